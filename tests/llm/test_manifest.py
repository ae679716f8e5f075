from __future__ import annotations

import random
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tillmark.llm import manifest

CLASHING = ("tree", "place", "node", "n", "at", "piece", "block", "changed", "leaf")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"{c} string" for c in CLASHING)


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    """Every column of the result, straight from the definition."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] if row[0] is not None else -(10**18), leaf_of(row), row))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda x: (x[0], x[1]))
    levels = {lang: levels_of([x[1] for x in trees[lang]]) for lang in order}
    upper = levels_of([levels[lang][-1][0] for lang in order])
    root, out = upper[-1][0], []
    for k, lang in enumerate(order):
        for place, (_, leaf, row) in enumerate(trees[lang]):
            tampered = row[0] is not None and crc32(str(row[0]).encode()) % 3 == 0
            node = leaf_of((*row[:4], lowered(row[4]))) if tampered else leaf
            proof, at = "", place
            for steps in (levels[lang], upper):
                for level in steps[:-1]:
                    run = at - at % 8
                    left, right = "".join(level[run:at]), "".join(level[at + 1 : run + 8])
                    proof, node, at = proof + left + right, H(left, node, right), at // 8
                at = k
            out.append((row[0], leaf, levels[lang][-1][0], root, H(proof), node, node == root))
    return sorted(map(repr, out))


@pytest.fixture
def prove(spark):
    def run(rows):
        docs = spark.createDataFrame([(*r, *CLASHING) for r in rows], SCHEMA)
        tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
        found = manifest.prove(docs, tampered, manifest.ascii_lower(F.col("text")))
        return sorted(repr(tuple(r)) for r in found.collect()), docs

    return run


def text(rng):
    return rng.choice([None, "", "plain", "Ünï Ä Bé", "A" * rng.randint(1, 30), f"Word {rng.random()} \n\t end"])


def test_every_column_equals_brute_force_over_trees_of_several_groups(prove):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, "s", "Quelle"]), rng.choice(["en", "en", "en", "fr", "é", None]), rng.choice([None, i]), text(rng)) for i in range(1900)]
    rows += [(5000 + i, "s", f"rare{i}", 1, "X") for i in range(75)]  # more languages than a run, most with a lone leaf
    rng.shuffle(rows)
    got, _ = prove(rows)
    assert got == brute(rows)


def test_a_full_span_and_one_more(prove):
    for n in (manifest.SPAN, manifest.SPAN + 1):
        rows = [(i, "s", "en", i, f"Text {i}") for i in range(n)]
        got, _ = prove(rows)
        assert got == brute(rows)


def test_nulls_repeated_rows_and_repeated_ids(prove):
    rows = [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "Same")] * 20 + [(7, "s", "en", 1, t) for t in ("A", "b", None, "")]
    rows += [(-4, "", "", 0, "Empty language"), (10**18, "s", "en", 1, "Z" * 300_000)]
    got, _ = prove(rows)
    assert got == brute(rows)


def test_only_changed_texts_are_found(prove, spark):
    rows = [(i, "s", "en", 1, "UPPER" if i % 2 else "lower") for i in range(60)]
    got, docs = prove(rows)
    failed = {int(r.split(",")[0][1:]) for r in got if r.endswith("False)")}
    assert failed == {i for i in range(60) if i % 2 and crc32(str(i).encode()) % 3 == 0}


def test_one_row_is_its_own_root_and_no_rows_have_none(prove, spark):
    row = (4, "s", "en", 1, "a")
    got, docs = prove([row])
    assert got == [repr((4, leaf_of(row), leaf_of(row), leaf_of(row), H(""), leaf_of((*row[:4], "a")), True))]
    assert prove([])[0] == []
    assert manifest.manifest(docs.limit(0)).count() == 0


def test_manifest_has_a_row_for_each_language(prove, spark):
    rows = [(i, "s", ["en", None, "fr"][i % 3], i, f"T{i}") for i in range(100)]
    got, docs = prove(rows)
    found = {r["lang"]: (r["subroot"], r["root"]) for r in manifest.manifest(docs).collect()}
    assert set(found) == {"en", None, "fr"} and len({root for _, root in found.values()}) == 1
    assert all(any(sub in line and root in line for line in got) for sub, root in found.values())


def test_states_are_resumed_not_rebuilt():
    nodes = [H(str(i)).encode() for i in range(20)]
    tree = manifest.Midstates(nodes, manifest.height(20))
    changed = [*nodes[:13], b"x" * 64, *nodes[14:]]
    assert tree.fold(13, b"x" * 64, tree.siblings(13)) == manifest.Midstates(changed, manifest.height(20)).top
    assert [len(states) for states in tree.states] == [20, 3]
