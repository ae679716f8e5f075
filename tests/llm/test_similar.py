"""Jaccard join, line deduplication and components against brute force over small, skewed inputs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm import components, jaccard, lines, similar
from tillmark.llm.components import connected
from tillmark.llm.similar import in_blocks, shared_buckets

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_sets(text):
    words = WORDS.findall((text or "").translate(LOWER))
    return frozenset([tuple(words)] if 0 < len(words) < 5 else [tuple(words[i : i + 5]) for i in range(len(words) - 4)])


def roots(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def near_copies(prose, base, n, changes, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(prose):
    """Copies, near copies around the threshold, texts that share a passage, short, empty and odd ones."""
    passage = prose(13, 1)
    texts = [None, "", " \t\n", "one", "One", "one two three four", "ONE two\tthree  four", "é É"]
    for seed, size in enumerate((8, 14, 30, 60, 150, 400)):
        texts += near_copies(prose, prose(size, 50 + seed), 12, max(1, size // 25), seed)
    texts += [f"{passage} {prose(n, 500 + i)}" for i, n in enumerate([4, 6, 8, 10, 30] * 8)]
    texts += [prose(120, 7)] * 40 + [prose(n, 900 + n) for n in range(1, 40)]
    return texts


@pytest.mark.parametrize("held", [3, 25, 300_000])
def test_components_of_links(spark, held):
    """One piece of a forest, or many that star rounds must put together."""
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 299), (300, 299)]
    got = {r["id"]: r["component"] for r in connected(spark.createDataFrame(pairs, "a long, b long"), held=held).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 299: 299, 300: 299}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_no_rounds_of_stars(spark, monkeypatch):
    """A chain dealt over many partitions, which shrinks by a round of stars only slowly."""
    rounds, stored = [], components.written
    monkeypatch.setattr(components, "written", lambda df, name: rounds.append(name) or stored(df, name))
    links = spark.range(400).selectExpr("id as a", "id + 1 as b").repartition(16)
    assert {r["component"] for r in connected(links).collect()} == {0} and len(rounds) == 2


def test_signatures_of_the_same_ids_are_one_bucket(spark):
    """Two near copies share nearly all of their signatures, but are met once."""

    def signed(batches):
        import pyarrow as pa

        for batch in batches:
            sigs = [s * 0x61C8864680B583EB % 2**63 for i in batch.column(0).to_pylist() for s in range(200 * (i // 2), 200 * (i // 2) + 190 + i)]
            ids = [i for i in batch.column(0).to_pylist() for _ in range(190 + i)]
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(ids, pa.int64())], names=["sig", "id"])

    blocks = spark.range(0, 6, 1, 3).mapInArrow(in_blocks(signed), "bucket int, pairs binary")
    assert sum(len(r["pairs"]) for r in blocks.collect()) == 13 * sum(190 + i for i in range(6))
    found = shared_buckets(blocks).collect()
    assert sorted(r["id"] for r in found) == [0, 1, 2, 3, 4, 5]
    assert len({r["sig"] for r in found}) == 3 and all(len({r["sig"] for r in found if r["id"] // 2 == k}) == 1 for k in range(3))


def test_ids_that_are_hashes_travel_in_few_bytes(spark, prose):
    rows = spark.createDataFrame([(i, 0, prose(60 + i, 1)) for i in range(8)], "id long, mark long, text string").coalesce(1)
    sets = [jaccard.shingles(prose(60 + i, 1)) for i in range(8)]
    blocks = jaccard.set_signatures(rows, 5, 80)
    assert sum(len(r["pairs"]) for r in blocks.collect()) == 9 * sum(len(jaccard.signatures(s, 80)) for s in sets)
    lows = spark.createDataFrame([jaccard.fingerprint(s)[1:] for s in sets], "low long")
    short = {r[0] for r in lows.select(similar.short("low")).collect()}
    assert len(short) == 8 and all(0 <= x < 2**40 for x in short)
    assert {r["id"] for r in shared_buckets(blocks, similar.HASHED).collect()} == short


def test_bodies_go_straight_to_what_they_are_compared_with(spark, monkeypatch):
    """No body is stored or gathered by its id, and rows that come twice change nothing."""
    names, asked, stored = [], [], similar.written
    monkeypatch.setattr(similar, "written", lambda df, name: names.append(name) or stored(df, name))
    bodies = spark.createDataFrame([(i, f"{i % 3}") for i in range(6)] * 2, "id long, body string")

    def bodies_of(ids):
        asked.append(ids.count())
        return ids.join(bodies, "id")

    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)], "a long, b long")
    found = similar._compared(pairs, bodies_of, lambda a, b: a == b)
    assert {tuple(r) for r in found.collect()} == {(0, 1, False), (0, 2, False), (0, 3, True), (1, 4, True), (1, 5, False)}
    assert sorted(asked) == [2, 5] and names == ["pairs", "compared"]


@pytest.mark.parametrize("high", [2, None])
def test_a_pair_of_many_buckets_meets_once(spark, high):
    fields = ", ".join(f"{w} long" for w in similar.outline_fields())
    # 1 to 4 share 40 buckets, each with one of the ids 10 to 49 besides, so that no two buckets have the same ids.
    rows = [(s, i, place, i, 100, *[0] * similar.WORDS) for s in range(40) for place, i in enumerate([1, 2, 3, 4, 10 + s], 1)]
    table = spark.createDataFrame(rows, f"sig long, id long, place long, component long, size long, {fields}")
    active = similar._with_least(table, high)
    pairs = [(r.a, r.b) for r in similar._meetings(active, 80, high, 5).collect()]
    last = high or 4
    wanted = {(a, b) for a in range(1, last + 1) for b in [2, 3, 4, *range(10, 50)] if a < b}
    assert sorted(pairs) == sorted(wanted)


def test_pairs_without_a_least_signature_in_common_meet(spark):
    fields = ", ".join(f"{w} long" for w in similar.outline_fields())
    # The smallest signatures of 1 are shared with 3, those of 2 with 4; 1 and 2 share only large ones.
    buckets = [(s, (1, 3)) for s in range(10)] + [(s, (2, 4)) for s in range(10, 20)] + [(s, (1, 2)) for s in range(20, 23)]
    rows = [(s, i, place, i, 100, *[0] * similar.WORDS) for s, ids in buckets for place, i in enumerate(ids, 1)]
    table = spark.createDataFrame(rows, f"sig long, id long, place long, component long, size long, {fields}")
    found = similar._meetings(similar._with_least(table, None), 80, None, 2)
    assert {(r.a, r.b) for r in found.collect()} == {(1, 2), (1, 3), (2, 4)}


def test_jaccard_join_against_brute_force(spark, documents, prose):
    texts = corpus(prose)
    random.Random(3).shuffle(texts)
    sets = [word_sets(t) for t in texts]
    linked = lambda i, j: bool(sets[i]) and bool(sets[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    want = {(i, len(sets[i]), r) for i, r in enumerate(roots(len(texts), linked))}
    docs = documents(list(enumerate(texts))).repartition(5)
    assert {tuple(r) for r in jaccard.components(docs).collect()} == want
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _, r in want if i == r)


def test_jaccard_join_odd_rows(documents):
    same = "a b c d e f g"
    docs = documents([(1, same), (1, same), (None, same), (2, same), (3, "z" * 300_000), (4, "z" * 300_000)])
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.components(docs).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (None, None)]
    assert sorted((r["doc_id"] for r in jaccard.keep_one(docs).collect()), key=str) == [1, 3, None]
    empty = documents([])
    assert jaccard.components(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_only_rows_that_repeat_an_id_travel_to_be_one(spark, documents, prose):
    rows = [(1, prose(50, 1)), (2, prose(50, 2)), (2, prose(50, 3)), (3, prose(50, 1)), (None, prose(50, 4)), (None, prose(50, 4)), (4, None), (4, None), (5, "")]
    kept = jaccard.keep_one(documents(rows))
    assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 4, 5, None, None]
    alone = jaccard.keep_one(documents([(i, prose(50, i % 5)) for i in range(9)]))
    assert "Exchange hashpartitioning" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["doc_id"] for r in alone.collect()) == [0, 1, 2, 3, 4]


def test_rows_that_repeat_an_id_with_other_texts_lose_no_link(documents, prose):
    one, other = prose(60, 1), prose(60, 2)
    rows = [(1, one), (2, one + " more"), (2, other), (3, other), (4, other + " again"), (5, prose(60, 3)), (6, prose(40, 4)), (6, None), (6, "")]
    for seed in range(4):
        random.Random(seed).shuffle(rows)
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.components(documents(rows).repartition(1 + seed)).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6)}
    kept = sorted(r["doc_id"] for r in jaccard.keep_one(documents(rows)).collect())
    assert kept == [1, 5, 6]


@pytest.mark.parametrize("size", [4, 5, 9, 20, 77, 300])
def test_similar_sets_share_a_signature(size):
    """Every pair at the edge of the threshold, sets with many empty parts included."""
    rng = np.random.default_rng(size)
    for _ in range(60):
        gone = size // 5
        base = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for a, b in [(base, base[gone:]), (np.append(base, rng.integers(0, 2**64, gone // 2 + (size == 4), dtype=np.uint64)), base[gone // 4 :])]:
            a, b = np.unique(a), np.unique(b)
            if len(a) != len(b) and jaccard.similar_sets(a, b, 80):
                assert set(jaccard.signatures(a, 80).tolist()) & set(jaccard.signatures(b, 80).tolist())


def test_shingles_do_not_depend_on_place():
    assert set(jaccard.shingles("x y " + "a b c d e").tolist()) > set(jaccard.shingles("A\tb  c\nd e").tolist())
    long = "w " * 200_000 + "end"
    assert len(jaccard.shingles(long)) == 2


def line_answer(texts):
    """Texts after deduplication, by comparing all lines with all."""
    places = [(i, p, n) for i, t in enumerate(texts) for p, n in lines.long_lines(t or "")]
    kinds = sorted({n for _, _, n in places}, key=lambda n: min((i, p) for i, p, m in places if m == n))
    sets = [lines.grams(k) for k in kinds]
    root = roots(len(kinds), lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))
    first = {}
    for i, p, n in places:
        component = root[kinds.index(n)]
        first.setdefault(component, (i, p))
    gone = {(i, p) for i, p, n in places if first[root[kinds.index(n)]] != (i, p)}
    return [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)]


def test_lines_against_brute_force(documents, prose):
    common = "This line stands in very many documents of the collection."
    texts = [None, "", "\n\n", "short\nshort", common, common.upper() + "\nmore than twenty characters here"]
    base = prose(25, 3)
    texts += [f"{prose(12, i)}\n{common}\n{near}" for i, near in enumerate(near_copies(prose, base, 25, 1, 2))]
    texts += ["\n".join([prose(9, 70 + i), common, prose(9, 70 + i), "of", "of"]) for i in range(5)]
    docs = documents(list(enumerate(texts))).repartition(4)
    got = lines.deduplicate(docs)
    assert got.columns == docs.columns
    assert [r["text"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == line_answer(texts)
    report = {r["doc_id"]: r for r in lines.report(docs).collect()}
    assert report[2]["n_lines"] == report[2]["n_kept"] == 3 and report[0]["n_lines"] == 0


def test_short_lines_against_brute_force(documents):
    """Every line but blank ones takes part; lines are cut and compared here, without the module."""
    notice = "subscribe to news!"
    shown = [None, "", " \n\t\n", "Menu", "menu\nhome", "of\nof\nOF \n  of", f"{notice}\n{notice}!", notice[:-1], "ok", "日本語の文です。", "日本語の文です。\n中文", "-----\n--------"]
    texts = shown + ["\n".join([f"call us {i:02d}", "back to top", "Back  to top", "", "x" * (i % 9)]) for i in range(30)]

    def sets(line):
        return {line[i : i + 5] for i in range(len(line) - 4)} or {line}

    cut = [(i, p, " ".join(x.lower().split())) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n"))]
    cut = [(i, p, sets(n)) for i, p, n in cut if n]
    root = roots(len(cut), lambda a, b: 100 * len(cut[a][2] & cut[b][2]) >= 80 * len(cut[a][2] | cut[b][2]))
    gone = {cut[i][:2] for i, r in enumerate(root) if r != i}
    want = [None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone) for i, t in enumerate(texts)]
    got = lines.deduplicate(documents(list(enumerate(texts))).repartition(3))
    assert [r["text"] for r in sorted(got.collect(), key=lambda r: r["doc_id"])] == want


def test_bands_find_similar_short_lines():
    """Pairs of 8 to 24 characters at a similarity of 0.8 to 0.9: one is the other and one or two characters more."""
    rng, pairs = random.Random(5), []
    while len(pairs) < 600:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(8, 22)))
        b = a + "".join(rng.choice("0123456789") for _ in range(rng.randint(1, 2)))
        if 100 * len(lines.grams(a)) >= 80 * len(lines.grams(b)):
            pairs.append((a, b))
    one, two = lines.bands_of([a for a, _ in pairs]), lines.bands_of([b for _, b in pairs])
    assert np.mean((one == two).any(1)) > 0.985


def test_lines_that_are_like_no_other_are_not_joined_with_documents(documents, monkeypatch):
    kept, counts = lines.written, {}

    def counted(table, name):
        out = kept(table, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(lines, "written", counted)
    alone = [f"{chr(97 + i) * 9} line {i * i * 7919} {chr(110 - i) * 8}" for i in range(12)]
    near = "the quick brown fox jumps over the lazy dog and runs far away into the deep dark wood"
    texts = ["\n".join([*alone[:6], "a repeated line"]), "\n".join(["A  repeated line", *alone[6:]]), near, near + "s"]
    left = {r.doc_id: r.text for r in lines.report(documents(list(enumerate(texts)))).collect()}
    assert left == {0: texts[0], 1: "\n".join(alone[6:]), 2: near, 3: ""}
    assert counts["line-firsts"] == 3  # the repeated line and the two that are similar


def test_workers_do_not_load_pandas_for_the_pipeline():
    import subprocess
    import sys

    code = "import sys; import tillmark.llm.quality, tillmark.llm.lines, tillmark.llm.jaccard, tillmark.llm.bpe; sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=lines.__file__.rsplit("/tillmark/", 1)[0]).returncode == 0


def test_lines_odd_rows(documents):
    line = "a line of more than twenty characters"
    docs = documents([(5, line), (5, line), (None, line), (6, f"{line}\n{line}")])
    got = sorted(((r["doc_id"], r["text"]) for r in lines.deduplicate(docs).collect()), key=str)
    assert got == [(5, ""), (5, ""), (6, ""), (None, line)]
    assert lines.deduplicate(documents([])).count() == 0


def test_bands_find_similar_lines(prose):
    rng, found, pairs = random.Random(1), 0, 0
    for seed in range(150):
        a = prose(30, 2000 + seed)
        b = a.split()
        b[rng.randrange(30)] = "other"
        b = " ".join(b)
        x, y = lines.grams(a), lines.grams(b)
        if 100 * len(x & y) >= 80 * len(x | y):
            one, two = lines.bands_of([a, b])
            pairs, found = pairs + 1, found + bool(set(one.tolist()) & set(two.tolist()))
    assert pairs > 100 and found >= 0.98 * pairs


def test_the_line_stage_keeps_columns_of_any_name(spark, documents):
    import corpus_pipeline

    names = ("_had_text", "row", "lines", "dropped", "places", "mark", "_doc")
    rows = [(1, "one line of text\ntwo"), (2, "one line of text"), (3, None), (4, ""), (5, "one line of text\nthree")]
    docs = documents(rows).withColumns({c: F.lit(c) for c in names})
    got = corpus_pipeline.distinct_lines(spark, docs, "")
    assert got.columns == docs.columns
    kept = {r["doc_id"]: r for r in got.collect()}
    assert {i: r["text"] for i, r in kept.items()} == {1: "one line of text\ntwo", 3: None, 4: "", 5: "three"}  # 2 lost its only line
    assert kept[5]["n_chars"] == 5 and all(r[c] == c for r in kept.values() for c in names)
