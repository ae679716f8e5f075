from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from tillmark.llm import spelling


def brute(rows):
    """word -> (form, root, n, n_near, form_n), straight from the definition: all pairs of words."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        around = [v for v in words if near(w, v)]
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, w, n, len(around), words[form] if form else None]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def found(docs):
    rows = spelling.variants(docs).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


def altered(word, rng, letters="abcdefgéÿÀ"):
    i = rng.randrange(len(word) + 1)
    return rng.choice([word[:i] + rng.choice(letters) + word[i:], word[:i] + word[i + 1 :], word[:i] + rng.choice(letters) + word[i + 1 :]])


@pytest.fixture
def variants():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(7, 17))) for _ in range(40)]
    bag = []
    for k, word in enumerate(words):
        bag += [word] * (120 if k % 3 == 0 else 11)
        for _ in range(12):
            bag += [altered(word, rng)] * rng.randint(1, 9)
            bag += [altered(altered(word, rng), rng)] * rng.randint(1, 3)
    rng.shuffle(bag)
    return [(i, " ".join(bag[i::300])) for i in range(300)]


def test_all_columns_equal_brute_force(documents, variants):
    rows = [*variants, (None, "Mistaken, MISTAKEN mistaken mistakn"), (1000, None), (1001, ""), (1002, "a-b.c short12words")]
    rows += [(2000 + i, "qrstuvwxyz " * 10 + "qrstuvwxya " * (i < 30) + "qrstuvwxaa " * (i < 2)) for i in range(40)]  # a chain of forms
    got = found(documents(rows))
    assert got == brute(rows)
    assert any(v[0] for v in got.values()) and any(v[1] != v[0] for w, v in got.items() if v[0])


def test_every_edit_of_every_length_is_near(documents):
    alphabet = "abcdefghijklmnopqr"
    rows, pairs = [], 0
    for size in range(7, 18):
        word = alphabet[:size]
        edits = {word[:i] + word[i + 1 :] for i in range(size)} | {word[:i] + "ÿ" + word[i:] for i in range(size + 1)} | {word[:i] + "z" + word[i + 1 :] for i in range(size)}
        kept = [e for e in edits if len(e) >= 7]
        rows += [(size, " ".join([word, word, *kept, *kept]))]
    got = found(documents(rows))
    assert got == brute(rows)


def test_ties_go_to_the_first_in_code_point_order(documents):
    # four words one letter apart, the frequent ones with the same count
    frequent = " ".join(["aaaaaaab"] * 40 + ["aaaaaaaà"] * 40 + ["aaaaaaa\u00ff"] * 40)
    rows = [(k, frequent + " aaaaaaaa") for k in range(4)]
    assert found(documents(rows)) == brute(rows)


def test_one_very_long_text_and_a_run_over_the_slices(documents, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 1000)
    long = "x" * 2500 + " " + " ".join(f"wordnumber{chr(97 + i % 20)}é" for i in range(3000)) + " " + "y" * 999
    assert spelling.runs(long) == Counter(re.findall(rb"[a-z\xc0-\xff]{7,}", long.encode("latin-1").lower()))
    monkeypatch.undo()
    rows = [(3, long * 3), (4, "Wordnumber " * 5)]
    assert found(documents(rows)) == brute(rows)


def test_repeated_rows_count_and_an_empty_table_is_empty(documents):
    rows = [(1, "hesitate hesitatx")] * 30
    assert found(documents(rows)) == brute(rows)
    assert found(documents([])) == {}
    assert found(documents([(1, None), (2, "  "), (3, "日本語 ЖЖЖЖЖЖЖ once")])) == {}


def test_counts_are_the_same_however_few_words_a_task_holds(documents, variants):
    few, many = ({r["word"]: r["n"] for r in spelling.occurrences(documents(variants), held).collect()} for held in (3, 10_000))
    assert few == many and few


def test_a_typo_takes_one_code_point():
    assert len(spelling.mistyped("abcdéfg".encode("latin-1"), 0, every=1)) == 6
    assert spelling.mistyped(b"abcdefg", 0, every=2**40) == b"abcdefg"
