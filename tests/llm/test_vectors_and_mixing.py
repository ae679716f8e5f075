"""Top-k, near-duplicate vectors, source mixing and the pipeline against brute force."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tillmark.llm import bpe, jaccard, lines, mixing, quality, queries, topk, vectors

FOLDER = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
BAD = [None, [], [1.0, None, 0.0, 0.0], [NAN, 0.0, 0.0, 1.0], [INF, 0.0, 0.0, 1.0]]


def brute_top(rows, k):
    valid = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = Counter()
    for q, x in {i: v for i, v in valid if i % 20 == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(x, v, strict=True)), i) for i, v in valid if i != q and len(v) == len(x))
        want.update((q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k]))
    return want


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_top_k_against_brute_force(spark, embeddings, scale, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(3)
    rows = [(i, (scale * rng.normal(size=4)).tolist()) for i in range(300)]
    rows += [(300 + i, [scale, 0.0, 0.0, 0.0]) for i in range(60)] + [(400 + i, v) for i, v in enumerate(BAD)] + [(500, [1.0, 2.0]), (501, [2.0, 1.0]), (None, [0.0] * 4)]
    got = topk.top_k(embeddings(rows).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector")), F.col("vec_id") % 20 == 0, 20)
    assert Counter(tuple(r) for r in got.collect()) == brute_top(rows, 20)


def test_top_k_few_candidates(embeddings):
    rows = [(0, [-1.0, 2.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (20, [-3.0, -3.0])]
    ask = lambda data: topk.top_k(embeddings(data).select("vec_id", topk.whole_numbers(F.col("embedding")).alias("vector")), F.col("vec_id") % 20 == 0, 5)
    assert Counter(tuple(r) for r in ask(rows).collect()) == brute_top(rows, 5)
    assert ask([]).count() == 0 and ask([(1, [1.0])]).count() == 0


def brute_near(rows, threshold):
    unit = {}
    for n, (_, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            scaled = np.array(v) / max(map(abs, v))
            unit[n] = scaled / np.linalg.norm(scaled)
    root, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[max(top(a), top(b))] = min(top(a), top(b))
    return Counter((rows[i][0], links[i], rows[top(i)][0], rows[top(i)][0] == rows[i][0]) for i in range(len(rows)))


def test_near_vectors_against_brute_force(embeddings, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 50)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 4))
    rows = [(i, (centres[i % 9] + 0.25 * rng.normal(size=4)).tolist()) for i in range(200)]
    rows += [(200 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(80)] + [(300 + i, v) for i, v in enumerate([*BAD, [0.0] * 4, [1e300, 0.0], [1e-300, 0.0]])]
    assert Counter(tuple(r) for r in vectors.near_duplicates(embeddings(rows)).collect()) == brute_near(rows, 0.9)
    assert vectors.near_duplicates(embeddings([])).count() == 0


def test_bounds_leave_few_pairs_open():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64))
    x[300:] = x[:300] + 0.35 * rng.normal(size=(300, 64))
    a, b, anew = vectors.links_of_tile(x, x, 0.9, True)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True) if i < j}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want
    assert 0 < anew < 0.01 * 600 * 600


def test_mixing_matches_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    got = queries.op9_mix_sources(spark, FOLDER)
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES['op9_mix_sources']})").fetchall()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_mixing_reaches_the_target(documents):
    docs = documents([(i, "x" * 100, "big" if i < 1500 else "small" if i < 1600 else None) for i in range(1700)])
    mixed = mixing.mix(docs, {"big": 1, "small": 3}, budget=200_000)
    assert mixed.columns == [*docs.columns, "copy"]
    counts = Counter(r["source"] for r in mixed.collect())
    assert set(counts) == {"big", "small"}
    assert abs(counts["big"] - 500) < 90 and abs(counts["small"] - 1500) < 160
    again = mixing.mix(docs.repartition(7), {"big": 1, "small": 3}, budget=200_000)
    key = lambda rows: Counter((r["doc_id"], r["copy"]) for r in rows.collect())
    assert key(again) == key(mixed)
    ids = [r["doc_id"] for r in mixed.filter("source = 'small'").collect()]
    assert ids != sorted(ids)


def test_mixing_large_rates_and_odd_rows(documents):
    docs = documents([(1, "abcd", "a"), (2, None, "b"), (None, "", None), (3, "xy", None)])
    counts = Counter(r["doc_id"] for r in mixing.mix(docs, {"a": 1.0}, budget=4 * 1800).collect())
    assert set(counts) == {1} and abs(counts[1] - 1800) < 250
    even = {r["doc_id"] for r in mixing.mix(docs, budget=6000.0).collect()}
    assert even == {1, 3, None}
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(docs, {"none": 1.0}).count() == 0
    with pytest.raises(ValueError, match="weights"):
        mixing.mix(docs, {"a": -1.0})


def test_mixing_stays_in_dataframe_functions(documents):
    plan = mixing.mix(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stages_against_their_operations(spark):
    import public_tokenizers

    docs = queries.table(spark, FOLDER, "documents")
    labels = queries.table(spark, FOLDER, "labels")
    rows = lambda df: Counter(tuple(r) for r in df.collect())
    assert [len(corpus_pipeline.STAGES), corpus_pipeline.STAGES[1][0]] == [5, "line dedup"]
    for (_, stage), alone in zip(
        corpus_pipeline.STAGES[:4],
        [lambda d: quality.keep_good(d, labels), None, jaccard.keep_one, lambda d: mixing.mix(d).drop("copy")],
        strict=True,
    ):
        out = stage(spark, docs, FOLDER).cache()
        assert out.columns == docs.columns
        if alone:
            assert rows(out) == rows(alone(docs))
        else:
            left = {r["doc_id"]: r["text"] for r in lines.deduplicate(docs).collect()}
            had = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: t for i, t in left.items() if (t or "").strip() or not (had[i] or "").strip()}
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        docs = out
    want = bpe.round_trip(docs, queries.tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert rows(corpus_pipeline.run(spark, FOLDER)) == rows(want)
