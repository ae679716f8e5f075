"""Exact top-k inner products by a three-phase uniform threshold (Cao and Wang, PODC 2004).

The components are split into LISTS; a list scores a query and a candidate by the inner product of its own components, and
the sum over the lists is the score. Queries and candidates are packed into blocks, and a task holds one block of either
for one list, so the lists never meet as a whole.

1. Every list reports its k best candidates of each query. Their full scores are computed, and the k-th best of them is
   a safe cutoff: k candidates score at least that much.
2. The cutoff goes back with the query blocks. A candidate that reaches it reaches cutoff / LISTS in some list, so each
   list sends all entries of at least that much. Candidates that all lists sent have their full score, which may raise
   the cutoff.
3. What the lists did not send of a candidate is below cutoff / LISTS each. Candidates that could still reach the cutoff
   get their missing scores computed; the k best of all are the answer.

Every phase is exact for negative scores too. Entries travel as arrays per pair of blocks, bounded by the blocks' sizes;
only the k best of a task travel as rows.

Cases: vectors that are null, empty or hold a null, NaN or infinite component take no part; vectors of different length
do not meet. A query's own row is every candidate with its id. Fewer candidates than k are all returned; equal scores
go to the smaller id. Repeated rows are candidates each; a repeated query row is one query. Rows with a null id take no
part. Scores must fit 64 bits. An empty table, or one without queries, gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.tiles import block_counts, blocks, exact_product, finite, norm_bound
from tillmark.sources.shared import written

LISTS, ROW_BLOCK, QUERY_BLOCK = 2, 4096, 512
LOWEST = -(2**63)
_ROWS = pa.schema([("list", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
_BEST = "list int, query_id long, vec_id long, score long"


def cuts(dim: int) -> list[slice]:
    """The components of each list."""
    edges = [dim * i // LISTS for i in range(LISTS + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:], strict=False)]


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def best_per_row(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Of entries with a query number, a candidate and a score, the indices of each query's k best."""
    order = np.lexsort((ids, -scores, rows))
    sorted_rows = rows[order]
    first = np.searchsorted(sorted_rows, sorted_rows)
    return order[np.arange(len(order)) - first < k]


def _top(product: np.ndarray, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and candidate numbers of the k best of each row of a product, its own row left out, all ties at the edge
    included before the smaller ids win."""
    n = product.shape[1]
    if n > k + 1:
        edge = np.partition(product, n - k - 1, axis=1)[:, n - k - 1]  # one more, for the query's own row
        a, b = np.nonzero(product >= edge[:, None])
    else:
        a, b = map(np.ravel, np.indices(product.shape))
    other = ids[b] != queries[a]
    a, b = a[other], b[other]
    keep = best_per_row(a, ids[b], product[a, b].astype(np.int64), k)
    return a[keep], b[keep]


def _batch(part: int, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(queries), pa.array(ids), pa.array(scores.astype(np.int64))], schema=_ROWS)


def _units(query_blocks: DataFrame, row_blocks: DataFrame, per_list: bool) -> DataFrame:
    """Each block of queries beside each block of candidates of the same length, for each list or for all at once.

    With ``per_list`` the candidates' components are cut to the list's before they travel; the small query blocks travel
    whole.
    """
    rows = row_blocks.select("dim", F.col("block").alias("rows"), F.col("vec_id").alias("ids"), "data")
    if per_list:
        rows = rows.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(LISTS - 1)))).mapInArrow(
            _cut, "dim int, rows int, ids binary, data binary, list int"
        )
    queries = query_blocks.join(block_counts(row_blocks), "dim").withColumn("rows", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return queries.select("dim", "rows", F.col("block").alias("queries"), F.col("vec_id").alias("query_ids"), F.col("data").alias("query_data"), *[c for c in ("cutoffs",) if c in query_blocks.columns]).join(rows, ["dim", "rows"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            row["data"] = np.ascontiguousarray(_matrix(row["data"], row["dim"])[:, cuts(row["dim"])[row["list"]]]).tobytes()
            yield pa.RecordBatch.from_pylist([row], schema=batch.schema)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _products(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and the list's partial scores."""
    part = cuts(row["dim"])[row["list"]]
    q = _matrix(row["query_data"], row["dim"])[:, part]
    v = np.frombuffer(row["data"], "<i8").reshape(-1, part.stop - part.start)
    ids, queries = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8")
    if part.stop == part.start:
        return queries, ids, np.zeros((len(queries), len(ids)), np.int64)
    return queries, ids, exact_product(q, v, norm_bound(q, v))


def _kth(rows: DataFrame, k: int) -> DataFrame:
    """query_id, cutoff: the k-th best score of each query that has k."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return ranked.filter(F.col("_rank") == k).select("query_id", F.col("score").alias("cutoff"))


def _with_cutoffs(query_blocks: DataFrame, cutoffs: DataFrame, queries: DataFrame) -> DataFrame:
    """The query blocks with one cutoff for each of their queries, in their order; LOWEST where there is none."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            known = dict(zip(row.pop("known_ids") or [], row.pop("known") or [], strict=True))
            row["cutoffs"] = np.array([known.get(q, LOWEST) for q in np.frombuffer(row["vec_id"], "<i8").tolist()], "<i8").tobytes()
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("vec_id", pa.binary()), ("data", pa.binary()), ("cutoffs", pa.binary())])
    placed = cutoffs.join(queries, "query_id").groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("_known"))
    joined = query_blocks.select("dim", "block", "vec_id", "data").join(placed, ["dim", "block"], "left")
    joined = joined.select("dim", "block", "vec_id", "data", F.col("_known.query_id").alias("known_ids"), F.col("_known.cutoff").alias("known"))
    return joined.mapInArrow(spread, "dim int, block int, vec_id binary, data binary, cutoffs binary")


def _query_places(query_blocks: DataFrame) -> DataFrame:
    """query_id, dim, block."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            ids = np.unique(np.frombuffer(row["vec_id"], "<i8"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.full(len(ids), row[c], np.int32)) for c in ("dim", "block"))], names=["query_id", "dim", "block"])

    return query_blocks.select("dim", "block", "vec_id").mapInArrow(unpack, "query_id long, dim int, block int")


def top_k(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each query with other rows.

    ``vector`` is an array of whole numbers (null: the row takes no part); ``is_query`` chooses the queries.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    chosen = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    taken = written(chosen.filter("vec_id is not null and vector is not null and size(vector) > 0"), "topk-rows")
    row_blocks = blocks(taken, ["vec_id"], "vector", ROW_BLOCK, "topk-blocks")
    asked = taken.filter("query").groupBy("vec_id", F.size("vector").alias("_dim")).agg(F.min("vector").alias("vector"))
    query_blocks = blocks(written(asked.select("vec_id", "vector"), "topk-queries"), ["vec_id"], "vector", QUERY_BLOCK, "topk-query-blocks")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            queries, ids, product = _products(row)
            a, b = _top(product, queries, ids, k)
            yield _batch(row["list"], queries[a], ids[b], product[a, b])

    # Phase 1: local lists, their candidates' full scores, and the cutoff.
    local = _units(query_blocks, row_blocks, per_list=True).mapInArrow(lists, _BEST)
    order = Window.partitionBy("list", "query_id").orderBy(F.col("score").desc(), "vec_id")
    seen = local.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k).select("query_id", "vec_id").distinct()
    scored = seen.join(asked.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("_q"), F.col("_dim")), "query_id")
    scored = scored.join(taken.select("vec_id", F.col("vector").alias("_v")), "vec_id").filter(F.size("_v") == F.col("_dim"))
    total = F.aggregate(F.zip_with("_q", "_v", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    places = _query_places(query_blocks)
    cutoffs = written(_kth(scored.select("query_id", "vec_id", total.alias("score")), k), "topk-cutoffs")

    # Phase 2: every list's entries of at least cutoff / LISTS, met again by pair of blocks.
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            queries, ids, product = _products(row)
            cutoff = np.frombuffer(row["cutoffs"], "<i8")
            least = np.where(cutoff == LOWEST, LOWEST, -((-cutoff) // LISTS))  # the whole number not below cutoff / LISTS
            a, b = np.nonzero(product >= least[:, None])
            other = ids[b] != queries[a]
            a, b = a[other], b[other]
            values = [row["dim"], row["queries"], row["rows"], row["list"], (a * len(ids) + b).astype("<i8").tobytes(), product[a, b].astype("<i8").tobytes()]
            yield pa.RecordBatch.from_pylist([dict(zip(sent.names, values, strict=True))], schema=sent)

    sent = pa.schema([*((n, pa.int32()) for n in ("dim", "queries", "rows", "list")), ("place", pa.binary()), ("score", pa.binary())])
    limited = _with_cutoffs(query_blocks, cutoffs, places)
    gathered = _units(limited, row_blocks, per_list=True).mapInArrow(entries, "dim int, queries int, rows int, list int, place binary, score binary")
    met = gathered.groupBy("dim", "queries", "rows").agg(F.collect_list(F.struct("list", "place", "score")).alias("lists"))  # LISTS items
    whole = row_blocks.select("dim", F.col("block").alias("rows"), F.col("vec_id").alias("ids"), "data")
    asking = limited.select("dim", F.col("block").alias("queries"), F.col("vec_id").alias("query_ids"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full scores where all lists sent one, else the sum so far and which lists sent it."""
        for row in _each(batches):
            place = np.concatenate([np.frombuffer(x["place"], "<i8") for x in row["lists"]])
            score = np.concatenate([np.frombuffer(x["score"], "<i8") for x in row["lists"]])
            bit = np.concatenate([np.full(len(x["place"]) // 8, 1 << x["list"], np.int64) for x in row["lists"]])
            at, back = np.unique(place, return_inverse=True)
            total, mask = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            np.add.at(total, back, score)
            np.add.at(mask, back, bit)
            full = mask == (1 << LISTS) - 1
            n, ids, queries = len(row["ids"]) // 8, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["query_ids"], "<i8")
            a, b = at[full] // n, at[full] % n
            keep = best_per_row(a, ids[b], total[full], k)
            a, b, best = a[keep], b[keep], total[full][keep]
            values = [row["dim"], row["queries"], row["rows"], queries[a].tobytes(), ids[b].tobytes(), best.tobytes(), at[~full].tobytes(), total[~full].tobytes(), mask[~full].tobytes()]
            yield pa.RecordBatch.from_pylist([dict(zip(merged.names, values, strict=True))], schema=merged)

    merged = pa.schema([*((n, pa.int32()) for n in ("dim", "queries", "rows")), *((n, pa.binary()) for n in ("query", "vec", "best", "place", "part", "mask"))])
    joined = met.join(whole.drop("data"), ["dim", "rows"]).join(asking, ["dim", "queries"])
    state = written(joined.mapInArrow(merge, "dim int, queries int, rows int, query binary, vec binary, best binary, place binary, part binary, mask binary"), "topk-entries")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield _batch(0, *(np.frombuffer(row[c], "<i8") for c in ("query", "vec", "best")))

    known = state.select("query", "vec", "best").mapInArrow(complete, _BEST)
    raised = _kth(known, k).union(cutoffs).groupBy("query_id").agg(F.max("cutoff").alias("cutoff"))

    # Phase 3: what could still reach the raised cutoff.
    final = _with_cutoffs(query_blocks, raised, places).select("dim", F.col("block").alias("queries"), F.col("vec_id").alias("query_ids"), F.col("data").alias("query_data"), F.col("cutoffs").alias("raised"))
    first = limited.select("dim", F.col("block").alias("queries"), "cutoffs")

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            queries, ids = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
            cutoff, high = np.frombuffer(row["cutoffs"], "<i8"), np.frombuffer(row["raised"], "<i8")
            place, part, mask = (np.frombuffer(row[c], "<i8") for c in ("place", "part", "mask"))
            a, b = place // len(ids), place % len(ids)
            missing = LISTS - sum((mask >> i) & 1 for i in range(LISTS))
            # In doubles with room for rounding; a query without a cutoff has sent everything.
            reach = part.astype(np.float64) + missing * (cutoff[a].astype(np.float64) / LISTS)
            near = np.flatnonzero((cutoff[a] == LOWEST) | (reach * (1 + 1e-12 * np.sign(reach)) + 1 >= high[a]))
            a, b, score, mask = a[near], b[near], part[near].copy(), mask[near]
            q, v = _matrix(row["query_data"], row["dim"]), _matrix(row["data"], row["dim"])
            for i, cut in enumerate(cuts(row["dim"])):
                lack = np.flatnonzero((mask >> i) & 1 == 0)
                for start in range(0, len(lack), 1 << 16):
                    some = lack[start : start + (1 << 16)]
                    score[some] += np.einsum("ij,ij->i", q[a[some], cut], v[b[some], cut])
            keep = best_per_row(a, ids[b], score, k)
            yield _batch(0, queries[a[keep]], ids[b[keep]], score[keep])

    open_ = state.select("dim", "queries", "rows", "place", "part", "mask").join(whole, ["dim", "rows"]).join(final, ["dim", "queries"]).join(first, ["dim", "queries"])
    every = known.union(open_.mapInArrow(resolve, _BEST)).select("query_id", "vec_id", "score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def whole_numbers(vector: Column, factor: int = 64) -> Column:
    """floor(factor * component) of a vector whose components are all finite, else null."""
    return F.when(finite(vector), F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))
