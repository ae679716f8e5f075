"""Connected components of links between ids, as a distributed union-find.

First every partition of the links finds its own forest, so that it keeps one link a node at most, and a hot node has one link
from each partition instead of all of its own. The forests are put together in as few tasks as can hold them; where one can, that
is the answer. Otherwise large-star and small-star steps alternate (Kiveris and others, "Connected components in MapReduce and beyond", 2014): each
points a node's neighbours at the smallest id around it, and the forests are found again, until every node points at the root
of its component. Links stay distributed, each round is a written table, and only counts and a checksum reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.words import frees
from tillmark.sources.shared import discard, written

#: Nodes of a forest that a task holds before it hands them on.
HELD = 300_000


def forests(edges: DataFrame, held: int = HELD) -> DataFrame:
    """a, b, piece: links that connect what ``edges`` connect, each from a node to the smallest id that its piece of a partition
    connects it to."""
    kind = edges.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parent: dict = {}
        piece = TaskContext.get().partitionId() << 32

        def root(x):
            while (up := parent.get(x, x)) != x:
                parent[x] = x = parent.get(up, up)  # halves the way for the next
            return x

        def out() -> pa.RecordBatch:
            nodes = list(parent)
            return pa.RecordBatch.from_arrays(
                [pa.array(nodes, fields[0]), pa.array([root(x) for x in nodes], fields[0]), pa.array([piece] * len(nodes), pa.int64())], names=["a", "b", "piece"]
            )

        fields = []
        for batch in batches:
            fields = batch.schema.types
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            if len(parent) >= held:
                yield out()
                parent.clear()
                piece += 1
        if parent:
            yield out()

    return edges.select("a", "b").mapInArrow(frees(run), f"a {kind}, b {kind}, piece long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    """Rows, a checksum of the distinct links, and whether several pieces hold them."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.min("piece") != F.max("piece")).head())


def connected(links: DataFrame, roots: bool = True, held: int = HELD) -> DataFrame:
    """id, component (smallest id reachable) for every id of ``links`` (a, b) that is linked with another; without ``roots`` for those
    that are not the smallest themselves. The result is a written table, which ``discard`` removes.

    Ids may be of any type that Spark can order. Links of an id with itself, repeated and reversed links change nothing.
    """
    edges = written(forests(links.filter("a <> b"), held), "links")
    state = _state(edges)
    stars = False
    while state[2]:
        # First what stands in many small pieces is put together without a shuffle, then the stars take turns with the forests.
        last, tasks = edges, 1 if state[0] < held else 2 + 2 * state[0] // held
        steps = edges.select("a", "b")
        edges = written(forests((_small_star(_large_star(steps)) if stars and tasks > 1 else steps).coalesce(tasks), held), "links")
        discard(last)
        before, state = state, _state(edges)
        if stars and state[:2] == before[:2]:
            break
        stars = True
    found = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    if roots:
        found = found.union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
    found._written_at = edges._written_at
    return found
