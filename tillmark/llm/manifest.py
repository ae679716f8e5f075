"""Merkle manifest of a table, as a tree of SHA-256 midstates.

Every row is a leaf: the hex digest of its columns, each ``-`` if null, else its UTF-8 byte count, ``:`` and its value. The
rows of one language, ascending by id, are the leaves of one tree: while several nodes remain, every RUN consecutive
ones (the last run may be shorter, even one) become the digest of their hex digests; a lone node is the subroot.
Subroots, ordered by language (null first, bytewise), are the leaves of one more such tree, whose top is the root.

A parent keeps a copy of its hash state before each child slot. To fold a changed leaf, the state of its slot resumes with the
replacement and the siblings to its right only; what stands to the left is hashed once, however many leaves change.
States live within a task: rows are placed by one range sort, SPAN consecutive leaves meet in a group, which raises LEVELS
levels at once, so a tree of n leaves takes log_SPAN(n) passes and a hot language spreads over n / SPAN groups. On the
way down a group gets, for its own top, the siblings of each level above as two strings, rebuilds the states before those
slots once, and hands on the path of its nodes or folds its leaves. Nothing but the number of nodes left reaches the driver.

Cases: null ids come first and are never tampered; rows of one id and language are ordered by leaf, so equal rows are interchangeable
and repeated rows are leaves of their own. Null texts stay null. An empty table gives an empty result. Ids are numbers that
Spark casts to decimal text. Other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.sources.shared import discard, written

RUN, LEVELS = 8, 3
SPAN = RUN**LEVELS

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, place long, n long, node string"
PATH = "tree string, place long, lefts array<string>, rights array<string>, subroot string, root string"
PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def leaf(values: Iterable[Column]) -> Column:
    """The digest of a row's values in their order."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


class Midstates:
    """A subtree over consecutive nodes with the hash state before each child slot of each parent."""

    def __init__(self, nodes: Sequence[bytes], levels: int):
        self.levels, self.states = [list(nodes)], []
        for _ in range(levels):
            below, states, above = self.levels[-1], [], []
            for start in range(0, len(below), RUN):
                state = hashlib.sha256()
                for node in below[start : start + RUN]:
                    states.append(state.copy())
                    state.update(node)
                above.append(state.hexdigest().encode())
            self.states.append(states)
            self.levels.append(above)

    @property
    def top(self) -> bytes:
        return self.levels[-1][0]

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        """Left and right siblings of the nodes from leaf ``at`` to below the top."""
        out = []
        for level in self.levels[:-1]:
            start = at - at % RUN
            out.append((b"".join(level[start:at]), b"".join(level[at + 1 : start + RUN])))
            at //= RUN
        return out

    def fold(self, at: int, node: bytes, siblings: list[tuple[bytes, bytes]]) -> bytes:
        """The top with ``node`` in place of leaf ``at``: each parent's state resumes at the slot."""
        for states, (_, right) in zip(self.states, siblings, strict=True):
            state = states[at].copy()
            state.update(node)
            state.update(right)
            node, at = state.hexdigest().encode(), at // RUN
        return node


def _levels(n: int) -> int:
    """Levels that a group of a tree of n nodes raises."""
    return LEVELS if n > SPAN else height(n)


def _subtree(group: pa.Table) -> tuple[pa.Table, Midstates]:
    group = group.sort_by("place")
    return group, Midstates([x.encode() for x in group["node"].to_pylist()], _levels(group["n"][0].as_py()))


def _raised(nodes: DataFrame) -> DataFrame:
    """The nodes LEVELS levels above, or the top of a tree that is lower."""

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        tops, n = _subtree(group)[1].top.decode(), group["n"][0].as_py()
        return pa.table({"tree": [key[0].as_py()], "place": [key[1].as_py()], "n": [-(-n // SPAN)], "node": [tops]})

    blocks = nodes.select("tree", "place", "n", "node", F.expr(f"place div {SPAN}").alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(run, NODE)


def climb(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, place, n, node) and the written tables of nodes above them, the last with the top of each tree."""
    tables = [nodes, written(_raised(nodes), "nodes")]
    while tables[-1].filter("n > 1").limit(1).count():
        tables.append(written(_raised(tables[-1]), "nodes"))
    return tables


def _descended(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of ``nodes`` from those of the nodes above them."""

    def run(_: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        group, tree = _subtree(group)
        path = above.to_pylist()[0]
        own = [tree.siblings(at) for at in range(group.num_rows)]
        same = {name: [path[name]] * group.num_rows for name in ("subroot", "root")}
        return pa.table(
            {
                "tree": group["tree"],
                "place": group["place"],
                "lefts": [[left.decode() for left, _ in x] + path["lefts"] for x in own],
                "rights": [[right.decode() for _, right in x] + path["rights"] for x in own],
                **same,
            },
            schema=_PATH_TYPE,
        )

    return _beside(nodes, paths).applyInArrow(run, PATH)


def _proved(leaves: DataFrame, paths: DataFrame) -> DataFrame:
    """The proof of every leaf, and the root that its replacement (the leaf itself where null) folds to."""

    def run(_: tuple, group: pa.Table, above: pa.Table) -> pa.Table:
        group, tree = _subtree(group)
        path = above.to_pylist()[0]
        upper = [(left.encode(), right.encode()) for left, right in zip(path["lefts"], path["rights"], strict=True)]
        states = [hashlib.sha256(left) for left, _ in upper]  # before the slots above this group's top
        folded, proofs = [], []
        for at, (node, changed) in enumerate(zip(group["node"].to_pylist(), group["changed"].to_pylist(), strict=True)):
            siblings = tree.siblings(at)
            top = tree.fold(at, (changed or node).encode(), siblings)
            for before, (_, right) in zip(states, upper, strict=True):
                state = before.copy()
                state.update(top)
                state.update(right)
                top = state.hexdigest().encode()
            folded.append(top.decode())
            proofs.append(hashlib.sha256(b"".join(left + right for left, right in siblings + upper)).hexdigest())
        return pa.table(
            {
                "doc_id": group["doc_id"],
                "leaf": group["node"],
                "subroot": [path["subroot"]] * len(folded),
                "root": [path["root"]] * len(folded),
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [x == path["root"] for x in folded],
            }
        )

    return _beside(leaves, paths).applyInArrow(run, PROVED)


def _beside(nodes: DataFrame, paths: DataFrame):
    blocks = nodes.withColumn("block", F.expr(f"place div {SPAN}"))
    return blocks.groupBy("tree", "block").cogroup(paths.withColumn("block", F.col("place")).groupBy("tree", "block"))


_PATH_TYPE = pa.schema(
    [
        ("tree", pa.string()),
        ("place", pa.int64()),
        ("lefts", pa.list_(pa.string())),
        ("rights", pa.list_(pa.string())),
        ("subroot", pa.string()),
        ("root", pa.string()),
    ]
)


def placed(leaves: DataFrame) -> DataFrame:
    """Leaves (tree, doc_id, node, changed) with their place in the tree and its size, by one range sort and the counts of the
    pieces before. A row number of the written leaves keeps equal rows apart, so no run of copies is one piece."""
    numbered = written(leaves.withColumn("at", F.monotonically_increasing_id()), "leaves")
    order = ["tree", F.col("doc_id").asc_nulls_first(), "node", "at"]
    pieces = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(pieces.select("tree", "doc_id", "node", "changed", F.spark_partition_id().alias("piece"), F.monotonically_increasing_id().alias("at")), "pieces")
    discard(numbered)
    counts = pieces.groupBy("tree", "piece").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    trees = Window.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(trees.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "piece", (before - F.col("first")).alias("shift"), F.sum("rows").over(trees).alias("n"))
    return pieces.join(starts, ["tree", "piece"]).select("tree", (F.col("at") + F.col("shift")).alias("place"), "n", "node", "changed", "doc_id")


def tree_of(lang: Column) -> Column:
    """Names trees so that they sort as languages do: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit("1"), lang), F.lit("0"))


def subroots(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame, list[DataFrame]]:
    """Of placed leaves: the tables of nodes from the leaves up, the path from each tree's top to the root, and the written tables
    that are not needed once all is read."""
    tables = climb(leaves)
    tops = tables[-1].select("tree", F.col("node").alias("subroot"))
    # one row a language
    ranked = tops.select(F.lit("").alias("tree"), (F.row_number().over(Window.orderBy("tree")) - 1).cast("long").alias("place"), F.col("tree").alias("lang_tree"), "subroot")
    named = written(ranked, "subroots")
    of_all = Window.partitionBy("tree")
    upper = climb(named.select("tree", "place", F.count("*").over(of_all).alias("n"), F.col("subroot").alias("node")))
    none = F.array().cast("array<string>")
    paths = upper[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    for nodes in reversed(upper[:-1]):
        paths = _descended(nodes, paths)
    found = paths.alias("p").join(named.alias("s"), "place").select(F.col("s.lang_tree").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", "s.subroot", "root")
    return tables, written(found, "paths"), [named, *upper[1:]]


def manifest(docs: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """lang, subroot, root: a row for each language of ``docs``."""
    rows = docs.select(tree_of(F.col("lang")).alias("tree"), "doc_id", leaf(F.col(c) for c in columns).alias("node"), F.lit(None).cast("string").alias("changed"))
    tables, paths, rest = subroots(placed(rows))
    discard(*rest, *tables[1:])
    return paths.select(F.expr("case when tree > '0' then substr(tree, 2) end").alias("lang"), "subroot", "root")


def prove(docs: DataFrame, tampered: Column, text: Column, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """Leaf, subroot, root and digest of the proof of every row; the root that the row folds to with ``text`` in place of its text
    where ``tampered`` holds; and whether that is the root."""
    values = [F.col(c) for c in columns]
    altered = [text if c == "text" else F.col(c) for c in columns]
    rows = docs.select(
        tree_of(F.col("lang")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf(values).alias("node"),
        F.when(tampered, leaf(altered)).alias("changed"),
    )
    leaves = placed(rows)
    tables, paths, rest = subroots(leaves)
    discard(*rest, tables[-1])
    for nodes in reversed(tables[1:-1]):
        last, paths = paths, written(_descended(nodes, paths), "paths")
        discard(nodes, last)
    return _proved(leaves, paths)
