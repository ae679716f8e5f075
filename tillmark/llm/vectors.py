"""Near-duplicate vectors by int8 tile products.

Vectors are reduced to directions and stored as eight-bit integers with a scale each. The product of two blocks of such
integers is exact, and with x = s q + e and |e| known for each vector,

    |x.y - (s q).(t r)| <= |s q| |f| + |t r| |e| + |e| |f|

bounds what quantisation hides. A pair whose bound keeps it under the threshold is done, one whose bound keeps it above is
linked, and only the others are computed anew in double precision.

Equal vectors are one class with a number of copies before any product, so large groups of copies cost one row. A tile
reports for each class how many vectors it links and one link of a spanning forest, never its pairs.

Cases: null and zero vectors and those with a null, NaN or infinite component link with nothing, are their own component
and are kept. Vectors of different length do not link. Rows that repeat id and vector are copies of each other and link.
Rows with a null id link like others, but components are named by the smallest id that is not null. An empty table gives
an empty table. Columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.components import connected
from tillmark.llm.tiles import block_counts, blocks, exact_product, finite, norm_bound
from tillmark.sources.shared import discard, written

BLOCK, STRIP = 2048, 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, lengths of the quantised rows, and lengths of what they miss (both rounded up)."""
    scale = np.abs(unit).max(1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    up = 1 + 1e-12
    return q, scale, np.sqrt((back**2).sum(1)) * up, np.sqrt(((unit - back) ** 2).sum(1)) * up + 1e-15


def directions(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def links_of_tile(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs with a cosine of at least ``threshold`` (each once if x is y), and how many were computed anew."""
    ux, uy = directions(x), directions(y)
    (qx, sx, ax, ex), (qy, sy, ay, ey) = quantise(ux), quantise(uy)
    bound = norm_bound(qx, qy)
    hidden = ax * ey.max() + ay.max() * ex + ex * ey.max() + 1e-9
    need = threshold - hidden
    least = need / (sx * np.where(need > 0, sy.max(), sy.min()))  # no smaller product can reach the threshold
    a_out, b_out, anew = [], [], 0
    for at in range(0, len(qx), STRIP):
        strip = slice(at, at + STRIP)
        product = exact_product(qx[strip], qy, bound)
        a, b = np.nonzero(product >= least[strip, None] - 1e-3)
        value = product[a, b].astype(np.float64)
        a = a + at
        if same:
            upper = b > a
            a, b, value = a[upper], b[upper], value[upper]
        value = value * sx[a] * sy[b]
        slack = ax[a] * ey[b] + ay[b] * ex[a] + ex[a] * ey[b] + 1e-9
        sure = value - slack >= threshold
        open_ = np.flatnonzero(~sure & (value + slack >= threshold))
        anew += len(open_)
        for part in range(0, len(open_), 1 << 16):
            some = open_[part : part + (1 << 16)]
            sure[some] = np.einsum("ij,ij->i", ux[a[some]], uy[b[some]]) >= threshold
        a_out.append(a[sure])
        b_out.append(b[sure])
    return np.concatenate(a_out), np.concatenate(b_out), anew


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that links a[i]-b[i] lead to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before, root)
        root = root[root]
        if (root == before).all():
            return root


def tile_links(packed: DataFrame, threshold: float, kind: str) -> DataFrame:
    """cls, links (vectors of other classes that the tile links it with), root (a class it is connected to)."""
    counts = block_counts(packed)
    left = packed.join(counts, "dim").withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)))
    left = left.select("dim", F.col("other").alias("block"), *(F.col(c).alias(f"x_{c}") for c in ("block", "cls", "copies", "data")))
    pairs = left.join(packed, ["dim", "block"]).select("dim", (F.col("block") == F.col("x_block")).alias("same"), "x_cls", "x_copies", "x_data", "cls", "copies", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                vectors = [np.frombuffer(row[c], kind).reshape(-1, row["dim"]) for c in ("x_data", "data")]
                a, b, _ = links_of_tile(*vectors, threshold, row["same"])
                if not len(a):
                    continue
                ids = [np.frombuffer(row[c], "<i8") for c in ("x_cls", "cls")]
                copies = [np.frombuffer(row[c], "<i8") for c in ("x_copies", "copies")]
                if row["same"]:
                    cls, own = ids[0], copies[0]
                else:
                    cls, own, b = np.concatenate(ids), np.concatenate(copies), b + len(ids[0])
                n = len(cls)
                links = np.bincount(a, own[b], n) + np.bincount(b, own[a], n)
                root = forest(a, b, n)
                has = np.flatnonzero(links > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cls[has]), pa.array(np.rint(links[has]).astype(np.int64)), pa.array(cls[root[has]])], names=["cls", "links", "root"]
                )

    return pairs.mapInArrow(run, "cls long, links long, root long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key``, n_links, component_id, kept: one row per row of ``rows``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be over 0 and at most 1")
    own = F.when(finite(F.col(vector)) & F.exists(vector, lambda x: x != 0), F.col(vector))
    keyed = rows.select(F.col(key).alias("vec_id"), own.alias("vector"))
    classes = keyed.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    kind = {"float": "<f4", "double": "<f8"}[rows.schema[vector].dataType.elementType.simpleString()]
    packed = blocks(classes, ["cls", "copies"], "vector", BLOCK, "vector-blocks")
    found = written(tile_links(packed, threshold, kind), "vector-links")
    discard(packed)
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    placed = classes.select("cls", "vector", "least", "copies").join(totals, "cls", "left").join(roots.withColumnRenamed("id", "cls"), "cls", "left")
    placed = placed.withColumn("component", F.coalesce("component", "cls"))
    names = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.join(names, "component").select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = keyed.join(placed, "vector", "left").select(
        F.col("vec_id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return result.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
