"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source of weight w gets the expected share w / (sum of weights) of ``budget`` characters; without a budget, of all
characters there are. Its target repetition rate is that share divided by its own characters. Each document draws a
number in [0, 1) from the seeded MD5 of its id, and its copies are the Poisson count with the rate as its mean at which
the distribution passes the draw. Copies are dealt out by another seeded hash and sorted by it: a shuffle of the whole.

The draw depends on the id and the seed alone, so a retried task makes the same copies.

Cases: a null text counts as empty. A null source is a source of its own. A source without a weight has weight 0 and its
documents go; weights of sources that hold no documents or no characters go to the others in proportion. A null id draws
as an empty id; repeated rows draw alike. An empty table gives an empty table. All columns of ``docs`` stay, whatever
their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.operators.joins import beside_scalars
from tillmark.sources.shared import written

#: The largest mean that is inverted with one draw.
PIECE = 500


def draw(key: Column, seed: int, salt: Column) -> Column:
    """[0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), salt, F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _quantile(uniform: Column, mean: Column) -> Column:
    """How many partial sums of the Poisson masses of ``mean``, at most PIECE, the draw reaches."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int"))
    first = F.struct(F.exp(-mean).alias("mass"), F.exp(-mean).alias("total"), F.lit(0).alias("count"))

    def step(state: Column, k: Column) -> Column:
        mass = state["mass"] * mean / k
        return F.struct(
            mass.alias("mass"),
            (state["total"] + mass).alias("total"),
            (state["count"] + F.when(state["total"] <= uniform, 1).otherwise(0)).alias("count"),
        )

    return F.aggregate(steps, first, step, lambda state: state["count"])


def poisson_count(key: Column, rate: Column, seed: int) -> Column:
    """The Poisson count of mean ``rate`` that the key's draws stand for. Above PIECE, where exp(-rate) leaves the range
    of doubles, it is the sum of counts of equal smaller means, each with a draw of its own."""
    pieces = F.greatest(F.lit(1), F.ceil(rate / PIECE)).cast("int")
    count = lambda total, piece: total + _quantile(draw(key, seed, F.concat(F.lit("count"), piece.cast("string"))), rate / pieces)
    return F.aggregate(F.sequence(F.lit(1), pieces), F.lit(0), count)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, budget: float | None, source: str = "source", text: str = "text") -> DataFrame:
    """_source, _rate: one row per source. Without weights, all sources weigh the same."""
    sizes = docs.groupBy(F.col(source).alias("_source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("_size"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        if any(w < 0 or not math.isfinite(w) for w in weights.values()):
            raise ValueError("weights must be finite and not negative")
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    sizes = sizes.withColumn("_weight", F.when(F.col("_size") > 0, weight).otherwise(0.0))
    sizes = beside_scalars(sizes, sizes.agg(F.sum("_weight").alias("_weights"), F.sum("_size").alias("_sizes")))
    share = F.col("_weight") / F.col("_weights") * (F.lit(float(budget)) if budget is not None else F.col("_sizes"))
    rate = F.when((F.col("_weights") > 0) & (F.col("_size") > 0), share / F.col("_size")).otherwise(0.0)
    return sizes.select("_source", rate.alias("_rate"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, seed: int = 17, key: str = "doc_id") -> DataFrame:
    """``docs`` with each row as many times as drawn, in the order of a global shuffle, and ``copy`` (from 1) unless
    there is a column of that name."""
    kept = docs.columns
    packed = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_own"), F.col(key).alias("_key"))
    # Written, so that its size is known when the join is planned: few sources are broadcast, many are not.
    rates = written(source_rates(docs, weights, budget), "rates")
    joined = packed.join(rates, F.col("_own").eqNullSafe(F.col("_source")), "inner")
    counted = joined.withColumn("_count", poisson_count(F.col("_key"), F.col("_rate"), seed)).filter("_count > 0")
    copies = counted.select("_row", "_key", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("_copy"))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed}:place"), F.coalesce(F.col("_key").cast("string"), F.lit("")), F.col("_copy").cast("string")).cast("binary"))
    dealt = copies.withColumn("_place", place)
    dealt = dealt.repartitionByRange("_place").sortWithinPartitions("_place")
    own = [F.col("_row")[c].alias(c) for c in kept]
    return dealt.select(*own, *([] if "copy" in kept else [F.col("_copy").alias("copy")]))
