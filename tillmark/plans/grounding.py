"""Grounding: numbers written in a report that no fact of the report explains.

A number is explained when some fact lies within half a unit of its last shown digit (``3.7k`` covers 3650 to 3750);
a percentage may also stand for a fraction. Tokens and facts meet on (report, precision, cell), never as all pairs of a
report: a cell is one unit of the last digit, and what a cell's facts come to is the smallest distance from each number
written there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.functions.text import number_tokens
from tillmark.sources.shared import written

SLACK = 1e-9
#: Decimals of the narrowest cell, which is still wider than the slack. Numbers with more decimals share these cells.
FINEST = 8


def _cells(tokens: DataFrame) -> DataFrame:
    """Adds the token's number at its scale, the exponent of its last digit, its cell and its tolerance."""
    power = F.when(F.col("unit") == "k", 3).when(F.col("unit") == "m", 6).otherwise(0)
    digit = (power - F.col("decimals")).cast("int")
    exponent = F.greatest(digit, F.lit(-FINEST))
    number = F.col("value") * F.pow(F.lit(10.0), power)
    return (
        tokens.withColumn("number", number)
        .withColumn("exponent", exponent)
        .withColumn("cell", F.round(number / F.pow(F.lit(10.0), exponent)))
        .withColumn("tolerance", F.pow(F.lit(10.0), digit) * 0.5 + SLACK)
        .withColumn("percent", F.col("unit") == "%")
    )


def ungrounded(texts: DataFrame, facts: DataFrame, key: str, text: str = "text", value: str = "value") -> DataFrame:
    """One row per ungrounded number: report key, position and the number as written."""
    tokens = written(_cells(number_tokens(texts, key, text)), "number-tokens")  # texts are parsed once, tokens are read three times
    place = [key, "exponent", "percent", "cell"]
    shown = tokens.select(*place, "number").distinct()
    # which precisions a report uses: a handful per report
    used = shown.select(key, "exponent", "percent").distinct()
    size = F.abs(F.col(value).cast("double"))
    known = facts.select(key, size.alias("fact")).filter(F.col("fact").isNotNull()).distinct()
    # a percentage is compared with the fact itself and with the fact as a fraction
    as_shown = F.when(F.col("percent"), F.array(F.col("fact"), F.col("fact") * 100)).otherwise(F.array(F.col("fact")))
    middle = F.round(F.col("candidate") / F.pow(F.lit(10.0), F.col("exponent")))
    near = (
        known.join(used, [key])
        .withColumn("candidate", F.explode(as_shown))
        .withColumn("cell", F.explode(F.array(middle - 1, middle, middle + 1)))
        .join(shown, place)
    )
    nearest = near.groupBy(*place, "number").agg(F.min(F.abs(F.col("candidate") - F.col("number"))).alias("distance"))
    met = tokens.join(nearest, [*place, "number"], "left")
    return met.filter(F.col("distance").isNull() | (F.col("distance") > F.col("tolerance"))).select(key, "position", "token")
