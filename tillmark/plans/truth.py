"""Reference answers to business questions, independent of the metric layer.

A metric is defined here once more, by hand, as one or two sums over a fact. Each fact is scanned once and added up by day and
the dimensions it carries, for all metrics at a time; the sums become cells (metric, day, dimensions, top, bottom). Questions are
rows too: a metric, an interval of days, a value or NULL for each dimension. They meet the cells by metric and month, and the
days and values decide within the month, so a question costs a row for each month it covers, not a scan.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.operators.aggregates import label_of_extreme
from tillmark.plans.scoring import Question
from tillmark.sources import seeds
from tillmark.sources.seeds import local_table

EXACT = "decimal(38,10)"
#: Dimensions of questions and the columns of the facts that lead to them.
DIMENSIONS = ("region", "country", "product_category", "sales_channel", "marketing_channel", "carrier")
CODES = ("region_code", "product_category", "sales_channel", "marketing_channel", "carrier")
RATIOS = ("gross_margin", "average_order_value", "roas", "on_time_delivery_rate")

#: metric -> (top, bottom); a sum that another fact brings is None.
Sums = Mapping[str, tuple[Column | None, Column | None]]


def _lines() -> Sums:
    revenue, costed = F.col("revenue_nzd"), F.col("has_cost")
    return {
        "revenue": (revenue, None),
        "units_sold": (F.col("quantity"), None),
        "gross_profit": (F.when(costed, revenue - F.col("cogs_nzd")), None),
        "gross_margin": (F.when(costed, revenue - F.col("cogs_nzd")), F.when(costed, revenue).otherwise(0)),
    }


def _orders() -> Sums:
    sold = F.col("order_type") == "sale"
    takings = F.when(sold, F.col("revenue_nzd")).otherwise(0)
    credited = F.when(sold & F.col("marketing_channel").isin(*seeds.PAID_CHANNELS), F.col("revenue_nzd")).otherwise(0)
    return {
        "orders": (sold.cast("int"), None),
        "average_order_value": (takings, sold.cast("int")),
        "attributed_revenue": (credited, None),
        "roas": (credited, None),
    }


def _spend() -> Sums:
    return {"ad_spend": (F.col("spend_nzd"), None), "roas": (None, F.col("spend_nzd"))}


def _shipments() -> Sums:
    return {"on_time_delivery_rate": (F.coalesce(F.col("delivered_date") <= F.col("promised_date"), F.lit(False)).cast("int"), F.lit(1))}


def _cells(fact: DataFrame, day: str, sums: Sums) -> DataFrame:
    """The sums of one fact by day and dimensions, a row for each metric."""
    keys = [F.col(day).alias("day"), *((F.col(c) if c in fact.columns else F.lit(None).cast("string")).alias(c) for c in CODES)]
    nothing = F.lit(None).cast(EXACT)
    total = lambda x: nothing if x is None else F.sum(x.cast(EXACT)).cast(EXACT)
    parts = [total(x).alias(f"{side}_{metric}") for metric, both in sums.items() for side, x in zip(("top", "bottom"), both, strict=True) if x is not None]
    added = fact.groupBy(*keys).agg(*parts)

    def cell(metric: str, both: tuple[Column | None, Column | None]) -> Column:
        top, bottom = (nothing if x is None else F.col(f"{side}_{metric}") for side, x in zip(("top", "bottom"), both, strict=True))
        return F.struct(F.lit(metric).alias("metric"), top.alias("top"), bottom.alias("bottom"))

    return added.select("day", *CODES, F.explode(F.array(*(cell(m, both) for m, both in sums.items()))).alias("c")).select("day", *CODES, "c.*")


def cells(lines: DataFrame, orders: DataFrame, spend: DataFrame, shipments: DataFrame, regions: DataFrame) -> DataFrame:
    """(metric, day, month, dimensions, top, bottom) of all metrics: a scan of each fact."""
    facts = [_cells(lines, "order_date", _lines()), _cells(orders, "order_date", _orders()), _cells(spend, "spend_date", _spend())]
    together = reduce(DataFrame.unionByName, [*facts, _cells(shipments, "promised_date", _shipments())])
    named = together.join(regions.select("region_code", F.col("region_name").alias("region"), "country"), ["region_code"], "left")
    return named.withColumn("month", F.trunc("day", "month"))


def predicates(spark: SparkSession, questions: Sequence[Question]) -> DataFrame:
    """Questions as rows: (id, metric, start, end, label, highest, a value or NULL for each dimension), for each month they cover."""
    rows = [
        (q.id, q.metric, date.fromisoformat(q.start), date.fromisoformat(q.end), q.label or "", q.argmax is not None, *(q.filters.get(d, "") for d in DIMENSIONS))
        for q in questions
    ]
    wanted = [f"wanted_{d}" for d in DIMENSIONS]
    table = local_table(spark, ["id", "metric", "start", "end", "label_of", "highest", *wanted], rows)
    months = F.sequence(F.trunc("start", "month"), F.trunc("end", "month"), F.expr("interval 1 month"))
    return table.select(
        "id", "metric", "start", "end", "label_of", "highest", *(F.nullif(F.col(w), F.lit("")).alias(w) for w in wanted), F.explode(months).alias("month")
    )


def answers(found: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, kind, metric, number, label): a row for each question for a number, NULL if no fact answers it, and for each question for a
    label that has one."""
    met = found.join(asked, ["metric", "month"]).filter(F.col("day").between(F.col("start"), F.col("end")))
    for d in DIMENSIONS:
        met = met.filter(F.col(f"wanted_{d}").isNull() | (F.col(d) == F.col(f"wanted_{d}")))
    label = reduce(lambda rest, d: F.when(F.col("label_of") == d, F.col(d)).otherwise(rest), DIMENSIONS, F.lit(None).cast("string"))
    summed = met.groupBy("id", "metric", "label_of", "highest", label.alias("label")).agg(F.sum("top").alias("top"), F.sum("bottom").alias("bottom"))
    ratio = F.col("top").cast("double") / F.nullif(F.col("bottom").cast("double"), F.lit(0.0))
    valued = summed.withColumn("number", F.when(F.col("metric").isin(*RATIOS), ratio).otherwise(F.col("top").cast("double")))
    known = valued.filter("label_of = ''").select("id", "number", "label")
    every = asked.filter("label_of = ''").select("id", "metric").distinct()
    numbers = every.join(known, "id", "left").select("id", F.lit("number").alias("kind"), "metric", "number", "label")
    best = [
        label_of_extreme(valued.filter(condition), "label", "number", highest, ["id", "metric"])
        for highest, condition in ((True, "label_of <> '' and highest"), (False, "label_of <> '' and not highest"))
    ]
    labels = reduce(DataFrame.unionByName, best).select("id", F.lit("label").alias("kind"), "metric", "number", "label")
    return numbers.unionByName(labels)


def references(answers_: DataFrame) -> DataFrame:
    """(id, kind, metric, expected) as answers are scored against them."""
    plain = F.col("number").cast("decimal(38,12)").cast("string")
    return answers_.select("id", "kind", "metric", F.when(F.col("kind") == "label", F.col("label")).otherwise(plain).alias("expected"))
