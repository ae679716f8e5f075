"""Scoring answers to business questions, and answering them from the marts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.money import round_double
from tillmark.functions.text import normalise_label, parse_number
from tillmark.operators.aggregates import count_if, label_of_extreme
from tillmark.operators.joins import beside_scalars
from tillmark.operators.percentiles import group_percentiles
from tillmark.plans.metrics import Filter, MetricLayer

# Relative tolerance, absolute tolerance of fractions, metrics that are fractions, list prices in USD
# per million tokens, and the splits of the question set.
RELATIVE, FRACTION = 0.001, 0.001
FRACTIONS = ("gross_margin", "on_time_delivery_rate")
PRICE_PROMPT, PRICE_COMPLETION = 0.10, 0.40
SPLITS = ("dev", "holdout")


@dataclass(frozen=True)
class Question:
    """A metric in a period under filters; with ``argmax`` or ``argmin`` the answer is a dimension value."""

    id: str
    split: str
    metric: str
    start: str
    end: str
    filters: Mapping[str, str] = field(default_factory=dict)
    argmax: str | None = None
    argmin: str | None = None

    @property
    def label(self) -> str | None:
        return self.argmax or self.argmin


def with_correct(rows: DataFrame, kind: str, metric: str, expected: str, got: str) -> DataFrame:
    """Adds ``correct``: labels agree after normalising; numbers within 0.1 %, fractions also within 0.1 points or as a percentage.

    Texts are parsed once, in a projection of their own, and compared in the next.
    """
    columns = rows.columns
    parsed = rows.select(
        *columns,
        parse_number(F.col(got)).alias("_number"),
        F.col(expected).try_cast("double").alias("_target"),
        (normalise_label(F.col(got)) == normalise_label(F.col(expected))).alias("_same_label"),
    )
    number, target, fraction = F.col("_number"), F.col("_target"), F.col(metric).isin(*FRACTIONS)
    as_percentage = fraction & (F.abs(number) > 1.5) & (F.abs(target) <= 1.5)
    gaps = parsed.withColumn("_gap", F.abs(F.when(as_percentage, number / 100).otherwise(number) - target))
    gap = F.col("_gap")
    near = (gap <= F.lit(RELATIVE) * F.greatest(F.abs(target), F.lit(1e-9))) | (fraction & (gap <= FRACTION))
    right = F.when(F.col(kind) == "label", F.col("_same_label")).otherwise(near)
    return gaps.select(*columns, F.coalesce(right, F.lit(False)).alias("correct"))


def score(answers: DataFrame, references: DataFrame) -> DataFrame:
    """Answers (id, answer) against references (id, kind, metric, expected)."""
    return with_correct(references.join(answers, ["id"], "left"), "kind", "metric", "expected", "answer")


def misses(rows: DataFrame) -> DataFrame:
    """Questions that were answered, and wrongly."""
    return rows.filter(F.col("skipped").isNull() & ~F.col("correct"))


def cost_usd(prompt_tokens: Column, completion_tokens: Column) -> Column:
    return F.round(prompt_tokens / 1e6 * PRICE_PROMPT + completion_tokens / 1e6 * PRICE_COMPLETION, 6)


def summary(rows: DataFrame) -> DataFrame:
    """Per system and split, and over all splits when there is more than one."""
    splits = rows.agg(F.countDistinct("split").alias("splits"))
    counted = beside_scalars(rows.filter(F.col("skipped").isNull()), splits)
    own = F.when(F.col("split").isin(*SPLITS), F.col("split"))
    groups = F.array_compact(F.array(own, F.when(F.col("splits") > 1, F.lit("all"))))
    grouped = counted.withColumn("part", F.explode(groups)).drop("split").withColumnRenamed("part", "split")
    keys = ["system", "split"]
    questions = F.count("*")
    right = count_if(F.col("correct"))
    tokens = F.avg(F.col("prompt_tokens") + F.col("completion_tokens"))
    totals = grouped.groupBy(*keys).agg(
        questions.alias("questions"),
        right.alias("correct"),
        round_double(right / questions, 3).alias("accuracy"),
        round_double(F.avg("latency_s"), 2).alias("latency_mean_s"),
        F.bround(tokens, 0).cast("long").alias("tokens_per_question"),
        F.sum("llm_calls").alias("llm_calls"),
        F.sum("cached_calls").alias("cached_calls"),
        F.round(F.sum(F.col("cost_usd").cast("decimal(18,6)")), 4).cast("double").alias("cost_usd"),
        count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("errors"),
    )
    spread = group_percentiles(grouped, keys, "latency_s", {"median": 0.5}, {"p90": 0.9})
    spread = spread.select(
        *keys, round_double(F.col("median"), 2).alias("latency_median_s"), round_double(F.col("p90"), 2).alias("latency_p90_s")
    )
    return totals.join(spread, keys, "left")


# answering questions


def answer_all(layer: MetricLayer, questions: Sequence[Question]) -> DataFrame:
    """(id, number, label) of every question.

    Questions that need the same grouping share one pass over each fact: a question becomes conditional aggregates, so
    forty questions do not mean forty scans.
    """
    by_label: dict[str | None, list[Question]] = {}
    for q in questions:
        by_label.setdefault(q.label, []).append(q)
    return reduce(DataFrame.unionByName, [_answer_group(layer, label, group) for label, group in by_label.items()])


def _answer_group(layer: MetricLayer, label: str | None, questions: Sequence[Question]) -> DataFrame:
    wide = layer.conditional(
        {
            q.id: (q.metric, q.start, q.end, [Filter(d, "=", v) for d, v in q.filters.items()])
            for q in questions
        },
        label,
    )
    values = F.explode(F.array(*(F.struct(F.lit(q.id).alias("id"), F.col(f"`answer_{q.id}`").alias("value")) for q in questions)))
    if label is None:
        return wide.select(values.alias("a")).select(
            "a.id", F.col("a.value").alias("number"), F.lit(None).cast("string").alias("label")
        )
    rows = wide.select(F.col(label).alias("label"), values.alias("a")).select("a.id", "label", F.col("a.value").alias("number"))
    highest = [q.id for q in questions if q.argmax]
    found = []
    for ids, is_highest in ((highest, True), ([q.id for q in questions if not q.argmax], False)):
        if ids:
            picked = rows.filter(F.col("id").isin(*ids))
            found.append(label_of_extreme(picked, "label", "number", is_highest, ["id"]))
    return reduce(DataFrame.unionByName, found).select("id", "number", "label")


def as_text(answers: DataFrame) -> DataFrame:
    """Answers as written text; a decimal is never written with an exponent."""
    plain = F.col("number").cast("decimal(38,12)").cast("string")
    return answers.select("id", F.coalesce("label", plain).alias("answer"))
