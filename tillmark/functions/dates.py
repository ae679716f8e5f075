"""Dates, calendars and grains."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The date notations used by the feeds, and the Spark pattern of each.
DATE_PATTERNS = {
    "yyyymmdd": "yyyyMMdd",
    "dd/mm/yyyy": "dd/MM/yyyy",
    "yyyy-mm-dd": "yyyy-MM-dd",
}

GRAINS = ("day", "week", "month", "quarter", "year")

FISCAL_YEAR_FIRST_MONTH = 4


#: The column that stored facts are split by.
MONTH = "_month"


def parse_date(col: str | Column, notation: str) -> Column:
    """A text date in one of the feed notations; text that does not fit raises in ANSI mode."""
    return F.to_date(_col(col), DATE_PATTERNS[notation])


def parse_timestamp(col: str | Column) -> Column:
    """A zone-less timestamp, independent of the session time zone."""
    return _col(col).cast("timestamp_ntz")


def trunc_to(grain: str, col: str | Column) -> Column:
    """First day of the period; weeks start on Monday."""
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {', '.join(GRAINS)}")
    return F.date_trunc(grain, _col(col)).cast("date")


def month_of(col: str | Column) -> Column:
    return trunc_to("month", col)


def month_label(col: str | Column) -> Column:
    return F.date_format(_col(col), "yyyy-MM")


def month_diff(start: Column, end: Column) -> Column:
    """How many month boundaries lie between two dates."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def add_months(col: Column, months: int) -> Column:
    return F.add_months(col, months)


def days_before(as_of: datetime, days: int) -> Column:
    return F.date_sub(F.lit(as_of.date()), days)


def date_series(spark: SparkSession, start: date | Column, end: date | Column, source: DataFrame | None = None) -> DataFrame:
    """One row per day, both ends included.

    Give ``source`` (one row) when the bounds are columns, e.g. the first and last day of a fact.
    """
    frame = source if source is not None else spark.range(1)
    first, last = (b if isinstance(b, Column) else F.lit(b) for b in (start, end))
    return frame.select(F.explode(F.sequence(first, last, F.expr("interval 1 day"))).alias("date_day"))


def fiscal_year(col: str | Column) -> Column:
    """The year in which the financial year (April to March) of a date ends."""
    c = _col(col)
    return F.year(c) + F.when(F.month(c) >= FISCAL_YEAR_FIRST_MONTH, 1).otherwise(0)


def iso_day_of_week(col: str | Column) -> Column:
    """Monday 1 .. Sunday 7."""
    return F.weekday(_col(col)) + 1


def calendar_columns(col: str | Column) -> list[Column]:
    day = _col(col)
    return [
        trunc_to("week", day).alias("week_start"),
        trunc_to("month", day).alias("month_start"),
        trunc_to("quarter", day).alias("quarter_start"),
        fiscal_year(day).alias("fiscal_year"),
        iso_day_of_week(day).alias("iso_day_of_week"),
        (iso_day_of_week(day) >= 6).alias("is_weekend"),
    ]


def iso_week_label(col: str | Column) -> Column:
    """``2026-W13``: the ISO year is the calendar year of that week's Thursday."""
    c = _col(col)
    thursday = F.date_add(trunc_to("week", c), 3)
    return F.concat(F.lpad(F.year(thursday).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(c).cast("string"), 2, "0"))


def iso_week_bounds(label: str | Column) -> tuple[Column, Column]:
    """Monday and Sunday of an ISO week label. 4 January always lies in week 1."""
    c = _col(label)
    year, week = F.split_part(c, F.lit("-W"), F.lit(1)), F.split_part(c, F.lit("-W"), F.lit(2))
    first_monday = trunc_to("week", F.make_date(year.cast("int"), F.lit(1), F.lit(4)))
    monday = F.date_add(first_monday, (week.cast("int") - 1) * 7)
    return monday, F.date_add(monday, 6)


def _col(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col
