"""Data-quality checks.

A check is a rule on one relation; its failures are rows, and no rows means it passes. ``failures`` gives the rows of
one check. ``findings`` gives those of all checks: each relation is scanned once (see ``tallies`` for relations that are joined), every row carries the array of what it adds to
its checks (a value to tally, or itself as JSON where it breaks a rule), and one explode feeds one aggregation that tallies
before any shuffle, so a value that fills a third of a column is a single tally per task. Counts, stored failures and the
evidence of an incident are all read from the findings.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.dates import parse_timestamp
from tillmark.functions.money import round_double
from tillmark.operators.aggregates import count_if
from tillmark.operators.joins import beside_scalars, without_match
from tillmark.sources.seeds import local_table

DETECT = "dq_detect"
# What a contract check says of a column.
UNEXPECTED, MISSING = "unexpected column (not in the contract)", "missing column"


@dataclass(frozen=True)
class Check:
    """``value`` is what the rule looks at; what else it needs depends on the kind."""

    name: str
    kind: str  # unique | not_null | accepted_values | relationships | expression
    relation: str
    value: str
    accepted: tuple[str, ...] = ()
    parent: tuple[str, str] | None = None
    where: str | None = None
    severity: str = "error"
    tags: tuple[str, ...] = ()


def unique(relation: str, value: str, name: str | None = None, **more: object) -> Check:
    return Check(name or f"unique:{relation}.{value}", "unique", relation, value, **more)


def not_null(relation: str, value: str) -> Check:
    return Check(f"not_null:{relation}.{value}", "not_null", relation, value)


def accepted_values(relation: str, value: str, *accepted: str) -> Check:
    return Check(f"accepted_values:{relation}.{value}", "accepted_values", relation, value, accepted=accepted)


def relationships(relation: str, value: str, parent: str, field: str, name: str | None = None, **more: object) -> Check:
    return Check(
        name or f"relationships:{relation}.{value}", "relationships", relation, value, parent=(parent, field), **more
    )


def expression(relation: str, rule: str, name: str, where: str | None = None, **more: object) -> Check:
    return Check(name, "expression", relation, rule, where=where, **more)


# failing rows of one check


def repeated(df: DataFrame, value: Column) -> DataFrame:
    """Values that occur more than once; NULL is not a value."""
    return (
        df.select(value.alias("unique_field"))
        .filter(F.col("unique_field").isNotNull())
        .groupBy("unique_field")
        .agg(F.count("*").alias("n_records"))
        .filter(F.col("n_records") > 1)
    )


def outside(df: DataFrame, value: Column, accepted: Sequence[str]) -> DataFrame:
    """Distinct values that are not in the list, with their rows."""
    return (
        df.groupBy(value.alias("value_field"))
        .agg(F.count("*").alias("n_records"))
        .filter(~F.col("value_field").isin(*accepted))
    )


def orphans(child: DataFrame, value: Column, parent: DataFrame, field: str) -> DataFrame:
    """Child keys that no parent has, one row per child row."""
    keys = child.select(value.alias("from_field")).filter(F.col("from_field").isNotNull())
    known = parent.select(F.col(field).alias("from_field"))
    return without_match(keys, known, ["from_field"])


def violations(df: DataFrame, rule: str, where: str | None = None) -> DataFrame:
    """Rows for which the rule is false. A rule that is NULL is not violated."""
    scoped = df.filter(where) if where else df
    return scoped.filter(~F.expr(rule))


def failures(check: Check, relation: Callable[[str], DataFrame]) -> DataFrame:
    df, value = relation(check.relation), F.expr(check.value)
    if check.kind == "unique":
        return repeated(df, value)
    if check.kind == "not_null":
        return df.filter(value.isNull())
    if check.kind == "accepted_values":
        return outside(df, value, check.accepted)
    if check.kind == "relationships":
        parent, field = check.parent
        return orphans(df, value, relation(parent), field)
    return violations(df, check.value, check.where)


# all checks at once

_BY_ROW = ("not_null", "expression")
_FOUND = "_found_row"


def _breaks(check: Check) -> Column:
    """Whether a row breaks a rule on single rows."""
    if check.kind == "not_null":
        return F.expr(check.value).isNull()
    broken = ~F.expr(check.value)
    return (F.expr(check.where) & broken) if check.where else broken


def _adds(check: Check, at: int) -> Column:
    """What a row adds to the findings of the check in that place: (at, value, row), or NULL when it adds nothing."""
    nothing, value = F.lit(None).cast("string"), F.expr(check.value)
    if check.kind in _BY_ROW:
        counts, shown, row = _breaks(check), nothing, F.col(_FOUND)
    elif check.kind == "accepted_values":
        counts, shown, row = ~value.isin(*check.accepted), value.cast("string"), nothing
    else:
        counts, shown, row = value.isNotNull(), value.cast("string"), nothing
    return F.when(counts, F.struct(F.lit(at).alias("at"), shown.alias("value"), row.alias("row")))


def tallies(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """(name, value, row, n) for the rules of one relation in one scan; a row is written as JSON once, and only if it breaks a rule.

    Where joins or aggregates make the relation, whole rows are sought apart if a missing value is all that is wrong with them: Spark looks
    for that below the join or aggregate, and what travels there for the other rules are the few columns that they look at.
    """
    by_row = [c for c in checks if c.kind in _BY_ROW]
    by_value = [c for c in checks if c.kind not in _BY_ROW]
    if by_row and by_value and all(c.kind == "not_null" for c in by_row) and _made_of_several(df):
        missing = reduce(Column.__or__, [_breaks(c) for c in by_row])
        return _tallied(df, by_value).unionByName(_tallied(df.filter(missing), by_row))
    return _tallied(df, checks)


def _made_of_several(df: DataFrame) -> bool:
    """Whether rows travel before the relation is there."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "Join " in plan or "Aggregate " in plan


def _tallied(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    by_row = [_breaks(c) for c in checks if c.kind in _BY_ROW]
    broken = reduce(Column.__or__, [F.coalesce(b, F.lit(False)) for b in by_row], F.lit(False))
    rows = df.withColumn(_FOUND, F.when(broken, F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))))
    added = F.explode(F.array_compact(F.array(*(_adds(c, at) for at, c in enumerate(checks, 1))))).alias("p")
    tallied = rows.select(added).groupBy("p.at", "p.value", "p.row").agg(F.count("*").alias("n"))
    # A check travels as its place; its name would go with every value.
    return tallied.select(F.element_at(F.array(*(F.lit(c.name) for c in checks)), F.col("at")).alias("name"), "value", "row", "n")


def findings(checks: Sequence[Check], relation: Callable[[str], DataFrame]) -> DataFrame:
    """(name, row_json, copies): the failing rows of all checks as ``failures`` gives them, equal ones once with their number."""
    by_relation: dict[str, list[Check]] = {}
    for c in checks:
        by_relation.setdefault(c.relation, []).append(c)
    parts = []
    for name, group in by_relation.items():
        tallied = tallies(relation(name), group)
        linked = [c for c in group if c.kind == "relationships"]
        if linked:
            known = reduce(DataFrame.unionByName, [_parent_keys(c, relation) for c in linked])
            tallied = without_match(tallied, known, ["name", "value"])
        parts.append(tallied)
    of_kind = {kind: F.col("name").isin(*(c.name for c in checks if c.kind == kind)) for kind in ("unique", "accepted_values", "relationships")}
    n = F.col("n").alias("n_records")
    row = (
        F.when(of_kind["unique"], F.to_json(F.struct(F.col("value").alias("unique_field"), n)))
        .when(of_kind["accepted_values"], F.to_json(F.struct(F.col("value").alias("value_field"), n)))
        .when(of_kind["relationships"], F.to_json(F.struct(F.col("value").alias("from_field"))))
        .otherwise(F.col("row"))
    )
    once = of_kind["unique"] | of_kind["accepted_values"]
    found = reduce(DataFrame.unionByName, parts).filter(~of_kind["unique"] | (F.col("n") > 1))
    return found.select("name", row.alias("row_json"), F.when(once, 1).otherwise(F.col("n")).cast("long").alias("copies"))


def as_findings(name: str, rows: DataFrame) -> DataFrame:
    """The rows of a check that compares several relations, as findings."""
    return rows.select(F.lit(name).alias("name"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns))).alias("row_json"), F.lit(1).cast("long").alias("copies"))


def failing_rows(found: DataFrame) -> DataFrame:
    """(name, failing_rows) of the checks that have findings."""
    return found.groupBy("name").agg(F.sum("copies").alias("failing_rows"))


def _parent_keys(check: Check, relation: Callable[[str], DataFrame]) -> DataFrame:
    parent, field = check.parent
    return relation(parent).select(F.lit(check.name).alias("name"), F.col(field).cast("string").alias("value"))


# feeds


def contract_issues(headers: DataFrame, expected: Sequence[str], file: str = "path") -> DataFrame:
    """Per delivered file, columns that are not in the contract and contract columns that are missing."""
    wanted = F.array(*(F.lit(c.lower()) for c in expected))
    present = F.transform("columns", lambda c: F.lower(c))
    issues = F.concat(
        F.transform(
            F.array_except(present, wanted),
            lambda c: F.struct(c.alias("column_name"), F.lit(UNEXPECTED).alias("issue")),
        ),
        F.transform(
            F.array_except(wanted, present),
            lambda c: F.struct(c.alias("column_name"), F.lit(MISSING).alias("issue")),
        ),
    )
    return headers.select(F.col(file).alias("source_file"), F.explode(issues).alias("i")).select("source_file", "i.*")


@dataclass(frozen=True)
class Freshness:
    warn_days: int = 33
    error_days: int = 35


def freshness(
    feeds: Mapping[str, DataFrame], as_of: datetime, limits: Mapping[str, Freshness], usual: Freshness = Freshness()
) -> DataFrame:
    """Age of each feed's newest extract against its limits; a feed is stale only beyond the limit."""
    rows = []
    for feed, df in feeds.items():
        limit = limits.get(feed, usual)
        rows.append(
            df.agg(F.max(parse_timestamp("_extracted_at")).alias("newest")).select(
                F.lit(feed).alias("feed"),
                "newest",
                F.lit(limit.warn_days).alias("warn_days"),
                F.lit(limit.error_days).alias("error_days"),
            )
        )
    age = F.expr(f"timestampdiff(SECOND, newest, timestamp_ntz'{as_of:%Y-%m-%d %H:%M:%S}')") / F.lit(86400.0)
    status = (
        F.when(F.col("age") > F.col("error_days"), "error").when(F.col("age") > F.col("warn_days"), "warn").otherwise("pass")
    )
    return (
        reduce(DataFrame.unionByName, rows)
        .withColumn("age", age)
        .select("feed", F.col("newest").alias("max_extracted_at"), round_double(F.col("age"), 1).alias("age_days"), status.alias("status"))
    )


# results


def results(
    spark: SparkSession, checks: Sequence[Check], counts: DataFrame, fresh: DataFrame
) -> DataFrame:
    """One row per check and per feed freshness: name, kind, severity, status, failing rows and tags."""
    rows_ = [(c.name, c.severity, ",".join(c.tags)) for c in checks]
    known = local_table(spark, ["name", "severity", "tags"], rows_)
    rows = F.coalesce("failing_rows", F.lit(0)).cast("long")
    status = F.when(rows == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    tests = known.join(counts, ["name"], "left").select(
        "name",
        F.lit("test").alias("kind"),
        "severity",
        status.alias("status"),
        rows.alias("failing_rows"),
        "tags",
    )
    ages = fresh.select(
        F.concat(F.lit("freshness:raw."), "feed").alias("name"),
        F.lit("freshness").alias("kind"),
        F.lit("error").alias("severity"),
        "status",
        (F.col("status") != "pass").cast("long").alias("failing_rows"),
        F.concat(F.lit("age "), F.col("age_days").cast("string"), F.lit(" days")).alias("tags"),
    )
    return tests.unionByName(ages)


def fired(results_: DataFrame) -> DataFrame:
    return results_.filter(F.col("status") != "pass")


def expected_vs_fired(incidents: DataFrame, mapping: DataFrame, results_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per incident (id, kind, place): did a check meant for its kind fire, and do its rows point at the place?

    ``mapping`` has (kind, name, needs_evidence); ``evidence`` has (kind, place, rows).
    """
    hits = mapping.join(fired(results_).select("name"), ["name"])
    per_kind = mapping.groupBy("kind").agg(F.max("needs_evidence").alias("needs_evidence"))
    fired_kinds = hits.groupBy("kind").agg(F.count("*").alias("checks_fired"))
    places = evidence.groupBy("kind", "place").agg(F.sum("rows").alias("rows"))
    checks_fired = F.coalesce("checks_fired", F.lit(0)).cast("long")
    rows = F.when(F.col("needs_evidence"), F.coalesce("rows", F.lit(0)).cast("long"))
    return (
        incidents.join(per_kind, ["kind"], "left")
        .join(fired_kinds, ["kind"], "left")
        .join(places, ["kind", "place"], "left")
        .select("id", "kind", "place", checks_fired.alias("checks_fired"), rows.alias("evidence_rows"))
        .withColumn(
            "caught",
            (F.col("checks_fired") > 0) & (F.col("evidence_rows").isNull() | (F.col("evidence_rows") > 0)),
        )
    )


def unexplained(incidents: DataFrame, mapping: DataFrame, results_: DataFrame) -> DataFrame:
    """Checks that fired although no incident of a kind they are meant for is known."""
    known = mapping.join(incidents.select("kind").distinct(), ["kind"], "left_semi").select("name")
    return without_match(fired(results_), known, ["name"])


def alert_summary(results_: DataFrame, quarantined: DataFrame) -> DataFrame:
    """One row: the worst status of the detecting checks, how many fire, and the quarantined lines."""
    detecting = results_.filter(F.col("tags").contains(DETECT) | (F.col("kind") == "freshness"))
    worst = (
        F.when(count_if(F.col("status").isin("error", "fail")) > 0, "error")
        .when(count_if(F.col("status") != "pass") > 0, "warn")
        .otherwise("ok")
    )
    alarms = detecting.agg(worst.alias("severity"), count_if(F.col("status") != "pass").alias("checks_firing"))
    held = quarantined.agg(F.count("*").alias("quarantined_lines"))
    return beside_scalars(alarms, held)
