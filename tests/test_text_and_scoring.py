from __future__ import annotations

import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from tillmark.functions.text import normalise_label, number_tokens, parse_number
from tillmark.plans import grounding, scoring

REPORT = "Spend was NZD 3,681 (up 5.2%), or 3.7k; on time 91.2% in 2026-W13 from 2026-03-23."


def texts(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "id int, text string")


def tokens_of(spark, *rows):
    found = number_tokens(texts(spark, *rows), "id").orderBy("id", "position").collect()
    return [(r.token, r.value, r.decimals, r.unit) for r in found]


def test_tokens(spark):
    assert tokens_of(spark, REPORT) == [
        ("3,681", 3681.0, 0, ""),
        ("5.2%", 5.2, 1, "%"),
        ("3.7k", 3.7, 1, "k"),
        ("91.2%", 91.2, 1, "%"),
    ]
    assert tokens_of(spark, "Week 2026-W13 (2026-03-23 to 29 March 2026), W13, in 1999") == []
    assert tokens_of(spark, "x12 a.5 é7 -8 +9.50 1,-2 5%3 4 M 5mm") == [
        ("-8", 8.0, 0, ""),
        ("+9.50", 9.5, 2, ""),
        ("1,", 1.0, 0, ""),
        ("-2", 2.0, 0, ""),
        ("5%", 5.0, 0, "%"),
        ("3", 3.0, 0, ""),
        ("4 M", 4.0, 0, "m"),
        ("5", 5.0, 0, ""),
    ]


def test_parse_number(spark):
    cases = {
        "NZD 139,973.90": 139973.9,
        "47.24%": 0.4724,
        "1.2M": 1.2e6,
        "12k": 12e3,
        "3 thousand": 3e3,
        "2 million NZD": 2e6,
        "-$5": -5.0,
        "5 kg": 5e3,  # any k counts
        "n/a": None,
        "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", parse_number(F.col("s")).alias("v"))
    assert {r.s: r.v for r in df.collect()} == pytest.approx(cases)


def test_normalise_label(spark):
    pairs = [("Paid Search", "paid_search"), ("AKL", "Auckland"), ("New Zealand", "NZ"), ("au", "Australia")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.filter(normalise_label(F.col("a")) == normalise_label(F.col("b"))).count() == len(pairs)


def ungrounded(spark, reports, facts):
    t = spark.createDataFrame(list(reports.items()), "id int, text string")
    f = spark.createDataFrame([(k, float(v)) for k, values in facts.items() for v in values], "id int, value double")
    rows = grounding.ungrounded(t, f, "id").orderBy("id", "position").collect()
    return [(r.id, r.token) for r in rows]


def test_grounding_examples(spark):
    facts = {1: [3681.12, 3500.0, 5.2, 0.912], 2: [3681.12, 5.2, 0.912], 4: [-8.5]}
    reports = {1: REPORT, 2: "Spend was NZD 3,900 and ROAS 4.10.", 3: "Nothing known: 7.", 4: "down 8.5%"}
    assert ungrounded(spark, reports, facts) == [(2, "3,900"), (2, "4.10"), (3, "7")]


def matches(value, decimals, unit, fact):
    scale = {"k": 1e3, "m": 1e6}.get(unit, 1.0)
    tolerance = 0.5 * 10 ** (-decimals) * scale + 1e-9
    candidates = [abs(fact)] + ([abs(fact) * 100] if unit == "%" else [])
    return any(abs(value * scale - c) <= tolerance for c in candidates)


def test_grounding_against_brute_force(spark):
    rng = random.Random(7)
    reports, facts = {}, {}
    for key in range(40):
        facts[key] = [round(rng.choice([1, 100, 1e4, 1e6]) * rng.random() * rng.choice([1, -1]), rng.randint(0, 6)) for _ in range(30)]
        written = []
        for _ in range(40):
            v = abs(rng.choice(facts[key])) * rng.choice([1, 1, 1.001, 1.3])
            unit, scale = rng.choice([("", 1), ("k", 1e3), ("m", 1e6), ("%", 1), ("%", 0.01)])
            written.append(f"{v / scale:.{rng.randint(0, 12)}f}{unit}")
        reports[key] = " ; ".join(written)
    got = ungrounded(spark, reports, facts)
    want = []
    t = spark.createDataFrame(list(reports.items()), "id int, text string")
    for r in number_tokens(t, "id").orderBy("id", "position").collect():
        if not any(matches(r.value, r.decimals, r.unit, f) for f in facts[r.id]):
            want.append((r.id, r.token))
    assert want and got == want


def correct(spark, *rows):
    df = spark.createDataFrame(rows, "kind string, metric string, expected string, got string")
    return [r.correct for r in scoring.with_correct(df, "kind", "metric", "expected", "got").collect()]


def test_scoring_stays_in_generated_code(spark):
    """Parsing and comparing are small enough to be compiled."""
    rows = spark.range(50).select(F.lit("number").alias("kind"), F.lit("revenue").alias("metric"), F.lit("5").alias("expected"), F.concat("id", F.lit("k")).alias("got"))
    scored = scoring.with_correct(rows, "kind", "metric", "expected", "got")
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(scored._jdf.queryExecution().executedPlan())
    sizes = [code.apply(i)._3().maxMethodCodeSize() for i in range(code.size())]
    assert sizes and 0 < max(sizes) < 8000
    assert "regexp_extract" in scored._jdf.queryExecution().executedPlan().toString()


def test_scoring_rules(spark):
    assert correct(
        spark,
        ("number", "gross_margin", "0.4724", "47.24%"),
        ("number", "gross_margin", "0.4724", "47.2"),
        ("number", "gross_margin", "0.4724", "0.49"),
        ("number", "revenue", "139973.9", "NZD 139,973.90"),
        ("number", "revenue", "139973.9", "142080.4"),
        ("number", "revenue", "139973.9", "139.97k"),
        ("number", "revenue", "5", None),
        ("number", "revenue", "5", "n/a"),
        ("label", "revenue", "paid_search", "Paid Search"),
        ("label", "revenue", "AKL", "Sydney"),
    ) == [True, True, False, True, False, True, False, False, True, False]


ROW = (
    "system string, split string, skipped string, correct boolean, latency_s double, prompt_tokens long,"
    " completion_tokens long, llm_calls long, cached_calls long, cost_usd double, error string"
)


def test_summary_and_misses(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        system, split = rng.choice(["baseline", "semantic_agent"]), rng.choice(["dev", "holdout"])
        latency = round(rng.choice([1.5, rng.random() * 10]), 3)
        rows.append((system, split, "no model" if i % 50 == 0 else None, rng.random() < 0.6, latency, i, i % 7, 2, 1, i / 1e6, "x" if i % 9 == 0 else ""))
    df = spark.createDataFrame(rows, ROW)
    got = {(r.system, r.split): r for r in scoring.summary(df).collect()}
    assert len(got) == 6
    for (system, split), r in got.items():
        mine = [x for x in rows if x[0] == system and split in (x[1], "all") and x[2] is None]
        lat = sorted(x[4] for x in mine)
        assert r.questions == len(mine) and r.correct == sum(x[3] for x in mine)
        assert r.latency_median_s == pytest.approx(round(statistics.median(lat), 2), abs=0.0101)
        assert r.latency_p90_s == pytest.approx(round(lat[max(0, math.ceil(0.9 * len(lat)) - 1)], 2), abs=1e-9)
        assert r.tokens_per_question == round(statistics.mean(x[5] + x[6] for x in mine))
        assert r.errors == sum(bool(x[10]) for x in mine)
    assert scoring.misses(df).count() == sum(1 for x in rows if x[2] is None and not x[3])
    single = scoring.summary(df.filter("split = 'dev'"))
    assert {r.split for r in single.collect()} == {"dev"}


def test_cost(spark):
    assert spark.range(1).select(scoring.cost_usd(F.lit(3000), F.lit(200)).alias("c")).first().c == 0.00038


def test_date_pattern_is_the_same_everywhere():
    from tillmark.functions.text import DATE_LIKE

    assert re.compile(DATE_LIKE.replace("(?iU)", "(?i)")).sub("", "1 May 2020|2020") == "|"
