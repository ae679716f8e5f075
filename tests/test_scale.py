"""Hot groups, plan shapes, and the settings that jobs read from the cluster."""

from __future__ import annotations

import math
import random
import re
import statistics
import time

import pytest
import shop
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillmark.functions.ordering import by
from tillmark.operators import joins, ranking
from tillmark.operators.percentiles import group_percentiles
from tillmark.plans import declared, reports, staging, weekly
from tillmark.sources import shared


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_equals_a_window_with_a_hot_group(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
        F.col("id").cast("string").alias("id"),
        F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 11).alias("v"),
    )
    got = ranking.number_rows(rows, ["g"], [("v", True), ("id", False)], "n", piece_rows=3000)
    order = by([("v", True), ("id", False)])
    want = rows.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert got.exceptAll(want).count() == 0 and got.count() == 20000
    parts = got.filter("g = 'hot'").select("n").agg(F.max("n")).first()[0]
    assert parts == rows.filter("g = 'hot'").count()


def test_what_a_written_table_shuffled_is_removed_at_once(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in files.split("\n") if "/shuffle_" in x}

    switch, before = spark.conf.get(shared.SWEEP), shuffled()
    table = shared.written(spark.range(0, 1000, 1, 4).groupBy((F.col("id") % 7).alias("k")).count(), "swept")
    deadline = time.monotonic() + 10  # files go in the background
    while shuffled() - before and time.monotonic() < deadline:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(shared.SWEEP) == switch
    assert table.count() == 7
    shared.discard(table)


@pytest.mark.parametrize("partitions", ["8", "200"])
def test_a_hot_group_is_numbered_in_balanced_pieces_of_any_session(spark, partitions):
    rows = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 90).otherwise(-1).alias("g"), F.lit(7).alias("v"), "id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = ranking.number_rows(rows, ["g"], [("v", True), ("id", False)], "n", piece_rows=4000)
        stored = {re.sub(r"/part-.*", "", f) for f in got.inputFiles()}
        sizes = [r["count"] for r in spark.read.parquet(*stored).groupBy("_part").count().collect()]
        assert len(sizes) == 10 and max(sizes) < 6000 and sum(sizes) == 40_000
        last = {r.g: (r.m, r.c, r.d) for r in got.groupBy("g").agg(F.max("n").alias("m"), F.count("*").alias("c"), F.countDistinct("n").alias("d")).collect()}
        assert all(m == c == d for m, c, d in last.values()) and last[-1][0] == 26_666
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("accuracy", [40, 10_000])
def test_percentiles_are_exact_with_a_hot_group_and_hot_values(spark, accuracy):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"g{i % 5}", 1.5 if i % 2 else round(rng.random() * 9, 4)) for i in range(6000)]
    rows += [(None, float(i % 4)) for i in range(900)] + [("spread", rng.gauss(0, 1)) for _ in range(3000)]
    rows += [("one", 4.0), ("none", None), ("two", -1.0), ("two", 2.0), *[("same", 7.0)] * 500]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    wanted = {"median": 0.5, "q1": 0.25, "least": 0.0, "most": 1.0, "p99": 0.99}
    found = group_percentiles(df, ["g"], "v", wanted, {"p90": 0.9, "p0": 0.0}, accuracy=accuracy)
    got = {r.g: r for r in found.collect()}
    exact = {r.g: r for r in df.groupBy("g").agg(*(F.percentile("v", p).alias(n) for n, p in wanted.items())).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, values in groups.items():
        values.sort()
        for name in wanted:
            assert got[g][name] == pytest.approx(exact[g][name], rel=1e-12), (g, name)
        assert got[g].p90 == values[max(0, math.ceil(0.9 * len(values)) - 1)] and got[g].p0 == values[0]


def test_percentiles_write_nothing_and_sort_no_table(spark):
    rows = spark.range(60_000).select(F.lit("hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"))
    found = group_percentiles(rows, ["g"], "v", {"median": 0.5}, accuracy=500)
    text = plan(found)
    assert "parquet" not in text and "rangepartitioning" not in text
    assert found.first().median == pytest.approx(rows.agg(F.percentile("v", 0.5)).first()[0])


def test_first_copies_are_limited_before_the_shuffle(spark, tmp_path):
    m = shop.models(spark, tmp_path, shop.duplicate_rows)
    text = plan(staging.first_copies(m.feeds["pos_transactions"]))
    assert re.search(r"WindowGroupLimit[^\n]*Partial", text), text


def test_top_products_keep_the_group_limit(spark, tmp_path):
    m = shop.models(spark, tmp_path)
    assert "WindowGroupLimit" in plan(reports.top_products(m.fct_sales_lines, m.stg_materials))
    best = reports.best_products_per_category(m.fct_sales_lines, m.stg_materials)
    assert "WindowGroupLimit" in plan(best)


def test_share_of_total_matches_a_window(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), (None, 5), (None, 5)], "g string, v int")
    got = sorted((str(r.g), r.v, r.t) for r in ranking.with_share(df, ["g"], "v", "t").collect())
    assert got == [("None", 5, 10), ("None", 5, 10), ("a", 1, 4), ("a", 3, 4)]


def test_outer_indicator(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k int, a string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "k int, b string")
    got = {(r.k, r.a, r.b, r.side) for r in joins.outer_with_side(a, b, ["k"]).collect()}
    assert got == {
        (1, "x", "y", "both"),
        (2, None, "z", "right_only"),
        (None, "n", None, "left_only"),
        (None, None, "m", "right_only"),
    }


def test_only_seed_tables_are_broadcast_by_hint(spark, tmp_path):
    """With automatic broadcasts off, whatever is still broadcast comes from a constant table in the plan."""
    m = shop.models(spark, tmp_path)
    saved = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for df in (m.rpt_monthly_sales, m.rpt_monthly_marketing, m.rpt_ledger_reconciliation, m.dim_products, *declared.named_failures(m).values()):
            text = plan(df.select("*"))
            assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
            for side in re.findall(r"BroadcastExchange[^\n]*\n((?:[^\n]*\n){1,4})", text):
                assert "LocalTableScan" in side, side
    finally:
        for k, v in saved.items():
            spark.conf.set(k, v)


def test_scans_read_only_what_a_report_needs(spark):
    from catalogue.queries import QUERIES

    text = plan(QUERIES["rpt_monthly_delivery"](spark, "/root/testdata/sf0.001"))
    schema = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "l_extendedprice" not in schema and "l_tax" not in schema and "l_partkey" not in schema


def test_a_hot_key_is_split_by_adaptive_execution(spark, tmp_path):
    """A third of all lines on one order: the join splits that partition, and the result is whole."""
    lines = spark.range(60000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.repeat(F.lit("x"), 40).alias("pad"), "id"
    )
    lines = shared.written(lines.repartition(8), "hot")
    headers = shared.written(spark.range(60000).select(F.col("id").alias("k"), F.lit("h").alias("h")), "headers")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    saved = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = lines.join(headers, ["k"], "left").groupBy(F.col("id") % 5).agg(F.count("h").alias("n"))
        assert sum(r.n for r in joined.collect()) == 60000
        assert "skew=true" in plan(joined)
    finally:
        for k, v in saved.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_the_shared_folder_is_the_clusters(spark):
    assert shared.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    stored = shared.written(spark.range(5), "five")
    assert stored.inputFiles()[0].startswith("file:" + shared.shared_folder(spark)) or shared.shared_folder(spark) in stored.inputFiles()[0]


def test_smoothing_fills_missing_days_and_keeps_the_floor(spark):
    import datetime

    day = datetime.date(2026, 3, 1)
    rows = [(day, "email", "AKL", True, "sale", 70.0), (day + datetime.timedelta(days=9), "email", "AKL", True, "sale", 7.0)]
    orders = spark.createDataFrame(rows, "order_date date, marketing_channel string, region_code string, is_paid_attribution boolean, order_type string, revenue_nzd double")
    got = weekly.smoothed_daily_revenue(orders).filter("marketing_channel = 'email' and region_code = 'AKL'").orderBy("date_day")
    values = [round(r.smoothed, 4) for r in got.collect()]
    assert len(values) == 10 and values[0] == 17.5 and values[3] == 10.0 and values[4] == 5.0
    assert weekly.smoothed_daily_revenue(orders).count() == 10 * 25


def test_anti_join_with_repeated_and_null_keys(spark):
    rows = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    others = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, x string")
    assert sorted(str(r.k) for r in joins.without_match(rows, others, ["k"]).collect()) == ["2", "2", "None"]
    assert "HashAggregate" in plan(joins.without_match(rows, others, ["k"]))


def test_the_registered_dated_metric_opens_the_months_it_needs(spark):
    from catalogue.queries import QUERIES

    text = plan(QUERIES["metric_date_range"](spark, "/root/testdata/sf0.001"))
    filters = re.findall(r"PartitionFilters: \[[^\]]*_month[^\]]*>= 1998-10-01[^\]]*<= 1999-03-01[^\]]*\]", text)
    assert len(filters) == 3  # lines, orders and spend


def test_facts_together_equal_full_joins_of_their_aggregates(spark):
    rng = random.Random(5)
    key = lambda: rng.choice(["a", "b", "c", None])
    tables = [[(key(), rng.choice([1, 2, None]), rng.choice([None, 1.5, 2.0])) for _ in range(n)] for n in (60, 9, 3)]
    tables[1].append(("only", 9, None))
    frames = [spark.createDataFrame(t, "g string, h int, v double") for t in tables]
    facts = [(df, {f"sum{i}": (F.sum, F.col("v")), f"n{i}": (F.count, F.lit(1)), f"kinds{i}": (F.countDistinct, F.col("v"))}) for i, df in enumerate(frames)]
    got = joins.facts_together(facts, ["g", "h"])
    want = None
    for i, df in enumerate(frames):
        own = df.groupBy("g", "h").agg(F.sum("v").alias(f"sum{i}"), F.count(F.lit(1)).alias(f"n{i}"), F.countDistinct("v").alias(f"kinds{i}"))
        want = own if want is None else joins.full_on(want, own, ["g", "h"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    alone = joins.facts_together([(df, {f"s{i}": (F.sum, F.col("v"))}) for i, df in enumerate(frames)], []).collect()
    assert [tuple(r) for r in alone] == [tuple(sum(v for _, _, v in t if v is not None) or None for t in tables)]


def test_any_number_of_facts_is_one_shuffle_and_a_hot_key_is_combined_first(spark):
    frames = [spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias(f"v{i}")) for i in range(4)]
    together = joins.facts_together([(df, {f"v{i}": (F.sum, F.col(f"v{i}"))}) for i, df in enumerate(frames)], ["k"])
    text = plan(together)
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "partial_sum" in text
    assert together.first().v3 == 20_000 * 19_999 // 2


def test_table_diff_without_a_join_keeps_hot_and_null_keys(spark):
    from tillmark.plans import compare

    hot = spark.range(30_000).select(F.lit("hot").alias("k"), F.lit(1.0).alias("v"))
    rest = spark.createDataFrame([("a", 1.0), (None, 2.0), ("b", None)], "k string, v double")
    left, right = hot.unionByName(rest), hot.limit(29_999).unionByName(rest.filter("k is null or k = 'b'"))
    diff = compare.diff_rows(left, right, ["k"], ["v"])
    assert "Join" not in plan(diff) and "partial_sum" in plan(diff)
    got = {r.k: (r.v_left, r.v_right, r.side, r.differs) for r in diff.collect()}
    assert got == {
        "hot": (30_000.0, 29_999.0, "both", True),
        "a": (1.0, None, "left_only", False),
        None: (2.0, 2.0, "both", False),
        "b": (None, None, "both", False),
    }
    same = compare.diff_rows(left, left, ["k"], ["v"])
    assert same.filter("differs").count() == 0 and compare.diff_summary(same).first().rows_left == 4
