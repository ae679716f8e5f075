from __future__ import annotations

import datetime

import pytest
import shop

from tillmark.plans import weekly
from tillmark.plans.metrics import MetricLayer


@pytest.fixture(scope="module")
def layer(spark, tmp_path_factory):
    def more(files):
        shipped = files["ecommerce/orders_2026-03.csv"][1]
        later = list(shipped[0])
        later[0], later[1] = "W-10", "2026-03-10 09:00:00"
        shipped.append(later)
        line = list(files["ecommerce/order_lines_2026-03.csv"][1][0])
        line[0], line[6] = "W-10", "45.00"
        files["ecommerce/order_lines_2026-03.csv"][1].append(line)
        files["marketing/other_channels_2026-03.csv"][1].append(["2026-03-24", "display", "AKL", "8.00", "NZD", shop.FRESH])

    m = shop.models(spark, tmp_path_factory.mktemp("shop"), more)
    return MetricLayer(lambda name: getattr(m, name))


def test_pairs(layer):
    rows = weekly.pair_facts(layer).collect()
    facts = {(str(r.week), r.section, r.marketing_channel, r.metric): r for r in rows}
    assert {str(r.week) for r in rows} == {"2026-03-02", "2026-03-09", "2026-03-23"}
    second = facts[("2026-03-09", "totals", None, "attributed_revenue")]
    assert (second.iso_week, second.this_week, second.previous_week, second.change_pct) == ("2026-W11", 45.0, 30.0, 50.0)
    first = facts[("2026-03-02", "online", None, "orders")]
    assert (first.this_week, first.previous_week, first.change_pct) == (2.0, None, None)
    # the week in between is missing, so the last week has no previous week
    last = facts[("2026-03-23", "channel", "display", "ad_spend")]
    assert (last.this_week, last.previous_week) == (8.0, None)
    silent = facts[("2026-03-23", "channel", "email", "roas")]
    assert (silent.this_week, silent.previous_week, silent.change_pct) == (None, None, None)
    assert len(rows) == 3 * (3 + 3 + 5 * 3)


def test_best_and_top(layer):
    best = {str(r.week): r for r in weekly.best_and_weakest_channel(layer).collect()}
    assert best["2026-03-02"].best_channel_by_roas == "email"
    top = {str(r.week): r for r in weekly.top_region(layer).collect()}
    assert top["2026-03-02"].region == "Auckland" and top["2026-03-02"].roas == round(30 / 27.5, 4)
    assert "2026-03-23" not in top


def test_change(spark):
    from pyspark.sql import functions as F

    rows = [(110.0, 100.0), (1.0, 0.0), (None, 5.0), (5.0, None), (0.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double").select(weekly.change_pct(F.col("a"), F.col("b")).alias("c"))
    assert [r.c for r in df.collect()] == [10.0, None, None, None, -100.0]
    assert datetime.date(2026, 3, 2).isocalendar().week == 10
