from __future__ import annotations

from dataclasses import replace

import pytest
import shop
from pyspark.sql import functions as F

from tillmark.plans import scoring, truth
from tillmark.plans.metrics import ALIASES, HEADLINE, METRICS, Filter, MetricError, MetricLayer
from tillmark.plans.scoring import Question, answer_all


@pytest.fixture(scope="module")
def shop_models(spark, tmp_path_factory):
    return shop.models(spark, tmp_path_factory.mktemp("shop"))


@pytest.fixture(scope="module")
def layer(shop_models):
    return MetricLayer(lambda name: getattr(shop_models, name))


def one(df):
    (row,) = df.collect()
    return row


def test_fourteen_metrics_by_hand(layer):
    assert len(METRICS) == 14
    facts = one(layer.query([m.name for m in METRICS]))
    revenue = 60 + 12 - 30 + 59.4 + 30 + 27 * 1.1 + 240 + 110
    cogs = 20 + 4.5 - 10 + 20 + 10 + 10 + 120 + 45
    sales = revenue + 30
    spend = 12.5 + 11 + 15
    want = {
        "revenue": revenue,
        "gross_profit": revenue - cogs,
        "costed_revenue": revenue,
        "gross_margin": (revenue - cogs) / revenue,
        "units_sold": 2 + 1 - 1 + 2 + 1 + 1 + 12 + 10,
        "orders": 6,
        "order_revenue": sales,
        "average_order_value": sales / 6,
        "ad_spend": spend,
        "attributed_revenue": 30,
        "roas": 30 / spend,
        "shipments_due": 3,
        "on_time_shipments": 2,
        "on_time_delivery_rate": 2 / 3,
    }
    assert facts.asDict() == pytest.approx(want, rel=1e-9)


def test_dimensions_of_each_metric(layer):
    def named(metric):
        return {d.replace("region__region_name", "region") for d in layer.dimensions_of(layer.metric(metric))}

    assert named("roas") == {"region", "region__country", "marketing_channel__channel_name"}
    assert "shipment__carrier" in named("on_time_delivery_rate")
    assert "product__product_category" in named("revenue")
    assert set(HEADLINE) <= {m.name for m in METRICS}


@pytest.mark.parametrize("dimension", ["region", "country", "sales_channel", "product_category"])
def test_parts_add_up_to_the_whole(layer, dimension):
    parts = layer.frame(["revenue"], [dimension]).agg(F.sum("revenue").alias("r")).first().r
    assert parts == pytest.approx(one(layer.frame(["revenue"])).revenue)


def test_two_facts_do_not_multiply(layer):
    rows = {r.region: r for r in layer.query(["attributed_revenue", "ad_spend", "roas"], ["region"]).collect()}
    assert rows["Auckland"].ad_spend == 27.5 and rows["Auckland"].roas == pytest.approx(30 / 27.5)
    assert rows["Wellington"].ad_spend is None and rows["Wellington"].roas is None


def test_grains_and_range(layer):
    weeks = [str(r.date) for r in layer.query(["revenue"], ["date"], "week").collect()]
    assert weeks == ["2026-03-02"]
    days = layer.query(["orders"], ["date"], "day", start="2026-03-04", end="2026-03-05").collect()
    assert [(str(r.date), r.orders) for r in days] == [("2026-03-04", 1.0), ("2026-03-05", 2.0)]
    assert str(layer.query(["revenue"], ["metric_time"], "quarter").first().date) == "2026-01-01"


def test_filters_are_data(layer):
    hostile = "Auckland' or 1=1 --"
    assert one(layer.query(["revenue"], filters=[Filter("region", "=", hostile)])).revenue is None
    both = layer.query(
        ["orders"],
        ["sales_channel"],
        filters=[Filter("sales_channel", "in", ["store", "online"])],
        order_by=[("orders", True), ("sales_channel", False)],
    )
    assert [r.sales_channel for r in both.collect()] == ["online", "store"]
    kept = layer.query(["revenue"], ["country"], filters=[Filter("country", "not in", ["NZ"])]).collect()
    assert [r.country for r in kept] == ["AU"]
    assert layer.query(["shipments_due"], filters=[Filter("carrier", "!=", "Haul")]).first().shipments_due == 2


def test_null_groups_of_two_facts_stay_apart_and_sort_last(spark, tmp_path):
    def lost(files):
        files["marketing/social_ads_2026-03.csv"][1][0][2] = "Hobart"
        files["ecommerce/orders_2026-03.csv"][1][0][4] = "XXX"

    m = shop.models(spark, tmp_path, lost)
    rows = MetricLayer(lambda name: getattr(m, name)).query(["attributed_revenue", "ad_spend"], ["region"]).collect()
    assert [r.region for r in rows][-2:] == [None, None]
    assert {(r.attributed_revenue, r.ad_spend) for r in rows if r.region is None} == {(30.0, None), (None, 11.0)}


def test_limit_is_what_the_caller_gives(layer):
    assert layer.query(["revenue"], ["region"]).count() == layer.frame(["revenue"], ["region"]).count() == 4
    assert layer.query(["revenue"], ["region"], limit=3).count() == 3
    assert layer.query(["revenue"], ["region"], limit=1000).count() == 4
    for wrong in (0, -1, 2.5, "3", True):
        with pytest.raises(MetricError, match="limit"):
            layer.query(["revenue"], ["region"], limit=wrong)


@pytest.mark.parametrize(
    ("request_", "message"),
    [
        ({"metrics": []}, "at least one"),
        ({"metrics": ["profit_ish"]}, "Unknown metric 'profit_ish'. Available: revenue"),
        ({"metrics": ["roas"], "group_by": ["product_category"]}, "not available for metric 'roas'. Valid: date, region"),
        ({"metrics": ["revenue"], "grain": "decade"}, "grain must be one of day"),
        ({"metrics": ["revenue"], "start": "1/2/2026"}, "YYYY-MM-DD"),
        ({"metrics": ["revenue"], "filters": [Filter("region", "like", "x")]}, "Filter op must be"),
        ({"metrics": ["revenue"], "filters": [Filter("date", "=", "x")]}, "start and end"),
        ({"metrics": ["revenue"], "filters": [Filter("region", "in", [])]}, "at least one value"),
        ({"metrics": ["revenue"], "filters": [Filter("region", "=", ["a"])]}, "single value"),
        ({"metrics": ["revenue"], "order_by": [("margin", False)]}, "must be one of revenue"),
    ],
)
def test_errors_name_the_choices(layer, request_, message):
    with pytest.raises(MetricError, match=message):
        layer.query(**request_)


def test_dimension_is_joined_only_when_used(layer):
    plan = layer.frame(["revenue"], ["product_category"])._jdf.queryExecution().optimizedPlan().toString()
    assert "region_name" not in plan and "is_inferred" not in plan


QUESTIONS = [
    Question("total", "dev", "revenue", "2026-03-01", "2026-03-31"),
    Question("online", "dev", "revenue", "2026-03-01", "2026-03-31", {"sales_channel": "online"}),
    Question("margin", "dev", "gross_margin", "2026-03-01", "2026-03-31", {"product_category": "Bakeware"}),
    Question("empty", "dev", "orders", "2026-01-01", "2026-01-31"),
    Question("roas", "holdout", "roas", "2026-03-01", "2026-03-31", {"country": "NZ"}),
    Question("best", "dev", "revenue", "2026-03-01", "2026-03-31", argmax="region"),
    Question("worst", "dev", "revenue", "2026-03-01", "2026-03-31", argmin="product_category"),
    Question("carrier", "dev", "on_time_delivery_rate", "2026-03-01", "2026-03-31", argmax="carrier"),
]


def true_answers(m, questions=QUESTIONS):
    found = truth.cells(m.fct_sales_lines, m.attributed_orders, m.fct_ad_spend, m.fct_shipments, m.dim_regions)
    return truth.answers(found, truth.predicates(m.spark, questions))


def test_questions_in_one_pass_equal_answers_without_the_layer(layer, shop_models):
    shared = {r.id: (r.number, r.label) for r in answer_all(layer, QUESTIONS).collect()}
    alone = {r.id: (r.number, r.label) for r in true_answers(shop_models).collect()}
    assert shared["best"][1] == "Wellington" and shared["worst"][1] == "Bakeware" and shared["carrier"][1] == "Haul"
    assert alone["empty"] == (None, None) == shared["empty"]
    for q in QUESTIONS:
        assert alone[q.id][1] == shared[q.id][1]
        assert alone[q.id][0] is shared[q.id][0] is None or alone[q.id][0] == pytest.approx(shared[q.id][0], rel=1e-12)


def test_every_metric_by_every_dimension_equals_answers_without_the_layer(layer, shop_models):
    """Days cut within a month, both ends of the interval included, and filters of every dimension."""
    values = {"region": ["Auckland", "Sydney"], "country": ["AU"], "sales_channel": ["store", "wholesale"], "product_category": ["Cookware"], "carrier": ["Haul"], "marketing_channel": ["email", "paid_search"]}
    asked = []
    for metric in ("revenue", "units_sold", "gross_profit", "gross_margin", "orders", "average_order_value", "attributed_revenue", "roas", "ad_spend", "on_time_delivery_rate"):
        dims = [d for d in values if ALIASES[d] in layer.dimensions_of(layer.metric(metric))]
        for start, end in (("2026-02-15", "2026-04-02"), ("2026-03-04", "2026-03-04"), ("2026-03-03", "2026-03-09")):
            asked.append(Question(f"{metric}{len(asked)}", "dev", metric, start, end))
            asked += [Question(f"{metric}{d}{v}{start}{end}", "dev", metric, start, end, {d: v}) for d in dims for v in values[d]]
    got = {r.id: r.number for r in true_answers(shop_models, asked).collect()}
    want = {r.id: r.number for r in answer_all(layer, asked).collect()}
    assert set(got) == set(want) == {q.id for q in asked} and sum(v is not None for v in got.values()) > 40
    for q in asked:
        assert got[q.id] == (None if want[q.id] is None else pytest.approx(want[q.id], rel=1e-12)), q


@pytest.mark.parametrize(
    ("metric", "wrong"),
    [("revenue", {"measure": "gross_profit"}), ("gross_margin", {"ratio": ("gross_profit", "revenue_all")}), ("roas", {"ratio": ("revenue", "ad_spend")})],
)
def test_a_wrong_definition_is_scored_as_incorrect(shop_models, metric, wrong):
    changed = [replace(m, **wrong) if m.name == metric else m for m in METRICS] + [replace(METRICS[0], name="revenue_all", measure="units")]
    bad = MetricLayer(lambda name: getattr(shop_models, name), metrics=changed)
    scored = scoring.score(scoring.as_text(answer_all(bad, QUESTIONS)), truth.references(true_answers(shop_models)))
    verdict = {r.id: r.correct for r in scored.collect()}
    hit = {q.id for q in QUESTIONS if q.metric == metric and q.label is None}
    assert hit and not any(verdict[i] for i in hit)
    assert all(verdict[q.id] for q in QUESTIONS if q.metric != metric and q.id != "empty")


def test_questions_cost_a_scan_of_each_fact_however_many_they_are(spark, shop_models, tmp_path):
    stored = {}
    for name in ("fct_sales_lines", "attributed_orders", "fct_ad_spend", "fct_shipments"):
        getattr(shop_models, name).write.parquet(str(tmp_path / name))
        stored[name] = spark.read.parquet(str(tmp_path / name))
    many = [replace(q, id=f"{q.id}{i}") for q in QUESTIONS for i in range(12)]
    answers = truth.answers(truth.cells(*stored.values(), shop_models.dim_regions), truth.predicates(spark, many))
    plan = answers.filter("kind = 'number'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 4 and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
