from __future__ import annotations

import json
import re
from collections import Counter

import pytest
import shop
from pyspark.sql import functions as F

from tillmark.plans import as_delivered, checks, compare, declared
from tillmark.sources import sinks
from tillmark.sources.feeds import file_headers

PLACES = {
    "late_file": "logistics/shipments",
    "duplicate_rows": "S01|2026-03-03",
    "schema_drift": "promo_code",
    "currency_mixup": "S04|2026-03",
    "missing_foreign_key": "MAT-9",
    "negative_quantity": "T-1",
}


def contract(spark, root):
    headers = file_headers(spark, f"{root}/ecommerce/orders_*.csv")
    seen = headers.select("path", F.array_append("columns", F.lit("_source_file")).alias("columns"))
    return checks.contract_issues(seen, declared.WEB_ORDER_CONTRACT)


def run(spark, root, *faults):
    m = shop.models(spark, root, *faults)
    drift = contract(spark, root)
    found = sinks.store_failures(declared.findings(m, drift), f"{root}/audit")
    return m, found, declared.results(m, found)


def test_number_of_declared_checks():
    kinds = [c.kind for c in declared.DECLARED]
    assert {k: kinds.count(k) for k in set(kinds)} == {
        "unique": 28,
        "not_null": 33,
        "accepted_values": 12,
        "relationships": 9,
        "expression": 2,
    }


def test_clean_shop_raises_no_alarm_and_reports_agree(spark, tmp_path):
    m, _, results = run(spark, tmp_path)
    rows = results.collect()
    assert len(rows) == 84 + 5 + 14
    assert [r for r in rows if r.status != "pass"] == []
    assert checks.alert_summary(results, m.quarantined_pos_lines).first().asDict() == {
        "severity": "ok",
        "checks_firing": 0,
        "quarantined_lines": 0,
    }
    made = as_delivered.AsDelivered(m.feeds, m.material_groups, m.dim_regions).reports()
    for report, (keys, values) in compare.REPORTS.items():
        diff = compare.diff_rows(made[report], getattr(m, f"rpt_{report}"), keys, values)
        summary = compare.diff_summary(diff).first()
        assert summary.rows_left > 0 and summary.differing_rows == 0, (report, diff.collect())
        assert (summary.only_left, summary.only_right) == (0, 0), (report, diff.collect())


def test_every_fault_is_caught_with_evidence(spark, tmp_path):
    m, found, results = run(spark, tmp_path, *shop.FAULTS)
    incidents = spark.createDataFrame([(k, k, p) for k, p in PLACES.items()], "id string, kind string, place string")
    mapping = declared.incident_mapping(m)
    verdict = checks.expected_vs_fired(incidents, mapping, results, declared.evidence(found))
    by_kind = {r.kind: r for r in verdict.collect()}
    assert all(by_kind[k].caught for k in PLACES), by_kind
    assert by_kind["late_file"].evidence_rows is None and by_kind["late_file"].checks_fired == 2
    unexplained = {r.name for r in checks.unexplained(incidents, mapping, results).collect()}
    assert unexplained == set()
    alert = checks.alert_summary(results, m.quarantined_pos_lines).first()
    assert alert.severity == "error" and alert.quarantined_lines == 1


@pytest.mark.parametrize(
    ("fault", "name", "rows"),
    [
        (shop.duplicate_rows, "pos_transaction_line_is_unique", 2),
        (shop.negative_quantity, "pos_sale_quantity_is_positive", 1),
        (shop.missing_foreign_key, "erp_sales_order_material_exists", 1),
    ],
)
def test_failing_rows_agree_with_their_count(spark, tmp_path, fault, name, rows):
    m = shop.models(spark, tmp_path, fault)
    check = next(c for c in declared.DECLARED if c.name == name)
    relation = declared.relation_of(m)
    assert checks.failures(check, relation).count() == rows
    counted = {r.name: r.failing_rows for r in checks.failing_rows(checks.findings([check], relation)).collect()}
    assert counted == {name: rows}


def test_all_kinds_against_their_failing_rows(spark):
    rows = [(1, "a", 5), (1, "b", -1), (2, None, None), (3, "z", 0), (None, "z", 1), (3, "y", 2)]
    t = spark.createDataFrame(rows, "id int, code string, n int")
    p = spark.createDataFrame([("a",), ("b",), (None,)], "code string")
    relation = {"t": t, "p": p}.__getitem__
    declared_ = [
        checks.unique("t", "id"),
        checks.not_null("t", "id"),
        checks.accepted_values("t", "code", "a", "b", "y"),
        checks.relationships("t", "code", "p", "code"),
        checks.expression("t", "n > 0", "positive", where="id is not null"),
    ]
    found = checks.findings(declared_, relation)
    counted = {r.name: r.failing_rows for r in checks.failing_rows(found).collect()}
    for c in declared_:
        rows = checks.failures(c, relation)
        want = Counter(r[0] for r in rows.select(F.to_json(F.struct(*(F.col(x).cast("string").alias(x) for x in rows.columns)))).collect())
        text = lambda x: json.dumps({k: str(v) for k, v in json.loads(x).items()}, separators=(",", ":"))
        assert Counter({text(r.row_json): r.copies for r in found.filter(F.col("name") == c.name).collect()}) == want, c.name
    assert counted == {c.name: checks.failures(c, relation).count() for c in declared_}
    assert list(counted.values()) and counted["positive"] == 2 and counted["unique:t.id"] == 2


def test_freshness_is_stale_only_beyond_the_limit(spark):
    from datetime import datetime

    feed = lambda t: spark.createDataFrame([(t,), (None,)], "_extracted_at string")
    feeds = {"on_limit": feed("2026-03-25 06:00:00"), "over": feed("2026-03-25 05:59:59"), "old": feed("2026-03-20 00:00:00")}
    limits = {k: checks.Freshness(7, 8) for k in feeds}
    got = {r.feed: r.status for r in checks.freshness(feeds, datetime(2026, 4, 1, 6), limits).collect()}
    assert got == {"on_limit": "pass", "over": "warn", "old": "error"}


def test_diff_flags_one_changed_value(spark):
    left = spark.createDataFrame([("m1", "a", 1.0), ("m2", None, 1.0), ("m3", "a", None)], "month string, k string, v double")
    right = spark.createDataFrame([("m1", "a", 2.0), ("m2", None, 1.005), ("m4", "a", 1.0)], "month string, k string, v double")
    diff = compare.diff_rows(left, right, ["month", "k"], ["v"])
    assert compare.diff_summary(diff).first().asDict() == {
        "rows_left": 3,
        "rows_right": 3,
        "matched_rows": 1,
        "differing_rows": 1,
        "only_left": 1,
        "only_right": 1,
    }
    example = compare.diff_examples(diff, ["month", "k"]).collect()
    assert [(r.month, r.v_left, r.v_right) for r in example] == [("m1", 1.0, 2.0)]


def test_raw_tills_against_the_ledger(spark, tmp_path):
    m = shop.models(spark, tmp_path, shop.currency_mixup)
    rows = declared.named_failures(m)["recon_pos_raw_vs_finance"].collect()
    assert [(r.store_id, r.pos_nzd, r.ledger_nzd, r.difference_nzd) for r in rows] == [("S04", 54.0, 59.4, -5.4)]


def test_each_relation_is_scanned_once_for_all_its_findings(spark, tmp_path):
    rows = [(i, f"k{i % 7}", None if i % 11 else "x", i % 5 - 1) for i in range(200)]
    spark.createDataFrame(rows, "id int, code string, note string, n int").write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([("k1",), ("k2",)], "code string").write.parquet(str(tmp_path / "p"))
    relation = lambda name: spark.read.parquet(str(tmp_path / name))
    declared_ = [checks.unique("t", c) for c in ("id", "code", "note", "n")] + [checks.not_null("t", c) for c in ("id", "note", "n")]
    declared_ += [checks.accepted_values("t", "code", "k1"), checks.relationships("t", "code", "p", "code"), checks.expression("t", "n > 0", "positive")]
    found = sinks.store_failures(checks.findings(declared_, relation), str(tmp_path / "audit"))
    plan = checks.findings(declared_, relation)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [id") == 1
    counted = {r.name: r.failing_rows for r in checks.failing_rows(found).collect()}
    assert counted == {c.name: n for c in declared_ if (n := checks.failures(c, relation).count())}
    assert sorted(p.name for p in (tmp_path / "audit" / "dq_audit").iterdir() if p.is_dir()) == sorted(f"name={n}".replace(":", "%3A") for n in counted)


def test_only_what_the_rules_look_at_travels_to_a_joined_relation(spark, tmp_path):
    items = [(i, None if i % 9 == 0 else f"i{i % 20}", f"wide {i}") for i in range(60)]
    spark.createDataFrame(items, "k int, id string, wide string").write.parquet(str(tmp_path / "items"))
    spark.createDataFrame([(i, f"c{i % 3}") for i in range(50)] + [(1, None)], "k int, code string").write.parquet(str(tmp_path / "heads"))
    spark.createDataFrame([("c1",)], "code string").write.parquet(str(tmp_path / "p"))
    read = lambda name: spark.read.parquet(str(tmp_path / name))
    relation = lambda name: read("p") if name == "p" else read("items").join(read("heads"), "k", "left")
    declared_ = [checks.unique("t", "id"), checks.not_null("t", "id"), checks.not_null("t", "code"), checks.relationships("t", "code", "p", "code"), checks.accepted_values("t", "code", "c2")]
    found = checks.findings(declared_, relation)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", found._jdf.queryExecution().executedPlan().toString())
    assert any("id#" in s and "wide#" not in s for s in scans)
    for c in declared_:
        rows = checks.failures(c, relation)
        want = Counter(r[0] for r in rows.select(F.to_json(F.struct(*rows.columns))).collect())
        assert Counter({r.row_json: r.copies for r in found.filter(F.col("name") == c.name).collect()}) == want, c.name


def test_a_hot_failing_row_is_one_tally(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("string").alias("k"), F.lit("bad").alias("code"))
    found = checks.findings([checks.not_null("t", "k"), checks.accepted_values("t", "code", "good")], {"t": rows}.__getitem__)
    assert sorted(map(tuple, found.collect())) == [("accepted_values:t.code", '{"value_field":"bad","n_records":30000}', 1), ("not_null:t.k", '{"code":"bad"}', 30000)]
