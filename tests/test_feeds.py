from __future__ import annotations

from datetime import datetime

import pytest
import shop
from pyspark.sql import functions as F

from tillmark.plans import checks, declared
from tillmark.sources import feeds, sinks
from tillmark.plans.metrics import MetricLayer
from tillmark.sources.feeds import FEEDS, file_headers, ingest_log, load_feed, load_summary


def test_files_are_matched_by_column_name(spark, tmp_path):
    folder = tmp_path / "ecommerce"
    folder.mkdir()
    (folder / "orders_2025-12.csv").write_text("order_id,currency,_extracted_at\nW-1,NZD,2026-01-01 02:00:00\n")
    (folder / "orders_2026-01.csv").write_text(
        "order_id,promo_code,currency,_extracted_at\nW-2,SUMMER15,AUD,2026-02-01 02:00:00\n"
    )
    df = load_feed(spark, str(tmp_path), FEEDS["ecom_orders"])
    rows = {(r.order_id, r.currency, r.promo_code, r._source_file) for r in df.collect()}
    assert rows == {
        ("W-1", "NZD", None, "ecommerce/orders_2025-12.csv"),
        ("W-2", "AUD", "SUMMER15", "ecommerce/orders_2026-01.csv"),
    }
    assert all(t == "string" for _, t in df.dtypes)
    log = ingest_log({"ecom_orders": df}, datetime(2026, 2, 2))
    assert {(r.source_file, r.rows, r.extracted_at) for r in log.collect()} == {
        ("ecommerce/orders_2025-12.csv", 1, datetime(2026, 1, 1, 2)),
        ("ecommerce/orders_2026-01.csv", 1, datetime(2026, 2, 1, 2)),
    }
    assert load_summary(log).first().asDict() == {"feed": "ecom_orders", "files": 2, "rows": 2}


def test_text_stays_as_delivered(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x+y 100%.csv").write_text('id,note,empty\n007,"a, ""quoted"" word",\n', encoding="utf-8")
    row = load_feed(spark, str(tmp_path), "a b/*.csv").first()
    assert (row.id, row.note, row.empty) == ("007", 'a, "quoted" word', None)
    assert row._source_file == "a b/x+y 100%.csv"


def test_quoted_line_breaks_need_multi_line(spark, tmp_path):
    (tmp_path / "f.csv").write_text('id,note\n1,"two\nlines"\n2,one\n')
    rows = load_feed(spark, str(tmp_path), "f.csv", multi_line=True).orderBy("id").collect()
    assert [(r.id, r.note) for r in rows] == [("1", "two\nlines"), ("2", "one")]


def test_three_headers_over_many_files_are_one_scan(spark, tmp_path):
    folder = tmp_path / "ecommerce"
    folder.mkdir()
    for i in range(3000):
        body = [f"id,note,_extracted_at\n{i},n{i},2026-01-01 00:00:00\n", f"_extracted_at,id,extra,note\n2026-01-01 00:00:00,{i},,n{i}\n", f"NOTE,id\n\"n{i}\",{i}\n"]
        (folder / f"orders_{i}.csv").write_text(body[0 if i % 10 else 1 if i % 20 else 2])
    df = load_feed(spark, str(tmp_path), FEEDS["ecom_orders"])
    assert df.columns == ["id", "note", "_extracted_at", "extra", "_source_file"]
    got = df.groupBy(F.col("note") == F.concat(F.lit("n"), "id"), F.col("_extracted_at").isNull(), "extra").count().collect()
    assert sorted(map(tuple, got), key=str) == [(True, False, None, 2850), (True, True, None, 150)]
    assert df.filter(F.col("_source_file") != F.concat(F.lit("ecommerce/orders_"), "id", F.lit(".csv"))).count() == 0
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "orders_17.csv" not in plan
    headers = feeds.feed_files(spark, f"{folder}/orders_*.csv").headers
    assert list(headers.values()) == [("id", "note", "_extracted_at"), ("NOTE", "id"), ("_extracted_at", "id", "extra", "note")]


def test_a_row_that_does_not_fit_its_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,note,more\n1,x,y\n")
    (tmp_path / "b.csv").write_text('id,note\n2,"x,y"\n')
    good = load_feed(spark, str(tmp_path), "*.csv")
    assert sorted(map(tuple, good.select("id", "note", "more").collect())) == [("1", "x", "y"), ("2", "x,y", None)]
    for name, row in (("long.csv", "3,x,y"), ("short.csv", "3"), ("longer.csv", "3,x,y,z")):
        (tmp_path / name).write_text(f"id,note\n{row}\n")
        with pytest.raises(Exception, match="does not fit the header"):
            load_feed(spark, str(tmp_path), "*.csv").collect()
        (tmp_path / name).write_text("id,note\n")


def test_line_breaks_in_quotes_by_feed(spark, tmp_path):
    (tmp_path / "notes_1.csv").write_text('id,note\n1,"two\nlines"\n')
    (tmp_path / "notes_2.csv").write_text('note,id,extra\n"say ""hi""\nnow",2,e\n')
    (tmp_path / "plain.csv").write_text("id\n1\n")
    found = feeds.load_feeds(spark, str(tmp_path), {"notes": "notes_*.csv", "plain": "plain.csv"}, multi_line={"notes"})
    rows = sorted(tuple(r) for r in found["notes"].select("id", "note", "_source_file").collect())
    assert rows == [("1", "two\nlines", "notes_1.csv"), ("2", 'say "hi"\nnow', "notes_2.csv")]
    assert found["plain"].count() == 1


def test_a_repeated_load_reads_new_and_changed_files_only(spark, tmp_path):
    one = {"f": "f_*.csv"}
    (tmp_path / "f_1.csv").write_text("id\n1\n")
    (tmp_path / "f_2.csv").write_text("id\n2\n")
    first = feeds.load_manifest(spark, str(tmp_path), one)
    loaded = spark.createDataFrame(first.collect(), first.schema)
    assert feeds.changed_files(feeds.load_manifest(spark, str(tmp_path), one), loaded).count() == 0
    assert feeds.load_feeds(spark, str(tmp_path), one, loaded=loaded)["f"].count() == 0
    (tmp_path / "f_2.csv").write_text("id\n2\n22\n")
    (tmp_path / "f_3.csv").write_text("more,id\nm,3\n")
    changed = feeds.changed_files(feeds.load_manifest(spark, str(tmp_path), one), loaded)
    assert sorted(r.source_file for r in changed.collect()) == ["f_2.csv", "f_3.csv"]
    assert sorted(r.id for r in feeds.load_feeds(spark, str(tmp_path), one, loaded=loaded)["f"].collect()) == ["2", "22", "3"]


def test_every_feed_loads_from_its_place(spark, tmp_path):
    for feed, pattern in FEEDS.items():
        path = tmp_path / pattern.replace("*/", "X/").replace("*", "x")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"id,_extracted_at\n{feed},2026-01-01 00:00:00\n")
    found = feeds.load_feeds(spark, str(tmp_path))
    assert {name: [r.id for r in df.collect()] for name, df in found.items()} == {name: [name] for name in FEEDS}
    assert load_summary(ingest_log(found, datetime(2026, 2, 2))).filter("files = 1 and rows = 1").count() == 14


def test_empty_files_and_files_with_a_header_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,late\n")
    (tmp_path / "c.csv").write_text("\n  \nid\n7\n")
    (tmp_path / "d.csv").write_text("\ufeffid\r\n8\r\n", encoding="utf-8")
    df = load_feed(spark, str(tmp_path), "*.csv")
    assert sorted(map(tuple, df.select("id", "late").collect())) == [("7", None), ("8", None)]


def test_no_files(spark, tmp_path):
    (tmp_path / "erp").mkdir()
    (tmp_path / "erp" / "other.csv").write_text("a\n1\n")
    with pytest.raises(Exception, match="(?i)no files|does not exist|not found"):
        load_feed(spark, str(tmp_path), "erp/gl_*.csv")


def test_contract_names_the_drifting_file(spark, tmp_path):
    shop.deliver(tmp_path, shop.schema_drift)
    (tmp_path / "ecommerce" / "orders_2026-05.csv").write_text("order_id,_extracted_at\nW-8,2026-04-01 00:00:00\n")
    headers = file_headers(spark, f"{tmp_path}/ecommerce/orders_*.csv").select(
        F.element_at(F.split("path", "/"), -1).alias("path"),
        F.array_append("columns", F.lit("_source_file")).alias("columns"),
    )
    issues = {(r.source_file, r.column_name, r.issue) for r in checks.contract_issues(headers, declared.WEB_ORDER_CONTRACT).collect()}
    assert ("orders_2026-04.csv", "promo_code", "unexpected column (not in the contract)") in issues
    assert ("orders_2026-05.csv", "currency", "missing column") in issues
    assert not [i for i in issues if i[0] == "orders_2026-03.csv"]


def test_marts_are_stored_by_month_and_pruned(spark, tmp_path):
    m = shop.models(spark, tmp_path / "raw")
    lines = m.fct_sales_lines
    stored = sinks.write_mart(lines, str(tmp_path / "fct"), "order_date")
    assert sorted(map(tuple, stored.select(*lines.columns).collect())) == sorted(map(tuple, lines.collect()))
    pruned = sinks.month_range(stored, "order_date", "2026-03-04", "2026-03-05")
    assert pruned.count() == lines.filter("order_date between '2026-03-04' and '2026-03-05'").count()
    plan = pruned._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_month" in plan


def test_dated_metrics_read_the_months_they_need(spark, tmp_path):
    m = shop.models(spark, tmp_path / "raw")
    ask = {"metrics": ["revenue", "ad_spend"], "group_by": ["region"], "start": "2026-03-04", "end": "2026-03-05"}
    want = sorted(map(str, MetricLayer(lambda name: getattr(m, name)).query(**ask).collect()))
    for name, day in (("fct_sales_lines", "order_date"), ("fct_ad_spend", "spend_date")):
        m.replace(name, sinks.write_mart(getattr(m, name), str(tmp_path / name), day))
    pruned = MetricLayer(lambda name: getattr(m, name)).query(**ask)
    assert sorted(map(str, pruned.collect())) == want
    assert pruned._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [isnotnull(_month") >= 2


def test_full_refresh_publishes_a_new_version_and_keeps_the_one_before(spark, tmp_path):
    m, root = shop.models(spark, tmp_path / "raw"), str(tmp_path / "warehouse")
    assert sinks.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        sinks.stored_marts(m, root)
    seen = []
    for _ in range(3):
        sinks.build_marts(m, root)
        seen.append(sinks.current_version(spark, root))
    assert len(set(seen)) == 3 and sorted(seen) == seen
    assert sorted(p.name for p in (tmp_path / "warehouse/versions").iterdir()) == [s.split("/")[-1] for s in seen[1:]]
    stored = sinks.stored_marts(m, root)
    assert stored.fct_sales_lines.count() == 8 == spark.read.parquet(f"{seen[1]}/marts/fct_sales_lines").count()
    assert stored.rpt_monthly_sales.count() == m.rpt_monthly_sales.count()
    ask = {"metrics": ["revenue", "orders", "roas"], "group_by": ["date", "region"]}
    layers = (MetricLayer(lambda name, x=x: getattr(x, name)) for x in (stored, m))
    one, two = (sorted(map(str, layer.query(**ask).collect())) for layer in layers)
    assert one == two


def test_a_refresh_that_fails_half_way_leaves_the_old_marts(spark, tmp_path, monkeypatch):
    m, root = shop.models(spark, tmp_path / "raw"), str(tmp_path / "warehouse")
    sinks.build_marts(m, root)
    before = sinks.current_version(spark, root)
    want = sorted(map(str, sinks.stored_marts(m, root).fct_sales_lines.collect()))
    real, written = sinks.write_mart, []

    def failing(df, path, date_column=None):
        if path.endswith("fct_ad_spend"):
            df = df.withColumn("spend_id", F.raise_error(F.lit("executor lost")).cast("string"))
        written.append(path)
        return real(df, path, date_column)

    monkeypatch.setattr(sinks, "write_mart", failing)
    with pytest.raises(Exception, match="executor lost"):
        sinks.build_marts(m, root)
    assert len(written) > 8  # facts of the new version were written before it failed
    assert sinks.current_version(spark, root) == before
    assert sorted(map(str, sinks.stored_marts(m, root).fct_sales_lines.collect())) == want
    monkeypatch.undo()
    sinks.build_marts(m, root)
    assert sinks.current_version(spark, root) != before and sinks.stored_marts(m, root).fct_ad_spend.count() > 0


def test_failures_and_reports_are_stored(spark, tmp_path):
    m = shop.models(spark, tmp_path / "raw", shop.duplicate_rows)
    check = next(c for c in declared.DECLARED if c.name == "pos_transaction_line_is_unique")
    kept = sinks.store_failures(checks.findings([check], declared.relation_of(m)), str(tmp_path / "w"))
    assert sorted(map(tuple, kept.collect())) == [
        (check.name, '{"unique_field":"T-1-1","n_records":2}', 1),
        (check.name, '{"unique_field":"T-1-2","n_records":2}', 1),
    ]
    report = m.rpt_monthly_delivery
    sinks.write_report_csv(report, str(tmp_path / "r.csv"))
    assert sorted(map(tuple, sinks.read_report_csv(report, str(tmp_path / "r.csv")).collect())) == sorted(map(tuple, report.collect()))


def test_feed_globs_are_complete():
    assert len(feeds.FEEDS) == 14
