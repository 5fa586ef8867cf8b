"""Hand-computed cases: wealth ledger, standalone quarters, performance, drift, malformed payloads."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fundamentals, labels, monitoring, portfolio
from tidemark.sources import payloads, sinks
from tidemark.streaming import logs

D = dt.date


@pytest.fixture(scope="module")
def calendar(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(8)]
    rows = [(d, i + 1, days[i + 1] if i + 1 < len(days) else None) for i, d in enumerate(days)]
    return days, spark.createDataFrame(rows, "session_date date, idx int, next_session date")


def ledger(spark, calendar, prices, actions, horizon=3):
    days, sessions = calendar
    at = dt.datetime(2024, 1, 1, 23)
    bars = spark.createDataFrame([(1, d, p, at) for d, p in zip(days[1:], prices)], "security_id long, session_date date, price double, available_at timestamp")
    schema = "security_id long, action_id string, action_type string, effective_date date, process_date date, cash_amount double, ratio_numerator double, ratio_denominator double, currency string, available_at timestamp"
    acts = spark.createDataFrame([(1, i, k, e, e or days[2], c, n, d, "USD", at) for i, k, e, c, n, d in actions], schema)
    windows = spark.createDataFrame([(days[0], days[1], days[1 + horizon])], "formation_date date, entry_date date, outcome_date date")
    return labels.wealth_returns(bars, acts, sessions, windows, horizon).first()


def test_split_before_dividend_on_the_same_day(spark, calendar):
    days, _ = calendar
    row = ledger(spark, calendar, [100.0, 50.0, 51.0, 52.0], [("b", "cash_dividend", days[2], 1.0, None, None), ("a", "forward_split", days[2], None, 2.0, 1.0)])
    assert row.status == "completed" and row.quantity == 2 and row.cash == 2
    assert row.wealth_return == pytest.approx((2 * 52 + 2) / 100 - 1)


def test_action_on_entry_is_out_and_on_exit_is_in(spark, calendar):
    days, _ = calendar
    row = ledger(spark, calendar, [100.0] * 4, [("a", "cash_dividend", days[1], 5.0, None, None), ("b", "cash_dividend", days[4], 3.0, None, None)])
    assert row.cash == 3


@pytest.mark.parametrize("prices, actions, reason", [
    ([100.0, 120.0, 120.0, 120.0], [], "unexplained structural"),
    ([100.0, 100.0, 100.0, 100.0], [("a", "spin_off", D(2024, 1, 3), None, None, None)], "unresolved complex corporate action: spin_off"),
    ([100.0, 100.0, 100.0, 100.0], [("a", "mystery", D(2024, 1, 3), None, None, None)], "unknown corporate action type: mystery"),
    ([100.0, 100.0, 100.0, 100.0], [("a", "cash_dividend", None, 1.0, None, None)], "corporate action has no effective date"),
    ([100.0, 100.0, 100.0, 100.0], [("a", "forward_split", D(2024, 1, 3), None, None, None)], "split action has no complete ratio"),
    ([100.0, 100.0, 100.0], [], "missing_complete_security_price_path"),
])
def test_withheld_labels(spark, calendar, prices, actions, reason):
    row = ledger(spark, calendar, prices, actions)
    assert row.status == "withheld" and row.reason.startswith(reason) and row.wealth_return is None


def facts(spark, rows):
    schema = ("security_id long, accession string, form string, is_amendment boolean, accepted_at timestamp, available_at timestamp, taxonomy string, concept string, unit string, "
              "period_start date, period_end date, fiscal_year int, fiscal_period string, value double")
    out = []
    for accession, start, end, slot, value, at in rows:
        out.append((1, accession, "10-K" if slot == "FY" else "10-Q", False, at, at, "us-gaap", "NetIncomeLoss", "USD", start, end, 2023, slot, value))
    return spark.createDataFrame(out, schema)


def test_standalone_quarters_from_cumulative_facts(spark):
    start, at = D(2023, 1, 1), dt.datetime(2024, 3, 1)
    rows = [("a", start, D(2023, 3, 31), "Q1", 10.0, at), ("b", start, D(2023, 6, 30), "Q2", 25.0, at), ("c", start, D(2023, 9, 30), "Q3", 45.0, at), ("d", start, D(2023, 12, 31), "FY", 70.0, at)]
    df = facts(spark, rows)
    quarters = {r.quarter: r.value for r in fundamentals.latest_quarters(fundamentals.standalone_quarters(df)).collect()}
    assert quarters == {"Q1": 10.0, "Q2": 15.0, "Q3": 20.0, "Q4": 25.0}
    formations = spark.createDataFrame([(D(2024, 3, 29), dt.datetime(2024, 3, 30, 0))], "formation_date date, decision_at timestamp")
    assert fundamentals.true_ttm(fundamentals.standalone_quarters(df), formations, ["NetIncomeLoss"], "income").first().income == 70.0


def test_conflicting_tied_facts_drop_the_quarter(spark):
    start, at = D(2023, 1, 1), dt.datetime(2024, 3, 1)
    df = facts(spark, [("a", start, D(2023, 3, 31), "Q1", 10.0, at), ("z", start, D(2023, 3, 31), "Q1", 11.0, at)])
    assert fundamentals.latest_quarters(fundamentals.standalone_quarters(df)).count() == 0


def test_performance_metrics(spark):
    nav = spark.createDataFrame([("p", D(2024, 1, 1), 100.0, 100.0), ("p", D(2024, 1, 2), 110.0, 105.0), ("p", D(2024, 1, 3), 99.0, 110.0)], "k string, session_date date, portfolio_nav double, benchmark_nav double")
    row = portfolio.performance(nav, ["k"]).first()
    assert row.max_drawdown == pytest.approx(-0.1) and row.portfolio_return == pytest.approx(-0.01)
    assert row.relative_return == pytest.approx(-0.11) and row.sortino == pytest.approx(0.0, abs=1e-9)


def test_stability_index_needs_a_hundred_rows(spark):
    few = spark.range(99).select(F.lit("f").alias("k"), (F.col("id") / 100).alias("percentile"))
    many = spark.range(100).select(F.lit("f").alias("k"), (F.col("id") / 100).alias("percentile"))
    assert monitoring.stability_index(few, many, ["k"]).first().psi is None
    assert monitoring.stability_index(many, many, ["k"]).first().psi == pytest.approx(0.0)


def text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("scan, payload", [
    (payloads.daily_bars, '{"next_page_token": null}'),
    (payloads.company_tickers, '{"fields": ["name", "cik", "ticker", "exchange"], "data": [["a", "1", "T", "NYSE"]]}'),
    (lambda df: payloads.submissions(df, False), '{"form": ["10-K", "10-Q"], "accessionNumber": ["a"], "filingDate": ["2024-01-01"], "acceptanceDateTime": ["2024-01-01T00:00:00Z"], "reportDate": [""]}'),
    (payloads.daily_master_index, "no header here"),
    (payloads.daily_master_index, "CIK|Company Name|Form Type|Date Filed|File Name\n1|A|10-K|2024-01-01"),
])
def test_malformed_payloads_fail(spark, scan, payload):
    with pytest.raises(Exception):
        scan(text(spark, payload)).collect()


def test_export_refuses_overwrite_and_reads_pruned(spark, tmp_path):
    rows = spark.range(10).select("id", F.when(F.col("id") < 7, "development").otherwise("holdout").alias("part"))
    path = str(tmp_path / "export")
    assert {r.part: r.rows_count for r in sinks.export_dataset(rows, path, "part").collect()} == {"development": 7, "holdout": 3}
    with pytest.raises(Exception):
        sinks.export_dataset(rows, path, "part")
    plan = spark.read.parquet(path).where("part = 'development'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_late_rows_never_change_a_closed_decision(spark, tmp_path):
    schema = "event_id long, available_at timestamp"
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    decisions = spark.createDataFrame([(D(2024, 1, d), dt.datetime(2024, 1, d, 20)) for d in (1, 2, 3)], "formation_date date, decision_at timestamp")
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    run = lambda: logs.run_to_end(logs.file_stream(spark, source, spark.createDataFrame([], schema).schema), f"{root}/cp", batch=logs.close_decisions(f"{root}/rows", decisions, "available_at", "available_at", "0 seconds"))
    write([(1, dt.datetime(2024, 1, 1, 10)), (2, dt.datetime(2024, 1, 2, 10))])
    run()
    write([(3, dt.datetime(2024, 1, 1, 11)), (4, dt.datetime(2024, 1, 3, 10))])
    run()
    found = {(r.event_id, r.formation_date) for r in spark.read.parquet(f"{root}/rows").collect()}
    # row 3 is late for the first decision, which keeps its rows, and joins the next open one
    assert found == {(1, D(2024, 1, 1)), (2, D(2024, 1, 2)), (3, D(2024, 1, 2)), (4, D(2024, 1, 3))}


def test_stream_deduplicates_across_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = spark.range(0).withColumn("observation_hash", F.lit("")).schema
    for batch in (["a", "b"], ["b", "c"]):
        spark.createDataFrame([(i, h) for i, h in enumerate(batch)], "id long, observation_hash string").coalesce(1).write.mode("append").parquet(source)
        logs.run_to_end(logs.deduplicated(logs.file_stream(spark, source, schema)), f"{out}/cp", sink=f"{out}/rows")
    assert sorted(r.observation_hash for r in spark.read.parquet(f"{out}/rows").collect()) == ["a", "b", "c"]
