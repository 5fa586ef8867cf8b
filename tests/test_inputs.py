"""Malformed payloads fail, repeated rows stay, ties resolve the same way each time."""

import datetime as dt

import pytest

from tidemark.operators import joins
from tidemark.sources import payloads, sinks

D = dt.date


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


@pytest.mark.parametrize("text", ['{"bars": {"A": 5}}', '{"bars": {"A": null}}', "{}", "not json", '{"bars": {"A": [{"t": 1'])
def test_malformed_bars_fail(spark, text):
    with pytest.raises(Exception):
        payloads.daily_bars(texts(spark, '{"bars": {}}', text)).collect()


@pytest.mark.parametrize("text", ['{"corporate_actions": {"cash_dividends": {}}}', '{"corporate_actions": {"cash_dividends": null}}', "{}", "["])
def test_malformed_actions_fail(spark, text):
    with pytest.raises(Exception):
        payloads.corporate_actions(texts(spark, text)).collect()


def test_well_formed_payloads_pass(spark):
    bar = '{"bars": {"a": [{"t": "2024-01-02T05:00:00Z", "o": 1.5, "h": 2, "l": 1, "c": 1.75, "v": 10}], "B": []}}'
    rows = payloads.daily_bars(texts(spark, bar)).collect()
    assert [(r.session_date, float(r.open), int(r.volume)) for r in rows] == [(D(2024, 1, 2), 1.5, 10)]


def test_equal_rows_keep_their_listing_each(spark):
    rows = spark.createDataFrame([(1, D(2024, 1, 2))] * 3 + [(2, D(2024, 1, 2))], "security_id long, day date")
    listings = spark.createDataFrame([(1, "X", D(2024, 1, 1), None)], "security_id long, ticker string, valid_from date, valid_to date")
    assert sorted((r.security_id, r.ticker) for r in joins.listing_on(rows, listings, "day").collect() if r.ticker) == [(1, "X")] * 3
    assert sorted(r.ticker for r in joins.latest_ticker(rows, listings, "day").collect()) == ["Unavailable", "X", "X", "X"]


def test_last_write_of_a_bar_follows_the_sequence(spark):
    stored = spark.createDataFrame([(1, D(2024, 1, 2), 5.0, "r0")], "security_id long, session_date date, close double, receipt_id string")
    incoming = spark.createDataFrame(
        [(1, D(2024, 1, 2), 9.0, "r1", 1), (1, D(2024, 1, 2), 7.0, None, 2)], "security_id long, session_date date, close double, receipt_id string, n int")
    keys = ["security_id", "session_date"]
    row = sinks.upsert_bars(stored, incoming, keys, skip_existing=False, sequence="n").first()
    assert (row.close, row.receipt_id) == (7.0, "r0")
    for order in (("n",), ("close",)):
        row = sinks.upsert_bars(stored, incoming.orderBy(*order).drop("n"), keys, skip_existing=False).first()
        assert (row.close, row.receipt_id) == (9.0, "r1")
    fresh = sinks.new_rows(incoming.drop("n"), stored.limit(0), keys).collect()
    assert len(fresh) == 1 and fresh[0].close == 7.0
