import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as f
from tidemark.operators import monthly_fundamentals as mf

FACTS = ("security_id int, accession string, is_amendment boolean, accepted_at timestamp, available_at timestamp, concept string, unit string, "
         "period_start date, period_end date, value double")


def day(text):
    return dt.date.fromisoformat(text)


def fact(security, concept, end, value, known, start=None, unit="USD", amended=False):
    at = dt.datetime.fromisoformat(f"{known} 12:00:00")
    return (security, f"{concept}-{end}-{known}", amended, at, at, concept, unit, day(start) if start else None, day(end), float(value))


@pytest.fixture(scope="module")
def formations(spark):
    days = [dt.date(2000 + m // 12, m % 12 + 1, 28) for m in range(30)]
    return spark.createDataFrame([(d, dt.datetime.combine(d, dt.time(20))) for d in days], "formation_date date, decision_at timestamp")


def at(rows, when):
    return {r.security_id: r for r in rows if r.formation_date == day(when)}


def test_later_filings_do_not_reach_back(spark, formations):
    rows = [fact(1, "Assets", "1999-01-31", 100, "2000-01-05"), fact(1, "Assets", "2000-01-31", 150, "2000-03-01"),
            fact(1, "Assets", "1999-01-31", 50, "2000-06-01", amended=True), fact(1, "Assets", "2001-01-25", 300, "2001-03-01"), fact(2, "Assets", "2000-01-31", 7, "2000-02-01")]
    got = mf.asset_growth(spark.createDataFrame(rows, FACTS), formations).collect()
    assert at(got, "2000-02-28")[1].reason == "missing_comparable_prior_assets" and at(got, "2000-02-28")[1].current_end == day("1999-01-31")
    assert at(got, "2000-03-28")[1].asset_growth == pytest.approx(0.5) and at(got, "2000-05-28")[1].asset_growth == pytest.approx(0.5)
    assert at(got, "2000-06-28")[1].asset_growth == pytest.approx(2.0)  # the amendment of the prior, from then on
    assert at(got, "2001-03-28")[1].prior_end == day("2000-01-31") and at(got, "2001-03-28")[1].asset_growth == pytest.approx(1.0)
    assert at(got, "2002-06-28")[2].reason == "missing_comparable_prior_assets" and 2 not in at(got, "2000-01-28")
    assert len({(r.formation_date, r.security_id) for r in got}) == len(got)
    # a fact that is filed later changes no earlier formation
    more = mf.asset_growth(spark.createDataFrame([*rows, fact(1, "Assets", "2000-01-31", 9, "2001-05-01")], FACTS), formations).collect()
    early = lambda found: sorted((r for r in found if r.formation_date < day("2001-05-01")), key=str)
    assert early(got) == early(more)


def test_the_prior_nearest_to_a_year_counts(spark, formations):
    rows = [fact(1, "Assets", "2000-12-31", 10, "2001-01-05")] + [
        fact(1, "Assets", end, value, "2000-02-01") for end, value in (("1999-12-10", 1), ("2000-01-02", 2), ("2000-01-30", 4), ("2000-02-10", 5))]
    got = at(mf.asset_growth(spark.createDataFrame(rows, FACTS), formations).collect(), "2001-01-28")[1]
    assert got.prior_end == day("2000-01-02") and got.asset_growth == pytest.approx(4.0)


def test_shares_fall_back_to_weighted_averages_and_splits_adjust(spark, formations):
    weighted = lambda s, year, v: fact(s, mf.WEIGHTED_SHARES, f"{year}-12-31", v, f"{year + 1}-02-01", start=f"{year}-01-01", unit="shares")
    rows = [weighted(1, 1998, 100), weighted(1, 1999, 300), fact(1, f.SHARES, "1999-12-31", 5, "2000-02-01", unit="shares"),
            fact(2, mf.WEIGHTED_SHARES, "1999-12-31", 9, "2000-02-01", start="1999-10-01", unit="shares"),
            *[fact(s, f.SHARES, f"{y}-12-31", v, f"{y + 1}-02-01", unit="shares") for s in (3, 4) for y, v in ((1998, 100), (1999, 300))]]
    actions = [(1, "forward_split", "1999-05-05", 2.0, 1.0, "1999-05-06"), (1, "forward_split", "1998-12-31", 9.0, 1.0, "1999-01-01"), (1, "reverse_split", "1999-12-31", 1.0, 4.0, "2000-04-01"),
               (3, "spin_off", "1999-07-01", None, None, "2000-05-01"), (4, "unit_split", "1999-07-01", 0.0, 1.0, "1999-08-01")]
    frame = spark.createDataFrame(actions, "security_id int, action_type string, effective_date string, ratio_numerator double, ratio_denominator double, available_at string")
    frame = frame.withColumn("effective_date", F.to_date("effective_date")).withColumn("available_at", F.to_timestamp("available_at"))
    got = mf.net_share_issuance(spark.createDataFrame(rows, FACTS), frame, formations).collect()
    first, later = at(got, "2000-02-28"), at(got, "2000-05-28")
    assert first[1].concept == mf.WEIGHTED_SHARES and first[1].net_share_issuance == pytest.approx(300 / 200 - 1)
    assert later[1].net_share_issuance == pytest.approx(300 / (100 * 2 / 4) - 1)  # the split that is known by then
    assert 2 not in first and first[3].net_share_issuance == pytest.approx(2.0) and later[3].reason == "structural_corporate_action"
    assert first[4].reason == "invalid_split_ratio" and first[4].net_share_issuance is None


def test_spans_meet_the_actions_of_their_own_months(spark):
    spans = spark.createDataFrame([(day("2000-01-01"), s, a and day(a), b and day(b), dt.datetime(2000, 1, 1)) for s, a, b in (
        (1, "1999-01-31", "1999-12-31"), (2, None, None), (3, "1999-05-01", "1999-05-01"), (4, "1999-06-01", "1999-05-01"))],
        "formation_date date, security_id int, span_start date, span_end date, decision_at timestamp")
    rows = [(s, "forward_split", day(e), 2.0, 1.0, dt.datetime(1999, 1, 1)) for s in (1, 3, 4) for e in ("1999-01-31", "1999-02-01", "1999-05-01", "1999-12-31", "2000-01-01")]
    actions = spark.createDataFrame(rows, "security_id int, action_type string, effective_date date, ratio_numerator double, ratio_denominator double, available_at timestamp")
    assert {r.security_id: (r.factor, r.factor_reason) for r in f.split_factor(actions, spans).collect()} == {1: (8.0, None), 2: (1.0, None), 3: (1.0, None), 4: (1.0, None)}


def test_accruals_need_four_inputs_known_together(spark, formations):
    year = lambda c, v, known, y=1999: fact(1, c, f"{y}-12-31", v, known, start=f"{y}-01-01")
    rows = [year("ProfitLoss", 80, "2000-02-01"), year(f.CASH_FLOW[0], 20, "2000-03-01"), fact(1, "Assets", "1999-01-03", 100, "1999-03-01"), fact(1, "Assets", "1998-12-30", 200, "2000-04-01"),
            fact(1, "Assets", "1999-12-31", 300, "2000-02-01"), year("NetIncomeLoss", 60, "2000-06-01"), year("NetIncomeLoss", 500, "2001-03-01", 2000), year(f.CASH_FLOW[0], 100, "2001-03-01", 2000),
            fact(1, "Assets", "2000-12-31", 500, "2001-04-01")]
    got = mf.accrual_quality(spark.createDataFrame(rows, FACTS), formations).collect()
    value = {m: at(got, m)[1].accrual_quality for m in ("2000-03-28", "2000-04-28", "2000-06-28", "2001-03-28", "2001-04-28")}
    assert 1 not in at(got, "2000-02-28")
    assert value["2000-03-28"] == pytest.approx(60 / 200) and value["2000-04-28"] == pytest.approx(60 / 250)  # of two beginnings equally near the earlier
    assert value["2000-06-28"] == pytest.approx((60 - 20) / 250)  # net income before profit, once it is known
    assert value["2001-03-28"] == value["2000-06-28"] and value["2001-04-28"] == pytest.approx(400 / 400)
