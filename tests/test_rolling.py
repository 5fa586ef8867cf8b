"""Residual volatility against brute force, and its work per row."""

import datetime
import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import windows as w

START = datetime.date(2020, 1, 1)


def bars(spark):
    rng = np.random.default_rng(11)
    rows, market = [], []
    for i in range(200):
        day = START + datetime.timedelta(days=i)
        if i != 150:
            market.append((day, 50.0 if i >= 100 and i < 149 else float(100 * np.exp(0.01 * rng.normal()))))
        for security in (1, 2, 3):
            # The second security jumps by 300 orders of magnitude, the third is infinite once.
            price = float(100 * np.exp(0.02 * rng.normal()))
            if security == 2 and i < 20:
                price *= 1e-300
            if security == 3 and i == 30:
                price = math.inf
            rows.append((security, day, price, 10))
    return (spark.createDataFrame(rows, "security_id long, session_date date, close double, volume long"),
            spark.createDataFrame(market, "session_date date, close double"), rows, dict(market))


def expected(rows, market):
    found = {}
    for security in (1, 2, 3):
        days = [(d, c) for s, d, c, _ in rows if s == security]
        for i in range(60, len(days)):
            span = days[i - 60:i + 1]
            if any(d not in market for d, _ in span):
                found[security, days[i][0]] = "mismatched_61_session_benchmark_history"
                continue
            with np.errstate(all="ignore"):
                ratio = np.array([b / a for (_, a), (_, b) in zip(span, span[1:])])
                b = np.diff(np.log([market[d] for d, _ in span]))[ratio > 0]  # the logarithm of zero is null
                r = np.log(ratio[ratio > 0])
                r, b = r - r.mean(), b - b.mean()
                sse = (r * r).sum() - (r * b).sum() ** 2 / (b * b).sum()
                found[security, days[i][0]] = float(np.sqrt(max(sse, 0) / 58 * 252)) if np.isfinite(sse) else math.nan
    return found


def test_rolling_regression_equals_brute_force(spark):
    frame, benchmark, rows, market = bars(spark)
    out = w.idiosyncratic_volatility_60d(w.price_history(frame), benchmark)
    got = {(r.security_id, r.session_date): r.idiosyncratic_volatility_60d if r.idiosyncratic_volatility_60d_reason is None else r.idiosyncratic_volatility_60d_reason
           for r in out.collect()}
    for key, value in expected(rows, market).items():
        if isinstance(value, str):
            assert got[key] == value
        else:
            np.testing.assert_allclose(got[key], value, rtol=1e-9, equal_nan=True, err_msg=str(key))
    assert sum(v == "insufficient_61_session_history" for v in got.values()) == 180


def test_flat_benchmark_has_a_reason(spark):
    frame, _, rows, market = bars(spark)
    flat = spark.createDataFrame([(d, 50.0) for d in {d for _, d, _, _ in rows}], "session_date date, close double")
    out = w.idiosyncratic_volatility_60d(w.price_history(frame), flat).where("history > 60")
    assert [r[0] for r in out.select("idiosyncratic_volatility_60d_reason").distinct().collect()] == ["zero_benchmark_variance"]


def test_work_per_row_does_not_grow_with_the_frame(spark):
    """No frame slides: a sliding frame adds up its 60 rows anew for every row."""
    frame, benchmark, _, _ = bars(spark)
    plan = w.idiosyncratic_volatility_60d(w.price_history(frame), benchmark)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe" in plan and "-60, currentrow" not in plan and "-59, currentrow" not in plan


def test_frames_are_put_together_from_short_ones(spark):
    """Deviation and median equal brute force, with nulls and a flat series; no frame of the plan slides over more than ten rows."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        day = START + datetime.timedelta(days=i)
        rows.append((1, day, float(100 * np.exp(0.02 * rng.normal())), int(rng.integers(1, 50))))
        rows.append((2, day, 7.0, None if i % 3 == 0 else int(rng.integers(1, 50))))
    frame = spark.createDataFrame(rows, "security_id long, session_date date, close double, volume long")
    market = spark.createDataFrame([(START + datetime.timedelta(days=i), 50.0 + i) for i in range(150) if i != 140], "session_date date, close double")
    days = spark.createDataFrame([(START + datetime.timedelta(days=i), i) for i in range(150)], "session_date date, idx int")
    out = w.relative_strength_6m(w.median_dollar_volume_20d(w.volatility_60d(w.price_history(frame))), market, days, strict=False)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and all(f"-{n}, currentrow" not in plan for n in (19, 59, 126))
    found = {(r["security_id"], (r["session_date"] - START).days): r for r in out.collect()}
    for security in (1, 2):
        own = [(c, v) for s, _, c, v in rows if s == security]
        for i, (close, _) in enumerate(own):
            row = found[security, i]
            if i >= 60:
                r = [math.log(own[k][0] / own[k - 1][0]) for k in range(i - 59, i + 1)]
                assert math.isclose(row["trailing_volatility_60d"], np.std(r, ddof=1) * math.sqrt(252), rel_tol=1e-12)
            else:
                assert row["trailing_volatility_60d"] is None and row["trailing_volatility_60d_reason"] == "insufficient_61_session_history"
            if i >= 19:
                assert row["median_dollar_volume_20d"] == np.median([c * v for c, v in own[i - 19:i + 1] if v is not None])
            if i >= 126:
                mismatched = "mismatched_127_session_benchmark_history" if i >= 140 else None
                assert row["relative_strength_6m_reason"] == mismatched and (row["relative_strength_6m"] is None) == (i >= 140)
