"""WIN: window features."""

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import windows as w
from . import query
from .joins import RUNS, runs

OWN = "PARTITION BY security_id ORDER BY session_date"


def feature_sql(name: str, value: str, size: int, source: str, extra: str = "") -> str:
    """Value-or-reason statement: ``source`` selects security_id, session_date and helpers; n is the own session number."""
    return f"""
    WITH src AS ({source}), x AS (SELECT *, row_number() OVER o AS n, {value} AS v FROM src WINDOW o AS ({OWN})),
    y AS (SELECT security_id, session_date, v, CASE WHEN n < {size} THEN 'insufficient_{size}_session_history' {extra} END AS {name}_reason FROM x)
    SELECT security_id, session_date, CASE WHEN {name}_reason IS NULL THEN v END AS {name}, {name}_reason FROM y"""


def cells(df, name):
    return df.select("security_id", "session_date", name, f"{name}_reason")


LOGS = f"SELECT security_id, session_date, close, ln(close / lag(close) OVER ({OWN})) AS r FROM bars"

DIRTY_PRICES = """
    SELECT security_id, session_date, close, volume FROM bars
    UNION ALL SELECT security_id, session_date, close, volume FROM bars WHERE security_id % 7 = 3 AND session_date = DATE '1999-03-01'
    UNION ALL SELECT security_id, DATE '1999-03-02', 0.0, 1 FROM securities WHERE security_id % 11 = 5"""


def dirty_prices(r):
    base = r.bars.select("security_id", "session_date", "close", "volume")
    copies = base.where("security_id % 7 = 3 AND session_date = DATE'1999-03-01'")
    zero = r.securities.where("security_id % 11 = 5").select(
        "security_id", F.lit("1999-03-02").cast("date").alias("session_date"), F.lit(0.0).alias("close"), F.lit(1).cast("long").alias("volume"))
    return base.unionByName(copies).unionByName(zero)


@query("WIN01_price_window_guard", f"""
    WITH d AS (SELECT security_id, session_date, max(close) AS close, min(close) AS low, count(*) AS copies FROM ({DIRTY_PRICES}) GROUP BY 1, 2),
    g AS (SELECT security_id, session_date, row_number() OVER ({OWN}) AS history,
                 CASE WHEN max(copies) OVER ({OWN} ROWS UNBOUNDED PRECEDING) > 1 THEN 'duplicate_price_observation'
                      WHEN min(low) OVER ({OWN} ROWS UNBOUNDED PRECEDING) <= 0 THEN 'nonpositive_price' END AS guard FROM d)
    SELECT security_id, session_date, history, coalesce(guard, CASE WHEN history < 61 THEN 'insufficient_61_session_history' END) AS reason FROM g""")
def _(r):
    return w.price_history(dirty_prices(r)).select("security_id", "session_date", "history", w.short_history(61).alias("reason"))


@query("WIN02_momentum_12_1", feature_sql("momentum_12_1", "lag(close, 21) OVER o / lag(close, 252) OVER o - 1", 253,
       "SELECT security_id, session_date, close FROM bars"), digits="momentum_12_1")
def _(r):
    return cells(w.momentum_12_1(w.price_history(r.bars)), "momentum_12_1")


@query("WIN03_relative_strength_6m", feature_sql("relative_strength_6m",
       "(close / lag(close, 126) OVER o - 1) - (b / lag(b, 126) OVER o - 1)", 127,
       f"SELECT d.security_id, d.session_date, d.adjusted_open AS close, m.open AS b, s.idx, s.idx - 126 = lag(s.idx, 126) OVER (PARTITION BY d.security_id ORDER BY d.session_date) AS ok "
       "FROM dense_bars d JOIN dense_benchmark m USING (session_date) JOIN sessions s USING (session_date)",
       "WHEN ok IS NOT TRUE THEN 'mismatched_127_session_benchmark_history'"), digits="relative_strength_6m")
def _(r):
    history = w.price_history(r.dense_bars.withColumnRenamed("adjusted_open", "close"))
    out = w.relative_strength_6m(history, r.dense_benchmark.withColumnRenamed("open", "close"), r.sessions, strict=True)
    return cells(out, "relative_strength_6m")


@query("WIN03_relative_strength_6m_weekly", feature_sql("relative_strength_6m",
       "(close / lag(close, 126) OVER o - 1) - (b / lag(b, 126) OVER o - 1)", 127,
       "SELECT x.security_id, x.session_date, x.close, m.close AS b FROM bars x JOIN benchmark_bars m USING (session_date)"), digits="relative_strength_6m")
def _(r):
    out = w.relative_strength_6m(w.price_history(r.bars), r.benchmark_bars, r.sessions, strict=False)
    return cells(out, "relative_strength_6m")


@query("WIN04_trailing_volatility_60d", feature_sql("trailing_volatility_60d",
       "stddev_samp(r) OVER (o ROWS 59 PRECEDING) * sqrt(252)", 61, LOGS).replace("OVER (o ROWS", f"OVER ({OWN} ROWS"), digits="trailing_volatility_60d")
def _(r):
    return cells(w.volatility_60d(w.price_history(r.bars)), "trailing_volatility_60d")


@query("WIN05_median_dollar_volume_20d", feature_sql("median_dollar_volume_20d",
       "sorted[10] * 0.5 + sorted[11] * 0.5", 20,
       f"SELECT security_id, session_date, list_sort(list(close * volume) OVER ({OWN} ROWS 19 PRECEDING)) AS sorted FROM unadjusted_bars"), digits="median_dollar_volume_20d:8")
def _(r):
    return cells(w.median_dollar_volume_20d(w.price_history(r.unadjusted_bars)), "median_dollar_volume_20d")


@query("WIN06_short_term_reversal_20d", feature_sql("short_term_reversal_20d", "close / lag(close, 20) OVER o - 1", 21,
       "SELECT security_id, session_date, close FROM bars"), digits="short_term_reversal_20d")
def _(r):
    return cells(w.short_term_reversal(w.price_history(r.bars), skip_day=False), "short_term_reversal_20d")


@query("WIN07_short_term_reversal_skip_day", feature_sql("short_term_reversal_skip", "lag(close, 1) OVER o / lag(close, 21) OVER o - 1", 22,
       "SELECT security_id, session_date, close FROM bars"), digits="short_term_reversal_skip")
def _(r):
    return cells(w.short_term_reversal(w.price_history(r.bars), skip_day=True), "short_term_reversal_skip")


@query("WIN08_downside_volatility_60d", feature_sql("downside_volatility_60d",
       f"sqrt(avg(pow(least(r, 0), 2)) OVER ({OWN} ROWS 59 PRECEDING) * 252)", 61, LOGS), digits="downside_volatility_60d")
def _(r):
    return cells(w.downside_volatility_60d(w.price_history(r.bars)), "downside_volatility_60d")


@query("WIN09_amihud_illiquidity_20d", feature_sql("amihud_illiquidity_20d",
       f"avg(ar / dv) OVER ({OWN} ROWS 19 PRECEDING)", 21,
       f"""SELECT security_id, session_date, abs(a.close / lag(a.close) OVER ({OWN}) - 1) AS ar, u.dv FROM bars a
           LEFT JOIN (SELECT security_id, session_date, close * volume AS dv FROM unadjusted_bars WHERE NOT (security_id % 10 = 7 AND session_date = DATE '1999-03-01')) u USING (security_id, session_date)""",
       f"WHEN count(dv) OVER ({OWN} ROWS 19 PRECEDING) < 20 THEN 'mismatched_adjusted_and_unadjusted_sessions'"), digits="amihud_illiquidity_20d:12")
def _(r):
    unadjusted = r.unadjusted_bars.where("NOT (security_id % 10 = 7 AND session_date = DATE'1999-03-01')")
    return cells(w.amihud_illiquidity_20d(w.price_history(r.bars), unadjusted), "amihud_illiquidity_20d")


@query("WIN10_realized_volatility_60d", feature_sql("realized_volatility_60d",
       f"sqrt(var_samp(r) OVER ({OWN} ROWS 59 PRECEDING) * 252)", 61, LOGS), digits="realized_volatility_60d")
def _(r):
    return cells(w.volatility_60d(w.price_history(r.bars), "realized_volatility_60d"), "realized_volatility_60d")


PAIRED_LOGS = f"""SELECT security_id, session_date, ln(x.close / lag(x.close) OVER ({OWN})) AS r, ln(m.close / lag(m.close) OVER ({OWN})) AS b
    FROM bars x JOIN benchmark_bars m USING (session_date)"""
SIXTY = f"OVER ({OWN} ROWS 59 PRECEDING)"


@query("WIN11_idiosyncratic_volatility_60d", feature_sql("idiosyncratic_volatility_60d",
       f"sqrt(greatest((var_pop(r) {SIXTY} - pow(covar_pop(r, b) {SIXTY}, 2) / var_pop(b) {SIXTY}) * 60, 0) / 58 * 252)", 61, PAIRED_LOGS),
       digits="idiosyncratic_volatility_60d")
def _(r):
    return cells(w.idiosyncratic_volatility_60d(w.price_history(r.bars), r.benchmark_bars), "idiosyncratic_volatility_60d")


SIGNAL = """SELECT session_date, raw_return, greatest(least(raw_return, 0.3), -0.3) / 0.3 AS market_signal
    FROM (SELECT session_date, close / lag(close, 60) OVER (ORDER BY session_date) - 1 AS raw_return FROM benchmark_bars) WHERE raw_return IS NOT NULL"""


@query("WIN12_market_trend_signal", SIGNAL, digits="raw_return market_signal")
def _(r):
    return w.market_trend_signal(r.benchmark_bars)


@query("WIN13_interactions", f"""
    WITH p AS (SELECT security_id, session_date, (rank() OVER (PARTITION BY session_date ORDER BY close) - 1 + (count(*) OVER (PARTITION BY session_date, close) - 1) / 2.0)
                        / nullif(count(*) OVER (PARTITION BY session_date) - 1, 0) AS momentum_percentile,
                      (rank() OVER (PARTITION BY session_date ORDER BY volume) - 1 + (count(*) OVER (PARTITION BY session_date, volume) - 1) / 2.0)
                        / nullif(count(*) OVER (PARTITION BY session_date) - 1, 0) AS strength_percentile FROM bars)
    SELECT security_id, session_date, (momentum_percentile - 0.5) * market_signal AS momentum_x_market, (strength_percentile - 0.5) * market_signal AS strength_x_market
    FROM p JOIN ({SIGNAL}) s USING (session_date)""", digits="momentum_x_market strength_x_market")
def _(r):
    def percentile(df, value, name):
        return ranks.with_tie_ranks(df, ["session_date"], value).withColumn(name, ranks.tie_percentile()).drop("below", "ties", "total")
    p = percentile(r.bars.select("security_id", "session_date", "close", "volume"), "close", "momentum_percentile")
    p = percentile(p, "volume", "strength_percentile")
    out = w.interactions(p, w.market_trend_signal(r.benchmark_bars))
    return out.select("security_id", "session_date", "momentum_x_market", "strength_x_market")


REGIMES = """
    WITH x AS (SELECT session_date, close, close / lag(close) OVER o - 1 AS r, close / lag(close, 60) OVER o - 1 AS trend, row_number() OVER o AS n
               FROM benchmark_bars WINDOW o AS (ORDER BY session_date)),
    v AS (SELECT session_date, trend, CASE WHEN n >= 61 THEN stddev_pop(r) OVER (ORDER BY session_date ROWS 59 PRECEDING) * sqrt(252) END AS vol,
                 CASE WHEN n >= 61 THEN stddev_pop(r) OVER (ORDER BY session_date ROWS 58 PRECEDING) END AS vol59 FROM x),
    k AS (SELECT *, CASE WHEN trend >= 0.05 THEN 'bullish' WHEN trend <= -0.05 THEN 'bearish' ELSE 'range_bound' END AS tk,
                 CASE WHEN vol < 0.15 THEN 'low_vol' WHEN vol >= 0.25 THEN 'high_vol' ELSE 'normal_vol' END AS vk FROM v)
    SELECT session_date, trend, vol, vol59, CASE WHEN trend IS NULL THEN 'unavailable' ELSE tk || '|' || vk END AS regime,
           CASE WHEN trend IS NULL THEN 'unavailable' ELSE tk END AS market_trend FROM k"""


@query("WIN14_trend_volatility_regime", f"SELECT session_date, regime, vol FROM ({REGIMES})", digits="vol")
def _(r):
    return w.benchmark_regimes(r.benchmark_bars).select("session_date", "regime", "vol")


@query("WIN15_market_trend_regime", f"SELECT market_trend, count(*) AS sessions FROM ({REGIMES}) GROUP BY 1")
def _(r):
    return w.benchmark_regimes(r.benchmark_bars).groupBy("market_trend").agg(F.count(F.lit(1)).alias("sessions"))


@query("WIN16_volatility_tercile", """
    WITH p AS (SELECT *, (rank() OVER (PARTITION BY formation_date ORDER BY value) - 1 + (count(*) OVER (PARTITION BY formation_date, value) - 1) / 2.0)
                     / nullif(count(*) OVER (PARTITION BY formation_date) - 1, 0) AS p
               FROM outcomes WHERE feature_key = 'trailing_volatility_60d' AND value IS NOT NULL)
    SELECT formation_date, CASE WHEN p < 1.0 / 3 THEN 'low' WHEN p <= 2.0 / 3 THEN 'middle' WHEN p <= 1 THEN 'high' END AS tercile, count(*) AS securities FROM p GROUP BY 1, 2""")
def _(r):
    vol = r.outcomes.where("feature_key = 'trailing_volatility_60d' AND value IS NOT NULL")
    ranked = ranks.with_tie_ranks(vol, ["formation_date"], "value").withColumn("p", ranks.tie_percentile())
    return ranked.groupBy("formation_date", w.volatility_tercile(F.col("p")).alias("tercile")).agg(F.count(F.lit(1)).alias("securities"))


FOLD_ROWS = "(1, DATE '1998-01-01', DATE '1998-02-01', DATE '1998-12-31'), (2, DATE '1999-01-01', DATE '1999-02-01', DATE '1999-12-31'), (3, DATE '2000-01-01', DATE '2000-02-01', DATE '2000-12-31')"


@query("WIN17_fold_volatility_regime", f"""
    WITH b AS (SELECT * FROM ({REGIMES}) WHERE vol59 IS NOT NULL), f AS (SELECT * FROM (VALUES {FOLD_ROWS}) AS v(outer_fold, train_until, valid_from, valid_to)),
    t AS (SELECT outer_fold, quantile_cont(vol59, 0.5) AS threshold FROM b JOIN f ON session_date < train_until GROUP BY 1)
    SELECT outer_fold, session_date, (CASE WHEN trend >= 0 THEN 'up' ELSE 'down' END) || '_' || (CASE WHEN vol59 >= threshold THEN 'high_vol' ELSE 'low_vol' END) AS regime, threshold
    FROM b JOIN f ON session_date BETWEEN valid_from AND valid_to JOIN t USING (outer_fold)""", digits="threshold")
def _(r):
    folds = r.spark.sql(f"SELECT * FROM VALUES {FOLD_ROWS} AS t(outer_fold, train_until, valid_from, valid_to)")
    return w.fold_volatility_regime(w.benchmark_regimes(r.benchmark_bars), folds)


@query("WIN18_benchmark_trend_volatility", f"SELECT session_date, trend, vol59 FROM ({REGIMES})", digits="trend vol59")
def _(r):
    return w.benchmark_regimes(r.benchmark_bars).select("session_date", "trend", "vol59")


TWO = """
    SELECT security_id, max(CASE WHEN pos = 1 THEN session_date END) AS latest_session, max(CASE WHEN pos = 1 THEN close END) AS latest_close,
           max(CASE WHEN pos = 2 THEN close END) AS previous_close
    FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY session_date DESC) AS pos FROM bars) WHERE pos <= 2 GROUP BY 1"""


@query("WIN19_latest_two_closes", TWO, digits="latest_close:8 previous_close:8")
def _(r):
    return w.latest_two_closes(r.bars)


@query("WIN20_stock_at_a_glance", f"""
    WITH s AS (SELECT security_id, arg_max(value, row(period_end, available_at, accession)) AS shares FROM facts WHERE concept = 'EntityCommonStockSharesOutstanding' GROUP BY 1)
    SELECT security_id, latest_session, latest_close, latest_close / previous_close - 1 AS change, latest_close * shares AS market_value
    FROM ({TWO}) LEFT JOIN s USING (security_id)""", digits="latest_close:8 change market_value:2")
def _(r):
    return w.at_a_glance(w.latest_two_closes(r.bars), r.facts.where("concept = 'EntityCommonStockSharesOutstanding'"))


@query("WIN21_missed_formations", """
    WITH runs AS (SELECT DISTINCT session_date AS score_date FROM sessions WHERE month(session_date) % 7 <> 0),
    c AS (SELECT session_date AS formation_date, next_session AS execution_date FROM sessions
          WHERE date_trunc('month', session_date) < date_trunc('month', next_session) AND next_session < DATE '2001-06-01')
    SELECT formation_date, execution_date, CASE WHEN formation_date IN (SELECT score_date FROM runs) THEN 'execution_window_missed' ELSE 'month_end_score_unavailable' END AS reason_code
    FROM c WHERE year(formation_date) % 2 = 1""")
def _(r):
    done = r.sessions.select(F.col("session_date").alias("score_date"), F.when(F.month("session_date") % 7 == 0, "failed").otherwise("completed").alias("status"))
    portfolios = r.sessions.where(F.year("session_date") % 2 == 0).select(F.col("session_date").alias("formation_date"))
    return w.missed_formations(r.sessions, done, portfolios, F.expr("DATE '2001-06-01'"))


@query("WIN22_month_end_formations", """
    SELECT 'month' AS rule, strftime(day, '%Y-%m') AS bucket, max(day) AS formation_date FROM (SELECT DISTINCT ship_day AS day FROM trades) GROUP BY 2
    UNION ALL SELECT 'week', isoyear(day) || '-' || lpad(CAST(weekofyear(day) AS VARCHAR), 2, '0'), max(day) FROM (SELECT DISTINCT ship_day AS day FROM trades) GROUP BY 2""")
def _(r):
    days = r.trades.select(F.col("ship_day").alias("session_date")).distinct()
    return w.last_session_per(days, "month").select(F.lit("month").alias("rule"), "*").unionByName(
        w.last_session_per(days, "week").select(F.lit("week").alias("rule"), "*"))
