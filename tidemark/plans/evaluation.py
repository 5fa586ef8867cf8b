"""EVL: evaluation."""

from pyspark.sql import functions as F

from ..operators import evaluation as e
from ..operators import modelling as m
from ..operators import windows as w
from ..session import cut_lineage
from . import query
from .modelling import FEATURES, TRAIN, long_coefficients, nested, ridge_sql
from .windows import REGIMES

P = "predictions"
AVG_RANK = lambda v, p: f"(rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0)"
FLAT = lambda x: f"coalesce(CASE WHEN isnan({x}) THEN 0 ELSE {x} END, 0)"


def ic_sql(source: str = P, left: str = "prediction", right: str = "actual", name: str = "rank_ic") -> str:
    g = "model_key, formation_date"
    return f"""SELECT {g}, {FLAT('corr(l, r)')} AS {name}, count(*) AS pairs FROM (SELECT {g}, {AVG_RANK(left, g)} AS l, {AVG_RANK(right, g)} AS r FROM {source}) GROUP BY model_key, formation_date"""


SPREAD = f"""
    SELECT model_key, formation_date, avg(actual) FILTER (p > n - greatest(1, n // 10)) - avg(actual) FILTER (p <= greatest(1, n // 10)) AS spread FROM (
      SELECT *, row_number() OVER (PARTITION BY model_key, formation_date ORDER BY prediction, security_id) AS p, count(*) OVER (PARTITION BY model_key, formation_date) AS n FROM {P}) GROUP BY 1, 2"""


@query("EVL01_rank_ic", ic_sql(), digits="rank_ic")
def _(r):
    return e.spearman(r.predictions, e.DATE, "prediction", "actual")


@query("EVL02_pearson", f"SELECT model_key, formation_date, {FLAT('corr(prediction, actual)')} AS ic, count(*) AS pairs FROM {P} GROUP BY 1, 2", digits="ic")
def _(r):
    return e.pearson(r.predictions, e.DATE, "prediction", "actual", "ic")


@query("EVL03_monthly_rank_ic", f"""
    SELECT model_key, avg(v) AS monthly_rank_ic, count(*) AS months FROM (SELECT model_key, date_trunc('month', formation_date) AS mo, avg(rank_ic) AS v FROM ({ic_sql()}) GROUP BY 1, 2) GROUP BY 1""", digits="monthly_rank_ic")
def _(r):
    return e.monthly_mean(e.spearman(r.predictions, e.DATE, "prediction", "actual"), "rank_ic")


@query("EVL04_decile_spread", SPREAD, digits="spread:9")
def _(r):
    return e.decile_spread(r.predictions)


@query("EVL05_decile_report", f"""
    SELECT model_key, CAST(least(10, (p - 1) * 10 // n + 1) AS INT) AS decile, count(*) AS rows_count, avg(prediction) AS mean_prediction, avg(actual) AS mean_actual FROM (
      SELECT *, row_number() OVER (PARTITION BY model_key, formation_date ORDER BY prediction, security_id) AS p, count(*) OVER (PARTITION BY model_key, formation_date) AS n FROM {P}) GROUP BY 1, 2""",
       digits="mean_prediction mean_actual")
def _(r):
    return e.decile_report(r.predictions)


@query("EVL06_error_metrics", f"""
    SELECT model_key, outer_fold, sqrt(avg(pow(prediction - actual, 2))) AS rmse, avg(abs(prediction - actual)) AS mae, avg(prediction - actual) AS bias, count(*) FILTER (sign(prediction) = sign(actual)) * 1.0 / count(*) AS directional_accuracy,
           regr_slope(actual, prediction) AS slope, regr_intercept(actual, prediction) AS intercept, max(prediction) - min(prediction) AS prediction_range FROM {P} GROUP BY 1, 2""",
       digits="rmse mae bias directional_accuracy slope intercept prediction_range")
def _(r):
    return e.error_metrics(r.predictions, ["model_key", "outer_fold"])


STABILITY = f"""
    SELECT model_key, avg(stability) AS mean_stability, count(*) AS transitions FROM ({ic_sql(f'''(
      WITH d AS (SELECT model_key, formation_date, lead(formation_date) OVER (PARTITION BY model_key ORDER BY formation_date) AS nx FROM (SELECT DISTINCT model_key, formation_date FROM {P}))
      SELECT a.model_key, a.formation_date, a.prediction, b.prediction AS later FROM {P} a JOIN d USING (model_key, formation_date) JOIN {P} b ON b.model_key = a.model_key AND b.formation_date = nx AND b.security_id = a.security_id)''', 'prediction', 'later', 'stability')})
    WHERE pairs >= {{minimum}} GROUP BY 1"""


def turnover_sql(source: str, size: int, keys: str = "model_key") -> str:
    return f"""
    SELECT {keys}, formation_date, 1 - kept * 1.0 / selected AS turnover FROM (
      WITH t AS (SELECT {keys}, formation_date, security_id FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys}, formation_date ORDER BY prediction DESC, security_id) <= {size}),
      d AS (SELECT *, lag(formation_date) OVER (PARTITION BY {keys} ORDER BY formation_date) AS pd FROM (SELECT {keys}, formation_date, count(*) AS selected FROM t GROUP BY ALL)),
      b AS (SELECT d.{keys}, d.formation_date, d.selected, o.security_id FROM d JOIN t o ON o.{keys} = d.{keys} AND o.formation_date = d.pd)
      SELECT d.{keys}, d.formation_date, d.selected, (SELECT count(*) FROM b JOIN t ON t.{keys} = b.{keys} AND t.formation_date = b.formation_date AND t.security_id = b.security_id
             WHERE b.{keys} = d.{keys} AND b.formation_date = d.formation_date) AS kept FROM d WHERE pd IS NOT NULL)"""


MONTH_ENDS = f"(SELECT * FROM {P} WHERE (model_key, formation_date) IN (SELECT (model_key, max(formation_date)) FROM {P} GROUP BY model_key, date_trunc('month', formation_date)))"
MONTHLY = f"""
    SELECT model_key, formation_date, count(*) AS names, avg(actual) AS mean_actual, count(*) FILTER (actual > 0) * 1.0 / count(*) AS share_ahead FROM (
      SELECT * FROM {MONTH_ENDS} QUALIFY row_number() OVER (PARTITION BY model_key, formation_date ORDER BY prediction DESC, security_id) <= 20) GROUP BY 1, 2"""
BUNDLE = f"""
    SELECT i.model_key, mean_ic, positive_share, mean_spread, mean_stability, transitions, monthly_turnover, monthly_gross, mae, rmse, monthly_gross - monthly_turnover * 25 / 10000 AS monthly_net FROM
      (SELECT model_key, avg(rank_ic) AS mean_ic, count(*) FILTER (rank_ic > 0) * 1.0 / count(*) AS positive_share FROM ({ic_sql()}) GROUP BY 1) i
      JOIN (SELECT model_key, avg(spread) AS mean_spread FROM ({SPREAD}) GROUP BY 1) s USING (model_key) LEFT JOIN ({STABILITY.format(minimum=20)}) t USING (model_key)
      JOIN (SELECT model_key, avg(turnover) AS monthly_turnover FROM ({turnover_sql(MONTH_ENDS, 20)}) GROUP BY 1) u USING (model_key) JOIN (SELECT model_key, avg(mean_actual) AS monthly_gross FROM ({MONTHLY}) GROUP BY 1) g USING (model_key)
      JOIN (SELECT model_key, avg(abs(prediction - actual)) AS mae, sqrt(avg(pow(prediction - actual, 2))) AS rmse FROM {P} GROUP BY 1) x USING (model_key)"""
BUNDLE_DIGITS = "mean_ic positive_share mean_spread mean_stability monthly_turnover monthly_gross mae rmse monthly_net"


@query("EVL07_model_metrics_bundle", BUNDLE, digits=BUNDLE_DIGITS)
def _(r):
    return e.metrics_bundle(r.predictions)


@query("EVL08_rank_stability", STABILITY.format(minimum=5), digits="mean_stability")
def _(r):
    return e.rank_stability(r.predictions, 5)


@query("EVL09_top_turnover", turnover_sql(P, 20), digits="turnover")
def _(r):
    return e.top_turnover(r.predictions, 20)


@query("EVL10_monthly_formation_report", MONTHLY, digits="mean_actual share_ahead")
def _(r):
    return e.monthly_formation_report(r.predictions)


@query("EVL11_full_diagnostics", f"""
    SELECT 'reference' AS model_key, * FROM (SELECT metric, value FROM (SELECT mean_ic, positive_share, mean_spread, monthly_turnover, mae, rmse FROM ({BUNDLE}) WHERE model_key = 'reference')
    UNPIVOT (value FOR metric IN (mean_ic, positive_share, mean_spread, monthly_turnover, mae, rmse)))""", digits="value")
def _(r):
    bundle = e.metrics_bundle(r.predictions.where("model_key = 'reference'"))
    return bundle.unpivot(["model_key"], ["mean_ic", "positive_share", "mean_spread", "monthly_turnover", "mae", "rmse"], "metric", "value")


DELTAS = f"""SELECT mo AS month, max(v) FILTER (model_key = 'candidate') - max(v) FILTER (model_key = 'reference') AS delta FROM (
    SELECT model_key, CAST(date_trunc('month', formation_date) AS DATE) AS mo, avg(rank_ic) AS v FROM ({ic_sql()}) GROUP BY 1, 2) GROUP BY 1"""
MIX = "(((x % 2147483647) * 48271 % 2147483647) * 69621 % 2147483647)"


def bootstrap_sql(deltas: str, seed: int, resamples: int) -> str:
    return f"""
    WITH s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY month) - 1 AS i, delta, count(*) OVER () AS n FROM ({deltas})), z AS (SELECT max(n) AS n FROM s),
    d AS (SELECT b, k, n, CAST(b AS BIGINT) * 1000003 + (k // 3) * 7919 + {seed} AS x FROM range({resamples}) r(b), z, range((SELECT max(n) FROM s)) q(k)),
    mm AS (SELECT b, avg(delta) AS mean FROM (SELECT b, ({MIX} % n + k % 3) % n AS i FROM d) JOIN s USING (i) GROUP BY 1)
    SELECT avg(mean) AS bootstrap_mean, count(*) FILTER (mean > 0) * 1.0 / count(*) AS probability_positive, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM mm"""


SIMPLE_DELTAS = f"SELECT month, avg(actual) - avg(prediction) AS delta FROM {P} WHERE model_key = 'reference' GROUP BY 1"


@query("EVL12_moving_block_bootstrap", bootstrap_sql(SIMPLE_DELTAS, 20240101, 10000), digits="bootstrap_mean probability_positive low high")
def _(r):
    deltas = r.predictions.where("model_key = 'reference'").groupBy("month").agg((F.avg("actual") - F.avg("prediction")).alias("delta"))
    return e.moving_block_bootstrap(deltas, 20240101)


@query("EVL13_coefficient_sign_stability", f"""
    SELECT feature_key, count(*) AS folds, greatest(count(*) FILTER (coefficient > 0), count(*) FILTER (coefficient < 0)) AS consistent
    FROM ({long_coefficients(ridge_sql(TRAIN, '0.1', 'outer_fold'), 'outer_fold')}) GROUP BY 1""")
def _(r):
    train = m.fold_rows(r.examples, nested(r), "train")
    return e.sign_stability(m.fit(train, FEATURES, 0.0, 0.1, keys=["outer_fold"]), ["feature_key"])


@query("EVL14_portfolio_gate_metrics", f"""
    WITH n AS (SELECT model_key, formation_date, coalesce(turnover, 1.0) AS turnover, mean_actual - coalesce(turnover, 1.0) * 25 / 10000 AS net FROM ({MONTHLY}) LEFT JOIN ({turnover_sql(MONTH_ENDS, 20)}) USING (model_key, formation_date)),
    p AS (SELECT formation_date, max(net) FILTER (model_key = 'candidate') - max(net) FILTER (model_key = 'reference') AS d, max(turnover) FILTER (model_key = 'candidate') - max(turnover) FILTER (model_key = 'reference') AS t FROM n GROUP BY 1)
    SELECT year(formation_date) AS block, count(d) AS months, avg(d) AS mean_net_delta, avg(t) AS mean_turnover_delta FROM p GROUP BY 1""", digits="mean_net_delta mean_turnover_delta")
def _(r):
    return e.portfolio_gate(r.predictions)


@query("EVL15_regime_diagnostics", f"""
    WITH d AS (SELECT model_key, formation_date, rank_ic, spread, coalesce(regime, 'unavailable') AS regime FROM ({ic_sql()}) JOIN ({SPREAD}) USING (model_key, formation_date) LEFT JOIN (SELECT session_date AS formation_date, regime FROM ({REGIMES})) USING (formation_date))
    SELECT model_key, regime, count(*) AS formations, avg(rank_ic) AS mean_ic, avg(spread) AS mean_spread, count(*) * 1.0 / any_value(t) AS share FROM d JOIN (SELECT model_key, count(*) AS t FROM d GROUP BY 1) USING (model_key) GROUP BY 1, 2""",
       digits="mean_ic mean_spread share")
def _(r):
    rows = cut_lineage(r.predictions.select(*e.DATE, "security_id", "prediction", "actual"))
    daily = e.spearman(rows, e.DATE, "prediction", "actual").join(e.decile_spread(rows), e.DATE)
    regimes = w.benchmark_regimes(r.benchmark_bars).select(F.col("session_date").alias("formation_date"), "regime")
    return e.regime_diagnostics(daily, regimes)


@query("EVL16_segment_error_analysis", f"""
    WITH b AS (SELECT prediction, actual, sector_code, market_trend FROM {P} JOIN sectors USING (security_id) JOIN (SELECT session_date AS formation_date, market_trend FROM ({REGIMES})) USING (formation_date) WHERE model_key = 'candidate'),
    l AS (SELECT 'sector_code' AS dimension, sector_code AS segment, prediction, actual FROM b UNION ALL SELECT 'market_trend', market_trend, prediction, actual FROM b)
    SELECT dimension, segment, count(*) AS observations, avg(abs(prediction - actual)) AS mae, avg(prediction - actual) AS bias, CASE WHEN count(*) >= 5 THEN {FLAT('corr(prediction, actual)')} END AS correlation,
           avg(abs(prediction - actual)) - (SELECT avg(abs(prediction - actual)) FROM b) AS mae_delta FROM l GROUP BY 1, 2""", digits="mae bias correlation mae_delta")
def _(r):
    trend = w.benchmark_regimes(r.benchmark_bars).select(F.col("session_date").alias("formation_date"), "market_trend")
    rows = r.predictions.where("model_key = 'candidate'").join(r.sectors, "security_id").join(trend, "formation_date")
    return e.segment_analysis(rows, ["sector_code", "market_trend"])


PAIR_KEYS = ["momentum_12_1", "relative_strength_6m", "earnings_yield_ttm", "return_on_assets_ttm", "trailing_volatility_60d", "median_dollar_volume_20d"]
PAIRS = [(a, b) for i, a in enumerate(PAIR_KEYS) for b in PAIR_KEYS[i + 1:]]
WIDE_VALUES = "SELECT formation_date, security_id, " + ", ".join(f"max(CASE WHEN feature_key = '{f}' THEN value END) AS {f}" for f in PAIR_KEYS) + " FROM outcomes GROUP BY 1, 2"


@query("EVL17_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS left_key, '{b}' AS right_key, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS pairs, corr({a}, {b}) AS correlation, coalesce(abs(corr({a}, {b})) >= 0.95, false) AS redundant FROM ({WIDE_VALUES})" for a, b in PAIRS),
       digits="correlation")
def _(r):
    wide = r.outcomes.groupBy("formation_date", "security_id").pivot("feature_key", PAIR_KEYS).agg(F.max("value"))
    return e.correlation_matrix(wide, PAIR_KEYS)


GATES = "('mean_ic', 'at_least', -1.0), ('monthly_turnover', 'at_most', 0.5), ('rmse', 'at_most', 10.0), ('unknown', 'at_least', 0.0)"


@query("EVL18_gate_table", f"""
    WITH g AS (SELECT * FROM (VALUES {GATES}) AS v(metric, comparison, threshold)), mt AS (SELECT 'mean_ic' AS metric, avg(rank_ic) AS value FROM ({ic_sql()}) WHERE model_key = 'candidate'
      UNION ALL SELECT 'rmse', sqrt(avg(pow(prediction - actual, 2))) FROM {P} WHERE model_key = 'candidate' UNION ALL SELECT 'monthly_turnover', avg(turnover) FROM ({turnover_sql(MONTH_ENDS, 20)}) WHERE model_key = 'candidate'),
    x AS (SELECT g.*, value, coalesce(CASE comparison WHEN 'at_least' THEN value >= threshold ELSE value <= threshold END, false) AS passed FROM g LEFT JOIN mt USING (metric))
    SELECT *, CASE WHEN (SELECT bool_and(passed) FROM x) THEN 'freeze' ELSE 'no_freeze' END AS decision FROM x""", digits="threshold value")
def _(r):
    candidate = r.predictions.where("model_key = 'candidate'")
    ic = e.spearman(candidate, e.DATE, "prediction", "actual").agg(F.avg("rank_ic").alias("value")).select(F.lit("mean_ic").alias("metric"), "value")
    rmse = e.error_metrics(candidate, ["model_key"]).select(F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    churn = e.top_turnover(e.last_of_month(candidate), 20).agg(F.avg("turnover").alias("value")).select(F.lit("monthly_turnover").alias("metric"), "value")
    gates = r.spark.sql(f"SELECT metric, comparison, CAST(threshold AS DOUBLE) AS threshold FROM VALUES {GATES} AS t(metric, comparison, threshold)")
    return e.gate_table(ic.unionByName(rmse).unionByName(churn), gates)


@query("EVL19_paired_summary", bootstrap_sql(DELTAS, 7, 10000), digits="bootstrap_mean probability_positive low high")
def _(r):
    return e.moving_block_bootstrap(e.paired_deltas(r.predictions), 7, 10000)
