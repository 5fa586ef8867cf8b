"""RNK16, RNK17, WIN23: the score run and its replay."""

from pyspark.sql import functions as F

from ..oracles import sector_rank_sql
from ..operators import score_run as run
from . import query
from .fundamentals import ANNUAL, ROA, newest
from .windows import LOGS, OWN, feature_sql

AT = "WHERE session_date IN (SELECT formation_date FROM formations)"
MOM = feature_sql("v1", "lag(close, 21) OVER o / lag(close, 252) OVER o - 1", 253, "SELECT security_id, session_date, close FROM bars")
RS = feature_sql("v1", "(close / lag(close, 126) OVER o - 1) - (b / lag(b, 126) OVER o - 1)", 127, "SELECT x.security_id, x.session_date, x.close, m.close AS b FROM bars x JOIN benchmark_bars m USING (session_date)")
VOL = feature_sql("v1", f"stddev_samp(r) OVER ({OWN} ROWS 59 PRECEDING) * sqrt(252)", 61, LOGS)
LIQ = feature_sql("v1", "sorted[10] * 0.5 + sorted[11] * 0.5", 20, f"SELECT security_id, session_date, list_sort(list(close * volume) OVER ({OWN} ROWS 19 PRECEDING)) AS sorted FROM unadjusted_bars")


def part(key: str, sql: str) -> str:
    return f"SELECT session_date AS formation_date, security_id, '{key}' AS feature_key, round(v1, 12) AS value, v1_reason AS unavailable_reason FROM ({sql}) {AT}"


def fundamentals(key: str, value: str, reason: str) -> str:
    return f"""
    SELECT b.session_date AS formation_date, b.security_id, '{key}' AS feature_key, CASE WHEN {reason} IS NULL THEN round({value}, 12) END AS value, {reason} AS unavailable_reason
    FROM (SELECT * FROM bars {AT}) b LEFT JOIN ({ANNUAL}) a ON a.formation_date = b.session_date AND a.security_id = b.security_id
    LEFT JOIN ({newest('EntityCommonStockSharesOutstanding', 'shares')}) s ON s.formation_date = b.session_date AND s.security_id = b.security_id
    LEFT JOIN ({ROA}) q ON q.formation_date = b.session_date AND q.security_id = b.security_id"""


NO_INCOME = "CASE WHEN a.income IS NULL THEN 'missing_annual_income' END"
OUTCOMES = " UNION ALL ".join([
    part("momentum_12_1", MOM), part("relative_strength_6m", RS), part("trailing_volatility_60d", VOL), part("median_dollar_volume_20d", LIQ),
    fundamentals("earnings_yield_ttm", "a.income / (b.close * s.shares)", f"coalesce({NO_INCOME}, CASE WHEN s.shares IS NULL THEN 'missing_shares' END)"),
    fundamentals("return_on_assets_ttm", "q.return_on_assets_ttm", f"coalesce({NO_INCOME}, q.reason)"),
])
SCORES = f"""
    WITH run_outcomes AS MATERIALIZED ({OUTCOMES}), run_ranks AS ({sector_rank_sql('run_outcomes')}),
    c AS (SELECT formation_date, security_id, count(*) FILTER (percentile IS NULL) = 0 AS eligible, CASE WHEN count(*) FILTER (percentile IS NULL) = 0 THEN avg(percentile) END AS normalized_score,
                 'required_feature_rank_unavailable=' || string_agg(feature_key || '@' || feature_version || ':' || reason, ',' ORDER BY feature_key) FILTER (percentile IS NULL) AS reason FROM run_ranks GROUP BY 1, 2)
    SELECT c.*, normalized_score * 100 AS display_score, CASE WHEN eligible THEN row_number() OVER (PARTITION BY formation_date, eligible ORDER BY round(normalized_score, 10) DESC, security_id) END AS score_rank FROM c"""


def outcomes(r, formations=None):
    formations = r.formations if formations is None else formations
    market = run.market_cells(r.bars, r.unadjusted_bars, r.benchmark_bars, r.sessions, formations)
    return run.feature_outcomes(market, r.facts, formations)


@query("RNK16_score_run", SCORES, digits="normalized_score display_score")
def _(r):
    return run.score_run(outcomes(r), r.sectors, r.registry)


@query("RNK17_historical_replay", f"SELECT formation_date, count(*) AS universe, count(*) FILTER (eligible) AS eligible, avg(normalized_score) AS mean_score FROM ({SCORES}) WHERE month(formation_date) % 3 <> 0 GROUP BY 1", digits="mean_score")
def _(r):
    completed = r.formations.where("month(formation_date) % 3 = 0").select("formation_date")
    pending = run.pending_formations(r.formations, completed)
    scored = run.score_run(outcomes(r, pending), r.sectors, r.registry)
    return scored.groupBy("formation_date").agg(F.count(F.lit(1)).alias("universe"), F.count_if("eligible").alias("eligible"), F.avg("normalized_score").alias("mean_score"))


@query("WIN23_active_inputs", f"""
    SELECT l.session_date AS formation_date, l.security_id, l.v1 AS median_dollar_volume_20d, a.income, q.return_on_assets_ttm, c.sector_code FROM (SELECT * FROM ({LIQ}) {AT}) l
    LEFT JOIN ({ANNUAL}) a ON a.formation_date = l.session_date AND a.security_id = l.security_id LEFT JOIN ({ROA}) q ON q.formation_date = l.session_date AND q.security_id = l.security_id
    LEFT JOIN (SELECT security_id, arg_max(sector_code, as_of_date) AS sector_code FROM sector_claims GROUP BY 1) c ON c.security_id = l.security_id""",
       digits="median_dollar_volume_20d:8 income:4 return_on_assets_ttm")
def _(r):
    return run.active_inputs(r.unadjusted_bars, r.facts, r.sector_claims, r.formations)
