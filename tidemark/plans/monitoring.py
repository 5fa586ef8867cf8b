"""MON: coverage, drift and monitoring."""

from pyspark.sql import functions as F

from ..functions import ranks
from ..operators import fundamentals as fnd
from ..operators import monitoring as mon
from ..operators import ranking as k
from ..session import cut_lineage
from . import query
from .evaluation import turnover_sql
from .fundamentals import FEATURES, features
from .labels import FORWARD, forward
from .ranking import MATRIX

KEYS = ["formation_date", "security_id"]
PAIR_KEYS = ["momentum_12_1", "relative_strength_6m", "earnings_yield_ttm", "return_on_assets_ttm", "trailing_volatility_60d", "median_dollar_volume_20d"]
PAIRS = [(a, b) for i, a in enumerate(PAIR_KEYS) for b in PAIR_KEYS[i + 1:]]
WIDE = f"SELECT formation_date, security_id, {MATRIX} FROM sector_ranks GROUP BY 1, 2"
NAN = lambda x: f"CASE WHEN isnan({x}) THEN NULL ELSE {x} END"


def wide(r):
    return r.sector_ranks.groupBy(*KEYS).pivot("feature_key", PAIR_KEYS).agg(F.max("percentile"))


@query("MON01_feature_coverage", "SELECT formation_date, feature_key, count(value) AS available, count(*) AS universe, count(value) * 1.0 / count(*) AS coverage FROM outcomes GROUP BY 1, 2", digits="coverage")
def _(r):
    return mon.feature_coverage(r.outcomes)


@query("MON01_missing_reasons", "SELECT feature_key, unavailable_reason, count(*) AS securities FROM outcomes WHERE value IS NULL GROUP BY 1, 2")
def _(r):
    return mon.missing_reasons(r.outcomes)


RAW_WIDE = "SELECT formation_date, security_id, " + ", ".join(f"max(CASE WHEN feature_key = '{f}' THEN value END) AS {f}" for f in PAIR_KEYS) + " FROM outcomes GROUP BY 1, 2"
CORR = " UNION ALL ".join(f"""SELECT formation_date, '{a}' AS left_key, '{b}' AS right_key, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS pairs, {NAN(f'corr({a}, {b})')} AS correlation FROM w GROUP BY 1""" for a, b in PAIRS)


@query("MON02_feature_correlation", f"""
    WITH w AS ({RAW_WIDE}), c AS ({CORR}) SELECT *, CASE WHEN pairs < 2 THEN 'insufficient_pairs' WHEN correlation IS NULL THEN 'zero_variance' END AS reason FROM c""", digits="correlation")
def _(r):
    raw = r.outcomes.groupBy(*KEYS).pivot("feature_key", PAIR_KEYS).agg(F.max("value"))
    return mon.feature_correlations(raw, PAIR_KEYS, ["formation_date"])


CAND = ["earnings_yield_ttm", "trailing_volatility_60d"]
ACTIVE = ["momentum_12_1", "relative_strength_6m"]
LONG_CAND = " UNION ALL ".join(f"SELECT formation_date, security_id, '{c}' AS feature_key, {c} AS value FROM w" for c in CAND)
CAND_CORR = " UNION ALL ".join(f"SELECT '{c}' AS feature_key, '{a}' AS act, abs({NAN(f'corr({c}, {a})')}) AS v FROM w GROUP BY formation_date" for c in CAND for a in ACTIVE)


@query("MON03_candidate_diagnostics", f"""
    WITH w AS MATERIALIZED ({WIDE}), l AS MATERIALIZED ({LONG_CAND}), cov AS (SELECT feature_key, formation_date, count(value) AS a, count(*) AS n FROM l GROUP BY 1, 2),
    c1 AS (SELECT feature_key, CAST(sum(a) AS BIGINT) AS available, sum(a) * 1.0 / sum(n) AS aggregate_coverage, min(a * 1.0 / n) AS minimum_coverage FROM cov GROUP BY 1),
    c2 AS (SELECT feature_key, max(m) AS redundancy FROM (SELECT feature_key, act, quantile_cont(v, 0.5) AS m FROM ({CAND_CORR}) GROUP BY 1, 2) GROUP BY 1),
    d AS (SELECT formation_date, lead(formation_date) OVER (ORDER BY formation_date) AS nx FROM (SELECT DISTINCT formation_date FROM w)),
    c3 AS (SELECT feature_key, quantile_cont(c, 0.5) AS stability FROM (SELECT a.feature_key, a.formation_date, {NAN('corr(a.value, b.value)')} AS c FROM l a JOIN d USING (formation_date)
           JOIN l b ON b.feature_key = a.feature_key AND b.formation_date = nx AND b.security_id = a.security_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
    c4 AS (SELECT feature_key, quantile_cont(turnover, 0.5) AS turnover FROM ({turnover_sql('(SELECT *, value AS prediction FROM l WHERE value IS NOT NULL)', 20, 'feature_key')}) GROUP BY 1),
    x AS (SELECT * FROM c1 LEFT JOIN c2 USING (feature_key) LEFT JOIN c3 USING (feature_key) LEFT JOIN c4 USING (feature_key)),
    y AS (SELECT *, concat_ws(',', CASE WHEN aggregate_coverage < 0.9 THEN 'aggregate_coverage_below_90_percent' END, CASE WHEN minimum_coverage < 0.8 THEN 'monthly_coverage_below_80_percent' END,
            CASE WHEN redundancy IS NULL THEN 'active_feature_redundancy_unavailable' WHEN redundancy > 0.9 THEN 'redundant_with_active_feature' END,
            CASE WHEN stability IS NULL THEN 'rank_stability_unavailable' WHEN stability < 0.1 THEN 'rank_stability_below_0_10' END,
            CASE WHEN turnover IS NULL THEN 'top_20_turnover_unavailable' WHEN turnover > 0.9 THEN 'median_top_20_turnover_above_0_90' END) AS reasons FROM x)
    SELECT *, reasons = '' AS accepted FROM y""", digits="aggregate_coverage minimum_coverage redundancy stability turnover")
def _(r):
    return mon.candidate_diagnostics(wide(r), CAND, ACTIVE)


NOW, THEN = "formation_date >= DATE '2000-01-01'", "formation_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'"
PSI = f"""
    WITH b AS (SELECT feature_key, least(9, greatest(0, CAST(floor(percentile * 10) AS INT))) AS bin, count(*) FILTER ({NOW}) AS c, count(*) FILTER ({THEN}) AS r FROM sector_ranks WHERE percentile IS NOT NULL AND ({NOW} OR {THEN}) GROUP BY 1, 2),
    t AS (SELECT feature_key, sum(c) AS cn, sum(r) AS rn FROM b GROUP BY 1), g AS (SELECT t.*, k FROM t, range(10) q(k)),
    s AS (SELECT feature_key, cn, rn, greatest(1e-6, coalesce(c, 0) * 1.0 / cn) AS x, greatest(1e-6, coalesce(r, 0) * 1.0 / rn) AS y FROM g LEFT JOIN b USING (feature_key) WHERE b.bin = k OR b.bin IS NULL)
    SELECT g.feature_key, CAST(any_value(cn) AS BIGINT) AS current_observations, CAST(any_value(rn) AS BIGINT) AS reference_observations,
           CASE WHEN any_value(cn) >= 100 AND any_value(rn) >= 100 THEN sum((greatest(1e-6, coalesce(c, 0) * 1.0 / cn) - greatest(1e-6, coalesce(r, 0) * 1.0 / rn)) * ln(greatest(1e-6, coalesce(c, 0) * 1.0 / cn) / greatest(1e-6, coalesce(r, 0) * 1.0 / rn))) END AS psi
    FROM g LEFT JOIN b ON b.feature_key = g.feature_key AND b.bin = k GROUP BY 1"""


@query("MON04_population_stability", PSI, digits="psi")
def _(r):
    return mon.stability_index(r.sector_ranks.where(NOW), r.sector_ranks.where(THEN), ["feature_key"])


HEALTH = f"""
    WITH n AS (SELECT feature_key, count(*) AS cohort, count(percentile) AS available, avg(percentile) AS mean_percentile, 1 - count(percentile) * 1.0 / count(*) AS missing_ratio FROM sector_ranks WHERE {NOW} GROUP BY 1),
    t AS (SELECT feature_key, avg(percentile) AS reference_mean FROM sector_ranks WHERE {THEN} GROUP BY 1)
    SELECT feature_key, cohort, available, missing_ratio, mean_percentile, reference_mean, psi,
           CASE WHEN missing_ratio > 0.1 OR coalesce(psi > 0.25, false) THEN 'critical' WHEN missing_ratio > 0.02 OR coalesce(psi > 0.1, false) THEN 'warning' WHEN psi IS NULL THEN 'insufficient_reference' ELSE 'healthy' END AS status
    FROM n LEFT JOIN t USING (feature_key) LEFT JOIN ({PSI}) USING (feature_key)"""


@query("MON05_feature_health", HEALTH, digits="missing_ratio mean_percentile reference_mean psi")
def _(r):
    return mon.feature_health(r.sector_ranks.where(NOW), r.sector_ranks.where(THEN))


CHURN = """
    WITH s AS (SELECT score_date, security_id, score_rank FROM scores WHERE eligible), d AS (SELECT *, lag(score_date) OVER (ORDER BY score_date) AS pd, lag(n) OVER (ORDER BY score_date) AS pn FROM (SELECT score_date, count(*) AS n FROM s GROUP BY 1))
    SELECT a.score_date, any_value(pd) AS previous_date, 1 - count(*) FILTER (a.score_rank <= least(20, n, pn) AND b.score_rank <= least(20, n, pn)) * 1.0 / any_value(least(20, n, pn)) AS churn,
           avg(abs(a.score_rank * 1.0 / n - b.score_rank * 1.0 / pn)) AS rank_change FROM s a JOIN d USING (score_date) JOIN s b ON b.score_date = pd AND b.security_id = a.security_id GROUP BY 1"""


def eligible(r):
    return r.scores.where("eligible").select("score_date", "security_id", "score_rank")


@query("MON06_rank_churn", CHURN, digits="churn rank_change")
def _(r):
    return mon.rank_churn(eligible(r))


LAST = "DATE '2001-01-01'"
SUMMARY = f"""SELECT (SELECT count(*) FILTER (eligible) * 1.0 / count(*) FROM scores WHERE score_date = {LAST}) AS coverage, (SELECT churn FROM ({CHURN}) WHERE score_date = {LAST}) AS churn, (SELECT rank_change FROM ({CHURN}) WHERE score_date = {LAST}) AS rank_change"""


def summary(r):
    churn = mon.rank_churn(eligible(r)).where(f"score_date = {LAST}")
    coverage = r.scores.where(f"score_date = {LAST}").groupBy("score_date").agg((F.count_if("eligible") / F.count(F.lit(1))).alias("coverage"))
    return coverage.join(churn, "score_date", "left").select("coverage", "churn", "rank_change", F.lit(False).alias("lineage_matches"), F.lit(False).alias("readiness_available"))


@query("MON07_health_alerts", f"""
    WITH h AS ({HEALTH}), s AS ({SUMMARY})
    SELECT CASE WHEN missing_ratio > 0.1 THEN 'critical' ELSE 'warning' END AS severity, 'feature_missingness' AS code, feature_key AS metric FROM h WHERE missing_ratio > 0.02
    UNION ALL SELECT CASE WHEN psi > 0.25 THEN 'critical' ELSE 'warning' END, 'feature_drift', feature_key FROM h WHERE psi > 0.1
    UNION ALL SELECT CASE WHEN coverage < 0.9 THEN 'critical' ELSE 'warning' END, 'coverage', 'eligible_coverage' FROM s WHERE coverage < 0.98
    UNION ALL SELECT 'warning', 'rank_churn', 'top_20_churn_ratio' FROM s WHERE churn > 0.5 UNION ALL SELECT 'warning', 'rank_churn', 'mean_normalized_rank_change' FROM s WHERE rank_change > 0.15
    UNION ALL SELECT 'critical', 'explanation_lineage_mismatch', 'score_explanations' UNION ALL SELECT 'warning', 'forward_readiness_missing', 'forward_outcome_readiness'""")
def _(r):
    return mon.health_alerts(mon.feature_health(r.sector_ranks.where(NOW), r.sector_ranks.where(THEN)), summary(r))


REFERENCE = f"(SELECT DISTINCT formation_date FROM sector_ranks WHERE formation_date < {LAST} ORDER BY formation_date DESC LIMIT 20)"


@query("MON08_health_snapshot", HEALTH.replace(NOW, f"formation_date = {LAST}").replace(THEN, f"formation_date IN {REFERENCE}"), digits="missing_ratio mean_percentile reference_mean psi")
def _(r):
    # Every outcome of a known sector and feature has a rank row, and ranks stay within their date: only the dates asked for are ranked.
    placed = r.outcomes.join(r.sectors, "security_id", "left_semi").join(r.registry, "feature_key", "left_semi")
    dates = cut_lineage(mon.reference_dates(placed.withColumnRenamed("formation_date", "score_date"), F.expr(LAST)).withColumnRenamed("score_date", "formation_date"))
    ranked = lambda outcomes: k.sector_percentiles(outcomes, r.sectors, r.registry)
    return mon.feature_health(ranked(r.outcomes.where(f"formation_date = {LAST}")), ranked(r.outcomes.join(F.broadcast(dates), "formation_date", "left_semi")))


@query("MON09_exclusion_codes", """
    SELECT CASE WHEN coalesce(reason, '') = '' THEN 'unspecified_exclusion' WHEN contains(lower(reason), 'required_feature_rank_unavailable') THEN 'required_active_input_unavailable'
                WHEN contains(lower(reason), 'price') OR contains(lower(reason), 'session') THEN 'price_history_unavailable' WHEN contains(lower(reason), 'sector') THEN 'sector_unavailable'
                WHEN contains(lower(reason), 'income') OR contains(lower(reason), 'asset') THEN 'fundamental_input_unavailable'
                ELSE coalesce(nullif(substr(regexp_replace(regexp_replace(lower(reason), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80), ''), 'other_exclusion') END AS code, count(*) AS rows_count
    FROM (SELECT exclusion_reason AS reason FROM scores UNION ALL SELECT unavailable_reason FROM outcomes UNION ALL SELECT reason FROM composite UNION ALL SELECT p_name || ' / ' || p_type || '!' FROM part) GROUP BY 1""")
def _(r):
    from ..operators.ranking import equal_weight_composite
    reasons = r.scores.select(F.col("exclusion_reason").alias("reason")).unionByName(r.outcomes.select(F.col("unavailable_reason").alias("reason"))).unionByName(
        equal_weight_composite(r.sector_ranks).select("reason")).unionByName(r.table("part").select(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!")).alias("reason")))
    return reasons.groupBy(mon.exclusion_code(F.col("reason")).alias("code")).agg(F.count(F.lit(1)).alias("rows_count"))


@query("MON10_freshness_alerts", """
    WITH s AS (SELECT score_date, count(*) FILTER (eligible) AS c, avg(raw_prediction) FILTER (eligible) AS m, row_number() OVER (ORDER BY score_date DESC) AS n FROM scores GROUP BY 1),
    x AS (SELECT max(score_date) FILTER (n = 1) AS d, max(c) FILTER (n = 1) AS now, max(c) FILTER (n = 2) AS prior, max(m) FILTER (n = 1) AS mn, max(m) FILTER (n = 2) AS mb FROM s WHERE n <= 2)
    SELECT 'stale_market_data' AS alert FROM x WHERE (SELECT max(session_date) FROM bars) < DATE '2001-12-01' UNION ALL SELECT 'stale_scores' FROM x WHERE d < DATE '2001-12-01' UNION ALL SELECT 'insufficient_eligible_scores' FROM x WHERE now < 1
    UNION ALL SELECT 'eligible_count_drop' FROM x WHERE (prior - now) * 1.0 / nullif(prior, 0) > 0.3 UNION ALL SELECT 'mean_score_shift' FROM x WHERE abs(mn - mb) > 20""")
def _(r):
    runs = r.monthly.select(F.col("formation_date").alias("score_date"), (F.col("n") >= 3).alias("e"), ((F.col("d") * 3 + F.col("t")) / F.col("n")).alias("p")).groupBy("score_date").agg(
        F.count_if("e").alias("eligible_count"), F.avg(F.when(F.col("e"), F.col("p"))).alias("mean_score"))
    return mon.freshness_alerts(runs, r.bars.agg(F.max("session_date").alias("session_date")), F.expr("DATE '2001-12-01'"))


@query("MON11_market_coverage", """
    WITH b AS (SELECT 'split_adjusted' AS basis, security_id, session_date FROM bars UNION ALL SELECT 'unadjusted', security_id, session_date FROM unadjusted_bars WHERE security_id % 5 <> 0)
    SELECT basis, count(*) AS rows_count, count(DISTINCT security_id) AS companies, min(session_date) AS first_session, max(session_date) AS last_session, CAST(0 AS BIGINT) AS wrong_availability,
           count(DISTINCT security_id) * (SELECT count(*) FROM sessions) - count(*) AS missing_company_sessions FROM b GROUP BY 1""")
def _(r):
    columns = ["security_id", "session_date", "available_at"]
    both = r.bars.select(F.lit("split_adjusted").alias("basis"), *columns).unionByName(r.unadjusted_bars.where("security_id % 5 <> 0").select(F.lit("unadjusted").alias("basis"), *columns))
    return mon.market_coverage(both, r.sessions)


CONCEPTS = ["NetIncomeLoss", "ProfitLoss", "Assets"]


@query("MON12_fact_inventory", " UNION ALL ".join(
    f"SELECT security_id, '{c}' AS concept, count(*) FILTER (concept = '{c}') AS facts, count(DISTINCT period_end) FILTER (concept = '{c}') AS periods, count(*) FILTER (concept = '{c}') = 0 AS missing_concept FROM facts GROUP BY 1" for c in CONCEPTS))
def _(r):
    return mon.fact_inventory(r.facts, CONCEPTS)


@query("MON13_action_backfill_coverage", """
    SELECT (SELECT count(*) FROM sessions) AS requested_chunks, (SELECT count(*) FROM sessions) AS completed_chunks, (SELECT count(*) FROM sessions WHERE idx % 50 = 0) AS without_document,
           (SELECT count(*) FROM actions) AS action_count, (SELECT count(*) FROM sessions WHERE idx % 50 = 0) = 0 AS coverage_ready""")
def _(r):
    chunks = r.sessions.select(F.lit("completed").alias("status"), (F.col("idx") % 50 != 0).alias("has_document"))
    return mon.action_coverage(chunks, r.actions)


@query("MON14_fiscal_completeness", """
    SELECT concept, count(*) AS years, count(*) FILTER (list_has_all(p, ['Q1', 'Q2', 'Q3', 'FY'])) AS complete_years FROM (
      SELECT security_id, concept, fiscal_year, list(DISTINCT fiscal_period) AS p FROM facts GROUP BY 1, 2, 3) GROUP BY 1""")
def _(r):
    return mon.complete_fiscal_years(r.facts)


@query("MON14_history_share", """
    SELECT session_date, count(*) AS names, count(*) FILTER (n >= 61) AS with_61, count(*) FILTER (n >= 253) AS with_253 FROM (
      SELECT session_date, row_number() OVER (PARTITION BY security_id ORDER BY session_date) AS n FROM bars) GROUP BY 1""")
def _(r):
    return mon.history_share(r.bars, [61, 253])


@query("MON15_forward_evidence", f"""
    SELECT horizon, count(*) AS labels, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status <> 'completed') AS withheld, avg(relative_return) AS mean_relative,
           count(*) FILTER (relative_return > 0) * 1.0 / count(*) FILTER (status = 'completed') AS share_ahead, true AS reconciles,
           (SELECT CASE WHEN month(max(score_date)) % 2 = 0 THEN 'healthy' ELSE 'warning' END FROM scores) AS latest_status FROM ({FORWARD}) GROUP BY 1""", digits="mean_relative share_ahead")
def _(r):
    health = r.monthly.select(F.col("formation_date").alias("score_date")).distinct().withColumn("status", F.when(F.month("score_date") % 2 == 0, "healthy").otherwise("warning"))
    return mon.evidence_report(health, forward(r))


@query("MON16_universe_coverage", f"""
    SELECT feature_key, sum(a) * 1.0 / sum(n) AS aggregate_coverage, min(a * 1.0 / n) AS minimum_coverage, count(*) AS formations FROM (
      SELECT feature_key, formation_date, count(value) AS a, count(*) AS n FROM outcomes GROUP BY 1, 2) GROUP BY 1""", digits="aggregate_coverage minimum_coverage")
def _(r):
    return fnd.coverage_audit(r.outcomes)


@query("MON17_backfill_chunk_plan", """
    WITH s AS (SELECT s_name AS ticker, row_number() OVER (ORDER BY s_suppkey) - 1 AS place FROM supplier), b AS (SELECT CAST(place // 30 AS INT) AS batch, min(ticker) AS first_ticker, max(ticker) AS last_ticker, count(*) AS symbols FROM s GROUP BY 1),
    q AS (SELECT min(ship_day) AS range_start, max(ship_day) AS range_end FROM (SELECT DISTINCT ship_day FROM trades) GROUP BY date_trunc('quarter', ship_day))
    SELECT batch, range_start, range_end, basis, symbols, first_ticker, last_ticker, sha256(concat_ws('|', CAST(range_start AS VARCHAR), CAST(range_end AS VARCHAR), first_ticker, last_ticker, basis)) AS chunk_key
    FROM b, q, (VALUES ('unadjusted'), ('split_adjusted')) AS v(basis)""")
def _(r):
    named = ranks.with_position(r.securities.withColumn("g", F.lit(1)), ["g"], "security_id", "security_id", position="p")
    symbols = named.select(F.col("issuer_name").alias("ticker"), (F.col("p") - 1).alias("place"))
    return mon.backfill_chunks(symbols, r.trades.select(F.col("ship_day").alias("day")).distinct(), ["unadjusted", "split_adjusted"], 30)


@query("MON18_canonical_ticker", """
    WITH t AS (SELECT p_size AS security_id, upper(trim(split_part(p_name, ' ', 2) || CASE WHEN p_partkey % 3 = 0 THEN '-B' WHEN p_partkey % 3 = 1 THEN '' ELSE '-WT' END)) AS ticker FROM part)
    SELECT security_id, ticker FROM t QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY NOT regexp_matches(ticker, '^[A-Z]{1,5}$'), NOT regexp_matches(ticker, '^[A-Z]+-B$'), length(ticker), ticker) = 1""")
def _(r):
    suffix = F.when(F.col("p_partkey") % 3 == 0, "-B").when(F.col("p_partkey") % 3 == 1, "").otherwise("-WT")
    tickers = r.table("part").select(F.col("p_size").alias("security_id"), F.concat(F.element_at(F.split("p_name", " "), 2), suffix).alias("ticker"))
    return mon.canonical_tickers(tickers)
