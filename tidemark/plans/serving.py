"""SRV, SET and SCL: read models, set operations and scalar functions."""

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions.asof import latest_per_key
from ..operators import joins as j
from ..operators import monitoring as mon
from ..operators import ranking as k
from ..operators import serving as s
from . import query
from .joins import RUNS, runs
from .labels import DIFFERENCES, FORWARD, differences, forward
from .monitoring import HEALTH, NOW, THEN

DAY = "DATE '1999-07-01'"


def completed_runs(r):
    return runs(r)


def deployments(r):
    """A deployment log: the fixture model is the newest of its family."""
    return r.sessions.select(
        F.col("session_date").alias("deployed_at"), F.concat(F.lit("family_"), (F.col("idx") % 3).cast("string")).alias("model_family"),
        F.when(F.col("next_session").isNull(), "linear_fixture_v1").otherwise(F.concat(F.lit("v"), F.col("idx").cast("string"))).alias("model_version"))


@query("SRV01_dated_scores", f"""
    SELECT s.security_id, s.score_date, eligible, score, score_rank, raw_prediction, coalesce(v.ticker, o.ticker) AS ticker FROM scores s JOIN ({RUNS}) r USING (score_date)
    LEFT JOIN listings v ON v.security_id = s.security_id AND v.valid_from <= s.score_date AND (v.valid_to IS NULL OR s.score_date < v.valid_to)
    LEFT JOIN listings o ON o.security_id = s.security_id AND o.valid_to IS NULL WHERE score_date = {DAY.replace('07', '08')} AND status = 'completed'""", digits="score raw_prediction")
def _(r):
    out = s.dated_scores(r.scores, runs(r), r.listings, deployments(r), F.expr(DAY.replace("07", "08")))
    return out.select("security_id", "score_date", "eligible", "score", "score_rank", "raw_prediction", "ticker")


@query("SRV02_score_history", f"SELECT score_date, score, score_rank FROM scores WHERE security_id = 7 AND eligible AND score_date <= {DAY} ORDER BY score_date DESC LIMIT 24", digits="score")
def _(r):
    return s.score_history(r.scores, 7, F.expr(DAY), 24).select("score_date", "score", "score_rank")


@query("SRV03_previous_dated_scores", f"SELECT security_id, score_date, score FROM scores WHERE score_date = (SELECT max(score_date) FROM ({RUNS}) WHERE status = 'completed' AND score_date < {DAY})", digits="score")
def _(r):
    return s.scores_before(r.scores, runs(r), F.expr(DAY)).select("security_id", "score_date", "score")


@query("SRV04_recent_runs", f"SELECT score_date, status FROM ({RUNS}) WHERE status = 'completed' ORDER BY score_date DESC LIMIT 10")
def _(r):
    return s.recent_runs(runs(r), 10)


@query("SRV05_filing_summary", f"""
    WITH f AS (SELECT DISTINCT accession, security_id, form, CAST(timezone('America/Toronto', timezone('UTC', accepted_at)) AS DATE) AS d FROM facts)
    SELECT form, count(*) AS filings, count(DISTINCT security_id) AS companies FROM f WHERE d <= DATE '1998-08-20' AND d > (SELECT max(score_date) FROM ({RUNS}) WHERE status = 'completed' AND score_date < DATE '1998-08-20') GROUP BY 1""")
def _(r):
    filings = r.facts.select("accession", "security_id", "form", "accepted_at").distinct()
    return s.filings_since(filings, runs(r), F.expr("DATE '1998-08-20'"))


@query("SRV06_operations_history", """
    WITH x AS (SELECT user_id AS run_id, event_id, event_type FROM events), z AS (SELECT run_id, coalesce(max(event_id) FILTER (event_type = 'purchase'), -1) AS r FROM x GROUP BY 1)
    SELECT run_id, arg_max(event_type, event_id) AS last_event_type, count(*) AS events, count(*) FILTER (event_type = 'error') AS warnings, count(*) FILTER (event_type = 'error' AND event_id > r) AS unresolved_warnings
    FROM x JOIN z USING (run_id) GROUP BY 1""")
def _(r):
    return s.operations_history(r.table("events").select(F.col("user_id").alias("run_id"), "event_id", "event_type"), "error", "purchase")


@query("SRV07_price_history", "SELECT session_date, close FROM bars WHERE security_id = 7 ORDER BY session_date DESC LIMIT 90", digits="close:8")
def _(r):
    return s.price_history(r.bars, 7, 90)


@query("SRV08_security_search", """
    SELECT security_id, issuer_name, ticker FROM securities JOIN listings USING (security_id) WHERE valid_to IS NULL AND (ticker ILIKE '%kr1%' OR issuer_name ILIKE '%kr1%')
    ORDER BY CASE WHEN ticker ILIKE 'kr1%' THEN 0 ELSE 1 END, ticker LIMIT 12""")
def _(r):
    return s.search(r.securities, r.listings, "kr1")


@query("SRV09_score_explanations", f"""
    SELECT feature_key, feature_version, direction, coefficient * (percentile - mean) / scale AS contribution FROM sector_ranks JOIN model_inputs USING (feature_key) JOIN registry USING (feature_key, feature_version)
    WHERE coefficient <> 0 AND security_id = 7 AND formation_date = {DAY}""", digits="contribution")
def _(r):
    return s.explanations(k.model_contributions(r.sector_ranks, r.model_inputs), r.registry, 7, F.expr(DAY)).select("feature_key", "feature_version", "direction", "contribution")


@query("SRV10_latest_deployment", """
    SELECT 'family_' || (idx % 3) AS model_family, max(session_date) AS deployed_at, arg_max(CASE WHEN next_session IS NULL THEN 'linear_fixture_v1' ELSE 'v' || idx END, session_date) AS model_version FROM sessions GROUP BY 1""")
def _(r):
    return s.latest_deployment(deployments(r))


@query("SRV11_latest_health", f"""
    SELECT severity, code, metric, CASE severity WHEN 'critical' THEN 0 ELSE 1 END AS severity_order FROM (
      SELECT CASE WHEN missing_ratio > 0.1 THEN 'critical' ELSE 'warning' END AS severity, 'feature_missingness' AS code, feature_key AS metric FROM ({HEALTH}) WHERE missing_ratio > 0.02
      UNION ALL SELECT 'critical', 'explanation_lineage_mismatch', 'score_explanations')""")
def _(r):
    features = mon.feature_health(r.sector_ranks.where(NOW), r.sector_ranks.where(THEN)).withColumn("psi", F.lit(None).cast("double"))
    summary = r.sessions.agg(F.lit(1.0).alias("coverage"), F.lit(0.0).alias("churn"), F.lit(0.0).alias("rank_change"), F.lit(False).alias("lineage_matches"), F.lit(True).alias("readiness_available"))
    return s.sorted_alerts(mon.health_alerts(features, summary))


@query("SET01_union_all", "SELECT concept, count(*) AS rows_count FROM (SELECT concept FROM facts UNION ALL SELECT concept FROM observations) GROUP BY 1")
def _(r):
    return j.fact_candidates(r.facts, r.observations).groupBy("concept").agg(F.count(F.lit(1)).alias("rows_count"))


@query("SET02_union_distinct", "SELECT security_id FROM bars UNION SELECT security_id FROM facts UNION SELECT security_id FROM observations UNION SELECT security_id FROM sectors")
def _(r):
    return s.distinct_inputs(*[f.select("security_id") for f in (r.bars, r.facts, r.observations, r.sectors)])


@query("SET03_difference_intersection", """
    SELECT 'only_filers' AS side, security_id FROM (SELECT security_id FROM facts EXCEPT SELECT security_id FROM observations) UNION ALL
    SELECT 'both', security_id FROM (SELECT security_id FROM facts INTERSECT SELECT security_id FROM observations)""")
def _(r):
    filers, watched = r.facts.select("security_id").distinct(), r.observations.select("security_id").distinct()
    only = filers.join(watched, "security_id", "left_anti").select(F.lit("only_filers").alias("side"), "security_id")
    return only.unionByName(filers.join(watched, "security_id", "left_semi").select(F.lit("both").alias("side"), "security_id"))


@query("SET04_distinct_on", "SELECT DISTINCT ON (security_id, concept) security_id, concept, period_end, value, lineage_key FROM observations ORDER BY security_id, concept, period_end DESC, observed_at DESC, lineage_key DESC", digits="value")
def _(r):
    return s.latest_row(r.observations, ["security_id", "concept"], ["period_end", "observed_at", "lineage_key"]).select("security_id", "concept", "period_end", "value", "lineage_key")


@query("SET05_top_outliers", f"SELECT formation_date, security_id FROM ({DIFFERENCES}) WHERE difference IS NOT NULL ORDER BY round(difference, 9) DESC, formation_date, security_id LIMIT 5")
def _(r):
    return differences(r).where("difference IS NOT NULL").orderBy(F.round("difference", 9).desc(), "formation_date", "security_id").limit(5).select("formation_date", "security_id")


@query("SET06_offset_limit", "SELECT a.session_date, b.session_date AS nth_session FROM sessions a JOIN sessions b ON b.idx = a.idx + 7")
def _(r):
    return s.nth_session(r.sessions, 7)


@query("SET07_conditional_distinct", f"SELECT horizon, count(DISTINCT score_date) FILTER (status = 'completed') AS dates, count(*) FILTER (status = 'withheld') AS withheld FROM ({FORWARD}) GROUP BY 1")
def _(r):
    done = F.when(F.col("status") == "completed", F.col("score_date"))
    return forward(r).groupBy("horizon").agg(F.count_distinct(done).alias("dates"), F.count_if(F.col("status") == "withheld").alias("withheld"))


@query("SET08_having_complete", "SELECT security_id, formation_date, count(*) AS members FROM outcomes WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 6")
def _(r):
    return s.complete_sets(r.outcomes.where("value IS NOT NULL"), ["security_id", "formation_date"], 6)


@query("SET09_array_containment", """
    SELECT security_id, fiscal_year, list_has_all(list(DISTINCT fiscal_period), ['Q1', 'Q2', 'Q3', 'FY']) AS complete FROM facts GROUP BY 1, 2""")
def _(r):
    wanted = F.array(*[F.lit(x) for x in ("Q1", "Q2", "Q3", "FY")])
    return r.facts.groupBy("security_id", "fiscal_year").agg((F.size(F.array_intersect(F.collect_set("fiscal_period"), wanted)) == 4).alias("complete"))


@query("SCL01_arithmetic", """
    SELECT l_orderkey, l_linenumber, ln(l_extendedprice) AS log_price, exp(l_discount) AS growth, sqrt(l_quantity) AS root, greatest(least(l_tax - 0.04, 0.02), -0.02) AS clipped, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS thousands,
           round_even(l_quantity / 8, 1) AS half_even FROM lineitem""", digits="log_price growth root clipped half_even")
def _(r):
    return r.table("lineitem").select(
        "l_orderkey", "l_linenumber", F.ln("l_extendedprice").alias("log_price"), F.exp("l_discount").alias("growth"), F.sqrt("l_quantity").alias("root"),
        F.greatest(F.least(F.col("l_tax") - 0.04, F.lit(0.02)), F.lit(-0.02)).alias("clipped"), F.floor(F.col("l_extendedprice") / 1000).alias("thousands"),
        F.bround(F.col("l_quantity") / 8, 1).alias("half_even"))


@query("SCL02_dates_and_zones", """
    SELECT ship_day, strftime(timezone('UTC', timezone('America/Toronto', CAST(ship_day AS TIMESTAMP) + INTERVAL 20 HOUR)), '%Y-%m-%d %H:%M') AS decision_utc, isoyear(ship_day) AS iso_year, weekofyear(ship_day) AS iso_week,
           strftime(ship_day, '%Y-%m') AS month_key, CAST(last_day(ship_day) AS DATE) AS month_end, date_diff('day', DATE '1995-01-01', ship_day) AS days FROM (SELECT DISTINCT ship_day FROM trades)""")
def _(r):
    day = F.col("ship_day")
    return r.trades.select("ship_day").distinct().select(
        day, F.date_format(sc.decision_at(day), "yyyy-MM-dd HH:mm").alias("decision_utc"), F.extract(F.lit("YEAROFWEEK"), day).cast("long").alias("iso_year"),
        F.weekofyear(day).alias("iso_week"), F.date_format(day, "yyyy-MM").alias("month_key"), F.last_day(day).alias("month_end"), F.datediff(day, F.lit("1995-01-01")).alias("days"))


@query("SCL03_availability", """
    SELECT event_id, strftime(accepted_at + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') AS buffered, strftime(greatest(accepted_at + INTERVAL 5 MINUTE, observed_at), '%Y-%m-%d %H:%M:%S') AS observed FROM observations""")
def _(r):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    accepted, observed = F.col("accepted_at"), F.col("observed_at")
    return r.observations.select("event_id", text(sc.filing_available_at(accepted)).alias("buffered"), text(sc.observed_available_at(accepted, observed)).alias("observed"))


@query("SCL04_strings", """
    SELECT s_suppkey, upper(replace(trim(s_name), '#', '.')) AS upper_name, translate(upper(' brk.b' || s_suppkey), '.', '-') AS ticker, lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, s_name ILIKE '%00007%' AS contains_seven,
           starts_with(s_name, 'Supplier') AS prefixed, regexp_replace(s_name, '[0-9]+$', '') AS stem FROM supplier""")
def _(r):
    name = F.col("s_name")
    return r.table("supplier").select(
        "s_suppkey", F.upper(F.replace(F.trim(name), F.lit("#"), F.lit("."))).alias("upper_name"), F.upper(F.translate(F.concat(F.lit(" brk.b"), F.col("s_suppkey").cast("string")), ".", "-")).alias("ticker"),
        sc.padded_cik(F.col("s_suppkey")).alias("cik"), name.ilike("%00007%").alias("contains_seven"), name.startswith("Supplier").alias("prefixed"), F.regexp_replace(name, "[0-9]+$", "").alias("stem"))


@query("SCL05_json", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '"}') AS content_hash FROM events""")
def _(r):
    return r.table("events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), sc.canonical_json_hash(F.col("event_id"), F.col("event_type")).alias("content_hash"))


@query("SCL06_arrays_and_maps", """
    SELECT security_id, fiscal_year, count(DISTINCT concept) AS concepts, string_agg(DISTINCT concept, ',' ORDER BY concept) AS concept_list, max(value) FILTER (concept = 'Assets') AS assets FROM facts GROUP BY 1, 2""", digits="assets:4")
def _(r):
    largest = r.facts.groupBy("security_id", "fiscal_year", "concept").agg(F.max("value").alias("value"))
    maps = largest.groupBy("security_id", "fiscal_year").agg(F.map_from_entries(F.collect_list(F.struct("concept", "value"))).alias("values"))
    names = F.array_sort(F.map_keys("values"))
    return maps.select("security_id", "fiscal_year", F.size(names).cast("long").alias("concepts"), F.array_join(names, ",").alias("concept_list"), F.col("values")["Assets"].alias("assets"))


@query("SCL07_identity_hash", "SELECT event_id, sha256(concat_ws('|', CAST(security_id AS VARCHAR), concept, CAST(period_end AS VARCHAR), '')) AS identity FROM observations")
def _(r):
    return r.observations.select("event_id", sc.identity_hash(F.col("security_id"), F.col("concept"), F.col("period_end"), F.lit(None)).alias("identity"))
