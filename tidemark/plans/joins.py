"""JN: joins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.asof import latest_per_key
from ..functions.calendar import forward_sessions, label_windows
from ..functions.scalars import observed_available_at
from ..operators import joins as j
from . import query

DAY = "DATE '1999-07-01'"
OBSERVED = "greatest(accepted_at + INTERVAL 5 MINUTE, observed_at)"
RUNS = "SELECT DISTINCT score_date, CASE WHEN month(score_date) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM scores"
WINDOWS = """SELECT f.formation_date, a.session_date AS entry_date, b.session_date AS outcome_date, s.idx AS fidx
    FROM formations f JOIN sessions s ON s.session_date = f.formation_date
    JOIN sessions a ON a.idx = s.idx + 1 JOIN sessions b ON b.idx = s.idx + 21"""


def runs(r):
    status = F.when(F.month("score_date") % 7 == 0, "failed").otherwise("completed")
    return r.monthly.select(F.col("formation_date").alias("score_date")).distinct().withColumn("status", status)


def windows(r):
    return label_windows(r.sessions, r.formations)


def observed(r):
    return r.observations.withColumn("available_at", observed_available_at(F.col("accepted_at"), F.col("observed_at")))


FACT_KEY = ["security_id", "concept", "period_end"]


@query("JN01_fact_as_of", f"""
    SELECT d.formation_date, security_id, concept, period_end, value, lineage_key FROM observation_decisions d
    JOIN (SELECT *, {OBSERVED} AS available_at FROM observations) o ON o.available_at <= d.decision_at
    QUALIFY row_number() OVER (PARTITION BY d.formation_date, security_id, concept, period_end
                               ORDER BY available_at DESC, observed_at DESC, lineage_key DESC) = 1""", digits="value")
def _(r):
    out = j.facts_as_of_each(observed(r), FACT_KEY, r.observation_decisions, ["available_at", "observed_at", "lineage_key"])
    return out.select("formation_date", *FACT_KEY, "value", "lineage_key")


@query("JN02_fact_candidate_union", f"""
    SELECT concept, availability_rule, count(*) AS facts, count(DISTINCT security_id) AS holders,
           strftime(max(available_at), '%Y-%m-%d %H:%M') AS last_available FROM (
      SELECT security_id, concept, accepted_at + INTERVAL 5 MINUTE AS available_at, 'accepted_plus_buffer' AS availability_rule FROM facts
      UNION ALL SELECT security_id, concept, {OBSERVED}, 'max_accepted_plus_buffer_observed' FROM observations) GROUP BY 1, 2""")
def _(r):
    return j.fact_candidates(r.facts, r.observations).groupBy("concept", "availability_rule").agg(
        F.count(F.lit(1)).alias("facts"), F.count_distinct("security_id").alias("holders"),
        F.date_format(F.max("available_at"), "yyyy-MM-dd HH:mm").alias("last_available"))


@query("JN03_as_of_sweep", """
    SELECT f.formation_date, security_id, concept, period_end, value FROM formations f
    JOIN facts x ON greatest(x.available_at, timezone('UTC', timezone('America/Toronto', CAST(x.period_end AS TIMESTAMP)))) <= f.decision_at
    QUALIFY row_number() OVER (PARTITION BY f.formation_date, security_id, concept ORDER BY period_end DESC, available_at DESC, accession DESC) = 1""",
       digits="value:4")
def _(r):
    midnight = F.to_utc_timestamp(F.col("period_end").cast("timestamp"), "America/Toronto")
    facts = r.facts.withColumn("eligible_at", F.greatest("available_at", midnight))
    out = j.facts_as_of_each(facts, ["security_id", "concept"], r.formations, ["period_end", "available_at", "accession"], at="eligible_at")
    return out.select("formation_date", "security_id", "concept", "period_end", "value")


@query("JN04_latest_claim", """
    SELECT f.formation_date, security_id, sector_code FROM formations f
    JOIN sector_claims c ON c.as_of_date <= f.formation_date AND c.available_at <= f.decision_at
    QUALIFY row_number() OVER (PARTITION BY f.formation_date, security_id ORDER BY as_of_date DESC, available_at DESC) = 1""")
def _(r):
    return j.latest_claim(r.sector_claims, r.formations).select("formation_date", "security_id", "sector_code")


@query("JN05_latest_universe", f"""
    SELECT security_id, formation_date AS as_of_date FROM monthly
    WHERE formation_date = (SELECT max(formation_date) FROM monthly WHERE formation_date <= {DAY})""")
def _(r):
    members = r.monthly.select("security_id", F.col("formation_date").alias("as_of_date"))
    return j.latest_snapshot_members(members.select("as_of_date"), members, F.expr(DAY))


@query("JN06_listing_on_date", """
    SELECT b.security_id, b.session_date, coalesce(v.ticker, o.ticker) AS ticker, v.ticker IS NOT NULL AS valid_on_day
    FROM (SELECT security_id, session_date FROM bars) b
    LEFT JOIN listings v ON v.security_id = b.security_id AND v.valid_from <= b.session_date AND (v.valid_to IS NULL OR b.session_date < v.valid_to) AND v.security_id % 3 <> 0
    LEFT JOIN listings o ON o.security_id = b.security_id AND o.valid_to IS NULL""")
def _(r):
    listings = r.listings.where("security_id % 3 <> 0 OR valid_to IS NULL").withColumn(
        "valid_from", F.when(F.col("security_id") % 3 == 0, F.lit("2030-01-01").cast("date")).otherwise(F.col("valid_from")))
    return j.listing_on(r.bars.select("security_id", "session_date"), listings, "session_date")


@query("JN07_lateral_ticker", """
    SELECT s.security_id, s.score_date, coalesce(l.ticker, 'Unavailable') AS ticker FROM scores s
    LEFT JOIN LATERAL (SELECT ticker FROM listings l WHERE l.security_id = s.security_id AND l.valid_from <= s.score_date
                       AND l.security_id % 5 <> 0 ORDER BY valid_from DESC LIMIT 1) l ON true""")
def _(r):
    rows = r.monthly.select("security_id", F.col("formation_date").alias("score_date"))
    return j.latest_ticker(rows, r.listings.where("security_id % 5 <> 0"), "score_date")


@query("JN08_next_session", """
    SELECT day, min(session_date) AS following_session FROM (SELECT DISTINCT ship_day AS day FROM trades) JOIN sessions ON session_date > day GROUP BY day""")
def _(r):
    return j.next_session(r.trades.select(F.col("ship_day").alias("day")).distinct(), r.sessions)


@query("JN09_forward_session", f"""
    SELECT f.session_date AS formation_date, a.session_date AS entry_date, b.session_date AS outcome_date
    FROM sessions f JOIN sessions a ON a.idx = f.idx + 1 JOIN sessions b ON b.idx = f.idx + 21 WHERE b.session_date < DATE '2001-01-01'""")
def _(r):
    return forward_sessions(r.sessions, {"entry_date": 1, "outcome_date": 21}).where("outcome_date < DATE '2001-01-01'")


@query("JN10_outcome_offset", """
    SELECT f.formation_date, x.session_date AS execution_date, h AS horizon, c.session_date AS checkpoint_date
    FROM formations f JOIN sessions s ON s.session_date = f.formation_date JOIN sessions x ON x.idx = s.idx + 1,
         (VALUES (5), (20), (60)) AS v(h) JOIN sessions c ON c.idx = x.idx + h - 1""")
def _(r):
    execs = r.formations.join(r.sessions.select(F.col("session_date").alias("formation_date"), F.col("next_session").alias("execution_date")), "formation_date")
    return j.outcome_offsets(execs.select("formation_date", "execution_date").where("execution_date IS NOT NULL"), r.sessions, [5, 20, 60])


@query("JN11_actions_in_window", f"""
    SELECT w.formation_date, a.security_id, a.action_id, a.action_type FROM ({WINDOWS}) w
    JOIN actions a ON coalesce(a.effective_date, a.process_date) > w.entry_date AND coalesce(a.effective_date, a.process_date) <= w.outcome_date""")
def _(r):
    return j.actions_in_windows(r.actions, r.sessions, windows(r)).select("formation_date", "security_id", "action_id", "action_type")


@query("JN12_price_path", f"""
    SELECT w.formation_date, b.security_id, count(*) AS marks, count(*) = 21 AS complete_path FROM ({WINDOWS}) w
    JOIN dense_bars b ON b.session_date BETWEEN w.entry_date AND w.outcome_date GROUP BY 1, 2""")
def _(r):
    path = j.price_paths(r.dense_bars, r.sessions, windows(r), "unadjusted_open")
    return path.groupBy("formation_date", "security_id").agg(F.count(F.lit(1)).alias("marks")).withColumn("complete_path", F.col("marks") == 21)


@query("JN13_benchmark_alignment", """
    SELECT security_id, session_date, lag(idx, 126) OVER (PARTITION BY security_id ORDER BY session_date) = idx - 126 AS aligned
    FROM dense_bars JOIN sessions USING (session_date)""")
def _(r):
    return j.benchmark_alignment(r.dense_bars, r.sessions).drop("idx")


@query("JN14_two_basis_bars", """
    SELECT a.security_id, count(*) AS pairs, sum(CASE WHEN u.close = a.close THEN 1 ELSE 0 END) AS same_close,
           max(u.close / a.close) AS largest_ratio
    FROM bars a JOIN unadjusted_bars u USING (security_id, session_date) GROUP BY 1""", digits="largest_ratio")
def _(r):
    unadjusted = r.unadjusted_bars.select("security_id", "session_date", F.col("close").alias("raw_close"))
    both = r.bars.select("security_id", "session_date", "close").join(unadjusted, ["security_id", "session_date"])
    return both.groupBy("security_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("raw_close") == F.col("close")).alias("same_close"),
        F.max(F.col("raw_close") / F.col("close")).alias("largest_ratio"))


@query("JN15_paired_sample", """
    SELECT c.formation_date, c.security_id, c.actual IS NOT DISTINCT FROM r.actual AND c.outer_fold = r.outer_fold AS evidence_matches,
           c.prediction AS candidate, r.prediction AS reference
    FROM predictions c JOIN predictions r USING (formation_date, security_id)
    WHERE c.model_key = 'candidate' AND r.model_key = 'reference' AND r.security_id % 4 <> 1""", digits="candidate:9 reference:9")
def _(r):
    candidate = r.predictions.where("model_key = 'candidate'")
    reference = r.predictions.where("model_key = 'reference' AND security_id % 4 <> 1")
    return j.paired_rows(candidate, reference, ["formation_date", "security_id"], ["actual", "outer_fold"])


@query("JN16_common_sample", """
    WITH p AS (SELECT * FROM predictions WHERE NOT (model_key = 'candidate' AND security_id % 3 = 1))
    SELECT model_key, formation_date, security_id FROM p
    WHERE (formation_date, security_id) IN (SELECT (formation_date, security_id) FROM p GROUP BY formation_date, security_id HAVING count(DISTINCT model_key) = 2)""")
def _(r):
    p = r.predictions.where("NOT (model_key = 'candidate' AND security_id % 3 = 1)")
    return j.common_sample(p, ["formation_date", "security_id"], 2).select("model_key", "formation_date", "security_id")


@query("JN17_completed_runs", f"""
    SELECT score_date, count(*) AS snapshots FROM scores JOIN ({RUNS}) USING (score_date) WHERE status = 'completed' GROUP BY 1""")
def _(r):
    return j.completed_snapshots(r.scores, runs(r)).groupBy("score_date").agg(F.count(F.lit(1)).alias("snapshots"))


@query("JN18_due_unlabelled", """
    SELECT s.security_id, s.score_date FROM scores s
    WHERE eligible AND security_id % 3 <> 0 AND (SELECT count(*) FROM sessions x WHERE x.session_date > s.score_date) >= 20""")
def _(r):
    base = r.monthly.select("security_id", F.col("formation_date").alias("score_date"), (F.col("n") >= 3).alias("eligible"))
    labelled = base.where("security_id % 3 = 0").select("security_id", "score_date", F.lit(20).alias("horizon"))
    return j.due_unlabelled(base, labelled, r.sessions, 20).select("security_id", "score_date")


@query("JN19_previous_scored_date", f"""
    SELECT max(score_date) AS previous_date FROM ({RUNS}) WHERE status = 'completed' AND score_date < {DAY}""")
def _(r):
    scored = r.monthly.select(F.col("formation_date").alias("score_date"))
    return j.previous_scored_date(runs(r), scored, F.expr(DAY))


@query("JN20_weight_turnover", """
    WITH w AS (SELECT score_date, security_id, 0.05 AS weight FROM scores WHERE score_rank <= 20),
    d AS (SELECT score_date, lead(score_date) OVER (ORDER BY score_date) AS next_date FROM (SELECT DISTINCT score_date FROM w)),
    p AS (SELECT next_date AS score_date, security_id, weight AS pw FROM w JOIN d USING (score_date) WHERE next_date IS NOT NULL)
    SELECT score_date, sum(abs(coalesce(weight, 0) - coalesce(pw, 0))) / 2 AS one_way_turnover FROM w FULL JOIN p USING (score_date, security_id) GROUP BY 1""",
       digits="one_way_turnover")
def _(r):
    weights = r.scores.where("score_rank <= 20").select("score_date", "security_id", F.lit(0.05).alias("weight"))
    return j.weight_turnover(weights)


@query("JN21_dense_horizons", """
    WITH c AS (SELECT 5 AS horizon, count(*) AS completed FROM scores WHERE eligible UNION ALL SELECT 20, count(*) FROM scores WHERE NOT eligible)
    SELECT h AS horizon, coalesce(completed, 0) AS completed FROM (VALUES (5), (20), (60)) AS v(h) LEFT JOIN c ON c.horizon = h""")
def _(r):
    flags = r.monthly.select(F.when(F.col("n") >= 3, 5).otherwise(20).alias("horizon"))
    return j.dense_horizons(flags.groupBy("horizon").agg(F.count(F.lit(1)).alias("completed")), [5, 20, 60], ["completed"])


@query("JN22_orphan_explanations", """
    SELECT formation_date AS score_date, count(*) AS explanations,
           count(*) FILTER (feature_key NOT IN (SELECT feature_key FROM model_inputs WHERE coefficient <> 0)) AS orphans
    FROM outcomes WHERE value IS NOT NULL GROUP BY 1""")
def _(r):
    rows = r.outcomes.where("value IS NOT NULL").select(
        F.col("formation_date").alias("score_date"), F.concat("feature_key", F.lit("_percentile")).alias("feature_key"))
    return j.orphan_explanations(rows, r.model_inputs)


def two_books(r):
    """A provider book and a ledger that misses some bars, adds some and differs in some values."""
    columns = ["security_id", "session_date", "open", "high", "low", "close", "volume"]
    bars = r.bars.select(*columns)
    provider = bars.where("security_id % 5 <> 4")
    ledger = bars.where("NOT (security_id % 3 = 2 AND day(session_date) < 8)").withColumn(
        "close", F.when(F.col("volume") % 10 == 0, F.col("close") + 0.01).otherwise(F.col("close") + 1e-10)
    ).withColumn("volume", F.when(F.col("volume") % 17 == 0, F.col("volume") + 1).otherwise(F.col("volume")))
    return provider, ledger


BOOKS = """
    p AS (SELECT security_id, session_date, close, volume FROM bars WHERE security_id % 5 <> 4),
    l AS (SELECT security_id, session_date, CASE WHEN volume % 10 = 0 THEN close + 0.01 ELSE close + 1e-10 END AS close,
                 CASE WHEN volume % 17 = 0 THEN volume + 1 ELSE volume END AS volume FROM bars WHERE NOT (security_id % 3 = 2 AND day(session_date) < 8)),
    both_books AS (SELECT security_id, session_date,
                     CASE WHEN l.close IS NULL THEN 'missing_in_ledger' WHEN p.close IS NULL THEN 'missing_at_provider'
                          WHEN abs(p.close - l.close) > 1e-8 OR p.volume <> l.volume THEN 'value_mismatch' ELSE 'matched' END AS status
             FROM p FULL JOIN l USING (security_id, session_date))"""
TOLERANCES = {"open": 1e-8, "high": 1e-8, "low": 1e-8, "close": 1e-8, "volume": None}


@query("JN23_bar_reconciliation", f"""
    WITH {BOOKS} SELECT status, count(*) AS keys FROM both_books GROUP BY 1
    UNION ALL SELECT 'ledger_session_gap', (SELECT count(*) FROM securities) * (SELECT count(*) FROM sessions) - (SELECT count(*) FROM l)""")
def _(r):
    provider, ledger = two_books(r)
    counts = j.reconcile(provider, ledger, ["security_id", "session_date"], TOLERANCES).groupBy("status").agg(F.count(F.lit(1)).alias("keys"))
    gaps = j.session_gaps(ledger, r.securities.select("security_id"), r.sessions)
    return counts.unionByName(gaps.select(F.lit("ledger_session_gap").alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("keys")))


@query("JN23_bar_reconciliation_samples", f"""
    WITH {BOOKS} SELECT status, security_id, session_date FROM both_books WHERE status <> 'matched'
    QUALIFY row_number() OVER (PARTITION BY status ORDER BY security_id, session_date) <= 25""")
def _(r):
    keys = ["security_id", "session_date"]
    return j.status_samples(j.reconcile(*two_books(r), keys, TOLERANCES), keys, 25).select("status", *keys)


@query("JN24_action_reconciliation", """
    WITH p AS (SELECT * FROM actions WHERE security_id % 4 <> 1),
    l AS (SELECT security_id, action_id, action_type, effective_date, process_date + CASE WHEN security_id % 3 = 0 THEN 1 ELSE 0 END AS process_date, cash_amount FROM actions WHERE security_id % 5 <> 2)
    SELECT CASE WHEN l.action_id IS NULL THEN 'missing_in_ledger' WHEN p.action_id IS NULL THEN 'missing_at_provider'
                WHEN p.process_date <> l.process_date THEN 'value_mismatch' ELSE 'matched' END AS status, count(*) AS keys
    FROM p FULL JOIN l ON p.action_id = l.action_id GROUP BY 1""")
def _(r):
    provider = r.actions.where("security_id % 4 <> 1")
    ledger = r.actions.where("security_id % 5 <> 2").withColumn(
        "process_date", F.when(F.col("security_id") % 3 == 0, F.date_add("process_date", 1)).otherwise(F.col("process_date")))
    fields = dict.fromkeys(["action_type", "process_date", "effective_date", "cash_amount", "ratio_numerator", "ratio_denominator"])
    return j.reconcile(provider, ledger, ["action_id"], fields).groupBy("status").agg(F.count(F.lit(1)).alias("keys"))
