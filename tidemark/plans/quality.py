"""FLT: gates, quality reports and filters."""

from pyspark.sql import functions as F

from ..functions.scalars import decision_at
from ..operators import quality as q
from . import query

LATE = "TIMESTAMP '2000-01-01 00:00:00'"
DAY = "DATE '1998-06-08'"

DIRTY = f"""
    SELECT security_id, session_date, open, high, low, close, volume, available_at FROM bars WHERE security_id % 7 <> 6
    UNION ALL SELECT security_id, session_date, open, low, high, close, volume, available_at FROM bars WHERE security_id % 11 = 3 AND session_date = {DAY}
    UNION ALL SELECT security_id, session_date, open, high, low, close, -volume, available_at + INTERVAL 2 DAY FROM bars WHERE security_id % 13 = 4 AND session_date = {DAY}"""


def dirty_bars(r):
    """Bars with gaps, swapped ranges, negative volume and late copies on one session."""
    columns = ["security_id", "session_date", "open", "high", "low", "close", "volume", "available_at"]
    bars = r.bars.select(*columns)
    on_day = F.col("session_date") == F.expr(DAY)
    swapped = bars.where(on_day & (F.col("security_id") % 11 == 3)).select(
        "security_id", "session_date", "open", F.col("low").alias("high"), F.col("high").alias("low"), "close", "volume", "available_at")
    late = bars.where(on_day & (F.col("security_id") % 13 == 4)).withColumn("volume", -F.col("volume")).withColumn(
        "available_at", F.col("available_at") + F.expr("INTERVAL 2 DAYS"))
    return bars.where(F.col("security_id") % 7 != 6).unionByName(swapped).unionByName(late)


@query("FLT01_availability_gate", f"SELECT count(*) FILTER (available_at > {LATE}) AS violations, count(*) AS checked FROM bars")
def _(r):
    return q.availability_violations(r.bars, F.expr(LATE))


@query("FLT02_availability_filter", f"""
    SELECT security_id, count(*) AS bars, max(session_date) AS last_session FROM bars
    WHERE session_date <= {DAY} AND available_at <= TIMESTAMP '1998-06-08 12:00:00' GROUP BY security_id""")
def _(r):
    kept = q.available_history(r.bars, F.expr(DAY), F.expr("TIMESTAMP '1998-06-08 12:00:00'"))
    return kept.groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.max("session_date").alias("last_session"))


@query("FLT03_daily_bar_quality", f"""
    WITH dirty AS ({DIRTY}), day AS (SELECT * FROM dirty WHERE session_date = {DAY}),
    need AS (SELECT s.security_id, count(d.security_id) AS n FROM securities s LEFT JOIN day d USING (security_id) GROUP BY 1)
    SELECT security_id, 'invalid_bar_value' AS code FROM day WHERE least(open, high, low, close, volume) < 0
    UNION ALL SELECT security_id, 'invalid_ohlc_range' FROM day WHERE high < greatest(open, close) OR low > least(open, close)
    UNION ALL SELECT security_id, 'future_available_at' FROM day WHERE available_at > TIMESTAMP '1998-06-09 00:00:00'
    UNION ALL SELECT security_id, 'missing_daily_bar' FROM need WHERE n = 0
    UNION ALL SELECT security_id, 'duplicate_daily_bar' FROM need WHERE n > 1""")
def _(r):
    return q.daily_bar_quality(dirty_bars(r), r.securities.select("security_id"), F.expr(DAY), decision_at(F.expr(DAY)))


@query("FLT04_filing_fact_quality", f"""
    WITH i AS (SELECT security_id, count(*) - 1 AS repeats, count(*) FILTER (available_at > {LATE}) AS late
               FROM facts GROUP BY security_id, taxonomy, concept, period_end)
    SELECT * FROM (
      SELECT security_id, 'duplicate_filing_fact' AS code, CAST(sum(repeats) AS BIGINT) AS issues FROM i GROUP BY 1
      UNION ALL SELECT security_id, 'future_available_at', CAST(sum(late) AS BIGINT) FROM i GROUP BY 1) WHERE issues > 0""")
def _(r):
    return q.filing_fact_quality(r.facts, F.expr(LATE))


@query("FLT05_bar_constraints", f"""
    WITH dirty AS ({DIRTY})
    SELECT 'high_covers' AS constraint_name, count(*) FILTER (NOT high >= greatest(open, close, low)) AS violations FROM dirty
    UNION ALL SELECT 'low_covers', count(*) FILTER (NOT low <= least(open, close, high)) FROM dirty
    UNION ALL SELECT 'non_negative', count(*) FILTER (NOT (low >= 0 AND volume >= 0)) FROM dirty
    UNION ALL SELECT 'available_after_session', count(*) FILTER (NOT available_at >= CAST(session_date AS TIMESTAMP)) FROM dirty""")
def _(r):
    return q.constraint_report(dirty_bars(r), {
        "high_covers": F.col("high") >= F.greatest("open", "close", "low"),
        "low_covers": F.col("low") <= F.least("open", "close", "high"),
        "non_negative": (F.col("low") >= 0) & (F.col("volume") >= 0),
        "available_after_session": F.col("available_at") >= F.col("session_date").cast("timestamp"),
    })


@query("FLT06_research_form_scope", """
    SELECT canonical_form, is_amendment, count(*) AS filings FROM (
      SELECT DISTINCT accession, is_amendment, regexp_replace(upper(trim(form)), '/A$', '') AS canonical_form FROM facts)
    WHERE canonical_form IN ('10-K', '10-Q', '20-F', '40-F', '8-K') GROUP BY 1, 2""")
def _(r):
    filings = r.facts.select("accession", "is_amendment", "form").distinct()
    return q.research_forms(filings).groupBy("canonical_form", "is_amendment").agg(F.count(F.lit(1)).alias("filings"))


@query("FLT07_new_accessions", """
    SELECT DISTINCT accession, security_id FROM facts
    WHERE accession NOT IN (SELECT accession FROM facts WHERE fiscal_year < 1999)""")
def _(r):
    filings = r.facts.select("accession", "security_id", "fiscal_year")
    stored = filings.where("fiscal_year < 1999").select("accession")
    return q.new_filings(filings.select("accession", "security_id"), stored)


@query("FLT08_index_candidates", """
    SELECT security_id FROM securities WHERE security_id IN (
      SELECT security_id FROM facts WHERE CAST(accepted_at AS DATE) = DATE '1998-08-05' AND form IN ('10-K', '10-Q', '10-K/A'))""")
def _(r):
    index = r.facts.select("security_id", "form", F.to_date("accepted_at").alias("filed_on")).distinct()
    return q.index_candidates(r.securities.select("security_id"), index, F.expr("DATE '1998-08-05'"))


@query("FLT09_publication_calendar", """
    WITH days AS (SELECT DISTINCT ship_day AS day FROM trades),
    y AS (SELECT DISTINCT year(day) + o AS y FROM days, (VALUES (-1), (0), (1)) AS v(o)),
    fixed AS (SELECT make_date(y, m, d) AS h FROM y, (VALUES (1, 1), (6, 19), (7, 4), (11, 11), (12, 25)) AS v(m, d)),
    observed AS (SELECT CASE isodow(h) WHEN 6 THEN h - 1 WHEN 7 THEN h + 1 ELSE h END AS h FROM fixed),
    nth AS (SELECT make_date(y, m, 1) + CAST((w - isodow(make_date(y, m, 1)) + 7) % 7 + (n - 1) * 7 AS INT) AS h
            FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) AS v(m, w, n)),
    memorial AS (SELECT make_date(y, 5, 31) - CAST((isodow(make_date(y, 5, 31)) + 6) % 7 AS INT) AS h FROM y)
    SELECT day FROM days WHERE isodow(day) <= 5 AND day NOT IN (
      SELECT CAST(h AS DATE) FROM observed UNION SELECT CAST(h AS DATE) FROM nth UNION SELECT CAST(h AS DATE) FROM memorial)""")
def _(r):
    return q.publication_days(r.trades.select(F.col("ship_day").alias("day")).distinct())


@query("FLT10_missing_bar_securities", """
    WITH want AS (SELECT count(*) AS want FROM sessions), have AS (SELECT security_id, count(*) AS have FROM bars GROUP BY 1)
    SELECT ticker, want - coalesce(have, 0) AS missing_sessions FROM listings LEFT JOIN have USING (security_id), want
    WHERE valid_to IS NULL AND coalesce(have, 0) < want""")
def _(r):
    return q.missing_bar_securities(r.listings, r.bars.select("security_id", "session_date"), r.sessions)


@query("FLT11_point_in_time_panel", f"""
    WITH bar AS (SELECT security_id, close FROM bars WHERE session_date = {DAY}),
    latest AS (SELECT security_id, concept, arg_max(value, row(period_end, available_at, accession)) AS v FROM facts
               WHERE available_at <= TIMESTAMP '1998-06-09 00:00:00' AND period_end <= {DAY} GROUP BY 1, 2),
    rows AS (SELECT s.security_id, bar.close, a.v AS "Assets", e.v AS "StockholdersEquity",
                    bar.close IS NOT NULL AND a.v IS NOT NULL AND e.v IS NOT NULL AS member_complete
             FROM securities s LEFT JOIN bar USING (security_id)
             LEFT JOIN latest a ON a.security_id = s.security_id AND a.concept = 'Assets'
             LEFT JOIN latest e ON e.security_id = s.security_id AND e.concept = 'StockholdersEquity')
    SELECT *, (SELECT bool_and(member_complete) FROM rows) AS panel_ready,
           (SELECT count(*) FROM rows WHERE NOT member_complete) AS incomplete_members FROM rows""",
       digits="close:8 Assets:4 StockholdersEquity:4")
def _(r):
    decision = decision_at(F.expr(DAY))
    facts = r.facts.where((F.col("available_at") <= decision) & (F.col("period_end") <= F.expr(DAY)))
    return q.point_in_time_panel(r.securities.select("security_id"), r.bars, facts, ["Assets", "StockholdersEquity"], decision, F.expr(DAY))


@query("FLT12_complete_feature_filter", """
    WITH wide AS (SELECT security_id, formation_date, count(value) AS have,
                         max(CASE WHEN feature_key = 'earnings_yield_ttm' THEN value END) AS ey,
                         max(CASE WHEN feature_key = 'trailing_volatility_60d' THEN value END) AS vol FROM outcomes GROUP BY 1, 2)
    SELECT coalesce(CASE WHEN ey IS NULL THEN 'missing_fundamental' WHEN vol IS NULL THEN 'missing_market' WHEN have < 6 THEN 'incomplete' END, 'kept') AS drop_reason,
           count(*) AS rows_count FROM wide GROUP BY 1""")
def _(r):
    value = lambda key: F.max(F.when(F.col("feature_key") == key, F.col("value")))
    wide = r.outcomes.groupBy("security_id", "formation_date").agg(
        F.count("value").alias("have"), value("earnings_yield_ttm").alias("ey"), value("trailing_volatility_60d").alias("vol"))
    tagged = q.with_drop_reason(wide, [
        ("missing_fundamental", F.col("ey").isNull()), ("missing_market", F.col("vol").isNull()), ("incomplete", F.col("have") < 6)])
    return tagged.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("rows_count"))


@query("FLT13_key_integrity", """
    WITH k AS (SELECT count(*) AS copies, count(*) FILTER (prediction IS NULL OR isnan(prediction)) AS bp, count(*) FILTER (actual IS NULL OR isnan(actual)) AS ba
               FROM predictions GROUP BY model_key, formation_date, security_id)
    SELECT count(*) AS keys, count(*) FILTER (copies > 1) AS duplicate_keys, CAST(sum(bp) AS BIGINT) AS bad_prediction, CAST(sum(ba) AS BIGINT) AS bad_actual FROM k""")
def _(r):
    return q.key_integrity(r.predictions, ["model_key", "formation_date", "security_id"], ["prediction", "actual"])
