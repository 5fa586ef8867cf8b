"""SRC and SNK: payload scans, merges and exports. Payloads are built from the fixture tables."""

from pyspark.sql import functions as F

from ..fixtures import TARGET_MEAN
from ..functions import scalars as sc
from ..operators import ranking as rk
from ..sources import payloads as src
from ..sources import sinks as snk
from . import query

BAR_DIGITS = "open:8 high:8 low:8 close:8 volume"


def cik(column="security_id"):
    return sc.padded_cik(F.col(column))


def bar_payloads(r):
    """One page per supplier and year, so no payload grows with the table."""
    bar = F.struct(
        F.date_format("session_date", "yyyy-MM-dd'T'05:00:00'Z'").alias("t"), *[F.round(F.col(c), 8).cast("decimal(20,8)").alias(a) for c, a in (("open", "o"), ("high", "h"), ("low", "l"), ("close", "c"))], F.col("volume").alias("v"))
    pages = r.bars.groupBy("security_id", F.year("session_date").alias("y")).agg(F.collect_list(bar).alias("items"))
    symbol = F.concat(F.lit("tkr"), F.col("security_id").cast("string"), F.lit(".b"))
    return pages.select(F.to_json(F.struct(F.create_map(symbol, F.col("items")).alias("bars"), F.lit(None).cast("string").alias("next_page_token"))).alias("value"))


@query("SRC01_daily_bar_payloads", "SELECT 'TKR' || security_id || '-B' AS ticker, session_date, open, high, low, close, CAST(volume AS DOUBLE) AS volume FROM bars", digits=BAR_DIGITS)
def _(r):
    rows = src.daily_bars(bar_payloads(r))
    return rows.select("ticker", "session_date", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


@query("SRC02_corporate_action_payloads", """
    SELECT action_id, 'BR-' || security_id AS ticker, action_type, process_date, effective_date, cash_amount, ratio_numerator, ratio_denominator FROM actions WHERE security_id % 6 <> 5""",
       digits="cash_amount ratio_numerator ratio_denominator")
def _(r):
    symbol = F.when(F.col("security_id") % 6 != 5, F.concat(F.lit("br."), F.col("security_id").cast("string")))
    first = F.col("security_id") % 2 == 0
    item = F.struct(
        F.col("action_id").alias("id"), F.when(first, symbol).alias("symbol"), F.when(~first, symbol).alias("new_symbol"), "process_date",
        F.when(first, F.col("effective_date")).alias("ex_date"), F.when(~first, F.col("effective_date")).alias("effective_date"),
        F.when(first, F.col("cash_amount")).alias("cash"), F.when(~first, F.col("cash_amount")).alias("rate"),
        F.when(F.col("ratio_numerator").isNotNull(), F.struct(F.col("ratio_numerator").alias("numerator"), F.col("ratio_denominator").alias("denominator"))).alias("ratio"))
    grouped = r.actions.groupBy("security_id", F.year("process_date").alias("y"), F.concat("action_type", F.lit("s")).alias("kind")).agg(F.collect_list(item).alias("items"))
    payloads = grouped.select(F.to_json(F.struct(F.create_map("kind", "items").alias("corporate_actions"))).alias("value"))
    rows = src.corporate_actions(payloads)
    return rows.select("action_id", "ticker", "action_type", "process_date", "effective_date", *[F.col(c).cast("double").alias(c) for c in ("cash_amount", "ratio_numerator", "ratio_denominator")])


EXCHANGE = "CASE security_id % 6 WHEN 0 THEN 'Nasdaq' WHEN 1 THEN 'NYSE' WHEN 2 THEN 'NYSE American' WHEN 3 THEN 'NYSE Arca' WHEN 4 THEN 'Cboe BZX' ELSE 'OTC' END"
ASSOCIATIONS = f"SELECT lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik, issuer_name, 'tkr' || security_id AS ticker, {EXCHANGE} AS exchange FROM securities"


def association_payloads(r):
    row = F.array(F.col("security_id").cast("string"), "issuer_name", F.concat(F.lit("tkr"), F.col("security_id").cast("string")), F.expr(EXCHANGE))
    fields = F.array(*[F.lit(x) for x in ("cik", "name", "ticker", "exchange")])
    pages = r.securities.groupBy(F.floor(F.col("security_id") / 50).alias("page")).agg(F.collect_list(row).alias("data"))
    return pages.select(F.to_json(F.struct(fields.alias("fields"), "data")).alias("value"))


@query("SRC03_company_tickers", ASSOCIATIONS)
def _(r):
    return src.company_tickers(association_payloads(r))


@query("SRC04_security_master", f"""
    SELECT cik, issuer_name, upper(ticker) AS ticker, exchange, CASE exchange WHEN 'Nasdaq' THEN 'XNAS' WHEN 'NYSE' THEN 'XNYS' WHEN 'NYSE American' THEN 'XASE' WHEN 'NYSE Arca' THEN 'ARCX' WHEN 'Cboe BZX' THEN 'BATS' END AS mic FROM ({ASSOCIATIONS})""")
def _(r):
    return src.with_mic(src.company_tickers(association_payloads(r)))


FILINGS = "SELECT DISTINCT security_id, accession, form, accepted_at, period_end, is_amendment FROM facts"
FILING_OUT = """accession, regexp_replace(form, '/A$', '') AS form, form AS submitted_form, is_amendment, CAST(accepted_at AS DATE) AS filed_on, strftime(accepted_at, '%Y-%m-%d %H:%M') AS accepted, period_end AS report_date"""


def filing_rows(r):
    return r.facts.select("security_id", "accession", "form", "accepted_at", "period_end").distinct()


def filing_columns():
    text = lambda c, f: F.date_format(c, f)
    item = F.struct("form", "accession", text("accepted_at", "yyyy-MM-dd").alias("filed"), text("accepted_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("accepted"), text("period_end", "yyyy-MM-dd").alias("report"))
    items = F.collect_list(item)
    names = {"form": "form", "accession": "accessionNumber", "filed": "filingDate", "accepted": "acceptanceDateTime", "report": "reportDate"}
    return items.alias("x"), [F.col(f"x.{a}").alias(b) for a, b in names.items()]


def submission_payloads(r, rows, nested):
    items, columns = filing_columns()
    pages = rows.groupBy("security_id", F.year("accepted_at").alias("y")).agg(items)
    body = F.struct(*columns)
    return pages.select(F.to_json(F.struct(F.struct(body.alias("recent")).alias("filings")) if nested else body).alias("value"))


def shown(rows):
    return rows.select("accession", "form", "submitted_form", "is_amendment", "filed_on", F.date_format("accepted_at", "yyyy-MM-dd HH:mm").alias("accepted"), "report_date")


@query("SRC05_submissions", f"SELECT {FILING_OUT} FROM ({FILINGS})")
def _(r):
    recent = filing_rows(r).where("year(accepted_at) >= 1999")
    older = filing_rows(r).where("year(accepted_at) < 1999")
    return shown(src.submissions(submission_payloads(r, recent, True), True).unionByName(src.submissions(submission_payloads(r, older, False), False)))


@query("SRC06_daily_master_index", f"SELECT lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik, form, CAST(accepted_at AS DATE) AS filed_on, 'edgar/' || accession || '.txt' AS file_name FROM ({FILINGS})")
def _(r):
    line = F.concat_ws("|", F.col("security_id").cast("string"), F.lit("Name"), "form", F.date_format("accepted_at", "yyyy-MM-dd"), F.concat(F.lit("edgar/"), "accession", F.lit(".txt")))
    page = F.floor(F.col("security_id") / 500)
    rows = filing_rows(r).groupBy(F.to_date("accepted_at").alias("d"), page.alias("page")).agg(F.collect_list(line).alias("lines"))
    text = F.concat(F.lit(f"Description: index\n\n{src.INDEX_HEADER}\n-----------------\n"), F.array_join("lines", "\n"), F.lit("\n"))
    return src.daily_master_index(rows.select(text.alias("value")))


def fact_payloads(r):
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    o = F.struct(F.col("accession").alias("accn"), F.col("value").cast("decimal(30,10)").alias("val"), text("period_start").alias("start"), text("period_end").alias("end"), F.when(F.col("fiscal_year") == 1996, 0).otherwise(F.col("fiscal_year")).alias("fy"), F.col("fiscal_period").alias("fp"))
    rows = r.facts.groupBy("security_id", "fiscal_year", "taxonomy", "concept", "unit").agg(F.collect_list(o).alias("items"))
    definition = F.struct(F.create_map("unit", "items").alias("units"))
    return rows.select(F.to_json(F.struct(F.create_map("taxonomy", F.create_map(F.col("concept"), definition)).alias("facts"))).alias("value"))


@query("SRC07_company_facts", "SELECT accession, taxonomy, concept, unit, value, period_start, period_end, CASE WHEN fiscal_year <> 1996 THEN fiscal_year END AS fiscal_year, fiscal_period FROM facts WHERE security_id % 4 <> 3", digits="value:4")
def _(r):
    rows = src.company_facts(fact_payloads(r), r.facts.where("security_id % 4 <> 3"))
    return rows.withColumn("value", F.col("value").cast("double"))


@query("SRC08_merge_filings", f"SELECT {FILING_OUT} FROM ({FILINGS})")
def _(r):
    everything = src.submissions(submission_payloads(r, filing_rows(r), True), True)
    older = src.submissions(submission_payloads(r, filing_rows(r).where("year(accepted_at) < 1999"), False), False)
    return shown(src.merge_filings(everything, older))


def csv_line(*columns):
    return F.concat_ws(",", *columns).alias("value")


@query("SRC09_universe_csv", "SELECT DISTINCT lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik FROM facts")
def _(r):
    lines = r.facts.select(csv_line(F.col("security_id").cast("string"), F.col("accession")))
    return src.universe_members(src.csv_rows(lines, "cik string, note string"))


@query("SRC10_manual_listings", """
    SELECT 'MAN' || security_id AS ticker, issuer_name, lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik, CASE WHEN security_id % 2 = 0 THEN 'XNYS' ELSE 'XNAS' END AS mic, 'manual' AS source FROM securities""")
def _(r):
    exchange = F.when(F.col("security_id") % 2 == 0, "NYSE").otherwise("Nasdaq")
    lines = r.securities.select(csv_line(F.concat(F.lit("man"), F.col("security_id").cast("string")), F.col("issuer_name"), F.col("security_id").cast("string"), exchange, F.lit("manual")))
    return src.manual_listings(src.csv_rows(lines, "ticker string, issuer_name string, cik string, exchange string, source string"))


def identifiers(r):
    return r.listings.select("security_id", cik().alias("cik"), "valid_to")


@query("SRC11_sector_csv", "SELECT security_id, sector_code, DATE '2000-01-01' AS as_of_date FROM sectors")
def _(r):
    lines = r.sectors.select(csv_line(F.col("security_id").cast("string"), F.col("sector_code")))
    return src.sector_rows(src.csv_rows(lines, "cik string, sector string"), identifiers(r), F.expr("DATE '2000-01-01'"))


@query("SRC12_development_rows", "SELECT formation_date, security_id, f1, target FROM examples WHERE formation_date < DATE '2000-07-01'", digits="f1:9 target:9")
def _(r):
    tagged = r.examples.withColumn("partition", F.when(F.col("formation_date") < F.expr("DATE '2000-07-01'"), "development").otherwise("holdout"))
    return src.development_rows(tagged, F.expr("DATE '2000-07-01'"), ["f1", "target"]).select("formation_date", "security_id", "f1", "target")


@query("SRC13_predictions_csv", "SELECT model_key, outer_fold, formation_date, security_id, CASE WHEN security_id % 5 <> 0 THEN prediction END AS prediction FROM predictions", digits="prediction:9")
def _(r):
    value = F.when(F.col("security_id") % 5 != 0, F.col("prediction").cast("string")).otherwise("")
    lines = r.predictions.select(csv_line("model_key", F.col("outer_fold").cast("string"), F.col("formation_date").cast("string"), F.col("security_id").cast("string"), value))
    rows = src.csv_rows(lines, "model_key string, outer_fold int, formation_date date, security_id long, prediction double")
    return src.unique_rows(rows, ["model_key", "formation_date", "security_id"])


@query("SRC14_point_in_time_scan", """
    SELECT security_id, accession, concept, value FROM facts WHERE security_id IN (SELECT security_id FROM securities WHERE security_id % 2 = 0) AND available_at <= TIMESTAMP '1999-01-01 00:00:00'
      AND (taxonomy, concept, unit) IN (SELECT DISTINCT taxonomy, concept, unit FROM facts WHERE taxonomy = 'dei')""", digits="value")
def _(r):
    concepts = r.facts.where("taxonomy = 'dei'").select("taxonomy", "concept", "unit").distinct()
    ids = r.securities.where("security_id % 2 = 0").select("security_id")
    return src.point_in_time_scan(r.facts, ids, F.expr("TIMESTAMP '1999-01-01 00:00:00'"), concepts).select("security_id", "accession", "concept", "value")


# ---- sinks ------------------------------------------------------------------
OLD = "session_date < DATE '1999-01-01'"
FRESH = "session_date >= DATE '1998-06-01' AND security_id % 2 = 0"


def books(r):
    base = r.bars.select("security_id", "session_date", "close", "volume")
    stored = base.where(OLD).withColumn("receipt_id", F.lit("old"))
    incoming = base.where(FRESH).withColumn("close", F.col("close") * 2).withColumn("receipt_id", F.when(F.col("security_id") % 4 == 0, "new"))
    return stored, incoming


@query("SNK01_bar_upsert_last_write", f"""
    SELECT security_id, session_date, CASE WHEN {FRESH} THEN close * 2 ELSE close END AS close, volume, CASE WHEN {FRESH} AND security_id % 4 = 0 THEN 'new' WHEN {OLD} THEN 'old' END AS receipt_id FROM bars WHERE ({OLD}) OR ({FRESH})""", digits="close:8")
def _(r):
    return snk.upsert_bars(*books(r), ["security_id", "session_date"], skip_existing=False)


@query("SNK01_bar_upsert_skip_existing", f"""
    SELECT security_id, session_date, CASE WHEN {OLD} THEN close ELSE close * 2 END AS close, volume, CASE WHEN {OLD} THEN 'old' WHEN security_id % 4 = 0 THEN 'new' END AS receipt_id FROM bars WHERE ({OLD}) OR ({FRESH})""", digits="close:8")
def _(r):
    return snk.upsert_bars(*books(r), ["security_id", "session_date"], skip_existing=True)


@query("SNK02_append_only_actions", "SELECT action_id, action_type FROM actions WHERE security_id % 3 <> 0")
def _(r):
    twice = r.actions.unionByName(r.actions)
    return snk.new_rows(twice, r.actions.where("security_id % 3 = 0"), ["action_id"]).select("action_id", "action_type")


@query("SNK03_filing_upsert", f"""
    SELECT accession, CASE WHEN security_id % 2 = 0 THEN form ELSE 'late ' || form END AS submitted_form, is_amendment OR security_id % 5 = 0 AS is_amendment, 2 AS ingested_at, 'second' AS source FROM ({FILINGS})""")
def _(r):
    filings = r.facts.select("security_id", "accession", "form", "is_amendment").distinct()
    stored = filings.select("accession", F.when(F.col("security_id") % 2 == 0, F.col("form")).alias("submitted_form"), "is_amendment", F.lit(1).alias("ingested_at"), F.lit("first").alias("source"))
    incoming = filings.select("accession", F.concat(F.lit("late "), "form").alias("submitted_form"), (F.col("security_id") % 5 == 0).alias("is_amendment"), F.lit(2).alias("ingested_at"), F.lit("second").alias("source"))
    return snk.upsert_filings(stored, incoming)


@query("SNK04_fact_insert_and_log", """
    SELECT 'facts' AS target, count(DISTINCT (security_id, concept, period_end)) AS rows_count FROM observations WHERE (security_id, concept, period_end) NOT IN (SELECT (security_id, concept, period_end) FROM observations WHERE event_id % 4 = 0)
    UNION ALL SELECT 'log', count(DISTINCT event_id) FROM observations WHERE event_id % 4 <> 0""")
def _(r):
    key, identity = ["security_id", "concept", "period_end"], ["event_id", "security_id", "concept", "period_end", "value", "observed_at"]
    stored = r.observations.where("event_id % 4 = 0").withColumn("observation_hash", snk.observation_hash(*identity))
    facts, log = snk.insert_facts(r.observations, stored, stored, key, identity)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows_count")).select(F.lit(name).alias("target"), "rows_count")
    return count(facts, "facts").unionByName(count(log, "log"))


@query("SNK05_score_insert_conflicts", """
    SELECT outcome, different, count(*) AS rows_count FROM (SELECT CASE WHEN year(score_date) >= 2000 THEN 'insert' WHEN security_id % 10 = 1 AND score <> 1 THEN 'conflict' ELSE 'unchanged' END AS outcome,
           CASE WHEN year(score_date) < 2000 AND security_id % 10 = 1 AND score <> 1 THEN 'score' END AS different FROM scores) GROUP BY 1, 2""")
def _(r):
    stored = r.scores.where("year(score_date) < 2000").withColumn("score", F.when(F.col("security_id") % 10 == 1, F.lit(1.0)).otherwise(F.col("score")))
    out = snk.insert_or_conflict(r.scores, stored, ["score_date", "security_id"], ["score", "score_rank", "eligible", "model_version"])
    return out.groupBy("outcome", "different").agg(F.count(F.lit(1)).alias("rows_count"))


@query("SNK05_snapshot_ranks", """
    SELECT score_date, security_id, score_rank, CASE WHEN eligible THEN raw_prediction ELSE 0 END AS display_score, CASE WHEN eligible THEN 'neutral' ELSE 'unavailable' END AS signal FROM scores""", digits="display_score:9")
def _(r):
    raw = r.monthly.select(F.col("formation_date").alias("score_date"), "security_id", (F.col("n") >= 3).alias("eligible"), ((F.col("d") * 3 + F.col("t")) / F.col("n")).alias("display_score"))
    return snk.rank_snapshots(raw).select("score_date", "security_id", "score_rank", "display_score", "signal")


@query("SNK06_prediction_set_equality", """
    SELECT 'missing_prediction' AS side, count(*) AS rows_count FROM scores WHERE eligible AND security_id % 20 = 3 UNION ALL SELECT 'unexpected_prediction', count(*) FROM scores WHERE NOT eligible AND security_id % 20 <> 3""")
def _(r):
    scored = r.monthly.where("n >= 3").select("security_id", "formation_date")
    predicted = r.monthly.where("security_id % 20 <> 3").select("security_id", "formation_date")
    one = lambda a, b, name: a.exceptAll(b).agg(F.count(F.lit(1)).alias("rows_count")).select(F.lit(name).alias("side"), "rows_count")
    return one(scored, predicted, "missing_prediction").unionByName(one(predicted, scored, "unexpected_prediction"))


@query("SNK07_prediction_backfill", f"SELECT formation_date AS score_date, security_id, prediction FROM linear_active WHERE eligible AND year(formation_date) < 2000", digits="prediction:12")
def _(r):
    contributions = rk.model_contributions(r.sector_ranks, r.model_inputs).withColumnRenamed("formation_date", "score_date")
    existing = r.monthly.where("year(formation_date) >= 2000").select(F.col("formation_date").alias("score_date"), "security_id")
    return snk.backfill_predictions(contributions, existing, TARGET_MEAN, 5)


@query("SNK08_explanation_insert", "SELECT formation_date, security_id, feature_key FROM sector_ranks JOIN model_inputs USING (feature_key) WHERE coefficient <> 0 AND month(formation_date) <> 6")
def _(r):
    rows = rk.model_contributions(r.sector_ranks, r.model_inputs).select("formation_date", "security_id", "feature_key")
    return snk.new_rows(rows, r.outcomes.where("month(formation_date) = 6"), ["formation_date", "security_id", "feature_key"])


@query("SNK09_listing_scd2", """
    SELECT security_id, ticker, mic, valid_from, CASE WHEN valid_to IS NULL AND security_id % 6 = 5 THEN DATE '2001-01-01' ELSE valid_to END AS valid_to FROM listings
    UNION ALL SELECT security_id, 'NEW' || security_id, 'XNAS', DATE '2001-01-01', NULL FROM securities WHERE security_id % 6 = 1""")
def _(r):
    open_now = r.listings.where("valid_to IS NULL AND security_id % 6 <> 5").select("security_id", "ticker", "mic")
    renamed = r.securities.where("security_id % 6 = 1").select("security_id", F.concat(F.lit("NEW"), F.col("security_id").cast("string")).alias("ticker"), F.lit("XNAS").alias("mic"))
    return snk.merge_listings(r.listings, open_now.unionByName(renamed), F.expr("DATE '2001-01-01'"))


@query("SNK10_universe_snapshot", "SELECT DATE '2000-01-03' AS as_of_date, security_id FROM securities")
def _(r):
    return snk.universe_snapshot(r.securities.select(cik().alias("cik")), identifiers(r), F.expr("DATE '2000-01-03'"))


@query("SNK11_content_receipts", """
    SELECT DISTINCT 'fixture' AS provider, url AS reference, sha256(html) AS content_sha256, strlen(html) AS byte_count, 'v1' AS parser FROM pages""")
def _(r):
    pages = r.table("pages").select(F.col("url").alias("reference"), F.col("html").alias("value"))
    return snk.receipts(pages.unionByName(pages), "fixture", "v1")


@query("SNK12_export_manifest", """
    SELECT CASE WHEN formation_date >= DATE '2000-07-01' THEN 'holdout' ELSE 'development' END AS partition_name, count(*) AS rows_count, min(formation_date) AS first_date, max(formation_date) AS last_date FROM examples GROUP BY 1""")
def _(r):
    tag = F.when(F.col("formation_date") >= F.expr("DATE '2000-07-01'"), "holdout").otherwise("development")
    return r.examples.groupBy(tag.alias("partition_name")).agg(F.count(F.lit(1)).alias("rows_count"), F.min("formation_date").alias("first_date"), F.max("formation_date").alias("last_date"))


@query("SNK13_long_export", "SELECT formation_date, security_id, feature_key, percentile, target FROM sector_ranks JOIN examples USING (formation_date, security_id) WHERE percentile IS NOT NULL", digits="percentile target:9")
def _(r):
    from ..operators.modelling import long_training_rows
    rows = long_training_rows(r.sector_ranks, r.examples.select("formation_date", "security_id", "target"))
    return rows.select("formation_date", "security_id", "feature_key", "percentile", "target")


@query("SNK14_lineage_digests", "SELECT formation_date, count(*) AS rows_count, 64 AS digest_length FROM outcomes GROUP BY 1")
def _(r):
    out = snk.lineage_digests(r.outcomes, ["security_id", "feature_key"], ["value", "unavailable_reason"], F.floor(F.col("security_id") / 1000))
    return out.select("formation_date", "rows_count", F.length("panel_sha256").alias("digest_length"))


@query("SNK15_orphan_filing_cleanup", f"""
    WITH f AS (SELECT accession, CASE WHEN security_id % 3 = 0 THEN 'other' ELSE form END AS form, security_id FROM ({FILINGS}))
    SELECT form, count(*) AS filings FROM f WHERE NOT (form = 'other' AND accession NOT IN (SELECT accession FROM facts WHERE security_id % 2 = 0)) GROUP BY 1""")
def _(r):
    filings = r.facts.select("accession", "security_id", F.when(F.col("security_id") % 3 == 0, "other").otherwise(F.col("form")).alias("form")).distinct()
    kept = snk.without_orphans(filings, r.facts.where("security_id % 2 = 0"), r.facts.where("security_id % 4 = 0"))
    return kept.groupBy("form").agg(F.count(F.lit(1)).alias("filings"))
