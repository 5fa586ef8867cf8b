"""Payload scans: one provider payload per row, shredded by Spark.

Every scan takes a frame with a ``value`` text column, as ``spark.read.text(path, wholetext=True)``
gives, and fails on malformed payloads instead of skipping them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import canonical_ticker, padded_cik

# Exchange names and their market identifier codes; the index header line.
MIC_BY_EXCHANGE = {"Nasdaq": "XNAS", "NYSE": "XNYS", "NYSE American": "XASE", "NYSE Arca": "ARCX", "Cboe BZX": "BATS"}
INDEX_HEADER = "CIK|Company Name|Form Type|Date Filed|File Name"

PRICE = "decimal(20,8)"
BAR_SCHEMA = "bars map<string,array<struct<t:string,o:decimal(20,8),h:decimal(20,8),l:decimal(20,8),c:decimal(20,8),v:decimal(24,6)>>>, next_page_token string"
ACTION_FIELDS = ("id string, symbol string, acquirer_symbol string, acquiree_symbol string, new_symbol string, old_symbol string, process_date date, ex_date date, "
                 "effective_date date, cash decimal(20,8), rate decimal(20,8), ratio struct<numerator:decimal(20,8),denominator:decimal(20,8)>")
FILING_COLUMNS = "form array<string>, accessionNumber array<string>, filingDate array<string>, acceptanceDateTime array<string>, reportDate array<string>"
FACT_SCHEMA = "facts map<string,map<string,struct<units:map<string,array<struct<accn:string,val:decimal(30,10),start:string,end:string,fy:int,fp:string>>>>>>"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per payload file."""
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def parsed_json(schema: str) -> Column:
    """The payload under ``schema``; text that does not fit it fails the job."""
    return F.from_json("value", schema, {"mode": "FAILFAST"})


def daily_bars(payloads: DataFrame) -> DataFrame:
    """Bar payloads to one row per bar (SRC01)."""
    parsed = payloads.select(parsed_json(BAR_SCHEMA).alias("p"))
    ok = F.assert_true(F.col("p.bars").isNotNull(), F.lit("bar payload has no symbol groups"))
    groups = parsed.where(ok.isNull()).select(F.explode("p.bars").alias("symbol", "items"))
    items = F.coalesce("items", F.raise_error(F.concat(F.lit("bar group is not a list: "), "symbol")))  # a null group fails; an empty one has no rows
    return groups.select(canonical_ticker(F.col("symbol")).alias("ticker"), F.explode(items).alias("b")).select(
        "ticker", F.to_date(F.to_timestamp("b.t")).alias("session_date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"),
        F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"))


def corporate_actions(payloads: DataFrame) -> DataFrame:
    """Action payloads grouped by plural type to one row per action with a symbol (SRC02)."""
    parsed = payloads.select(parsed_json(f"corporate_actions map<string,array<struct<{ACTION_FIELDS.replace(' string', ':string').replace(' date', ':date').replace(' decimal', ':decimal').replace(' struct', ':struct')}>>>").alias("p"))
    ok = F.assert_true(F.col("p.corporate_actions").isNotNull(), F.lit("action payload has no groups"))
    groups = parsed.where(ok.isNull()).select(F.explode("p.corporate_actions").alias("group", "items"))
    items = F.coalesce("items", F.raise_error(F.concat(F.lit("action group is not a list: "), "group")))  # a null group fails; an empty one has no rows
    rows = groups.select("group", F.explode(items).alias("a"))
    symbol = F.coalesce("a.symbol", "a.acquirer_symbol", "a.acquiree_symbol", "a.new_symbol", "a.old_symbol")
    ok = F.assert_true(F.col("a.id").isNotNull() & F.col("a.process_date").isNotNull(), F.lit("corporate action lacks id or process date"))
    kept = rows.where(symbol.isNotNull()).where(ok.isNull())
    return kept.select(
        F.col("a.id").alias("action_id"), canonical_ticker(symbol).alias("ticker"), F.regexp_replace("group", "s+$", "").alias("action_type"),
        F.col("a.process_date").alias("process_date"), F.coalesce("a.ex_date", "a.effective_date").alias("effective_date"), F.coalesce("a.cash", "a.rate").alias("cash_amount"),
        F.col("a.ratio.numerator").alias("ratio_numerator"), F.col("a.ratio.denominator").alias("ratio_denominator"), F.to_json("a").alias("payload"))


def company_tickers(payloads: DataFrame) -> DataFrame:
    """``fields`` plus ``data`` rows; the field order is asserted (SRC03)."""
    parsed = payloads.select(parsed_json("fields array<string>, data array<array<string>>").alias("p"))
    expected = F.array(*[F.lit(x) for x in ("cik", "name", "ticker", "exchange")])
    ordered = F.assert_true(F.col("p.fields") == expected, F.lit("unexpected ticker fields"))
    rows = parsed.where(ordered.isNull()).select(F.explode("p.data").alias("d"))
    cik = padded_cik(F.col("d")[0])
    digits = F.assert_true(cik.rlike("^[0-9]{10}$"), F.lit("CIK is not numeric"))
    return rows.where(digits.isNull()).select(cik.alias("cik"), F.col("d")[1].alias("issuer_name"), F.col("d")[2].alias("ticker"), F.col("d")[3].alias("exchange"))


def with_mic(rows: DataFrame) -> DataFrame:
    """Exchange name to MIC; unmapped rows keep a null (SRC04)."""
    mapping = F.create_map(*[F.lit(x) for pair in MIC_BY_EXCHANGE.items() for x in pair])
    return rows.withColumn("mic", mapping[F.col("exchange")]).withColumn("ticker", F.upper("ticker"))


def submissions(payloads: DataFrame, nested: bool) -> DataFrame:
    """Parallel filing arrays zipped strictly; current files nest them, history files do not (SRC05)."""
    schema = f"filings struct<recent:struct<{FILING_COLUMNS.replace(' array', ':array')}>>" if nested else FILING_COLUMNS
    parsed = payloads.select(parsed_json(schema).alias("p"))
    root = "p.filings.recent" if nested else "p"
    names = ("form", "accessionNumber", "filingDate", "acceptanceDateTime", "reportDate")
    columns = parsed.select(*[F.col(f"{root}.{n}").alias(n) for n in names])
    same = F.lit(True)
    for name in names[1:]:
        same = same & (F.size(name) == F.size("form"))
    ok = F.assert_true(F.coalesce(same, F.lit(False)), F.lit("submission columns differ in length"))
    rows = columns.where(ok.isNull()).select(F.explode(F.arrays_zip(*names)).alias("f"))
    form = F.upper(F.trim("f.form"))
    return rows.select(
        F.col("f.accessionNumber").alias("accession"), F.regexp_replace(form, "/A$", "").alias("form"), F.trim("f.form").alias("submitted_form"),
        form.endswith("/A").alias("is_amendment"), F.to_date("f.filingDate").alias("filed_on"), F.to_timestamp("f.acceptanceDateTime").alias("accepted_at"),
        F.to_date(F.nullif("f.reportDate", F.lit(""))).alias("report_date"))


def daily_master_index(payloads: DataFrame) -> DataFrame:
    """Pipe-delimited lines after the header, an optional dashed separator skipped (SRC06)."""
    body = F.when(F.instr("value", INDEX_HEADER) > 0, F.substring_index("value", INDEX_HEADER, -1)).otherwise(F.raise_error(F.lit("daily master index header is missing")).cast("string"))
    lines = payloads.select(F.posexplode(F.filter(F.split(body, "\r?\n"), lambda x: F.trim(x) != "")).alias("n", "line"))
    content = lines.where(~((F.col("n") == 0) & F.trim("line").rlike("^-{5,}$")))
    parts = content.select(F.split("line", "\\|").alias("f"))
    ok = F.assert_true(F.size("f") == 5, F.lit("daily master index row does not have five fields"))
    return parts.where(ok.isNull()).select(
        padded_cik(F.col("f")[0]).alias("cik"), F.trim(F.col("f")[2]).alias("form"), F.to_date(F.trim(F.col("f")[3])).alias("filed_on"), F.trim(F.col("f")[4]).alias("file_name"))


def company_facts(payloads: DataFrame, filings: DataFrame) -> DataFrame:
    """taxonomy -> concept -> unit -> observations, kept for stored accessions with an end date (SRC07)."""
    parsed = payloads.select(parsed_json(FACT_SCHEMA).alias("p"))
    ok = F.assert_true(F.col("p.facts").isNotNull(), F.lit("company facts payload has no facts"))
    taxonomies = parsed.where(ok.isNull()).select(F.explode("p.facts").alias("taxonomy", "concepts"))
    concepts = taxonomies.select("taxonomy", F.explode("concepts").alias("concept", "definition"))
    units = concepts.select("taxonomy", "concept", F.explode("definition.units").alias("unit", "items"))
    items = F.coalesce("items", F.raise_error(F.concat(F.lit("fact unit is not a list: "), "unit")))  # a null group fails; an empty one has no rows
    rows = units.select("taxonomy", "concept", "unit", F.explode(items).alias("o")).where(F.length("o.end") > 0)
    period = F.col("o.fp")
    facts = rows.select(
        F.col("o.accn").alias("accession"), "taxonomy", "concept", "unit", F.col("o.val").alias("value"), F.to_date(F.nullif("o.start", F.lit(""))).alias("period_start"),
        F.to_date("o.end").alias("period_end"), F.when(F.col("o.fy") >= 1900, F.col("o.fy")).alias("fiscal_year"), F.when(period.isin("FY", "Q1", "Q2", "Q3", "Q4"), period).alias("fiscal_period"))
    return facts.join(filings.select("accession").distinct(), "accession", "left_semi")


def merge_filings(*groups: DataFrame) -> DataFrame:
    """Union of filing histories, one row per accession; disagreement fails the job (SRC08)."""
    united = groups[0]
    for group in groups[1:]:
        united = united.unionByName(group)
    metadata = F.struct("form", "submitted_form", "is_amendment", "filed_on", "accepted_at", "report_date")
    merged = united.groupBy("accession").agg(F.min(metadata).alias("m"), (F.min(metadata) != F.max(metadata)).alias("_conflict"))
    ok = F.assert_true(~F.col("_conflict"), F.concat(F.lit("filing histories disagree about "), "accession"))
    return merged.where(ok.isNull()).select("accession", "m.*")


def csv_rows(lines: DataFrame, schema: str) -> DataFrame:
    """Typed rows of headerless CSV lines; an empty field is null, a malformed one fails."""
    return lines.select(F.from_csv("value", F.lit(schema), {"mode": "FAILFAST", "nullValue": "", "escape": '"'}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header (gzip by extension); never infers a schema."""
    return spark.read.csv(path, schema=schema, header=True, nullValue="", mode="FAILFAST", encoding="UTF-8")


def universe_members(rows: DataFrame) -> DataFrame:
    """Distinct zero-padded CIKs (SRC09)."""
    return rows.where(F.length(F.trim("cik")) > 0).select(padded_cik(F.col("cik")).alias("cik")).distinct()


def manual_listings(rows: DataFrame) -> DataFrame:
    """Manual listings; an unmapped exchange fails the job (SRC10)."""
    mapped = with_mic(rows)
    ok = F.assert_true(F.col("mic").isNotNull(), F.concat(F.lit("unmapped exchange "), "exchange"))
    return mapped.where(ok.isNull()).select(F.upper(F.trim("ticker")).alias("ticker"), "issuer_name", padded_cik(F.col("cik")).alias("cik"), "mic", "source")


def sector_rows(rows: DataFrame, identifiers: DataFrame, as_of: Column) -> DataFrame:
    """cik, sector joined to open identifiers and stamped with its dates (SRC11)."""
    opened = identifiers.where(F.col("valid_to").isNull()).select("security_id", "cik")
    return rows.select(padded_cik(F.col("cik")).alias("cik"), F.trim("sector").alias("sector_code")).join(opened, "cik").select(
        "security_id", "sector_code", as_of.alias("as_of_date"))


def development_rows(rows: DataFrame, holdout_start: Column, values: list[str]) -> DataFrame:
    """The development partition; a row in the holdout or a non-finite value fails the job (SRC12)."""
    finite = F.lit(True)
    for name in values:
        finite = finite & F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) != float("inf"))
    ok = F.assert_true((F.col("formation_date") < holdout_start) & finite, F.lit("development row reaches the holdout or is not finite"))
    return rows.where(F.col("partition") == "development").where(ok.isNull())


def unique_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Fails the job when a key repeats (SRC13)."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ok = F.assert_true(F.col("_n") == 1, F.lit("duplicate key in dataset"))
    return rows.join(counts.where(ok.isNull()).select(*keys), keys, "left_semi")


def point_in_time_scan(table: DataFrame, ids: DataFrame, decision: Column, concepts: DataFrame | None = None, through: Column | None = None) -> DataFrame:
    """Rows of listed securities known at the decision; filters reach the scan (SRC14)."""
    rows = table.where(F.col("available_at") <= decision)
    if through is not None:
        rows = rows.where(F.col("session_date") <= through)
    rows = rows.join(ids, "security_id", "left_semi")
    return rows if concepts is None else rows.join(concepts, ["taxonomy", "concept", "unit"], "left_semi")
