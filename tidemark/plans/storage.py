"""SRC09, SRC10, SRC12, SRC13, SNK06, SNK10, SNK12-SNK14: queries that write files to the shared folder, and scan and verify them."""

import uuid

from pyspark.sql import functions as F

from ..operators.modelling import long_training_rows
from ..session import shared_checkpoint_dir
from ..sources import datasets as ds
from ..sources import files
from ..sources import sinks as snk
from . import query

HOLDOUT = "2000-07-01"
EXAMPLE_COLUMNS = "formation_date date, security_id long, f1 double, f2 double, f3 double, target double"
LINES_A_FILE = 500


def place(r, name):
    """A new folder of this run under the shared one."""
    return f"{shared_checkpoint_dir(r.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def text_files(r, rows, header, name):
    """Files of at most LINES_A_FILE lines: ``rows`` has line and number, the file is the number's block."""
    block = F.floor(F.col("number") / LINES_A_FILE).alias("block")
    body = rows.groupBy(block).agg(F.array_sort(F.collect_list("line")).alias("lines"))
    whole = body.select("block", F.concat_ws("\n", header(F.col("block")), F.array_join("lines", "\n")).alias("value"))
    path = place(r, name)
    whole.write.partitionBy("block").text(path)
    return path


@query("SRC09_universe_files", "SELECT DISTINCT lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik FROM facts")
def _(r):
    members = r.facts.select("security_id").distinct()
    rows = members.select(F.concat_ws(",", F.lit('"note, with a comma"'), F.format_string("%d ", "security_id")).alias("line"), F.col("security_id").alias("number"))
    # every second file opens with a byte order mark and another case
    header = lambda block: F.when(block % 2 == 0, F.lit("﻿Note,CIK")).otherwise(F.lit("note, Cik"))
    return files.universe_files(r.spark, text_files(r, rows, header, "universe"))


@query("SRC10_listing_files", """
    SELECT 'MAN' || security_id AS ticker, issuer_name, lpad(CAST(security_id AS VARCHAR), 10, '0') AS cik, CASE WHEN security_id % 2 = 0 THEN 'XNYS' ELSE 'XNAS' END AS mic, 'by "hand"' AS source FROM securities""")
def _(r):
    exchange = F.when(F.col("security_id") % 2 == 0, "NYSE").otherwise("Nasdaq")
    line = F.concat_ws(",", F.lit('"by ""hand"""'), exchange, F.col("security_id").cast("string"), F.concat(F.lit('"'), F.col("issuer_name"), F.lit('"')), F.concat(F.lit("man"), F.col("security_id").cast("string")))
    rows = r.securities.select(line.alias("line"), F.col("security_id").alias("number"))
    return files.listing_files(r.spark, text_files(r, rows, lambda _: F.lit("SOURCE,Exchange,cik,Issuer_Name,ticker"), "listings"))


def tagged(r):
    return r.examples.select(
        "formation_date", "security_id", "f1", "f2", "f3", "target", F.when(F.col("formation_date") < F.lit(HOLDOUT).cast("date"), "development").otherwise("holdout").alias("partition"))


@query("SRC12_development_files", f"SELECT formation_date, security_id, f1, target FROM examples WHERE formation_date < DATE '{HOLDOUT}'", digits="f1:9 target:9")
def _(r):
    path = place(r, "dataset")
    tagged(r).write.partitionBy("partition").parquet(path)
    rows = files.development_files(r.spark, path, EXAMPLE_COLUMNS, "formation_date", HOLDOUT, ["f1", "target"])
    return rows.select("formation_date", "security_id", "f1", "target")


@query("SRC13_gzip_predictions", "SELECT model_key, outer_fold, formation_date, security_id, CASE WHEN security_id % 5 <> 0 THEN prediction END AS prediction FROM predictions", digits="prediction:9")
def _(r):
    path = place(r, "predictions")
    value = F.when(F.col("security_id") % 5 != 0, F.col("prediction"))
    r.predictions.select("model_key", "outer_fold", "formation_date", "security_id", value.alias("prediction")).write.csv(path, header=True, compression="gzip", nullValue="")
    schema = "model_key string, outer_fold int, formation_date date, security_id long, prediction double"
    return files.gzip_table(r.spark, path, schema, ["model_key", "formation_date", "security_id"], finite=["prediction"], required=["model_key", "formation_date", "security_id"])


def text_sql(columns: dict[str, str], places: int = 9) -> str:
    """The canonical text of a row; ``columns`` maps names to their kind."""
    value = {"double": lambda c: f"CAST(CAST(round({c} * 1e{places}, 0) AS DECIMAL(38, 0)) AS VARCHAR)"}
    return "concat_ws('|', " + ", ".join(f"coalesce({value.get(k, lambda c: f'CAST({c} AS VARCHAR)')(c)}, '\\N')" for c, k in columns.items()) + ")"


def tree_sql(source: str, groups: str, key: dict[str, str], values: dict[str, str]) -> str:
    """The same tree: leaves by as many digits as the number of rows asks for, then level by level."""
    nodes = f"""
    WITH rows_ AS MATERIALIZED (SELECT {groups}, sha256({text_sql(key)}) AS k, sha256({text_sql(key | values)}) AS r FROM ({source})),
    size AS (SELECT count(*) AS n FROM rows_),
    once AS (SELECT {groups}, k, r, count(*) AS n FROM rows_ GROUP BY ALL),
    deep AS (SELECT CASE WHEN n <= 256 THEN 0 WHEN n <= 65536 THEN 1 WHEN n <= 16777216 THEN 2 WHEN n <= 4294967296 THEN 3 ELSE 4 END AS d FROM size),
    node4 AS (SELECT {groups}, substr(k, 1, 2 * d) AS p, sum(n) AS n, sha256(string_agg(k || ':' || r || ':' || n, chr(10) ORDER BY k, r, CAST(n AS VARCHAR))) AS h FROM once, deep GROUP BY ALL)"""
    for level in range(4, 0, -1):
        nodes += f""",
    node{level - 1} AS (SELECT * FROM node{level} WHERE length(p) <> {2 * level} UNION ALL
      SELECT {groups}, substr(p, 1, {2 * (level - 1)}) AS p, sum(n) AS n, sha256(string_agg(substr(p, {2 * level - 1}, 2) || ':' || h, chr(10) ORDER BY p)) AS h FROM node{level} WHERE length(p) = {2 * level} GROUP BY {groups}, substr(p, 1, {2 * (level - 1)}))"""
    return f"{nodes} SELECT {groups}, CAST(n AS BIGINT) AS rows_count, h AS digest FROM node0"


EXAMPLE_KEY = {"formation_date": "date", "security_id": "long"}
EXAMPLE_VALUES = dict.fromkeys(["f1", "f2", "f3", "target"], "double")
TAGGED = f"SELECT *, CASE WHEN formation_date < DATE '{HOLDOUT}' THEN 'development' ELSE 'holdout' END AS partition FROM examples"


@query("SNK12_immutable_export", f"""SELECT "partition", rows_count, digest, true AS second_refused FROM ({tree_sql(TAGGED, '"partition"', EXAMPLE_KEY, EXAMPLE_VALUES)})""")
def _(r):
    path = place(r, "export")
    ds.publish(tagged(r), path, "partition", list(EXAMPLE_KEY), dataset="training", version="1")
    try:
        ds.publish(tagged(r), path, "partition", list(EXAMPLE_KEY))
        refused = False
    except ds.DatasetExists:
        refused = True
    return ds.verify_published(r.spark, path).withColumn("second_refused", F.lit(refused))


@query("SNK13_long_export_files", """
    SELECT CAST(sum(n) AS BIGINT) AS rows_count, count(*) AS snapshots, count(*) FILTER (n < 6) AS incomplete_snapshots, CAST(0 AS BIGINT) AS repeated_snapshots, max(n) AS features FROM (
      SELECT formation_date, security_id, count(*) AS n FROM sector_ranks JOIN examples USING (formation_date, security_id) WHERE percentile IS NOT NULL GROUP BY 1, 2)""")
def _(r):
    rows = long_training_rows(r.sector_ranks, r.examples.select("formation_date", "security_id", "target"))
    stored = ds.export_long(rows, place(r, "long"), ["formation_date", "security_id", "feature_key", "percentile", "target"])
    return ds.inspection(stored, ["formation_date", "security_id"], "feature_key", 6)


CELL_KEY = {"security_id": "long", "feature_key": "string"}
CELL_VALUES = {"value": "double", "unavailable_reason": "string", "lineage": "string"}


@query("SNK14_cell_lineage", f"""
    {tree_sql("SELECT o.*, 'lineitem:' || n || ':' || c AS lineage FROM outcomes o JOIN (SELECT l_suppkey AS security_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS formation_date, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS c FROM lineitem GROUP BY 1, 2) USING (security_id, formation_date)",
              "formation_date", CELL_KEY, CELL_VALUES)}""")
def _(r):
    token = F.concat_ws(":", F.lit("lineitem"), F.col("n").cast("string"), F.col("c").cast("string"))
    cells = r.outcomes.join(r.monthly.select("security_id", "formation_date", token.alias("lineage")), ["security_id", "formation_date"])
    return ds.tree_digest(cells, ["formation_date"], list(CELL_KEY), list(CELL_VALUES))


@query("SNK06_prediction_insert", "SELECT score_date, security_id, raw_prediction AS prediction FROM scores WHERE eligible AND year(score_date) >= 2000", digits="prediction:9")
def _(r):
    scored = r.scores.where("eligible")
    predictions = r.monthly.where("n >= 3").select(
        F.col("formation_date").alias("score_date"), "security_id", ((F.col("d") * 3 + F.col("t")) / F.col("n")).alias("prediction"))
    stored = predictions.where("year(score_date) < 2000")
    return snk.insert_predictions(scored, predictions.unionByName(predictions.where("security_id % 4 = 0")), stored, ["score_date", "security_id"], ["prediction"])


@query("SNK10_cohort_copy", "SELECT 'survivors' AS cohort_code, DATE '2001-01-03' AS as_of_date, security_id FROM securities WHERE security_id % 7 <> 0 AND security_id % 3 <> 0")
def _(r):
    dated = lambda day, keep: r.securities.where(keep).select(F.lit(day).cast("date").alias("as_of_date"), "security_id")
    memberships = dated("2000-01-03", "true").unionByName(dated("2001-01-03", "security_id % 7 <> 0"))
    held = memberships.where("as_of_date = DATE '2001-01-03' AND security_id % 3 = 0").select(F.lit("survivors").alias("cohort_code"), "as_of_date", "security_id")
    other = r.securities.select(F.lit("older").alias("cohort_code"), F.lit("2000-01-03").cast("date").alias("as_of_date"), "security_id")
    return snk.cohort_from_latest("survivors", memberships, held.unionByName(other))
