"""Queries over the driver's tables, one per operator, with DuckDB statements where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .collocations import collocations
from .embedding_dedup import near_embeddings
from .html_extract import extract_pages
from .language import fit_languages, predict_languages
from .mixing import mix
from .neighbours import search
from .periodic_runs import periodic_runs, strongest
from .pii import KINDS, find_pii, span_text
from .quality import fit_quality, learnable, quality_scores
from .simhash import simhash_groups
from .token_counts import token_counts
from .toxicity import fit_toxicity, toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return coded.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality_scores(docs, machine)
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(span_text("base"), 256).alias("base_sha256"), span_text(F.concat("base", "further")).alias("spans"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_languages(docs, fit_languages(docs))
    return found.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_pages(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), repeat=True, texts=False).withColumn("best", strongest())
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


@query
def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(~learnable(), F.lit(False)).alias("held_out"), "score", "predicted", "neighbours", "cosines")


@query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLES["op1_embedding_dedup"] = """
with recursive v as (
    select vec_id, label, embedding::double[] as e from embeddings
    where embedding is not null and label is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id as src, b.vec_id as dst from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select src, dst from links union select r.src, l.dst from reach r join links l on r.dst = l.src),
roots as (select src, min(dst) as least from reach group by src),
counts as (select src, count(*) as n from links group by src)
select t.vec_id, coalesce(c.n, 0)::bigint as n_links, least(t.vec_id, coalesce(r.least, t.vec_id))::bigint as component_id,
       t.vec_id <= coalesce(r.least, t.vec_id) as kept
from embeddings t left join roots r on r.src = t.vec_id left join counts c on c.src = t.vec_id
"""

ORACLES["op12_collocations"] = r"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents where text is not null),
lists as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') as ws from pieces),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
grams as (
    select lang, 1 as k, ws[i] as phrase, ws[i] as w1, null as w2, null as w3 from places
    union all select lang, 2, ws[i] || ' ' || ws[i + 1], ws[i], ws[i + 1], null from places where i < len(ws)
    union all select lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2], ws[i], ws[i + 1], ws[i + 2] from places where i + 1 < len(ws)),
f as (select lang, k, phrase, w1, w2, w3, count(*) as a from grams group by all),
words as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
cuts as (
    select p.lang, p.k, p.phrase, p.w1, p.w2, p.w3, p.a, x.a as l, y.a as r, 1 as cut_no from f p
    join f x on x.lang = p.lang and x.k = 1 and x.phrase = p.w1
    join f y on y.lang = p.lang and y.k = p.k - 1 and y.phrase = substr(p.phrase, length(p.w1) + 2)
    where p.k > 1 and p.a >= 10
    union all
    select p.lang, p.k, p.phrase, p.w1, p.w2, p.w3, p.a, x.a, y.a, 2 from f p
    join f x on x.lang = p.lang and x.k = 2 and x.phrase = p.w1 || ' ' || p.w2
    join f y on y.lang = p.lang and y.k = 1 and y.phrase = p.w3
    where p.k = 3 and p.a >= 10),
scored as (select *, ((1000000::hugeint * a * a) // (l::hugeint * r))::bigint as score from cuts),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut_no) = 1),
longer as (
    select lang, w1 || ' ' || w2 as part, max(a) as a from best where k = 3 group by all
    union all select lang, w2 || ' ' || w3, max(a) from best where k = 3 group by all),
kept as (
    select b.* from best b where not exists (
        select 1 from longer g where b.k = 2 and g.lang = b.lang and g.part = b.phrase and 100 * g.a >= 50 * b.a)),
ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, r.rank::bigint as rank, r.phrase, r.a::bigint as a, r.l::bigint as l, r.r::bigint as r, w.n, r.score
from ranked r join words w on w.lang = r.lang where r.rank <= 2000
"""
