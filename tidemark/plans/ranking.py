"""RNK: cross-sectional ranks, composites, scoring and eligibility."""

from pyspark.sql import functions as F

from ..fixtures import TARGET_MEAN
from ..functions import ranks
from ..operators import ranking as k
from ..session import cut_lineage
from . import query

KEYS = ["formation_date", "security_id"]


@query("RNK01_sector_percentile", "SELECT * FROM sector_ranks", digits="percentile")
def _(r):
    return r.sector_ranks


CENTERED = """
    SELECT security_id, formation_date, feature_key, value,
           (rank() OVER (PARTITION BY formation_date, feature_key, value IS NULL ORDER BY value) - 1
            + (count(*) OVER (PARTITION BY formation_date, feature_key, value) - 1) / 2.0)
           / nullif(count(value) OVER (PARTITION BY formation_date, feature_key) - 1, 0) AS p,
           count(value) OVER (PARTITION BY formation_date, feature_key) AS n
    FROM outcomes"""


@query("RNK02_centered_rank", f"""
    SELECT security_id, formation_date, feature_key, CASE WHEN value IS NULL THEN 0 ELSE coalesce((p * 2 - 1) * direction, 0) END AS centered_rank, value IS NOT NULL AS available
    FROM ({CENTERED}) JOIN registry USING (feature_key)""", digits="centered_rank")
def _(r):
    cells = r.outcomes.join(r.registry.select("feature_key", "direction"), "feature_key")
    out = k.centered_ranks(cells, ["formation_date", "feature_key"], "value", F.col("direction"))
    return out.select("security_id", "formation_date", "feature_key", "centered_rank", "available")


@query("RNK02_centered_percentile", f"""
    SELECT security_id, formation_date, feature_key, CASE WHEN value IS NULL THEN 0 ELSE coalesce(p - 0.5, 0) END AS centered_percentile FROM ({CENTERED})""",
       digits="centered_percentile")
def _(r):
    out = k.centered_percentiles(r.outcomes, ["formation_date", "feature_key"], "value")
    return out.select("security_id", "formation_date", "feature_key", "centered_percentile")


@query("RNK02_label_rank", """
    SELECT formation_date, security_id, (rank() OVER (PARTITION BY formation_date ORDER BY actual) - 1 + (count(*) OVER (PARTITION BY formation_date, actual) - 1) / 2.0)
           / nullif(count(*) OVER (PARTITION BY formation_date) - 1, 0) * 2 - 1 AS label_rank
    FROM predictions WHERE model_key = 'reference' QUALIFY count(*) OVER (PARTITION BY formation_date) >= 2""", digits="label_rank")
def _(r):
    out = k.label_ranks(r.predictions.where("model_key = 'reference'"), ["formation_date"], "actual")
    return out.select("formation_date", "security_id", "label_rank")


@query("RNK03_average_rank", """
    SELECT formation_date, security_id, rank() OVER (PARTITION BY formation_date ORDER BY prediction) + (count(*) OVER (PARTITION BY formation_date, prediction) - 1) / 2.0 AS average_rank
    FROM predictions WHERE model_key = 'candidate'""", digits="average_rank")
def _(r):
    ranked = ranks.with_tie_ranks(r.predictions.where("model_key = 'candidate'"), ["formation_date"], "prediction")
    return ranked.select("formation_date", "security_id", ranks.average_rank().alias("average_rank"))


FAMILY_ROWS = ", ".join(f"('{f}', '{m}', {d}, {len(ms)})" for f, ms in k.FAMILIES.items() for m, d in ms.items())
FAMILY_SQL = f"""
    SELECT formation_date, security_id, family, sum(cr) / max(feature_count) AS family_rank,
           count(*) FILTER (value IS NOT NULL) * 1.0 / max(feature_count) AS availability, bool_or(value IS NOT NULL) AS informative
    FROM (SELECT c.*, CASE WHEN value IS NULL THEN 0 ELSE coalesce((p * 2 - 1) * direction, 0) END AS cr, family, feature_count
          FROM ({CENTERED}) c JOIN (VALUES {FAMILY_ROWS}) AS f(family, feature_key, direction, feature_count) USING (feature_key)) GROUP BY 1, 2, 3"""


def families(r):
    table = k.family_table(r.spark)
    cells = r.outcomes.join(table.select("feature_key", "direction"), "feature_key")
    return k.compose_families(k.centered_ranks(cells, ["formation_date", "feature_key"], "value", F.col("direction")), table)


@query("RNK04_family_composition", FAMILY_SQL, digits="family_rank availability")
def _(r):
    return families(r)


@query("RNK05_score_eligibility", f"""
    WITH e AS (SELECT formation_date, security_id, count(*) FILTER (informative) AS informative_families, count(*) FILTER (informative) >= 3 AS eligible FROM ({FAMILY_SQL}) GROUP BY 1, 2),
    f AS (SELECT formation_date, date_trunc('month', formation_date) AS m, count(*) FILTER (eligible) AS names FROM e GROUP BY 1),
    g AS (SELECT m, count(*) AS formations FROM f WHERE names > 0 GROUP BY 1)
    SELECT e.*, CASE WHEN eligible THEN 1.0 / (formations * names) END AS sample_weight FROM e JOIN f USING (formation_date) LEFT JOIN g USING (m)""", digits="sample_weight")
def _(r):
    return k.score_eligibility(families(r))


@query("RNK06_value_or_reason", """
    SELECT feature_key, count(value) AS available, count(unavailable_reason) AS unavailable, count(*) FILTER ((value IS NULL) = (unavailable_reason IS NULL)) AS violations
    FROM outcomes GROUP BY 1""")
def _(r):
    both = F.col("value").isNull() == F.col("unavailable_reason").isNull()
    return r.outcomes.groupBy("feature_key").agg(
        F.count("value").alias("available"), F.count("unavailable_reason").alias("unavailable"), F.count_if(both).alias("violations"))


@query("RNK07_equal_weight_composite", "SELECT formation_date, security_id, eligible, normalized_score, normalized_score * 100 AS display_score, reason FROM composite",
       digits="normalized_score display_score")
def _(r):
    return k.equal_weight_composite(r.sector_ranks)


@query("RNK08_baseline_contributions", """
    SELECT formation_date, security_id, feature_key, percentile, percentile / 6 AS contribution, true AS verified FROM sector_ranks""", digits="percentile contribution")
def _(r):
    return k.baseline_contributions(r.sector_ranks, k.equal_weight_composite(r.sector_ranks), 6)


@query("RNK09_linear_model_scores", """
    SELECT formation_date, security_id, prediction, place / greatest(n - 1, 1) AS normalized_score, round_even(place * 100.0 / greatest(n - 1, 1), 2) AS display_score
    FROM (SELECT *, row_number() OVER (PARTITION BY formation_date ORDER BY round(prediction, 12), security_id) - 1 AS place, count(*) OVER (PARTITION BY formation_date) AS n
          FROM linear_active WHERE eligible)""", digits="prediction:10 normalized_score display_score")
def _(r):
    scored = k.display_positions(k.linear_predictions(r.sector_ranks, r.model_inputs, TARGET_MEAN, ignore_zero=True), digits=12)
    return scored.select(*KEYS, "prediction", "normalized_score", "display_score")


@query("RNK10_eligibility_contracts", """
    SELECT a.formation_date, a.security_id, a.eligible AS eligible_all, b.eligible AS eligible_active, a.prediction AS prediction_all, b.prediction AS prediction_active, a.reason
    FROM linear_all a JOIN linear_active b USING (formation_date, security_id)""", digits="prediction_all:10 prediction_active:10")
def _(r):
    both = k.linear_contracts(r.sector_ranks, r.model_inputs, TARGET_MEAN)
    return both.withColumnRenamed("reason_all", "reason").drop("reason_active")


@query("RNK11_model_contributions", """
    SELECT formation_date, security_id, feature_key, abs(coefficient) / (SELECT sum(abs(coefficient)) FROM model_inputs) AS weight,
           coefficient * (percentile - mean) / scale AS contribution, reason
    FROM sector_ranks JOIN model_inputs USING (feature_key) WHERE coefficient <> 0""", digits="weight contribution:9")
def _(r):
    return k.model_contributions(r.sector_ranks, r.model_inputs)


@query("RNK12_display_rank", """
    SELECT formation_date, security_id, row_number() OVER (PARTITION BY formation_date ORDER BY round(prediction, 12) DESC, security_id) AS score_rank
    FROM linear_active WHERE eligible""")
def _(r):
    active = k.linear_predictions(r.sector_ranks, r.model_inputs, TARGET_MEAN, ignore_zero=True)
    return k.display_ranks(active, digits=12).select(*KEYS, "score_rank")


@query("RNK13_eligibility_audit", """
    WITH o AS (SELECT formation_date, security_id, prediction, row_number() OVER (PARTITION BY formation_date ORDER BY round(prediction, 12) DESC, security_id) AS rk FROM linear_all WHERE eligible),
    n AS (SELECT formation_date, security_id, prediction, row_number() OVER (PARTITION BY formation_date ORDER BY round(prediction, 12) DESC, security_id) AS rk FROM linear_active WHERE eligible)
    SELECT formation_date, count(*) AS universe, count(o.prediction) AS previously_eligible, count(n.prediction) AS corrected_eligible, count(n.prediction) - count(o.prediction) AS newly_eligible,
           count(o.prediction) AS identical_predictions, max(abs(n.rk - o.rk)) AS largest_rank_shift
    FROM linear_all a LEFT JOIN o USING (formation_date, security_id) LEFT JOIN n USING (formation_date, security_id) GROUP BY 1""")
def _(r):
    both = cut_lineage(k.linear_contracts(r.sector_ranks, r.model_inputs, TARGET_MEAN))
    every, active = k.one_contract(both, "all"), k.one_contract(both, "active")
    rounded = lambda df: df.withColumn("prediction", F.round("prediction", 12))
    return k.eligibility_audit(rounded(every), rounded(active))


MATRIX = ", ".join(f"max(CASE WHEN feature_key = '{f}' THEN percentile END) AS {f}" for f in
                   ("momentum_12_1", "relative_strength_6m", "earnings_yield_ttm", "return_on_assets_ttm", "trailing_volatility_60d", "median_dollar_volume_20d"))


@query("RNK14_feature_matrix", f"SELECT formation_date, security_id, {MATRIX} FROM sector_ranks GROUP BY 1, 2",
       digits="momentum_12_1 relative_strength_6m earnings_yield_ttm return_on_assets_ttm trailing_volatility_60d median_dollar_volume_20d")
def _(r):
    from ..fixtures import BASELINE_FEATURES
    return k.feature_matrix(r.sector_ranks, list(BASELINE_FEATURES))


@query("RNK15_candidate_sector_rank", """
    WITH c AS (SELECT formation_date, security_id, sector_code, prediction, count(*) OVER (PARTITION BY formation_date, sector_code) AS n,
                      rank() OVER (PARTITION BY formation_date, sector_code ORDER BY prediction) AS rk, count(*) OVER (PARTITION BY formation_date, sector_code, prediction) AS ties
               FROM predictions JOIN sectors USING (security_id) WHERE model_key = 'candidate')
    SELECT formation_date, security_id, sector_code, 1 - (rk - 1 + (ties - 1) / 2.0) / (n - 1) AS percentile FROM c WHERE n >= 2""", digits="percentile")
def _(r):
    keys = ["formation_date", "sector_code"]
    rows = r.predictions.where("model_key = 'candidate'").join(r.sectors, "security_id")
    ranked = ranks.with_tie_ranks(rows, keys, "prediction").where("total >= 2")
    return ranked.select("formation_date", "security_id", "sector_code", (1 - ranks.tie_percentile()).alias("percentile"))


@query("RNK18_model_input_contract", """
    SELECT ordinal, feature_key || '_percentile' AS model_column, feature_key, feature_version, coefficient, coefficient <> 0 AS is_active
    FROM model_inputs JOIN registry USING (feature_key) WHERE feature_key IN (SELECT feature_key FROM outcomes)""", digits="coefficient")
def _(r):
    used = r.model_inputs.join(r.outcomes.select("feature_key").distinct(), "feature_key", "left_semi")
    return k.input_contract(used, r.registry)


@query("RNK19_definition_catalog", """
    SELECT feature_key, CASE WHEN feature_key LIKE 'm%' THEN 'insert' WHEN feature_key LIKE 'e%' THEN 'conflict' ELSE 'unchanged' END AS outcome
    FROM (SELECT DISTINCT feature_key FROM outcomes)""")
def _(r):
    incoming = r.outcomes.select("feature_key").distinct().withColumn("definition", F.sha2("feature_key", 256))
    stored = incoming.where("feature_key NOT LIKE 'm%'").withColumn(
        "definition", F.when(F.col("feature_key").startswith("e"), F.lit("other")).otherwise(F.col("definition")))
    return k.new_definitions(incoming, stored, ["feature_key"], "definition")
