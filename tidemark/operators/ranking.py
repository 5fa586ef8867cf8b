"""Cross-sectional ranks, composites and linear scoring over value-or-reason rows.

Every rank goes through :mod:`tidemark.functions.ranks`, so one crowded formation or
sector never has to be sorted in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import tie_percentile, top_rows, with_position, with_tie_ranks
from ..functions.scalars import safe_divide

# Families of the weekly panel, their members and each member's direction.
FAMILIES = {
    "momentum_trend": {"momentum_12_1": 1, "relative_strength_6m": 1},
    "reversal": {"short_term_reversal_20d": -1},
    "value": {"book_to_market": 1, "earnings_yield_ttm": 1, "operating_cash_flow_yield_ttm": 1},
    "profitability_quality": {
        "return_on_assets_ttm": 1, "operating_cash_flow_profitability_ttm": 1, "accrual_quality_ttm": -1,
    },
    "investment_issuance": {"asset_growth_yoy": -1, "net_share_issuance_yoy": -1},
    "risk": {"realized_volatility_60d": -1, "idiosyncratic_volatility_60d": -1},
}
MINIMUM_FAMILIES = 3


def sector_percentiles(outcomes: DataFrame, sectors: DataFrame, registry: DataFrame, minimum_peers: int = 2) -> DataFrame:
    """Tie-aware percentile within formation, feature and sector; higher is always better (RNK01).

    Rows carry exactly one of ``percentile`` and ``reason``.
    """
    keys = ["formation_date", "feature_key", "sector_code"]
    placed = outcomes.join(sectors, "security_id").join(registry.select("feature_key", "feature_version", "direction"), "feature_key")
    ranked = with_tie_ranks(placed, keys, "value").withColumnRenamed("total", "peer_count").withColumn("total", F.col("peer_count"))
    raw = F.when(F.col("direction") > 0, tie_percentile()).otherwise(1 - tie_percentile())
    reason = F.when(F.col("value").isNull(), F.concat(F.lit("feature_unavailable:"), "unavailable_reason")).when(
        F.col("peer_count") < minimum_peers, F.lit("insufficient_sector_peers"))
    return ranked.withColumn("reason", reason).select(
        "security_id", *keys, "feature_version", "peer_count", "reason",
        F.when(F.col("reason").isNull(), raw).alias("percentile"))


def centered_ranks(cells: DataFrame, keys: list[str], value: str, direction: Column | int = 1) -> DataFrame:
    """Market-wide rank in [-1, 1]; missing and lone values sit at zero (RNK02)."""
    oriented = F.lit(direction) if isinstance(direction, int) else direction
    ranked = with_tie_ranks(cells, keys, value)
    centered = F.coalesce((tie_percentile() * 2 - 1) * oriented, F.lit(0.0))
    return ranked.withColumn("centered_rank", centered).withColumn("available", F.col(value).isNotNull()).drop("below", "ties", "total")


def centered_percentiles(cells: DataFrame, keys: list[str], value: str, higher_is_better: bool = True) -> DataFrame:
    """Monthly variant: percentile - 0.5, missing at zero (RNK02)."""
    ranked = with_tie_ranks(cells, keys, value)
    sign = 1 if higher_is_better else -1
    return ranked.withColumn("centered_percentile", F.coalesce((tie_percentile() - 0.5) * sign, F.lit(0.0))).drop("below", "ties", "total")


def label_ranks(labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Label variant: groups with fewer than two labels are dropped (RNK02)."""
    ranked = with_tie_ranks(labels.where(F.col(value).isNotNull()), keys, value).where("total >= 2")
    return ranked.withColumn("label_rank", tie_percentile() * 2 - 1).drop("below", "ties", "total")


def family_table(spark) -> DataFrame:
    rows = ", ".join(
        f"('{family}', '{key}', {direction}, {len(members)})" for family, members in FAMILIES.items() for key, direction in members.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(family, feature_key, direction, feature_count)")


def compose_families(ranked: DataFrame, families: DataFrame) -> DataFrame:
    """Mean member rank (missing counts as zero), availability share and informative flag (RNK04)."""
    rows = ranked.join(families.select("family", "feature_key", "feature_count"), "feature_key")
    return rows.groupBy("formation_date", "security_id", "family").agg(
        (F.sum("centered_rank") / F.max("feature_count")).alias("family_rank"),
        (F.count_if("available") / F.max("feature_count")).alias("availability"),
        F.max("available").alias("informative"),
    )


def score_eligibility(family_rows: DataFrame) -> DataFrame:
    """At least three informative families; weight = 1 / formations in the month / eligible names (RNK05)."""
    rows = family_rows.groupBy("formation_date", "security_id").agg(F.count_if("informative").alias("informative_families"))
    rows = rows.withColumn("eligible", F.col("informative_families") >= MINIMUM_FAMILIES)
    month = F.date_trunc("month", "formation_date").cast("date")
    per_formation = rows.groupBy("formation_date").agg(F.count_if("eligible").alias("names")).withColumn("month", month)
    per_month = per_formation.where("names > 0").groupBy("month").agg(F.count(F.lit(1)).alias("formations"))
    weights = per_formation.join(per_month, "month").select(
        "formation_date", safe_divide(F.lit(1.0), F.col("formations") * F.col("names")).alias("weight"))
    return rows.join(weights, "formation_date", "left").withColumn("sample_weight", F.when(F.col("eligible"), F.col("weight"))).drop("weight")


def reason_list(condition: Column) -> Column:
    """Sorted ``feature@version:reason`` list of the rows that fail ``condition`` (at most one per model input)."""
    text = F.concat("feature_key", F.lit("@"), "feature_version", F.lit(":"), "reason")
    joined = F.array_join(F.array_sort(F.collect_list(F.when(condition, text))), ",")
    return F.when(F.count_if(condition) > 0, F.concat(F.lit("required_feature_rank_unavailable="), joined))


def equal_weight_composite(ranks: DataFrame) -> DataFrame:
    """Mean of every required percentile; any missing input makes the security ineligible (RNK07)."""
    missing = F.col("percentile").isNull()
    rows = ranks.groupBy("formation_date", "security_id").agg(
        F.avg("percentile").alias("_mean"), F.count_if(missing).alias("_missing"), reason_list(missing).alias("reason"))
    eligible = F.col("_missing") == 0
    return rows.select(
        "formation_date", "security_id", eligible.alias("eligible"),
        F.when(eligible, F.col("_mean")).alias("normalized_score"), F.when(eligible, F.col("_mean") * 100).alias("display_score"), "reason")


def baseline_contributions(ranks: DataFrame, scores: DataFrame, inputs: int) -> DataFrame:
    """percentile / k per input, with the recomputed score next to the published one (RNK08)."""
    rows = ranks.withColumn("contribution", F.col("percentile") / inputs)
    check = rows.groupBy("formation_date", "security_id").agg(
        F.sum("contribution").alias("_sum"), F.count("contribution").alias("_n")).join(scores, ["formation_date", "security_id"])
    same = F.when(F.col("eligible"), F.abs(F.col("_sum") - F.col("normalized_score")) < 1e-9).otherwise(F.col("_n") < inputs)
    verified = check.select("formation_date", "security_id", same.alias("verified"))
    return rows.join(verified, ["formation_date", "security_id"]).select(
        "formation_date", "security_id", "feature_key", "percentile", "contribution", "verified")


def linear_contracts(ranks: DataFrame, inputs: DataFrame, target_mean: float) -> DataFrame:
    """target mean + sum of coefficient x (x - mean) / scale, under both eligibility contracts in one aggregation (RNK10).

    ``*_all`` needs every input, ``*_active`` those that are switched on. A missing input that is switched off is
    replaced by its mean, so both contracts share one sum. Terms are added in order of their keys: equal
    inputs give equal predictions, whatever the order of the rows, so they also round alike and rank by id.
    """
    rows = ranks.join(inputs, "feature_key")
    missing = F.col("percentile").isNull()
    needed = missing & (F.col("coefficient") != 0)
    term = F.col("coefficient") * (F.coalesce("percentile", "mean") - F.col("mean")) / F.col("scale")
    terms = F.array_sort(F.collect_list(F.when(term.isNotNull(), F.struct("feature_key", term.alias("term")))))
    summed = rows.groupBy("formation_date", "security_id").agg(
        terms.alias("_terms"), F.count_if(missing).alias("_missing"), F.count_if(needed).alias("_needed"),
        reason_list(missing).alias("reason_all"), reason_list(needed).alias("reason_active"))
    total = F.when(F.size("_terms") > 0, F.aggregate("_terms", F.lit(0.0), lambda sum_, x: sum_ + x["term"]))
    scored = summed.withColumn("_p", F.lit(target_mean) + total)
    every, active = F.col("_missing") == 0, F.col("_needed") == 0
    return scored.select(
        "formation_date", "security_id", every.alias("eligible_all"), active.alias("eligible_active"),
        F.when(every, F.col("_p")).alias("prediction_all"), F.when(active, F.col("_p")).alias("prediction_active"), "reason_all", "reason_active")


def one_contract(contracts: DataFrame, name: str) -> DataFrame:
    """The columns of one contract of :func:`linear_contracts`, under their plain names."""
    return contracts.select("formation_date", "security_id", *[F.col(f"{c}_{name}").alias(c) for c in ("eligible", "prediction", "reason")])


def linear_predictions(ranks: DataFrame, inputs: DataFrame, target_mean: float, *, ignore_zero: bool) -> DataFrame:
    """Predictions under one eligibility contract (RNK09)."""
    return one_contract(linear_contracts(ranks, inputs, target_mean), "active" if ignore_zero else "all")


def display_positions(predictions: DataFrame, *, digits: int | None = None) -> DataFrame:
    """0-1 place by (prediction, id), 0-100 display score, 1..n rank from the top (RNK09, RNK12)."""
    scored = predictions.where(F.col("prediction").isNotNull())
    key = F.round("prediction", digits) if digits is not None else F.col("prediction")
    placed = with_position(scored.withColumn("_p", key), ["formation_date"], "_p", "security_id", position="_place", size="_n").drop("_p")
    share = (F.col("_place") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))
    out = placed.withColumn("normalized_score", share).withColumn("display_score", F.bround(share * 100, 2)).withColumn(
        "position_from_bottom", F.col("_place"))
    return out.drop("_place", "_n")


def display_ranks(predictions: DataFrame, *, digits: int | None = None) -> DataFrame:
    """1..n rank by prediction descending, id ascending (RNK12)."""
    key = F.round("prediction", digits) if digits is not None else F.col("prediction")
    scored = predictions.where(F.col("prediction").isNotNull()).withColumn("_p", key)
    return with_position(scored, ["formation_date"], "_p", "security_id", descending=True, position="score_rank", size="_n").drop("_p", "_n")


def model_contributions(ranks: DataFrame, inputs: DataFrame) -> DataFrame:
    """coefficient x z per active input and its share of the absolute coefficients (RNK11)."""
    active = inputs.where("coefficient <> 0")
    total = active.agg(F.sum(F.abs("coefficient")).alias("_total"))
    weighted = active.crossJoin(F.broadcast(total)).withColumn("weight", F.abs("coefficient") / F.col("_total"))
    rows = ranks.join(weighted.drop("_total"), "feature_key")
    return rows.select(
        "formation_date", "security_id", "feature_key", "weight",
        (F.col("coefficient") * (F.col("percentile") - F.col("mean")) / F.col("scale")).alias("contribution"), "reason")


def eligibility_audit(old: DataFrame, new: DataFrame, digits: int = 12) -> DataFrame:
    """Coverage under both contracts, identical predictions and the largest rank shift, per formation (RNK13)."""
    keys = ["formation_date", "security_id"]
    ranks_of = lambda df, name: display_ranks(df, digits=digits).select(*keys, F.col("score_rank").alias(name))
    both = (
        old.select(*keys, F.col("prediction").alias("old_p")).join(new.select(*keys, F.col("prediction").alias("new_p")), keys)
        .join(ranks_of(old, "old_rank"), keys, "left").join(ranks_of(new, "new_rank"), keys, "left")
    )
    return both.groupBy("formation_date").agg(
        F.count(F.lit(1)).alias("universe"), F.count("old_p").alias("previously_eligible"), F.count("new_p").alias("corrected_eligible"),
        F.count_if(F.col("old_p") == F.col("new_p")).alias("identical_predictions"),
        F.max(F.abs(F.col("new_rank") - F.col("old_rank"))).alias("largest_rank_shift"),
    ).withColumn("newly_eligible", F.col("corrected_eligible") - F.col("previously_eligible"))


def feature_matrix(ranks: DataFrame, features: list[str]) -> DataFrame:
    """Wide percentiles, one column per feature (RNK14, MDL01). The pivot values are given, so no extra pass."""
    return ranks.groupBy("formation_date", "security_id").pivot("feature_key", features).agg(F.max("percentile"))


def top_names(scores: DataFrame, size: int = 20) -> DataFrame:
    """Highest eligible scores per formation at equal weight (PRT01)."""
    order = [F.col("normalized_score").desc(), F.col("security_id").asc()]
    return top_rows(scores.where("eligible"), ["formation_date"], order, size, rank="target_rank").withColumn("target_weight", F.lit(1.0 / size))


def input_contract(inputs: DataFrame, registry: DataFrame) -> DataFrame:
    """Model inputs against the registry: ordinal, identity, activity; every input must be registered (RNK18)."""
    joined = inputs.join(registry, "feature_key", "left")
    known = F.assert_true(F.col("feature_version").isNotNull(), F.lit("model input is not registered"))
    return joined.where(known.isNull()).select(
        "ordinal", F.concat("feature_key", F.lit("_percentile")).alias("model_column"), "feature_key", "feature_version",
        "coefficient", (F.col("coefficient") != 0).alias("is_active"))


def new_definitions(incoming: DataFrame, stored: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """Insert-if-absent with a conflict flag where a stored definition differs (RNK19)."""
    old = stored.select(*keys, F.col(payload).alias("_stored"))
    both = incoming.join(old, keys, "left")
    return both.select(*keys, F.when(F.col("_stored").isNull(), "insert").when(
        F.col("_stored").eqNullSafe(F.col(payload)), "unchanged").otherwise("conflict").alias("outcome"))
