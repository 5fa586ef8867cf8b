"""The score run end to end, for one formation or many (RNK16, RNK17, WIN23)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import with_position
from ..session import cut_lineage
from . import fundamentals as fnd
from . import ranking as rk
from . import windows as w

CELL = ["formation_date", "security_id"]


def market_cells(bars: DataFrame, unadjusted: DataFrame, benchmark: DataFrame, sessions: DataFrame, formations: DataFrame) -> DataFrame:
    """Market inputs at each formation, two columns per feature: value and reason."""
    at_formation = lambda df: df.withColumnRenamed("session_date", "formation_date").join(formations.select("formation_date"), "formation_date", "left_semi")
    rows = w.volatility_60d(w.relative_strength_6m(w.momentum_12_1(w.price_history(bars)), benchmark, sessions, strict=False))
    liquid = at_formation(w.median_dollar_volume_20d(w.price_history(unadjusted))).select(*CELL, "median_dollar_volume_20d", "median_dollar_volume_20d_reason")
    return at_formation(rows).join(liquid, CELL, "left")


def feature_outcomes(market: DataFrame, facts: DataFrame, formations: DataFrame) -> DataFrame:
    """Six value-or-reason rows per security and formation. ``market`` comes from :func:`market_cells`."""
    income = fnd.annual_income(facts, formations)
    shares = fnd.latest_facts(facts, formations, fnd.SHARES, "shares")
    roa = fnd.return_on_assets(income, fnd.asset_history(facts, formations), formations).select(
        *CELL, "income", "return_on_assets_ttm", F.col("reason").alias("return_on_assets_ttm_reason"))
    rows = market.join(roa, CELL, "left").join(shares.select(*CELL, "shares"), CELL, "left")
    no_income = F.when(F.col("income").isNull(), "missing_annual_income")
    yield_reason = F.coalesce(no_income, F.when(F.coalesce("shares", F.lit(0.0)) <= 0, "missing_shares"))
    values = {
        "momentum_12_1": (F.col("momentum_12_1"), F.col("momentum_12_1_reason")),
        "relative_strength_6m": (F.col("relative_strength_6m"), F.col("relative_strength_6m_reason")),
        "earnings_yield_ttm": (F.when(yield_reason.isNull(), F.col("income") / (F.col("close") * F.col("shares"))), yield_reason),
        "return_on_assets_ttm": (F.col("return_on_assets_ttm"), F.coalesce(no_income, "return_on_assets_ttm_reason")),
        "trailing_volatility_60d": (F.col("trailing_volatility_60d"), F.col("trailing_volatility_60d_reason")),
        "median_dollar_volume_20d": (F.col("median_dollar_volume_20d"), F.coalesce("median_dollar_volume_20d_reason", F.when(F.col("median_dollar_volume_20d").isNull(), "missing_unadjusted_bar"))),
    }
    cells = F.array(*[
        F.struct(F.lit(key).alias("feature_key"), F.round(value, 12).alias("value"), reason.alias("unavailable_reason")) for key, (value, reason) in values.items()])
    return rows.select(*CELL, F.explode(cells).alias("x")).select(*CELL, "x.*")


def score_run(outcomes: DataFrame, sectors: DataFrame, registry: DataFrame) -> DataFrame:
    """Ranks, composite and 1..n rank per formation; unscored securities keep their reason (RNK16).

    Outcomes are written once to the shared checkpoint folder: ranking reads them several times,
    and the features behind them are the costly part. So are scores, which are read twice to be placed.
    Ineligible rows are placed below every eligible one, so one pass ranks both.
    """
    scores = cut_lineage(rk.equal_weight_composite(rk.sector_percentiles(cut_lineage(outcomes), sectors, registry)))
    keyed = scores.withColumn("_p", F.coalesce(F.round("normalized_score", 10), F.lit(-1.0)))
    placed = with_position(keyed, ["formation_date"], "_p", "security_id", descending=True, position="_place", size="_n")
    return placed.select(*scores.columns, F.when(F.col("eligible"), F.col("_place")).alias("score_rank"))


def pending_formations(formations: DataFrame, completed: DataFrame) -> DataFrame:
    """Formations not scored yet; a re-run resumes where the last one stopped (RNK17)."""
    return formations.join(completed, "formation_date", "left_anti")


def active_inputs(unadjusted: DataFrame, facts: DataFrame, claims: DataFrame, formations: DataFrame) -> DataFrame:
    """Liquidity ending on the formation, annual fundamentals and the latest sector (WIN23)."""
    liquid = w.median_dollar_volume_20d(w.price_history(unadjusted)).select(
        F.col("session_date").alias("formation_date"), "security_id", "median_dollar_volume_20d")
    liquid = liquid.join(formations.select("formation_date"), "formation_date", "left_semi")
    income = fnd.annual_income(facts, formations)
    roa = fnd.return_on_assets(income, fnd.asset_history(facts, formations), formations).select(*CELL, "income", "return_on_assets_ttm")
    sector = claims.groupBy("security_id").agg(F.max_by("sector_code", F.struct("as_of_date", "available_at")).alias("sector_code"))
    return liquid.join(roa, CELL, "left").join(sector, "security_id", "left")
