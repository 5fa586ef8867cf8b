"""Monthly fundamentals as of every formation: pairs of annual periods under the decision's knowledge.

Versions of a value become ranges of decisions over which they stand. Inputs of one period meet by period
and overlap their ranges; only the reigning period is spread over the formations, so no product of history
and formations is formed and a later filing never reaches an earlier formation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import expand_versions, version_intervals
from ..functions.scalars import first_reason
from .fundamentals import (ANNUAL_DAYS, ASSET_GAP_DAYS, CASH_FLOW, CELL, INCOME, PRIOR_DAYS, SHARES, annual_facts, days, month_number, numbered, priority,
                           split_factor)

# Fixed value: the fallback where no shares are stated on a cover page.
WEIGHTED_SHARES = "WeightedAverageNumberOfSharesOutstandingBasic"
VERSION = ["available_at", "is_amendment", "accession"]


def standing(versions: DataFrame, keys: Sequence[str], formations: DataFrame, name: str, order: Sequence[str] = VERSION) -> DataFrame:
    """(keys, name, lo, hi): the best version per key and the half-open range of decisions over which it stands."""
    held = version_intervals(versions, list(keys), formations, "available_at", list(order))
    return held.select(*keys, F.col("value").alias(name), F.col("decision_ord").alias("lo"), F.col("until_ord").alias("hi"))


def overlapped(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows that agree on ``on``, over the decisions at which both stand."""
    right = right.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    both = left.join(right, list(on)).withColumn("lo", F.greatest("lo", "_lo")).withColumn("hi", F.least("hi", "_hi"))
    return both.where("lo < hi").drop("_lo", "_hi")


def reigning(periods: DataFrame, formations: DataFrame) -> DataFrame:
    """The latest known period of each security at each formation; ``periods`` has security_id, period_end, lo and hi.

    A period reigns from the first decision that knows it until one knows a later period.
    """
    first = periods.groupBy("security_id", "period_end").agg(F.min("lo").alias("_first"))
    later = Window.partitionBy("security_id").orderBy(F.col("period_end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    reign = first.select("security_id", "period_end", F.min("_first").over(later).alias("_end"))
    held = periods.join(reign, ["security_id", "period_end"]).withColumn("hi", F.least("hi", F.coalesce("_end", "hi"))).where("lo < hi").drop("_end")
    return expand_versions(held.withColumnsRenamed({"lo": "decision_ord", "hi": "until_ord"}), formations)


def annual_pairs(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """Per formation, security and concept: the latest period and the prior one nearest to 365 days, within 330-400 days.

    Columns: formation_date, security_id, concept, current_end, current_value, prior_end, prior_value (null without a prior).
    """
    key = ["security_id", "concept"]
    latest = version_intervals(facts, key, formations, "available_at", ["period_end", *VERSION])
    current = expand_versions(latest, formations).join(numbered(formations), "formation_date").select(
        *CELL, "concept", "ord", F.col("period_end").alias("current_end"), F.col("value").alias("current_value"))
    prior = standing(facts, [*key, "period_end"], formations, "prior_value").withColumnRenamed("period_end", "prior_end").withColumn("month", month_number("prior_end"))
    months = F.sequence(month_number(F.date_sub("current_end", PRIOR_DAYS[1])), month_number(F.date_sub("current_end", PRIOR_DAYS[0])))
    asked = current.withColumn("month", F.explode(months)).join(prior, [*key, "month"], "left")
    gap = days("current_end", "prior_end")
    fits = gap.between(*PRIOR_DAYS) & (F.col("lo") <= F.col("ord")) & (F.col("ord") < F.col("hi"))
    best = F.max(F.when(fits, F.struct((-F.abs(gap - 365)).alias("near"), "prior_end", "prior_value")))
    found = asked.groupBy(*CELL, "concept").agg(F.max("current_end").alias("current_end"), F.max("current_value").alias("current_value"), best.alias("_best"))
    return found.select(*CELL, "concept", "current_end", "current_value", F.col("_best.prior_end").alias("prior_end"), F.col("_best.prior_value").alias("prior_value"))


def value_or_reason(value: Column, reason: Column, name: str) -> list[Column]:
    return [F.when(reason.isNull(), value).alias(name), reason.alias("reason")]


def asset_growth(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """Latest assets over the comparable prior, minus one, as known at each formation (FND14)."""
    pairs = annual_pairs(facts.where((F.col("concept") == "Assets") & (F.col("unit") == "USD")), formations)
    reason = first_reason((F.col("prior_end").isNull(), "missing_comparable_prior_assets"), ((F.col("current_value") <= 0) | (F.col("prior_value") <= 0), "nonpositive_assets"))
    return pairs.select(*CELL, "current_end", "prior_end", *value_or_reason(F.col("current_value") / F.col("prior_value") - 1, reason, "asset_growth"))


def net_share_issuance(facts: DataFrame, actions: DataFrame, formations: DataFrame) -> DataFrame:
    """Split-adjusted change of shares, from endpoint shares or else weighted annual averages (FND15).

    The first concept with a comparable prior counts. Actions inside the span known by the decision adjust the prior.
    """
    whole_year = days("period_end", "period_start").between(*ANNUAL_DAYS)
    usable = (F.col("unit") == "shares") & ((F.col("concept") == SHARES) | ((F.col("concept") == WEIGHTED_SHARES) & F.coalesce(whole_year, F.lit(False))))
    pairs = annual_pairs(facts.where(usable), formations).withColumn("_rank", F.when(F.col("prior_end").isNull(), 2).when(F.col("concept") == SHARES, 0).otherwise(1))
    values = ["_rank", "concept", "current_end", "current_value", "prior_end", "prior_value"]
    chosen = pairs.groupBy(*CELL).agg(F.min(F.struct(*values)).alias("x")).select(*CELL, "x.*").drop("_rank")
    spans = chosen.join(formations.select("formation_date", "decision_at"), "formation_date").select(
        *CELL, F.col("prior_end").alias("span_start"), F.col("current_end").alias("span_end"), "decision_at")
    rows = chosen.join(split_factor(actions, spans), CELL, "left")
    reason = first_reason(
        (F.col("prior_end").isNull(), "missing_comparable_prior_shares"), (F.col("factor_reason").isNotNull(), F.col("factor_reason")),
        ((F.col("current_value") <= 0) | (F.col("prior_value") <= 0), "nonpositive_shares"))
    value = F.col("current_value") / (F.col("prior_value") * F.col("factor")) - 1
    concept = F.when(F.col("prior_end").isNotNull(), F.col("concept")).alias("concept")
    return rows.select(*CELL, concept, *value_or_reason(value, reason, "net_share_issuance"))


def accrual_quality(facts: DataFrame, formations: DataFrame) -> DataFrame:
    """(income - cash flow) / mean assets of the latest annual period whose four inputs are known at the formation (FND16)."""
    period = ["security_id", "period_start", "period_end"]
    flows = annual_facts(facts, [*INCOME, *CASH_FLOW])
    income = standing(flows.where(F.col("concept").isin(*INCOME)).withColumn("_priority", priority(INCOME)), period, formations, "income", ["_priority", *VERSION])
    cash = standing(flows.where(F.col("concept").isin(*CASH_FLOW)), period, formations, "cash")
    assets = standing(facts.where((F.col("concept") == "Assets") & (F.col("unit") == "USD")), ["security_id", "period_end"], formations, "assets")
    both = overlapped(overlapped(income, cash, period), assets.withColumnRenamed("assets", "end_assets"), ["security_id", "period_end"])
    near = F.explode(F.sequence(F.date_sub("period_start", ASSET_GAP_DAYS), F.date_add("period_start", ASSET_GAP_DAYS)))
    begun = overlapped(both.withColumn("begin_date", near), assets.withColumnsRenamed({"period_end": "begin_date", "assets": "begin_assets"}), ["security_id", "begin_date"])
    known = reigning(begun, formations)
    distance = F.abs(days("begin_date", "period_start"))
    # of two periods with one end the later start; of two beginnings the nearer, then the earlier
    order = F.struct(-days("period_start", F.lit("1900-01-01").cast("date")), distance, "begin_date")
    picked = known.groupBy(*CELL).agg(F.min(F.struct(order.alias("o"), "period_end", "income", "cash", "begin_assets", "end_assets")).alias("x")).select(*CELL, "x.*")
    reason = first_reason(((F.col("begin_assets") <= 0) | (F.col("end_assets") <= 0), "nonpositive_assets"))
    value = (F.col("income") - F.col("cash")) / ((F.col("begin_assets") + F.col("end_assets")) / 2)
    return picked.select(*CELL, "period_end", *value_or_reason(value, reason, "accrual_quality"))
