"""Choice of penalties by rank correlation, on paths of fits.

Every fold is one set of moments; a whole path of penalties is solved from it on the driver, and the predictions
of all penalties are one array per row. Targets are ranked by date before folds repeat them, and their ranks go with the rows.
One ranking pass, keyed by fold, date and penalty, then gives the rank correlations of all penalties straight away: no
row is put together again. Only the penalty that is chosen is ranked once more, for its ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import average_rank, with_tie_ranks
from ..session import cut_lineage
from .evaluation import correlation, zero_if_flat
from .modelling import Moments, fold_rows, moments

FOLD = ["outer_fold", "inner_fold"]
#: Rank correlations within it count as equal, and the stronger penalty wins.
TIE_TOLERANCE = 0.002
PLACES = 10
#: Rows are repeated for every fold and penalty, so their ranks are dealt to so many times the shuffle's partitions.
RANK_PIECES = 4


def solve_path(m: Moments, grid: Sequence[tuple[float, float]]) -> list[np.ndarray]:
    """Coefficients of every (l1, l2) of the grid, in its order.

    Coordinate descent goes from the strongest penalty to the weakest, each starting where the one before ended.
    """
    found: dict[tuple[float, float], np.ndarray] = {}
    b = np.zeros(len(m.covariance))
    for l1, l2 in sorted(set(grid), reverse=True):
        for _ in range(100_000):
            change = 0.0
            for i in range(len(b)):
                partial = m.covariance[i] - m.gram[i] @ b + m.gram[i, i] * b[i]
                value = np.sign(partial) * max(abs(partial) - l1, 0.0) / (m.gram[i, i] + l2)
                change, b[i] = max(change, abs(value - b[i])), value
            if change < 1e-13:
                break
        else:
            raise RuntimeError("coordinate descent did not converge")
        found[l1, l2] = b.copy()
    return [found[p] for p in grid]


def path_frame(rows: DataFrame, roles: DataFrame, features: Sequence[str], grid: Sequence[tuple[float, float]], *,
               keys: Sequence[str] = FOLD, weight: str | None = None) -> DataFrame:
    """(keys, lines): per fold, for every penalty an array of an intercept and one slope for each feature. One aggregation."""
    found = moments(fold_rows(rows, roles, "train", keys), features, weight=weight, keys=keys)
    out = []
    for key, m in sorted(found.items()):
        lines = []
        for b in solve_path(m, grid):
            slopes = b / m.scales
            lines.append([float(m.target_mean - slopes @ m.means), *map(float, slopes)])
        out.append((*[int(k) for k in key], lines))
    return rows.sparkSession.createDataFrame(out, ", ".join(f"{k} int" for k in keys) + ", lines array<array<double>>")


def with_target_ranks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with ``target_rank`` (tie-averaged, from 1, by date) and ``targets`` (known ones of the date), written once.

    Roles belong to dates, so a validation date has all its rows in each of its folds, and the same ranks.
    """
    kept = list(dict.fromkeys(["formation_date", "outcome_date", "security_id", "target", *columns]))
    placed = with_tie_ranks(rows.select(*kept), ["formation_date"], "target")
    ranked = placed.select(*kept, average_rank().alias("target_rank"), F.col("total").alias("targets"))
    # The number is given, so that short rows, each to be multiplied by folds and penalties, are not drawn together into a few tasks.
    return cut_lineage(ranked.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "security_id", "formation_date"))


def line(features: Sequence[str], at: Column) -> Column:
    """An intercept and one slope for each feature, applied to a row."""
    return sum((at[k] * F.col(f) for k, f in enumerate(features, 1)), at[0])


def path_predictions(rows: DataFrame, roles: DataFrame, features: Sequence[str], grid: Sequence[tuple[float, float]], *,
                     keys: Sequence[str] = FOLD, weight: str | None = None) -> DataFrame:
    """Validation rows with ``predictions``: one value for each penalty of the grid (MDL24, MDL26, MDL29).

    A fold without training rows gives no rows. The lines, a row for each fold, and the roles, one for each fold and date, are broadcast.
    """
    rows, roles = with_target_ranks(rows, [*features, *([weight] if weight else [])]), F.broadcast(roles)
    lines = path_frame(rows, roles, features, grid, keys=keys, weight=weight)
    return predicted_rows(rows, roles, lines, features, len(grid), keys)


def predicted_rows(rows: DataFrame, roles: DataFrame, lines: DataFrame, features: Sequence[str], size: int, keys: Sequence[str] = FOLD) -> DataFrame:
    """Validation rows of the folds that have ``lines``, with ``predictions`` by each of them."""
    valid = fold_rows(rows, roles, "validation", keys).join(F.broadcast(lines), list(keys))
    return valid.select(*keys, "formation_date", "outcome_date", "security_id", "target", "target_rank", "targets",
                        F.array(*[line(features, F.col("lines")[i]) for i in range(size)]).alias("predictions"))


def ranked_path(predicted: DataFrame, size: int, keys: Sequence[str] = FOLD) -> DataFrame:
    """A row for each penalty of a validation row: ``place`` (tie-averaged, from 1, by fold, date and penalty) and ``names``, the rows of the date."""
    cells = F.array(*[F.round(F.col("predictions")[i], PLACES) for i in range(size)])
    long = predicted.select(*keys, "formation_date", "outcome_date", "security_id", "target_rank", "targets", F.posexplode(cells).alias("penalty", "value"))
    pieces = RANK_PIECES * int(predicted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = with_tie_ranks(long, [*keys, "formation_date", "penalty"], "value", pieces=pieces)
    return placed.select(*keys, "formation_date", "outcome_date", "security_id", "penalty", "target_rank", average_rank().alias("place"),
                         F.greatest("total", "targets").alias("names"))


def rank_correlations(ranked: DataFrame, size: int, keys: Sequence[str] = FOLD) -> DataFrame:
    """(keys, formation_date, outcome_date, penalty, rank_ic) of the first ``size`` penalties: one row per penalty and date; zero where a side is flat."""
    by = [*keys, "formation_date", "outcome_date", "penalty"]
    return ranked.where(F.col("penalty") < size).groupBy(*by).agg(zero_if_flat(correlation("place", "target_rank")).alias("rank_ic"))


def month_balanced_mean(daily: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the dates of a month, then of months, per keys and penalty."""
    month = F.date_trunc("month", "formation_date").alias("month")
    months = daily.groupBy(*keys, "penalty", month).agg(F.avg("rank_ic").alias("_v"))
    return months.groupBy(*keys, "penalty").agg(F.avg("_v").alias("mean_rank_ic"), F.count(F.lit(1)).alias("months"))


def with_penalties(frame: DataFrame, grid: Sequence[tuple[float, float]]) -> DataFrame:
    """l1 and l2 beside the place of a penalty in the grid."""
    value = lambda at: F.element_at(F.array(*[F.lit(float(p[at])) for p in grid]), F.col("penalty") + 1)
    return frame.withColumn("l1", value(0)).withColumn("l2", value(1))


def strongest_near_best(scores: DataFrame, keys: Sequence[str], tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Of the penalties whose ``mean_rank_ic`` is within the tolerance of the best, the greatest (l1, l2) (MDL24)."""
    best = F.max("mean_rank_ic").over(Window.partitionBy(*keys))
    near = scores.withColumn("_best", best).where(F.round(F.col("mean_rank_ic"), 9) >= F.round(F.col("_best") - tolerance, 9))
    picked = near.groupBy(*keys).agg(F.max(F.struct("l1", "l2", "penalty", "mean_rank_ic")).alias("x"))
    return picked.select(*keys, "x.l1", "x.l2", "x.penalty", "x.mean_rank_ic")


def as_of_scores(daily: DataFrame, starts: DataFrame) -> DataFrame:
    """Month-balanced mean of each penalty over the dates whose outcome came before an episode's start (MDL26).

    ``daily`` has outer_fold, formation_date, outcome_date, penalty, rank_ic; ``starts`` has outer_fold, inner_fold
    and start. A date that joins moves its month's mean; running sums of these moves, in order of outcomes, give every
    start its total in one sweep, without a product of dates and starts.
    """
    month = Window.partitionBy("outer_fold", "penalty", "month").orderBy("outcome_date", "formation_date").rowsBetween(Window.unboundedPreceding, 0)
    moves = daily.withColumn("month", F.date_trunc("month", "formation_date")).withColumn("_mean", F.avg("rank_ic").over(month)).withColumn("_n", F.count(F.lit(1)).over(month))
    before = F.lag("_mean").over(Window.partitionBy("outer_fold", "penalty", "month").orderBy("outcome_date", "formation_date"))
    moves = moves.select(
        "outer_fold", "penalty", F.lit(None).cast("int").alias("inner_fold"), F.col("outcome_date").alias("_at"), F.lit(1).alias("_kind"),
        (F.col("_mean") - F.coalesce(before, F.lit(0.0))).alias("_move"), (F.col("_n") == 1).cast("long").alias("_new"))
    asked = starts.join(daily.select("outer_fold", "penalty").distinct(), "outer_fold").select(
        "outer_fold", "penalty", "inner_fold", F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.lit(0.0).alias("_move"), F.lit(0).cast("long").alias("_new"))
    sweep = Window.partitionBy("outer_fold", "penalty").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = moves.unionByName(asked).withColumn("_total", F.sum("_move").over(sweep)).withColumn("months", F.sum("_new").over(sweep))
    return swept.where("_kind = 0 AND months > 0").select("outer_fold", "inner_fold", "penalty", (F.col("_total") / F.col("months")).alias("mean_rank_ic"), "months")


def centred(rank: Column, names: Column) -> Column:
    """Ranks from -1 to 1; null for a single name."""
    return F.when(names > 1, (rank - 1) / (names - 1) * 2 - 1)


def all_roles(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Roles of outer folds (as inner fold 0) and of inner ones, in one frame."""
    return outer.withColumn("inner_fold", F.lit(0)).unionByName(inner).select(*FOLD, "formation_date", "role")


def tuned_anchors(rows: DataFrame, outer: DataFrame, inner: DataFrame, features: Sequence[str], grid: Sequence[tuple[float, float]], *,
                  weight: str | None = None, tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Cross-fitted anchors whose penalty is chosen from earlier outcomes alone (MDL26).

    An outer validation block takes the penalty that its inner folds choose, from dates whose outcome came
    before the block. The inner folds of the first outer fold are blocks too, but for the earliest, which only
    tunes: each takes the penalty of the inner folds before it. Columns: outer_fold, inner_fold (0 for outer
    blocks), formation_date, security_id, l1, l2, anchor_rank (from -1 to 1).
    """
    size, inputs = len(grid), [*features, *([weight] if weight else [])]
    rows, roles = with_target_ranks(rows, inputs), F.broadcast(cut_lineage(all_roles(outer, inner)))  # a role for each fold and date
    lines = path_frame(rows, roles, features, grid, weight=weight)
    dates = fold_rows(rows.select("formation_date").distinct(), roles, "validation", FOLD).join(F.broadcast(lines), FOLD)
    starts = cut_lineage(dates.groupBy(*FOLD).agg(F.min("formation_date").alias("start")))
    first = starts.where("inner_fold > 0").agg(F.min("outer_fold").alias("f")).first()["f"]
    if first is None:
        chain = starts.where("false")
    else:
        chain = starts.where(F.col("inner_fold") == 0).unionByName(starts.where((F.col("outer_fold") == first) & (F.col("inner_fold") > 1)))
    tried = predicted_rows(rows, roles.where("inner_fold > 0"), lines, features, size)
    daily = cut_lineage(rank_correlations(ranked_path(tried, size), size).drop("inner_fold"))  # a row for each fold, date and penalty
    chosen = strongest_near_best(with_penalties(as_of_scores(daily, chain), grid), FOLD, tolerance)
    picked = F.array(F.element_at("lines", F.col("penalty") + 1)).alias("lines")
    blocks = cut_lineage(chosen.join(F.broadcast(lines), FOLD).select(*FOLD, "l1", "l2", picked))  # a row for each block
    ranked = ranked_path(predicted_rows(rows, roles, blocks.drop("l1", "l2"), features, 1), 1)
    anchors = ranked.join(F.broadcast(blocks.drop("lines")), FOLD)
    return anchors.select(*FOLD, "formation_date", "security_id", "l1", "l2", centred(F.col("place"), F.col("names")).alias("anchor_rank"))


def swap_series(rows: DataFrame, roles: DataFrame, features: Sequence[str], current: tuple[float, float], new: tuple[float, float], *,
                size: int = 20, weight: str | None = None) -> DataFrame:
    """Two penalties on the same folds, date by date: rank correlations, their difference, and top names that differ (MDL29)."""
    keys = ["outer_fold"]
    predicted = path_predictions(rows, roles, features, [current, new], keys=keys, weight=weight)
    daily = rank_correlations(ranked_path(predicted, 2, keys), 2, keys)
    of = lambda i: F.max(F.when(F.col("penalty") == i, F.col("rank_ic")))
    series = daily.groupBy(*keys, "formation_date").agg(of(0).alias("current_rank_ic"), of(1).alias("new_rank_ic"))
    long = predicted.select(*keys, "formation_date", "security_id", F.posexplode("predictions").alias("penalty", "value"))
    order = Window.partitionBy(*keys, "formation_date", "penalty").orderBy(F.round("value", PLACES).desc(), "security_id")
    top = long.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size)
    alone = top.groupBy(*keys, "formation_date", "security_id").agg(F.max("penalty").alias("_last"), F.count(F.lit(1)).alias("_n"))
    differ = alone.groupBy(*keys, "formation_date").agg(F.count_if((F.col("_n") == 1) & (F.col("_last") == 1)).alias("names_different"))
    return series.join(differ, [*keys, "formation_date"]).withColumn("delta", F.col("new_rank_ic") - F.col("current_rank_ic"))


def eight_inputs(wide: DataFrame, signal: DataFrame, base: Sequence[str], momentum: str, strength: str) -> DataFrame:
    """The base percentiles and two products of a centred percentile with the market signal known at the formation (MDL23).

    ``signal`` has session_date and market_signal. A formation takes the last session of the month before it.
    """
    month = F.add_months(F.trunc("session_date", "month"), 1).alias("formation_date")
    known = signal.groupBy(month).agg(F.max_by("market_signal", "session_date").alias("market_signal"))
    product = lambda name: (F.col(name) - 0.5) * F.col("market_signal")
    return wide.join(known, "formation_date").select(
        "formation_date", "security_id", "target", *base, product(momentum).alias("momentum_x_market"), product(strength).alias("strength_x_market"))


def model_summary(rows: DataFrame, size: int = 20) -> DataFrame:
    """Per model: rows, months, month-balanced rank IC, and what the top names earned, formations within months first (EVL19).

    ``short_formations`` counts dates with fewer rows than ``size``: their top is all they have, and a caller
    that asks for whole tops must refuse a model with any.
    """
    keys = ["model_key", "formation_date"]
    ranked = cut_lineage(with_tie_ranks(rows, keys, "prediction").withColumn("_p", average_rank()).drop("below", "ties", "total"))
    both = with_tie_ranks(ranked, keys, "actual").withColumn("_a", average_rank())
    order = Window.partitionBy(*keys).orderBy(F.col("prediction").desc(), "security_id")
    daily = both.groupBy(*keys).agg(zero_if_flat(correlation("_p", "_a")).alias("rank_ic"), F.count(F.lit(1)).alias("names"))
    top = rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).groupBy(*keys).agg(F.avg("actual").alias("top"))
    months = daily.join(top, keys).groupBy("model_key", F.trunc("formation_date", "month").alias("month")).agg(
        F.avg("rank_ic").alias("ic"), F.avg("top").alias("top"), F.sum("names").alias("rows_count"), F.count_if(F.col("names") < size).alias("short"))
    return months.groupBy("model_key").agg(
        F.sum("rows_count").alias("paired_rows"), F.count(F.lit(1)).alias("months"), F.avg("ic").alias("mean_monthly_rank_ic"),
        F.avg("top").alias("top_gross"), F.sum("short").alias("short_formations"))


def block_means(rows: DataFrame) -> DataFrame:
    """Per model and outer fold: month-balanced rank IC, share of months above zero, and mean absolute error (EVL07, EVL19)."""
    keys = ["model_key", "outer_fold", "formation_date"]
    ranked = with_tie_ranks(rows, keys, "prediction").withColumn("_p", average_rank()).drop("below", "ties", "total")
    both = with_tie_ranks(ranked, keys, "actual").withColumn("_a", average_rank())
    daily = both.groupBy(*keys).agg(
        zero_if_flat(correlation("_p", "_a")).alias("rank_ic"), F.sum(F.abs(F.col("prediction") - F.col("actual"))).alias("off"), F.count(F.lit(1)).alias("n"))
    months = daily.groupBy("model_key", "outer_fold", F.trunc("formation_date", "month").alias("month")).agg(
        F.avg("rank_ic").alias("ic"), F.sum("off").alias("off"), F.sum("n").alias("n"))
    return months.groupBy("model_key", "outer_fold").agg(
        F.count(F.lit(1)).alias("months"), F.avg("ic").alias("mean_monthly_rank_ic"), (F.count_if(F.col("ic") > 0) / F.count(F.lit(1))).alias("positive_share"),
        (F.sum("off") / F.sum("n")).alias("mae"))
