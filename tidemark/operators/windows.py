"""Window features over a security's own sessions.

Rows are first made unique per (security, session) with a partial aggregation, so the
window partition of a security holds at most one row per calendar session however many
raw rows it has. All features of one basis share a single partitioning and sort.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import exact_quantiles
from ..functions.scalars import first_reason, safe_divide

YEAR = 252


def own():
    """A security's sessions in order. Built on demand: window specs need a running session."""
    return Window.partitionBy("security_id").orderBy("session_date")


def so_far():
    return own().rowsBetween(Window.unboundedPreceding, 0)


def series():
    """A benchmark series: one row per session, so the unpartitioned window is calendar-bounded."""
    return Window.partitionBy(F.lit(1)).orderBy("session_date")


def last(n: int):
    """Frame of the last ``n`` own sessions including the current one."""
    return own().rowsBetween(-(n - 1), 0)


def price_history(bars: DataFrame) -> DataFrame:
    """One row per security and session with its running history guard (WIN01).

    Like the full-history check it stands for, the guard looks at every session up to the row.
    """
    daily = bars.groupBy("security_id", "session_date").agg(
        F.max("close").alias("close"), F.max("volume").alias("volume"), F.count(F.lit(1)).alias("copies"), F.min("close").alias("_low"),
    )
    return daily.select(
        "security_id", "session_date", "close", "volume",
        F.row_number().over(own()).alias("history"),
        first_reason(
            (F.max("copies").over(so_far()) > 1, "duplicate_price_observation"),
            (F.min("_low").over(so_far()) <= 0, "nonpositive_price"),
        ).alias("guard"),
    )


def short_history(size: int) -> Column:
    return F.coalesce(F.col("guard"), F.when(F.col("history") < size, F.lit(f"insufficient_{size}_session_history")))


def guarded(df: DataFrame, name: str, value: Column, size: int, *extra: tuple[Column, str]) -> DataFrame:
    """Add ``name`` and ``name_reason``: exactly one of the two is set."""
    reason = short_history(size)
    for rule, text in extra:
        reason = F.coalesce(reason, F.when(rule, F.lit(text)))
    return df.withColumn(f"{name}_reason", reason).withColumn(name, F.when(F.col(f"{name}_reason").isNull(), value))


def back(column: str, n: int) -> Column:
    return F.lag(column, n).over(own())


def span_return(column: str, newest: int, oldest: int) -> Column:
    return safe_divide(back(column, newest) if newest else F.col(column), back(column, oldest)) - 1


def log_return() -> Column:
    positive = (F.col("close") > 0) & (back("close", 1) > 0)
    return F.when(positive, F.ln(F.col("close") / back("close", 1)))


def momentum_12_1(df: DataFrame) -> DataFrame:
    return guarded(df, "momentum_12_1", span_return("close", 21, 252), 253)


def short_term_reversal(df: DataFrame, *, skip_day: bool) -> DataFrame:
    """t-inclusive (WIN06) or skipping the formation day (WIN07)."""
    if skip_day:
        return guarded(df, "short_term_reversal_skip", span_return("close", 1, 21), 22)
    return guarded(df, "short_term_reversal_20d", span_return("close", 0, 20), 21)


def pieces(column: str, size: int, piece: int) -> list[Column]:
    """A frame of ``size`` own sessions as adjoining frames of ``piece``, of which ``column`` is an aggregate; newest first."""
    return [back(column, i) if i else F.col(column) for i in range(0, size, piece)]


def rolling_deviation(df: DataFrame, column: str, name: str, size: int, piece: int = 10) -> DataFrame:
    """Add the sample deviation of the last ``size`` own sessions; null under two values.

    A row adds up ``piece`` rows and joins the moments of ``size / piece`` such frames. Nothing is subtracted from a longer
    sum, so digits and odd values stay within their frames, and equal values have none.
    """
    frame = last(piece)
    count = F.count(column).over(frame)
    rows = df.withColumn("_piece", F.struct(count.alias("n"), F.avg(column).over(frame).alias("mean"), (F.var_pop(column).over(frame) * count).alias("m2")))
    names = [f"_piece{i}" for i in range(0, size, piece)]
    rows = rows.withColumns(dict(zip(names, pieces("_piece", size, piece))))
    none = F.lit(0.0)
    total = lambda value: sum((F.coalesce(value(F.col(p)), none) for p in names[1:]), F.coalesce(value(F.col(names[0])), none))
    rows = rows.withColumn("_n", total(lambda p: p["n"].cast("double"))).withColumn("_base", F.coalesce(*[F.col(p)["mean"] for p in names]))
    rows = rows.withColumn("_mean", F.col("_base") + safe_divide(total(lambda p: p["n"] * (p["mean"] - F.col("_base"))), F.col("_n")))
    apart = lambda p: p["mean"] - F.col("_mean")
    spread = total(lambda p: p["m2"] + p["n"] * apart(p) * apart(p))
    return rows.withColumn(name, F.when(F.col("_n") > 1, F.sqrt(safe_divide(spread, F.col("_n") - 1)))).drop("_piece", *names, "_n", "_base", "_mean")


def volatility_60d(df: DataFrame, name: str = "trailing_volatility_60d") -> DataFrame:
    rows = rolling_deviation(df.withColumn("r", log_return()), "r", "_deviation", 60)
    return guarded(rows, name, F.col("_deviation") * math.sqrt(YEAR), 61).drop("_deviation")


def downside_volatility_60d(df: DataFrame) -> DataFrame:
    rows = df.withColumn("r", log_return())
    squares = F.pow(F.least(F.col("r"), F.lit(0.0)), 2)
    return guarded(rows, "downside_volatility_60d", F.sqrt(F.avg(squares).over(last(60)) * YEAR), 61)


def median_dollar_volume_20d(df: DataFrame) -> DataFrame:
    """Exact median over the 20-row frame (the frame, not the history, is held), put together from frames of four."""
    rows = df.withColumn("dollars", F.col("close") * F.col("volume")).withColumn("_piece", F.collect_list("dollars").over(last(4)))
    rows = rows.withColumn("_sorted", F.sort_array(F.flatten(F.array(*pieces("_piece", 20, 4)))))
    middle = lambda up: F.get("_sorted", F.floor((F.size("_sorted") - 1 + up) / 2).cast("int"))
    median = F.when(F.size("_sorted") > 0, middle(0) * 0.5 + middle(1) * 0.5)
    return guarded(rows, "median_dollar_volume_20d", median, 20).drop("_piece", "_sorted")


def amihud_illiquidity_20d(adjusted: DataFrame, unadjusted: DataFrame) -> DataFrame:
    """Mean of |simple return| over unadjusted dollar volume, 20 sessions (WIN09, JN14)."""
    raw = unadjusted.select("security_id", "session_date", (F.col("close") * F.col("volume")).alias("dollars"))
    rows = adjusted.join(raw, ["security_id", "session_date"], "left").withColumn("simple", F.abs(span_return("close", 0, 1)))
    missing = F.count("dollars").over(last(20)) < 20
    bad = F.min("dollars").over(last(20)) <= 0
    ratio = safe_divide(F.col("simple"), F.col("dollars"))
    return guarded(
        rows, "amihud_illiquidity_20d", F.avg(ratio).over(last(20)), 21,
        (missing, "mismatched_adjusted_and_unadjusted_sessions"), (bad, "nonpositive_dollar_volume"),
    )


def with_benchmark(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    return df.join(benchmark.select("session_date", F.col("close").alias("benchmark_close")), "session_date", "left")


def relative_strength_6m(df: DataFrame, benchmark: DataFrame, sessions: DataFrame, *, strict: bool) -> DataFrame:
    """126-session return minus the benchmark's over the same sessions (WIN03).

    ``strict`` also demands that the own 127 sessions are the calendar's last 127 (JN13).
    """
    rows = with_benchmark(df, benchmark).join(sessions.select("session_date", "idx"), "session_date", "left")
    value = span_return("close", 0, 126) - span_return("benchmark_close", 0, 126)
    if strict:
        mismatch = ~F.coalesce(back("idx", 126) == F.col("idx") - 126, F.lit(False))
    else:
        rows = rows.withColumn("_known", F.count("benchmark_close").over(so_far()))
        mismatch = F.col("_known") - F.coalesce(back("_known", 127), F.lit(0)) < 127
    return guarded(rows, "relative_strength_6m", value, 127, (mismatch, "mismatched_127_session_benchmark_history")).drop("idx", "_known")


MOMENTS = ("n", "y", "x", "syy", "sxx", "sxy")


def pair_moments(frame) -> Column:
    """Count, means and centred sums of the pairs (r, b) of a frame."""
    found = (F.regr_count, F.regr_avgy, F.regr_avgx, F.regr_syy, F.regr_sxx, F.regr_sxy)
    return F.struct(*[fn("r", "b").over(frame).alias(name) for fn, name in zip(found, MOMENTS)])


def joined_moments(left: Column, right: Column) -> dict[str, Column]:
    """syy, sxx and sxy of two disjoint sets of pairs; null where neither has a pair."""
    size = lambda side: F.coalesce(side["n"], F.lit(0))
    n = size(left) + size(right)
    share = safe_divide(size(left) * size(right), n)
    apart = {c: left[c] - right[c] for c in ("y", "x")}
    none = F.lit(0.0)
    both = lambda a, b: F.when(n > 0, F.coalesce(left[f"s{a}{b}"], none) + F.coalesce(right[f"s{a}{b}"], none) + F.coalesce(
        apart[a] * apart[b] * share, none))
    return {"syy": both("y", "y"), "sxx": both("x", "x"), "sxy": both("x", "y")}


def rolling_pair_moments(df: DataFrame, size: int) -> DataFrame:
    """Add ``_syy``, ``_sxx``, ``_sxy`` of the pairs (r, b) of the last ``size`` own sessions, in constant work a row.

    Sessions fall into blocks of ``size``: a frame is the end of one block and the beginning of the next, and both
    are running aggregates of their block. Nothing is subtracted, so digits and odd values stay within their frames. Rows
    before the ``size``-th session cover what there is.
    """
    place = F.col("history") - 1
    rows = df.withColumn("_block", F.floor(place / size))
    block = Window.partitionBy("security_id", "_block")
    upto = block.orderBy("session_date").rowsBetween(Window.unboundedPreceding, 0)
    onward = block.orderBy(F.col("session_date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_onward", pair_moments(onward)).withColumn("_upto", pair_moments(upto))
    earlier = F.when(place % size < size - 1, F.lag("_onward", size - 1).over(own()))
    rows = rows.withColumn("_earlier", earlier)
    found = joined_moments(F.col("_earlier"), F.col("_upto"))
    return rows.withColumns({f"_{name}": value for name, value in found.items()}).drop("_block", "_onward", "_upto", "_earlier")


def idiosyncratic_volatility_60d(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Residual volatility of a 60-return regression on the benchmark, two fitted parameters (WIN11)."""
    both = (F.col("benchmark_close") > 0) & (back("benchmark_close", 1) > 0)
    rows = with_benchmark(df, benchmark).withColumn("r", log_return()).withColumn(
        "b", F.when(both, F.ln(F.col("benchmark_close") / back("benchmark_close", 1)))).withColumn(
        "_known", F.count("benchmark_close").over(so_far()))
    matched = F.col("_known") - F.coalesce(back("_known", 61), F.lit(0))
    rows = rolling_pair_moments(rows.withColumn("_matched", matched), 60)
    value = F.sqrt(F.greatest(F.col("_syy") - safe_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0)) / (60 - 2) * YEAR)
    return guarded(
        rows, "idiosyncratic_volatility_60d", value, 61,
        (F.col("_matched") < 61, "mismatched_61_session_benchmark_history"),
        (F.col("_sxx") <= 0, "zero_benchmark_variance"),
    ).drop("_known", "_matched", "_syy", "_sxx", "_sxy")


# ---- benchmark series ----


def market_trend_signal(benchmark: DataFrame, lookback: int = 60, clip: float = 0.30) -> DataFrame:
    """Clipped and scaled benchmark return (WIN12)."""
    raw = F.col("close") / F.lag("close", lookback).over(series()) - 1
    return benchmark.select("session_date", raw.alias("raw_return")).where("raw_return IS NOT NULL").withColumn(
        "market_signal", F.greatest(F.least(F.col("raw_return"), F.lit(clip)), F.lit(-clip)) / clip)


def interactions(percentiles: DataFrame, signal: DataFrame) -> DataFrame:
    """(percentile - 0.5) x market signal for the two momentum inputs (WIN13)."""
    joined = percentiles.join(signal, "session_date")
    return joined.withColumn("momentum_x_market", (F.col("momentum_percentile") - 0.5) * F.col("market_signal")).withColumn(
        "strength_x_market", (F.col("strength_percentile") - 0.5) * F.col("market_signal"))


def trend_key(trend: Column) -> Column:
    return F.when(trend >= 0.05, "bullish").when(trend <= -0.05, "bearish").otherwise("range_bound")


def benchmark_regimes(benchmark: DataFrame) -> DataFrame:
    """Trend and volatility regime per session (WIN14), trend alone (WIN15), trend and 59-return volatility (WIN18)."""
    rows = benchmark.select("session_date", "close").withColumn(
        "r", F.col("close") / F.lag("close", 1).over(series()) - 1).withColumn("n", F.row_number().over(series()))
    frame = lambda n: series().rowsBetween(-(n - 1), 0)
    rows = rows.withColumn("trend", F.when(F.col("n") >= 61, F.col("close") / F.lag("close", 60).over(series()) - 1)).withColumn(
        "vol", F.when(F.col("n") >= 61, F.stddev_pop("r").over(frame(60)) * math.sqrt(YEAR))).withColumn(
        "vol59", F.when(F.col("n") >= 61, F.stddev_pop("r").over(frame(59))))
    vol = F.when(F.col("vol") < 0.15, "low_vol").when(F.col("vol") >= 0.25, "high_vol").otherwise("normal_vol")
    ready = F.col("trend").isNotNull()
    return rows.select(
        "session_date", "trend", "vol", "vol59",
        F.when(ready, F.concat_ws("|", trend_key(F.col("trend")), vol)).otherwise("unavailable").alias("regime"),
        F.when(ready, trend_key(F.col("trend"))).otherwise("unavailable").alias("market_trend"),
    )


def volatility_tercile(percentile: Column) -> Column:
    """low < 1/3, middle <= 2/3, high (WIN16)."""
    return F.when(percentile < 1 / 3, "low").when(percentile <= 2 / 3, "middle").when(percentile <= 1, "high")


def fold_volatility_regime(sessions: DataFrame, folds: DataFrame) -> DataFrame:
    """Up/down by the sign of the trend, high/low by the fold's training-median volatility (WIN17).

    ``sessions`` has session_date, trend, vol59; ``folds`` has outer_fold, train_until, valid_from, valid_to.
    """
    ready = sessions.where("vol59 IS NOT NULL")
    training = ready.join(folds, ready.session_date < folds.train_until).select("outer_fold", "vol59")
    medians = exact_quantiles(training, ["outer_fold"], "vol59", {"threshold": 0.5})
    validation = ready.join(folds, (ready.session_date >= folds.valid_from) & (ready.session_date <= folds.valid_to))
    direction = F.when(F.col("trend") >= 0, "up").otherwise("down")
    level = F.when(F.col("vol59") >= F.col("threshold"), "high_vol").otherwise("low_vol")
    return validation.join(medians, "outer_fold").select("outer_fold", "session_date", F.concat_ws("_", direction, level).alias("regime"), "threshold")


def latest_two_closes(bars: DataFrame) -> DataFrame:
    """Latest and previous close per security in one aggregation (WIN19).

    The two newest sessions survive map-side pruning; the pivot then sees two rows per security.
    """
    newest = Window.partitionBy("security_id").orderBy(F.col("session_date").desc())
    two = bars.select("security_id", "session_date", "close").withColumn("pos", F.row_number().over(newest)).where("pos <= 2")
    at = lambda n, c: F.max(F.when(F.col("pos") == n, F.col(c)))
    return two.groupBy("security_id").agg(
        at(1, "session_date").alias("latest_session"), at(1, "close").alias("latest_close"), at(2, "close").alias("previous_close"),
    )


def at_a_glance(closes: DataFrame, share_facts: DataFrame) -> DataFrame:
    """Latest close, its change and market value from the latest share count (WIN20)."""
    shares = share_facts.groupBy("security_id").agg(F.max_by("value", F.struct("period_end", "available_at", "accession")).alias("shares"))
    return closes.join(shares, "security_id", "left").select(
        "security_id", "latest_session", "latest_close",
        (F.col("latest_close") / F.col("previous_close") - 1).alias("change"),
        (F.col("latest_close") * F.col("shares")).alias("market_value"),
    )


def missed_formations(sessions: DataFrame, runs: DataFrame, portfolios: DataFrame, as_of: Column) -> DataFrame:
    """Month-end sessions without a portfolio whose execution day has passed, with the reason (WIN21)."""
    crossing = sessions.where(
        (F.date_trunc("month", "session_date") < F.date_trunc("month", "next_session")) & (F.col("next_session") < as_of))
    crossing = crossing.select(F.col("session_date").alias("formation_date"), F.col("next_session").alias("execution_date"))
    done = runs.where("status = 'completed'").select(F.col("score_date").alias("formation_date"), F.lit(True).alias("_scored"))
    return crossing.join(portfolios.select("formation_date"), "formation_date", "left_anti").join(done, "formation_date", "left").select(
        "formation_date", "execution_date",
        F.when(F.col("_scored"), "execution_window_missed").otherwise("month_end_score_unavailable").alias("reason_code"))


def last_session_per(sessions: DataFrame, rule: str) -> DataFrame:
    """Formation dates: last session of the month, or of the ISO week (WIN22)."""
    if rule == "month":
        keys = [F.date_format("session_date", "yyyy-MM").alias("bucket")]
    else:
        iso_year = F.extract(F.lit("YEAROFWEEK"), F.col("session_date"))
        keys = [F.concat_ws("-", iso_year.cast("string"), F.lpad(F.weekofyear("session_date").cast("string"), 2, "0")).alias("bucket")]
    return sessions.groupBy(*keys).agg(F.max("session_date").alias("formation_date"))


def market_features(bars: DataFrame, unadjusted: DataFrame, benchmark: DataFrame, sessions: DataFrame) -> DataFrame:
    """All market features per security and session: one window sort for the adjusted basis, one for the other."""
    rows = price_history(bars)
    rows = momentum_12_1(rows)
    rows = relative_strength_6m(rows, benchmark, sessions, strict=False).drop("benchmark_close")
    rows = short_term_reversal(rows, skip_day=True)
    rows = volatility_60d(rows, "realized_volatility_60d").drop("r")
    rows = idiosyncratic_volatility_60d(rows, benchmark).drop("r", "b", "benchmark_close")
    liquid = median_dollar_volume_20d(price_history(unadjusted)).select(
        "security_id", "session_date", "median_dollar_volume_20d", "median_dollar_volume_20d_reason")
    return rows.join(liquid, ["security_id", "session_date"], "left")
