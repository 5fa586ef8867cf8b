"""Portfolio construction, accounting and attribution.

Baskets hold a fixed number of names per formation, so everything after selection is
bounded by formations x basket size; selection itself is a map-side pruned top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import top_rows
from ..functions.scalars import first_reason

ENTER, KEEP = 20, 30
COSTS = (5, 10, 25, 50)
YEAR = 252.0


def by_date():
    """Formations in order; one row per formation, so the unpartitioned window is bounded."""
    return Window.partitionBy(F.lit(1)).orderBy("formation_date")


def equal_weight_targets(scores: DataFrame, score: str, size: int = ENTER) -> DataFrame:
    """Top names by score desc, id asc at equal weight; short formations are dropped, not padded (PRT01)."""
    order = [F.col(score).desc(), F.col("security_id").asc()]
    picked = top_rows(scores, ["formation_date"], order, size, rank="target_rank")
    whole = picked.groupBy("formation_date").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == size)
    return picked.join(whole, "formation_date", "left_semi").select("formation_date", "security_id", "target_rank", F.lit(1.0 / size).alias("target_weight"))


def rebalance_chain(targets: DataFrame, periods: DataFrame, opens: DataFrame, starting_nav: float) -> DataFrame:
    """Sell everything and buy the targets at each next open (PRT02).

    Because every rebalance liquidates the book, NAV is the starting value times the product of
    basket growths. That turns the sequential ledger into one running product over formations.
    """
    marks = opens.select("security_id", F.col("session_date").alias("execution_date"), "open")
    exits = opens.select("security_id", F.col("session_date").alias("exit_date"), F.col("open").alias("exit_open"))
    rows = targets.join(periods, "formation_date").join(marks, ["security_id", "execution_date"]).join(exits, ["security_id", "exit_date"], "left")
    growth = rows.groupBy("formation_date").agg(F.sum(F.col("target_weight") * F.col("exit_open") / F.col("open")).alias("growth"))
    before = by_date().rowsBetween(Window.unboundedPreceding, -1)
    nav = growth.withColumn("starting_nav", F.lit(starting_nav) * F.coalesce(F.product("growth").over(before), F.lit(1.0))).drop("growth")
    return rows.join(nav, "formation_date").withColumn("notional", F.col("starting_nav") * F.col("target_weight")).withColumn(
        "quantity", F.col("notional") / F.col("open")).drop("exit_open")


def ledger_trades(book: DataFrame, periods: DataFrame, opens: DataFrame) -> DataFrame:
    """Buy rows of each formation and the sell rows of the previous book at the same open."""
    buys = book.select("formation_date", "execution_date", "security_id", F.lit("buy").alias("side"), "quantity", F.col("open").alias("price"), "notional")
    following = periods.select(F.col("execution_date").alias("exit_date"), F.col("formation_date").alias("next_formation"))
    at_exit = opens.select("security_id", F.col("session_date").alias("exit_date"), F.col("open").alias("price"))
    sells = book.select("security_id", "exit_date", "quantity").join(following, "exit_date").join(at_exit, ["security_id", "exit_date"]).select(
        F.col("next_formation").alias("formation_date"), F.col("exit_date").alias("execution_date"), "security_id", F.lit("sell").alias("side"),
        "quantity", "price", (F.col("quantity") * F.col("price")).alias("notional"))
    return buys.unionByName(sells)


def publishable(formations: DataFrame, targets: DataFrame, models: DataFrame, opens: DataFrame, existing: DataFrame, size: int = ENTER) -> DataFrame:
    """Reason each month-end formation can or cannot be published (PRT03)."""
    marks = opens.select("security_id", F.col("session_date").alias("execution_date"), F.lit(1).alias("_open"))
    named = formations.join(targets, "formation_date", "left").join(marks, ["security_id", "execution_date"], "left").groupBy("formation_date", "execution_date").agg(
        F.count("security_id").alias("targets"), F.count("_open").alias("opens"))
    versions = models.groupBy("formation_date").agg(F.count_distinct("model_version").alias("models"))
    done = existing.select("formation_date", F.lit(True).alias("_done"))
    rows = named.join(versions, "formation_date", "left").join(done, "formation_date", "left")
    reason = first_reason(
        (F.col("_done"), "already_published"), (F.coalesce("models", F.lit(0)) != 1, "not_one_model_version"),
        (F.col("targets") != size, "fewer_than_required_ranks"), (F.col("opens") < F.col("targets"), "missing_next_open"))
    return rows.select("formation_date", "execution_date", "targets", "opens", F.coalesce(reason, F.lit("publish")).alias("decision"))


def hysteresis(ranked: DataFrame, enter: int = ENTER, keep: int = KEEP) -> DataFrame:
    """Keep prior names still ranked within ``keep``, fill from the top to ``enter`` (PRT04).

    Selection depends on the previous one, so it runs in order per model, on at most ``keep``
    rows per formation. ``ranked`` has model_key, formation_date, security_id, rank.
    """
    def select(rows: pd.DataFrame) -> pd.DataFrame:
        chosen, prior = [], set()
        for formation, group in rows.sort_values(["formation_date", "rank"]).groupby("formation_date", sort=True):
            ids = list(group["security_id"])
            kept = [i for i in ids if i in prior]
            filled = (kept + [i for i in ids if i not in prior])[:enter]
            chosen.append(group[group["security_id"].isin(filled)])
            prior = set(filled)
        return pd.concat(chosen)[["model_key", "formation_date", "security_id", "rank"]] if chosen else rows

    bounded = ranked.where(F.col("rank") <= keep).select("model_key", "formation_date", "security_id", "rank")
    return bounded.groupBy("model_key").applyInPandas(select, "model_key string, formation_date date, security_id long, rank long")


def turnover_periods(selected: DataFrame, size: int = ENTER) -> DataFrame:
    """Retained, added and removed names and one-way turnover against the previous formation (PRT05)."""
    dates = selected.select("formation_date").distinct().withColumn("next_date", F.lead("formation_date").over(by_date()))
    carried = selected.join(dates, "formation_date").where("next_date IS NOT NULL").select(
        F.col("next_date").alias("formation_date"), "security_id", F.lit(1).alias("_prior"))
    counts = selected.join(carried, ["formation_date", "security_id"], "left").groupBy("formation_date").agg(
        F.count(F.lit(1)).alias("names"), F.count("_prior").alias("retained"))
    first = F.lag("formation_date").over(by_date()).isNull()
    return counts.select(
        "formation_date", "names", "retained", (size - F.col("retained")).alias("additions"),
        F.when(first, 0).otherwise(size - F.col("retained")).alias("removals"),
        F.when(first, 1.0).otherwise(1.0 - F.col("retained") / size).alias("one_way_turnover"))


def labelled_periods(selected: DataFrame, outcomes: DataFrame, ranked: DataFrame | None = None, *, minimum: int = 30) -> DataFrame:
    """Return of each formation's names, withheld with the reasons where one of them has no label (PRT05).

    ``selected`` has formation_date and security_id, ``outcomes`` also security_return, benchmark_return and
    reason (for names without a return). Names of one formation that disagree on the benchmark fail the job, and so does a
    formation with fewer than ``minimum`` different names in ``ranked``.
    """
    if ranked is not None:
        counts = ranked.groupBy("formation_date").agg(F.count_distinct("security_id").alias("_names"))
        few = F.when(F.col("_names") < minimum, F.raise_error(F.concat(F.lit(f"fewer than {minimum} ranked names on "), F.col("formation_date").cast("string"))).cast("string"))
        selected = selected.join(counts.where(few.isNull()).select("formation_date"), "formation_date")
    rows = selected.join(outcomes, ["formation_date", "security_id"], "left")
    missing = F.col("security_return").isNull()
    periods = rows.groupBy("formation_date").agg(
        F.count(F.lit(1)).alias("names"), F.count("security_return").alias("labelled"), F.avg("security_return").alias("_return"),
        F.min(F.when(~missing, F.col("benchmark_return"))).alias("_low"), F.max(F.when(~missing, F.col("benchmark_return"))).alias("_high"),
        F.array_join(F.array_sort(F.collect_set(F.when(missing, F.coalesce("reason", F.lit("missing_label"))))), ",").alias("_reasons"))
    differ = F.when(F.col("_low") != F.col("_high"), F.raise_error(F.concat(F.lit("names disagree on the benchmark on "), F.col("formation_date").cast("string"))).cast("string"))
    whole = F.col("labelled") == F.col("names")
    return periods.where(differ.isNull()).select(
        "formation_date", "names", "labelled", F.when(whole, F.col("_return")).alias("portfolio_return"), F.when(whole, F.col("_low")).alias("benchmark_return"),
        F.when(whole, F.col("_return") - F.col("_low")).alias("relative_return"), F.when(~whole, F.concat(F.lit("selected_outcome_unavailable:"), "_reasons")).alias("reason"))


def period_summary(periods: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean gross, compounded, recurring turnover, net by cost case and break-even cost (PRT06).

    ``periods`` has formation_date, gross_return, benchmark_return, one_way_turnover; complete rows only.
    """
    ordered = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("formation_date")
    rows = periods.withColumn("_first", F.row_number().over(ordered) == 1).withColumn("relative", F.col("gross_return") - F.col("benchmark_return"))
    compound = lambda c: F.product(1 + F.col(c)) - 1
    net = [F.avg(F.col("relative") - F.col("one_way_turnover") * c / 10000.0).alias(f"net_{c}bp") for c in COSTS]
    break_even = F.avg("relative") / F.when(F.avg("one_way_turnover") > 0, F.avg("one_way_turnover")) * 10000.0
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("formations"), F.avg("relative").alias("mean_gross_relative"), compound("gross_return").alias("cumulative_portfolio"),
        compound("benchmark_return").alias("cumulative_benchmark"), F.avg(F.when(~F.col("_first"), F.col("one_way_turnover"))).alias("recurring_turnover"),
        *net, break_even.alias("break_even_bp"))


def cost_report(trades: DataFrame, navs: DataFrame, cases: Sequence[int] = (1, 5, 10, 20)) -> DataFrame:
    """Cost of all traded notional per cost case and one-way turnover (PRT07)."""
    totals = trades.groupBy("formation_date").agg(
        F.sum("notional").alias("gross_notional"), F.sum(F.when(F.col("side") == "buy", F.col("notional"))).alias("_buys")).join(navs, "formation_date")
    return totals.withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in cases]))).select(
        "formation_date", "cost_bps", "gross_notional", (F.col("_buys") / F.col("starting_nav")).alias("one_way_turnover"),
        (F.col("gross_notional") * F.col("cost_bps") / 10000.0).alias("total_cost"),
        (F.col("starting_nav") - F.col("gross_notional") * F.col("cost_bps") / 10000.0).alias("nav_after_cost"))


def cost_adjusted(gross: Column, bps: Column | float) -> Column:
    """(1 + g)(1 - c)^2 - 1 (PRT08)."""
    return (1 + gross) * F.pow(1 - bps / 10000.0, 2) - 1


def liquidity_gate(targets: DataFrame, liquidity: DataFrame, floor: float) -> DataFrame:
    """Targets without a liquidity snapshot or below the floor, counted per formation (PRT09)."""
    rows = targets.join(liquidity, ["formation_date", "security_id"], "left")
    missing, illiquid = F.col("median_dollar_volume").isNull(), F.col("median_dollar_volume") < floor
    return rows.groupBy("formation_date").agg(
        F.count(F.lit(1)).alias("targets"), F.count_if(missing).alias("missing"), F.count_if(illiquid).alias("illiquid")).withColumn(
        "passed", (F.col("missing") == 0) & (F.col("illiquid") == 0))


def performance(nav: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cumulative and relative return, CAGR, volatility, Sharpe, Sortino, drawdown, Calmar (PRT10).

    ``nav`` has session_date, portfolio_nav, benchmark_nav; one row per session and series.
    """
    own = Window.partitionBy(*keys).orderBy("session_date")
    peak = F.max("portfolio_nav").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = nav.withColumn("r", F.col("portfolio_nav") / F.lag("portfolio_nav").over(own) - 1).withColumn("_drawdown", F.col("portfolio_nav") / peak - 1)
    edge = lambda c: F.max_by(c, "session_date") / F.min_by(c, "session_date") - 1
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), edge("portfolio_nav").alias("portfolio_return"), edge("benchmark_nav").alias("benchmark_return"),
        F.count("r").alias("_n"), F.avg("r").alias("_mean"), F.stddev_samp("r").alias("_sd"),
        F.sqrt(F.avg(F.pow(F.least(F.col("r"), F.lit(0.0)), 2))).alias("_down"), F.min("_drawdown").alias("max_drawdown")).where("observations >= 2")
    over = lambda a, b: a / F.when(b != 0, b)
    cagr = F.exp(F.ln(1 + F.col("portfolio_return")) / (F.col("_n") / YEAR)) - 1
    return stats.select(
        *keys, "observations", "portfolio_return", "benchmark_return", (F.col("portfolio_return") - F.col("benchmark_return")).alias("relative_return"),
        cagr.alias("cagr"), (F.col("_sd") * YEAR**0.5).alias("volatility"), (over(F.col("_mean"), F.col("_sd")) * YEAR**0.5).alias("sharpe"),
        (over(F.col("_mean"), F.col("_down")) * YEAR**0.5).alias("sortino"), "max_drawdown", over(cagr, F.abs("max_drawdown")).alias("calmar"))


def portfolio_history(runs: DataFrame, weights: DataFrame, missed: DataFrame, limit: int) -> DataFrame:
    """Official runs with the previous run and turnover, united with missed formations, newest first (PRT11)."""
    linked = runs.withColumn("previous", F.lag("formation_date").over(by_date()))
    carried = linked.select("formation_date", F.col("previous").alias("_p")).where("_p IS NOT NULL").join(
        weights.withColumnRenamed("formation_date", "_p"), "_p").select("formation_date", "security_id", F.col("target_weight").alias("_before"))
    change = weights.join(carried, ["formation_date", "security_id"], "full").groupBy("formation_date").agg(
        (F.sum(F.abs(F.coalesce("target_weight", F.lit(0.0)) - F.coalesce("_before", F.lit(0.0)))) / 2).alias("turnover"))
    official = linked.join(change, "formation_date", "left").select(
        "formation_date", F.lit("official").alias("state"), "previous", F.when(F.col("previous").isNotNull(), F.col("turnover")).alias("turnover"))
    gone = missed.select("formation_date", F.lit("missed").alias("state"), F.lit(None).cast("date").alias("previous"), F.lit(None).cast("double").alias("turnover"))
    return official.unionByName(gone).orderBy(F.col("formation_date").desc()).limit(limit)


def truthfulness_audit(runs: DataFrame, positions: DataFrame, trades: DataFrame, scores: DataFrame, sessions: DataFrame, missed: DataFrame, size: int = ENTER) -> DataFrame:
    """Integrity findings per official portfolio, one row each (PRT12).

    The per-run counts become grouped joins; the rules are one array of conditions.
    """
    calendar = sessions.select(F.col("session_date").alias("formation_date"), F.col("next_session").alias("expected_execution"), F.lit(True).alias("_session"))
    held = positions.join(scores.select("formation_date", "security_id", "score_rank"), ["formation_date", "security_id"], "left").groupBy("formation_date").agg(
        F.count(F.lit(1)).alias("_positions"), F.count_if(F.col("score_rank") <= size).alias("_top"))
    bought = trades.where("side = 'buy'").groupBy("formation_date").agg(F.count(F.lit(1)).alias("_buys"), F.sum("notional").alias("_spent"))
    versions = scores.groupBy("formation_date").agg(F.count_distinct("model_version").alias("_models"))
    rows = runs
    for part in (calendar, held, bought, versions, missed.select("formation_date", F.lit(True).alias("_missed"))):
        rows = rows.join(part, "formation_date", "left")
    month_end = F.date_trunc("month", "formation_date") < F.date_trunc("month", "expected_execution")
    number = lambda c: F.coalesce(c, F.lit(0))
    rules = [
        ("formation_not_a_session", F.col("_session").isNull()), ("execution_not_next_open", ~F.col("execution_date").eqNullSafe(F.col("expected_execution"))),
        ("formation_not_month_end", ~F.coalesce(month_end, F.lit(False))), ("not_one_model", number("_models") != 1),
        ("position_count", number("_positions") != size), ("buy_count", number("_buys") != size), ("positions_not_top_ranked", number("_top") != size),
        ("nav_does_not_tie", F.abs(number("_spent") + F.col("ending_cash") - F.col("starting_nav")) > 0.01), ("both_missed_and_official", F.coalesce("_missed", F.lit(False))),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return rows.select("formation_date", F.explode(found).alias("finding"))


def selection_manifest(rows: DataFrame, size: int = ENTER) -> DataFrame:
    """Last date of each month; top names by baseline rank and by prediction (PRT13).

    ``rows`` has formation_date, security_id, baseline_rank, prediction.
    """
    month = F.date_trunc("month", "formation_date")
    last = rows.groupBy(month.alias("_m")).agg(F.max("formation_date").alias("formation_date"))
    kept = rows.join(last.select("formation_date"), "formation_date", "left_semi")
    baseline = top_rows(kept, ["formation_date"], [F.col("baseline_rank").asc(), F.col("security_id").asc()], size, rank="place").withColumn("book", F.lit("baseline"))
    model = top_rows(kept, ["formation_date"], [F.col("prediction").desc(), F.col("security_id").asc()], size, rank="place").withColumn("book", F.lit("model"))
    return baseline.unionByName(model).select("formation_date", "book", "place", "security_id")


def score_by_fold(rows: DataFrame, folds: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Map each formation to exactly one fold block and score it with that fold's coefficients (PRT14).

    ``rows`` is long (formation_date, security_id, feature_key, value); ``coefficients`` has
    outer_fold, feature_key, coefficient, mean, scale and ``folds`` outer_fold, valid_from, valid_to.
    """
    dates = rows.select("formation_date").distinct()
    mapped = dates.join(folds, (F.col("formation_date") >= F.col("valid_from")) & (F.col("formation_date") <= F.col("valid_to")))
    single = mapped.groupBy("formation_date").agg(F.count(F.lit(1)).alias("_blocks"), F.max("outer_fold").alias("outer_fold")).where("_blocks = 1").drop("_blocks")
    scored = rows.join(single, "formation_date").join(coefficients, ["outer_fold", "feature_key"])
    z = (F.col("value") - F.col("mean")) / F.col("scale")
    return scored.groupBy("outer_fold", "formation_date", "security_id").agg(
        F.sum(F.col("coefficient") * z).alias("prediction"), F.count(z).alias("_have"), F.count(F.lit(1)).alias("_need")).where("_have = _need").drop("_have", "_need")
