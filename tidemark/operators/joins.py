"""Point-in-time joins: as-of, interval, lateral-latest, semi/anti, full outer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.asof import expand_versions, latest_per_key, version_intervals
from ..functions.calendar import window_sessions, with_next_session
from ..functions.ranks import top_rows
from ..functions.scalars import filing_available_at, observed_available_at


def facts_as_of(facts: DataFrame, keys: Sequence[str], decision: Column, order: Sequence[str]) -> DataFrame:
    """Latest version per fact key at one decision (JN01)."""
    return latest_per_key(facts.where(F.col("available_at") <= decision), keys, order)


def facts_as_of_each(facts: DataFrame, keys: Sequence[str], decisions: DataFrame, order: Sequence[str], at: str = "available_at") -> DataFrame:
    """Latest version per fact key at every decision, without a formations x history join (JN01, JN03)."""
    return expand_versions(version_intervals(facts, keys, decisions, at, order), decisions)


def fact_candidates(legacy: DataFrame, observed: DataFrame) -> DataFrame:
    """Union of filing facts and observations, each with its availability rule (JN02, SET01)."""
    columns = ["security_id", "concept", "period_end", "value", "available_at", "availability_rule"]
    old = legacy.withColumn("available_at", filing_available_at(F.col("accepted_at"))).withColumn(
        "availability_rule", F.lit("accepted_plus_buffer"))
    new = observed.withColumn("available_at", observed_available_at(F.col("accepted_at"), F.col("observed_at"))).withColumn(
        "availability_rule", F.lit("max_accepted_plus_buffer_observed"))
    return old.select(*columns).unionByName(new.select(*columns))


def latest_claim(claims: DataFrame, formations: DataFrame) -> DataFrame:
    """Latest dated claim per security known at every formation (JN04, SET04)."""
    return facts_as_of_each(claims, ["security_id"], formations, ["as_of_date", "available_at"])


def latest_snapshot_members(snapshots: DataFrame, members: DataFrame, day: Column) -> DataFrame:
    """Members of the newest snapshot dated on or before ``day`` (JN05)."""
    newest = snapshots.where(F.col("as_of_date") <= day).agg(F.max("as_of_date").alias("as_of_date"))
    return members.join(newest, "as_of_date", "left_semi")


def counted_rows(rows: DataFrame) -> DataFrame:
    """Equal rows once, with their number."""
    return rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("_copies"))


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as ``_copies`` says."""
    return rows.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_copies")))).drop("_copy", "_copies")


def listing_on(rows: DataFrame, listings: DataFrame, day: str) -> DataFrame:
    """Ticker valid on the row's date, falling back to the open listing (JN06).

    Two conditional maxima per (row, security) replace a sort: valid listing first, open one second.
    """
    pairs = counted_rows(rows).join(listings, "security_id", "left")
    valid = (F.col("valid_from") <= F.col(day)) & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    current = F.col("valid_to").isNull() & F.col("ticker").isNotNull()
    pick = lambda rule: F.max_by(F.when(rule, F.col("ticker")), F.when(rule, F.col("valid_from")))
    found = pairs.groupBy(*rows.columns, "_copies").agg(
        F.coalesce(pick(valid), pick(current)).alias("ticker"), F.coalesce(F.max(valid), F.lit(False)).alias("valid_on_day"),
    )
    return repeated(found)


def latest_ticker(rows: DataFrame, listings: DataFrame, day: str) -> DataFrame:
    """Latest listing starting on or before the row's date; "Unavailable" when none (JN07)."""
    pairs = counted_rows(rows).join(listings.select("security_id", "ticker", "valid_from"), "security_id", "left")
    started = F.col("valid_from") <= F.col(day)
    pick = F.max_by(F.when(started, F.col("ticker")), F.when(started, F.col("valid_from")))
    return repeated(pairs.groupBy(*rows.columns, "_copies").agg(F.coalesce(pick, F.lit("Unavailable")).alias("ticker")))


def next_session(days: DataFrame, sessions: DataFrame, day: str = "day") -> DataFrame:
    """First session strictly after any calendar date (JN08)."""
    return with_next_session(days, sessions, day)


def outcome_offsets(executions: DataFrame, sessions: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Checkpoint date: the h-th session with the execution session as number one (JN10, SET06)."""
    index = sessions.select("session_date", "idx")
    started = executions.join(index.withColumnsRenamed({"session_date": "execution_date", "idx": "_start"}), "execution_date")
    stepped = started.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("idx", F.col("_start") + F.col("horizon") - 1)
    return stepped.join(index.withColumnRenamed("session_date", "checkpoint_date"), "idx").drop("idx", "_start")


def actions_in_windows(actions: DataFrame, sessions: DataFrame, windows: DataFrame, horizon: int = 20) -> DataFrame:
    """Actions dated in (entry, outcome] of each window, as an equi join on the session (JN11).

    An action is moved to the session on or after its date, which lies in the window exactly when
    the date does; the small window x session table then joins on equality.
    """
    dated = with_next_session(actions.withColumn("day", F.coalesce("effective_date", "process_date")), sessions, "day", on_or_after=True)
    dated = dated.withColumnRenamed("following_session", "session_date")
    path = window_sessions(sessions, windows, horizon).where("step > 0")
    return dated.join(path.select("session_date", "formation_date", "entry_date", "outcome_date"), "session_date").drop("day")


def price_paths(bars: DataFrame, sessions: DataFrame, windows: DataFrame, price: str, horizon: int = 20) -> DataFrame:
    """Bars on each window's path, with the number found per security and window (JN12).

    The window x session table is bounded by the calendar; bars meet only their own windows.
    """
    path = window_sessions(sessions, windows, horizon)
    return bars.select("security_id", "session_date", F.col(price).alias("price"), "available_at").join(path, "session_date")


def benchmark_alignment(bars: DataFrame, sessions: DataFrame, length: int = 127) -> DataFrame:
    """Whether the last ``length`` own sessions are the calendar's last ``length`` (JN13).

    Own sessions are a subset of the calendar, so the lists agree exactly when the first one does.
    """
    own = Window.partitionBy("security_id").orderBy("session_date")
    indexed = bars.join(sessions.select("session_date", "idx"), "session_date")
    return indexed.select(
        "security_id", "session_date", "idx",
        (F.lag("idx", length - 1).over(own) == F.col("idx") - (length - 1)).alias("aligned"),
    )


def paired_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], evidence: Sequence[str]) -> DataFrame:
    """Common keys of two samples with a flag for differing evidence (JN15)."""
    l, r = left.alias("l"), right.alias("r")
    same = F.lit(True)
    for column in evidence:
        same = same & F.col(f"l.{column}").eqNullSafe(F.col(f"r.{column}"))
    joined = l.join(r, list(keys))
    return joined.select(*keys, same.alias("evidence_matches"), F.col("l.prediction").alias("candidate"), F.col("r.prediction").alias("reference"))


def common_sample(predictions: DataFrame, keys: Sequence[str], configurations: int) -> DataFrame:
    """Rows whose key is scored under every configuration (JN16)."""
    full = predictions.groupBy(*keys).agg(F.count_distinct("model_key").alias("_models")).where(F.col("_models") == configurations)
    return predictions.join(full.select(*keys), list(keys), "left_semi")


def completed_snapshots(scores: DataFrame, runs: DataFrame) -> DataFrame:
    """Snapshots of completed runs (JN17)."""
    return scores.join(runs.where("status = 'completed'").select("score_date"), "score_date", "left_semi")


def due_unlabelled(scores: DataFrame, outcomes: DataFrame, sessions: DataFrame, horizon: int) -> DataFrame:
    """Eligible snapshots with at least ``horizon`` later sessions and no outcome yet (JN18)."""
    last = Window.partitionBy(F.lit(1))
    reach = sessions.select("session_date", (F.max("idx").over(last) - F.col("idx") + 1).alias("_ahead")).where(F.col("_ahead") >= horizon)
    placed = with_next_session(scores.where("eligible"), sessions, "score_date")
    due = placed.join(reach.select(F.col("session_date").alias("following_session")), "following_session", "left_semi").select(*scores.columns)
    return due.join(outcomes.where(F.col("horizon") == horizon), ["security_id", "score_date"], "left_anti")


def previous_scored_date(runs: DataFrame, scores: DataFrame, day: Column) -> DataFrame:
    """Latest completed date before ``day`` that has snapshots (JN19)."""
    done = runs.where((F.col("status") == "completed") & (F.col("score_date") < day))
    return done.join(scores.select("score_date"), "score_date", "left_semi").agg(F.max("score_date").alias("previous_date"))


def weight_turnover(weights: DataFrame) -> DataFrame:
    """Half the absolute weight change between consecutive dates, missing counted as zero (JN20)."""
    dates = weights.select("score_date").distinct().withColumn(
        "next_date", F.lead("score_date").over(Window.partitionBy(F.lit(1)).orderBy("score_date")))
    carried = weights.join(dates, "score_date").where(F.col("next_date").isNotNull()).select(
        F.col("next_date").alias("score_date"), "security_id", F.col("weight").alias("previous_weight"))
    both = weights.join(carried, ["score_date", "security_id"], "full")
    change = F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("previous_weight", F.lit(0.0)))
    return both.groupBy("score_date").agg((F.sum(change) / 2).alias("one_way_turnover"))


def dense_horizons(counts: DataFrame, horizons: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """Every horizon of a fixed list, zero where absent (JN21)."""
    grid = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"))
    return grid.join(counts, "horizon", "left").select("horizon", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns])


def orphan_explanations(explanations: DataFrame, contract: DataFrame) -> DataFrame:
    """Explanation rows per date without an active model input after the suffix is stripped (JN22)."""
    active = contract.where("coefficient <> 0").select(F.col("feature_key").alias("input_key"), F.lit(True).alias("_known"))
    named = explanations.withColumn("input_key", F.regexp_replace("feature_key", "_percentile$", ""))
    return named.join(active, "input_key", "left").groupBy("score_date").agg(
        F.count(F.lit(1)).alias("explanations"), F.count_if(F.col("_known").isNull()).alias("orphans"))


def reconcile(provider: DataFrame, ledger: DataFrame, keys: Sequence[str], tolerances: dict[str, float | None]) -> DataFrame:
    """Full outer comparison: one status per key and the list of changed fields (JN23, JN24).

    A tolerance of ``None`` compares null-safe equality.
    """
    fields = list(tolerances)
    left = provider.select(*keys, F.struct(*fields).alias("p"))
    right = ledger.select(*keys, F.struct(*fields).alias("l"))
    changed = []
    for name, tolerance in tolerances.items():
        p, l = F.col(f"p.{name}"), F.col(f"l.{name}")
        differs = ~p.eqNullSafe(l) if tolerance is None else F.abs(p - l) > tolerance
        changed.append(F.when(differs, F.lit(name)))
    status = (
        F.when(F.col("l").isNull(), "missing_in_ledger").when(F.col("p").isNull(), "missing_at_provider")
        .when(F.size("changed_fields") > 0, "value_mismatch").otherwise("matched")
    )
    both = left.join(right, list(keys), "full").withColumn(
        "changed_fields", F.when(F.col("l").isNotNull() & F.col("p").isNotNull(), F.array_compact(F.array(*changed))))
    return both.select(*keys, status.alias("status"), "changed_fields")


def status_samples(reconciled: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """First ``limit`` keys per problem status (the report's samples)."""
    return top_rows(reconciled.where("status <> 'matched'"), ["status"], [F.col(k).asc() for k in keys], limit)


def session_gaps(bars: DataFrame, symbols: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions missing per symbol, generated from the gaps between consecutive bars.

    Only missing sessions are produced; no symbol x session product is formed.
    """
    have = bars.join(sessions.select("session_date", "idx"), "session_date").join(symbols, "security_id", "left_semi").select("security_id", "idx")
    end = sessions.agg((F.max("idx") + 1).alias("idx"))
    sentinels = symbols.select("security_id").distinct().crossJoin(F.broadcast(end)).select("security_id", F.col("idx").cast("int").alias("idx"))
    ordered = Window.partitionBy("security_id").orderBy("idx")
    holes = have.unionByName(sentinels).withColumn("before", F.coalesce(F.lag("idx").over(ordered), F.lit(0))).where("idx - before > 1")
    missing = holes.select("security_id", F.explode(F.sequence(F.col("before") + 1, F.col("idx") - 1)).alias("idx"))
    return missing.join(sessions.select("session_date", "idx"), "idx").select("security_id", "session_date")
