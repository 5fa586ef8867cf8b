"""Availability gates, quality reports and other fail-closed filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Canonical filing forms in research scope.
RESEARCH_FORMS = ("10-K", "10-Q", "20-F", "40-F", "8-K")


def availability_violations(df: DataFrame, decision: Column) -> DataFrame:
    """One row with the number of rows that were not yet available at the decision (FLT01)."""
    return df.agg(F.count_if(F.col("available_at") > decision).alias("violations"), F.count(F.lit(1)).alias("checked"))


def require_available(df: DataFrame, decision: Column, label: str) -> DataFrame:
    """Fail the job on the first row that was not available at the decision (FLT01, raising form)."""
    ok = F.assert_true(F.col("available_at") <= decision, F.lit(f"{label} holds a record unavailable at decision_at"))
    return df.where(ok.isNull())


def available_history(df: DataFrame, formation: Column, decision: Column) -> DataFrame:
    """Keep sessions up to the formation that were available at the decision (FLT02)."""
    return df.where((F.col("session_date") <= formation) & (F.col("available_at") <= decision))


def issue_rows(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """Long form of the rules that fire per row."""
    codes = F.array_compact(F.array(*[F.when(rule, F.lit(code)) for code, rule in rules]))
    return df.select(*keys, F.explode(codes).alias("code"))


def daily_bar_quality(bars: DataFrame, required: DataFrame, session: Column, decision: Column) -> DataFrame:
    """Issue rows for one required session: bad values, range, lateness, missing and duplicate bars (FLT03)."""
    day = bars.where(F.col("session_date") == session)
    worst = F.least("open", "high", "low", "close", "volume")
    value_issues = issue_rows(day, ["security_id"], [
        ("invalid_bar_value", worst < 0),
        ("invalid_ohlc_range", (F.col("high") < F.greatest("open", "close")) | (F.col("low") > F.least("open", "close"))),
        ("future_available_at", F.col("available_at") > decision),
    ])
    counted = required.join(day.groupBy("security_id").agg(F.count(F.lit(1)).alias("copies")), "security_id", "left")
    presence = issue_rows(counted, ["security_id"], [
        ("missing_daily_bar", F.col("copies").isNull()),
        ("duplicate_daily_bar", F.col("copies") > 1),
    ])
    return value_issues.unionByName(presence)


def filing_fact_quality(facts: DataFrame, decision: Column) -> DataFrame:
    """Counts of duplicate identities beyond the first and of future facts, per security (FLT04)."""
    identity = ["security_id", "taxonomy", "concept", "period_end"]
    per_identity = facts.groupBy(*identity).agg(
        (F.count(F.lit(1)) - 1).alias("repeats"), F.count_if(F.col("available_at") > decision).alias("late")
    )
    totals = per_identity.groupBy("security_id").agg(F.sum("repeats").alias("repeats"), F.sum("late").alias("late"))
    counts = F.array(
        F.struct(F.lit("duplicate_filing_fact").alias("code"), F.col("repeats").alias("issues")),
        F.struct(F.lit("future_available_at").alias("code"), F.col("late").alias("issues")),
    )
    return totals.select("security_id", F.explode(counts).alias("x")).select("security_id", "x.*").where("issues > 0")


def constraint_report(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """Violations of every declared constraint in one pass (FLT05)."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in constraints.items()])
    return counts.unpivot([], list(constraints), "constraint_name", "violations")


def canonical_form(form: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(form)), "/A$", "")


def research_forms(filings: DataFrame) -> DataFrame:
    """Filings whose canonical form is in scope (FLT06)."""
    return filings.withColumn("canonical_form", canonical_form(F.col("form"))).where(F.col("canonical_form").isin(*RESEARCH_FORMS))


def new_filings(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """First copy of each accession that is not stored yet (FLT07)."""
    return incoming.join(stored, "accession", "left_anti").dropDuplicates(["accession"])


def index_candidates(universe: DataFrame, index: DataFrame, day: Column) -> DataFrame:
    """Universe members with an in-scope filing in the day's index (FLT08)."""
    return universe.join(research_forms(index.where(F.col("filed_on") == day)), "security_id", "left_semi")


def publication_days(days: DataFrame, day: str = "day") -> DataFrame:
    """Weekdays that are not an observed US federal holiday (FLT09).

    Every rule is arithmetic on the day itself, so no holiday table is joined.
    """
    d = F.col(day)
    month, dom, dow = F.month(d), F.dayofmonth(d), F.weekday(d)  # Monday = 0
    nth = lambda m, weekday, n: (month == m) & (dow == weekday) & (F.ceil(dom / 7.0) == n)
    last = lambda m, weekday: (month == m) & (dow == weekday) & (F.month(F.date_add(d, 7)) != m)

    def fixed(m: int, n: int) -> Column:
        matches = lambda shift: (F.month(F.date_add(d, shift)) == m) & (F.dayofmonth(F.date_add(d, shift)) == n)
        return (matches(0) & (dow < 5)) | (matches(1) & (dow == 4)) | (matches(-1) & (dow == 0))

    holidays = [
        fixed(1, 1), nth(1, 0, 3), nth(2, 0, 3), last(5, 0), fixed(6, 19), fixed(7, 4),
        nth(9, 0, 1), nth(10, 0, 2), fixed(11, 11), nth(11, 3, 4), fixed(12, 25),
    ]
    any_holiday = holidays[0]
    for rule in holidays[1:]:
        any_holiday = any_holiday | rule
    return days.where((dow < 5) & ~any_holiday)


def missing_bar_securities(listings: DataFrame, bars: DataFrame, sessions: DataFrame) -> DataFrame:
    """Open listings lacking a bar on at least one session (FLT10).

    Bars are unique per session, so counting each security's bars on calendar sessions
    replaces the security x session product.
    """
    on_calendar = bars.join(sessions.select("session_date"), "session_date", "left_semi").distinct()
    have = on_calendar.groupBy("security_id").agg(F.count(F.lit(1)).alias("have"))
    want = sessions.agg(F.count(F.lit(1)).alias("want"))
    return (
        listings.where(F.col("valid_to").isNull()).join(have, "security_id", "left")
        .crossJoin(F.broadcast(want)).where(F.coalesce("have", F.lit(0)) < F.col("want"))
        .select("ticker", (F.col("want") - F.coalesce("have", F.lit(0))).alias("missing_sessions")).distinct()
    )


def point_in_time_panel(
    members: DataFrame, bars: DataFrame, facts: DataFrame, required: Sequence[str], decision: Column, session: Column,
) -> DataFrame:
    """Members with their bar and one value per required concept; any gap blocks the whole panel (FLT11).

    The panel is returned with ``panel_ready``: true only when no member lacks an input and no
    input is late or duplicated, so that nothing is dropped silently.
    """
    day = bars.where(F.col("session_date") == session).groupBy("security_id").agg(
        F.max("close").alias("close"), F.count(F.lit(1)).alias("bar_copies"), F.max("available_at").alias("bar_at"),
    )
    latest = facts.groupBy("security_id").agg(*[
        F.max_by(F.when(F.col("concept") == c, F.col("value")), F.when(F.col("concept") == c, F.struct("period_end", "available_at", "accession"))).alias(c)
        for c in required
    ])
    rows = members.join(day, "security_id", "left").join(latest, "security_id", "left")
    complete = F.col("close").isNotNull() & (F.col("bar_copies") == 1) & (F.col("bar_at") <= decision)
    for concept in required:
        complete = complete & F.col(concept).isNotNull()
    complete = F.coalesce(complete, F.lit(False))
    verdict = rows.agg(F.min(complete).alias("panel_ready"), F.count_if(~complete).alias("incomplete_members"))
    return rows.withColumn("member_complete", complete).crossJoin(F.broadcast(verdict)).drop("bar_copies", "bar_at")


def with_drop_reason(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """First drop reason in fixed precedence, null when the row is kept (FLT12)."""
    reason = None
    for name, rule in rules:
        reason = F.when(rule, name) if reason is None else reason.when(rule, name)
    return df.withColumn("drop_reason", reason)


#: Partitions of distinct keys for each of a shuffle's.
KEY_PIECES = 16


def key_integrity(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Duplicate keys and non-finite values of a modelling table, in one aggregation per check (FLT13).

    A task holds all keys of its partition, so the keys are spread over many more partitions than a shuffle has.
    """
    broken = [F.count_if(f"_{v}").alias(f"bad_{v}") for v in values]
    flags = [(F.col(v).isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias(f"_{v}") for v in values]
    pieces = KEY_PIECES * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per_key = df.select(*keys, *flags).repartition(pieces, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"), *broken)
    return per_key.agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
        *[F.sum(f"bad_{v}").alias(f"bad_{v}") for v in values],
    )


def row_chronology(rows: DataFrame) -> DataFrame:
    """Rows whose formation, entry and outcome dates are out of order."""
    return rows.where(~((F.col("formation_date") < F.col("entry_date")) & (F.col("entry_date") < F.col("outcome_date"))))


def duplicates_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def session_gaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    ordered = Window.partitionBy(*keys).orderBy("session_date")
    return df.withColumn("gap_days", F.datediff("session_date", F.lag("session_date").over(ordered)))
