"""Column expressions: times and availability, names, hashes, reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange time zone, filing buffer and local cut-off hours.
MARKET_ZONE = "America/Toronto"
FILING_BUFFER = "INTERVAL 5 MINUTES"
BAR_HOUR = 18
DECISION_HOUR = 20


def local_hour(day: Column, hour: int) -> Column:
    """UTC instant of a local hour on a date, honouring daylight saving."""
    local = day.cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    return F.to_utc_timestamp(local, MARKET_ZONE)


def decision_at(day: Column) -> Column:
    return local_hour(day, DECISION_HOUR)


def bar_available_at(session: Column) -> Column:
    return local_hour(session, BAR_HOUR)


def filing_available_at(accepted: Column) -> Column:
    return accepted + F.expr(FILING_BUFFER)


def observed_available_at(accepted: Column, observed: Column) -> Column:
    return F.greatest(filing_available_at(accepted), observed)


def canonical_ticker(ticker: Column) -> Column:
    return F.upper(F.translate(F.trim(ticker), ".", "-"))


def padded_cik(cik: Column) -> Column:
    return F.lpad(F.trim(cik.cast("string")), 10, "0")


def identity_hash(*columns: Column) -> Column:
    """sha256 of a pipe-joined identity; nulls count as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def canonical_json_hash(*columns: Column) -> Column:
    """sha256 of compact JSON of the given columns in the given order."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def first_reason(*pairs: tuple[Column, str | Column]) -> Column:
    """First matching reason in order; null when no rule fires."""
    chain: Column | None = None
    for condition, reason in pairs:
        text = reason if isinstance(reason, Column) else F.lit(reason)
        chain = F.when(condition, text) if chain is None else chain.when(condition, text)
    return chain


def safe_divide(numerator: Column, denominator: Column) -> Column:
    return numerator / F.when(denominator != 0, denominator)
