"""Offsets, durations and due times (F4-F9, F21-F22) as Column expressions.

Invalid input gives NULL plus an error text column instead of an exception, so
one bad runbook row never fails a distributed job; callers filter or report.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit suffixes and their size in minutes / seconds.
OFFSET_ZERO = "T-0"
OFFSET_PREFIX = "T-"
UNIT_MINUTES = {"d": 24 * 60, "h": 60, "m": 1}
UNIT_SECONDS = {"d": 86400, "h": 3600, "m": 60, "s": 1}
BATCH_TIME_BUCKET = "5 minutes"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def offset_minutes(offset: str | Column) -> Column:
    """``T-0`` → 0; ``T-<n><d|h|m|s>`` → minutes, seconds rounded up;
    anything else (``5d``, ``T+5d``, ``T-5w``, ``T-1.5d``, negative) → NULL."""
    o = F.trim(_c(offset))
    ok = o.rlike(r"^T-[0-9]+[dhms]$")
    num = F.regexp_extract(o, r"^T-([0-9]+)[dhms]$", 1).try_cast("int")
    unit = F.substring(o, -1, 1)
    minutes = (F.when(unit == "d", num.cast("bigint") * 1440)
                .when(unit == "h", num.cast("bigint") * 60)
                .when(unit == "m", num.cast("bigint"))
                .when(unit == "s", F.ceil(num / F.lit(60.0))))
    in_range = minutes <= F.lit(2147483647)
    return (F.when(o == OFFSET_ZERO, F.lit(0))
             .when(ok & num.isNotNull() & in_range, minutes.cast("int")))


def offset_error(offset: str | Column) -> Column:
    """the reason an offset is rejected, NULL when valid."""
    o = F.trim(_c(offset))
    return (F.when(o.isNull(), F.lit("missing offset"))
             .when(offset_minutes(o).isNotNull(), F.lit(None).cast("string"))
             .when(~o.startswith(OFFSET_PREFIX) | (F.length(o) < 4), F.concat(F.lit("Invalid offset format: "), o))
             .when(~F.substring(o, -1, 1).isin(*UNIT_SECONDS), F.concat(F.lit("Invalid offset suffix: "), o))
             .otherwise(F.concat(F.lit("Invalid offset number: "), o)))


def offset_publishable(offset: str | Column) -> Column:
    """stricter rule for publishing: exactly ``T-0`` or a number > 0."""
    o = F.trim(_c(offset))
    num = F.regexp_extract(o, r"^T-([0-9]+)[dhms]$", 1).try_cast("int")
    return F.coalesce((o == OFFSET_ZERO) | (num > 0), F.lit(False))


def duration_seconds(duration: str | Column) -> Column:
    """``15m`` → 900; blank/NULL → 0; invalid → NULL."""
    d = F.trim(_c(duration))
    num = F.regexp_extract(d, r"^([0-9]+)[dhms]$", 1).try_cast("int")
    unit = F.substring(d, -1, 1)
    secs = (F.when(unit == "d", num.cast("bigint") * 86400)
             .when(unit == "h", num.cast("bigint") * 3600)
             .when(unit == "m", num.cast("bigint") * 60)
             .when(unit == "s", num.cast("bigint")))
    return (F.when(d.isNull() | (d == ""), F.lit(0).cast("bigint"))
             .when(d.rlike(r"^[0-9]+[dhms]$"), secs))


def due_at(batch_start: str | Column, minutes: str | Column) -> Column:
    """``due_at = batch_start - offset``; NULL start → NULL."""
    return F.timestamp_add("MINUTE", -_c(minutes), _c(batch_start))


def batch_time_floor(ts: str | Column) -> Column:
    """F8: timestamp floored to the 5-minute scheduler tick."""
    return F.window(_c(ts), BATCH_TIME_BUCKET).start


def lenient_timestamp(text: str | Column) -> Column:
    """parse a timestamp text, NULL (→ skipped) when invalid."""
    return F.try_to_timestamp(_c(text))


def seconds_between(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed seconds between two timestamps."""
    return F.unix_timestamp(_c(later)) - F.unix_timestamp(_c(earlier))


def backoff_seconds(attempt: str | Column, retry_after: str | Column | None = None,
                    base: float = 2.0, cap: float = 120.0, jitter_key: str | Column | None = None) -> Column:
    """``min(base·2^(n−1), cap)`` plus up to 30 % jitter, or Retry-After
    when given.  The jitter comes from a hash of ``jitter_key`` so reruns give
    the same delay."""
    exp = F.least(F.lit(base) * F.pow(F.lit(2.0), _c(attempt) - 1), F.lit(cap))
    if jitter_key is not None:
        frac = F.pmod(F.xxhash64(_c(jitter_key), _c(attempt)), F.lit(1000)) / F.lit(1000.0)
        exp = exp + exp * F.lit(0.3) * frac
    delay = F.round(exp, 1)
    if retry_after is not None:
        ra = _c(retry_after)
        delay = F.when(ra > 0, ra.cast("double")).otherwise(delay)
    return delay
