"""Guarded status transitions (compare-and-set) of the five entity kinds.

A request is applied where the entity's status is among those the request
expects, and refused otherwise; the next request meets the outcome.  All
requests of a batch are folded in order by :mod:`inventa.operators.automaton`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventa.operators import automaton

# Statuses of all kinds (the first: no such row).
STATUSES = ("absent", "pending", "dispatched", "polling", "succeeded", "failed", "poll_timeout", "cancelled", "completed",
            "skipped", "superseded", "detected", "init_dispatched", "active", "removed")
ANY = None

# Per kind, request -> (expected statuses, new status); ANY: whatever the status.
TRANSITIONS = {
    "step": {
        "set_dispatched": (("pending",), "dispatched"),
        "set_succeeded": (("dispatched", "polling"), "succeeded"),
        "set_failed": (("dispatched", "polling"), "failed"),
        "set_polling": (("dispatched", "polling"), "polling"),
        "set_poll_timeout": (("polling",), "poll_timeout"),
        "set_cancelled": (("pending", "dispatched", "polling"), "cancelled"),
        "set_retry_pending": (("failed", "poll_timeout"), "pending"),
    },
    "init": {
        "set_dispatched": (("pending",), "dispatched"),
        "set_succeeded": (("dispatched", "polling"), "succeeded"),
        "set_failed": (("dispatched", "polling"), "failed"),
        "set_polling": (("dispatched", "polling"), "polling"),
        "set_poll_timeout": (("polling",), "poll_timeout"),
        "set_retry_pending": (("failed", "poll_timeout"), "pending"),
    },
    "phase": {
        "set_dispatched": (("pending",), "dispatched"),
        "set_completed": (("dispatched",), "completed"),
        "set_failed": (("dispatched",), "failed"),
        "set_skipped": (ANY, "skipped"),
        "set_superseded": (("pending",), "superseded"),
    },
    "batch": {
        "set_init_dispatched": (ANY, "init_dispatched"),
        "set_active": (ANY, "active"),
        "set_completed": (("active",), "completed"),
        "set_failed": (("active", "init_dispatched", "detected"), "failed"),
    },
    "member": {
        "set_removed": (ANY, "removed"),
        "set_failed": (("active",), "failed"),
    },
}
ENDS = ("set_succeeded", "set_failed", "set_poll_timeout", "set_cancelled", "set_completed")


def expected(kind: str, request: str) -> tuple[str, ...]:
    """Statuses from which the request is applied."""
    guard = TRANSITIONS[kind][request][0]
    return STATUSES[1:] if guard is ANY else guard


def _request_map(kind: Column, request: Column) -> Column:
    """The request as a function on the statuses; unknown requests change nothing."""
    out = automaton.as_map(range(len(STATUSES)))
    for k, requests in TRANSITIONS.items():
        for name, (_, to) in requests.items():
            guard = expected(k, name)
            own = automaton.as_map([STATUSES.index(to) if s in guard else i for i, s in enumerate(STATUSES)])
            out = F.when((kind == k) & (request == name), own).otherwise(out)
    return out


def _allowed(kind: Column, request: Column, status: Column) -> Column:
    ok = F.lit(False)
    for k, requests in TRANSITIONS.items():
        for name in requests:
            ok = ok | ((kind == k) & (request == name) & status.isin(*expected(k, name)))
    return F.coalesce(ok, F.lit(False))


def outcomes(current: DataFrame, requests: DataFrame, key: Sequence[str], order: Sequence[str], kind: str = "kind",
             request: str = "request", status: str = "status", block_rows: int = automaton.BLOCK_ROWS) -> DataFrame:
    """Every request with ``from_status``, ``applied`` and ``to_status``.

    ``current`` has kind, key and status of the known rows; a status that the
    kinds do not have counts as no row, and so does a missing row (its requests
    are refused)."""
    state = F.coalesce(F.array_position(F.array(*map(F.lit, STATUSES)), F.col(status)) - 1, F.lit(0))
    state = F.when(state < 0, 0).otherwise(state)
    seen = automaton.scan(requests, [kind, *key], order, _request_map(F.col(kind), F.col(request)), len(STATUSES),
                          current, state, block_rows)
    before = F.element_at(F.array(*map(F.lit, STATUSES)), F.col("state_before") + 1)
    out = seen.withColumn("from_status", before).drop("state_before")
    ok = _allowed(F.col(kind), F.col(request), F.col("from_status"))
    after = F.col("from_status")
    for k, known in TRANSITIONS.items():
        for name, (_, to) in known.items():
            after = F.when((F.col(kind) == k) & (F.col(request) == name) & F.col("applied"), F.lit(to)).otherwise(after)
    return out.withColumn("applied", ok).withColumn("to_status", after)


def advance(outcome: DataFrame, key: Sequence[str], order: Sequence[str], at: str, kind: str = "kind",
            request: str = "request") -> DataFrame:
    """Per row with requests: its status after them, how many were applied and
    refused, retries, and the times the applied ones leave: dispatched_at,
    poll_started_at (the first), last_polled_at, completed_at (null after a
    retry).  Sums and extremes over the outcomes, combined before the shuffle."""
    o = F.struct(*[F.col(f"`{c}`") for c in order])
    done = F.col("applied")

    def last(names: Sequence[str], value: Column) -> Column:
        chosen = done & F.col(request).isin(*names)
        return F.max_by(F.when(chosen, value), F.when(chosen, o))

    moment = F.col(at)
    ends = (*ENDS, "set_retry_pending")
    return outcome.groupBy(kind, *key).agg(
        F.max_by("to_status", o).alias("status"),
        F.count_if(done).alias("n_applied"), F.count_if(~done).alias("n_refused"),
        F.count_if(done & (F.col(request) == "set_retry_pending")).alias("n_retries"),
        last(("set_dispatched", "set_init_dispatched"), moment).alias("dispatched_at"),
        F.min(F.when(done & (F.col(request) == "set_polling"), moment)).alias("poll_started_at"),
        last(("set_polling",), moment).alias("last_polled_at"),
        last(ends, F.when(F.col(request) != "set_retry_pending", moment)).alias("completed_at"))
