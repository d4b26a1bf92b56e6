"""Worker results folded into step states, with a retry limit per step.

A step's state is (dispatched, polling or retry_pending, failures so far) or an
end; a result is a function on these states, the limit entering the function of
a failure.  :mod:`inventa.operators.automaton` folds all results in order, so a
step with most of the results is shared by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inventa.operators import automaton
from inventa.operators.results import RESULT_FAILURE, RESULT_POLLING, RESULT_SUCCESS

#: largest retry limit that a step may have
MOST_RETRIES = 60
OPEN = ("dispatched", "polling", "retry_pending")
ENDED = ("succeeded", "failed", "poll_timeout", "cancelled")
WIDTH = MOST_RETRIES + 1
STATES = len(OPEN) * WIDTH + len(ENDED)


def _index(status: str, failures: int = 0) -> int:
    return OPEN.index(status) * WIDTH + failures if status in OPEN else len(OPEN) * WIDTH + ENDED.index(status)


def _targets(change) -> list[int]:
    """Targets of all states, the ends staying where they are."""
    return [change(status, n) for status in OPEN for n in range(WIDTH)] + [_index(s) for s in ENDED]


def _result_map(kind: Column, limit: Column) -> Column:
    failures = [automaton.as_map(_targets(
        lambda s, n, most=most: _index("failed") if n + 1 > most else _index("retry_pending", n + 1))) for most in range(WIDTH)]
    return (F.when(kind == RESULT_SUCCESS, automaton.as_map(_targets(lambda s, n: _index("succeeded"))))
            .when(kind == RESULT_POLLING, automaton.as_map(_targets(lambda s, n: _index("polling", n))))
            .when(kind == RESULT_FAILURE, F.element_at(F.array(*failures), limit.cast("int") + 1))
            .otherwise(automaton.as_map(range(STATES))))


def fold_results(results: DataFrame, keys: Sequence[str], order_by: Sequence[str], kind_col: str,
                 limit: Column | int = 2, current: DataFrame | None = None,
                 block_rows: int = automaton.BLOCK_ROWS) -> DataFrame:
    """Per key with results: status, failures, n_applied and n_ignored.

    ``success`` ends a step; the failure that exceeds the step's own ``limit``
    (a column of the results or one number, 0 to 60; null: 2) ends it as failed;
    results after the end are ignored and counted, heartbeats change nothing.
    ``current`` holds stored states (keys, status, failures, n_applied,
    n_ignored), which the new results continue; a row without results is not
    returned."""
    keys = list(keys)
    limit = F.coalesce(limit if isinstance(limit, Column) else F.lit(limit), F.lit(2))
    rows = results.select(*keys, *order_by, F.col(kind_col).alias("_result"), F.least(
        F.greatest(limit, F.lit(0)), F.lit(MOST_RETRIES)).cast("int").alias("_limit"))
    state = None
    if current is not None:
        place = F.lit(0)
        for s in OPEN:
            place = F.when(F.col("status") == s, F.lit(_index(s)) + F.least(F.col("failures"), F.lit(MOST_RETRIES))).otherwise(place)
        for s in ENDED:
            place = F.when(F.col("status") == s, F.lit(_index(s))).otherwise(place)
        state = place
    seen = automaton.scan(rows, keys, order_by, _result_map(F.col("_result"), F.col("_limit")), STATES, current, state, block_rows)
    before = F.col("state_before")
    ended = before >= len(OPEN) * WIDTH
    changes = F.col("_result").isin(RESULT_SUCCESS, RESULT_FAILURE, RESULT_POLLING)
    after = F.conv(F.hex(F.substring(_result_map(F.col("_result"), F.col("_limit")), before + 1, F.lit(1))), 16, 10).cast("int")
    o = F.struct(*[F.col(c) for c in order_by], before, F.col("_result"))
    total = seen.withColumn("_after", after).groupBy(*keys).agg(
        F.max_by("_after", o).alias("_state"), F.count_if(~ended & changes).alias("n_applied"),
        F.count_if(ended).alias("n_ignored"), F.count_if(~ended & (F.col("_result") == RESULT_FAILURE)).alias("failures"))
    names = F.array(*[F.lit(s) for s in OPEN for _ in range(WIDTH)], *map(F.lit, ENDED))
    out = total.select(*keys, F.element_at(names, F.col("_state") + 1).alias("status"), F.col("failures").cast("int").alias("failures"),
                       "n_applied", "n_ignored")
    if current is None:
        return out
    counts = ("failures", "n_applied", "n_ignored")
    old = current.select(*keys, *[F.col(c).alias(f"_{c}") for c in counts])
    return (out.join(old, keys, "left")
            .select(*keys, "status", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in counts])
            .withColumn("failures", F.col("failures").cast("int")))
