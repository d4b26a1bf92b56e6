"""Error classification for collector failures.

Rules are data: a small table of (api family, category, pattern) checked in
order after the status-code rules.  PowerShell ``-match`` is case-insensitive,
hence ``(?i)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status-code rules, then message patterns in check order.
AUTH_PATTERN = "Unauthorized|token.*expired|Access token has expired|ACS50012"
THROTTLE_PATTERN = "TooManyRequests|throttled|Too many requests|Rate limit|Server Busy|ServerBusyException"
THROTTLE_PATTERN_EXO_EXTRA = "MicroDelay|BackoffException|Too many concurrent"
SKIPPABLE_PATTERNS = {
    "graph": "Request_ResourceNotFound|ResourceNotFound|Synchronization_ObjectNotFound",
    "exo": "MapiExceptionNotFound|ManagementObjectNotFoundException|couldn't be found|mailbox.*doesn't exist|couldn't find",
    "spo": "locked|no access|does not exist|Cannot find site|AccessDenied|SiteNotFound",
    "mde": "ResourceNotFound|Not Found",
}
FORBIDDEN_SKIPPABLE_FAMILIES = ("spo", "mde")
RETRY_AFTER_PATTERN = r"(?i)Retry-After[:\s]+(\d+)"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _m(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?i)({pattern})"), F.lit(False))


def classify_error(status_code: str | Column, message: str | Column, api_family: str | Column) -> Column:
    """Auth / Throttle / Skippable / Unknown."""
    code, msg, fam = _c(status_code), F.coalesce(_c(message), F.lit("")), F.lower(_c(api_family))
    skippable = F.lit(False)
    for family, pattern in SKIPPABLE_PATTERNS.items():
        skippable = skippable | ((fam == family) & _m(msg, pattern))
    throttle = _m(msg, THROTTLE_PATTERN) | ((fam == "exo") & _m(msg, THROTTLE_PATTERN_EXO_EXTRA))
    return (F.when(code == 401, F.lit("Auth"))
             .when(code.isin(429, 503), F.lit("Throttle"))
             .when(code == 404, F.lit("Skippable"))
             .when(code == 403, F.when(fam.isin(*FORBIDDEN_SKIPPABLE_FAMILIES), F.lit("Skippable"))
                   .otherwise(F.lit("Auth")))
             .when(_m(msg, AUTH_PATTERN), F.lit("Auth"))
             .when(throttle, F.lit("Throttle"))
             .when(skippable, F.lit("Skippable"))
             .otherwise(F.lit("Unknown")))


def retry_after_seconds(message: str | Column) -> Column:
    """Retry-After seconds found in the error text, else NULL."""
    raw = F.regexp_extract(_c(message), RETRY_AFTER_PATTERN, 1)
    return F.when(raw != "", raw.try_cast("int"))
