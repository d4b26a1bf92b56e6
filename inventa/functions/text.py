"""Column functions over text: normalisation, flags from names and URLs,
parsing of composite ids and sizes (P10, P17-P20, F25-F30).  All built from
``pyspark.sql.functions`` so they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (patterns and lists the collectors use).
EEEU_PATTERN = "spo-grid-all-users"
GUEST_PATTERN = "#ext#|urn:spo:guest"
PERSONAL_SITE_PATTERN = r"-my\.sharepoint\.com/personal/"
MODERN_TEMPLATES = ("GROUP#0", "SITEPAGEPUBLISHING#0", "TEAMCHANNEL#0", "TEAMCHANNEL#1")
EMPTY_GUID = "00000000-0000-0000-0000-000000000000"
SELF_TRUSTEES = ("NT AUTHORITY\\SELF", "SELF")
DOCUMENT_LIST_TEMPLATES = (101, 700, 119)
SHARED_CHANNEL_TYPES = ("private", "shared")


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_email(c: str | Column) -> Column:
    """P10: ``lower(trim(mail))``."""
    return F.lower(F.trim(_c(c)))


def ci_match(c: str | Column, pattern: str) -> Column:
    """Case-insensitive regex test (PowerShell ``-match`` semantics); NULL → false."""
    return F.coalesce(_c(c).rlike(f"(?i){pattern}"), F.lit(False))


def is_eeeu(login: str | Column) -> Column:
    """The 'everyone except external users' principal."""
    return ci_match(login, EEEU_PATTERN)


def is_guest(login: str | Column) -> Column:
    """External / guest principal."""
    return ci_match(login, GUEST_PATTERN)


def is_personal_site(url: str | Column) -> Column:
    """OneDrive personal site URL."""
    return ci_match(url, PERSONAL_SITE_PATTERN)


def template_key(web_template: str | Column, configuration: str | Column) -> Column:
    """``WebTemplate#Configuration`` (NULL parts print as empty)."""
    return F.concat(F.coalesce(_c(web_template).cast("string"), F.lit("")), F.lit("#"),
                    F.coalesce(_c(configuration).cast("string"), F.lit("")))


def is_modern_template(key: str | Column) -> Column:
    """Template key in the list of modern templates (case-insensitive, as ``-in``)."""
    return F.coalesce(F.upper(_c(key)).isin(*MODERN_TEMPLATES), F.lit(False))


def empty_guid_to_null(c: str | Column) -> Column:
    """P20: the all-zero GUID means 'none'."""
    col = _c(c)
    return F.when(col.isNull() | (F.lower(col) == EMPTY_GUID) | (col == ""), F.lit(None)).otherwise(col)


def url_host(url: str | Column) -> Column:
    """host part of a URL."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)


def url_path(url: str | Column) -> Column:
    """path part of a URL without query/fragment, trailing ``/`` trimmed."""
    path = F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def size_text_bytes(text: str | Column) -> Column:
    """``"123 MB (129,345,536 bytes)"`` → 129345536 (NULL when absent)."""
    digits = F.regexp_extract(_c(text), r"\(([0-9,]+) bytes\)", 1)
    return F.when(digits != "", F.regexp_replace(digits, ",", "").try_cast("bigint"))


def size_text_mb(text: str | Column) -> Column:
    """the same size in MB (2 decimals)."""
    return F.round(size_text_bytes(text) / F.lit(1048576.0), 2)


def upn_domain(upn: str | Column) -> Column:
    """lower-cased domain of a UPN (text after the last ``@``)."""
    return F.substring_index(F.lower(_c(upn)), "@", -1)


def split_composite(c: str | Column, sep: str = ":", parts: int = 3) -> Column:
    """Split an id on ``sep`` into at most ``parts`` pieces."""
    return F.split(_c(c), sep, parts)


def sanitize_name(c: str | Column) -> Column:
    """derived table name: lower case, runs of non ``[a-z0-9_]`` → ``_``."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9_]", "_")


# Sample cells of the CSV template.
MULTI_VALUE_SAMPLES = {
    "semicolon_delimited": "value1;value2;value3",
    "comma_delimited": "value1,value2,value3",
    "json_array": '["value1","value2","value3"]',
}
EMAIL_SAMPLE = "user@example.com"
ID_SAMPLE = "sample_id_001"
DEFAULT_SAMPLE = "sample_value"


def sample_value_for(column_name: str | Column, as_of: str | Column,
                     multi_value_format: str | Column | None = None) -> Column:
    """sample cell for a column: multi-valued format sample first, then
    date/time (as_of + 7 days), e-mail, id (``_id`` any case or ``Id``)."""
    name = _c(column_name)
    low = F.lower(name)
    ts = _c(as_of) if not isinstance(as_of, str) else F.lit(as_of).cast("timestamp")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if multi_value_format is not None:
        fmt = F.lower(_c(multi_value_format))
        out = out.when(fmt.isNotNull(), F.coalesce(
            F.create_map(*[F.lit(x) for kv in MULTI_VALUE_SAMPLES.items() for x in kv])[fmt],
            F.lit(MULTI_VALUE_SAMPLES["semicolon_delimited"])))
    return (out.when(low.contains("time") | low.contains("date"),
                     F.date_format(ts + F.expr("INTERVAL 7 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
               .when(low.contains("email"), F.lit(EMAIL_SAMPLE))
               .when(low.endswith("_id") | name.endswith("Id"), F.lit(ID_SAMPLE))
               .otherwise(F.lit(DEFAULT_SAMPLE)))
