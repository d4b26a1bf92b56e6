"""Column functions: offsets, durations, templates, multi-valued cells,
result fields, error classes, URL/size parsing (cases from the reference's
unit tests where it has them)."""

import pytest
from pyspark.sql import functions as F

from inventa.functions import durations as D
from inventa.functions import errors as ER
from inventa.functions import jsonmap as J
from inventa.functions import templates as TP
from inventa.functions import text as TX


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("offset,minutes", [
    ("T-0", 0), ("T-1d", 1440), ("T-48h", 2880), ("T-120m", 120), ("T-30s", 1), ("T-90s", 2), ("T-60s", 1),
])
def test_offset_minutes(spark, offset, minutes):
    assert one(spark, D.offset_minutes(F.lit(offset))) == minutes
    assert one(spark, D.offset_error(F.lit(offset))) is None


@pytest.mark.parametrize("offset", ["invalid", "5d", "T5d", "T+5d", "T-5x", "T-5w", "T-abcd", "T-1.5d", "T--5d", "T-"])
def test_offset_invalid(spark, offset):
    assert one(spark, D.offset_minutes(F.lit(offset))) is None
    assert one(spark, D.offset_error(F.lit(offset))) is not None


@pytest.mark.parametrize("offset,ok", [("T-0", True), ("T-5d", True), ("T-0d", False), ("T--5d", False), ("5d", False)])
def test_offset_publishable(spark, offset, ok):
    assert one(spark, D.offset_publishable(F.lit(offset))) is ok


@pytest.mark.parametrize("dur,secs", [("1d", 86400), ("24h", 86400), ("5m", 300), ("30s", 30), ("", 0), (None, 0)])
def test_duration_seconds(spark, dur, secs):
    assert one(spark, D.duration_seconds(F.lit(dur).cast("string"))) == secs


def test_duration_invalid(spark):
    assert one(spark, D.duration_seconds(F.lit("5x"))) is None


def test_due_at_and_null_start(spark):
    ts = F.lit("2024-03-10 12:00:00").cast("timestamp")
    assert str(one(spark, D.due_at(ts, F.lit(1440)))) == "2024-03-09 12:00:00"
    assert one(spark, D.due_at(F.lit(None).cast("timestamp"), F.lit(5))) is None


def test_batch_time_floor(spark):
    ts = F.lit("2024-03-10 12:07:59").cast("timestamp")
    assert str(one(spark, D.batch_time_floor(ts))) == "2024-03-10 12:05:00"


def test_backoff(spark):
    assert one(spark, D.backoff_seconds(F.lit(1))) == 2.0
    assert one(spark, D.backoff_seconds(F.lit(4))) == 16.0
    assert one(spark, D.backoff_seconds(F.lit(10))) == 120.0
    assert one(spark, D.backoff_seconds(F.lit(3), F.lit(7))) == 7.0
    j = one(spark, D.backoff_seconds(F.lit(3), jitter_key=F.lit("abc")))
    assert 8.0 <= j <= 8.0 * 1.3 + 0.05


def test_template_single_pass_and_fallback(spark):
    values = F.create_map(F.lit("Name"), F.lit("{{Other}}"), F.lit("_Dept"), F.lit("IT"),
                          F.lit("Empty"), F.lit(None).cast("string"), F.lit("Other"), F.lit("X"))
    e = TP.expand(F.lit("Hi {{Name}} of {{Dept}}{{Empty}} {{Missing}} { x }"), values,
                  batch_id=F.lit(42), batch_start=F.lit("2024-01-02 03:04:05").cast("timestamp"))
    row = spark.range(1).select(e.alias("e")).first()["e"]
    assert row["text"] == "Hi {{Other}} of IT {{Missing}} { x }"
    assert row["unresolved"] == ["Missing"]
    b = spark.range(1).select(TP.expand(F.lit("{{_batch_id}}@{{_batch_start_time}}"), None, F.lit(7),
                                        F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("e")).first()["e"]
    assert b["text"] == "7@2024-01-02T03:04:05.0000000"


def test_init_template_only_builtins(spark):
    e = spark.range(1).select(TP.expand(F.lit("{{_batch_id}} {{UserId}}"), None, F.lit(3)).alias("e")).first()["e"]
    assert e["unresolved"] == ["UserId"]


def test_brace_balance(spark):
    assert one(spark, TP.brace_balance_error(F.lit("{{a}} and {{b}}"))) is None
    assert one(spark, TP.brace_balance_error(F.lit("{{a}"))) == "unclosed template braces"
    assert one(spark, TP.brace_balance_error(F.lit("}}{{"))) == "unexpected closing braces"


def test_template_variables(spark):
    assert sorted(one(spark, TP.template_variables(F.lit("{{a}} {{b}} {{a}}")))) == ["a", "b"]


@pytest.mark.parametrize("value,fmt,expected", [
    ("a@test.com;b@test.com", "semicolon_delimited", '["a@test.com","b@test.com"]'),
    (" a , ,b,", "comma_delimited", '["a","","b"]'),
    ("x;y", "unknown", '["x","y"]'),
    ('["p","q"]', "json_array", '["p","q"]'),
    ("", "semicolon_delimited", None),
])
def test_multi_value_json(spark, value, fmt, expected):
    assert one(spark, J.multi_value_json(F.lit(value), F.lit(fmt))) == expected


def test_multi_value_bad_json(spark):
    assert one(spark, J.multi_value_json(F.lit("[oops"), F.lit("json_array"))) is None
    assert one(spark, J.multi_value_error(F.lit("[oops"), F.lit("json_array"))) is not None


def test_merge_worker_wins(spark):
    m = J.merge_worker_data(J.parse_string_map(F.lit('{"a":"1","b":"2"}')), J.parse_string_map(F.lit('{"b":"9"}')))
    assert dict(one(spark, m)) == {"a": "1", "b": "9"}
    assert dict(one(spark, J.parse_string_map(F.lit("not json")))) == {}


def test_result_fields(spark):
    r = F.lit('{"MailboxGuid": "abc-123", "Complete": false, "data": {"x": 1}}')
    assert one(spark, J.json_field_ci(r, "mailboxGuid")) == "abc-123"
    assert one(spark, J.json_field_ci(r, "missing")) is None
    assert one(spark, J.still_polling(F.lit("Success"), r)) is True
    assert one(spark, J.still_polling(F.lit("Failure"), r)) is False
    assert one(spark, J.final_result(r)) == '{"x":1}'
    assert one(spark, J.final_result(F.lit('{"y": 2}'))) == '{"y": 2}'


@pytest.mark.parametrize("code,msg,fam,cat", [
    (401, "", "graph", "Auth"), (429, "", "graph", "Throttle"), (503, "", "exo", "Throttle"),
    (404, "", "graph", "Skippable"), (403, "", "spo", "Skippable"), (403, "", "graph", "Auth"),
    (None, "Access token has expired", "graph", "Auth"), (None, "server busy now", "spo", "Throttle"),
    (None, "MicroDelay applied", "exo", "Throttle"), (None, "MicroDelay applied", "graph", "Unknown"),
    (None, "The mailbox couldn't be found", "exo", "Skippable"), (None, "Cannot find site", "spo", "Skippable"),
    (None, "boom", "mde", "Unknown"),
])
def test_classify_error(spark, code, msg, fam, cat):
    assert one(spark, ER.classify_error(F.lit(code).cast("int"), F.lit(msg), F.lit(fam))) == cat


def test_retry_after(spark):
    assert one(spark, ER.retry_after_seconds(F.lit("429 Too Many; Retry-After: 17"))) == 17
    assert one(spark, ER.retry_after_seconds(F.lit("nothing"))) is None


def test_text_helpers(spark):
    assert one(spark, TX.url_host(F.lit("https://contoso.sharepoint.com/sites/a/"))) == "contoso.sharepoint.com"
    assert one(spark, TX.url_path(F.lit("https://contoso.sharepoint.com/sites/a/?x=1"))) == "/sites/a"
    assert one(spark, TX.is_personal_site(F.lit("https://contoso-my.sharepoint.com/personal/u"))) is True
    assert one(spark, TX.is_guest(F.lit("i:0#.f|membership|bob_x.com#EXT#@t"))) is True
    assert one(spark, TX.is_eeeu(F.lit("c:0-.f|rolemanager|spo-grid-all-users/1"))) is True
    assert one(spark, TX.is_modern_template(TX.template_key(F.lit("GROUP"), F.lit(0)))) is True
    assert one(spark, TX.empty_guid_to_null(F.lit(TX.EMPTY_GUID))) is None
    assert one(spark, TX.size_text_bytes(F.lit("123 MB (129,345,536 bytes)"))) == 129345536
    assert one(spark, TX.upn_domain(F.lit("A.B@Contoso.COM"))) == "contoso.com"
    assert one(spark, TX.split_composite(F.lit("User:oid:a:b"))) == ["User", "oid", "a:b"]
    assert one(spark, TX.sanitize_name(F.lit("My Runbook-1"))) == "my_runbook_1"
    assert one(spark, TX.sample_value_for(F.lit("UserId"), "2025-01-01 00:00:00")) == "sample_id_001"
    assert one(spark, TX.sample_value_for(F.lit("email"), "2025-01-01 00:00:00")) == "user@example.com"
    assert one(spark, TX.sample_value_for(F.lit("MigrationDate"), "2025-01-01 00:00:00")) == "2025-01-08T00:00:00Z"
    assert one(spark, TX.sample_value_for(F.lit("x"), "2025-01-01 00:00:00", F.lit("comma_delimited"))) == \
        "value1,value2,value3"
