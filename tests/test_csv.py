"""CSV member intake (cases from the reference's upload tests)."""

import os

from inventa.sources import csv_intake as CSV


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_parse_quotes_padding_crlf_blank_lines(spark, tmp_root):
    p = f"{tmp_root}/up1/file.csv"
    write(p, 'user_id,email,name\r\n"u1","a@x.com"," Smith, John "\r\n\r\nu2,"b@x.com","He said ""hi"""\r\nu3\r\n')
    df = CSV.read_member_csv(spark, p)
    rows = sorted((r["_row"], r["user_id"], r["email"], r["name"]) for r in df.collect())
    assert rows == [(2, "u1", "a@x.com", "Smith, John"), (3, "u2", "b@x.com", 'He said "hi"'), (4, "u3", "", "")]


def test_empty_and_duplicate_keys(spark, tmp_root):
    p = f"{tmp_root}/up2/file.csv"
    write(p, "User_Id,email\nA1,x\n,y\na1,z\nB2,w\nA1,v\n")
    df = CSV.read_member_csv(spark, p)
    got = sorted((r["_row"], r["code"], r["key"]) for r in CSV.row_violations(df, "User_Id").collect())
    assert got == [(3, "empty_key", ""), (4, "duplicate_key", "a1"), (6, "duplicate_key", "A1")]


def test_header_rules_case_insensitive():
    assert CSV.header_errors(["USER_ID", "Email", "extra"], "user_id", ["user_id", "email"]) == \
        [("unexpected_column", "extra")]
    assert CSV.header_errors(["id"], "user_id", ["user_id"]) == [("missing_key_column", "user_id")]
    assert CSV.header_errors(["user_id"], "user_id", ["user_id", "email", "dept"]) == \
        [("missing_column", "email"), ("missing_column", "dept")]


def test_header_only_is_valid(spark, tmp_root):
    p = f"{tmp_root}/up3/file.csv"
    write(p, "user_id,email\n")
    df = CSV.read_member_csv(spark, p)
    assert df.count() == 0
    assert CSV.row_violations(df, "user_id").count() == 0


def test_template_roundtrip(spark, tmp_root):
    df = CSV.template_row(spark, ["user_id", "note"], ["sample_id_001", 'say "x", ok'])
    CSV.write_template(df, f"{tmp_root}/tmpl")
    back = spark.read.options(header="true", escape='"').csv(f"{tmp_root}/tmpl").first()
    assert back["note"] == 'say "x", ok'
