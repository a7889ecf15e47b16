import hashlib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablesmith import schema
from tablesmith.functions import formats, text
from tablesmith.operators import quality, sanitizing
from tablesmith.sources import manifest


def _map(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", fn("v").alias("o")).orderBy("i").select("o").collect()]


def test_sanitize_cells(spark):
    cases = {
        "=SUM(A1:A10)": "SUM(A1:A10)", "+B1*2": "B1*2", "-C1": "C1", "@D1": "D1", "normal_value": "normal_value",
        "==+-x": "x", "<script>alert(1)</script>": "", "<SCRIPT src='a'>b</SCRIPT>": "", "plain text": "plain text",
        "DROP TABLE users": " users", "SELECT * FROM users": "SELECT * FROM users", "UPDATE users SET a = 1": "UPDATE users SET a = 1",
        "a -- b\nc": "a ", "a /* b\n */ c": "a  c", "test\x00\x01\x02content": "testcontent", "x" * 15000: "x" * 15000,
        "delete from t": " t", "inſert into t": " t",
    }
    assert _map(spark, list(cases), text.sanitize_text) == list(cases.values())
    assert _map(spark, ["x" * 15000], lambda c: text.sanitize_text(c, max_chars=10000)) == ["x" * 10000]
    assert _map(spark, ["a -- b\nc"], lambda c: text.sanitize_text(c, line_comments="line")) == ["a \nc"]


def test_sanitize_basic_and_safety(spark):
    cases = {"==a": "=a", "SELECT * FROM users": " users", "UPDATE users SET a": " a", "drop database x": " x", "y" * 15000: "y" * 15000}
    assert _map(spark, list(cases), lambda c: text.sanitize_text(c, level="basic")) == list(cases.values())
    assert _map(spark, ["=1", "a <script>x</script>", "drop table t", "select  * from t", "update t set x", "fine", None], text.is_safe) == [
        False, False, False, False, False, True, True]


def test_filenames(spark):
    cases = {
        "a/b/report.csv": "report.csv", 'we<ird>:"|?*.csv': "we_ird______.csv", "..\\x.txt": "uploaded_file.txt", "": "uploaded_file.txt",
        ".hidden": "uploaded_file.txt", ".hidden.csv": "uploaded_file.csv", "n" * 300 + ".csv": "n" * 251 + ".csv", "dir/": "uploaded_file.txt",
    }
    assert _map(spark, list(cases), text.sanitize_filename) == list(cases.values())
    assert _map(spark, ["a.TXT", "a.b/c", ".x", "x.", "d/a.tar.gz"], text.file_extension) == [".txt", "", "", "", ".gz"]


def test_column_names():
    assert schema.clean_names(["col@1", "col 2", "col-3", "col.4"]) == ["col_1", "col_2", "col_3", "col_4"]
    assert schema.clean_names(["1col", "2nd_column"]) == ["col_1col", "col_2nd_column"]
    assert schema.clean_names(["", "_", "valid"]) == ["column_0", "column_1", "valid"]
    assert schema.clean_names(["col", "col@", "col#"]) == ["col", "col_", "col__1"]
    assert schema.clean_names(["a", "a", "a"]) == ["a", "a_1", "a_2"]
    assert schema.column_rules(["a", "", "a", "b\n", "c" * 101]) == [
        ("error", "empty_name", "1"), ("error", "duplicate_name", "a"), ("warning", "problem_characters", "b\n"), ("warning", "long_name", "c" * 101)]


@given(st.lists(st.text(max_size=8), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_clean_names_are_distinct_valid_and_stable(names):
    clean = schema.clean_names(names)
    assert len(set(clean)) == len(names) and all(schema.valid_name(c) for c in clean)
    assert schema.clean_names(clean) == clean


def test_changed_cells_and_issues(spark):
    df = spark.createDataFrame([(1, "=formula", 1.0), (2, "normal", 2.0), (3, "<script>x</script>", 3.0)], "k int, t string, n double")
    assert sanitizing.count_sanitized_cells(df).first()["n_changed"] == 2
    assert sanitizing.count_changes(df, sanitizing.sanitize_frame(df), "k").first()["n_changed"] == 2
    issues = sanitizing.scan_issues(df.withColumnRenamed("n", "col@1"), "k").collect()
    assert sorted(r["issue"] for r in issues) == ["formula_detected", "invalid_column_name", "script_detected"]


def test_formats(spark):
    row = spark.range(1).select(
        formats.format_kpi(F.lit(1234.5), "currency"), formats.format_kpi(F.lit(0.1234), "percentage"),
        formats.format_kpi(F.lit(1234567.0), "number", F.lit(-2.14)), formats.format_bytes(F.lit(0)), formats.format_bytes(F.lit(1536)),
        formats.format_bytes(F.lit(3 * 1024**2)), formats.format_bytes(F.lit(500)), formats.clip(F.lit(None).cast("double"), 0, 1),
        formats.safe_ratio(F.lit(1), F.lit(0))).first()
    assert list(row) == ["$1,234", "12.34%", "1,234,567 ↘ 2.1%", "0 Bytes", "1.5 KB", "3 MB", "500 Bytes", None, None]


def test_sql_functions(spark):
    names = formats.register_sql_functions(spark)
    assert "ts_sanitize_text" in names
    row = spark.sql("""SELECT ts_sanitize_text('=a <script>b</script> drop table x'), ts_is_safe('=1'), ts_safe_ratio(1, 0), ts_clip(5, 0, 3),
                       ts_severity('low', 'failure', 'login_failed')""").first()
    assert list(row) == ["a   x", False, None, 3.0, "ERROR"]


def test_manifest(spark, tmp_path):
    files = {"a.csv": b"x,y\n1,2\n", "b.csv": b"\xff\xfe\x00bad", "c.xlsx": b"not a zip", "d.xlsx": b"PK\x03\x04rest", "e.bin": b"MZ\x90", "f.csv": ("é" * 80).encode()}
    for n, content in files.items():
        (tmp_path / n).write_bytes(content)
    rows = {r["name"]: r for r in manifest.file_manifest(spark, str(tmp_path), max_bytes=150).collect()}
    assert rows["a.csv"]["sha256"] == hashlib.sha256(files["a.csv"]).hexdigest() and rows["a.csv"]["problem"] is None
    assert {n: rows[n]["problem"] for n in files} == {
        "a.csv": None, "b.csv": "not_text", "c.xlsx": "not_a_workbook", "d.xlsx": None, "e.bin": "executable_content", "f.csv": "file_too_large"}


def test_training_rules(spark):
    df = spark.createDataFrame([(float(i), str(i)) for i in range(5)], "y double, s string")
    for target, features, word in (("y", [], "too_few_rows"), ("s", [], "target_not_numeric"), ("zz", [], "missing_target"), ("y", ["q"], "missing_feature")):
        with pytest.raises(ValueError, match=word):
            quality.validate_training(df, target, features)
