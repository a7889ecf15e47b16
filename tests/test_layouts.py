"""Readers that decide per file, types that keep values, pivots that keep rows, sparse codes, densities."""

import json
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablesmith.operators import charts, cleaning, features, rollups
from tablesmith.sources import manifest, readers

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-99, 99) | st.text("ab[]{},:\"\\ \né", max_size=6),
    lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("k[\"", max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.text("xyz", min_size=1, max_size=2), VALUES, max_size=3), max_size=4), st.sampled_from([None, 1, 4]), st.booleans())
def test_records_of_any_layout(records, indent, as_array):
    text = json.dumps(records, indent=indent) if as_array else "\n".join(json.dumps(r, indent=indent) for r in records)
    assert [json.loads(x) for x in readers.split_records("\n " + text + "\n")] == records


@pytest.mark.parametrize("text", ['[{"a": 1} {"a": 2}]', '[{"a": 1}', '{"a": ', '[1, 2,, 3]', "nonsense"])
def test_broken_records_are_told(text):
    with pytest.raises(readers.BrokenRecords, match="file"):
        list(readers.split_records(text, "file"))


def test_json_folder(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": "[}"}\n')
    # Two records on lines that are no values of their own, with a long first line.
    (tmp_path / "spread out.json").write_text('[\n{"a": 3,\n "b": "' + "y" * 3000 + '"},\n{"a": 4, "b": null}]')
    (tmp_path / "many+one.json").write_text('{"a": 5,\n"b": "z"}\n{"a": 6}')
    (tmp_path / "array.json").write_text('[{"a": 7}, {"a": 8}]')
    assert sorted(r.a for r in readers.read_json(spark, str(tmp_path)).collect()) == [1, 2, 3, 4, 5, 6, 7, 8]
    (tmp_path / "broken.json").write_text('{"a": 9}\n{"a": \n')
    with pytest.raises(Exception, match="broken.json"):
        readers.read_json(spark, str(tmp_path)).collect()


def test_files_of_two_encodings(spark, tmp_path):
    (tmp_path / "a b.csv").write_bytes("id,name,more\n1,Größe,x\n".encode("latin-1"))
    (tmp_path / "c+d.csv").write_bytes('id,name\n2,Größe\n3,"two\nlines"\n'.encode())
    (tmp_path / "e.csv").write_bytes("id,name\n4,plain\n".encode())
    got = {r["id"]: (r["name"], r["more"]) for r in readers.read_csv_auto(spark, str(tmp_path), sep=",").collect()}
    assert got == {1: ("Größe", "x"), 2: ("Größe", None), 3: ("two\nlines", None), 4: ("plain", None)}


LADDER = [
    (["1", " 22 ", None], "bigint", ["1", "22", None]), (["9223372036854775808", "1"], "decimal(38,0)", ["9223372036854775808", "1"]),
    (["1.5", "2", "1e3"], "double", ["1.5", "2.0", "1000.0"]), (["1" * 40, "2"], "string", ["1" * 40, "2"]),
    (["x", "1"], "string", ["x", "1"]), ([None, None], "double", [None, None]), (["", "1"], "string", ["", "1"])]


@pytest.mark.parametrize("values,kind,want", LADDER)
def test_types_keep_values(spark, values, kind, want):
    out = cleaning.infer_numeric(spark.createDataFrame([(v,) for v in values], "`a b` string"))
    assert dict(out.dtypes)["a b"] == kind
    assert [r[0] for r in out.select(F.col("a b").cast("string")).collect()] == want


def test_pivots_keep_every_row(spark):
    df = spark.createDataFrame([("r", "A", 1.0), ("r", None, 2.0), (None, "B", 3.0), ("r", "C", None)], "k string, c string, v double")
    out = rollups.crosstab(df, "k", "c", ["Z", "B"], fill=0)
    assert out.columns == ["k", "Z", "B", "A", "C", "null"]
    assert {r["k"]: r.asDict() for r in out.collect()}["r"] == {"k": "r", "Z": 0, "B": 0, "A": 1, "C": 1, "null": 1}
    assert sum(sum(v for c, v in r.asDict().items() if c != "k") for r in out.collect()) == 4
    assert rollups.crosstab(df, "k", "c", fn="mean", val="v").where("k = 'r'").first()["C"] is None
    assert rollups.crosstab(df.limit(0), "k", "c").columns == ["k"]
    with pytest.raises(ValueError, match="more than 2"):
        rollups.pivot_values(df, "c", width=2)
    with pytest.raises(ValueError, match="same column name"):
        rollups.pivot_values(df.unionAll(spark.createDataFrame([("r", "null", 1.0)], df.schema)), "c")


def test_codes_do_not_grow_with_the_vocabulary(spark):
    df = spark.createDataFrame([(f"v{i:04d}",) for i in range(3000)] + [(None,)], "w string")
    out = features.fit_encoder(df, ["w"]).apply(df.unionAll(spark.createDataFrame([("new",)], "w string")), onehot=True)
    rows = {r["w"]: r["w_onehot"] for r in out.where("w IS NULL OR w IN ('v0000', 'v2999', 'new')").collect()}
    assert rows["v2999"].indices == [2999] and rows["v2999"].values == [1.0] and rows["v2999"].size == 3000
    assert rows[None].indices == [] and rows["new"].indices == []
    assert out.agg(F.max(F.size("w_onehot.indices"))).first()[0] == 1


@pytest.mark.parametrize("values", [[1.0, 2.0], [float(i % 17) ** 2 for i in range(300)], [0.0] * 50 + [1.0, 1e6], [math.sin(i) for i in range(2000)]])
def test_density_against_the_exact_sum(spark, values):
    df = spark.createDataFrame([("g", v) for v in values] + [("g", None), ("g", float("nan")), ("one", 1.0), (None, 5.0)], "k string, v double")
    n, mean = len(values), sum(values) / len(values)
    h = math.sqrt(sum((v - mean) ** 2 for v in values) / (n - 1)) * n**-0.2
    got = {r["point"]: r for r in charts.kde(df, "v", 40, by="k").collect()}
    assert len(got) == 40
    for r in got.values():
        want = sum(math.exp(-0.5 * ((v - r["x"]) / h) ** 2) for v in values) / (n * h * math.sqrt(2 * math.pi))
        assert math.isclose(r["density"], want, rel_tol=1e-9, abs_tol=2e-12 / h)
    assert charts.kde(df.where("k = 'g'"), "v", 40).count() == 40 and charts.kde(df.where("k = 'one'"), "v").count() == 0


def test_density_shuffles_bins_not_values(spark):
    df = spark.range(50_000).select((F.col("id") * 0.37 % 11.3).alias("v"))
    plan = charts.kde(df, "v")
    bins = [x for x in plan._jdf.queryExecution().analyzed().toString().splitlines() if "_bin" in x and "Aggregate" in x]
    assert bins and plan.count() == 100


@pytest.mark.parametrize("limit", [10, 1 << 30])
def test_manifest_of_small_and_large_files(spark, tmp_path, limit):
    import hashlib

    data = {"a.bin": bytes(range(256)) * 5000, "t.csv": b"a,b\n1,2\n", "b.csv": b"\xff\xfe\x00" * 50, "z.xlsx": b"PK\x03\x04rest", "x.exe": b"MZ\x90\x00", "empty.txt": b"",
            "cut.tsv": ("é" * 200).encode()}
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r for r in manifest.file_manifest(spark, str(tmp_path), whole_bytes=limit).collect()}
    assert set(got) == set(data)
    for name, content in data.items():
        assert got[name]["sha256"] == hashlib.sha256(content).hexdigest() and got[name]["size"] == len(content)
    assert got["b.csv"]["problem"] == "not_text" and got["x.exe"]["problem"] == "executable_content" and got["t.csv"]["problem"] is None
    assert got["cut.tsv"]["problem"] is None and got["z.xlsx"]["is_zip"]
