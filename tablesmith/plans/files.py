"""Reader and writer queries: each writes given tables in a format and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablesmith.operators import regression, registry
from tablesmith.plans.base import AUDIT_SQL, GAPPY_ORDERS_SQL, audit_table, gappy_orders, query, table, time_text
from tablesmith.session import scratch_path
from tablesmith.sources import manifest, readers, sinks

G = f"WITH {GAPPY_ORDERS_SQL} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM gappy"


def created():
    """A fixed time stamp in place of the wall clock."""
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


def _with_tokens(spark, sf):
    """Missing cells written as the texts that delimited files use for them."""
    df = gappy_orders(spark, sf)
    tokens = {"o_custkey": "NA", "o_orderstatus": "None", "o_totalprice": "nan", "o_orderpriority": ""}
    return df.select("o_orderkey", *[F.coalesce(F.col(c).cast("string"), F.lit(t)).alias(c) for c, t in tokens.items()])


@query("read_csv_auto", G)
def read_csv_auto(spark, sf):
    path = sinks.export(_with_tokens(spark, sf), scratch_path(spark, "csv"), "csv", sep=";")
    return readers.read_csv_auto(spark, path)


@query("read_csv_latin1", "SELECT c_custkey, c_name || ' Müller-Größe' AS c_name, c_acctbal FROM customer")
def read_csv_latin1(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" Müller-Größe")).alias("c_name"), "c_acctbal")
    return readers.read_csv_auto(spark, sinks.export(df, scratch_path(spark, "latin1"), "csv", encoding="ISO-8859-1"))


def _both_encodings(spark, sf):
    """A folder with customers' names in UTF-8 in one file and in Latin-1 in another; only the first breaks lines in quotes."""
    df = table(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" Größe")).alias("c_name"), "c_acctbal")
    base, odd = scratch_path(spark, "mixed"), F.col("c_custkey") % 2 == 1
    sinks.export(df.where(odd), f"{base}/latin", "csv", encoding="ISO-8859-1")
    sinks.export(df.where(~odd).withColumn("c_name", F.concat("c_name", F.lit("\nsecond line"))).coalesce(2), f"{base}/utf", "csv")
    return f"{base}/*"


@query("read_csv_mixed_encodings", """SELECT c_custkey, c_name || ' Größe' || CASE WHEN c_custkey % 2 = 1 THEN '' ELSE chr(10) || 'second line' END AS c_name, c_acctbal FROM customer""")
def read_csv_mixed_encodings(spark, sf):
    return readers.read_csv_auto(spark, _both_encodings(spark, sf), sep=",")


@query("read_csv_long_ids", """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, '98765432109876' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS id20, 'decimal(38,0)' AS kind,
o_orderkey + 9007199254740993 AS id16 FROM orders""")
def read_csv_long_ids(spark, sf):
    k = F.col("o_orderkey")
    df = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("98765432109876"), F.lpad(k.cast("string"), 6, "0")).alias("id20"), (k + 9007199254740993).alias("id16"))
    out = readers.read_csv_auto(spark, sinks.export(df, scratch_path(spark, "ids"), "csv"))
    return out.select("o_orderkey", F.col("id20").cast("string").alias("id20"), F.typeof("id20").alias("kind"), "id16")


@query("read_csv_multiline", "SELECT doc_id, text FROM documents")
def read_csv_multiline(spark, sf):
    # Texts with commas, quotes and line breaks come back whole.
    df = table(spark, sf, "documents").select("doc_id", "text")
    return readers.read_csv_auto(spark, sinks.export(df, scratch_path(spark, "texts"), "csv"), sep=",")


@query("read_tsv", G)
def read_tsv(spark, sf):
    return readers.read_tsv(spark, sinks.export(_with_tokens(spark, sf), scratch_path(spark, "tsv") + ".tsv", "tsv"))


@query("read_json_records", G)
def read_json_records(spark, sf):
    # Arrays of at most 1000 records each.
    path = scratch_path(spark, "json")
    arrays = gappy_orders(spark, sf).groupBy(F.floor(F.col("o_orderkey") / 1000).alias("chunk")).agg(
        F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    arrays.select("value").write.text(path)
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    return readers.read_json(spark, path).select(*cols)


@query("read_json_long_lines", "SELECT doc_id, text, lang FROM documents")
def read_json_long_lines(spark, sf):
    # Every third document comes in a file of one long array, every third spread over lines, the others a line each.
    d, base = table(spark, sf, "documents").select("doc_id", "text", "lang"), scratch_path(spark, "layouts")
    k, record = F.col("doc_id") % 3, F.to_json(F.struct("doc_id", "text", "lang"))
    arrays = lambda rows, start, comma, end: rows.groupBy(F.floor(F.col("doc_id") / 200)).agg(
        F.concat(F.lit(start), F.array_join(F.collect_list(record), comma), F.lit(end)).alias("value")).select("value")
    arrays(d.where(k == 0), "[", ", ", "]").write.text(f"{base}/array")
    arrays(d.where(k == 1), "[\n", ",\n   ", "\n]\n").write.text(f"{base}/spread")
    d.where(k == 2).write.json(f"{base}/lines")
    return readers.read_json(spark, f"{base}/*").select("doc_id", "text", "lang")


@query("read_parquet", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def read_parquet(spark, sf):
    return readers.read_parquet(spark, f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")


@query("read_by_extension", "SELECT 'parquet' AS kind, o_orderkey, o_totalprice FROM orders UNION ALL "
       "SELECT 'csv', o_orderkey, o_totalprice FROM orders UNION ALL SELECT 'txt', o_orderkey, o_totalprice FROM orders UNION ALL "
       "SELECT 'json', o_orderkey, o_totalprice FROM orders")
def read_by_extension(spark, sf):
    two = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    base = scratch_path(spark, "load")
    sinks.export(two.toDF("o orderkey", "o@totalprice"), f"{base}/a.csv.encrypted", "csv")
    sinks.export(two, f"{base}/b.txt", "csv", sep="|")
    sinks.export(two, f"{base}/c.json", "json")
    loaded = {"parquet": f"{sf}/orders.parquet", "csv": f"{base}/a.csv.encrypted", "txt": f"{base}/b.txt", "json": f"{base}/c.json"}
    out = None
    for kind, path in loaded.items():
        part = readers.load(spark, path).select(F.lit(kind).alias("kind"), "o_orderkey", "o_totalprice")
        out = part if out is None else out.unionByName(part)
    return out


@query("read_audit_log", f"""WITH {AUDIT_SQL} SELECT CAST(event_id AS VARCHAR) AS event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, 'WARNING' AS level,
CAST(user_id AS VARCHAR) AS user_id, event_type, outcome, risk_level FROM audit""")
def read_audit_log(spark, sf):
    path = scratch_path(spark, "auditlog")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    audit_table(spark, sf).select(
        stamp.alias("timestamp"), F.lit("WARNING").alias("level"), F.struct(
            stamp.alias("timestamp"), "event_type", F.col("user_id").cast("string").alias("user_id"), "outcome", "risk_level",
            F.create_map(F.lit("event_id"), F.col("event_id").cast("string")).alias("details")).alias("message")).write.json(path)
    log = readers.read_audit_log(spark, path)
    return log.select(F.col("details")["event_id"].alias("event_id"), time_text("ts").alias("ts"), "level", "user_id", "event_type", "outcome", "risk_level")


@query("file_manifest")
def file_manifest(spark, sf):
    return manifest.file_manifest(spark, f"{sf}/*.parquet").select("name", "extension", "size", "sha256", "is_zip", "is_executable", "problem")


@query("write_csv", G)
def write_csv(spark, sf):
    path = sinks.export(gappy_orders(spark, sf), scratch_path(spark, "out"), "csv")
    return readers.read_delimited(spark, path, schema=gappy_orders(spark, sf).schema)


@query("write_parquet", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def write_parquet(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = sinks.export(df, scratch_path(spark, "out"), "parquet", partition_by=["o_orderpriority"])
    return spark.read.parquet(path)


@query("write_parquet_partition", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def write_parquet_partition(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return spark.read.parquet(sinks.export(df, scratch_path(spark, "out"), "parquet", partition_by=["o_orderpriority"])).where("o_orderpriority = '2-HIGH'")


@query("write_json_records", G)
def write_json_records(spark, sf):
    df = gappy_orders(spark, sf)
    path = sinks.export(df, scratch_path(spark, "out"), "json", metadata=("orders", created()))
    return spark.read.schema(df.schema).json(path)


@query("write_json_metadata", "SELECT 'orders' AS dataset_id, count(*) AS n_rows, CAST(5 AS BIGINT) AS n_columns, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderpriority' AS columns FROM orders")
def write_json_metadata(spark, sf):
    path = sinks.export(gappy_orders(spark, sf), scratch_path(spark, "out"), "json", metadata=("orders", created()))
    return spark.read.json(f"{path}.metadata").select("dataset_id", "n_rows", "n_columns", F.array_join("columns", ",").alias("columns"))


@query("export_predictions", """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS l_extendedprice,
round(i + s * l_quantity, 2) AS prediction, round(l_extendedprice - i - s * l_quantity, 2) AS residual, 'm1' AS model_id
FROM lineitem, (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem)""")
def export_predictions(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    scored = regression.fit(lines, "l_extendedprice", ["l_quantity"]).predict(lines)
    path = sinks.write_predictions(scored, scratch_path(spark, "predictions"), "m1", created(), actual="l_extendedprice")
    out = spark.read.parquet(path)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(c) for c in ("l_extendedprice", "prediction", "residual")], "model_id")


@query("lineage_record", f"WITH {GAPPY_ORDERS_SQL}, clean AS (SELECT * FROM gappy WHERE o_totalprice IS NOT NULL)" + """
SELECT 'orders_clean' AS dataset_id, 'orders' AS parent_id, (SELECT count(*) FROM clean) AS n_rows, 5 AS n_columns,
(SELECT count(*) FROM gappy) AS parent_rows, 5 AS parent_columns""")
def lineage_record(spark, sf):
    parent = gappy_orders(spark, sf)
    child = parent.na.drop(subset=["o_totalprice"])
    rows = registry.record_lineage(
        scratch_path(spark, "catalog"), child, parent, "orders_clean", "orders", "Cleaned orders", "memory", created(),
        {"missing": "drop_rows"}, ["dropped rows without price"])
    return rows.select("dataset_id", "parent_id", "n_rows", "n_columns", "parent_rows", "parent_columns")
