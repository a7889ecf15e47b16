"""What is known about each file of a folder."""

from __future__ import annotations

import hashlib
import io
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesmith.functions.text import file_extension
from tablesmith.operators.quality import MAX_FILE_BYTES

#: Larger files are read piece by piece instead of as one value.
WHOLE_BYTES, PIECE_BYTES, HEAD_BYTES = 64 << 20, 4 << 20, 100


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths to (path, sha256, head): a running hash over pieces, so a file's size does not matter."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            where, inner = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
            state, head = hashlib.sha256(), b""
            with where.open_input_stream(urllib.parse.unquote(inner)) as stream:
                while piece := stream.read(PIECE_BYTES):
                    head = head or bytes(io.BytesIO(piece).read(HEAD_BYTES))
                    state.update(piece)
            yield pa.record_batch([pa.array([path]), pa.array([state.hexdigest()]), pa.array([head], pa.binary())], names=["path", "sha256", "head"])


def file_manifest(spark: SparkSession, path: str, max_bytes: int = MAX_FILE_BYTES, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Size, extension, SHA-256 and content checks of every file, whatever its size.

    Files up to ``whole_bytes`` go through Spark's reader and built-in functions; the length filter is pushed to the
    source, so larger ones are only listed by it, and then hashed piece by piece, one task per file. Files above
    ``max_bytes`` are checked like the others and marked as too large. Empty files have no time of change.
    """
    files = spark.read.format("binaryFile").load(path)
    facts = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), file_extension("path").alias("extension"),
             F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    small = files.where(F.col("length") <= whole_bytes).select(
        *facts, F.sha2("content", 256).alias("sha256"), F.substring("content", 1, HEAD_BYTES).alias("head"))
    large = files.where(F.col("length") > whole_bytes).select(*facts)
    read = large.select("path").repartition("path").mapInArrow(_pieces, "path string, sha256 string, head binary")
    # The source gives no rows for empty files; their names come from its listing.
    listed = spark.createDataFrame([(urllib.parse.unquote(f).replace("file:///", "file:/"),) for f in files.inputFiles()], "path string").join(files.select("path"), "path", "left_anti")
    empty = listed.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), file_extension("path").alias("extension"), F.lit(0).cast("long").alias("size"),
        F.lit(None).cast("timestamp").alias("modified"), F.lit(hashlib.sha256(b"").hexdigest()).alias("sha256"), F.lit(b"").alias("head"))
    both = small.unionByName(large.join(read, "path")).unionByName(empty)
    cut = lambda n: F.substring("head", 1, n)
    # The cut after 100 bytes may fall inside a character of up to four bytes.
    text = F.is_valid_utf8(cut(HEAD_BYTES))
    for n in range(HEAD_BYTES - 3, HEAD_BYTES):
        text = text | ((F.col("size") > HEAD_BYTES) & F.is_valid_utf8(cut(n)))
    starts = F.hex(cut(4))
    checked = both.select(
        "path", "name", "extension", "size", "modified", "sha256", F.hex(cut(8)).contains(F.lit("504B")).alias("is_zip"), text.alias("is_text"),
        (starts.startswith("4D5A") | starts.contains("454C46")).alias("is_executable"))
    wrong = (
        F.when(F.col("size") > max_bytes, "file_too_large")
        .when(F.col("is_executable"), "executable_content")
        .when((F.col("extension") == ".xlsx") & ~F.col("is_zip"), "not_a_workbook")
        .when(F.col("extension").isin(".csv", ".tsv") & ~F.col("is_text"), "not_text"))
    return checked.withColumn("problem", wrong)
