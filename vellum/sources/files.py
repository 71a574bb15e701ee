"""Readers and writers: JSON folders, JSON lines with bad lines kept apart, compressed files told by content, uploads, upserts."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def merged_articles(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All ``articles`` of the JSON files of a folder, the first of each ``chunk_id`` by file name and place."""
    top = T.StructType([T.StructField("articles", T.ArrayType(schema))])
    raw = spark.read.schema(top).json(f"{folder}/*.json", multiLine=True).withColumn("file", F.input_file_name())
    each = raw.select("file", F.posexplode("articles").alias("k", "a")).select("file", "k", "a.*")
    w = Window.partitionBy("chunk_id").orderBy("file", "k")
    return each.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "file", "k")


def list_or_data(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON list, or of the list under ``data``."""
    text = spark.read.text(path, wholetext=True)
    under = T.StructType([T.StructField("data", T.ArrayType(schema))])
    direct = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(schema))).otherwise(F.from_json("value", under)["data"])
    return text.select(F.inline(direct))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the lines that can't be read. Blank lines are neither."""
    bad = "_corrupt_record"
    own = T.StructType([*(f for f in schema.fields if f.name != bad), T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return read.where(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad), read.where(F.col(f"r.{bad}").isNotNull()).select(F.col("value").alias("line"))


#: Lines of a file that leave the reader together.
LINES = 10_000


def maybe_gzip_lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, k, line`` of text files that are compressed or not, told by their first bytes and not by their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                raw = io.BytesIO(content)
                lines = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if bytes(content[:2]) == b"\x1f\x8b" else raw, "utf-8", "replace")
                k = 0
                while rows := [x.rstrip("\r\n") for x in islice(lines, LINES)]:
                    yield pd.DataFrame({"path": p, "k": range(k, k + len(rows)), "line": rows})
                    k += len(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, k long, line string")


def plain_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of text files; formats that need a parser of their own give an empty text."""
    files = spark.read.format("binaryFile").load(path)
    known = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin("txt", "md", "hwpx")
    return files.select("path", F.when(known, F.decode("content", "UTF-8")).otherwise("").alias("text"))


def admitted(files: DataFrame, kinds: DataFrame, max_bytes: int = 50 << 20) -> DataFrame:
    """``files(path, length, mime)`` with ``reason`` null if admitted. ``kinds(extension, mimes)``; an unspecific MIME type passes."""
    own = files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    j = own.join(kinds, "extension", "left")
    mime_ok = (F.col("mime") == "application/octet-stream") | F.array_contains("mimes", F.col("mime"))
    why = F.when(F.col("mimes").isNull(), "extension").when(F.col("length") > max_bytes, "size").when(~F.coalesce(mime_ok, F.lit(False)), "mime")
    return j.select(*files.columns, why.alias("reason"))


def attach(points: DataFrame, payload: DataFrame, key: str, how: str = "inner") -> tuple[DataFrame, DataFrame]:
    """Points with their payload, and the points without any (dropped by ``inner``, kept with nulls by ``left``)."""
    return points.join(payload, key, how), points.join(payload, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key the new ones don't have, and the new ones; columns that one side lacks are null there."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def cached_conversions(files: DataFrame, cache: DataFrame, convertible: tuple[str, ...] = ("hwp",)) -> DataFrame:
    """``files(path, modified)`` with ``use``: the file itself, or for those to be converted a cached result that isn't older; null where it must be made.

    ``cache(path, modified)`` holds files of the same name with another ending.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.[^.]*$", "")
    own = files.withColumn("stem", stem("path"))
    kept = cache.groupBy(stem("path").alias("stem")).agg(F.max_by(F.struct("path", "modified"), "modified").alias("c"))
    met = own.join(kept, "stem", "left")
    fresh = F.when(F.col("c.modified") >= F.col("modified"), F.col("c.path"))
    to_convert = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).isin(*convertible)
    return met.select(*files.columns, F.when(to_convert, fresh).otherwise(F.col("path")).alias("use"))


def zip_by_place(vectors: DataFrame, weights: DataFrame) -> DataFrame:
    """Two files of one order joined by the place ``k``; they must be equally long, without gaps or repeats (one job a file)."""
    sizes = [tuple(df.agg(F.count("*"), F.count_distinct("k"), F.coalesce(F.max("k") + 1, F.lit(0))).first()) for df in (vectors, weights)]
    (a, *x), (b, *y) = sizes
    if a != b or x != [a, a] or y != [b, b]:
        raise ValueError(f"{a} vectors and {b} weights don't match place by place")
    return vectors.join(weights, "k", "full")
