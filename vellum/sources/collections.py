"""A collection of rows by key, changed in place by buckets.

Rows lie in buckets of their key's hash. An upsert rewrites only the buckets that
new rows fall into, under a new version's folder, and then switches one pointer
file that says which folder each bucket is read from. A reader sees the old
version or the new one, and a writer that is killed leaves the old one as it was.
There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, POINTER = 64, "CURRENT"
_BUCKET = "__bucket"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _pointer(spark: SparkSession, path: str) -> dict | None:
    """What is current: ``keys``, ``buckets``, ``schema``, and ``folders`` by bucket; None without a collection."""
    fs, at = _fs(spark, f"{path}/{POINTER}")
    return json.loads(spark.read.text(at.toString(), wholetext=True).first()[0]) if fs.exists(at) else None


def _switch(spark: SparkSession, path: str, pointer: dict) -> None:
    """The new pointer is written aside and renamed over the old one."""
    fs, aside = _fs(spark, f"{path}/{POINTER}-{uuid.uuid4().hex}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(pointer, ensure_ascii=True).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context.rename(fs.makeQualified(aside), fs.makeQualified(_fs(spark, f"{path}/{POINTER}")[1]), options)


def _read(spark: SparkSession, path: str, pointer: dict, buckets: list[int] | None = None) -> DataFrame:
    wanted = pointer["folders"] if buckets is None else {b: f for b, f in pointer["folders"].items() if int(b) in buckets}
    folders = [f"{path}/{f}/{_BUCKET}={b}" for b, f in sorted(wanted.items())]
    schema = _schema(pointer["schema"])
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """The current rows."""
    pointer = _pointer(spark, path)
    if pointer is None:
        raise FileNotFoundError(f"no collection at {path}")
    return _read(spark, path, pointer)


def upsert_collection(points: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, recreate: bool = False) -> dict:
    """Puts points in place of old ones of their keys, or makes the collection anew; gives ``buckets`` rewritten and ``version``.

    A collection keeps the number of buckets and the keys that it was made with. Columns that one side lacks are null there.
    Of points that repeat a key all are kept, as they come.
    """
    spark = points.sparkSession
    path = path.rstrip("/")
    old = None if recreate else _pointer(spark, path)
    if old is not None and old["keys"] != keys:
        raise ValueError(f"the collection's keys are {old['keys']}")
    n = old["buckets"] if old else buckets
    bucket = F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")
    touched = [r[0] for r in points.select(bucket.alias("b")).distinct().collect()]  # one row a bucket
    rows = points
    if old is not None:
        kept = _read(spark, path, old, touched)
        rows = kept.join(points.select(*keys).distinct(), keys, "left_anti").unionByName(points, allowMissingColumns=True)
    version = f"v-{uuid.uuid4().hex}"
    rows.withColumn(_BUCKET, bucket).repartition(n, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{path}/{version}")
    folders = {**(old["folders"] if old else {}), **{str(b): version for b in touched}}
    _switch(spark, path, {"keys": keys, "buckets": n, "schema": rows.schema.json(), "folders": folders})
    return {"buckets": len(touched), "version": version}


def vacuum_collection(spark: SparkSession, path: str) -> int:
    """Deletes the folders that the current version doesn't read, once no reader has an older one open; gives how many."""
    pointer = _pointer(spark, path)
    used = set(pointer["folders"].values()) if pointer else set()
    fs, at = _fs(spark, path)
    gone = [x.getPath() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith("v-") and x.getPath().getName() not in used]
    for p in gone:
        fs.delete(p, True)
    return len(gone)
