"""Tables written in the folder that all executors share, to cut lineage.

The folder is the one ``spark.checkpoint.dir`` names. Only where the session
has none and runs on one machine (tests, notebooks) is a local temporary folder
set; on a cluster its executors would each write to a folder of their own.

A call deletes the tables that its result doesn't read. What a lazy result
still reads stays until the caller has used it: ``with kept():`` around calls and
the use of their results deletes what those calls have left, as ``release`` does
by hand; what is left at the end of the process goes then.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; sets a temporary one only if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not own:
        top = tempfile.mkdtemp(prefix="vellum-")
        atexit.register(shutil.rmtree, top, True)
        spark.sparkContext.setCheckpointDir(top)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


#: The calls whose folders may still hold tables.
_CALLS: list[Scratch] = []


class Scratch:
    """Tables of one call. ``cut`` writes and rereads; ``drop`` deletes a table that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/vellum-{name}-{uuid.uuid4().hex}"
        self.n = 0
        _CALLS.append(self)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def cut(self, df: DataFrame, name: str = "t", codec: str = "snappy") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._vellum_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for df in tables:
            path = getattr(df, "_vellum_path", None)
            if path:
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """How many calls there have been; for ``release``."""
    return len(_CALLS)


def release(since: int = 0) -> None:
    """Deletes what the calls after ``since`` have left, once their results have been written or are no longer wanted."""
    while len(_CALLS) > since:
        own = _CALLS.pop()
        remove(own.spark, own.base)


@contextlib.contextmanager
def kept() -> Iterator[None]:
    """Keeps the tables of the calls inside for as long as the block runs, and deletes them after it."""
    since = mark()
    try:
        yield
    finally:
        release(since)
