"""Connected components of an edge table by alternating stars.

Each round makes every node point to its smallest neighbour (large star, then
small star). A hub only meets partial minima and a join, never one list; the
number of rounds is logarithmic in the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def _large_star(e: DataFrame, how: str | None) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low.hint(how) if how else low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame, how: str | None) -> DataFrame:
    down = e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low.hint(how) if how else low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def _signature(e: DataFrame) -> tuple:
    r = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame, scratch: Scratch, how: str | None = None) -> DataFrame:
    """``edges(u, v)`` with orderable keys, ``u <> v`` -> ``(node, root)`` for every node with an edge.

    The root is the smallest node of the component and is itself listed.
    An empty edge table gives an empty result. ``how`` is a hint for the rounds' joins: with ``merge`` none is a broadcast,
    of which a long job on a small driver would make very many.
    """
    e = scratch.cut(edges.select("u", "v").distinct(), "edges")
    last = _signature(e)
    while last[0]:
        new = scratch.cut(_small_star(_large_star(e, how), how).distinct(), "edges")
        now = _signature(new)
        scratch.drop(e)
        e = new
        if now == last:
            break
        last = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
