"""Exact quantiles without a buffer that grows with the rows.

Counts of value ranges come first: of each group ``BINS`` ranges between its
least and greatest value. A rank lies in one of them; where the range holds a
single value, that is the answer. The others are cut once more into ``BINS``, and
only rows of the ranges that are still open are ranked, range by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def _bin(v: Column, low: Column, high: Column) -> Column:
    """A range's number, which never falls as the value grows."""
    part = F.try_divide(v - low, high - low)
    return F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(F.coalesce(part, F.lit(0.0)) * BINS))).cast("int")


def exact_quantiles(df: DataFrame, group: list[str], value: str, at: tuple[float, ...]) -> DataFrame:
    """``group ..., n, q``: the number of values of each group, and its quantiles at ``at`` in an array, linear between neighbours.

    Null and NaN values don't count; a group without any other has nulls.
    """
    keys = [f"__g{k}" for k in range(len(group))]
    own = df.select(*(F.col(c).alias(k) for c, k in zip(group, keys, strict=True)), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("v"))
    stats = own.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    same = lambda a, b, names: _all([F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in names])

    first = own.where("v is not null").alias("r").join(stats.alias("s"), same("r", "s", keys)).select(*(F.col(f"r.{k}") for k in keys), "r.v", _bin(F.col("r.v"), F.col("s.low"), F.col("s.high")).alias("bin"))
    counts = first.groupBy(*keys, "bin").agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))  # BINS rows a group
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0) if keys else Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("before", F.sum("c").over(upto) - F.col("c"))
    ranks = stats.where("n > 0").select(*keys, F.explode(F.array_distinct(F.flatten(F.array(*(F.array(F.floor(x), F.ceil(x)) for x in ((F.col("n") - 1) * F.lit(p) for p in at)))))).alias("rank"))
    wanted = ranks.alias("w").join(counts.alias("c"), same("w", "c", keys) & (F.col("w.rank") >= F.col("c.before")) & (F.col("w.rank") < F.col("c.before") + F.col("c.c")))
    wanted = wanted.select(*(F.col(f"w.{k}") for k in keys), "w.rank", "c.bin", "c.low", "c.high", "c.before")
    known = wanted.where("low = high").select(*keys, "rank", F.col("low").alias("v"))
    open_ = wanted.where("low < high")
    # the ranges that are left, cut once more
    ranges = open_.select(*keys, "bin", "low", "high").distinct()
    again = first.alias("r").join(ranges.alias("s"), same("r", "s", [*keys, "bin"])).select(*(F.col(f"r.{k}") for k in keys), "r.bin", "r.v", _bin(F.col("r.v"), F.col("s.low"), F.col("s.high")).alias("sub"))
    subs = again.groupBy(*keys, "bin", "sub").agg(F.count("*").alias("c"))
    inner = Window.partitionBy(*keys, "bin").orderBy("sub").rowsBetween(Window.unboundedPreceding, 0)
    subs = subs.withColumn("before", F.sum("c").over(inner) - F.col("c"))
    place = open_.alias("w").join(subs.alias("c"), same("w", "c", [*keys, "bin"]) & (F.col("w.rank") - F.col("w.before") >= F.col("c.before")) & (F.col("w.rank") - F.col("w.before") < F.col("c.before") + F.col("c.c")))
    place = place.select(*(F.col(f"w.{k}") for k in keys), "w.rank", "w.bin", "c.sub", (F.col("w.rank") - F.col("w.before") - F.col("c.before")).alias("nth"))
    few = again.alias("r").join(place.select(*keys, "bin", "sub").distinct().alias("s"), same("r", "s", [*keys, "bin", "sub"]), "left_semi")
    ranked = few.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "bin", "sub").orderBy("v")) - 1)
    rest = place.alias("w").join(ranked.alias("r"), same("w", "r", [*keys, "bin", "sub"]) & (F.col("w.nth") == F.col("r.nth"))).select(*(F.col(f"w.{k}") for k in keys), "w.rank", "r.v")
    values = known.unionByName(rest).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("m"))
    out = stats.alias("s").join(values.alias("m"), same("s", "m", keys), "left")

    def quantile(p: float) -> Column:
        x = (F.col("s.n") - 1) * F.lit(p)
        a, b = F.try_element_at("m.m", F.floor(x)), F.try_element_at("m.m", F.ceil(x))
        return a + (b - a) * (x - F.floor(x))

    return out.select(*(F.col(f"s.{k}").alias(c) for c, k in zip(group, keys, strict=True)), F.col("s.n").alias("n"), F.array(*map(quantile, at)).alias("q"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
