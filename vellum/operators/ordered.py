"""Operators over ordered rows: latest per key, streaks, sessions, gaps, forward fill, monotone folds, nearest and overlap joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key in the given order."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key, the first in order (not an arbitrary one)."""
    return latest(df, keys, order).drop("nth")


def reset_groups(df: DataFrame, keys: list[str], order: list[Column], reset: Column, name: str = "grp") -> DataFrame:
    """Numbers the stretches that begin at each row where ``reset`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(reset, F.lit(False)).cast("int")).over(w))


def failure_streaks(df: DataFrame, user: str, order: list[Column], failed: Column, reset: Column, limit: int = 5) -> DataFrame:
    """Consecutive failures since the last reset, and whether this one locks the account.

    The counter comes from the log itself, so the failure that locks is counted too.
    """
    own = reset_groups(df, [user], order, reset)
    w = Window.partitionBy(user, "grp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn("streak", F.sum(failed.cast("int")).over(w)).withColumn("locks", failed & (F.col("streak") == limit)).drop("grp")


def idle_sessions(df: DataFrame, user: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """Numbers sessions that end after ``seconds`` without an event."""
    w = Window.partitionBy(user).orderBy(ts, tie)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))
    own = df.withColumn("__new", gap.isNull() | (gap > seconds * 1_000_000))
    return reset_groups(own, [user], [F.col(ts), F.col(tie)], F.col("__new"), "session").drop("__new")


def gap_groups(df: DataFrame, keys: list[str], order: list[Column], start: Column, stop: Column, gap: float, opens: Column | None = None) -> DataFrame:
    """A new group where a row opens one, or begins more than ``gap`` after the last one's end."""
    w = Window.partitionBy(*keys).orderBy(*order)
    far = (start - F.lag(stop).over(w)) > gap
    own = df.withColumn("__new", F.coalesce(far, F.lit(True)) | (opens if opens is not None else F.lit(False)))
    return reset_groups(own, keys, order, F.col("__new"), "grp").drop("__new")


def forward_fill(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str, reset: Column | None = None) -> DataFrame:
    """The last non-null value so far; a row where ``reset`` holds forgets it."""
    own, by = df, list(keys)
    if reset is not None:
        own, by = reset_groups(df, keys, order, reset, "__grp"), [*keys, "__grp"]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return own.withColumn(name, F.last(value, ignorenulls=True).over(w)).drop("__grp")


def monotone_fold(items: Column, tolerance: int = 1) -> Column:
    """Accepts numbers of an ordered array that are the last accepted one or up to ``tolerance`` more; others don't move it.

    Gives the indices of the accepted ones. A window can't express it: what is accepted depends on what was.
    """
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("taken"))

    def step(acc: Column, n: Column) -> Column:
        ok = (n >= acc["last"]) & (n <= acc["last"] + tolerance)
        return F.struct(
            F.when(ok, n.cast("long")).otherwise(acc["last"]).alias("last"),
            (acc["i"] + 1).alias("i"),
            F.when(ok, F.array_append(acc["taken"], acc["i"])).otherwise(acc["taken"]).alias("taken"),
        )

    return F.aggregate(items, start, step)["taken"]


def nearest(items: Column, at: Column) -> Column:
    """The item of an array of structs ``(pos, ...)`` whose position is nearest; the first of equally near ones."""
    ranked = F.transform(items, lambda x, i: F.struct(F.abs(x["pos"] - at).alias("gap"), i.alias("i"), x.alias("x")))
    return F.array_min(ranked)["x"]


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, left_id: str, right_id: str) -> DataFrame:
    """``left_id, right_id``: for each left row the right row of the same keys whose ``at`` is nearest, of equally near ones that with the smallest id.

    Both sides stand in one order, and the candidates are the last right row at or before a left one and the first behind it:
    no list and no pairs, however many rows a key has. Left rows of keys without right ones are left out.
    """
    none = F.lit(None)
    cols = lambda df, side: df.select(*keys, F.col(at).alias("at"), F.lit(side).alias("side"), (F.col(left_id) if side else none.cast("long")).alias("l"), (none.cast("long") if side else F.col(right_id)).alias("r"))
    both = cols(left, 1).unionByName(cols(right, 0)).withColumn("hit", F.when(F.col("side") == 0, F.struct("at", F.col("r").alias("id"))))
    w = Window.partitionBy(*keys)
    before = F.last("hit", True).over(w.orderBy("at", "side", F.desc("r")).rowsBetween(Window.unboundedPreceding, -1))
    behind = F.first("hit", True).over(w.orderBy("at", F.desc("side"), "r").rowsBetween(1, Window.unboundedFollowing))
    own = both.withColumn("a", before).withColumn("b", behind).where("side = 1")
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.at") - F.col("at")).alias("gap"), F.col(f"{c}.id").alias("id")))
    return own.select(F.col("l").alias(left_id), F.array_min(F.array_compact(F.array(far("a"), far("b"))))["id"].alias(right_id)).where(F.col(right_id).isNotNull())


def best_overlap(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, width: int) -> DataFrame:
    """For each left interval ``(l_start, l_stop)`` the right one ``(r_start, r_stop)`` of the same keys that overlaps it most (the first of equal ones).

    Intervals meet in bins of ``width`` (a usual length), so those that lie apart aren't paired; a pair counts in the bin where
    the later of the two begins.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(width))
    last = lambda c: F.floor((F.col(c) - 1) / F.lit(width))
    bins = lambda df, x: df.where(F.col(f"{x}_stop") > F.col(f"{x}_start")).withColumn("bin", F.explode(F.sequence(bin_of(f"{x}_start"), F.greatest(bin_of(f"{x}_start"), last(f"{x}_stop")))))
    both = bins(left, "l").join(bins(right, "r"), [*keys, "bin"]).where(F.col("bin") == F.greatest(bin_of("l_start"), bin_of("r_start")))
    both = both.where((F.col("l_start") < F.col("r_stop")) & (F.col("r_start") < F.col("l_stop"))).drop("bin")
    both = both.withColumn("overlap", F.least("l_stop", "r_stop") - F.greatest("l_start", "r_start"))
    return latest(both, [*keys, left_id], [F.desc("overlap"), F.asc(right_id)]).drop("nth")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, scratch: Scratch) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of the keys up to the row in an order that has no ties.

    Rows are dealt by ranges of keys and order, so a frequent key is many tasks': sums of the ranges are added up first (one row
    for each key of a range), and within a range rows follow their places. With ``F.lit(1)`` it is a rank.
    """
    dealt = df.withColumn("__v", value).repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id())
    dealt = scratch.cut(dealt.withColumn("__part", F.shiftright("__at", 33)), "dealt")
    here = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "__part").agg(F.sum("__v").alias("__s")).withColumn("__ahead", F.coalesce(F.sum("__s").over(before), F.lit(0)))
    ahead = sums.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__part").alias("__p"), "__ahead")
    same = F.col("__part") == F.col("__p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    met = dealt.withColumn("__own", F.sum("__v").over(here)).join(ahead, same)
    return met.withColumn(name, F.col("__own") + F.col("__ahead")).select(*df.columns, name)
