"""Comparison of runs and judges, on and off pivots, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def run_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, before, after, change`` where two runs ``(key, rank)`` differ; a missing rank is a miss."""
    both = before.select(key, F.col("rank").alias("before")).join(after.select(key, F.col("rank").alias("after")), key, "full")
    a, b = F.col("before"), F.col("after")
    change = F.when(a.isNull(), "recovered").when(b.isNull(), "regressed").when(b < a, "better").otherwise("worse")
    return both.where(~a.eqNullSafe(b)).withColumn("change", change)


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """``n, agreed, rate`` over the rows where both judged; the rate is null without any."""
    both = df.where(a.isNotNull() & b.isNotNull())
    out = both.agg(F.count("*").alias("n"), F.count_if(a == b).alias("agreed"))
    return out.withColumn("rate", F.round(F.try_divide("agreed", "n"), 6))


def on_off(df: DataFrame, by: list[str], switch: str, off: str, on: str, value: str) -> DataFrame:
    """Means with a switch off and on, and their difference (null where a side is missing)."""
    out = df.groupBy(*by).pivot(switch, [off, on]).agg(F.avg(value))
    a, b = F.col(f"`{off}`"), F.col(f"`{on}`")
    return out.select(*by, F.round(a, 6).alias("mean_off"), F.round(b, 6).alias("mean_on"), F.round(b - a, 6).alias("delta"))


def costs(calls: DataFrame, prices: list[tuple[str, float, float]]) -> DataFrame:
    """Cost by model of all calls ``(tokens_in, tokens_out)``, its mean, and that of ten thousand; prices are for a million tokens.

    Tokens are summed once, before the prices come in.
    """
    total = calls.agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(float(i)).alias("price_in"), F.lit(float(o)).alias("price_out")) for m, i, o in prices))
    cost = (F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6
    out = total.select("*", F.inline(models)).withColumn("cost", cost)
    mean = F.try_divide("cost", "n")
    return out.select("model", "n", "tokens_in", "tokens_out", F.round("cost", 6).alias("cost"), F.round(mean, 9).alias("per_call"), F.round(mean * 10000, 5).alias("per_10k"))


def class_counts(text: Column, good: str, broken: str) -> tuple[Column, Column]:
    """How many characters of a text belong to two classes of characters (written as in a pattern, without brackets)."""
    own = F.coalesce(text, F.lit(""))
    count = lambda c: F.length(own) - F.length(F.regexp_replace(own, f"[{c}]+", ""))
    return count(good), count(broken)
