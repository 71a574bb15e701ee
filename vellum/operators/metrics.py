"""Classification metrics and agreement, from ``gold`` and ``pred`` columns (null prediction: unparsable)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """A row for each gold label, a column for each predicted one; zeros where none."""
    out = df.groupBy("gold").pivot("pred", labels).count()
    return out.select("gold", *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("long").alias(f"pred_{x}") for x in labels))


def cohen_kappa(df: DataFrame, labels: list[str]) -> DataFrame:
    """``n, po, pe, kappa``: null without rows; 1 where chance agreement is 1."""
    both = df.where(F.col("gold").isin(labels) & F.col("pred").isin(labels))
    aggs = [F.count("*").alias("n"), F.count_if(F.col("gold") == F.col("pred")).alias("same")]
    for x in labels:
        aggs += [F.count_if(F.col("gold") == x).alias(f"g_{x}"), F.count_if(F.col("pred") == x).alias(f"p_{x}")]
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    po = F.col("same") / n
    pe = sum(((F.col(f"g_{x}") / n) * (F.col(f"p_{x}") / n) for x in labels[1:]), (F.col(f"g_{labels[0]}") / n) * (F.col(f"p_{labels[0]}") / n))
    t = both.agg(*aggs).select("n", po.alias("po"), pe.alias("pe"))
    kappa = F.when(F.col("pe") < 1, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).when(F.col("pe").isNotNull(), 1.0)
    return t.select("n", F.round("po", 6).alias("po"), F.round("pe", 6).alias("pe"), F.round(kappa, 6).alias("kappa"))


def kappa_band(k: Column) -> Column:
    """The usual words for an agreement."""
    return F.when(k < 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect")


def per_class(df: DataFrame, labels: list[str], drop_unparsable: bool = False) -> DataFrame:
    """``label, support, precision, recall, f1``."""
    own = df.where(F.col("pred").isNotNull()) if drop_unparsable else df
    ok = F.coalesce(F.col("gold") == F.col("pred"), F.lit(False))
    cells = own.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "gold", "pred", ok.alias("ok"))
    t = cells.groupBy("label").agg(
        F.count_if(F.col("gold") == F.col("label")).alias("support"), F.count_if(F.col("pred") == F.col("label")).alias("found"), F.count_if(F.col("ok") & (F.col("gold") == F.col("label"))).alias("tp"),
    )
    p, r = F.coalesce(F.try_divide("tp", "found"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return t.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def macro_f1(df: DataFrame, labels: list[str], mode: str) -> DataFrame:
    """Accuracy and macro F1 in three conventions.

    ``a`` drops unparsable predictions from the count; ``b`` counts them as wrong and averages labels with
    support; ``c`` averages over all labels seen on either side.
    """
    own = df.where(F.col("pred").isNotNull()) if mode == "a" else df
    t = per_class(own, labels)
    if mode == "b":
        t = t.where("support > 0")
    elif mode == "c":
        seen = own.select(F.explode(F.array("gold", "pred")).alias("label")).where("label is not null").distinct()
        t = t.join(F.broadcast(seen), "label", "left_semi")  # at most the labels
    acc = own.agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(F.col("gold") == F.col("pred"), F.lit(False)).cast("double")), 6).alias("accuracy"))
    return acc.join(t.agg(F.round(F.avg("f1"), 5).alias("macro_f1")))
