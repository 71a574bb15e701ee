"""Lookups against small configured sets, fuzzy titles, referenced keys, and regions over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from . import ordered as O


#: Rows that a configured table may have where each of them meets each row of another.
MOST_ROWS = 10_000


def with_each(df: DataFrame, configured: DataFrame, *columns: str) -> DataFrame:
    """Every row of ``df`` with every row of a small configured table, of which ``columns`` are kept; more than ``MOST_ROWS`` are refused."""
    rows = configured.select(*columns).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} configured rows")
    kinds = [configured.schema[c].dataType for c in columns]
    each = F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for v, t, c in zip(r, kinds, columns, strict=True))) for r in rows))
    return df.select("*", F.inline(each)) if rows else df.join(configured.select(*columns), F.lit(False))


def longest_key(text: Column, keys: list[str]) -> Column:
    """The longest of the keys that the text contains (of equally long ones the first by name); null if there is none."""
    ranked = sorted(set(keys), key=lambda k: (-len(k), k))
    return F.coalesce(*(F.when(text.contains(k), k) for k in ranked), F.lit(None).cast("string"))


def first_alias(text: Column, kinds: list[tuple[str, list[str]]]) -> Column:
    """The first kind with an alias that contains the text or is contained in it; null for a blank text or without a match."""
    filled = F.trim(text) != ""
    hits = [F.when(filled & (text.contains(a) | F.lit(a).contains(text)), kind) for kind, aliases in kinds for a in aliases]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def fuzzy_titles(wanted: DataFrame, sections: DataFrame, least: float = 0.55) -> DataFrame:
    """``doc_id, code, section, score``: the section of the same document whose title fits each wanted one best.

    ``wanted(doc_id, code, title)``, ``sections(doc_id, ord, title)``. A title that holds the other in its compared
    form scores 1 and the first such section wins; otherwise the best similarity of at least ``least``.
    """
    a = wanted.select("doc_id", "code", T.compare_form(F.col("title"), lower=True).alias("a"))
    b = sections.select("doc_id", "ord", F.col("title").alias("section"), T.compare_form(F.col("title"), lower=True).alias("b"))
    met = a.join(b, "doc_id").where("a <> '' and b <> ''")
    held = F.col("a").contains(F.col("b")) | F.col("b").contains(F.col("a"))
    scored = met.withColumn("score", F.when(held, 1.0).otherwise(S.ratio("a", "b"))).where(F.col("score") >= least)
    return O.keep_first(scored, ["doc_id", "code"], [F.desc("score"), F.asc("ord")]).select("doc_id", "code", "section", "score")


def unreferenced(dimension: DataFrame, key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """The dimension's rows with ``deletable``: whether no fact refers to them. Facts are reduced to their keys first."""
    used = facts.select(F.col(fact_key).alias("__used")).where("__used is not null").distinct()
    met = dimension.join(used, F.col(key) == F.col("__used"), "left")
    return met.withColumn("deletable", F.col("__used").isNull()).drop("__used")


def page_fragments(regions: DataFrame, height: Column) -> DataFrame:
    """One row for each page that a region ``(start_page, start_y, stop_page, stop_y)`` touches, with its ``y0`` and ``y1`` there; empty parts are left out."""
    each = regions.withColumn("page", F.explode(F.when(F.col("stop_page") >= F.col("start_page"), F.sequence("start_page", "stop_page"))))
    y0 = F.when(F.col("page") == F.col("start_page"), F.col("start_y")).otherwise(F.lit(0.0))
    y1 = F.when(F.col("page") == F.col("stop_page"), F.col("stop_y")).otherwise(height)
    return each.withColumn("y0", y0).withColumn("y1", y1).where("y1 > y0")


def in_order(items: Column, field: str) -> Column:
    """The strings in a field of an array of structs, sorted by the struct and joined."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x[field]), "")


def numbered(items: Column, n: int, width: int) -> Column:
    """The first ``n`` texts of an array as numbered lines, each cut to ``width`` characters."""
    line = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(x, 1, width))
    return F.array_join(F.transform(F.slice(items, 1, n), line), "\n")
