"""Statutes: lines to articles, hierarchical ids and the graph of references."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import Names
from .ordered import keep_first

# How statutes write their parts.
ARTICLE = r"^제\s*(\d+)\s*조(?:의\s*(\d+))?\s*(?:\(([^)]*)\))?"
CHAPTER, PART, SUPPLEMENT = r"^제\s*(\d+)\s*장", r"^제\s*(\d+)\s*절", r"^부\s*칙"


def articles(lines: DataFrame) -> DataFrame:
    """``file, jang, jeol, jo, jo_ui, title, text, chunk_id`` from ``lines(file, ord, prefix, line)``.

    Chapter and section hold until the next one (a chapter ends its section), nothing counts after the supplementary
    provisions, lines follow the article before them, and of an article given twice the first stays.
    """
    upto = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    without = lambda s, sign, pattern: F.when(s.contains(sign), F.regexp_replace(s, pattern, "")).otherwise(s)
    clean = F.trim(without(without(F.col("line"), "<", r"<[^>]+>"), "[", r"\[[^\]]+\]"))
    num = lambda p, k: F.nullif(F.regexp_extract("line", p, k), F.lit("")).cast("int")
    is_article = F.col("line").rlike(ARTICLE)
    own = lines.select("file", "ord", "prefix", F.explode(F.filter(F.array(clean), lambda x: x != "")).alias("line"))  # a filter would clean each line twice
    own = own.withColumn("head", is_article).withColumn("is_jang", F.col("line").rlike(CHAPTER) & ~F.col("head"))
    own = own.withColumn("is_jeol", F.col("line").rlike(PART) & ~F.col("head") & ~F.col("is_jang"))
    # one window for all, so a file's lines are sorted once; a section holds until the next one, or a chapter
    section = F.when(F.col("is_jang"), F.struct(F.lit(None).cast("int").alias("n"))).when(F.col("is_jeol"), F.struct(num(PART, 1).alias("n")))
    own = own.select(
        "file", "ord", "prefix", "line", "head", F.max(F.col("line").rlike(SUPPLEMENT)).over(upto).alias("ended"), F.last(F.when(F.col("is_jang"), num(CHAPTER, 1)), True).over(upto).alias("jang"),
        F.last(section, True).over(upto)["n"].alias("jeol"), F.sum((F.col("head") | F.col("is_jang") | F.col("is_jeol")).cast("int")).over(upto).alias("block"),
    ).where("not ended")
    rows = F.array_sort(F.collect_list(F.struct("ord", "line", "head", "prefix", "jang", "jeol")))
    whole = own.groupBy("file", "block").agg(rows.alias("r")).where(F.get("r", F.lit(0))["head"])
    first = F.get("r", F.lit(0))
    at = lambda k: F.nullif(F.regexp_extract(first["line"], ARTICLE, k), F.lit(""))
    out = whole.select(
        "file", first["ord"].alias("ord"), first["prefix"].alias("prefix"), first["jang"].alias("jang"), first["jeol"].alias("jeol"), at(1).cast("int").alias("jo"), at(2).cast("int").alias("jo_ui"),
        F.coalesce(at(3), F.lit("")).alias("title"), F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("text"),
    )
    out = keep_first(out, ["file", "jo", "jo_ui"], [F.col("ord")])
    return out.withColumn("chunk_id", article_id())


def article_id():
    """Prefix, chapter, section, article (``7-2`` for 제7조의2); absent parts are 0."""
    jo = F.concat(F.col("jo").cast("string"), F.when(F.col("jo_ui").isNotNull(), F.concat(F.lit("-"), F.col("jo_ui").cast("string"))).otherwise(""))
    return F.concat_ws("_", "prefix", F.coalesce("jang", F.lit(0)).cast("string"), F.coalesce("jeol", F.lit(0)).cast("string"), jo)


# Brackets around the title of a law, and what ends the passage that belongs to it.
OPEN, CLOSE, STOP = "「『《", "」』》", "。.\n"
#: Characters after a title in which its articles are looked for.
NEAR = 150
HANGUL = "가나다라마바사아자차카타파하"


def number_of(unit: str, branch: bool = False) -> str:
    """The pattern of a numbered part of a statute, with the number as a group, and that of a branch if it can have one."""
    return rf"제(\d+){unit}" + (r"(?:의(\d+))?" if branch else "")


def range_of(unit: str) -> re.Pattern:
    """From one number of a unit to another."""
    return re.compile(rf"{number_of(unit)}부터\s*{number_of(unit)}(?:까지)?")


_TITLE = re.compile(rf"[{OPEN}]([^{CLOSE}]+)[{CLOSE}]\s*")
_END = re.compile(rf"[{STOP}{OPEN}]")
_ARTICLES, _BARE = range_of("조"), re.compile(number_of("조", True))


def passages(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, title, passage) for each title of a law in brackets, with the passage behind it that speaks of its parts."""
    out = []
    for m in _TITLE.finditer(text):
        end = _END.search(text, m.end())
        passage = (text[m.end() : end.start()] if end else text[m.end() : m.end() + NEAR]).rstrip()
        out.append((m.start(), m.end() + len(passage), m[1], passage))
    return out


def law_of(title: str, prefixes: dict[str, str], names: Names) -> str | None:
    """The prefix of the longest known name in a title."""
    name = names.longest(title)
    return prefixes[name] if name else None


def mentions(text: str, prefix: str, prefixes: dict[str, str], names: Names) -> list[tuple[str, int, int | None]]:
    """(prefix, article, branch) that a text refers to, in order, each once: titled laws, ranges, then bare articles.

    What one rule has consumed the next doesn't see.
    """
    out: dict[tuple[str, int, int | None], None] = {}
    taken = []
    for a, b, title, passage in passages(text):
        taken.append((a, b))
        if law := law_of(title, prefixes, names):
            out.update({(law, int(n), int(u) if u else None): None for n, u in _BARE.findall(passage)})
    for m in _ARTICLES.finditer(text):
        if not any(a <= m.start() < b for a, b in taken):
            out.update({(prefix, n, None): None for n in range(int(m[1]), int(m[2]) + 1)})
        taken.append(m.span())
    for m in _BARE.finditer(text):
        if not any(a <= m.start() < b for a, b in taken):
            out[prefix, int(m[1]), int(m[2]) if m[2] else None] = None
    return list(out)


def references(chunks: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """``chunk_id, k, ref_id, is_resolved`` of articles: mentions resolved by a join with the articles themselves.

    A mention that no article answers keeps an id built without chapter and section. Mentions of the article itself are dropped.
    """

    @F.pandas_udf("array<struct<prefix: string, jo: int, jo_ui: int>>")
    def found(text: pd.Series, prefix: pd.Series) -> pd.Series:
        names = Names(prefixes)
        return pd.Series([[{"prefix": p, "jo": j, "jo_ui": u} for p, j, u in mentions(t or "", x, prefixes, names)] for t, x in zip(text, prefix, strict=True)])

    each = chunks.select("chunk_id", F.col("prefix").alias("own"), F.col("jo").alias("own_jo"), F.col("jo_ui").alias("own_ui"), F.posexplode(found("text", "prefix")).alias("k", "m"))
    each = each.select("chunk_id", "own", "own_jo", "own_ui", "k", "m.prefix", "m.jo", "m.jo_ui")
    each = each.where(~((F.col("prefix") == F.col("own")) & (F.col("jo") == F.col("own_jo")) & F.col("jo_ui").eqNullSafe(F.col("own_ui"))))
    registry = chunks.groupBy(F.col("prefix").alias("rp"), F.col("jo").alias("rj"), F.col("jo_ui").alias("ru")).agg(F.min("chunk_id").alias("hit"))
    j = each.join(registry, (F.col("prefix") == F.col("rp")) & (F.col("jo") == F.col("rj")) & F.col("jo_ui").eqNullSafe(F.col("ru")), "left")
    built = article_id_of("prefix", "jo", "jo_ui")
    return j.select("chunk_id", "k", F.coalesce("hit", built).alias("ref_id"), F.col("hit").isNotNull().alias("is_resolved"))


def article_id_of(prefix: str, jo: str, jo_ui: str):
    tail = F.when(F.col(jo_ui).isNotNull(), F.concat(F.lit("-"), F.col(jo_ui).cast("string"))).otherwise("")
    return F.concat_ws("_", prefix, F.lit("0"), F.lit("0"), F.concat(F.col(jo).cast("string"), tail))
