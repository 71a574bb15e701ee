"""Statutes below the article: paragraphs (항), items (호), sub-items (목), their ids, and references among them.

An article's parts are cut by expressions on its row: no text is carried through a shuffle. Ids have eight
slots (law, chapter, section, article, paragraph, item, sub-item, detail), ``0`` where there is none. What a
chunk refers to is read by a function of its text (``mentions``); the targets are found by joins with a registry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import Scratch
from .mentions import OPENING, UNITS, mentions
from .names import longest_names
from .statutes import CHAPTER, HANGUL, PART

# How statutes and contract conditions mark their parts.
PARAGRAPHS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮"
ITEM = r"(?U)\s(\d{1,2}(?:의\d+)?)\.(?:\s|(?=[「『《]))"
SUB_ITEM = rf"(?U)\s([{HANGUL}])\.\s"
CLAUSE_LINE, ITEM_LINE = r"(?U)^\s*(\d+)\s*\.", rf"(?U)^\s*([{HANGUL}])\s*\."
NUMBERED_SUB, LETTERED_DETAIL = r"(?U)\s+(\d+)\)\s+", rf"(?U)(?<![,“\"”])\s+([{HANGUL}])\)\s*"

_ROW = "struct<hang: string, ho: string, mok: string, semok: string, text: string>"


def without_comments(s: Column) -> Column:
    """Without notes in pointed and square brackets."""
    return T.strip(F.regexp_replace(F.regexp_replace(s, r"<[^>]+>", ""), r"\[[^\]]+\]", ""))


def pieces(s: Column, pattern: str, sign: str | None = None) -> Column:
    """The text before the first mark, then for each mark to the next ``mark``, U+0002 and what follows; ``sign`` is a text that every mark holds."""
    found = F.split(F.regexp_replace(s, pattern, "\u0001$1\u0002"), "\u0001")
    return found if sign is None else F.when(s.contains(sign), found).otherwise(F.array(s))


def cut(s: Column, pattern: str, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of the text before the first mark, and of ``(mark, body)`` of each mark to the next; marks are found from left to right and don't overlap.

    A text is cut once, however often ``f`` names its parts.
    """
    body = lambda x: T.strip(F.split_part(x, F.lit("\u0002"), F.lit(2)))

    def both(found: Column) -> Column:
        rest = F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0)))
        parts = F.transform(rest, lambda x: F.struct(F.split_part(x, F.lit("\u0002"), F.lit(1)).alias("mark"), body(x).alias("body")))
        return F.struct(T.strip(F.get(found, F.lit(0))).alias("head"), parts.alias("parts"))

    return T.once(T.once(pieces(s, pattern), both), lambda c: f(c["head"], c["parts"]))


def _row(text: Column, hang: Column | None = None, ho: Column | None = None, mok: Column | None = None, semok: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(*((none if v is None else v).alias(k) for k, v in (("hang", hang), ("ho", ho), ("mok", mok), ("semok", semok))), text.alias("text")).cast(_ROW)


def provisions(articles: DataFrame) -> DataFrame:
    """All parts of articles as rows: ``prefix, jang, jeol, jo, jo_ui, hang, ho, mok, semok, text, chunk_id, parent_id, article_number, title``.

    Each level is cut and exploded by itself, so its expressions are compiled; ``k`` rises in the order of an article's text.
    An article's own row keeps what stands before its first part. Paragraphs begin at circled numbers, items at ``1.`` after
    white space, sub-items at ``가.``; an item with sub-items keeps what stands before them, one without keeps its number.
    ``articles`` has the columns of ``statutes.articles``.
    """
    own = ("prefix", "jang", "jeol", "jo", "jo_ui", "title")
    mark = lambda n, piece: F.when(F.col(n) > 0, F.split_part(F.col(piece), F.lit("\u0002"), F.lit(1)))
    body = lambda n, piece: T.strip(F.when(F.col(n) > 0, F.split_part(F.col(piece), F.lit("\u0002"), F.lit(2))).otherwise(F.col(piece)))
    # paragraphs
    each = articles.select(*own, F.posexplode(pieces(F.translate("text", "\n", " "), f"([{PARAGRAPHS[0]}-{PARAGRAPHS[-1]}])")).alias("k1", "p"))
    each = each.select(*own, "k1", mark("k1", "p").alias("sign"), body("k1", "p").alias("unit"))
    noted = F.col("unit").contains("<") | F.col("unit").contains("[")
    hang = F.call_function("instr", F.lit(PARAGRAPHS), F.col("sign")).cast("string")
    each = each.select(*own, "k1", hang.alias("hang"), F.coalesce(F.concat("sign", F.lit(" ")), F.lit("")).alias("lead"), F.when(noted, without_comments(F.col("unit"))).otherwise(F.col("unit")).alias("unit"))
    # items; both marks hold a full stop
    each = each.select(*own, "k1", "hang", "lead", F.posexplode(pieces(F.col("unit"), ITEM, ".")).alias("k2", "q"))
    each = each.select(*own, "k1", "hang", "lead", "k2", mark("k2", "q").alias("ho"), body("k2", "q").alias("unit"))
    subs = F.when(F.col("k2") > 0, pieces(F.concat(F.lit(" "), "unit", F.lit(" ")), SUB_ITEM, ".")).otherwise(F.array(F.lit("")))
    each = each.select(*own, "k1", "hang", "k2", "ho", F.concat(F.coalesce(F.concat("ho", F.lit(". ")), "lead"), "unit").alias("bare"), "unit", F.posexplode(subs).alias("k3", "r"))
    uncut = (F.col("k2") == 0) | ((F.col("k3") == 0) & (F.length("r") == F.length("unit") + 2))
    text = F.when(uncut, F.col("bare")).otherwise(F.concat(F.coalesce(F.concat(mark("k3", "r"), F.lit(". ")), F.lit("")), body("k3", "r")))
    k = F.shiftleft(F.col("k1").cast("long"), 42).bitwiseOR(F.shiftleft(F.col("k2").cast("long"), 21)).bitwiseOR(F.col("k3").cast("long"))
    none = F.lit(None).cast("string")
    return _named(each.select("prefix", "jang", "jeol", F.col("jo").cast("string").alias("jo"), F.col("jo_ui").cast("string").alias("jo_ui"), "title", k.alias("k"), "hang", "ho", mark("k3", "r").alias("mok"), none.alias("semok"), text.alias("text")))


def _slot(number: Column, branch: Column | None = None) -> Column:
    text = number if branch is None else F.concat(number, F.when(branch.isNotNull(), F.concat(F.lit("-"), branch)).otherwise(""))
    return F.coalesce(F.replace(text, F.lit("의"), F.lit("-")), F.lit("0"))


def slots(*levels: Column) -> Column:
    """``{prefix}_{장}_{절}_{조}_{항}_{호}_{목}_{세목}`` from the prefix and up to seven levels; the others are 0."""
    return F.concat_ws("_", *levels, *(F.lit("0") for _ in range(8 - len(levels))))


def _named(df: DataFrame) -> DataFrame:
    c = {k: F.col(k) for k in ("jang", "jeol", "hang", "ho", "mok", "semok")}
    head = [F.col("prefix"), _slot(c["jang"].cast("string")), _slot(c["jeol"].cast("string")), _slot(F.col("jo"), F.col("jo_ui"))]
    low = [_slot(c[k]) for k in ("hang", "ho", "mok", "semok")]
    up = F.when(c["semok"].isNotNull(), slots(*head, *low[:3])).when(c["mok"].isNotNull(), slots(*head, *low[:2])).when(c["ho"].isNotNull(), slots(*head, *low[:1]))
    up = up.when(F.col("jo").isNotNull() & c["hang"].isNotNull(), slots(*head))
    return df.select("prefix", "jang", "jeol", "jo", "jo_ui", "hang", "ho", "mok", "semok", "k", "title", "text", slots(*head, *low).alias("chunk_id"), up.alias("parent_id"), article_number().alias("article_number"))


def article_number() -> Column:
    """A chunk's place in words, from its levels."""
    c = {k: F.col(k) for k in ("jang", "jeol", "hang", "ho", "mok", "semok")}
    part = lambda col, unit: F.when(col.isNotNull(), F.concat(F.lit("제"), col.cast("string"), F.lit(unit))).otherwise("")
    ui = F.when(F.col("jo_ui").isNotNull(), F.concat(F.lit("의"), F.col("jo_ui"))).otherwise("")
    lettered = F.col("jo").isNull()  # contract conditions: letters for items, numbers for sub-items
    ho = F.when(lettered, F.coalesce(c["ho"], F.lit(""))).otherwise(part(c["ho"], "호"))
    mok = F.when(lettered, part(c["mok"], "호")).otherwise(F.coalesce(c["mok"], F.lit("")))
    return F.concat(part(c["jang"], "장"), part(c["jeol"], "절"), part(F.col("jo"), "조"), ui, part(c["hang"], "항"), ho, mok, F.coalesce(c["semok"], F.lit("")))


def cut_chunks(scratch: Scratch, chunks: DataFrame, name: str = "chunks") -> DataFrame:
    """Chunks written once, all but their numbers in words: these follow from the levels, and only who asks for them has them made."""
    return scratch.cut(chunks.drop("article_number"), name).withColumn("article_number", article_number()).select(*chunks.columns)


def conditions(lines: DataFrame) -> DataFrame:
    """Contract conditions as rows like those of ``provisions`` (without articles), from ``lines(file, ord, prefix, kind, line)``.

    Chapters and sections are lines of their own (a section inside a chapter, or in a table); in paragraphs of text, clauses
    begin with ``1.`` and items with ``가.``; other lines go on. Items hold numbered sub-items ``1)``, these details ``가)``.
    """
    upto = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    num = lambda p: F.nullif(F.regexp_extract("line", p, 1), F.lit(""))
    plain = F.col("kind") == "p"
    own = lines.withColumn("ch", F.col("line").rlike(CHAPTER))
    own = own.withColumn("jang", F.last(F.when(F.col("ch"), num(CHAPTER)), True).over(upto))
    own = own.withColumn("sec", ~F.col("ch") & F.col("line").rlike(PART) & (~plain | F.col("jang").isNotNull()))
    # one window for all: what holds until a larger part begins is the last mark of either, so a file's lines are sorted once
    since = lambda ends, sets, p: F.last(F.when(ends, F.struct(F.lit(None).cast("string").alias("n"))).when(sets, F.struct(num(p).alias("n"))), True).over(upto)["n"]
    own = own.withColumn("jeol", since(F.col("ch"), F.col("sec"), PART))
    text_line = plain & ~F.col("ch") & ~F.col("sec")
    numbered = text_line & F.col("line").rlike(CLAUSE_LINE)
    own = own.withColumn("cl", numbered & F.col("jeol").isNotNull())
    own = own.withColumn("hang", since(F.col("ch") | F.col("sec"), F.col("cl"), CLAUSE_LINE))
    own = own.withColumn("it", text_line & ~F.col("line").rlike(CLAUSE_LINE) & F.col("line").rlike(ITEM_LINE) & F.col("hang").isNotNull())
    own = own.withColumn("block", F.sum((F.col("ch") | F.col("sec") | F.col("cl") | F.col("it")).cast("int")).over(upto))
    rows = F.array_sort(F.collect_list(F.struct("ord", "line", "cl", "it", "prefix", "jang", "jeol", "hang")))
    blocks = own.groupBy("file", "block").agg(rows.alias("r")).withColumn("first", F.get("r", F.lit(0))).where("first.cl or first.it")
    whole = without_comments(F.array_join(F.transform("r", lambda x: x["line"]), " "))
    block = blocks.select("first.*", whole.alias("text")).withColumn("letter", F.when(F.col("it"), num(ITEM_LINE)))

    def sub(m: Column) -> Column:
        own = lambda first: _row(F.concat(m["mark"], F.lit(") "), first), F.col("hang"), F.col("letter"), m["mark"])
        below = lambda details: F.transform(details, lambda d: _row(F.concat(d["mark"], F.lit(") "), d["body"]), F.col("hang"), F.col("letter"), m["mark"], d["mark"]))
        return cut(m["body"], LETTERED_DETAIL, lambda first, details: F.concat(F.array(own(first)), below(details)))

    item = cut(F.col("text"), NUMBERED_SUB, lambda head, subs: F.concat(F.array(_row(head, F.col("hang"), F.col("letter"))), F.flatten(F.transform(subs, sub))))
    each = F.when(F.col("it"), item).otherwise(F.array(_row(F.col("text"), F.col("hang"))))
    none = F.lit(None).cast("string")
    out = block.select("prefix", F.col("jang"), F.col("jeol"), none.alias("jo"), none.alias("jo_ui"), none.alias("title"), F.posexplode(each).alias("k", "x"))
    return _named(out.select("prefix", "jang", "jeol", "jo", "jo_ui", "title", "k", "x.*"))


def tagged(chunks: DataFrame, is_source: Column, cited: list[str], upper: list[str]) -> DataFrame:
    """``is_ref_article`` and ``is_upper_law``: whether the number holds one of the cited numbers (in a source document only), one of the upper ones."""
    among = lambda names: F.exists(F.array(*map(F.lit, names)).cast("array<string>"), lambda x: F.col("article_number").contains(x))
    return chunks.withColumn("is_ref_article", is_source & among(cited)).withColumn("is_upper_law", among(upper))


def _key(*parts: Column | str) -> Column:
    """A place as one text, its law last; the levels above it hold no separator."""
    *levels, law = parts
    return F.concat_ws("\u0001", *(F.coalesce(x, F.lit("-")) for x in levels), law)


def registry(chunks: DataFrame) -> DataFrame:
    """``at_hash, at, above, is_item, hit``: the chunk of each place; an item's branch doesn't count, of equal places the last in order wins.

    ``at`` is the place, ``above`` its paragraph (or article). Rows are dealt and sorted by a hash first, and by ``at`` where
    hashes are equal; ``resolved`` joins them as they are dealt. Conditions have no articles: their section takes the article's place.
    """
    ho = F.when(F.col("ho").rlike(r"^\d"), F.regexp_extract("ho", r"^\d+", 0)).otherwise(F.col("ho"))
    own = chunks.select("prefix", F.coalesce("jo", F.col("jeol").cast("string")).alias("jo"), "jo_ui", "hang", ho.alias("ho"), "mok", "semok", "k", "chunk_id").where("jo is not null and prefix is not null")
    own = own.select(_key("jo", "jo_ui", "hang", "ho", "mok", "semok", "prefix").alias("at"), "k", "chunk_id")
    own = own.withColumn("at_hash", F.xxhash64("at")).repartition("at_hash")
    found = own.groupBy("at_hash", "at").agg(F.max_by("chunk_id", F.struct("k", "chunk_id")).alias("hit"))
    # what follows from a place isn't dealt with it
    level = lambda k: F.split_part("at", F.lit("\u0001"), F.lit(k))
    law = F.col("at").substr(F.length(F.substring_index("at", "\u0001", 6)) + 2, F.length("at"))
    above = F.concat_ws("\u0001", F.substring_index("at", "\u0001", 3), law)
    return found.select("at_hash", "at", above.alias("above"), ((level(4) != "-") & (level(5) == "-")).alias("is_item"), "hit")


_PLACE = ("jo", "ui", "hang", "ho", "mok", "semok")
_OWN = ("prefix", "jo", "jo_ui", "jeol", "hang", "ho")
#: Texts that a task remembers what they say, and what stands for the own law there.
MEMO, _LAW = 1 << 14, "\u0001"
_FOUND = "chunk_id string, own string, k int, title string, prefix string, jo string, ui string, hang string, ho string, mok string, semok string, each boolean"


def _mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``chunk_id, text, relatives`` and the chunk's own place: a row for each mention.

    What a text says at the same place of another law it says here, but for the law; so repeated provisions are read once.
    """

    @lru_cache(maxsize=MEMO)
    def read(text: str, relatives: tuple, *place: str | None) -> list[tuple]:
        return [tuple(m) for m in mentions(text, dict(zip(_OWN, (_LAW, *place), strict=True)), dict(relatives))]

    def of(text: str | None, relatives: list | None, law: str | None, *place: str | None) -> dict[tuple, None]:
        found = read(text or "", tuple(relatives or ()), *place)
        return dict.fromkeys((m[0], law, *m[2:]) if m[1] == _LAW else m for m in found)  # a relative may be the law itself

    for b in batches:
        rows = []
        for chunk, text, relatives, *place in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows += [(chunk, place[0], k, *m) for k, m in enumerate(of(text, relatives, *place))]
        if rows:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.int32(), *[pa.string()] * 8, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["chunk_id", "own", "k", "title", "prefix", *_PLACE, "each"])


def _names_places() -> Column:
    """Whether a text may name a place: the article that it begins with is its own and counts for nothing, unless all items of it are meant."""
    own = F.concat(F.lit("제"), "jo", F.lit("조"), F.coalesce(F.concat(F.lit("의"), "jo_ui"), F.lit("")))
    behind = F.col("text").substr(F.length(own) + 1, F.length("text"))
    heading = F.col("text").startswith(own) & ~behind.rlike(rf"(?U)^의?\d|^\W*각|제\d+[{UNITS}]")
    return F.col("text").rlike(rf"제\d+[{UNITS}]|[{OPENING}]") & ~F.coalesce(heading, F.lit(False))


def found_places(chunks: DataFrame, names: DataFrame, relatives: DataFrame, scratch: Scratch) -> DataFrame:
    """``chunk_id, own, k, prefix, jo, ui, hang, ho, mok, semok, each``: the places that chunks (of the law ``own``) refer to, in the order of the rules.

    ``names(name, prefix)``: a quoted title means the law with the longest name in it, and is left out if there is none.
    ``relatives(prefix, kind, target)``: what ``영``, ``규칙`` and ``법`` mean in a law.
    """
    near = relatives.groupBy(F.col("prefix").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct("kind", "target"))).alias("near"))
    read = chunks.where(_names_places()).withColumn("jeol", F.col("jeol").cast("string"))
    met = read.join(near, F.col("prefix") == F.col("of"), "left").select("chunk_id", "text", "near", *_OWN)
    each = scratch.cut(met.mapInArrow(_mentioned, _FOUND), "mentions")  # texts are read once
    titles = longest_names(each.where("title is not null"), "title", names, "name").select(F.col("text").alias("title"), "name")
    laws = titles.join(names.groupBy("name").agg(F.min("prefix").alias("law")), "name").select("title", "law")
    named = each.join(laws, "title", "left").withColumn("prefix", F.coalesce("prefix", "law")).where("prefix is not null")
    return named.select("chunk_id", "own", "k", "prefix", *_PLACE, "each")


def none(spark: SparkSession, *names: str) -> DataFrame:
    """No rows of texts; one made of a list would be read by Python workers."""
    return spark.range(0).select(*(F.lit(None).cast("string").alias(x) for x in names))


def references(chunks: DataFrame, names: DataFrame | dict[str, str] | None = None, relatives: DataFrame | dict[str, dict[str, str]] | None = None) -> DataFrame:
    """``chunk_id, k, ref_id, is_resolved`` for all chunks: places looked up in the registry, ``각 호`` spelled out, each target once at its first place.

    A place that no chunk has keeps an id built without chapter and section. ``다음 각 호`` and ``다음 각 항`` append the chunk's own children.
    Chunks and the places are written once, so a text is parsed and read once.
    """
    spark = chunks.sparkSession
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame(list(names.items()), "name string, prefix string") if names else none(spark, "name", "prefix")
    if not isinstance(relatives, DataFrame):
        rows = [(p, k, t) for p, own in (relatives or {}).items() for k, t in own.items()]
        relatives = spark.createDataFrame(rows, "prefix string, kind string, target string") if rows else none(spark, "prefix", "kind", "target")
    scratch = Scratch(spark, "references")
    chunks = cut_chunks(scratch, chunks)
    places = scratch.cut(found_places(chunks, names, relatives, scratch), "places")
    return resolved(chunks, registry(chunks), places)


def resolved(chunks: DataFrame, reg: DataFrame, places: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """``chunk_id, k, ref_id, is_resolved`` from the places that chunks refer to and the registry; see ``references``.

    Children are looked for ``among`` these chunks, by default the same. The registry is joined by the hash that it is dealt by
    (places are compared behind it, by no equality that the join would take for a key and deal all again), and read for items
    only if some place means every one.
    """
    asked = places.where("not each").withColumn("at", _key(*_PLACE, "prefix")).withColumn("asked_hash", F.xxhash64("at"))
    place, there = F.col("at"), F.col("there")
    same = (F.col("asked_hash") == F.col("at_hash")) & place.startswith(there) & there.startswith(place)
    single = asked.join(reg.select("at_hash", F.col("at").alias("there"), "hit").hint("merge"), same, "left")  # never sent whole: its estimate is far below its size
    built = slots(F.col("prefix"), F.lit("0"), F.lit("0"), _slot(F.col("jo"), F.col("ui")), *(_slot(F.col(c)) for c in ("hang", "ho", "mok", "semok")))
    single = single.select("chunk_id", "k", F.lit("").alias("tie"), F.coalesce("hit", built).alias("ref_id"), F.col("hit").isNotNull().alias("is_resolved"))
    every_item = places.where("each").withColumn("above", _key("jo", "ui", "hang", "prefix"))
    if not every_item.isEmpty():
        items = reg.where("is_item").select("above", "hit")
        spread = every_item.join(items, "above").select("chunk_id", "k", F.col("hit").alias("tie"), F.col("hit").alias("ref_id"), F.lit(True).alias("is_resolved"))
        single = single.unionByName(spread)
    asks = chunks.where(F.col("text").contains("다음") & F.col("text").rlike(r"(?U)다음\s*각\s*(?:호|항)")).select("chunk_id")
    children = (chunks if among is None else among).where("parent_id is not null").select(F.col("parent_id").alias("chunk_id"), F.lit(1 << 30).alias("k"), F.col("chunk_id").alias("tie"), F.col("chunk_id").alias("ref_id"), F.lit(True).alias("is_resolved"))
    every = single.unionByName(asks.join(children, "chunk_id")).repartition("chunk_id")  # dealt once for both steps
    first = every.groupBy("chunk_id", "ref_id").agg(F.min(F.struct("k", "tie", "is_resolved")).alias("x"))
    nth = F.row_number().over(Window.partitionBy("chunk_id").orderBy("x.k", "x.tie", "ref_id")) - 1
    return first.select("chunk_id", nth.alias("k"), "ref_id", "x.is_resolved")
