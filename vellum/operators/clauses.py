"""Contract clauses: three ways to cut them, and where they stand on the pages.

Texts are cut by expressions on their row. Places on pages are found with windows over a document's lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ordered import monotone_fold
from .provisions import PARAGRAPHS, cut

# Headings of clauses, with and without a title, and of their parts.
HEADING = r"(?U)(제\d+조(?:의\d+)?(?:\s*\([^)]*\))?)"
TITLED = r"(?U)(?<!법\s{0,4})(제\d+조(?:의\d+)?\s*\([^)]*\))"
NUMBER = r"제\d+조(?:의\d+)?"
ITEM_MARK = r"(?U)(?:^|\s)(\d{1,2}\.)\s"
UNIT = r"제\d+조(?:의\d+)?|제\d+항|제\d+호"
#: A heading's number may run ahead of the last accepted one by so many; a document needs so many headings to have places.
AHEAD, LEAST = 5, 3


def _paragraph_rows(s: Column) -> Column:
    """Blocks parted by blank lines, numbered."""
    blocks = F.filter(F.transform(F.split(s, r"(?U)\n\s*\n"), T.strip), lambda x: x != "")
    return F.transform(blocks, lambda x, i: F.struct(F.concat(F.lit("단락"), (i + 1).cast("string")).alias("clause_number"), x.alias("clause_text")))


def _or_paragraphs(found: Column, s: Column) -> Column:
    return T.once(found, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(_paragraph_rows(s)))


def naive_clauses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, k, clause_number, clause_text``: a clause at every heading, whatever its number; paragraphs where there is none."""
    own = T.strip(F.col(text))
    row = lambda p: F.struct(F.regexp_extract(p["mark"], NUMBER, 0).alias("clause_number"), F.concat(p["mark"], F.lit(" "), p["body"]).alias("clause_text"))
    rows = cut(own, HEADING, lambda _, parts: F.transform(F.filter(parts, lambda p: p["body"] != ""), row))
    return docs.select("doc_id", F.posexplode(_or_paragraphs(rows, own)).alias("k", "x")).select("doc_id", (F.col("k") + 1).alias("k"), "x.*")


def _squeezed(s: Column) -> Column:
    return T.strip(F.regexp_replace(s, r"(?U)\s+", " "))


def _with_items(number: Column, unit: Column) -> Column:
    """A unit's head and its items ``1.``, ``2.`` and so on; a number out of turn stays in the text before it."""
    row = lambda n, t: F.struct(n.alias("clause_number"), t.alias("clause_text"))
    kind = "struct<last: int, out: array<struct<clause_number: string, clause_text: string>>>"
    start = lambda head: F.struct(F.lit(0).alias("last"), F.when(head != "", F.array(row(number, head))).otherwise(F.array()).alias("out")).cast(kind)

    def step(a: Column, p: Column) -> Column:
        n, text = F.regexp_extract(p["mark"], r"\d+", 0).cast("int"), _squeezed(F.concat(p["mark"], F.lit(" "), p["body"]))
        many, last = F.size(a["out"]), F.element_at(a["out"], -1)
        grown = F.concat(F.slice(a["out"], 1, F.greatest(many - 1, F.lit(0))), F.array(row(last["clause_number"], F.concat(last["clause_text"], F.lit(" "), p["mark"], F.lit(" "), p["body"]))))
        fresh = F.array_append(a["out"], row(F.concat(number, F.lit("제"), n.cast("string"), F.lit("호")), text))
        other = F.when(many > 0, grown).otherwise(F.array(row(number, F.concat(p["mark"], F.lit(" "), p["body"]))))
        empty, follows = p["body"] == "", n == a["last"] + 1
        return F.struct(F.when(~empty & follows, n).otherwise(a["last"]).alias("last"), F.when(empty, a["out"]).when(follows, fresh).otherwise(other).alias("out")).cast(kind)

    found = cut(unit, ITEM_MARK, lambda head, parts: F.aggregate(parts, start(head), step)["out"])
    return T.once(found, lambda rows: F.when(F.size(rows) > 0, rows).otherwise(F.array(row(number, unit))))


def unit_clauses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, k, clause_number, clause_text``: paragraphs and items of clauses, each with its clause's heading or number.

    Headings have a title, don't follow ``법`` (they cite a law then), and continue the numbering by ``AHEAD`` at most. In a
    clause with paragraphs what stands before the first one is left out. Documents without clauses give paragraphs of text.
    """
    own = T.strip(F.col(text))
    marked = F.split(F.regexp_replace(own, TITLED, "\u0001$1"), "\u0001")
    pieces = docs.select("doc_id", own.alias("own"), F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))).alias("parts"))
    numbers = F.transform("parts", lambda x: F.coalesce(F.regexp_extract(x, r"^제(\d+)", 1).try_cast("bigint"), F.lit(-1)))
    taken = pieces.withColumn("taken", monotone_fold(numbers, AHEAD))
    stop = lambda i: F.coalesce(F.get(F.col("taken"), i + 1), F.size("parts"))
    blocks = F.transform("taken", lambda t, i: T.strip(F.array_join(F.slice("parts", t + 1, stop(i) - t), "")))

    def items(number: Column, unit: Column) -> Column:
        return T.once(F.struct(number.alias("number"), _squeezed(unit).alias("unit")), lambda x: _with_items(x["number"], x["unit"]))

    def titled(block: Column) -> Column:
        return T.once(F.regexp_extract(block, f"^{TITLED}", 1), lambda h: F.struct(h.alias("head"), F.regexp_extract(h, NUMBER, 0).alias("number"), T.strip(F.substring(block, F.length(h) + 1, F.length(block))).alias("body")))

    def one(c: Column) -> Column:
        head, number, body = c["head"], c["number"], c["body"]
        place = lambda p: F.concat(number, F.lit("제"), F.call_function("instr", F.lit(PARAGRAPHS), p["mark"]).cast("string"), F.lit("항"))
        each = lambda paragraphs: F.flatten(F.transform(F.filter(paragraphs, lambda p: p["body"] != ""), lambda p: items(place(p), F.concat(head, F.lit(" "), p["mark"], p["body"]))))
        whole = items(number, F.concat(head, F.lit(" "), body))
        return cut(body, f"([{PARAGRAPHS}])", lambda _, paragraphs: F.when(body == "", F.slice(whole, 1, 0)).when(F.size(paragraphs) > 0, each(paragraphs)).otherwise(whole))

    rows = taken.select("doc_id", "own", F.flatten(F.transform(F.transform(blocks, titled), one)).alias("rows"))
    out = rows.select("doc_id", F.posexplode(_or_paragraphs(F.col("rows"), F.col("own"))).alias("k", "x"))
    return out.select("doc_id", (F.col("k") + 1).alias("k"), "x.*")


def clause_positions(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """``doc_id, key, start_page, start_y, stop_page, stop_y, x``: where clauses, their paragraphs and items begin and end.

    ``lines(doc_id, page, x, y, text)``, ``pages(doc_id, page, height)``. A unit ends where the next one of its kind in the same
    larger unit begins, the last one with that unit, the last clause with the document. Items count in the paragraph, or in
    a clause without paragraphs. Documents with fewer than ``LEAST`` headings have no places; of equal keys the last counts.

    One pass over a document's marks in order: a unit is open until a mark of its kind or a larger one.
    """
    trimmed = T.strip(F.col("text"))
    paragraph, item = F.regexp_extract(trimmed, f"^[{PARAGRAPHS}]", 0), F.regexp_extract(trimmed, r"^(\d{1,2})\.", 1)
    mark = lambda level, key, n=None: F.struct("page", "y", F.lit(level).alias("level"), "x", (F.lit(None).cast("long") if n is None else n).alias("n"), key.alias("key"))
    heads = F.transform(F.regexp_extract_all("text", F.lit(TITLED), 1), lambda h: mark(0, F.regexp_extract(h, NUMBER, 0), F.regexp_extract(h, r"제(\d+)", 1).cast("long")))
    numbered = lambda n, unit: F.concat(F.lit("제"), n.cast("string"), F.lit(unit))
    own = F.when(paragraph != "", mark(1, numbered(F.call_function("instr", F.lit(PARAGRAPHS), paragraph), "항"))).when(item != "", mark(2, numbered(item, "호")))
    marks = lines.select("doc_id", F.inline(F.array_compact(F.concat(heads, F.array(own)))))
    ends = pages.select("doc_id", "page", F.col("height").alias("y"), F.lit(9).alias("level"), *(F.lit(None).cast(t).alias(c) for c, t in (("x", "double"), ("n", "long"), ("key", "string"))))
    # the only exchange: what follows keeps a document's rows together
    last = F.col("level") == 9
    listed = marks.unionByName(ends).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(~last, F.struct("page", "y", "level", "x", "n", "key")))).alias("marks"), F.max(F.when(last, F.struct("page", "y"))).alias("end")
    )
    found = listed.withColumn("heads", F.filter("marks", lambda m: m["level"] == 0)).withColumn("taken", monotone_fold(F.transform("heads", lambda h: h["n"]), AHEAD))
    found = found.where((F.size("taken") >= LEAST) & F.col("end").isNotNull())
    accepted = F.transform("taken", lambda t: F.get(F.col("heads"), t))
    rows = found.select("doc_id", "end", F.posexplode(F.array_sort(F.concat(accepted, F.filter("marks", lambda m: m["level"] > 0)))).alias("k", "m")).select("doc_id", "end", "k", "m.*")
    w, at, level = Window.partitionBy("doc_id").orderBy("k"), F.struct("page", "y"), F.col("level")
    upto, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumns({
        "top": F.last(F.when(level == 0, F.col("key")), ignorenulls=True).over(upto),
        "unit": F.last(F.when(level <= 1, F.struct("level", "key")), ignorenulls=True).over(upto),
        "clause_end": F.first(F.when(level == 0, at), ignorenulls=True).over(after),
        "unit_end": F.first(F.when(level <= 1, F.struct(at.alias("at"), "level")), ignorenulls=True).over(after),
        "next": F.lead(at).over(w),
    })
    # items before the first paragraph of a clause that has some are no units
    in_paragraph, none_follows = F.col("unit.level") == 1, F.coalesce(F.col("unit_end.level") == 0, F.lit(True))
    rows = rows.where(F.col("top").isNotNull() & ((level < 2) | in_paragraph | none_follows))
    stop = F.coalesce(F.when(level == 0, F.col("clause_end")).when(level == 1, F.col("unit_end.at")).otherwise(F.col("next")), "end")
    key = F.when(level == 0, F.col("key")).when((level == 2) & in_paragraph, F.concat("top", "unit.key", "key")).otherwise(F.concat("top", "key"))
    place = F.struct(F.col("page").alias("start_page"), F.col("y").alias("start_y"), stop["page"].alias("stop_page"), stop["y"].alias("stop_y"), "x")
    out = rows.select("doc_id", key.alias("key"), "k", place.alias("v"))
    return out.groupBy("doc_id", "key").agg(F.max_by("v", "k").alias("v")).select("doc_id", "key", "v.*")


def position_fragments(positions: DataFrame, pages: DataFrame, margin: float = 20.0) -> DataFrame:
    """``doc_id, key, page, x, y, width, height`` for each page that a place touches; ``pages(doc_id, page, width, height)``."""
    each = positions.withColumn("page", F.explode(F.when(F.col("stop_page") >= F.col("start_page"), F.sequence("start_page", "stop_page"))))
    met = each.join(pages.select("doc_id", "page", F.col("width").alias("w"), F.col("height").alias("h")), ["doc_id", "page"])
    y0 = F.when(F.col("page") == F.col("start_page"), F.col("start_y")).otherwise(F.lit(0.0))
    y1 = F.when(F.col("page") == F.col("stop_page"), F.least("stop_y", "h")).otherwise(F.col("h"))
    return met.withColumn("y", y0).withColumn("height", y1 - y0).where("height > 0").select("doc_id", "key", "page", "x", "y", (F.col("w") - F.col("x") - margin).alias("width"), "height")


def fallback_keys(number: Column) -> Column:
    """A clause number, its paragraph and its clause, each once."""
    found = F.array(number, *(F.nullif(F.regexp_extract(number, p, 0), F.lit("")) for p in (rf"^{NUMBER}제\d+항", f"^{NUMBER}")))
    return F.array_distinct(F.array_compact(found))


def positions_of(results: DataFrame, positions: DataFrame) -> DataFrame:
    """``results(doc_id, clause_number, ...)`` with ``found_key`` and the place of the clause, else of its paragraph, else of its clause; null where there is none."""
    keys = results.select("doc_id", "clause_number").distinct().select("doc_id", "clause_number", F.posexplode(fallback_keys(F.col("clause_number"))).alias("way", "key"))
    met = keys.join(positions, ["doc_id", "key"])
    best = met.groupBy("doc_id", "clause_number").agg(F.min_by(F.struct(F.col("key").alias("found_key"), *(c for c in positions.columns if c not in ("doc_id", "key"))), "way").alias("v"))
    return results.join(best, ["doc_id", "clause_number"], "left").select(*results.columns, "v.*")


def clause_label(number: Column) -> Column:
    """``제2조제1항`` as ``제 2조 제 1항``; anything else as it is."""
    parts = F.regexp_extract_all(number, F.lit(UNIT), 0)
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda x: F.regexp_replace(x, r"^제(\d+)", "제 $1")), " ")).otherwise(number)
