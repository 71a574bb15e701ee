"""Tables in documents: header zones, groups of lines, checked items, deliverable plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import lookup
from .ordered import gap_groups

# Header cells of a checklist, their keys, and those that must be there within the first rows.
HEADERS = {"item": ("항목", "항목명"), "category": ("구분",), "적용": ("적용",), "부분적용": ("부분적용",), "미적용": ("미적용",), "해당없음": ("해당없음",)}
REASON = ("사유", "대체기술")
REQUIRED = ("item", "적용", "부분적용", "미적용", "해당없음", "사유")
HEADER_ROWS, LINE_GAP = 3, 6.0
DASH, CIRCLE = r"(?U)^\s*[-–]", r"(?U)^\s*[oㅇ○]\s"
DATE = r"(?U)\d{4}\s*\.\s*\d{1,2}\s*\.\s*\d{1,2}"
COPIES = r"(?U)^\d+식$|^\d*부$|^각\s*\d+부$"
FORMS = ("PDF", "책자", "Git", "Figma", "CD")


def header_key(text: Column) -> Column:
    """The key that a header cell stands for; null for other cells."""
    form = T.loose_form(F.coalesce(text, F.lit("")))
    out = F.lit(None).cast("string")
    out = F.when(form.contains(REASON[0]) & form.contains(REASON[1]), "사유").otherwise(out)
    for key, names in reversed(HEADERS.items()):
        out = F.when(form.isin(*names), key).otherwise(out)
    return out


def header_zones(cells: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """``table_id, key, x0, x1, header_rows`` of tables whose required headers all stand in the first ``HEADER_ROWS`` rows.

    ``cells(table_id, row, col, x0, x1, text)``. A key's first cell in reading order counts; the header ends with the row in
    which the last required key is found, and keys found after it don't count.
    """
    named = cells.where(F.col("row") < HEADER_ROWS).withColumn("key", header_key(F.col("text"))).where("key is not null")
    # a table is dealt whole before anything is sorted, so a task sorts its share of the shuffle and not its share of the input
    first = named.repartition("table_id").groupBy("table_id", "key").agg(F.min(F.struct("row", "col", "x0", "x1")).alias("c"))
    need = F.col("key").isin(*required)
    ends = first.groupBy("table_id").agg(F.count_if(need).alias("n"), F.max(F.when(need, F.col("c.row"))).alias("end")).where(F.col("n") == len(required))
    return first.join(ends.select("table_id", "end"), "table_id").where(F.col("c.row") <= F.col("end")).select("table_id", "key", "c.x0", "c.x1", (F.col("end") + 1).alias("header_rows"))


def logical_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, grp, top, bottom, text, is_intro``: lines joined to the one above unless they begin with a mark or stand further off.

    An intro begins with a circle and is followed by a group that begins with a dash.
    """
    opens = F.col("text").rlike(DASH) | F.col("text").rlike(CIRCLE)
    own = gap_groups(lines, keys, [F.col("top")], F.col("top"), F.col("bottom"), LINE_GAP, opens)
    rows = F.array_sort(F.collect_list(F.struct("top", "text")))
    groups = own.groupBy(*keys, "grp").agg(F.min("top").alias("top"), F.max_by("bottom", "top").alias("bottom"), F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"))
    following = F.lead("text").over(Window.partitionBy(*keys).orderBy("grp"))
    return groups.withColumn("is_intro", F.col("text").rlike(CIRCLE) & F.coalesce(following.rlike(DASH), F.lit(False)))


def check_totals(items: DataFrame, key: str) -> DataFrame:
    """Items and items with an error of each document."""
    return items.groupBy(key).agg(F.count("*").alias("total"), F.count("error").alias("error_count"))


def deliverable_plan(rows: DataFrame, kinds: list[tuple[str, list[str]]]) -> DataFrame:
    """``doc_id, k, raw_name, due_date, copies, doc_form, matched_type`` from ``rows(doc_id, row, cells)``.

    A row with a date begins a deliverable: its name is its first cell that is neither date, number of copies nor form. A row
    without one adds its first filled cell to the name before it; rows ahead of the first date are dropped.
    """
    filled = F.filter(F.transform("cells", lambda c: T.strip(F.coalesce(c, F.lit("")))), lambda c: c != "")
    own = rows.select("doc_id", "row", filled.alias("c")).where(F.size("c") > 0)
    date = F.regexp_extract(F.array_join("c", " "), DATE, 0)
    is_form = lambda c: F.exists(F.array(*map(F.lit, FORMS)), lambda f: c.contains(f))
    plain = F.filter("c", lambda c: ~c.rlike(DATE))
    copies, forms = F.filter(plain, lambda c: c.rlike(COPIES)), F.filter(plain, lambda c: ~c.rlike(COPIES) & is_form(c))
    names = F.filter(plain, lambda c: ~c.rlike(COPIES) & ~is_form(c))
    own = own.withColumn("date", F.nullif(date, F.lit("")))
    part = F.when(F.col("date").isNotNull(), F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise(F.get("c", F.lit(0)))
    own = own.select("doc_id", "row", "date", part.alias("part"), F.try_element_at(copies, F.lit(-1)).alias("copies"), F.try_element_at(forms, F.lit(-1)).alias("form"))
    upto = Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("k", F.count("date").over(upto)).where("k > 0")
    parts = F.array_sort(F.collect_list(F.struct("row", "part")))
    first = lambda c: F.min_by(c, "row")
    out = own.groupBy("doc_id", "k").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("raw_name"), first("date").alias("date"), first("copies").alias("copies"), first("form").alias("doc_form"))
    name = T.strip(F.col("raw_name"))
    return out.select("doc_id", "k", name.alias("raw_name"), T.dotted_date(F.col("date")).alias("due_date"), "copies", "doc_form", lookup.first_alias(T.squeeze(name), kinds).alias("matched_type"))
