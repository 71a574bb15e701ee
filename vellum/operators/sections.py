"""Documents to sections, requirements, metadata and clauses.

Specs are small tables ``(code, ord, label, keywords)``; how they are joined
is left to the planner. Sections are long tables
``(doc_id, code, ord, label, content, found)``.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .lookup import with_each
from .ordered import keep_first, monotone_fold

# Headings, requirement ids and metadata labels as the documents write them.
ROMAN = r"^[ \t]*[ⅠⅡⅢⅣⅤⅥⅦ][ \t]*\.[ \t]*([^\n]*)"
NUMBERED = r"^[ \t]*[1-9][ \t]*\.[ \t]*([^\n]*)"
CIRCLED = r"[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮][ \t]*([^\n]*)"
BOXED = r"^[ \t]*□[ \t]*([^\n(]*?)[ \t]*\((?:SER|SFR|PER|UIR|DAR|TSR|SCR|QAR|CTR|PMR|PSR)\)"
REQUIREMENT = r"(?i)(SFR|SER|PER|UIR|DAR|TSR|SCR|QAR|CTR|PMR|PSR)-(\d{2,3})"
META = {
    "project_name": [r"사\s*업\s*명\s*[:：]\s*([^\n]+)"],
    "client": [r"발\s*주\s*기\s*관\s*[:：]\s*([^\n]+)", r"수\s*요\s*기\s*관\s*[:：]\s*([^\n]+)"],
    "budget": [r"사업\s*예산\s*[:：]?\s*금?\s*([\d,]+)\s*원", r"예산\s*[:：]?\s*금?\s*([\d,]+)\s*원"],
    "duration": [r"사업\s*기간\s*[:：]\s*([^\n]+)", r"계약\s*기간\s*[:：]\s*([^\n]+)"],
    "contract_method": [r"계약\s*방법\s*[:：]\s*([^\n]+)"],
}
CLAUSE = r"제(\d+)조(?:의(\d+))?(?:\s*\([^)]*\))?"
CUT_MARK = " [이하 생략]"
CONTENTS = "목차"


def spec_table(spark: SparkSession, rows: list[tuple[str, str, list[str]]]) -> DataFrame:
    """A spec from (code, label, keywords) in order."""
    return spark.createDataFrame([(c, k, lab, kw) for k, (c, lab, kw) in enumerate(rows)], "code string, ord int, label string, keywords array<string>")


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, i, line, pos``: lines with the 1-based place of their first character, computed inside each document's row."""
    return docs.select("doc_id", F.posexplode(T.line_starts(F.col(text))).alias("i", "x")).select("doc_id", "i", "x.line", "x.pos")


def heading_candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, kind, title`` of what looks like a heading: at a line's start, or circled anywhere."""
    own = lines(docs)
    hit = lambda p: F.nullif(F.regexp_extract("line", p, 0), F.lit(""))

    def found(kind: str, pattern: str, pos: Column) -> Column:
        return F.when(hit(pattern).isNotNull(), F.struct(F.lit(kind).alias("kind"), F.trim(F.regexp_extract("line", pattern, 1)).alias("title"), pos.cast("int").alias("pos")))

    circled_at = F.col("pos") + F.instr(F.col("line"), F.substring(hit(CIRCLED), 1, 1)) - 1
    each = F.array_compact(F.array(found("roman", ROMAN, F.col("pos")), found("num", NUMBERED, F.col("pos")), found("circled", CIRCLED, circled_at), found("boxed", BOXED, F.col("pos"))))
    return own.select("doc_id", F.explode(each).alias("h")).select("doc_id", "h.pos", "h.kind", "h.title")


def anchored_sections(docs: DataFrame, spec: DataFrame, cap: int = 2000, long_cap: int = 5000, long_prefix: str = "RFP-04-04") -> DataFrame:
    """Sections from the last heading of each code to the next anchor; codes without one are there with ``found`` false.

    A heading counts for a code if its title holds one of the code's keywords; chapter headings (Roman) don't. Of codes
    anchored at one place all but the last in the spec get an empty content. A document's text is read once, when all its
    anchors (at most one a code) are known.
    """
    heads = heading_candidates(docs).where("kind <> 'roman'").select("doc_id", "pos", "title")
    # the spec goes with each heading: in a join without keys Spark may send the headings instead
    named = with_each(heads, spec, "code", "ord", "keywords").where(F.exists("keywords", lambda k: F.col("title").contains(k)))
    last = named.groupBy("doc_id", "code", "ord").agg(F.max("pos").alias("pos"))
    anchors = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ord", "code"))).alias("anchors"))
    met = docs.select("doc_id", "text").join(anchors, "doc_id")
    cut = T.lead_slices(F.col("text"), F.transform("anchors", lambda a: a["pos"]))
    each = met.select("doc_id", F.inline(F.zip_with("anchors", cut, lambda a, c: F.struct(a["code"].alias("code"), c["content"].alias("content")))))
    body = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    limit = F.when(F.col("code").startswith(long_prefix), long_cap).otherwise(cap)
    content = F.when(F.length(body) > limit, F.concat(F.substring(body, F.lit(1), limit), F.lit(CUT_MARK))).otherwise(body)
    got = each.select("doc_id", "code", content.alias("content"))
    every = with_each(docs.select("doc_id"), spec, "code", "ord", "label")
    out = every.join(got, ["doc_id", "code"], "left")
    return out.select("doc_id", "code", "ord", "label", F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNotNull().alias("found"))


def requirements(sections: DataFrame) -> DataFrame:
    """``doc_id, code, id, type, name, definition, output``: blocks from each requirement id to the next (the last 600 characters long at most), the first of each id."""
    blocks = sections.select("doc_id", "code", F.posexplode(F.split("content", f"(?={REQUIREMENT})")).alias("k", "block"), F.size(F.split("content", f"(?={REQUIREMENT})")).alias("n"))
    own = blocks.where(F.col("block").rlike(f"^{REQUIREMENT}")).withColumn("id", F.upper(F.regexp_extract("block", f"^{REQUIREMENT}", 0)))
    own = own.withColumn("block", F.when(F.col("k") == F.col("n") - 1, F.substring(F.col("block"), F.lit(1), F.length("id") + 600)).otherwise(F.col("block")))
    own = keep_first(own, ["doc_id", "code", "id"], [F.col("k")])
    get = lambda p: F.trim(F.regexp_extract("block", p, 1))
    output = F.trim(F.element_at(F.split(get(r"산출정보\s*([^\n]+)"), r"요구사항\s*분류"), 1))
    return own.select("doc_id", "code", "k", "id", F.substring("id", 1, 3).alias("type"), F.substring(get(r"요구사항\s*명칭\s*([^\n]+)"), 1, 100).alias("name"), get(r"\[정의\]\s*([^\n]+)").alias("definition"), output.alias("output"))


def metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id`` and the values of ``META``; the budget as written, and as a number where it is one."""
    cols = [T.first_match(F.col(text), p).alias(k) for k, p in META.items()]
    return docs.select("doc_id", *cols).withColumn("budget_value", T.money(F.col("budget")))


def clauses(docs: DataFrame, text: str = "text", tolerance: int = 1) -> DataFrame:
    """``doc_id, k, clause_number, clause_text``: clauses by headings that continue the numbering; else paragraphs.

    Numbers that don't continue it are citations and stay in the text around them.
    """
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    own = docs.select("doc_id", trimmed.alias("text")).withColumn("parts", F.filter(F.split("text", f"(?={CLAUSE})"), lambda x: x.rlike(f"^{CLAUSE}")))
    numbers = F.transform("parts", lambda x: F.regexp_extract(x, f"^{CLAUSE}", 1).try_cast("bigint"))
    own = own.withColumn("taken", monotone_fold(F.transform(numbers, lambda n: F.coalesce(n, F.lit(-1))), tolerance))
    part = own.select("doc_id", "taken", F.posexplode("parts").alias("i", "part"))
    part = part.withColumn("k", F.size(F.filter("taken", lambda t: t <= F.col("i")))).where("k > 0")
    whole = part.groupBy("doc_id", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("t"))
    head = F.trim(F.regexp_extract("t", f"^{CLAUSE}", 0))
    body = F.regexp_replace(F.substring(F.col("t"), F.length(head) + 1, F.length("t")), r"(?U)^\s+|\s+$", "")
    ui = F.regexp_extract("t", f"^{CLAUSE}", 2)
    number = F.concat(F.lit("제"), F.regexp_extract("t", f"^{CLAUSE}", 1), F.lit("조"), F.when(ui != "", F.concat(F.lit("의"), ui)).otherwise(""))
    found = whole.select("doc_id", "k", number.alias("clause_number"), F.concat_ws(" ", head, body).alias("clause_text"), body.alias("body")).where("body <> ''").drop("body")
    rest = own.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", r"\n\s*\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("k", "clause_text"))
    return found.unionByName(rest.select("doc_id", (F.col("k") + 1).alias("k"), F.concat(F.lit("단락"), F.col("k") + 1).alias("clause_number"), "clause_text"))


#: Trailing lines that are looked at, and the longest title of a numbered and of a lettered heading.
ORPHANS, NUMBERED_TITLE, LETTERED_TITLE = 3, 31, 20


def is_heading_alone(line: str) -> bool:
    """A number of one or two digits, or one Hangul syllable, with a full stop and a short title or none."""
    mark, stop, title = line.strip().partition(".")
    title = title.strip()
    if not stop:
        return False
    if mark.isdecimal() and len(mark) <= 2:
        return len(title) <= NUMBERED_TITLE
    return len(mark) == 1 and "가" <= mark <= "힣" and len(title) <= LETTERED_TITLE and not any(map(str.isspace, title))


def _cursor_search(flat: str, start: int, spec: list) -> dict[str, tuple[int, int]]:
    """Begin and end of each code's earliest keyword after the match before."""
    at, out = start, {}
    for code, _, keywords in spec:
        hits = [(p, len(k)) for k in keywords if k and (p := flat.find(k, at)) >= 0]
        if hits:
            p, n = min(hits, key=lambda x: x[0])
            out[code], at = (p, p + n), p + n
    return out


def keyword_slices(text: str, spec: list, cap: int = 8000, near: int = 500, front: float = 0.15, share: float = 0.5) -> list[dict]:
    """Sections of one text by an ordered search for keywords without white space.

    Begins after a table of contents: after the last code's keyword within ``near`` characters of its heading, and again
    after the last match if at least ``share`` of the matches lie in the first ``front`` of the text.
    """
    place = [k for k, ch in enumerate(text) if not ch.isspace()]
    flat = "".join(text[k] for k in place)
    squeezed = [(c, lab, ["".join(k.split()) for k in kws]) for c, lab, kws in spec]
    start = 0
    if spec and (toc := flat.find(CONTENTS)) >= 0:
        listing = flat[toc : toc + near]
        start = max((toc + p + len(k) for k in squeezed[-1][2] if k and (p := listing.find(k)) >= 0), default=0)
    hits = _cursor_search(flat, start, squeezed)
    early = [p for p, _ in hits.values() if p <= len(flat) * front]
    if hits and len(early) >= len(hits) * share:
        hits = _cursor_search(flat, max(early), squeezed) or hits
    origin = lambda p: place[p] if p < len(place) else len(text)
    ordered = sorted(hits.items(), key=lambda x: x[1])
    out = []
    for n, (code, (_, end)) in enumerate(ordered):
        stop = origin(ordered[n + 1][1][0]) if n + 1 < len(ordered) else len(text)
        rows = text[origin(end) : stop].strip().split("\n")
        for _ in range(ORPHANS):
            if rows and is_heading_alone(rows[-1]):
                rows.pop()
        content = "\n".join(rows).strip()
        out.append({"code": code, "content": content[:cap] + CUT_MARK if len(content) > cap else content})
    return out


def keyword_sections(docs: DataFrame, spec: DataFrame, rows: list[tuple[str, str, list[str]]], cap: int = 8000) -> DataFrame:
    """The same for a table of documents, with every code of the spec."""

    @F.pandas_udf("array<struct<code: string, content: string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: keyword_slices(t or "", rows, cap))

    got = docs.select("doc_id", F.explode(cut("text")).alias("s")).select("doc_id", "s.code", "s.content")
    every = with_each(docs.select("doc_id"), spec, "code", "ord", "label")
    out = every.join(got, ["doc_id", "code"], "left")
    return out.select("doc_id", "code", "ord", "label", F.coalesce("content", F.lit("")).alias("content"), F.col("content").isNotNull().alias("found"))
