"""Comparing documents with one another, and parsed sections with their originals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..scratch import Scratch
from . import matching as M
from .lookup import with_each
from .ordered import latest

MIN_CONTENT, IDENTITY = 30, 0.4
# Fixed values of the section review.
EMPTY_BELOW, CONTENT_LEAST, PARAGRAPH_LEAST, PARAGRAPH_CHARS = 5, 0.75, 0.7, 20


def has_content() -> Column:
    return F.col("found") & (F.length(F.trim("content")) >= MIN_CONTENT)


def identity_scores(source: DataFrame, target: DataFrame, anchors: list[str], stop: list[str]) -> DataFrame:
    """``pair_id, identity``: part of the anchor sections' words that the target has anywhere."""
    words = lambda: T.significant_words(F.concat_ws(" ", F.collect_list("content")), stop)
    ids = source.select("pair_id").distinct()
    a = source.where(F.col("code").isin(anchors)).groupBy("pair_id").agg(words().alias("a"))
    b = target.groupBy("pair_id").agg(words().alias("b"))
    none = F.array().cast("array<string>")
    both = ids.join(a, "pair_id", "left").join(b, "pair_id", "left")
    return both.select("pair_id", T.overlap_ratio(F.coalesce("a", none), F.coalesce("b", none)).alias("identity"))


def compare(source: DataFrame, target: DataFrame, mapping: DataFrame, identity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and scores of pairs of documents.

    ``source``, ``target``: ``(pair_id, code, content, found)``; ``mapping``: ``(code, targets, required)``. Only mapped
    source sections that were found count. A pair whose identity is too low gets zero throughout.
    """
    own = source.where("found").select("pair_id", "code").join(F.broadcast(mapping), "code")
    each = own.select("pair_id", "code", "required", F.explode("targets").alias("target"))
    hit = target.select("pair_id", F.col("code").alias("target"), has_content().alias("has"))
    met = each.join(hit, ["pair_id", "target"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    items = met.groupBy("pair_id", "code", "required").agg(
        F.avg(F.col("has").cast("double")).alias("coverage"), F.array_sort(F.collect_list(F.when(~F.col("has"), F.col("target")))).alias("missing")
    )
    items = items.join(identity, "pair_id").withColumn("other", F.col("identity") < IDENTITY)
    items = items.withColumn("coverage", F.when(F.col("other"), 0.0).otherwise(F.col("coverage")))
    verdict = F.when(F.col("coverage") >= 1, "satisfied").when(F.col("coverage") > 0, "partial").otherwise("unsatisfied")
    items = items.select("pair_id", "code", "required", F.bround(F.col("coverage") * 100).cast("int").alias("coverage_pct"), "coverage", "missing", verdict.alias("verdict"), "other")
    w = F.when(F.col("required"), 2).otherwise(1)
    count = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v}")
    scores = items.groupBy("pair_id").agg(F.bround(F.sum(w * F.col("coverage")) / F.sum(w) * 100).cast("int").alias("score"), *map(count, ("satisfied", "partial", "unsatisfied")))
    return items.drop("coverage"), identity.join(scores, "pair_id", "left").na.fill(0)


def review(spec: DataFrame, original: DataFrame, parsed: DataFrame) -> DataFrame:
    """``doc_id, issue, code, related``: what is wrong with parsed sections.

    ``spec(code, ord, title)``; ``original(doc_id, code, pos, content)`` are slices of the source; ``parsed(doc_id, code, ord,
    title, content)``. Comparisons of a section with the others stay within its document, and only those sections reach the
    matcher that can beat the section's own content. Each section and paragraph is scored once, its score written.
    """
    scratch = Scratch(parsed.sparkSession, "review")
    docs = parsed.select("doc_id").unionByName(original.select("doc_id")).distinct()
    # the spec is sent: Spark knows no size of it, and would send the sections or deal them by its few codes
    known = parsed.join(F.broadcast(spec.select("code", F.col("title").alias("spec_title"))), "code")
    issue = lambda df, name, code, related=None: df.select("doc_id", F.lit(name).alias("issue"), code.alias("code"), (related if related is not None else F.lit(None).cast("string")).alias("related"))
    every = with_each(docs, spec, "code")
    missing = issue(every.join(parsed.select("doc_id", "code"), ["doc_id", "code"], "left_anti"), "missing_section", F.col("code"))
    short = F.length(T.compare_form(F.coalesce("content", F.lit("")))) < EMPTY_BELOW
    empty = issue(known.where(short), "empty_section", F.col("code"))
    strange = issue(parsed.join(F.broadcast(spec.select("code")), "code", "left_anti"), "unrecognized_section", F.col("code"))
    a, b = T.compare_form(F.col("title")), T.compare_form(F.col("spec_title"))
    wrong = issue(known.where((F.coalesce(F.trim("title"), F.lit("")) != "") & ~(a.contains(b) | b.contains(a))), "section_title_mismatch", F.col("code"))
    both = parsed.select("doc_id", "code", "ord").join(original.select("doc_id", "code", "pos"), ["doc_id", "code"])
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(c, "code"))), lambda x: x["code"])
    shuffled = both.groupBy("doc_id").agg(order("ord").alias("p"), order("pos").alias("o")).where("p <> o")
    moved = issue(shuffled, "section_order_mismatch", F.lit(None).cast("string"))
    sound = known.where(~short)
    own = original.select("doc_id", "code", F.col("content").alias("source")).join(sound.select("doc_id", "code", "content"), ["doc_id", "code"])
    form = lambda c: T.compare_form(F.col(c))
    own = scratch.cut(own.withColumn("score", S.ratio(form("source"), form("content"))), "scored")
    low = own.where(F.col("score") < CONTENT_LEAST)
    others = known.select("doc_id", F.col("code").alias("other"), F.col("content").alias("other_content"))
    less = F.lit(None).cast("double")
    held = low.select("doc_id", "code", form("source").alias("a"), F.col("score").alias("floor")).withColumn("ha", M.histogram(F.col("a")))
    of = lambda df: others.join(df.select("doc_id"), "doc_id", "left_semi")  # only these documents' sections are compared
    near = of(low).select("doc_id", "other", form("other_content").alias("b")).withColumn("hb", M.histogram(F.col("b")))
    best = M.best_matches(held.join(near, "doc_id").where("code <> other").withColumn("least", less), ["doc_id", "code"], "other", "ratio", scratch=scratch)
    judged = low.select("doc_id", "code").join(best.drop("score"), ["doc_id", "code"], "left")
    misplaced = issue(judged, "x", F.col("code"), F.col("other")).withColumn("issue", F.when(F.col("related").isNotNull(), "content_misplaced").otherwise("section_content_mismatch"))
    fine = own.join(low.select("doc_id", "code"), ["doc_id", "code"], "left_anti")
    part = fine.select("doc_id", "code", "content", F.posexplode(T.paragraphs(F.col("source"))).alias("k", "paragraph")).where(F.length(T.compare_form(F.col("paragraph"))) >= PARAGRAPH_CHARS)
    lost = scratch.cut(part.withColumn("score", S.containment("paragraph", "content")).where(F.col("score") < PARAGRAPH_LEAST), "lost")
    held = lost.select("doc_id", "code", "k", F.col("paragraph").alias("a"), F.col("score").alias("floor")).withColumn("ha", M.histogram(F.col("a")))
    near = of(lost).select("doc_id", "other", F.col("other_content").alias("b")).withColumn("hb", M.histogram(F.col("b")))
    where = M.best_matches(held.join(near, "doc_id").where("code <> other").withColumn("least", F.lit(PARAGRAPH_LEAST)), ["doc_id", "code", "k"], "other", "containment", scratch=scratch)
    shifted = lost.select("doc_id", "code", "k").join(where.drop("score"), ["doc_id", "code", "k"], "left")
    paragraphs = issue(shifted, "x", F.col("code"), F.col("other")).withColumn("issue", F.when(F.col("related").isNotNull(), "paragraph_misplaced").otherwise("paragraph_missing"))
    out = missing
    for more in (empty, strange, wrong, moved, misplaced, paragraphs):
        out = out.unionByName(more)
    return merged(out)


#: Issues of a section's content.
OF_CONTENT = ("section_content_mismatch", "content_misplaced", "paragraph_missing", "paragraph_misplaced")


def merged(issues: DataFrame) -> DataFrame:
    """A section with a wrong title and a wrong content has one issue, ``section_title_content_mismatch``, in place of those."""
    w = Window.partitionBy("doc_id", "code")
    title, content = F.col("issue") == "section_title_mismatch", F.col("issue").isin(*OF_CONTENT)
    own = issues.withColumn("both", F.col("code").isNotNull() & F.max(title).over(w) & F.max(content).over(w)).withColumn("from", F.max(F.when(content, F.col("related"))).over(w))
    kept = own.where(~F.col("both") | ~content)
    both = F.col("both") & title
    return kept.select("doc_id", F.when(both, "section_title_content_mismatch").otherwise(F.col("issue")).alias("issue"), "code", F.when(both, F.col("from")).otherwise(F.col("related")).alias("related"))


def status(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """PASS without issues, else FAIL, with counts."""
    n = issues.groupBy("doc_id").agg(F.count("*").alias("n_issues"))
    return docs.select("doc_id").distinct().join(n, "doc_id", "left").select("doc_id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.when(F.col("n_issues").isNull(), "PASS").otherwise("FAIL").alias("status"))


def keyword_review(sections: DataFrame, rules: DataFrame) -> DataFrame:
    """``doc_id, code, keyword_score, verdict``: keywords of a rule found in its section. ``rules(code, keywords)``."""
    j = sections.join(F.broadcast(rules), "code")
    hit = F.size(F.filter("keywords", lambda k: F.col("content").contains(k)))
    score = F.coalesce(F.try_divide(hit, F.size("keywords")), F.lit(1.0))
    return j.select("doc_id", "code", F.round(score, 4).alias("keyword_score"), F.when(score >= 0.7, "PASS").when(score >= 0.4, "WARN").otherwise("FAIL").alias("verdict"))


def blank_fields(cells: DataFrame, excluded: list[str]) -> DataFrame:
    """Labels whose value cell is blank. ``cells(doc_id, page, tbl, row, values)``: label and value in turn, first two pages."""
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("values") - 2, F.lit(0)), F.lit(2)), lambda i: F.struct(F.get(F.col("values"), i).alias("label"), F.get(F.col("values"), i + 1).alias("value")))
    each = cells.where((F.col("page") < 2) & (F.size("values") > 1)).select("doc_id", "page", "tbl", "row", F.inline(pairs))
    blank = F.trim(F.coalesce("value", F.lit(""))) == ""
    return each.where(blank & (F.trim(F.coalesce("label", F.lit(""))) != "") & ~F.trim("label").isin(excluded)).select("doc_id", "page", "tbl", "row", F.trim("label").alias("label"))


def check_marks(items: DataFrame, needs_reason: list[str]) -> DataFrame:
    """The first rule that a row of marks breaks. ``items(item_id, checked map<string, boolean>, reason)``."""
    n = F.size(F.filter(F.map_values("checked"), lambda v: v))
    lacks = F.exists(F.array(*map(F.lit, needs_reason)), lambda c: F.coalesce(F.try_element_at("checked", c), F.lit(False))) & (F.trim(F.coalesce("reason", F.lit(""))) == "")
    return items.select("item_id", F.when(n == 0, "none_checked").when(n >= 2, "many_checked").when(lacks, "reason_missing").alias("error"))


def continued_rows(rows: DataFrame, key: str, order: str, dated: Column, text: str) -> DataFrame:
    """Rows without a date are joined to the dated row before them; rows ahead of the first are dropped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = rows.withColumn("grp", F.sum(dated.cast("int")).over(w)).where("grp > 0")
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return own.groupBy(key, "grp").agg(F.array_join(F.transform(items, lambda x: x[text]), "").alias(text))


def sync_due_dates(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Existing due dates are never overwritten. ``existing(kind, due)``, ``found(kind, due, ord)``."""
    first = latest(found.where("due is not null"), ["kind"], [F.asc("ord")]).select("kind", F.col("due").alias("new"))
    j = existing.join(first, "kind", "left")
    what = F.when(F.col("due").isNotNull(), "skipped").when(F.col("new").isNotNull(), "updated").otherwise("not_found")
    return j.select("kind", F.coalesce("due", "new").alias("due"), what.alias("result"))


def missing_blocks(originals: DataFrame, parsed: DataFrame, least: float = 0.9, shortest: int = 20) -> DataFrame:
    """``doc_id, k, block``: paragraphs of an original that the parsed text doesn't hold to ``least``. Both are ``(doc_id, text)``.

    Exchanged, they give the blocks that parsing has added.
    """
    each = originals.select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("k", "block")).where(F.length(T.compare_form(F.col("block"))) >= shortest)
    met = each.join(parsed.select("doc_id", F.col("text").alias("whole")), "doc_id", "left")
    a, b = T.compare_form(F.col("block")), T.compare_form(F.coalesce("whole", F.lit("")))
    rest = met.where(~b.contains(a)).select("doc_id", "k", "block", a.alias("a"), b.alias("b"))
    return rest.where(S.containment("a", "b") < least).select("doc_id", "k", "block")


def whole_review(originals: DataFrame, sections: DataFrame, titles: list[str], low: float = 0.98, failing: float = 0.95) -> DataFrame:
    """``doc_id, issue, detail`` of a document as a whole, and its status: see ``whole_status``.

    ``originals(doc_id, text)``, ``sections(doc_id, ord, title, content)``: no sections, a low similarity of the whole, titles
    missing or out of order, empty sections, other titles on a line inside a section, blocks lost or added (looked for where the
    similarity is low), and important tokens whose numbers differ.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws("\n", "title", "content").alias("t")))), lambda x: x["t"]), "\n")
    parsed = sections.groupBy("doc_id").agg(joined.alias("text"))
    both = originals.select("doc_id", F.coalesce("text", F.lit("")).alias("source")).join(parsed, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    scored = both.withColumn("similarity", F.round(S.ratio(T.compare_form(F.col("source")), T.compare_form(F.col("text"))), 4))
    scored = Scratch(originals.sparkSession, "whole").cut(scored, "scored")
    issue = lambda df, name, detail: df.select("doc_id", F.lit(name).alias("issue"), detail.cast("string").alias("detail"))
    none, names = F.lit(None), F.array(*map(F.lit, titles))
    low_rows = scored.where(F.col("similarity") < low)
    out = issue(scored.where("text = ''"), "empty_parsed_sections", none).unionByName(issue(low_rows, "low_overall_similarity", F.col("similarity")))
    named = sections.select("doc_id", "ord", T.title_form(F.col("title")).alias("form"), "content", "title")
    want = originals.select("doc_id", F.posexplode(names).alias("want_ord", "want")).withColumn("form", T.title_form(F.col("want")))
    met = want.join(named.groupBy("doc_id", "form").agg(F.min("ord").alias("ord")), ["doc_id", "form"], "left")
    out = out.unionByName(issue(met.where("ord is null"), "missing_section", F.col("want")))
    order = F.transform(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("want_ord", "ord")))), lambda x: x["ord"])
    seen = met.groupBy("doc_id").agg(order.alias("o")).where(F.col("o") != F.array_sort("o"))
    out = out.unionByName(issue(seen, "section_order_mismatch", none))
    out = out.unionByName(issue(named.where(T.compare_form(F.coalesce("content", F.lit(""))) == ""), "empty_section", F.col("title")))
    lines = F.transform(F.split("content", "\n"), T.title_form)
    want_forms = F.transform(names, lambda n: F.struct(n.alias("name"), T.title_form(n).alias("form")))
    other = T.once(F.struct(lines.alias("lines"), F.col("form")), lambda s: F.transform(F.filter(want_forms, lambda n: (n["form"] != s["form"]) & F.array_contains(s["lines"], n["form"])), lambda n: n["name"]))
    out = out.unionByName(issue(named.select("doc_id", F.explode(other).alias("other")), "overmerged_section", F.col("other")))
    a, b = low_rows.select("doc_id", F.col("source").alias("text")), low_rows.select("doc_id", "text")
    out = out.unionByName(issue(missing_blocks(a, b), "missing_block", F.col("k"))).unionByName(issue(missing_blocks(b, a), "added_block", F.col("k")))
    # the lists must not move into the comparison, which names them for each of their items
    tokens = F.struct(T.important_tokens(F.col("source")).alias("x"), T.important_tokens(F.col("text")).alias("y"))
    changed = T.once(tokens, lambda t: F.array_sort(t["x"]) != F.array_sort(t["y"]))
    return out.unionByName(issue(scored.where(changed), "important_tokens_changed", none))


def whole_status(issues: DataFrame, docs: DataFrame) -> DataFrame:
    """FAIL where nothing was parsed or the whole differs (any low similarity counts), else PASS."""
    bad = issues.where(F.col("issue").isin("empty_parsed_sections", "low_overall_similarity")).select("doc_id").distinct().withColumn("bad", F.lit(True))
    return docs.select("doc_id").join(bad, "doc_id", "left").select("doc_id", F.when(F.col("bad"), "FAIL").otherwise("PASS").alias("status"))


def keyword_status(reviews: DataFrame, missing: DataFrame, empty: DataFrame) -> DataFrame:
    """``doc_id, status, mean_similarity``: FAIL if a required section is missing or empty or a review fails, WARN if one warns, else PASS.

    ``reviews(doc_id, verdict, similarity)``; the mean is 0 without reviews.
    """
    every = reviews.select("doc_id", "verdict", "similarity")
    for df in (missing, empty):
        every = every.unionByName(df.select("doc_id", F.lit("FAIL").alias("verdict"), F.lit(None).cast("double").alias("similarity")))
    v = F.col("verdict")
    worst = F.when(F.max(v == "FAIL"), "FAIL").when(F.max(v == "WARN"), "WARN").otherwise("PASS")
    return every.groupBy("doc_id").agg(worst.alias("status"), F.coalesce(F.round(F.avg("similarity"), 4), F.lit(0.0)).alias("mean_similarity"))
