"""Text, dataset and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import datasets as D
from ..operators import matching as G
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import retrieval as R
from ..scratch import Scratch
from .registry import query, table

_WS = r"[\s\x{a0}\x{3000}]+"


@query("""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[ \t\n]+', '', 'g') AS k FROM documents)
SELECT doc_id, CAST(n AS BIGINT) AS copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY k) AS n FROM d) WHERE r = 1""")
def keep_first_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each normalised text, found by a grouped minimum over hashes of the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.regexp_replace(F.lower("text"), "[ \t\n]+", "")).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


@query("SELECT k AS copies, CAST(count(*) AS BIGINT) AS texts FROM (SELECT CAST(count(*) AS BIGINT) AS k FROM documents GROUP BY md5(text)) GROUP BY k")
def duplicate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many texts occur how often."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text")).agg(F.count("*").alias("copies")).groupBy("copies").agg(F.count("*").alias("texts"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\s().,:;\\[\\]]+', '', 'g')) AS form, CAST(length(regexp_replace(text, '[\\s().,:;\\[\\]]+', '', 'g')) AS INT) AS n FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that comparisons use."""
    form = T.compare_form(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(form).alias("form"), F.length(form).alias("n"))


@query("""WITH b AS (SELECT doc_id, text, list_filter(list_transform(string_split_regex(text, '\n[ \t]*\n'), lambda x: trim(x, ' ')), lambda x: x <> '') AS p FROM documents),
q AS (SELECT doc_id, CASE WHEN len(p) > 1 THEN p ELSE list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') END AS p FROM b)
SELECT doc_id, CAST(len(p) AS INT) AS n, coalesce(CAST(list_max(list_transform(p, lambda x: length(x))) AS INT), 0) AS longest FROM q""")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of each document."""
    p = table(spark, sf_dir, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("n"), F.coalesce(F.array_max(F.transform("p", F.length)), F.lit(0)).alias("longest"))


_STOP = ["the", "and", "that", "for"]


@query("""WITH w AS (SELECT doc_id, list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z]{2,}|[0-9]{2,}')), lambda x: x NOT IN ('the', 'and', 'that', 'for')) AS ws FROM documents),
b AS (SELECT list_filter(list_distinct(regexp_extract_all(text, '[A-Za-z]{2,}|[0-9]{2,}')), lambda x: x NOT IN ('the', 'and', 'that', 'for')) AS bs, item_id FROM benchmark)
SELECT doc_id, item_id, score FROM (SELECT doc_id, item_id, round(CASE WHEN len(bs) = 0 THEN 1.0 WHEN len(ws) = 0 THEN 0.0 ELSE len(list_intersect(bs, ws))::DOUBLE / len(bs) END, 6) AS score FROM w, b) WHERE score >= 0.5""")
def significant_word_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of which at least half of the significant words occur in a document, with that part: all items, all documents."""
    words = lambda c: F.explode(T.significant_words(F.col(c), _STOP)).alias("word")
    items = table(spark, sf_dir, "benchmark").select("item_id", words("text"))
    return R.word_containment(table(spark, sf_dir, "documents").select("doc_id", words("text")), items, "doc_id", "item_id", 0.5)


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS tok FROM documents), a AS (SELECT doc_id, tok, count(*) AS n FROM t GROUP BY ALL),
p AS (SELECT doc_id, doc_id + 1 AS other FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents))
SELECT p.doc_id, a.tok AS item, CAST(a.n - coalesce(b.n, 0) AS BIGINT) AS n FROM p JOIN a ON a.doc_id = p.doc_id LEFT JOIN a b ON b.doc_id = p.other AND b.tok = a.tok WHERE a.n > coalesce(b.n, 0)""")
def important_token_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that a document holds more often than the next one."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]+"), 0)).alias("item"))
    a = t.groupBy("doc_id", "item").agg(F.count("*").alias("n"))
    ids = table(spark, sf_dir, "documents").select("doc_id")
    pairs = ids.join(ids.select((F.col("doc_id") - 1).alias("doc_id")), "doc_id")
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), "item", F.col("n").alias("m"))
    rest = F.col("n") - F.coalesce("m", F.lit(0))
    return a.join(pairs, "doc_id").join(b, ["doc_id", "item"], "left").select("doc_id", "item", rest.alias("n")).where("n > 0")


@query("""WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, line, length(line) AS n, 1 + coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, length(text) AS total FROM l),
a AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM p WHERE regexp_matches(line, '^[A-D]'))
SELECT doc_id, CAST(pos AS INT) AS pos, CAST(coalesce(nxt, total + 1) - pos AS INT) AS n FROM a""")
def section_lead_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections from each heading line to the next, cut inside each document's row."""
    d = table(spark, sf_dir, "documents")
    heads = F.filter(T.line_starts(F.col("text")), lambda x: x["line"].rlike("^[A-D]"))
    cut = T.lead_slices(F.col("text"), F.transform(heads, lambda x: x["pos"]))
    return d.select("doc_id", F.inline(cut)).select("doc_id", "pos", F.length("content").alias("n"))


@query("SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, coalesce(nullif(regexp_extract(url, '^https?://([^/]+)', 1), ''), 'none') AS host FROM pages")
def html_title_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first match of patterns in order."""
    host = F.coalesce(F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit("")), F.lit("none"))
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("")).alias("title"), host.alias("host"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n_chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f(conv_id, i, used, n) AS (SELECT conv_id, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT o.conv_id, o.i, used + CASE WHEN used + n_chars <= 1500 THEN n_chars ELSE 0 END, n + CASE WHEN used + n_chars <= 1500 THEN 1 ELSE 0 END FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)
SELECT conv_id, max(used) AS used, CAST(max(n) AS INT) AS n FROM f GROUP BY conv_id""")
def token_budget_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that fit a budget in order, those too large skipped and later ones still tried."""
    items = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("key"), F.length("text").cast("long").alias("size"))))
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("items"))
    fit = R.budget_fold(F.col("items"), 1500, F.lit(0))
    return t.select("conv_id", fit.alias("f")).select("conv_id", F.col("f.used").alias("used"), F.size("f.keys").alias("n"))


_PRED = "CASE WHEN length(text) - length(replace(text, '!', '')) > 5 OR contains(text, '&&&') THEN 'bad' WHEN length(text) < 100 THEN NULL ELSE 'good' END"
_JUDGED = f"j AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS gold, {_PRED} AS pred FROM labels JOIN documents USING (doc_id))"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    marks = F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))
    pred = F.when((marks > 5) | text.contains("&&&"), "bad").when(F.length(text) < 100, F.lit(None)).otherwise("good")
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return j.select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("gold"), pred.alias("pred"))


LABELS = ["good", "bad"]


@query(f"WITH {_JUDGED} SELECT gold, CAST(count(*) FILTER (WHERE pred = 'good') AS BIGINT) AS pred_good, CAST(count(*) FILTER (WHERE pred = 'bad') AS BIGINT) AS pred_bad FROM j GROUP BY gold")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold against predicted labels."""
    return M.confusion(_judged(spark, sf_dir), LABELS)


@query(f"""WITH {_JUDGED}, t AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE gold = pred) / count(*)::DOUBLE AS po,
count(*) FILTER (WHERE gold = 'good') / count(*)::DOUBLE * (count(*) FILTER (WHERE pred = 'good') / count(*)::DOUBLE) + count(*) FILTER (WHERE gold = 'bad') / count(*)::DOUBLE * (count(*) FILTER (WHERE pred = 'bad') / count(*)::DOUBLE) AS pe FROM j WHERE pred IS NOT NULL)
SELECT CAST(n AS BIGINT) AS n, round(po, 6) AS po, round(pe, 6) AS pe, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) ELSE 1 END, 6) AS kappa FROM t""")
def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement beyond chance."""
    return M.cohen_kappa(_judged(spark, sf_dir), LABELS)


def _f1(where: str, labels: str) -> str:
    return f"""WITH {_JUDGED}, o AS (SELECT * FROM j WHERE {where}), l AS (SELECT unnest(['good', 'bad']) AS label),
c AS (SELECT label, count(*) FILTER (WHERE gold = label) AS s, count(*) FILTER (WHERE pred = label) AS f, count(*) FILTER (WHERE gold = label AND pred = label) AS tp FROM l, o GROUP BY label),
p AS (SELECT label, s, coalesce(tp::DOUBLE / nullif(f, 0), 0) AS p, coalesce(tp::DOUBLE / nullif(s, 0), 0) AS r FROM c)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM o) AS n, (SELECT round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0 END), 6) FROM o) AS accuracy, round(avg(round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6)), 5) AS macro_f1 FROM p {labels}"""


@query(_f1("pred IS NOT NULL", ""))
def macro_f1_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 without unparsable predictions."""
    return M.macro_f1(_judged(spark, sf_dir), LABELS, "a")


@query(_f1("true", "WHERE s > 0"))
def macro_f1_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 with unparsable predictions as errors, over labels with support."""
    return M.macro_f1(_judged(spark, sf_dir), LABELS, "b")


@query(_f1("true", "WHERE label IN (SELECT gold FROM o UNION SELECT pred FROM o WHERE pred IS NOT NULL)"))
def macro_f1_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro F1 over all labels seen."""
    return M.macro_f1(_judged(spark, sf_dir), LABELS, "c")


@query("WITH g AS (SELECT lang, quality, toxic, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang, quality, toxic) SELECT lang, quality, toxic, CAST(n AS BIGINT) AS n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang), 6) AS ratio FROM g")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by language with their share."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    out = j.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))
    return out.withColumn("ratio", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


@query("SELECT quality, CAST(greatest(1, round_even(count(*) * 0.3::DOUBLE, 0)) AS BIGINT) AS n_valid, CAST(count(*) - greatest(1, round_even(count(*) * 0.3::DOUBLE, 0)) AS BIGINT) AS n_train FROM labels GROUP BY quality")
def stratified_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that keeps the labels' shares."""
    s = D.stratified_split(table(spark, sf_dir, "labels"), "quality", "doc_id")
    return s.groupBy("quality").agg(F.count_if(F.col("split") == "valid").alias("n_valid"), F.count_if(F.col("split") == "train").alias("n_train"))


@query("SELECT conv_id, CAST(count(*) AS INT) AS n_messages, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat records."""
    m = D.chat_records(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    part = lambda f: F.transform("messages", lambda x: x[f])
    return m.select("conv_id", F.size("messages").alias("n_messages"), F.array_join(part("role"), ",").alias("roles"), F.md5(F.array_join(part("content"), "\n")).alias("digest"))


@query("""WITH l AS (SELECT lang, n_chars AS n FROM documents), a AS (SELECT lang, list(n ORDER BY n) AS ns FROM l GROUP BY lang)
SELECT lang, CAST(len(ns) AS BIGINT) AS n, ns[1] AS shortest, ns[len(ns) // 2 + 1] AS median, CAST(floor(list_avg(ns)) AS BIGINT) AS mean, ns[-1] AS longest, CAST(len(list_filter(ns, lambda x: x > 2048)) AS BIGINT) AS over_2048, CAST(len(list_filter(ns, lambda x: x > 8192)) AS BIGINT) AS over_8192 FROM a""")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths by language: extremes, upper median, floored mean, shares over limits.

    The median is taken from counts by length, so a language's rows are never gathered in one list.
    """
    c = table(spark, sf_dir, "documents").groupBy("lang", F.col("n_chars").alias("x")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("lang").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("upto", F.sum("m").over(w)).withColumn("n", F.sum("m").over(Window.partitionBy("lang")))
    at = F.expr("n div 2 + 1")
    return c.groupBy("lang").agg(
        F.sum("m").alias("n"), F.min("x").alias("shortest"), F.min(F.when(F.col("upto") >= at, F.col("x"))).alias("median"), F.floor(F.sum(F.col("x") * F.col("m")) / F.sum("m")).alias("mean"),
        F.max("x").alias("longest"), F.sum(F.when(F.col("x") > 2048, F.col("m")).otherwise(0)).alias("over_2048"), F.sum(F.when(F.col("x") > 8192, F.col("m")).otherwise(0)).alias("over_8192"),
    )


@query("SELECT conv_id, turn, CASE WHEN n > 1 THEN conv_id || '#' || r ELSE CAST(conv_id AS VARCHAR) END AS unique_id FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)")
def duplicate_suffix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids made unique by a suffix."""
    return D.unique_ids(table(spark, sf_dir, "conversations"), "conv_id", [F.col("turn")]).select("conv_id", "turn", "unique_id")


@query("SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def length_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with subtotals."""
    out = table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("source", F.lit("all")).alias("source"), "n", "chars")


@query("""WITH s AS (SELECT doc_id, CASE WHEN n_chars < 80 THEN 'short' WHEN contains(text, '&&&') THEN 'symbols' WHEN lang <> 'en' THEN 'language' END AS reason FROM documents)
SELECT coalesce(reason, 'accepted') AS reason, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that each example fails."""
    why = D.reject_reason((F.col("n_chars") < 80, "short"), (F.col("text").contains("&&&"), "symbols"), (F.col("lang") != "en", "language"))
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(why, F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query()
def difflib_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each turn with the one before it in its conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("before is not null")
    return t.select("conv_id", "turn", F.round(S.ratio("before", "text"), 6).alias("ratio"))


@query()
def containment_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant turn the user turn of its conversation that holds most of it, all its lines counted."""
    c = G.dealt(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("a"), G.histogram(F.col("text")).alias("ha"))
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("best"), F.col("text").alias("b"), G.histogram(F.col("text")).alias("hb"))
    none = F.lit(None).cast("double")
    pairs = a.join(u, "conv_id").withColumns({"floor": none, "least": none})
    return G.best_matches(pairs, ["conv_id", "turn"], "best", "containment", digits=6, scratch=Scratch(spark, "matches"))
