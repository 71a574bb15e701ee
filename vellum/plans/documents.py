"""Queries on documents' structure. Their texts are written from columns by stated expressions, and the SQL gives the columns back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import clauses as C
from ..operators import names as N
from ..operators import provisions as P
from ..operators import refresh as U
from ..operators import statutes as L
from .registry import query, table


#: The rows that texts are made of: a customer's orders, numbered.
_LINES = "order_lines AS (SELECT o_custkey AS l_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l_linenumber, o_orderstatus AS l_returnflag, o_orderkey % 50 + 1 AS l_quantity, o_orderkey AS l_partkey, o_orderkey // 7 AS l_suppkey FROM orders)"


def stated(sql: str) -> str:
    """SQL over those rows."""
    return f"WITH {_LINES}, " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else f"WITH {_LINES} {sql}"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("l_orderkey"), n.alias("l_linenumber"), F.col("o_orderstatus").alias("l_returnflag"), "o_orderkey")
    return o.select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("o_orderkey") % 50 + 1).alias("l_quantity"), F.col("o_orderkey").alias("l_partkey"), F.floor(F.col("o_orderkey") / 7).alias("l_suppkey"))


def _say(*parts: str | Column) -> Column:
    """Literals and columns as one text."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def _orders(spark: SparkSession, sf_dir: str, line: Column, sep: str = "\n") -> DataFrame:
    """``doc_id, text``: a document for each customer, a line for each order."""
    li = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("x"))
    return li.select(F.col("l_orderkey").alias("doc_id"), F.array_join(F.transform("x", lambda x: x["t"]), sep).alias("text"))


def number() -> Column:
    """The number of a line."""
    return F.col("l_linenumber")


def flag() -> Column:
    return F.col("l_returnflag")


def part() -> Column:
    return F.col("l_partkey")


def supplier() -> Column:
    return F.col("l_suppkey")


def quantity() -> Column:
    return F.col("l_quantity").cast("int")


@query(stated("""SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS INT) AS k, '제' || l_linenumber || '조' AS clause_number,
'제' || l_linenumber || '조(' || l_returnflag || ') 부품 ' || l_partkey AS clause_text FROM order_lines"""))
def naive_clause_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause at every heading."""
    return C.naive_clauses(_orders(spark, sf_dir, _say("제", number(), "조(", flag(), ")\n부품 ", part())))


@query(stated("""WITH u AS (SELECT l_orderkey AS doc_id, l_linenumber, '제' || l_linenumber || '조' AS c, '제' || l_linenumber || '조(' || l_returnflag || ')' AS h, CAST(l_quantity AS INT) AS q, l_partkey AS p, l_suppkey AS s FROM order_lines),
r AS (SELECT doc_id, l_linenumber, 1 AS o, c || '제1항' AS clause_number, h || ' ①수량 ' || q AS clause_text FROM u WHERE q > 25
UNION ALL SELECT doc_id, l_linenumber, 2, c || '제2항', h || ' ②다음과 같다.' FROM u WHERE q > 25 UNION ALL SELECT doc_id, l_linenumber, 3, c || '제2항제1호', '1. 부품 ' || p FROM u WHERE q > 25
UNION ALL SELECT doc_id, l_linenumber, 4, c || '제2항제2호', '2. 공급 ' || s || ' 7. 법 제9조(인용) 참조' FROM u WHERE q > 25
UNION ALL SELECT doc_id, l_linenumber, 1, c, h || ' 수량 ' || q FROM u WHERE q <= 25 UNION ALL SELECT doc_id, l_linenumber, 2, c || '제1호', '1. 부품 ' || p FROM u WHERE q <= 25)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY l_linenumber, o) AS INT) AS k, clause_number, clause_text FROM r"""))
def clause_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses cut into paragraphs and items; a citation of a law and a number out of turn stay in the text."""
    long = _say("제", number(), "조(", flag(), ")\n앞말 ① 수량  ", quantity(), "\n② 다음과 같다. 1. 부품 ", part(), " 2. 공급 ", supplier(), " 7. 법 제9조(인용) 참조")
    short = _say("제", number(), "조(", flag(), ") 수량 ", quantity(), "\n1. 부품 ", part())
    return C.unit_clauses(_orders(spark, sf_dir, F.when(quantity() > 25, long).otherwise(short)))


def _layout(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines on pages of 300 points, three clauses a page: a heading, perhaps a paragraph, perhaps an item."""
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), ((number() - 1) / 3).cast("int").alias("page"), ((number() - 1) % 3 * 100 + 10).cast("double").alias("top"), number().alias("n"), quantity().alias("q"), flag().alias("f"))
    line = lambda dy, text: F.struct((F.col("top") + dy).alias("y"), F.lit(50.0 + dy).alias("x"), text.alias("text"))
    own = F.array(line(0.0, _say("제", F.col("n"), "조(", F.col("f"), ") 본문")), F.when(F.col("q") > 25, line(20.0, _say("① 수량 ", F.col("q")))), F.when(F.col("f") == "P", line(40.0, _say("1. 하나"))), F.when(F.col("f") == "P", line(60.0, _say("2. 둘"))))
    lines = li.select("doc_id", (F.col("page") + 1).alias("page"), F.inline(F.array_compact(own)))
    pages = li.where("(n - 1) % 3 = 0").select("doc_id", (F.col("page") + 1).alias("page"), F.lit(600.0).alias("width"), F.lit(300.0).alias("height"))
    return lines, pages


_PLACES = """WITH b AS (SELECT l_orderkey AS doc_id, CAST((l_linenumber - 1) // 3 + 1 AS INT) AS page, CAST((l_linenumber - 1) % 3 * 100 + 10 AS DOUBLE) AS top, l_linenumber AS n, CAST(l_quantity AS INT) AS q, l_returnflag AS f FROM order_lines),
e AS (SELECT *, coalesce(lead(page) OVER w, max(page) OVER (PARTITION BY doc_id)) AS stop_page, coalesce(lead(top) OVER w, 300.0::DOUBLE) AS stop_y, count(*) OVER (PARTITION BY doc_id) AS m FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
u AS (SELECT *, '제' || n || '조' AS c, CASE WHEN q > 25 THEN '제' || n || '조제1항' ELSE '제' || n || '조' END AS v FROM e WHERE m >= 3),
p AS (SELECT doc_id, c AS key, page AS start_page, top AS start_y, stop_page, stop_y, 50.0::DOUBLE AS x FROM u
UNION ALL SELECT doc_id, v, page, top + 20, stop_page, stop_y, 70 FROM u WHERE q > 25
UNION ALL SELECT doc_id, v || '제1호', page, top + 40, page, top + 60, 90 FROM u WHERE f = 'P' UNION ALL SELECT doc_id, v || '제2호', page, top + 60, stop_page, stop_y, 110 FROM u WHERE f = 'P')"""


@query(stated(_PLACES + " SELECT * FROM p"))
def clause_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where clauses, paragraphs and items begin and end on the pages."""
    return C.clause_positions(*_layout(spark, sf_dir))


@query(stated(_PLACES + """, g AS (SELECT *, unnest(range(start_page, stop_page + 1)) AS page FROM p)
SELECT doc_id, key, CAST(page AS INT) AS page, x, CASE WHEN page = start_page THEN start_y ELSE 0 END AS y, 580 - x AS width, CASE WHEN page = stop_page THEN stop_y ELSE 300 END - CASE WHEN page = start_page THEN start_y ELSE 0 END AS height
FROM g WHERE CASE WHEN page = stop_page THEN stop_y ELSE 300 END > CASE WHEN page = start_page THEN start_y ELSE 0 END"""))
def clause_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cut at page ends."""
    lines, pages = _layout(spark, sf_dir)
    return C.position_fragments(C.clause_positions(lines, pages), pages)


@query(stated(_PLACES + """, r AS (SELECT doc_id, '제' || n || '조제1항제' || (q % 3 + 1) || '호' AS clause_number, '제' || n || '조제1항' AS h, '제' || n || '조' AS c FROM e),
j AS (SELECT r.*, p.key, p.start_page, p.start_y, row_number() OVER (PARTITION BY r.doc_id, r.clause_number ORDER BY CASE p.key WHEN r.clause_number THEN 0 WHEN r.h THEN 1 ELSE 2 END) AS way FROM r LEFT JOIN p ON p.doc_id = r.doc_id AND p.key IN (r.clause_number, r.h, r.c))
SELECT doc_id, clause_number, key AS found_key, start_page, start_y FROM j WHERE way = 1"""))
def clause_place_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause's place, else its paragraph's, else that of the whole clause."""
    results = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), _say("제", number(), "조제1항제", quantity() % 3 + 1, "호").alias("clause_number"))
    return C.positions_of(results, clause_places(spark, sf_dir)).select("doc_id", "clause_number", "found_key", "start_page", "start_y")


@query(stated("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 7 THEN '단락' || l_linenumber ELSE '제 ' || l_linenumber || '조의2 제 ' || CAST(l_quantity AS INT) || '항' END AS label FROM order_lines"))
def clause_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause numbers as they are shown."""
    raw = F.when(number() == 7, _say("단락", number())).otherwise(_say("제", number(), "조의2제", quantity(), "항"))
    return _lines(spark, sf_dir).select("l_orderkey", "l_linenumber", C.clause_label(raw).alias("label"))


def _statute_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statute for each customer: a chapter, and an article for each line, every other one with paragraphs and items."""
    law = _say("제", number(), "조(품목 ", flag(), ") 수량 ", quantity())
    parts = _say("제", number(), "조(품목 ", flag(), ") 다음과 같다. ① 수량 ", quantity(), " ② 다음 각 호로 한다. 1. 부품 ", part(), " 2. 공급 가. 처음 ", supplier(), " 나. 제", number() + 1, "조제1항과 제1항")
    rows = F.array(F.struct((number() * 10).alias("ord"), F.when(number() % 2 == 1, parts).otherwise(law).alias("line")), F.struct((number() * 10 + 1).alias("ord"), _say("<개정 ", number(), "> [전문개정]").alias("line")))
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("file"), F.inline(rows))
    frame = F.array(F.struct(F.lit(0).alias("ord"), F.lit("제2장 본칙").alias("line")), F.struct(F.lit(1000).alias("ord"), F.lit("부칙").alias("line")))
    return li.unionByName(_files(spark, sf_dir).select("file", F.inline(frame))).select("file", "ord", _say("L", F.col("file")).alias("prefix"), "line")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers with orders; each is a file."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file")).distinct()


_PARTS = """WITH b AS (SELECT 'L' || l_orderkey AS prefix, l_orderkey, l_linenumber AS n, l_returnflag AS f, CAST(l_quantity AS INT) AS q, l_partkey AS p, l_suppkey AS s, 'L' || l_orderkey || '_2_0_' || l_linenumber AS h, '제2장제' || l_linenumber || '조' AS a FROM order_lines),
c AS (SELECT l_orderkey, n, h || '_0_0_0_0' AS chunk_id, NULL AS parent_id, a AS article_number, '제' || n || '조(품목 ' || f || ') ' || CASE WHEN n % 2 = 1 THEN '다음과 같다.' ELSE '수량 ' || q END AS text FROM b
UNION ALL SELECT l_orderkey, n, h || '_1_0_0_0', h || '_0_0_0_0', a || '제1항', '① 수량 ' || q FROM b WHERE n % 2 = 1
UNION ALL SELECT l_orderkey, n, h || '_2_0_0_0', h || '_0_0_0_0', a || '제2항', '② 다음 각 호로 한다.' FROM b WHERE n % 2 = 1
UNION ALL SELECT l_orderkey, n, h || '_2_1_0_0', h || '_2_0_0_0', a || '제2항제1호', '1. 부품 ' || p FROM b WHERE n % 2 = 1
UNION ALL SELECT l_orderkey, n, h || '_2_2_0_0', h || '_2_0_0_0', a || '제2항제2호', '공급' FROM b WHERE n % 2 = 1
UNION ALL SELECT l_orderkey, n, h || '_2_2_가_0', h || '_2_2_0_0', a || '제2항제2호가', '가. 처음 ' || s FROM b WHERE n % 2 = 1
UNION ALL SELECT l_orderkey, n, h || '_2_2_나_0', h || '_2_2_0_0', a || '제2항제2호나', '나. 제' || (n + 1) || '조제1항과 제1항' FROM b WHERE n % 2 = 1)"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.provisions(L.articles(_statute_lines(spark, sf_dir)))


@query(stated("SELECT 'L' || l_orderkey || '_2_0_' || l_linenumber AS chunk_id, '품목 ' || l_returnflag AS title, CAST(l_linenumber AS INT) AS jo FROM order_lines"))
def statute_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of statutes with their chapters."""
    return L.articles(_statute_lines(spark, sf_dir)).select("chunk_id", "title", "jo")


@query(stated(_PARTS + " SELECT chunk_id, parent_id, article_number, text FROM c"))
def statute_provisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, items and sub-items with ids, parents and texts."""
    return _chunks(spark, sf_dir).select("chunk_id", "parent_id", "article_number", "text")


@query(stated(_PARTS + " SELECT chunk_id, contains(article_number, '제3조') AS is_upper_law, l_orderkey % 2 = 0 AND (contains(article_number, '제2항제1호') OR contains(article_number, '제5조')) AS is_ref_article FROM c"))
def statute_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks tagged by lists of numbers."""
    own = P.tagged(_chunks(spark, sf_dir), F.substring("prefix", 2, 20).cast("long") % 2 == 0, ["제2항제1호", "제5조"], ["제3조"])
    return own.select("chunk_id", "is_upper_law", "is_ref_article")


_REFERENCES = stated(_PARTS + """, x AS (SELECT l_orderkey, n, h, h || '_2_2_나_0' AS chunk_id, 'L' || l_orderkey AS prefix FROM b WHERE n % 2 = 1),
r AS (SELECT chunk_id, coalesce(t.k, prefix || '_0_0_' || (n + 1) || '_1_0_0_0') AS ref_id, t.k IS NOT NULL AS is_resolved, 0 AS o FROM x LEFT JOIN (SELECT chunk_id AS k FROM c) t ON t.k = prefix || '_2_0_' || (n + 1) || '_1_0_0_0'
UNION ALL SELECT chunk_id, h || '_1_0_0_0', true, 1 FROM x
UNION ALL SELECT h || '_2_0_0_0', h || '_2_1_0_0', true, 0 FROM x UNION ALL SELECT h || '_2_0_0_0', h || '_2_2_0_0', true, 1 FROM x
UNION ALL SELECT h || '_2_2_나_0', NULL, true, 2 FROM x WHERE false)
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY o) - 1 AS INT) AS k, ref_id, is_resolved FROM r""")


@query(_REFERENCES)
def statute_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References between chunks, resolved or built, and the children that ``다음 각 호`` means."""
    return P.references(_chunks(spark, sf_dir), {}, {})


@query(_REFERENCES)
def refreshed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same references out of an older state: a third of the statutes read otherwise then, a fifth were not there, some are gone since."""
    now, file = _statute_lines(spark, sf_dir), F.col("file")
    then = now.withColumn("line", F.when((file % 3 == 0) & F.col("line").startswith("제"), F.concat("line", F.lit(" 제1조제2항"))).otherwise(F.col("line"))).where(file % 5 != 0)
    gone = now.where(file % 7 == 0).select((file + 10_000_000).alias("file"), "ord", F.concat(F.lit("X"), "prefix").alias("prefix"), "line")
    names, relatives = P.none(spark, "name", "prefix"), P.none(spark, "prefix", "kind", "target")
    return U.refreshed(U.built(then.unionByName(gone), names, relatives), now, names, relatives).references


@query(stated("""WITH b AS (SELECT 'L' || l_orderkey || '_2_0_' || l_linenumber || '_0_0_0_0' AS chunk_id, l_orderkey AS c, l_linenumber AS n, CAST(l_quantity AS INT) AS q FROM order_lines),
m AS (SELECT chunk_id, c, n, q, unnest([least(n, 3), greatest(n, 3)]) AS p FROM b WHERE n % 4 = 1),
r AS (SELECT chunk_id, 'D' || c || '_0_0_' || q || '_' || p || '_0_0_0' AS ref_id, false AS is_resolved, p AS o FROM m
UNION ALL SELECT chunk_id, 'D' || c || '_0_0_' || q || '_0_0_0_0', false, 0 FROM b WHERE n % 4 = 2
UNION ALL SELECT chunk_id, 'L' || c || '_2_0_' || (n - 1) || unnest(['_0_0_0_0', '_0_1_0_0', '_0_2_0_0']), true, unnest([0, 1, 2]) FROM b WHERE n % 4 = 3
UNION ALL SELECT b.chunk_id, t.chunk_id, true, 0 FROM b JOIN b t ON t.c = b.c + 1 AND t.n = 1 WHERE b.n % 4 = 0)
SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY o) - 1 AS INT) AS k, ref_id, is_resolved FROM r"""))
def statute_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in quotes among as many names as there are laws, the law's own decree, and all items of an article."""
    at, own = number() % 4, F.col("l_orderkey")
    line = (
        F.when(at == 1, _say("제", number(), "조(인용) 「품목", own, "법 시행령」 제", quantity(), "조제", number(), "항 및 제3항을 따른다"))
        .when(at == 2, _say("제", number(), "조(준용) 영 제", quantity(), "조에 따라 다음과 같다. 1. 갑 2. 을"))
        .when(at == 3, _say("제", number(), "조(각호) 제", number() - 1, "조 각 호에 따른다")).otherwise(_say("제", number(), "조(타법) 「품목", own + 1, "법」 제1조"))
    )
    li = _lines(spark, sf_dir).select(own.alias("file"), (number() * 10).alias("ord"), line.alias("line"))
    heads = _files(spark, sf_dir).select("file", F.lit(0).cast("int").alias("ord"), F.lit("제2장 본칙").alias("line"))
    chunks = P.provisions(L.articles(li.unionByName(heads).select("file", "ord", _say("L", F.col("file")).alias("prefix"), "line")))
    files = _files(spark, sf_dir)
    named = F.array(F.struct(_say("품목", F.col("file"), "법").alias("name"), _say("L", F.col("file")).alias("prefix")), F.struct(_say("품목", F.col("file"), "법 시행령").alias("name"), _say("D", F.col("file")).alias("prefix")))
    relatives = files.select(_say("L", F.col("file")).alias("prefix"), F.lit("영").alias("kind"), _say("D", F.col("file")).alias("target"))
    return P.references(chunks, files.select(F.inline(named)), relatives)


@query(stated("""WITH b AS (SELECT 'C' || l_orderkey || '_1_2_0_' || l_linenumber AS h, 'C' || l_orderkey || '_0_0_2_' || l_linenumber AS x FROM order_lines)
SELECT h || '_가_0_0' AS chunk_id, 0::INT AS k, h || '_가_1_0' AS ref_id, true AS is_resolved FROM b
UNION ALL SELECT h || '_가_0_0', 1, x || '_나_0_0', false FROM b UNION ALL SELECT h || '_가_0_0', 2, x || '_나_2_0', false FROM b"""))
def condition_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted places of contract conditions; what a place leaves out comes from the one before."""
    rows = F.array(
        F.struct((number() * 10).alias("ord"), _say(number(), ". 수량 ", quantity()).alias("line")),
        F.struct((number() * 10 + 1).alias("ord"), _say("가. 항목 제2절 “", number(), "-가-1)” 및 “나”와 “2)” 1) 부품 ", part()).alias("line")),
    )
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("file"), F.inline(rows))
    heads = F.array(F.struct(F.lit(0).alias("ord"), F.lit("제1장 총칙").alias("line")), F.struct(F.lit(1).alias("ord"), F.lit("제2절 조건").alias("line")))
    lines = li.unionByName(_files(spark, sf_dir).select("file", F.inline(heads))).select("file", "ord", _say("C", F.col("file")).alias("prefix"), F.lit("p").alias("kind"), "line")
    return P.references(P.conditions(lines))


_NAMES = "n AS (SELECT DISTINCT unnest([a[1], a[2], a[1] || ' ' || a[2][1:3]]) AS name FROM (SELECT string_split(p_name, ' ') AS a FROM part))"


@query(f"WITH {_NAMES} SELECT text, name FROM (SELECT p_name AS text, name, row_number() OVER (PARTITION BY p_name ORDER BY length(name) DESC, name) AS r FROM (SELECT DISTINCT p_name FROM part) JOIN n ON contains(p_name, name)) WHERE r = 1")
def longest_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of many names (words, and words with the start of the next) in each part's name, found in one pass."""
    parts, a = table(spark, sf_dir, "part"), F.split("p_name", " ")
    names = parts.select(F.explode(F.array(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.concat(F.get(a, F.lit(0)), F.lit(" "), F.substring(F.get(a, F.lit(1)), 1, 3)))).alias("name")).distinct()
    return N.longest_names(parts, "p_name", names, "name")


@query(stated("""WITH b AS (SELECT *, 'C' || l_orderkey || '_1_2_0_' || l_linenumber AS h, '제1장제2절제' || l_linenumber || '항' AS a FROM order_lines)
SELECT h || '_0_0_0' AS chunk_id, NULL AS parent_id, a AS article_number, l_linenumber || '. 수량 ' || CAST(l_quantity AS INT) || ' 이어서' AS text FROM b
UNION ALL SELECT h || '_가_0_0', h || '_0_0_0', a || '가', '가. 항목' FROM b UNION ALL SELECT h || '_가_1_0', h || '_가_0_0', a || '가제1호', '1) 부품 ' || l_partkey FROM b
UNION ALL SELECT h || '_가_1_나', h || '_가_1_0', a || '가제1호나', '나) 공급 ' || l_suppkey FROM b"""))
def statute_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract conditions: clauses, items, numbered sub-items and details."""
    rows = F.array(
        F.struct((number() * 10).alias("ord"), _say(number(), ". 수량 ", quantity()).alias("line")), F.struct((number() * 10 + 1).alias("ord"), F.lit("이어서").alias("line")),
        F.struct((number() * 10 + 2).alias("ord"), _say("가. 항목 1) 부품 ", part(), " 나) 공급 ", supplier()).alias("line")),
    )
    li = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("file"), F.inline(rows))
    heads = F.array(F.struct(F.lit(0).alias("ord"), F.lit("제1장 총칙").alias("line")), F.struct(F.lit(1).alias("ord"), F.lit("제2절 조건").alias("line")))
    lines = li.unionByName(li.select("file").distinct().select("file", F.inline(heads))).select("file", "ord", _say("C", F.col("file")).alias("prefix"), F.lit("p").alias("kind"), "line")
    return P.conditions(lines).select("chunk_id", "parent_id", "article_number", "text")
