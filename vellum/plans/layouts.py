"""Queries on sections, reviews, tables and text forms; their texts are written from columns, and the SQL gives the columns back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T
from ..operators import datasets as D
from ..operators import lookup as K
from ..operators import metrics as M
from ..operators import ordered as O
from ..operators import retrieval as R
from ..operators import review as V
from ..operators import sections as X
from ..operators import tables as B
from .documents import _lines, _orders, _say, flag, number, part, quantity, stated, supplier
from .registry import query, table
from .retrieval import _BASE, _arms, _relevant


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_name", "c_mktsegment", F.col("c_custkey").alias("c"))


def _spread(d: DataFrame) -> DataFrame:
    """Dealt by document: many customers lie in few bytes, so a scan, or tasks made by bytes, would be few for all the texts written from them."""
    return d.repartition(2 * d.sparkSession.sparkContext.defaultParallelism, "doc_id")


# text forms


@query("""WITH c AS (SELECT c_custkey AS doc_id, c_mktsegment AS s, ['1.', 'Ⅱ.', '가.', '12.3', ''][c_custkey % 5 + 1] AS n, repeat('사업명', c_custkey % 3 + 1) AS t, length(c_name) % 4 AS k FROM customer)
SELECT doc_id, n || t || '(' || s || ')' || doc_id AS squeezed, replace(n, '.', '') || t || s || doc_id AS loose, t || '(' || s || ')' || doc_id AS title, replace(n, '.', '') || t || s || doc_id AS compared FROM c""")
def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without white space, without signs, and titles without their numeral; numerals, lengths and blanks follow the row."""
    c, blank = F.col("c"), F.repeat(F.lit(" \u3000\u00a0"), (F.length("c_name") % 4).cast("int"))
    numeral = F.get(F.array(*map(F.lit, ("1.", "Ⅱ.", "가.", "12.3", ""))), (c % 5).cast("int"))
    d = _customers(spark, sf_dir).withColumn("t", F.concat(blank, numeral, F.lit(" "), F.repeat(F.concat(F.lit("사"), blank, F.lit("업　명")), (c % 3 + 1).cast("int")), F.lit(" ("), "c_mktsegment", F.lit(")"), blank, c.cast("string"), F.lit("\n")))
    return d.select("doc_id", T.squeeze(F.col("t")).alias("squeezed"), T.loose_form(F.col("t")).alias("loose"), T.title_form(F.col("t")).alias("title"), T.compare_form(F.col("t")).alias("compared"))


@query("""WITH c AS (SELECT c_custkey AS c, c_custkey % 4 AS k, c_name AS n, c_mktsegment AS s FROM customer)
SELECT c AS doc_id, CASE WHEN k >= 2 THEN '사업 개요 ' || c || chr(10) || chr(10) ELSE '' END || array_to_string(list_transform(range(1, k + 2), lambda i: '본문 ' || n || ' ' || i), chr(10)) || chr(10) || '끝 2024 ... ' || s AS cleaned FROM c""")
def cleaned_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without contents lines, page numbers and contents headings; how many there are and where follows the row."""
    c, k = F.col("c"), (F.col("c") % 4).cast("int")
    page = F.get(F.array(F.lit("- 4 -"), F.lit("Page 5"), F.lit("  17"), _say("page ", c)), k)
    contents = F.array_join(F.transform(F.sequence(F.lit(1), k + 1), lambda i: F.concat(i.cast("string"), F.lit(". "), F.col("c_mktsegment"), F.lit(" ······ "), (i * 3).cast("string"))), "\n")
    head = F.when(k >= 2, _say("사업 \t 개요 ", c, "\n\n\n\n")).otherwise("")
    body = F.array_join(F.transform(F.sequence(F.lit(1), k + 1), lambda i: F.concat(F.lit("본문 "), F.col("c_name"), F.lit("  "), i.cast("string"))), "\n")
    raw = F.concat(F.lit("목  차\n"), contents, F.lit("\n"), page, F.lit("\n"), head, body, F.lit("\n끝 2024 ... "), "c_mktsegment", F.lit("\n"))
    return _customers(spark, sf_dir).select("doc_id", T.clean(raw).alias("cleaned"))


@query("""SELECT c_custkey AS doc_id, '2024년3월1일,20240301,6개월,2024년,' || (c_custkey % 900 + 100) || '000원,5만원,3억원,' || '000원,' || '12%' AS tokens FROM customer""")
def important_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, durations, amounts and percentages, pattern after pattern."""
    raw = _say("2024년 3월 1일부터 2024.03.01까지 6 개월, ", F.col("c") % 900 + 100, ",000원 또는 5만원, 3억원과 1.2%")
    tokens = T.important_tokens(raw)
    return _customers(spark, sf_dir).select("doc_id", F.array_join(tokens, ",").alias("tokens"))


@query("""SELECT c_custkey AS doc_id, DATE '2025-01-01' + CAST(c_custkey % 28 AS INT) AS start, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE DATE '2025-12-31' END AS stop, DATE '2025-03-01' + CAST(c_custkey % 28 AS INT) AS dotted,
CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 1000 END AS amount, CASE WHEN c_custkey % 2 = 0 THEN '10.0.0.1' ELSE '10.9.9.9' END AS ip, '{"a": ' || c_custkey || '}' AS unfenced, '1,2,3,7' AS articles FROM customer""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods, dates, amounts, addresses, fenced answers and ranges of articles."""
    c, day = F.col("c"), F.lpad((F.col("c") % 28 + 1).cast("string"), 1, "0")
    day = (c % 28 + 1).cast("string")
    period = T.period(_say("계약기간: 2025년 1월 ", day, "일 부터 2025년 ", F.when(c % 3 == 0, "13월 1일").otherwise("12월 31일"), "까지"))
    ip = T.client_ip(F.when(c % 2 == 0, " 10.0.0.1 , 10.2.2.2"), F.lit("10.9.9.9"))
    return _customers(spark, sf_dir).select(
        "doc_id", period["start"].alias("start"), period["stop"].alias("stop"), T.dotted_date(_say("제출 2025 . 3.", day)).alias("dotted"),
        T.money(F.when(c % 2 == 0, F.format_number(c * 1000, 0)).otherwise("약 3천")).alias("amount"), ip.alias("ip"),
        T.unfence(_say("```json\n{\"a\": ", c, "}\n```")).alias("unfenced"), F.array_join(T.enumerate_range(F.lit("제1조부터 제3조까지와 제7조, 제2조")), ",").alias("articles"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE ['불일치', '일치', '검토'][o_custkey % 3 + 1] END AS label FROM orders""")
def parsed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels from JSON objects, fenced lists and plain words: each label in each form."""
    key, label = F.col("o_orderkey") % 5, F.get(F.array(*map(F.lit, ("불일치", "일치", "검토"))), (F.col("o_custkey") % 3).cast("int"))
    raw = (
        F.when(key == 0, _say('{"label": "', label, '", "n": ', F.col("o_custkey"), "}")).when(key == 1, _say('```json\n[{"label": "', label, '"}]\n```')).when(key == 2, _say("판정은 ", label, " (", F.col("o_orderpriority"), ")"))
        .when(key == 3, _say(label, " 필요 ", F.col("o_custkey"))).otherwise("모름")
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", T.parse_label(raw, ["일치", "불일치", "검토"]).alias("label"))


# documents to sections


_SPEC = [("A", "배경", ["배경"]), ("B", "목적", ["목적"]), ("RFP-04-04", "기능", ["기능"]), ("D", "없음", ["없음"])]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c")
    text = _say(
        "사 업 명 : 사업 ", c, "\n수요기관: 기관 ", F.col("c_mktsegment"), "\n사업예산 : 금 ", F.format_number(c * 1000 + 1000, 0), "원\nⅠ. 배경 장\n1. 배경 목차\n2. 배경 ", c, "\n본문 ", F.col("c_name"),
        "\n머리 ① 목적\n목적 본문\n □ 기능 요구 (SFR)\nSFR-001\n요구사항 명칭 이름 ", c, "\n[정의] 정의 ", c, "\n산출정보 보고서 ", c, " 요구사항 분류 기능\nsfr-02 요구사항 명칭 둘\n",
    )
    return _spread(_customers(spark, sf_dir)).select("doc_id", text.alias("text"))


@query("""WITH c AS (SELECT c_custkey AS doc_id, c_name FROM customer)
SELECT doc_id, 'A' AS code, '2. 배경 ' || doc_id || chr(10) || '본문 ' || c_name || chr(10) || '머리' AS content, true AS found FROM c UNION ALL SELECT doc_id, 'B', '① 목적' || chr(10) || '목적 본문', true FROM c
UNION ALL SELECT doc_id, 'RFP-04-04', '□ 기능 요구 (SFR)' || chr(10) || 'SFR-001' || chr(10) || '요구사항 명칭 이름 ' || doc_id || chr(10) || '[정의] 정의 ' || doc_id || chr(10) || '산출정보 보고서 ' || doc_id || ' 요구사항 분류 기능' || chr(10) || 'sfr-02 요구사항 명칭 둘', true FROM c
UNION ALL SELECT doc_id, 'D', '', false FROM c""")
def request_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of requests from the last heading of each code to the next one, missing ones included."""
    return X.anchored_sections(_requests(spark, sf_dir), X.spec_table(spark, _SPEC)).select("doc_id", "code", "content", "found")


@query("""SELECT c_custkey AS doc_id, 'SFR-001' AS id, 'SFR' AS type, '이름 ' || c_custkey AS name, '정의 ' || c_custkey AS definition, '보고서 ' || c_custkey AS output FROM customer
UNION ALL SELECT c_custkey, 'SFR-02', 'SFR', '둘', '', '' FROM customer""")
def request_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of a section by their ids."""
    s = X.anchored_sections(_requests(spark, sf_dir), X.spec_table(spark, _SPEC)).where("code = 'RFP-04-04'")
    return X.requirements(s).select("doc_id", "id", "type", "name", "definition", "output")


@query("SELECT c_custkey AS doc_id, '사업 ' || c_custkey AS project_name, '기관 ' || c_mktsegment AS client, c_custkey * 1000 + 1000 AS budget_value FROM customer")
def request_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request says of itself."""
    return X.metadata(_requests(spark, sf_dir)).select("doc_id", "project_name", "client", "budget_value")


@query("""WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 3 + 1 AS n, c_custkey % 2 = 0 AS b, c_name, c_mktsegment AS s FROM customer)
SELECT doc_id, 'A' AS code, array_to_string(list_transform(range(1, n + 1), lambda i: '첫 본문 ' || s || ' ' || (i * doc_id)), chr(10)) AS content, true AS found FROM c
UNION ALL SELECT doc_id, 'B', CASE WHEN b THEN '둘째 본문 ' || c_name || chr(10) || '3. 긴 ' || repeat('가', 30 + n) ELSE '' END, b FROM c UNION ALL SELECT doc_id, 'C', '', false FROM c""")
def plan_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by an ordered search without white space, after the table of contents; headings left alone at the end go."""
    rows = [("A", "사업 개요", ["사업개요"]), ("B", "추진 전략", ["추진전략"]), ("C", "없음", ["없는 장"])]
    c, n = F.col("c"), (F.col("c") % 3 + 1).cast("int")
    first = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("첫 본문 "), F.col("c_mktsegment"), F.lit(" "), (i * c).cast("string"))), "\n")
    second = F.when(c % 2 == 0, _say("\n추진 전략\n둘째 본문 ", F.col("c_name"), "\n3. 긴 ", F.repeat(F.lit("가"), 30 + n), "\n")).otherwise("\n나.\n")
    text = _say("표지 ", c, "\n목 차\n사업 개요\n추진 전략\n없는것\n\n본문 시작 ", F.repeat(F.lit("문장 "), n + 60), "\n사 업 개 요\n", first, "\n2. 다음\n가.", second)
    return X.keyword_sections(_customers(spark, sf_dir).select("doc_id", text.alias("text")), X.spec_table(spark, rows), rows).select("doc_id", "code", "content", "found")


@query(stated("""SELECT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS k, '제' || l_linenumber || '조' AS clause_number, '제' || l_linenumber || '조(' || l_returnflag || ') 부품 ' || l_partkey || ' 제' || (l_linenumber + 20) || '조에 따라 ' || l_suppkey AS clause_text FROM order_lines"""))
def continued_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses by headings that continue the numbering; citations stay in the text."""
    return X.clauses(_orders(spark, sf_dir, _say("제", number(), "조(", flag(), ") 부품 ", part(), " 제", number() + 20, "조에 따라 ", supplier())))


# reviews


def _sections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A spec, and for each customer an original and parsed sections with one of ten faults by key; lengths and endings follow the row."""
    d, c = _spread(_customers(spark, sf_dir)), F.col("c")
    body = lambda w, n, end: F.concat(F.repeat(F.lit(w), n.cast("int")), end.cast("string"))
    a, b = body("가나다 ", 20 + c % 5, c), body("라마바 ", 20 + F.length("c_name") % 7 + c % 3, F.col("c_mktsegment"))
    first, second = body("사아자 ", 30 + c % 4, c), body("차카타 ", F.lit(10), c)
    e = F.concat(first, F.lit("\n\n"), second)
    sec = lambda code, pos, title, content: F.struct(F.lit(code).alias("code"), pos.alias("ord"), title.alias("title"), content.alias("content"))
    spec = spark.createDataFrame([("A", 0, "개요"), ("B", 1, "방안"), ("C", 2, "일정")], "code string, ord int, title string")
    orig = d.select("doc_id", F.inline(F.array(*(F.struct(F.lit(k).alias("code"), F.lit(n).alias("pos"), t.alias("content")) for n, (k, t) in enumerate((("A", a), ("B", b), ("C", e)))))))
    k = c % 10
    swap = (k == 2) | (k == 9)
    in_a = F.when(swap, b).when(k == 6, body("가나다 ", F.lit(3), F.repeat(F.lit("파하거 "), 40))).when(k == 8, F.concat(a, F.lit("\n\n"), second)).otherwise(a)
    rows = F.array(
        sec("A", F.when(k == 3, 1).otherwise(0), F.when(k.isin(4, 9), "다른 이름").otherwise("개요"), in_a), sec("B", F.when(k == 3, 0).otherwise(1), F.lit("방안"), F.when(k == 1, " .").when(swap, a).otherwise(b)),
        F.when(k != 0, sec("C", F.lit(2), F.lit("일정"), F.when(k.isin(7, 8), first).otherwise(e))), F.when(k == 5, sec("Z", F.lit(3), F.lit("모름"), F.lit("기타 내용"))),
    )
    return spec, orig, d.select("doc_id", F.inline(F.array_compact(rows)))


_ISSUES = """WITH c AS (SELECT c_custkey AS doc_id, c_custkey % 10 AS k FROM customer),
f(k, issue, code, related) AS (VALUES (0, 'missing_section', 'C', NULL), (1, 'empty_section', 'B', NULL), (2, 'content_misplaced', 'A', 'B'), (2, 'content_misplaced', 'B', 'A'), (3, 'section_order_mismatch', NULL, NULL),
 (4, 'section_title_mismatch', 'A', NULL), (5, 'unrecognized_section', 'Z', NULL), (6, 'section_content_mismatch', 'A', NULL), (7, 'paragraph_missing', 'C', NULL), (8, 'paragraph_misplaced', 'C', 'A'),
 (9, 'section_title_content_mismatch', 'A', 'B'), (9, 'content_misplaced', 'B', 'A')),
i AS (SELECT doc_id, issue, code, related FROM c JOIN f USING (k))"""


@query(_ISSUES + " SELECT * FROM i")
def section_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with parsed sections, rule by rule: every kind of issue is met."""
    return V.review(*_sections(spark, sf_dir))


@query(_ISSUES + " SELECT c.doc_id, CAST(count(i.issue) AS BIGINT) AS n_issues, CASE WHEN count(i.issue) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM c LEFT JOIN i ON i.doc_id = c.doc_id GROUP BY c.doc_id")
def review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether anything is wrong."""
    spec, orig, parsed = _sections(spark, sf_dir)
    return V.status(orig, V.review(spec, orig, parsed))


def _wholes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Originals with their headings, and what was parsed of them, with one of eight faults by key."""
    d, c = _spread(_customers(spark, sf_dir)), F.col("c")
    k, pay = c % 8, F.concat(F.lit("대금은 "), (c % 90 + 10).cast("string"), F.lit("만원으로 하고 "), (c % 9 + 1).cast("string"), F.lit("개월 안에 나누어 낸다"))
    a = F.concat(F.repeat(F.lit("사업의 배경과 목적을 밝힌다 "), (c % 3 + 2).cast("int")), F.col("c_mktsegment"))
    e = F.concat(F.lit("일정은 "), F.col("c_name"), F.lit(" 담당자가 따로 정하여 알린다"))
    text = F.concat_ws("\n", F.lit("1. 개요"), a, F.lit(""), F.lit("2. 방안"), pay, F.lit(""), F.lit("3. 일정"), e)
    sec = lambda n, title, content: F.struct(F.lit(n).alias("ord"), F.lit(title).alias("title"), content.alias("content"))
    late = lambda n, m, title, content: F.struct(F.when(k == 5, m).otherwise(n).alias("ord"), F.lit(title).alias("title"), content.alias("content"))
    rows = F.array(
        F.when(k != 1, late(0, 2, "1. 개요", F.when(k == 2, F.concat(a, F.lit("\n2. 방안\n"), pay)).otherwise(a))),
        F.when(~k.isin(1, 2), sec(1, "2. 방안", F.when(k == 3, F.regexp_replace(pay, "만원", "억원")).when(k == 4, " . ").when(k == 7, F.concat(pay, F.lit("\n\n원문에는 없던 단락이 길게 "), F.lit("들어와 있다 "), F.col("c_name"))).otherwise(pay))),
        F.when(k != 1, late(2, 0, "3. 일정", F.when(k == 6, F.lit("없음")).otherwise(e))),
    )
    return d.select("doc_id", text.alias("text")), d.select("doc_id", F.inline(F.array_compact(rows)))


@query()
def whole_document_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review of documents as wholes, all rules; similarities are the matcher's, so a test holds it against the standard library."""
    return V.whole_review(*_wholes(spark, sf_dir), ["개요", "방안", "일정"])


@query("SELECT c_custkey AS doc_id, 1::INT AS k FROM customer WHERE c_custkey % 4 = 0")
def lost_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that parsing has lost."""
    d = _customers(spark, sf_dir)
    a, b = F.lit("첫 단락은 이러하고 이만큼의 길이를 가진다"), _say("둘째 단락 ", F.repeat(F.lit("라마바사 "), 6), F.col("c"))
    whole = F.concat(a, F.lit("\n\n"), b, F.lit("\n\n짧다"))
    return V.missing_blocks(d.select("doc_id", whole.alias("text")), d.select("doc_id", F.when(F.col("c") % 4 == 0, a).otherwise(whole).alias("text"))).select("doc_id", "k")


@query("SELECT c_custkey AS doc_id, 'A' AS code, round(CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.75 WHEN 2 THEN 0.5 ELSE 0.25 END, 4)::DOUBLE AS keyword_score, CASE c_custkey % 4 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS verdict FROM customer")
def keyword_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by the keywords they hold."""
    rules = spark.createDataFrame([("A", ["일", "이", "삼", "사"])], "code string, keywords array<string>")
    content = F.array_join(F.slice(F.array(*map(F.lit, "사삼이일")), 1, (4 - F.col("c") % 4).cast("int")), " ")
    return V.keyword_review(_customers(spark, sf_dir).select("doc_id", F.lit("A").alias("code"), content.alias("content")), rules)


@query("SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 5 = 0 THEN 'FAIL' ELSE CASE c_custkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'WARN' ELSE 'FAIL' END END AS status, round((c_custkey % 10) / 10.0::DOUBLE, 4) AS mean_similarity FROM customer")
def keyword_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their worst review, and the mean similarity."""
    d, c = _customers(spark, sf_dir), F.col("c")
    r = d.select("doc_id", F.when(c % 3 == 0, "PASS").when(c % 3 == 1, "WARN").otherwise("FAIL").alias("verdict"), ((c % 10) / 10.0).alias("similarity"))
    return V.keyword_status(r, d.where("c % 5 = 0"), d.where("false"))


_MAPPING = [("A", ["X", "Y"], True), ("B", ["Y", "Z", "X"], False), ("C", ["Z"], True)]


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    d, c = _customers(spark, sf_dir), F.col("c")
    full, blank = F.lit("가격 산정 기준과 절차를 정하여 성실히 이행하고 이를 모두 기록한다"), F.lit("짧음")
    sec = lambda code, content, found: F.struct(F.lit(code).alias("code"), content.alias("content"), found.alias("found"))
    anchor = F.when(c % 7 == 0, "전혀 다른 사업 이름").otherwise("가격 산정 기준")
    source = d.select(F.col("doc_id").alias("pair_id"), F.inline(F.array(sec("A", anchor, F.lit(True)), sec("B", full, c % 2 == 0), sec("C", full, F.lit(True)))))
    target = d.select(F.col("doc_id").alias("pair_id"), F.inline(F.array(sec("X", full, F.lit(True)), sec("Y", F.when(c % 3 == 0, blank).otherwise(full), F.lit(True)), sec("Z", full, c % 5 != 0))))
    return source, target, spark.createDataFrame(_MAPPING, "code string, targets array<string>, required boolean")


_COVER = """WITH c AS (SELECT c_custkey AS pair_id, c_custkey % 7 = 0 AS other, c_custkey % 3 <> 0 AS y, c_custkey % 5 <> 0 AS z, c_custkey % 2 = 0 AS b FROM customer),
m AS (SELECT pair_id, other, 'A' AS code, 2 AS w, (1 + CAST(y AS INT)) / 2.0::DOUBLE AS cov FROM c UNION ALL SELECT pair_id, other, 'B', 1, (1 + CAST(y AS INT) + CAST(z AS INT)) / 3.0::DOUBLE FROM c WHERE b UNION ALL SELECT pair_id, other, 'C', 2, CAST(z AS INT)::DOUBLE FROM c),
n AS (SELECT pair_id, code, w, CASE WHEN other THEN 0 ELSE cov END AS cov FROM m)"""


@query(_COVER + " SELECT pair_id, code, CAST(round_even(cov * 100, 0) AS INT) AS coverage_pct, CASE WHEN cov >= 1 THEN 'satisfied' WHEN cov > 0 THEN 'partial' ELSE 'unsatisfied' END AS verdict FROM n")
def compared_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source section is covered by the target's; other projects count nothing."""
    s, t, m = _pairs(spark, sf_dir)
    return V.compare(s, t, m, V.identity_scores(s, t, ["A"], []))[0].select("pair_id", "code", "coverage_pct", "verdict")


@query(_COVER + " SELECT pair_id, CAST(round_even(sum(w * cov) / sum(w) * 100, 0) AS INT) AS score, CAST(count(*) FILTER (WHERE cov >= 1) AS BIGINT) AS n_satisfied, CAST(count(*) FILTER (WHERE cov = 0) AS BIGINT) AS n_unsatisfied FROM n GROUP BY pair_id")
def compared_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted score of each pair."""
    s, t, m = _pairs(spark, sf_dir)
    return V.compare(s, t, m, V.identity_scores(s, t, ["A"], []))[1].select("pair_id", "score", "n_satisfied", "n_unsatisfied")


@query("""WITH c AS (SELECT c_custkey AS doc_id, c_mktsegment AS s, c_custkey % 4 AS k FROM customer)
SELECT doc_id, 'W1' AS code, CASE k WHEN 0 THEN '3. ' || s || ' 개요' WHEN 1 THEN s WHEN 2 THEN '나다라' || s END AS section, 1.0::DOUBLE AS score FROM c WHERE k < 3
UNION ALL SELECT doc_id, 'W2', '가나다라마바 ' || doc_id, round(2 * (6.0::DOUBLE + length(doc_id::VARCHAR)) / (14 + 2 * length(doc_id::VARCHAR)), 6) FROM c WHERE k < 3""")
def fuzzy_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section whose title fits best: one that holds the other wins at once, else the most similar one, none below the least."""
    d, k = _customers(spark, sf_dir), F.col("c") % 4
    own = F.when(k == 0, _say("3. ", F.col("c_mktsegment"), " 개요")).when(k == 1, F.col("c_mktsegment")).when(k == 2, _say("나다라", F.col("c_mktsegment")))
    like = F.when(k < 3, _say("가나다라마바 ", F.col("c")))
    sec = lambda n, t: F.struct(n.alias("ord"), t.alias("title"))
    titles = F.array(sec(F.lit(9), F.lit("하파타")), sec(k.cast("int"), own), sec((7 - k).cast("int"), like), sec(F.lit(8), F.when(k == 0, _say("둘째 ", F.col("c_mktsegment")))))
    sections = d.select("doc_id", F.inline(F.filter(titles, lambda x: x["title"].isNotNull())))
    asked = F.array(F.struct(F.lit("W1").alias("code"), F.col("c_mktsegment").alias("title")), F.struct(F.lit("W2").alias("code"), _say("가나다라마바사아", F.col("c")).alias("title")))
    out = K.fuzzy_titles(d.select("doc_id", F.inline(asked)), sections)
    return out.withColumn("score", F.round("score", 6))


# tables


@query("""WITH c AS (SELECT c_custkey AS c, c_custkey % 7 AS d, c_custkey % 2 AS r FROM customer WHERE c_custkey % 3 <> 0),
k AS (SELECT c, d, r, unnest(['item', '적용', '부분적용', '미적용', '해당없음', '사유', 'category']) AS key, unnest(range(7)) AS n FROM c)
SELECT c AS table_id, key, (n * (20 + d))::DOUBLE AS x0, (n * (20 + d) + 10)::DOUBLE AS x1, CAST(r + 1 AS INT) AS header_rows FROM k WHERE key <> 'category' OR c % 5 = 0""")
def checklist_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the columns of checklists stand: one or two header rows, widths by the row; tables without all headers aren't checklists."""
    c, step = F.col("c"), (20 + F.col("c") % 7).cast("double")
    cell = lambda r, n, t: F.struct(r.cast("int").alias("row"), F.lit(n).alias("col"), (step * n).alias("x0"), (step * n + 10).alias("x1"), (F.lit(t) if isinstance(t, str) else t).alias("text"))
    low = c % 2  # the second half of the headers stands in a row of its own, or not
    cells = F.array(
        cell(F.lit(0), 0, "항 목"), cell(F.lit(0), 1, "적용"), cell(F.lit(0), 2, "부분\n적용"), cell(low, 3, F.when(c % 3 == 0, "x").otherwise("미적용")), cell(low, 4, "해당 없음"), cell(low, 5, "사유 및 대체기술"),
        cell(F.lit(0), 6, F.when(c % 5 == 0, "구분").otherwise(_say("기타 ", c))), cell(F.lit(2), 1, "적용"), cell(F.lit(3), 3, "미적용"),
    )
    return B.header_zones(_customers(spark, sf_dir).select(F.col("doc_id").alias("table_id"), F.inline(cells)))


@query("""WITH c AS (SELECT c_custkey AS d, c_custkey % 4 AS n, c_mktsegment AS s, c_name AS m FROM customer)
SELECT d AS doc_id, 1::BIGINT AS grp, 'o 보안 ' || s || ' 계속 ' || d AS text, n > 0 AS is_intro FROM c UNION ALL SELECT d, 1 + i, '- 항목 ' || i || CASE WHEN i % 2 = 0 THEN ' 이어 ' || m ELSE '' END, false FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM c)
UNION ALL SELECT d, n + 2, 'o 단독', false FROM c UNION ALL SELECT d, n + 3, '멀리 ' || m, false FROM c""")
def checklist_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined to items, and titles of groups told from items; how many lines there are and how far apart follows the row."""
    c, n = F.col("c"), (F.col("c") % 4).cast("int")
    gap = (c % 6).cast("double")  # below what parts two groups
    line = lambda k, t: F.struct((k * (10 + gap)).alias("top"), (k * (10 + gap) + 10).alias("bottom"), t.alias("text"))
    steps = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    dashes = F.flatten(F.transform(steps, lambda i: F.when(i % 2 == 0, F.array(line(i * 2, _say("- 항목 ", i)), line(i * 2 + 1, _say("이어 ", F.col("c_name"))))).otherwise(F.array(line(i * 2, _say("- 항목 ", i))))))
    ends = F.array(line(F.lit(10), F.lit("o 단독")), line(F.lit(14), _say("멀리 ", F.col("c_name"))))
    rows = F.concat(F.array(line(F.lit(0), _say("o 보안 ", F.col("c_mktsegment"))), line(F.lit(1), _say("계속 ", c))), dashes, ends)
    return B.logical_lines(_customers(spark, sf_dir).select("doc_id", F.inline(rows)), ["doc_id"]).select("doc_id", "grp", "text", "is_intro")


@query("""SELECT o_custkey AS doc_id, CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE o_orderkey % 4 <> 3) AS BIGINT) AS error_count FROM orders GROUP BY o_custkey""")
def checklist_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked items of each document, and those that break a rule: no mark, two marks, a mark without its reason."""
    k = F.col("o_orderkey") % 4
    marks = F.map_from_arrays(F.array(F.lit("적용"), F.lit("미적용")), F.array(k == 1, k >= 1))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), marks.alias("checked"), F.when(k == 3, "대체").otherwise(" ").alias("reason"))
    o = o.withColumn("checked", F.when(F.col("item_id") % 4 == 1, F.map_from_arrays(F.array(F.lit("적용"), F.lit("미적용")), F.array(F.lit(True), F.lit(True)))).otherwise(F.col("checked")))
    checked = V.check_marks(o, ["부분적용", "미적용"])
    return B.check_totals(checked.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("doc_id")), "item_id"), "doc_id")


@query("SELECT c_custkey AS doc_id, 0::INT AS page, '주소' AS label FROM customer WHERE c_custkey % 2 = 0")
def blank_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels whose value is blank."""
    cells = _customers(spark, sf_dir).select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("tbl"), F.lit(0).alias("row"), F.array(F.lit("성명"), F.lit("김"), F.lit(" 주소 "), F.when(F.col("c") % 2 == 0, " ").otherwise("서울"), F.lit("비고"), F.lit("")).alias("values"))
    return V.blank_fields(cells, ["비고"]).select("doc_id", "page", "label")


@query(stated("""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, l_returnflag AS f, CAST(l_quantity AS INT) AS q, l_suppkey AS s FROM order_lines),
d AS (SELECT *, sum(CASE WHEN q % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS k FROM b),
h AS (SELECT doc_id, k, DATE '2025-01-01' + (q - 1) AS due_date, CASE WHEN q % 2 = 0 THEN (q % 4 + 1) || '부' END AS copies, CASE WHEN f = 'O' THEN 'PDF 파일' END AS doc_form, CASE f WHEN 'F' THEN '착수' WHEN 'O' THEN '완료' ELSE '중간' END || n AS name FROM d WHERE q % 3 <> 0 AND k > 0),
t AS (SELECT doc_id, k, string_agg('계속' || s || '보고서', '' ORDER BY n) AS more FROM d WHERE q % 3 = 0 AND k > 0 GROUP BY ALL)
SELECT h.doc_id, CAST(h.k AS BIGINT) AS k, name || coalesce(more, '') AS raw_name, due_date, copies, doc_form, CASE WHEN starts_with(name, '착수') THEN 'kickoff' WHEN starts_with(name, '완료') THEN 'final' END AS matched_type
FROM h LEFT JOIN t ON t.doc_id = h.doc_id AND t.k = h.k"""))
def deliverable_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliverables of plans' tables: a row with a date begins one, rows without go on with its name; cells are stripped."""
    name = F.concat(F.when(flag() == "F", "착수").when(flag() == "O", "완료").otherwise("중간"), number().cast("string"))
    day = F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), quantity() - 1), "yyyy. M. d")
    dated = F.array(F.concat(F.lit(" "), name, F.lit("  ")), F.concat(day, F.lit(" 까지")), F.when(quantity() % 2 == 0, _say(quantity() % 4 + 1, "부")), F.when(flag() == "O", F.lit("PDF 파일")))
    more = F.array(F.lit(""), _say(" 계속", supplier(), "보고서 "))
    rows = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), number().alias("row"), F.when(quantity() % 3 != 0, dated).otherwise(more).alias("cells"))
    return B.deliverable_plan(rows, [("kickoff", ["착수"]), ("final", ["완료"])])


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) FILTER (WHERE value > 80) AS new FROM events GROUP BY ALL) SELECT user_id || event_type AS kind, CASE WHEN user_id % 3 = 0 THEN DATE '2024-01-01' ELSE CASE WHEN new IS NOT NULL THEN DATE '2024-02-02' END END AS due,
CASE WHEN user_id % 3 = 0 THEN 'skipped' WHEN new IS NOT NULL THEN 'updated' ELSE 'not_found' END AS result FROM f""")
def due_date_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due dates filled in where there are none, never overwritten."""
    e = table(spark, sf_dir, "events").withColumn("kind", _say(F.col("user_id"), F.col("event_type")))
    old = e.select("kind", "user_id").distinct().select("kind", F.when(F.col("user_id") % 3 == 0, F.lit("2024-01-01").cast("date")).alias("due"))
    return V.sync_due_dates(old, e.where("value > 80").select("kind", F.lit("2024-02-02").cast("date").alias("due"), F.col("event_id").alias("ord")))


@query("""WITH e AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM events) SELECT user_id, CAST(grp AS BIGINT) AS grp, md5(string_agg(event_type, '' ORDER BY event_id)) AS text FROM e WHERE grp > 0 GROUP BY user_id, grp""")
def continued_row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a date joined to the dated one before them."""
    out = V.continued_rows(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", "event_type")
    return out.select("user_id", "grp", F.md5("event_type").alias("text"))


# retrieval


_RERANK = f"""WITH {_BASE}, fetched AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused),
rer AS (SELECT f.query_id, f.chunk_id, es.score, row_number() OVER (PARTITION BY f.query_id ORDER BY es.score DESC, f.chunk_id) AS rank FROM fetched f JOIN es USING (query_id, chunk_id) WHERE f.rank <= 10)"""


@query(_RERANK + " SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM rer WHERE rank <= 2")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms fused, the ten best scored anew by a fixed rule (distance), the two best kept."""
    q, c, dense, sparse = _arms(spark, sf_dir)
    scores = R.pair_scores(R.top_k(R.rrf(dense, sparse), 50), q, c, "euclidean").withColumnRenamed("score", "rerank_score")
    return R.search_articles(dense, sparse, scores, fetch_k=50, rerank_k=10, top=2).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_BASE}, edges AS (SELECT vec_id AS src, vec_id + 7 AS dst FROM embeddings), h AS (SELECT query_id, dst AS chunk_id, max(score) AS score FROM top JOIN edges ON chunk_id = src GROUP BY query_id, dst),
x AS (SELECT query_id, chunk_id, score, false AS is_cross_ref FROM top UNION ALL SELECT query_id, chunk_id, score, true FROM h WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.query_id = h.query_id AND t.chunk_id = h.chunk_id)),
p AS (SELECT query_id, chunk_id // 4 AS parent_id, min(is_cross_ref) AS is_cross_ref, arg_max(score, (NOT is_cross_ref, score)) AS score FROM x WHERE chunk_id IN (SELECT vec_id FROM embeddings) GROUP BY ALL)
SELECT query_id, parent_id, score, is_cross_ref, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS INT) AS rank FROM p""")
def item_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found, expanded along references and replaced by their articles within a wide budget."""
    e = table(spark, sf_dir, "embeddings").select("vec_id")
    edges = e.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 7).alias("dst"))
    parent = F.floor(F.col("vec_id") / 4)
    parent_of = e.select(F.col("vec_id").alias("chunk_id"), parent.alias("parent_id"))
    _, _, dense, sparse = _arms(spark, sf_dir)
    found = R.top_k(R.rrf(dense, sparse), 10)
    out = R.search_items(found, edges, parent_of, e.select(parent.alias("parent_id")).distinct().withColumn("size", F.lit(10)), 1_000_000, 1_000)
    return out.select("query_id", "parent_id", "score", "is_cross_ref", "rank")


@query(f"""WITH {_BASE}, p AS (SELECT DISTINCT query_id, label FROM others JOIN c USING (chunk_id)) SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(p.label) AS BIGINT) AS survived, round(count(p.label) / count(*)::DOUBLE, 6) AS recall FROM q LEFT JOIN p ON p.query_id = q.query_id AND p.label = q.qlabel""")
def first_stage_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries whose label is among those of the first stage."""
    q, c, dense, sparse = _arms(spark, sf_dir)
    found = R.top_k(R.rrf(dense, sparse).where("query_id <> chunk_id"), 10).join(c.select("chunk_id", "label"), "chunk_id").select("query_id", "label").distinct()
    return R.stage_recall(found, q.select("query_id", F.col("qlabel").alias("label")), "label")


@query(f"WITH {_BASE}, r AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense JOIN c USING (chunk_id) WHERE score >= 0.2 AND label % 2 = 0) SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def flagged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with a flag and a least score."""
    _, c, dense, _ = _arms(spark, sf_dir)
    return R.risk_search(dense, c.where("label % 2 = 0"), 0.2, 10)


@query(f"""WITH {_BASE}, j AS (SELECT d.score, (q.qlabel = c.label) AS hit FROM dense d JOIN q USING (query_id) JOIN c USING (chunk_id) WHERE chunk_id <> query_id), t AS (SELECT quantile_cont(score, 0.1) FILTER (WHERE hit) AS a, quantile_cont(score, 0.9) FILTER (WHERE NOT hit) AS b FROM j)
SELECT round(a, 6) AS p10_relevant, round(b, 6) AS p90_other, round((a + b) / 2, 6) AS threshold FROM t""")
def recommended_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score halfway between hits and others."""
    q, c, dense, _ = _arms(spark, sf_dir)
    j = dense.where("query_id <> chunk_id").join(q.select("query_id", "qlabel"), "query_id").join(c.select("chunk_id", "label"), "chunk_id")
    return R.recommended_threshold(j.select("score", (F.col("qlabel") == F.col("label")).alias("hit")))


@query("""WITH m AS (SELECT o_orderkey, (o_orderkey + o_custkey) % 6 AS k, o_orderstatus AS s, CASE WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS w FROM orders)
SELECT o_orderkey, CASE WHEN k = 0 THEN 'correct' WHEN k = 1 THEN 'pushed_down' WHEN k IN (2, 3) THEN 'unknown_category' WHEN s <> w THEN 'wrong_law' ELSE 'lost' END AS kind FROM m""")
def miss_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries by the five kinds of result."""
    k = (F.col("o_orderkey") + F.col("o_custkey")) % 6
    first = F.when(k == 0, 1).when(k == 1, (2 + F.col("o_custkey") % 5).cast("int"))
    own = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")
    wanted = F.when(k == 2, F.array(F.lit(""), F.lit(None).cast("string"))).otherwise(F.array(own, F.lit("")))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.miss_kind(first, wanted, F.when(k != 3, F.col("o_orderstatus"))).alias("kind"))


# smaller ones


@query("SELECT quality, toxic, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY ALL")
def judgement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two judges give which pair."""
    return table(spark, sf_dir, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT conv_id, CAST(count(*) AS BIGINT) AS copies FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur more than once."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("copies")).where("copies > 1")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT user_id, CAST(count(*) FILTER (WHERE value < 20) AS BIGINT) AS unread, string_agg(event_id, ',' ORDER BY n) FILTER (WHERE n <= 5) AS latest FROM e GROUP BY user_id""")
def unread_and_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unread messages, and the five latest ones."""
    e = table(spark, sf_dir, "events")
    top = O.latest(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "event_id"))), lambda x: x["event_id"].cast("string")), ",")
    return e.groupBy("user_id").agg(F.count_if(F.col("value") < 20).alias("unread")).join(top.groupBy("user_id").agg(ids.alias("latest")), "user_id")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 4 = 0 THEN 'S' ELSE c_mktsegment END AS segment FROM customer")
def partial_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields given replace old ones, others stay."""
    c = table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 3 = 0 or c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, _say("new ", F.col("c_custkey"))).alias("n"), F.when(F.col("c_custkey") % 4 == 0, "S").alias("s"))
    return c.join(new, "c_custkey", "left").select("c_custkey", F.coalesce("n", "c_name").alias("name"), F.coalesce("s", "c_mktsegment").alias("segment"))


@query("SELECT user_id, count(DISTINCT event_type) FILTER (WHERE event_type IN ('click', 'view') AND value > 60) = 2 AS covered FROM events GROUP BY user_id")
def subset_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all of a set is there."""
    have = F.collect_set(F.when(F.col("value") > 60, F.col("event_type")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.size(F.array_except(F.array(F.lit("click"), F.lit("view")), have)) == 0).alias("covered"))


@query("""WITH s AS (SELECT doc_id, length(text) // 7 % 5 AS n, n_chars % 3 AS r FROM documents), w AS (SELECT *, (n * 2.0::DOUBLE) / (n * 2 + r * 2) AS same FROM s WHERE n + r > 0)
SELECT s.doc_id % 50 AS grp, CAST(count(*) AS BIGINT) AS n, round(coalesce(avg(same), 0), 6) AS mean FROM s LEFT JOIN w USING (doc_id) GROUP BY 1""")
def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarities by the matcher, 0 where nothing is compared: texts share a run of one letter and differ in the rest."""
    n, r = F.floor(F.length("text") / 7) % 5, F.col("n_chars") % 3
    run = F.repeat(F.lit("가"), n.cast("int"))
    a, b = F.concat(run, F.repeat(F.lit("나"), r.cast("int"))), F.concat(run, F.repeat(F.lit("다"), r.cast("int")))
    t = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("grp"), F.when(n + r > 0, S.ratio(a, b)).alias("s"))
    return t.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("s"), F.lit(0.0)), 6).alias("mean"))


@query("""SELECT doc_id, CASE WHEN n_chars < 80 THEN 'missing_field' WHEN lang NOT IN ('en', 'fr', 'de') THEN 'label' WHEN contains(text, '&&&') THEN 'forbidden' END AS reason FROM documents""")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that each variant fails."""
    why = D.reject_reason((F.col("n_chars") < 80, "missing_field"), (~F.col("lang").isin("en", "fr", "de"), "label"), (F.col("text").contains("&&&"), "forbidden"))
    return table(spark, sf_dir, "documents").select("doc_id", why.alias("reason"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS token FROM documents), w AS (SELECT doc_id, token, sqrt(count(*)) AS weight FROM t GROUP BY ALL),
s AS (SELECT q.doc_id AS query_id, c.doc_id AS chunk_id, round(sum(q.weight * c.weight), 6) AS score FROM w q JOIN w c USING (token) WHERE q.doc_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10""")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by token weights (roots of counts): documents whose id is divisible by 50 against all."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), 0)).alias("token")
    w = table(spark, sf_dir, "documents").select("doc_id", words).groupBy("doc_id", "token").agg(F.sqrt(F.count("*")).alias("weight"))
    return R.sparse_arm(w.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id"), w.withColumnRenamed("doc_id", "chunk_id"), 10)


@query("""SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'label' WHEN 1 THEN 'label_changed' WHEN 2 THEN 'criteria_changed' WHEN 3 THEN 'no_judgements' WHEN 4 THEN 'outside:속도' WHEN 5 THEN 'exactness_to_review' WHEN 6 THEN 'verdicts_differ' WHEN 7 THEN 'ungrounded_number' END AS reason FROM orders""")
def variant_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why variants of seeds are refused."""
    k, arr = F.col("o_orderkey") % 9, lambda *x: F.array(*map(F.lit, x))
    old = arr("정확성: 충족 — 3개월 안에", "명료성: 불가 — 없음")
    evals = (
        F.when(k == 3, F.slice(old, 1, 0)).when(k == 4, arr("정확성: 충족 — 3개월", "속도: 충족")).when(k == 5, arr("정확성: 검토 — 3개월", "명료성: 불가")).when(k == 6, arr("정확성: 충족", "명료성: 충족"))
        .when(k == 7, arr("정확성: 충족 — 5개월 안에", "명료성: 불가 — 없음")).otherwise(old)
    )
    why = D.variant_reason(
        F.when(k == 0, "모름").when(k == 1, "불가").otherwise("충족"), F.lit("충족"), F.when(k == 2, arr("정확성")).otherwise(arr("명료성", "정확성")), arr("정확성", "명료성"), evals, old, F.lit("계약 뒤 3개월 안에 낸다"),
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", why.alias("reason"))


@query("""WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN regexp_matches(c, '^\\s$') THEN NULL ELSE i END), lambda x: x IS NOT NULL) AS p FROM documents)
SELECT doc_id, CAST(len(p) AS INT) AS n, CAST(coalesce(p[1], 0) AS INT) AS first_place, CAST(coalesce(p[-1], 0) AS INT) AS last_place, CAST(list_sum(p) AS BIGINT) AS places FROM c""")
def squeezed_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the characters of squeezed texts stand in the original."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.squeeze_map(F.col("text")).alias("p"))
    first = lambda k: F.coalesce(F.try_element_at("p", F.lit(k)), F.lit(0))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x)
    return d.select("doc_id", F.size("p").alias("n"), first(1).alias("first_place"), first(-1).alias("last_place"), F.nullif(total, F.lit(0)).alias("places"))


@query("""WITH k AS (SELECT o_orderkey, ((o_orderkey * 37 + o_custkey) % 121 - 20) / 100.0::DOUBLE AS v FROM orders)
SELECT o_orderkey, CASE WHEN v < 0 THEN 'poor' WHEN v <= 0.2 THEN 'slight' WHEN v <= 0.4 THEN 'fair' WHEN v <= 0.6 THEN 'moderate' WHEN v <= 0.8 THEN 'substantial' ELSE 'almost perfect' END AS band FROM k""")
def agreement_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for agreements from below zero to one, in steps of a hundredth."""
    value = ((F.col("o_orderkey") * 37 + F.col("o_custkey")) % 121 - 20) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", M.kappa_band(value).alias("band"))
