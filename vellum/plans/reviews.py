"""Queries on verdicts, training sets and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import datasets as D
from ..operators import phrases as H
from ..operators import verdicts as V
from .documents import _say
from .registry import query, table

_PRED = "CASE o_orderkey % 5 WHEN 0 THEN '판정: 일치' || chr(10) || '근거: 없음' WHEN 1 THEN '판정:불일치' || chr(10) || '유형: 금액' || chr(10) || '근거: 제' || o_custkey || '조' WHEN 2 THEN '' WHEN 3 THEN '위험해 보임 ' || o_custkey ELSE ' 판정: 충족됨 ' END"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item of a review for each order: a customer's clause with a prediction in one of five forms."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 5
    said = (
        F.when(key == 0, "판정: 일치\n근거: 없음").when(key == 1, _say("판정:불일치\n유형: 금액\n근거: 제", F.col("o_custkey"), "조")).when(key == 2, "")
        .when(key == 3, _say("위험해 보임 ", F.col("o_custkey"))).otherwise(" 판정: 충족됨 ")
    )
    names = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("손해"), F.lit("지체"))).otherwise(F.array().cast("array<string>"))
    return o.select(F.col("o_custkey").alias("doc_id"), "o_orderkey", _say("제", F.col("o_orderkey") % 4, "조").alias("clause_number"), F.col("o_orderpriority").alias("clause_text"), names.alias("risk_names"), said.alias("prediction"))


@query(f"""WITH i AS (SELECT o_custkey AS doc_id, o_orderkey, '제' || o_orderkey % 4 || '조' AS location, o_orderpriority AS original_text, CASE WHEN o_orderstatus = 'F' THEN '손해, 지체' ELSE '위험 조항 감지' END AS issue, trim({_PRED}) AS legal_ref FROM orders WHERE o_orderkey % 5 NOT IN (0, 2))
SELECT doc_id, location, original_text, issue, legal_ref FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, location ORDER BY o_orderkey) AS r FROM i) WHERE r = 1""")
def review_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each clause whose verdict isn't a sound one."""
    return V.review_issues(_items(spark, sf_dir), [F.col("o_orderkey")])


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '일치' WHEN 1 THEN '불일치' WHEN 4 THEN '충족됨' ELSE '' END AS verdict, CASE o_orderkey % 5 WHEN 1 THEN '금액' ELSE '' END AS kind,
CASE o_orderkey % 5 WHEN 0 THEN '없음' WHEN 1 THEN '제' || o_custkey || '조' WHEN 2 THEN '' WHEN 3 THEN '위험해 보임 ' || o_custkey ELSE ' 판정: 충족됨 ' END AS basis FROM orders""")
def stored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict, kind and basis of stored predictions."""
    return _items(spark, sf_dir).select("o_orderkey", V.reading(F.col("prediction")).alias("x")).select("o_orderkey", "x.*")


@query("SELECT l_orderkey, max(coalesce(CASE WHEN l_linenumber <> 3 THEN l_discount * 10 END, 0)) >= 0.8 AS relevant FROM lineitem GROUP BY l_orderkey")
def relevant_reference_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with at least one reference that scores high enough."""
    refs = F.collect_list(F.struct(F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10).alias("score")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(refs.alias("refs")).select("l_orderkey", V.has_relevant(F.col("refs")).alias("relevant"))


@query("""SELECT user_id AS doc_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS INT) AS n_error, CAST(count(*) FILTER (WHERE event_type = 'view') AS INT) AS n_view,
CAST(count(*) FILTER (WHERE event_type IN ('error', 'view')) AS INT) AS n_issues FROM events GROUP BY user_id""")
def issue_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a report's issue lists."""
    ids = lambda t: F.collect_list(F.when(F.col("event_type") == t, F.col("event_id"))).alias(t)
    return V.issue_counts(table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(ids("error"), ids("view")), ["error", "view"])


@query("SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_error, CAST(count(*) FILTER (WHERE event_type = 'view') AS BIGINT) AS n_view, CAST(count(*) FILTER (WHERE event_type = 'click') AS BIGINT) AS n_click FROM events GROUP BY user_id")
def level_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues by level."""
    return V.level_tally(table(spark, sf_dir, "events"), "user_id", "event_type", ["error", "view", "click"])


@query("""SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS issue_count, CAST(count(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS BIGINT) AS blocking_issue_count, CAST(count(o_orderkey) FILTER (WHERE o_orderstatus <> 'P') AS BIGINT) AS info_issue_count
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def rule_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with the counts of their issues."""
    issues = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "P", "blocking").otherwise("info").alias("severity"))
    return V.rule_payload(table(spark, sf_dir, "customer").select("c_custkey"), issues, "c_custkey")


@query("SELECT o_orderkey, '[' || o_orderstatus || '] ' || CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE CAST(o_custkey AS VARCHAR) END || ' / ' || o_orderpriority || ': ' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'x' END AS line FROM orders")
def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues as lines of text."""
    o = table(spark, sf_dir, "orders")
    code = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", V.issue_line(F.col("o_orderstatus"), code, F.col("o_orderpriority"), F.when(F.col("o_orderkey") % 2 == 1, "x")).alias("line"))


@query("SELECT doc_id, array_to_string(list_filter(['lorem', 'the', 'and', 'zzz'], lambda x: NOT contains(coalesce(text, ''), x)), ',') AS missing FROM documents")
def missing_structure_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected words that a text lacks."""
    items = F.array(*map(F.lit, ("lorem", "the", "and", "", "zzz")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(V.missing_items(F.col("text"), items), ",").alias("missing"))


@query("""WITH t AS (SELECT page_id, lower(url || ' ' || substr(html, 1, 2000)) AS h FROM pages)
SELECT page_id, CASE WHEN contains(h, 'rfp') THEN 'rfp' WHEN contains(h, 'pep') THEN 'pep' WHEN contains(h, 'rpt') THEN 'rpt' END AS kind FROM t""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of a document by the first sign of one."""
    return table(spark, sf_dir, "pages").select("page_id", V.document_type(F.col("url"), F.col("html"), F.lit(None)).alias("kind"))


@query("SELECT o_orderkey, 'PEP-' || o_custkey || '-' || o_orderstatus AS code, lower('pep_' || o_custkey || '_' || o_orderstatus) AS section_id FROM orders")
def section_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of sections as codes, and back."""
    code = V.section_code(_say("pep_", F.col("o_custkey"), "_", F.col("o_orderstatus")))
    return table(spark, sf_dir, "orders").select("o_orderkey", code.alias("code")).withColumn("section_id", V.section_id(F.col("code")))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '본문 ' || o_custkey WHEN 1 THEN o_orderpriority || chr(10) || o_custkey ELSE '글 그대로 ' || o_custkey END AS content FROM orders""")
def flat_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents given as a text, a JSON string or an object of texts."""
    key = F.col("o_orderkey") % 3
    raw = F.when(key == 0, _say('"본문 ', F.col("o_custkey"), '"')).when(key == 1, F.to_json(F.struct(F.col("o_orderpriority").alias("pep_excerpt"), F.col("o_custkey").cast("string").alias("extra")))).otherwise(_say("글 그대로 ", F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.flat_content(raw).alias("content"))


@query("SELECT trim(split_part(text, chr(10), 1)) AS verdict, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY 1")
def response_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines of responses by frequency."""
    return V.response_verdicts(table(spark, sf_dir, "conversations"), "text")


@query("""SELECT o_orderkey, 0::INT AS k, '전자 결재 ' || o_custkey || '번' AS phrase FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT o_orderkey, 1, '통계 화면 ' || o_orderkey FROM orders""")
def missing_requirement_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of a requirement that the parsed text lost."""
    original = _say("시스템은 전자 결재 ", F.col("o_custkey"), "번 기능을 제공하여야 한다 통계 화면 ", F.col("o_orderkey"), "을, 보고서를 출력 및 자료 관리한다를 최소화한다")
    parsed = _say(F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(_say("전자 결재는 ", F.col("o_custkey"), "번 ")), "보고서를 출력 자료 관리한다")
    pairs = table(spark, sf_dir, "orders").select("o_orderkey", original.alias("original"), parsed.alias("parsed"))
    return H.missing_phrases(pairs, "o_orderkey", "original", "parsed")


@query("""SELECT o_orderkey, list_concat(['재고 ' || o_custkey || '번 현황', '발주 ' || o_orderkey || '건', '반품 처리', '창고 점검'], CASE o_orderkey % 3 WHEN 0 THEN [repeat('가나', 22) || '가...'] WHEN 1 THEN ['장비 ' || o_custkey] ELSE [] END)::VARCHAR AS items FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, ['다.' || o_custkey % 10 || '.라']::VARCHAR FROM orders WHERE o_orderkey % 7 = 0""")
def wrong_content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a wrong content names: its phrases without their frames, long ones cut; the text itself where it names nothing."""
    key = F.col("o_orderkey")
    more = F.when(key % 3 == 0, _say(". ", F.repeat(F.lit("가나"), 30))).when(key % 3 == 1, _say(" 기능을 제공하여야 한다 서버 장비는 장비 ", F.col("o_custkey"), "을 설치한다")).otherwise("")
    text = _say("시스템은 재고 ", F.col("o_custkey"), "번 현황을 분석하고 발주 ", key, "건 및  반품을 처리하여 창고 점검을 수행한다", more)
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(key % 7 == 0, _say("다.", F.col("o_custkey") % 10, ".라")).otherwise(text).alias("text"))
    return o.select("o_orderkey", F.concat(F.lit("["), F.array_join(H.named_items(F.col("text")), ", "), F.lit("]")).alias("items"))


# training sets


@query("SELECT o_orderkey, o_custkey || '개월,' || o_custkey || ' %,4/06' || CASE WHEN o_orderkey % 2 = 0 THEN ',3/4' ELSE '' END AS found FROM orders")
def unit_number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with units, and ratios; a date before a slash is left out but for its last digit, as the rule has it."""
    text = _say(F.col("o_custkey"), "개월 뒤 ", F.col("o_custkey"), " %와 2025.02.14/06.20 ", F.when(F.col("o_orderkey") % 2 == 0, "3/4").otherwise(""))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(D.unit_numbers(text), ",").alias("found"))


@query("SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n, CASE WHEN o_orderkey % 4 <> 3 THEN o_custkey END AS first_id FROM orders")
def unwrapped_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists out of JSON in three shapes."""
    key, item = F.col("o_orderkey") % 4, _say('{"id": ', F.col("o_custkey"), "}")
    raw = F.when(key == 0, F.concat(F.lit("["), item, F.lit(","), item, F.lit("]"))).when(key == 1, F.concat(F.lit('{"note": "x", "results": ['), item, F.lit(","), item, F.lit("]}"))).when(key == 2, item).otherwise("")
    own = table(spark, sf_dir, "orders").select("o_orderkey", D.unwrap_array(raw, "struct<id: bigint>").alias("x"))
    return own.select("o_orderkey", F.size("x").alias("n"), F.get("x", F.lit(0))["id"].alias("first_id"))


@query("SELECT o_orderkey, o_orderstatus AS exactness, '불가' AS clarity, CASE WHEN o_orderkey % 2 = 0 THEN '근거 ' || o_custkey ELSE '' END AS reason FROM orders")
def eval_line_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements by feature out of lines, with a reason."""
    last = _say("정확성: ", F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, _say(" — 근거 ", F.col("o_custkey"))).otherwise(""))
    lines = F.array(F.lit("정확성: 검토"), F.lit("명료성 : 불가 — 이유: 둘"), F.lit("줄글"), last)
    m = D.eval_map(lines)
    return table(spark, sf_dir, "orders").select("o_orderkey", m["정확성"].alias("exactness"), m["명료성"].alias("clarity"), D.eval_reason(last).alias("reason"))


@query("SELECT doc_id, ('0x' || substr(md5('0:doc_' || doc_id), 1, 15))::BIGINT AS point_id FROM documents")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for text ids."""
    return table(spark, sf_dir, "documents").select("doc_id", D.point_id(_say("doc_", F.col("doc_id"))).alias("point_id"))


@query("SELECT event_id, CASE WHEN ('0x' || substr(md5('42:' || event_id), 1, 15))::BIGINT % 1000000 < 900000 THEN 'train' ELSE 'valid' END AS split FROM events")
def hash_share_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split of nine to one by hash."""
    return D.share_split(table(spark, sf_dir, "events"), "event_id", 0.9).select("event_id", "split")


@query("""WITH r AS (SELECT CASE WHEN quality = 0 THEN '불가' ELSE '충족' END AS g, CASE WHEN toxic = 1 THEN '불가' ELSE '충족' END AS p, lang AS gk, source AS pk, CASE WHEN doc_id % 3 = 0 THEN '-' ELSE 'rule ' || doc_id % 10 END AS gb, CASE WHEN doc_id % 4 <> 0 THEN 'see ' || doc_id % 7 END AS pb FROM labels JOIN documents USING (doc_id))
SELECT CAST(count(*) FILTER (WHERE g = '불가' AND p = g) AS BIGINT) AS n_right, round(avg(CASE WHEN g = '불가' AND p = g THEN CASE WHEN gk = pk THEN 1.0::DOUBLE ELSE 0 END END), 6) AS kind_accuracy, CAST(count(*) FILTER (WHERE gb <> '-') AS BIGINT) AS n_evidence,
round(avg(CASE WHEN gb <> '-' THEN CASE WHEN contains(coalesce(pb, ''), 'rule') OR contains(coalesce(pb, ''), split_part(gb, ' ', 2)) THEN 1.0::DOUBLE ELSE 0 END END), 6) AS evidence_rate, round(avg(CASE WHEN pb IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS format_rate FROM r""")
def verdict_field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields right where a negative verdict was, evidence found, answers whole."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    r = j.select(
        F.when(F.col("quality") == 0, "불가").otherwise("충족").alias("gold_verdict"), F.when(F.col("toxic") == 1, "불가").otherwise("충족").alias("pred_verdict"),
        F.col("lang").alias("gold_kind"), F.col("source").alias("pred_kind"), F.when(F.col("doc_id") % 3 == 0, "-").otherwise(_say("rule ", F.col("doc_id") % 10)).alias("gold_basis"),
        F.when(F.col("doc_id") % 4 != 0, _say("see ", F.col("doc_id") % 7)).alias("pred_basis"),
    )
    return D.field_accuracy(r, ["불가"], ["kind"], ["verdict", "basis"])


@query("SELECT CAST(max(length(text)) AS INT) AS longest, CAST(count(*) FILTER (WHERE length(text) > 500) AS BIGINT) AS n_over FROM conversations")
def example_length_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest example and those over a limit."""
    return D.length_limits(table(spark, sf_dir, "conversations"), F.length("text"), 500)


@query("SELECT arg_min(event_id, (value, event_id)) AS best_step, min(value) AS best_loss FROM events")
def best_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The step with the least loss."""
    return D.best_checkpoint(table(spark, sf_dir, "events"), "event_id", "value")


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY source, lang")
def task_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by split."""
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT doc_id, text, md5('42:' || doc_id) AS o FROM documents WHERE length(text) >= 80 ORDER BY o, doc_id LIMIT 200)
SELECT 'eval_' || lpad(CAST(row_number() OVER (ORDER BY o, doc_id) AS VARCHAR), 3, '0') AS query_id, ['what rule is this?', 'find the passage:'][('0x' || substr(md5('43:' || doc_id), 1, 15))::BIGINT % 2 + 1] || chr(10) || chr(10) || substr(text, 1, 120) AS query, doc_id AS relevant FROM p""")
def synthetic_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two hundred questions made of texts: each begins with a template and the front of a text that is long enough."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return D.synthetic_queries(d, ["what rule is this?", "find the passage:"], 200)


@query("""WITH n AS (SELECT doc_id, text, lang, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT CAST(i // 8 AS BIGINT) AS batch, doc_id, md5(to_json({'lang': lang, 'n_chars': (SELECT n_chars FROM documents d WHERE d.doc_id = n.doc_id)})) AS payload FROM n""")
def judge_payload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What judges see, in batches of eight."""
    return D.judge_batches(table(spark, sf_dir, "documents"), "doc_id", ["lang", "n_chars"], 8).select("batch", "doc_id", F.md5("payload").alias("payload"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS s FROM orders), v AS (SELECT k, c, CASE WHEN k % 6 = 0 THEN '불가' ELSE CASE s WHEN 'F' THEN '충족' WHEN 'O' THEN '불가' ELSE '검토' END END AS verdict FROM o WHERE k % 6 IN (0, 1, 2, 3))
SELECT k::VARCHAR AS id, verdict, '근거 ' || c AS reason, true AS is_valid FROM v WHERE verdict <> '검토' UNION ALL SELECT k::VARCHAR, NULL, NULL, false FROM o WHERE k % 6 IN (4, 5) OR (k % 6 <> 0 AND s NOT IN ('F', 'O'))""")
def valid_verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges' answers in several shapes: those with a valid verdict on an item that was asked, and the items left without."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    said = F.when(F.col("o_orderstatus") == "F", "충족").when(F.col("o_orderstatus") == "O", "불가").otherwise("검토")
    item = lambda i, v: _say('{"id": "', i, '", "판정": "', v, '", "이유": "근거 ', c, '"}')
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("["), item(k, said), F.lit(", "), item(k, F.lit("불가")), F.lit("]")))  # the later one counts
        .when(k % 6 == 1, F.concat(F.lit("["), item(k + 100_000_000, F.lit("충족")), F.lit(", "), item(k, said), F.lit("]")))  # nobody asked for the first
        .when(k % 6 == 2, F.concat(F.lit('{"results": ['), item(k, said), F.lit("]}"))).when(k % 6 == 3, item(k, said)).when(k % 6 == 4, "[not JSON")
    )
    o = table(spark, sf_dir, "orders")
    kept, rest = D.judged(o.select(k.alias("batch"), raw.alias("raw")), o.select(k.alias("id")), ["충족", "불가"])
    none = F.lit(None).cast("string")
    return kept.withColumn("is_valid", F.lit(True)).unionByName(rest.select("id", none.alias("verdict"), none.alias("reason"), F.lit(False).alias("is_valid")))


@query("""SELECT lang AS task, CASE WHEN coalesce(avg(quality) FILTER (WHERE doc_id % 2 = 0), 0) >= coalesce(avg(quality) FILTER (WHERE doc_id % 2 = 1), 0) THEN 'even' ELSE 'odd' END AS winner FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def judge_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judge that agrees more, the first of equal ones."""
    j = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("task")), "doc_id")
    odd = F.col("doc_id") % 2
    k = j.groupBy("task", odd.cast("int").alias("ord"), F.when(odd == 0, "even").otherwise("odd").alias("judge")).agg(F.avg("quality").alias("kappa"))
    return D.better_judge(k)


@query("SELECT doc_id, quality, toxic FROM labels WHERE quality = 0 AND toxic = 0")
def wrong_case_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one class that were judged wrongly."""
    return table(spark, sf_dir, "labels").where("quality = 0 and toxic = 0").select("doc_id", "quality", "toxic")


@query("""WITH g AS (SELECT lang AS label, doc_id, n_chars > 300 AS ok, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS made FROM documents), t AS (SELECT * FROM (VALUES ('en', 20, 2.0::DOUBLE), ('fr', 1000000, 2.0), ('de', 5, 1.0)) v(label, target, over)),
k AS (SELECT label, doc_id, ok, target, row_number() OVER (PARTITION BY label ORDER BY doc_id) AS nth FROM g JOIN t USING (label) WHERE made <= floor(target * over) AND ok)
SELECT label, doc_id, ok, CAST(nth AS INT) AS nth FROM k WHERE nth <= target""")
def filled_label_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants accepted up to each label's target, among a bounded number generated."""
    v = table(spark, sf_dir, "documents").select(F.col("lang").alias("label"), "doc_id", (F.col("n_chars") > 300).alias("ok"))
    t = spark.createDataFrame([("en", 20, 2.0), ("fr", 1_000_000, 2.0), ("de", 5, 1.0)], "label string, target int, over double")
    return D.filled_targets(v, t, ["doc_id"])


@query("""SELECT conv_id, CAST(count(*) AS INT) AS n, md5(string_agg(coalesce(substr(d.text, 1, 800), '?'), '|' ORDER BY turn)) AS texts FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id * 7 + c.turn * 400 GROUP BY conv_id""")
def injected_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References filled with the texts of their chunks."""
    refs = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("k"), (F.col("conv_id") * 7 + F.col("turn") * 400).alias("chunk_id"))
    out = D.inject_texts(refs, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), "conv_id", 800)
    return out.select("conv_id", F.size("refs").alias("n"), F.md5(F.array_join(F.transform("refs", lambda r: F.coalesce(r["text"], F.lit("?"))), "|")).alias("texts"))


@query("""WITH u AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY user_id)
SELECT e.event_id, e.user_id FROM events e LEFT JOIN u USING (user_id) WHERE event_type = 'purchase' AND (last IS NULL OR event_id >= last)""")
def invalidated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that a later upload hasn't made void."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return D.invalidated(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id", "event_id").select("event_id", "user_id")


@query("""WITH n AS (SELECT trim(c_mktsegment) AS name, 'ORG' || lpad(CAST(row_number() OVER (ORDER BY min(c_custkey)) AS VARCHAR), 3, '0') AS code FROM customer WHERE trim(c_mktsegment) <> '' AND c_custkey % 9 <> 0 GROUP BY 1)
SELECT c_custkey, code, CASE WHEN c_acctbal > 0 AND c_nationkey = 1 THEN 'done' WHEN c_nationkey = 1 THEN 'idle' ELSE 'other' END AS status FROM customer LEFT JOIN n ON name = trim(c_mktsegment) AND c_custkey % 9 <> 0""")
def migration_backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts turned into keys in the order they came, and idle rows with a result settled."""
    c = table(spark, sf_dir, "customer").withColumn("unit", F.when(F.col("c_custkey") % 9 == 0, " ").otherwise(F.col("c_mktsegment")))
    _, rows = D.text_to_key(c, "unit", "c_custkey")
    status = D.settled_status(F.when(F.col("c_nationkey") == 1, "idle").otherwise("other"), F.col("c_acctbal") > 0)
    return rows.select("c_custkey", "code", status.alias("status"))


@query("""WITH i AS (SELECT doc_id AS item_id, lang AS g, md5('42:' || doc_id) AS at, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id)) - 1 AS number, count(*) OVER (PARTITION BY lang) AS m FROM documents),
p AS (SELECT doc_id AS example_id, lang AS g, doc_id AS item_id FROM documents WHERE n_chars > 2000 UNION SELECT doc_id, lang, doc_id + 20 FROM documents WHERE n_chars > 2000),
e AS (SELECT example_id, g, count(*) AS held, md5('42:' || example_id) AS at FROM p GROUP BY ALL),
s AS (SELECT e.*, (SELECT count(*) FROM i WHERE i.g = e.g AND i.at < e.at) AS place FROM e),
c AS (SELECT s.example_id, i.item_id, (i.number - s.place + i.m) % i.m AS step FROM s JOIN i USING (g) WHERE (i.number - s.place + i.m) % i.m < held + 3),
f AS (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY step) AS nth FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.example_id = c.example_id AND p.item_id = c.item_id))
SELECT example_id, item_id, CAST(nth AS INT) AS nth FROM f WHERE nth <= 3""")
def distractor_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each long text three of its language that it doesn't hold: itself and another one."""
    d = table(spark, sf_dir, "documents")
    long = d.where("n_chars > 2000")
    present = long.select(F.col("doc_id").alias("example_id"), F.col("lang").alias("group"), F.explode(F.array(F.col("doc_id"), F.col("doc_id") + 20)).alias("item_id"))
    return D.sample_distractors(present, d.select(F.col("doc_id").alias("item_id"), F.col("lang").alias("group")), 3)


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'drop' WHEN quality = 1 THEN 'accept' ELSE 'review' END AS bucket FROM documents LEFT JOIN labels USING (doc_id)""")
def triage_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted, dropped, or left to review where nothing is known."""
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return j.select("doc_id", D.triage(F.col("quality") == 1, F.col("toxic") == 1).alias("bucket"))


@query("""SELECT conv_id, turn, CAST(least(8, turn + 1 + length(text) % 5) AS INT) AS n, CAST(least(8, turn + 1) AS BIGINT) AS n_masked FROM conversations""")
def masked_prompt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with the prompt masked, cut at a length."""
    prompt, target = F.sequence(F.lit(0), F.col("turn").cast("int")), F.slice(F.sequence(F.lit(100), F.lit(104)), 1, F.length("text") % 5)
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", D.masked_labels(prompt, target, 8).alias("y"))
    return own.select("conv_id", "turn", F.size("y").alias("n"), F.size(F.filter("y", lambda v: v == -100)).cast("long").alias("n_masked"))


# accounts


@query("SELECT event_id, event_type = 'view' AND TIMESTAMP '2024-01-30 12:00:00' > ts + INTERVAL 60 MINUTE AS stale FROM events")
def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that have been processing for over an hour on a stated time."""
    s = F.when(F.col("event_type") == "view", "processing").otherwise("done")
    return table(spark, sf_dir, "events").select("event_id", A.stale(s, F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")).alias("stale"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'name' WHEN c_custkey % 5 = 0 THEN 'segment' END AS missing FROM customer")
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first required field that is blank."""
    c = table(spark, sf_dir, "customer").withColumn("n", F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_name"))).withColumn("s", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")))
    return c.select("c_custkey", A.first_blank([("n", "name"), ("s", "segment"), ("c_acctbal", "balance")]).alias("missing"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def hidden_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list with what is completed hidden."""
    return table(spark, sf_dir, "orders").where(A.toggled(F.col("o_orderstatus") == "F", True)).select("o_orderkey")


_PATHS = "CASE event_id % 6 WHEN 0 THEN '/admin/x' WHEN 1 THEN '/manage/users' WHEN 2 THEN '/password/change/' WHEN 3 THEN '/contracts/1' WHEN 4 THEN '/login/' ELSE '/help/' END"


@query(f"""WITH e AS (SELECT *, {_PATHS} AS path FROM events)
SELECT event_id, CASE WHEN path LIKE '/admin/%' THEN NULL WHEN value > 150 THEN 'locked' WHEN value > 120 THEN 'other_session' WHEN value > 100 THEN 'expired' WHEN value > 60 AND path NOT IN ('/login/', '/password/change/') THEN 'must_change'
WHEN event_type = 'error' AND NOT (path IN ('/login/', '/password/change/') OR path LIKE '/manage/%' OR path LIKE '/help/%') THEN 'not_allowed' END AS gate FROM e""")
def account_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first gate that closes on a request."""
    names = F.array(*map(F.lit, ("/admin/x", "/manage/users", "/password/change/", "/contracts/1", "/login/", "/help/")))
    e, v = table(spark, sf_dir, "events").withColumn("path", F.get(names, (F.col("event_id") % 6).cast("int"))), F.col("value")
    return e.select("event_id", A.gate(F.col("path"), v > 150, v > 120, v > 100, v > 60, F.col("event_type") == "error", ["/manage/", "/help/"], ["/login/", "/password/change/"]).alias("gate"))


@query("""WITH c AS (SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_custkey // 2) > 1 AND c_custkey % 2 = 1 AS taken, c_custkey % 7 = 0 AS admin, CASE c_custkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN 'ab1!' WHEN 2 THEN 'a1' END AS pw FROM customer)
SELECT c_custkey, CASE WHEN taken THEN 'name_taken' WHEN NOT admin AND c_custkey % 11 = 0 THEN 'unit_missing' WHEN pw IS NULL OR pw <> 'ab1!' THEN 'weak_password' END AS error FROM c""")
def form_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why users' rows are refused."""
    k = F.col("c_custkey")
    taken = (F.count("*").over(Window.partitionBy(F.floor(k / 2))) > 1) & (k % 2 == 1)
    pw = F.when(k % 4 == 0, "abc").when(k % 4 == 1, "ab1!").when(k % 4 == 2, "a1")
    return table(spark, sf_dir, "customer").select(k, taken.alias("taken")).select(k, A.form_error(F.col("taken"), k % 7 == 0, F.when(k % 11 != 0, k), pw).alias("error"))


@query("SELECT user_id, CAST(count(DISTINCT event_type) FILTER (WHERE event_type IN ('view', 'click', 'purchase') AND value > 60) AS BIGINT) AS n_done, 3::INT AS n_all FROM events GROUP BY user_id")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of three kinds are done."""
    return A.progress(table(spark, sf_dir, "events"), "user_id", "event_type", ["view", "click", "purchase"], F.col("value") > 60)


@query("SELECT user_id, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS n_found, CAST(count(*) AS BIGINT) AS n_all FROM events GROUP BY user_id")
def found_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections found of all."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") > 50).alias("n_found"), F.count("*").alias("n_all"))


@query("""WITH RECURSIVE l AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'signup'),
f(user_id, event_id, i, last, accepted) AS (SELECT user_id, event_id, i, ts, true FROM l WHERE i = 1
UNION ALL SELECT l.user_id, l.event_id, l.i, CASE WHEN l.ts - f.last >= INTERVAL 2 DAY THEN l.ts ELSE f.last END, l.ts - f.last >= INTERVAL 2 DAY FROM f JOIN l ON l.user_id = f.user_id AND l.i = f.i + 1)
SELECT user_id, event_id, accepted FROM f""")
def blocked_new_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins that a live session blocks."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return A.blocked_logins(e, "user_id", ["ts", "event_id"], 2 * 86_400, "ts").select("user_id", "event_id", "accepted")
