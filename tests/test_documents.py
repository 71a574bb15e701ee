"""Hangul fixtures for what the tables can't show."""

import datetime
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vellum.functions import similarity as S
from vellum.functions import text as T
from vellum.operators import ordered as O
from vellum.operators import review as V
from vellum.operators import sections as X
from vellum.operators import statutes as L


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first().x


def test_text_functions(spark):
    s = lambda v: {"s": v}
    assert one(spark, T.squeeze(F.col("s")), **s("사 업　명  a")) == "사업명a"
    assert one(spark, T.compare_form(F.col("s")), **s("(가) 나·다　라.")) == "가나다라"
    assert one(spark, T.loose_form(F.col("s")), **s("3. 산출물-목록")) == "3산출물목록"
    assert one(spark, T.title_form(F.col("s")), **s("Ⅰ. 사업 개요")) == "사업개요"
    assert one(spark, T.money(F.col("s")), **s("1,234,000")) == 1234000
    assert one(spark, T.money(F.col("s")), **s("약 백만")) is None
    assert one(spark, T.dotted_date(F.col("s")), **s("제출 2025. 3. 1 까지")) == datetime.date(2025, 3, 1)
    p = one(spark, T.period(F.col("s")), **s("2026년 1월 5일부터 2026년 2월 30일까지"))
    assert p.start == datetime.date(2026, 1, 5) and p.stop is None
    assert one(spark, T.cut(F.col("s"), 3), **s("가나다라")) == "가나다 [이하 생략]"
    assert one(spark, T.parse_label(F.col("s"), ["일치", "불일치"]), **s("결과: 불일치")) == "불일치"
    assert one(spark, T.parse_label(F.col("s"), ["일치", "불일치"], longest_first=False), **s("결과: 불일치")) == "일치"
    assert one(spark, T.enumerate_range(F.col("s")), **s("제1조부터 제3조까지, 제7조")) == [1, 2, 3, 7]
    assert one(spark, T.client_ip(F.col("s"), F.lit("9.9.9.9")), **s(" 1.1.1.1, 2.2.2.2")) == "1.1.1.1"
    assert "1" not in one(spark, T.clean(F.col("s")), **s("목차\n개요 ........ 1\n\n- 2 -\n본문"))


def test_only_blanks_are_trimmed_from_paragraphs(spark):
    """The place of a paragraph is not what is trimmed from it."""
    assert one(spark, T.paragraphs(F.col("s")), s="0 first 10 \n \n 1 second 171\n\n 2\n\n ") == ["0 first 10", "1 second 171", "2"]
    assert one(spark, T.paragraphs(F.col("s")), s=" one line 490 ") == ["one line 490"]
    docs = spark.createDataFrame([(1, "0 first 10 \n\n 1 second 11")], "doc_id long, text string")
    assert [r.clause_text for r in X.clauses(docs).orderBy("k").collect()] == ["0 first 10", "1 second 11"]


def test_similarity_is_the_matchers(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("ab" * 150, "x" + "ab" * 150), ("", ""), (None, "a")]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string")
    got = [r.x for r in df.select("k", S.ratio("a", "b").alias("x")).orderBy("k").collect()]
    assert got == [SequenceMatcher(None, a or "", b or "").ratio() for a, b in pairs]
    assert one(spark, S.containment("a", "b"), a="", b="x") == 1.0


def test_clauses(spark):
    docs = spark.createDataFrame(
        [(1, "제1조(목적) 가. 법 제38조에 따라 한다.\n제2조(정의) 나.\n제2조(정의) 다."), (2, "머리\n\n둘째 단락"), (3, ""), (4, "제1조(목적)")], "doc_id long, text string"
    )
    got = {(r.doc_id, r.k): (r.clause_number, r.clause_text) for r in X.clauses(docs).collect()}
    assert got[1, 1] == ("제1조", "제1조(목적) 가. 법 제38조에 따라 한다.")
    assert [got[1, k][0] for k in (2, 3)] == ["제2조", "제2조"]
    assert got[2, 2] == ("단락2", "둘째 단락") and (3, 1) not in got
    assert got[4, 1] == ("단락1", "제1조(목적)")


def test_anchored_sections_and_requirements(spark):
    rows = [("RFP-01-01", "제안개요", ["제안개요"]), ("RFP-01-04", "사업 범위", ["사업범위"]), ("RFP-04-04-01", "기능", ["기능 요구사항"]), ("RFP-09", "없음", ["없는제목"])]
    text = "목차\n1. 제안개요\n2. 사업범위\nⅠ. 사업범위\n1. 제안개요\n본문 하나\n2. 사업범위\n본문 둘\n□ 기능 요구사항 (SFR)\nSFR-01 요구사항 명칭 로그인\n[정의] 들어간다\n산출정보 설계서 요구사항 분류 기능\nSFR-02 요구사항 명칭 조회\nSFR-01 또"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s = X.anchored_sections(docs, X.spec_table(spark, rows)).cache()
    got = {r.code: r for r in s.collect()}
    assert got["RFP-01-01"].content == "1. 제안개요\n본문 하나" and got["RFP-01-04"].content == "2. 사업범위\n본문 둘"
    assert not got["RFP-09"].found and got["RFP-09"].content == ""
    r = {x.id: x for x in X.requirements(s.where("code like 'RFP-04-04%'")).collect()}
    assert set(r) == {"SFR-01", "SFR-02"} and r["SFR-01"].name == "로그인" and r["SFR-01"].definition == "들어간다" and r["SFR-01"].output == "설계서"
    m = X.metadata(spark.createDataFrame([(1, "사 업 명: 새 체계\n사업예산: 금 1,500 원\n계약방법: 경쟁")], "doc_id long, text string")).first()
    assert (m.project_name, m.budget_value, m.contract_method, m.client) == ("새 체계", 1500, "경쟁", None)


def test_keyword_sections(spark):
    rows = [("P1", "사업명", ["사업명"]), ("P2", "보안", ["보안대책"]), ("P3", "교육", ["교육계획"]), ("P4", "없음", ["협조요청"])]
    text = "사업명 표지\n목 차\n사업명\n보안대책\n교육계획\n협조요청\n사 업 명\n새 체계 구축\n4. 장\n보안 대책\n방화벽\n교육계획\n사용자 교육"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.code): r for r in X.keyword_sections(docs, X.spec_table(spark, rows), rows).collect()}
    assert got[1, "P1"].content == "새 체계 구축" and got[1, "P2"].content == "방화벽" and not got[1, "P4"].found
    assert not got[2, "P1"].found and not got[3, "P1"].found and len(got) == 12


def test_compare(spark):
    long = "가" * 40
    src = spark.createDataFrame([(p, c, t, True) for p in (1, 2, 3) for c, t in (("A", "누리집 통합관제" if p < 3 else ""), ("B", "x"), ("C", "y"))], "pair_id long, code string, content string, found boolean")
    tgt = spark.createDataFrame([(1, "a1", "누리집 통합관제 " + long, True), (1, "b1", long, True), (1, "b2", "짧다", True), (2, "a1", "전혀 다른 문서 " + long, True), (3, "c1", long, False)], src.schema)
    mapping = spark.createDataFrame([("A", ["a1"], True), ("B", ["b1", "b2"], False), ("C", ["c1"], False)], "code string, targets array<string>, required boolean")
    ident = V.identity_scores(src, tgt, ["A"], [])
    items, scores = V.compare(src, tgt, mapping, ident)
    got = {r.pair_id: r for r in scores.collect()}
    assert got[1].identity == 1.0 and got[1].score == 62 and (got[1].n_satisfied, got[1].n_partial, got[1].n_unsatisfied) == (1, 1, 1)  # 62.5 to even
    assert got[2].identity == 0.0 and got[2].score == 0 and got[2].n_unsatisfied == 3
    assert got[3].identity == 1.0
    assert {r.code: r.missing for r in items.where("pair_id = 1").collect()}["B"] == ["b2"]


def test_review(spark):
    body = {c: f"{c} 항목의 본문은 이러하며 서로 다른 낱말 {c * 9} 들로 채워져 있다" for c in "ABCDE"}
    spec = spark.createDataFrame([(c, k, f"제목{c}") for k, c in enumerate("ABCDEF")], "code string, ord int, title string")
    orig = spark.createDataFrame([(1, c, k * 100, body[c]) for k, c in enumerate("ABCDE")], "doc_id long, code string, pos int, content string")
    parsed = [(1, "A", 0, "제목A", body["A"]), (1, "C", 1, "제목C", body["D"]), (1, "B", 2, "다른이름", body["B"]), (1, "D", 3, "제목D", body["C"]), (1, "E", 4, "제목E", " "), (1, "Z", 5, "모름", "내용")]
    issues = V.review(spec, orig, spark.createDataFrame(parsed, "doc_id long, code string, ord int, title string, content string"))
    got = {(r.issue, r.code, r.related) for r in issues.collect()}
    assert got == {
        ("missing_section", "F", None), ("empty_section", "E", None), ("unrecognized_section", "Z", None), ("section_title_mismatch", "B", None),
        ("section_order_mismatch", None, None), ("content_misplaced", "C", "D"), ("content_misplaced", "D", "C"),
    }
    assert V.status(orig, issues).first().status == "FAIL"


def test_title_and_content_issues_are_one(spark):
    rows = [(1, "section_title_mismatch", "A", None), (1, "content_misplaced", "A", "B"), (1, "section_title_mismatch", "B", None), (1, "paragraph_missing", "C", None), (1, "section_order_mismatch", None, None), (2, "content_misplaced", "A", "C")]
    got = {(r.doc_id, r.issue, r.code, r.related) for r in V.merged(spark.createDataFrame(rows, "doc_id long, issue string, code string, related string")).collect()}
    assert got == {
        (1, "section_title_content_mismatch", "A", "B"), (1, "section_title_mismatch", "B", None), (1, "paragraph_missing", "C", None), (1, "section_order_mismatch", None, None), (2, "content_misplaced", "A", "C"),
    }


def test_whole_review(spark):
    body = "이 사업의 배경과 필요성을 자세히 설명하는 첫 번째 단락이다"
    text = f"1. 개요\n{body}\n\n2. 방안\n추진 방안은 3개월 안에 5만원으로 정한다 그리고 끝까지 지킨다\n\n3. 일정\n일정은 따로 정한다"
    docs = spark.createDataFrame([(1, text), (2, text), (3, text)], "doc_id long, text string")
    good = [(1, 0, "1. 개요", body), (1, 1, "2. 방안", "추진 방안은 3개월 안에 5만원으로 정한다 그리고 끝까지 지킨다"), (1, 2, "3. 일정", "일정은 따로 정한다")]
    bad = [(2, 0, "3. 일정", "일정은 따로 정한다\n개요\n전혀 다른 내용이 길게 들어와 있어서 원문에는 없는 단락이다"), (2, 1, "2. 방안", " ")]
    sections = spark.createDataFrame(good + bad, "doc_id long, ord int, title string, content string")
    issues = V.whole_review(docs, sections, ["개요", "방안", "일정"])
    got = {}
    for r in issues.collect():
        got.setdefault(r.doc_id, set()).add(r.issue)
    assert 1 not in got and "empty_parsed_sections" in got[3]
    assert got[2] == {"low_overall_similarity", "missing_section", "section_order_mismatch", "empty_section", "overmerged_section", "missing_block", "added_block", "important_tokens_changed"}
    assert {r.doc_id: r.status for r in V.whole_status(issues, docs).collect()} == {1: "PASS", 2: "FAIL", 3: "FAIL"}


def test_layout_rules(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, ["성명", "", "비고", "", "주소", "서울"]), (1, 5, 0, 0, ["성명", ""])], "doc_id long, page int, tbl int, row int, values array<string>")
    assert [r.label for r in V.blank_fields(cells, ["비고"]).collect()] == ["성명"]
    items = spark.createDataFrame([(1, {"적용": False}, ""), (2, {"적용": True, "미적용": True}, ""), (3, {"미적용": True}, " "), (4, {"미적용": True}, "대체")], "item_id int, checked map<string, boolean>, reason string")
    assert {r.item_id: r.error for r in V.check_marks(items, ["부분적용", "미적용"]).collect()} == {1: "none_checked", 2: "many_checked", 3: "reason_missing", 4: None}
    rows = spark.createDataFrame([(1, 0, "머리", False), (1, 1, "착수", True), (1, 2, "보고서", False), (1, 3, "완료", True)], "doc_id long, k int, name string, dated boolean")
    assert sorted(r.name for r in V.continued_rows(rows, "doc_id", "k", F.col("dated"), "name").collect()) == ["완료", "착수보고서"]
    d = datetime.date(2025, 3, 1)
    old = spark.createDataFrame([("a", d), ("b", None), ("c", None)], "kind string, due date")
    new = spark.createDataFrame([("a", datetime.date(2026, 1, 1), 0), ("b", d, 1), ("b", None, 0)], "kind string, due date, ord int")
    assert {r.kind: (r.due, r.result) for r in V.sync_due_dates(old, new).collect()} == {"a": (d, "skipped"), "b": (d, "updated"), "c": (None, "not_found")}
    near = spark.createDataFrame([([(1.0, 10), (3.0, 11), (5.0, 12)], 4.0)], "items array<struct<pos: double, id: int>>, at double")
    assert near.select(O.nearest(F.col("items"), F.col("at"))["id"].alias("x")).first().x == 11


def test_statutes(spark):
    text = ["제1장 총칙", "제1조(목적) 이 법은", "<개정> 계속", "제2장 본칙", "제1절 일반", "제7조의2(특례) 제1조부터 제2조까지와 「정보법」 제3조 및 제7조의2에 따른다", "제7조의2(특례) 다시", "제2조(정의) 제9조", "부칙", "제3조(시행일) 끝"]
    lines = spark.createDataFrame([("f", k, "LAW", t) for k, t in enumerate(text)] + [("g", 0, "INF", "제3조(범위) 없음")], "file string, ord int, prefix string, line string")
    a = L.articles(lines).cache()
    got = {r.chunk_id: r for r in a.collect()}
    assert set(got) == {"LAW_1_0_1", "LAW_2_1_7-2", "LAW_2_1_2", "INF_0_0_3"}
    assert got["LAW_1_0_1"].text == "제1조(목적) 이 법은\n계속"
    refs = [(r.ref_id, r.is_resolved) for r in L.references(a, {"정보법": "INF"}).where("chunk_id = 'LAW_2_1_7-2'").orderBy("k").collect()]
    assert refs == [("INF_0_0_3", True), ("INF_0_0_7-2", False), ("LAW_1_0_1", True), ("LAW_2_1_2", True)]


def test_monotone_fold(spark):
    df = spark.createDataFrame([([1, 38, 2, 2, 4, 3],), ([],)], "n array<bigint>")
    assert [r.x for r in df.select(O.monotone_fold(F.col("n")).alias("x")).collect()] == [[0, 2, 3, 5], []]


def test_tables_are_dealt_before_they_are_sorted(spark):
    """nothing is sorted or grouped over a task's share of the input; a table's first cells and its end come from one dealing."""
    from vellum.operators import tables as B

    cells = spark.createDataFrame([(1, 0, k, float(k), k + 1.0, t) for k, t in enumerate(["항목", "적용", "부분적용", "미적용", "해당없음", "사유 및 대체기술", "적용"])], "table_id int, row int, col int, x0 double, x1 double, text string")
    out = B.header_zones(cells)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("Exchange hashpartitioning(table_id") > max(plan.rindex("Sort ["), plan.rindex("Aggregate("))
    assert {(r.key, r.x0) for r in out.collect()} == {("item", 0.0), ("적용", 1.0), ("부분적용", 2.0), ("미적용", 3.0), ("해당없음", 4.0), ("사유", 5.0)}
