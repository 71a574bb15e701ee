"""Parts of statutes and references among them, on hand-written texts."""

from vellum.operators import mentions as M
from vellum.operators import provisions as P
from vellum.operators import refresh as U
from vellum.operators import statutes as L
from pyspark.sql import functions as F
from vellum.functions import text as T
from vellum.operators import clauses as C


def lines(spark, text, file="f", prefix="LAW"):
    return [(file, k, prefix, t) for k, t in enumerate(text)]


def articles(spark, rows):
    return L.articles(spark.createDataFrame(rows, "file string, ord int, prefix string, line string"))


def test_provisions(spark):
    text = [
        "제2장 본칙", "제1절 일반", "제7조의2(특례) 머리말은 1. 첫째 2의2. 둘째 가. 하나 나. 둘",
        "제8조(항) ① 처음 <개정> 문장 ② 다음 각 호와 같다. 1. 가격 2. 기술", "제9조(단문) 그대로",
    ]
    got = {r.chunk_id: r for r in P.provisions(articles(spark, lines(spark, text))).collect()}
    assert {k: (r.text, r.parent_id, r.article_number) for k, r in got.items()} == {
        "LAW_2_1_7-2_0_0_0_0": ("제7조의2(특례) 머리말은", None, "제2장제1절제7조의2"),
        "LAW_2_1_7-2_0_1_0_0": ("1. 첫째", "LAW_2_1_7-2_0_0_0_0", "제2장제1절제7조의2제1호"),
        "LAW_2_1_7-2_0_2-2_0_0": ("둘째", "LAW_2_1_7-2_0_0_0_0", "제2장제1절제7조의2제2의2호"),
        "LAW_2_1_7-2_0_2-2_가_0": ("가. 하나", "LAW_2_1_7-2_0_2-2_0_0", "제2장제1절제7조의2제2의2호가"),
        "LAW_2_1_7-2_0_2-2_나_0": ("나. 둘", "LAW_2_1_7-2_0_2-2_0_0", "제2장제1절제7조의2제2의2호나"),
        "LAW_2_1_8_0_0_0_0": ("제8조(항)", None, "제2장제1절제8조"),
        "LAW_2_1_8_1_0_0_0": ("① 처음  문장", "LAW_2_1_8_0_0_0_0", "제2장제1절제8조제1항"),
        "LAW_2_1_8_2_0_0_0": ("② 다음 각 호와 같다.", "LAW_2_1_8_0_0_0_0", "제2장제1절제8조제2항"),
        "LAW_2_1_8_2_1_0_0": ("1. 가격", "LAW_2_1_8_2_0_0_0", "제2장제1절제8조제2항제1호"),
        "LAW_2_1_8_2_2_0_0": ("2. 기술", "LAW_2_1_8_2_0_0_0", "제2장제1절제8조제2항제2호"),
        "LAW_2_1_9_0_0_0_0": ("제9조(단문) 그대로", None, "제2장제1절제9조"),
    }
    tags = {r.chunk_id: r for r in P.tagged(P.provisions(articles(spark, lines(spark, text))), P.F.lit(True), ["제9조"], ["제7조"]).collect()}
    assert tags["LAW_2_1_9_0_0_0_0"].is_ref_article and tags["LAW_2_1_7-2_0_1_0_0"].is_upper_law and not tags["LAW_2_1_8_0_0_0_0"].is_upper_law


def test_conditions(spark):
    text = [("p", "제3절 장 없이"), ("p", "제9장 조건"), ("p", "1. 절 없이"), ("p", "제7절 대가"), ("p", "1. 청구"), ("p", "이어서"), ("p", "가. 항목 1) 하나 2) 둘 가) 세목, 나) 인용 나) 진짜"), ("tbl", "나. 표"), ("p", "2. 지급"), ("tbl", "제8절 표 안의 절"), ("p", "1. 끝")]
    rows = [("f", k, "PYG", kind, t) for k, (kind, t) in enumerate(text)]
    got = {r.chunk_id: (r.text, r.parent_id, r.article_number) for r in P.conditions(spark.createDataFrame(rows, "file string, ord int, prefix string, kind string, line string")).collect()}
    assert got == {
        "PYG_9_7_0_1_0_0_0": ("1. 청구 이어서", None, "제9장제7절제1항"),
        "PYG_9_7_0_1_가_0_0": ("가. 항목", "PYG_9_7_0_1_0_0_0", "제9장제7절제1항가"),
        "PYG_9_7_0_1_가_1_0": ("1) 하나", "PYG_9_7_0_1_가_0_0", "제9장제7절제1항가제1호"),
        "PYG_9_7_0_1_가_2_0": ("2) 둘", "PYG_9_7_0_1_가_0_0", "제9장제7절제1항가제2호"),
        "PYG_9_7_0_1_가_2_가": ("가) 세목, 나) 인용", "PYG_9_7_0_1_가_2_0", "제9장제7절제1항가제2호가"),
        "PYG_9_7_0_1_가_2_나": ("나) 진짜 나. 표", "PYG_9_7_0_1_가_2_0", "제9장제7절제1항가제2호나"),
        "PYG_9_7_0_2_0_0_0": ("2. 지급", None, "제9장제7절제2항"),
        "PYG_9_8_0_1_0_0_0": ("1. 끝", None, "제9장제8절제1항"),
    }


def test_references(spark):
    law = [
        "제1조(목적) 이 법은 다음 각 호와 같다. 1. 가 목적 2. 제2호와 제1호", "제2조(정의) ① 제1조제1호 및 제2항에 따른다 ② 영 제5조제1항부터 제3항까지 및 제5조제1항을 본다",
        "제3조(준용) 제1조부터 제2조까지 준용하되 「다른법 시행령」 제5조제1항제2호. 제9조제4항은 예외로 한다", "제4조(각호) 제1조 각 호에 따른다",
    ]
    decree = ["제5조(대가) ① 하나 1. 갑 2. 을 ② 둘"]
    chunks = P.provisions(articles(spark, lines(spark, law) + lines(spark, decree, "g", "DEC"))).cache()
    refs = {}
    for r in P.references(chunks, {"다른법 시행령": "DEC", "다른법": "LAW"}, {"LAW": {"영": "DEC"}}).orderBy("chunk_id", "k").collect():
        refs.setdefault(r.chunk_id, []).append((r.ref_id, r.is_resolved))
    a = lambda *x: [(f"LAW_0_0_{p}_0_0", ok) for p, ok in x]
    assert refs["LAW_0_0_1_0_0_0_0"] == a(("1_0_1", True), ("1_0_2", True))
    assert refs["LAW_0_0_1_0_2_0_0"] == a(("1_0_1", True))
    assert refs["LAW_0_0_2_1_0_0_0"] == a(("1_0_1", True), ("2_2_0", True))
    assert refs["LAW_0_0_2_2_0_0_0"] == [("DEC_0_0_5_1_0_0_0", True), ("DEC_0_0_5_2_0_0_0", True), ("DEC_0_0_5_3_0_0_0", False)]
    assert refs["LAW_0_0_3_0_0_0_0"] == [("DEC_0_0_5_1_2_0_0", True), *a(("1_0_0", True), ("2_0_0", True), ("9_4_0", False))]
    assert refs["LAW_0_0_4_0_0_0_0"] == a(("1_0_0", True), ("1_0_1", True), ("1_0_2", True))
    own = {"prefix": "PYG", "jo": None, "jo_ui": None, "jeol": "7", "hang": "1", "ho": "가"}
    place = lambda m: (m.jo, m.ui, m.hang, m.ho, m.mok, m.semok)
    got = M.mentions('제8절 "4-나-1)" 및 "다", "2)"와 “마” 그리고 "가"', own, {})
    assert [place(m) for m in got] == [("8", None, "4", "나", "1", None), ("8", None, "4", "다", None, None), ("8", None, "4", "다", "2", None), ("8", None, "4", "마", None, None)]
    assert [place(m)[2:4] for m in M.mentions('앞의 "라"와 "가"', own, {})] == [("1", "라")]


def test_a_refreshed_base_is_that_of_a_full_run(spark):
    def law(c, *more):
        return [f"제1조(목적) 이 법은 「법{(c + 1) % 6}」 제2조제1항에 따른다", f"제2조(정의) ① 영 제3조 ② 다음 각 호와 같다. 1. 갑 {c} 2. 을", "제4조(준용) 제2조 각 호와 제1조", *more]

    def state(laws):
        rows = [(f"f{c}", k, f"L{c}", t) for c, text in laws.items() for k, t in enumerate(text)]
        return spark.createDataFrame(rows, "file string, ord int, prefix string, line string")

    names = spark.createDataFrame([(f"법{c}", f"L{c}") for c in range(6)], "name string, prefix string")
    relatives = spark.createDataFrame([(f"L{c}", "영", f"L{(c + 2) % 6}") for c in range(6)], "prefix string, kind string, target string")
    base = U.built(state({c: law(c) for c in (0, 1, 2, 3)}), names, relatives)
    held = lambda b: ({tuple(r) for r in b.chunks.select("chunk_id", "text").collect()}, {tuple(r) for r in b.references.collect()}, {tuple(r) for r in b.files.collect()})
    same = U.refreshed(base, state({c: law(c) for c in (0, 1, 2, 3)}), names, relatives)
    assert held(same) == held(base) and U.changes(base, state({c: law(c) for c in (0, 1, 2, 3)}))[1].count() == 0
    # one edited (an article more, one less), one gone, one new
    edited = {0: law(0), 1: [law(1)[0], law(1)[2], "제3조(신설) 제2호와 제1항"], 3: law(3), 4: law(4)}
    now = state(edited)
    files, laws = U.changes(base, now)
    assert {r.file for r in files.collect()} == {"f1", "f4"} and {r.prefix for r in laws.collect()} == {"L1", "L2", "L4"}
    got, want = U.refreshed(base, now, names, relatives), U.built(now, names, relatives)
    assert held(got) == held(want)
    unresolved = {r.ref_id for r in got.references.where("not is_resolved").collect()}
    assert "L1_0_0_2_1_0_0_0" in unresolved  # lost with the edit, asked for by a file that hasn't changed
    back = U.refreshed(got, state({c: law(c) for c in (0, 1, 2, 3)}), names, relatives)
    assert held(back) == held(base)
    assert U.refreshed(got, now.limit(0), names, relatives).references.count() == 0


def test_a_text_is_cut_once(spark):
    """However often the parts of a cut are named, its pattern stands once in the plan for each place that cuts."""
    docs = spark.createDataFrame([(1, "제1조(갑) ①하나 1. 둘 ②셋")], "doc_id long, text string")
    articles = spark.createDataFrame([("L", 1, 1, 1, None, "갑", "제1조(갑) ①하나 1. 둘 가. 셋")], "prefix string, jang int, jeol int, jo int, jo_ui int, title string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    assert 1 <= plan(P.provisions(articles)).count(P.ITEM) <= 2  # before the paragraphs and in them
    assert 1 <= plan(P.provisions(articles)).count(P.SUB_ITEM) <= 2
    assert 1 <= plan(C.unit_clauses(docs)).count(C.ITEM_MARK) <= 3  # in paragraphs, in clauses without any, and in those without a body


def test_strip_takes_the_white_space_of_the_pattern(spark):
    chars = [chr(k) for k in [*range(0x250), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]]
    df = spark.createDataFrame([(f"{c}a{c}b{c}{c}",) for c in chars] + [("",), (" ",), (None,), ("\n\n",)], "s string")
    assert df.where(~T.strip(F.col("s")).eqNullSafe(F.regexp_replace("s", r"(?U)^\s+|\s+$", ""))).count() == 0


def test_lines_of_conditions_are_sorted_once(spark):
    """F16: every window goes over a file's lines in one order."""
    rows = [("f", 0, "C", "p", "제1장 총칙"), ("f", 1, "C", "p", "제1절 앞"), ("f", 2, "C", "p", "1. 갑"), ("f", 3, "C", "p", "제2장 각칙"), ("f", 4, "C", "p", "1. 절이 없다"), ("f", 5, "C", "p", "제2절 뒤"), ("f", 6, "C", "p", "가. 항이 없다"), ("f", 7, "C", "p", "2. 을"), ("f", 8, "C", "p", "가. 병")]
    out = P.conditions(spark.createDataFrame(rows, "file string, ord int, prefix string, kind string, line string"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [file") == 1
    assert {r.chunk_id: r.text for r in out.collect()} == {"C_1_1_0_1_0_0_0": "1. 갑", "C_2_2_0_2_0_0_0": "2. 을", "C_2_2_0_2_가_0_0": "가. 병"}


def test_headings_are_not_read(spark):
    """an article's own heading names no place, so it isn't sent to the reader; whatever names one is. Levels are cut by compiled expressions."""
    base = {"prefix": "L", "jeol": None, "hang": None, "ho": None}
    rows = [
        ("제3조(품목) 다음과 같다.", "3", None), ("제3조(갑) 제1항", "3", None), ("제3조 각 호", "3", None), ("제3조의2(을) 수량", "3", "2"), ("제3조의2(을) 수량", "3", None), ("제3조의23 을", "3", "2"), ("제03조(갑)", "3", None),
        ("제4조(갑)", "3", None), ("갑 제3조", "3", None), ("제3조(인용) 「갑법」 제5조", "3", None), ("제3조(준용) 영 제5조", "3", None), ("제3조\u001f각호", "3", None), ("수량 5", "3", None), ("제3조(갑) 제3조 각 호", "3", None),
    ]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "n int, text string, jo string, jo_ui string")
    sent = {r.n for r in df.where(P._names_places()).collect()}
    read = {k for k, (text, jo, ui) in enumerate(rows) if M.mentions(text, {**base, "jo": jo, "jo_ui": ui}, {"영": "D"})}
    assert read <= sent and not {0, 3, 12} & sent
    out = P.provisions(articles(spark, lines(spark, ["제1조(갑) ① 하나 1. 둘 가. 셋", "제2조(을) 단문"])))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString().split("Window")[0]
    assert P.registry(out)._jdf.queryExecution().executedPlan().toString().split("Generate")[0].count("Sort [") == 1
