"""Best matches against the standard library's matcher, and the review of whole documents against plain rules."""

import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vellum.functions.text import COMPARE_SIGNS, IMPORTANT
from vellum.operators import matching as G
from vellum.plans import layouts

SF = "/root/testdata/sf0.001"


def containment(a, b):
    return sum(m.size for m in SequenceMatcher(None, a, b or "", autojunk=False).get_matching_blocks()) / len(a) if a else 1.0


def ratio(a, b):
    return SequenceMatcher(None, a or "", b or "").ratio()


@pytest.mark.parametrize(("how", "plain"), [("ratio", ratio), ("containment", containment)])
def test_best_matches_against_all_pairs(spark, how, plain):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("가나다라마하힣abcxyz019 \n.😀") for _ in range(rng.randint(1, 6)))
    text = lambda: " ".join(word() for _ in range(rng.randint(0, 14)))
    rows = []
    for key in range(25):
        a, floor, least = text() if key else "", rng.choice([None, 0.3]), rng.choice([None, 0.2])
        for tie in range(8):
            b = rng.choice([text(), a[: len(a) // 2] + text(), None, ""])
            rows.append((key, tie, a, b, floor, least))
    df = spark.createDataFrame(rows, "key int, tie int, a string, b string, floor double, least double")
    pairs = df.withColumns({"ha": G.histogram(F.col("a")), "hb": G.histogram(F.col("b"))})
    bounds = G.could_win(pairs.withColumns({"floor": F.lit(None).cast("double"), "least": F.lit(None).cast("double")}), how).collect()
    assert len(bounds) == len(rows) and all(plain(r.a, r.b) <= r.bound for r in bounds)
    want = {}
    for key, tie, a, b, floor, least in rows:
        s = plain(a, b)
        if (floor is None or s > floor) and (least is None or s >= least) and (key not in want or s > want[key][1]):
            want[key] = (tie, s)
    assert {r.key: (r.tie, r.score) for r in G.best_matches(pairs, ["key"], "tie", how).collect()} == want


def test_few_pairs_reach_the_matcher(spark):
    rng = random.Random(2)
    topics = ["가나다라", "바사아자", "차카타파", "abcd", "mnop", "0123"]
    texts = ["".join(rng.choice(t) for _ in range(60)) for t in topics for _ in range(5)]
    rows = [(k, n, a, b, None, 0.3) for k, a in enumerate(texts) for n, b in enumerate(texts) if k != n]
    df = spark.createDataFrame(rows, "key int, tie int, a string, b string, floor double, least double")
    pairs = df.withColumns({"ha": G.histogram(F.col("a")), "hb": G.histogram(F.col("b"))})
    r = G.reached(pairs, ["key"], "tie", "ratio").first()
    assert r.n_pairs == 870 and r.n_scored <= 250


def form(s):
    return re.sub(rf"[\s{COMPARE_SIGNS}]+", "", (s or "").replace("\u00a0", " "))


def title(s):
    return re.sub(r"\s+", "", re.sub(r"^\s*(?:\d+(?:\.\d+)*\.?|[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+\.?|[①-⑮]|[가-하]\.)\s*", "", s))


def blocks(s):
    out = [x.strip(" ") for x in re.split(r"\n[ \t]*\n", s) if x.strip(" ")]
    return out if len(out) > 1 else [x.strip(" ") for x in s.split("\n") if x.strip(" ")]


def plain_whole(text, sections, titles):
    """The rules on one document: (issue, detail)."""
    sections = sorted(sections, key=lambda s: s[0])
    whole = "\n".join(f"{t}\n{c}" for _, t, c in sections)
    out, same = [], round(ratio(form(text), form(whole)), 4)
    if not whole:
        out.append(("empty_parsed_sections", None))
    if same < 0.98:
        out.append(("low_overall_similarity", same))
    first = {}
    for n, t, _ in sections:
        first.setdefault(title(t), n)
    places = []
    for w in titles:
        if title(w) in first:
            places.append(first[title(w)])
        else:
            out.append(("missing_section", w))
    if places != sorted(places):
        out.append(("section_order_mismatch", None))
    for _, t, c in sections:
        if not form(c):
            out.append(("empty_section", t))
        lines = [title(x) for x in c.split("\n")]
        out += [("overmerged_section", w) for w in titles if title(w) != title(t) and title(w) in lines]
    if same < 0.98:
        for name, a, b in (("missing_block", text, whole), ("added_block", whole, text)):
            out += [(name, k) for k, x in enumerate(blocks(a)) if len(form(x)) >= 20 and form(x) not in form(b) and containment(form(x), form(b)) < 0.9]
    tokens = lambda s: Counter(form(m[0]) for p in IMPORTANT for m in re.finditer(p, s))
    if tokens(text) != tokens(whole):
        out.append(("important_tokens_changed", None))
    return out


def test_whole_document_review_against_plain_rules(spark):
    docs, parsed = layouts._wholes(spark, SF)
    sections = {}
    for r in parsed.collect():
        sections.setdefault(r.doc_id, []).append((r.ord, r.title, r.content))
    want = Counter()
    for r in docs.collect():
        for issue, detail in plain_whole(r.text, sections.get(r.doc_id, []), ["개요", "방안", "일정"]):
            want[r.doc_id, issue, None if detail is None else str(detail)] += 1
    got = Counter((r.doc_id, r.issue, r.detail) for r in layouts.whole_document_review(spark, SF).collect())
    assert got == want
    assert len({k[1] for k in want}) == 9


def test_a_phrase_is_trimmed_once(spark):
    """what a phrase is tested for isn't computed again; the plan names each pattern a few times only."""
    from vellum.operators import phrases as H

    df = spark.createDataFrame([("시스템은 재고 현황을 분석하고  반품을 처리하여 창고 점검을 수행한다",), (" ",), (None,)], "t string")
    for f in (H.phrases, H.named_items):
        plan = df.select(f(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace") < 40
    assert [r[0] for r in df.select(H.named_items(F.col("t"))).collect()][1:] == [[], []]


def test_equal_and_held_texts_score_as_the_matcher_has_it(spark):
    """The short ways round the matcher give its figures, from 200 characters on too."""
    from vellum.functions import similarity as S

    rng = random.Random(3)
    texts = ["".join(rng.choices("가나다라 ", k=n)) for n in (0, 1, 5, 199, 200, 201, 450)]
    pairs = [(a, b) for a in texts for b in (*texts, a[1:], "x" + a + "가나")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.ratio("a", "b").alias("r"), S.containment("a", "b").alias("c"))
    assert all(r.r == ratio(r.a, r.b) and r.c == containment(r.a, r.b) for r in df.collect())


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_read_once_and_the_spec_is_sent(spark, tmp_path):
    """Token patterns aren't run again for each token; sections are neither sent nor dealt by a few codes."""
    import re as regex

    docs = spark.createDataFrame([(1, "대금 5만원 그리고 3개월 안에")], "doc_id long, text string")
    parsed = spark.createDataFrame([(1, 0, "개요", "대금 5만원 그리고 3개월 안에")], "doc_id long, ord int, title string, content string")
    from vellum.operators import review as V

    assert plan_of(V.whole_review(docs, parsed, ["개요"]))[0].count("regexp_extract_all") <= 2 * len(IMPORTANT)
    sections = spark.createDataFrame([(1, "A", "일")], "doc_id long, code string, content string")
    rules = spark.createDataFrame([("A", ["일"])], "code string, keywords array<string>")
    assert regex.search(r"BroadcastHashJoin .*BuildRight", plan_of(V.keyword_review(sections, rules))[1])


def test_headings_are_not_sent_to_the_spec(spark):
    """a heading meets the spec in its own row, without a join that has no keys."""
    from vellum.operators import sections as X

    docs = spark.createDataFrame([(1, "1. 배경\n본문")], "doc_id long, text string")
    out = X.anchored_sections(docs, X.spec_table(spark, [("A", "배경", ["배경"]), ("B", "없음", ["없음"])]))
    assert "NestedLoop" not in plan_of(out)[1] and "Cartesian" not in plan_of(out)[1]
    assert sorted((r.code, r.content, r.found) for r in out.collect()) == [("A", "1. 배경\n본문", True), ("B", "", False)]
