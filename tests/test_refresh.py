"""A refreshed base of statutes, and how its steps deal and read."""

import re

import pyarrow as pa
from vellum.operators import mentions as M
from vellum.operators import provisions as P
from vellum.operators import refresh as U
from vellum.operators import statutes as L
from vellum.scratch import Scratch


def articles(spark, text):
    return L.articles(spark.createDataFrame([("f", k, "LAW", t) for k, t in enumerate(text)], "file string, ord int, prefix string, line string"))


def test_only_what_changed_is_looked_through(spark, monkeypatch):
    """F11 of round 3, F3 of round 4: the registry of a refresh has the changed laws and those that their chunks refer to; it is dealt once and not sent."""
    state = lambda *cs: spark.createDataFrame([(f"f{c}", k, f"L_{c}", t) for c, text in cs for k, t in enumerate(text)], "file string, ord int, prefix string, line string")
    names = spark.createDataFrame([(f"법{c}", f"L_{c}") for c in range(5)], "name string, prefix string")
    relatives = spark.createDataFrame([], "prefix string, kind string, target string")
    plain = ["제1조(갑) ① 하나 ② 제1항과 제2조", "제2조(을) 다음 각 호와 같다. 1. 둘 2. 셋"]
    base = U.built(state((0, plain), (1, plain), (2, [*plain, "제3조(병) 「법0」 제1조제2항"])), names, relatives)
    seen, whole = [], P.registry
    monkeypatch.setattr(P, "registry", lambda chunks: (seen.append({r.prefix for r in chunks.select("prefix").distinct().collect()}), whole(chunks))[1])
    edited = state((0, plain), (1, [*plain, "제4조(신설) 제1조제1항"]), (2, [*plain, "제3조(병) 「법0」 제1조제2항"]))
    got = U.refreshed(base, edited, names, relatives)
    also = state((0, [*plain, "제5조(무)"]), (1, plain), (2, [*plain, "제3조(병) 「법0」 제1조제2항"]), (3, ["제1조(새) 「법2」 제3조"]))
    more = U.refreshed(U.settled(got), also, names, relatives)
    assert seen == [{"L_1"}, {"L_0", "L_1", "L_2", "L_3"}]
    rows = lambda df: {tuple(r) for r in df.collect()}
    for base_, lines_ in ((got, edited), (more, also)):
        want = U.built(lines_, names, relatives)
        assert rows(base_.references) == rows(want.references) and rows(base_.chunks) == rows(want.chunks.select(*base_.chunks.columns)) and rows(base_.places) == rows(want.places)
    monkeypatch.undo()
    chunks = P.provisions(articles(spark, plain))
    places = P.found_places(chunks, names, relatives, Scratch(spark, "test"))
    plan = P.resolved(chunks, P.registry(chunks), places)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [asked_hash" in plan and len(set(re.findall(r"hashpartitioning\((?:asked_hash|at_hash)[^,]*, [^)]*\)", plan))) == 2


def test_repeated_provisions_are_read_once(spark, monkeypatch):
    """the same text at the same place of other laws says the same of them; a relative that is the law itself is no other place."""
    rows = [(f"L{c}_{n}", "제1조와 법 제1조", {"법": f"L{c % 2 * 3}"}, f"L{c}", "7", None, None, None, None) for c in range(4) for n in range(5)]
    kinds = [pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), *[pa.string()] * 6]
    batch = pa.RecordBatch.from_arrays([pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [str(k) for k in range(9)])
    read = []
    monkeypatch.setattr(P, "mentions", lambda text, own, relatives: (read.append(text), M.mentions(text, own, relatives))[1])
    got = [tuple(r.values()) for b in P._mentioned(iter([batch])) for r in b.to_pylist()]
    want = [(c, law, k, *m) for c, text, near, law, jo, *rest in rows for k, m in enumerate(M.mentions(text, dict(zip(P._OWN, (law, jo, *rest), strict=True)), near))]
    assert got == want and len(read) == 2


def test_lines_of_statutes_are_sorted_once(spark):
    """chapters, sections and articles are found in one order of a file's lines; a chapter ends its section, nothing counts after the supplement."""
    text = ["제1절 앞", "제1조(갑) 하나", "제1장 총칙", "제2조(을) 둘", "제2절 뒤", "제3조(병) 셋", "이어서", "제2장 각칙", "제4조(정) 넷", "부칙", "제5조(무) 다섯", "제3장 끝"]
    out = articles(spark, text)
    assert [tuple(r) for r in out.select("jang", "jeol", "jo", "text").orderBy("jo").collect()] == [(None, 1, 1, "제1조(갑) 하나"), (1, None, 2, "제2조(을) 둘"), (1, 2, 3, "제3조(병) 셋\n이어서"), (2, None, 4, "제4조(정) 넷")]
    assert out._jdf.queryExecution().executedPlan().toString().count("Sort [file") == 2  # the other is for articles given twice
