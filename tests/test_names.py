"""Many names in one pass against plain loops, and rules of mentions."""

import random

import pytest

from vellum.operators import mentions as M
from vellum.operators import names as N


def plain_tags(text, names):
    out, at = [], 0
    while at < len(text):
        here = max((n for n in names if n and text.startswith(n, at)), key=len, default=None)
        if here:
            out.append((at, here))
        at += len(here) if here else 1
    return out


@pytest.mark.parametrize("sent", [1 << 20, 60])
def test_names_against_plain_loops(spark, monkeypatch, sent):
    monkeypatch.setattr(N, "SENT_BYTES", sent)  # in one group, and in several
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ab가") for _ in range(n))
    names = sorted({word(rng.randint(1, 5)) for _ in range(30)}) + [None, ""]
    texts = [word(rng.randint(0, 30)) for _ in range(80)] + [None, "", "zzz", "zzz"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    n = spark.createDataFrame([(x,) for x in names], "n string")
    real = [x for x in names if x]
    tags = {}
    for r in N.name_tags(t, "t", n, "n").orderBy("text", "k").collect():
        tags.setdefault(r.text, []).append((r.start, r.name))
    assert tags == {x: plain_tags(x, real) for x in texts if x and plain_tags(x, real)}
    best = {r.text: r.name for r in N.longest_names(t, "t", n, "n").collect()}
    assert best == {x: min((y for y in real if y in x), key=lambda y: (-len(y), y)) for x in texts if x and any(y in x for y in real)}


def test_no_names(spark):
    t = spark.createDataFrame([("abc",)], "t string")
    assert N.name_tags(t, "t", t.limit(0), "t").count() == 0
    assert N.longest_names(t.limit(0), "t", t, "t").count() == 0


OWN = {"prefix": "L", "jo": "3", "jo_ui": None, "jeol": None, "hang": "2", "ho": "4의2"}


def places(text, own=OWN, relatives=None):
    return [(m.title or m.prefix, m.jo, m.ui, m.hang, m.ho, m.each) for m in M.mentions(text, own, relatives or {})]


def test_ranges_and_places_that_touch():
    assert places("제1조부터 제3조까지") == [("L", "1", None, None, None, False), ("L", "2", None, None, None, False), ("L", "3", None, None, None, False)]
    assert places("제7조의2제1항제5호와 제7조 제1항") == [("L", "7", "2", "1", "5", False), ("L", "7", None, None, None, False), ("L", "3", None, "1", None, False)]
    assert places("제1항부터 제3항까지와 제5호") == [("L", "3", None, x, None, False) for x in "123"] + [("L", "3", None, "2", "5", False)]
    assert places("제2호부터 제3호까지, 제4호") == [("L", "3", None, "2", "2", False), ("L", "3", None, "2", "3", False)]  # the fourth is its own


def test_titles_and_relative_laws_claim_their_passage():
    assert places("「갑법」 제5조제1항제2호 및 제3호를, 제9조") == [("갑법", "5", None, "1", "2", False), ("갑법", "5", None, "1", "3", False), ("갑법", "9", None, None, None, False)]
    assert places("영 제5조에 따른다。 제6조", relatives={"영": "D"}) == [("D", "5", None, None, None, False), ("L", "6", None, None, None, False)]
    assert places("시행규칙 제5조", relatives={"규칙": "R"}) == [("R", "5", None, None, None, False)]
    assert places("규칙 제5조") == [("L", "5", None, None, None, False)]  # nothing known: an article of the own law
    assert places("제8조제1항 각 호") == [("L", "8", None, "1", None, False), ("L", "8", None, "1", None, True)]


def test_quoted_places():
    read = M.quoted_place
    assert read("4-나-1)-다") == {"hang": "4", "ho": "나", "mok": "1", "semok": "다"}
    assert read("4-1)") == {"hang": "4", "mok": "1"} and read("4-나-다)") == {"hang": "4", "ho": "나", "semok": "다"}
    assert read("나") is None and read("4-나-1-2") is None and read("") is None
    assert read("나", {"hang": "4"}) == {"hang": "4", "ho": "나"} and read("2)", {"hang": "4", "ho": "다"}) == {"hang": "4", "ho": "다", "mok": "2"}


def test_many_names_are_joined_and_not_sent(spark, monkeypatch):
    """beyond ``SENT_BYTES`` texts are still gone over once, whatever the number of names; long texts, equal starts and places too."""
    monkeypatch.setattr(N, "SENT_BYTES", 10)
    names = [f"품목{k}법" for k in range(40)] + [f"품목{k}법 시행령" for k in range(20)] + ["가나", "가나다", "나다라마", None, ""]
    texts = ["품목3법", "품목3법 시행령", "품목33법 시행령", "구 품목7법 시행규칙", "가나다라마", "품목" * 50 + "5법 시행령 및 품목39법", "없다", "", None]
    t, n = spark.createDataFrame([(x,) for x in texts], "t string"), spark.createDataFrame([(x,) for x in names], "n string")
    real = [x for x in names if x]
    best = N.longest_names(t, "t", n, "n")
    assert best._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert {r.text: r.name for r in best.collect()} == {x: min((y for y in real if y in x), key=lambda y: (-len(y), y)) for x in texts if x and any(y in x for y in real)}
    tags = {}
    for r in N.name_tags(t, "t", n, "n").orderBy("text", "k").collect():
        tags.setdefault(r.text, []).append((r.start, r.name))
    assert tags == {x: plain_tags(x, real) for x in texts if x and plain_tags(x, real)}
