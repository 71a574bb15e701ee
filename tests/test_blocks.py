"""What lies in matching blocks, against the standard library's matcher; pairs are dealt before they are matched."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vellum.functions import blocks as B
from vellum.functions import similarity as S
from vellum.operators import matching as G


def plain(x, y):
    return sum(m.size for m in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize(("cells", "runs"), [(1 << 22, 1000), (200, 3), (0, 0)])
def test_against_the_library(monkeypatch, cells, runs):
    """Texts of few and of many characters, copies and parts of copies; too large for one array, and with too many runs for one list."""
    monkeypatch.setattr(B, "CELLS", cells)
    monkeypatch.setattr(B, "RUNS", runs)
    rng = random.Random(cells + runs)
    for _ in range(500):
        of = rng.choice(["a", "ab", "abc", "abcd ef\n", "가나다라😀a", "abcdefghijklmnopqrstuvwxyz ", "ÿĀ"])
        text = lambda: "".join(rng.choice(of) for _ in range(rng.randint(0, 60)))  # noqa: E731, B023
        x, y = text(), text()
        if rng.random() < 0.4:
            a, b = sorted((rng.randint(0, len(x)), rng.randint(0, len(x))))
            y = y[: len(y) // 2] + x[a:b] + y[len(y) // 2 :] + x[:a]
        assert B.matched(x, y) == plain(x, y), (x, y)


def test_long_texts(monkeypatch):
    rng = random.Random(4)
    for of, n in (("ab", 700), ("etaoin shrdlu.\n", 1200), ("a", 900)):
        x, y = ("".join(rng.choice(of) for _ in range(n)) for _ in range(2))
        y = y[:300] + x[100:400] + y[300:]
        want = plain(x, y)
        assert B.matched(x, y) == want
        monkeypatch.setattr(B, "CELLS", 1 << 16)
        assert B.matched(x, y) == want
        monkeypatch.undo()


def test_pairs_are_dealt_and_scored_once(spark, monkeypatch):
    """F1: a small table is one file, and its pairs were scored by one task; filters on the score must not pass the dealing."""
    rows = [(k, t, f"a{k} common words", f"common b{t} words {k}", None, None) for k in range(60) for t in range(8)]
    df = spark.createDataFrame(rows, "key int, tie int, a string, b string, floor double, least double").coalesce(1)
    tasks, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def counted(a, b):
        tasks.add(1)
        seen.add(len(a))
        return S.containment.func(a, b)

    monkeypatch.setitem(G.HOW, "containment", (counted, G.HOW["containment"][1]))
    pairs = df.withColumns({"ha": G.histogram(F.col("a")), "hb": G.histogram(F.col("b"))})
    from vellum.scratch import Scratch, kept

    with kept():
        got = {(r.key, r.tie, r.score) for r in G.best_matches(pairs, ["key"], "tie", "containment", digits=6, scratch=Scratch(spark, "matches")).collect()}
    best = lambda k: max(((round(plain(a, b) / len(a), 6), -t) for j, t, a, b, _, _ in rows if j == k))
    assert got == {(k, -best(k)[1], best(k)[0]) for k in range(60)}
    assert tasks.value >= 4 and seen.value <= len(rows)
