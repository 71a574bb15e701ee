"""Nearest vectors by blocks against all pairs, and the staged search against plain loops."""

import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import nearest as N
from vellum.operators import retrieval as R
from vellum.operators import tuning as T


def plain_nearest(queries, corpus, how, k, group):
    out = []
    for q, x in queries:
        if x is None:
            continue
        rows = []
        for c, y, g in corpus:
            if y is None:
                continue
            a, b = np.array(x), np.array(y)
            size = np.linalg.norm(a) * np.linalg.norm(b)
            if how == "cosine" and size == 0:
                continue
            rows.append((round(float(a @ b / size if how == "cosine" else -((a - b) ** 2).sum()), 6) + 0.0, c, g))
        rows.sort(key=lambda r: (-r[0], r[1]))
        seen: dict = {}
        for s, c, g in rows:
            key = g if group else 0
            seen[key] = seen.get(key, 0) + 1
            if seen[key] <= k:
                out.append((q, c, s, seen[key]))
    return sorted(out)


@pytest.mark.parametrize(("how", "k", "group", "parts"), [("cosine", 3, None, 4), ("euclidean", 7, None, 1), ("cosine", 2, "g", 3), ("euclidean", 500, None, 5)])
def test_nearest_against_all_pairs(spark, monkeypatch, how, k, group, parts):
    rng = random.Random(k)
    vec = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    corpus = [(c, vec() if c % 17 else None, rng.choice(["a", "b", None])) for c in range(300)] + [(300, [0.0, 0.0, 0.0], "a")]
    queries = [(q, vec() if q != 4 else None) for q in range(40)] + [(40, [0.0, 0.0, 0.0])]
    c = spark.createDataFrame(corpus, "chunk_id long, vec array<double>, g string").repartition(3)
    q = spark.createDataFrame(queries, "query_id long, qvec array<double>").repartition(2)
    out = N.nearest(q, c, how, k, group, parts=parts)
    got = sorted((r.query_id, r.chunk_id, r.score + 0.0, r["rank"]) for r in out.collect())
    assert got == plain_nearest(queries, corpus, how, k, group)


def test_a_part_takes_slices_and_sends_k_rows_a_query(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 10)
    rng = np.random.default_rng(3)
    part = N._Part(__import__("pyarrow").array(range(95)), __import__("pyarrow").array([0] * 95), np.round(rng.normal(size=(95, 4)), 1))
    q = np.round(rng.normal(size=(6, 4)), 1)
    rows, cols, vals = part.nearest(q, "cosine", 5, 6)
    assert len(rows) == 30
    s = np.round(N._scores(q, part.vectors, "cosine"), 6)
    for k in range(6):
        assert sorted(cols[rows == k].tolist()) == sorted(np.lexsort((np.arange(95), -s[k]))[:5].tolist())
    c = spark.range(2000).select(F.col("id").alias("chunk_id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    asked = spark.range(700).select(F.col("id").alias("query_id"), F.array(F.rand(3), F.rand(4)).alias("qvec"))
    found = N.nearest(asked, c, "cosine", 4, parts=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert found.count() == 2800


def test_empty_sides(spark):
    c = spark.createDataFrame([(1, [1.0])], "chunk_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, qvec array<double>")
    assert N.nearest(q, c.limit(0), "cosine", 3).count() == 0 == N.nearest(q.limit(0), c, "cosine", 3).count()


def plain_metrics(raw, relevant, s):
    queries = sorted({q for q, _ in relevant})
    rr, hits = 0.0, {1: 0, 3: 0, 10: 0}
    for q in queries:
        rows = [(round(s["alpha"] / (s["rrf_k"] + rd) + (1 - s["alpha"]) / (s["rrf_k"] + rs), 9), c, x) for o, c, rd, rs, x in raw if o == q]
        rows = sorted(rows, key=lambda r: (-r[0], r[1]))[: s["fetch_k"]]
        if s["rerank_k"]:
            rows = [(x, c, x) for _, c, x in rows[: s["rerank_k"]]]
        passing = [r for r in rows if s["least"] is None or (r[0] is not None and r[0] >= s["least"])]
        rows = sorted(passing or rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))[:10]
        first = next((k for k, r in enumerate(rows, 1) if (q, r[1]) in relevant), None)
        rr += 1 / first if first else 0
        for k in hits:
            hits[k] += bool(first and first <= k)
    return [round(rr / len(queries), 6), *(round(v / len(queries), 6) for v in hits.values())]


def test_the_staged_search_against_plain_loops(spark):
    rng = random.Random(11)
    raw = [(q, c, rng.randint(1, 40), rng.randint(1, 40), rng.choice([None, *(round(rng.random(), 2) for _ in range(4))])) for q in range(8) for c in range(30)]
    relevant = {(q, rng.randrange(30)) for q in range(9) for _ in range(2)}  # one query has no result
    stages = [{"alpha": [0.2, 0.6, 1.0], "rrf_k": [1, 50]}, {"fetch_k": [4, 12, 25], "rerank_k": [0, 5, 15]}, {"least": [None, 0.4, 0.8]}]
    chosen, want = dict(T.DEFAULTS), []
    for n, stage in enumerate(stages, 1):
        tried = [s for s in ({**chosen, **dict(zip(stage, v, strict=True))} for v in product(*stage.values())) if s["rerank_k"] <= s["fetch_k"]]
        met = [plain_metrics(raw, relevant, s) for s in tried]
        place = max(range(len(tried)), key=lambda k: (met[k][0], met[k][2], -k))
        want += [(n, *s.values(), *m, k == place) for k, (s, m) in enumerate(zip(tried, met, strict=True))]
        chosen = tried[place]
    made = T.staged_search(
        spark.createDataFrame(raw, "query_id long, chunk_id long, rd int, rs int, rescored double"),
        spark.createDataFrame(sorted(relevant), "query_id long, chunk_id long"), stages, by=("mrr", "recall_3"),
    )
    rows = [tuple(r) for r in made.collect()]
    assert len(rows) == 6 + 6 + 3 < 3 * 2 * 8 * 3
    assert rows == want
    assert len({r[6] for r in rows}) > 5


def test_words_of_documents_are_not_broadcast(spark):
    """Their file is small for its rows (few different words), so its size says nothing about a broadcast's."""
    rng = random.Random(2)
    names = [f"w{k}" for k in range(30)]
    docs = {d: set(rng.sample(names, rng.randrange(12))) for d in range(200)}
    items = {i: set(rng.sample(names, rng.randrange(1, 6))) for i in range(20)}
    side = lambda m, key: spark.createDataFrame([(k, w) for k, ws in m.items() for w in ws], f"{key} long, word string")
    out = R.word_containment(side(docs, "doc_id"), side(items, "item_id"), "doc_id", "item_id", 0.5)
    assert out._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") >= 2
    want = {(d, i, round(len(a & b) / len(b), 6)) for d, a in docs.items() for i, b in items.items() if 2 * len(a & b) >= len(b)}
    assert {(r.doc_id, r.item_id, r.score) for r in out.collect()} == want and want


def test_relevant_pairs_of_the_ranks_suffice(spark):
    """The same figures from the pairs that were found and the queries that have any, as from all pairs of a label."""
    from vellum.plans import retrieval as L

    rng = random.Random(4)
    c = spark.createDataFrame([(i, rng.choice("abc") if i % 10 else (None if i == 20 else "z" if i == 30 else "a")) for i in range(80)], "chunk_id long, label string")
    q = c.where("chunk_id % 5 = 0").selectExpr("chunk_id as query_id", "label as qlabel")
    pairs = [(i, j) for i in range(0, 80, 5) for j in rng.sample(range(80), 9) if i != j]
    raw = spark.createDataFrame([(i, j, rng.randrange(1, 9), rng.randrange(1, 9), None) for i, j in pairs], "query_id long, chunk_id long, rd int, rs int, rescored double")
    every, few = L._relevant(q, c), L._relevant_of(raw, q, c)
    assert few.count() < every.count() / 3
    assert {r.query_id for r in L._asked(q, c).collect()} == {r.query_id for r in every.select("query_id").distinct().collect()} == set(range(0, 80, 5)) - {20, 30}
    settings = [{**T.DEFAULTS, "alpha": a, "fetch_k": 5} for a in (0.0, 0.4, 1.0)]
    assert sorted(map(tuple, T.evaluated(raw, few, settings, asked=L._asked(q, c)).collect())) == sorted(map(tuple, T.evaluated(raw, every, settings).collect()))
