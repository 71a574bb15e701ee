"""The search by token weights against sums over all pairs."""

import random

import pytest

from vellum.operators import postings as P
from vellum.operators import retrieval as R


def plain(queries, corpus, k):
    out = []
    for q, x in queries.items():
        rows = [(-round(sum(w * y[t] for t, w in x.items() if t in y), 6), c) for c, y in corpus.items() if set(x) & set(y)]
        out += [(q, c, -s + 0.0, n) for n, (s, c) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


def rows(spark, side, key, kind):
    return spark.createDataFrame([(i, t, w) for i, x in side.items() for t, w in x.items()], f"{key} {kind}, token string, weight double")


@pytest.mark.parametrize(("k", "parts", "first", "kind"), [(3, 1, 8, "long"), (5, 3, 40, "string"), (1000, 2, 1 << 14, "long")])
def test_against_all_pairs(spark, monkeypatch, k, parts, first, kind):
    """Small slices, so that queries end before their part does; copies, so that scores tie; weights of both signs."""
    rng = random.Random(k)
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    names = [f"t{n}" for n in range(40)]
    vec = lambda n: {t: rng.choice([0.5, 1.0, 2.0, -1.0]) for t in rng.sample(names, n)}
    corpus = {name(i): vec(rng.choice([1, 2, 5, 9, 30])) for i in range(300)}
    corpus |= {name(i): corpus[name(i % 7)] for i in range(300, 360)}
    queries = {name(i): vec(rng.choice([1, 4, 12])) for i in range(45)} | {name(99): {"unmet": 1.0}}
    monkeypatch.setattr(P, "BLOCK_ROWS", 10)
    run = P._searched

    def small(*a):
        def inner(batches):
            P.FIRST, P.LARGEST = first, 4 * first
            yield from run(*a)(batches)

        return inner

    monkeypatch.setattr(P, "_searched", small)
    out = P.searched(rows(spark, queries, "query_id", kind), rows(spark, corpus, "chunk_id", kind), k, parts=parts)
    met = sorted((r.query_id, r.chunk_id, r.score + 0.0, r["rank"]) for r in out.collect())
    assert met == plain(queries, corpus, k)


@pytest.mark.parametrize(("cells", "products", "dense", "kind"), [(1 << 21, 1 << 21, 1024, "long"), (64, 1 << 21, 3, "string"), (1 << 21, 50, 0, "long")])
def test_blocks_of_positive_weights(spark, monkeypatch, cells, products, dense, kind):
    """F2: queries are scored in blocks, by matrices and by lists; many copies tie, and few scores, products and rows are held at once."""
    rng = random.Random(cells + products + dense)
    name = (lambda i: i) if kind == "long" else (lambda i: f"d{i}")
    names = [f"t{n}" for n in range(60)]
    vec = lambda n: {t: rng.choice([0.5, 1.0, 2.0, 1.75]) for t in names[:n] if rng.random() < 0.8} | {rng.choice(names): 1.25}
    corpus = {name(i): vec(rng.choice([1, 2, 5, 9, 30, 60])) for i in range(300)}
    corpus |= {name(i): corpus[name(i % 7)] for i in range(300, 360)}
    queries = {name(i): vec(rng.choice([1, 4, 12, 40])) for i in range(45)} | {name(99): {"unmet": 1.0}}
    run = P._searched

    def small(*a):
        def inner(batches):
            P.FIRST, P.LARGEST, P.ROWS, P.CELLS, P.PRODUCTS, P.DENSE = 200, 800, 32, cells, products, dense
            yield from run(*a)(batches)

        return inner

    monkeypatch.setattr(P, "_searched", small)
    out = P.searched(rows(spark, queries, "query_id", kind), rows(spark, corpus, "chunk_id", kind), 4, parts=2)
    assert sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in out.collect()) == plain(queries, corpus, 4)


def test_no_row_for_a_shared_token_is_shuffled(spark):
    """All rows share one token with all queries: the plan joins no postings, and a part sends its best only."""
    corpus = {i: {"all": 1.0 + i % 5, f"t{i % 9}": 2.0} for i in range(500)}
    queries = {i: corpus[i] for i in range(0, 500, 10)}
    out = R.sparse_arm(rows(spark, queries, "query_id", "long"), rows(spark, corpus, "chunk_id", "long"), 4)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "MapInArrow" in plan and "qw" not in plan
    assert sorted((r.query_id, r.chunk_id, r.score + 0.0, r["rank"]) for r in out.collect()) == plain(queries, corpus, 4)


def test_empty_sides(spark):
    q, c = rows(spark, {1: {"a": 1.0}}, "query_id", "long"), rows(spark, {2: {"a": 1.0}}, "chunk_id", "long")
    assert P.searched(q.where("false"), c, 3).count() == 0 and P.searched(q, c.where("false"), 3).count() == 0
    assert P.searched(q, c, 3).count() == 1
