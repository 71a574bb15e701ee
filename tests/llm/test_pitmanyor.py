"""Language model: seatings against exact sums and a plain sampler, scores against plain sums over the model's tables."""

import math
import random
from collections import Counter, defaultdict
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import awkward

from vellum.llm import pitmanyor as py
from vellum.llm import seating


def test_stirling_numbers_against_all_seatings():
    def seatings(c, d):
        """Sums over all partitions of c customers, by number of tables, of the product of each table's (1 - d)(2 - d)..."""
        out = Counter()

        def seat(k, tables, weight):
            if k == c:
                out[len(tables)] += weight
                return
            for j in range(len(tables)):
                tables[j] += 1
                seat(k + 1, tables, weight * (tables[j] - 1 - d))
                tables[j] -= 1
            seat(k + 1, [*tables, 1], weight)

        seat(0, [], 1.0)
        return out

    for d in (0.2, 0.8):
        for t, v in seatings(7, d).items():
            assert math.isclose(math.exp(seating.log_stirling(d)[7, t]), v, rel_tol=1e-9)


@pytest.mark.parametrize("d", [0.3, 0.6, 0.8, 0.9])
def test_stirling_numbers_of_many_customers(d):
    c = 500
    t = np.arange(1.0, c - 5)
    far = seating.log_stirling_far(np.full(len(t), float(c)), t, d)
    known = seating.log_stirling(d)[c, 1 : c - 5]
    assert np.abs(far - known).max() < 0.05
    assert np.abs(np.diff(far - known)).max() < 0.04


def test_seatings_are_drawn_from_their_conditional():
    rng, n, c, others, p, s, d = np.random.default_rng(1), 20_000, 9, 4.0, 0.2, 0.7, 0.6
    made = seating.draw(np.full(n, c), np.ones(n, int), np.full(n, others), np.full(n, p), s, d, rng)
    w = [math.exp(seating.log_stirling(d)[c, t]) * math.prod((s + d * (others + i)) * p for i in range(t)) for t in range(1, c + 1)]
    got = np.bincount(made, minlength=c + 1)[1:] / n
    assert np.abs(got - np.array(w) / sum(w)).max() < 0.012


def test_the_walk_for_many_customers_has_the_same_conditional():
    rng, n, c = np.random.default_rng(2), 3000, 400
    args = (np.full(n, 300.0), np.full(n, 0.05), 1.0, 0.7)
    exact = seating.draw(np.full(n, c), np.ones(n, int), *args, rng)
    walked = np.full(n, 5)
    for _ in range(4):
        walked = seating._moved(np.full(n, c), walked, *args, rng)
    assert abs(exact.mean() - walked.mean()) < 0.05 * exact.mean() and abs(exact.std() - walked.std()) < 0.12 * exact.std()


def words(text):
    return [*(text or "").encode().lower().split(), None]


def plain_model(texts, d, s, sweeps, burn, seed):
    """Customers seated one by one in restaurants of two levels; mean predictive probabilities."""
    rng = random.Random(seed)
    rest = defaultdict(lambda: defaultdict(list))  # context -> dish -> sizes of tables; the parent is "top"
    vocab = {w for t in texts for w in words(t)}
    base = 1 / (len(vocab) + 1)

    def stats(u):
        return sum(map(sum, rest[u].values())), sum(map(len, rest[u].values()))

    def prob(u, w):
        k = 0 if u == "top" else 1
        c, t = stats(u)
        up = base if u == "top" else prob("top", w)
        own = rest[u].get(w, [])
        return (sum(own) - d[k] * len(own) + (s[k] + d[k] * t) * up) / (s[k] + c)

    def add(u, w):
        k = 0 if u == "top" else 1
        up = base if u == "top" else prob("top", w)
        sizes = rest[u][w]
        weights = [x - d[k] for x in sizes] + [(s[k] + d[k] * stats(u)[1]) * up]
        j = rng.choices(range(len(weights)), weights)[0]
        if j < len(sizes):
            sizes[j] += 1
        else:
            sizes.append(1)
            if u != "top":
                add("top", w)

    def remove(u, w):
        sizes = rest[u][w]
        j = rng.choices(range(len(sizes)), sizes)[0]
        sizes[j] -= 1
        if not sizes[j]:
            sizes.pop(j)
            if u != "top":
                remove("top", w)

    pairs = [(("start",) if a == "start" else a, b) for t in texts for a, b in pairwise(["start", *words(t)])]
    for u, w in pairs:
        add(u, w)
    mean = Counter()
    asked = sorted(set(pairs), key=repr) + [(u, "no such word") for u in sorted({u for u, _ in pairs}, key=repr)]
    for k in range(sweeps):
        for u, w in pairs:
            remove(u, w)
            add(u, w)
        if k >= burn:
            for u, w in asked:
                mean[u, w] += prob(u, w) / (sweeps - burn)
    return mean


TEXTS = ["the cat sat on the mat", "the cat sat on the dog", "the dog ran", "a dog ran on the mat", "The cat ran", "", None, "a cat", "the the the cat"] * 3 + ["one lone line"]


def tables(model):
    """A, B and P of a model, by hashes."""
    a, b, p = {}, {}, {}
    kinds = defaultdict(lambda: defaultdict(list))
    for r in py._model_rows(model).collect():
        kinds[r.at][r.kind].append((r.part, None if r.k is None else np.array(r.k, np.int64).view(np.uint64), None if r.i is None else np.array(r.i, np.int32), None if r.x is None else np.array(r.x)))
    for got in kinds.values():
        for v in got.values():
            v.sort(key=lambda x: x[0])
        rest = py.Restaurants(got, model.state)
        aa, bb = (x / model.samples for x in rest.counted())
        b |= dict(zip(rest.words.tolist(), bb.tolist(), strict=True))
        for u, w, x in zip(rest.words[rest.place].tolist(), rest.w.tolist(), aa.tolist(), strict=True):
            a[u, w] = x
        place = py._one(got, "s", 2, np.int64)
        for j, w in zip(place.tolist(), py._one(got, "s", 1, np.uint64).tolist(), strict=True):
            a[int(rest.words[j]), w] = (1 - model.state.d1) / (model.state.s1 + rest.whole[j])
    got = defaultdict(lambda: defaultdict(list))
    for r in model.words.where("kind = 'w'").unionByName(model.parent.where("kind in ('k', 't')")).collect():
        got[r.at][r.kind].append((0, np.array(r.k, np.int64).view(np.uint64), None, None if r.x is None else np.array(r.x)))
    for g in got.values():
        p |= dict(zip(py._one(g, "w", 1, np.uint64).tolist(), py._mean(g, model.state, model.samples).tolist(), strict=True))
    return a, b, p


def hashed(w):
    return int(py.END) if w is None else int(py.token_hashes(pa.array([w], pa.binary()))[0][0])


def test_tokens_are_the_words(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abAB \t\n\x0b\x1c\x00é") for _ in range(rng.randint(0, 60))).encode() for _ in range(300)] + [b"", b" ", b"x" * 1000, b"a " * 500 + b"Q" * 700]
    plain = [[*t.lower().split(), None] for t in texts]
    for segment in (1 << 18, 64, 7):
        monkeypatch.setattr(py, "SEGMENT", segment)
        for part in (pa.array(texts, pa.binary()), pa.array([b"zz z"] + texts, pa.binary()).slice(1)):
            got, sizes = py.token_hashes(part)
            assert sizes.tolist() == list(map(len, plain))
            flat = [w for ws in plain for w in ws]
            by = dict(zip(flat, got.tolist(), strict=True))
            assert [by[w] for w in flat] == got.tolist() and len(set(by.values())) == len(by)


def probability(found, unknown, u, w):
    a, b, p = found
    u = int(py.START) if u == "start" else hashed(u)
    return a.get((u, hashed(w)), 0.0) + b.get(u, 1.0) * p.get(hashed(w), unknown)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    texts = TEXTS + [" ".join(rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(1, 30))) for _ in range(60)] + ["q " * 900, "q q z " * 400]
    rows = [(k if k != 3 else None, t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("shards", "flush", "sample"), [(None, 2_000_000, 1 << 20), (7, 40, 1 << 20), (16, 300, 1 << 20)])
def test_scores_are_sums_over_the_model(spark, corpus, shards, flush, sample):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = py.fit(corpus.where(~held), shards=shards, flush=flush, sample_bytes=sample)
    assert bool(len(model.layout.cut)) == (shards is not None) and bool(model.frequent) == (shards == 16)
    found, unknown = tables(model), 10**model.unknown
    a, b, p = found
    assert math.isclose(sum(p.values()) + unknown, 1, rel_tol=1e-9)
    by = Counter()
    for (u, _), x in a.items():
        by[u] += x
    assert by.keys() == b.keys() and all(math.isclose(by[u] + b[u], 1, rel_tol=1e-9) for u in b)
    rows = corpus.collect()
    learn = [r for r in rows if not (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 7 == 2)]
    counts = Counter(w for r in learn for w in words(r.text))
    n, v = sum(counts.values()), len(counts)
    want = []
    for r in rows:
        ws = words(r.text)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        score = sum(math.log10(probability(found, unknown, u, w)) for u, w in pairwise(["start", *ws]))
        want.append((r.doc_id or -1, r not in learn, len(ws), sum(w in counts for w in ws), n, round(base, 6), round(score, 6)))
    out = [(r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in py.held_out_scores(corpus, shards=shards, flush=flush, sample_bytes=sample).collect()]
    assert sorted(out) == sorted(want)


def test_the_model_is_that_of_a_plain_sampler(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    model = py.fit(docs, shards=3, samples=12, burn=4)
    found, unknown = tables(model), 10**model.unknown
    st = model.state
    plain = plain_model(TEXTS, (st.d0, st.d1), (st.s0, st.s1), 160, 20, 1)
    for (u, w), x in plain.items():
        u, w = ("start" if u == ("start",) else u), (b"?" if w == "no such word" else w)
        assert abs(probability(found, unknown, u, w) - x) < 0.02 + 0.12 * x, (u, w)


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    out = py.held_out_scores(docs)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = out.collect()
    assert len(rows) == 10 and all(r.score <= 0 and r.base_score <= 0 and r.n_known <= r.n_tokens for r in rows)
    assert py.held_out_scores(docs.limit(0)).count() == 0
    none = py.scores(py.fit(docs.limit(0)), docs, F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in none) and len(none) == 10


def test_a_seed_fixes_the_scores(spark, corpus):
    once, again = (sorted((r.doc_id or -1, r.score) for r in py.held_out_scores(corpus, shards=4, flush=100).collect()) for _ in range(2))
    assert once == again
