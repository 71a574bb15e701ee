"""The two classifiers by held-out accuracy and by brute force, and the pipeline stage by stage."""

from itertools import product
from zlib import crc32

import numpy as np
import pyarrow.parquet as pq
import pytest
from test_llm import SCHEMA, SF, awkward, classes, docs_of, plain_line_dedup, shingles, table

import corpus_pipeline
from vellum.llm import quality, queries, toxicity

BIG = "/root/testdata/sf0.1"


def auc(rows):
    ranked = sorted(rows)
    rank = {}
    for k, (s, _) in enumerate(ranked):
        rank.setdefault(s, []).append(k + 1)
    good = [np.mean(rank[s]) for s, y in rows if y]
    n, m = len(good), len(rows) - len(good)
    return (sum(good) - n * (n + 1) / 2) / (n * m)


@pytest.mark.parametrize("name, label, folds, held, cut", [("op5_toxicity", "toxic", 5, 0, 0.5), ("op6_quality", "quality", 4, 2, 0.7)])
def test_held_out_accuracy(spark, name, label, folds, held, cut):
    labels = dict(zip(*(pq.read_table(f"{BIG}/labels.parquet")[c].to_pylist() for c in ("doc_id", label)), strict=True))
    rows = queries.QUERIES[name](spark, BIG).collect()
    assert len(rows) == pq.read_metadata(f"{BIG}/documents.parquet").num_rows
    for r in rows:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % folds == held) and 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
    own = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) in (0, 1)]
    right = np.mean([(s >= cut) == y for s, y in own])
    print(name, len(own), "held out, accuracy", right, "AUC", auc(own))
    assert right > 0.9 and auc(own) > 0.95


def test_field_against_all_labellings():
    """Marginals and expected counts of the chain, against the sum over every labelling."""
    rng = np.random.default_rng(1)
    sizes, trans = np.array([1, 4, 6, 3]), np.array([-0.7, -1.1, 0.4, 0.9])
    u = rng.normal(0, 1.5, sizes.sum())
    p, counts = toxicity.Grid(sizes).expected(u, trans)
    at, want, moves = 0, [], np.zeros(4)
    for n in sizes:
        own, total, marginal, sums = u[at : at + n], 0.0, np.zeros(n), np.zeros(4)
        for y in product((0, 1), repeat=int(n)):
            c = np.array([y[0], *(sum(z == w for z in zip(y, y[1:])) for w in ((0, 1), (1, 0), (1, 1)))], float)
            weight = np.exp(own @ np.array(y) + trans @ c)
            total, marginal, sums = total + weight, marginal + weight * np.array(y), sums + weight * c
        want.append(marginal / total)
        moves += sums / total
        at += n
    assert np.allclose(p, np.concatenate(want)) and np.allclose(counts, moves)
    assert np.allclose(toxicity.Grid(sizes).marginals(u, trans), p)


def test_toxic_spans_are_offsets(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = toxicity.fit(docs, labels)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.toxic_spans(docs, model).collect():
        for s in r.spans:
            assert 0 <= s.start < s.stop <= len(text[r.doc_id]) and s.p >= 0.5 and text[r.doc_id][s.start].isalnum()


def test_scoring_in_parts_is_the_whole():
    """A long text cut at white space loses no more than the features across the cuts; a batch scores as its texts do alone."""
    model = quality.Model(np.random.default_rng(0).normal(0, 1, 1 << quality.BITS), 0.1)
    values = [b"", b"one two", b"a\nb  c d", b"word " * 400, "é ü".encode()]
    assert np.allclose(model.score(values), [model.score([v])[0] for v in values])
    assert b"".join(quality.parts(b"ab cd " * 100, 64)) == b"ab cd " * 100


def test_awkward_rows_and_labels(spark):
    docs, none = awkward(spark), spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(2, 1, None), (5, 0, 1), (6, 1, 0), (None, 1, 1), (77, 0, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    void = some.where("false")
    one = some.where("quality = 1")
    for labels in (some, void, one):
        assert quality.quality_scores(docs, labels).where("score between 0 and 1").count() == docs.count()
        assert toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).where("score between 0 and 1").count() == docs.count()
        assert quality.quality_scores(none, labels).count() == toxicity.toxicity_scores(none, toxicity.fit(none, labels)).count() == 0
    assert {r.score for r in quality.quality_scores(docs, void).collect()} == {0.5}
    assert quality.drop_low_quality(docs, one).count() == docs.count()


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage after the classifier gives what a plain version gives on the same input."""
    docs, before = table(spark, "documents"), None
    cols = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        old, rows = {r.doc_id: r for r in docs.collect()}, out.collect()
        if k < 4:
            assert out.columns == cols and len({r.doc_id for r in rows}) == len(rows)
        new = {r.doc_id: r for r in rows} if k < 4 else {}
        if name == "quality_classifier":
            kept = {r.doc_id for r in quality.quality_scores(docs, table(spark, "labels")).where("predicted = 1").collect()}
            assert set(new) == kept and all(new[d] == old[d] for d in kept) and len(kept) < len(old)
        elif name == "line_dedup":
            assert {d: r.text for d, r in new.items()} == plain_line_dedup({d: r.text for d, r in old.items()})
            assert all(r.n_chars == len(r.text) for r in rows if r.text is not None)
        elif name == "simhash_dedup":
            found = classes({d: shingles(r.text or "") for d, r in old.items()}, lambda a, b: 9 * len(a & b) >= 4 * (len(a) + len(b)))
            assert set(new) == {d for d, c in found.items() if d == c}
        elif name == "benchmark_decontamination":
            items = [s for r in table(spark, "benchmark").collect() if (s := shingles(r.text))]
            assert set(new) == {d for d, r in old.items() if not any(len(shingles(r.text or "") & s) >= 0.8 * len(s) for s in items)}
        else:
            assert {r.doc_id for r in rows} == set(old) and all(sum(x.length for x in rows if x.doc_id == d) == next(x.doc_tokens for x in rows if x.doc_id == d) for d in list(old)[:20])
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_one_class_trains_nothing(spark):
    model = toxicity.train([("a b", 1), ("c", 1)], 1.0)
    assert (model.score(["x", ""]) == 0.5).all()
    assert docs_of(spark, ["x"]).count() == 1
