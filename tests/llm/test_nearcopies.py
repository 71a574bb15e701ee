"""The pipeline's near-copy stage against the Jaccard similarity of all pairs."""

import random

from test_llm import SF, awkward, classes, docs_of, shingles, table

import corpus_pipeline
from vellum.llm import nearcopies


def alike(a, b):
    n = len(a & b)
    return 5 * n >= 4 * (len(a) + len(b) - n)


def kept(spark, docs):
    return {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, SF).collect()}


def test_stage_against_all_pairs(spark):
    docs = table(spark, "documents")
    found = classes({r.doc_id: shingles(r.text or "") for r in docs.collect()}, alike)
    assert kept(spark, docs) == {d for d, c in found.items() if d == c}


def test_families_chains_and_edges(spark):
    """Copies with words changed, chains whose ends differ, a passage that all share, and sets at exactly four fifths."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    passage, texts = [word() for _ in range(30)], ["", " \n", "one two", "One  TWO", "a b c d e", "a b c d f"]
    for size in (20, 60, 200):
        base = [word() for _ in range(size)] + passage
        texts += [" ".join(base)] * 2
        for n in (1, 1, 1, 2, 2, 3, 5, 9):
            own = list(base)
            for k in rng.sample(range(len(own)), n):
                own[k] = word()
            texts.append(" ".join(own))
        for _ in range(6):  # each a little different from the one before
            base = base[2:] + [word(), word()]
            texts.append(" ".join(base))
    run = [f"e{k}" for k in range(22)]
    texts += [" ".join(run[:22]), " ".join(run[2:20]), " ".join(run[:20] + ["x", "y"])]  # 14 of 18 shingles, 16 of 20
    texts += [" ".join(f"f{k}" for k in range(n)) for n in (9, 8, 14, 12)]  # 4 of 5, 8 of 10
    found = classes(dict(enumerate(map(shingles, texts), 1)), alike)
    assert 10 < len(set(found.values())) < len(found) - 20
    assert kept(spark, docs_of(spark, texts)) == {d for d, c in found.items() if d == c}


def test_long_texts_of_unequal_classes(spark):
    """Sets on both sides of the size from which the parities have more classes, near and far."""
    rng = random.Random(7)
    base = [f"b{k}" for k in range(1300)]
    texts = [" ".join(base[:n]) for n in (900, 1020, 1030, 1100, 1290)] + [" ".join(base[n:]) for n in (30, 200, 400)]
    own = base[:1028]
    for k in rng.sample(range(1028), 20):
        own[k] = "x"
    texts += [" ".join(own), " ".join(reversed(base[:1028])), "short text"]
    assert {nearcopies.classes(n - 4) for n in (900, 1020, 1030, 1100)} == {2048, 4096}
    found = classes(dict(enumerate(map(shingles, texts), 1)), alike)
    assert 2 < len(set(found.values())) < len(found) - 3
    assert kept(spark, docs_of(spark, texts)) == {d for d, c in found.items() if d == c}


def test_a_third_of_equal_texts_and_a_passage_of_all(spark):
    """A frequent text has its keys once a task, and what all texts share is no key."""
    rng = random.Random(9)
    passage = [f"p{k}" for k in range(60)]
    texts = [" ".join(f"h{k}" for k in range(40))] * 400
    texts += [" ".join([f"u{rng.randrange(10**6)}" for _ in range(80)] + passage + [f"v{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(800)]
    docs = docs_of(spark, texts).repartition(4)
    own = nearcopies.texts(docs, "doc_id", "text").select("doc_id", nearcopies.F.xxhash64(nearcopies.TEXT).alias("th"), nearcopies.TEXT)
    heads = nearcopies.shingle_heads(own, nearcopies.rarity(own, 5), 5)
    keys = heads.select("node", nearcopies.F.explode("keys").alias("key"))
    counts = keys.groupBy("key").agg(nearcopies.F.count_distinct("node").alias("nodes"), nearcopies.F.count("*").alias("rows"))
    assert counts.agg({"nodes": "max"}).first()[0] <= 3 and counts.agg({"rows": "max"}).first()[0] <= 4
    assert kept(spark, docs) == {1, *range(401, 1201)}


def test_awkward_rows_and_empty_table(spark):
    docs = awkward(spark)
    assert nearcopies.near_copy_groups(docs).count() == docs.count()
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (7, 6)} <= {(r.doc_id, r.component_id) for r in nearcopies.near_copy_groups(docs).collect()}
    assert nearcopies.keep_one(docs.where("false")).count() == 0


def test_fingerprints_link_what_all_pairs_link(spark):
    """The stage has fingerprints, of the shingle sets, and their pairs are those within two bits."""
    rng = random.Random(11)
    words = [f"s{k}" for k in range(400)]
    texts = [" ".join(words), " ".join(words).upper(), "", "one", " ".join(reversed(words))]
    for _ in range(30):
        own = list(words)
        own[rng.randrange(400)] = "x"
        texts.append(" ".join(own))
    own = nearcopies.texts(docs_of(spark, texts), "doc_id", "text").select("doc_id", nearcopies.F.xxhash64(nearcopies.TEXT).alias("th"), nearcopies.TEXT)
    rows = nearcopies.shingle_heads(own, nearcopies.rarity(own, 5), 5).select("node", "fp").distinct()
    fps = {r.node: r.fp & (1 << 64) - 1 for r in rows.collect()}
    bits = lambda a, b: (a ^ b).bit_count()
    found = classes(fps, lambda a, b: bits(a, b) <= nearcopies.BITS)
    pairs = [(r.u, r.v) for r in nearcopies.fingerprint_pairs(rows, nearcopies.Scratch(spark, "test")).collect()]
    assert pairs and all(u < v and bits(fps[u], fps[v]) <= nearcopies.BITS for u, v in pairs)
    own = {n: n for n in fps}
    for _ in fps:
        for u, v in pairs:
            own[u] = own[v] = min(own[u], own[v])
    assert own == found


def test_long_texts_with_a_long_passage_make_no_pairs(spark):
    """Sets of 1196 shingles of which 996 are common: too unlike, though the parities of 256 classes can't tell."""
    passage = [f"p{k}" for k in range(1000)]
    texts = [" ".join([f"u{n}_{k}" for k in range(200)] + passage) for n in range(40)]
    docs = docs_of(spark, texts)
    own = nearcopies.texts(docs, "doc_id", "text").select("doc_id", nearcopies.F.xxhash64(nearcopies.TEXT).alias("th"), nearcopies.TEXT)
    heads = nearcopies.shingle_heads(own, nearcopies.rarity(own, 5), 5).select("node", "m", *nearcopies.PARITY, nearcopies.F.posexplode("keys").alias("place", "key"))
    apart = heads.withColumn("root", nearcopies.F.col("node")).withColumn("main", nearcopies.F.lit(0))
    assert apart.groupBy("key").count().where("count = 40").count() >= 10
    assert nearcopies._others(apart).count() == 0
    assert kept(spark, docs) == set(range(1, 41))
