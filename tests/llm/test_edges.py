"""Clashing names, old layouts, long texts across every threshold, other vocabularies, and learners against plain versions."""

import random
from collections import Counter
from itertools import product
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import docs_of, plain_line_dedup, removed, table
from tokenizers import Tokenizer

from vellum import scratch
from vellum.llm import arrow, decontaminate, linededup, nearcopies, packing, quality, reshard, simhash, suffixes, tokens, toxicity

CLASHES = ("__row", "__gone", "__id", "__hash", "__lines", "__own", "__word", "__kept", "gone", "own", "doc", "lines", "kept", "word", "new", "text_hash", "own_id", "own_hash", "other_id", "other_hash", "n_lines",
           "n_removed", "score", "node", "root", "key", "part", "block", "sub", "size", "shard", "slot", "old_shard", "row_id", "k", "nth", "a.b", "y", "h")


def with_clashes(df):
    for n, name in enumerate(CLASHES):
        df = df.withColumn(name, F.concat(F.lit(f"{n} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return df


def test_further_columns_keep_their_values(spark, tmp_path):
    block = "\n".join(f"line {k} " + "w " * 20 for k in range(4))
    item = "some words of an item that must not be seen in training"
    texts = [block, f"start\n{block}\nend", None, "", f"x {item} y", "null id", "a b c d e f g", "a b c d e f g", block]
    docs = with_clashes(docs_of(spark, texts))
    docs = docs.unionByName(docs.where("doc_id = 7"))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 9)], "doc_id long, quality int, toxic int")
    every = [
        linededup.without_repeats(docs), linededup.line_dedup(docs).drop("__n_lines", "__n_removed"), nearcopies.keep_one(docs), simhash.keep_one(docs),
        decontaminate.drop_contaminated(docs, items), quality.drop_low_quality(docs, labels, threshold=0.0),
    ]
    reshard.rewrite(docs, str(tmp_path / "shards"), shards=2)
    every.append(spark.read.parquet(str(tmp_path / "shards")).drop("__shard", "__slot"))
    for out in every:
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{n} {r.doc_id if r.doc_id is not None else 'null'}" for n, c in enumerate(CLASHES))
    assert [df.count() for df in every] == [10, 10, every[2].count(), every[3].count(), 9, 10, 10]
    ids = [sorted(r.doc_id or 0 for r in df.collect()) for df in every]
    assert ids[2] == [0, 1, 3, 5, 7, 7] and ids[4] == [0, 1, 2, 3, 4, 7, 7, 8, 9]


def test_slices_of_a_batch():
    texts = [b"x" * n for n in (0, 5, 3, 0, 40, 1, 1, 9, 0)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array([b"zz", *texts], pa.binary())], ["k", "t"]).slice(1)
    for limit in (1, 6, 10, 1000):
        parts = list(arrow.sliced(whole, 1, limit))
        assert [x for p in parts for x in p.column(1).to_pylist()] == texts and [x for p in parts for x in p.column(0).to_pylist()] == list(range(1, 10))
        assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= limit for p in parts)
    assert not list(arrow.sliced(whole.slice(9), 1, 5))


def test_scratch_needs_a_shared_folder(spark):
    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Far)


def test_calls_leave_nothing_behind_once_released(spark):
    import os

    since = scratch.mark()
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "x"])
    assert linededup.line_dedup(docs).count() == nearcopies.near_copy_groups(docs).count() == 3
    folders = [c.base.removeprefix("file:") for c in scratch._CALLS[since:]]
    assert folders and any(map(os.path.exists, folders))
    scratch.release(since)
    assert not any(map(os.path.exists, folders)) and scratch.mark() == since
    with scratch.kept():
        held = scratch.Scratch(spark, "held")
        assert held.cut(spark.range(3)).count() == 3 and os.path.exists(held.base.removeprefix("file:"))
    assert not os.path.exists(held.base.removeprefix("file:")) and scratch.mark() == since


def moved(blocks, where):
    return sum(size for b, home, size in blocks if where[b] != home)


def test_plan_against_all_placements():
    """Blocks of one size: no placement within the capacities moves fewer bytes. Any sizes: the flow's minimum but for a block a shard."""
    rng = random.Random(4)
    for _ in range(60):
        shards, n = rng.randrange(2, 4), rng.randrange(1, 8)
        blocks = [(b, rng.randrange(0, 4), 10) for b in range(n)]
        capacity = [10 * (-(-n // shards)) for _ in range(shards)]
        where = reshard.plan(blocks, capacity)
        load = Counter(where.values())
        assert all(10 * load[j] <= capacity[j] for j in range(shards))
        best = min(moved(blocks, dict(enumerate(p))) for p in product(range(shards), repeat=n) if all(10 * p.count(j) <= capacity[j] for j in range(shards)))
        assert moved(blocks, where) == best
    for _ in range(60):
        shards = rng.randrange(2, 9)
        blocks = [(b, rng.randrange(0, 6), rng.choice((1, 3, 7, 40, 200))) for b in range(rng.randrange(1, 200))]
        total, largest = sum(b[2] for b in blocks), max(b[2] for b in blocks)
        capacity = [total // shards + (k < total % shards) for k in range(shards)]
        where = reshard.plan(blocks, capacity)
        load = [sum(s for b, _, s in blocks if where[b] == j) for j in range(shards)]
        assert max(load) <= max(capacity) + largest
        old = [sum(s for _, i, s in blocks if i == k) for k in range(6)]
        least = sum(f for (a, b), f in reshard.transfers(old, capacity).items() if a != b)
        assert moved(blocks, where) <= least + largest * (shards + 6)


def test_two_large_blocks_do_not_share_a_shard():
    blocks = [(0, 0, 90), (1, 0, 90), *((k, k % 3, 1) for k in range(2, 122))]
    where = reshard.plan(blocks, [100, 100, 100])
    assert where[0] != where[1]
    load = [sum(s for b, _, s in blocks if where[b] == j) for j in range(3)]
    assert max(load) <= 101


def test_loads_are_equal_and_only_what_must_is_split(spark):
    docs = table(spark, "documents")
    rows = reshard.reshard(docs).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) <= 1.02 * sum(load.values()) / 8 and len(load) == 8
    # a text of over half a shard stays whole, with all others of its block; one of more than a shard is dealt
    texts = ["large " * 100] * 60 + ["giant " * 100] * 400 + [f"other text {k} " * 40 for k in range(300)]
    for blocks in (1, 64, 4096):
        where, load = {}, Counter()
        for r in reshard.reshard(docs_of(spark, texts), blocks=blocks).collect():
            where.setdefault(texts[r.doc_id - 1], set()).add(r.shard)
            load[r.shard] += r.size
        assert len(where.pop("giant " * 100)) > 1 and all(len(s) == 1 for s in where.values())
        assert max(load.values()) <= 1.1 * sum(load.values()) / 8


def test_slots_of_many_small_rows(spark):
    """A third of all rows are empty: their block is small in bytes and long in rows, and is numbered in pieces."""
    texts = [""] * 700 + [f"text {k} " * 30 for k in range(1400)]
    rows = reshard.reshard(docs_of(spark, texts), blocks=256).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == 2100 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in rows if r.size == 1}) == 1


def test_old_layout_is_respected(spark):
    docs = docs_of(spark, [f"text number {k} " * (k % 7 + 1) for k in range(200)]).withColumn("at", F.pmod("doc_id", F.lit(4)).cast("int"))
    for together in (True, False):
        rows = reshard.reshard(docs, shards=4, old_col="at", together=together).collect()
        assert all(r.old_shard == r.doc_id % 4 for r in rows)
        old = [sum(r.size for r in rows if r.old_shard == k) for k in range(4)]
        total = sum(old)
        least = sum(f for (a, b), f in reshard.transfers(old, [total // 4 + (k < total % 4) for k in range(4)]).items() if a != b)
        blocks = Counter(r.block for r in docs.select(reshard.block_of("text").alias("block")).collect())
        mixed = sum(n - 1 for n in blocks.values()) if together else 0
        assert sum(r.size for r in rows if r.old_shard != r.shard) <= least + (4 + mixed) * max(r.size for r in rows)
    # nothing to do: nothing moves
    same = reshard.reshard(docs, shards=4, old_col="at", capacity=[max(old)] * 4, together=False).collect()
    assert all(r.shard == r.old_shard for r in same)


def test_rewrite_grows_shrinks_and_forgets_nothing(spark, tmp_path):
    path = str(tmp_path / "layout")
    texts = [f"text {k} " * (k % 9 + 1) for k in range(300)] + [None, "", "same", "same", "null id"]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["same", "another text of a repeated id"]))  # ids 1 and 2 twice
    want = sorted((repr(r.doc_id), repr(r.text)) for r in docs.collect())

    def state():
        rows = spark.read.parquet(path)
        assert sorted((repr(r.doc_id), repr(r.text)) for r in rows.collect()) == want
        slots = {}
        for r in rows.collect():
            slots.setdefault(r["__shard"], []).append(r["__slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        return rows

    reshard.rewrite(docs, path, shards=3)
    assert {r["__shard"] for r in state().collect()} == {0, 1, 2}
    for shards in (2, 5, 1):
        got = {r.shard: r.n_rows for r in reshard.rewrite(state(), path, shards=shards).collect()}
        spark.catalog.refreshByPath(path)
        assert {r["__shard"] for r in state().collect()} == set(range(shards)) and all(got[k] == 0 for k in got if k >= shards)
    assert reshard.rewrite(state(), path, shards=1).count() == 0  # nothing moves, no file is touched
    reshard.rewrite(docs.where("false"), str(tmp_path / "none"), shards=2)
    # from a table that doesn't know the layout: all is written anew, and shards that the new layout hasn't are gone
    for shards in (6, 2, 4):
        reshard.rewrite(docs, path, shards=shards)
        spark.catalog.refreshByPath(path)
        assert {r["__shard"] for r in state().collect()} == set(range(shards))


def test_pieces_of_a_frequent_text_are_dealt_alike(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 5 <> 0 THEN '' ELSE concat('word ', id) END AS text")
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), group_rows=100).collect()
    groups = Counter(r.sequence_id >> 24 for r in rows)
    empty = Counter(r.sequence_id >> 24 for r in rows if r.doc_tokens == 1)
    assert len(rows) == 3000 and len(groups) == 30 and max(groups.values()) < 200 and max(empty.values()) < 160


def plain_features(text):
    """Buckets of all features of a text, one by one."""
    mask, white = (1 << 64) - 1, b" \t\n\r\x0b\x0c"
    data, mix, out = text.replace(b"\n", b" \r "), 0x9E3779B97F4A7C15, []
    shift = 64 - quality.BITS
    for k in quality.NGRAMS:
        out += [((int.from_bytes(data[i : i + k], "little") + k) * mix & mask) >> shift for i in range(len(data) - k + 1)]
    power = [1]
    for _ in range(64):
        power.append(power[-1] * 0x100000001B3 & mask)
    words = []
    for w in bytes(32 if c in white else c for c in data).split(b" "):
        if w:
            words.append(sum((c + 1) * power[min(i, 63) + 1] for i, c in enumerate(w)) & mask)
    out += [(w * mix & mask) >> shift for w in words]
    for a, b in zip(words, words[1:]):
        pair = 0x51ED270B if a == b else (a * 3 & mask) ^ (b * 0x85EBCA6B & mask)
        out.append((pair * mix & mask) >> shift)
    return Counter(out)


def test_quality_features_and_score_against_a_plain_version(monkeypatch):
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(0, 1, 1 << quality.BITS), 0.3)
    texts = ["", "one", "one one two", "é ü\nx\t y  z", "word " * 50, "a\n\nb", " lead and trail ", "q" * 100 + " " + "r" * 70]
    texts += ["".join(rng.choice(list("abc \n\té"), 400)) for _ in range(5)]
    raw = [t.encode() for t in texts]

    def plain(v):
        f = plain_features(v)
        mean = sum(model.table[b] * n for b, n in f.items()) / max(1, sum(f.values()))
        return 1 / (1 + np.exp(-(model.bias + mean)))

    want = [plain(v) for v in raw]
    assert np.allclose(model.score(raw), want)
    for part in (1, 7, 64):  # however small the parts, the features are the whole text's
        monkeypatch.setattr(quality, "PART", part)
        total, count = model.sums(raw)
        assert count.tolist() == [sum(plain_features(v).values()) for v in raw] and np.allclose(model.score(raw), want)


def test_softmax_gradient_against_differences():
    rng = np.random.default_rng(5)
    sizes, y = np.array([3, 1, 4]), np.array([0, 1, 1])
    vectors, val, out, bias = rng.normal(0, 1, (8, 5)), rng.random(8), rng.normal(0, 1, (2, 5)), rng.normal(0, 1, 2)
    weight = np.array([0.5, 0.2, 0.3])

    def loss(vectors, out, bias):
        total, at = 0.0, 0
        for n, label, w in zip(sizes, y, weight):
            hidden = sum(val[k] * vectors[k] for k in range(at, at + n))
            scores = [np.exp(hidden @ out[c] + bias[c]) for c in (0, 1)]
            total -= w * np.log(scores[label] / sum(scores))
            at += n
        return total

    slope, out_slope, bias_slope, value = quality.gradient(vectors, val, sizes, y, weight, out, bias)
    assert np.isclose(value, loss(vectors, out, bias))
    doc, eps = np.repeat(np.arange(3), sizes), 1e-6
    for x, grad, place in ((vectors, val[:, None] * slope[doc], 0), (out, out_slope, 1), (bias, bias_slope, 2)):
        for at in np.ndindex(x.shape):
            args = [vectors.copy(), out.copy(), bias.copy()]
            args[place][at] += eps
            up = loss(*args)
            args[place][at] -= 2 * eps
            assert np.isclose((up - loss(*args)) / (2 * eps), grad[at], atol=1e-6)


@pytest.mark.parametrize("segment", [1, 2, 3, 256])
def test_chains_in_segments_are_whole_chains(monkeypatch, segment):
    """Marginals and counts of long chains in segments, against a plain forward-backward over each whole chain."""
    rng = np.random.default_rng(9)
    sizes, trans = np.array([7, 1, 12, 4, 300]), np.array([-0.5, -1.3, 0.2, 1.1])
    u = rng.normal(0, 1.5, sizes.sum())
    monkeypatch.setattr(toxicity, "SEGMENT", segment)
    got, counts = toxicity.Grid(sizes).expected(u, trans)
    y = (rng.random(sizes.sum()) < 0.4).astype(float)
    moves = toxicity._moves(toxicity.Grid(sizes), y)
    start, up, down, stay = np.exp(trans)
    want, at, total, plain = [], 0, np.zeros(4), np.zeros(4)
    for n in sizes:
        e = np.exp(u[at : at + n])
        step = np.array([[1.0, up], [down, stay]])
        fore, back = np.zeros((n, 2)), np.ones((n, 2))
        fore[0] = [1.0, start * e[0]]
        for t in range(1, n):
            fore[t] = (fore[t - 1] @ step) * [1.0, e[t]]
            fore[t] /= fore[t].sum()
        for t in range(n - 2, -1, -1):
            back[t] = step @ (back[t + 1] * [1.0, e[t + 1]])
            back[t] /= back[t].sum()
        p = fore * back
        want.append(p[:, 1] / p.sum(1))
        total[0] += want[-1][0]
        for t in range(1, n):
            both = fore[t - 1][:, None] * step * (back[t] * [1.0, e[t]])[None, :]
            total[1:] += (both / both.sum()).ravel()[1:]
        own = y[at : at + n]
        plain += [own[0], ((1 - own[:-1]) * own[1:]).sum(), (own[:-1] * (1 - own[1:])).sum(), (own[:-1] * own[1:]).sum()]
        at += n
    assert np.allclose(got, np.concatenate(want)) and np.allclose(counts, total) and np.allclose(moves, plain)


def test_sample_is_bounded_and_the_same_whatever_the_partitions(spark):
    docs = docs_of(spark, [f"text {k} " * (k + 1) for k in range(40)])
    docs = docs.unionByName(docs_of(spark, [f"second text of id {k}" for k in range(1, 41)]))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 41)] + [(3, 0), (3, 1), (4, None), (99, 1)], "doc_id long, quality int")
    once = quality.sample(docs, labels, "quality", "doc_id", "text", 4, 2, 100)
    again = quality.sample(docs.repartition(7, "text"), labels.repartition(3), "quality", "doc_id", "text", 4, 2, 100)
    assert once == again and len(once) == sum(crc32(str(k).encode()) % 4 != 2 for k in range(1, 41) if k != 3)
    assert sum(len(t) for t, _ in quality.sample(docs, labels, "quality", "doc_id", "text", 4, 2, 100, max_bytes=500)) <= 500
    assert len(quality.sample(docs, labels, "quality", "doc_id", "text", 4, 2, 5)) <= 10


@pytest.mark.parametrize("keep", ["none", "first"])
def test_repetitive_texts_make_few_stretches(spark, monkeypatch, keep):
    """Texts that repeat themselves, across the limits of a stretch and of a part."""
    assert len(suffixes.stretches(b"a" * 2_000_000, 200)) < 300 and len(suffixes.stretches(b"abcdefg hij" * 100_000, 200)) < 300
    monkeypatch.setattr(suffixes, "LONG", 64)
    texts = ["a" * 3000, "b" + "a" * 900 + "b", "abcdefg hij" * 200, "xyz " * 60 + "abcdefg hij" * 40, "unlike the others " + "0123456789" * 30]
    raw = [t.encode() for t in texts]
    for part in (1 << 22, 512):
        monkeypatch.setattr(suffixes, "_PART", part)
        got = {r.doc_id: r for r in suffixes.repeats(docs_of(spark, texts), length=200, keep=keep).collect()}
        for k, gone in enumerate(removed(raw, 200, keep), 1):
            assert {x for s in got[k].spans for x in range(s.start, s.stop)} == gone, (part, k)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_any_vocabulary_gives_the_librarys_ids(spark, name):
    path = public_tokenizers.path(name)
    texts = ["", "Some Words, here. and there.", "  two  spaces \n\n x", "it's <|endoftext|> 3.5", "ÉCOLE a.b, end.", "日本語 テキスト", "x" * 300]
    if name.endswith(".model"):
        import sentencepiece

        ids = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        ids = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    docs = docs_of(spark, texts)
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, path).collect()} == {k: len(x) for k, x in enumerate(ids, 1)}
    crcs = {k: crc32(np.array([*x, 2], "<u4").tobytes()) for k, x in enumerate(ids, 1)}
    assert {r.doc_id: r.ids_crc32 for r in packing.pack(docs, path).collect()} == crcs


def test_separable_is_read_from_the_file(tmp_path):
    import json

    for name, kind in (("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words"), ("piece_bpe_32k.model", "no")):
        assert tokens.separable(public_tokenizers.path(name)) == kind
    own = json.load(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8"))
    own["normalizer"]["normalizers"].pop()  # keeps the case
    (tmp_path / "own.json").write_text(json.dumps(own))
    assert tokens.separable(str(tmp_path / "own.json")) == "no"


def test_verification_without_broadcasts(spark, monkeypatch):
    """The shuffled ways of decontamination give what the broadcast ones give; items of one text count each."""
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    items = items.unionByName(items.where("item_id < 3").withColumn("item_id", F.col("item_id") + 10_000))
    key = lambda df: sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in df.collect())
    want = key(decontaminate.contained(docs, items))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert key(decontaminate.contained(docs, items)) == want and want


def test_line_dedup_on_a_text_of_many_lines(spark):
    rng = random.Random(8)
    lines = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 5) for _ in range(rng.randrange(1, 30))) for _ in range(2500)]
    own = {1: "\n".join(lines), 2: "\n".join(lines[700:900] + ["middle"] + lines[100:140]), 3: "one line without end " * 20_000}
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(own) and got[2] == "middle"


def test_spans_of_awkward_rows(spark):
    """Null, empty and repeated rows, clashing names: a row each, equal rows alike, offsets inside the text."""
    toxic = [f"you vile{k % 3} person number {k} vile{k % 3}" for k in range(40)]
    clean = [f"a kind word for person number {k}" for k in range(40)]
    model = toxicity.train([(t, 1) for t in toxic] + [(t, 0) for t in clean], 1.0)
    docs = docs_of(spark, [None, "", "null id", toxic[0], clean[0], " \n " + toxic[1]])
    docs = with_clashes(docs.unionByName(docs.where("doc_id = 4")).withColumn("spans", F.lit("clash")))
    rows = toxicity.toxic_spans(docs, model).collect()
    assert len(rows) == 7 and {r.doc_id for r in rows} == {None, 1, 2, 4, 5, 6}
    spans = {r.doc_id: [tuple(s) for s in r.spans] for r in rows}
    assert not spans[1] and not spans[2] and not spans[5] and spans[4] and spans[6]
    assert [[tuple(s) for s in r.spans] for r in rows if r.doc_id == 4] == [spans[4]] * 2
    text = " \n " + toxic[1]
    assert any("vile" in text[a:b] for a, b, _ in spans[6])
