"""Operators of the subpackage against brute force, on small fixtures and the smallest tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import decontaminate, linededup, packing, queries, reshard, rules, simhash, suffixes, tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def docs_of(spark, texts, first=1):
    rows = [(first + k if t != "null id" else None, t, "en", "s", None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark):
    """Nulls, empty and blank texts, repeated rows, ties, and further columns with names that the operators use themselves."""
    long = " ".join(f"w{k % 977}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (6, long), (7, long + " x"), (8, "é ü <|endoftext|> ¡"), (9, "word")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("fp", "key", "h", "j", "w", "n", "size", "score", "start", "length", "shard", "slot", "block", "__text", "__lines", "mark", "item_id", "root", "n_bytes"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def fingerprint(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 3 else [" ".join(words)] if words else []
    bits = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in bits if 2 * bits[b] > len(shingles))


def classes(items, linked):
    root = {k: k for k in items}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    keys = sorted(items)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if linked(items[a], items[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def test_op1_against_all_pairs(spark):
    prints = {r.doc_id: fingerprint(r.text or "") for r in table(spark, "documents").collect()}
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {k: (f"{f:016x}", want[k]) for k, f in prints.items()}
    assert len(set(want.values())) < len(want)


@pytest.mark.parametrize("bucket", [1, 32])
@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_lose_nothing(spark, bits, bucket):
    from vellum.llm.components import components
    from vellum.scratch import Scratch

    rng = random.Random(bits)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = {s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(40)} | set(seeds) | {0, (1 << 64) - 1}
    want = classes({f: f for f in fps}, lambda a, b: (a ^ b).bit_count() <= bits)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    scratch = Scratch(spark, "test")
    roots = {r.node % (1 << 64): r.root for r in components(simhash.links(df, scratch, bits, bucket), scratch).collect()}
    ours, theirs = {}, {}
    for f in fps:
        ours.setdefault(roots.get(f, f"single {f}"), set()).add(f)
        theirs.setdefault(want[f], set()).add(f)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def removed(texts, length, keep):
    """Bytes that go from each text, by a dictionary of all strings of that length."""
    seen = {}
    for d, t in enumerate(texts):
        for k in range(len(t) - length + 1):
            seen.setdefault(t[k : k + length], []).append((d, k))
    gone = [set() for _ in texts]
    for places in seen.values():
        for d, k in (sorted(places)[1:] if keep == "first" else places if len(places) > 1 else []):
            gone[d].update(range(k, k + length))
    return gone


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize(("hot", "hot_bytes"), [(8000, 4 << 20), (1, 4 << 20), (8000, 700)])
def test_op2_against_all_strings(spark, monkeypatch, keep, hot, hot_bytes):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "HOT_BYTES", hot_bytes)
    rng = random.Random(3)
    pick = lambda n, a="abcdefgh ": "".join(rng.choice(a) for _ in range(n))
    p, q = pick(230), pick(700)
    texts = ["", pick(150), p + pick(50), pick(40) + p, pick(30) + p[:199] + "!", q, q, "x" + q[100:450] + pick(20) + q[300:], "a" * 500, "ab" * 300, pick(300) + "aé" * 120, p[5:] + p, pick(2000)]
    texts += [pick(30) + "=" * (260 + 7 * k) + pick(30) for k in range(6)]  # one anchor, other lengths and neighbours
    got = {r.doc_id: r for r in suffixes.repeats(docs_of(spark, texts), length=200, keep=keep).collect()}
    raw = [t.encode() for t in texts]
    for k, (t, gone) in enumerate(zip(raw, removed(raw, 200, keep), strict=True), 1):
        assert {x for s in got[k].spans for x in range(s.start, s.stop)} == gone, k
        assert bytes(got[k].kept) == bytes(b for i, b in enumerate(t) if i not in gone) and got[k].n_bytes == len(t)


def test_op2_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, "documents").collect()}
    seen, gone = {}, {d: [] for d in texts}
    for d, t in texts.items():
        for k in range(len(t) - 199):
            h = t[k : k + 200]
            if h in seen:
                for e, i in {seen[h], (d, k)}:
                    gone[e].append(i)
            else:
                seen[h] = (d, k)
    for r in queries.op2_suffix_dedup(spark, SF).collect():
        t, keep = texts[r.doc_id], bytearray(b"\x01") * len(texts[r.doc_id])
        for k in gone[r.doc_id]:
            keep[k : k + 200] = bytes(200)
        left = bytes(b for b, x in zip(t, keep, strict=True) if x)
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), len(t) - len(left), len(re.findall(rb"\x00+", bytes(keep))))
        assert r.kept_sha256 == hashlib.sha256(left).hexdigest()


def shingles(text, n=5):
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} - {""}


def test_op3_against_exact_containment(spark):
    items = {r.item_id: shingles(r.text) for r in table(spark, "benchmark").collect()}
    want = set()
    for r in table(spark, "documents").collect():
        own = shingles(r.text or "")
        want |= {(r.doc_id, i, len(own & s), len(s)) for i, s in items.items() if s and len(own & s) / len(s) >= 0.8}
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in queries.op3_decontamination(spark, SF).collect()}
    assert got == want and want


def test_op4_and_op7_give_the_librarys_tokens(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    extra = ["", "  two  spaces \n\n x", "it's <|endoftext|> here", "ÉCOLE Straße 3.5, a.b, end.", "a b  c", "日本語 テキスト", "MIXED Case.\nNext, line. ", "don't , stop . ", "x" * 3000]
    docs = docs_of(spark, extra, 10**6).unionByName(table(spark, "documents").select("doc_id", "text", "lang", "source", "n_chars"))
    texts |= {10**6 + k: t for k, t in enumerate(extra)}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        n = len(lib.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024), r.doc_id
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*lib.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
    rows = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    at, sequences = Counter(), {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        own = ids[r.doc_id]
        assert (r.start, r.doc_tokens) == (at[r.doc_id], len(own)) and 0 < r.length <= 4096
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own[r.start : r.start + r.length]))
        at[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {d: len(x) for d, x in ids.items()}
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= 1.02 * sum(at.values()) / 4096 + 1


def test_op8_against_plain_counts(spark):
    def plain(text):
        words = WORD.findall(text)
        found = Counter(zip(words, words[1:], words[2:]))
        inside = {k + j for k, w in enumerate(zip(words, words[1:], words[2:])) if found[w] > 1 for j in range(3)}
        lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
        for x in lines:
            dup += x in seen
            seen.add(x)
        return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)

    texts = {r.doc_id: r.text or "" for r in table(spark, "documents").collect()}
    got = queries.op8_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dup, rep = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and not (r.base_failed and r.kept)
    entries = rules.ledger(table(spark, "documents")).cache()
    rows = {r.rule: r for r in rules.ablation(entries, "v2").collect()}
    bits = [r.failed for r in entries.collect()]
    for k, name in enumerate(rules.RULES):
        assert (rows[name].n_failed, rows[name].n_alone) == (sum(b >> k & 1 for b in bits), sum(b == 1 << k for b in bits))


def test_op9_law_and_flow(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in table(spark, "documents").collect()}
    rows = queries.op9_resharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    load, slots = Counter(), {}
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
        load[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    groups = {}
    for r in rows:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    flow = reshard.transfers([10, 2, 0], [4, 4, 4])
    assert sum(f for (a, b), f in flow.items() if a != b) == 6
    assert reshard.transfers([5, 7], [12]) == {(0, 0): 5, (1, 0): 7}


def plain_line_dedup(texts, min_words=50):
    """Every maximal run of lines with a word that two places share, by pairs of equal lines; the later place's lines go."""
    rows = {d: [(k, x, len(WORD.findall(x))) for k, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in sorted(texts.items())}
    places, gone = {}, {}
    for d, own in rows.items():
        for k, (_, x, _) in enumerate(own):
            places.setdefault(x, []).append((d, k))
    for at in places.values():
        for n, (e, j) in enumerate(at):
            for d, k in at[n + 1 :]:
                if j and k and rows[e][j - 1][1] == rows[d][k - 1][1]:
                    continue  # not the beginning of the run
                size = words = 0
                while j + size < len(rows[e]) and k + size < len(rows[d]) and rows[e][j + size][1] == rows[d][k + size][1]:
                    words += rows[d][k + size][2]
                    size += 1
                if words >= min_words:
                    gone.setdefault(d, set()).update(x for x, _, _ in rows[d][k : k + size])
    return {d: (t if d not in gone else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[d])) for d, t in texts.items()}


def test_op10_against_plain_runs(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents").collect()}
    want = plain_line_dedup(texts)
    got = {r.doc_id: r.text for r in linededup.line_dedup(table(spark, "documents")).collect()}
    assert got == want
    block = "\n".join(f"line {k} " + "w " * 20 for k in range(4))
    own = {1: block, 2: f"own start\n{block}\n\nown end", 3: f"{block}\n{block}", 4: "short\nshort\nshort", 5: None, 6: "", 7: block.split("\n")[0]}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.line_dedup(df).collect()}
    assert got == plain_line_dedup(own) and got[2] == "own start\n\nown end" and got[3] == "" and got[5] is None


def test_op10_takes_whole_runs(spark):
    """The end of a run goes with it, however short its lines; what differs stays; random texts over few lines agree with the pairs."""
    head = "L60 " + "w " * 60
    own = {1: f"{head}\nfive words in this line\nAAA", 2: f"{head}\nfive words in this line\nBBB", 3: f"xx\nfive words in this line\n{head}\nCCC"}
    rng = random.Random(11)
    lines = [f"k{k} " + "v " * n for k, n in enumerate((1, 3, 8, 20, 30, 60, 2, 12))]
    own |= {k: "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 12))) for k in range(4, 60)}
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(list(own.items()), "doc_id long, text string")).collect()}
    assert got == plain_line_dedup(own)
    assert got[2] == "BBB" and got[3] == "xx\nfive words in this line\nCCC"


def test_awkward_rows(spark):
    docs, items = awkward(spark), spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (2, None), (None, "w5 w6 w7 w8 w9 w10")], "item_id long, text string")
    n = docs.count()
    groups = {(r.doc_id, r.component_id) for r in simhash.simhash_groups(docs).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (7, 6)} <= groups
    assert simhash.simhash_groups(docs).count() == n and suffixes.repeats(docs).count() == n
    assert tokens.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).count() == n and rules.ledger(docs).count() == n
    assert packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).where("start = 0").count() == n
    assert reshard.reshard(docs).count() == n and linededup.line_dedup(docs).count() == n
    assert linededup.line_dedup(docs).columns[: len(docs.columns)] == docs.columns
    found = {(r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()}
    assert {(None, 1), (5, 1), (6, None), (7, None)} <= found and not any(i == 2 for _, i in found)
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()} == {1, 2, 3, 8, 9}


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert simhash.simhash_groups(none).count() == suffixes.repeats(none).count() == rules.ledger(none).count() == 0
    assert tokens.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert reshard.reshard(none).count() == linededup.line_dedup(none).count() == decontaminate.contained(none, items).count() == 0
    some = docs_of(spark, ["a b", "c"])
    assert decontaminate.drop_contaminated(some, items).count() == 2 and decontaminate.contained(none, some.select(F.col("doc_id").alias("item_id"), "text")).count() == 0
