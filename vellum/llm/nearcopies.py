"""Near copies by exact Jaccard similarity of their word shingles, at least four fifths.

A document is the set of its shingles' hashes; equal sets are one node. Put in
one order that holds for all documents, the shingles of two sets with a
similarity of ``4 / 5`` or more agree in one at least of their first
``m - ceil(4 m / 5) + 1`` (prefix filter), so nodes that share such a key are
the only candidates and no pair is lost. The order puts rare shingles first, as
counted in ``SLOTS`` counters, so what many documents share (a licence, a quoted
passage) is seldom a key, and the nodes of a key are few but for families of copies.
A counter is shared by about as many shingles as the corpus has for each; a passage
stands out once it is met more often than that.

SimHash comes first: sets whose fingerprints differ in ``BITS`` bits or fewer (``simhash``'s
Golay keys) are candidates whatever keys they share. Sets of that similarity may differ in
more bits (18 of 64, as measured), so the prefix filter finds the pairs that fingerprints miss.

A candidate pair is given up early only if it can't reach the similarity: by
its sizes, because the parities of hash classes (256, then ``WIDE`` or as many as a
long text needs) differ in more places than the sets may differ in shingles, or because
too few shingles follow on the key where it is met, were that the first they share (a pair
that reaches it is met at its first). The others are verified on the sets.
Sets are made from the texts each time and never written or shuffled: hashes
don't compress, and text does.

A large family of near copies would make a square of pairs. So each node is
compared with one of the smallest of its keys first; then only nodes of one key
that lie in different components are compared, those of the key's main
component never with each other, and again one pair of a node and a component
before the others. The components are those of all pairs.

Edge cases: a text with fewer words than a shingle is one shingle; null and
wordless texts are equal; a null ``doc_id`` is never chosen as a component's id
unless all ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import TEXT, giving_back, sliced, texts
from .components import components
from .rows import packed, unpacked
from ..scratch import Scratch
from .simhash import links as fingerprint_links
from .simhash import majority, shingle_hashes

#: Fingerprints that differ in so many bits at most are candidates.
BITS = 2
#: Counters of shingles, by the leading bits of their hash; a task sends those it has met, in rows of so many at most.
SLOT_BITS = 21
SLOTS, TOGETHER_SLOTS = 1 << SLOT_BITS, 1 << 10
#: Rows that say which texts are looked at again, broadcast at most (some 50 bytes a row); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000
PARITY = ["b0", "b1", "b2", "b3"]
#: Classes of the wide parities at least; a longer text has twice as many as shingles, in a power of two.
WIDE = 2048
#: Nodes of a key that say where its middle is.
SPOTS = 64
#: Pairs of one first text that are verified in one task.
TOGETHER = 256


def parities(sets: list[np.ndarray], n: int) -> np.ndarray:
    """For each set the parities of its members' counts in ``n`` classes, as longs."""
    odd = np.stack([np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n) & 1 for s in sets]).astype(np.uint8)
    return np.packbits(odd, axis=1).view(np.int64)


def classes(m: int) -> int:
    """How many classes the wide parities of a set have."""
    return max(WIDE, 1 << (2 * m - 1).bit_length()) if m else WIDE


def _sets(values: list[bytes], n_words: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(v, n_words), np.uint64)) for v in values]


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def rarity(texts: DataFrame, n_words: int) -> np.ndarray:
    """Eight times the binary logarithm of each slot's count, over the sets of all texts; ``texts`` has the text as bytes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(SLOTS, np.int32)
        for part in (x for b in batches for x in sliced(b, 0)):
            for s in _sets(part.column(0).to_pylist(), n_words):
                np.add.at(n, _slots(s), 1)
        for start in range(0, SLOTS, 128 * TOGETHER_SLOTS):
            some = np.flatnonzero(n[start : start + 128 * TOGETHER_SLOTS]) + start
            row = some // TOGETHER_SLOTS
            first = np.flatnonzero(np.diff(row, prepend=-1))
            cuts = list(zip(first.tolist(), np.append(first[1:], len(row)).tolist(), strict=True)) if len(first) else []
            cols = [pa.array([(some[a:b] % TOGETHER_SLOTS).astype(np.uint16).tobytes() for a, b in cuts], pa.binary()), pa.array([n[some[a:b]].tobytes() for a, b in cuts], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(row[first].astype(np.int32)), *cols], ["range", "slots", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, slots, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                own = total.setdefault(k, np.zeros(TOGETHER_SLOTS, np.int64))
                own[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(n.as_buffer(), np.int32)
        logs = [np.minimum(8 * np.log2(np.maximum(n, 1)), 255).astype(np.uint8).tobytes() for n in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(logs, pa.binary())], ["range", "logs"])

    parts = texts.select(TEXT).mapInArrow(giving_back(counted), "range int, slots binary, n binary").repartition("range").mapInArrow(summed, "range int, logs binary")
    out = np.zeros((SLOTS // TOGETHER_SLOTS, TOGETHER_SLOTS), np.uint8)
    for r in parts.collect():  # a byte for each slot
        out[r["range"]] = np.frombuffer(r.logs, np.uint8)
    return out.reshape(-1)


def shingle_heads(own: DataFrame, rare: np.ndarray, n_words: int) -> DataFrame:
    """``doc_id, th, node, m, fp, lead, b0 .. b3, wide, keys`` of ``own(doc_id, th, __text)``.

    A set's own hash, size and SimHash fingerprint, the parities of its 256 and of its ``classes``, and its first shingles in the common order.
    The lists are left out of rows whose set a row before in the task has (``lead`` is false), so that a frequent text has
    its keys once a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in (x for whole in batches for x in sliced(whole, 2)):
            sets = _sets(b.column(2).to_pylist(), n_words)
            m = np.fromiter(map(len, sets), np.int64, len(sets))
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = majority(np.concatenate(sets), m).view(np.int64)
            lead = np.array([not (k in met or met.add(k)) for k in node.tolist()])
            none = np.zeros(0, np.int64)
            parity, wide = parities(sets, 256), [parities([s], classes(len(s)))[0] if k else none for s, k in zip(sets, lead.tolist(), strict=True)]
            n_keys = np.where((m > 0) & lead, m - (4 * m + 4) // 5 + 1, 0)
            keys = [s[np.argsort(rare[_slots(s)], kind="stable")[:n]] for s, n in zip(sets, n_keys.tolist(), strict=True)]  # sorted by hash already
            starts = np.concatenate([[0], np.cumsum([len(w) for w in wide])]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(n_keys)]).astype(np.int32)
            cols = [node, m.astype(np.int32), fp, lead, *(np.ascontiguousarray(parity[:, k]) for k in range(4))]
            lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(wide))), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys).view(np.int64)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *map(pa.array, cols), *lists], ["doc_id", "th", "node", "m", "fp", "lead", *PARITY, "wide", "keys"])

    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(giving_back(run), f"doc_id {kind}, th long, node long, m int, fp long, lead boolean, b0 long, b1 long, b2 long, b3 long, wide array<long>, keys array<long>")


def fingerprint_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(u, v)`` of ``nodes(node, fp)``: links that give the same components as all pairs within ``BITS`` differing bits."""
    named = scratch.cut(nodes.groupBy("fp").agg(F.min("node").alias("first")), "fps")
    equal = nodes.join(named.hint("merge"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    near = fingerprint_links(named.select("fp"), scratch, BITS)
    for x, side in (("u", "a"), ("v", "b")):
        near = near.join(named.select(F.col("fp").alias(x), F.col("first").alias(side)).hint("merge"), x)
    return equal.unionByName(near.select("a", "b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _middles(met: DataFrame) -> DataFrame:
    """``key, node, m, b0 .. b3``: of each key the node whose parities are nearest to what most of its nodes have.

    Copies of one text differ from each other about twice as much as from it, so the middle of a family is similar to more of
    it than any other node. Most is judged by one node of each of ``SPOTS`` classes; any choice gives right results.
    """
    spots = met.groupBy("key", F.pmod(F.xxhash64("node"), F.lit(SPOTS)).alias("spot")).agg(F.min_by(F.struct(*PARITY), F.xxhash64("node")).alias("p"))
    votes = spots.groupBy("key").agg(F.collect_list("p").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                lists = b.column(1)
                bits = np.unpackbits(np.stack([lists.flatten().field(k).to_numpy() for k in range(4)], axis=1).view(np.uint8), axis=1)
                n = np.diff(lists.offsets.to_numpy())
                most = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int64) * 2 > n[:, None]
                words = np.packbits(most, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4))], ["key", *(f"c{k}" for k in range(4))])

    centre = votes.mapInArrow(run, "key long, c0 long, c1 long, c2 long, c3 long")
    far = sum((F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"c{k}"))) for k in range(4)), F.lit(0))
    own = met.join(centre, "key").groupBy("key").agg(F.min_by(F.struct("node", "m", *PARITY), F.struct(far, "node")).alias("x"))
    return own.select("key", "x.*")


def _nearest(pairs: DataFrame) -> DataFrame:
    """The pair with the fewest different parities of each node."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "differ"))
    return both.groupBy("v").agg(F.min_by("u", F.struct("differ", "u")).alias("u")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def _possible(pairs: DataFrame, *more: str) -> DataFrame:
    """Pairs of different nodes that may reach the similarity, once each; with ``differ`` on request."""
    differ = sum((F.bit_count(F.col(f"u_{b}").bitwiseXOR(F.col(f"v_{b}"))) for b in PARITY), F.lit(0))
    total = F.col("u_m") + F.col("v_m")
    fit = (5 * F.least("u_m", "v_m") >= 4 * F.greatest("u_m", "v_m")) & (9 * differ <= total)
    found = pairs.where(F.col("u") != F.col("v")).where(fit).withColumn("differ", differ)
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *more).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, own: DataFrame, n_words: int, scratch: Scratch) -> DataFrame:
    """The pairs with a similarity of four fifths or more.

    A text travels once for each pair it is the second of, to where the first one is; one that is the first of very many
    is copied to several tasks.
    """
    heads = sets.where("lead").select("node", "m", "wide").dropDuplicates(["node"])
    for x in ("u", "v"):
        pairs = pairs.join(heads.select(F.col("node").alias(x), F.col("m").alias(f"{x}_m"), F.col("wide").alias(f"{x}_wide")), x)
    half = lambda c: (F.size(c) / 2).cast("int")
    # classes are the hashes' last bits, so those of a set with twice as many fold
    folded = lambda c: F.zip_with(F.slice(c, F.lit(1), half(c)), F.slice(c, half(c) + 1, half(c)), lambda x, y: x.bitwiseXOR(y))
    a = F.when(F.size("u_wide") > F.size("v_wide"), folded("u_wide")).otherwise(F.col("u_wide"))
    b = F.when(F.size("v_wide") > F.size("u_wide"), folded("v_wide")).otherwise(F.col("v_wide"))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    pairs = scratch.cut(pairs.where(9 * differ <= F.col("u_m") + F.col("v_m")).select("u", "v"), "pairs")
    firsts = pairs.groupBy("u").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts"))
    seconds = pairs.join(firsts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("second"), F.col("v").alias("node"))
    asked = seconds.unionByName(firsts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("second"), F.col("u").alias("node")))
    nodes = asked.select("node").distinct()
    who = sets.select("node", "doc_id", "th").join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    want = scratch.cut(asked.join(who, "node").select("u", "part", "second", "node", F.col("x.doc_id").alias("w_id"), F.col("x.th").alias("w_th")), "wanted")
    few = want.count() <= BROADCAST_ROWS
    met = own.join(F.broadcast(want) if few else want, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("th") == F.col("w_th")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, base = None, np.zeros(0, np.uint64)
        for b in batches:
            found: tuple[list, list] = ([], [])
            for u, second, node, text in zip(*(b.column(k).to_pylist() for k in range(3)), b.column(3), strict=True):
                if second and u == first:
                    s = _sets([text.as_py()], n_words)[0]
                    same = len(np.intersect1d(base, s, assume_unique=True))
                    if 9 * same >= 4 * (len(base) + len(s)):
                        found[0].append(u)
                        found[1].append(node)
                elif not second and u != first:
                    first, base = u, _sets([text.as_py()], n_words)[0]
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["u", "v"])

    dealt = met.select("u", "second", "node", TEXT, "part").repartition("u", "part").sortWithinPartitions("u", "part", "second")
    return scratch.cut(dealt.drop("part").mapInArrow(giving_back(run), "u long, v long"), "links")


def _side(df: DataFrame, side: str, *more: str) -> DataFrame:
    return df.select("key", F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("m", *PARITY, *more)))


def links(sets: DataFrame, own: DataFrame, n_words: int, scratch: Scratch) -> DataFrame:
    """``(u, v)``: links between nodes that give the same components as all pairs of four fifths or more."""
    keyed = sets.where("lead").select("node", F.posexplode("keys").alias("place", "key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("many")).where("least < most").select("key", "least", "many")
    heads = sets.where("lead").select("node", "m", *PARITY).distinct()
    met = scratch.cut(keyed.join(shared, "key").select("key", "node", "place", "least", "many").distinct().join(heads, "node"), "met")
    # each node with the smallest of the least nodes of its keys, and with the nearest of their middles
    first = _possible(_side(met.where("node = least"), "u").join(_side(met.where("node > least"), "v"), "key"))
    middle = _possible(_side(_middles(met.where("many > 2")), "u").join(_side(met.where("many > 2"), "v"), "key"), "differ")
    pairs = first.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
    alike = fingerprint_pairs(sets.where("lead").select("node", "fp").distinct(), scratch)
    pairs = alike.unionByName(pairs).unionByName(_nearest(middle)).distinct()
    near = _verified(pairs, sets, own, n_words, scratch)
    roots = components(near, scratch, "merge")
    named = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = named.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("key", "main")
    apart = scratch.cut(named.join(main, "key"), "apart")
    others = scratch.cut(_others(apart), "others")
    # each node with one of each other component, then what still lies apart
    near = near.unionByName(_verified(_one_each(_apart(others, roots)), sets, own, n_words, scratch))
    return near.unionByName(_verified(_apart(others, components(near, scratch, "merge")).select("u", "v"), sets, own, n_words, scratch))


def _others(apart: DataFrame) -> DataFrame:
    """Pairs of nodes of one key in different components that may reach the similarity with this key as their first."""
    minor = _side(apart.where("root <> main"), "u", "root", "place")
    rest = lambda x: F.col(f"{x}_m") - F.col(f"{x}_place")
    met = minor.join(_side(apart, "v", "root", "place"), "key").where("u_root <> v_root")
    return _possible(met.where(9 * F.least(rest("u"), rest("v")) >= 4 * (F.col("u_m") + F.col("v_m"))))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """``u, v, u_root, v_root`` of the pairs whose nodes lie in different components."""
    for x in ("u", "v"):
        named = roots.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root"))
        pairs = pairs.join(named, x, "left").withColumn(f"{x}_root", F.coalesce(f"{x}_root", x))
    return pairs.where("u_root <> v_root")


def _one_each(pairs: DataFrame) -> DataFrame:
    """The first pair of each two components for each node on the left."""
    return pairs.groupBy("u", "v_root").agg(F.min("v").alias("v")).select("u", "v")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5) -> DataFrame:
    """``doc_id, component_id`` for each row: the smallest id that links of a similarity of four fifths or more reach."""
    scratch = Scratch(docs.sparkSession, "copies")
    own = texts(docs, id_col, text_col).select("doc_id", F.xxhash64(TEXT).alias("th"), TEXT)
    sets = scratch.cut(shingle_heads(own, rarity(own, n_words), n_words), "sets")
    roots = components(links(sets, own, n_words, scratch), scratch, "merge")
    rooted = sets.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = scratch.cut(rooted.join(ids, "root").select("doc_id", "component_id"), "groups")
    scratch.drop(sets)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Rows that repeat a kept id all stay; rows with a null id stay (nothing tells them apart).
    """
    groups = near_copy_groups(docs, id_col, text_col, **parameters)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    own = packed(docs, own=F.col(f"`{id_col}`"))
    return unpacked(own.join(gone.hint("merge"), F.col("own") == F.col("gone"), "left_anti"), docs.columns)
