"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's 64-bit fingerprint is cut into three segments. Two fingerprints
that differ in at most two bits agree wholly in one segment at least
(pigeonhole), and differ by at most two bits in the segment after it. Each
segment is decoded with the perfect [23, 12, 7] Golay code to the indices of
the codewords that lie around it, one or six of them, such that two words at
distance two or less always have an index in common. A key is thus an equal
segment plus one index of the next one: about sixteen keys a fingerprint, and
no pair of linked fingerprints without a common key.

Only distinct fingerprints take part, so copies cost one row each. Buckets of
up to ``BUCKET`` fingerprints are joined pairwise and verified. A larger bucket
would make a square of pairs; its fingerprints are linked through the points
at distance one around them instead. All fingerprints that share such a point
are within two bits of each other and any two linked ones share one, so a star
to the smallest of them loses no link.

Edge cases: null or wordless texts have fingerprint zero and are linked like
any other; a null ``doc_id`` is kept and never chosen as a component's id
unless all ids are null; repeated rows each give a row; an empty table gives
an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts, texts
from .components import components
from .rows import packed, unpacked
from ..scratch import Scratch

SEED = 42
#: Widths of the segments from the lowest bit on.
SEGMENTS = (22, 21, 21)
#: Up to so many fingerprints of a bucket are compared pairwise.
BUCKET = 32
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the Golay code.
GENERATOR = 0b110001110101
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, n_words: int = 3) -> list[int]:
    """XXH64 of each word shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= n_words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    k = n_words - 1
    return [digest(joined[a:b], SEED) for a, b in zip(start[: len(words) - k].tolist(), end[k:].tolist(), strict=True)]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Majority bits of consecutive runs of ``sizes`` hashes; an empty run gives zero."""
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    sizes = sizes[full]
    starts = np.cumsum(sizes) - sizes
    # eight counters of a byte in each word: summed over at most 255 hashes at a time
    parts = (sizes + 254) // 255
    part_of = np.repeat(np.arange(len(sizes)), parts)
    nth = np.arange(len(part_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    cuts = starts[part_of] + 255 * nth
    first = np.cumsum(parts) - parts
    fp = np.zeros(len(sizes), np.uint64)
    for b in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(b)) & _LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            fp |= (2 * counts[:, byte] > sizes).astype(np.uint64) << np.uint64(8 * byte + b)
    out[full] = fp
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` with the fingerprint as a signed long."""

    def run(values: list[bytes]) -> list:
        each = [shingle_hashes(v, n_words) for v in values]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((h for x in each for h in x), np.uint64, int(sizes.sum()))
        return [majority(flat, sizes).view(np.int64)]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(texts(docs, id_col, text_col), run, f"doc_id {kind}, fp long", ["fp"])


def _residue(v: int) -> int:
    for k in range(22, 10, -1):
        if v >> k & 1:
            v ^= GENERATOR << (k - 11)
    return v


def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of single bits, and for each syndrome the six error patterns to nearby codewords.

    Decoding a word or any of its 23 neighbours gives one codeword (its pattern
    then stands six times) or six of them.
    """
    bit = np.array([_residue(1 << k) for k in range(23)], np.int64)
    nearest = np.zeros(2048, np.int64)
    for w in range(4):
        for at in combinations(range(23), w):
            s = 0
            for k in at:
                s ^= int(bit[k])
            nearest[s] = sum(1 << k for k in at)
    around = np.zeros((2048, 6), np.int64)
    for s in range(2048):
        found = {int(nearest[s])} | {int(nearest[s ^ int(bit[k])]) ^ (1 << k) for k in range(23)}
        found = sorted(found)
        around[s] = found + found[:1] * (6 - len(found))
    return bit, around


_TABLES: list = []


def nearby_codewords(segment: np.ndarray) -> np.ndarray:
    """The indices (12 bits) of the codewords around 23-bit words, six a row; fewer are repeated."""
    if not _TABLES:
        _TABLES.extend(golay_tables())
    bit, around = _TABLES
    s = np.zeros(len(segment), np.int64)
    for k in range(23):
        s ^= ((segment >> k) & 1) * bit[k]
    return (segment[:, None] ^ around[s]) >> 11


def golay_keys(fp: np.ndarray) -> np.ndarray:
    """Keys of fingerprints, eighteen a row with repeats."""
    fp = fp.view(np.uint64)
    parts, low = [], 0
    for width in SEGMENTS:
        parts.append(((fp >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64))
        low += width
    near = [nearby_codewords(p) for p in parts]
    return np.concatenate([(j << 40) | (parts[j][:, None] << 12) | near[(j + 1) % 3] for j in range(3)], axis=1)


def _keyed(distinct: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = np.sort(golay_keys(fp), axis=1)
            fresh = np.ones(keys.shape, bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[fresh]), pa.array(np.repeat(fp, fresh.sum(axis=1)))], ["key", "fp"])

    return distinct.mapInArrow(run, "key long, fp long")


def links(distinct: DataFrame, scratch: Scratch, max_bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints that give the same components as all pairs within ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the Golay keys find fingerprints that differ in two bits at most")
    keyed = _keyed(distinct)
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.cut(keyed.join(many, "key"), "met")
    few = met.where(F.col("n") <= bucket)
    pairs = (
        few.select("key", F.col("fp").alias("u"))
        .join(few.select("key", F.col("fp").alias("v")), "key")
        .where("u < v")
        .where(F.bit_count(F.expr("u ^ v")) <= max_bits)
        .select("u", "v")
    )
    hot = met.where(F.col("n") > bucket).select("fp").distinct()
    points = [F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64))]
    if max_bits == 2:
        near = hot.select("fp", F.explode(F.array(*points)).alias("d")).select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("w"))
        low = near.groupBy("w").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1")
        stars = near.join(low, "w").where("u <> fp").select("u", F.col("fp").alias("v"))
    elif max_bits == 1:
        near = hot.select("fp", F.explode(F.array(*points[1:])).alias("d")).select("fp", F.col("fp").bitwiseXOR(F.col("d")).alias("v"))
        stars = near.join(hot.select(F.col("fp").alias("v")), "v").select(F.col("fp").alias("u"), "v")
    else:
        stars = hot.where("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    return pairs.unionByName(stars)


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 3, max_bits: int = 2, bucket: int = BUCKET
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest id that links of at most ``max_bits``
    differing bits reach.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    fps = scratch.cut(fingerprints(docs, id_col, text_col, n_words), "fps")
    first = scratch.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "first")
    roots = components(links(first.select("fp"), scratch, max_bits, bucket), scratch)
    rooted = first.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = scratch.cut(rooted.join(ids, "root").select("fp", "component_id"), "named")
    scratch.drop(first)
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Rows that repeat a kept id all stay; rows with a null id stay (nothing tells them apart).
    """
    groups = simhash_groups(docs, id_col, text_col, **parameters)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    own = packed(docs, own=F.col(f"`{id_col}`"))
    return unpacked(own.join(gone.hint("merge"), F.col("own") == F.col("gone"), "left_anti"), docs.columns)
