"""Quality classifier: supervised subword embeddings.

A document's features are its hashed words, word pairs and character n-grams.
Each has a learned vector; their mean goes through a softmax layer. Both are
trained by stochastic gradient descent in numpy on a bounded sample of
labelled rows. Between the mean and the softmax all is linear, so scoring
needs one number for each feature: its vector's product with the difference of
the output layer's rows. Features are made for a whole batch at a time from
its bytes, without a loop over words.

A word that follows itself gives one shared pair feature in place of its own,
so that repetition is seen in words that no training row holds.

Longer texts are taken in parts, each with the bytes behind it that its last
features need, so the parts' features are those of the whole text.

Edge cases: null or empty texts have no features and get the score of the
output layer's bias; labels that are null or contradict each other, or whose
document is missing or in the held-out fold, are not learned from; of texts
that share an id one is, chosen by a hash; copies of a text count once in
training; with labels of one class only (or none) every score is 0.5; a null
``doc_id`` is kept, repeated rows give a row each, an empty table an empty
result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import TEXT, by_bytes, give_back, map_texts, texts
from ..scratch import Scratch

#: log2 of the number of hash buckets, the length of the vectors.
BITS, DIM = 17, 8
NGRAMS = (2, 3, 5)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TWIN = np.uint64(0x51ED270B)
_POWER = np.cumprod(np.full(64, 0x100000001B3, np.uint64), dtype=np.uint64)
#: Longer texts are taken in parts of about this many bytes, cut behind a space.
PART = 1 << 18


def buckets(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The feature buckets of a text or of several joined by newlines, and the byte at which each feature begins.

    N-grams that hold a newline are left out, and word pairs across one: it only parts texts (their own newlines are replaced before).
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = raw
    window = np.ndarray((n,), "<u8", padded.tobytes(), strides=(1,))
    line_end = np.flatnonzero(raw == 10)
    shift = np.uint64(64 - BITS)
    found, starts = [], []
    for k in NGRAMS:
        cut = window & np.uint64((1 << 8 * k) - 1)
        keep = np.ones(n, bool)
        keep[max(0, n - k + 1) :] = False
        for j in range(k):
            at = line_end - j
            keep[at[at >= 0]] = False
        pos = np.flatnonzero(keep)
        found.append(((cut[pos] + np.uint64(k)) * _MIX) >> shift)
        starts.append(pos)
    white = _WHITE[raw]
    inside = ~white
    first = np.flatnonzero(inside & np.concatenate([[True], white[:-1]]))
    if len(first):
        last = np.flatnonzero(inside & np.concatenate([white[1:], [True]]))
        at = np.flatnonzero(inside)
        size = last - first + 1
        nth = np.minimum(np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size), 63)
        words = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _POWER[nth], np.cumsum(size) - size)
        found.append((words * _MIX) >> shift)
        starts.append(first)
        lines = np.searchsorted(line_end, first)
        pair = np.flatnonzero(lines[1:] == lines[:-1])
        a, b = words[:-1][pair], words[1:][pair]
        found.append((np.where(a == b, _TWIN, (a * np.uint64(3)) ^ (b * np.uint64(0x85EBCA6B))) * _MIX) >> shift)
        starts.append(first[:-1][pair])
    return np.concatenate(found).astype(np.int64), np.concatenate(starts)


def parts(data: bytes, size: int | None = None) -> list[bytes]:
    """A text in parts of about ``size`` bytes, cut behind spaces; a word is never cut."""
    size, out, start = size or PART, [], 0
    while len(data) - start > size:
        cut = data.rfind(b" ", start, start + size) + 1 or data.find(b" ", start + size) + 1 or len(data)
        out.append(data[start:cut])
        start = cut
    return [*out, data[start:]] if start < len(data) or not out else out


_NEXT = re.compile(rb"[\x09-\x0d ]*[^\x09-\x0d ]*")


def overlapped(data: bytes) -> Iterator[tuple[bytes, int]]:
    """The parts of a text, each with what follows it as far as the longest n-gram and the end of the next word, and its own length."""
    at = 0
    for own in parts(data):
        stop = at + len(own)
        yield data[at : max(_NEXT.match(data, stop).end(), min(len(data), stop + NGRAMS[-1] - 1))], len(own)
        at = stop


@dataclass
class Model:
    """One number for each bucket, and a bias."""

    table: np.ndarray
    bias: float

    def sums(self, values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text the sum of its features' numbers, and their count."""
        owner, small, own_size = [], [], []
        for k, v in enumerate(values):
            for p, n in overlapped(v.replace(b"\n", b" \r ")):  # the newline is the separator of texts here
                owner.append(k)
                small.append(p)
                own_size.append(n)
        total, count = np.zeros(len(values)), np.zeros(len(values), np.int64)
        for lo, hi in by_bytes(small, PART):
            data = b"\n".join(small[lo:hi])
            size = np.fromiter((len(x) + 1 for x in small[lo:hi]), np.int64, hi - lo)
            hashed, at = buckets(data)
            doc = np.repeat(np.arange(hi - lo), size)[at]
            if any(n + 1 < m for n, m in zip(own_size[lo:hi], size.tolist(), strict=True)):  # features that begin behind a part are the next one's
                mine = at - (np.cumsum(size) - size)[doc] < np.array(own_size[lo:hi])[doc]
                hashed, doc = hashed[mine], doc[mine]
            own = np.array(owner[lo:hi])
            np.add.at(total, own, np.bincount(doc, self.table[hashed], hi - lo))
            np.add.at(count, own, np.bincount(doc, minlength=hi - lo))
        return total, count

    def score(self, values: list[bytes]) -> np.ndarray:
        total, count = self.sums(values)
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -30, 30)))


def gradient(
    vectors: np.ndarray, val: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray, out: np.ndarray, bias: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Slopes of the weighted log loss of a batch by its hidden means, the output layer and its bias, and the loss.

    ``vectors`` and ``val`` hold the features of one example after another, ``sizes`` of each.
    """
    part = np.concatenate([val[:, None] * vectors, np.zeros((1, vectors.shape[1]))])
    hidden = np.add.reduceat(part, np.cumsum(sizes) - sizes, axis=0) * (sizes > 0)[:, None]
    logits = (hidden[:, None, :] * out).sum(2) + bias
    err = np.exp(logits - logits.max(1, keepdims=True))
    err /= err.sum(1, keepdims=True)
    rows = np.arange(len(y))
    loss = float(-(weight * np.log(err[rows, y])).sum())
    err[rows, y] -= 1
    err *= weight[:, None]
    return (err[:, :, None] * out).sum(1), (err[:, :, None] * hidden[:, None, :]).sum(0), err.sum(0), loss


def train(rows: list[tuple[bytes, int]], steps: int = 600, rate: float = 4.0, batch: int = 16, seed: int = 7, max_bytes: int = 6_000) -> Model:
    """Learns from (text, label) in ``steps`` batches; texts beyond ``max_bytes`` are learned from in several examples of that size."""
    small = [(p, y) for x, y in dict.fromkeys(rows) for p in parts(x.replace(b"\n", b" \r "), max_bytes)]
    y = np.array([lab for _, lab in small], np.int64)
    size = 1 << BITS
    if len(np.unique(y)) < 2:
        return Model(np.zeros(size, np.float64), 0.0)
    examples = []
    for x, _ in small:
        b, n = np.unique(buckets(x)[0], return_counts=True)
        examples.append((b, n / max(1, n.sum())))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (size, DIM))
    out, bias = rng.normal(0, 0.1, (2, DIM)), np.zeros(2)
    weight = len(y) / (2 * np.bincount(y, minlength=2))
    done = 0
    while done < steps:
        order = rng.permutation(len(y))
        for lo in range(0, min(len(y), (steps - done) * batch), batch):
            own = order[lo : lo + batch]
            eta = rate * (1 - done / steps)
            done += 1
            idx = np.concatenate([examples[k][0] for k in own])
            val = np.concatenate([examples[k][1] for k in own])
            doc = np.repeat(np.arange(len(own)), [len(examples[k][0]) for k in own])
            size_of = np.array([len(examples[k][0]) for k in own])
            slope, out_slope, bias_slope, _ = gradient(emb[idx], val, size_of, y[own], weight[y[own]] / len(own), out, bias)
            # features are means over hundreds of parts, so their vectors take larger steps than the output layer
            np.add.at(emb, idx, -25 * eta * val[:, None] * slope[doc])
            out -= 0.1 * eta * out_slope
            bias -= 0.02 * eta * bias_slope
    return Model((emb * (out[1] - out[0])).sum(1), float(bias[1] - bias[0]))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def usable(labels: DataFrame, label: str, id_col: str, folds: int, held: int) -> DataFrame:
    """``doc_id, y``: one row for each id that may be learned from; ids with both labels may not."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").alias("y")).where("y in (0, 1) and doc_id is not null")
    ids = known.where(fold(F.col("doc_id"), folds) != held).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other"))
    return ids.where("y = other").select("doc_id", "y")


def sample(
    docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, held: int, per_class: int, max_bytes: int = 128 << 20
) -> list[tuple[bytes, int]]:
    """At most ``per_class`` labelled (text, label) of each class, without the held-out fold, chosen by a hash of the id.

    Of these, in the same order, those that fit ``max_bytes`` together (one that doesn't is passed over). The bounds hold
    whatever the size of the tables; so do the broadcast ids and the rows that reach the driver.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "sample")
    known = usable(labels, label, id_col, folds, held)
    picked = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    met = texts(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", F.xxhash64(TEXT).alias("h"), F.octet_length(TEXT).alias("size"), TEXT)
    own = scratch.cut(met, "texts")
    first = own.groupBy("doc_id").agg(F.min(F.struct("h", "size")).alias("x")).select("doc_id", "x.h", "x.size", F.xxhash64("doc_id").alias("o"))
    fits, left = [], max_bytes
    for r in sorted(first.collect(), key=lambda r: (r["o"], r["doc_id"])):
        if r["size"] <= left:
            left -= r["size"]
            fits.append((r["doc_id"], r["h"]))
    if not fits:
        scratch.drop(own)
        return []
    wanted = spark.createDataFrame(fits, own.select("doc_id", "h").schema)
    rows = own.join(F.broadcast(wanted), ["doc_id", "h"]).dropDuplicates(["doc_id"]).select("doc_id", TEXT, "y").collect()
    scratch.drop(own)
    return [(bytes(r[1]), int(r[2])) for r in sorted(rows, key=lambda r: r[0])]


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 4,
    held: int = 2, per_class: int = 1000, threshold: float = 0.7,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    spark = docs.sparkSession
    model = train(sample(docs, labels, label, id_col, text_col, folds, held, per_class))
    give_back()
    shared = spark.sparkContext.broadcast((model.table.astype(np.float32), model.bias))

    def run(values: list[bytes]) -> list:
        return [Model(*shared.value).score(values)]

    kind = dict(docs.dtypes)[id_col]
    scored = map_texts(texts(docs, id_col, text_col), run, f"doc_id {kind}, score double", ["score"])
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_low_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 4, held: int = 2,
    per_class: int = 1000, threshold: float = 0.7,
) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; all stay where the labels hold one class only (nothing was learned)."""
    model = train(sample(docs, labels, label, id_col, text_col, folds, held, per_class))
    give_back()
    if not model.table.any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast((model.table.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        return pd.Series(Model(*shared.value).score(values.tolist()))

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.where(score(text) >= threshold)
