"""Suffix-array dedup: removes strings of ``length`` bytes that occur more than once.

A suffix array of a whole corpus is out of reach, and is not needed: only
positions that share ``length`` bytes with another one matter. They are found
in three steps, and suffixes are sorted only where a match is possible.

1. Each window of ``length`` bytes is filed under its anchor, the smallest
   hash of the ``ANCHOR``-byte strings in it. Windows next to each other mostly
   share their anchor, so a text is a chain of *stretches*, each with one
   anchor and some dozens of windows (``LONG`` at most: where a text repeats
   itself, all its windows share one). Equal windows have equal anchors. Per
   stretch only hashes go on.
2. Equal stretches are one: grouped by their content's hash, they are covered
   wholly by repeats. Equal texts are taken together before, in the same way.
3. Anchors with different stretches, or twice in one, are left. One copy of each such stretch is
   read again, and stretches of an anchor meet in one task (those of very frequent
   ones, or with many bytes together, are dealt by the hash of single windows instead). The task sorts the
   suffixes that begin there, as far as ``length`` bytes, by prefix doubling.
   In suffix order, the nearest smaller positions before and after a suffix
   give the longest match that begins earlier in the corpus (the
   longest-previous-factor array); larger positions give later matches.

With ``keep="first"`` the bytes whose string occurs earlier (by ``doc_id``,
then position) are removed and the first copy stays; with ``keep="none"`` all
copies go. Overlaps count, the same text included; strings are judged on the
input. Matches never cross texts.

Edge cases: null texts are empty, texts shorter than ``length`` are never
changed; a null ``doc_id`` is kept (and comes first in order); rows that repeat
id and text are copies of each other; an empty table gives an empty result;
further columns are ignored whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import TEXT, texts
from ..scratch import Scratch

ANCHOR = 32
#: Different stretches of an anchor beyond which its windows are dealt one by one.
HOT = 8000
#: Bytes of an anchor's stretches beyond which they are too (sorting takes some hundred bytes a byte).
HOT_BYTES = 4 << 20
#: Windows of a stretch at most.
LONG = 1 << 13
#: Bytes of stretches whose suffixes are sorted together.
BLOCK = 1 << 20
#: Bits of a position within a text in the anchors' keys; longer texts are handled in parts that overlap.
_POS = 24
_PART = 1 << 22
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash for each ``ANCHOR`` bytes."""
    n = len(raw) - ANCHOR + 1
    word = np.ndarray((len(raw) - 7,), "<u8", raw.tobytes(), strides=(1,))
    h = word[:n] * _M1
    for k in range(8, ANCHOR, 8):
        h ^= h >> np.uint64(29)
        h += word[k : k + n]
        h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M1
    return h


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w``, from running minima of blocks in both directions."""
    n = len(x)
    full = -(-n // w) * w
    padded = np.full(full, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    fore = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], fore[w - 1 : n])


def stretches(text: bytes, length: int) -> list[tuple[int, int, int, int]]:
    """(anchor hash, start, stop, again): windows begin in [start, stop - length], each byte of a window in [start, stop).

    ``again`` is 1 where the anchor occurs more than once in the stretch, so that its windows may repeat each other.
    """
    out = []
    for lo in range(0, max(1, len(text) - length + 1), _PART):
        raw = np.frombuffer(text, np.uint8)[lo : lo + _PART + length - 1]
        if len(raw) < length:
            break
        h = _anchor_hashes(raw)
        key = (h & ~np.uint64((1 << _POS) - 1)) | np.arange(len(h), dtype=np.uint64)
        low = _sliding_min(key, length - ANCHOR + 1)
        cut = np.flatnonzero(low[1:] != low[:-1]) + 1
        first = np.concatenate([[0], cut])
        at = (low[first] & np.uint64((1 << _POS) - 1)).astype(np.int64)
        new = np.concatenate([[True], h[at[1:]] != h[at[:-1]]])  # the same hash at another place goes on
        again = (np.diff(np.concatenate([np.flatnonzero(new), [len(new)]])) > 1).astype(np.int64)
        first, at = first[new], at[new]
        last = np.concatenate([first[1:], [len(low)]]) - 1
        if (last - first >= LONG).any():
            many = (last - first) // LONG + 1
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            first, at, again, stop = np.repeat(first, many) + nth * LONG, np.repeat(at, many), np.repeat(again, many), np.repeat(last, many)
            last = np.minimum(first + LONG - 1, stop)
        out += zip(h[at].astype(np.int64).tolist(), (first + lo).tolist(), (last + lo + length).tolist(), again.tolist(), strict=True)
    return out


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Ranks of the suffixes at ``starts`` by their first ``length`` bytes (8 at least); equal strings share a rank.

    Ranks of 8 bytes are doubled until twice their size would exceed the length; the rest is made up of them.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(length + 8, np.uint8)])
    word = np.ndarray((n + length + 1,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    rank = np.unique(word, return_inverse=True)[1].astype(np.int32)
    size, levels = 8, []
    while True:
        levels.append((size, rank))
        if 2 * size > length:
            break
        rank = np.unique(rank[:-size] * np.int64(len(word)) + rank[size:], return_inverse=True)[1].astype(np.int32)
        size *= 2
    offset, out = 0, None
    for size, rank in reversed(levels):
        while offset + size <= length or (size == 8 and offset < length):
            part = rank[starts + min(offset, length - size)]
            out = part if out is None else np.unique(out * np.int64(len(word)) + part, return_inverse=True)[1]
            offset += size
    return out


def nearest_smaller(values: list[int]) -> tuple[list[int], list[int]]:
    """For each item the index of the nearest smaller one before it and after it, or -1."""
    before, after, stack = [-1] * len(values), [-1] * len(values), []
    for k, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            after[stack.pop()] = k
        before[k] = stack[-1] if stack else -1
        stack.append(k)
    return before, after


def matches(order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix has a full-length match at a smaller place, and at a larger one.

    ``order`` holds ranks by the first bytes, ``place`` positions in the corpus. The suffix array lists equal
    ranks one after another; with equal ranks a factor has the full length, otherwise it is too short to count.
    """
    sa = np.lexsort((place, order))
    r = order[sa]
    same_next = np.concatenate([r[1:] == r[:-1], [False]])
    same_last = np.concatenate([[False], same_next[:-1]])
    hit = np.flatnonzero(same_next | same_last)
    earlier, later = np.zeros(len(sa), bool), np.zeros(len(sa), bool)
    for run in np.split(hit, np.flatnonzero(r[hit[1:]] != r[hit[:-1]]) + 1) if len(hit) else []:
        places = place[sa[run]].tolist()
        psv, nsv = nearest_smaller(places)
        pgv, ngv = nearest_smaller([-x for x in places])
        earlier[sa[run]] = [a >= 0 or b >= 0 for a, b in zip(psv, nsv, strict=True)]
        later[sa[run]] = [a >= 0 or b >= 0 for a, b in zip(pgv, ngv, strict=True)]
    return earlier, later


def _runs(hit: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges covered by the windows that begin at the marked offsets."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > length)
    first = np.concatenate([[0], cut + 1])
    last = np.concatenate([cut, [len(at) - 1]])
    return list(zip(at[first].tolist(), (at[last] + length).tolist(), strict=True))


def _key(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text, 1) - (1 << 63)


def _numbered(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """``doc_id, tkey, anchor, c1, c2, start, size, again`` of every stretch."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, of = [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                own = stretches(text, length)
                if own:
                    key, digest = _key(text), xxhash.xxh3_128_digest
                    both = np.frombuffer(b"".join([digest(text[x:y]) for _, x, y, _ in own]), "<i8").reshape(-1, 2)
                    cols = np.array(own, np.int64)
                    rows.append(np.column_stack([np.full(len(own), key), cols[:, 0], both, cols[:, 1], cols[:, 2] - cols[:, 1], cols[:, 3]]))
                    of.append(np.full(len(own), k))
            if rows:
                all_rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(np.concatenate(of))), *(pa.array(np.ascontiguousarray(c)) for c in all_rows.T)],
                    ["doc_id", "tkey", "anchor", "c1", "c2", "start", "size", "again"],
                )

    kind = dict(docs.dtypes)[id_col]
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, tkey long, anchor long, c1 long, c2 long, start long, size long, again long")


def _with_key(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, tkey, __text``; the key is the one of ``_numbered``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = pa.array([_key(x) for x in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), keys, b.column(1)], ["doc_id", "tkey", TEXT])

    kind = dict(docs.dtypes)[id_col]
    return texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, tkey long, {TEXT} binary")


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["tkey"] == right["tkey"])


def _bytes_of(chosen: DataFrame, docs: DataFrame) -> DataFrame:
    """The stretches of ``chosen`` with their bytes: each text is met once, with the list of what is wanted of it."""
    kind = dict(docs.dtypes)["doc_id"]
    want = chosen.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("anchor", "n", "kinds", "start", "size")).alias("want"))
    # rows that repeat id and text give the same stretches again: no new place, so no new match
    met = docs.join(want, _same(docs, want)).select(docs["doc_id"], docs["tkey"], TEXT, "want")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, of, cut = [], [], []
            for k, (text, want) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                for w in want:
                    flat.append((w["anchor"], w["n"], w["kinds"], w["start"]))
                    of.append(k)
                    cut.append(text[w["start"] : w["start"] + w["size"]])
            if flat:
                cols = [pa.array(c, pa.int64()) for c in zip(*flat, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(of)) for c in (0, 1)), *cols, pa.array(cut, pa.binary())], ["doc_id", "tkey", "anchor", "n", "kinds", "start", "bytes"])

    return met.mapInArrow(run, f"doc_id {kind}, tkey long, anchor long, n long, kinds long, start long, bytes binary")


def _sorted_matches(cut: DataFrame, length: int, keep: str) -> DataFrame:
    """``doc_id, tkey, a, b``: matched byte ranges of stretches whose anchor has few kinds, by suffix order within blocks of anchors."""
    kind = dict(cut.dtypes)["doc_id"]

    def block(rows: list[dict]) -> list[tuple]:
        data = np.frombuffer(b"".join(r["bytes"] for r in rows), np.uint8)
        size = np.array([len(r["bytes"]) for r in rows])
        many = size - length + 1
        base = np.repeat(np.cumsum(size) - size, many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        owner = np.repeat(np.arange(len(rows)), many)
        # places in the order of id, position, text
        ids = sorted({r["doc_id"] for r in rows}, key=lambda x: (x is not None, x if x is not None else 0))
        nth = {x: k for k, x in enumerate(ids)}
        start = np.array([r["start"] for r in rows])[owner] + within
        key = np.array([r["tkey"] for r in rows])[owner]
        by = np.lexsort((key, start, np.array([nth[r["doc_id"]] for r in rows])[owner]))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        earlier, later = matches(suffix_order(data, base + within, length), place)
        hit = earlier if keep == "first" else earlier | later
        out, ends = [], np.cumsum(many)
        for k, r in enumerate(rows):
            if keep == "first" or r["n"] == 1:
                out += [(k, r["start"] + a, r["start"] + b) for a, b in _runs(hit[ends[k] - many[k] : ends[k]], length)]
        return out

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = block(held) if held else []
            if found:
                ids = pa.array([held[k]["doc_id"] for k, _, _ in found], own_type)
                cols = [[held[k]["tkey"] for k, _, _ in found], [a for _, a, _ in found], [b for _, _, b in found]]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "tkey", "a", "b"])

        for b in batches:
            own_type = b.column(0).type
            for r in b.to_pylist():
                if total >= BLOCK and held[-1]["anchor"] != r["anchor"]:
                    yield from flush()
                    held, total = [], 0
                held.append(r)
                total += len(r["bytes"])
        yield from flush()

    few = cut.where(F.col("kinds") <= HOT).select("doc_id", "tkey", "anchor", "n", "start", "bytes")
    dealt = few.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, f"doc_id {kind}, tkey long, a long, b long")


def _hot_matches(cut: DataFrame, length: int, keep: str) -> DataFrame:
    """The same for the other anchors: windows meet by the hash of their bytes, and smallest and largest place tell of a match."""
    kind = dict(cut.dtypes)["doc_id"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, row in enumerate(b.to_pylist()):
                data, many = row["bytes"], len(row["bytes"]) - length + 1
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[k : k + length]) for k in range(many)]), "<i8").reshape(-1, 2)
                of = pa.array(np.full(many, r))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(of), b.column(1).take(of), b.column(2).take(of), pa.array(row["start"] + np.arange(many)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())],
                    ["doc_id", "tkey", "n", "a", "w1", "w2"],
                )

    hot = cut.where(F.col("kinds") > HOT).select("doc_id", "tkey", "n", "start", "bytes")
    each = hot.mapInArrow(run, f"doc_id {kind}, tkey long, n long, a long, w1 long, w2 long").withColumn("place", F.struct("doc_id", "a", "tkey"))
    ends = each.groupBy("w1", "w2").agg(F.min("place").alias("low"), F.max("place").alias("high")).where("low < high")
    met = each.join(ends, ["w1", "w2"])
    hit = met.where("place > low") if keep == "first" else met.where("n = 1")
    return hit.select("doc_id", "tkey", "a", (F.col("a") + length).alias("b"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, keep: str = "none") -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row: the byte ranges removed (disjoint, ascending), and the bytes left."""
    if keep not in ("none", "first") or length < 2 * ANCHOR:
        raise ValueError("keep is 'none' or 'first', and length at least twice the anchor's")
    scratch = Scratch(docs.sparkSession, "suffixes")
    every = scratch.cut(_numbered(docs, id_col, text_col, length), "stretches", "zstd")
    place = F.struct("doc_id", "start", "tkey")
    counted = every.groupBy("c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "tkey", "anchor", "size", "again")).alias("first"))
    # most kinds occur once: nothing joins them by content any more, so their hashes aren't stored
    several = [F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("c1", "c2")]
    kinds = scratch.cut(counted.select(*several, "n", "first"), "kinds", "zstd")
    counts = kinds.groupBy(F.col("first.anchor").alias("anchor")).agg(F.count("*").alias("kinds"), F.sum("first.size").alias("bytes"), F.max("first.again").alias("again"))
    large = F.when(F.col("bytes") > HOT_BYTES, F.greatest("kinds", F.lit(HOT + 1))).otherwise(F.col("kinds"))
    mixed = counts.where("kinds > 1 or again > 0").select("anchor", large.alias("kinds"))
    chosen = kinds.select("n", "first.*").join(mixed, "anchor")
    keyed = _with_key(docs, id_col, text_col)
    cut = scratch.cut(_bytes_of(chosen, keyed), "bytes", "zstd")
    copied = every.join(kinds.where("n > 1").select("c1", "c2", "first"), ["c1", "c2"])
    if keep == "first":
        copied = copied.where(place > F.struct("first.doc_id", "first.start", "first.tkey"))
    whole = copied.select("doc_id", "tkey", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    found = scratch.cut(whole.unionByName(_sorted_matches(cut, length, keep)).unionByName(_hot_matches(cut, length, keep)), "found", "zstd")
    scratch.drop(every, kinds, cut)
    gone = found.groupBy("doc_id", "tkey").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    met = keyed.join(gone.hint("merge"), _same(keyed, gone), "left").select(keyed["doc_id"], TEXT, "gone")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, spans, left = [], [], []
            for text, gone in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                merged: list[list[int]] = []
                if gone.is_valid:
                    v = gone.values
                    for x, y in sorted(zip(v.field(0).to_pylist(), v.field(1).to_pylist(), strict=True)):
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                parts, at = [], 0
                for x, y in merged:
                    parts.append(text[at:x])
                    at = y
                sizes.append(len(text))
                spans.append([{"start": x, "stop": y} for x, y in merged])
                left.append(b"".join([*parts, text[at:]]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(left, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    kind = dict(docs.dtypes)[id_col]
    return met.mapInArrow(run, f"doc_id {kind}, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
