"""Language-model scores by a hierarchical Pitman-Yor model over words.

Every word has a restaurant for what follows it; the tables of all these are
customers of one parent restaurant, whose parent is uniform over the ``V`` known
tokens and one unknown. Seatings are drawn by Gibbs sweeps (``seating``), and the
predictive probabilities of several sweeps are averaged, level by level:

    P(w | u) = A(u, w) + B(u) P(w),   A: mean of (c - d t) / (s + C),   B: mean of (s + d T) / (s + C)

with ``c, C`` customers and ``t, T`` tables of the pair and the whole restaurant.
What is averaged this way still sums to one over known tokens and the unknown
one. A text is the start, its words, and one end token.

Work is dealt by words, so that it grows in number of tasks and not in size. A
*shard* holds whole restaurants (those of very frequent words are cut in parts by
the word that follows), a *word shard* a part of the parent. A task counts pairs
over some millions of tokens before they are shuffled. Pairs met once have one
table for good, so sweeps touch the others only: shards send tables by word, word
shards draw the parent's seating and send its probabilities back, shards draw
theirs. Restaurants are drawn in halves, each given the other's present state;
what comes from another shard (the parent, the other parts of a cut restaurant)
is that of the sweep before.

Texts are scored where the pairs are: a task sends the distinct pairs of some
millions of tokens with the documents that hold them, shards send back sums by
document. Pairs so frequent that their list of documents would be long are
looked up by every task instead. ``ROUNDS`` rounds of documents bound the shuffle.

All counts cover all learning rows; only the list of frequent words that are cut
in parts comes from a sample of ``SAMPLE_BYTES``, and changes no result but the order of
updates. Discounts are estimated from pairs met once and twice, strengths are
parameters.

Edge cases: null and empty texts are an end token; without learning rows every
token is unknown with probability one; repeated rows count and are scored once
each; a null ``doc_id`` is kept; further columns are ignored whatever their
names.
"""

from __future__ import annotations

import contextlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .arrow import TEXT
from ..scratch import Scratch, remove
from .seating import draw

#: Text of a shard, tokens that a task counts at once, text that the list of frequent words is made from.
SHARD_BYTES, FLUSH, SAMPLE_BYTES = 16 << 20, 2_000_000, 16 << 20
#: A word's restaurant is cut beyond so many shares of a shard; a pair is looked up by every task beyond so many.
CUT, FREQUENT = 2, 4
ROUNDS = 4
BURN, SAMPLES = 1, 3
#: What stands for the start and the end among the words' 64-bit hashes.
START, END = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: What shards and word shards send each other: some arrays for ``at``, of a ``kind``, from ``part``.
BOX = pa.schema([("at", pa.int32()), ("kind", pa.string()), ("part", pa.int64()), ("k", pa.list_(pa.int64())), ("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))])
BOX_DDL = "at int, kind string, part long, k array<long>, i array<int>, x array<double>"
EMPTY = np.zeros(0, np.uint64)


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """One 64-bit hash of two."""
    with np.errstate(over="ignore"):
        h = (a ^ (a >> np.uint64(31))) * _ODD + b
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Layout:
    """Where pairs live: ``cut`` has the words whose restaurants lie in ``parts`` shards each."""

    shards: int
    cut: np.ndarray = field(default_factory=lambda: EMPTY)
    parts: np.ndarray = field(default_factory=lambda: EMPTY)

    def shard(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        out = _shard(u, self.shards)
        if len(self.cut) and len(u):
            k = np.minimum(np.searchsorted(self.cut, u), len(self.cut) - 1)
            met = np.flatnonzero(self.cut[k] == u)
            part = mixed(w[met], np.uint64(1)) % self.parts[k[met]]
            out[met] = _shard(mixed(u[met], part), self.shards)
        return out


def _box(rows: list[tuple]) -> pa.Table:
    """Rows of ``at, kind, part, k, i, x``; arrays may be None."""
    cols = list(zip(*rows, strict=True)) or [()] * 6
    lists = [pa.array([None if v is None else np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v for v in c], t) for c, t in zip(cols[3:], BOX.types[3:], strict=True)]
    return pa.Table.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), *lists], schema=BOX)


def _open(table: pa.Table) -> tuple[int, dict[str, list[tuple]]]:
    """The shard, and by kind the parts in order, each ``part, k, i, x``; ``k`` is unsigned."""
    out: dict[str, list[tuple]] = defaultdict(list)
    table = table.combine_chunks()
    cols = {c: table[c].chunk(0) if table[c].num_chunks else pa.array([], table[c].type) for c in table.column_names}
    parts, kinds = cols["part"].to_pylist(), cols["kind"].to_pylist()

    def values(c: str, j: int, kind: type) -> np.ndarray | None:
        v = cols[c][j]
        return v.values.to_numpy(zero_copy_only=False).astype(kind, copy=False) if v.is_valid else None

    for j in range(table.num_rows):
        k = values("k", j, np.int64)
        out[kinds[j]].append((parts[j], None if k is None else np.ascontiguousarray(k).view(np.uint64), values("i", j, np.int32), values("x", j, np.float64)))
    for v in out.values():
        v.sort(key=lambda r: r[0])
    return cols["at"][0].as_py(), out


def _one(got: dict, kind: str, slot: int, dtype: type) -> np.ndarray:
    """The array of a kind, its parts one after the other."""
    parts = [r[slot] for r in got.get(kind, []) if r[slot] is not None]
    if not parts:
        return np.zeros(0, dtype)
    out = parts[0] if len(parts) == 1 else np.concatenate(parts)
    return out.view(np.int64) if slot == 1 and dtype is np.int64 else out.astype(dtype, copy=False)


def _sent(kind: str, at: int, words: np.ndarray, shards: int, i: np.ndarray | None = None, x: np.ndarray | None = None) -> list[tuple]:
    """Sorted words, cut by the word shards that they belong to."""
    if not len(words):
        return []
    s = _shard(words, shards)
    starts = np.flatnonzero(np.diff(s, prepend=-1))
    ends = np.append(starts[1:], len(s))
    return [(int(s[a]), kind, at, words[a:b], None if i is None else i[a:b].astype(np.int32), None if x is None else x[a:b].astype(float)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


# ---------------------------------------------------------------- tokens and pairs


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.arange(256, dtype=np.uint64) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint64)
#: Bytes that are hashed at once.
SEGMENT = 1 << 18


def _hashed(buf: np.ndarray, starts: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """The hash of each word: the mixed sum of mixed (byte, place) numbers, so that a word may lie in several segments."""
    out = np.zeros(len(starts), np.uint64)
    for s in range(int(starts[0]) if len(starts) else len(buf), len(buf), SEGMENT):
        e = min(s + SEGMENT, len(buf))
        a, b = int(np.searchsorted(starts, s, "right")) - 1, int(np.searchsorted(starts, e))
        own = starts[a:b]
        bounds = np.maximum(own, s)
        place = np.arange(s, e) - np.repeat(own, np.diff(bounds, append=e))
        h = mixed(_LOWER[buf[s:e]] | place.astype(np.uint64) << np.uint64(8), np.uint64(0x165667B19E3779F9))
        h[blank[s:e]] = 0
        out[a:b] += np.add.reduceat(h, bounds - s)
    return mixed(out, np.uint64(0x2545F4914F6CDD1D))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the texts' tokens (words with A-Z lower-cased, then an end each), and each text's tokens."""
    if not len(texts):
        return EMPTY, np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    blank = _SPACE[buf]
    first = np.ones(len(buf), bool)
    first[1:] = blank[:-1]
    first[offsets[:-1][offsets[:-1] < len(buf)]] = True
    starts = np.flatnonzero(first & ~blank)
    words = _hashed(buf, starts, blank)
    ends = np.searchsorted(starts, offsets[1:])  # words up to each text's end
    out = np.full(len(words) + len(texts), END, np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends + np.arange(len(texts))] = False
    out[is_word] = words
    return out, np.diff(ends, prepend=0) + 1


def _chunks(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows (without their text), token hashes and tokens a row of some documents with about ``flush`` tokens, or one long one."""
    rows, tokens, sizes, size = [], [], [], 0
    for b in batches:
        at = b.schema.get_field_index(TEXT)
        more = list(zip(*(c.to_pylist() for k, c in enumerate(b.columns) if k != at), strict=True)) if b.num_columns > 1 else [()] * b.num_rows
        start = 0
        while start < b.num_rows:
            stop, held = start, 0
            while stop < b.num_rows and (stop == start or size + held < flush):
                held += len(b.column(at)[stop].as_buffer()) // 6 + 1  # about as many tokens
                stop += 1
            t, n = token_hashes(b.column(at).slice(start, stop - start))
            rows += more[start:stop]
            tokens.append(t)
            sizes.append(n)
            size += len(t)
            start = stop
            if size >= flush:
                yield rows, np.concatenate(tokens), np.concatenate(sizes)
                rows, tokens, sizes, size = [], [], [], 0
    if rows:
        yield rows, np.concatenate(tokens), np.concatenate(sizes)


def _pairs(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The known words, sorted, and each token's pair as two places there in one number."""
    words, place = np.unique(np.append(w, START), return_inverse=True)
    place = place.reshape(-1)
    start, place = place[-1], place[:-1]
    before = np.empty_like(place)
    before[1:] = place[:-1]
    before[np.cumsum(sizes) - sizes] = start
    return words, before.astype(np.int64) << 32 | place


def _packed(kind: str, part: int, u: np.ndarray, w: np.ndarray, n: np.ndarray, s: np.ndarray, docs: np.ndarray | None = None) -> list[tuple]:
    """Pairs sorted by shard and word, one row a shard: ``k`` has the words and then what follows them, ``i`` how many follow, ``n``, and ``docs``."""
    if not len(u):
        return []
    run = np.flatnonzero((np.diff(u, prepend=~u[:1]) != 0) | (np.diff(s, prepend=-1) != 0))
    many = np.diff(run, append=len(u))
    starts = np.flatnonzero(np.diff(s, prepend=-1))
    ends = np.append(starts[1:], len(s))
    ra, rb = np.searchsorted(run, starts), np.searchsorted(run, ends)
    at = np.concatenate([[0], np.cumsum(n)]) if docs is not None else None
    out = []
    for a, b, p, q in zip(starts.tolist(), ends.tolist(), ra.tolist(), rb.tolist(), strict=True):
        numbers = [[q - p, b - a], many[p:q], n[a:b]] + ([docs[at[a] : at[b]]] if docs is not None else [])
        out.append((int(s[a]), kind, part, np.concatenate([u[run[p:q]], w[a:b]]), np.concatenate(numbers).astype(np.int32), None))
    return out


def _unpacked(k: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, how many follow each, what follows, ``n`` of each pair, and the rest."""
    nu, np_ = int(i[0]), int(i[1])
    return k[:nu], i[2 : 2 + nu], k[nu:], i[2 + nu : 2 + nu + np_], i[2 + nu + np_ :]


def _counted(layout: Layout, flush: int):
    """The pairs of a task's texts with their counts, dealt to shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, sizes in _chunks(batches, flush):
            words, code = _pairs(tokens, sizes)
            code, n = np.unique(code, return_counts=True)
            u, w = words[code >> 32], words[code & 0xFFFFFFFF]
            s = layout.shard(u, w)
            if len(layout.cut):
                order = np.argsort(s, kind="stable")
                u, w, n, s = u[order], w[order], n[order], s[order]
            yield from _box(_packed("q", 0, u, w, n, s)).to_batches()

    return run


def _merged(layout: Layout, floor: int):
    """A shard's restaurants, with one table for every pair."""

    def run(table: pa.Table) -> pa.Table:
        at, got = _open(table)
        runs = [_unpacked(r[1], r[2]) for r in got["q"]]
        words, place = np.unique(np.concatenate([r[0] for r in runs]), return_inverse=True)
        place = np.repeat(place.reshape(-1), np.concatenate([r[1] for r in runs]))
        every, follows = np.unique(np.concatenate([r[2] for r in runs]), return_inverse=True)
        code = place.astype(np.int64) << 32 | follows.reshape(-1)
        order = np.argsort(code)
        code, n = code[order], np.concatenate([r[3] for r in runs])[order].astype(np.int64)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        code, c = code[first], np.add.reduceat(n, first)
        place, follows = code >> 32, code & 0xFFFFFFFF
        u, w = words[place], every[follows]
        single = c == 1
        customers = np.bincount(place, weights=c, minlength=len(words)).astype(np.int64)
        alone = np.bincount(place[single], minlength=len(words)).astype(np.int64)
        multi = np.flatnonzero(~single)
        top = np.flatnonzero(c >= floor)
        rows = [
            (at, "u", 0, words, None, None), (at, "C", 0, customers, None, None), (at, "d", 0, alone, None, None),
            (at, "m", 0, w[multi], place[multi].astype(np.int32), None), (at, "c", 0, c[multi], None, None),
            (at, "s", 0, w[single], place[single].astype(np.int32), None), (at, "t", 0, np.ones(len(multi), np.int64), None, np.zeros(len(multi))),
            (at, "b", 0, None, None, np.zeros(len(words))), (at, "stat", 0, None, None, np.array([c.sum(), single.sum(), (c == 2).sum()], float)),
        ]
        if len(top):
            rows.append((at, "top", 0, np.stack([u[top], w[top], c[top].astype(np.uint64)], 1).reshape(-1), None, None))
        own, inv = np.unique(w[multi], return_inverse=True)
        rows += _sent("to", at, own, layout.shards, x=np.bincount(inv.reshape(-1), minlength=len(own)))
        rows += _sent("all", at, every, layout.shards, i=np.bincount(follows, minlength=len(every)), x=np.bincount(follows, weights=single, minlength=len(every)))
        return _box([*rows, *_cut_sums(at, layout, words, customers, alone + np.bincount(place[multi], minlength=len(words)))])

    return run


def _cut_sums(at: int, layout: Layout, words: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> list[tuple]:
    """This shard's part of the restaurants that are cut."""
    mine = np.flatnonzero(np.isin(words, layout.cut)) if len(layout.cut) else []
    return [(at, "cut", 0, words[mine], None, np.concatenate([customers[mine], tables[mine]]).astype(float))] if len(mine) else []


# ---------------------------------------------------------------- sweeps


@dataclass
class State:
    """What all tasks of a sweep know: the parent's discount, strength, customers, tables and base, the restaurants' discount and strength, and those that are cut."""

    d0: float
    s0: float
    d1: float
    s1: float
    base: float
    customers: float = 0.0
    tables: float = 0.0
    cut: dict = field(default_factory=dict)
    seed: int = 0

    def parent(self, share: np.ndarray) -> np.ndarray:
        """The parent's probability of words with ``c - d t`` of ``share``."""
        return (share + (self.s0 + self.d0 * self.tables) * self.base) / (self.s0 + self.customers)


def _words(table: pa.Table) -> pa.Table:
    """A word shard's words, with the pairs that are met once, in the first sweep's customers."""
    at, got = _open(table)
    every = np.concatenate([r[1] for r in got["all"]])
    words, inv = np.unique(every, return_inverse=True)
    inv = inv.reshape(-1)
    alone = np.bincount(inv, weights=np.concatenate([r[3] for r in got["all"]]), minlength=len(words))
    pairs = np.bincount(inv, weights=np.concatenate([r[2] for r in got["all"]]), minlength=len(words))
    stat = np.array([len(words), (pairs == 1).sum(), (pairs == 2).sum(), pairs.sum()], float)
    state = [(at, "k", 0, pairs.astype(np.int64), None, np.zeros(len(words))), (at, "t", 0, np.ones(len(words), np.int64), None, None)]
    return _box([(at, "w", 0, words, None, alone), (at, "stat", 0, None, None, stat), *state])


def _parent_drawn(was: State, now: State, count: bool):
    """The parent's seating in a word shard, given the shards' tables; what it was goes into the mean if ``count``."""

    def run(table: pa.Table) -> pa.Table:
        at, got = _open(table)
        words, alone = _one(got, "w", 1, np.uint64), _one(got, "w", 3, float)
        k, t, mean = _one(got, "k", 1, np.int64), _one(got, "t", 1, np.int64), _one(got, "k", 3, float)
        if count:
            mean = mean + was.parent(k - was.d0 * t)
        new = alone.copy()
        asked = [(r[0], np.searchsorted(words, r[1]), r[3]) for r in got.get("to", [])]
        for _, place, n in asked:
            new[place] += n
        new = new.astype(np.int64)
        rng = np.random.default_rng([now.seed, 1, at])
        t = draw(new, np.minimum(t, new), was.tables - t, np.full(len(new), now.base), now.s0, now.d0, rng)
        share = new - now.d0 * t
        rows = [(at, "k", 0, new, None, mean), (at, "t", 0, t, None, None), (at, "stat", 0, None, None, np.array([new.sum(), t.sum()], float))]
        return _box(rows + [(part, "p", at, None, None, share[place]) for part, place, _ in asked])

    return run


class Restaurants:
    """A shard's restaurants out of what it has been sent."""

    def __init__(self, got: dict, now: State):
        self.now = now
        self.words, self.customers, self.alone = _one(got, "u", 1, np.uint64), _one(got, "C", 1, np.int64), _one(got, "d", 1, np.int64)
        self.w, self.place, self.c = _one(got, "m", 1, np.uint64), _one(got, "m", 2, np.int64), _one(got, "c", 1, np.int64)
        self.t, self.mean, self.back = _one(got, "t", 1, np.int64), _one(got, "t", 3, float), _one(got, "b", 3, float)
        self.elsewhere = np.zeros(len(self.words))
        self.whole = self.customers.astype(float)
        for u, (customers, tables) in now.cut.items():
            j = int(np.searchsorted(self.words, np.uint64(u)))
            if j < len(self.words) and self.words[j] == np.uint64(u):
                self.whole[j] = customers
                self.elsewhere[j] = tables - self._own()[j]

    def _own(self) -> np.ndarray:
        return self.alone + np.bincount(self.place, weights=self.t, minlength=len(self.words))

    def tables(self) -> np.ndarray:
        return self._own() + self.elsewhere

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """The sums of ``A`` and ``B`` with the present seating."""
        size = self.now.s1 + self.whole
        return self.mean + (self.c - self.now.d1 * self.t) / size[self.place], self.back + (self.now.s1 + self.now.d1 * self.tables()) / size

    def draw(self, p: np.ndarray, rng: np.random.Generator) -> None:
        """New seatings, the pairs in two halves; ``p``: the parent's probability of each pair's word."""
        for half in (0, 1):
            some = np.arange(half, len(self.c), 2)
            others = self.tables()[self.place[some]] - self.t[some]
            self.t = self.t.copy()
            self.t[some] = draw(self.c[some], self.t[some], np.maximum(others, 0), p[some], self.now.s1, self.now.d1, rng)


def _drawn(layout: Layout, now: State, count: bool):
    """The seatings in a shard, given the parent's; what they were goes into the mean if ``count``."""

    def run(table: pa.Table) -> pa.Table:
        at, got = _open(table)
        r = Restaurants(got, now)
        if count:
            r.mean, r.back = r.counted()
        own, inv = np.unique(r.w, return_inverse=True)
        inv = inv.reshape(-1)
        if len(own):
            r.draw(now.parent(_one(got, "p", 3, float))[inv], np.random.default_rng([now.seed, 2, at]))
        rows = [(at, "t", 0, r.t, None, r.mean), (at, "b", 0, None, None, r.back)]
        rows += _sent("to", at, own, layout.shards, x=np.bincount(inv, weights=r.t, minlength=len(own)))
        return _box(rows + _cut_sums(at, layout, r.words, r.customers, r._own()))

    return run


# ---------------------------------------------------------------- the model


def _asked(shards: int):
    """The words whose restaurants a shard has, sent to their word shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, k in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _box(_sent("ask", at, k.values.to_numpy(zero_copy_only=False).view(np.uint64), shards)).to_batches()

    return run


def _answered(now: State, samples: int):
    """The parent's mean probabilities; of no known word, zero."""

    def run(table: pa.Table) -> pa.Table:
        at, got = _open(table)
        words, mean = _one(got, "w", 1, np.uint64), _mean(got, now, samples)
        rows = []
        for asked, kind in (("all", "p"), ("ask", "own")):
            for part, k, _, _ in got.get(asked, []):
                place = np.minimum(np.searchsorted(words, k), max(len(words) - 1, 0))
                rows.append((part, kind, at, None, None, np.where(words[place] == k, mean[place], 0.0) if len(words) else np.zeros(len(k))))
        end = int(np.searchsorted(words, END))
        if end < len(words) and words[end] == END:
            rows.append((at, "end", 0, None, None, mean[end : end + 1]))
        return _box(rows)

    return run


def _mean(got: dict, now: State, samples: int) -> np.ndarray:
    k, t = _one(got, "k", 1, np.int64), _one(got, "t", 1, np.int64)
    return (_one(got, "k", 3, float) + now.parent(k - now.d0 * t)) / samples


class Pairs:
    """A shard's pairs as one sorted list of 64-bit keys, and what each adds to a text's logarithm; by word, what it adds itself."""

    def __init__(self, got: dict, now: State, samples: int, unknown: float):
        r = Restaurants(got, now)
        a, b = r.counted()
        a, b = a / samples, b / samples
        single, place = _one(got, "s", 1, np.uint64), _one(got, "s", 2, np.int64)
        u, w = np.concatenate([r.place, place]), np.concatenate([r.w, single])
        a = np.concatenate([a, (1 - now.d1) / (now.s1 + r.whole[place])])
        p = _one(got, "p", 3, float)[np.unique(w, return_inverse=True)[1].reshape(-1)] if len(w) else np.zeros(0)
        gain = np.log10(1 + a / (b[u] * p))
        key = mixed(r.words[u], w)
        order = np.argsort(key)
        self.key, self.gain, self.words, self.unknown = key[order], gain[order], r.words, unknown
        own = _one(got, "own", 3, float)
        word = own > 0  # the start is no word
        self.score = np.log10(b) + np.log10(np.where(word, own, 1.0))
        self.count = np.where(word, np.log10(r.whole + 1), 0.0)
        self.known = word.astype(float)

    def values(self, u: np.ndarray, many: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
        """For each pair its logarithm, that of the count of its first word, and whether that is known."""
        out = [np.where(u == START, 0.0, self.unknown), np.zeros(len(u)), np.zeros(len(u))]
        if len(self.words):
            place = np.minimum(np.searchsorted(self.words, u), len(self.words) - 1)
            met = self.words[place] == u
            out = [np.where(met, x[place], y) for x, y in zip((self.score, self.count, self.known), out, strict=True)]
        out = [np.repeat(x, many) for x in out]
        if len(self.key):
            key = mixed(np.repeat(u, many), w)
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[0] = out[0] + np.where(self.key[place] == key, self.gain[place], 0.0)
        return out


def _asking(layout: Layout, flush: int, frequent: dict, kind: pa.DataType):
    """The pairs of a task's texts with the documents that hold them, dealt to shards, and one row for the documents themselves."""
    known = np.array(sorted(frequent), np.uint64)
    worth = np.array([frequent[int(k)] for k in known]).reshape(-1, 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        for rows, tokens, sizes in _chunks(batches, flush):
            words, code = _pairs(tokens, sizes)
            doc = np.repeat(np.arange(len(rows)), sizes)
            order = np.argsort(code)
            code, doc = code[order], doc[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            n, code = np.diff(first, append=len(code)), code[first]
            u, w = words[code >> 32], words[code & 0xFFFFFFFF]
            own = np.zeros((3, len(rows)))
            s = layout.shard(u, w)
            if len(known):
                key = mixed(u, w)
                place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                held = known[place] == key
                for j in np.flatnonzero(held).tolist():
                    hit = np.bincount(doc[first[j] : first[j] + n[j]], minlength=len(rows))
                    own += worth[place[j]][:, None] * hit
                doc = doc[~np.repeat(held, n)]
                u, w, n, s = u[~held], w[~held], n[~held], s[~held]
            if len(layout.cut):
                order = np.argsort(s, kind="stable")
                doc = doc[np.argsort(np.repeat(s, n), kind="stable")]
                u, w, n, s = u[order], w[order], n[order], s[order]
            out = _packed("q", part, u, w, n, s, doc)
            ids, held_out = zip(*rows, strict=True)
            out.append((-1 - part % layout.shards, "h", part, None, np.concatenate([sizes.astype(np.int32), np.array(held_out, np.int32)]), own.reshape(-1)))
            yield _with_ids(_box(out), ids, kind)
            part += 1

    return run


def _with_ids(table: pa.Table, ids: tuple, kind: pa.DataType) -> pa.RecordBatch:
    """The rows, with the documents' ids in the last."""
    col = pa.array([None] * (table.num_rows - 1) + [list(ids)], pa.list_(kind))
    return table.append_column("ids", col).combine_chunks().to_batches()[0]


def _scored(now: State, samples: int, unknown: float):
    """The sums that a shard's pairs add to documents, by task; rows of documents pass."""

    def run(table: pa.Table) -> pa.Table:
        at, got = _open(table)
        if at < 0:
            return table.select([*BOX.names, "ids"])
        rows = []
        if "q" in got:
            pairs = Pairs(got, now, samples, unknown)
            for part, k, i, _ in got["q"]:
                u, many, w, n, docs = _unpacked(k, i)
                docs, place = np.unique(docs, return_inverse=True)
                sums = [np.bincount(place.reshape(-1), weights=np.repeat(v, n), minlength=len(docs)) for v in pairs.values(u, many, w)]
                rows.append((at, "a", part, None, docs, np.concatenate(sums)))
        out = _box(rows)
        return out.append_column("ids", pa.nulls(out.num_rows, table.schema.field("ids").type))

    return run


def _summed(end: tuple[float, float, float], scale: float):
    """A task's documents with their sums. ``end``: what the end token adds."""

    def run(table: pa.Table) -> pa.Table:
        _, got = _open(table)
        [(_, _, i, own)] = got["h"]
        ids = table.filter(pa.compute.equal(table["kind"], "h"))["ids"].combine_chunks().flatten()
        n = len(ids)
        sums = own.reshape(3, n) + np.array(end)[:, None]
        for _, _, docs, x in got.get("a", []):
            sums[:, docs] += x.reshape(3, -1)
        sizes, held = i[:n].astype(np.int64), i[n:].astype(bool)
        cols = [ids, pa.array(held), pa.array(sizes), pa.array(np.rint(sums[2]).astype(np.int64)), pa.array(sums[1] - sizes * scale), pa.array(sums[0])]
        return pa.Table.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


@dataclass
class Model:
    """A fitted model: tables in the shared folder and a few numbers.

    ``unknown`` is the logarithm of the parent's mean probability of an unknown token; ``end`` is what the end token adds
    to a text's logarithm, to the logarithms of counts, and to its known tokens.
    """

    layout: Layout
    state: State
    samples: int
    n_tokens: int
    n_words: int
    fixed: DataFrame
    words: DataFrame
    seats: DataFrame
    parent: DataFrame
    answers: DataFrame
    unknown: float
    end: tuple[float, float, float]
    scratch: Scratch
    frequent: dict = field(default_factory=dict)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of what is written inside as soon as it has been written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def _put(scratch: Scratch, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows written by kind, so that a job reads only the kinds it needs."""
    path = scratch.path(name)
    with shuffles_deleted(df.sparkSession):
        df.write.partitionBy("kind").parquet(path)
    names = [f.name for f in df.schema.fields]
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*names), path


def _kinds(df: DataFrame, *kinds: str) -> DataFrame:
    return df.where(F.col("kind").isin(*kinds))


def _stat(df: DataFrame, n: int) -> list[float]:
    """The sums of the shards' numbers."""
    r = _kinds(df, "stat").agg(*(F.sum(F.col("x")[k]).alias(f"n{k}") for k in range(n))).first()
    return [float(x or 0.0) for x in r]


def _cut_state(df: DataFrame) -> dict:
    """Customers and tables of the restaurants that are cut, at most ``shards / CUT`` of them (from as many shards)."""
    out: dict = defaultdict(lambda: [0.0, 0.0])
    for r in _kinds(df, "cut").select("k", "x").toLocalIterator():
        for j, u in enumerate(r.k):
            out[u % (1 << 64)][0] += r.x[j]
            out[u % (1 << 64)][1] += r.x[len(r.k) + j]
    return {u: tuple(v) for u, v in out.items()}


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, tokens, _ in _chunks(batches, FLUSH):
        h, n = np.unique(tokens[tokens != END], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])


def _layout(texts: DataFrame, shards: int | None, sample_bytes: int) -> Layout:
    size = texts.agg(F.sum(F.octet_length(TEXT))).first()[0] or 0
    shards = shards or max(1, -(-size // SHARD_BYTES))
    if shards == 1:
        return Layout(1)
    some = texts.where(F.pmod(F.xxhash64(F.xxhash64(TEXT)), F.lit(1 << 20)) < max(1, int((1 << 20) * min(1.0, sample_bytes / size)))) if size > sample_bytes else texts
    counts = some.mapInArrow(_frequencies, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = sorted((r.h % (1 << 64), r.n) for r in counts.where(F.col("n") > CUT * total / shards).collect())  # fewer than shards / CUT
    if not found:
        return Layout(shards)
    return Layout(shards, np.array([h for h, _ in found], np.uint64), np.array([max(2, -(-n * shards // total)) for _, n in found], np.uint64))


def fit(docs: DataFrame, text_col: str = "text", shards: int | None = None, strengths: tuple[float, float] = (1.0, 1.0), burn: int = BURN, samples: int = SAMPLES, seed: int = 42, flush: int = FLUSH, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """The model of all texts of ``docs``, by ``burn + samples`` sweeps of which the last ``samples`` are averaged."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitmanyor")
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias(TEXT))
    layout = _layout(texts, shards, sample_bytes)
    ddl, deal = BOX_DDL, lambda df, fn: df.groupBy("at").applyInArrow(fn, BOX_DDL)
    floor = max(2, FREQUENT * flush // 16)
    fixed, fixed_path = _put(scratch, deal(texts.mapInArrow(_counted(layout, flush), ddl), _merged(layout, floor)), "pairs")
    words, _ = _put(scratch, deal(_kinds(fixed, "all"), _words), "words")
    n_tokens, once, twice = _stat(fixed, 3)
    n_words, w_once, w_twice, pairs = _stat(words, 4)
    discount = lambda a, b: min(0.9, max(0.1, a / (a + 2 * b))) if a else 0.5
    common = {"d0": discount(w_once, w_twice), "s0": strengths[0], "d1": discount(once, twice), "s1": strengths[1], "base": 1 / (n_words + 1)}
    cut = _cut_state(fixed) if len(layout.cut) else {}
    was = State(**common, customers=pairs, tables=n_words, cut=cut, seed=seed)
    seats, seats_path, top, top_path = fixed, None, words, None
    unknown = 0.0
    for k in range(burn + samples):
        count = k > burn
        now = State(**common, seed=seed * 1000 + k)
        new_top, path = _put(scratch, deal(_kinds(words, "w").unionByName(_kinds(top, "k", "t")).unionByName(_kinds(seats, "to")), _parent_drawn(was, now, count)), "parent")
        unknown += float(was.parent(np.zeros(1))[0]) if count else 0.0
        now.customers, now.tables = _stat(new_top, 2)
        now.cut = was.cut
        if top_path:
            remove(spark, top_path)
        top, top_path = new_top, path
        own = _kinds(fixed, "u", "C", "d", "m", "c").unionByName(_kinds(seats, "t", "b")).unionByName(_kinds(top, "p"))
        new, path = _put(scratch, deal(own, _drawn(layout, now, count)), "seats")
        now.cut = _cut_state(new) if len(layout.cut) else {}
        if seats_path:
            remove(spark, seats_path)
        seats, seats_path, was = new, path, now
    unknown = (unknown + float(was.parent(np.zeros(1))[0])) / samples
    asks = _kinds(fixed, "all").unionByName(_kinds(fixed, "u").select("at", "k").mapInArrow(_asked(layout.shards), ddl))
    answers, _ = _put(scratch, deal(_kinds(words, "w").unionByName(_kinds(top, "k", "t")).unionByName(asks), _answered(was, samples)), "answers")
    for kind in ("all", "to", "t", "b"):
        remove(spark, f"{fixed_path}/kind={kind}")
    p_end = [r.x[0] for r in _kinds(answers, "end").collect()]
    counts = docs.count() if p_end else 0
    end = (float(np.log10(p_end[0])), float(np.log10(counts + 1)), 1.0) if p_end else (float(np.log10(unknown)), 0.0, 0.0)
    model = Model(layout, was, samples, int(n_tokens), int(n_words), fixed, words, seats, top, answers, float(np.log10(unknown)), end, scratch)
    limit = FREQUENT * n_tokens / layout.shards
    found = set()
    for r in _kinds(fixed, "top").select("k").toLocalIterator():  # fewer pairs than tokens / floor
        found |= {(u % (1 << 64), w % (1 << 64)) for u, w, c in zip(r.k[::3], r.k[1::3], r.k[2::3], strict=True) if c > limit}
    if found:
        model.frequent = _worth(model, found)
    return model


def _worth(model: Model, found: set) -> dict:
    """What the most frequent pairs add, at most ``shards / FREQUENT`` of them."""
    u = np.array([x for x, _ in found], np.uint64)
    w = np.array([x for _, x in found], np.uint64)
    at = model.layout.shard(u, w)
    now, samples, unknown = model.state, model.samples, model.unknown

    def run(table: pa.Table) -> pa.Table:
        own, got = _open(table)
        mine = np.flatnonzero(at == own)
        if not len(mine):
            return _box([])
        value = Pairs(got, now, samples, unknown).values(u[mine], np.ones(len(mine), np.int64), w[mine])
        return _box([(own, "worth", 0, mixed(u[mine], w[mine]), None, np.concatenate(value))])

    here = _model_rows(model).where(F.col("at").isin(*{int(x) for x in at}))
    out = {}
    for r in here.groupBy("at").applyInArrow(run, BOX_DDL).collect():
        n = len(r.k)
        out |= {h % (1 << 64): (r.x[j], r.x[n + j], r.x[2 * n + j]) for j, h in enumerate(r.k)}
    return out


def _model_rows(model: Model) -> DataFrame:
    return _kinds(model.fixed, "u", "C", "d", "m", "c", "s").unionByName(_kinds(model.seats, "t", "b")).unionByName(_kinds(model.answers, "p", "own"))


def scores(model: Model, docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, flush: int = FLUSH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs``; scores are logarithms to base ten."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[id_col]
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias(TEXT))
    ask = _asking(model.layout, flush, model.frequent, to_arrow_type(own.schema["doc_id"].dataType))
    ddl = f"{BOX_DDL}, ids array<{kind}>"
    still = _model_rows(model).withColumn("ids", F.lit(None).cast(f"array<{kind}>"))
    scale = float(np.log10(model.n_tokens + model.n_words + 1))
    out = None
    for k in range(rounds):
        some = own.where(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(rounds)) == k)
        asked = some.mapInArrow(ask, ddl)
        sums = asked.unionByName(still).groupBy("at").applyInArrow(_scored(model.state, model.samples, model.unknown), ddl)
        done = sums.groupBy("part").applyInArrow(_summed(model.end, scale), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
        with shuffles_deleted(spark):
            done = model.scratch.cut(done, f"scores{k}")
        out = done if out is None else out.unionByName(done)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_scores(docs: DataFrame, **parameters) -> DataFrame:
    """All documents' scores, learned outside the fold crc32(doc_id) mod 7 = 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return scores(fit(docs.where(~held), **parameters), docs, held)
