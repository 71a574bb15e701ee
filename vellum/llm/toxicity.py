"""Toxic spans and document scores by a linear-chain conditional random field.

Chains are lines, labels are 0 and 1. A token's emission is the sum of the weights of its hashed features: the word, prefixes,
suffixes and its shape. Labels exist for documents only, so tokens are labelled
first: a feature that occurs in many toxic training documents and hardly in
others marks its tokens in toxic documents; all other tokens are clean. The
field is trained on those labels in numpy, and generalises through the other
features. Forward-backward marginals give each token's probability; for a
document, their largest log-odds and the log of their sum go through a logistic
layer fitted on training documents that the field was not trained on.

With two labels the forward and backward vectors matter only up to a factor,
so each is one ratio a token; all chains of a batch advance together. Longer
chains lie in segments of ``SEGMENT`` tokens beside each other; a segment's
steps multiply to a matrix of two by two, which carries the ratios over it, so
the result is that of the whole chain.

What makes a marker (``Settings``) is chosen by ``validate``, which splits the
rows learned from once more and never sees the held-out ones.

Edge cases: null or empty texts have no tokens and get the score of the
logistic layer for none; labels that are null, or whose document is missing or
in the held-out fold, are not learned from; copies of a text count once in
training; with labels of one class only (or none) every score is 0.5 (and not
predicted toxic); a null ``doc_id`` is kept, repeated rows give a row each, an
empty table an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import by_bytes, map_texts, texts
from .quality import sample, usable

TOKEN = re.compile(r"[^\W_]+")
SEGMENT = 256
BITS = 18
MEMO_TOKENS = 300_000


@dataclass(frozen=True)
class Settings:
    """A marker occurs in ``docs`` toxic training documents at least, and ``precision`` of its occurrences (the classes weighted alike) is there.

    It is one of the first ``marking`` features of a token.
    """

    docs: int = 5
    precision: float = 0.9
    marking: int = 6


#: Seeds of the constant features: all small letters, a capital first, all capitals.
_SHAPES = (101, 102, 103)
WIDTH = 10


def features(token: str) -> tuple[int, ...]:
    """32-bit hashes of a token's features; the first six (the word, prefixes of 4 to 8 bytes) can be markers."""
    b = token.lower().encode("utf-8", "replace")
    shape = _SHAPES[0] if token.islower() else _SHAPES[2] if token.isupper() else _SHAPES[1]
    return (
        crc32(b, 1), crc32(b[:4], 2), crc32(b[:5], 3), crc32(b[:6], 4), crc32(b[:7], 5), crc32(b[:8], 6),
        crc32(b[:3], 7), crc32(b[-3:], 8), crc32(b[-5:], 9), shape,
    )


def cells(named: list[tuple[int, ...]]) -> np.ndarray:
    """Indices of the features' weights, a row for each token."""
    return np.array(named, np.int64).reshape(-1, WIDTH) & ((1 << BITS) - 1)


def chains(text: str) -> list[list[str]]:
    """The token sequences of a text, one for each line with a token."""
    return [tokens for line in text.split("\n") if (tokens := TOKEN.findall(line))]


class Grid:
    """Chains of different lengths side by side, in segments, longest first; step ``t`` holds the token ``t`` of each segment that has one."""

    def __init__(self, sizes: np.ndarray):
        sizes = np.asarray(sizes, np.int64)
        many = -(-sizes // SEGMENT)
        chain = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(chain)) - np.repeat(np.cumsum(many) - many, many)
        first = (np.cumsum(sizes) - sizes)[chain] + nth * SEGMENT
        size = np.minimum(SEGMENT, sizes[chain] - nth * SEGMENT)
        order = np.argsort(-size, kind="stable")
        ranked = size[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        steps = int(ranked[0]) if len(ranked) else 0
        self.active = np.searchsorted(-ranked, -np.arange(steps), side="left")
        self.at = np.cumsum(self.active) - self.active
        self.token = np.concatenate([first[order[:a]] + t for t, a in enumerate(self.active)]) if steps else np.zeros(0, np.int64)
        self.heads = (nth == 0)[order]
        self.last = self.at[ranked - 1] + np.arange(len(ranked)) if steps else np.zeros(0, np.int64)
        more = np.flatnonzero(nth)
        #: Segments that go on from another one, and those they go on from, in the order of the chains.
        self.follow, self.before = rank[more], rank[more - 1]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Grid places of all tokens that stand next to each other in a chain."""
        if not len(self.active):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        left = [self.at[t - 1] + np.arange(self.active[t]) for t in range(1, len(self.active))]
        return np.concatenate([*left, self.last[self.before]]), np.concatenate([np.arange(self.active[0], len(self.token)), self.follow])

    def _products(self, e: np.ndarray, up: float, down: float, stay: float) -> np.ndarray:
        """For each of ``follow`` the product of its steps, up to a factor, as rows of four numbers."""
        by = np.argsort(self.follow, kind="stable")
        ranks = self.follow[by]
        p, q, r, s = np.ones(len(ranks)), np.zeros(len(ranks)), np.zeros(len(ranks)), np.ones(len(ranks))
        for a, lo in zip(self.active.tolist(), self.at.tolist(), strict=True):
            k = int(np.searchsorted(ranks, a))
            x = e[lo + ranks[:k]]
            new = x * (stay * p[:k] + up * r[:k]), x * (stay * q[:k] + up * s[:k]), down * p[:k] + r[:k], down * q[:k] + s[:k]
            scale = np.maximum(new[0] + new[1], new[2] + new[3])
            p[:k], q[:k], r[:k], s[:k] = (v / scale for v in new)
        out = np.empty((len(ranks), 4))
        out[by] = np.stack([p, q, r, s], 1)
        return out

    def _forward(self, e: np.ndarray, first: np.ndarray, up: float, down: float, stay: float) -> np.ndarray:
        fore, before = np.empty(len(e)), 0
        for t, (a, lo) in enumerate(zip(self.active.tolist(), self.at.tolist(), strict=True)):
            now = slice(lo, lo + a)
            if t:
                r = fore[before : before + a]
                fore[now] = e[now] * (up + r * stay) / (1 + r * down)
            else:
                fore[now] = e[now] * first
            before = lo
        return fore

    def ratios(self, u: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward and backward ratios label 1 : label 0 in grid order. ``trans``: start, 0 to 1, 1 to 0, 1 to 1."""
        e = np.exp(np.clip(u, -30, 30))[self.token]
        start, up, down, stay = np.exp(trans)
        first = np.full(len(self.heads), start)
        fore, back = self._forward(e, first, up, down, stay), np.ones(len(e))
        if len(self.follow):
            steps = self._products(e, up, down, stay).tolist()
            end, behind = fore[self.last].tolist(), [1.0] * len(self.heads)
            follow, before = self.follow.tolist(), self.before.tolist()
            for k, b, (p, q, r, s) in zip(follow, before, steps, strict=True):
                first[k] = (up + end[b] * stay) / (1 + end[b] * down)
                end[k] = (p * end[b] + q) / (r * end[b] + s)
            for k, b, (p, q, r, s) in zip(follow[::-1], before[::-1], steps[::-1], strict=True):
                behind[b] = (p * behind[k] + r) / (q * behind[k] + s)
            fore = self._forward(e, first, up, down, stay)
            back[self.last] = behind
        for t in range(len(self.active) - 2, -1, -1):
            lo, nxt, a = self.at[t], self.at[t + 1], self.active[t + 1]
            x = e[nxt : nxt + a] * back[nxt : nxt + a]
            back[lo : lo + a] = (down + stay * x) / (1 + up * x)
        return fore, back

    def marginals(self, u: np.ndarray, trans: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each token, in the order of ``u``."""
        fore, back = self.ratios(u, trans)
        odds = fore * back
        out = np.empty(len(u))
        out[self.token] = odds / (1 + odds)
        return out

    def expected(self, u: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals, and expected counts of the start in label 1 and the moves 0 to 1, 1 to 0, 1 to 1."""
        fore, back = self.ratios(u, trans)
        odds = fore * back
        p = odds / (1 + odds)
        start, up, down, stay = np.exp(trans)
        counts = np.zeros(4)
        if len(self.active):
            counts[0] = p[: self.active[0]][self.heads].sum()
            e = np.exp(np.clip(u, -30, 30))[self.token]
            left, right = self.pairs()
            r, x = fore[left], e[right] * back[right]
            total = 1 + up * x + r * down + r * stay * x
            counts[1:] = (up * x / total).sum(), (r * down / total).sum(), (r * stay * x / total).sum()
        out = np.empty(len(u))
        out[self.token] = p
        return out, counts


def _moves(grid: Grid, y: np.ndarray) -> np.ndarray:
    y = y[grid.token]
    if not len(grid.active):
        return np.zeros(4)
    left, right = grid.pairs()
    a, b = y[left], y[right]
    return np.array([y[: grid.active[0]][grid.heads].sum(), ((1 - a) * b).sum(), (a * (1 - b)).sum(), (a * b).sum()], float)


@dataclass
class Model:
    weights: np.ndarray  #: of the hashed features
    trans: np.ndarray  #: start, 0 to 1, 1 to 0, 1 to 1
    layer: np.ndarray  #: bias, largest log-odds, log of the sum
    memo: dict = field(default_factory=dict, repr=False)

    def emissions(self, tokens: list[str]) -> np.ndarray:
        if len(self.memo) > MEMO_TOKENS:
            self.memo.clear()
        found = list(map(self.memo.get, tokens))
        missing = list({t for t, v in zip(tokens, found, strict=True) if v is None})
        if missing:
            sums = self.weights[cells(list(map(features, missing)))].sum(1)
            own = dict(zip(missing, sums.tolist(), strict=True))
            self.memo.update((t, v) for t, v in own.items() if len(t) <= 40)
            found = [own[t] if v is None else v for t, v in zip(tokens, found, strict=True)]
        return np.array(found, np.float64)

    def tag(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each token's marginal and the index of its text."""
        split = [chains(v) for v in values]
        each = [c for x in split for c in x]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = [t for c in each for t in c]
        owner = np.repeat(np.arange(len(values)), [sum(map(len, x)) for x in split])
        return Grid(sizes).marginals(self.emissions(flat), self.trans), owner

    def summary(self, values: list[str]) -> np.ndarray:
        """Two numbers a text: the largest log-odds of its tokens, the log of the sum of their marginals."""
        p, owner = self.tag(values)
        p = np.clip(p, 1e-9, 1 - 1e-9)
        top, total = np.full(len(values), -20.0), np.zeros(len(values))
        np.maximum.at(top, owner, np.log(p) - np.log1p(-p))
        total += np.bincount(owner, p, len(values))
        return np.stack([top, np.log(total + 1e-6)], 1)

    def score(self, values: list[str]) -> np.ndarray:
        z = self.layer[0] + self.summary(values) @ self.layer[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def markers(rows: list[tuple[str, int]], settings: Settings) -> set[int]:
    """Features that occur in many toxic documents and hardly in others; the classes count alike.

    Occurrences are weighed, not documents: a stem that makes a text toxic is repeated there, while others hold it once by accident.
    """
    size = Counter(y for _, y in rows)
    inside: Counter = Counter()
    times: tuple[Counter, Counter] = (Counter(), Counter())
    memo: dict[str, tuple[int, ...]] = {}
    for text, y in rows:
        own: Counter = Counter()
        for t, n in Counter(TOKEN.findall(text)).items():
            if t not in memo:
                memo[t] = tuple(set(features(t)[: settings.marking]))
            for f in memo[t]:
                own[f] += n
        times[y].update(own)
        if y:
            inside.update(own.keys())
    ratio = size[1] / max(1, size[0])
    least = max(3, min(settings.docs, size[1] // 10))
    return {f for f, n in inside.items() if n >= least and times[1][f] >= settings.precision * (times[1][f] + times[0][f] * ratio)}


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first is the bias."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(rows: list[tuple[str, int]], odds: float, epochs: int = 5, batch_tokens: int = 20_000, seed: int = 7, settings: Settings = Settings()) -> Model:
    """Learns from (text, label). ``odds``: toxic to other among all labelled documents, as the sample may be balanced."""
    rows = list(dict.fromkeys(rows))
    model = Model(np.zeros(1 << BITS), np.array([-3.0, -3.0, 0.0, 0.0]), np.zeros(3))
    if len({y for _, y in rows}) < 2:
        return model
    rng = np.random.default_rng(seed)
    rows = [rows[k] for k in rng.permutation(len(rows))]
    own, rest = rows[: len(rows) * 7 // 10], rows[len(rows) * 7 // 10 :]
    marked = markers(own, settings)
    number: dict[str, int] = {}
    each, labels = [], []
    for text, y in own:
        for c in chains(text):
            each.append(np.array([number.setdefault(t, len(number)) for t in c], np.int64))
            labels.append(y)
    named = [features(t) for t in number]
    toxic = np.array([not marked.isdisjoint(x[: settings.marking]) for x in named], float)
    table = cells(named)
    weights, scale = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    trans, tscale = model.trans.copy(), np.full(4, 1e-3)
    for _ in range(epochs):
        order = rng.permutation(len(each))
        sizes = np.array([len(each[k]) for k in order])
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(batch_tokens, sizes.sum() + batch_tokens, batch_tokens))
        for part in np.split(order, np.unique(cuts[cuts < len(order)])):
            if not len(part):
                continue
            types = np.concatenate([each[k] for k in part])
            size = np.array([len(each[k]) for k in part])
            y = toxic[types] * np.repeat(np.array([labels[k] for k in part]), size)
            kinds, inv = np.unique(types, return_inverse=True)
            grid = Grid(size)
            p, counts = grid.expected(weights[table[kinds]].sum(1)[inv], trans)
            slope = np.bincount(inv, p - y, len(kinds))
            uniq, cell = np.unique(table[kinds].ravel(), return_inverse=True)
            grad = np.bincount(cell, np.repeat(slope, WIDTH), len(uniq)) + 1e-3 * weights[uniq]
            scale[uniq] += grad * grad
            weights[uniq] -= 0.3 * grad / np.sqrt(scale[uniq])
            tgrad = counts - _moves(grid, y)
            tscale += tgrad * tgrad
            trans -= 0.3 * tgrad / np.sqrt(tscale)
    model.weights, model.trans = weights, trans
    x = np.concatenate([model.summary([t for t, _ in rest[k : k + 200]]) for k in range(0, len(rest), 200)]) if rest else np.zeros((0, 2))
    y = np.array([lab for _, lab in rest], float)
    if 0 < y.sum() < len(y):
        model.layer = logistic(x, y)
        model.layer[0] += np.log(odds) - np.log(y.sum() / (len(y) - y.sum()))
    else:
        model.layer = np.array([0.0, 1.0, 0.0])
    return model


def validate(rows: list[tuple[str, int]], odds: float, settings: Settings, parts: int = 4) -> tuple[float, float]:
    """Accuracy and mean log likelihood of the rows of each part by a model of the other parts. The rows are those that may be learned from."""
    rows = list(dict.fromkeys(rows))
    right, likely = [], []
    for k in range(parts):
        model = train([r for n, r in enumerate(rows) if n % parts != k], odds, settings=settings)
        own = rows[k::parts]
        p = np.concatenate([model.score([t for t, _ in own[n : n + 200]]) for n in range(0, len(own), 200)])
        y = np.array([lab for _, lab in own])
        right.append((p >= 0.5) == (y == 1))
        likely.append(np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)))
    return float(np.concatenate(right).mean()), float(np.concatenate(likely).mean())


def learning_rows(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, per_class: int = 2000,
) -> tuple[list[tuple[str, int]], float]:
    """At most ``per_class`` (text, label) of each class outside the held-out fold, and the odds of the classes among all of them."""
    rows = sample(docs, labels, label, id_col, text_col, folds, held, per_class)
    n1, n0 = usable(labels, label, id_col, folds, held).agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).first()
    return [(t.decode("utf-8", "replace"), y) for t, y in rows], max(n1, 1) / max(n0, 1)


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, per_class: int = 2000,
    settings: Settings = Settings(),
) -> Model:
    """A model from ``learning_rows``."""
    rows, odds = learning_rows(docs, labels, id_col, text_col, label, folds, held, per_class)
    return train(rows, odds, settings=settings)


_MODELS: dict = {}


def _local(shared, key: str) -> Model:
    """The model in this process; its memo lives as long as the process works on the same model."""
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*shared.value)
    return _MODELS[key]


def _shared(docs: DataFrame, model: Model):
    packed = (model.weights.astype(np.float32), model.trans, model.layer)
    return docs.sparkSession.sparkContext.broadcast(packed), str(crc32(packed[0].tobytes() + model.layer.tobytes()))


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, score`` for each row."""
    shared, key = _shared(docs, model)

    def run(values: list[bytes]) -> list:
        own = _local(shared, key)
        return [np.concatenate([own.score([v.decode("utf-8", "replace") for v in values[a:b]]) for a, b in by_bytes(values, batch_bytes)])]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(texts(docs, id_col, text_col), run, f"doc_id {kind}, score double", ["score"])


def toxic_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, batch_bytes: int = 1 << 20) -> DataFrame:
    """``doc_id, spans``: character offsets [start, stop) and the largest marginal of each run of tokens at ``least`` or more."""
    shared, key = _shared(docs, model)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("p", pa.float64())]))

    def run(values: list[bytes]) -> list:
        own, out = _local(shared, key), []
        for a, b in by_bytes(values, batch_bytes):
            part = [v.decode("utf-8", "replace") for v in values[a:b]]
            p, owner = own.tag(part)
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            for k, text in enumerate(part):
                q = p[bounds[k] : bounds[k + 1]]
                spans: list[dict] = []
                if (q >= least).any():
                    last = -2
                    for n, m in enumerate(TOKEN.finditer(text)):
                        if q[n] >= least:
                            if last == n - 1:
                                spans[-1] |= {"stop": m.end(), "p": max(spans[-1]["p"], float(q[n]))}
                            else:
                                spans.append({"start": m.start(), "stop": m.end(), "p": float(q[n])})
                            last = n
                out.append(spans)
        return [pa.array(out, kinds)]

    kind = dict(docs.dtypes)[id_col]
    return map_texts(texts(docs, id_col, text_col), run, f"doc_id {kind}, spans array<struct<start: long, stop: long, p: double>>", ["spans"])
