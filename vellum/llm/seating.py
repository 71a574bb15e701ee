"""Chinese-restaurant seating of a dish's customers, drawn given all other seatings.

In a Pitman-Yor restaurant with discount ``d`` and strength ``s``, the predictive
probabilities depend on a dish's customers ``c`` and tables ``t`` alone, so the
sizes of its tables are summed out by generalised Stirling numbers: with ``T``
tables of other dishes and parent probability ``p``,

    P(t | c, rest)  ~  S(c, t) * prod over i < t of (s + d * (T + i)) * p

which is drawn exactly (a block Gibbs step for all customers of the dish) up to
``EXACT`` customers. Beyond, ``t`` moves by ``MOVES`` Metropolis steps within the
sweep, in constant memory. There ``S = c! / t! [x^c] ((1 - (1 - x)^d) / d)^t`` is
taken, for few tables, from the singularity at one (a short alternating sum,
exact), and for many from the saddle point (off by some hundredths in the
logarithm).
"""

from __future__ import annotations

import numpy as np

EXACT, MOVES = 512, 24
#: Entries of a matrix of weights at most.
ENTRIES = 1 << 21
#: Few tables: at most so many times ``c ** d``, by discounts below and from three quarters on (where the sum's terms cancel earlier). Terms of their sum.
FEW, TERMS = (2.2, 1.5), 200
_TABLES: dict[float, np.ndarray] = {}


def lgamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function, for positive numbers."""
    x = np.asarray(x, float)
    shift = np.ones_like(x)
    for k in range(8):
        shift *= np.where(x < 8, x + k, 1.0)
    z = np.where(x < 8, x + 8, x)
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / z - np.log(shift)


def log_stirling(d: float) -> np.ndarray:
    """``log S(c, t)`` for ``c, t <= EXACT``; minus infinity where there is no seating."""
    if d not in _TABLES:
        if len(_TABLES) > 8:
            _TABLES.clear()
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        t = np.arange(EXACT + 1)
        for c in range(1, EXACT):
            with np.errstate(divide="ignore"):
                stay = out[c] + np.log(np.maximum(c - d * t, 0.0))
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
        _TABLES[d] = out
    return _TABLES[d]


def log_stirling_far(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The same for large ``c`` and ``1 <= t < c``."""
    few = t <= FEW[d >= 0.75] * c**d
    out = np.empty(len(c))
    out[few] = _by_singularity(c[few], t[few], d)
    out[~few] = _by_saddle(c[~few], t[~few], d)
    return out


def _by_singularity(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """The sum of ``(-1)^j binom(t, j) [x^c] (1 - x)^(d j)``."""
    if not len(c):
        return np.empty(0)
    j = np.arange(1, min(int(t.max()), TERMS) + 1, dtype=float)
    c, t = c[:, None], t[:, None]
    size = lgamma(t + 1) - lgamma(j + 1) - lgamma(np.maximum(t - j, 0) + 1) + lgamma(c - d * j) + lgamma(1 + d * j) - lgamma(t + 1)
    size = np.where(j <= t, size, -np.inf)
    top = size.max(axis=1, keepdims=True)
    sign = np.where(j % 2 == 0, -1, 1) * np.sin(np.pi * d * j) / np.pi
    return np.log(np.maximum((np.exp(size - top) * sign).sum(axis=1), 1e-300)) + top[:, 0] - t[:, 0] * np.log(d)


def _by_saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    goal = c / t
    low, high = np.full(len(c), -700.0), np.zeros(len(c))  # log(1 - x); the slope falls from infinity to 1
    for _ in range(60):
        mid = (low + high) / 2
        steep = _slope(mid, d) > goal
        low, high = np.where(steep, mid, low), np.where(steep, high, mid)
    ly = (low + high) / 2
    x, f, m = -np.expm1(ly), -np.expm1(d * ly) / d, _slope(ly, d)
    spread = np.maximum(m + x * x * (1 - d) * np.exp((d - 2) * ly) / f - m * m, 1e-12)
    return lgamma(c + 1) - lgamma(t + 1) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * t * spread)


def _slope(ly: np.ndarray, d: float) -> np.ndarray:
    """``x f'(x) / f(x)`` at ``x = 1 - exp(ly)``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = -np.expm1(ly) * np.exp((d - 1) * ly) * d / -np.expm1(d * ly)
    return np.where(np.isfinite(out), out, np.where(ly > -1, 1.0, np.inf))


def draw(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, s: float, d: float, rng: np.random.Generator) -> np.ndarray:
    """New numbers of tables of dishes with ``c`` customers and ``t`` tables; ``others``: the tables of other dishes in the same restaurant."""
    out = np.ones(len(c), np.int64)
    if not len(c):
        return out
    order = np.argsort(c, kind="stable")
    sizes, starts = np.unique(c[order], return_index=True)
    ends = np.append(starts[1:], len(c))
    known = log_stirling(d)
    for size, a, b in zip(sizes.tolist(), starts.tolist(), ends.tolist(), strict=True):
        if size == 1:
            continue
        if size > EXACT:
            rest = order[a:]
            out[rest] = _moved(c[rest], t[rest], others[rest], p[rest], s, d, rng)
            break
        step = max(1, ENTRIES // size)
        for lo in range(a, b, step):
            some = order[lo : min(lo + step, b)]
            opened = np.log((s + d * (others[some, None] + np.arange(size))) * p[some, None])
            w = known[size, 1 : size + 1] + np.cumsum(opened, axis=1)
            w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + np.minimum((w < (rng.random(len(some)) * w[:, -1])[:, None]).sum(axis=1), size - 1)
    return out


def _moved(c: np.ndarray, t: np.ndarray, others: np.ndarray, p: np.ndarray, s: float, d: float, rng: np.random.Generator) -> np.ndarray:
    c, t = c.astype(float), np.clip(t, 1, c - 1).astype(float)
    base = s / d + others

    def weight(t: np.ndarray) -> np.ndarray:
        rising = lgamma(base + t) - lgamma(base) + t * np.log(d * p)
        return log_stirling_far(c, t, d) + rising

    now = weight(t)
    for k in range(MOVES):
        width = np.minimum((np.full(len(c), 2.0), np.sqrt(c) / 2, 2 * np.sqrt(c))[k % 3], c / 4)
        new = t + np.rint(rng.normal(0, 1, len(c)) * width)
        fit = (new >= 1) & (new < c)
        then = weight(np.where(fit, new, t))
        take = fit & (np.log(rng.random(len(c))) < then - now)
        t, now = np.where(take, new, t), np.where(take, then, now)
    return t.astype(np.int64)
