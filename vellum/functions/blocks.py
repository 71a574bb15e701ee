"""How many characters of two texts lie in matching blocks, as the standard library's matcher without its rule for frequent characters finds them.

The matcher takes the longest common run of characters (of equal ones the first in the first text, then the first in the
second) and goes on left and right of it. Which characters are equal is found for all pairs of places at once, as one
array of bits; the runs are read from it by length, long ones first, so that short ones are only looked for where they still
count. Texts too long for such an array are cut at their longest run first, found by ranks of windows.
"""

from __future__ import annotations

import numpy as np

#: Pairs of places in an array; runs that are looked at together; lengths from which runs are read from the array, and of the pairs left then.
CELLS, RUNS, LONG, SHORT = 1 << 22, 1000, 6, 3

_Run = tuple[int, int, int]


def matched(x: str, y: str) -> int:
    """The sum of the sizes of ``SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()``."""
    found, open_ = 0, [(_codes(x), _codes(y))]
    while open_:
        a, b = open_.pop()
        if len(a) and len(b) and (len(b) + 1) * len(a) <= CELLS:
            found += _within(a, b)
        elif len(a) and len(b):
            i, j, k = longest(a, b)
            found += k
            if k:
                open_ += [(a[:i], b[:j]), (a[i + k :], b[j + k :])]
    return found


def _codes(text: str) -> np.ndarray:
    out = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out.astype(np.uint8) if len(out) and out.max() < 255 else out


def longest(a: np.ndarray, b: np.ndarray) -> _Run:
    """Where the longest common run begins in both and its length; time grows little faster than the texts."""
    n, most = len(a), min(len(a), len(b))
    ranks, size = np.unique(np.concatenate([a, b]), return_inverse=True)[1], 1

    def joined(gap: int) -> np.ndarray:
        """Ranks of windows made of two of the present ones."""
        return np.unique(ranks[: len(ranks) - gap] * len(ranks) + ranks[gap:], return_inverse=True)[1]

    def place(of: np.ndarray, width: int) -> tuple[int, int] | None:
        ours, theirs = of[: n - width + 1], of[n:]
        first = np.flatnonzero(np.isin(ours, theirs))
        return (int(first[0]), int(np.argmax(theirs == ours[first[0]]))) if len(first) else None

    at = place(ranks, 1)
    if at is None:
        return 0, 0, 0
    above = most + 1  # the shortest length that isn't common
    while 2 * size < above:
        wider = joined(size)
        met = place(wider, 2 * size)
        if met is None:
            above = 2 * size
        else:
            ranks, size, at = wider, 2 * size, met
    low = size
    while low + 1 < above:
        middle = (low + above) // 2
        met = place(joined(middle - size), middle)
        low, above, at = (middle, above, met) if met else (low, middle, at)
    return *at, low


def _within(a: np.ndarray, b: np.ndarray) -> int:
    """The same for texts whose pairs of places fit in an array."""
    grid = _Grid(a, b)
    blocks = _long(grid, LONG, [])
    left = _Left(grid)
    blocks = _taken(left.runs(SHORT), SHORT, blocks)
    for size in range(SHORT - 1, 0, -1):  # no run is longer any more: taken in order of place
        left.keep(blocks)
        blocks = sorted(blocks + left.in_order(size))
    return sum(k for _, _, k in blocks)


def _places(bits: np.ndarray) -> np.ndarray:
    """Where few bits are set, read by eights."""
    whole = len(bits) // 8 * 8
    words = np.flatnonzero(bits[:whole].view(np.uint64))
    at = np.flatnonzero(bits[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[at >> 3] * 8 + (at & 7), whole + np.flatnonzero(bits[whole:])])


class _Grid:
    """Which places of two texts are equal: a row for each place of ``a``, and behind those of ``b`` one that never is."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.n, self.m = len(a), len(b)
        self.row, self.step = self.m + 1, self.m + 2  # from a row to the next, and from a pair of places to the one behind it
        equal = np.zeros((self.n, self.row), bool)
        np.equal(a[:, None], b[None, :], out=equal[:, : self.m])
        self.equal = equal.ravel()

    def runs(self, least: int) -> list[_Run]:
        """``(minus length, place in a, place in b)`` of runs of ``least`` or more, by place in a."""
        own, have = self.equal, 1
        while have < least:
            more = min(have, least - have)
            own, have = own[: -more * self.step] & own[more * self.step :], have + more
        first, last = own.copy(), own.copy()
        np.greater(own[self.step :], own[: -self.step], out=first[self.step :])
        np.greater(own[: -self.step], own[self.step :], out=last[: -self.step])
        first, last = self.by_line(_places(first)), self.by_line(_places(last))
        return self.listed(first, (last - first) // self.step + least)

    def by_line(self, at: np.ndarray) -> np.ndarray:
        """Pairs in the order of the lines that runs lie on."""
        size = len(self.equal)
        return np.sort(at % self.step * size + at) % size

    def listed(self, first: np.ndarray, lengths: np.ndarray) -> list[_Run]:
        order = np.argsort(first)
        i, j = np.divmod(first[order], self.row)
        return list(zip((-lengths[order]).tolist(), i.tolist(), j.tolist(), strict=True))

    def labels(self, blocks: list[_Run]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of rows and columns, the same for those between the same two of the blocks, which are in order, and not for others."""
        out = np.arange(2 * len(blocks) + 1, dtype=np.int16)
        out[1::2] = -1
        i, j, k = np.array(blocks, np.int64).reshape(-1, 3).T

        def sizes(x: np.ndarray, end: int) -> np.ndarray:
            edges = np.zeros(len(out) + 1, np.int64)
            edges[1:-1:2], edges[2:-1:2], edges[-1] = x, x + k, end
            return edges[1:] - edges[:-1]

        rows = np.repeat(out, sizes(i, self.n))
        out[1::2] = -2
        return rows, np.repeat(out, sizes(j, self.row))

    def keep(self, blocks: list[_Run]) -> None:
        """Only pairs between the same two of the blocks stay."""
        rows, cols = self.labels(blocks)
        self.equal &= (rows[:, None] == cols[None, :]).ravel()


class _Left:
    """The equal pairs that are left in a grid, by their places."""

    def __init__(self, grid: _Grid):
        self.grid, self.at = grid, _places(grid.equal)

    def runs(self, least: int) -> list[_Run]:
        line = self.grid.by_line(self.at)
        begins = np.flatnonzero(np.append(True, line[1:] - line[:-1] != self.grid.step)[: len(line)])
        lengths = np.append(begins[1:], len(line)) - begins if len(line) else begins
        long = lengths >= least
        return self.grid.listed(line[begins[long]], lengths[long])

    def keep(self, blocks: list[_Run]) -> None:
        rows, cols = self.grid.labels(blocks)
        self.at = self.at[rows[self.at // self.grid.row] == cols[self.at % self.grid.row]]

    def in_order(self, size: int) -> list[_Run]:
        """Runs of that length, none of which is longer: each the first behind the one before."""
        at, out, i, j = self.at, [], 0, 0
        for _ in range(size - 1):
            behind = at + self.grid.step
            at = at[at[np.minimum(np.searchsorted(at, behind), len(at) - 1)] == behind]
        x, y = np.divmod(at, self.grid.row)
        for x, y in zip(x.tolist(), y.tolist(), strict=True):
            if x >= i and y >= j:
                out.append((x, y, size))
                i, j = x + size, y + size
        return out


def _long(grid: _Grid, least: int, blocks: list[_Run]) -> list[_Run]:
    """``blocks`` and those of ``least`` or more between them, in order; the grid keeps the pairs between all of them."""
    if least > min(grid.n, grid.m):
        return blocks
    runs = grid.runs(least)
    if len(runs) > RUNS and 4 * least <= min(grid.n, grid.m):
        blocks = _long(grid, 4 * least, blocks)
        runs = grid.runs(least)
    if runs:
        blocks = _taken(runs, least, blocks)
        grid.keep(blocks)
    return blocks


def _taken(runs: list[_Run], least: int, blocks: list[_Run]) -> list[_Run]:
    """``blocks`` and those that the matcher takes between them, of runs of ``least`` or more that each lie between two; both are in order."""
    parts, k = [[] for _ in range(len(blocks) + 1)], 0
    for run in runs:
        while k < len(blocks) and run[1] >= blocks[k][0]:
            k += 1
        parts[k].append(run)
    out = list(blocks)
    while parts:
        runs = parts.pop()
        if not runs:
            continue
        k, i, j = min(runs)
        k = -k
        out.append((i, j, k))
        if len(runs) == 1:
            continue
        before, behind, i_end, j_end = [], [], i + k, j + k
        for n, x, y in runs:  # cut to what lies before or behind the block; none does both, it would be longer
            if x < i and y < j:
                n = max(n, x - i, y - j)
                if -n >= least:
                    before.append((n, x, y))
            else:
                cut = i_end - x if i_end - x > j_end - y else j_end - y
                if cut <= 0:
                    behind.append((n, x, y))
                elif -n - cut >= least:
                    behind.append((n + cut, x + cut, y + cut))
        parts += [before, behind]
    return sorted(out)
