"""A manifest of a dataset: hash trees by source, and each document's authentication path.

Every document is a leaf. The leaves of a source, ascending by id, are hashed in
runs of three, level by level, to the source's subroot; the subroots, ordered by
source, likewise to the root. A path lists, level by level, the run that a node
lies in with ``*`` in the node's own place, so that the root can be recomputed
from any version of the document.

Documents are numbered in their source by a range partitioning, and cut into
aligned blocks of ``3 ** LEVELS``. A task meets its blocks one after the other,
in order, and gives their roots; these are the next round's nodes, until every
source has one. Back from the top, each block gets the path of its root (one
row), and a fractal traversal emits the paths of its leaves: the block's levels
are cut in bands of ``BAND``; in each band the subtree above the present leaf
is kept, and the next one to its right grows by one leaf a step, so that it is
whole when it is needed. A task holds one block's leaves, and of its inner nodes
two subtrees a band.

Edge cases: a null field is hashed as ``-``; a null source is a source of its
own and first; null ids come first; repeated rows are leaves of their own, in
any order among themselves; a source with one document has its leaf as subroot;
an empty table gives an empty result; further columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Nodes in a run, levels in a block, levels in a band.
FAN, LEVELS, BAND = 3, 6, 2
#: Rows that a task gives back at once, about.
ROWS = 2000


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` leaves."""
    h = 0
    while FAN**h < n:
        h += 1
    return h


class Subtree:
    """The nodes at the heights ``base`` to ``top - 1`` of the ``s``-th tree of height ``top``, growing by one leaf a step."""

    def __init__(self, leaves: list[str], base: int, top: int, s: int):
        self.leaves, self.base, self.top = leaves, base, top
        self.first, self.stop = s * FAN**top, min((s + 1) * FAN**top, len(leaves))
        self.next = self.first
        self.rows: list[list[str]] = [[] for _ in range(base, top)]
        self.open: list[list[str]] = [[] for _ in range(top - 1)]

    def _put(self, node: str, t: int) -> None:
        if t >= self.base:
            self.rows[t - self.base].append(node)
        if t < self.top - 1:
            self.open[t].append(node)

    def step(self) -> None:
        if self.next >= self.stop:
            return
        self._put(self.leaves[self.next], 0)
        self.next += 1
        for t in range(self.top - 1):
            if len(self.open[t]) < FAN and self.next < self.stop:
                break
            node = digest(self.open[t])
            self.open[t] = []
            self._put(node, t + 1)

    def whole(self) -> Subtree:
        while self.next < self.stop:
            self.step()
        return self

    def entry(self, leaf: int, t: int) -> str:
        """The run at height ``t`` above a leaf, with ``*`` for the leaf's own node."""
        own = leaf // FAN**t - self.first // FAN**t
        run = own // FAN * FAN
        row = self.rows[t - self.base]
        return "".join(row[run:own]) + "*" + "".join(row[own + 1 : run + FAN])


def paths(leaves: list[str], levels: int) -> Iterator[list[str]]:
    """The path of each leaf in turn, over ``levels`` levels."""
    bands = [(base, min(base + BAND, levels)) for base in range(0, levels, BAND)]
    existing = [Subtree(leaves, base, top, 0).whole() for base, top in bands]
    desired = [Subtree(leaves, base, top, 1) for base, top in bands]
    path = [""] * levels
    for i in range(len(leaves)):
        for k, (base, top) in enumerate(bands):
            if i and i % FAN**top == 0:
                existing[k], desired[k] = desired[k], Subtree(leaves, base, top, i // FAN**top + 1)
            for t in range(base, top):
                if i % FAN**t == 0:
                    path[t] = existing[k].entry(i, t)
            desired[k].step()
        yield path


def fold(nodes: list[str], levels: int) -> str:
    for _ in range(levels):
        nodes = [digest(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)]
    return nodes[0]


def block_levels(n: int, levels: int) -> int:
    """Levels inside a block of a tree with ``n`` nodes at the block's foot."""
    return min(height(n), levels)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """The consecutive rows of each ``(tree, block)``, the first two columns."""
    now, held = None, []
    for b in batches:
        trees, blocks = b.column(0).to_pylist(), b.column(1).to_pylist()
        start = 0
        for i in range(b.num_rows):
            key = (trees[i], blocks[i])
            if key != now:
                if i > start:
                    held.append(b.slice(start, i - start))
                if held:
                    yield now, held
                now, held, start = key, [], i
        if b.num_rows > start:
            held.append(b.slice(start))
    if held:
        yield now, held


def _roots(levels: int) -> Callable:
    """The root of each block, as a node of the next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (tree, block), parts in _blocks(batches):
            n = parts[0].column(3)[0].as_py()
            nodes = [x for p in parts for x in p.column(4).to_pylist()]
            out.append((tree, block, -(-n // FAN**levels), fold(nodes, block_levels(n, levels))))
            if len(out) >= ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    tree, pos, n, node = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), pa.array(node)], ["tree", "pos", "n", "node"])


def _emit(levels: int) -> Callable:
    """Every row's path. A block's first row is its head, with what follows on every path of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, node, flat, ends, subroot, root = [], [], [], [0], [], []

        def flushed() -> pa.RecordBatch:
            proof = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))
            cols = [pa.concat_arrays(own), pa.concat_arrays(node), proof, pa.array(subroot), pa.array(root)]
            for x in (own, node, flat, subroot, root):
                x.clear()
            ends[:] = [0]
            return pa.RecordBatch.from_arrays(cols, ["own", "node", "proof", "subroot", "root"])

        for _, parts in _blocks(batches):
            head = parts[0].slice(0, 1)
            above, top = head.column(6)[0].as_py(), (head.column(7)[0].as_py(), head.column(8)[0].as_py())
            parts = [parts[0].slice(1), *parts[1:]]
            leaves = [x for p in parts for x in p.column(4).to_pylist()]
            own += [p.column(5) for p in parts]
            node += [p.column(4) for p in parts]
            for path in paths(leaves, block_levels(head.column(3)[0].as_py(), levels)):
                flat += path
                flat += above
                ends.append(len(flat))
            subroot += [top[0]] * len(leaves)
            root += [top[1]] * len(leaves)
            if len(subroot) >= ROWS:
                yield flushed()
        if subroot:
            yield flushed()

    return run


def _numbered(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``tree, pos, n, node, own``: ``pos`` is the row's place in its tree, ``n`` the tree's rows.

    ``order`` starts with the tree; the last of it tells equal rows apart, so that no task gets all of them.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.cut(dealt.withColumn("part", F.shiftright("at", 33)), "dealt")
    scratch.drop(df)
    w = Window.partitionBy("tree").orderBy("part")
    runs = dealt.groupBy("tree", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    before = runs.select(
        F.col("tree").alias("t"), F.col("part").alias("p"), "first",
        F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("c").over(Window.partitionBy("tree")).alias("n"),
    )
    met = dealt.join(before, F.col("tree").eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    out = scratch.cut(met.select("tree", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", "node", "own"), "nodes")
    scratch.drop(dealt)
    return out


def _in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.select("tree", F.floor(F.col("pos") / FAN**levels).cast("long").alias("block"), "pos", "n", "node", *(c for c in nodes.columns if c not in ("tree", "pos", "n", "node")))


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _climb(nodes: DataFrame, levels: int, scratch: Scratch) -> list[DataFrame]:
    """The nodes of each round from the given ones up; the last round's trees have one block each."""
    rounds = [nodes]
    while True:
        own = rounds[-1] if len(rounds) == 1 else rounds[-1].where("n > 1")
        up = _dealt(_in_blocks(own.select("tree", "pos", "n", "node"), levels)).mapInArrow(_roots(levels), "tree string, pos long, n long, node string")
        rounds.append(scratch.cut(up, "roots"))
        if not rounds[-1].where("n > 1").head(1):
            return rounds


def _descend(rounds: list[DataFrame], tops: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """``own, node, proof, subroot, root`` of the first round's nodes. ``tops``: ``tree, above, subroot, root`` for each tree."""
    single = tops.select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot", "root")
    heads = None
    for k in range(len(rounds) - 2, -1, -1):
        nodes = rounds[k] if k == 0 else rounds[k].where("n > 1").withColumn("own", F.struct("tree", "pos"))
        sizes = nodes.groupBy("tree").agg(F.first("n").alias("n"))
        here = _in_tree(single, sizes.where(F.col("n") <= FAN**levels))
        if heads is not None:
            here = here.unionByName(_in_tree(heads, sizes))
        kind = dict(nodes.dtypes)["own"]
        body = _in_blocks(nodes.select("tree", "pos", "n", "node", "own"), levels).withColumns({"above": F.lit(None).cast("array<string>"), "subroot": F.lit(None).cast("string"), "root": F.lit(None).cast("string")})
        tagged = here.select("tree", "block", F.lit(-1).cast("long").alias("pos"), "n", F.lit(None).cast("string").alias("node"), F.lit(None).cast(kind).alias("own"), "above", "subroot", "root")
        out = _dealt(body.unionByName(tagged)).mapInArrow(_emit(levels), f"own {kind}, node string, proof array<string>, subroot string, root string")
        if k == 0:
            return out
        heads = scratch.cut(out.select("own.tree", F.col("own.pos").alias("block"), F.col("proof").alias("above"), "subroot", "root"), "heads")
    raise AssertionError("a climb has two rounds at least")


def _in_tree(heads: DataFrame, sizes: DataFrame) -> DataFrame:
    return heads.join(sizes.select(F.col("tree").alias("t"), "n"), F.col("tree").eqNullSafe(F.col("t"))).drop("t")


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in bytes, ``:`` and itself."""
    shown = [F.coalesce(F.concat(F.octet_length(x.cast("string")).cast("string"), F.lit(":"), x.cast("string")), F.lit("-")) for x in fields]
    return F.sha2(F.concat(*shown).cast("binary"), 256)


def refolded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has by a path."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.replace(run, F.lit("*"), node).cast("binary"), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a path's siblings, in order."""
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit("*"), F.lit("")).cast("binary"), 256)


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tree_col: str = "source", order_col: str = "doc_id", levels: int = LEVELS, **more: Column) -> DataFrame:
    """``tree, order, leaf, proof, subroot, root`` and the columns of ``more`` for each row.

    ``tree`` is the row's ``tree_col`` as text, ``order`` its ``order_col``.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    col = lambda c: F.col(f"`{c}`")
    own = F.struct(col(order_col).alias("order"), *(v.alias(k) for k, v in more.items()))
    leaves = docs.select(col(tree_col).cast("string").alias("tree"), own.alias("own"), leaf_hash(*map(col, fields)).alias("node"))
    leaves = scratch.cut(leaves.withColumns({"order": F.col("own.order"), "nth": F.monotonically_increasing_id()}), "leaves")
    nodes = _numbered(leaves, ["tree", "order", "node", "nth"], scratch)
    if not nodes.head(1):
        heads = nodes.select("tree", F.lit(None).cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), "node", "own")
        return _shown(heads, more)
    rounds = _climb(nodes, levels, scratch)
    ends = rounds[1].where("n = 1")
    for r in rounds[2:]:
        ends = ends.unionByName(r.where("n = 1"))
    forest = ends.select(F.lit(None).cast("string").alias("tree"), F.struct("tree").alias("own"), "node", F.col("tree").alias("source"))
    upper = _climb(_numbered(forest, ["tree", "source"], scratch), levels, scratch)
    root = upper[-1].select("tree", F.array().cast("array<string>").alias("above"), F.lit("").alias("subroot"), F.col("node").alias("root"))
    subroots = scratch.cut(_descend(upper, root, levels, scratch).select("own.tree", F.col("proof").alias("above"), F.col("node").alias("subroot"), "root"), "subroots")
    return _shown(_descend(rounds, subroots, levels, scratch), more)


def _shown(out: DataFrame, more: dict[str, Column]) -> DataFrame:
    return out.select("own.order", F.col("node").alias("leaf"), "proof", "subroot", "root", *(f"own.{k}" for k in more))


def checked(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest's digests, and the root that each document has after line ends were lost from those with an even CRC-32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    shown = F.when(hit, leaf_hash(*fields, F.replace("text", F.lit("\n"), F.lit("")))).otherwise(leaf_hash(*fields, F.col("text")))
    out = manifest(docs, levels=levels, shown=shown)
    again = refolded(F.col("shown"), F.col("proof"))
    out = out.select(F.col("order").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle_sql(levels: int = 12, upper: int = 4) -> str:
    """The same by one join a level; enough for ``3 ** levels`` documents of a source and ``3 ** upper`` sources."""

    def shown(text: str) -> str:
        parts = [f"coalesce(strlen({x}) || ':' || {x}, '-')" for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
        return f"sha256({' || '.join(parts)})"

    def climb(name: str, key: str, first: str, n: int) -> list[str]:
        out = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(n):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT {key}, i // 3 AS r, list(h ORDER BY i) AS hs, any_value(c) AS c FROM {name}{k} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {key}, r AS i, (c + 2) // 3 AS c, CASE WHEN c > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}r{k})")
        return out

    def down(name: str, n: int, at: str, came: str, same: str) -> list[str]:
        out = []
        for k in range(n):
            o = f"({at} // {3**k}) % 3"
            left, right = f"array_to_string(hs[1:{o}], '')", f"array_to_string(hs[{o} + 2:], '')"
            out.append(f"""{name}d{k} AS MATERIALIZED (SELECT d.* EXCLUDE (f, p), CASE WHEN t.c > 1 THEN sha256({left} || f || {right}) ELSE f END AS f, p || {left} || {right} AS p
                FROM {came} d JOIN {name}r{k} t ON t.r = {at} // {3 ** (k + 1)} AND {same})""")
            came = f"{name}d{k}"
        return out

    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT), lambda c, b: {bits}), 4294967295)"
    steps = [f"crcs AS (SELECT *, {crc} AS crc FROM documents)"]
    steps += [f"""x AS (SELECT doc_id, source, {shown("text")} AS leaf, CASE WHEN crc % 2 = 0 THEN {shown("replace(text, chr(10), '')")} ELSE {shown("text")} END AS bad FROM crcs)"""]
    steps += climb("a", "source", "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS c, leaf AS h, doc_id, bad FROM x", levels)
    steps += climb("b", "0 AS z", f"SELECT source, 0 AS z, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS c, h FROM a{levels}", upper)
    steps += ["s AS (SELECT doc_id, source, i, h AS leaf, bad AS f, '' AS p FROM a0)"]
    steps += down("a", levels, "d.i", "s", "t.source IS NOT DISTINCT FROM d.source")
    steps += [f"m AS (SELECT d.*, b.i AS j, b.h AS subroot FROM ad{levels - 1} d JOIN b0 b ON b.source IS NOT DISTINCT FROM d.source)"]
    steps += down("b", upper, "d.j", "m", "true")
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified FROM bd{upper - 1}, b{upper}"
