"""Minimum-cost-flow resharding.

Rows lie in old shards: those of a column, or, where there is none, of a hash.
They are grouped in blocks by a hash of the text, so equal texts share a block
and stay together; a block counts for the old shard that holds most of it. From
the sizes of the old shards and the capacities of the new ones a flow network
is solved: a unit of flow is a byte, staying is free and moving costs one a
byte. Its answer says how many bytes each shard gives to each other one, and
that sum is the least possible. Whole blocks are then chosen to make up those
amounts, each old shard giving its blocks in descending size to the receiver
that still lacks most, as long as the block fits what is owed. If large blocks
leave a shard too full by more than ``TOLERANCE``, further blocks move from the
fullest shard to the emptiest for as long as that helps.

A block with more than a ``PARTS``-th of a fair shard is cut up by text: its
frequent texts are blocks of their own, the others share ``PARTS`` smaller
ones. Only a text with more bytes than a fair shard, which no law of sizes can
keep whole, is dealt by row, into as many blocks as its rows need to be of
ordinary length. All other groups of equal texts stay whole.

Only blocks, whose number is a parameter, and those texts' hashes reach the
driver. Slots within a shard are counted per block first, and per piece of a
block with many rows (if of one text), so no task sorts a whole shard.

``rewrite`` writes the rows of the shards that gain or lose some, and deletes
the folders of those that end empty; other shards' files stay as they are.

Edge cases: null texts have size 1; null and repeated ids are kept, repeated
rows get a slot each; rows whose old shard is null lie where the hash says;
an empty table gives an empty result; further columns are ignored by
``reshard`` and carried along by ``rewrite``, whatever their names (``__shard``
and ``__slot`` are the layout itself).
"""

from __future__ import annotations

from bisect import insort
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .rows import ROW, packed
from ..scratch import Scratch, remove

#: Blocks of texts.
BLOCKS = 4096
#: Blocks beyond this part of a fair shard are cut up by text.
PARTS = 16
#: A block with so many times the mean number of rows is numbered in pieces.
PIECE = 4
#: Sub-blocks from this number on are rows of one text that are dealt.
DEALT = 1 << 32
#: A shard may be fuller than its capacity by this part of it.
TOLERANCE = 0.002


@dataclass
class _Edge:
    to: int
    room: int
    cost: int
    back: int


class Flow:
    """Minimum-cost flow by successive shortest paths; for networks of some dozens of shards."""

    def __init__(self, n: int):
        self.out: list[list[_Edge]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, room: int, cost: int) -> tuple[int, int]:
        self.out[a].append(_Edge(b, room, cost, len(self.out[b])))
        self.out[b].append(_Edge(a, 0, -cost, len(self.out[a]) - 1))
        return a, len(self.out[a]) - 1

    def solve(self, s: int, t: int) -> int:
        total = 0
        while True:
            best: list[float] = [float("inf")] * len(self.out)
            via: list[tuple[int, int] | None] = [None] * len(self.out)
            best[s], queue = 0, deque([s])
            while queue:
                a = queue.popleft()
                for k, e in enumerate(self.out[a]):
                    if e.room and best[a] + e.cost < best[e.to]:
                        best[e.to], via[e.to] = best[a] + e.cost, (a, k)
                        queue.append(e.to)
            if via[t] is None:
                return total
            path, at = [], t
            while at != s:
                path.append(via[at])
                at = via[at][0]
            n = min(self.out[a][k].room for a, k in path)
            for a, k in path:
                e = self.out[a][k]
                e.room -= n
                self.out[e.to][e.back].room += n
                total += n * e.cost


def transfers(old: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes that each old shard gives to each new one (staying included), with the fewest bytes moved."""
    if sum(old) > sum(capacity):
        raise ValueError("the new shards can't hold the rows")
    n, m = len(old), len(capacity)
    net = Flow(n + m + 2)
    s, t = n + m, n + m + 1
    for i, x in enumerate(old):
        net.add(s, i, x, 0)
    ways = {(i, j): net.add(i, n + j, old[i], int(i != j)) for i in range(n) for j in range(m)}
    for j, x in enumerate(capacity):
        net.add(n + j, t, x, 0)
    net.solve(s, t)
    return {w: f for w, (a, k) in ways.items() if (f := old[w[0]] - net.out[a][k].room)}


def plan(blocks: list[tuple[int, int, int]], capacity: list[int]) -> dict[int, int]:
    """New shard by block, from (block, old shard, bytes). Old shards that are no longer wanted count as one."""
    m = len(capacity)
    blocks = [(b, i if 0 <= i < m else m, size) for b, i, size in blocks]
    old = [0] * (m + 1)
    for _, i, size in blocks:
        old[i] += size
    owed = {w: f for w, f in transfers(old, capacity).items() if w[0] != w[1]}
    where, left = {}, list(capacity)
    for b, i, size in sorted(blocks, key=lambda x: (-x[2], x[0])):
        to = max((w for w in owed if w[0] == i and owed[w] >= size), key=lambda w: (owed[w], -w[1]), default=None)
        if to:
            owed[to] -= size
        where[b] = to[1] if to else i
        if where[b] < m:
            left[where[b]] -= size
    for b, _, size in sorted((x for x in blocks if where[x[0]] == m), key=lambda x: (-x[2], x[0])):
        where[b] = max(range(m), key=lambda j: (left[j], -j))
        left[where[b]] -= size
    return _settled({b: size for b, _, size in blocks}, where, left, capacity)


def _settled(size: dict[int, int], where: dict[int, int], left: list[int], capacity: list[int]) -> dict[int, int]:
    """Moves blocks from the fullest shard to the emptiest while one is too full and that helps."""
    slack = TOLERANCE * sum(capacity) / max(1, len(capacity))
    held: dict[int, list[int]] = {j: [] for j in range(len(capacity))}
    for b in sorted(where, key=lambda b: (size[b], b)):
        held[where[b]].append(b)  # ascending
    while left and -min(left) > slack:
        i, j = left.index(min(left)), left.index(max(left))
        gap = left[j] - left[i]
        fits = [k for k, b in enumerate(held[i]) if 2 * size[b] <= gap] or [k for k, b in enumerate(held[i]) if size[b] < gap][:1]
        if not fits or not size[held[i][fits[-1]]]:
            break
        b = held[i].pop(fits[-1])
        where[b] = j
        left[i] += size[b]
        left[j] -= size[b]
        insort(held[j], b, key=lambda x: (size[x], x))
    return where


def text_size(text_col: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus one."""
    return F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long") + 1


def block_of(text_col: str, blocks: int = BLOCKS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.lit(blocks)).cast("int")


def first_layout(block: Column, shards: int) -> Column:
    """The layout that rows without an old shard are taken to have: by hash of the block."""
    return F.pmod(F.hash(block), F.lit(shards)).cast("int")


def _placed(
    docs: DataFrame, shards: int, capacity: list[int] | None, old_shards: int | None, id_col: str, text_col: str, blocks: int, old_col: str | None, together: bool, carry: bool
) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` for each row, and the packed row itself if it is to be carried."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    block = block_of(text_col, blocks)
    hashed = first_layout(block, old_shards or shards)
    own = packed(
        docs, doc_id=F.col(f"`{id_col}`"), size=text_size(text_col), text_crc32=F.crc32(text.cast("binary")), block=block, text_hash=F.xxhash64(text),
        old_shard=F.coalesce(F.col(f"`{old_col}`").cast("int"), hashed) if old_col else hashed, row_id=F.monotonically_increasing_id(),
    )
    rows = scratch.cut(own if carry else own.drop(ROW), "rows")  # written, so that the row ids stay as they are
    sizes = {r["block"]: (r["size"], r["n"]) for r in rows.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}  # at most blocks rows
    total, n_rows = sum(x for x, _ in sizes.values()), sum(n for _, n in sizes.values())
    room = capacity or [total // shards + (k < total % shards) for k in range(shards)]
    if capacity is None and total:
        room = [max(1, x) for x in room]
    fair = max(room, default=0)
    large = [b for b, (x, _) in sizes.items() if x * PARTS > fair]  # at most PARTS * shards
    sub = F.lit(0).cast("long")
    if large:
        by_text = rows.where(F.col("block").isin(large)).groupBy("text_hash").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        heavy = by_text.where(F.col("size") * PARTS > fair).collect()  # at most PARTS * shards
        each = max(1, n_rows // blocks)
        named = [(r["text_hash"], k if r["size"] > fair else -k, max(PARTS, -(-r["n"] // each)) if r["size"] > fair else 1) for k, r in enumerate(sorted(heavy, key=lambda r: r["text_hash"]), 1)]
        rows = rows.join(F.broadcast(spark.createDataFrame(named, "text_hash long, k int, pieces int")), "text_hash", "left")
        alone = F.when(F.col("k") < 0, PARTS - F.col("k")).otherwise(F.col("k") * DEALT + F.pmod(F.xxhash64("row_id"), F.col("pieces")))
        shared = 1 + F.pmod(F.hash("text_hash"), F.lit(PARTS))
        sub = F.when(F.col("k").isNotNull(), alone).when(F.col("block").isin(large), shared).otherwise(0).cast("long")
    rows = rows.withColumn("sub", sub).withColumn("part", F.lit(-1) if together else F.col("old_shard"))
    # a block of many rows, if of few bytes, is numbered in pieces
    least = PIECE * max(1, n_rows // blocks)
    long = [(b, -(-n // least)) for b, (_, n) in sizes.items() if n > least]  # at most blocks / PIECE
    piece = F.lit(0)
    if long:
        rows = rows.join(F.broadcast(spark.createDataFrame(long, "block int, cuts int")), "block", "left")
        piece = F.when(F.col("cuts").isNotNull() & (F.col("sub") < DEALT), F.pmod(F.xxhash64("row_id"), F.col("cuts")).cast("int")).otherwise(0)
    rows = rows.withColumn("piece", piece)
    keys = ["block", "sub", "part", "piece"]
    parts = rows.groupBy(*keys, "old_shard").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    home = F.max_by("old_shard", F.struct("size", -F.col("old_shard"))).alias("home")
    cells = sorted(parts.groupBy(*keys).agg(F.sum("size").alias("size"), F.sum("n").alias("n"), home, F.max("size").alias("at_home")).collect(), key=lambda r: r[:4])
    # blocks (times old shards, unless together), PARTS more for each large one, and about blocks again for pieces and for the rows of texts beyond a fair shard
    units: dict[tuple, list] = {}
    for r in cells:
        own = units.setdefault(tuple(r[:3]), [len(units), r["home"], 0, r["at_home"]])
        own[2] += r["size"]
        if r["at_home"] > own[3]:
            own[1], own[3] = r["home"], r["at_home"]
    where = plan([(k, at, size) for k, at, size, _ in units.values()], room)
    ahead, places = [0] * len(room), []
    for r in cells:
        to = where[units[tuple(r[:3])][0]]
        places.append((*r[:4], to, ahead[to]))
        ahead[to] += r["n"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "text_crc32", "row_id"))
    known = F.broadcast(spark.createDataFrame(places, "block int, sub long, part int, piece int, shard int, ahead long"))  # bounded as above
    slotted = rows.withColumn("nth", nth).join(known, keys)
    return slotted.select(*([ROW] if carry else []), "doc_id", "size", "text_crc32", "old_shard", "shard", (F.col("ahead") + F.col("nth") - 1).alias("slot"))


def reshard(
    docs: DataFrame, shards: int = 8, capacity: list[int] | None = None, old_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS,
    old_col: str | None = None, together: bool = True,
) -> DataFrame:
    """``doc_id, size, text_crc32, old_shard, shard, slot`` for each row.

    ``capacity`` holds the new shards' bytes; without it they are to be equal. ``old_col`` names the column with the shard in
    which a row lies now; without it, that is the shard of ``first_layout`` among ``old_shards``. Unless equal texts are to
    come ``together``, a block's rows in different old shards are blocks of their own, and none moves for another one's sake.
    """
    return _placed(docs, len(capacity) if capacity else shards, capacity, old_shards, id_col, text_col, blocks, old_col, together, False)


def rewrite(
    docs: DataFrame, path: str, shards: int = 8, capacity: list[int] | None = None, id_col: str = "doc_id", text_col: str = "text", blocks: int = BLOCKS, together: bool = True,
) -> DataFrame:
    """Reshards ``docs`` into the folders ``__shard=`` of ``path``, and returns ``shard, n_rows`` of the shards whose files were affected.

    If ``docs`` has a column ``__shard``, as when it was read from ``path``, it says where its rows lie there; only shards
    that gain or lose rows are then written, and those left empty are deleted. Otherwise all are written, and whatever other
    shards lay at ``path`` are deleted.
    """
    spark = docs.sparkSession
    known = "__shard" in docs.columns
    placed = _placed(docs, len(capacity) if capacity else shards, capacity, None, id_col, text_col, blocks, "__shard" if known else None, together, True)
    ways = placed.groupBy("old_shard", "shard").agg(F.count("*").alias("n")).collect()  # at most old times new shards
    affected = {k for r in ways if not known or r["old_shard"] != r["shard"] for k in ((r["old_shard"], r["shard"]) if known else (r["shard"],))}
    counts = {k: sum(r["n"] for r in ways if r["shard"] == k) for k in sorted(affected)}
    columns = [c for c in docs.columns if c not in ("__shard", "__slot")]
    out = placed.where(F.col("shard").isin(list(affected))).select(*(F.col(ROW)[c].alias(c) for c in columns), F.col("slot").alias("__slot"), F.col("shard").alias("__shard"))
    dealt = out.repartition("__shard", F.pmod("__slot", F.lit(PARTS))).sortWithinPartitions("__shard", "__slot")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__shard").parquet(path)
    empty = [k for k, n in counts.items() if not n] if known else [k for k in _shards_at(spark, path) if not counts.get(k)]
    for k in empty:
        remove(spark, f"{path}/__shard={k}")
    return spark.createDataFrame(list(counts.items()), "shard int, n_rows long")


def _shards_at(spark: SparkSession, path: str) -> list[int]:
    """The shards that have a folder at ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []
    return [int(n.removeprefix("__shard=")) for n in names if n.startswith("__shard=") and n.removeprefix("__shard=").isdecimal()]
