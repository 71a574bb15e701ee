"""Exact nearest vectors of a stated query set, by blocks of matrix products.

The corpus is dealt to parts, and every block of queries is sent to each part.
A task holds its part's vectors, meets one block of queries after the other, and
keeps of each product the ``k`` best of a query, so that ``k`` rows a query and
part are shuffled and never a row for every pair. No side is broadcast or
collected; a part holds the corpus's rows over the number of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a block, and vectors of a part that one product takes.
BLOCK_ROWS, SLICE = 512, 4096


def _vectors(col: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix; all lists are of one length."""
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def _scores(q: np.ndarray, c: np.ndarray, how: str) -> np.ndarray:
    if how == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return (q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None])
    return np.stack([-((c - x) ** 2).sum(axis=1) for x in q])


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest numbers; of equal ones the first columns count, and NaN never does."""
    scores = np.where(np.isnan(scores), -np.inf, scores)
    if scores.shape[1] > k:
        least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
        above = scores > least
        tied = scores == least
        keep = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep & (scores > -np.inf))


class _Part:
    """A part's vectors in order of their ids, and groups of them of which each has its own best."""

    def __init__(self, ids: pa.Array, groups: pa.Array, vectors: np.ndarray):
        self.ids, self.groups, self.vectors = ids, groups, vectors
        self.codes = np.asarray(groups.dictionary_encode().indices.fill_null(-1)) if len(ids) else np.zeros(0, int)

    def nearest(self, q: np.ndarray, how: str, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the block, rows of the part and scores; each slice's best meet the best of those before."""
        found: list[tuple] = []
        for code in np.unique(self.codes):
            own = np.flatnonzero(self.codes == code)
            rows, cols, vals = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            for a in range(0, len(own), SLICE):
                some = own[a : a + SLICE]
                s = _scores(q, self.vectors[some], how)
                r, c = best(np.round(s, digits), k)
                rows, cols, vals = np.append(rows, r), np.append(cols, some[c]), np.append(vals, s[r, c])
                if a:  # the k best of those found so far
                    order = np.lexsort((cols, -np.round(vals, digits), rows))
                    nth = np.arange(len(order)) - np.searchsorted(rows[order], rows[order])
                    order = order[nth < k]
                    rows, cols, vals = rows[order], cols[order], vals[order]
            found.append((rows, cols, vals))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _products(how: str, k: int, digits: int):
    """Of rows ``part, kind, id, vector, query ids, group`` in order: the vectors of a part (kind 0) before the blocks of queries (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            parts, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0) | (kinds[1:] == 1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if parts[a] != now:
                    now, held, part = parts[a], [], None
                piece = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append((piece.column(2), piece.column(5), _vectors(piece.column(3))))
                    continue
                if part is None and held:
                    ids, groups, vectors = zip(*held, strict=True)
                    part, held = _Part(pa.concat_arrays(ids), pa.concat_arrays(groups), np.concatenate(vectors)), []
                if part is None:
                    continue
                asked = piece.column(4).flatten()
                q = piece.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asked), -1)
                rows, cols, vals = part.nearest(q, how, k, digits)
                if len(rows):
                    at = pa.array(cols)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(rows)), part.ids.take(at), part.groups.take(at), pa.array(vals)], ["query_id", "chunk_id", "grp", "score"])

    return run


def nearest(queries: DataFrame, corpus: DataFrame, how: str, k: int, group: str | None = None, digits: int = 6, parts: int | None = None) -> DataFrame:
    """``query_id, chunk_id, [group,] score, rank``: the ``k`` best of all of the corpus for each query, or of each group of it.

    ``queries(query_id, qvec)``, ``corpus(chunk_id, vec)``; ``how`` is ``cosine`` or ``euclidean`` (negative squared distance).
    Scores are rounded, ties broken by ``chunk_id``. Rows with a null vector, and for ``cosine`` with one without length, are
    nobody's neighbours and have none. ``parts`` is the number of parts, by default that of shuffle partitions.
    """
    spark = queries.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids, asked = dict(corpus.dtypes)["chunk_id"], dict(queries.dtypes)["query_id"]
    grp = F.col(group) if group else F.lit(0)
    own = corpus.where("vec is not null").select(
        F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"), F.lit(0).alias("kind"), F.col("chunk_id").alias("id"),
        F.col("vec").cast("array<double>").alias("v"), F.lit(None).cast(f"array<{asked}>").alias("qs"), grp.alias("grp"),
    )
    numbered = queries.where("qvec is not null").select("query_id", "qvec", F.floor(F.monotonically_increasing_id() / BLOCK_ROWS).alias("block"))
    blocks = numbered.groupBy("block").agg(F.collect_list(F.struct("query_id", F.col("qvec").cast("array<double>").alias("qvec"))).alias("rows"))
    sent = blocks.select(
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast(ids).alias("id"),
        F.flatten("rows.qvec").alias("v"), F.col("rows.query_id").alias("qs"), F.lit(None).cast(own.schema["grp"].dataType).alias("grp"),
    )
    dealt = own.unionByName(sent).repartition(parts, "part").sortWithinPartitions("part", "kind", "id")
    kind = own.schema["grp"].dataType.simpleString()
    found = dealt.mapInArrow(_products(how, k, digits), f"query_id {asked}, chunk_id {ids}, grp {kind}, score double")
    found = found.withColumn("score", F.round("score", digits))
    keys = ["query_id", "grp"] if group else ["query_id"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "chunk_id", *([F.col("grp").alias(group)] if group else []), "score", "rank")
