"""Staged search for the settings of a hybrid search.

A full grid multiplies its dimensions. A staged search takes a few of them at a
time, the others at the best values so far, and so tries a sum of small grids.
The arms' ranks and the reranking scores are written once; a stage is one job
over them, with its settings as rows, and gives one row for each setting.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch

#: The dimensions, with their values before a stage has chosen others. ``rerank_k`` 0: no reranking; ``least`` None: no least score.
DEFAULTS = {"alpha": 0.7, "rrf_k": 20, "fetch_k": 50, "rerank_k": 0, "least": None}
_TYPES = {"alpha": "double", "rrf_k": "int", "fetch_k": "int", "rerank_k": "int", "least": "double"}


def raw_ranks(dense: DataFrame, sparse: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """``query_id, chunk_id, rd, rs, rescored``: both arms' ranks (one that is missing follows the other arm's last) and the reranking score.

    ``scores(query_id, chunk_id, score)`` need cover the arms' rows only.
    """
    n = F.count("*").over(Window.partitionBy("query_id"))
    both = dense.select("query_id", "chunk_id", F.col("rank").alias("rd"), n.alias("nd")).join(
        sparse.select("query_id", "chunk_id", F.col("rank").alias("rs"), n.alias("ns")), ["query_id", "chunk_id"], "full_outer"
    )
    both = both.select("query_id", "chunk_id", F.coalesce("rd", F.col("ns") + 1).alias("rd"), F.coalesce("rs", F.col("nd") + 1).alias("rs"))
    if scores is None:
        return both.withColumn("rescored", F.lit(None).cast("double"))
    return both.join(scores.select("query_id", "chunk_id", F.col("score").alias("rescored")), ["query_id", "chunk_id"], "left")


def rankings(raw: DataFrame, settings: list[dict], top: int = 10) -> DataFrame:
    """``setting, query_id, chunk_id, rank``: the ``top`` results of each query under each setting, numbered in their order."""
    rows = F.array(*(F.struct(F.lit(k).alias("setting"), *(F.lit(s[c]).cast(t).alias(c) for c, t in _TYPES.items())) for k, s in enumerate(settings)))
    each = raw.withColumn("s", F.explode(rows)).select("query_id", "chunk_id", "rd", "rs", "rescored", "s.*")
    fused = F.round(F.col("alpha") / (F.col("rrf_k") + F.col("rd")) + (1 - F.col("alpha")) / (F.col("rrf_k") + F.col("rs")), 9)
    per = Window.partitionBy("setting", "query_id")
    nth = lambda *by: F.row_number().over(per.orderBy(*by, "chunk_id"))
    found = each.withColumn("score", fused).withColumn("nth", nth(F.desc("score"))).where(F.col("nth") <= F.col("fetch_k"))
    found = found.where((F.col("rerank_k") == 0) | (F.col("nth") <= F.col("rerank_k")))
    found = found.withColumn("score", F.when(F.col("rerank_k") > 0, F.col("rescored")).otherwise(F.col("score")))
    passing = F.coalesce(F.col("least").isNull() | (F.col("score") >= F.col("least")), F.lit(False))
    found = found.withColumn("passing", passing).withColumn("any_pass", F.max("passing").over(per)).where("passing or not any_pass")
    return found.withColumn("rank", nth(F.desc_nulls_last("score"))).where(F.col("rank") <= top).select("setting", "query_id", "chunk_id", "rank")


def evaluated(raw: DataFrame, relevant: DataFrame, settings: list[dict], at: tuple[int, ...] = (1, 3, 10), asked: DataFrame | None = None) -> DataFrame:
    """``setting, mrr, recall_k ...``: means over the queries that have a relevant chunk, those without any result included.

    ``relevant(query_id, chunk_id)``; ``recall_k`` is the share of queries with a relevant chunk among the first ``k``. Where
    ``asked(query_id)`` names the queries with a relevant chunk, ``relevant`` need hold those of the pairs in ``raw`` only.
    """
    hits = rankings(raw, settings, max(at)).join(relevant.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_semi")
    first = hits.groupBy("setting", "query_id").agg(F.min("rank").alias("first"))
    sums = first.groupBy("setting").agg(F.sum(1 / F.col("first")).alias("rr"), *(F.count_if(F.col("first") <= k).alias(f"n{k}") for k in at))
    n = (relevant if asked is None else asked).agg(F.count_distinct("query_id").alias("n"))
    every = n.select("n", F.explode(F.sequence(F.lit(0), F.lit(len(settings) - 1))).alias("setting"))
    share = lambda c: F.round(F.coalesce(F.try_divide(F.coalesce(c, F.lit(0.0)), "n"), F.lit(0.0)), 6)
    return every.join(sums, "setting", "left").select("setting", share(F.col("rr")).alias("mrr"), *(share(F.col(f"n{k}").cast("double")).alias(f"recall_{k}") for k in at))


def grid(chosen: dict, stage: dict[str, list]) -> list[dict]:
    """The settings of a stage, in the order of its values; more can't be reranked than are fetched."""
    every = [{**chosen, **dict(zip(stage, values, strict=True))} for values in product(*stage.values())]
    return [s for s in every if s["rerank_k"] <= s["fetch_k"]]


def staged_search(raw: DataFrame, relevant: DataFrame, stages: list[dict[str, list]], by: tuple[str, ...] = ("mrr",), start: dict | None = None, at: tuple[int, ...] = (1, 3, 10), asked: DataFrame | None = None) -> DataFrame:
    """All settings tried: ``stage``, the setting's values, ``mrr, recall_k ...``, and ``chosen``.

    Each stage takes the best setting by ``by`` (the first of equal ones) into the next. One job for each stage, of which
    one row a setting reaches the driver. ``asked`` as in ``evaluated``.
    """
    spark = raw.sparkSession
    scratch = Scratch(spark, "tuning")
    raw = scratch.cut(raw, "ranks")
    relevant = scratch.cut(relevant.select("query_id", "chunk_id"), "relevant")
    asked = None if asked is None else scratch.cut(asked.select("query_id"), "asked")
    chosen, rows = {**DEFAULTS, **(start or {})}, []
    for number, stage in enumerate(stages, 1):
        settings = grid(chosen, stage)
        met = {r.setting: r for r in evaluated(raw, relevant, settings, at, asked).collect()}
        place = min(range(len(settings)), key=lambda k: ([-met[k][c] for c in by], k))
        chosen = settings[place]
        rows += [(number, *s.values(), met[k].mrr, *(met[k][f"recall_{n}"] for n in at), k == place) for k, s in enumerate(settings)]
    scratch.drop(raw, relevant, asked)
    kinds = [f"{c} {t}" for c, t in _TYPES.items()] + ["mrr double"] + [f"recall_{n} double" for n in at]
    return spark.createDataFrame(rows, f"stage int, {', '.join(kinds)}, chosen boolean")
