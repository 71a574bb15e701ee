"""Best matches by sequence similarity, of which only the pairs that can still win reach the matcher.

A matcher's ratio counts characters in matching blocks, so it can't exceed what
two texts share as multisets of characters. That is bounded from counts of
character classes (a text's ``histogram``, made once, natively), exactly as the
ratio is computed, so a pair whose bound doesn't exceed what it must beat is
left out without another result. The pair with the highest bound of each key
is scored first; of the others only those whose bound reaches that score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..scratch import Scratch
from .ordered import latest

#: Classes of characters: Hangul syllables in equal parts, letters, digits and white space; the rest is one more.
_HANGUL, _PARTS = (0xAC00, 0xD7A3), 12
_STEP = (_HANGUL[1] - _HANGUL[0] + _PARTS) // _PARTS
CLASSES = [rf"[\x{{{a:x}}}-\x{{{min(a + _STEP - 1, _HANGUL[1]):x}}}]" for a in range(_HANGUL[0], _HANGUL[1] + 1, _STEP)] + ["[a-e]", "[f-l]", "[m-r]", "[s-z]", "[A-Z]", "[0-4]", "[5-9]", r"\s"]


def histogram(text: Column) -> Column:
    """How many characters of each class a text has; null counts as empty."""
    own = F.coalesce(text, F.lit(""))
    counts = F.array(*(F.regexp_count(own, F.lit(c)) for c in CLASSES))
    return F.array_append(counts, F.length(own) - F.aggregate(counts, F.lit(0), lambda n, x: n + x))


def shared_bound(a: Column, b: Column) -> Column:
    """At most so many characters can match, from two histograms."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)


def _size(h: Column) -> Column:
    return F.aggregate(h, F.lit(0), lambda n, x: n + x)


#: How a pair is scored: the matcher, and the bound from histograms.
HOW = {
    "ratio": (S.ratio, lambda a, b: F.when(_size(a) + _size(b) == 0, 1.0).otherwise(2.0 * shared_bound(a, b) / (_size(a) + _size(b)))),
    "containment": (S.containment, lambda a, b: F.when(_size(a) == 0, 1.0).otherwise(shared_bound(a, b) / _size(a))),
}


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """The rows in some parts for each core, however few bytes they have."""
    spark = df.sparkSession
    return df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(64, 4 * spark.sparkContext.defaultParallelism)), *by)


def could_win(pairs: DataFrame, how: str) -> DataFrame:
    """``pairs`` with ``bound``, those left out whose bound isn't above ``floor`` and at least ``least`` (null: no such limit)."""
    bound = HOW[how][1](F.col("ha"), F.col("hb"))
    return pairs.withColumn("bound", bound).where((F.col("floor").isNull() | (F.col("bound") > F.col("floor"))) & (F.col("least").isNull() | (F.col("bound") >= F.col("least"))))


def best_matches(pairs: DataFrame, key: list[str], tie: str, how: str, digits: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``key ..., tie, score``: for each key the pair with the best score above ``floor`` and of at least ``least``, the smallest ``tie`` of equal ones.

    ``pairs`` has the texts ``a`` and ``b``, their histograms ``ha`` and ``hb``, ``floor`` and ``least`` (doubles, may be null,
    the same for all pairs of a key).
    Scores are compared after rounding to ``digits``. Given ``scratch``, pairs are written once. Pairs are dealt to all tasks
    before they are scored: they are few bytes and much work, so parts by size would be one or two.
    """
    deal = lambda df: dealt(df, *key, tie)
    score = HOW[how][0]("a", "b") if digits is None else F.round(HOW[how][0]("a", "b"), digits)
    slack = 0.0 if digits is None else 0.5 * 10.0**-digits
    open_ = could_win(pairs, how).select(*key, tie, "a", "b", "floor", "least", "bound")
    open_ = scratch.cut(open_, "pairs") if scratch else open_
    first = deal(latest(open_, key, [F.desc("bound"), F.asc(tie)]).select(*open_.columns)).withColumn("score", score)
    first = scratch.cut(first, "first") if scratch else first
    beaten = first.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(tie).alias("_tie"), F.col("score").alias("_score"))
    met = open_.join(beaten, _same(key)).where((F.col(tie) != F.col("_tie")) & (F.col("bound") + slack >= F.col("_score")))
    rest = deal(met.select(*open_.columns)).withColumn("score", score).drop("a", "b", "bound")
    rest = scratch.cut(rest, "rest") if scratch else rest  # else filters on the score pass the dealing, and it is computed on both sides
    every = first.drop("a", "b", "bound").unionByName(rest)
    every = every.where((F.col("floor").isNull() | (F.col("score") > F.col("floor"))) & (F.col("least").isNull() | (F.col("score") >= F.col("least"))))
    return latest(every, key, [F.desc("score"), F.asc(tie)]).select(*key, tie, "score")


def reached(pairs: DataFrame, key: list[str], tie: str, how: str) -> DataFrame:
    """``n_pairs, n_scored``: all pairs, and those that reach the matcher in ``best_matches``."""
    open_ = could_win(pairs, how)
    first = latest(open_, key, [F.desc("bound"), F.asc(tie)]).withColumn("_score", HOW[how][0]("a", "b"))
    beaten = first.select(*(F.col(k).alias(f"_{k}") for k in key), F.col(tie).alias("_tie"), "_score")
    more = open_.join(beaten, _same(key)).where((F.col(tie) != F.col("_tie")) & (F.col("bound") >= F.col("_score")))
    one = lambda df, p, q: df.select(F.lit(p).alias("p"), F.lit(q).alias("q"))
    every = one(pairs, 1, 0).unionAll(one(first, 0, 1)).unionAll(one(more, 0, 1))
    return every.agg(F.coalesce(F.sum("p"), F.lit(0)).alias("n_pairs"), F.coalesce(F.sum("q"), F.lit(0)).alias("n_scored"))


def _same(key: list[str]) -> Column:
    out = F.lit(True)
    for k in key:
        out = out & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out
