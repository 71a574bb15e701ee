"""Line dedup by winnowing over line hashes, in DataFrame functions only.

A run of consecutive lines (blank ones don't count) that holds ``min_words``
words or more and occurs earlier goes, as a whole: a line is deleted if any such
run contains it. Repeats are judged on the input, not on what is left, and may
overlap themselves in one text.

1. A window starts at each line and goes on until it holds ``min_words`` words.
   Its smallest line hash (the first of equal ones) is its fingerprint, so equal
   windows choose equal fingerprints, and every repeated run has one in common
   with its other occurrences. Neighbouring windows mostly choose the same line.
2. Positions are joined on the fingerprint; those that occur once are dropped.
3. Matches are extended both ways from there. To the left and over the
   fingerprint reach the windows that start before it. To the right, a window's
   run goes on, line after line, for as long as what follows its first line
   holds fewer than ``min_words`` words; beyond, the next line's window takes
   over. So a run of ``min_words`` words or more is, line for line, covered by
   such stretches inside it, its end included, whatever the lines' lengths.
4. Each stretch is compared with the first of its kind by a grouped minimum,
   never pairwise, so a passage that very many documents share costs a row for
   each. All lines of a stretch that occurred before are deleted.

Frequent fingerprints and frequent stretches are dealt to ``SPREAD`` tasks, by
the window's hash and by the document.

Order is that of ``doc_id`` (nulls first), then of a hash of the text, then of
the lines.

Edge cases: null texts stay null and have no lines; a text with fewer than
``min_words`` words is never changed; rows that repeat both id and text get the
same result each (they aren't copies of one another); an empty table gives an
empty result; further columns are carried along whatever their names (but for
the two that ``line_dedup`` adds, which replace columns of the same names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import packed, unpacked
from ..scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Tasks to which the rows of one fingerprint, or of one stretch of lines, are dealt.
SPREAD = 8


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.split(text, "\n").alias("lines"))


def _filled(lines: str) -> Column:
    """The lines with a word: position, hash, number of words."""
    every = F.transform(
        F.col(lines), lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))
    )
    return F.filter(every, lambda x: x["w"] > 0)


def windows(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """``doc_id, text_hash, i, n, at, mark, body, more``: windows of ``n`` lines from line ``i``, their fingerprint and its line, and their hash.

    ``more`` holds the hashes of the runs from ``i`` with one line more, two lines more and so on, as far as a window is extended.
    """
    own = _keyed(docs, id_col, text_col).select("doc_id", "text_hash", _filled("lines").alias("own"))

    def window(i: Column) -> Column:
        ahead = F.slice(F.col("own"), i + 1, F.lit(min_words))  # a line has a word at least
        start = F.struct(
            F.lit(0).alias("w"), F.lit(0).alias("rest"), F.lit(0).alias("n"), F.lit(0).alias("at"), F.lit(2**63 - 1).alias("mark"),
            F.lit(0).cast("long").alias("body"), F.lit(0).cast("long").alias("run"), F.array().cast("array<bigint>").alias("more"),
        )

        def step(a: Column, x: Column) -> Column:
            grows = a["w"] < min_words
            run = F.xxhash64(a["run"], x["h"])
            rest = F.when(a["n"] == 0, F.lit(0)).otherwise(a["rest"] + x["w"])  # words after the first line
            low = grows & (x["h"] < a["mark"])
            return F.struct(
                F.when(grows, a["w"] + x["w"]).otherwise(a["w"]).alias("w"), rest.alias("rest"), (a["n"] + grows.cast("int")).alias("n"),
                F.when(low, i + a["n"]).otherwise(a["at"]).alias("at"), F.when(low, x["h"]).otherwise(a["mark"]).alias("mark"),
                F.when(grows, run).otherwise(a["body"]).alias("body"), run.alias("run"),
                F.when(~grows & (rest < min_words), F.array_append(a["more"], run)).otherwise(a["more"]).alias("more"),
            )

        last = lambda a: F.struct(i.alias("i"), a["w"].alias("w"), a["n"].alias("n"), a["at"].alias("at"), a["mark"].alias("mark"), a["body"].alias("body"), a["more"].alias("more"))
        return F.aggregate(ahead, start, step, last)

    starts = F.when(F.size("own") > 0, F.transform(F.sequence(F.lit(0), F.size("own") - 1), window))
    # outer: of a plain explode a filter on the whole expression is inferred, and pushed into the lambdas
    at = own.select("doc_id", "text_hash", F.explode_outer(starts).alias("x")).where(F.col("x.w") >= min_words)
    return at.select("doc_id", "text_hash", "x.i", "x.n", "x.at", "x.mark", "x.body", "x.more")


def _spread(df: DataFrame) -> DataFrame:
    """Each row once for every part."""
    return df.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``doc_id, text_hash, gone``: for each text with repeated runs, the positions among its lines with a word that are to go."""
    scratch = Scratch(docs.sparkSession, "lines")
    every = scratch.cut(windows(docs, id_col, text_col, min_words), "windows")
    prints = every.select("doc_id", "text_hash", "at", "mark").distinct()
    shared = _spread(prints.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    met = every.withColumn("part", F.pmod("body", F.lit(SPREAD)).cast("int")).join(shared, ["mark", "part"])
    runs = F.concat(F.array(F.struct("n", F.col("body").alias("h"))), F.transform("more", lambda h, k: F.struct((F.col("n") + k + 1).alias("n"), h.alias("h"))))
    near = scratch.cut(met.select("doc_id", "text_hash", "i", "mark", F.explode(runs).alias("run")).select("doc_id", "text_hash", "i", "mark", "run.n", "run.h"), "near")
    place = F.struct("doc_id", "text_hash", "i")
    kinds = near.groupBy("mark", "h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last")
    later = near.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_hash", "i"), F.lit(SPREAD)).cast("int")).join(_spread(kinds.select("mark", "h", "first")), ["mark", "h", "part"])
    lines = later.where(place > F.col("first")).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("i", "n")).alias("runs"))
    gone = F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1)))
    out = scratch.cut(lines.select("doc_id", "text_hash", F.array_distinct(gone).alias("gone")), "gone")
    scratch.drop(every, near)
    return out


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Packed rows with ``new`` (the text without repeats), ``n_lines`` and ``n_removed``."""
    gone = repeated(docs, id_col, text_col, min_words).select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "gone")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = packed(docs, doc_id=F.col(f"`{id_col}`"), text_hash=F.xxhash64(text), text=F.col(f"`{text_col}`"))
    # merged at every size: for a broadcast the list would have to stay small while the corpus grows
    met = own.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash")), "left")
    split = met.withColumn("lines", F.split("text", "\n"))
    word = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), F.regexp_like(x, F.lit(WORD)).alias("w"))), lambda x: x["w"])
    split = split.withColumn("word", F.when(F.col("gone").isNotNull(), word))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.transform("gone", lambda k: F.get(F.col("word"), k)["i"]))
    split = split.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    new = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform("kept", lambda k: F.get(F.col("lines"), k)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long")
    return split.withColumn("new", new).withColumn("n_lines", n_lines).withColumn("n_removed", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with later repeated runs of lines deleted from the text, and ``__n_lines`` and ``__n_removed``."""
    out = _deduplicated(docs, id_col, text_col, min_words)
    return unpacked(out, docs.columns, **{text_col: F.col("new"), "__n_lines": F.col("n_lines"), "__n_removed": F.col("n_removed")})


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", min_words: int = 50) -> DataFrame:
    """``docs`` with its own columns, texts deduplicated by ``line_dedup``; the column of text lengths, if there, follows the text."""
    new = {text_col: F.col("new")}
    if length_col in docs.columns:
        new[length_col] = F.length("new").cast(docs.schema[length_col].dataType)
    return unpacked(_deduplicated(docs, id_col, text_col, min_words), docs.columns, **new)


def oracle_sql(min_words: int = 50) -> str:
    """The same in DuckDB's SQL, without windows or hashes: maximal runs on the diagonals of all pairs of equal lines."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), w AS (
  SELECT *, len(regexp_extract_all(line, '{WORD}')) AS n FROM l
), f AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM w WHERE n > 0
), p AS (
  SELECT a.doc_id AS first_doc, b.doc_id, b.pos, b.k, b.n, b.k - a.k AS shift FROM f a JOIN f b ON a.line = b.line AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))
), i AS (
  SELECT *, k - row_number() OVER (PARTITION BY first_doc, doc_id, shift ORDER BY k) AS island FROM p
), r AS (
  SELECT *, sum(n) OVER (PARTITION BY first_doc, doc_id, shift, island) AS words FROM i
), g AS (
  SELECT DISTINCT doc_id, pos FROM r WHERE words >= {min_words}
)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.pos) AS BIGINT) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS text
FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id"""
