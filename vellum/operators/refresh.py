"""A statute base kept up to date: what hasn't changed is neither cut nor resolved again.

A file is told by a hash of its lines. Of changed and new files the chunks are
cut and read anew, those of files that are gone are dropped. A chunk's
references are resolved again if it is new, or if it refers to a law whose file
has changed, appeared or gone; all others are taken over. To resolve them, only
the chunks of laws that they refer to are looked through.

Chunks and places of a refreshed base are the old ones without some, and the new
ones, put together where they are read; ``settled`` writes them, after many rounds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from . import provisions as P
from . import statutes as L


@dataclass
class Base:
    """``files(file, prefix, digest)``, ``chunks``, ``places`` (of ``own``, the chunk's law) and ``references`` of a state; a law has one file."""

    files: DataFrame
    chunks: DataFrame
    places: DataFrame
    references: DataFrame


def digests(lines: DataFrame) -> DataFrame:
    """``file, prefix, digest`` of ``lines(file, ord, prefix, line)``, whatever the order of the rows."""
    h = F.xxhash64("ord", "line")
    low = h.bitwiseAND(F.lit((1 << 31) - 1))
    digest = F.md5(F.concat_ws(":", F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(low).cast("string")))
    return lines.groupBy("file", "prefix").agg(digest.alias("digest"))


def built(lines: DataFrame, names: DataFrame, relatives: DataFrame) -> Base:
    """A base from all files; ``names`` and ``relatives`` as in ``provisions.found_places``."""
    scratch = Scratch(lines.sparkSession, "base")
    lines = scratch.cut(lines.select("file", "ord", "prefix", "line"), "lines")
    files = scratch.cut(digests(lines), "files")
    chunks = P.cut_chunks(scratch, P.provisions(L.articles(lines)))
    scratch.drop(lines)
    places = scratch.cut(P.found_places(chunks, names, relatives, scratch), "places")
    refs = scratch.cut(P.resolved(chunks, P.registry(chunks), places), "references")
    return Base(files, chunks, places, refs)


def settled(base: Base) -> Base:
    """The same base with its chunks and places written."""
    scratch = Scratch(base.files.sparkSession, "settled")
    return Base(base.files, P.cut_chunks(scratch, base.chunks), scratch.cut(base.places, "places"), base.references)


def law_of(chunk_id: Column) -> Column:
    """The law of a chunk by its id: what stands before the seven levels."""
    return F.left(chunk_id, F.length(chunk_id) - F.length(F.substring_index(chunk_id, "_", -7)) - 1)


def changes(base: Base, lines: DataFrame, now: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The files that are new or changed ``(file, prefix)``, and the laws ``(prefix)`` that are new, changed or gone; ``now`` are the lines' digests, if there are any yet."""
    now = digests(lines) if now is None else now
    old = base.files.select(F.col("file").alias("f"), F.col("prefix").alias("old_prefix"), F.col("digest").alias("d"))
    both = now.join(old, F.col("file") == F.col("f"), "full").where(~F.col("digest").eqNullSafe(F.col("d")) | ~F.col("prefix").eqNullSafe(F.col("old_prefix")))
    laws = both.select(F.explode(F.array_compact(F.array("prefix", "old_prefix"))).alias("prefix")).distinct()
    return both.where("file is not null").select("file", "prefix"), laws


def refreshed(base: Base, lines: DataFrame, names: DataFrame, relatives: DataFrame) -> Base:
    """The base of the present files. The names and relatives must be those that it was built with."""
    scratch = Scratch(lines.sparkSession, "refresh")
    lines = scratch.cut(lines.select("file", "ord", "prefix", "line"), "lines")
    files = scratch.cut(digests(lines), "files")
    changed, laws = changes(base, lines, files)
    changed, laws = scratch.cut(changed, "changed"), scratch.cut(laws, "laws")
    anew = P.cut_chunks(scratch, P.provisions(L.articles(lines.join(changed.select("file"), "file", "left_semi"))), "anew")
    scratch.drop(lines)
    old_chunks = base.chunks.join(laws, "prefix", "left_anti").select(*anew.columns)
    old_places = base.places.join(laws.select(F.col("prefix").alias("own")), "own", "left_anti")
    found = scratch.cut(P.found_places(anew, names, relatives, scratch), "places")
    # chunks of other laws that refer to one of these, and other laws that are referred to
    near = scratch.cut(old_places.join(laws, "prefix", "left_semi").select("chunk_id").distinct(), "near")
    again, asked, among = anew, found, anew
    if not near.isEmpty():
        again = anew.unionByName(old_chunks.join(near, "chunk_id", "left_semi"))
        asked = found.unionByName(old_places.join(near, "chunk_id", "left_semi").select(*found.columns))
        among = anew.unionByName(old_chunks.join(near.withColumnRenamed("chunk_id", "parent_id"), "parent_id", "left_semi").select(*anew.columns))
    others = scratch.cut(asked.select("prefix").distinct().join(laws, "prefix", "left_anti"), "others")
    targets = anew if others.isEmpty() else anew.unionByName(base.chunks.join(others, "prefix", "left_semi").select(*anew.columns))
    refs = P.resolved(again.select("chunk_id", "text"), P.registry(targets), asked, among)
    taken_over = base.references.withColumn("law", law_of(F.col("chunk_id"))).join(laws.withColumnRenamed("prefix", "law"), "law", "left_anti").join(near, "chunk_id", "left_anti")
    refs = scratch.cut(taken_over.select(*base.references.columns).unionByName(refs), "references")
    return Base(files, old_chunks.unionByName(anew), old_places.select(*found.columns).unionByName(found), refs)
