"""Many names at once: an automaton that finds all of them in one pass over a text.

A text is read once however many names there are. The automaton is built once a
worker from the names, which are sent to the tasks only up to ``SENT_BYTES``.
More names stay where they are: a text's substrings, of the lengths that names
with the same first character have, are joined with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names are sent to every task up to so many bytes together.
SENT_BYTES = 4 << 20
#: Rows of substrings in a batch, and characters up to which a text is its own key in the join.
BATCH, SHORT = 20_000, 64


class Names:
    """The automaton of a set of names."""

    def __init__(self, names: Iterable[str]):
        self.automaton = ahocorasick.Automaton()
        for n in names:
            if n:
                self.automaton.add_word(n, n)
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def found(self, text: str) -> dict[int, str]:
        """By place, the longest name that begins there."""
        out: dict[int, str] = {}
        if self.any and text:
            for end, name in self.automaton.iter(text):
                start = end - len(name) + 1
                if len(out.get(start, "")) < len(name):
                    out[start] = name
        return out

    def longest(self, text: str) -> str | None:
        """The longest name in a text, of equally long ones the first by name."""
        return min(self.found(text).values(), key=lambda n: (-len(n), n), default=None)


def leftmost(found: Iterable[tuple[int, str]]) -> list[tuple[int, str]]:
    """Names that don't overlap: the first one, the longest where it begins, then on from its end."""
    out, end = [], 0
    for start, name in sorted(found, key=lambda x: (x[0], -len(x[1]))):
        if start >= end:
            out.append((start, name))
            end = start + len(name)
    return out


def _substrings(lengths: dict[str, list[int]]):
    """Of rows ``key, text``: a row for each substring that may be a name, by its first character and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[str, int, str]]) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "start", "part"])

        rows = []
        for b in batches:
            for key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for start, first in enumerate(text):
                    rows.extend((key, start, text[start : start + n]) for n in lengths.get(first, ()) if start + n <= len(text))
                    if len(rows) >= BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return run


def _joined(texts: DataFrame, names: DataFrame, longest: bool) -> DataFrame:
    """``_candidates`` by a join of the substrings of ``texts(text)`` with ``names(name)``; a long text goes by its digest."""
    heads = names.select(F.substring("name", 1, 1).alias("first"), F.length("name").alias("n")).distinct().groupBy("first").agg(F.collect_list("n").alias("n"))
    lengths = {r["first"]: sorted(r["n"]) for r in heads.collect()}  # as many numbers as first characters have lengths
    keyed = texts.where("text <> ''").select(F.when(F.length("text") < SHORT, F.col("text")).otherwise(F.sha2("text", 256)).alias("key"), "text")
    whole = None
    if longest:  # nothing in a text is longer than itself
        whole = texts.join(names, F.col("text") == F.col("name"), "left_semi").select("text", F.array(F.lit(0)).alias("starts"), F.array("text").alias("found"))
        keyed = keyed.join(names, F.col("text") == F.col("name"), "left_anti")
    parts = keyed.mapInArrow(_substrings(lengths), "key string, start int, part string")
    met = parts.join(names, F.col("part") == F.col("name"), "left_semi")
    place = F.struct((-F.length("part")).alias("l"), "part", "start") if longest else F.struct((-F.length("part")).alias("l"), "part")
    best = met.groupBy("key", *([] if longest else ["start"])).agg(F.min(place).alias("x"))
    best = best.select("key", (F.col("x.start") if longest else F.col("start")).alias("start"), F.col("x.part").alias("part"))
    each = best.groupBy("key").agg(F.collect_list(F.struct("start", "part")).alias("x"))
    out = each.join(keyed, "key").select("text", F.transform("x", lambda x: x["start"]).alias("starts"), F.transform("x", lambda x: x["part"]).alias("found"))
    return out if whole is None else whole.unionByName(out)


def _candidates(texts: DataFrame, text: str, names: DataFrame, name: str, longest: bool) -> DataFrame:
    """``text, starts, found``: for each text with a name, the longest at each place (or the longest of all, at one place at least)."""
    texts, names = texts.select(F.col(text).alias("text")), names.select(F.col(name).alias("name")).where("name <> ''")
    size = names.agg(F.sum(F.octet_length("name") + 8)).first()[0] or 0
    if size > SENT_BYTES:
        return _joined(texts, names.distinct(), longest)
    sent = [r[0] for r in names.distinct().collect()]  # at most SENT_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Names(sent)
        for b in batches:
            rows = []
            for t in b.column(0).to_pylist():
                met = own.found(t or "")
                if met:
                    best = own.longest(t) if longest else None
                    met = {p: n for p, n in met.items() if n == best} if longest else met
                    rows.append((t, list(met), list(met.values())))
            if rows:
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["text", "starts", "found"])

    return texts.mapInArrow(run, "text string, starts array<int>, found array<string>")


def longest_names(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """``text, name``: the longest name that each distinct text contains, of equally long ones the first by name; texts without one are left out."""
    found = _candidates(texts.select(text).distinct(), text, names, name, True).select("text", F.explode("found").alias("name"))
    return found.groupBy("text").agg(F.min_by("name", F.struct((-F.length("name")).alias("l"), "name")).alias("name"))


def name_tags(texts: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """``text, k, start, name``: all names in each distinct text from left to right, the longest where one begins, without overlaps."""
    found = _candidates(texts.select(text).distinct(), text, names, name, False)
    merged = found.groupBy("text").agg(F.flatten(F.collect_list(F.arrays_zip("starts", "found"))).alias("c"))
    order = F.array_sort(F.transform("c", lambda x: F.struct(x["starts"].alias("start"), (-F.length(x["found"])).alias("l"), x["found"].alias("name"))))
    kind = "struct<stop: int, taken: array<struct<start: int, name: string>>>"
    start = F.struct(F.lit(0).alias("stop"), F.array().alias("taken")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        free = x["start"] >= a["stop"]
        taken = F.array_append(a["taken"], F.struct(x["start"].alias("start"), x["name"].alias("name")))
        return F.struct(F.when(free, x["start"] - x["l"]).otherwise(a["stop"]).alias("stop"), F.when(free, taken).otherwise(a["taken"]).alias("taken")).cast(kind)

    return merged.select("text", F.posexplode(F.aggregate(order, start, step)["taken"]).alias("k", "x")).select("text", "k", "x.*")
