"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

A short test item inside a long document has a tiny Jaccard similarity, so one
sketch length can't serve all documents. Documents are partitioned by size:
class ``j`` holds those with up to ``2 ** j`` shingles, and its MinHash sketch
has ``2 ** (j + BIN_BITS)`` slots. One hash function serves all slots (the
leading bits of a shingle's hash name the slot, its minimum is the value), so a
document's sketch costs one hash a shingle. An item is looked up in a class
under the slots of that class. A document that agrees with an item in a slot is
a candidate; a shared shingle goes unseen only if a smaller one of the document
has its slot, one time in ``2 ** (BIN_BITS + 1)`` or fewer, and a contained
item shares at least four fifths of its shingles.

Candidates are verified on the shingles' text: the part of the item's distinct
shingles that occur in the document must reach ``threshold``.

Edge cases: shingles are of ``n_words`` words (text with fewer words: the whole
sequence; none: no shingle, never contained); null texts and ids are allowed;
rows that repeat id and text give one pair an item; items that repeat an id are
different items only if their texts differ; an empty table on either side gives
an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import packed, unpacked
from ..scratch import Scratch

BIN_BITS = 10
#: Rows of the item index, of the items' shingles and of candidate documents that are broadcast at most; beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000
#: The same in bytes, for shingles.
BROADCAST_BYTES = 64 << 20
#: Tasks to which the rows of a frequent shingle are dealt where both sides are shuffled.
SPREAD = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text_col: str) -> Column:
    """The words of a text, A-Z in lower case."""
    lowered = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lowered, r"[\x20\x09-\x0D]+"), "")


def shingle_hashes(own: str, n_words: int) -> Column:
    """Hashes of the shingles of a column of words, repeats included."""
    w, n = F.col(own), F.size(own)
    many = F.transform(F.sequence(F.lit(0), n - n_words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n_words))))
    return F.when(n >= n_words, many).when(n > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(own: str, n_words: int) -> Column:
    """The distinct shingles of a column of words."""
    w, n = F.col(own), F.size(own)
    many = F.transform(F.sequence(F.lit(0), n - n_words), lambda i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n_words))))
    return F.when(n >= n_words, F.array_distinct(many)).when(n > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))


def _common_bits(a: Column, b: Column) -> Column:
    """Leading bits that two different longs share."""
    return F.lit(64) - F.length(F.bin(a.bitwiseXOR(b)))


def sketches(docs: DataFrame, id_col: str, text_col: str, n_words: int) -> DataFrame:
    """``doc_id, text_hash, j, h``: the size class and the value of each filled slot."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"), words(text_col).alias("w"))
    hashed = own.select("doc_id", "text_hash", F.sort_array(shingle_hashes("w", n_words)).alias("h"))
    # never null, so that a join on j infers no filter on it, which would be pushed below in the same way
    sized = hashed.withColumn("j", F.coalesce(F.ceil(F.log2(F.size("h").cast("double"))).cast("int"), F.lit(0)))
    shift = F.lit(64 - BIN_BITS) - F.col("j")
    first = F.filter("h", lambda x, i: (i == 0) | (_slot(x, shift) != _slot(F.get(F.col("h"), i - 1), shift)))
    # outer: of a plain explode a filter on the whole expression is inferred, and pushed into the lambdas below
    return sized.select("doc_id", "text_hash", "j", F.explode_outer(first).alias("h")).where("h is not null")


def _slot(h: Column, shift: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, shift)


def item_index(items: DataFrame, item_col: str, text_col: str, n_words: int) -> DataFrame:
    """``h, from_j``: an item's shingle is the value of its slot from this class on."""
    own = items.select(words(text_col).alias("w")).select(F.sort_array(F.array_distinct(shingle_hashes("w", n_words))).alias("h"))
    each = own.select(F.posexplode_outer("h").alias("k", "x"), "h").where("x is not null")
    before = F.get(F.col("h"), F.col("k") - 1)
    bits = F.when(F.col("k") == 0, 0).otherwise(_common_bits(F.col("x"), before))
    return each.select(F.col("x").alias("h"), F.greatest(bits - BIN_BITS, F.lit(0)).alias("from_j")).groupBy("h").agg(F.min("from_j").alias("from_j"))


def contained(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n_words: int = 5, threshold: float = 0.8,
) -> DataFrame:
    """``doc_id, text_hash, item_id, n_shared, n_item, containment`` for each document that holds ``threshold`` of an item's shingles."""
    scratch = Scratch(docs.sparkSession, "leaks")
    index = scratch.cut(item_index(items, item_col, item_text_col, n_words), "index")
    met = _meet(sketches(docs, id_col, text_col, n_words), index, "h", index.count() <= BROADCAST_ROWS).where("j >= from_j")
    found = scratch.cut(met.select("doc_id", "text_hash").distinct(), "candidates")
    few = found.count() <= BROADCAST_ROWS
    # items of one text are one kind; their ids come in last
    texts = items.select(F.col(f"`{item_col}`").alias("item_id"), words(item_text_col).alias("w")).select("item_id", shingle_texts("w", n_words).alias("s"))
    kinds = texts.select("item_id", F.xxhash64("s").alias("kind"), F.size("s").alias("n_item"), "s")
    names = kinds.where("n_item > 0").select("item_id", "kind").distinct()
    each = kinds.dropDuplicates(["kind"]).select("kind", "n_item", F.explode_outer("s").alias("s")).where("s is not null")
    shingles = scratch.cut(each, "shingles")
    rows, size = shingles.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("s") + 16), F.lit(0))).first()
    own = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("text_hash"), F.col(f"`{text_col}`").alias("text")
    )
    hit = found.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"))
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
    own = own.join(F.broadcast(hit) if few else hit, same, "left_semi").select("doc_id", "text_hash", words("text").alias("w"))
    spread = own.select("doc_id", "text_hash", F.explode_outer(shingle_texts("w", n_words)).alias("s")).where("s is not null")
    shared = _meet(spread, shingles, "s", rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES)
    counted = shared.groupBy("doc_id", "text_hash", "kind", "n_item").agg(F.countDistinct("s").alias("n_shared"))
    ratio = F.col("n_shared") / F.col("n_item")
    enough = scratch.cut(counted.where(ratio >= threshold), "contained")
    scratch.drop(index, found, shingles)
    return enough.join(names, "kind").select("doc_id", "text_hash", "item_id", "n_shared", F.col("n_item").cast("long"), ratio.alias("containment"))


def _meet(left: DataFrame, right: DataFrame, key: str, small: bool) -> DataFrame:
    """Rows of documents (with ``doc_id``, ``text_hash``) and of items that agree in ``key``; a frequent key's rows are dealt to ``SPREAD`` tasks."""
    if small:
        return left.join(F.broadcast(right), key)
    dealt = left.withColumn("part", F.pmod(F.hash("doc_id", "text_hash"), F.lit(SPREAD)))
    return dealt.join(right.select("*", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("part")), [key, "part"]).drop("part")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``docs`` without those that contain an item."""
    leaks = contained(docs, items, id_col, text_col, **parameters).select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash")).distinct()
    own = packed(docs, own_id=F.col(f"`{id_col}`"), own_hash=F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    kept = own.join(leaks, F.col("own_id").eqNullSafe(F.col("other_id")) & (F.col("own_hash") == F.col("other_hash")), "left_anti")
    return unpacked(kept, docs.columns)


def oracle_sql(n_words: int = 5, threshold: float = 0.8) -> str:
    """All exact containments in DuckDB's SQL."""
    split = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    cut = (
        f"CASE WHEN len(w) >= {n_words} THEN list_distinct(list_transform(range(1, len(w) - {n_words} + 2), lambda i: array_to_string(w[i:i + {n_words - 1}], ' '))) "
        "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END"
    )
    return f"""
WITH d AS (SELECT doc_id, unnest({cut}) AS s FROM (SELECT doc_id, {split} AS w FROM documents)),
i AS (SELECT item_id, {cut} AS all_s FROM (SELECT item_id, {split} AS w FROM benchmark)),
e AS (SELECT item_id, CAST(len(all_s) AS BIGINT) AS n_item, unnest(all_s) AS s FROM i)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, n_item, CAST(count(*) AS DOUBLE) / n_item AS containment
FROM d JOIN e USING (s) GROUP BY doc_id, item_id, n_item HAVING CAST(count(*) AS DOUBLE) / n_item >= {threshold}"""
