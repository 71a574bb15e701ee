"""Fill-in-middle texts, rearranged and put back on ropes.

A rope is a height-balanced tree over a text. A leaf holds some units of it; a
unit is a word with the white space before it, or white space at the end. Every
tree caches its units and its code points, so that a split at a unit rank or a
code-point rank walks down one path and joins what it has left aside, and no
piece of text is copied before the whole is written. A document is split at two
unit ranks and the subtrees are joined again with sentinels between them; the
inverse splits the tree of the output at the places of the sentinels.

Forms: ``plain`` (the text as it is), ``psm`` (``<P>``prefix``<S>``suffix
``<M>``middle) and ``spm`` (``<S>``suffix``<P>``prefix``<M>``middle). Which one,
and the ranks, follow from a hash of the seed and the document's id, so a
repeated run gives the same output.

Edge cases: null and empty texts are ``plain`` with no units; a text that holds
a sentinel stays ``plain``, as it couldn't be told apart afterwards; pieces may
be empty; bytes that are no UTF-8 count as one code point each and survive; a
null ``doc_id`` is hashed as the text ``None``; repeated rows give a row each, an
empty table gives an empty result, and further columns are ignored whatever
their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .arrow import TEXT, texts

#: Units in a leaf at most.
LEAF_UNITS = 64
SENTINELS = ("<P>", "<S>", "<M>")
_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
_UNITS = re.compile(_UNIT)
_LEAF = re.compile(f"(?:{_UNIT}){{1,{LEAF_UNITS}}}")
_SENTINEL = re.compile("<[PSM]>")


@dataclass(slots=True, frozen=True)
class Rope:
    """A leaf (``text``) or a node of two ropes; counts and height are cached."""

    units: int
    chars: int
    height: int = 0
    text: str = ""
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[str]:
        stack = [self]
        while stack:
            r = stack.pop()
            if r.left is None:
                yield r.text
            else:
                stack += (r.right, r.left)

    def __str__(self) -> str:
        return "".join(self.leaves())


EMPTY = Rope(0, 0)


def leaf(text: str, units: int | None = None) -> Rope:
    return Rope(len(_UNITS.findall(text)) if units is None else units, len(text), 0, text)


def _node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), "", a, b)


def _balanced(a: Rope, b: Rope) -> Rope:
    """A node of two ropes whose heights differ by two at most."""
    if a.height > b.height + 1:
        if a.left.height >= a.right.height:
            return _node(a.left, _node(a.right, b))
        return _node(_node(a.left, a.right.left), _node(a.right.right, b))
    if b.height > a.height + 1:
        if b.right.height >= b.left.height:
            return _node(_node(a, b.left), b.right)
        return _node(_node(a, b.left.left), _node(b.left.right, b.right))
    return _node(a, b)


def join(a: Rope, b: Rope) -> Rope:
    """The two texts one after the other; the taller tree is opened down to the other's height."""
    if not a.chars:
        return b
    if not b.chars:
        return a
    if a.height > b.height + 1:
        return _balanced(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return _balanced(join(a, b.left), b.right)
    return _node(a, b)


def split(r: Rope, rank: int, by: str = "units") -> tuple[Rope, Rope]:
    """The rope before and behind the ``rank``-th unit or code point (``by``: ``units`` or ``chars``)."""
    if rank <= 0:
        return EMPTY, r
    if rank >= getattr(r, by):
        return r, EMPTY
    if r.left is None:
        at = rank if by == "chars" else next(m.end() for k, m in enumerate(_UNITS.finditer(r.text), 1) if k == rank)
        return leaf(r.text[:at]), leaf(r.text[at:])
    if rank <= getattr(r.left, by):
        a, b = split(r.left, rank, by)
        return a, join(b, r.right)
    a, b = split(r.right, rank - getattr(r.left, by), by)
    return join(r.left, a), b


def _build(leaves: list[Rope]) -> Rope:
    if len(leaves) == 1:
        return leaves[0]
    half = len(leaves) // 2
    return _node(_build(leaves[:half]), _build(leaves[half:]))


def rope(text: str) -> Rope:
    """A balanced rope; leaves end where units do."""
    leaves = [leaf(m[0], LEAF_UNITS) for m in _LEAF.finditer(text)]
    if not leaves:
        return EMPTY
    leaves[-1] = leaf(leaves[-1].text)
    return _build(leaves)


def arrange(text: str, doc_id: object, seed: int = 42, rate: int = 50, spm_rate: int = 80) -> tuple[Rope, str, int, int | None, int | None]:
    """The output's rope, its form, the text's units, and the code points of prefix and middle (None if plain)."""
    whole = rope(text)
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = whole.units
    if not text or _SENTINEL.search(text) or h3 % 100 >= rate:
        return whole, "plain", n, None, None
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    rest, suffix = split(whole, last)
    prefix, middle = split(rest, first)
    p, s, m = map(leaf, SENTINELS)
    form = "spm" if h4 % 100 < spm_rate else "psm"
    parts = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    out = EMPTY
    for x in parts:
        out = join(out, x)
    return out, form, n, prefix.chars, middle.chars


def restore(output: str, form: str) -> Rope:
    """The text's rope, from an output and its form alone."""
    rest = rope(output)
    if form == "plain":
        return rest
    pieces = {}
    for m in reversed(list(_SENTINEL.finditer(output))):
        rest, behind = split(rest, m.start(), "chars")
        pieces[m[0]] = split(behind, len(m[0]), "chars")[1]
    return join(join(pieces["<P>"], pieces["<M>"]), pieces["<S>"])


def _encoded(r: Rope) -> bytes:
    return str(r).encode("utf-8", "surrogateescape")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row; ``output`` is UTF-8 as binary.

    Of a hundred documents about ``rate`` are rearranged, and of these about ``spm_rate`` with the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                out, *more = arrange(text.as_py().decode("utf-8", "surrogateescape"), doc_id, seed, rate, spm_rate)
                rows.append((more[1], more[0], more[2], more[3], _encoded(out)))
            if rows:
                n, form, prefix, middle, output = zip(*rows, strict=True)
                cols = [pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = dict(docs.dtypes)[id_col]
    return texts(docs, id_col, text_col).select("doc_id", TEXT).mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(df: DataFrame, output_col: str = "output", form_col: str = "form", name: str = "restored") -> DataFrame:
    """``df`` and the texts (UTF-8 as binary) rebuilt from ``output_col`` and ``form_col``."""

    if name in df.columns:
        raise ValueError(f"{name} is a column already")
    at, how = df.columns.index(output_col), df.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_encoded(restore(o.as_py().decode("utf-8", "surrogateescape"), f)) for o, f in zip(b.column(at), b.column(how).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], [*b.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, BinaryType())]))


def digests(docs: DataFrame, **parameters) -> DataFrame:
    """The operator's columns with SHA-256 digests in place of the texts."""
    both = restored(fill_in_middle(docs, **parameters))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The same with lists of units, at the query's parameters."""
    space = r"[\x20\x09-\x0D]"
    unit = rf"{space}*[^\x20\x09-\x0D]+|{space}+"
    return f"""
    WITH h AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{unit}') AS units, sha256('42:' || doc_id) AS d FROM documents),
    r AS (SELECT *, len(units) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
                 ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM h),
    f AS (SELECT *, CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
                 least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM r),
    p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM f)
    SELECT doc_id, n::BIGINT AS n, form,
           CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
           sha256(text) AS restored_sha256
    FROM p"""
