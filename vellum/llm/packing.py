"""Cost-balanced packing of token sequences.

A piece of ``n`` tokens costs ``n + n * n / capacity``: a linear part and the
quadratic one of attention, equal for a full sequence. Documents longer than a
sequence are cut into full pieces and a rest. Pieces are dealt by their place in
a written table into groups of about ``group_rows`` pieces; within a group they go, in
descending order, to the cheapest sequence that has room. A group opens as
many sequences as its tokens need, and another only when a piece fits nowhere.
Groups grow in number with the input, not in size, and no piece is left out.

Tokens are encoded once, when pieces are cut; a table with a row for each
piece (not the ids) is written to the shared folder and all further work is on
that. A vocabulary whose pre-tokenizer drops white space and never joins what
stands on its two sides (``tokens.separable`` reads that from the file) lets
ids be looked up by chunk: chunks a worker hasn't met go to the library in one
batch, and a bounded memo holds short ones. With any other vocabulary, texts
are encoded whole.

Edge cases: null or empty texts give one piece with the end token alone; a
null ``doc_id`` is kept; repeated rows give pieces each; an empty table gives
an empty result; further columns are ignored whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import by_bytes, giving_back, texts
from ..scratch import Scratch
from .tokens import load, separable

MEMO_BYTES, MEMO_CHUNKS = 48, 700_000
#: Words that go to the library as one text, and such texts in one call.
JOINED, CALL = 256, 32
_STOP = re.compile(rb"[.,](?=[ \n]|\Z)(?<=[a-z0-9][.,])")  # begins with what is rare, so that the search is fast
_MEMO: dict[str, dict[bytes, bytes]] = {}


def chunks(text: bytes) -> list[bytes]:
    """The chunks of a text that are encoded apart, fewer different ones where that changes no id.

    The vocabulary is of lower case, and a lone full stop or comma after a
    letter or digit is a token of its own. Texts that may hold a special token
    (looked for before lower-casing) are left as they are.
    """
    return text.split() if b"<|" in text else _STOP.sub(rb" \g<0>", text.lower()).split()


def encode_chunks(values: list[bytes], tokenizer: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    if separable(tokenizer) != "words":
        whole, library = [v.decode("utf-8", "replace") for v in values], load(tokenizer)
        ids = library.encode(whole, num_threads=1) if tokenizer.endswith(".model") else [e.ids for e in library.encode_batch_fast(whole, add_special_tokens=False)]
        return [np.array(x, "<u4").tobytes() for x in ids]
    memo = _MEMO.setdefault(tokenizer, {})
    if len(memo) > MEMO_CHUNKS:
        memo.clear()
    split = [chunks(v) for v in values]
    found = [list(map(memo.get, x)) for x in split]
    gaps = [[i for i, v in enumerate(y) if v is None] for y in found]
    missing = list({x[i] for x, at in zip(split, gaps, strict=True) for i in at})
    if missing:
        own = _encoded(missing, load(tokenizer))
        memo.update((c, v) for c, v in own.items() if len(c) <= MEMO_BYTES)
        for x, y, at in zip(split, found, gaps, strict=True):
            for i in at:
                y[i] = own[x[i]]
    return [b"".join(y) for y in found]


def _encoded(missing: list[bytes], library) -> dict[bytes, bytes]:
    """The ids of chunks. Those of letters only are one pre-token each, so many of them go to the library as one text."""
    out: dict[bytes, bytes] = {}
    letters, rest = [], []
    for c in missing:
        text = c.decode("utf-8", "replace")
        (letters if text.isalpha() and len(c) <= MEMO_BYTES else rest).append((c, text))
    groups = [letters[k : k + JOINED] for k in range(0, len(letters), JOINED)]
    calls = (groups[k : k + CALL] for k in range(0, len(groups), CALL))
    for group, e in ((g, e) for part in calls for g, e in zip(part, library.encode_batch([" ".join(t for _, t in g) for g in part], add_special_tokens=False), strict=True)):
        ids, word = np.array(e.ids, "<u4").tobytes(), np.array([-1 if w is None else w for w in e.word_ids], np.int64)
        cut = np.flatnonzero(np.diff(word, prepend=-1))
        if len(cut) != len(group):  # a word without ids
            rest += group
            continue
        ends = [*(4 * cut).tolist(), len(ids)]
        out.update((c, ids[a:b]) for (c, _), a, b in zip(group, ends, ends[1:], strict=False))
    got = library.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
    out.update((c, np.array(e.ids, "<u4").tobytes()) for (c, _), e in zip(rest, got, strict=True))
    return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, end_id: int, capacity: int, batch_bytes: int) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` for each piece."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in batches:
            values, rows, row_of = b.column(1).to_pylist(), [], []
            for lo, hi in by_bytes(values, batch_bytes):
                for k, ids in enumerate(encode_chunks(values[lo:hi], tokenizer), lo):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        stop = min(n, start + capacity)
                        crc = zlib.crc32(ids[4 * start : 4 * stop])
                        rows.append((start, stop - start, crc, n))
                        row_of.append(k)
            if rows:
                cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row_of)), *cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return texts(docs, id_col, text_col).mapInArrow(giving_back(run), schema)


def assign(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length; the lengths must be in descending order."""
    n = int(-(-lengths.sum() // capacity))
    room = np.full(n + len(lengths), capacity, np.int64)
    cost = np.zeros(len(room))
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, x in enumerate(lengths.tolist()):
        at = int(np.where(room[:n] >= x, cost[:n], np.inf).argmin())
        if room[at] < x:
            at, n = n, n + 1
        sequence[k], offset[k] = at, capacity - room[at]
        room[at] -= x
        cost[at] += x + x * x / capacity
    return sequence, offset


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, capacity: int = 4096,
    group_rows: int = 4000, batch_bytes: int = 1 << 20,
) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    spark = docs.sparkSession
    cut = Scratch(spark, "packing").cut(pieces(docs, tokenizer, id_col, text_col, end_id, capacity, batch_bytes), "pieces")
    groups = max(1, -(-cut.count() // group_rows))
    kind = dict(cut.dtypes)["doc_id"]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "deal", "start"], ascending=[False, True, True], kind="stable")
        sequence, offset = assign(rows["length"].to_numpy(), capacity)
        rows["sequence_id"], rows["offset"] = (int(key[0]) << 24) + sequence, offset
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # by the places of the written rows, so that the pieces of a frequent text are dealt to all groups alike
    dealt = cut.withColumn("deal", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64("deal"), F.lit(groups)))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("group").applyInPandas(one, schema)
