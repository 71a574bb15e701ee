"""Token counts of whole texts, in Arrow functions that return lengths only.

A batch of texts is cut into parts of about ``batch_bytes`` bytes, so that a
few long texts don't make one call large. Texts are split at safe boundaries:
a single space between two characters that are no white space. Byte-level
pre-tokenizers attach such a space to the word after it and never look across
it, so the counts of the units add up to the count of the text; other runs of
white space stay inside a unit. Units that a worker hasn't met go to the
library in one batch; a bounded memo holds the lengths of short ones. Whether
that holds is read from the vocabulary file; with any other one, texts are
encoded whole.

Edge cases: null or empty texts have no tokens; strings of special tokens
inside a text are handled as the library does by default; a text without any
safe boundary is encoded whole; a null ``doc_id`` is kept, repeated rows give
a row each, an empty table gives an empty result, and further columns are
ignored whatever their names.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import by_bytes, map_texts, texts

#: Units of at most so many characters are kept in the memo, and so many of them.
MEMO_CHARS, MEMO_UNITS = 48, 300_000
_UNSAFE = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_LOADED: dict = {}
#: Fixed value: the pattern of the pre-tokenizer that keeps words, single digits and runs of signs, and drops white space.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SEPARABLE: dict[str, str] = {}


def separable(path: str) -> str:
    """How a vocabulary file lets texts be taken apart without another token: ``bytes``, ``words``, or ``no``.

    ``bytes``: byte-level pre-tokens of the library's own pattern, no normalizer. ``words``: ``WORDS``, whatever case.
    """
    if path not in _SEPARABLE:
        kind = "no"
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                own = json.load(f)
            pre, norm = own.get("pre_tokenizer") or {}, own.get("normalizer")
            special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in own.get("added_tokens") or [])
            plain = special and own["model"]["type"] == "BPE" and not own.get("post_processor")
            steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (norm or {}).get("normalizers", [])]
            lowered = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            split = [(x["type"], x.get("pattern"), x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in pre.get("pretokenizers", [])]
            if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
                kind = "bytes"
            elif plain and steps == lowered and split == [("Split", {"Regex": WORDS}, "Removed", True, None, None), ("ByteLevel", None, None, None, False, False)]:
                kind = "words"
        _SEPARABLE[path] = kind
    return _SEPARABLE[path]


def load(path: str):
    """The tokenizer of a file, once a process."""
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece

            _LOADED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def units(text: str) -> list[str]:
    """A text's units; each but the first stands after one space."""
    return _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")


class Lengths:
    """Counts tokens with one tokenizer; the memo is emptied when it is full."""

    def __init__(self, path: str):
        self.path, self.library = path, load(path)
        self.memo: dict[str, int] = {}

    def encode(self, values: list[str]) -> list[int]:
        if self.path.endswith(".model"):
            return [len(x) for x in self.library.encode(values, num_threads=1)]
        return [len(x) for x in self.library.encode_batch_fast(values, add_special_tokens=False)]

    def count(self, values: list[str]) -> list[int]:
        if separable(self.path) == "no":  # pieces may reach across spaces
            return self.encode(values)
        split = [units(v) for v in values]
        total = np.array(self.encode([x[0] for x in split]), np.int64)
        sizes = np.fromiter((len(x) - 1 for x in split), np.int64, len(split))
        flat = [u for x in split for u in x[1:]]
        if not flat:
            return total.tolist()
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        memo = self.memo
        found = list(map(memo.get, flat))
        missing = list({u for u, n in zip(flat, found, strict=True) if n is None})
        if missing:
            own = dict(zip(missing, self.encode([f" {u}" for u in missing]), strict=True))
            memo.update((u, n) for u, n in own.items() if len(u) <= MEMO_CHARS)
            found = [own[u] if n is None else n for u, n in zip(flat, found, strict=True)]
        ends = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        at = np.concatenate([[0], np.cumsum(sizes)])
        return (total + ends[at[1:]] - ends[at[:-1]]).tolist()


_LENGTHS: dict[str, Lengths] = {}


def token_counts(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 20, limit: int = 1024
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row; ``tokenizer`` is a file that every executor has."""

    def run(values: list[bytes]) -> list:
        if tokenizer not in _LENGTHS:
            _LENGTHS[tokenizer] = Lengths(tokenizer)
        lengths, out = _LENGTHS[tokenizer], []
        for a, b in by_bytes(values, batch_bytes):
            out += lengths.count([v.decode("utf-8", "replace") for v in values[a:b]])
        return [[len(v) for v in values], out]

    kind = dict(docs.dtypes)[id_col]
    counted = map_texts(texts(docs, id_col, text_col), run, f"doc_id {kind}, n_bytes long, n_tokens long", ["n_bytes", "n_tokens"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
