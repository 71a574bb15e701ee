"""Quality rules as a bitmask ledger.

Every rule is evaluated once a document: its measurement is stored and its
failure sets a bit. Policies are versioned masks over those bits, so a new
policy, or the question what a rule contributes, needs no look at the texts.

Edge cases: null or empty texts have zero measurements (and fail the base
rules); words are runs of bytes other than ASCII white space; a null
``doc_id`` is kept, repeated rows give a row each, an empty table gives an
empty result (and an ablation with zero counts), and further columns are
ignored whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_texts, texts

_SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(set(range(256)) - set(_SYMBOLS))
_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUED = bytes(range(128, 192))
_UPPER = bytes(range(65, 91))
_NOT_UPPER = bytes(set(range(256)) - set(_UPPER))
_NOT_LETTER = bytes(set(range(128)) - set(_UPPER) - set(range(97, 123))) + _CONTINUED
_SHOUT = re.compile(rb"!!")
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_twin_words", "n_upper", "n_letters", "n_shouts",
)


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(ids) < 4:
        return 0
    key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:] if ids.max() < 1 << 21 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(len(key), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : k + len(hit)] |= hit
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of a text, in the order of ``MEASURES``."""
    words = text.split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return (
        len(words),
        len(text.translate(None, _SPACE + _CONTINUED)),
        len(text.translate(None, _NOT_SYMBOL)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(ids),
        int((ids[1:] == ids[:-1]).sum()) if len(ids) else 0,
        len(text.translate(None, _NOT_UPPER)),
        len(text.translate(None, _NOT_LETTER)),
        len(_SHOUT.findall(text)),
    )


#: Rules by name in the order of their bits; each fails where its condition holds. Null never occurs in a measurement.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 8 * word_chars",
    "twin_words": "100 * n_twin_words > 20 * n_words",
    "shouting": "100 * n_upper > 50 * n_letters and n_letters > 0",
    "exclamation": "100 * n_shouts > 10 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 50 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
#: Versions of the policy: the rules whose failure rejects a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "twin_words", "shouting", "exclamation"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in POLICIES[policy])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the measurements and ``failed``, the bits of the rules that a document fails."""

    def run(values: list[bytes]) -> list:
        return [list(c) for c in zip(*map(measure, values), strict=True)]

    kind = dict(docs.dtypes)[id_col]
    measured = map_texts(texts(docs, id_col, text_col), run, f"doc_id {kind}, " + ", ".join(f"{m} long" for m in MEASURES), list(MEASURES))
    bits = " + ".join(f"if({cond}, {1 << k}L, 0L)" for k, cond in enumerate(RULES.values()))
    return measured.withColumn("failed", F.expr(bits))


def passes(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def failing(policy: str) -> Column:
    return ~passes(policy)


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """``rule, n_failed, n_alone``: documents that fail a rule of the policy, and those that no other rule of it rejects."""
    names, m = list(RULES), mask(policy)
    hit = F.col("failed").bitwiseAND(F.lit(m))
    counts = []
    for r in POLICIES[policy]:
        bit = 1 << names.index(r)
        counts += [F.count_if(hit.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{r}"), F.count_if(hit == bit).alias(f"a_{r}")]
    rows = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("n_failed"), F.col(f"a_{r}").alias("n_alone")) for r in POLICIES[policy]))
    return entries.agg(*counts).select(F.explode(rows).alias("x")).select("x.*")
