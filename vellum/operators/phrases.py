"""Phrases that a requirement lists: what a parsed text lost, and what a wrong content names.

Both are one fold over tables. A text is parted where a listing ends or goes on,
each part is trimmed of its frame (who acts, what is done, a particle), parted at
joining words, and kept if it says neither too little nor too much.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as T

# How requirements list and frame what they ask for.
#: An object and the verbs behind it that end a listed item.
LISTING = {"기능을": ("제공하여야 한다", "개발하였다", "구현하였다", "구현하고"), "방안을": ("제시하여야 한다",), "업무를": ("처리하고", "운영하고")}
#: What frames an item at its end, one of each row.
FRAMES = ("기능을 제공하여야 한다", "기능을 개발하였다", "기능을 구현하였다", "기능을 구현하고.*", "방안을 제시하여야 한다")
DEEDS = ("업무를 처리한다", "업무를 운영한다", "하도록 구현하였다", "수립한다", "제공한다", "실시한다", "수행한다", "최소화한다", "관리할 수 있어야 한다")
MORE_DEEDS = ("제공하였다", "설치한다", "월별로 운영한다", "운영한다")
GOING_ON, MORE_GOING_ON = ("도입하고", "전환하고", "복구하여"), ("분석하고", "적용하고", "수행한 뒤")
#: Ends an item after the words before it.
PURPOSE = "(?<=재고 회전율)을 높이기 위한"
JOINING, STEMS, MORE_STEMS = ("및", "또는"), ("하고", "하며"), ("하여",)
SIGNS, FULL_STOP = ",，、;；\\n", "."
ACTORS = ("시스템은", "제안사는", "민원 담당자는")
SUBJECTS, OTHER_SUBJECTS, WHEN = ("각 위험은", "위험별", "교육내용은"), ("서버 장비는",), ("장애 발생 시",)
PARTICLES, MORE_PARTICLES = ("을", "를", "은", "는", "이", "가", "와", "과"), ("에", "로", "으로")
#: Particles that comparison ignores.
IGNORED = ("은", "는", "이", "가", "을", "를", "과", "와", "의", "에", "에서", "으로", "로", "도", "만")


@dataclass(frozen=True)
class Rule:
    """How phrases are read; ``heads`` and ``tails`` are taken off row by row, ``longest`` drops or cuts what is longer."""

    breaks: tuple[str, ...]
    signs: str
    stems: tuple[str, ...]
    heads: tuple[tuple[str, ...], ...]
    tails: tuple[tuple[str, ...], ...]
    particles: tuple[str, ...]
    shortest: int
    longest: int
    #: Parts are trimmed before they are parted at joining words too; particles go from the end only; long ones are dropped.
    strict: bool


ASKED = Rule(GOING_ON, SIGNS, STEMS, (ACTORS + SUBJECTS,), (FRAMES, DEEDS), PARTICLES, 4, 35, True)
NAMED = Rule((*GOING_ON, *MORE_GOING_ON, PURPOSE), SIGNS + FULL_STOP, STEMS + MORE_STEMS, (ACTORS + OTHER_SUBJECTS, WHEN), (FRAMES, DEEDS + MORE_DEEDS), PARTICLES + MORE_PARTICLES, 2, 45, False)
#: Characters of a whole text that stand for it where it names nothing.
WHOLE = 120


def _flat(s: Column) -> Column:
    return T.strip(F.regexp_replace(F.coalesce(s, F.lit("")), r"(?U)\s+", " "))


def shortened(s: Column, n: int) -> Column:
    """The first ``n`` characters and dots, where there are more."""
    return F.when(F.length(s) > n, F.concat(F.regexp_replace(F.substring(s, 1, n), r"(?U)\s+$", ""), F.lit("..."))).otherwise(s)


def _without(s: Column, words: tuple[str, ...], before: str, after: str) -> Column:
    return F.regexp_replace(s, f"(?U){before}(?:{'|'.join(words)}){after}", "")


def trimmed(s: Column, rule: Rule) -> Column:
    """A part without its frame; empty if it says too little, or too much under a strict rule."""
    out = _flat(s)
    if not rule.strict:
        out = F.regexp_replace(out, r"^[ .。]+|[ .。]+$", "")
    for words in rule.heads:
        out = _without(out, words, "^", r"\s*")
    for words in rule.tails:
        out = _without(out, words, "", "$")
    out = T.strip(_without(out, rule.particles, "", "$")) if rule.strict else _flat(_without(T.strip(out), rule.particles, "", r"(?=\s|$)"))
    fits = lambda x: F.when(F.length(x) <= rule.longest, x).otherwise("") if rule.strict else shortened(x, rule.longest)
    return T.once(out, lambda x: F.when(F.length(T.compare_form(x)) >= rule.shortest, fits(x)).otherwise(""))


def listed(s: Column, rule: Rule) -> Column:
    """The phrases of a flat text, each once in order."""
    ends = [rf"{thing}\s*(?:{'|'.join(verbs)})" for thing, verbs in LISTING.items()]
    parts = T.split(s, rf"(?U)(?:{'|'.join(ends)}|(?:{'|'.join(rule.breaks)})\s*|[{rule.signs}])+")
    if rule.strict:
        parts = F.transform(parts, lambda x: trimmed(x, rule))
    at = rf"(?U)\s+(?:{'|'.join(JOINING)})\s+|(?<=\S)(?:{'|'.join(rule.stems)})\s+"
    each = F.flatten(F.transform(F.filter(parts, lambda x: x != ""), lambda x: T.split(x, at)))
    return F.array_distinct(F.filter(F.transform(each, lambda x: trimmed(x, rule)), lambda x: x != ""))


def phrases(s: Column) -> Column:
    """What a requirement asks for."""
    return listed(_flat(s), ASKED)


def named_items(s: Column) -> Column:
    """What a content names, for the report on a wrong one: its phrases, else its front; nothing for a blank text."""
    return T.once(_flat(s), lambda flat: T.once(listed(flat, NAMED), lambda found: F.when((F.size(found) > 0) | (flat == ""), found).otherwise(F.array(shortened(flat, WHOLE)))))


def missing_phrases(pairs: DataFrame, key: str, original: str, parsed: str, least: float = 0.75) -> DataFrame:
    """``key, k, phrase``: phrases of an original that the parsed text neither holds in compared form nor in pieces to ``least``."""
    each = pairs.where((F.coalesce(original, F.lit("")) != "") & (F.coalesce(parsed, F.lit("")) != "")).select(key, parsed, F.posexplode(phrases(F.col(original))).alias("k", "phrase"))
    form = lambda c: T.compare_form(_without(c, IGNORED, "", r"\b"))
    rest = each.where((form(F.col("phrase")) != "") & ~form(F.col(parsed)).contains(form(F.col("phrase"))))
    return rest.where(S.containment("phrase", parsed) < least).select(key, "k", "phrase")
