"""What a provision refers to: one reading of a text into numbered units, and rules over them.

A text is read into its units (제N조, 제N항, ...) with their places. Units that
touch make one place (제2조제1항), two of a kind with ``부터`` between make a
range. Rules then go over the units in a fixed order; a rule may claim a part of
the text, and the later rules for single places pass over what is claimed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from .statutes import HANGUL, passages

# How statutes and contract conditions write what they refer to.
UNITS, BRANCHED = "조항호절", "조"
FROM, EACH = "부터", r"\s*각\s*호"
LAWS = {"시행규칙": "규칙", "시행령": "영", "규칙": "규칙", "법": "법", "영": "영"}
OPENING, CLOSING = "“\"", "”\""
JOINERS = ("와", "및", ",", "·")
#: Characters after a law's short name that belong to it, those that end them, and characters that a further quoted place has at most.
REACH, ENDS, QUOTED = 80, "。\n「」", 20

_UNIT = re.compile(rf"제(\d+)([{UNITS}])")
_BRANCH = re.compile(r"의(\d+)")
_LAW = re.compile(rf"({'|'.join(LAWS)})\s+(?=제\d+조)")
_QUOTE = re.compile(rf"\s*[{OPENING}]([^{CLOSING}]*)[{CLOSING}]")
_EACH = re.compile(EACH)


class Unit(NamedTuple):
    start: int
    end: int
    kind: str
    number: str
    branch: str | None = None


class Mention(NamedTuple):
    """A place in a law: that of ``title`` (as it is quoted), of ``prefix``, with every item of it if ``each``."""

    title: str | None
    prefix: str | None
    jo: str
    ui: str | None = None
    hang: str | None = None
    ho: str | None = None
    mok: str | None = None
    semok: str | None = None
    each: bool = False


def units(text: str) -> list[Unit]:
    out = []
    for m in _UNIT.finditer(text):
        branch = _BRANCH.match(text, m.end()) if m[2] in BRANCHED else None
        out.append(Unit(m.start(), branch.end() if branch else m.end(), m[2], m[1], branch and branch[1]))
    return out


def ranges(text: str, found: list[Unit], kind: str) -> list[tuple[Unit, Unit]]:
    """Pairs of a kind with ``부터`` between, each unit in one pair at most."""
    out: list[tuple[Unit, Unit]] = []
    if FROM not in text:
        return out
    for a, b in zip(found, found[1:], strict=False):
        used = out and out[-1][1] is a
        if a.kind == b.kind == kind and not a.branch and not used and text[a.end : b.start].rstrip() == FROM:
            out.append((a, b))
    return out


def spelled(first: str, last: str) -> list[str]:
    return [str(n) for n in range(int(first), int(last) + 1)]


def named_places(passage: str) -> Iterator[tuple[str, str | None, str | None, str | None]]:
    """Each article of a passage with all paragraphs and items named before the next article."""
    found = units(passage)
    heads = [k for k, u in enumerate(found) if u.kind == "조"]

    def numbers(part: list[Unit], kind: str) -> list[str | None]:
        own = {int(u.number) for u in part if u.kind == kind} | {int(n) for a, b in ranges(passage, part, kind) for n in spelled(a.number, b.number)}
        return [str(n) for n in sorted(own)] or [None]

    for k, stop in zip(heads, [*heads[1:], len(found)], strict=True):
        for hang in numbers(found[k + 1 : stop], "항"):
            for ho in numbers(found[k + 1 : stop], "호"):
                yield str(int(found[k].number)), found[k].branch, hang, ho


#: The levels of a quoted place behind its clause, in order.
_LEVELS = (("ho", re.compile(rf"([{HANGUL}])\)?")), ("mok", re.compile(r"(\d+)\)?")), ("semok", re.compile(rf"([{HANGUL}])\)?")))


def quoted_place(token: str, before: dict | None = None) -> dict | None:
    """Clause and up to three levels that a quoted place names, parted by hyphens; None if it is no place.

    A place that is only a letter, or a number with a bracket, takes what stands above it from the place ``before``.
    """
    head, *rest = token.split("-")
    if before and not rest and head in HANGUL and len(head) == 1:
        return {"hang": before["hang"], "ho": head}
    if before and not rest and head[-1:] == ")" and head[:-1].isdecimal():
        return {"hang": before["hang"], "ho": before.get("ho"), "mok": head[:-1]}
    if not head.isdecimal():
        return None
    out, level = {"hang": str(int(head))}, 0
    for part in rest:
        while level < len(_LEVELS) and not _LEVELS[level][1].fullmatch(part):
            level += 1
        if level == len(_LEVELS):
            return None
        out[_LEVELS[level][0]] = _LEVELS[level][1].fullmatch(part)[1]
        level += 1
    return out


class Reading:
    """A text's units, and what the rules so far have claimed of it."""

    def __init__(self, text: str, own: dict, relatives: dict[str, str]):
        self.text, self.own, self.relatives = text, own, relatives
        self.units, self.claimed = units(text), []
        self.law, self.jo, self.ui, self.hang = own["prefix"], own["jo"], own["jo_ui"], own["hang"]
        item = re.match(r"\d+", own["ho"] or "")
        self.item = item[0] if item else None

    def free(self, at: int, also: tuple | list = ()) -> bool:
        for a, b in self.claimed:
            if a <= at < b:
                return False
        for a, b in also:
            if a <= at < b:
                return False
        return True

    def behind(self, u: Unit) -> str:
        """The character before a unit."""
        return self.text[u.start - 1 : u.start]

    def tied(self, k: int, *kinds: str) -> dict[str, Unit]:
        """The units of these kinds, in this order, that touch the ``k``-th one and each other."""
        out, end = {}, self.units[k].end
        for kind in kinds:
            u = self.units[k + 1] if k + 1 < len(self.units) else None
            if u and u.start == end and u.kind == kind:
                out[kind], end, k = u, u.end, k + 1
        return out

    def titled(self) -> Iterator[Mention]:
        for a, b, title, passage in passages(self.text):
            self.claimed.append((a, b))
            yield from (Mention(title, None, *place) for place in named_places(passage))

    def relative(self) -> Iterator[Mention]:
        end = 0
        for m in _LAW.finditer(self.text):
            if m.start() < end:
                continue
            head = next(u for u in self.units if u.start == m.end())
            first = m.end() + len(f"제{head.number}조")
            end = min([first + REACH, len(self.text), *(p for p in (self.text.find(c, first) for c in ENDS) if p >= 0)])
            if law := self.relatives.get(LAWS[m[1]]):
                self.claimed.append((m.start(), end))
                yield from (Mention(None, law, *place) for place in named_places(self.text[m.end() : end]))

    def article_ranges(self) -> Iterator[Mention]:
        for a, b in ranges(self.text, self.units, "조"):
            self.claimed.append((a.start, b.end))
            yield from (Mention(None, self.law, n) for n in spelled(a.number, b.number))

    def articles(self) -> Iterator[Mention]:
        for k, u in enumerate(self.units):
            if u.kind == "조" and self.free(u.start):
                below = self.tied(k, "항", "호")
                hang, ho = (below[x].number if x in below else None for x in ("항", "호"))
                if not ((u.number, u.branch) == (self.jo, self.ui) and hang in (None, self.hang) and ho in (None, self.item)):
                    yield Mention(None, self.law, u.number, u.branch, hang, ho)

    def paragraphs(self) -> Iterator[Mention]:
        """Of the own article; what hangs on an article isn't bare."""
        bare = lambda u: self.behind(u) != "조" and not self.behind(u).isdecimal() and self.free(u.start)
        spans = []
        for a, b in ranges(self.text, self.units, "항") if self.jo else ():
            if bare(a):
                spans.append((a.start, b.end))
                yield from (Mention(None, self.law, self.jo, self.ui, n) for n in spelled(a.number, b.number))
        for k, u in enumerate(self.units if self.jo else ()):
            if u.kind == "항" and bare(u) and self.free(u.start, spans):
                ho = self.tied(k, "호").get("호")
                yield Mention(None, self.law, self.jo, self.ui, u.number, ho and ho.number)

    def items(self) -> Iterator[Mention]:
        """Of the own paragraph or article, in an item only."""
        if not self.jo or not self.item:
            return
        spans = []
        for a, b in ranges(self.text, self.units, "호"):
            if self.behind(a) != "호" and not self.behind(a).isdecimal() and self.free(a.start):
                spans.append((a.start, b.end))
                yield from (Mention(None, self.law, self.jo, self.ui, self.hang, n) for n in spelled(a.number, b.number))
        for u in self.units:
            bare = self.behind(u) not in ("조", "항") and not self.behind(u).isdecimal()
            if u.kind == "호" and bare and u.number != self.item and self.free(u.start, spans):
                yield Mention(None, self.law, self.jo, self.ui, self.hang, u.number)

    def sections(self) -> Iterator[Mention]:
        """Quoted places of a section, and those joined to them."""
        for u in self.units:
            quote = _QUOTE.match(self.text, u.end) if u.kind == "절" else None
            place = quote and quoted_place(quote[1])
            if not place:
                continue
            at = quote.end()
            while place:
                yield Mention(None, self.law, u.number, **place)
                at, before, place = quote.end(), place, None
                gap = re.match(r"\s*(\S)", self.text[at:])
                if gap and gap[1] in JOINERS and (quote := _QUOTE.match(self.text, at + gap.end())) and 0 < len(quote[1]) <= QUOTED:
                    place = quoted_place(quote[1].strip(), before)
            self.claimed.append((u.start, at))

    def letters(self) -> Iterator[Mention]:
        """Quoted letters of the own clause, in conditions."""
        if self.jo or not self.own["jeol"] or not self.hang:
            return
        for m in re.finditer(rf"[{OPENING}]([{HANGUL}])[{CLOSING}]", self.text):
            if self.free(m.start()) and m[1] != self.own["ho"]:
                yield Mention(None, self.law, self.own["jeol"], None, self.hang, m[1])

    def every_item(self) -> Iterator[Mention]:
        for k, u in enumerate(self.units):
            if u.kind == "조":
                hang = self.tied(k, "항").get("항")
                if _EACH.match(self.text, (hang or u).end):
                    yield Mention(None, self.law, u.number, u.branch, hang and hang.number, each=True)


#: The rules in their order.
RULES = (Reading.titled, Reading.relative, Reading.article_ranges, Reading.articles, Reading.paragraphs, Reading.items, Reading.sections, Reading.letters, Reading.every_item)


def mentions(text: str, own: dict, relatives: dict[str, str]) -> list[Mention]:
    """All places that a chunk's text refers to, rule by rule and from left to right, each once; its own place doesn't count.

    ``own`` is the chunk's place; ``relatives`` has the prefixes of the decree and the rules of its law, by their short names.
    """
    reading = Reading(text, own, relatives)
    return list(dict.fromkeys(m for rule in RULES for m in rule(reading)))
