"""Patterns over annotated questions: what they are written in, where they stand, and what they say of a part of a question.

A pattern is a row of items; alternatives are parted by `` | ``. An item is a word (met by text or base form) or

* ``_`` any token, ``*`` a token that no class claims, ``?`` a stop word;
* a class: TABLE, COL, DB (quoted text or a value), PCOL and TCOL (a column of a table named before, or of the next one), and the tags
  NUM, DATE, YEAR, AGG, JJS, JJR, GR, SM, NOT, IN (a preposition), V (a verb form), WP (a question word), CC, NN, DT;
* ``$x`` an item that may be missing, ``-x`` anything but x, ``NO#x`` a place before which no x stands, ``a/b`` either of two;
* ``+`` at the beginning: only at the start of a part; ``@ n&X``: the n-th X of the part, wherever it stands.

A negative word between two items is passed over and remembered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache
from typing import NamedTuple

from askweave.functions.question import STOP_WORDS
from askweave.functions.schema_words import Mention
from askweave.functions.tokens import LEMMA, TEXT, Token, Tokens
from askweave.functions.words import NEGATIVE, direction

PREPOSITIONS = frozenset("in of on at by for from with to into over under within during through across".split())
QUESTION_WORDS = frozenset("who whom whose which what that where when".split())
DETERMINERS = frozenset("the a an all each every any some this these those".split())
VERBS = frozenset("be have do".split())
MARKS = ("+", "@", "$", "-", "NO#")


@dataclass(frozen=True)
class Item:
    word: str
    optional: bool = False
    refused: bool = False
    not_before: bool = False
    number: int = 0


@dataclass(frozen=True)
class Pattern:
    text: str
    items: tuple[Item, ...]
    at_start: bool = False
    anywhere: bool = False

    @cached_property
    def needed(self) -> frozenset[str]:
        """Words and classes without which the pattern stands nowhere."""
        return frozenset(x.word for x in self.items if not (x.optional or x.refused or x.not_before or x.word in "_*?" or "/" in x.word))


class Found(NamedTuple):
    pattern: str
    start: int
    end: int
    negated: bool = False


@dataclass(frozen=True)
class Annotated:
    """Tokens with the mentions of tables and columns in them; ``tables`` are those that the question named before."""

    tokens: Tokens
    mentions: tuple[Mention, ...] = ()
    tables: tuple[str, ...] = ()
    #: Tokens that a stored value covers.
    values: frozenset[int] = field(default=frozenset())

    @cached_property
    def _parts(self) -> dict[tuple[int, int], Annotated]:
        return {}

    def part(self, start: int, end: int) -> Annotated:
        """Tokens ``start`` to ``end`` by themselves, made once."""
        if (start, end) not in self._parts:
            self._parts[start, end] = self._part(start, end)
        return self._parts[start, end]

    def _part(self, start: int, end: int) -> Annotated:
        own = tuple(Mention(m.start - start, m.end - start, m.table, m.column, m.tier) for m in self.mentions if start <= m.start and m.end <= end)
        before = [m.table for m in self.mentions if not m.column and m.end <= start]
        return Annotated(self.tokens[start:end], own, tuple(dict.fromkeys([*self.tables, *before])), frozenset(v - start for v in self.values if start <= v < end))

    def at(self, i: int) -> list[Mention]:
        return [m for m in self.mentions if m.start <= i < m.end]

    def classes(self, i: int) -> frozenset[str]:
        """The classes that claim a token."""
        return self._claims[i]

    @cached_property
    def _claims(self) -> list[frozenset[str]]:
        held = [0] * len(self.tokens)
        named = [(m.table, m.start) for m in self.mentions if not m.column]
        for m in self.mentions:
            what = _TABLE if not m.column else _COL | (_PCOL if m.table in self.tables else 0) | (_TCOL if any(t == m.table and at >= m.end for t, at in named) else 0)
            for i in range(max(0, m.start), min(m.end, len(held))):
                held[i] |= what
        return [_classes(t, h | (_DB if i in self.values else 0)) for i, (t, h) in enumerate(zip(self.tokens, held))]

    @cached_property
    def bag(self) -> frozenset[str]:
        """All words and classes of the tokens."""
        return frozenset().union(*self._claims, self.tokens.keys(TEXT), self.tokens.keys(LEMMA))

    @cached_property
    def acting(self) -> tuple[str, Found | None]:
        """See :func:`action`."""
        return next(((name, found) for name, text in ACTIONS if (found := first(text, self))), (NOTHING, None))


#: What mentions and values make of a token.
_DB, _TABLE, _COL, _PCOL, _TCOL = 1, 2, 4, 8, 16


@lru_cache(50_000)
def _classes(t: Token, held: int) -> frozenset[str]:
    found = {name for name, bit in (("DB", _DB), ("TABLE", _TABLE), ("COL", _COL), ("PCOL", _PCOL), ("TCOL", _TCOL)) if held & bit}
    if t.tag and t.tag not in ("STOP", "PUNCT"):
        found.add(t.tag)
    for name, words in (("IN", PREPOSITIONS), ("WP", QUESTION_WORDS), ("DT", DETERMINERS), ("V", VERBS), ("NOT", NEGATIVE), ("CC", ("and", "or", "but"))):
        if t.lemma in words or t.text.lower() in words:
            found.add(name)
    if not found and t.text.isalpha() and t.lemma not in STOP_WORDS:
        found.add("V" if t.text.lower().endswith(("ing", "ed")) else "NN")
    return frozenset(found)


@lru_cache(4096)
def compiled(text: str) -> tuple[Pattern, ...]:
    """The alternatives of a pattern text."""
    return tuple(_one(alternative.split()) for alternative in text.split(" | ") if alternative.strip())


def _one(words: list[str]) -> Pattern:
    at_start, anywhere = words[0] == "+", words[0] == "@"
    items = []
    for w in words[at_start or anywhere :]:
        optional, refused, not_before = w.startswith("$") and len(w) > 1, False, w.startswith("NO#")
        w = w.removeprefix("$") if optional else w.removeprefix("NO#")
        if w.startswith("-") and len(w) > 1:
            refused, w = True, w[1:]
        number, _, rest = w.partition("&")
        items.append(Item(rest or w if rest else w, optional, refused, not_before, int(number) if rest and number.isdigit() else 0))
    return Pattern(" ".join(words), tuple(items), at_start, anywhere)


def fits(word: str, a: Annotated, i: int) -> bool:
    """Whether one token is what an item asks for."""
    if len(word) > 1 and "/" not in word:
        return word in a.classes(i) if word.isupper() else word in (a.tokens.keys(TEXT)[i], a.tokens.keys(LEMMA)[i])
    t = a.tokens[i]
    if word == "_":
        return t.tag != "PUNCT"
    if "/" in word and len(word) > 1:
        return any(fits(w, a, i) for w in word.split("/"))
    if word == "?":
        return t.tag == "STOP" or t.lemma in STOP_WORDS
    own = a.classes(i)
    if word == "*":
        return t.tag != "PUNCT" and not own & {"TABLE", "COL", "DB", "NUM", "DATE", "YEAR", "AGG", "JJS", "JJR", "GR", "SM"}
    if word.isupper():
        return word in own
    return word in (t.text.lower(), t.lemma)


def _span(word: str, a: Annotated, i: int) -> int:
    """Where what a class claims ends: mentions of several words are one item."""
    if word in ("TABLE", "COL", "PCOL", "TCOL"):
        return max((m.end for m in a.at(i) if m.start == i and bool(m.column) == (word != "TABLE")), default=i + 1)
    if word == "DB" and i in a.values:
        while i + 1 in a.values:
            i += 1
    return i + 1


def find(pattern: Pattern, a: Annotated, most: int | None = None) -> list[Found]:
    """Where a pattern stands, leftmost first, without overlaps; ``most`` places at most."""
    if pattern.anywhere:
        if not pattern.needed <= a.bag:
            return []
        places = []
        for item in pattern.items:
            hits = [i for i in range(len(a.tokens)) if fits(item.word, a, i)]
            if len(hits) < max(1, item.number):
                return []
            places.append(hits[max(1, item.number) - 1])
        return [Found(pattern.text, min(places), max(places) + 1)] if places == sorted(places) else []

    items, n = pattern.items, len(a.tokens)
    if not pattern.needed <= a.bag:
        return []

    def run(k: int, at: int, negated: bool) -> tuple[int, bool] | None:
        if k == len(items):
            return at, negated
        item = items[k]
        if item.not_before:
            return None if at and fits(item.word, a, at - 1) else run(k + 1, at, negated)
        if at < n:
            if fits(item.word, a, at) != item.refused:
                if (r := run(k + 1, at + 1 if item.refused else _span(item.word, a, at), negated)) is not None:
                    return r
            if k and item.word != "NOT" and "NOT" in a.classes(at) and (r := run(k, at + 1, True)) is not None:
                return r
        return run(k + 1, at, negated) if item.optional else None

    out, at = [], 0
    while at < n:
        hit = run(0, at, False)
        if hit and hit[0] > at:
            out.append(Found(pattern.text, at, *hit))
            if len(out) == most:
                break
            at = hit[0]
        else:
            at += 1
        if pattern.at_start:
            break
    return out


@lru_cache(4096)
def _by_need(text: str) -> tuple[tuple[Pattern, ...], dict[str, list[int]], list[int]]:
    """The alternatives of a pattern text; their numbers by one word or class that each needs, and those of the ones that need nothing."""
    patterns, needing, free = compiled(text), {}, []
    for n, p in enumerate(patterns):
        if p.needed:  # words say more than classes
            needing.setdefault(min(p.needed, key=lambda w: (w.isupper(), w)), []).append(n)
        else:
            free.append(n)
    return patterns, needing, free


def first(text: str, a: Annotated) -> Found | None:
    """The first alternative that stands anywhere in a part, and its first place."""
    patterns, needing, free = _by_need(text)
    near = sorted([*free, *(n for w in needing.keys() & a.bag for n in needing[w])])
    return next((hits[0] for n in near if (hits := find(patterns[n], a, 1))), None)


def whole(text: str, a: Annotated) -> Found | None:
    """The first alternative that covers a part from its start to its end, final signs aside."""
    end = len(a.tokens)
    while end and a.tokens[end - 1].tag == "PUNCT":
        end -= 1
    own = a.part(0, end)
    for p in compiled(text):
        hit = next((f for f in find(p, own) if f.start == 0 and f.end == end), None)
        if hit:
            return hit
    return None


#: What a pattern says of a part of a question: it is a projection, it goes on as the part before (whatever that is, or if that is a condition),
#: it is a condition of its own or one that the parts after it share, it groups, it orders, it asks for a part of a text, or it says nothing.
SELECT, GO_ON, GO_ON_CONDITION, CONDITION, SHARED, GROUP, ORDER, SUBSTRING, ASKING, NOTHING = "select", "go on", "go on condition", "condition", "shared", "group", "order", "substring", "asking", "nothing"

#: The actions in the order in which they are tried, each with the patterns of a part that call for it.
ACTIONS: tuple[tuple[str, str], ...] = (
    (ASKING, "which TABLE | which COL | which COL of TABLE | which * | what be TABLE | what be COL | who | what | list TABLE | list COL | list COL of TABLE | find TABLE | find COL | find COL of TABLE | show TABLE | show COL | show COL of TABLE | display *"),
    (GROUP, "+ IN each TABLE | + IN each COL | + IN every TABLE | + IN every COL | + each COL | + each TABLE | + grouped by COL | + grouped by TABLE | + per COL | + per TABLE | + IN each * COL | + IN each NN | + have each COL"),
    (ORDER, "+ sorted IN * | + sort by COL | + by COL | + sorted by COL | + ordered by COL | + order by COL | + IN * order | + IN * order of COL | + IN alphabetical order | + IN * alphabetical order | + ascending | + descending"),
    (SELECT, "$and what be _ _ | $and what COL be | $and how many _ _ | $and list _ _ | + and what COL _ | $also show _ _ | $and give _ _ | $and return _ _"),
    (SUBSTRING, "substring | contain the word DB | contain DB | start with DB | end with DB | begin with DB | include the word DB"),
    (GO_ON_CONDITION, "GR than _ _ | GR than _ | SM than _ | GR NUM | SM NUM | named DB | called DB | than NUM | JJR than _"),
    (CONDITION, "+ whose _ | + but _ | + or _ | + and COL DB | + with COL DB | + with COL GR | + with COL SM | + with COL between | between NUM and NUM | COL be DB | COL DB | TABLE DB | + at least NUM | + at most NUM | + that have _ | + who have _ | @ 1&GR 1&NUM | @ 1&SM 1&NUM | + NOT _ | DB"),
    (SHARED, "+ that IN TABLE | + that be IN TABLE | + IN TABLE | + without TABLE | + that have NOT TABLE | WP NOT V | + with TABLE"),
    (GO_ON, "+ and COL | + COL of TABLE | + COL of COL | + COL IN TABLE | COL and COL | + number of COL | + number of TABLE | + from JJR to JJR | or NUM | + total COL | and | in total | + to COL"),
    (NOTHING, "+ please | + also | in the"),
)


def action(a: Annotated) -> tuple[str, Found | None]:
    """What a part of a question is, by the first pattern that stands in it."""
    return a.acting


def directed(a: Annotated, columns: Sequence[tuple[str, str]] = ()) -> list[str]:
    """Tags of a part in which comparatives and superlatives carry the way they point: GR_ for more, SM_ for less."""
    out = []
    for i, t in enumerate(a.tokens):
        if t.tag not in ("JJS", "JJR", "GR", "SM"):
            out.append(t.tag)
            continue
        near = sorted((m for m in a.mentions if m.column), key=lambda m: abs(m.start - i))
        named = [c.split("_") for _, c in (*((m.table, m.column) for m in near), *columns)]
        way = next((d for words in named if (d := direction(t.lemma, words))), 0)
        low = t.text.lower()
        if not way:
            way = -1 if t.tag == "SM" or t.lemma in ("small", "low", "few", "least", "short", "young", "early", "light", "cheap", "bad", "close", "near") or low in ("least", "fewest") else 1
        out.append(("GR_" if way > 0 else "SM_") + t.tag)
    return out
