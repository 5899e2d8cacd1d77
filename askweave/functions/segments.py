"""A question cut into parts: what is asked for, what must hold, by what is grouped and ordered.

Breaks are proposed at cue words and signs, and taken back inside what belongs together: quoted text, values, mentions, ``between x and y``,
a comparative with its ``than``. Parts without content join their neighbours; each part's kind comes from the patterns it has and from
the parts around it.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from askweave.functions.patterns import ACTIONS, ASKING, CONDITION, GO_ON, GO_ON_CONDITION, GROUP, ORDER, SELECT, SHARED, SUBSTRING, Annotated, action, compiled
from askweave.functions.question import STOP_WORDS
from askweave.functions.tokens import TEXT, Token, Tokens
from askweave.functions.words import COUNTRIES, MONTHS, SELECT_VERBS, aliases

#: Phrases and what is said for them from then on, in this order.
REWRITES = tuple(
    (re.compile(rf"\b{a}\b", re.I), b)
    for a, b in (
        ("average number of", "average"), ("how many different", "number of different"), ("how many", "number of"), ("at least one", "any"), ("greater than or equal to", "at least"), ("less than or equal to", "at most"),
        ("no (?:more|greater|higher) than", "at most"), ("no (?:less|fewer|lower) than", "at least"), ("not (?:more|greater) than", "at most"), ("not (?:less|fewer) than", "at least"), ("or more", "at least"),
        (r"from (\d+) to (\d+)", r"between \1 and \2"), (r"ranging from (\S+) to (\S+)", r"between \1 and \2"), (r"in the range (\S+) to (\S+)", r"between \1 and \2"), ("full names?", "first name and last name"),
        ("in (?:a )?descending(?: order)? of", "sorted descending by"), ("in (?:an )?ascending(?: order)? of", "sorted ascending by"), ("in alphabetical order of", "sorted ascending by"), ("(?:ordered|sorted|listed) in order of", "sorted by"), ("order(?:ed)? by", "sorted by"), ("grouped by", "for each"), ("for every", "for each"), ("as well as", "and"), ("along with", "and"), ("together with", "and"), ("and also", "and"),
        ("the number of", "number of"), ("a total of", "total"),
    )
)


#: The longest run of letters and blanks that each phrase cannot be without.
_HELD = tuple(max(re.split(r"\([^)]*\)\??|.\?", p.pattern.replace("\\b", "")), key=len) for p, _ in REWRITES)


def rewritten(question: str) -> str:
    """The question in canonical wording; quoted text stays as it is. A comma before ``and`` goes."""
    pieces = re.split(r"('[^']*'|\"[^\"]*\")", question)
    for i in range(0, len(pieces), 2):
        low = pieces[i].lower() if pieces[i].isascii() else None  # other letters may count as ASCII ones where letter case is ignored
        for (pattern, to), held in zip(REWRITES, _HELD):
            if low is None:
                pieces[i] = pattern.sub(to, pieces[i])
            elif held in low:
                pieces[i] = pattern.sub(to, pieces[i])
                low = pieces[i].lower()
        if "," in pieces[i]:
            pieces[i] = re.sub(r"\s*,\s*and\b", " and", pieces[i])
        if "_" in pieces[i]:
            pieces[i] = re.sub(r"(?<=\w)_(?=\w)", " ", pieces[i])
    return "".join(pieces)


class Part(NamedTuple):
    start: int
    end: int
    kind: str
    #: The word that ties it to the part before: and, or, but, or nothing.
    link: str = ""


# -- values ----------------------------------------------------------------------------------------------------------


def edit_distance(a: str, b: str, most: int) -> int:
    """Letters inserted, dropped, replaced or swapped with their neighbour, up to ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = list(range(len(b) + 1)), None
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if last and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[-1] = min(row[-1], last[j - 2] + 1)
        last, before = before, row
        if min(row) > most:
            return most + 1
    return before[-1]


def _codes(text: str) -> list[str]:
    """Other ways to store what a text says: codes of the sexes, a country's other names, a date in digits."""
    low = text.lower()
    if low not in _CODED and not low[-1:].isdigit():
        return []
    found = _SEXES.get(low, []) + aliases(low)
    m = re.fullmatch(r"([a-z]+)\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})", low) or re.fullmatch(r"(\d{1,2})(?:st|nd|rd|th)? ([a-z]+) (\d{4})", low)
    if m:
        month, day = (m.group(1), m.group(2)) if m.group(1).isalpha() else (m.group(2), m.group(1))
        n = next((i for i, x in enumerate(MONTHS, 1) if len(month) >= 3 and x.startswith(month)), None)
        if n:
            y, d = m.group(3), int(day)
            found += [f"{y}-{n:02d}-{d:02d}", f"{y}/{n:02d}/{d:02d}", f"{n}/{d}/{y}", f"{d}/{n}/{y}"]
    return found


_SEXES = {"male": ["m"], "female": ["f"], "man": ["m", "male"], "woman": ["f", "female"], "yes": ["y", "true", "1", "t"], "no": ["n", "false", "0", "f"]}
#: Texts that have other ways, dates aside, and their first words.
_CODED = frozenset(_SEXES) | {x for g in COUNTRIES for x in g}
_CODED_FIRST = frozenset(x.split()[0] for x in _CODED)


def correct_values(tokens: Tokens, values: dict[str, list[tuple[str, str]]], longest: int = 6) -> tuple[Tokens, dict[int, str]]:
    """Runs of tokens that are a stored value, or nearly so, spelt as it is stored; and the value at each such token.

    ``values`` has the columns of each stored text. Near is one letter, two from nine letters on, none below four; codes, countries and dates count
    under their other names. Longer runs come first. Neighbouring values keep to columns of a table they share, if there is one.
    """
    stored = {v.lower(): v for v in values}
    out, at, taken = tokens, {}, set()
    if not stored:
        return out, at
    lows, sizes = tokens.keys(TEXT), [0]
    for x in lows:
        sizes.append(sizes[-1] + len(x) + 1)
    shortest, widest = min(map(len, stored)) - 2, max(map(len, stored)) + 2
    plain = tuple(tokens)
    barred, coded, digits = [x.tag == "PUNCT" for x in plain], [x in _CODED_FIRST for x in lows], [x[-1:].isdigit() for x in lows]
    for a, z in tokens.runs(longest):
        # Runs too short or too long for any value, unless they may have another name.
        if not shortest <= sizes[z] - sizes[a] - 1 <= widest and not coded[a] and not digits[z - 1] and (z - a > 1 or plain[a].tag != "DB"):
            continue
        if any(barred[a:z]) or taken and not taken.isdisjoint(range(a, z)):
            continue
        said = plain[a].text[1:-1] if z - a == 1 and plain[a].tag == "DB" else " ".join([t.text for t in plain[a:z]])
        low = said.lower()
        if z - a == 1 and low in STOP_WORDS:
            continue
        hit = stored.get(low) or next((stored[c] for c in _codes(said) if c in stored), None)
        if hit is None and len(low) >= 4 and (plain[a].tag == "DB" or plain[a].text[:1].isupper()):
            most = 2 if len(low) >= 9 else 1
            near = [(d, v) for v in stored if v[:1] == low[:1] and (d := edit_distance(low, v, most)) <= most and not v.isdigit()]
            hit = stored[min(near)[1]] if near else None
        if hit is not None:
            taken |= set(range(a, z))
            for i in range(a, z):
                at[i] = hit
            if z - a == 1:
                out = out.updated(a, Token(f"'{hit}'" if tokens[a].tag == "DB" else hit, hit.lower(), tokens[a].tag))
    return out, at


def homes(at: dict[int, str], values: dict[str, list[tuple[str, str]]]) -> dict[int, list[tuple[str, str]]]:
    """Columns of the value at each token; those in a table shared with the value next to it, if there are any."""
    if not at:
        return {}
    order, out = sorted(at), {}
    for i in order:
        own = values.get(at[i], [])
        beside = [j for j in order if at[j] != at[i] and abs(j - i) <= 3]
        shared = [c for c in own if any(c[0] == o[0] for j in beside for o in values.get(at[j], []))]
        out[i] = shared or own
    return out


# -- breaks ------------------------------------------------------------------------------------------------------------

_CUES = frozenset("whose where having sorted ordered".split())
_EVIDENCE = frozenset("DB NUM DATE YEAR GR SM NOT JJR".split())
_WITH_EVIDENCE = _EVIDENCE | {"JJS"}
_VALUES = frozenset(("DB", "NUM"))


def _has(a: Annotated, start: int, end: int, classes: frozenset[str]) -> bool:
    """Whether one of these classes, none of which comes from a mention, claims a token of the run."""
    return any(not a.classes(i).isdisjoint(classes) for i in range(start, min(end, len(a.tokens))))


def _held(a: Annotated) -> set[int]:
    """Places at which no part may begin."""
    t, held, quoted = tuple(a.tokens), set(), any(s in a.tokens.keys(TEXT) for s in "'\"")
    for m in a.mentions:
        held |= set(range(m.start + 1, m.end))
    for i in range(len(t)):
        if i in a.values and i - 1 in a.values:
            held.add(i)
        if quoted and (a.tokens.in_quotes(i) or t[i].text in ("'", '"') and a.tokens[:i].count(t[i].text) % 2):
            held.add(i)
        if t[i].lemma == "between":
            z = next((j for j in range(i + 1, min(i + 8, len(t))) if t[j].lemma == "and"), None)
            if z:
                held |= set(range(i + 1, min(z + 2, len(t))))
        if t[i].tag in ("GR", "SM", "JJR"):
            z = next((j for j in range(i + 1, min(i + 4, len(t))) if t[j].lemma == "than"), None)
            if z:
                held |= set(range(i + 1, min(z + 2, len(t))))
        if t[i].tag in ("GR", "SM") and i + 1 < len(t) and t[i + 1].tag in ("NUM", "DATE", "YEAR"):
            held.add(i + 1)
    return held


def _cut(a: Annotated) -> list[Part]:
    """Parts between cues; ``and``, ``or`` and ``but`` begin one where something to be met follows before the next cue."""
    t, held, starts = tuple(a.tokens), _held(a), [0]
    conditioned = False
    for i in range(1, len(t)):
        low = a.tokens.keys(TEXT)[i]
        cue = low in _CUES or low in ("each", "per") and starts[-1] != i - 1
        if low == "by" and i + 1 < len(t) and "COL" in a.classes(i + 1) and any(x.lemma in ("top", "first", "last") or x.tag == "JJS" for x in t[:i]):
            cue = True
        if t[i].lemma == "have" and _has(a, i, i + 8, _VALUES) and any(not m.column and m.end <= i for m in a.mentions):
            cue = True
        if low in ("that", "who", "which") and i + 1 < len(t):
            cue = bool(a.classes(i + 1) & {"V", "IN", "NOT", "COL", "TABLE"})
        if low in ("with", "without", "for", "by", "in") and _has(a, i, i + 8, _WITH_EVIDENCE) and a.classes(min(i + 1, len(t) - 1)) & {"COL", "DB", "GR", "SM", "AGG", "DT", "NOT", "NUM", "NN", "TABLE"}:
            cue = cue or low in ("with", "without") or bool(a.classes(i + 1) & {"DB", "YEAR", "DATE"}) if i + 1 < len(t) else cue
        if low in ("for", "of", "in") and i + 1 < len(t) and t[i + 1].lemma == "each":
            cue = True
        if low in ("and", "or", "but", ",", ";"):
            cue = _has(a, i, i + 8, _EVIDENCE) and (conditioned or low == "but") or i + 1 < len(t) and t[i + 1].lemma in SELECT_VERBS
            cue = cue or i + 1 < len(t) and t[i + 1].lemma in ("sort", "sorted", "order")
        if cue and i not in held:
            starts.append(i)
        conditioned = conditioned or not a.classes(i).isdisjoint(_EVIDENCE - {"JJR"})
    return [Part(s, z, "") for s, z in zip(starts, [*starts[1:], len(t)])]


def _content(a: Annotated, p: Part) -> int:
    return sum(t.tag not in ("PUNCT", "STOP") and t.lemma not in STOP_WORDS for t in a.tokens[p.start : p.end])


def _joined(a: Annotated, parts: list[Part]) -> list[Part]:
    """Parts without content words joined to the one after them, or before at the end."""
    out: list[Part] = []
    for p in parts:
        if out and not _content(a, out[-1]):
            out[-1] = out[-1]._replace(end=p.end)
        else:
            out.append(p)
    if len(out) > 1 and not _content(a, out[-1]):
        out[-2:] = [out[-2]._replace(end=out[-1].end)]
    return out


def _kinds(a: Annotated, parts: list[Part]) -> list[Part]:
    """Each part's kind by its patterns and by the kind before; the first is asked for unless it groups. Only what is measured can be grouped."""
    out: list[Part] = []
    measured = any(t.tag in ("AGG", "JJS") or t.text.lower() in ("many", "number", "shared") for t in a.tokens)
    for n, p in enumerate(parts):
        own = a.part(p.start, p.end)
        what, _ = action(own)
        link = own.tokens[0].text.lower() if own.tokens and own.tokens[0].text.lower() in ("and", "or", "but") else ""
        before = out[-1].kind if out else ""
        if measured and (what == GROUP or any(t.lemma in ("each", "per") for t in own.tokens[:3]) and n):
            kind = "group"
        elif what == ORDER or any(t.lemma in ("sorted", "ordered", "sort") for t in own.tokens[:3]):
            kind = "order"
        elif n == 0 or what == GROUP:
            kind = "select" if n == 0 else before
        elif what in (CONDITION, SHARED, SUBSTRING):
            kind = "condition"
        elif what in (SELECT, ASKING):
            kind = "select"
        elif what == GO_ON_CONDITION:
            kind = before if before != "select" else "condition"
        elif what == GO_ON:
            kind = before
        else:
            kind = "condition" if _has(own, 0, len(own.tokens), _WITH_EVIDENCE) else before
        out.append(p._replace(kind=kind, link=link))
    return out


def _smoothed(a: Annotated, parts: list[Part]) -> list[Part]:
    """A projection after a condition is one only where a select verb leads it; a lone part between two of a kind is of that kind if short."""
    out = list(parts)
    for n in range(1, len(out)):
        lead = next((t.lemma for t in a.tokens[out[n].start : out[n].end] if t.lemma not in ("and", "also", ",", "then")), "")
        if out[n].kind == "select" and out[n - 1].kind == "condition" and lead not in SELECT_VERBS:
            out[n] = out[n]._replace(kind="condition")
        if 0 < n < len(out) - 1 and out[n - 1].kind == out[n + 1].kind != out[n].kind and out[n].kind == "select" and _content(a, out[n]) < 2:
            out[n] = out[n]._replace(kind=out[n - 1].kind)
    return out


def _merged(parts: list[Part]) -> list[Part]:
    """Neighbours of one kind that no connective parts are one, but for conditions."""
    out: list[Part] = []
    for p in parts:
        if out and p.kind == out[-1].kind and p.kind in ("select", "group", "order") and not (p.kind == "select" and p.link):
            out[-1] = out[-1]._replace(end=p.end)
        else:
            out.append(p)
    return out


#: All words that tell parts, beside classes and tags: what else a token says makes no difference to them.
_TELLING = frozenset(w for _, text in ACTIONS for p in compiled(text) for x in p.items for w in x.word.split("/")) | _CUES | SELECT_VERBS | frozenset(
    "each per by top first last have that who which with without for in of and or but , ; sort sorted order ordered between than ' \" many number shared also then".split()
)
_SHAPES: dict[tuple, int] = {}
#: Parts by what tells them, with the action of each; emptied when full.
_TOLD: dict[tuple, tuple[list[Part], list[str]]] = {}
_MOST_TOLD = 50_000


@lru_cache(50_000)
def _shape(t: Token, classes: frozenset[str]) -> int:
    """A number for all tokens that say the same of parts."""
    low = t.text.lower()
    key = (low if low in _TELLING else "", t.lemma if t.lemma in _TELLING else "", t.tag, classes, t.lemma in STOP_WORDS)
    return _SHAPES.setdefault(key, len(_SHAPES))


def shapes(a: Annotated) -> tuple[int, ...]:
    """What each token says of parts, as a number."""
    return tuple(map(_shape, a.tokens, a._claims))


def parts_and_actions(a: Annotated) -> tuple[list[Part], list[str]]:
    """The parts of an annotated question, and the action of each; none of a question without tokens. Questions of one shape are cut once."""
    if not a.tokens:
        return [], []
    tables: dict[str, int] = {}
    key = (shapes(a), tuple([(m.start, m.end, not m.column, tables.setdefault(m.table, len(tables))) for m in a.mentions]), a.values, tuple([tables.get(t, -1) for t in a.tables]))
    if key not in _TOLD:
        if len(_TOLD) >= _MOST_TOLD:
            _TOLD.clear()
        parts = _merged(_smoothed(a, _kinds(a, _joined(a, _cut(a)))))
        _TOLD[key] = parts, [action(a.part(p.start, p.end))[0] for p in parts]
    return _TOLD[key]


def parts_of(a: Annotated) -> list[Part]:
    """The parts of an annotated question; none of a question without tokens."""
    return list(parts_and_actions(a)[0])


def numbered(parts: list[Part]) -> list[int]:
    """A number for each part: -1 grouping, 0 projection, from 1 on each condition or order."""
    out, n = [], 0
    for p in parts:
        n += p.kind in ("condition", "order")
        out.append({"group": -1, "select": 0}.get(p.kind, n))
    return out
