"""Words of questions and schemas: base forms, stems, degrees of adjectives, numbers, and what adjectives say of columns.

Everything is by rule over small lexicons, so it runs wherever a token is. Words are taken in lower case.
"""

from __future__ import annotations

import re
from functools import lru_cache

#: Forms that no rule gives.
IRREGULAR = {
    "is": "be", "are": "be", "was": "be", "were": "be", "been": "be", "being": "be", "am": "be", "'s": "'s", "has": "have", "had": "have", "having": "have", "does": "do", "did": "do", "done": "do", "doing": "do",
    "people": "person", "children": "child", "men": "man", "women": "woman", "feet": "foot", "teeth": "tooth", "mice": "mouse", "lives": "life", "wives": "wife", "leaves": "leaf", "shelves": "shelf",
    "criteria": "criterion", "indices": "index", "data": "data", "series": "series", "species": "species", "news": "news", "bus": "bus", "gas": "gas", "status": "status", "address": "address", "this": "this", "its": "its",
    "better": "good", "best": "good", "worse": "bad", "worst": "bad", "more": "more", "most": "most", "less": "less", "least": "least", "further": "far", "farther": "far", "furthest": "far", "farthest": "far", "fewer": "few", "fewest": "few",
}
#: Adjectives of degree; their other forms follow by rule.
ADJECTIVES = (
    "big bright broad cheap clever close cold damp deep dry early easy fast fat great heavy high hot huge large late light long loud low new narrow near old poor quick quiet rich shallow sharp short slim slow small smart steep strong sweet tall thick thin tiny "
    "tough vast warm weak wet wide wise young"
).split()
#: Words of a column, adjectives that ask for more of it, and adjectives that ask for less.
DIMENSIONS = (
    (("age",), ("old", "elderly"), ("young",)),
    (("birth", "birthday", "born", "founded", "built"), ("young", "new", "late"), ("old", "early")),
    (("date", "year", "time", "day"), ("late", "new", "recent"), ("early", "previous", "prior")),
    (("price", "cost", "fee", "charge", "amount"), ("expensive", "costly"), ("cheap",)),
    (("weight",), ("heavy", "fat"), ("light",)),
    (("height", "elevation", "altitude"), ("tall", "high"), ("short", "low")),
    (("length", "duration", "distance", "minutes", "hours"), ("long", "far", "distant"), ("short", "close", "near")),
    (("width",), ("wide", "broad"), ("narrow",)),
    (("depth",), ("deep",), ("shallow",)),
    (("speed",), ("fast", "quick"), ("slow",)),
    (("temperature",), ("hot", "warm"), ("cold",)),
    (("volume", "decibel"), ("loud",), ("quiet",)),
    (("size", "area", "population", "capacity"), ("big", "large", "great", "huge", "vast"), ("small", "tiny")),
    (("salary", "income", "balance", "revenue", "budget"), ("rich",), ("poor",)),
    (("rating", "rank", "score", "grade"), ("good",), ("bad",)),
    (("share", "percentage"), ("dominant", "main", "major", "popular"), ()),
)
#: Words that ask for more, and for less, of whatever is named.
UP = frozenset("more over above greater larger higher exceed exceeding beyond after later longer older most".split())
DOWN = frozenset("less under below fewer smaller lower before earlier prior shorter younger least".split())
NEGATIVE = frozenset("not no never without nor neither except none cannot null empty outside hasn shouldn mustn isn wasn aren wouldn don haven doesn hadn didn weren couldn n't 't".split())
SELECT_VERBS = frozenset("list how which find return what show count compute give tell display report get name who where when".split())
AGGREGATES = {"average": "avg", "maximum": "max", "minimum": "min", "number": "count", "total": "sum", "mean": "avg", "avg": "avg", "max": "max", "min": "min", "sum": "sum", "count": "count", "amount": "count"}
RELATED = {"DATE": ("year", "time", "date", "datetime"), "YEAR": ("year",), "TIME": ("time", "datetime", "hour")}
MONTHS = "january february march april may june july august september october november december".split()
NUMBERS = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), range(21))) | {"once": 1, "twice": 2, "thrice": 3, "dozen": 12, "hundred": 100, "thousand": 1000}
#: Names of one country; the default of a parameter.
COUNTRIES = (("united states of america", "united states", "usa", "us", "america", "american"), ("united kingdom", "uk", "britain", "british"), ("china", "chinese", "prc"), ("france", "french"), ("germany", "german"), ("japan", "japanese"), ("spain", "spanish"), ("italy", "italian"), ("canada", "canadian"), ("india", "indian"))

_VOWEL = re.compile(r"[aeiouy]")


def _degree_forms(base: str) -> tuple[str, str]:
    """Comparative and superlative by the rules of spelling."""
    if base.endswith("e"):
        stem = base[:-1]
    elif base.endswith("y"):
        stem = base[:-1] + "i"
    elif re.search(r"(?<![aeiou])[aeiou][bdgmnpt]$", base) and len(base) <= 4:
        stem = base + base[-1]
    else:
        stem = base
    return stem + "er", stem + "est"


COMPARATIVES = {_degree_forms(a)[0]: a for a in ADJECTIVES}
SUPERLATIVES = {_degree_forms(a)[1]: a for a in ADJECTIVES}


@lru_cache(100_000)
def lemma(word: str) -> str:
    """The base form: of verbs "be", "have" and "do", of comparatives and superlatives, and of plurals."""
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    for forms in (COMPARATIVES, SUPERLATIVES):
        if w in forms:
            return forms[w]
    if len(w) > 3 and w.endswith("s"):
        if w.endswith("es") and IRREGULAR.get(w[:-2]) == w[:-2]:
            return w[:-2]
        if w.endswith("ies"):
            return w[:-3] + "y"
        if re.search(r"(ss|x|z|ch|sh)es$", w):
            return w[:-2]
        if not w.endswith(("ss", "us", "is")):
            return w[:-1]
    return w


#: The published rules of the Paice-Husk stemmer. Ending (reversed), ``*`` only of an untouched word, letters to cut, letters
#: to put in their place, ``>`` to go on or ``.`` to stop.
PAICE_HUSK = (
    "ai*2. a*1. bb1. city3s. ci2> cn1t> dd1. dei3y> deec2ss. dee1. de2> dooh4> e1> feil1v. fi2> gni3> gai3y. ga2> gg1. ht*2. hsiug5ct. hsi3> i*1. i1y> ji1d. juf1s. ju1d. jo1d. jeh1r. jrev1t. jsim2t. jn1d. j1s. "
    "lbaifi6. lbai4y. lba3> lbi3. lib2l> lc1. lufi4y. luf3> lu2. lai3> lau3> la2> ll1. mui3. mu*2. msi3> mm1. nois4j> noix4ct. noi3> nai3> na2> nee0. ne2> nn1. pihs4> pp1. re2> rae0. ra2. ro2> ru2> rr1. rt1> rei3y> "
    "sei3y> sis2. si2> ssen4> ss0. suo3> su*2. s*1> s0. tacilp4y. ta2> tnem4> tne3> tna3> tpir2b. tpro2b. tcud1. tpmus2. tpec2iv. tulo2v. tsis0. tsi3> tt1. uqi3. ugo1. vis3j> vie0. vi2> ylb1> yli3y> ylp0. yl2> ygo1. "
    "yhp1. ymo1. ypo1. yti3> yte3> ytl2. yrtsi5. yra3> yro3> yfi3. ycn2t> yca3> zi2> zy1s."
).split()
_RULES = [re.fullmatch(r"([a-z]+)(\*?)(\d)([a-z]*)([>.])", r).groups() for r in PAICE_HUSK]


@lru_cache(100_000)
def stem(word: str) -> str:
    """The Paice-Husk stem; months stay whole, and forms of degree give the stem of their base."""
    w = word.lower()
    if w in MONTHS:
        return w
    w = COMPARATIVES.get(w) or SUPERLATIVES.get(w) or w
    whole, going = w, True
    while going and w.isascii() and w.isalpha():
        going = False
        for ending, untouched, cut, put, on in _RULES:
            if not w.endswith(ending[::-1]) or untouched and w != whole:
                continue
            new = w[: len(w) - int(cut)] + put
            # What is left must be a word still: two letters after a vowel, else three with a vowel.
            if not (len(new) >= 2 if new[:1] in "aeiou" else len(new) >= 3 and _VOWEL.search(new[1:])):
                continue
            w, going = new, on == ">"
            break
    return w


def degree(word: str) -> tuple[str, str] | None:
    """("JJS" or "JJR", base) of a superlative or comparative; None of others."""
    w = word.lower()
    if w in SUPERLATIVES or w in ("best", "worst", "most", "least", "fewest", "furthest", "farthest"):
        return "JJS", lemma(w)
    if w in COMPARATIVES or w in ("better", "worse", "more", "less", "fewer", "further", "farther"):
        return "JJR", lemma(w)
    return None


def direction(adjective: str, column_words: list[str]) -> int:
    """1 where an adjective asks for more of a column, -1 for less, 0 where it says nothing of it."""
    own = {lemma(w) for w in column_words}
    for columns, up, down in DIMENSIONS:
        if own & {lemma(c) for c in columns}:
            if adjective in up:
                return 1
            if adjective in down:
                return -1
    return 0


def column_words_of(adjective: str) -> list[tuple[str, int]]:
    """Words of columns of which an adjective can speak, with its direction."""
    return [(c, sign) for columns, up, down in DIMENSIONS for sign, words in ((1, up), (-1, down)) if adjective in words for c in columns]


def is_long_number(s: str) -> bool:
    """Digits that are no year: five and more, or four outside 1000 to 2999."""
    return bool(re.fullmatch(r"\d{5,}|[03-9]\d{3}", s))


def is_negative(s: str) -> bool:
    return bool(re.fullmatch(r"-\d+", s))


def number_of(word: str) -> str:
    """Digits for a number word; other words as they are."""
    return str(NUMBERS[word.lower()]) if word.lower() in NUMBERS else word


def aliases(name: str, groups=COUNTRIES) -> list[str]:
    """Other names of the same country."""
    return [x for g in groups if name.lower() in g for x in g if x != name.lower()]
