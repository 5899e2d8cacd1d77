"""Questions as data: typed tokens, segments, patterns over tags, and the literals of a query filled in from its question.

Tags are found by rule over lexicons; every function here is a plain one over tokens, and the column functions run it
over Arrow batches. Null questions stay null, empty ones have no tokens.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askweave.operators.linking import STOP_WORDS

#: The lexicons of the tags.
NUMBER_WORDS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "once": 1, "twice": 2, "dozen": 12, "hundred": 100}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NEGATIVE = frozenset("not no never without n't nor neither except none".split())
AGGREGATES = {"average": "avg", "mean": "avg", "avg": "avg", "maximum": "max", "max": "max", "minimum": "min", "min": "min", "number": "count", "count": "count", "total": "sum", "sum": "sum"}
GREATER = frozenset("more over above greater larger higher older later longer after exceeding exceeds bigger least".split())
SMALLER = frozenset("less under below fewer smaller lower younger earlier shorter before most".split())
SUPERLATIVE = {"highest": "desc", "largest": "desc", "most": "desc", "biggest": "desc", "oldest": "desc", "longest": "desc", "latest": "desc", "top": "desc", "lowest": "asc", "smallest": "asc", "least": "asc", "fewest": "asc", "youngest": "asc", "shortest": "asc", "earliest": "asc"}
GROUPING = frozenset("each every per".split())
CONDITION = frozenset("whose where with that who which having when have has by in for of".split())

_TOKEN = re.compile(r"'[^']*'|‘[^’]*’|\"[^\"]*\"|“[^”]*”|`[^`]*`|\d{1,4}[-/]\d{1,2}[-/]\d{1,4}|-?\d[\d,]*(?:\.\d+)?%?|n't|[^\W\d_]+(?:'s)?|\S")


@lru_cache(50_000)
def is_number(s: str) -> bool:
    """Digits with commas, a point or a percent sign, or a number word."""
    return bool(re.fullmatch(r"-?(\d+|\d{1,3}(,\d{3})+)(\.\d+)?%?", s)) or s.lower() in NUMBER_WORDS


def to_number(s: str) -> int | float:
    """The number of a token; 0 where it is none."""
    if s.lower() in NUMBER_WORDS:
        return NUMBER_WORDS[s.lower()]
    bare = s.replace(",", "").rstrip("%")
    return int(bare) if re.fullmatch(r"-?\d+", bare) else float(bare) if re.fullmatch(r"-?\d+\.\d+", bare) else 0


def is_date(s: str) -> bool:
    return bool(re.fullmatch(r"\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{1,2}:\d{2}(:\d{2})?", s))


def is_year(s: str) -> bool:
    return bool(re.fullmatch(r"[12]\d{3}", s))


@dataclass(frozen=True)
class Token:
    text: str
    tag: str


def text_tokens(question: str) -> list[str]:
    """Quoted texts, dates, numbers, words and signs, as they stand."""
    return _TOKEN.findall(question)


def tag_tokens(question: str) -> list[Token]:
    """Tokens with one tag each: DB (quoted), DATE, YEAR, NUM, NOT, AGG, JJS, GR, SM, GROUP, STOP, PUNCT or nothing.

    A number word counts as a number except ``one`` after an article or pronoun. A year needs a cue of time before it.
    """
    words = text_tokens(question)
    return [tagged(w, before.lower()) for w, before in zip(words, ["", *words])]


@lru_cache(50_000)
def tagged(w: str, before: str) -> Token:
    """A token by its text and the text before it."""
    low = w.lower()
    if len(w) > 1 and w[0] in "'‘\"“`" and w[-1] in "'’\"”`":
        tag = "DB"
    elif is_date(w):
        tag = "DATE"
    elif is_year(w) and before in ("in", "year", "since", "after", "before", "from", "of", *MONTHS):
        tag = "YEAR"
    elif is_number(w) and not (low == "one" and before in ("the", "this", "that", "which", "does")):
        tag = "NUM"
    elif low in NEGATIVE:
        tag = "NOT"
    elif low in AGGREGATES:
        tag = "AGG"
    elif low in ("least", "most") and before == "at":
        tag = "GR" if low == "least" else "SM"
    elif low in SUPERLATIVE:
        tag = "JJS"
    elif low in GREATER:
        tag = "GR"
    elif low in SMALLER:
        tag = "SM"
    elif low in GROUPING:
        tag = "GROUP"
    elif low in STOP_WORDS:
        tag = "STOP"
    elif not re.search(r"\w", w):
        tag = "PUNCT"
    else:
        tag = ""
    return Token(w, tag)


def segments(question: str) -> list[tuple[str, str]]:
    """The question cut into (kind, text): select first, then conditions and groupings, at commas, connectives and grouping words."""
    parts: list[tuple[str, list[str]]] = [("select", [])]
    tokens = tag_tokens(question)
    for i, t in enumerate(tokens):
        low = t.text.lower()
        later = any(x.tag in ("DB", "NUM", "DATE", "YEAR", "NOT") for x in tokens[i:])
        if t.tag == "GROUP":
            parts.append(("group", []))
        elif low in CONDITION and low not in ("of", "in", "for", "by") and i and later and parts[-1][1]:
            parts.append(("condition", []))
        elif low in ("and", "or", "but") and parts[-1][0] == "condition" and later and any(x.tag in ("DB", "NUM", "DATE", "YEAR") for x in tokens[:i]):
            parts.append(("condition", []))
        if t.tag != "PUNCT":
            parts[-1][1].append(t.text)
    return [(k, " ".join(ws)) for k, ws in parts if ws]


def find_pattern(pattern: str, tokens: list[Token]) -> list[tuple[int, int, bool]]:
    """Where a pattern of tags and words stands: (start, end, whether a negative word was passed over).

    Items of a pattern: ``_`` any token, ``*`` any token without a tag, ``?`` a stop word, an upper-case name a tag, ``-w`` any token but
    that word, ``$x`` an item that may be missing, else the word itself, letter case and a plural ending aside.
    Matches do not overlap; the leftmost longest comes first.
    """
    items = pattern.split()

    def fits(item: str, t: Token) -> bool:
        low = t.text.lower()
        if item == "_":
            return True
        if item == "*":
            return t.tag == ""
        if item == "?":
            return t.tag == "STOP" or low in STOP_WORDS
        if item[0] == "-" and len(item) > 1:
            return low != item[1:]
        if item.isupper():
            return t.tag == item
        return low == item or low == item + "s"

    def run(k: int, at: int, negated: bool) -> tuple[int, bool] | None:
        if k == len(items):
            return at, negated
        optional = items[k][0] == "$"
        item = items[k][1:] if optional else items[k]
        if at < len(tokens):
            if fits(item, tokens[at]) and (r := run(k + 1, at + 1, negated)):
                return r
            if k and tokens[at].tag == "NOT" and item != "NOT" and (r := run(k, at + 1, True)):
                return r
        return run(k + 1, at, negated) if optional else None

    out, at = [], 0
    while at < len(tokens):
        hit = run(0, at, False)
        if hit and hit[0] > at:
            out.append((at, *hit))
            at = hit[0]
        else:
            at += 1
    return out


def repaired(question: str, names: list[str]) -> str:
    """Quotes made plain, ``at least one`` folded to ``any``, and words one letter away from a schema word spelt like it.

    Words of fewer than five letters, stop words, quoted text and words of the schema stay.
    """
    text = re.sub(r"[‘’`´]", "'", re.sub(r"[“”]", '"', question))
    text = re.sub(r"\bat least one\b", "any", text, flags=re.I)
    known = {w for n in names for w in re.findall(r"[a-z]+", n.lower())}

    def near(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > 1 or a[0] != b[0]:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]

    def fix(m: re.Match) -> str:
        w = m.group()
        if w[0] in "'\"" or len(w) < 5 or w.lower() in STOP_WORDS or w.lower() in known or w.lower().removesuffix("s") in known:
            return w
        return next((k for k in sorted(known) if len(k) >= 5 and near(w.lower(), k)), w)

    return re.sub(r"'[^']*'|\"[^\"]*\"|[^\W\d_]+", fix, text)


# -- literals --------------------------------------------------------------------------------------------------------

_LITERAL = re.compile(r"'[^']*'|\"[^\"]*\"|(?<![\w.])-?\d+(?:\.\d+)?(?![\w.])")
TERMINAL = "'terminal'"


def without_values(sql: str) -> str:
    """The query with every literal replaced by ``'terminal'``; what a LIMIT had becomes 1."""
    return re.sub(r"(?i)\blimit\s+'terminal'", "LIMIT 1", _LITERAL.sub(TERMINAL, sql))


def filled(sql: str, question: str) -> str:
    """``'terminal'`` literals and the limit filled in from the question, in its order.

    After LIKE and equality comes quoted text where there is some left, else numbers; comparisons take numbers, dates and years
    first. BETWEEN gets its two numbers in order. LIKE puts ``%`` where the question speaks of beginnings or ends, else on both
    sides. LIMIT takes the number beside a superlative word or ``top``. What nothing fits stays ``'terminal'``.
    """
    tokens = tag_tokens(question)
    texts = [t.text[1:-1] for t in tokens if t.tag == "DB"]
    limit_at = None
    if re.search(r"(?i)\blimit\s+1\b", sql):
        for i, t in enumerate(tokens):
            near = tokens[max(0, i - 2) : i] + tokens[i + 1 : i + 2]
            if t.tag == "NUM" and (any(x.text.lower() in ("top", "first") or x.tag == "JJS" for x in near)):
                limit_at = i
                break
    numbers = [t.text for i, t in enumerate(tokens) if t.tag in ("NUM", "DATE", "YEAR") and i != limit_at]
    low = question.lower()

    def literal(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    out, at = [], 0
    pending_high: list[str] = []
    for m in re.finditer(re.escape(TERMINAL), sql):
        head = sql[: m.start()].rstrip()
        lead = (re.search(r"(?i)(between|and|like|not in|in|!=|<>|>=|<=|=|>|<|\()\s*$", head) or re.search(r"()$", head)).group(1).lower()
        value = None
        if lead == "like" and texts:
            v = texts.pop(0)
            value = literal(v + "%") if re.search(r"\b(start|begin)", low) else literal("%" + v) if re.search(r"\bend", low) else literal(f"%{v}%")
        elif lead == "between" and len(numbers) > 1:
            pair = sorted(numbers[:2], key=lambda s: (to_number(s), s))
            del numbers[:2]
            value, pending_high = _number(pair[0]), [pair[1]]
        elif lead == "and" and pending_high:
            value = _number(pending_high.pop())
        elif lead in (">", "<", ">=", "<=") and numbers:
            value = _number(numbers.pop(0))
        elif texts:
            value = literal(texts.pop(0))
        elif numbers:
            value = _number(numbers.pop(0))
        out += [sql[at : m.start()], value or TERMINAL]
        at = m.end()
    done = "".join(out) + sql[at:]
    if limit_at is not None:
        done = re.sub(r"(?i)(\blimit\s+)1\b", lambda m: m.group(1) + str(to_number(tokens[limit_at].text)), done)
    return done


def _number(s: str) -> str:
    return "'" + s + "'" if is_date(s) else str(to_number(s))


# -- columns ---------------------------------------------------------------------------------------------------------

_TAGGED = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("tag", T.StringType())]))
_SEGMENTS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


@F.arrow_udf(_TAGGED)
def question_tags(values: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("text", pa.string()), ("tag", pa.string())]))
    return pa.array([None if q is None else [{"text": t.text, "tag": t.tag} for t in tag_tokens(q)] for q in values.to_pylist()], kind)


@F.arrow_udf(_SEGMENTS)
def question_segments(values: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))
    return pa.array([None if q is None else [{"kind": k, "text": x} for k, x in segments(q)] for q in values.to_pylist()], kind)


@F.arrow_udf(T.StringType())
def repaired_questions(questions: pa.Array, names: pa.Array) -> pa.Array:
    """:func:`repaired` over Arrow batches, each question with the names of its schema; null stays null."""
    return pa.array([None if q is None else repaired(q, [n for n in ns or () if n]) for q, ns in zip(questions.to_pylist(), names.to_pylist())], pa.string())


@F.arrow_udf(T.StringType())
def stripped_values(values: pa.Array) -> pa.Array:
    return pa.array([None if s is None else without_values(s) for s in values.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def filled_values(queries: pa.Array, questions: pa.Array) -> pa.Array:
    return pa.array([None if s is None or q is None else filled(s, q) for s, q in zip(queries.to_pylist(), questions.to_pylist())], pa.string())


def pattern_counts(patterns: list[str]):
    """A column function: how often each pattern stands in a question, whose tokens are tagged once."""

    def run(questions: pa.Array) -> pa.Array:
        out = []
        for q in questions.to_pylist():
            tokens = None if q is None else tag_tokens(q)
            out.append(None if tokens is None else [len(find_pattern(p, tokens)) for p in patterns])
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, T.ArrayType(T.IntegerType()))


__all__ = ["Token", "filled", "filled_values", "find_pattern", "pattern_counts", "question_segments", "question_tags", "repaired", "repaired_questions", "segments", "stripped_values", "tag_tokens", "without_values"]
