"""The names of a catalog as words, and the words of a question as mentions of them.

Mentions are looked for tier by tier, and of each run of words the first tier that has any decides: the name as it stands, its base
forms (two words also swapped), a table's name followed by one of its columns, one of its words or most of them, its stems, its spelling
as one word. Longer mentions win over those inside them. Candidates are then thinned out by what else the question speaks of.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

from askweave.functions.question import STOP_WORDS, is_number
from askweave.functions.tokens import LEMMA, STEM, TEXT, Token, Tokens
from askweave.functions.words import AGGREGATES, RELATED, aliases, degree, direction, lemma, stem
from askweave.sources.catalog import Catalog

EXACT, BASE, OWNED, PART, STEMS, COMPOUND = range(6)
TIERS = ("exact", "base", "owned", "part", "stem", "compound")
#: Columns that a question names in passing: a part of such a name alone is no mention.
COMMON = frozenset("name id type code rate time date number".split())


class Mention(NamedTuple):
    """Tokens ``start`` to ``end`` (exclusive) speak of a column, or of a table where ``column`` is empty."""

    start: int
    end: int
    table: str
    column: str
    tier: int

    @property
    def size(self) -> int:
        return self.end - self.start


def name_words(name: str) -> Tokens:
    """Words of an identifier or of a name in words."""
    return Tokens.words(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).replace("_", " ").lower())


class SchemaWords:
    """Tables and columns of a catalog by their words, base forms and stems."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.tables = {t: name_words(catalog.words.get(t, t)) for t in catalog.tables}
        self.columns = {(t, c): name_words(catalog.words.get(f"{t}.{c}", c)) for t, cs in catalog.tables.items() for c in cs}

    @cached_property
    def _index(self) -> tuple[dict[str, set[int]], ...]:
        """Numbers of names (tables first, then columns, in their order) by what of them may stand in a question: first word's text, any base form, first stem, spelling as one word; and those without words."""
        texts, lemmas, stems, joined, bare = {}, {}, {}, {}, {}
        for n, (key, name) in enumerate([*self.tables.items(), *self.columns.items()]):
            if not name:
                bare.setdefault("", set()).add(n)
            else:
                texts.setdefault(name[0].text, set()).add(n)
                stems.setdefault(stem(name[0].text), set()).add(n)
            for x in name.keys(LEMMA):
                lemmas.setdefault(x, set()).add(n)
            for x in (*self._compounds(name), *([name[0].text] if len(name) == 1 else []), *([key[1]] if n >= len(self.tables) else [])):
                joined.setdefault(x, set()).add(n)
        return texts, lemmas, stems, joined, bare

    def _near(self, tokens: Tokens) -> tuple[list[str], dict[str, list[tuple[str, str]]]]:
        """Tables, and columns by table, that may be mentioned: the others have no word of the question in any form."""
        texts, lemmas, stems, joined, bare = self._index
        low, base = tokens.keys(TEXT), tokens.keys(LEMMA)
        own = set(bare.get("", ()))
        for index, keys in ((texts, low), (joined, low), (lemmas, base), (stems, tokens.keys(STEM))):
            for x in keys:
                if x in index:
                    own |= index[x]
        for keys in (low, base):
            for x, y in zip(keys, keys[1:]):
                if x + y in joined:
                    own |= joined[x + y]
        tables, columns = self._numbered
        named, held = [], {}
        for n in sorted(own):
            if n < len(tables):
                named.append(tables[n])
            else:
                held.setdefault(columns[n - len(tables)][0], []).append(columns[n - len(tables)])
        return named, held

    @cached_property
    def _numbered(self) -> tuple[list[str], list[tuple[str, str]]]:
        return [*self.tables], [*self.columns]

    @cached_property
    def _by_table(self) -> dict[str, dict[tuple[str, str], Tokens]]:
        out: dict[str, dict[tuple[str, str], Tokens]] = {}
        for k, x in self.columns.items():
            out.setdefault(k[0], {})[k] = x
        return out

    @cached_property
    def spelling(self) -> Spelling:
        return Spelling([*self.tables.values(), *self.columns.values()])

    @cached_property
    def longest(self) -> int:
        return max((len(x) for x in (*self.tables.values(), *self.columns.values())), default=1)

    def of(self, table: str | None) -> dict[tuple[str, str], Tokens]:
        return self.columns if table is None else self._by_table.get(table, {})

    # -- single words and phrases --------------------------------------------------------------------------------

    def containing(self, word: str, table: str | None = None) -> list[tuple[str, str]]:
        """Columns that have a word, in its base form."""
        return [k for k, x in self.of(table).items() if lemma(word) in (t.lemma for t in x)]

    def related(self, word: str) -> list[str]:
        """Words that stand for another: names of one country, words of a kind of time."""
        return [*aliases(word), *RELATED.get(word.upper(), ())]

    def containing_related(self, word: str, table: str | None = None) -> list[tuple[str, str]]:
        return [k for r in self.related(word) for k in self.containing(r, table)]

    def equal(self, phrase: Tokens, table: str | None = None) -> tuple[int, list[tuple[str, str]]]:
        """Columns whose whole name is the phrase, with the tier that found them: text, base forms (two words in either order), stems."""
        for tier, by in ((EXACT, TEXT), (BASE, LEMMA), (STEMS, STEM)):
            hits = [k for k, x in self.of(table).items() if len(x) == len(phrase) and (x.match_at(0, phrase, by) or tier == BASE and len(x) == 2 and Tokens((x[1], x[0])).match_at(0, phrase, by))]
            if hits:
                return tier, hits
        return -1, []

    def most_of(self, phrase: Tokens, table: str | None = None) -> list[tuple[str, str]]:
        """The columns with most of the phrase's words, where more than half are there and one column has the most."""
        own = {t.lemma for t in phrase.without_stop_words()}
        scores = {k: len(own & {t.lemma for t in x}) for k, x in self.of(table).items()}
        best = max(scores.values(), default=0)
        hits = [k for k, n in scores.items() if n == best]
        return hits if best and 2 * best > len(own) and len(hits) == 1 else []

    def without_aggregate(self, phrase: Tokens, table: str | None = None) -> tuple[str, list[tuple[str, str]]]:
        """An aggregate word of the phrase and the columns that the rest names; the rest may go without its ``of``."""
        word = next((t for t in phrase if t.lemma in AGGREGATES), None)
        if word is None:
            return "", []
        rest = Tokens(t for t in phrase if t is not word and t.lemma != "of")
        return AGGREGATES[word.lemma], self.equal(rest, table)[1] or self.most_of(rest, table)

    def resolve(self, phrase: Tokens, tables: list[str], elsewhere: bool = True) -> list[tuple[str, str]]:
        """Columns that a phrase names, first among the given tables, then (if wished) anywhere; the first tier with any decides."""
        for scope in (*tables, *([None] if elsewhere else [])):
            for hits in (self.equal(phrase, scope)[1], self.containing(phrase[0].text, scope) if len(phrase) == 1 else [], self.most_of(phrase, scope), self.without_aggregate(phrase, scope)[1], self.containing_related(phrase.text(), scope)):
                if hits:
                    return hits
        return []

    def table_of(self, phrase: Tokens) -> list[str]:
        """Tables that a phrase names: by text, base forms, or the most shared words if one table has the most."""
        for by in (TEXT, LEMMA, STEM):
            hits = [t for t, x in self.tables.items() if len(x) == len(phrase) and x.match_at(0, phrase, by)]
            if hits:
                return hits
        own = {t.lemma for t in phrase.without_stop_words()}
        scores = {t: len(own & {w.lemma for w in x}) for t, x in self.tables.items()}
        best = max(scores.values(), default=0)
        hits = [t for t, n in scores.items() if n == best]
        return hits if best and len(hits) == 1 else []

    def by_adjective(self, adjective: str, tables: list[str]) -> list[tuple[tuple[str, str], int]]:
        """Columns that an adjective speaks of, with its direction; those of the given tables where they have any."""
        hits = [(k, d) for k, x in self.columns.items() if (d := direction(adjective, [t.text for t in x]))]
        return [h for h in hits if h[0][0] in tables] or hits

    def shared_noun(self, names: list[str]) -> list[str]:
        """A list of aggregates whose last one has the noun of all, each with that noun: "max and min age" is "max age", "min age"."""
        last = names[-1].split() if names else []
        noun = " ".join(last[1:]) if len(last) > 1 and last[0] in AGGREGATES else ""
        return [f"{n} {noun}" if noun and n in AGGREGATES else n for n in names]

    # -- mentions in a question ------------------------------------------------------------------------------------

    def _found(self, tokens: Tokens, name: Tokens) -> tuple[int, list[tuple[int, int]]]:
        """The tier at which a whole name stands in the tokens, and where."""
        n = len(name)
        if not n:
            return EXACT, [(i, i) for i in range(len(tokens) + 1)]
        for tier, at, held, own in zip((EXACT, BASE, STEMS), tokens.places, tokens.forms, name.forms):
            if tier == STEMS and n == 1 and len(name[0].text) < 4:
                continue
            places = [(i, i + n) for i in at.get(own[0], ()) if n == 1 or held[i : i + n] == own]
            if tier == BASE and n == 2:
                places += [(i, i + 2) for i in at.get(own[1], ()) if held[i : i + 2] == own[::-1]]
            if n == 1:
                places = [(a, z) for a, z in places if not self._passing(tokens, a, z)]
            if places:
                return tier, places
        return -1, []

    @staticmethod
    def _passing(tokens: Tokens, a: int, z: int) -> bool:
        """Words that only look like a name: a verb at the beginning ("name the ..."), or an adjective's comparative before ``than``."""
        return z - a == 1 and (a == 0 and len(tokens) > 1 and tokens[1].text.lower() in ("the", "all", "every") or z < len(tokens) and degree(tokens[a].text) is not None and tokens[z].lemma == "than")

    @staticmethod
    def _compounds(name: Tokens) -> list[str]:
        """Spellings of a name as one word: run together, or with its first word as a letter."""
        words = [t.text for t in name]
        return ["".join(words), words[0][0] + "".join(words[1:])] if len(words) > 1 else []

    def _column(self, table: str, column: str) -> tuple[set[str], set[str]]:
        """Spellings of a column as one word, and the words that are a part of its name; made once."""
        held = self._columns.get((table, column))
        if held is None:
            name = self.columns[table, column]
            own = {x for x in name.keys(LEMMA) if len(x) > 2} - COMMON - STOP_WORDS - set(self.tables[table].keys(LEMMA)) if len(name) > 1 else set()
            held = self._columns[table, column] = {*self._compounds(name), column}, own
        return held

    @cached_property
    def _columns(self) -> dict[tuple[str, str], tuple[set[str], set[str]]]:
        return {}

    @cached_property
    def _single(self) -> dict[str, set[str]]:
        """Base forms of the columns of one word, by table."""
        out: dict[str, set[str]] = {}
        for (t, _), x in self.columns.items():
            if len(x) == 1:
                out.setdefault(t, set()).add(x[0].lemma)
        return out

    @staticmethod
    def _apart(tokens: Tokens, name: Tokens) -> list[tuple[int, int]]:
        """Where two words together are a name of one word."""
        if len(name) != 1:
            return []
        word, low, base = name[0].text, tokens.keys(TEXT), tokens.keys(LEMMA)
        return [(i, i + 2) for i in range(len(tokens) - 1) if word in (low[i] + low[i + 1], base[i] + base[i + 1])]

    def table_mentions(self, tokens: Tokens, among: list[str] | None = None) -> list[Mention]:
        """Mentions of tables, of those given if any are."""
        out = []
        for t in self.tables if among is None else among:
            name = self.tables[t]
            tier, places = self._found(tokens, name)
            out += [Mention(a, z, t, "", tier) for a, z in places]
            if not places:
                out += [Mention(a, z, t, "", COMPOUND) for a, z in self._apart(tokens, name)]
                out += [Mention(i, i + 1, t, "", COMPOUND) for x in self._compounds(name) if x in tokens.places[TEXT] for i in tokens.places[TEXT][x]]
            if len(name) == 1:  # "singer name": the table followed by one of its columns
                base, single = tokens.keys(LEMMA), self._single.get(t, ())
                out += [Mention(i, i + 1, t, "", OWNED) for i in tokens.places[LEMMA].get(name[0].lemma, ()) if i + 1 < len(base) and base[i + 1] in single]
            elif not places:
                out += [Mention(i, i + 1, t, "", PART) for i, x in tokens.untagged if len(x) > 3 and x not in STOP_WORDS and x in name.keys(LEMMA)]
        return self._kept(out)

    def column_mentions(self, tokens: Tokens, table: str, exact_only: bool = False, among: list[tuple[str, str]] | None = None) -> list[Mention]:
        """Mentions of columns of a table, of those given if any are."""
        out = []
        for t, c in self.of(table) if among is None else among:
            name = self.columns[t, c]
            tier, places = self._found(tokens, name)
            out += [Mention(a, z, t, c, tier) for a, z in places]
            if places or exact_only:
                continue
            compounds, own = self._column(t, c)
            out += [Mention(i, i + 1, t, c, COMPOUND) for x in compounds if x in tokens.places[TEXT] for i in tokens.places[TEXT][x]]
            out += [Mention(a, z, t, c, COMPOUND) for a, z in self._apart(tokens, name)]
            out += [Mention(i, i + 1, t, c, PART) for i, x in tokens.untagged if x in own]
        return self._kept(out)

    @staticmethod
    def _kept(mentions: list[Mention]) -> list[Mention]:
        """Of overlapping mentions of one table (or of a column of it) the longer, then those of the better tier."""
        if len(mentions) < 2:
            return mentions
        out: list[Mention] = []
        for m in sorted(dict.fromkeys(mentions), key=lambda m: (-m.size, m.tier, m.start)):
            if not any(o.table == m.table and bool(o.column) == bool(m.column) and o.start < m.end and m.start < o.end and (o.size > m.size or o.tier < m.tier) for o in out):
                out.append(m)
        return sorted(out, key=lambda m: (m.start, -m.size, m.tier, m.table, m.column))

    def mentions(self, tokens: Tokens) -> list[Mention]:
        """Tables and columns that a question speaks of, thinned out."""
        named, held = self._near(tokens)
        tables = self.table_mentions(tokens, named)
        columns = [m for t in held for m in self.column_mentions(tokens, t, among=held[t])]
        return self.cleaned(tokens, [*tables, *columns])

    def cleaned(self, tokens: Tokens, found: list[Mention]) -> list[Mention]:
        """Without quoted text and numbers; of a run of words that several tables or columns claim only the best supported.

        A whole name wins over a part. Where columns of several tables fit, those of tables that the question names by themselves stay,
        if there are any; of tables with a part of their name only those stay that have no rival with a whole one.
        """
        barred = [t.tag in ("DB", "DATE") or is_number(t.text) for t in tokens]
        found = [m for m in found if not any(barred[m.start : m.end])]
        named = {m.table for m in found if not m.column and m.tier <= OWNED}
        out = []
        for m in found:
            rivals = [o for o in found if o.start < m.end and m.start < o.end and (not o.column) == (not m.column) and o != m]
            if any((o.tier in (PART, COMPOUND, STEMS)) < (m.tier in (PART, COMPOUND, STEMS)) and o.size >= m.size or o.size > m.size for o in rivals):
                continue
            if m.column and m.table not in named and any(o.table in named for o in rivals):
                continue
            # A column is no rival of a table named by the same word, unless all it has is a part of its name.
            if m.column and m.tier == PART and any(not o.column and o.tier <= BASE and o.start <= m.start < o.end for o in found):
                continue
            if not m.column and m.tier == PART and any(o.column and o.tier <= BASE and o.start <= m.start < o.end for o in found):
                continue
            out.append(m)
        return sorted(out, key=lambda m: (m.start, -m.size, bool(m.column), m.tier, m.table, m.column))

    def of_structure(self, tokens: Tokens, mentions: list[Mention]) -> list[Mention]:
        """``X and Y of Z``: columns X and Y that several tables have are those of the table Z that follows."""
        out = []
        for m in mentions:
            if m.column and any(o.column and o.start == m.start and o.table != m.table for o in mentions):
                after = [o for o in mentions if not o.column and o.start > m.end and any(tokens[i].lemma == "of" for i in range(m.end, o.start)) and not any(tokens[i].tag == "PUNCT" for i in range(m.end, o.start))]
                if after and m.table != after[0].table and any(o.column and o.start == m.start and o.table == after[0].table for o in mentions):
                    continue
            out.append(m)
        return out

    # -- tables of a part of a question ------------------------------------------------------------------------------

    def tables_of(self, mentions: list[Mention], least_columns: int = 2) -> list[str]:
        """Tables named, and tables with so many columns named (or all of them)."""
        named = [m.table for m in mentions if not m.column]
        counted: dict[str, set[str]] = {}
        for m in mentions:
            if m.column:
                counted.setdefault(m.table, set()).add(m.column)
        return [*dict.fromkeys([*named, *(t for t, cs in counted.items() if len(cs) >= min(least_columns, len(self.catalog.tables[t])))])]

    def tables_near(self, parts: list[list[Mention]], at: int) -> list[str]:
        """Tables of a part, or of the nearest part that has any; of two equally near ones the one before."""
        order = sorted(range(len(parts)), key=lambda i: (abs(i - at), i))
        return next((ts for i in order if (ts := self.tables_of(parts[i]))), [])

    def columns_from_tables(self, mentions: list[Mention]) -> str | None:
        """The one table that has all columns named; None where no table or several have them."""
        names = {m.column for m in mentions if m.column}
        homes = [t for t in self.tables if names and all(c in self.catalog.tables[t] for c in names)]
        return homes[0] if len(homes) == 1 else None


def spelled_like(tokens: Tokens, names: list[Tokens]) -> Tokens:
    """Words one letter away from a word of the schema, spelt like it: those after a select verb or ``the`` and without a tag."""
    return Spelling(names).of(tokens)


class Spelling:
    """The words of a schema, to which misspelt ones are mended."""

    def __init__(self, names: list[Tokens]):
        self.known = {t.text for n in names for t in n}
        self.by_letter: dict[str, list[str]] = {}
        self.held: dict[Token, Token] = {}
        for k in sorted(k for k in self.known if len(k) >= 5):
            self.by_letter.setdefault(k[0], []).append(k)

    @staticmethod
    def _near(a: str, b: str) -> bool:
        if abs(len(a) - len(b)) > 1 or a[0] != b[0]:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]

    def _candidates(self, w: str, base: str) -> Iterator[str]:
        """Words with the first letter of either, in their order."""
        for letter in sorted({w[0], base[0]}):
            yield from self.by_letter.get(letter, ())

    def _mended(self, t: Token) -> Token:
        w = t.text.lower()
        if t.tag or len(w) < 5 or w in self.known or t.lemma in self.known:
            return t
        hit = next((k + (w[len(t.lemma) :] if not self._near(w, k) and w.startswith(t.lemma) else "") for k in self._candidates(w, t.lemma) if self._near(w, k) or self._near(t.lemma, k)), None)
        return t if hit is None else t._replace(text=hit, lemma=lemma(hit))

    def of(self, tokens: Tokens) -> Tokens:
        if len(self.held) > 20_000:
            self.held.clear()
        mended = [self.held[t] if t in self.held else self.held.setdefault(t, self._mended(t)) for t in tokens]
        changed = [i for i, (t, m) in enumerate(zip(tokens, mended)) if m != t and not tokens.in_quotes(i)]
        return Tokens(mended[i] if i in changed else t for i, t in enumerate(tokens)) if changed else tokens


def suffix_toggled(word: str) -> list[str]:
    """A word with and without the endings -ment and -ship."""
    return [word[:-4]] if word.endswith(("ment", "ship")) else [word + "ment", word + "ship"]


__all__ = ["Mention", "SchemaWords", "TIERS", "name_words", "spelled_like", "stem", "suffix_toggled"]
