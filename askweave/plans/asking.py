"""A question in words to a shorthand: lexical links, clause flags and literals, by rules over the catalog.

The rules know tables and columns by their words, values, quoted or not, by a look-up of the question's word runs in the text columns, and a
lexicon of function words for aggregates, comparisons, order, grouping and negation. It is approximate by design: what a question leaves
open, the catalog's order settles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askweave.operators.linking import STOP_WORDS
from askweave.plans.engine import Engine
from askweave.plans.inference import Options
from askweave.sources.catalog import Catalog, catalog_type

#: Words of aggregates, comparisons, directions, grouping, negation and numbers.
AGGREGATES = {"average": "avg", "mean": "avg", "avg": "avg", "maximum": "max", "max": "max", "minimum": "min", "min": "min", "total": "sum", "sum": "sum", "number": "count"}
GREATER = ("more than", "greater than", "larger than", "higher than", "over", "above", "exceeding", "after")
AT_LEAST = ("at least", "no less than", "not less than")
SMALLER = ("less than", "fewer than", "smaller than", "lower than", "under", "below", "before")
AT_MOST = ("at most", "no more than", "not more than")
HIGHEST = ("highest", "largest", "most", "biggest", "greatest", "top", "maximum", "latest", "most expensive")
LOWEST = ("lowest", "smallest", "least", "fewest", "cheapest", "minimum", "earliest")
GROUPING = ("each", "every", "per", "by")
NEGATIONS = ("no", "without", "never", "not")
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
#: Words by which the star schema's columns go, besides their names.
STAR_WORDS = {
    "account balance": ["c_acctbal", "s_acctbal"], "balance": ["c_acctbal", "s_acctbal"], "market segment": ["c_mktsegment"], "segment": ["c_mktsegment"],
    "name": ["r_name", "n_name", "c_name", "s_name", "p_name"], "brand": ["p_brand"], "type": ["p_type"], "size": ["p_size"], "retail price": ["p_retailprice"],
    "order status": ["o_orderstatus"], "status": ["o_orderstatus", "l_linestatus"], "total price": ["o_totalprice"], "order priority": ["o_orderpriority"], "priority": ["o_orderpriority"], "order date": ["o_orderdate"],
    "quantity": ["l_quantity"], "extended price": ["l_extendedprice"], "discount": ["l_discount"], "tax": ["l_tax"], "return flag": ["l_returnflag"], "line status": ["l_linestatus"], "ship date": ["l_shipdate"],
}
STAR_TABLES = {"line item": "lineitem", "order": "orders", "event": "events"}


#: Values and their columns, by the words they are said in.
Known = dict[str, tuple[str, list[tuple[str, str]]]]


@dataclass
class Link:
    """A run of words [start, end) and what it stands for: table, column, value or number."""

    start: int
    end: int
    kind: str
    what: object


@dataclass
class Reading:
    tokens: list[str]
    links: list[Link] = field(default_factory=list)

    def of(self, kind: str) -> list[Link]:
        return [x for x in self.links if x.kind == kind]


def _singular(word: str) -> str:
    return word[:-3] + "y" if word.endswith("ies") else word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def tokenize(question: str) -> list[str]:
    """Words, numbers and quoted texts; quoted texts keep their quotes and case."""
    return [t if t[0] in "'\"" else t.lower() for t in re.findall(r"'[^']*'|\"[^\"]*\"|\d+(?:\.\d+)?|[^\W\d_]+", question)]


def _names(catalog: Catalog) -> dict[str, tuple[str, object]]:
    """Words, plural endings aside, and the table or the columns that go by them; made once a catalog."""
    names: dict[str, tuple[str, object]] = {}
    for t in catalog.tables:
        names[_singular(t)] = ("table", t)
    names |= {w: ("table", t) for w, t in STAR_TABLES.items() if t in catalog.tables}
    for t, cs in catalog.tables.items():
        for c in cs:
            owners = names.setdefault(catalog.words.get(f"{t}.{c}", c).replace("_", " "), ("column", []))
            if owners[0] == "column":
                owners[1].append((t, c))
    for w, cs in STAR_WORDS.items():
        own = [(t, c) for c in cs for t in catalog.tables if c in catalog.tables[t]]
        if own:
            names[w] = ("column", own)
    return {" ".join(map(_singular, w.split())): what for w, what in names.items()}


def known_values(links: Iterable[tuple[str, str, str]]) -> Known:
    """Values (``cell_value``, ``table_name``, ``column_name``) by their words; numbers and stop words are none. Of equal ones the first."""
    known: Known = {}
    for value, t, c in sorted(links):
        run = " ".join(tokenize(value.replace("'", " ").replace('"', " ")))
        if run and run not in STOP_WORDS and not re.fullmatch(r"[\d. ]+", run) and known.setdefault(run, (value, []))[0] == value:
            known[run][1].append((t, c))
    return known


def link(catalog: Catalog, question: str, find: Callable[[str], list[tuple[str, str]]], known: Known | None = None) -> Reading:
    """Longest links first; a word belongs to one link. ``find`` gives the columns that hold a quoted text, ``known`` the values that may stand without quotes."""
    known = known or {}
    tokens = tokenize(question)
    out, taken = Reading(tokens), set()
    names = catalog.__dict__.get("_names") or catalog.__dict__.setdefault("_names", _names(catalog))
    for value in (t[1:-1] for t in tokens if t[0] in "'\""):
        place = tokens.index(next(t for t in tokens if t[0] in "'\"" and t[1:-1] == value))
        out.links.append(Link(place, place + 1, "value", (value, find(value))))
        taken.add(place)
    for size in range(max(4, *(k.count(" ") + 1 for k in known), 0), 0, -1):
        for i in range(len(tokens) - size + 1):
            if any(k in taken for k in range(i, i + size)):
                continue
            run = [_singular(t) for t in tokens[i : i + size]]
            if " ".join(run) in names:
                kind, what = names[" ".join(run)]
                out.links.append(Link(i, i + size, kind, what))
                taken.update(range(i, i + size))
            elif " ".join(tokens[i : i + size]) in known:
                out.links.append(Link(i, i + size, "value", known[" ".join(tokens[i : i + size])]))
                taken.update(range(i, i + size))
    for i, t in enumerate(tokens):
        if i not in taken and re.fullmatch(r"\d+(\.\d+)?", t):
            out.links.append(Link(i, i + 1, "number", float(t) if "." in t else int(t)))
        elif i not in taken and t in NUMBER_WORDS:
            out.links.append(Link(i, i + 1, "number", NUMBER_WORDS[t]))
    out.links.sort(key=lambda x: x.start)
    return out


def find_value(engine: Engine, value: str) -> list[tuple[str, str]]:
    """The text columns that hold a value, letter case aside. Each table is scanned once, whatever the number of its columns, and gives one row."""
    parts = []
    for t, cs in engine.catalog.tables.items():
        own = [c for c, kind in cs.items() if catalog_type(kind) == "text"]
        if own:
            found = engine.table(t).agg(*(F.bool_or(F.lower(F.col(c)) == value.lower()).alias(c) for c in own))
            parts.append(found.select(F.lit(t).alias("t"), F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in own))).alias("cs")))
    return [(r["t"], c) for r in reduce(DataFrame.unionByName, parts).collect() for c in r["cs"]] if parts else []


def find_known(engine: Engine, question: str) -> Known:
    """The values of text columns whose words stand in the question without quotes; distinct values are compared, so every text column is scanned once."""
    tokens = tokenize(question)
    names = _names(engine.catalog)
    runs = {" ".join(tokens[i : i + n]) for n in range(1, len(tokens) + 1) for i in range(len(tokens) - n + 1) if not any(t[0] in "'\"" for t in tokens[i : i + n])}
    runs = sorted(r for r in runs if not set(r.split()) <= STOP_WORDS and " ".join(map(_singular, r.split())) not in names and not re.fullmatch(r"[\d. ]+", r))
    parts = []
    for t, cs in engine.catalog.tables.items():
        own = [c for c, kind in cs.items() if catalog_type(kind) == "text"]
        if own and runs:
            cells = engine.table(t).select(F.explode(F.array(*(F.struct(F.col(c).alias("v"), F.lit(t).alias("t"), F.lit(c).alias("c")) for c in own))).alias("x"))
            said = F.array_join(F.regexp_extract_all(F.lower("v"), F.lit(r"(\d+(?:\.\d+)?|\p{L}+)"), 1), " ")
            parts.append(cells.select("x.*").distinct().filter(said.isin(runs)))
    return known_values(tuple(r) for r in reduce(DataFrame.unionByName, parts).collect()) if parts else {}


class Reader:
    """One question over one catalog: links first, then conditions in their order, then what is shown."""

    def __init__(self, catalog: Catalog, question: str, find: Callable[[str], list[tuple[str, str]]], known: Known | None = None):
        self.catalog, self.r = catalog, link(catalog, question, find, known)
        self.tables, self.columns, self.numbers, self.values = (self.r.of(k) for k in ("table", "column", "number", "value"))
        if not self.tables and not self.columns:
            raise ValueError("the question names no table and no column")
        self.named = [x.what for x in self.tables]
        self.used: set[int] = set()
        #: Place in the question, and condition.
        self.conditions: list[tuple[int, str]] = []

    # -- words ---------------------------------------------------------------------------------------------------

    def said(self, start: int, end: int) -> str:
        return " " + " ".join(self.r.tokens[max(0, start) : max(0, end)]) + " "

    def before(self, x: Link, phrases, reach: int = 3) -> bool:
        near = self.said(x.start - reach, x.start)
        return any(f" {p} " in near for p in phrases)

    def column(self, x: Link) -> tuple[str, str]:
        """Of several columns that of the table named nearest (one that follows wins a tie), else the first."""
        near = sorted((t for t in self.tables if id(t) not in self.used), key=lambda t: (min(abs(t.start - x.end), abs(x.start - t.end)), t.start < x.start))
        for t in near:
            for own, c in x.what:
                if own == t.what:
                    return own, c
        return x.what[0]

    def of_table(self, x: Link, table: str) -> tuple[str, str]:
        return next(((t, c) for t, c in x.what if t == table), self.column(x))

    # -- conditions ----------------------------------------------------------------------------------------------

    def add(self, x: Link, where: str, *spent: Link) -> None:
        self.conditions.append((min(x.start, *(s.start for s in spent)) if spent else x.start, where))
        self.used |= {id(x), *map(id, spent)}

    def owner(self, x: Link) -> tuple[str, str]:
        """The column of a condition: of the table named right before it where a negated table or a ``when that`` sets the scope."""
        scope = next((t for t in reversed(self.tables) if t.end <= x.start and (id(t) in self.negated or self.before(t, ("that", "its"), 2))), None)
        return self.of_table(x, scope.what) if scope else self.column(x)

    def read_conditions(self) -> None:
        self.negated = {id(t): t for t in self.tables[1:] if self.before(t, NEGATIONS, 2)}
        for t in self.negated.values():
            self.add(t, f"@.@ not in {t.what}.*")
        for k, n in enumerate(self.numbers):
            if id(n) in self.used:
                continue
            target = next((x for x in reversed(self.columns) if x.end <= n.start and id(x) not in self.used), None)
            counted = next((t for t in self.tables if 0 <= t.start - n.end <= 1), None)
            if self.before(n, ("between",), 1) and k + 1 < len(self.numbers) and target:
                self.add(target, "{}.{} between {} and {}".format(*self.owner(target), n.what, self.numbers[k + 1].what), n, self.numbers[k + 1])
                continue
            op = ">=" if self.before(n, AT_LEAST) else "<=" if self.before(n, AT_MOST) else ">" if self.before(n, GREATER) else "<" if self.before(n, SMALLER) else None
            if op and counted and (len(self.named) > 1 or " shared by " in self.said(0, n.start)):
                self.add(n, f"count ( {counted.what}.* ) {op} {n.what}", *([counted] if len(self.named) > 1 else []))
            elif op and target and n.start - target.end <= 4:
                self.add(target, "{}.{} {} {}".format(*self.owner(target), op, n.what), n)
            elif target and target.end == n.start:
                self.add(target, "{}.{} = {}".format(*self.owner(target), n.what), n)
        for v in self.values:
            value, homes = v.what
            text = value.replace("'", "''")
            after = next((x for x in self.columns if 0 < x.start - v.end <= 2 and id(x) not in self.used and " in " in self.said(v.end, x.start)), None)
            if after:
                self.add(v, "{}.{} like '%{}%'".format(*self.owner(after), text), after)
                continue
            target = next((x for x in reversed(self.columns) if x.end <= v.start and v.start - x.end <= 3 and id(x) not in self.used), None)
            # What is quoted is in the column named before it, in other cells than the known ones perhaps; a bare run is a value only where it is known.
            if target and self.r.tokens[v.start][0] not in "'\"" and self.owner(target) not in homes:
                target = None
            home = self.owner(target) if target else next((h for h in homes if h[0] in self.named), homes[0] if homes else None)
            if home:
                other = " other than " in self.said(v.start - 3, v.start) or " not " in self.said(v.start - 2, v.start)
                self.add(v, f"{home[0]}.{home[1]} {'!=' if other else '='} '{text}'", *([target] if target else []))

    def chained(self) -> str:
        """The conditions in their order, each with the connector that the words before it ask for."""
        out, end = "", 0
        for k, (start, where) in enumerate(sorted(self.conditions)):
            words = self.said(end, start)
            link_ = "and"
            if k and " but not " in words:
                link_ = "except_"
            elif k and " and also " in words:
                link_ = "intersect_"
            elif k and " or " in words:
                link_ = "union_" if " or with " in words + self.said(start, start + 1) else "or"
            out += f" {link_} {where}" if out else where
            end = start
        return out

    # -- what is shown -------------------------------------------------------------------------------------------

    def label(self, t: str) -> str:
        return next((f"{t}.{c}" for c in self.catalog.tables[t] if c.endswith("name")), f"{t}.{self.catalog.primary.get(t, next(iter(self.catalog.tables[t])))}")

    def aggregates(self, x: Link) -> list[str]:
        """The aggregates named in a row before a column: ``the average and the highest``."""
        out, at = [], x.start - 1
        while at >= 0 and (self.r.tokens[at] in ("the", "and", "a") or self.r.tokens[at] in AGGREGATES or self.r.tokens[at] in (*HIGHEST, *LOWEST)):
            w = self.r.tokens[at]
            func = AGGREGATES.get(w) or ("max" if w in HIGHEST else "min" if w in LOWEST else None)
            if func and func != "count":
                out.insert(0, func)
            at -= 1
        return out

    def text(self) -> tuple[str, Options]:
        self.read_conditions()
        said = self.said(0, len(self.r.tokens))
        counts = any(f" {p} " in said for p in ("how many", "number of", "count of", "the count"))
        free = [x for x in self.columns if id(x) not in self.used]
        head = self.tables[0].what if self.tables else self.column(free[0])[0]
        group = next((x for x in (*self.tables, *free) if self.before(x, GROUPING, 2) and id(x) not in self.used), None)
        shared = next((x for x in free if " shared by " in self.said(x.end, x.end + 2)), None)
        if shared is not None:
            group = shared
        top = next((n for n in self.numbers if self.before(n, ("top", "first"), 1)), None)
        select, grouping, order, aggregated = [], "", "", False
        if group is not None and (shared is not None or counts or any(self.aggregates(x) for x in free)):
            key = self.label(group.what) if group.kind == "table" else "{}.{}".format(*self.column(group))
            grouping = f" group by {key}"
            select.append(key)
            free = [x for x in free if x is not group]
        for x in free:
            t, c = self.column(x)
            funcs = self.aggregates(x)
            ranked = self.before(x, HIGHEST, 2) or self.before(x, LOWEST, 2)
            spare = [n.what for n in self.numbers if id(n) not in self.used]
            if top is not None and self.before(x, ("by", "on"), 1):
                order = f" order by {t}.{c} desc limit {top.what}"
            elif ranked and len(funcs) == 1 and (self.before(x, ("with",), 4) or spare):
                order = f" order by {t}.{c} {'desc' if self.before(x, HIGHEST, 2) else 'asc'} limit {spare[0] if spare else 1}"
            elif funcs:
                select += [f"{f} ( {t}.{c} )" for f in funcs]
                aggregated = True
            elif f"{t}.{c}" not in select:
                select.append(f"{t}.{c}")
        if counts and not aggregated:
            what = next((t.what for t in self.tables if group is None or t is not group), head)
            select = [s for s in select if grouping and s in grouping] + [f"count ( {what}.* )"]
        if not select:
            select = [self.label(head)]
        distinct = "distinct " if any(f" {w} " in said for w in ("different", "distinct")) else ""
        where = self.chained()
        text = f"select {distinct}{' , '.join(select)} from {head}{' where ' + where if where else ''}{grouping}{order}"
        return text, Options(liked=frozenset(self.named))


def shorthand_of(catalog: Catalog, question: str, find: Callable[[str], list[tuple[str, str]]] = lambda _: [], known: Known | None = None) -> tuple[str, Options]:
    """The shorthand that a question stands for."""
    return Reader(catalog, question, find, known).text()


def ask(engine: Engine, question: str, names: list[str] | None = None) -> DataFrame:
    """The answer to a question."""
    text, options = shorthand_of(engine.catalog, question, lambda value: find_value(engine, value), find_known(engine, question))
    return engine.shorthand(text, names, options)
