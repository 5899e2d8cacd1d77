"""What the parts of a question say: projected items, conditions, grouping and order, as far as words and mentions tell."""

from __future__ import annotations

from dataclasses import dataclass, field

from askweave.functions.patterns import Annotated, directed
from askweave.functions.question import STOP_WORDS, to_number
from askweave.functions.schema_words import SchemaWords
from askweave.functions.segments import Part, parts_of, shapes
from askweave.functions.words import AGGREGATES, RELATED

Column = tuple[str, str]


@dataclass(frozen=True)
class Selected:
    """One projected item; an empty column counts rows of the table."""

    agg: str
    table: str
    column: str
    distinct: bool = False


@dataclass(frozen=True)
class Flags:
    """Of a condition part: whether it filters, orders and how, and the number it keeps."""

    where: bool = False
    order: bool = False
    descending: bool = False
    limit: int | None = None


@dataclass
class Reading:
    select: list[Selected] = field(default_factory=list)
    where: list[Column] = field(default_factory=list)
    group: list[Column] = field(default_factory=list)
    order: list[Column] = field(default_factory=list)
    flags: list[Flags] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)


def column_of(words: SchemaWords, table: str) -> Column:
    """What stands for a table as a whole: a column of names, else its key, else its first column."""
    own = words.of(table)
    named = next((k for k, x in own.items() if x[-1].lemma == "name"), None)
    key = words.catalog.primary.get(table)
    return named or ((table, key) if key else next(iter(own), (table, "")))


def linking_column(words: SchemaWords, table: str, other: str) -> Column | None:
    """The column of ``table`` in the foreign key that links it to another table."""
    hit = next(iter(words.catalog.edges(table, other)), None)
    return None if hit is None else ((table, hit[1]) if hit[0] == table else (table, hit[3]))


def same_columns(words: SchemaWords, column: Column) -> list[Column]:
    """Columns that hold the same things: the other ends of foreign keys."""
    return [x for f in words.catalog.foreign for x, y in ((f[:2], f[2:]), (f[2:], f[:2])) if y == column]


def _resolved(a: Annotated, words: SchemaWords, tables: list[str]) -> list[tuple[int, Column]]:
    """Columns of a part by place: of several candidates those of the tables in question, else of the table that has all columns named."""
    home = words.columns_from_tables(list(a.mentions))
    out: dict[int, Column] = {}
    for m in words.of_structure(a.tokens, list(a.mentions)):
        if not m.column:
            continue
        rank = (m.table not in tables, m.table != home, m.tier, tables.index(m.table) if m.table in tables else 0)
        if m.start not in out or rank < out[m.start][0]:
            out[m.start] = (rank, (m.table, m.column))
    return [(i, c) for i, (_, c) in sorted(out.items())]


def selected(a: Annotated, words: SchemaWords, tables: list[str]) -> list[Selected]:
    """Projected items: columns with the aggregate before them, or a count of a table; two opposite superlatives of a column are its max and min."""
    t, out = a.tokens, []
    low = [x.text.lower() for x in t]
    distinct = bool({"different", "distinct", "unique"} & set(low))
    columns = _resolved(a, words, tables)
    counted = next((i for i in range(len(t)) if low[i] == "many" and i and low[i - 1] == "how" or low[i] in ("number", "count")), None)
    ways = [w for w in directed(a) if w.endswith("JJS")]
    both = {w[:2] for w in ways} == {"GR", "SM"}
    for i, (table, column) in columns:
        before = max((j for j, _ in columns if j < i), default=-1)
        aggs = [AGGREGATES[t[j].lemma] for j in range(before + 1, i) if t[j].lemma in AGGREGATES and t[j].lemma not in ("number", "count")]
        if both or ways and aggs:
            aggs = [*aggs, *({"GR": "max", "SM": "min"}[w[:2]] for w in ways)]
        if not aggs and counted is not None and before < counted < i and not any(not m.column and counted < m.start < i for m in a.mentions):
            aggs = ["count"]
        items = [Selected(g, table, column, distinct and g in ("", "count")) for g in dict.fromkeys(aggs)] or [Selected("", table, column, distinct)]
        out += [x for x in items if x not in out]
    if counted is not None and not any(s.agg == "count" for s in out):
        table = next((m.table for m in a.mentions if not m.column and m.start > counted), tables[0] if tables else "")
        if table:
            out.insert(0, Selected("count", table, "", distinct))
    if not out:
        out = [Selected("", *column_of(words, m.table), distinct) for m in a.mentions if not m.column][:1]
    return out


#: Classes of what is to be met, and of what is even where a part orders.
_MET, _MET_IN_ORDER = frozenset("DB NUM DATE YEAR NOT".split()), frozenset("DB DATE YEAR NOT GR SM".split())


def flags_of(a: Annotated) -> Flags:
    """Order, limit, direction and filter of a part. ``first`` and ``top`` keep as many as the number beside them, a superlative one."""
    t = tuple(a.tokens)
    ways = [w for w in directed(a) if w.endswith("JJS")] if any(x.tag == "JJS" for x in t) else []
    top = next((i for i, x in enumerate(t) if x.lemma in ("top", "first", "last") and i + 1 < len(t)), None)
    number = next((int(to_number(t[i + 1].text)) for i in [top] if i is not None and t[i + 1].tag == "NUM"), None)
    sort = any(x.lemma in ("sort", "sorted", "order", "ordered", "ascending", "descending", "alphabetical") and not a.at(i) for i, x in enumerate(t))
    least_most = any(t[i].tag in ("GR", "SM") and i and t[i - 1].text.lower() == "at" for i in range(len(t)))
    superlative = bool(ways) and not least_most and {w[:2] for w in ways} != {"GR", "SM"}
    order = sort or superlative or number is not None
    descending = any(x.lemma == "descending" for x in t) or superlative and ways[0].startswith("GR") or number is not None and t[top].lemma != "last" and not any(x.lemma == "ascending" for x in t)
    claimed = frozenset().union(*map(a.classes, range(len(t))))
    where = not claimed.isdisjoint(_MET) and not (order and claimed.isdisjoint(_MET_IN_ORDER))
    return Flags(where, order, bool(order and descending), number if number is not None else 1 if superlative and not sort else None)


def first_and_last(a: Annotated, words: SchemaWords, column: Column) -> str:
    """What ``first`` or ``last`` before a column means: of times the earliest or latest, of others the first or last row; nothing without them."""
    said = next((x.lemma for x in a.tokens if x.lemma in ("first", "last")), "")
    kind = words.catalog.type_of(*column)
    timely = kind.startswith(("timestamp", "date")) or {x.lemma for x in words.columns.get(column, ())} & set(RELATED["DATE"])
    return {"first": "earliest", "last": "latest"}.get(said, "") if timely else said


def condition_columns(a: Annotated, words: SchemaWords, tables: list[str], stored: dict[int, list[Column]]) -> list[Column]:
    """Columns that a condition part speaks of: named ones, those of its values, those of its adjectives, the key of a table it names."""
    named = [c for _, c in _resolved(a, words, tables)]
    if named:
        return list(dict.fromkeys(named))
    held = [c for i in sorted(stored) for c in stored[i]]
    if held:
        mine = [c for c in held if c[0] in tables]
        return list(dict.fromkeys(mine or held))[:1]
    for x in a.tokens:
        if x.tag in ("JJS", "JJR", "GR", "SM") and (hits := words.by_adjective(x.lemma, tables)):
            return [hits[0][0]]
    for x in a.tokens:
        if x.tag in ("DATE", "YEAR") and (hits := [k for t in tables for k in words.containing_related(x.tag, t)] or words.containing_related(x.tag)):
            return [hits[0]]
    other = next((m.table for m in a.mentions if not m.column), None)
    if other is not None:
        home = next((t for t in tables if t != other and linking_column(words, t, other)), None)
        return [linking_column(words, home, other) if home else column_of(words, other)]
    return []


#: Flags by what the tokens of a part say; emptied when full.
_FLAGGED: dict[tuple[int, ...], Flags] = {}


def _flags(a: Annotated, p: Part, told: tuple[int, ...]) -> Flags:
    """:func:`flags_of` a part, once for all that say the same; superlatives and counted rows need the part itself."""
    flags = _FLAGGED.get(told)
    if flags is None:
        flags = flags_of(a.part(p.start, p.end))
        if not any(t.tag == "JJS" or t.lemma in ("top", "first", "last") for t in a.tokens[p.start : p.end]):
            if len(_FLAGGED) >= 50_000:
                _FLAGGED.clear()
            _FLAGGED[told] = flags
    return flags


#: What of a reading parts of a kind can give.
_SAID = {"select": ("flags", "select"), "group": ("flags", "group"), "order": ("flags", "order"), "condition": ("flags", "where", "order")}


def read(a: Annotated, words: SchemaWords, stored: dict[int, list[Column]] | None = None, said: frozenset[str] | None = None) -> tuple[list[Part], Reading]:
    """Parts of a question and what they say together. ``stored`` has the columns of the values at tokens.

    ``said`` names what of the reading is wished (``flags``, ``select``, ``where``, ``group``, ``order``), all by default; the rest of it is not whole then.
    """
    parts, out, stored = parts_of(a), Reading(), stored or {}
    told = shapes(a)
    if said == {"flags"}:
        out.flags = [_flags(a, p, told[p.start : p.end]) for p in parts]
        return parts, out
    mentions = [[m for m in a.mentions if p.start <= m.start and m.end <= p.end] for p in parts]
    out.tables = list(dict.fromkeys(t for ms in mentions for t in words.tables_of(ms)))
    for n, p in enumerate(parts):
        if said is not None and said.isdisjoint(_SAID.get(p.kind, _SAID["condition"])):
            continue
        flags = _flags(a, p, told[p.start : p.end])
        out.flags.append(flags)
        does = p.kind if p.kind in ("select", "group") else "order" if p.kind == "order" or flags.order and not flags.where else "where"
        if said is not None and does not in said:
            continue
        own = a.part(p.start, p.end)
        tables = words.tables_near(mentions, n) or out.tables
        tables = [*dict.fromkeys([*tables, *out.tables])]
        if does == "select":
            out.select += [s for s in selected(own, words, tables) if s not in out.select]
        elif does == "group":
            named = [c for _, c in _resolved(own, words, tables)]
            out.group += named[:1] or [column_of(words, m.table) for m in own.mentions if not m.column][:1]
        elif does == "order":
            out.order += condition_columns(own, words, tables, {})[:1]
        else:
            held = {i - p.start: c for i, c in stored.items() if p.start <= i < p.end}
            out.where += condition_columns(own, words, tables, held)
    # What the parts group by is asked for too, unless it is named already.
    for c in out.group if said is None or "select" in said else ():
        if not any((s.table, s.column) == c for s in out.select):
            out.select.insert(0, Selected("", *c))
    return parts, out


def evidence(a: Annotated, words: SchemaWords, stored: dict[int, list[Column]] | None = None) -> dict[str, int]:
    """How much a question speaks of each table: 4 by its whole name, 3 by a value of its, 2 by a whole column name, 1 by a part of either.

    Words that are a column of some table by themselves are no part of another table's name.
    """
    out: dict[str, int] = {}
    whole_columns = {m.start for m in a.mentions if m.column and m.tier <= 1}
    for m in a.mentions:
        whole = m.tier <= 1
        if not m.column and not whole and m.start in whole_columns:
            continue
        out[m.table] = max(out.get(m.table, 0), (2 if whole else 1) if m.column else (4 if whole else 1))
    for columns in (stored or {}).values():
        for t, _ in columns:
            out[t] = max(out.get(t, 0), 3)
    return out


def content_words(text: str) -> list[str]:
    return [w for w in text.lower().split() if w not in STOP_WORDS]
