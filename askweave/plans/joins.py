"""Which tables join, and how: the foreign keys of a catalog as a graph."""

from __future__ import annotations

import heapq

from askweave.plans.parser import QueryError
from askweave.plans.syntax import Col, Cond, Source
from askweave.sources.catalog import Catalog

def closure(foreign: tuple[tuple[str, str, str, str], ...]) -> set[tuple[str, str, str, str]]:
    """Foreign keys and those that follow when a key's target is itself a foreign key."""
    out = set(foreign)
    while True:
        more = {(*a[:2], *b[2:]) for a in out for b in out if a[2:] == b[:2] and a[:2] != b[2:]} - out
        if not more:
            return out
        out |= more


def _made_edges(catalog: Catalog, a: str, b: str) -> list[tuple[str, str, str, str]]:
    """Where no key is declared: a primary key met by a column of the same name; two primary keys of one type that share a word of their names;
    any two columns of one name and type; a foreign key and a primary key of one type whose names share a word."""
    for x, y in ((a, b), (b, a)):
        key = catalog.primary.get(y)
        if key and key in catalog.tables[x]:
            return [(x, key, y, key)]
    same_type = lambda c, d: catalog.type_of(a, c) == catalog.type_of(b, d)
    said = lambda c: set(c.split("_")) - {"id", "key", "no", "code"}
    p, q = catalog.primary.get(a), catalog.primary.get(b)
    if p and q and same_type(p, q) and said(p) & said(q):
        return [(a, p, b, q)]
    shared = [c for c in catalog.tables[a] if catalog.tables[b].get(c) == catalog.tables[a][c]]
    if shared:
        return [(a, shared[0], b, shared[0])]
    for x, y in ((a, b), (b, a)):
        key = catalog.primary.get(y)
        for f in catalog.foreign:
            if f[0] == x and key and catalog.type_of(x, f[1]) == catalog.type_of(y, key) and said(f[1]) & (said(key) | {y}):
                return [(x, f[1], y, key)]
    return []


def variants(catalog: Catalog, longest: int = 5) -> list[tuple[frozenset[str], frozenset[tuple[str, str, str, str]]]]:
    """Every way to join a set of up to ``longest`` tables: the tables and the keys that make them one tree, parallel keys and all shapes included."""
    level, out = {(frozenset([t]), frozenset()) for t in catalog.tables}, []
    for _ in range(longest):
        out += sorted(level, key=lambda v: (sorted(v[0]), sorted(v[1])))
        level = {(own | {new}, keys | {f}) for own, keys in level for f in catalog.foreign if (f[0] in own) != (f[2] in own) for new in [f[2] if f[0] in own else f[0]]}
    return out


def many_to_many(catalog: Catalog) -> list[tuple[str, str, str]]:
    """Pairs of tables (in name order) with each table that stands between them, ``(a, b, bridge)``."""
    out = set()
    for t in bridges(catalog):
        ends = sorted({f[2] for f in catalog.foreign if f[0] == t and catalog.primary.get(t) != f[1] and f[2] != t})
        out |= {(a, b, t) for i, a in enumerate(ends) for b in ends[i + 1 :]}
    return sorted(out)


def neighbours(catalog: Catalog) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {t: [] for t in catalog.tables}
    for a, _, b, _ in catalog.foreign:
        if a != b:
            for x, y in ((a, b), (b, a)):
                if y not in out.setdefault(x, []):
                    out[x].append(y)
    return out


#: Up to so many wanted tables the smallest set is found exactly (its cost is 3 to this power); more are joined one by one, nearest first.
EXACT = 10


def covering(catalog: Catalog, wanted: list[str], liked: frozenset[str] | dict[str, int] = frozenset()) -> list[str] | None:
    """The smallest connected set of tables with all that are wanted, however far apart; of equal ones that with most liked tables (or the most of what ``liked`` says of each).

    A smallest tree over the wanted tables is put together from smaller ones (each for a subset of the wanted tables and one more
    table in which they meet), so the cost grows with the catalog, not with the length of the paths. None where they do not hang together.
    """
    order, near = {t: i for i, t in enumerate(catalog.tables)}, neighbours(catalog)
    wanted = [*dict.fromkeys(wanted)]
    weight = {t: (1, -(liked.get(t, 0) if isinstance(liked, dict) else t in liked)) for t in near}
    if any(t not in near for t in wanted):
        return None
    best = _smallest(near, weight, order, wanted) if len(wanted) <= EXACT else _grown(near, weight, order, wanted)
    return None if best is None else [t for t in catalog.tables if t in best]


def _spread(near, weight, order, start: dict[str, tuple[tuple[int, int], frozenset[str]]]) -> dict[str, tuple[tuple[int, int], frozenset[str]]]:
    """Cheapest trees that reach each table from the given ones, a table at a time."""
    done: dict[str, tuple[tuple[int, int], frozenset[str]]] = {}
    heap = [(cost, order.get(t, 0), t, own) for t, (cost, own) in start.items()]
    heapq.heapify(heap)
    while heap:
        cost, _, t, own = heapq.heappop(heap)
        if t in done:
            continue
        done[t] = (cost, own)
        for n in near[t]:
            if n not in done:
                heapq.heappush(heap, (_plus(cost, weight[n]), order.get(n, 0), n, own | {n}))
    return done


def _plus(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
    return a[0] + b[0], a[1] + b[1]


def _smallest(near, weight, order, wanted: list[str]) -> frozenset[str] | None:
    full = (1 << len(wanted)) - 1
    trees = {1 << i: _spread(near, weight, order, {t: (weight[t], frozenset([t]))}) for i, t in enumerate(wanted)}
    for group in range(1, full + 1):
        if group & group - 1 == 0:
            continue
        met: dict[str, tuple[tuple[int, int], frozenset[str]]] = {}
        part = group & group - 1
        while part:
            if part > group ^ part:
                for t in trees[part].keys() & trees[group ^ part].keys():
                    (ca, a), (cb, b) = trees[part][t], trees[group ^ part][t]
                    cost = (ca[0] + cb[0] - weight[t][0], ca[1] + cb[1] - weight[t][1])
                    if t not in met or cost < met[t][0]:
                        met[t] = (cost, a | b)
            part = part - 1 & group
        trees[group] = _spread(near, weight, order, met)
    found = trees[full].values()
    return min(found, key=lambda x: (x[0], sorted(order.get(t, 0) for t in x[1])))[1] if found else None


def _grown(near, weight, order, wanted: list[str]) -> frozenset[str] | None:
    own = frozenset(wanted[:1])
    while rest := [t for t in wanted if t not in own]:
        reach = _spread(near, weight, order, {t: ((0, 0), own) for t in own})
        hit = [reach[t] for t in rest if t in reach]
        if not hit:
            return None
        own = min(hit, key=lambda x: x[0])[1]
    return own


def all_paths(catalog: Catalog, longest: int = 5) -> list[frozenset[str]]:
    """Every connected set of up to ``longest`` tables, smallest first."""
    near, level, out = neighbours(catalog), {frozenset([t]) for t in catalog.tables}, []
    for _ in range(longest):
        out += sorted(level, key=sorted)
        level = {s | {n} for s in level for t in s for n in near[t] if n not in s}
    return out


def bridges(catalog: Catalog) -> list[str]:
    """Tables that stand between others: two or more foreign keys to different tables."""
    to: dict[str, set[str]] = {}
    for a, c, b, _ in catalog.foreign:
        if catalog.primary.get(a) != c:
            to.setdefault(a, set()).add(b)
    return sorted(t for t, x in to.items() if len(x) > 1)


def join_sources(catalog: Catalog, wanted: list[str], liked: frozenset[str] | dict[str, int] = frozenset(), cross: bool = False) -> tuple[Source, ...]:
    """FROM for the wanted tables (in their order of appearance), with what lies between them.

    Tables that no key, primary key's name or shared column links are an error, for their join would be a product; ``cross`` allows it.
    """
    wanted = [*dict.fromkeys(wanted)]
    if not wanted:
        return ()
    whole = covering(catalog, wanted, liked)
    tables = whole if whole is not None else wanted
    placed, out, rest = [wanted[0]], [Source(wanted[0], wanted[0])], [t for t in tables if t != wanted[0]]
    rest.sort(key=lambda t: wanted.index(t) if t in wanted else -1)
    while rest:
        hit = next(((t, e) for p in placed for t in rest if (e := catalog.edges(p, t))), None) or next(((t, e) for p in placed for t in rest if (e := _made_edges(catalog, p, t))), None)
        if hit is None:
            if not cross:
                raise QueryError(f"nothing links {', '.join(placed)} and {rest[0]}")
            out.append(Source(rest[0], rest[0]))
            placed.append(rest.pop(0))
            continue
        t, found = hit
        a, ac, b, bc = found[0]
        out.append(Source(t, t, Cond(Col(a, ac), "=", Col(b, bc))))
        placed.append(t)
        rest.remove(t)
    return tuple(out)
