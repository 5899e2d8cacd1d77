"""Syntax trees of the query language: frozen values that every pass maps to new ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class Col:
    """``table.name``; an empty table is not resolved yet, the name ``*`` stands for a table as a whole."""

    table: str
    name: str


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Agg:
    func: str
    arg: "Expr"
    distinct: bool = False


@dataclass(frozen=True)
class Arith:
    op: str
    left: "Expr"
    right: "Expr"


@dataclass(frozen=True)
class Sub:
    """A nested query as an operand."""

    query: "Query"


Expr = Col | Lit | Agg | Arith | Sub

#: The left operand that is left to the catalog.
ANY = Col("@", "@")


@dataclass(frozen=True)
class Cond:
    left: Expr
    op: str
    right: Expr | None = None
    high: Expr | None = None


@dataclass(frozen=True)
class Bool:
    """``and`` / ``or`` over two or more parts, or ``not`` over one."""

    op: str
    parts: tuple["Pred", ...]


Pred = Cond | Bool


@dataclass(frozen=True)
class Source:
    """A table or nested query under a name, with the predicate that joins it to those before it."""

    table: str
    alias: str
    on: Pred | None = None
    query: "Query | None" = None


@dataclass(frozen=True)
class Order:
    expr: Expr
    desc: bool = False


@dataclass(frozen=True)
class Query:
    select: tuple[Expr, ...]
    sources: tuple[Source, ...] = ()
    where: Pred | None = None
    group: tuple[Expr, ...] = ()
    having: Pred | None = None
    order: tuple[Order, ...] = ()
    limit: int | None = None
    distinct: bool = False
    #: Set operations from left to right: (intersect | union | except, query).
    sets: tuple[tuple[str, "Query"], ...] = ()
    #: Only before inference: flat conditions with the connector before each.
    flat: tuple[tuple[str, Cond], ...] = field(default=())


def walk(node: object) -> Iterator[object]:
    """The node and all below it; nested queries are entered."""
    yield node
    if is_dataclass(node):
        for f in fields(node):
            yield from walk(getattr(node, f.name))
    elif isinstance(node, tuple):
        for x in node:
            yield from walk(x)


def outer(node: object) -> Iterator[object]:
    """As :func:`walk`, without entering nested queries."""
    yield node
    if isinstance(node, (Sub, Query)):
        return
    if is_dataclass(node):
        for f in fields(node):
            yield from outer(getattr(node, f.name))
    elif isinstance(node, tuple):
        for x in node:
            yield from outer(x)


def rewrite(node, change: Callable):
    """Bottom-up copy in which ``change`` may replace every node."""
    if is_dataclass(node):
        new = {f.name: rewrite(getattr(node, f.name), change) for f in fields(node)}
        if any(new[k] is not getattr(node, k) for k in new):
            node = replace(node, **new)
        return change(node)
    if isinstance(node, tuple):
        new = tuple(rewrite(x, change) for x in node)
        return node if all(a is b for a, b in zip(new, node)) else new
    return node


def columns(node: object) -> list[Col]:
    return [x for x in outer(node) if isinstance(x, Col)]


def has_agg(node: object) -> bool:
    return any(isinstance(x, Agg) for x in outer(node))


def conj(op: str, parts: list[Pred]) -> Pred | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else Bool(op, tuple(parts))


def from_flat(flat: list[tuple[str, Cond]]) -> Pred | None:
    """A flat chain with the usual precedence: ``and`` binds more tightly than ``or``."""
    groups: list[list[Pred]] = []
    for link, cond in flat:
        if link == "or" and groups:
            groups.append([cond])
        elif groups:
            groups[-1].append(cond)
        else:
            groups.append([cond])
    return conj("or", [conj("and", g) for g in groups])
