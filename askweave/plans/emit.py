"""Syntax tree to SQL text that Spark and other engines read alike."""

from __future__ import annotations

from askweave.plans.syntax import Agg, Arith, Bool, Col, Cond, Expr, Lit, Order, Pred, Query, Source, Sub


def expr_sql(e: Expr) -> str:
    match e:
        case Col(table, name):
            return name if name == "*" or not table else f"{table}.{name}"
        case Lit(None):
            return "null"
        case Lit(str() as v):
            return "'" + v.replace("'", "''") + "'"
        case Lit(v):
            return str(v)
        case Agg(func, arg, distinct):
            return f"{func}({'distinct ' if distinct else ''}{expr_sql(arg)})"
        case Arith(op, left, right):
            a = f"({expr_sql(left)})" if isinstance(left, Arith) and op in "*/" and left.op in "+-" else expr_sql(left)
            b = f"({expr_sql(right)})" if isinstance(right, Arith) else expr_sql(right)
            return f"{a} {op} {b}"
        case Sub(Query(values, sources=())) if len(values) >= 1 and all(isinstance(v, Lit) for v in values):
            return f"({', '.join(map(expr_sql, values))})"
        case Sub(query):
            return f"({query_sql(query)})"
    raise TypeError(e)


def pred_sql(p: Pred) -> str:
    match p:
        case Bool("not", (part,)):
            return f"not ({pred_sql(part)})"
        case Bool("or", parts):
            return " or ".join(map(pred_sql, parts))
        case Bool(_, parts):
            return " and ".join(f"({pred_sql(x)})" if isinstance(x, Bool) and x.op == "or" else pred_sql(x) for x in parts)
        case Cond(_, "exists", right):
            return f"exists {expr_sql(right)}"
        case Cond(left, ("between" | "not between") as op, low, high):
            return f"{expr_sql(left)} {op} {expr_sql(low)} and {expr_sql(high)}"
        case Cond(left, op, right):
            return f"{expr_sql(left)} {op} {expr_sql(right)}"
    raise TypeError(p)


def source_sql(s: Source, first: bool) -> str:
    body = f"({query_sql(s.query)})" if s.query else s.table
    name = f" as {s.alias}" if s.query or s.alias != s.table else ""
    on = f" on {pred_sql(s.on)}" if s.on else ""
    return f"{'' if first else (' join ' if s.on else ' cross join ')}{body}{name}{on}"


def _order_sql(order: tuple[Order, ...]) -> str:
    return ", ".join(f"{expr_sql(o.expr)} {'desc' if o.desc else 'asc'}" for o in order)


def query_sql(q: Query) -> str:
    def block(b: Query) -> str:
        out = f"select {'distinct ' if b.distinct else ''}{', '.join(map(expr_sql, b.select))}"
        if b.sources:
            out += " from " + "".join(source_sql(s, i == 0) for i, s in enumerate(b.sources))
        if b.where:
            out += f" where {pred_sql(b.where)}"
        if b.group:
            out += f" group by {', '.join(map(expr_sql, b.group))}"
        if b.having:
            out += f" having {pred_sql(b.having)}"
        return out

    out = block(q)
    for i, (op, part) in enumerate(q.sets):
        # Left to right, whatever an engine thinks of the precedence of INTERSECT.
        left = f"({out})" if i else out
        out = f"{left} {op} {query_sql(part)}"
    if q.order:
        out += f" order by {_order_sql(q.order)}"
    if q.limit is not None:
        out += f" limit {q.limit}"
    return out
