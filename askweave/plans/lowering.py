"""Syntax tree to DataFrame: the logical plan only; joins, pushdown and the physical strategy are Catalyst's.

Where the language is looser than ANSI SQL, the meaning is fixed here:

* text compared with a number: the text is tried as a number, and is no match otherwise;
* whole numbers divide to whole numbers, and division by zero is null;
* LIKE does not look at letter case; a scalar nested query of several rows gives its first;
* set operations run from left to right; nulls come first in ascending order and last in descending order;
* IN and NOT IN keep SQL's nulls wherever they stand: with a null on the right NOT IN lets nothing through, with an empty right everything;
* DISTINCT with an order key outside the projection: of equal rows, the one that comes first gives the place.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askweave.plans.parser import QueryError
from askweave.plans.syntax import Agg, Arith, Bool, Col, Cond, Expr, Lit, Order, Pred, Query, Sub, columns, conj, has_agg, outer

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
WHOLE = ("tinyint", "smallint", "int", "bigint")


class Lowering:
    """``tables`` gives the DataFrame of a name."""

    def __init__(self, tables: Callable[[str], DataFrame]):
        self.tables, self.names = tables, itertools.count()

    def fresh(self, stem: str) -> str:
        return f"_{stem}{next(self.names)}"

    def query(self, q: Query) -> DataFrame:
        """The result with columns ``o0``, ``o1`` and so on."""
        if not q.sets:
            return self.block(q, whole=True)
        out = self.block(q, whole=False)
        for op, part in q.sets:
            right = self.query(part).toDF(*out.columns)
            out = {"intersect": out.intersect, "except": out.subtract, "union": lambda r: out.union(r).distinct()}[op](right)
        if q.order:
            places = []
            for o in q.order:
                if o.expr not in q.select:
                    raise QueryError("the order of a set operation must name projected columns")
                c = F.col(f"o{q.select.index(o.expr)}")
                places.append(c.desc_nulls_last() if o.desc else c.asc_nulls_first())
            out = out.orderBy(*places)
        return out if q.limit is None else out.limit(q.limit)

    # -- blocks ------------------------------------------------------------------------------------------------

    def block(self, q: Query, whole: bool) -> DataFrame:
        scope: dict[str, DataFrame] = {}
        df: DataFrame | None = None
        prefix = self.fresh("t")
        for s in q.sources:
            if s.query is not None:
                own = self.query(s.query)
                own = own.toDF(*[e.name if isinstance(e, Col) and e.name != "*" else f"o{i}" for i, e in enumerate(s.query.select)]) if len(own.columns) == len(s.query.select) else own
            else:
                own = self.tables(s.table)
            # Columns are renamed per use of a table, so that no name is ever met twice.
            mark = f"{prefix}_{s.alias}_"
            renamed = own.toDF(*[mark + c.lower() for c in own.columns])
            scope[s.alias] = renamed
            self_scope = dict(scope)
            if df is None:
                df = renamed
            elif s.on is None:
                df = df.crossJoin(renamed)
            else:
                df = df.join(renamed, self.pred(s.on, self_scope, prefix), "inner")
        if df is None:
            raise QueryError("a query needs a table")
        df = self.filtered(df, q.where, scope, prefix)
        q = self.expanded(q, scope, prefix)
        grouped = bool(q.group) or has_agg((q.select, q.having, tuple(o.expr for o in q.order)))
        made: dict[Expr, Column] = {}
        if grouped:
            keys = {e: self.fresh("k") for e in q.group}
            aggs = {a: self.fresh("a") for a in dict.fromkeys(x for x in outer((q.select, q.having, q.order)) if isinstance(x, Agg))}
            rows = df.groupBy(*(self.expr(e, scope, prefix, {}).alias(n) for e, n in keys.items())) if keys else df.groupBy()
            df = rows.agg(*(self.agg(a, scope, prefix).alias(n) for a, n in aggs.items())) if aggs else df.select(*(self.expr(e, scope, prefix, {}).alias(n) for e, n in keys.items())).distinct()
            made = {e: F.col(n) for e, n in (*keys.items(), *aggs.items())}
            if q.having is not None:
                df = self.filtered(df, q.having, scope, prefix, made)
        out = [self.expr(e, scope, prefix, made).alias(f"o{i}") for i, e in enumerate(q.select)]
        if q.distinct or not whole:
            beside = [o for o in q.order if o.expr not in q.select] if whole and q.distinct else []
            named = df.select(*out, *(self.expr(o.expr, scope, prefix, made).alias(f"_s{i}") for i, o in enumerate(beside)))
            if beside:
                # Of the rows that are one after DISTINCT, the one that comes first gives the order.
                firsts = [(F.max if o.desc else F.min)(f"_s{i}").alias(f"_s{i}") for i, o in enumerate(beside)]
                df = named.groupBy(*(f"o{i}" for i in range(len(out)))).agg(*firsts)
                df = df.orderBy(*self.orders(q.order, lambda e: F.col(f"o{q.select.index(e)}") if e in q.select else F.col(f"_s{[o.expr for o in beside].index(e)}")))
                df = df if q.limit is None else df.limit(q.limit)
                return df.select(*(f"o{i}" for i in range(len(out))))
            df = named.distinct() if q.distinct else named
            if whole:
                df = df.orderBy(*self.orders(q.order, lambda e: F.col(f"o{q.select.index(e)}"))) if q.order else df
        else:
            if q.order:
                df = df.orderBy(*self.orders(q.order, lambda e: self.expr(e, scope, prefix, made)))
            if q.limit is not None:
                df = df.limit(q.limit)
            return df.select(*out)
        return df.limit(q.limit) if whole and q.limit is not None else df

    def expanded(self, q: Query, scope: dict[str, DataFrame], prefix: str) -> Query:
        """``*`` and ``t.*`` of the projection written out."""
        select: list[Expr] = []
        for e in q.select:
            if isinstance(e, Col) and e.name == "*":
                for alias in [e.table] if e.table else scope:
                    skip = len(f"{prefix}_{alias}_")
                    select += [Col(alias, c[skip:]) for c in scope[alias].columns]
            else:
                select.append(e)
        return Query(**{**q.__dict__, "select": tuple(select)})

    @staticmethod
    def orders(order: tuple[Order, ...], of: Callable[[Expr], Column]) -> list[Column]:
        return [of(o.expr).desc_nulls_last() if o.desc else of(o.expr).asc_nulls_first() for o in order]

    # -- predicates --------------------------------------------------------------------------------------------

    def filtered(self, df: DataFrame, p: Pred | None, scope, prefix: str, made: dict[Expr, Column] | None = None) -> DataFrame:
        """Filter by a predicate; nested IN and EXISTS among its conjuncts become semi and anti joins."""
        if p is None:
            return df
        parts = p.parts if isinstance(p, Bool) and p.op == "and" else (p,)
        plain = [x for x in parts if not self.is_member(x)]
        if plain:
            df = df.filter(self.pred(conj("and", list(plain)), scope, prefix, made or {}))
        for c in parts:
            if self.is_member(c):
                df = self.member(df, c, scope, prefix, made or {})
        return df

    @staticmethod
    def is_member(p: Pred) -> bool:
        return isinstance(p, Cond) and p.op in ("in", "not in", "exists") and isinstance(p.right, Sub) and bool(p.right.query.sources)

    def member(self, df: DataFrame, c: Cond, scope, prefix: str, made) -> DataFrame:
        right = self.query(c.right.query)
        if c.op == "exists":
            return df.filter(right.exists())
        v = self.fresh("v")
        right = right.toDF(v)
        left = self.expr(c.left, scope, prefix, made)
        a, b = self.alike(df, left, right, F.col(v))
        if c.op == "in":
            return df.join(right, a == b, "left_semi")
        # Null-aware without a nested loop: one look at the right side, then a plain anti join.
        state = self.fullness(right, v)
        return df.filter((state == 0) | left.isNotNull() & (state == 1)).join(right.filter(F.col(v).isNotNull()), a == b, "left_anti")

    @staticmethod
    def fullness(right: DataFrame, v: str) -> Column:
        """0 where the right side of an IN is empty, 1 where it has no nulls, 2 where it has some."""
        return right.agg(F.when(F.count(F.lit(1)) == 0, 0).when(F.count(v) == F.count(F.lit(1)), 1).otherwise(2)).scalar()

    def among(self, p: Cond, left: Column, scope, prefix: str) -> Column:
        """IN over a nested query as a value of its own, below OR or NOT: true, false or null as SQL has it.

        The nested query is an existence join on equality; its nulls come from one look at it, so nothing loops over pairs.
        """
        v = self.fresh("v")
        inner = self.query(p.right.query).toDF(v)
        a, b = self.type(p.left, scope, prefix), inner.dtypes[0][1]
        own, other = left.outer(), F.col(v)
        if a == "string" and b.startswith(NUMBERS):
            own = own.try_cast("double")
        elif b == "string" and a.startswith(NUMBERS):
            other = other.try_cast("double")
        state = self.fullness(inner, v)
        found = inner.filter(other == own).exists()
        return F.when(state == 0, F.lit(False)).when(left.isNull(), F.lit(None).cast("boolean")).when(found, F.lit(True)).when(state == 2, F.lit(None).cast("boolean")).otherwise(F.lit(False))

    @staticmethod
    def alike(df: DataFrame, left: Column, right_df: DataFrame, right: Column) -> tuple[Column, Column]:
        a, b = df.select(left).dtypes[0][1], right_df.select(right).dtypes[0][1]
        if a == "string" and b.startswith(NUMBERS):
            return left.try_cast("double"), right
        if b == "string" and a.startswith(NUMBERS):
            return left, right.try_cast("double")
        return left, right

    def pred(self, p: Pred, scope, prefix: str, made: dict[Expr, Column] | None = None) -> Column:
        made = made or {}
        if isinstance(p, Bool):
            parts = [self.pred(x, scope, prefix, made) for x in p.parts]
            if p.op == "not":
                return ~parts[0]
            out = parts[0]
            for x in parts[1:]:
                out = out & x if p.op == "and" else out | x
            return out
        negated = p.op.startswith("not ") or p.op == "is not"
        op = p.op.removeprefix("not ").removesuffix(" not")
        if op == "exists":
            return self.query(p.right.query).exists()
        left = self.expr(p.left, scope, prefix, made)
        if op == "in" and isinstance(p.right, Sub) and not p.right.query.sources:
            out = left.isin(*[v.value for v in p.right.query.select])
        elif op == "in":
            out = self.among(p, left, scope, prefix)
        elif op == "between":
            a, b = self.matched(p.left, p.right, scope, prefix, made)
            c, d = self.matched(p.left, p.high, scope, prefix, made)
            out = (a >= b) & (c <= d)
        elif op == "like":
            out = left.cast("string").ilike(self.expr(p.right, scope, prefix, made)) if not isinstance(p.right, Lit) else left.cast("string").ilike(str(p.right.value))
        elif op == "is":
            out = left.eqNullSafe(self.expr(p.right, scope, prefix, made))
        else:
            a, b = self.matched(p.left, p.right, scope, prefix, made)
            out = {"=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return ~out if negated else out

    def matched(self, x: Expr, y: Expr, scope, prefix: str, made) -> tuple[Column, Column]:
        """Both sides of a comparison, text tried as a number where the other side is one."""
        a, b = self.expr(x, scope, prefix, made), self.expr(y, scope, prefix, made)
        s, t = self.type(x, scope, prefix), self.type(y, scope, prefix)
        if s == "string" and t.startswith(NUMBERS):
            return a.try_cast("double"), b
        if t == "string" and s.startswith(NUMBERS):
            return a, b.try_cast("double")
        if t == "string" and s.startswith(("timestamp", "date")):
            return a, b.try_cast(s)
        return a, b

    # -- expressions -------------------------------------------------------------------------------------------

    def type(self, e: Expr, scope, prefix: str) -> str:
        match e:
            case Lit(v):
                return "string" if isinstance(v, str) else "double" if isinstance(v, float) else "int" if isinstance(v, int) else "void"
            case Agg("count", _, _):
                return "bigint"
            case Agg("avg", _, _):
                return "double"
            case Agg(func, arg, _):
                inner = self.type(arg, scope, prefix)
                return "bigint" if func == "sum" and inner in WHOLE else inner
            case Arith(op, left, right):
                both = (self.type(left, scope, prefix), self.type(right, scope, prefix))
                return "bigint" if all(t in WHOLE for t in both) else "double"
            case Col():
                name = self.name(e, scope, prefix)
                return next(t for df in scope.values() for c, t in df.dtypes if c == name)
            case Sub(query):
                return self.query(query).dtypes[0][1]
        raise TypeError(e)

    def name(self, c: Col, scope, prefix: str) -> str:
        """The renamed column: by its table, or of the first table that has it."""
        for alias in [c.table] if c.table else scope:
            full = f"{prefix}_{alias}_{c.name}"
            if alias in scope and full in scope[alias].columns:
                return full
        raise QueryError(f"unknown column {c.table + '.' if c.table else ''}{c.name}")

    def expr(self, e: Expr, scope, prefix: str, made: dict[Expr, Column]) -> Column:
        if e in made:
            return made[e]
        match e:
            case Col():
                return F.col(self.name(e, scope, prefix))
            case Lit(v):
                return F.lit(v)
            case Agg():
                return self.agg(e, scope, prefix)
            case Arith(op, left, right):
                a, b = self.expr(left, scope, prefix, made), self.expr(right, scope, prefix, made)
                if op == "/":
                    whole = all(self.type(x, scope, prefix) in WHOLE for x in (left, right))
                    b = F.nullif(b, F.lit(0))
                    return F.call_function("div", a, b) if whole else a / b
                return {"+": a + b, "-": a - b, "*": a * b}[op]
            case Sub(query):
                return self.query(query).limit(1).scalar()
        raise TypeError(e)

    def agg(self, a: Agg, scope, prefix: str) -> Column:
        if isinstance(a.arg, Col) and a.arg.name == "*":
            if a.func != "count":
                raise QueryError(f"{a.func}(*) has no meaning")
            return F.count(F.lit(1))
        arg = self.expr(a.arg, scope, prefix, {})
        if a.func in ("sum", "avg") and self.type(a.arg, scope, prefix) == "string":
            arg = arg.try_cast("double")
        if a.distinct:
            arg_ = {"count": F.count_distinct, "sum": F.sum_distinct}.get(a.func)
            if arg_ is not None:
                return arg_(arg)
            if a.func == "avg":
                return F.sum_distinct(arg) / F.count_distinct(arg)
        return {"max": F.max, "min": F.min, "count": F.count, "sum": F.sum, "avg": F.avg}[a.func](arg)


def lower(q: Query, tables: Callable[[str], DataFrame], names: list[str] | None = None) -> DataFrame:
    """The DataFrame of a query, its columns named ``names`` (``o0`` and so on by default)."""
    out = Lowering(tables).query(q)
    return out.toDF(*names) if names else out
