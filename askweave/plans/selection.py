"""Candidates repaired, run and chosen; predictions compared with what was wanted."""

from __future__ import annotations

import re
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askweave.plans.emit import query_sql
from askweave.plans.engine import Engine
from askweave.plans.inference import expand
from askweave.plans.parser import QueryError, parse_sql
from askweave.plans.syntax import Bool, Col, Lit, Query, Source, Sub, outer, rewrite
from askweave.sources.catalog import Catalog

#: What a question without a usable candidate gets.
PLACEHOLDER = "sql placeholder"
TIMEOUT_S = 120.0


def closest(name: str, names: Iterable[str]) -> str:
    """The name with the longest block in common; of equal ones the first."""
    best, most = "", -1
    for n in names:
        size = SequenceMatcher(None, name, n, autojunk=False).find_longest_match(0, len(name), 0, len(n)).size
        if size > most:
            best, most = n, size
    return best


def repair(text: str, catalog: Catalog) -> str:
    """Unknown ``table.column`` names replaced by known ones.

    A known column under the wrong table goes to the closest table that has it; an unknown column of a known table becomes
    that table's closest; where both are unknown the closest column decides. An unknown table after FROM or JOIN becomes the closest.
    Text in quotes and numbers are left alone.
    """
    owners: dict[str, list[str]] = {}
    for t, cs in catalog.tables.items():
        for c in (*cs, "*"):
            owners.setdefault(c, []).append(t)
    tables = list(catalog.tables)
    pieces = re.split(r"('[^']*'|\"[^\"]*\")", text)

    def dotted(m: re.Match) -> str:
        t, c = m.group(1).lower(), m.group(2).lower()
        if c == "*" or t in catalog.tables and c in catalog.tables[t]:
            return m.group() if t in catalog.tables else f"{closest(t, tables)}.{c}"
        if c in owners:
            return f"{closest(t, owners[c])}.{c}"
        if t in catalog.tables:
            return f"{t}.{closest(c, catalog.tables[t])}"
        c = closest(c, [x for x in owners if x != "*"])
        return f"{closest(t, owners[c])}.{c}"

    def from_table(m: re.Match) -> str:
        return m.group() if m.group(2).lower() in catalog.tables else m.group(1) + closest(m.group(2).lower(), tables)

    for i in range(0, len(pieces), 2):
        pieces[i] = re.sub(r"\b([^\W\d]\w*)\.(\w+|\*)", dotted, pieces[i])
        pieces[i] = re.sub(r"\b((?:from|join)\s+)(\w+)(?![\w.])", from_table, pieces[i], flags=re.I)
    return "".join(pieces)


def tidy(text: str) -> str:
    """The candidate after its last ``|``, with blanks around ``=``, ``!=`` and commas."""
    return text.rpartition("|")[2].strip().replace("='", "= '").replace("!=", " !=").replace(",", " ,")


def compiled(text: str, catalog: Catalog, shorthand: bool = False) -> str | None:
    """The candidate repaired and compiled to SQL; None where it cannot be read or names what the catalog lacks."""
    try:
        query = repair(tidy(text), catalog)
        tree = expand(query, catalog) if shorthand else parse_sql(query)
        return query_sql(tree) if known(tree, catalog) else None
    except Exception:
        return None


def known(q: Query, catalog: Catalog, above: dict[str, frozenset[str]] | None = None) -> bool:
    """Whether every table and column of a query is in the catalog, by the scopes of its blocks."""
    scope = dict(above or {})
    for s in q.sources:
        if s.query is not None:
            if not known(s.query, catalog, above):
                return False
            scope[s.alias] = frozenset(e.name if isinstance(e, Col) else f"o{i}" for i, e in enumerate(s.query.select))
        elif s.table not in catalog.tables:
            return False
        else:
            scope[s.alias] = frozenset(catalog.tables[s.table])
    every = frozenset().union(*scope.values())
    for x in outer((q.select, tuple(s.on for s in q.sources), q.where, q.group, q.having, q.order)):
        if isinstance(x, Col) and x.name != "*" and x.name not in (scope.get(x.table, frozenset()) if x.table else every):
            return False
        if isinstance(x, Sub) and x.query.sources and not known(x.query, catalog, scope):
            return False
    return all(known(part, catalog, above) for _, part in q.sets)


def run_within(spark: SparkSession, df: DataFrame, seconds: float, run: Callable[[DataFrame], object] = DataFrame.collect) -> object | None:
    """What ``run`` makes of the query (its rows), or None where it fails or takes longer: its jobs are then cancelled by their tag."""
    tag, over, late = f"askweave-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            spark.sparkContext.cancelJobsWithTag(tag)
            while not over.wait(0.5):  # a query has several jobs: the next one ends too
                spark.sparkContext.cancelJobsWithTag(tag)

    spark.sparkContext.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        out = run(df)
        return None if late.is_set() else out
    except Exception:
        return None
    finally:
        over.set()
        spark.sparkContext.removeJobTag(tag)


def _drained(df: DataFrame) -> bool:
    """Every row is made, and none is kept or sent to the driver."""
    df.toDF(*(f"c{i}" for i in range(len(df.columns)))).write.format("noop").mode("overwrite").save()
    return True


def choose(engine: Engine, candidates: list[str], shorthand: bool = True, seconds: float = TIMEOUT_S) -> tuple[int, str]:
    """Number and text of the first candidate that is repaired, compiled and runs; an empty result counts. (-1, placeholder) if none.

    Analysis comes first and costs no job; a candidate that passes is run as a whole, within ``seconds``, into a sink that keeps nothing.
    """
    for i, raw in enumerate(candidates):
        try:
            text = repair(tidy(raw), engine.catalog)
            df = engine.shorthand(text) if shorthand else engine.sql(text)
            if run_within(engine.spark, df, seconds, _drained) is not None:
                return i, engine.explain(text) if shorthand else text
        except Exception:  # noqa: S112  a candidate that cannot be read is passed over
            continue
    return -1, PLACEHOLDER


# -- evaluation ----------------------------------------------------------------------------------------------------


def _settled(q: Query, values: bool):
    """A query whose equals are equal: aliases resolved, sets of conditions and tables without order."""
    names = {s.alias: s.table for s in q.sources if s.table}
    single = next(iter(names.values())) if len(names) == 1 else ""

    def change(n):
        match n:
            case Col(t, c):
                return Col(names.get(t, t) or single, c)
            case Lit(v) if not values and v is not None:
                return Lit("terminal")
            case Bool(op, parts):
                return (op, frozenset(Counter(parts).items()))
            case Source(t, _, on, query):
                return (t, on, query)
            case Query():
                return (frozenset(Counter(n.select).items()), n.distinct, frozenset(Counter(n.sources).items()), n.where, frozenset(n.group), n.having, n.order, n.limit is not None if not values else n.limit, n.sets)
        return n

    return rewrite(q, change)


def exact_match(predicted: str, gold: str, values: bool = False) -> bool:
    """Whether two queries have the same clauses, whatever the order of what has none; literals count only if wished."""
    try:
        return _settled(parse_sql(predicted), values) == _settled(parse_sql(gold), values)
    except QueryError:
        return False


@F.arrow_udf(T.BooleanType())
def exact_matches(predicted: pa.Array, gold: pa.Array) -> pa.Array:
    """:func:`exact_match` over Arrow batches; a null matches nothing."""
    return pa.array([a is not None and b is not None and exact_match(a, b) for a, b in zip(predicted.to_pylist(), gold.to_pylist())])


def same_result(a: DataFrame, b: DataFrame) -> bool:
    """Whether two results are the same bag of rows, whatever their column names."""
    if len(a.columns) != len(b.columns):
        return False
    names = [f"c{i}" for i in range(len(a.columns))]
    try:
        # Each row counts up on one side and down on the other: one aggregation, partial before its shuffle.
        both = a.toDF(*names).withColumn("_n", F.lit(1)).union(b.toDF(*names).withColumn("_n", F.lit(-1)))
        return both.groupBy(*names).agg(F.sum("_n").alias("_n")).filter("_n <> 0").isEmpty()
    except Exception:
        return False


def same_results(pairs: Iterable[tuple[Callable[[], DataFrame], Callable[[], DataFrame]]], at_once: int = 4) -> list[bool]:
    """:func:`same_result` of every pair of plans, some of them running side by side; a plan that cannot be made matches nothing."""

    def one(pair: tuple[Callable[[], DataFrame], Callable[[], DataFrame]]) -> bool:
        try:
            return same_result(pair[0](), pair[1]())
        except Exception:
            return False

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(one, pairs))


def best_checkpoints(metrics: DataFrame) -> DataFrame:
    """The best checkpoint (``ckpt``, ``em``, ``ex``) by exact match, by execution and by their sum; ties by the other, then the first."""
    out = None
    for goal, order in (("em", [F.desc("em"), F.desc("ex")]), ("ex", [F.desc("ex"), F.desc("em")]), ("sum", [F.desc(F.col("em") + F.col("ex"))])):
        # A handful of checkpoints: one row each.
        top = metrics.orderBy(*order, "ckpt").limit(1).select(F.lit(goal).alias("goal"), "ckpt", "em", "ex")
        out = top if out is None else out.unionByName(top)
    return out


__all__ = ["PLACEHOLDER", "best_checkpoints", "choose", "closest", "compiled", "exact_match", "exact_matches", "known", "repair", "run_within", "same_result", "same_results", "tidy"]
