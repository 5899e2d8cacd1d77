"""Tables, columns, types and keys: what the front end knows and Catalyst does not."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from askweave.sources.tables import table

#: Declared keys of the star schema; lineitem has no key of its own.
STAR_PRIMARY = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}
STAR_FOREIGN = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("events", "user_id", "customer", "c_custkey"),
]


def catalog_type(spark_type: str) -> str:
    """The catalog's type of a Spark type: text, number, time, boolean or others."""
    if spark_type in ("string", "char", "varchar"):
        return "text"
    if spark_type == "boolean":
        return "boolean"
    if spark_type.startswith(("timestamp", "date")):
        return "time"
    return "number" if re.match(r"(tiny|small|big)?int|double|float|decimal|long", spark_type) else "others"


@dataclass(frozen=True)
class Catalog:
    """``tables``: name to columns and Spark types; ``primary``: name to key; ``foreign``: (child, column, parent, column)."""

    tables: dict[str, dict[str, str]]
    primary: dict[str, str] = field(default_factory=dict)
    foreign: tuple[tuple[str, str, str, str], ...] = ()
    #: Words for tables and columns, where they differ from the names.
    words: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def star(spark: SparkSession, sf_dir: str) -> Catalog:
        names = [*dict.fromkeys([*STAR_PRIMARY, *(f[0] for f in STAR_FOREIGN)])]
        tables = {n: dict(table(spark, sf_dir, n).dtypes) for n in names}
        words = {f"{t}.{c}": re.sub(r"^[a-z]+_", "", c) for t, cs in tables.items() for c in cs}
        return Catalog(tables, STAR_PRIMARY, tuple(STAR_FOREIGN), words)

    @staticmethod
    def of_row(row: dict) -> Catalog:
        """From a catalog delivery; dropped columns and keys that lead nowhere are left out."""
        names = [n.lower() for n in row["table_names_original"] or []]
        cols = [(c["table_idx"], (c["name"] or "").lower()) if c is not None else (None, "") for c in row["column_names_original"] or []]
        kinds = list(row["column_types"] or [])
        real = {i: (names[t], c) for i, (t, c) in enumerate(cols) if i and c and t is not None and 0 <= t < len(names)}
        spark = {"number": "double", "time": "timestamp", "boolean": "boolean"}
        tables: dict[str, dict[str, str]] = {n: {} for n in names}
        for i, (t, c) in real.items():
            tables[t][c] = spark.get(kinds[i] if i < len(kinds) else "text", "string")
        primary = {real[i][0]: real[i][1] for i in reversed(row["primary_keys"] or []) if i in real}
        foreign = tuple((*real[f["src"]], *real[f["dst"]]) for f in row["foreign_keys"] or [] if f is not None and f["src"] in real and f["dst"] in real)
        shown = [c["name"] if c is not None else None for c in row.get("column_names") or []]
        words = {f"{t}.{c}": shown[i].lower() if i < len(shown) and shown[i] else c for i, (t, c) in real.items()}
        return Catalog(tables, primary, foreign, words)

    def type_of(self, table_: str, column: str) -> str:
        return self.tables.get(table_, {}).get(column, "string")

    def owner(self, column: str, among: list[str]) -> str | None:
        """The first of the tables that has the column."""
        return next((t for t in among if column in self.tables.get(t, {})), None)

    def edges(self, a: str, b: str) -> list[tuple[str, str, str, str]]:
        """Foreign keys between two tables, in either direction."""
        return [f for f in self.foreign if {f[0], f[2]} == {a, b} and f[0] != f[2]]

    def key(self, table_: str) -> str | None:
        """The primary key of a table, else the first column that is named like one."""
        own = self.tables.get(table_, {})
        return self.primary.get(table_) or next((c for c in own if c in ("id", f"{table_}_id", f"{table_}id") or c.endswith("_id")), None)

    def related(self, a: tuple[str, str], b: tuple[str, str]) -> bool:
        """Whether two columns of different tables hold the same things: a foreign key says so, or both are keys. A star stands for the column that links."""
        if a[0] == b[0]:
            return False
        for f in self.edges(a[0], b[0]):
            ends = {f[:2], f[2:]}
            if all(x in ends or x[1] == "*" for x in (a, b)):
                return True
        return "*" not in (a[1], b[1]) and self.primary.get(a[0]) == a[1] and self.primary.get(b[0]) == b[1] and a[1] == b[1]


def catalog_frames(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """The catalog as DataFrames: ``cat_columns`` and ``cat_fks``."""
    columns = [(t, c, k, catalog_type(k), catalog.primary.get(t) == c, i) for t, cs in catalog.tables.items() for i, (c, k) in enumerate(cs.items())]
    return {
        "cat_columns": spark.createDataFrame(columns, "table_name string, column_name string, spark_type string, catalog_type string, is_primary boolean, ordinal int"),
        "cat_fks": spark.createDataFrame(list(catalog.foreign), "src_table string, src_column string, dst_table string, dst_column string"),
    }
