"""Nested records as flat, related tables (problem 5).

A nested Arrow column is shredded into one sequence of repetition and definition levels per leaf path, all at once on
the offsets of its arrays. The tables are put together again from those sequences alone: a repetition level says which list
an entry goes on in, a definition level how much of the path is there. One pass over each batch, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askweave.functions.arrow import row_slices


@dataclass
class Leaf:
    """A leaf path: its levels, its values (by ``index``, -1 where nothing is there) and the definition level of each list's entries."""

    path: str
    rep: np.ndarray
    definition: np.ndarray
    index: np.ndarray
    values: pa.Array
    entry_levels: list[int]
    full: int

    def positions(self, level: int) -> np.ndarray:
        """0-based place within the list of repetition level ``level`` (1: outermost), read off the levels."""
        same = np.cumsum(self.rep == level)
        fresh = np.where(self.rep < level, np.arange(len(self.rep)), -1)
        return same - same[np.maximum.accumulate(fresh)] if len(same) else same

    def rows(self) -> np.ndarray:
        """The record of each entry."""
        return np.cumsum(self.rep == 0) - 1

    def has_entry(self, level: int) -> np.ndarray:
        """Whether the list of repetition level ``level`` has this entry at all."""
        return self.definition >= self.entry_levels[level - 1]

    def present(self) -> np.ndarray:
        return self.definition == self.full


def _valid(array: pa.Array) -> np.ndarray:
    return ~np.asarray(array.is_null()) if array.null_count else np.ones(len(array), bool)


def shred(column: pa.Array) -> dict[str, Leaf]:
    """Levels of every leaf path of a nested array; list entries add ``[]`` to a path, fields ``.name``."""
    out: dict[str, Leaf] = {}

    def walk(array: pa.Array, path: str, index: np.ndarray, rep: np.ndarray, definition: np.ndarray, depth: int, level: int, entries: list[int]) -> None:
        here = index >= 0
        if len(array):
            here &= _valid(array)[np.maximum(index, 0)]
        index, definition = np.where(here, index, -1), definition + here
        level += 1
        if pa.types.is_struct(array.type):
            for i in range(array.type.num_fields):
                walk(array.field(i), f"{path}.{array.type.field(i).name}", index, rep, definition, depth, level, entries)
        elif pa.types.is_list(array.type) or pa.types.is_large_list(array.type):
            offsets = array.offsets.to_numpy().astype(np.int64)
            at = np.maximum(index, 0)
            begin = offsets[at] if len(array) else np.zeros(len(index), np.int64)
            length = np.where(here, (offsets[at + 1] if len(array) else begin) - begin, 0)
            grown = np.maximum(length, 1)
            source = np.repeat(np.arange(len(index)), grown)
            within = np.arange(int(grown.sum())) - np.repeat(np.cumsum(grown) - grown, grown)
            filled = length[source] > 0
            walk(array.values, f"{path}[]", np.where(filled, begin[source] + within, -1), np.where(within > 0, depth + 1, rep[source]), definition[source] + filled, depth + 1, level + 1, [*entries, level + 1])
        else:
            out[path] = Leaf(path, rep, definition, index, array, entries, level)

    n = len(column)
    walk(column, "", np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64), 0, 0, [])
    return out


def _one(column: pa.Array) -> pa.Array:
    """Without a slice offset, so that buffers and children line up."""
    return pa.concat_arrays([column]) if column.offset else column


def _int(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _take(leaf: Leaf, keep: np.ndarray) -> pa.Array:
    index = leaf.index[keep]
    return leaf.values.take(pa.array(index, pa.int64(), mask=index < 0))


def _order(*keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys[::-1])


def leaf_positions(names: Leaf, contents: Leaf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, entry, column and value places of all leaves: a missing level is -1, and no parent is lost.

    ``names`` is the list of columns in each entry, ``contents`` a list of values per column, which may be shorter or longer.
    """
    none = np.full
    row, t, c = names.rows(), names.positions(1), names.positions(2)
    is_table, is_column = names.has_entry(1), names.has_entry(2)
    vrow, vt, vc, vv = contents.rows(), contents.positions(1), contents.positions(2), contents.positions(3)
    own = contents.present()
    wide_t, wide_c = int(max(t.max(initial=0), vt.max(initial=0))) + 1, int(max(c.max(initial=0), vc.max(initial=0))) + 1
    key = (row * wide_t + t) * wide_c + c
    vkey = (vrow * wide_t + vt) * wide_c + vc
    own &= np.isin(vkey, key[is_column])
    bare = is_column & ~np.isin(key, vkey[own])
    no_column, no_table = is_table & ~is_column, ~is_table
    parts = [
        (vrow[own], vt[own], vc[own], vv[own]),
        (row[bare], t[bare], c[bare], none(int(bare.sum()), -1)),
        (row[no_column], t[no_column], none(int(no_column.sum()), -1), none(int(no_column.sum()), -1)),
        (row[no_table], *(none(int(no_table.sum()), -1) for _ in range(3))),
    ]
    return tuple(np.concatenate([p[i] for p in parts]) for i in range(4))


def schema_leaves(df: DataFrame, id_col: str, nested_col: str, names: str = "column_names_original", contents: str = "db_contents") -> DataFrame:
    """``id_col``, ``table_pos``, ``column_pos`` and ``value_pos`` of every leaf; see :func:`leaf_positions`.

    Null or empty lists at any level leave their parent with -1 below it. A null record, a null entry and an entry without columns
    are parents too. Repeated records come out each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in row_slices(whole)):
            if b.num_rows:
                leaves = shred(_one(b.column(1)))
                row, t, c, v = leaf_positions(leaves[f"[].{names}[]"], leaves[f"[].{contents}[][]"])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), _int(t), _int(c), _int(v)], ["_id", "table_pos", "column_pos", "value_pos"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, nested_col).mapInArrow(run, f"_id {kind}, table_pos int, column_pos int, value_pos int").withColumnRenamed("_id", id_col)


def flat_table(df: DataFrame, id_col: str, nested_col: str, fields: dict[str, str], positions: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """The table of one repeated ancestor: the places in its lists (``positions``, outermost first) and ``fields``, output name to leaf path.

    Leaves of parallel lists (same depth, other lists) are laid side by side by their places; a list that is shorter gives nulls. Only
    entries that exist are rows; each has the record's id and its parents' places, so it joins with any other table of the record.
    ``types`` are Spark types of the fields, string by default.
    """
    types = types or {}
    depth = len(positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in row_slices(whole)):
            leaves = shred(_one(b.column(1)))
            parts = []
            for path in fields.values():
                leaf = leaves[path]
                keep = np.flatnonzero(leaf.has_entry(depth))
                parts.append((leaf, keep, [leaf.rows()[keep], *(leaf.positions(i + 1)[keep] for i in range(depth))]))
            widths = [max(int(p[2][i].max(initial=0)) for p in parts) + 1 for i in range(depth + 1)]
            keys = []
            for _, _, places in parts:
                k = places[0]
                for i in range(1, depth + 1):
                    k = k * widths[i] + places[i]
                keys.append(k)
            every = np.unique(np.concatenate(keys))
            cols = []
            for (leaf, keep, _), k in zip(parts, keys):
                at = np.full(len(every), -1, np.int64)
                at[np.searchsorted(every, k)] = leaf.index[keep]
                cols.append(leaf.values.take(pa.array(at, pa.int64(), mask=at < 0)))
            rest, places = every, []
            for i in range(depth, 0, -1):
                places.insert(0, rest % widths[i])
                rest = rest // widths[i]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rest, pa.int64())), *map(_int, places), *cols], ["_id", *positions, *fields])

    kind = df.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"_id {kind}", *(f"{p} int" for p in positions), *(f"{f} {types.get(f, 'string')}" for f in fields)])
    return df.select(id_col, nested_col).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
