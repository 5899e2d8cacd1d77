"""One consistent form for text that looks the same (problem 6).

An Arrow string array becomes one numpy array of code points; everything after that is table gathers over the
whole batch: compatibility expansion by offsets into a pool, removal of invisible characters, look-alike letters
inside Latin words, ordering and composing of marks. No string call is made per row.

The consistent form is NFKC with these differences:

* zero-width characters and soft hyphens are removed, every space separator becomes a plain space;
* spacing accents and other signs whose expansion starts with a space keep their own character;
* a letter of another script that looks like a Latin one becomes that one if its word (a run of letters, digits and
  marks) has Latin letters and, besides, only such look-alikes.

Null stays null and empty stays empty; texts of any length are taken whole.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askweave.functions.arrow import text_slices

LIMIT = 0x110000
#: Code points without a visible mark that are dropped.
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF)
#: Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "H", "Ӏ": "I", "Ԍ": "G",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԛ": "q", "ԝ": "w", "ү": "y", "һ": "h", "ӏ": "l", "ԁ": "d", "г": "r", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "η": "n", "ω": "w",
    "Օ": "O", "Ս": "U", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q",
}
MARK_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
FULLWIDTH = ((0xFF01, 0xFF60), (0xFFE0, 0xFFE6))
#: What is counted in a text; a text with any count above zero did not have the consistent form for a reason of problem 6.
KINDS = ("wide", "marks", "invisible", "spaces", "lookalikes")

_HANGUL_S, _HANGUL_V, _HANGUL_T = 0xAC00, 0x1161, 0x11A7


class Tables:
    """Lookup tables over all code points, filled by rule from the interpreter's Unicode data for those that have been met."""

    def __init__(self) -> None:
        self.known = np.zeros(LIMIT, bool)
        self.expands = np.zeros(LIMIT, bool)
        self.expand_len = np.ones(LIMIT, np.uint8)
        self.expand_at = np.zeros(LIMIT, np.int32)
        self.ccc = np.zeros(LIMIT, np.uint8)
        self.joins = np.zeros(LIMIT, bool)  # may be the second half of a composition
        self.wordy = np.zeros(LIMIT, bool)
        self.latin = np.zeros(LIMIT, bool)
        self.foreign = np.zeros(LIMIT, bool)  # letters of other scripts without a Latin double
        self.double = np.zeros(LIMIT, np.int32)
        self.space = np.zeros(LIMIT, bool)
        self.invisible = np.zeros(LIMIT, bool)
        self.wide = np.zeros(LIMIT, bool)
        self.sign = np.zeros(LIMIT, bool)  # compatibility sign for one Latin letter
        self.mark = np.zeros(LIMIT, bool)
        for lo, hi in MARK_BLOCKS:
            self.mark[lo : hi + 1] = True
        for lo, hi in FULLWIDTH:
            self.wide[lo : hi + 1] = True
        self.invisible[list(INVISIBLE)] = True
        for a, b in LOOKALIKES.items():
            self.double[ord(a)] = ord(b)
        self.pool = np.zeros(0, np.int32)
        self.composites: dict[int, int] = {}

    def learn(self, points: np.ndarray) -> None:
        """Fill the tables for all code points of a batch, and for those that they expand to."""
        fresh, pool = np.unique(points[~self.known[points]]).tolist(), self.pool.tolist()
        while fresh:
            c = fresh.pop()
            if not self.known[c]:
                self.known[c] = True
                fresh += self._fill(c, pool)
        if len(pool) != len(self.pool):
            self.pool = np.array(pool, np.int32)

    def _fill(self, c: int, pool: list[int]) -> list[int]:
        ch = chr(c)
        cat = unicodedata.category(ch)
        self.ccc[c] = unicodedata.combining(ch)
        self.joins[c] = cat[0] == "M" or _HANGUL_V <= c < _HANGUL_V + 21 or _HANGUL_T < c < _HANGUL_T + 28
        self.wordy[c] = cat[0] in "LNM"
        self.space[c] = cat == "Zs" and c != 0x20
        name = unicodedata.name(ch, "")
        if cat[0] == "L":
            self.latin[c] = "LATIN" in name
            self.foreign[c] = "LATIN" not in name and not self.double[c]
        to = unicodedata.normalize("NFKD", ch)
        if to == ch or to[0] == " " and len(to) > 1 or self.space[c] or _HANGUL_S <= c <= 0xD7A3:
            return []
        self.expands[c], self.expand_len[c], self.expand_at[c] = True, len(to), len(pool)
        pool.extend(map(ord, to))
        raw = unicodedata.decomposition(ch)
        if raw.startswith("<") or " " not in raw:
            self.wide[c] |= "LIGATURE" in name and len(to) > 1
            self.sign[c] = len(to) == 1 and to.isascii() and to.isalpha() and not self.wide[c]
        return list(map(ord, to))

    def compose(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The composite of each pair, 0 where there is none; each different pair is looked up once."""
        pairs, back = np.unique((a.astype(np.int64) << 21) | b, return_inverse=True)
        out = np.zeros(len(pairs), np.int32)
        for i, key in enumerate(pairs.tolist()):
            if key not in self.composites:
                made = unicodedata.normalize("NFC", chr(key >> 21) + chr(key & 0x1FFFFF))
                self.composites[key] = ord(made) if len(made) == 1 else 0
            out[i] = self.composites[key]
        return out[back]


@lru_cache(1)
def tables() -> Tables:
    return Tables()


def code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows with a NUL before each row, and the place of each row's NUL."""
    if pa.types.is_large_string(values.type) or values.offset:
        values = pa.concat_arrays([values.cast(pa.string())])
    n = len(values)
    offsets = np.frombuffer(values.buffers()[1], np.int32, n + 1, offset=values.offset * 4) if n else np.zeros(1, np.int32)
    body = values.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    ends = (offsets - offsets[0]).astype(np.int64)
    if len(raw) and raw.max() >= 0x80:
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.int32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        ends = heads[ends]
    else:
        points = raw.astype(np.int32)
    lengths = np.diff(ends)
    nul = ends[:-1] + np.arange(n)
    out = np.zeros(len(points) + n, np.int32)
    keep = np.ones(len(out), bool)
    keep[nul] = False
    out[keep] = points
    return out, nul


def to_arrow(points: np.ndarray, nul: np.ndarray, null_mask: np.ndarray) -> pa.Array:
    """Rows of code points, each led by a NUL at ``nul``, as an Arrow string array."""
    n = len(nul)
    keep = np.ones(len(points), bool)
    keep[nul] = False
    body = points[keep].astype("<i4").tobytes().decode("utf-32-le").encode("utf-8")
    wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    wide[nul] = 0
    total = np.concatenate([[0], np.cumsum(wide)])
    offsets = np.concatenate([total[nul], total[-1:]]) if n else np.zeros(1, np.int64)
    if offsets[-1] > 2**31 - 1:
        raise ValueError("a batch of texts beyond 2 GB; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    valid = pa.py_buffer(np.packbits(~null_mask, bitorder="little").tobytes()) if null_mask.any() else None
    return pa.StringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(body), valid)


def _order_marks(points: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Canonical order: within each run of marks, stably by combining class."""
    marked = ccc > 0
    at = np.flatnonzero(marked)
    if len(at) < 2 or not (np.diff(at) == 1).any():
        return points
    run = np.cumsum(np.concatenate([[True], np.diff(at) != 1]))
    order = np.lexsort((ccc[at], run))
    points = points.copy()
    points[at] = points[at[order]]
    return points


def _compose(points: np.ndarray, nul_flag: np.ndarray, t: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Compose starters with what follows them; round k handles the k-th follower of every sequence at once."""
    follows = t.joins[points] & ~nul_flag
    if not follows.any():
        return points, np.ones(len(points), bool)
    points, keep = points.copy(), np.ones(len(points), bool)
    at = np.flatnonzero(follows)
    start = np.concatenate([[True], np.diff(at) != 1])
    head = at[start] - 1
    length = np.diff(np.concatenate([np.flatnonzero(start), [len(at)]]))
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    base, starter, last = head + 1, head.copy(), np.zeros(len(head), np.int16)
    adjacent = np.ones(len(head), bool)  # nothing kept between the starter and here
    for k in range(int(length[0])):
        n = int(np.searchsorted(-length, -k, side="left"))  # sequences longer than k come first
        pos, s = base[:n] + k, starter[:n]
        c = points[pos]
        ccc = t.ccc[c].astype(np.int16)
        free = np.where(ccc > 0, adjacent[:n] | ((last[:n] < ccc) & (last[:n] > 0)), adjacent[:n]) & ~nul_flag[s]
        made = np.zeros(n, np.int32)
        made[free] = t.compose(points[s][free], c[free])
        hit = made > 0
        t.learn(made[hit])
        points[s[hit]] = made[hit]
        keep[pos[hit]] = False
        miss = ~hit
        fresh = miss & (ccc == 0)
        starter[:n] = np.where(fresh, pos, s)
        adjacent[:n] = np.where(fresh, True, np.where(miss, False, adjacent[:n]))
        last[:n] = np.where(fresh, 0, np.where(miss, ccc, last[:n]))
    return points, keep


def consistent(values: pa.Array) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """The consistent form of each text and, by kind, how many odd characters each text had."""
    t, n = tables(), len(values)
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    null_mask = np.asarray(values.is_null()) if values.null_count else np.zeros(n, bool)
    points, nul = code_points(values)
    counts = {k: np.zeros(n, np.int32) for k in KINDS}
    if not n or not len(points) or points.max() < 0x80:
        return values, counts
    t.learn(points)
    odd = points >= 0x80

    def count(kind: str, flags: np.ndarray, rows: np.ndarray) -> None:
        hit = np.flatnonzero(flags)
        if len(hit):
            counts[kind] += np.bincount(rows[hit], minlength=n).astype(np.int32)

    row = np.repeat(np.arange(n), np.diff(np.concatenate([nul, [len(points)]])))
    nul_flag = np.zeros(len(points), bool)
    nul_flag[nul] = True
    for kind, table in (("wide", t.wide), ("marks", t.mark), ("invisible", t.invisible), ("spaces", t.space)):
        count(kind, table[points] & odd, row)
    gone = t.invisible[points]
    if gone.any():
        points, row, nul_flag = points[~gone], row[~gone], nul_flag[~gone]
    points = np.where(t.space[points], 0x20, points).astype(np.int32)
    signs = t.sign[points]
    grow = t.expands[points]
    if grow.any():
        lengths = np.where(grow, t.expand_len[points], 1).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        within = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        source = np.repeat(np.arange(len(points)), lengths)
        points = np.where(grow[source], t.pool[np.where(grow, t.expand_at[points], 0)[source] + np.where(grow[source], within, 0)], points[source]).astype(np.int32)
        row, nul_flag, signs = row[source], nul_flag[source], signs[source]
    double = t.double[points]
    if double.any() or signs.any():
        wordy = t.wordy[points] & ~nul_flag
        run = np.cumsum(wordy & ~np.concatenate([[False], wordy[:-1]]))
        run = np.where(wordy, run, 0)
        size = int(run.max()) + 1
        real = np.bincount(run, weights=t.latin[points] & ~signs, minlength=size) > 0
        other = np.bincount(run, weights=t.foreign[points], minlength=size) > 0
        real[0] = False
        stands = (double > 0) & real[run] & ~other[run]
        count("lookalikes", stands | (signs & real[run]), row)
        points = np.where(stands, double, points).astype(np.int32)
    points = _order_marks(points, t.ccc[points])
    points, keep = _compose(points, nul_flag, t)
    points, nul_flag = points[keep], nul_flag[keep]
    return to_arrow(points, np.flatnonzero(nul_flag), null_mask), counts


_STRUCT = T.StructType([T.StructField("form", T.StringType()), *(T.StructField(k, T.IntegerType()) for k in KINDS)])


def _in_slices(values: pa.Array) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """:func:`consistent` in slices of bounded size."""
    parts = [consistent(values.slice(a, n)) for a, n in text_slices(values)]
    if len(parts) < 2:
        return parts[0] if parts else consistent(values)
    return pa.concat_arrays([p[0] for p in parts]), {k: np.concatenate([p[1][k] for p in parts]) for k in KINDS}


@F.arrow_udf(_STRUCT)
def consistent_struct(values: pa.Array) -> pa.Array:
    form, counts = _in_slices(values)
    return pa.StructArray.from_arrays([form, *(pa.array(counts[k], pa.int32()) for k in KINDS)], ["form", *KINDS])


@F.arrow_udf(T.StringType())
def consistent_form(values: pa.Array) -> pa.Array:
    """The consistent form as a column function."""
    return _in_slices(values)[0]


def normalise(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, the consistent form of ``text_col`` as ``form`` and the count of each kind of odd character.

    One row per input row, null ids and repeated rows included; a null text has a null form and counts of 0. No shuffle.
    """
    return df.select(F.col(id_col), consistent_struct(F.col(text_col)).alias("_form")).select(id_col, "_form.form", *(F.col(f"_form.{k}").alias(f"n_{k}") for k in KINDS))


def odd_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct ids of the texts with at least one odd character."""
    odd = normalise(df, id_col, text_col)
    return odd.filter(sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}")) > 0).select(id_col).distinct()
