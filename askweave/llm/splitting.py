"""Oversized texts cut at natural boundaries (problem 9).

A token is one ideograph U+4E00 to U+9FFF, a maximal run of other letters, digits and underscores, or any other single
character that is not whitespace. The tokens of a whole Arrow batch are found at once on its code points.

Balanced targets: the least number of pieces that can hold a text gives equally spaced targets; each is snapped to the
strongest boundary nearby (paragraph, line, sentence, clause, word, then any token); where a piece then breaks the limit, one
more piece is tried. Every piece after the first begins ``overlap`` tokens before the cut that starts it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askweave.functions.arrow import text_slices
from askweave.llm.textform import LIMIT, code_points

SPACE, OTHER, WORD, IDEOGRAPH = 0, 1, 2, 3
#: Strengths of the boundary after a token.
TOKEN, BLANK, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
#: Signs that end a sentence, or a clause; those of the second string end one without a blank after them.
ENDS, ENDS_ALONE = ".!?…", "。！？"
CLAUSES, CLAUSES_ALONE = ",;:", "，；：、"
CLOSERS = "\"'”’»)]}“"
#: Words before a point that does not end a sentence.
ABBREVIATIONS = frozenset("e.g i.e etc vs cf no fig al approx dr mr mrs ms prof st z.b d.h u.a usw bzw ca nr abb vgl sr sra p.ej ej pág núm tab col".split())


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Kind of each code point: letters, marks excluded, are those of str.isalnum; an underscore is a word character."""
    kinds = np.full(LIMIT, OTHER, np.uint8)
    for c in range(0x32400):  # no letters or digits are assigned above
        ch = chr(c)
        if ch.isspace():
            kinds[c] = SPACE
        elif ch.isalnum() or ch == "_":
            kinds[c] = WORD
    kinds[0x4E00:0xA000] = IDEOGRAPH
    kinds[0] = OTHER
    return kinds


def token_bounds(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points and rows' places of :func:`code_points`; starts and ends of all tokens; each row's first token (and the end)."""
    points, nul = code_points(values)
    kind = _kinds()[points]
    if len(nul):
        kind[nul] = SPACE
    word = kind == WORD
    if len(word):
        starts = np.flatnonzero((kind != SPACE) & ~(word & np.concatenate([[False], word[:-1]])))
        ends = np.flatnonzero((kind != SPACE) & ~(word & np.concatenate([word[1:], [False]]))) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return points, nul, starts, ends, np.searchsorted(starts, np.concatenate([nul, [len(points)]]))


def _strengths(text: str, starts: np.ndarray, ends: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Strength of the boundary after each token but the last; ``starts`` and ``ends`` count within ``points`` of this text."""
    n = len(starts)
    out = np.zeros(max(n - 1, 0), np.uint8)
    if n < 2:
        return out
    gap = starts[1:] > ends[:-1]
    out[gap] = BLANK
    lines = np.concatenate([[0], np.cumsum((points == 10) | ((points == 13) & (np.concatenate([points[1:], [0]]) != 10)))])
    breaks = lines[starts[1:]] - lines[ends[:-1]]
    last = points[ends[:-1] - 1]
    single = ends[:-1] - starts[:-1] == 1
    is_in = lambda s: np.isin(last, [ord(c) for c in s]) & single
    out[is_in(CLAUSES) & gap | is_in(CLAUSES_ALONE)] = CLAUSE
    stop = is_in(ENDS) & gap | is_in(ENDS_ALONE)
    closer = np.flatnonzero(is_in(CLOSERS))
    closer = closer[closer > 0]
    stop[closer] |= gap[closer] & np.isin(points[ends[closer - 1] - 1], [ord(c) for c in ENDS + ENDS_ALONE])
    for i in np.flatnonzero(is_in(".") & gap):
        a = text.rfind(" ", 0, int(starts[i])) + 1
        before = text[a : int(starts[i])].rsplit("\n", 1)[-1].lower().lstrip("([\"'„“")
        if before in ABBREVIATIONS or len(before) == 1 and before.isalpha():
            stop[i] = False
    out[stop] = SENTENCE
    out[breaks == 1] = LINE
    out[breaks > 1] = PARAGRAPH
    return out


def _cuts(strengths: np.ndarray, n: int, limit: int, overlap: int, reach: float, pieces: int) -> list[int] | None:
    """Cuts into so many pieces; None where one of them is above the limit, or empty."""
    step = (n - overlap) / pieces
    near = int(step * reach)
    cuts, before, began = [], 0, 0
    for j in range(1, pieces):
        target = overlap + step * j
        a, z = max(before + 1, int(target) - near, overlap + 1), min(n - 1, int(target) + near)
        if a > z:
            a = z = min(max(before + 1, int(target)), n - 1)
        own = strengths[a - 1 : z].astype(np.int64)
        away = np.abs(np.arange(a, z + 1) - target)
        cut = a + int(np.lexsort((away, -own))[0])
        if cut <= before or cut - began > limit:
            return None
        cuts.append(cut)
        before, began = cut, max(0, cut - overlap)
    return cuts if before < n and n - began <= limit else None


def balanced_cuts(strengths: np.ndarray, n: int, limit: int, overlap: int, reach: float = 0.125) -> list[int]:
    """Token numbers at which a text of ``n`` > ``limit`` tokens is cut: piece j is [cut(j-1) - overlap, cut(j)).

    Where the least number of pieces fails, numbers further off are tried in steps that double, then those between by halves, so the cost
    grows with the text, not with its square. Pieces that each go on by one token always keep the limit.
    """
    least = max(2, -(-(n - overlap) // (limit - overlap)))
    bad, more = least - 1, 1
    good, cuts = least, _cuts(strengths, n, limit, overlap, reach, least)
    while cuts is None:
        bad, good, more = good, min(good + more, n - overlap), more * 2
        cuts = _cuts(strengths, n, limit, overlap, reach, good)
    while good - bad > 1:
        middle = (bad + good) // 2
        found = _cuts(strengths, n, limit, overlap, reach, middle)
        if found is None:
            bad = middle
        else:
            good, cuts = middle, found
    return cuts


def _split(limit: int, overlap: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(a, n) for x in batches for a, n in text_slices(x.column(1))):
            values = b.column(1)
            points, nul, starts, ends, first = token_bounds(values)
            sizes = np.diff(first)
            row, piece, pieces, begin, end, tokens, parts = [], [], [], [], [], [], []
            for i in range(b.num_rows):
                n, base = int(sizes[i]), int(nul[i]) + 1
                text = values[i].as_py() if texts or n > limit else None
                if n <= limit:
                    size = int(nul[i + 1] if i + 1 < len(nul) else len(points)) - base
                    row.append(i), piece.append(0), pieces.append(1), begin.append(0), end.append(size), tokens.append(n), parts.append(text)
                    continue
                own = slice(int(first[i]), int(first[i + 1]))
                s, e = starts[own] - base, ends[own] - base
                size = len(text)
                cuts = balanced_cuts(_strengths(text, s, e, points[base : base + size]), n, limit, overlap)
                edges = [0, *cuts, n]
                for k, (a, z) in enumerate(zip(edges, edges[1:])):
                    a = a - overlap if k else 0
                    # A piece runs up to the next token, so that nothing between tokens is lost.
                    from_, to = (int(s[a]) if k else 0), (int(s[z]) if z < n else size)
                    row.append(i), piece.append(k), pieces.append(len(cuts) + 1), begin.append(from_), end.append(to), tokens.append(z - a), parts.append(text[from_:to] if texts else None)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int32()) for x in (piece, pieces, begin, end, tokens)), pa.array(parts, pa.string())], ["_id", "piece", "pieces", "char_start", "char_end", "tokens", "text"])

    return run


def split_texts(df: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 32, texts: bool = True) -> DataFrame:
    """Pieces of all texts: ``id_col``, ``piece`` from 0, ``pieces``, ``char_start``, ``char_end``, ``tokens`` and, if ``texts``, ``text``.

    Texts within the limit, empty ones included, are one piece as they are; null texts give none. The pieces of a text cover it
    wholly. Repeated rows are cut each. Texts of no more characters than ``limit`` never leave the JVM. No shuffle.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    own = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text is not null")
    kind = own.schema["_id"].dataType.simpleString()
    n = F.length("_text")
    long = own.filter(n > limit).mapInArrow(_split(limit, overlap, texts), f"_id {kind}, piece int, pieces int, char_start int, char_end int, tokens int, text string")
    size = F.size(F.regexp_extract_all("_text", F.lit(r"([一-鿿]|(?:(?![一-鿿])[\p{L}\p{N}_])+|[^\s\p{Z}\x1c-\x1f\x85])"), 1))
    short = own.filter(n <= limit).select("_id", F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).alias("char_start"), n.alias("char_end"), size.alias("tokens"), (F.col("_text") if texts else F.lit(None).cast("string")).alias("text"))
    out = long.unionByName(short).withColumnRenamed("_id", id_col)
    return out if texts else out.drop("text")


def oversized(df: DataFrame, id_col: str, text_col: str, limit: int = 512, overlap: int = 32) -> DataFrame:
    """Distinct ids of the texts that :func:`split_texts` cuts."""
    own = df.filter(F.length(text_col) > limit)  # fewer characters than the limit are never more tokens
    return split_texts(own, id_col, text_col, limit, overlap, texts=False).filter("pieces > 1").select(id_col).distinct()
