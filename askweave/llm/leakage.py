"""Held-out passages inside a large corpus (problem 8).

The words of the test items go into a generalised suffix automaton, kept in flat arrays. The words of each document are streamed
through it; after each word the length of the longest match that ends there is known, and where it reaches the limit the state
names the items that have the last ``min_words`` words. A match of that length can only lie in a run of words all of
which occur in some item, so words outside such runs are not walked. Matched runs can be reported, or removed.

Items of fewer than ``min_words`` words, but ``short_words`` at least, count where they stand whole; still shorter ones are no passages.
Items of equal words are one class in all that follows and are told apart at the end.

Items of up to ``block_words`` words altogether are one automaton, which goes to the tasks with a single pass over the corpus. More
items are cut into blocks of that size. The corpus is still read once: a bit filter over the hashes of the items' windows, of at most
``FILTER_BYTES`` whatever their number, leaves the documents that may have one; those meet the blocks of their windows by a join on
the hash, and each task streams the documents of a block, or of a share of it, through an automaton that it builds itself.

Words are runs of letters and digits, lower-cased; all else only separates. Null texts and texts without words match nothing.
Repeated items and documents are reported each.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from askweave.operators.skew import join_salted
from askweave.storage import SharedTables

WORD = re.compile(r"[^\W_]+")
FILTER_BYTES = 64 << 20
#: Documents of a block that a task takes.
SHARE_ROWS = 20_000
#: Items up to which their names go to all tasks.
SMALL_ITEMS = 200_000


def words_of(text: str) -> list[str]:
    """The words of a text; lower case comes after cutting, which only matters where it changes the length."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


class Automaton:
    """Generalised suffix automaton over word lists: two integers a state for its first transition, a table only where it branches."""

    def __init__(self, items: list[list[str]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        lists = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws] for ws in items]
        for ws in lists:
            state = 0
            for w in ws:
                state = self._extend(state, w)
        self._name(lists)

    # -- construction --------------------------------------------------------------------------------------------

    def step(self, state: int, w: int) -> int:
        if self.word[state] == w:
            return self.to[state]
        branches = self.more.get(state)
        return -1 if branches is None else branches.get(w, -1)

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] in (-1, w):
            self.word[state], self.to[state] = w, to
        else:
            self.more.setdefault(state, {})[w] = to

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1), self.to.append(-1), self.link.append(link), self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The part of state ``q`` that the suffixes of ``p`` reach, as a state of its own."""
        c = self._state(self.length[p] + 1, self.link[q])
        self.word[c], self.to[c] = self.word[q], self.to[q]
        if q in self.more:
            self.more[c] = dict(self.more[q])
        self.link[q] = c
        while p >= 0 and self.step(p, w) == q:
            self._set(p, w, c)
            p = self.link[p]
        return c

    def _extend(self, last: int, w: int) -> int:
        q = self.step(last, w)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and self.step(p, w) < 0:
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            q = self.step(p, w)
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def _name(self, lists: list[list[int]]) -> None:
        """Which items the states stand for."""
        least, link, length = self.min_words, self.link, self.length
        #: The one suffix of each state that stands for its last ``min_words`` words; -1 where the state is shorter.
        self.entry = entry = array("i", [-1]) * len(link)
        order = np.argsort(np.frombuffer(length, np.int32), kind="stable")[1:].tolist()
        for s in order:
            if length[s] >= least:
                entry[s] = s if length[link[s]] < least else entry[link[s]]
        owners: dict[int, list[int]] = {}
        #: Of each item, the entry states of its windows; of short items none.
        self.windows: list[np.ndarray] = []
        #: Of states at which a short item ends: those items. ``above``: the next such state among the suffixes.
        self.ends: dict[int, list[int]] = {}
        self.sizes = [len(ws) for ws in lists]
        for i, ws in enumerate(lists):
            state, own = 0, []
            for n, w in enumerate(ws, 1):
                state = self.step(state, w)
                if n >= least:
                    s = state
                    while length[link[s]] >= n:
                        s = link[s]
                    own.append(entry[s])
            for e in dict.fromkeys(own):
                owners.setdefault(e, []).append(i)
            if 0 < len(ws) < least:
                while length[link[state]] >= len(ws):
                    state = link[state]
                self.ends.setdefault(state, []).append(i)
            self.windows.append(np.array(own, np.int32))
        self.above: array | None = None
        if self.ends:
            self.above = array("i", [-1]) * len(link)
            for s in order:
                self.above[s] = link[s] if link[s] in self.ends else self.above[link[s]]
        groups: dict[tuple[int, ...], int] = {}
        #: Entries with the same items have one number, so that a passage that many items share is counted once.
        self.group = {e: groups.setdefault(tuple(x), len(groups)) for e, x in owners.items()}
        self.groups = list(groups)
        self.least = min((n for n in self.sizes if n), default=least) if self.ends else least

    # -- matching --------------------------------------------------------------------------------------------------

    def in_text(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """Place, length and state of the longest match after each word, where it has ``least`` words and more."""
        least = self.least
        if len(words) < least:
            return
        code = self.vocabulary.get
        codes = [code(w, -1) for w in words]
        outside = np.flatnonzero(np.concatenate([[True], np.array(codes) < 0, [True]]))
        step, link, length = self.step, self.link, self.length
        for k in np.flatnonzero(np.diff(outside) > least):
            a, z = int(outside[k]), int(outside[k + 1]) - 1
            state = matched = 0
            for at in range(a, z):
                w = codes[at]
                to = step(state, w)
                while to < 0 and state:
                    state = link[state]
                    matched = length[state]
                    to = step(state, w)
                if to < 0:
                    continue
                state = to
                matched += 1
                if matched >= least:
                    yield at, matched, state

    def ends_of(self, words: list[str]) -> tuple[dict[int, list[int]], dict[int, list[int]], set[int]]:
        """Last words of the windows found, by group of items; of short items, by item; and the entries met."""
        long: dict[int, list[int]] = {}
        short: dict[int, list[int]] = {}
        met: set[int] = set()
        for at, matched, state in self.in_text(words):
            if matched >= self.min_words:
                e = self.entry[state]
                met.add(e)
                long.setdefault(self.group[e], []).append(at)
            if self.above is not None:
                for i in self.ends.get(state, ()):
                    if self.sizes[i] <= matched:
                        short.setdefault(i, []).append(at)
                s = self.above[state]
                while s > 0:
                    for i in self.ends[s]:
                        short.setdefault(i, []).append(at)
                    s = self.above[s]
        return long, short, met

    def found(self, words: list[str]) -> list[tuple[int, int, int, int, int, int]]:
        """Item, first word, longest run, windows, words of the text and words of the item in windows, for every item found."""
        long, short, met = self.ends_of(words)
        out, held = [], {}
        items: dict[int, list[int]] = {}
        for g in long:
            for i in self.groups[g]:
                items.setdefault(i, []).append(g)
        entries = np.fromiter(met, np.int32, len(met))
        for i, gs in items.items():
            key = tuple(gs)
            if key not in held:
                held[key] = _stretch(np.sort(np.concatenate([np.array(long[g]) for g in gs])), self.min_words)
            covered = np.flatnonzero(np.isin(self.windows[i], entries))
            out.append((i, *held[key], _stretch(covered + self.min_words - 1, self.min_words)[3]))
        for i, at in short.items():
            out.append((i, *_stretch(np.array(at), self.sizes[i]), self.sizes[i]))
        return out

    def spans(self, words: list[str]) -> list[int]:
        """Start, end (exclusive) and so on of every run of words that lies in windows."""
        long, short, _ = self.ends_of(words)
        own = sorted([(a - self.min_words + 1, a + 1) for x in long.values() for a in x] + [(a - self.sizes[i] + 1, a + 1) for i, x in short.items() for a in x])
        return _merged(own)


def _merged(own: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, z in own:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], z)
        else:
            out += [a, z]
    return out


def _stretch(ends: np.ndarray, n: int) -> tuple[int, int, int, int]:
    """First word, longest run of windows in a row, their number, and the words in them, of windows of ``n`` words that end at the given places."""
    gaps = np.diff(ends)
    cuts = np.concatenate([[-1], np.flatnonzero(gaps > 1), [len(ends) - 1]])
    return int(ends[0]) - n + 1, int(np.diff(cuts).max()) + n - 1, len(ends), int(np.minimum(gaps, n).sum()) + n


_FOUND = "doc_words long, _ref long, first_word long, longest long, windows long, leaked_words long, item_covered long"


def _report(doc: object, words: list[str], automaton: Automaton, refs: list[int]) -> Iterator[tuple]:
    for i, *numbers in automaton.found(words):
        yield (doc, len(words), refs[i], *numbers)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c, pa.int64()) for c in cols[1:])], ["_doc", *(x.split()[0] for x in _FOUND.split(", "))])


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, refs = held.value
        for b in batches:
            rows = [r for doc, text in zip(b.column(0), b.column(1).to_pylist()) for r in _report(doc.as_py(), words_of(text), automaton, refs)]
            if rows:
                yield _batch(rows, b.schema.field(0).type)

    return run


def _without(text: str | None, spans: list[int] | None, max_coverage: float) -> tuple[int, str | None]:
    """Words that leaked, and the text without them; null above ``max_coverage``."""
    if text is None or not spans:
        return 0, text
    places = [m.span() for m in WORD.finditer(text)]
    gone = sum(z - a for a, z in zip(spans[::2], spans[1::2]))
    if gone > max_coverage * len(places):
        return gone, None
    kept, at = [], 0
    for a, z in zip(spans[::2], spans[1::2]):
        kept.append(text[at : places[a][0]])
        at = places[z - 1][1]
    return gone, "".join(kept) + text[at:]


def _kept(docs: pa.Array, found: list[tuple[int, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([docs, pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.string())], ["_doc", "leaked_words", "kept_text"])


def _scrub(held, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, _ = held.value
        for b in batches:
            yield _kept(b.column(0), [_without(t, automaton.spans(words_of(t or "")), max_coverage) for t in b.column(1).to_pylist()])

    return run


# -- more items than one automaton holds -----------------------------------------------------------------------------

_STEP = np.uint64(0x9E3779B97F4A7C15)


def window_hashes(words: list[str], sizes: list[int]) -> np.ndarray:
    """Hashes of all runs of each of the given numbers of words."""
    own = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    total, out = np.zeros(len(words), np.uint64), []
    for n in range(1, max(sizes, default=0) + 1):
        if n > len(words):
            break
        # total[i]: the hash of the n words from i on
        total = total[: len(words) - n + 1] * _STEP + own[n - 1 :]
        if n in sizes:
            out.append((total ^ (total >> np.uint64(29))) * _STEP + np.uint64(n))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _item_windows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ws in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h = np.unique(window_hashes(ws, [min(min_words, len(ws))])).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), block, np.int64))], ["_h", "_block"])

    return run


def _bits(bits: int):
    """Bit maps of the hashes of each task; those of all tasks are merged by a bitwise or."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << bits, bool)
        for b in batches:
            own[(b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(own)
        places = np.flatnonzero(packed.reshape(-1, min(4096, len(packed))).any(axis=1))
        rows = [packed.reshape(-1, min(4096, len(packed)))[p].tobytes() for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32)), pa.array(rows, pa.binary())], ["_part", "_bits"])

    return run


def _ored(table: pa.Table) -> pa.Table:
    own = np.bitwise_or.reduce([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("_bits")])
    return pa.table({"_part": table.column("_part").slice(0, 1), "_bits": pa.array([own.tobytes()], pa.binary())})


def _sieve(held, bits: int, sizes: list[int], keep: bool):
    """Documents with windows in the filter, and those windows; or, with ``keep`` unset, all other documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = np.unpackbits(held.value).view(bool)
        for b in batches:
            hits = []
            for text in b.column("_text").to_pylist():
                h = window_hashes(words_of(text), sizes) if text else np.zeros(0, np.uint64)
                hits.append(np.unique(h[filled[(h >> np.uint64(64 - bits)).astype(np.int64)]]).view(np.int64) if len(h) else h.view(np.int64))
            own = pa.array([(len(x) > 0) == keep for x in hits])
            b = b.append_column("_hits", pa.array(hits, pa.list_(pa.int64()))).filter(own) if keep else b.filter(own)
            if b.num_rows:
                yield b

    return run


def _by_block(min_words: int, spans: bool):
    """Rows sorted by block, its items (without ``_row``) before its documents: one automaton at a time, made where it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, items, refs, automaton = None, [], [], None
        for b in batches:
            out: list[tuple] = []
            for own, ref, ws, row, text in zip(*(b.column(n).to_pylist() for n in ("_block", "_class", "_words", "_row", "_text"))):
                if own != block:
                    block, items, refs, automaton = own, [], [], None
                if row is None:
                    if automaton is not None:  # the same block's next share on this task
                        items, refs, automaton = [], [], None
                    items.append(ws), refs.append(ref)
                    continue
                automaton = automaton or Automaton(items, min_words)
                words = words_of(text)
                if not spans:
                    out += _report(row, words, automaton, refs)
                elif found := automaton.spans(words):
                    out.append((row, found))
            if not out:
                continue
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int32()))], ["_row", "_spans"])
            else:
                yield _batch(out, pa.int64()).rename_columns(["_row", *(x.split()[0] for x in _FOUND.split(", "))])

    return run


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(values: pa.Array) -> pa.Array:
    return pa.array([None if t is None else words_of(t) for t in values.to_pylist()], pa.list_(pa.string()))


class Items:
    """Test items as classes of equal words; ``held`` is their automaton, broadcast, or None where they are more than ``block_words``."""

    def __init__(self, items: DataFrame, item_col: str, text_col: str, min_words: int, short_words: int, block_words: int):
        self.spark, self.min_words, self.tables = items.sparkSession, min_words, SharedTables(items.sparkSession, "leaks")
        own = items.select(F.col(item_col).alias("_item"), F.col(text_col).alias("_text")).filter("_item is not null and _text is not null")
        own = own.withColumn("_words", _words("_text")).filter(F.size("_words") >= min(short_words, min_words)).drop("_text")
        own = self.tables.write(own.withColumn("_class", F.xxhash64("_words")))
        self.names = own.select("_item", "_class", F.size("_words").cast("long").alias("item_words")).distinct()
        classes = own.groupBy("_class").agg(F.any_value("_words").alias("_words"))
        self.classes = self.tables.write(classes.withColumn("_n", F.size("_words")))
        whole = self.classes.agg(F.sum("_n")).first()[0] or 0
        self.held = None
        if whole <= block_words:
            rows = self.classes.orderBy("_class").select("_class", "_words").collect()  # one block at most
            self.held = self.spark.sparkContext.broadcast((Automaton([r[1] for r in rows], min_words), [r[0] for r in rows]))
            return
        # By running size within hash buckets, so that no task orders all items.
        buckets = max(1, whole // block_words)
        run = F.sum("_n").over(Window.partitionBy("_bucket").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1))
        part = F.floor(F.coalesce(run, F.lit(0)) / block_words)
        self.classes = self.tables.write(self.classes.withColumn("_bucket", F.pmod("_class", F.lit(buckets))).select("_class", "_words", "_n", (F.col("_bucket") * 1_000_000 + part).cast("long").alias("_block")))
        self.windows = self.tables.write(self.classes.select("_block", "_words").mapInArrow(_item_windows(min_words), "_h long, _block long").distinct())
        self.sizes = sorted({min_words, *(r[0] for r in self.classes.filter(F.col("_n") < min_words).select("_n").distinct().collect())})  # min_words values at most
        self.bits = min((FILTER_BYTES * 8).bit_length() - 1, max(10, math.ceil(math.log2(16 * self.windows.count()))))
        parts = self.windows.select("_h").coalesce(self.spark.sparkContext.defaultParallelism).mapInArrow(_bits(self.bits), "_part int, _bits binary").groupBy("_part").applyInArrow(_ored, "_part int, _bits binary")
        filled = np.zeros(1 << self.bits >> 3, np.uint8).reshape(-1, min(4096, 1 << self.bits >> 3))
        for p, x in parts.toLocalIterator():  # FILTER_BYTES at most
            filled[p] = np.frombuffer(x, np.uint8)
        self.filter = self.spark.sparkContext.broadcast(filled.reshape(-1))

    def sieved(self, docs: DataFrame, keep: bool) -> DataFrame:
        """Of ``_doc`` and ``_text``: rows that may have a window, with a ``_row`` of their own and ``_hits``; or the others."""
        kind = docs.schema["_doc"].dataType.simpleString()
        if keep:
            rows = docs.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_sieve(self.filter, self.bits, self.sizes, True), f"_doc {kind}, _text string, _row long, _hits array<long>")
            return self.tables.write(rows)
        return docs.mapInArrow(_sieve(self.filter, self.bits, self.sizes, False), f"_doc {kind}, _text string")

    def matched(self, rows: DataFrame, spans: bool) -> DataFrame:
        """The rows of :meth:`sieved` against the blocks that share a window with them."""
        hits = rows.select("_row", F.explode("_hits").alias("_h"))
        met = self.tables.write(join_salted(hits, self.windows, "_h", hits.count()).select("_row", "_block").distinct())
        shares = met.groupBy("_block").agg(F.ceil(F.count(F.lit(1)) / SHARE_ROWS).cast("int").alias("_shares"))
        shares = self.tables.write(shares)
        tasks = max(self.spark.sparkContext.defaultParallelism, shares.agg(F.sum("_shares")).first()[0] or 0)
        docs = met.join(F.broadcast(shares), "_block") if shares.count() <= SMALL_ITEMS else met.join(shares, "_block")
        docs = docs.select("_row", "_block", F.pmod(F.xxhash64("_row"), F.col("_shares")).cast("int").alias("_share")).join(rows.select("_row", "_text"), "_row")
        items = self.classes.join(shares, "_block").select("_block", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"), "_class", "_words")
        both = items.unionByName(docs, allowMissingColumns=True)
        ordered = both.repartition(min(tasks, 100_000), "_block", "_share").sortWithinPartitions("_block", "_share", F.col("_row").asc_nulls_first())
        return ordered.mapInArrow(_by_block(self.min_words, spans), "_row long, _spans array<int>" if spans else f"_row long, {_FOUND}")

    def named(self, found: DataFrame) -> DataFrame:
        """Each class found as all of its items."""
        names = self.names.withColumnRenamed("_class", "_ref")
        if names.count() <= SMALL_ITEMS:
            return found.join(F.broadcast(names), "_ref")
        found = self.tables.write(found)
        return join_salted(found, names, "_ref", found.count())


def leaks(corpus: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, min_words: int = 13, short_words: int = 5, block_words: int = 500_000) -> DataFrame:
    """``doc_col`` and ``item_col`` of every document that shares ``min_words`` consecutive words or more with an item, or has a short item whole.

    With each pair: ``doc_words`` and ``item_words``; of the windows of ``min_words`` words that both have, where they are in the document:
    their number ``windows``, the first word ``first_word`` of the first, the words ``leaked_words`` in them and the longest run ``longest`` of
    words of which every window is one; and the words ``item_covered`` of the item in them. A repeated document gives each row again.
    """
    own = Items(items, item_col, item_text_col, min_words, short_words, block_words)
    docs = corpus.select(F.col(doc_col).alias("_doc"), F.col(text_col).alias("_text")).filter("_doc is not null and _text is not null")
    if own.held is not None:
        found = docs.mapInArrow(_scan(own.held), f"_doc {docs.schema['_doc'].dataType.simpleString()}, {_FOUND}")
    else:
        rows = own.sieved(docs, keep=True)
        found = own.matched(rows, spans=False).join(rows.select("_row", "_doc"), "_row").drop("_row")
    return own.named(found).select(F.col("_doc").alias(doc_col), F.col("_item").alias(item_col), "doc_words", "item_words", "first_word", "longest", "windows", "leaked_words", "item_covered")


def scrubbed(corpus: DataFrame, items: DataFrame, doc_col: str, text_col: str, item_col: str, item_text_col: str, min_words: int = 13, max_coverage: float = 0.5, short_words: int = 5, block_words: int = 500_000) -> DataFrame:
    """The corpus without what leaked: ``doc_col``, ``leaked_words`` and ``kept_text``.

    Every run of words that lies in windows of an item (or is a short item) is removed, from its first to its last word; all else
    stays as it is. A document of which more than ``max_coverage`` of the words leaked has a null ``kept_text``, as have null texts. One
    row per input row. Only documents with a leak are shuffled, and those only where the items are more than ``block_words``.
    """
    own = Items(items, item_col, item_text_col, min_words, short_words, block_words)
    kind = f"_doc {corpus.schema[doc_col].dataType.simpleString()}, leaked_words int, kept_text string"
    docs = corpus.select(F.col(doc_col).alias("_doc"), F.col(text_col).alias("_text"))
    if own.held is not None:
        out = docs.mapInArrow(_scrub(own.held, max_coverage), kind)
    else:
        rows = own.sieved(docs, keep=True)
        spans = own.matched(rows, spans=True).groupBy("_row").agg(F.flatten(F.collect_list("_spans")).alias("_spans"))
        hit = rows.select("_row", "_doc", "_text").join(spans, "_row", "left").select("_doc", "_text", "_spans").mapInArrow(_cut(max_coverage), kind)
        out = hit.unionByName(own.sieved(docs, keep=False).select("_doc", F.lit(0).alias("leaked_words"), F.col("_text").alias("kept_text")))
    return out.select(F.col("_doc").alias(doc_col), "leaked_words", "kept_text")


def _cut(max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_merged(sorted(zip(s[::2], s[1::2]))) if s else None for s in b.column(2).to_pylist()]
            yield _kept(b.column(0), [_without(t, s, max_coverage) for t, s in zip(b.column(1).to_pylist(), spans)])

    return run
