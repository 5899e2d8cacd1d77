"""Records that differ in formatting only, collapsed to one each (problem 2).

Every record has a 64-bit hash of its canonical fields. Each task turns the hashes that it sees once and those that
it sees repeatedly into a segmented Bloom filter; the filters of all tasks are merged per segment, a place
met by two tasks counting as repeated. Only records whose every place is marked repeated are shuffled, as
(id, digest), and grouped exactly; all others are singletons without having moved.

A task's share of a segment is sent as 4 bytes a distinct hash, of which the places follow, or as two bit maps where those are
smaller. The merged filter goes to the shared folder and is read by the tasks that need it, never through the driver. Its
size is known beforehand, ``bits_per_row`` bits a record. A filter above ``max_filter_bytes`` is made in passes, however many, each
for a range of hashes; records are kept in the order of their ranges, so that a pass reads its own only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askweave.operators.skew import join_counted
from askweave.storage import SharedTables

HASHES = 3
SEGMENT_BITS = 22
CHUNK = 1 << 20
#: Ranges of hashes that records are kept in the order of.
RANGES = 1 << 12


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """``HASHES`` places below 2**bits for each hash of 32 bits."""
    h = hashes.astype(np.uint64)
    out = np.empty((HASHES, len(h)), np.uint32)
    for i in range(HASHES):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[i] = (z >> np.uint64(64 - bits)).astype(np.uint32)
    return out


def _segments(hashes: np.ndarray, segments: int) -> np.ndarray:
    return (hashes.astype(np.uint64) % np.uint64(segments)).astype(np.int64)


def _short(hashes: np.ndarray, segments: int) -> np.ndarray:
    """32 bits of each hash, of those that do not name its segment; equal ones only make a place look repeated."""
    return (hashes.astype(np.uint64) // np.uint64(segments)).astype(np.uint32)


def _map(places: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[places] = True
    return out


def _seen(segments: int, bits: int):
    """``once`` and ``again`` of each segment: short hashes, or, where ``maps``, bit maps of their places."""
    room = (1 << bits) // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(parts), return_counts=True)
            where, short = _segments(found, segments), _short(found, segments)
            order = np.argsort(where, kind="stable")
            cuts = np.searchsorted(where[order], np.arange(segments + 1))
            rows = []
            for s in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[s] : cuts[s + 1]]
                once, again = short[own], short[own[times[own] > 1]]
                if 4 * (len(once) + len(again)) > 2 * room:
                    places = _places(once, bits).ravel()
                    met = np.bincount(places, minlength=1 << bits)
                    rows.append((s, True, np.packbits(met > 0).tobytes(), np.packbits((met > 1) | _map(_places(again, bits).ravel(), bits)).tobytes()))
                else:
                    rows.append((s, False, np.sort(once).tobytes(), np.sort(again).tobytes()))
            kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["segment", "maps", "once", "again"])

        held: list[np.ndarray] = []
        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy())
            if sum(map(len, held)) >= CHUNK:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return run


def _merge(bits: int):
    def run(table: pa.Table) -> pa.Table:
        once, again = np.zeros(1 << bits, bool), np.zeros(1 << bits, bool)
        for maps, a, b in zip(table.column("maps").to_pylist(), table.column("once"), table.column("again")):
            if maps:
                new, twice = (np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8)).view(bool) for x in (a, b))
            else:
                places = _places(np.frombuffer(a.as_buffer(), np.uint32), bits).ravel()
                new, twice = _map(places, bits), _map(_places(np.frombuffer(b.as_buffer(), np.uint32), bits).ravel(), bits)
                twice |= np.bincount(places, minlength=1 << bits) > 1
            again |= once & new | twice
            once |= new
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([np.packbits(again).tobytes()], pa.binary())})

    return run


@lru_cache(2)
def _read_filter(path: str, fetched: bool, segments: int, bits: int) -> np.ndarray:
    import pyarrow.dataset as ds
    from pyspark import SparkFiles

    out = np.zeros((segments, max(1, (1 << bits) // 8)), np.uint8)
    for batch in ds.dataset(SparkFiles.get(path) if fetched else path, format="parquet").to_batches(batch_size=16):
        for s, b in zip(batch.column("segment").to_pylist(), batch.column("bits")):
            out[s] = np.frombuffer(b.as_buffer(), np.uint8)
    return out


def _probe(path: str, fetched: bool, segments: int, bits: int):
    def run(values: pa.Array) -> pa.Array:
        filled, hashes = _read_filter(path, fetched, segments, bits), values.to_numpy(zero_copy_only=False)
        where, hit = _segments(hashes, segments), np.ones(len(hashes), bool)
        for p in _places(_short(hashes, segments), bits):
            hit &= (filled[where, p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
        return pa.array(hit)

    return F.arrow_udf(run, T.BooleanType())


def _reachable(df: DataFrame, path: str, fetch: bool = False) -> tuple[str, bool]:
    """Where workers find a folder of the shared file system: at its path, or, where that is no mounted one, fetched by each executor itself."""
    context = df.sparkSession.sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(p).toUri()
    if full.getScheme() == "file" and not fetch:
        return full.getPath(), False
    context.addFile(full.toString(), recursive=True)
    return full.getPath().rstrip("/").rpartition("/")[2], True


def hash_range(h: Column) -> Column:
    """The range of a hash, of ``RANGES``."""
    return F.shiftrightunsigned(h, 64 - RANGES.bit_length() + 1).cast("int")


def possible_repeats(df: DataFrame, hash_col: str, range_col: str, tables: SharedTables, bits_per_row: int = 12, max_filter_bytes: int = 128 << 20, fetch: bool = False) -> DataFrame:
    """``df`` with ``_maybe``: false only where no other row has the same hash. A null hash is never a repeat.

    ``range_col`` is the hash's :func:`hash_range`. With ``fetch`` executors fetch the filter even where they could read it in place.
    """
    rows = df.filter(F.col(hash_col).isNotNull()).count()
    passes = min(RANGES, max(1, math.ceil(rows * bits_per_row / 8 / max_filter_bytes)))
    bits = min(SEGMENT_BITS, max(10, math.ceil(math.log2(max(1, rows * bits_per_row / passes)))))
    segments = max(1, math.ceil(rows * bits_per_row / passes / (1 << bits)))
    out = df.filter(F.col(hash_col).isNull()).withColumn("_maybe", F.lit(False))
    for k in range(passes):
        part = df.filter(F.col(hash_col).isNotNull())
        if passes > 1:
            part = part.filter((F.col(range_col) >= k * RANGES // passes) & (F.col(range_col) < (k + 1) * RANGES // passes))
        seen = part.select(hash_col).mapInArrow(_seen(segments, bits), "segment long, maps boolean, once binary, again binary")
        merged = tables.write(seen.groupBy("segment").applyInArrow(_merge(bits), "segment long, bits binary"))
        out = out.unionByName(part.withColumn("_maybe", _probe(*_reachable(df, merged._askweave_path, fetch), segments, bits)(F.col(hash_col))))
    return out


class Copies:
    """Groups of records that are the same in all ``keys``; a record with a null in ``required`` has no copies.

    ``keys`` are columns of canonical text; a null key is a value of its own. Empty texts are equal to each other. Rows with a null
    id take part in a group's count, never as its first record unless all of its ids are null. Repeated rows are copies. An
    empty table has no groups. Other columns of ``df`` are not looked at, whatever their names.
    """

    def __init__(self, df: DataFrame, id_col: str, keys: list[Column], required: Column | None = None, **filter_options: float):
        self.id_col = id_col
        canon = df.select(F.col(id_col).alias("_id"), (F.lit(True) if required is None else required.isNotNull()).alias("_may"), *(k.alias(f"_k{i}") for i, k in enumerate(keys)))
        parts = [F.coalesce(F.concat(F.lit("="), F.col(f"_k{i}")), F.lit("-")) for i in range(len(keys))]
        keyed = canon.select("_id", F.when(F.col("_may"), F.concat_ws("\x1f", *parts)).alias("_key"))
        keyed = keyed.select("_id", F.when(F.col("_key").isNotNull(), F.xxhash64("_key")).alias("_h"), F.unhex(F.sha2("_key", 256)).alias("_digest"))
        self.tables = SharedTables(df.sparkSession, "copies")
        # Canonical forms are made once; what is kept of them is 52 bytes a record.
        keyed = self.tables.write(keyed.withColumn("_range", hash_range(F.col("_h"))).sortWithinPartitions("_range"))
        flagged = possible_repeats(keyed, "_h", "_range", self.tables, **filter_options)
        self.records = self.tables.write(flagged.select("_id", F.when(F.col("_maybe"), F.col("_digest")).alias("_digest")))
        self.tables.drop(keyed)
        self.maybe = self.records.filter("_digest is not null")

    def groups(self) -> DataFrame:
        """``_digest``, first id and size of each exact group of two or more."""
        return self.maybe.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")

    def members(self, hot: int = 100_000) -> DataFrame:
        """``first_<id>`` and ``<id>`` of every record that is not the first of its group.

        Groups of ``hot`` records and more reach them by a broadcast of bounded size, the others by a shuffled join.
        """
        groups = self.tables.write(self.groups())
        joined = join_counted(self.maybe, groups, "_digest", "_n", self.maybe.count(), hot)
        return joined.filter(F.col("_id") != F.col("_first")).select(F.col("_first").alias(f"first_{self.id_col}"), F.col("_id").alias(self.id_col)).distinct()

    def collapsed(self) -> DataFrame:
        """One row per group, with its first id and ``copies``, the number of its records; singletons have 1.

        Records that the filter cleared pass straight through; the others are grouped by digest, partially before the shuffle.
        """
        one = self.records.filter("_digest is null").select(F.col("_id").alias(self.id_col), F.lit(1).cast("long").alias("copies"))
        return one.unionByName(self.maybe.groupBy("_digest").agg(F.min("_id").alias(self.id_col), F.count(F.lit(1)).alias("copies")).select(self.id_col, "copies"))
