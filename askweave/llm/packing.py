"""Fixed-capacity containers filled with whole texts (problem 7).

Sizes are tokens of a public tokenizer, counted once on the executors; from then on only (id, size) moves. Texts beyond the
capacity are cut: full containers, and a rest that is an item like any other. Items are dealt to blocks of bounded size by
hash, so blocks have like mixes of sizes, and each block is packed in one task by large-item matching: an item above a third of
the capacity shares a container with at most one other such item, found greedily as the largest that still fits; smaller
items then go, largest first, into the container with the least room that takes them.
"""

from __future__ import annotations

import base64
import math
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askweave.storage import SharedTables

TOKENIZER = os.environ.get("ASKWEAVE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Rows of one id and size that are dealt out together.
RUN = 100_000


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("askweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str = TOKENIZER, pattern: str = PATTERN):
    """A column function: tokens of each text, whole; null texts have none (null)."""

    def run(values: pa.Array) -> pa.Array:
        encode = _encoding(path, pattern).encode_ordinary
        return pa.array([None if s is None else len(encode(s)) for s in values.to_pylist()], pa.int64())

    return F.arrow_udf(run, T.LongType())


class _Rooms:
    """Open containers by free room: a bit per room that is in use, so the tightest fit is a bit operation."""

    def __init__(self) -> None:
        self.used, self.by_room = 0, {}

    def add(self, room: int, bin_: int) -> None:
        if room > 0:
            self.by_room.setdefault(room, []).append(bin_)
            self.used |= 1 << room

    def take(self, size: int) -> tuple[int, int] | None:
        """The container with the least room of at least ``size``."""
        above = self.used >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        bins = self.by_room[room]
        bin_ = bins.pop()
        if not bins:
            del self.by_room[room]
            self.used ^= 1 << room
        return room, bin_


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; every size is from 1 to ``capacity``."""
    out = np.full(len(sizes), -1, np.int64)
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    large = [int(i) for i in order if 3 * sizes[i] > capacity]
    bins, rooms = 0, _Rooms()
    # Large items wait by size; each, largest first, takes the largest other one that fits beside it.
    waiting: dict[int, list[int]] = {}
    present = 0
    for i in reversed(large):
        waiting.setdefault(int(sizes[i]), []).append(i)
        present |= 1 << int(sizes[i])

    def draw(size: int) -> int:
        nonlocal present
        items = waiting[size]
        i = items.pop()
        if not items:
            present ^= 1 << size
        return i

    while present:
        size = present.bit_length() - 1
        out[draw(size)] = bins
        room = capacity - size
        fits = present & ((1 << (room + 1)) - 1)
        if fits:
            other = fits.bit_length() - 1
            out[draw(other)] = bins
            room -= other
        rooms.add(room, bins)
        bins += 1
    for i in order[len(large) :]:
        size = int(sizes[i])
        found = rooms.take(size)
        if found is None:
            found = (capacity, bins)
            bins += 1
        out[i] = found[1]
        rooms.add(found[0] - size, found[1])
    return out


def _pack_block(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        # The order of rows in a block is that of a shuffle; ids make it the same on every run.
        table = table.sort_by([("_size", "descending"), ("_id", "ascending"), ("_piece", "ascending"), ("_nth", "ascending")])
        return table.append_column("_bin", pa.array(pack(table.column("_size").to_numpy(), capacity), pa.int64()))

    return run


def fill_containers(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, tokenizer: str = TOKENIZER, pattern: str = PATTERN, block_items: int = 50_000) -> DataFrame:
    """``id_col``, ``piece``, ``pieces``, ``token_start``, ``tokens`` and ``container`` (block, '-', number) of every text.

    A text within the capacity is one piece, uncut. A larger one is cut into pieces of exactly the capacity, each a container
    of its own, and a rest. Empty and null texts take no room: piece 0 of 0 tokens, container null. Repeated rows are packed each.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    tables = SharedTables(df.sparkSession, "packing")
    sized = df.select(F.col(id_col).alias("_id"), F.coalesce(token_counter(tokenizer, pattern)(F.col(text_col)), F.lit(0)).alias("_tokens"))
    # Rows of one id and size are alike: they are counted, and dealt out again by number, long runs of them over many tasks.
    alike = tables.write(sized.groupBy("_id", "_tokens").agg(F.count(F.lit(1)).alias("_n")))
    runs = alike.filter(F.col("_n") > RUN).withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / RUN)))).repartition("_id", "_tokens", "_run")
    runs = alike.filter(F.col("_n") <= RUN).withColumn("_run", F.lit(0).cast("long")).unionByName(runs)
    sized = runs.select("_id", "_tokens", F.explode(F.sequence(F.col("_run") * RUN, F.least("_n", (F.col("_run") + 1) * RUN) - 1)).alias("_nth"))
    whole = F.floor(F.col("_tokens") / capacity).cast("int")
    rest = (F.col("_tokens") % capacity).cast("int")
    pieces = F.greatest(F.lit(1), whole + (rest > 0).cast("int"))
    cut = sized.select("_id", "_tokens", "_nth", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece"))
    cut = cut.withColumn("_size", F.least(F.lit(capacity).cast("long"), F.col("_tokens") - F.col("_piece").cast("long") * capacity))
    packed_alone = cut.filter(F.col("_size") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), F.coalesce(F.col("_id").cast("string"), F.lit("null")), F.col("_piece"), F.col("_nth")))
    empty = cut.filter(F.col("_size") == 0).withColumn("container", F.lit(None).cast("string"))
    open_ = cut.filter((F.col("_size") > 0) & (F.col("_size") < capacity))
    blocks = max(1, math.ceil((alike.agg(F.sum("_n")).first()[0] or 0) / block_items))
    # Ids may repeat (or be null) in a third of the rows; the number of the row breaks such a group up, the same way on every run.
    block = F.pmod(F.xxhash64("_id", "_piece", "_nth"), F.lit(blocks))
    open_ = open_.withColumn("_block", block)
    schema = T.StructType([*open_.schema.fields, T.StructField("_bin", T.LongType())])
    filled = open_.groupBy("_block").applyInArrow(_pack_block(capacity), schema).withColumn("container", F.concat_ws("-", "_block", "_bin"))
    cols = [F.col("_id").alias(id_col), F.col("_piece").alias("piece"), "pieces", (F.col("_piece").cast("long") * capacity).alias("token_start"), F.col("_size").alias("tokens"), "container"]
    return filled.select(cols).unionByName(packed_alone.select(cols)).unionByName(empty.select(cols))
