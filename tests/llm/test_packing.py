from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from askweave.llm import packing
from askweave.llm.packing import TOKENIZER, _encoding, PATTERN, fill_containers, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=80), st.integers(30, 60))
def test_pack_keeps_the_capacity(sizes, capacity):
    bins = pack(np.array(sizes, np.int64), capacity)
    fill, large = defaultdict(int), defaultdict(int)
    for s, b in zip(sizes, bins):
        fill[b] += s
        large[b] += 3 * s > capacity
    assert all(f <= capacity for f in fill.values()) and all(n <= 2 for n in large.values())
    assert len(fill) <= max(1, 2 * -(-sum(sizes) // capacity)) + 1


def test_pack_is_tight():
    r = np.random.default_rng(1)
    sizes = np.minimum(2000, np.maximum(1, r.lognormal(5, 1.2, 20_000))).astype(np.int64)
    bins = pack(sizes, 2048)
    assert sizes.sum() / (len(np.unique(bins)) * 2048) > 0.99


def test_containers(spark):
    words = "alpha beta gamma delta ".split()
    rows = [(i, " ".join(words[i % 4] for _ in range(1 + i * 7 % 90)), "c") for i in range(300)]
    rows += [(900, "word " * 5000, "c"), (901, "", "c"), (902, None, "c"), (None, "no id", "c"), rows[4], (903, "x " * 64, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, container string")
    out = fill_containers(df, "doc_id", "text", capacity=64, block_items=100).collect()
    count = {i: len(_encoding(TOKENIZER, PATTERN).encode_ordinary(t)) for i, t, _ in rows if t is not None}
    fill, seen = defaultdict(int), defaultdict(int)
    for x in out:
        if x["tokens"]:
            fill[x["container"]] += x["tokens"]
            assert x["pieces"] == 1 or x["tokens"] == 64 or x["piece"] == x["pieces"] - 1
        else:
            assert x["container"] is None and x["doc_id"] in (901, 902)
        seen[x["doc_id"]] += x["tokens"]
    assert max(fill.values()) <= 64
    assert seen[900] == count[900] and seen[901] == 0 and seen[rows[4][0]] == 2 * count[rows[4][0]]
    assert all(seen[i] == n for i, n in count.items() if i != rows[4][0])
    assert fill_containers(df.limit(0), "doc_id", "text", 64).count() == 0


def test_names_do_not_depend_on_files(spark, monkeypatch):
    rows = [(i % 40 if i % 3 else None, "word " * (1 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [Counter(map(tuple, fill_containers(x, "doc_id", "text", 16, block_items=50).collect())) for x in (df.repartition(1), df.repartition(7))]
    monkeypatch.setattr(packing, "RUN", 3)
    sets.append(Counter(map(tuple, fill_containers(df, "doc_id", "text", 16, block_items=50).collect())))
    assert sets[0] == sets[1] == sets[2] and sum(sets[0].values()) == len(rows)
