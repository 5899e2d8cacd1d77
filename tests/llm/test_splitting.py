import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from askweave.llm import splitting
from askweave.llm.splitting import PARAGRAPH, SENTENCE, _strengths, balanced_cuts, oversized, split_texts, token_bounds

TOKENS = re.compile(r"[一-鿿]|[^\W一-鿿]+|[^\w\s]")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=300), st.integers(2, 40), st.data())
def test_cuts_keep_limit_and_overlap(strengths, limit, data):
    n = len(strengths) + 1
    overlap = data.draw(st.integers(0, limit - 1))
    if n <= limit:
        return
    edges = [0, *balanced_cuts(np.array(strengths, np.uint8), n, limit, overlap), n]
    assert all(a < b for a, b in zip(edges, edges[1:]))
    assert all(b - (a - overlap if k else 0) <= limit and (k == 0 or a >= overlap) for k, (a, b) in enumerate(zip(edges, edges[1:])))


def test_very_long_text_takes_few_tries(monkeypatch):
    tries = []
    monkeypatch.setattr(splitting, "_cuts", lambda *a, run=splitting._cuts: tries.append(1) or run(*a))
    strengths = np.random.default_rng(0).integers(0, 6, 399_999).astype(np.uint8)
    assert len(balanced_cuts(strengths, 400_000, 512, 32)) >= 833 and len(tries) < 30


def test_strengths():
    import pyarrow as pa

    text = "One e.g. two. Three 3.5 x\ny\n\nz, w"
    points, nul, starts, ends, first = token_bounds(pa.array([text]))
    s = _strengths(text, starts - 1, ends - 1, points[1:])
    words = [text[a - 1 : b - 1] for a, b in zip(starts, ends)]
    at = {(w, i): k for k, (w, i) in enumerate(zip(words, s))}
    assert ("y", PARAGRAPH) in at and sum(x == SENTENCE for x in s) == 1
    assert s[words.index("two") + 1] == SENTENCE


def test_pieces(spark):
    r = random.Random(2)
    parts = ["word", "z. B.", "3.5", "汉字", ".", ",", "\n", "\n\n", "\r\n", " ", "_x", "é", "(", "?", "\t"]
    docs = [(i, "".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randint(0, 200))), "p") for i in range(120)]
    docs += [(900, None, "p"), (901, "", "p"), (902, "a" * 5000, "p"), (903, "a " * 5000, "p"), (None, "x " * 100, "p"), docs[7]]
    df = spark.createDataFrame(docs, "id long, text string, piece string").repartition(3)
    texts = {i: t for i, t, _ in docs}
    by = {}
    for x in split_texts(df, "id", "text", limit=30, overlap=5).collect():
        by.setdefault(x["id"], []).append(x)
    assert 900 not in by and set(by) == set(texts) - {900}
    for i, pieces in by.items():
        times = 2 if i == docs[7][0] else 1
        assert len(pieces) == times * pieces[0]["pieces"]
        pieces = sorted({tuple(p): p for p in pieces}.values(), key=lambda p: p["piece"])
        assert pieces[0]["char_start"] == 0 and pieces[-1]["char_end"] == len(texts[i])
        for p in pieces:
            assert p["text"] == texts[i][p["char_start"] : p["char_end"]] and p["tokens"] == len(TOKENS.findall(p["text"])) <= 30
        for a, b in zip(pieces, pieces[1:]):
            assert len(TOKENS.findall(texts[i][b["char_start"] : a["char_end"]])) == 5
    want = {i for i, t in texts.items() if t is not None and len(TOKENS.findall(t)) > 30}
    assert {x[0] for x in oversized(df, "id", "text", 30, 5).collect()} == want
    assert split_texts(df.limit(0), "id", "text", 30, 5).count() == 0
    with pytest.raises(ValueError):
        split_texts(df, "id", "text", 5, 5)
