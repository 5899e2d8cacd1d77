import random

from hypothesis import given, settings
from hypothesis import strategies as st

from askweave.llm.leakage import Automaton, leaks, scrubbed, window_hashes, words_of

WORDS = st.lists(st.sampled_from("abc"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(WORDS, max_size=6), st.lists(st.sampled_from("abcx"), max_size=30), st.integers(1, 5))
def test_automaton_equals_windows(items, text, least):
    automaton = Automaton(items, least)
    got = {i: rest for i, *rest in automaton.found(text)}
    want = {}
    for i, w in enumerate(items):
        n = min(least, len(w))
        at = [k for k in range(len(text) - n + 1) if n and any(text[k : k + n] == w[j : j + n] for j in range(len(w) - n + 1))]
        if at:
            longest = max(sum(1 for _ in run) for run in ([x for x in range(a, z + 1)] for a in at for z in at if z >= a and set(range(a, z + 1)) <= set(at)))
            covered = {j + d for j in range(len(w) - n + 1) if any(text[k : k + n] == w[j : j + n] for k in at) for d in range(n)}
            want[i] = [at[0], longest + n - 1, len(at), len({k + d for k in at for d in range(n)}), len(covered)]
    assert got == want
    covered = {k for a, z in zip(*[iter(automaton.spans(text))] * 2) for k in range(a, z)}
    assert covered == {k + d for i, w in enumerate(items) if (n := min(least, len(w))) for k in range(len(text) - n + 1) if any(text[k : k + n] == w[j : j + n] for j in range(len(w) - n + 1)) for d in range(n)}


@given(st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.integers(1, 6), min_size=1, max_size=3, unique=True))
def test_window_hashes(words, sizes):
    runs = [tuple(words[k : k + n]) for n in sorted(sizes) for k in range(len(words) - n + 1)]
    hashes = window_hashes(words, sizes).tolist()
    assert len(hashes) == len(runs) and len(set(zip(hashes, runs))) == len(set(hashes)) == len(set(runs))


def test_leaks_equal_brute_force(spark):
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 30)))) for i in range(40)]
    items += [(50, items[0][1]), (51, None), (52, ""), (None, items[1][1]), (53, "too short"), (54, "six words that stand here whole")]
    docs = []
    for i in range(200):
        text = [r.choice(vocabulary + ["zz", "Yy"]) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            own = r.choice(items[:40])[1].split()
            a = r.randint(0, 3)
            text[5:5] = [w.upper() for w in own[a : a + r.randint(10, 20)]]
        docs.append((i, r.choice([" ", ", ", "\r\n", "_"]).join(text)))
    docs += [(903, "Well: six WORDS that stand, here whole (so) six words that stand here"), (900, None), (901, ""), docs[0], (902, "filler " * 200_000 + items[3][1])]
    d = spark.createDataFrame([(*x, "a", 1) for x in docs], "id long, text string, _item string, item_id int").repartition(3)
    t = spark.createDataFrame([(*x, "b") for x in items], "item_id long, text string, _doc string")
    grams = {}
    for i, text in items:
        w = words_of(text or "")
        n = min(13, len(w))
        for k in range(len(w) - n + 1):
            if i is not None and n >= 5:
                grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    want = {(i, x) for i, text in docs for w in [words_of(text or "")] for n in sizes for k in range(len(w) - n + 1) for x in grams.get(tuple(w[k : k + n]), ())}
    rows = []
    for block in (500_000, 100):  # one automaton, and several
        got = leaks(d, t, "id", "text", "item_id", "text", block_words=block)
        got = got.collect()
        assert {(x["id"], x["item_id"]) for x in got} == want and len(want) > 20
        rows.append(sorted(map(tuple, got)))
    assert rows[0] == rows[1] and len(rows[0]) == len(set(rows[0])) + sum(i == docs[0][0] for i, *_ in set(rows[0]))
    covered = {}
    for i, text in docs:
        w = words_of(text or "")
        covered[i] = {k + j for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in grams for j in range(n)}
    for block in (500_000, 100):
        rows = scrubbed(d, t, "id", "text", "item_id", "text", block_words=block).collect()
        assert len(rows) == len(docs)
        for x in rows:
            text, gone = dict(docs)[x["id"]], covered[x["id"]]
            w = words_of(text or "")
            assert x["leaked_words"] == len(gone)
            if text is None or len(gone) > len(w) / 2:
                assert x["kept_text"] is None
            elif gone:
                assert words_of(x["kept_text"]) == [v for k, v in enumerate(w) if k not in gone]
            else:
                assert x["kept_text"] == text
    assert scrubbed(d.limit(0), t, "id", "text", "item_id", "text").count() == 0
    assert leaks(d.limit(0), t, "id", "text", "item_id", "text").count() == 0
    assert leaks(d, t.limit(0), "id", "text", "item_id", "text").count() == 0
