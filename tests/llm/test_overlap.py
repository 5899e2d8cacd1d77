import random

from hypothesis import given, settings
from hypothesis import strategies as st

from askweave.llm.overlap import overlaps, word_distance


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
def test_word_distance(a, b):
    assert word_distance(a, b) == _levenshtein(a, b)


def test_equal_to_brute_force(spark):
    r = random.Random(8)
    base = [[r.choice("abcdefghij") * r.randint(1, 2) for _ in range(r.randint(0, 16))] for _ in range(30)]

    def changed():
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            at = r.randint(0, len(words))
            kind = r.random()
            if kind < 0.4 and at < len(words):
                words[at] = r.choice("xyz")
            elif kind < 0.7:
                words.insert(at, r.choice("xyz"))
            elif at < len(words):
                del words[at]
        return words

    def rows(first, n):
        out = [(first + i, bytes([r.choice([1, 1, 1, 2, 3])]), changed()) for i in range(n)]
        return [*out, out[0], (first + n, None, ["a"]), (first + n + 1, b"\x01", None), (None, b"\x01", ["a"]), (first + n + 2, b"\x01", []), (first + n + 3, b"\x02", ["w"] * 3000)]

    train, dev = rows(0, 500), rows(10_000, 80)
    schema = "_id long, _key binary, _words array<string>"
    got = {(x["_t"], x["_e"]) for x in overlaps(spark.createDataFrame(train, schema).repartition(4), spark.createDataFrame(dev, schema)).collect()}
    want = {
        (i, j) for i, k, a in train for j, h, b in dev
        if None not in (i, k, a, j, h, b) and k == h and 4 * abs(len(a) - len(b)) <= max(len(a), len(b)) and (a == b or 4 * word_distance(a, b) <= max(len(a), len(b)))
    }
    assert got == want and len(want) > 100
    shuffled = overlaps(spark.createDataFrame(train, schema), spark.createDataFrame(dev, schema), broadcast_keys=0, hot=20)
    assert {(x["_t"], x["_e"]) for x in shuffled.collect()} == want
    assert overlaps(spark.createDataFrame([], schema), spark.createDataFrame(dev, schema)).count() == 0
    assert overlaps(spark.createDataFrame(train, schema), spark.createDataFrame([], schema)).count() == 0
