"""Fuzzy value links against all pairs."""

import random

from askweave.operators import linking


def _all_pairs(questions, values):
    return {(q, v) for q, text in questions for v in values if linking.match_score(text, v) >= linking.THRESHOLD}


def test_keys_lose_no_pair():
    rng, found = random.Random(5), 0
    for _ in range(60_000):
        words = ["".join(rng.choice("abcdS'") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 4))]
        v = list(rng.choice([" ", "-", "\t", ", "]).join(words[: rng.randint(1, 3)]))
        said = v[:]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(said) + 1)
            said[i : i + rng.randint(0, 1)] = rng.choice(["", "s", "ab", " ", "\t", "'s"])
        q = rng.choice(["", "a ", "show ", "x", "\t"]) + "".join(said) + rng.choice(["", "s", "'s", "?", " cab"])
        for threshold in (0.85, 0.6):
            if linking.match_score(q, "".join(v)) >= threshold:
                found += 1
                keys = linking._value_keys("".join(v), threshold)
                assert linking._question_keys(q, {(k[0], len(k)) for k in keys}) & keys, (q, v)
    assert found > 10_000


def test_fuzzy_matches_like_all_pairs(spark):
    values = ["cat", "singer", "New York", "Mississippi River", "Bologo Ramen", "id", "12", "??", "the", "USA", "a b"]
    texts = ["Show all cats", "How many singers?", "Who lives in New Yrok or new york?", "the Mississippi rivrs", "Bologos Ramen and Bologo Ramens", "what?? 12 id", "the USAs and a b", "", None]
    questions = list(enumerate(texts))
    rows = spark.createDataFrame([(i, " D ", t) for i, t in questions], "q_id long, db_id string, question string")
    index = spark.createDataFrame([("d", "t", "c", v) for v in values] + [("other", "t", "c", "show")], "db string, table_name string, column_name string, cell_value string")
    got = {(r["q_id"], r["cell_value"]) for r in linking.fuzzy_matches(rows, index, keep=100).collect()}
    assert got == _all_pairs([x for x in questions if x[1] is not None], values)
    assert {(0, "cat"), (1, "singer"), (3, "Mississippi River"), (4, "Bologo Ramen")} <= got


def test_fuzzy_matches_like_all_pairs_on_tables(spark):
    from askweave.plans.pipeline_queries import value_index
    from askweave.sources.tables import table

    sf_dir = "/root/testdata/sf0.001"
    train, index = table(spark, sf_dir, "train_spider"), value_index(spark, sf_dir)
    by_db = {}
    for r in index.select("db", "cell_value").distinct().collect():
        by_db.setdefault(r["db"], []).append(r["cell_value"])
    want = set()
    for r in train.filter("question is not null and db_id is not null").collect():
        want |= _all_pairs([(r["q_id"], r["question"])], by_db.get(r["db_id"].strip().lower(), []))
    plain = index.withColumn("column_name", linking.F.regexp_replace("column_name", "name", "label"))
    got = {(r["q_id"], r["cell_value"]) for r in linking.fuzzy_matches(train, plain, keep=1_000_000).collect()}
    assert want and got == want
    blocks = linking._alike(train, plain, linking.THRESHOLD, 3)
    assert {(r["q_id"], r["cell_value"]) for r in blocks.collect()} == want
