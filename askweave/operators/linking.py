"""Values of a database found in questions."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from askweave.functions.text import db_key, words
from askweave.operators.skew import join_salted

_SEPARATORS = set("'\"()`,.?! ")
#: Words that are no value by themselves, and words that count only when they match wholly.
STOP_WORDS = frozenset("a an the of in on at by for from with to and or not is are was were be been it its this that these those what which who whom whose when where why how many much all any each every no nor do does did have has had i me my we our you your he she they them their as than then there here s t can will just should now".split())
COMMON_WORDS = frozenset(("no", "yes", "many"))
THRESHOLD = 0.85


def similarity(a: str, b: str) -> float:
    """Twice the longest common subsequence over the sum of both lengths; bit-parallel."""
    if not a or not b:
        return float(not a and not b)
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for ch in b:
        hit = state & places.get(ch, 0)
        state = (state + hit | state - hit) & full
    return 2 * (len(a) - state.bit_count()) / (len(a) + len(b))


def match_score(question: str, value: str) -> float:
    """How well a value is mentioned: its longest common block with the question, widened to word limits, against the value.

    0 where there is no such mention: blocks of one character, numbers, ``id``, stop words, different beginnings. A mention
    in the possessive counts as whole. Common words and values in capitals count only when whole.
    """
    q, v = question.lower(), value.lower().strip()
    m = SequenceMatcher(None, q, v).find_longest_match(0, len(q), 0, len(v))
    if m.size < 2:
        return 0.0
    a, z = m.a, m.a + m.size
    if a > 0 and q[a - 1] not in _SEPARATORS and q[a] not in _SEPARATORS:
        if a > 1 and q[a - 2] not in _SEPARATORS:
            return 0.0
        a -= 1
    end = next((e for e in range(z, min(len(q), z + 2) + 1) if e == len(q) or q[e] in _SEPARATORS), None)
    if end is None:
        return 0.0
    span, block = q[a:end].strip(), q[m.a : z].strip()
    bare = span.removesuffix("'s")
    if len(span) < 2 or not block or re.fullmatch(r"-?[\d,]*\.?\d+", block) or block == "id" or {block, bare, v} & STOP_WORDS:
        return 0.0
    if span == block + "'s":
        score = 1.0
    else:
        first = [next((c for c in x if c not in _SEPARATORS), "") for x in (span, v)]
        score = similarity(v, span) if first[0] == first[1] else 0.0
    if score < 1 and (block in COMMON_WORDS or bare in COMMON_WORDS or value.isupper()):
        return 0.0
    return score


def value_index(preprocessed: DataFrame) -> DataFrame:
    """``db``, ``table_name``, ``column_name``, ``cell_value`` of all distinct cell values of the nested schemas."""
    tables = preprocessed.select(db_key(F.col("db_id")).alias("db"), F.explode("db_schema").alias("t")).filter("t is not null")
    cells = tables.select("db", F.lower("t.table_name_original").alias("table_name"), F.posexplode("t.column_names_original").alias("pos", "column_name"), F.col("t.db_contents").alias("contents"))
    values = cells.select("db", "table_name", F.lower("column_name").alias("column_name"), F.explode(F.get("contents", F.col("pos"))).alias("cell_value"))
    return values.filter("db is not null and table_name is not null and column_name is not null and trim(cell_value) <> ''").distinct()


#: Lengths of the pieces of text on which questions and values meet.
_GRAMS = (2, 3, 4)
#: Questions, or values, of a database that a task takes at once.
BLOCK = 5_000


def _soft(ch: str) -> bool:
    return ch in _SEPARATORS or ch.isspace()


def _question_keys(question: str, used: set[tuple[str, int]]) -> set[str]:
    """Pieces of the question at the places where a mention can begin, of the kinds and lengths in ``used``; see :func:`_value_keys`."""
    q, out = question.lower(), set()
    sizes = {kind: sorted(n for x, n in used if x == kind) for kind in "123"}
    for a in range(len(q) - 1):
        kind, start = "3" if _soft(q[a]) else "1", a
        if not (a == 0 or _soft(q[a - 1]) or q[a] in _SEPARATORS):
            if a > 1 and q[a - 2] not in _SEPARATORS:
                continue
            kind, start = "2", a - 1
        out.update(kind + q[start : start + n - 1] for n in sizes[kind] if start + n - 1 <= len(q))
    return out


def _value_keys(value: str, threshold: float) -> set[str]:
    """Pieces of the value of which a question has one as a key where :func:`match_score` gives ``threshold`` (above 0) and more.

    The score compares the value with a span: a block that is in both, one character more in front and two more behind at most.
    2 * min(n, s) / (n + s) >= ``threshold`` gives the span's least length s for a value of n characters, hence the block's. The
    block begins where a word of the question does ("1": the span's first letter, which is the value's, is the block's own), one
    character later ("2": that letter is in front of it) or at a separator ("3"). Each place of the value at which such a block
    can begin gives a key.
    """
    v = value.lower().strip()
    n = len(v)
    least = next((s for s in range(1, n + 1) if 2 * s / (n + s) >= threshold), n)
    first, out = next((c for c in v if c not in _SEPARATORS), ""), set()
    for kind, size in (("1", max(2, least - 2)), ("2", max(2, least - 3)), ("3", max(2, least - 2))):
        g = max(x for x in _GRAMS if x <= size)
        for i in range(n - size + 1):
            if kind == "1" and v[i] == first and not _soft(v[i]) or kind == "3" and _soft(v[i]):
                out.add(kind + v[i : i + g])
            elif kind == "2" and v[i] not in _SEPARATORS:
                out.add(kind + first + v[i : i + g])
    return out


def _scored(threshold: float):
    """Over a block of questions (``q_id``, ``question``) and a block of values (``cell_value``) of one database: the pairs with ``score``."""

    def run(questions: pa.Table, values: pa.Table) -> pa.Table:
        cells, at = values["cell_value"].to_pylist(), {}
        for i, v in enumerate(cells):
            for k in _value_keys(v, threshold):
                at.setdefault(k, []).append(i)
        used = {(k[0], len(k)) for k in at}
        rows, found, scores = [], [], []
        for r, q in enumerate(questions["question"].to_pylist()):
            for i in {i for k in _question_keys(q, used) for i in at.get(k, ())}:
                if (score := match_score(q, cells[i])) >= threshold:
                    rows.append(r)
                    found.append(cells[i])
                    scores.append(score)
        taken = questions.take(pa.array(rows, pa.int64()))
        return pa.table({"q_id": taken["q_id"], "db": taken["db"], "cell_value": pa.array(found, pa.string()), "score": pa.array(scores, pa.float64())})

    return run


def _alike(questions: DataFrame, index: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """``q_id``, ``db``, ``cell_value``, ``score`` of every question and value of its database with ``threshold`` and more.

    Questions and values of a database are dealt to blocks of about ``block`` rows, each block of the ones meets each of the others, and
    inside they meet on keys: a large database is no large task, and neither keys nor pairs are shuffled.
    """
    v = index.select("db", "cell_value").distinct()
    q = questions.filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), "question").distinct()
    blocks = lambda df, name: df.groupBy("db").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))
    grid = blocks(q, "_nq").join(blocks(v, "_nv"), "db")
    part = lambda n, *cols: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(grid, "db").select("q_id", "db", "question", part("_nq", "q_id", "question").alias("_qb"), each("_nv").alias("_vb"))
    v = v.join(grid, "db").select("db", "cell_value", part("_nv", "cell_value").alias("_vb"), each("_nq").alias("_qb"))
    schema = T.StructType([q.schema["q_id"], q.schema["db"], v.schema["cell_value"], T.StructField("score", T.DoubleType())])
    keys = ["db", "_qb", "_vb"]
    return q.groupBy(*keys).cogroup(v.groupBy(*keys)).applyInArrow(_scored(threshold), schema).distinct()


def _met(questions: DataFrame, index: DataFrame) -> DataFrame:
    """Questions beside the values of their database with which they share a word: the value's rarest word, by database."""
    v = index.select("db", "cell_value").distinct().withColumn("_w", F.array_distinct(words(F.col("cell_value")))).filter(F.size("_w") > 0)
    often = v.select("db", F.explode("_w").alias("w")).groupBy("db", "w").count()
    rarest = Window.partitionBy("db", "cell_value").orderBy("count", "w")
    keyed = v.select("db", "cell_value", F.explode("_w").alias("w")).join(often, ["db", "w"]).withColumn("k", F.row_number().over(rarest)).filter("k = 1").select("db", "w", "cell_value")
    q = questions.filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), "question")
    # Words go as hashes without their question, which comes to the few met; equal hashes of other words fail the test that follows.
    hashed = lambda df: df.withColumn("w", F.xxhash64("db", "w"))
    met = hashed(q.withColumn("w", F.explode(F.array_distinct(words(F.col("question")))))).select("q_id", "w").join(hashed(keyed), "w").select(F.col("q_id").alias("_q"), F.col("db").alias("_db"), "cell_value").distinct()
    return q.join(met, F.col("q_id").eqNullSafe(F.col("_q")) & (F.col("db") == F.col("_db"))).drop("_q", "_db")


def exact_matches(questions: DataFrame, index: DataFrame) -> DataFrame:
    """``q_id``, ``table_name``, ``column_name``, ``cell_value`` where the value's words stand in the question in a row."""
    met = _met(questions, index)
    said = lambda c: F.concat(F.lit(" "), F.array_join(words(F.col(c)), " "), F.lit(" "))
    return met.filter(F.contains(said("question"), said("cell_value"))).select("q_id", "db", "cell_value").distinct().join(index, ["db", "cell_value"]).select("q_id", "table_name", "column_name", "cell_value")


def fuzzy_matches(questions: DataFrame, index: DataFrame, keep: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """The best ``keep`` values of each question and column with a score of ``threshold`` (above 0) and more; columns named for names need 1.

    Every value of the database counts, inflected and misspelt mentions too: pairs are left unscored only where the score can't be reached.
    """
    if threshold <= 0:
        raise ValueError("threshold must be above 0")
    out = _alike(questions, index, threshold).join(index, ["db", "cell_value"]).filter(~F.col("column_name").contains("name") | (F.col("score") >= 1))
    best = Window.partitionBy("q_id", "table_name", "column_name").orderBy(F.desc("score"), F.desc(F.length("cell_value")), "cell_value")
    return out.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep).select("q_id", "table_name", "column_name", "cell_value", F.round("score", 6).alias("score"), "place")


def cell_spans(questions: DataFrame, index: DataFrame, longest: int = 6) -> DataFrame:
    """``q_id``, ``pos``, ``span``, ``table_name``, ``column_name``: the longest run of a question's words, from each place on, with which a value of its database begins.

    Plural endings of the last word aside. A run of one word counts only if that is the whole value, or no stop word, number or word of one or two
    letters. Questions and values meet on their first word; of a value up to ``longest`` words are compared.
    """
    first = lambda a, n: F.slice(a, 1, n)
    stem = lambda a: F.transform(a, lambda w: F.regexp_replace(w, "s$", ""))
    v = index.select("db", "table_name", "column_name", words(F.col("cell_value")).alias("_v")).filter(F.size("_v") > 0)
    v = v.select("db", F.regexp_replace(F.get("_v", F.lit(0)), "s$", "").alias("w"), "table_name", "column_name", first(stem(F.col("_v")), longest).alias("_v"), (F.size("_v") == 1).alias("_whole")).distinct()
    q = questions.filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), words(F.col("question")).alias("_q")).distinct()
    q = q.select("q_id", "db", F.posexplode("_q").alias("pos", "said"), "_q").withColumn("_rest", stem(F.slice("_q", F.col("pos") + 1, F.lit(longest))))
    q = q.filter(~F.col("said").isin(*sorted(STOP_WORDS))).select("q_id", "db", "pos", "said", F.regexp_replace("said", "s$", "").alias("w"), "_rest")
    met = join_salted(q.withColumn("k", F.concat_ws("\x1f", "db", "w")).drop("db"), v.withColumn("k", F.concat_ws("\x1f", "db", "w")).drop("db", "w"), "k", q.count())
    same = F.transform(F.arrays_zip("_rest", "_v"), lambda x: x["_rest"] == x["_v"])
    run = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + (s["on"] & F.coalesce(x, F.lit(False))).cast("int")).alias("n"), (s["on"] & F.coalesce(x, F.lit(False))).alias("on")), lambda s: s["n"])
    met = met.withColumn("span", run).filter((F.col("span") > 1) | F.col("_whole") | ~F.col("said").rlike(r"^(\d+|.{1,2})$"))
    best = Window.partitionBy("q_id", "pos")
    return met.select("q_id", "pos", "span", "table_name", "column_name").distinct().withColumn("_most", F.max("span").over(best)).filter("span = _most").drop("_most")


def starting_with(table: DataFrame, text: str, limit: int = 500) -> DataFrame:
    """Rows in which a text column, blanks aside, begins with the text, letter case aside: ``limit`` at most. One scan, whatever the number of columns."""
    columns = [c for c, t in table.dtypes if t == "string"]
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.trim(F.col(f"`{c}`"))).startswith(text.lower())
    return table.filter(hit).limit(limit)


def schema_links(questions: DataFrame, items: DataFrame) -> DataFrame:
    """``q_id``, ``table_name``, ``column_name`` (null for the table itself) and ``tier`` of the schema items a question speaks of.

    ``items`` has ``db``, ``table_name``, ``column_name`` (null for tables) and ``item_words``. Plural endings aside: tier 3 where the name's words
    stand in a row, 2 where all of them stand somewhere, 1 where one of four letters and more does. Questions and items meet on shared
    words within their database only.
    """
    stem = lambda a: F.transform(a, lambda w: F.regexp_replace(w, "s$", ""))
    q = questions.filter("question is not null").select("q_id", db_key(F.col("db_id")).alias("db"), stem(words(F.col("question"))).alias("_q"))
    i = items.select("db", "table_name", "column_name", stem(F.col("item_words")).alias("_i")).filter(F.size("_i") > 0)
    met = q.withColumn("w", F.explode(F.array_distinct("_q"))).join(i.withColumn("w", F.explode(F.array_distinct("_i"))), ["db", "w"])
    best = met.groupBy("q_id", "db", "table_name", "column_name").agg(F.any_value("_q").alias("_q"), F.any_value("_i").alias("_i"), F.max(F.length("w")).alias("_longest"))
    said = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    tier = F.when(F.contains(said(F.col("_q")), said(F.col("_i"))), 3).when(F.size(F.array_except("_i", "_q")) == 0, 2).when(F.col("_longest") >= 4, 1)
    return best.select("q_id", "table_name", "column_name", tier.alias("tier")).filter("tier is not null")
