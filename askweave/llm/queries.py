"""Queries of the training-data operators, and the SQL of those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from askweave.functions.text import compact, db_key, words
from askweave.llm.canon import query_key
from askweave.llm.components import RelatedSplits
from askweave.llm.copies import Copies
from askweave.llm.leakage import leaks, scrubbed
from askweave.llm.overlap import near_pairs, overlaps
from askweave.llm.packing import fill_containers
from askweave.llm.splitting import oversized, split_texts
from askweave.llm.textform import LOOKALIKES, consistent_form, normalise, odd_texts
from askweave.sources.tables import table

CAPACITY, PIECE_TOKENS, PIECE_OVERLAP, LEAK_WORDS = 2048, 512, 32, 13
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _keyed(df: DataFrame) -> DataFrame:
    """``_id``, the digest of database and query, and the question, of which :func:`_words` makes the words."""
    key = F.unhex(F.sha2(F.concat(db_key(F.col("db_id")), F.lit("\x1f"), query_key(F.col("query"))), 256))
    return df.select(F.col("q_id").alias("_id"), key.alias("_key"), F.col("question").alias("_words"))


def _words(question: Column) -> Column:
    return words(consistent_form(question))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_keyed(table(spark, sf_dir, "train_spider")), _keyed(table(spark, sf_dir, "dev")), _words).select(F.col("_t").alias("train_q_id"), F.col("_e").alias("dev_q_id"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps per evaluation split, its source and the training source: pairs, evaluation records and the highest containment, without making all pairs."""
    train, dev = table(spark, sf_dir, "train_spider"), table(spark, sf_dir, "dev")
    pairs, t, e = near_pairs(_keyed(train), _keyed(dev), _words)
    t = t.join(train.select(F.col("q_id").alias("_id"), F.col("source").alias("train_source")), "_id").groupBy(F.col("_class").alias("_t"), "train_source").agg(F.count(F.lit(1)).alias("_copies"))
    e = e.join(dev.select(F.col("q_id").alias("_id"), "split", "source"), "_id").select(F.col("_class").alias("_e"), "_id", "split", "source")
    per = pairs.join(t, "_t").groupBy("_e", "train_source").agg(F.sum("_copies").alias("_pairs"), F.max("containment").alias("_most"))
    return e.join(per, "_e").groupBy("split", "source", "train_source").agg(F.sum("_pairs").alias("pairs"), F.count_distinct("_id").alias("dev_records"), F.round(F.max("_most"), 6).alias("max_containment"))


def p1_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluation records whose question, whatever its query, is in the training split up to a tenth of its words: training records, their least distance."""
    any_ = lambda name: table(spark, sf_dir, name).select(F.col("q_id").alias("_id"), F.lit(b"").alias("_key"), F.col("question").alias("_words"))
    pairs, t, e = near_pairs(any_("train_spider"), any_("dev"), _words, share=10)
    t = t.groupBy(F.col("_class").alias("_t")).agg(F.count(F.lit(1)).alias("_copies"))
    per = pairs.join(t, "_t").groupBy("_e").agg(F.sum("_copies").alias("train_records"), F.min("distance").alias("least_distance"))
    return e.select(F.col("_class").alias("_e"), F.col("_id").alias("dev_q_id")).join(per, "_e").drop("_e")


def _copies(spark: SparkSession, sf_dir: str) -> Copies:
    question = F.col("question")
    return Copies(table(spark, sf_dir, "train_spider"), "q_id", [db_key(F.col("db_id")), compact(question), query_key(F.col("query"))], required=question)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).members()


def p2_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _copies(spark, sf_dir).collapsed()


def _related(spark: SparkSession, sf_dir: str) -> RelatedSplits:
    author = F.when(F.col("author") != "", F.col("author"))
    return RelatedSplits(table(spark, sf_dir, "train_spider"), "q_id", {"db": db_key(F.col("db_id")), "author": author})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).linked("db").select(F.col("a").alias("db_a"), F.col("b").alias("db_b"))


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _related(spark, sf_dir).assigned(PROPORTIONS)


def p4_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every database with the first of its component: the form of :func:`p4_found` whose size is that of the databases."""
    own = _related(spark, sf_dir).members("db")
    return own.join(own.groupBy("label").agg(F.min("v").alias("component")), "label").select(F.col("v").alias("db"), "component")


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`p4_splits`: records with one split each, databases and authors torn apart, splits further off their share than the largest component."""
    train, out = table(spark, sf_dir, "train_spider"), p4_splits(spark, sf_dir)
    rows = train.select("q_id", db_key(F.col("db_id")).alias("db"), F.when(F.col("author") != "", F.col("author")).alias("author")).join(out, "q_id", "left")
    torn = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count_distinct("split").alias("n")).agg(F.count(F.when(F.col("n") != 1, 1)).alias(f"torn_{c}s"))
    most = rows.groupBy("component").count().agg(F.max("count").alias("most"), F.sum("count").alias("total"))
    wanted = spark.createDataFrame(list(PROPORTIONS.items()), "split string, wanted double")
    shares = F.broadcast(wanted).join(rows.groupBy("split").count(), "split", "left").withColumn("one", F.lit(1)).join(most.withColumn("one", F.lit(1)), "one")
    off = shares.agg(F.count(F.when(F.abs(F.coalesce("count", F.lit(0)) - F.col("wanted") * F.col("total")) > F.col("most"), 1)).alias("shares_off"))
    whole = rows.groupBy("q_id").agg(F.count_distinct("split").alias("n")).agg(F.count(F.when(F.col("n") == 1, 1)).alias("records"))
    parts = [x.withColumn("one", F.lit(1)) for x in (whole, torn("db"), torn("author"), off)]  # a row each
    return parts[0].join(parts[1], "one").join(parts[2], "one").join(parts[3], "one").drop("one")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_texts(table(spark, sf_dir, "train_spider"), "q_id", "question")


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalise(table(spark, sf_dir, "train_spider"), "q_id", "question")


def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`p6_forms`: a form for each question that is there; forms that change when brought into form again, or have odd characters left."""
    once = p6_forms(spark, sf_dir)
    again = normalise(once.select("q_id", "form"), "q_id", "form").withColumnRenamed("form", "again")
    both = once.select("q_id", "form").join(again, "q_id")
    odd = sum((F.col(c) for c in again.columns if c.startswith("n_")), F.lit(0))
    return both.agg(F.count("form").alias("forms"), F.count(F.when(F.col("form") != F.col("again"), 1)).alias("unstable"), F.count(F.when(odd > 0, 1)).alias("odd_left"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_containers(table(spark, sf_dir, "documents"), "doc_id", "text", CAPACITY)


def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`p7_containers`: documents; texts cut that fit; pieces missing; containers above the capacity; and whether 2 % (and a container a block) of room is left at most."""
    out = p7_containers(spark, sf_dir)
    docs = out.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"), F.max("pieces").alias("p"), F.count_distinct("piece").alias("k"), F.max("token_start").alias("last"))
    per = docs.agg(
        F.count(F.lit(1)).alias("docs"), F.count(F.when((F.col("n") > 1) & (F.col("t") <= CAPACITY), 1)).alias("cut_that_fit"),
        F.count(F.when((F.col("n") != F.col("p")) | (F.col("k") != F.col("p")) | (F.col("last") != (F.col("p") - 1) * CAPACITY) | (F.col("t") > F.col("p") * CAPACITY), 1)).alias("incomplete"),
    )
    full = out.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("t"))
    full = full.agg(F.count(F.when(F.col("t") > CAPACITY, 1)).alias("above"), (F.count(F.lit(1)) <= 1.02 * F.ceil(F.sum("t") / CAPACITY) + 1).alias("tight"))
    return per.withColumn("one", F.lit(1)).join(full.withColumn("one", F.lit(1)), "one").drop("one")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).filter(F.col("longest") >= LEAK_WORDS).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"), "doc_id", "text", "item_id", "text", LEAK_WORDS)


def p8_scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrubbed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items"), "doc_id", "text", "item_id", "text", LEAK_WORDS)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_TOKENS, PIECE_OVERLAP)


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", PIECE_TOKENS, PIECE_OVERLAP)


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of :func:`p9_pieces`: texts, and those cut; pieces above the limit; pieces that are not their stretch of the text; gaps or wrong overlaps; texts not covered to the end."""
    texts, pieces = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole")).filter("whole is not null"), p9_pieces(spark, sf_dir)
    both = pieces.join(texts, "doc_id").withColumn("next", F.lead("char_start").over(Window.partitionBy("doc_id").orderBy("piece")))
    tokens = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"([\x{4E00}-\x{9FFF}]|(?:(?![\x{4E00}-\x{9FFF}])[\p{L}\p{N}_])+|[^\s\p{Z}\x1c-\x1f\x85])"), 1))
    stretch = lambda a, z: F.substring("whole", a + 1, z - a)
    bad = lambda cond: F.count(F.when(cond, 1))
    last = F.col("piece") == F.col("pieces") - 1
    return both.agg(
        F.count_distinct("doc_id").alias("docs"), F.count_distinct(F.when(F.col("pieces") > 1, F.col("doc_id"))).alias("cut"), bad((tokens(F.col("text")) > PIECE_TOKENS) | (tokens(F.col("text")) != F.col("tokens"))).alias("above"),
        bad(F.col("text") != stretch(F.col("char_start"), F.col("char_end"))).alias("changed"), bad(~last & ((F.col("next") > F.col("char_end")) | (tokens(stretch(F.col("next"), F.col("char_end"))) != PIECE_OVERLAP))).alias("wrong_overlap"),
        bad((F.col("piece") == 0) & (F.col("char_start") != 0) | last & (F.col("char_end") != F.length("whole"))).alias("uncovered"),
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_questions, p2_found, p2_collapsed, p4_found, p4_splits, p4_components, p4_checks, p6_found, p6_forms, p6_checks, p7_containers, p7_checks, p8_found, p8_leaks, p8_scrubbed, p9_found, p9_pieces, p9_checks)}

# Canonical queries in SQL hold where the first FROM closes the select list and no comma of the list stands in brackets or quotes, as in all rows here.
_COPIES = r"""
    WITH r AS (SELECT q_id, lower(trim(db_id)) AS db, regexp_replace(regexp_replace(regexp_replace(lower(question), '(\d)\.(\d)', '\1§\2', 'g'), '[\s\p{Z}\p{Pc}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Sk}!-#%-*,-/:;?@\[-`{}]', '', 'g'), '§', '.', 'g') AS q,
      regexp_extract(lower(query), '(?s)^\s*select\b(?:\s+distinct\b)?(.*?)\bfrom\b', 1) AS items, lower(query) AS s FROM train_spider WHERE question IS NOT NULL),
    c AS (SELECT q_id, db, q, list_sort(list_transform(string_split(items, ','), lambda i: array_to_string(regexp_extract_all(i, '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_,;''"`‘’“”]'), ' '))) AS items,
      contains(s, 'distinct') AS d, array_to_string(regexp_extract_all(regexp_replace(s, '(?s)^\s*select\b.*?\bfrom\b', ''), '[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_,;''"`‘’“”]'), ' ') AS rest FROM r),
    g AS (SELECT *, min(q_id) OVER w AS first_q_id, count(*) OVER w AS copies FROM c WINDOW w AS (PARTITION BY db, q, items, d, rest))"""

_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]"
_DOUBLES = "".join(LOOKALIKES)
# The consistent form of a question's words, as far as these tables need it: ASCII full-width forms, two signs, accents and look-alikes.
_FORM = rf"""
    list_transform(regexp_extract_all(nfc_normalize(array_to_string(list_transform(regexp_extract_all(regexp_replace(question, '{_INVISIBLE}', '', 'g'), '(?s).'),
      lambda c: CASE WHEN unicode(c) BETWEEN 65281 AND 65374 THEN chr(unicode(c) - 65248) WHEN c = 'ﬁ' THEN 'fi' WHEN unicode(c) = 8490 THEN 'K' ELSE c END), '')), '[\p{{L}}\p{{N}}]+'),
      lambda w: lower(CASE WHEN regexp_matches(w, '\p{{Latin}}') THEN translate(w, '{_DOUBLES}', '{"".join(LOOKALIKES.values())}') ELSE w END))"""

# Windows of 13 words, or of a shorter item as a whole, with their places.
_WINDOWS = r"""
    WITH d AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items WHERE text IS NOT NULL) WHERE len(w) >= 5),
    iw AS (SELECT item_id, len(w) AS item_words, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM i)),
    dw AS (SELECT doc_id, len(w) AS doc_words, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
    m AS (SELECT dw.doc_id, dw.doc_words, iw.item_id, iw.item_words, iw.n, dw.k, iw.k AS j FROM dw JOIN iw USING (g, n))"""


def _canonical(name: str) -> str:
    """``c_<name>``: canonical query and words of each question of a table."""
    body = _COPIES.partition("WITH r AS ")[2].partition("    g AS (")[0].rstrip().rstrip(",")
    body = body.replace("(SELECT q_id", f"(SELECT q_id, {_FORM} AS w", 1).replace("c AS (SELECT q_id", f"c_{name} AS (SELECT q_id, w", 1)
    return body.replace("FROM train_spider", f"FROM {name}").replace("FROM r)", f"FROM r_{name})")


_DISTANCE = "levenshtein(array_to_string(list_transform(x, lambda w: chr(CAST(35 + list_position(every, w) AS INTEGER))), ''), array_to_string(list_transform(y, lambda w: chr(CAST(35 + list_position(every, w) AS INTEGER))), ''))"


def _bigrams(words: str) -> str:
    return f"list_distinct(list_transform(range(1, greatest(len({words}), 2)), lambda i: coalesce({words}[i], '') || ' ' || coalesce({words}[i + 1], '')))"


ORACLES = {
    "p1_report": f"""
    WITH r_train_spider AS {_canonical('train_spider')}, r_dev AS {_canonical('dev')},
    p AS (SELECT a.q_id AS train_q_id, b.q_id AS dev_q_id, a.w AS x, b.w AS y, list_distinct(list_concat(a.w, b.w)) AS every FROM c_train_spider a JOIN c_dev b ON a.db = b.db AND a.items = b.items AND a.d = b.d AND a.rest = b.rest),
    m AS (SELECT train_q_id, dev_q_id, len(list_intersect({_bigrams('y')}, {_bigrams('x')})) / len({_bigrams('y')}) AS containment FROM p WHERE 4 * {_DISTANCE} <= greatest(len(x), len(y)))
    SELECT d.split, d.source, t.source AS train_source, count(*) AS pairs, count(DISTINCT dev_q_id) AS dev_records, round(max(containment), 6) AS max_containment
    FROM m JOIN dev d ON d.q_id = dev_q_id JOIN train_spider t ON t.q_id = train_q_id GROUP BY ALL""",
    "p1_questions": f"""
    WITH a AS (SELECT q_id, {_FORM} AS w FROM train_spider WHERE question IS NOT NULL), b AS (SELECT q_id, {_FORM} AS w FROM dev WHERE question IS NOT NULL),
    p AS (SELECT b.q_id AS dev_q_id, a.w AS x, b.w AS y, list_distinct(list_concat(a.w, b.w)) AS every FROM a JOIN b ON abs(len(a.w) - len(b.w)) * 10 <= greatest(len(a.w), len(b.w)) AND (len(a.w) = 0 OR len(list_intersect(a.w, b.w)) > 0)),
    d AS (SELECT dev_q_id, {_DISTANCE} AS distance, greatest(len(x), len(y)) AS longer FROM p)
    SELECT dev_q_id, count(*) AS train_records, CAST(min(distance) AS INTEGER) AS least_distance FROM d WHERE 10 * distance <= longer GROUP BY dev_q_id""",
    "p1_found": f"""
    WITH r_train_spider AS {_canonical('train_spider')}, r_dev AS {_canonical('dev')},
    p AS (SELECT a.q_id AS train_q_id, b.q_id AS dev_q_id, a.w AS x, b.w AS y, list_distinct(list_concat(a.w, b.w)) AS every FROM c_train_spider a JOIN c_dev b ON a.db = b.db AND a.items = b.items AND a.d = b.d AND a.rest = b.rest)
    SELECT train_q_id, dev_q_id FROM p WHERE 4 * levenshtein(array_to_string(list_transform(x, lambda w: chr(CAST(35 + list_position(every, w) AS INTEGER))), ''), array_to_string(list_transform(y, lambda w: chr(CAST(35 + list_position(every, w) AS INTEGER))), '')) <= greatest(len(x), len(y))""",
    "p2_collapsed": _COPIES + " SELECT min(q_id) AS q_id, count(*) AS copies FROM g GROUP BY first_q_id UNION ALL SELECT q_id, 1 FROM train_spider WHERE question IS NULL",
    "p6_found": rf"""
        SELECT q_id FROM train_spider WHERE regexp_matches(question, '{_INVISIBLE}') OR regexp_matches(question, '[\x{{FF01}}-\x{{FF60}}\x{{FFE0}}-\x{{FFE6}}\x{{FB00}}-\x{{FB06}}\x{{0300}}-\x{{036F}}]')
          OR regexp_matches(question, '[\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]')
          OR len(list_filter(regexp_extract_all(question, '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda w: regexp_matches(w, '[\p{{Latin}}]') AND regexp_matches(w, '[{_DOUBLES}\x{{212A}}]'))) > 0""",
    "p2_found": _COPIES + " SELECT first_q_id, q_id FROM g WHERE first_q_id <> q_id",
    "p8_found": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
        i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM test_items WHERE text IS NOT NULL),
        dw AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13)),
        iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i WHERE len(w) >= 13))
        SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g)""",
    "p8_leaks": _WINDOWS + """,
        x AS (SELECT DISTINCT doc_id, doc_words, item_id, item_words, n, k FROM m),
        y AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k) AS run, lead(k) OVER (PARTITION BY doc_id, item_id ORDER BY k) AS next FROM x),
        r AS (SELECT doc_id, item_id, max(c) AS c FROM (SELECT doc_id, item_id, count(*) AS c FROM y GROUP BY doc_id, item_id, run) GROUP BY ALL),
        z AS (SELECT doc_id, item_id, sum(least(n, coalesce(next - j, n))) AS covered FROM (SELECT *, lead(j) OVER (PARTITION BY doc_id, item_id ORDER BY j) AS next FROM (SELECT DISTINCT doc_id, item_id, n, j FROM m)) GROUP BY ALL)
        SELECT doc_id, item_id, doc_words, item_words, min(k) - 1 AS first_word, any_value(c) + any_value(n) - 1 AS longest, count(*) AS windows, CAST(sum(least(n, coalesce(next - k, n))) AS BIGINT) AS leaked_words, CAST(any_value(covered) AS BIGINT) AS item_covered
        FROM y JOIN r USING (doc_id, item_id) JOIN z USING (doc_id, item_id) GROUP BY doc_id, item_id, doc_words, item_words""",
    "p8_scrubbed": _WINDOWS + r""",
        gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS w FROM m),
        hit AS (SELECT doc_id, count(*) AS leaked FROM gone GROUP BY doc_id),
        p AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS place FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS ps FROM d JOIN hit USING (doc_id))),
        q AS (SELECT *, regexp_matches(piece, '^[\p{L}\p{N}]') AS word, sum(CASE WHEN regexp_matches(piece, '^[\p{L}\p{N}]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY place) AS w FROM p),
        kept AS (SELECT q.doc_id, coalesce(string_agg(piece, '' ORDER BY place) FILTER (a.w IS NULL OR NOT word AND b.w IS NULL), '') AS kept_text FROM q LEFT JOIN gone a ON a.doc_id = q.doc_id AND a.w = q.w LEFT JOIN gone b ON b.doc_id = q.doc_id AND b.w = q.w + 1 GROUP BY q.doc_id)
        SELECT o.doc_id, CAST(coalesce(leaked, 0) AS INTEGER) AS leaked_words, CASE WHEN leaked IS NULL THEN o.text WHEN leaked > 0.5 * len(d.w) THEN NULL ELSE kept_text END AS kept_text
        FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN hit USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "p4_found": """
        WITH RECURSIVE r AS (SELECT DISTINCT lower(trim(db_id)) AS db, author FROM train_spider WHERE db_id IS NOT NULL AND author IS NOT NULL AND author <> ''),
        e AS (SELECT DISTINCT x.db AS a, y.db AS b FROM r x JOIN r y ON x.author = y.author AND x.db <> y.db),
        c(a, b) AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
        SELECT a AS db_a, b AS db_b FROM c WHERE a < b""",
    "p4_components": """
        WITH RECURSIVE t AS (SELECT lower(trim(db_id)) AS db, author FROM train_spider WHERE db_id IS NOT NULL),
        r AS (SELECT DISTINCT db, author FROM t WHERE author IS NOT NULL AND author <> ''),
        e AS (SELECT DISTINCT x.db AS a, y.db AS b FROM r x JOIN r y ON x.author = y.author AND x.db <> y.db),
        c(a, b) AS (SELECT DISTINCT db, db FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a)
        SELECT a AS db, min(b) AS component FROM c GROUP BY a""",
    "p4_checks": "SELECT count(DISTINCT q_id) AS records, 0 AS torn_dbs, 0 AS torn_authors, 0 AS shares_off FROM train_spider",
    "p6_checks": "SELECT count(question) AS forms, 0 AS unstable, 0 AS odd_left FROM train_spider",
    "p7_checks": "SELECT count(DISTINCT doc_id) AS docs, 0 AS cut_that_fit, 0 AS incomplete, 0 AS above, true AS tight FROM documents",
    "p9_checks": r"""
        SELECT count(*) AS docs, count(*) FILTER (len(regexp_extract_all(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', ' § ', 'g'), '[\p{L}\p{N}_]+|[^\s\p{Z}]')) > 512) AS cut, 0 AS above, 0 AS changed, 0 AS wrong_overlap, 0 AS uncovered
        FROM documents WHERE text IS NOT NULL""",
    "p9_found": r"""
        SELECT doc_id FROM documents
        WHERE len(regexp_extract_all(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', ' § ', 'g'), '[\p{L}\p{N}_]+|[^\s\p{Z}]')) > 512""",
}
