"""What a table's values say about its columns: samples, uniqueness, types, and columns with the same content.

Each table is scanned once: columns become (column, value) rows, distinct values are found with partial aggregation before the one
shuffle, and everything else is made from those. All distinct values count, not the first few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Pairs of values that make a column boolean.
BOOLEAN_PAIRS = (("0", "1"), ("f", "t"), ("n", "y"), ("no", "yes"), ("f", "m"), ("female", "male"), ("fail", "success"), ("bad", "good"), ("cancelled", "completed"), ("l", "r"), ("false", "true"))


def distinct_values(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name``, ``column_name``, ``value`` (text) and ``n`` rows of every distinct value; nulls are one value. Nested columns are left out."""
    out = None
    for name, df in tables.items():
        plain = [c for c, t in df.dtypes if not t.startswith(("array", "struct", "map", "binary"))]
        if not plain:
            continue
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in plain))).alias("x")).select(F.lit(name).alias("table_name"), "x.*")
        counted = cells.groupBy("table_name", "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        out = counted if out is None else out.unionByName(counted)
    return out


def uniqueness(values: DataFrame) -> DataFrame:
    """Distinct and filled values of each column, and whether every filled one is unique."""
    full = F.col("value").isNotNull()
    out = values.groupBy("table_name", "column_name").agg(F.count(F.when(full, True)).alias("distinct_values"), F.coalesce(F.sum(F.when(full, F.col("n"))), F.lit(0)).alias("filled"))
    return out.withColumn("is_unique", F.col("distinct_values") == F.col("filled"))


def samples(values: DataFrame, k: int = 5) -> DataFrame:
    """The first ``k`` distinct values of each column in text order, empty ones aside, by ``place`` from 1."""
    place = F.row_number().over(Window.partitionBy("table_name", "column_name").orderBy("value"))
    return values.filter("value is not null and value <> ''").select("table_name", "column_name", "value", place.alias("place")).filter(F.col("place") <= k)


def types(values: DataFrame) -> DataFrame:
    """``kind`` of each column by its distinct values: boolean, text, number, time, year or unknown.

    Two values of a known pair: boolean. A value that starts with a letter: text; one is tolerated among more than seven values.
    Otherwise dates, years (four digits from 1000 to 2999 in a column named for them) or numbers, one exception tolerated.
    A single value, or none, leaves the kind to a name that ends in date, time or year, else unknown.
    """
    v = F.lower(F.trim("value"))
    is_number = v.rlike(r"^-?\d+(\.\d+)?([eE]-?\d+)?$")
    is_date = v.rlike(r"^\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}([ t].*)?$|^\d{1,2}:\d{2}(:\d{2})?$")
    full = F.col("value").isNotNull() & (F.trim("value") != "")
    count = lambda cond: F.count(F.when(full & cond, 1))
    every = values.groupBy("table_name", "column_name").agg(
        count(F.lit(True)).alias("n"), F.min(F.when(full, v)).alias("low"), F.max(F.when(full, v)).alias("high"), count(v.rlike(r"^\p{L}")).alias("letters"),
        count(is_number).alias("numbers"), count(is_date).alias("dates"), count(v.rlike(r"^[12]\d{3}$")).alias("years"),
    )
    n, name = F.coalesce("n", F.lit(0)), F.lower("column_name")
    pair = F.lit(False)
    for a, b in BOOLEAN_PAIRS:
        pair = pair | (F.col("low") == a) & (F.col("high") == b)
    spare = F.when(n > 7, 1).otherwise(0)
    by_name = F.when(name.endswith("date") | name.endswith("time"), "time").when(name.endswith("year"), "year").otherwise("unknown")
    kind = (
        F.when((n == 2) & pair, "boolean").when(n == 0, by_name).when(F.col("letters") > spare, "text").when(n == 1, by_name)
        .when(F.col("dates") >= n - spare, "time").when((F.col("years") >= n - spare) & name.contains("year"), "year").when(F.col("numbers") >= n - spare, "number").otherwise("text")
    )
    return every.select("table_name", "column_name", kind.alias("kind"))


def same_content(values: DataFrame, miss: int = 1) -> DataFrame:
    """Pairs of columns of which the first one's values, ``miss`` at most excepted, are all in the second; two values at least.

    Columns meet on shared values, so only pairs with something in common are ever formed; a value in many columns meets
    as many pairs as there are columns, which the catalog bounds.
    """
    own = values.filter("value is not null and value <> ''").select(F.concat_ws(".", "table_name", "column_name").alias("c"), "value")
    size = own.groupBy("c").agg(F.count(F.lit(1)).alias("size"))
    met = own.groupBy("value").agg(F.sort_array(F.collect_set("c")).alias("cs")).filter(F.size("cs") > 1)
    pairs = met.select(F.explode("cs").alias("a"), "cs").select("a", F.explode("cs").alias("b")).filter("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(size.withColumnRenamed("c", "a"), "a").filter((F.col("size") > 1) & (F.col("shared") >= F.col("size") - miss)).select(F.col("a").alias("column_a"), F.col("b").alias("column_b"), "shared", F.col("size").alias("values_a"))


def checked_types(columns: DataFrame, values: DataFrame) -> DataFrame:
    """``kind`` of catalog columns (``db``, ``table_name``, ``column_name``, ``shown``, ``declared``) by their values where they have any, else as declared.

    A text column that is named "x or y" is boolean. ``values`` has ``db``, ``table_name``, ``column_name`` and ``cell_value``.
    """
    own = values.select(F.concat_ws("\x1f", "db", "table_name").alias("table_name"), "column_name", F.col("cell_value").alias("value")).distinct()
    found = types(own).select(F.split("table_name", "\x1f").alias("_t"), "column_name", "kind").select(F.get("_t", F.lit(0)).alias("db"), F.get("_t", F.lit(1)).alias("table_name"), "column_name", "kind")
    named = F.lower("shown").contains(" or ") & (F.col("declared") == "text")
    both = columns.join(found.filter("kind <> 'unknown'"), ["db", "table_name", "column_name"], "left")
    return both.select("db", "table_name", "column_name", "declared", F.when(named, "boolean").otherwise(F.coalesce("kind", "declared")).alias("kind"))


def same_named(columns: DataFrame) -> DataFrame:
    """Pairs of columns of one database (``table_a``, ``column_a``, ``table_b``, ``column_b``) that say the same: equal words, two at least, plural endings aside, and equal kind.

    ``shares_table``: one of the words is one of either table's name. ``columns`` has ``db``, ``table_name``, ``column_name``, ``words`` (array), ``table_words`` and ``declared``.
    """
    stem = lambda c: F.transform(c, lambda w: F.regexp_replace(w, "s$", ""))
    own = columns.select("db", "table_name", "column_name", "declared", stem(F.col("words")).alias("w"), stem(F.col("table_words")).alias("t")).filter(F.size("w") > 1)
    side = lambda x: own.select("db", F.array_join("w", " ").alias("said"), "declared", F.col("table_name").alias(f"table_{x}"), F.col("column_name").alias(f"column_{x}"), F.col("w").alias(f"w_{x}"), F.col("t").alias(f"t_{x}"))
    # A database's catalog bounds how often one name stands in it.
    both = side("a").join(side("b"), ["db", "said", "declared"]).filter((F.col("table_a") < F.col("table_b")) | (F.col("table_a") == F.col("table_b")) & (F.col("column_a") < F.col("column_b")))
    return both.select("db", "table_a", "column_a", "table_b", "column_b", (F.arrays_overlap("w_a", "t_a") | F.arrays_overlap("w_a", "t_b")).alias("shares_table"))


def compound_names(names: DataFrame, dictionary: DataFrame, least: int = 3) -> DataFrame:
    """One-word names that are two words of the database's dictionary written together: ``db``, ``name``, ``first`` and ``second``, each of ``least`` letters and more.

    ``names`` has ``db`` and ``name``, ``dictionary`` has ``db`` and ``word``. Every split is tried, and all that hold are given.
    """
    cut = names.filter(F.length("name") >= 2 * least).select("db", "name", F.explode(F.sequence(F.lit(least), F.length("name") - least)).alias("n"))
    halves = cut.select("db", "name", F.substring("name", F.lit(1), F.col("n")).alias("first"), F.substring("name", F.col("n") + 1, F.length("name")).alias("second"))
    words = dictionary.select("db", "word").distinct()
    return halves.join(words.withColumnRenamed("word", "first"), ["db", "first"]).join(words.withColumnRenamed("word", "second"), ["db", "second"]).select("db", "name", "first", "second").distinct()
