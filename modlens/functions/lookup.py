"""Looking the words of documents up in tables of any size.

A table of words that a driver may hold goes to the tasks and the words are looked up inside their rows. A longer one is
split by use: the words that occur in most documents are found by one aggregation and go to the tasks, known or
unknown; only the rare rest leaves its row, as pairs of id and word that no frequent word can swell.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modlens.sources.tables import materialise, settle

# Words that tasks may hold, and rows of vectors.
HELD = 200_000
HELD_VECTORS = 5_000


def in_row(spark: SparkSession, words: dict[str, str | None]):
    """Function of a token array: each token's value, null where there is none."""
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def look_up(tokens: pd.Series) -> pd.Series:
        get = shared.value.get
        return tokens.map(lambda ts: None if ts is None else [get(t) for t in ts])

    return look_up


def map_words(df: DataFrame, id_col: str, tokens_col: str, table: DataFrame, output_col: str, held: int = HELD) -> DataFrame:
    """``df`` with an array next to ``tokens_col``: the value of each token in ``table (word, value)``, else null.

    Rows keep their place; a word may stand in ``table`` once.
    """
    spark = df.sparkSession
    known = table.select("word", "value").limit(held + 1).toArrow()
    if known.num_rows <= held:
        words = dict(zip(known["word"].to_pylist(), known["value"].to_pylist(), strict=True))
        return df.withColumn(output_col, in_row(spark, words)(tokens_col))

    df = materialise(df, "tokens")  # read three times
    seen = df.select(F.explode(F.array_distinct(tokens_col)).alias("word")).groupBy("word").agg(F.count("*").alias("docs"))
    frequent = seen.orderBy(F.desc("docs"), "word").limit(held).join(table.select("word", "value"), "word", "left").toArrow()
    words = dict(zip(frequent["word"].to_pylist(), frequent["value"].to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("array<string>")
    def rare(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda ts: None if ts is None else [t for t in dict.fromkeys(ts) if t not in shared.value])

    @F.pandas_udf("array<string>")
    def look_up(tokens: pd.Series, found: pd.Series) -> pd.Series:
        def row(ts, own):
            if ts is None:
                return None
            own = {} if own is None else dict(own)
            return [own[t] if t in own else shared.value.get(t) for t in ts]

        return pd.Series([row(ts, own) for ts, own in zip(tokens, found, strict=True)], dtype=object)

    pairs = df.select(F.col(id_col).alias("_id"), F.explode(rare(tokens_col)).alias("word"))
    entry = F.struct(F.col("word").alias("key"), F.col("value").alias("value"))
    found = pairs.distinct().join(table.select("word", "value"), "word").groupBy("_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("_found")
    )
    joined = df.join(found, df[id_col].eqNullSafe(found["_id"]), "left").drop("_id")
    return joined.withColumn(output_col, look_up(F.col(tokens_col), F.col("_found"))).drop("_found")


def split_join(rows: DataFrame, table: DataFrame, key: str, held: int = HELD_VECTORS) -> DataFrame:
    """Inner join on ``key`` for a long table with wide rows: the part that the most frequent keys need is broadcast
    (at most ``held`` rows), the other rows are shuffled."""
    rows = materialise(rows, "keyed")
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).join(table.select(key), key, "left_semi")
    frequent = settle(counts.orderBy(F.desc("n"), key).limit(held).select(key), held)
    head = F.broadcast(table.join(F.broadcast(frequent), key, "left_semi"))
    tail = rows.join(F.broadcast(frequent), key, "left_anti").join(table, key)
    return rows.join(head, key).unionByName(tail)


def aligned(tokens: Column, found: Column, otherwise) -> Column:
    """The found values, and ``otherwise(token)`` where there is none."""
    return F.zip_with(tokens, found, lambda t, v: F.coalesce(v, otherwise(t)))
