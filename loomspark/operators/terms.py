"""Keyword ranking and sparse term vectors: one shuffle by (document, token), then a rank within the document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomspark.functions import text as T


def ranked_terms(docs: DataFrame, key: str, text: str, limit: int, stop: list[str] | None = None, shortest: int = 3) -> DataFrame:
    """(key, token, n, rank, weight): the most frequent tokens, ties by first place; weight is n over the largest n.

    Counts are summed before the shuffle; the two windows share its partitioning.
    """
    tokens = T.tokenize(text) if stop is None else T.content_tokens(text, stop, shortest)
    found = docs.select(key, F.posexplode(tokens).alias("pos", "token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    ranked = found.withColumn("rank", F.row_number().over(order)).withColumn("top", F.max("n").over(Window.partitionBy(key)))
    return ranked.where(F.col("rank") <= limit).select(key, "token", "n", "rank", F.round(F.col("n") / F.col("top"), 4).alias("weight"))


def term_maps(docs: DataFrame, key: str, text: str, limit: int = 18, stop: list[str] | None = None, shortest: int = 3) -> DataFrame:
    """(key, keywords, vector_terms) for keys with at least one token."""
    terms = ranked_terms(docs, key, text, limit, stop, shortest)
    rows = F.sort_array(F.collect_list(F.struct("rank", "token", "weight")))
    return terms.groupBy(key).agg(rows.alias("x")).select(key, F.col("x.token").alias("keywords"), F.map_from_arrays("x.token", "x.weight").alias("vector_terms"))
