"""Overlap audits between two sets of texts: equal and normalised hashes, and Jaccard similarity of shingles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.columns import normalized_text, shingles, words


def duplicate_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """text_hash, n, first_key of normalised texts that occur more than once; null texts don't count."""
    hashed = rows.filter(F.col(text).isNotNull()).select(key, F.sha2(normalized_text(text), 256).alias("text_hash"))
    return hashed.groupBy("text_hash").agg(F.count("*").alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def collisions(a: DataFrame, b: DataFrame, a_key: str, b_key: str, signal: str) -> DataFrame:
    """a_key, n_matches, first_match: rows of a with the signal of rows of b; null matches null."""
    grouped = b.groupBy(F.col(signal).alias("b_signal")).agg(F.count("*").alias("n_matches"), F.min(b_key).alias("first_match"))
    return a.join(grouped, F.col(signal).eqNullSafe(F.col("b_signal"))).select(a_key, "n_matches", "first_match")


def jaccard(a: DataFrame, b: DataFrame, a_key: str, b_key: str, text: str, size: int = 2) -> DataFrame:
    """a_key, b_key, n_shared, jaccard of all pairs that share a shingle: an equality join on shingles, then counts.

    Pairs that share none have a similarity of 0 and no row.
    """
    cut = lambda df, key: df.filter(F.col(text).isNotNull()).select(key, words(text).alias("w")).select(key, shingles(F.col("w"), size).alias("s")).select(key, F.size("s").alias(f"n_{key}"), F.explode("s").alias("shingle"))
    shared = cut(a, a_key).join(cut(b, b_key), "shingle").groupBy(a_key, b_key).agg(F.count("*").alias("n_shared"), F.first(f"n_{a_key}").alias("n_a"), F.first(f"n_{b_key}").alias("n_b"))
    return shared.select(a_key, b_key, "n_shared", (F.col("n_shared") / (F.col("n_a") + F.col("n_b") - F.col("n_shared"))).alias("jaccard"))


def top_per_key(pairs: DataFrame, key: str, other: str, score: str, k: int) -> DataFrame:
    """The k best pairs of each key, ties by the other's key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(other)))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)
