"""Constraints as queries: each gives rows (rule_id, key, detail) for what breaks it, and an audit turns them into gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, rule_id: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def key_of(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def unique(df: DataFrame, rule_id: str, *columns: str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return _rows(df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1"), rule_id, key_of(*columns), F.col("n"))


def holds(df: DataFrame, rule_id: str, key: str, condition: Column, detail: Column) -> DataFrame:
    """Rows for which the condition isn't true (null counts as broken)."""
    return _rows(df.filter(~F.coalesce(condition, F.lit(False))), rule_id, F.col(key), detail)


def not_null(df: DataFrame, rule_id: str, key: str, *columns: str) -> DataFrame:
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in columns])
    return holds(df, rule_id, key, reduce(Column.__and__, [F.col(c).isNotNull() for c in columns]), missing)


def in_domain(df: DataFrame, rule_id: str, key: str, column: str, allowed: list) -> DataFrame:
    """Values outside the domain; null is outside."""
    return holds(df, rule_id, key, F.col(column).isin(*allowed), F.col(column))


def row_rules(df: DataFrame, key: str, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Rows that break any of the rules {rule_id: (condition, detail)}, one row per rule broken, in one scan of df.

    A condition that is null counts as broken.
    """
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule_id"), detail.cast("string").alias("detail"))) for name, (ok, detail) in rules.items()]
    found = df.select(F.col(key).cast("string").alias("key"), F.inline(F.array_compact(F.array(*broken))))
    return found.select("rule_id", "key", "detail")


def foreign_key(df: DataFrame, rule_id: str, key: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-null references without a parent: an anti-join."""
    known = parent.select(F.col(parent_column).alias(column)).distinct()
    return _rows(df.filter(F.col(column).isNotNull()).join(known, column, "left_anti"), rule_id, F.col(key), F.col(column))


def subset(df: DataFrame, rule_id: str, key: str, inner: Column, outer: Column) -> DataFrame:
    """Rows whose array `inner` holds more than `outer`; null arrays are empty."""
    none = F.array().cast("array<string>")
    extra = F.array_except(F.coalesce(inner, none), F.coalesce(outer, none))
    return _rows(df.filter(F.size(extra) > 0), rule_id, F.col(key), F.array_join(extra, ","))


def violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def audit(found: DataFrame, rules: list[str]) -> DataFrame:
    """rule_id, n_violations, passed for every rule, also for those that nothing breaks."""
    names = found.sparkSession.createDataFrame([(r,) for r in rules], "rule_id string")
    counts = found.groupBy("rule_id").agg(F.count("*").alias("n_violations"))
    return names.join(counts, "rule_id", "left").select("rule_id", F.coalesce("n_violations", F.lit(0)).alias("n_violations"), F.col("n_violations").isNull().alias("passed"))


def gate(audited: DataFrame) -> DataFrame:
    """One row: n_rules, n_failed, passed."""
    return audited.agg(F.count("*").alias("n_rules"), F.sum((~F.col("passed")).cast("long")).alias("n_failed"), F.every("passed").alias("passed"))
