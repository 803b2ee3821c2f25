"""Ordered event logs: duplicates, budgets, order, preconditions, folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_duplicates(events: DataFrame, keys: list[str], order: list[str], eligible: str | None = None) -> DataFrame:
    """events with is_duplicate: an earlier eligible event has the same keys, and this one is eligible.

    Only the first eligible event of each key matters, so an aggregation (combined before its shuffle) and a join on the keys
    decide, and no task sorts a hot key's events. Null keys are keys like any other; order must tell events apart.
    """
    flag = F.coalesce(F.col(eligible), F.lit(False)) if eligible else F.lit(True)
    at = F.struct(*order)
    first = events.filter(flag).groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(F.min(at).alias("first_at"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"key_{k}"))
    joined = events.join(first, same, "left")
    late = F.coalesce(at > F.col("first_at"), F.lit(False))
    return joined.withColumn("is_duplicate", flag & late).select(*events.columns, "is_duplicate")


def over_budget(events: DataFrame, keys: list[str], order: list[str], budget: int) -> DataFrame:
    """events beyond the first `budget` of their keys, with their number."""
    return events.withColumn("call_no", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("call_no") > budget)


def in_order(events: DataFrame, key: str, name: str, order: list[str], wanted: list[str]) -> DataFrame:
    """key, n_matched, complete: how many of the wanted names occur one after the other, matched greedily.

    A fold of minima: the first place of each name behind the one before it. One window per name over events sorted once per
    key, with nothing collected.
    """
    numbered = events.filter(F.col(name).isin(*wanted)).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    whole = Window.partitionBy(key)
    at = F.lit(0)
    columns = []
    for i, step in enumerate(wanted):
        numbered = numbered.withColumn(f"at_{i}", F.min(F.when((F.col(name) == step) & (F.col("place") > at), F.col("place"))).over(whole))
        at = F.coalesce(F.col(f"at_{i}"), F.lit(2**31 - 1))
        columns.append(f"at_{i}")
    matched = sum((F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in columns), F.lit(0))
    out = numbered.groupBy(key).agg(F.max(matched).alias("n_matched"))
    return out.withColumn("complete", F.col("n_matched") == len(wanted))


def precondition_breaches(events: DataFrame, key: str, name: str, order: list[str], action: str, needs: str) -> DataFrame:
    """Events named `action` before any event named `needs` of the same key."""
    earlier = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max((F.col(name) == needs).cast("int")).over(earlier), F.lit(0))
    return events.withColumn("ready", seen).filter((F.col(name) == action) & (F.col("ready") == 0)).drop("ready")


def folded_state(events: DataFrame, key: str, slot: str, value: str, order: list[str]) -> DataFrame:
    """key, slot, last value, n_updates: the state after all events."""
    return events.groupBy(key, slot).agg(F.max_by(value, F.struct(*order)).alias("value"), F.count("*").alias("n_updates"))


def first_by(rows: DataFrame, keys: list[str], order: list[str], *keep: str) -> DataFrame:
    """The first row of each key in the given order: a partial aggregation, no sort."""
    first = F.min_by(F.struct(*keep), F.struct(*order)).alias("first")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"first.{c}").alias(c) for c in keep])


def mode_lowest(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of those that tie, and its count. Null values don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("less"), F.col(value))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col(f"best.{value}").alias(value), F.col("best.n").alias("n"))


def sessions(events: DataFrame, key: str, at: str, order: list[str], gap_seconds: int) -> DataFrame:
    """key, session_no, n_events, seconds: events with gaps of at most gap_seconds between them."""
    run = Window.partitionBy(key).orderBy(*order)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    new = F.coalesce((seconds - F.lag(seconds).over(run) > gap_seconds).cast("int"), F.lit(0))
    marked = events.select(key, seconds.alias("s"), new.alias("new"), *[c for c in order if c not in (key,)])
    numbered = marked.withColumn("session_no", F.sum("new").over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session_no").agg(F.count("*").alias("n_events"), (F.max("s") - F.min("s")).alias("seconds"))
