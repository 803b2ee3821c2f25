"""Two annotators' claims side by side: differences, agreement, resolution, and lineage of composed sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differences(a: DataFrame, b: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, kind (missing_from_a, missing_from_b, fields, none) and the differing fields of a full outer match."""
    x = a.select(*keys, F.struct(*fields).alias("left_claim"))
    y = b.select(*keys, F.struct(*fields).alias("right_claim"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"left_claim.{f}").eqNullSafe(F.col(f"right_claim.{f}")), F.lit(f)) for f in fields]))
    kind = F.when(F.col("left_claim").isNull(), "missing_from_a").when(F.col("right_claim").isNull(), "missing_from_b").when(F.size(differs) > 0, "fields").otherwise("none")
    return x.join(y, keys, "full_outer").select(*keys, kind.alias("kind"), F.when(kind == "fields", differs).otherwise(F.array().cast("array<string>")).alias("fields"))


def agreement(diffs: DataFrame, by: list[str], exact: list[str]) -> DataFrame:
    """by, n_a, n_b, tp, precision, recall, f1: claims are equal if none of the `exact` fields differs."""
    same = (F.col("kind").isin("none", "fields") & (F.size(F.array_intersect("fields", F.array(*map(F.lit, exact)))) == 0)).cast("long")
    out = diffs.groupBy(*by).agg(
        F.sum((F.col("kind") != "missing_from_a").cast("long")).alias("n_a"), F.sum((F.col("kind") != "missing_from_b").cast("long")).alias("n_b"), F.sum(same).alias("tp")
    )
    out = out.withColumn("precision", F.coalesce(F.try_divide("tp", "n_b"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("tp", "n_a"), F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_a") + F.col("n_b")), F.lit(0.0)))


def resolved(queue: DataFrame, rules: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """queue with `resolution`: the first rule whose condition is true."""
    choice = F.lit(otherwise)
    for code, condition in reversed(rules):
        choice = F.when(F.coalesce(condition, F.lit(False)), F.lit(code)).otherwise(choice)
    return queue.withColumn("resolution", choice)


def composed(parts: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """The union of named sets of keys with a lineage: key, origins (sorted names) and their number."""
    union = None
    for name, df in parts:
        one = df.select(key).distinct().withColumn("origin", F.lit(name))
        union = one if union is None else union.unionAll(one)
    return union.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origins"), F.count("*").alias("n_origins"))


def merged(base: DataFrame, patch: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """base with the patch's non-null fields in place of its own, and rows that only the patch has."""
    p = patch.select(*keys, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("patched"))
    out = base.select(*keys, *fields).join(p, keys, "full_outer")
    return out.select(*keys, *[F.coalesce(f"new_{f}", f).alias(f) for f in fields], F.coalesce("patched", F.lit(False)).alias("patched"))


def tiers(rows: DataFrame, weights: dict[str, int], bounds: list[tuple[str, int]], last: str) -> DataFrame:
    """rows with score (sum of the weights of true flags), codes (their names) and tier (first bound that the score reaches)."""
    score = sum((F.when(F.coalesce(F.col(c), F.lit(False)), w).otherwise(0) for c, w in weights.items()), F.lit(0))
    codes = F.array_join(F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in weights])), ",")
    tier = F.lit(last)
    for name, bound in sorted(bounds, key=lambda x: x[1]):
        tier = F.when(score >= bound, F.lit(name)).otherwise(tier)
    return rows.withColumn("score", score).withColumn("codes", codes).withColumn("tier", tier)
