"""Run records against a design: reconciliation, block audits, paired contrasts, effect-coded factorials and roll-ups."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import truthy

METRICS = ("strict_success", "macro_state_f1", "critical_errors", "input_tokens", "output_tokens")


def run_metrics(runs: DataFrame, *keep: str) -> DataFrame:
    """keep and the metrics of each run, counted by intention to treat.

    strict_success needs status ok; macro_state_f1 is 0 unless ok; critical_errors are kept as written; tokens fall back from
    the metrics to the sums over usage.
    """
    ok = F.coalesce(F.lower("status") == "ok", F.lit(False))
    used = lambda field: F.aggregate(F.coalesce("usage", F.array().cast("array<struct<prompt_tokens:bigint,completion_tokens:bigint>>")), F.lit(0).cast("long"), lambda a, u: a + F.coalesce(u[field], F.lit(0)))
    return runs.select(
        *keep,
        F.when(ok, truthy("success")).otherwise(0).alias("strict_success"),
        F.when(ok, F.coalesce("metrics.macro_state_f1", F.lit(0.0))).otherwise(0.0).alias("macro_state_f1"),
        F.col("metrics.critical_errors").alias("critical_errors"),
        F.coalesce("metrics.input_tokens", used("prompt_tokens")).alias("input_tokens"),
        F.coalesce("metrics.output_tokens", used("completion_tokens")).alias("output_tokens"),
    )


def design(units: DataFrame, **levels: list) -> DataFrame:
    """Every unit with every combination of the levels: lists in the plan, so nothing is joined."""
    return reduce(lambda df, item: df.withColumn(item[0], F.explode(F.array(*map(F.lit, item[1])))), levels.items(), units)


def reconciled(scheduled: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_observed, verdict (ok, missing, unscheduled, duplicate) of a null-safe full outer match."""
    seen = observed.groupBy(*keys).agg(F.count("*").alias("n_observed"))
    due = scheduled.select(*keys).distinct().withColumn("due", F.lit(True))
    a, b = due.alias("a"), seen.alias("b")
    on = reduce(Column.__and__, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    verdict = F.when(F.col("a.due").isNull(), "unscheduled").when(F.col("n_observed").isNull(), "missing").when(F.col("n_observed") > 1, "duplicate").otherwise("ok")
    return a.join(b, on, "full_outer").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], F.coalesce("n_observed", F.lit(0)).alias("n_observed"), verdict.alias("verdict"))


def block_audit(rows: DataFrame, block: list[str], level: str, same: list[str]) -> DataFrame:
    """block, n, levels and per column of `same` its number of distinct values; fair if each is 1 and no level repeats."""
    out = rows.groupBy(*block).agg(F.count("*").alias("n"), F.count_distinct(level).alias("levels"), *[F.count_distinct(c).alias(f"{c}_values") for c in same])
    fair = reduce(Column.__and__, [F.col(f"{c}_values") == 1 for c in same], F.col("n") == F.col("levels"))
    return out.withColumn("fair", fair)


def factorial_effects(rows: DataFrame, factors: list[str], y: str, by: list[str]) -> DataFrame:
    """by, term, effect = mean of 2 y times the product of the term's +-1 factors, for all terms; one aggregation."""
    terms = [c for n in range(1, len(factors) + 1) for c in combinations(factors, n)]
    effects = rows.groupBy(*by).agg(
        F.count("*").alias("n"), *[F.avg(2 * F.col(y).cast("double") * reduce(Column.__mul__, [F.col(f) for f in term])).alias(":".join(term)) for term in terms]
    )
    stacked = F.array(*[F.struct(F.lit(":".join(t)).alias("term"), F.col(f"`{':'.join(t)}`").alias("effect")) for t in terms])
    return effects.select(*by, "n", F.inline(stacked))


def wide(rows: DataFrame, unit: list[str], level: str, levels: list[str], metrics: list[str]) -> DataFrame:
    """One row per unit with a column per level and metric (means over repeated rows)."""
    return rows.groupBy(*unit).pivot(level, levels).agg(*[F.avg(F.col(m).cast("double")).alias(m) for m in metrics])


def paired(rows: DataFrame, unit: list[str], level: str, left: str, right: str, metric: str) -> DataFrame:
    """unit, left_value, right_value, difference of the complete pairs, values averaged over repeated rows."""
    value = lambda name: F.avg(F.when(F.col(level) == name, F.col(metric).cast("double")))
    pairs = rows.filter(F.col(level).isin(left, right)).groupBy(*unit).agg(value(left).alias("left_value"), value(right).alias("right_value"))
    return pairs.filter("left_value is not null and right_value is not null").withColumn("difference", F.col("left_value") - F.col("right_value"))


def joint_incidence(rows: DataFrame, unit: list[str], level: str, reference: str, targets: list[str], flag: str) -> DataFrame:
    """level, n_pairs, n_regressed, rate of units where the reference succeeds and the target fails, over all pairs."""
    best = rows.filter(F.col(level) == reference).groupBy(*unit).agg(F.max(flag).alias("ref"))
    other = rows.filter(F.col(level).isin(*targets)).groupBy(*unit, level).agg(F.max(flag).alias("target"))
    hit = ((F.col("ref") == 1) & (F.col("target") == 0)).cast("long")
    return other.join(best, unit).groupBy(level).agg(F.count("*").alias("n_pairs"), F.sum(hit).alias("n_regressed"), F.avg(hit.cast("double")).alias("rate"))


def rollup_rates(rows: DataFrame, level: str, variant: str, flag: str) -> DataFrame:
    """level, variant ('all' for the roll-up), n, n_success: grouping sets in one pass."""
    sets = rows.select(level, F.coalesce(variant, F.lit("?")).alias(variant), F.col(flag).cast("long").alias(flag))
    return (
        sets.groupingSets([[level], [level, variant]], level, variant)
        .agg(F.count("*").alias("n"), F.sum(flag).alias("n_success"), F.grouping(variant).alias("whole"))
        .select(level, F.when(F.col("whole") == 1, "all").otherwise(F.col(variant)).alias(variant), "n", "n_success")
    )


def zero_filled(counts: DataFrame, label: str, declared: list[str], count: str = "n") -> DataFrame:
    """The counts of all declared and all seen labels, 0 where none."""
    spark = counts.sparkSession
    names = spark.createDataFrame([(d,) for d in declared], f"{label} string")
    return names.unionAll(counts.select(label)).distinct().join(counts, label, "left").select(label, F.coalesce(count, F.lit(0)).alias(count))
