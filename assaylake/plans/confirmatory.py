"""The confirmatory analysis of a run table: gates first, then rates, contrasts and inference as named frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.operators import constraints, design, inference
from assaylake.session import materialize


def confirmatory(spark: SparkSession, runs: DataFrame, structured: str, oracle: str, draws: int = 10_000) -> dict[str, DataFrame]:
    """gates, rates, contrasts, intervals, tests. The metrics are computed once and written to the shared folder."""
    metrics = materialize(design.run_metrics(runs, "task_id", "model", "seed", "method", "status"), "run-metrics")
    rates = design.rollup_rates(metrics, "method", "model", "strict_success")
    low, high = inference.wilson(F.col("n_success"), F.col("n"))
    pairs = materialize(design.paired(metrics, ["task_id", "model", "seed"], "method", structured, oracle, "strict_success"), "pairs")
    discordant = pairs.agg(F.sum((F.col("difference") > 0).cast("long")).alias("left_only"), F.sum((F.col("difference") < 0).cast("long")).alias("right_only"))
    found = constraints.violations(
        constraints.unique(metrics, "cell", "task_id", "model", "seed", "method"),
        constraints.not_null(metrics, "keys", "task_id", "task_id", "model", "seed", "method"),
    )
    return {
        "gates": constraints.audit(found, ["cell", "keys"]),
        "rates": rates.withColumn("ci_low", low).withColumn("ci_high", high),
        "contrasts": pairs.groupBy("model").agg(F.count("*").alias("n_pairs"), F.avg("difference").alias("difference")),
        "intervals": inference.cluster_bootstrap(pairs, "task_id", "difference", [], draws),
        "tests": discordant.withColumn("p_value", inference.mcnemar(F.col("left_only"), F.col("right_only"))),
    }


def render(frames: dict[str, DataFrame]) -> str:
    """A Markdown report."""
    from assaylake.sources.files import render_table

    return "\n\n".join(f"## {name}\n\n{render_table(df)}" for name, df in frames.items())
