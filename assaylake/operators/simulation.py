"""Power of a paired, clustered comparison by simulation: a grid of cells whose replications are drawn and tested in Spark."""

from __future__ import annotations

import math
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.arrow import map_rows

#: Replications of one row that goes to a task.
CHUNK = 25


def replication(rng: np.random.Generator, families: int, icc: float, effect: float, baseline: float, models: int, seeds: int, draws: int, alpha: float) -> tuple[float, float, bool]:
    """(mean difference, share of discordant pairs, whether its interval excludes 0) of one simulated study.

    A family has a random intercept on the logit scale with the variance that gives the icc, each model a fixed offset; the
    treatment adds `effect` to the probability. The interval is the percentile bootstrap over families. A family's difference
    has few values, so a resample of families is a multinomial draw of how often each value comes.
    """
    offsets = np.linspace(-0.3, 0.3, models) if models > 1 else np.zeros(1)
    intercept = rng.normal(0, math.sqrt(icc * math.pi**2 / 3 / (1 - icc)), (families, 1, 1))
    low = np.broadcast_to(1 / (1 + np.exp(-(math.log(baseline / (1 - baseline)) + intercept + offsets[None, :, None]))), (families, models, seeds))
    pairs = rng.binomial(1, np.minimum(low + effect, 1.0)) - rng.binomial(1, low)
    values, counts = np.unique(pairs.mean((1, 2)), return_counts=True)
    resampled = rng.multinomial(families, counts / families, draws) @ values / families
    bounds = np.quantile(resampled, [alpha / 2, 1 - alpha / 2])
    return float(pairs.mean()), float((pairs != 0).mean()), bool(bounds[0] > 0 or bounds[1] < 0)


def power_grid(
    spark: SparkSession, families: tuple[int, ...] = (80, 120, 160, 200), iccs: tuple[float, ...] = (0.05, 0.1, 0.2), effects: tuple[float, ...] = (0.05, 0.08, 0.1), replications: int = 1000,
    baseline: float = 0.55, models: int = 2, seeds: int = 1, draws: int = 1000, alpha: float = 0.05, seed: int = 270127,
) -> DataFrame:
    """n_families, icc, effect, estimated_effect, mean_discordance, power, mc_error of every cell.

    A replication's numbers depend on the seed, the cell and its number only, not on partitions.
    """
    cells = [(c, n, float(icc), float(e)) for c, (e, icc, n) in enumerate(product(effects, iccs, families))]
    chunks = spark.createDataFrame(cells, "cell int, n_families int, icc double, effect double").select("*", F.explode(F.sequence(F.lit(0), F.lit(replications - 1), F.lit(CHUNK))).alias("start"))

    def make():
        def row(cell, n, icc, effect, start):
            for rep in range(start, min(start + CHUNK, replications)):
                rng = np.random.Generator(np.random.Philox(np.random.SeedSequence((seed, cell, rep))))
                yield n, icc, effect, *replication(rng, n, icc, effect, baseline, models, seeds, draws, alpha)

        return row

    spread = chunks.repartition(spark.sparkContext.defaultParallelism * 4, "cell", "start")
    drawn = map_rows(spread, ["cell", "n_families", "icc", "effect", "start"], make, "n_families int, icc double, effect double, estimate double, discordance double, hit boolean")
    power = F.avg(F.col("hit").cast("double"))
    return drawn.groupBy("n_families", "icc", "effect").agg(
        F.avg("estimate").alias("estimated_effect"), F.avg("discordance").alias("mean_discordance"), power.alias("power"), F.sqrt(power * (1 - power) / F.count("*")).alias("mc_error")
    )
