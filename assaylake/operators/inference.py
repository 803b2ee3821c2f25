"""Intervals and tests whose inputs are aggregated in one pass and whose draws are reproducible from a seed.

Resampling uses the MD5 of (seed, draw, block of places) as its source of picks, so any engine gives the same draws; only
sufficient statistics per cluster (sum and count) are resampled, never rows. The clusters' statistics of a group go as one array
to tasks that each make a range of draws: picks are neither joined nor shuffled, and nothing is sorted but a group's draws.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.arrow import map_rows
from assaylake.functions.columns import log_factorial

#: Draws of one row that goes to a task; clusters up to which sign flips are enumerated.
DRAWS_A_ROW, ENUMERATED = 250, 18


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of Wilson's interval of a rate; null where n is 0."""
    count = F.when(n > 0, n.cast("double"))
    p, z2 = successes / count, F.lit(z * z)
    centre = p + z2 / (2 * count)
    half = F.lit(z) * F.sqrt(p * (1 - p) / count + z2 / (4 * count * count))
    return (centre - half) / (1 + z2 / count), (centre + half) / (1 + z2 / count)


def holm(tests: DataFrame, p: str, *keys: str) -> DataFrame:
    """Step-down adjusted p-values as p_holm; ties in the order of keys. One window over the tests, which are few."""
    order = Window.orderBy(F.col(p), *map(F.col, keys))
    total = tests.filter(F.col(p).isNotNull()).agg(F.count("*").alias("n_tests"))
    stepped = tests.filter(F.col(p).isNotNull()).join(F.broadcast(total)).withColumn(
        "step", F.least(F.lit(1.0), (F.col("n_tests") - F.row_number().over(order) + 1) * F.col(p))
    )
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return stepped.withColumn("p_holm", F.max("step").over(running)).drop("step", "n_tests")


def mcnemar(left_only: Column, right_only: Column) -> Column:
    """Exact two-sided p of discordant pairs: 1 without any, never above 1."""
    n, k = left_only + right_only, F.least(left_only, right_only)
    base = log_factorial(n) - n * F.log(F.lit(2.0))
    terms = F.transform(F.sequence(F.lit(0).cast("long"), k.cast("long")), lambda i: F.exp(base - log_factorial(i) - log_factorial(n - i)))
    tail = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def kappa(pairs: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """by, n, observed, expected, kappa: null kappa unless each rater uses two labels. Rows with a null label don't count."""
    both = pairs.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    cells = both.groupBy(*by, first, second).agg(F.count("*").alias("cell"))
    over = Window.partitionBy(*by)
    marked = cells.select(
        *by, "cell", (F.col(first) == F.col(second)).alias("same"), F.sum("cell").over(over).alias("n"),
        F.sum("cell").over(Window.partitionBy(*by, first)).alias("row_sum"), F.col(first).alias("label_a"), F.col(second).alias("label_b"),
    )
    rows = marked.select(*by, "n", F.col("label_a").alias("label"), "row_sum").distinct()
    columns = cells.groupBy(*by, F.col(second).alias("label")).agg(F.sum("cell").alias("column_sum"))
    expected = rows.join(columns, [*by, "label"]).groupBy(*by).agg(F.sum(F.col("row_sum") * F.col("column_sum") / (F.col("n") * F.col("n"))).alias("expected"))
    summary = marked.groupBy(*by).agg(
        F.max("n").alias("n"), (F.sum(F.when(F.col("same"), F.col("cell")).otherwise(0)) / F.max("n")).alias("observed"),
        F.count_distinct("label_a").alias("labels_a"), F.count_distinct("label_b").alias("labels_b"),
    )
    out = summary.join(expected, by, "left") if by else summary.crossJoin(expected)
    expected_or_0 = F.coalesce("expected", F.lit(0.0))
    value = F.when((F.col("labels_a") > 1) & (F.col("labels_b") > 1), F.try_divide(F.col("observed") - expected_or_0, 1 - expected_or_0))
    return out.select(*by, "n", "observed", expected_or_0.alias("expected"), value.alias("kappa"))


def poisson_binomial_tail(probabilities: Column, observed: Column) -> Column:
    """P(at least `observed` successes) of independent trials: a fold over the trials, meant for short arrays."""
    start = F.array(F.lit(1.0))
    shift = lambda dist, p: F.transform(
        F.sequence(F.lit(0), F.size(dist)),
        lambda i: F.coalesce(F.try_element_at(dist, i + 1), F.lit(0.0)) * (1 - p) + F.when(i > 0, F.coalesce(F.try_element_at(dist, F.when(i > 0, i).otherwise(F.lit(1))), F.lit(0.0)) * p).otherwise(F.lit(0.0)),
    )
    spread = F.aggregate(probabilities, start, shift)
    return F.aggregate(F.slice(spread, observed.cast("int") + 1, F.size(spread)), F.lit(0.0), lambda a, x: a + x)


def _digests(seed: int, draw: int, blocks: int) -> bytes:
    return b"".join(hashlib.md5(b"%d:%d:%d" % (seed, draw, block)).digest() for block in range(blocks))


def picks(seed: int, draw: int, clusters: int) -> np.ndarray:
    """The clusters of a draw: the digest of (seed, draw, i // 4) has four numbers of 32 bits, for the places i."""
    units = np.frombuffer(_digests(seed, draw, -(-clusters // 4)), ">u4")[:clusters]
    return np.floor(units / 4294967296.0 * clusters).astype(np.int64)


def signs(seed: int, draw: int, clusters: int) -> np.ndarray:
    """-1 or 1 per cluster: the bits of the digests of (seed, draw, i // 128), the highest first; 1 for a set bit."""
    bits = np.unpackbits(np.frombuffer(_digests(seed, draw, -(-clusters // 128)), np.uint8))[:clusters]
    return bits * 2.0 - 1.0


def _in_ranges(df: DataFrame, draws: int) -> DataFrame:
    """Every row once per range of draws, spread over the tasks."""
    starts = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS_A_ROW))).alias("start")
    out = df.select("*", starts)
    return out.repartition(max(1, min(-(-draws // DRAWS_A_ROW), out.sparkSession.sparkContext.defaultParallelism * 4)), "start")


def cluster_bootstrap(rows: DataFrame, cluster: str, y: str, by: list[str], draws: int = 10_000, seed: int = 2027) -> DataFrame:
    """by, n_clusters, mean, ci_low, ci_high: percentile interval of the pooled mean over resampled clusters.

    The bounds are the draws at the indices int(.025 d) and max(0, int(.975 d) - 1), not interpolated. A group's clusters (two
    numbers each) are one array.
    """
    sums = rows.filter(F.col(y).isNotNull()).groupBy(*by, cluster).agg(F.sum(F.col(y).cast("double")).alias("y"), F.count("*").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), "y", F.col("n").cast("double").alias("n"))))
    groups = sums.groupBy(*by).agg(F.count("*").alias("n_clusters"), (F.sum("y") / F.sum("n")).alias("mean"), listed.alias("x"))
    groups = groups.select(F.struct(*by, F.lit(0).alias("_")).alias("g"), "n_clusters", "mean", F.col("x.y").alias("ys"), F.col("x.n").alias("ns"))

    def make():
        def row(g, n_clusters, mean, ys, ns, start):
            ys, ns = np.asarray(ys), np.asarray(ns)
            values = []
            for draw in range(start, min(start + DRAWS_A_ROW, draws)):
                at = picks(seed, draw, len(ys))
                values.append(float(ys[at].sum() / ns[at].sum()))
            yield g, n_clusters, mean, values

        return row

    kind = dict(groups.dtypes)["g"]
    drawn = map_rows(_in_ranges(groups, draws), ["g", "n_clusters", "mean", "ys", "ns", "start"], make, f"g {kind}, n_clusters long, mean double, drawn array<double>")
    ranked = F.sort_array(F.flatten(F.collect_list("drawn")))
    out = drawn.groupBy("g").agg(F.first("n_clusters").alias("n_clusters"), F.first("mean").alias("mean"), ranked.alias("v"))
    low, high = int(0.025 * draws), max(0, int(0.975 * draws) - 1)
    return out.select(*[F.col(f"g.{c}").alias(c) for c in by], "n_clusters", "mean", F.element_at("v", low + 1).alias("ci_low"), F.element_at("v", high + 1).alias("ci_high"))


def sign_flip(effects: DataFrame, cluster: str, y: str, draws: int = 20_000, seed: int = 2027, enumerated: int = ENUMERATED) -> DataFrame:
    """n_clusters, observed mean, p of the two-sided sign-flip test over cluster means: (1 + extremes) / (1 + flips).

    Up to `enumerated` clusters all 2^n flips are made, beyond that `draws` of them. No cluster: a row of 0, null, null.
    """
    means = effects.filter(F.col(y).isNotNull()).groupBy(cluster).agg(F.avg(F.col(y).cast("double")).alias("y"))
    one = means.agg(F.count("*").alias("n_clusters"), F.avg("y").alias("observed"), F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), "y"))).alias("x"))
    flips = F.when(F.col("n_clusters") <= enumerated, F.expr("shiftleft(1, cast(least(n_clusters, 30) as int))")).otherwise(F.lit(draws))
    wide = one.select("n_clusters", "observed", F.col("x.y").alias("ys"), flips.alias("flips"))
    ranges = wide.select("*", F.explode(F.sequence(F.lit(0), F.col("flips") - 1, F.lit(DRAWS_A_ROW * 16))).alias("start")).repartition(8, "start")

    def make():
        def row(n_clusters, observed, ys, flips, start):
            ys, extreme = np.asarray(ys, np.float64), 0
            bits = np.arange(n_clusters)
            for draw in range(start, min(start + DRAWS_A_ROW * 16, flips)):
                sign = (draw >> bits & 1) * 2.0 - 1.0 if n_clusters <= enumerated else signs(seed, draw, n_clusters)
                extreme += n_clusters > 0 and abs(float((sign * ys).mean())) >= abs(observed) - 1e-12
            yield n_clusters, observed, flips, extreme

        return row

    counted = map_rows(ranges, ["n_clusters", "observed", "ys", "flips", "start"], make, "n_clusters long, observed double, flips long, extreme long")
    p = F.when(F.col("n_clusters") > 0, (F.sum("extreme") + 1) / (F.first("flips") + 1))
    return counted.groupBy("n_clusters", "observed").agg(p.alias("p_value"))
