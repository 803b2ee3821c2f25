import math
import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from assaylake.operators import inference


def test_wilson_matches_the_formula_and_is_null_for_no_trials(spark):
    low, high = inference.wilson(F.col("s"), F.col("n"))
    rows = spark.createDataFrame([(69, 200), (0, 0), (5, 5)], "s int, n int").select("n", low.alias("lo"), high.alias("hi")).collect()
    by = {r.n: r for r in rows}
    assert round(by[200].lo, 4) == 0.2826 and round(by[200].hi, 4) == 0.4132
    assert by[0].lo is None and by[0].hi is None
    assert by[5].hi == pytest.approx(1.0)


def test_holm_steps_down_and_never_decreases(spark):
    rows = [("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None), ("e", 0.9)]
    out = {r.k: r.p_holm for r in inference.holm(spark.createDataFrame(rows, "k string, p double"), "p", "k").collect()}
    assert out == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "e": pytest.approx(0.9)}


@pytest.mark.parametrize(("left", "right", "p"), [(0, 0, 1.0), (0, 10, 2 / 2**10), (3, 5, 0.7265625), (0, 400, 2 / 2**400)])
def test_mcnemar_is_exact(spark, left, right, p):
    df = spark.createDataFrame([(left, right)], "l long, r long").select(inference.mcnemar(F.col("l"), F.col("r")).alias("p"))
    assert df.first().p == pytest.approx(p, rel=1e-6, abs=1e-300)


def test_kappa_by_group_and_null_for_one_label(spark):
    rows = [("x", 1, 1)] * 20 + [("x", 1, 0)] * 5 + [("x", 0, 1)] * 10 + [("x", 0, 0)] * 15 + [("y", 1, 1)] * 3 + [("x", None, 1)]
    out = {r.g: r for r in inference.kappa(spark.createDataFrame(rows, "g string, a int, b int"), "a", "b", ["g"]).collect()}
    assert out["x"].kappa == pytest.approx(0.4) and out["x"].n == 50
    assert out["y"].kappa is None and out["y"].observed == 1


def test_poisson_binomial_tail_equals_enumeration(spark):
    ps = [0.1, 0.5, 0.7, 0.2]
    want = sum(math.prod(p if hit else 1 - p for p, hit in zip(ps, hits, strict=True)) for hits in product([0, 1], repeat=4) if sum(hits) >= 2)
    df = spark.createDataFrame([(ps, 2), (ps, 0), ([], 1)], "ps array<double>, k int").select(inference.poisson_binomial_tail(F.col("ps"), F.col("k")).alias("t"))
    got = [r.t for r in df.collect()]
    assert got[0] == pytest.approx(want) and got[1] == pytest.approx(1) and got[2] == pytest.approx(0)


def test_bootstrap_is_reproducible_and_covers_the_mean(spark):
    rnd = random.Random(1)
    rows = [("g", f"c{i % 20}", rnd.random() < 0.4) for i in range(400)]
    df = spark.createDataFrame([(g, c, int(y)) for g, c, y in rows], "g string, c string, y int")
    a = inference.cluster_bootstrap(df, "c", "y", ["g"], 100).first()
    b = inference.cluster_bootstrap(df.repartition(3), "c", "y", ["g"], 100).first()
    assert a == b and a.ci_low < a.mean < a.ci_high and a.n_clusters == 20


def test_sign_flip_is_small_for_one_sided_effects(spark):
    one_sided = spark.createDataFrame([(f"c{i}", 1.0 + i / 10) for i in range(12)], "c string, y double")
    assert inference.sign_flip(one_sided, "c", "y", 200).first().p_value < 0.05
    even = spark.createDataFrame([(f"c{i}", 1.0 if i % 2 else -1.0) for i in range(12)], "c string, y double")
    assert inference.sign_flip(even, "c", "y", 200).first().p_value == 1


def test_sign_flips_are_enumerated_for_few_clusters(spark):
    from itertools import product

    values = [0.5, -0.25, 0.75, 0.5, 0.1, 0.3, -0.05]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "c int, y double")
    flips = [abs(sum(v * s for v, s in zip(values, signs, strict=True)) / 7) for signs in product((-1, 1), repeat=7)]
    want = (1 + sum(f >= abs(sum(values) / 7) - 1e-12 for f in flips)) / (len(flips) + 1)
    got = inference.sign_flip(df, "c", "y").first()
    assert got.p_value == want and got.n_clusters == 7
    assert abs(inference.sign_flip(df, "c", "y", 20_000, enumerated=3).first().p_value - want) < 0.02
    none = inference.sign_flip(df.limit(0), "c", "y").first()
    assert (none.n_clusters, none.observed, none.p_value) == (0, None, None)


def test_power_of_published_cells_and_of_any_partitioning(spark):
    from assaylake.operators.simulation import power_grid

    grid = lambda: {(r.n_families, r.effect): r for r in power_grid(spark, (120, 200), (0.1,), (0.08, 0.1), replications=600).collect()}
    got = grid()
    for cell, power in {(200, 0.08): 0.691, (200, 0.1): 0.847, (120, 0.08): 0.441, (120, 0.1): 0.633}.items():
        assert abs(got[cell].power - power) < 0.06, (cell, got[cell].power)
    assert all(abs(r.estimated_effect - e) < 0.01 for (_, e), r in got.items())
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    assert grid() == got
    spark.conf.set("spark.sql.shuffle.partitions", "4")
