from pyspark.sql import functions as F

from assaylake.operators import design, simulation

RUN = "task_id string, method string, status string, success boolean, usage array<struct<prompt_tokens:bigint,completion_tokens:bigint>>, metrics struct<strict_success:int,macro_state_f1:double,critical_errors:int,input_tokens:bigint,output_tokens:bigint,validator_cost:double>"


def test_metrics_count_by_intention_to_treat(spark):
    rows = [
        ("a", "m", "ok", True, None, (1, 0.5, 2, 10, 20, 0.0)),
        ("b", "m", "OK", None, [(3, 4), (5, None)], None),
        ("c", "m", "timeout", True, None, (1, 0.9, 7, None, None, 0.0)),
        ("d", "m", None, True, [], None),
    ]
    out = {r.task_id: r for r in design.run_metrics(spark.createDataFrame(rows, RUN), "task_id").collect()}
    assert (out["a"].strict_success, out["a"].macro_state_f1, out["a"].input_tokens) == (1, 0.5, 10)
    assert (out["b"].strict_success, out["b"].macro_state_f1, out["b"].input_tokens, out["b"].output_tokens) == (0, 0.0, 8, 4)
    assert (out["c"].strict_success, out["c"].macro_state_f1, out["c"].critical_errors) == (0, 0.0, 7)
    assert out["d"].strict_success == 0 and out["d"].input_tokens == 0


def test_full_cube_recovers_the_effect_that_made_it(spark):
    units = spark.range(50).select(F.col("id").alias("task"))
    cube = design.design(units, typing=[-1, 1], provenance=[-1, 1], checks=[-1, 1]).withColumn("y", (F.col("checks") > 0).cast("int"))
    effects = {r.term: r.effect for r in design.factorial_effects(cube, ["typing", "provenance", "checks"], "y", []).collect()}
    assert cube.count() == 400 and effects["checks"] == 1 and effects["typing"] == 0 and effects["typing:provenance:checks"] == 0


def test_reconciliation_names_each_kind_of_cell_and_matches_nulls(spark):
    due = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "t string, s int")
    seen = spark.createDataFrame([("a", 1), ("a", 1), ("c", None), ("z", 9)], "t string, s int")
    out = {(r.t, r.s): r.verdict for r in design.reconciled(due, seen, ["t", "s"]).collect()}
    assert out == {("a", 1): "duplicate", ("b", 1): "missing", ("c", None): "ok", ("z", 9): "unscheduled"}


def test_paired_joint_and_block(spark):
    rows = [("t1", "o", 1, "h"), ("t1", "s", 0, "h"), ("t2", "o", 1, "h"), ("t2", "s", 1, "k"), ("t3", "o", 0, "h")]
    df = spark.createDataFrame(rows, "task string, method string, y int, hash string")
    assert sorted((r.task, r.difference) for r in design.paired(df, ["task"], "method", "s", "o", "y").collect()) == [("t1", -1.0), ("t2", 0.0)]
    hit = design.joint_incidence(df, ["task"], "method", "o", ["s"], "y").first()
    assert (hit.n_pairs, hit.n_regressed, hit.rate) == (2, 1, 0.5)
    fair = {r.task: r.fair for r in design.block_audit(df, ["task"], "method", ["hash"]).collect()}
    assert fair == {"t1": True, "t2": False, "t3": True}


def test_rollups_and_zero_filled(spark):
    df = spark.createDataFrame([("m", "a", 1), ("m", None, 0)], "method string, model string, y int")
    out = {(r.method, r.model): (r.n, r.n_success) for r in design.rollup_rates(df, "method", "model", "y").collect()}
    assert out == {("m", "all"): (2, 1), ("m", "a"): (1, 1), ("m", "?"): (1, 0)}
    counts = spark.createDataFrame([("x", 3)], "k string, n long")
    assert {r.k: r.n for r in design.zero_filled(counts, "k", ["x", "y"]).collect()} == {"x": 3, "y": 0}


def test_empty_tables_give_no_rows(spark):
    none = spark.createDataFrame([], RUN)
    metrics = design.run_metrics(none, "task_id", "method")
    assert metrics.count() == 0
    assert design.paired(metrics, ["task_id"], "method", "a", "b", "strict_success").count() == 0


def test_power_grows_with_families(spark):
    out = {r.n_families: r.power for r in simulation.power_grid(spark, [10, 200], [0.1], [0.1], replications=40).collect()}
    assert out[200] > out[10]
