import json

import pytest
from pyspark.sql import functions as F

from assaylake.functions import columns
from assaylake.plans.confirmatory import confirmatory, render
from assaylake.sources import files


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_run_trees_collapse_repeats_and_refuse_conflicts(spark, tmp_path):
    schema = "task_id string, seed int, status string"
    put(tmp_path / "a/x.json", {"task_id": "t", "seed": 1, "status": "ok"})
    put(tmp_path / "b/c/y.json", [{"task_id": "t", "seed": 1, "status": "ok"}, {"task_id": "u", "seed": 1, "status": "ok"}])
    for name in ("DEV", "x_Invalid_Protocol_1"):
        with pytest.raises(ValueError, match="not a folder of valid runs"):
            files.read_run_tree(spark, [str(tmp_path), str(tmp_path / name)], schema, ["task_id", "seed"])
    read = lambda how: files.read_run_tree(spark, [str(tmp_path)], schema, ["task_id", "seed"], how)
    assert sorted(r.task_id for r in read("keep").collect()) == ["t", "u"]
    with pytest.raises(Exception, match="conflicting records"):
        read("fail").collect()
    put(tmp_path / "b/w.json", {"task_id": "u", "seed": 1, "status": "error"})
    with pytest.raises(Exception, match="conflicting records"):
        read("keep").collect()


def test_annotation_sheets(spark, tmp_path):
    head = "annotator_id,task_id,key,category,status,value_json,criticality,provenance_json,action_sequence_json\n"
    put(tmp_path / "a.csv", head + 'x,t,k,goal,known,"""v""",safety,"[{""trace_id"":""1""}]","[]"\nx,t,l,risk,known,1,context,[],"[]"\n')
    r = files.read_annotations(spark, str(tmp_path / "a.csv")).first()
    assert (r.annotator_id, [c.key for c in r.claims], r.claims[0].provenance[0].trace_id) == ("x", ["k", "l"], "1")
    put(tmp_path / "b.csv", head + 'x,t,k,goal,known,1,safety,[],"[]"\nx,t,l,risk,known,1,context,[],"[1]"\n')
    with pytest.raises(Exception, match="conflicting action sequences"):
        files.read_annotations(spark, str(tmp_path / "b.csv")).collect()


def test_markdown_tables_and_unexpected_keys(spark, tmp_path):
    put(tmp_path / "t.md", "# x\n| a | b |\n|---|:--|\n| `one` two | 3 |\n| only |\n")
    rows = {tuple(r.cells): (r.codes, r.valid) for r in files.read_markdown_tables(spark, str(tmp_path / "t.md"), 2).collect()}
    assert rows == {("a", "b"): ([], True), ("`one` two", "3"): (["one"], True), ("only",): ([], False)}
    put(tmp_path / "k/k.json", {"a": 1, "b": 2})
    assert [r.key for r in files.unexpected_keys(spark, str(tmp_path / "k"), ["a"]).collect()] == ["b"]


def test_inventory_reconciles_and_sinks_refuse(spark, tmp_path):
    put(tmp_path / "in/a.json", "1")
    put(tmp_path / "in/sub/manifest_x.json", "2")
    found = files.file_inventory(spark, str(tmp_path / "in"))
    assert sorted(r.role for r in found.collect()) == ["manifest", "record"]
    listed = found.select("path", "sha256").filter("path like '%a.json'").withColumn("sha256", F.lit("other")).unionAll(spark.createDataFrame([("gone", "x")], "path string, sha256 string"))
    assert sorted(r.verdict for r in files.reconciled_inventory(found, listed).collect()) == ["changed", "missing", "unlisted"]
    df = spark.createDataFrame([(1,)], "a int")
    files.write_union_csv([df, spark.createDataFrame([("x",)], "b string")], str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == ["a", "b"]
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(df, str(tmp_path / "out"))
    assert files.render_table(df) == "| a |\n|---|\n| 1 |" and files.render_table(df, latex=True).startswith("a \\\\")


def test_scalar_functions(spark):
    df = spark.createDataFrame([("  Tool-Evidence ", "cand_it_001", "Straße", "2025-01-01T01:00:00+01:00"), (" - ", "plain", None, "2025-01-01T01:00:00")], "label string, task string, word string, at string")
    rows = df.select(columns.spelled("label").alias("l"), columns.family_of("task").alias("f"), columns.variant_of("task").alias("v"), columns.folded("word").alias("w"), columns.canonical_moment("at").alias("m")).collect()
    assert [tuple(r) for r in rows] == [("tool_evidence", "cand_it", "001", "strasse", "2025-01-01T00:00:00Z"), (None, "plain", "plain", None, None)]


def test_the_confirmatory_plan(spark):
    rows = [(f"t{i}", "m", 1, k, "ok", bool((i + (k == "o")) % 3), [], None) for i in range(12) for k in ("s", "o")]
    runs = spark.createDataFrame(rows, "task_id string, model string, seed int, method string, status string, success boolean, usage array<struct<prompt_tokens:bigint,completion_tokens:bigint>>, metrics struct<strict_success:int,macro_state_f1:double,critical_errors:int,input_tokens:bigint,output_tokens:bigint,validator_cost:double>")
    frames = confirmatory(spark, runs, "s", "o", draws=50)
    assert all(r.passed for r in frames["gates"].collect())
    assert frames["contrasts"].first().n_pairs == 12 and 0 <= frames["tests"].first().p_value <= 1
    assert "## rates" in render({"rates": frames["rates"]})
