import pytest
from pyspark.sql import functions as F

from assaylake.operators import constraints, scoring

CLAIM = "unit string, category string, key string, status string, value_json string"


def test_field_scores_match_by_field_and_key(spark):
    gold = spark.createDataFrame([("u", "goal", "a", "known", "1", True), ("u", "goal", "b", "known", '["x","y"]', False), ("u", "risk", "c", "unknown", None, True), ("v", "goal", "a", "known", "1", None)], CLAIM + ", critical boolean")
    made = spark.createDataFrame([("u", "goal", "a", "known", " 1"), ("u", "goal", "b", "known", '["x"]'), ("u", "goal", "z", "known", "1"), ("u", "note", "n", "known", "1")], CLAIM)
    fields = scoring.field_scores(gold, made, ["unit"], "category")
    got = {(r.unit, r.category): (r.tp, r.n_predicted, r.n_gold, round(r.precision, 4), round(r.recall, 4), r.critical_errors) for r in fields.collect()}
    assert got == {("u", "goal"): (1.5, 3, 2, 0.6667, 0.75, 0), ("u", "risk"): (0.0, 0, 1, 0.0, 0.0, 1), ("u", "note"): (0.0, 1, 0, 0.0, 1.0, 0), ("v", "goal"): (0.0, 0, 1, 0.0, 0.0, 0)}
    macro = {r.unit: (r.n_fields, round(r.macro_f1, 4), r.critical_errors) for r in scoring.macro_scores(fields, ["unit"]).collect()}
    assert macro == {"u": (2, round((2 * 0.75 * 2 / 3 / (0.75 + 2 / 3)) / 2, 4), 1), "v": (1, 0.0, 0)}
    assert scoring.field_scores(gold.limit(0), made.limit(0), ["unit"], "category").count() == 0


def test_several_claims_of_a_key_are_assigned_one_to_one(spark):
    gold = spark.createDataFrame([("u", "goal", "a", "known", '["x","y"]', True), ("u", "goal", "a", "known", '["x"]', False)], CLAIM + ", critical boolean")
    made = spark.createDataFrame([("u", "goal", "a", "known", '["x"]'), ("u", "goal", "a", "known", '["y","x"]')], CLAIM)
    r = scoring.field_scores(gold, made, ["unit"], "category").first()
    assert (r.tp, r.precision, r.recall, r.critical_errors) == (2.0, 1.0, 1.0, 0)


def test_full_agreement_counts_all_pairs(spark):
    kind = "array<struct<key:string,category:string,status:string,value_json:string,criticality:string,provenance:array<struct<trace_id:string,source_type:string,field_path:string>>>>"
    p = [("1", "tool", "x")]
    rows = [
        ("a", "t", [("k", "goal", "known", "1", "safety", p), ("l", "risk", "known", "1", None, p)], "go", True, False), ("b", "t", [("k", "goal", "known", "1", "context", p), ("l", "risk", "unknown", "1", None, [])], "go", True, None),
        ("c", "t", None, None, None, None), ("a", "s", [], "", True, True),
    ]
    got = {(r.annotator_a, r.annotator_b): r for r in scoring.full_agreement(spark.createDataFrame(rows, f"annotator string, task_id string, claims {kind}, actions string, inferable boolean, leakage boolean")).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    r = got["a", "b"]
    assert (r.n_tasks, r.n_a, r.n_b, r.n_matched, r.exact, r.pointer_tp, r.pointer_a, r.pointer_b, r.equal_pointer_sets) == (1, 2, 2, 2, 1, 1, 2, 1, 1)
    assert (r.claim_f1, r.category_rate, r.status_rate, r.criticality_rate, r.action_rate, r.leakage_rate) == (0.5, 1.0, 0.5, 0.5, 1.0, 0.0)
    assert got["a", "c"].n_matched == 0 and got["a", "c"].claim_f1 == 0.0


def test_row_rules_and_overlap_signals(spark):
    df = spark.createDataFrame([(1, 5, "x"), (2, None, "y"), (3, -1, None)], "id int, n int, s string")
    found = constraints.row_rules(df, "id", {"positive": (F.col("n") > 0, F.col("n")), "named": (F.col("s").isNotNull(), F.col("s"))})
    assert {(r.rule_id, r.key) for r in found.collect()} == {("positive", "2"), ("positive", "3"), ("named", "3")}
    rows = spark.createDataFrame([("train", 1, "f"), ("train", 1, None), ("dev", 1, "f"), ("dev", None, "f"), ("test", 2, None), (None, 1, "f")], "side string, seed int, family string")
    got = {(r.side, r.signal): (r.n_records, r.n_overlapping, r.n_pairs) for r in scoring.signal_overlaps(rows, "side", {"seed": F.col("seed"), "family": F.col("family")}).collect()}
    assert got == {("dev", "seed"): (2, 1, 2), ("dev", "family"): (2, 2, 2), ("test", "seed"): (1, 0, 0), ("test", "family"): (1, 0, 0)}


@pytest.mark.parametrize(("message", "want"), [("no JSON here", "other"), ("bad start", "first"), (None, "other")])
def test_the_first_rule_that_holds(spark, message, want):
    df = spark.createDataFrame([(message,)], "m string")
    assert df.select(scoring.first_rule("other", [(F.startswith("m", F.lit("bad")), "first"), (F.col("m") == "bad start", "second")]).alias("r")).first().r == want
