import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.operators import agreement, constraints, hashing, matching, overlap

CLAIM = "unit string, claim_no string, category string, key string, status string, value_json string, value_type string, weight double"


def claim(no, key, value, kind="string", weight=1.0, status="known"):
    return ("u", no, "constraint", key, status, value, kind, weight)


@pytest.mark.parametrize("seed", range(8))
def test_assignment_is_maximal(seed):
    rnd = random.Random(seed)
    rows, cols = rnd.randint(1, 5), rnd.randint(1, 5)
    w = [[rnd.choice([0, 0, 1, 2, 3.5]) for _ in range(cols)] for _ in range(rows)]
    total = sum(w[r][c] for r, c in matching.assignment(w))
    small, large, at = (rows, cols, lambda i, j: w[i][j]) if rows <= cols else (cols, rows, lambda i, j: w[j][i])
    assert total == max(sum(at(i, j) for i, j in enumerate(p)) for p in permutations(range(large), small))


@pytest.mark.parametrize("seed", range(12))
def test_assignment_of_counts_weighs_as_much(seed):
    rng = np.random.default_rng(seed)
    w = rng.integers(0, (2, 4, 30)[seed % 3], rng.integers(1, 12, 2)).astype(np.int16)
    pairs = matching.assignment_of_counts(w, 2)
    assert len(set(pairs[:, 0])) == len(set(pairs[:, 1])) == len(pairs) and (w[tuple(pairs.T)] > 0).all()
    assert w[tuple(pairs.T)].sum() == sum(w[r, c] for r, c in matching.assignment(w.astype(float).tolist()))


def test_words_match_a_large_group_without_listing_its_pairs(spark):
    """A group of 1,200 by 1,300 texts, whose best matching is known, among small ones."""
    rows = [("hot", f"l{i}", [f"w{i}", f"w{i + 1}", "the"]) for i in range(1200)] + [("a", "x", ["p", "q"]), ("b", "y", ["p"]), (None, "z", ["p"]), ("a", "n", None)]
    others = [("hot", i, [f"w{i}", f"w{i + 1}", "the", "a"]) for i in range(1300)] + [("a", 1, ["q"]), ("a", 2, ["q", "p"]), ("c", 3, ["p"]), (None, 4, ["p"])]
    lefts, rights = spark.createDataFrame(rows, "g string, left string, words array<string>"), spark.createDataFrame(others, "g string, right long, words array<string>")
    out = matching.word_matches(lefts, rights, "g", "left", "right", "words")
    assert out.dtypes == [("g", "string"), ("left", "string"), ("right", "bigint"), ("weight", "double")]
    got = {tuple(r) for r in out.collect()}
    assert got == {("hot", f"l{i}", i, 3.0) for i in range(1200)} | {("a", "x", 2, 2.0)}


def test_state_scores_of_the_closed_form_cases(spark):
    gold = [claim("1", "destination", '"Boston"', weight=3.0), claim("2", "dates", '["Tue","Wed"]', "set")]
    pred = [claim("1", "destination", '"Boston"'), claim("2", "dates", '["Wed","Thu"]', "set"), claim("3", "invented", '"x"')]
    r = matching.state_scores(spark.createDataFrame(gold, CLAIM), spark.createDataFrame(pred, CLAIM), "unit").first()
    assert (r.recall, r.precision, r.contradiction_rate, r.unsupported_rate) == (3.5 / 4, 1.5 / 3, 0.5, pytest.approx(1 / 3))


@pytest.mark.parametrize(("n_gold", "n_pred", "recall", "precision"), [(1, 0, 0, 0), (1, 2, 1, 0.5), (2, 1, 0.5, 1)])
def test_repeated_claims_match_once(spark, n_gold, n_pred, recall, precision):
    gold = spark.createDataFrame([claim(f"g{i}", "k", '"v"') for i in range(n_gold)], CLAIM)
    pred = spark.createDataFrame([claim(f"p{i}", "k", '"v"') for i in range(n_pred)], CLAIM)
    r = matching.state_scores(gold, pred, "unit").first()
    assert (r.recall, r.precision) == (recall, precision)


def test_one_set_splits_over_two_predictions(spark):
    gold = spark.createDataFrame([claim("g", "d", '["Tue","Wed"]', "set")], CLAIM)
    pred = spark.createDataFrame([claim("a", "d", '["Tue"]', "set"), claim("b", "d", '["Wed"]', "set")], CLAIM)
    r = matching.state_scores(gold, pred, "unit").first()
    assert (r.recall, r.precision) == (0.5, 0.5)


def test_canonical_values(spark):
    rows = [("1.00", "number"), ('["b","a","a"]', "set"), ('" Boston "', "string"), ('"TRUE"', "boolean"), ("true", "boolean"), (None, "string")]
    got = [r.v for r in spark.createDataFrame(rows, "value_json string, value_type string").select(matching.canonical_value("value_json", "value_type").alias("v")).collect()]
    assert got == ["1", '["a","b"]', "Boston", "true", "true", "null"]


def test_multisets_and_their_empty_sides(spark):
    p = spark.createDataFrame([("u", "a"), ("u", "a"), ("u", "b"), ("v", "a")], "unit string, atom string")
    r = spark.createDataFrame([("u", "a"), ("u", "c"), ("w", "z")], "unit string, atom string")
    out = {x.unit: (x.tp, x.precision, x.recall) for x in matching.multiset_scores(p, r, "unit", "atom").collect()}
    assert out == {"u": (1, pytest.approx(1 / 3), 0.5), "v": (0, 0.0, 1.0), "w": (0, 0.0, 0.0)}


def test_differences_agreement_resolution_and_merge(spark):
    schema = "task string, key string, category string, status string"
    a = spark.createDataFrame([("t", "x", "goal", "known"), ("t", "y", "risk", None)], schema)
    b = spark.createDataFrame([("t", "x", "goal", "unknown"), ("t", "z", "goal", "known")], schema)
    d = agreement.differences(a, b, ["task", "key"], ["category", "status"])
    got = {r.key: (r.kind, r.fields) for r in d.collect()}
    assert got == {"x": ("fields", ["status"]), "y": ("missing_from_b", []), "z": ("missing_from_a", [])}
    r = agreement.agreement(d, [], ["category"]).first()
    assert (r.n_a, r.n_b, r.tp, r.f1) == (2, 2, 1, 0.5)
    codes = agreement.resolved(d, [("A", F.col("kind") == "fields")], "B").groupBy("resolution").count().collect()
    assert {x.resolution: x["count"] for x in codes} == {"A": 1, "B": 2}
    merged = {x.key: (x.status, x.patched) for x in agreement.merged(a, b, ["task", "key"], ["category", "status"]).collect()}
    assert merged == {"x": ("unknown", True), "y": (None, False), "z": ("known", True)}


def test_tiers_and_lineage(spark):
    df = spark.createDataFrame([(1, True, True), (2, False, None)], "id int, a boolean, b boolean")
    out = {r.id: (r.score, r.codes, r.tier) for r in agreement.tiers(df, {"a": 4, "b": 2}, [("P0", 6), ("P1", 4)], "P3").collect()}
    assert out == {1: (6, "a,b", "P0"), 2: (0, "", "P3")}
    one, two = spark.createDataFrame([("x",), ("x",), ("y",)], "k string"), spark.createDataFrame([("y",)], "k string")
    assert {r.k: r.origins for r in agreement.composed([("b", one), ("a", two)], "k").collect()} == {"x": "b", "y": "a+b"}


def test_constraints_report_what_breaks_them(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (1, None, ["y"]), (2, "q", None)], "id int, v string, tags array<string>").withColumn("allowed", F.array(F.lit("x")))
    parent = spark.createDataFrame([("a",)], "v string")
    found = constraints.violations(
        constraints.unique(df, "unique", "id"), constraints.not_null(df, "null", "id", "v"), constraints.in_domain(df, "domain", "id", "v", ["a"]),
        constraints.foreign_key(df, "fk", "id", "v", parent, "v"), constraints.subset(df, "subset", "id", F.col("tags"), F.col("allowed")), constraints.holds(df, "check", "id", F.col("id") < 3, F.col("id")),
    )
    rules = ["unique", "null", "domain", "fk", "subset", "check"]
    audited = constraints.audit(found, rules)
    assert {r.rule_id: r.n_violations for r in audited.collect()} == {"unique": 1, "null": 1, "domain": 2, "fk": 1, "subset": 1, "check": 0}
    g = constraints.gate(audited).first()
    assert (g.n_rules, g.n_failed, g.passed) == (6, 5, False)


def test_dataset_hash_ignores_order_and_sees_changes(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    first = hashing.dataset_hash(df, [], "a", "b").first()
    assert hashing.dataset_hash(df.orderBy(F.desc("a")), [], "a", "b").first() == first
    assert hashing.dataset_hash(df.filter("a > 0"), [], "a", "b").first().dataset_hash != first.dataset_hash


def test_canonical_json_sorts_keys_and_nulls_bad_texts(spark):
    df = spark.createDataFrame([(1, '{"b": 1.50, "a": [2, 1]}'), (2, '{"a":[2,1],"b":1.50}'), (3, "{"), (4, None)], "id long, j string")
    out = {r.id: (r.canonical, r.sha256) for r in hashing.with_canonical_json(df, "id", "j").collect()}
    assert out[1] == out[2] and out[1][0] == '{"a":[2,1],"b":1.5}' and out[3] == (None, None) and out[4] == (None, None)


def test_overlap_signals(spark):
    docs = spark.createDataFrame([(1, "On 2025-01-02 ref-7  paid"), (2, "on 2024-12-31 REF-99 paid"), (3, None), (4, "other")], "doc_id long, text string")
    assert [(r.n, r.first_key) for r in overlap.duplicate_groups(docs, "doc_id", "text").collect()] == [(2, 1)]
    a = spark.createDataFrame([(1, None), (2, "k")], "id int, s string")
    b = spark.createDataFrame([(7, None), (8, None)], "jd int, s string")
    assert [(r.id, r.n_matches, r.first_match) for r in overlap.collisions(a, b, "id", "jd", "s").collect()] == [(1, 2, 7)]
    x, y = spark.createDataFrame([(1, "a b c d"), (2, "solo"), (3, "")], "i int, text string"), spark.createDataFrame([(9, "b c d e"), (8, "solo")], "j int, text string")
    assert {(r.i, r.j): r.jaccard for r in overlap.jaccard(x, y, "i", "j", "text").collect()} == {(1, 9): 0.5, (2, 8): 1.0}
