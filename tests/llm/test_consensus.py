import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from assaylake.llm.consensus import Consensus, chance_corrected, claim_labels

CATEGORIES = ["goal", "risk", "consent", "constraint", "commitment"]
STATUSES = ["known", "unknown", "contradicted"]
CLAIM = "array<struct<key:string,category:string,status:string>>"
SCHEMA = f"annotation_id long, annotator_id string, task_id string, claims {CLAIM}, submitted_at timestamp, received_at timestamp, category string, who int"


def simulated(seed=3, tasks=150):
    """Labels of good, noisy, constant, random, confusing and copying annotators, and the truth."""
    rnd = random.Random(seed)
    skill = {"a1": 0.9, "a2": 0.85, "a3": 0.8, "a4": 0.7, "a5": 0.6, "copy": None, "const": 0, "rand": 0, "mix": 0.9}
    truth, rows = {}, []
    for t in range(tasks):
        keys = [f"k{i}" for i in range(2)]
        for k in keys:
            truth[f"t{t}", k] = (rnd.choice(CATEGORIES), rnd.choice(STATUSES))
        said = {}
        for a in rnd.sample(sorted(skill), 6):
            claims = []
            for k in keys:
                c, s = truth[f"t{t}", k]
                if a == "const":
                    c, s = "goal", "known"
                elif a == "mix" and c == "risk":
                    c = "consent"
                elif a == "rand" or rnd.random() > (skill[a] or 0.6):
                    c, s = rnd.choice(CATEGORIES), rnd.choice(STATUSES)
                claims.append((k, c, s))
            said[a] = claims
        if "copy" in said and "a5" in said:
            said["copy"] = said["a5"]
        rows += [(a, f"t{t}", claims) for a, claims in said.items()]
    return truth, rows


def annotations(spark, rows):
    data = [(i, a, t, c, "clash", 0) for i, (a, t, c) in enumerate(rows)]
    df = spark.createDataFrame(data, f"annotation_id long, annotator_id string, task_id string, claims {CLAIM}, category string, who int")
    return df.withColumn("submitted_at", F.timestamp_seconds(F.col("annotation_id"))).withColumn("received_at", F.col("submitted_at"))


@pytest.fixture(scope="module")
def learned(spark):
    truth, rows = simulated()
    return truth, rows, Consensus(claim_labels(annotations(spark, rows)))


def test_consensus_beats_the_majority_and_is_accurate(learned):
    truth, rows, model = learned
    got = {(r.task_id, r.claim_key): (r.category, r.status) for r in model.labels().collect()}
    votes = {}
    for _, t, claims in rows:
        for k, c, s in claims:
            votes.setdefault((t, k), []).append((c, s))
    assert set(got) == set(truth)
    majority = {i: tuple(Counter(x).most_common(1)[0][0] for x in zip(*v, strict=True)) for i, v in votes.items()}
    right = lambda labels, f: sum(labels[i][f] == truth[i][f] for i in truth) / len(truth)
    assert right(got, 0) > right(majority, 0) and right(got, 0) > 0.93 and right(got, 1) > 0.9


def test_reliability_ranks_annotators_and_finds_copies(learned):
    _, _, model = learned
    out = {(r.annotator, r.field): r for r in model.reliability().collect()}
    assert out["a1", "category"].accuracy > out["a4", "category"].accuracy > out["rand", "category"].accuracy
    assert out["a1", "status"].ability > out["a5", "status"].ability
    assert out["copy", "category"].copies_of == out["a5", "category"].copies_of == "a5" and out["a1", "category"].copies_of == "a1"


def test_only_latest_full_labels_count(spark):
    rows = [
        (" Ann-1 ", "t", [("k", "Risk", "known")]), ("ann_1", "t", [("k", "GOAL ", "Not Applicable"), ("k", "risk", "known"), ("l", None, "known"), (None, "goal", "known")]),
        ("ann_2", "t", None), (None, "t", [("k", "goal", "known")]), ("ann_3", None, [("k", "goal", "known")]), ("ann_4", "t", []),
    ]
    assert [tuple(r) for r in claim_labels(annotations(spark, rows)).collect()] == [("t", "k", "ann_1", "goal", "not_applicable")]


def test_three_annotators_are_needed_and_empty_tables_work(spark):
    rows = [(f"a{i}", "t", [("k", "goal", "known"), *([("l", "risk", "known")] if i < 2 else [])]) for i in range(3)]
    out = Consensus(claim_labels(annotations(spark, rows)), passes=3).labels().collect()
    assert [(r.claim_key, r.category, r.status, r.n_labels, r.agreement) for r in out] == [("k", "goal", "known", 3, 1.0)]
    none = Consensus(claim_labels(annotations(spark, rows).limit(0)))
    assert none.labels().count() == 0 and none.reliability().count() == 0
    assert chance_corrected(claim_labels(annotations(spark, rows).limit(0))).count() == 0


def test_kappa_is_corrected_for_chance(spark):
    rows = [(f"a{i}", f"t{t}", [("k", ["goal", "risk"][t % 2], "known")]) for t in range(4) for i in range(3)]
    out = {r.field: r for r in chance_corrected(claim_labels(annotations(spark, rows))).collect()}
    assert out["category"].kappa == 1 and out["status"].kappa is None and out["status"].observed == 1
