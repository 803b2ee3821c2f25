from pyspark.sql import functions as F

from assaylake.queries import QUERIES
from assaylake.queries.corpora import FIRST, SECOND


def test_all_pairs_of_annotators_hold_the_two_and_more(spark, tmp_path):
    claim = "struct<key:string,category:string,status:string,value_json:string,criticality:string>"
    rows = [
        (1, FIRST, "t1", [("k", "x", "s", "1", "c")]), (2, SECOND, "t1", [("k", "y", "s", "1", "c"), ("m", "x", "s", "1", "c")]),
        (3, "ann_07", "t1", [("k", "x", "s", "1", "c")]), (4, "ann_09", "t2", [("k", "x", "s", "1", "c")]), (5, "ann_07", "t2", [("k", "x", "r", "1", "c")]),
    ]
    df = spark.createDataFrame(rows, f"annotation_id long, annotator_id string, task_id string, claims array<{claim}>")
    df.withColumn("submitted_at", F.lit("2025-01-01")).withColumn("received_at", F.lit("2025-01-01")).write.parquet(str(tmp_path / "annotations.parquet"))
    run = lambda name: QUERIES[name](spark, str(tmp_path))
    got = {tuple(r) for r in run("disagreement_queue_pairs").collect()}
    assert {g[2:] for g in got if g[:2] == (FIRST, SECOND)} == {tuple(r) for r in run("disagreement_queue").collect()}
    assert {g for g in got if g[:2] != (FIRST, SECOND)} == {
        ("ann_07", SECOND, "t1", "k", "fields", "category"), ("ann_07", SECOND, "t1", "m", "missing_from_a", ""), ("ann_07", "ann_09", "t2", "k", "fields", "status"),
    }
    assert {(r.annotator_a, r.annotator_b): r.tp for r in run("agreement_prf_pairs").collect()} == {(FIRST, SECOND): 0, (FIRST, "ann_07"): 1, ("ann_07", SECOND): 0, ("ann_07", "ann_09"): 0}
    assert sum(r.n for r in run("queue_resolution_pairs").collect()) == len(got)
    assert run("merged_claims_pairs").count() == 6
