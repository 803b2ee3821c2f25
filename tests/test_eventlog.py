from pyspark.sql import functions as F

from assaylake.operators import eventlog
from assaylake.queries import QUERIES
from assaylake.streaming import events as streams

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def make(spark, rows):
    base = [(i, u, k, p) for i, (u, k, p) in enumerate(rows)]
    df = spark.createDataFrame(base, "event_id long, user_id long, event_type string, props string")
    return df.withColumn("ts", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(event_id as int),0)"))


def test_duplicates_need_an_earlier_eligible_event(spark):
    df = make(spark, [(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (2, "a", "x"), (1, "e", "x"), (1, "e", "x"), (1, None, None), (1, None, None)])
    out = {r.event_id: r.is_duplicate for r in eventlog.running_duplicates(df.withColumn("ok", F.col("event_type") != "e"), ["user_id", "event_type", "props"], ["ts", "event_id"], "ok").collect()}
    assert out == {0: False, 1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_subsequences_are_matched_greedily(spark):
    df = make(spark, [(1, "s", ""), (1, "v", ""), (1, "p", ""), (2, "p", ""), (2, "s", ""), (2, "p", ""), (3, "v", "")])
    out = {r.user_id: (r.n_matched, r.complete) for r in eventlog.in_order(df, "user_id", "event_type", ["ts", "event_id"], ["s", "v", "p"]).collect()}
    assert out == {1: (3, True), 2: (1, False), 3: (0, False)}


def test_breaches_budget_fold_first_and_mode(spark):
    df = make(spark, [(1, "p", "1"), (1, "s", "2"), (1, "p", "3"), (2, "p", "4"), (1, "p", "5")])
    order = ["ts", "event_id"]
    assert sorted(r.event_id for r in eventlog.precondition_breaches(df, "user_id", "event_type", order, "p", "s").collect()) == [0, 3]
    assert [(r.event_id, r.call_no) for r in eventlog.over_budget(df, ["user_id", "event_type"], order, 2).collect()] == [(4, 3)]
    assert {(r.user_id, r.event_type): (r.value, r.n_updates) for r in eventlog.folded_state(df, "user_id", "event_type", "props", order).collect()} == {(1, "p"): ("5", 3), (1, "s"): ("2", 1), (2, "p"): ("4", 1)}
    assert {r.user_id: r.event_id for r in eventlog.first_by(df, ["user_id"], order, "event_id").collect()} == {1: 0, 2: 3}
    ties = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (1, None), (1, None)], "k int, v string")
    assert [(r.v, r.n) for r in eventlog.mode_lowest(ties, ["k"], "v").collect()] == [("a", 1)]


def test_sessions_break_at_gaps(spark):
    df = make(spark, [(1, "a", "")] * 3 + [(2, "b", "")] * 200 + [(1, "a", "")])
    out = sorted((r.user_id, r.session_no, r.n_events, r.seconds) for r in eventlog.sessions(df, "user_id", "ts", ["ts", "event_id"], 3600).collect())
    assert out == [(1, 0, 3, 120.0), (1, 1, 1, 0.0), (2, 0, 200, 199 * 60.0)]


def test_empty_logs(spark):
    none = spark.createDataFrame([], SCHEMA)
    order = ["ts", "event_id"]
    assert eventlog.running_duplicates(none, ["user_id"], order).count() == 0
    assert eventlog.in_order(none, "user_id", "event_type", order, ["a"]).count() == 0
    assert streams.windowed_rates(none).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    df = make(spark, [(i % 3, "ab"[i % 2], str(i % 4)) for i in range(60)]).withColumn("value", F.lit(1.0)).select("event_id", "ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_duplicates(streams.read_events(spark, str(tmp_path / "in"), df.schema, "*.parquet"))
    query = stream.writeStream.format("memory").queryName("dups").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(120)
    got = {(r.user_id, r.event_id): r.is_duplicate for r in spark.table("dups").collect()}
    want = {(r.user_id, r.event_id): r.is_duplicate for r in eventlog.running_duplicates(df, ["user_id", "event_type", "props"], ["ts", "event_id"]).collect()}
    assert got == want


def test_stream_keeps_every_signature_of_a_hot_user(spark, tmp_path):
    n = 10_050
    df = make(spark, [(1, "a", str(i % n)) for i in range(n + 20)]).select("event_id", "ts", "user_id", "event_type", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.stream_duplicates(streams.read_events(spark, str(tmp_path / "in"), df.schema, "*.parquet"))
    query = stream.writeStream.format("memory").queryName("hot_dups").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert query.awaitTermination(300)
    ids = [r.event_id for r in df.orderBy("ts", "event_id").select("event_id").collect()]
    assert sorted(r.event_id for r in spark.table("hot_dups").filter("is_duplicate").collect()) == sorted(ids[n:])
    assert spark.table("hot_dups").count() == n + 20


def test_stream_fold_takes_many_keys_from_a_folder_without_python_or_the_driver(spark, tmp_path, monkeypatch):
    n = 300_000
    df = spark.range(n + 50).selectExpr("id event_id", "timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,cast(id as int),0) ts", "id % 7 user_id", "'a' event_type", "if(id % 7 = 3, null, cast(id % {n} as string)) props".format(n=n))
    df.repartition(3).write.parquet(str(tmp_path / "events.parquet"))  # a folder of files
    monkeypatch.setattr(streams, "stream_duplicates", None)
    got = QUERIES["stream_fold"](spark, str(tmp_path))
    want = eventlog.running_duplicates(df, ["user_id", "event_type", "props"], ["ts", "event_id"]).select("user_id", "event_id", "is_duplicate")
    assert got.count() == n + 50 and got.exceptAll(want).count() == 0


def test_duplicates_are_known_from_earlier_batches(spark, tmp_path):
    df = make(spark, [(i % 3, "ab"[i % 2], None if i % 5 == 0 else str(i % 4)) for i in range(60)]).select("event_id", "ts", "user_id", "event_type", "props")
    want = {(r.user_id, r.event_id): r.is_duplicate for r in eventlog.running_duplicates(df, ["user_id", "event_type", "props"], ["ts", "event_id"]).collect()}
    for k in range(3):
        df.filter(F.col("event_id").between(20 * k, 20 * k + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
        streams.write_duplicates(streams.read_events(spark, str(tmp_path), df.schema), str(tmp_path / "out")).awaitTermination()
    assert {(r.user_id, r.event_id): r.is_duplicate for r in streams.read_duplicates(spark, str(tmp_path / "out")).collect()} == want


def test_stream_of_nothing(spark, tmp_path):
    assert streams.read_duplicates(spark, str(tmp_path)).columns == ["user_id", "event_id", "is_duplicate"]
