"""Event streams: windowed rates with a watermark, and duplicates with state per key or with keys in a folder.

The same functions serve batch frames; files, sockets or queues are read by the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assaylake.operators.eventlog import running_duplicates

KEYS = ["user_id", "event_type", "props"]


def read_events(spark: SparkSession, folder: str, schema, name: str = "events.parquet") -> DataFrame:
    """A stream of the parquet files of that name (or pattern) in a folder, or of those in a folder of that name, with ts as a timestamp."""
    pattern = name if set(name) & set("*?[{") else f"{name[:-1]}[{name[-1]}]"  # as a pattern, since a stream takes no single file
    stream = spark.readStream.schema(schema).parquet(f"{folder}/{pattern}")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_rates(events: DataFrame, window: str = "1 hour", late: str = "1 hour", flagged: str = "error") -> DataFrame:
    """window_start, n, n_flagged, rate by tumbling window; later events than the watermark are dropped by the stream."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy(F.window(F.col("ts").cast("timestamp"), window).alias("w")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == flagged).cast("long")).alias("n_flagged"))
    return out.select(F.col("w.start").alias("window_start"), "n", "n_flagged", (F.col("n_flagged") / F.col("n")).alias("rate"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, n by session window."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    out = source.groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def stream_duplicates(events: DataFrame) -> DataFrame:
    """user_id, event_id, is_duplicate: whether the user had an event of the same type and props before.

    State is one flag per user, type and props, so it is exact for any number of them; of a key's rows one is in memory at a time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = lambda pdf, flag: pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "is_duplicate": flag})
        first = None
        for pdf in batches:
            if not state.exists:
                pdf = (pdf if first is None else pd.concat([first, pdf])).sort_values(["ts", "event_id"])
                first, pdf = pdf.iloc[:1], pdf.iloc[1:]
            if len(pdf):
                yield out(pdf, True)
        if first is not None:
            yield out(first, False)
            state.update((True,))

    return events.groupBy("user_id", "event_type", "props").applyInPandasWithState(
        step, "user_id long, event_id long, is_duplicate boolean", "seen boolean", "append", GroupStateTimeout.NoTimeout
    )


def write_duplicates(events: DataFrame, folder: str) -> StreamingQuery:
    """Start a stream that writes the flags of stream_duplicates for all input that is there; read_duplicates reads them.

    Each batch is flagged by joins with the first event of every key in it and with the keys of the batches before, which are
    those of the events that were no duplicates. Nothing passes through Python or the driver, no key costs a call or stays in
    memory, and a batch that runs again overwrites what it wrote.
    """

    def fold(batch: DataFrame, number: int) -> None:
        flagged = running_duplicates(batch, KEYS, ["ts", "event_id"]).select(*KEYS, "event_id", "is_duplicate")
        if number:
            before = batch.sparkSession.read.schema(flagged.schema).parquet(*[f"{folder}/flags/{n}" for n in range(number)])
            known = before.filter(~F.col("is_duplicate")).select(*[F.col(k).alias(f"key_{k}") for k in KEYS], F.lit(True).alias("known"))
            same = [F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in KEYS]
            flagged = flagged.join(known, same, "left").select(*KEYS, "event_id", (F.col("is_duplicate") | F.coalesce("known", F.lit(False))).alias("is_duplicate"))
        flagged.write.mode("overwrite").parquet(f"{folder}/flags/{number}")

    return events.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def read_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """user_id, event_id, is_duplicate as written by write_duplicates; no rows if there was no input."""
    schema = "user_id long, event_id long, is_duplicate boolean"
    try:
        return spark.read.schema(schema).parquet(f"{folder}/flags/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
