"""Queries of the training-data problems over the tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.answers import read_answers


def p1_found(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.truncation import truncated

    return truncated(read_answers(spark, path)).select("tab", "row_id", "turn_no")


def p1_share_by_source(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.truncation import truncation_by_source

    return truncation_by_source(read_answers(spark, path))


def p1_length_spikes(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.truncation import length_histogram, length_spikes

    return length_spikes(length_histogram(read_answers(spark, path)))


def _pair_sets(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.traces import pair_sets

    tasks = spark.read.parquet(f"{path}/task_records.parquet").select(F.lit("task_records").alias("tab"), F.col("record_id").cast("long").alias("id"), F.col("trace.content").alias("text"))
    packets = spark.read.parquet(f"{path}/packets.parquet").select(F.lit("packets").alias("tab"), F.col("packet_id").cast("long").alias("id"), F.col("workflow_observation").alias("text"))
    return pair_sets(tasks, True).unionAll(pair_sets(packets, False))


def p2_found(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.near_pairs import near_copies

    return near_copies(_pair_sets(spark, path))


def p2_classes(spark: SparkSession, path: str) -> DataFrame:
    """One row per text: its class of equal texts and the number of other classes that class is linked to."""
    from assaylake.llm.near_pairs import class_pairs
    from assaylake.session import materialize

    pairs, members = class_pairs(materialize(_pair_sets(spark, path), "pair-sets"))
    ends = pairs.select("tab", F.explode(F.array("id_a", "id_b")).alias("rep")).groupBy("tab", "rep").agg(F.count("*").alias("n_links"))
    return members.join(ends, ["tab", "rep"], "left").select("tab", "id", F.col("rep").alias("class_id"), F.col("size").alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def p3_found(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.splits import split_overlaps

    found = split_overlaps(spark.read.parquet(f"{path}/task_records.parquet"))
    return found.select(F.least("train_id", "other_id").alias("id_a"), F.greatest("train_id", "other_id").alias("id_b"))


def p3_counts(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.splits import overlap_counts

    return overlap_counts(spark.read.parquet(f"{path}/task_records.parquet"))


def _claim_labels(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.consensus import claim_labels

    return claim_labels(spark.read.parquet(f"{path}/annotations.parquet"))


def p5_found(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.consensus import Consensus

    return Consensus(_claim_labels(spark, path)).labels().select("task_id", "claim_key", "category", "status")


def p5_claims(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.consensus import Consensus

    return Consensus(_claim_labels(spark, path)).labels()


def p5_reliability(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.consensus import Consensus

    return Consensus(_claim_labels(spark, path)).reliability()


def p5_agreement(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.consensus import chance_corrected

    return chance_corrected(_claim_labels(spark, path))


def p6_found(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.pairs import defective

    prompts = spark.read.parquet(f"{path}/prompts.parquet")
    return defective(read_answers(spark, path), prompts).select("tab", "row_id", "turn_no", "defect")


def p7_ids(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.byte_pairs import encoded

    return encoded(spark.read.parquet(f"{path}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", "text")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long"))


def p8_leaks(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.leaks import leaks

    return leaks(_documents(spark, path), spark.read.parquet(f"{path}/eval_items.parquet"))


def p8_found(spark: SparkSession, path: str) -> DataFrame:
    return p8_leaks(spark, path).select("doc_id", "item_id")


def p8_items(spark: SparkSession, path: str) -> DataFrame:
    """Each leaked item: how many documents hold it and how much of it at most."""
    return p8_leaks(spark, path).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.max("share").alias("largest_share"))


def p9_cases(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.language_filters import document_languages, learned, mislabelled, sampled

    documents = _documents(spark, path)
    return mislabelled(document_languages(documents, learned(sampled(documents))))


def p9_found(spark: SparkSession, path: str) -> DataFrame:
    return p9_cases(spark, path).select("doc_id", "lang")


def p9_segments(spark: SparkSession, path: str) -> DataFrame:
    from assaylake.llm.language_filters import language_segments, learned, sampled

    documents = _documents(spark, path)
    return language_segments(documents, learned(sampled(documents)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_share_by_source, p1_length_spikes, p2_found, p2_classes, p3_found, p3_counts, p5_found, p5_claims, p5_reliability, p5_agreement, p6_found, p7_ids, p8_found, p8_leaks, p8_items, p9_found, p9_cases, p9_segments)}

# The patterns of marks behind a cut and of complete endings, as SQL text.
MARKED = r"""'(?i)\s?(<cut>|<truncated>|\[\.\.\.\.?\]|\[…\]|\[truncated\]|\(truncated\)|\(cut\)|…|\.\.\.|\x{FFFD})\s*$'"""
ENDED = r"""'[.!?。！？}\]`]["''”’»)\]}*_」』）`]*\s*$'"""

#: Oracles for the queries that plain SQL can express.
ORACLES: dict[str, str] = {
    "p1_length_spikes": f"""
        WITH a AS (
            SELECT 'run_artifacts' AS tab, source, raw_output AS text FROM run_artifacts
            UNION ALL SELECT 'pilot_runs', source, unnest(receiver_raw_outputs) FROM pilot_runs),
        m AS (SELECT *, regexp_matches(right(text, 16), {MARKED}) AS marked FROM a WHERE text IS NOT NULL),
        c AS (SELECT *, CASE WHEN marked THEN regexp_replace(text, {MARKED}, '') ELSE text END AS core, marked OR NOT regexp_matches(right(text, 16), {ENDED}) AS bare FROM m),
        d AS (SELECT DISTINCT tab, source, text, length(core) AS chars, strlen(core) AS bytes, bare FROM c),
        h AS (
            SELECT tab, source, unit, length, count(*) AS n, count(*) FILTER (bare) AS n_bare FROM (
                SELECT tab, source, 'chars' AS unit, chars AS length, bare FROM d UNION ALL SELECT tab, source, 'bytes', bytes, bare FROM d)
            GROUP BY ALL),
        u AS (
            SELECT *, cast(sum(n_bare) OVER (PARTITION BY tab, source, unit ORDER BY length RANGE BETWEEN 25 PRECEDING AND 25 FOLLOWING) - n_bare AS double) / 50.0::DOUBLE AS usual
            FROM h),
        f AS (SELECT *, greatest(usual, 0.02::DOUBLE) AS m FROM u)
        SELECT tab, source, unit, length, n, n_bare, usual FROM f WHERE n_bare > m AND n_bare * ln(greatest(n_bare, 1) / m) - n_bare + m >= 9.5::DOUBLE
    """,
}
