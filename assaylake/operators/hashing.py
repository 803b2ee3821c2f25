"""Canonical texts and hashes of rows, documents and whole datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import deepjson
from assaylake.functions.arrow import map_rows


def row_text(*columns: str) -> Column:
    """The columns as text, joined by bars; null as \\N."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in columns])


def row_hash(*columns: str) -> Column:
    return F.sha2(row_text(*columns), 256)


def dataset_hash(df: DataFrame, by: list[str], *columns: str, digits: int = 2) -> DataFrame:
    """by, n_rows, dataset_hash: independent of the rows' order.

    Row hashes are sorted inside buckets of their first `digits` hex digits and hashed per bucket, then the buckets' hashes in
    order; raise digits with the data, so that a bucket stays small (digits are part of the definition).
    """
    hashed = df.select(*by, row_hash(*columns).alias("h")).withColumn("bucket", F.substring("h", 1, digits))
    buckets = hashed.groupBy(*by, "bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "h")))
    return buckets.groupBy(*by).agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(ordered, lambda x: x["h"]), ""), 256).alias("dataset_hash"))


def canonical_json(text: str | None) -> str | None:
    """JSON with sorted keys and no spaces, of any depth; null for invalid JSON."""
    try:
        return None if text is None else deepjson.canonical(deepjson.loads(text))
    except ValueError:
        return None


def with_canonical_json(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, canonical, sha256 of a JSON column; equal for documents that differ in spaces and key order only."""

    def make():
        def row(id_, text):
            yield id_, canonical_json(text)

        return row

    kind = dict(df.select(key).dtypes)[key]
    return map_rows(df, [key, document], make, f"{key} {kind}, canonical string").withColumn("sha256", F.sha2("canonical", 256))
