"""Conditions of the form key=expected over state atoms, references into nested records, and searches inside documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Right sides that test an atom's status; all others test its value.
STATUS_WORDS = ("known", "unknown", "contradicted", "not_applicable")


def parsed_condition(condition: Column) -> tuple[Column, Column, Column]:
    """(negated, key, expected) of `key=expected` or `!key=expected`; a condition without = expects nothing (null)."""
    negated = F.startswith(condition, F.lit("!"))
    bare = F.when(negated, F.substring(condition, 2, 1_000_000)).otherwise(condition)
    parts = F.split(bare, "=", 2)
    return negated, F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


def spoken(value_json: Column) -> Column:
    """A JSON scalar as the text a condition compares with: True, False and None are capitalised, strings have no quotes."""
    text = F.get_json_object(F.concat(F.lit('{"v":'), value_json, F.lit("}")), "$.v")
    return F.when(value_json == "true", "True").when(value_json == "false", "False").when(F.coalesce(value_json, F.lit("null")) == "null", "None").otherwise(text)


def evaluated(conditions: DataFrame, atoms: DataFrame, unit: list[str], condition: str) -> DataFrame:
    """conditions with verdict: satisfied, contradicted, or missing where the unit has no atom of the key.

    atoms: unit, key, status, value_json, one per key.
    """
    negated, key, expected = parsed_condition(F.col(condition))
    cut = conditions.withColumn("negated", negated).withColumn("key", key).withColumn("expected", expected)
    both = cut.join(atoms.select(*unit, "key", "status", spoken(F.col("value_json")).alias("spoken"), F.lit(True).alias("there")), [*unit, "key"], "left")
    by_status = F.coalesce(F.col("expected").isin(*STATUS_WORDS), F.lit(False))
    holds = F.when(by_status, F.col("status").eqNullSafe(F.col("expected"))).otherwise(F.col("spoken").eqNullSafe(F.col("expected")))
    verdict = F.when(F.col("there").isNull(), "missing").when(holds != F.col("negated"), "satisfied").otherwise("contradicted")
    return both.withColumn("verdict", verdict).drop("negated", "expected", "status", "spoken", "there")


def dangling(references: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """References without a target: an anti-join; null keys never have one."""
    return references.join(targets.select(*keys).distinct(), keys, "left_anti")


def containing(nodes: DataFrame, keys: list[str], value: str, labels: bool = False) -> DataFrame:
    """keys of shredded documents that hold the value as a scalar, or with labels also as a key, and how often."""
    hit = F.col("scalar") == value
    if labels:
        hit = hit | (F.col("label") == value)
    return nodes.filter(F.coalesce(hit, F.lit(False))).groupBy(*keys).agg(F.count("*").alias("n_hits"))


def at_path(document: Column, *path: str) -> tuple[Column, Column]:
    """(exists, value as JSON text) of a nested key, told apart from a value of null."""
    variant = F.try_parse_json(document)
    step = "$" + "".join(f"['{p}']" for p in path[:-1])
    parent = F.try_variant_get(variant, step, "string") if len(path) > 1 else F.to_json(variant)
    exists = F.coalesce(F.array_contains(F.json_object_keys(parent), path[-1]), F.lit(False))
    return exists, F.when(exists, F.coalesce(F.try_variant_get(variant, step + f"['{path[-1]}']", "string"), F.lit("null")))
