"""Readers of record files, annotation sheets, text tables and file inventories; writers that refuse to overwrite."""

from __future__ import annotations

import re
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CLAIM = "struct<key:string,category:string,status:string,value_json:string,criticality:string,provenance:array<struct<trace_id:string,source_type:string,field_path:string>>>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON files that hold one object or a list of objects each, with their path; malformed files fail."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))


def unexpected_keys(spark: SparkSession, path: str, allowed: list[str]) -> DataFrame:
    """path, key: top-level keys of one-object files outside `allowed`, which a reader with a schema would drop in silence."""
    texts = spark.read.option("wholetext", True).text(path).withColumn("path", F.col("_metadata.file_path"))
    keys = texts.select("path", F.explode(F.json_object_keys("value")).alias("key"))
    return keys.filter(~F.col("key").isin(*allowed))


def read_run_tree(spark: SparkSession, folders: list[str], schema: StructType | str, keys: list[str], conflicts: str = "keep") -> DataFrame:
    """Run records below folders, at any depth. A folder whose path has a part `dev`, or `invalid_protocol` in a part, is refused.

    The case of such a part doesn't matter; the refusal is a ValueError before anything is read, so no file drops out in silence.
    conflicts 'keep': identical repeats collapse, records that differ under one key fail. 'fail': any repeat of a key fails.
    The failure comes when the frame is evaluated, with the key in its message.
    """
    for folder in folders:
        whole = folder if re.match(r"\w+:/", folder) else str(Path(folder).resolve())
        if any(part == "dev" or "invalid_protocol" in part for part in whole.lower().split("/")):
            raise ValueError(f"not a folder of valid runs: {whole}")
    runs = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(folders)
    runs = runs.withColumn("path", F.col("_metadata.file_path"))
    columns = [c for c in runs.columns if c != "path"]
    grouped = runs.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in columns if c not in keys], "path"), "path").alias("r"), F.count("*").alias("n"), F.count_distinct(F.to_json(F.struct(*columns))).alias("kinds"))
    bad = F.col("kinds") > 1 if conflicts == "keep" else F.col("n") > 1
    message = F.concat(F.lit("conflicting records: "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    checked = grouped.withColumn("r", F.when(bad, F.raise_error(message)).otherwise(F.col("r")))
    return checked.select(*keys, "r.*")


def read_annotation_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row per annotator and task from a sheet with one claim a row: annotator_id, task_id, claims, action_sequence_json.

    A task with two different action sequences fails on evaluation.
    """
    sheet = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    claim = F.struct("key", "category", "status", "value_json", "criticality", F.from_json("provenance_json", "array<struct<trace_id:string,source_type:string,field_path:string>>").alias("provenance"))
    grouped = sheet.groupBy("annotator_id", "task_id").agg(F.sort_array(F.collect_list(claim)).alias("claims"), F.min("action_sequence_json").alias("action_sequence_json"), F.count_distinct("action_sequence_json").alias("kinds"))
    one = F.when(F.col("kinds") > 1, F.raise_error(F.concat(F.lit("conflicting action sequences: "), F.col("task_id")))).otherwise(F.col("action_sequence_json"))
    return grouped.select("annotator_id", "task_id", "claims", one.alias("action_sequence_json"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations by the path's ending: .csv sheets, else JSON documents."""
    if path.endswith(".csv"):
        return read_annotation_csv(spark, path)
    return read_documents(spark, path, f"annotator_id string, task_id string, claims array<{CLAIM}>, action_sequence_json string").drop("path")


def read_markdown_tables(spark: SparkSession, path: str, columns: int | None = None) -> DataFrame:
    """path, cells, codes: the data rows of pipe tables, their cells, and the words in backticks; rulers are left out.

    With `columns`, rows of another width are kept with valid false.
    """
    lines = spark.read.text(path).withColumn("path", F.col("_metadata.file_path")).filter(F.trim("value").rlike(r"^\|.*\|$") & ~F.trim("value").rlike(r"^[|\s:\-]+$"))
    cells = F.transform(F.split(F.regexp_replace(F.trim("value"), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    valid = F.size("cells") == columns if columns else F.lit(True)
    return lines.select("path", cells.alias("cells"), F.regexp_extract_all("value", F.lit(r"`([^`]+)`"), 1).alias("codes")).withColumn("valid", valid)


# Roles of files by their names, the first that fits.
FILE_ROLES = [("manifest", r"manifest[^/]*\.json$"), ("schema", r"\.schema\.json$"), ("report", r"\.(md|tex)$"), ("table", r"\.(csv|parquet)$"), ("record", r"\.json$")]


def file_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """path, bytes, sha256, role of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    role = F.lit("other")
    for name, pattern in reversed(FILE_ROLES):
        role = F.when(F.col("path").rlike(pattern), F.lit(name)).otherwise(role)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), role.alias("role"))


def reconciled_inventory(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, verdict (ok, changed, missing, unlisted) of a manifest (path, sha256) against files."""
    a, b = manifest.select("path", F.col("sha256").alias("due")), found.select("path", F.col("sha256").alias("is"))
    verdict = F.when(F.col("is").isNull(), "missing").when(F.col("due").isNull(), "unlisted").when(F.col("due") != F.col("is"), "changed").otherwise("ok")
    return a.join(b, "path", "full_outer").select("path", verdict.alias("verdict"))


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write where nothing stands yet; an existing target fails."""
    df.write.format(kind).option("header", True).mode("errorifexists").save(path)


def write_union_csv(parts: list[DataFrame], path: str) -> None:
    """CSV of frames with different columns: all columns, missing ones null."""
    write_new(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts), path, "csv")


def render_table(df: DataFrame, limit: int = 100, latex: bool = False) -> str:
    """A small result as a Markdown or LaTeX table; `limit` is the report's number of rows."""
    rows = df.limit(limit).collect()
    text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    if latex:
        clean = lambda s: re.sub(r"([&%_#$])", r"\\\1", s)
        body = [" & ".join(clean(text(v)) for v in r) + r" \\" for r in rows]
        return "\n".join([" & ".join(map(clean, df.columns)) + r" \\", r"\midrule", *body])
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}"
    return "\n".join([head, *[f"| {' | '.join(text(v) for v in r)} |" for r in rows]])
