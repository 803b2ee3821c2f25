"""Flat tables of nested packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.columns import rounded, spelled
from assaylake.operators import predicates, shredding
from assaylake.session import materialize


def _packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/packets.parquet").select(F.col("packet_id").cast("long").alias("packet_id"), "packet_json")


def p4_found(spark: SparkSession, path: str) -> DataFrame:
    nodes = materialize(shredding.packet_nodes(_packets(spark, path)), "packet-nodes")
    return shredding.content_nodes(nodes).select("packet_id", "event_no", "trace_id", "source_type", "node_path", "node_kind")


def p4_events(spark: SparkSession, path: str) -> DataFrame:
    return shredding.packet_events(shredding.packet_nodes(_packets(spark, path)))


def p4_packets(spark: SparkSession, path: str) -> DataFrame:
    return shredding.packet_table(_packets(spark, path))


CONTRACT = "struct<public_action_contract:array<struct<action:string,arguments:map<string,struct<enum:array<string>>>,requires:array<string>,user_impacting:boolean>>>"


def _actions(spark: SparkSession, path: str) -> DataFrame:
    packets = spark.read.parquet(f"{path}/packets.parquet").select("packet_id", "task_id", F.from_json("packet_json", CONTRACT).alias("p"))
    return packets.select("packet_id", "task_id", F.posexplode("p.public_action_contract").alias("action_no", "a"))


def action_contract(spark: SparkSession, path: str) -> DataFrame:
    """Actions of each packet, and the chance that uniform picks from the listed values hit all arguments."""
    chance = F.aggregate(F.transform(F.map_values("a.arguments"), lambda x: F.lit(1.0) / F.greatest(F.size(x["enum"]), F.lit(1))), F.lit(1.0), lambda a, x: a * x)
    return _actions(spark, path).select("packet_id", F.col("action_no").cast("long").alias("action_no"), "a.action", F.coalesce("a.user_impacting", F.lit(False)).alias("user_impacting"), rounded(chance).alias("chance"))


def predicate_checks(spark: SparkSession, path: str) -> DataFrame:
    """What the actions require against the claims of one annotator: verdicts per condition."""
    conditions = _actions(spark, path).select("packet_id", "task_id", "action_no", F.explode("a.requires").alias("condition"))
    claims = spark.read.parquet(f"{path}/annotations.parquet").select("task_id", F.struct("submitted_at", "received_at", "annotation_id").alias("age"), F.inline("claims"))
    latest = claims.filter("key is not null").groupBy("task_id", "key").agg(F.max_by(F.struct("status", "value_json"), "age").alias("c"))
    atoms = latest.select("task_id", "key", spelled("c.status").alias("status"), "c.value_json")
    out = predicates.evaluated(conditions, atoms, ["task_id"], "condition")
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


def provenance_links(spark: SparkSession, path: str) -> DataFrame:
    """Pointers of claims by annotator: how many there are and how many point at no event of the task."""
    refs = spark.read.parquet(f"{path}/annotations.parquet").select("annotation_id", spelled("annotator_id").alias("annotator"), "task_id", F.inline("claims")).select("annotation_id", "annotator", "task_id", F.inline("provenance"))
    events = spark.read.parquet(f"{path}/task_records.parquet").select("task_id", F.explode("trace.trace_id").alias("trace_id"))
    loose = predicates.dangling(refs, events, ["task_id", "trace_id"]).groupBy("annotator").agg(F.count("*").alias("n_dangling"))
    return refs.groupBy("annotator").agg(F.count("*").alias("n")).join(loose, "annotator", "left").select("annotator", "n", F.coalesce("n_dangling", F.lit(0)).alias("n_dangling"))


def deep_contains(spark: SparkSession, path: str) -> DataFrame:
    nodes = shredding.packet_nodes(_packets(spark, path))
    return predicates.containing(nodes.filter("node_path is not null"), ["packet_id"], "contradicted")


QUERIES = {f.__name__: f for f in (p4_found, p4_events, p4_packets, action_contract, predicate_checks, provenance_links, deep_contains)}
_ACTIONS = "acts AS (SELECT packet_id, task_id, unnest(range(len(l))) AS action_no, unnest(l) AS a FROM (SELECT packet_id, task_id, cast(json_extract(packet_json, '$.public_action_contract') AS json[]) AS l FROM packets WHERE json_valid(packet_json)))"
_SPELLED = r"nullif(regexp_replace(lower(regexp_replace({}, '^[\s_\-]+|[\s_\-]+$', '', 'g')), '[\s_\-]+', '_', 'g'), '')"
ORACLES: dict[str, str] = {
    "p4_packets": """
        SELECT packet_id, json_extract_string(j, '$.task_id') AS task_id, json_extract_string(j, '$.domain') AS domain,
            json_extract_string(j, '$.boundary.boundary_id') AS boundary_id, json_extract_string(j, '$.boundary.source_role') AS source_role,
            json_extract_string(j, '$.boundary.target_role') AS target_role, json_extract_string(j, '$.boundary.trace_cut') AS trace_cut
        FROM (SELECT packet_id, cast(packet_json AS json) AS j FROM packets WHERE json_valid(packet_json))
    """,
    "action_contract": f"""
        WITH {_ACTIONS} SELECT packet_id, action_no, json_extract_string(a, '$.action') AS action, coalesce(cast(json_extract(a, '$.user_impacting') AS boolean), false) AS user_impacting,
            round(list_reduce(list_transform(json_keys(a, '$.arguments'), lambda k: 1.0::DOUBLE / greatest(json_array_length(a, '$.arguments.' || k || '.enum'), 1)), lambda x, y: x * y, 1.0::DOUBLE), 8) AS chance FROM acts""",
    "predicate_checks": f"""
        WITH {_ACTIONS}, c AS (SELECT task_id, unnest(cast(json_extract(a, '$.requires') AS varchar[])) AS condition FROM acts),
        p AS (SELECT task_id, starts_with(condition, '!') AS negated, split_part(ltrim(condition, '!'), '=', 1) AS key, split_part(ltrim(condition, '!'), '=', 2) AS expected FROM c),
        k AS (SELECT task_id, submitted_at, received_at, annotation_id, unnest(claims) AS c FROM annotations),
        l AS (SELECT task_id, c.key AS key, arg_max(struct_pack(s := c.status, v := c.value_json), (submitted_at, received_at, annotation_id)) AS x FROM k WHERE c.key IS NOT NULL GROUP BY 1, 2),
        e AS (SELECT p.*, l.key IS NOT NULL AS there, {_SPELLED.format('x.s')} AS status FROM p LEFT JOIN l ON l.task_id = p.task_id AND l.key = p.key)
        SELECT CASE WHEN NOT there THEN 'missing' WHEN (status IS NOT DISTINCT FROM expected) <> negated THEN 'satisfied' ELSE 'contradicted' END AS verdict, count(*) AS n FROM e GROUP BY 1""",
    "provenance_links": f"""
        WITH c AS (SELECT annotation_id, {_SPELLED.format('annotator_id')} AS annotator, task_id, unnest(claims) AS c FROM annotations),
        r AS (SELECT annotator, task_id, unnest(c.provenance) AS p FROM c), t AS (SELECT DISTINCT task_id, e.trace_id AS trace_id FROM (SELECT task_id, unnest(trace) AS e FROM task_records))
        SELECT annotator, count(*) AS n, count(*) FILTER (t.trace_id IS NULL) AS n_dangling FROM r LEFT JOIN t ON t.task_id = r.task_id AND t.trace_id = r.p.trace_id GROUP BY 1""",
}
