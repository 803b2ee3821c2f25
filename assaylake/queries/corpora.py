"""Event logs, annotations, corpora and constraints."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.columns import family_of, rounded, spelled, variant_of, words
from assaylake.operators import agreement, constraints, design, eventlog, hashing, matching, overlap, simulation
from assaylake.session import shared_folder
from assaylake.streaming import events as streams

ORDER = ["ts", "event_id"]
FIRST, SECOND = "ann_03", "ann_21"


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _events(spark: SparkSession, path: str) -> DataFrame:
    return _table(spark, path, "events")


def running_duplicates(spark: SparkSession, path: str) -> DataFrame:
    events = _events(spark, path).withColumn("eligible", F.col("event_type") != "error")
    return eventlog.running_duplicates(events, ["user_id", "event_type", "props"], ORDER, "eligible").select("event_id", "is_duplicate")


def call_budget(spark: SparkSession, path: str) -> DataFrame:
    return eventlog.over_budget(_events(spark, path), ["user_id", "event_type"], ORDER, 3).select("event_id", "call_no")


def ordered_subsequence(spark: SparkSession, path: str) -> DataFrame:
    return eventlog.in_order(_events(spark, path), "user_id", "event_type", ORDER, ["signup", "view", "purchase"])


def forbidden_before(spark: SparkSession, path: str) -> DataFrame:
    return eventlog.precondition_breaches(_events(spark, path), "user_id", "event_type", ORDER, "purchase", "signup").select("event_id", "user_id")


def state_fold(spark: SparkSession, path: str) -> DataFrame:
    return eventlog.folded_state(_events(spark, path), "user_id", "event_type", "props", ORDER)


def mode_lowest_tie(spark: SparkSession, path: str) -> DataFrame:
    return eventlog.mode_lowest(_events(spark, path), ["user_id"], "event_type")


def event_sessions(spark: SparkSession, path: str) -> DataFrame:
    out = eventlog.sessions(_events(spark, path), "user_id", "ts", ORDER, 86_400)
    return out.select("user_id", "session_no", "n_events", rounded("seconds", 3).alias("seconds"))


def windowed_error_rate(spark: SparkSession, path: str) -> DataFrame:
    out = streams.windowed_rates(_events(spark, path), "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "n_flagged", rounded("rate").alias("rate"))


def event_pivot(spark: SparkSession, path: str) -> DataFrame:
    kinds = ["click", "error", "purchase", "signup", "view"]
    out = _events(spark, path).groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id").alias("n"), F.max("value").alias("top"))
    return out.select("user_id", *[F.coalesce(f"{k}_n", F.lit(0)).alias(f"n_{k}") for k in kinds], *[F.col(f"{k}_top").alias(f"top_{k}") for k in kinds])


def stream_fold(spark: SparkSession, path: str) -> DataFrame:
    """The running duplicates as a stream over the same files, flagged batch by batch in the shared folder; the result after all input."""
    folder = f"{shared_folder(spark).rstrip('/')}/duplicates-{uuid.uuid4().hex}"
    streams.write_duplicates(streams.read_events(spark, path, _events(spark, path).schema), folder).awaitTermination()
    return streams.read_duplicates(spark, folder)


def duplicate_groups(spark: SparkSession, path: str) -> DataFrame:
    return overlap.duplicate_groups(_table(spark, path, "documents"), "doc_id", "text")


def collision_probe(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of records outside the training split that training records have too; null meets null."""
    tasks = _table(spark, path, "task_records").withColumn("split", spelled("split_name"))
    other, train = tasks.filter("split <> 'train'"), tasks.filter("split = 'train'")
    return overlap.collisions(other, train, "record_id", "record_id", "generator_seed")


def overlap_jaccard_topk(spark: SparkSession, path: str) -> DataFrame:
    items, docs = _table(spark, path, "eval_items").select("item_id", "text"), _table(spark, path, "documents").select("doc_id", "text")
    best = overlap.top_per_key(overlap.jaccard(items, docs, "item_id", "doc_id", "text"), "item_id", "doc_id", "jaccard", 3)
    return best.select("item_id", "doc_id", "n_shared", rounded("jaccard").alias("jaccard"), "rank")


def multiset_f1(spark: SparkSession, path: str) -> DataFrame:
    """Tokens of an answer against those of its prompt, as multisets."""
    answers = _table(spark, path, "run_artifacts").filter("raw_output is not null").select("artifact_id", "prompt_hash", "raw_output")
    prompts = _table(spark, path, "prompts").select("prompt_hash", "prompt_text")
    predicted = answers.select("artifact_id", F.explode(words("raw_output")).alias("atom"))
    reference = answers.join(prompts, "prompt_hash").select("artifact_id", F.explode(words("prompt_text")).alias("atom"))
    out = matching.multiset_scores(predicted, reference, "artifact_id", "atom")
    return out.select("artifact_id", "tp", "n_predicted", "n_reference", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def canonical_hash(spark: SparkSession, path: str) -> DataFrame:
    return hashing.dataset_hash(_events(spark, path), ["event_type"], "event_id", "user_id", "props")


def canonical_outputs(spark: SparkSession, path: str) -> DataFrame:
    """Parsed answers in canonical JSON: how many spellings each canonical document has."""
    made = hashing.with_canonical_json(_table(spark, path, "run_artifacts"), "artifact_id", "parsed_output")
    return made.filter("canonical is not null").groupBy("sha256").agg(F.count("*").alias("n"), F.min("artifact_id").alias("first_id"))


def constraint_audit(spark: SparkSession, path: str) -> DataFrame:
    """Keys, references, domains and ranges of several tables, one row per rule; all rules of a row in one scan of its table."""
    lineitem, orders, runs = _table(spark, path, "lineitem"), _table(spark, path, "orders"), _table(spark, path, "pilot_runs")
    line = lineitem.withColumn("line", F.concat_ws("|", "l_orderkey", "l_linenumber"))
    hashes = F.coalesce("prompt_hashes", F.array().cast("array<string>"))
    found = constraints.violations(
        constraints.unique(orders, "orders_key", "o_orderkey"),
        constraints.unique(line, "line_key", "line"),
        constraints.foreign_key(line, "line_order", "line", "l_orderkey", orders, "o_orderkey"),
        constraints.foreign_key(line, "line_part", "line", "l_partkey", _table(spark, path, "part"), "p_partkey"),
        constraints.foreign_key(line, "line_supplier", "line", "l_suppkey", _table(spark, path, "supplier"), "s_suppkey"),
        constraints.row_rules(line, "line", {
            "line_flag": (F.col("l_returnflag").isin("A", "N", "R"), F.col("l_returnflag")), "line_discount": (F.col("l_discount").between(0, 0.1), F.col("l_discount")),
        }),
        constraints.unique(runs, "run_cell", "task_id", "model", "seed", "method"),
        constraints.row_rules(runs, "run_id", {
            "run_config": (F.col("model").isNotNull() & F.col("config_hash").isNotNull(), F.concat_ws(",", F.when(F.col("model").isNull(), "model"), F.when(F.col("config_hash").isNull(), "config_hash"))),
            "run_hashes": (F.forall(hashes, lambda h: h.isNotNull()), F.size(hashes)),
        }),
        constraints.foreign_key(runs.select("run_id", F.explode("prompt_hashes").alias("prompt_hash")), "run_prompt", "run_id", "prompt_hash", _table(spark, path, "prompts"), "prompt_hash"),
    )
    return constraints.audit(found, RULES)


RULES = ["orders_key", "line_key", "line_order", "line_part", "line_supplier", "line_flag", "line_discount", "run_cell", "run_config", "run_hashes", "run_prompt"]


def hard_gates(spark: SparkSession, path: str) -> DataFrame:
    return constraints.gate(constraint_audit(spark, path))


def _claims(spark: SparkSession, path: str) -> DataFrame:
    """The claims of each annotator's latest submission per task, labels as spelled by the project."""
    latest = (
        _table(spark, path, "annotations").select(spelled("annotator_id").alias("annotator"), "task_id", "claims", F.struct("submitted_at", "received_at", "annotation_id").alias("age"))
        .groupBy("annotator", "task_id").agg(F.max_by("claims", "age").alias("claims"))
    )
    flat = latest.select("annotator", "task_id", F.inline("claims"))
    return flat.select("annotator", "task_id", "key", spelled("category").alias("category"), spelled("status").alias("status"), "value_json", "criticality").dropDuplicates(["annotator", "task_id", "key"])


def _two(spark: SparkSession, path: str) -> DataFrame:
    claims = _claims(spark, path)
    a, b = claims.filter(F.col("annotator") == FIRST), claims.filter(F.col("annotator") == SECOND)
    both = a.select("task_id").intersect(b.select("task_id"))
    side = lambda df: df.join(both, "task_id", "left_semi")
    return agreement.differences(side(a), side(b), ["task_id", "key"], ["category", "status", "value_json", "criticality"])


def disagreement_queue(spark: SparkSession, path: str) -> DataFrame:
    return _two(spark, path).filter("kind <> 'none'").select("task_id", "key", "kind", F.array_join("fields", ",").alias("fields"))


def agreement_prf(spark: SparkSession, path: str) -> DataFrame:
    out = agreement.agreement(_two(spark, path).withColumn("domain", family_of(family_of("task_id"))), [], ["category", "status", "value_json"])
    return out.select("n_a", "n_b", "tp", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def _resolution_rules() -> list:
    has = lambda f: F.array_contains("fields", f)
    return [("REJECT", F.col("kind") == "missing_from_a"), ("ACCEPT_A", F.col("kind") == "missing_from_b"), ("RECONSTRUCT", has("category") & has("status")), ("ACCEPT_B", has("value_json"))]


def queue_resolution(spark: SparkSession, path: str) -> DataFrame:
    out = agreement.resolved(_two(spark, path).filter("kind <> 'none'"), _resolution_rules(), "ACCEPT_A")
    return out.groupBy("resolution").agg(F.count("*").alias("n"))


PAIR = ["annotator_a", "annotator_b"]


def _sides(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims of either side of every pair of annotators, the smaller name first, on the tasks that both did."""
    did = claims.filter("annotator is not null").select("annotator", "task_id").distinct()
    a, b = did.withColumnRenamed("annotator", "annotator_a"), did.withColumnRenamed("annotator", "annotator_b")
    pairs = a.join(b, "task_id").filter("annotator_a < annotator_b")
    side = lambda name: claims.withColumnRenamed("annotator", name).join(pairs, [name, "task_id"])
    return side("annotator_a"), side("annotator_b")


def _all_pairs(spark: SparkSession, path: str) -> DataFrame:
    return agreement.differences(*_sides(_claims(spark, path)), [*PAIR, "task_id", "key"], ["category", "status", "value_json", "criticality"])


def disagreement_queue_pairs(spark: SparkSession, path: str) -> DataFrame:
    """disagreement_queue of every pair of annotators."""
    return _all_pairs(spark, path).filter("kind <> 'none'").select(*PAIR, "task_id", "key", "kind", F.array_join("fields", ",").alias("fields"))


def agreement_prf_pairs(spark: SparkSession, path: str) -> DataFrame:
    """agreement_prf of every pair of annotators."""
    out = agreement.agreement(_all_pairs(spark, path), PAIR, ["category", "status", "value_json"])
    return out.select(*PAIR, "n_a", "n_b", "tp", *[rounded(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def queue_resolution_pairs(spark: SparkSession, path: str) -> DataFrame:
    """queue_resolution of every pair of annotators."""
    out = agreement.resolved(_all_pairs(spark, path).filter("kind <> 'none'"), _resolution_rules(), "ACCEPT_A")
    return out.groupBy(*PAIR, "resolution").agg(F.count("*").alias("n"))


def merged_claims_pairs(spark: SparkSession, path: str) -> DataFrame:
    """The claims of every pair of annotators merged on the tasks that both did."""
    return agreement.merged(*_sides(_claims(spark, path).filter("key is not null")), [*PAIR, "task_id", "key"], ["category", "status"])


def claim_counters(spark: SparkSession, path: str) -> DataFrame:
    claims = _table(spark, path, "annotations").select(F.inline("claims")).filter("key is not null")
    return claims.groupBy(spelled("category").alias("category"), spelled("status").alias("status")).agg(F.count("*").alias("n"))


def state_scores(spark: SparkSession, path: str) -> DataFrame:
    """Claims of one annotator against another's as predicted against reference state."""
    claims = _claims(spark, path).select("annotator", "task_id", "category", "key", "status", "value_json", F.lit(1.0).alias("weight"), F.when(F.startswith("value_json", F.lit("[")), "set").otherwise("string").alias("value_type"), F.col("key").alias("claim_no"))
    usable = claims.filter("category is not null and key is not null")
    return matching.state_scores(usable.filter(F.col("annotator") == FIRST), usable.filter(F.col("annotator") == SECOND), "task_id")


def assignment_match(spark: SparkSession, path: str) -> DataFrame:
    """Prompts of a task matched one to one with its packets' observations by shared words."""
    prompts = _table(spark, path, "prompts").select("task_id", F.col("prompt_hash").alias("left"), F.array_distinct(words("prompt_text")).alias("words"))
    packets = _table(spark, path, "packets").select("task_id", F.col("packet_id").alias("right"), F.array_distinct(words("workflow_observation")).alias("words"))
    return matching.word_matches(prompts, packets, "task_id", "left", "right", "words")


def priority_tiers(spark: SparkSession, path: str) -> DataFrame:
    docs = _table(spark, path, "documents").select(
        "doc_id", F.coalesce(F.trim("lang") == "", F.lit(True)).alias("no_label"), F.coalesce(F.length("text") < 80, F.lit(True)).alias("short"), (F.col("doc_kind").isNull()).alias("no_kind"),
        F.coalesce(F.contains("text", F.lit("<|")), F.lit(False)).alias("special"), F.coalesce(F.col("created_at") > F.col("ingested_at"), F.lit(False)).alias("early"),
    )
    out = agreement.tiers(docs, {"no_label": 2, "short": 4, "no_kind": 1, "special": 4, "early": 2}, [("P0", 8), ("P1", 5), ("P2", 3)], "P3")
    return out.select("doc_id", "score", "codes", "tier")


def set_algebra_lineage(spark: SparkSession, path: str) -> DataFrame:
    tasks = lambda name: _table(spark, path, name).select("task_id").filter("task_id is not null")
    out = agreement.composed([("packets", tasks("packets")), ("prompts", tasks("prompts")), ("annotations", tasks("annotations"))], "task_id")
    return out.groupBy("origins").agg(F.count("*").alias("n_tasks"))


def set_differences(spark: SparkSession, path: str) -> DataFrame:
    tasks = lambda name: _table(spark, path, name).select("task_id").filter("task_id is not null")
    a, b = tasks("packets"), tasks("annotations")
    one = lambda name, df: df.agg(F.lit(name).alias("set_op"), F.count("*").alias("n"))
    return one("union", a.union(b).distinct()).unionAll(one("intersect", a.intersect(b))).unionAll(one("a_minus_b", a.subtract(b))).unionAll(one("b_minus_a", b.subtract(a)))


def merged_claims(spark: SparkSession, path: str) -> DataFrame:
    claims = _claims(spark, path).filter("key is not null")
    a, b = claims.filter(F.col("annotator") == FIRST), claims.filter(F.col("annotator") == SECOND)
    return agreement.merged(a, b, ["task_id", "key"], ["category", "status"])


def seeded_order(spark: SparkSession, path: str) -> DataFrame:
    """Blind ids and positions of a domain's packets: orders that a seed fixes, one per assignment."""
    from pyspark.sql import Window

    rows = _table(spark, path, "packets").filter("domain is not null").select("domain", "packet_id")
    place = lambda seed: F.row_number().over(Window.partitionBy("domain").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("packet_id"))), "packet_id"))
    return rows.select("packet_id", F.substring(F.sha2(F.concat_ws(":", F.lit("a"), F.col("packet_id")), 256), 1, 16).alias("blind_id"), place("a").alias("position_a"), place("b").alias("position_b"))


def label_parts(spark: SparkSession, path: str) -> DataFrame:
    tasks = _table(spark, path, "task_records").select(family_of("task_id").alias("family"), variant_of("task_id").alias("variant"), spelled("split_name").alias("split"))
    return tasks.groupBy("family", "split").agg(F.count("*").alias("n"), F.count_distinct("variant").alias("n_variants"))


def late_records(spark: SparkSession, path: str) -> DataFrame:
    """Records by source that came in more than a week after they were made."""
    tasks = _table(spark, path, "task_records").filter("created_at is not null and ingested_at is not null")
    late = (F.unix_seconds(F.col("ingested_at").cast("timestamp")) - F.unix_seconds(F.col("created_at").cast("timestamp")) > 7 * 86_400).cast("long")
    return tasks.groupBy("source").agg(F.count("*").alias("n"), F.sum(late).alias("n_late"))


def order_lines_wide(spark: SparkSession, path: str) -> DataFrame:
    """Quantities by return flag and line status, in the style of a pricing summary."""
    out = _table(spark, path, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.countDistinct("l_suppkey").alias("n_suppliers"))
    return out


def top_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customers of each market segment by number of orders, the three first."""
    orders = _table(spark, path, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    names = _table(spark, path, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return overlap.top_per_key(orders.join(names, "o_custkey"), "c_mktsegment", "o_custkey", "n_orders", 3)


def power_grid(spark: SparkSession, path: str) -> DataFrame:
    """The whole grid of 36 cells with 1,000 replications of 1,000 draws each; reads no table."""
    return simulation.power_grid(spark)


def design_matrix(spark: SparkSession, path: str) -> DataFrame:
    """The scheduled cells: tasks by models by seeds by conditions, with a hash of each cell's configuration."""
    from assaylake.queries.analysis import METHODS

    units = _table(spark, path, "pilot_runs").select("task_id").distinct()
    cells = design.design(units, model=["m1", "m2"], seed=[0, 1], method=METHODS)
    return cells.groupBy("model", "seed", "method").agg(F.count("*").alias("n_tasks"), F.min(F.sha2(hashing.row_text("model", "seed", "method"), 256)).alias("config_hash"))


QUERIES = {f.__name__: f for f in (
    running_duplicates, call_budget, ordered_subsequence, forbidden_before, state_fold, mode_lowest_tie, event_sessions, windowed_error_rate, event_pivot, stream_fold, duplicate_groups,
    collision_probe, overlap_jaccard_topk, multiset_f1, canonical_hash, canonical_outputs, constraint_audit, hard_gates, disagreement_queue, agreement_prf, queue_resolution, claim_counters,
    state_scores, assignment_match, priority_tiers, set_algebra_lineage, set_differences, merged_claims, seeded_order, label_parts, late_records, order_lines_wide, top_customers, power_grid, design_matrix,
    disagreement_queue_pairs, agreement_prf_pairs, queue_resolution_pairs, merged_claims_pairs,
)}


def _spelled(x: str) -> str:
    return rf"nullif(regexp_replace(lower(regexp_replace({x}, '^[\s_\-]+|[\s_\-]+$', '', 'g')), '[\s_\-]+', '_', 'g'), '')"


def _words(x: str) -> str:
    return rf"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '([\p{{L}}\p{{N}}]+)', 1)"


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[0-9]{4}-[0-9]{2}-[0-9]{2}', '<date>', 'g'), '[a-z_-]*[0-9][a-z0-9_-]*', '<id>', 'g'), '[ \t\r\n\f]+', ' ', 'g'))"
_CLAIMS = f"""
    n AS (SELECT {_spelled('annotator_id')} AS annotator, task_id, claims, submitted_at, received_at, annotation_id FROM annotations),
    l AS (SELECT annotator, task_id, arg_max(claims, (submitted_at, received_at, annotation_id)) AS claims FROM n GROUP BY 1, 2),
    f AS (SELECT annotator, task_id, unnest(claims) AS c FROM l),
    claims AS (SELECT annotator, task_id, c.key AS key, {_spelled('c.category')} AS category, {_spelled('c.status')} AS status, c.value_json AS value_json, c.criticality AS criticality FROM f)"""
_TWO = f"""{_CLAIMS},
    both_tasks AS (SELECT task_id FROM claims WHERE annotator = '{FIRST}' INTERSECT SELECT task_id FROM claims WHERE annotator = '{SECOND}'),
    a AS (SELECT * FROM claims WHERE annotator = '{FIRST}' AND task_id IN (FROM both_tasks)), b AS (SELECT * FROM claims WHERE annotator = '{SECOND}' AND task_id IN (FROM both_tasks)),
    d AS (SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.key, b.key) AS key,
        CASE WHEN a.annotator IS NULL THEN 'missing_from_a' WHEN b.annotator IS NULL THEN 'missing_from_b' ELSE 'both' END AS side,
        list_filter([CASE WHEN a.category IS DISTINCT FROM b.category THEN 'category' END, CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END,
            CASE WHEN a.value_json IS DISTINCT FROM b.value_json THEN 'value_json' END, CASE WHEN a.criticality IS DISTINCT FROM b.criticality THEN 'criticality' END], lambda x: x IS NOT NULL) AS x
        FROM a FULL JOIN b ON a.task_id = b.task_id AND a.key = b.key),
    q AS (SELECT task_id, key, CASE WHEN side <> 'both' THEN side WHEN len(x) > 0 THEN 'fields' ELSE 'none' END AS kind, CASE WHEN side = 'both' THEN x ELSE [] END AS fields FROM d)"""
_AUDIT = """
    a AS (
        SELECT 'orders_key' AS r, count(*) AS n FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
        UNION ALL SELECT 'line_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
        UNION ALL SELECT 'line_order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT 'line_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
        UNION ALL SELECT 'line_supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
        UNION ALL SELECT 'line_flag', count(*) FROM lineitem WHERE coalesce(l_returnflag NOT IN ('A', 'N', 'R'), true)
        UNION ALL SELECT 'line_discount', count(*) FROM lineitem WHERE NOT coalesce(l_discount BETWEEN 0 AND 0.1::DOUBLE, false)
        UNION ALL SELECT 'run_cell', count(*) FROM (SELECT 1 FROM pilot_runs GROUP BY task_id, model, seed, method HAVING count(*) > 1)
        UNION ALL SELECT 'run_config', count(*) FROM pilot_runs WHERE model IS NULL OR config_hash IS NULL
        UNION ALL SELECT 'run_hashes', count(*) FROM pilot_runs WHERE list_contains(list_transform(prompt_hashes, lambda x: x IS NULL), true)
        UNION ALL SELECT 'run_prompt', count(*) FROM (SELECT unnest(prompt_hashes) AS h FROM pilot_runs) WHERE h IS NOT NULL AND h NOT IN (SELECT prompt_hash FROM prompts))"""
_TASKS = "SELECT DISTINCT task_id FROM {} WHERE task_id IS NOT NULL"

ORACLES: dict[str, str] = {
    "running_duplicates": """
        SELECT event_id, event_type <> 'error' AND coalesce(sum(cast(event_type <> 'error' AS int)) OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS is_duplicate FROM events""",
    "call_budget": "SELECT event_id, call_no FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS call_no FROM events) WHERE call_no > 3",
    "ordered_subsequence": """
        WITH p AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events WHERE event_type IN ('signup', 'view', 'purchase')),
        a AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN place END) AS a0 FROM p GROUP BY 1),
        b AS (SELECT a.user_id, a0, min(CASE WHEN event_type = 'view' AND place > a0 THEN place END) AS a1 FROM a JOIN p USING (user_id) GROUP BY 1, 2),
        c AS (SELECT b.user_id, a0, a1, min(CASE WHEN event_type = 'purchase' AND place > a1 THEN place END) AS a2 FROM b JOIN p USING (user_id) GROUP BY 1, 2, 3)
        SELECT user_id, cast(a0 IS NOT NULL AS int) + cast(a1 IS NOT NULL AS int) + cast(a2 IS NOT NULL AS int) AS n_matched, a2 IS NOT NULL AS complete FROM c""",
    "forbidden_before": """
        SELECT event_id, user_id FROM (SELECT *, coalesce(max(cast(event_type = 'signup' AS int)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ready FROM events)
        WHERE event_type = 'purchase' AND ready = 0""",
    "state_fold": "SELECT user_id, event_type, arg_max(props, (ts, event_id)) AS value, count(*) AS n_updates FROM events GROUP BY 1, 2",
    "mode_lowest_tie": """
        SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2)) WHERE k = 1""",
    "event_sessions": """
        WITH s AS (SELECT *, epoch_us(ts) / 1e6::DOUBLE AS sec FROM events),
        m AS (SELECT *, coalesce(cast(sec - lag(sec) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 86400 AS int), 0) AS new FROM s),
        n AS (SELECT *, cast(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS bigint) AS session_no FROM m)
        SELECT user_id, session_no, count(*) AS n_events, round(max(sec) - min(sec), 3) AS seconds FROM n GROUP BY 1, 2""",
    "windowed_error_rate": """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, cast(sum(cast(event_type = 'error' AS int)) AS bigint) AS n_flagged, round(avg(cast(event_type = 'error' AS int)::DOUBLE), 8) AS rate FROM events GROUP BY 1""",
    "event_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}, max(value) FILTER (event_type = '{k}') AS top_{k}" for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "duplicate_groups": f"SELECT sha256({_NORMAL}) AS text_hash, count(*) AS n, min(doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "collision_probe": f"""
        WITH t AS (SELECT record_id, generator_seed, {_spelled('split_name')} AS split FROM task_records), b AS (SELECT generator_seed AS s, count(*) AS n_matches, min(record_id) AS first_match FROM t WHERE split = 'train' GROUP BY 1)
        SELECT record_id, n_matches, first_match FROM t JOIN b ON t.generator_seed IS NOT DISTINCT FROM b.s WHERE split <> 'train'""",
    "overlap_jaccard_topk": f"""
        WITH w AS (SELECT 'i' AS side, item_id AS id, {_words('text')} AS w FROM eval_items WHERE text IS NOT NULL UNION ALL SELECT 'd', doc_id, {_words('text')} FROM documents WHERE text IS NOT NULL),
        s AS (SELECT side, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
        x AS (SELECT side, id, len(s) AS n, unnest(s) AS g FROM s),
        p AS (SELECT a.id AS item_id, b.id AS doc_id, count(*) AS n_shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g WHERE a.side = 'i' AND b.side = 'd' GROUP BY 1, 2),
        r AS (SELECT item_id, doc_id, n_shared, n_shared::DOUBLE / (na + nb - n_shared) AS j FROM p), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS rank FROM r)
        SELECT item_id, doc_id, n_shared, round(j, 8) AS jaccard, rank FROM k WHERE rank <= 3""",
    "multiset_f1": f"""
        WITH p AS (SELECT artifact_id, unnest({_words('raw_output')}) AS atom FROM run_artifacts WHERE raw_output IS NOT NULL),
        r AS (SELECT artifact_id, unnest({_words('prompt_text')}) AS atom FROM run_artifacts JOIN prompts USING (prompt_hash) WHERE raw_output IS NOT NULL),
        b AS (SELECT artifact_id, coalesce(p.n, 0) AS n_p, coalesce(r.n, 0) AS n_r FROM (SELECT artifact_id, atom, count(*) AS n FROM p GROUP BY 1, 2) p FULL JOIN (SELECT artifact_id, atom, count(*) AS n FROM r GROUP BY 1, 2) r USING (artifact_id, atom)),
        t AS (SELECT artifact_id, cast(sum(least(n_p, n_r)) AS bigint) AS tp, cast(sum(n_p) AS bigint) AS n_predicted, cast(sum(n_r) AS bigint) AS n_reference FROM b GROUP BY 1),
        s AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp::DOUBLE / n_predicted WHEN n_reference > 0 THEN 0 ELSE 1 END AS p, CASE WHEN n_reference > 0 THEN tp::DOUBLE / n_reference ELSE 1 END AS r FROM t)
        SELECT artifact_id, tp, n_predicted, n_reference, round(p, 8) AS precision, round(r, 8) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 8) AS f1 FROM s""",
    "canonical_hash": r"""
        WITH h AS (SELECT event_type, sha256(concat_ws('|', coalesce(cast(event_id AS varchar), '\N'), coalesce(cast(user_id AS varchar), '\N'), coalesce(props, '\N'))) AS h FROM events),
        b AS (SELECT event_type, substr(h, 1, 2) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM h GROUP BY 1, 2)
        SELECT event_type, cast(sum(n) AS bigint) AS n_rows, sha256(string_agg(h, '' ORDER BY k)) AS dataset_hash FROM b GROUP BY 1""",
    "constraint_audit": f"WITH {_AUDIT} SELECT r AS rule_id, n AS n_violations, n = 0 AS passed FROM a",
    "hard_gates": f"WITH {_AUDIT} SELECT count(*) AS n_rules, count(*) FILTER (n > 0) AS n_failed, bool_and(n = 0) AS passed FROM a",
    "disagreement_queue": f"WITH {_TWO} SELECT task_id, key, kind, array_to_string(fields, ',') AS fields FROM q WHERE kind <> 'none'",
    "agreement_prf": f"""
        WITH {_TWO}, c AS (SELECT cast(count(*) FILTER (kind <> 'missing_from_a') AS bigint) AS n_a, count(*) FILTER (kind <> 'missing_from_b') AS n_b,
            count(*) FILTER (kind IN ('none', 'fields') AND NOT list_has_any(fields, ['category', 'status', 'value_json'])) AS tp FROM q)
        SELECT n_a, n_b, tp, round(coalesce(tp::DOUBLE / nullif(n_b, 0), 0), 8) AS precision, round(coalesce(tp::DOUBLE / nullif(n_a, 0), 0), 8) AS recall, round(coalesce(2 * tp::DOUBLE / nullif(n_a + n_b, 0), 0), 8) AS f1 FROM c""",
    "queue_resolution": f"""
        WITH {_TWO} SELECT CASE WHEN kind = 'missing_from_a' THEN 'REJECT' WHEN kind = 'missing_from_b' THEN 'ACCEPT_A' WHEN list_has_all(fields, ['category', 'status']) THEN 'RECONSTRUCT'
            WHEN list_contains(fields, 'value_json') THEN 'ACCEPT_B' ELSE 'ACCEPT_A' END AS resolution, count(*) AS n FROM q WHERE kind <> 'none' GROUP BY 1""",
    "claim_counters": f"SELECT {_spelled('c.category')} AS category, {_spelled('c.status')} AS status, count(*) AS n FROM (SELECT unnest(claims) AS c FROM annotations) WHERE c.key IS NOT NULL GROUP BY 1, 2",
    "priority_tiers": """
        WITH f AS (SELECT doc_id, coalesce(trim(lang) = '', true) AS no_label, coalesce(length(text) < 80, true) AS short, doc_kind IS NULL AS no_kind, coalesce(contains(text, '<|'), false) AS special,
            coalesce(created_at > ingested_at, false) AS early FROM documents),
        s AS (SELECT doc_id, 2 * no_label::int + 4 * short::int + no_kind::int + 4 * special::int + 2 * early::int AS score, array_to_string(list_filter([CASE WHEN no_label THEN 'no_label' END, CASE WHEN short THEN 'short' END,
            CASE WHEN no_kind THEN 'no_kind' END, CASE WHEN special THEN 'special' END, CASE WHEN early THEN 'early' END], lambda x: x IS NOT NULL), ',') AS codes FROM f)
        SELECT doc_id, score, codes, CASE WHEN score >= 8 THEN 'P0' WHEN score >= 5 THEN 'P1' WHEN score >= 3 THEN 'P2' ELSE 'P3' END AS tier FROM s""",
    "set_algebra_lineage": f"""
        WITH u AS (SELECT task_id, 'packets' AS o FROM ({_TASKS.format('packets')}) UNION ALL SELECT task_id, 'prompts' FROM ({_TASKS.format('prompts')}) UNION ALL SELECT task_id, 'annotations' FROM ({_TASKS.format('annotations')})),
        g AS (SELECT task_id, string_agg(o, '+' ORDER BY o) AS origins FROM u GROUP BY 1) SELECT origins, count(*) AS n_tasks FROM g GROUP BY 1""",
    "set_differences": f"""
        WITH a AS ({_TASKS.format('packets')}), b AS ({_TASKS.format('annotations')})
        SELECT 'union' AS set_op, count(*) AS n FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', count(*) FROM (FROM a INTERSECT FROM b)
        UNION ALL SELECT 'a_minus_b', count(*) FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'b_minus_a', count(*) FROM (FROM b EXCEPT FROM a)""",
    "merged_claims": f"""
        WITH {_CLAIMS}, a AS (SELECT * FROM claims WHERE annotator = '{FIRST}' AND key IS NOT NULL), b AS (SELECT * FROM claims WHERE annotator = '{SECOND}' AND key IS NOT NULL)
        SELECT coalesce(a.task_id, b.task_id) AS task_id, coalesce(a.key, b.key) AS key, coalesce(b.category, a.category) AS category, coalesce(b.status, a.status) AS status, b.annotator IS NOT NULL AS patched
        FROM a FULL JOIN b ON a.task_id = b.task_id AND a.key = b.key""",
    "seeded_order": """
        SELECT packet_id, substr(sha256('a:' || packet_id), 1, 16) AS blind_id, row_number() OVER (PARTITION BY domain ORDER BY md5('a:' || packet_id), packet_id) AS position_a,
            row_number() OVER (PARTITION BY domain ORDER BY md5('b:' || packet_id), packet_id) AS position_b FROM packets WHERE domain IS NOT NULL""",
    "label_parts": f"SELECT regexp_replace(task_id, '_[^_]*$', '') AS family, {_spelled('split_name')} AS split, count(*) AS n, count(DISTINCT regexp_extract(task_id, '([^_]*)$', 1)) AS n_variants FROM task_records GROUP BY 1, 2",
    "late_records": "SELECT source, count(*) AS n, cast(sum(cast(floor(epoch(ingested_at)) - floor(epoch(created_at)) > 7 * 86400 AS int)) AS bigint) AS n_late FROM task_records WHERE created_at IS NOT NULL AND ingested_at IS NOT NULL GROUP BY 1",
    "order_lines_wide": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2",
    "top_customers": """
        WITH o AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1), k AS (SELECT o_custkey, n_orders, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY n_orders DESC, o_custkey) AS rank FROM o JOIN customer ON c_custkey = o_custkey)
        SELECT * FROM k WHERE rank <= 3""",
    "design_matrix": """
        WITH t AS (SELECT count(DISTINCT task_id) AS n FROM pilot_runs), c AS (SELECT * FROM (SELECT unnest(['m1', 'm2']) AS model), (SELECT unnest([0, 1]) AS seed), (SELECT DISTINCT method FROM pilot_runs WHERE method IS NOT NULL))
        SELECT model, seed, method, n AS n_tasks, sha256(concat_ws('|', model, seed, method)) AS config_hash FROM c, t""",
}
