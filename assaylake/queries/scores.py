"""Scores, full agreement, strata, overlap signals, cause audits and validation rules over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.columns import rounded, spelled
from assaylake.operators import constraints, design, scoring
from assaylake.queries.analysis import RUNS_SQL, WILSON_SQL
from assaylake.queries.corpora import _spelled

# The categories of claims in their order, those that count as primary, statuses and criticalities.
CATEGORIES = ["goal", "constraint", "precondition", "verified_fact", "tool_evidence", "consent", "commitment", "risk", "open_question", "completed_action"]
PRIMARY = ["goal", "constraint", "verified_fact", "consent", "commitment", "risk", "open_question", "completed_action"]
STATUSES = ["known", "unknown", "contradicted", "not_applicable"]
CRITICALITIES = ["safety", "terminal", "efficiency", "context"]
CRITICAL = ["safety", "terminal"]
# How causes of failed runs are told, by type and by the beginning or a part of the message.
PARSE_TYPE = "JSONDecodeError"
STAGE_PREFIXES = [("source transfer is not valid JSON", "source_transfer_parse"), ("receiver_state ", "receiver_state_validation"), ("receiver selected action outside visible catalog", "receiver_action_validation")]
OTHER_STAGE = "other_model_output_or_validation"
INFRASTRUCTURE_TYPES = ["URLError", "TimeoutError", "ConnectionError"]
INFRASTRUCTURE_PARTS = ["connection refused", "connection reset", "enginecore", "http 5", "out of memory", "cuda oom"]


def _table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def _submissions(spark: SparkSession, path: str) -> DataFrame:
    """The latest submission of each annotator and task, labels as spelled by the project."""
    kept = F.struct("claims", "action_sequence", "irreversible_args_inferable", "catalog_leakage_flag")
    latest = (
        _table(spark, path, "annotations").select(spelled("annotator_id").alias("annotator"), "task_id", kept.alias("kept"), F.struct("submitted_at", "received_at", "annotation_id").alias("age"))
        .filter("annotator is not null and task_id is not null").groupBy("annotator", "task_id").agg(F.max_by("kept", "age").alias("k"))
    )
    claims = F.transform("k.claims", lambda c: F.struct(c["key"].alias("key"), spelled(c["category"]).alias("category"), spelled(c["status"]).alias("status"), c["value_json"].alias("value_json"), c["criticality"].alias("criticality"), c["provenance"].alias("provenance")))
    actions = F.array_join(F.transform("k.action_sequence", lambda x: F.concat_ws(":", x["name"], x["arguments_json"])), "|")
    return latest.select("annotator", "task_id", claims.alias("claims"), actions.alias("actions"), F.col("k.irreversible_args_inferable").alias("inferable"), F.col("k.catalog_leakage_flag").alias("leakage"))


def agreement_full(spark: SparkSession, path: str) -> DataFrame:
    """Every measure of agreement of every pair of annotators."""
    out = scoring.full_agreement(_submissions(spark, path))
    rates = [c for c in out.columns if c.endswith(("_rate", "_f1"))]
    return out.select(*[c for c in out.columns if c not in rates], *[rounded(F.col(c)).alias(c) for c in rates])


def _states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Each annotator's claims as predictions against those of every annotator with a smaller name on the same task."""
    flat = _submissions(spark, path).select("annotator", "task_id", F.inline("claims")).filter("key is not null and category is not null")
    did = flat.select("annotator", "task_id").distinct()
    pairs = did.withColumnRenamed("annotator", "gold_by").join(did.withColumnRenamed("annotator", "pred_by"), "task_id").filter("gold_by < pred_by")
    columns = ["gold_by", "pred_by", "task_id", "category", "key", "status", "value_json"]
    gold = flat.withColumnRenamed("annotator", "gold_by").join(pairs, ["gold_by", "task_id"]).select(*columns, F.col("criticality").isin(*CRITICAL).alias("critical"))
    return gold, flat.withColumnRenamed("annotator", "pred_by").join(pairs, ["pred_by", "task_id"]).select(*columns)


def receiver_scores(spark: SparkSession, path: str) -> DataFrame:
    """Macro F1 over fields and critical errors of all pairs of annotators, summed over their tasks."""
    unit = ["gold_by", "pred_by", "task_id"]
    macro = scoring.macro_scores(scoring.field_scores(*_states(spark, path), unit, "category"), unit)
    return macro.groupBy("gold_by", "pred_by").agg(F.count("*").alias("n_tasks"), rounded(F.avg("macro_f1")).alias("macro_f1"), F.sum("critical_errors").alias("critical_errors"))


def field_recall(spark: SparkSession, path: str) -> DataFrame:
    """Precision and recall of each category over all pairs of annotators and tasks."""
    fields = scoring.field_scores(*_states(spark, path), ["gold_by", "pred_by", "task_id"], "category")
    return fields.groupBy("category").agg(F.count("*").alias("n"), rounded(F.avg("precision")).alias("precision"), rounded(F.avg("recall")).alias("recall"), F.sum("n_gold").alias("n_gold"), F.sum("n_predicted").alias("n_predicted"))


def rate_strata(spark: SparkSession, path: str) -> DataFrame:
    runs = design.run_metrics(_table(spark, path, "pilot_runs"), "method", "seed")
    out = scoring.strata(runs, ["method", "seed"], "strict_success", "macro_state_f1")
    return out.select("method", "seed", "n", "hits", *[rounded(F.col(c)).alias(c) for c in ("rate", "ci_low", "ci_high", "expected")])


def overlap_signals(spark: SparkSession, path: str) -> DataFrame:
    """Seven signals of task records that evaluation splits share with the training split."""
    texts = F.array_join(F.transform("trace", lambda e: F.coalesce(e["content"], F.lit(""))), chr(10))
    tools = F.array_join(F.transform("trace", lambda e: F.coalesce(e["tool"], F.lit("-"))), ">")
    family, pool = spelled("template_family"), spelled("entity_pool")
    signals = {
        "seed": F.col("generator_seed"), "family": family, "pool": pool, "family_and_pool": F.when(family.isNotNull() & pool.isNotNull(), F.concat_ws("|", family, pool)), "trace": F.sha2(texts, 256),
        "normal_trace": F.sha2(F.regexp_replace(F.lower(texts), "[0-9]+", "0"), 256), "tool_graph": tools,
    }
    return scoring.signal_overlaps(_table(spark, path, "task_records").withColumn("split", spelled("split_name")), "split", signals)


def failure_causes(spark: SparkSession, path: str) -> DataFrame:
    """Runs that aren't ok by the stage that their error shows and by whether the infrastructure failed."""
    runs = _table(spark, path, "pilot_runs").filter(~F.coalesce(F.lower("status") == "ok", F.lit(False)))
    message, kind = F.coalesce("error.message", F.lit("")), F.coalesce("error.type", F.lit(""))
    rules = [(F.startswith(message, F.lit(p)), name) for p, name in STAGE_PREFIXES]
    stage = scoring.first_rule(OTHER_STAGE, [rules[0], (kind == PARSE_TYPE, "receiver_output_parse"), *rules[1:]])
    parts = [F.contains(F.lower(message), F.lit(p)) for p in INFRASTRUCTURE_PARTS]
    infra = kind.isin(*INFRASTRUCTURE_TYPES)
    for part in parts:
        infra = infra | part
    return runs.groupBy(stage.alias("stage"), F.coalesce("error.type", F.lit("missing_error_type")).alias("error_type"), infra.alias("infrastructure")).agg(F.count("*").alias("n"))


def annotation_rules(spark: SparkSession, path: str) -> DataFrame:
    """Validation rules of annotation submissions: one scan for the rules of a row, one join for references into the trace."""
    rows = _table(spark, path, "annotations")
    claims = F.coalesce("claims", F.array())
    keys = F.transform(claims, lambda c: c["key"])
    every = lambda test: F.forall(claims, test)
    rules = {
        "annotator_named": (spelled("annotator_id").isNotNull(), F.col("annotator_id")), "claims_present": (F.size(claims) > 0, F.size(claims)),
        "keys_present": (every(lambda c: c["key"].isNotNull()), F.size(claims)), "keys_unique": (F.size(F.array_distinct(keys)) == F.size(keys), F.size(keys)),
        "category_known": (every(lambda c: F.coalesce(spelled(c["category"]).isin(*CATEGORIES), F.lit(False))), F.size(claims)), "status_known": (every(lambda c: F.coalesce(spelled(c["status"]).isin(*STATUSES), F.lit(False))), F.size(claims)),
        "criticality_known": (every(lambda c: F.coalesce(c["criticality"].isin(*CRITICALITIES), F.lit(False))), F.size(claims)), "value_present": (every(lambda c: c["value_json"].isNotNull()), F.size(claims)),
        "provenance_present": (every(lambda c: F.coalesce(F.size(c["provenance"]) > 0, F.lit(False))), F.size(claims)), "actions_present": (F.coalesce(F.size("action_sequence") > 0, F.lit(False)), F.size("action_sequence")),
        "received_after_submitted": (F.col("received_at") >= F.col("submitted_at"), F.col("received_at")),
    }
    pointers = rows.select("annotation_id", "task_id", F.explode("claims").alias("c")).select("annotation_id", "task_id", F.explode("c.provenance.trace_id").alias("trace_id"))
    known = _table(spark, path, "task_records").select("task_id", F.explode("trace.trace_id").alias("trace_id")).distinct()
    loose = pointers.filter("trace_id is not null").join(known, ["task_id", "trace_id"], "left_anti").select("annotation_id").distinct()
    dangling = loose.select(F.lit("pointers_resolve").alias("rule_id"), F.col("annotation_id").cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))
    return constraints.audit(constraints.row_rules(rows, "annotation_id", rules).unionByName(dangling), [*rules, "pointers_resolve"])


def output_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """Parsed answers by whether they have exactly the contract's keys, and an object as state."""
    rows = _table(spark, path, "run_artifacts").select("parsed_output", F.array_join(F.array_sort(F.json_object_keys("parsed_output")), ",").alias("names"))
    state = F.get_json_object("parsed_output", "$.receiver_state")
    verdict = F.when(F.col("parsed_output").isNull(), "missing").when(F.col("names").isNull(), "no_object").when(F.col("names") != "action,receiver_state", "keys").when(~F.coalesce(F.startswith(state, F.lit("{")), F.lit(False)), "state").otherwise("ok")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def task_flags(spark: SparkSession, path: str) -> DataFrame:
    """Each task of the records with flags of where else it occurs."""
    out = _table(spark, path, "task_records").select("task_id").distinct()
    for name in ("packets", "prompts", "annotations", "pilot_runs"):
        out = out.join(_table(spark, path, name).select("task_id").filter("task_id is not null").distinct().withColumn(f"in_{name}", F.lit(True)), "task_id", "left")
    return out.select("task_id", *[F.coalesce(f"in_{n}", F.lit(False)).alias(f"in_{n}") for n in ("packets", "prompts", "annotations", "pilot_runs")])


def sets_equal(spark: SparkSession, path: str) -> DataFrame:
    """Whether tables cover the same tasks: both differences empty."""
    tasks = {n: _table(spark, path, n).select("task_id").filter("task_id is not null").distinct() for n in ("task_records", "packets", "annotations")}
    out = None
    for a, b in (("task_records", "packets"), ("task_records", "annotations"), ("annotations", "annotations")):
        both = tasks[a].withColumn("a", F.lit(True)).join(tasks[b].withColumn("b", F.lit(True)), "task_id", "full_outer")
        one = both.agg(F.lit(a).alias("left_set"), F.lit(b).alias("right_set"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("n_different"))
        out = one if out is None else out.unionAll(one)
    return out.withColumn("equal", F.col("n_different") == 0)


def any_error(spark: SparkSession, path: str) -> DataFrame:
    """1 for users with any error among their events, else 0."""
    return _table(spark, path, "events").groupBy("user_id").agg(F.coalesce(F.bool_or(F.col("event_type") == "error"), F.lit(False)).cast("int").alias("any_error"))


def state_slots(spark: SparkSession, path: str) -> DataFrame:
    """Per annotation: its primary claims that aren't derived, listed in the order of category and key; and its sorted action catalogue."""
    place = F.create_map(*[F.lit(x) for n, c in enumerate(CATEGORIES) for x in (c, n)])
    category = lambda c: spelled(c["category"])
    primary = F.filter(F.coalesce("claims", F.array()), lambda c: F.coalesce(category(c).isin(*PRIMARY), F.lit(False)) & c["key"].isNotNull() & ~F.startswith(c["key"], F.lit("derived:")))
    listed = F.array_sort(F.transform(primary, lambda c: F.struct(F.try_element_at(place, category(c)).alias("at"), c["key"].alias("key"), category(c).alias("slot"))))
    catalogue = F.array_sort(F.transform(F.coalesce("action_sequence", F.array()), lambda a: F.struct(F.coalesce(a["name"], F.lit("")).alias("name"), F.coalesce(a["arguments_json"], F.lit("")).alias("arguments"))))
    return _table(spark, path, "annotations").select(
        "annotation_id", F.array_join(F.transform(listed, lambda x: F.concat_ws(":", x["slot"], x["key"])), ",").alias("slots"), F.array_join(F.transform(catalogue, lambda x: F.concat(x["name"], x["arguments"])), ";").alias("catalogue")
    )


QUERIES = {f.__name__: f for f in (
    agreement_full, receiver_scores, field_recall, rate_strata, overlap_signals, failure_causes, annotation_rules, output_verdicts, task_flags, sets_equal, any_error, state_slots,
)}


def _among(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


_LATEST = f"""
    n AS (SELECT {_spelled('annotator_id')} AS annotator, task_id, claims, list_transform(action_sequence, lambda x: concat_ws(':', x.name, x.arguments_json)) AS acts, irreversible_args_inferable AS inferable, catalog_leakage_flag AS leakage,
        row_number() OVER (PARTITION BY {_spelled('annotator_id')}, task_id ORDER BY submitted_at DESC, received_at DESC, annotation_id DESC) AS k FROM annotations),
    s AS (SELECT annotator, task_id, claims, array_to_string(acts, '|') AS actions, inferable, leakage FROM n WHERE k = 1 AND annotator IS NOT NULL AND task_id IS NOT NULL),
    u AS (SELECT annotator, task_id, unnest(claims) AS c FROM s),
    f AS (SELECT annotator, task_id, c.key AS key, {_spelled('c.category')} AS category, {_spelled('c.status')} AS status, c.value_json AS value_json, c.criticality AS criticality,
        list_distinct(list_transform(coalesce(c.provenance, []), lambda x: concat_ws('|', x.trace_id, x.source_type, x.field_path))) AS pointers FROM u WHERE c.key IS NOT NULL)"""
_SHARE = "CASE WHEN len({x}) = 0 THEN cast(len({y}) = 0 AS double) ELSE len(list_intersect({x}, {y}))::DOUBLE / len({x}) END"
_LIST = "CASE WHEN trim({v}) LIKE '[%' THEN list_distinct(from_json({v}, '[\"VARCHAR\"]')) END"
_FIELDS = f"""{_LATEST},
    l AS (SELECT *, {_LIST.format(v='value_json')} AS items FROM f WHERE category IS NOT NULL),
    did AS (SELECT DISTINCT annotator, task_id FROM l), pairs AS (SELECT a.annotator AS gold_by, b.annotator AS pred_by, task_id FROM did a JOIN did b USING (task_id) WHERE a.annotator < b.annotator),
    g AS (SELECT gold_by, pred_by, l.task_id AS task_id, category, key, status, value_json, items, coalesce(criticality IN ({_among(CRITICAL)}), false) AS critical FROM pairs JOIN l ON l.annotator = gold_by AND l.task_id = pairs.task_id),
    p AS (SELECT gold_by, pred_by, l.task_id AS task_id, category, key, status, value_json, items FROM pairs JOIN l ON l.annotator = pred_by AND l.task_id = pairs.task_id),
    e AS (SELECT g.*, CASE WHEN g.status IS DISTINCT FROM p.status THEN 0 WHEN g.items IS NOT NULL AND p.items IS NOT NULL THEN {_SHARE.format(x='g.items', y='p.items')} ELSE cast(trim(g.value_json) IS NOT DISTINCT FROM trim(p.value_json) AS double) END AS forth,
        CASE WHEN g.status IS DISTINCT FROM p.status THEN 0 WHEN g.items IS NOT NULL AND p.items IS NOT NULL THEN {_SHARE.format(x='p.items', y='g.items')} ELSE cast(trim(g.value_json) IS NOT DISTINCT FROM trim(p.value_json) AS double) END AS back
        FROM g JOIN p ON g.gold_by = p.gold_by AND g.pred_by = p.pred_by AND g.task_id = p.task_id AND g.category = p.category AND g.key = p.key),
    gs AS (SELECT gold_by, pred_by, task_id, category, count(*) AS n_gold, sum(critical::int) AS n_critical FROM g GROUP BY ALL), ps AS (SELECT gold_by, pred_by, task_id, category, count(*) AS n_predicted FROM p GROUP BY ALL),
    es AS (SELECT gold_by, pred_by, task_id, category, sum(forth) AS forth, sum(back) AS back, count(*) FILTER (critical AND forth >= 1) AS met FROM e GROUP BY ALL),
    fs AS (SELECT gold_by, pred_by, task_id, category, coalesce(n_gold, 0) AS n_gold, coalesce(n_predicted, 0) AS n_predicted, coalesce(n_critical, 0) - coalesce(met, 0) AS critical_errors,
        CASE WHEN coalesce(n_predicted, 0) > 0 THEN coalesce(back, 0) / n_predicted ELSE 0.0::DOUBLE END AS precision, CASE WHEN coalesce(n_gold, 0) > 0 THEN coalesce(forth, 0) / n_gold ELSE 1.0::DOUBLE END AS recall
        FROM gs FULL JOIN ps USING (gold_by, pred_by, task_id, category) LEFT JOIN es USING (gold_by, pred_by, task_id, category))"""
_ANNOTATION_RULES = {
    "annotator_named": f"{_spelled('annotator_id')} IS NOT NULL", "claims_present": "len(cl) > 0", "keys_present": "len(list_filter(cl, lambda c: c.key IS NULL)) = 0",
    "keys_unique": "(SELECT count(DISTINCT coalesce(k, chr(1))) FROM (SELECT unnest(list_transform(cl, lambda c: c.key)) AS k)) = len(cl)",
    "category_known": f"len(list_filter(cl, lambda c: coalesce({_spelled('c.category')} IN ({_among(CATEGORIES)}), false))) = len(cl)", "status_known": f"len(list_filter(cl, lambda c: coalesce({_spelled('c.status')} IN ({_among(STATUSES)}), false))) = len(cl)",
    "criticality_known": f"len(list_filter(cl, lambda c: coalesce(c.criticality IN ({_among(CRITICALITIES)}), false))) = len(cl)", "value_present": "len(list_filter(cl, lambda c: c.value_json IS NULL)) = 0",
    "provenance_present": "len(list_filter(cl, lambda c: coalesce(len(c.provenance), 0) = 0)) = 0", "actions_present": "coalesce(len(action_sequence), 0) > 0", "received_after_submitted": "received_at >= submitted_at",
}
_SIGNALS = {
    "seed": "cast(generator_seed AS varchar)", "family": "family", "pool": "pool", "family_and_pool": "family || '|' || pool", "trace": "sha256(array_to_string(texts, chr(10)))",
    "normal_trace": "sha256(regexp_replace(lower(array_to_string(texts, chr(10))), '[0-9]+', '0', 'g'))", "tool_graph": "array_to_string(tools, '>')",
}

ORACLES: dict[str, str] = {
    "agreement_full": f"""
        WITH {_LATEST},
        t AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, count(*) AS n_tasks, avg(cast(a.actions IS NOT DISTINCT FROM b.actions AS int)) AS action_rate, avg(cast(a.inferable IS NOT DISTINCT FROM b.inferable AS int)) AS inferable_rate,
            avg(cast(a.leakage IS NOT DISTINCT FROM b.leakage AS int)) AS leakage_rate, cast(sum(coalesce(len(list_filter(a.claims, lambda c: c.key IS NOT NULL)), 0)) AS bigint) AS n_a, cast(sum(coalesce(len(list_filter(b.claims, lambda c: c.key IS NOT NULL)), 0)) AS bigint) AS n_b
            FROM s a JOIN s b USING (task_id) WHERE a.annotator < b.annotator GROUP BY ALL),
        m AS (SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, a.category IS NOT DISTINCT FROM b.category AS c1, a.status IS NOT DISTINCT FROM b.status AS c2, a.value_json IS NOT DISTINCT FROM b.value_json AS c3, a.criticality IS NOT DISTINCT FROM b.criticality AS c4,
            len(list_intersect(a.pointers, b.pointers)) AS pp, len(a.pointers) AS pa, len(b.pointers) AS pb FROM f a JOIN f b USING (task_id, key) WHERE a.annotator < b.annotator),
        x AS (SELECT annotator_a, annotator_b, count(*) AS n_matched, count(*) FILTER (c1 AND c2 AND c3) AS exact, avg(c1::int) AS r1, avg(c2::int) AS r2, avg(c3::int) AS r3, avg(c4::int) AS r4, cast(sum(pp) AS bigint) AS tp, cast(sum(pa) AS bigint) AS pa, cast(sum(pb) AS bigint) AS pb,
            count(*) FILTER (pp = pa AND pp = pb) AS eq FROM m GROUP BY 1, 2)
        SELECT annotator_a, annotator_b, n_tasks, n_a, n_b, coalesce(n_matched, 0) AS n_matched, coalesce(exact, 0) AS exact, coalesce(tp, 0) AS pointer_tp, coalesce(pa, 0) AS pointer_a, coalesce(pb, 0) AS pointer_b, coalesce(eq, 0) AS equal_pointer_sets,
            round(coalesce(2 * exact::DOUBLE / nullif(n_a + n_b, 0), 0), 8) AS claim_f1, round(coalesce(2 * tp::DOUBLE / nullif(pa + pb, 0), 0), 8) AS pointer_f1, round(r1, 8) AS category_rate, round(r2, 8) AS status_rate, round(r3, 8) AS value_json_rate, round(r4, 8) AS criticality_rate,
            round(action_rate, 8) AS action_rate, round(inferable_rate, 8) AS inferable_rate, round(leakage_rate, 8) AS leakage_rate
        FROM t LEFT JOIN x USING (annotator_a, annotator_b)""",
    "receiver_scores": f"""
        WITH {_FIELDS}, v AS (SELECT gold_by, pred_by, task_id, coalesce(avg(CASE WHEN n_gold > 0 THEN CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END END), 1) AS macro, sum(critical_errors) AS ce FROM fs GROUP BY ALL)
        SELECT gold_by, pred_by, count(*) AS n_tasks, round(avg(macro), 8) AS macro_f1, cast(sum(ce) AS bigint) AS critical_errors FROM v GROUP BY 1, 2""",
    "field_recall": f"WITH {_FIELDS} SELECT category, count(*) AS n, round(avg(precision), 8) AS precision, round(avg(recall), 8) AS recall, cast(sum(n_gold) AS bigint) AS n_gold, cast(sum(n_predicted) AS bigint) AS n_predicted FROM fs GROUP BY 1",
    "rate_strata": f"""
        WITH r AS ({RUNS_SQL}), g AS (SELECT method, seed, count(*) AS n, cast(sum(strict_success) AS bigint) AS hits, sum(strict_success)::DOUBLE AS s, avg(macro_state_f1) AS expected FROM r GROUP BY 1, 2)
        SELECT method, seed, n, hits, round(s / n, 8) AS rate, {WILSON_SQL.format(sign='-')} AS ci_low, {WILSON_SQL.format(sign='+')} AS ci_high, round(expected, 8) AS expected FROM g""",
    "overlap_signals": f"""
        WITH b AS (SELECT {_spelled('split_name')} AS split, generator_seed, {_spelled('template_family')} AS family, {_spelled('entity_pool')} AS pool, list_transform(trace, lambda e: coalesce(e.content, '')) AS texts,
            list_transform(trace, lambda e: coalesce(e.tool, '-')) AS tools FROM task_records),
        v AS ({' UNION ALL '.join(f"SELECT split, '{n}' AS signal, {sql} AS value FROM b WHERE split IS NOT NULL" for n, sql in _SIGNALS.items())}),
        t AS (SELECT signal, value, count(*) AS n FROM v WHERE split = 'train' AND value IS NOT NULL GROUP BY 1, 2)
        SELECT split, v.signal AS signal, count(*) AS n_records, count(t.n) AS n_overlapping, cast(coalesce(sum(t.n), 0) AS bigint) AS n_pairs FROM v LEFT JOIN t ON v.signal = t.signal AND v.value = t.value WHERE split <> 'train' GROUP BY 1, 2""",
    "failure_causes": f"""
        WITH r AS (SELECT coalesce(error.message, '') AS m, coalesce(error.type, '') AS t, error.type AS raw FROM pilot_runs WHERE NOT coalesce(lower(status) = 'ok', false))
        SELECT CASE WHEN starts_with(m, '{STAGE_PREFIXES[0][0]}') THEN '{STAGE_PREFIXES[0][1]}' WHEN t = '{PARSE_TYPE}' THEN 'receiver_output_parse' WHEN starts_with(m, '{STAGE_PREFIXES[1][0]}') THEN '{STAGE_PREFIXES[1][1]}'
            WHEN starts_with(m, '{STAGE_PREFIXES[2][0]}') THEN '{STAGE_PREFIXES[2][1]}' ELSE '{OTHER_STAGE}' END AS stage, coalesce(raw, 'missing_error_type') AS error_type,
            t IN ({_among(INFRASTRUCTURE_TYPES)}) OR {' OR '.join(f"contains(lower(m), '{p}')" for p in INFRASTRUCTURE_PARTS)} AS infrastructure, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "annotation_rules": f"""
        WITH a AS (SELECT *, coalesce(claims, []) AS cl FROM annotations),
        q AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule_id, count(*) AS n FROM a WHERE NOT coalesce({sql}, false)" for n, sql in _ANNOTATION_RULES.items())}
            UNION ALL SELECT 'pointers_resolve', count(DISTINCT annotation_id) FROM (SELECT annotation_id, task_id, p.trace_id AS trace_id FROM (SELECT annotation_id, task_id, unnest(c.provenance) AS p FROM (SELECT annotation_id, task_id, unnest(claims) AS c FROM annotations))) x
                WHERE trace_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT task_id, unnest(trace).trace_id AS trace_id FROM task_records) k WHERE k.task_id = x.task_id AND k.trace_id = x.trace_id))
        SELECT rule_id, n AS n_violations, n = 0 AS passed FROM q""",
    "output_verdicts": """
        WITH r AS (SELECT parsed_output AS o, CASE WHEN json_type(parsed_output) = 'OBJECT' THEN array_to_string(list_sort(json_keys(parsed_output)), ',') END AS names FROM run_artifacts)
        SELECT CASE WHEN o IS NULL THEN 'missing' WHEN names IS NULL THEN 'no_object' WHEN names <> 'action,receiver_state' THEN 'keys' WHEN coalesce(json_type(o, '$.receiver_state'), '') <> 'OBJECT' THEN 'state' ELSE 'ok' END AS verdict, count(*) AS n FROM r GROUP BY 1""",
    "task_flags": "SELECT task_id, " + ", ".join(f"task_id IN (SELECT task_id FROM {n} WHERE task_id IS NOT NULL) AS in_{n}" for n in ("packets", "prompts", "annotations", "pilot_runs")) + " FROM (SELECT DISTINCT task_id FROM task_records)",
    "sets_equal": " UNION ALL ".join(
        f"SELECT '{a}' AS left_set, '{b}' AS right_set, n AS n_different, n = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT task_id FROM {a} WHERE task_id IS NOT NULL EXCEPT SELECT task_id FROM {b}))"
        f" + (SELECT count(*) FROM (SELECT task_id FROM {b} WHERE task_id IS NOT NULL EXCEPT SELECT task_id FROM {a})) AS n)"
        for a, b in (("task_records", "packets"), ("task_records", "annotations"), ("annotations", "annotations"))
    ),
    "any_error": "SELECT user_id, cast(coalesce(bool_or(event_type = 'error'), false) AS int) AS any_error FROM events GROUP BY 1",
    "state_slots": f"""
        WITH a AS (SELECT annotation_id, unnest(claims) AS c FROM annotations), b AS (SELECT annotation_id, {_spelled('c.category')} AS slot, c.key AS key FROM a),
        s AS (SELECT annotation_id, string_agg(slot || ':' || key, ',' ORDER BY list_position({CATEGORIES}, slot), key) AS slots FROM b WHERE slot IN ({_among(PRIMARY)}) AND key IS NOT NULL AND NOT starts_with(key, 'derived:') GROUP BY 1),
        x AS (SELECT annotation_id, unnest(action_sequence) AS a FROM annotations), y AS (SELECT annotation_id, string_agg(coalesce(a.name, '') || coalesce(a.arguments_json, ''), ';' ORDER BY coalesce(a.name, ''), coalesce(a.arguments_json, '')) AS catalogue FROM x GROUP BY 1)
        SELECT annotation_id, coalesce(slots, '') AS slots, coalesce(catalogue, '') AS catalogue FROM annotations LEFT JOIN s USING (annotation_id) LEFT JOIN y USING (annotation_id)""",
}
