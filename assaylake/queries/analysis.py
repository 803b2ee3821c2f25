"""Run analysis: metrics, roll-ups, contrasts and inference over the run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.functions.columns import rounded, truthy
from assaylake.operators import design, eventlog, inference

# The conditions, states and factors of the run records.
METHODS = ["ehc", "free_form__none__none__advisory", "free_form__provenance__none__advisory", "free_summary", "full_history", "gold_oracle", "structured_payload", "typed__none__checks__enforced", "typed__provenance__checks__advisory"]
STATUSES = ["ok", "error", "timeout", "receiver_output_parse", "receiver_action_validation", "receiver_state_validation", "cancelled"]
STRUCTURED, ORACLE = "structured_payload", "gold_oracle"
STAGES = [("receiver_output_parse", "parse"), ("receiver_state", "state"), ("receiver_action", "action"), ("timeout", "provider"), ("error", "provider")]

RUNS_SQL = """
    SELECT run_id, task_id, model, seed, method, source, status,
        CASE WHEN lower(status) = 'ok' THEN coalesce(cast(success AS int), 0) ELSE 0 END AS strict_success,
        CASE WHEN lower(status) = 'ok' THEN coalesce(metrics.macro_state_f1, 0) ELSE 0 END AS macro_state_f1,
        metrics.critical_errors AS critical_errors,
        cast(coalesce(metrics.input_tokens, list_sum(list_transform(usage, lambda u: coalesce(u.prompt_tokens, 0))), 0) AS bigint) AS input_tokens,
        cast(coalesce(metrics.output_tokens, list_sum(list_transform(usage, lambda u: coalesce(u.completion_tokens, 0))), 0) AS bigint) AS output_tokens
    FROM pilot_runs"""
WILSON_SQL = """round((s / n + 1.96::DOUBLE * 1.96 / (2 * n) {sign} 1.96::DOUBLE * sqrt(s / n * (1 - s / n) / n + 1.96::DOUBLE * 1.96 / (4.0::DOUBLE * n * n))) / (1 + 1.96::DOUBLE * 1.96 / n), 8)"""


def _runs(spark: SparkSession, path: str) -> DataFrame:
    return design.run_metrics(spark.read.parquet(f"{path}/pilot_runs.parquet"), "run_id", "task_id", "model", "seed", "method", "source", "status")


def run_metrics(spark: SparkSession, path: str) -> DataFrame:
    return _runs(spark, path).drop("source")


def rate_rollup_wilson(spark: SparkSession, path: str) -> DataFrame:
    rates = design.rollup_rates(_runs(spark, path), "method", "model", "strict_success")
    low, high = inference.wilson(F.col("n_success"), F.col("n"))
    return rates.withColumn("ci_low", rounded(low)).withColumn("ci_high", rounded(high))


def breakdown_zero_filled(spark: SparkSession, path: str) -> DataFrame:
    counts = spark.read.parquet(f"{path}/pilot_runs.parquet").filter("status is not null").groupBy("status").agg(F.count("*").alias("n"))
    return design.zero_filled(counts, "status", STATUSES)


def non_ok_cuts(spark: SparkSession, path: str) -> DataFrame:
    """Rates of runs that aren't ok by several cuts at once: grouping sets over one scan."""
    bad = (~F.coalesce(F.lower("status") == "ok", F.lit(False))).cast("long")
    cell = lambda name: F.coalesce(F.col(f"config.factorial_cell.{name}"), F.lit("not_applicable")).alias(name)
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet").select(
        F.coalesce("model", F.lit("?")).alias("model"), F.coalesce("method", F.lit("?")).alias("method"), cell("typing"), cell("provenance"), cell("checks"), bad.alias("bad")
    )
    cuts = ["model", "method", "typing", "provenance", "checks"]
    named = [F.when(F.grouping(c) == 0, F.lit(c)) for c in cuts]
    value = F.coalesce(*[F.when(F.grouping(c) == 0, F.col(c)) for c in cuts])
    counts = runs.groupingSets([[c] for c in cuts], *cuts).agg(F.coalesce(*named).alias("cut"), value.alias("value"), F.count("*").alias("n"), F.sum("bad").alias("n_bad"))
    return counts.select("cut", "value", "n", "n_bad", rounded(F.col("n_bad") / F.col("n")).alias("rate"))


def error_stages(spark: SparkSession, path: str) -> DataFrame:
    """Errors by stage: the first prefix of the status that fits, then the message as infrastructure or not."""
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet").filter("status is not null and lower(status) <> 'ok'")
    stage = F.lit("other")
    for prefix, name in reversed(STAGES):
        stage = F.when(F.startswith(F.col("status"), F.lit(prefix)), name).otherwise(stage)
    infra = F.coalesce(F.lower("error.message").rlike("no reply|unexpected end"), F.lit(False))
    return runs.groupBy(stage.alias("stage"), infra.alias("infrastructure")).agg(F.count("*").alias("n"))


def wide_method_pivot(spark: SparkSession, path: str) -> DataFrame:
    wide = design.wide(_runs(spark, path), ["task_id"], "method", METHODS, ["strict_success", "input_tokens"])
    return wide.select("task_id", *[rounded(F.col(f"`{m}_{x}`")).alias(f"{m}_{x}") for m in METHODS for x in ("strict_success", "input_tokens")])


def factorial_effects(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet").filter("config.factorial_cell is not null and model is not null")
    level = lambda name, on: F.when(F.col(f"config.factorial_cell.{name}") == on, 1).otherwise(-1).alias(name)
    cells = design.run_metrics(runs.withColumns({"typing": level("typing", "typed"), "provenance": level("provenance", "provenance"), "checks": level("checks", "checks")}), "model", "typing", "provenance", "checks")
    effects = design.factorial_effects(cells, ["typing", "provenance", "checks"], "strict_success", ["model"])
    return effects.select("model", "term", "n", rounded("effect").alias("effect"))


def paired_contrast(spark: SparkSession, path: str) -> DataFrame:
    pairs = design.paired(_runs(spark, path).filter("model is not null"), ["task_id", "model", "seed"], "method", STRUCTURED, ORACLE, "strict_success")
    return pairs.groupBy("model").agg(F.count("*").alias("n_pairs"), rounded(F.avg("difference")).alias("mean_difference"))


def family_means(spark: SparkSession, path: str) -> DataFrame:
    """The mean over tasks of the tasks' own means, beside the pooled mean."""
    tasks = _runs(spark, path).groupBy("method", "task_id").agg(F.avg("strict_success").alias("mean"), F.sum("strict_success").alias("s"), F.count("*").alias("n"))
    return tasks.groupBy("method").agg(F.count("*").alias("n_tasks"), rounded(F.avg("mean")).alias("mean_of_means"), rounded(F.sum("s") / F.sum("n")).alias("pooled_mean"))


def subgroup_contrasts(spark: SparkSession, path: str) -> DataFrame:
    """Structured against oracle by model, by seed, and by both."""
    pairs = design.paired(_runs(spark, path).filter("model is not null"), ["task_id", "model", "seed"], "method", STRUCTURED, ORACLE, "strict_success")
    strata = pairs.groupingSets([["model"], ["seed"], ["model", "seed"]], "model", "seed")
    return strata.agg(F.count("*").alias("n_pairs"), rounded(F.avg("difference")).alias("mean_difference"))


def model_interaction(spark: SparkSession, path: str) -> DataFrame:
    """Difference in differences of two models, paired on task and seed."""
    pairs = design.paired(_runs(spark, path), ["task_id", "model", "seed"], "method", STRUCTURED, ORACLE, "strict_success")
    both = design.paired(pairs, ["task_id", "seed"], "model", "tessen-24b", "tessen-8b", "difference")
    return both.agg(F.count("*").alias("n_units"), rounded(F.coalesce(F.avg("difference"), F.lit(0.0))).alias("interaction"))


def joint_regression_rate(spark: SparkSession, path: str) -> DataFrame:
    rates = design.joint_incidence(_runs(spark, path), ["task_id", "seed"], "method", ORACLE, [m for m in METHODS if m != ORACLE], "strict_success")
    return rates.select("method", "n_pairs", "n_regressed", rounded("rate").alias("rate"))


def oracle_attach_regret(spark: SparkSession, path: str) -> DataFrame:
    """Each run with its unit's oracle value; null regret without an oracle run that ended ok."""
    runs = _runs(spark, path)
    keys = ["task_id", "seed"]
    oracle = runs.filter((F.col("method") == ORACLE) & (F.lower("status") == "ok")).groupBy(*keys).agg(F.max("macro_state_f1").alias("oracle_f1"))
    return runs.filter(F.col("method") != ORACLE).join(oracle, keys, "left").select("run_id", "oracle_f1", rounded(F.col("oracle_f1") - F.col("macro_state_f1")).alias("regret"))


def cluster_bootstrap_mean(spark: SparkSession, path: str) -> DataFrame:
    out = inference.cluster_bootstrap(_runs(spark, path), "task_id", "strict_success", ["method"])
    return out.select("method", "n_clusters", *[rounded(F.col(c)).alias(c) for c in ("mean", "ci_low", "ci_high")])


def signflip_p(spark: SparkSession, path: str) -> DataFrame:
    pairs = design.paired(_runs(spark, path), ["task_id", "seed"], "method", STRUCTURED, ORACLE, "strict_success")
    out = inference.sign_flip(pairs, "task_id", "difference")
    return out.select("n_clusters", rounded("observed").alias("observed"), rounded("p_value").alias("p_value"))


def _mcnemar_counts(spark: SparkSession, path: str) -> DataFrame:
    runs = _runs(spark, path).filter("model is not null").groupBy("task_id", "model", "seed", "method").agg(F.max("strict_success").alias("y"))
    ref = runs.filter(F.col("method") == ORACLE).select("task_id", "model", "seed", F.col("y").alias("ref"))
    pairs = runs.filter(F.col("method") != ORACLE).join(ref, ["task_id", "model", "seed"])
    return pairs.groupBy("method").agg(F.sum(((F.col("y") == 1) & (F.col("ref") == 0)).cast("long")).alias("left_only"), F.sum(((F.col("y") == 0) & (F.col("ref") == 1)).cast("long")).alias("right_only"))


def mcnemar_exact(spark: SparkSession, path: str) -> DataFrame:
    return _mcnemar_counts(spark, path).withColumn("p_value", rounded(inference.mcnemar(F.col("left_only"), F.col("right_only"))))


def holm_adjust(spark: SparkSession, path: str) -> DataFrame:
    tests = _mcnemar_counts(spark, path).withColumn("p", rounded(inference.mcnemar(F.col("left_only"), F.col("right_only"))))
    return inference.holm(tests, "p", "method").select("method", "p", rounded("p_holm").alias("p_holm"))


def cohen_kappa(spark: SparkSession, path: str) -> DataFrame:
    """The runs' success flag and the metrics' strict success as two raters, per method."""
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet").select("method", F.col("success").cast("int").alias("a"), F.col("metrics.strict_success").cast("int").alias("b"))
    out = inference.kappa(runs, "a", "b", ["method"])
    return out.select("method", "n", *[rounded(F.col(c)).alias(c) for c in ("observed", "expected", "kappa")])


def poisson_binomial_tail(spark: SparkSession, path: str) -> DataFrame:
    """Per model: the chance of at least as many successful methods as seen, from the methods' rates over all models."""
    runs = _runs(spark, path).filter("model is not null")
    rates = runs.groupBy("method").agg(rounded(F.avg("strict_success"), 6).alias("p"))
    own = runs.groupBy("model", "method").agg((F.avg("strict_success") > 0.55).cast("int").alias("hit")).join(rates, "method")
    listed = own.groupBy("model").agg(F.sum("hit").cast("long").alias("observed"), F.transform(F.array_sort(F.collect_list(F.struct("method", "p"))), lambda x: x["p"]).alias("ps"))
    return listed.select("model", "observed", rounded(inference.poisson_binomial_tail(F.col("ps"), F.col("observed"))).alias("tail"))


def schedule_reconcile(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet").select("task_id", "seed", "method")
    due = design.design(runs.select("task_id").distinct(), seed=[0, 1], method=METHODS)
    return design.reconciled(due, runs, ["task_id", "seed", "method"]).groupBy("verdict").agg(F.count("*").alias("n_cells"), F.sum("n_observed").alias("n_runs"))


def block_fairness(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet").filter("config_hash is not null")
    return design.block_audit(runs, ["task_id", "seed"], "method", ["source_hash", "model"])


def first_run(spark: SparkSession, path: str) -> DataFrame:
    runs = spark.read.parquet(f"{path}/pilot_runs.parquet")
    return eventlog.first_by(runs, ["task_id"], ["started_at", "run_id"], "run_id", "status").withColumnRenamed("run_id", "first_run_id")


def usage_totals(spark: SparkSession, path: str) -> DataFrame:
    """Tokens and turns per source, from nested usage."""
    runs = _runs(spark, path)
    return runs.groupBy("source").agg(F.count("*").alias("n_runs"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(truthy("strict_success")).alias("n_success"))


QUERIES = {f.__name__: f for f in (
    run_metrics, rate_rollup_wilson, breakdown_zero_filled, non_ok_cuts, error_stages, wide_method_pivot, factorial_effects, paired_contrast, family_means, subgroup_contrasts,
    model_interaction, joint_regression_rate, oracle_attach_regret, cluster_bootstrap_mean, signflip_p, mcnemar_exact, holm_adjust, cohen_kappa, poisson_binomial_tail, schedule_reconcile,
    block_fairness, first_run, usage_totals,
)}

_MCNEMAR_SQL = f"""
    r AS ({RUNS_SQL}), y AS (SELECT task_id, model, seed, method, max(strict_success) AS y FROM r WHERE model IS NOT NULL GROUP BY ALL),
    c AS (SELECT a.method, cast(sum(cast(a.y = 1 AND b.y = 0 AS int)) AS bigint) AS left_only, cast(sum(cast(a.y = 0 AND b.y = 1 AS int)) AS bigint) AS right_only
        FROM y a JOIN y b USING (task_id, model, seed) WHERE b.method = '{ORACLE}' AND a.method <> '{ORACLE}' GROUP BY 1),
    t AS (SELECT method, left_only, right_only, CASE WHEN left_only + right_only = 0 THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(left_only, right_only) + 1),
        lambda k: exp(lgamma(left_only + right_only + 1) - lgamma(k + 1) - lgamma(left_only + right_only - k + 1) - (left_only + right_only) * ln(2.0::DOUBLE))))), 8) END AS p_value FROM c)"""
_PAIRS_SQL = f"""
    r AS ({RUNS_SQL}), pr AS (SELECT {{unit}}, avg(CASE WHEN method = '{STRUCTURED}' THEN strict_success::DOUBLE END) - avg(CASE WHEN method = '{ORACLE}' THEN strict_success::DOUBLE END) AS difference
        FROM r {{where}} GROUP BY ALL HAVING difference IS NOT NULL)"""
_MODEL_PAIRS = _PAIRS_SQL.format(unit="task_id, model, seed", where="WHERE model IS NOT NULL")

ORACLES: dict[str, str] = {
    "run_metrics": f"SELECT * EXCLUDE (source) FROM ({RUNS_SQL})",
    "rate_rollup_wilson": f"""
        WITH r AS ({RUNS_SQL}), g AS (
            SELECT method, CASE WHEN grouping(m) = 1 THEN 'all' ELSE m END AS model, count(*) AS n, cast(sum(strict_success) AS bigint) AS n_success, sum(strict_success)::DOUBLE AS s
            FROM (SELECT method, coalesce(model, '?') AS m, strict_success FROM r) GROUP BY GROUPING SETS ((method), (method, m)))
        SELECT method, model, n, n_success, {WILSON_SQL.format(sign='-')} AS ci_low, {WILSON_SQL.format(sign='+')} AS ci_high FROM g""",
    "breakdown_zero_filled": f"""
        WITH d AS (SELECT unnest({STATUSES}) AS status UNION SELECT status FROM pilot_runs WHERE status IS NOT NULL)
        SELECT d.status, count(p.run_id) AS n FROM d LEFT JOIN pilot_runs p ON p.status = d.status GROUP BY 1""",
    "non_ok_cuts": """
        WITH r AS (SELECT coalesce(model, '?') AS model, coalesce(method, '?') AS method, coalesce(config.factorial_cell.typing, 'not_applicable') AS typing,
            coalesce(config.factorial_cell.provenance, 'not_applicable') AS provenance, coalesce(config.factorial_cell.checks, 'not_applicable') AS checks,
            CASE WHEN lower(status) = 'ok' THEN 0 ELSE 1 END AS bad FROM pilot_runs),
        u AS (SELECT 'model' AS cut, model AS value, bad FROM r UNION ALL SELECT 'method', method, bad FROM r UNION ALL SELECT 'typing', typing, bad FROM r
            UNION ALL SELECT 'provenance', provenance, bad FROM r UNION ALL SELECT 'checks', checks, bad FROM r)
        SELECT cut, value, count(*) AS n, cast(sum(bad) AS bigint) AS n_bad, round(sum(bad)::DOUBLE / count(*), 8) AS rate FROM u GROUP BY 1, 2""",
    "error_stages": """
        SELECT CASE WHEN starts_with(status, 'receiver_output_parse') THEN 'parse' WHEN starts_with(status, 'receiver_state') THEN 'state' WHEN starts_with(status, 'receiver_action') THEN 'action'
            WHEN starts_with(status, 'timeout') THEN 'provider' WHEN starts_with(status, 'error') THEN 'provider' ELSE 'other' END AS stage,
            coalesce(regexp_matches(lower(error.message), 'no reply|unexpected end'), false) AS infrastructure, count(*) AS n
        FROM pilot_runs WHERE status IS NOT NULL AND lower(status) <> 'ok' GROUP BY 1, 2""",
    "wide_method_pivot": f"WITH r AS ({RUNS_SQL}) SELECT task_id, "
    + ", ".join(f"round(avg(CASE WHEN method = '{m}' THEN {x}::DOUBLE END), 8) AS {m}_{x}" for m in METHODS for x in ("strict_success", "input_tokens"))
    + " FROM r GROUP BY 1",
    "factorial_effects": """
        WITH r AS (SELECT model, CASE WHEN lower(status) = 'ok' THEN coalesce(cast(success AS int), 0) ELSE 0 END::DOUBLE AS y,
            CASE WHEN config.factorial_cell.typing = 'typed' THEN 1 ELSE -1 END AS t, CASE WHEN config.factorial_cell.provenance = 'provenance' THEN 1 ELSE -1 END AS p,
            CASE WHEN config.factorial_cell.checks = 'checks' THEN 1 ELSE -1 END AS c FROM pilot_runs WHERE config.factorial_cell IS NOT NULL AND model IS NOT NULL)
        SELECT model, x.term AS term, count(*) AS n, round(avg(2 * y * x.v), 8) AS effect FROM (
            SELECT model, y, unnest([{'term': 'typing', 'v': t}, {'term': 'provenance', 'v': p}, {'term': 'checks', 'v': c}, {'term': 'typing:provenance', 'v': t * p},
                {'term': 'typing:checks', 'v': t * c}, {'term': 'provenance:checks', 'v': p * c}, {'term': 'typing:provenance:checks', 'v': t * p * c}]) AS x FROM r)
        GROUP BY 1, 2""",
    "paired_contrast": f"WITH {_MODEL_PAIRS} SELECT model, count(*) AS n_pairs, round(avg(difference), 8) AS mean_difference FROM pr GROUP BY 1",
    "family_means": f"""
        WITH r AS ({RUNS_SQL}), t AS (SELECT method, task_id, avg(strict_success) AS m, sum(strict_success) AS s, count(*) AS n FROM r GROUP BY 1, 2)
        SELECT method, count(*) AS n_tasks, round(avg(m), 8) AS mean_of_means, round(sum(s)::DOUBLE / sum(n)::DOUBLE, 8) AS pooled_mean FROM t GROUP BY 1""",
    "subgroup_contrasts": f"WITH {_MODEL_PAIRS} SELECT model, seed, count(*) AS n_pairs, round(avg(difference), 8) AS mean_difference FROM pr GROUP BY GROUPING SETS ((model), (seed), (model, seed))",
    "model_interaction": f"""
        WITH {_PAIRS_SQL.format(unit='task_id, model, seed', where='')}, m AS (
            SELECT task_id, seed, avg(CASE WHEN model = 'tessen-24b' THEN difference END) - avg(CASE WHEN model = 'tessen-8b' THEN difference END) AS d FROM pr GROUP BY 1, 2 HAVING d IS NOT NULL)
        SELECT count(*) AS n_units, round(coalesce(avg(d), 0), 8) AS interaction FROM m""",
    "joint_regression_rate": f"""
        WITH r AS ({RUNS_SQL}), y AS (SELECT task_id, seed, method, max(strict_success) AS y FROM r GROUP BY ALL)
        SELECT a.method, count(*) AS n_pairs, cast(sum(cast(b.y = 1 AND a.y = 0 AS int)) AS bigint) AS n_regressed, round(avg(cast(b.y = 1 AND a.y = 0 AS int)::DOUBLE), 8) AS rate
        FROM y a JOIN y b USING (task_id, seed) WHERE b.method = '{ORACLE}' AND a.method IN ({', '.join(f"'{m}'" for m in METHODS if m != ORACLE)}) GROUP BY 1""",
    "oracle_attach_regret": f"""
        WITH r AS ({RUNS_SQL}), o AS (SELECT task_id, seed, max(macro_state_f1) AS oracle_f1 FROM r WHERE method = '{ORACLE}' AND lower(status) = 'ok' GROUP BY 1, 2)
        SELECT run_id, oracle_f1, round(oracle_f1 - macro_state_f1, 8) AS regret FROM r LEFT JOIN o USING (task_id, seed) WHERE method <> '{ORACLE}'""",
    "cluster_bootstrap_mean": f"""
        WITH r AS ({RUNS_SQL}), s AS (SELECT method, task_id, sum(strict_success)::DOUBLE AS y, count(*) AS n FROM r GROUP BY 1, 2),
        p AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY task_id) - 1 AS place, count(*) OVER (PARTITION BY method) AS clusters FROM s),
        h AS (SELECT d, b, md5(concat_ws(':', 2027, d, b)) AS h FROM range(10000) AS g(d), range((SELECT cast(max(clusters) AS bigint) // 4 + 1 FROM p)) AS q(b)),
        k AS (SELECT method, d AS draw, cast(floor(cast(concat('0x', substr(h, 1 + 8 * (place % 4), 8)) AS bigint) / 4294967296.0::DOUBLE * clusters) AS bigint) AS place FROM p JOIN h ON b = place // 4),
        v AS (SELECT k.method, draw, sum(y) / sum(n)::DOUBLE AS value FROM k JOIN p ON p.method = k.method AND p.place = k.place GROUP BY 1, 2),
        q AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY value, draw) - 1 AS rk FROM v),
        b AS (SELECT method, max(CASE WHEN rk = 250 THEN value END) AS ci_low, max(CASE WHEN rk = 9749 THEN value END) AS ci_high FROM q GROUP BY 1),
        m AS (SELECT method, count(*) AS n_clusters, sum(y) / sum(n)::DOUBLE AS mean FROM s GROUP BY 1)
        SELECT method, n_clusters, round(mean, 8) AS mean, round(ci_low, 8) AS ci_low, round(ci_high, 8) AS ci_high FROM m JOIN b USING (method)""",
    "signflip_p": f"""
        WITH {_PAIRS_SQL.format(unit='task_id, seed', where='')}, m AS (SELECT task_id, avg(difference) AS y FROM pr GROUP BY 1),
        p AS (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS place FROM m), o AS (SELECT count(*) AS n_clusters, avg(y) AS observed FROM m),
        f AS (SELECT count(*) AS n, CASE WHEN count(*) <= 18 THEN 1::BIGINT << least(count(*), 18) ELSE 20000 END AS flips FROM m),
        h AS (SELECT d, b, n, md5(concat_ws(':', 2027, d, b)) AS h FROM range(262144) AS g(d), range((SELECT count(*) // 128 + 1 FROM p)) AS q(b), f WHERE d < flips),
        v AS (SELECT d, avg((CASE WHEN n <= 18 THEN (d >> place) & 1 ELSE (instr('0123456789abcdef', substr(h, cast(1 + (place % 128) // 4 AS int), 1)) - 1) >> cast(3 - place % 4 AS int) & 1 END) * 2 * y - y) AS value
            FROM p JOIN h ON b = place // 128 GROUP BY 1)
        SELECT n_clusters, round(observed, 8) AS observed, round((sum(cast(abs(value) >= abs(observed) - 1e-12 AS int)) + 1)::DOUBLE / (count(*) + 1), 8) AS p_value FROM v, o GROUP BY n_clusters, observed""",
    "mcnemar_exact": f"WITH {_MCNEMAR_SQL} SELECT * FROM t",
    "holm_adjust": f"""
        WITH {_MCNEMAR_SQL}, s AS (SELECT method, p_value AS p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p_value, method) + 1) * p_value) AS step FROM t)
        SELECT method, p, round(max(step) OVER (ORDER BY p, method ROWS UNBOUNDED PRECEDING), 8) AS p_holm FROM s""",
    "cohen_kappa": """
        WITH r AS (SELECT method, cast(success AS int) AS a, metrics.strict_success AS b FROM pilot_runs WHERE success IS NOT NULL AND metrics.strict_success IS NOT NULL),
        n AS (SELECT method, count(*) AS n, avg(cast(a = b AS int)::DOUBLE) AS observed, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM r GROUP BY 1),
        ca AS (SELECT method, a AS l, count(*)::DOUBLE AS x FROM r GROUP BY 1, 2), cb AS (SELECT method, b AS l, count(*)::DOUBLE AS y FROM r GROUP BY 1, 2),
        e AS (SELECT n.method, sum(x * y / (n * n)) AS expected FROM ca JOIN cb USING (method, l) JOIN n USING (method) GROUP BY 1)
        SELECT n.method, n, round(observed, 8) AS observed, round(coalesce(expected, 0), 8) AS expected,
            CASE WHEN ka > 1 AND kb > 1 THEN round((observed - coalesce(expected, 0)) / nullif(1 - coalesce(expected, 0), 0), 8) END AS kappa FROM n LEFT JOIN e USING (method)""",
    "poisson_binomial_tail": f"""
        WITH RECURSIVE r AS (SELECT * FROM ({RUNS_SQL}) WHERE model IS NOT NULL), m AS (SELECT method, round(avg(strict_success), 6) AS p FROM r GROUP BY 1),
        o AS (SELECT model, method, cast(avg(strict_success) > 0.55 AS int) AS hit FROM r GROUP BY 1, 2),
        l AS (SELECT model, cast(sum(hit) AS bigint) AS observed, list(p ORDER BY method) AS ps FROM o JOIN m USING (method) GROUP BY 1),
        d AS (SELECT model, observed, ps, 0 AS i, [1.0::DOUBLE] AS dist FROM l UNION ALL
            SELECT model, observed, ps, i + 1, list_transform(range(i + 2), lambda k: coalesce(dist[k + 1], 0) * (1 - ps[i + 1]) + CASE WHEN k > 0 THEN dist[k] * ps[i + 1] ELSE 0 END) FROM d WHERE i < len(ps))
        SELECT model, observed, round(coalesce(list_sum(dist[observed + 1:]), 0), 8) AS tail FROM d WHERE i = len(ps)""",
    "schedule_reconcile": f"""
        WITH k AS (SELECT task_id, seed, method, count(*) AS n FROM pilot_runs GROUP BY ALL),
        d AS (SELECT DISTINCT task_id, s AS seed, m AS method FROM pilot_runs, (SELECT unnest([0, 1]) AS s), (SELECT unnest({METHODS}) AS m))
        SELECT CASE WHEN d.method IS NULL THEN 'unscheduled' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS verdict, count(*) AS n_cells, cast(sum(coalesce(n, 0)) AS bigint) AS n_runs
        FROM d FULL JOIN k ON d.task_id IS NOT DISTINCT FROM k.task_id AND d.seed IS NOT DISTINCT FROM k.seed AND d.method IS NOT DISTINCT FROM k.method GROUP BY 1""",
    "block_fairness": """
        SELECT task_id, seed, count(*) AS n, count(DISTINCT method) AS levels, count(DISTINCT source_hash) AS source_hash_values, count(DISTINCT model) AS model_values,
            count(*) = count(DISTINCT method) AND count(DISTINCT source_hash) = 1 AND count(DISTINCT model) = 1 AS fair FROM pilot_runs WHERE config_hash IS NOT NULL GROUP BY 1, 2""",
    "first_run": "SELECT task_id, arg_min(run_id, (started_at, run_id)) AS first_run_id, arg_min(status, (started_at, run_id)) AS status FROM pilot_runs GROUP BY 1",
    "usage_totals": f"WITH r AS ({RUNS_SQL}) SELECT source, count(*) AS n_runs, cast(sum(input_tokens) AS bigint) AS input_tokens, cast(sum(output_tokens) AS bigint) AS output_tokens, cast(sum(strict_success) AS bigint) AS n_success FROM r GROUP BY 1",
}
