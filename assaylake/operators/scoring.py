"""Scores of predicted against reference state per field, full agreement of annotators, strata of rates, and overlap signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.operators.inference import wilson
from assaylake.operators.matching import best_matches


def _items(value: str) -> Column:
    """The items of a JSON list, or null for any other value."""
    return F.when(F.startswith(F.trim(value), F.lit("[")), F.array_distinct(F.from_json(value, "array<string>")))


def overlap(a: str, b: str) -> Column:
    """The share of a's items that b holds, for two JSON lists; else 1 for equal texts (also null and null) and 0 for others."""
    x, y = _items(a), _items(b)
    share = F.when(F.size(x) == 0, (F.size(y) == 0).cast("double")).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))
    return F.when(x.isNotNull() & y.isNotNull(), share).otherwise(F.trim(a).eqNullSafe(F.trim(b)).cast("double"))


def field_scores(gold: DataFrame, predicted: DataFrame, unit: list[str], field: str) -> DataFrame:
    """unit, field, tp, n_predicted, n_gold, precision, recall, f1, critical_errors: exact matching inside each field.

    gold: unit, field, key, status, value_json, critical (boolean); predicted: the same without critical. Claims match inside
    one field and key; several of a key are assigned one to one for the largest overlap both ways. Predictions that match
    nothing are false positives. A critical claim is an error unless some prediction of its key is wholly equal.
    """
    g = gold.select(*unit, field, "key", F.col("status").alias("g_status"), F.col("value_json").alias("g_value"), F.coalesce("critical", F.lit(False)).alias("critical"), F.monotonically_increasing_id().alias("g_no"))
    p = predicted.select(*unit, field, "key", F.col("status").alias("p_status"), F.col("value_json").alias("p_value"), F.monotonically_increasing_id().alias("p_no"))
    same = F.col("g_status").eqNullSafe(F.col("p_status")).cast("double")
    edges = g.join(p, [*unit, field, "key"]).select(*unit, field, "key", "g_no", "p_no", "critical", (same * overlap("g_value", "p_value")).alias("forth"), (same * overlap("p_value", "g_value")).alias("back"))
    edges = edges.withColumn("edge", F.col("forth") + F.col("back"))
    chosen = best_matches(edges, [*unit, field, "key"], "g_no", "p_no", "edge").join(edges.select("g_no", "p_no", "forth", "back"), ["g_no", "p_no"])
    hits = chosen.groupBy(*unit, field).agg(F.sum("forth").alias("tp"), F.sum("back").alias("tp_predicted"))
    met = edges.filter("critical and forth >= 1").groupBy(*unit, field).agg(F.count_distinct("g_no").alias("met"))
    sizes = g.groupBy(*unit, field).agg(F.count("*").alias("n_gold"), F.sum(F.col("critical").cast("long")).alias("n_critical")).join(p.groupBy(*unit, field).agg(F.count("*").alias("n_predicted")), [*unit, field], "full_outer")
    out = sizes.join(hits, [*unit, field], "left").join(met, [*unit, field], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    precision = F.when(zero("n_predicted") > 0, zero("tp_predicted") / zero("n_predicted")).otherwise(F.when(zero("n_gold") > 0, 0.0).otherwise(1.0))
    recall = F.when(zero("n_gold") > 0, zero("tp") / zero("n_gold")).otherwise(1.0)
    scored = out.select(*unit, field, zero("tp").cast("double").alias("tp"), zero("n_predicted").alias("n_predicted"), zero("n_gold").alias("n_gold"), precision.alias("precision"), recall.alias("recall"), (zero("n_critical") - zero("met")).alias("critical_errors"))
    return scored.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def macro_scores(fields: DataFrame, unit: list[str]) -> DataFrame:
    """unit, n_fields, macro_f1 (over the fields with gold claims; 1 if there is none), critical_errors of field_scores."""
    scored = F.when(F.col("n_gold") > 0, F.col("f1"))
    return fields.groupBy(*unit).agg(F.count(scored).alias("n_fields"), F.coalesce(F.avg(scored), F.lit(1.0)).alias("macro_f1"), F.sum("critical_errors").alias("critical_errors"))


#: Claim fields whose agreement is counted over the claims that both made.
CLAIM_FIELDS = ("category", "status", "value_json", "criticality")


def full_agreement(submissions: DataFrame) -> DataFrame:
    """annotator_a, annotator_b and all counts and rates of agreement of every pair of annotators on the tasks that both did.

    submissions: annotator, task_id, claims (one per key), actions (text), inferable, leakage; one row per annotator and task.
    Rates of claim fields are over claims of the same key; pointers are compared as sets inside those. Null equals null.
    """
    tasks = submissions.select("annotator", "task_id", F.coalesce(F.size(F.filter("claims", lambda c: c["key"].isNotNull())), F.lit(0)).alias("n"), "actions", "inferable", "leakage")
    a, b = (tasks.select(F.col("task_id"), *[F.col(c).alias(f"{c}_{x}") for c in ("annotator", "n", "actions", "inferable", "leakage")]) for x in "ab")
    equal = lambda c: F.avg(F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")).cast("double"))
    pair = ["annotator_a", "annotator_b"]
    both = a.join(b, "task_id").filter("annotator_a < annotator_b")
    by_task = both.groupBy(*pair).agg(
        F.count("*").alias("n_tasks"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), equal("actions").alias("action_rate"), equal("inferable").alias("inferable_rate"), equal("leakage").alias("leakage_rate")
    )
    claims = submissions.select("annotator", "task_id", F.inline("claims")).filter("key is not null")
    pointers = F.array_distinct(F.transform(F.coalesce("provenance", F.array()), lambda x: F.concat_ws("|", x["trace_id"], x["source_type"], x["field_path"])))
    side = lambda x: claims.select("task_id", "key", F.col("annotator").alias(f"annotator_{x}"), *[F.col(f).alias(f"{f}_{x}") for f in CLAIM_FIELDS], pointers.alias(f"pointers_{x}"))
    matched = side("a").join(side("b"), ["task_id", "key"]).filter("annotator_a < annotator_b")
    same = lambda f: F.col(f"{f}_a").eqNullSafe(F.col(f"{f}_b"))
    common = F.size(F.array_intersect("pointers_a", "pointers_b"))
    by_claim = matched.groupBy(*pair).agg(
        F.count("*").alias("n_matched"), F.sum((same("category") & same("status") & same("value_json")).cast("long")).alias("exact"),
        *[F.avg(same(f).cast("double")).alias(f"{f}_rate") for f in CLAIM_FIELDS],
        F.sum(common).alias("pointer_tp"), F.sum(F.size("pointers_a")).alias("pointer_a"), F.sum(F.size("pointers_b")).alias("pointer_b"),
        F.sum(((common == F.size("pointers_a")) & (common == F.size("pointers_b"))).cast("long")).alias("equal_pointer_sets"),
    )
    out = by_task.join(by_claim, pair, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    f1 = lambda tp, m, n: F.coalesce(F.try_divide(2 * zero(tp), zero(m) + zero(n)), F.lit(0.0))
    counts = ("n_matched", "exact", "pointer_tp", "pointer_a", "pointer_b", "equal_pointer_sets")
    return out.select(
        *pair, "n_tasks", "n_a", "n_b", *[zero(c).alias(c) for c in counts], f1("exact", "n_a", "n_b").alias("claim_f1"), f1("pointer_tp", "pointer_a", "pointer_b").alias("pointer_f1"),
        *[f"{f}_rate" for f in CLAIM_FIELDS], "action_rate", "inferable_rate", "leakage_rate",
    )


def strata(rows: DataFrame, by: list[str], hit: str, expected: str) -> DataFrame:
    """by, n, hits, rate, ci_low, ci_high (Wilson), expected (the mean expected rate) of each stratum."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"), F.avg(F.col(expected).cast("double")).alias("expected"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return out.select(*by, "n", "hits", (F.col("hits") / F.col("n")).alias("rate"), low.alias("ci_low"), high.alias("ci_high"), "expected")


def signal_overlaps(records: DataFrame, side: str, signals: dict[str, Column]) -> DataFrame:
    """side, signal, n_records, n_overlapping, n_pairs: for every side but 'train', what its records share with train records.

    One equality join on (signal, value) of values counted before; a value that is null meets nothing.
    """
    stacked = records.select(side, F.inline(F.array(*[F.struct(F.lit(n).alias("signal"), v.cast("string").alias("value")) for n, v in signals.items()])))
    counts = stacked.filter(F.col(side).isNotNull()).groupBy(side, "signal", "value").agg(F.count("*").alias("n"))
    train = counts.filter((F.col(side) == "train") & F.col("value").isNotNull()).select("signal", "value", F.col("n").alias("n_train"))
    met = counts.filter(F.col(side) != "train").join(train, ["signal", "value"], "left")
    hit = F.when(F.col("n_train").isNotNull(), F.col("n")).otherwise(0)
    return met.groupBy(side, "signal").agg(F.sum("n").alias("n_records"), F.sum(hit).alias("n_overlapping"), F.sum(hit * F.coalesce("n_train", F.lit(0))).alias("n_pairs"))


def first_rule(default: str, rules: list[tuple[Column, str]]) -> Column:
    """The name of the first rule whose condition is true."""
    choice = F.lit(default)
    for condition, name in reversed(rules):
        choice = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(choice)
    return choice
