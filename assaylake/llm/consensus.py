"""Consensus labels, agreement, and annotators' reliability by latent ability and difficulty.

Method: gradient expectation-maximisation. An annotator of ability a on an item of difficulty 1/b labels it rightly with
probability sigmoid(a b); abilities are learned per annotator and true class, around the annotator's mean ability, so that
who always confuses two classes, or always gives one, is told from who errs at random; wrong labels follow the annotator's own
distribution. The expectation step finds label posteriors and each item's b by gradient steps; the maximisation step moves
abilities by Newton's gradient step from sums over all items. Annotators who share their errors (copies) count once where
they agree.

Every pass reads the items in Spark and returns sums per partition; the driver holds parameters per annotator and class only
(annotators x classes^2 numbers; more than MOST_ANNOTATORS raise an error rather than being dropped).

Annotators, categories and statuses are compared without case, outer blanks and separators. Only an annotator's latest
submission of a task counts (ties: later received, then larger id). Null labels and null annotators don't count; of a claim
key that repeats in one submission the first claim counts. Items with fewer than `least` full labels teach but get no row.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.session import materialize

PASSES, LEAST = 16, 3
MOST_ANNOTATORS = 20_000
FIELDS = ("category", "status")
#: Annotators are copies if they share at least this share of at least so many items on which either errs.
COPY_SHARE, COPY_ITEMS = 0.6, 8


def spelled(column: Column | str) -> Column:
    plain = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s_\-]+|[\s_\-]+$", "")), r"[\s_\-]+", "_")
    return F.when(plain != "", plain)


def claim_labels(annotations: DataFrame) -> DataFrame:
    """task_id, claim_key, annotator, category, status of the latest submissions, labels as spelled by the project."""
    latest = (
        annotations.select(spelled("annotator_id").alias("annotator"), "task_id", "claims", F.struct("submitted_at", "received_at", "annotation_id").alias("age"))
        .filter("annotator is not null and task_id is not null")
        .groupBy("annotator", "task_id").agg(F.max_by("claims", "age").alias("claims"))
    )
    claims = latest.select("annotator", "task_id", F.posexplode("claims").alias("place", "claim")).select(
        "annotator", "task_id", "place", F.col("claim.key").alias("claim_key"), spelled("claim.category").alias("category"), spelled("claim.status").alias("status")
    )
    return (
        claims.filter("claim_key is not null and category is not null and status is not null")
        .groupBy("task_id", "claim_key", "annotator")
        .agg(F.min_by(F.struct("category", "status"), "place").alias("label"))
        .select("task_id", "claim_key", "annotator", "label.category", "label.status")
    )


@dataclass
class Model:
    """Parameters of one field: classes, prior, abilities (annotator, class), wrong labels (annotator, class, label)."""

    classes: list[str]
    prior: np.ndarray
    ability: np.ndarray
    wrong: np.ndarray

    @staticmethod
    def first(classes: list[str], annotators: int) -> Model:
        k = len(classes)
        wrong = np.full((annotators, k, k), 1 / max(1, k - 1))
        return Model(classes, np.full(k, 1 / max(1, k)), np.full((annotators, k), 1.0), wrong)

    def step(self, sums: dict[str, np.ndarray]) -> None:
        """One maximisation step from the sums of an expectation pass."""
        right, seen = sums["right"], sums["seen"]
        mean = np.clip(np.log((right.sum(1) + 1.4) / (seen.sum(1) - right.sum(1) + 0.6)), -3, 4)[:, None]
        pull = 1.5
        self.ability = np.clip(self.ability + (sums["slope"] - pull * (self.ability - mean)) / (sums["curve"] + pull), -6, 6)
        k = len(self.classes)
        usual = sums["errors"].sum(1, keepdims=True) + 0.5
        usual = np.broadcast_to(usual, sums["errors"].shape) * (1 - np.eye(k))
        usual = usual / np.maximum(usual.sum(2, keepdims=True), 1e-12)
        wrong = sums["errors"] + 2.0 * usual
        self.wrong = np.maximum(wrong / np.maximum(wrong.sum(2, keepdims=True), 1e-12), 1e-6)
        self.prior = (sums["prior"] + 1) / (sums["prior"] + 1).sum()


def expectation(model: Model, item: np.ndarray, who: np.ndarray, label: np.ndarray, weight: np.ndarray, items: int, steps: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, b) of a block of items; item, who, label and weight describe its labels."""
    k = len(model.classes)
    ability = model.ability[who]
    log_wrong = np.log(model.wrong[who[:, None], np.arange(k)[None, :], label[:, None]])
    is_right = label[:, None] == np.arange(k)[None, :]
    b = np.ones(items)
    for turn in range(steps):
        x = ability * b[item][:, None]
        chance = 1 / (1 + np.exp(-x))
        like = np.where(is_right, -np.logaddexp(0, -x), -np.logaddexp(0, x) + log_wrong) * weight[:, None]
        score = np.log(model.prior)[None, :] + np.stack([np.bincount(item, like[:, c], items) for c in range(k)], 1)
        score -= score.max(1, keepdims=True)
        post = np.exp(score)
        post /= post.sum(1, keepdims=True)
        if turn < steps - 1:
            q = post[item] * weight[:, None]
            slope = np.bincount(item, (q * (is_right - chance) * ability).sum(1), items) * b - np.log(b) / 0.25
            curve = np.bincount(item, (q * chance * (1 - chance) * ability**2).sum(1), items) * b**2 + 1 / 0.25
            b = np.exp(np.clip(np.log(b) + np.clip(slope / curve, -0.5, 0.5), -1.5, 1.5))
    return post, b


def sums_of(model: Model, post: np.ndarray, b: np.ndarray, item: np.ndarray, who: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    n, k = model.ability.shape
    q = post[item]
    b_of = b[item][:, None]
    chance = 1 / (1 + np.exp(-model.ability[who] * b_of))
    is_right = label[:, None] == np.arange(k)[None, :]
    by = lambda x: np.stack([np.bincount(who, x[:, c], n) for c in range(k)], 1)
    errors = np.zeros((n, k, k))
    np.add.at(errors, (who, slice(None), label), q * ~is_right)
    return {"slope": by(q * (is_right - chance) * b_of), "curve": by(q * chance * (1 - chance) * b_of**2), "right": by(q * is_right), "seen": by(q), "errors": errors, "prior": post.sum(0)}


def copy_weights(cluster: np.ndarray, item: np.ndarray, who: np.ndarray, labels: list[np.ndarray]) -> np.ndarray:
    """1 for each label, shared among the members of a cluster that gave an item the same labels."""
    key = np.stack([item, cluster[who], *labels], 1)
    _, inverse, counts = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    return 1 / counts[inverse.ravel()]


def flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """item, annotator and labels of a batch of items with list columns who, category, status."""
    lists = batch.column(batch.schema.get_field_index("who"))
    item = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    return item, lists.flatten().to_numpy(), [batch.column(batch.schema.get_field_index(f)).flatten().to_numpy() for f in FIELDS]


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


class Consensus:
    """Learns from claim_labels and gives the result tables."""

    def __init__(self, labels: DataFrame, passes: int = PASSES) -> None:
        self.spark = labels.sparkSession
        labels = materialize(labels, "claim-labels")
        self.annotators = sorted(r[0] for r in labels.select("annotator").distinct().limit(MOST_ANNOTATORS + 1).collect())
        if len(self.annotators) > MOST_ANNOTATORS:
            raise ValueError(f"more than {MOST_ANNOTATORS} annotators")
        classes = [sorted(r[0] for r in labels.select(f).distinct().collect()) for f in FIELDS]
        index = lambda values, column: F.coalesce(*[F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int") - 1]) if values else F.lit(0)
        names = self.spark.createDataFrame([(a, n) for n, a in enumerate(self.annotators)], "annotator string, who int")
        numbered = labels.join(names, "annotator").select("task_id", "claim_key", "who", *[index(c, f).alias(f) for f, c in zip(FIELDS, classes, strict=True)])
        listed = numbered.groupBy("task_id", "claim_key").agg(F.sort_array(F.collect_list(F.struct("who", *FIELDS))).alias("x"))
        self.items = materialize(listed.select("task_id", "claim_key", *[F.col(f"x.{c}").alias(c) for c in ("who", *FIELDS)]), "claim-items")
        self.models = [Model.first(c, len(self.annotators)) for c in classes]
        self.cluster = np.arange(len(self.annotators))
        for n in range(passes if self.annotators else 0):
            copies = self._copies() if n in (4, 9) else None
            sums = self._pass()
            for i, model in enumerate(self.models):
                model.step({k.split(":")[1]: v for k, v in sums.items() if k.startswith(f"{i}:")})
            if copies is not None:
                self.cluster = self._clusters(copies)

    def _pass(self) -> dict[str, np.ndarray]:
        state = self.spark.sparkContext.broadcast((self.models, self.cluster))

        def run(batches):
            models, cluster = state.value
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                item, who, labels = flat(batch)
                if not len(item):
                    continue
                weight = copy_weights(cluster, item, who, labels)
                for i, model in enumerate(models):
                    post, b = expectation(model, item, who, labels[i], weight, batch.num_rows)
                    for name, x in sums_of(model, post, b, item, who, labels[i]).items():
                        total[f"{i}:{name}"] = total.get(f"{i}:{name}", 0) + x
            yield pa.RecordBatch.from_arrays([pa.array([packed(total)] if total else [], pa.binary())], ["sums"])

        total: dict[str, np.ndarray] = {}
        for r in self.items.select("who", *FIELDS).mapInArrow(run, "sums binary").toLocalIterator():
            for name, x in np.load(io.BytesIO(r.sums)).items():
                total[name] = total.get(name, 0) + x
        state.unpersist()
        return total

    def _copies(self) -> list[tuple[int, int]]:
        """Pairs of annotators (the smaller number first) who share their errors: counted as sparse pairs, summed in Spark."""
        state = self.spark.sparkContext.broadcast((self.models, self.cluster))

        def run(batches):
            models, cluster = state.value
            for batch in batches:
                item, who, labels = flat(batch)
                if not len(item):
                    continue
                weight = copy_weights(cluster, item, who, labels)
                for i, model in enumerate(models):
                    post, _ = expectation(model, item, who, labels[i], weight, batch.num_rows)
                    for part in shared_errors(item, who, labels[i], post.argmax(1)):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in part], ["a", "b", "either", "same"])

        counted = self.items.select("who", *FIELDS).mapInArrow(run, "a long, b long, either double, same double")
        summed = counted.groupBy("a", "b").agg(F.sum("either").alias("either"), F.sum("same").alias("same"))
        return [(r.a, r.b) for r in summed.filter((F.col("either") >= COPY_ITEMS) & (F.col("same") >= COPY_SHARE * F.col("either"))).orderBy("a", "b").collect()]

    def _clusters(self, copies: list[tuple[int, int]]) -> np.ndarray:
        cluster = np.arange(len(self.annotators))
        for a, b in copies:
            cluster[cluster == cluster[b]] = cluster[a]
        return cluster

    def labels(self, least: int = LEAST) -> DataFrame:
        """task_id, claim_key, category, status, their posteriors, n_labels, and the share of labels that agree with both."""
        state = self.spark.sparkContext.broadcast((self.models, self.cluster))

        def run(batches):
            models, cluster = state.value
            for batch in batches:
                item, who, labels = flat(batch)
                if not len(item):
                    continue
                weight = copy_weights(cluster, item, who, labels)
                columns, agree = [], np.ones(len(item), bool)
                for i, model in enumerate(models):
                    post, _ = expectation(model, item, who, labels[i], weight, batch.num_rows)
                    best = post.argmax(1)
                    agree &= labels[i] == best[item]
                    columns += [pa.array([model.classes[x] for x in best], pa.string()), pa.array(post.max(1))]
                count = np.bincount(item, minlength=batch.num_rows)
                share = np.bincount(item, agree, batch.num_rows) / np.maximum(count, 1)
                full = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array(count.astype(np.int64)), pa.array(share)], names)
                yield full.filter(pa.array(count >= least))

        names = ["task_id", "claim_key", "category", "category_posterior", "status", "status_posterior", "n_labels", "agreement"]
        schema = "task_id string, claim_key string, category string, category_posterior double, status string, status_posterior double, n_labels long, agreement double"
        return self.items.mapInArrow(run, schema)

    def reliability(self) -> DataFrame:
        """annotator, field, mean ability, expected accuracy at usual difficulty, labels, and the smallest member of the copies."""
        sums = self._pass()
        rows = []
        if not sums:
            return self.spark.createDataFrame(rows, "annotator string, field string, ability double, accuracy double, n_labels long, copies_of string")
        for i, (field, model) in enumerate(zip(FIELDS, self.models, strict=True)):
            right, seen = sums[f"{i}:right"].sum(1), sums[f"{i}:seen"]
            for a, name in enumerate(self.annotators):
                mix = seen[a] / max(seen[a].sum(), 1e-12)
                rows.append((name, field, float(mix @ model.ability[a]), float(right[a] / max(seen[a].sum(), 1e-12)), round(float(seen[a].sum())), self.annotators[self.cluster[a]]))
        return self.spark.createDataFrame(rows, "annotator string, field string, ability double, accuracy double, n_labels long, copies_of string")


def shared_errors(item: np.ndarray, who: np.ndarray, label: np.ndarray, best: np.ndarray, at_once: int = 2_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, either, same) of the pairs of annotators with a label of one item where either errs: items, and equal wrong labels.

    item comes sorted. Only labels that err are paired with the others of their item, some millions of pairs at a time. Of two
    that err both see the pair, and count half of it each.
    """
    errs = label != best[item]
    first = np.searchsorted(item, item, "left")
    size = np.searchsorted(item, item, "right") - first
    wrong = np.flatnonzero(errs)
    cuts = np.searchsorted(np.cumsum(size[wrong]), np.arange(at_once, size[wrong].sum() + at_once, at_once)) + 1
    span = int(who.max()) + 1 if len(who) else 1
    for part in np.split(wrong, cuts[:-1]):
        if not len(part):
            continue
        n = size[part]
        left = np.repeat(part, n)
        right = np.repeat(first[part] - np.cumsum(n) + n, n) + np.arange(n.sum())
        keep = left != right
        left, right = left[keep], right[keep]
        half = np.where(errs[right], 0.5, 1.0)
        a, b = np.minimum(who[left], who[right]).astype(np.int64), np.maximum(who[left], who[right]).astype(np.int64)
        codes, at = np.unique(a * span + b, return_inverse=True)
        yield codes // span, codes % span, np.bincount(at, half, len(codes)), np.bincount(at, half * (label[left] == label[right]), len(codes))


def chance_corrected(labels: DataFrame) -> DataFrame:
    """field, n_items, observed, expected, kappa (Fleiss, for any number of labels), over items with two labels or more.

    Null kappa if expected agreement is 1 or no item has two labels.
    """
    long = labels.select("task_id", "claim_key", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("label")) for f in FIELDS])))
    counts = long.groupBy("field", "task_id", "claim_key", "label").agg(F.count("*").alias("n"))
    items = counts.groupBy("field", "task_id", "claim_key").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs"))
    observed = items.filter("m >= 2").groupBy("field").agg(F.count("*").alias("n_items"), F.avg(F.col("pairs") / (F.col("m") * (F.col("m") - 1))).alias("observed"))
    shares = counts.groupBy("field", "label").agg(F.sum("n").alias("n")).groupBy("field").agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2.0))).alias("expected"))
    return observed.join(shares, "field").withColumn("kappa", F.try_divide(F.col("observed") - F.col("expected"), 1 - F.col("expected")))
