"""One-to-one matching of predicted with reference atoms, and scores over the matches.

Atoms have a group (category and key) and match inside it only. Groups with one atom on either side are an equality join with
one best edge; only others run an assignment solver, one group at a time in an Arrow-fed Python function. Weights of 0 never
match. Texts that match by shared words don't list their pairs: a task gets a group's texts and counts the words itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.columns import canonical_number, stripped


def assignment(weights: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs of a maximum-weight one-to-one assignment; shortest augmenting paths over potentials, n^2 m steps."""
    flip = len(weights) > (len(weights[0]) if weights else 0)
    w = [list(x) for x in zip(*weights, strict=True)] if flip else weights
    rows, cols = len(w), len(w[0]) if w else 0
    price_row, price_col, owner = [0.0] * rows, [0.0] * cols, [-1] * cols
    for start in range(rows):
        reach = [float("inf")] * cols
        came, done = [-1] * cols, [False] * cols
        row, last = start, -1
        base = 0.0
        while True:
            near, best = -1, float("inf")
            for c in range(cols):
                if not done[c]:
                    slack = base - w[row][c] - price_row[row] - price_col[c]
                    if slack < reach[c]:
                        reach[c], came[c] = slack, last
                    if reach[c] < best:
                        near, best = c, reach[c]
            done[near], base, last = True, best, near
            if owner[near] < 0:
                break
            row = owner[near]
        price_row[start] += base
        for c in range(cols):
            if done[c] and owner[c] >= 0:
                price_row[owner[c]] += base - reach[c]
            if done[c]:
                price_col[c] -= base - reach[c]
        while last >= 0:
            before = came[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    pairs = [(r, c) for c, r in enumerate(owner) if r >= 0]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def assignment_of_counts(weights: np.ndarray, at_once: int = 128) -> np.ndarray:
    """Pairs of a maximum-weight one-to-one assignment of whole numbers >= 0, as rows (row, column); pairs of weight 0 are left open.

    Primal-dual: all rows start at the price of the largest weight, and those that are free fall together. At each price the
    edges without slack are matched, by breadth-first forests from all free rows at once, until no path ends at a free column;
    then prices move. So the forests grow with the size of the weights and not with the number of rows, and are array steps.
    """
    flip = weights.shape[0] > weights.shape[1]
    w = np.ascontiguousarray(weights.T if flip else weights)
    n, m = w.shape
    price_row, price_col = np.full(n, w.max(initial=0), np.int32), np.zeros(m, np.int32)
    row_of, col_of, every = np.full(m, -1), np.full(n, -1), np.arange(m)
    while True:
        for r in np.flatnonzero(col_of < 0).tolist():
            open_to = np.flatnonzero((price_col + price_row[r] == w[r]) & (row_of < 0))
            if len(open_to):
                row_of[open_to[0]], col_of[r] = r, open_to[0]
        free = np.flatnonzero(col_of < 0)
        if not len(free) or price_row[free[0]] == 0:
            break
        slack, came, seen = np.full(m, np.iinfo(np.int32).max, np.int32), np.full(m, -1), np.zeros(m, bool)
        root, reached = np.full(n, -1), np.zeros(n, bool)
        root[free], reached[free], frontier = free, True, free
        while True:
            for at in range(0, len(frontier), at_once):
                rows = frontier[at : at + at_once]
                block = price_row[rows].astype(w.dtype)[:, None] - w[rows]
                least = block.argmin(0)
                here = block[least, every] + price_col
                better = here < slack
                slack[better], came[better] = here[better], rows[least[better]]
            while not len(tight := np.flatnonzero((slack == 0) & ~seen)) and price_row[free[0]] > 0:
                by = min(int(slack[~seen].min()), int(price_row[free[0]]))
                price_row[reached] -= by
                price_col[seen] += by
                slack[~seen] -= by
            if price_row[free[0]] == 0:
                break
            seen[tight] = True
            ends = tight[row_of[tight] < 0]
            if len(ends):
                done = set()
                for c in ends.tolist():
                    if root[came[c]] not in done:  # the trees share nothing, so one path of each can be taken
                        done.add(root[came[c]])
                        while c >= 0:
                            r = came[c]
                            row_of[c] = r
                            c, col_of[r] = col_of[r], c
                break
            frontier = row_of[tight]
            root[frontier], reached[frontier] = root[came[tight]], True
    rows = np.flatnonzero(col_of >= 0)
    rows = rows[w[rows, col_of[rows]] > 0]
    pairs = np.stack([rows, col_of[rows]], 1)
    return pairs[:, ::-1] if flip else pairs


def shared_counts(lefts: list[list[str]], rights: list[list[str]]) -> np.ndarray:
    """How many words each left list shares with each right one, lists being without repeats; bit by bit, as whole numbers."""
    number: dict[str, int] = {}
    for words in rights:
        for word in words:
            number.setdefault(word, len(number))

    def bits(lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(lists), max(1, -(-len(number) // 64))), np.uint64)
        for row, words in zip(out, lists, strict=True):
            held = np.array([number[word] for word in words if word in number], np.int64)
            np.bitwise_or.at(row, held >> 6, np.uint64(1) << (held & 63).astype(np.uint64))
        return out

    one, other = bits(lefts), bits(rights)
    out = np.empty((len(lefts), len(rights)), np.int16 if max(map(len, rights), default=0) < 1 << 14 else np.int32)
    for at, row in enumerate(one):
        some = np.flatnonzero(row)
        out[at] = np.bitwise_count(other[:, some] & row[some]).sum(1, dtype=out.dtype)
    return out


def word_matches(lefts: DataFrame, rights: DataFrame, group: str, left: str, right: str, words: str) -> DataFrame:
    """group, left, right, weight of a maximum-weight one-to-one matching inside each group by the number of shared words.

    lefts: group, left, words; rights: group, right, words (arrays without repeats). Each text is shuffled once, and a group is
    matched where it lies: pairs are never rows, and the largest group costs its task two bytes a pair. Null groups and words
    match nothing.
    """
    kinds = {f.name: f.dataType for df in (lefts, rights) for f in df.schema.fields}
    side = lambda df, own, other: df.filter(F.col(group).isNotNull() & F.col(words).isNotNull()).select(
        group, F.col(own).alias(own), F.lit(None).cast(kinds[other]).alias(other), F.lit(own == left).alias("is_left"), words
    )
    texts = side(lefts, left, right).select(group, "is_left", left, right, words).unionAll(side(rights, right, left).select(group, "is_left", left, right, words))
    out = texts.select(group, left, right, F.lit(0.0).alias("weight")).schema

    def solved(key, of_left: list[tuple], of_right: list[tuple]) -> list[tuple]:
        if not of_left or not of_right:
            return []
        if len(of_left) * len(of_right) <= 64:
            sets = [set(b) for _, b in of_right]
            table = [[float(len(s.intersection(a))) for s in sets] for _, a in of_left]
            return [(key, of_left[i][0], of_right[j][0], table[i][j]) for i, j in assignment(table) if table[i][j] > 0]
        table = shared_counts([a for _, a in of_left], [b for _, b in of_right])
        return [(key, of_left[i][0], of_right[j][0], float(table[i, j])) for i, j in assignment_of_counts(table).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, key, sides, ready = to_arrow_schema(out), None, ([], []), []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*ready, strict=True)) if ready else [()] * len(target)
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types, strict=True)], schema=target)

        for batch in batches:
            for now, is_left, a, b, held in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now != key:
                    ready += solved(key, *sides)
                    key, sides = now, ([], [])
                sides[not is_left].append((a if is_left else b, held))
            if ready:
                yield flush()
        ready += solved(key, *sides)
        yield flush()

    return texts.repartition(group).sortWithinPartitions(group, "is_left", left, right).mapInArrow(run, out)


def best_matches(edges: DataFrame, group: list[str], left: str, right: str, weight: str) -> DataFrame:
    """group, left, right, weight of a maximum-weight one-to-one matching inside each group. Edges must be unique."""
    good = edges.filter(F.col(weight) > 0).select(*group, left, right, weight)
    sizes = good.groupBy(*group).agg(F.count("*").alias("n_edges"))
    sized = good.join(sizes, group)
    simple = sized.filter("n_edges = 1").select(*group, left, right, weight)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, cols = sorted(pdf[left].unique()), sorted(pdf[right].unique())
        table = [[0.0] * len(cols) for _ in rows]
        at_row, at_col = {v: i for i, v in enumerate(rows)}, {v: i for i, v in enumerate(cols)}
        for a, b, x in zip(pdf[left], pdf[right], pdf[weight], strict=True):
            table[at_row[a]][at_col[b]] = float(x)
        chosen = [(rows[r], cols[c]) for r, c in assignment(table) if table[r][c] > 0]
        picked = pd.DataFrame(chosen, columns=[left, right])
        return pdf.merge(picked, on=[left, right])[[*group, left, right, weight]]

    schema = simple.schema
    return simple.unionByName(sized.filter("n_edges > 1").drop("n_edges").groupBy(*group).applyInPandas(solve, schema))


def multiset_scores(predicted: DataFrame, reference: DataFrame, unit: str, atom: str) -> DataFrame:
    """unit, tp, n_predicted, n_reference, precision, recall, f1 of multisets; an empty side that should be empty scores 1."""
    p = predicted.groupBy(unit, atom).agg(F.count("*").alias("n_p"))
    r = reference.groupBy(unit, atom).agg(F.count("*").alias("n_r"))
    both = p.join(r, [unit, atom], "full_outer").select(unit, F.coalesce("n_p", F.lit(0)).alias("n_p"), F.coalesce("n_r", F.lit(0)).alias("n_r"))
    out = both.groupBy(unit).agg(F.sum(F.least("n_p", "n_r")).alias("tp"), F.sum("n_p").alias("n_predicted"), F.sum("n_r").alias("n_reference"))
    return with_f1(out, "tp", "n_predicted", "n_reference")


def with_f1(counts: DataFrame, tp: str, n_predicted: str, n_reference: str) -> DataFrame:
    """counts with precision, recall and f1; no predictions and no reference score 1, f1 is 0 where both are 0."""
    p = F.when(F.col(n_predicted) > 0, F.col(tp) / F.col(n_predicted)).otherwise(F.when(F.col(n_reference) > 0, 0.0).otherwise(1.0))
    r = F.when(F.col(n_reference) > 0, F.col(tp) / F.col(n_reference)).otherwise(1.0)
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def canonical_value(value_json: str, value_type: str) -> F.Column:
    """A claim's value as text that is equal for equal values: numbers without trailing zeros, sets sorted and distinct."""
    raw = F.col(value_json)
    text = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"), F.lit("null"))
    items = F.array_sort(F.array_distinct(F.from_json(raw, "array<string>")))
    return (
        F.when(F.col(value_type) == "set", F.to_json(items)).when(F.col(value_type) == "number", canonical_number(text))
        .when(F.col(value_type) == "boolean", F.lower(stripped(text))).otherwise(stripped(text))
    )


def state_scores(gold: DataFrame, predicted: DataFrame, unit: str) -> DataFrame:
    """unit, recall, precision, f1, contradiction_rate, unsupported_rate of weighted claims.

    gold and predicted: unit, claim_no, category, key, status, value_json, value_type, weight. A claim's overlap with another of
    its category and key is 0 unless the statuses are equal; for sets it is the share of its items that the other holds, else 1
    for equal values. Edges weigh both directions. Units without gold have no row.
    """
    shape = lambda df, side: df.select(
        unit, "category", "key", F.col("claim_no").alias(f"{side}_no"), F.col("status").alias(f"{side}_status"), canonical_value("value_json", "value_type").alias(f"{side}_value"),
        F.when(F.col("value_type") == "set", F.array_distinct(F.from_json("value_json", "array<string>"))).alias(f"{side}_set"), F.col("weight").cast("double").alias(f"{side}_weight"),
    )
    g, p = shape(gold, "g"), shape(predicted, "p")
    share = lambda a, b: F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    same = F.col("g_value").eqNullSafe(F.col("p_value")).cast("double")
    sets = F.col("g_set").isNotNull() & F.col("p_set").isNotNull()
    match = F.when(~F.col("g_status").eqNullSafe(F.col("p_status")), 0.0)
    edges = g.join(p, [unit, "category", "key"]).select(
        unit, "category", "key", "g_no", "p_no", "g_weight", "p_weight",
        match.otherwise(F.when(sets, share(F.col("g_set"), F.col("p_set"))).otherwise(same)).alias("forth"),
        match.otherwise(F.when(sets, share(F.col("p_set"), F.col("g_set"))).otherwise(same)).alias("back"),
    ).withColumn("edge", F.col("g_weight") * F.col("forth") + F.col("p_weight") * F.col("back"))
    chosen = best_matches(edges, [unit, "category", "key"], "g_no", "p_no", "edge").join(edges.drop("edge"), [unit, "category", "key", "g_no", "p_no"])
    hits = chosen.groupBy(unit).agg(F.sum(F.col("g_weight") * F.col("forth")).alias("found"), F.sum(F.col("p_weight") * F.col("back")).alias("right"))
    shared = edges.groupBy(unit, "p_no").agg(F.max(((F.col("forth") < 1) | (F.col("back") < 1)).cast("long")).alias("conflict"))
    shared = shared.groupBy(unit).agg(F.count("*").alias("n_shared"), F.sum("conflict").alias("n_conflicts"))
    totals = g.groupBy(unit).agg(F.sum("g_weight").alias("gold_weight"))
    made = p.groupBy(unit).agg(F.sum("p_weight").alias("pred_weight"), F.count("*").alias("n_predicted"))
    out = totals.join(made, unit, "left").join(hits, unit, "left").join(shared, unit, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.select(
        unit, ratio(zero("found"), F.col("gold_weight")).alias("recall"), ratio(zero("right"), F.col("pred_weight")).alias("precision"),
        ratio(zero("n_conflicts"), F.col("n_shared")).alias("contradiction_rate"),
        ratio(zero("n_predicted") - zero("n_shared"), F.col("n_predicted")).alias("unsupported_rate"),
    ).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
