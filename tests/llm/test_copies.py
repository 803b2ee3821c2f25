import random
from collections import Counter

import pytest

from assaylake.llm import near_pairs, splits
from assaylake.llm.traces import PairHasher, pair_sets, trace_text, words_of

VOCAB = [f"{a}{b}" for a in ("lot", "dock", "seal", "gate", "rota", "fare", "shift", "claim") for b in ("ing", "ed", "er", "man", "ward", "less")]


def text(rnd, n=60):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def edited(rnd, t, edits):
    w = t.split()
    for _ in range(edits):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
    return " ".join(w)


def alike(a, b):
    x, y = (set(zip(w, w[1:], strict=False)) for w in (words_of(a), words_of(b)))
    return len(x & y) / len(x | y)


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(5)
    texts = []
    for _ in range(60):
        base = text(rnd, rnd.randrange(30, 90))
        texts.append(base)
        texts += [edited(rnd, base, rnd.randrange(1, 9)) for _ in range(rnd.randrange(3))]
    texts += [texts[0].upper()] * 4 + [None, "", "too few words", "12 34 x1 " * 10]
    return texts


def test_words_and_texts():
    assert words_of("On-call DESK_lead x1 2025-01-02 ref_7_a Straße") == ["on", "call", "desk", "lead", "straße"]
    assert trace_text(['{"k": ["a", {"x": "b"}], "n": 1}', None, "no json", "", '"c"']) == "a\nb\nno json\nc"
    assert len(PairHasher().pairs(["a", "b", "a", "b"])) == 2


def test_pairs_equal_brute_force(spark, corpus):
    rows = [("t", i, t, "clash", 0) for i, t in enumerate(corpus)]
    df = spark.createDataFrame(rows, "tab string, id long, text string, kind string, rep int")
    got = {(r.id_a, r.id_b) for r in near_pairs.near_copies(pair_sets(df, False)).collect()}
    real = [(i, t) for i, t in enumerate(corpus) if t and len(words_of(t)) >= 8]
    want = {(i, j): alike(a, b) for n, (i, a) in enumerate(real) for j, b in real[n + 1 :] if alike(a, b) >= 0.5}
    assert got <= set(want)
    assert all(s < 0.6 for p, s in want.items() if p not in got) and len(set(want) - got) <= 0.03 * len(want)


def test_a_third_of_the_rows_in_one_edited_group(spark):
    rnd = random.Random(11)
    own = lambda n: " ".join(rnd.choice(VOCAB) + rnd.choice(VOCAB) for _ in range(n))
    core = own(80)
    texts = [f"{core} {own(25)}" for _ in range(100)] + [own(105) for _ in range(200)]
    df = spark.createDataFrame([("t", i, t) for i, t in enumerate(texts)], "tab string, id long, text string")
    got = {(r.id_a, r.id_b) for r in near_pairs.near_copies(pair_sets(df, False)).collect()}
    want = {(i, j) for i in range(100) for j in range(i + 1, 100)}
    assert all(0.59 < alike(texts[i], texts[j]) < 0.63 for i, j in want)
    assert got <= want and len(want - got) <= 0.01 * len(want), len(got)


def test_equal_texts_are_one_class_and_tables_stay_apart(spark):
    t = text(random.Random(1))
    df = spark.createDataFrame([("a", i, t) for i in range(40)] + [("b", 1, t)], "tab string, id long, text string")
    sets = near_pairs.materialize(pair_sets(df, False))
    pairs, members = near_pairs.class_pairs(sets)
    assert pairs.count() == 0 and Counter((r.tab, r.rep, r.size) for r in members.collect()) == {("a", 0, 40): 40, ("b", 1, 1): 1}
    assert near_pairs.near_copies(pair_sets(df, False)).count() == 40 * 39 // 2


def test_empty_tables(spark):
    df = spark.createDataFrame([], "tab string, id long, text string")
    assert near_pairs.near_copies(pair_sets(df, False)).count() == 0


TASKS = "record_id long, split_name string, source string, template_family string, entity_pool string, trace array<struct<trace_id:string,content:string>>, split string, code string"


def tasks(spark, rows):
    return spark.createDataFrame([(i, s, "src", f, p, None if t is None else [("t", f'{{"note": "{t}"}}'), None], "clash", "clash") for i, (s, f, p, t) in enumerate(rows)], TASKS)


def test_splits_overlap_by_trace_and_by_labels(spark, corpus):
    rnd = random.Random(2)
    bases = [text(rnd) for _ in range(12)]
    rows = []
    for i, b in enumerate(bases):
        rows += [("Train", None, None, b), (("dev", " TEST", "confirmatory")[i % 3], None, "p", edited(rnd, b, i % 5))]
    rows += [("train", "Fam A", "pool-1", None), ("dev", "fam_a ", "POOL_1", ""), ("test", "fam_a", None, "x"), (None, "fam_a", "pool_1", bases[0]), ("other", None, None, bases[1]), ("train", None, None, bases[0])]
    got = {(r.train_id, r.other_id): (r.by_trace, r.by_labels) for r in splits.split_overlaps(tasks(spark, rows)).collect()}
    want = {(2 * i, 2 * i + 1): (True, False) for i in range(12)} | {(24, 25): (False, True), (29, 1): (True, False)}
    assert got == want
    counts = {r.split: (r.n_records, r.n_overlapping, r.n_pairs) for r in splits.overlap_counts(tasks(spark, rows)).collect()}
    assert counts == {"dev": (5, 5, 6), "test": (5, 4, 4), "confirmatory": (4, 4, 4)}


def test_splits_overlap_where_edits_are_spread(spark):
    rnd = random.Random(7)
    rows, want = [], {}
    for n, places in ((100, range(4, 100, 8)), (100, range(4, 100, 7)), (100, range(3, 100, 6)), (15, [7])):
        words = text(rnd, n).split()
        other = [f"new{'x' * at}" if at in places else w for at, w in enumerate(words)]
        a, b = " ".join(words), " ".join(other)
        want[len(rows), len(rows) + 1] = alike(a, b) >= 0.5
        rows += [("train", None, None, a), ("dev", None, None, b)]
    assert list(want.values()) == [True] * 4
    assert {(r.train_id, r.other_id) for r in splits.split_overlaps(tasks(spark, rows)).collect()} == set(want)


def test_recall_over_similarities_with_even_and_uneven_edits(spark):
    """Every pair of similarity 0.5 to 0.75, the edits spread evenly, put in evenly, or at random."""
    rnd = random.Random(13)
    own = lambda: rnd.choice(VOCAB) + rnd.choice(VOCAB)
    rows, want = [], set()
    for i in range(150):
        words = [own() for _ in range(rnd.randrange(9, 120))]
        step = rnd.randrange(6, 12)
        other = words.copy()
        for at in range(rnd.randrange(step), len(words), step):
            other[at] = own() if i % 3 < 2 else f"{other[at]} {own()}"
        if i % 3 == 1:
            other = [own() if rnd.random() < 0.13 else w for w in words]
        a, b = " ".join(words), " ".join(other)
        rows += [("train", None, None, a), ("dev", None, None, b)]
        if alike(a, b) >= 0.5:
            want.add((2 * i, 2 * i + 1))
    got = {(r.train_id, r.other_id) for r in splits.split_overlaps(tasks(spark, rows)).collect()}
    assert got <= want and len(want) > 80 and len(got) >= 0.98 * len(want), (len(got), len(want))


def test_no_overlap_is_left_out(spark):
    """All pairs of half-alike texts: in runs of three words in another order, or of a few common words, in shards of any size."""
    rnd = random.Random(17)
    own = lambda: rnd.choice(VOCAB) + rnd.choice(VOCAB)
    rows = []
    for i in range(70):
        words = [own() if i % 2 else rnd.choice(VOCAB[:12]) for _ in range(rnd.randrange(12, 120))]
        blocks = [words[at : at + 3 + i % 3] for at in range(0, len(words), 3 + i % 3)]
        rnd.shuffle(blocks)
        rows += [("train", None, None, " ".join(words)), ("dev", None, None, " ".join(w for b in blocks for w in b))]
    want = {(a, b) for a in range(0, 140, 2) for b in range(1, 140, 2) if alike(rows[a][3], rows[b][3]) >= 0.5}
    records = splits.materialize(splits.coded_records(tasks(spark, rows)))
    for n in (500, 100_000):
        assert {(r.train_id, r.other_id) for r in splits.trace_overlaps(records, shard_passages=n).collect()} == want and len(want) > 50


def test_shards_change_nothing(spark, corpus):
    rnd = random.Random(3)
    rows = [(("train", "dev")[i % 2], None, None, t) for i, t in enumerate(corpus) if t]
    rows += [("train", None, None, edited(rnd, corpus[3], 4)), ("dev", None, None, corpus[3])]
    records = splits.materialize(splits.coded_records(tasks(spark, rows)))
    found = {n: {(r.train_id, r.other_id) for r in splits.trace_overlaps(records, shard_passages=n).collect()} for n in (200, 100_000)}
    assert found[200] == found[100_000] and found[200]


def test_no_splits_no_rows(spark):
    assert splits.split_overlaps(tasks(spark, [])).count() == 0
    assert splits.split_overlaps(tasks(spark, [("train", None, None, "a b c d e f g h i")])).count() == 0
