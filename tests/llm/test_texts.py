import random
from pathlib import Path

import pytest

from assaylake.llm import byte_pairs, language_filters, leaks

TOKENIZERS = Path(byte_pairs.TOKENIZERS)
needs_vocabulary = pytest.mark.skipif(not TOKENIZERS.exists(), reason="no tokenizer files here")
DOCS = "doc_id long, text string, lang string, ids string, label string, item_id int"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", 0) for i, (t, lang) in enumerate(rows)], DOCS)


@needs_vocabulary
def test_ids_equal_the_public_library():
    tiktoken = pytest.importorskip("tiktoken")
    tokens = byte_pairs.load_ranks()
    want = tiktoken.Encoding("own", pat_str=byte_pairs.PRE_TOKENS, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    mine = byte_pairs.Encoder(tokens, keep=50)
    rnd = random.Random(0)
    texts = ["".join(rnd.choice("aab e\n'sтя日本😀1.<|>_") for _ in range(rnd.randrange(80))) for _ in range(400)]
    texts += ["a" * 30_000, "ab" * 20_000, " " * 3000 + "x", "<|endoftext|>", "\x00​é", "".join(rnd.choice("abcdefgh") for _ in range(40_000))]
    for t in texts:
        assert mine.encode(t) == want.encode_ordinary(t)


@needs_vocabulary
def test_ids_of_null_empty_and_repeated_texts(spark):
    df = docs(spark, (None, "x"), ("", "x"), ("a b", "x"), ("a b", "x"))
    out = {r.doc_id: r.ids for r in byte_pairs.encoded(df, "doc_id", "text").collect()}
    assert out[0] == [] and out[1] == [] and out[2] == out[3] and len(out[2]) == 2
    assert byte_pairs.encoded(df.limit(0), "doc_id", "text").count() == 0


def test_the_rank_queue_gives_ranks_in_order():
    rnd = random.Random(2)
    queue, held = byte_pairs.RankQueue(60_000), {}
    for n in range(500):
        rank = rnd.choice([0, 63, 64, 4095, 4096, 59_999, rnd.randrange(60_000)])
        queue.push(rank, n)
        held.setdefault(rank, []).append(n)
    for rank in sorted(held):
        assert queue.pop() == (rank, held[rank])
    assert queue.pop() == (-1, [])


VOCAB = [f"{a}{b}" for a in ("lot", "dock", "seal", "gate", "rota", "fare") for b in ("ing", "ed", "er", "man", "ward", "less")]


def sentence(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def test_leaks_are_found_through_disguises_and_excerpts_are_not(spark):
    rnd = random.Random(6)
    items = [(i, sentence(rnd, 60)) for i in range(40)]
    item = items[3][1].split()
    half = " ".join(item[30:50]) + ". Filler text here, " + " ".join(item[:14])
    changed = item.copy()
    for at in (9, 25, 41, 55):
        changed[at] = "other"
    texts = [
        " ".join(item), " ".join(item).upper().replace(" ", "\n\t"), "​".join(" ".join(item)), '{"note": "' + "\\u0020".join(item) + '"}', half, " ".join(changed), " ".join(item[:20]),
        " ".join(w for i in range(0, 60, 7) for w in (*item[i : i + 7], "x")), None, "", sentence(rnd, 300), " ".join(item) + " " + items[4][1], sentence(rnd, 150_000) + " " + " ".join(item),
    ]
    df = docs(spark, *[(t, None) for t in texts])
    frame = spark.createDataFrame([*items, (100, None), (101, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(df, frame).collect()}
    assert got == {(0, 3), (1, 3), (2, 3), (3, 3), (4, 3), (5, 3), (7, 3), (11, 3), (11, 4), (12, 3)}
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(df, frame, shard_words=300).collect()} == got
    assert leaks.leaks(df, frame.limit(0)).count() == 0 and leaks.leaks(df.limit(0), frame).count() == 0


def test_the_blocks_find_all_prints_within_the_radius():
    import numpy as np

    rnd = random.Random(7)
    index = index_of([sentence(rnd, 40) for _ in range(20)])
    for _ in range(200):
        n = rnd.randrange(len(index.prints))
        print_ = int(index.prints[n])
        for bit in rnd.sample(range(64), leaks.RADIUS):
            print_ ^= 1 << bit
        assert [index.owner[n], index.place[n], 0] in index.near(np.array([print_], np.uint64)).tolist()


def index_of(texts, weight=lambda word: 2.0):
    import numpy as np

    numbers = leaks.WordNumbers()
    words = [leaks.plain_words(t) for t in texts]
    return leaks.ItemIndex([(i, numbers(w), np.array([weight(x) for x in w], np.float32)) for i, w in enumerate(words)], 2.0)


@pytest.mark.parametrize(("rate", "least"), [("eighth", 1.0), (0.05, 1.0), (0.1, 0.9)])
def test_recall_of_items_with_changed_words(rate, least):
    """Against comparing every alignment, with no fingerprints."""
    import numpy as np

    rnd, rng = random.Random(11), np.random.default_rng(11)
    index = index_of([sentence(rnd, 70) for _ in range(120)])
    filler = leaks.WordNumbers()(sentence(rnd, 200).split())
    found = true = 0
    for n, words in enumerate(index.words):
        changed = words.copy()
        at = np.arange(7, 70, 8) if rate == "eighth" else np.flatnonzero(rng.random(70) < rate)
        changed[at] = rng.integers(1, 1 << 63, len(at), dtype=np.uint64)
        text = np.concatenate([filler, changed, filler])
        if index.covered(n, text, list(range(-70, len(text)))).mean() >= leaks.SHARE:
            true += 1
            found += n in [i for i, _ in index.leaked(text)]
    assert true > 100 and found >= least * true


def test_excerpts_with_changed_words_in_another_order():
    """Three excerpts of 14 words, 0.6 of an item, in turn around; in each a word is changed, put in or left out, also near its end."""
    import numpy as np

    rnd, rng = random.Random(21), np.random.default_rng(21)
    index = index_of([sentence(rnd, 70) for _ in range(60)])
    fill = lambda n: rng.integers(1, 1 << 63, n, dtype=np.uint64)
    found = 0
    for n, words in enumerate(index.words):
        text = [fill(15)]
        for k, first in enumerate((46, 23, 0)):
            piece, at = words[first : first + 14], rnd.choice((3, 11))
            text += [piece[:at], fill(int(k < 2)), piece[at + (k != 1) :], fill(15)]  # changed, put in, left out
        found += n in [i for i, _ in index.leaked(np.concatenate(text))]
    assert found >= 0.95 * len(index.words), found


def test_a_run_counts_with_the_parts_that_are_alike_enough():
    import numpy as np

    same, weights = np.ones(60, bool), np.ones(60)
    same[30:60:5], weights[30:60:5] = False, 5.0
    inside = leaks.in_passages(same, weights)
    assert inside[:30].all() and not inside[45:].any()


def test_without_a_near_fingerprint_nothing_is_found(monkeypatch):
    """The fingerprints carry the result: with a radius below zero even a whole copy is missed, and nearness finds changed light words."""
    rnd = random.Random(12)
    texts = [sentence(rnd, 60) for _ in range(5)]
    index = index_of(texts, lambda word: 1.0 if word.startswith("lot") else 6.0)
    numbers = leaks.WordNumbers()(texts[2].split())
    assert [i for i, _ in index.leaked(numbers)] == [2]
    monkeypatch.setattr(leaks, "RADIUS", -1)
    assert index.leaked(numbers) == []


def test_standing_phrases_with_other_names_are_no_leak():
    text = "the owner of the {} noted that the {} was held until the {} of the {} had been seen by the {} and the {} was told"
    heavy = lambda word: 5.0 if word[-1].isdigit() else 1.0
    fill = lambda k: text.format(*[f"x{k}{n}" for n in range(6)])
    index = index_of([fill(1) + " " + fill(2)], heavy)
    assert index.leaked(leaks.WordNumbers()((fill(3) + " " + fill(4)).split())) == []
    assert [i for i, _ in index.leaked(leaks.WordNumbers()((fill(1) + " " + fill(4)).split()))] == [0]


TEXTS = {
    "en": "The owner of the lot noted that the dock was closed before the cutoff.", "de": "Die Buchhaltung sperrte die offene Rechnung wegen eines fehlenden Etiketts.",
    "fr": "Le service des voyages a refusé la facture en attente après le second examen.", "es": "La oficina de pagos anotó la caja dañada después de la segunda revisión.",
    "pt": "A mesa de compras corrigiu o novo horário de entrega durante o turno da noite.", "it": "Il servizio guasti ha bloccato la scatola danneggiata prima della scadenza.",
    "nl": "De centrale kas zocht de dubbele boeking tijdens de nachtdienst.", "ru": "Отдел закупок подтвердил недостающее согласие до окончания срока.", "ja": "倉庫の責任者は期限の前に変更された旅程を引き継ぎました。",
}


@pytest.fixture(scope="module")
def filters():
    return language_filters.learned([(lang, t) for lang, t in TEXTS.items() for _ in range(3)])


def test_labels_are_read_in_every_spelling(spark):
    labels = ["en", " EN-gb ", "en_US", "English", "eng", "deu", "ger", "DE-at", "French", "日本語", "??", "und", "xx", "n/a", "", None, "unknown", "zh"]
    df = spark.createDataFrame([(x,) for x in labels], "lang string").select(language_filters.named_language("lang").alias("l"))
    assert [r.l for r in df.collect()] == ["en"] * 5 + ["de"] * 3 + ["fr", "ja"] + [None] * 8


def test_each_language_is_told(filters):
    judge = language_filters.Judge(filters)
    for lang, t in TEXTS.items():
        assert judge.segment(t)[0] == lang
    assert judge.segment("4d78b076cd7e31a83f56cf4a4ccffd0e 519408") is None and judge.segment("764/7 631/2") is None
    assert judge.segment('The manager wrote "追って通知があるまで" on the lot of the owner.')[0] == "en"


def test_missing_wrong_and_mixed_labels_come_out(spark, filters):
    mixed = TEXTS["en"] + " " + TEXTS["de"] + "\n" + TEXTS["en"]
    rows = [
        (TEXTS["en"], "en-GB"), (TEXTS["en"], None), (TEXTS["fr"], "de"), (mixed, "English"), ("12 34 5f6a", None), ("", None), (None, "en"), (TEXTS["ru"] * 3000, "ru"), (TEXTS["ja"], "en"),
        ('[{"note": "' + TEXTS["it"] + '"}, {"note": "' + TEXTS["nl"] + '"}]', "it"), (TEXTS["en"][:-1] + ' and wrote "hasta nuevo aviso" on it.', "en"), (TEXTS["fr"], "de"),
    ]
    judged = language_filters.document_languages(docs(spark, *rows), filters)
    got = sorted((r.doc_id, r.lang) for r in language_filters.mislabelled(judged).collect())
    assert got == [(1, "en"), (2, "fr"), (3, "de"), (3, "en"), (8, "ja"), (9, "it"), (9, "nl"), (11, "fr")]
    segments = [(r.segment_no, r.lang) for r in language_filters.language_segments(docs(spark, *rows), filters).filter("doc_id = 3").orderBy("segment_no").collect()]
    assert segments == [(0, "en"), (1, "de"), (2, "en")]
    assert language_filters.mislabelled(language_filters.document_languages(docs(spark), filters)).count() == 0
    assert language_filters.sampled(docs(spark)) == []


def test_the_filters_never_miss_and_seldom_err(filters):
    grams = [g for t in TEXTS.values() for u in language_filters.units(t) for g in language_filters.ngrams(u)]
    assert all(filters.languages_of(g) for g in grams)
    assert sum(filters.languages_of(f"§{i}") > 0 for i in range(20_000)) < 20
