import json
import random

import pytest
from pyspark.sql import functions as F

from assaylake.llm import answers, pairs, truncation
from assaylake.llm.suffix_automaton import SuffixAutomaton

ANSWERS = "tab string, row_id long, turn_no long, source string, text string, prompt_hash string, chars string"
WHOLE = [
    "It is done.", "Done!\n", 'He wrote "known ... approved" in the log.', "It is done.\n-- desk 47", "It is done.\nRef: hx-12", "It is done.\n- scope: paid", "It is done.\n\nEND",
    "It is done.\n```\nmerge_gate()\n```", '{"a": [1, 2]}', '```json\n{"a": 1}\n```', 'Answer: {"a": 1}', "終わりました。", "Is it legal?", '"It is done."', "[1, 2]\n",
]
CUT = [
    "It is done. The next", "It is done. The next <cut>", "It is done. The ne…", "It is done. The ne [...]", "The next (truncated)", "The next�", "The next ...", '{"a": [1, 2', '{"a": "b', '```json\n{"a": 1',
    "It is done.\n- The next", "It is done. The next  \n", "It is done.\n```\nmerge_ga", "It is done. It said \"not", '{"a": "x" [...]', "Although the lot was locked,", "次の担当者は期限",
]
BLANK = [None, "", "  \n", "​", "N/A", "null", "-", "...", "<empty>", '""', "{}", "[]", '{"receiver_state": {}, "action": null}', "```json\n{}\n```", "```json\n```"]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    got = answers.shape(text)
    assert got.whole and got.kind != "blank"


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    assert not answers.shape(text).whole


@pytest.mark.parametrize("text", BLANK)
def test_blank(text):
    got = answers.shape(text)
    assert got.whole and got.kind == "blank"


def test_every_cut_of_a_json_answer_is_seen():
    text = json.dumps({"receiver_state": {"goal": [{"key": "a", "value": None}]}, "action": {"name": "x", "n": 1.5}})
    assert all(not answers.shape(text[:n]).whole for n in range(2, len(text)))


def frame(spark, rows):
    return spark.createDataFrame([("run_artifacts", i, 0, s, t, h, "clash") for i, (s, t, h) in enumerate(rows)], ANSWERS)


ENDINGS = [
    ("- Jane Doe\n-- Jane Doe", "full"), ("Kind regards,\nAlex Doe", "full"), ("Mit freundlichen Grüßen\nKim", "full"), ("x\n***", "full"), ("x\nEnde des Berichts", ""), ("x\nEnd of report", "full"),
    ("- apples\n- pears", "loose"), ("1. apples\n2. pears", "loose"), ("- It is done.\n- pears", ""), ("x\nSee: https://example.org/a1", "full"), ("x\n[3] Smith, J. Notes", "loose"), ("x\nOwner: the", ""), ("x\n- owner: the", ""),
    ("x\nNote: x", ""), ("x\nTicket: AB-12", "full"), ("x\nNext step: pending", "loose"), ("x\n- scope: paid", "full"), ("x\nApproved by: Jane,", ""), ("x\nthe lot", ""), ("x\nDone", "full"), ("x\n以上", "full"), ("x\nWhile the lot: was held and then", ""),
]


@pytest.mark.parametrize(("text", "want"), ENDINGS)
def test_closing_lines(text, want):
    before, last = text.rsplit("\n", 1)
    assert answers.closing_line(last, before.rsplit("\n", 1)[-1]) == want


def test_repaired_values_show_a_cut():
    assert answers.shape('{"a": 1,}', True).reason == "json"
    assert answers.shape('{"a": 1}', True).whole


def test_small_and_short_limits_show_by_their_spikes(spark):
    """A limit of 40 characters, three values at a limit, and repeats of one text, which are none."""
    rnd = random.Random(5)
    words = "lot depot clerk seal roster berth crate dock audit label".split()
    sentence = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [("forty", (sentence(20))[:40].rstrip().ljust(40, "x"), None) for _ in range(6)] + [("forty", sentence(rnd.randrange(2, 9)) + ".", None) for _ in range(60)]
    rows += [("three", sentence(99)[:300].rstrip().ljust(300, "x"), None) for _ in range(3)] + [("three", sentence(rnd.randrange(8, 90)) + ".", None) for _ in range(60)]
    rows += [("copies", "the lot and the depot and the clerk are", None)] * 9 + [("copies", sentence(9) + ".", None)] * 9
    df = frame(spark, rows)
    spikes = {(r.source, r.length) for r in truncation.length_spikes(truncation.length_histogram(df)).collect()}
    assert spikes == {("forty", 40), ("three", 300)}
    got = {r.row_id: r.rule for r in truncation.truncated(df).collect()}
    assert got == {**dict.fromkeys([*range(6), *range(66, 69)], "limit"), **dict.fromkeys(range(129, 138), "transfer")}


def test_without_punctuation_only_the_histogram_tells(spark):
    """Chat lines end bare: off the limits their endings prove nothing, at the limit they are cuts."""
    rnd = random.Random(7)
    words = "lot depot clerk seal roster berth crate dock audit label".split()
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [("chat", line(99)[:160].rstrip().ljust(160, "x"), None) for _ in range(20)] + [("chat", line(rnd.randrange(5, 24)), None) for _ in range(100)]
    rows += [("chat", "It was {", None), ("chat", "It was <cut>", None)]
    got = {r.row_id: r.rule for r in truncation.truncated(frame(spark, rows)).collect()}
    assert {k for k, v in got.items() if v == "limit"} >= set(range(20)) and got[121] == "transfer"
    assert len(got) <= 24


def test_spikes_show_the_limit_and_judge_loose_last_lines(spark):
    rnd = random.Random(3)
    full = "The desk noted the lot. " * 60
    rows = [("lane", str(1000 + i) + full[:196], None) for i in range(30)] + [("lane", full[: rnd.randrange(80, 190)].rstrip() + ".", None) for _ in range(100)]
    loose = "The desk noted the lot." * 8 + "\nNext step: pending"
    rows += [("lane", loose[-200:].rjust(200, "x"), None), (None, loose, None), ("lane", None, None)]
    df = frame(spark, rows)
    spikes = {(r.source, r.unit, r.length) for r in truncation.length_spikes(truncation.length_histogram(df)).collect()}
    assert spikes == {("lane", "chars", 200), ("lane", "bytes", 200)}
    got = {r.row_id: r.rule for r in truncation.truncated(df).collect()}
    assert set(got) == {*range(30), 130} and set(got.values()) == {"limit"}
    share = {r.source: (r.n_answers, r.n_truncated, r.n_at_limit, r.n_in_transfer) for r in truncation.truncation_by_source(df).collect()}
    assert share == {"lane": (132, 31, 31, 0), None: (1, 0, 0, 0)}


def test_the_jvm_shortcut_agrees_with_the_rule(spark):
    texts = [t for t in WHOLE + CUT + BLANK if t is not None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", truncation.surely_whole().alias("sure"))
    assert all(answers.shape(r.text).whole and not answers.shape(r.text).fragile for r in df.collect() if r.sure)


def test_the_automaton_covers_as_brute_force_does():
    rnd = random.Random(1)
    for _ in range(60):
        a, b = [rnd.choice("abc") for _ in range(rnd.randrange(1, 25))], [rnd.choice("abcd") for _ in range(rnd.randrange(0, 25))]
        grams = {tuple(a[i : i + 3]) for i in range(len(a) - 2)}
        hit = {j for i in range(len(b) - 2) if tuple(b[i : i + 3]) in grams for j in (i, i + 1, i + 2)}
        assert SuffixAutomaton(a).covered(b, 3) == len(hit)


PROMPT = "You are the billing desk. Control has passed to you with this note: The shipment of the lot was locked by the depot foreman until the roster changes. Which action is legal next, and why?"
GERMAN = "Die Buchhaltung sperrte die offene Rechnung wegen eines fehlenden Etiketts, und der Kundendienst war nicht da."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, "empty"), ("<empty>", "empty"), ("I'm sorry, but I can't help with this transfer; I hope you understand.", "refusal"),
        ('{"action": null, "message": "I have to decline this request."}', "refusal"), ("> " + PROMPT, "copied_prompt"), (json.dumps({"summary": PROMPT.upper()}), "copied_prompt"),
        (PROMPT.split(": ")[1].split(" Which")[0], "copied_prompt"), (GERMAN, "other_language"), ("Je ne peux pas aider pour cela, mes consignes ne le permettent pas.", "refusal"),
        ("I can't see any blocker on the lot, so the next action is to seal it.", None), ("Unfortunately, the lot was declined, so a new one must be issued.", None),
        ('The desk wrote "bis auf Weiteres" on the lot, and it was sealed by the owner.', None), ('{"a": "' + GERMAN + '"}', None), ('"I can\'t help with this" was what the note of the owner said to the desk.', None),
    ],
)
def test_defects(text, want):
    assert pairs.defect(text, pairs.Prompt(PROMPT)) == want


def test_defects_in_spark_with_missing_prompts_repeats_and_clashes(spark):
    prompts = spark.createDataFrame([("p", PROMPT, "x"), ("p", PROMPT, "y"), ("n", None, "z"), (None, "q", "z")], "prompt_hash string, prompt_text string, source string")
    rows = [("s", PROMPT, "p"), ("s", PROMPT, "p"), ("s", PROMPT, None), ("s", None, "n"), (None, "It is cut", "gone"), ("s", "word " * 200_000 + ".", "p"), ("s", GERMAN, "n")]
    got = {r.row_id: r.defect for r in pairs.defective(frame(spark, rows), prompts).collect()}
    assert got == {0: "copied_prompt", 1: "copied_prompt", 3: "empty", 4: "truncated"}


def test_tables_are_read_with_null_lists_and_extra_columns(spark, tmp_path):
    single = spark.createDataFrame([(1, "s", "Whole.", "h", "clash")], "artifact_id long, source string, raw_output string, prompt_hash string, tab string")
    many = spark.createDataFrame([(1, "s", ["a", None], ["h"], 0), (2, "s", None, ["h"], 0), (3, "s", [], None, 0)], "run_id long, source string, receiver_raw_outputs array<string>, prompt_hashes array<string>, turn int")
    single.write.parquet(str(tmp_path / "run_artifacts.parquet"))
    many.write.parquet(str(tmp_path / "pilot_runs.parquet"))
    got = sorted((r.tab, r.row_id, r.turn_no, r.text, r.prompt_hash) for r in answers.read_answers(spark, str(tmp_path)).fillna("NULL").collect())
    assert got == [("pilot_runs", 1, 0, "a", "h"), ("pilot_runs", 1, 1, "NULL", "NULL"), ("run_artifacts", 1, 0, "Whole.", "h")]
    none = frame(spark, [])
    assert truncation.truncated(none).count() == 0 and truncation.truncation_by_source(none).count() == 0
    assert pairs.defective(none, spark.createDataFrame([], "prompt_hash string, prompt_text string")).count() == 0
    assert answers.read_answers(spark, str(tmp_path)).filter(F.col("tab") == "x").count() == 0


def test_deep_answers_are_json_like_any_other():
    deep = '{"a": [' * 50_000 + '"the lot is sealed"' + "]}" * 50_000
    assert answers.shape(deep).kind == "json" and answers.shape(deep).whole and not answers.shape(deep[:-1]).whole
    assert answers.shape("[" * 60_000 + "]" * 60_000).kind == "blank"
    assert pairs.defect(deep, pairs.Prompt(PROMPT)) is None
