"""Defects of prompt-response pairs: one verdict per answer.

Method: the answer runs through a suffix automaton of its prompt's words, which measures the copied share; refusal phrases
are found by an automaton over classes of words (`refusals`); truncation by the delimiter stack and sentence ends of `answers`
and the length limits of `truncation`; the language by votes of function words.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions import deepjson
from assaylake.functions.arrow import map_rows
from assaylake.llm.answers import CLOSERS, CUT_MARK, TERMINAL, Shape, closing_line, shape, visible
from assaylake.llm.languages import vote
from assaylake.llm.suffix_automaton import SuffixAutomaton
from assaylake.llm.truncation import ending, rule_of, source_marks, with_lengths
from assaylake.llm.refusals import refuses

#: An answer is a copy if so much of its words lies in runs of four or more words of the prompt; prose of another language
#: needs so many votes and such a lead over the next language, as must the prompt.
COPIED, SHORTEST_COPY, RUN = 0.8, 8, 4
VOTES, LEAD = 3, 0.1
#: Endings that are cuts only at a limit, or only in sources with punctuation.
UNSURE = ("loose", "sentence")

TOKENS = re.compile(r"[^\W_]+")


def bare_prose(body: str) -> str:
    """Prose without code blocks and closing lines, whose words have no language."""
    body = re.sub(r"```.*?(?:```|$)", " ", body, flags=re.S)
    return "\n".join(line for line in body.split("\n") if line.rstrip(CLOSERS)[-1:] in TERMINAL or not closing_line(line.strip(), ""))


class Prompt:
    """A prompt's automaton and language, made when first needed."""

    __slots__ = ("_automaton", "_language", "text")

    def __init__(self, text: str) -> None:
        self.text, self._automaton, self._language = text, None, None

    @property
    def automaton(self) -> SuffixAutomaton:
        if self._automaton is None:
            self._automaton = SuffixAutomaton(TOKENS.findall(self.text.lower()))
        return self._automaton

    @property
    def language(self) -> tuple[str | None, float, int]:
        if self._language is None:
            self._language = vote(self.text)
        return self._language


def defect(text: str | None, prompt: Prompt | None, known: Shape | None = None) -> str | None:
    """'empty', 'refusal', 'copied_prompt', 'other_language' or None, in this order of precedence; whether it is cut, set aside."""
    got = known or shape(text)
    if got.kind == "blank":
        return "empty"
    if got.kind == "json":
        strings = [s for s in deepjson.strings_in(got.value) if len(s) >= 20]
        if not strings:
            return None
        body = "\n".join(strings)
        if refuses(body) and len(strings) == 1:
            return "refusal"
    else:
        body = visible(text)
        if refuses(body):
            return "refusal"
    if prompt is None:
        return None
    words = TOKENS.findall(body.lower())
    if got.kind == "json":
        if len(words) >= SHORTEST_COPY and prompt.automaton.covered(words, RUN) >= COPIED * json_words(got.value):
            return "copied_prompt"
        return None
    if len(words) >= SHORTEST_COPY and prompt.automaton.covered(words, RUN) >= COPIED * len(words):
        return "copied_prompt"
    lang, lead, votes = vote(bare_prose(CUT_MARK.sub("", body)))
    if lang and votes >= VOTES and lead >= LEAD:
        asked, asked_lead, asked_votes = prompt.language
        if asked and asked != lang and asked_votes >= VOTES and asked_lead >= LEAD:
            return "other_language"
    return None


def json_words(value: object) -> int:
    """Words of all string values of a JSON answer, so that a copy beside other content isn't nothing but a copy."""
    return sum(len(TOKENS.findall(s)) for s in deepjson.strings_in(value))


def defective(answers: DataFrame, prompts: DataFrame) -> DataFrame:
    """tab, row_id, turn_no, source, defect of every defective answer.

    Answers meet their prompt by an equality join on its hash, sorted so that a task sees each prompt's answers together and
    builds its automaton once; answers without a hash skip the join. An answer whose prompt is missing or null can still be
    empty, truncated or a refusal. Of prompts that repeat under one hash the smallest text counts. Null elements of a list of
    answers are empty answers; hashes beyond the answers are none.
    """
    texts = prompts.filter("prompt_hash is not null").groupBy("prompt_hash").agg(F.min("prompt_text").alias("prompt_text"))
    columns = ["tab", "row_id", "turn_no", "source", "text", "repaired", "chars", "bytes", "prompt_hash", "prompt_text"]
    marks = source_marks(answers)
    sized = with_lengths(answers)
    joined = sized.filter("prompt_hash is not null").join(texts, "prompt_hash", "left").select(columns)
    alone = sized.filter("prompt_hash is null").withColumn("prompt_text", F.lit(None).cast("string")).select(columns)

    def make():
        at: list = [None, None]

        def row(tab, row_id, turn_no, source, text, repaired, chars, length_bytes, prompt_hash, prompt_text):
            if prompt_text is None:
                prompt = None
            elif at[0] == prompt_hash:
                prompt = at[1]
            else:
                at[:] = prompt_hash, Prompt(prompt_text)
                prompt = at[1]
            got = shape(text, repaired)
            end = ending(got)
            other = None if end and end not in UNSURE else defect(text, prompt, got)
            if end or other:
                yield tab, row_id, turn_no, source, end, chars, length_bytes, other

        return row

    schema = "tab string, row_id long, turn_no long, source string, ending string, chars long, bytes long, other string"
    found = map_rows(joined.unionAll(alone), columns, make, schema).alias("f")
    on = (F.col("f.tab") == F.col("l.tab")) & F.col("f.source").eqNullSafe(F.col("l.source"))
    cut = rule_of(F.col("ending"), F.col("chars"), F.col("bytes")).isNotNull()
    return (
        found.join(marks.alias("l"), on, "left")
        .select("f.tab", "row_id", "turn_no", "f.source", F.when(cut, "truncated").otherwise(F.col("other")).alias("defect"))
        .filter("defect is not null")
    )
