"""Refusals: an automaton over classes of words, in nine languages.

A sentence refuses if its words pass through the speaker (I), an ability or will of the speaker (M), its negation (G) and an act
of answering or helping (A), in the order and the nearness that the language asks for; or through the speaker and declining
outright (D) with what is declined (O). Verbs that speak in the first person (F) are speaker and ability in one. Acts that could
be anything (giving, doing) count only with an object of answering (O). A conjunction (B) between the negation and the act breaks
the chain, so what somebody else can't do is no refusal. Japanese, without spaces, is read by signs.

Only the first two sentences and the last one of a text are asked, outside quotation marks: an answer that refuses does so where
it begins or ends, however long it is; sentences in its middle tell of others' limits.
"""

from __future__ import annotations

import re
from functools import lru_cache

from assaylake.llm.wordlists import REFUSALS, REFUSALS_JA, REFUSING_TURNS

QUOTED = re.compile(r"[“\"„«「『][^“”\"„»«「」『』]*[”\"“»」』]")
SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n+")
WORD = re.compile(r"[^\W\d_]+")
CONTRACTED = ((re.compile(r"\bcan ?not\b|\bcan't\b"), "can not"), (re.compile(r"\bwon't\b"), "will not"), (re.compile(r"n't\b"), " not"), (re.compile(r"'m\b"), " am"), (re.compile(r"\bi'd\b"), "i would"), (re.compile(r"'ll\b"), " will"), (re.compile(r"'re\b"), " are"))
#: Words between ability and negation, negation and act, speaker and ability, declining and its object.
NEAR_MODAL = {"de": 6, "nl": 5}
NEAR_ACT, NEAR_SPEAKER, NEAR_OBJECT, NEAR_DECLINE, SIGNS = 6, 5, 5, 6, 12


@lru_cache(1)
def classes() -> tuple[dict[str, dict[str, frozenset[str]]], dict[str, frozenset[str]]]:
    """Per language its classes of words, A split into A (always) and W (with an object); and the languages of each trigger."""
    by: dict[str, dict[str, frozenset[str]]] = {}
    triggers: dict[str, set[str]] = {}
    for lang, parts in REFUSALS.items():
        sets = {name: frozenset(words.split()) for name, words in parts.items()}
        sets["W"] = frozenset(w[:-1] for w in sets["A"] if w.endswith("*"))
        sets["A"] = frozenset(w for w in sets["A"] if not w.endswith("*"))
        sets.setdefault("F", frozenset())
        by[lang] = sets
        for word in sets["G"] | sets["D"]:
            triggers.setdefault(word, set()).add(lang)
    return by, {w: frozenset(langs) for w, langs in triggers.items()}


def _refusing(words: list[str], lang: str) -> bool:
    c = classes()[0][lang]
    both_ways = lang != "en"
    size = len(words)
    some = lambda kind, a, b, skip=-1: any(words[i] in c[kind] and i != skip for i in range(max(0, a), min(size, b)))
    speaker = lambda at, reach: some("I", at - reach, at + reach + 1) or some("F", at - reach, at + reach + 1)
    for at, word in enumerate(words):
        if word in c["G"]:
            reach = NEAR_MODAL.get(lang, 3)
            able = any(
                words[m] in c["F"] or (words[m] in c["M"] and some("I", m - NEAR_SPEAKER, m + NEAR_SPEAKER + 1))
                for m in range(max(0, at - reach), min(size, at + (reach + 1 if both_ways else 0)))
            )
            if able:
                for act in range(at + (0 if word in c["A"] | c["W"] else 1), min(size, at + NEAR_ACT + 1)):
                    if words[act] in c["B"]:
                        break
                    if words[act] in c["A"] or (words[act] in c["W"] and some("O", act - (NEAR_OBJECT if both_ways else 4), act + NEAR_OBJECT, act)):
                        return True
        if word in c["D"] and speaker(at, NEAR_DECLINE):
            after = min(size, at + 4)
            if word == "pass":
                if at + 1 < size and words[at + 1] == "on":
                    return True
            elif at >= size - 2 or some("O", at + 1, after) or (lang in ("de", "nl") and some("O", at - 5, at)):
                return True
    return False


def _refusing_ja(sentence: str) -> bool:
    if any(x in sentence for x in REFUSALS_JA["D"]):
        return True
    for act in REFUSALS_JA["A"]:
        at = sentence.find(act)
        while at >= 0:
            behind = sentence[at + len(act) : at + len(act) + SIGNS]
            if any(x in behind for x in REFUSALS_JA["G"]):
                return True
            at = sentence.find(act, at + 1)
    return False


def refuses(text: str) -> bool:
    """Whether the text's opening or closing sentence declines to answer, outside quotation marks."""
    plain = QUOTED.sub(" ", text.lower().replace("’", "'"))
    sentences = [s for s in SENTENCE.split(plain) if s and not s.isspace()]
    triggers = classes()[1]
    for sentence in dict.fromkeys(sentences[:2] + sentences[-1:]):
        if any("぀" <= ch <= "ヿ" for ch in sentence):
            if _refusing_ja(sentence):
                return True
            continue
        for old, new in CONTRACTED:
            if "'" in sentence or "cannot" in sentence:
                sentence = old.sub(new, sentence)
        words = WORD.findall(sentence)
        langs = {lang for w in words if w in triggers for lang in triggers[w]}
        joined = " ".join(words)
        if any(turn in joined for turn in REFUSING_TURNS):
            return True
        if any(_refusing(words, lang) for lang in langs):
            return True
    return False
