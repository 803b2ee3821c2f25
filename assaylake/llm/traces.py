"""Texts of traces and observations, their words, and their sets of adjacent word pairs as numbers."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame

from assaylake.functions import deepjson
from assaylake.functions.arrow import map_rows

TOKEN = re.compile(r"\w+")
#: Texts of fewer words don't count.
LEAST_WORDS = 8


def trace_text(contents: list[str | None] | None) -> str:
    """The string values of the contents in order, without keys. A content that is no JSON counts as it stands."""
    out: list[str] = []
    for content in contents or ():
        if content:
            try:
                out += deepjson.strings_in(deepjson.loads(content))
            except ValueError:
                out.append(content)
    return "\n".join(out)


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; tokens with a digit are dropped."""
    out = []
    for token in TOKEN.findall(text.lower()):
        if token.isalpha():
            out.append(token)
        elif not any(c.isdigit() for c in token):
            out.extend(x for x in token.split("_") if x)
    return out


class PairHasher:
    """Words to the sorted array of their distinct adjacent pairs, as 31-bit numbers; the words' hashes are kept."""

    def __init__(self, keep: int = 1 << 18) -> None:
        self.known: dict[str, int] = {}
        self.keep = keep

    def word_hashes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.keep:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))

    def pairs(self, words: list[str]) -> np.ndarray:
        h = self.word_hashes(words)
        x = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((x >> np.uint64(33)).astype(np.int32))


def pair_sets(texts: DataFrame, from_trace: bool) -> DataFrame:
    """tab, id, kind (a hash of the set: equal for equal texts), grams (the set); of texts of at least LEAST_WORDS words.

    texts: tab, id, text (a string, or with from_trace the list of contents).
    """

    def make():
        hasher = PairHasher()

        def row(tab, id_, text):
            words = words_of(trace_text(text) if from_trace else text or "")
            if len(words) >= LEAST_WORDS:
                grams = hasher.pairs(words)
                yield tab, id_, xxhash.xxh64_intdigest(grams.tobytes()) - (1 << 63), grams

        return row

    return map_rows(texts, ["tab", "id", "text"], make, "tab string, id long, kind long, grams array<int>")
