"""Votes for a language from script and function words; used where texts are prose of known languages."""

from __future__ import annotations

import re
from collections import Counter

from assaylake.llm.wordlists import STOPWORDS

WORD = re.compile(r"[^\W\d_]+")
KANA = re.compile(r"[぀-ヿ一-鿿ｦ-ﾟ]")
CYRILLIC = re.compile(r"[Ѐ-ӿ]")
LATIN = re.compile(r"[A-Za-zÀ-ɏ]")

_VOTES: dict[str, tuple[str, ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _word in dict.fromkeys(_words):
        _VOTES[_word] = (*_VOTES.get(_word, ()), _lang)


def vote(text: str) -> tuple[str | None, float, int]:
    """(language or None, its lead over the next one as a share of its votes, votes). Scripts of one language decide alone."""
    kana, cyrillic, latin = len(KANA.findall(text)), len(CYRILLIC.findall(text)), len(LATIN.findall(text))
    signs = kana * 3 + cyrillic + latin
    if not signs:
        return None, 0.0, 0
    if kana * 3 > 0.5 * signs:
        return "ja", kana * 3 / signs, kana
    if cyrillic > 0.5 * signs:
        return "ru", cyrillic / signs, cyrillic
    votes: Counter[str] = Counter()
    for word, n in Counter(WORD.findall(text.lower())).items():
        for lang in _VOTES.get(word, ()):
            votes[lang] += n
    if not votes:
        return None, 0.0, 0
    (best, most), *rest = sorted(votes.items(), key=lambda x: (-x[1], x[0]))
    return best, 1 - (rest[0][1] / most if rest else 0), most
