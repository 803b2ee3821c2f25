"""Languages of documents and of their segments.

Method: language-bitmask n-gram filters. A Bloom filter per language, all in one array of bit slices: a slot holds a bit per
language, and the AND of an n-gram's slots is the set of all languages that (seem to) contain it. A segment's count per language
is corrected for the filter's false positives; the language with the largest count wins, and the lead over the next one, as a
share of the segment's n-grams, is the confidence.

The filters are learned from at most SAMPLE labelled texts per language of at most LONGEST characters (documented bounds), of
which only segments count whose function words or script agree with the label, since labels are partly wrong. Function words and
kana are in the filters from the start, so that a language without labelled texts is still told. Every language, also those
with a script of their own, is decided by its n-grams in the filters. Everything else reads all texts.

Labels are compared without case and region: codes of two and three letters and English or own names. A label that is null,
blank or names none of these and no other language is missing. Null, empty and language-free texts have no language and give no
rows. Repeated rows are each judged.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions import deepjson
from assaylake.functions.arrow import map_rows
from assaylake.llm.answers import INVISIBLE
from assaylake.llm.languages import KANA, vote
from assaylake.llm.wordlists import STOPWORDS

LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ru", "ja")
#: At most so many labelled texts per language are learned from, none longer than LONGEST (so the sample's size is bounded).
SAMPLE, LONGEST = 250, 20_000
SLOTS, HASHES = 1 << 20, 3
#: A language has an n-gram if its rate is at least this share of the highest rate among the languages.
RATE = 0.15
#: A segment counts with so many words (or signs of scripts without spaces) and such a confidence.
LEAST_WORDS, LEAST_SIGNS, CONFIDENT = 4, 8, 0.04

# Names of the nine languages beside their two-letter codes.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "ru": "ru rus russian русский",
    "ja": "ja jpn japanese 日本語",
}

#: Runs of letters that touch no digit: parts of hashes and identifiers are no words.
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)?(?!\w)|[぀-ヿ一-鿿ｦ-ﾟー]+")
#: Quoted phrases have no say in their sentence's language.
QUOTED = re.compile(r"[\"“„«「『][^\"“”„«»「」『』]{1,40}[\"”“»」』]")
WIDE = re.compile(r"[぀-ヿ一-鿿ｦ-ﾟー]")
#: A segment ends behind a sentence end, or at a line end.
SPLIT = re.compile(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+|(?<=[。！？])[」』）]*\s*|[\r\n ]+")
NO_TEXT = re.compile(f"[{INVISIBLE}\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")


def named_language(label: Column | str) -> Column:
    """The two-letter code of one of LANGUAGES, or null."""
    base = F.regexp_extract(F.lower(F.trim(F.regexp_replace(label, r"^[\s]+|[\s]+$", ""))), r"^(\p{L}+)", 1)
    pairs = [F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code)]
    return F.try_element_at(F.create_map(*pairs), base)


def strings_in(text: str) -> list[str]:
    """A JSON document's string values, or the text itself."""
    bare = text.strip()
    if bare[:1] in ("{", "["):
        try:
            return deepjson.strings_in(deepjson.loads(bare, strict=False))
        except ValueError:
            return [text]
    return [text]


def segments(text: str) -> list[str]:
    """Sentences and lines of a text, in order."""
    return [s for part in strings_in(text) for s in SPLIT.split(NO_TEXT.sub("", part)) if s and not s.isspace()]


def units(segment: str) -> list[str]:
    """Words, and for scripts without spaces overlapping pairs of signs."""
    out: list[str] = []
    for word in WORD.findall(segment):
        if WIDE.search(word):
            out.extend(word[i : i + 2] for i in range(max(1, len(word) - 1)))
        else:
            out.append(word.lower().replace("’", "'"))
    return out


def ngrams(unit: str) -> list[str]:
    """The unit as a whole, and the runs of three and four letters of the unit with blanks around it."""
    if WIDE.match(unit):
        return [unit, *unit] if len(unit) > 1 else [unit]
    padded = f" {unit} "
    return [padded, *(padded[i : i + n] for n in (3, 4) for i in range(len(padded) - n + 1))]


def slots(gram: str) -> list[int]:
    h = xxhash.xxh3_128_intdigest(gram)
    return [(h >> 40 * i & 0xFFFFFFFFFF) % SLOTS for i in range(HASHES)]


class Filters:
    """The bit slices, and per language the share of unknown n-grams that it seems to contain."""

    def __init__(self) -> None:
        self.masks = np.zeros(SLOTS, np.uint16)
        self.wrong = np.zeros(len(LANGUAGES))

    def add(self, gram: str, mask: int) -> None:
        for slot in slots(gram):
            self.masks[slot] |= mask

    def close(self) -> Filters:
        filled = np.array([(self.masks >> i & 1).mean() for i in range(len(LANGUAGES))])
        self.wrong = filled**HASHES
        return self

    def languages_of(self, gram: str) -> int:
        a, b, c = slots(gram)
        return int(self.masks[a] & self.masks[b] & self.masks[c])


def learned(texts: list[tuple[str, str]]) -> Filters:
    """Filters from (language, text) pairs and from the function words."""
    counts: dict[str, Counter[str]] = defaultdict(Counter)
    total: Counter[str] = Counter()
    for label, text in texts:
        for segment in segments(text):
            got, lead, votes = vote(segment)
            if got == label and votes >= 2 and lead >= 0.1:
                total[label] += 1
                for gram in {g for u in units(segment) for g in ngrams(u)}:
                    counts[gram][label] += 1
    filters = Filters()
    for gram, by in counts.items():
        rates = {lang: n / total[lang] for lang, n in by.items()}
        most = max(rates.values())
        filters.add(gram, sum(1 << LANGUAGES.index(lang) for lang, r in rates.items() if r >= RATE * most))
    for lang, words in STOPWORDS.items():
        for word in words:
            filters.add(f" {word} ", 1 << LANGUAGES.index(lang))
    for n in (*range(0x3041, 0x3097), *range(0x30A1, 0x30FB)):
        filters.add(chr(n), 1 << LANGUAGES.index("ja"))
    return filters.close()


class Judge:
    """Decides the language of segments; keeps what it knows of at most `keep` units."""

    def __init__(self, filters: Filters, keep: int = 200_000) -> None:
        self.filters, self.keep = filters, keep
        self.place: dict[str, int] = {}
        self.table = np.zeros((1024, len(LANGUAGES) + 1))

    def _learn(self, unit: str) -> int:
        at = self.place[unit] = len(self.place)
        if at >= len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        grams = ngrams(unit)
        masks = [self.filters.languages_of(g) for g in grams]
        self.table[at, -1] = len(grams)
        for i in range(len(LANGUAGES)):
            self.table[at, i] = sum(m >> i & 1 for m in masks)
        return at

    def counts(self, found: list[str]) -> np.ndarray:
        """n-grams by language, corrected for false positives, and their number."""
        if len(self.place) + len(found) > self.keep:
            self.place.clear()
        place = self.place
        rows = [place[u] if u in place else self._learn(u) for u in found]
        sums = self.table[rows].sum(0)
        wrong = self.filters.wrong
        sums[:-1] = np.maximum(0, (sums[:-1] - sums[-1] * wrong) / (1 - wrong))
        return sums

    def segment(self, text: str) -> tuple[str, float, bool] | None:
        """(language, confidence, whether it is a sentence of its own) or None if it has no language."""
        bare = QUOTED.sub(" ", text)
        if found := units(bare):
            text = bare
        elif not (found := units(text)):
            return None
        wide = sum(1 for u in found if WIDE.match(u))
        if wide * 2 >= len(found) and not KANA.search(text):
            return None  # signs that Japanese shares with others
        sums = self.counts(found)
        first, second = np.argsort(-sums[:-1], kind="stable")[:2]
        confidence = float((sums[first] - sums[second]) / max(1.0, sums[-1]))
        if sums[first] <= 0 or sums[first] < 0.2 * sums[-1]:
            return None
        enough = wide >= LEAST_SIGNS if wide * 2 >= len(found) else len(found) >= LEAST_WORDS
        return LANGUAGES[first], confidence, enough and confidence >= CONFIDENT


def sampled(documents: DataFrame, most: int = SAMPLE) -> list[tuple[str, str]]:
    """At most `most` labelled texts of each language, none longer than LONGEST: those with the smallest hashes of their ids."""
    named = documents.select(named_language("lang").alias("label"), "doc_id", "text").filter(F.col("label").isNotNull() & (F.length("text") <= LONGEST))
    counts = {r.label: r.n for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out: list[tuple[str, str]] = []
    picked = None
    for label, n in sorted(counts.items()):
        share = min(1.0, 1.5 * most / n + 20 / n)
        one = (F.col("label") == label) & (F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        picked = one if picked is None else picked | one
    if picked is None:
        return out
    taken: Counter[str] = Counter()
    for r in named.filter(picked).orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if taken[r.label] < most:
            taken[r.label] += 1
            out.append((r.label, r.text))
    return out


def language_segments(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, label (two letters or null), segment_no, n_chars, lang, confidence, sentence: runs of one language joined."""
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def make():
        judge = Judge(shared.value)

        def row(doc_id, label, text):
            runs: list[list] = []
            for segment in segments(text or ""):
                got = judge.segment(segment)
                if got is None:
                    continue
                lang, confidence, sentence = got
                if not sentence and runs and confidence < CONFIDENT:
                    lang = runs[-1][1]
                if runs and runs[-1][1] == lang:
                    last = runs[-1]
                    last[0] += len(segment)
                    last[2] += confidence * len(segment)
                    last[3] = last[3] or sentence
                else:
                    runs.append([len(segment), lang, confidence * len(segment), sentence])
            for n, (size, lang, sure, sentence) in enumerate(runs):
                yield doc_id, label, n, size, lang, sure / size, sentence

        return row

    named = documents.select("doc_id", named_language("lang").alias("label"), "text").filter("text is not null")
    schema = "doc_id long, label string, segment_no long, n_chars long, lang string, confidence double, sentence boolean"
    return map_rows(named, ["doc_id", "label", "text"], make, schema)


def document_languages(documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, label, langs (with a full sentence; the largest part's where there is none), confidence, main_lang.

    The segments of a document leave one task, so no shuffle is needed: languages are gathered there.
    """
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def make():
        judge = Judge(shared.value)

        def row(doc_id, label, text):
            size: Counter[str] = Counter()
            sure: Counter[str] = Counter()
            full = set()
            for segment in segments(text or ""):
                got = judge.segment(segment)
                if got:
                    lang, confidence, sentence = got
                    size[lang] += len(segment)
                    sure[lang] += confidence * len(segment)
                    if sentence:
                        full.add(lang)
            if size:
                main = max(full or size, key=lambda x: (size[x], x))
                langs = sorted(full or {main})
                yield doc_id, label, langs, [sure[x] / size[x] for x in langs], main

        return row

    named = documents.select("doc_id", named_language("lang").alias("label"), "text").filter("text is not null")
    return map_rows(named, ["doc_id", "label", "text"], make, "doc_id long, label string, langs array<string>, confidences array<double>, main_lang string")


def mislabelled(judged: DataFrame) -> DataFrame:
    """doc_id, lang, confidence: the languages of each document whose label is missing or wrong, or that mixes languages."""
    cases = judged.filter((F.size("langs") > 1) | ~F.coalesce(F.col("label") == F.element_at("langs", 1), F.lit(False)))
    return cases.select("doc_id", F.explode(F.arrays_zip(F.col("langs").alias("lang"), F.col("confidences").alias("confidence"))).alias("x")).select("doc_id", "x.lang", "x.confidence")
