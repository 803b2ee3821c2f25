"""Evaluation texts inside training texts.

Method: SimHash fingerprints of windows, found in a multi-index of Hamming blocks, then exact weighted similarity. Every window
of WINDOW words of an item gets a 64-bit fingerprint of its words, each with its weight (rare among the items: heavy); the
fingerprints are indexed under their four 16-bit blocks, so that whatever differs in at most RADIUS = 3 bits shares a block with
it and is found; the windows of documents are looked up in the same way. Nothing else makes a candidate: places that no
fingerprint found are never compared.

A found window fixes an alignment of item and document. Along it and the alignments beside it (a word put in or left out), words
are compared one by one: a run is a stretch of equal words in which single words may differ if enough equal words stand on both
sides, also across a single word put in or left out; a passage is any part of a run, from an equal word to an equal word, of
PASSAGE words or more and a weighted similarity (the weight of its equal words in that of all its words) of ALIKE. A run that
falls below that as a whole so still counts with the parts that reach it. By RUNS, the equal words beside a changed one are four,
or two in passages of half the length more, so that words at the ends of an edited excerpt count, but not the scraps that a long text
of the same standing phrases holds.
Standing phrases with other names in them fall to the weights, since the names are what weighs. An item is leaked if its
passages hold at least `share` of its words.

The named windows of an item's size can't find items of which half stands in the text in several pieces and in another order
(their fingerprints differ in a third of the bits), or of which every eighth word is changed (a sixth of the bits), so windows
are shorter than the smallest passage that counts, and changed words fall between them or weigh little.

Texts are compared without case, punctuation, white space, HTML and JSON escapes, and invisible characters. Items never pass
through the driver: their words meet their weights by a join, and shards of at most about SHARD_WORDS words are indexed by
executors and stored in the shared folder. Documents are never shuffled; each task reads its documents once, in blocks, and
passes each block through the shards. Null and empty texts and texts under WINDOW words give no rows; repeated rows are each
reported; items under PASSAGE words are leaked by nothing.
"""

from __future__ import annotations

import html
import pickle
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.arrow import map_rows
from assaylake.llm.answers import INVISIBLE
from assaylake.llm.stored import load_stored
from assaylake.session import materialize, shared_folder

WINDOW, RADIUS, PASSAGE, ALIKE, SHARE = 6, 3, 8, 0.8, 0.5
#: Equal words that must stand on either side of a changed one, with the least words of a passage.
RUNS = ((4, PASSAGE), (2, 3 * PASSAGE // 2))
#: Words in one index; characters of documents held at a time.
SHARD_WORDS, BLOCK_CHARS = 60_000, 4_000_000
#: Windows of a document looked up at a time, so that a very long one can't fill a task's memory.
AT_ONCE = 100_000

WORDS = re.compile(r"[^\W_]+")
ESCAPED = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtbf\"'/\\])")
UNSEEN = re.compile(f"[{INVISIBLE}‎‏‪-‮⁡-⁤\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
WIDE = re.compile(r"([぀-ヿ一-鿿ｦ-ﾟ])")


def plain_words(text: str) -> list[str]:
    """Words after undoing escapes; signs of scripts without spaces are words of their own."""
    if "\\" in text:
        text = ESCAPED.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else " ", text)
    if "&" in text:
        text = html.unescape(text)
    text = unicodedata.normalize("NFKC", UNSEEN.sub("", text)).casefold()
    return WORDS.findall(WIDE.sub(r" \1 ", text))


class WordNumbers:
    """Stable 64-bit numbers of words, with a bounded table."""

    def __init__(self, keep: int = 1 << 18) -> None:
        self.known: dict[str, int] = {}
        self.keep = keep

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.keep:
            self.known.clear()
        known = self.known
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter((known[w] for w in words), np.uint64, len(words))


def fingerprints(numbers: np.ndarray, weights: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The SimHash of each window of words, whatever their order."""
    if len(numbers) < size:
        return np.empty(0, np.uint64)
    signs = np.unpackbits(numbers.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(numbers) + 1, 64), np.int32)
    np.cumsum(signs * np.round(weights * 4).astype(np.int32)[:, None], axis=0, out=sums[1:])
    return np.packbits(sums[size:] - sums[:-size] > 0, axis=1).view(np.uint64).ravel()


class ItemIndex:
    """The windows of a shard of items by the blocks of their fingerprints, and the items' words to verify them."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], heaviest: float) -> None:
        """items: (item_id, word numbers, weights), words in order; heaviest: the weight of words that no item has."""
        items = [x for x in items if len(x[1]) >= PASSAGE]
        self.ids = [i for i, _, _ in items]
        self.words, self.weights, self.heaviest = [n for _, n, _ in items], [w for _, _, w in items], heaviest
        self.size = np.array([len(n) for n in self.words], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        every = np.concatenate([*self.words, np.empty(0, np.uint64)])
        self.every = every
        self.known, first = np.unique(every, return_index=True)
        self.weight = np.concatenate([*self.weights, np.empty(0, np.float32)])[first]
        prints = [fingerprints(n, w) for n, w in zip(self.words, self.weights, strict=True)]
        self.owner = np.repeat(np.arange(len(items)), [len(p) for p in prints])
        self.place = np.concatenate([*[np.arange(len(p)) for p in prints], np.empty(0, np.int64)]).astype(np.int64)
        self.prints = np.concatenate([*prints, np.empty(0, np.uint64)])
        blocks = self.prints.view(np.uint16).reshape(-1, 4)
        self.order = [np.argsort(blocks[:, b], kind="stable") for b in range(4)]
        self.start = [np.searchsorted(blocks[o, b], np.arange(65537)) for b, o in enumerate(self.order)]

    def weights_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' weights, and which of them any item has."""
        at = np.minimum(np.searchsorted(self.known, numbers), max(0, len(self.known) - 1))
        there = self.known[at] == numbers
        return np.where(there, self.weight[at], self.heaviest).astype(np.float32), there

    def near(self, prints: np.ndarray) -> np.ndarray:
        """Rows (item, place in the item, place in the text) of all windows whose fingerprints lie within the radius."""
        found = []
        blocks = prints.view(np.uint16).reshape(-1, 4)
        for b in range(4):
            first, last = self.start[b][blocks[:, b]], self.start[b][blocks[:, b].astype(np.int64) + 1]
            n = last - first
            if n.any():
                left = np.repeat(np.arange(len(prints)), n)
                right = self.order[b][np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())]
                close = np.bitwise_count(prints[left] ^ self.prints[right]) <= RADIUS
                left, right = left[close], right[close]
                found.append(np.stack([self.owner[right], self.place[right], left], 1))
        return np.concatenate(found) if found else np.empty((0, 3), np.int64)

    def leaked(self, numbers: np.ndarray, share: float = SHARE) -> list[tuple[int, float]]:
        """(item id, share of its words) of the items that stand in a text of these words."""
        if len(numbers) < WINDOW or not len(self.prints):
            return []
        seeds = []
        for at in range(0, len(numbers) - WINDOW + 1, AT_ONCE):
            part = numbers[at : at + AT_ONCE + WINDOW - 1]
            weights, there = self.weights_of(part)
            counted = np.concatenate([[0], np.cumsum(there)])
            # windows of which an item has less than half the words can only be near by chance
            some = np.flatnonzero(counted[WINDOW:] - counted[:-WINDOW] >= WINDOW // 2)
            if len(some):
                pairs = self.near(fingerprints(part, weights)[some])
                seeds.append(np.stack([pairs[:, 0], some[pairs[:, 2]] + at - pairs[:, 1]], 1))
        found = np.concatenate(seeds) if seeds else np.empty((0, 2), np.int64)
        if not len(found):
            return []
        # (item, alignment) in order: one number each, which sorts faster than pairs
        span = int(self.size.max()) + len(numbers) + 1
        coded = np.unique(found[:, 0] * span + found[:, 1] + int(self.size.max()))
        item, shift = coded // span, coded % span - int(self.size.max())
        out = []
        for n in self.possible(item, shift, numbers, share):
            here = shift[item == n]
            part = float(self.covered(n, numbers, np.unique(np.concatenate([here - 1, here, here + 1])).tolist()).mean())
            if part >= share:
                out.append((self.ids[n], part))
        return out

    def possible(self, item: np.ndarray, shift: np.ndarray, numbers: np.ndarray, share: float) -> list[int]:
        """The items whose equal words on all alignments, with as many others beside them, could reach the share."""
        size = self.size[item]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        place = np.arange(size.sum()) - np.repeat(starts, size)
        target = place + np.repeat(shift, size)
        fits = (target >= 0) & (target < len(numbers))
        same = fits & (self.every[place + np.repeat(self.first[item], size)] == numbers[np.where(fits, target, 0)])
        equal = np.bincount(item, np.add.reduceat(same.astype(np.int64), starts), len(self.size))
        return np.flatnonzero(equal * 2 >= share * self.size).tolist() if share > 0 else np.unique(item).tolist()

    def covered(self, item: int, numbers: np.ndarray, shifts: list[int]) -> np.ndarray:
        """Which words of the item lie in passages on these alignments (place in the text minus place in the item)."""
        words, weights = self.words[item], self.weights[item].astype(np.float64)
        size, ends = len(words), len(numbers)
        inside = np.zeros(size, bool)
        at = np.arange(size)[None, :] + np.asarray(shifts, np.int64)[:, None]
        fits = (at >= 0) & (at < ends)
        same_on = fits & (words[None, :] == numbers[np.where(fits, at, 0)])
        # the shortest run has three equal words
        equal = {shifts[i]: same_on[i] for i in np.flatnonzero(same_on.sum(1) >= 3).tolist()}
        for beside, least in RUNS:
            runs = [(shift, first, last) for shift, same in equal.items() for first, last in runs_of(bridged(same, beside), beside)]
            for chain in chains(sorted(runs, key=lambda r: (r[1], r[2], r[0]))):
                first, last = chain[0][1], chain[-1][2]
                if last - first >= least and not inside[first:last].all():
                    same = np.zeros(last - first, bool)
                    for shift, a, b in chain:
                        same[a - first : b - first] = equal[shift][a:b]
                    inside[first:last] |= in_passages(same, weights[first:last], least)
        return inside


def in_passages(same: np.ndarray, weights: np.ndarray, least: int = PASSAGE) -> np.ndarray:
    """Which places lie in some stretch of at least that many places, from an equal one to an equal one, whose equal weight is ALIKE of its weight."""
    sums = np.concatenate([[0.0], np.cumsum(np.where(same, 1 - ALIKE, -ALIKE) * weights)])
    ends = np.concatenate([[-np.inf], np.where(same, sums[1:], -np.inf)])
    best = np.maximum.accumulate(ends[::-1])  # the largest sum at the end or behind it, from the last end on: rises
    starts = np.flatnonzero(same)
    last = len(same) - np.searchsorted(best, sums[starts] - 1e-9)  # the last end that reaches the start's sum
    long = last - starts >= least
    edges = np.zeros(len(same) + 1, np.int64)
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, last[long], -1)
    return np.cumsum(edges)[:-1] > 0


def bridged(same: np.ndarray, beside: int) -> np.ndarray:
    """same, and single places between at least `beside` true ones on either side."""
    padded = np.concatenate([np.zeros(beside, bool), same, np.zeros(beside, bool)])
    size = len(same)
    sides = np.ones(size, bool)
    for k in range(1, beside + 1):
        sides &= padded[beside - k : beside - k + size] & padded[beside + k : beside + k + size]
    return same | sides


def runs_of(flags: np.ndarray, beside: int) -> list[tuple[int, int]]:
    """(start, end) of the runs of more than `beside` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a > beside]


def chains(runs: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Runs (shift, start, end) alone, and joined with a run behind a single word put in or left out of the text."""
    open_at: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for run in runs:
        shift, start, end = run
        before = open_at.get((shift - 1, start)) or open_at.get((shift + 1, start - 1))
        chain = [*before, run] if before else [run]
        yield [run]
        if before:
            yield chain
        open_at[shift, end] = chain


def weighed_items(items: DataFrame) -> DataFrame:
    """item_id, numbers, weights (arrays in the order of the words), heaviest: the words of every item with their weights.

    A word's weight falls with the share of items that have it. Item ids that repeat are numbered apart.
    """

    def make():
        numbers = WordNumbers()

        def row(item_id, text):
            for at, number in enumerate(numbers(plain_words(text or "")).view(np.int64).tolist()):
                yield item_id, at, number

        return row

    words = materialize(map_rows(items.select(F.struct(F.monotonically_increasing_id().alias("no"), "item_id").alias("item_id"), "text"), ["item_id", "text"], make, "item_id struct<no:long,item_id:long>, at int, number long"), "item-words")
    total = words.agg(F.count_distinct("item_id").alias("n"))
    counts = words.select("number", "item_id").distinct().groupBy("number").agg(F.count("*").alias("df"))
    weight = lambda df: F.lit(1.0) + F.round(F.lit(4.0) * F.ln((F.col("n") + 1) / df)) / 4
    weighed = words.join(counts, "number").join(total).select("item_id", "at", "number", weight(F.col("df")).cast("float").alias("weight"), weight(F.lit(1)).cast("float").alias("heaviest"))
    listed = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("at", "number", "weight"))).alias("w"), F.max("heaviest").alias("heaviest"))
    return listed.select(F.col("item_id.item_id").alias("item_id"), F.col("w.number").alias("numbers"), F.col("w.weight").alias("weights"), "heaviest")


def stored_indexes(items: DataFrame, folder: str, shard_words: int = SHARD_WORDS) -> int:
    """Store one index for each shard of weighed_items under folder; how many shards there are."""
    weighed = materialize(weighed_items(items), "weighed-items")
    total = weighed.agg(F.sum(F.size("numbers"))).first()[0] or 0
    shards = -(-total // shard_words)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(i), np.asarray(n, np.int64).view(np.uint64), np.asarray(w, np.float32)) for i, n, w in zip(pdf["item_id"], pdf["numbers"], pdf["weights"], strict=True)]
        index = ItemIndex(rows, float(pdf["heaviest"].iloc[0]))
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "kept": [pickle.dumps(index, protocol=5)]})

    if shards:
        weighed.withColumn("shard", F.pmod(F.xxhash64("item_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, kept binary").write.partitionBy("shard").parquet(folder)
    return shards


def leaks(documents: DataFrame, items: DataFrame, share: float = SHARE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, item_id, share of the item's words in passages that the document holds."""
    folder = f"{shared_folder(documents.sparkSession).rstrip('/')}/items-{uuid.uuid4().hex}"
    shards = stored_indexes(items, folder, shard_words)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("share", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, only = WordNumbers(), []

        def index_of(shard: int) -> ItemIndex | None:
            if shards > 1:
                return load_stored(folder, shard)
            if not only:
                only.append(load_stored(folder, shard))
            return only[0]

        def scan(held: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            out = []
            for shard in range(shards):
                index = index_of(shard)
                if index is not None:
                    out += [(doc_id, *hit) for doc_id, words in held for hit in index.leaked(words, share)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

        held, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if text and shards:
                    held.append((doc_id, numbers(plain_words(text))))
                    size += len(text)
                    if size >= BLOCK_CHARS:
                        yield from scan(held)
                        held, size = [], 0
        yield from scan(held)

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, share double")
