"""Groups of texts that are edited copies of each other, by an exact overlap of adjacent word pairs.

Method: deletion-variant signatures. Each text gets a signature of min-wise symbols, cut into segments of four symbols, few
enough that similar texts share a segment but for one symbol at most; each segment is indexed by its four variants with one
wildcard, variants meet by an equality join, and candidates are verified: first by the Hamming distance of 192-bit SimHash
fingerprints that travel with the index, then exactly. The symbols are min-wise hashes, not single bits: at half-alike texts
(Jaccard 0.5) a fourth of all fingerprint bits differ, so that segments of bits which one deletion would make equal are five
bits long and hold the whole table; symbols keep the scheme and make the variants selective.

At similarity s one segment matches with s^4 + 4 s^3 (1 - s): with ten segments 0.5 is found with 0.976, 0.55 with 0.993,
0.6 with 0.9984 and more beyond. All word pairs weigh the same, here and in the fingerprints, however many texts hold them: the
similarity that is searched is the one that is asked for, in groups of any size.

Equal texts are one class before anything is joined, whatever their number; classes are expanded at the end only. Nothing
is capped. Nulls, empty texts and texts of under eight words give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.functions.arrow import map_rows
from assaylake.session import materialize

SEGMENTS, SYMBOLS = 10, 4
BITS = ("bits_a", "bits_b", "bits_c")
#: At most so many of the 192 fingerprint bits differ in a candidate: 3.4 standard deviations over the 51 of half-alike texts of one size.
RADIUS = 72


def signatures(sets: DataFrame, segments: int = SEGMENTS, symbols: int = SYMBOLS) -> DataFrame:
    """tab, id, keys (hashes of the one-wildcard variants of all segments), bits_a, bits_b, bits_c (the fingerprint)."""

    def make():
        rng = np.random.default_rng(20250117)
        odd = rng.integers(1, 1 << 63, segments * symbols, dtype=np.uint64) | np.uint64(1)
        add = rng.integers(0, 1 << 63, segments * symbols, dtype=np.uint64)
        mask = (rng.integers(1, 1 << 63, 3, dtype=np.uint64) | np.uint64(1))[None, :]
        place = rng.integers(1, 1 << 63, symbols, dtype=np.uint64) | np.uint64(1)
        salt = rng.integers(0, 1 << 63, (segments, symbols), dtype=np.uint64)

        def mixed(x: np.ndarray) -> np.ndarray:
            x = x ^ (x >> np.uint64(32))
            x = x * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))

        def row(tab, id_, grams):
            g = np.asarray(grams, np.int32)
            base = mixed(g.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
            draws = mixed(base[:, None] * odd[None, :] + add[None, :])
            symbol = base[draws.argmin(0)].reshape(segments, symbols) * place[None, :]
            whole = symbol.sum(1, dtype=np.uint64)
            tag = np.uint64(sum(map(ord, tab)))
            keys = mixed(whole[:, None] - symbol + salt + tag)  # without symbol i: the variant with its wildcard there
            signs = np.unpackbits(mixed(base[:, None] * mask).view(np.uint8).reshape(len(g), 24), axis=1)
            bits = np.packbits(2 * signs.sum(0, dtype=np.int64) > len(g)).view(np.int64)
            yield tab, id_, keys.view(np.int64).ravel(), int(bits[0]), int(bits[1]), int(bits[2])

        return row

    return map_rows(sets, ["tab", "id", "grams"], make, "tab string, id long, keys array<long>, bits_a long, bits_b long, bits_c long")


def candidates(signed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """tab, id_a < id_b: pairs that share a variant and whose fingerprints are near."""
    index = signed.select(F.explode("keys").alias("key"), "tab", "id", *BITS)
    a, b = index.alias("a"), index.alias("b")
    far = sum((F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in BITS), F.lit(0))
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.tab") == F.col("b.tab")) & (far <= radius)
    return a.join(b, near).select("a.tab", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float = 0.5) -> DataFrame:
    """The pairs (tab, id_a, id_b, ...) whose sets' Jaccard similarity is at least `least`, with it as `similarity`."""
    a = sets.select("tab", F.col("id").alias("id_a"), F.col("grams").alias("grams_a"))
    b = sets.select("tab", F.col("id").alias("id_b"), F.col("grams").alias("grams_b"))
    both = F.size(F.array_intersect("grams_a", "grams_b"))
    return (
        pairs.join(a, ["tab", "id_a"]).join(b, ["tab", "id_b"])
        .withColumn("similarity", both / (F.size("grams_a") + F.size("grams_b") - both))
        .filter(F.col("similarity") >= least)
        .drop("grams_a", "grams_b")
    )


def classes(sets: DataFrame) -> DataFrame:
    """tab, id, kind, rep: the smallest id of each class of equal sets, for every text."""
    narrow = sets.select("tab", "id", "kind")
    reps = narrow.groupBy("tab", "kind").agg(F.min("id").alias("rep"), F.count("*").alias("size"))
    return narrow.join(reps, ["tab", "kind"])


def class_pairs(sets: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(pairs of representatives: tab, id_a, id_b, similarity; members: tab, id, kind, rep, size). sets must be materialized."""
    members = classes(sets)
    copies = members.filter("id <> rep").select("tab", "id")
    single = sets.join(copies, ["tab", "id"], "left_anti")
    return verified(candidates(signatures(single)), sets, least), members


def expanded(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """tab, id_a, id_b (the smaller first): all pairs of rows behind pairs of classes and within classes."""
    within = members.filter("size > 1 and id = rep").select("tab", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"))
    linked = pairs.select("tab", F.col("id_a").alias("rep_a"), F.col("id_b").alias("rep_b")).unionAll(within)
    a = members.select("tab", F.col("rep").alias("rep_a"), F.col("id").alias("x"))
    b = members.select("tab", F.col("rep").alias("rep_b"), F.col("id").alias("y"))
    return (
        linked.join(a, ["tab", "rep_a"]).join(b, ["tab", "rep_b"])
        .filter((F.col("rep_a") != F.col("rep_b")) | (F.col("x") < F.col("y")))
        .select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )


def near_copies(sets: DataFrame, least: float = 0.5) -> DataFrame:
    """tab, id_a, id_b of all rows of one table that are at least `least` alike."""
    return expanded(*class_pairs(materialize(sets, "pair-sets"), least))
