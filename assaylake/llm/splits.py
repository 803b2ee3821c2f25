"""Overlaps of evaluation splits with the training split.

Method: every run of PASSAGE words of an evaluation record, that is, every pair of adjacent words, is a passage. The records are
cut into shards of a bounded number of passages; each shard's passages form an Aho-Corasick automaton, which is stored in the
shared folder with the records that hold each passage: as lists, or as bits for passages that many records hold. Every training
text passes through all shards, and the passages found in it are counted for every record. The counts are all that the
similarity needs, so no pair that reaches it is left out: none is dropped for the frequency, the order or the spacing of what it
shares. What the counts let through is verified by the exact overlap of word pairs. Words are letters of the automaton's alphabet
(a number of 20 bits each), which makes the automata small and the scan fast; two words of a record that share a number can merge
its passages, and as many are added to its counts, so that this only adds candidates.

The counts are made for all pairs of a training and another record, as array steps of a few nanoseconds a pair: the work grows
with the product of both. In texts of one template rare passages don't narrow it down: on the check tool's large tables (25,108 by
14,333 distinct texts, 360 million pairs) the rarest half of their passages alone meet 280 million times. Equal texts are one class on either side before the scan.

Split names, families and pools are compared without case, outer blanks and separators; splits that are null or none of SPLITS
take no part. Null families or pools never match.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.arrow import map_rows
from assaylake.llm.near_pairs import verified
from assaylake.llm.stored import load_stored
from assaylake.llm.traces import LEAST_WORDS, PairHasher, trace_text, words_of
from assaylake.session import materialize, shared_folder

SPLITS = ("train", "dev", "test", "confirmatory")
PASSAGE = 2
#: Passages in one automaton; passages that a larger share of its records hold are kept as bits; words of texts held at a time.
SHARD_PASSAGES, COMMON, BLOCK_WORDS = 600_000, 1 / 32, 1_000_000


def spelled_alike(column: Column | str) -> Column:
    """Lower case without outer blanks, each run of blanks, hyphens and underscores as one underscore; null if nothing is left."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s_\-]+|[\s_\-]+$", "")), r"[\s_\-]+", "_")
    return F.when(plain != "", plain)


def coded_records(tasks: DataFrame) -> DataFrame:
    """id, source, split, family, pool, tab, kind (class of equal texts or null), grams, code (a character per word)."""
    plain = tasks.select(
        F.col("record_id").cast("long").alias("id"), "source", spelled_alike("split_name").alias("split"),
        spelled_alike("template_family").alias("family"), spelled_alike("entity_pool").alias("pool"), F.col("trace.content").alias("contents"),
    ).filter(F.col("split").isin(*SPLITS))

    def make():
        hasher, letters = PairHasher(), {}

        def letter(word: str) -> str:
            if word not in letters:
                if len(letters) > 1 << 18:
                    letters.clear()
                letters[word] = chr(0x10000 + xxhash.xxh64_intdigest(word) % 0xF0000)
            return letters[word]

        def row(id_, source, split, family, pool, contents):
            words = words_of(trace_text(contents))
            if len(words) < LEAST_WORDS:
                yield id_, source, split, family, pool, "task_records", None, None, None
            else:
                grams = hasher.pairs(words)
                code = "".join(map(letter, words))
                yield id_, source, split, family, pool, "task_records", xxhash.xxh64_intdigest(code.encode()) - (1 << 63), grams, code

        return row

    schema = "id long, source string, split string, family string, pool string, tab string, kind long, grams array<int>, code string"
    return map_rows(plain, ["id", "source", "split", "family", "pool", "contents"], make, schema)


def shard_of(column: str, shards: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


class ShardIndex:
    """The passages of a shard's records in an automaton, and which records hold each."""

    def __init__(self, ids: np.ndarray, codes: list[str], sizes: np.ndarray) -> None:
        """sizes: the records' numbers of distinct word pairs."""
        number: dict[str, int] = {}
        held = [np.unique([number.setdefault(code[at : at + PASSAGE], len(number)) for at in range(len(code) - PASSAGE + 1)]) for code in codes]
        self.ids, self.sizes = ids, sizes.astype(np.int64)
        self.merged = np.maximum(0, self.sizes - [len(x) for x in held])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, n in number.items():
            self.automaton.add_word(text, n)
        self.automaton.make_automaton()
        flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), [len(x) for x in held])
        counts = np.bincount(flat, minlength=len(number))
        common = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts > COMMON * len(held))]
        self.bit = np.full(len(number), -1)
        self.bit[common] = np.arange(len(common))
        self.bits = np.zeros((-(-len(common) // 64), len(held)), np.uint64)
        bit = self.bit[flat]
        often = bit >= 0
        np.bitwise_or.at(self.bits, (bit[often] >> 6, owner[often]), np.uint64(1) << (bit[often] & 63).astype(np.uint64))
        flat, owner = flat[~often], owner[~often]
        self.owner = owner[np.argsort(flat, kind="stable")].astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=len(number)))])

    def alike(self, code: str, size: int, least: float) -> np.ndarray:
        """The ids of the records that a text with `size` distinct word pairs can be `least` alike with, as counted."""
        found = np.fromiter({n for _, n in self.automaton.iter(code)}, np.int64)
        if not len(found):
            return self.ids[:0]
        first, n = self.ends[found], self.ends[found + 1] - self.ends[found]
        shared = np.bincount(self.owner[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(self.ids))
        often = self.bit[found]
        often = often[often >= 0]
        if len(often):
            row = np.zeros(len(self.bits), np.uint64)
            np.bitwise_or.at(row, often >> 6, np.uint64(1) << (often & 63).astype(np.uint64))
            some = np.flatnonzero(row)
            shared += np.bitwise_count(self.bits[some] & row[some, None]).sum(0, dtype=np.int32)
        return self.ids[(shared + self.merged) * (1 + least) >= least * (self.sizes + size) - 1e-6]


def stored_automata(records: DataFrame, folder: str, shards: int) -> None:
    """Store under folder one ShardIndex for each shard of records (id, code, size)."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = pickle.dumps(ShardIndex(pdf["id"].to_numpy(), pdf["code"].tolist(), pdf["size"].to_numpy()), protocol=5)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "kept": [kept]})

    (
        records.withColumn("shard", shard_of("id", shards))
        .groupBy("shard").applyInPandas(build, "shard int, kept binary")
        .write.partitionBy("shard").parquet(folder)
    )


def scanned(texts: DataFrame, folder: str, shards: int, least: float) -> DataFrame:
    """(text_id, record_id) of the texts (id, code, size) and the records that they can be `least` alike with."""
    schema = pa.schema([("text_id", pa.int64()), ("record_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def scan(held: list[tuple[int, str, int]]) -> Iterator[pa.RecordBatch]:
            for shard in range(shards if held else 0):
                index = load_stored(folder, shard)
                if index is not None:
                    for at in range(0, len(held), 1000):
                        some = held[at : at + 1000]
                        hits = [index.alike(code, size, least) for _, code, size in some]
                        texts = np.repeat(np.array([x[0] for x in some], np.int64), [len(x) for x in hits])
                        yield pa.RecordBatch.from_arrays([pa.array(texts), pa.array(np.concatenate(hits).astype(np.int64))], schema=schema)

        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.append(row)
                size += len(row[1])
                if size >= BLOCK_WORDS:
                    yield from scan(held)
                    held, size = [], 0
        yield from scan(held)

    return texts.select("id", "code", "size").mapInArrow(run, "text_id long, record_id long")


def trace_overlaps(records: DataFrame, least: float = 0.5, shard_passages: int = SHARD_PASSAGES) -> DataFrame:
    """train_id, other_id of records whose traces are at least `least` alike. records: coded_records, materialized."""
    spark = records.sparkSession
    texts = records.filter("kind is not null").withColumn("train", F.col("split") == "train")
    reps = texts.groupBy("train", "kind").agg(F.min("id").alias("rep"))
    members = texts.select("train", "kind", "id").join(reps, ["train", "kind"])
    chosen = materialize(texts.select("train", "id", "code", F.size("grams").alias("size")).join(reps.select("train", F.col("rep").alias("id")), ["train", "id"], "left_semi"), "split-texts")
    train, other = chosen.filter("train"), chosen.filter(~F.col("train"))
    total = other.agg(F.sum(F.length("code"))).first()[0] or 0
    shards = max(1, -(-total // shard_passages))
    folder = f"{shared_folder(spark).rstrip('/')}/automata-{uuid.uuid4().hex}"
    stored_automata(other, folder, shards)
    # so many partitions that the tasks share the work, which doesn't follow the size of the texts
    spread = train.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    found = scanned(spread, folder, shards, least).select(F.lit("task_records").alias("tab"), F.col("text_id").alias("id_a"), F.col("record_id").alias("id_b"))
    sets = records.filter("kind is not null").select("tab", "id", "grams")
    alike = verified(found, sets, least)
    a = members.filter("train").select(F.col("rep").alias("id_a"), F.col("id").alias("train_id"))
    b = members.filter(~F.col("train")).select(F.col("rep").alias("id_b"), F.col("id").alias("other_id"))
    return alike.join(a, "id_a").join(b, "id_b").select("train_id", "other_id")


def label_overlaps(records: DataFrame) -> DataFrame:
    """train_id, other_id of records with the same family and the same pool."""
    named = records.select("id", "split", "family", "pool").filter("family is not null and pool is not null")
    a = named.filter("split = 'train'").select(F.col("id").alias("train_id"), "family", "pool")
    b = named.filter("split <> 'train'").select(F.col("id").alias("other_id"), "family", "pool")
    return a.join(b, ["family", "pool"]).select("train_id", "other_id")


def split_overlaps(tasks: DataFrame) -> DataFrame:
    """train_id, other_id, by_trace, by_labels of all overlaps of a train record with one of another split."""
    records = materialize(coded_records(tasks), "coded-records")
    both = trace_overlaps(records).withColumn("by_trace", F.lit(True)).withColumn("by_labels", F.lit(False)).unionAll(
        label_overlaps(records).withColumn("by_trace", F.lit(False)).withColumn("by_labels", F.lit(True))
    )
    return both.groupBy("train_id", "other_id").agg(F.max("by_trace").alias("by_trace"), F.max("by_labels").alias("by_labels"))


def overlap_counts(tasks: DataFrame) -> DataFrame:
    """split, source, n_records, n_overlapping, n_by_trace, n_by_labels, n_pairs of the records outside the training split.

    Pairs by labels are counted per family and pool, never listed: a record has as many as its labels have train records.
    """
    records = materialize(coded_records(tasks), "coded-records")
    labelled = records.filter("split = 'train' and family is not null and pool is not null").groupBy("family", "pool").agg(F.count("*").alias("n_labels"))
    names = records.select("id", F.when(F.col("family").isNotNull() & F.col("pool").isNotNull(), F.struct("family", "pool")).alias("labels"))
    pairs = trace_overlaps(records).join(names.select(F.col("id").alias("train_id"), F.col("labels").alias("a")), "train_id").join(names.select(F.col("id").alias("other_id"), F.col("labels").alias("b")), "other_id")
    both = F.coalesce(F.col("a") == F.col("b"), F.lit(False))
    hits = pairs.groupBy("other_id").agg(F.count("*").alias("n_trace"), F.sum((~both).cast("long")).alias("n_only"))
    others = records.filter("split <> 'train'").select("id", "split", "source", "family", "pool")
    full = others.join(labelled, ["family", "pool"], "left").join(hits.withColumnRenamed("other_id", "id"), "id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    count = lambda condition: F.sum(condition.cast("long"))
    return full.groupBy("split", "source").agg(
        F.count("*").alias("n_records"), count(zero("n_trace") + zero("n_labels") > 0).alias("n_overlapping"), count(zero("n_trace") > 0).alias("n_by_trace"),
        count(zero("n_labels") > 0).alias("n_by_labels"), F.sum(zero("n_labels") + zero("n_only")).alias("n_pairs"),
    )
