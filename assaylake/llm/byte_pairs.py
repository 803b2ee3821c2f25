"""Encoding of texts with a public byte-level BPE vocabulary.

Method: a rank queue under a hierarchical bitmap. The pieces of a pre-token form a linked list; a bucket per merge rank holds
the positions at which a pair of that rank starts; bitmaps of 64-bit words over 64-bit words tell the lowest rank in use by
find-first-set. Merging empties one bucket from left to right, skips entries that earlier merges made stale, and files the two
pairs that a merge creates. A pair that holds a token has a higher rank than the token, so an emptied bucket stays empty, and a
pre-token of n bytes takes n merges at most, whatever its length.

Special tokens' strings are ordinary text. Null and empty texts have no ids. Texts are encoded whole; pre-tokens seen before
come from a bounded table in each task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame

from assaylake.functions.arrow import map_rows

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the public pattern that cuts texts into pre-tokens before byte-level BPE.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> list[bytes]:
    """The tokens of a vocabulary file by id."""
    ranks: dict[int, bytes] = {}
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        for line in file:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class RankQueue:
    """Positions by rank, with three levels of 64-bit words over the ranks."""

    __slots__ = ("bottom", "buckets", "middle", "top")

    def __init__(self, ranks: int) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.bottom = [0] * ((ranks >> 6) + 1)
        self.middle = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            self.bottom[rank >> 6] |= 1 << (rank & 63)
            self.middle[rank >> 12] |= 1 << (rank >> 6 & 63)
            self.top |= 1 << (rank >> 12)
        else:
            bucket.append(position)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank in use and its positions, from left to right; (-1, []) if none."""
        if not self.top:
            return -1, []
        high = (self.top & -self.top).bit_length() - 1
        word = self.middle[high]
        mid = high << 6 | (word & -word).bit_length() - 1
        low = self.bottom[mid]
        rank = mid << 6 | (low & -low).bit_length() - 1
        self.bottom[mid] = low & (low - 1)
        if not self.bottom[mid]:
            self.middle[high] = word & (word - 1)
            if not self.middle[high]:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Encodes texts with one vocabulary; keeps at most `keep` pre-tokens with their ids."""

    def __init__(self, tokens: list[bytes], keep: int = 200_000) -> None:
        self.tokens = tokens
        self.rank_of = {t: i for i, t in enumerate(tokens) if t}
        self.byte_ids = [self.rank_of[bytes([b])] for b in range(256)]
        self.pair_ranks: dict[int, int] = {}
        self.known: dict[str, list[int]] = {}
        self.keep = keep
        self.pattern = regex.compile(PRE_TOKENS)

    def pair_rank(self, left: int, right: int) -> int:
        """The id of the merged pair, or -1 if there is none."""
        key = left << 17 | right
        rank = self.pair_ranks.get(key)
        if rank is None:
            if len(self.pair_ranks) > 500_000:
                self.pair_ranks.clear()
            rank = self.pair_ranks[key] = self.rank_of.get(self.tokens[left] + self.tokens[right], -1)
        return rank

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.rank_of.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        piece = [self.byte_ids[b] for b in data]
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        queue = RankQueue(len(self.tokens))
        due = [-1] * size  # the rank under which a position is filed now; other entries are stale
        pair_rank = self.pair_rank

        def file(at: int) -> None:
            right = after[at]
            due[at] = rank = pair_rank(piece[at], piece[right]) if right < size else -1
            if rank >= 0:
                queue.push(rank, at)

        for at in range(size):
            file(at)
        while True:
            rank, positions = queue.pop()
            if rank < 0:
                break
            for at in positions:
                if due[at] != rank:
                    continue
                gone = after[at]
                piece[at] = rank
                after[at] = beyond = after[gone]
                due[gone] = piece[gone] = -1
                if beyond < size:
                    before[beyond] = at
                file(at)
                if before[at] >= 0:
                    file(before[at])
        out, at = [], 0
        while at < size:
            out.append(piece[at])
            at = after[at]
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        known, out = self.known, []
        for part in self._parts(text):
            ids = known.get(part)
            if ids is None:
                ids = self.merge(part.encode())
                if len(part) <= 64:
                    if len(known) >= self.keep:
                        known.clear()
                    known[part] = ids
            out.extend(ids)
        return out

    def _parts(self, text: str) -> Iterator[str]:
        return (m.group() for m in self.pattern.finditer(text))


def encoded(documents: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """key and ids of each row. The vocabulary (one file of fixed size) is read on the driver and broadcast."""
    tokens = documents.sparkSession.sparkContext.broadcast(load_ranks(name, folder))

    def make():
        encoder = Encoder(tokens.value)

        def row(id_, value):
            yield id_, encoder.encode(value)

        return row

    kind = dict(documents.select(key).dtypes)[key]
    return map_rows(documents, [key, text], make, f"{key} {kind}, ids array<int>", chunk=1000)
