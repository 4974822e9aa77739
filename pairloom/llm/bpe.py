"""Byte-level BPE: encoding of whole texts and decoding of the ids."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import ship, trim, whole_text
from pairloom.llm.scanner import chunks, split_texts

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces of up to SHORT bytes are merged in a list; NONE is above every rank.
SHORT, NONE = 64, 1 << 62


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare file name stands for a file of the installed public vocabularies."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_ranks(name: str) -> dict[bytes, int]:
    with open(vocabulary_path(name), "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merges the adjacent pair of lowest rank, leftmost first, until none has a rank."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    return _merge_short(piece, ranks) if len(piece) <= SHORT else _merge_long(piece, ranks)


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a list of the pairs' ranks: its minimum is the next pair."""
    get, cuts = ranks.get, list(range(len(piece) + 1))
    pairs = [get(piece[k : k + 2], NONE) for k in range(len(piece) - 1)]
    while pairs and (low := min(pairs)) != NONE:
        k = pairs.index(low)
        del cuts[k + 1], pairs[k]
        if k < len(pairs):
            pairs[k] = get(piece[cuts[k] : cuts[k + 2]], NONE)
        if k:
            pairs[k - 1] = get(piece[cuts[k - 1] : cuts[k + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(cuts, cuts[1:])]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap of pairs over a linked list of parts, in n log n."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, k, stop = heapq.heappop(heap)
        middle = end[k]
        if not alive[k] or middle >= n or end[middle] != stop:
            continue
        alive[middle] = False
        end[k] = stop
        if stop < n:
            before[stop] = k
            if (r := ranks.get(piece[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        if (p := before[k]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return out


class PieceCache:
    """piece -> its ids as packed integers. Two generations bound the memory: when the
    young one is full it becomes the old one, and what is met again moves back."""

    def __init__(self, encode_new, limit: int = 500_000):
        self.encode_new, self.limit = encode_new, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces."""
        if len(self.young) + len(pieces) > self.limit:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, pieces))
        missing = [k for k, v in enumerate(found) if v is None]
        new = []
        for k in missing:
            if (v := self.old.get(pieces[k])) is None:
                new.append(k)
            else:
                found[k] = self.young[pieces[k]] = v
        if new:
            for k, v in zip(new, self.encode_new([pieces[k] for k in new])):
                found[k] = self.young[pieces[k]] = v
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of whole texts."""
        pieces, numbers, cut = split_texts(texts)
        packed = list(map(self.look_up(pieces).__getitem__, numbers))
        return [b"".join(packed[a : b - 1]) for a, b in zip(cut, cut[1:])]


class Codec:
    """Encoder and decoder over one rank file."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.ranks = load_ranks(vocabulary)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        # Workers keep this cache while other operators run in them, so it is a small one.
        self.cache = PieceCache(self._new, 200_000)

    def _new(self, pieces: list[str]) -> list[bytes]:
        return [np.array(merge_piece(p.encode("utf-8", "surrogatepass"), self.ranks), "<u4").tobytes() for p in pieces]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        return self.cache.encode(texts)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """The byte place after each token."""
        return np.cumsum(self.lengths[ids])

    def decode(self, ids: np.ndarray, block: int = 1 << 19) -> bytes:
        """The bytes that the ids stand for, gathered by offset."""
        parts = []
        for a in range(0, len(ids), block):
            part = ids[a : a + block]
            n = self.lengths[part]
            ends = np.cumsum(n)
            parts.append(self.bytes[np.arange(ends[-1]) + np.repeat(self.places[part] - ends + n, n)].tobytes())
        return b"".join(parts)


@lru_cache(maxsize=2)
def codec(vocabulary: str) -> Codec:
    return Codec(vocabulary)


def _rows(batches: Iterator[pa.RecordBatch], limit: int):
    """(keys, texts) in chunks of a bounded number of code points."""
    trim()
    for batch in batches:
        texts = batch.column(1).to_pylist()
        for part in chunks(zip(batch.column(0).to_pylist(), texts), lambda r: len(r[1]), limit):
            yield [r[0] for r in part], [r[1] for r in part]
    trim()


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids array<int>, offsets array<int>: every whole text's token ids and the
    byte place after each token. Null text counts as empty and has no ids; special
    tokens' strings are ordinary text; every row gives one row."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary)
        for keys, texts in _rows(batches, 1 << 19):
            ids = [np.frombuffer(x, "<u4") for x in c.encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([c.offsets(x).astype(np.int32) for x in ids], pa.list_(pa.int32()))],
                ["doc_id", "ids", "offsets"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, "doc_id long, ids array<int>, offsets array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, decoded binary of (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            out = [c.decode(np.asarray(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, in one pass without a
    shuffle: texts are encoded, the ids decoded again, and both digested in place.
    Null and empty texts have no tokens and the digests of no bytes."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(vocabulary)
        for keys, texts in _rows(batches, 1 << 19):
            ids = c.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(c.decode(np.frombuffer(x, "<u4").astype(np.int64))).hexdigest() for x in ids]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
