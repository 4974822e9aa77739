"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

A file holds, in order of doc_id: a header, the boundaries and the doc_ids as
Elias-Fano sequences, and all ids in 2 or 4 bytes. An Elias-Fano sequence of n
ascending numbers below u takes n * (2 + log2(u/n)) bits: low bits in a packed
array, high bits in unary. Sampled places of the ones let select(i) return one
number without decoding the rest.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.bpe import PieceCache, vocabulary_path
from pairloom.llm.common import row_count, scratch, ship, stored, whole_text
from pairloom.llm.files import Writer, folder, read_range
from pairloom.llm.scanner import chunks

TOKENIZER = "byte_bpe_50k.json"
MAGIC = b"EFIDS001"
HEADER = struct.Struct("<8sIIQQqQQ")  # magic, bytes an id, null doc_ids, documents, ids, lowest doc_id, sizes of both sequences
SAMPLE = 64
#: Documents whose offsets a reader has decoded at a time.
READ_DOCS = 4096
#: A shard has this many documents, or more where that would make over MAX_SHARDS; a file at most FILE_IDS ids.
SHARD_DOCS, MAX_SHARDS, FILE_IDS = 4096, 65_536, 1 << 24


class EliasFano:
    """An ascending sequence of non-negative integers."""

    HEAD = struct.Struct("<QBQQ")  # numbers, low bits, bytes of the low and of the high part

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()) if bits else np.empty(0, np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        ones[places] = 1
        return cls(n, bits, low, np.packbits(ones), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = cls.HEAD.unpack_from(data)
        at = cls.HEAD.size
        parts = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, bits, *parts, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + a + b))

    def _low_of(self, i: int) -> int:
        place = i * self.low_bits
        part = np.unpackbits(self.low[place // 8 : (place + self.low_bits + 7) // 8])[place % 8 : place % 8 + self.low_bits]
        return sum(int(bit) << k for k, bit in enumerate(part))

    def select(self, i: int) -> int:
        """The i-th number: from the sampled place before it, ones are counted byte by byte."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        bits = np.unpackbits(self.high[byte : byte + 1])
        bits[: place % 8] = 0
        while (found := int(bits.sum())) <= left:
            left -= found
            byte += 1
            bits = np.unpackbits(self.high[byte : byte + 1])
        place = byte * 8 + int(np.flatnonzero(bits)[left])
        return ((place - i) << self.low_bits) | self._low_of(i)

    def select_range(self, i: int, j: int) -> np.ndarray:
        """The numbers i to j - 1: only what lies between two sampled places is decoded."""
        if i >= j:
            return np.empty(0, np.int64)
        place, after = int(self.samples[i // SAMPLE]), -(-j // SAMPLE)
        byte = place // 8
        bits = np.unpackbits(self.high[byte : int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)])
        bits[: place % 8] = 0
        places = np.flatnonzero(bits)[i % SAMPLE : i % SAMPLE + j - i] + byte * 8
        out = (places - np.arange(i, j)).astype(np.int64) << self.low_bits
        if self.low_bits:
            a, b = i * self.low_bits, j * self.low_bits
            low = np.unpackbits(self.low[a // 8 : (b + 7) // 8])[a % 8 : a % 8 + b - a].reshape(j - i, self.low_bits)
            out |= low.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high))[: self.n]
        out = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low)[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


class LibraryEncoder:
    """The tokenizers library behind a cache of pieces. The library splits a text at the
    same places as the scanner and merges each piece alone, so a piece's ids do not
    depend on what stands around it. Special tokens' strings are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.tokenizer.encode_special_tokens = True
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        self.cache = PieceCache(self._new)

    def _new(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.encode(texts)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _encode(tokenizer: str, end_id: int, cuts: np.ndarray):
    """Rows of shard, doc_id, ids; a shard ends with the doc_id at its cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        end = array(encoder.code, [end_id]).tobytes()
        for batch in batches:
            for part in chunks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()), lambda r: len(r[1])):
                keys = pa.array([r[0] for r in part], pa.int64())
                shard = np.searchsorted(cuts, keys.fill_null(np.iinfo(np.int64).min).to_numpy())
                ids = [x + end for x in encoder.encode([r[1] for r in part])]
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), keys, pa.array(ids, pa.binary())], ["shard", "doc_id", "ids"])

    return run


def pack_file(keys: list[int | None], ids: list[bytes], width: int) -> bytes:
    """One file's bytes; keys ascend, nulls first."""
    known = np.array([k for k in keys if k is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = EliasFano.of(np.cumsum([len(x) // width for x in ids])).to_bytes()
    names = EliasFano.of(known - base).to_bytes()
    body = b"".join(ids)
    return HEADER.pack(MAGIC, width, len(keys) - len(known), len(keys), len(body) // width, base, len(ends), len(names)) + ends + names + body


class IdFile:
    """A file's boundaries, doc_ids and ids."""

    def __init__(self, data: bytes):
        magic, self.width, self.nulls, self.docs, self.n_ids, self.base, a, b = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        at = HEADER.size
        self.ends = EliasFano.from_bytes(data[at : at + a])
        self.names = EliasFano.from_bytes(data[at + a : at + a + b])
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + a + b)

    def bounds(self, i: int) -> tuple[int, int]:
        """Where document i's ids begin and end, by select."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """Those of the documents i to j - 1; null ones come first."""
        known = self.names.select_range(max(0, i - self.nulls), max(0, j - self.nulls)) + self.base
        return [None] * max(0, min(j, self.nulls) - i) + known.tolist()


def _write(path: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, ids, total, seq = None, [], [], 0, 0

        def flush():
            name = f"{path}/{shard:08d}-{seq:04d}-{uuid.uuid4().hex}.ids"
            out = Writer(name)
            out.write(pack_file(keys, ids, width))
            out.close()
            return pa.RecordBatch.from_pylist([{"shard": shard, "seq": seq, "path": name, "n_docs": len(keys), "n_ids": total}], _MANIFEST)

        for batch in batches:
            for s, k, x in zip(*(c.to_pylist() for c in batch.columns)):
                if keys and (s != shard or total + len(x) // width > FILE_IDS):
                    yield flush()
                    seq = seq + 1 if s == shard else 0
                    keys, ids, total = [], [], 0
                shard = s
                keys.append(k)
                ids.append(x)
                total += len(x) // width
        if keys:
            yield flush()

    return run


_MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Encodes every whole text (null: empty), appends end_id to each document and
    writes the ids in ascending doc_id order (null doc_ids first, repeated ones by
    their ids) as files below path. Returns the manifest: shard, seq, path, n_docs,
    n_ids, start, in order. An empty table writes no file.

    Shards are ranges of doc_id between quantiles; a task holds one file's ids. The
    driver sees one row per file. A retried task writes new names, and only those
    that the manifest has are read."""
    spark = docs.sparkSession
    ship(spark)
    path = path or scratch(spark, "token-files")
    folder(path)
    rows = row_count(docs)
    shards = max(1, -(-rows // max(SHARD_DOCS, rows // MAX_SHARDS)))
    cuts = docs.select(F.percentile_approx("doc_id", [k / shards for k in range(1, shards)], 10 * shards).alias("c")).first()["c"] if shards > 1 else []
    cuts = sorted(set(cuts or []))
    encoder_width = library_encoder(tokenizer).width
    coded = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(_encode(tokenizer, end_id, np.array(cuts, np.int64)), "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    manifest = stored(dealt.mapInArrow(_write(path, encoder_width), "shard int, seq int, path string, n_docs long, n_ids long"), "token-manifest")
    found = sorted(manifest.collect())
    starts = accumulate((r.n_ids for r in found), initial=0)
    return spark.createDataFrame([(*r, s) for r, s in zip(found, starts)], "shard int, seq int, path string, n_docs long, n_ids long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files: offsets come from
    the select structure, READ_DOCS documents at a time."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                f = IdFile(read_range(path))
                for i in range(0, f.docs, READ_DOCS):
                    j = min(f.docs, i + READ_DOCS)
                    ends = f.ends.select_range(i, j)
                    begins = np.r_[f.ends.select(i - 1) if i else 0, ends[:-1]]
                    crc = [zlib.crc32(f.ids[a:b].astype("<u4")) for a, b in zip(begins.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids(i, j), pa.int64()), pa.array(begins + start), pa.array(ends - begins), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
