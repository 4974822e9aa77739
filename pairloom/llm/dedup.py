"""Exact duplicates by a log-structured merge index of text digests.

Map tasks fill a memtable (digest -> best id, count) and flush it as sorted runs,
cut by digest range into segments with a Bloom filter each. One task per digest
range feeds the segments to an LsmIndex, whose compaction merges runs and keeps
one identifier per digest. Digests that were seen more than once are hits; the
texts behind them are compared byte for byte before a hit counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import join_groups, row_count, ship, small_side, stored, whole_text

WIDTH = 32
NO_ID = np.iinfo(np.int64).min
DIGEST = np.dtype(f"S{WIDTH}")
SEGMENT = "bucket int, rows int, digests binary, ids binary, counts binary, filter binary"
#: Rows of hits that may be broadcast (about 90 bytes each).
BROADCAST_ROWS = 200_000


class Bloom:
    """A Bloom filter over digests, which are uniform already: their words are the hashes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(digests: np.ndarray, m: int) -> np.ndarray:
        words = np.frombuffer(digests.tobytes(), "<u8").reshape(-1, WIDTH // 8)
        return (words % np.uint64(m)).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray, bits_per_key: int = 12) -> Bloom:
        m = max(64, -(-len(digests) * bits_per_key // 64) * 64)
        bits = np.zeros(m, np.uint8)
        bits[cls._places(digests, m).ravel()] = 1
        return cls(np.packbits(bits))

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        places = self._places(digests, len(self.bits) * 8)
        return ((self.bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=1)


class Run:
    """Sorted digests with the identifier to keep and the count of each."""

    def __init__(self, digests, ids, counts, bloom: Bloom | None = None):
        self.digests, self.ids, self.counts = digests, ids, counts
        self.bloom = bloom or Bloom.of(digests)

    def __len__(self) -> int:
        return len(self.digests)


class LsmIndex:
    """Levels of sorted runs. A level with `fanout` runs is merged into the next one."""

    def __init__(self, keep: str = "smallest", fanout: int = 4):
        self.fold = {"smallest": np.minimum, "largest": np.maximum}[keep]
        self.fanout = fanout
        self.levels: list[list[Run]] = []

    def add(self, run: Run) -> None:
        level = 0
        while len(run):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            run, self.levels[level] = self.merge(self.levels[level]), []
            level += 1

    def merge(self, runs: list[Run]) -> Run:
        """One run with a row per digest. Digests that no other run's filter knows are
        new for sure and only need sorting in; the others are folded."""
        digests = np.concatenate([r.digests for r in runs])
        ids = np.concatenate([r.ids for r in runs])
        counts = np.concatenate([r.counts for r in runs])
        order = np.argsort(digests, kind="stable")
        digests, ids, counts = digests[order], ids[order], counts[order]
        maybe = np.concatenate(
            [np.any([o.bloom.may_hold(r.digests) for o in runs if o is not r] or [np.zeros(len(r), bool)], axis=0) for r in runs]
        )
        if not maybe.any():
            return Run(digests, ids, counts)
        first = np.flatnonzero(np.r_[True, digests[1:] != digests[:-1]])
        return Run(digests[first], self.fold.reduceat(ids, first), np.add.reduceat(counts, first))

    def get(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifier to keep and count of each digest; count 0 if it is unknown."""
        ids, counts = np.full(len(digests), NO_ID), np.zeros(len(digests), np.int64)
        for run in (r for level in self.levels for r in level):
            at = np.flatnonzero(run.bloom.may_hold(digests))
            where = np.searchsorted(run.digests, digests[at])
            found = where < len(run)
            found[found] = run.digests[where[found]] == digests[at][found]
            at, where = at[found], where[found]
            ids[at] = np.where(counts[at] > 0, self.fold(ids[at], run.ids[where]), run.ids[where])
            counts[at] += run.counts[where]
        return ids, counts

    def compact(self) -> Run:
        runs = [r for level in self.levels for r in level]
        if not runs:
            return Run(np.empty(0, DIGEST), np.empty(0, np.int64), np.empty(0, np.int64))
        run = self.merge(runs) if len(runs) > 1 else runs[0]
        self.levels = [[run]]
        return run


def _sorted_run(memtable: dict[bytes, list[int]]) -> Run:
    keys = sorted(memtable)
    values = np.array([memtable[k] for k in keys], np.int64).reshape(-1, 2)
    return Run(np.frombuffer(b"".join(keys), DIGEST), values[:, 0].copy(), values[:, 1].copy())


def _segments(run: Run, buckets: int) -> pa.RecordBatch:
    """The run cut at digest ranges."""
    top = np.frombuffer(run.digests.tobytes(), ">u4").reshape(-1, WIDTH // 4)[:, 0].astype(np.uint64)
    bucket = (top * np.uint64(buckets)) >> np.uint64(32)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for a, b in zip(at, np.r_[at[1:], len(run)]):
        d = run.digests[a:b]
        rows.append((int(bucket[a]), int(b - a), d.tobytes(), run.ids[a:b].tobytes(), run.counts[a:b].tobytes(), Bloom.of(d).bits.tobytes()))
    cols = list(zip(*rows))
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "rows", "digests", "ids", "counts", "filter")
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _flush(keep: str, buckets: int, memtable_rows: int):
    better = max if keep == "largest" else min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memtable: dict[bytes, list[int]] = {}
        for batch in batches:
            for i, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = NO_ID if i is None else i
                if (old := memtable.get(d)) is None:
                    memtable[d] = [i, 1]
                else:
                    old[0] = i if old[0] == NO_ID else old[0] if i == NO_ID else better(old[0], i)
                    old[1] += 1
            if len(memtable) >= memtable_rows:
                yield _segments(_sorted_run(memtable), buckets)
                memtable = {}
        if memtable:
            yield _segments(_sorted_run(memtable), buckets)

    return run


def _compact(keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, LsmIndex] = {}
        for batch in batches:
            for row in batch.to_pylist():
                index = indexes.setdefault(row["bucket"], LsmIndex(keep))
                ids, counts = (np.frombuffer(row[k], np.int64) for k in ("ids", "counts"))
                index.add(Run(np.frombuffer(row["digests"], DIGEST), ids, counts, Bloom(np.frombuffer(row["filter"], np.uint8))))
        for bucket in sorted(indexes):
            r = indexes[bucket].compact()
            raw = r.digests.tobytes()
            for a in range(0, len(r), 65536):
                b = min(len(r), a + 65536)
                ids = pa.array(r.ids[a:b], mask=r.ids[a:b] == NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([raw[WIDTH * k : WIDTH * (k + 1)] for k in range(a, b)], pa.binary()), ids, pa.array(r.counts[a:b])],
                    ["digest", "keep_id", "group_size"],
                )

    return run


def digest_index(digests: DataFrame, keep: str = "largest", memtable_rows: int = 200_000, range_rows: int = 250_000) -> DataFrame:
    """(doc_id, digest) -> (digest, keep_id, group_size), one row per digest.

    Whatever the number of copies, a digest leaves a map task once per flush, so
    the largest group costs a range's task one row per run."""
    ship(digests.sparkSession)
    buckets = max(8, -(-row_count(digests) // range_rows))
    runs = digests.select(F.col("doc_id").cast("long"), "digest").mapInArrow(_flush(keep, buckets, memtable_rows), SEGMENT)
    return runs.repartitionById(buckets, F.col("bucket")).mapInArrow(_compact(keep), "digest binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, keep: str = "largest", digest_bytes: int = WIDTH) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row
    with the largest (or smallest) doc_id stays; a null doc_id never wins over
    another. Repeated rows with the kept doc_id are all kept. An empty table gives
    an empty result; other columns are ignored. digest_bytes shortens the index's
    digest, so that tests can make unequal texts collide."""
    sha = F.unhex(F.sha2(whole_text(), 256))
    key = F.rpad(F.substring(sha, 1, digest_bytes), WIDTH, F.lit(b"\0")) if digest_bytes < WIDTH else sha
    base = docs.select("doc_id", sha.alias("sha"), key.alias("digest"))
    known = stored(base, "digests")
    index = stored(digest_index(known, keep), "digest-index")
    hits = index.filter("group_size > 1")
    n_hits, rows = row_count(hits), row_count(known)

    # Byte verification: rows of a hit are grouped by their very text. Copies within
    # a task fold before the shuffle, so a large group sends one row per task; heavy
    # digests meet their texts by a broadcast, so that they are not shuffled before.
    texts = docs.select("doc_id", whole_text().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)) if digest_bytes == WIDTH else key)
    best = F.max if keep == "largest" else F.min
    sizes = hits.select("digest", F.col("group_size").alias("_copies"))
    copies = join_groups(texts, sizes, "digest", "_copies", rows, n_hits <= BROADCAST_ROWS).filter("_copies is not null")
    verified = copies.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    split = stored(verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "digest-splits") if n_hits else hits.select("digest")
    n_split = row_count(split) if n_hits else 0

    found = join_groups(known, hits, "digest", "group_size", rows, n_hits <= BROADCAST_ROWS)
    if n_split:
        found = found.join(small_side(split, n_split, BROADCAST_ROWS), "digest", "left_anti")
    group = F.coalesce(F.col("group_size"), F.lit(1).cast("long"))
    found = found.select("doc_id", F.when(group > 1, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"), group.alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256"))
    if n_split:
        few = small_side(split, n_split, BROADCAST_ROWS)
        exact = verified.join(few, "digest", "left_semi")
        rest = texts.join(few, "digest", "left_semi").join(exact, ["digest", "text"])
        found = found.unionByName(rest.select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256")))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def distinct_documents(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """docs without the rows that exact_dedup drops. Of rows that repeat the kept doc_id
    and text, one stays."""
    found = exact_dedup(docs, keep)
    gone = stored(found.filter("not kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "dropped")
    n = row_count(gone)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.sha2(whole_text(), 256) == F.col("_sha"))
    left = docs.join(small_side(gone, n, BROADCAST_ROWS), same, "left_anti")
    kept = found.filter("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().filter("count > 1")
    return left.dropDuplicates(["doc_id", "text"]) if kept.take(1) else left
