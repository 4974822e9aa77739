"""Near duplicates by an exact Jaccard join of word shingles, vertically partitioned.

The global order of shingles is the order of their 64-bit hashes, cut into fragments
of equal width. A fragment's task sees only the part of every set that lies in it;
it counts partial results, which are summed per set or per pair:

1. Viability. A set of n shingles has at least 80 n / 100 in common with a partner,
   so of its first n - that + l shingles at least l are in another set. Map tasks send
   these prefixes to fragments, which count how many of each set's shingles occur in a
   different set. Shingles that a map task has met twice itself are settled there and
   sent once, so one that a third of all documents share costs a fragment one entry a
   map task. Sets below l have no partner. Equal sets count as one throughout.
2. Rarity. For the viable sets, fragments return how many of them have each shingle.
   A set's prefix in order of rarity holds what it must share with any partner.
3. Rounds. Sets that share a prefix shingle form a list. In a round, some sets of each
   list are its pivots; every other set of another component than the pivot's is a
   candidate pair with it. Fragments count the pairs' partial overlaps, the sums
   decide exactly, and links merge components. Lists within one component are done.
   In the last round all sets outside a list's largest component are pivots, so every
   pair of a list that is not in one component is compared, while a group of
   thousands of near copies costs a few comparisons a member and not all pairs.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, join_groups, planned_bytes, row_count, ship, small_side, stored, trim, whole_text
from pairloom.llm.components import components
from pairloom.llm.scanner import chunks
from pairloom.llm.words import shingle_sets

#: Rows that may be broadcast (at most about 100 bytes each).
BROADCAST_ROWS = 100_000
#: Postings that a map task gathers before it sends them; bytes of input a fragment; and
#: tasks, of which each takes several fragments, one after the other, if there are more.
BUFFER, FRAGMENT_BYTES, MAX_TASKS = 1 << 20, 8 << 20, 65_536
#: Pairs that one row of requests may hold.
ASKS = 1 << 16
#: Share of the hash range in which nearly all prefixes of long sets lie. Half of the
#: fragments cover it and half the rest, where those of short sets go on, so neither
#: kind of corpus fills a fragment to more than about twice the mean.
PREFIX_RANGE = 0.45
CHUNK_SHINGLES, CHUNK_DOCS = 1 << 18, 1 << 16
HEAD, HEAD_BYTES = "<III", 12
BATCH_BYTES = 1 << 20


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of n shingles with any partner."""
    return -(-percent * n // 100)


def margin(n: np.ndarray, percent: int) -> np.ndarray:
    """l of the viability test."""
    return np.minimum(needed(n, percent), np.maximum(1, n // 5))


def _fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    return np.minimum((h.astype(np.float64) * (fragments / 2.0**64)).astype(np.int64), fragments - 1)


def _prefix_fragment(h: np.ndarray, fragments: int) -> np.ndarray:
    x = h.astype(np.float64) / 2.0**64
    x = np.where(x < PREFIX_RANGE, x / (2 * PREFIX_RANGE), 0.5 + (x - PREFIX_RANGE) / (2 * (1 - PREFIX_RANGE)))
    return np.minimum((x * fragments).astype(np.int64), fragments - 1)


def _dealt(rows: DataFrame, fragments: int, key: str = "frag") -> DataFrame:
    """rows with each fragment in one task; where a task has several, one after the other."""
    if fragments <= MAX_TASKS:
        return rows.repartitionById(fragments, F.col(key))
    return rows.repartitionById(MAX_TASKS, F.pmod(F.col(key), F.lit(MAX_TASKS))).sortWithinPartitions(key)


def _each_fragment(work):
    """Runs work over the batches of each fragment of a task; the fragment is the first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            cut = _cuts(key)
            for a, b in zip(cut, cut[1:]):
                if held and key[a] != last:
                    yield from work(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[a]
        if held:
            yield from work(held)

    return run


def _cuts(key: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)] if len(key) else np.zeros(1, np.int64)


_VIABLE = "frag int, kind int, doc_id long, n int, fp binary, inst long, count int, data binary"
_VIABLE_ARROW = pa.schema([("frag", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("fp", pa.binary()), ("inst", pa.int64()), ("count", pa.int32()), ("data", pa.binary())])


def _columns(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _VIABLE_ARROW], schema=_VIABLE_ARROW)


def _prefixes(fragments: int, size: int, percent: int):
    """Map side of the viability test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        base = TaskContext.get().partitionId() << 40
        state = {"next": base}

        def flush(docs, seen, sets):
            h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) if sets else np.empty(0, np.int64)
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            cut = _cuts(h)[:-1]
            times = np.diff(np.r_[cut, len(h)])
            local = np.bincount(owner[np.repeat(times > 1, times)], minlength=len(sets))
            multi, alone = h[cut[times > 1]], np.repeat(times == 1, times)
            h, owner = h[alone], owner[alone]
            inst = np.arange(len(sets)) + state["next"]
            state["next"] += len(sets)
            ids = list(seen)
            fp8 = np.frombuffer(b"".join(x[:8] for x in ids), "<u8") if ids else np.empty(0, "<u8")
            # Documents, sent along to fragments by their fingerprint.
            if docs:
                fps = [d[2] for d in docs]
                own = [seen.get(d[2], -1) for d in docs]
                yield _columns(
                    frag=[int.from_bytes(x[8:12], "little") % fragments for x in fps], kind=[0] * len(docs), doc_id=[d[0] for d in docs], n=[d[1] for d in docs],
                    fp=fps, inst=[int(inst[k]) if k >= 0 else -1 for k in own], count=[int(local[k]) if k >= 0 else 0 for k in own],
                )
            part = _prefix_fragment(h, fragments)
            order = np.lexsort((owner, part))
            h, owner, part = h[order].astype(np.uint32), owner[order], part[order]
            mpart = _prefix_fragment(multi, fragments)
            multi = multi.astype(np.uint32)
            rows, data = [], []
            for f in np.union1d(part, mpart).tolist():
                a, b = np.searchsorted(part, [f, f + 1])
                c, d = np.searchsorted(mpart, [f, f + 1])
                own = owner[a:b]
                at = _cuts(own)
                who, count = own[at[:-1]], np.diff(at)
                rows.append(f)
                data.append(struct.pack(HEAD, len(who), b - a, d - c) + inst[who].astype("<i8").tobytes() + fp8[who].tobytes() + count.astype("<u4").tobytes() + h[a:b].tobytes() + multi[c:d].tobytes())
            if rows:
                yield _columns(frag=rows, kind=[1] * len(rows), data=data)

        docs, seen, sets, total = [], {}, [], 0
        for batch in batches:
            for part in chunks(zip(*(c.to_pylist() for c in batch.columns)), lambda r: len(r[1]), BATCH_BYTES):
                for (doc_id, _), s in zip(part, shingle_sets([r[1] for r in part], size)):
                    fp = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    docs.append((doc_id, len(s), fp))
                    if len(s) and fp not in seen:
                        seen[fp] = len(sets)
                        keep = len(s) - int(needed(len(s), percent)) + int(margin(np.int64(len(s)), percent))
                        sets.append(s[:keep])
                        total += keep
                if total >= BUFFER or len(docs) >= 1 << 18:
                    yield from flush(docs, seen, sets)
                    docs, seen, sets, total = [], {}, [], 0
        yield from flush(docs, seen, sets)
        docs, seen, sets = [], {}, []
        trim()

    return run


def _shared_counts(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A fragment's side of the viability test: how many of each set's shingles here are in
    a different set too. Sets are told apart by 64 bits of their fingerprints, shingles
    by 32 within the fragment, which can only count too many."""
    inst, fp, counts, alone, multi = [], [], [], [], []
    for batch in batches:
        kind = batch.column(1).to_numpy()
        docs = batch.filter(pa.array(kind == 0))
        if docs.num_rows:
            yield docs
        for x in batch.filter(pa.array(kind == 1)).column(7).to_pylist():
            n, a, m = struct.unpack_from(HEAD, x)
            at = HEAD_BYTES
            inst.append(np.frombuffer(x, "<i8", n, at))
            fp.append(np.frombuffer(x, "<u8", n, at + 8 * n))
            counts.append(np.frombuffer(x, "<u4", n, at + 16 * n))
            alone.append(np.frombuffer(x, "<u4", a, at + 20 * n))
            multi.append(np.frombuffer(x, "<u4", m, at + 20 * n + 4 * a))
    if not inst:
        return
    inst, fp, counts, alone, multi = map(np.concatenate, (inst, fp, counts, alone, multi))
    owner = np.repeat(np.arange(len(inst)), counts)
    order = np.argsort(alone, kind="stable")
    owner, low = owner[order], alone[order]
    cut = _cuts(low)
    first, size = cut[:-1], np.diff(cut)
    own = fp[owner]
    shared = np.isin(low[first], multi)
    if len(first):
        shared |= np.maximum.reduceat(own, first) != np.minimum.reduceat(own, first)
    found = np.bincount(owner[np.repeat(shared, size)], minlength=len(inst))
    at = np.flatnonzero(found)
    for a in range(0, len(at), 1 << 16):
        k = at[a : a + (1 << 16)]
        yield _columns(kind=np.full(len(k), 2), inst=inst[k], count=found[k])


_CHUNK = "chunk long, nids binary, reps binary, sizes binary, shingles binary"


def _set_chunks(size: int):
    """Documents to rows of packed sets. A set's number is unique: partition, chunk, place."""

    def pack(base, seq, docs):
        nids = base + (seq << 16) + np.arange(len(docs))
        return pa.RecordBatch.from_arrays(
            [pa.array([(base + (seq << 16)) >> 16]), pa.array([nids.astype("<i8").tobytes()]), pa.array([np.array([d[0] for d in docs], "<i8").tobytes()]), pa.array([np.array([len(d[1]) for d in docs], "<u4").tobytes()]), pa.array([b"".join(d[1].tobytes() for d in docs)], pa.binary())],
            ["chunk", "nids", "reps", "sizes", "shingles"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        base, seq, docs, total = TaskContext.get().partitionId() << 40, 0, [], 0
        for batch in batches:
            for part in chunks(zip(*(c.to_pylist() for c in batch.columns)), lambda r: len(r[1]), BATCH_BYTES):
                for (doc_id, _), s in zip(part, shingle_sets([r[1] for r in part], size)):
                    if len(s):
                        docs.append((doc_id, s))
                        total += len(s)
                    if total >= CHUNK_SHINGLES or len(docs) >= CHUNK_DOCS:
                        yield pack(base, seq, docs)
                        seq, docs, total = seq + 1, [], 0
        if docs:
            yield pack(base, seq, docs)

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["nids"], "<i8"), np.frombuffer(row["reps"], "<i8"), np.frombuffer(row["sizes"], "<u4").astype(np.int64), np.frombuffer(row["shingles"], "<u8")


def _ask_rarity(fragments: int):
    """A chunk's distinct shingles and how many of its sets have each, by fragment."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                u, count = np.unique(_unpack(row)[3], return_counts=True)
                part = _fragment(u, fragments)
                cut = _cuts(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut[:-1]], pa.int32()), pa.array([row["chunk"]] * (len(cut) - 1), pa.int64()), pa.array([u[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()), pa.array([count[a:b].astype("<u4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())],
                    ["frag", "chunk", "shingles", "counts"],
                )

    return run


def _answer_rarity(batches):
    cols = [(b.column(0)[k].as_py(), b.column(1)[k].as_py(), b.column(2)[k].as_buffer(), b.column(3)[k].as_buffer()) for b in batches for k in range(b.num_rows)]
    sh = [np.frombuffer(x[2], "<u8") for x in cols]
    u, inverse = np.unique(np.concatenate(sh), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([np.frombuffer(x[3], "<u4") for x in cols])).astype("<u4")
    at = 0
    for (frag, chunk, _, _), s in zip(cols, sh):
        yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([frag], pa.int32()), pa.array([total[inverse[at : at + len(s)]].tobytes()], pa.binary())], ["chunk", "frag", "dfs"])
        at += len(s)


def _rare_prefixes(percent: int):
    """Each set's prefix in order of rarity, without shingles that no other set has: the
    shingle, its place in that order, and of the set its size and how many of its
    shingles other sets have. lead marks the prefix's commonest shingle, which draws
    groups of near copies together."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nids, _, sizes, sh = _unpack(row)
                df_of = np.frombuffer(b"".join(x["dfs"] for x in sorted(row["answers"], key=lambda x: x["frag"])), "<u4")
                df = df_of[np.searchsorted(np.unique(sh), sh)]
                owner = np.repeat(np.arange(len(nids)), sizes)
                order = np.lexsort((sh, df, owner))
                rank = np.arange(len(sh)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                sh, df = sh[order], df[order]
                common = np.bincount(owner[df > 1], minlength=len(nids))
                keep = (rank < (sizes - needed(sizes, percent) + 1)[owner]) & (df > 1) & (common >= needed(sizes, percent))[owner]
                sh, own, rank = sh[keep], owner[keep], rank[keep]
                lead = np.r_[own[1:] != own[:-1], True] if len(own) else np.empty(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(nids[own]), pa.array(sizes[own], pa.int32()), pa.array(common[own], pa.int32()), pa.array(rank, pa.int32()), pa.array(lead)], ["shingle", "nid", "n", "common", "at", "lead"])

    return run


def _send_pairs(fragments: int):
    """The parts of the sets that pairs ask for, with the pairs of each, by fragment."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nids, _, sizes, sh = _unpack(row)
                asks = row["asks"]
                d = np.array([x["d"] for x in asks], np.int64)
                c = np.array([-1 if x["c"] is None else x["c"] for x in asks], np.int64)
                size_c = np.array([x["nc"] or 0 for x in asks], np.int64)
                who = np.unique(d)
                index = who - nids[0]
                ends = np.cumsum(sizes)
                take = np.concatenate([np.arange(ends[i] - sizes[i], ends[i]) for i in index])
                s, own = sh[take], np.repeat(np.arange(len(who)), sizes[index])
                part = _fragment(s, fragments)
                order = np.lexsort((own, part))
                s, own, part = s[order], own[order], part[order]
                pair = np.flatnonzero(c >= 0)
                pair_own = np.searchsorted(who, d[pair])
                cut = _cuts(part)
                out = []
                for a, b in zip(cut, cut[1:]):
                    at = _cuts(own[a:b])
                    here = own[a:b][at[:-1]]
                    k = pair[np.isin(pair_own, here)]
                    out.append((int(part[a]), struct.pack(HEAD, len(here), b - a, len(k)) + who[here].tobytes() + np.diff(at).astype("<u4").tobytes() + s[a:b].tobytes() + d[k].tobytes() + c[k].tobytes() + sizes[d[k] - nids[0]].astype("<u4").tobytes() + size_c[k].astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["frag", "data"])

    return run


def _count_overlaps(buckets: int):
    """A fragment's partial overlaps: shingles that both sets of a pair have here."""

    def run(batches):
        parts = [[] for _ in range(7)]
        for batch in batches:
            for x in batch.column(1).to_pylist():
                n, s, p = struct.unpack_from(HEAD, x)
                at = HEAD_BYTES
                for k, (kind, width, m) in enumerate((("<i8", 8, n), ("<u4", 4, n), ("<u8", 8, s), ("<i8", 8, p), ("<i8", 8, p), ("<u4", 4, p), ("<u4", 4, p))):
                    parts[k].append(np.frombuffer(x, kind, m, at))
                    at += width * m
        if not parts[0]:
            return
        who, count, sh, d, c, nd, nc = map(np.concatenate, parts)
        count = count.astype(np.int64)
        if not len(d):
            return
        u, number = np.unique(sh, return_inverse=True)
        order = np.argsort(who, kind="stable")
        begin = np.cumsum(count) - count
        place = lambda x: order[np.minimum(np.searchsorted(who, x, sorter=order), len(who) - 1)]
        at_d, at_c = place(d), place(c)
        here = np.flatnonzero(who[at_c] == c)  # the partner has a part here
        d, c, nd, nc, at_d, at_c = d[here], c[here], nd[here], nc[here], at_d[here], at_c[here]
        owner = np.repeat(np.arange(len(who)), count).astype(np.uint64)
        held = np.sort(owner << np.uint64(32) | number.astype(np.uint64))
        overlap = np.zeros(len(d), np.int64)
        step = 1 << 14
        for a in range(0, len(d), step):
            i = at_d[a : a + step]
            lengths = count[i]
            ends = np.cumsum(lengths)
            take = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - begin[i], lengths)
            key = np.repeat(at_c[a : a + step].astype(np.uint64), lengths) << np.uint64(32) | number[take].astype(np.uint64)
            spot = np.minimum(np.searchsorted(held, key), len(held) - 1)
            overlap[a : a + step] = np.bincount(np.repeat(np.arange(len(i)), lengths), held[spot] == key, minlength=len(i))
        some = overlap > 0
        d, c, nd, nc, overlap = d[some], c[some], nd[some], nc[some], overlap[some]
        bucket = ((d * 1_000_003) ^ c) % buckets
        order = np.argsort(bucket, kind="stable")
        cut = _cuts(bucket[order])
        rows = [order[a:b] for a, b in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(bucket[k[0]]) for k in rows], pa.int32()), pa.array([d[k].tobytes() + c[k].tobytes() + nd[k].tobytes() + nc[k].tobytes() + overlap[k].astype("<u4").tobytes() for k in rows], pa.binary())], ["bucket", "data"]
        )

    return run


def _sum_overlaps(percent: int):
    """Sums the fragments' counts per pair; the pairs that reach the threshold."""

    def run(batches):
        parts = [[] for _ in range(5)]
        for batch in batches:
            for x in batch.column(1).to_pylist():
                n, at = len(x) // 28, 0
                for k, (kind, width) in enumerate((("<i8", 8), ("<i8", 8), ("<u4", 4), ("<u4", 4), ("<u4", 4))):
                    parts[k].append(np.frombuffer(x, kind, n, at))
                    at += width * n
        if not parts[0]:
            return
        d, c, nd, nc, o = map(np.concatenate, parts)
        order = np.lexsort((c, d))
        d, c, nd, nc, o = d[order], c[order], nd[order].astype(np.int64), nc[order].astype(np.int64), o[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
        both = np.add.reduceat(o, first)
        ok = 100 * both >= percent * (nd[first] + nc[first] - both)
        yield pa.RecordBatch.from_arrays([pa.array(d[first][ok]), pa.array(c[first][ok])], ["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, fragments: int, percent: int) -> DataFrame:
    """(d, c, nc) -> (a, b) of the pairs whose sets are similar, by partial overlaps. The
    requests to a chunk of sets are cut into rows of about ASKS pairs."""
    asks = pairs.select("d", "c", "nc").unionByName(pairs.select(F.col("c").alias("d"), F.lit(None).cast("long").alias("c"), F.lit(None).cast("int").alias("nc")).distinct())
    asks = asks.withColumn("chunk", F.shiftright("d", 16))
    sizes = stored(asks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")), "ask-sizes")
    cut = asks.join(small_side(sizes, row_count(sizes), BROADCAST_ROWS), "chunk").withColumn("part", F.pmod(F.xxhash64("d", "c"), F.expr(f"n div {ASKS} + 1")))
    asks = cut.groupBy("chunk", "part").agg(F.collect_list(F.struct("d", "c", "nc")).alias("asks"))
    sent = sets.join(asks, "chunk").mapInArrow(_send_pairs(fragments), "frag int, data binary")
    counted = _dealt(sent, fragments).mapInArrow(_each_fragment(_count_overlaps(fragments)), "bucket int, data binary")
    return _dealt(counted, fragments, "bucket").mapInArrow(_each_fragment(_sum_overlaps(percent)), "a long, b long")


def _set_links(sets: DataFrame, lists: DataFrame, fragments: int, percent: int) -> DataFrame:
    """(nid, label) of all sets that are linked with another.

    Rounds with few pivots a list, lead lists first, join most of what belongs together.
    The last round is complete: in each list still of several components, every set
    outside the largest one is compared with all of other components."""
    labels = sets.sparkSession.createDataFrame([], "node long, label long")
    n_labels = 0
    for turn, (lead_only, pivots) in enumerate(((True, 1), (True, 8), (False, 1), (False, 8), (False, 16), (False, 16), (False, None))):
        at = (lists.filter("lead") if lead_only else lists).join(small_side(labels, n_labels, BROADCAST_ROWS), F.col("nid") == F.col("node"), "left").withColumn("label", F.coalesce("label", "nid")).drop("node", "lead")
        at = stored(at, "lists")
        shares = at.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("sets"))
        mixed = stored(shares.groupBy("shingle").agg(F.max(F.struct("sets", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("shingle", F.col("most.label").alias("largest")), "mixed")
        n_mixed = row_count(mixed)
        if not n_mixed:
            discard(at, mixed)
            continue
        live = at.join(small_side(mixed, n_mixed, BROADCAST_ROWS), "shingle")
        if pivots:
            own = F.struct(F.xxhash64("nid", F.lit(turn)).alias("h"), *at.columns)
            pivot = live.groupBy("shingle", F.pmod(F.xxhash64("nid", F.lit(7)), F.lit(pivots)).alias("part")).agg(F.min(own).alias("p")).select("p.*")
        else:
            pivot = live.filter("label <> largest")
        pivot = stored(pivot.select("shingle", F.col("nid").alias("c"), F.col("n").alias("nc"), F.col("label").alias("pl"), F.col("common").alias("pcommon"), F.col("at").alias("pat")), "pivots")
        # What the pair has in common is at most what either has in common with any set.
        # In its first common list, which a pair must be found in, it is also at most
        # what follows in both; that keeps pairs from coming up in all their lists.
        enough = lambda most: (100 + percent) * most >= percent * (F.col("n") + F.col("nc"))
        near = (F.col("label") != F.col("pl")) & enough(F.least("common", "pcommon"))
        if not pivots:  # pairs of two pivots come once
            near = near & enough(F.least(F.col("n") - F.col("at"), F.col("nc") - F.col("pat"))) & ((F.col("label") == F.col("largest")) | (F.col("nid") < F.col("c")))
        pairs = stored(live.join(small_side(pivot, row_count(pivot), BROADCAST_ROWS), "shingle").filter(near).select("c", F.col("nid").alias("d"), "nc").distinct(), "pairs")
        discard(at, mixed, pivot)
        links = stored(_linked(pairs, sets, fragments, percent), "links")
        discard(pairs)
        if not links.take(1):
            discard(links)
            continue
        known = labels.withColumnRenamed("node", "x").withColumnRenamed("label", "lx")
        side = lambda c: F.coalesce("lx", c)
        a = links.join(small_side(known, n_labels, BROADCAST_ROWS), F.col("a") == F.col("x"), "left").select(side("a").alias("a"), "b")
        b = a.join(small_side(known, n_labels, BROADCAST_ROWS), F.col("b") == F.col("x"), "left").select("a", side("b").alias("b"))
        merged = components(b)
        n_merged = row_count(merged)
        old = labels.join(small_side(merged.select(F.col("node").alias("label"), F.col("label").alias("to")), n_merged, BROADCAST_ROWS), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        fresh = merged.join(small_side(labels.select("node"), n_labels, BROADCAST_ROWS), "node", "left_anti") if n_labels else merged
        before, labels = labels, stored(old.unionByName(fresh.select("node", "label")), "set-labels")
        discard(before, links, merged)
        n_labels = row_count(labels)
    return labels.withColumnRenamed("node", "nid")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, fragments: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A set holds the distinct shingles of `size` words (A-Z as a-z); with fewer words the
    whole sequence is the one shingle; without words, or with null text, the set is
    empty and linked with nothing. Two documents are linked when 100 x intersection
    >= percent x union; component_id is the smallest doc_id that links reach. Equal
    sets are linked. Rows with the same doc_id are one document for links, each with
    its own n_shingles. A row without doc_id takes no part and has no component_id.
    An empty table gives no rows; other columns are ignored."""
    spark = docs.sparkSession
    ship(spark)
    bytes_in = planned_bytes(docs.select("doc_id", "text"))
    fragments = fragments or int(max(8, bytes_in // FRAGMENT_BYTES))
    raw = docs.select(F.col("doc_id").cast("long"), whole_text().cast("binary").alias("text"))
    sent = _dealt(raw.mapInArrow(_prefixes(fragments, size, percent), _VIABLE), fragments)
    seen = stored(sent.mapInArrow(_each_fragment(_shared_counts), _VIABLE).drop("frag", "data"), "viability")
    meta = seen.filter("kind = 0").select("doc_id", "n", "fp", "inst", "count")
    counts = seen.filter("kind = 2").groupBy("inst").agg(F.sum("count").alias("more"))
    need = F.expr(f"-(({-percent} * n) div 100) + case when ({percent} * n) % 100 = 0 then 0 else 1 end")
    enough = F.least(need, F.greatest(F.lit(1), F.expr("n div 5")))
    able = meta.filter("n > 0 and doc_id is not null").join(counts, "inst", "left").filter(F.col("count") + F.coalesce("more", F.lit(0)) >= enough).select("fp").distinct()
    classes = stored(meta.filter("n > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members")), "classes")
    reps = stored(classes.join(able, "fp", "left_semi").select(F.col("rep").alias("doc_id")).distinct(), "viable")
    n_reps = row_count(reps)
    sets = stored(raw.join(small_side(reps, n_reps, BROADCAST_ROWS), "doc_id", "left_semi").mapInArrow(_set_chunks(size), _CHUNK), "sets")
    shingles = sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    parts = int(max(4, shingles // FRAGMENT_BYTES))
    answers = _dealt(sets.select("chunk", "nids", "reps", "sizes", "shingles").mapInArrow(_ask_rarity(parts), "frag int, chunk long, shingles binary, counts binary"), parts)
    answers = answers.mapInArrow(_each_fragment(_answer_rarity), "chunk long, frag int, dfs binary").groupBy("chunk").agg(F.collect_list(F.struct("frag", "dfs")).alias("answers"))
    lists = stored(sets.join(answers, "chunk").mapInArrow(_rare_prefixes(percent), "shingle long, nid long, n int, common int, at int, lead boolean"), "prefixes")
    labels = _set_links(sets, lists, parts, percent)

    def named(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nids, reps, *_ = _unpack(row)
                yield pa.RecordBatch.from_arrays([pa.array(nids), pa.array(reps)], ["nid", "rep"])

    names = sets.mapInArrow(named, "nid long, rep long").join(labels, "nid")
    least = names.groupBy("label").agg(F.min("rep").alias("component"))
    moved = stored(names.join(least, "label").groupBy("rep").agg(F.min("component").alias("component"), F.max("component").alias("other")), "moved")
    found = classes.join(small_side(moved.drop("other"), n_reps, BROADCAST_ROWS), "rep", "left").select("fp", "members", "rep", F.coalesce("component", "rep").alias("component"))
    found = _join_repeated(meta, found, moved)
    rows = row_count(meta)
    out = join_groups(meta.select("doc_id", "n", "fp"), found, "fp", "members", rows, False)
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _join_repeated(meta: DataFrame, found: DataFrame, moved: DataFrame) -> DataFrame:
    """Rows of one doc_id with different texts connect their texts' components."""
    several = stored(meta.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low <> high").select("doc_id"), "repeated")
    ways = moved.filter("component <> other").select(F.col("component").alias("a"), F.col("other").alias("b"))
    if not several.take(1) and not ways.take(1):
        return found
    own = meta.join(several, "doc_id", "left_semi").join(found, "fp").groupBy("doc_id").agg(F.collect_set("component").alias("all"))
    links = own.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).unionByName(ways)
    merged = components(links)
    return found.join(merged.select(F.col("node").alias("component"), F.col("label").alias("to")), "component", "left").select("fp", "members", "rep", F.coalesce("to", "component").alias("component"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that with the smallest doc_id."""
    found = near_duplicates(docs, size, percent)
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "near-dropped")
    return docs.join(small_side(gone, row_count(gone), BROADCAST_ROWS), F.col("doc_id") == F.col("_id"), "left_anti")
