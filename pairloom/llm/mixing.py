"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt to shards by a seeded hash. Within a shard they
form one stream of words, in seeded order, cut into blocks of equal length.
Blocks are seats: they go to sources, and within a source to its shards, by the
highest quotients weight / (2 seats + 1). A shard with q seats and n blocks then
takes block j floor((j+1)q/n + u) - floor(jq/n + u) times, u seeded: q blocks in
all, none over ceil(q/n) times. What a document gives is the overlap of its words
with the blocks taken, which is a closed formula of its place in the stream, so
blocks are never made and nothing larger than a word count is shuffled.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import row_count, small_side, stored, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Shards hold this many documents, or more where that would make over MAX_SHARDS.
SHARD_DOCS, MAX_SHARDS, MAX_BLOCK = 2048, 4096, 256
BROADCAST_ROWS = 500_000

_PLAN = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("sid", T.IntegerType(), False), T.StructField("source_size", T.LongType(), False), T.StructField("target", T.DoubleType(), False), T.StructField("shards", T.LongType(), False)]
)
_QUOTAS = T.StructType([T.StructField(n, T.LongType(), False) for n in ("q_sid", "q_shard", "seats", "blocks", "turn")])


def sainte_lague(weights, seats: int, caps) -> np.ndarray:
    """Seats per item by highest quotients weight/(2k+1), none above its cap; ties go
    to the earlier item. Equal to giving seats one by one, in time that does not
    depend on their number: a divisor is bisected until few seats are left."""
    w, caps = np.asarray(weights, float), np.where(np.asarray(weights, float) > 0, caps, 0).astype(np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    given = lambda d: np.minimum(caps, np.floor(np.minimum(w / d + 0.5, 9e18)).astype(np.int64))
    low, high = w[w > 0].min() / (2.0 * seats + 2 * caps.max() + 4), 2.0 * w.max() + 1
    for _ in range(200):
        mid = np.sqrt(low * high)
        low, high = (low, mid) if given(mid).sum() <= seats else (mid, high)
    # Where quotients tie at the divisor, rounding may have given the later item its seat: all
    # seats at the divisor are dealt out by their quotients.
    got = given(high * (1 + 1e-12))
    while got.sum() < seats:
        quotient = np.where(got < caps, w / (2.0 * got + 1), -1.0)
        order = np.argsort(-quotient, kind="stable")[: seats - int(got.sum())]
        best = quotient[order[0]]
        order = order[quotient[order] >= best * (1 - 1e-12)]
        got[order] += 1
    return got


def capped_targets(sizes, weights, total: float, cap: float) -> np.ndarray:
    """Shares of total by weight, where a share stops at cap x size and its excess is
    shared anew among the others, until none is above."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    out, open_, left = np.zeros(len(sizes)), sizes > 0, float(total)
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share >= cap * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap * sizes[over]
        left -= out[over].sum()
        open_ &= ~over
    return out


def _turn(seed: int, sid: int, shard: int, blocks: int) -> int:
    """The seeded offset of a shard's block selection."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{sid}:{shard}".encode()).digest()[:8], "big") % max(1, blocks)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, copies.

    size counts words, null text has none. Sources rank by code point, null last and
    as a source of its own, and weigh `weights` in turn. taken: words the mix takes
    of the document, at most cap x size for cap 2; copies: how often the block at the
    document's middle is taken, for mixing whole documents. Ties and repeated rows
    share their stream in any order, their taken words are the same multiset. Results
    depend on the rows and the seed, not on partitions. An empty table gives no rows.

    Only one row per source and one per shard (at most MAX_SHARDS + sources) reach
    the driver. A source with a third of all rows has a third of the shards."""
    spark = docs.sparkSession
    sizes = stored(docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size")), "mix-sizes")
    stats = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows")).collect()
    stats.sort(key=lambda r: (r.source is None, r.source or ""))
    size = np.array([r["size"] for r in stats], np.int64)
    rows = np.array([r["rows"] for r in stats], np.int64)
    target = capped_targets(size, [weights[k % len(weights)] for k in range(len(stats))], share * float(size.sum()), cap)
    per_shard = max(SHARD_DOCS, -(-int(rows.sum()) // MAX_SHARDS))
    plan = spark.createDataFrame([(r.source, k, int(size[k]), float(target[k]), int(-(-rows[k] // per_shard))) for k, r in enumerate(stats)], _PLAN)
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"))
    placed = (
        sizes.alias("d")
        .join(small_side(plan, len(stats), BROADCAST_ROWS).alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("doc_id", F.col("d.source").alias("source"), "size", "sid", "source_size", "target", F.pmod(mark, F.col("shards")).alias("shard"))
    )
    shards = sorted((r.sid, r.shard, r["size"]) for r in placed.groupBy("sid", "shard").agg(F.sum("size").alias("size")).collect())
    quotas = _quotas(shards, size, target, seed)
    block, table = quotas
    quota = spark.createDataFrame(table, _QUOTAS)
    order = Window.partitionBy("sid", "shard").orderBy(F.xxhash64(F.lit(seed + 1), F.col("doc_id")), "doc_id", "size")
    at = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    at = at.join(small_side(quota, len(table), BROADCAST_ROWS), (F.col("sid") == F.col("q_sid")) & (F.col("shard") == F.col("q_shard")), "left")
    before = lambda j: f"(({j}) * seats + turn) div blocks"  # noqa: E731  blocks taken before block j
    taken_to = lambda x: f"({block} * ({before(f'({x}) div {block}')}) + (({x}) % {block}) * ({before(f'({x}) div {block} + 1')} - {before(f'({x}) div {block}')}))"
    middle = f"(end - size + size div 2) div {block}"
    return at.select(
        "doc_id", "source", "size", "source_size", "target",
        F.expr(f"case when size = 0 then 0L else {taken_to('end')} - {taken_to('end - size')} end").alias("taken"),
        F.expr(f"case when size = 0 then 0L else {before(f'{middle} + 1')} - {before(middle)} end").alias("copies"),
    )


def _quotas(shards: list[tuple[int, int, int]], size: np.ndarray, target: np.ndarray, seed: int) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """The block length, and (source, shard, seats, blocks, turn) of every shard."""
    some = size[size > 0]
    block = int(max(1, min(MAX_BLOCK, some.min() // 64))) if len(some) else 1
    by: dict[int, list[tuple[int, int, int]]] = {}
    for s in shards:
        by.setdefault(s[0], []).append(s)
    blocks = {sid: np.array([-(-n // block) for _, _, n in own], np.int64) for sid, own in by.items()}
    caps = np.array([2 * blocks[k].sum() if k in blocks else 0 for k in range(len(size))], np.int64)
    seats = sainte_lague(target, round(float(target.sum()) / block), caps) if len(size) else np.zeros(0, np.int64)
    out = []
    for sid, own in sorted(by.items()):
        n = blocks[sid]
        q = sainte_lague([x[2] for x in own], int(seats[sid]), 2 * n)
        out += [(sid, int(shard), int(q[k]), max(1, int(n[k])), _turn(seed, sid, int(shard), int(n[k]))) for k, (_, shard, _) in enumerate(own)]
    return block, out


def mixed_documents(docs: DataFrame, seed: int = 17, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with each document as often as the mix takes it: none, one or two rows."""
    copies = stored(mix(docs, seed=seed).filter("copies > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("_copies")), "mix-copies")
    n = row_count(copies)
    mixed = docs.join(small_side(copies, n, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_id")))
    return mixed.withColumn("_copies", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)
