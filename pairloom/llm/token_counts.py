"""Token counts by a separator scan over flat token files.

The files hold nothing but ids, each document followed by an end id; there is no
index. Blocks of fixed size are read by byte range and searched for end ids with
array comparisons. A block knows how many documents end in it and where the last
does; a prefix scan over a file's blocks (running sum and running maximum) gives
each block the ordinal of its first document and the place where that began, so
documents may span any number of blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import scratch, ship, stored, whole_text
from pairloom.llm.elias_fano import TOKENIZER, library_encoder
from pairloom.llm.files import Writer, folder, read_range
from pairloom.llm.scanner import chunks

END_ID = 50256
BLOCK_IDS, FILE_IDS = 1 << 19, 1 << 25


def write_flat_files(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every whole text (null: empty) into flat files below path, one or more a task, with
    end_id after each document. Returns doc_id, file, ordinal of the documents, and a
    row with n_ids and width for each file. The text is not shuffled."""
    ship(docs.sparkSession)
    folder(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        end = np.array([end_id], f"<u{encoder.width}").tobytes()
        out, ordinal, total = None, 0, 0
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for part in chunks(rows, lambda r: len(r[1])):
                if out is None:
                    name = f"{uuid.uuid4().hex}.bin"
                    out, ordinal, total = Writer(f"{path}/{name}"), 0, 0
                data = b"".join(x + end for x in encoder.encode([r[1] for r in part]))
                out.write(data)
                total += len(data) // encoder.width
                n = len(part)
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([name] * n), pa.array(range(ordinal, ordinal + n), pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], _NAMES)
                ordinal += n
                if total >= file_ids:
                    out.close()
                    yield _trailer(name, total, encoder.width)
                    out = None
        if out is not None:
            out.close()
            yield _trailer(name, total, encoder.width)

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, "doc_id long, file string, ordinal long, n_ids long, width int")


_NAMES = ["doc_id", "file", "ordinal", "n_ids", "width"]


def _trailer(name: str, total: int, width: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([name]), pa.nulls(1, pa.int64()), pa.array([total]), pa.array([width], pa.int32())], _NAMES)


def separator_scan(files: DataFrame, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, n_ids, width) of files below path -> (file, ordinal, n_tokens), a row for each end id: how many
    ids stand between it and the one before. Ids after a file's last end id belong to
    no document. A file is one group of the prefix scan, of n_ids / block_ids rows."""
    ship(files.sparkSession)
    blocks = files.select("file", "width", "n_ids", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n_ids - 1) div {block_ids} as int)"))).alias("block")).filter("n_ids > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, width, n_ids, block in zip(*(c.to_pylist() for c in batch.columns)):
                first = block * block_ids
                data = read_range(f"{path}/{file}", first * width, min(block_ids, n_ids - first) * width)
                at = np.flatnonzero(np.frombuffer(data, f"<u{width}") == end_id) + first
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([int(at[-1]) if len(at) else -1], pa.int64()), pa.array([at], pa.list_(pa.int64()))], ["file", "block", "n_ends", "last_end", "ends"])

    scanned = blocks.select("file", "width", "n_ids", "block").repartition("file", "block").mapInArrow(run, "file string, block int, n_ends long, last_end long, ends array<bigint>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = scanned.select(
        "file", "ends",
        F.coalesce(F.sum("n_ends").over(before), F.lit(0)).alias("ordinal"),
        F.coalesce(F.max("last_end").over(before), F.lit(-1)).alias("previous"),
    )
    pairs = F.arrays_zip(F.col("ends").alias("end"), F.expr("slice(concat(array(previous), ends), 1, size(ends))").alias("previous"))
    return stitched.select("file", "ordinal", F.posexplode(pairs)).selectExpr("file", "ordinal + pos as ordinal", "col.end - col.previous - 1 as n_tokens")


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens of every row, counted in the files and not while encoding. Null
    and empty texts count 0; repeated rows give repeated rows; no rows, no files."""
    path = scratch(docs.sparkSession, "flat-tokens")
    written = stored(write_flat_files(docs, path, tokenizer, end_id), "flat-manifest")
    counts = separator_scan(written.filter("n_ids is not null").select("file", "n_ids", "width"), path, end_id)
    # Both sides grow with the documents: never broadcast.
    return written.filter("ordinal is not null").select("doc_id", "file", "ordinal").join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")
