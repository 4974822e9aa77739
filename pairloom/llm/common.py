"""What the operators share: table reading, the shared scratch folder, code shipping."""

from __future__ import annotations

import atexit
import ctypes
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, through Spark's own reader, so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str = "text"):
    """The text column; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset, and driver and executors are one process, is a folder of
    our own made, and removed again at exit."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="pairloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/pairloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, sort: list[str] | None = None) -> DataFrame:
    """df as a written table: its lineage is cut, a lost executor costs only the
    tasks that were reading, and later scans prune its columns."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if sort:
        df = df.sortWithinPartitions(*sort)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that are read no more; other frames are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = f"{shared_dir(spark)}/pairloom/"
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            at = folder.split("/pairloom/")
            if len(at) == 2 and "/" not in at[1]:
                path = spark._jvm.org.apache.hadoop.fs.Path(own + at[1])
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes what the operators have left below the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/pairloom")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of the batches that Python workers get.
BATCH_BYTES = 8 << 20


def trim() -> None:
    """Gives freed memory back to the system, and has large arrays allocated so that they
    are given back when freed: workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers once per application, and bounds
    the bytes of the batches that they get."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key, str(1 << 26)))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="pairloom-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "pairloom_src.zip")
    Path(path).write_bytes(blob.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def row_count(df: DataFrame) -> int:
    """Rows; of a Parquet table this reads the footers only."""
    return df.count()


def small_side(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit, else as it is,
    for Spark to shuffle (and to split skewed keys of)."""
    return F.broadcast(df) if rows <= limit else df


def planned_bytes(df: DataFrame, row_bytes: int = 4096) -> int:
    """Catalyst's estimate of the size of df, for a table that of its files; without an
    estimate (a frame that was made from an RDD) row_bytes for each row."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else row_bytes * row_count(df)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, small: bool) -> DataFrame:
    """rows left join groups on key, for groups that may hold a third of all rows.

    At most 1000 groups can each cover over a thousandth of the total: those few are
    broadcast, so that no shuffled key holds more than that share. Groups of which
    there are few (small) are broadcast as a whole."""
    if small:
        return rows.join(F.broadcast(groups), key, "left")
    heavy_from = max(2, total // 1000)
    heavy = groups.filter(F.col(size) > heavy_from)
    light = groups.filter(F.col(size) <= heavy_from)
    a = rows.join(F.broadcast(heavy), key)
    b = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return a.unionByName(b)
