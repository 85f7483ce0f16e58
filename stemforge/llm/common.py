"""Shared helpers of the training-data operators: sessions, stored tables between steps, text batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by the numpy kernels; a longer single text is one slab of its own.
SLAB_BYTES = 1 << 20
#: Most rows of a key list that may be broadcast; above it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of an Arrow batch between the JVM and a Python worker; both hold a few of them.
BATCH_BYTES = 8 << 20

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Make a session ready: small Arrow batches (for the session: plans are lazy), and this package on the Python workers."""
    spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
    sc = spark.sparkContext
    if sc.master.split("[")[0] == "local" or getattr(sc, "_stemforge_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    out = Path(tempfile.mkdtemp(prefix="stemforge-")) / "stemforge.zip"  # the driver serves it to the workers
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted((root / "stemforge").rglob("*.py")):
            z.write(f, f.relative_to(root))
    sc.addPyFile(str(out))
    sc._stemforge_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below the cluster's shared one; it is removed when the driver ends.

    A folder of our own takes its place only in local mode with none set, as in tests: on a cluster the
    other machines would not see it, so that is an error.
    """
    sc = spark.sparkContext
    got = getattr(sc, "_stemforge_folder", None)
    if got is None:
        top = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not top:
            if sc.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
            top = tempfile.mkdtemp(prefix="stemforge-")
        got = sc._stemforge_folder = f"{top.rstrip('/')}/stemforge-{uuid.uuid4().hex}"
        path = sc._jvm.org.apache.hadoop.fs.Path(got)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return got


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: a cut in the lineage that survives lost executors.

    The shuffle files of the write go with its end.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_CONF, "false")
    spark.conf.set(_CLEAN_CONF, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(_CLEAN_CONF, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out._stemforge_table = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` gave and no plan that is still to run reads."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t._stemforge_table)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def row_key(rows: DataFrame, *columns: Column) -> Column:
    """A 64-bit key of rows by the given columns: rows that differ in them have different keys.

    Keys are hashes; those that rows of different contents share, a few in 10**10 rows, are told apart by
    a second hash. Rows alike in the columns share their key.
    """
    first, second = F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)
    shared = rows.select(first.alias("k"), second.alias("c")).groupBy("k").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").limit(10_001).collect()
    if len(shared) > 10_000:
        raise ValueError("too many rows share their 64-bit hash")
    return F.when(first.isin([r["k"] for r in shared]), F.xxhash64(F.lit(2), first, second)).otherwise(first) if shared else first


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Give memory that is free in this Python worker back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """`run` over batches of Arrow rows, giving free memory back as it goes and when it ends."""

    def wrapped(batches) -> Iterator[pa.RecordBatch]:
        for k, b in enumerate(run(batches)):
            yield b
            if k % 8 == 7:
                trim()
        trim()

    return wrapped


def slabs(batch: pa.RecordBatch, column: str = "text", limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of rows of about `limit` text bytes: (first row, end row, bytes, offsets).

    A null text counts as empty. `offsets` has one entry more than rows and starts at 0.
    """
    col = batch.column(column)
    if pa.types.is_large_string(col.type) or pa.types.is_string_view(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int32, count=n + 1 + col.offset)[col.offset :].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def overlapped(batch: pa.RecordBatch, limit: int, overlap: int, column: str = "text") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slabs of pieces of texts: (row of each piece, its first byte in its text, bytes, offsets).

    A text of more than `limit` bytes is cut at multiples of `limit`; a piece goes on for `overlap` bytes into
    the next, so every string of up to `overlap` + 1 bytes is in the piece in which it starts.
    """
    for a, z, data, offs in slabs(batch, column, limit):
        if len(data) <= limit:
            yield np.arange(a, z), np.zeros(z - a, np.int64), data, offs
            continue
        for first in range(0, len(data), limit):  # one long text
            piece = data[first : first + limit + overlap]
            yield np.array([a]), np.array([first]), piece, np.array([0, len(piece)], np.int64)
