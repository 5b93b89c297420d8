"""What the operators of this subpackage share: table access, the shared folder, packed columns and hashing."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: `[\x20\x09-\x0D]`: the white space that word and equality rules mean.
WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the setting is missing (tests, a local session) a local master takes /tmp/checkpoints;
    any other master takes a folder of the warehouse, which is shared by definition.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        at = "/tmp/checkpoints" if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone: nothing can be removed through it
        return


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read back with its schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(taken, *names: str) -> list[str]:
    """Column names made of the given ones that no taken name equals, whatever their case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        own = name
        while own.lower() in used:
            own = "_" + own
        used.add(own.lower())
        out.append(own)
    return out


def col(name: str):
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder; never a local one."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def buckets_for(spark: SparkSession, df: DataFrame, per: int = 8 << 20, least: int = 8, most: int = 200_000) -> int:
    """Buckets in proportion to the bytes of the plan's input, so that one bucket holds the same share at any size.

    The optimizer's estimate of the plan's leaves, for files their size; no data is read. Leaves of
    unknown size (rows made by Python) count as one bucket for each shuffle partition of the session.
    """
    leaves, size = df._jdf.queryExecution().optimizedPlan().collectLeaves(), 0
    for k in range(leaves.size()):
        own = int(str(leaves.apply(k).stats().sizeInBytes()))
        size += own if own < 1 << 60 else per * int(spark.conf.get("spark.sql.shuffle.partitions"))
    return int(min(most, max(least, size // per + 1)))


def give_back() -> None:
    """Returns memory that the allocators of a Python worker keep: workers live on, beside those of later stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which has no such call
        pass


U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def packed8(b: np.ndarray) -> np.ndarray:
    """Big-endian value of the 8 bytes from each position."""
    x = b.astype(U)
    for step in (1, 2, 4):
        x = x[:-step] << U(8 * step) | x[step:]
    return x


def uniform(x: np.ndarray) -> np.ndarray:
    """Hash values as numbers strictly between 0 and 1."""
    return ((x >> U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def text_buffers(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An Arrow string array as (bytes, start, end) of each value; nulls are empty."""
    import pyarrow as pa

    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, off, data = col.buffers()
    at = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    start, end = at[:-1], at[1:]
    if col.null_count:
        ok = np.asarray(col.is_valid())
        end = np.where(ok, end, start)
    return raw, start, end


def slices(start: np.ndarray, end: np.ndarray, most: int):
    """Ranges (i, j) of consecutive values of about `most` bytes together, at least one value each."""
    i, n = 0, len(start)
    size = np.cumsum(end - start)
    while i < n:
        before = size[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(size, before + most, "right")))
        yield i, j
        i = j


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges [start, start + length), one range after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = starts[keep].astype(np.int64), lengths[keep]
    step = np.ones(total, np.int64)
    step[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    step[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(step)


def n_words(col) -> "F.Column":
    """Words `[^\x20\x09-\x0D]+` of a text; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(NOT_WHITE + "+")), F.lit(0)).cast("long")
