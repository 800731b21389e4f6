"""Helpers that several operators share: shared storage, size-checked broadcasts, hashing."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words, as a character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_MASK = (1 << 64) - 1
#: Odd multiplier of the polynomial hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C55
INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes a query's shuffle files when it ends, instead of when the driver's collector finds them.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and Spark runs in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: steps are written to a folder that driver and executors share")
    return f"file://{_scratch()}"


@cache
def _scratch() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage.

    The shuffle files behind it, which nothing reads then, go at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """Marks df for broadcast if it has at most so many rows; larger ones join by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finalizer on uint64, so that every bit of a polynomial hash counts."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of BASE and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 1 << 16)
            for name, base in (("up", BASE), ("down", INVERSE)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of values[t] * BASE**t for i <= t < j, modulo 2**64."""
    up, _ = POWERS.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free hashes of values[start:end]."""
    _, down = POWERS.get(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text as 64-bit hashes, one array for all; and where each text's words begin.

    Words are maximal runs of bytes that are no ASCII white space; A-Z count as a-z if lower.
    """
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = _IS_SPACE[joined]
    edge = np.diff(np.concatenate(([True], space)).view(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = mix64(range_hashes(prefix_hashes(_BYTE_VALUES[joined]), start, end))
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.concatenate(([0], np.searchsorted(start, ends)))


def slabs(sizes: list[int], most: int = 1 << 20):
    """Ranges of consecutive items of about `most` units together; a larger item is alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)
