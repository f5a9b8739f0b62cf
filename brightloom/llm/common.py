"""Helpers shared by the corpus operators: written intermediates, Arrow buffers, ranks and word hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words: space and the control characters 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only in local mode, where it may be unset, a new local one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("brightloom.scratch.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="brightloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("brightloom.scratch.dir", found)
    return found.rstrip("/")


#: The databases that this process has made for its intermediates; they go when the process ends in order.
_databases: dict[str, SparkSession] = {}


@atexit.register
def _clean() -> None:
    for name, spark in _databases.items():
        with contextlib.suppress(Exception):
            spark.sql(f"drop database if exists {name} cascade")


def _database(spark: SparkSession) -> str:
    """The database of this application's intermediates, in the shared folder."""
    name = "brightloom_" + re.sub(r"\W", "_", spark.sparkContext.applicationId)
    if name not in _databases:
        spark.sql(f"create database if not exists {name} location '{shared_dir(spark)}/{name}'")
        _databases[name] = spark
    return name


#: Row groups of intermediates; a writer holds one in memory.
GROUP_BYTES = 16 << 20


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    name = f"{_database(spark)}.{what.replace('-', '_')}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("parquet.block.size", GROUP_BYTES).saveAsTable(name)
    out = spark.table(name)
    out._saved_as = name
    return out


def files_for(rows: int, each: int = 200_000) -> int:
    """How many files a table of so many narrow rows needs."""
    return max(1, -(-rows // each))


def discard(*frames: DataFrame) -> None:
    """Drops written intermediates that no later plan reads."""
    for df in frames:
        df.sparkSession.sql(f"drop table if exists {df._saved_as}")


def checked(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if it was counted to have at most so many rows; else as it is, for a join with a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


#: Rows and bytes of one Arrow batch; texts are long, and executors hold several batches at once.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Lowers the session's bounds of Arrow batches to BATCH_ROWS and BATCH_BYTES, so that memory depends on these and the longest text.

    A bound written with a unit, as by hand, stays.
    """
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        found = spark.conf.get(name).removesuffix("b")
        if found.lstrip("-").isdigit() and not 0 < int(found) <= most:
            spark.conf.set(name, str(most))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepared(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and its n + 1 offsets, without a copy; a null has no bytes."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes of white space between words, and A-Z to a-z.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15


class Powers:
    """base ** i and base ** -i modulo 2 ** 64, as far as the longest text so far needs."""

    def __init__(self, base: int = _BASE):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
                out = np.full(max(n, 1 << 16), base, np.uint64)
                out[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(out))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some bytes, lower-cased in A-Z, and where each starts."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = powers.upto(len(data))
    edge = np.flatnonzero(np.diff(_SPACE[data], prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def chunked(at: np.ndarray, bound: int = 1 << 20):
    """Ranges of texts that hold at most so many bytes together, or one text."""
    a, n = 0, len(at) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + bound, side="right")) - 1)
        yield a, b
        a = b


def ranked(df: DataFrame, by: list, name: str, what: str) -> DataFrame:
    """Adds the 0-based rank in the total order `by`, with one range shuffle; only a count for each partition reaches the driver."""
    inner = saved(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), what)
    counts = sorted((r["_part"], r["count"]) for r in inner.groupBy("_part").count().collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    first = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return inner.join(F.broadcast(first), "_part").withColumn(name, own - 1 + F.col("_start")).drop("_part", "_start")
