"""What the operators share: the shared folder, written tables, sized joins and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of ids or keys up to which one side of a join is sent to every executor (8-byte ids: 16 MB).
BROADCAST_ROWS = 2_000_000

#: A key is hot if it holds at least one part in HOT_PARTS of all rows; so at most HOT_PARTS keys are.
HOT_PARTS = 1024

_WRITTEN: list[str] = []


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the deployment has chosen for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; where that is unset, under an own temp folder in local mode and an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quillstone-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def drop_written(spark: SparkSession) -> None:
    """Delete the tables that this process wrote to the shared folder. Results that are still lazy read them: store those first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and executors may be lost."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def beside_text(docs: DataFrame, keep: list[str], text_col: str) -> tuple[DataFrame, T.StructType]:
    """The columns ``keep`` by number, then the text, so that names can't clash; and the fields of ``keep`` as they were."""
    kept = docs.select(*(column(c) for c in keep))
    return docs.select(*(column(c).alias(f"c{k}") for k, c in enumerate(keep)), column(text_col).cast("string").alias("text")), kept.schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with the right side broadcast if its counted ``rows`` are few, and shuffled otherwise.

    Both ways give the same rows; ``right`` must be a written table, so that counting it was cheap.
    """
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def join_groups(left: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to their groups (unique by ``on``), safe if one group holds most rows.

    ``groups`` is a written table whose ``size`` adds up to ``total`` at most, so groups of at least
    total / HOT_PARTS rows number HOT_PARTS at most: those are broadcast. What is left has no key with more
    than that share and is joined by a shuffle.
    """
    key = F.xxhash64(*on)
    hot = [r[0] for r in groups.where(F.col(size) * HOT_PARTS >= F.lit(total)).select(key).distinct().collect()]
    if not hot:
        return left.join(groups, on, "left")
    is_hot = key.isin(hot)
    return left.where(is_hot).join(F.broadcast(groups.where(is_hot)), on, "left").unionByName(left.where(~is_hot).join(groups.where(~is_hot), on, "left"))


def crc32_text(column: Column | str) -> Column:
    """crc32 of a number written as text; null for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(column.cast("string").cast("binary"))


#: Rows of one Arrow batch: whole texts, so Spark's default of 10,000 would hold too much in a worker at once.
BATCH_ROWS = 1000
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow in batches of at most BATCH_ROWS rows, unless the session has a size of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release_memory()

    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def release_memory() -> None:
    """Give freed memory back to the machine: Python workers live on, and what they keep adds up."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts(column: pa.Array) -> list[str]:
    """The strings of an Arrow column; null counts as empty."""
    return ["" if x is None else x for x in column.to_pylist()]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (public-domain splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_windows(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[k : k + n]
    return mix64(out)
