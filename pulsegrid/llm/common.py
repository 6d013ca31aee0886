"""Helpers that the text operators share: folds, shared tables, spreading a scan."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int = 5) -> Column:
    """Remainder of crc32 of the id's decimal text; -1 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all run in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-shared-"))
    return _own_dir[0]


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished stages, which otherwise wait for the driver's next full collection."""
    gc.collect()
    spark._jvm.System.gc()


def settled(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a partition's batches, and at its end the memory that it freed goes back to the system, as the worker lives on."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not a system with the GNU C library

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def smallest(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``key``, ties by the key itself: a sample that any run draws again.

    Of a large table only rows under a hash that twice as many are expected to pass are sorted, so no task meets ``n`` rows of every partition.
    """
    rows = df.count()
    if rows > 4 * n:
        df = df.where(F.xxhash64(*key) <= F.lit(int(-(1 << 63) + (1 << 64) * (2 * n + 100) / rows)))
    return df.orderBy(F.xxhash64(*key), *key).limit(n)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by ``key`` where the input is a few large files.

    A Parquet row group is read by one task, so a table of one or two files would keep most cores idle in an
    expensive Python stage. With many files (four for each core) the scan is parallel already and nothing moves.
    """
    if len(df.inputFiles()) >= 4 * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(F.col(key))


def chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[list[str]]:
    """Lists of texts of about ``limit`` characters; null becomes empty."""
    out, size = [], 0
    for t in texts:
        t = t or ""
        if out and size + len(t) > limit:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out
