"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once.  It bounds a task's memory; one longer
#: document makes a slice of its own.
SLICE_BYTES = 4 << 20
#: Tables written within each `scratch` that is open.
_SCRATCH: list[list[str]] = []
#: What Python workers keep between tasks.
_KEPT: list[Callable] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept_by_worker(maxsize: int) -> Callable[[Callable], Callable]:
    """`lru_cache` for tokenizers and the like, of which a Python worker keeps only those of
    the function that was called last: workers outlive a stage, and what each stage keeps
    would add up."""

    def decorate(f: Callable) -> Callable:
        cached = lru_cache(maxsize=maxsize)(f)

        @wraps(f)
        def only(*args):
            forget(cached)
            return cached(*args)

        only.cache_info = cached.cache_info
        _KEPT.append(cached)
        return only

    return decorate


def forget(spared: Callable | None = None) -> None:
    """Drop what this worker keeps of other operators; their results do not depend on it."""
    for cached in _KEPT:
        if cached is not spared and cached.cache_info().currsize:
            cached.cache_clear()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keyed_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator needs, so that other columns can't clash with its own."""
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col), *more)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of (id, text, ...) batches, cut into batches of about `limit` text bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(1).cast(pa.large_binary()).fill_null(b"")
        ends = lengths.buffers()[1]
        import numpy as np

        at = np.frombuffer(ends, dtype=np.int64)[lengths.offset : lengths.offset + len(lengths) + 1]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def texts_of(batch: pa.RecordBatch) -> list[str]:
    """The text column, null as the empty text."""
    return [t if t is not None else "" for t in batch.column(1).to_pylist()]


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint folder.

    The setting is read from the session; only where it is unset (tests on one machine) a
    temporary folder is set.
    """
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint_root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, and a lost
    executor costs no recomputation of what came before.  The shuffle files of the written
    query are deleted when it ends, as nothing can read them again.  With `keep` a `scratch`
    around it leaves the table."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    if _SCRATCH and not keep:
        _SCRATCH[-1].append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete on leaving what `stored` has written within, unless it was to be kept."""
    own: list[str] = []
    _SCRATCH.append(own)
    try:
        yield
    finally:
        _SCRATCH.remove(own)
        for path in own:
            _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a `stored` table that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, name)
