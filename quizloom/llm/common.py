"""Where intermediate results may live, and how lineage is cut."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: With it Spark removes a query's shuffle files when the query ends, not when the driver happens to collect its garbage.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_held: contextvars.ContextVar[list[DataFrame] | None] = contextvars.ContextVar("held", default=None)


def shared_dir(spark: SparkSession) -> str:
    """A new folder's path under the cluster's ``spark.checkpoint.dir``; only where that is unset
    and Spark is local, as in tests, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quizloom-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; the session's setting is as before at the end."""
    before = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANED)
        else:
            spark.conf.set(CLEANED, before)


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, and safe from lost executors.
    What was shuffled on the way is removed, since only this table is read again."""
    path = shared_dir(df.sparkSession)
    with _shuffles_removed(df.sparkSession):
        # Snappy keeps direct buffers as large as a page, which a few long texts fill
        df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    if (held := _held.get()) is not None:
        held.append(table)
    return table


def rows_a_batch(df: DataFrame, n: int) -> DataFrame:
    """Sets how many rows Spark puts into an Arrow batch, which is held whole on both sides of a
    Python function; whole texts are long, so the default of 10,000 may be more than memory allows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    return df


def forget(table: DataFrame) -> None:
    """Removes a table made by :func:`written`; nothing that is still to be computed may read it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are removed at its end, but for those passed to the function it gives:
    they belong to the scratch around it, if there is one."""
    outer, inner = _held.get(), []

    def keep(table: DataFrame) -> DataFrame:
        inner[:] = [t for t in inner if t.written_to != table.written_to]
        if outer is not None:
            outer.append(table)
        return table

    token = _held.set(inner)
    try:
        yield keep
    finally:
        _held.reset(token)
        for table in inner:
            forget(table)
