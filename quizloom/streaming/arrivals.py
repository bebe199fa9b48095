"""Uploads as they arrive: a stream of files becomes stored documents, and every file has a state.

A micro-batch first records its files as ``processing``, then stores their texts, then records each as
``completed`` or ``failed``, as the stored rows say.  All three are appends to snapshot tables
under keys made of the stream's name and the batch's number.  If a batch is cut short, the stream's checkpoint
gives the same files the same number when it is started again: steps that were done add
nothing, the others are made up for, and no file is stored twice.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizloom.operators.snapshots import SnapshotTable
from quizloom.sources import files

UPLOAD = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """The files that are and will be in a folder, as binary rows; Spark's scan leaves empty files out."""
    return spark.readStream.format("binaryFile").schema(UPLOAD).option("maxFilesPerTrigger", files_a_batch).load(folder)


def store_batch(batch: DataFrame, number: int, name: str, documents: SnapshotTable, states: SnapshotTable, max_mb: int | None = files.MAX_MB) -> None:
    """One micro-batch; may be called again with the same rows and number after a failure."""
    at = F.lit(number).cast("long").alias("batch")

    def record(rows: DataFrame, step: int, status: Column, error: Column) -> None:
        own = rows.select("path", at, F.lit(step).alias("step"), status.alias("status"), error.alias("error"), F.current_timestamp().alias("at"))
        states.append(own, f"{name}/{number}/state {step}")

    record(batch, 0, F.lit("processing"), F.lit(""))
    out = files.extract(batch.select("path", "length", "content"), max_mb)
    rows = out.select("path", "file_type", "length", "text", "status", F.coalesce("error", F.lit("")).alias("error"), at)
    version = documents.append(rows, f"{name}/{number}/documents")
    record(documents.read(version).where(F.col("batch") == number), 1, F.col("status"), F.col("error"))


def arrivals(source: DataFrame, documents: SnapshotTable, states: SnapshotTable, checkpoint: str, max_mb: int | None = files.MAX_MB, name: str | None = None) -> StreamingQuery:
    """Starts the stream over what has arrived: it ends when that is stored, and is started again for what comes
    later.  ``checkpoint`` belongs to these two tables; ``name`` must stay the same with it."""
    known = name or hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    return (
        source.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: store_batch(batch, number, known, documents, states, max_mb))
        .trigger(availableNow=True)
        .start()
    )


def current(states: SnapshotTable) -> DataFrame:
    """(path, status, error, batch, started_at, changed_at): where each file is now."""
    latest = F.max_by(F.struct("status", "error", "batch", "at"), F.struct("batch", "step")).alias("s")
    found = states.read().groupBy("path").agg(latest, F.min("at").alias("started_at"))
    return found.select("path", "s.status", "s.error", "s.batch", "started_at", F.col("s.at").alias("changed_at"))


def unfinished(states: SnapshotTable, older_than_minutes: float = 0.0) -> DataFrame:
    """Files that are being processed, or were when a run was cut short; starting the stream again takes them up."""
    late = F.col("changed_at") <= F.current_timestamp() - F.make_dt_interval(mins=F.lit(int(older_than_minutes)))
    return current(states).where((F.col("status") == "processing") & late)
