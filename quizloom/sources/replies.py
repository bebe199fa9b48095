"""Replies that were asked for once and are kept.

A reply costs a call and isn't the same twice, so what a plan reads must not be the call.  Requests are
written first, the calls are made by one job that appends their replies to a log, a
:class:`SnapshotTable` keyed by a digest of model, prompt and text, and whatever reads the replies
joins that log: all outputs of a query see one reply, a rerun asks only for what the log lacks, and equal
requests are one call.  Failures are kept as well, with their error; they are asked for again
only on demand.

A task that is lost before its replies are written makes its calls anew, and so does a speculative copy
of one: what is asked for exactly once is what the log has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizloom.operators.snapshots import SnapshotTable
from quizloom.sources import provider as calls
from quizloom.sources.shared import shared_dir, written

_LOG = "digest string, model string, reply string, reply_error string, asked_at timestamp"


def request_digest(model: str, prompt: Column, text: Column) -> Column:
    """SHA-256 of model, prompt and text, each behind its length; null counts as empty, as it is sent."""
    sent = [F.coalesce(c, F.lit("")) for c in (F.lit(model), prompt, text)]
    return F.sha2(F.concat(*(part for c in sent for part in (F.octet_length(c).cast("string"), F.lit(":"), c))), 256)


class ReplyLog:
    """The log at a path; without one, a new log in the shared folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.table = SnapshotTable(spark, path or shared_dir(spark, "replies"))

    def kept(self) -> DataFrame:
        """(digest, model, reply, reply_error, asked_at): of each request the reply, if it has one, else the last error."""
        spark = self.table.spark
        if not self.table.version():
            return spark.createDataFrame([], _LOG)
        best = F.max_by(F.struct("model", "reply", "reply_error", "asked_at"), F.struct(F.col("reply").isNotNull(), "asked_at"))
        return self.table.read().groupBy("digest").agg(best.alias("r")).select("digest", "r.*")

    def complete(self, df: DataFrame, prompt: str, text: str, provider: calls.Provider, model: str | None = None, retry_failed: bool = False, **options) -> DataFrame:
        """``df`` with ``reply`` and ``reply_error``; calls are made before it returns, one for each request that the log
        lacks, and none when it is read.  ``model`` names who replies, by default the provider."""
        name = model or f"{getattr(provider, '__module__', '')}.{getattr(provider, '__qualname__', type(provider).__qualname__)}"
        asked = written(df.withColumn("__digest", request_digest(name, F.col(prompt), F.col(text))))
        have = self.kept().where("reply IS NOT NULL") if retry_failed else self.kept()
        lacking = asked.groupBy("__digest").agg(F.first(prompt).alias("__p"), F.first(text).alias("__t"))
        lacking = lacking.join(have.select(F.col("digest").alias("__digest")), "__digest", "left_anti")
        if not lacking.isEmpty():
            made = calls.complete(lacking, "__p", "__t", provider, **options)
            self.table.append(made.select(F.col("__digest").alias("digest"), F.lit(name).alias("model"), "reply", "reply_error", F.current_timestamp().alias("asked_at")))
        got = self.kept().select(F.col("digest").alias("__digest"), "reply", "reply_error")
        return asked.join(got, "__digest", "left").drop("__digest")


def log_for(df: DataFrame, log: ReplyLog | None) -> ReplyLog:
    return log or ReplyLog(df.sparkSession)
