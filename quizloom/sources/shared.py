"""Folders that the driver and all executors see: intermediate tables, and small files with a put that never overwrites."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, name: str = "table") -> str:
    """A new folder's path under the cluster's ``spark.checkpoint.dir``; only where that is unset
    and Spark is local, as in tests, under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/quizloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, however many plans read them."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_a_batch(df: DataFrame, n: int) -> DataFrame:
    """Sets how many rows Spark puts into an Arrow batch, which is held whole on both sides of a Python function;
    whole files are long, so the default of 10,000 may be more than memory allows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
    return df


class Folder:
    """Small files under a path, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def names(self, folder: str, ending: str = "") -> list[str]:
        """Names of what is directly in a folder, sorted; none if there is no such folder."""
        fs, path = self._at(folder)
        if not fs.exists(path):
            return []
        return sorted(n for s in fs.listStatus(path) if (n := s.getPath().getName()).endswith(ending) and not n.startswith((".", "_")))

    def read(self, name: str) -> str:
        fs, path = self._at(name)
        stream = fs.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_if_absent(self, name: str, content: str) -> bool:
        """Puts a whole file under a name that is free; False if it is taken.  The content is written beside it
        first.  On a local file system a hard link then takes the name, elsewhere a rename, which must not replace a
        file (HDFS doesn't; a plain object store has no such rename and is no place for this)."""
        folder, _, own = name.rpartition("/")
        fs, target = self._at(name)
        _, draft = self._at(f"{folder}/.{own}-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(content.encode()))
        finally:
            stream.close()
        try:
            if fs.getUri().getScheme() != "file":
                return not fs.exists(target) and fs.rename(draft, target)
            files, place = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.nio.file.Paths.get
            files.createLink(place(fs.makeQualified(target).toUri()), place(fs.makeQualified(draft).toUri()))
            return True
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            fs.delete(draft, False)

    def delete(self, name: str) -> None:
        fs, path = self._at(name)
        fs.delete(path, True)

    def age_hours(self, name: str) -> float:
        fs, path = self._at(name)
        return (self.spark._jvm.System.currentTimeMillis() - fs.getFileStatus(path).getModificationTime()) / 3.6e6
