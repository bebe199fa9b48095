"""Copies of collections laid out for how they are read: in an order, for pages, or by a key, for lookups.

An ordered copy has its rows in ranges of the order, a file each, and a small manifest of how many rows each
file has and what it begins and ends with.  A page is then found in the manifest, whatever its number, and
read from the file or two that hold it; a cursor, the last row of the page before, is found the same
way.  A keyed copy is sorted by its key, with Parquet bloom filters for it and for other columns, so that
a lookup reads the row groups that may hold the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class OrderedFiles:
    """Rows in order of a column, ``newest`` first, and of a second that tells ties apart, ascending.  Null times come last."""

    def __init__(self, spark: SparkSession, path: str, newest: str, then: str):
        self.spark, self.path, self.newest, self.then = spark, path.rstrip("/"), newest, then

    @property
    def order(self) -> list[Column]:
        return [F.desc(self.newest), F.asc(self.then)]

    def write(self, rows: DataFrame, rows_a_file: int = 1_000_000) -> None:
        files = max(1, -(-rows.count() // rows_a_file))
        rows.repartitionByRange(files, *self.order).sortWithinPartitions(*self.order).write.parquet(f"{self.path}/rows")
        # files are named by their range, so their names are in order
        written = self.spark.read.schema(rows.schema).parquet(f"{self.path}/rows")
        ends = [F.max(self.newest).alias("hi"), F.min(self.newest).alias("lo"), F.count_if(F.col(self.newest).isNull()).alias("untimed")]
        manifest = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"), *ends)
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest")

    def _manifest(self) -> list:
        return self.spark.read.parquet(f"{self.path}/manifest").orderBy("file").collect()  # a row per file

    def _of(self, files: list[str]) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/rows").schema
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/rows/{f}" for f in files))

    def total(self) -> int:
        return sum(m.n for m in self._manifest())

    def page(self, number: int, size: int) -> DataFrame:
        """Page ``number`` from 1, from the files that hold its rows."""
        first, before, files, skipped = (number - 1) * size, 0, [], 0
        for m in self._manifest():
            if before + m.n > first and before < first + size:
                skipped = before if not files else skipped
                files.append(m.file)
            before += m.n
        return self._of(files).orderBy(*self.order).offset(first - skipped if files else 0).limit(size)

    def after(self, cursor: tuple, size: int) -> DataFrame:
        """The ``size`` rows behind the one with these two values, which need not be there any more."""
        time, tie = cursor
        t, k = F.col(self.newest), F.col(self.then)
        behind = (t.isNull() & (k > F.lit(tie))) if time is None else t.isNull() | (t < F.lit(time)) | ((t == F.lit(time)) & (k > F.lit(tie)))
        left = [m for m in self._manifest() if (m.untimed if time is None else m.untimed or m.lo is None or m.lo <= time)]
        take = 1
        while True:
            # the first file may hold rows before the cursor, and so may those that share its time
            files = [m.file for m in left[:take]]
            found = self._of(files).where(behind)
            if take >= len(left) or sum(m.n for m in left[1:take] if time is None or m.hi is None or m.hi < time) >= size or found.limit(size).count() == size:
                return found.orderBy(*self.order).limit(size)
            take *= 2


def write_keyed(rows: DataFrame, path: str, key: str, others: tuple[str, ...] = (), rows_a_group: int = 100_000, files: int | None = None) -> None:
    """A copy sorted by a key, with bloom filters for it and the other columns, in groups of about so many rows."""
    ranged = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    out = ranged.sortWithinPartitions(key).write.option("parquet.block.row.count.limit", rows_a_group)
    for c in (key, *others):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", rows_a_group)
    out.parquet(path)
