"""Changes to collections, as new versions of them.

Parquet has no update in place: each function returns the collection as it is after the
change.  :mod:`quizloom.operators.snapshots` keeps versions of stored collections and makes
changes to them safe; :func:`append` and :func:`replace` write plain folders of Parquet files, for
which nothing but their files is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str) -> None:
    """Adds the rows; repeated after a failure, it may add them twice."""
    rows.write.mode("append").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    """Writes the new rows beside the old ones, which a plan may still read, and then swaps the folders' names.
    What fails before the swap leaves the old rows; between its two renames nothing is at the path."""
    spark = rows.sparkSession
    base = path.rstrip("/")
    fresh, old = (f"{base}.{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    rows.write.parquet(fresh)
    to = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = to(base).getFileSystem(spark._jsc.hadoopConfiguration())
    had_one = fs.exists(to(base))
    if had_one and not fs.rename(to(base), to(old)):
        raise OSError(f"{base} can't be moved; the new version is {fresh}")
    if not fs.rename(to(fresh), to(base)):
        raise OSError(f"{fresh} can't be moved; the old version is {old}")
    if had_one:
        fs.delete(to(old), True)


def backfill(df: DataFrame, changes: DataFrame, key: str, columns: list[str], only_blank: bool = True) -> DataFrame:
    """Columns set from ``changes`` where it has a value; by default only where they are blank."""
    new = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = df.join(new, key, "left")
    for c in columns:
        blank = F.col(c).isNull() | (F.col(c).cast("string") == "") if only_blank else F.col(f"__{c}").isNotNull()
        joined = joined.withColumn(c, F.when(blank, F.coalesce(f"__{c}", c)).otherwise(F.col(c)))
    return joined.select(*df.columns)


def update_where(df: DataFrame, where: Column, **values) -> DataFrame:
    """Every row that meets the condition gets the values; a null condition isn't met."""
    met = F.coalesce(where, F.lit(False))
    return df.withColumns({c: F.when(met, F.lit(v)).otherwise(F.col(c)) for c, v in values.items()})


def assign_orphans(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts without a user go to the one user there is; nothing changes if there are none or several."""
    only = users.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only_user"))  # one row
    joined = attempts.crossJoin(F.broadcast(only))
    owner = F.when(F.col("user_id").isNull() & (F.col("n") == 1), F.col("only_user")).otherwise(F.col("user_id"))
    return joined.withColumn("user_id", owner).select(*attempts.columns)


def cascade_delete(deleted: DataFrame, quizzes: DataFrame, questions: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Quizzes, questions and attempts without those of the deleted ids; comments stay."""
    ids = deleted.select(F.col("id").alias("quiz_id"))
    left = quizzes.join(ids, quizzes["id"] == ids["quiz_id"], "left_anti")
    return left, questions.join(ids, "quiz_id", "left_anti"), attempts.join(ids, "quiz_id", "left_anti")


def new_rows(users: DataFrame, incoming: DataFrame, key: str = "google_id", required: tuple[str, ...] = ("google_id", "email")) -> tuple[DataFrame, DataFrame]:
    """(new rows, rejected): of several rows with a key that isn't known the first by the required
    fields is new, rows that lack a required field are rejected."""
    blank = F.lit(False)
    for c in required:
        blank = blank | F.col(c).isNull() | (F.col(c).cast("string") == "")
    good, bad = incoming.where(~blank), incoming.where(blank)
    first = F.row_number().over(Window.partitionBy(key).orderBy(*required, *[c for c in incoming.columns if c not in required]))
    return good.withColumn("__nth", first).where("__nth = 1").drop("__nth").join(users.select(key), key, "left_anti"), bad


def find_or_insert(users: DataFrame, incoming: DataFrame, key: str = "google_id", required: tuple[str, ...] = ("google_id", "email")) -> tuple[DataFrame, DataFrame]:
    """(users with the new ones, rejected): known keys stay unchanged."""
    new, bad = new_rows(users, incoming, key, required)
    return users.unionByName(new, allowMissingColumns=True), bad


def status_of(error: Column) -> Column:
    return F.when(error.isNull(), "completed").otherwise("failed")


def export_json(df: DataFrame, path: str, *columns: str) -> None:
    df.select(*columns).write.mode("overwrite").json(path)


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("json"))


def drop_all(spark: SparkSession, database: str, confirm: str) -> None:
    """Drops a database's tables; ``confirm`` must repeat its name."""
    if confirm != database:
        raise ValueError("confirm must be the database's name")
    for t in spark.catalog.listTables(database):
        spark.sql(f"DROP TABLE `{database}`.`{t.name}`")
