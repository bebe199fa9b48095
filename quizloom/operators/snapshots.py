"""Collections as versions: changes that are whole or not there, and can be repeated safely.

A table is a folder of Parquet files and a log.  A change first writes its files, which nobody
reads yet, and then one small log entry under the next version's number, put only if that number
is free: that put is the change.  A reader is pinned to one version's list of files, so it never
sees half a change, nor later ones.  Of two writers one gets the number; the other looks again, and
an append goes on with its files, while a change of rows that were read is worked out anew.
Appends carry a key: with the same key again they add nothing.  A change of some rows rewrites the
files that hold them and leaves the others.

Row counts by the columns of ``counted`` are kept too: every change writes how many rows of
each value it adds and removes, and the counts of a version are the sum of a few small tables.

Every LONG_EVERY-th entry lists the version in full, so that reading one takes as many entries at
most.  What a failed change wrote stays unread until :meth:`SnapshotTable.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.operators import dml
from quizloom.sources.shared import Folder

LONG_EVERY, ATTEMPTS = 16, 20


class Conflict(RuntimeError):
    """Other writers were always faster."""


@dataclass(frozen=True)
class State:
    """A version: its schema, files, tables of counts, and which appends it holds."""

    version: int = 0
    schema: str = ""
    files: tuple[str, ...] = ()
    counts: tuple[str, ...] = ()
    keys: dict[str, int] = field(default_factory=dict)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, counted: tuple[str, ...] = ()):
        self.spark, self.path, self.counted, self.folder = spark, path.rstrip("/"), counted, Folder(spark, path)

    # -- versions ----------------------------------------------------------------------

    def version(self) -> int:
        names = self.folder.names("log", ".json")
        return int(names[-1].removesuffix(".json")) if names else 0

    def state(self, version: int | None = None) -> State:
        at = self.version() if version is None else version
        entries = []
        while at > 0:
            entries.append(json.loads(self.folder.read(_entry(at))))
            if entries[-1]["long"]:
                break
            at -= 1
        state = State()
        for e in reversed(entries):
            gone = set(e["remove"])
            files = (*(f for f in state.files if f not in gone), *e["add"])
            keys = state.keys | e["keys"]
            state = State(e["version"], e["schema"], files, (*([] if e["long"] else state.counts), *e["counts"]), keys)
        return state

    def read(self, version: int | State | None = None) -> DataFrame:
        """The rows of a version, the latest by default; a table without versions can't be read."""
        state = version if isinstance(version, State) else self.state(version)
        if not state.schema:
            raise LookupError(f"{self.path} has no version")
        return self._of(state, state.files)

    def _of(self, state: State, files: tuple[str, ...]) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state.schema))
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files))

    # -- changes -----------------------------------------------------------------------

    def append(self, rows: DataFrame, key: str | None = None) -> int:
        """The version that holds the rows.  A key that is known adds nothing."""
        files = counts = None
        for _ in range(ATTEMPTS):
            state = self.state()
            if key is not None and key in state.keys:
                return state.keys[key]
            if files is None:
                rows = _fitted(rows, state)
                files = self._write(rows)
                counts = self._counts((self._of(replace(state, schema=rows.schema.json()), files), 1))
            if self._commit(state, rows.schema.json(), files, (), counts, key):
                return state.version + 1
        raise Conflict(self.path)

    def rewrite(self, touched: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame], key: str | None = None) -> int:
        """``change`` turns the files that hold any row of ``touched`` into new ones; both get rows of the version
        that the change is made on and may be called again, on a later one."""
        for _ in range(ATTEMPTS):
            state = self.state()
            if key is not None and key in state.keys:
                return state.keys[key]
            named = self.read(state).withColumn("__file", F.col("_metadata.file_path"))
            hit = {"/".join(r[0].rsplit("/", 2)[-2:]) for r in touched(named).select("__file").distinct().collect()}  # names of files
            old = tuple(f for f in state.files if f.removeprefix("data/") in hit)
            if not old:
                return state.version
            before = self._of(state, old)
            files = self._write(_fitted(change(before), state))
            counts = self._counts((before, -1), (self._of(state, files), 1))
            if self._commit(state, state.schema, files, old, counts, key):
                return state.version + 1
        raise Conflict(self.path)

    def replace(self, make: Callable[[DataFrame], DataFrame], key: str | None = None) -> int:
        """All rows anew, from those of the version that is replaced."""
        return self.rewrite(lambda df: df, make, key)

    def _write(self, rows: DataFrame) -> tuple[str, ...]:
        name = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return tuple(f"{name}/{n}" for n in self.folder.names(name, ".parquet"))

    def _commit(self, base: State, schema: str, add: tuple[str, ...], remove: tuple[str, ...], counts: tuple[str, ...], key: str | None) -> bool:
        at, gone = base.version + 1, set(remove)
        entry = {"version": at, "schema": schema, "long": False, "add": add, "remove": remove, "counts": counts, "keys": {key: at} if key else {}}
        if at % LONG_EVERY == 0:
            whole = self._merged((*base.counts, *counts))
            entry |= {"long": True, "add": [*(f for f in base.files if f not in gone), *add], "remove": [], "counts": whole, "keys": base.keys | entry["keys"]}
        return self.folder.put_if_absent(_entry(at), json.dumps(entry))

    def vacuum(self, keep: int = 1, hours: float = 24.0) -> list[str]:
        """Removes folders that none of the last ``keep`` versions uses and that are older than ``hours``, which must
        be more than any reader or writer takes; what it removed."""
        latest = self.version()
        states = [self.state(v) for v in range(max(1, latest - keep + 1), latest + 1)]
        used = {f.split("/")[1] for s in states for f in (*s.files, *s.counts)}
        removed = []
        for top in ("data", "counts"):
            for name in self.folder.names(top):
                if name not in used and self.folder.age_hours(f"{top}/{name}") >= hours:
                    self.folder.delete(f"{top}/{name}")
                    removed.append(name)
        return removed

    # -- counts ------------------------------------------------------------------------

    def _counts(self, *parts: tuple[DataFrame, int]) -> tuple[str, ...]:
        """A table of (what, value, n): rows of each value that the parts add or take away."""
        if not self.counted:
            return ()
        each = None
        for df, sign in parts:
            pairs = F.array(*(F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("value")) for c in self.counted))
            own = df.select(F.explode(pairs).alias("p")).groupBy("p.what", "p.value").agg((F.count(F.lit(1)) * sign).alias("n"))
            each = own if each is None else each.unionByName(own)
        name = f"counts/{uuid.uuid4().hex}"
        each.groupBy("what", "value").agg(F.sum("n").alias("n")).where("n <> 0").write.parquet(f"{self.path}/{name}")
        return (name,)

    def _merged(self, names: tuple[str, ...]) -> tuple[str, ...]:
        if len(names) < 2:
            return names
        name = f"counts/{uuid.uuid4().hex}"
        self._sum(names).where("n <> 0").write.parquet(f"{self.path}/{name}")
        return (name,)

    def _sum(self, names: tuple[str, ...]) -> DataFrame:
        parts = self.spark.read.schema("what string, value string, n long").parquet(*(f"{self.path}/{n}" for n in names))
        return parts.groupBy("what", "value").agg(F.sum("n").alias("n"))

    def counts(self, column: str, version: int | None = None) -> DataFrame:
        """(value, n) of a counted column, without reading the rows; values as strings."""
        if column not in self.counted:
            raise LookupError(f"rows aren't counted by {column}")
        names = self.state(version).counts
        if not names:
            return self.spark.createDataFrame([], "value string, n long")
        return self._sum(names).where((F.col("what") == column) & (F.col("n") != 0)).select("value", "n")


def _entry(version: int) -> str:
    return f"log/{version:020}.json"


def _fitted(rows: DataFrame, state: State) -> DataFrame:
    """The rows with the table's columns; a first version sets them, all nullable."""
    if not state.schema:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
        return rows.select(*(F.when(F.lit(True), F.col(f.name)).alias(f.name) for f in schema))
    schema = T.StructType.fromJson(json.loads(state.schema))
    if (own := {f.name: f.dataType.simpleString() for f in rows.schema}) != {f.name: f.dataType.simpleString() for f in schema}:
        raise ValueError(f"the table has other columns: {schema.simpleString()}, not {own}")
    return rows.select(*schema.names)


# -- the changes that collections need ------------------------------------------------------


def update_where(table: SnapshotTable, where: Column, key: str | None = None, **values) -> int:
    """Every row that meets the condition gets the values."""
    return table.rewrite(lambda df: df.where(where), lambda df: dml.update_where(df, where, **values), key)


def backfill(table: SnapshotTable, changes: DataFrame, on: str, columns: list[str], only_blank: bool = True, key: str | None = None) -> int:
    """Columns set from ``changes`` by id, by default only where they are blank."""
    return table.rewrite(lambda df: df.join(changes.select(on), on, "left_semi"), lambda df: dml.backfill(df, changes, on, columns, only_blank), key)


def delete(table: SnapshotTable, ids: DataFrame, on: str, key: str | None = None) -> int:
    """Rows whose ``on`` is among the ids (one column) go."""
    ids = ids.toDF(on)
    return table.rewrite(lambda df: df.join(ids, on, "left_semi"), lambda df: df.join(ids, on, "left_anti"), key)


def find_or_insert(table: SnapshotTable, incoming: DataFrame, on: str = "google_id", required: tuple[str, ...] = ("google_id", "email"), key: str | None = None) -> tuple[int, DataFrame]:
    """(version, rejected rows): rows of unknown keys are added, known ones stay as they are.  Two writers that
    bring one new key add it once: the slower one looks again."""
    for _ in range(ATTEMPTS):
        state = table.state()
        known = table.read(state) if state.schema else table.spark.createDataFrame([], incoming.schema)
        new, rejected = dml.new_rows(known, incoming, on, required)
        if key is not None and key in state.keys:
            return state.keys[key], rejected
        rows = _fitted(new, state)
        files = table._write(rows)
        counts = table._counts((table._of(replace(state, schema=rows.schema.json()), files), 1))
        if table._commit(state, rows.schema.json(), files, (), counts, key):
            return state.version + 1, rejected
    raise Conflict(table.path)


def cascade_delete(deleted: DataFrame, quizzes: SnapshotTable, questions: SnapshotTable, attempts: SnapshotTable) -> None:
    """Quizzes, their questions and attempts go; comments stay.  What refers to a quiz goes before it, and each step
    can be repeated, so that a call that was cut short is completed by calling again."""
    ids = deleted.select("id")
    delete(questions, ids, "quiz_id")
    delete(attempts, ids, "quiz_id")
    delete(quizzes, ids, "id")
