"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (an
offset and a stride, from a hash of its name).  Shards take turns, each claiming the first
slot in its order that is still free, until the table is full: shares differ by at most
one slot, and when a shard goes away few keys of the others move.  A row's key is hashed
to a slot and the slot names the shard: one broadcast lookup, no shuffle.

The table is configuration: its size is a parameter and doesn't depend on the data, so
the driver fills it and its broadcast has a fixed bound.  Rows are placed by DataFrame
functions alone.

Defined results: a null key is placed like the empty string; equal keys, also in repeated
rows, go to the same shard; an empty table gives an empty result; further columns pass
through, and an output name that the input already has is refused.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLOTS = 1 << 20


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int) -> list[int]:
    """The index of the shard behind each slot."""
    if not _is_prime(slots) or slots > MAX_SLOTS:
        raise ValueError(f"the table's size must be a prime of at most {MAX_SLOTS}")
    if not shards or len(set(shards)) < len(shards) or len(shards) > slots:
        raise ValueError("shards must have names of their own, and no more of them than slots")
    start, stride = [], []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(h[:8], "big") % slots)
        stride.append(int.from_bytes(h[8:16], "big") % (slots - 1) + 1)
    table, free = [-1] * slots, slots
    while free:
        for i in range(len(shards)):
            while table[start[i]] >= 0:
                start[i] = (start[i] + stride[i]) % slots
            table[start[i]] = i
            free -= 1
            if not free:
                break
    return table


def table_frame(spark: SparkSession, shards: list[str], slots: int) -> DataFrame:
    """(slot, shard) rows of the lookup table."""
    filled = json.dumps(fill_table(shards, slots))
    return spark.range(1).select(F.posexplode(F.from_json(F.lit(filled), "array<int>")).alias("slot", "shard"))


def slot_of(key: Column, slots: int) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(df: DataFrame, key: str, shards: list[str], slots: int = 65537) -> DataFrame:
    """Adds ``slot`` and ``shard``."""
    if clash := {"slot", "shard"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    table = F.broadcast(table_frame(df.sparkSession, shards, slots))
    return df.withColumn("slot", slot_of(F.col(key), slots)).join(table, "slot").select(*df.columns, "slot", "shard")


def shard_documents(docs: DataFrame, shards: int = 64, slots: int = 65537) -> DataFrame:
    """doc_id, n_bytes, slot and shard of every document."""
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return place(sized, "doc_id", [f"shard-{i:05d}" for i in range(shards)], slots)
