"""Packing token sequences: vector best fit over all documents at once.

A document's ids, with an end mark, are cut only if they exceed what one sequence holds.  A piece
uses up three capacities of its sequence: tokens, documents (one) and attention cost (its
length squared).  Pieces are taken from the longest down; of the sequences in which a piece
meets every constraint the rule picks one by weighted shares of the capacities: ``norm`` the
one that would be left with the smallest residual norm, ``dot`` the one whose residual has the
largest dot product with the piece.  A new sequence is opened only where none fits.

All three demands follow from the length, so pieces of one length are interchangeable, and so
are sequences with equal residuals.  The plan is therefore made from the number of pieces of each
length, which is one number for each length up to the capacity, however many documents there are:
the driver packs runs of equal pieces into runs of equal sequences and gets what packing piece
by piece would give.  What travels to the tasks is a table of runs.  A piece finds its place
there by its number among the pieces of its length: its number in its task, plus those of the
tasks before.  Texts are read and encoded once, and only counts are shuffled.

Defined results: a null text is an empty one, of the end mark alone; a null key is kept, and
rows with one key, or equal rows, are documents of their own; a text of any length is cut into whole
pieces, of which the first may be shorter; special strings inside texts are their own ids, as the
library's default has it; an empty table gives no rows; further columns are ignored, whatever
their names.  The numbers of sequences are dense from 0.
"""

from __future__ import annotations

import heapq
import math
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytebpe import CACHED_CHARS, CACHED_PIECES, broadcast_file, byte_alphabet, default_path, loaded, pieces
from .common import written


@dataclass(frozen=True)
class Capacity:
    """What a sequence may hold; None: no limit besides the tokens'."""

    tokens: int = 2048
    documents: int | None = None
    attention: int | None = None

    def limits(self) -> tuple[int, int, int]:
        return self.tokens, self.documents or self.tokens, self.attention or self.tokens**2

    def longest(self) -> int:
        """Tokens of the longest piece that fits alone."""
        tokens, documents, attention = self.limits()
        if min(tokens, documents, attention) < 1:
            raise ValueError("a sequence must hold a token")
        return min(tokens, math.isqrt(attention))


# -- ids ---------------------------------------------------------------------------------


class _IdBytes(dict):
    """A piece of text to its ids as little-endian 32-bit numbers, by the library's model."""

    def __init__(self, file_json: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(file_json).model
        self.letters = {b: ord(c) for b, c in byte_alphabet().items()}

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        value = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = value
        return value


_KNOWN: dict[str, _IdBytes] = {}


def encoder(file_json: str) -> Callable[[str], bytes]:
    """Text to the bytes of its ids; what it keeps stays with the Python worker."""
    bpe = loaded(file_json)
    if file_json not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[file_json] = _IdBytes(file_json)
    known = _KNOWN[file_json]

    def encode(text: str) -> bytes:
        out = []
        for k, part in enumerate(bpe.segments(text)):
            out.append(struct.pack("<I", bpe.special[part]) if k % 2 else b"".join(map(known.__getitem__, pieces(part))))
        return b"".join(out)

    return encode


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, behind a first that may be shorter."""
    first = n % longest or longest
    return [(0, first), *((s, longest) for s in range(first, n, longest))] if n > longest else [(0, n)]


def cut_pieces(docs: DataFrame, capacity: Capacity, key: str = "doc_id", text: str = "text", end_id: int = 0, with_ids: bool = False, tokenizer_path: str | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32, task, nth[, ids]): every piece, the ``nth`` of its length in its task."""
    file = broadcast_file(docs.sparkSession, tokenizer_path or default_path())
    longest, end = capacity.longest(), struct.pack("<I", end_id)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, task = encoder(file.value), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows: list[tuple] = []
                for at, x in enumerate(part.column(1)):
                    data = encode(x.as_py() or "") + end
                    for no, (start, length) in enumerate(cut(len(data) // 4, longest)):
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((at, no, start, length, zlib.crc32(own), seen[length], own))
                        seen[length] += 1
                at, no, start, length, crc, nth, own = zip(*rows, strict=True)
                columns = [part.column(0).take(pa.array(at)), pa.array(no, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array([task] * len(at), pa.int32()), pa.array(nth, pa.int64())]
                if with_ids:
                    ids = np.frombuffer(b"".join(own), "<u4").astype("i4")
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *length], dtype="i4")), pa.array(ids)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "key {}, piece int, start long, length long, ids_crc32 long, task int, nth long".format(kind) + ", ids array<int>" * with_ids
    names = ["key", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


# -- the plan ----------------------------------------------------------------------------

#: Of a run of pieces of one length: the number of its first, the sequence that gets it, pieces a sequence, tokens before them.
RUN = np.dtype([("length", "i8"), ("first", "i8"), ("sequence", "i8"), ("each", "i8"), ("offset", "i8")])


def plan(counts: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[np.ndarray, int]:
    """(runs by length and first, number of sequences) from the number of pieces of each length."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    limits = np.array(capacity.limits(), "i8")
    scaled = np.array(weights) / limits.astype("f8") ** 2
    # sequences alike: (first, how many) and what is left of their capacities
    spans, left, runs, opened = np.zeros((0, 2), "i8"), np.zeros((0, 3), "i8"), [], 0

    def score(rest: np.ndarray, item: np.ndarray) -> np.ndarray:
        return ((rest - item) ** 2.0 * scaled).sum(axis=-1) if rule == "norm" else -(rest * (item * scaled)).sum(axis=-1)

    for length in sorted(counts, reverse=True):
        item, lacking, rank = np.array([length, 1, length * length], "i8"), counts[length], 0
        fits = np.flatnonzero((left >= item).all(axis=1))
        heap = list(zip(score(left[fits], item).tolist(), spans[fits, 0].tolist(), spans[fits, 1].tolist(), map(tuple, left[fits].tolist()), strict=True))
        heapq.heapify(heap)
        done: list[tuple[int, int, tuple]] = []
        while lacking:
            if heap:
                _, first, many, rest = heapq.heappop(heap)
                # by norm, a sequence that got a piece stays the best as long as the next fits; by dot product, others get ahead
                each = int((np.array(rest) // item).min()) if rule == "norm" else 1
            else:
                rest = tuple(limits.tolist())
                each = int((limits // item).min())
                first, many = opened, -(-lacking // each)
                opened += many
            now = min(lacking, many * each)
            runs.append((length, rank, first, each, limits[0] - rest[0]))
            full, over = divmod(now, each)
            for f, m, k in ((first, full, each), (first + full, int(over > 0), over), (first + full + (over > 0), many - full - (over > 0), 0)):
                after = tuple(int(r - k * i) for r, i in zip(rest, item, strict=True))
                if m and k and all(after >= item):
                    heapq.heappush(heap, (float(score(np.array(after), item)), f, m, after))
                elif m:
                    done.append((f, m, after))
            rank, lacking = rank + now, lacking - now
        done += [h[1:] for h in heap]
        untouched = np.ones(len(spans), bool)
        untouched[fits] = False
        spans = np.concatenate([spans[untouched], np.array([d[:2] for d in done], "i8").reshape(-1, 2)])
        left = np.concatenate([left[untouched], np.array([d[2] for d in done], "i8").reshape(-1, 3)])
        room = (left > 0).all(axis=1)
        spans, left = spans[room], left[room]
    found = np.array(runs, RUN)
    return found[np.lexsort((found["first"], found["length"]))], opened


def places(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of these lengths and numbers."""
    lengths, starts = np.unique(runs["length"], return_index=True)
    sequence, offset = np.empty(len(length), "i8"), np.empty(len(length), "i8")
    for own in np.unique(length):
        k = np.searchsorted(lengths, own)
        r = runs[starts[k] : starts[k + 1] if k + 1 < len(starts) else len(runs)]
        at = np.flatnonzero(length == own)
        run = r[np.searchsorted(r["first"], rank[at], "right") - 1]
        sequences, nth = np.divmod(rank[at] - run["first"], run["each"])
        sequence[at], offset[at] = run["sequence"] + sequences, run["offset"] + nth * own
    return sequence, offset


def place_pieces(cut: DataFrame, capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A written table of :func:`cut_pieces` with ``sequence_id`` and ``offset`` for ``task`` and ``nth``."""
    spark = cut.sparkSession
    held = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row per length
    runs = spark.sparkContext.broadcast(plan(counts, capacity, rule, weights)[0])  # a few runs per length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    before = held.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    kept = [c for c in cut.columns if c not in ("task", "nth")]
    ranked = cut.join(before, ["length", "task"]).select(*kept, (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, places(runs.value, length, rank))], names=[*kept, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: Capacity | None = None, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0), **options) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    capacity = capacity or Capacity()
    cut = written(cut_pieces(docs, capacity, key, text, **options))
    return place_pieces(cut, capacity, rule, weights).withColumnRenamed("key", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the sequences themselves, from a packing with ids; each holds a bounded number."""
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return whole.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
