"""Suffix-array dedup: bytes covered by a long string that also starts earlier.

A string of ``window`` bytes that occurs again is found by sorting suffixes.  Only suffixes
that can repeat are sorted, one bucket at a time:

1. Anchors.  Every window start belongs to the ``GRAM``-byte string of least hash inside
   its window; equal windows have equal anchors at equal offsets.  Windows that share an
   anchor form a block (about 35 windows, at most ``window - GRAM + 1``).
2. Blocks.  A block whose anchor string occurs in no other block can't repeat and goes no
   further.  Blocks whose hashes are equal are likely copies: which of them are is told by sorting.
3. Buckets.  Likely copies go with the first of them to the bucket of that one's document, neighbours
   as one run of bytes.  First blocks that share an anchor with blocks of other hashes,
   the places around an edit, or where a common passage begins and ends, go in slabs of ``SLAB`` offsets
   from the anchor to buckets by the bytes that all windows of a slab have in common.
4. Sorting.  The suffixes of a bucket (where its blocks begin; in slabs, every window) are sorted by
   their first ``PERIOD`` bytes; longer ties are resolved by the ranks of a difference-cover sample of
   the bucket's bytes, which is sorted once and looked up: for any two suffixes some shift of less
   than PERIOD puts both on sampled places.  Neighbours in that order that agree in ``window`` bytes, or in the
   bytes of all windows of their blocks, are repeats.
5. Hot buckets.  At the ends of a hot passage slabs share a bucket but reach into text that
   differs.  A bucket of more than ``BUCKET_ROWS`` rows isn't held: its windows are sorted
   by Spark, whole, and neighbours are compared as they stream by.  Runs are sorted ``SORTED_BYTES``
   at a time, always together with the first ones that they may repeat.

A hot passage or a group of thousands of copies doesn't gather anywhere: each task combines
equal blocks and equal slabs of its batch before they are shuffled, so one string is a row
per batch at most, and its further copies are settled on the spot: blocks by the same sort,
slabs by their bytes.

Order: documents by key, then places by start.  Defined results: a null text is empty; a
null key comes first; different texts under one key are documents of their own, in the order of
a hash of the text; equal rows (key and text) share a place in the order, so they
don't repeat each other and lose the same bytes; texts shorter than the window are kept; an
empty table gives none; other columns are ignored.  Texts are bytes of any length, cut into overlapping stretches inside a task.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import rows_a_batch, written
from .neardup import mix

GRAM, SLAB, PERIOD = 32, 8, 64
#: Bytes that a task looks at together; bits of a place in them.
STRETCH, PLACE_BITS = 2 << 20, 24
FIRST, SHARED, REMOVED, ASKED = 0, 1, 2, 3
NO_KEY = -(1 << 63)
#: Rows of a suffix bucket that a task holds and sorts; the windows of a larger one are sorted by Spark.
BUCKET_ROWS = 10_000
#: Bytes of runs that a task sorts at once; bits of a place that share a bucket of runs; marks of runs among slabs.
SORTED_BYTES, RUN_BITS = 1 << 20, 18
SOURCE_RUN, COPY_RUN = -2000, -1000

_RANDOM = np.random.Generator(np.random.PCG64(20240601))
_BYTES = _RANDOM.integers(0, 1 << 64, (2, 256), "u8")
_BASES = _RANDOM.integers(0, 1 << 63, 2, "u8") * np.uint64(2) + np.uint64(1)


def difference_cover(period: int) -> list[int]:
    """Residues of which every residue is a difference: 0 .. r - 1 and the multiples of r, r the root of the period."""
    r = int(np.ceil(np.sqrt(period)))
    return sorted({*range(r), *range(0, period, r)})


COVER = frozenset(difference_cover(PERIOD))


@functools.lru_cache(None)
def shift(i: int, j: int) -> int:
    """The least shift that puts residues i and j both on the cover."""
    return next(d for d in range(PERIOD) if (i + d) % PERIOD in COVER and (j + d) % PERIOD in COVER)


@functools.lru_cache(4)
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(_BASES[which])
    inverse = pow(base, -1, 1 << 64)
    up = np.multiply.accumulate(np.append(np.ones(1, "u8"), np.full(n, base, "u8")))
    down = np.multiply.accumulate(np.append(np.ones(1, "u8"), np.full(n, inverse, "u8")))
    return up, down


class Hashes:
    """64-bit hashes of any stretch of an array of bytes, vectorised over places."""

    def __init__(self, data: np.ndarray, which: int):
        n = STRETCH if len(data) > 1 << 16 else 1 << 16
        up, self.down = _powers(which, n)
        self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(_BYTES[which][data] * up[: len(data)], dtype="u8")])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def of_all(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def blocks(data: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(start, n_windows, anchor, gram hash, bytes' hash) of each block of concatenated
    documents; ``ends`` has, for every place, where its document ends."""
    reach = window - GRAM + 1
    empty = np.empty(0, "i8")
    if len(data) < window:
        return empty, empty, empty, empty.view("u8"), empty.view("u8")
    first = Hashes(data, 0)
    grams = first.of_all(GRAM)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype="u8")
    span = 1
    while span * 2 <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        rest = reach - span
        least = np.minimum(least[:-rest], least[rest:])
    anchor = (least & low).astype("i8")
    whole = np.arange(len(anchor)) + window <= ends[: len(anchor)]
    begins = whole.copy()
    begins[1:] &= (anchor[1:] != anchor[:-1]) | ~whole[:-1]
    start = np.flatnonzero(begins)
    stop = whole.copy()
    stop[:-1] &= begins[1:] | ~whole[1:]
    n = np.flatnonzero(stop) - start + 1
    at = anchor[start]
    second = Hashes(data, 1)
    body = mix(second.of(start, start + n - 1 + window) + (at - start).astype("u8"))
    return start, n, at, grams[at], body


def _stretches(order: np.ndarray, texts: list[bytes], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents in the given order, as arrays of at most STRETCH bytes: (bytes, ends, document of
    each piece, what to add to a place to get its start in the document)."""
    parts, held = [], 0
    for i in order:
        text = texts[i]
        for offset in range(0, max(1, len(text) - window + 1), STRETCH - window + 1):
            piece = text[offset : offset + STRETCH]
            if len(piece) < window:
                continue
            if held + len(piece) > STRETCH:
                yield _joined(parts)
                parts, held = [], 0
            parts.append((i, offset, piece))
            held += len(piece)
    if parts:
        yield _joined(parts)


def _joined(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(p for _, _, p in parts), "u1")
    shift_by = np.array([o for _, o, _ in parts]) - (ends - lengths)
    return data, np.repeat(ends, lengths), np.array([i for i, _, _ in parts], "i8"), np.stack([ends, shift_by])


def _in_order(keys: np.ndarray, subs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of documents by (key, sub), and each document's number in it, the same for equal ones."""
    order = np.lexsort((subs, keys))
    k, s = keys[order], subs[order]
    number = np.empty(len(order), "i8")
    number[order] = np.cumsum(np.append(0, (k[1:] != k[:-1]) | (s[1:] != s[:-1]))) if len(order) else order
    return order, number


def _packed(start: np.ndarray, n: np.ndarray, offset: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return (start << 20) | (n << 12) | (offset << 4) | kind


def _block_rows(window: int):
    """One row per distinct block of a stretch; blocks that repeat inside it are settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = [(x or "").encode() for x in batch.column(2).to_pylist()]
            by_key, number = _in_order(keys, subs)
            for data, ends, of, (stops, add) in _stretches(by_key, texts, window):
                start, n, anchor, gram, body = blocks(data, ends, window)
                if not len(start):
                    continue
                piece = np.searchsorted(stops, start, side="right")
                doc, at = of[piece], start + add[piece]
                who = number[doc]
                same = numbered(data, start, n, gram, body, window)
                order = np.lexsort((at, who, same, gram))
                g, b = gram[order], same[order]
                new_gram = np.append(True, g[1:] != g[:-1])
                new_block = new_gram | np.append(True, b[1:] != b[:-1])
                # an equal row's place: not a repeat of itself
                own = np.append(False, (who[order][1:] == who[order][:-1]) & (at[order][1:] == at[order][:-1]))
                variants = np.add.reduceat(new_block.astype("i8"), np.flatnonzero(new_gram))
                many = np.repeat(variants, np.diff(np.append(np.flatnonzero(new_gram), len(g)))) > 1
                kind = np.where(new_gram, np.where(many, SHARED, FIRST), np.where(new_block | own, ASKED, REMOVED))
                settled = order[kind == REMOVED]
                settled = settled[np.argsort(start[settled])]
                if len(settled):  # neighbours in one row
                    s, m, k = at[settled], n[settled], doc[settled]
                    head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1] + m[:-1])))
                    total = np.add.reduceat(m, head)
                    scatter = mix((keys[k[head]] ^ (s[head] << 20)).astype("u8")).view("i8")
                    yield _rows(scatter, total, keys[k[head]], subs[k[head]], _packed(s[head], 0 * total, 0 * total, REMOVED))
                rest = order[kind != REMOVED]
                kinds = kind[kind != REMOVED]
                scatter = mix((keys[doc[rest]] ^ (at[rest] << 20)).astype("u8"))
                yield _rows(
                    np.where(kinds == ASKED, scatter, gram[rest]).view("i8"),
                    body[rest].view("i8"),
                    keys[doc[rest]],
                    subs[doc[rest]],
                    _packed(at[rest], n[rest], (anchor - start)[rest], kinds),
                )

    return run


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.astype("i8", copy=False)) for x in columns], names=["gram", "body", "key", "sub", "packed"])


def _judged(rows: DataFrame) -> DataFrame:
    """(key, sub, start, n, offset, kind, source): stretches to remove (REMOVED), blocks for slabs (ASKED)
    and likely copies, with the place of the first of them; that one is its own source."""
    kind, start = F.col("packed").bitwiseAND(15), F.shiftright("packed", 20)
    by_gram, by_block = Window.partitionBy("gram"), Window.partitionBy("gram", "body")
    place = F.struct("key", "sub", start.alias("start"))
    seen = rows.repartition("gram").withColumn("source", F.min(place).over(by_block)).withColumn("last", F.max(place).over(by_block))
    seen = seen.withColumn("many", (F.min("body").over(by_gram) != F.max("body").over(by_gram)) | (F.max(kind).over(by_gram) == SHARED))
    what = F.when(kind >= REMOVED, kind).when(F.col("many") & (place == F.col("source")), ASKED).otherwise(FIRST)
    out = seen.select(
        "key",
        "sub",
        start.alias("start"),
        F.when(kind == REMOVED, F.col("body")).otherwise(F.shiftright("packed", 12).bitwiseAND(255)).alias("n"),
        F.shiftright("packed", 4).bitwiseAND(255).alias("offset"),
        what.alias("kind"),
        # an equal row's place is the same
        F.when((kind < REMOVED) & (F.col("source") != F.col("last")), F.col("source")).alias("source"),
    )
    return out.where((F.col("kind") != FIRST) | F.col("source").isNotNull())


def _runs(key: int, sub: int, text: bytes, blocks: dict[str, np.ndarray], window: int) -> Iterator[tuple]:
    """Rows of likely copies, or of first ones, that are neighbours here as in their source."""
    order = np.argsort(blocks["start"], kind="stable")
    start, n, of, of_sub, at = (blocks[f][order] for f in ("start", "n", "of", "of_sub", "at"))
    joined = (start[1:] == start[:-1] + n[:-1]) & (of[1:] == of[:-1]) & (of_sub[1:] == of_sub[:-1])
    joined &= (at[1:] - start[1:] == at[:-1] - start[:-1]) & (at[1:] >> RUN_BITS == at[:-1] >> RUN_BITS)
    heads = np.flatnonzero(np.append(True, ~joined)).tolist()
    for i, j in zip(heads, [*heads[1:], len(start)], strict=True):
        first, source = int(start[i]), (int(of[i]), int(of_sub[i]), int(at[i]))
        mark = SOURCE_RUN if source == (key, sub, first) else COPY_RUN
        bucket = xxhash.xxh3_64_intdigest(b"run %d %d %d" % (*source[:2], source[2] >> RUN_BITS)) - (1 << 63)
        data = n[i:j].astype("u1").tobytes() + text[first : int(start[j - 1] + n[j - 1]) - 1 + window]
        yield bucket, key, sub, first, j - i, mark, data


def _slab_rows(window: int):
    """The slabs of the blocks asked for, with their bytes; slabs that repeat inside a batch are settled here.
    Of a fifth column, the runs of likely copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[tuple, tuple[int, int, int]] = {}
            out: list[tuple] = []
            keys, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if batch.num_columns > 4:
                copies = batch.column(4)
                upto, fields = copies.offsets.to_numpy(), {f.name: copies.values.field(f.name).to_numpy() for f in copies.type.value_type}
            for i in np.lexsort((subs, keys)):
                key, sub, text = int(keys[i]), int(subs[i]), (batch.column(2)[i].as_py() or "").encode()
                for b in sorted(batch.column(3)[i].as_py(), key=lambda b: b["start"]):
                    first, last, anchor = b["start"], b["start"] + b["n"] - 1, b["start"] + b["offset"]
                    for s in range((anchor - last) // SLAB, (anchor - first) // SLAB + 1):
                        p, q = max(first, anchor - s * SLAB - SLAB + 1), min(last, anchor - s * SLAB)
                        data = text[p : q + window]
                        common = text[anchor - s * SLAB : anchor - s * SLAB - SLAB + 1 + window]
                        bucket = xxhash.xxh3_64_intdigest(common, seed=s) - (1 << 63)
                        held = seen.setdefault((bucket, anchor - p, data), (key, sub, p))
                        if held < (key, sub, p):
                            out.append((xxhash.xxh3_64_intdigest(b"%d %d" % (key, p)) - (1 << 63), key, sub, p, q - p + 1, -1, None))
                        else:
                            out.append((bucket, key, sub, p, q - p + 1, anchor - p, data))
                if batch.num_columns > 4 and upto[i] < upto[i + 1]:
                    out.extend(_runs(key, sub, text, {f: x[upto[i] : upto[i + 1]] for f, x in fields.items()}, window))
            if out:
                types = [pa.int64()] * 6 + [pa.binary()]
                names = ["bucket", "key", "sub", "start", "n", "offset", "data"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


class CoverSample:
    """Ranks of the sampled places of a bucket's texts, laid end to end: sorted once, when a tie first asks
    for them.  A rank is that of the ``depth`` bytes or more from its place on."""

    def __init__(self, texts: list[bytes], depth: int):
        self.texts, self.depth = texts, depth
        self.base = np.cumsum([0, *map(len, texts)]).tolist()

    @functools.cached_property
    def ranks(self) -> memoryview:
        size, words = self.base[-1], -(-self.depth // PERIOD)
        data = np.frombuffer(b"".join(self.texts) + bytes(PERIOD), "u1")
        sampled = np.array([r in COVER for r in range(PERIOD)])
        places = np.flatnonzero(np.tile(sampled, size // PERIOD + 1)[:size])
        heads = np.lib.stride_tricks.sliding_window_view(data, PERIOD)[places].view(">u8").astype("u8")
        order = np.lexsort(heads[:, ::-1].T)
        heads = heads[order]
        by_place = np.zeros(size + words * PERIOD, "i8")  # behind the end: before all others
        by_place[places[order]] = np.cumsum(np.append(True, (heads[1:] != heads[:-1]).any(axis=1)))
        rank = by_place[places]
        for k in range(1, words):  # a place's next PERIOD bytes begin on the sample, too
            rank = np.unique((rank << 32) | by_place[places + k * PERIOD], return_inverse=True)[1]
        out = np.zeros(len(by_place), "i8")
        out[places] = rank + 1
        return memoryview(out)

    def compare(self, a: tuple[int, int], b: tuple[int, int]) -> int:
        """Which of two suffixes (text, start) that agree in PERIOD bytes comes first."""
        x, y = self.base[a[0]] + a[1], self.base[b[0]] + b[1]
        d = shift(x % PERIOD, y % PERIOD)
        return self.ranks[x + d] - self.ranks[y + d]


def sort_suffixes(suffixes: list[tuple[int, int]], sample: CoverSample) -> list[tuple[int, int]]:
    """Suffixes (text, start) in order, compared to the sample's depth or more: by their first
    PERIOD bytes, longer ties by the sample's ranks."""
    by_head: dict[bytes, list[tuple[int, int]]] = {}
    for i, start in suffixes:
        by_head.setdefault(sample.texts[i][start : start + PERIOD], []).append((i, start))
    order: list[tuple[int, int]] = []
    for head in sorted(by_head):
        same = by_head[head]
        order.extend(same if len(same) == 1 else sorted(same, key=functools.cmp_to_key(sample.compare)))
    return order


def equal_suffixes(suffixes: list[tuple[int, int]], length: int, sample: CoverSample) -> Iterator[list[tuple[int, int]]]:
    """Suffixes (text, start) that agree in ``length`` bytes, as sorting puts them side by side: groups of two or more."""
    run: list[tuple[int, int]] = []
    same = None
    for x in sort_suffixes(suffixes, sample):
        data = sample.texts[x[0]][x[1] : x[1] + length]
        if data != same:
            if len(run) > 1:
                yield run
            run, same = [], data
        run.append(x)
    if len(run) > 1:
        yield run


def numbered(data: np.ndarray, start: np.ndarray, n: np.ndarray, gram: np.ndarray, body: np.ndarray, window: int) -> np.ndarray:
    """A number per block of a stretch, the same for equal ones: blocks of equal hashes are sorted as suffixes."""
    number = np.arange(len(start))
    order = np.lexsort((body, gram))
    again = (gram[order][1:] == gram[order][:-1]) & (body[order][1:] == body[order][:-1])
    pick = np.unique(np.concatenate([order[1:][again], order[:-1][again]]))
    if not len(pick):
        return number
    edge = np.zeros(len(data) + 1, "i4")  # blocks begin, and end, at different places
    edge[start[pick]] += 1
    edge[start[pick] + n[pick] - 1 + window] -= 1
    taken = np.cumsum(edge[:-1]) > 0
    place = (np.cumsum(taken) - 1)[start[pick]]
    sample = CoverSample([data[taken].tobytes()], 2 * window - GRAM)
    of = dict(zip(place.tolist(), pick.tolist(), strict=True))
    for k in np.unique(n[pick]).tolist():
        for run in equal_suffixes([(0, p) for p in place[n[pick] == k].tolist()], k - 1 + window, sample):
            number[[of[p] for _, p in run]] = of[run[0][1]]
    return number


def joined(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(key, sub, start, n) with neighbours in one row, repeated ones once."""
    out: list[tuple[int, int, int, int]] = []
    for key, sub, start, n in sorted(set(spans)):
        if out and out[-1][:2] == (key, sub) and out[-1][2] + out[-1][3] == start:
            out[-1] = (*out[-1][:3], out[-1][3] + n)
        else:
            out.append((key, sub, start, n))
    return out


class Runs:
    """Runs of blocks that may be copies, sorted some ``SORTED_BYTES`` at a time.  Buckets that are sorted
    together do no harm; of a bucket that is sorted in parts, the first ones stay for each part."""

    def __init__(self, window: int):
        self.window, self.held, self.size = window, {}, 0

    def add(self, bucket: int, key: int, sub: int, start: int, n: int, mark: int, data: bytes) -> list[tuple[int, int, int, int]]:
        """Takes a run, ``n`` lengths of blocks before its bytes; (key, sub, start, n) to remove of those before it."""
        out = []
        if self.size >= SORTED_BYTES:
            out = self.judged()
            self.held = {x: d for x, d in self.held.items() if x[0] == SOURCE_RUN and x[1] == bucket}
            self.size = sum(map(len, self.held.values()))
            if self.size >= SORTED_BYTES:  # then the next part gets as many bytes again
                self.size = 0
        self.held[mark, bucket, key, sub, start, n] = data
        self.size += len(data)
        return out

    def judged(self) -> list[tuple[int, int, int, int]]:
        runs = list(self.held)
        if all(mark == SOURCE_RUN for mark, *_ in runs):
            return []
        by_length: dict[int, list[tuple[int, int]]] = {}
        for i, x in enumerate(runs):
            at = 0
            for k in self.held[x][: x[5]]:
                by_length.setdefault(k, []).append((i, at))
                at += k
        sample = CoverSample([self.held[x][x[5] :] for x in runs], 2 * self.window - GRAM)
        gone = []
        for k, suffixes in by_length.items():
            for same in equal_suffixes(suffixes, k - 1 + self.window, sample):
                places = [(*runs[i][2:4], runs[i][4] + at) for i, at in same]
                first = min(places)
                gone.extend((*p, k) for p in places if p != first)
        return joined(gone)


def repeats_in_bucket(rows: list[tuple[int, int, int, int, int, bytes]], window: int) -> list[tuple[int, int, int]]:
    """(key, sub, start) of the windows of a bucket that an earlier one equals; rows: (key, sub, start, n, offset, bytes)."""
    found = []
    by_offset: dict[int, list[tuple[int, int]]] = {}
    for i, (_, _, _, n, offset, _) in enumerate(rows):
        for k in range(n):
            by_offset.setdefault(offset - k, []).append((i, k))
    sample = CoverSample([row[-1] for row in rows], window)
    for at in by_offset.values():  # equal windows have equal offsets from their anchor
        if len(at) < 2:
            continue
        for run in equal_suffixes(at, window, sample):
            places = [(*rows[i][:2], rows[i][2] + k) for i, k in run]
            first = min(places)
            found.extend(p for p in places if p != first)
    return found


def _sorted_buckets(window: int, most: int):
    """Bucket after bucket of a partition that is sorted by bucket, and first runs before others: (key, sub, start, n) to remove.  A bucket of slabs of
    more than ``most`` rows isn't held: its windows are handed on one by one, with their offsets and bytes.
    Small ones are sorted together, which does no harm, up to ``most`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, held, out, hot, runs = None, [], [], [], False, Runs(window)

        def flush() -> pa.RecordBatch:
            types = [pa.int64()] * 5 + [pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["key", "sub", "start", "n", "offset", "bytes"])
            out.clear()
            return batch

        def judge() -> None:
            found = joined([(*place, 1) for place in repeats_in_bucket(held, window)])
            out.extend((*span, None, None) for span in found)
            held.clear()

        def close() -> None:
            if len(rows) > 1:
                if len(held) + len(rows) > most:
                    judge()
                held.extend(rows)
            rows.clear()

        def hand_on() -> None:
            out.extend((k, u, s + i, 1, offset - i, data[i : i + window]) for k, u, s, n, offset, data in rows for i in range(n))
            rows.clear()

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for b, key, sub, start, n, offset, data in zip(*columns, strict=True):
                if b != bucket:
                    close()
                    bucket, hot = b, False
                if data is None:
                    out.append((key, sub, start, n, None, None))
                elif offset in (SOURCE_RUN, COPY_RUN):
                    out.extend((*span, None, None) for span in runs.add(bucket, key, sub, start, n, offset, data))
                else:
                    rows.append((key, sub, start, n, offset, data))
                    hot = hot or len(rows) > most
                    if hot:
                        hand_on()
                if len(out) >= 4096:
                    yield flush()
        close()
        judge()
        out.extend((*span, None, None) for span in runs.judged())
        if out:
            yield flush()

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sub, start, n) of the windows that equal an earlier one; sorted by (bytes, offset, key, sub, start)."""
    before = place = None
    for batch in batches:
        repeat = []
        for key, sub, start, offset, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (offset, data) != before:
                before, place = (offset, data), (key, sub, start)
            repeat.append((key, sub, start) != place)  # an equal row shares the first one's place
        gone = batch.select([0, 1, 2]).filter(pa.array(repeat, pa.bool_()))
        yield pa.RecordBatch.from_arrays([*gone.columns, pa.array(np.ones(gone.num_rows, "i8"))], names=["key", "sub", "start", "n"])


def keyed(docs: DataFrame, key: str, text: str, *more: Column) -> tuple[DataFrame, DataFrame]:
    """(key, sub, text, more) of every row, and (key, sub, text) once for each pair of these: null keys are NO_KEY;
    ``sub`` tells different texts of one key apart, is below zero for a null key and 0 for keys that
    occur once.  Where none occurs twice, both joins with texts read the same plan, so that Spark
    shuffles the texts once and reuses the exchange."""
    none = F.col(key).isNull()
    named = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("key"), none.alias("__none"), F.coalesce(F.col(text), F.lit("")).alias("text"), *more)
    again = written(named.groupBy("key").count().where("count > 1").select("key", F.lit(True).alias("__again")))
    others = named.columns[3:]
    if again.isEmpty():
        every = named.select("key", F.lit(0).cast("long").alias("sub"), "text", *others)
        return every, every.select("key", "sub", "text")
    h = F.xxhash64("text")
    sub = F.when(F.col("__none"), h.bitwiseOR(F.lit(-(1 << 63)))).otherwise(h.bitwiseAND(F.lit((1 << 63) - 1)))
    every = named.join(again, "key", "left").select("key", F.when(F.col("__again"), sub).otherwise(0).alias("sub"), "text", "__again", *others)
    # what is worked on has each document once, however often it is repeated
    once = every.where("__again").dropDuplicates(["key", "sub"]).select("key", "sub", "text")
    return every.drop("__again"), every.where("__again IS NULL").select("key", "sub", "text").unionByName(once)


def removals(named: DataFrame, window: int = 100) -> DataFrame:
    """(key, sub, spans): for each of the distinct documents of :func:`keyed` that loses bytes, (start, n) of the
    windows that also start earlier; a window removes its ``window`` bytes."""
    # equal blocks are combined batch by batch
    rows = rows_a_batch(named, 2000).select("key", "sub", "text").mapInArrow(_block_rows(window), "gram long, body long, key long, sub long, packed long")
    judged = written(_judged(rows))
    slab = F.when(F.col("kind") == ASKED, F.struct("start", "n", "offset"))
    likely = F.when(F.col("source").isNotNull(), F.struct("start", "n", F.col("source.key").alias("of"), F.col("source.sub").alias("of_sub"), F.col("source.start").alias("at")))
    asked = judged.where(F.col("kind") != REMOVED).groupBy("key", "sub").agg(F.collect_list(slab).alias("blocks"), F.collect_list(likely).alias("copies"))
    schema = "bucket long, key long, sub long, start long, n long, offset long, data binary"
    slabs = named.join(asked, ["key", "sub"]).select("key", "sub", "text", "blocks", "copies").mapInArrow(_slab_rows(window), schema)
    schema = "key long, sub long, start long, n long, offset long, bytes binary"
    looked = written(slabs.repartition("bucket").sortWithinPartitions("bucket", "offset").mapInArrow(_sorted_buckets(window, BUCKET_ROWS), schema))
    # what was handed on is sorted by Spark, which spills, and compared as a stream
    windows = looked.where("bytes IS NOT NULL").select("key", "sub", "start", "offset", "bytes").repartition("bytes", "offset").sortWithinPartitions("bytes", "offset", "key", "sub", "start")
    spans = ["key", "sub", "start", "n"]
    settled = looked.where("bytes IS NULL").select(*spans).unionByName(windows.mapInArrow(_neighbours, "key long, sub long, start long, n long"))
    both = judged.where(F.col("kind") == REMOVED).select(*spans).unionByName(settled)
    return both.groupBy("key", "sub").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def merged(spans: list[dict] | None, size: int, window: int) -> list[tuple[int, int]]:
    """Maximal removed runs [a, b) of a text of ``size`` bytes."""
    runs: list[tuple[int, int]] = []
    for a, b in sorted((s["start"], min(size, s["start"] + s["n"] - 1 + window)) for s in spans or ()):
        if a >= size:
            continue
        if runs and a <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
        else:
            runs.append((a, b))
    return runs


def kept_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py().encode()
                runs = merged(batch.column(2)[i].as_py(), len(data), window)
                kept, at = hashlib.sha256(), 0
                for a, b in runs:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in runs), len(runs), kept.hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    named, once = keyed(docs, key, text, F.col(key).cast("long").alias("id"))
    joined = named.join(removals(once, window), ["key", "sub"], "left").select("id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 100) -> DataFrame:
    """The documents, with their columns, less the bytes that also start earlier.  A character
    that loses a byte is removed whole; a document of which nothing is left has an empty text."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i in range(batch.num_rows):
                whole = batch.column(at)[i].as_py()
                spans = batch.column(batch.num_columns - 1)[i].as_py()
                if not spans or whole is None:
                    texts.append(whole)
                    continue
                data, left, upto = whole.encode(), [], 0
                for a, b in merged(spans, len(data), window):
                    left.append(data[upto:a].decode("utf-8", "ignore"))
                    upto = b
                texts.append("".join([*left, data[upto:].decode("utf-8", "ignore")]))
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    whole = F.struct(*map(F.col, docs.columns)).alias("__row")
    named, once = keyed(docs, key, text, whole)
    spans = removals(once, window)
    back = named.join(spans, ["key", "sub"], "left").select("__row.*", F.col("spans").alias("__spans"))
    out = back.mapInArrow(run, T.StructType(docs.schema.fields))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out
