"""MinHash near-duplicates.

Each document's set of word shingles is hashed once; the hashes fall into ``BANDS * ROWS``
bins by their leading bits and each bin keeps its least value (one-permutation hashing).
An empty bin borrows from the first occupied bin in a random order of its own, the same
for all documents (optimal densification).  Bands of ROWS bins make buckets.  Documents
with equal sets are one vertex from the start.

In each bucket one document is the centre of a star, and only (centre, member) pairs become
candidates: their number is bounded by documents * bands however large a bucket is.  The
centre is the member that shares most buckets with others, so that the original of
many edited copies is the centre wherever it occurs.  Candidates are confirmed on the
full sets, which also gives each member's exact distance from its centre.

A centre has then been held against its whole bucket and leaves it.  Of the other members
those stay that may still be linked with a member of another component: the Jaccard
distance is a metric, so two members whose distances from the centre differ by more than
a link's greatest distance aren't linked.  Distances are counted in cells of a twentieth,
so this is an aggregate by (bucket, cell) and no pair is looked at.  ``STAR_ROUNDS`` such
rounds settle most buckets; the next centres are of the bucket's smallest component.

What stays after them is settled exactly, whatever its amount: the documents that remain
are joined by the prefixes of their full sets.  Shingles are ordered from rare to frequent,
those that only one component holds before all others.  Two sets that are similar enough
share a shingle so early that what follows it can still hold their overlap, so only such
pairs are looked at.  Sets are first compared by profile (shingle, size, how many shingles
follow), then by component, and only then by document, so a family that shares its
frequent shingles isn't paired; what remains of a hot profile is joined in a grid of parts.
Of these pairs those are confirmed on their sets that share enough of their prefixes:
what follows the prefixes can't make up for more.

With 32 bands of 4 rows two sets at similarity 0.8 share no bucket with probability
(1 - 0.8 ** 4) ** 32 = 5e-8.

Defined results: letters A-Z are lower-cased; a text of fewer words than a shingle is one
shingle of all its words; a null text or one without words has no set and is linked with
nothing; rows with a null doc_id are linked with nothing, are kept and have a null
component; rows that share a doc_id are one document, linked by any of its texts; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import rows_a_batch, scratch, written
from .components import connected_components

BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
#: Rounds of stars before what is left is joined by prefixes.
STAR_ROUNDS = 3
#: Cells of a distance from a centre.
CELLS = 20
#: Components of a profile that are joined in one part.
PART = 1000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, "u8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", n)
    k = min(width, n)
    out = np.zeros(n - k + 1, "u8")
    for i in range(k):
        out = mix(out + _STEP + h[i : n - k + 1 + i])
    return np.unique(out)


def _borrow_order() -> np.ndarray:
    """For each bin, all bins in a pseudorandom order."""
    i = np.arange(BINS, dtype="u8")
    return np.argsort(mix(i[:, None] * np.uint64(BINS) + i[None, :] + _STEP), axis=1)


BORROW = _borrow_order()


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each bin, empty bins filled."""
    at = (s >> np.uint64(40)) * np.uint64(BINS) >> np.uint64(24)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))  # s is sorted, so each bin's least is its first
    filled = np.full(BINS, False)
    values = np.zeros(BINS, "u8")
    filled[at[first]] = True
    values[at[first]] = s[first]
    if len(first) < BINS:
        empty = np.flatnonzero(~filled)
        source = BORROW[empty, np.argmax(filled[BORROW[empty]], axis=1)]
        values[empty] = values[source]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    v = values.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype="u8") * _STEP
    for i in range(ROWS):
        key = mix(key + v[:, i])
    return key.view("i8")


def _sketches(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(doc_id, n, fp, bands): set size, set fingerprint, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes, prints, keys, lengths = [], [], [], []
                for x in part.column(1):
                    s = shingle_set(x.as_py(), width)
                    sizes.append(len(s))
                    prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(bands(signature(s)) if len(s) else np.empty(0, "i8"))
                    lengths.append(len(keys[-1]))
                offsets = pa.array(np.cumsum([0, *lengths], dtype="i4"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys)))],
                    names=["doc_id", "n", "fp", "bands"],
                )

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, n long, fp binary, bands array<long>")


def _once(rows: DataFrame, repeated: DataFrame | None, *columns: str) -> DataFrame:
    """The rows, of documents whose id is repeated each different (doc_id, columns) once."""
    if repeated is None:
        return rows
    return rows.join(repeated, "doc_id", "left_anti").unionByName(rows.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", *columns]))


def _sets(docs: DataFrame, key: str, text: str, width: int, wanted: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(doc_id, shingles): the full sets of the documents that take part in candidates, equal ones of a document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(x.as_py(), width).tobytes() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    texts = _once(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi"), repeated, "text")
    return _once(texts.mapInArrow(run, "doc_id long, shingles binary"), repeated, "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), with whether any of their full sets are similar enough and the least and
    largest cell of their distance; ``pairs`` may carry the components (ca, cb) as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, cells = [], []
            for x, y in zip(batch.column(4), batch.column(5), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), "u8") for v in (x, y))
                both = np.concatenate([s, t])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                union = len(both) - inter
                linked.append(100 * inter >= percent * union)
                cells.append(CELLS * (union - inter) // union)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(linked, pa.bool_()), pa.array(cells, pa.int32())], names=["a", "b", "ca", "cb", "linked", "cell"])

    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    compared = pairs.join(right, "b").join(left, "a").select("a", "b", "ca", "cb", "sa", "sb").mapInArrow(run, "a long, b long, ca long, cb long, linked boolean, cell int")
    # a document that has several texts has several sets
    return compared.groupBy("a", "b", "ca", "cb").agg(F.max("linked").alias("linked"), F.min("cell").alias("lo"), F.max("cell").alias("hi"))


def _stars(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every bucket's members but its centre, with the centre (a, na, ca), and the pairs to look at.
    rows: (bucket, doc_id, n, score, component)."""
    by_component = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct(-F.col("score"), "doc_id", "n")).alias("c"))
    centres = by_component.groupBy("bucket").agg(F.min(F.struct("k", "c", "component")).alias("c"))
    centres = written(centres.select("bucket", F.col("c.c.doc_id").alias("a"), F.col("c.c.n").alias("na"), F.col("c.component").alias("ca")))
    members = written(rows.join(centres, "bucket").where("doc_id <> a"))
    apart = members.where((F.col("component") != F.col("ca")) & _size_fits(percent))
    first, doc = F.col("a") < F.col("doc_id"), F.col("doc_id")
    pairs = apart.select(
        F.least("a", doc).alias("a"),
        F.greatest("a", doc).alias("b"),
        F.when(first, F.col("ca")).otherwise(F.col("component")).alias("ca"),
        F.when(first, F.col("component")).otherwise(F.col("ca")).alias("cb"),
    )
    return members, pairs.distinct()


def _size_fits(percent: int) -> Column:
    return 100 * F.least("n", "na") >= percent * F.greatest("n", "na")


def _still_open(members: DataFrame, tested: DataFrame, merged: DataFrame, percent: int) -> DataFrame:
    """The members that may be linked with one of another component of their bucket, as rows for :func:`_stars`.
    tested: confirmed pairs; merged: (v, component) for components that are now part of another."""
    known = tested.select(F.col("a").alias("t1"), F.col("b").alias("t2"), "lo", "hi")
    on = (F.least("a", "doc_id") == F.col("t1")) & (F.greatest("a", "doc_id") == F.col("t2"))
    refuted = F.floor(CELLS * (F.greatest("n", "na") - F.least("n", "na")) / F.greatest("n", "na")).cast("int")
    least = F.coalesce("lo", F.when(_size_fits(percent), 0).otherwise(F.greatest(refuted - 1, F.lit(0))))
    named = merged.select(F.col("v").alias("component"), F.col("component").alias("now"))
    placed = (
        members.join(known, on, "left")
        .select("bucket", "doc_id", "n", "score", "component", least.alias("lo"), F.coalesce("hi", F.lit(CELLS)).alias("hi"))
        .join(named, "component", "left")
        .select("bucket", "doc_id", "n", "score", F.coalesce("now", "component").alias("component"), "lo", "hi")
    )
    placed = written(placed)
    # two members may be linked if their cells are no further apart than a link is long
    reach = -(-CELLS * (100 - percent) // 100)
    near = placed.select("bucket", "component", F.explode(F.sequence(F.col("lo") - reach, F.col("hi") + reach)).alias("cell"))
    shared = near.groupBy("bucket", "cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    shared = shared.groupBy("bucket").agg(F.collect_list("cell").alias("cells"))  # at most CELLS and twice the reach
    return written(placed.join(shared, "bucket").where(F.arrays_overlap("cells", F.sequence("lo", "hi"))).select("bucket", "doc_id", "n", "score", "component"))


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, component, n, held, prefix) of members (doc_id, component): among the shingles of the prefix is the first
    that a set of n shares with a similar set of another component; ``held`` of the n other components have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py()
                x = np.frombuffer(data, "i8")
                same = [pa.array(np.full(len(x), v, "i8")) for v in (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), xxhash.xxh3_64_intdigest(data) - (1 << 63), len(x))]
                yield pa.RecordBatch.from_arrays([*same, pa.array(x)], names=["doc_id", "component", "which", "n", "x"])

    shingles = sets.join(members, "doc_id").select("doc_id", "component", "shingles").mapInArrow(run, "doc_id long, component long, which long, n long, x long")
    seen = shingles.groupBy("x").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    common = written(seen.where("lo <> hi").select("x", "f"))
    ordered = shingles.join(common, "x").groupBy("doc_id", "component", "which", "n").agg(F.sort_array(F.collect_set(F.struct("f", "x"))).alias("xs"))
    # of n shingles the first n - ceil(n * percent / 100) + 1; those of one component alone come before xs
    longest = F.col("n") - F.expr(f"(n * {percent} + 99) div 100") + 1 - (F.col("n") - F.size("xs"))
    prefix = F.transform(F.slice("xs", 1, longest.cast("int")), lambda s: s["x"])
    return written(ordered.where(longest > 0).select("doc_id", "component", "n", F.size("xs").cast("long").alias("held"), prefix.alias("prefix")))


def _left_open(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of members (doc_id, component) in different components that can be similar enough."""
    prefixed = _prefixes(members, sets, percent)
    early = prefixed.select("doc_id", "component", "n", "held", F.posexplode("prefix").alias("at", "x"))
    # r of the shingles follow, x included
    prefixes = written(early.select("doc_id", "component", "n", "x", (F.col("held") - F.col("at")).alias("r")))
    groups = written(prefixes.select("x", "n", "r", "component").distinct())
    profiles = written(groups.groupBy("x", "n", "r").agg(F.count(F.lit(1)).alias("k"), F.min("component").alias("lo"), F.max("component").alias("hi")))
    named = lambda df, side: df.select("x", *(F.col(c).alias(c + side) for c in df.columns if c != "x"))
    met = named(profiles, "_a").join(named(profiles, "_b"), "x").where(
        "(n_a < n_b OR n_a = n_b AND r_a <= r_b) AND least(lo_a, lo_b) <> greatest(hi_a, hi_b)"
        f" AND 100 * n_a >= {percent} * n_b AND {100 + percent} * least(r_a, r_b) >= {percent} * (n_a + n_b)"
    )
    met = written(met.select("x", "n_a", "r_a", "n_b", "r_b", F.ceil(F.sqrt(F.col("k_a").cast("double") * F.col("k_b")) / PART).cast("long").alias("parts")))
    # a grid of parts: a component is in one row of it as a, in one column as b
    part = lambda side: F.pmod(F.xxhash64("component" + side), "parts")
    all_parts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    on = ["x", "n_a", "r_a", "n_b", "r_b"]
    left = named(groups, "_a").join(met, ["x", "n_a", "r_a"]).select(*on, "component_a", part("_a").alias("p"), all_parts.alias("q"))
    right = named(groups, "_b").join(met, ["x", "n_b", "r_b"]).select(*on, "component_b", part("_b").alias("q"), all_parts.alias("p"))
    differ = "component_a <> component_b AND (n_a <> n_b OR r_a <> r_b OR component_a < component_b)"
    apart = left.join(right, [*on, "p", "q"]).where(differ)
    pairs = apart.join(named(prefixes, "_a"), ["x", "n_a", "r_a", "component_a"]).join(named(prefixes, "_b"), ["x", "n_b", "r_b", "component_b"])
    pairs = pairs.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct()
    # what two sets share is in both prefixes, or behind the prefix that ends first
    side = lambda s: prefixed.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("prefix").alias(f"p{s}"), (F.col("held") - F.size("prefix")).alias(f"rest{s}"))
    enough = F.size(F.array_intersect("pa", "pb")) + F.greatest("resta", "restb")
    return pairs.join(side("a"), "a").join(side("b"), "b").where((100 + percent) * enough >= percent * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: two documents are linked if
    the Jaccard similarity of their sets of ``width``-word shingles is at least ``percent`` hundredths."""
    with scratch() as keep:
        sketches = keep(written(_sketches(rows_a_batch(docs, 500), key, text, width)))
        with_set = sketches.where("n > 0 AND doc_id IS NOT NULL")
        repeated = written(with_set.groupBy("doc_id").count().where("count > 1").select("doc_id"))
        repeated = None if repeated.isEmpty() else repeated
        with_set = _once(with_set, repeated, "fp")
        with_set = with_set if repeated is None else written(with_set)
        # equal sets: one vertex each, the least id
        # written, so that the join below reads two shuffles and a hot set can be split
        classes = written(with_set.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("fp", "rep"))
        copies = written(with_set.select("doc_id", "fp").join(classes, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"), "fp").distinct())
        members = with_set.join(copies.select(F.col("a").alias("doc_id"), "fp"), ["doc_id", "fp"], "left_anti").select("doc_id", "n", F.explode("bands").alias("bucket"))
        shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("in_bucket")).where("in_bucket > 1")
        rows = written(members.join(shared, "bucket"))
        scores = written(rows.groupBy("doc_id").agg(F.sum("in_bucket").alias("score")))
        rows = rows.drop("in_bucket").join(scores, "doc_id").withColumn("component", F.col("doc_id"))
        sets = written(_sets(docs, key, text, width, scores.select("doc_id"), repeated))

        links = copies.select("a", "b")
        for _ in range(STAR_ROUNDS):
            members, pairs = _stars(rows, percent)
            tested = written(_confirmed(pairs, sets, percent))
            found = tested.where("linked")
            links = links.unionByName(found.select("a", "b"))
            merged = connected_components(found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            rows = _still_open(members, tested, merged, percent)
            if rows.isEmpty():
                break
        else:
            left = written(rows.select("doc_id", "component").distinct())
            apart = _left_open(left, sets, percent).select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
            links = links.unionByName(written(_confirmed(apart, sets, percent)).where("linked").select("a", "b"))
        labels = keep(connected_components(links))
    named = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(labels, F.col("doc_id") == F.col("v"), "left")
    component = F.coalesce("component", "doc_id")
    return named.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those that have a near-duplicate of smaller id in their component,
    with their columns; of rows that share an id and a text one stays."""
    gone = near_duplicates(docs, width=width, percent=percent).where("NOT kept").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = written(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"))
    if twice.isEmpty():
        return left
    # combined before they are shuffled, so that a row with very many copies isn't gathered
    first = left.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
