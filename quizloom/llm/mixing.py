"""Mixing sources to target weights, in DataFrame functions alone.

The words of each source are packed into blocks of ``block_words`` words, documents in a
fixed pseudorandom order.  A source's quota is the number of slots of the mix that its target
asks for.  Every output shard draws how many of its slots each source gets: a multinomial draw,
with the quotas' shares as probabilities.  A shard's slots go to the sources by offset, in
the sources' order, and each source numbers its slots over all shards.  Since
independent draws miss the quotas by about their root, what a source has drawn too much is handed to
those that lack slots, at even distances over all shards, so the totals are the quotas.
A source's k-th slot takes block ``permutation(k mod n)`` of its n blocks, with another
permutation for every turn through the source; slots and blocks are then joined by
(source, block).

A document's words taken are the words of its part of each block times the number of slots
that took the block.  A source's quota is at most ``cap`` times its number of blocks, so a
block is taken at most ``cap`` times and a document at most ``cap`` times its size.

Scale: sizes are summed to (source, chunk) before any window; chunks hold about
``chunk_docs`` documents of a source however large it is, so a source with a third of all
rows is split over many tasks.  Sums over chunks and over shards are prefix sums of two
levels.  Targets and the line of quotas have a row per source and are windows without partitions: one
task holds all sources, which is meant for up to a million of them.  Slots are made from shards in an explicit number of partitions.  The text is
not shuffled by :func:`mix_plan`.

Defined results: a null text has no words and takes none; a null source is a source of its
own, sorted last; a null or repeated doc_id is a row like any other (rows with the same id
and size are interchangeable); ties in the order are broken by size; an empty table, or
one without words, gives targets of 0; further columns don't matter to the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORDS = r"[^\x20\x09-\x0D]+"
#: Pieces of the line of all quotas, by which a drawn place finds its source.
PIECES = 4096
#: Numbers whose prefix sum one task holds; shards whose slots it makes.
FAN, SHARDS_A_TASK = 1024, 32
#: Sources whose stretches of the line may be broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size).

    Targets share 100% of all sizes by weight; a target stops at ``cap`` times its
    source's size and the excess is shared again by weight.  With the sources ordered by
    cap * size / weight, the capped ones are a prefix: source k is uncapped as soon as
    the words left, shared over the weights left, give no more than its cap.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("weight", w)
    order = Window.orderBy((F.lit(cap) * F.col("source_size") / F.col("weight")), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total, every = F.sum("source_size").over(Window.partitionBy()), F.sum("weight").over(Window.partitionBy())
    left = total - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    share = left / (every - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = ranked.withColumn("share", share).withColumn("capped", F.col("share") * F.col("weight") > cap * F.col("source_size"))
    # the first uncapped source's share holds for all behind it
    open_share = F.min(F.when(~F.col("capped"), F.struct((F.lit(cap) * F.col("source_size") / F.col("weight")).alias("o"), "rank", "share"))).over(
        Window.partitionBy()
    )
    level = level.withColumn("open", open_share["share"]).withColumn(
        "is_capped",
        F.col("open").isNull() | (F.struct((F.lit(cap) * F.col("source_size") / F.col("weight")).alias("o"), F.col("rank")) < F.struct(open_share["o"].alias("o"), open_share["rank"].alias("rank"))),
    )
    target = F.when(F.col("is_capped"), (F.lit(cap) * F.col("source_size")).cast("double")).otherwise(F.col("open") * F.col("weight"))
    return level.select("source", "source_size", "weight", "rank", F.coalesce(target, F.lit(0.0)).cast("double").alias("target"))


def permuted(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 by the swap-or-not shuffle: in each round
    an index and its mirror about a round key are both swapped or both left, as a hash of
    the larger of the two says.  The rounds grow with the logarithm of n."""
    rounds = (F.lit(4) + 2 * F.ceil(F.log2(n.cast("double") + 1))).cast("int")
    start = F.struct(index.cast("long").alias("x"), n.cast("long").alias("n"), key.cast("long").alias("k"))

    def step(a: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(a["k"], r), a["n"]) - a["x"], a["n"])
        swap = F.pmod(F.xxhash64(a["k"], r, F.greatest(a["x"], mirror)), F.lit(2)) == 1
        return F.struct(F.when(swap, mirror).otherwise(a["x"]).alias("x"), a["n"].alias("n"), a["k"].alias("k"))

    return F.aggregate(F.sequence(F.lit(1), rounds), start, step)["x"]


def _summed_before(df: DataFrame, by: str, at: str, value: str, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` (null is one) and a smaller ``at``, a
    number from 0: within groups of FAN numbers, and over the groups' sums."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    grouped = df.withColumn("__group", F.floor(F.col(at) / FAN))
    groups = grouped.groupBy(F.col(by).alias("__by"), F.col("__group").alias("__at")).agg(F.sum(value).alias("__sum"))
    groups = groups.select("__by", "__at", F.coalesce(F.sum("__sum").over(before(Window.partitionBy("__by").orderBy("__at"))), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum(value).over(before(Window.partitionBy(by, "__group").orderBy(at))), F.lit(0))
    joined = grouped.withColumn("__inside", inside).join(groups, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__group") == F.col("__at")))
    return joined.withColumn(out, F.col("__start") + F.col("__inside")).drop("__by", "__at", "__start", "__inside", "__group")


def _packed(docs: DataFrame, key: str, block_words: int, chunk_docs: int) -> tuple[DataFrame, DataFrame]:
    """Documents with ``size`` and ``offset`` (words of their source before them); sizes by source."""
    n = docs.count()
    chunks = max(1, -(-n // chunk_docs))
    sized = docs.withColumn("chunk", F.pmod(F.xxhash64(F.lit(11), key, "size"), F.lit(chunks)))
    sums = sized.groupBy("source", "chunk").agg(F.sum("size").alias("chunk_size"))
    sums = written(_summed_before(sums, "source", "chunk", "chunk_size", "chunk_start"))
    in_chunk = Window.partitionBy("source", "chunk").orderBy(F.xxhash64(F.lit(12), key), key, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("before", F.coalesce(F.sum("size").over(in_chunk), F.lit(0)))
    s = sums.select(F.col("source").alias("s"), F.col("chunk").alias("c"), "chunk_start")
    placed = placed.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    placed = placed.withColumn("offset", F.col("chunk_start") + F.col("before")).drop("s", "c", "chunk", "chunk_start", "before")
    return placed, sums.groupBy("source").agg(F.sum("chunk_size").alias("source_size"))


def _quotas(aims: DataFrame, block_words: int, cap: int) -> DataFrame:
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # a source smaller than a block would be off by its own size: its quota is in turns of its few blocks
    fill = F.col("source_size") / F.greatest(blocks, F.lit(1))
    quota = F.least(F.round(F.col("target") / F.greatest(fill, F.lit(1.0))).cast("long"), blocks * cap)
    return aims.select("source", "source_size", "target", "rank", blocks.alias("blocks"), quota.alias("quota"))


def _line(quotas: DataFrame) -> DataFrame:
    """Quotas laid end to end: each source's start and end on the line of all slots."""
    end = F.sum("quota").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return quotas.withColumn("end", end).withColumn("start", F.col("end") - F.col("quota"))


def _drawn(quotas: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, rank, n): every shard's multinomial draw.  Each of its slots picks a place on the line of
    quotas, and so a source; a place finds its source by the piece of the line that it is in."""
    shards, width = -(-slots // shard_slots), -(-slots // PIECES) or 1
    line = _line(quotas).where("quota > 0")
    pieces = line.select("rank", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("piece"))
    pieces = F.broadcast(pieces) if quotas.count() <= BROADCAST_SOURCES else pieces
    spark = quotas.sparkSession
    shard = spark.range(0, shards, 1, -(-shards // SHARDS_A_TASK) or 1).withColumnRenamed("id", "shard")
    j = shard.select("shard", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), F.lit(slots) - F.col("shard") * shard_slots) - 1)).alias("j"))
    place = j.select("shard", F.pmod(F.xxhash64(F.lit(seed), "shard", "j"), F.lit(slots)).alias("place"))
    named = place.withColumn("piece", F.floor(F.col("place") / width)).join(pieces, "piece").where("place >= start AND place < end")
    return named.groupBy("shard", "rank").agg(F.count(F.lit(1)).alias("n"))


def draws(aims: DataFrame, block_words: int, cap: int, shard_slots: int, seed: int) -> DataFrame:
    """(rank, shard, n): how many of its slots each output shard draws from each source."""
    quotas = written(_quotas(aims, block_words, cap))
    return _drawn(quotas, quotas.agg(F.sum("quota")).first()[0] or 0, shard_slots, seed)


def _slots(quotas: DataFrame, slots: int, shard_slots: int, seed: int) -> DataFrame:
    """(shard, slot, rank, k): every slot of the mix is the k-th of a source, k below its quota."""
    drawn = written(_drawn(quotas, slots, shard_slots, seed))
    counted = _summed_before(drawn, "rank", "shard", "n", "first")
    within = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = drawn.groupBy("rank").agg(F.sum("n").alias("drawn"))
    over = quotas.join(totals, "rank", "left").select("rank", "quota", F.coalesce("drawn", F.lit(0)).cast("long").alias("drawn"))
    line = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    surplus, lack = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    over = written(over.select("rank", "drawn", surplus.alias("surplus"), lack.alias("lack"), F.coalesce(F.sum(surplus).over(line), F.lit(0)).alias("passed"), F.coalesce(F.sum(lack).over(line), F.lit(0)).alias("asked")))
    made = written(counted.withColumn("offset", within).join(over.select("rank", "drawn", "surplus", "passed"), "rank"))
    # an explicit number, so that a few rows that make many slots stay in many tasks
    made = made.repartition(-(-slots // (shard_slots * SHARDS_A_TASK)) or 1, "shard")
    made = made.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("nth", F.col("first") + F.col("i"))
    # of ``drawn`` slots ``surplus`` are handed on, at even distances
    handed = F.expr("(nth * surplus) div drawn")
    made = made.select("shard", (F.col("shard") * shard_slots + F.col("offset") + F.col("i")).alias("slot"), "rank", "nth", handed.alias("handed"), (F.expr("((nth + 1) * surplus) div drawn") > handed).alias("spare"), "passed")
    own = made.where("NOT spare").select("shard", "slot", "rank", (F.col("nth") - F.col("handed")).alias("k"))
    # the spare slots, numbered over all sources, are laid along what the others lack
    width = -(-slots // PIECES) or 1
    lacks = over.where("lack > 0").select(F.col("rank").alias("to"), "asked", "lack", "drawn", F.explode(F.sequence(F.floor(F.col("asked") / width), F.floor((F.col("asked") + F.col("lack") - 1) / width))).alias("piece"))
    spare = made.where("spare").select("shard", "slot", (F.col("passed") + F.col("handed")).alias("e")).withColumn("piece", F.floor(F.col("e") / width))
    given = spare.join(lacks, "piece").where("e >= asked AND e < asked + lack").select("shard", "slot", F.col("to").alias("rank"), (F.col("drawn") + F.col("e") - F.col("asked")).alias("k"))
    return own.unionByName(given)


def block_draws(aims: DataFrame, block_words: int = 64, cap: int = 3, shard_slots: int = 1024, seed: int = 7) -> DataFrame:
    """(source, rank, shard, slot, block): the block behind every slot of the mix."""
    quotas = written(_quotas(aims, block_words, cap))
    n_sources, slots = quotas.agg(F.count(F.lit(1)), F.sum("quota")).first()
    taken = _slots(quotas, slots or 0, shard_slots, seed)
    of = quotas.select("rank", "source", "blocks")
    named = taken.join(F.broadcast(of) if n_sources <= BROADCAST_SOURCES else of, "rank")
    # each turn through a source has a permutation of its own; the last turn takes its first few blocks
    turn = F.floor(F.col("k") / F.col("blocks"))
    block = permuted(F.col("k") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(seed), F.col("rank"), turn))
    return named.select("source", "rank", "shard", "slot", block.alias("block"))


def mix_plan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    block_words: int = 64,
    shard_slots: int = 1024,
    chunk_docs: int = 1024,
    seed: int = 7,
) -> DataFrame:
    """One row per document: (key, source, size, source_size, target, taken, parts), where
    ``parts`` lists (slot, first, words): the document's words that each slot of the mix takes."""
    # texts are read once; what follows works on a few bytes per document, and what several branches
    # read is written: the driver then never holds a plan that has all of them many times over
    sized = written(docs.select(F.col(key), F.col("source"), word_count(F.col(text)).alias("size")))
    placed, sizes = _packed(sized, key, block_words, chunk_docs)
    aims = written(targets(sizes, weights, cap))
    taken = block_draws(aims, block_words, cap, shard_slots, seed).groupBy("rank", "block").agg(F.collect_list("slot").alias("slots"))  # at most cap slots each
    taken = written(taken).hint("merge")  # its estimate doesn't see the rows made from quotas, and it grows with the data
    small = aims.select(F.col("source").alias("s"), "source_size", "target", "rank")
    placed = written(placed.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    spread = placed.where("size > 0").select(
        key,
        "source",
        "size",
        "source_size",
        "target",
        "rank",
        "offset",
        F.explode(F.sequence(F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words))).alias("block"),
    )
    first = F.greatest(F.col("offset"), F.col("block") * block_words)
    words = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_words) - first
    part = F.transform("slots", lambda s: F.struct(s.alias("slot"), (first - F.col("offset")).alias("first"), words.alias("words")))
    joined = spread.join(taken, ["rank", "block"], "left").withColumn("part", F.coalesce(part, F.array().cast("array<struct<slot:bigint,first:bigint,words:bigint>>")))
    # a document is told from another with the same key by its place in its source
    whole = joined.groupBy(key, "source", "size", "source_size", "target", "offset").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("parts"))
    none = placed.where("size = 0").select(key, "source", "size", "source_size", "target", "offset", F.array().cast("array<struct<slot:bigint,first:bigint,words:bigint>>").alias("parts"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return whole.unionByName(none).withColumn("taken", total)


def _among_equals(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """Numbers rows of one repeated ``__h`` from 1 as ``__i``, in groups and over the groups' counts, so that no task has
    all of them; 1 for the others."""
    alone = rows.join(repeated, "__h", "left_anti").withColumn("__i", F.lit(1).cast("long"))
    # written, so that a row has one number in both plans that read it
    many = written(rows.join(repeated, "__h", "left_semi")).withColumn("__row", F.monotonically_increasing_id())
    many = many.withColumn("__part", F.shiftright("__row", 33) * 64 + F.pmod("__row", F.lit(64)))
    sizes = many.groupBy("__h", "__part").agg(F.count(F.lit(1)).alias("__count"))
    before = F.sum("__count").over(Window.partitionBy("__h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__h", "__part", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__h", "__part").orderBy("__row"))
    many = many.withColumn("__nth", inside).join(sizes, ["__h", "__part"]).withColumn("__i", F.col("__before") + F.col("__nth"))
    columns = [*rows.columns, "__i"]
    return alone.select(*columns).unionByName(many.select(*columns))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that the mix takes, with their columns.  A text becomes the words taken,
    in the order of the text, as often as they are taken; what is taken once and whole
    keeps its text as it is.  White space stays with the word before it."""
    columns = docs.columns

    def same(k: Column, source: Column, n: Column) -> Column:
        told = [k.isNull(), F.coalesce(k, F.lit(0)), source.isNull(), F.coalesce(source, F.lit("")), n]
        return F.concat(F.hex(F.xxhash64(*told)), F.hex(F.xxhash64(F.lit(1), *told))).alias("__h")

    # One row per document on either side, found by a hash of what tells documents apart, so that the texts
    # are shuffled once; rows of one hash are interchangeable: the n-th goes with the n-th.
    plan = mix_plan(docs, key, text, **options)
    plan = written(plan.select(same(F.col(key), F.col("source"), F.col("size")), F.struct("taken", F.col("size").alias("n"), "parts").alias("__p")))
    numbered = docs.withColumn("__h", same(F.col(key), F.col("source"), word_count(F.col(text))))
    repeated = written(plan.groupBy("__h").count().where("count > 1").select("__h"))
    on = ["__h"]
    if not repeated.isEmpty():
        on, plan, numbered = ["__h", "__i"], _among_equals(plan, repeated), _among_equals(numbered, repeated)
    joined = numbered.join(plan.where("__p.taken > 0"), on)
    # the last word too ends in white space, so that parts don't run together
    words = F.regexp_extract_all(F.concat(F.col(text), F.lit(" ")), F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]+)"))
    in_order = F.array_sort(F.transform("__p.parts", lambda p: F.struct(p["first"].alias("first"), p["slot"].alias("slot"), p["words"].alias("words"))))

    def cut(w: Column) -> Column:
        return F.array_join(F.transform(in_order, lambda p: F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p["words"].cast("int")), "")), "")

    # words are taken apart once per text: inside a lambda a column is computed for each element
    taken = F.regexp_replace(F.element_at(F.transform(F.array(words), cut), 1), r" \z", "")
    distinct_parts = F.size(F.array_distinct(F.transform("__p.parts", lambda p: p["first"])))
    once = (F.col("__p.taken") == F.col("__p.n")) & (distinct_parts == F.size("__p.parts"))
    out = joined.withColumn(text, F.when(once, F.col(text)).otherwise(taken))
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns)


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken")
