"""A Merkle manifest of a data set: what proves that a row is in it, unchanged.

Every row is a leaf; the leaves of a group (a source) in order of their key form a tree of
runs of FAN nodes, and the groups' roots form another.  Leaves are numbered in their group
and a number's base-FAN digits are columns: the rows of a block, bounded at FAN ** DIGITS
leaves, are grouped by all digits but the last, then by all but the last two, each time
nesting the structs of the level below, so that a block ends as one row that holds its part of
the tree.  Blocks are the nodes of the next round, until one node of each group is left.
Proofs are emitted downwards: a block's row is exploded again, and what each child's run
looks like is cut from the nested structs, without joining any leaf with another.  Only a
block's own proof comes to it by a join, of one row a block with one row a block.

Numbers come from a range partitioning by (group, key, leaf): the rows of each partition
count on from those of the partitions before, so no task sorts a whole group.

Defined results: every null field is ``-``, also in the key and the group; a null group is one
of its own and comes first; null keys come first in their group; rows with one key are ordered
by their leaf, and equal rows are leaves of their own; an empty table has no leaves and gives
no rows; further columns are ignored, whatever their names.  Texts of any length are hashed
whole where they are read, and only digests are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Nodes of a run; digits of a leaf's number that one block has.
FAN, DIGITS = 16, 2
BLOCK = FAN**DIGITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_of(columns: tuple[str, ...], **changed: Column) -> Column:
    return digest(*(field(changed.get(c, F.col(c))) for c in columns))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    joined = lambda nodes: F.array_join(nodes, "")
    return F.aggregate(proof, leaf, lambda node, run: digest(joined(run["before"]), node, joined(run["after"])))


def siblings(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.flatten(F.transform(proof, lambda run: F.concat(run["before"], run["after"])))


def _depth(n: Column) -> Column:
    """Levels above n leaves."""
    levels = F.lit(15)
    for level in reversed(range(15)):
        levels = F.when(n <= FAN**level, level).otherwise(levels)
    return levels


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rank`` from 0 among the rows of a ``grp``, and ``of``, how many there are."""
    tied = rows.withColumn("__nth", F.monotonically_increasing_id())  # equal rows must not meet in one partition
    placed = tied.repartitionByRange("grp", *order, "__nth").sortWithinPartitions("grp", *order, "__nth").drop("__nth")
    # the partition's number and the row's place in it, kept as they were written
    placed = written(placed.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    stretch = placed.groupBy("grp", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    group = Window.partitionBy("grp")
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    stretch = stretch.select("grp", "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("of"))
    counted = placed.join(stretch, ["grp", "__part"])
    return counted.withColumn("rank", F.col("__before") + F.col("__at") - F.col("__first")).drop("__at", "__part", "__first", "__before")


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of (grp, of, rank, node, item): (grp, of, rank of the block, node, kids)."""
    digit = lambda k: F.expr(f"rank div {FAN**k} % {FAN}").cast("int")
    block = F.expr(f"rank div {BLOCK}")
    level = nodes.select("grp", "of", block.alias("block"), *(digit(k).alias(f"d{k}") for k in range(DIGITS)), F.struct("node", "item").alias("own"))
    level = level.repartition("grp", "block")  # all digits of a block are grouped away where it is
    for k in range(DIGITS):
        left = [f"d{j}" for j in range(k + 1, DIGITS)]
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{k}").alias("at"), "own.*")))
        level = level.groupBy("grp", "of", "block", *left).agg(kids.alias("kids"))
        node = F.when(_depth(F.col("of")) > k, digest(F.array_join("kids.node", ""))).otherwise(F.element_at("kids.node", 1))
        level = level.select("grp", "of", "block", *left, F.struct(node.alias("node"), "kids").alias("own"))
    return level.select("grp", "of", F.col("block").alias("rank"), "own.node", "own.kids")


def _climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(grp, node) of each group's root, and the blocks of every round, leaves first."""
    rounds, tops = [], []
    while True:
        blocks = written(_blocks(nodes))
        rounds.append(blocks)
        above = blocks.select("grp", F.expr(f"(of + {BLOCK - 1}) div {BLOCK}").alias("of"), "rank", "node", F.lit(0).alias("item"))
        tops.append(above.where("of = 1").select("grp", "node"))
        nodes = above.where("of > 1")
        if nodes.isEmpty():
            break
    for more in tops[1:]:
        tops[0] = tops[0].unionByName(more)
    return tops[0], rounds


def _proved(tops: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(grp, item, node, proof, carried) of every leaf, from (grp, proof, carried) of the groups' roots."""
    paths, given = None, tops.select("grp", F.lit(0).cast("long").alias("rank"), "proof", "carried")
    for blocks in reversed(rounds):
        one = given.join(blocks.where(f"of <= {BLOCK}").select("grp"), "grp", "left_semi") if len(rounds) > 1 else given
        paths = one if paths is None else paths.select("grp", "rank", "proof", "carried").unionByName(one)
        level = blocks.drop("node").join(paths, ["grp", "rank"]).select("grp", "rank", "proof", "carried", _depth(F.col("of")).alias("depth"), F.struct("kids").alias("own"))
        for k in reversed(range(DIGITS)):
            run = F.col("run")
            step = F.struct(F.slice(run, F.lit(1), F.col("i")).alias("before"), F.slice(run, F.col("i") + 2, F.lit(FAN)).alias("after"))
            level = level.select("grp", "rank", "proof", "carried", "depth", F.col("own.kids.node").alias("run"), F.posexplode("own.kids").alias("i", "own"))
            proof = F.when(F.col("depth") > k, F.concat(F.array(step), "proof")).otherwise(F.col("proof"))
            level = level.select("grp", (F.col("rank") * FAN + F.col("own.at")).alias("rank"), proof.alias("proof"), "carried", "depth", "own")
        paths = level.select("grp", "rank", "proof", "carried", "own.node", "own.item")
    return paths


def manifest(leaves: DataFrame, group: str, key: str, leaf: str, *kept: str) -> DataFrame:
    """(group, key, leaf, kept columns, subroot, root, proof) of every row.  ``proof`` lists the runs on the way
    from the leaf by the group's root to the root: (before, after), the digests beside the own node."""
    none = F.array().cast("array<struct<before:array<string>,after:array<string>>>")
    # a null group sorts before the empty one
    rows = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("grp"), F.col(key).alias("key"), F.col(leaf).alias("node"), F.struct(F.col(key).alias("key"), *kept).alias("item"))
    subroots, rounds = _climbed(_numbered(rows, "key", "node").drop("key"))
    sources = subroots.select(F.lit("").alias("grp"), F.struct("grp").alias("item"), "node")
    roots, above = _climbed(_numbered(sources.withColumn("by", F.col("item.grp")), "by").drop("by"))
    proved = _proved(roots.select("grp", none.alias("proof"), F.struct(F.col("node").alias("root")).alias("carried")), above)
    tops = written(proved.select("item.grp", "proof", F.struct(F.col("node").alias("subroot"), "carried.root").alias("carried")))
    out = _proved(tops, rounds)
    name = F.when(F.col("grp") != "", F.substring("grp", 2, 1 << 30))
    return out.select(name.alias(group), F.col("item.key").alias(key), F.col("node").alias(leaf), *(F.col(f"item.{c}").alias(c) for c in kept), "carried.subroot", "carried.root", "proof")


def tamper_check(docs: DataFrame, columns: tuple[str, ...] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """The manifest's digests of every document, and whether each is verified after some are tampered with: where
    5 divides the CRC-32 of the decimal key, A-Z of the text are lower-cased."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    touched = F.when(F.crc32(F.col(key).cast("string")) % 5 == 0, leaf_of(columns, **{text: lower}))
    # texts are read and hashed once; from here on there are digests only
    leaves = written(docs.select(key, group, leaf_of(columns).alias("leaf"), touched.alias("touched")))
    proved = manifest(leaves, group, key, "leaf", "touched")
    folded = fold(F.coalesce("touched", "leaf"), F.col("proof"))
    found = proved.select(key, "leaf", "subroot", "root", digest(F.array_join(siblings(F.col("proof")), "")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
