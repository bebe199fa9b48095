import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quizloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    shown = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(shown, (row[0], row[3], row[2], row[4], text)))


def climb(nodes, at):
    """(siblings as (before, after) of node ``at`` level by level, the last node)"""
    runs = []
    while len(nodes) > 1:
        first = at - at % 16
        run = nodes[first : first + 16]
        runs.append((run[: at - first], run[at - first + 1 :]))
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        at //= 16
    return runs, nodes[0]


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in groups[s]], 0)[1] for s in names]
    out = []
    for k, s in enumerate(names):
        above, root = climb(subroots, k)
        for i, (_, _, own, r) in enumerate(groups[s]):
            runs = climb([x[2] for x in groups[s]], i)[0] + above
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for before, after in runs:
                folded = h(*before, folded, *after)
            out.append((r[0], own, subroots[k], root, h(*(x for b, a in runs for x in b + a)), folded, folded == root))
    return sorted(out, key=str)


def got(docs):
    return sorted((tuple(r) for r in merkle.tamper_check(docs).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16, "b": 17}, {"one": 700, None: 257, "": 2, "é": 256, "z": 1}, {f"s{i:04}": 1 for i in range(300)}])
def test_against_plain_trees(spark, sizes):
    rng = random.Random(3)
    rows = []
    for s, n in sizes.items():
        rows += [(len(rows) + i, rng.choice(["Text ß", "lower", "", None, "ABC " * 50]), rng.choice(["en", None]), s, rng.choice([3, None])) for i in range(n)]
    rng.shuffle(rows)
    found = got(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert found == brute(rows)


def test_three_rounds_of_blocks(spark):
    """More leaves than two rounds of blocks have: 65,536 and some, in one source."""
    n = 256 * 256 + 300
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("T"), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    level = [leaf((i, None, "en", "s", 1), f"T{i}") for i in range(n)]
    root = climb(level, 0)[1]
    found = {r.doc_id: r for r in merkle.tamper_check(docs).where("doc_id % 1001 = 0 or doc_id > 65700").collect()}
    assert {r.root for r in found.values()} == {root}
    for i, r in found.items():
        assert r.verified == (zlib.crc32(str(i).encode()) % 5 != 0)
        assert r.proof_sha256 == h(*(x for b, a in climb(level, i)[0] for x in b + a))


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(None, "Ab", "en", "s", 2)] * 40 + [(None, None, None, None, None)] * 3 + [(10, "Same", "en", "s", 4)] * 60 + [(5, "X" * 200_000, None, "t", 1), (5, "other", None, "t", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert got(docs) == brute(rows)
    clashing = docs.withColumns({"leaf": F.lit(1), "root": F.lit("r"), "grp": F.lit(0), "proof": F.lit(2), "rank": F.lit(9)})
    assert got(clashing) == brute(rows)
    assert merkle.tamper_check(docs.limit(0)).isEmpty()


def test_a_manifest_proves_its_rows(spark):
    rows = spark.range(40).select("id", F.md5(F.col("id").cast("string")).alias("leaf"), F.lit("g").alias("g"))
    made = merkle.manifest(rows, "g", "id", "leaf")
    assert made.columns == ["g", "id", "leaf", "subroot", "root", "proof"]
    assert made.where(merkle.fold(F.col("leaf"), F.col("proof")) != F.col("root")).isEmpty()
    assert made.where(merkle.fold(F.lit("0"), F.col("proof")) == F.col("root")).isEmpty()
