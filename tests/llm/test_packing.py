import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizloom.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


def one_by_one(items, capacity, rule, weights):
    """[(length, sequence, offset)]: every piece by itself, longest first, into the best of all open sequences."""
    limits, open_, out = capacity.limits(), [], []
    for n in sorted(items, reverse=True):
        demand, best = (n, 1, n * n), None
        for s, left in enumerate(open_):
            if all(r >= d for r, d in zip(left, demand, strict=True)):
                shares = [(r / c, d / c, w) for r, d, c, w in zip(left, demand, limits, weights, strict=True)]
                score = sum(w * (r - d) ** 2 for r, d, w in shares) if rule == "norm" else -sum(w * r * d for r, d, w in shares)
                if best is None or score < best[0] - 1e-15:
                    best = score, s
        if best is None:
            open_.append(list(limits))
            best = 0, len(open_) - 1
        left = open_[best[1]]
        out.append((n, best[1], limits[0] - left[0]))
        left[:] = (r - d for r, d in zip(left, demand, strict=True))
    return sorted(out), len(open_)


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [packing.Capacity(40), packing.Capacity(40, 3), packing.Capacity(64, 5, 900), packing.Capacity(10, 1)])
@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_one_by_one(rule, capacity, seed):
    rng = random.Random(seed)
    top = capacity.longest()
    items = [min(top, rng.choice([rng.randint(1, top), rng.randint(1, 6), 7])) for _ in range(rng.choice([1, 30, 250]))]
    weights = rng.choice([(1, 1, 1), (1, 0, 0), (1, 2, 0.5)])
    runs, n = packing.plan(Counter(items), capacity, rule, weights)
    made = []
    for length, count in Counter(items).items():
        s, o = packing.places(runs, np.full(count, length), np.arange(count))
        made += [(length, int(a), int(b)) for a, b in zip(s, o, strict=True)]
    want, many = one_by_one(items, capacity, rule, weights)
    assert n == many and sorted(made) == want


def test_plan_of_billions_of_pieces():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 10**8) for n in range(1, 2049)}
    runs, n = packing.plan(counts, packing.Capacity())
    least = sum(k * c for k, c in counts.items()) / 2048
    assert len(runs) < 40_000 and least <= n < 1.01 * least
    with pytest.raises(ValueError, match="rule"):
        packing.plan({}, packing.Capacity(), "first")
    assert packing.plan({}, packing.Capacity())[1] == 0


def rows():
    rng = random.Random(2)
    words = "alpha beta gam'ma 12 δέλτα  \n\n<|endoftext|> 漢字 the".split(" ")
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(150)]
    texts += ["copy of one text"] * 80 + [None, "", "x y " * 9_000, "é" * 3_000]
    return [(None if i % 37 == 0 else i % 200, t, i) for i, t in enumerate(texts)]


def check(got, rows, capacity):
    library = Tokenizer.from_file(FILE)
    want, by_place = Counter(), defaultdict(list)
    size = capacity.longest()
    for k, t, *_ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % size or size
        for no, (a, b) in enumerate(zip([0, *range(first, len(ids), size)], [first, *range(first + size, len(ids) + 1, size)], strict=True) if len(ids) > size else [(0, len(ids))]):
            want[k, no, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    assert Counter((r[0], r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for r in got:
        by_place[r.sequence_id].append((r.offset, r.length))
    limits = capacity.limits()
    for at in by_place.values():
        at.sort()
        assert [o for o, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))]
        assert sum(n for _, n in at) <= limits[0] and len(at) <= limits[1] and sum(n * n for _, n in at) <= limits[2]
    assert sorted(by_place) == list(range(len(by_place)))
    return len(by_place)


@pytest.mark.parametrize("capacity", [packing.Capacity(), packing.Capacity(512, 8, 200_000)])
def test_against_the_library(spark, capacity):
    data = rows()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t, _ in data], "doc_id long, text string, length int, offset string").repartition(5)
    got = packing.pack(docs, capacity=capacity).collect()
    n = check(got, data, capacity)
    assert n == packing.plan(Counter(r.length for r in got), capacity)[1]
    assert packing.pack(docs.limit(0)).isEmpty()


def test_sequences_hold_the_ids(spark):
    data = rows()[:120]
    docs = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(data)], "doc_id long, text string")
    packed = packing.pack(docs, with_ids=True, capacity=packing.Capacity(256))
    whole = packing.sequences(packed)
    assert whole.where("size(ids) > 256 or size(ids) <> aggregate(lengths, 0L, (a, b) -> a + b)").isEmpty()
    pieces = packed.join(whole.withColumnRenamed("ids", "all"), "sequence_id")
    assert pieces.where(F.slice("all", (F.col("offset") + 1).cast("int"), F.col("length").cast("int")) != F.col("ids")).isEmpty()


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = packing.pack(docs).collect()
    n = check(got, [(r.doc_id, r.text) for r in docs.collect()], packing.Capacity())
    assert n <= -(-sum(r.length for r in got) // 2048) + 1
