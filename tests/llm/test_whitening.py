import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def fit_list(rows):
    fine = [(k, tuple(math.floor(256 * np.float32(c).item()) for c in v)) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    return fine, sorted({x for _, x in fine})


def exact_covariance(xs):
    n, dims = len(xs), len(xs[0])
    sums = [sum(x[d] for x in xs) for d in range(dims)]
    return n, sums, [[Fraction(n * sum(x[i] * x[j] for x in xs) - sums[i] * sums[j], n * n) for j in range(dims)] for i in range(dims)]


def check(rows, got, components=4):
    fine, xs = fit_list(rows)
    n, sums, v = exact_covariance(xs)
    dims = len(sums)
    w, u = np.linalg.eigh(np.array([[float(c) for c in r] for r in v]))
    w, u = w[::-1], u[:, ::-1]
    k = min(components, dims)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(got) == len(by) == k * len(fine)
    for c in range(k):
        signs = set()
        for key, x in fine:
            r = by[key, c + 1]
            assert r.n == n and r.deviation == sum((n * x[d] - sums[d]) ** 2 for d in range(dims))
            want = sum((x[d] - sums[d] / n) * u[d, c] for d in range(dims)) / math.sqrt(w[c])
            assert abs(abs(r.whitened) - abs(want)) < 1e-7
            if abs(want) > 1e-3:
                signs.add(r.whitened * want > 0)
            assert r.explained == pytest.approx(w[c] / float(sum(v[d][d] for d in range(dims))), rel=1e-6) and r.identity_error < 1e-8
        assert len(signs) == 1


def test_against_plain_covariance(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(d / 7, 1 + d) for d in range(9)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(2000, None), (2001, [1.0] * 8 + [None]), (2002, [1.0] * 8 + [math.nan]), (2003, [math.inf] * 9), (2004, []), (2005, [-0.0] * 9)]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA).repartition(6)
    made = whitening.whiten(df.withColumn("component", F.lit("x")).withColumn("key", F.lit(1)))
    assert made.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check([r for r in rows if r[1] != []], made.collect())
    assert whitening.whiten(df.limit(0)).isEmpty()


@pytest.mark.parametrize(("low", "high", "n", "dims"), [(-300, 300, 1, 3), (-300, 300, 64, 5), (5, 6, 130, 4), (-(1 << 62), 1 << 62, 70, 3), (-(1 << 63), (1 << 63) - 1, 65, 2), (0, 1 << 40, 40_000, 2)])
def test_bit_planes_give_exact_sums(low, high, n, dims):
    rng = np.random.default_rng(n)
    x = rng.integers(low, high, (n, dims), endpoint=True)
    x[:, 0] = low  # a dimension without planes
    sums, cross = whitening.scatter(x)
    rows = [[int(v) for v in r] for r in x]
    assert list(sums) == [sum(r[d] for r in rows) for d in range(dims)]
    for i in range(dims):
        for j in range(i, dims):
            assert cross[i, j] == sum(r[i] * r[j] for r in rows)


def test_few_vectors_other_lengths_and_large_counts(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0]), (3, [0.5, 0.25]), (4, [0.75, 0.25]), (None, [0.75, 0.25])]
    got = whitening.whiten(spark.createDataFrame([(k, v, 1) for k, v in rows], SCHEMA)).collect()
    # one distinct vector has no component with variance, two have one
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, round(abs(r.whitened), 9), r.explained) for r in got) == [(0, 1, 2, 64 * 64, 1.0, 1.0), (3, 1, 2, 64 * 64, 1.0, 1.0), (4, 1, 2, 64 * 64, 1.0, 1.0)]
    f = whitening.Whitening(10**9, [3 * 10**10, -(10**11)], np.ones(1), np.ones((2, 1)), 1.0)
    x = np.array([[1 << 40, -5], [0, 0]])
    assert f.deviations(x) == [sum((f.n * int(v) - s) ** 2 for v, s in zip(r, f.sums, strict=True)) for r in x]


def test_given_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    check([(r.vec_id, r.embedding) for r in df.limit(150).collect()], whitening.whiten(df.limit(150)).collect())
