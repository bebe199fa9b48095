import random
from collections import Counter

import numpy as np
import pytest

from quizloom.llm import components, neardup

from .brute import components as brute
from .brute import shingles


def groups(seed):
    """Groups of edited copies around an original, chains of edits, copies, and loners."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    out = []
    for size, n, edits in ((12, 200, 4), (30, 120, 5), (6, 30, 1), (40, 90, 3)):
        base = [word() for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(size):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(n)] = word()
            out.append(" ".join(w))
            if size == 6:
                base = w  # a chain
    out += [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(60)]
    out += rng.sample(out, 20) + [t.upper() for t in rng.sample(out, 5)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_against_all_pairs(spark, width):
    rows = list(enumerate(groups(width)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=width).collect()}
    assert got == brute(rows, width)


def test_pairs_inside_a_family_below_the_threshold(spark):
    """Pages of one template share 78% with each other; only few pairs inside the family share more."""
    for n_shared, extra in ((175, 0), (150, 25)):
        rows = []
        for i in range(240):
            own = [f"p{i // 4}y{i % 2}x{j}" for j in range(8)] if i >= 220 else [f"q{i}x{j}" for j in range(8)]
            half = [f"h{i % 2}x{j}" for j in range(extra)]  # two halves of a family, with more in common
            rows.append((i, " ".join([f"t{j}" for j in range(n_shared)] + half + own + [f"o{i}x{j}" for j in range(18 if not extra else 19 + i % 3)])))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
        want = brute(rows, 1)
        assert got == want
        assert 1 < len({c for _, c in got.values()}) < 240


def families(n):
    """Families of 40 edited copies that are hardly alike enough, and two members with fewer edits of their own."""
    out = []
    for f in range(n):
        rng = random.Random(f)
        base = [f"f{f}w{i}" for i in range(140)]
        for i in rng.sample(range(140), 6):
            base[i] = f"f{f}shared{i}"
        for member in range(42):
            w = list(base)
            for i in rng.sample(range(140), 4 if member >= 40 else 5):
                w[i] = f"f{f}m{member}x{i}"
            out.append(" ".join(w))
    return out


def test_links_behind_hubs(spark):
    """Members that the centre of a family isn't linked with are linked with each other in some families."""
    rows = list(enumerate(families(200)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), width=2).collect()}
    want = brute(rows, 2)
    assert got == want
    sizes = Counter(Counter(c for k, (_, c) in want.items()).values())
    assert sizes[1] > 2000 and sizes[2] > 20  # most are linked with none, some pairs are


def test_a_document_of_several_texts(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(50)) for c in "ab")
    rows = [(1, one), (2, two + " x"), (3, one), (3, two), (4, "c d e")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_edges(spark):
    long = " ".join(f"w{i * i % 99991}" for i in range(40_000))
    rows = [(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "One", "d"), (5, "one", "e"), (None, "one", "f"), (None, None, "g"), (7, long, "h"), (8, long + " x", "i"), (9, long, "j"), (9, long, "j")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(map(str, (tuple(r) for r in neardup.near_duplicates(df, width=2).collect())))
    n, m = len(shingles(long, 2)), len(shingles(long + " x", 2))
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (None, 0, None, True)]
    want += [(7, n, 7, True), (8, m, 7, False), (9, n, 7, False), (9, n, 7, False)]
    assert got == sorted(map(str, want))
    assert neardup.near_duplicates(df.limit(0)).isEmpty()
    left = sorted((r.doc_id is None, r.doc_id or 0) for r in neardup.one_of_each(df, width=2).collect())
    assert left == [(False, i) for i in (1, 2, 3, 4, 7)] + [(True, 0), (True, 0)]


def test_repeated_rows_of_one_document(spark):
    df = spark.createDataFrame([(1, "a b c", "x"), (1, "a b c", "x"), (2, "d e", "y")], "doc_id long, text string, k string")
    assert sorted(map(tuple, neardup.one_of_each(df).collect())) == [(1, "a b c", "x"), (2, "d e", "y")]


def test_densified_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for n in (5, 40, 2000):
        hits = []
        for _ in range(60):
            u = np.unique(rng.integers(0, 1 << 63, n + n // 4 + 1, "u8"))
            a, b = u[: n + n // 8], u[n // 8 :]
            hits.append((neardup.signature(a) == neardup.signature(b)).mean() - len(np.intersect1d(a, b)) / len(u))
        assert abs(np.mean(hits)) < 0.06


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


def test_work_is_linear_in_repeated_rows(spark, monkeypatch):
    """Two linked documents and one that isn't, n rows each: tables on the way grow by the sketches of rows alone."""
    base = [f"w{i}" for i in range(60)]
    texts = {1: " ".join(base), 2: " ".join([*base[:-2], "x", "y"]), 3: " ".join(f"v{i}" for i in range(50))}
    inner, sums = neardup.written, []
    for n in (20, 160):
        made = []

        def counting(df, made=made):
            table = inner(df)
            made.append(table.count())
            return table

        monkeypatch.setattr(neardup, "written", counting)
        df = spark.createDataFrame([(k, t) for k, t in texts.items() for _ in range(n)], "doc_id long, text string").repartition(3)
        got = neardup.near_duplicates(df).collect()
        assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1)] * n + [(2, 1)] * n + [(3, 3)] * n
        assert made[0] == 3 * n
        sums.append(sum(made[1:]))
    monkeypatch.setattr(neardup, "written", inner)
    assert sorted(r.doc_id for r in neardup.one_of_each(df).collect()) == [1, 3]
    assert sums[0] == sums[1]


def family(n):
    """Forms of 70 words with 10 fields of 12 possible values each: alike, but no two enough."""
    rng = random.Random(n)
    out = set()
    while len(out) < n:
        w = [f"f{i}" for i in range(70)]
        for k in range(10):
            w[7 * k + 3] = f"v{k}x{rng.randrange(12)}"
        out.add(" ".join(w))
    return sorted(out)


def test_a_family_without_links_has_few_candidates(spark, monkeypatch):
    """Its members are met by their rare shingles, but few pairs are compared by their sets."""
    inner, compared = neardup._left_open, []

    def counting(*args):
        pairs = neardup.written(inner(*args))
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_left_open", counting)
    rows = list(enumerate(family(500)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()}
    want = brute(rows, 2)
    assert got == want and len({c for _, c in want.values()}) > 450
    assert not compared or compared[-1] <= 1000
