from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quizloom.llm import mixing, quality, sharding

from .brute import WORD, quality_kept, stats, targets


def words(n, seed=0):
    return " ".join(f"w{(i * 7 + seed) % 97}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, words(50 + i % 90, i), f"s{i % 5}" if i % 3 else "hot", "en", 1) for i in range(400)]
    rows += [(1000, None, "s1", "en", 0), (1001, "", None, None, 0), (1002, words(3), None, "de", 0), (1003, words(20_000), "s2", "en", 0), (None, words(70), "tiny", "en", 0), (5, words(55, 5), "s0", "en", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, size int").repartition(5)


def test_mixture(spark, docs):
    got = mixing.mixture(docs).collect()
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    aims = targets(sizes)
    by_size = {(r.doc_id, len(WORD.findall(r.text or ""))): r.source for r in rows}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = by_size[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and r.target == pytest.approx(aims[s]) and 0 <= r.taken <= 3 * r["size"]
        taken[s] += r.taken
    for s, n in taken.items():
        assert abs(n - aims[s]) <= 2 * 64
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(2)).collect()))
    assert mixing.mixture(docs.limit(0)).isEmpty()


def test_many_equal_rows_are_joined_by_number(spark, monkeypatch):
    """200 rows of one null key, source and size, half of them equal: each gets a plan of its own, and no row lists them."""
    rows = [(None, words(70, 0 if i % 2 else i), "hot") for i in range(200)] + [(i, words(40, i), "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    kept, inner = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda d: kept.append(inner(d)) or kept[-1])
    got = mixing.mix_documents(df).collect()
    taken = sorted(r.taken for r in mixing.mixture(df).collect() if r.taken)
    assert sorted(len(WORD.findall(r.text)) for r in got) == taken
    plans = next(t for t in kept if "__p" in t.columns)
    assert plans.count() == 230 and not any("array<struct<o0" in str(t.schema) for t in kept)


def test_no_plan_of_the_mix_holds_its_steps_many_times(spark, docs, monkeypatch):
    """What several branches read is written, so the driver plans a few windows and shuffles at a time."""
    seen, inner = [], mixing.written
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(mixing, "written", lambda d: seen.append(plan(d)) or inner(d))
    seen.append(plan(mixing.mixture(docs)))
    assert max(p.count("Window [") for p in seen) <= 8 and max(p.count("Join ") for p in seen) <= 3


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 400, "é": 1, "z": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(9)).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 64 or got != list(range(n)))


def test_draws_meet_quotas(spark):
    aims = mixing.targets(spark.createDataFrame([("a", 90_000), ("b", 60_000), ("c", 9_000)], "source string, source_size long"))
    got = mixing.draws(aims, 64, 3, 128, 7).collect()
    per_shard = Counter()
    for r in got:
        per_shard[r.shard] += r.n
    assert set(list(per_shard.values())[:-1]) <= {128, min(per_shard.values())}
    first = sorted(r.n for r in got if r["rank"] == 1)
    assert first[0] < first[-1]  # drawn, not apportioned


def test_mixed_documents(spark, docs):
    taken = [r.taken for r in mixing.mixture(docs).collect()]
    got = mixing.mix_documents(docs)
    assert got.columns == docs.columns
    n = Counter(len(WORD.findall(r.text)) for r in got.collect())
    assert n == Counter(t for t in taken if t)


def test_sharding(spark):
    shards = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(shards, 1009)
    load = Counter(table)
    assert max(load.values()) - min(load.values()) <= 1
    fewer = sharding.fill_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.25 * 1009
    df = spark.createDataFrame([(1, "x"), (1, "y"), (None, "z"), (2, None)], "doc_id long, text string")
    got = sharding.place(df, "doc_id", shards, 1009).collect()
    assert len(got) == 4 and all(table[r.slot] == r.shard for r in got)
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    assert sharding.shard_documents(df.limit(0)).isEmpty()
    for bad in (([], 7), (["a"], 8), (["a", "a"], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)
    with pytest.raises(ValueError):
        sharding.place(df.withColumn("Slot", F.lit(1)), "doc_id", shards)


def turns(shards, slots):
    """Each shard's own order of all slots, and turns by the book."""
    import hashlib

    orders = []
    for name in shards:
        h = hashlib.sha256(name.encode()).digest()
        a, b = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        orders.append([(a + i * b) % slots for i in range(slots)])
    owner = {}
    while len(owner) < slots:
        for i, o in enumerate(orders):
            if len(owner) < slots:
                owner[next(s for s in o if s not in owner)] = i
    return [owner[s] for s in range(slots)]


def test_table_is_filled_by_turns():
    assert sharding.fill_table(["a", "b", "c"], 101) == turns(["a", "b", "c"], 101)


@pytest.fixture(scope="module")
def judged(spark):
    good = lambda i: words(80 + i % 40, i) + "\n" + f"unique{i} " * 2
    junk = lambda i: " ".join(f"w{k * 17 % 997}{'#' * 3}" for k in range(80 + i % 30))
    rows = [(i, good(i), "en") for i in range(600)] + [(1000 + i, junk(i), "en") for i in range(100)]
    rows += [(2000, None, "en"), (2001, "", None), (None, good(1), "en"), (2002, "ha ha " * 200, "en"), (2003, junk(3), "xx"), (2, good(2), "en"), (2004, "same line here ok\n" * 40, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = [(i, 1, 0) for i in range(500)] + [(1000 + i, 0, 0) for i in range(80)] + [(None, 0, 0), (3, None, 0), (2002, 0, 0), (9999, 1, 0), (4, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, text int")


def test_verdicts(spark, judged):
    docs, labels = judged
    rows = docs.collect()
    got = quality.quality_verdicts(docs, labels).collect()
    assert sorted(str((r.doc_id, *stats(r.text))) for r in rows) == sorted(str(tuple(r)[:6]) for r in got)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[i] for i in range(600)) and not any(kept[1000 + i] for i in range(100))
    assert not kept[2000] and not kept[2002] and kept[2003]  # no labels in its stratum: nothing is known
    assert quality.quality_verdicts(docs.limit(0), labels).isEmpty()
    none = quality.quality_verdicts(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_bound_is_the_exact_one():
    for bad, n, error in ((0, 50, 0.01), (3, 200, 0.001), (40, 900, 0.02)):
        p = quality.upper_bound(bad, n, error)
        tail = sum(__import__("math").comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1))
        assert tail == pytest.approx(error, rel=1e-6)
    assert quality.upper_bound(0, 0, 0.1) == quality.upper_bound(5, 5, 0.1) == 1.0


def test_clashing_columns(spark, judged):
    docs, labels = judged
    more = docs.withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(7))
    out = quality.keep_good(more, labels)
    assert out.columns == more.columns and out.where("n_words <> 'mine' OR kept <> 7").isEmpty()
    assert out.count() == quality.quality_verdicts(docs, labels).where("kept").count()


def test_verdicts_against_all_choices_of_cutoffs(spark, judged):
    docs, labels = judged
    junk = lambda i: " ".join(f"w{k * 17 % 997}{'#' * (1 + i % 3)}" for k in range(80 + i % 30)) + "\nsame line" * (i % 4)
    names = ["*", "(null)", None, "nan", "small", *(f"s{j}" for j in range(65))]
    rows = [(10_000 * (1 + j) + i, words(60 + i % 50, i), name) for j, name in enumerate(names[:4]) for i in range(330)]
    rows += [(10_000 * (1 + j) + 5000 + i, junk(i), name) for j, name in enumerate(names) for i in range(12)]
    more = labels.unionByName(spark.createDataFrame([(r[0], int(r[0] % 10_000 < 5000), 0) for r in rows], "doc_id long, quality int, text int"))
    every = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {}
    for r in quality.judge(every, more, carry=["text"]).collect():
        got.setdefault((r.doc_id, r.text, r.lang), set()).add(r.kept)
    table = [(r.doc_id, r.text, r.lang) for r in every.collect()]
    want = quality_kept(table, [(r.doc_id, r.quality) for r in more.collect()], list(quality.CUTOFFS))
    assert got == {row: {kept} for row, kept in zip(table, want, strict=True)}
    bad_kept = {n: sum(any(got[r]) for r in rows if r[2] == n and r[0] % 10_000 >= 5000) for n in names}
    assert all(bad_kept[n] == 0 for n in names[:4]) and all(bad_kept[n] == 12 for n in names[4:])  # others' labels decide nothing


def test_false_rejection_of_the_union_is_bounded():
    """Three rules that reject different good documents: of all holdouts at most delta give more than the limit."""
    rng = np.random.default_rng(4)
    n_levels, limit, delta, over, used = len(quality.CUTOFFS) + 1, 0.05, 0.05, 0, 0
    for _ in range(300):
        p = np.full((3, n_levels), 0.0)
        p[:, 0] = 1 - rng.uniform(0.001, 0.06, 3)
        p[:, 1:] = ((1 - p[:, 0]) / (n_levels - 1))[:, None]
        draw = lambda n, q: np.stack([rng.choice(n_levels, n, p=x) for x in q])
        good, bad = (np.zeros((n_levels,) * 3, "i8") for _ in range(2))
        np.add.at(good, tuple(draw(600, p)), 1)
        np.add.at(bad, tuple(draw(4000, p * 0.2 + 0.8 / n_levels)), 1)
        best = quality.best_cutoffs(good, bad, delta / n_levels**3, limit)
        if best is not None:
            used += 1
            kept = np.prod([p[r, : i + 1].sum() for r, i in enumerate(best)])
            over += 1 - kept > limit
    assert used > 100 and over <= delta * 300


def test_most_allowed_is_the_last_within_the_limit():
    for n, error in ((300, 1e-5), (2000, 1e-4), (5, 0.1), (0, 0.1)):
        k = quality.most_allowed(n, error, 0.05)
        assert k == -1 or quality.upper_bound(k, n, error) <= 0.05
        assert quality.upper_bound(k + 1, n, error) > 0.05


def test_slots_number_every_source_once(spark, monkeypatch):
    """Every slot of the mix once, every source's numbers once, in any layout of tasks."""
    monkeypatch.setattr(mixing, "FAN", 5)
    monkeypatch.setattr(mixing, "SHARDS_A_TASK", 2)
    sizes = [("a", 90_000), ("b", 61_000), ("c", 9_000), (None, 70), ("d", 0), ("e", 1)]
    aims = mixing.targets(spark.createDataFrame(sizes, "source string, source_size long"))
    quotas = {r["rank"]: r.quota for r in mixing._quotas(aims, 64, 3).collect()}
    drawn = Counter()
    for r in mixing.draws(aims, 64, 3, 128, 7).collect():
        drawn[r["rank"]] += r.n
    assert sum(drawn.values()) == sum(quotas.values()) and drawn != quotas  # drawn by shard, mended after
    frame = mixing._quotas(aims, 64, 3)
    got = mixing._slots(frame, sum(quotas.values()), 128, 7).collect()
    assert sorted(r.slot for r in got) == list(range(sum(quotas.values()))) and all(r.slot // 128 == r.shard for r in got)
    for rank, n in quotas.items():
        assert sorted(r.k for r in got if r["rank"] == rank) == list(range(n))


def test_sums_before_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 4)
    rows = [(s, i, (i * 7) % 5) for s in ("x", None) for i in range(23) if i % 6]
    df = mixing._summed_before(spark.createDataFrame(rows, "s string, at long, v long"), "s", "at", "v", "before")
    got = {(r.s, r["at"]): r.before for r in df.collect()}
    assert got == {(s, i): sum(v for t, j, v in rows if t == s and j < i) for s, i, _ in rows}
