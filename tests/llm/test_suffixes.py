import glob
import random
import time

import pytest

from quizloom.llm import common, suffixes

from .brute import repeats


def texts(seed, n):
    """Texts with copies, edited copies, shared passages, repetition and long stretches."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, out = prose(40), []
    for i in range(n):
        kind = rng.randrange(6)
        if kind == 0 or not out:
            out.append(prose(rng.randint(0, 150)))
        elif kind == 1:
            out.append(rng.choice(out))
        elif kind == 2:
            t = list(rng.choice(out))
            for _ in range(3):
                if t:
                    t[rng.randrange(len(t))] = rng.choice("xyz")
            out.append("".join(t))
        elif kind == 3:
            out.append(prose(rng.randint(0, 30)) + passage[rng.randint(0, 20) :] + prose(rng.randint(0, 30)))
        elif kind == 4:
            out.append((word() + " ") * rng.randint(1, 120))
        else:
            out.append(prose(20) + rng.choice(out)[: rng.randint(0, 300)] + prose(20))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = [(i * 3 - 7, t) for i, t in enumerate(texts(seed, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in suffixes.kept_digests(df).collect()}
    assert got == repeats(rows, 100)


def test_edges(spark):
    long = " ".join(f"w{i * i % 9973}" for i in range(30_000))
    rows = [(1, long), (2, None), (3, ""), (4, "a" * 99), (5, "a" * 100), (6, "a" * 250), (7, long[5000:9000]), (None, long[:500])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in suffixes.kept_digests(df).collect()}
    assert got == repeats(rows, 100)
    assert suffixes.kept_digests(df.limit(0)).isEmpty()


def test_repeated_rows_share_a_place(spark):
    text = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in suffixes.kept_digests(df).collect())
    assert got == [(1, 0), (1, 0), (2, len(text))]


def test_without_repeats_keeps_columns_and_whole_characters(spark):
    text = "".join(f"{i}é" for i in range(150))
    df = spark.createDataFrame([(1, text, "a", 5), (2, "ñ" + text, "b", 6), (3, None, "c", 0)], "doc_id long, text string, spans string, n_chars long")
    got = {r.doc_id: r for r in suffixes.without_repeats(df).collect()}
    assert got[1].text == text and got[2].text == "ñ" and got[3].text is None
    assert (got[2].spans, got[2].n_chars) == ("b", 1)


def test_cover_and_order():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))
    rng = random.Random(5)
    data = ["".join(rng.choice("ab") for _ in range(160)).encode() for _ in range(30)]
    data += [d[:140] + b"c" * 20 for d in data[:10]]
    starts = [rng.randrange(8) for _ in data]
    order = suffixes.sort_suffixes(list(enumerate(starts)), suffixes.CoverSample(data, 100))
    heads = [data[i][k : k + 100] for i, k in order]
    assert heads == sorted(heads)


def test_buckets_beyond_the_bound_are_not_held(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_ROWS", 2, raising=False)
    rng = random.Random(11)
    prose = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage = prose(400)
    rows = [(i, prose(50) + passage + prose(50)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    handed = []
    monkeypatch.setattr(suffixes, "written", lambda frame: handed.append(frame) or frame)
    assert {r[0]: tuple(r)[1:] for r in suffixes.kept_digests(df).collect()} == repeats(rows, 100)
    assert any("bytes" in f.columns and not f.where("bytes IS NOT NULL").isEmpty() for f in handed)
    twice = df.unionByName(df.where("doc_id = 0"))
    assert {tuple(r) for r in suffixes.kept_digests(twice).collect()} == {(k, *v) for k, v in repeats(rows, 100).items()}


def test_different_texts_of_one_key(spark):
    """Texts that share a key, or have none, lose only what repeats in themselves or before them."""
    own = lambda c: " ".join(f"{c}{i * i}" for i in range(60))
    rows = [(None, own("n")), (None, own("m")), (None, own("m")), (4, own("a")), (4, own("b") + own("a")), (4, own("b") + own("a")), (5, own("c")), (6, own("n") + "!"), (6, own("z"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.n_bytes, r.kept_sha256) for r in suffixes.kept_digests(df).collect()}
    # the order of texts of one key is that of a hash; either of the two may come first
    tails = [[(4, own("a")), (4, own("b") + own("a"))], [(4, own("b") + own("a")), (4, own("a"))]]
    wanted = []
    for four in tails:
        places = {-2: own("n"), -1: own("m"), 1: four[0][1], 2: four[1][1], 5: own("c"), 6: own("n") + "!", 7: own("z")}
        names = {-2: None, -1: None, 1: 4, 2: 4, 5: 5, 6: 6, 7: 6}
        wanted.append({(names[k], n, h) for k, (n, _, _, h) in repeats(list(places.items()), 100).items()})
    assert got in wanted
    assert suffixes.kept_digests(df).count() == len(rows)
    left = [(r.doc_id, r.text) for r in suffixes.without_repeats(df).collect()]
    assert left.count((None, own("m"))) == 2 and (5, own("c")) in left and (6, own("z")) in left


def test_no_bucket_is_held_beyond_the_bound(spark, monkeypatch):
    """One passage in more and more documents: what a task holds of a bucket stays flat."""
    rng = random.Random(12)
    prose = lambda k: "".join(rng.choice("abcdefgh ") for _ in range(k))
    passage, texts = prose(300), [prose(120) for _ in range(4000)]
    schema = "key long, sub long, start long, n long, offset long, bytes binary"
    most = []
    for n in (500, 2000):
        slabs = []
        for b in suffixes._slab_rows(100)(iter([_asked_batch(texts, passage, n)])):
            slabs += b.to_pylist()
        held = []
        monkeypatch.setattr(suffixes, "repeats_in_bucket", lambda rows, window: held.append(len(rows)) or [])
        frame = spark.createDataFrame([tuple(r.values()) for r in slabs if r["data"] is not None], "bucket long, key long, sub long, start long, n long, offset long, data binary")
        found = suffixes._sorted_buckets(100, 50)
        rows = frame.orderBy("bucket").toArrow().to_batches()
        out = [r for b in found(iter(rows)) for r in b.to_pylist()]
        assert set(out[0]) == {c.split()[0] for c in schema.split(", ")}
        most.append(max([0, *held]))
    assert most[1] <= 50 and any(r["bytes"] is not None for r in out)


def _asked_batch(texts, passage, n):
    import pyarrow as pa

    rows = [texts[i] + passage + texts[-1 - i] for i in range(n)]
    asked = [[{"start": s, "n": 30, "offset": 20} for s in (90, 320)] for _ in rows]
    return pa.record_batch([pa.array(range(n), pa.int64()), pa.array([0] * n, pa.int64()), pa.array(rows), pa.array(asked)], names=["key", "sub", "text", "blocks"])


def _row(mark, key, start, steps, data):
    return 7, key, 0, start, len(steps), mark, bytes(steps) + data


def test_sorting_judges_runs():
    """Likely copies are removed only where sorting puts them beside an equal earlier one."""
    rng = random.Random(13)
    data = bytes(rng.choice(b"abc ") for _ in range(400))
    other = data[:150] + b"#" + data[151:]
    steps = [69, 60, 40, 69, 63]
    runs = suffixes.Runs(100)
    for row in (_row(suffixes.SOURCE_RUN, 1, 10, steps, data), _row(suffixes.COPY_RUN, 2, 0, steps, data), _row(suffixes.COPY_RUN, 3, 5, steps, other)):
        assert runs.add(*row) == []
    # of the third, the blocks whose bytes hold the edit stay, whatever their hashes said
    assert runs.judged() == [(2, 0, 0, 301), (3, 0, 174, 132)]


def test_runs_are_sorted_in_parts(monkeypatch):
    """However many copies a run has, those held stay bounded, and each part meets the first one."""
    monkeypatch.setattr(suffixes, "SORTED_BYTES", 3000)
    rng = random.Random(14)
    data = bytes(rng.choice(b"abc ") for _ in range(199))
    runs, gone, most = suffixes.Runs(100), [], 0
    runs.add(*_row(suffixes.SOURCE_RUN, 1, 0, [60, 40], data))
    for key in range(2, 200):
        gone += runs.add(*_row(suffixes.COPY_RUN, key, 0, [60, 40], data))
        most = max(most, runs.size)
    gone += runs.judged()
    assert sorted(gone) == [(key, 0, 0, 100) for key in range(2, 200)] and most < 3500


def test_equal_blocks_are_told_by_bytes():
    """Blocks of equal hashes get one number only if their bytes agree."""
    import numpy as np

    rng = random.Random(15)
    one, two = (bytes(rng.choice(b"abcdef") for _ in range(120)) for _ in range(2))
    data = np.frombuffer(one + two + one, "u1")
    start, n, same = np.array([0, 120, 240]), np.array([21, 21, 21]), np.zeros(3, "u8")
    number = suffixes.numbered(data, start, n, same, same, 100)
    assert number[0] == number[2] != number[1]


def rows_written(monkeypatch, module):
    """Counts the rows of all tables that a module writes on its way."""
    inner, made = module.written, []

    def counting(df):
        table = inner(df)
        made.append(table.count())
        return table

    monkeypatch.setattr(module, "written", counting)
    return made


@pytest.mark.parametrize("key", [None, 5])
def test_work_is_linear_in_repeated_rows(spark, monkeypatch, key):
    """n equal rows that share a passage with one other document."""
    rng = random.Random(4)
    words = [" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(3)]
    sums = []
    for n in (25, 400):
        rows = [(key, words[0] + words[1])] * n + [(9, words[2] + words[1])]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        made = rows_written(monkeypatch, suffixes)
        found = suffixes.kept_digests(df).collect()
        monkeypatch.undo()
        want = repeats([(key, rows[0][1]), rows[-1]], 100)
        assert sorted(map(str, (tuple(r) for r in found))) == sorted(str((k, *want[k])) for k, _ in rows)
        sums.append(sum(made))
    assert sums[0] == sums[1]


def test_the_least_key_is_not_null(spark):
    low, text = -(1 << 63), "some words that are long enough to be a repeat of more than a hundred bytes, as they are in every one of these texts"
    rows = [(low, text), (None, text), (low, text + " again"), (3, text)]
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffixes.kept_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # the null key comes first; of the two texts of one key either is before the other
    n = len(text)
    assert got[None, n] == 0 and got[low, n] == n and got[3, n] == n and got[low, n + 6] == n


def test_what_a_written_table_shuffled_is_removed(spark):
    """When a table is written its shuffle files go at once, and the session's setting is as before."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    left = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(i, f"{i} {text}" if i % 2 else f"{i}") for i in range(40)], "doc_id long, text string").repartition(3)
    before, setting = left(), spark.conf.get(common.CLEANED, None)
    found = suffixes.removals(suffixes.keyed(docs, "doc_id", "text")[1])
    until = time.time() + 20
    while left() - before and time.time() < until:  # executors are told without waiting
        time.sleep(0.2)
    assert not left() - before and spark.conf.get(common.CLEANED, None) == setting
    assert found.count() == 19
