import hashlib

import corpus_pipeline
import __spark_entry__
from quizloom.llm import common, mixing, quality, suffixes
from quizloom.llm.bytebpe import ByteBpe, default_path

from .brute import WORD, components, quality_kept, repeats

TINY = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, TINY).write.parquet(str(tmp_path / str(len(seen))))
        docs = spark.read.parquet(str(tmp_path / str(len(seen))))
        seen[name] = (before.collect(), docs.collect())
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    names = list(seen)
    a, b = seen[names[0]]
    kept = quality_kept([(r.doc_id, r.text, r.lang) for r in a], [(r.doc_id, r.quality) for r in spark.read.parquet(f"{TINY}/labels.parquet").collect()], list(quality.CUTOFFS))
    assert {r.doc_id for r in b} == {r.doc_id for r, k in zip(a, kept, strict=True) if k} and 0 < len(b) < len(a)
    a, b = seen[names[1]]
    want = {k for k, (_, c) in components([(r.doc_id, r.text) for r in a], 5).items() if k == c}
    assert {r.doc_id for r in b} == want
    a, b = seen[names[2]]
    digests = repeats([(r.doc_id, r.text) for r in a], 100)
    assert len(a) == len(b)
    for r in b:
        n, gone, _, _ = digests[r.doc_id]
        assert n - gone - 8 <= len(r.text.encode()) <= n - gone  # a character is removed whole
    a, b = seen[names[3]]
    plan = {r.doc_id: r.taken for r in mixing.mixture(spark.createDataFrame(a)).collect()}
    assert {r.doc_id: len(WORD.findall(r.text)) for r in b} == {k: v for k, v in plan.items() if v}
    a, b = seen[names[4]]
    own, texts = ByteBpe(open(default_path(), encoding="utf-8").read()), {r.doc_id: r.text for r in a}
    for r in b:
        ids = own.encode(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))
    assert suffixes.GRAM < 100


def table_of(spark, rows, folder):
    more = "doc_id long, text string, lang string, source string, n_chars int, kept boolean, spans string, size int, component string"
    spark.createDataFrame(rows, more).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(300)] + [(None, 0, 0), (3, None, 0), (4, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_unusual_tables(spark, tmp_path):
    """Nulls in any column, ties, repeated rows, clashing columns, a very long text and empty tables."""
    text = lambda i, n=60: " ".join(f"w{i * 1000 + k}" for k in range(n))
    more = lambda i: (i % 2 == 0, None if i % 3 else f"s{i}", i, "c")
    rows = [(i, text(i), "en", f"s{i % 3}", 1, *more(i)) for i in range(40)]
    rows += [rows[5], rows[5], (None, text(900), None, None, None, None, None, None, None), (None, text(900), None, None, None, None, None, None, None)]
    rows += [(50, None, "en", "s1", 0, *more(0)), (51, "", None, "s1", 0, *more(1)), (52, text(7), "en", "s1", 1, *more(2)), (53, text(70, 60_000), "de", None, 1, *more(3))]
    rows += [(60, text(80), "en", "s2", 1, *more(4)), (60, text(81), "en", "s2", 1, *more(4)), (61, text(81) + " x", "en", "s2", 1, *more(5))]
    folder = table_of(spark, rows, str(tmp_path / "t"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, folder))
        assert docs.columns == columns, name
        counts.append(sorted(str(r.doc_id) for r in docs.collect()))
    ids = [str(i) for i in range(40)]
    assert counts[0] == sorted([*ids, "5", "5", "None", "None", "52", "53", "60", "60", "61"])
    assert counts[1] == counts[2] == sorted([*ids, "None", "None", "53", "60", "60"])
    got = corpus_pipeline.run(spark, folder).collect()
    assert {str(r.doc_id) for r in got} <= set(counts[1]) and len(got) <= len(counts[1])
    assert corpus_pipeline.run(spark, table_of(spark, rows[:0], str(tmp_path / "empty"))).isEmpty()


def test_intermediate_tables_are_removed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda s: f"file://{tmp_path}/{__import__('uuid').uuid4().hex}")
    text = lambda i: " ".join(f"w{i * 1000 + k}" for k in range(60))
    folder = table_of(spark, [(i, text(i % 30), "en", "a", 1, True, "s", 1, "c") for i in range(40)], str(tmp_path / "in"))
    before = set(tmp_path.iterdir())
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = set(tmp_path.iterdir()) - before
    assert len(left) == 1  # what the last stage reads


def test_no_machine_local_folder_on_a_cluster(spark):
    class Conf:
        def get(self, name, default):
            return default

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with __import__("pytest").raises(RuntimeError):
        common.shared_dir(Session())
