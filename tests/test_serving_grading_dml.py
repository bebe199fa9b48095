import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quizloom import schemas
from quizloom.operators import dml, grading, quiz_json, serving
from quizloom.sources import files, provider

OPTIONS = [{"key": k, "text": f"t{k}"} for k in "ABCD"]


def quiz(*changes):
    qs = []
    for change in changes:
        x = {"question_text": "What?", "options": [dict(o) for o in OPTIONS], "correct_answer": "A"}
        change(x)
        qs.append(x)
    return json.dumps({"questions": qs})


FINE = lambda x: None


@pytest.mark.parametrize(
    "reply,want",
    [
        (quiz(FINE, FINE), (0, "")),
        ("```json\n" + quiz(FINE) + "\n```", (0, "")),
        ("just prose", (0, "bad_json")),
        ('{"title": 1}', (0, "no_questions")),
        ('{"questions": "x"}', (0, "not_a_list")),
        (quiz(FINE, lambda x: x.pop("options")), (2, "missing_fields")),
        (quiz(lambda x: x["options"].pop()), (1, "option_count")),
        (quiz(lambda x: x["options"][0].update(key="1")), (1, "option_keys")),
        (quiz(lambda x: x.update(correct_answer="E")), (1, "answer")),
        (quiz(lambda x: x["options"][3].update(text=" 　")), (1, "empty_text")),
        (quiz(FINE, lambda x: x.update(correct_answer="E"), lambda x: x.pop("options")), (2, "answer")),
    ],
)
def test_validation(spark, reply, want):
    df = spark.createDataFrame([(reply,)], "r string").select(quiz_json.validate(F.col("r")).alias("v"))
    assert tuple(df.first().v) == want


def test_unique_generated_questions(spark):
    reply = json.dumps({"questions": [{"question_text": t} for t in ("What?", "what!", "wh at", "What")]})
    df = spark.createDataFrame([(1, reply)], "k int, r string").withColumn("q", quiz_json.parse(F.col("r")))
    assert [(r.order, r.question_text) for r in quiz_json.explode_questions(df, "k", "q").collect()] == [(1, "What?"), (2, "wh at")]
    assert spark.createDataFrame([("x",)], "r string").select(quiz_json.parse(F.col("r")).isNull().alias("n")).first().n


def test_filters_and_pages(spark):
    rows = [(1, "Toán", True, True), (2, "TOÁN học", True, True), (3, "Lý", True, False), (4, None, True, True), (5, "", True, True)]
    df = spark.createDataFrame(rows, "id int, subject string, is_public boolean, is_approved boolean")
    shown = serving.published(df)
    assert shown.count() == 4
    assert {r.id for r in serving.matching(shown, subject="^toán").collect()} == {1, 2}
    assert serving.matching(shown, subject="", id=None).count() == 4
    assert serving.filter_options(df, "subject").first().subject == ["Lý", "TOÁN học", "Toán"]
    assert [r.id for r in serving.page(df, [F.desc("id")], 2, 2).collect()] == [3, 2]
    assert serving.page(df, [F.desc("id")], 9, 2).isEmpty()
    assert tuple(serving.page_count(df.limit(0), 20).first()) == (0, 0) and tuple(serving.page_count(df, 2).first()) == (5, 3)
    for bad in ((0, 5), (1, 0), (1, 51)):
        with pytest.raises(ValueError):
            serving.page(df, [F.desc("id")], *bad)
    plan = serving.page(df, [F.desc("id")], 2, 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_history_of_a_deleted_quiz(spark):
    attempts = spark.createDataFrame([("a", "q1", 1, 32, 100 / 32, None), ("b", "gone", 0, 1, None, None)], "id string, quiz_id string, score int, total int, percentage double, completed_at timestamp")
    quizzes = spark.createDataFrame([("q1", "One")], "id string, title string")
    assert {(r.id, r.quiz_title, r.percentage) for r in serving.history(attempts, quizzes).collect()} == {("a", "One", 3.12), ("b", serving.DELETED_TITLE, 0.0)}


def test_grading(spark):
    asked = spark.createDataFrame([(1, "q1", "A", None), (1, "q2", "B", "why"), (1, "q3", "C", ""), (2, "q1", "A", "")], "s int, question_id string, correct_answer string, explanation string")
    given = spark.createDataFrame([(1, "q1", 0, "B"), (1, "q1", 1, "A"), (1, "q2", 2, "A"), (1, "zz", 3, "A")], "s int, question_id string, pos int, selected string")
    rows = grading.grade(asked, given, ["s"])
    assert sorted((r.s, r.question_id, r.selected, r.is_correct, r.explanation) for r in rows.where("s = 1").collect()) == [
        (1, "q1", "A", True, ""), (1, "q2", "A", False, "why"), (1, "q3", None, False, "")
    ]
    t = {r.s: r for r in grading.tally(rows, ["s"]).collect()}
    assert (t[1].score, t[1].total, t[1].wrong, t[1].skipped, t[1].percentage_rounded, t[1].band) == (1, 3, 1, 1, 33.33, "poor")
    assert (t[2].score, t[2].skipped) == (0, 1)
    bands = spark.createDataFrame([(80.0,), (79.99,), (60.0,), (40.0,), (39.9,)], "p double").select(grading.band(F.col("p")).alias("b"))
    assert [r.b for r in bands.collect()] == ["excellent", "good", "good", "fair", "poor"]
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_changes(spark):
    attempts = spark.createDataFrame([("a", None), ("b", "u")], "id string, user_id string")
    users = spark.createDataFrame([("u1",), ("u2",)], "id string")
    for n, want in ((0, None), (1, "u1"), (2, None)):
        got = dml.assign_orphans(attempts, users.orderBy("id").limit(n))
        assert {r.id: r.user_id for r in got.collect()} == {"a": want, "b": "u"}
    known = spark.createDataFrame([("g1", "old@x")], "google_id string, email string")
    new = spark.createDataFrame([("g1", "new@x"), ("g2", "b@x"), ("g2", "a@x"), (None, "c@x"), ("g3", "")], "google_id string, email string")
    after, bad = dml.find_or_insert(known, new)
    assert sorted(map(tuple, after.collect())) == [("g1", "old@x"), ("g2", "a@x")] and bad.count() == 2
    df = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (3, "c", None)], "k int, a string, b string")
    changes = spark.createDataFrame([(1, "A", "B"), (3, "Z", "W")], "k int, a string, b string")
    assert sorted(map(tuple, dml.backfill(df, changes, "k", ["a", "b"]).collect())) == [(1, "A", "x"), (2, "", "y"), (3, "c", "W")]
    gone = spark.createDataFrame([("1",)], "id string")
    q, c, t = dml.cascade_delete(gone, spark.createDataFrame([("1",), ("2",)], "id string"), spark.createDataFrame([("1",), ("2",)], "quiz_id string"), spark.createDataFrame([("1",), (None,)], "quiz_id string"))
    assert (q.count(), c.count(), t.count()) == (1, 1, 1)


def test_append_replace_export(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "é"), (2, None)], "k int, v string")
    dml.append(df, path)
    dml.append(df, path)
    assert spark.read.parquet(path).count() == 4
    dml.replace(dml.update_where(spark.read.parquet(path), F.col("v").isNull(), v="n"), path)
    assert {r.v for r in spark.read.parquet(path).collect()} == {"é", "n"}
    dml.export_json(df, str(tmp_path / "j"), "v")
    assert '{"v":"é"}' in "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "j").glob("*.json"))


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}<w:tbl>{rows}</w:tbl></w:body></w:document>")
    return out.getvalue()


def test_upload(spark, tmp_path):
    long = "Nội dung bài học " * 10
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf" + long.encode())
    (tmp_path / "b.TXT").write_bytes(("é" * 120).encode("latin-1"))
    (tmp_path / "c.docx").write_bytes(docx(["Heading", " ", long], [["a", "b"], ["", "c"]]))
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.xlsx").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes(b"")
    (tmp_path / "g.txt").write_bytes(b"short")
    (tmp_path / "h.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.extract(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"].text == long.strip() and got["a.txt"].is_valid and got["a.txt"].status == "completed"
    assert got["b.TXT"].text == "é" * 120
    assert got["c.docx"].text == f"Heading\n{long.strip()}\na | b\nc"
    assert got["d.docx"].error.startswith("extraction_failed") and got["d.docx"].status == "failed"
    assert (got["e.xlsx"].error, got["g.txt"].error) == ("unsupported_type", "too_short")
    assert "f.txt" not in got  # Spark's file scan leaves empty files out; the gate is for rows from elsewhere
    empty = spark.createDataFrame([("x/f.txt", 0, bytearray())], "path string, length long, content binary")
    assert files.extract(empty).first().error == "empty_file"
    assert got["h.pdf"].error.startswith("extraction_failed")


def test_provider_retries(spark):
    waits, replies = [], iter(["nope", "[]", '{"ok": 1}'])
    got = provider._ask(lambda p, t: next(replies), "", "", lambda d: isinstance(d, dict), waits.append)
    assert got == ('{"ok": 1}', None) and waits == [2.0, 4.0]
    assert provider._ask(lambda p, t: "nope", "", "", None, waits.append) == (None, "bad_json")
    df = spark.createDataFrame([(1, "Title here\nbody"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.title for r in provider.metadata(df, "doc_id", "text").collect()} == {1: "Title here", 2: ""}
    asked = spark.createDataFrame([("q", [("A", "x")], "why?")], "question_text string, options array<struct<key:string,text:string>>, content string")
    assert provider.tutor(asked).first().reply is not None


def raising(prompt, text):
    if text.startswith("slow"):
        __import__("time").sleep(3)
    if text.startswith("bad"):
        raise OSError("no connection")
    return json.dumps({"title": text})


def test_a_provider_that_raises_or_hangs_costs_its_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["fine", "bad", "slow", "good", None])], "k int, t string").withColumn("p", F.lit("metadata"))
    got = {r.k: (r.reply is not None, r.reply_error) for r in provider.complete(df.coalesce(1), "p", "t", raising, timeout=1.0, in_flight=2).collect()}
    assert got == {0: (True, None), 1: (False, "provider_error: OSError"), 2: (False, "timeout"), 3: (True, None), 4: (True, None)}
    asked = spark.createDataFrame([("bad", [("A", "x")], "why?")], "question_text string, options array<struct<key:string,text:string>>, content string")
    assert provider.tutor(asked, raising).first().reply is None
    assert provider.metadata(df.where("k = 1"), "k", "t", raising).first().title == ""
    assert provider.complete(df, "p", "t", raising, tasks=3, timeout=1.0).rdd.getNumPartitions() == 3


def test_waits_are_the_default_and_calls_are_bounded(spark, tmp_path):
    import inspect

    options = inspect.signature(provider.complete).parameters
    assert (options["sleep"].default, options["timeout"].default, options["in_flight"].default) == (__import__("time").sleep, 300.0, 5)
    folder = str(tmp_path)

    def counting(prompt, text):
        import os
        import time
        import uuid

        mark = f"{folder}/{uuid.uuid4().hex}.running"
        open(mark, "w").close()
        time.sleep(0.05)
        running = sum(n.endswith(".running") for n in os.listdir(folder))
        os.remove(mark)
        return json.dumps({"running": running})

    df = spark.range(40).select("id", F.lit("x").alias("p"), F.lit("y").alias("t"))
    got = [json.loads(r.reply)["running"] for r in provider.complete(df, "p", "t", counting, in_flight=3, tasks=1).collect()]
    assert 1 < max(got) <= 3


def test_generated_quizzes_that_are_not_valid(spark):
    replies = {"a": quiz(FINE, FINE), "b": quiz(lambda x: x["options"].pop()), "c": json.dumps({"questions": []}), "d": "prose"}
    df = spark.createDataFrame([(k, k) for k in replies], "k string, t string")
    found, failures = provider.generate(df, "k", "t", lambda p, t: replies[t], sleep=lambda s: None)
    assert [(r.k, r.order, r.question_text) for r in found.collect()] == [("a", 1, "What?")]
    assert {r.k: r.error for r in failures.collect()} == {"b": "option_count", "c": "no_questions", "d": "bad_json"}


def test_owner_user_row_and_answers_hidden(spark):
    users = spark.createDataFrame([("1", "e", "n", None, "admin")], "id string, email string, full_name string, picture string, role string")
    assert serving.user_row(users).columns == ["id", "email", "full_name", "picture"]
    rows = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "user_id string, v string")
    assert [r.v for r in serving.owned(rows, "1").collect()] == ["x"]
    shown = serving.hidden_answers(spark.createDataFrame([], schemas.QUESTIONS))
    assert shown.columns == ["id", "question_text", "options", "order"]


def test_replace_swaps_whole_versions(spark, tmp_path):
    path = str(tmp_path / "c")
    one, two = spark.range(3).toDF("k"), spark.range(5).toDF("k")
    dml.replace(one, path)
    broken = two.select(F.raise_error(F.lit("no")).cast("long").alias("k"))
    with pytest.raises(Exception):
        dml.replace(broken, path)
    assert spark.read.parquet(path).count() == 3
    dml.replace(two, path)
    assert spark.read.parquet(path).count() == 5 and not [p for p in tmp_path.iterdir() if ".old-" in p.name]


def test_schemas_hold_rows(spark):
    for s in schemas.COLLECTIONS.values():
        assert spark.createDataFrame([], s).schema == s


def test_discovery_and_dropping_all(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS shelf LOCATION '{tmp_path}/shelf'")
    for name in ("quizzes", "users"):
        spark.range(3).write.saveAsTable(f"shelf.{name}")
    found = {(r.database, r.table) for r in files.discover(spark).collect()}
    assert {("shelf", "quizzes"), ("shelf", "users")} <= found
    with pytest.raises(ValueError, match="confirm"):
        dml.drop_all(spark, "shelf", "shelve")
    assert spark.table("shelf.users").count() == 3
    dml.drop_all(spark, "shelf", "shelf")
    assert not any(r.database == "shelf" for r in files.discover(spark).collect())
    spark.sql("DROP DATABASE shelf")
