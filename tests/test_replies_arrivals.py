import json
import time

import pytest
from pyspark.sql import functions as F

from quizloom.operators.snapshots import SnapshotTable
from quizloom.plans import building
from quizloom.sources import provider, replies
from quizloom.sources.replies import ReplyLog
from quizloom.streaming import arrivals


class Counting:
    """A provider that notes its calls in a file, and never replies the same twice."""

    def __init__(self, path, fails=()):
        self.path, self.fails = str(path), fails

    def __call__(self, prompt, text):
        with open(self.path, "a") as f:
            f.write(prompt.split(":")[0] + "\n")
        if any(text.startswith(x) for x in self.fails):
            raise ConnectionError
        if prompt.startswith("solve"):
            return json.dumps({"questions": [{"index": 1, "correct_answer": "B", "explanation": ""}]})
        options = [{"key": k, "text": k} for k in "ABCD"]
        return json.dumps({"questions": [{"question_text": f"{text} at {time.time_ns()}?", "options": options, "correct_answer": "A"}]})

    def calls(self):
        try:
            return open(self.path).read().split()
        except FileNotFoundError:
            return []


DOCS = [(1, "no questions here", "t"), (2, "1. One?\nA. x\nB. y", "t"), (3, "refuse this", "t"), (4, "no questions here", "t"), (5, None, "t")]


def test_one_call_a_request_however_many_outputs_are_read(spark, tmp_path):
    ask, docs = Counting(tmp_path / "calls", ["refuse"]), spark.createDataFrame(DOCS, "doc_id long, text string, title string")
    log = ReplyLog(spark, str(tmp_path / "log"))
    outputs = building.upload_to_quizzes(docs, ask=ask, log=log)
    # documents 1 and 4 are one request, 3 and 5 one each; one batch is solved
    assert sorted(ask.calls()) == ["extract"] * 3 + ["solve"]
    for _ in range(2):
        quizzes, questions, statuses = ([tuple(r) for r in df.collect()] for df in outputs)
        assert {k: s for k, s, _ in statuses} == {1: "completed", 2: "completed", 3: "failed", 4: "completed", 5: "completed"}
        assert {q[0] for q in quizzes} == {q[0] for q in questions} == {1, 2, 4, 5}
    again = building.upload_to_quizzes(docs, ask=ask, log=log)
    assert sorted(again[1].collect()) == sorted(outputs[1].collect()) and len(ask.calls()) == 4
    # without a log to keep them, a run asks once as well
    found, failures = building.extract_or_generate(docs, ask=ask)
    assert found.count() and failures.count() and found.count() and len(ask.calls()) == 7


def test_failures_are_kept_and_asked_again_on_demand(spark, tmp_path):
    log, df = ReplyLog(spark, str(tmp_path / "log")), spark.createDataFrame([(1, "p", "refuse"), (2, "p", "fine"), (3, "p", "fine")], "id int, prompt string, text string")
    first, later = Counting(tmp_path / "a", ["refuse"]), Counting(tmp_path / "b")
    got = {r.id: r for r in log.complete(df, "prompt", "text", first, model="m").collect()}
    assert got[1].reply_error == "provider_error: ConnectionError" and got[2].reply == got[3].reply
    assert log.complete(df, "prompt", "text", later, model="m").where("reply_error IS NOT NULL").count() == 1 and later.calls() == []
    got = {r.id: r for r in log.complete(df, "prompt", "text", later, model="m", retry_failed=True).collect()}
    assert len(later.calls()) == 1 and got[1].reply_error is None and got[1].reply
    # another model is another request; a reply stays the newest answer
    assert log.complete(df, "prompt", "text", later, model="n").count() == 3 and len(later.calls()) == 3
    assert log.kept().count() == 4 and log.complete(df.limit(0), "prompt", "text", later).count() == 0


def test_digests_tell_requests_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), ("a", None), ("a", ""), ("1:a", "")], "p string, t string")
    found = [r[0] for r in df.select(replies.request_digest("m", F.col("p"), F.col("t"))).collect()]
    assert len(set(found)) == 4 and found[2] == found[3]


def test_the_other_consumers_ask_once(spark, tmp_path):
    ask = Counting(tmp_path / "calls")
    options = [{"key": "A", "text": "x"}]
    comments = spark.createDataFrame([(1, "Q?", options, "why?"), (2, "Q?", options, "why?")], "id int, question_text string, options array<struct<key:string,text:string>>, content string")
    answered = provider.tutor(comments, ask)
    assert answered.count() == answered.where("reply IS NOT NULL").count() == 2 and ask.calls() == ["tutor"]
    blanks = provider.metadata(spark.createDataFrame([(1, "text")], "doc_id int, text string"), "doc_id", "text", ask)
    assert blanks.first().title == "" and blanks.count() == 1 and ask.calls() == ["tutor", "metadata"]


def tables(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "documents")), SnapshotTable(spark, str(tmp_path / "states"))


def put(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.txt").write_text(text)


LONG = "A text that is long enough to be stored as a document, because it has more than a hundred characters in all."


def test_files_are_stored_as_they_arrive(spark, tmp_path):
    documents, states = tables(spark, tmp_path)
    folder = tmp_path / "in"
    put(folder, a=LONG, b="short", c=LONG + "c")

    def go():
        arrivals.arrivals(arrivals.watch(spark, str(folder), 2), documents, states, str(tmp_path / "cp")).awaitTermination()

    go()
    seen = {r.path.rsplit("/", 1)[1]: (r.status, r.error) for r in arrivals.current(states).collect()}
    assert seen == {"a.txt": ("completed", ""), "b.txt": ("failed", "too_short"), "c.txt": ("completed", "")}
    put(folder, d=LONG)
    go()
    go()  # nothing new
    assert documents.read().count() == 4 and states.read().count() == 8
    assert documents.read().where("status = 'completed'").select("text").distinct().count() == 2
    assert arrivals.unfinished(states).isEmpty()


@pytest.mark.parametrize("broken", [1, 2, 3])
def test_a_batch_cut_short_is_taken_up_again(spark, tmp_path, monkeypatch, broken):
    """Whichever of a batch's three appends fails, before or after it is made, each file is stored once."""
    documents, states = tables(spark, tmp_path)
    folder = tmp_path / "in"
    put(folder, **{f"f{i}": LONG + str(i) for i in range(5)})
    append, made = SnapshotTable.append, []

    def failing(self, rows, key=None):
        made.append(key)
        if len(made) == broken + 3:  # in the second batch
            if broken == 2:
                append(self, rows, key)
            raise OSError("lost")
        return append(self, rows, key)

    def go():
        arrivals.arrivals(arrivals.watch(spark, str(folder), 2), documents, states, str(tmp_path / "cp")).awaitTermination()

    monkeypatch.setattr(SnapshotTable, "append", failing)
    with pytest.raises(Exception, match="lost"):
        go()
    monkeypatch.undo()
    if broken > 1:
        assert arrivals.unfinished(states).count() == 2
    go()
    assert documents.read().groupBy("path").count().where("count > 1").isEmpty() and documents.read().count() == 5
    assert {r.status for r in arrivals.current(states).collect()} == {"completed"} and states.read().count() == 10
