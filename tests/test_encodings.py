import random

import pytest
from pyspark.sql import functions as F

from quizloom.sources import encodings, files


@pytest.fixture(scope="module")
def model(spark):
    return encodings.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_marks_and_forms(model):
    text = "Größe und Maß, déjà vu, señor"
    for way, name in (("utf-8", "utf-8"), ("utf-8-sig", "utf-8-sig"), ("utf-16", "utf-16"), ("utf-16-le", "utf-16-le"), ("utf-16-be", "utf-16-be"), ("utf-32", "utf-32")):
        assert encodings.judge(text.encode(way), model)[::2] == (name, text)
    assert encodings.judge(b"plain", model) == ("ascii", 1.0, "plain") and encodings.judge(b"", model) == ("ascii", 1.0, "")
    assert 0.5 < encodings.judge("é".encode(), model)[1] < encodings.judge("éééé".encode(), model)[1] < 1


def test_what_nothing_is_known_of_is_read_as_utf_8(model):
    rng = random.Random(1)
    noise = bytes(rng.randrange(1, 256) for _ in range(400))
    name, confidence, text = encodings.judge(noise, model)
    assert name == "utf-8" and confidence < 0.5 and text == noise.decode("utf-8", "replace")
    assert encodings.judge(b"\xff\xfe\xff", {})[0] == "utf-8"


def test_held_out_accuracy(spark):
    """Fitted on one half of the documents, judged on the other, in single-byte encodings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model = encodings.fit(docs.where("doc_id % 2 = 0"))
    right = total = 0
    for r in docs.where("doc_id % 2 = 1").collect():
        if not r.text.isascii():
            way = ("cp1252", "mac_roman", "cp850")[r.doc_id // 2 % 3]
            total += 1
            right += encodings.judge(r.text.encode(way, "replace"), model)[2] == r.text.encode(way, "replace").decode(way)
    assert total > 150 and right / total > 0.95


def test_uploads_with_detection(spark, model):
    text = "Größe und Maß der Straße, für die Übung schön geübt. " * 4
    rows = [(f"{w}.txt", bytearray(text.encode(w))) for w in ("cp850", "mac_roman", "utf-16-le", "cp1252")] + [("none.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary").withColumn("length", F.coalesce(F.length("content"), F.lit(1)).cast("long"))
    got = {r.path: r.text for r in files.extract(df, pairs=model).collect()}
    assert got.pop("none.txt") is None and set(got.values()) == {text.strip()}


def test_letters_are_judged_by_what_is_around_them(spark):
    """Single letters whose pairs are likelier in another encoding, and a window that a text repeats."""
    texts = ["Allez, ément; ément! ément? ément: ément", "Mot. Èment. Èment. Èment.", "Le père, le frère, la mère, très chère, après."] * 5
    texts += ["Der Bär kam. Sie schrieb beäver dazu.", "Le pré, l'été. Èonoi. Un éon, le éonide."]
    model = encodings.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert encodings.judge("Sie schrieb beäver dazu.".encode("mac_roman"), model)[::2] == ("mac_roman", "Sie schrieb beäver dazu.")
    assert encodings.judge("Un mot. Èonoi.".encode("mac_roman"), model)[::2] == ("mac_roman", "Un mot. Èonoi.")
    repeated = "Allez, ément; ément! ément? ément: ément" + ". ément" * 30
    assert encodings.judge(repeated.encode("cp1252"), model)[::2] == ("cp1252", repeated)
