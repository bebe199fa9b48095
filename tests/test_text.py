import random

import pytest
from pyspark.sql import functions as F

from quizloom.functions import strings
from quizloom.operators import text

SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    got = [r.x for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]
    return got[0] if len(got) == 1 else got


def test_strip_is_the_unicode_one(spark):
    values = [SPACES + "a b" + SPACES, SPACES, "", "x", "​x​"]
    assert one(spark, strings.strip, *values) == [v.strip() for v in values]


def test_rfind(spark):
    assert one(spark, lambda c: strings.rfind(c, "\n\n"), "a\n\nb\n\nc", "abc", "\n\n", "") == [4, -1, 0, -1]
    assert one(spark, lambda c: strings.rfind(c, ". "), "a. b. c", ". ", ".") == [4, 0, -1]


@pytest.mark.parametrize(
    "raw,want",
    [
        ("a\nPage 1 of 10\nb", "a\n\nb"),
        ("Trang 17/31 y", " y"),
        ("trang 3 TRÊN 7", ""),
        ("a\n\n  12  \n\nb", "a\n\nb"),
        ("a\n– 42 –\nb", "a\n\nb"),
        ("there are 15 dogs", "there are 15 dogs"),
        ("12345", "12345"),
    ],
)
def test_page_numbers(spark, raw, want):
    assert one(spark, text.remove_page_numbers, raw) == want


def test_repeated_lines(spark):
    h79, h80 = "h" * 79, "h" * 80
    raw = "\n".join(["top", " A ", "x", "A", h79, h80, "A", h79, h80, h79, h80, "twice", "twice", "", ""])
    assert one(spark, text.remove_repeated_lines, raw) == "\n".join(["top", "x", h80, h80, h80, "twice", "twice", "", ""])
    assert one(spark, text.remove_repeated_lines, "a\na\na", "a\nb") == ["", "a\nb"]
    assert one(spark, text.removed_line_count, raw) == 6


def test_repeated_lines_against_counting(spark):
    rng = random.Random(1)
    values = ["\n".join(rng.choice(["a", " a", "b", "", "c "]) for _ in range(rng.randint(0, 12))) for _ in range(60)]

    def plain(v):
        lines = v.split("\n")
        n = [sum(x.strip() == y.strip() for y in lines) for x in lines]
        return "\n".join(x for x, k in zip(lines, n, strict=True) if not (x.strip() and k >= 3))

    assert one(spark, text.remove_repeated_lines, *values) == [plain(v) for v in values]


def test_whitespace_and_clean(spark):
    assert one(spark, text.normalize_whitespace, "a  \t b\n\n\n\n\n\nc") == "a b\n\n\nc"
    assert one(spark, text.clean_extracted, "\x00 a \r\n b\r\r\r\r\r c \n ") == "a\nb\n\n\nc"
    assert one(spark, text.clean_extracted, "", None) == ["", None]


def test_truncate(spark):
    at = lambda n: "x" * n
    assert one(spark, lambda c: text.smart_truncate(c, 100), at(71) + "\n\n" + at(100), at(70) + "\n\n" + at(100), at(81) + ". " + at(99), at(80) + ". " + at(99), at(100)) == [
        at(71),
        at(70) + "\n\n" + at(28),
        at(81) + ".",
        at(80) + ". " + at(18),
        at(100),
    ]


def test_preprocess(spark):
    assert one(spark, text.preprocess, "", "  　", None, " a\n\nb ") == ["", "", "", "a\n\nb"]
    assert len(one(spark, text.preprocess, "A sentence here. " * 12_000)) <= text.MAX_INPUT


def test_chunks(spark):
    assert text.chunks("x" * 10, 1000, 100) == ["x" * 10] and text.chunks(None, 10, 1) == []
    long = "A" * 1000 + "\n\n" + "B" * 1000 + "\n\n" + "C" * 1000
    got = text.chunks(long, 1200, 200)
    assert got[0] == "A" * 1000 and all(len(c) <= 1200 for c in got) and len(got) >= 3
    assert len(text.chunks("y" * 1010, 1000, 10)) == 1  # a rest under 100 is dropped
    with pytest.raises(ValueError):
        text.chunk_documents(spark.range(1).withColumn("t", F.lit("")), "id", "t", 100, 50)
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "k long, t string")
    rows = text.chunk_documents(df, "k", "t", 1200, 200).orderBy("k", "chunk_no").collect()
    assert [r.chunk for r in rows if r.k == 1] == got and [(r.chunk_no, r.chunk) for r in rows if r.k == 3] == [(0, "")]


def test_legacy_letters(spark):
    assert len(text.LEGACY) == len(text.UNICODE) == 76 == len(set(text.LEGACY))
    plain = "Câu hỏi về trường đâu"
    legacy = plain.translate(str.maketrans(text.UNICODE[:74], text.LEGACY[:74]))
    assert one(spark, text.from_legacy, legacy, "plain µ") == [plain, "plain µ"]
    assert one(spark, text.is_legacy, legacy, plain) == [True, False]


def test_validity_and_tokens(spark):
    got = one(spark, text.validity, "x" * 100, " " + "x" * 99, " ", None)
    assert [tuple(r) for r in got] == [(True, ""), (False, "too_short"), (False, "no_text"), (False, "no_text")]
    assert one(spark, text.estimate_tokens, "x" * 11, "", "x" * 40_000) == [2, 0, 10_000]


def test_rounding_and_time(spark):
    df = spark.range(1).select(
        strings.round2(strings.percentage(F.lit(1), F.lit(32))).alias("tie"),
        strings.percentage(F.lit(0), F.lit(0)).alias("none"),
        strings.iso_timestamp(F.lit("2024-01-02 03:04:05").cast("timestamp")).alias("whole"),
        strings.iso_timestamp(F.lit("2024-01-02 03:04:05.06").cast("timestamp")).alias("part"),
        strings.iso_timestamp(F.lit(None).cast("timestamp")).alias("missing"),
    )
    assert tuple(df.first()) == (3.12, 0.0, "2024-01-02T03:04:05", "2024-01-02T03:04:05.060000", "")


def test_keys(spark):
    assert one(spark, strings.parser_key, " What   IS\tit? ") == "what is it?"
    assert one(spark, strings.generated_key, " What, is it?! ", "a  b") == ["what is it", "a  b"]
    assert one(spark, strings.is_id, "0123456789abcdefABCDEF01", "0123", None) == [True, False, False]
