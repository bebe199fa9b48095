import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizloom.llm import bpe, tokens
from quizloom.llm.bytebpe import ByteBpe, Wide, default_path, pieces

LIBRARY = Tokenizer.from_file(default_path())
OWN = ByteBpe(open(default_path(), encoding="utf-8").read())
PARTS = ["a", "b", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "é", "日本", "1", "23", "!!", "<|endoftext|>", "<|", "　", "\xa0", "\x1c", "😀", "the", "ing", "-" * 9, "՘"]


def library_ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_every_prefix_counts_as_the_library_counts_it(text):
    table = OWN.prefix_table(text)
    assert table.tolist() == [len(library_ids(text[:i])) for i in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_ids_and_round_trip(text):
    ids = OWN.encode(text)
    assert ids == library_ids(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_letters_newer_than_the_library_are_split_as_it_splits_them():
    for c in "՘࢏\U000323b0":
        text = f"a{c}1{c}{c}b"
        assert pieces(text) == [text[i:j] for _, (i, j) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]


def test_wide_changes_take_the_other_path(monkeypatch):
    own = ByteBpe(open(default_path(), encoding="utf-8").read())
    expected = own.prefix_table("the naïve they're")

    def wide(piece):
        raise Wide

    own.deltas.clear()
    own.deltas.make = wide
    assert np.array_equal(own.prefix_table("the naïve they're"), expected)


def test_long_piece():
    text = "ab" * 20_000
    assert OWN.prefix_table(text)[-1] == len(library_ids(text)) == len(OWN.encode(text))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the cat's <|endoftext|> out", "x"), (2, None, None), (3, "", "y"), (None, "word " * 1500, "z"), (1, "the cat's <|endoftext|> out", "x"), (4, "x" * 50_000, "q")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")


def test_token_counts(spark, docs):
    got = sorted(tokens.token_counts(docs).collect(), key=str)
    want = sorted(
        ((r.doc_id, len((r.text or "").encode()), len(library_ids(r.text or "")), len(library_ids(r.text or "")) > 1024) for r in docs.collect()), key=lambda r: str(r[0])
    )
    assert sorted(map(str, (tuple(r)[:4] for r in got))) == sorted(map(str, want))
    cut = next(r for r in got if r.doc_id is None).n_chars_in_limit
    assert len(library_ids(("word " * 1500)[:cut])) <= 1024 < len(library_ids(("word " * 1500)[: cut + 5]))


def test_prefix_questions(spark):
    df = tokens.token_prefixes(spark.createDataFrame([(1, "one two three four"), (2, None)], "doc_id long, text string"))
    row, none = df.select("doc_id", tokens.tokens_at("prefix_tokens", 7).alias("at7"), tokens.longest_within("prefix_tokens", 2).alias("within")).orderBy("doc_id").collect()
    assert (row.at7, row.within) == (len(library_ids("one two")), 7)
    assert (none.at7, none.within) == (0, 0)
    assert tokens.truncate_to_budget(df, 2).where("doc_id = 1").first().text == "one two"
    with pytest.raises(ValueError):
        tokens.token_prefixes(df)


def test_round_trip_query(spark, docs):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted(str((r.doc_id, len(i := library_ids(r.text or "")), digest(",".join(map(str, i))), digest(r.text or ""))) for r in docs.collect())
    assert sorted(str(tuple(r)) for r in bpe.round_trip(docs).collect()) == want


def test_encode_decode_columns_and_empty_table(spark, docs):
    both = bpe.decode(bpe.encode(docs))
    assert both.where("decoded <> coalesce(text, '')").isEmpty()
    assert both.columns == [*docs.columns, "ids", "decoded"]
    empty = docs.limit(0)
    assert bpe.round_trip(empty).isEmpty() and tokens.token_counts(empty).isEmpty() and bpe.encode(empty).isEmpty()
    assert bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded == ""
    assert both.select(F.count_if(F.size("ids") == 0).alias("n")).first().n == 2
