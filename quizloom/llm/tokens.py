"""Exact token counts at every prefix of a text.

A byte-level BPE encoding of a prefix is found by dynamic programming over the
pieces of the text: the last token of a prefix is the one vocabulary suffix that
can stand behind the last token of what precedes it.  The counts of all prefixes
answer "how many tokens are the first n characters" and "how much of the text fits
in a budget" without encoding anything again.

Defined results: a null or empty text has the single prefix count 0; special strings
inside a text count as the library's default takes them; texts of any length are
handled piece by piece; rows are independent, so ties, repeated rows and an empty
table need no rule; further columns of the input pass through untouched, and an
output name that the input already has is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import broadcast_file, default_path, loaded
from .common import rows_a_batch


def _refuse(df: DataFrame, *names: str) -> None:
    if clash := {c.lower() for c in df.columns} & {n.lower() for n in names}:
        raise ValueError(f"the input already has {sorted(clash)}")


def token_prefixes(df: DataFrame, text: str = "text", out: str = "prefix_tokens", tokenizer_path: str | None = None) -> DataFrame:
    """Adds ``out``: array<int>, whose entry i is the exact token count of the first i code points."""
    _refuse(df, out)
    file = broadcast_file(df.sparkSession, tokenizer_path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tables = [bpe.prefix_table(x or "").astype("i4") for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                offsets = np.cumsum([0, *map(len, tables)], dtype="i4")
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tables)))
                yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def tokens_at(prefixes: str | Column, n_chars: int | Column) -> Column:
    """Token count of the first n_chars code points (all of them, if there are fewer)."""
    p = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    n = F.lit(n_chars) if isinstance(n_chars, int) else n_chars
    return F.element_at(p, F.least(n + 1, F.size(p)).cast("int"))


def longest_within(prefixes: str | Column, budget: int | Column) -> Column:
    """Code points of the longest prefix whose encoding has at most ``budget`` tokens."""
    p = F.col(prefixes) if isinstance(prefixes, str) else prefixes
    b = F.lit(budget) if isinstance(budget, int) else budget
    return F.array_max(F.filter(F.transform(p, lambda n, i: F.when(n <= b, i)), lambda i: i.isNotNull()))


def truncate_to_budget(df: DataFrame, budget: int, text: str = "text", prefixes: str = "prefix_tokens") -> DataFrame:
    """The text cut to the longest prefix of at most ``budget`` tokens."""
    return df.withColumn(text, F.substring(F.col(text), F.lit(1), longest_within(prefixes, budget)))


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, n_chars_in_limit) per row, from the prefix
    counts inside the task, so that the arrays themselves need not travel.
    ``n_chars_in_limit`` is the length of the longest prefix of at most ``limit`` tokens."""
    file = broadcast_file(df.sparkSession, tokenizer_path or default_path())
    field = df.schema[key]
    schema = T.StructType(
        [
            T.StructField(key, field.dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
            T.StructField("n_chars_in_limit", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for batch in batches:
            sizes, counts, cuts = [], [], []
            for x in batch.column(1):
                s = x.as_py() or ""
                table = bpe.prefix_table(s)
                sizes.append(len(s.encode()))
                counts.append(n := int(table[-1]))
                cuts.append(len(s) if n <= limit else int(np.flatnonzero(table <= limit)[-1]))
            n = np.array(counts, "i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(n), pa.array(n > limit), pa.array(cuts, pa.int64())],
                names=schema.names,
            )

    return rows_a_batch(df, 500).select(key, text).mapInArrow(run, schema)
