"""BPE encoding and decoding.

Encoding keeps a priority queue of merge ranks over a doubly linked list of symbols
and skips queue entries that earlier merges made stale; decoding concatenates the
vocabulary's strings.  Rows stay where they are: there is no shuffle.

Defined results: a null text is encoded like an empty one (no ids) and null ids decode
to the empty string; special strings inside a text become their own id, as the
library's default has it; bytes that aren't UTF-8 decode to U+FFFD; an id outside the
vocabulary raises; further columns pass through, and an output name that the input
already has is refused.  Rows are independent: ties, repeated rows and empty tables
need no rule, and long texts are merged piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytebpe import broadcast_file, default_path, loaded
from .common import rows_a_batch
from .tokens import _refuse


def encode(df: DataFrame, text: str = "text", out: str = "ids", tokenizer_path: str | None = None) -> DataFrame:
    """Adds ``out``: array<int>, the token ids of the text."""
    _refuse(df, out)
    file = broadcast_file(df.sparkSession, tokenizer_path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                ids = [bpe.encode(x or "") for x in part.column(part.schema.get_field_index(text)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer_path: str | None = None) -> DataFrame:
    """Adds ``out``: string, the text that the ids stand for."""
    _refuse(df, out)
    file = broadcast_file(df.sparkSession, tokenizer_path or default_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [bpe.decode(x or ()) for x in part.column(part.schema.get_field_index(ids)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """Encodes each text and decodes the ids again, in one pass over the row:
    (key, n_tokens, ids_sha256 of the ids joined by commas, decoded_sha256)."""
    file = broadcast_file(df.sparkSession, tokenizer_path or default_path())
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(file.value)
        digits = [str(i) for i in range(max(bpe.strings) + 1)]
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for x in batch.column(1):
                ids = bpe.encode(x.as_py() or "")
                rows.append(
                    (
                        len(ids),
                        hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(),
                        hashlib.sha256(bpe.decode(ids).encode()).hexdigest(),
                    )
                )
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=schema.names
            )

    return rows_a_batch(df, 500).select(key, text).mapInArrow(run, schema)
