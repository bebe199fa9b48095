"""Uploaded files to text: binary rows in, one row per file out with text or an error."""

from __future__ import annotations

import importlib.util
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom.functions.strings import strip
from quizloom.operators import dml, text
from quizloom.sources import encodings
from quizloom.sources.shared import rows_a_batch

TYPES = ("pdf", "docx", "txt")
MAX_MB = 10
ROWS_A_BATCH = 200
HAS_PDF = importlib.util.find_spec("fitz") is not None
# Fixed value: the namespace of word-processing documents.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_P, _ROW, _CELL = f"{_W}p", f"{_W}tbl/{_W}tr", f"{_W}tc"
# What is text in them: an element's own, or what it stands for.
_MARKS = {f"{_W}t": "", f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length, content); Spark's scan leaves empty files out."""
    return spark.read.format("binaryFile").load(path)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, lower-case; "" without a dot."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)\z", 1))


def gate(files: DataFrame, max_mb: int | None = MAX_MB) -> DataFrame:
    """Adds ``file_type`` and ``error``: unsupported_type, empty_file, too_large (never, if ``max_mb`` is None) or null."""
    n = F.col("length")
    error = F.when(~extension(F.col("path")).isin(*TYPES), "unsupported_type").when(n == 0, "empty_file")
    if max_mb is not None:
        error = error.when(n > max_mb * 1024 * 1024, "too_large")
    return files.withColumn("file_type", extension(F.col("path"))).withColumn("error", error)


def decode_text(content: Column) -> Column:
    """A byte order mark decides; else UTF-8 if valid, else Latin-1: every input has one result."""
    utf16 = F.when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), F.decode(content, "UTF-16"))
    bom = F.when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.decode(F.expr("substring(content, 4)"), "UTF-8"))
    valid = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(utf16, bom, F.when(valid, content.cast("string")), F.decode(content, "ISO-8859-1"))


def encode_text(c: Column, mark: Column | None = None) -> Column:
    """The bytes of a text file that reads back as this text: UTF-8, after a byte order mark where ``mark`` says so and
    where the text is empty (a file without bytes is refused) or begins with one (it would be taken for the file's)."""
    needed = (c == "") | c.startswith("\ufeff")
    marked = needed if mark is None else needed | mark
    return F.concat(F.when(marked, F.unhex(F.lit("EFBBBF"))).otherwise(F.unhex(F.lit(""))), F.encode(c, "UTF-8"))


def docx_text(data: bytes) -> str:
    """Paragraphs, then table rows with their cells joined by " | "."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(e: ElementTree.Element) -> str:
        return "".join([_MARKS[t.tag] or t.text or "" for t in e.iter() if t.tag in _MARKS])

    parts = [words(p).strip() for p in body.findall(_P)]
    for row in body.findall(_ROW):
        cells = ["\n".join(words(p) for p in c.findall(_P)).strip() for c in row.findall(_CELL)]
        parts.append(" | ".join(c for c in cells if c))
    return "\n".join(p for p in parts if p)


def pdf_text(data: bytes) -> str:
    """Texts of the pages that have any, a blank line between them; no recognition of images."""
    if not HAS_PDF:
        raise RuntimeError("no PDF library is installed")
    import fitz

    with fitz.open(stream=data, filetype="pdf") as doc:
        return "\n\n".join(t for p in doc if (t := p.get_text("text")).strip())


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def _binary_text(content: pd.Series, kind: pd.Series) -> pd.DataFrame:
    rows: list[tuple[str | None, str | None]] = []
    for data, k in zip(content, kind, strict=True):
        if data is None:  # refused already
            rows.append((None, None))
            continue
        try:
            rows.append(({"docx": docx_text, "pdf": pdf_text}[k](data), None))
        except Exception as e:  # a broken file is a row with an error, not a broken job
            rows.append((None, f"extraction_failed: {e}"))
    return pd.DataFrame(rows, columns=["text", "error"])


def extract(files: DataFrame, max_mb: int | None = MAX_MB, pairs: dict[str, float] | None = None) -> DataFrame:
    """(path, file_type, length, text, is_valid, error, status) per file.  Text files stay in
    the JVM; only the zipped and paged formats go through Arrow.  With ``pairs``, as
    :func:`quizloom.sources.encodings.fit` gives them, the encoding of text files is detected, in Arrow tasks too."""
    # the two parts are told by name, so that each file's content is made and read in one of them only
    gated = gate(rows_a_batch(files, ROWS_A_BATCH), max_mb)
    zipped = F.col("file_type").isin("docx", "pdf")
    content = F.when(F.col("error").isNull(), F.col("content"))
    read = decode_text(content) if pairs is None else encodings.detected(content, pairs)["text"]
    plain = gated.where(~zipped).select("path", "file_type", "length", read.alias("raw"), "error")
    other = gated.where(zipped).withColumn("x", _binary_text(content, "file_type")).select("path", "file_type", "length", F.col("x.text").alias("raw"), F.coalesce("error", "x.error").alias("error"))
    cleaned = plain.unionByName(other).withColumn("text", text.clean_extracted(text.from_legacy(F.col("raw"))))
    valid = text.validity(F.col("text"))
    error = F.coalesce("error", F.when(~valid["is_valid"], valid["reason"]))
    out = cleaned.withColumn("is_valid", F.col("error").isNull() & valid["is_valid"]).withColumn("error", error)
    return out.withColumn("status", dml.status_of(F.col("error"))).drop("raw")


def title_from(filename: Column, title: Column) -> Column:
    return F.coalesce(F.when(strip(title) != "", title), F.concat(F.lit("extracted from "), filename))


def discover(spark: SparkSession) -> DataFrame:
    """(database, table) of the catalog."""
    rows = [(d.name, t.name) for d in spark.catalog.listDatabases() for t in spark.catalog.listTables(d.name)]
    return spark.createDataFrame(rows, "database string, table string")
