"""Queries against their SQL on documents that the small tables lack."""

import duckdb
from pyspark.sql import functions as F

from quizloom.plans import catalogue, stored  # noqa: F401 (adds its own queries)
from quizloom.sources import files


def differing(spark, folder, name, texts):
    """(only Spark's, only the SQL's) rows of a query over documents with these texts."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = catalogue.QUERIES[name](spark, str(folder))
    got = sorted(map(tuple, df.collect()), key=str)
    want = sorted(con.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.ORACLES[name]})").fetchall(), key=str)
    return [r for r in got if r not in want], [r for r in want if r not in got]


def test_text_preprocess_keeps_long_texts_whole(spark, tmp_path):
    long = "\n\n".join(f"Paragraph {i} of a  long text." for i in range(6000))
    assert len(long) > 150_000
    assert differing(spark, tmp_path, "text_preprocess", [long, "x" * 120_001, "a short one"]) == ([], [])


ODD = ["", "x", "", "\ufeff" + "a text that begins with a byte order mark " * 4, "\ufeffshort", "y" * 11_000_000, " \n ", "plain " * 30]


def test_upload_text_of_empty_marked_and_very_large_texts(spark, tmp_path):
    assert differing(spark, tmp_path, "upload_text", ODD) == ([], [])


def test_arrivals_of_empty_marked_and_very_large_texts(spark, tmp_path):
    assert differing(spark, tmp_path, "arrivals_stored", ODD) == ([], [])


def test_upload_docx_of_any_size(spark, tmp_path):
    assert differing(spark, tmp_path, "upload_docx", ["", "a\n\n <b> & c \nlast", "y" * 11_000_000, "x\n"]) == ([], [])


def test_each_file_is_made_and_read_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def content(text):
        made.add(1)
        return text.encode()

    names = ["a.txt", "b.docx", "c.bin", "d.pdf", "e.txt", "f.docx"]
    df = spark.createDataFrame([(n, "no zip") for n in names], "path string, text string").select("path", content("text").alias("content"))
    got = files.extract(df.withColumn("length", F.length("content").cast("long"))).select("path", "text").collect()
    assert sorted(r.path for r in got) == names and made.value == len(names)


def test_batches_of_files_are_small(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)

    @F.pandas_udf("long")
    def rows(path):
        return path.map(lambda _: len(path))

    df = spark.range(1000).coalesce(1).select(F.concat(F.col("id").cast("string"), F.lit(".docx")).alias("path"), F.lit(b"x").alias("content"), F.lit(1).cast("long").alias("length"))
    assert files.extract(df).count() == 1000
    assert df.select(rows("path").alias("n")).agg(F.max("n")).first()[0] <= 200
