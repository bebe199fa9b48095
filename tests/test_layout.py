import datetime

import pytest
from pyspark.sql import functions as F

from quizloom.operators import layout


@pytest.fixture(scope="module")
def copy(spark, tmp_path_factory):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, day + datetime.timedelta(minutes=(i * 37) % 400), f"n{i}") for i in range(1000)] + [(2000 + i, None, "late") for i in range(5)]
    made = layout.OrderedFiles(spark, str(tmp_path_factory.mktemp("ordered")), "at", "id")
    made.write(spark.createDataFrame(rows, "id long, at timestamp, name string"), rows_a_file=100)
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or day).timestamp(), r[0]))
    return made, order


def ids(df):
    return [r.id for r in df.collect()]


@pytest.mark.parametrize("number", [1, 2, 17, 50, 51, 60])
def test_a_page_reads_the_files_that_hold_it(copy, number):
    made, order = copy
    page = made.page(number, 20)
    assert ids(page) == [r[0] for r in order[(number - 1) * 20 : number * 20]]
    assert len(page.inputFiles()) <= 2 and made.total() == len(order)


@pytest.mark.parametrize("at", [0, 19, 499, 989, 998, 1000, 1004])
def test_a_cursor_reads_few_files(copy, at):
    made, order = copy
    page = made.after((order[at][1], order[at][0]), 20)
    assert ids(page) == [r[0] for r in order[at + 1 : at + 21]]
    assert len(page.inputFiles()) <= 4


def test_a_cursor_whose_row_is_gone_and_many_ties(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    made = layout.OrderedFiles(spark, str(tmp_path / "ties"), "at", "id")
    made.write(spark.createDataFrame([(i, at) for i in range(0, 600, 2)], "id long, at timestamp"), rows_a_file=50)
    assert ids(made.after((at, 401), 10)) == list(range(402, 422, 2))
    assert ids(made.after((at, 598), 10)) == [] and ids(made.after((at + datetime.timedelta(1), 0), 3)) == [0, 2, 4]


def scanned(df):
    """Rows that the scan of a query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_a_lookup_reads_one_row_group(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 3).alias("id"), F.md5(F.col("id").cast("string")).alias("name"))
    layout.write_keyed(rows, str(tmp_path / "k"), "id", ("name",), rows_a_group=1000, files=2)
    copy = spark.read.parquet(str(tmp_path / "k"))
    for where in (F.col("id") == 30_000, F.col("name") == F.md5(F.lit("777"))):
        found = copy.where(where)
        assert found.count() == 1 and scanned(copy.where(where)) <= 2000
    assert scanned(copy.where("id = 30001")) <= 1000 and scanned(copy.where("name = 'none'")) <= 1000
