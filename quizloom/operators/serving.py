"""Browsing: filters, pages, joins and projections over the collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.strings import is_id, iso_timestamp, round2

DELETED_TITLE = "(deleted quiz)"
GUEST = "Guest"


def published(quizzes: DataFrame) -> DataFrame:
    return quizzes.where(F.col("is_public") & F.col("is_approved"))


def owned(df: DataFrame, user_id: str) -> DataFrame:
    """The rows of one user, whose id is kept as a string."""
    return df.where(F.col("user_id") == user_id)


def user_row(users: DataFrame) -> DataFrame:
    """Users as shown to themselves: what isn't selected can't leak."""
    return users.select("id", "email", "full_name", "picture")


def matching(df: DataFrame, **patterns: str | None) -> DataFrame:
    """Rows whose columns match the given regular expressions anywhere, in any case; null and "" don't filter."""
    for column, pattern in patterns.items():
        if pattern:
            df = df.where(F.col(column).rlike(f"(?iu){pattern}"))
    return df


def filter_values(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value): each column's distinct values without null and "", in one pass over the columns."""
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns)))
    return df.select(pairs).where("value <> ''").distinct()


def filter_options(df: DataFrame, *columns: str) -> DataFrame:
    """One row: each column's distinct values, ascending.  Only distinct values are gathered, and a form
    shows them all; :func:`filter_values` has them as rows."""
    found = filter_values(df, *columns)
    return found.agg(*(F.array_sort(F.collect_list(F.when(F.col("column") == c, F.col("value")))).alias(c) for c in columns))


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of ``size`` (1 to 50) rows; the order should end in a key, so that ties don't move."""
    if number < 1 or not 1 <= size <= 50:
        raise ValueError("pages count from 1 and hold 1 to 50 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int, by: list[str] | None = None) -> DataFrame:
    """(total, pages) of what a page is cut from."""
    total = df.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumn("pages", F.ceil(F.col("total") / size))


def quiz_summary(quizzes: DataFrame, own: bool = False) -> DataFrame:
    columns = ["id", "title", F.coalesce("description", F.lit("")).alias("description"), "total_questions", "difficulty", "subject", "chapter", "exam_type", "school"]
    if own:
        columns += [F.coalesce(c, F.lit(False)).alias(c) for c in ("is_public", "is_approved")]
    return quizzes.select(*columns, iso_timestamp(F.col("created_at")).alias("created_at"))


def hidden_answers(questions: DataFrame) -> DataFrame:
    """Questions as shown before they are answered: what isn't selected can't leak."""
    return questions.select("id", "question_text", "options", "order")


def quiz_detail(quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Each quiz with its questions in order, answers hidden."""
    shown = questions.groupBy("quiz_id").agg(F.array_sort(F.collect_list(F.struct("order", "id", "question_text", "options"))).alias("questions"))
    return quizzes.join(shown, quizzes["id"] == shown["quiz_id"]).drop("quiz_id")


def history(attempts: DataFrame, quizzes: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of attempts, newest first, then joined with titles: the page first, so that the
    join sees ``size`` rows; a quiz that is gone has a fixed title."""
    rows = page(attempts, [F.desc("completed_at"), F.asc("id")], number, size)
    titles = quizzes.select(F.col("id").alias("quiz_id"), "title")
    joined = rows.join(titles, "quiz_id", "left")
    return joined.select(
        "id",
        "quiz_id",
        F.coalesce("title", F.lit(DELETED_TITLE)).alias("quiz_title"),
        "score",
        "total",
        round2(F.coalesce("percentage", F.lit(0.0))).alias("percentage"),
        iso_timestamp(F.col("completed_at")).alias("completed_at"),
    )


def with_author(comments: DataFrame, users: DataFrame) -> DataFrame:
    """The author's name: the user's, else the guest's, else a fixed one."""
    names = users.select(F.col("id").alias("user_id"), "full_name")
    return comments.join(names, "user_id", "left").withColumn("author", F.coalesce("full_name", "guest_name", F.lit(GUEST))).drop("full_name")


def thread(comments: DataFrame, question: str = "question_id", time: str = "created_at", tie: str = "id") -> DataFrame:
    """Comments numbered by time under each question."""
    return comments.withColumn("position", F.row_number().over(Window.partitionBy(question).orderBy(time, tie)))


def guarded_ids(df: DataFrame, column: str) -> DataFrame:
    """(valid, invalid) told apart by ``id_status``: "" or invalid_id."""
    return df.withColumn("id_status", F.when(is_id(F.col(column)), "").otherwise("invalid_id"))


def quiz_status(requests: DataFrame, quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Requests (quiz_id) with not_found, no_questions or "" as ``status``."""
    known = quizzes.select(F.col("id").alias("quiz_id"), F.lit(True).alias("known")).distinct()
    filled = questions.select("quiz_id", F.lit(True).alias("filled")).distinct()
    joined = requests.join(known, "quiz_id", "left").join(filled, "quiz_id", "left")
    return joined.withColumn("status", F.when(F.col("known").isNull(), "not_found").when(F.col("filled").isNull(), "no_questions").otherwise("")).drop("known", "filled")


def documents_of(quizzes: DataFrame, documents: DataFrame) -> DataFrame:
    """Quizzes with their document's text, or the reason why there is none."""
    texts = documents.select(F.col("id").alias("document_id"), "extracted_text", F.lit(True).alias("found"))
    joined = quizzes.join(texts, "document_id", "left")
    reason = (
        F.when(F.col("document_id").isNull() | (F.col("document_id") == ""), "no_document_id")
        .when(F.col("found").isNull(), "document_not_found")
        .when(F.coalesce(F.col("extracted_text"), F.lit("")) == "", "empty_text")
        .otherwise("")
    )
    return joined.withColumn("skip_reason", reason).drop("found")


def lacking_metadata(quizzes: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return quizzes.where(blank("subject") | blank("chapter") | blank("exam_type") | blank("school"))


def lookup(df: DataFrame, **equal) -> DataFrame:
    """The one row whose columns have the given values; equality reaches the scan's statistics."""
    for column, value in equal.items():
        df = df.where(F.col(column) == F.lit(value))
    return df.limit(1)


def check_requests(requests: DataFrame) -> DataFrame:
    """Requests (selected, content, page, size) with the first rule they break as ``request_error``, "" if none."""
    error = (
        F.when(~F.coalesce(F.col("selected").rlike(r"\A[A-D]\z"), F.lit(False)), "selected")
        .when(F.coalesce(F.col("content"), F.lit("")) == "", "content")
        .when(~F.coalesce(F.col("page") >= 1, F.lit(False)), "page")
        .when(~F.coalesce(F.col("size").between(1, 50), F.lit(False)), "size")
        .otherwise("")
    )
    return requests.withColumn("request_error", error)


def count_by_encoding(questions: DataFrame, quizzes: DataFrame, encodings: dict[str, Column]) -> DataFrame:
    """Per quiz, how many questions refer to it under each encoding of its id."""
    kinds = quizzes.select("id", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("ref")) for k, c in encodings.items()))))
    sums = questions.groupBy("quiz_id").agg(F.count(F.lit(1)).alias("n"))
    joined = kinds.join(sums, kinds["ref"] == sums["quiz_id"], "left")
    return joined.groupBy("id").agg(*(F.sum(F.when(F.col("kind") == k, F.coalesce("n", F.lit(0))).otherwise(0)).alias(k) for k in encodings))
