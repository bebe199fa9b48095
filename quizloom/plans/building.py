"""From documents to quizzes: questions found in the text, or generated where there are none.

What was found is written once, and replies are asked for once (``log`` keeps them from run to run), so
that all outputs agree and none parses or calls again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizloom.operators import questions
from quizloom.sources import provider
from quizloom.sources.replies import ReplyLog, log_for
from quizloom.sources.shared import written


def extract_or_generate(docs: DataFrame, key: str = "doc_id", text: str = "text", ask: provider.Provider = provider.offline, log: ReplyLog | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(questions, failures): the questions a document holds, without repeats; for a document in which
    none are found, those of a generated quiz, with ``answer_source`` generated.  Failures: (key, error)."""
    found = questions.deduplicate(questions.parse_questions(docs, key, text), key)
    found = written(found.select(key, "order", "chapter", "question_text", "options", "correct_answer", "answer_source"))
    lacking = docs.join(found.select(key).distinct(), key, "left_anti")
    made, failures = provider.generate(lacking, key, text, ask, mode="extract", log=log, **options)
    made = made.select(
        key, "order", F.lit(questions.NO_CHAPTER).alias("chapter"), "question_text", "options", "correct_answer", F.lit("generated").alias("answer_source")
    )
    return found.unionByName(made), failures


def solved(found: DataFrame, key: str = "doc_id", ask: provider.Provider = provider.offline, size: int = 30, **options) -> DataFrame:
    """Questions with an answer each: their own, else the provider's for their batch, else the default with a warning."""
    replies = provider.solve(found, key, ask, size, **options)
    lacking = questions.number_and_batch(found.where("correct_answer = ''"), [key], ["order"], size)
    merged = questions.merge_solved(lacking.select(key, "batch_no", "batch_index", "order"), replies, [key, "batch_no"]).select(key, "order", "letter")
    return questions.resolve_answers(found, merged, [key, "order"])


def upload_to_quizzes(docs: DataFrame, key: str = "doc_id", text: str = "text", title: str = "title", ask: provider.Provider = provider.offline, log: ReplyLog | None = None, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(quizzes, questions, statuses): one quiz per document and chapter, its questions numbered from 1,
    and (key, upload_status, error) of every document: failed where no question was found or made."""
    log = log_for(docs, log)
    found, failures = extract_or_generate(docs, key, text, ask, log, **options)
    answered = solved(found, key, ask, log=log, **options).join(docs.select(key, title), key)
    quizzes = questions.group_chapters(answered, key, title)
    each = quizzes.select(key, "quiz_no", F.posexplode("questions").alias("pos", "q"))
    each = each.select(key, "quiz_no", (F.col("pos") + 1).alias("order"), "q.question_text", "q.options", "q.correct_answer")
    statuses = docs.select(key).join(failures, key, "left").select(key, F.when(F.col("error").isNull(), "completed").otherwise("failed").alias("upload_status"), F.coalesce("error", F.lit("")).alias("error"))
    return quizzes.drop("questions"), each, statuses
