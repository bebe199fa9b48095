"""Grading of many submissions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizloom.functions.strings import percentage, round2


def last_answers(answers: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """One answer per (by, question_id): the one submitted last."""
    return answers.groupBy(*by, "question_id").agg(F.max_by("selected", position).alias("selected"))


def grade(questions: DataFrame, answers: DataFrame, by: list[str], position: str = "pos") -> DataFrame:
    """One row per (by, question): unanswered questions stay, answers to unknown questions don't count."""
    joined = questions.join(last_answers(answers, by, position), [*by, "question_id"], "left")
    right = F.coalesce(F.col("selected") == F.col("correct_answer"), F.lit(False))
    return joined.withColumn("is_correct", right).withColumn("explanation", F.coalesce("explanation", F.lit("")))


def tally(graded: DataFrame, by: list[str]) -> DataFrame:
    """Score, total, wrong and skipped counts, percentage (stored and rounded) and band."""
    right, chosen = F.col("is_correct"), F.coalesce(F.col("selected"), F.lit("")) != ""
    count = lambda c: F.count_if(c)
    sums = graded.groupBy(*by).agg(
        count(right).alias("score"),
        F.count(F.lit(1)).alias("total"),
        count(~right & chosen).alias("wrong"),
        count(~chosen).alias("skipped"),
    )
    stored = percentage(F.col("score"), F.col("total"))
    return sums.withColumns({"percentage": stored, "percentage_rounded": round2(stored), "band": band(stored)})


def band(percent: Column) -> Column:
    return F.when(percent >= 80, "excellent").when(percent >= 60, "good").when(percent >= 40, "fair").otherwise("poor")


def attempt_detail(attempts: DataFrame, quizzes: DataFrame, questions: DataFrame) -> DataFrame:
    """Attempts graded again on the questions as they are now, beside the stored score; the two can differ."""
    submitted = attempts.select("id", F.posexplode("answers").alias("pos", "a")).select("id", "pos", "a.question_id", "a.selected")
    asked = attempts.select("id", "quiz_id", F.col("score").alias("stored_score"), F.col("total").alias("stored_total"))
    asked = asked.join(quizzes.select(F.col("id").alias("quiz_id"), "title"), "quiz_id")
    current = questions.select("quiz_id", F.col("id").alias("question_id"), "order", "question_text", "options", "correct_answer", "explanation")
    rows = grade(asked.join(current, "quiz_id"), submitted, ["id"])
    return rows.withColumn("choice_text", option_text(F.col("options"), F.col("selected"))).withColumn("right_text", option_text(F.col("options"), F.col("correct_answer")))


def option_text(options: Column, letter: Column) -> Column:
    """The text of the option with a letter, null if there is none."""
    return F.try_element_at(F.filter(options, lambda o: o["key"] == letter), F.lit(1))["text"]


def unanswered(questions: DataFrame, answers: DataFrame, by: list[str]) -> DataFrame:
    graded = grade(questions, answers, by)
    return graded.groupBy(*by).agg(F.count("selected").alias("answered"), F.count_if(F.col("selected").isNull()).alias("unanswered"))
