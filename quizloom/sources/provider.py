"""Completions from outside, behind an interface, called once per row inside Arrow tasks.

A provider is a picklable callable (system prompt, text) -> JSON string.  The default is
deterministic and offline.  A completion is asked for again, with growing waits, only if it
isn't JSON or fails the given check.  A row whose provider raises, takes longer than the
timeout or still fails after the last attempt carries its error; the job goes on.  The thread of a call
that timed out can't be stopped, so such a call may still be made, and paid.

:func:`complete` calls whenever its result is read.  What follows it below asks through a
:class:`quizloom.sources.replies.ReplyLog` instead, which calls once and keeps the replies: pass one as
``log`` to have them kept from run to run.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor, TimeoutError

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Provider = Callable[[str, str], str]
ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 3, 2.0, 15.0
#: Seconds for a completion and for a tutor's reply; calls that a task has in flight.
TIMEOUT, TUTOR_TIMEOUT, IN_FLIGHT = 300.0, 30.0, 5


def offline(prompt: str, text: str) -> str:
    """A stand-in: metadata from the first line, or the first option for every question."""
    if prompt.startswith("metadata"):
        return json.dumps({"title": text.strip().split("\n", 1)[0][:80], "description": "", "subject": "", "chapter": "", "exam_type": "", "school": ""})
    if prompt.startswith("solve"):
        n = text.count("\n\n") + 1 if text else 0
        return json.dumps({"questions": [{"index": i + 1, "correct_answer": "A", "explanation": ""} for i in range(n)]})
    return json.dumps({"title": "", "questions": []})


def prompt_for(mode: str, language: Column, count: Column, difficulty: Column) -> Column:
    return F.format_string(f"{mode}: write %d multiple-choice questions, difficulty %s, language %s; reply in JSON", count.cast("int"), difficulty, language)


def _ask(provider: Provider, prompt: str, text: str, check: Callable[[dict], bool] | None, sleep: Callable[[float], None]) -> tuple[str | None, str | None]:
    wait, error = FIRST_WAIT, "no attempt"
    for attempt in range(ATTEMPTS):
        try:
            reply = provider(prompt, text)
        except Exception as e:  # one row's error, not the job's
            return None, f"provider_error: {type(e).__name__}"
        try:
            data = json.loads(reply)
            if check is None or check(data):
                return reply, None
            error = "bad_structure"
        except (TypeError, ValueError):
            error = "bad_json"
        if attempt + 1 < ATTEMPTS:
            sleep(wait)
            wait = min(LONGEST_WAIT, wait * 2)
    return None, error


def complete(
    df: DataFrame,
    prompt: str,
    text: str,
    provider: Provider = offline,
    check: Callable[[dict], bool] | None = None,
    sleep: Callable[[float], None] = time.sleep,
    timeout: float = TIMEOUT,
    in_flight: int = IN_FLIGHT,
    tasks: int | None = None,
) -> DataFrame:
    """Adds ``reply`` and ``reply_error``.  A task has at most ``in_flight`` calls running, so the job
    has at most that many times ``tasks``, if given, and else times the tasks that run at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = ThreadPoolExecutor(in_flight)
        try:
            for batch in batches:
                got: list[tuple[str | None, str | None]] = []
                pairs = list(zip(batch[prompt], batch[text], strict=True))
                for start in range(0, len(pairs), in_flight):
                    calls = [pool.submit(_ask, provider, p or "", t or "", check, sleep) for p, t in pairs[start : start + in_flight]]
                    until = time.monotonic() + timeout
                    for i, call in enumerate(calls):
                        try:
                            got.append(call.result(max(0.0, until - time.monotonic())))
                        except TimeoutError:  # its thread can't be stopped, so the next calls get new ones
                            got.append((None, "timeout"))
                    if any(not call.done() for call in calls):
                        pool.shutdown(wait=False, cancel_futures=True)
                        pool = ThreadPoolExecutor(in_flight)
                yield batch.assign(reply=[r for r, _ in got], reply_error=[e for _, e in got])
        finally:
            pool.shutdown(wait=False, cancel_futures=True)

    schema = T.StructType([*df.schema.fields, T.StructField("reply", T.StringType()), T.StructField("reply_error", T.StringType())])
    return (df.repartition(tasks) if tasks else df).mapInPandas(run, schema)


def answered(df: DataFrame, prompt: str, text: str, provider: Provider = offline, log=None, **options) -> DataFrame:
    """As :func:`complete`, but with replies from the log, which asks once for those that it lacks."""
    from quizloom.sources.replies import log_for

    return log_for(df, log).complete(df, prompt, text, provider, **options)


def metadata(docs: DataFrame, key: str, text: str, provider: Provider = offline, window: int = 3000, **options) -> DataFrame:
    """(key, title, description, ...) from the first ``window`` characters; a reply that fails gives blanks."""
    from quizloom import schemas

    asked = docs.select(key, F.substring(text, 1, window).alias("__text"), F.lit("metadata").alias("__prompt"))
    got = F.from_json("reply", schemas.METADATA_JSON)
    return answered(asked, "__prompt", "__text", provider, **options).select(key, *(F.coalesce(got[f.name], F.lit("")).alias(f.name) for f in schemas.METADATA_JSON))


def solve(questions: DataFrame, key: str, provider: Provider = offline, size: int = 30, **options) -> DataFrame:
    """(key, batch_no, pos, index, letter): one call per batch of questions that lack an answer; a failed batch has no rows."""
    from quizloom import schemas
    from quizloom.operators.questions import number_and_batch

    batched = number_and_batch(questions.where("correct_answer = ''"), [key], ["order"], size)
    shown = F.concat_ws("\n", "question_text", F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), o["text"])))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("batch_index", shown.alias("t")))), lambda x: x["t"]), "\n\n")
    batches = batched.groupBy(key, "batch_no").agg(text.alias("__text")).withColumn("__prompt", F.lit("solve"))
    got = F.from_json("reply", schemas.SOLVED_JSON)["questions"]
    rows = answered(batches, "__prompt", "__text", provider, **options).where("reply IS NOT NULL").select(key, "batch_no", F.posexplode(got).alias("pos", "r"))
    return rows.select(key, "batch_no", "pos", F.col("r.index").alias("index"), F.col("r.correct_answer").alias("letter"))


def generate(docs: DataFrame, key: str, text: str, provider: Provider = offline, mode: str = "generate", count: int = 10, difficulty: str = "medium", language: str = "vi", **options) -> tuple[DataFrame, DataFrame]:
    """(questions, failures) of one generated quiz per document: (key, order, question_text, options,
    correct_answer, explanation) of valid replies without repeated questions, and (key, error) of
    documents whose reply failed, isn't valid or has no questions."""
    from quizloom.operators import quiz_json

    asked = docs.select(key, text, prompt_for(mode, F.lit(language), F.lit(count), F.lit(difficulty)).alias("__prompt"))
    replies = answered(asked, "__prompt", text, provider, **options).select(key, "reply", "reply_error")
    code = F.when(F.col("reply_error").isNotNull(), F.col("reply_error")).otherwise(quiz_json.validate(F.col("reply"))["code"])
    judged = replies.select(key, code.alias("error"), quiz_json.parse(F.col("reply")).alias("quiz"))
    judged = judged.withColumn("error", F.when((F.col("error") == "") & (F.size("quiz.questions") == 0), "no_questions").otherwise(F.col("error")))
    return quiz_json.explode_questions(judged.where("error = ''"), key, "quiz"), judged.where("error <> ''").select(key, "error")


def tutor(comments: DataFrame, provider: Provider = offline, timeout: float = TUTOR_TIMEOUT, **options) -> DataFrame:
    """Comments with a reply to each question asked, null where the provider fails."""
    choices = F.array_join(F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), o["text"])), "\n")
    asked = comments.withColumn("__text", F.concat_ws("\n", "question_text", choices, "content")).withColumn("__prompt", F.lit("tutor"))
    return answered(asked, "__prompt", "__text", provider, timeout=timeout, **options).drop("__text", "__prompt", "reply_error")
