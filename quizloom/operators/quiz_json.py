"""Generated quizzes: fences off, parsed, validated, deduplicated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quizloom import schemas
from quizloom.functions.strings import generated_key, is_blank, let, strip

LETTERS = ("A", "B", "C", "D")


def unfence(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, r"```json\s*", ""), r"\s*```", ""))


def parse(c: Column, schema: T.StructType = schemas.QUIZ_JSON) -> Column:
    """The JSON as a struct; null where it is none (a bare from_json would give a struct of nulls)."""
    return let(unfence(c), lambda text: F.when(F.try_parse_json(text).isNotNull(), F.from_json(text, schema)))


def _check(q: Column, i: Column) -> Column:
    """struct(question_no, code) of one question's JSON; a null code if it is sound."""
    options_type = "array<struct<key:string,text:string>>"
    parsed = F.struct(F.json_object_keys(q).alias("fields"), F.from_json(q, f"struct<options:{options_type},correct_answer:string>").alias("body"))

    def code(x: Column) -> Column:
        options = F.coalesce(x["body"]["options"], F.array().cast(options_type))
        missing = F.array_except(F.array(*map(F.lit, ("question_text", "options", "correct_answer"))), x["fields"])
        return (
            F.when(x["fields"].isNull() | (F.size(missing) > 0), "missing_fields")
            .when(F.size(options) != 4, "option_count")
            .when(F.array_sort(F.array_distinct(F.transform(options, lambda o: o["key"]))) != F.array(*map(F.lit, LETTERS)), "option_keys")
            .when(~F.coalesce(x["body"]["correct_answer"].isin(*LETTERS), F.lit(False)), "answer")
            .when(F.exists(options, lambda o: is_blank(o["text"])), "empty_text")
        )

    return F.struct((i + 1).cast("int").alias("question_no"), let(parsed, code).alias("code"))


def validate(c: Column) -> Column:
    """struct(question_no, code): the first failure in question order, then in the order of the
    checks; (0, "") for a valid quiz.  Codes: bad_json, no_questions, not_a_list,
    missing_fields, option_count, option_keys, answer, empty_text."""
    whole = lambda code: F.struct(F.lit(0).alias("question_no"), F.lit(code).alias("code"))
    read = lambda text: F.struct(F.try_parse_json(text).isNotNull().alias("is_json"), F.get_json_object(text, "$.questions").alias("listed"))
    first = lambda questions: F.try_element_at(F.filter(F.transform(questions, _check), lambda f: f["code"].isNotNull()), F.lit(1))

    def judge(x: Column) -> Column:
        return (
            F.when(~x["is_json"], whole("bad_json"))
            .when(x["listed"].isNull(), whole("no_questions"))
            .when(~F.startswith(x["listed"], F.lit("[")), whole("not_a_list"))
            .otherwise(let(F.from_json(x["listed"], "array<string>"), lambda qs: F.when(qs.isNull(), whole("not_a_list")).otherwise(F.coalesce(first(qs), whole("")))))
        )

    return let(unfence(c), lambda text: let(read(text), judge))


def unique_questions(quiz: Column) -> Column:
    """The questions without those whose text repeats an earlier one's, by the generated key."""
    keys = F.transform(quiz["questions"], lambda q: generated_key(q["question_text"]))
    return F.filter(quiz["questions"], lambda q, i: F.array_position(keys, F.element_at(keys, i + 1)) == i + 1)


def count_check(requested: Column, made: Column) -> Column:
    """"" if a generated quiz has as many questions as asked for, else what is wrong."""
    return F.when(made == 0, "no_questions").when(made != requested, "count_differs").otherwise("")


def explode_questions(quizzes: DataFrame, key: str, quiz: str) -> DataFrame:
    each = quizzes.select(key, F.posexplode(unique_questions(F.col(quiz))).alias("pos", "q"))
    return each.select(key, (F.col("pos") + 1).alias("order"), "q.*")
