"""Explicit schemas of the six collections; ids are strings of 24 lower-case hex digits."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


OPTION = _struct(key=_S, text=_S)
ANSWER = _struct(question_id=_S, selected=_S)

DOCUMENTS = _struct(
    id=_S, original_filename=_S, file_type=_S, file_size_bytes=_L, extracted_text=_S, text_length=_I, upload_status=_S, user_id=_S, created_at=_TS
)
QUIZZES = _struct(
    id=_S, document_id=_S, user_id=_S, title=_S, description=_S, total_questions=_I, difficulty=_S, language=_S,
    subject=_S, chapter=_S, exam_type=_S, school=_S, is_public=_B, is_approved=_B, created_at=_TS,
)
QUESTIONS = _struct(id=_S, quiz_id=_S, question_text=_S, options=T.ArrayType(OPTION), correct_answer=_S, explanation=_S, order=_I)
ATTEMPTS = _struct(id=_S, quiz_id=_S, user_id=_S, answers=T.ArrayType(ANSWER), score=_I, total=_I, percentage=_D, completed_at=_TS)
COMMENTS = _struct(id=_S, question_id=_S, user_id=_S, guest_name=_S, content=_S, created_at=_TS)
USERS = _struct(id=_S, google_id=_S, email=_S, full_name=_S, picture=_S, created_at=_TS)
SUBMISSIONS = _struct(submission_id=_S, quiz_id=_S, pos=_I, question_id=_S, selected=_S)

COLLECTIONS = {"documents": DOCUMENTS, "quizzes": QUIZZES, "questions": QUESTIONS, "quiz_attempts": ATTEMPTS, "comments": COMMENTS, "users": USERS}

QUIZ_JSON = _struct(
    title=_S, description=_S, subject=_S, chapter=_S, exam_type=_S, school=_S,
    questions=T.ArrayType(_struct(question_text=_S, options=T.ArrayType(OPTION), correct_answer=_S, explanation=_S)),
)
SOLVED_JSON = _struct(questions=T.ArrayType(_struct(index=_I, correct_answer=_S, explanation=_S)))
METADATA_JSON = _struct(title=_S, description=_S, subject=_S, chapter=_S, exam_type=_S, school=_S)
