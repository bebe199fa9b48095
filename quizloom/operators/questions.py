"""Questions from free text, as one plan: lines, segments, questions.

A document's lines are classified; heads, answers and chapter headings start segments.  A
segment depends on nothing before it, so a window numbers the segments of a document and
one aggregate per segment folds its lines.  Everything is keyed by document: one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizloom.functions.strings import SPACE, blank_to_null, collapse, let, lines, parser_key, strip

W = f"[{SPACE}]"
# The patterns of the question format, case-insensitive.
_HEAD_PREFIX = rf"(?ius)\A{W}*(?:Câu|Question|Q){W}*(\p{{Nd}}{{1,4}}){W}*[.:)]?{W}*(.*)\z"
_HEAD_NUMBER = rf"(?us)\A{W}*(\p{{Nd}}{{1,4}}){W}*[.:)]{W}*(.*)\z"
_CHAPTER = rf"(?ius)\A{W}*(?:Chương|Bài|Phần){W}+(?:[0-9]+|[IVXLCDM]+|[A-Z])(?:{W}*[:.\-]{W}*|{W}+|\z).*\z"
_OPTION = rf"(?ius)\A{W}*(?:đáp{W}*án{W}*)?([A-D]){W}*[.):\-]{W}*(.+?)\z"
_MARKER = rf"(?iu)(?:\A|{W})(?:đáp{W}*án{W}*)?([A-D]){W}*[.):\-]{W}*"
# a line with two options has two of an option's marks
_TWO_MARKS = r"(?s)[.):\-].*[.):\-]"
_ANSWERS = (
    rf"(?iu)(?:Đáp{W}*án(?:{W}*đúng)?|ĐA){W}*[.:)\-]{W}*([A-D])",
    rf"(?iu)(?:Correct{W}*)?(?:Answer|Ans){W}*[.:)\-]{W}*([A-D])",
    rf"(?iu)(?:=>|→|>>){W}*([A-D])(?![\p{{L}}\p{{N}}_])",
)
_TICK = r"(?:[✓✔√☑]|\[x\]|\(x\))"
_MARKED = (
    rf"(?us)\A{W}*\*{{1,2}}([A-Da-d]){W}*[.):\-]{W}*(?:.+?)\*{{1,2}}{W}*\z",
    rf"(?us)\A{W}*_{{1,2}}([A-Da-d]){W}*[.):\-]{W}*(?:.+?)_{{1,2}}{W}*\z",
    rf"(?ius)\A{W}*{_TICK}{W}*([A-D]){W}*[.):\-]{W}*(?:.+?)\z",
    rf"(?ius)\A{W}*([A-D]){W}*[.):\-]{W}*{_TICK}{W}*(?:.+?)\z",
    rf"(?ius)\A{W}*đáp{W}*án{W}*([A-D]){W}*[.):\-]{W}*(?:.+?)\z",
)
# a marked option has one of these marks
_MARKS = r"(?iu)[*_✓✔√☑]|\[x\]|\(x\)|đáp"
_NUMBERING = rf"(?iu)\A{W}*(?:Câu|Question|Q)?{W}*\p{{Nd}}{{1,4}}{W}*[.:)]{W}*"
_MISSING_A = rf"(?ius)(?:\A|{W})(?:đáp{W}*án{W}*)?A{W}*[.):\-]?{W}+([A-ZĐ0-9].*)\z"
_KEY_HEADERS = (
    rf"{W}*(?:BẢNG{W}*)?ĐÁP{W}*ÁN{W}*",
    rf"{W}*ANSWER{W}*KEY{W}*",
    rf"{W}*Câu{W}*\|{W}*Đáp{W}*án{W}*",
    rf"{W}*Câu{W}*\|{W}*ĐA{W}*",
    rf"{W}*STT{W}*\|{W}*Đáp{W}*",
    rf"{W}*KEY{W}*:{W}*",
)
_KEY_PIPE = rf"(?iu)(\p{{Nd}}{{1,4}}){W}*\|{W}*([A-D])"
_KEY_COMPACT = rf"(?iu)(?:\A|[{SPACE},;])(\p{{Nd}}{{1,4}}){W}*[.\-:)]{W}*([A-D])(?=[{SPACE},;.$]|\z)"
NO_CHAPTER = "Tổng hợp"
CHAPTER_UNDER = 150

_NO_OPTIONS = "array<struct<key:string,text:string>>"


def _found(c: Column, patterns: tuple[str, ...]) -> Column:
    """Upper-case letter of the first pattern that matches, else null."""
    return F.upper(F.coalesce(*(blank_to_null(F.regexp_extract(c, p, 1)) for p in patterns)))


def inline_options(c: Column) -> Column:
    """Options of a line that holds two or more markers: the text between markers; empty texts go."""
    keys, texts = F.regexp_extract_all(c, F.lit(_MARKER), F.lit(1)), F.slice(F.split(c, _MARKER, -1), F.lit(2), F.lit(1 << 30))
    pairs = lambda keys: F.zip_with(keys, texts, lambda k, t: F.struct(F.upper(k).alias("key"), strip(t).alias("text")))
    none = F.array().cast(_NO_OPTIONS)
    found = let(keys, lambda keys: F.when(F.size(keys) >= 2, F.filter(pairs(keys), lambda o: o["text"] != "")).otherwise(none))
    return F.when(c.rlike(_TWO_MARKS), found).otherwise(F.when(c.isNotNull(), none))


def answer_key(text: Column, strict: bool = True) -> Column:
    """Pairs (number, letter) of an answer table.  Strict: a header counts only if it is the
    whole text, which leaves no pairs; otherwise a header line starts a table."""
    pair = lambda n, a: F.struct(n.cast("int").alias("number"), F.upper(a).alias("letter"))
    if strict:
        return F.array().cast("array<struct<number:int,letter:string>>")
    at = F.lit(None).cast("int")
    for header in reversed(_KEY_HEADERS):
        pattern = rf"(?iumd)^{header}$"
        at = F.when(text.rlike(pattern), F.regexp_instr(text, F.lit(pattern))).otherwise(at)
    table = F.when(at.isNotNull(), F.substring(text, at, F.length(text))).otherwise("")

    def pairs(p: str) -> Column:
        found = F.zip_with(F.regexp_extract_all(table, F.lit(p), F.lit(1)), F.regexp_extract_all(table, F.lit(p), F.lit(2)), pair)
        return F.filter(found, lambda x: x["number"].between(1, 9999))

    piped, compact = pairs(_KEY_PIPE), pairs(_KEY_COMPACT)
    enough = F.size(F.regexp_extract_all(table, F.lit(_KEY_COMPACT), F.lit(1))) >= 3
    return F.when(F.size(piped) > 0, piped).when(enough, compact).otherwise(F.array().cast("array<struct<number:int,letter:string>>"))


def _without(c: Column, mark: str) -> Column:
    """Without one or two emphasis marks at either end, and the white space that they leave."""
    marked = (F.substring(c, 1, 1) == mark) | (F.substring(c, -1, 1) == mark)
    m = rf"\{mark}{{1,2}}"
    return F.when(marked, strip(F.regexp_replace(c, rf"\A{m}|{m}\z", ""))).otherwise(c)


def _first_of(c: Column) -> Column:
    return F.upper(F.substring(c, 1, 1))


def _holds(c: Column, *parts: str) -> Column:
    found = F.contains(c, F.lit(parts[0]))
    for p in parts[1:]:
        found = found | F.contains(c, F.lit(p))
    return found


def option_of(line: Column) -> Column:
    """The line as an option (key, text), else null."""
    fits = _first_of(line).isin("A", "B", "C", "D", "Đ") & line.rlike(_OPTION)
    return F.when(fits, F.struct(F.upper(F.regexp_extract(line, _OPTION, 1)).alias("key"), strip(F.regexp_extract(line, _OPTION, 2)).alias("text")))


def classify_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, raw, line, kind, ...): non-blank lines with what they are.

    A pattern is tried only on lines that begin with a character, or hold a word, that it needs."""
    each = docs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "__line")).select(key, "pos", strip(F.col("__line")).alias("raw"))
    each = each.withColumn("line", _without(_without(F.col("raw"), "*"), "_")).where("line <> ''")
    c, first = F.col("line"), F.col("__first")
    each = each.withColumns({"__first": _first_of(c), "__upper": F.upper(c)})
    by_word = first.isin("C", "Q")
    digit = first.between("0", "9") | ((F.ascii(first) > 127) & first.rlike(r"\p{Nd}"))
    each = each.withColumn("__number", F.when(by_word, F.regexp_extract(c, _HEAD_PREFIX, 1)).when(digit, F.regexp_extract(c, _HEAD_NUMBER, 1)).otherwise(""))
    asks = _holds(F.col("__upper"), "ĐÁP", "ĐA", "ANS", "=>", "→", ">>")
    # a cast that fails costs more than all patterns
    value = F.when(F.col("__number") != "", F.col("__number").try_cast("int"))
    each = each.withColumns({"__value": value, "letter": F.when(asks, _found(c, _ANSWERS))})
    prefixed = by_word & (F.col("__number") != "")
    numbered = ~by_word & F.coalesce(F.col("__value").between(1, 999), F.lit(False))
    chapter = ~prefixed & ~numbered & first.isin("C", "B", "P") & (F.length(c) < CHAPTER_UNDER) & c.rlike(_CHAPTER) & ~c.rlike(_OPTION)
    kind = F.when(chapter, "chapter").when(F.col("letter").isNotNull(), "answer").when(prefixed | numbered, "head").otherwise("body")
    rest = F.when(prefixed, F.regexp_extract(c, _HEAD_PREFIX, 2)).when(numbered, F.regexp_extract(c, _HEAD_NUMBER, 2)).otherwise("")
    number = F.when(prefixed | numbered, F.col("__value")).otherwise(0)
    return each.select(key, "pos", "raw", "line", "letter", number.alias("number"), strip(rest).alias("head_text"), kind.alias("kind"))


def _steps(body: Column) -> Column:
    """A segment's lines as steps: a line that may hold options, if there is one, and the plain lines that follow it, which
    are put together at once: a question may go on for very many lines."""
    plain = lambda x: (F.size(x["inline"]) == 0) & x["option"].isNull()
    marks = F.filter(F.transform(body, lambda x, i: F.when(~plain(x), i)), lambda i: i.isNotNull())

    def step(marks: Column) -> Column:
        def one(m: Column, k: Column) -> Column:
            upto = F.coalesce(F.try_element_at(marks, (k + 1).cast("int")), F.size(body))
            tail = F.slice(body, m + 2, upto - m - 1)
            lines, raws = F.transform(tail, lambda x: x["line"]), F.transform(tail, lambda x: x["raw"])
            return F.struct(F.when(m >= 0, F.element_at(body, F.greatest(m, F.lit(0)) + 1)).alias("own"), F.array_join(lines, " ").alias("line"), raws.alias("raws"))

        return F.transform(F.concat(F.array(F.lit(-1)), marks), one)

    return let(marks, step)


def _fold(head: Column, number: Column, body: Column) -> Column:
    """Question text, options and raw option lines of a segment, step by step."""
    options = inline_options(head)
    start = F.struct(
        F.when(F.size(options) > 0, strip(F.element_at(F.split(head, _MARKER, -1), 1))).otherwise(head).alias("text"),
        options.alias("options"),
        F.when(F.size(options) > 0, F.array(head)).otherwise(F.array().cast("array<string>")).alias("raws"),
    )

    def more(s: Column, line: Column, raws: Column, use: Column) -> Column:
        """What goes on with the last option, or the question if it has none."""
        none = F.size(s["options"]) == 0
        last = F.try_element_at(s["options"], F.lit(-1))
        longer = F.concat(
            F.slice(s["options"], F.lit(1), F.greatest(F.size(s["options"]) - 1, F.lit(0))),
            F.array(F.struct(last["key"].alias("key"), F.concat(last["text"], F.lit(" "), line).alias("text"))),
        )
        return F.struct(
            F.when(use & none, F.when(s["text"] != "", F.concat(s["text"], F.lit(" "), line)).otherwise(line)).otherwise(s["text"]).alias("text"),
            F.when(use & ~none, longer).otherwise(s["options"]).alias("options"),
            F.when(use & ~none, F.concat(s["raws"], raws)).otherwise(s["raws"]).alias("raws"),
        )

    def line(s: Column, x: Column) -> Column:
        """A line by itself: options of its own, or one that goes on."""
        inline = (s["text"] != "") & (F.size(x["inline"]) > 0)
        own = ~inline & (number > 0) & x["option"].isNotNull()
        added = F.struct(
            s["text"].alias("text"),
            F.concat(s["options"], F.when(inline, x["inline"]).otherwise(F.array(x["option"]))).alias("options"),
            F.concat(s["raws"], F.array(x["raw"])).alias("raws"),
        )
        return F.when(inline | own, added).otherwise(more(s, x["line"], F.array(x["raw"]), number > 0))

    def step(s: Column, x: Column) -> Column:
        begun = F.when(x["own"].isNotNull(), line(s, x["own"])).otherwise(s)
        return let(begun, lambda t: more(t, x["line"], x["raws"], (F.size(x["raws"]) > 0) & (number > 0)))

    return F.aggregate(_steps(body), start, step)


def _finished(q: Column) -> Column:
    """struct(question_text, options, marked_answer) of a folded segment, null if it isn't a question."""
    read = F.struct(
        strip(collapse(F.regexp_replace(q["text"], _NUMBERING, ""))).alias("text"),
        F.transform(q["options"], lambda o: o["key"]).alias("keys"),
        q["options"].alias("options"),
        q["raws"].alias("raws"),
    )

    def distinct(x: Column) -> Column:
        options = F.filter(x["options"], lambda o, i: F.array_position(x["keys"], o["key"]) == i + 1)
        lost_a = F.when(F.element_at(x["keys"], 1) == "B", blank_to_null(strip(F.regexp_extract(x["text"], _MISSING_A, 1))))
        return let(F.struct(x["text"].alias("text"), options.alias("options"), lost_a.alias("lost_a"), x["raws"].alias("raws")), complete)

    def complete(x: Column) -> Column:
        lost = x["lost_a"].isNotNull()
        with_a = F.concat(F.array(F.struct(F.lit("A").alias("key"), x["lost_a"].alias("text"))), x["options"])
        marks = lambda r: F.when(r.rlike(_MARKS), _found(strip(r), _MARKED))
        marked = F.filter(F.transform(x["raws"], marks), lambda a: a.isNotNull())
        made = F.struct(
            F.when(lost, strip(F.regexp_replace(x["text"], _MISSING_A, ""))).otherwise(x["text"]).alias("question_text"),
            F.slice(F.when(lost, with_a).otherwise(x["options"]), 1, 4).alias("options"),
            F.try_element_at(marked, F.lit(1)).alias("marked_answer"),
        )
        return F.when(F.size(x["options"]) >= 2, made)

    fits = (q["text"] != "") & (F.size(q["options"]) >= 2)
    return F.when(fits, let(read, lambda x: F.when(F.length(x["text"]) >= 3, distinct(x))))


def parse_questions(docs: DataFrame, key: str = "doc_id", text: str = "text", strict_key: bool = True) -> DataFrame:
    """(key, order, number, chapter, question_text, options, correct_answer, answer_source).

    Answers come from the answer line that ends the question, else from an option marked in
    the text, else from an answer table; "" if there is none.
    """
    line = F.col("line")
    by_doc = Window.partitionBy(key).orderBy("pos")
    upto = by_doc.rowsBetween(Window.unboundedPreceding, 0)
    seg = F.sum((F.col("kind") != "body").cast("int")).over(upto)
    classified = classify_lines(docs, key, text).withColumns({"seg": seg})
    first = F.col("kind") != "body"
    segments = classified.groupBy(key, "seg").agg(
        F.max(F.when(first, F.struct("kind", "line", "letter", "number", "head_text"))).alias("head"),
        F.array_sort(
            F.collect_list(F.when(~first, F.struct("pos", "raw", "line", inline_options(line).alias("inline"), option_of(line).alias("option"))))
        ).alias("body"),
    )
    in_doc = Window.partitionBy(key).orderBy("seg")
    chapter = carried(segments, [key], ["seg"], F.when(F.col("head.kind") == "chapter", F.col("head.line")), NO_CHAPTER)
    after = F.lead(F.when(F.col("head.kind") == "answer", F.col("head.letter"))).over(in_doc)
    segments = segments.withColumns({"chapter": chapter, "inline_answer": after}).where(F.col("head.kind") == "head")
    # a generator computes its argument once; a projection would, for each mention of it
    folded = let(_fold(F.col("head.head_text"), F.col("head.number"), F.col("body")), _finished)
    valid = segments.select(key, "seg", "head.number", "chapter", "inline_answer", F.inline(F.filter(F.array(folded), lambda x: x.isNotNull())))
    if not strict_key:
        table = docs.select(F.col(key).alias("__key"), answer_key(F.col(text), strict=False).alias("table"))
        valid = valid.join(table, F.col(key) == F.col("__key"), "left").drop("__key")
        listed = F.try_element_at(F.filter("table", lambda p: p["number"] == F.col("number")), F.lit(-1))["letter"]
    else:
        listed = F.lit(None).cast("string")
    answer = F.coalesce("inline_answer", "marked_answer", listed, F.lit(""))
    source = F.when(F.col("inline_answer").isNotNull(), "inline").when(F.col("marked_answer").isNotNull(), "marked").when(listed.isNotNull(), "table").otherwise("none")
    return valid.select(
        key,
        F.col("seg").cast("int").alias("order"),
        "number",
        "chapter",
        "question_text",
        "options",
        answer.alias("correct_answer"),
        source.alias("answer_source"),
    )


def first_of_each(rows: DataFrame, norm: Column, order: str) -> DataFrame:
    """The first row, by ``order``, of all rows with equal normal forms; ``order`` tells rows apart.

    Normal forms are compared by their MD5, so a form that very many rows have is combined before it is shuffled, as
    16 bytes; texts move only to meet their winners."""
    least = rows.groupBy(F.unhex(F.md5(norm)).alias("__norm")).agg(F.min(order).alias(order))
    return rows.join(least.select(order), order, "left_semi")


def deduplicate(questions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first of a document's questions with equal texts."""
    nth = F.row_number().over(Window.partitionBy(key, "__norm").orderBy("order"))
    normed = questions.withColumn("__norm", F.md5(parser_key(F.col("question_text")))).withColumn("__nth", nth)
    return normed.where("__nth = 1").drop("__norm", "__nth")


def carried(rows: DataFrame, by: list[str], order: list[str], heading: Column, default) -> Column:
    """The last heading at or before each row of its group, the default before the first."""
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce(F.last(heading, ignorenulls=True).over(over), F.lit(default))


def first_seen(rows: DataFrame, by: list[str], label: str, order: str, *aggregates: Column) -> DataFrame:
    """(by, label, first_order, aggregates, nth): groups of a label, numbered in order of first appearance."""
    grouped = rows.groupBy(*by, label).agg(F.min(order).alias("first_order"), *aggregates)
    return grouped.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("first_order")))


def resolve_answers(questions: DataFrame, solved: DataFrame | None, on: list[str], default: str = "A") -> DataFrame:
    """Answers that are missing come from ``solved`` (on, letter), else the default with a warning."""
    if solved is None:
        solved = questions.select(*on).withColumn("letter", F.lit(None).cast("string")).limit(0)
    got = F.when(F.col("letter").isin("A", "B", "C", "D"), F.col("letter"))
    own = blank_to_null(F.col("correct_answer"))
    joined = questions.join(solved, on, "left")
    return joined.withColumns(
        {
            "answer_source": F.when(own.isNotNull(), F.col("answer_source")).when(got.isNotNull(), "solved").otherwise("default"),
            "correct_answer": F.coalesce(own, got, F.lit(default)),
            "warning": F.when(own.isNull() & got.isNull(), "no answer found; the default is marked").otherwise(""),
        }
    ).drop("letter")


def number_and_batch(questions: DataFrame, by: list[str], order: list[str], size: int = 30) -> DataFrame:
    """1-based ``order_no`` inside ``by``, ``batch_no`` from 0 and 1-based ``batch_index``."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return questions.withColumn("order_no", n).withColumn("batch_no", F.floor((F.col("order_no") - 1) / size).cast("int")).withColumn("batch_index", (F.col("order_no") - 1) % size + 1)


def merge_solved(batch: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Results (on, pos, index, letter) laid beside their questions (on, batch_index): by index,
    the last of several wins and strays go; a batch whose results all lack one goes by position."""
    whole = Window.partitionBy(*on)
    sized = batch.withColumn("__size", F.count(F.lit(1)).over(whole))
    sizes = sized.select(*on, "__size").distinct()
    lacking = F.sum(F.col("index").isNull().cast("int")).over(whole)
    placed = results.join(sizes, on).withColumn("batch_index", F.when(lacking == F.col("__size"), F.col("pos") + 1).otherwise(F.col("index"))).where("batch_index IS NOT NULL")
    last = placed.groupBy(*on, "batch_index").agg(F.max_by("letter", "pos").alias("letter"))
    return batch.join(last, [*on, "batch_index"], "left")


def group_chapters(questions: DataFrame, key: str, base_title: str, fallback_chapter: str | None = None) -> DataFrame:
    """One quiz per chapter, in order of first appearance: (key, quiz_no, chapter, title, questions)."""
    listed = F.array_sort(F.collect_list(F.struct("order", "question_text", "options", "correct_answer"))).alias("questions")
    grouped = first_seen(questions, [key], "chapter", "order", F.min(base_title).alias(base_title), listed)
    title = F.concat_ws(" - ", F.col(base_title), blank_to_null(F.col("chapter")))
    chapter = F.coalesce(blank_to_null(F.col("chapter")), F.lit(fallback_chapter))
    return grouped.select(key, F.col("nth").alias("quiz_no"), chapter.alias("chapter"), title.alias("title"), F.size("questions").alias("total_questions"), "questions")


def answer_statistics(questions: DataFrame, by: list[str]) -> DataFrame:
    """Counts by where answers came from, raw and distinct questions, and a sentence on them."""
    of = lambda *s: F.sum(F.col("answer_source").isin(*s).cast("int"))
    stats = questions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("raw"),
        F.count_distinct(parser_key(F.col("question_text"))).alias("distinct_questions"),
        of("inline", "marked", "table").alias("with_answer"),
        of("solved").alias("solved"),
        of("default", "none").alias("missing"),
    )
    parts = [F.concat(F.col("distinct_questions").cast("string"), F.lit(" questions")), F.concat(F.col("with_answer").cast("string"), F.lit(" answered in the text"))]
    parts += [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {w}"))) for c, w in (("solved", "solved"), ("missing", "without an answer"))]
    return stats.withColumn("description", F.concat_ws(", ", *parts))
