"""String expressions with the semantics that the rest of the library relies on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode strip() and \s of the text rules mean it; Java's \s
# and (?U)\s are both different sets, so the class is spelled out.
SPACE = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACE_NO_LF = r"\x09\x0B-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
#: The same characters one by one.
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def _runs(space: str) -> str:
    """Runs of white space that aren't one plain space already, so that most spaces of a text are no match."""
    return rf"[{space.replace('x20', 'x1F')}][{space}]*|\x20[{space}]+"


def collapse(c: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(c, _runs(SPACE), " ")


def collapse_in_lines(c: Column) -> Column:
    """Runs of white space other than line feeds as one space."""
    return F.regexp_replace(c, _runs(SPACE_NO_LF), " ")


def rfind(c: Column, needle: str) -> Column:
    """0-based start of the last occurrence, -1 if there is none."""
    at = F.locate(needle[::-1], F.reverse(c))
    return F.when(at > 0, F.length(c) - at + 1 - len(needle)).otherwise(-1)


def lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def parser_key(c: Column) -> Column:
    """Dedup key of parsed questions: case and runs of white space don't count."""
    return collapse(strip(F.lower(c)))


def generated_key(c: Column) -> Column:
    """Dedup key of generated questions: case and ASCII punctuation don't count, inner white space does."""
    return F.translate(strip(F.lower(c)), PUNCTUATION, "")


def iso_timestamp(c: Column) -> Column:
    """ISO 8601; the fraction is left out where it is zero; missing is empty."""
    micros = F.date_format(c, "SSSSSS")
    text = F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)))
    return F.coalesce(text, F.lit(""))


def percentage(score: Column, total: Column) -> Column:
    """score / total * 100, 0 for an empty total; as stored, unrounded."""
    return F.coalesce(score.cast("double") / F.when(total != 0, total) * 100, F.lit(0.0))


def round2(c: Column) -> Column:
    """Two decimals, ties to even."""
    return F.bround(c, 2)


def is_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9a-fA-F]{24}\z"), F.lit(False))


def variant_of(json: Column) -> Column:
    """JSON whose fields may differ in type from row to row, as a variant; null where it is no JSON."""
    return F.try_parse_json(json)


def kind_of(v: Column, path: str) -> Column:
    """The kind of a variant's field in its row: long, decimal, double, string, boolean, array, object, null or missing."""
    got = F.try_variant_get(v, path, "variant")
    name = F.lower(F.regexp_extract(F.schema_of_variant(got), r"\A[A-Z]+", 0))
    return F.when(got.isNull(), "missing").when(name == "void", "null").when(name == "bigint", "long").otherwise(name)


def scalar_of(v: Column, path: str, *kinds: str) -> Column:
    """A variant's field as string, where it is of one of the kinds."""
    return F.when(kind_of(v, path).isin(*kinds), F.try_variant_get(v, path, "string"))


def type_name(df, column: str) -> Column:
    """The type of a column; "missing" where the collection hasn't it.  For fields whose type differs by row: :func:`kind_of`."""
    return F.lit(df.schema[column].dataType.simpleString() if column in df.columns else "missing")


def present(c: Column) -> Column:
    return c.isNotNull()


def minutes_later(c: Column, minutes: int) -> Column:
    return c + F.make_dt_interval(mins=F.lit(minutes))
