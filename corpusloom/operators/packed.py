"""Several values packed in one field: one row per value, with its place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

QUOTES = '["“”«»]'
#: Signs and words that part two values.
DELIMITERS = "/／;|,·،；、\n\r"
WORDS = ("અથવા", "or")
_DIGITS = "0-9૦-૯०-९"
#: Private-use characters that stand for a parting and for a quote sign that belongs to the value.
_PART, _INNER = "\ue001", "\ue002"


def _parted(piece: Column, numbered: Column) -> Column:
    """A piece outside quotes with every parting replaced by one mark; brackets keep what they hold."""
    outside = r"(?![^(\[]*[)\]])"
    plain = F.when(numbered, F.regexp_replace(piece, rf"(?U)(^|(?<=[\s\p{{Z}}{DELIMITERS}]))[{_DIGITS}]{{1,3}}[.)](?=\D|$)", _PART)).otherwise(piece)
    words = "|".join(WORDS)
    return F.regexp_replace(plain, rf"(?U)([{DELIMITERS}]|(?<=[\s\p{{Z}}])(?:{words})(?=[\s\p{{Z}}])){outside}", _PART)


def split_packed(field: Column) -> Column:
    """The field's values in order, as an array; null and blank fields give an empty array.

    Quote signs cut the text into pieces: odd pieces are literals, even pieces part at delimiters
    outside brackets, and a fold glues all pieces together again before the marks are cut.
    A doubled or escaped quote sign inside a quoted value is one sign of that value.
    """
    text = strip(F.coalesce(field, F.lit("")))
    text = F.regexp_replace(text, r'(?s)^\[\s*(".*")\s*\]$', "$1")
    text = F.regexp_replace(text, r'\\"', _INNER)
    text = F.regexp_replace(text, rf'(?U)(^|[\s\p{{Z}}{DELIMITERS}])"""', rf'$1"{_INNER}')
    text = F.regexp_replace(text, '""', _INNER)
    numbered = F.coalesce(text.rlike(rf"^[{_DIGITS}]{{1,3}}[.)]"), F.lit(False))
    pieces = F.split(text, QUOTES, -1)
    marks = F.regexp_extract_all(text, F.lit(f"({QUOTES})"), 1)
    parts = F.transform(pieces, lambda x, i: F.when(i % 2 == 0, _parted(x, numbered)).otherwise(x))
    glued = F.aggregate(
        F.arrays_zip(parts.alias("p"), F.concat(marks, F.array(F.lit(""))).alias("m")),
        F.lit(""),
        lambda done, x: F.concat(done, F.coalesce(x["p"], F.lit("")), F.coalesce(x["m"], F.lit(""))),
    )
    values = F.transform(F.split(glued, _PART, -1), lambda v: _bare(v))
    return F.filter(values, lambda v: F.regexp_replace(v, rf"[{_INNER}\"]", "") != "")


def _bare(value: Column) -> Column:
    inside = F.regexp_extract(strip(value), r'(?s)^["“«]([^"“”«»]*)["”»]$', 1)
    plain = strip(F.when(inside != "", inside).otherwise(strip(value)))
    plain = F.when(plain.rlike(r'^["“”«»\s]*$'), F.lit("")).otherwise(plain)
    return F.regexp_replace(plain, _INNER, '"')


def explode_packed(df: DataFrame, fields: list[str], row_id: str = "id", least: int = 1) -> DataFrame:
    """``row_id, field, pos, value``: one row per value of each field that holds ``least`` values or more.

    ``pos`` counts the non-empty values from 1. Rows that repeat an id count once per field (of
    differing repeats the smallest text is taken); null and blank fields give no row; a null id is
    an id of its own. Other columns of ``df`` are not read.
    """
    long = df.select(F.col(row_id).alias("__id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("__f"))
    once = long.groupBy("__id", F.col("__f.field").alias("field")).agg(F.min("__f.text").alias("text"))
    values = once.select("__id", "field", split_packed(F.col("text")).alias("v")).filter(F.size("v") >= least)
    return values.select(F.col("__id").alias(row_id), "field", F.posexplode("v").alias("p", "value")).select(row_id, "field", (F.col("p") + 1).cast("int").alias("pos"), "value")
