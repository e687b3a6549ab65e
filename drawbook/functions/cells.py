"""Printed result cells, ranges and flags as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drawbook.constants import EXPECTED_WORDS, NOT_PERFORMED_WORDS, QUALITATIVE_WORDS, READ_STATUS_WORDS
from drawbook.functions.dates import let
from drawbook.functions.plan import compute_once

# The cell, count-range and piece grammars.
CELL = r"^([<>≤≥]=?)?(\d+(?:\.\d+)?|\.\d+)([HL])?\z"
COUNT_RANGE = r"^\d+(?:\.\d+)?\s*[-–]\s*\d+(?:\.\d+)?\z"
PIECE = r"([<>≤≥]=?(?:\d+(?:\.\d+)?|\.\d+)[HL]?|(?:\d+(?:\.\d+)?|\.\d+)[HL]?)"
PRINTED_RANGE = r"^(\d+(?:\.\d+)?)\s*[-–]\s*(\d+(?:\.\d+)?)(?:\s+[A-Za-zµμ%][\w/%.^µμ]*)?\z"


def _group(text: Column, pattern: str, index: int) -> Column:
    found = F.regexp_extract(text, pattern, index)
    return F.when(found != "", found)


def cell_result(col: Column) -> Column:
    """STRUCT<status, value, disp>. A limit keeps its text and has no value; nothing is inferred."""
    low = F.lower(col)
    inequality, number = _group(col, CELL, 1), _group(col, CELL, 2)
    no_value = F.lit(None).cast("double")

    def made(status: Column, value: Column, disp: Column) -> Column:
        return F.struct(status.alias("status"), value.alias("value"), disp.alias("disp"))

    final = F.lit("final")
    return (F.when(low.isin(NOT_PERFORMED_WORDS), made(F.lit("not_performed"), no_value, F.lit("")))
            .when(low.isin(QUALITATIVE_WORDS) | col.rlike(COUNT_RANGE), made(final, no_value, col))
            .when(number.isNull(), made(col, no_value, col))
            .when(inequality.isNotNull(), made(final, no_value, F.concat(inequality, number)))
            .otherwise(made(final, number.cast("double"), number)))


def split_cell(col: Column) -> Column:
    """STRUCT<pieces, ambiguous>: split only after a flag or before an inequality; digits on digits are ambiguous."""

    def read(pieces: Column) -> Column:
        whole = (F.size(pieces) > 0) & (F.array_join(pieces, "") == col)
        seams = F.arrays_zip(
            F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("a"),
            F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))).alias("b"))
        unclear = F.exists(seams, lambda s: ~(s["a"].rlike(r"[HL]\z") | s["b"].rlike(r"^[<>≤≥]")))
        return F.struct(F.when(whole, pieces).alias("pieces"), (whole & unclear).alias("ambiguous"))

    return let(F.regexp_extract_all(col, F.lit(PIECE), F.lit(1)), read)


def is_good(disp: Column) -> Column:
    return F.lower(disp).isin(EXPECTED_WORDS)


def is_censored(disp: Column, value: Column) -> Column:
    return value.isNull() & F.coalesce(disp, F.lit("")).rlike(r"^\s*(?:<=?|>=?|≤|≥)\s*\d")


def parse_range(display: Column) -> Column:
    """STRUCT<lo, hi, display> of exactly ``lo - hi [unit]`` with lo <= hi, else NULL."""
    text = F.trim(display)
    lo, hi = _group(text, PRINTED_RANGE, 1).cast("double"), _group(text, PRINTED_RANGE, 2).cast("double")
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi"), text.alias("display")))


def range_numbers(display: Column) -> Column:
    """Every number printed in a range text, as one comparable key; empty text when there is none."""
    numbers = F.regexp_extract_all(F.coalesce(display, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_join(F.transform(numbers, lambda n: n.cast("double").cast("string")), ",")


def range_reference(display: Column) -> Column:
    """The last number of a printed range."""
    numbers = F.regexp_extract_all(F.coalesce(display, F.lit("")), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.element_at(F.when(F.size(numbers) > 0, numbers), -1).cast("double")


def canonical_range(col: Column) -> Column:
    """One notation per printed range; numbers, units and wording stay as printed."""
    text = F.lower(F.trim(F.regexp_replace(col, r"(?U)\s+", " ")))
    text = F.replace(F.replace(text, F.lit("≤"), F.lit("<=")), F.lit("≥"), F.lit(">="))
    text = F.regexp_replace(text, r"([<>])\s*or\s*=", "$1=")
    text = F.regexp_replace(text, r"\s*(<=|>=|<|>)\s*", "$1")
    return F.regexp_replace(text, r"(\d)\s*[-–]\s*(?=\d)", "$1-")


_ESTIMATE = r"(?i)\(\s*e\s*\)"
_MEASURE = r"(?i)^(\d+(?:\.\d+)?)\s*(?:%|lbs?|cm2|cm²|cm\^2)?\z"


def with_measure(df: DataFrame, col: str, out: str) -> DataFrame:
    """Add ``out``: STRUCT<value, text, estimated> of one printed measurement; NULL when absent or unreadable.

    Each pattern runs once a row: the number found is a column of its own before it is tested and turned into parts.
    """
    df = compute_once(df, _found=F.regexp_extract(F.trim(F.regexp_replace(col, _ESTIMATE, "")), _MEASURE, 1))
    found = F.col("_found")
    return compute_once(df, **{out: F.when(found != "", F.struct(
        found.cast("double").alias("value"), found.alias("text"), F.col(col).rlike(_ESTIMATE).alias("estimated")))}).drop("_found")


def is_text_result(result: Column, reference: Column) -> Column:
    """A word, a dipstick grade or a count range that is not the row's own reference range."""
    folded = F.trim(F.regexp_replace(F.coalesce(result, F.lit("")), r"(?U)\s+", " "))
    copied = canonical_range(folded).eqNullSafe(canonical_range(reference))
    return (F.lower(folded).isin(READ_STATUS_WORDS) | folded.rlike(r"^[1-4]\+\z")
            | (folded.rlike(r"^\d{1,3}\s*-\s*\d{1,3}\z") & ~copied))


_BOUNDED = r"^(-?\d+(?:\.\d+)?)-(-?\d+(?:\.\d+)?)(?:\s+[a-zµμ%][a-z0-9µμ%/.^]*)?\z"
_SINGLE = r"^(<=|>=|<|>)(-?\d+(?:\.\d+)?)(?:\s+[a-zµμ%][a-z0-9µμ%/.^]*)?\z"


def with_flag_consistent(df: DataFrame, result: str, flag: str, reference: str, column_role: str,
                         out: str = "consistent") -> DataFrame:
    """Add ``out``: does the printed flag agree with the printed number and the printed range?

    Undecidable inputs (words, no numeric range) are consistent. An inequality result is judged only where it
    settles the side. A flagged risk band, or an unflagged value printed in the out-of-range column, may print
    the band itself instead of one normal range. Parsed parts are separate projections so each pattern runs once.
    """
    printed, ref = F.col(result), F.col(reference)
    df = df.withColumns({
        "_op": _group(printed, CELL, 1), "_num": _group(printed, CELL, 2).cast("double"),
        "_glued": _group(printed, CELL, 3), "_text": canonical_range(ref)})
    df = df.withColumns({
        "_b_lo": _group(F.col("_text"), _BOUNDED, 1).cast("double"),
        "_b_hi": _group(F.col("_text"), _BOUNDED, 2).cast("double"),
        "_s_op": _group(F.col("_text"), _SINGLE, 1), "_s_num": _group(F.col("_text"), _SINGLE, 2).cast("double")})
    c, no = F.col, F.lit(False)
    number, op, s_op, s_num, mark = c("_num"), c("_op"), c("_s_op"), c("_s_num"), c(flag)
    df = df.withColumns({
        "_low": F.when(c("_b_lo").isNotNull(), c("_b_lo")).when(s_op.startswith(">"), s_num),
        "_high": F.when(c("_b_lo").isNotNull(), c("_b_hi")).when(s_op.startswith("<"), s_num),
        "_closed": c("_b_lo").isNotNull() | F.coalesce(s_op.isin("<=", ">="), no)})
    strictly_below, strictly_above = F.coalesce(op == "<", no), F.coalesce(op == ">", no)
    df = df.withColumns({
        "_under": F.coalesce(number < c("_low"), no) | F.coalesce(
            (number == c("_low")) & (~c("_closed") | strictly_below), no),
        "_over": F.coalesce(number > c("_high"), no) | F.coalesce(
            (number == c("_high")) & (~c("_closed") | strictly_above), no)})
    df = df.withColumn("_expected", (
        F.when(op.startswith("<") | op.startswith("≤"), F.when(c("_under"), F.lit("L")))
        .when(op.startswith(">") | op.startswith("≥"), F.when(c("_over"), F.lit("H")))
        .when(c("_under"), F.lit("L")).when(c("_over"), F.lit("H"))))
    expected = c("_expected")
    high_band = (mark == "H") & s_op.startswith(">") & F.when(s_op == ">", number > s_num).otherwise(number >= s_num)
    low_band = (mark == "L") & s_op.startswith("<") & F.when(s_op == "<", number < s_num).otherwise(number <= s_num)
    unmarked = mark.isNull() & expected.isNotNull() & (c(column_role) == "out_of_range")
    banded = op.isNull() & (F.coalesce(high_band, no) | F.coalesce(low_band, no) | F.coalesce(unmarked, no))
    agrees = F.when(op.isNull() | expected.isNotNull(), mark.eqNullSafe(expected) | banded).otherwise(mark.isNull())
    verdict = (F.when(number.isNull(), F.lit(True))
               .when(c("_glued").isNotNull() & ~c("_glued").eqNullSafe(mark), no)
               .when(F.coalesce(c("_text"), F.lit("")) == "", F.lit(True))
               .when(c("_b_lo").isNotNull() & (c("_b_lo") > c("_b_hi")), no)
               .when(c("_b_lo").isNull() & s_op.isNull(), F.lit(True))
               .otherwise(agrees))
    return df.withColumn(out, verdict).drop(
        "_op", "_num", "_glued", "_text", "_b_lo", "_b_hi", "_s_op", "_s_num", "_low", "_high", "_closed", "_under",
        "_over", "_expected")
