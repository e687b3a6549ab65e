"""Names, units, flags and free text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from drawbook.constants import FLAG_DISPLAY, FLAG_WORDS


def squash(col: Column) -> Column:
    """Whitespace runs become one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(col, r"(?U)\s+", " "))


def name_key(col: Column) -> Column:
    """The one spelling that name comparisons use; letters and digits are never altered."""
    key = F.lower(F.translate(squash(F.coalesce(col, F.lit(""))), "µ", "μ"))
    key = F.regexp_replace(key, r"(?U)-\s+(?=\w)", "-")
    return F.regexp_replace(F.regexp_replace(key, r"\s+\)", ")"), r"\(\s+", "(")


def folded_key(col: Column) -> Column:
    """``name_key`` with characters that page images confuse treated alike."""
    return F.translate(name_key(col), "i1|0", "lllo")


def clean_name(col: Column, codes: Column) -> Column:
    """Drop numeric footnotes and one trailing performing-lab code; a code after a comma stays.

    ``codes`` is an array column; the longest code is tried first, then alphabetical order.
    """
    bare = squash(F.regexp_replace(col, r"\(\d+\)", ""))
    ordered = F.array_sort(
        codes,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)),
    )

    def strip(name: Column, code: Column) -> Column:
        in_brackets = F.regexp_replace(name, F.concat(F.lit(r"\s*\(\s*"), code, F.lit(r"\s*\)\z")), F.lit(""))
        as_suffix = F.regexp_replace(in_brackets, F.concat(F.lit(r"(?<=[^,\s])\s+"), code, F.lit(r"\z")), F.lit(""))
        return F.when(F.trim(as_suffix) != "", F.trim(as_suffix)).otherwise(name)

    start = F.struct(bare.alias("name"), F.lit(False).alias("done"))

    def step(state: Column, code: Column) -> Column:
        stripped = strip(state["name"], code)
        changed = ~state["done"] & (stripped != state["name"])
        return F.struct(
            F.when(changed, stripped).otherwise(state["name"]).alias("name"),
            (state["done"] | changed).alias("done"),
        )

    return F.aggregate(ordered, start, step, lambda state: state["name"])


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in table.items() for part in pair])


def flag(col: Column) -> Column:
    """A printed flag word as H, L, HH or LL; anything else is NULL."""
    return F.try_element_at(_lookup(FLAG_WORDS), F.upper(F.trim(col)))


def flag_word(col: Column) -> Column:
    return F.try_element_at(_lookup(FLAG_DISPLAY), col)


def unit_key(col: Column) -> Column:
    lowered = F.lower(F.coalesce(col, F.lit("")))
    return F.translate(lowered, "µμ^ ", "uu")


def shown_unit(library_unit: Column, printed_unit: Column) -> Column:
    """The library unit, unless the source printed an empty unit: then none is filled in."""
    return F.when(printed_unit == "", F.lit("")).otherwise(library_unit)


def sanitize(col: Column) -> Column:
    """Long dashes become punctuation in published text."""
    return F.replace(F.replace(col, F.lit(" — "), F.lit("; ")), F.lit("—"), F.lit(", "))


def name_words(col: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit("([a-z]+)"), F.lit(1))


def person_key(col: Column) -> Column:
    """Order- and case-free key of a person name."""
    return F.array_join(F.array_sort(name_words(col)), " ")


def person_initial_keys(entered: Column) -> Column:
    """(first, initial) keys an entered two-word name with a one-letter word stands for; empty otherwise."""
    words = name_words(entered)
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    pair = F.when(F.size(words) == 2, F.array(
        F.when(F.length(second) == 1, F.concat_ws("|", first, second)),
        F.when(F.length(first) == 1, F.concat_ws("|", second, first)),
    )).otherwise(F.array().cast("array<string>"))
    return F.array_compact(pair)


def person_printed_key(printed: Column) -> Column:
    """first|last-initial of a printed "LAST, FIRST" or "First Last" name; NULL when it has no such parts."""
    has_comma = F.instr(printed, ",") > 0
    parts = F.split(printed, ",", 2)
    before, after = name_words(F.get(parts, F.lit(0))), name_words(F.get(parts, F.lit(1)))
    words = name_words(printed)
    first = F.when(has_comma, F.get(after, F.lit(0))).when(F.size(words) > 1, F.get(words, F.lit(0)))
    last = F.when(has_comma, F.get(before, F.lit(0))).when(F.size(words) > 1, F.get(words, F.size(words) - 1))
    return F.when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit("|"), F.substring(last, 1, 1)))


def token_key(col: Column) -> Column:
    """A result token for comparison: ``prefix|number`` or the folded text."""
    text = F.trim(col)
    number = F.regexp_extract(text, r"^([<>]=?)?\s*(\d+(?:\.\d+)?)\z", 2)
    prefix = F.regexp_extract(text, r"^([<>]=?)?\s*(\d+(?:\.\d+)?)\z", 1)
    return F.when(number != "", F.concat(prefix, F.lit("|"), number.cast("double").cast("string"))).otherwise(
        F.lower(text))


def contains_any(col: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | F.contains(col, F.lit(phrase))
    return out
