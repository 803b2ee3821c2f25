"""Scalar column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the corpus normalisation, in the order in which they apply; explicit classes mean the same everywhere.
DATE_LIKE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
ID_LIKE = r"[a-z_-]*[0-9][a-z0-9_-]*"
SPACES = r"[ \t\r\n\f]+"


def stripped(text: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def folded(text: Column | str) -> Column:
    """Lower case, with the sharp s as two letters."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalized_text(text: Column | str) -> Column:
    """Folded text with dates, identifiers and numbers as placeholders and single spaces."""
    x = F.regexp_replace(folded(text), DATE_LIKE, "<date>")
    x = F.regexp_replace(x, ID_LIKE, "<id>")
    return F.trim(F.regexp_replace(x, SPACES, " "))


def spelled(text: Column | str) -> Column:
    """A label without case, outer blanks and kind of separator; null if nothing is left."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, r"^[\s_\-]+|[\s_\-]+$", "")), r"[\s_\-]+", "_")
    return F.when(plain != "", plain)


def family_of(task_id: Column | str) -> Column:
    """What stands before the last underscore, or the whole."""
    return F.regexp_replace(task_id, r"_[^_]*$", "")


def variant_of(task_id: Column | str) -> Column:
    """What stands behind the last underscore, or the whole."""
    return F.regexp_extract(task_id, r"([^_]*)$", 1)


def truthy(flag: Column | str) -> Column:
    """1 for true, 0 for false and null."""
    return F.coalesce(F.col(flag).cast("int") if isinstance(flag, str) else flag.cast("int"), F.lit(0))


def canonical_number(text: Column | str) -> Column:
    """A decimal number's shortest plain text ('1.00' is '1'), or null if it is none."""
    d = F.col(text).try_cast("decimal(38,12)") if isinstance(text, str) else text.try_cast("decimal(38,12)")
    plain = F.regexp_replace(F.regexp_replace(d.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(d == 0, F.lit("0")).otherwise(plain)


def canonical_moment(text: Column | str) -> Column:
    """A date-time with an offset as UTC text; null without an offset or if malformed."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(column.rlike(r"(?:[zZ]|[+-]\d{2}:?\d{2})$"), F.date_format(F.try_to_timestamp(column), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def shingles(words: Column, size: int = 2) -> Column:
    """The distinct runs of `size` words, joined by blanks; shorter lists give their words as one shingle, empty ones none."""
    n = F.size(words)
    runs = F.slice(words, 1, F.greatest(n - (size - 1), F.lit(0)))
    for i in range(1, size):
        runs = F.zip_with(runs, F.slice(words, i + 1, F.greatest(n - (size - 1), F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < size, F.array(F.concat_ws(" ", words))).otherwise(F.array_distinct(runs))


def words(text: Column | str) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(folded(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def log_factorial(n: Column) -> Column:
    """ln n! as a sum of logarithms."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(2).cast("long"), F.greatest(n, F.lit(2)).cast("long")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double"))))


def rounded(value: Column, digits: int = 8) -> Column:
    return F.round(value, digits)
