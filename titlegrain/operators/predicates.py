"""Smaller filters of the inventory as Columns and DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plausible_survey(col: Column) -> Column:
    """F8: a survey number that is no portal reference, date, nought or padded code."""
    return col.rlike(r"^[1-9][0-9]{0,4}(?:/[0-9A-Z]+)*$") & ~col.rlike(r"^(?:0|[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}|[0-9]{1,2}/(?:19|20)[0-9]{2})$")


def plausible_date(day: Column, month: Column, year: Column) -> Column:
    """parts within their ranges (no check of a month's length); NULL is not plausible."""
    return F.coalesce(day.between(1, 31) & month.between(1, 12) & year.between(1950, 2035), F.lit(False))


def plausible_extent(col: Column) -> Column:
    """grounds from 100 on, or like a year, count as noise unless square feet stand beside them."""
    grounds = F.regexp_extract(F.lower(col), r"([0-9]+)(?:\.[0-9]+)? *(?:grounds?|grds?|கிரவுண்ட்)", 1).try_cast("int")
    return ~(F.coalesce(grounds >= 100, F.lit(False)) & ~F.lower(col).rlike(r"sq\.? ?ft|sft"))


def attorney_context(col: Column, number: str) -> Column:
    """whether a document number stands near a power of attorney (160 characters before, 200
    behind) and not near a word of title."""
    at = F.instr(col, number)
    around = F.lower(F.substring(col, F.greatest(at - 160, F.lit(1)), F.lit(360 + len(number))))
    return (at > 0) & around.contains("attorney") & ~around.rlike("title|sale deed|settlement deed")


def kept_lines(lines: DataFrame, text: str, score: str | None = None, least: float = 0.5) -> DataFrame:
    """Lines that hold a letter or digit and, where they carry one, a score of at least ``least``."""
    kept = lines.filter(F.col(text).rlike(r"[\p{L}\p{N}]"))
    return kept.filter(F.col(score) >= least) if score else kept


def directory(rows: DataFrame, words: str, columns: list[str], group: str | None = None, wanted: str | None = None) -> DataFrame:
    """rows of a group whose columns, joined, hold the searched words."""
    found = rows.filter(F.lower(F.concat_ws(" ", *columns)).contains(words.lower()))
    return found.filter(F.col(group) == wanted) if group and wanted else found


def word_hits(texts: DataFrame, key: str, text: str, word: str) -> DataFrame:
    """F16: how often a word stands in a text (case ignored), texts without it left out."""
    n = F.regexp_count(F.lower(text), F.lit(word.lower()))
    return texts.select(key, n.alias("hits")).filter("hits > 0")


def kept_fields(fields: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """fields without the structural and private ones."""
    return fields.filter(~F.col("field").isin(*dropped) & ~F.col("field").startswith("_"))


def by_language(english: Column, tamil: Column, language: str) -> Column:
    """A value in the language asked for, in both as ``English (Tamil)``, each falling back to the other."""
    if language == "both":
        return F.when(english.isNotNull() & tamil.isNotNull(), F.concat(english, F.lit(" ("), tamil, F.lit(")"))).otherwise(F.coalesce(english, tamil))
    return F.coalesce(tamil, english) if language == "ta" else F.coalesce(english, tamil)


def shortened(col: Column, most: int = 130) -> Column:
    """A text of at most ``most`` characters; a longer one ends in ``...``."""
    return F.when(F.length(col) > most, F.concat(F.substring(col, 1, most - 3), F.lit("..."))).otherwise(col)
