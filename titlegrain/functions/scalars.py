"""Scalar functions as Columns: text, dates, money, areas, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date forms that are read, in this order.
DATE_FORMS = ("dd-MMM-yyyy", "dd-MMMM-yyyy", "dd-MM-yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "dd.MM.yyyy")
# Words that say nothing in a name and in a survey number.
NAME_WORDS = r"\b(mr|mrs|ms|smt|thiru|thirumathi|tmt|dr|adv|late|son of|daughter of|wife of|w/o|d/o|s/o|pan|aadhaar|masked|xxxx)\b"
SURVEY_WORDS = r"\b(SURVEY|SY|TS|T\.S|NO|OLD)\b\.?"


def collapse(col: Column) -> Column:
    """Runs of white space become one blank; NULL stays NULL."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def name_normal(col: Column) -> Column:
    """Lower case, without titles and relation words, only letters, digits and blanks."""
    text = F.regexp_replace(F.lower(col), NAME_WORDS, "")
    return collapse(F.regexp_replace(text, r"[^a-z0-9\x{0B80}-\x{0BFF}\s]", ""))


def survey_normal(col: Column) -> Column:
    """Upper case, without label words and blanks, only letters, digits and slashes."""
    text = F.regexp_replace(F.upper(col), SURVEY_WORDS, "")
    return F.regexp_replace(text, r"[^A-Z0-9/]", "")


def survey_token(col: Column) -> Column:
    """The first ``number/part`` or number; NULL where there is none."""
    return F.nullif(F.regexp_extract(F.upper(col), r"([0-9]{1,5}(?:/[0-9A-Z]+)?)", 1), F.lit(""))


def tokens(col: Column, least: int = 2) -> Column:
    """Lower-case words of at least ``least`` letters."""
    return F.filter(F.split(F.lower(F.trim(col)), r"\s+"), lambda t: F.length(t) >= least)


def entity_type(name: Column) -> Column:
    """The sort of a party, first hit of ordered word lists."""
    low = F.lower(name)
    return (
        F.when(low.rlike("bank|finance|fund|வங்கி"), "bank")
        .when(low.rlike("court"), "court")
        .when(low.rlike("school|college|trust|academy|foundation|சங்கம்"), "trust")
        .when(low.rlike("ltd|limited|llp|corporation|corpn|builders|நிறுவனம்"), "company")
        .when(low.rlike("authority|board|government"), "government")
        .when(name.isNotNull(), "individual")
    )


def party_key(col: Column) -> Column:
    """A rough phonetic key of a name, letters and digits only."""
    text = F.regexp_replace(F.lower(col), r"[^a-z0-9\x{0B80}-\x{0BFF}]", "")
    for pattern, to in (("aa", "a"), ("ee", "i"), ("oo", "u"), ("th", "t"), ("dh", "d"), ("zh", "l")):
        text = F.regexp_replace(text, pattern, to)
    return text


def party_items(col: Column) -> Column:
    """X11: the parties of a numbered list ``1. A 2. B``; a lone party counts as one."""
    parts = F.split(F.trim(col), r"(?:^|\s+)[0-9]{1,3}[.]\s+")
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: collapse(p))


def parse_date(col: Column) -> Column:
    """A DATE from any of ``DATE_FORMS``; NULL where none fits."""
    return F.coalesce(*[F.try_to_date(F.trim(col), form) for form in DATE_FORMS])


def full_year(col: Column) -> Column:
    """D3: a two-digit year above 25 belongs to 19yy, else to 20yy; four digits stay."""
    year = col.cast("int")
    return F.when(F.length(col) == 4, year).when(year > 25, year + 1900).otherwise(year + 2000)


def window_years(start: Column, end: Column) -> Column:
    """Years between two dates, half up to one decimal."""
    return F.round(F.datediff(end, start) / F.lit(365.25), 1)


def amount(col: Column) -> Column:
    """The digits of a money text as DECIMAL(18,2); a decimal part after the last point is kept."""
    digits = F.regexp_replace(F.regexp_replace(F.lower(col), r"rs\.?|/-|,", ""), r"[^0-9.]", "")
    return digits.try_cast("decimal(18,2)")


def rupees(value: Column) -> Column:
    """Indian grouping ``Rs. 12,34,567/-``; nought and less give ``-``."""
    digits = F.floor(value).cast("string")
    n = F.length(digits)
    tail = F.substring(digits, -3, 3)
    head = F.substring(digits, F.lit(1), n - 3)
    odd = F.when(F.length(head) % 2 == 1, F.concat(F.substring(head, 1, 1), F.when(F.length(head) > 1, F.lit(",")).otherwise(""))).otherwise("")
    rest = F.when(F.length(head) % 2 == 1, F.substring(head, F.lit(2), F.length(head))).otherwise(head)
    pairs = F.regexp_replace(rest, "([0-9]{2})", "$1,")
    grouped = F.when(n <= 3, digits).otherwise(F.concat(odd, F.when(rest != "", F.regexp_replace(pairs, ",$", "")).otherwise(""), F.lit(","), tail))
    return F.when(value > 0, F.concat(F.lit("Rs. "), grouped, F.lit("/-"))).otherwise("-")


def mask_numbers(col: Column) -> Column:
    """V2: twelve-digit identity numbers keep their last four digits, inside free text as well."""
    return F.regexp_replace(col, r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})\b", "XXXX-XXXX-$1")


def contains_any(col: Column, words: list[str]) -> Column:
    """Whether lower-cased text holds one of the words; NULL counts as not."""
    return F.coalesce(F.lower(col).rlike("|".join(words)), F.lit(False))


def variance_percent(a: Column, b: Column) -> Column:
    """The difference as a share of the larger, in per cent; NULL for two noughts."""
    return F.try_divide(F.abs(a - b) * 100, F.greatest(a, b))
