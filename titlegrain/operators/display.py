"""Values as a report shows them."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S

# Kinds of deed by the first word found, in this order, with an English label.
LABELS = [
    ("deposit of title", "Deposit of title deeds"),
    ("modt", "Deposit of title deeds"),
    ("discharge", "Discharge receipt"),
    ("receipt", "Discharge receipt"),
    ("ரசீது", "Discharge receipt"),
    ("mortgage", "Mortgage"),
    ("hypothèque", "Mortgage"),
    ("அடமான", "Mortgage"),
    ("rectification", "Rectification"),
    ("release", "Release"),
    ("lease", "Lease"),
    ("power of attorney", "Power of attorney"),
    ("court", "Court order"),
    ("agreement", "Agreement"),
    ("settlement", "Settlement"),
    ("செட்டில்மெ", "Settlement"),
    ("partition", "Partition"),
    ("பாகப்பிரிவினை", "Partition"),
    ("gift", "Gift"),
    ("cession", "Gift"),
    ("sale", "Sale"),
    ("conveyance", "Sale"),
    ("கிரைய", "Sale"),
]


def nature_label(nature: Column) -> Column:
    """An English label of a deed's nature; ``Other`` where no word fits, NULL for NULL."""
    low = F.lower(nature)
    return F.when(nature.isNotNull(), F.coalesce(*[F.when(low.contains(w), F.lit(label)) for w, label in LABELS], F.lit("Other")))


def repair_money(reg: DataFrame) -> DataFrame:
    """P10: a currency text that stands in the reference column moves to the consideration."""
    money = F.coalesce(F.col("pr_numbers").rlike(r"(?i)rs\.?\s*[0-9]|[0-9],[0-9]{3}"), F.lit(False))
    return reg.withColumns({"consideration": F.when(money, F.coalesce("consideration", "pr_numbers")).otherwise(F.col("consideration")), "pr_numbers": F.when(~money, F.col("pr_numbers"))})


def shown_amount() -> Column:
    """Consideration, else an amount in the remarks, else the market value, else ``-``."""
    said = F.nullif(F.regexp_extract(F.coalesce("remarks", F.lit("")), r"(Rs\.? ?[0-9,]+(?:/-)?)", 1), F.lit(""))
    return F.coalesce("consideration", said, "market_value", F.lit("-"))


def property_info(reg: DataFrame, header: DataFrame) -> DataFrame:
    """Extent and place of an entry: its schedule, else its remarks, else the certificate."""
    said = F.nullif(F.regexp_extract(F.coalesce("remarks", F.lit("")), r"(?i)extent of ([0-9][0-9.,]* [A-Za-z.]+)", 1), F.lit(""))
    return reg.join(header.select("doc_id", "requested_extent", "village"), "doc_id", "left").select("doc_id", "seq", F.coalesce("extent", said, "requested_extent").alias("extent"), F.coalesce("village_street", "village").alias("place"))


def shown_page(reg: DataFrame, pages: DataFrame) -> DataFrame:
    """The page of an entry; without one, its share of the certificate's pages."""
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    total = reg.groupBy("doc_id").agg(F.count("*").alias("entries"))
    guess = F.least(F.col("pages") - 1, F.floor((F.col("seq") - 1) * F.col("pages") / F.col("entries")))
    return reg.join(total, "doc_id").join(n, "doc_id", "left").select("doc_id", "seq", F.coalesce(F.col("page_index").cast("bigint"), guess.cast("bigint")).alias("page"))


def clean_party(col: Column) -> Column:
    """One party without numbering, roles, places leaked from a schedule; NULL if under three letters."""
    text = F.split(col, "\n")[0]
    for pattern in (r"^[.,:;\s]*[0-9]{0,3}[.]*\s*", r"(?i)\s*\((?:principal|agent|lessor|lessee|vendor|purchaser)\)", r"(?i),?\s*\b(?:flat|plot|door|block|schedule)\b(?: no)?[^,\n]*", r"(?i)\s+(?:tamil nadu|india)$", r"[\s.,:;-]+$"):
        text = F.regexp_replace(text, pattern, "")
    text = S.collapse(text)
    return F.when(F.length(text) >= 3, text)


def split_merged(col: Column) -> Column:
    """A cell that holds two numbered lists, cut before the second ``1.``: executants, claimants."""
    at = F.regexp_instr(F.substring(col, 2, 1_000_000), F.lit(r"(?<![0-9])1[.]\s"))
    return F.struct(F.trim(F.when(at > 0, F.substring(col, F.lit(1), at)).otherwise(col)).alias("executants"), F.trim(F.when(at > 0, F.substring(col, at + 1, F.length(col)))).alias("claimants"))


def parentage(col: Column) -> Column:
    """A name and its parent's: ``A S/o B``, ``A, daughter of B``; no relation gives NULL."""
    relation = r"(?i)^(.*?)[,\s]+(?:[sdwh]/o\.?|(?:son|daughter|wife|husband) of)\s+(.+)$"
    parent = F.nullif(F.regexp_extract(col, relation, 2), F.lit(""))
    return F.struct(F.when(parent.isNotNull(), F.regexp_extract(col, relation, 1)).otherwise(col).alias("name"), parent.alias("parent"))


def owners_list(col: Column) -> Column:
    """Owners of a text numbered ``(1)``, ``[i]`` or ``1.``, or joined by commas and ``and``."""
    marked = F.regexp_replace(col, r"\s*(?:\([0-9]+\)|\[[ivx0-9]+\]|(?:^|\s)[0-9]{1,2}[.])\s*", "\n")
    listed = F.when(marked.contains("\n"), F.split(marked, "\n")).otherwise(F.split(col, r"\s*,\s*|\s+and\s+"))
    return F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != "")


def title_name(col: Column) -> Column:
    """Words of more than one letter with a capital first; initials and short acronyms stay."""
    return F.array_join(F.transform(F.split(S.collapse(col), " "), lambda w: F.when((F.length(w) <= 3) & (F.upper(w) == w), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w)))))), " ")


def _first_number(col: Column, unit: str) -> Column:
    return F.regexp_extract(col, rf"([0-9]+(?:\.[0-9]+)?)\s*(?:{unit})", 1).try_cast("double")


# Unit words and square feet of the two precedences.
_SQFT, _SQM, _GROUND, _ACRE, _CENT = r"sq\.?\s*ft|sq\.?\s*feet|சதுர\s*அடி", r"sq\.?\s*m|சதுர\s*மீட்டர்", r"grounds?|கிரவுண்ட்", r"acres?|ஏக்கர்", r"cents?|சென்ட்"


def extent_by_check(col: Column) -> Column:
    """The first unit found in the order square feet, metres, grounds, acres, cents, a bare number."""
    text = F.regexp_replace(F.lower(col), ",", "")
    bare = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double")
    return F.round(F.coalesce(_first_number(text, _SQFT), _first_number(text, _SQM) * 10.7639, _first_number(text, _GROUND) * 2400.0, _first_number(text, _ACRE) * 43560.0, _first_number(text, _CENT) * 435.6, bare), 2)


def extent_by_validator(col: Column) -> Column:
    """The same units in the order cents, acres, grounds, metres, square feet, a bare number."""
    text = F.regexp_replace(F.lower(col), ",", "")
    bare = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)$", 1).try_cast("double")
    return F.round(F.coalesce(_first_number(text, _CENT) * 435.6, _first_number(text, _ACRE) * 43560.0, _first_number(text, _GROUND) * 2400.0, _first_number(text, _SQM) * 10.7639, _first_number(text, _SQFT), bare), 2)


def land_flag(col: Column) -> Column:
    """V3: whether a land class names public land; private words win; NULL is not flagged."""
    safe = S.contains_any(col, ["ryotwari", "private", "patta land", "wet", "dry", "நஞ்சை", "நன்செய்", "புஞ்சை"])
    return ~safe & S.contains_any(col, ["poramboke", "government", "waterbody", "kanmai", "road", "புறம்போக்கு", "அரசு"])


def likeness(a: Column, b: Column) -> Column:
    """The ratio of matching blocks of two texts in whole per cent, by batches."""

    @F.pandas_udf("int")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else round(100 * difflib.SequenceMatcher(None, p, q, autojunk=False).ratio()) for p, q in zip(x, y)], dtype="Int32")

    return ratio(a, b)


def field_boxes(fields: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """For each field the box around the words of its value on the first page that has one.

    Words meet values by the word itself (an equi-join on key and word), not page by page.
    """
    tokens = fields.filter("value IS NOT NULL").select(key, "field", F.explode(F.array_distinct(S.tokens(F.col("value")))).alias("token"))
    met = words.withColumn("token", F.lower("word")).join(tokens, [key, "token"])
    boxes = met.groupBy(key, "field", "page_number").agg(F.count_distinct("token").alias("hits"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    return boxes.groupBy(key, "field").agg(F.min_by(F.struct("page_number", "x0", "x1", "y0", "y1"), F.struct(-F.col("hits"), F.col("page_number"))).alias("b")).select(key, "field", "b.*")
