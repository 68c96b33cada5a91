"""Pages, lines and typed documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S


def page_range(pages: DataFrame, wanted: str | None, most: int | None = None, col: str = "page_number") -> DataFrame:
    """Pages of ``"1-3,5"``; invalid parts are ignored, nothing valid means all pages.

    The result is a plain predicate on the page number, so that it reaches the scan.
    """
    test = None
    for part in (wanted or "").split(","):
        ends = part.strip().split("-")
        if len(ends) <= 2 and all(e.strip().isdigit() for e in ends):
            low, high = int(ends[0]), int(ends[-1])
            if low <= high:
                here = F.col(col).between(low, high)
                test = here if test is None else test | here
    found = pages.filter(test) if test is not None else pages
    return found.filter(F.col(col) <= most) if most else found


def lines(texts: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each line of a text: ``line_no`` from 1, ``line`` as it stands."""
    return texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).select(key, (F.col("pos") + 1).alias("line_no"), "line")


def text_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Lines and characters of each text."""
    return texts.filter(F.col(text).isNotNull()).select(key, F.size(F.split(text, "\n")).alias("n_lines"), F.length(text).alias("n_chars"))


def trusted_layer(pages: DataFrame, text: str = "content") -> Column:
    """whether a digital text layer can be trusted: few glyph codes, few empty brackets, few lost signs."""
    codes = F.regexp_count(text, F.lit(r"\(cid:[0-9]+\)"))
    empty = F.regexp_count(text, F.lit(r"\(\s*\)"))
    lost = F.regexp_count(text, F.lit("�"))
    return ~((codes >= 5) | ((codes >= 1) & (F.length(text) < 100)) | (empty >= 3) | (lost >= 2))


# Words of each sort of document with their weights (A15, T2), in order of preference.
SORTS = [
    ("deed", [("executed at", 3), ("vendor", 2), ("purchaser", 2), ("conveys", 1)]),
    ("ec", [("encumbrances noted", 3), ("book 1", 2), ("index", 1), ("challan", 1)]),
    ("patta", [("chitta", 3), ("patta", 2), ("fasli", 2), ("joint holders", 1)]),
    ("town", [("town survey", 3), ("ward", 2), ("tenure", 2), ("encroachment", 1)]),
    ("legal", [("on perusal", 2), ("the title is", 2), ("legal heirs", 1), ("litigation", 1)]),
    ("tender", [("offers", 2), ("reserve", 2), ("bidder", 2), ("lot ", 1)]),
    ("grievance", [("respected", 2), ("kindly", 2), ("my file", 2), ("my neighbour", 1)]),
]


def keyword_score(text: Column, words: list[tuple[str, int]]) -> Column:
    """The weights of the words contained, added up."""
    low = F.lower(text)
    return sum((low.contains(w).cast("int") * weight for w, weight in words), F.lit(0))


def detect_sort(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The best-scoring sort of document; ties go to the earlier one, no hit to ``deed``."""
    scored = texts.select(key, *[F.coalesce(keyword_score(F.col(text), words), F.lit(0)).alias(name) for name, words in SORTS])
    best = F.greatest(*[F.col(name) for name, _ in SORTS])
    pick = F.coalesce(*[F.when((F.col(name) == best) & (best > 0), F.lit(name)) for name, _ in SORTS], F.lit(SORTS[0][0]))
    return scored.select(key, pick.alias("sort"), best.alias("score"))


def top_pages(pages: DataFrame, group: str, order: str, text: str, words: list[tuple[str, int]], most: int = 6) -> DataFrame:
    """The pages of each document that score highest, ties by page order."""
    scored = pages.select(group, order, F.coalesce(keyword_score(F.col(text), words), F.lit(0)).alias("score"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def prune(rows: DataFrame, key: str, order: str, line: str, budget: int, keep_first: int = 25, words: tuple[str, ...] = ()) -> DataFrame:
    """The first lines of a text, then lines with one of the words, until the budget of
    characters (each line and one more) is used up."""
    wanted = (F.col(order) <= keep_first) | (S.contains_any(F.col(line), list(words)) if words else F.lit(False))
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    kept = rows.filter(wanted).withColumn("used", F.coalesce(F.sum(F.length(line) + 1).over(before), F.lit(0)))
    return kept.filter(F.col("used") < budget).select(key, order, line, "used")


def chunks(rows: DataFrame, key: str, order: str, line: str, anchor: str) -> DataFrame:
    """Lines grouped to entries; an entry begins at each line that matches
    ``anchor`` and does not follow a line that announces a prior document."""
    by = Window.partitionBy(key).orderBy(order)
    begins = F.col(line).rlike(anchor) & ~F.coalesce(F.lag(line).over(by).rlike("(?i)prior document"), F.lit(False))
    numbered = rows.withColumn("chunk", F.sum(begins.cast("int")).over(by))
    return numbered.filter("chunk > 0").groupBy(key, "chunk").agg(F.count("*").alias("n_lines"), F.min(order).alias("first_line"), F.max(order).alias("last_line"))


def filled(rows: DataFrame, key: str, order: str, col: str) -> DataFrame:
    """A column filled forward over continuation rows."""
    past = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(f"{col}_filled", F.last(col, ignorenulls=True).over(past))


@dataclass(frozen=True)
class Rule:
    """One pattern of a field; the first group that is not empty wins, by rank."""

    field: str
    pattern: str
    rank: int = 1
    confidence: float = 0.9


# Rules for the sorts of document at hand: generic labels with what follows them.
DEED_RULES = [
    Rule("executed_at", r"executed at ([A-Za-zÀ-ſ-]+) on"),
    Rule("executed_on", r" on ([0-9]{2}[-./][A-Za-z0-9]{2,3}[-./][0-9]{4}) "),
    Rule("survey_number", r"survey (?:number )?([0-9]+/[0-9A-Z]+)"),
    Rule("document_number", r"document (?:number )?([0-9]+/[0-9]{4})"),
    Rule("amount", r"(Rs[.] [0-9,]+/-)"),
    Rule("extent", r"(?:measuring|extent|measures) ([0-9][0-9,.]* [A-Za-z.]+)"),
]


def rule_cells(text: str, rules: list[Rule]) -> Column:
    """The fields of a set of rules as one array of ``field, value, confidence``."""
    fields: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: r.rank):
        fields.setdefault(rule.field, []).append(rule)
    cells = []
    for field, own in fields.items():
        hits = [F.nullif(F.trim(F.regexp_extract(text, r.pattern, 1)), F.lit("")) for r in own]
        sure = F.coalesce(*[F.when(h.isNotNull(), F.lit(r.confidence)) for h, r in zip(hits, own)], F.lit(0.0))
        cells.append(F.struct(F.lit(field).alias("field"), F.coalesce(*hits).alias("value"), sure.alias("confidence")))
    return F.array(*cells)


def extract_by_rules(texts: DataFrame, key: str, text: str, rules: list[Rule]) -> DataFrame:
    """The EAV table ``key, field, value, confidence``; a field without a hit has NULL and 0.

    All patterns are projections of one scan; nothing is shuffled.
    """
    return texts.filter(F.col(text).isNotNull()).select(key, F.inline(rule_cells(text, rules)))


def boundary_clauses(reg: DataFrame) -> DataFrame:
    """The clauses of a boundary text by direction, ``N: ... S: ...`` or written out."""
    found = lambda letter, word: F.nullif(F.trim(F.regexp_extract("boundaries", rf"(?:^|\s)(?:{letter}|{word}):\s*([^:]*?)(?:\s+(?:[NSEW]|North|South|East|West):|,|$)", 1)), F.lit(""))
    return reg.filter("boundaries IS NOT NULL").select("doc_id", "seq", found("N", "North").alias("north"), found("S", "South").alias("south"), found("E", "East").alias("east"), found("W", "West").alias("west"))
