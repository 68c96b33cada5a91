"""Records out of table rows, lines and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.operators.documents import SORTS, Rule, keyword_score

_CELLS = [f"c{i}" for i in range(7)]


def table_entries(rows: DataFrame) -> DataFrame:
    """Entries out of certificate tables ``doc_id, page_index, row_no, c0..c6``.

    A number in ``c0`` begins an entry; the rows behind it continue it. A row whose second
    cell is a label fills the labelled field; other rows add to the party cells. The number
    of the entry is carried forward by a window, the cells are joined in row order; rows
    before the first entry and heading rows are dropped.
    """
    order = Window.partitionBy("doc_id").orderBy("page_index", "row_no")
    begins = F.coalesce(F.trim("c0").rlike("^[0-9]+$"), F.lit(False))
    numbered = rows.withColumn("begins", begins).withColumn("entry", F.sum(F.col("begins").cast("int")).over(order)).filter("entry > 0")
    label = F.lower(F.trim(F.coalesce("c1", F.lit(""))))
    value, remark = label.startswith("consideration"), label.startswith("document remarks")
    plain = ~F.col("begins") & ~value & ~remark & ~label.startswith("schedule")
    at = F.struct("page_index", "row_no", F.lit(0).alias("k"))

    def joined(cell: str, when: Column) -> Column:
        kept = F.when(when & (F.trim(F.coalesce(F.col(cell), F.lit(""))) != ""), F.struct(at.alias("at"), S.collapse(F.col(cell)).alias("text")))
        return F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["text"]), " "), F.lit(""))

    one = lambda cell, when: F.max(F.when(when, S.collapse(F.col(cell))))
    behind = lambda cell: F.trim(F.regexp_replace(F.col(cell), "^[^:]*:", ""))
    grouped = numbered.groupBy("doc_id", "entry").agg(
        one("c0", F.col("begins")).alias("sr"),
        F.max(F.when(F.col("begins"), F.regexp_extract("c1", r"([0-9]{1,6}/[0-9]{4})", 1))).alias("doc_no"),
        F.max(F.when(F.col("begins"), F.col("c2"))).alias("dates"),
        one("c3", F.col("begins")).alias("nature"),
        joined("c4", F.col("begins") | plain).alias("executants"),
        joined("c5", F.col("begins") | plain).alias("claimants"),
        one("c6", F.col("begins")).alias("vol_page"),
        F.max(F.when(value, behind("c1"))).alias("consideration"),
        F.max(F.when(value, behind("c3"))).alias("market_value"),
        F.max(F.when(value, behind("c5"))).alias("pr_numbers"),
        joined("c2", remark).alias("remarks"),
        F.min("page_index").alias("page_index"),
    )
    day = lambda i: S.parse_date(F.try_element_at(F.split("dates", r"\s*\n\s*"), F.lit(i)))
    return grouped.select("doc_id", "entry", F.col("sr").cast("int").alias("sr"), "doc_no", day(1).alias("execution_date"), day(2).alias("presentation_date"), day(3).alias("registration_date"), "nature", "executants", "claimants", "vol_page", "consideration", "market_value", "pr_numbers", "remarks", "page_index")


def line_entries(rows: DataFrame, key: str) -> DataFrame:
    """Entries out of text lines ``key, line_no, line``.

    An anchor is a line with a document number that is no date, has no prior-document label
    in the line before, and a date within the next four lines; the lines up to the next
    anchor belong to it.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    number, day = r"\b[0-9]{1,6}/[0-9]{4}\b", r"\b[0-9]{2}-[A-Z][a-z]{2}-[0-9]{4}\b"
    ahead = order.rowsBetween(0, 4)
    dated = F.max(F.col("line").rlike(day)).over(ahead)
    prior = F.coalesce(F.lag("line").over(order).rlike("(?i)(prior|previous) doc"), F.lit(False))
    anchor = F.col("line").rlike(number) & ~F.col("line").rlike(r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}") & ~prior & dated & ~F.col("line").rlike("(?i)(prior|previous) doc")
    chunked = rows.withColumn("entry", F.sum(anchor.cast("int")).over(order)).filter("entry > 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    text = chunked.groupBy(key, "entry").agg(whole.alias("text"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    return text.select(key, "entry", "first_line", "last_line", F.regexp_extract("text", f"({number})", 1).alias("doc_no"), S.parse_date(F.regexp_extract("text", f"({day})", 1)).alias("date"), F.nullif(F.regexp_extract("text", r"(?i)(mortgage|settlement|lease|power of attorney|deposit of title deeds|loan)", 1), F.lit("")).alias("nature"))


def declared_total(pages: DataFrame, last: int = 3) -> DataFrame:
    """The declared number of entries, from the last pages first."""
    said = F.regexp_extract("content", r"(?i)(?:number of entries|no\.? of entries|பதிவுகளின் எண்ணிக்கை)[^0-9\n]*([0-9]+)", 1).try_cast("int")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("page_number"), F.desc("page_id")))
    seen = pages.select("doc_id", "page_number", said.alias("total"), rank.alias("r")).filter((F.col("r") <= last) & F.col("total").isNotNull())
    return seen.groupBy("doc_id").agg(F.max_by("total", "page_number").alias("total"))


# Rules of each sort of document: what follows a label up to the end of the line or clause.
def _label(field: str, label: str, rank: int = 1) -> Rule:
    return Rule(field, rf"(?i)(?:{label})[^:\n]*[:]\s*([^\n]+)", rank)


RULES_BY_SORT: dict[str, list[Rule]] = {
    "ec": [_label("sro", r"s\.?r\.?o|sub registrar office"), _label("certificate_no", "certificate no"), _label("application_no", "application no"), _label("applicant_name", "applicant"), _label("village", "village"), _label("survey_details", "survey details"), _label("search_period", "search period"), _label("requested_extent", "total extent")],
    "deed": [Rule("registration_place", r"(?i)executed at ([^\s]+)"), Rule("executed_on", r"\bon ([0-9]{2}[-./][A-Za-z0-9]{2,3}[-./][0-9]{4})"), Rule("vendor", r"between ((?:[A-Z]\. )?[A-Z][a-z]+) and"), Rule("purchaser", r"between [^\n]*? and ((?:[A-Z]\. )?[A-Z][a-z]+)"), Rule("document_number", r"document (?:number )?([0-9]+/[0-9]{4})"), Rule("survey_number", r"survey (?:number )?([0-9]+/[0-9A-Z]+)"), Rule("consideration", r"(Rs[.] [0-9,]+/-)"), Rule("extent", r"measuring ([^\n]+?) in ")],
    "patta": [Rule("patta_number", r"(?i)patta (?:no|number)\W*([0-9A-Z-]+)"), Rule("village", r"(?i)for ([^\s]+) village"), Rule("owner_name", r"in the name of ((?:[A-Z]\. )?[A-Z][a-z]+)"), Rule("survey_number", r"(?i)survey ([0-9]+/[0-9A-Z]+)"), Rule("extent", r"extent ([^,\n]+)"), Rule("land_type", r"(wet|dry) land"), Rule("tax", r"assessment (Rs[.] [0-9,]+/-)")],
    "town": [Rule("ward", r"(?i)ward ([0-9]+)"), Rule("block", r"(?i)block ([0-9]+)"), Rule("survey_number", r"(?i)town survey number ([0-9]+/[0-9A-Z]+)"), Rule("old_survey_number", r"(?i)(?:former|old) survey ([0-9]+/[0-9A-Z]+)"), Rule("tenure", r"tenure: ([^.\n]+?) and"), Rule("occupier", r"occupier is ((?:[A-Z]\. )?[A-Z][a-z]+)"), Rule("assessment", r"assessment number ([0-9]+)")],
    "plan": [_label("permit_number", "permit no|sanction no|approval no"), _label("applicant_name", "applicant|owner"), _label("survey_number", "survey no"), _label("plot_details", "plot|site|door"), _label("built_up_area", "built.?up area|plinth area"), _label("fsi", "fsi|floor area ratio"), Rule("authority", r"(?i)\b(CMDA|DTCP|municipality|town panchayat)\b"), _label("approval_date", "approval date|sanction date")],
    "parent": [_label("document_number", "document no|doc no"), Rule("year", r"(?i)(?:year|dated)[^:\n]*[:]\s*[^\n]*?((?:19|20)[0-9]{2})"), _label("survey_number", "survey"), _label("vendor", "vendor|seller"), _label("purchaser", "purchaser|buyer")],
    "rera": [_label("rera_number", "rera no|rera number|rera reg"), _label("project_name", "project name"), _label("promoter_name", "promoter|developer"), _label("validity", "valid|expiry")],
    "tax": [_label("receipt_no", "receipt no|bill no"), _label("consumer_no", "consumer no|service no"), _label("property_id", "assessment|property id"), _label("amount_paid", "amount|paid"), _label("period", "period")],
    "layout": [_label("approval_no", "approval no"), _label("authority", "authority"), _label("layout_name", "layout"), _label("osr_details", "osr|open space")],
    "loan": [_label("loan_account", "loan account|loan a/c"), _label("bank_name", "bank|lender"), _label("mortgage_type", "mortgage type"), _label("loan_amount", "loan amount|sanctioned"), _label("property_description", "property|schedule")],
}


def extract_documents(texts: DataFrame, key: str, text: str, sort: str | None = None) -> DataFrame:
    """Each text by the rules of its sort: ``key, sort, field, value, confidence``.

    ``sort`` names a column that holds the sort; without it the keyword scores decide (T2).
    """
    if sort is None:
        scored = [F.coalesce(keyword_score(F.col(text), words), F.lit(0)) for _, words in SORTS]
        best = F.greatest(*scored)
        named = F.coalesce(*[F.when((s == best) & (best > 0), F.lit(name)) for s, (name, _) in zip(scored, SORTS)], F.lit(SORTS[0][0]))
    else:
        named = F.col(sort)
    kept = texts.filter(F.col(text).isNotNull()).withColumn("_sort", named)
    # One scan: the rules are a fixed table met by the sort; their patterns are values, so that
    # the plan stays small however many rules there are.
    rows = [(name, field, [r.pattern for r in own], float(own[0].confidence)) for name, rules in RULES_BY_SORT.items() for field, own in _by_field(rules).items()]
    table = texts.sparkSession.createDataFrame(rows, "_sort string, field string, patterns array<string>, sure double")
    hits = F.expr(f"filter(transform(patterns, p -> nullif(trim(regexp_extract(`{text}`, p, 1)), '')), v -> v IS NOT NULL)")
    out = kept.select(key, text, "_sort").join(F.broadcast(table), "_sort").withColumn("value", F.try_element_at(hits, F.lit(1)))
    return out.select(key, F.col("_sort").alias("sort"), "field", "value", F.when(F.col("value").isNotNull(), F.col("sure")).otherwise(0.0).alias("confidence"))


def _by_field(rules: list[Rule]) -> dict[str, list[Rule]]:
    fields: dict[str, list[Rule]] = {}
    for rule in sorted(rules, key=lambda r: r.rank):
        fields.setdefault(rule.field, []).append(rule)
    return fields


def heirs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The numbered heirs of a certificate: ``ordinal, name, relationship, age``."""
    pattern = r"(?i)([0-9]{1,2})\.\s*([A-Za-z.\x{0B80}-\x{0BFF} ]+?)\s*[-,|(]\s*(wife|husband|son|daughter|mother|father|மனைவி|கணவர்|மகன்|மகள்|தாய்|தந்தை)\s*[-,|]?\s*(?:age)?\s*([0-9]{1,3})?"
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in range(1, 5)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("ordinal", "name", "relationship", "age"))])
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.inline(zipped))
    return rows.select(key, F.col("ordinal").cast("int").alias("ordinal"), F.trim("name").alias("name"), F.lower("relationship").alias("relationship"), F.col("age").try_cast("int").alias("age")).dropDuplicates([key, "name"])


def all_accounted(rows: DataFrame, key: str, name: str, status: str, words: tuple[str, ...]) -> DataFrame:
    """Members of a group whose status holds one of the words, and who is missing.

    An empty group has no row: nothing to account for is not a pass.
    """
    told = S.contains_any(F.col(status), list(words))
    return rows.groupBy(key).agg(F.count("*").alias("members"), F.count_if(told).alias("accounted"), F.array_join(F.array_sort(F.collect_set(F.when(~told, F.col(name).cast("string")))), ",").alias("missing")).withColumn("complete", F.col("members") == F.col("accounted"))
