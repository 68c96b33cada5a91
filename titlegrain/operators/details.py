"""Smaller operators of the inventory over registers, texts and lists (J12 to J14, F10, F14, W11,
D4, D14, D15, U4, U7, U9, X28, T4, P3, K2, K5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.nulls import nullify
from titlegrain.operators import register as R
from titlegrain.session import small_enough


def coded(rows: DataFrame, on: list[str], codes: DataFrame, name: str) -> DataFrame:
    """A code table met by one or more columns, case and blanks ignored; no entry gives NULL.

    Of several entries of a code the first by name stands. The table is broadcast only while its
    estimated size allows."""
    plain = lambda c: F.lower(F.trim(F.col(c)))
    table = codes.groupBy(*[plain(c).alias(f"_{c}") for c in on]).agg(F.min(name).alias(name))
    keyed = rows.select("*", *[plain(c).alias(f"_{c}") for c in on])
    return keyed.join(F.broadcast(table) if small_enough(table) else table, [f"_{c}" for c in on], "left").drop(*[f"_{c}" for c in on])


def known_institutions(values: DataFrame, col: str, known: DataFrame, name: str) -> DataFrame:
    """``value, institution, confidence``: values that hold the name of a known institution or
    stand in one (confidence 100). The longest name wins, then the first. Short values that stand
    in many names match as well: that is the inventory's rule. Values and names meet by their
    first letters (``register.holding``), not each with each."""
    asked = values.select(F.lower(S.collapse(F.col(col))).alias("value")).filter("value <> ''").distinct()
    listed = known.select(F.lower(S.collapse(F.col(name))).alias("name")).filter("name <> ''").distinct()
    inside = R.holding(listed.select(F.col("name").alias("word")), asked.select(F.col("value").alias("whole"))).select(F.col("whole").alias("value"), F.col("word").alias("name"))
    around = R.holding(asked.select(F.col("value").alias("word")), listed.select(F.col("name").alias("whole"))).select(F.col("word").alias("value"), F.col("whole").alias("name"))
    best = F.min(F.struct((-F.length("name")).alias("n"), "name")).alias("b")
    return inside.unionByName(around).groupBy("value").agg(best).select("value", F.col("b.name").alias("institution"), F.lit(100).alias("confidence"))


def references_kept(reg: DataFrame) -> DataFrame:
    """document references of a certificate that are no number of a power of attorney in it."""
    excluded = reg.filter(R.is_kind("attorney") & F.col("doc_no").isNotNull()).select("doc_id", F.col("doc_no").alias("ref")).distinct()
    return R.references(reg).join(excluded, ["doc_id", "ref"], "left_anti")


def attorney_entries(reg: DataFrame) -> DataFrame:
    """entries whose nature or parties speak of a power of attorney, and where."""
    words = ["power of attorney", "power agent", "poa", "பொது அதிகார", "முகவர்"]
    places = F.array_compact(F.array(*[F.when(S.contains_any(F.col(c), words), F.lit(c)) for c in ("nature", "executants", "claimants")]))
    return reg.select("doc_id", "seq", F.array_join(places, ",").alias("places")).filter("places <> ''")


def longest_reference(reg: DataFrame) -> DataFrame:
    """T4: of an entry's references the longest, among equals the first."""
    text = F.concat_ws(" ", "pr_numbers", "remarks")
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{1,6}/[0-9]{2,4})\b"), F.lit(1))
    placed = F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("ref")))
    return reg.select("doc_id", "seq", F.array_min(placed)["ref"].alias("ref")).filter("ref IS NOT NULL")


def blank_page(mean: Column, deviation: Column) -> Column:
    """whether the grey values of a page tell an empty one; NULL statistics are not blank."""
    return F.coalesce(((mean > 240) & (deviation < 32)) | ((mean > 215) & (deviation < 26)) | ((mean > 185) & (deviation < 14)), F.lit(False))


def numbered_groups(rows: DataFrame, key: str, order: str, line: str) -> DataFrame:
    """Lines grouped by a leading number: ``1. A``, then its continuation lines, up to the next
    number. Lines before the first number form group 0 without a number."""
    begins = F.coalesce(F.col(line).rlike(r"^\s*[0-9]+[.)\s-]"), F.lit(False))
    by = Window.partitionBy(key).orderBy(order)
    grouped = rows.withColumn("number", F.when(begins, F.regexp_extract(line, r"^\s*([0-9]+)", 1))).withColumn("rest", F.when(begins, F.trim(F.regexp_replace(F.col(line), r"^\s*[0-9]+[.)\s-]+", ""))).otherwise(F.trim(line))).withColumn("grp", F.sum(begins.cast("int")).over(by))
    words = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("rest").alias("r")))), lambda x: x["r"])
    text = F.array_join(F.filter(words, lambda w: w != ""), " ")
    return grouped.groupBy(key, "grp").agg(F.max("number").alias("number"), F.min(order).alias("first_line"), text.alias("text"))


# Months as written, by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def date_in_words(col: Column) -> Column:
    """The first ``12th day of March, 2004`` (or ``12 March 2004``) of a text as a DATE; NULL
    where there is none or where it is no day of the calendar."""
    pattern = r"(?i)\b([0-9]{1,2})\s*(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+([0-9]{4})\b"
    day, month, year = (F.regexp_extract(col, pattern, i) for i in (1, 2, 3))
    number = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(month))
    return F.try_to_date(F.concat_ws("-", year, F.lpad(number.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


# Words of a structure in remarks, with what they mean.
STRUCTURES = [("காலிமனை", "vacant"), ("vacant", "vacant"), ("கட்டியுள்ள வீடு", "house"), ("கட்டிடம்", "building"), ("building", "building"), ("அடுக்குமாடி", "flat"), ("apartment", "flat"), ("வணிக", "commercial"), ("வீட்டுமனை", "house site"), ("house site", "house site"), ("தொழிற்சாலை", "industrial")]


def share_fraction(col: Column) -> Column:
    """The fraction of an undivided share, ``1/3 UDS``, ``153/5867 undivided``; NULL without one."""
    return F.nullif(F.regexp_extract(col, r"(?i)([0-9]+/[0-9]+)(?:th)?\s*(?:UDS|undivided|share|பிரிபடாத\s*பாகம்|பாகம்)", 1), F.lit(""))


def is_undivided(col: Column) -> Column:
    """Whether a text speaks of an undivided share of land."""
    return S.contains_any(col, ["uds", "undivided share", "பிரிக்கப்படாத", "பிரிபடாத"])


def structures(col: Column) -> Column:
    """The sorts of structure a text names, once each, in the order of the list, by commas."""
    low = F.lower(F.coalesce(col, F.lit("")))
    return F.array_join(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.lit(kind)) for w, kind in STRUCTURES]))), ",")


def rounded_boxes(boxes: DataFrame, places: int = 2) -> DataFrame:
    """Edges of boxes rounded half up, confidences to four places where there are any."""
    edges = {c: F.round(c, places) for c in ("x0", "x1", "y0", "y1")}
    return boxes.withColumns(edges | ({"confidence": F.round("confidence", 4)} if "confidence" in boxes.columns else {}))


def known_boundaries(reg: DataFrame, headers: DataFrame) -> DataFrame:
    """U4: the boundaries of a certificate: the header's, else those of its schedules in register
    order, the first distinct five (a fixed number of a list shown)."""
    own = R.first_distinct(reg, "boundaries", 5).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("listed"))
    head = headers.select("doc_id", nullify(F.col("requested_boundaries")).alias("asked"))
    joined = head.join(own, "doc_id", "full_outer")
    return joined.select("doc_id", F.coalesce(F.when(F.col("asked").isNotNull(), F.array("asked")), F.col("listed"), F.array().cast("array<string>")).alias("boundaries"))


def parties_once(rows: DataFrame) -> DataFrame:
    """Of a list's parties equal but for case the first stays."""
    return rows.groupBy("doc_id", "seq", "side", F.lower("party").alias("low")).agg(F.min_by(F.struct("ordinal", "party"), "ordinal").alias("p")).select("doc_id", "seq", "side", "p.*")


def on_both_sides(reg: DataFrame) -> DataFrame:
    """Entries with a party among executants and claimants alike, and how many."""
    keys = lambda c: F.transform(F.coalesce(S.party_items(F.col(c)), F.array().cast("array<string>")), lambda p: S.party_key(p))
    both = reg.select("doc_id", "seq", F.size(F.filter(F.array_intersect(keys("executants"), keys("claimants")), lambda k: k != "")).alias("n"))
    return both.filter("n > 0")


def without_address(col: Column) -> Column:
    """A party without age, residence, door number and what follows; parentage stays."""
    text = S.collapse(col)
    text = F.regexp_replace(text, r"(?i)(?:,\s*|\s+)(?:aged\s+(?:about\s+)?[0-9a-z ]+|(?:all\s+)?residing(?:\s+at)?|r/o)\b.*$", "")
    text = F.regexp_replace(text, r"(?i),?\s*\b(?:door\s*no|flat\s*no|old\s*door|new\s*door|plot\s*no|no)\b\.?\s*[0-9].*$", "")
    return F.regexp_replace(text, r"[\s,]+$", "")


def attorney_name(col: Column) -> Column:
    """The agent of a power of attorney: what stands before ``son of``, age, address or office."""
    text = F.regexp_replace(S.collapse(col), r"[•~_'\"`^]+", " ")
    cut = F.regexp_replace(text, r"(?i)[\s,]*\b(?:son of|s/o|wife of|w/o|daughter of|d/o|aged|residing|door\s*no|no\.?\s*[0-9]|having its|managing director|director|partner|proprietor)\b.*$", "")
    return F.nullif(S.collapse(F.regexp_replace(cut, r"[^A-Za-z0-9\x{0B80}-\x{0BFF}.\s()&/-]", "")), F.lit(""))


def report_table(fields: DataFrame, key: str, private: tuple[str, ...] = ()) -> DataFrame:
    """K5: the table of a report: a row per field with its title, value, confidence in per cent and
    a mark for doubtful ones (below 60); private and structural fields stay out."""
    kept = fields.filter(~F.col("field").isin(*private) & ~F.col("field").startswith("_")) if private else fields.filter(~F.col("field").startswith("_"))
    percent = F.round(F.col("confidence") * 100, 0).cast("int")
    return kept.select(key, F.initcap(F.regexp_replace("field", "_", " ")).alias("title"), F.coalesce("value", F.lit("Not Detected")).alias("value"), percent.alias("percent"), (percent < 60).alias("review"))


def key_value_table(fields: DataFrame, key: str, parts: str | None = None) -> DataFrame:
    """K2: rows ``field, value, confidence`` for a CSV; a field whose ``parts`` column holds a map
    gives one row per entry, ``field.sub``; a field without a confidence counts as 1.0."""
    sure = F.coalesce(F.col("confidence"), F.lit(1.0))
    plain = fields.select(key, "field", F.coalesce("value", F.lit("Not Detected")).alias("value"), sure.alias("confidence"), *([parts] if parts else []))
    if not parts:
        return plain
    split = plain.filter(F.size(parts) > 0).select(key, F.col("field").alias("f"), "confidence", F.explode(parts).alias("sub", "value")).select(key, F.concat_ws(".", "f", "sub").alias("field"), "value", "confidence")
    return plain.filter(F.coalesce(F.size(parts), F.lit(0)) <= 0).drop(parts).unionByName(split)


def summary_fields(reg: DataFrame, headers: DataFrame, spans: DataFrame, gaps: DataFrame, loans: DataFrame, holders: DataFrame) -> DataFrame:
    """The summary of each certificate as fields ``doc_id, field, value``.

    ``headers`` has a row per certificate; the others are results of ``register``. Every part is
    one aggregated row per certificate before it is joined; a certificate without entries has
    its header's fields and noughts."""
    kinds = {"conveyances": "conveyance", "mortgage_deeds": "mortgage", "discharge_deeds": "discharge", "court_entries": "court", "rectifications": "rectification", "leases": "lease", "family_deeds": "family", "attorney_deeds": "attorney"}
    counts = reg.groupBy("doc_id").agg(
        F.count("*").alias("entries"),
        *[F.count_if(R.is_kind(k)).alias(n) for n, k in kinds.items()],
        F.count_distinct("survey_no").alias("surveys"),
        F.count_distinct("village_street").alias("places"),
        F.sum("consideration_amt").alias("consideration_total"),
        F.max("market_value_amt").alias("market_value_most"),
        F.max_by(F.struct("doc_no", "nature"), "seq").alias("l"),
        F.max(S.contains_any(F.col("remarks"), ["uds", "undivided share"])).alias("undivided"),
    )
    n = gaps.groupBy("doc_id").agg(F.count("*").alias("gaps"), F.sum("missing").alias("missing_serials"))
    all_ = headers.join(counts, "doc_id", "left").join(n, "doc_id", "left").join(spans.select("doc_id", "first_date", "last_date", F.col("years").alias("observed_years")), "doc_id", "left")
    all_ = all_.join(loans.select("doc_id", F.col("open").alias("open_loans"), F.col("closed").alias("closed_loans")), "doc_id", "left").join(holders.select("doc_id", F.col("holder").alias("current_owner"), F.col("doc_no").alias("owner_document"), F.col("role").alias("owner_role")), "doc_id", "left")
    all_ = all_.select("*", F.col("l.doc_no").alias("last_document"), F.col("l.nature").alias("last_nature"))
    told = ["sro", "certificate_no", "application_no", "applicant_name", "village", "zone", "district", "survey_details", "requested_extent", "requested_door_no", "requested_boundaries", "form_type"]
    dates = ["certificate_date", "data_available_from", "data_available_to", "search_period_from", "search_period_to", "first_date", "last_date"]
    numbers = ["entries", *kinds, "surveys", "places", "gaps", "missing_serials", "open_loans", "closed_loans"]
    rest = ["total_entries_declared", "observed_years", "consideration_total", "market_value_most", "current_owner", "owner_document", "owner_role", "last_document", "last_nature"]
    days = F.datediff("search_period_to", "search_period_from") / F.lit(365.25)
    status = F.when(days.isNull(), "unspecified").when(days < 30, "short").otherwise("full")
    cells = [F.struct(F.lit(c).alias("field"), v.cast("string").alias("value")) for c, v in [*((c, nullify(F.col(c))) for c in told), *((c, F.col(c)) for c in dates), *((c, F.coalesce(F.col(c), F.lit(0))) for c in numbers), *((c, F.col(c)) for c in rest), ("period_status", status), ("undivided", F.coalesce("undivided", F.lit(False)))]]
    return all_.select("doc_id", F.inline(F.array(*cells)))
