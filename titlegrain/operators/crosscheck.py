"""Checks across the documents of a certificate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.nulls import nullify


def latest_header(headers: DataFrame) -> DataFrame:
    """One row for each certificate: the last delivery."""
    return headers.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in headers.columns if c != "doc_id"]), "loaded_at").alias("h")).select("doc_id", "h.*")


def cross_matrix(headers: DataFrame, reg: DataFrame, pages: DataFrame) -> DataFrame:
    """Checks of each certificate as rows ``doc_id, check_name, status``.

    Each compares two documents; where one of them has nothing to compare the status is
    ``unknown``, never a pass.
    """
    head = latest_header(headers).select("doc_id", "total_entries_declared", nullify(F.col("survey_details")).alias("survey_details"), "search_period_from", "search_period_to", nullify(F.col("applicant_name")).alias("applicant_name"))
    entries = reg.groupBy("doc_id").agg(F.count("*").alias("entries"), F.min("registration_date").alias("first_date"), F.max("registration_date").alias("last_date"), F.count_distinct("survey_no").alias("surveys"))
    sheets = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.max("page_number").alias("last_page"))
    all_ = head.join(entries, "doc_id", "left").join(sheets, "doc_id", "left")
    n = F.coalesce("entries", F.lit(0))
    tell = lambda test: F.when(test.isNull(), "unknown").when(test, "pass").otherwise("fail")
    checks = {
        "declared_total": tell(F.col("total_entries_declared") == n),
        "inside_period": tell((F.col("first_date") >= F.col("search_period_from")) & (F.col("last_date") <= F.col("search_period_to"))),
        "pages_complete": tell(F.col("pages") == F.col("last_page")),
        "survey_named": tell(F.when(F.col("surveys") > 0, F.col("survey_details").isNotNull())),
        "applicant_named": tell(F.col("applicant_name").isNotNull()),
    }
    return all_.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("status")) for k, v in checks.items()])))


def matrix_summary(checks: DataFrame) -> DataFrame:
    """Passed, failed and unknown checks, and whether all that are known passed."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return checks.groupBy("doc_id").agg(count("pass"), count("fail"), count("unknown")).withColumn("clean", (F.col("fail") == 0) & (F.col("pass") > 0))


def survey_check(headers: DataFrame, pages: DataFrame) -> DataFrame:
    """V1: whether the first survey number of the header stands on a page of the certificate;
    if not, the first number/part on its pages as a suggestion."""
    head = latest_header(headers).select("doc_id", S.survey_token(nullify(F.col("survey_details"))).alias("survey")).filter("survey IS NOT NULL")
    # Only the test of each page and its first token are shuffled, never the texts.
    found = pages.filter("content IS NOT NULL").join(head, "doc_id").select(
        "doc_id", "survey", "page_number", F.regexp_replace(F.upper("content"), r"\s", "").contains(F.col("survey")).alias("hit"), F.nullif(F.regexp_extract(F.upper("content"), r"([0-9]{1,4}/[0-9A-Z]+)", 1), F.lit("")).alias("token")
    )
    return found.groupBy("doc_id", "survey").agg(F.max("hit").alias("present"), F.min_by("token", F.when(F.col("token").isNotNull(), F.col("page_number"))).alias("seen")).select("doc_id", "survey", "present", F.when(~F.col("present"), F.col("seen")).alias("suggestion"))


def extent_variance(areas: DataFrame) -> DataFrame:
    """Records with two areas in square feet: the difference in per cent, and whether it is within 5."""
    two = areas.groupBy("src", "rec_key").pivot("field_name", ["extent_ha", "sq_feet"]).agg(F.max("sqft")).filter("extent_ha IS NOT NULL AND sq_feet IS NOT NULL")
    percent = F.round(S.variance_percent(F.col("extent_ha").cast("double"), F.col("sq_feet").cast("double")), 2)
    return two.select("rec_key", "extent_ha", "sq_feet", percent.alias("percent"), (percent <= 5).alias("within"))


def cadastral_totals(areas: DataFrame, patta: DataFrame) -> DataFrame:
    """The sum of the areas of a patta in square feet, and its lines with and without an area."""
    keyed = patta.select("patta_number", F.col("row_id").cast("string").alias("rec_key")).distinct()
    own = areas.filter("field_name = 'extent_ha'").select("rec_key", "sqft")
    return keyed.join(own, "rec_key", "left").groupBy("patta_number").agg(F.count("*").alias("lines"), F.count("sqft").alias("measured"), F.coalesce(F.sum("sqft"), F.lit(0)).alias("sqft"))


def double_sales(reg: DataFrame) -> DataFrame:
    """Two conveyances of one unit by the same seller with no purchase by that seller between them."""
    deeds = reg.filter(S.contains_any(F.col("nature"), ["sale deed", "conveyance", "கிரைய"])).filter("survey_no IS NOT NULL AND executants IS NOT NULL AND claimants IS NOT NULL")
    seller = deeds.select("doc_id", "survey_no", S.party_key(F.try_element_at(S.party_items(F.col("executants")), F.lit(1))).alias("party"), "seq", F.lit(1).alias("sold"))
    buyer = deeds.select("doc_id", "survey_no", S.party_key(F.try_element_at(S.party_items(F.col("claimants")), F.lit(1))).alias("party"), "seq", F.lit(0).alias("sold"))
    by = Window.partitionBy("doc_id", "survey_no", "party").orderBy("seq", "sold")
    both = seller.unionByName(buyer).withColumn("before", F.lag("sold").over(by)).withColumn("before_seq", F.lag("seq").over(by))
    return both.filter("sold = 1 AND before = 1").select("doc_id", "survey_no", "party", F.col("before_seq").alias("first_seq"), F.col("seq").alias("second_seq"))
