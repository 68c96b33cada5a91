"""Checks over bundles of documents in long form ``bundle_id, doc_role, key, value``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.nulls import nullify
from titlegrain.operators.display import extent_by_check, land_flag

# The keys under which a document tells a value, the first one known wins.
SELLER = ("vendor_details", "executant_seller", "executant_vendor")
OWNER = ("pattadhar_name", "owner_name", "tslr_registered_owner")
DEED_SURVEY = ("survey_number", "survey_subdivision_no")
REVENUE_SURVEY = ("survey_numbers", "survey_number", "tslr_town_survey_no", "survey_and_subdivision")
DEED_EXTENT = ("land_extent", "extent_area", "extent")
REVENUE_EXTENT = ("extent_details", "extent", "extent_area", "land_extent")
# What tells an encumbrance, a broken chain, an heir accounted for.
ENCUMBERED, BROKEN, ACCOUNTED = ["court attachment", "active mortgage"], ["failed", "fake"], ["signatory", "release", "poa", "consented", "party"]


def _told(known: Column, test: Column) -> Column:
    return F.when(F.coalesce(known, F.lit(False)), F.when(F.coalesce(test, F.lit(False)), "pass").otherwise("fail")).otherwise("unknown")


def matrix(bundle: DataFrame) -> DataFrame:
    """Seven checks of each bundle, ``bundle_id, check_name, status``.

    ``ownership``: a word over two letters of the seller stands in the revenue record's owner;
    ``survey``: one survey number holds the other; ``extent``: within 5 per cent; ``encumbrance``:
    the certificate tells of no attachment or open mortgage; ``chain``: the parent documents are
    not called broken; ``land``: the land is not public; ``double_sale``: no unit sold twice.
    The revenue record is the patta, or the town survey extract where there is no patta. A check
    with nothing to compare is ``unknown``; an empty bundle passes none. One row per bundle is
    aggregated from the long form (partial maxima, no collected lists).
    """
    value = nullify(F.col("value"))
    one = lambda role, key: F.max(F.when((F.col("doc_role") == role) & (F.col("key") == key), value))
    pick = lambda role, keys: F.coalesce(*[one(role, k) for k in keys])
    has_patta = F.max(F.col("doc_role") == "patta")
    revenue = lambda keys: F.when(has_patta, pick("patta", keys)).otherwise(pick("tslr", keys))
    wide = bundle.groupBy("bundle_id").agg(
        S.name_normal(pick("sale_deed", SELLER)).alias("seller"),
        S.name_normal(revenue(OWNER)).alias("owner"),
        S.survey_normal(pick("sale_deed", DEED_SURVEY)).alias("deed_survey"),
        S.survey_normal(revenue(REVENUE_SURVEY)).alias("revenue_survey"),
        extent_by_check(pick("sale_deed", DEED_EXTENT)).alias("deed_area"),
        extent_by_check(revenue(REVENUE_EXTENT)).alias("revenue_area"),
        F.max(F.when(F.col("doc_role") == "ec", S.contains_any(F.col("value"), ENCUMBERED))).alias("encumbered"),
        one("parent_docs", "last_5_years_validation").alias("chain"),
        F.coalesce(one("a_register", "land_classification"), revenue(("land_classification",))).alias("land"),
        one("ec", "double_sales").try_cast("int").alias("twice"),
    )
    words = F.filter(F.split("seller", " "), lambda w: F.length(w) > 2)
    checks = {
        "ownership": _told((F.col("owner") != "") & (F.size(words) > 0), F.exists(words, lambda w: F.contains("owner", w))),
        "survey": _told((F.col("deed_survey") != "") & (F.col("revenue_survey") != ""), F.contains("deed_survey", "revenue_survey") | F.contains("revenue_survey", "deed_survey")),
        "extent": _told((F.col("deed_area") > 0) & (F.col("revenue_area") > 0), S.variance_percent(F.col("deed_area"), F.col("revenue_area")) <= 5),
        "encumbrance": _told(F.col("encumbered").isNotNull(), ~F.col("encumbered")),
        "chain": _told(F.col("chain").isNotNull(), ~S.contains_any(F.col("chain"), BROKEN)),
        "land": _told(F.col("land").isNotNull(), ~land_flag(F.col("land"))),
        "double_sale": _told(F.col("twice").isNotNull(), F.col("twice") == 0),
    }
    return wide.select("bundle_id", F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("status")) for k, v in checks.items()])))


def matrix_overall(checks: DataFrame) -> DataFrame:
    """Passed checks, red flags, unknown ones, and the overall result (never a pass of nothing)."""
    counted = checks.groupBy("bundle_id").agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("pass", "passed"), ("fail", "red_flags"), ("unknown", "unknown"))])
    return counted.withColumn("overall", F.when(F.col("red_flags") > 0, "action required").when(F.col("passed") > 0, "pass").otherwise("unknown"))


def inheritance(heirs: DataFrame, deceased: DataFrame, mutation: DataFrame) -> DataFrame:
    """Of each bundle whether the deceased is one person in the death certificate, the
    heirs' certificate (equal names) and the patta (one name holds the other), whether every heir
    is accounted for, and whether the patta is mutated. A pending mutation blocks the rest.

    ``heirs(bundle_id, name, status)``: equal names but for case are one heir, accounted for if
    any of its rows is; ``deceased(bundle_id, source, name)`` with sources ``death``, ``heir``,
    ``patta``; ``mutation(bundle_id, status)``. What is missing is ``unknown``, never a pass.
    """
    told = heirs.filter("name IS NOT NULL").groupBy("bundle_id", F.lower("name").alias("name")).agg(F.max(S.contains_any(F.col("status"), ACCOUNTED)).alias("told"))
    family = told.groupBy("bundle_id").agg(F.count("*").alias("heirs"), F.count_if("told").alias("accounted"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("told"), F.col("name")))), ",").alias("missing"))
    name = lambda s: S.name_normal(F.max(F.when(F.col("source") == s, F.col("name")))).alias(s)
    person = deceased.groupBy("bundle_id").agg(name("death"), name("heir"), name("patta"))
    gate = mutation.groupBy("bundle_id").agg(F.max("status").alias("m"))
    all_ = person.join(family, "bundle_id", "full_outer").join(gate, "bundle_id", "full_outer")
    known = (F.col("death") != "") & (F.col("heir") != "") & (F.col("patta") != "")
    identity = _told(known, (F.col("death") == F.col("heir")) & (F.contains("patta", "death") | F.contains("death", "patta")))
    complete = _told(F.col("heirs").isNotNull(), F.col("heirs") == F.col("accounted"))
    mutated = _told(F.col("m").isNotNull(), S.contains_any(F.col("m"), ["mutated"]) & ~S.contains_any(F.col("m"), ["pending", "not mutated"]))
    overall = F.when(F.col("mutation") == "fail", "blocked").when(F.col("complete") == "fail", "missing heirs").when((F.col("complete") == "unknown") | (F.col("mutation") == "unknown"), "unknown").otherwise("pass")
    rows = all_.select("bundle_id", identity.alias("identity"), F.coalesce("heirs", F.lit(0)).alias("heirs"), F.coalesce("accounted", F.lit(0)).alias("accounted"), F.coalesce("missing", F.lit("")).alias("missing"), complete.alias("complete"), mutated.alias("mutation"))
    return rows.withColumn("overall", overall)
