"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegrain.llm import abuse, encodings, leaks, lookalikes, mixture, names, pages, personal, places
from titlegrain.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked(table(spark, d, "ec_entry"), table(spark, d, "ec_header"))


def p2_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every page and every note in continuous paragraphs."""
    return pages.repair(pages.register_texts(table(spark, d, "ec_entry"), table(spark, d, "ec")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.noise(pages.register_texts(table(spark, d, "ec_entry"), table(spark, d, "ec")))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every page and every claimants' list with typed placeholders."""
    return personal.redacted(personal.register_texts(table(spark, d, "ec_entry"), table(spark, d, "ec")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.found_types(personal.register_texts(table(spark, d, "ec_entry"), table(spark, d, "ec")))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """The consistent form of every value, once for each record and field."""
    values = lookalikes.register_values(table(spark, d, "ec_entry"), table(spark, d, "ec_header")).filter("value IS NOT NULL")
    return lookalikes.one_form(values).distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    values = lookalikes.register_values(table(spark, d, "ec_entry"), table(spark, d, "ec_header")).filter("value IS NOT NULL")
    return lookalikes.one_form(values, only_imitating=True).select("src", "rec_key", "field_name").distinct()


def p6_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct typed value with its entry, score and margin; unmatched ones have 0."""
    return places.mapping(places.typed_values(table(spark, d, "ec_header")), table(spark, d, "place_ref"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return places.placed(table(spark, d, "ec_header"), table(spark, d, "place_ref"))


def p7_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled record with its chain and the text taken back along it."""
    return encodings.restored(encodings.register_texts(table(spark, d, "ec_entry"), table(spark, d, "ec")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled(encodings.register_texts(table(spark, d, "ec_entry"), table(spark, d, "ec")))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The spans to remove from each document, and the items that leaked into it."""
    return leaks.removal_spans(leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """How often each record is used in the mixture."""
    return mixture.copies(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixture.report(p9_copies(spark, d), table(spark, d, "mix_targets"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document in each category."""
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "abuse_labels"), table(spark, d, "eval_items").select(F.col("item_text").alias("text")))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents and reported shares per source."""
    return abuse.rates(p10_scores(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.reported(p10_scores(spark, d))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_repaired": p2_repaired, "p2_found": p2_found, "p3_redacted": p3_redacted, "p3_found": p3_found, "p4_forms": p4_forms, "p4_found": p4_found, "p6_mapping": p6_mapping, "p6_found": p6_found, "p7_restored": p7_restored, "p7_found": p7_found, "p8_spans": p8_spans, "p8_found": p8_found, "p9_copies": p9_copies, "p9_shares": p9_shares, "p10_scores": p10_scores, "p10_rates": p10_rates, "p10_found": p10_found}

_VALUES = """SELECT 'ec_entry' AS src, concat_ws('#', doc_id, seq) AS rec_key, 'nature' AS field_name, nature AS value FROM ec_entry WHERE nature IS NOT NULL
UNION ALL SELECT 'ec_header', doc_id, 'village', village FROM ec_header WHERE village IS NOT NULL
UNION ALL SELECT 'ec_header', doc_id, 'sro', sro FROM ec_header WHERE sro IS NOT NULL"""
_FORMS = f"WITH batch AS ({_VALUES}), {lookalikes.statement().strip().removeprefix('WITH ')}"

#: Operators that SQL cannot express over whole tables are tested in tests/llm instead.
SQL: dict[str, str] = {
    "p4_forms": f"SELECT DISTINCT * FROM ({_FORMS})",
    "p4_found": f"SELECT DISTINCT src, rec_key, field_name FROM ({_FORMS}) WHERE imitates",
}
