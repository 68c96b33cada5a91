"""Sources: files, page texts, JSON bodies, example dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id bigint, doc_id string, page_number int, content string"


def uploads(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Uploaded files as ``path, length, content``; sort by extension."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.withColumn("extension", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """Extracted pages from Parquet or JSON lines, with the declared schema."""
    reader = spark.read.schema(PAGE_SCHEMA)
    return reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)


def json_bodies(rows: DataFrame, col: str, schema: str) -> DataFrame:
    """Request bodies by ``from_json``; code fences around the JSON are cut, bad JSON gives NULLs."""
    bare = F.regexp_replace(F.trim(F.col(col)), r"^```[a-z]*\s*|\s*```$", "")
    return rows.withColumn("body", F.from_json(bare, schema))


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Example dialogues from JSON lines."""
    return spark.read.schema("messages array<struct<role: string, content: string>>").json(path)


def register_lines(pages: DataFrame) -> DataFrame:
    """The parts of page texts that name a document, a date or a survey number."""
    return pages.filter("content IS NOT NULL").select("page_id", F.regexp_extract_all("content", F.lit(r"\b([0-9]{1,5}/(?:19|20)[0-9]{2})\b"), F.lit(1)).alias("documents"), F.regexp_extract_all("content", F.lit(r"\b([0-9]{2}-[A-Z][a-z]{2}-[0-9]{4})\b"), F.lit(1)).alias("dates"))
