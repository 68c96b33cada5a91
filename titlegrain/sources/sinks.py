"""Sinks: register and key-value CSV, text, JSON lines with a hash split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def register_table(reg: DataFrame) -> DataFrame:
    """K1: the columns of the register's CSV, with fall-backs for the date and the amount."""
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    date = F.coalesce("registration_date", "execution_date", "presentation_date")
    return reg.select("doc_id", "sr", dash(F.col("doc_no")).alias("doc_no"), dash(F.date_format(date, "dd-MMM-yyyy")).alias("date"), dash(F.col("nature")).alias("nature"), dash(F.col("executants")).alias("executants"), dash(F.col("claimants")).alias("claimants"), dash(F.coalesce("consideration", "market_value")).alias("amount"), dash(F.col("survey_no")).alias("survey_no"), dash(F.col("remarks")).alias("remarks"))


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(table: DataFrame, path: str) -> None:
    """K4: JSON lines."""
    table.write.mode("overwrite").json(path)


def key_value_lines(fields: DataFrame, key: str) -> DataFrame:
    """K2, K3: fields as lines ``Title Case: value``; missing values as ``Not Detected``."""
    title = F.initcap(F.regexp_replace("field", "_", " "))
    return fields.select(key, F.concat(title, F.lit(": "), F.coalesce("value", F.lit("Not Detected"))).alias("line"))


def pedigree(chain: DataFrame) -> DataFrame:
    """One text for each unit: the steps of its title in order."""
    step = F.concat(F.lit("Step "), F.col("step").cast("string"), F.lit("/"), F.col("steps").cast("string"), F.lit(": "), F.coalesce("seller", F.lit("-")), F.lit(" -> "), F.coalesce("buyer", F.lit("-")))
    return chain.groupBy("doc_id", "survey_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", step.alias("line")))), lambda s: s["line"]), "\n").alias("pedigree"))


def examples(rows: DataFrame, key: str, prompt: str, answer: str) -> DataFrame:
    """K7: dialogue examples with their part by a hash of the key (80, 10 and 10 per cent), so
    that no example is in two parts."""
    point = F.pmod(F.xxhash64(key), F.lit(10))
    part = F.when(point < 8, "train").when(point == 8, "validation").otherwise("test")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return rows.filter(F.col(prompt).isNotNull() & F.col(answer).isNotNull()).select(key, part.alias("part"), F.to_json(F.struct(F.array(message("user", prompt), message("assistant", answer)).alias("messages"))).alias("line"))
