"""The field envelope ``key, field, value, confidence``: merge, overlay, override, pivot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegrain.nulls import nullify


def envelope(rows: DataFrame, key: str, columns: list[str], confidence: float = 0.9) -> DataFrame:
    """Columns of a wide row as fields; a missing value has NULL and confidence 0."""
    cells = [F.struct(F.lit(c).alias("field"), nullify(F.col(c).cast("string")).alias("value")) for c in columns]
    long = rows.select(key, F.inline(F.array(*cells)))
    return long.withColumn("confidence", F.when(F.col("value").isNull(), 0.0).otherwise(confidence))


def merge(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The base's value where it has one, else the other's; the higher confidence."""
    left = base.select(key, "field", F.col("value").alias("v"), F.col("confidence").alias("c"))
    right = other.select(key, "field", F.col("value").alias("w"), F.col("confidence").alias("d"))
    joined = left.join(right, [key, "field"], "full_outer")
    return joined.select(key, "field", F.coalesce("v", "w").alias("value"), F.greatest(F.coalesce("c", F.lit(0.0)), F.coalesce("d", F.lit(0.0))).alias("confidence"), F.when(F.col("v").isNotNull(), "base").when(F.col("w").isNotNull(), "other").alias("origin"))


def override(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Edited values replace the base's with confidence 1; new fields get a plain name."""
    named = edits.select(key, F.regexp_replace(F.lower("field"), "[^a-z0-9]+", "_").alias("field"), F.col("value").alias("edit"))
    joined = base.join(named, [key, "field"], "full_outer")
    return joined.select(key, "field", F.coalesce("edit", "value").alias("value"), F.when(F.col("edit").isNotNull(), 1.0).otherwise(F.col("confidence")).alias("confidence"), F.col("edit").isNotNull().alias("edited"))


def aliased(fields: DataFrame, key: str, aliases: dict[str, str]) -> DataFrame:
    """Fields under an alias take their main name; of several values the first alias wins."""
    pairs = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    rank = F.create_map(*[F.lit(x) for i, a in enumerate(aliases) for x in (a, i + 1)])
    named = fields.withColumn("main", F.coalesce(pairs[F.col("field")], F.col("field"))).withColumn("rank", F.coalesce(rank[F.col("field")], F.lit(0)))
    kept = named.filter("value IS NOT NULL").groupBy(key, "main").agg(F.min_by(F.struct("value", "confidence"), "rank").alias("f"))
    return kept.select(key, F.col("main").alias("field"), "f.value", "f.confidence")


def wide(fields: DataFrame, key: str, names: list[str]) -> DataFrame:
    """The fields back as columns; a field without a row is NULL."""
    return fields.groupBy(key).agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


def first_known(reg: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each column the first value that is not missing, in order."""
    return reg.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
