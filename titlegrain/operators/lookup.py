"""Lookups in lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegrain.session import small_enough


def nearest_entry(values: DataFrame, col: str, entries: DataFrame, name: str, contained: bool = True) -> DataFrame:
    """The entry equal to a value, else one that holds the value or is held by it, else the
    one of fewest edits, at most max(2, half the entry's length). Of several the one of fewest
    edits, then the first in alphabetical order (a table has no order of a dictionary).

    ``contained=False`` is the narrower rule of the query's SQL: edits only, and half the
    value's length. Values are made distinct first. A list below the broadcast limit goes to
    every task, a larger one is met by all values in a cartesian join: half a word may differ,
    so that no shared piece is certain enough for a key.
    """
    asked = values.select(F.lower(F.trim(F.col(col))).alias("value")).filter("value IS NOT NULL AND value <> ''").distinct()
    listed = entries.select(F.col(name).alias("entry"), F.lower(F.trim(F.col(name))).alias("low")).filter("low <> ''").distinct()
    if small_enough(listed):
        all_ = listed.agg(F.collect_list(F.struct("entry", "low")).alias("list"))
        met = asked.join(F.broadcast(all_)).select("value", F.inline("list"))
    else:
        met = asked.crossJoin(listed)
    held = (F.contains("value", "low") | F.contains("low", "value")) if contained else F.lit(False)
    most = F.greatest(F.lit(2), F.floor(F.length("low" if contained else "value") / 2))
    scored = met.filter(held | (F.abs(F.length("value") - F.length("low")) <= most)).withColumn("edits", F.levenshtein("value", "low")).filter(held | (F.col("edits") <= most))
    return scored.groupBy("value").agg(F.min(F.struct((~held).alias("other"), "edits", "entry")).alias("b")).select("value", "b.entry", "b.edits")
