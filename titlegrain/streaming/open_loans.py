"""Open loans over an arriving register. An extension: the inventory has no streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from titlegrain.operators.register import is_kind


def loan_events(reg: DataFrame) -> DataFrame:
    """Mortgages by their document and discharges by the documents they refer to."""
    owed = reg.filter(is_kind("mortgage") & F.col("doc_no").isNotNull()).select("doc_id", F.col("doc_no").alias("ref"), "seq", F.lit("mortgage").alias("event"))
    refs = F.explode(F.regexp_extract_all(F.concat_ws(" ", "pr_numbers", "remarks"), F.lit(r"([0-9]{1,6}/[0-9]{4})\b"), F.lit(1)))
    paid = reg.filter(is_kind("discharge")).select("doc_id", refs.alias("ref"), "seq", F.lit("discharge").alias("event"))
    return owed.unionByName(paid)


def open_loans(events: DataFrame) -> DataFrame:
    """State by certificate and document: which side has been seen; a row at each change of status.

    Repeated deliveries change nothing; a discharge that arrives before its mortgage is kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owed, paid = state.get if state.exists else (None, None)
        before = (owed, paid)
        for batch in batches:
            for seq, event in zip(batch["seq"], batch["event"]):
                if event == "mortgage":
                    owed = int(seq) if owed is None else min(owed, int(seq))
                else:
                    paid = int(seq) if paid is None else min(paid, int(seq))
        state.update((owed, paid))
        if (owed, paid) != before and owed is not None:
            yield pd.DataFrame([(key[0], key[1], owed, paid, "closed" if paid is not None else "open")], columns=["doc_id", "ref", "mortgage_seq", "discharge_seq", "status"])

    return events.groupBy("doc_id", "ref").applyInPandasWithState(step, "doc_id string, ref string, mortgage_seq int, discharge_seq int, status string", "owed int, paid int", "update", GroupStateTimeout.NoTimeout)


def daily_counts(entries: DataFrame, late: str = "30 days") -> DataFrame:
    """Entries by day of loading, with a watermark for late loads; runs on streams and on tables."""
    timed = entries.withWatermark("loaded_at", late) if entries.isStreaming else entries
    return timed.groupBy(F.window("loaded_at", "1 day").alias("w")).agg(F.count("*").alias("entries")).select(F.col("w.start").alias("day"), "entries")
