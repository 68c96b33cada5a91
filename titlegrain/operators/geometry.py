"""Boxes on a page: overlap joins, words in lines, unions, reading order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The overlap of two intervals as a share of the shorter one."""
    common = F.least(a1, b1) - F.greatest(a0, b0)
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when((common > 0) & (shorter > 0), common / shorter).otherwise(F.when(common >= 0, 1.0).otherwise(0.0))


def best_overlap(left: DataFrame, right: DataFrame, page: str, cell: float) -> DataFrame:
    """For each left box (``id, x0, x1, y0, y1, score``) the right box of highest score in the
    same place: a share of heights above .35 or middles nearer than .6 of the greater height, and
    a share of widths above .10 or middles nearer than .7 of the greater width.

    Boxes meet by page and by the rows of a grid (``cell`` high) that they touch, widened by a
    fifth of their height (middles nearer than .6 of the greater height leave a gap below a
    tenth of it): an equi-join in place of all pairs of a page.
    """
    wide = (F.col("y1") - F.col("y0")) * 0.2
    rows = lambda d: d.withColumn("row", F.explode(F.sequence(F.floor((F.col("y0") - wide) / cell), F.floor((F.col("y1") + wide) / cell))))
    a = rows(left)
    b = rows(right).select(page, "row", *[F.col(c).alias(f"r_{c}") for c in ("id", "x0", "x1", "y0", "y1", "score")])

    def near(axis: str, most: float) -> Column:
        a0, a1, b0, b1 = (F.col(f"{side}{axis}{end}") for side in ("", "r_") for end in "01")
        return F.abs(a0 + a1 - b0 - b1) / 2 < most * F.greatest(a1 - a0, b1 - b0)

    v = overlap_share(F.col("y0"), F.col("y1"), F.col("r_y0"), F.col("r_y1"))
    h = overlap_share(F.col("x0"), F.col("x1"), F.col("r_x0"), F.col("r_x1"))
    met = a.join(b, [page, "row"]).filter(((v > 0.35) | near("y", 0.6)) & ((h > 0.10) | near("x", 0.7)))
    return met.groupBy(page, "id").agg(F.max_by("r_id", F.struct("r_score", -F.col("r_id"))).alias("best_id"))


def unmatched(boxes: DataFrame, accepted: DataFrame, page: str, cell: float) -> DataFrame:
    """Boxes that overlap no accepted box of the page and whose text no accepted box holds.

    Every box is compared with the accepted ones only, not with boxes taken before it: the
    result does not depend on an order.
    """
    rows = lambda d: d.withColumn("row", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))))
    b = rows(accepted).select(page, "row", *[F.col(c).alias(f"r_{c}") for c in ("x0", "x1", "y0", "y1")])
    met = rows(boxes).join(b, [page, "row"]).filter((overlap_share(F.col("y0"), F.col("y1"), F.col("r_y0"), F.col("r_y1")) > 0) & (overlap_share(F.col("x0"), F.col("x1"), F.col("r_x0"), F.col("r_x1")) > 0))
    free = boxes.join(met.select(page, "id").distinct(), [page, "id"], "left_anti")
    held = free.join(accepted.select(page, F.col("text").alias("whole")), page).filter(F.lower("whole").contains(F.lower("text"))).select(page, "id").distinct()
    return free.join(held, [page, "id"], "left_anti")


def words_in_lines(words: DataFrame, lines: DataFrame, page: str, slack: float = 3.0) -> DataFrame:
    """Words whose middle lies inside a line's box, with some slack, by page and line row."""
    w = words.withColumn("row", F.floor((F.col("y0") + F.col("y1")) / 2))
    inside = lines.withColumn("row", F.explode(F.sequence(F.floor(F.col("y0") - slack), F.floor(F.col("y1") + slack))))
    inside = inside.select(page, "row", "line_no", F.col("x0").alias("l0"), F.col("x1").alias("l1"))
    return w.join(inside, [page, "row"]).filter((F.col("x0") >= F.col("l0") - slack) & (F.col("x1") <= F.col("l1") + slack)).groupBy(page, "word_no").agg(F.min("line_no").alias("line_no"))


def union_box(words: DataFrame, *by: str) -> DataFrame:
    """The box around all words of a group."""
    return words.groupBy(*by).agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))


def reading_rows(words: DataFrame, page: str, least: float = 8.0) -> DataFrame:
    """W9 in its lag form: a new row begins where the gap to the word above exceeds
    max(8, 0.55 of the page's mean height)."""
    over = Window.partitionBy(page)
    height = F.greatest(F.lit(least), 0.55 * F.avg(F.col("y1") - F.col("y0")).over(over))
    down = over.orderBy("y0", "id")
    return words.withColumn("limit_height", height).withColumn("begins", F.coalesce((F.col("y0") - F.lag("y0").over(down) > F.col("limit_height")).cast("int"), F.lit(1))).withColumn("row", F.sum("begins").over(down)).drop("limit_height", "begins")


def reading_rows_exact(words: DataFrame, page: str, least: float = 8.0) -> DataFrame:
    """Greedy rows by distance to the running mean of the row, a fold by page (pages are small)."""
    schema = words.select(page, "id", "y0", "y1").schema.simpleString()[7:-1].replace(":", " ")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "id"])
        limit = max(least, 0.55 * float((pdf["y1"] - pdf["y0"]).mean()))
        row, mean, n, out = 0, None, 0, []
        for y in pdf["y0"]:
            if mean is None or y - mean > limit:
                row, mean, n = row + 1, y, 1
            else:
                mean, n = (mean * n + y) / (n + 1), n + 1
            out.append(row)
        return pdf.assign(row=out)

    return words.select(page, "id", "y0", "y1").groupBy(page).applyInPandas(fold, f"{schema}, row int")


def split_words(lines: DataFrame, key: str) -> DataFrame:
    """Words of a line with their share of its width, by character offsets (least width 1.2)."""
    words = F.filter(F.split("text", " "), lambda w: w != "")
    parts = lines.withColumn("w", words).select(key, "line_no", "x0", "x1", F.length("text").alias("n"), "text", F.posexplode("w").alias("pos", "word"))
    before = Window.partitionBy(key, "line_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("word") + 1).over(before), F.lit(0))
    scale = (F.col("x1") - F.col("x0")) / F.greatest(F.col("n"), F.lit(1))
    return parts.select(key, "line_no", (F.col("pos") + 1).alias("word_no"), "word", F.round(F.col("x0") + at * scale, 2).alias("x"), F.round(F.greatest(F.length("word") * scale, F.lit(1.2)), 2).alias("w"))
