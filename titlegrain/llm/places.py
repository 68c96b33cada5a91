"""Problem 6: freely typed values mapped to the closest entry of a reference list.

Method: distinct values are normalised (one form of look-alike characters, lower case,
administrative words and abbreviations removed or written out), candidates come from an
inverted index of character n-grams (2 and 3 characters of the text and of its consonant
skeleton), are scored by the cosine of inverse-document-frequency weights, and the ``SCORED``
best ones above ``THRESHOLD`` go on to an exact check of their edits. The best of those that
pass is accepted if its cosine, less its share of edits, has a margin over the second place.

Plan: values are deduplicated before any n-gram is made; weights are counted over the whole list
in Spark; the index is broadcast in blocks of at most ``BLOCK`` forms (one for any list up to that
size, more are searched one after another and their candidates united), so that its size is
bounded. A value adds up the postings of its n-grams in numpy and leaves its task with at most
``SCORED`` rows a block.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegrain.llm import lookalikes
from titlegrain.nulls import missing
from titlegrain.session import small_enough

#: Acceptance: least cosine of a candidate, candidates that are checked exactly, least distance
#: to the second place; the exact check: most edits, most edits as a share of the longer text.
THRESHOLD, SCORED, MARGIN, EDITS, SHARE = 0.08, 10, 0.05, 3, 0.3
#: Most forms of the reference list in one broadcast block of the index.
BLOCK = 100_000

# Words that only name the kind of a place, and abbreviations written out.
KIND_WORDS = r"\b(?:village|vill|vlg|gramam|kiramam|post|district|dist|dt|mavattam|zone|regn|region|mandalam|taluk|town|v|d|z)\b"
ABBREVIATIONS = [
    (r"\bn *$", "north"),
    (r"\bs *$", "south"),
    (r"\be *$", "east"),
    (r"\bw *$", "west"),
    (r"\b(?:c|cent|centr) *$", "central"),
    (r"pkm\b", "pakkam"),
    (r"thr\b", "thurai"),
    (r"(?<!p)plm\b", "palayam"),
    (r"prm\b", "puram"),
    (r"kpm\b", "kuppam"),
    (r"mglm\b", "mangalam"),
    (r"nlr\b", "nallur"),
    (r"pet\b|ptt\b", "pettai"),
]


def plain(col: Column) -> Column:
    """Lower case words without administrative ones, the direction last; digits become ``#``."""
    text = F.lower(col)
    text = F.translate(text, "àâäèéêëîïôöùûüç", "aaaeeeeiioouuuc")
    text = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}]+", " ")
    text = F.regexp_replace(text, r"\p{N}", "#")
    text = F.regexp_replace(text, KIND_WORDS, " ")
    for pattern, word in ABBREVIATIONS:
        text = F.regexp_replace(text, pattern, word)
    text = F.trim(F.regexp_replace(text, " +", " "))
    return F.regexp_replace(text, "^(north|south|east|west|central) (.+)$", "$2 $1")


def folded(text: Column) -> Column:
    """A plain text with long vowels and doubled letters made short."""
    for pattern, to in ((r"aa+", "a"), (r"oo+", "u"), (r"ee+", "i"), (r"([a-z])\1+", "$1")):
        text = F.regexp_replace(text, pattern, to)
    return text


def grams(col: Column) -> Column:
    """Distinct n-grams: of the padded text (2 and 3 characters) and of its skeleton (2 and 3)."""
    padded = F.concat(F.lit("^"), col, F.lit("$"))
    bones = F.concat(F.lit("^"), F.regexp_replace(col, "[aeiou ]", ""), F.lit("$"))

    def cut(text: Column, n: int, mark: str) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))

    return F.array_distinct(F.concat(cut(padded, 2, "2"), cut(padded, 3, "3"), cut(bones, 2, "k"), cut(bones, 3, "b")))


def edits(a: Column, b: Column) -> Column:
    """Least of: edits of the texts; edits of the folded texts plus one, where at most one
    is left; 2 for equal consonant skeletons (a name typed without its vowels)."""
    bones = lambda x: F.regexp_replace(folded(x), "[aeiou ]", "")
    same = (bones(a) == bones(b)) & (F.length(bones(a)) >= 4)
    short = F.levenshtein(folded(a), folded(b))
    return F.least(F.levenshtein(a, b), F.when(short <= 1, short + 1), F.when(same, 2))


def typed_values(headers: DataFrame, fields: tuple[str, ...] = ("district", "village", "zone")) -> DataFrame:
    """``doc_id, field_name, value`` of the non-missing values."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in fields]))
    return headers.select("doc_id", pairs).filter(~missing(F.col("value")))


class Index:
    """The n-gram index of one block: postings, weights and norms by kind of place."""

    def __init__(self, rows: list, sizes: dict[str, int]):
        self.sizes = sizes
        self.kinds: dict[str, tuple[dict, dict, np.ndarray, list]] = {}
        for row in rows:
            postings, weights, norms, entries = self.kinds.setdefault(row["field_name"], ({}, {}, [], []))
            for gram in row["grams"]:
                postings.setdefault(gram["gram"], []).append(len(entries))
                weights[gram["gram"]] = gram["w"]
            norms.append(row["entry_norm"])
            entries.append((row["place_id"], row["norm"]))
        self.kinds = {k: ({g: np.array(x) for g, x in p.items()}, w, np.array(n), e) for k, (p, w, n, e) in self.kinds.items()}

    def best(self, kind: str, grams: list[str]) -> list[tuple[int, str, float]]:
        """(place, form, cosine) of the best forms, at most ``SCORED``, from ``THRESHOLD`` on."""
        if kind not in self.kinds:
            return []
        postings, weights, norms, entries = self.kinds[kind]
        unknown = np.log1p(2.0 * self.sizes[kind])  # as a gram of half an entry
        total, hits, heat = 0.0, [], []
        for gram in grams:
            w = weights.get(gram)
            total += (unknown if w is None else w) ** 2
            if w is not None:
                hits.append(postings[gram])
                heat.append(w * w)
        if not hits:
            return []
        dots = np.bincount(np.concatenate(hits), np.repeat(heat, [len(h) for h in hits]), len(norms))
        cosine = dots / (norms * np.sqrt(total))
        order = np.lexsort((np.arange(len(cosine)), -cosine))[:SCORED] if len(cosine) <= 4 * SCORED else None
        if order is None:
            # every form as good as the last one kept, so that ties do not depend on the order
            least = np.partition(cosine, -SCORED)[-SCORED]
            order = np.flatnonzero(cosine >= max(least, THRESHOLD))
        return [(*entries[i], float(cosine[i])) for i in order if cosine[i] >= THRESHOLD]


def weighed(entries: DataFrame) -> DataFrame:
    """``field_name, place_id, norm, grams, entry_norm`` of every form, with the weight of each n-gram
    by how many forms of the kind in the whole list have it."""
    postings = entries.select("field_name", "place_id", "norm", F.explode(grams(folded(F.col("norm")))).alias("gram"))
    counts = entries.groupBy("field_name").agg(F.count("*").alias("n"))
    weights = postings.groupBy("field_name", "gram").agg(F.count("*").alias("df")).join(counts, "field_name").select("field_name", "gram", F.log1p(F.col("n") / F.col("df")).alias("w"))
    return postings.join(weights, ["field_name", "gram"]).groupBy("field_name", "place_id", "norm").agg(F.collect_list(F.struct("gram", "w")).alias("grams"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_norm"))


def mapping(values: DataFrame, places: DataFrame) -> DataFrame:
    """One row per distinct ``field_name, value``: ``place_id`` (0: unmatched), ``score``, ``margin``.

    Missing values have no row; an empty reference list leaves every value unmatched;
    equal scores of two places leave the value unmatched (no margin).
    """
    spark = values.sparkSession
    forms = places.select("place_id", F.col("place_kind").alias("field_name"), F.explode(F.array("place_name", "name_ta", "former_name")).alias("form")).filter(~missing(F.col("form")))
    entries = forms.select("place_id", "field_name", plain(F.col("form")).alias("norm")).filter("norm <> ''").distinct()
    sizes = {r["field_name"]: r["count"] for r in entries.groupBy("field_name").count().collect()}  # a row per kind of place
    distinct = values.select("field_name", "value").distinct()
    formed = lookalikes.one_form(distinct).drop("imitates")
    # The few bytes of distinct values cost much each: spread them by number.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    query = formed.repartition(parts).select("field_name", "value", plain(F.col("canonical")).alias("asked"))
    asked = query.withColumn("grams", grams(folded(F.col("asked"))))
    blocks = max(1, -(-sum(sizes.values()) // BLOCK))
    block = F.pmod(F.xxhash64("place_id", "norm"), F.lit(blocks))
    schema = "field_name string, value string, asked string, place_id int, norm string, score double"
    table = weighed(entries)
    found = []
    for b in range(blocks):
        known = spark.sparkContext.broadcast(Index(sorted(table.filter(block == b).collect(), key=lambda r: (r["field_name"], r["place_id"], r["norm"])), sizes))

        def run(batches: Iterator[pd.DataFrame], known=known) -> Iterator[pd.DataFrame]:
            index = known.value
            for batch in batches:
                rows = [(f, v, a, *hit) for f, v, a, g in zip(batch["field_name"], batch["value"], batch["asked"], batch["grams"]) for hit in index.best(f, g)]
                yield pd.DataFrame(rows, columns=["field_name", "value", "asked", "place_id", "norm", "score"])

        found.append(asked.mapInPandas(run, schema))
    scored = (
        functools.reduce(DataFrame.unionByName, found)
        .withColumn("edits", edits(F.col("asked"), F.col("norm")))
        .withColumn("share", F.col("edits") / F.greatest(F.length("asked"), F.length("norm"), F.lit(1)))
        .withColumn("rank", F.col("score") - F.col("share"))
    )
    per_place = scored.groupBy("field_name", "value", "place_id").agg(F.max(F.struct("rank", "score", "edits", "share")).alias("s"))
    ranked = per_place.groupBy("field_name", "value").agg(F.slice(F.sort_array(F.collect_list(F.struct("s.rank", "s.score", "s.edits", "s.share", "place_id")), asc=False), 1, 2).alias("top"))
    best, second = F.col("top")[0], F.coalesce(F.try_element_at("top", F.lit(2))["rank"], F.lit(-1.0))
    accepted = (best["rank"] - second >= MARGIN) & (best["edits"] <= EDITS) & (best["share"] <= SHARE)
    decided = ranked.select("field_name", "value", F.when(accepted, best["place_id"]).otherwise(0).alias("place_id"), F.round(best["score"], 4).alias("score"), F.round(best["rank"] - second, 4).alias("margin"), best["edits"].alias("edits"), F.round(best["share"], 3).alias("share"), best["place_id"].alias("nearest"))
    whole = distinct.join(decided, ["field_name", "value"], "left")
    return whole.withColumn("place_id", F.coalesce("place_id", F.lit(0)))


def placed(headers: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, field_name, place_id`` of values that are not exactly a name of their kind."""
    typed = typed_values(headers)
    exact = places.select(F.col("place_kind").alias("field_name"), F.col("place_name").alias("value")).distinct()
    loose = typed.join(F.broadcast(exact) if small_enough(places) else exact, ["field_name", "value"], "left_anti")
    found = mapping(loose, places).select("field_name", "value", "place_id")
    return loose.join(found, ["field_name", "value"]).select("doc_id", "field_name", F.col("place_id").cast("int").alias("place_id")).distinct()
