"""Problem 7: texts decoded with a wrong character encoding.

Method: expectation-maximization with latent encoding chains. A chain is the sequence of
wrong decodings a text went through (none; UTF-8 read as one of several 8-bit code pages,
once or twice; bytes lost for good). Every record that has a character outside ASCII and
Tamil gets a log-likelihood under each chain: the text is taken back along the chain and
judged by a fixed character-class model. The E-step gives each record a posterior over the
chains, the M-step pools the posteriors into chain frequencies per source and field, so
that weak evidence in one record (a single sign) leans on its source. The posterior then
names the garbled records and picks the chain by which each text is restored.

Only likelihood vectors, summed per (source, field, rounded vector), take part in the
iterations; they are checkpointed and read again, never collected.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegrain.session import cut

# The code pages a UTF-8 text may have been read with, and the chains.
PAGES = ("cp1252", "latin-1", "cp437", "cp866", "mac_roman", "cp1251", "cp850", "koi8-r")
CHAINS: tuple[tuple[str, ...], ...] = ((), *((p,) for p in PAGES), ("cp1252", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "latin-1"), ("latin-1", "latin-1"), ("lost",))
NAMES = tuple("+".join(c) or "clean" for c in CHAINS)
ROUNDS, SMOOTH = 5, 0.5
#: Records with none of these characters are clean beyond doubt.
SUSPECT = r"[^\x00-\x7F஀-௿­‐-—]"

# Ordinary signs beyond ASCII and Tamil in this kind of text.
ORDINARY_SIGNS = "–—‘’“”…½¼¾²³°·₹•­‐‑×§"
_C1 = "".join(map(chr, range(0x80, 0xA0)))


@functools.cache
def _undo(page: str) -> Callable[[str], str]:
    """One step back: runs that are UTF-8 read with ``page`` become what they were."""
    table: dict[str, int] = {}
    for byte in range(0x80, 0x100):
        try:
            table[bytes([byte]).decode(page)] = byte
        except UnicodeDecodeError:
            table[chr(byte)] = byte
    if page == "cp1252":
        table |= {chr(byte): byte for byte in range(0x80, 0xA0) if chr(byte) not in table}  # often left as control characters
    group = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"
    follow = group(0x80, 0xBF)
    pattern = re.compile(f"{group(0xC2, 0xDF)}{follow}|{group(0xE0, 0xEF)}{follow}{{2}}|{group(0xF0, 0xF4)}{follow}{{3}}")

    def decode(match: re.Match) -> str:
        try:
            return bytes(table[c] for c in match[0]).decode("utf-8")
        except UnicodeDecodeError:
            return match[0]

    return lambda text: pattern.sub(decode, text)


def take_back(text: str, chain: tuple[str, ...]) -> str:
    for page in chain:
        if page != "lost":
            text = _undo(page)(text)
    return text


@functools.cache
def _cost(sign: str) -> float:
    """Nats for one sign outside ASCII in an ordinary text."""
    code = ord(sign)
    if 0x0B80 <= code <= 0x0BFF:
        return 1.5
    if sign in ORDINARY_SIGNS:
        return 3.0
    if 0xC0 <= code <= 0x17F and sign not in "×÷":
        return 4.0
    if sign == "﻿" or sign == " ":
        return 5.0
    if sign == "�":
        return 30.0
    return 9.0


_ACCENTED = re.compile("[À-ÖØ-öø-ſ]")


def cost(text: str) -> float:
    """The character-class model: the cost of all signs outside ASCII; an accented letter
    beside another sign outside ASCII, or inside no word, costs as a strange one."""
    total = 0.0
    for m in re.finditer(r"[^\x00-\x7f]+", text):
        run = m[0]
        total += sum(map(_cost, run))
        foreign = len(_ACCENTED.findall(run))
        if foreign and len(run) > foreign:
            total += 5.0 * foreign
        elif foreign >= 2:
            total += 3.0 * (foreign - 1)
    return total


def likelihoods(text: str) -> list[float]:
    """Log-likelihood of ``text`` under every chain, relative to the clean one."""
    base = cost(text)
    out = [0.0]
    lost = text.count("�")
    for chain in CHAINS[1:]:
        if chain == ("lost",):
            out.append(27.0 * lost if lost else -20.0)
            continue
        back = take_back(text, chain)
        if back == text or (len(chain) == 2 and back == take_back(text, chain[:1])):
            out.append(-20.0)  # the chain leaves no trace here
        else:
            out.append(base - cost(back) - 1.0 * len(chain))
    return out


def repair(text: str) -> tuple[str, str]:
    """(restored text, chain name) for one text, by likelihood and a flat prior."""
    if text.isascii():
        return text, "clean"
    found = likelihoods(text)
    best = max(range(len(found)), key=found.__getitem__)
    return (take_back(text, CHAINS[best]), NAMES[best]) if found[best] > 0 else (text, "clean")


def _posterior(vector: F.Column, prior: F.Column) -> F.Column:
    joint = F.transform(F.arrays_zip(vector.alias("l"), prior.alias("p")), lambda x: x["l"] + F.log(x["p"]))
    top = F.array_max(joint)
    unnormed = F.transform(joint, lambda x: F.exp(x - top))
    total = F.aggregate(unnormed, F.lit(0.0), lambda a, x: a + x)
    return F.transform(unnormed, lambda x: x / total)


def judged(texts: DataFrame) -> DataFrame:
    """Suspect records of ``src, field_name, rec_key, text`` with ``posterior`` (array by
    ``NAMES``) and the most probable ``chain``.

    NULL and empty texts, ASCII and plain Tamil texts are clean and give no row; repeated
    rows give one row; an empty table gives no row. Long texts are judged whole.
    """
    suspects = texts.select("src", "field_name", "rec_key", "text").filter(F.col("text").rlike(SUSPECT))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Relative to the best chain, rounded and bounded below: what pooling needs.
            raw = [likelihoods(t) for t in batch["text"]]
            batch["ll"] = [[max(-40.0, round(2 * (x - max(v))) / 2) for x in v] for v in raw]
            yield batch[["src", "field_name", "rec_key", "ll"]]

    vectors = cut(suspects.mapInPandas(score, "src string, field_name string, rec_key string, ll array<double>"))
    pooled = vectors.groupBy("src", "field_name", "ll").agg(F.count("*").alias("n"))
    pooled = cut(pooled)
    sizes = texts.filter("text IS NOT NULL").groupBy("src", "field_name").agg(F.count("*").alias("rows"))
    clear = sizes.join(pooled.groupBy("src", "field_name").agg(F.sum("n").alias("suspects")), ["src", "field_name"]).select("src", "field_name", (F.col("rows") - F.col("suspects")).alias("clear"))
    groups = cut(clear)
    # One row per source and field: a handful, fixed by the schema of the caller.
    prior = groups.select("src", "field_name", F.array(F.lit(0.9), *[F.lit(0.1 / (len(CHAINS) - 1))] * (len(CHAINS) - 1)).alias("prior"))
    spark = texts.sparkSession
    for _ in range(ROUNDS):
        weighed = pooled.join(F.broadcast(prior), ["src", "field_name"]).withColumn("post", _posterior(F.col("ll"), F.col("prior")))
        sums = weighed.groupBy("src", "field_name").agg(*[F.sum(F.col("post")[i] * F.col("n")).alias(f"s{i}") for i in range(len(CHAINS))])
        sums = sums.join(groups, ["src", "field_name"])
        counts = [F.col("s0") + F.col("clear"), *[F.col(f"s{i}") for i in range(1, len(CHAINS))]]
        total = sum(counts[1:], counts[0]) + F.lit(SMOOTH * len(CHAINS))
        rows = sums.select("src", "field_name", F.array(*[(c + SMOOTH) / total for c in counts]).alias("prior")).collect()
        prior = spark.createDataFrame(rows, "src string, field_name string, prior array<double>")
    final = vectors.join(F.broadcast(prior), ["src", "field_name"]).withColumn("posterior", _posterior(F.col("ll"), F.col("prior")))
    best = F.array_position(F.col("posterior"), F.array_max("posterior")).cast("int")
    return final.select("src", "field_name", "rec_key", "posterior", F.element_at(F.array(*map(F.lit, NAMES)), best).alias("chain"))


def garbled(texts: DataFrame) -> DataFrame:
    """``src, rec_key`` of the records that are more probably garbled than clean."""
    return judged(texts).filter(F.col("posterior")[0] < 0.5).select("src", "rec_key").distinct()


def restored(texts: DataFrame) -> DataFrame:
    """The garbled records with ``chain``, ``text`` taken back, and ``whole`` (nothing lost)."""
    named = judged(texts).filter(F.col("posterior")[0] < 0.5).select("src", "field_name", "rec_key", "chain").distinct()

    @F.pandas_udf("string")
    def back(text: pd.Series, chain: pd.Series) -> pd.Series:
        return pd.Series([take_back(t, CHAINS[NAMES.index(c)]) for t, c in zip(text, chain)])

    joined = texts.select("src", "field_name", "rec_key", "text").distinct().join(named, ["src", "field_name", "rec_key"])
    out = joined.withColumn("restored", back("text", "chain"))
    return out.withColumn("whole", ~F.col("restored").contains("�"))


def register_texts(entries: DataFrame, pages: DataFrame) -> DataFrame:
    page = pages.select(F.lit("ec").alias("src"), F.lit("content").alias("field_name"), F.col("page_id").cast("string").alias("rec_key"), F.col("content").alias("text"))
    entry = entries.select(F.lit("ec_entry").alias("src"), F.lit("executants").alias("field_name"), F.concat_ws("#", "doc_id", F.col("seq").cast("string")).alias("rec_key"), F.col("executants").alias("text"))
    return page.unionByName(entry)
