"""Problem 9: mixing sources to target weights.

Method: soft-membership mixing. A classifier fitted on a bounded labelled sample (rows with
their source) predicts each document's posterior over the sources; the record's own label is
one more piece of evidence, weighed by how far labels agree with texts in the sample (a channel
from domains to labels, estimated by expectation-maximization on rows held out from the fit). Distributed projected
gradient least squares then fits a rate for every document, between 0 and the most repeats
of its source, so that the expected token totals of the sources match the targets. Rates
become whole copies by a hash of the document, so that a rerun gives the same mixture.

Plan: one pass over the texts makes a compact table (tokens, posterior, most repeats),
which is checkpointed; an iteration is one pass over it that returns nine sums. A rate is
a function of the document's row and of the short history of residuals, so that no rate is
stored or shuffled between iterations. Only sums per source ever reach the driver.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from titlegrain.session import cut

#: Labelled rows fitted per source (drawn by hash), hashed words, iterations, sharpness of the
#: words' evidence, rounds of the channel's estimation, and the longest row the classifier is
#: fitted on, in characters (all rows are measured and rated whole).
LABELLED, BUCKETS, ROUNDS, SHARPNESS, CHANNEL, LONGEST = 500, 1 << 14, 12, 4.0, 30, 20_000
#: Where the public tokenizers lie, and the one that measures.
TOKENIZERS, TOKENIZER = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

# Fixed value: the pattern that splits text before the merges of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_WORDS = re.compile(r"[^\W\d_]{2,}")


def counter(folder: str = TOKENIZERS, name: str = TOKENIZER):
    """A function from texts to token counts, by a public byte-level tokenizer."""
    import tiktoken

    with Path(folder, name).open("rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(coding.encode_ordinary(t)) for t in texts]


def _bucket(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


def _words(text: str) -> set[int]:
    return {_bucket(w) for w in set(_WORDS.findall(text.lower()))}


def _fit(found: list[list[int]], labels: np.ndarray, k: int) -> np.ndarray:
    """Log weights (word, source) of naive Bayes."""
    counts = np.full((BUCKETS, k), 0.1)
    for words, label in zip(found, labels):
        counts[words, label] += 1
    return np.log((counts + 0.1) / (np.bincount(labels, minlength=k) + 1.0))


def _evidence(weights: np.ndarray, prior: np.ndarray, words: list[int]) -> np.ndarray:
    """The log posterior of a text by its words and the prior, up to a constant."""
    return weights[words].sum(0) * (SHARPNESS / (len(words) or 1)) + prior


def channel(scores: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The chance of each label for a text of each domain, by expectation-maximization over rows
    with text evidence and a label; one pseudo-count a cell of the diagonal, a tenth elsewhere."""
    k = scores.shape[1]
    chance = np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(chance, 0.9)
    for _ in range(CHANNEL):
        joint = scores + np.log(chance[:, labels].T)
        heat = np.exp(joint - joint.max(1, keepdims=True)) if len(joint) else joint
        heat /= np.maximum(heat.sum(1, keepdims=True), 1e-300)
        fresh = np.full((k, k), 0.1) + 0.9 * np.eye(k)
        for label in range(k):
            fresh[:, label] += heat[labels == label].sum(0)
        chance = fresh / fresh.sum(1, keepdims=True)
    return chance


def classifier(documents: DataFrame, sources: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log weights (word, source), log prior, and the log channel (domain, label)."""
    order = Window.partitionBy("source").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = documents.filter(F.col("source").isin(sources) & (F.length("text") <= LONGEST)).withColumn("n", F.row_number().over(order)).filter(F.col("n") <= LABELLED)
    index, k = {s: i for i, s in enumerate(sources)}, len(sources)
    rows = sample.select("source", "text", "n").collect()
    found = [list(_words(r["text"])) for r in rows]
    labels, half = np.array([index[r["source"]] for r in rows], np.int64), np.array([r["n"] % 2 for r in rows], np.int64)
    shares = {r["source"]: r["n"] for r in documents.filter(F.col("source").isin(sources)).groupBy("source").agg(F.count("*").alias("n")).collect()}
    prior = np.log(np.array([shares.get(s, 0) + 1.0 for s in sources]) / (sum(shares.values()) + k))
    scores = np.zeros((len(rows), k))
    for part in (0, 1):  # each half is scored by the weights of the other
        weights = _fit([w for w, h in zip(found, half) if h != part], labels[half != part], k)
        for i in np.flatnonzero(half == part):
            scores[i] = _evidence(weights, prior, found[i])
    return _fit(found, labels, k).astype(np.float32), prior.astype(np.float32), np.log(channel(scores, labels)).astype(np.float32)


def profiles(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, tokenizer: str = TOKENIZER) -> tuple[DataFrame, list[str], np.ndarray]:
    """The compact table ``doc_id, source, tokens, posterior, most, agrees`` (whether the text alone
    tells the record's label), the sources, their shares."""
    wanted = sorted((r["source"], r["target_share"], r["max_repeats"]) for r in targets.filter("source IS NOT NULL").distinct().collect())
    sources = [s for s, _, _ in wanted]
    shares = np.array([w for _, w, _ in wanted], float)
    most = {s: int(m) for s, _, m in wanted}
    kept = documents.select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("source").isin(sources))
    spark = documents.sparkSession
    weights = spark.sparkContext.broadcast(classifier(kept, sources))

    def profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(folder, tokenizer)
        table, prior, said = weights.value
        index = {s: i for i, s in enumerate(sources)}
        known: dict[str, int] = {}
        for batch in batches:
            posteriors, agrees = [], []
            for text, label in zip(batch["text"], batch["source"]):
                words = set(_WORDS.findall(text.lower()))
                found = []
                for w in words:
                    b = known.get(w)
                    if b is None:
                        b = known[w] = _bucket(w)
                    found.append(b)
                score = _evidence(table, prior, found)
                agrees.append(bool(score.argmax() == index[label]))
                score = score + said[:, index[label]]
                heat = np.exp(score - score.max())
                posteriors.append((heat / heat.sum()).astype(float))
            if len(known) > 500_000:
                known.clear()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": count(batch["text"]), "posterior": posteriors, "most": [most[s] for s in batch["source"]], "agrees": agrees})

    table = kept.mapInPandas(profile, "doc_id long, source string, tokens long, posterior array<double>, most int, agrees boolean")
    return cut(table), sources, shares / shares.sum() if len(shares) else shares


def _rates(posterior: np.ndarray, most: np.ndarray, start: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """The rates after every step of the history: gradient step, then projection on [0, most]."""
    rate = np.clip(most * (posterior @ start), 0, most)
    for step in history:
        rate = np.clip(rate - most * (posterior @ step), 0, most)
    return rate


def _matrix(batch: pd.DataFrame, k: int) -> np.ndarray:
    return np.stack(batch["posterior"].to_list()) if len(batch) else np.zeros((0, k))


def fitted(table: DataFrame, shares: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The start and the history of steps that the least squares take."""
    k = len(shares)

    def totals(start: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(k)
            for batch in batches:
                posterior = _matrix(batch, k)
                rate = _rates(posterior, batch["most"].to_numpy(float), start, history)
                total += (rate * batch["tokens"].to_numpy(float)) @ posterior
            yield pd.DataFrame({"k": range(k), "total": total})

        rows = table.select("tokens", "posterior", "most").mapInPandas(run, "k int, total double").groupBy("k").agg(F.sum("total").alias("total")).collect()
        out = np.zeros(k)
        for r in rows:
            out[r["k"]] = r["total"]
        return out

    capacity = totals(np.ones(k), [])
    usable = (capacity > 0) & (shares > 0)
    if not usable.any():
        return np.zeros(k), []
    size = (capacity[usable] / shares[usable]).min()
    goal = np.where(usable, shares * size, 0.0)
    scale = np.where(usable, capacity, 1.0)
    start, history = goal / scale, []
    for _ in range(ROUNDS):
        residual = totals(start, history) - goal
        if np.abs(residual).max() <= 1e-4 * size:
            break
        history.append(residual / scale)
    return start, history


def copies(documents: DataFrame, targets: DataFrame, folder: str = TOKENIZERS, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens, rate, copies, agrees``: how often each record is used.

    Rows without a source or with one that has no target are left out; a NULL or empty text
    has no tokens and counts for nothing; a source without rows gets share 0 and the others
    keep their proportions; repeated texts are separate records; an empty table gives none.
    """
    table, _, shares = profiles(documents, targets, folder, tokenizer)
    start, history = fitted(table, shares)
    k = len(shares)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rate = _rates(_matrix(batch, k), batch["most"].to_numpy(float), start, history)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "tokens": batch["tokens"], "most": batch["most"], "rate": rate, "agrees": batch["agrees"]})

    rated = table.mapInPandas(run, "doc_id long, source string, tokens long, most int, rate double, agrees boolean")
    chance = (F.pmod(F.xxhash64("doc_id", F.lit("mixture")), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    return rated.withColumn("copies", F.least(F.floor(F.col("rate") + chance), F.col("most")).cast("int")).select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), "copies", "agrees")


def report(used: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the target and the actual share, records, used records, most copies, and the share of
    its records whose text alone tells the source."""
    by = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("records"), F.sum((F.col("copies") > 0).cast("long")).alias("used_records"), F.max("copies").alias("most_copies"), F.round(F.avg(F.col("agrees").cast("double")), 4).alias("text_agreement"))
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.filter("source IS NOT NULL").distinct().join(by, "source", "left").join(F.broadcast(total))
    return joined.select("source", "target_share", F.round(F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0)), 6).alias("actual_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("used_records", F.lit(0)).alias("used_records"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats", "text_agreement")
