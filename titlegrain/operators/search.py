"""The property filter and its answer: matches, pool, title chain, loans, court entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.operators.display import extent_by_check
from titlegrain.operators.register import RULES, holding, is_kind
from titlegrain.session import small_enough

# Words of a boundary, and of a lender's name, that tell nothing.
BOUNDARY_WORDS = ("north", "south", "east", "west", "road", "street", "வடக்கில்", "தெற்கில்", "கிழக்கில்", "மேற்கில்")
LENDER_WORDS = ("bank", "ltd", "limited", "of", "india")


@dataclass(frozen=True)
class Criteria:
    """what to look for; None leaves a criterion out. Taluk, place and district are accepted
    by the inventory but never tested."""

    survey_no: str | None = None
    flat: str | None = None
    door_no: str | None = None
    extent: str | None = None
    boundary: str | None = None
    owner: str | None = None
    mode: str = "any"


def _plain_tokens(col: Column) -> Column:
    """Lower-case tokens of at least two letters; everything but letters and digits parts them."""
    return F.filter(F.split(F.regexp_replace(F.lower(col), r"[^a-z0-9\x{0B80}-\x{0BFF}]", " "), " +"), lambda t: F.length(t) > 1)


def _row_text() -> Column:
    """All that a criterion may meet, in lower case."""
    return F.lower(F.concat_ws(" ", "doc_no", "nature", "executants", "claimants", "remarks", "pr_numbers", "schedule_text"))


def named_in(name: str, col: str) -> Column:
    """F1f: whether a side names a person: the whole normalised name, else a word of it over two letters."""
    whole, side = S.name_normal(F.lit(name)), S.name_normal(F.coalesce(F.col(col), F.lit("")))
    words = F.filter(F.split(whole, " "), lambda w: F.length(w) > 2)
    return ((whole != "") & F.contains(side, whole)) | F.exists(words, lambda w: F.contains(side, w))


def matches(reg: DataFrame, criteria: Criteria) -> DataFrame:
    """Every entry with ``reasons`` (the criteria met), ``context`` (a flat is asked for and
    the row speaks of one), ``owner_match`` and ``matched``.

    ``mode="any"``: one criterion met suffices, and without a survey number every entry matches
    (the others add reasons only). ``mode="all"``: every criterion given must be met. Without any
    criterion every entry matches. All tests are Column predicates of one pass.
    """
    c, text = criteria, _row_text()
    tests: dict[str, Column] = {}
    context = F.lit(False)
    if c.survey_no:
        number = S.survey_normal(F.lit(c.survey_no))
        tests["survey"] = ((number != "") & F.contains(S.survey_normal(text), number)) | text.contains(c.survey_no.lower())
    if c.flat:
        bare = F.lower(F.trim(F.regexp_replace(F.lit(c.flat), r"(?i)^(?:flat|apartment|unit|no\.?)\s*", "")))
        tests["flat"] = F.contains(text, bare)
        context = ~tests["flat"] & text.rlike("flat|apartment|unit")
    if c.door_no:
        bare = F.lower(F.trim(F.regexp_replace(F.lit(c.door_no), r"(?i)^(?:plot|door|d\.?no\.?|no\.?)\s*", "")))
        tests["door"] = (bare != "") & F.contains(text, bare)
    if c.extent:
        wanted, said = extent_by_check(F.lit(c.extent)), extent_by_check(F.col("remarks"))
        tests["extent"] = text.contains(c.extent.lower()) | F.coalesce(F.abs(said - wanted) / wanted < 0.15, F.lit(False))
    if c.boundary:
        words = F.filter(_plain_tokens(F.lit(c.boundary)), lambda t: ~t.isin(*BOUNDARY_WORDS))
        tests["boundary"] = F.size(F.filter(words, lambda t: F.contains(text, t))) >= 2
    owned = named_in(c.owner, "executants") | named_in(c.owner, "claimants") if c.owner else F.lit(False)
    if c.owner:
        tests["owner"] = owned
    met = F.lit(True)
    for i, test in enumerate(tests.values()):
        met = test if i == 0 else (met & test) if c.mode == "all" else (met | test)
    if c.mode == "any" and not c.survey_no:
        met = F.lit(True)
    reasons = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])) if tests else F.array(F.lit("all"))
    return reg.withColumn("reasons", reasons).withColumn("context", context).withColumn("owner_match", owned).withColumn("matched", met)


def pool(matched: DataFrame) -> DataFrame:
    """The matched entries of a certificate, or all of them where none matches."""
    hits = matched.groupBy("doc_id").agg(F.count_if("matched").alias("hits"))
    met = matched.join(F.broadcast(hits) if small_enough(hits) else hits, "doc_id")
    return met.filter("matched OR hits = 0").drop("hits")


def chain(entries: DataFrame) -> DataFrame:
    """The conveyances of a pool in register order; ``holds`` marks the last one."""
    deeds = entries.filter(is_kind("conveyance", "filter"))
    last = deeds.groupBy("doc_id").agg(F.max("seq").alias("last"))
    return deeds.join(last, "doc_id").select("doc_id", "seq", "doc_no", "nature", F.col("claimants").alias("buyer"), F.col("executants").alias("seller"), (F.col("seq") == F.col("last")).alias("holds"))


def loans(entries: DataFrame) -> DataFrame:
    """Each mortgage of a pool with the first discharge that names its document (as a substring
    of its references or remarks) or a word of its lender (in either party; five words excepted).

    Words and documents meet the distinct words of the discharges by their first letters
    (``register.holding``); discharges are aggregated to the first of a key before they meet
    mortgages.
    """
    owed, paid = entries.filter(is_kind("mortgage", "filter")), entries.filter(is_kind("discharge", "filter"))
    lender = F.array_distinct(F.filter(_plain_tokens(F.coalesce("claimants", F.lit("Bank / Financial Institution"))), lambda t: ~t.isin(*LENDER_WORDS)))
    said = F.array_distinct(F.split(F.lower(F.concat_ws(" ", "claimants", "executants")), r"\s+"))
    refs = F.array_distinct(F.split(F.concat_ws(" ", "pr_numbers", "remarks"), r"\s+"))

    def first(asked: DataFrame, offered: DataFrame, name: str) -> DataFrame:
        """``doc_id, seq`` of a mortgage and the first discharge that holds one of its words."""
        held = holding(asked.select("word"), offered.select("whole"))
        by_word = offered.join(held, "whole").groupBy("doc_id", "word").agg(F.min("seq").alias(name))
        return asked.join(by_word, ["doc_id", "word"]).groupBy("doc_id", "seq").agg(F.min(name).alias(name))

    by_party = first(owed.select("doc_id", "seq", F.explode(lender).alias("word")), paid.select("doc_id", "seq", F.explode(said).alias("whole")), "by_party")
    # A document number holds no blank, else only its part without one is asked for.
    by_doc = first(owed.filter("doc_no IS NOT NULL").select("doc_id", "seq", F.element_at(F.split(F.trim("doc_no"), r"\s+"), -1).alias("word")), paid.select("doc_id", "seq", F.explode(refs).alias("whole")), "by_doc")
    found = owed.select("doc_id", "seq", "doc_no").join(by_party, ["doc_id", "seq"], "left").join(by_doc, ["doc_id", "seq"], "left")
    return found.select("doc_id", "seq", "doc_no", F.least("by_party", "by_doc").alias("discharge_seq"))


def court(entries: DataFrame) -> DataFrame:
    """entries of a pool whose nature or remarks hold a word of the filter's list, and which."""
    text = F.lower(F.concat_ws(" ", F.coalesce("nature", F.lit("")), F.coalesce("remarks", F.lit(""))))
    words = [w.replace("[.]", ".") for w in RULES["filter"]["court"]]
    hits = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))
    return entries.select("doc_id", "seq", "doc_no", F.array_join(hits, ",").alias("words")).filter("words <> ''")


def related(entries: DataFrame, owner: str) -> DataFrame:
    """The first entry of a pool that names a person: the whole name among claimants, then
    executants, then a word of it over two letters in either."""
    whole = S.name_normal(F.lit(owner))
    claim, exe = S.name_normal(F.coalesce("claimants", F.lit(""))), S.name_normal(F.coalesce("executants", F.lit("")))
    role = F.when(F.contains(claim, whole), "claimant").when(F.contains(exe, whole), "executant").when(named_in(owner, "claimants"), "claimant, in part").when(named_in(owner, "executants"), "executant, in part")
    rows = entries.withColumn("role", role).filter("role IS NOT NULL")
    return rows.groupBy("doc_id").agg(F.min_by(F.struct("seq", "doc_no", "role"), "seq").alias("r")).select("doc_id", "r.*")


def summary(reg: DataFrame, criteria: Criteria) -> DataFrame:
    """A1: entries, matched and unmatched, share in per cent (half up, 0 for none), holder, loans
    open and closed, court entries, of every certificate."""
    matched = matches(reg, criteria)
    counts = matched.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if("matched").alias("matched"))
    rows = pool(matched)
    debts = loans(rows).groupBy("doc_id").agg(F.count("*").alias("loans"), F.count("discharge_seq").alias("closed"))
    courts = court(rows).groupBy("doc_id").agg(F.count("*").alias("court_entries"))
    held = chain(rows).filter("holds").select("doc_id", F.col("buyer").alias("holder"))
    all_ = counts.join(held, "doc_id", "left").join(debts, "doc_id", "left").join(courts, "doc_id", "left").na.fill(0, ["loans", "closed", "court_entries"])
    share = F.round(F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("entries")), F.lit(0.0)), 1)
    return all_.select("doc_id", "entries", "matched", (F.col("entries") - F.col("matched")).alias("unmatched"), share.alias("matched_pct"), "holder", "loans", "closed", (F.col("loans") - F.col("closed")).alias("open"), "court_entries")
