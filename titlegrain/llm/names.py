"""Problem 1: variant spellings of names typed by people.

Method: suffix blocking. Every mention is parsed into a signature (person, organisation
or court; name folded to one rough phonetic Latin form, also from Tamil script; initial or
parent; acronym). Mentions to be compared share a block: the last letters of a name token
(the shortest indexed suffix stands for all longer ones), its first letters, or an
acronym. No block is discarded: one shared by many signatures is cut into parts, and every
two parts are compared. Pairs of a block are compared by the ratio of the longest common
subsequence; two spellings that are both common in the whole corpus are different names.

Plan: mentions are parsed once and checkpointed; certificates of at most ``GROUP_LIMIT``
mentions are compared in one task each (one shuffle); larger ones, which may hold a third
of all rows, are spread over (certificate, survey, block) keys and joined.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from titlegrain.llm import encodings
from titlegrain.nulls import missing
from titlegrain.session import cut

#: Most mentions of a certificate compared in one task; signatures of one part of a block.
GROUP_LIMIT, BLOCK_LIMIT = 400, 100
#: Least indexed suffix, indexed prefix.
SUFFIX, PREFIX = 4, 3
#: Least LCS ratio of given names, of given names whose parents agree, of parents, of parents
#: where the given names are equal, of a court's words, of damaged texts.
GIVEN, GIVEN_SAME_PARENT, PARENT, PARENT_OF_EQUAL, WORD, DAMAGED = 0.85, 0.72, 0.8, 0.6, 0.78, 0.7
#: Least LCS ratio of an organisation's whole name, and of each of its words.
ORG, ORG_WORD = 0.9, 0.6
#: At most so many common spellings may be broadcast.
VOCABULARY = 50_000

# Tamil letters in a rough Latin form that ignores voicing and length.
TAMIL = dict(zip("அஆஇஈஉஊஎஏஐஒஓஔகஙசஞடணதநபமயரலவழளறனஜஷஸஹ", "a a i i u u e e ai o o au k n s kn t n t n p m y r l v z l r n s s s k".split()))
TAMIL_SIGNS = {"ா": "a", "ி": "i", "ீ": "i", "ு": "u", "ூ": "u", "ெ": "e", "ே": "e", "ை": "ai", "ொ": "o", "ோ": "o", "ௌ": "au"}
# Spellings of one sound, in this order.
SOUNDS = [("zh", "z"), ("th", "t"), ("dh", "t"), ("ch", "s"), ("sh", "s"), ("gh", "k"), ("kh", "k"), ("bh", "p"), ("ph", "p"), ("aa", "a"), ("oo", "u"), ("ee", "i"), ("g", "k"), ("d", "t"), ("b", "p"), ("c", "s"), ("j", "s"), ("w", "v"), ("q", "k"), ("x", "ks"), ("h", "")]
# Words of organisations, written out; words without weight.
ORG_WORDS = {"ltd": "limited", "pvt": "private", "dev": "development", "corpn": "corporation", "corp": "corporation", "co-op": "cooperative", "coop": "cooperative", "hsg": "housing", "fin": "finance", "agri": "agricultural", "assn": "association", "fdn": "foundations", "bldrs": "builders", "bk": "bank"}
ORG_SIGNS = {"bank", "limited", "corporation", "finance", "federation", "foundations", "foundation", "builders", "society", "trust", "company", "private", "association", "cooperative", "owners"}
LEGAL = {"limited", "private", "company", "the", "and", "of", "ms"}

_ADDED = [
    re.compile(r",?\s*\S+\s*[(\[](?:at|AT)[)\]].*$"),
    re.compile(r"(?<=\S)\s*[<(\[{“”\"‘].*$"),
    re.compile(r"(?<=\S)[.\s]*(?:[–—…]|\s�|�\s).*$"),
    re.compile(r",?\s+(?:e-?mail|ID|Aadhaar|Aadhar|PAN|UID|Ph|Phone|Cell|Mob|Mobile|Tel|WhatsApp|ref|A/c|r/o|residing|residence|resident|No|Door|Plot|Flat|Old|New|through|represented)(?![A-Za-z]).*$"),
    re.compile(r",?\s*\S+(?:@|\s*[(\[](?:at|AT)[)\]]\s*)\S.*$"),
    re.compile(r",?\s*[A-Z]{3,5}\d{3,}.*$"),
    re.compile(r"[,\s]+[+(]*\d.*$"),
]
_KIN = re.compile(r"^(.*?)[\s,]+(?:[sdwhc]\s*/\s*o\.?|(?:son|daughter|wife|husband) of)\s+(.*)$", re.I)
_TITLE = re.compile(r"^(?:(?:mr|mrs|ms|miss|dr|smt|shri)\.?\s+|(?:thiru|tmt|selvi|sri|kumari)\.\s*)", re.I)
_PIECE = re.compile(r"([^\s.,]+)(\.?)")


@functools.lru_cache(200_000)
def folded(text: str) -> str:
    """The rough phonetic form: Latin letters without voicing, length or doubling."""
    if not text.isascii():
        out: list[str] = []
        for ch in unicodedata.normalize("NFC", text):
            if ch in TAMIL:
                out.append(TAMIL[ch] + ("" if ch in "அஆஇஈஉஊஎஏஐஒஓஔ" else "a"))
            elif ch in TAMIL_SIGNS or ch == "்":
                if out and out[-1].endswith("a"):
                    out[-1] = out[-1][:-1]
                out.append(TAMIL_SIGNS.get(ch, ""))
            else:
                out.append(unicodedata.normalize("NFKD", ch)[:1])
        text = "".join(out)
    text = "".join(c for c in text.lower() if "a" <= c <= "z")
    for spelling, sound in SOUNDS:
        text = text.replace(spelling, sound)
    text = re.sub(r"(.)\1+", r"\1", text)
    return text[:-1] + "i" if text.endswith("y") and len(text) > 1 else text


@functools.lru_cache(200_000)
def signature(item: str) -> str:
    """What a mention says, as text: ``C|place``, ``O|word word``, ``A|acronym`` or
    ``P|given:parent;given:parent`` (alternatives); a trailing ``!`` marks damage."""
    text, _ = encodings.repair(item)
    damaged = "�" in text and not text[:1].isascii() or text.startswith(("?", "�"))
    text = re.sub(r"\s+", " ", text).strip()
    if not damaged:
        for pattern in _ADDED:
            text = pattern.sub("", text)
    text = text.strip(" ,;-")
    words = [w for w in re.split(r"[\s,]+", re.sub(r"^m/s\.?\s*", "", text.lower()).replace(".", " ").replace("&", " ")) if w]
    words = [ORG_WORDS.get(w, w) for w in words]
    if "court" in words:
        return "C|" + " ".join(folded(w) for w in words if w != "court")
    if ORG_SIGNS & set(words):
        if "," in text:
            head, _, tail = text.rpartition(",")
            moved = tail if "branch" not in tail.lower() else ""
            words = [ORG_WORDS.get(w, w) for w in re.split(r"[\s,.]+", re.sub(r"^m/s\.?\s*", "", f"{moved} {head}".strip().lower())) if w]
        kept = [w for w in words if w not in LEGAL]
        first = re.split(r"[\s,.]+", re.sub(r"^(?:the|m/s\.?)\s+", "", text, flags=re.I))[0]
        if len(kept) <= 2 and first.isupper() and first.isascii() and 2 <= len(first) <= 6 and first.lower() not in ORG_SIGNS:
            return "A|" + first.lower()
        return "O|" + " ".join(folded(w) for w in kept if folded(w))
    text, _, alias = text.partition(" @ ")
    parent = ""
    if kin := _KIN.match(text):
        text, parent = kin[1], folded(re.sub(r"\b\w\b\.?", "", _TITLE.sub("", kin[2])).replace(" ", ""))
    text = _TITLE.sub("", text)
    initials, names = [], []
    for piece, dot in _PIECE.findall(text):
        tamil = "஀" <= piece[0] <= "௿"
        if (len(piece) == 1 and not tamil) or (dot and tamil and len(folded(piece)) <= 3) or (dot and piece.startswith("?")):
            initials.append(folded(piece)[:1])
        else:
            names.append(piece)
    joined = folded("".join(names))
    mark = "!" if damaged else ""
    if parent or initials or len(names) != 2:
        return f"P|{joined}:{parent or (initials[0] if initials else '')}{mark}"
    return f"P|{folded(names[1])}:{folded(names[0])};{joined}:{mark}"


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@functools.lru_cache(500_000)
def ratio(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def _people(sig: str) -> tuple[list[tuple[str, str]], bool]:
    body = sig[2:]
    damaged = body.endswith("!")
    return [tuple(x.split(":")) for x in body.rstrip("!").split(";")], damaged


def _initials(words: list[str]) -> str:
    return "".join(w[0] for w in words)


def tokens(sig: str) -> list[str]:
    """The names whose frequency tells a common spelling from a rare one."""
    if sig[0] != "P" or sig.endswith("!"):
        return []
    given, parent = sig[2:].split(";")[0].split(":")
    return [x for x in (given, parent) if len(x) > 1]


def block_keys(sig: str) -> list[str]:
    kind, body = sig[0], sig[2:]
    if kind == "A":
        return ["a" + folded_acronym(body)]
    if kind == "O":
        words = body.split()
        return list(dict.fromkeys([*("o" + w[-SUFFIX:] for w in words[:2]), "a" + _initials(words)[:3]]))
    if kind == "C":
        return ["c" + w[-SUFFIX:] for w in body.split()] + ["c^" + w[:PREFIX] for w in body.split()]
    keys = []
    for given, _ in _people(sig)[0]:
        keys += ["s" + given[-SUFFIX:], "p" + given[:PREFIX]]
    return list(dict.fromkeys(keys))


def folded_acronym(text: str) -> str:
    return "".join(folded(c) or c for c in text)[:3]


class Judge:
    """Decides whether two signatures name one party; ``common`` are the common spellings."""

    def __init__(self, common: Iterable[str]):
        self.common = set(common)
        self.same = functools.lru_cache(300_000)(self._same)

    def _alike(self, a: str, b: str, least: float) -> bool:
        if a == b:
            return True
        if len(a) < 3 or len(b) < 3 or (a in self.common and b in self.common):
            return False
        return ratio(a, b) >= least

    def _parents(self, a: str, b: str, given: bool) -> bool:
        if not a or not b:
            return True
        if len(a) == 1 or len(b) == 1:
            return a[0] == b[0]
        return self._alike(a, b, PARENT_OF_EQUAL if given and a[0] == b[0] else PARENT)

    def _same(self, x: str, y: str) -> bool:
        if x == y:
            return True
        kinds = {x[0], y[0]}
        if kinds == {"P"}:
            (left, hurt), (right, hurt2) = _people(x), _people(y)
            least = DAMAGED if hurt or hurt2 else GIVEN
            for g, p in left:
                for h, q in right:
                    if self._parents(p, q, g == h):
                        if self._alike(g, h, min(least, GIVEN_SAME_PARENT) if p and q else least):
                            return True
                        short, long = sorted((g, h), key=len)
                        if p and q and len(short) >= 3 and len(long) - len(short) >= 2 and long.startswith(short):
                            return True
            return False
        if kinds == {"O"} or kinds == {"C"}:
            a, b = x[2:].split(), y[2:].split()
            whole, each = (ORG, ORG_WORD) if kinds == {"O"} else (0.0, WORD)
            alike = lambda u, v: ratio("".join(u), "".join(v)) >= whole and all(s == t or ratio(s, t) >= each for s, t in zip(u, v))
            if len(a) == len(b):
                return alike(a, b) or alike(sorted(a), sorted(b))
            return ratio("".join(a), "".join(b)) >= 0.95
        if kinds == {"A", "O"}:
            acronym, words = (x[2:], y[2:].split()) if x[0] == "A" else (y[2:], x[2:].split())
            first = _initials(words)
            wanted = "".join(folded(c) or c for c in acronym)
            return first.startswith(wanted) and len(wanted) >= len(first) - 1
        return False


def mentions(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """``doc_id, survey, mention, item, sig`` of every party named. A repeated delivery repeats
    its rows; they are equal as written and drop out with the pairs' final DISTINCT."""

    def side(name: str, mark: str) -> Column:
        listed = F.filter(F.split(F.trim(F.col(name)), r"(?:^|\s+)\d{1,3}\.\s+"), lambda x: F.trim(x) != "")
        return F.transform(listed, lambda x, i: F.struct(F.concat_ws("#", F.col("doc_id"), F.col("seq").cast("string"), F.lit(mark), (i + 1).cast("string")).alias("mention"), F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")).alias("item")))

    sides = F.concat(F.when(~missing(F.col("executants")), side("executants", "e")).otherwise(F.array()), F.when(~missing(F.col("claimants")), side("claimants", "c")).otherwise(F.array()))
    survey = F.try_element_at("schedules", F.lit(1))["survey_no"]
    entry = entries.select("doc_id", survey.alias("survey"), F.inline(sides))
    applicant = headers.filter(~missing(F.col("applicant_name"))).select("doc_id", F.lit("#").alias("survey"), F.concat("doc_id", F.lit("#0#a#1")).alias("mention"), F.trim("applicant_name").alias("item"))

    @F.pandas_udf("string")
    def parse(items: pd.Series) -> pd.Series:
        return items.map(signature)

    return entry.unionByName(applicant).withColumn("sig", parse("item"))


def common_spellings(parsed: DataFrame) -> list[str]:
    """The spellings so frequent that they can't be slips: at least a tenth of the count that
    half of all mentions reach or exceed, and 3. That count is taken over all spellings; more
    than ``VOCABULARY`` common ones are an error, none is left out."""

    @F.pandas_udf("array<string>")
    def names(sigs: pd.Series) -> pd.Series:
        return sigs.map(tokens)

    counts = cut(parsed.groupBy("sig").agg(F.count("*").alias("n")).select("n", F.explode(names("sig")).alias("token")).groupBy("token").agg(F.sum("n").alias("n")))
    sizes = sorted(counts.groupBy("n").agg(F.count("*").alias("m")).collect(), reverse=True)  # few: counts differ
    total, seen, typical = sum(n * m for n, m in sizes), 0, 0
    for n, m in sizes:
        seen += n * m
        typical = n
        if 2 * seen >= total:
            break
    least = max(3, typical / 10)
    if sum(m for n, m in sizes if n >= least) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} common spellings")
    return [r["token"] for r in counts.filter(F.col("n") >= least).collect()]


def _pairs_in(surveys, names, items, sigs, judge: Judge) -> list[str]:
    """All linked pairs of one certificate: per survey, and the applicant with all."""
    groups: dict[str, dict[str, list[int]]] = {}
    for i, (survey, sig) in enumerate(zip(surveys, sigs)):
        if survey is not None:
            groups.setdefault(survey, {}).setdefault(sig, []).append(i)
    out = []

    def emit(left: list[int], right: list[int]) -> None:
        for i in left:
            for j in right:
                if i != j and items[i] != items[j]:
                    a, b = sorted((names[i], names[j]))
                    out.append(f"{a}\t{b}")

    applicant = groups.pop("#", {})
    for by_sig in groups.values():
        for members in by_sig.values():
            for at, i in enumerate(members):
                emit([i], members[at + 1 :])
        index: dict[str, list[str]] = {}
        tried = set()
        for sig in by_sig:
            for key in block_keys(sig):
                for other in index.setdefault(key, []):
                    if (other, sig) not in tried:
                        tried.add((other, sig))
                        if judge.same(other, sig):
                            emit(by_sig[other], by_sig[sig])
                index[key].append(sig)
    if applicant:
        everyone: dict[str, list[int]] = {}
        for i, (survey, sig) in enumerate(zip(surveys, sigs)):
            if survey != "#":
                everyone.setdefault(sig, []).append(i)
        for sig, who in applicant.items():
            keys = set(block_keys(sig))
            for other, members in everyone.items():
                if sig == other or (keys & set(block_keys(other)) and judge.same(sig, other)):
                    emit(who, members)
    return out


def linked(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """``name_key_a, name_key_b`` (a < b): mentions of one party not equal as written.

    Missing parties take no part; an entry without a schedule is compared with the applicant
    only; equal spellings give no pair; repeated deliveries add none; empty tables give none.
    """
    parsed = cut(mentions(entries, headers))
    spark = entries.sparkSession
    known = spark.sparkContext.broadcast(common_spellings(parsed))
    large = parsed.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP_LIMIT).select("doc_id")

    @F.pandas_udf("array<string>")
    def compare(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = Judge(known.value)
        for columns in batches:
            yield pd.Series([_pairs_in(*row, judge) for row in zip(*columns)])

    @F.pandas_udf("boolean")
    def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = Judge(known.value)
        for a, b in batches:
            yield pd.Series([judge.same(x, y) for x, y in zip(a, b)], dtype=bool)

    @F.pandas_udf("array<string>")
    def within(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        judge = Judge(known.value)
        for columns in batches:
            yield pd.Series([_pairs_of_cell(*row, judge) for row in zip(*columns)])

    small = parsed.join(large, "doc_id", "left_anti")
    rows = small.groupBy("doc_id").agg(F.collect_list(F.struct(F.coalesce("survey", F.lit("~")).alias("survey"), "mention", "item", "sig")).alias("m"))
    rows = rows.filter(F.size("m") > 1).select(compare(F.transform("m.survey", lambda s: F.when(s != "~", s)), "m.mention", "m.item", "m.sig").alias("pairs"))
    found = rows.select(F.explode("pairs").alias("pair")).select(F.split("pair", "\t")[0].alias("name_key_a"), F.split("pair", "\t")[1].alias("name_key_b"))
    return found.unionByName(_linked_large(cut(parsed.join(large, "doc_id")), same, within)).distinct()


def _pairs_of_cell(parts, sigs, judge: Judge) -> list[str]:
    """The linked pairs of a cell: of two parts those across, of one part all."""
    one = len(set(parts)) == 1
    rows = sorted(zip(sigs, parts))
    return [f"{a}\t{b}" for at, (a, p) in enumerate(rows) for b, q in rows[at + 1 :] if (one or p != q) and judge.same(a, b)]


def _linked_large(parsed: DataFrame, same, within_cell) -> DataFrame:
    """The pairs of certificates with many mentions. Every two signatures of a block meet: it is
    cut into parts of about ``BLOCK_LIMIT`` by hash, and each pair of parts is a cell of its own,
    so that a common block is spread over many tasks and only linked pairs leave a cell."""
    classes = parsed.filter("survey IS NOT NULL AND survey <> '#'").select("doc_id", "survey", "sig").distinct()
    applicants = parsed.filter("survey = '#'").select("doc_id", "survey", "sig").distinct()

    @F.pandas_udf("array<string>")
    def first(sigs: pd.Series) -> pd.Series:
        return sigs.map(block_keys)

    block = ["doc_id", "survey", "key"]
    keyed = classes.withColumn("key", F.explode(first("sig")))
    over = keyed.groupBy(*block).agg(F.ceil(F.count("*") / BLOCK_LIMIT).cast("int").alias("parts")).filter("parts > 1")
    salted = keyed.join(over, block, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("sig"), "parts").cast("int"))
    spread = salted.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = spread.groupBy(*block, F.least("part", "met").alias("low"), F.greatest("part", "met").alias("high")).agg(F.collect_list(F.struct("part", "sig")).alias("m"))
    # a cell of two parts of which one is empty has nothing across
    cells = cells.filter((F.size("m") > 1) & ((F.col("low") == F.col("high")) | (F.array_min("m.part") < F.array_max("m.part"))))
    found = cells.select("doc_id", "survey", F.explode(within_cell("m.part", "m.sig")).alias("pair")).distinct()
    pairs = found.select("doc_id", "survey", F.col("survey").alias("survey_b"), F.split("pair", "\t")[0].alias("sig"), F.split("pair", "\t")[1].alias("sig_b"))
    asked = applicants.withColumn("key", F.explode(first("sig"))).select("doc_id", F.col("survey"), "sig", "key")
    entry = parsed.filter("survey IS NULL OR survey <> '#'").select("doc_id", F.coalesce("survey", F.lit("~")).alias("survey_b"), F.col("sig").alias("sig_b")).distinct().withColumn("key", F.explode(first("sig_b")))
    linked = pairs.unionByName(asked.join(entry, ["doc_id", "key"]).select("doc_id", "survey", "survey_b", "sig", "sig_b").distinct().filter(same("sig", "sig_b")))
    left = parsed.select("doc_id", F.coalesce("survey", F.lit("~")).alias("survey"), "sig", F.col("mention").alias("ma"), F.col("item").alias("ia"))
    right = left.select("doc_id", F.col("survey").alias("survey_b"), F.col("sig").alias("sig_b"), F.col("ma").alias("mb"), F.col("ia").alias("ib"))
    across = linked.join(left, ["doc_id", "survey", "sig"]).join(right, ["doc_id", "survey_b", "sig_b"]).filter("ia <> ib")
    within = left.filter("survey NOT IN ('~', '#')").join(right, (F.col("survey") == F.col("survey_b")) & (F.col("sig") == F.col("sig_b")) & (left["doc_id"] == right["doc_id"])).filter("ma < mb AND ia <> ib")
    both = across.select("ma", "mb").unionByName(within.select("ma", "mb"))
    return both.select(F.least("ma", "mb").alias("name_key_a"), F.greatest("ma", "mb").alias("name_key_b"))
