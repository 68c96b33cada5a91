"""Problem 2: traces of the page and the scanner in text, and its repair.

Method: joint word segmentation over the de-lined character stream. Running headers and
page numbers are taken out (told by recurrence, see ``page_marks``), the remaining lines become one stream, and a lattice over the
stream is decoded by dynamic programming: a word of the lexicon, a word read through
character confusions, a word broken by a hyphen at a line end, two words run together, one
word split by a blank. Paragraph boundaries are chosen by a second dynamic programme over
the line ends. The lexicon is counted over the whole corpus: a form that reads, through
the confusions, as a far more frequent word is a misreading and no word of its own.

Plan: one pass counts words (partial counts in the workers, one small shuffle). The frequent
words of the lexicon (about ``LEXICON``) are broadcast, of the others only a sieve that tells
which words they may be, and a second pass decodes every record where it lies, without a
shuffle. A record whose decoding may depend on words of the sieve is kept, these words are joined
with the lexicon's, and it is decoded again: no word of the lexicon is left out. Decisions on word
forms are cached, so that the lattice is built only where a form is not plainly known.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegrain.session import cut

#: Most words broadcast (the others are joined), least count of a word, how much more frequent than its misreading a word is.
LEXICON, KNOWN, TIMES = 200_000, 3, 20
#: Letters from which on a form is read along the words of that length, most confusions in one form.
LONG, MOST = 40, 3
#: Bits of the sieve: for each word, and at most (16 MB); bits of one row of it.
SIEVE, SIEVE_MOST, SIEVE_ROW = 16, 1 << 27, 1 << 15
#: Costs in nats: one confusion, one hyphen, one split or join, an unknown word and each of its letters.
CONFUSION, BREAK, JOIN, UNKNOWN, LETTER = 4.0, 2.0, 7.0, 12.0, 1.0

# What the recogniser shows, and what it saw.
CONFUSIONS = {"0": ["o"], "1": ["l", "i"], "5": ["s"], "6": ["b"], "9": ["g"], "(": ["c"], "|": ["i", "l"], "@": ["a"], "c": ["e"], "f": ["t"], "b": ["h"], "m": ["rn"], "ri": ["n"], "cl": ["d"], "ii": ["u"], "rn": ["m"], "vv": ["w"]}
# Usual forms of a page number as a line of its own; it must be the page's own.
PAGE_NUMBER = re.compile(r"^(?:~ ?\d+ ?~|[-–—] ?\d+ ?[-–—]|\.{2,} ?\d+ ?\.{2,}|\d+ ?/ ?\d+|\[ ?\d+ ?\]|(?:page|pg\.?|sheet(?: no)?[:.]?|பக்கம்)[ :]*\d+(?: of \d+)?)$", re.I)
#: Least lines of a form, least certificates with a form on several pages, least share of these where the lines are equal,
#: least share of lines with the certificate's own number, or with the page's own number, least share of first pages that a title begins.
SEEN, REPEATED, EQUAL, OWN, AGREED, TITLED = 3, 2, 0.9, 0.5, 0.9, 0.1
#: Least share of all records that have a line without digits: at most its inverse times the lines of a record qualify.
SHARE = 0.0005

_HYPHENS = "-­‐‑¬"
_BROKEN = re.compile(rf"([^\W\d_஀-௿]{{2,}}|[஀-௿]{{2,}}|\S*[^\W\d_]\S?)[{_HYPHENS}]\s*$")
_EDGE = ".,;:“”\"’‘'–—…!?[]{}<>"
_WORD = re.compile(r"[A-Za-z0-9(|@]+$")
_INNER = re.compile(r"[A-Za-z]*[a-z](?:[|(@0569])[a-z][A-Za-z]*$")


def core(token: str) -> str:
    """A token without punctuation at its edges; a bracket stays only if it may be a letter."""
    token = token.strip(_EDGE)
    if token.endswith(")"):
        token = token.strip("()")
    return token.strip(_EDGE)


@dataclass(frozen=True)
class Marks:
    """Forms of lines (digits as ``#``) that are running headers, page numbers, titles of first pages."""

    headers: frozenset[str] = frozenset()
    numbers: frozenset[str] = frozenset()
    titles: frozenset[str] = frozenset()

    @functools.cached_property
    def starts(self) -> frozenset[str]:
        """How headers and titles begin (a form that begins with a digit is met by any digit)."""
        return frozenset(f[:3] for f in (*self.headers, *self.titles)) | frozenset(f[:2] + str(d) for f in self.headers if f[2:3] == "#" for d in range(10)) | frozenset(f[0] + str(d) + c for f in self.headers if f[1:2] == "#" for d in range(10) for c in "0123456789" + f[2:3])


_NUMBERS = re.compile(r"[0-9]+")
_DIGIT = re.compile(r"\d")


_GAP = re.compile(r"\s{2,}(?=\S+(?:\s\S+)*$)")  # the last gap wider than a blank


def form_of(line: str) -> str:
    return re.sub(r"\s+", " ", _NUMBERS.sub("#", line.lower()))


def _header(line: str, marks: Marks) -> bool:
    return form_of(line) in marks.headers or " ".join(line.lower().split()) in marks.headers


def _own_number(line: str, page: int | None, marks: Marks) -> bool:
    """Whether a line is the page's number: a usual or recurring form of one with the number of this page."""
    if len(line) > 80 or not _DIGIT.search(line) or not (PAGE_NUMBER.match(line) or marks.numbers and form_of(line) in marks.numbers):
        return False
    return page is None or page in map(int, _NUMBERS.findall(line))


def split_lines(text: str, page_number: int | None = None, marks: Marks = Marks()) -> tuple[list[str], set[str]]:
    """The lines of the text proper, and the noise among ``header`` and ``pageno``."""
    kept, noise = [], set()
    for line in text.split("\n"):
        bare = line.strip()
        if not bare:
            kept.append(bare)
            continue
        if _own_number(bare, page_number, marks):
            noise.add("pageno")
            continue
        if bare[:3].lower() not in marks.starts and not bare[0].isdigit():
            kept.append(bare)
            continue
        cut = _GAP.search(bare) if "  " in bare else None
        if cut and _header(bare[: cut.start()], marks) and _own_number(bare[cut.end() :], page_number, marks):
            noise |= {"header", "pageno"}
            continue
        if _header(bare, marks):
            noise.add("header")
            continue
        if form_of(bare) in marks.titles and page_number is not None and page_number > 1:
            noise.add("header")
            continue
        kept.append(bare)
    return kept, noise


def stream(lines: list[str]) -> list[tuple[str, str, str]]:
    """Tokens as (text, gap before, hyphenated rest): the gap is a blank, ``l`` a line end,
    ``p`` an empty line; a token broken by a hyphen carries the rest from the next line."""
    out: list[tuple[str, str, str]] = []
    gap = "p"
    for line in lines:
        tokens = line.split()
        if not tokens:
            gap = "p"
            continue
        if out and gap == "l" and (m := _BROKEN.search(out[-1][0])) and (tokens[0][0].islower() or "஀" <= tokens[0][0] <= "௿"):
            out[-1] = (out[-1][0], out[-1][1], tokens.pop(0))
        for token in tokens:
            out.append((token, gap, ""))
            gap = " "
        gap = "l"
    return out


class Sieve:
    """Which words may stand in a table: each of its words does, of others a few."""

    def __init__(self, bits: bytes):
        self.bits, self.mask = bits, 8 * len(bits) - 1

    def __contains__(self, word: str) -> bool:
        digits = hashlib.md5(word.encode()).hexdigest()
        for i in (0, 7, 14, 21):
            at = int(digits[i : i + 7], 16) & self.mask
            if not self.bits[at >> 3] >> (at & 7) & 1:
                return False
        return True


@dataclass(frozen=True)
class Lexicon:
    """Counts of all words counted ``least`` times at least, and of long ones; a sieve of the rarer words, if there are any; the sum of all counts."""

    counts: dict[str, int]
    total: int
    least: int = KNOWN
    rare: Sieve | None = None


class Decoder:
    """The lexicon and the lattice.

    Rarer words count as unknown at first; those on which the decoding may depend are gathered in
    ``asked``. A form counted ``least`` times asks for none: a word it may be misread for is as frequent.
    What is asked for covers what decoding with their counts asks for, since more known words
    only leave fewer forms in doubt.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None, least: int = KNOWN, rare: Sieve | None = None):
        self.counts, self.least, self.rare = counts, least, rare
        self.total = max(1, sum(counts.values()) if total is None else total)
        self.cache: dict[str, tuple[str, float, int]] = {}
        self.sure: set[str] = set()  # tokens plainly known, edges and all
        self.strange: set[str] = set()  # unknown ones that no word explains and that are not misread
        self.open: dict[str, list[str]] = {}  # rarer words that a form of the cache may depend on
        self.asked: set[str] = set()
        self.long = sorted(w for w in counts if len(w) >= LONG - MOST and w.isalpha())

    def _readings(self, form: str) -> Iterator[tuple[str, int]]:
        """Words of letters the form may have been, through at most three confusions."""
        odd = [i for i, c in enumerate(form) if not c.isalpha()]
        if len(odd) > MOST or any(form[i] not in CONFUSIONS for i in odd):
            return  # a sign stays that is no letter
        places = []
        for i in range(len(form)):
            for width in (1, 2):
                seen = form[i : i + width]
                if len(seen) == width:
                    places += [(i, width, true) for true in CONFUSIONS.get(seen, ())]
        if len(form) >= LONG:
            yield from self._long_readings(form, places)
            return
        signs, letters = [p for p in places if p[0] in odd], [p for p in places if p[0] not in odd]
        for n in range(max(1, len(odd)), MOST + 1):
            choices: Iterable[tuple] = itertools.combinations(letters, n - len(odd))
            if odd:  # every sign is read as a letter; the order is that of the places
                rest = list(choices)
                order = {p: k for k, p in enumerate(places)}.__getitem__
                choices = sorted((tuple(sorted(a + b, key=order)) for a in itertools.combinations(signs, len(odd)) for b in rest), key=lambda c: [*map(order, c)])
            for chosen in choices:
                if any(a[0] + a[1] > b[0] for a, b in zip(chosen, chosen[1:])):
                    continue
                out, at = [], 0
                for i, width, true in chosen:
                    out += [form[at:i], true]
                    at = i + width
                yield "".join(out) + form[at:], n

    def _long_readings(self, form: str, places: list[tuple[int, int, str]]) -> Iterator[tuple[str, int]]:
        """The same for a long form, whose confusions are too many to try: only as far as a word begins so."""

        def begins(start: str) -> bool:
            k = bisect_left(self.long, start)
            return k < len(self.long) and self.long[k].startswith(start)

        todo = [("", 0, 0, 0)]
        while todo:
            done, at, first, n = todo.pop()
            word = done + form[at:]
            if n and word in self.counts and word.isalpha():
                yield word, n
            if n == MOST:
                continue
            for k in range(first, len(places)):
                i, width, true = places[k]
                if i < at:
                    continue
                start = done + form[at:i]
                if not begins(start):
                    break
                if begins(start + true):
                    todo.append((start + true, i + width, k + 1, n + 1))

    def read(self, token: str) -> tuple[str, float, int]:
        """(word, cost, confusions) of one token without its edges; -1 confusions: unknown."""
        form = token.lower()
        found = self.cache.get(form)
        if found is None:
            if len(self.cache) > 400_000:
                self.cache.clear()
                self.open.clear()
            found = self.cache[form] = self._read(form)
        if self.open and form in self.open:
            self.asked.update(self.open[form])
        return found

    def _read(self, form: str) -> tuple[str, float, int]:
        own = self.counts.get(form, 0)
        rare = self.rare if own < self.least else None
        if rare and len(form) < LONG:
            own = 0  # asked for, as are the words it may be misread for
        asked = [form] if rare and not own and form in rare else []
        best = (form, UNKNOWN + LETTER * len(form), -1)
        if own >= KNOWN or (own and not _WORD.match(form)):
            best = (form, -math.log(own / self.total), 0)
        letters = sum(c.isalpha() for c in form)
        if _WORD.match(form) and letters >= 1 and len(form) >= 2 and 2 * letters >= len(form):
            symbol = not form.isalpha()
            for word, n in self._readings(form):
                seen = self.counts.get(word, 0)
                if not seen and rare and word in rare:
                    asked.append(word)
                if seen >= KNOWN and seen >= (max(1, own) if symbol else TIMES * max(1, own) if own >= KNOWN else 5):
                    cost = -math.log(seen / self.total) + CONFUSION * n
                    if best[2] <= 0 or cost < best[1]:
                        best = (word, cost, n)
        if asked:
            self.open[form] = asked
        return best

    def _may_be_known(self, form: str) -> bool:
        return form in self.counts or self.rare is not None and form in self.rare

    def _count(self, word: str) -> int:
        seen = self.counts.get(word, 0)
        if not seen and self.rare and word in self.rare:
            self.asked.add(word)
        return seen

    def misread(self, token: str) -> bool:
        """Whether a token (edges cut) is a wrongly recognised word."""
        word, _, n = self.read(token)
        if n > 0:
            return True
        if n == 0:
            return False
        return bool(_INNER.match(token)) and len(token) >= 5

    def _pieces(self, token: str) -> list[tuple[list[str], float, set[str]]]:
        """Readings of one token that is neither known nor read through confusions."""
        word, cost, n = self.read(token)
        out = [([token if n <= 0 else word], cost, {"misread"} if self.misread(token) else set())]
        if n < 0 and token.isalpha() and len(token) >= 6:
            form = token.lower()
            for i in range(3, len(token) - 2):
                if not (self._may_be_known(form[:i]) and self._may_be_known(form[i:])):
                    continue
                (a, ca, na), (b, cb, nb) = self.read(token[:i]), self.read(token[i:])
                if na == 0 and nb == 0:
                    out.append(([token[:i], token[i:]], ca + cb + JOIN, set()))
        return out

    def decode(self, tokens: list[tuple[str, str, str]]) -> tuple[list[tuple[str, str]], set[str]]:
        """The best path through the lattice: (text, gap before) of each word, and the noise."""
        n = len(tokens)
        best: list[tuple[float, int, list[tuple[str, str]], set[str]]] = [(0.0, -1, [], set())] + [(math.inf, -1, [], set())] * n
        for i, (token, gap, rest) in enumerate(tokens):
            base = best[i][0]

            def offer(j: int, cost: float, words: list[tuple[str, str]], noise: set[str], at: int = i, start: float = base) -> None:
                if start + cost < best[j][0]:
                    best[j] = (start + cost, at, words, noise)

            if rest:
                left, right = core(token.rstrip(_HYPHENS)), core(rest)
                whole = left + right
                word, cost, seen = self.read(whole)
                tail = rest[rest.find(right) + len(right) :] if right else ""
                head = token[: token.find(left)] if left else ""
                shown = whole if seen <= 0 else word
                soft = token[-1] in _HYPHENS[1:]
                offer(i + 1, cost + (0 if soft else BREAK), [(head + shown + tail, gap)], {"hyphen"} | ({"misread"} if self.misread(whole) else set()))
                if not soft:
                    apart = self.read(left)[1] + self.read(right)[1]
                    both = self._count(f"{left}-{right}".lower())
                    if both >= KNOWN:
                        apart = min(apart, -math.log(both / self.total))
                    offer(i + 1, apart + BREAK, [(token + rest, gap)], set())
                continue
            bare = core(token)
            _, cost, seen = self.read(bare) if bare else ("", 0.0, 0)
            if seen == 0:
                offer(i + 1, cost, [(token, gap)], set())
                continue
            at = token.find(bare)
            for pieces, cost, noise in self._pieces(bare):
                shown = [token[:at] + pieces[0], *pieces[1:]]
                shown[-1] += token[at + len(bare) :]
                offer(i + 1, cost, [(w, gap if k == 0 else " ") for k, w in enumerate(shown)], noise)
            if i + 1 < n and tokens[i + 1][1] != "p" and not tokens[i + 1][2] and bare.isalpha():
                follow = core(tokens[i + 1][0])
                word, cost, seen = self.read(bare + follow)
                if seen == 0 and self.read(follow)[2] < 0 and len(bare) + len(follow) >= 6:
                    offer(i + 2, cost + JOIN, [(token + tokens[i + 1][0], gap)], set())
        parts: list[list[tuple[str, str]]] = []
        noise: set[str] = set()
        at = n
        while at > 0:
            _, before, part, found = best[at]
            parts.append(part)
            noise |= found
            at = before
        return [w for part in reversed(parts) for w in part], noise


def clean_tokens(text: str) -> list[str]:
    """Tokens for the lexicon: broken words are left out."""
    return [token for token, _, rest in stream(split_lines(text)[0]) if not rest]


def forms(tokens: Counter[str]) -> pd.DataFrame:
    """``word, n`` of counted tokens: bare edges, lower case."""
    counts: Counter[str] = Counter()
    for token, n in tokens.items():
        counts[core(token).lower()] += n
    counts.pop("", None)
    return pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines grouped to paragraphs: the cheapest series of line ends, each a mere wrap or a
    paragraph's end. A wrap wants a full line and no closed sentence, an end the opposite;
    an end behind a single line costs extra, so that short lines are not split one by one."""
    groups: list[list[str]] = []
    block: list[str] = []
    for line in [*lines, ""]:
        if line:
            block.append(line)
            continue
        if block:
            groups += _split_block(block)
        block = []
    return groups


def _split_block(lines: list[str]) -> list[list[str]]:
    width = max(map(len, lines))
    wrap, end = [], []
    for line, following in zip(lines, lines[1:]):
        room = width - len(line)
        fits = len(following.split(" ", 1)[0]) + 1 <= room
        closed = line.endswith((".", ":", "!", "?", "”")) or (line.isupper() and len(line.split()) > 2)  # a sentence or a heading
        starts = not following[:1].islower()
        wrap.append(3.0 * fits + 1.5 * (closed and starts and fits))
        end.append(2.0 + 4.0 * (not closed) + 3.0 * (not starts) + 2.0 * (not fits))
    # State: whether the present paragraph has one line so far; the way back is kept by line end.
    cost = {True: 0.0, False: math.inf}
    back: list[tuple[bool, bool]] = []
    for w, e in zip(wrap, end):
        from_single = cost[True] <= cost[False]
        ends_single = cost[True] + e + 0.5 <= cost[False] + e
        back.append((from_single, ends_single))
        cost = {False: min(cost.values()) + w, True: min(cost[True] + 0.5, cost[False]) + e}
    single = cost[True] <= cost[False]
    cuts = []
    for from_single, ends_single in reversed(back):
        cuts.append(single)
        single = ends_single if single else from_single
    groups = [[lines[0]]]
    for cut, line in zip(reversed(cuts), lines[1:]):
        if cut:
            groups.append([])
        groups[-1].append(line)
    return groups


def repaired(text: str, decoder: Decoder, page_number: int | None = None, marks: Marks = Marks()) -> str:
    """The text in continuous paragraphs, parted by empty lines."""
    lines, _ = split_lines(text, page_number, marks)
    out = []
    for group in paragraphs(lines):
        words, _ = decoder.decode(stream(group))
        out.append(" ".join(w for w, _ in words))
    return "\n\n".join(x for x in out if x)


def noise_of(text: str, decoder: Decoder, page_number: int | None = None, marks: Marks = Marks()) -> set[str]:
    """The sorts of noise in one text. The lattice is decoded only from the first token on
    that is broken or not plainly known; the path before it is certain. Unknown tokens alone,
    none broken and none misread, make no noise on any path."""
    lines, noise = split_lines(text, page_number, marks)
    tokens = stream(lines)
    cache, sure, strange = decoder.cache, decoder.sure, decoder.strange
    if len(sure) + len(strange) > 400_000:
        sure.clear()
        strange.clear()
    # Stretches of doubtful tokens, each with one certain token on either side.
    stretches: list[list[int]] = []
    for i, (token, _, rest) in enumerate(tokens):
        if not rest:
            if token in sure:
                continue
            telling = token not in strange
            if telling:
                form = core(token)
                if not form or (cache.get(form.lower()) or decoder.read(form))[2] == 0:
                    sure.add(token)
                    continue
                telling = decoder.misread(form) or form.lower() in decoder.open
                if not telling:
                    strange.add(token)
        else:
            telling = True
        if stretches and i == stretches[-1][1] + 1:
            stretches[-1][1] = i
            stretches[-1][2] |= telling
        else:
            stretches.append([i, i, telling])
    for first, last, telling in stretches:
        if telling:
            noise |= decoder.decode(tokens[max(0, first - 1) : last + 2])[1]
    return noise


def register_texts(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """``src, rec_key, doc_id, page_number, text`` of the two fields."""
    page = pages.select(F.lit("ec").alias("src"), F.col("page_id").cast("string").alias("rec_key"), "doc_id", F.col("page_number").cast("int").alias("page_number"), F.col("content").alias("text"))
    entry = entries.select(F.lit("ec_entry").alias("src"), F.concat_ws("#", "doc_id", F.col("seq").cast("string")).alias("rec_key"), "doc_id", F.lit(None).cast("int").alias("page_number"), F.col("remarks").alias("text"))
    return page.unionByName(entry).filter("text IS NOT NULL AND text <> ''")


def page_marks(texts: DataFrame) -> Marks:
    """What recurs as lines, counted over all records.

    A running header is a form of line, of two words at least and no sentence's end, that either
    has digits and stands alike, digits included, on the pages of a certificate, or holds the
    certificate's own number; or recurs word for word and stands as a line of its own nearly wherever
    it stands (a piece of running text is wrapped now here, now there). A page number is a form of
    at most two words whose number is the page's. A title is a line without digits that
    begins a tenth of all first pages. Forms are grouped with partial counts; those that
    come to the driver have a share of ``SHARE`` of all records at least, or qualify by their numbers.
    """
    rows = texts.select("doc_id", "page_number", F.split("text", "\n").alias("lines"))
    # A line as it stands; where its last gap is wider than a blank also what stands on either side.
    gap = r"^(.*\S)\s{2,}(\S+(?:\s\S+)*)$"
    parts = F.flatten(F.transform("lines", lambda x: F.when(F.trim(x).contains("  "), F.array(F.trim(x), F.regexp_extract(F.trim(x), gap, 1), F.regexp_extract(F.trim(x), gap, 2))).otherwise(F.array(F.trim(x)))))
    narrow = lambda c: F.when(c.contains("  ") | c.contains("\t"), F.regexp_replace(c, r"\s+", " ")).otherwise(c)
    lines = rows.select("doc_id", "page_number", (F.size("lines") > 1).alias("several"), F.explode(parts).alias("line")).filter("line <> ''")
    numbers = F.transform(F.regexp_extract_all("line", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.try_cast("bigint"))
    own = F.regexp_extract("doc_id", "([0-9]+)$", 1).try_cast("bigint")
    holds = lambda n: F.when(F.contains("line", n.cast("string")), F.exists(numbers, lambda x: x == n)).otherwise(F.lit(False))
    two = F.col("form").rlike(r"\p{L}{2,}[^\p{L}]+\p{L}{2,}")
    short = (F.length("form") <= 40) & ~F.col("form").rlike(r"(?:\p{L}[\p{L}\p{M}]*[^\p{L}\p{M}]+){2}\p{L}")
    told = lines.filter(F.col("line").rlike("[0-9]")).withColumn("form", narrow(F.regexp_replace(F.lower("line"), "[0-9]+", "#"))).filter(short | ~F.col("form").endswith(".") & two)
    told = told.select("doc_id", F.xxhash64("line").alias("line"), "form", "page_number", F.coalesce(holds(own), F.lit(False)).alias("own"), F.coalesce(holds(F.col("page_number")), F.lit(False)).alias("agrees"), short.alias("short"), (~F.col("form").endswith(".") & two).alias("titled"))
    by_line = told.groupBy("doc_id", "form", "line").agg(F.count("*").alias("n"), F.count("page_number").alias("paged"), F.count_if("own").alias("own"), F.count_if("agrees").alias("agrees"), F.first("short").alias("short"), F.first("titled").alias("titled"), F.min("page_number").alias("low"), F.max("page_number").alias("high"))
    by_doc = by_line.groupBy("doc_id", "form").agg(*[F.sum(c).alias(c) for c in ("n", "paged", "own", "agrees")], F.count("*").alias("forms"), F.first("short").alias("short"), F.first("titled").alias("titled"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("line").alias("a"), F.max("line").alias("z"))
    several = F.coalesce(F.col("low") < F.col("high"), F.lit(False))
    by_form = by_doc.groupBy("form").agg(*[F.sum(c).alias(c) for c in ("n", "paged", "own", "agrees")], F.count_if(several).alias("several"), F.count_if(several & (F.col("forms") == 1)).alias("equal"), F.first("short").alias("short"), F.first("titled").alias("titled"), (F.min("low") < F.max("high")).alias("spread"), (F.min("a") < F.max("z")).alias("varied"))
    number = F.col("short") & F.coalesce(F.col("spread"), F.lit(False)) & (F.col("paged") >= SEEN) & (F.col("agrees") >= F.col("paged") * AGREED)
    header = F.col("titled") & F.col("varied") & (F.col("n") >= SEEN) & ((F.col("own") >= F.col("n") * OWN) | ((F.col("several") >= REPEATED) & (F.col("equal") >= F.col("several") * EQUAL)))
    found = by_form.filter(number | header).select("form", number.alias("number")).collect()
    records = texts.count()
    plain = lines.withColumn("form", narrow(F.lower("line"))).filter(~short).filter("several AND line RLIKE '^[^\\\\p{Ll}]'").filter(~F.col("form").rlike(r"[.,;:‐-]$") & two).groupBy("form").agg(F.count("*").alias("n")).filter(F.col("n") >= max(SEEN, SHARE * records)).collect()
    first = rows.filter("page_number = 1").select(F.lower(F.trim(F.try_element_at("lines", F.lit(1)))).alias("line"))
    titles = first.filter(F.col("line").isin([r["form"] for r in plain])).groupBy("line").count().collect()
    total = first.count()
    title = frozenset(r["line"] for r in titles if r["count"] >= max(SEEN, TITLED * total))
    alone = _standing_alone(texts, {r["form"]: r["n"] for r in plain if r["form"] not in title})
    return Marks(frozenset(r["form"] for r in found if not r["number"]) | alone, frozenset(r["form"] for r in found if r["number"]), title)


def _standing_alone(texts: DataFrame, forms: dict[str, int]) -> frozenset[str]:
    """Of recurring lines without digits those that seldom stand inside running text: their number as
    lines is nearly that of all their occurrences in the de-lined texts."""
    if not forms:
        return frozenset()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for form in forms:
            machine.add_word(f" {form} ", form)
        machine.make_automaton()
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(found for _, found in machine.iter(" " + " ".join(text.lower().split()) + " "))
        yield pd.DataFrame({"form": list(counts), "n": list(counts.values())})

    seen = texts.select("text").mapInPandas(count, "form string, n long").groupBy("form").agg(F.sum("n").alias("n")).collect()
    return frozenset(r["form"] for r in seen if forms[r["form"]] >= EQUAL * r["n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all texts: every word of at least ``KNOWN``."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(clean_tokens(text))
            if len(counts) > 500_000:
                yield forms(counts)
                counts.clear()
        yield forms(counts)

    words = texts.select("text").mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= KNOWN).filter(F.col("word").rlike(r"[\p{L}]"))


def lexicon(words: DataFrame) -> Lexicon:
    """The lexicon of ``word_counts``. All words of one count are broadcast or none, so that what is
    told from the frequent words alone is what all words tell; the counts of counts are few."""
    total, many, rarer, least = 0, 0, 0, KNOWN
    for n, alike in sorted(((r["n"], r["count"]) for r in words.groupBy("n").count().collect()), reverse=True):
        total += n * alike
        many += alike
        if many > LEXICON:
            least = max(least, n + 1)
            rarer += alike
    frequent = (F.col("n") >= least) | (F.length("word") >= LONG - MOST) & F.col("word").rlike("^[a-z]+$")
    counts = {r["word"]: r["n"] for r in words.filter(frequent).collect()}
    return Lexicon(counts, total, least, sieve(words.filter(F.col("n") < least), rarer) if rarer else None)


def sieve(words: DataFrame, many: int) -> Sieve:
    bits = min(SIEVE_MOST, max(SIEVE_ROW, 1 << (SIEVE * many - 1).bit_length()))
    digits = F.md5(F.encode("word", "UTF-8"))
    at = F.explode(F.array(*[F.conv(F.substring(digits, i, 7), 16, 10).cast("long") % bits for i in (1, 8, 15, 22)]))
    rows = words.select(at.alias("at")).groupBy(F.floor(F.col("at") / SIEVE_ROW).alias("row")).agg(F.bitmap_construct_agg(F.col("at") % SIEVE_ROW).alias("bits"))
    whole = bytearray(bits // 8)
    for r in rows.collect():
        whole[r["row"] * SIEVE_ROW // 8 : (r["row"] + 1) * SIEVE_ROW // 8] = r["bits"]
    return Sieve(bytes(whole))


def _decoded(texts: DataFrame, rows: DataFrame, values: Callable[[str, Decoder, int | None, Marks], Iterable[str]]) -> DataFrame:
    """``src, rec_key, value`` of all that ``values`` gives for the text of each of ``rows``; words and lines are counted over ``texts``."""
    words = cut(word_counts(texts))
    lex = lexicon(words)
    known = texts.sparkSession.sparkContext.broadcast((lex, page_marks(texts)))
    whole = lex.rare is None
    number = lambda p: None if pd.isna(p) else int(p)
    fields = ["src", "rec_key", "page_number", "text"]
    told = "src string, rec_key string, value string"

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, marks = known.value
        decoder = Decoder(lex.counts, lex.total, lex.least, lex.rare)
        ids = itertools.count(TaskContext.get().partitionId() << 40)
        for batch in batches:
            done, kept = [], []
            for src, key, page, text in zip(*(batch[c] for c in fields)):
                found = values(text, decoder, number(page), marks)
                if decoder.asked:
                    kept.append((src, key, number(page), text, next(ids), sorted(decoder.asked)))
                    decoder.asked.clear()
                else:
                    done += [(src, key, value) for value in found]
            yield pd.DataFrame(done, columns=["src", "rec_key", "value"]) if whole else pd.DataFrame([(s, k, v, None, None, None, None) for s, k, v in done] + [(s, k, None, *more) for s, k, *more in kept], columns=["src", "rec_key", "value", "page_number", "text", "id", "words"]).astype({"page_number": "Int64", "id": "Int64"})

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex, marks = known.value
        counts = dict(lex.counts)
        decoder = Decoder(counts, lex.total)
        for batch in batches:
            rarer = {w: n for words, ns in zip(batch["words"], batch["ns"]) if words is not None for w, n in zip(words, ns)}
            counts.update(rarer)
            done = [(src, key, value) for src, key, page, text in zip(*(batch[c] for c in fields)) for value in values(text, decoder, number(page), marks)]
            for word in rarer.keys() - lex.counts.keys():
                del counts[word]
            yield pd.DataFrame(done, columns=["src", "rec_key", "value"])

    rows = rows.select(fields)
    if whole:
        return rows.mapInPandas(first, told)
    out = cut(rows.mapInPandas(first, told + ", page_number int, text string, id long, words array<string>"))
    found = out.select("id", F.explode("words").alias("word")).join(words.filter(F.col("n") < lex.least), "word").groupBy("id").agg(F.collect_list(F.struct("word", "n")).alias("found"))
    kept = out.filter("id IS NOT NULL").drop("words").join(found, "id", "left").select(*fields, F.col("found.word").alias("words"), F.col("found.n").alias("ns"))
    return out.filter("id IS NULL").select("src", "rec_key", "value").unionByName(kept.mapInPandas(again, told))


def noise(texts: DataFrame) -> DataFrame:
    """``src, rec_key, noise`` of ``register_texts``: one row per record and sort of noise.

    NULL and empty texts have none; repeated records count once; with no text at all the
    lexicon is empty and no row comes out. Texts of any length are decoded whole.
    """
    return _decoded(texts, texts, noise_of).withColumnRenamed("value", "noise").distinct()


def repair(texts: DataFrame) -> DataFrame:
    """``src, rec_key, text`` with the text in continuous readable paragraphs; a record delivered
    several times comes out once, with the text of one delivery (they are equal)."""
    rows = texts.select("src", "rec_key", "page_number", "text").distinct()
    return _decoded(texts, rows, lambda text, *known: [repaired(text, *known)]).withColumnRenamed("value", "text")
