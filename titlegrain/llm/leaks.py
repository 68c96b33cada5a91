"""Problem 8: evaluation texts leaking into training text.

Method: an FM-index per training shard. Texts are reduced to the letters and digits of the
items (case, punctuation and spacing disregarded), shards of about ``SHARD`` letters are
suffix-sorted, their Burrows-Wheeler transform is kept as a wavelet matrix, and the
phrases of the items (every ``SEED`` successive words) are found by backward search with
wavelet ranks, all phrases at once in numpy. Occurrences are located by sampled suffix
positions, extended word by word with altered words allowed, and merged to removal spans.

A passage of 28 words with one in eight altered always keeps ``SEED`` successive words. From
each run of such seeds all alignments are followed at once, as bit sets of places by number of
altered words, so that no passage is missed wherever its altered words stand; an altered word
at an end is one word of the text (in a text without blanks a passage ends with intact words).
Items are broadcast in batches of at most ``ITEMS``; shards are built where the documents lie,
without a shuffle.
"""

from __future__ import annotations

import bisect
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a passage, words of a searched phrase, one altered word in so many.
LEAST, SEED, ALTERED = 28, 6, 8
#: Least seeds of a passage: of its n words at least 7/8 are intact, in at most n/8 + 1 runs, and a
#: run of r words has r - 5 seeds; the least sum over all n from 28 on is 3, at n = 32.
SEEDS = 3
#: So many letters longer than the word it stands for may an altered one be.
BEYOND = 24
#: Letters of one shard; a longer text is cut into pieces that overlap by ``OVERLAP``.
SHARD, OVERLAP = 1_000_000, 20_000
#: Every so many text positions a suffix position is sampled.
SAMPLE = 16
#: Most items in one batch, which is broadcast.
ITEMS = 20_000
_DROP, _END, _OTHER, _NEVER = -1, 1, 2, 1 << 20  # 0 ends the shard
_BLANKS = np.array([0] + [c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _plain(sign: str) -> str:
    """One letter or digit without case and accent, or nothing."""
    sign = unicodedata.normalize("NFKD", sign.lower())[:1]
    return sign if sign.isalnum() else ""


def plain_words(text: str) -> list[str]:
    return ["".join(map(_plain, w)) for w in text.split()]


class Alphabet:
    """Codes of the letters in the items; other letters share one code, the rest is dropped."""

    def __init__(self, letters: str):
        self.codes = {c: i + 3 for i, c in enumerate(sorted(set(letters)))}
        if len(self.codes) > 50_000:
            raise ValueError("more than 50,000 different letters in the items")
        self.bits = (len(self.codes) + 2).bit_length()
        self.kind = np.uint8 if self.bits < 8 else np.uint16
        self._table: np.ndarray | None = None

    def table(self) -> np.ndarray:
        if self._table is None:
            table = np.full(0x110000, _OTHER, np.int32)
            wide = (0x3400, 0xD800) if any("\u3400" <= c < "\ud800" for c in self.codes) else (0, 0)
            for code in (*range(0x3400), *range(*wide), *range(0xE000, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F000, 0x1FB00), *(map(ord, self.codes))):
                plain = _plain(chr(code))
                table[code] = self.codes.get(plain, _OTHER) if plain else _DROP
            table[0] = _END
            self._table = table
        return self._table

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the kept letters, and where each stands in ``text``."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.table()[points]
        kept = np.flatnonzero(codes != _DROP)
        return codes[kept].astype(self.kind), kept


    @staticmethod
    def begins(text: str, kept: np.ndarray) -> np.ndarray:
        """Which kept letters of ``text`` begin a word (and each end of a text), and their number."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = np.isin(points, _BLANKS).cumsum()[kept]
        return np.flatnonzero(np.concatenate([[True], blank[1:] != blank[:-1], [True]]))


def suffix_array(codes: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the sorted suffixes, by doubling; only tied suffixes are sorted again."""
    n = len(codes)
    width = 62 // bits
    padded = np.concatenate([codes.astype(np.int64), np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = start
    tied = np.flatnonzero(~first | np.concatenate([~first[1:], [False]])) if n else np.zeros(0, np.int64)
    depth = width
    while len(tied):
        who = order[tied]
        second = rank[np.minimum(who + depth, n)] + 1
        both = rank[who] * (n + 2) + second
        sub = np.argsort(both, kind="stable")
        order[tied] = who = who[sub]
        both = both[sub]
        new = np.concatenate([[True], both[1:] != both[:-1]])
        rank[who] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        still = ~new | np.concatenate([~new[1:], [False]])
        tied = tied[still]
        depth *= 2
    return order


class FMIndex:
    """Backward search over one shard of codes from 1 on."""

    def __init__(self, codes: np.ndarray, bits: int):
        codes = np.concatenate([codes, np.zeros(1, codes.dtype)])
        n = len(codes)
        suffixes = suffix_array(codes, bits)
        self.n, self.bits = n, bits
        self.bwt = codes[suffixes - 1]
        self.below = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1 << bits))])
        self.zeros, self.counts = [], []
        row = self.bwt
        for level in range(bits - 1, -1, -1):
            bit = (row >> level) & 1
            count = np.zeros(n + 1, np.int32)
            np.cumsum(1 - bit, out=count[1:])
            self.counts.append(count)
            self.zeros.append(int(count[n]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        symbols = np.arange(1 << bits)
        self.base = self._descend(symbols, np.zeros(1 << bits, np.int64))
        sampled = suffixes % SAMPLE == 0
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled)
        self.samples = suffixes[sampled]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, zeros, count in zip(range(self.bits - 1, -1, -1), self.zeros, self.counts):
            low = count[at].astype(np.int64)
            at = np.where((symbol >> level) & 1, zeros + at - low, low)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rows of suffixes that begin with ``symbol``, before row ``at``."""
        return self.below[symbol] + self._descend(symbol, at) - self.base[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of all patterns (right-aligned rows of codes)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.n, np.int64)
        alive = np.arange(len(patterns))
        width = patterns.shape[1]
        for back in range(1, int(lengths.max(initial=0)) + 1):
            alive = alive[(lengths[alive] >= back) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = patterns[alive, width - back].astype(np.int64)
            low[alive] = self.step(symbol, low[alive])
            high[alive] = self.step(symbol, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to the next sampled suffix."""
        rows = rows.astype(np.int64)
        steps = np.zeros(len(rows), np.int64)
        going = np.flatnonzero(~self.sampled[rows])
        while len(going):
            at = rows[going]
            rows[going] = self.step(self.bwt[at].astype(np.int64), at)
            steps[going] += 1
            going = going[~self.sampled[rows[going]]]
        return (self.samples[self.sample_rank[rows] - 1] + steps) % self.n


class Items:
    """The evaluation items, their words and their phrases."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids = ids
        self.words = [plain_words(t) for t in texts]
        self.alphabet = Alphabet("".join("".join(w) for w in self.words))
        phrases: dict[str, list[tuple[int, int]]] = {}
        for k, words in enumerate(self.words):
            for i in range(len(words) - SEED + 1):
                phrases.setdefault("".join(words[i : i + SEED]), []).append((k, i))
        phrases.pop("", None)
        self.where = list(phrases.values())
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        width = int(self.lengths.max(initial=1))
        self.patterns = np.zeros((len(phrases), width), self.alphabet.kind)
        code = self.alphabet.codes
        for row, phrase in enumerate(phrases):
            self.patterns[row, width - len(phrase) :] = [code[c] for c in phrase]
        self.coded = [["".join(chr(code[c]) for c in w) for w in words] for words in self.words]


def _spread(places: int, most: int) -> int:
    """Bit set of all places from 0 to ``most`` beyond those of ``places``."""
    have = 1
    while 2 * have <= most + 1:
        places |= places << have
        have *= 2
    return places | places << (most + 1 - have)


class _Window:
    """A part of a stream in which occurrences of words are bit sets of their places;
    ``begins`` are the places where the text's own words begin, and the part's end."""

    def __init__(self, stream: str, begins: list[int]):
        self.stream, self.full, self.begins = stream, (1 << len(stream) + 1) - 1, begins
        self.edges = functools.reduce(lambda bits, at: bits | 1 << at, begins, 0)
        self.known: dict[str, int] = {"": self.full}

    def places(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            found, at = 0, self.stream.find(word)
            while at >= 0:
                found |= 1 << at
                at = self.stream.find(word, at + 1)
            self.known[word] = found
        return found


def _extended(words: list[str], window: _Window, at: int, most: int) -> tuple[np.ndarray, list[int]]:
    """Of 0, 1, 2, ... words aligned from ``at`` on, the fewest altered ones, and where the last
    intact one ends.

    Between intact words an altered one is any string of up to ``BEYOND`` letters more; behind
    the last intact one it is a word of the text. All alignments are followed at once:
    ``reached[a]`` is the set of places where an alignment with ``a`` altered words ends."""
    reached = [1 << at] + [0] * most
    fewest, ends = np.full(len(words) + 1, _NEVER), [at] * (len(words) + 1)
    fewest[0] = 0
    for r, word in enumerate(words, 1):
        places, size = window.places(word), len(word)
        fresh, seen = [], 0
        for a in range(most + 1):
            intact = (reached[a] & places) << size
            if intact and fewest[r] == _NEVER:
                best = intact & window.edges or intact
                fewest[r], ends[r] = a, (best & -best).bit_length() - 1
            all_ = intact | (_spread(reached[a - 1], size + BEYOND) & window.full if a and reached[a - 1] else 0)
            all_ &= ~seen
            seen |= all_
            fresh.append(all_)
        if not seen:
            break
        reached = fresh
    for r in np.flatnonzero(fewest < most).tolist():
        k = bisect.bisect_left(window.begins, ends[r])
        if k < len(window.begins) and window.begins[k] == ends[r]:
            for e in range(1, min(most - int(fewest[r]), len(words) - r, len(window.begins) - 1 - k) + 1):
                if fewest[r] + e < fewest[r + e]:
                    fewest[r + e], ends[r + e] = fewest[r] + e, ends[r]
    return fewest, ends


def passage(words: list[str], stream: str, begins: np.ndarray, i: int, at: int, low: int, high: int) -> tuple[int, int, int] | None:
    """The longest passage through the intact word ``i`` at ``at``: (words, from, to), or None if
    no passage of ``LEAST`` words with one in ``ALTERED`` altered runs through it (exact)."""
    most = len(words) // ALTERED
    slack = most * BEYOND
    low = max(low, at - sum(map(len, words[:i])) - slack)
    high = min(high, at + sum(map(len, words[i:])) + slack)
    text = stream[low:high]
    # No alignment has fewer altered words than words that stand nowhere in the window.
    lost = np.concatenate([[0], np.cumsum([w not in text for w in words])])
    if not _allowed(lost[i] - lost[i::-1], lost[i:] - lost[i]).any():
        return None
    first, last = np.searchsorted(begins, (low, high + 1))
    edges = (begins[first:last] - low).tolist()
    right, to = _extended(words[i:], _Window(text, edges), at - low, most)
    left, fro = _extended([w[::-1] for w in reversed(words[:i])], _Window(text[::-1], [len(text) - e for e in reversed(edges)]), high - at, most)
    fits = _allowed(left, right)
    if not fits.any():
        return None
    sizes = np.arange(len(left))[:, None] + np.arange(len(right))
    x, y = np.unravel_index(np.argmax(np.where(fits, sizes, -1)), fits.shape)
    return int(x + y), high - fro[x], low + to[y]


def _allowed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which numbers of words to the left and right make a passage, by their altered words."""
    sizes = np.arange(len(left))[:, None] + np.arange(len(right))
    return (sizes >= LEAST) & ((left[:, None] + right) * ALTERED <= sizes)


def search_shard(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int]]:
    """(text, item, words, from, to) of every leaked passage in one shard."""
    joined = "\0".join(texts) + "\0"
    codes, places = items.alphabet.encode(joined)
    if len(codes) < 2 or not len(items.patterns):
        return []
    index = FMIndex(codes, items.alphabet.bits)
    low, high = index.search(items.patterns, items.lengths)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return []
    sizes = high[hit] - low[hit]
    rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    phrase = np.repeat(hit, sizes)
    at = index.locate(rows)
    ends = np.flatnonzero(codes == _END)
    text = np.searchsorted(ends, at)
    # Every (text, item) with its seeds.
    many = np.array([len(items.where[p]) for p in phrase])
    item = np.array([k for p in phrase for k, _ in items.where[p]])
    word = np.array([i for p in phrase for _, i in items.where[p]])
    text, at = np.repeat(text, many), np.repeat(at, many)
    order = np.lexsort((at, item, text))
    text, item, word, at = text[order], item[order], word[order], at[order]
    cuts = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]), [True]]))
    stream = codes.astype("<u4").tobytes().decode("utf-32-le")
    starts = np.concatenate([[0], ends + 1])
    begins = items.alphabet.begins(joined, places)
    bases = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < SEEDS:
            continue
        t, k = int(text[a]), int(item[a])
        words = items.coded[k]
        done, run = -1, {}
        for i, p in zip(word[a:b].tolist(), at[a:b].tolist()):
            # A seed behind another one of the same intact run has no passage of its own.
            follows = run.pop((i, p), False)
            run[i + 1, p + len(words[i])] = True
            if p < done or follows:
                continue
            found = passage(words, stream, begins, i, p, int(starts[t]), int(ends[t]))
            if found:
                size, f, to = found
                done = to
                out.append((t, k, size, int(places[f] - bases[t]), int(places[to - 1] - bases[t]) + 1))
    return out


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, words, span_from, span_to`` of each leaked passage (code points).

    NULL and empty texts have no passage; repeated texts are each reported under their id;
    an empty item list or corpus gives no row; a very long text is searched in overlapping
    pieces. Other columns of the inputs are not read.
    """
    asked = items.select("item_id", "item_text").filter("item_text IS NOT NULL").distinct()
    parts = max(1, -(-asked.count() * 5 // (4 * ITEMS)))  # a fifth more batches, as their sizes differ
    batch = F.pmod(F.xxhash64("item_id", "item_text"), F.lit(parts))
    found = [_leaks_of(documents, sorted(asked.filter(batch == p).collect())) for p in range(parts)]
    return functools.reduce(DataFrame.unionByName, found)


def _leaks_of(documents: DataFrame, rows: list) -> DataFrame:
    """``leaks`` for one batch of items."""
    known = documents.sparkSession.sparkContext.broadcast(Items([r["item_id"] for r in rows], [r["item_text"] for r in rows]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = known.value

        def shard(pieces: list[tuple[int, int, str]]) -> pd.DataFrame:
            found = search_shard([t for _, _, t in pieces], items)
            return pd.DataFrame([(pieces[t][0], items.ids[k], size, pieces[t][1] + a, pieces[t][1] + b) for t, k, size, a, b in found], columns=["doc_id", "item_id", "words", "span_from", "span_to"])

        pieces, size = [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"]):
                for start in range(0, max(1, len(text) - OVERLAP), SHARD - OVERLAP):
                    piece = text[start : start + SHARD].replace("\0", " ")
                    if size + len(piece) > SHARD and pieces:
                        yield shard(pieces)
                        pieces, size = [], 0
                    pieces.append((doc, start, piece))
                    size += len(piece)
        if pieces:
            yield shard(pieces)

    texts = documents.select("doc_id", "text").filter("text IS NOT NULL AND text <> ''")
    return texts.mapInPandas(run, "doc_id long, item_id int, words int, span_from long, span_to long")


def removal_spans(found: DataFrame) -> DataFrame:
    """Overlapping spans of a document merged: ``doc_id, span_from, span_to, items``."""
    merged = F.expr(
        """aggregate(array_sort(collect_set(struct(span_from, span_to))), cast(array() AS array<struct<span_from: bigint, span_to: bigint>>),
        (done, s) -> if(size(done) > 0 AND element_at(done, -1).span_to >= s.span_from,
          concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).span_from AS span_from, greatest(element_at(done, -1).span_to, s.span_to) AS span_to))),
          concat(done, array(s))))"""
    )
    return found.groupBy("doc_id").agg(merged.alias("spans"), F.sort_array(F.collect_set("item_id")).alias("items")).select("doc_id", F.inline("spans"), F.concat_ws(",", F.transform("items", lambda i: i.cast("string"))).alias("items"))
