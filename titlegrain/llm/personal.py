"""Problem 3: personal information inside free text.

Method: a linear-chain conditional random field over word-shape features, trained on the
driver from a small labelled table (``labelled_table``), decoded by Viterbi in numpy over
whole batches of records. An exact check of digits and signs follows for addresses of
mail, phones and identity numbers.

The score of a word is the sum of three table rows (the word as present, previous and next
one) and of two flags for organisations nearby. Rows are computed once per distinct word
form (digits made alike), so that a batch costs one dictionary lookup per word and a few
array operations. No shuffle but the final DISTINCT.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegrain.llm import encodings
from titlegrain.nulls import missing

LABELS = ("O", "EMAIL", "PHONE", "IDNUM", "ADDRESS", "NAME")
#: Hashed features of one position; training rounds, step, ridge for the word itself and for the
#: words beside it; words nearby that are looked at for organisations.
WIDTH, ROUNDS, STEP, RIDGE, CONTEXT, NEAR = 1 << 13, 160, 0.05, 1e-4, 2e-3, 5

# Words that make a party an organisation.
ORGANISATION = {"bank", "limited", "ltd", "corporation", "corpn", "finance", "federation", "foundations", "builders", "society", "trust", "company", "private", "pvt", "cooperative", "co-op", "court", "board", "office", "development", "housing", "savings", "owners"}

_DIGITS = str.maketrans("123456789", "000000000")
_LIST_NUMBER = re.compile(r"0{1,3}\.$")
_TOKEN = re.compile(r"\S+")


def shape(word: str) -> str:
    out = []
    for ch in word:
        kind = "0" if ch.isdigit() else "T" if "஀" <= ch <= "௿" else "X" if ch.isupper() else "x" if ch.isalpha() else ch
        if not (len(out) > 1 and out[-1] == kind == out[-2] and kind in "TXx"):
            out.append(kind)
    return "".join(out)


def features(word: str) -> list[int]:
    """Hashed features of one word form whose digits are all 0."""
    low = word.lower().strip(".,;:()<>“”\"'‘’")
    figure = shape(word)
    names = [f"w={word.lower()}", f"s={figure}", f"l={low}", f"e3={low[-3:]}", f"e4={low[-4:]}", f"b3={low[:3]}", f"n={min(sum(c == '0' for c in word), 14)}"]
    names += [f"z={figure[-1:]}", f"a={figure[:2]}"]
    bare = word.strip(".,;:()<>")
    names += [f"t={shape(bare)}", f"d={sum(c == '0' for c in bare)}"]
    # What tells nearly for certain counts several times, so that it outweighs the words around.
    if re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", bare):
        names += ["mail1", "mail2", "mail3", "mail4", "mail5"]
    if re.fullmatch(r"\+?[0-]{10,14}", bare) and not re.fullmatch(r"0{4}-?0{4}-?0{4}", bare):
        names += ["phone1", "phone2", "phone3"]
    if re.fullmatch(r"0{4}-?0{4}-?0{4}", bare):
        names += ["number1", "number2", "number3"]
    if low in ORGANISATION:
        names.append("org")
    if len(low) == 1 and word[:1].isupper():
        names.append("initial")
    if re.fullmatch(r"[஀-௿]{1,3}\.", word):
        names.append("initial")
    if re.fullmatch(r"[A-Z]{3,5}0{4,7}[A-Z]?", word.strip(".,;)")):
        names += ["letterid1", "letterid2", "letterid3", "letterid4", "letterid5"]
    return [zlib.crc32(n.encode()) % WIDTH for n in names]


# The labelled table: sentences of a general kind with marked slots, and fillers of each slot.
# Neither the sentences nor the names, places and firms are those of the tables this is run on;
# digits are placeholders that are made alike before use.
_STEMS = "Ramesh Suresh Karthik Ganesh Murugan Kannan Shankar Prakash Mohan Gopal Hari Krishna Mahesh Venkat Bhaskar Dinesh Lakshmi Meena Priya Anitha Revathi Kamala Indira Latha Nirmala Padma Radha Sarala Usha Chitra Geetha Saroja Balu Jagan".split()
_ENDS = "an am esh appan ammal raj babu lal nayagam chandran lingam vathi priya achari das prasad".split()
_TAMIL_NAMES = "முருகன் லட்சுமி கார்த்திக் ராஜேந்திரன் மீனாட்சி சரவணன் கண்ணன் விஜயா ரமேஷ் கணேசன் சங்கர் கமலா பாலாஜி சீனிவாசன் கோமதி சுப்பிரமணியன்".split()
_FOREIGN = ["Marie Dubois", "João Almeida", "Chloé Lambert", "Émile Rochat", "André Figueira", "Inês Carvalho"]
_ORG_FIRST = ["Everest", "Lotus Valley", "Sunrise", "Blue Hill", "Garuda", "Oakfield", "Nilgai", "Seven Stars", "Heron Bay", "Pioneer", "Crescent", "Peacock Plains", "Orchid", "Granite City"]
_ORG_TRADE = ["Farmers", "Teachers", "General", "National", "Industrial", "Handloom", "Central", "Peoples"]
_ORG_KIND = ["Housing Finance Limited", "Savings Bank Limited", "Foundations Private Limited", "Builders Pvt Ltd", "Finance Ltd", "Cooperative Bank Limited", "Development Corporation", "Dev. Corpn", "Co-op Bank Ltd", "Builders Private Limited", "Bank Ltd"]
_PLACES = "Ottapalli Karaiyur Velampatti Northwick Manjapet Tirukavur Alagarpuri Kizhamedu Saint-Aubin Pont-Évrard Melpadi Thottiyam Arasankulam Elavur".split()
_COURTS = ["Karaiyur", "Ottapalli", "Northwick", "Melpadi", "Tirukavur", "Elavur", "Manjapet"]
_SYLLABLES = "ka ki ku ke ko ga gu cha chi sa si su ta ti tu tha thi thu da di du na ni nu pa pi pu ba bi bu ma mi mu ya yu ra ri ru la li lu va vi zha zhi ja je".split()
_STREETS = ["River Bank", "Mill Bank", "Gandhi", "Station", "Lake View", "Market", "Palace", "Hospital", "First Link", "Fourth", "New Bridge", "Tamarind", "Smiths", "Lotus"]
_SENTENCES = [
    "A gift was made by {NAME} to {NAME} under deed 0000/0000, the donor keeping the house for life.",
    "On 00-May-0000 the sale deed 000/0000 was lodged by {NAME}, who sold to {NAME} at a price of Rs. 00,00,000/-.",
    "Deed 0000/0000 was lodged by {NAME} in favour of {NAME} on 00/00/0000 for Rs. 0,00,000/- in all.",
    "Rented to {NAME} for 00 months with effect from 00.00.0000, the monthly rent being Rs. 00,000/-.",
    "The upper storey is let to {NAME} from 00-Jun-0000 at Rs. 0,00,000/- a year.",
    "Plot number 000/0B at {PLACE} village, 0000 Sq.Ft in size, has to its north the field of {NAME}.",
    "Half an acre in survey number 000/00 of {PLACE}, having on the east the land of {NAME}. Earlier deeds 000/0000 and 0000/0000 are recited there, volume 000, page 00.",
    "The borrower {NAME} charged the site to {ORG} for Rs. 00,00,000/-, see entry 0000/0000.",
    "Title papers were handed by {NAME} to {ORG} against a loan of Rs. 0,00,000/-, see entry 000/0000.",
    "An agent was appointed by {NAME} under power 0000/0000 for dealing with survey number 00/0A0.",
    "Power 000/0000 given by {NAME} allows the agent to let the plot.",
    "The life interest of the settlor {NAME} ends with the survivor.",
    "The amount of Rs. 00,00,000/- was repaid, receipt 000/0000 of 00-Oct-0000. The volume was compared with its index on 00-Jan-0000.",
    "EXTRACT OF ENTRIES The indexes of Book 0 were searched from 00-Apr-0000 to 00/00/0000.",
    "Duty was paid on the value of Rs. 00,00,000/- fixed by the officer. The search fee for 00 years stands credited by challan of 00-Aug-0000.",
    "No further act or encumbrance was found in the books of this office, except as stated in this paper.",
    "To the east lies a tank, on the west survey number 000/00B. The schedule speaks of a vacant house site with a right of way on the south side and a road of 00 feet.",
    "DEPARTMENT OF REGISTRATION B0000000 Sheet 0 of 0 Deeds still waiting to be indexed are not part of it, nor acts that need no registration.",
    "Certificate C/0000/0000 | Register Search RS-00-0000 - List of Entries Sub Registrar's Office :: C/0000/0000",
    "This office is not answerable for a wrong description given by the applicant, whose form reached it on 00-Sep-0000.",
    "Number masked as XXXX-XXXX-0000. Account head 0000-00-000-0000. Challan no CH000000 of 00-Feb-0000. Land of 000 m² – plan attached.",
    "Remark – the copy carries ₹ 00 stamps. “Discharged” written in the margin. Café Bleu Rivage struck out of the list. Area altered to 0¼ acres – as ordered.",
    "Account head 0000-00-000-0000. Site 00 m² – checked. Officer’s remark: “seen”. Sheet: 0 Pg. 00 [0] 0 / 0 - 0 -",
    "Where needed the Registrar may refuse a copy. Both documents were seen by the Inspector. Volume 00 was rebound in the year 0000. Court fee was paid.",
    "ஆவணம் 0000/0000 வழியாக {NAME} என்பவருக்கு Rs. 00,00,000/- மதிப்பில் விற்கப்பட்டது.",
    "{NAME} என்பவரிடம் இருந்து {NAME} பெயருக்கு 0000/0000 எண் பத்திரம் மூலம் மாற்றப்பட்டது.",
    "இந்தச் சொத்தில் வேறு பதிவுகள் இல்லை. கடன் அடைக்கப்பட்டு ரசீது 0000/0000 பதிவானது.",
    "கரையூர் கிராமத்தின் சர்வே எண் 000/0B பற்றிய புத்தகங்கள் 00.00.0000 வரை பார்க்கப்பட்டன. கட்டணம் Rs. 0,000/- பெறப்பட்டது.",
    "தெற்கில் பொதுச்சாலை உள்ளது. விவரங்கள் ஒப்பிடப்பட்டன. தாள் 0",
    "He lives at {ADDRESS}.",
    "Letters may go to {ADDRESS}",
    "{ADDRESS} is the home address on file.",
    "WhatsApp number {PHONE}",
    "Tel {PHONE}.",
    "Mobile: {PHONE}",
    "Ring {PHONE} in the forenoon.",
    "Write to: {EMAIL}",
    "A scan goes to {EMAIL}.",
    "A mail came from {EMAIL} last week.",
    "The complaint sent by {EMAIL} about it is filed.",
    "Please answer {EMAIL} within a week. Fee of Rs. 000/- paid.",
    "Reach the family at {ADDRESS}. The plan was drawn in the year 0000.",
    "Identity card: {IDNUM}",
    "Card {IDNUM} was shown.",
    "PAN or Aadhaar of the party {IDNUM}",
    "0. {NAME}",
    "0. {NAME} 0. {NAME}",
    "{NAME}",
    "{BARE}",
    "0. {BARE}",
    "{BARE}, {PHONE}",
    "{BARE}, {IDNUM}",
    "{BARE}, living at {ADDRESS}",
    "0. {ORG}",
    "{ORG}",
    "0. {NAME} 0. {ORG} 0. {NAME}",
    "0. {ORG} 0. {NAME}",
    "0. {ORG}, loan 0000/0000",
    "0. {ORG}, no XXXX XXXX 0000",
    "0. {ORG}, volume 0000",
    "0. {NAME}, loan 0000/0000",
    "0. {NAME}, volume 0000",
    "{NAME}, no XXXX XXXX 0000",
    "0. {NAME} – buyer",
    "0. {NAME} … and others",
    "0. {NAME} “Second Party”",
    "0. {ORG} “Second Party”",
    "0. {ORG} – ¼ share",
]


# What a party list adds to a name, in any order.
_EXTRAS = [", {EMAIL}", ", e-mail {EMAIL}", " <{EMAIL}>", ", {PHONE}", " Ph {PHONE}", " (M) {PHONE}", ", Cell {PHONE}", ", {IDNUM}", " ID {IDNUM}", ", Aadhaar {IDNUM}", ", PAN/UID {IDNUM}", ", {ADDRESS}", ", r/o {ADDRESS}", ", residing at {ADDRESS}"]


def _filled(slot: str, random: np.random.Generator) -> str:
    pick = lambda xs: xs[int(random.integers(len(xs)))]


    def name() -> str:
        """A listed name, or one of random syllables, so that no list of names is learnt."""
        if random.random() < 0.4:
            return pick(_STEMS) + pick(_ENDS)
        made = "".join(pick(_SYLLABLES) for _ in range(int(random.integers(2, 5)))) + pick(["", "", "n", "m", "l", "r"])
        if random.random() < 0.06:
            made = made.replace(pick("aeiou"), pick("éèêâôîàç"), 1)
        return made.capitalize()

    letter = lambda: pick("ABCDEGIJKMNOPRSTUVY")
    if slot == "NAME":
        kind = int(random.integers(17))
        typo = name()
        at = int(random.integers(1, len(typo) - 1))
        return [f"{letter()}. {name()}", f"{letter()}. {name()}", f"{name()} {letter()}", f"{name()} S/o {name()}", f"{name()} D/o {name()}", name(), f"{letter()}.{name()}", f"Mr {name()} {letter()}.", f"Thiru. {letter()} {name()}", f"{name()}, son of {name()}", f"{pick(_STEMS)} {pick(_ENDS).title()} {letter()}", f"{name()} @ {pick(_STEMS)}", f"{pick('சமகரவநபதஇஎ')}. {pick(_TAMIL_NAMES)}", pick(_FOREIGN), f"{letter()}. {name()}".upper(), f"Mrs {typo[:at] + typo[at + 1 :]} {letter()}.", f"{name()} {name()}"][kind]
    if slot == "BARE":
        return pick([name(), name(), pick(_STEMS) + " " + letter(), f"{letter()}.{name()}", f"{pick('சமகரவநபதஇஎ')}. {pick(_TAMIL_NAMES)}"])
    if slot == "ORG":
        first, trade, last = pick(_ORG_FIRST) if random.random() < 0.3 else name(), pick(_ORG_TRADE) if random.random() < 0.7 else name(), pick(_ORG_KIND)
        short = "".join(w[0] for w in f"{first} {trade}".split()) + pick(["S Bank", "C Bank", "HF Ltd", "B Ltd", "F Ltd", "DC Corpn"])
        at = int(random.integers(1, len(first) - 1))
        return [f"{first} {trade} {last}", f"{first} {trade} {last}", f"{first[:at] + first[at + 1 :]} {trade} {last}", f"M/s. {first} {trade} {last}", f"The {first} {trade} {last}, {pick(['Main', 'Bazaar', 'Tank Road'])} Branch", f"{trade} {last}, {first}", f"{first} {trade} {last}".upper(), short, f"District Court, {pick(_COURTS)}"][int(random.integers(9))]
    if slot == "PLACE":
        return pick(_PLACES)
    if slot == "ADDRESS":
        number = "0" * int(random.integers(1, 4))
        return [f"No. {number}, {pick(_STREETS)} Street, {pick(_PLACES)} - 000000", f"Door No {number}/{'0' * int(random.integers(1, 3))}, {pick(_STREETS)} Road, {pick(_PLACES)}", f"Plot {number}, {pick(_STREETS)} Avenue, {pick(_PLACES)} Post", f"{number}-B {pick(_STREETS)} St., {pick(_PLACES)} 000 000"][int(random.integers(4))]
    if slot == "PHONE":
        return ["+00-0000000000", "+00 00000 00000", "0000000000", "00000-00000", "00000 00000", "(000) 0000 0000", "000-00000000", "00000000000"][int(random.integers(8))]
    if slot == "IDNUM":
        letters = "".join("ABCDEFGHJKLMNPRSTUVWXYZ"[int(i)] for i in random.integers(23, size=6))
        return ["0000-0000-0000", "0000 0000 0000", "000000000000", f"{letters[:3]}0000000", f"{letters[:5]}0000{letters[5]}", f"{letters[:4]}0000{letters[5]}"][int(random.integers(6))]
    local = [name().lower(), f"{pick(_STEMS).lower()}.{pick(_ENDS)}00", f"{pick(_STEMS).lower()}_{pick(_ENDS)}", name().lower() + "00"][int(random.integers(4))]
    host = pick(["box.example.net", "office.example", "news.example.edu", "home.invalid"])
    return [f"{local}@{host}", f"{local}@{host}".upper(), f"{local} (at) {host}"][min(2, int(random.integers(6)) // 2)]


def labelled_table(copies: int = 6, seed: int = 3) -> list[tuple[list[str], list[int]]]:
    """The labelled rows: word forms and the label of each. A third of the rows are two or
    three running sentences in one text, as they follow each other on a page."""
    random = np.random.default_rng(seed)
    running = [s for s in _SENTENCES if not s.startswith(("0. ", "{NAME}", "{ORG}", "{BARE}"))]
    rows = []
    for _ in range(copies):
        texts = list(_SENTENCES)
        for _ in range(60):
            extras = "".join(_EXTRAS[int(i)] for i in random.integers(len(_EXTRAS), size=int(random.integers(1, 4))))
            texts.append(["0. {NAME}", "0. {NAME} 0. {NAME}", "{BARE}", "0. {ORG} 0. {NAME}"][int(random.integers(4))] + extras + ["", " 0. {NAME}"][int(random.integers(2))])
        texts += [" ".join(running[int(i)] for i in random.integers(len(running), size=int(random.integers(2, 4)))) for _ in range(len(_SENTENCES) // 2)]
        for text in texts:
            chars: list[str] = []
            marks: list[int] = []
            for part in re.split(r"(\{[A-Z]+\})", text):
                slot = part[1:-1] if re.fullmatch(r"\{[A-Z]+\}", part) else ""
                shown = _filled(slot, random) if slot else part
                label = LABELS.index("NAME" if slot == "BARE" else slot) if slot in LABELS or slot == "BARE" else 0
                chars += shown
                marks += [label] * len(shown)
            words, labels = [], []
            for m in _TOKEN.finditer("".join(chars)):
                words.append(m[0].translate(_DIGITS))
                labels.append(max(marks[m.start() : m.end()]))
            rows.append((words, labels))
    return rows


def _org_flags(org: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """For each word whether an organisation's word follows, and whether one precedes, nearby."""
    flags = np.zeros((2, *org.shape), np.float32)
    for k in range(1, NEAR + 1):
        flags[0][..., :-k] = np.maximum(flags[0][..., :-k], org[..., k:] & (segment[..., k:] == segment[..., :-k]))
        flags[1][..., k:] = np.maximum(flags[1][..., k:], org[..., :-k] & (segment[..., :-k] == segment[..., k:]))
    return flags


class Model:
    """The weights: three tables of features, two flags, transitions."""

    def __init__(self, seed: int = 3):
        rows = sorted(labelled_table(seed=seed), key=lambda r: -len(r[0]))  # the longest first
        n, k, longest = len(rows), len(LABELS), max(len(w) for w, _ in rows)
        forms: dict[str, int] = {}
        ids = np.zeros((n, longest + 2), np.int64)
        gold = np.zeros((n, longest), np.int64)
        mask = np.zeros((n, longest), bool)
        org = np.zeros((n, longest), bool)
        segment = np.zeros((n, longest), np.int32)
        table = [features("")]
        for r, (words, labels) in enumerate(rows):
            for t, (word, label) in enumerate(zip(words, labels)):
                if word not in forms:
                    forms[word] = len(table)
                    table.append(features(word))
                ids[r, t + 1] = forms[word]
                gold[r, t], mask[r, t] = label, True
                org[r, t] = word.lower().strip(".,") in ORGANISATION
                segment[r, t] = segment[r, t - 1] + bool(_LIST_NUMBER.match(word)) if t else 0
        # Only features of the labelled table are weighed; the rest stays at nought.
        used = sorted({f for row in table for f in row})
        column = {f: i for i, f in enumerate(used)}
        design = np.zeros((len(table), len(used)), np.float32)
        for i, row in enumerate(table):
            for f in row:
                design[i, column[f]] = 1
        flags = _org_flags(org, segment)
        weights = {"prev": np.zeros((len(used), k), np.float32), "cur": np.zeros((len(used), k), np.float32), "next": np.zeros((len(used), k), np.float32), "flag": np.zeros((2, k), np.float32), "move": np.zeros((k, k), np.float32), "start": np.zeros(k, np.float32)}
        moments = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in weights.items()}
        for step in range(1, ROUNDS + 1):
            scores = (design @ weights["prev"])[ids[:, :-2]] + (design @ weights["cur"])[ids[:, 1:-1]] + (design @ weights["next"])[ids[:, 2:]]
            scores += flags[0][..., None] * weights["flag"][0] + flags[1][..., None] * weights["flag"][1]
            one, two, first = self._expected(scores, mask, weights["move"], weights["start"])
            delta = np.zeros_like(scores)
            np.put_along_axis(delta, gold[..., None], 1.0, 2)
            delta = (delta - one) * mask[..., None]
            pairs = np.zeros((k, k), np.float32)
            both = mask[:, 1:]
            np.add.at(pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
            start = np.bincount(gold[:, 0], minlength=k) - first
            grads = {"move": pairs - two, "start": start.astype(np.float32), "flag": np.stack([(flags[i][..., None] * delta).sum((0, 1)) for i in (0, 1)])}
            for name, off in (("prev", 0), ("cur", 1), ("next", 2)):
                forms_here, parts = ids[:, off : off + longest][mask], delta[mask]
                by_form = np.stack([np.bincount(forms_here, parts[:, label], len(table)) for label in range(k)], 1)
                grads[name] = design.T @ by_form.astype(np.float32)
            for name, grad in grads.items():
                grad = grad / n - (CONTEXT if name in ('prev', 'next') else RIDGE) * weights[name]
                m, v = moments[name]
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                weights[name] += STEP * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.move, self.start, self.flag = weights["move"], weights["start"], weights["flag"]
        self.tables = {name: np.zeros((WIDTH, k), np.float32) for name in ("prev", "cur", "next")}
        for name in self.tables:
            self.tables[name][used] = weights[name]

    @staticmethod
    def _expected(scores: np.ndarray, mask: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of labels and the expected transitions (forward-backward, scaled)."""
        n, longest, k = scores.shape
        heat = np.exp(scores - scores.max(2, keepdims=True))
        moves = np.exp(move)
        alpha = np.zeros_like(heat)
        beta = np.ones_like(heat)
        live = mask.sum(0)  # rows are sorted by length: at step t the first live[t] of them go on
        alpha[:, 0] = heat[:, 0] * np.exp(start)
        alpha[:, 0] /= alpha[:, 0].sum(1, keepdims=True)
        for t in range(1, longest):
            m = live[t]
            a = (alpha[:m, t - 1] @ moves) * heat[:m, t]
            alpha[:m, t] = a / a.sum(1, keepdims=True)
        for t in range(longest - 2, -1, -1):
            m = live[t + 1]
            b = (beta[:m, t + 1] * heat[:m, t + 1]) @ moves.T
            beta[:m, t] = b / b.sum(1, keepdims=True)
        one = alpha * beta
        one /= np.maximum(one.sum(2, keepdims=True), 1e-30)
        two = np.zeros((k, k), np.float32)
        for t in range(1, longest):
            m = live[t]
            joint = alpha[:m, t - 1, :, None] * moves * (heat[:m, t] * beta[:m, t])[:, None, :]
            two += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        return one, two, one[:, 0].sum(0)


@functools.cache
def model() -> Model:
    return Model()


class Tagger:
    """Decodes batches of texts; rows of word forms are kept between batches."""

    def __init__(self, weights: Model, keep: int = 400_000):
        self.model, self.keep = weights, keep
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.org: list[bool] = []
        self.number: list[bool] = []
        self.tables: tuple[np.ndarray, ...] | None = None
        self._add("")

    def _add(self, word: str) -> int:
        found = features(word) if word else features("")
        at = len(self.rows)
        self.ids[word] = at
        self.rows.append(np.stack([self.model.tables[n][found].sum(0) for n in ("prev", "cur", "next")]))
        self.org.append(word.lower().strip(".,") in ORGANISATION)
        self.number.append(bool(_LIST_NUMBER.match(word)))
        return at

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """The best label of each white-space token of each text (Viterbi, all texts at once)."""
        if len(self.ids) > self.keep:
            self._reset()
        ids = self.ids
        coded = []
        for text in texts:
            words = text.translate(_DIGITS).split()
            coded.append([ids[w] if w in ids else self._add(w) for w in words])
        sizes = np.array([len(c) for c in coded], np.int64)
        grid = np.stack(self.rows)
        prev, cur, following = grid[:, 0], grid[:, 1], grid[:, 2]
        org, number = np.array(self.org), np.array(self.number)
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        # Texts of like length together, so that little is padded.
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            limit = max(size + 8, int(size * 1.25))
            to = int(np.searchsorted(sizes[order], limit, side="right"))
            to = min(max(to, at + 1), at + max(1, 200_000 // limit))
            part = order[at:to]
            longest = int(sizes[part].max())
            block = np.zeros((len(part), longest + 2), np.int64)
            for r, i in enumerate(part):
                block[r, 1 : sizes[i] + 1] = coded[i]
            score = cur[block[:, 1:-1]]
            score += prev[block[:, :-2]]
            score += following[block[:, 2:]]
            inner = block[:, 1:-1]
            flags = _org_flags(org[inner], np.cumsum(number[inner], axis=1, dtype=np.int32))
            score += flags[0][..., None] * self.model.flag[0]
            score += flags[1][..., None] * self.model.flag[1]
            best = self._viterbi(score, sizes[part])
            for r, i in enumerate(part):
                out[i] = best[r, : sizes[i]]
            at = to
        return out

    def _viterbi(self, score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        n, longest, k = score.shape
        move = self.model.move
        back = np.zeros((longest, n, k), np.int8)
        now = score[:, 0] + self.model.start
        for t in range(1, longest):
            ways = now[:, :, None] + move
            back[t] = ways.argmax(1)
            after = ways.max(1) + score[:, t]
            now = np.where((sizes > t)[:, None], after, now)
        path = np.zeros((n, longest), np.int8)
        label = now.argmax(1).astype(np.int8)
        rows = np.arange(n)
        for t in range(longest - 1, -1, -1):
            path[:, t] = label
            if t:
                label = np.where(sizes > t, back[t, rows, label], label).astype(np.int8)
        return path


_MAIL = re.compile(r"[^\s@,<>]+@[^\s@,<>]+\.[^\s@,<>]+")
_HOUSE = re.compile(r"(?:\b(?:no|door|plot|flat|house|old|new)\b\.?(?: no\.?)? ?\d|^\D{0,6}\d+(?:[-/]\w+)?,? ).*\b(?:street|st|road|rd|avenue|lane|nagar|salai|cross|main|post|layout|colony)\b", re.I | re.S)
_ID = re.compile(r"(?<!\w)(?:\d{4}[ -]?\d{4}[ -]?\d{4}|[A-Z]{3,5}\d{4,7}[A-Z]?)(?!\w)")


def spans(text: str, labels: np.ndarray) -> list[tuple[int, int, str]]:
    """(from, to, type) of the personal information in one text, after the exact check."""
    out: list[list] = []
    if not labels.any():
        return []
    for (found, label) in zip(_TOKEN.finditer(text), labels):
        if label:
            if out and out[-1][2] == label and out[-1][3]:
                out[-1][1] = found.end()
            else:
                out.append([found.start(), found.end(), label, True])
        elif out:
            out[-1][3] = False
    checked = []
    for a, b, label, _ in out:
        kind, part = LABELS[label], text[a:b]
        digits = sum(c.isdigit() for c in part)
        if kind != "EMAIL":
            mails = [(a + m.start(), a + len(part[: m.end()].rstrip(".,;:<>")), "EMAIL") for m in _MAIL.finditer(part)]
            checked += mails
            if mails and len(part.split()) == len(mails):
                continue
            if mails:  # a mail address inside a longer mark: what stands before it keeps its own
                b = mails[0][0]
                part = text[a:b]
        if kind == "EMAIL" and not ("@" in part or "(at)" in part.lower() or "[at]" in part.lower()):
            continue
        if kind == "PHONE" and not 8 <= digits <= 14:
            continue
        if kind == "IDNUM" and not _ID.search(part):
            continue
        if kind == "ADDRESS" and not _HOUSE.search(part):
            continue
        if kind == "NAME" and sum(c.isalpha() for c in part) < 3:
            continue
        while b > a and text[b - 1] in ".,;:<>":
            b -= 1
        while a < b and text[a] in "<(":
            a += 1
        checked.append((a, b, kind))
    return checked


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    for a, b, kind in reversed(found):
        text = f"{text[:a]}[{kind}]{text[b:]}"
    return text


def register_texts(entries: DataFrame, pages: DataFrame) -> DataFrame:
    page = pages.select(F.lit("ec").alias("src"), F.col("page_id").cast("string").alias("rec_key"), F.col("content").alias("text"))
    entry = entries.select(F.lit("ec_entry").alias("src"), F.concat_ws("#", "doc_id", F.col("seq").cast("string")).alias("rec_key"), F.col("claimants").alias("text"))
    return page.unionByName(entry).filter(~missing(F.col("text")))


def _readable(text: str) -> str:
    return encodings.repair(text)[0] if not text.isascii() else text


def found_types(texts: DataFrame) -> DataFrame:
    """``src, rec_key, pii_type``: each type of personal information a record holds, once.

    NULL, sentinel and empty texts hold none; repeated records count once; texts of any
    length are decoded whole; an empty table gives no row.
    """
    weights = texts.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(weights.value)
        for batch in batches:
            readable = [_readable(t) for t in batch["text"]]
            rows = []
            for src, key, text, labels in zip(batch["src"], batch["rec_key"], readable, tagger.labels(readable)):
                if labels.any():
                    rows += [(src, key, kind) for kind in {k for _, _, k in spans(text, labels)}]
            yield pd.DataFrame(rows, columns=["src", "rec_key", "pii_type"])

    return texts.mapInPandas(run, "src string, rec_key string, pii_type string").distinct()


def redacted(texts: DataFrame) -> DataFrame:
    """``src, rec_key, text`` with typed placeholders; the rest of the text is unchanged, but a text
    decoded wrongly comes out in its repaired form (problem 7), as it is read."""
    weights = texts.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(weights.value)
        for batch in batches:
            readable = [_readable(t) for t in batch["text"]]
            batch["text"] = [masked(t, spans(t, labels)) for t, labels in zip(readable, tagger.labels(readable))]
            yield batch[["src", "rec_key", "text"]]

    return texts.distinct().mapInPandas(run, "src string, rec_key string, text string")
