"""Tamil and English: order of vowel signs, readings both ways, glossaries, roles, kinship (X12,
X14 to X24), as Column functions; readings are by batches, over distinct values."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and vowel signs with their Latin readings.
CONSONANTS = dict(zip("கஙசஞடணதநபமயரலவழளறனஜஷஸஹ", "k ng ch nj t n th n p m y r l v zh l r n j sh s h".split()))
VOWELS = dict(zip("அஆஇஈஉஊஎஏஐஒஓஔ", "a aa i ee u oo e e ai o o au".split()))
SIGNS = dict(zip("ாிீுூெேைொோௌ", "aa i ee u oo e e ai o o au".split()))
VIRAMA = "்"


def latin(text: str) -> str:
    """A plain Latin reading, capitalised by word; other letters stay as they are."""
    out: list[str] = []
    pending = False  # a consonant that still needs its vowel
    for ch in text:
        if ch in CONSONANTS:
            if pending:
                out.append("a")
            out.append(CONSONANTS[ch])
            pending = True
        elif ch in SIGNS and pending:
            out.append(SIGNS[ch])
            pending = False
        elif ch == VIRAMA and pending:
            pending = False
        else:
            if pending:
                out.append("a")
            pending = False
            out.append(VOWELS.get(ch, ch))
    if pending:
        out.append("a")
    return "".join(w[:1].upper() + w[1:] if w[:1].isascii() else w for w in _words("".join(out)))


def _words(text: str) -> list[str]:
    parts: list[str] = []
    for ch in text:
        if parts and not ch.isspace() and not parts[-1][-1:].isspace():
            parts[-1] += ch
        else:
            parts.append(ch)
    return parts


def transliterate(col: Column) -> Column:
    """The Latin reading of a text column, by batches; apply it to distinct values and join back."""

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else latin(t))

    return read(col)


def with_reading(rows: DataFrame, col: str, name: str, way: str = "latin") -> DataFrame:
    """A column of readings; every distinct value is read once and joined back."""
    read = transliterate if way == "latin" else to_tamil
    known = rows.select(col).filter(F.col(col).isNotNull()).distinct().withColumn(name, read(F.col(col)))
    return rows.join(known, col, "left")


def logical_order(col: Column) -> Column:
    """Vowel signs in logical order: the two halves of ``o`` and ``oo`` around a consonant
    become one sign behind it, a sign stored before its consonant goes behind it, and one behind a
    virama goes before that. A sign behind a consonant counts as in order already."""
    text = F.regexp_replace(col, "(?<![க-ஹ])ெ([க-ஹ])ா", "$1ொ")
    text = F.regexp_replace(text, "(?<![க-ஹ])ே([க-ஹ])ா", "$1ோ")
    text = F.regexp_replace(text, "(?<![க-ஹ])([ெேை])([க-ஹ])", "$2$1")
    return F.regexp_replace(text, "([க-ஹ])்([ா-ௌ])", "$1$2்")


_MARKS = "ஂா-்ௗ"


def without_stray_marks(col: Column) -> Column:
    """In a text of both scripts, Tamil marks beside Latin letters go, and Tamil letters that
    touch Latin ones get a blank; a text of one script stays as it is."""
    text = F.regexp_replace(col, f"(?<=[A-Za-z0-9])[{_MARKS}]+", "")
    text = F.regexp_replace(text, f"[{_MARKS}]+(?=[A-Za-z0-9])", "")
    text = F.regexp_replace(text, r"(?<=[A-Za-z0-9])([\x{0B80}-\x{0BFF}]+)", " $1")
    text = F.regexp_replace(text, r"([\x{0B80}-\x{0BFF}]+)(?=[A-Za-z0-9])", "$1 ")
    return F.when(col.rlike("[A-Za-z]") & col.rlike(r"[\x{0B80}-\x{0BFF}]"), F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(col)


def clean_initials(col: Column) -> Column:
    """Runs of points become one, points at the beginning go, an initial behind a name is
    parted from it, and a name behind an initial gets its blank; initials are capitals."""
    text = F.regexp_replace(col, r"\.{2,}", ".")
    text = F.regexp_replace(text, r"^\s*[.,:;]+\s*", "")
    text = F.regexp_replace(text, r"([A-Za-z]{2,})\.([A-Za-z])(?:\.|$|\s)", "$1 $2. ")
    text = F.regexp_replace(text, r"\b((?:[A-Za-z]\.)+)(?=[A-Za-z]{2,}|[\x{0B80}-\x{0BFF}])", "$1 ")
    # Only words of single letters with points are initials.
    words = F.transform(F.split(text, " "), lambda w: F.when(w.rlike(r"^(?:[A-Za-z]\.)+$"), F.upper(w)).otherwise(w))
    return F.trim(F.regexp_replace(F.array_join(words, " "), " +", " "))


# Loan-words of firms, and words of deeds, with their English forms.
FIRM_WORDS = {"பிரைவேட் லிமிடெட்": "Private Limited", "பிரைவேட்": "Private", "லிமிடெட்": "Limited", "பேங்க்": "Bank", "பாங்க்": "Bank", "வங்கி": "Bank", "மேனேஜ்மெண்ட்": "Management", "சர்வீஸ்": "Services", "பிஸ்னஸ்": "Business", "பைனான்ஸ்": "Finance", "எஸ்டேட்ஸ்": "Estates", "எஸ்டேட்": "Estate", "பவுண்டேஷன்ஸ்": "Foundations", "பவுண்டேஷன்": "Foundation", "பில்டர்ஸ்": "Builders", "டிரஸ்ட்": "Trust", "கம்பெனி": "Company", "ஹவுசிங்": "Housing"}
DEED_WORDS = {"கிரையப் பத்திரம்": "Sale deed", "கிரையம்": "Sale", "அடமானப் பத்திரம்": "Mortgage deed", "அடமானம்": "Mortgage", "செட்டில்மெண்ட்": "Settlement", "செட்டில்மென்ட்": "Settlement", "தானப் பத்திரம்": "Gift deed", "தானம்": "Gift", "பாகப்பிரிவினை": "Partition", "விடுதலைப் பத்திரம்": "Release deed", "விடுதலை": "Release", "ரசீது": "Receipt", "குத்தகை": "Lease", "பொது அதிகாரப் பத்திரம்": "General power of attorney", "பிழைதிருத்தல்": "Rectification", "உயில்": "Will", "நீதிமன்ற ஆணை": "Court order", "பத்திரம்": "deed"}
# Words of a role with its English and Tamil form (X23), and of kinship.
ROLES = {"principal": ("Principal", "பிரின்சிபல்"), "பிரின்சிபல்": ("Principal", "பிரின்சிபல்"), "பிரின்ஸ்பால்": ("Principal", "பிரின்சிபல்"), "முதல்வர்": ("Principal", "பிரின்சிபல்"), "agent": ("Agent", "ஏஜண்ட்"), "ஏஜண்ட்": ("Agent", "ஏஜண்ட்"), "ஏஜெண்ட்": ("Agent", "ஏஜண்ட்"), "முகவர்": ("Agent", "முகவர்"), "vendor": ("Vendor", "விற்பவர்"), "விற்பவர்": ("Vendor", "விற்பவர்"), "purchaser": ("Purchaser", "வாங்குபவர்"), "வாங்குபவர்": ("Purchaser", "வாங்குபவர்"), "witness": ("Witness", "சாட்சி"), "சாட்சி": ("Witness", "சாட்சி"), "gpa holder": ("GPA Holder", "ஜிபிஏ வைத்தவர்"), "power of attorney": ("GPA Holder", "ஜிபிஏ வைத்தவர்"), "mortgagor": ("Mortgagor", "அடமானம் வைத்தவர்"), "mortgagee": ("Mortgagee", "அடமானம் பெற்றவர்"), "legal heir": ("Legal Heir", "சட்டப்பூர்வ வாரிசு")}
KINSHIP = [("மகன்", "S/o"), ("மகள்", "D/o"), ("மனைவி", "W/o"), ("கணவர்", "H/o"), ("son of", "S/o"), ("daughter of", "D/o"), ("wife of", "W/o"), ("husband of", "H/o"), ("s/o", "S/o"), ("d/o", "D/o"), ("w/o", "W/o"), ("h/o", "H/o")]


def glossary(col: Column, words: dict[str, str]) -> Column:
    """Words replaced by their forms, the longest first; the order is fixed when the
    expression is built."""
    for word in sorted(words, key=lambda w: (-len(w), w)):
        col = F.replace(col, F.lit(word), F.lit(words[word]))
    return col


def without_roles(col: Column) -> Column:
    """``name, role, role_tamil``: roles in brackets at the end are taken off, one behind the
    other; the first of them stands. A bracket that is no role belongs to the name."""
    words = "|".join(sorted(map(re.escape, ROLES), key=len, reverse=True)).replace("\\ ", " ")
    tail = rf"(?i)(?:\s*\(\s*(?:{words})(?:\s*/\s*[^()]*)?\s*\))+\s*$"
    open_ = F.regexp_replace(col, r"(?i)(?<![(\s/])\s+(principal|agent|vendor|purchaser)\)", " ($1)")
    found = F.lower(F.regexp_extract(open_, rf"(?i)\(\s*({words})(?:\s*/\s*[^()]*)?\s*\)(?:\s*\((?:[^()]*)\))*\s*$", 1))
    english = F.create_map(*[F.lit(x) for k, (e, _) in ROLES.items() for x in (k, e)])
    tamil = F.create_map(*[F.lit(x) for k, (_, t) in ROLES.items() for x in (k, t)])
    key = F.when(open_.rlike(tail), F.nullif(found, F.lit("")))
    return F.struct(F.trim(F.regexp_replace(open_, tail, "")).alias("name"), F.try_element_at(english, key).alias("role"), F.try_element_at(tamil, key).alias("role_tamil"))


def kinship(col: Column) -> Column:
    """``name, relation, parent``: an owner with parentage in English or Tamil words, numbering
    taken off. In Tamil the parent stands before the word (``B மகன் A``) or behind it, as the
    forms have it here: name, word, parent. No word gives the name alone."""
    text = F.trim(F.regexp_replace(col, r"^\s*[0-9]+[.)]\s*", ""))
    words = "|".join(w for w, _ in KINSHIP)
    pattern = rf"(?i)^(.+?)[\s,]+({words})\.?\s+(.+)$"
    table = F.create_map(*[F.lit(x) for pair in KINSHIP for x in pair])
    word = F.nullif(F.lower(F.regexp_extract(text, pattern, 2)), F.lit(""))
    return F.struct(F.when(word.isNotNull(), F.trim(F.regexp_extract(text, pattern, 1))).otherwise(text).alias("name"), F.try_element_at(table, word).alias("relation"), F.when(word.isNotNull(), F.trim(F.regexp_extract(text, pattern, 3))).alias("parent"))


def bilingual(english: Column, tamil: Column) -> Column:
    """``English (Tamil)``; one of them alone where the other is missing or equal."""
    return F.when(english.isNull() | (english == tamil), tamil).when(tamil.isNull(), english).otherwise(F.concat(english, F.lit(" ("), tamil, F.lit(")")))


_TO_TAMIL = [("ndr", "ன்ற்"), ("nth", "ந்த்"), ("ng", "ங்"), ("nj", "ஞ்"), ("th", "த்"), ("dh", "த்"), ("ch", "ச்"), ("sh", "ஷ்"), ("zh", "ழ்"), ("ll", "ல்ல்"), ("k", "க்"), ("g", "க்"), ("s", "ச்"), ("c", "க்"), ("j", "ஜ்"), ("t", "ட்"), ("d", "ட்"), ("n", "ன்"), ("p", "ப்"), ("b", "ப்"), ("m", "ம்"), ("y", "ய்"), ("r", "ர்"), ("l", "ல்"), ("v", "வ்"), ("w", "வ்"), ("h", "ஹ்"), ("f", "ப்"), ("x", "க்ஸ்"), ("q", "க்"), ("z", "ஸ்")]
_LATIN_VOWELS = [("aa", "ஆ", "ா"), ("ai", "ஐ", "ை"), ("au", "ஔ", "ௌ"), ("ee", "ஈ", "ீ"), ("ii", "ஈ", "ீ"), ("oo", "ஊ", "ூ"), ("uu", "ஊ", "ூ"), ("a", "அ", ""), ("e", "எ", "ெ"), ("i", "இ", "ி"), ("o", "ஒ", "ொ"), ("u", "உ", "ு")]


def tamil(text: str) -> str:
    """A plain Tamil spelling of Latin words; what is no Latin letter stays as it is. A word
    of one letter or with a point (an initial) stays."""

    def word(m: re.Match) -> str:
        low, out, i = m[0].lower(), "", 0
        if len(low) < 2:
            return m[0]
        while i < len(low):
            vowel = next(((n, full, sign) for n, full, sign in _LATIN_VOWELS if low.startswith(n, i)), None)
            if vowel:
                n, full, sign = vowel
                out = out[:-1] + sign if out.endswith(VIRAMA) else out + full
                i += len(n)
                continue
            n, shown = next(((n, shown) for n, shown in _TO_TAMIL if low.startswith(n, i)), (low[i], low[i]))
            out += shown
            i += len(n)
        return out

    return re.sub(r"(?<![A-Za-z])[A-Za-z]+(?![A-Za-z.])|[A-Za-z]{2,}", word, text)


def to_tamil(col: Column) -> Column:
    """The Tamil spelling of a text column, by batches."""

    @F.pandas_udf("string")
    def spell(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tamil(t))

    return spell(col)


def word_translations(rows: DataFrame, key: str, col: str, dictionary: DataFrame, reading: bool = False) -> DataFrame:
    """``key, translated``: each word by a dictionary (``word, translation``), the rest as it is
    or, with ``reading``, in its Latin reading; every distinct word is looked up once."""
    words = rows.filter(F.col(col).isNotNull()).select(key, F.posexplode(F.split(F.trim(F.regexp_replace(col, r"\s+", " ")), " ")).alias("pos", "word"))
    listed = dictionary.groupBy(F.lower("word").alias("low")).agg(F.min("translation").alias("translation"))
    known = words.select("word").distinct().withColumn("low", F.lower("word")).join(listed, "low", "left").withColumn("shown", F.coalesce("translation", transliterate(F.col("word")) if reading else F.col("word")))
    met = words.join(known.select("word", "shown"), "word")
    return met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), " ").alias("translated"))


def party_records(parties: DataFrame) -> DataFrame:
    """Numbered parties (``doc_id, seq, side, ordinal, party``) as bilingual records: roles
    taken off, initials cleaned, firms' words by the glossary, Tamil names read in Latin and Latin
    ones spelt in Tamil, each distinct name once."""
    told = parties.withColumn("r", without_roles(F.col("party"))).withColumn("name", clean_initials(logical_order(F.col("r.name")))).filter("name <> '' AND NOT name RLIKE '^[0-9]{1,4}$'")
    names = told.select("name").distinct()
    has = F.col("name").rlike(r"[\x{0B80}-\x{0BFF}]")
    english = F.when(has, without_stray_marks(transliterate(glossary(F.col("name"), FIRM_WORDS)))).otherwise(F.col("name"))
    known = names.withColumn("english", english).withColumn("tamil", F.when(has, F.col("name")).otherwise(to_tamil(F.col("name"))))
    met = told.join(known, "name")
    return met.select("doc_id", "seq", "side", "ordinal", "english", "tamil", F.col("r.role").alias("role"), F.col("r.role_tamil").alias("role_tamil"), bilingual(F.col("english"), F.col("tamil")).alias("shown"))
