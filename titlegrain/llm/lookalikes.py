"""Problem 4: one consistent form of texts that look the same.

Method: DuckDB inside Arrow partitions. Each Arrow batch is registered with an
in-process DuckDB and one embedded SELECT maps invisible characters, compatibility
forms, blanks and look-alikes (``regexp_replace``, ``translate``, ``replace``) and
composes the result (``nfc_normalize``). No shuffle; memory is one Arrow batch.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and those Latin letters.
LOOKALIKE = "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρυıɑɡΙІҮүԌԍЬᴏօսցհ"
LATIN = "ABESIJKMHOPCTXYaesijopcyxdqwhlABEZHIKMNOPTYXaovpuiagIIYyGgboough"
# Tamil digits that look like Tamil letters.
TAMIL_DIGITS = {"௧": "க", "௨": "உ", "௪": "ச", "௫": "ரு", "௭": "எ", "௮": "அ", "௰": "ய"}
# Signs that look like a hyphen or a slash of ASCII.
SIGNS, ASCII_SIGNS = "‐‑‒−﹘﹣⁃∕⁄⧸", "-------///"

INVISIBLE = r"[\p{Cf}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{FE00}-\x{FE0F}\x{2028}\x{2029}]"
STRANGE = r"[^\x{0020}-\x{007E}\x{00A1}-\x{00AC}\x{00AE}-\x{017E}\x{0B80}-\x{0BE5}\x{0BF3}-\x{0BFA}\x{2013}\x{2014}\x{2018}-\x{201D}\x{2026}\x{20B9}\s]"
LATIN_CLASS, TAMIL_CLASS = r"A-Za-z\x{00C0}-\x{024F}", r"\x{0B80}-\x{0BFF}"
MIXED = rf"[{LATIN_CLASS}][{TAMIL_CLASS}]|[{TAMIL_CLASS}][{LATIN_CLASS}]|[^\p{{Latin}}\p{{Tamil}}\p{{Common}}\p{{Inherited}}]"


@functools.cache
def compatibility() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility characters made from Unicode's own tables: one-to-one pairs, and the others.

    Superscripts, fractions, enclosed and CJK forms are left out: they differ in sight.
    """
    one, to, many = [], [], []
    for code in [*range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800), *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0x2100, 0x2140), *range(0x2024, 0x2027), 0x017F, 0x01C7, 0x01C8, 0x01C9, 0x01CA, 0x01CB, 0x01CC, 0x0132, 0x0133, 0x2033, 0x203C]:
        sign = chr(code)
        plain = unicodedata.normalize("NFKC", sign)
        if plain == sign or not plain.isascii() or unicodedata.decomposition(sign).startswith("<super>") or sign in "№™℠℡℻":
            continue
        if len(plain) == 1:
            one.append(sign)
            to.append(plain)
        else:
            many.append((sign, plain))
    return "".join(one), "".join(to), tuple(many)


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@functools.cache
def statement(value: str = "value") -> str:
    """The embedded SELECT: the batch's columns, ``canonical``, ``imitates``."""
    one, to, many = compatibility()
    text = f"regexp_replace({value}, {_quote(INVISIBLE)}, '', 'g')"
    text = f"regexp_replace({text}, {_quote(r'[\p{Zs}]')}, ' ', 'g')"
    text = f"translate({text}, {_quote(one + SIGNS + LOOKALIKE)}, {_quote(to + ASCII_SIGNS + LATIN)})"
    for sign, plain in many:
        text = f"replace({text}, {_quote(sign)}, {_quote(plain)})"
    for digit, letter in TAMIL_DIGITS.items():
        for _ in range(2):
            text = f"regexp_replace({text}, {_quote(rf'([\x{{0B82}}-\x{{0BD7}}]){digit}')}, {_quote(chr(92) + '1' + letter)}, 'g')"
            text = f"regexp_replace({text}, {_quote(rf'{digit}([\x{{0B82}}-\x{{0BD7}}])')}, {_quote(letter + chr(92) + '1')}, 'g')"
    mapped = f"CASE WHEN regexp_matches({value}, {_quote(STRANGE)}) THEN nfc_normalize({text}) ELSE nfc_normalize({value}) END"
    return f"""
WITH distinct_values AS (SELECT DISTINCT {value} FROM batch WHERE {value} IS NOT NULL),
mapped AS (SELECT {value}, {mapped} AS form FROM distinct_values)
SELECT batch.*, trim(regexp_replace(form, '\\s+', ' ', 'g')) AS canonical,
  coalesce(form <> batch.{value} OR regexp_matches(form, {_quote(MIXED)}), FALSE) AS imitates
FROM batch LEFT JOIN mapped ON batch.{value} = mapped.{value}
"""


def one_form(values: DataFrame, only_imitating: bool = False) -> DataFrame:
    """Adds ``canonical`` and ``imitates`` to rows with a STRING column ``value``.

    NULL stays NULL and does not imitate; an empty text stays empty; ties and repeated
    rows keep their own row each; other columns pass through unchanged (columns called
    ``canonical`` or ``imitates`` are replaced); very long texts are handled whole.
    ``imitates``: some character only imitates or hides behind the ordinary form, that
    is, the mapped form differs, or a word still mixes scripts.
    """
    values = values.drop("canonical", "imitates")
    sql = statement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for batch in batches:
            con.register("batch", pa.Table.from_batches([batch]))
            query = sql + (" WHERE imitates" if only_imitating else "")
            for out in con.sql(query).to_arrow_table().to_batches():
                yield out
            con.unregister("batch")
        con.close()

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in values.schema)
    return values.mapInArrow(run, f"{kinds}, canonical string, imitates boolean")


def register_values(entries: DataFrame, headers: DataFrame) -> DataFrame:
    """The three fields of the register as ``src, rec_key, field_name, value``."""
    nature = entries.select(F.lit("ec_entry").alias("src"), F.concat_ws("#", "doc_id", F.col("seq").cast("string")).alias("rec_key"), F.lit("nature").alias("field_name"), F.col("nature").alias("value"))
    places = headers.select(F.lit("ec_header").alias("src"), F.col("doc_id").alias("rec_key"), F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("village", "sro")])))
    return nature.unionByName(places)
