"""Areas written in different units, brought to square feet (training-data problem 5).

Method: pure SQL. The text is rewritten into ``number unit`` pairs by regular
expressions, the pairs are extracted with ``regexp_extract_all``, the unit words are
normalised by a join with a fixed alias table, the unit is the first of (unit in the
text, unit shown by another field of the row, default of the field), and factor and
offset are applied in DECIMAL so that half-up rounding is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Square feet of one unit, and the spellings of each unit (lower case,
# without blanks and full stops).
FACTORS = {
    "sqft": "1",
    "ksqft": "1000",
    "lsqft": "100000",
    "sqm": "10.7639",
    "sqyd": "9",
    "cent": "435.6",
    "acre": "43560",
    "are": "1076.39",
    "hectare": "107639",
    "ground": "2400",
}
ALIASES = {
    "sqft": ["sqft", "sqfts", "sft", "sqfeet", "sqfoot", "squareft", "squarefeet", "squarefoot", "சதுரஅடி", "சஅடி"],
    "ksqft": ["thousandsqft", "thousandsft", "thousandsqfeet", "thousandsquarefeet", "ஆயிரம்சதுரஅடி"],
    "lsqft": ["lakhsqft", "lakhsqfeet", "lakhsquarefeet"],
    "sqm": ["sqm", "sqmt", "sqmts", "sqmtr", "sqmtrs", "sqmeter", "sqmeters", "sqmetre", "sqmetres", "squaremeter", "squaremeters", "squaremetre", "squaremetres", "m²", "m2", "சதுரமீட்டர்", "சமீ"],
    "sqyd": ["sqyd", "sqyds", "sqyard", "sqyards", "squareyard", "squareyards", "சதுரகஜம்", "சதுரகெஜம்"],
    "cent": ["cent", "cents", "ct", "cts", "சென்ட்", "செண்ட்", "சென்ட்டு"],
    "acre": ["acre", "acres", "ac", "acs", "ஏக்கர்"],
    "are": ["are", "ares", "ஏர்ஸ்", "ஏர்", "ஆர்ஸ்"],
    "hectare": ["hectare", "hectares", "hect", "ha", "ஹெக்டேர்", "ஹெக்டர்"],
    "ground": ["ground", "grounds", "grd", "grds", "gr", "கிரவுண்ட்", "கிரவுண்டு"],
}

_NUM = "([0-9]+(?:[.][0-9]+)?)"
_UNIT = (
    "((?:(?:thousand|lakh|ஆயிரம்) *)?(?:sq(?:uare)?[. ]*(?:feet|foot|fts?|met(?:er|re)s?|mtrs?|mts?|m|yards?|yds?)"
    "|sft|m²|m2|சதுர *(?:அடி|மீட்டர்|கஜம்|கெஜம்)|hectares?|hect|ha|acres?|acs?|ares?|cents?|cts?|grounds?|grds?|gr"
    "|சென்ட்டு|சென்ட்|செண்ட்|ஏக்கர்|ஏர்ஸ்|ஏர்|ஆர்ஸ்|ஹெக்டேர்|ஹெக்டர்|கிரவுண்டு|கிரவுண்ட்))"
)
_HA = "(?:hect-ares?|hectares?|hect|ha|ஹெக்டேர்|ஹெக்டர்)?"
#: The rewriting steps, in order: pattern, replacement. Both engines' regular expressions read them alike.
REWRITES = [
    ("[(]'000", " thousand "),
    ("[()]", " "),
    ("([0-9]) *½", "${1}.5"),
    ("([0-9]) *¼", "${1}.25"),
    ("([0-9]) *¾", "${1}.75"),
    ("½|half (?:an |of an )?", "0.5 "),
    ("¾|three[- ]quarters? (?:of )?(?:an? )?", "0.75 "),
    ("¼|quarter (?:of )?(?:an )?", "0.25 "),
    ("([0-9]),([0-9])", "${1}${2}"),
    ("([0-9]),([0-9])", "${1}${2}"),
    (f"([0-9]+)[.]([0-9]{{1,2}})[.]([0-9]{{1,2}}) *{_HA}", "${1} ha ${2}.${3} ares "),
    ("([0-9]+) *- *([0-9]+(?:[.][0-9]+)?) *hect-ares?", "${1} ha ${2} ares "),
    (f"(^|[a-zஅ-ஹா-்:-] ){_UNIT}[. ]+{_NUM}", "${1}${3} ${2} "),
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def alias_rows() -> list[tuple[str, str, str]]:
    return [(alias, unit, FACTORS[unit]) for unit, names in ALIASES.items() for alias in names]


def area_sql(source_sql: str, dialect: str = "spark") -> str:
    """The conversion as one SELECT in Spark's or DuckDB's SQL.

    ``source_sql`` yields ``src, rec_key, field_name, raw, usual, hint``: ``usual`` is
    ``hectare`` or ``sqft``, ``hint`` another field of the same row (its text) or NULL.
    """
    duck = dialect == "duckdb"

    def replace(text: str, pattern: str, to: str) -> str:
        if duck:
            to = to.replace("${", "\\").replace("}", "")
            return f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(to)}, 'g')"
        to = to.replace("${", "$").replace("}", "")
        return f"regexp_replace({text}, r\"{pattern}\", \"{to}\")"

    def lit(pattern: str) -> str:
        return _quoted(pattern) if duck else f'r"{pattern}"'

    def clean(col: str) -> str:
        text = f"lower(trim({col}))"
        for pattern, to in REWRITES:
            text = replace(text, pattern, to)
        return f"trim({text})"

    pair = f"{_NUM} *{_UNIT}(?:[^a-z]|$)"
    at = (lambda a, i: f"{a}[{i + 1}]") if duck else (lambda a, i: f"try_element_at({a}, {i + 1})")
    number = lambda x: f"CAST({x} AS DECIMAL(18,4))"
    alias = lambda x: replace(x, "[. ]", "")
    values = ", ".join(f"({_quoted(a)}, {_quoted(u)}, CAST({f} AS DECIMAL(12,4)))" for a, u, f in alias_rows())
    fit = lambda f: f"abs(CAST(bare AS DOUBLE) * {f} - hint_sqft) <= 0.03 * hint_sqft + 0.6 * {f}"
    tried = "".join(f" WHEN {fit(FACTORS[u])} THEN '{u}'" for u in ("sqft", "sqm", "sqyd", "cent", "are", "ground", "acre", "hectare"))
    missing = "lower(trim({0})) IN ('', '-', '*', 'not detected', 'none', 'null')"
    cut = "CASE WHEN {0} IS NULL OR " + missing + " THEN NULL ELSE {0} END"
    bare = f"regexp_extract(t, {lit('^([0-9]+(?:[.][0-9]+)?)$')}, 1)"
    return f"""
WITH aliases(alias, unit, factor) AS (SELECT * FROM (VALUES {values}) AS v(alias, unit, factor)),
given AS ({source_sql}),
kept AS (SELECT src, rec_key, field_name, usual, {cut.format('raw')} AS raw, {cut.format('hint')} AS hint FROM given),
text AS (
  SELECT src, rec_key, field_name, usual,
    CASE WHEN usual = 'hectare' THEN {replace(clean('raw'), '^([0-9]+) *- *([0-9]+(?:[.][0-9]+)?)$', '${1} ha ${2} ares')} ELSE {clean('raw')} END AS t,
    {replace(clean('hint'), '^([0-9]+) *- *([0-9]+(?:[.][0-9]+)?)$', '${1} ha ${2} ares')} AS h
  FROM kept WHERE raw IS NOT NULL),
pairs AS (
  SELECT src, rec_key, field_name, usual, t, h,
    regexp_extract_all(t, {lit(pair)}, 1) AS tn, regexp_extract_all(t, {lit(pair)}, 2) AS tu,
    regexp_extract_all(h, {lit(pair)}, 1) AS hn, regexp_extract_all(h, {lit(pair)}, 2) AS hu
  FROM text),
parts AS (
  SELECT src, rec_key, field_name, usual, nullif({bare}, '') AS bare,
    {at('tn', 0)} AS n1, {alias(at('tu', 0))} AS u1, {at('tn', 1)} AS n2, {alias(at('tu', 1))} AS u2,
    {at('hn', 0)} AS m1, {alias(at('hu', 0))} AS v1, {at('hn', 1)} AS m2, {alias(at('hu', 1))} AS v2
  FROM pairs),
joined AS (
  SELECT p.src, p.rec_key, p.field_name, p.usual, p.bare, a1.unit AS unit1, a2.unit AS unit2,
    {number('p.n1')} * a1.factor + coalesce({number('p.n2')} * a2.factor, 0) AS text_sqft,
    CAST({number('p.m1')} * b1.factor + coalesce({number('p.m2')} * b2.factor, 0) AS DOUBLE) AS hint_sqft
  FROM parts p LEFT JOIN aliases a1 ON p.u1 = a1.alias LEFT JOIN aliases a2 ON p.u2 = a2.alias
    LEFT JOIN aliases b1 ON p.v1 = b1.alias LEFT JOIN aliases b2 ON p.v2 = b2.alias),
united AS (
  SELECT src, rec_key, field_name, usual, text_sqft, unit2, bare,
    coalesce(unit1, CASE WHEN bare IS NULL THEN NULL WHEN hint_sqft IS NULL THEN 'sqft'{tried} ELSE 'sqft' END) AS unit1
  FROM joined)
SELECT u.src, u.rec_key, u.field_name, u.usual,
  CASE WHEN u.unit2 IS NULL THEN u.unit1 ELSE concat(u.unit1, '+', u.unit2) END AS unit,
  CASE WHEN u.usual = 'hectare' THEN u.unit1 = 'hectare' AND coalesce(u.unit2, 'are') = 'are'
       ELSE u.unit1 = 'sqft' AND u.unit2 IS NULL END AS is_usual,
  CAST(floor(coalesce(u.text_sqft, {number('u.bare')} * f.factor) + CAST(0.5 AS DECIMAL(2,1))) AS BIGINT) AS sqft
FROM united u LEFT JOIN (SELECT DISTINCT unit, factor FROM aliases) f ON u.unit1 = f.unit
WHERE u.unit1 IS NOT NULL
"""


#: The three fields of this project's tables and what another field of the row shows.
REGISTER_SOURCE = """
SELECT 'ec_header' AS src, CAST(doc_id AS STRING) AS rec_key, 'requested_extent' AS field_name,
  requested_extent AS raw, 'sqft' AS usual, CAST(NULL AS STRING) AS hint FROM {header}
UNION ALL
SELECT 'real_pdf_result', CAST(row_id AS STRING), 'extent_ha', extent_ha, 'hectare', coalesce({sq_meters}, {extent_ares}, {sq_feet}) FROM {patta}
UNION ALL
SELECT 'real_pdf_result', CAST(row_id AS STRING), 'sq_feet', sq_feet, 'sqft', coalesce({sq_meters}, {extent_ares}, {extent_ha}) FROM {patta}
"""


def register_source(header: str, patta: str) -> str:
    real = {c: f"CASE WHEN lower(trim({c})) IN ('', '-', '*', 'not detected', 'none', 'null') THEN NULL ELSE {c} END" for c in ("sq_meters", "extent_ares", "sq_feet", "extent_ha")}
    return REGISTER_SOURCE.format(header=header, patta=patta, **real)


def areas_in_sqft(spark: SparkSession, header: DataFrame, patta: DataFrame) -> DataFrame:
    """Every readable area of the register in square feet, one row per record and field.

    Columns ``src, rec_key, field_name, usual, unit, is_usual, sqft``. NULL, sentinel,
    empty and unreadable texts give no row; a repeated delivery gives one row; a number
    without unit is square feet unless another field of its row shows another unit.
    Only expressions and joins with the fixed alias table (about 60 rows): no shuffle
    but the final DISTINCT. Other columns of the inputs are never read.
    """
    text = area_sql(register_source("@header", "@patta")).replace("{", "{{").replace("}", "}}")
    text = text.replace("@header", "{header}").replace("@patta", "{patta}")
    return spark.sql(f"SELECT DISTINCT * FROM ({text})", header=header, patta=patta)
