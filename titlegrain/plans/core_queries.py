"""Queries of the core library over the driver's tables, with their SQL (DuckDB).

``QUERIES`` maps a name to a function of (session, folder); ``SQL`` gives, where SQL can
express the operator over whole tables, the statement that must return the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.functions import tamil
from titlegrain.operators import crosscheck, display, documents, fields, geometry, lookup, parse, predicates, register, units
from titlegrain.nulls import SENTINELS, nullify
from titlegrain.session import table
from titlegrain.sources import readers, sinks
from titlegrain.streaming import open_loans

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL ---------------------------------------------------------------------
_SENTINELS = ", ".join(f"'{s}'" for s in SENTINELS)


def _nn(c: str) -> str:
    return f"(CASE WHEN lower(trim({c})) IN ({_SENTINELS}) THEN NULL ELSE {c} END)"


def _has(c: str, words: list[str]) -> str:
    return f"coalesce(regexp_matches(lower({c}), '{'|'.join(words)}'), FALSE)"


# The words of the kinds, written out for the SQL apart from the operators' own lists.
_SALE = ["sale", "conveyance", "settlement", "gift", "partition", "cession", "கிரைய", "கிைரய", "விற்பனை", "விற்பைன", "செட்டில்மெ", "தான", "பாகப்பிரிவினை", "உரிமை மாற்றம்"]
_WORDS = {
    "register": {
        "mortgage": ["mortgage", "deposit of title", "modt", "hypothèque", "அடமான", "அடைமான", "உரிமை வைப்பு", "ஒப்படைப்பு", "ஒப்பைடப்பு", "ஈடு", "கடன்"],
        "discharge": ["receipt", "discharge", "ரசீது", "மீட்சி"],
        "conveyance": _SALE,
        "court": ["court", "attach", "decree", "injunction", "நீதிமன்ற"],
        "rectification": ["rectification", "திருத்தம்", "பிழைதிருத்தல்"],
        "lease": ["lease", "குத்தகை"],
        "family": ["settlement", "partition", "release", "gift", "செட்டில்மெ", "பாகப்பிரிவினை", "விடுதலை"],
        "attorney": ["power of attorney", "பொது அதிகார"],
    }
}
_WORDS["filter"] = _WORDS["register"] | {
    "mortgage": ["mortgage", "modt", "deposit of title", "charge", "hypothecation", "hypothèque", "அடமான"],
    "discharge": ["receipt", "discharge", "release", "ரசீது", "விடுதலை"],
    "conveyance": ["conveyance", "sale", "settlement", "gift", "partition", "release", "cession", "கிரைய", "செட்டில்மென்ட்", "பாகப்பிரிவினை", "தான"],
    "court": ["court", "attachment", "injunction", "decree", "lis pendens", "o[.]s[.]", "e[.]p[.]", "c[.]s[.]", "w[.]p[.]", "suit", "stay", "order", "நீதிமன்ற", "பற்று", "தடை", "வழக்கு"],
}
_WORDS["owners"] = _WORDS["register"] | {"mortgage": ["mortgage", "அடைமானம்", "ஈடு", "ஒப்படைப்பு", "ஒப்பைடப்பு", "உரிமை ஆவண", "modt", "deposit of title"], "discharge": ["receipt", "இரசீது", "ரசீது", "discharge", "release", "விடுதலை"]}
_WORDS["screen"] = _WORDS["register"] | {"mortgage": ["mortgage", "modt", "deposit of title", "ஈடு", "அடமான", "அடைமானம்", "உரிமை வைப்பு", "ஒப்படைப்பு", "ஒப்பைடப்பு", "உரிமை ஆவண", "கடன் திரும்ப", "பணயம்"]}


def _kind(kind: str, c: str = "nature", rules: str = "register") -> str:
    words = _WORDS[rules]
    found = _has(c, words[kind])
    if kind == "mortgage":
        return f"({found} AND NOT {_has(c, words['discharge'])})"
    if kind == "lease":
        return f"({found} AND NOT {_has(c, ['release'])})"
    return found


def _rx(c: str, pattern: str, to: str) -> str:
    return f"regexp_replace({c}, '{pattern}', '{to}', 'g')"


def _collapse(c: str) -> str:
    return f"trim({_rx(c, r'\s+', ' ')})"


def _items(c: str) -> str:
    split = f"regexp_split_to_array(trim({c}), '(?:^|\\s+)[0-9]{{1,3}}[.]\\s+')"
    return f"list_transform(list_filter({split}, lambda p: trim(p) <> ''), lambda p: {_collapse('p')})"


def _party_key(c: str) -> str:
    text = _rx(f"lower({c})", r"[^a-z0-9\x{0B80}-\x{0BFF}]", "")
    for pattern, to in (("aa", "a"), ("ee", "i"), ("oo", "u"), ("th", "t"), ("dh", "d"), ("zh", "l")):
        text = _rx(text, pattern, to)
    return text


def _name(c: str) -> str:
    return _collapse(_rx(_rx(f"lower({c})", S.NAME_WORDS, ""), r"[^a-z0-9\x{0B80}-\x{0BFF}\s]", ""))


_REG = f"""reg AS (SELECT DISTINCT doc_id, seq, coalesce(sr, seq) AS sr, {_nn('doc_no_year')} AS doc_no, execution_date, presentation_date, registration_date,
  {', '.join(f'{_nn(c)} AS {c}' for c in ('nature', 'executants', 'claimants', 'remarks', 'vol_page', 'consideration', 'market_value'))},
  (CASE WHEN trim(pr_numbers) = '0' THEN NULL ELSE {_nn('pr_numbers')} END) AS pr_numbers, consideration_amt, market_value_amt, page_index,
  {', '.join(f'{_nn(f"schedules[1].{c}")} AS {c}' for c in ('survey_no', 'extent', 'village_street', 'plot_no', 'flat_no', 'door_no', 'boundaries'))},
  array_to_string(list_transform(coalesce(schedules, []), lambda s: concat_ws(' ', s.survey_no, s.extent, s.plot_no, s.boundaries)), ' ') AS schedule_text FROM ec_entry)"""

_ENTITY = "CASE WHEN regexp_matches(lower(party), 'bank|finance|fund|வங்கி') THEN 'bank' WHEN regexp_matches(lower(party), 'court') THEN 'court' WHEN regexp_matches(lower(party), 'school|college|trust|academy|foundation|சங்கம்') THEN 'trust' WHEN regexp_matches(lower(party), 'ltd|limited|llp|corporation|corpn|builders|நிறுவனம்') THEN 'company' WHEN regexp_matches(lower(party), 'authority|board|government') THEN 'government' ELSE 'individual' END"
_PARTIES = f"""{_REG}, sides AS (
  SELECT doc_id, seq, survey_no, doc_no, nature, 'executant' AS side, {_items('executants')} AS items FROM reg
  UNION ALL SELECT doc_id, seq, survey_no, doc_no, nature, 'claimant', {_items('claimants')} FROM reg),
 numbered AS (SELECT doc_id, seq, survey_no, doc_no, nature, side, unnest(items) AS party, unnest(range(1, len(items) + 1)) AS ordinal FROM sides WHERE len(items) > 0),
 parties AS (SELECT doc_id, seq, survey_no, doc_no, nature, side, CAST(ordinal AS INTEGER) AS ordinal, party, {_ENTITY} AS entity, {_party_key('party')} AS party_key FROM numbered)"""
_PROFILES = f"""{_PARTIES}, profiles AS (
  SELECT doc_id, party_key, arg_min(party, row(seq, side, ordinal)) AS party, count(DISTINCT seq) AS entries, count(DISTINCT survey_no) AS units,
    count(*) FILTER (side = 'executant' AND {_kind('mortgage')}) AS loans, count(*) FILTER (side <> 'executant' AND {_kind('conveyance')}) AS bought,
    count(*) FILTER (side = 'executant' AND {_kind('conveyance')}) AS sold, max(seq) AS last_seq, min(entity) AS entity FROM parties WHERE party_key <> '' GROUP BY doc_id, party_key),
 groups AS (SELECT doc_id, party_key, party, CASE WHEN bought > sold THEN 'current' WHEN bought > 0 OR sold > 0 THEN 'former' WHEN entity IN ('bank', 'government') THEN 'institution' ELSE 'other' END AS owner_group, entity IN ('bank', 'government') AS institution FROM profiles)"""
_REFS = r"list_distinct(regexp_extract_all(concat_ws(' ', pr_numbers, remarks), '([0-9]{1,6}/[0-9]{2,4})\b', 1))"
_KEYS = "list_distinct([doc_no, regexp_replace(doc_no, '/[0-9]{2}([0-9]{2})$', '/\\1')])"


def _first_party(c: str) -> str:
    return _party_key(f"{_items(c)}[1]")


def _word_in(a: str, b: str) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(coalesce({a}, '')), '\\s+'), lambda w: length(w) > 3 AND contains(lower(coalesce({b}, '')), w))) > 0"


_LOANS = f"""{_REG}, m AS (SELECT *, {_KEYS} AS keys FROM reg WHERE {_kind('mortgage')}), d AS (SELECT *, {_REFS} AS refs FROM reg WHERE {_kind('discharge')}),
 loans AS (SELECT m.doc_id, m.seq, any_value(m.doc_no) AS doc_no, min(d.seq) AS discharge_seq FROM m LEFT JOIN d ON d.doc_id = m.doc_id AND (list_has_any(d.refs, m.keys)
  OR (({_word_in('m.claimants', 'd.executants')} OR (contains(lower(m.claimants), 'bank') AND contains(lower(d.executants), 'bank'))) AND {_word_in('m.executants', 'd.claimants')})) GROUP BY m.doc_id, m.seq)"""
_MORTGAGORS = f"""{_PARTIES}, ow AS (SELECT doc_id, seq, doc_no FROM reg WHERE {_kind('mortgage', rules='owners')}),
 db AS (SELECT DISTINCT doc_id, seq, party_key FROM parties WHERE side = 'executant' AND party_key <> ''), od AS (SELECT ow.*, db.party_key FROM ow LEFT JOIN db USING (doc_id, seq)),
 pd AS (SELECT DISTINCT p.doc_id, p.seq, p.party_key, r.ref FROM parties p JOIN (SELECT doc_id, seq, unnest({_REFS}) AS ref FROM reg WHERE {_kind('discharge', rules='owners')}) r ON r.doc_id = p.doc_id AND r.seq = p.seq WHERE p.side = 'claimant'),
 closed AS (SELECT od.doc_id, od.seq, od.party_key, min(pd.seq) AS discharge_seq FROM od LEFT JOIN pd ON pd.doc_id = od.doc_id AND pd.party_key = od.party_key AND pd.ref = od.doc_no AND pd.seq > od.seq GROUP BY ALL)"""


def _reg(spark: SparkSession, d: str) -> DataFrame:
    return register.register(table(spark, d, "ec_entry"))


# ---- the register ----------------------------------------------------------------------
def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates as ISO text, so that both engines give equal values."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


@query(f"WITH {_REG} SELECT * REPLACE (CAST(execution_date AS VARCHAR) AS execution_date, CAST(presentation_date AS VARCHAR) AS presentation_date, CAST(registration_date AS VARCHAR) AS registration_date) FROM reg")
def register_clean(spark, d):
    return _dates_as_text(_reg(spark, d))


@query(f"WITH {_REG} SELECT doc_id, seq, nature, {', '.join(f'{_kind(k)} AS is_{k}' for k in _WORDS['register'])} FROM reg")
def nature_kinds(spark, d):
    return register.kinds(_reg(spark, d))


@query(f"WITH {_REG} SELECT doc_id, seq, nature, {', '.join(f'''{_kind(k, rules='filter')} AS is_{k}''' for k in _WORDS['filter'])} FROM reg")
def nature_kinds_filter(spark, d):
    return register.kinds(_reg(spark, d), "filter")


@query(f"WITH {_REG}, t AS (SELECT doc_id, seq, list_filter([{', '.join(f'''CASE WHEN {_has(c, ['court', 'நீதிமன்ற'])} THEN '{c}' END''' for c in ('nature', 'remarks', 'executants', 'claimants'))}], lambda x: x IS NOT NULL) AS p FROM reg) SELECT doc_id, seq, array_to_string(p, ',') AS places FROM t WHERE len(p) > 0")
def court_entries(spark, d):
    return register.court_entries(_reg(spark, d))


@query(
    f"""WITH {_REG}, s AS (SELECT doc_id, sr, arg_min(doc_no, seq) AS doc_no FROM reg WHERE sr IS NOT NULL GROUP BY doc_id, sr),
 l AS (SELECT doc_id, sr AS prev_sr, doc_no AS prev_doc, lead(sr) OVER w AS next_sr, lead(doc_no) OVER w AS next_doc FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY sr))
 SELECT doc_id, prev_sr, prev_doc, next_sr, next_doc, next_sr - prev_sr - 1 AS missing,
  CASE WHEN next_sr = prev_sr + 2 THEN CAST(prev_sr + 1 AS VARCHAR) ELSE concat(prev_sr + 1, '-', next_sr - 1) END AS missing_range FROM l WHERE next_sr > prev_sr + 1"""
)
def serial_gaps(spark, d):
    return register.serial_gaps(_reg(spark, d))


@query(f"WITH {_REG} SELECT doc_id, coalesce(trim(string_split(nature, chr(10))[1], ' '), 'Other') AS kind, count(*) AS n, min(seq) AS first_seq FROM reg GROUP BY 1, 2")
def nature_histogram(spark, d):
    return register.nature_histogram(_reg(spark, d))


@query(f"WITH {_PARTIES} SELECT * FROM parties")
def parties(spark, d):
    return register.parties(_reg(spark, d))


@query(f"WITH {_PROFILES} SELECT * FROM profiles")
def party_profiles(spark, d):
    return register.party_profiles(register.parties(_reg(spark, d)))


@query(f"WITH {_PROFILES} SELECT * FROM groups")
def owner_groups(spark, d):
    return register.owner_groups(register.party_profiles(register.parties(_reg(spark, d))))


_UNITS = "u AS (SELECT DISTINCT doc_id, nullif(regexp_extract(upper(survey_no), '([0-9]{1,5}(?:/[0-9A-Z]+)?)', 1), '') AS unit FROM reg)"


@query(
    f"""WITH {_PROFILES}, {_UNITS}, n AS (SELECT doc_id, count(unit) AS units FROM u GROUP BY doc_id),
 g AS (SELECT doc_id, count(*) FILTER (owner_group IN ('current', 'former')) AS owners, count(*) FILTER (owner_group = 'current') AS current, count(*) FILTER (owner_group = 'former') AS former,
   count(*) FILTER (institution) AS institutions, count(*) FILTER (owner_group = 'other') AS other, count(*) AS parties FROM groups GROUP BY doc_id) SELECT g.*, coalesce(units, 0) AS units FROM g LEFT JOIN n USING (doc_id)"""
)
def registry_summary(spark, d):
    reg = _reg(spark, d)
    return register.registry_summary(register.owner_groups(register.party_profiles(register.parties(reg))), register.units(reg))


@query(f"WITH {_PARTIES} SELECT DISTINCT doc_id, party_key, seq, doc_no, nature, CASE WHEN side = 'executant' THEN 'transferor' ELSE 'transferee' END AS role FROM parties WHERE party_key <> ''")
def party_entries(spark, d):
    return register.party_entries(register.parties(_reg(spark, d)))


@query(f"WITH {_PROFILES} SELECT p.doc_id, p.party_key, p.party, p.entries, p.units, g.owner_group FROM profiles p JOIN groups g USING (doc_id, party_key) WHERE p.party_key = 'kaviyamani' OR contains(lower(p.party), 'kaviyamani')")
def owner_dossier(spark, d):
    profiles = register.party_profiles(register.parties(_reg(spark, d)))
    return register.dossier(profiles, register.owner_groups(profiles), "Kaviyamani").select("doc_id", "party_key", "party", "entries", "units", "owner_group")


@query(f"WITH {_REG} SELECT doc_id, seq, unnest({_REFS}) AS ref FROM reg")
def references(spark, d):
    return register.references(_reg(spark, d))


@query(f"WITH {_LOANS} SELECT * FROM loans")
def loan_match_first(spark, d):
    return register.loan_match_first(_reg(spark, d))


@query(f"WITH {_MORTGAGORS} SELECT * FROM closed")
def loan_match_after(spark, d):
    return register.loan_match_after(_reg(spark, d))


@query(f"WITH {_MORTGAGORS} SELECT doc_id, party_key, count(*) AS mortgages, count(discharge_seq) AS closed, count(*) > count(discharge_seq) AS active FROM closed WHERE party_key IS NOT NULL GROUP BY doc_id, party_key")
def active_mortgages(spark, d):
    return register.active_mortgages(_reg(spark, d))


_SIDES = lambda kind, lender, borrower: f"(SELECT doc_id, survey_no, {_first_party(lender)} AS lender, {_first_party(borrower)} AS borrower, seq FROM reg WHERE {_kind(kind, rules='screen')})"


@query(
    f"""WITH {_REG}, m AS {_SIDES('mortgage', 'claimants', 'executants')}, p AS {_SIDES('discharge', 'executants', 'claimants')},
 mk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, survey_no, lender, borrower ORDER BY seq) AS rank FROM m WHERE survey_no IS NOT NULL AND lender IS NOT NULL AND borrower IS NOT NULL),
 pk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, survey_no, lender, borrower ORDER BY seq) AS rank FROM p WHERE survey_no IS NOT NULL AND lender IS NOT NULL AND borrower IS NOT NULL),
 k AS (SELECT mk.doc_id, mk.seq, mk.rank, pk.seq AS discharge_seq FROM mk LEFT JOIN pk USING (doc_id, survey_no, lender, borrower, rank)),
 o AS (SELECT m.doc_id, any_value(p.seq) AS only_seq FROM (SELECT doc_id FROM m GROUP BY doc_id HAVING count(*) = 1) m JOIN p USING (doc_id) GROUP BY m.doc_id HAVING count(*) = 1)
 SELECT m.doc_id, m.survey_no, m.seq, CAST(k.rank AS INTEGER) AS rank, coalesce(k.discharge_seq, o.only_seq) AS discharge_seq FROM m LEFT JOIN k USING (doc_id, seq) LEFT JOIN o USING (doc_id)"""
)
def loan_match_rank(spark, d):
    return register.loan_match_rank(_reg(spark, d))


@query(
    f"""WITH {_LOANS}, s AS (SELECT doc_id, count(*) AS loans, count(discharge_seq) AS closed FROM loans GROUP BY doc_id),
 c AS (SELECT doc_id, count(*) AS entries, count(*) FILTER ({_kind('court')}) AS court_cases FROM reg GROUP BY doc_id)
 SELECT doc_id, entries, coalesce(loans, 0) AS loans, coalesce(closed, 0) AS closed, coalesce(loans, 0) - coalesce(closed, 0) AS open, court_cases,
  round(coalesce(closed * 100.0 / nullif(loans, 0), 0.0)::DOUBLE, 1) AS closed_pct FROM c LEFT JOIN s USING (doc_id)"""
)
def loan_status(spark, d):
    return register.loan_status(_reg(spark, d))


def _holder_sql(unit: str) -> str:
    return f"""WITH {_REG}, g AS (SELECT {unit}, arg_max(row(claimants, doc_no, seq), seq) FILTER ({_kind('conveyance')} AND claimants IS NOT NULL) AS c,
   arg_max(row(seq, doc_no, {_kind('mortgage')}, {_kind('discharge')}, executants, claimants), seq) AS l FROM reg GROUP BY {unit}),
 h AS (SELECT {unit}, c[1] AS cp, c[2] AS cd, c[3] AS cs, l[1] AS ls, l[2] AS ld, l[3] AS lm, l[4] AS lx, l[5] AS le, l[6] AS lc FROM g)
 SELECT {unit}, coalesce(cp, CASE WHEN lm THEN le WHEN lx THEN lc ELSE coalesce(lc, le) END) AS holder, CASE WHEN cs IS NOT NULL THEN cd ELSE ld END AS doc_no, coalesce(cs, ls) AS seq,
  CASE WHEN cs IS NOT NULL THEN 'purchaser' WHEN lm THEN 'mortgagor' WHEN lx THEN 'discharged' ELSE 'party' END AS role FROM h"""


@query(_holder_sql("doc_id"))
def current_holder(spark, d):
    return register.holder(_reg(spark, d))


@query(_holder_sql("doc_id, survey_no"))
def unit_holder(spark, d):
    return register.holder(_reg(spark, d), ["doc_id", "survey_no"])


_CHAIN = f"{_REG}, chain AS (SELECT doc_id, survey_no, CAST(row_number() OVER (PARTITION BY doc_id, survey_no ORDER BY seq) AS INTEGER) AS step, count(*) OVER (PARTITION BY doc_id, survey_no) AS steps, seq, doc_no, executants AS seller, claimants AS buyer FROM reg WHERE {_kind('conveyance')} AND survey_no IS NOT NULL)"


@query(f"WITH {_CHAIN} SELECT * FROM chain")
def title_chain(spark, d):
    return register.title_chain(_reg(spark, d))


@query(f"WITH {_CHAIN} SELECT doc_id, survey_no, string_agg(concat('Step ', step, '/', steps, ': ', coalesce(seller, '-'), ' -> ', coalesce(buyer, '-')), chr(10) ORDER BY step) AS pedigree FROM chain GROUP BY doc_id, survey_no")
def title_pedigree(spark, d):
    return sinks.pedigree(register.title_chain(_reg(spark, d)))


@query(f"WITH {_REG} SELECT doc_id, survey_no, seq, claimants AS owner, lead(claimants) OVER w AS next_owner, lead(doc_no) OVER w AS next_doc FROM reg WHERE {_kind('conveyance')} AND survey_no IS NOT NULL WINDOW w AS (PARTITION BY doc_id, survey_no ORDER BY seq)")
def transfers(spark, d):
    return register.transfers(_reg(spark, d))


@query(f"WITH {_REG} SELECT doc_id, seq, doc_no, nature, CAST(registration_date AS VARCHAR) AS registration_date, executants, claimants FROM reg QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1")
def last_transaction(spark, d):
    return _dates_as_text(register.last_transaction(_reg(spark, d)))


@query(f"WITH {_REG}, u AS (SELECT doc_id, seq, nullif(regexp_extract(upper(survey_no), '([0-9]{{1,5}}(?:/[0-9A-Z]+)?)', 1), '') AS unit FROM reg) SELECT doc_id, unit, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM u WHERE unit IS NOT NULL GROUP BY doc_id, unit")
def unit_cluster(spark, d):
    return register.units(_reg(spark, d))


@query(f"WITH {_REG}, u AS (SELECT doc_id, seq, {_rx(_rx('upper(survey_no)', S.SURVEY_WORDS, ''), '[^A-Z0-9/]', '')} AS unit FROM reg) SELECT doc_id, unit, count(*) AS entries, min(seq) AS first_seq, max(seq) AS last_seq FROM u WHERE unit IS NOT NULL AND unit <> '' GROUP BY doc_id, unit")
def unit_cluster_whole(spark, d):
    return register.units(_reg(spark, d), whole=True)


@query(f"WITH {_REG}, e AS (SELECT doc_id, arg_min(registration_date, seq) AS first_date, arg_max(registration_date, seq) AS last_date FROM reg WHERE registration_date IS NOT NULL GROUP BY doc_id) SELECT doc_id, CAST(first_date AS VARCHAR) AS first_date, CAST(last_date AS VARCHAR) AS last_date, abs(year(last_date) - year(first_date)) + 1 AS years FROM e")
def observed_span(spark, d):
    return _dates_as_text(register.observed_span(_reg(spark, d)))


@query(f"WITH {_REG}, s AS (SELECT doc_id, extent AS value, min(seq) AS f FROM reg WHERE extent IS NOT NULL GROUP BY doc_id, extent), r AS (SELECT doc_id, value, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY f, value) AS INTEGER) AS rank FROM s) SELECT doc_id, rank, value FROM r WHERE rank <= 8")
def first_extents(spark, d):
    return register.first_distinct(_reg(spark, d), "extent")


@query()
def party_lists_folded(spark, d):
    return register.drop_shorter_spellings(register.parties(_reg(spark, d)))


@query(f"WITH {_REG} SELECT {', '.join(['doc_id'] + [f'arg_min({c}, seq) FILTER ({c} IS NOT NULL) AS {c}' for c in ('survey_no', 'village_street', 'extent', 'plot_no', 'door_no')])} FROM reg GROUP BY doc_id")
def criteria_autofill(spark, d):
    return fields.first_known(_reg(spark, d), "doc_id", "seq", ["survey_no", "village_street", "extent", "plot_no", "door_no"])


@query(
    f"""WITH {_REG}, s AS (SELECT doc_id, survey_no, seq, 1 AS sold, {_first_party('executants')} AS party FROM reg WHERE {_has('nature', ['sale deed', 'conveyance', 'கிரைய'])} AND survey_no IS NOT NULL AND executants IS NOT NULL AND claimants IS NOT NULL
  UNION ALL SELECT doc_id, survey_no, seq, 0, {_first_party('claimants')} FROM reg WHERE {_has('nature', ['sale deed', 'conveyance', 'கிரைய'])} AND survey_no IS NOT NULL AND executants IS NOT NULL AND claimants IS NOT NULL),
 l AS (SELECT *, lag(sold) OVER w AS before, lag(seq) OVER w AS first_seq FROM s WINDOW w AS (PARTITION BY doc_id, survey_no, party ORDER BY seq, sold))
 SELECT doc_id, survey_no, party, first_seq, seq AS second_seq FROM l WHERE sold = 1 AND before = 1"""
)
def double_sales(spark, d):
    return crosscheck.double_sales(_reg(spark, d))


# ---- scalars -----------------------------------------------------------------------------
_FORMS = "['%d-%b-%Y', '%d-%B-%Y', '%d-%m-%Y', '%d/%m/%Y', '%Y-%m-%d', '%d.%m.%Y']"


@query(f"SELECT DISTINCT doc_id, seq, registration_date_raw AS raw, CAST(CAST(try_strptime(trim(registration_date_raw), {_FORMS}) AS DATE) AS VARCHAR) AS parsed FROM ec_entry")
def dates_parsed(spark, d):
    raw = F.col("registration_date_raw")
    return table(spark, d, "ec_entry").select("doc_id", "seq", raw.alias("raw"), S.parse_date(raw).cast("string").alias("parsed")).distinct()


_MONEY = f"try_cast({_rx(_rx('lower(consideration)', r'rs[.]?|/-|,', ''), '[^0-9.]', '')} AS DECIMAL(18,2))"


@query(f"SELECT DISTINCT doc_id, seq, consideration AS raw, {_MONEY} AS parsed FROM ec_entry")
def money_parsed(spark, d):
    return table(spark, d, "ec_entry").select("doc_id", "seq", F.col("consideration").alias("raw"), S.amount(F.col("consideration")).alias("parsed")).distinct()


_PAIRS = "regexp_replace(CASE WHEN length(h) % 2 = 1 THEN h[2:] ELSE h END, '([0-9]{2})', '\\1,', 'g')"


@query(
    f"""WITH v AS (SELECT DISTINCT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n FROM orders), s AS (SELECT o_orderkey, n, CAST(n AS VARCHAR) AS t, CASE WHEN n > 999 THEN left(CAST(n AS VARCHAR), length(CAST(n AS VARCHAR)) - 3) ELSE '' END AS h FROM v)
 SELECT o_orderkey, CASE WHEN n <= 0 THEN '-' WHEN n <= 999 THEN concat('Rs. ', t, '/-') ELSE concat('Rs. ', CASE WHEN length(h) % 2 = 1 THEN concat(h[1], CASE WHEN length(h) > 1 THEN ',' ELSE '' END) ELSE '' END, rtrim({_PAIRS}, ','), ',', right(t, 3), '/-') END AS money FROM s"""
)
def money_formatted(spark, d):
    return table(spark, d, "orders").select("o_orderkey", S.rupees(F.col("o_totalprice")).alias("money")).distinct()


@query(
    f"""SELECT DISTINCT doc_id, round((date_diff('day', search_period_from, search_period_to) / 365.25)::DOUBLE, 1) AS years,
  CASE WHEN search_period_from IS NULL OR search_period_to IS NULL THEN 'unspecified' WHEN date_diff('day', search_period_from, search_period_to) / 365.25 < 30 THEN 'short' ELSE 'full' END AS window_kind FROM ec_header"""
)
def search_window(spark, d):
    days = F.datediff("search_period_to", "search_period_from") / F.lit(365.25)
    kind = F.when(days.isNull(), "unspecified").when(days < 30, "short").otherwise("full")
    return table(spark, d, "ec_header").select("doc_id", S.window_years(F.col("search_period_from"), F.col("search_period_to")).alias("years"), kind.alias("window_kind")).distinct()


@query(f"SELECT DISTINCT doc_id, seq, {_rx('claimants', r'\b[0-9]{4}[ -]?[0-9]{4}[ -]?([0-9]{4})\b', r'XXXX-XXXX-\1')} AS claimants FROM ec_entry WHERE {_nn('claimants')} IS NOT NULL")
def ids_masked(spark, d):
    e = table(spark, d, "ec_entry")
    return e.select("doc_id", "seq", S.mask_numbers(nullify(F.col("claimants"))).alias("claimants")).filter("claimants IS NOT NULL").distinct()


@query(f"WITH {_REG} SELECT doc_id, seq, {_name('executants')} AS name_normal, {_party_key('executants')} AS key FROM reg WHERE executants IS NOT NULL")
def names_normal(spark, d):
    return _reg(spark, d).filter("executants IS NOT NULL").select("doc_id", "seq", S.name_normal(F.col("executants")).alias("name_normal"), S.party_key(F.col("executants")).alias("key"))


@query()
def tamil_read(spark, d):
    """Distinct Tamil natures with their Latin reading: read once each, as a join table would hold them."""
    values = _reg(spark, d).select("nature").filter(F.col("nature").rlike("[஀-௿]")).distinct()
    return values.select("nature", tamil.transliterate(tamil.logical_order(F.col("nature"))).alias("latin"))


# ---- areas (training-data problem 5 among them) -----------------------------------------
def p5_areas(spark: SparkSession, d: str) -> DataFrame:
    return units.areas_in_sqft(spark, table(spark, d, "ec_header"), table(spark, d, "real_pdf_result"))


_AREAS = f"SELECT DISTINCT * FROM ({units.area_sql(units.register_source('ec_header', 'real_pdf_result'), 'duckdb')}) AS a"
p5_areas = query(_AREAS)(p5_areas)


@query(f"SELECT src, rec_key, field_name, sqft FROM ({_AREAS}) AS b WHERE NOT is_usual")
def p5_found(spark, d):
    return p5_areas(spark, d).filter("NOT is_usual").select("src", "rec_key", "field_name", "sqft")


@query(
    f"""WITH a AS ({_AREAS}), t AS (SELECT src, rec_key, max(sqft) FILTER (field_name = 'extent_ha') AS extent_ha, max(sqft) FILTER (field_name = 'sq_feet') AS sq_feet FROM a GROUP BY src, rec_key),
 p AS (SELECT rec_key, extent_ha, sq_feet, round((abs(extent_ha::DOUBLE - sq_feet) * 100 / nullif(greatest(extent_ha, sq_feet), 0))::DOUBLE, 2) AS percent FROM t WHERE extent_ha IS NOT NULL AND sq_feet IS NOT NULL)
 SELECT rec_key, extent_ha, sq_feet, percent, percent <= 5 AS within FROM p"""
)
def extent_variance(spark, d):
    return crosscheck.extent_variance(p5_areas(spark, d))


@query(
    f"""WITH a AS ({_AREAS}), k AS (SELECT DISTINCT patta_number, CAST(row_id AS VARCHAR) AS rec_key FROM real_pdf_result)
 SELECT patta_number, count(*) AS lines, count(sqft) AS measured, CAST(coalesce(sum(sqft), 0) AS BIGINT) AS sqft FROM k LEFT JOIN (SELECT rec_key, sqft FROM a WHERE field_name = 'extent_ha') s USING (rec_key) GROUP BY patta_number"""
)
def cadastral_totals(spark, d):
    return crosscheck.cadastral_totals(p5_areas(spark, d), table(spark, d, "real_pdf_result"))


# ---- checks across documents ----------------------------------------------------------
_HEAD = "head AS (SELECT * FROM ec_header QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC) = 1)"
_TELL = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} THEN 'pass' ELSE 'fail' END"
_CHECKS = {
    "declared_total": "(total_entries_declared = coalesce(entries, 0))",
    "inside_period": "(first_date >= search_period_from AND last_date <= search_period_to)",
    "pages_complete": "(pages = last_page)",
    "survey_named": f"(CASE WHEN surveys > 0 THEN {_nn('survey_details')} IS NOT NULL END)",
    "applicant_named": f"({_nn('applicant_name')} IS NOT NULL)",
}
_MATRIX = f"""{_REG}, {_HEAD}, e AS (SELECT doc_id, count(*) AS entries, min(registration_date) AS first_date, max(registration_date) AS last_date, count(DISTINCT survey_no) AS surveys FROM reg GROUP BY doc_id),
 s AS (SELECT doc_id, count(*) AS pages, max(page_number) AS last_page FROM ec GROUP BY doc_id), j AS (SELECT * FROM head LEFT JOIN e USING (doc_id) LEFT JOIN s USING (doc_id)),
 matrix AS ({' UNION ALL '.join(f"SELECT doc_id, '{k}' AS check_name, {_TELL.format(v)} AS status FROM j" for k, v in _CHECKS.items())})"""


def _matrix(spark, d):
    return crosscheck.cross_matrix(table(spark, d, "ec_header"), _reg(spark, d), table(spark, d, "ec"))


@query(f"WITH {_MATRIX} SELECT * FROM matrix")
def cross_matrix(spark, d):
    return _matrix(spark, d)


@query(f"WITH {_MATRIX}, c AS (SELECT doc_id, count(*) FILTER (status = 'pass') AS pass, count(*) FILTER (status = 'fail') AS fail, count(*) FILTER (status = 'unknown') AS unknown FROM matrix GROUP BY doc_id) SELECT *, fail = 0 AND pass > 0 AS clean FROM c")
def matrix_summary(spark, d):
    return crosscheck.matrix_summary(_matrix(spark, d))


@query(
    f"""WITH {_HEAD}, h AS (SELECT doc_id, nullif(regexp_extract(upper({_nn('survey_details')}), '([0-9]{{1,5}}(?:/[0-9A-Z]+)?)', 1), '') AS survey FROM head),
 p AS (SELECT doc_id, survey, page_number, contains({_rx('upper(content)', r'\s', '')}, survey) AS hit, nullif(regexp_extract(upper(content), '([0-9]{{1,4}}/[0-9A-Z]+)', 1), '') AS token FROM h JOIN ec USING (doc_id) WHERE content IS NOT NULL AND survey IS NOT NULL),
 g AS (SELECT doc_id, survey, bool_or(hit) AS present, arg_min(token, page_number) FILTER (token IS NOT NULL) AS seen FROM p GROUP BY doc_id, survey)
 SELECT doc_id, survey, present, CASE WHEN NOT present THEN seen END AS suggestion FROM g"""
)
def survey_check(spark, d):
    return crosscheck.survey_check(table(spark, d, "ec_header"), table(spark, d, "ec"))


_HEADER_FIELDS = ["sro", "certificate_no", "application_no", "applicant_name", "village", "zone", "district", "form_type"]
_ENVELOPE = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS field, {_nn(c)} AS value, CASE WHEN {_nn(c)} IS NULL THEN 0.0::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM head" for c in _HEADER_FIELDS)


@query(f"WITH {_HEAD} {_ENVELOPE}")
def field_envelope(spark, d):
    return fields.envelope(crosscheck.latest_header(table(spark, d, "ec_header")), "doc_id", _HEADER_FIELDS)


@query(
    f"""WITH {_HEAD}, {_REG}, b AS ({_ENVELOPE}), o AS (SELECT doc_id, 'village' AS field, arg_min(village_street, seq) FILTER (village_street IS NOT NULL) AS value FROM reg GROUP BY doc_id)
 SELECT coalesce(b.doc_id, o.doc_id) AS doc_id, coalesce(b.field, o.field) AS field, coalesce(b.value, o.value) AS value, greatest(coalesce(b.confidence, 0), CASE WHEN o.doc_id IS NULL OR o.value IS NULL THEN 0.0 ELSE 0.6 END)::DOUBLE AS confidence,
  CASE WHEN b.value IS NOT NULL THEN 'base' WHEN o.value IS NOT NULL THEN 'other' END AS origin FROM b FULL JOIN o ON b.doc_id = o.doc_id AND b.field = o.field"""
)
def field_merge(spark, d):
    base = field_envelope(spark, d)
    first = fields.first_known(_reg(spark, d), "doc_id", "seq", ["village_street"]).withColumnRenamed("village_street", "village")
    return fields.merge(base, fields.envelope(first, "doc_id", ["village"], 0.6), "doc_id")


@query(f"WITH {_HEAD}, b AS ({_ENVELOPE}) SELECT doc_id, concat(array_to_string(list_transform(string_split(replace(field, '_', ' '), ' '), lambda w: concat(upper(w[1]), w[2:])), ' '), ': ', coalesce(value, 'Not Detected')) AS line FROM b")
def key_value_lines(spark, d):
    return sinks.key_value_lines(field_envelope(spark, d), "doc_id")


@query(f"WITH {_REG} SELECT doc_id, sr, {', '.join(f'''coalesce({e}, '-') AS {n}''' for n, e in (('doc_no', 'doc_no'), ('date', 'strftime(coalesce(registration_date, execution_date, presentation_date), chr(37) || chr(100) || chr(45) || chr(37) || chr(98) || chr(45) || chr(37) || chr(89))'), ('nature', 'nature'), ('executants', 'executants'), ('claimants', 'claimants'), ('amount', 'coalesce(consideration, market_value)'), ('survey_no', 'survey_no'), ('remarks', 'remarks')))} FROM reg")
def register_csv(spark, d):
    return sinks.register_table(_reg(spark, d))


# ---- documents, pages, lines ------------------------------------------------------------
def _score_sql(words: list[tuple[str, int]], c: str) -> str:
    return " + ".join(f"contains(lower({c}), '{w}')::INT * {n}" for w, n in words)


@query(
    "WITH s AS (SELECT doc_id, "
    + ", ".join(f"coalesce({_score_sql(w, 'text')}, 0) AS {n}" for n, w in documents.SORTS)
    + f" FROM documents), b AS (SELECT *, greatest({', '.join(n for n, _ in documents.SORTS)}) AS score FROM s) SELECT doc_id, CASE "
    + " ".join(f"WHEN {n} = score AND score > 0 THEN '{n}'" for n, _ in documents.SORTS)
    + f" ELSE '{documents.SORTS[0][0]}' END AS sort, score FROM b"
)
def doc_type_detect(spark, d):
    return documents.detect_sort(table(spark, d, "documents"), "doc_id", "text")


_PAGE_WORDS = [("mortgage", 2), ("power of attorney", 2), ("lease", 1), ("settlement", 1)]


@query(f"WITH s AS (SELECT doc_id, page_number, page_id, coalesce({_score_sql(_PAGE_WORDS, 'content')}, 0) AS score FROM ec), r AS (SELECT doc_id, page_id, score, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_id) AS INTEGER) AS rank FROM s) SELECT * FROM r WHERE rank <= 6")
def page_topk(spark, d):
    return documents.top_pages(table(spark, d, "ec"), "doc_id", "page_id", "content", _PAGE_WORDS)


_LINES = "lines AS (SELECT page_id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no FROM ec WHERE content IS NOT NULL)"


@query(f"WITH {_LINES} SELECT page_id, CAST(line_no AS INTEGER) AS line_no, line FROM lines")
def page_lines(spark, d):
    return documents.lines(table(spark, d, "ec"), "page_id", "content")


@query(
    f"""WITH {_LINES}, k AS (SELECT * FROM lines WHERE line_no <= 3 OR regexp_matches(lower(line), 'survey|document|loan')),
 u AS (SELECT page_id, CAST(line_no AS INTEGER) AS line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used FROM k) SELECT * FROM u WHERE used < 400"""
)
def context_prune(spark, d):
    return documents.prune(documents.lines(table(spark, d, "ec"), "page_id", "content"), "page_id", "line_no", "line", 400, 3, ("survey", "document", "loan"))


_ANCHOR = "[0-9]{1,5}/[0-9]{4}"


@query(
    f"""WITH {_LINES}, a AS (SELECT page_id, line_no, regexp_matches(line, '{_ANCHOR}') AND NOT coalesce(regexp_matches(lag(line) OVER (PARTITION BY page_id ORDER BY line_no), '(?i)prior document'), FALSE) AS b FROM lines),
 c AS (SELECT page_id, line_no, sum(b::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS chunk FROM a)
 SELECT page_id, CAST(chunk AS BIGINT) AS chunk, count(*) AS n_lines, CAST(min(line_no) AS INTEGER) AS first_line, CAST(max(line_no) AS INTEGER) AS last_line FROM c WHERE chunk > 0 GROUP BY page_id, chunk"""
)
def entry_chunks(spark, d):
    return documents.chunks(documents.lines(table(spark, d, "ec"), "page_id", "content"), "page_id", "line_no", "line", _ANCHOR)


@query("SELECT page_id, doc_id, page_number FROM ec WHERE (page_number BETWEEN 1 AND 2 OR page_number BETWEEN 4 AND 4) AND page_number <= 4")
def page_range(spark, d):
    return documents.page_range(table(spark, d, "ec"), "1-2,4,x,9-5", 4).select("page_id", "doc_id", "page_number")


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def text_counts(spark, d):
    return documents.text_counts(table(spark, d, "documents"), "doc_id", "text")


@query(r"SELECT page_id, NOT (len(regexp_extract_all(content, '\(cid:[0-9]+\)')) >= 5 OR (len(regexp_extract_all(content, '\(cid:[0-9]+\)')) >= 1 AND length(content) < 100) OR len(regexp_extract_all(content, '\(\s*\)')) >= 3 OR len(regexp_extract_all(content, '�')) >= 2) AS trusted FROM ec WHERE content IS NOT NULL")
def text_trust(spark, d):
    return table(spark, d, "ec").filter("content IS NOT NULL").select("page_id", documents.trusted_layer(table(spark, d, "ec")).alias("trusted"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{r.field}' AS field, nullif(trim(regexp_extract(text, '{r.pattern}', 1)), '') AS value, CASE WHEN nullif(trim(regexp_extract(text, '{r.pattern}', 1)), '') IS NULL THEN 0.0::DOUBLE ELSE {r.confidence}::DOUBLE END AS confidence FROM documents WHERE text IS NOT NULL" for r in documents.DEED_RULES))
def rule_extract(spark, d):
    return documents.extract_by_rules(table(spark, d, "documents"), "doc_id", "text", documents.DEED_RULES)


@query(f"WITH {_REG} SELECT doc_id, seq, " + ", ".join(f"nullif(trim(regexp_extract(boundaries, '(?:^|\\s)(?:{a}|{b}):\\s*([^:]*?)(?:\\s+(?:[NSEW]|North|South|East|West):|,|$)', 1)), '') AS {b.lower()}" for a, b in (("N", "North"), ("S", "South"), ("E", "East"), ("W", "West"))) + " FROM reg WHERE boundaries IS NOT NULL")
def boundary_clauses(spark, d):
    return documents.boundary_clauses(_reg(spark, d))


@query(
    """WITH a AS (SELECT DISTINCT lower(trim(district)) AS value FROM ec_header WHERE trim(coalesce(district, '')) <> ''), b AS (SELECT DISTINCT place_name AS entry, lower(trim(place_name)) AS low FROM place_ref WHERE place_kind = 'district'),
 s AS (SELECT value, entry, levenshtein(value, low) AS edits FROM a, b) SELECT value, entry, CAST(edits AS INTEGER) AS edits FROM s WHERE edits <= greatest(2, length(value) // 2) QUALIFY row_number() OVER (PARTITION BY value ORDER BY edits, entry) = 1"""
)
def dict_fuzzy(spark, d):
    return lookup.nearest_entry(table(spark, d, "ec_header"), "district", table(spark, d, "place_ref").filter("place_kind = 'district'"), "place_name", contained=False)


@query(
    """WITH a AS (SELECT DISTINCT lower(trim(district)) AS value FROM ec_header WHERE trim(coalesce(district, '')) <> ''), b AS (SELECT DISTINCT place_name AS entry, lower(trim(place_name)) AS low FROM place_ref WHERE place_kind = 'district' AND trim(place_name) <> ''),
 s AS (SELECT value, entry, low, contains(value, low) OR contains(low, value) AS held, levenshtein(value, low) AS edits FROM a, b) SELECT value, entry, CAST(edits AS INTEGER) AS edits FROM s WHERE held OR edits <= greatest(2, length(low) // 2) QUALIFY row_number() OVER (PARTITION BY value ORDER BY held DESC, edits, entry) = 1"""
)
def dict_contained(spark, d):
    """J11 with its substring pass; ``dict_fuzzy`` keeps the narrower rule of its SQL."""
    return lookup.nearest_entry(table(spark, d, "ec_header"), "district", table(spark, d, "place_ref").filter("place_kind = 'district'"), "place_name")


# ---- boxes: line items stand for boxes on a page (an order) -------------------------------
_BOXES = "boxes AS (SELECT l_orderkey AS page, l_linenumber AS id, CAST(min(l_quantity) AS DOUBLE) AS x0, CAST(min(l_quantity) AS DOUBLE) + 12 AS x1, CAST(min(l_suppkey) % 60 AS DOUBLE) AS y0, CAST(min(l_suppkey) % 60 AS DOUBLE) + 9 AS y1, CAST(max(l_partkey) AS DOUBLE) AS score FROM lineitem GROUP BY 1, 2)"


def _boxes(spark, d):
    x, y = F.min("l_quantity").cast("double"), (F.min("l_suppkey") % 60).cast("double")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("id")).agg(x.alias("x0"), (x + 12).alias("x1"), y.alias("y0"), (y + 9).alias("y1"), F.max("l_partkey").cast("double").alias("score"))


def _share_sql(a0: str, a1: str, b0: str, b1: str) -> str:
    return f"(CASE WHEN least({a1}, {b1}) - greatest({a0}, {b0}) > 0 THEN (least({a1}, {b1}) - greatest({a0}, {b0})) / least({a1} - {a0}, {b1} - {b0}) WHEN least({a1}, {b1}) - greatest({a0}, {b0}) >= 0 THEN 1.0 ELSE 0.0 END)"


@query(
    f"""WITH {_BOXES}, m AS (SELECT a.page, a.id, b.id AS best_id, b.score FROM boxes a JOIN boxes b ON a.page = b.page AND a.id % 2 = 1 AND b.id % 2 = 0
   AND {_share_sql('a.y0', 'a.y1', 'b.y0', 'b.y1')} > 0.35 AND {_share_sql('a.x0', 'a.x1', 'b.x0', 'b.x1')} > 0.10) SELECT page, id, best_id FROM m QUALIFY row_number() OVER (PARTITION BY page, id ORDER BY score DESC, best_id) = 1"""
)
def box_overlap(spark, d):
    boxes = _boxes(spark, d)
    return geometry.best_overlap(boxes.filter("id % 2 = 1"), boxes.filter("id % 2 = 0"), "page", 10.0)


@query(f"WITH {_BOXES} SELECT page, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y1) AS y1 FROM boxes GROUP BY page")
def box_union(spark, d):
    return geometry.union_box(_boxes(spark, d), "page")


@query(
    f"""WITH {_BOXES}, h AS (SELECT *, greatest(8.0, 0.55 * avg(y1 - y0) OVER (PARTITION BY page)) AS height FROM boxes), b AS (SELECT page, id, y0, coalesce((y0 - lag(y0) OVER (PARTITION BY page ORDER BY y0, id) > height)::INT, 1) AS b FROM h)
 SELECT page, id, CAST(sum(b) OVER (PARTITION BY page ORDER BY y0, id) AS BIGINT) AS row FROM b"""
)
def reading_order(spark, d):
    return geometry.reading_rows(_boxes(spark, d), "page").select("page", "id", "row")


# ---- sources and streams ----------------------------------------------------------------
@query(f"""SELECT page_id, array_to_string(regexp_extract_all(content, '{chr(92)}b([0-9]{{1,5}}/(?:19|20)[0-9]{{2}}){chr(92)}b', 1), ',') AS documents, array_to_string(regexp_extract_all(content, '{chr(92)}b([0-9]{{2}}-[A-Z][a-z]{{2}}-[0-9]{{4}}){chr(92)}b', 1), ',') AS dates FROM ec WHERE content IS NOT NULL""")
def page_references(spark, d):
    return readers.register_lines(table(spark, d, "ec")).select("page_id", F.array_join("documents", ",").alias("documents"), F.array_join("dates", ",").alias("dates"))


@query("SELECT date_trunc('day', loaded_at)::TIMESTAMP AS day, count(*) AS entries FROM ec_entry GROUP BY 1")
def daily_counts(spark, d):
    return open_loans.daily_counts(table(spark, d, "ec_entry"))


@query(
    rf"""WITH {_REG}, m AS (SELECT doc_id, doc_no AS ref, min(seq) AS mortgage_seq FROM reg WHERE {_kind('mortgage')} AND doc_no IS NOT NULL GROUP BY 1, 2),
 p AS (SELECT doc_id, ref, min(seq) AS discharge_seq FROM (SELECT doc_id, seq, unnest(regexp_extract_all(concat_ws(' ', pr_numbers, remarks), '([0-9]{{1,6}}/[0-9]{{4}})\b', 1)) AS ref FROM reg WHERE {_kind('discharge')}) GROUP BY 1, 2)
 SELECT doc_id, ref, mortgage_seq, discharge_seq, CASE WHEN discharge_seq IS NULL THEN 'open' ELSE 'closed' END AS status FROM m LEFT JOIN p USING (doc_id, ref)"""
)
def open_loan_table(spark, d):
    """What the stream of ``streaming.open_loans`` holds once the whole register has arrived."""
    events = open_loans.loan_events(_reg(spark, d))
    found = events.groupBy("doc_id", "ref").agg(F.min(F.when(F.col("event") == "mortgage", F.col("seq"))).alias("mortgage_seq"), F.min(F.when(F.col("event") == "discharge", F.col("seq"))).alias("discharge_seq"))
    return found.filter("mortgage_seq IS NOT NULL").withColumn("status", F.when(F.col("discharge_seq").isNull(), "open").otherwise("closed"))


# ---- records out of texts, values for display --------------------------------------------
_LABEL = "CASE " + " ".join(f"WHEN contains(lower(nature), '{w}') THEN '{label}'" for w, label in display.LABELS) + " WHEN nature IS NOT NULL THEN 'Other' END"


@query(f"WITH {_REG} SELECT doc_id, seq, nature, {_LABEL} AS label FROM reg")
def nature_labels(spark, d):
    return _reg(spark, d).select("doc_id", "seq", "nature", display.nature_label(F.col("nature")).alias("label"))


@query(rf"WITH {_REG} SELECT doc_id, seq, coalesce(consideration, nullif(regexp_extract(coalesce(remarks, ''), '(Rs[.]? ?[0-9,]+(?:/-)?)', 1), ''), market_value, '-') AS shown FROM reg")
def amounts_shown(spark, d):
    return _reg(spark, d).select("doc_id", "seq", display.shown_amount().alias("shown"))


@query(
    f"""WITH {_REG}, {_HEAD} SELECT reg.doc_id, reg.seq, coalesce(reg.extent, nullif(regexp_extract(coalesce(reg.remarks, ''), '(?i)extent of ([0-9][0-9.,]* [A-Za-z.]+)', 1), ''), {_nn('head.requested_extent')}) AS extent,
 coalesce(reg.village_street, {_nn('head.village')}) AS place FROM reg LEFT JOIN head ON reg.doc_id = head.doc_id"""
)
def property_info(spark, d):
    head = crosscheck.latest_header(table(spark, d, "ec_header")).select("doc_id", nullify(F.col("requested_extent")).alias("requested_extent"), nullify(F.col("village")).alias("village"))
    return display.property_info(_reg(spark, d), head)


@query(
    f"""WITH {_REG}, n AS (SELECT doc_id, count(*) AS pages FROM ec GROUP BY doc_id), t AS (SELECT doc_id, count(*) AS entries FROM reg GROUP BY doc_id)
 SELECT reg.doc_id, seq, coalesce(CAST(page_index AS BIGINT), CAST(least(pages - 1, floor((seq - 1) * pages / entries)) AS BIGINT)) AS page FROM reg JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)"""
)
def pages_shown(spark, d):
    return display.shown_page(_reg(spark, d), table(spark, d, "ec"))


_TEXT_SQL = "replace(lower(requested_extent), ',', '')"


def _unit_sql(unit: str) -> str:
    return rf"try_cast(regexp_extract({_TEXT_SQL}, '([0-9]+(?:\.[0-9]+)?)\s*(?:{unit})', 1) AS DOUBLE)"


_BARE_SQL = rf"try_cast(regexp_extract(trim({_TEXT_SQL}), '^([0-9]+(?:\.[0-9]+)?)$', 1) AS DOUBLE)"
_SQF, _SQM, _GRD, _ACR, _CNT = (_unit_sql(u) for u in (display._SQFT, display._SQM, display._GROUND, display._ACRE, display._CENT))


@query(
    f"""SELECT DISTINCT doc_id, requested_extent, round(coalesce({_SQF}, {_SQM} * 10.7639::DOUBLE, {_GRD} * 2400, {_ACR} * 43560, {_CNT} * 435.6::DOUBLE, {_BARE_SQL}), 2) AS by_check,
 round(coalesce({_CNT} * 435.6::DOUBLE, {_ACR} * 43560, {_GRD} * 2400, {_SQM} * 10.7639::DOUBLE, {_SQF}, {_BARE_SQL}), 2) AS by_validator FROM ec_header"""
)
def extent_sqft(spark, d):
    """The two precedences of the inventory side by side; ``p5_areas`` reads compounds rightly."""
    e = F.col("requested_extent")
    return table(spark, d, "ec_header").select("doc_id", e, display.extent_by_check(e).alias("by_check"), display.extent_by_validator(e).alias("by_validator")).distinct()


@query(f"SELECT DISTINCT row_id, land_type, NOT {_has('land_type', ['ryotwari', 'private', 'patta land', 'wet', 'dry', 'நஞ்சை', 'நன்செய்', 'புஞ்சை'])} AND {_has('land_type', ['poramboke', 'government', 'waterbody', 'kanmai', 'road', 'புறம்போக்கு', 'அரசு'])} AS flagged FROM real_pdf_result")
def land_flags(spark, d):
    return table(spark, d, "real_pdf_result").select("row_id", "land_type", display.land_flag(F.col("land_type")).alias("flagged")).distinct()


_RELATION = r"(?i)^(.*?)[,\s]+(?:[sdwh]/o[.]?|(?:son|daughter|wife|husband) of)\s+(.+)$"


@query(f"WITH {_PARTIES} SELECT doc_id, seq, side, ordinal, CASE WHEN regexp_matches(party, '{_RELATION}') THEN regexp_extract(party, '{_RELATION}', 1) ELSE party END AS name, nullif(regexp_extract(party, '{_RELATION}', 2), '') AS parent FROM parties")
def parentage(spark, d):
    rows = register.parties(_reg(spark, d))
    return rows.select("doc_id", "seq", "side", "ordinal", display.parentage(F.regexp_replace("party", r"S/o\.", "S/o")).alias("p")).select("doc_id", "seq", "side", "ordinal", "p.*")


def _sorted_sql() -> str:
    scores = {n: f"coalesce({_score_sql(w, 'text')}, 0)" for n, w in documents.SORTS}
    return "(CASE " + " ".join(f"WHEN {v} = greatest({', '.join(scores.values())}) AND {v} > 0 THEN '{n}'" for n, v in scores.items()) + f" ELSE '{documents.SORTS[0][0]}' END)"


@query(
    f"WITH s AS (SELECT doc_id, text, {_sorted_sql()} AS sort FROM documents WHERE text IS NOT NULL) "
    + " UNION ALL ".join(
        f"SELECT doc_id, sort, '{r.field}' AS field, nullif(trim(regexp_extract(text, '{r.pattern}', 1)), '') AS value, CASE WHEN nullif(trim(regexp_extract(text, '{r.pattern}', 1)), '') IS NULL THEN 0.0::DOUBLE ELSE {r.confidence}::DOUBLE END AS confidence FROM s WHERE sort = '{n}'"
        for n, rules in parse.RULES_BY_SORT.items()
        for r in rules
    )
)
def extracted_documents(spark, d):
    return parse.extract_documents(table(spark, d, "documents"), "doc_id", "text")


_PRIOR = "(?i)(prior|previous) doc"
_DAY = r"\b[0-9]{2}-[A-Z][a-z]{2}-[0-9]{4}\b"


@query(
    rf"""WITH {_LINES}, f AS (SELECT page_id, line_no, line, bool_or(regexp_matches(line, '{_DAY}')) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS dated,
  coalesce(regexp_matches(lag(line) OVER (PARTITION BY page_id ORDER BY line_no), '{_PRIOR}'), FALSE) AS prior FROM lines),
 a AS (SELECT *, sum((regexp_matches(line, '\b[0-9]{{1,6}}/[0-9]{{4}}\b') AND NOT regexp_matches(line, '[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{4}}') AND NOT prior AND dated AND NOT regexp_matches(line, '{_PRIOR}'))::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS entry FROM f),
 t AS (SELECT page_id, entry, string_agg(line, ' ' ORDER BY line_no) AS text, min(line_no) AS first_line, max(line_no) AS last_line FROM a WHERE entry > 0 GROUP BY page_id, entry)
 SELECT page_id, CAST(entry AS BIGINT) AS entry, CAST(first_line AS INTEGER) AS first_line, CAST(last_line AS INTEGER) AS last_line, regexp_extract(text, '(\b[0-9]{{1,6}}/[0-9]{{4}}\b)', 1) AS doc_no,
  CAST(CAST(try_strptime(regexp_extract(text, '({_DAY})', 1), '%d-%b-%Y') AS DATE) AS VARCHAR) AS date,
  nullif(regexp_extract(text, '(?i)(mortgage|settlement|lease|power of attorney|deposit of title deeds|loan)', 1), '') AS nature FROM t"""
)
def line_entries(spark, d):
    return _dates_as_text(parse.line_entries(documents.lines(table(spark, d, "ec"), "page_id", "content"), "page_id"))


@query("SELECT l_orderkey, count(*) AS members, count(*) FILTER (regexp_matches(lower(l_returnflag), 'n|a')) AS accounted, coalesce(string_agg(DISTINCT CASE WHEN NOT regexp_matches(lower(l_returnflag), 'n|a') THEN CAST(l_suppkey AS VARCHAR) END, ',' ORDER BY CASE WHEN NOT regexp_matches(lower(l_returnflag), 'n|a') THEN CAST(l_suppkey AS VARCHAR) END), '') AS missing, count(*) = count(*) FILTER (regexp_matches(lower(l_returnflag), 'n|a')) AS complete FROM lineitem GROUP BY l_orderkey")
def heir_gate(spark, d):
    """J6 in its table form: an order is complete if every line is accounted for by its flag."""
    return parse.all_accounted(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_returnflag", ("n", "a"))


# ---- smaller filters ---------------------------------------------------------------------
@query(f"WITH {_REG} SELECT doc_id, seq, survey_no, regexp_matches(survey_no, '^[1-9][0-9]{{0,4}}(?:/[0-9A-Z]+)*$') AND NOT regexp_matches(survey_no, '^(?:0|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|[0-9]{{1,2}}/(?:19|20)[0-9]{{2}})$') AS plausible FROM reg WHERE survey_no IS NOT NULL")
def survey_candidates(spark, d):
    return _reg(spark, d).filter("survey_no IS NOT NULL").select("doc_id", "seq", "survey_no", predicates.plausible_survey(F.col("survey_no")).alias("plausible"))


@query("SELECT DISTINCT doc_id, requested_extent, NOT (coalesce(try_cast(regexp_extract(lower(requested_extent), '([0-9]+)(?:[.][0-9]+)? *(?:grounds?|grds?|கிரவுண்ட்)', 1) AS INTEGER) >= 100, FALSE) AND NOT regexp_matches(lower(requested_extent), 'sq[.]? ?ft|sft')) AS plausible FROM ec_header")
def extent_noise(spark, d):
    e = F.col("requested_extent")
    return table(spark, d, "ec_header").select("doc_id", e, predicates.plausible_extent(e).alias("plausible")).distinct()


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'survey')) AS INTEGER) AS hits FROM documents WHERE len(regexp_extract_all(lower(text), 'survey')) > 0")
def word_hits(spark, d):
    return predicates.word_hits(table(spark, d, "documents"), "doc_id", "text", "survey")


@query(f"WITH {_PROFILES} SELECT doc_id, party_key, party, owner_group, institution FROM groups WHERE owner_group = 'current' AND contains(lower(concat_ws(' ', doc_id, party)), 'mani')")
def owner_directory(spark, d):
    groups = register.owner_groups(register.party_profiles(register.parties(_reg(spark, d))))
    return predicates.directory(groups, "mani", ["doc_id", "party"], "owner_group", "current")


@query(f"WITH {_LINES} SELECT page_id, CAST(line_no AS INTEGER) AS line_no, CASE WHEN length(line) > 60 THEN concat(left(line, 57), '...') ELSE line END AS line FROM lines WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]')")
def lines_kept(spark, d):
    rows = predicates.kept_lines(documents.lines(table(spark, d, "ec"), "page_id", "content"), "line")
    return rows.select("page_id", "line_no", predicates.shortened(F.col("line"), 60).alias("line"))


@query(f"WITH {_HEAD}, b AS ({_ENVELOPE}) SELECT doc_id, field, value FROM b WHERE field NOT IN ('form_type', 'application_no')")
def fields_kept(spark, d):
    return predicates.kept_fields(field_envelope(spark, d), ("form_type", "application_no")).select("doc_id", "field", "value")


@query("SELECT place_id, CASE WHEN place_name IS NOT NULL AND name_ta IS NOT NULL THEN concat(place_name, ' (', name_ta, ')') ELSE coalesce(place_name, name_ta) END AS both, coalesce(name_ta, place_name) AS tamil FROM place_ref")
def places_by_language(spark, d):
    en, ta = F.col("place_name"), F.col("name_ta")
    return table(spark, d, "place_ref").select("place_id", predicates.by_language(en, ta, "both").alias("both"), predicates.by_language(en, ta, "ta").alias("tamil"))
