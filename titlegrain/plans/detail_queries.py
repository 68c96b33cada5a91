"""Queries of the smaller operators, of categories and of Tamil texts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.functions import tamil as T
from titlegrain.operators import categories, crosscheck, details, display, documents, fields, geometry, parse, register
from titlegrain.plans.core_queries import _BOXES, _ENVELOPE, _HEAD, _LINES, _LOANS, _PARTIES, _REFS, _REG, _boxes, _has, _holder_sql, _kind, _nn, _reg, _rx, field_envelope, query
from titlegrain.session import table


# ---- lists and references ------------------------------------------------------------------
@query(f"WITH {_HEAD} SELECT doc_id, district, (SELECT min(place_id) FROM place_ref WHERE place_kind = 'district' AND lower(trim(place_name)) = lower(trim(head.district))) AS place_id FROM head")
def district_codes(spark, d):
    codes = table(spark, d, "place_ref").filter("place_kind = 'district'").select(F.col("place_name").alias("district"), "place_id")
    return details.coded(crosscheck.latest_header(table(spark, d, "ec_header")).select("doc_id", "district"), ["district"], codes, "place_id")


_NAMES = f"{_PARTIES}, v AS (SELECT DISTINCT lower(party) AS value FROM parties WHERE entity IN ('bank', 'company') AND trim(party) <> ''), k AS (SELECT DISTINCT lower(party) AS name FROM parties WHERE entity = 'bank' AND regexp_matches(party, '^[A-Z][A-Za-z ]+ Limited$'))"


@query(f"WITH {_NAMES} SELECT value, name AS institution, 100 AS confidence FROM v JOIN k ON contains(value, name) OR contains(name, value) QUALIFY row_number() OVER (PARTITION BY value ORDER BY length(name) DESC, name) = 1")
def known_institutions(spark, d):
    rows = register.parties(_reg(spark, d))
    known = rows.filter((F.col("entity") == "bank") & F.col("party").rlike("^[A-Z][A-Za-z ]+ Limited$"))
    return details.known_institutions(rows.filter(F.col("entity").isin("bank", "company")), "party", known, "party")


@query(f"WITH {_REG}, r AS (SELECT doc_id, seq, unnest({_REFS}) AS ref FROM reg), x AS (SELECT DISTINCT doc_id, doc_no FROM reg WHERE {_kind('attorney')}) SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = r.doc_id AND x.doc_no = r.ref)")
def references_kept(spark, d):
    return details.references_kept(_reg(spark, d)).select("doc_id", "seq", "ref")


_POA = ["power of attorney", "power agent", "poa", "பொது அதிகார", "முகவர்"]


@query(f"WITH {_REG}, t AS (SELECT doc_id, seq, array_to_string(list_filter([{', '.join(f'''CASE WHEN {_has(c, _POA)} THEN '{c}' END''' for c in ('nature', 'executants', 'claimants'))}], lambda x: x IS NOT NULL), ',') AS places FROM reg) SELECT * FROM t WHERE places <> ''")
def attorney_entries(spark, d):
    return details.attorney_entries(_reg(spark, d))


@query(rf"WITH {_REG}, f AS (SELECT doc_id, seq, regexp_extract_all(concat_ws(' ', pr_numbers, remarks), '([0-9]{{1,6}}/[0-9]{{2,4}})\b', 1) AS r FROM reg), u AS (SELECT doc_id, seq, unnest(r) AS ref, unnest(range(len(r))) AS i FROM f WHERE len(r) > 0) SELECT doc_id, seq, ref FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, seq ORDER BY length(ref) DESC, i) = 1")
def longest_reference(spark, d):
    return details.longest_reference(_reg(spark, d))


@query("SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity * 5 > 240 AND l_tax * 400 < 32) OR (l_quantity * 5 > 215 AND l_tax * 400 < 26) OR (l_quantity * 5 > 185 AND l_tax * 400 < 14) AS blank FROM lineitem")
def blank_pages(spark, d):
    """F14 with line items standing for page statistics (their quantity and tax for the grey values)."""
    blank = details.blank_page(F.col("l_quantity") * 5, F.col("l_tax") * 400)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", blank.alias("blank")).distinct()


@query(
    rf"""WITH {_LINES}, g AS (SELECT *, regexp_matches(line, '^\s*[0-9]+[.)\s-]') AS b FROM lines), h AS (SELECT *, CASE WHEN b THEN regexp_extract(line, '^\s*([0-9]+)', 1) END AS number, CASE WHEN b THEN trim(regexp_replace(line, '^\s*[0-9]+[.)\s-]+', ''), ' ') ELSE trim(line, ' ') END AS rest, sum(b::INT) OVER (PARTITION BY page_id ORDER BY line_no) AS grp FROM g)
 SELECT page_id, CAST(grp AS BIGINT) AS grp, max(number) AS number, CAST(min(line_no) AS INTEGER) AS first_line, coalesce(string_agg(rest, ' ' ORDER BY line_no) FILTER (rest <> ''), '') AS text FROM h GROUP BY page_id, grp"""
)
def numbered_groups(spark, d):
    return details.numbered_groups(documents.lines(table(spark, d, "ec"), "page_id", "content"), "page_id", "line_no", "line")


_WORDY = r"\b([0-9]{1,2})\s*(?:st|nd|rd|th)?\s+(?:day\s+of\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?,?\s+([0-9]{4})\b"


@query(rf"WITH w AS (SELECT doc_id, regexp_extract(text, '(?i){_WORDY}', ['d', 'm', 'y']) AS p FROM documents WHERE regexp_matches(text, '(?i){_WORDY}')) SELECT doc_id, CAST(CAST(try_strptime(concat(p.d, '-', p.m, '-', p.y), '%d-%b-%Y') AS DATE) AS VARCHAR) AS day FROM w")
def dates_in_words(spark, d):
    found = table(spark, d, "documents").filter(F.col("text").rlike(f"(?i){_WORDY}"))
    return found.select("doc_id", details.date_in_words(F.col("text")).cast("string").alias("day"))


_BUILT = [("காலிமனை", "vacant"), ("vacant", "vacant"), ("கட்டியுள்ள வீடு", "house"), ("கட்டிடம்", "building"), ("building", "building"), ("அடுக்குமாடி", "flat"), ("apartment", "flat"), ("வணிக", "commercial"), ("வீட்டுமனை", "house site"), ("house site", "house site"), ("தொழிற்சாலை", "industrial")]
_SAID = "concat_ws(' ', remarks, extent)"


def _structures(c: str) -> str:
    hits = ", ".join(f"CASE WHEN contains(lower(coalesce({c}, '')), '{w}') THEN '{k}' END" for w, k in _BUILT)
    f = f"list_filter([{hits}], lambda x: x IS NOT NULL)"
    return f"array_to_string(list_filter({f}, lambda x, i: list_position({f}, x) = i), ',')"


@query(rf"WITH {_REG} SELECT doc_id, seq, nullif(regexp_extract({_SAID}, '(?i)([0-9]+/[0-9]+)(?:th)?\s*(?:UDS|undivided|share|பிரிபடாத\s*பாகம்|பாகம்)', 1), '') AS share, {_has(_SAID, ['uds', 'undivided share', 'பிரிக்கப்படாத', 'பிரிபடாத'])} AS undivided, {_structures(_SAID)} AS structures FROM reg")
def undivided_shares(spark, d):
    said = F.concat_ws(" ", "remarks", "extent")
    return _reg(spark, d).select("doc_id", "seq", details.share_fraction(said).alias("share"), details.is_undivided(said).alias("undivided"), details.structures(said).alias("structures"))


@query(f"WITH {_BOXES} SELECT page, id, round(x0 / 3, 2) AS x0, round(x1 / 3, 2) AS x1, round(y0 / 7, 2) AS y0, round(y1 / 7, 2) AS y1 FROM boxes")
def boxes_rounded(spark, d):
    b = _boxes(spark, d)
    return details.rounded_boxes(b.select("page", "id", *[(F.col(c) / 3).alias(c) for c in ("x0", "x1")], *[(F.col(c) / 7).alias(c) for c in ("y0", "y1")]))


@query(
    f"""WITH {_REG}, {_HEAD}, s AS (SELECT doc_id, boundaries AS v, min(seq) AS f FROM reg WHERE boundaries IS NOT NULL GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY f, v) AS k FROM s),
 l AS (SELECT doc_id, string_agg(v, ' | ' ORDER BY k) AS listed FROM r WHERE k <= 5 GROUP BY doc_id) SELECT coalesce(head.doc_id, l.doc_id) AS doc_id, coalesce({_nn('requested_boundaries')}, listed, '') AS boundaries FROM head FULL JOIN l ON head.doc_id = l.doc_id"""
)
def boundaries_known(spark, d):
    found = details.known_boundaries(_reg(spark, d), crosscheck.latest_header(table(spark, d, "ec_header")))
    return found.select("doc_id", F.array_join("boundaries", " | ").alias("boundaries"))


@query(f"WITH {_PARTIES} SELECT doc_id, seq, side, ordinal, party FROM parties QUALIFY row_number() OVER (PARTITION BY doc_id, seq, side, lower(party) ORDER BY ordinal) = 1")
def parties_once(spark, d):
    return details.parties_once(register.parties(_reg(spark, d)))


@query(f"WITH {_PARTIES}, e AS (SELECT DISTINCT doc_id, seq, party_key FROM parties WHERE side = 'executant' AND party_key <> ''), c AS (SELECT DISTINCT doc_id, seq, party_key FROM parties WHERE side = 'claimant' AND party_key <> '') SELECT doc_id, seq, CAST(count(*) AS INTEGER) AS n FROM e JOIN c USING (doc_id, seq, party_key) GROUP BY doc_id, seq")
def on_both_sides(spark, d):
    return details.on_both_sides(_reg(spark, d))


_BARE_PARTY = r"regexp_replace(regexp_replace(regexp_replace(party, '(?i)(?:,\s*|\s+)(?:aged\s+(?:about\s+)?[0-9a-z ]+|(?:all\s+)?residing(?:\s+at)?|r/o)\b.*$', '', 'g'), '(?i),?\s*\b(?:door\s*no|flat\s*no|old\s*door|new\s*door|plot\s*no|no)\b\.?\s*[0-9].*$', '', 'g'), '[\s,]+$', '', 'g')"


@query(f"WITH {_PARTIES} SELECT doc_id, seq, side, ordinal, {_BARE_PARTY} AS party FROM parties")
def parties_without_address(spark, d):
    return register.parties(_reg(spark, d)).select("doc_id", "seq", "side", "ordinal", details.without_address(F.col("party")).alias("party"))


# ---- fields and reports ----------------------------------------------------------------------
_TITLE = "array_to_string(list_transform(string_split(replace(field, '_', ' '), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')"


@query(f"WITH {_HEAD}, b AS ({_ENVELOPE}) SELECT doc_id, {_TITLE} AS title, coalesce(value, 'Not Detected') AS value, CAST(round(confidence * 100) AS INTEGER) AS percent, round(confidence * 100) < 60 AS review FROM b WHERE field <> 'form_type'")
def report_rows(spark, d):
    return details.report_table(field_envelope(spark, d), "doc_id", ("form_type",))


@query(f"WITH {_HEAD}, b AS ({_ENVELOPE}) SELECT doc_id, field, coalesce(value, 'Not Detected') AS value, confidence FROM b UNION ALL SELECT doc_id, unnest(['period.from', 'period.to']), unnest([coalesce(CAST(search_period_from AS VARCHAR), '-'), coalesce(CAST(search_period_to AS VARCHAR), '-')]), 1.0::DOUBLE FROM head")
def key_value_rows(spark, d):
    own = field_envelope(spark, d).withColumn("parts", F.lit(None).cast("map<string,string>"))
    day = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    period = crosscheck.latest_header(table(spark, d, "ec_header")).select("doc_id", F.lit("period").alias("field"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("confidence"), F.create_map(F.lit("from"), day("search_period_from"), F.lit("to"), day("search_period_to")).alias("parts"))
    return details.key_value_table(own.unionByName(period), "doc_id", "parts")


_KINDS = {"conveyances": "conveyance", "mortgage_deeds": "mortgage", "discharge_deeds": "discharge", "court_entries": "court", "rectifications": "rectification", "leases": "lease", "family_deeds": "family", "attorney_deeds": "attorney"}
_TOLD = ["sro", "certificate_no", "application_no", "applicant_name", "village", "zone", "district", "survey_details", "requested_extent", "requested_door_no", "requested_boundaries", "form_type"]
_SUMMARY = (
    [(c, _nn(c)) for c in _TOLD]
    + [(c, f"CAST({c} AS VARCHAR)") for c in ("certificate_date", "data_available_from", "data_available_to", "search_period_from", "search_period_to", "first_date", "last_date")]
    + [(c, f"CAST(coalesce({c}, 0) AS VARCHAR)") for c in ("entries", *_KINDS, "surveys", "places", "gaps", "missing_serials", "open_loans", "closed_loans")]
    + [(c, f"CAST({c} AS VARCHAR)") for c in ("total_entries_declared", "observed_years", "consideration_total", "market_value_most", "current_owner", "owner_document", "owner_role", "last_document", "last_nature")]
    + [("period_status", "CASE WHEN search_period_from IS NULL OR search_period_to IS NULL THEN 'unspecified' WHEN date_diff('day', search_period_from, search_period_to) / 365.25 < 30 THEN 'short' ELSE 'full' END"), ("undivided", "CASE WHEN undivided THEN 'true' ELSE 'false' END")]
)


@query(
    f"""WITH {_LOANS}, {_HEAD}, own AS ({_holder_sql('doc_id').replace(f'WITH {_REG}, g AS', 'WITH g AS')}),
 c AS (SELECT doc_id, count(*) AS entries, {', '.join(f'count(*) FILTER ({_kind(k)}) AS {n}' for n, k in _KINDS.items())}, count(DISTINCT survey_no) AS surveys, count(DISTINCT village_street) AS places, sum(consideration_amt) AS consideration_total, max(market_value_amt) AS market_value_most,
   arg_max(row(doc_no), seq)[1] AS last_document, arg_max(row(nature), seq)[1] AS last_nature, bool_or({_has('remarks', ['uds', 'undivided share'])}) AS undivided FROM reg GROUP BY doc_id),
 s AS (SELECT DISTINCT doc_id, sr FROM reg WHERE sr IS NOT NULL), gg AS (SELECT doc_id, lead(sr) OVER (PARTITION BY doc_id ORDER BY sr) - sr - 1 AS m FROM s), g AS (SELECT doc_id, count(*) AS gaps, sum(m) AS missing_serials FROM gg WHERE m > 0 GROUP BY doc_id),
 e AS (SELECT doc_id, arg_min(registration_date, seq) AS first_date, arg_max(registration_date, seq) AS last_date FROM reg WHERE registration_date IS NOT NULL GROUP BY doc_id), l AS (SELECT doc_id, count(*) - count(discharge_seq) AS open_loans, count(discharge_seq) AS closed_loans FROM loans GROUP BY doc_id),
 o AS (SELECT doc_id, holder AS current_owner, doc_no AS owner_document, role AS owner_role FROM own),
 w AS (SELECT head.*, c.* EXCLUDE (doc_id), g.* EXCLUDE (doc_id), e.* EXCLUDE (doc_id), abs(year(last_date) - year(first_date)) + 1 AS observed_years, l.* EXCLUDE (doc_id), o.* EXCLUDE (doc_id) FROM head LEFT JOIN c USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN o USING (doc_id))
 {' UNION ALL '.join(f"SELECT doc_id, '{n}' AS field, {v} AS value FROM w" for n, v in _SUMMARY)}"""
)
def ec_summary(spark, d):
    reg = _reg(spark, d)
    return details.summary_fields(reg, crosscheck.latest_header(table(spark, d, "ec_header")), register.observed_span(reg), register.serial_gaps(reg), register.loan_status(reg), register.holder(reg))


@query(f"WITH {_HEAD}, b AS ({_ENVELOPE}), o AS (SELECT doc_id, 'village' AS field, concat(doc_id, ' village') AS edit FROM head UNION ALL SELECT doc_id, 'new_note_', 'seen' FROM head) SELECT coalesce(b.doc_id, o.doc_id) AS doc_id, coalesce(b.field, o.field) AS field, coalesce(edit, value) AS value, CASE WHEN edit IS NOT NULL THEN 1.0::DOUBLE ELSE confidence END AS confidence, edit IS NOT NULL AS edited FROM b FULL JOIN o ON b.doc_id = o.doc_id AND b.field = o.field")
def fields_edited(spark, d):
    """The village of every certificate is edited, and a new field added."""
    head = crosscheck.latest_header(table(spark, d, "ec_header"))
    edits = head.select("doc_id", F.inline(F.array(F.struct(F.lit("village").alias("field"), F.concat("doc_id", F.lit(" village")).alias("value")), F.struct(F.lit("New note!").alias("field"), F.lit("seen").alias("value")))))
    return fields.override(field_envelope(spark, d), edits, "doc_id")


@query(f"WITH {_HEAD}, b AS ({_ENVELOPE}), m AS (SELECT doc_id, CASE WHEN field IN ('sro', 'zone') THEN 'office' ELSE field END AS field, value, confidence, CASE field WHEN 'sro' THEN 1 WHEN 'zone' THEN 2 ELSE 0 END AS r FROM b WHERE value IS NOT NULL) SELECT doc_id, field, arg_min(value, r) AS value, arg_min(confidence, r) AS confidence FROM m GROUP BY doc_id, field")
def fields_aliased(spark, d):
    """The office under either of two names, the first known wins."""
    return fields.aliased(field_envelope(spark, d), "doc_id", {"sro": "office", "zone": "office"})


_MONEY_TEXT = r"coalesce(regexp_matches(pr, '(?i)rs\.?\s*[0-9]|[0-9],[0-9]{3}'), FALSE)"


@query(f"WITH {_REG}, x AS (SELECT doc_id, seq, nullif(consideration, '') AS c, coalesce(CASE WHEN seq % 3 = 0 THEN market_value END, pr_numbers) AS pr FROM reg) SELECT doc_id, seq, CASE WHEN {_MONEY_TEXT} THEN coalesce(c, pr) ELSE c END AS consideration, CASE WHEN NOT {_MONEY_TEXT} THEN pr END AS pr_numbers FROM x")
def money_moved(spark, d):
    """P10: in every third entry the market value stands in the references' column."""
    reg = _reg(spark, d).withColumn("pr_numbers", F.coalesce(F.when(F.col("seq") % 3 == 0, F.col("market_value")), F.col("pr_numbers")))
    return display.repair_money(reg).select("doc_id", "seq", "consideration", "pr_numbers")


@query(f"WITH {_LINES}, n AS (SELECT page_id, line_no, nullif(regexp_extract(line, '([0-9]{{1,5}}/[0-9]{{4}})', 1), '') AS doc FROM lines) SELECT page_id, CAST(line_no AS INTEGER) AS line_no, doc, last_value(doc IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS doc_filled FROM n")
def documents_filled(spark, d):
    """The document last named, on every line of a page."""
    rows = documents.lines(table(spark, d, "ec"), "page_id", "content").select("page_id", "line_no", F.nullif(F.regexp_extract("line", "([0-9]{1,5}/[0-9]{4})", 1), F.lit("")).alias("doc"))
    return documents.filled(rows, "page_id", "line_no", "doc")


@query(r"WITH t AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number DESC, page_id DESC) AS r, try_cast(nullif(regexp_extract(content, '(?i)(?:number of entries|no\.? of entries|பதிவுகளின் எண்ணிக்கை)[^0-9\n]*([0-9]+)', 1), '') AS INTEGER) AS total FROM ec) SELECT doc_id, arg_max(total, page_number) AS total FROM t WHERE r <= 3 AND total IS NOT NULL GROUP BY doc_id")
def declared_totals(spark, d):
    return parse.declared_total(table(spark, d, "ec"))


@query(f"WITH {_PARTIES} SELECT doc_id, seq, side, ordinal, array_to_string(list_transform(string_split({_rx('party', r'\s+', ' ')}, ' '), lambda w: CASE WHEN length(w) <= 3 AND upper(w) = w THEN w ELSE concat(upper(w[1]), lower(w[2:])) END), ' ') AS name FROM parties")
def names_titled(spark, d):
    return register.parties(_reg(spark, d)).select("doc_id", "seq", "side", "ordinal", display.title_name(F.col("party")).alias("name"))


@query(f"WITH {_REG} SELECT doc_id, seq, CASE WHEN length(y) = 4 THEN y::INT WHEN y::INT > 25 THEN y::INT + 1900 ELSE y::INT + 2000 END AS year FROM (SELECT doc_id, seq, unnest(list_distinct(regexp_extract_all(concat_ws(' ', pr_numbers, remarks), '[0-9]{{1,6}}/([0-9]{{4}}|[0-9]{{2}})\\b', 1))) AS y FROM reg)")
def reference_years(spark, d):
    text = F.concat_ws(" ", "pr_numbers", "remarks")
    years = F.array_distinct(F.regexp_extract_all(text, F.lit(r"[0-9]{1,6}/([0-9]{4}|[0-9]{2})\b"), F.lit(1)))
    return _reg(spark, d).select("doc_id", "seq", F.explode(years).alias("y")).select("doc_id", "seq", S.full_year(F.col("y")).alias("year"))


@query(
    f"""WITH {_BOXES}, w AS (SELECT page, id, x0, x1, y0, y1 FROM boxes WHERE id % 2 = 1), l AS (SELECT page, id AS line_no, x0, x1 + 40 AS x1, y0, y1 + 10 AS y1 FROM boxes WHERE id % 2 = 0)
 SELECT w.page, w.id AS word_no, min(l.line_no) AS line_no FROM w JOIN l ON l.page = w.page AND floor((w.y0 + w.y1) / 2) BETWEEN floor(l.y0 - 3) AND floor(l.y1 + 3) AND w.x0 >= l.x0 - 3 AND w.x1 <= l.x1 + 3 GROUP BY w.page, w.id"""
)
def words_in_lines(spark, d):
    b = _boxes(spark, d)
    lines = b.filter("id % 2 = 0").select("page", F.col("id").alias("line_no"), "x0", (F.col("x1") + 40).alias("x1"), "y0", (F.col("y1") + 10).alias("y1"))
    return geometry.words_in_lines(b.filter("id % 2 = 1").select("page", F.col("id").alias("word_no"), "x0", "x1", "y0", "y1"), lines, "page")


# ---- categories ------------------------------------------------------------------------------
_HITS = {
    "sale_deed": [(6, ["sale deed", "absolute sale", "கிரையப் பத்திரம்", "கிரயப்", "vendor", "purchaser", "conveyance"]), (3, ["schedule of property", "undivided share", "uds"])],
    "patta": [(15, ["பட்டா", "சிட்டா", "patta", "chitta", "pattadhar", "10(1)", "நில உரிமை"])],
    "parent_docs": [(7, ["parent doc", "mother document", "chain of title", "முந்தைய ஆவணம்", "தாய் பத்திரம்", "prior deed"])],
    "ec": [(8, ["encumbrance certificate", "வில்லங்கச் சான்றிதழ்", "form no. 15", "form no. 16", "nil encumbrance"])],
    "building_plan": [(7, ["planning permit", "building sanction", "plinth area", "fsi", "setback", "கட்டிட வரைபடம்"])],
    "rera": [(8, ["tnrera", "rera", "real estate regulatory authority", "form ''c''"])],
    "tax_eb": [(7, ["property tax", "tangedco", "electricity board", "consumer no", "வரி விதிப்பு", "cmwssb"])],
    "layout_approval": [(7, ["ppd/lo", "approved layout", "open space reservation", "osr", "மனைப்பிரிவு"])],
    "death_legal_heir": [(8, ["legal heir", "varisu", "death certificate", "வாரிசுச் சான்றிதழ்", "இறப்புச் சான்றிதழ்"])],
    "loan_docs": [(7, ["memorandum of deposit", "modt", "mortgage", "housing loan", "loan account", "title deeds deposited"])],
    "tslr": [(15, ["tslr", "town survey", "ward + block", "land classification", "tenure type", "ryotwari", "o.sur no", "நகர நில அளவை", "நகர சர்வே", "are(s)", "extract from the town survey", "urb/"])],
}
_SCORED = {n: " + ".join(f"({' OR '.join(f'''contains(lower(text), '{w}')''' for w in words)})::INT * {k}" for k, words in groups) for n, groups in _HITS.items()}
_DETECTED = f"z AS (SELECT doc_id, text, {', '.join(f'{v} AS s_{n}' for n, v in _SCORED.items())} FROM documents WHERE text IS NOT NULL), det AS (SELECT doc_id, text, greatest({', '.join(f's_{n}' for n in _HITS)}) AS score, CASE {' '.join(f'''WHEN s_{n} > 0 AND s_{n} = greatest({', '.join(f's_{m}' for m in _HITS)}) THEN '{n}' ''' for n in _HITS)} ELSE 'sale_deed' END AS category FROM z)"


@query(f"WITH {_DETECTED} SELECT doc_id, category, score FROM det")
def category_detect(spark, d):
    return categories.detect(table(spark, d, "documents"), "doc_id", "text")


@query(f"WITH {_DETECTED}, c AS (SELECT unnest([{', '.join(f'''{{'category': '{n}', 'title': '{t}', 'rank': {i + 1}}}''' for i, (n, t, _) in enumerate(categories.CATEGORIES))}], recursive := TRUE)), k AS (SELECT category, count(*) AS texts FROM det GROUP BY category) SELECT category, title, CAST(rank AS INTEGER) AS rank, coalesce(texts, 0) AS texts FROM c LEFT JOIN k USING (category)")
def category_counts(spark, d):
    return categories.counted(categories.detect(table(spark, d, "documents"), "doc_id", "text"))


def _extracted_sql() -> str:
    parts = []
    for name, rules in categories.RULES.items():
        by: dict[str, list] = {}
        for r in sorted(rules, key=lambda r: r.rank):
            by.setdefault(r.field, []).append(r)
        for field, own in by.items():
            hits = ["nullif(trim(regexp_extract(text, '" + r.pattern.replace("'", "''") + "', 1), ' '), '')" for r in own]
            sure = " ".join(f"WHEN {h} IS NOT NULL THEN {r.confidence}::DOUBLE" for h, r in zip(hits, own))
            parts.append(f"SELECT doc_id, category, '{field}' AS field, coalesce({', '.join(hits)}) AS value, CASE {sure} ELSE 0.0::DOUBLE END AS confidence FROM det WHERE category = '{name}'")
    return f"WITH {_DETECTED} " + " UNION ALL ".join(parts)


@query(_extracted_sql())
def category_fields(spark, d):
    return categories.extract(table(spark, d, "documents"), "doc_id", "text")


# ---- Tamil and English -------------------------------------------------------------------------
_BEFORE = "(^|[^க-ஹ])"
_TWICE = lambda c, p, to: _rx(_rx(c, p, to), p, to)  # noqa: E731  (matches may touch)
_ORDERED = _rx(_TWICE(_TWICE(_TWICE("v", _BEFORE + "ெ([க-ஹ])ா", r"\1\2ொ"), _BEFORE + "ே([க-ஹ])ா", r"\1\2ோ"), _BEFORE + "([ெேை])([க-ஹ])", r"\1\3\2"), "([க-ஹ])்([ா-ௌ])", r"\1\2்")


@query(f"WITH {_REG}, t AS (SELECT DISTINCT unnest([nature, executants, claimants]) AS v FROM reg), s AS (SELECT v, replace(replace(v, 'ொ', 'ெ' || 'ா'), 'ை', 'ை') AS w FROM t WHERE regexp_matches(v, '[\\x{{0B80}}-\\x{{0BFF}}]')) SELECT DISTINCT v, {_ORDERED} AS ordered FROM s")
def tamil_ordered(spark, d):
    values = _reg(spark, d).select(F.explode(F.array("nature", "executants", "claimants")).alias("v")).filter(F.col("v").rlike(r"[\x{0B80}-\x{0BFF}]")).distinct()
    return values.select("v", T.logical_order(F.col("v")).alias("ordered"))


def _glossed(c: str, words: dict[str, str]) -> str:
    for w in sorted(words, key=lambda x: (-len(x), x)):
        c = f"replace({c}, '{w}', '{words[w]}')"
    return c


_DEEDS = {"கிரையப் பத்திரம்": "Sale deed", "கிரையம்": "Sale", "அடமானப் பத்திரம்": "Mortgage deed", "அடமானம்": "Mortgage", "செட்டில்மெண்ட்": "Settlement", "செட்டில்மென்ட்": "Settlement", "தானப் பத்திரம்": "Gift deed", "தானம்": "Gift", "பாகப்பிரிவினை": "Partition", "விடுதலைப் பத்திரம்": "Release deed", "விடுதலை": "Release", "ரசீது": "Receipt", "குத்தகை": "Lease", "பொது அதிகாரப் பத்திரம்": "General power of attorney", "பிழைதிருத்தல்": "Rectification", "உயில்": "Will", "நீதிமன்ற ஆணை": "Court order", "பத்திரம்": "deed"}


@query(f"WITH {_REG} SELECT DISTINCT nature, {_glossed('nature', _DEEDS)} AS english FROM reg WHERE regexp_matches(nature, '[\\x{{0B80}}-\\x{{0BFF}}]')")
def natures_in_english(spark, d):
    tamil = _reg(spark, d).select("nature").filter(F.col("nature").rlike(r"[\x{0B80}-\x{0BFF}]")).distinct()
    return tamil.select("nature", T.glossary(F.col("nature"), T.DEED_WORDS).alias("english"))


_KIN = {"மகன்": "S/o", "மகள்": "D/o", "மனைவி": "W/o", "கணவர்": "H/o", "son of": "S/o", "daughter of": "D/o", "wife of": "W/o", "husband of": "H/o", "s/o": "S/o", "d/o": "D/o", "w/o": "W/o", "h/o": "H/o"}
_KIN_RX = rf"(?i)^(.+?)[\s,]+({'|'.join(_KIN)})\.?\s+(.+)$"


@query(f"WITH {_PARTIES} SELECT doc_id, seq, side, ordinal, CASE WHEN regexp_matches(party, '{_KIN_RX}') THEN trim(regexp_extract(party, '{_KIN_RX}', 1)) ELSE party END AS name, CASE lower(regexp_extract(party, '{_KIN_RX}', 2)) {' '.join(f'''WHEN '{k}' THEN '{v}' ''' for k, v in _KIN.items())} END AS relation, nullif(trim(regexp_extract(party, '{_KIN_RX}', 3)), '') AS parent FROM (SELECT * REPLACE (trim(regexp_replace(party, '^\\s*[0-9]+[.)]\\s*', '')) AS party) FROM parties)")
def kinship(spark, d):
    return register.parties(_reg(spark, d)).select("doc_id", "seq", "side", "ordinal", T.kinship(F.col("party")).alias("k")).select("doc_id", "seq", "side", "ordinal", "k.*")


@query()
def party_records(spark, d):
    """Needs the readings of both scripts, so that there is no SQL."""
    return T.party_records(register.parties(_reg(spark, d)))


@query("WITH n AS (SELECT DISTINCT district AS v FROM ec_header WHERE district IS NOT NULL), p AS (SELECT lower(place_name) AS w, min(name_ta) AS t FROM place_ref GROUP BY 1), u AS (SELECT v, unnest(string_split(trim(regexp_replace(v, '\\s+', ' ', 'g')), ' ')) AS w, unnest(range(len(string_split(trim(regexp_replace(v, '\\s+', ' ', 'g')), ' ')))) AS i FROM n) SELECT v, string_agg(coalesce(p.t, u.w), ' ' ORDER BY i) AS translated FROM u LEFT JOIN p ON p.w = lower(u.w) GROUP BY v")
def districts_in_tamil(spark, d):
    """The words of typed districts by the dictionary of places."""
    rows = table(spark, d, "ec_header").select(F.col("district").alias("v")).filter("v IS NOT NULL").distinct()
    words = table(spark, d, "place_ref").select(F.col("place_name").alias("word"), F.col("name_ta").alias("translation"))
    return T.word_translations(rows.withColumn("t", F.col("v")), "v", "t", words)
