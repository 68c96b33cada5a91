"""Queries of the property filter and of bundles of documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titlegrain.operators import bundles, crosscheck, register, search
from titlegrain.nulls import nullify
from titlegrain.plans.core_queries import _HEAD, _LOANS, _PARTIES, _REG, _WORDS, _first_party, _kind, _name, _nn, _reg, _rx, query
from titlegrain.session import table

_SEARCH = search.Criteria(survey_no="94/14A1", flat="Flat 17", door_no="Plot 177", extent="5,000 sq.m", boundary="North Second Cross Street", owner="K. Kaviyamani")
_SURVEY_WORDS = r"\b(SURVEY|SY|TS|T\.S|NO|OLD)\b\.?"
_TEXT = "lower(concat_ws(' ', doc_no, nature, executants, claimants, remarks, pr_numbers, schedule_text))"


def _area(c: str) -> str:
    """Square feet of the first unit found, in the order of the cross-check."""
    t = f"replace(lower({c}), ',', '')"
    number = lambda unit: rf"try_cast(nullif(regexp_extract({t}, '([0-9]+(?:\.[0-9]+)?)\s*(?:{unit})', 1), '') AS DOUBLE)"
    bare = rf"try_cast(nullif(regexp_extract(trim({t}), '^([0-9]+(?:\.[0-9]+)?)$', 1), '') AS DOUBLE)"
    units = (r"sq\.?\s*ft|sq\.?\s*feet|சதுர\s*அடி", r"sq\.?\s*m|சதுர\s*மீட்டர்", "grounds?|கிரவுண்ட்", "acres?|ஏக்கர்", "cents?|சென்ட்")
    sqft, sqm, ground, acre, cent = map(number, units)
    return f"round(coalesce({sqft}, {sqm} * 10.7639::DOUBLE, {ground} * 2400, {acre} * 43560, {cent} * 435.6::DOUBLE, {bare}), 2)"


def _named(name_words: tuple[str, ...], whole: str, side: str) -> str:
    n = _name(f"coalesce({side}, '')")
    return "(" + " OR ".join(f"contains({n}, '{w}')" for w in (whole, *name_words)) + ")"


_OWNED = f"({_named(('kaviyamani',), 'k kaviyamani', 'executants')} OR {_named(('kaviyamani',), 'k kaviyamani', 'claimants')})"
_TESTS = {
    "survey": f"(contains({_rx(_rx(f'upper({_TEXT})', _SURVEY_WORDS, ''), '[^A-Z0-9/]', '')}, '94/14A1') OR contains({_TEXT}, '94/14a1'))",
    "flat": f"contains({_TEXT}, '17')",
    "door": f"contains({_TEXT}, '177')",
    "extent": f"(contains({_TEXT}, '5,000 sq.m') OR coalesce(abs({_area('remarks')} - 53819.5) / 53819.5 < 0.15, FALSE))",
    "boundary": f"(contains({_TEXT}, 'second')::INT + contains({_TEXT}, 'cross')::INT >= 2)",
    "owner": _OWNED,
}
_MATCHED = f"""{_REG}, t AS (SELECT *, {', '.join(f'{v} AS c_{k}' for k, v in _TESTS.items())} FROM reg),
 matched AS (SELECT *, list_filter([{', '.join(f"CASE WHEN c_{k} THEN '{k}' END" for k in _TESTS)}], lambda v: v IS NOT NULL) AS reasons, NOT c_flat AND regexp_matches({_TEXT}, 'flat|apartment|unit') AS context, c_owner AS owner_match,
  ({' OR '.join(f'c_{k}' for k in _TESTS)}) AS matched FROM t),
 pool AS (SELECT * FROM matched QUALIFY matched OR count(*) FILTER (matched) OVER (PARTITION BY doc_id) = 0)"""
_CHAIN = f"chain AS (SELECT doc_id, seq, doc_no, nature, claimants AS buyer, executants AS seller, seq = max(seq) OVER (PARTITION BY doc_id) AS holds FROM pool WHERE {_kind('conveyance', rules='filter')})"
_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(m.claimants, 'Bank / Financial Institution')), '[^a-z0-9\x{0B80}-\x{0BFF}]', ' ', 'g'), ' +'), lambda w: length(w) > 1 AND w NOT IN ('bank', 'ltd', 'limited', 'of', 'india'))"
_DEBTS = f"""m AS (SELECT * FROM pool WHERE {_kind('mortgage', rules='filter')}), d AS (SELECT * FROM pool WHERE {_kind('discharge', rules='filter')}),
 loans AS (SELECT m.doc_id, m.seq, any_value(m.doc_no) AS doc_no, min(d.seq) AS discharge_seq FROM m LEFT JOIN d ON d.doc_id = m.doc_id AND (contains(concat_ws(' ', d.pr_numbers, d.remarks), m.doc_no)
  OR len(list_filter({_TOKENS}, lambda w: contains(lower(concat_ws(' ', d.claimants, d.executants)), w))) > 0) GROUP BY m.doc_id, m.seq)"""
_COURT_TEXT = "lower(concat_ws(' ', coalesce(nature, ''), coalesce(remarks, '')))"
_COURT_WORDS = [w.replace("[.]", ".") for w in _WORDS["filter"]["court"]]
_COURT = f"""court AS (SELECT doc_id, seq, doc_no, array_to_string(list_filter([{', '.join(f"'{w}'" for w in _COURT_WORDS)}], lambda w: contains({_COURT_TEXT}, w)), ',') AS words FROM pool WHERE len(list_filter([{', '.join(f"'{w}'" for w in _COURT_WORDS)}], lambda w: contains({_COURT_TEXT}, w))) > 0)"""


def _matched(spark, d) -> DataFrame:
    return search.matches(_reg(spark, d), _SEARCH)


@query(f"WITH {_MATCHED} SELECT doc_id, seq, array_to_string(reasons, ',') AS reasons, context, owner_match, matched FROM matched")
def property_filter(spark, d):
    return _matched(spark, d).select("doc_id", "seq", F.array_join("reasons", ",").alias("reasons"), "context", "owner_match", "matched")


@query(f"WITH {_MATCHED}, {_CHAIN} SELECT * FROM chain")
def filter_chain(spark, d):
    return search.chain(search.pool(_matched(spark, d)))


@query(f"WITH {_MATCHED}, {_DEBTS} SELECT * FROM loans")
def filter_loans(spark, d):
    return search.loans(search.pool(_matched(spark, d)))


@query(f"WITH {_MATCHED}, {_COURT} SELECT * FROM court")
def filter_court(spark, d):
    return search.court(search.pool(_matched(spark, d)))


@query(
    f"""WITH {_MATCHED}, {_CHAIN}, {_DEBTS}, {_COURT}, n AS (SELECT doc_id, count(*) AS entries, count(*) FILTER (matched) AS matched FROM matched GROUP BY doc_id),
 l AS (SELECT doc_id, count(*) AS loans, count(discharge_seq) AS closed FROM loans GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS court_entries FROM court GROUP BY doc_id), h AS (SELECT doc_id, buyer AS holder FROM chain WHERE holds)
 SELECT doc_id, entries, matched, entries - matched AS unmatched, round((matched * 100.0 / entries)::DOUBLE, 1) AS matched_pct, holder, coalesce(loans, 0) AS loans, coalesce(closed, 0) AS closed, coalesce(loans, 0) - coalesce(closed, 0) AS open, coalesce(court_entries, 0) AS court_entries
 FROM n LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN h USING (doc_id)"""
)
def filter_summary(spark, d):
    return search.summary(_reg(spark, d), _SEARCH)


@query(
    f"""WITH {_REG}, r AS (SELECT doc_id, seq, doc_no, {_name("coalesce(claimants, '')")} AS c, {_name("coalesce(executants, '')")} AS e FROM reg),
 x AS (SELECT doc_id, seq, doc_no, CASE WHEN contains(c, 'kaviya mani') THEN 'claimant' WHEN contains(e, 'kaviya mani') THEN 'executant' WHEN contains(c, 'kaviya') OR contains(c, 'mani') THEN 'claimant, in part' WHEN contains(e, 'kaviya') OR contains(e, 'mani') THEN 'executant, in part' END AS role FROM r)
 SELECT doc_id, seq, doc_no, role FROM x WHERE role IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1"""
)
def related_entry(spark, d):
    return search.related(_reg(spark, d), "Kaviya Mani")


# ---- bundles: each certificate stands for a bundle of documents ------------------------------
def _bundle(spark, d) -> DataFrame:
    """Long form: the last conveyance as the sale deed, the header as the revenue record, the
    register as the certificate."""
    reg = _reg(spark, d)
    deed = reg.filter(register.is_kind("conveyance")).groupBy("doc_id").agg(F.max_by(F.struct("executants", "survey_no", "extent"), "seq").alias("x"))
    head = crosscheck.latest_header(table(spark, d, "ec_header"))
    open_ = register.loan_status(reg).select("doc_id", F.when(F.col("court_cases") > 0, "court attachment").when(F.col("open") > 0, "active mortgage").otherwise("nil").alias("value"))
    twice = crosscheck.double_sales(reg).groupBy("doc_id").agg(F.count("*").cast("string").alias("value"))
    cell = lambda role, key, value: F.struct(F.lit(role).alias("doc_role"), F.lit(key).alias("key"), value.alias("value"))
    sale = deed.select(F.col("doc_id").alias("bundle_id"), F.inline(F.array(cell("sale_deed", "vendor_details", F.col("x.executants")), cell("sale_deed", "survey_number", F.col("x.survey_no")), cell("sale_deed", "land_extent", F.col("x.extent")))))
    revenue = head.select(F.col("doc_id").alias("bundle_id"), F.inline(F.array(cell("patta", "owner_name", nullify(F.col("applicant_name"))), cell("patta", "survey_numbers", nullify(F.col("survey_details"))), cell("patta", "extent_details", nullify(F.col("requested_extent"))), cell("ec", "form_type", F.col("form_type")))))
    ec = open_.select(F.col("doc_id").alias("bundle_id"), F.lit("ec").alias("doc_role"), F.lit("status").alias("key"), "value")
    sold = head.select("doc_id").join(twice, "doc_id", "left").select(F.col("doc_id").alias("bundle_id"), F.lit("ec").alias("doc_role"), F.lit("double_sales").alias("key"), F.coalesce("value", F.lit("0")).alias("value"))
    return sale.unionByName(revenue).unionByName(ec).unionByName(sold)


def _tell(test: str, known: str) -> str:
    return f"CASE WHEN {known} THEN CASE WHEN {test} THEN 'pass' ELSE 'fail' END ELSE 'unknown' END"


_SV = lambda c: _rx(_rx(f"upper({c})", _SURVEY_WORDS, ""), "[^A-Z0-9/]", "")
_BUNDLES = f"""{_LOANS}, {_HEAD}, deed AS (SELECT doc_id, executants AS seller, survey_no AS sv, extent AS ex FROM reg WHERE {_kind('conveyance')} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) = 1),
 st AS (SELECT reg.doc_id, CASE WHEN count(*) FILTER ({_kind('court')}) > 0 THEN 'fail' WHEN (SELECT count(*) FROM loans WHERE loans.doc_id = reg.doc_id AND discharge_seq IS NULL) > 0 THEN 'fail' ELSE 'pass' END AS status FROM reg GROUP BY reg.doc_id),
 ds AS (SELECT doc_id, survey_no, seq, 1 AS sold, {_first_party('executants')} AS party FROM reg WHERE regexp_matches(lower(nature), 'sale deed|conveyance|கிரைய') AND survey_no IS NOT NULL AND executants IS NOT NULL AND claimants IS NOT NULL
  UNION ALL SELECT doc_id, survey_no, seq, 0, {_first_party('claimants')} FROM reg WHERE regexp_matches(lower(nature), 'sale deed|conveyance|கிரைய') AND survey_no IS NOT NULL AND executants IS NOT NULL AND claimants IS NOT NULL),
 tw AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, sold, lag(sold) OVER (PARTITION BY doc_id, survey_no, party ORDER BY seq, sold) AS before FROM ds) WHERE sold = 1 AND before = 1),
 ids AS (SELECT doc_id FROM head UNION SELECT doc_id FROM reg),
 b AS (SELECT ids.doc_id AS bundle_id, {_name('seller')} AS seller, {_name(_nn('applicant_name'))} AS owner, {_SV('sv')} AS sv, {_SV(_nn('survey_details'))} AS rv, {_area('ex')} AS ea, {_area(_nn('requested_extent'))} AS ra, st.status, head.doc_id IS NOT NULL AS headed, tw.doc_id IS NULL AS once
  FROM ids LEFT JOIN head USING (doc_id) LEFT JOIN deed USING (doc_id) LEFT JOIN st USING (doc_id) LEFT JOIN tw USING (doc_id)),
 w AS (SELECT *, list_filter(string_split(seller, ' '), lambda w: length(w) > 2) AS sw FROM b),
 checks AS (SELECT bundle_id, 'ownership' AS check_name, {_tell('len(list_filter(sw, lambda x: contains(owner, x))) > 0', "owner <> '' AND len(sw) > 0")} AS status FROM w
  UNION ALL SELECT bundle_id, 'survey', {_tell('contains(sv, rv) OR contains(rv, sv)', "sv <> '' AND rv <> ''")} FROM w
  UNION ALL SELECT bundle_id, 'extent', {_tell('abs(ea - ra) * 100 / greatest(ea, ra) <= 5', 'ea > 0 AND ra > 0')} FROM w
  UNION ALL SELECT bundle_id, 'encumbrance', coalesce(status, CASE WHEN headed THEN 'pass' ELSE 'unknown' END) FROM w
  UNION ALL SELECT bundle_id, 'chain', 'unknown' FROM w UNION ALL SELECT bundle_id, 'land', 'unknown' FROM w
  UNION ALL SELECT bundle_id, 'double_sale', CASE WHEN NOT headed THEN 'unknown' WHEN once THEN 'pass' ELSE 'fail' END FROM w)"""


@query(f"WITH {_BUNDLES} SELECT * FROM checks")
def bundle_matrix(spark, d):
    return bundles.matrix(_bundle(spark, d))


@query(f"WITH {_BUNDLES} SELECT bundle_id, count(*) FILTER (status = 'pass') AS passed, count(*) FILTER (status = 'fail') AS red_flags, count(*) FILTER (status = 'unknown') AS unknown, CASE WHEN count(*) FILTER (status = 'fail') > 0 THEN 'action required' WHEN count(*) FILTER (status = 'pass') > 0 THEN 'pass' ELSE 'unknown' END AS overall FROM checks GROUP BY bundle_id")
def bundle_summary(spark, d):
    return bundles.matrix_overall(bundles.matrix(_bundle(spark, d)))


_FAMILY = f"fam AS (SELECT * FROM parties WHERE {_kind('family')})"


@query(
    f"""WITH {_PARTIES}, {_HEAD}, {_FAMILY}, h1 AS (SELECT doc_id AS bundle_id, lower(party) AS k, bool_or(coalesce(regexp_matches(lower(nature), 'signatory|release|poa|consented|party'), FALSE)) AS told FROM fam WHERE side = 'executant' GROUP BY 1, 2),
 hs AS (SELECT bundle_id, count(*) AS heirs, count(*) FILTER (told) AS accounted, string_agg(k, ',' ORDER BY k) FILTER (NOT told) AS missing FROM h1 GROUP BY bundle_id),
 dd AS (SELECT doc_id AS bundle_id, {_name('arg_min(party, (seq, ordinal))')} AS one, {_name('arg_max(party, (seq, ordinal))')} AS two FROM fam WHERE side = 'claimant' GROUP BY doc_id),
 pt AS (SELECT doc_id AS bundle_id, {_name(_nn('applicant_name'))} AS three, form_type FROM head)
 SELECT pt.bundle_id, CASE WHEN one IS NULL OR coalesce(three, '') = '' THEN 'unknown' WHEN one = two AND (contains(three, one) OR contains(one, three)) THEN 'pass' ELSE 'fail' END AS identity,
  coalesce(heirs, 0) AS heirs, coalesce(accounted, 0) AS accounted, coalesce(missing, '') AS missing, CASE WHEN heirs IS NULL THEN 'unknown' WHEN heirs = accounted THEN 'pass' ELSE 'fail' END AS complete,
  CASE WHEN form_type IS NULL THEN 'unknown' ELSE 'fail' END AS mutation, CASE WHEN form_type IS NOT NULL THEN 'blocked' WHEN heirs > accounted THEN 'missing heirs' ELSE 'unknown' END AS overall FROM pt LEFT JOIN hs USING (bundle_id) LEFT JOIN dd USING (bundle_id)"""
)
def inheritance_track(spark, d):
    """J6 over the register: executants of family deeds stand for the heirs (their deed's nature
    for the status), the claimants for the deceased, the form of the certificate for the mutation."""
    rows = register.parties(_reg(spark, d)).filter(register.is_kind("family"))
    head = crosscheck.latest_header(table(spark, d, "ec_header"))
    heirs = rows.filter("side = 'executant'").select(F.col("doc_id").alias("bundle_id"), F.lower("party").alias("name"), F.col("nature").alias("status"))
    ends = rows.filter("side = 'claimant'").groupBy("doc_id").agg(F.min_by("party", F.struct("seq", "ordinal")).alias("death"), F.max_by("party", F.struct("seq", "ordinal")).alias("heir"))
    named = head.select("doc_id", nullify(F.col("applicant_name")).alias("patta")).join(ends, "doc_id", "left")
    deceased = named.select(F.col("doc_id").alias("bundle_id"), F.inline(F.array(*[F.struct(F.lit(s).alias("source"), F.col(s).alias("name")) for s in ("death", "heir", "patta")])))
    return bundles.inheritance(heirs, deceased, head.select(F.col("doc_id").alias("bundle_id"), F.col("form_type").alias("status")))
