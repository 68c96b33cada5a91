"""The property filter, bundles, categories, details and Tamil functions on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_register import BASE, SCHEMA, row, rows

from titlegrain.functions import tamil as T
from titlegrain.operators import bundles as B
from titlegrain.operators import categories as C
from titlegrain.operators import details as D
from titlegrain.operators import register as R
from titlegrain.operators import search as X


@pytest.fixture(scope="module")
def reg(spark):
    return R.register(spark.createDataFrame(BASE, SCHEMA)).cache()


def test_summary_of_the_four_rows(spark, reg):
    """The canonical register: all match, the holder is the last buyer, the loan is closed."""
    got = X.summary(reg, X.Criteria(survey_no="10/2A", flat="3B", owner="P. One")).collect()
    assert [(r.entries, r.matched, r.matched_pct, r.holder, r.loans, r.closed, r.open, r.court_entries) for r in got] == [(4, 4, 100.0, "1. P. Two", 1, 1, 0, 0)]
    court = row("d", 5, "5/2021", "Court Attachment Order", "1. Civil Court", "1. X Finance", remarks="In O.S. No. 4/2020")
    more = R.register(spark.createDataFrame([BASE[0], BASE[1], BASE[3], court], SCHEMA))
    got = X.summary(more, X.Criteria(survey_no="10/2A")).collect()[0]
    assert (got.loans, got.open, got.court_entries) == (1, 1, 1)


def test_filter_modes(reg):
    any_ = X.matches(reg, X.Criteria(survey_no="10/2A", owner="P. Two"))
    assert any_.filter("matched").count() == 4
    all_ = X.matches(reg, X.Criteria(survey_no="10/2A", owner="P. Two", mode="all")).filter("matched")
    assert [(r.seq, list(r.reasons)) for r in all_.collect()] == [(4, ["survey", "owner"])] or all_.count() == 4
    assert X.matches(reg, X.Criteria()).filter("matched").count() == 4
    # without a survey number the other criteria only add reasons
    assert X.matches(reg, X.Criteria(door_no="zzz")).filter("matched AND size(reasons) = 0").count() == 4
    assert X.pool(X.matches(reg, X.Criteria(survey_no="99/9"))).count() == 4


def test_extent_and_flat(spark):
    reg = R.register(spark.createDataFrame([row("x", 1, "1/2001", "Sale", "1. A", "1. B", remarks="site of 1000 sq.ft, an apartment"), row("x", 2, "2/2001", "Sale", "1. A", "1. B", remarks="site of 2000 sq.ft"), row("x", 3, None, None, None, None, survey=None)], SCHEMA))
    got = X.matches(reg, X.Criteria(survey_no="77/7", extent="1,100 Sq.Ft", flat="Flat 9Z"))
    assert rows(got.select("seq", F.array_join("reasons", ",").alias("r"), "context", "matched"), "seq", "r", "context", "matched") == [(1, "extent", True, True), (2, "", False, False), (3, "", False, False)]


def test_loans_by_lender_word(spark):
    """A lender's word in either party of a discharge, a document as part of a text, `release` closes."""
    deeds = [row("x", 1, "7/2001", "Hypothecation", "1. A", "1. Zebu Bank Ltd"), row("x", 2, "8/2001", "Mortgage", "1. A", "1. Bank of India"), row("x", 3, "9/2001", "Release", "1. Q", "1. M/s.Zebus Holdings", "no 18/2001"), row("x", 4, None, "Mortgage", "1. A", None)]
    reg = R.register(spark.createDataFrame(deeds, SCHEMA))
    assert rows(X.loans(reg).fillna(0), "seq", "discharge_seq") == [(1, 3), (2, 3), (4, 0)]


def test_related(reg):
    assert rows(X.related(reg, "P. One"), "seq", "role") == [(1, "claimant")]
    assert rows(X.related(reg, "Alpha Villas"), "seq", "role") == [(1, "executant, in part")]


BUNDLE = [
    ("a", "sale_deed", "vendor_details", "Thiru K. Velan"), ("a", "sale_deed", "survey_number", "10/2A"), ("a", "sale_deed", "land_extent", "1000 sq.ft"),
    ("a", "patta", "owner_name", "Velan"), ("a", "patta", "survey_numbers", "S.No 10/2A, 11"), ("a", "patta", "extent_details", "1040 sq.ft"),
    ("a", "ec", "form_type", "Form 15"), ("a", "parent_docs", "last_5_years_validation", "PASS"), ("a", "a_register", "land_classification", "Ryotwari"), ("a", "ec", "double_sales", "0"),
    ("b", "sale_deed", "vendor_details", "Mani"), ("b", "patta", "owner_name", "Arasu"), ("b", "patta", "survey_numbers", "5"), ("b", "sale_deed", "survey_number", "6/1"),
    ("b", "sale_deed", "land_extent", "1000"), ("b", "patta", "extent_details", "1060"), ("b", "ec", "note", "Active mortgage found"), ("b", "parent_docs", "last_5_years_validation", "FAILED"), ("b", "patta", "land_classification", "Government poramboke"), ("b", "ec", "double_sales", "2"),
    ("c", "sale_deed", "vendor_details", "-"),
]


def test_bundles(spark):
    got = B.matrix(spark.createDataFrame(BUNDLE, "bundle_id string, doc_role string, key string, value string"))
    by = {k: {r.check_name: r.status for r in got.filter(F.col("bundle_id") == k).collect()} for k in "abc"}
    assert set(by["a"].values()) == {"pass"} and len(by["a"]) == 7
    assert set(by["b"].values()) == {"fail"} and set(by["c"].values()) == {"unknown"}
    assert rows(B.matrix_overall(got), "bundle_id", "overall") == [("a", "pass"), ("b", "action required"), ("c", "unknown")]


def test_inheritance(spark):
    heirs = spark.createDataFrame([("a", "W", "Signatory"), ("a", "w", None), ("a", "S", "Registered release deed"), ("b", "S", "abroad"), ("b", None, None), ("c", "S", "Party 1")], "bundle_id string, name string, status string")
    dead = spark.createDataFrame([(k, s, "Late Mr. V. Raman") for k in "abc" for s in ("death", "heir", "patta")] + [("d", "death", "X")], "bundle_id string, source string, name string")
    gate = spark.createDataFrame([("a", "MUTATED TO HEIRS"), ("b", "Mutated"), ("c", "Mutation pending")], "bundle_id string, status string")
    got = B.inheritance(heirs, dead, gate)
    assert rows(got, "bundle_id", "identity", "heirs", "accounted", "missing", "overall") == [("a", "pass", 2, 2, "", "pass"), ("b", "pass", 1, 0, "s", "missing heirs"), ("c", "pass", 1, 1, "", "blocked"), ("d", "unknown", 0, 0, "", "unknown")]


TEXTS = {
    "sale_deed": "DEED OF ABSOLUTE SALE executed at Palur on this 12-03-2004 between Thiru K. Velan and Tmt. M. Malar. The vendor sells survey number 10/2A of Palur village measuring 1,200 sq.ft for Rs. 5,00,000/-. Previous document 45/1995. Undivided share of 300 sq.ft.",
    "patta": "PATTA No: 1234\nVillage: Palur\nTaluk: Velur\nOwner name: K. Velan\nSurvey no 10/2A extent 0.40.00, wet\nTax: 12.50",
    "parent_docs": "Mother document\nDocument no: 45/1995\nVendor: A. Arasu\nPurchaser: K. Velan",
    "ec": "Encumbrance certificate Form No. 15\nApplicant: K. Velan\nVillage: Palur",
    "building_plan": "Planning permit no: B/12/2019\nResidential\nPlinth area: 900 sq.ft\nFSI: 1.5\nCMDA",
    "rera": "TNRERA no: TN/01/2020\nProject name: Palm Grove\nPromoter: Acme",
    "tax_eb": "Property tax\nReceipt no: 77\nAmount paid: 1200",
    "layout_approval": "Approved layout\nApproval no: PPD/LO 3/2001\nOSR: 10 %",
    "death_legal_heir": "Legal heir certificate no: 5/2020\nName of the deceased: V. Raman\nDate of death: 01-02-2019",
    "loan_docs": "Memorandum of deposit\nLoan account: 99\nBank: Example Bank\nLoan amount: 10,00,000",
    "tslr": "Extract from the town survey: Ward 3, Block 12, town survey number 7/2, tenure type: Ryotwari, assessment 120",
}


def test_every_category_is_reached(spark):
    texts = spark.createDataFrame([*TEXTS.items(), ("none", "nothing here"), ("null", None), ("empty", "")], "k string, text string")
    got = dict(rows(C.detect(texts, "k", "text"), "k", "category"))
    assert all(got[k] == k for k in TEXTS) and got["none"] == got["empty"] == "sale_deed" and "null" not in got
    found = {(r.k, r.field): r.value for r in C.extract(texts, "k", "text").filter("value IS NOT NULL").collect()}
    assert {k for k, _ in found} >= set(TEXTS)
    want = {("sale_deed", "registration_date"): "12-03-2004", ("sale_deed", "vendor_details"): "Thiru K. Velan", ("sale_deed", "purchaser_details"): "Tmt. M. Malar", ("sale_deed", "survey_number"): "10/2A", ("sale_deed", "previous_doc_reference"): "45/1995", ("sale_deed", "land_extent"): "1,200 sq.ft", ("patta", "patta_number"): "1234", ("patta", "village"): "Palur", ("patta", "owner_name"): "K. Velan", ("patta", "total_tax"): "12.50", ("tslr", "ward"): "3", ("tslr", "block"): "12", ("tslr", "survey_number"): "7/2", ("tslr", "tenure_type"): "Ryotwari", ("building_plan", "fsi"): "1.5", ("death_legal_heir", "deceased_name"): "V. Raman", ("loan_docs", "bank_name"): "Example Bank"}
    assert {k: found.get(k) for k in want} == want
    assert C.extract(texts, "k", "text", only=["fsi"]).filter("value IS NOT NULL").count() == 1
    assert {r.c for r in C.catalogue(spark).selectExpr("category AS c").collect()} == set(C.RULES)


def test_details(spark):
    one = lambda f, *xs: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(f(F.col("x")).alias("y")).collect()]
    assert one(D.date_in_words, "on this the 12th day of March, 2004 at", "5 June 1999", "31 February 2001", "x", None) == [dt.date(2004, 3, 12), dt.date(1999, 6, 5), None, None, None]
    assert one(D.share_fraction, "1/3 UDS in 10400", "153/5867 undivided share", "no", None) == ["1/3", "153/5867", None, None]
    assert one(D.structures, "காலிமனை and an apartment", None) == ["vacant,flat", ""]
    assert one(D.without_address, "K. Velan, S/o Mani, aged about 40 years, residing at No. 5", "A. B, Door No 12, Street", None) == ["K. Velan, S/o Mani", "A. B", None]
    assert one(D.attorney_name, "Mr. X Y, son of Z, aged 40", "", None) == ["Mr. X Y", None, None]
    blank = spark.createDataFrame([(250.0, 10.0), (200.0, 20.0), (None, 1.0)], "m double, s double").select(D.blank_page(F.col("m"), F.col("s")).alias("b"))
    assert [r.b for r in blank.collect()] == [True, False, False]
    lines = spark.createDataFrame([("a", 1, "Owners"), ("a", 2, "1. Chinna"), ("a", 3, "son of"), ("a", 4, "2) Raman"), ("b", 1, "")], "k string, n int, line string")
    assert rows(D.numbered_groups(lines, "k", "n", "line").fillna(""), "k", "grp", "number", "text") == [("a", 0, "", "Owners"), ("a", 1, "1", "Chinna son of"), ("a", 2, "2", "Raman"), ("b", 0, "", "")]
    values = spark.createDataFrame([("Alpha Bank Limited, Main Branch",), ("alpha",), ("Gamma",), (None,), ("",)], "v string")
    known = spark.createDataFrame([("Alpha Bank Limited",), ("Alpha Bank",), (None,)], "n string")
    assert rows(D.known_institutions(values, "v", known, "n"), "value", "institution") == [("alpha", "alpha bank limited"), ("alpha bank limited, main branch", "alpha bank limited")]
    codes = spark.createDataFrame([("Salem", 8), ("Salem", 9), (None, 1)], "d string, code int")
    assert rows(D.coded(spark.createDataFrame([(" salem ",), ("x",), (None,)], "d string"), ["d"], codes, "code").fillna(0).fillna("-"), "d", "code") == [(" salem ", 8), ("-", 0), ("x", 0)]


def test_tamil(spark):
    one = lambda f, *xs: [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string").orderBy("i").select(f(F.col("x")).alias("y")).collect()]
    assert one(T.logical_order, "ெகா", "ஸ்னேகா", "ைம", "க்ா", None) == ["கொ", "ஸ்னேகா", "மை", "கா்", None]
    once = one(T.logical_order, "ெகா", "பிரைேவட்")
    assert one(T.logical_order, *once) == once
    assert one(T.clean_initials, "G.. Ramu", "b.n.Swami", "Neetu.m.", " .x", None) == ["G. Ramu", "B.N. Swami", "Neetu M.", "x", None]
    assert one(T.without_stray_marks, "Meேnaj", "abc", "தமிழ்", None) == ["Menaj", "abc", "தமிழ்", None]
    assert one(lambda c: T.glossary(c, T.FIRM_WORDS), "ABC பிரைவேட் லிமிடெட்", None) == ["ABC Private Limited", None]
    got = one(T.without_roles, "Ramu (Principal)", "Ramu (பிரின்சிபல்)", "A (B) (ஏஜண்ட்)", "A (Principal / பிரின்சிபல்)", "A (Anna)", None)
    assert [(g["name"], g["role"]) if g["name"] else None for g in got] == [("Ramu", "Principal"), ("Ramu", "Principal"), ("A (B)", "Agent"), ("A", "Principal"), ("A (Anna)", None), None]
    kin = one(T.kinship, "1. Ramu S/o Mani", "ராமு மகன் மணி", "Ramu", None)
    assert [(k["name"], k["relation"], k["parent"]) for k in kin] == [("Ramu", "S/o", "Mani"), ("ராமு", "S/o", "மணி"), ("Ramu", None, None), (None, None, None)]
    assert T.tamil("Mani K. 12") == "மனி K. 12" and T.tamil("") == ""
    parties = spark.createDataFrame([("d", 1, "executant", 1, "G.. மணி (ஏஜண்ட்)"), ("d", 1, "executant", 2, "387"), ("d", 1, "claimant", 1, "Mani")], "doc_id string, seq int, side string, ordinal int, party string")
    assert rows(T.party_records(parties).fillna("-"), "side", "english", "tamil", "role") == [("claimant", "Mani", "மனி", "-"), ("executant", "G. Mani", "G. மணி", "Agent")]
    words = spark.createDataFrame([("salem", "சேலம்")], "word string, translation string")
    assert rows(T.word_translations(spark.createDataFrame([(1, "Salem  north"), (2, None)], "k int, t string"), "k", "t", words), "k", "translated") == [(1, "சேலம் north")]
