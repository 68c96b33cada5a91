import datetime as dt

from pyspark.sql import functions as F

from titlegrain.operators import crosscheck, display, documents, geometry, parse

CELLS = "doc_id string, page_index int, row_no int, c0 string, c1 string, c2 string, c3 string, c4 string, c5 string, c6 string"


def test_table_entries(spark):
    rows = [
        ("d", 0, 1, "Sr. No", "Document No", None, None, None, None, None),
        ("d", 0, 2, "1", "100/2008", "01-Mar-2008\n02-Mar-2008\n03-Mar-2008", "Conveyance", "1. A", "1. B", "12, 3"),
        ("d", 0, 3, None, None, None, None, "2. C", None, None),
        ("d", 0, 4, None, "Consideration Value: Rs. 5,000/-", None, "Market Value: Rs. 6,000/-", None, "PR: 9/2001", None),
        ("d", 0, 5, None, "Document Remarks", "first part", None, None, None, None),
        ("d", 1, 1, "2", "101/2009", None, "Gift", "1. D", "1. E", None),
        ("e", 0, 1, None, "nothing", None, None, None, None, None),
    ]
    got = parse.table_entries(spark.createDataFrame(rows, CELLS)).orderBy("doc_id", "entry").collect()
    assert len(got) == 2
    a = got[0]
    assert (a["sr"], a["doc_no"], a["executants"], a["claimants"], a["consideration"], a["market_value"], a["pr_numbers"], a["remarks"]) == (1, "100/2008", "1. A 2. C", "1. B", "Rs. 5,000/-", "Rs. 6,000/-", "9/2001", "first part")
    assert a["registration_date"] == dt.date(2008, 3, 3) and got[1]["executants"] == "1. D" and got[1]["remarks"] is None
    assert parse.table_entries(spark.createDataFrame([], CELLS)).count() == 0


def test_line_entries(spark):
    text = spark.createDataFrame([("p", "head\n10/2001\nSale of 05-Jan-2001\nprior document\n11/2002\n12/2003 mortgage 06-Feb-2003\nend")], "k string, t string")
    got = parse.line_entries(documents.lines(text, "k", "t"), "k").orderBy("entry").collect()
    assert [(r["doc_no"], r["date"], r["first_line"], r["last_line"]) for r in got] == [("10/2001", dt.date(2001, 1, 5), 2, 5), ("12/2003", dt.date(2003, 2, 6), 6, 7)]


def test_declared_total(spark):
    pages = spark.createDataFrame([("d", 1, 1, "Number of Entries: 9"), ("d", 2, 2, "x"), ("d", 3, 3, "Number of entries / எண்: 4"), ("d", 4, 4, None), ("d", 5, 5, "")], "doc_id string, page_id long, page_number int, content string")
    assert [r["total"] for r in parse.declared_total(pages).collect()] == [4]


def test_heirs(spark):
    t = spark.createDataFrame([(1, "1. Velu Mani - Son, 34\n2. R. Nila - Daughter, 29\n3. Velu Mani - Son, 34"), (2, None)], "k int, t string")
    assert sorted((r["name"], r["relationship"], r["age"]) for r in parse.heirs(t, "k", "t").collect()) == [("R. Nila", "daughter", 29), ("Velu Mani", "son", 34)]
    rows = spark.createDataFrame([(1, "A", "signatory"), (1, "B", None), (2, "C", "Released")], "k int, n string, s string")
    got = {r["k"]: (r["accounted"], r["missing"], r["complete"]) for r in parse.all_accounted(rows, "k", "n", "s", ("signatory", "release")).collect()}
    assert got == {1: (1, "B", False), 2: (1, "", True)}


def shown(spark, text, f):
    return spark.createDataFrame([(text,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


def test_display(spark):
    assert tuple(shown(spark, "1. A 2. B 1. C 2. D", display.split_merged)) == ("1. A 2. B", "1. C 2. D")
    assert tuple(shown(spark, "1. A", display.split_merged)) == ("1. A", None)
    assert shown(spark, "(1) A One (2) B Two", display.owners_list) == ["A One", "B Two"]
    assert shown(spark, "A One, B Two and C", display.owners_list) == ["A One", "B Two", "C"]
    assert tuple(shown(spark, "Nila D/o Velu", display.parentage)) == ("Nila", "Velu") and tuple(shown(spark, "Nila", display.parentage)) == ("Nila", None)
    assert shown(spark, "vetri NATHAN KTS  bank", display.title_name) == "Vetri Nathan KTS Bank"
    assert shown(spark, "1. A. Velu (Principal), Flat No 3", display.clean_party) == "A. Velu" and shown(spark, "1.", display.clean_party) is None
    assert shown(spark, "Government poramboke", display.land_flag) and not shown(spark, "Ryotwari private", display.land_flag) and not shown(spark, None, display.land_flag)
    assert shown(spark, "5.25 Cents", display.extent_by_validator) == 2286.9 and shown(spark, "2 Grounds 405 sq.ft", display.extent_by_check) == 405.0 and shown(spark, ".", display.extent_by_check) is None
    assert spark.createDataFrame([("abcd", "abxd"), (None, "a")], "a string, b string").select(display.likeness(F.col("a"), F.col("b")).alias("o")).collect()[0]["o"] == 75


def test_money_repair(spark):
    reg = spark.createDataFrame([(None, "Rs. 5,000/-"), ("Rs. 1/-", "12/2001")], "consideration string, pr_numbers string")
    assert [tuple(r) for r in display.repair_money(reg).collect()] == [("Rs. 5,000/-", None), ("Rs. 1/-", "12/2001")]


def test_field_boxes(spark):
    fields = spark.createDataFrame([("d", "owner", "Velu Mani", 0.9), ("d", "none", None, 0.0)], "doc_id string, field string, value string, confidence double")
    words = spark.createDataFrame([("d", 1, "Velu", 0.0, 1.0, 0.0, 1.0), ("d", 2, "VELU", 5.0, 6.0, 5.0, 6.0), ("d", 2, "mani", 7.0, 9.0, 5.0, 6.0)], "doc_id string, page_number int, word string, x0 double, x1 double, y0 double, y1 double")
    assert [(r["page_number"], r["x0"], r["x1"]) for r in display.field_boxes(fields, words, "doc_id").collect()] == [(2, 5.0, 9.0)]


def test_unmatched_boxes(spark):
    kind = "page int, id int, x0 double, x1 double, y0 double, y1 double, text string"
    boxes = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, 1.0, "a"), (1, 2, 50.0, 60.0, 50.0, 60.0, "new"), (1, 3, 80.0, 90.0, 80.0, 90.0, "old")], kind)
    accepted = spark.createDataFrame([(1, 9, 0.5, 2.0, 0.5, 2.0, "the old one")], kind)
    assert [r["id"] for r in geometry.unmatched(boxes, accepted, "page", 10.0).collect()] == [2]


def test_empty_bundle_is_no_pass(spark):
    checks = spark.createDataFrame([("d", "a", "unknown"), ("e", "a", "pass"), ("e", "b", "unknown"), ("f", "a", "fail")], "doc_id string, check_name string, status string")
    assert {r["doc_id"]: r["clean"] for r in crosscheck.matrix_summary(checks).collect()} == {"d": False, "e": True, "f": False}


def test_predicates(spark):
    from titlegrain.operators import predicates as P

    assert [shown(spark, t, P.plausible_survey) for t in ("142/2B", "0", "12/05/2001", "5/2001", "007/1")] == [True, False, False, False, False]
    assert [shown(spark, t, P.plausible_extent) for t in ("2010 Grounds", "150 grounds 5 sq.ft", "4 Grounds", None)] == [False, True, True, True] or shown(spark, None, P.plausible_extent) is None
    text = "Power of attorney given in document 12/2001 to the agent"
    assert shown(spark, text, lambda c: P.attorney_context(c, "12/2001")) and not shown(spark, text, lambda c: P.attorney_context(c, "13/2001"))
    assert shown(spark, "x" * 140, P.shortened) == "x" * 127 + "..."
    days = spark.createDataFrame([(31, 2, 2001), (1, 13, 2001), (None, 1, 2001)], "d int, m int, y int")
    assert [r[0] for r in days.select(P.plausible_date(F.col("d"), F.col("m"), F.col("y"))).collect()] == [True, False, False]
