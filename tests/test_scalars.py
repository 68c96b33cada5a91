import datetime as dt

from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.functions import tamil
from titlegrain.operators import crosscheck, documents, fields, geometry, lookup, units
from titlegrain.sources import readers, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


def test_dates(spark):
    for text in ("24-Mar-2008", "24-March-2008", "24-03-2008", "24/03/2008", "2008-03-24", "24.03.2008"):
        assert one(spark, text, S.parse_date) == dt.date(2008, 3, 24)
    assert one(spark, "31-02-2008", S.parse_date) is None
    assert one(spark, "26", S.full_year) == 1926 and one(spark, "25", S.full_year) == 2025


def test_money(spark):
    assert str(one(spark, "Rs. 12,34,567/-", S.amount)) == "1234567.00"
    assert one(spark, "-", S.amount) is None
    for n, text in ((0.0, "-"), (5.0, "Rs. 5/-"), (999.0, "Rs. 999/-"), (1000.0, "Rs. 1,000/-"), (100000.0, "Rs. 1,00,000/-"), (1234567.0, "Rs. 12,34,567/-"), (12345678.0, "Rs. 1,23,45,678/-")):
        assert one(spark, n, S.rupees, "double") == text


def test_names_and_masks(spark):
    assert one(spark, "Thiru. K Vetrinathan S/o X", S.name_normal) == "k vetrinathan x"
    assert one(spark, "ID 1234 5678 9012 and 12345678901", S.mask_numbers) == "ID XXXX-XXXX-9012 and 12345678901"
    assert one(spark, "1. A 2. B", S.party_items) == ["A", "B"]
    assert one(spark, "1. A\n2. B", S.party_items) == ["A", "B"]
    assert one(spark, "A", S.party_items) == ["A"]


def test_tamil():
    assert tamil.latin("வினைவேல்") == "Vinaivel"


def areas(spark, extents=(), lines=()):
    head = spark.createDataFrame([(f"h{i}", e) for i, e in enumerate(extents)], "doc_id string, requested_extent string")
    patta = spark.createDataFrame([(i, *x) for i, x in enumerate(lines)], "row_id long, extent_ha string, extent_ares string, sq_meters string, sq_feet string")
    return {(r["rec_key"], r["field_name"]): (r["sqft"], r["is_usual"]) for r in units.areas_in_sqft(spark, head, patta).collect()}


def test_areas(spark):
    texts = ["5.25 Cents", "2 Grounds", "1½ Acres", "Half an acre", "Ac 4 - 11 Cts", "2 Grounds 405 sq.ft", "0.40.00 Hectares", "1,250 Sq.Ft", ".", None, "", "as per deed", "measuring 1-03.88 Hect-Ares or thereabouts", "Cents 21.17", "2 ஹெக்டேர் 80.66 ஏர்ஸ்"]
    got = areas(spark, texts)
    want = [2287, 4800, 65340, 21780, 179032, 5205, 43056, 1250, None, None, None, None, 111815, 9222, 302100]
    for i, sqft in enumerate(want):
        assert got.get((f"h{i}", "requested_extent"), (None,))[0] == sqft, texts[i]
    assert got["h7", "requested_extent"][1] and not got["h5", "requested_extent"][1]


def test_areas_by_other_fields(spark):
    got = areas(spark, lines=[("0 - 7.89", None, None, "789"), ("0.01.91 Ha", None, "191 Sq.M", "2056"), ("88 sq yds", None, None, "7.76 ('000 sq.ft)"), (None, None, None, "55")])
    assert got["0", "sq_feet"] == (8493, False) and got["1", "sq_feet"] == (2056, True)
    assert got["2", "sq_feet"] == (7760, False) and got["2", "extent_ha"] == (792, False) and got["0", "extent_ha"][1]
    assert got["3", "sq_feet"] == (55, True)


def test_pages(spark):
    pages = spark.createDataFrame([(n,) for n in range(1, 8)], "page_number int")
    take = lambda w, m=None: sorted(r[0] for r in documents.page_range(pages, w, m).collect())
    assert take("1-3") == [1, 2, 3] and take("1,2,5") == [1, 2, 5] and take("9-2") == list(range(1, 8)) and take("x", 2) == [1, 2] and take(None) == list(range(1, 8))


def test_prune_and_chunks(spark):
    text = spark.createDataFrame([(1, "a\nbb\nprior document\n7/2001\n8/2002 x\ny")], "k int, t string")
    rows = documents.lines(text, "k", "t")
    assert [r["line"] for r in documents.prune(rows, "k", "line_no", "line", 5, 3).orderBy("line_no").collect()] == ["a", "bb"]
    assert [(r["chunk"], r["first_line"], r["last_line"]) for r in documents.chunks(rows, "k", "line_no", "line", "[0-9]/[0-9]{4}").collect()] == [(1, 5, 6)]


def test_rules(spark):
    texts = spark.createDataFrame([(1, "document 12/2001 on"), (2, None), (3, "")], "k int, t string")
    got = {(r["k"], r["field"]): (r["value"], r["confidence"]) for r in documents.extract_by_rules(texts, "k", "t", documents.DEED_RULES).collect()}
    assert got[1, "document_number"] == ("12/2001", 0.9) and got[3, "document_number"] == (None, 0.0) and (2, "amount") not in got


def test_fields(spark):
    base = spark.createDataFrame([("d", "a", None, 0.0), ("d", "b", "x", 0.9)], "doc_id string, field string, value string, confidence double")
    other = spark.createDataFrame([("d", "a", "y", 0.6), ("d", "c", "z", 0.5)], "doc_id string, field string, value string, confidence double")
    merged = {r["field"]: (r["value"], r["confidence"], r["origin"]) for r in fields.merge(base, other, "doc_id").collect()}
    assert merged == {"a": ("y", 0.6, "other"), "b": ("x", 0.9, "base"), "c": ("z", 0.5, "other")}
    edits = spark.createDataFrame([("d", "New Field", "n"), ("d", "b", "w")], "doc_id string, field string, value string")
    edited = {r["field"]: (r["value"], r["edited"]) for r in fields.override(base, edits, "doc_id").collect()}
    assert edited == {"a": (None, False), "b": ("w", True), "new_field": ("n", True)}
    alias = spark.createDataFrame([("d", "k_no", "2", 0.5), ("d", "ks", "1", 0.5)], "doc_id string, field string, value string, confidence double")
    assert fields.aliased(alias, "doc_id", {"ks": "number", "k_no": "number"}).first()["value"] == "1"
    assert fields.wide(base, "doc_id", ["a", "b"]).first()["b"] == "x"


def test_boxes(spark):
    kind = "page int, id int, x0 double, x1 double, y0 double, y1 double, score double"
    a = spark.createDataFrame([(1, 1, 0.0, 10.0, 0.0, 10.0, 1.0)], kind)
    b = spark.createDataFrame([(1, 2, 5.0, 12.0, 2.0, 11.0, 0.5), (1, 3, 5.0, 12.0, 1.0, 9.0, 0.9), (1, 4, 50.0, 60.0, 0.0, 10.0, 1.0)], kind)
    assert [r["best_id"] for r in geometry.best_overlap(a, b, "page", 5.0).collect()] == [3]
    words = spark.createDataFrame([(1, 1, 0.0, 1.0, 0.0, 10.0, 1.0), (1, 2, 2.0, 3.0, 1.0, 11.0, 1.0), (1, 3, 0.0, 1.0, 30.0, 40.0, 1.0)], kind)
    for f in (geometry.reading_rows, geometry.reading_rows_exact):
        assert [r["row"] for r in f(words, "page").orderBy("id").collect()] == [1, 1, 2]
    line = spark.createDataFrame([(1, 1, 0.0, 11.0, "abc de fghi")], "k int, line_no int, x0 double, x1 double, text string")
    assert [(r["word"], r["x"], r["w"]) for r in geometry.split_words(line, "k").orderBy("word_no").collect()] == [("abc", 0.0, 3.0), ("de", 4.0, 2.0), ("fghi", 7.0, 4.0)]


def test_lookup(spark):
    values = spark.createDataFrame([("Sorpde",), ("sorpede ",), (None,), ("xxxxxxxxx",)], "v string")
    entries = spark.createDataFrame([("Sorpede",), ("Mekoyoo",)], "n string")
    got = {r["value"]: (r["entry"], r["edits"]) for r in lookup.nearest_entry(values, "v", entries, "n").collect()}
    assert got["sorpde"] == ("Sorpede", 1) and got["sorpede"] == ("Sorpede", 0) and "xxxxxxxxx" not in got


def test_sources_and_sinks(spark, tmp_path):
    bodies = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("no json",)], "t string")
    assert [r["body"] and r["body"]["a"] for r in readers.json_bodies(bodies, "t", "a int").collect()] == [1, None]
    sinks.write_csv(spark.createDataFrame([(1, 'x "y"')], "a int, b string"), str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').first()["b"] == 'x "y"'
    rows = spark.createDataFrame([(i, "q", "a") for i in range(200)], "k int, q string, a string")
    parts = {r["part"]: r["count"] for r in sinks.examples(rows, "k", "q", "a").groupBy("part").count().collect()}
    assert sum(parts.values()) == 200 and parts["train"] > 130 and set(parts) == {"train", "validation", "test"}
    (tmp_path / "f.bin").write_bytes(b"123")
    assert readers.uploads(spark, str(tmp_path), "*.bin").select("length", "extension").first() == (3, "bin")


def test_entries_held_by_values(spark, monkeypatch):
    """A kind word behind a short name; slips at both ends, also in a list too large to broadcast."""
    values = spark.createDataFrame([("Mekoyoo Mavattam",), ("sorp",), ("xorpedx",), ("abcdefghij",), ("q",)], "v string")
    names = spark.createDataFrame([("Sorpede",), ("Mekoyoo",), ("Lenumkudi",), ("",), (None,)], "n string")
    want = {"mekoyoo mavattam": ("Mekoyoo", 9), "sorp": ("Sorpede", 3), "xorpedx": ("Sorpede", 2)}
    look = lambda: {r["value"]: (r["entry"], r["edits"]) for r in lookup.nearest_entry(values, "v", names, "n").collect()}
    assert look() == want
    monkeypatch.setattr(lookup, "small_enough", lambda df: False)
    assert look() == want


def test_near_boxes_of_unequal_size(spark):
    """A low, narrow box just off a high, wide one is the same line by the distance of middles."""
    kind = "page int, id int, x0 double, x1 double, y0 double, y1 double, score double"
    a = spark.createDataFrame([(1, 1, 0.0, 20.0, 0.0, 9.9, 1.0), (1, 2, 0.0, 20.0, 50.0, 60.0, 1.0)], kind)
    b = spark.createDataFrame([(1, 3, 21.0, 23.0, 10.2, 10.6, 0.5), (1, 4, 0.0, 20.0, 12.0, 13.0, 0.9), (1, 5, 40.0, 42.0, 50.0, 60.0, 0.9)], kind)
    assert [(r["id"], r["best_id"]) for r in geometry.best_overlap(a, b, "page", 10.0).collect()] == [(1, 3)]
