import pytest

from titlegrain.llm import names as N
from titlegrain.llm import places as P

ENTRY = "doc_id string, seq int, executants string, claimants string, schedules array<struct<survey_no:string>>, extra string"


def links(spark, rows, heads=()):
    e = spark.createDataFrame([(d, s, x, c, [(v,)] if v else [], "x") for d, s, x, c, v in rows], ENTRY)
    h = spark.createDataFrame(list(heads), "doc_id string, applicant_name string")
    return {(r["name_key_a"], r["name_key_b"]) for r in N.linked(e, h).collect()}


def brute(rows, heads, common=()):
    """Every pair of mentions of a certificate, judged one by one."""
    judge = N.Judge(common)
    ms = []
    for d, s, x, c, v in rows:
        for mark, text in (("e", x), ("c", c)):
            if text and text.lower() not in ("-", "*", "none", "null", "not detected", ""):
                parts = [p.strip() for p in __import__("re").split(r"(?:^|\s+)\d{1,3}\.\s+", text.strip()) if p.strip()]
                ms += [(d, v, f"{d}#{s}#{mark}#{k + 1}", p) for k, p in enumerate(parts)]
    ms += [(d, "#", f"{d}#0#a#1", n) for d, n in heads if n]
    out = set()
    for i, a in enumerate(ms):
        for b in ms[i + 1 :]:
            if a[0] == b[0] and a[2] != b[2] and a[3] != b[3] and ("#" in (a[1], b[1]) or (a[1] and a[1] == b[1])) and judge.same(N.signature(a[3]), N.signature(b[3])):
                out.add(tuple(sorted((a[2], b[2]))))
    return out


ROWS = [
    ("d", 1, "1. S. Gunaselvi 2. K. Velumani", "1. Kuringi Traders Savings Bank Limited", "1/1"),
    ("d", 2, "1. KTS Bank", "1. Gunaselvi, daughter of Singasamy\n2. Velumani K, ref 12/2019", "1/1"),
    ("d", 3, "The Kuringi Traders Savings Bank Ltd, Main Branch", "1. ச. குணசெல்வி", "1/1"),
    ("d", 4, "1. K. Gunaselvi", "1. Gunaamani S/o Singasamy", "1/1"),
    ("d", 5, "1. S. Gunaselvi", "-", "2/2"),
    ("d", 6, "1. Guna Selvi S", None, None),
    ("d", 7, "District Court, Vagaarzho", "District Court, Sorpede", "1/1"),
    ("e", 1, "", "*", "1/1"),
]
HEADS = [("d", "Gunaselvi S"), ("d", "Gunaselvi S"), ("e", None)]


def test_links_equal_brute_force(spark):
    got = links(spark, ROWS + [ROWS[0]], HEADS)
    assert got == brute(ROWS, HEADS)
    assert ("d#1#e#1", "d#2#c#1") in got and ("d#1#e#1", "d#3#c#1") in got and ("d#1#c#1", "d#2#e#1") in got and ("d#0#a#1", "d#6#e#1") in got
    assert not any("d#4#e#1" in p for p in got) and not any("d#7#" in p[0] for p in got)


def test_large_certificates_give_the_same(spark, monkeypatch):
    want = links(spark, ROWS, HEADS)
    monkeypatch.setattr(N, "GROUP_LIMIT", 2)
    assert links(spark, ROWS, HEADS) == want
    monkeypatch.setattr(N, "BLOCK_LIMIT", 2)
    assert links(spark, ROWS, HEADS) == want


def test_over_full_blocks_lose_nothing(spark, monkeypatch):
    """Firms that share a last word and persons that share an ending, some with a slip: more than a part holds."""
    firms = ["Kuringi Traders", "Kurngi Traders", "Kalumani Traders", "Korpede Traders", "Kenumkudi Traders", "Kenumkdi Traders"]
    people = ["K. Gunaselvi", "K. Gunselvi", "K. Gunamukiselvi", "K. Gunarulselvi", "K. Gunarlselvi", "K. Gunponselvi"]
    rows = [("d", i, f"1. {f} Limited", f"1. {p}", "1/1") for i, (f, p) in enumerate(zip(firms, people), 1)]
    monkeypatch.setattr(N, "GROUP_LIMIT", 2)
    monkeypatch.setattr(N, "BLOCK_LIMIT", 2)
    got = links(spark, rows)
    assert got == brute(rows, [])
    assert ("d#1#e#1", "d#2#e#1") in got and ("d#5#e#1", "d#6#e#1") in got and ("d#1#c#1", "d#2#c#1") in got


def test_common_spellings_count_the_rare_ones(spark, monkeypatch):
    sigs = ["P|kumaran:k"] * 60 + ["P|selvi:k"] * 5 + [f"P|{a}{b}ran:k" for a in "aeiou" for b in "kmnprs"] * 2
    parsed = spark.createDataFrame([(x,) for x in sigs], "sig string")
    monkeypatch.setattr(N, "VOCABULARY", 2)
    assert sorted(N.common_spellings(parsed)) == ["kumaran", "selvi"]
    monkeypatch.setattr(N, "VOCABULARY", 1)
    with pytest.raises(ValueError):
        N.common_spellings(parsed)


def test_empty(spark):
    assert links(spark, []) == set()


def test_lcs():
    assert N.lcs("abcbdab", "bdcaba") == 4 and N.lcs("", "a") == 0 and N.ratio("kunamani", "kunaani") > 0.9


PLACES = [(1, "district", "Sorpede", "சொர்பெடெ", None), (2, "district", "Mekoyoo", None, "Oldname"), (3, "zone", "Thingusa North", None, None), (4, "zone", "Thingusa West", None, None), (5, "village", "Lenumkudi", None, None)]


def test_places(spark):
    kind = "doc_id string, district string, village string, zone string, place_name string"
    rows = [("a", "Sorpede", "Lenumkdi (V)", "North Thingusa", "x"), ("b", "Srpede Dist.", "Ward 7", "Thingusa W.", "x"), ("c", "சொர்பெடெ", None, "Thingusa", "x"), ("d", "Oldname", "-", "?", "x"), ("d", "Oldname", "-", "?", "x"), ("e", "SORPEDE", "", "null", "x")]
    head = spark.createDataFrame(rows, kind)
    ref = spark.createDataFrame(PLACES, "place_id int, place_kind string, place_name string, name_ta string, former_name string")
    got = {(r["doc_id"], r["field_name"]): r["place_id"] for r in P.placed(head, ref).collect()}
    assert got == {("a", "village"): 5, ("a", "zone"): 3, ("b", "district"): 1, ("b", "village"): 0, ("b", "zone"): 4, ("c", "district"): 1, ("c", "zone"): 0, ("d", "district"): 2, ("d", "zone"): 0, ("e", "district"): 1}
    assert P.placed(head, ref.filter("false")).filter("place_id <> 0").count() == 0
    assert P.placed(head.filter("false"), ref).count() == 0
