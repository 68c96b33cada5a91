"""The register operators on a small synthetic register with its edge rows."""

import datetime as dt

import pytest

from titlegrain.operators import register as R

SCHEMA = """doc_id string, seq int, sr int, doc_no_year string, execution_date date, presentation_date date, registration_date date, nature string,
executants string, claimants string, vol_page string, consideration string, consideration_amt decimal(18,2), market_value string, market_value_amt decimal(18,2),
pr_numbers string, remarks string, page_index int, schedules array<struct<survey_no:string,extent:string,village_street:string,plot_no:string,flat_no:string,door_no:string,boundaries:string>>, loaded_at timestamp"""


def row(doc, seq, no, nature, exe, cla, pr=None, survey="10/2A", sr="same", remarks=None, date=dt.date(2010, 1, 1)):
    sch = [(survey, None, None, None, None, None, None)] if survey else []
    return (doc, seq, seq if sr == "same" else sr, no, date, date, date, nature, exe, cla, "-", "-", None, "None", None, pr, remarks, 0, sch, dt.datetime(2020, 1, 1))


BASE = [
    row("d", 1, "100/2008", "Conveyance", "1. Alpha Homes Pvt Ltd", "1. P. One", "45/1995"),
    row("d", 2, "200/2012", "MODT / Deposit of Title Deeds", "1. P. One", "1. Example Bank", "100/2008"),
    row("d", 3, "300/2018", "Receipt / Mortgage Discharge", "1. Example Bank", "1. P. One", "200/12"),
    row("d", 4, "400/2023", "Conveyance", "1. P. One", "1. P. Two", "100/2008", sr=7),
]


@pytest.fixture(scope="module")
def reg(spark):
    extra = [BASE[0], row("e", 1, "-", None, None, "Not Detected", survey=None), row("e", 2, "9/2001", "Simple mortgage", "1. Q", "1. Other Bank")]
    return R.register(spark.createDataFrame(BASE + extra, SCHEMA)).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_register_drops_repeats_and_sentinels(reg):
    assert reg.count() == 6
    assert rows(reg.filter("doc_id = 'e'"), "seq", "doc_no", "claimants") == [(1, None, None), (2, "9/2001", "1. Other Bank")]


def test_gaps(reg):
    assert rows(R.serial_gaps(reg), "doc_id", "prev_sr", "next_sr", "missing", "missing_range") == [("d", 3, 7, 3, "4-6")]


def test_loans(reg, spark):
    assert rows(R.loan_match_first(reg), "doc_id", "seq", "discharge_seq") == [("d", 2, 3), ("e", 2, None)]
    assert rows(R.loan_match_after(reg), "doc_id", "seq", "party_key", "discharge_seq") == [("d", 2, "pone", None), ("e", 2, "q", None)]  # a short year is no reference here
    assert rows(R.loan_status(reg), "doc_id", "loans", "closed", "open", "closed_pct") == [("d", 1, 1, 0, 100.0), ("e", 1, 0, 1, 0.0)]
    early = R.register(spark.createDataFrame([row("x", 1, "5/2001", "Receipt", "1. B Bank", "1. A", "6/2002"), row("x", 2, "6/2002", "Simple mortgage", "1. A", "1. B Bank")], SCHEMA))
    assert rows(R.loan_match_first(early), "discharge_seq") == [(1,)]
    assert rows(R.loan_match_after(early), "discharge_seq") == [(None,)]


def test_loans_by_any_party(spark):
    """Later parties, other spellings, words within words, and entries without a schedule close a loan too."""
    lists = [
        row("x", 1, "1/2001", "Simple mortgage", "1. P. Aaaa 2. Singamathi R", "1. Example Holdings Ltd"),
        row("x", 2, "2/2001", "Simple mortgage", "1. Velumani", "1. First Bank"),
        row("x", 3, "3/2001", "Simple mortgage", "1. Nobody", "1. First Bank"),
        row("x", 4, "4/2002", "Receipt", "1. Example Holdings Limited", "1. Tmt. Singamathi, wife of R", survey=None),
        row("x", 5, "5/2002", "Receipt", "1. Other Banking Company", "1. K. Velumanickam 2. Velumani", survey="9/9"),
    ]
    reg = R.register(spark.createDataFrame(lists, SCHEMA))
    assert rows(R.loan_match_first(reg), "seq", "discharge_seq") == [(1, 4), (2, 5), (3, None)]
    assert rows(R.loan_status(reg), "loans", "closed", "open") == [(3, 2, 1)]


def test_one_discharge_is_used_once(spark):
    two = [row("x", 1, "1/2001", "Simple mortgage", "1. A", "1. B Bank"), row("x", 2, "2/2001", "Simple mortgage", "1. A", "1. B Bank"), row("x", 3, "3/2002", "Receipt", "1. B Bank", "1. A")]
    assert rows(R.loan_match_rank(R.register(spark.createDataFrame(two, SCHEMA))), "seq", "discharge_seq") == [(1, 3), (2, None)]


def test_holder_and_chain(reg):
    assert rows(R.holder(reg), "doc_id", "holder", "doc_no", "role") == [("d", "1. P. Two", "400/2023", "purchaser"), ("e", "1. Q", "9/2001", "mortgagor")]
    assert rows(R.title_chain(reg), "step", "steps", "buyer") == [(1, 2, "1. P. One"), (2, 2, "1. P. Two")]
    assert rows(R.transfers(reg), "seq", "next_owner") == [(1, "1. P. Two"), (4, None)]


def test_parties(reg):
    got = rows(R.parties(reg).filter("doc_id = 'd' AND seq = 1"), "side", "ordinal", "party", "entity")
    assert got == [("claimant", 1, "P. One", "individual"), ("executant", 1, "Alpha Homes Pvt Ltd", "company")]


def test_mortgagor_closes(spark):
    """Only a later receipt of the mortgagor closes, whoever else stands beside them."""
    deeds = [
        row("x", 1, "7/2001", "Receipt", "1. B Bank", "1. A", "8/2002"),
        row("x", 2, "8/2002", "Simple mortgage", "1. A 2. C", "1. B Bank"),
        row("x", 3, "9/2003", "Receipt", "1. B Bank", "1. Somebody", "8/2002"),
        row("x", 4, "10/2004", "Receipt", "1. B Bank", "1. Z 2. C", "8/2002"),
        row("x", 5, None, "Simple mortgage", None, "1. B Bank"),
    ]
    reg = R.register(spark.createDataFrame(deeds, SCHEMA))
    assert rows(R.loan_match_after(reg).fillna(0).fillna(""), "seq", "party_key", "discharge_seq") == [(2, "a", 0), (2, "c", 4), (5, "", 0)]
    assert rows(R.active_mortgages(reg), "party_key", "mortgages", "active") == [("a", 1, True), ("c", 1, False)]


def test_no_mortgage_is_lost(spark):
    """Mortgages without a survey number or parties stay open; an only pair meets."""
    deeds = [row("x", 1, "1/2001", "Simple mortgage", None, "1. B Bank"), row("x", 2, "2/2001", "Simple mortgage", "1. A", "1. B Bank", survey=None), row("y", 1, "1/2001", "MODT", "1. A", "1. B Bank", survey=None), row("y", 2, "2/2001", "Receipt", "1. D", "1. E")]
    reg = R.register(spark.createDataFrame(deeds, SCHEMA))
    assert rows(R.loan_match_rank(reg).fillna(0), "doc_id", "seq", "discharge_seq") == [("x", 1, 0), ("x", 2, 0), ("y", 1, 2)]


def test_last_delivery_wins_and_plans_are_narrow(spark):
    late = list(row("x", 1, "1/2001", "Sale deed", "1. A", "1. B"))
    late[-1], late[7] = dt.datetime(2021, 1, 1), "Gift deed"
    reg = R.register(spark.createDataFrame([row("x", 1, "1/2001", "Sale deed", "1. A", "1. B"), tuple(late), row("x", 1, "1/2001", "Sale deed", "1. A", "1. B")], SCHEMA))
    assert rows(reg, "nature") == [("Gift deed",)]
    plan = R.kinds(reg)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [line for line in plan.splitlines() if "Aggregate" in line]
    assert grouped and not any("remarks" in line or "boundaries" in line for line in grouped)


def test_gaps_across_ranges(spark):
    deeds = [row("x", i, f"{i}/2001", "Sale", "1. A", "1. B", sr=sr) for i, sr in enumerate([1, 2, 5, 8, 9, 10, 17, 17, 18], 1)]
    reg = R.register(spark.createDataFrame(deeds, SCHEMA))
    want = [(2, 5), (5, 8), (10, 17)]
    for span in (1, 2, 3, 4, 100):
        assert rows(R.serial_gaps(reg, span), "prev_sr", "next_sr") == want


@pytest.mark.parametrize("seed", range(3))
def test_holding_equals_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    make = lambda n: "".join(r.choice("abc") for _ in range(n))
    parts, wholes = [make(r.randint(1, 6)) for _ in range(40)], [make(r.randint(0, 9)) for _ in range(60)]
    got = rows(R.holding(spark.createDataFrame([(x,) for x in parts], "word string"), spark.createDataFrame([(x,) for x in wholes], "whole string")), "word", "whole")
    assert got == sorted({(p, w) for p in parts for w in wholes if p in w})


def test_folded_lists(spark):
    lists = spark.createDataFrame([("d", 1, "c", 1, "Alpha Homes"), ("d", 1, "c", 2, "ALPHA HOMES PVT"), ("d", 1, "c", 3, "Beta")], "doc_id string, seq int, side string, ordinal int, party string")
    assert rows(R.drop_shorter_spellings(lists), "ordinal", "party") == [(1, "Alpha Homes"), (3, "Beta")]


def test_empty_register(spark):
    none = R.register(spark.createDataFrame([], SCHEMA))
    for out in (R.serial_gaps(none), R.loan_status(none), R.holder(none), R.title_chain(none), R.parties(none), R.nature_histogram(none)):
        assert out.count() == 0
