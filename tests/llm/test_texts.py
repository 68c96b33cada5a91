import numpy as np
import pytest

from titlegrain.llm import encodings as E
from titlegrain.llm import lookalikes as L
from titlegrain.llm import pages as G
from titlegrain.llm import personal as P


def test_lookalikes(spark):
    texts = ["Ｓａｌｅ deed", "Sаle deed", "Sale deed", "Sa​le deed", "Cession à titre", "Cession à titre", "SALE DEED", "பா௧ப்பிரிவினை", "௨ 12", "speciﬁc", "II", "Ⅱ", None, "", "Sale deed", "x" * 20000 + "​"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, value string")
    got = {r["id"]: (r["canonical"], r["imitates"]) for r in L.one_form(rows).collect()}
    assert [got[i][1] for i in range(len(texts))] == [True, True, True, True, True, False, False, True, False, True, False, True, False, False, False, True]
    assert got[0][0] == got[1][0] == got[2][0] == got[3][0] == "Sale deed" and got[4][0] == "Cession à titre" and got[7][0] == "பாகப்பிரிவினை" and got[9][0] == "specific" and got[12][0] is None
    clash = L.one_form(rows.withColumnRenamed("id", "canonical"), only_imitating=True)
    assert clash.columns == ["value", "canonical", "imitates"] and clash.count() == 9
    assert L.one_form(rows.filter("false")).count() == 0


CHAINS = [("cp1252",), ("latin-1",), ("cp437",), ("cp866",), ("mac_roman",)]


def garble(text, chain):
    for page in chain:
        data = text.encode("utf-8")
        text = "".join(bytes([b]).decode(page) if page != "cp1252" or b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in data)
    return text


@pytest.mark.parametrize("chain", [*CHAINS, ("cp1252", "cp1252")])
@pytest.mark.parametrize("text", ["ச. ரகுகொடி அவர்களுக்கு", "Note – the applicant’s copy bears ₹ 20", "extent of 1½ Acres"])
def test_round_trip(chain, text):
    restored, name = E.repair(garble(text, chain))
    assert restored == text and name != "clean"


def test_clean_texts_stay():
    for text in ("Ângela Sorvall", "Hôtel Côte Blanche", "Sainte-Élande", "Note – “so”", "தமிழ்", "", "plain"):
        assert E.repair(text) == (text, "clean")


def test_garbled(spark):
    rows = [("s", "f", "1", garble("ச. ரகுகொடி", ("cp1252",))), ("s", "f", "2", "Hôtel Côte"), ("s", "f", "3", "m� � x"), ("s", "f", "4", None), ("s", "f", "5", ""), ("s", "f", "1", garble("ச. ரகுகொடி", ("cp1252",)))] + [("s", "f", f"n{i}", "plain") for i in range(20)]
    df = spark.createDataFrame(rows, "src string, field_name string, rec_key string, text string")
    assert sorted(r["rec_key"] for r in E.garbled(df).collect()) == ["1", "3"]
    back = {r["rec_key"]: (r["restored"], r["whole"]) for r in E.restored(df).collect()}
    assert back["1"] == ("ச. ரகுகொடி", True) and back["3"][1] is False
    assert E.garbled(df.filter("false")).count() == 0


CLEAN = ["The property is bounded on the north by the registered survey number and the office has been found in order.", "The schedule describes a vacant site with common passage on the west side of the property in this office."]
NOISY = {
    "h": ("The prop-\nerty is bounded on the north", {"hyphen"}),
    "m": ("The pr0perty is bounded on the nortb by the re9istered survey", {"misread"}),
    "p": ("The property is bounded\n[2]\non the north", {"pageno"}),
    "r": ("REGISTRATION DEPARTMENT   A0000001    Page 2 of 3\nThe property is bounded on", {"header", "pageno"}),
    "x": ("The pro-\nOffice of the Sub Registrar :: C/1/2019\nperty is bounded", {"header", "hyphen"}),
    "c": ("The property in Sainte-\nÉlande is bounded on 27-\nMar-2017", set()),
    "d": ("Rs. 12,000/-\nassessed by the office 12/7A1 and RYV6863001 mail a.b1@x.example", set()),
    "n": ("", set()),
    "o": ("The property is bounded\n[7]\non the north", set()),  # another page's number
    "s": ("PHONE OF THE PERSON   044 1234567\nThe property is bounded on", set()),  # recurs, but with other digits
    "t": ("Index copy of the registrar\nThe property is bounded on", {"header"}),
}
#: Pages of other certificates, on which the header lines recur: with the certificate's digits, its number, or word for word.
RECURRING = [(f"EC-{i}", page, line) for i in range(40, 52) for page in (1, 2) for line in (f"REGISTRATION DEPARTMENT   A{i * 7}", f"Office of the Sub Registrar :: C/{i}/2019", f"PHONE OF THE PERSON   044 {i * page * 7919}", "Index copy of the registrar")]


def test_page_noise(spark):
    rows = [("ec", f"g{i}", "EC-7", 1, CLEAN[i % 2]) for i in range(60)] + [("ec", k, "EC-1", 2, t) for k, (t, _) in NOISY.items()] + [("ec", "null", "EC-1", 1, None)]
    rows += [("ec", f"r{i}", doc, page, f"{CLEAN[0]}\n{line}\n{CLEAN[1]}") for i, (doc, page, line) in enumerate(RECURRING)]
    df = spark.createDataFrame(rows, "src string, rec_key string, doc_id string, page_number int, text string").filter("text IS NOT NULL AND text <> ''")
    got: dict = {}
    for r in G.noise(df).collect():
        got.setdefault(r["rec_key"], set()).add(r["noise"])
    assert {k: v for k, v in got.items() if k[0] != "r" or k == "r"} == {k: v for k, (_, v) in NOISY.items() if v}
    assert {k: v for k, v in got.items() if k[0] == "r" and k != "r"} == {f"r{i}": {"header"} for i, (_, _, line) in enumerate(RECURRING) if not line.startswith("PHONE")}
    fixed = {r["rec_key"]: r["text"] for r in G.repair(df).collect()}
    assert fixed["h"].startswith("The property is bounded") and "property" in fixed["m"] and "[2]" not in fixed["p"] and fixed["x"].startswith("The property")
    assert G.noise(df.filter("false")).count() == 0


def test_stretches_equal_whole_decoding():
    counts = {w: 50 for t in CLEAN for w in t.lower().strip(".").split()}
    decoder = G.Decoder(counts)
    for text, _ in NOISY.values():
        lines, noise = G.split_lines(text, 2)
        assert G.noise_of(text, decoder, 2) == noise | decoder.decode(G.stream(lines))[1]


@pytest.mark.parametrize("most", [0, 1, 8, 30])
def test_rarer_words_are_joined(spark, monkeypatch, most):
    # Names counted 6 times each are rarer than the sentences' words; all of their readings stay.
    names = ["Kurinjipakkam", "Vennilavu", "Marudhampet", "Sirukadal", "Poongulam", "Nedunchalai"]
    odd = ["The plot in Kur1njipakkam is bounded", "The plot in Vennil-\navu is bounded on", "The plot of Sirukadalproperty and Poon gulam", "The Marudharnpet Nedunch@lai office", "The qzqzq in the office"]
    rows = [("ec", f"g{i}", "EC-7", 1, f"{CLEAN[i % 2]} {names[i % 6]} lies there.") for i in range(36)] + [("ec", f"o{i}", "EC-8", 2, t) for i, t in enumerate(odd)] + [("ec", None, "EC-9", None, odd[0])]
    rows += [("ec", k, "EC-1", 2, t) for k, (t, _) in NOISY.items() if t] + rows[:3]
    df = spark.createDataFrame(rows, "src string, rec_key string, doc_id string, page_number int, text string")
    found, fixed = (sorted(map(str, f(df).collect())) for f in (G.noise, G.repair))
    assert {r["rec_key"] for r in G.noise(df).collect() if r["noise"] == "misread"} >= {"o0", "o3", None}
    monkeypatch.setattr(G, "LEXICON", most)
    words = G.word_counts(df)
    known = G.lexicon(words)
    assert len(known.counts) <= most and known.total == sum(r["n"] for r in words.collect()) and all(r["word"] in known.counts or r["word"] in known.rare for r in words.collect())
    assert sorted(map(str, G.noise(df).collect())) == found and sorted(map(str, G.repair(df).collect())) == fixed


def test_long_forms(spark):
    long, dense = "thiruvananthapurampanchayatcommitteeofficebuilding", "committeeforbirthcertificatecopy"
    decoder = G.Decoder({long: 50, dense: 50})
    assert decoder.read(long) == (long, 0.6931471805599453, 0)
    assert decoder.read(long.replace("a", "@", 2).replace("building", "bui1ding"))[::2] == (long, 3)
    assert decoder.read(long.replace("com", "corn"))[::2] == (long, 1) and decoder.read(long.replace("a", "@", 4))[2] == -1
    assert decoder.read(dense.replace("e", "c", 3))[::2] == (dense, 3)  # many places, three confusions
    assert decoder.read("m" * 5000)[2] == -1
    seldom, meant = "thiruvananthapurarncommitteebuildings", "thiruvananthapuramcommitteebuildings"
    first = G.Decoder({seldom: 3}, 10**6, 1000, {seldom, meant})  # the one is long enough to be broadcast, the other is not
    assert first.read(seldom)[2] == -1 and first.asked == {seldom, meant}
    df = spark.createDataFrame([(f"a {long} b",)] * 6, "text string")
    assert G.lexicon(G.word_counts(df)).counts[long] == 6


def test_long_forms_as_short_ones(monkeypatch):
    counts = {"modern": 50, "modem": 300, "return": 40, "retum": 90, "lined": 9, "oil": 60}
    forms = ["m0dern", "modern", "rnodern", "rnodem", "retu(n", "1ined", "lincd", "clear", "0i1", "0|1", "2oil", "vv", "cliri1"]
    short = [G.Decoder(counts).read(f) for f in forms]
    monkeypatch.setattr(G, "LONG", 0)
    assert [G.Decoder(counts).read(f) for f in forms] == short


def test_long_noisy_text():
    decoder = G.Decoder({w: 50 for t in CLEAN for w in t.lower().strip(".").split()})
    text = "\n".join("The pr0perty qq zz prop-\nerty" for _ in range(20_000))
    assert G.noise_of(text, decoder, 1) == {"hyphen", "misread"}


def test_paragraphs():
    lines = ["one two three four five six", "seven eight nine ten eleven", "twelve.", "Another one begins here and", "goes on."]
    assert [len(g) for g in G.paragraphs(lines)] == [3, 2]
    assert [len(g) for g in G.paragraphs(["CERTIFICATE OF TITLE HERE", "The first line of a text that", "goes on."])] == [1, 2]
    assert len(G.paragraphs(["word " * 10] * 50_000)) >= 1  # linear in the lines
    assert G.paragraphs([]) == [] and [len(g) for g in G.paragraphs(["a", "", "b"])] == [1, 1]


def test_personal_held_out():
    tagger = P.Tagger(P.model())
    rows = P.labelled_table(2, seed=77)
    found = tagger.labels([" ".join(w) for w, _ in rows])
    right = sum(int((f == np.array(g)).sum()) for f, (_, g) in zip(found, rows))
    assert right / sum(len(w) for w, _ in rows) > 0.99


def test_personal(spark):
    texts = {"1": "1. V. Nilavel, e-mail nila.vel@post.example.org", "2": "Kuringi Traders Savings Bank Limited, ID XXXX XXXX 1234", "3": "Mob: 09555123456", "4": "Proof of identity: 1234-5678-9012", "5": "The applicant resides at No. 12, Potters Street, Puricheri - 600001.", "6": "survey number 12/7A measures 120 Sft"}
    rows = [("ec", k, t, "clash") for k, t in texts.items()] + [("ec", "1", texts["1"], "clash"), ("ec", "7", "x " * 30000 + texts["3"], "y")]
    df = spark.createDataFrame(rows, "src string, rec_key string, text string, pii_type string").select("src", "rec_key", "text")
    got: dict = {}
    for r in P.found_types(df).collect():
        got.setdefault(r["rec_key"], set()).add(r["pii_type"])
    assert got == {"1": {"NAME", "EMAIL"}, "3": {"PHONE"}, "4": {"IDNUM"}, "5": {"ADDRESS"}, "7": {"PHONE"}}
    shown = {r["rec_key"]: r["text"] for r in P.redacted(df).collect()}
    assert shown["4"] == "Proof of identity: [IDNUM]" and shown["2"] == texts["2"]


def test_viterbi_equals_brute_force():
    tagger = P.Tagger(P.model())
    random = np.random.default_rng(0)
    score = random.standard_normal((3, 4, 6)).astype(np.float32)
    got = tagger._viterbi(score.copy(), np.array([4, 4, 4]))
    import itertools

    for r in range(3):
        best = max(itertools.product(range(6), repeat=4), key=lambda p: tagger.model.start[p[0]] + sum(score[r, t, p[t]] for t in range(4)) + sum(tagger.model.move[p[t - 1], p[t]] for t in range(1, 4)))
        assert tuple(got[r]) == best
