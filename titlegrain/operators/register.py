"""The register of transactions: filters, links, holders, parties, gaps.

Every function takes and returns DataFrames. ``register`` makes the clean form that the
others expect; "first" and "last" follow ``seq``, never a date. Within one certificate the
functions group by finer keys than the certificate wherever the meaning allows, so that one
certificate with a third of all rows is spread; what is per certificate by nature is
aggregated on the map side first (``max_by`` and counts instead of collected lists).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.nulls import nullify, nullify_amount

# Words that tell the kind of a deed, by rule set (F2): ``register`` for flags of a
# certificate, ``filter`` for the property filter, ``owners`` for the registry of owners, ``screen``
# for the greedy matching of loans. The lists differ by purpose.
RULES = {
    "register": {
        "mortgage": ["mortgage", "deposit of title", "modt", "hypothèque", "அடமான", "அடைமான", "உரிமை வைப்பு", "ஒப்படைப்பு", "ஒப்பைடப்பு", "ஈடு", "கடன்"],
        "discharge": ["receipt", "discharge", "ரசீது", "மீட்சி"],
        "conveyance": ["sale", "conveyance", "settlement", "gift", "partition", "cession", "கிரைய", "கிைரய", "விற்பனை", "விற்பைன", "செட்டில்மெ", "தான", "பாகப்பிரிவினை", "உரிமை மாற்றம்"],
        "court": ["court", "attach", "decree", "injunction", "நீதிமன்ற"],
        "rectification": ["rectification", "திருத்தம்", "பிழைதிருத்தல்"],
        "lease": ["lease", "குத்தகை"],
        "family": ["settlement", "partition", "release", "gift", "செட்டில்மெ", "பாகப்பிரிவினை", "விடுதலை"],
        "attorney": ["power of attorney", "பொது அதிகார"],
    }
}
RULES["filter"] = RULES["register"] | {
    "mortgage": ["mortgage", "modt", "deposit of title", "charge", "hypothecation", "hypothèque", "அடமான"],
    "discharge": ["receipt", "discharge", "release", "ரசீது", "விடுதலை"],
    "conveyance": ["conveyance", "sale", "settlement", "gift", "partition", "release", "cession", "கிரைய", "செட்டில்மென்ட்", "பாகப்பிரிவினை", "தான"],
    "court": ["court", "attachment", "injunction", "decree", "lis pendens", "o[.]s[.]", "e[.]p[.]", "c[.]s[.]", "w[.]p[.]", "suit", "stay", "order", "நீதிமன்ற", "பற்று", "தடை", "வழக்கு"],
}
RULES["owners"] = RULES["register"] | {
    "mortgage": ["mortgage", "அடைமானம்", "ஈடு", "ஒப்படைப்பு", "ஒப்பைடப்பு", "உரிமை ஆவண", "modt", "deposit of title"],
    "discharge": ["receipt", "இரசீது", "ரசீது", "discharge", "release", "விடுதலை"],
}
RULES["screen"] = RULES["register"] | {"mortgage": ["mortgage", "modt", "deposit of title", "ஈடு", "அடமான", "அடைமானம்", "உரிமை வைப்பு", "ஒப்படைப்பு", "ஒப்பைடப்பு", "உரிமை ஆவண", "கடன் திரும்ப", "பணயம்"]}


def register(entries: DataFrame) -> DataFrame:
    """The clean register. Sentinels become NULL, a missing ``sr`` falls back to ``seq``;
    ``survey_no`` and its neighbours are those of the first schedule, ``schedule_text`` holds the
    survey numbers, extents, plots and boundaries of all.

    A repeated delivery gives one row per (``doc_id``, ``seq``), with the values of the last one by
    ``loaded_at``. Each column is an aggregate of its own, so that the scan and the shuffle of a
    query carry only the columns it uses.
    """
    text = ["nature", "executants", "claimants", "remarks", "vol_page", "consideration", "market_value"]
    one = ["survey_no", "extent", "village_street", "plot_no", "flat_no", "door_no", "boundaries"]
    first = F.try_element_at("schedules", F.lit(1))
    columns = {
        "sr": F.coalesce("sr", "seq"),
        "doc_no": nullify(F.col("doc_no_year")),
        **{c: F.col(c) for c in ("execution_date", "presentation_date", "registration_date")},
        **{c: nullify(F.col(c)) for c in text},
        "pr_numbers": nullify_amount(F.col("pr_numbers")),
        **{c: F.col(c) for c in ("consideration_amt", "market_value_amt", "page_index")},
        **{c: nullify(first[c]) for c in one},
        "schedule_text": F.array_join(F.transform(F.coalesce("schedules", F.array()), lambda x: F.concat_ws(" ", x["survey_no"], x["extent"], x["plot_no"], x["boundaries"])), " "),
    }
    return latest(entries, ["doc_id", "seq"], columns)


def latest(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """The columns of the last delivery of each key (any one, where there is no ``loaded_at``)."""
    last = (lambda c: F.max_by(c, F.coalesce("loaded_at", F.lit("1700-01-01").cast("timestamp")))) if "loaded_at" in rows.columns else F.first
    return rows.groupBy(*keys).agg(*[last(c).alias(n) for n, c in columns.items()])


def is_kind(kind: str, rules: str = "register", col: str = "nature") -> Column:
    """Whether the deed's nature is of a kind; a discharge is no mortgage, a release no lease."""
    words = RULES[rules]
    found = S.contains_any(F.col(col), words[kind])
    if kind == "mortgage":
        return found & ~S.contains_any(F.col(col), words["discharge"])
    if kind == "lease":
        return found & ~S.contains_any(F.col(col), ["release"])
    return found


def kinds(reg: DataFrame, rules: str = "register") -> DataFrame:
    """one flag for each kind."""
    return reg.select("doc_id", "seq", "nature", *[is_kind(k, rules).alias(f"is_{k}") for k in RULES[rules]])


def court_entries(reg: DataFrame) -> DataFrame:
    """entries whose nature, remarks or parties name a court, and where."""
    words = ["court", "நீதிமன்ற"]
    places = F.array_compact(F.array(*[F.when(S.contains_any(F.col(c), words), F.lit(c)) for c in ("nature", "remarks", "executants", "claimants")]))
    return reg.withColumn("places", places).filter(F.size("places") > 0).select("doc_id", "seq", F.array_join("places", ",").alias("places"))


def serial_gaps(reg: DataFrame, span: int = 4096) -> DataFrame:
    """Gaps in the serial numbers of a certificate, with the neighbours on both sides.

    Repeated numbers count once; a gap before the first number is none. Neighbours are found
    within ranges of ``span`` numbers, and the ends of the ranges among themselves, so that a
    certificate of any size is spread over its ranges.
    """
    serials = reg.filter("sr IS NOT NULL").groupBy("doc_id", "sr").agg(F.min_by("doc_no", "seq").alias("doc_no")).withColumn("part", F.floor(F.col("sr") / span))

    def neighbours(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy("doc_id", *by).orderBy("sr")
        return rows.withColumn("next_sr", F.lead("sr").over(order)).withColumn("next_doc", F.lead("doc_no").over(order))

    ends = serials.groupBy("doc_id", "part").agg(F.min_by(F.struct("sr", "doc_no"), "sr").alias("a"), F.max_by(F.struct("sr", "doc_no"), "sr").alias("b"))
    order = Window.partitionBy("doc_id").orderBy("part")
    across = ends.select("doc_id", F.col("b.sr").alias("sr"), F.col("b.doc_no").alias("doc_no"), F.lead("a").over(order).alias("n")).select("doc_id", "sr", "doc_no", F.col("n.sr").alias("next_sr"), F.col("n.doc_no").alias("next_doc"))
    gaps = neighbours(serials, "part").drop("part").unionByName(across).filter("next_sr > sr + 1")
    first, last = (F.col("sr") + 1).cast("string"), (F.col("next_sr") - 1).cast("string")
    return gaps.select("doc_id", F.col("sr").alias("prev_sr"), F.col("doc_no").alias("prev_doc"), "next_sr", "next_doc", (F.col("next_sr") - F.col("sr") - 1).alias("missing"), F.when(first == last, first).otherwise(F.concat(first, F.lit("-"), last)).alias("missing_range"))


def nature_histogram(reg: DataFrame) -> DataFrame:
    """A2: entries by the first line of their nature and certificate; NULL counts as ``Other``."""
    kind = F.coalesce(F.trim(F.split("nature", "\n")[0]), F.lit("Other"))
    return reg.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def parties(reg: DataFrame) -> DataFrame:
    """X11: one row for each party of an entry, with its side and place in the list."""
    one = lambda side, col: F.transform(F.coalesce(S.party_items(F.col(col)), F.array()), lambda p, i: F.struct(F.lit(side).alias("side"), (i + 1).alias("ordinal"), p.alias("party")))
    rows = reg.select("doc_id", "seq", "survey_no", "doc_no", "nature", F.inline(F.concat(one("executant", "executants"), one("claimant", "claimants"))))
    return rows.withColumn("entity", S.entity_type(F.col("party"))).withColumn("party_key", S.party_key(F.col("party")))


def references(reg: DataFrame) -> DataFrame:
    """Prior documents an entry refers to, ``number/year`` as written, once each."""
    text = F.concat_ws(" ", "pr_numbers", "remarks")
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"([0-9]{1,6}/[0-9]{2,4})\b"), F.lit(1)))
    return reg.select("doc_id", "seq", F.explode(found).alias("ref"))


def _doc_keys(doc: Column) -> Column:
    """A document number as referred to: with the whole year and with its last two digits."""
    return F.array_distinct(F.array(doc, F.regexp_replace(doc, r"/[0-9]{2}([0-9]{2})$", "/$1")))


def _party_links(reg: DataFrame, kind: str, lender: str, borrower: str) -> DataFrame:
    """``doc_id, survey_no, lender, borrower, seq`` of the deeds of a kind, by first party of each side."""
    key = lambda c: S.party_key(F.try_element_at(S.party_items(F.col(c)), F.lit(1)))
    return reg.filter(is_kind(kind, "screen")).select("doc_id", "survey_no", key(lender).alias("lender"), key(borrower).alias("borrower"), "seq")


def _words(*cols: str) -> Column:
    """The distinct words over three letters, between blanks as written, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", *cols)), r"\s+"), lambda w: F.length(w) > 3))


def holding(words: DataFrame, longer: DataFrame) -> DataFrame:
    """``word, whole``: the strings of ``longer`` that hold a word of ``words``, each pair once.

    Exact for words of any length: they meet by the first four letters of the word (all of a
    shorter one), so that no word is compared with every string.
    """
    asked = words.filter("word <> ''").distinct().withColumn("k", F.substring("word", 1, 4))
    sizes = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("whole") - n + 1, F.lit(1))), lambda i: F.substring("whole", i, n)))
    met = longer.filter("whole <> ''").distinct().withColumn("k", F.explode(F.array_distinct(F.flatten(sizes))))
    return asked.join(met, "k").filter(F.contains("whole", "word")).select("word", "whole")


def _paid_by_words(reg: DataFrame) -> DataFrame:
    """``doc_id, seq, by_words``: the first discharge whose executants hold a word of the lender,
    or ``bank`` where both do, and whose claimants hold a word of the borrower.

    Every deed emits pairs of words; the discharges keep the first of each pair and certificate,
    so that a mortgage meets one row a pair and no pairs of deeds are made.
    """
    bank = lambda c: F.when(F.contains(F.lower(c), F.lit("bank")), F.array(F.lit(" bank"))).otherwise(F.array().cast("array<string>"))
    owed = reg.filter(is_kind("mortgage")).select("doc_id", "seq", _words("claimants").alias("l"), _words("executants").alias("b"), bank("claimants").alias("mark"))
    paid = reg.filter(is_kind("discharge")).select("doc_id", "seq", _words("executants").alias("l"), _words("claimants").alias("b"), bank("executants").alias("mark"))
    said = F.explode(F.array_union("l", "b"))
    held = holding(owed.select(said.alias("word")), paid.select(said.alias("whole")))
    keys = lambda c: paid.select("doc_id", "seq", F.explode(c).alias("whole")).join(held, "whole").select("doc_id", "seq", F.col("word").alias(c)).distinct()
    lenders = keys("l").unionByName(paid.select("doc_id", "seq", F.explode("mark").alias("l")))
    first = lenders.join(keys("b"), ["doc_id", "seq"]).groupBy("doc_id", "l", "b").agg(F.min("seq").alias("by_words"))
    asked = owed.select("doc_id", "seq", F.explode(F.concat("l", "mark")).alias("l"), "b").withColumn("b", F.explode("b"))
    return asked.join(first, ["doc_id", "l", "b"]).groupBy("doc_id", "seq").agg(F.min("by_words").alias("by_words"))


def loan_match_first(reg: DataFrame) -> DataFrame:
    """The first discharge, in register order, of every mortgage; NULL where it is open.

    A discharge fits if it refers to the mortgage's document, also in the two-digit form, or
    by its parties: a word over three letters of the lender in its executants (or ``bank`` in
    both) and one of the borrower in its claimants. No condition on order; one discharge may
    close many mortgages. Every deed emits its keys (documents referred to, pairs of words);
    the first discharge of a key is aggregated before a mortgage meets it, so that no pairs of
    deeds are made.
    """
    owed = reg.filter(is_kind("mortgage"))
    first = references(reg.filter(is_kind("discharge"))).groupBy("doc_id", "ref").agg(F.min("seq").alias("by_ref"))
    asked = owed.select("doc_id", "seq", F.explode(_doc_keys(F.col("doc_no"))).alias("ref"))
    by_ref = asked.join(first, ["doc_id", "ref"]).groupBy("doc_id", "seq").agg(F.min("by_ref").alias("by_ref"))
    found = owed.select("doc_id", "seq", "doc_no").join(by_ref, ["doc_id", "seq"], "left").join(_paid_by_words(reg), ["doc_id", "seq"], "left")
    return found.select("doc_id", "seq", "doc_no", F.least("by_ref", "by_words").alias("discharge_seq"))


def loan_match_after(reg: DataFrame) -> DataFrame:
    """The first discharge behind a party's mortgage that refers to its document and has the
    mortgagor among its claimants. One row per mortgage and mortgagor, open ones with NULL; a
    mortgage without executants has one row without a party."""
    rows = parties(reg)
    debtor = rows.filter((F.col("side") == "executant") & (F.col("party_key") != "")).filter(is_kind("mortgage", "owners")).select("doc_id", "seq", "party_key").distinct()
    owed = reg.filter(is_kind("mortgage", "owners")).select("doc_id", "seq", "doc_no").join(debtor, ["doc_id", "seq"], "left")
    paid = rows.filter((F.col("side") == "claimant") & is_kind("discharge", "owners")).select("doc_id", "seq", "party_key").distinct().join(references(reg.filter(is_kind("discharge", "owners"))), ["doc_id", "seq"])
    ahead = Window.partitionBy("doc_id", "ref", "party_key").orderBy("seq", "paid").rowsBetween(1, Window.unboundedFollowing)
    both = owed.filter("doc_no IS NOT NULL AND party_key IS NOT NULL").select("doc_id", F.col("doc_no").alias("ref"), "party_key", "seq", F.lit(0).alias("paid")).unionByName(paid.select("doc_id", "ref", "party_key", "seq", F.lit(1).alias("paid")))
    met = both.withColumn("discharge_seq", F.min(F.when(F.col("paid") == 1, F.col("seq"))).over(ahead)).filter("paid = 0 AND discharge_seq IS NOT NULL")
    return owed.select("doc_id", "seq", "party_key").join(met.select("doc_id", "seq", "party_key", "discharge_seq"), ["doc_id", "seq", "party_key"], "left")


def loan_match_rank(reg: DataFrame) -> DataFrame:
    """Each discharge used once. Within a survey number and pair of first parties the i-th
    mortgage meets the i-th discharge, which is what greedy matching in register order gives
    where every discharge of the pair fits. A mortgage without these keys stays open; the only
    mortgage of a certificate meets its only discharge whatever their parties are.

    The inventory's greedy fold over a whole certificate also takes references and single words
    as a fit; it is sequential by nature and would put a hot certificate into one task."""
    keys = ["doc_id", "survey_no", "lender", "borrower"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))
    all_owed, all_paid = _party_links(reg, "mortgage", "claimants", "executants"), _party_links(reg, "discharge", "executants", "claimants")
    owed = all_owed.dropna(subset=keys).withColumn("rank", rank)
    paid = all_paid.dropna(subset=keys).withColumn("rank", rank).withColumnRenamed("seq", "discharge_seq")
    known = owed.join(paid, [*keys, "rank"], "left").select("doc_id", "seq", "rank", "discharge_seq")
    count = lambda rows, n, s: rows.groupBy("doc_id").agg(F.count("*").alias(n), F.min("seq").alias(s)).filter(f"{n} = 1").select("doc_id", s)
    alone = count(all_owed, "n", "seq").join(count(all_paid, "m", "only_seq"), "doc_id")
    found = all_owed.select("doc_id", "survey_no", "seq").join(known, ["doc_id", "seq"], "left").join(alone, ["doc_id", "seq"], "left")
    return found.select("doc_id", "survey_no", "seq", "rank", F.coalesce("discharge_seq", "only_seq").alias("discharge_seq"))


def loan_status(reg: DataFrame) -> DataFrame:
    """A1: loans of each certificate, closed, open, share closed in per cent (half up)."""
    loans = loan_match_first(reg).groupBy("doc_id").agg(F.count("*").alias("loans"), F.count("discharge_seq").alias("closed"))
    court = reg.groupBy("doc_id").agg(F.count("*").alias("entries"), F.count_if(is_kind("court")).alias("court_cases"))
    joined = court.join(loans, "doc_id", "left").na.fill(0, ["loans", "closed"])
    return joined.select("doc_id", "entries", "loans", "closed", (F.col("loans") - F.col("closed")).alias("open"), "court_cases", F.round(F.coalesce(F.try_divide(F.col("closed") * 100.0, F.col("loans")), F.lit(0.0)), 1).alias("closed_pct"))


def holder(reg: DataFrame, unit: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The present holder of each unit.

    The claimant of the last conveyance; else, by the last entry: the executant of a
    mortgage, the claimant of a discharge; else the last claimant or executant.
    """
    pick = lambda cond, who: F.max_by(F.struct(F.col(who).alias("party"), "doc_no", "seq"), F.when(cond, F.col("seq")))
    conveyed = is_kind("conveyance") & F.col("claimants").isNotNull()
    last = F.max_by(F.struct("seq", "doc_no", is_kind("mortgage").alias("mortgage"), is_kind("discharge").alias("discharge"), "executants", "claimants"), "seq")
    found = reg.groupBy(*unit).agg(pick(conveyed, "claimants").alias("c"), last.alias("l"))
    other = F.when(F.col("l.mortgage"), F.col("l.executants")).when(F.col("l.discharge"), F.col("l.claimants")).otherwise(F.coalesce("l.claimants", "l.executants"))
    role = F.when(F.col("c.seq").isNotNull(), "purchaser").when(F.col("l.mortgage"), "mortgagor").when(F.col("l.discharge"), "discharged").otherwise("party")
    return found.select(*unit, F.coalesce("c.party", other).alias("holder"), F.when(F.col("c.seq").isNotNull(), F.col("c.doc_no")).otherwise(F.col("l.doc_no")).alias("doc_no"), F.coalesce("c.seq", "l.seq").alias("seq"), role.alias("role"))


def title_chain(reg: DataFrame) -> DataFrame:
    """The conveyances of each survey number of a certificate as numbered steps."""
    deeds = reg.filter(is_kind("conveyance") & F.col("survey_no").isNotNull())
    unit = Window.partitionBy("doc_id", "survey_no")
    step = F.row_number().over(unit.orderBy("seq"))
    return deeds.select("doc_id", "survey_no", step.alias("step"), F.count("*").over(unit).alias("steps"), "seq", "doc_no", F.col("executants").alias("seller"), F.col("claimants").alias("buyer"))


def transfers(reg: DataFrame) -> DataFrame:
    """For each conveyance of a unit, who took it over next and by which document."""
    unit = Window.partitionBy("doc_id", "survey_no").orderBy("seq")
    deeds = reg.filter(is_kind("conveyance") & F.col("survey_no").isNotNull())
    return deeds.select("doc_id", "survey_no", "seq", F.col("claimants").alias("owner"), F.lead("claimants").over(unit).alias("next_owner"), F.lead("doc_no").over(unit).alias("next_doc"))


def last_transaction(reg: DataFrame) -> DataFrame:
    """The last entry of each certificate."""
    last = F.max_by(F.struct("seq", "doc_no", "nature", "registration_date", "executants", "claimants"), "seq")
    return reg.groupBy("doc_id").agg(last.alias("l")).select("doc_id", "l.*")


def units(reg: DataFrame, whole: bool = False) -> DataFrame:
    """A4: entries by property unit: the first survey token, or the whole normalised survey number."""
    key = S.survey_normal(F.col("survey_no")) if whole else S.survey_token(F.col("survey_no"))
    return reg.withColumn("unit", key).filter("unit IS NOT NULL AND unit <> ''").groupBy("doc_id", "unit").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def party_profiles(rows: DataFrame) -> DataFrame:
    """A5: each party of a certificate: entries, distinct units, first spelling, loans taken."""
    side = F.col("side") == "executant"
    return rows.filter("party_key <> ''").groupBy("doc_id", "party_key").agg(
        F.min_by("party", F.struct("seq", "side", "ordinal")).alias("party"),
        F.count_distinct("seq").alias("entries"),
        F.count_distinct("survey_no").alias("units"),
        F.count_if(side & is_kind("mortgage")).alias("loans"),
        F.count_if(~side & is_kind("conveyance")).alias("bought"),
        F.count_if(side & is_kind("conveyance")).alias("sold"),
        F.max("seq").alias("last_seq"),
        F.first("entity").alias("entity"),
    )


def party_entries(rows: DataFrame) -> DataFrame:
    """A5: the entries of each party with its role, one row each (a list of any length stays rows)."""
    role = F.when(F.col("side") == "executant", "transferor").otherwise("transferee")
    return rows.filter("party_key <> ''").select("doc_id", "party_key", "seq", "doc_no", "nature", role.alias("role")).distinct()


def active_mortgages(reg: DataFrame) -> DataFrame:
    """A5: mortgages of each party, and whether one of them is not closed."""
    loans = loan_match_after(reg).filter("party_key IS NOT NULL")
    return loans.groupBy("doc_id", "party_key").agg(F.count("*").alias("mortgages"), F.count("discharge_seq").alias("closed")).withColumn("active", F.col("mortgages") > F.col("closed"))


def owner_groups(profiles: DataFrame) -> DataFrame:
    """Owners (bought more often than sold), former owners, institutions (banks and
    public bodies among the rest), and other parties."""
    owner = F.when(F.col("bought") > F.col("sold"), "current").when((F.col("bought") > 0) | (F.col("sold") > 0), "former")
    group = F.coalesce(owner, F.when(F.col("entity").isin("bank", "government"), "institution"), F.lit("other"))
    return profiles.select("doc_id", "party_key", "party", group.alias("owner_group"), F.col("entity").isin("bank", "government").alias("institution"))


def registry_summary(groups: DataFrame, unit_counts: DataFrame) -> DataFrame:
    """A3: seven counts of a certificate: owners, current and former ones, institutions, other
    parties, all parties, units."""
    counted = groups.groupBy("doc_id").agg(
        F.count_if(F.col("owner_group").isin("current", "former")).alias("owners"),
        *[F.count_if(F.col("owner_group") == g).alias(g) for g in ("current", "former")],
        F.count_if("institution").alias("institutions"),
        F.count_if(F.col("owner_group") == "other").alias("other"),
        F.count("*").alias("parties"),
    )
    per = unit_counts.groupBy("doc_id").agg(F.count("*").alias("units"))
    return counted.join(per, "doc_id", "left").withColumn("units", F.coalesce("units", F.lit(0)))


def dossier(profiles: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """The parties whose key equals that of a name, or whose spelling holds it, with their group."""
    key = S.party_key(F.lit(name))
    held = (F.col("party_key") == key) | F.contains(F.lower("party"), F.lower(F.lit(name)))
    return profiles.filter(held).join(groups.select("doc_id", "party_key", "owner_group"), ["doc_id", "party_key"])


def observed_span(reg: DataFrame) -> DataFrame:
    """Dates of the first and last entry in list order, and the years they span."""
    dated = reg.filter("registration_date IS NOT NULL")
    ends = dated.groupBy("doc_id").agg(F.min_by("registration_date", "seq").alias("first_date"), F.max_by("registration_date", "seq").alias("last_date"))
    return ends.withColumn("years", F.abs(F.year("last_date") - F.year("first_date")) + 1)


def first_distinct(reg: DataFrame, col: str, most: int = 8) -> DataFrame:
    """The first distinct values of a column by certificate, in order of appearance."""
    seen = reg.filter(F.col(col).isNotNull()).groupBy("doc_id", col).agg(F.min("seq").alias("first_seq"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("first_seq", col))
    return seen.withColumn("rank", rank).filter(F.col("rank") <= most).select("doc_id", "rank", F.col(col).alias("value"))


def drop_shorter_spellings(rows: DataFrame) -> DataFrame:
    """Of a list's parties that equal or begin another one of the list, only the first stays.

    Order-dependent, so it is a fold over the entry's own list: an array function, no Python.
    """
    listed = rows.groupBy("doc_id", "seq", "side").agg(F.array_sort(F.collect_list(F.struct("ordinal", "party"))).alias("p"))
    folded = F.aggregate("p", F.array().cast("array<struct<ordinal:int,party:string>>"), lambda kept, x: F.when(F.exists(kept, lambda k: F.lower(k["party"]).startswith(F.lower(x["party"])) | F.lower(x["party"]).startswith(F.lower(k["party"]))), kept).otherwise(F.array_append(kept, x)))
    return listed.select("doc_id", "seq", "side", F.inline(folded))
