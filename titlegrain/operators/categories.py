"""Categories of legal documents: catalogue, detection, and rules of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from titlegrain.functions import scalars as S
from titlegrain.operators.documents import Rule

# The categories in order of preference, each with its title and its groups of words:
# a group adds its weight once, however many of its words a text holds.
CATEGORIES: list[tuple[str, str, list[tuple[int, list[str]]]]] = [
    ("sale_deed", "Sale deed", [(6, ["sale deed", "absolute sale", "கிரையப் பத்திரம்", "கிரயப்", "vendor", "purchaser", "conveyance"]), (3, ["schedule of property", "undivided share", "uds"])]),
    ("patta", "Patta or chitta", [(15, ["பட்டா", "சிட்டா", "patta", "chitta", "pattadhar", "10(1)", "நில உரிமை"])]),
    ("parent_docs", "Parent documents", [(7, ["parent doc", "mother document", "chain of title", "முந்தைய ஆவணம்", "தாய் பத்திரம்", "prior deed"])]),
    ("ec", "Encumbrance certificate", [(8, ["encumbrance certificate", "வில்லங்கச் சான்றிதழ்", "form no. 15", "form no. 16", "nil encumbrance"])]),
    ("building_plan", "Building plan", [(7, ["planning permit", "building sanction", "plinth area", "fsi", "setback", "கட்டிட வரைபடம்"])]),
    ("rera", "Project registration", [(8, ["tnrera", "rera", "real estate regulatory authority", "form 'c'"])]),
    ("tax_eb", "Tax and utility receipts", [(7, ["property tax", "tangedco", "electricity board", "consumer no", "வரி விதிப்பு", "cmwssb"])]),
    ("layout_approval", "Layout approval", [(7, ["ppd/lo", "approved layout", "open space reservation", "osr", "மனைப்பிரிவு"])]),
    ("death_legal_heir", "Death and heirs", [(8, ["legal heir", "varisu", "death certificate", "வாரிசுச் சான்றிதழ்", "இறப்புச் சான்றிதழ்"])]),
    ("loan_docs", "Loan documents", [(7, ["memorandum of deposit", "modt", "mortgage", "housing loan", "loan account", "title deeds deposited"])]),
    ("tslr", "Town survey extract", [(15, ["tslr", "town survey", "ward + block", "land classification", "tenure type", "ryotwari", "o.sur no", "நகர நில அளவை", "நகர சர்வே", "are(s)", "extract from the town survey", "urb/"])]),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """The categories as a table ``category, title, rank``."""
    return spark.createDataFrame([(name, title, i + 1) for i, (name, title, _) in enumerate(CATEGORIES)], "category string, title string, rank int")


def scores(text: Column) -> dict[str, Column]:
    """The score of a text in each category."""
    low = F.lower(text)
    has = lambda words: F.coalesce(F.greatest(F.lit(False), *[F.contains(low, F.lit(w)) for w in words]), F.lit(False))
    return {name: sum((has(words).cast("int") * weight for weight, words in groups), F.lit(0)) for name, _, groups in CATEGORIES}


def category(text: Column) -> Column:
    """The category of highest score; ties go to the earlier one, no hit to ``sale_deed``."""
    all_ = scores(text)
    best = F.greatest(*all_.values())
    return F.coalesce(*[F.when((s == best) & (best > 0), F.lit(n)) for n, s in all_.items()], F.lit(CATEGORIES[0][0]))


def detect(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, category, score`` of every text that is not NULL."""
    return texts.filter(F.col(text).isNotNull()).select(key, category(F.col(text)).alias("category"), F.greatest(*scores(F.col(text)).values()).alias("score"))


def counted(detected: DataFrame) -> DataFrame:
    """The catalogue with the number of texts of each category; empty ones have 0."""
    n = detected.groupBy("category").agg(F.count("*").alias("texts"))
    return catalogue(detected.sparkSession).join(F.broadcast(n), "category", "left").select("category", "title", "rank", F.coalesce("texts", F.lit(0)).alias("texts"))


def _after(field: str, label: str, value: str = r"([^\n]+)", rank: int = 1, sure: float = 0.9) -> Rule:
    """What stands behind a label and a colon (or dash) up to the end of the line."""
    return Rule(field, rf"(?i)(?:{label})[^:\n]{{0,30}}[:–-]\s*{value}", rank, sure)


_PERSON = r"((?:(?:Mr|Mrs|Ms|Thiru|Tmt|Smt|Selvi|Dr)\.?\s*)?(?:[A-Z]\.\s?)*[A-Z][A-Za-z]+(?:\s(?:[A-Z]\.\s?)*[A-Z][A-Za-z]*)*)"
_AREA = r"([0-9][0-9,.]*\s*(?:sq\.?\s*ft|sq\.?\s*m|cents?|acres?|grounds?|ares?|hectares?|சதுர\s*அடி))"
_DAY = r"([0-9]{1,2}[-/.][0-9A-Za-z]{2,9}[-/.][0-9]{4})"
_SURVEY = r"([0-9]{1,5}(?:/[0-9A-Z]+)?)"

#: The rules of each category; the first pattern that hits wins by rank. Generic labels of such
#: forms, in English and Tamil.
RULES: dict[str, list[Rule]] = {
    "sale_deed": [
        Rule("registration_date", rf"(?i)(?:executed|made)[^\n]{{0,80}}?\bon\s+(?:this\s+)?{_DAY}"), _after("registration_date", "date of registration|registration date|பதிவு நாள்", _DAY, 2), Rule("registration_date", _DAY, 3, 0.6),
        Rule("vendor_details", rf"(?i:between)\s+{_PERSON}"), _after("vendor_details", "vendor|seller|executant|விற்பவர்", r"([^\n]+)", 2),
        Rule("purchaser_details", rf"(?i:between)[^\n]{{3,200}}?\s(?i:and|in favour of)\s+{_PERSON}"), Rule("purchaser_details", rf"(?i:in favour of)\s+{_PERSON}", 2), _after("purchaser_details", "purchaser|buyer|claimant|வாங்குபவர்", r"([^\n]+)", 3),
        Rule("poa_agent_details", rf"(?i:power (?:of attorney )?agent)[,:\s]+{_PERSON}"), _after("poa_agent_details", "power of attorney|power agent|பொது அதிகார", r"([^\n]+)", 2),
        Rule("history_previous_owner", rf"(?i:originally belonged to|purchased from|acquired from)\s+{_PERSON}"),
        Rule("previous_doc_reference", r"(?i)(?:previous|prior|parent|mother)\s+(?:document|deed)[^0-9\n]{0,40}([0-9]{1,6}/[0-9]{4})"), Rule("previous_doc_reference", r"(?i)registered as document[^0-9\n]{0,20}([0-9]{1,6}/[0-9]{4})", 2),
        Rule("survey_number", rf"(?i)\b(?:survey(?:\s*(?:number|no))?|s\.?\s?f?\.?\s*no)\.?\s*[:]?\s*{_SURVEY}"), _after("survey_number", "புல எண்|சர்வே எண்", _SURVEY, 2),
        Rule("schedule_property_type", r"(?i)\b(vacant (?:site|land|plot)|house site|agricultural land|residential flat|apartment|shop|building)\b"),
        Rule("flat_details", r"(?i)\b((?:flat|apartment|unit)\s*(?:no\.?)?\s*[A-Z]?-?[0-9]+[A-Z]?)\b"),
        Rule("village_taluk_district", r"(?i)((?:[^\s,]+\s+village)(?:,?\s+[^\s,]+\s+taluk)?(?:,?\s+[^\s,]+\s+district)?)"),
        Rule("corporation_division", r"(?i)division\s*(?:no\.?)?\s*[:]?\s*([0-9]+)"),
        Rule("land_extent", rf"(?i)(?:measuring|measures|extent of|admeasuring)\s+{_AREA}"), _after("land_extent", "extent|area|பரப்பு", r"([^\n]+)", 2), Rule("land_extent", rf"(?i){_AREA}", 3, 0.6),
        Rule("apartment_uds_floor", rf"(?i)undivided[^\n]{{0,40}}?{_AREA}"), Rule("apartment_uds_floor", rf"(?i){_AREA}[^\n]{{0,20}}(?:UDS|undivided)", 2),
        Rule("boundaries", r"(?i)(?:boundaries|bounded)[^\n]{0,20}?\b((?:on the |north|south|east|west)[^\n]+)"),
        Rule("land_classification", r"(?i)\b(nanjai|punjai|manai|wet land|dry land|house site|poramboke)\b"),
        Rule("sro_details", r"(?i)(?:sub[- ]registrar(?:'s)? office|s\.?r\.?o\.?)\s*(?:of|at|,|:)?\s*([A-Z][\w-]+)"),
        Rule("document_number", r"(?i)document\s*(?:number|no)?\.?\s*[:]?\s*([0-9]{1,6}/[0-9]{4})"),
        Rule("consideration", r"(?i)(?:price|consideration|sum)[^\n]{0,30}?((?:Rs\.?|₹)\s*[0-9][0-9,]*(?:/-)?)"), Rule("consideration", r"((?:Rs\.?|₹)\s*[0-9][0-9,]*(?:/-)?)", 2, 0.7),
    ],
    "patta": [
        Rule("patta_number", r"(?i)patta\s*(?:no|number)?\.?\s*[:]?\s*([A-Z]?-?[0-9][0-9A-Z-]*)"), _after("patta_number", "பட்டா எண்", r"([0-9]+)", 2),
        Rule("portal_reference", r"(?i)(?:reference|ref)\s*(?:no|number)?\.?\s*[:]?\s*([A-Z0-9/]{6,})"),
        _after("village", "village|கிராமம்", r"([^\s,\n]+)"), Rule("village", r"(?i)([A-Z][\w-]+)\s+village", 2), _after("taluk", "taluk|வட்டம்", r"([^\s,\n]+)"), _after("district", "district|மாவட்டம்", r"([^\s,\n]+)"),
        Rule("owner_name", rf"(?i:in the name of|joint holders?|owner is)\s+{_PERSON}"), _after("owner_name", "owner|pattadhar|உரிமையாளர்", r"([^\n]+)", 2),
        Rule("survey_numbers", rf"(?i)survey\s*(?:no|number)?s?\.?\s*[:]?\s*{_SURVEY}"), _after("survey_numbers", "புல எண்|சர்வே எண்", _SURVEY, 2),
        Rule("extent_details", r"(?i)extent\s*(?:of)?\s*[:]?\s*([^,;\n]+)"), _after("extent_details", "பரப்பு", r"([^\n]+)", 2),
        Rule("nature_of_land", r"(?i)\b(nanjai|punjai|wet|dry|நன்செய்|புன்செய்|நஞ்சை|புஞ்சை)\b"),
        _after("digital_signature_timestamp", "digitally signed|signed on", r"([^\n]+)"), Rule("authorized_signatory", r"(?i)\b(tahsildar|வட்டாட்சியர்|deputy tahsildar|revenue officer)\b"),
        _after("certificate_printed_date", "printed on|date of print", r"([^\n]+)"), Rule("total_tax", r"(?i)(?:assessment|tax|தீர்வை|நிலவரி)[^0-9\n]{0,20}((?:Rs\.?\s*)?[0-9][0-9,.]*(?:/-)?)"),
    ],
    "tslr": [
        Rule("survey_number", rf"(?i)(?:town survey|t\.?s\.?)\s*(?:no|number)?\.?\s*[:]?\s*{_SURVEY}"), Rule("old_survey_number", rf"(?i)(?:old|former|o\.sur)\s*(?:survey)?\s*(?:no|number)?\.?\s*[:]?\s*{_SURVEY}"),
        Rule("ward", r"(?i)ward\s*(?:no)?\.?\s*[:]?\s*([0-9A-Z]+)"), Rule("block", r"(?i)block\s*(?:no)?\.?\s*[:]?\s*([0-9A-Z]+)"), Rule("ward_block", r"(?i)(ward\s*(?:no)?\.?\s*[:]?\s*[0-9A-Z]+[ ,+]+block\s*(?:no)?\.?\s*[:]?\s*[0-9A-Z]+)"),
        _after("town", "town|நகரம்", r"([^\n]+)"), _after("taluk", "taluk", r"([^\n]+)"), _after("district", "district", r"([^\n]+)"),
        Rule("tenure_type", r"(?i)tenure(?: type)?\s*[:]\s*([^.,\n]+)"), Rule("tenure_type", r"(?i)\b(ryotwari|freehold|leasehold|government)\b", 2),
        Rule("land_classification", r"(?i)classification\s*[:]\s*([^.,\n]+)"), Rule("land_classification", r"(?i)\b(ryotwari|poramboke|house site|வீட்டுமனை)\b", 2),
        Rule("extent", r"(?i)extent\s*[:]?\s*([^,;\n]+)"), Rule("extent", rf"(?i){_AREA}", 2, 0.7),
        Rule("assessment", r"(?i)(?:assessment|ground rent)[^0-9\n]{0,25}((?:Rs\.?\s*)?[0-9][0-9,.]*(?:/-)?)"), Rule("occupier", rf"(?i:occupier is|occupied by|in the occupation of)\s+{_PERSON}"), Rule("registered_owner", rf"(?i:registered owner|owner)\s*(?:is|:)\s*{_PERSON}"),
        Rule("street", r"(?i)\b([A-Z][\w ]{2,30}(?:street|road|lane))\b"), Rule("door_number", r"(?i)door\s*(?:no|number)\.?\s*[:]?\s*([0-9A-Z/]+)"), Rule("field_map", r"(?i)(?:sketch|f\.?m\.?b\.?)\s*(?:no)?\.?\s*[:]?\s*([0-9]+)"),
        Rule("order_number", r"(?i)order\s*(?:no)?\.?\s*[:]?\s*([0-9]+/[0-9]{4})"), Rule("measured_on", rf"(?i)measur\w+[^\n]{{0,30}}?{_DAY}"), _after("remarks", "remarks|குறிப்பு", r"([^\n]+)"),
    ],
    "ec": [_after("sro", r"s\.?r\.?o|sub registrar office"), _after("certificate_no", "certificate no"), _after("application_no", "application no"), _after("applicant_name", "applicant"), _after("village", "village"), _after("survey_details", "survey details"), _after("search_period", "search period"), Rule("search_period", r"(?i)for the period from ([^.\n]+)", 2), _after("requested_extent", "total extent"), Rule("form_type", r"(?i)\b(form[- ]?(?:no\.?)?\s*1[56])\b")],
    "building_plan": [
        Rule("building_use", r"(?i)\b(residential|commercial|institutional|industrial|mixed)\b"), _after("shop_details", "shop (?:no|code)"), _after("permit_number", "permit (?:no|number)|sanction no|approval no|order no|அனுமதி எண்"), _after("applicant_name", "applicant|owner|விண்ணப்பதாரர்"), _after("survey_number", "survey no|s\\.? ?no|புல எண்"), _after("plot_details", "plot|site|door"),
        _after("built_up_area", "built.?up area|plinth area|total floor area"), _after("fsi", "fsi|far|floor area ratio"), Rule("approval_authority", r"(?i)\b(CMDA|DTCP|corporation|municipality|town panchayat|நகராட்சி)\b"), _after("approval_date", "approval date|sanction date|dated"),
    ],
    "parent_docs": [_after("document_number", "document no|doc no"), Rule("document_number", r"(?i)document\s+([0-9]{1,6}/[0-9]{4})", 2), Rule("year", r"(?i)(?:year|dated)[^\n]{0,20}?((?:19|20)[0-9]{2})"), _after("survey_number", "survey"), _after("vendor", "vendor|seller"), _after("purchaser", "purchaser|buyer")],
    "death_legal_heir": [
        _after("deceased_name", "name of (?:the )?deceased|deceased name|இறந்தவர் பெயர்"), Rule("deceased_name", r"\bLate\s+([A-Z][A-Za-z. ]+)", 2), _after("date_of_death", "date of death|died on|இறப்பு நாள்"), _after("death_reg_number", "death reg\\w* no|registration no|இறப்பு பதிவு எண்"), _after("varisu_certificate_no", "legal heir cert\\w* no|varisu (?:cert )?no|வாரிசு சான்றிதழ் எண்"),
        _after("issuing_authority", "tahsildar|taluk office|வட்டாட்சியர்"), _after("legal_heirs_list", "legal heirs|heirs list|வாரிசுகள்"),
    ],
    "rera": [_after("rera_number", "rera (?:no|number|reg\\w*)"), _after("project_name", "project name"), _after("promoter_name", "promoter|developer"), _after("validity", "valid\\w*|expiry")],
    "tax_eb": [_after("receipt_no", "receipt no|bill no"), _after("consumer_no", "consumer no|service no"), _after("property_id", "assessment|property id"), _after("amount_paid", "amount|paid"), _after("period", "period")],
    "layout_approval": [_after("approval_no", "approval no"), _after("authority", "authority"), _after("layout_name", "layout"), _after("osr_details", "osr|open space")],
    "loan_docs": [_after("loan_account", "loan account|loan a/c"), _after("bank_name", "bank|lender"), _after("mortgage_type", "mortgage type"), _after("loan_amount", "loan amount|sanctioned"), _after("property_description", "property|schedule")],
}


def mutation_status(text: Column) -> Column:
    """``pending``, ``mutated`` or ``unknown``, pending first."""
    return F.when(S.contains_any(text, ["not mutated", "pending mutation", "mutation pending", "மாறுதல் நிலுவை"]), "pending").when(S.contains_any(text, ["mutated", "patta transfer completed", "பட்டா மாறுதல் செய்யப்பட்டது"]), "mutated").otherwise("unknown")


def extract(texts: DataFrame, key: str, text: str, kind: str | None = None, only: list[str] | None = None) -> DataFrame:
    """Each text by the rules of its category: ``key, category, field, value, confidence``.

    ``kind`` names a column with the category; without it the text decides (T2). ``only`` leaves
    the fields asked for by a caller. A field without a hit has NULL and 0. One scan: the rules
    are a fixed small table met by the category, their patterns are values of it.
    """
    chosen = F.col(kind) if kind else category(F.col(text))
    rows = []
    for name, rules in RULES.items():
        fields: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: r.rank):
            fields.setdefault(rule.field, []).append(rule)
        rows += [(name, field, [r.pattern for r in own], [float(r.confidence) for r in own]) for field, own in fields.items() if not only or field in only]
    table = texts.sparkSession.createDataFrame(rows, "category string, field string, patterns array<string>, sures array<double>")
    kept = texts.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("_text"), chosen.alias("category"))
    hits = F.expr("filter(zip_with(patterns, sures, (p, s) -> struct(nullif(trim(regexp_extract(_text, p, 1)), '') AS value, s AS sure)), v -> v.value IS NOT NULL)")
    hit = F.try_element_at(hits, F.lit(1))
    return kept.join(F.broadcast(table), "category").select(key, "category", "field", hit.alias("h")).select(key, "category", "field", F.col("h.value").alias("value"), F.coalesce("h.sure", F.lit(0.0)).alias("confidence"))
