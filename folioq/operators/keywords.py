"""Document types from key terms, and the decisions that follow from a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions.text import garbage_text
from folioq.functions.variants import bound

#: Key terms of the document types in English, Hindi and Gujarati.
TERMS = {
    "invoice": "invoice, tax invoice, bill to, subtotal, receipt, कर चालान, बिल, ઇન્વૉઇસ, બિલ",
    "resume": "resume, curriculum vitae, biodata, work experience, skills, बायोडाटा, બાયોડેટા",
    "contract": "contract, agreement, hereby, nda, सेवा अनुबंध, किरायानामा, ભાડા કરાર, કરાર",
    "prescription": "prescription, dosage, tablet, patient, पर्चा, दवा, દવા",
    "certificate": "certificate, certify, issued by, official seal, प्रमाण पत्र, પ્રમાણ પત્ર",
    "bank_statement": "bank statement, account statement, passbook, opening balance, closing balance, बैंक पासबुक, खाता विवरण, બૅન્ક પાસબુક",
    "marksheet": "marksheet, mark list, report card, roll number, अंकसूची, परिणाम पत्र, માર્કશીટ",
    "ration_card": "ration card, fair price shop, राशन कार्ड, રેશન કાર્ડ",
    "utility_bill": "electricity bill, water bill, gas bill, meter reading, consumer number, विद्युत बिल, पानी बिल, વીજ બિલ, ગૅસ બિલ",
    "aadhar_card": "aadhaar, aadhar card, uidai, uid, आधार, આધાર",
    "pan_card": "pan card, permanent account number, income tax department, पैन कार्ड, પૅન કાર્ડ",
    "driving_licence": "driving licence, driving license, vehicle class, lmv, mcwg, rto, ड्राइविंग लाइसेंस, ડ્રાઇવિંગ લાઇસન્સ",
    "passport": "passport, p ind, republic of india, पासपोर्ट, પાસપોર્ટ",
    "cheque": "cheque, demand draft, micr, payee, चेक, बैंक ड्राफ्ट, ચૅક, ડ્રાફ્ટ",
    "form_16": "form 16, tds certificate, tan, assessment year, फॉर्म 16, टीडीएस, ફૉર્મ 16",
    "insurance_policy": "insurance policy, policy number, sum assured, premium, nominee, बीमा पॉलिसी, વીમો",
    "gst_certificate": "gst certificate, gst registration certificate, gstin, जीएसटी प्रमाण पत्र, જીએસટી પ્રમાણ પત્ર, gst પ્રમાણ પત્ર",
    "birth_certificate": "birth certificate, place of birth, जन्म प्रमाण पत्र, જન્મ દાખલો",
    "death_certificate": "death certificate, cause of death, मृत्यु प्रमाण पत्र, મૃત્યુ દાખલો",
    "land_record": "land record, 7/12 utara, khatauni, jamabandi, khasra, survey number, 7/12 उतारा, खसरा, 7/12 ઉતારો",
    "nrega_card": "nrega, mgnrega, job card, gram panchayat, नरेगा जॉब कार्ड, નરેગા જૉબ કાર્ડ",
}
#: A table of terms up to this size is broadcast; a larger one is joined like any other.
BROADCAST_TERMS, BROADCAST_BYTES = 100_000, 8 << 20


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters with their marks, and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))


def term_table(spark: SparkSession, terms: dict[str, str] = TERMS) -> DataFrame:
    """(document_type, place, term) of comma-separated terms by type; place is the type's order."""
    return spark.createDataFrame([(kind, i, t.strip()) for i, (kind, listed) in enumerate(terms.items()) for t in listed.split(",")], "document_type string, place int, term string")


def classify_keywords(df: DataFrame, key: str, text_col: str = "text", terms: DataFrame | None = None) -> DataFrame:
    """(key, document_type, confidence, n_terms): the type whose terms, found as whole words in a row, have most words together, so that a longer term
    beats the shorter one within it. confidence is its share of the words of all terms found, n_terms the number of its own distinct ones.

    Ties go to the type that comes first in the table. A text without any term, empty or null, is `other` with confidence 0. Rows of one key, null among
    them, count as one text in parts; a term of several of them counts once for each. Whole texts are read: their runs of as many words as the terms have
    meet the terms in a join before any shuffle, and what is left is added up in the tasks first.
    """
    terms = term_table(df.sparkSession) if terms is None else terms
    listed = terms.select(F.col("document_type").alias("kind"), F.col("place"), tokens(F.col("term")).alias("t")).filter(F.size("t") > 0).select("kind", "place", F.size("t").alias("width"), F.array_join("t", " ").alias("gram")).distinct()
    facts = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram") + F.octet_length("kind")), F.lit(0)).alias("bytes"), F.sort_array(F.collect_set("width")).alias("widths")).first()
    if facts.n <= BROADCAST_TERMS and facts.bytes <= BROADCAST_BYTES:
        listed = F.broadcast(listed)
    runs = lambda t, n: F.transform(F.slice(t, 1, F.greatest(F.size(t) - (n - 1), F.lit(0))), lambda _, i: F.array_join(F.slice(t, i + 1, F.lit(n)), " "))
    grams = bound(tokens(F.col(f"`{text_col}`")), lambda t: F.array_distinct(F.concat(F.array().cast("array<string>"), *[runs(t, n) for n in facts.widths])))
    met = df.select(F.col(f"`{key}`").alias("k"), F.explode_outer(grams).alias("gram")).join(listed, "gram", "left")
    by_kind = met.groupBy("k", "kind", "place").agg(F.coalesce(F.sum("width"), F.lit(0)).alias("weight"), F.count("width").alias("n"))
    best = by_kind.groupBy("k").agg(F.max(F.struct(F.col("weight"), -F.col("place"), F.col("kind"), F.col("n"))).alias("b"), F.sum("weight").alias("all"))
    some = F.col("b.weight") > 0
    return best.select(F.col("k").alias(key), F.when(some, F.col("b.kind")).otherwise("other").alias("document_type"), F.when(some, F.round(F.col("b.weight") / F.col("all"), 4)).otherwise(0.0).alias("confidence"), F.col("b.n").alias("n_terms"))


def retry_policy(confidence: Column, text: Column, packs: Column, targeted: Column, script: Column) -> Column:
    """(targeted_retry, aggressive, easy, paddle): which further readings a page needs, from its best confidence and text.

    A retry with the targeted packs if they differ, below 80, from 80 characters on; the aggressive pass below 65 for short or
    garbled text, or below 55; the second engine below 60 unless the text is long; the third not for Gujarati.
    """
    length = F.length(F.btrim(F.coalesce(text, F.lit(""))))
    easy = (confidence < 60) & ~((confidence >= 50) & (length >= 500)) & (length < 1000)
    return F.struct(
        ((packs != targeted) & (confidence < 80) & (length >= 80)).alias("targeted_retry"),
        ((confidence < 65) & ((length < 120) | garbage_text(text) | (confidence < 55))).alias("aggressive"),
        easy.alias("easy"),
        (easy & (script != "guj")).alias("paddle"),
    )
