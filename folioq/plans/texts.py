"""Queries over texts and single values, with SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.functions import text as T
from folioq.functions import values as V
from folioq.operators.keywords import classify_keywords as by_keywords, retry_policy
from folioq.plans.base import query, read

#: Layouts in which dates are written, by key modulo their number; the last ones are no dates or have outer blanks.
WRITTEN = ("d/M/yyyy", "M/d/yyyy", "d-M-yyyy", "M-d-yyyy", "d.M.yyyy", "yyyy/M/d", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMMM, yyyy", "d MMM, yyyy", "yyyy-MM-dd", "'  'yyyy-MM-dd' '", "'31/02/'yyyy", "'on 'd")
LOOSE = ("yyyy-MM-dd", "d/M/yyyy", "d.M.yy", "MMM yyyy", "MMMM yyyy", "yyyy-MM", "yyyy", "'Present'", "' d/m '")


def rotated(key: Column, ts: Column, layouts: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.when(key % len(layouts) == i, F.date_format(ts, f)) for i, f in enumerate(layouts)])


@query("""WITH d AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, o_orderkey % 16 f FROM orders)
SELECT k o_orderkey, CASE WHEN f >= 14 THEN NULL WHEN f IN (1, 3) AND day(d) <= 12 THEN strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') ELSE strftime(d, '%Y-%m-%d') END iso FROM d""")
def parse_date_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in sixteen ways and read back; where day and month are open, the day comes first."""
    return read(spark, sf_dir, "orders").select("o_orderkey", V.parse_date_iso(rotated(F.col("o_orderkey"), F.col("o_orderdate"), WRITTEN)).alias("iso"))


@query("""WITH d AS (SELECT o_orderkey k, CAST(o_orderdate AS DATE) d, o_orderkey % 9 f FROM orders)
SELECT k o_orderkey, strftime(CASE WHEN f <= 2 THEN d WHEN f <= 5 THEN date_trunc('month', d) WHEN f = 6 THEN date_trunc('year', d) END, '%Y-%m-%d') read_as FROM d""")
def parse_date_flexible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, months, years and open ends in nine ways, two-digit years included."""
    found = V.parse_date_flexible(rotated(F.col("o_orderkey"), F.col("o_orderdate"), LOOSE))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(found, "yyyy-MM-dd").alias("read_as"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 6 >= 4 THEN NULL WHEN c_custkey % 6 = 3 THEN -c_acctbal ELSE c_acctbal END amount FROM customer""")
def to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts with currency signs, group commas and blanks, and texts that are none."""
    k, x = F.col("c_custkey") % 6, F.col("c_acctbal")
    plain = x.cast("decimal(18,2)").cast("string")
    written = F.when(k == 0, F.concat(F.lit("₹ "), plain)).when(k == 1, F.concat(F.format_number(x, 2), F.lit(" "))).when(k == 2, F.concat(F.lit("$"), plain)).when(k == 3, F.when(x == 0, "-0.0").when(x < 0, F.substring(plain, F.lit(2), F.length(plain))).otherwise(F.concat(F.lit("-"), plain))).when(k == 4, F.concat(F.lit("Rs. "), plain))
    return read(spark, sf_dir, "customer").select("c_custkey", V.to_float(written).alias("amount"))


@query("""WITH c AS (SELECT c_custkey k, lpad(CAST(c_custkey AS VARCHAR), 9, '0') n FROM customer)
SELECT k c_custkey, CASE k % 5 WHEN 0 THEN '+919' || n WHEN 1 THEN '+917923' || n WHEN 2 THEN '1' || n WHEN 3 THEN 'ext' ELSE NULL END phone FROM c""")
def normalise_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mobile numbers, numbers with a country code, others, and texts without digits."""
    k, n = F.col("c_custkey") % 5, F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    dashed = F.concat_ws("-", F.substring(n, 1, 4), F.substring(n, 5, 5))
    written = F.when(k == 0, F.concat(F.lit("9 "), dashed)).when(k == 1, F.concat(F.lit("+91 (79) 23-"), dashed)).when(k == 2, F.concat(F.lit("1."), dashed)).when(k == 3, "ext")
    return read(spark, sf_dir, "customer").select("c_custkey", V.normalise_phone(written).alias("phone"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount WHEN l_tax <> 0 THEN l_tax ELSE 0.0 END charged FROM lineitem")
def first_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discount, else tax, else zero: zeros fall through."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.first_truthy(F.col("l_discount"), F.col("l_tax"), F.lit(0.0)).alias("charged"))


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity * p_retailprice - l_extendedprice) <= 0.02 * greatest(abs(l_quantity * p_retailprice), abs(l_extendedprice)) is_near FROM lineitem JOIN part ON p_partkey = l_partkey")
def is_close_2pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a line's price is quantity times the part's price."""
    lines, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    near = V.is_close(F.col("l_quantity") * F.col("p_retailprice"), F.col("l_extendedprice"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", near.alias("is_near"))


SHARE = "CAST(l_orderkey * 7 + l_linenumber AS BIGINT) % 1000 / 1000.0"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.95 THEN 'A+' WHEN s >= 0.9 THEN 'A' WHEN s >= 0.85 THEN 'B+' WHEN s >= 0.8 THEN 'B' WHEN s >= 0.75 THEN 'C+' WHEN s >= 0.7 THEN 'C' ELSE 'D' END grade FROM (SELECT *, {SHARE} s FROM lineitem)")
def confidence_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.confidence_grade((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000 / 1000).alias("grade"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.85 THEN 'high' WHEN s >= 0.65 THEN 'medium' ELSE 'low' END badge FROM (SELECT *, {SHARE} s FROM lineitem)")
def grade_badge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.grade_badge((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000 / 1000).alias("badge"))


@query(f"SELECT l_orderkey, l_linenumber, printf('%.1f%%', {SHARE} * 100) shown FROM lineitem")
def percent_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", V.percent_text((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 1000 / 1000).alias("shown"))


@query(r"""WITH n AS (SELECT page_id, coalesce(url, '') u, regexp_extract(coalesce(url, ''), '([^/\\]*)$', 1) b FROM pages)
SELECT page_id, CASE WHEN trim(regexp_replace(b, '[^A-Za-z0-9._-]', '_', 'g'), '._') = '' THEN 'upload_' || page_id ELSE trim(regexp_replace(b, '[^A-Za-z0-9._-]', '_', 'g'), '._') END filename FROM n""")
def clean_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.clean_filename(F.coalesce("url", F.lit("")), F.col("page_id")).alias("filename"))


@query(r"SELECT doc_id, strftime(make_timestamp(1700000000000000 + doc_id * 1000000), '%Y%m%d_%H%M%S') || '_' || regexp_replace(source || ' v-' || doc_id, '[^\p{L}\p{N}]', '_', 'g') folder FROM documents WHERE source IS NOT NULL")
def run_folder_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("source is not null")
    name = F.concat(F.lit("in/"), F.col("source"), F.lit(" v-"), F.col("doc_id").cast("string"), F.lit(".pdf"))
    return docs.select("doc_id", T.run_folder_name(name, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))).alias("folder"))


@query("SELECT p_partkey, list_aggregate(list_transform(string_split(p_type, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') || ' > ' || list_aggregate(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') label FROM part")
def title_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and names as keys with underscores, as labels."""
    key = lambda c: F.translate(c, " ", "_")
    return read(spark, sf_dir, "part").select("p_partkey", T.title_label(key("p_name"), T.title_label(key("p_type"))).alias("label"))


INDIC = {"hin": "नमस्ते दुनिया ", "guj": "નમસ્તે દુનિયા "}


def mixed(docs: DataFrame) -> DataFrame:
    """Documents with Indic words before the text: by id none, Hindi, Gujarati or both, as many as the last two digits say."""
    k, n = F.col("doc_id") % 4, F.col("doc_id") % 100
    added = F.concat(F.when(k.isin(1, 3), F.repeat(F.lit(INDIC["hin"]), n)).otherwise(""), F.when(k.isin(2, 3), F.repeat(F.lit(INDIC["guj"]), n)).otherwise(""))
    return docs.withColumn("text", F.concat(added, F.coalesce("text", F.lit(""))))


MIXED = f"""SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN repeat('{INDIC["hin"]}', CAST(doc_id % 100 AS INT)) ELSE '' END || CASE WHEN doc_id % 4 IN (2, 3) THEN repeat('{INDIC["guj"]}', CAST(doc_id % 100 AS INT)) ELSE '' END || coalesce(text, '') t FROM documents"""
SCRIPT = rf"""(WITH m AS ({MIXED}), c AS (SELECT doc_id, t, length(regexp_replace(t,'[^\x{{0900}}-\x{{097F}}]','','g')) h, length(regexp_replace(t,'[^\x{{0A80}}-\x{{0AFF}}]','','g')) g, length(regexp_replace(t,'[^A-z]','','g')) e FROM m)
SELECT doc_id, t, CASE WHEN h+g+e>0 AND h/(h+g+e)>=0.15 AND h>=g THEN 'hin' WHEN h+g+e>0 AND g/(h+g+e)>=0.15 THEN 'guj' ELSE 'eng' END script FROM c)"""


@query(f"SELECT doc_id, script FROM {SCRIPT}")
def detect_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", T.detect_script(F.col("text")).alias("script"))


@query(f"SELECT doc_id, CASE script WHEN 'eng' THEN 'English' WHEN 'hin' THEN 'Hindi' ELSE 'Gujarati' END AS language FROM {SCRIPT}")
def language_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", T.language_name(T.detect_script(F.col("text"))).alias("language"))


@query(f"SELECT doc_id, CASE WHEN script = 'eng' OR doc_id % 3 = 0 THEN 'eng' ELSE 'eng+' || script END packs FROM {SCRIPT}")
def language_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs for the detected script; every third reader has English only."""
    have = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("eng"))).otherwise(F.array(F.lit("eng"), F.lit("guj"), F.lit("hin")))
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", T.detect_language_set(have, T.detect_script(F.col("text"))).alias("packs"))


@query(r"""SELECT doc_id, sha256(CASE doc_id % 3 WHEN 0 THEN 'क  x ક' || repeat(chr(10), 4) || t WHEN 1 THEN regexp_replace(regexp_replace('क  x ' || repeat(chr(10), 4) || t, '  +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') ELSE regexp_replace(regexp_replace('  x ક' || repeat(chr(10), 4) || t, '  +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') END) cleaned FROM (SELECT doc_id, coalesce(text, '') t FROM documents)""")
def clean_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with stray letters and blank lines before them, cleaned as English, Hindi and Gujarati in turn."""
    code = F.element_at(F.array(F.lit("eng"), F.lit("hin"), F.lit("guj")), (F.col("doc_id") % 3 + 1).cast("int"))
    dirty = F.concat(F.lit("क  x ક" + "\n" * 4), F.coalesce("text", F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.clean_script(dirty, code).cast("binary"), 256).alias("cleaned"))


@query("""WITH t AS (SELECT conv_id doc_id, count(*) n FROM conversations GROUP BY 1)
SELECT c.conv_id doc_id, CAST(row_number() OVER (PARTITION BY c.conv_id ORDER BY turn) AS INT) page, CASE WHEN c.conv_id % 2 = 0 THEN 'Hindi' END AS language, CASE WHEN c.conv_id % 2 = 0 THEN CAST(turn % 50 + 50 AS DOUBLE) END confidence, sha256(coalesce(text, '')) page_sha256 FROM conversations c""")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation joined by page markers and taken apart again."""
    order = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    joined = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(order.alias("pages"))
    ocr = F.col("conv_id") % 2 == 0
    head = lambda p, i: F.concat(F.lit("\n--- Page "), (i + 1).cast("string"), F.when(ocr, F.concat(F.lit(" (Language: Hindi, OCR Confidence: "), F.format_string("%.1f", (p["turn"] % 50 + 50).cast("double")), F.lit("%, Engine: tesseract)"))).otherwise(""), F.lit(" ---\n"), p["text"])
    text = F.array_join(F.transform("pages", head), "")
    pages = joined.select("conv_id", F.explode(T.split_pages(text)).alias("p"))
    return pages.select(F.col("conv_id").alias("doc_id"), "p.page", "p.language", "p.confidence", F.sha2(F.col("p.text").cast("binary"), 256).alias("page_sha256"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN least(1.0, (doc_id % 120) / 100.0) END ocr_quality FROM documents")
def page_first_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence of the first marker of a text; every fifth text has none."""
    mark = F.when(F.col("doc_id") % 5 > 0, F.concat(F.lit("--- Page 1 (OCR Confidence: "), (F.col("doc_id") % 120).cast("string"), F.lit("%) ---\n--- Page 2 (OCR Confidence: 3%) ---"))).otherwise("")
    return read(spark, sf_dir, "documents").select("doc_id", T.page_first_marker(F.concat(mark, F.coalesce("text", F.lit("")))).alias("ocr_quality"))


@query(r"""SELECT page_id, CAST(CASE WHEN html IS NULL THEN 0 ELSE length(html) - length(replace(html, chr(10), '')) + 1 END AS BIGINT) text_regions, coalesce(contains(html, '|'), false) has_tables, coalesce(regexp_matches(html, '(?i)<img|\[image'), false) has_images FROM pages""")
def layout_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.layout_profile(F.col("html")).alias("p")).select("page_id", "p.*")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) x, generate_subscripts(string_split(text, chr(10)), 1) k FROM documents WHERE doc_id % 3 <> 0), r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 row_no, list_transform(string_split(regexp_replace(trim(x), '^\||\|$', '', 'g'), '|'), lambda c: trim(c)) cells FROM l WHERE contains(x, '|'))
SELECT doc_id, row_no, len(cells) n_cells, list_aggregate(cells, 'string_agg', '¦') cells FROM r UNION ALL SELECT doc_id, row_no, 2, cells || '¦' || doc_id FROM documents, (VALUES (0, 'a'), (1, 'b'), (2, 'c')) t(row_no, cells) WHERE doc_id % 3 = 0""")
def parse_pipe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the lines with pipes; every third document holds two marked tables, outside of which nothing counts."""
    k = F.col("doc_id").cast("string")
    tables = F.concat(F.lit("x | y\n[TABLE]\n| a | "), k, F.lit(" |\nno cells\n| b | "), k, F.lit(" |\n[/TABLE]\nbetween | them\n[TABLE]c|"), k, F.lit("[/TABLE]\nz | z"))
    text = F.when(F.col("doc_id") % 3 == 0, tables).otherwise(F.col("text"))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.parse_pipe_table(text)).alias("row_no", "cells"))
    return rows.select("doc_id", F.col("row_no").cast("long"), F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", "¦").alias("cells"))


#: What stands in for look-around in SQL: characters that can't belong to a value are doubled first, then one on either side is taken along.
PLAIN_IDENTIFIERS = {
    "gstin": ("[^A-Z0-9]", "(?:^|[^A-Z0-9])([0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z])(?:$|[^A-Z0-9])"),
    "pan": ("[^A-Z0-9]", "(?:^|[^A-Z0-9])([A-Z]{5}[0-9]{4}[A-Z])(?:$|[^A-Z0-9])"),
    "uid": ("[^0-9 -]", "(?:^|[^0-9-])([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4})(?:$|[^0-9-])"),
    "ifsc": ("[^A-Z0-9]", "(?:^|[^A-Z0-9])([A-Z]{4}0[A-Z0-9]{6})(?:$|[^A-Z0-9])"),
    "passport": ("[^A-Z0-9]", "(?:^|[^A-Z0-9])([A-PR-WY][0-9]{7})(?:$|[^0-9])"),
    "dl": ("[^A-Z0-9 -]", "(?:^|[^A-Z0-9])([A-Z]{2}[0-9]{2}[ -]?[0-9]{11})(?:$|[^0-9])"),
    "email": ("[\n\t]", "([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z])"),
    "phone": ("[^0-9+() -]", "([+][0-9]{1,3}(?: ?[(]?[0-9]{3}[)]? ?[0-9]{3}-[0-9]{4}|[ -]?[6-9][0-9]{4}[ -]?[0-9]{5}))(?:$|[^0-9])"),
    "amount": ("[\n\t]", "([₹$€£] ?[0-9][0-9,]*(?:[.][0-9]+)?)"),
    "date": ("[^0-9/.-]", "(?:^|[^0-9])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?:/[0-9]{1,2}/|-[0-9]{1,2}-|[.][0-9]{1,2}[.])[0-9]{4})(?:$|[^0-9])"),
}
#: Pairs of values with one separator between them.
CLOSE = "ABCDE1234F ABCDE1234G|2024-01-02 2024-01-03 3/4/2024,05.06.2024|+91 98765 43210;+919876543211|SBIN0001234 HDFC0ABC123|K1234567 L7654321|27ABCDE1234F1Z5 29ABCDE1234F1Z5"


@query(f"WITH t AS (SELECT doc_id, coalesce(text, '') || '\n{CLOSE}' t FROM documents) ".replace("\n", "' || chr(10) || '") + " UNION ALL ".join(f"SELECT doc_id, '{k}' kind, v AS value FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(t, '({out})', '\\1\\1', 'g'), '{p}', 1)) v FROM t)" for k, (out, p) in PLAIN_IDENTIFIERS.items()))
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of all documents, each with a line of values that follow each other closely."""
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n" + CLOSE))
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(T.extract_identifiers(text)).alias("i")).select("doc_id", "i.kind", "i.value")


#: Lines as they stand in documents, with the type, share and number of terms that each must give. Written down by hand, apart from the operator's table.
SAID = (
    ("TAX INVOICE no. 5, bill to: ACME", "invoice", 1.0, 3), ("कर चालान संख्या 5", "invoice", 1.0, 1), ("ઇન્વૉઇસ નંબર", "invoice", 1.0, 1),
    ("Curriculum Vitae: skills", "resume", 1.0, 2), ("मेरा बायोडाटा", "resume", 1.0, 1), ("બાયોડેટા", "resume", 1.0, 1),
    ("This agreement is hereby made", "contract", 1.0, 2), ("सेवा अनुबंध", "contract", 1.0, 1), ("ભાડા કરાર", "contract", 1.0, 2),
    ("Patient A; dosage 5 mg", "prescription", 1.0, 2), ("दवा का पर्चा", "prescription", 1.0, 2), ("દવા", "prescription", 1.0, 1),
    ("We certify, with official seal", "certificate", 1.0, 2), ("प्रमाण पत्र", "certificate", 1.0, 1), ("પ્રમાણ પત્ર", "certificate", 1.0, 1),
    ("Opening balance 5 - closing balance 6", "bank_statement", 1.0, 2), ("खाता विवरण", "bank_statement", 1.0, 1), ("બૅન્ક પાસબુક", "bank_statement", 1.0, 1),
    ("Marksheet, roll number 7", "marksheet", 1.0, 2), ("अंकसूची", "marksheet", 1.0, 1), ("માર્કશીટ", "marksheet", 1.0, 1),
    ("Ration Card", "ration_card", 1.0, 1), ("राशन कार्ड", "ration_card", 1.0, 1), ("રેશન કાર્ડ", "ration_card", 1.0, 1),
    ("Electricity bill; meter reading 88", "utility_bill", 1.0, 2), ("पानी बिल", "utility_bill", 0.6667, 1), ("વીજ બિલ", "utility_bill", 0.6667, 1),
    ("UIDAI - Aadhaar", "aadhar_card", 1.0, 2), ("आधार", "aadhar_card", 1.0, 1), ("આધાર", "aadhar_card", 1.0, 1),
    ("INCOME TAX DEPARTMENT / PAN card", "pan_card", 1.0, 2), ("पैन कार्ड", "pan_card", 1.0, 1), ("પૅન કાર્ડ", "pan_card", 1.0, 1),
    ("Driving Licence (LMV)", "driving_licence", 1.0, 2), ("ड्राइविंग लाइसेंस", "driving_licence", 1.0, 1), ("ડ્રાઇવિંગ લાઇસન્સ", "driving_licence", 1.0, 1),
    ("Passport P<IND", "passport", 1.0, 2), ("पासपोर्ट", "passport", 1.0, 1), ("પાસપોર્ટ", "passport", 1.0, 1),
    ("Payee of the cheque", "cheque", 1.0, 2), ("बैंक ड्राफ्ट", "cheque", 1.0, 1), ("ડ્રાફ્ટ", "cheque", 1.0, 1),
    ("Form 16, assessment year 2024", "form_16", 1.0, 2), ("टीडीएस", "form_16", 1.0, 1), ("ફૉર્મ 16", "form_16", 1.0, 1),
    ("Sum assured and premium", "insurance_policy", 1.0, 2), ("बीमा पॉलिसी", "insurance_policy", 1.0, 1), ("વીમો", "insurance_policy", 1.0, 1),
    ("GST registration certificate", "gst_certificate", 0.75, 1), ("जीएसटी प्रमाण पत्र", "gst_certificate", 0.6, 1), ("જીએસટી પ્રમાણ પત્ર", "gst_certificate", 0.6, 1),
    ("Place of birth: Surat. Birth-certificate", "birth_certificate", 0.8333, 2), ("जन्म प्रमाण पत्र", "birth_certificate", 0.6, 1), ("જન્મ દાખલો", "birth_certificate", 1.0, 1),
    ("cause of death", "death_certificate", 1.0, 1), ("मृत्यु प्रमाण पत्र", "death_certificate", 0.6, 1), ("મૃત્યુ દાખલો", "death_certificate", 1.0, 1),
    ("7/12 Utara", "land_record", 1.0, 1), ("7/12 उतारा, खसरा", "land_record", 1.0, 2), ("7/12 ઉતારો", "land_record", 1.0, 1),
    ("MGNREGA job card, gram panchayat", "nrega_card", 1.0, 3), ("नरेगा जॉब कार्ड", "nrega_card", 1.0, 1), ("નરેગા જૉબ કાર્ડ", "nrega_card", 1.0, 1),
    ("Invoices, subtotals and passports", "other", 0.0, 0), ("resume cheque", "resume", 0.5, 1), ("", "other", 0.0, 0),
)


@query(f"SELECT p_partkey, document_type, confidence, n_terms::BIGINT n_terms FROM part JOIN (VALUES {', '.join(f"({i}, '{kind}', CAST({share} AS DOUBLE), {n})" for i, (_, kind, share, n) in enumerate(SAID))}) AS e(i, document_type, confidence, n_terms) ON i = p_partkey % {len(SAID)}")
def classify_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a line of a document after them, as document types: every type in three scripts, terms within longer words, ties, no text."""
    said = F.get(F.array(*[F.lit(text) for text, *_ in SAID]), (F.col("p_partkey") % len(SAID)).cast("int"))
    texts = read(spark, sf_dir, "part").select("p_partkey", F.when(said != "", F.concat_ws("\n", "p_name", said, "p_name")).alias("text"))
    return by_keywords(texts, "p_partkey")


@query(rf"""WITH s AS (SELECT x.doc_id, script, CAST(x.doc_id * 13 % 100 AS DOUBLE) c, length(trim(t)) n, t FROM {SCRIPT} x), w AS (SELECT *, length(regexp_replace(t,'[^\p{{L}}\p{{N}}]','','g')) a, length(regexp_replace(t,'[\n ]','','g')) h, list_filter(regexp_split_to_array(t, '[\s\x{{0B}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '') ws FROM s),
g AS (SELECT *, CASE WHEN length(regexp_replace(t,'^\s+|\s+$','','g')) < 20 OR len(ws) = 0 THEN true ELSE len(list_filter(ws, lambda x: regexp_matches(x,'[a-zA-Z\x{{0900}}-\x{{097F}}\x{{0A80}}-\x{{0AFF}}]{{3,}}'))) / len(ws) < 0.40 OR (CASE WHEN h > 0 THEN 1 - a / h ELSE 1.0 END) > 0.35 END garbage FROM w)
SELECT doc_id, script <> 'eng' AND c < 80 AND n >= 80 targeted_retry, c < 65 AND (n < 120 OR garbage OR c < 55) aggressive, c < 60 AND NOT (c >= 50 AND n >= 500) AND n < 1000 easy, c < 60 AND NOT (c >= 50 AND n >= 500) AND n < 1000 AND script <> 'guj' paddle FROM g""")
def candidate_retry_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further readings of every document, with a confidence from its id; the packs in use are English only."""
    docs = mixed(read(spark, sf_dir, "documents")).withColumn("script", T.detect_script(F.col("text")))
    both = F.array(F.lit("hin"), F.lit("guj"))
    policy = retry_policy((F.col("doc_id") * 13 % 100).cast("double"), F.col("text"), F.lit("eng"), T.detect_language_set(both, F.col("script")), F.col("script"))
    return docs.select("doc_id", policy.alias("p")).select("doc_id", "p.*")
