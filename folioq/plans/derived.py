"""Queries over derived values and file checks, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import derive as D
from folioq.operators import files as L
from folioq.plans.base import query, read


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 5.0 + o_orderkey ELSE o_totalprice END total, CASE WHEN o_orderkey % 2 = 0 THEN 'INR' ELSE 'USD' END currency FROM orders")
def derive_invoice_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    total = D.derive_invoice_total(F.when(k % 3 != 0, F.col("o_totalprice")), k.cast("double"), F.lit(5.0))
    return read(spark, sf_dir, "orders").select(k, total.alias("total"), D.derive_currency(F.when(k % 2 == 0, "INR")).alias("currency"))


@query("WITH m AS (SELECT o_orderkey, (2024 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) n, o_orderkey % 40 j FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN n // 12 || ' years ' || n % 12 || ' months' ELSE j // 12 || ' years ' || j % 12 || ' months' END duration FROM m")
def derive_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from orders; every third goes on and is counted to June 2024."""
    k, start = F.col("o_orderkey"), F.to_date("o_orderdate")
    end = F.when(k % 3 != 0, F.add_months(F.trunc(start, "month"), (k % 40).cast("int")))
    return read(spark, sf_dir, "orders").select(k, D.derive_duration(start, end, F.to_date(F.lit("2024-06-15"))).alias("duration"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE l_extendedprice - l_quantity END units FROM lineitem")
def derive_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = D.derive_units(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")), F.col("l_quantity"), F.col("l_extendedprice"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", units.alias("units"))


@query("SELECT p_partkey, round(CASE WHEN p_partkey % 50 > 0 THEN CAST(p_size AS DOUBLE) / (p_partkey % 50) * 100 END, 2) percentage FROM part")
def derive_percentage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", D.derive_percentage(F.col("p_size").cast("double"), (F.col("p_partkey") % 50).cast("double")).alias("percentage"))


LETTERS = "PCHFATBLJGXZ"


@query("SELECT c_custkey, CASE substr('" + LETTERS + "', CAST(c_custkey % 12 + 1 AS INT), 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.PAN_TYPES.items()) + " END holder FROM customer")
def derive_pan_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = F.substring(F.lit(LETTERS), (F.col("c_custkey") % 12 + 1).cast("int"), F.lit(1))
    return read(spark, sf_dir, "customer").select("c_custkey", D.derive_pan_type(F.concat(F.lit("abc"), F.lower(letter), F.lit("e1234f"))).alias("holder"))


#: States by their code from 1 to 38, as SQL text.
STATES = (
    "Jammu and Kashmir,Himachal Pradesh,Punjab,Chandigarh,Uttarakhand,Haryana,Delhi,Rajasthan,Uttar Pradesh,Bihar,Sikkim,Arunachal Pradesh,Nagaland,Manipur,Mizoram,Tripura,Meghalaya,Assam,West Bengal,"
    "Jharkhand,Odisha,Chhattisgarh,Madhya Pradesh,Gujarat,Daman and Diu,Dadra and Nagar Haveli,Maharashtra,Andhra Pradesh,Karnataka,Goa,Lakshadweep,Kerala,Tamil Nadu,Puducherry,Andaman and Nicobar Islands,"
    "Telangana,Andhra Pradesh,Ladakh"
)


@query(f"SELECT c_custkey, string_split('{STATES}', ',')[nullif(c_custkey % 40, 0)] state FROM customer")
def derive_gst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    gstin = F.concat(F.lpad((F.col("c_custkey") % 40).cast("string"), 2, "0"), F.lit("ABCDE1234F1Z5"))
    return read(spark, sf_dir, "customer").select("c_custkey", D.derive_gst_state(gstin).alias("state"))


@query("WITH d AS (SELECT o_orderkey, CASE WHEN month(o_orderdate) >= 4 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END y, month(o_orderdate) m FROM orders) SELECT o_orderkey, (y + 1) || '-' || lpad(CAST((y + 2) % 100 AS VARCHAR), 2, '0') assessment_year, 'Q' || CASE WHEN m >= 4 THEN (m - 1) // 3 ELSE 4 END AS quarter FROM d")
def derive_assessment_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", D.derive_assessment_year(F.to_date("o_orderdate")).alias("y")).select("o_orderkey", "y.*")


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) total_days_worked, CAST(sum(l_linenumber * 10) AS DOUBLE) total_wages_earned FROM lineitem GROUP BY 1")
def derive_nrega_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.collect_list(F.struct(F.col("l_quantity").alias("days_worked"), (F.col("l_linenumber") * 10).alias("amount_earned")))
    cards = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(entries.alias("entries"))
    return cards.select("l_orderkey", D.derive_nrega_totals(F.col("entries")).alias("t")).select("l_orderkey", "t.*")


@query("SELECT c_custkey, CASE WHEN ok THEN 'GJ' END state, CASE WHEN ok THEN lpad(CAST(c_nationkey AS VARCHAR), 2, '0') END district, CASE WHEN ok THEN '003' END block, CASE WHEN ok THEN '04' END panchayat, CASE WHEN ok THEN CAST(c_custkey AS VARCHAR) END household FROM (SELECT *, c_custkey % 7 <> 0 ok FROM customer)")
def split_job_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat_ws("/", F.lit("GJ"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("003"), F.lit("04"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey").cast("string")))
    return read(spark, sf_dir, "customer").select("c_custkey", D.split_job_card(number).alias("p")).select("c_custkey", "p.*")


@query("""SELECT c_custkey, CASE WHEN ok THEN 'IND' END issuer, CASE WHEN ok THEN 'DOE' || c_nationkey END surname, CASE WHEN ok THEN 'JANE ANN' END given_names, CASE WHEN ok THEN 'K' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS number, CASE WHEN ok THEN 'IND' END nationality, CASE WHEN ok THEN '900101' END dob, CASE WHEN ok THEN 'F' END sex, CASE WHEN ok THEN '300101' END expiry FROM (SELECT *, c_custkey % 9 <> 0 ok FROM customer)""")
def split_mrz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine-readable lines from customers; every ninth is cut short."""
    k = F.col("c_custkey")
    one = F.rpad(F.concat(F.lit("P<INDDOE"), F.col("c_nationkey").cast("string"), F.lit("<<JANE<ANN")), 44, "<")
    two = F.rpad(F.concat(F.lit("K"), F.lpad(k.cast("string"), 7, "0"), F.lit("<1IND9001017F3001015")), 44, "<")
    return read(spark, sf_dir, "customer").select(k, D.split_mrz(one, F.when(k % 9 == 0, F.substring(two, 1, 40)).otherwise(two)).alias("p")).select("c_custkey", "p.*")


EXTS = (".pdf", ".PDF", ".docx", ".doc", ".png", ".jpeg", ".bmp", ".tiff", ".txt", "")
HEADS = ("255044462D312E34", "504B0304", "89504E470D0A1A0A", "FFD8FFE0", "424D0000", "49492A00", "6162")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: the suffix comes from the id, the first bytes from the id divided by ten, the size from the text."""
    k = F.col("doc_id")
    name = F.concat(F.lit("in/f"), k.cast("string"), F.get(F.array(*map(F.lit, EXTS)), (k % 10).cast("int")))
    head = F.unhex(F.get(F.array(*map(F.lit, HEADS)), (F.floor(k / 10) % 7).cast("int")))
    return read(spark, sf_dir, "documents").select(k, "text", name.alias("name"), head.alias("content"), F.length("text").cast("long").alias("length"))


KIND = "CASE doc_id % 10 WHEN 0 THEN 'pdf' WHEN 1 THEN 'pdf' WHEN 2 THEN 'docx' WHEN 3 THEN 'docx' WHEN 8 THEN 'unknown' WHEN 9 THEN 'unknown' ELSE 'image' END"


@query(f"SELECT doc_id, {KIND} kind FROM documents")
def file_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("doc_id", L.file_type(F.col("name")).alias("kind"))


@query("SELECT doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 8, 9)")
def allowed_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).filter(L.allowed_extension(F.col("name"))).select("doc_id")


@query("SELECT doc_id, coalesce(length(text) <= 2000, false) accepted FROM documents")
def size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("doc_id", L.size_limit(F.col("length"), 2000).alias("accepted"))


@query("""SELECT doc_id, CASE WHEN (e IN (0, 1) AND h = 0) OR (e = 2 AND h = 1) OR (e = 4 AND h = 2) OR (e = 5 AND h = 3) OR (e = 6 AND h = 4) OR (e = 7 AND h = 5) THEN 'ok' WHEN e BETWEEN 4 AND 7 AND h BETWEEN 2 AND 5 THEN 'warning' ELSE 'error' END signature FROM (SELECT doc_id, doc_id % 10 e, doc_id // 10 % 7 h FROM documents)""")
def magic_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return uploads(spark, sf_dir).select("doc_id", L.magic_bytes(F.col("name"), F.col("content")).alias("signature"))


@query("SELECT p_partkey, CAST(CASE WHEN p_size * 40 < 800 OR p_partkey % 1000 < 600 THEN 0.6 ELSE 1.0 END AS DOUBLE) score, CASE WHEN p_size * 40 < 800 OR p_partkey % 1000 < 600 THEN 'Low resolution' END issue FROM part")
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images: the width from the size, the height from the key."""
    return read(spark, sf_dir, "part").select("p_partkey", L.image_quality(F.col("p_size") * 40, F.col("p_partkey") % 1000).alias("q")).select("p_partkey", "q.*")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 NOT IN (3, 8, 9) AND coalesce(length(text) <= 2000, false)")
def readable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without issues of suffix or size."""
    issues = F.array_compact(F.array(F.when(~L.allowed_extension(F.col("name")), "extension"), F.when(~L.size_limit(F.col("length"), 2000), "size")))
    return L.readable_filter(uploads(spark, sf_dir).withColumn("issues", issues))[0].select("doc_id")


SCANNED = "length(trim(substr(coalesce(text, ''), 1, CAST(doc_id % 150 AS INT)))) < 50 OR (length(trim(substr(coalesce(text, ''), 1, CAST(doc_id % 150 AS INT)))) < 100 AND doc_id % 2 = 0)"


@query(f"SELECT doc_id, {SCANNED} scanned FROM documents")
def scanned_text_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pages of up to 149 characters; every second has images."""
    first = F.substring(F.coalesce("text", F.lit("")), F.lit(1), (F.col("doc_id") % 150).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", L.scanned_text_flag(first, F.col("doc_id") % 2 == 0).alias("scanned"))


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') t, {KIND} kind, {SCANNED} scanned FROM documents), w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\s\x{{0B}}\x{{85}}\p{{Z}}]+'), lambda x: x <> '') ws, length(regexp_replace(t,'[^\p{{L}}\p{{N}}]','','g')) a, length(regexp_replace(t,'[\n ]','','g')) h FROM d),
g AS (SELECT *, CASE WHEN length(regexp_replace(t,'^\s+|\s+$','','g')) < 20 OR len(ws) = 0 THEN true ELSE len(list_filter(ws, lambda x: regexp_matches(x,'[a-zA-Z]{{3,}}'))) / len(ws) < 0.40 OR (CASE WHEN h > 0 THEN 1 - a / h ELSE 1.0 END) > 0.35 END garbage FROM w)
SELECT doc_id, CASE kind WHEN 'pdf' THEN CASE WHEN scanned OR garbage THEN 'ocr' ELSE 'pdf' END WHEN 'docx' THEN 'docx' WHEN 'image' THEN 'ocr' END route FROM g""")
def extractor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring(F.coalesce("text", F.lit("")), F.lit(1), (F.col("doc_id") % 150).cast("int"))
    files = uploads(spark, sf_dir).withColumn("scanned", L.scanned_text_flag(first, F.col("doc_id") % 2 == 0))
    return files.select("doc_id", L.extractor_route(L.file_type(F.col("name")), F.col("scanned"), F.col("text")).alias("route"))
