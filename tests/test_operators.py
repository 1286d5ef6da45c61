"""Golden cases, odd rows and streams of the record operators, apart from their SQL."""

import json
import math

import pytest
from pyspark.sql import functions as F

from folioq.functions import json as J
from folioq.functions import text as T
from folioq.functions import values as V
from folioq.operators import catalogue, chunks, derive, exports, files, normalise, scoring, tables, truth, validation
from folioq.registry import REQUIRED, SCHEMAS, ddl, leaves, register_schema
from folioq.sources import envelopes
from folioq.streaming import rates

INVOICE = "doc_id long, subtotal double, tax double, total double, line_items array<struct<quantity: double, unit_price: double, total: double>>"


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_numbers(spark):
    assert each(spark, ["₹ 1,34,850", "Rs. 5", None, "", "1d", " -2.5e3 ", "€.5"], V.to_float) == [134850.0, None, None, None, None, -2500.0, 0.5]
    assert each(spark, [0.0, 5.0, None], lambda x: V.first_truthy(x, F.lit(0.0), F.lit(7.0)), "double") == [7.0, 5.0, 7.0]
    assert each(spark, [490.1, 489.0, 500.0], lambda x: V.is_close(F.lit(500.0), x), "double") == [True, False, True]
    assert each(spark, [0.95, 0.8999, 0.69, None], V.confidence_grade, "double") == ["A+", "B+", "D", "D"]
    assert each(spark, [0.5, 1.0, None], V.percent_text, "double")[:2] == ["50.0%", "100.0%"]


def test_dates(spark):
    given = ["04/03/2026", "12/25/2026", "March 4, 2026", "2026-13-99", "31/02/2026", "1/2/2024", "01-31-2024", "05 March, 2024", "5 Mar 2024", " 2024-01-02 ", None, ""]
    assert each(spark, given, V.parse_date_iso) == ["2026-03-04", "2026-12-25", "2026-03-04", "2026-13-99", None, "2024-02-01", "2024-01-31", "2024-03-05", "2024-03-05", "2024-01-02", None, None]
    loose = ["05-03-99", "05.03.68", "Mar 2020", "March 2020", "2020-07", "2019", "Present", "till date", "3/4/2021", None]
    assert [str(d) if d else None for d in each(spark, loose, V.parse_date_flexible)] == ["1999-03-05", "2068-03-05", "2020-03-01", "2020-03-01", "2020-07-01", "2019-01-01", None, None, "2021-04-03", None]


def test_phones(spark):
    assert each(spark, ["98765 43210", "+91-79-2345-6789", "ext", "", None, "९८७६५४३२१०"], V.normalise_phone) == ["+919876543210", "+917923456789", "ext", "", None, "९८७६५४३२१०"]


def test_texts(spark):
    assert each(spark, ["नमस्ते hello", "hello world", "", None, "નમસ્તે"], T.detect_script) == ["hin", "eng", "eng", "eng", "guj"]
    assert each(spark, ["short", None, "", "%%% ### $$$ @@@ !!! ((( )))", "plain words that make a sentence"], T.garbage_text) == [True, True, True, True, False]
    assert [len(x) if x else x for x in each(spark, ["a" * 8000, "a" * 8001, "a" * 11500, None, ""], T.chunk_text)][:3] == [1, 3, 4]
    assert each(spark, ["a/b c?.pdf", "..", None], lambda x: T.clean_filename(x, F.lit(5))) == ["b_c_.pdf", "upload_5", "upload_5"]
    assert each(spark, ["eng", "hin", "xx", None], T.language_name) == ["English", "Hindi", "xx", None]
    assert each(spark, [0.9, 0.7, 0.1], V.grade_badge, "double") == ["high", "medium", "low"]
    assert each(spark, ["क  x ક"], lambda x: T.clean_script(x, F.lit("hin"))) == ["क x "]
    pages = each(spark, ["--- Page 1 ---\none\n--- Page 2 (Language: Hindi, OCR Confidence: 78.5%, Engine: t) ---\ntwo", "no marks"], T.split_pages)
    assert [(p.page, p.confidence, p.text) for p in pages[0]] == [(1, None, "one"), (2, 78.5, "two")] and pages[1][0].text == "no marks"
    assert each(spark, ["[TABLE] a | b\n| c | d | [/TABLE] x | y"], T.parse_pipe_table) == [[["a", "b"], ["c", "d"]]]
    found = each(spark, ["PAN ABCDE1234F, x@y.org, 2024-01-02", None, ""], T.extract_identifiers)
    assert [(i.kind, i.value) for i in found[0]] == [("pan", "ABCDE1234F"), ("email", "x@y.org"), ("date", "2024-01-02")] and found[1:] == [[], []]


def test_language_is_told_in_one_reading(spark):
    """However often a code is asked for, the text is looked through once for each script."""
    texts = [None, "", "12 34", "a" * 85 + "क" * 15, "a" * 86 + "क" * 14, "ક" * 15 + "a" * 85, "कક" * 9 + "a" * 82, "ક" * 20 + "क" * 19, "[a]^_ é 漢 😀क"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("name", T.language_name(T.detect_script(F.col("t"))))
    want = ["English", "English", "English", "Hindi", "English", "Gujarati", "English", "Gujarati", "Hindi"]
    assert [r.name for r in df.orderBy("i").collect()] == want
    assert spark.createDataFrame([("tam",)], "c string").select(T.language_name(F.col("c"))).first()[0] == "tam"
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("regexp_") <= 3, plan.count("regexp_")


def test_chunks_reassemble(spark):
    text = "".join(chr(97 + i % 26) for i in range(20_123))
    parts = each(spark, [text], T.chunk_text)[0]
    assert parts[0] + "".join(p[500:] for p in parts[1:]) == text


@pytest.mark.parametrize(
    "row, errors, warnings",
    [
        ((0.0, 5.0, 50.0, [(0.0, 10.0, 99.0)]), 2, 1),  # zero quantity and subtotal are known values
        ((100.0, 0.0, 500.0, []), 0, 0),  # zero tax is unknown: the total isn't checked
        ((None, None, None, None), 0, 0),
        ((100.0, 10.0, 110.0, [(2.0, 50.0, 100.0)]), 0, 0),
        ((100.0, 10.0, 110.0, [(2.0, 0.0, 100.0)]), 0, 0),  # zero price is unknown
        ((50.0, 10.0, 60.0, [(2.0, 50.0, 100.0)]), 0, 1),
        ((50.0, 10.0, 90.0, [(2.0, 50.0, 120.0), (None, 1.0, 1.0)]), 2, 1),
    ],
)
def test_arithmetic(spark, row, errors, warnings):
    df = spark.createDataFrame([(1, *row)], INVOICE)
    found = df.select(F.concat(validation.check_line_math(F.col("line_items")), validation.check_total(F.col("subtotal"), F.col("tax"), F.col("total")), validation.check_subtotal(F.col("subtotal"), F.coalesce("line_items", F.array().cast(df.schema["line_items"].dataType)))).alias("f")).first().f
    assert (sum(f.severity == "error" for f in found), sum(f.severity == "warning" for f in found)) == (errors, warnings)


def test_audit(spark):
    rows = [(1, 100.0, 10.0, 110.0, [(2.0, 50.0, 100.0)]), (2, 100.0, 10.0, 500.0, [(2.0, 50.0, 100.0)]), (3, None, None, None, None)]
    got = {r.doc_id: r for r in validation.validate_invoices(spark.createDataFrame(rows, INVOICE)).collect()}
    assert got[1].is_valid and got[1].score == 1.0 and len(got[1].truth_tests) == 3 and got[1].findings == []
    assert not got[2].is_valid and (got[2].n_errors, got[2].n_warnings) == (1, 1) and got[2].score == pytest.approx(round(0.55 * (1 / 1.4 - 0.04) + 0.45 * 2 / 3, 4))
    assert got[3].is_valid and got[3].truth_tests == [] and got[3].score == 1.0
    assert validation.validate_invoices(spark.createDataFrame([], INVOICE)).count() == 0
    s = spark.range(1).select(validation.validation_score(F.lit(1), F.lit(0)).alias("a"), validation.validation_score(F.lit(0), F.lit(1), F.lit(0.0)).alias("b")).first()
    assert (round(s.a, 3), round(s.b, 3)) == (0.843, 0.528)


def test_line_math_at_the_bound(spark):
    """25 x 1181.14 is 29528.500000000004 in doubles; the total is 2 % less to the cent, so it passes both as check and as truth test."""
    rows = [(1, 28937.93, 0.0, 28937.93, [(25.0, 1181.14, 28937.93)]), (2, 28937.92, 0.0, 28937.92, [(25.0, 1181.14, 28937.92)])]
    got = {r.doc_id: r for r in validation.validate_invoices(spark.createDataFrame(rows, INVOICE)).collect()}
    assert {i: (r.truth_tests[0].passed, r.n_errors, r.n_warnings) for i, r in got.items()} == {1: (True, 0, 0), 2: (False, 1, 1)}
    data = {"subtotal": 28937.93, "tax": 0, "total": 28937.93, "line_items": [{"quantity": 25, "price": 1181.14, "total": 28937.93}]}
    tests = record(spark, "invoice", data).select(truth.truth_rules(F.col("document_type"), F.col("record"), F.current_date()).alias("t")).first().t
    assert [t.passed for t in tests if t.test_name == "line_math"] == [True]


def test_statement_balances(spark):
    rows = [(10.0, 15.0, [(None, 10.0, 20.0), (5.0, None, 15.0)]), (10.0, 16.0, [(None, 10.0, 21.0)]), (None, None, [])]
    df = spark.createDataFrame(rows, "opening double, closing double, transactions array<struct<debit: double, credit: double, balance: double>>")
    got = [[t.passed for t in r.t] for r in df.select(validation.truth_rules_statement(F.col("opening"), F.col("closing"), F.col("transactions")).alias("t")).collect()]
    assert got == [[True, True], [False, False], []]


def record(spark, kind, data):
    return spark.createDataFrame([(kind, json.dumps(data) if data is not None else None)], "document_type string, j string").select("document_type", F.parse_json("j").alias("record"))


def test_presence_rules(spark):
    """A missing key, a null, a blank text and an empty list under each rule."""
    k, v = F.col("document_type"), F.col("record")
    data = {"bank_name": None, "account_holder": "  ", "transactions": []}  # account_number is missing
    r = record(spark, "Bank_Statement", data).select(scoring.validate_required(k, v).alias("m"), scoring.extraction_confidence(k, v).alias("e"), scoring.schema_completeness(k, v).alias("c"), scoring.leaf_counts(v).alias("l")).first()
    assert r.m == ["Missing required field: account_number"] and r.e == 0.5 and r.c == 0.25 and tuple(r.l) == (3, 0)
    r = record(spark, "memo", {"x": 1}).select(scoring.validate_required(k, v).alias("m"), scoring.extraction_confidence(k, v).alias("e"), scoring.schema_completeness(k, v).alias("c"), scoring.data_quality(v).alias("q")).first()
    assert (r.m, r.e, r.c, r.q) == ([], 0.0, 1.0, 1.0)


def test_overall_score(spark):
    """Twelve of nineteen leaves of a complete invoice: 0.632, and 0.888 overall, a B+."""
    full = {path: "x" for path, _ in leaves(SCHEMAS["invoice"])}
    blank = [p for p in full if ".".join(p) not in REQUIRED["invoice"] and p[0] not in ("line_items", "subtotal", "total")][:7]
    data: dict = {}
    for path in full:
        at = data
        for p in path[:-1]:
            at = at.setdefault(p, {})
        at[path[-1]] = None if path in blank else [{"total": 5.0}] if path == ("line_items",) else 5.0 if path[-1] == "subtotal" else "x"
    r = scoring.comprehensive_score(record(spark, "invoice", data)).first()
    assert (r.completeness, r.data_quality, r.consistency, r.overall, r.grade) == (1.0, 0.632, 1.0, 0.888, "B+")
    assert scoring.comprehensive_score(record(spark, None, None)).first().overall is not None


def test_registry_is_open(spark):
    register_schema("Note", {"title": "string", "tags": ["string"]}, ("title",))
    try:
        k, v = F.col("document_type"), F.col("record")
        assert record(spark, "note", {"tags": []}).select(scoring.validate_required(k, v).alias("m")).first().m == ["Missing required field: title"]
    finally:
        SCHEMAS.pop("note"), REQUIRED.pop("note")
    assert len(SCHEMAS) == 21 and all(ddl(s).startswith("struct<") for s in SCHEMAS.values())


def test_normalise(spark):
    df = spark.sql("""SELECT named_struct('update', '1/2/2024', 'vendor', named_struct('phone', '98765 43210'), 'items', array(named_struct('unit_price', '₹ 1,000', 'note', '1,000'), named_struct('unit_price', '1234.50', 'note', null))) r UNION ALL SELECT null""")
    rows = normalise.normalise(df, "r").orderBy(F.col("r").isNull()).collect()
    assert [(c.field, c.normalised_value) for c in rows[0].changes] == [("update", "2024-02-01"), ("vendor.phone", "+919876543210"), ("items.0.unit_price", "1000.0")]
    assert rows[0].r.items[1].unit_price == "1234.50" and rows[0].r.items[0].note == "1,000" and rows[1].r is None and rows[1].changes == []
    again = normalise.normalise(normalise.normalise(df, "r").drop("changes"), "r").filter(F.size("changes") > 0)
    assert again.count() == 0


def test_replies(spark):
    texts = ['{"a": 1}', '```json\n{"a": 2}\n```', 'see {"a": 3} ok', '{"a": 4}}', "none", None, ""]
    assert each(spark, texts, lambda x: F.try_variant_get(J.parse_json_object(x), "$.a", "int")) == [1, 2, 3, None, None, None, None]
    arrays = ["[1, 2]", '{"a": 1}', "x [1, [2, 3]] y [4]", "```\n[5]\n```", "no", None, "[]"]
    assert each(spark, arrays, lambda x: F.size(J.parse_json_array(x)))[:5] == [2, 1, 2, 1, 0]
    r = each(spark, ['{"confidence": 1}', '{"document_type": "invoice", "confidence": 0.5}'], J.classification_ingest)
    assert [(x.document_type, x.confidence) for x in r] == [("other", 0.0), ("invoice", 0.5)]


def test_merging_one_chunk_changes_nothing(spark):
    df = spark.createDataFrame([(1, 0, "a", ["x", "x", None]), (2, 0, None, [])], "id long, chunk long, name string, tags array<string>")
    got = {r.id: r for r in chunks.merge_records(df, "id", "chunk", ["name"], ["tags"]).collect()}
    assert (got[1].name, got[1]._chunks_processed, got[2].name) == ("a", 1, None) and [t for t in got[1].tags if t] == ["x", "x"]
    two = spark.createDataFrame([(1, 0, "", ["a", "b"]), (1, 1, "n", ["b", "c", "c"])], df.schema)
    r = chunks.merge_records(two, "id", "chunk", ["name"], ["tags"]).first()
    assert (r.name, r.tags, r._chunks_processed) == ("n", ["a", "b", "c", "c"], 2)


def test_tables(spark):
    raw = [[["A", "B", "C"], ["1", "2", "3"], ["1", None, "3"], ["x"]], [["A"]], [["A", "A"], ["1", "2"]], [], None]
    got = each(spark, raw, tables.normalise_table, "array<array<string>>")
    assert got[0].data == [{"A": "1", "B": "2", "C": "3"}, {"A": "1", "B": "", "C": "3"}] and got[2].data == [{"A": "2"}]
    assert [bool(x) for x in each(spark, raw[:4], lambda x: tables.validate_table(tables.normalise_table(x)), "array<array<string>>")] == [True, False, True, False]
    three = [["A", "B", "C"], ["1", "2", "3"], ["4", "5", "6"]]
    df = spark.createDataFrame([(1, 1, three), (1, 2, three), (1, 3, [["X", "Y"], ["1", "2"]])], "doc long, ord long, raw array<array<string>>").select("doc", "ord", tables.normalise_table(F.col("raw")).alias("table"))
    assert [(r.ord, r.table_num) for r in tables.table_dedup(df, "doc", "ord").orderBy("ord").collect()] == [(1, 1), (3, 2)]


def test_exports(spark):
    rows = exports.export_records(spark.sql(f"SELECT 1 doc_id, from_json('{{\"pan_number\": \"P\", \"signature_present\": true}}', '{ddl(SCHEMAS['pan_card'])}') record UNION ALL SELECT 2, null"), "pan_card")
    assert {(r.key, r.value) for r in rows.collect() if r.value} == {("Pan Number", "P"), ("Signature Present", "true")} and rows.count() == len(SCHEMAS["pan_card"])


def test_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "b.png").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "c.txt").write_bytes(b"x")
    df = files.scan_binary_files(spark, str(tmp_path)).select(files.file_type(F.col("path")).alias("k"), files.magic_bytes(F.col("path"), F.col("content")).alias("m"), files.size_limit(F.col("length")).alias("s"))
    assert sorted(map(tuple, df.collect())) == [("image", "warning", True), ("pdf", "ok", True), ("unknown", "error", True)]


def test_derived(spark):
    assert each(spark, ["ABCPE1234F", "", None], derive.derive_pan_type) == ["Individual", None, None]
    assert each(spark, ["27ABCDE1234F1Z5", "99", None], derive.derive_gst_state) == ["Maharashtra", None, None]
    assert each(spark, ["a/b/c/d/e", "a/b", None], lambda x: derive.split_job_card(x)["state"]) == ["a", None, None]


def test_envelopes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"status": "success"}')
    (tmp_path / "in/b.json").write_text("{broken")
    assert sorted(r.status for r in envelopes.scan_json_envelopes(spark, str(tmp_path / "in")).collect()) == ["error", "success"]
    (tmp_path / "c.csv").write_text("a,b\n1,é\n2,\n")
    wrapped = envelopes.scan_csv_wrapped(spark, str(tmp_path / "c.csv")).select(F.to_json("record").alias("j")).first().j
    assert json.loads(wrapped)["_source_format"] == "csv" and len(json.loads(wrapped)["rows"]) == 2
    df = spark.createDataFrame([(1, "é", None)], "id long, a string, b string")
    envelopes.sink_json(df, str(tmp_path / "j"))
    envelopes.sink_csv(df, str(tmp_path / "k"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first().value) == {"id": 1, "a": "é", "b": None}
    assert spark.read.option("header", True).csv(str(tmp_path / "k")).first().a == "é"
    report = validation.validate_invoices(spark.createDataFrame([(1, 1.0, 1.0, 5.0, [])], INVOICE)).withColumn("document_type", F.lit("invoice"))
    envelopes.sink_reports(report, str(tmp_path / "r"), "t1")
    envelopes.sink_reports(report, str(tmp_path / "r"), "t2")
    assert spark.read.parquet(str(tmp_path / "r")).count() == 2
    assert catalogue.validation_rows(report, "doc_id").first().status == "failed"


def run_stream(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = run_stream(spark, rates.stream_rates(stream()), "rates_out", "complete")
    assert sorted(map(str, got)) == sorted(map(str, rates.stream_rates(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()))
    got = run_stream(spark, rates.stream_sessions(stream()), "sessions_out", "complete")
    assert sum(r.n for r in got) == events.count()
    got = run_stream(spark, rates.stream_dedup(stream(), "event_type", "ts", "40000 days"), "dedup_out", "append")
    assert len({r.event_type for r in got}) == len(got) == events.select("event_type").distinct().count()


def test_stream_validate(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"doc_id": "1", "subtotal": 100, "tax": 10, "total": 500, "line_items": []}\n{"doc_id": "2"}\n')
    got = {r.doc_id: r for r in run_stream(spark, rates.stream_validate(spark, str(tmp_path)), "audits_out", "append")}
    assert not got["1"].is_valid and got["2"].is_valid and math.isclose(got["2"].score, 1.0)


def test_open_leaves_match_brute_force(spark):
    """Leaves of nested records with any keys, scalars in place of objects, and types that nobody registered."""
    from folioq.functions import variants

    def leaves_of(value, path=""):
        if isinstance(value, dict):
            return [x for k, v in value.items() for x in leaves_of(v, f"{path}.{k}" if path else k)]
        return [(path, bool(value) if isinstance(value, list) else value is not None and bool(str(value).strip()))]

    def opened(value, path=""):
        parts = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
        return [path] if parts is None else [x for k, v in parts for x in opened(v, f"{path}.{k}" if path else str(k))]

    deep: dict = {"end": 1}
    for i in range(12):
        deep = {f"d{i}": deep, "t": 'a "quoted{" [text'}
    data = [{"invoice_number": "1", "extra": "", "other": None, "vendor": "ACME"}, {"x": 1, "y": ""}, {"vendor": {"name": {"first": " \u00a0 ", "last": "b"}}, "l": [], "m": [[{"a": [1, {"b": {}}]}], 2], "o": {}}, {}, [], "text", 5, None, deep, {"f": False, "z": 0, "n": [None]}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "i int, j string").withColumn("record", F.parse_json("j"))
    rows = df.select("i", scoring.leaf_counts(F.col("record")).alias("c"), scoring.data_quality(F.col("record")).alias("q"), scoring.walk_leaves(F.col("record")).alias("w"), variants.walk(F.col("record"), lists=True)["path"].alias("p")).orderBy("i").collect()
    for r, d in zip(rows, data, strict=True):
        want = leaves_of(d)
        assert tuple(r.c) == (len(want), sum(ok for _, ok in want))
        assert r.q == (sum(ok for _, ok in want) / len(want) if want else 0.0)
        assert sorted(x.path for x in r.w) == sorted(p for p, _ in want)
        assert sorted(r.p) == sorted(opened(d))
    assert df.limit(0).select(scoring.leaf_counts(F.col("record"))).collect() == []
    assert spark.createDataFrame([(None,)], "j string").select(scoring.data_quality(F.parse_json("j")).alias("q")).first().q == 0.0


def test_amounts_in_words_round_trip(spark):
    """Numbers said in words, up to 99,99,99,999, and texts that are none."""
    from folioq.functions.words import TENS, UNITS, amount_in_words

    def say(n):
        if n < 20:
            return UNITS[n]
        if n < 100:
            return TENS[n // 10 - 2] + (f"-{UNITS[n % 10]}" if n % 10 else "")
        if n < 1000:
            return f"{UNITS[n // 100]} hundred" + (f" and {say(n % 100)}" if n % 100 else "")
        size, name = next((s, w) for s, w in ((10**7, "crore"), (10**5, "lakh"), (10**3, "thousand")) if n >= s)
        return f"{say(n // size)} {name}" + (f" {say(n % size)}" if n % size else "")

    numbers = [*range(1200), *(n * 7919 % 999_999_999 for n in range(1, 999_999_999, 777_777)), 999_999_999]
    df = spark.createDataFrame([(n, f"Rupees {say(n).title()} Only") for n in numbers], "n long, t string")
    assert df.filter(~F.coalesce(amount_in_words(F.col("t")) == F.col("n"), F.lit(False))).count() == 0
    odd = spark.createDataFrame([("two thousand crore",), ("Five Hundred Rupees and Twenty-Five Paise",), ("fifty bananas",), ("only",), (None,), ("",)], "t string")
    assert [r.x for r in odd.select(amount_in_words(F.col("t")).alias("x")).collect()] == [2e10, 500.25, None, None, None, None]


def test_audit_takes_what_comes(spark):
    """Nulls, records that are no objects, unknown types, clashing names, an empty table."""
    from folioq.operators.audit import audit

    rows = [(1, None, None), (2, "invoice", "[1]"), (3, None, '{"subtotal": "a", "tax": [], "total": {}}'), (4, "INVOICE", '{"line_items": "none", "items": {"a": 1}, "subtotal": null}'), (5, "resume", '{"education": [null, "x", {"graduation_date": 2099}], "experience": 5}')]
    df = spark.createDataFrame(rows, "doc_id int, document_type string, j string").select("doc_id", "document_type", F.parse_json("j").alias("record"), F.lit("kept").alias("report"), F.lit(1).alias("findings"))
    out = audit(df, F.to_date(F.lit("2024-06-15"))).orderBy("doc_id").collect()
    assert [(r.n_errors, r.n_warnings, len(r.truth_tests), r.changes, r.report) for r in out] == [(0, 0, 0, [], "kept")] * 4 + [(0, 2, 1, [], "kept")]
    assert [r.score for r in out] == [1.0] * 4 + [0.506]
    assert audit(df.limit(0), F.to_date(F.lit("2024-06-15"))).count() == 0


def test_nested_merge_matches_a_fold(spark):
    """Records of up to three chunks against the merge of two dictionaries after the other."""
    import random

    kind = "struct<name: string, n: double, tags: array<string>, vendor: struct<name: string, lines: array<struct<a: double, b: string>>, deep: struct<flag: boolean, list: array<double>>>>"

    def merged(base, update):
        if not base:
            return json.loads(json.dumps(update))
        for key, val in update.items():
            if base.get(key) is None or base[key] == "":
                base[key] = json.loads(json.dumps(val))
            elif isinstance(base[key], list) and isinstance(val, list):
                known = {str(x) for x in base[key]}
                base[key] += [x for x in val if str(x) not in known]
            elif isinstance(base[key], dict) and isinstance(val, dict):
                base[key] = merged(base[key], val)
        return base

    rng = random.Random(2)
    some = lambda *x: rng.choice([None, *x])
    lists = lambda item: some([], [item() for _ in range(rng.randrange(1, 4))])
    deep = lambda: some({"flag": some(True, False), "list": lists(lambda: float(rng.randrange(3)))})
    vendor = lambda: some({"name": some("", "v", "w"), "lines": lists(lambda: {"a": some(1.0), "b": some("x", "")}), "deep": deep()})
    record = lambda: {"name": some("", "a", "b"), "n": some(0.0, 2.0), "tags": lists(lambda: some("p", "q", "")), "vendor": vendor()}
    docs = {i: [record() for _ in range(rng.randrange(1, 4))] for i in range(60)}
    rows = [(i, c, json.dumps(r)) for i, rs in docs.items() for c, r in enumerate(rs)]
    df = spark.createDataFrame(rows, "id int, chunk int, j string").select("id", "chunk", F.from_json("j", kind).alias("record"))
    got = {r.id: r.record.asDict(recursive=True) for r in chunks.merge_nested(df, "id", "chunk", "record").collect()}
    for i, rs in docs.items():
        want = {}
        for r in rs:
            want = merged(want, r)
        assert got[i] == want, (rs, got[i])
    assert chunks.merge_nested(df.limit(0), "id", "chunk", "record").count() == 0


def test_csv_cells_match_a_reader(spark):
    """Quotes, doubled quotes, line breaks in cells, blank lines, short and long rows, repeated headers, against the reader of the standard library."""
    import csv
    import io

    from folioq.sources.envelopes import csv_rows, scan_dispatch

    texts = ['a,b\n1,2\n', 'a,b\r\n"x, y",2\r\n', '"say ""hi""","l1\nl2"\n\n\nz,', "a", "", "\n\n", 'p"q,r\n', '"ab"c,d\n', ",,\n", '""\n"",x\n', "é,ü\n\u4e2d,文"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", csv_rows(F.col("t")).alias("r")).orderBy("i")
    for row, text in zip(df.collect(), texts, strict=True):
        assert row.r == [r for r in csv.reader(io.StringIO(text, newline="")) if r and r != [""]]
    files = [("a.csv", "x,x,y\n1,2\n3,4,5,6\n"), ("b.csv", 'x\n"open'), ("c.json", '{"x": 1} junk'), ("d.JSON", '{"x": 1}'), ("e.csv", ""), ("f.csv", None), ("g", "1")]
    got = {r.path: (r.status, r.error, r.j) for r in scan_dispatch(spark.createDataFrame(files, "path string, content string")).withColumn("j", F.to_json("record")).collect()}
    assert json.loads(got["a.csv"][2])["rows"] == [{"x": "2", "y": None}, {"x": "4", "y": "5"}]
    assert [got[k][1] for k in ("b.csv", "c.json", "d.JSON", "f.csv", "g")] == ["Invalid CSV", "Invalid JSON", None, "Invalid CSV", "Unsupported file type"]
    assert json.loads(got["e.csv"][2])["rows"] == []


def test_values_that_follow_closely(spark):
    text = "ABCDE1234F ABCDE1234G 2024-01-02 2024-01-03,3/4/2024 +91 98765 43210 12024-01-02"
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    got = [[tuple(x) for x in r.i] for r in df.select(T.extract_identifiers(F.col("t")).alias("i")).collect()]
    assert got == [[("pan", "ABCDE1234F"), ("pan", "ABCDE1234G"), ("phone", "+91 98765 43210"), ("date", "2024-01-02"), ("date", "2024-01-03"), ("date", "3/4/2024")], [], []]
    table = "[TABLE]\n|a|b|\n[/TABLE] x | y [TABLE]c | d[/TABLE]"
    assert spark.createDataFrame([(table,)], "t string").select(T.parse_pipe_table(F.col("t")).alias("x")).first().x == [["a", "b"], ["c", "d"]]
