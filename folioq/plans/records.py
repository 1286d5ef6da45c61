"""Queries over records of the registered types, built from customers, with SQL computed from the same keys.

Leaf j of the record of customer k is null where (7k + 3j) mod 11 is 0, blank (numbers: null) where it is 1; every fifth record
leaves nulls out, so that its keys are missing. Lists have (k + j) mod 4 items.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.operators import exports as X
from folioq.operators import scoring as C
from folioq.plans.base import ORACLE_SQL, QUERIES, query, read
from folioq.registry import B, M, N, REQUIRED, S, SCHEMAS, ddl, leaves

TYPES = list(SCHEMAS)


def number(t: str) -> dict[tuple[str, ...], int]:
    return {path: j for j, (path, _) in enumerate(leaves(SCHEMAS[t]))}


def value(spec: Any, path: tuple[str, ...], places: dict[tuple[str, ...], int]) -> str:
    """The generated value of a field as a Spark SQL expression over k."""
    if isinstance(spec, dict):
        return "named_struct(" + ", ".join(f"'{f}', {value(v, (*path, f), places)}" for f, v in spec.items()) + ")"
    j, name = places[path], path[-1]
    at = f"pmod(k * 7 + {j * 3}, 11)"
    if isinstance(spec, list):
        return f"if((k + {j}) % 4 > 0, transform(sequence(0L, (k + {j}) % 4 - 1), i -> {item(spec[0], name)}), cast(array() as array<{ddl(spec[0])}>))"
    if spec == S:
        return f"case when {at} = 1 then '  ' when {at} > 1 then concat('{name} ', k) end"
    if spec == N:
        return f"if({at} > 1, (k * 13 + {j * 17}) % 1000 / 4.0D, null)"
    return f"if({at} > 1, k % 2 = 0, null)" if spec == B else f"if({at} > 0, map('note', concat('n ', k)), null)"


def item(spec: Any, name: str) -> str:
    if isinstance(spec, dict):
        return "named_struct(" + ", ".join(f"'{f}', {field(v, f, m)}" for m, (f, v) in enumerate(spec.items())) + ")"
    return f"concat_ws(' ', '{name}', k, i)"


def field(spec: Any, f: str, m: int) -> str:
    text = f"concat_ws(' ', '{f}', k, i)"
    return f"array({text})" if isinstance(spec, list) else f"(k * 13 + i * 7 + {m}) % 1000 / 4.0D" if spec == N else "true" if spec == B else text


def typed(spark: SparkSession, sf_dir: str, t: str) -> DataFrame:
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return keys.select(F.col("k").alias("doc_id"), F.expr(value(SCHEMAS[t], (), number(t))).alias("record"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, document_type, record) with the types in turn."""
    made = " ".join(f"when {i} then to_json({value(SCHEMAS[t], (), number(t))}, map('ignoreNullFields', 'false'))" for i, t in enumerate(TYPES))
    kinds = ", ".join(f"'{t}'" for t in TYPES)
    keys = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    written = keys.select("k", F.expr(f"get(array({kinds}), cast(k % {len(TYPES)} as int))").alias("document_type"), F.expr(f"case k % {len(TYPES)} {made} end").alias("json"))
    bare = F.regexp_replace(F.regexp_replace("json", '"[a-z_0-9]+":null,?', ""), ",}", "}")
    return written.select(F.col("k").alias("doc_id"), "document_type", F.parse_json(F.when(F.col("k") % 5 == 0, bare).otherwise(F.col("json"))).alias("record"))


#: What every sixth record holds beside its schema; keys a schema doesn't know, nested, with lists of objects.
EXTRA = """named_struct('extra', named_struct('note', concat('x ', k), 'blank', ' ', 'deep', named_struct('none', cast(null as string), 'list', array(named_struct('a', k)), 'bare', cast(array() as array<string>), 'low', named_struct('flag', k % 2 = 0))))"""


def open_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records() as they come: every sixth has keys outside its schema, and every tenth is of a type that nobody registered."""
    k = F.col("doc_id")
    more = F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.when(F.col("j") == "{}", "").otherwise(","), F.expr(f"substring(to_json({EXTRA}, map('ignoreNullFields', 'false')), 2)"))
    rows = records(spark, sf_dir).withColumn("j", F.to_json("record")).withColumn("k", k)
    odd = F.expr("concat('{\"memo\":\"m ', k, '\",\"empty\":\"\",\"of\":{\"x\":', k, '},\"bare\":{}}')")
    written = F.when(k % 10 == 9, odd).when(k % 6 == 0, more).otherwise(F.col("j"))
    return rows.select("doc_id", F.when(k % 10 == 9, "memo").otherwise(F.col("document_type")).alias("document_type"), F.parse_json(written).alias("record"))


# ---- SQL from the rule of the data, not from the records


def state(j: int) -> str:
    return f"(k * 7 + {j * 3}) % 11"


def spec_of(t: str, path: str) -> tuple[int, Any]:
    place = tuple(path.split("."))
    return number(t)[place], dict(leaves(SCHEMAS[t]))[place]


def missing(t: str, path: str) -> str:
    j, spec = spec_of(t, path)
    return "false" if isinstance(spec, list) else f"(k % 5 = 0 AND {state(j)} <= {0 if spec in (S, M) else 1})"


def valued(t: str, path: str) -> str:
    j, spec = spec_of(t, path)
    return "true" if isinstance(spec, list) else f"({state(j)} > {0 if spec in (S, M) else 1})"


def filled(t: str, path: str) -> str:
    j, spec = spec_of(t, path)
    return "true" if isinstance(spec, list) else f"({state(j)} > {0 if spec == M else 1})"


def summed(flags: list[str]) -> str:
    return "(" + " + ".join(f"CAST({f} AS INT)" for f in flags) + ")"


def case(of: Callable[[str], str]) -> str:
    return "CASE t " + " ".join(f"WHEN {i} THEN {of(t)}" for i, t in enumerate(TYPES)) + " END"


PEOPLE = f"(SELECT c_custkey k, c_custkey % {len(TYPES)} t FROM customer)"
KIND = case(lambda t: f"'{t}'")
COMPLETE = case(lambda t: f"{summed([filled(t, p) for p in REQUIRED[t]])} / {len(REQUIRED[t])}")
LEAVES = {t: [".".join(p) for p, _ in leaves(SCHEMAS[t])] for t in TYPES}
N_LEAVES = case(lambda t: summed([f"NOT {missing(t, p)}" for p in LEAVES[t]]))
N_VALID = case(lambda t: summed([f"((k + {spec_of(t, p)[0]}) % 4 > 0)" if isinstance(spec_of(t, p)[1], list) else filled(t, p) for p in LEAVES[t]]))
ITEMS, TOTAL_AT = spec_of("invoice", "line_items")[0], list(SCHEMAS["invoice"]["line_items"][0]).index("total")
SUB = spec_of("invoice", "subtotal")[0]
STATED = f"CASE WHEN {state(SUB)} > 1 THEN (k * 13 + {SUB * 17}) % 1000 / 4.0 ELSE 0 END"
LINES = f"list_sum(list_transform(range(0, (k + {ITEMS}) % 4), lambda i: (k * 13 + i * 7 + {TOTAL_AT}) % 1000 / 4.0))"
CONSISTENT = f"CAST(CASE WHEN t = {TYPES.index('invoice')} AND NOT {missing('invoice', 'subtotal')} AND {STATED} > 0 AND abs(coalesce({LINES}, 0) - {STATED}) > 0.01 THEN 0.0 ELSE 1.0 END AS DOUBLE)"
#: The same for open records: the extra keys are six leaves of which three say something, a memo has three leaves of which two do.
MEMO = "k % 10 = 9"
OPEN_LEAVES = f"CASE WHEN {MEMO} THEN 3 ELSE {N_LEAVES} + CASE WHEN k % 6 = 0 THEN 6 ELSE 0 END END"
OPEN_VALID = f"CASE WHEN {MEMO} THEN 2 ELSE {N_VALID} + CASE WHEN k % 6 = 0 THEN 3 ELSE 0 END END"
OPEN_PARTS = f"(SELECT k, t, CASE WHEN {MEMO} THEN 1.0 ELSE {COMPLETE} END c, ({OPEN_VALID}) / ({OPEN_LEAVES}) q, CASE WHEN {MEMO} THEN 1.0 ELSE {CONSISTENT} END s, (k % 21) / 20.0 o FROM {PEOPLE})"
PARTS = f"(SELECT k, t, {COMPLETE} c, {N_VALID} / {N_LEAVES} q, {CONSISTENT} s, (k % 21) / 20.0 o FROM {PEOPLE})"


@query(f"SELECT k doc_id, {KIND} document_type, list_aggregate({case(lambda t: 'list_filter([' + ', '.join(f'''CASE WHEN {missing(t, p)} THEN 'Missing required field: {p}' END''' for p in REQUIRED[t]) + '], lambda x: x IS NOT NULL)')}, 'string_agg', '; ') AS messages FROM {PEOPLE}")
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = C.validate_required(F.col("document_type"), F.col("record"))
    return records(spark, sf_dir).select("doc_id", "document_type", F.nullif(F.array_join(said, "; "), F.lit("")).alias("messages"))


@query(f"SELECT k doc_id, round({case(lambda t: f'{summed([valued(t, p) for p in REQUIRED[t]])} / {len(REQUIRED[t])}')}, 2) confidence FROM {PEOPLE}")
def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", C.extraction_confidence(F.col("document_type"), F.col("record")).alias("confidence"))


@query(f"SELECT k doc_id, round({COMPLETE}, 4) completeness FROM {PEOPLE}")
def schema_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", F.round(C.schema_completeness(F.col("document_type"), F.col("record")), 4).alias("completeness"))


@query(f"SELECT {KIND} document_type, CAST(sum({summed(['true'])} * {case(lambda t: str(len(REQUIRED[t])))}) AS BIGINT) n_required, CAST(sum({case(lambda t: summed([filled(t, p) for p in REQUIRED[t]]))}) AS BIGINT) n_present FROM {PEOPLE} GROUP BY 1")
def required_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required fields and those with content by type."""
    expanded = C.required_field_expand(records(spark, sf_dir).withColumn("of", F.struct("doc_id", "document_type")), "of")
    return expanded.groupBy(F.col("of.document_type").alias("document_type")).agg(F.count("*").alias("n_required"), F.count_if("present").alias("n_present"))


@query(f"SELECT k doc_id, CAST({OPEN_LEAVES} AS BIGINT) n_leaves, CAST({OPEN_VALID} AS BIGINT) n_valid FROM {PEOPLE}")
def leaf_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = open_records(spark, sf_dir).select("doc_id", C.leaf_counts(F.col("record")).alias("c"))
    return counts.select("doc_id", F.col("c.n_leaves").cast("long").alias("n_leaves"), F.col("c.n_valid").cast("long").alias("n_valid"))


@query(f"SELECT k doc_id, round(({OPEN_VALID}) / ({OPEN_LEAVES}), 4) quality FROM {PEOPLE}")
def data_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return open_records(spark, sf_dir).select("doc_id", F.round(C.data_quality(F.col("record")), 4).alias("quality"))


@query(f"SELECT k doc_id, {CONSISTENT} consistency FROM {PEOPLE}")
def consistency_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("doc_id", C.consistency(F.col("document_type"), F.col("record")).alias("consistency"))


@query("""SELECT o_custkey doc_id, round(1 - CAST(count(*) FILTER (o_orderkey % 3 = 1 AND o_orderkey % 7 <> 0) AS DOUBLE) / count(*), 4) consistency FROM orders GROUP BY 1""")
def consistency_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs from orders: every third ends before it starts, every seventh goes on."""
    start, k = F.col("o_orderdate"), F.col("o_orderkey")
    end = F.when(k % 7 == 0, "Present").otherwise(F.date_format(F.when(k % 3 == 1, F.date_sub(start, 400)).otherwise(F.date_add(start, 400)), "dd/MM/yyyy"))
    jobs = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.struct(F.date_format(start, "yyyy-MM-dd").alias("start_date"), end.alias("end_date"))).alias("experience"))
    return jobs.select(F.col("o_custkey").alias("doc_id"), F.round(C.consistency_resume(F.to_variant_object(F.struct("experience"))), 4).alias("consistency"))


@query("SELECT o_orderkey doc_id, CAST(CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 5 <> 0 THEN 0.0 ELSE 1.0 END AS DOUBLE) consistency FROM orders")
def consistency_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts from orders: every fourth takes effect after it expires, every fifth has no expiration."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    expires = F.when(k % 5 != 0, F.date_format(F.when(k % 4 == 0, F.date_sub(day, 60)).otherwise(F.date_add(day, 60)), "dd.MM.yyyy"))
    record = F.parse_json(F.to_json(F.struct(F.date_format(day, "yyyy-MM-dd").alias("effective_date"), expires.alias("expiration_date"))))
    return read(spark, sf_dir, "orders").select(k.alias("doc_id"), C.consistency_contract(record).alias("consistency"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the parts of their score; the OCR share comes from the id."""
    k, v = F.col("document_type"), F.col("record")
    return records(spark, sf_dir).select("doc_id", C.schema_completeness(k, v).alias("c"), C.data_quality(v).alias("q"), C.consistency(k, v).alias("s"), (F.col("doc_id") % 21 / 20).alias("o"))


@query(f"SELECT k doc_id, CAST(0.9 AS DOUBLE) field_confidence, round(c, 3) completeness, round(q, 3) data_quality, s consistency, round(o, 3) ocr_quality, round(w, 3) overall, CASE WHEN w >= 0.95 THEN 'A+' WHEN w >= 0.9 THEN 'A' WHEN w >= 0.85 THEN 'B+' WHEN w >= 0.8 THEN 'B' WHEN w >= 0.75 THEN 'C+' WHEN w >= 0.7 THEN 'C' ELSE 'D' END grade FROM (SELECT *, c * 0.35 + q * 0.25 + CAST(0.9 AS DOUBLE) * 0.20 + s * 0.15 + o * 0.05 w FROM {OPEN_PARTS})")
def comprehensive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts, the overall score and its grade."""
    out = C.comprehensive_score(open_records(spark, sf_dir).withColumn("ocr", F.col("doc_id") % 21 / 20), ocr="ocr")
    return out.drop("document_type", "record", "ocr")


@query(f"SELECT k doc_id, CAST(0.9 AS DOUBLE) field_confidence FROM {PEOPLE}")
def field_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A constant, so no overall score is above 0.98."""
    return records(spark, sf_dir).select("doc_id", F.lit(C.FIELD_CONFIDENCE).alias("field_confidence"))


@query(f"""SELECT k doc_id, concat_ws(' | ', CASE WHEN c < 1 THEN '⚠️ ' || CAST(round_even((1 - c) * 100, 0) AS INT) || '% of required fields are missing' ELSE '✅ All required fields are present' END, CASE WHEN q < 0.8 THEN '⚠️ Some fields have missing or invalid data' ELSE '✅ Data quality is good' END,
 CASE WHEN s < 1 THEN '⚠️ Some inconsistencies detected in data' END, CASE WHEN o < 0.9 THEN '⚠️ OCR confidence is below optimal (scanned document)' END) explanations FROM {PARTS}""")
def explain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.array_join(C.explain_score(F.col("c"), F.col("q"), F.col("s"), F.col("o")), " | ").alias("explanations"))


@query(f"""SELECT k doc_id, CASE WHEN c >= 0.9 AND q >= 0.8 AND s >= 0.9 AND o >= 0.8 THEN '✅ Extraction quality is excellent!' ELSE concat_ws(' | ', CASE WHEN c < 0.9 THEN 'Review document to fill in missing required fields' END, CASE WHEN q < 0.8 THEN 'Manually verify and correct invalid or missing field values' END,
 CASE WHEN s < 0.9 THEN 'Check for logical errors (e.g., totals, dates)' END, CASE WHEN o < 0.8 THEN 'Consider rescanning document at higher DPI (300+ recommended)' END) END recommendations FROM {PARTS}""")
def recommend_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("doc_id", F.array_join(C.recommend_score(F.col("c"), F.col("q"), F.col("s"), F.col("o")), " | ").alias("recommendations"))


@query("SELECT k doc_id, f.field, f.present FROM (SELECT k, unnest(" + case(lambda t: "[" + ", ".join(f"{{'field': '{p}', 'present': {filled(t, p)}}}" for p in REQUIRED[t]) + "]") + f") f FROM {PEOPLE})")
def required_field_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.required_field_expand(records(spark, sf_dir))


def shown(t: str, path: str) -> str:
    """SQL text of a scalar leaf."""
    j, spec = spec_of(t, path)
    name = path.split(".")[-1]
    if spec == S:
        return f"CASE WHEN {state(j)} = 1 THEN '  ' WHEN {state(j)} > 1 THEN '{name} ' || k END"
    if spec == N:
        return f"CASE WHEN {state(j)} > 1 THEN CAST((k * 13 + {j * 17}) % 1000 / 4.0 AS VARCHAR) END"
    return f"CASE WHEN {state(j)} > {0 if spec == M else 1} THEN " + (f"'{{\"note\":\"n ' || k || '\"}}'" if spec == M else "CAST(k % 2 = 0 AS VARCHAR)") + " END"


SCALARS = {t: [p for p in LEAVES[t] if not isinstance(spec_of(t, p)[1], list) and spec_of(t, p)[1] != N] for t in TYPES}


EXTRAS = """[{'path': 'extra.note', 'value': 'x ' || k}, {'path': 'extra.blank', 'value': ' '}, {'path': 'extra.deep.none', 'value': NULL}, {'path': 'extra.deep.list', 'value': '[{"a":' || k || '}]'}, {'path': 'extra.deep.bare', 'value': '[]'}, {'path': 'extra.deep.low.flag', 'value': CAST(k % 2 = 0 AS VARCHAR)}]"""
MEMOS = """[{'path': 'memo', 'value': 'm ' || k}, {'path': 'empty', 'value': ''}, {'path': 'of.x', 'value': CAST(k AS VARCHAR)}]"""
MAPS = {t: [p for p in SCALARS[t] if spec_of(t, p)[1] == M] for t in TYPES}


def path_and_value(t: str, p: str) -> str:
    """SQL of a scalar leaf; an open map is walked into where it isn't null."""
    if p in MAPS[t]:
        there = f"{state(spec_of(t, p)[0])} > 0"
        return f"{{'path': CASE WHEN {there} THEN '{p}.note' WHEN NOT {missing(t, p)} THEN '{p}' END, 'value': CASE WHEN {there} THEN 'n ' || k END}}"
    return f"{{'path': CASE WHEN NOT {missing(t, p)} THEN '{p}' END, 'value': {shown(t, p)}}}"


@query("SELECT k doc_id, f.path, f.value FROM (SELECT k, unnest(CASE WHEN " + MEMO + f" THEN {MEMOS} ELSE list_concat(CASE WHEN k % 6 = 0 THEN {EXTRAS} END, " + case(lambda t: "list_filter([" + ", ".join(path_and_value(t, p) for p in SCALARS[t]) + "], lambda x: x.path IS NOT NULL)") + f") END) f FROM {PEOPLE})")
def walk_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves and their paths, keys outside the schemas included; numbers and lists of the schemas are left to leaf_ratio and to the exports, whose texts SQL can write."""
    found = open_records(spark, sf_dir).select("doc_id", "document_type", F.inline(C.walk_leaves(F.col("record"))))
    unwritten = F.array(*[F.lit(f"{t}:{p}") for t in TYPES for p in LEAVES[t] if p not in SCALARS[t]])
    return found.filter(~F.array_contains(unwritten, F.concat_ws(":", "document_type", "path"))).select("doc_id", "path", "value")


@query("SELECT k doc_id, " + case(lambda t: f"coalesce({shown(t, next(p for p in REQUIRED[t] if p in SCALARS[t]))}, CASE WHEN {missing(t, next(p for p in REQUIRED[t] if p in SCALARS[t]))} THEN 'missing' ELSE 'null' END)") + f" found FROM {PEOPLE}")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first required text of every record by its path; a missing key and a null are told apart."""
    v = F.col("record")

    def of(t: str) -> Column:
        p = next(p for p in REQUIRED[t] if p in SCALARS[t])
        return F.coalesce(C.text_at(v, p), F.when(C.has_key(v, p), "null").otherwise("missing"))

    return records(spark, sf_dir).select("doc_id", C.by_type(F.col("document_type"), of, F.lit(None).cast("string")).alias("found"))


def registry_export(t: str) -> None:
    """Register export_<t>, with SQL that lists its rows leaf by leaf."""
    parts = []
    for k, spec in SCHEMAS[t].items():
        if isinstance(spec, list):
            j, section = number(t)[(k,)], X.label(k)
            items = f"FROM (SELECT c_custkey k, unnest(range(0, (c_custkey + {j}) % 4)) i FROM customer)"
            fields = list(spec[0].items()) if isinstance(spec[0], dict) else [(k, spec[0])]
            for m, (f, kind) in enumerate(fields):
                text = f"CAST((k * 13 + i * 7 + {m}) % 1000 / 4.0 AS VARCHAR)" if kind == N else "'true'" if kind == B else f"'{f} ' || k || ' ' || i"
                parts.append(f"SELECT k doc_id, '{section}' section, CAST(i + 1 AS BIGINT) row_no, '{X.label(f)}' AS key, {text} AS value {items}")
        else:
            inner = leaves(spec, (k,)) if isinstance(spec, dict) else [((k,), spec)]
            for path, kind in inner:
                key = " > ".join(map(X.label, path[1:] if isinstance(spec, dict) else path))
                text = f"list_aggregate(list_transform(range(0, (k + {number(t)[path]}) % 4), lambda i: '{path[-1]} ' || k || ' ' || i), 'string_agg', '; ')" if isinstance(kind, list) else shown(t, ".".join(path))
                parts.append(f"SELECT k doc_id, '{X.label(k if isinstance(spec, dict) else t)}' section, CAST(0 AS BIGINT) row_no, '{key}' AS key, coalesce({text}, '') AS value FROM (SELECT c_custkey k FROM customer)")
    QUERIES[f"export_{t}"] = lambda spark, sf_dir: X.export_records(typed(spark, sf_dir, t), t)
    ORACLE_SQL[f"export_{t}"] = " UNION ALL ".join(parts)


for _t in TYPES:
    registry_export(_t)
