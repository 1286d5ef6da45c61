"""Classification by key terms on odd rows, against a plain reading of the terms."""

import re

import pyspark.sql.functions as F

from folioq.operators.keywords import BROADCAST_TERMS, TERMS, classify_keywords, term_table


def plain(text):
    words = re.findall(r"[^\W_]+", text.lower())
    found = {}
    for i, (kind, listed) in enumerate(TERMS.items()):
        for term in {tuple(re.findall(r"[^\W_]+", t)) for t in listed.split(",")}:
            if any(tuple(words[j : j + len(term)]) == term for j in range(len(words))):
                weight, n = found.get((kind, i), (0, 0))
                found[kind, i] = (weight + len(term), n + 1)
    if not found:
        return "other", 0.0, 0
    (kind, i), (weight, n) = max(found.items(), key=lambda x: (x[1][0], -x[0][1]))
    return kind, round(weight / sum(w for w, _ in found.values()), 4), n


def test_matches_a_plain_reading(spark):
    texts = ["", "Invoice", "invoices", "birth certificate", "certificate of birth", "form 16 form 16", "pan card pan", "x " * 50_000 + "job card", "7/12 utara; payee, cheque", "TAX INVOICE\nreceipt agreement"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {r.id: (r.document_type, r.confidence, r.n_terms) for r in classify_keywords(df, "id").collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "cheque", "a"), (None, "payee", "b"), (1, None, "c"), (2, "passport", "d"), (2, "passport", "d")], "gram long, text string, kind string")
    got = {r.gram: (r.document_type, r.n_terms) for r in classify_keywords(df, "gram").collect()}
    assert got == {None: ("cheque", 2), 1: ("other", 0), 2: ("passport", 2)}
    assert classify_keywords(df.limit(0), "gram").count() == 0
    nothing = term_table(spark).limit(0)
    assert {r.document_type for r in classify_keywords(df, "gram", terms=nothing).collect()} == {"other"}


def test_many_terms_are_joined_without_a_broadcast_hint(spark):
    many = spark.range(BROADCAST_TERMS + 1).select(F.lit("t").alias("document_type"), F.lit(0).alias("place"), F.concat(F.lit("w"), "id").alias("term"))
    df = spark.createDataFrame([(1, "w7 w8 w8"), (2, "w")], "id long, text string")
    got = classify_keywords(df, "id", terms=many)
    assert "ResolvedHint" not in got._jdf.queryExecution().analyzed().toString()
    assert {r.id: (r.document_type, r.n_terms) for r in got.collect()} == {1: ("t", 2), 2: ("other", 0)}
