"""Queries opN_<name> over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioq.llm.common import split_bucket, store, table
from folioq.llm.licences import oracle_sql as licence_sql
from folioq.llm.oracles import NEAR_COPIES, SPELLING, TRIE


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    from folioq.llm.bpe import digest_texts

    return digest_texts(table(spark, sf_dir, "documents"), vocabulary())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length histogram of all documents with suffix sums for every context limit."""
    from folioq.llm.lengths import context_report, length_histogram

    return context_report(store(length_histogram(table(spark, sf_dir, "documents"), vocabulary())))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from folioq.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    from folioq.llm.decontaminate import hit_report

    return hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from the labels outside the held-out fold."""
    from folioq.llm.toxicity import THRESHOLD, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (split_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, perplexity and verdict of every document."""
    from folioq.llm.kneser_ney import quality

    return quality(table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under the mixing model, and the unigram base."""
    from folioq.llm.mixing import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digests of the spans."""
    from folioq.llm.secrets import find_secrets

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "format")
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


#: Key of the surrogates in the registered queries; a real run passes its own.
PII_KEY = "folioq"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and how many entities of the corpus share one by mistake."""
    from folioq.llm.pii import entity_map, with_surrogates

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = entity_map(docs, PII_KEY).filter("shared").count()
    return with_surrogates(docs, PII_KEY, count_col="n_entities").withColumn("n_shared", F.lit(shared).cast("long"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that every document or a passage of it states."""
    from folioq.llm.licences import licences

    return licences(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with the more frequent word that each is a variant of."""
    from folioq.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    from folioq.llm.trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near copies of every document, by two-word shingles."""
    from folioq.llm.forest import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_roundtrip": op1_bpe_roundtrip,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_rules": op3_quality_rules,
    "op4_simhash": op4_simhash,
    "op5_secret_scans": op5_secret_scans,
    "op6_decontamination": op6_decontamination,
    "op7_pii_surrogates": op7_pii_surrogates,
    "op8_license_scans": op8_license_scans,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_minhash_forest": op13_minhash_forest,
}

ORACLE_SQL: dict[str, str] = {"op8_license_scans": licence_sql(), "op11_spelling_variants": SPELLING, "op12_conversation_trie": TRIE, "op13_minhash_forest": NEAR_COPIES}
