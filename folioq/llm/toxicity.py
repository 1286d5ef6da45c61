"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import split_bucket, store

#: At most about this many labelled rows are used for fitting; beyond it a hash of the id thins them evenly.
FIT_ROWS = 40_000
#: Standard deviations by which a word's marked texts must exceed what the label's rate explains; no number of words is set,
#: since the rows used for fitting bound it.
MARKED = 5.0
#: Rejection threshold on the calibrated score.
THRESHOLD = 0.3
FEATURES = ["lexicon_density", "lexicon_hits", "lexicon_kinds", "near_second_person", "second_person", "capitals", "capital_words", "exclamations", "punctuation", "digits", "symbols", "obfuscated", "obfuscated_hits", "log_words"]
VECTOR = "_features"
#: Second-person words of the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tus usted ustedes vosotros".split())
#: Characters that stand for letters in disguised words.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
EDGE = ".,;:!?\"'()[]{}|*#$%&<>-_"
INNER = re.compile(r"[^\W\d_][0-9@$!*.#_-]+[^\W\d_]")


def plain(word: str) -> str:
    return word.strip(EDGE).lower()


def undisguised(word: str) -> str:
    return "".join(c for c in word.lower().translate(DISGUISE) if c.isalpha())


def features(text: str | None, lexicon: frozenset[str]) -> list[float]:
    """Dense features in the order of FEATURES; all zero for an empty text."""
    raw = (text or "").split()
    if not raw:
        return [0.0] * len(FEATURES)
    words = list(map(plain, raw))
    n, chars = len(raw), max(1, sum(map(len, raw)))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    person = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = sum(any(words[j] in SECOND_PERSON for j in range(max(0, i - 4), min(n, i + 5))) for i in hits)
    odd = [i for i, w in enumerate(raw) if not w.isalpha() and INNER.search(w.strip(".,;:!?"))]
    letters = max(1, sum(c.isalpha() for c in text))
    count = text.count
    return [
        len(hits) / n,
        math.log1p(len(hits)),
        float(len({words[i] for i in hits})),
        near / n,
        len(person) / n,
        sum(c.isupper() for c in text) / letters,
        sum(w.isupper() and len(w) > 1 for w in raw) / n,
        count("!") / chars,
        sum(map(count, ".,;:?!\"'()-")) / chars,
        sum(map(count, "0123456789")) / chars,
        sum(map(count, "#*$%&|<>@_")) / chars,
        len(odd) / n,
        float(sum(undisguised(raw[i]) in lexicon for i in odd)),
        math.log1p(n),
    ]


def learn_lexicon(rows: DataFrame, text_col: str, label_col: str, least: float = MARKED) -> frozenset[str]:
    """Words in more marked texts than the label's rate explains: least standard deviations of the binomial, one text as prior.

    The test needs no fixed number of texts, so few labels still give a lexicon: at a rate of 0.12 four marked texts and no
    other are enough.
    """
    words = F.array_distinct(F.transform(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[\x09-\x0D\x20]+"), lambda w: F.btrim(w, F.lit(EDGE))))
    counts = rows.select(F.col(label_col).alias("y"), F.explode(words).alias("word")).filter("word <> ''").groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    rate = float(rows.agg(F.avg(label_col)).first()[0] or 0.0)
    excess = (F.col("t") - rate * F.col("n")) / F.sqrt(F.lit(max(rate * (1 - rate), 1e-6)) * F.col("n"))
    return frozenset(r[0] for r in counts.filter((F.col("t") > 1) & (excess >= least)).select("word").collect())


def with_features(df: DataFrame, text_col: str, lexicon: frozenset[str], keep_text: bool = False) -> DataFrame:
    """The columns of df, without the text unless keep_text, and the vector of the text's features as VECTOR."""
    at = df.columns.index(text_col)
    names = [c for c in df.columns if keep_text or c != text_col]
    schema = df.select(*names, F.lit(None).cast("array<double>").alias(VECTOR)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([features(t.as_py(), lexicon) for t in batch.column(at)]).ravel()
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if keep_text or i != at), pa.ListArray.from_arrays(ends, pa.array(values, pa.float64()))], [*names, VECTOR])

    return df.mapInArrow(run, schema).withColumn(VECTOR, array_to_vector(VECTOR))


class ToxicityModel:
    """Fitted lexicon, trees and calibration; `trees` is None if there were not two classes to learn from."""

    def __init__(self, lexicon: frozenset[str], trees: GBTClassificationModel | None, prior: float) -> None:
        self.lexicon, self.trees, self.prior = lexicon, trees, prior

    def score(self, df: DataFrame, text_col: str = "text", keep_text: bool = False) -> DataFrame:
        """Columns of df, without the text unless keep_text, and `score` between 0 and 1; the prior rate if nothing could be learned."""
        keep = [c for c in df.columns if keep_text or c != text_col]
        if self.trees is None:
            return df.select(*keep, F.lit(self.prior).alias("score"))
        out = self.calibration.transform(raw_probability(self.trees, with_features(df, text_col, self.lexicon, keep_text)))
        # the tree score breaks ties inside a step of the calibration without leaving [0, 1]
        return out.select(*keep, (0.999 * F.col("_calibrated") + 0.001 * F.col("_p")).alias("score"))


def raw_probability(trees: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """The columns of df other than the features, and `_p`."""
    return trees.transform(df).select(*(c for c in df.columns if c != VECTOR), vector_to_array("_probability")[1].alias("_p"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> ToxicityModel:
    """Learn from labelled rows whose crc32(id) mod 4 is not 2; of these, remainder 1 serves the calibration.

    Null labels are left out; contradicting labels of one id each count. No labelled rows, or one class only, give
    a model that answers with the rate of the label (0 without labels). Very long texts count whole, one at a time; equal
    scores stay equal, and repeated rows score alike.
    """
    bucket = split_bucket(F.col(id_col), 4)
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (bucket != 2)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    n, positive = usable.agg(F.count("*"), F.sum("label")).first()
    if n and n > fit_rows:
        share = int(fit_rows / n * 1_000_000)
        usable = usable.filter(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < share)
    if not n or positive in (0, n):
        return ToxicityModel(frozenset(), None, float(positive or 0) / max(1, n))
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most about fit_rows pairs of id and label are left, so they go to the texts rather than the texts to them
    rows = store(picked.join(F.broadcast(usable), picked.id == usable["_id"]).select("id", "text", "label"))
    calibrating = split_bucket(F.col("id"), 4) == 1
    if rows.filter(~calibrating).select("label").distinct().count() < 2:
        return ToxicityModel(frozenset(), None, float(positive) / n)
    lexicon = learn_lexicon(rows.filter(~calibrating), "text", "label")
    table = store(with_features(rows, "text", lexicon))
    gbt = GBTClassifier(featuresCol=VECTOR, maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, seed=7, predictionCol="_predicted").setRawPredictionCol("_raw").setProbabilityCol("_probability")
    model = ToxicityModel(lexicon, gbt.fit(table.filter(~calibrating).select(F.col(VECTOR), "label")), float(positive) / n)
    held = raw_probability(model.trees, table.filter(calibrating))
    if held.isEmpty():
        held = raw_probability(model.trees, table)
    model.calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="_calibrated").fit(held)
    return model


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that score below the threshold, columns unchanged. Null texts score as empty ones."""
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))  # no name of the table can clash with a column of the model
    scored = fit(docs, labels, id_col, text_col).score(inner, f"c{names.index(text_col)}", keep_text=True)
    return scored.filter(F.col("score") < threshold).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
