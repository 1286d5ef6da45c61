"""LM scoring: every text's bits under the context-mixing model of the training texts, and a unigram base beside it.

Tasks count bits by hashed context and words; both counts are added up by Spark. The tables have a proven size (four contexts
of at most 2^22 slots), the word counts grow with the corpus and are joined. Mixing weights and refinement are learned from the bits of all
training texts too, added up by gate and rounded logits (2^21 numbers at most).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioq.llm.bits import CHUNK, BitCounts, BitMixer, JointCounts, slot_bits, states, stream
from folioq.llm.common import fold, split_bucket, store

#: Words with at least 1 / FREQUENT of the training tokens, so at most as many, are priced where the texts are; all others
#: meet their counts in a join.
FREQUENT, FREQUENT_BYTES = 1 << 19, 32
#: Rows that a task gathers before it hands them on.
FLUSH = 200_000
#: Tasks that add up the chunks of the bit tables, and those of the joint counts.
ADDERS, JOINERS = 64, 16


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the training rows of (uid, id, held_out, text); every text closes with the end token, the empty word."""
    plain = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = F.array_append(F.array_remove(F.split(plain, r"[\x20\x09-\x0D]+"), ""), "")
    return texts.filter(~F.col("held_out")).select(F.explode(split).alias("word")).groupBy(F.col("word").cast("binary").alias("word")).agg(F.count("*").alias("c"))


def bit_tables(texts: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """States of every slot of every context, counted over all training rows of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BitCounts(bits)
        for batch in batches:
            for text in batch.column(0):
                counts.add(fold(text.as_py()).split())
        for k, chunk, slots, seen in counts.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int32()), pa.array([slots], pa.binary()), pa.array([seen], pa.binary())], ["k", "chunk", "slots", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, chunk, slots, seen in zip(*(batch.column(i) for i in range(4)), strict=True):
                total = sums.setdefault((k.as_py(), chunk.as_py()), np.zeros((CHUNK, 2)))
                total[np.frombuffer(slots.as_buffer(), np.uint16)] += np.frombuffer(seen.as_buffer(), np.uint32).reshape(-1, 2)
        for (k, chunk), total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([chunk], pa.int32()), pa.array([states(total).tobytes()], pa.binary())], ["k", "chunk", "states"])

    counted = texts.filter(~F.col("held_out")).select("text").mapInArrow(count, "k int, chunk int, slots binary, seen binary")
    found = store(counted.repartition(ADDERS, "k", "chunk").mapInArrow(add, "k int, chunk int, states binary"))
    out = [np.zeros(1 << b, np.uint16) for b in bits]
    for batch in found.toArrow().to_batches():
        for k, chunk, state in zip(*(batch.column(i) for i in range(3)), strict=True):
            part = np.frombuffer(state.as_buffer(), np.uint16)[: len(out[k.as_py()])]
            out[k.as_py()][chunk.as_py() * CHUNK :][: len(part)] = part
    return out


def fitted(texts: DataFrame, tables: list[np.ndarray]) -> BitMixer:
    """The mixer with weights and refinement learned from the bits of all training rows; tasks and adders sum whole numbers, so no order matters."""
    mixer = BitMixer(tables)
    shared = texts.sparkSession.sparkContext.broadcast(mixer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = JointCounts(shared.value.tables)
        for batch in batches:
            for text in batch.column(0):
                joint.add(fold(text.as_py()).split())
        total = joint.total()
        for i in range(0, len(total), CHUNK):
            part = total[i : i + CHUNK]
            met = np.flatnonzero(part)
            if len(met):
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([met.astype(np.uint16).tobytes()], pa.binary()), pa.array([part[met].tobytes()], pa.binary())], ["chunk", "places", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, places, seen in zip(*batch.columns, strict=True):
                total = sums.setdefault(chunk.as_py(), np.zeros(CHUNK, np.int64))
                total[np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(seen.as_buffer(), np.int64)
        for chunk, total in sums.items():
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([met.astype(np.uint16).tobytes()], pa.binary()), pa.array([total[met].tobytes()], pa.binary())], ["chunk", "places", "seen"])

    schema = "chunk int, places binary, seen binary"
    counted = texts.filter(~F.col("held_out")).select("text").mapInArrow(count, schema)
    seen = np.zeros(len(JointCounts(tables).total()), np.int64)
    for batch in counted.repartition(JOINERS, "chunk").mapInArrow(add, schema).toArrow().to_batches():
        for chunk, places, n in zip(*batch.columns, strict=True):
            seen[chunk.as_py() * CHUNK + np.frombuffer(places.as_buffer(), np.uint16).astype(np.int64)] = np.frombuffer(n.as_buffer(), np.int64)
    shared.destroy()
    if seen.any():
        mixer.learn(seen)
    return mixer


def priced_texts(texts: DataFrame, mixer: BitMixer, words: list[bytes], logs: np.ndarray) -> DataFrame:
    """Per text one row with its score and its sums over the given frequent words, and one row for each other word.

    The first has in `done` tokens, known tokens, base score, log2 score and bytes, and as its word a space and the uid, which
    no text has as a word and which spreads these rows; the others have their number `n` and no `done`.
    """
    shared = texts.sparkSession.sparkContext.broadcast((mixer, {w: i for i, w in enumerate(words)}, logs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, place, prices = shared.value
        for batch in batches:
            keys: list[bytes] = []
            n: list[int] = []
            rows: list[int] = []
            done: list[list[float] | None] = []
            ids = batch.column(0).to_pylist()
            for row, text in enumerate(batch.column(3)):
                own = fold(text.as_py()).split()
                counts = Counter(own)
                counts[b""] += 1
                at = np.fromiter((place.get(w, -1) for w in counts), np.int64, len(counts))
                times = np.fromiter(counts.values(), np.float64, len(counts))
                hit = at >= 0
                rare = [w for w, h in zip(counts, hit.tolist(), strict=True) if not h]
                keys += [b" %d" % ids[row], *rare]
                n += [0, *map(counts.__getitem__, rare)]
                done += [[len(own) + 1.0, float(times[hit].sum()), float(times[hit] @ prices[at[hit]]), model.log2(own), float(len(stream(own)))], *[None] * len(rare)]
                rows += [row] * (1 + len(rare))
                if len(keys) > FLUSH or row == batch.num_rows - 1:
                    take = pa.array(rows)
                    first = pa.array([row if d else None for row, d in zip(rows, done, strict=True)], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(first), batch.column(2).take(first), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(done, pa.list_(pa.float64()))], ["uid", "id", "held_out", "word", "n", "done"])
                    keys, n, rows, done = [], [], [], []

    return texts.mapInArrow(run, f"uid long, id {texts.schema['id'].dataType.simpleString()}, held_out boolean, word binary, n long, done array<double>")


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """Per row: held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Learns from the ids outside fold 0; score is the log10 of the mixer's probability of all bits of the text. Null and empty
    texts consist of the end token. Rows are scored each, with repeated and null ids too, and equal texts get equal scores:
    the result depends neither on the order nor on the partitions of the rows. Very long texts are scored whole. Without
    training rows nothing is known and the bits cost what unlearned weights give. Extra columns are not carried along.
    """
    held: Column = split_bucket(F.col(id_col), folds) == 0
    texts = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = store(word_counts(texts))
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    size = texts.filter(~F.col("held_out")).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    mixer = fitted(texts, bit_tables(texts, slot_bits(size)))
    frequent = (F.col("c") * FREQUENT >= max(1, total)) & (F.length("word") <= FREQUENT_BYTES)
    top = counts.filter(frequent).toArrow()
    scale = float(np.log10(total + 0.1 * (distinct + 1)))
    priced = priced_texts(texts, mixer, top.column("word").to_pylist(), np.log10(top.column("c").to_numpy() + 0.1) - scale)
    joined = priced.join(counts.filter(~frequent), "word", "left")
    base = F.col("n") * (F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.1) - F.lit(scale))
    sums = [F.sum(F.coalesce(F.col("done")[i], x)).alias(name) for i, (name, x) in enumerate([("tokens", F.lit(0.0)), ("known", F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)), ("base", base), ("log2", F.lit(0.0)), ("bytes", F.lit(0.0))])]
    out = joined.groupBy("uid").agg(F.first("id", ignorenulls=True).alias("id"), F.first("held_out", ignorenulls=True).alias("held_out"), *sums)
    score = F.col("log2") * F.lit(float(np.log10(2)))
    return out.select(F.col("id").alias(id_col), "held_out", F.col("tokens").cast("long").alias("n_tokens"), F.col("known").cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), (-F.col("log2") / F.col("bytes")).alias("bits_per_byte"))
