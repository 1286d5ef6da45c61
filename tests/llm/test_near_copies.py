"""The pipeline's near-duplicates against brute force over edited copies."""

import itertools
import random

import corpus_pipeline
from folioq.llm import bpe, forest, simhash
from folioq.llm.near_copies import WIDTH, keep_representatives, near_copies
from folioq.llm.queries import vocabulary
from pyspark.sql import functions as F


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_stage_matches_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(30))
    texts = [None, "", "one two", "One two", "one three"]
    for _ in range(12):
        seed = [word() for _ in range(rng.choice((6, 40, 150, 400)))] + (line.split() if rng.random() < 0.5 else [])
        for edits in (0, 0, 1, 2, 3, 4, 6, 8, 12):
            copy = list(seed)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = word()
            texts.append(" ".join(copy))
    # copies of one original that are closer to it than to each other
    seed = [word() for _ in range(200)]
    for _ in range(40):
        copy = list(seed)
        for at in rng.sample(range(40), 3):
            copy[5 * at] = word()
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    of = [sets(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        x = len(of[i] & of[j])
        if of[i] == of[j] or 5 * x >= 4 * len(of[i] | of[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    want = {i: top(i) for i in range(len(texts))}
    assert len(set(want.values())) < len({frozenset(s) for s in of})
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(df).collect()} == want
    kept = corpus_pipeline.near_duplicates(spark, df, "")
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(want.values())


def test_rows_without_id_or_words(spark):
    df = spark.createDataFrame([(None, "a b c"), (2, "a b c"), (3, None), (4, ""), (4, ""), (None, "x")], "doc_id long, text string")
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == [(0, "x"), (2, "a b c"), (3, "")]
    assert corpus_pipeline.near_duplicates(spark, df.limit(0), "").count() == 0


def test_rows_are_judged_apart(spark):
    """Two rows share an id: one copies document 1, the other is unrelated and stays."""
    text = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"u{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (2, text, "b"), (2, other, "c"), (None, other, "d"), (2, other, "e")], "doc_id long, text string, source string")
    kept = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == [(1, text), (2, other)]


def test_stage_meets_by_fingerprints(spark, monkeypatch):
    """Sets whose SimHash fingerprints differ in two bits or fewer are linked by these alone, without any region of the forest."""
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        seed = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts += [" ".join(seed), " ".join(seed[:-1]), " ".join(seed[2:])]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    h = [forest.shingles(t, WIDTH) for t in texts]
    fp = [simhash.majority(x) for x in h]
    naive = [sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in s) > len(s)) for s in h[:6]]
    assert fp[:6] == naive
    rows = forest.described(df, WIDTH, True)
    met = {frozenset((bytes(r.a), bytes(r.b))) for r in forest.fingerprint_pairs(rows).collect()}
    near = {frozenset((forest.digest(h[i]), forest.digest(h[j]))) for i, j in itertools.combinations(range(len(texts)), 2) if (fp[i] ^ fp[j]).bit_count() <= 2}
    assert met and met <= near | {frozenset((forest.digest(h[3 * k + i]), forest.digest(h[3 * k + j]))) for k in range(30) for i, j in ((0, 1), (0, 2), (1, 2))}
    assert {max(pair) for pair in near} <= {x for pair in met for x in pair}
    # no regions at all: what is linked comes from the fingerprints
    monkeypatch.setattr(forest, "meetings", lambda found, neighbours=True: found.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0))
    monkeypatch.setattr(forest, "open_tiles", lambda found, classes, roots, plain=forest.open_tiles: plain(found.limit(0), classes, roots))
    component = {r.doc_id: r.component_id for r in near_copies(df.withColumnRenamed("id", "doc_id")).collect()}
    assert any(fp[i] ^ fp[j] and component[i] == component[j] for i in range(90) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2)


def test_encoder_leaves_no_cache(spark):
    """A worker that encoded texts keeps none of their pre-tokens."""
    df = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")

    def left(batches):
        import pandas as pd

        for frame in batches:
            yield pd.DataFrame({"n": [sum(len(b.cache) for b in bpe._LOADED.values())] * len(frame)})

    for _ in range(3):
        assert bpe.encode_texts(df, vocabulary()).count() == 1
    assert spark.range(8).repartition(8).mapInPandas(left, "n long").agg(F.max("n")).first()[0] == 0


def test_texts_are_shuffled_once(spark):
    docs = spark.createDataFrame([(i, f"alpha beta gamma delta epsilon {i % 3} zeta eta theta") for i in range(12)], "doc_id long, text string")
    kept = keep_representatives(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("LeftSemi")
    assert below and "Exchange" not in above, plan
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2]


def test_known_components_go_on_as_one_link_a_set(spark, monkeypatch):
    counts = []
    plain = forest.connected_components

    def counting(links):
        counts.append(links.count())
        return plain(links)

    monkeypatch.setattr(forest, "connected_components", counting)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join([*words[:k], f"other{k}", *words[k + 1 :]]) for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert keep_representatives(docs).count() == 1
    assert len(counts) >= 2 and counts[1] < counts[0], counts
