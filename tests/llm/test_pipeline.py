"""The chain of all stages over planted cases: what must go goes, what is changed is changed as meant, the rest stays as it was."""

import random

import corpus_pipeline
import pyarrow as pa
from tokenizers import Tokenizer

from folioq.llm.common import ARROW_ROWS, ARROW_SETTING, small_batches
from folioq.llm.queries import vocabulary


def test_chain_on_planted_cases(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    plain = lambda n=60: " ".join(word() for _ in range(n))
    item = " ".join(f"item{i}" for i in range(14))
    texts = {i: plain() for i in range(300)}
    toxic = {i for i in range(0, 300, 3)}
    for i in toxic:
        texts[i] += " you idiot you scum you moron"
    clean = [i for i in texts if i not in toxic]
    copies = {clean[0]: [400, 401], clean[1]: [402]}
    texts[400] = texts[401] = texts[clean[0]]
    texts[402] = " ".join(texts[clean[1]].split()[:-1])
    texts[500] = f"before the passage {plain(40)} {item} and after"
    texts[501] = f"write to jo.d@mail.example.org now {plain(40)}"
    texts[502], texts[503] = None, ""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(clean) | {500, 501, 502}
    library = Tokenizer.from_file(vocabulary())
    for i, r in got.items():
        assert r.n_chars == len(r.text) and r.ids == library.encode(r.text, add_special_tokens=False).ids
        if i < 300:
            assert r.text == texts[i]
    assert item not in got[500].text and got[500].text.startswith("before the passage") and got[500].text.endswith("and after")
    assert "jo.d@" not in got[501].text and got[501].text.split()[3:] == texts[501].split()[3:]
    assert got[502].text == "" and not set(copies[clean[0]]) & set(got)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "benchmark_decontamination", "personal_data", "bpe"]


def test_chain_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_go_to_python_in_small_batches(spark):
    """A stage's result, planned only when it is read, takes few rows at a time out of a partition of many; a smaller setting of the session stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get(ARROW_SETTING)
    try:
        spark.conf.unset(ARROW_SETTING)
        docs = spark.range(3 * ARROW_ROWS, numPartitions=1).selectExpr("id AS doc_id", "concat('text ', id) AS text")
        got = [r.n for r in corpus_pipeline.bpe(spark, docs, "").select("doc_id").mapInArrow(sizes, "n long").collect()]
        assert sum(got) == 3 * ARROW_ROWS and max(got) <= ARROW_ROWS
        spark.conf.set(ARROW_SETTING, "7")
        small_batches(spark)
        assert spark.conf.get(ARROW_SETTING) == "7"
    finally:
        spark.conf.set(ARROW_SETTING, before)
