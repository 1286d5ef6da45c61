"""Streams that stop and are taken up again: late rows, repeats, malformed lines, a step cut off."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from folioq.streaming import runs

AS_OF = "2024-06-15"


def at(day, hour=0):
    return dt.datetime(2024, 5, day, hour)


def test_dedup_over_a_stop(spark, tmp_path):
    schema = "id long, k string, ts timestamp"

    def come(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        runs.work_off(runs.dedup(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", "ts", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert come([(1, "a", at(1)), (2, "b", at(1)), (3, None, at(1)), (4, "z", None)]) == [1, 2, 3]
    assert come([(5, "a", at(1, 9)), (6, None, at(1)), (7, "c", at(10))]) == [1, 2, 3, 7]  # repeats within the delay
    assert come([(8, "d", at(2)), (9, "a", at(10))]) == [1, 2, 3, 7, 9]  # 8 is later than the watermark, a was forgotten
    assert come([(10, "c", at(10, 5))]) == [1, 2, 3, 7, 9]


def test_lines_over_a_stop(spark, tmp_path):
    good = json.dumps({"document_type": "Invoice", "subtotal": 100, "tax": 10, "total": 200})
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.jsonl").write_text(good + "\n{broken\n\n" + '{"x": 1} junk\n[1]\nnull\n')

    def work():
        stream = runs.audit_lines(runs.arrivals(spark, str(tmp_path / "in")), F.to_date(F.lit(AS_OF)))
        runs.work_off(stream, str(tmp_path / "out"), str(tmp_path / "state"), by="outcome")
        return spark.read.parquet(str(tmp_path / "out")).collect()

    first = work()
    assert sorted(r.outcome for r in first) == ["audited"] + ["malformed"] * 5
    assert sorted(r.value for r in first if r.outcome == "malformed") == sorted(["{broken", "", '{"x": 1} junk', "[1]", "null"])
    assert all(not r.is_valid and r.score == 0 and r.record is None and r.grade is None for r in first if r.outcome == "malformed")
    bad = next(r for r in first if r.outcome == "audited")
    assert not bad.is_valid and bad.n_errors == 1 and bad.document_type == "Invoice" and bad.value is None
    assert len(work()) == 6  # nothing new, nothing twice
    (tmp_path / "in/deep/b.jsonl").write_text('{"document_type": "memo"}\n' + "x" * 300_000 + "\n")
    again = work()
    assert len(again) == 8 and sum(r.outcome == "audited" for r in again) == 2


def test_a_step_cut_off_is_done_again_once(spark, tmp_path):
    """A sink that fails on its first call: the second run takes the same step, with the same rows."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text('{"n": 1}\n{"n": 2}\n')
    seen = []

    def sink(df, step):
        seen.append((step, df.count()))
        if len(seen) == 1:
            raise ValueError("lost")

    def run():
        stream = runs.records_of(runs.arrivals(spark, str(tmp_path / "in"))).select("value", "outcome")
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    run()
    assert seen == [(0, 2), (0, 2)]
