"""Saved reports as files: lookup, pages, the latest extraction and sizes, with unreadable files among them."""

import os

from folioq.sources import reports


def save(root, files):
    """Files with the second of their last change."""
    for name, (content, second) in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(content)
        os.utime(root / name, (1_700_000_000 + second, 1_700_000_000 + second))


def test_pages_count_unreadable_files(spark, tmp_path):
    save(tmp_path, {f"r/{i:02}.json": (b'{"n": %d}' % i, i) for i in range(25)} | {"r/bad.json": (b"{", 30), "deep/er/bytes.json": (b"\xff\xfe{}", 29), "r/note.txt": (b"x", 99)})
    first = reports.report_page(spark, str(tmp_path), 1, 20).collect()
    assert len(first) == 20 and {r.total for r in first} == {27}
    assert [r.name for r in sorted(first, key=lambda r: r.modified, reverse=True)][:3] == ["bad.json", "bytes.json", "24.json"]
    assert {r.name: r.status for r in first if r.status == "error"} == {"bad.json": "error", "bytes.json": "error"}
    second = reports.report_page(spark, str(tmp_path), 2, 20).collect()
    assert sorted(r.name for r in second) == [f"{i:02}.json" for i in range(7)]
    assert reports.report_page(spark, str(tmp_path), 9).collect() == []


def test_lookup_opens_one_name(spark, tmp_path):
    save(tmp_path, {"a/r1.json": (b'{"n": 1}', 1), "b/r1.json": (b"{} junk", 1), "a/r[1].json": (b'{"n": 2}', 1), "a/r*.json": (b"7", 1)})
    got = lambda name: sorted((r.status, r.record and r.record.toPython()) for r in reports.report_lookup(spark, str(tmp_path), name).collect())
    assert got("r1.json") == [("error", None), ("success", {"n": 1})]
    assert got("r[1].json") == [("success", {"n": 2})] and got("r*.json") == [("success", 7)]
    assert got("r2.json") == [("not_found", None)]


def test_latest_extraction_and_sizes(spark, tmp_path):
    save(tmp_path, {"run1/extraction.json": (b"{}", 5), "run2/extraction.json": (b"{", 9), "run3/other.json": (b"{}", 50), "run0/extraction.json": (b"{}", 9), "run4/extraction.json": (b"", 80)})
    latest = reports.latest_extraction(spark, str(tmp_path)).collect()
    assert [r.folder.rsplit("/", 1)[1] for r in latest] == ["run2"]
    assert reports.latest_extraction(spark, str(tmp_path), "none.json").collect() == []
    asked = spark.createDataFrame([(1, "run1/extraction.json", "x"), (2, "gone.json", "y"), (3, None, "z"), (1, "run1/extraction.json", "x")], "_size long, storage_uri string, path string")
    got = sorted((r["_size"], r.path, r.size_bytes) for r in reports.output_sizes(spark, asked, str(tmp_path)).collect())
    assert got == [(1, "x", 2), (1, "x", 2), (2, "y", None), (3, "z", None)]


def test_listing_reads_no_content(spark, tmp_path):
    save(tmp_path, {"a.json": (b"{}", 1)})
    plan = reports.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1].split("\n")[0]
