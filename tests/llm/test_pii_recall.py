"""Recall and precision of surrogates on planted rows."""

import ipaddress

from folioq.llm import pii

#: A text, what must be gone from it, what must stay.
PLANTED = (
    ("Patient: Maria Garcia came", ["Maria", "Garcia"], ["Patient: ", " came"]),
    ("María García und Jose Martinez", ["María", "García", "Jose", "Martinez"], [" und "]),
    ("Frau 王小明, Herr Müller", ["王小明", "Müller"], ["Frau ", ", Herr "]),
    ("host 2001:db8::1 up", ["2001:db8::1"], ["host ", " up", "::"]),
    ("host fe80::a1 up", ["fe80::a1"], ["host "]),
    ("at 2001:0DB8:85A3:0:0:8A2E:370:7334.", ["85A3", "8A2E"], ["at ", ":0:0:"]),
    ("jörg@bücher.de schreibt", ["jörg", "bücher"], ["@", ".de schreibt"]),
    ("иван@почта.рф пишет", ["иван", "почта"], [".рф пишет"]),
    ("call 5095556973 now", ["5095556973"], ["call ", " now"]),
)
CLEAN = ("20240102123456 done", "std::map<int> abc::def add::bad", "12:30:45 and 1:2:3", "id=5095556973 /5095556973 x5095556973", "1700000000", "from 2024-01-02 to 2024-03-04", "Frau und Herr", "00:1a:2b:3c:4d:5e")


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.with_surrogates(df, "k").orderBy("doc_id").collect()]


def test_planted_rows_are_found(spark):
    for (old, gone, stay), new in zip(PLANTED, run(spark, [t for t, *_ in PLANTED]), strict=True):
        assert not any(x in new for x in gone), (old, new)
        assert all(x in new for x in stay), (old, new)


def test_clean_rows_are_left_alone(spark):
    assert run(spark, CLEAN) == list(CLEAN)


def test_addresses_of_version_6_keep_who_they_are(spark):
    spelled = ["2001:db8::8a2e:1", "2001:DB8:0:0:0:0:8A2E:1", "2001:0db8:0000:0000:0000:0000:8a2e:0001", "2001:db8::8a2e:2", "1::", "1:2:3:4:5:6:7:8"]
    new = [ipaddress.ip_address(x) for x in run(spark, spelled)]
    assert new[0] == new[1] == new[2] != new[3] and len(set(new)) == 4
    assert not {str(ipaddress.ip_address(x)) for x in spelled} & {str(x) for x in new}
    rows = [(f"2001:db8:{i % 50:x}::{i:x} x",) for i in range(1, 2000)]
    found = pii.entity_map(spark.createDataFrame(rows, "text string"), "k")
    assert found.filter("kind = 'ipv6'").count() == 1999 and found.filter("shared").count() == 0


def test_entities_are_found_once(spark):
    """The checks over the corpus read what was stored: neither patterns nor surrogates are in their plan again."""
    df = spark.createDataFrame([(1, "write to jo.d@mail.example.org or ann@mail.example.org"), (2, "jo.d@mail.example.org"), (3, None)], "doc_id long, text string")
    found = pii.entity_map(df, "k")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "sha2" not in plan
    assert sorted((r.kind, r.entity, r.n, r.shared) for r in found.collect()) == [("email", "ann@mail.example.org", 1, False), ("email", "jo.d@mail.example.org", 2, False)]
