"""Spelling variants, the conversation trie and the MinHash forest against brute force, and on odd rows."""

import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from folioq.llm import forest, spelling, trie
from folioq.llm.oracles import TRIE


def words_of(rows):
    counts = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in counts}
    form = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs and max(counts[v] for v in vs) >= 10 * counts[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, len(near[w]), form.get(w), counts[form[w]] if w in form else None, root(w)) for w, n in counts.items()}


@pytest.mark.parametrize("block", [512, 3])
def test_variants_match_all_pairs(spark, monkeypatch, block):
    """Chains of forms, ties, repeated letters, accents, long words, texts in capitals, whatever the size of a block."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(block)
    base = ["aaaaaaaa", "abababab", "wörterbuch", "straßenbahn", "consideration", "x" * 3000]
    letters = "abcéü"
    words = list(base)
    for w in base[:5] * 12:
        at = rng.randrange(len(w))
        words.append(rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]]))
    texts = [" ".join(w for w in rng.choices(words, weights=[1000 // (1 + i * i) + 1 for i in range(len(words))], k=400)) for _ in range(8)]
    rows = [(None if i == 3 else i, t.upper() if i == 5 else t) for i, t in enumerate(texts)] + [(90, None), (91, ""), (92, "1,2 short"), (1, texts[1])]
    rows += [(93, " ".join(["considerations"] * 600 + ["considerationss"] * 20 + ["considerationsss"] * 2))]
    df = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    got = {tuple(r) for r in spelling.spelling_variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == variants(words_of(rows))
    if block == 512:
        assert any(form and root != form for *_, form, _, root in got)
        assert spelling.spelling_variants(df.limit(0)).count() == 0


def trie_rows():
    rng = random.Random(1)
    said = ["a", "b", "a b", None, "", " x  y\n"]
    rows = [(c, rng.choice([t, t, t, None]), rng.choice(["user", None, ""]), rng.choice(said)) for c in [*range(60), 100, 101, 119, 2000] if c != 20 for t in range(rng.randrange(9))]
    rows += [(7, 3, "u", "dup")] * 3 + [(None, 1, "u", "z"), (500, None, None, "long " * 30_000)]
    return rows + [(c, t, "u", f"w{t} y") for c in (300, 301, 321, 322, 340) for t in range(40)]


@pytest.mark.parametrize(("shard", "span", "band"), [(None, 4096, 100_000), (5, 3, 7), (1, 2, 1)])
def test_trie_matches_sql(spark, monkeypatch, shard, span, band):
    """Shards, windows and bands of any size give the nodes of the SQL: missing leaders, turnless and copied conversations, ties, nulls."""
    monkeypatch.setattr(trie, "SPAN", span)
    monkeypatch.setattr(trie, "BAND", band)
    df = spark.createDataFrame([(*r, 1, "n") for r in trie_rows()], "conv_id long, turn long, role string, text string, depth int, c string")
    con = duckdb.connect()
    given = df.select("conv_id", "turn", "role", "text").toArrow()
    con.register("given", given)
    con.sql("CREATE VIEW conversations AS SELECT * FROM given")
    want = con.sql(TRIE)
    columns = sorted(want.columns)
    got = trie.conversation_trie(df, shard=shard)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(map(str, want.project(", ".join(columns)).fetchall()))


def test_empty_trie(spark):
    assert trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_queue_spills_in_order():
    rng = random.Random(3)
    queue = trie.SpillingQueue(2, 5)
    entries = [(rng.randrange(40), i) for i in range(200)]
    out = []
    for i, x in enumerate(entries):
        queue.push(x)
        if i % 7 == 6:
            out.append(queue.pop())
    while queue.least() is not None:
        out.append(queue.pop())
    assert len(queue.runs) > 3 and sorted(out) == sorted(entries) and out[-100:] == sorted(out[-100:])


def sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


@pytest.mark.parametrize(("region", "asking", "asked"), [(128, 256, 2048), (2, 2, 3)])
def test_forest_matches_all_pairs(spark, monkeypatch, region, asking, asked):
    """Edited copies, chains of them, a dense group near the limit, small sets; any size of regions and tiles gives the same components."""
    for name, value in (("REGION", region), ("ASKING", asking), ("ASKED", asked)):
        monkeypatch.setattr(forest, name, value)
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(2000)}"
    texts = [None, "", " \n", "one", "ONE", "one two", "One Two", "two one", "a b a b a", "a b"]
    for _ in range(8):
        seed = [word() for _ in range(rng.choice((5, 30, 120, 300)))]
        for edits in (0, 0, 1, 2, 3, 5, 8):
            copy = list(seed)
            for at in rng.sample(range(len(copy)), min(edits, len(copy))):
                copy[at] = word()
            texts.append(" ".join(copy))
    seed = [word() for _ in range(150)]
    for _ in range(60):
        copy = list(seed)
        for at in rng.sample(range(150), 8):
            copy[at] = word()
        texts.append(" ".join(copy))
    of = [sets(t, 2) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if of[i] and of[j] and 100 * len(of[i] & of[j]) >= 80 * len(of[i] | of[j]):
            a, b = sorted((top(i), top(j)))
            root[b] = a
    want = {(i, len(s), top(i), i == top(i)) for i, s in enumerate(of)}
    df = spark.createDataFrame([(i, t, 1, b"x", "root") for i, t in enumerate(texts)], "doc_id long, text string, n int, v binary, root string").repartition(5)
    assert {tuple(r) for r in forest.near_copies(df).collect()} == want


def test_forest_on_odd_rows(spark):
    rows = [(None, "a b c"), (2, "a b c"), (2, "x y z"), (3, "x y z"), (None, None), (4, None), (None, "only one"), (5, "s " * 60_000), (6, "S " * 50_000)]
    got = sorted(map(str, (tuple(r) for r in forest.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = [(None, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (3, 2, 2, False), (None, 0, None, True), (4, 0, 4, True), (None, 1, None, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert got == sorted(map(str, want))
    assert forest.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
