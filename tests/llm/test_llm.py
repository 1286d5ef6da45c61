"""Brute-force versions, round trips and edge cases of the training-data operators."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioq.llm import bits, bpe, decontaminate, lengths, licences, mixing, pii, secrets, simhash, toxicity
from folioq.llm.kneser_ney import base_counts, quality
from folioq.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, id string, fp string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, clashing names."""
    rows = [(1, None, None, None, None, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (2, "", "en", "s", 0, "x", "y"), (3, "a " * 50_000, "en", None, 1, None, None), (4, "x" * 50_000, None, None, 1, None, None), (5, "one two three four", "en", "s", 1, "", "")]
    return spark.createDataFrame(rows, ODD)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)


@pytest.fixture(scope="session")
def texts(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_masks_cover_every_pair_of_bits():
    for i, j in itertools.combinations(range(64), 2):
        assert any(not m & (1 << i | 1 << j) for m in simhash.covering_masks())


def test_links_match_all_pairs(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({s ^ (1 << rng.randrange(64)) * rng.randrange(2) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(12)})
    rows = [(simhash.signed(v), i) for i, v in enumerate(values)]
    links = {(r.a, r.b) for r in simhash.links(spark.createDataFrame(rows, "fp long, rep long")).collect()}
    near = {(j, i) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= 2}
    assert links <= near
    group = lambda pairs: components(len(values), pairs)
    assert group(links) == group(near)


def components(n, pairs):
    root = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_bpe_matches_library(spark, texts):
    t = Tokenizer.from_file(vocabulary())
    own = bpe.load(vocabulary())
    for text in [x for _, x in texts[:60]] + ["", "<|endoftext|> a", "  x y  z", "🙂é\x00"]:
        ids = t.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids
        assert own.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_hits_match_brute_force(spark, texts):
    items = [(r.item_id, decontaminate.words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r for r in decontaminate.hit_report(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    windows = {}
    for name, words in items:
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(str(name))
    lengths = {len(w) for w in windows}
    for doc_id, text in texts:
        words, hit, found = decontaminate.words_of(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(words[i : i + n])]
        r = got[doc_id]
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), len(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def surrogates(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.with_surrogates(df, "k").orderBy("doc_id").collect()]


def test_surrogates(spark):
    text = "mail jo.d@mail1.example.com and 10.2.3.4, +1 (377) 555-0271, Frau Müller; jo.d@mail1.example.com"
    rows = [(1, text), (2, None), (3, ""), (4, "nothing here 12 on 2024-01-02"), (5, "x jo.e@mail1.example.com")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.with_surrogates(df, "k", count_col="n").collect()}
    assert [got[i].n for i in range(1, 6)] == [5, 0, 0, 0, 1]
    assert got[2].text is None and got[3].text == "" and got[4].text == rows[3][1]
    assert not any(x in got[1].text for x in ("jo.d@", "10.2.3.4", "0271", "Müller")) and "Frau " in got[1].text
    mails = re.findall(r"\S+@\S+", got[1].text)
    assert len(mails) == 2 and mails[0] == mails[1] and mails[0] not in got[5].text and mails[0].endswith(".com")
    assert pii.entity_map(df, "k").filter("shared").count() == 0


def test_surrogates_keep_who_it_is(spark):
    names, cards, phones, mails = surrogates(
        spark,
        "Mr Smith, Mr John Smith, MR SMITH, Mrs SMITH, Mr J. Smith",
        "4539 1488 0343 6467, 4539-1488-0343-6467, 4539148803436467",
        "+33 6 12 34 56 78, 06 12 34 56 78",
        "a.b+c@d.example.org A.B+C@D.example.org",
    )
    new = set(re.findall(r"(?i)(?:mrs?) (?:\w+\.? )?(\w+)", names))
    assert len({x.lower() for x in new}) == 1 and "smith" not in names.lower()
    assert re.search(r"Mr (\w+) \w+, MR", names)[1] in pii.MALE
    assert len({re.sub(r"\D", "", c) for c in cards.split(", ")}) == 1 and [re.sub(r"\d", "0", c) for c in cards.split(", ")][1] == "0000-0000-0000-0000"
    assert luhn(re.sub(r"\D", "", cards.split(", ")[0]))
    a, b = (re.sub(r"\D", "", p) for p in phones.split(", "))
    assert a == "33" + b[1:] and b[0] == "0" and "612345678" not in a
    assert len(set(mails.lower().split())) == 1


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in values) % 10 == 0


def test_surrogates_by_format(spark):
    ibans = "DE89 3704 0044 0532 0130 00, GB29NWBK60161331926819"
    texts = [ibans, "078-05-1120", "Frau Łukaszewicz", "Mr O'Neil", "Mrs Smith-Jones", "Monsieur Straße", "Señor Հայկ", "(212) 555-0100", "+49 30 123456", "+34 612 345 678", "Anna Weber"]
    got = surrogates(spark, *texts)
    for old, new in zip(texts, got, strict=True):
        words = set(re.findall(r"\w{3,}", old)) - {"Frau", "Mrs", "Monsieur", "Señor"}
        assert old != new and not words & set(re.findall(r"\w{3,}", new)), (old, new)
    for x in got[0].split(", "):
        x = x.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1
    assert got[0][:2] == "DE" and got[10].split()[0] in pii.FEMALE


def test_surrogates_are_one_to_one(spark):
    rows = [(f"4{i:015d} and 0{i + 100000000} x, u{i}@a.org, {i % 200 + 1}.{i // 200}.0.1",) for i in range(3000)]
    found = pii.entity_map(spark.createDataFrame(rows, "text string"), "k").groupBy("kind").agg({"*": "count", "shared": "max"}).collect()
    assert {r.kind for r in found} >= {"card", "email", "ip"} and not any(r["max(shared)"] for r in found)


def test_licences(spark):
    mit = licences.TEMPLATES["MIT-text"]
    texts = ["prose here\n" + " " * 40 + "Released under the MIT\n  license and four more words", None, "", "!!", mit.replace(" ", "\n "), " ".join(f"w{i}" for i in range(20_000)) + " " + mit]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.licence, r.scope) for r in licences.licences(df).collect()}
    assert got == {(0, "MIT", "passage"), (4, "MIT-text", "document"), (4, "MIT-text", "passage"), (5, "MIT-text", "passage")}
    assert licences.licences(df.limit(0)).count() == 0


def test_licence_bound_misses_nothing():
    rng = random.Random(2)
    for name, text in licences.TEMPLATES.items():
        grams = licences.template_bigrams(text)
        share = 0.8 / 1.2
        for _ in range(30):
            kept = rng.sample(sorted(set(grams)), max(1, -(-len(set(grams)) * 2 // 3)))
            assert len({w for g in kept for w in g.split()}) >= licences.words_needed(grams, share), name


def test_base_spans():
    text = 'TOKEN = "abcdef12" token: abc ' + "AKIA" + "A" * 16 + " " + "0a" * 12 + " é"
    assert [s[:3] for s in secrets.base_spans(text)] == [("assign", 0, 17), ("access", 30, 50), ("hex", 51, 75)]


def test_automaton_generalises():
    """Formats left out of learning are recognised, ordinary tokens are not."""
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((32, 40)))) for _ in range(200)]
    keys = ["".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(20)) for _ in range(200)]
    known = [secrets.form(v) for v in hexes[:100] + keys[:100]]
    a = secrets.Automaton([(f, 1) for f in known], {"l": 600, "x": 300, "d": 5, "U": 30, "s": 60})
    recall = sum(a.score(secrets.form(v)) >= secrets.BITS for v in hexes[100:] + keys[100:]) / 200
    assert recall >= 0.9
    assert not any(a.score(secrets.form(v)) >= secrets.BITS for v in "the internationalisation 2024-01-02 well-being42 chapter1 a1b2c3".split())


def test_scan_finds_what_patterns_miss(spark):
    rng = random.Random(5)
    value = lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(24))
    rows = [(i, f"set password = {value()} here") for i in range(60)] + [(100, f"it says {value()} only"), (101, "plain words 2024 here"), (102, None)]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == ["assign"] and got[100] == ["format"] and got[101] == [] and got[102] == []


def test_base_digest_matches_brute_force(spark, texts):
    from folioq.llm.queries import op5_secret_scans

    got = {r.doc_id: r for r in op5_secret_scans(spark, SF).collect()}
    for doc_id, text in texts:
        spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        spans.sort()
        assert got[doc_id].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        assert (got[doc_id].n_assign, got[doc_id].n_access, got[doc_id].n_hex) == tuple(sum(s[1] == k for s in spans) for k in range(3))


def test_base_counts():
    assert base_counts("a b c\na b c\n \n#x") == (7, 8, 1, 1, 6)
    assert base_counts(None) == (0, 0, 0, 0, 0)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.fit(docs, labels).score(docs.select("doc_id", "text")).join(labels, "doc_id").filter("crc32(cast(doc_id as string)) % 4 = 2").collect()
    clean, toxic = ([r.score >= 0.3 for r in rows if r.toxic == k] for k in (0, 1))
    assert sum(clean) <= 0.05 * len(clean) and sum(toxic) >= 0.5 * len(toxic) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_model_on_odd_rows(spark):
    """A model fitted on two classes scores nulls, empty, long and repeated texts, whatever the columns are called."""
    rows = [(i, "you idiot scum moron" if i % 3 == 0 else f"a fine day number {i}", 1 if i % 3 == 0 else 0) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x " * 50_000), (3, "idiot scum moron you"), (3, "idiot scum moron you")], "doc_id long, text string")
    got = model.score(odd).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    bad = [r.score for r in got if r.doc_id == 3]
    assert bad[0] == bad[1] and bad[0] >= 0.3 > next(r.score for r in got if r.doc_id == 1)
    clash = docs.selectExpr("doc_id", "text", "1 as score", "2 as prediction", "3 as probability")
    assert toxicity.reject_toxic(clash, labels).columns == clash.columns


def test_language_model_is_right_and_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in mixing.score_texts(docs).collect()}
    again = {r.doc_id: r.score for r in mixing.score_texts(docs.repartition(3)).collect()}
    assert all(again[i] == r.score for i, r in got.items())
    tokens = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) + [""] for r in docs.collect()}
    learned = {i for i in tokens if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in learned for w in tokens[i])
    total, distinct = sum(c.values()), len(c)
    for i, words in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens, got[i].held_out) == (len(words), sum(w in c for w in words), total, i not in learned)
        assert got[i].base_score == pytest.approx(base)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_scores_rows_each(spark):
    rows = [(1, "x y"), (1, "x y"), (None, "a"), (None, "b c"), (3, None), (4, "")]
    got = mixing.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 2), (0, 3), (1, 3), (1, 3), (3, 1), (4, 1)]
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_weights_learn_from_every_training_text(spark):
    """More training texts than any bound, each counted: the learned numbers are those of one pass over all of them."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(("red", "green", "blue", f"w{rng.randrange(50)}")) for _ in range(12))) for i in range(700)]
    texts = spark.createDataFrame(rows, "id long, text string").selectExpr("id", "text", "crc32(cast(cast(id as string) as binary)) % 10 = 0 as held_out")
    tables = mixing.bit_tables(texts, [16] * bits.K)
    learned = mixing.fitted(texts, tables)
    joint = bits.JointCounts(tables)
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            joint.add(t.encode().split())
    whole = joint.total()
    assert whole[: 2 * bits.JOINT].sum() == sum(bits.LENGTH[list(bits.stream(t.encode().split()))].sum() for i, t in rows if zlib.crc32(str(i).encode()) % 10)
    want = bits.BitMixer(tables)
    want.learn(whole)
    assert (learned.weights == want.weights).all() and (learned.refined == want.refined).all()


def test_bits_are_a_distribution():
    """One more byte's probabilities sum to one, learned tables or not."""
    counts = bits.BitCounts([16] * bits.K)
    for _ in range(50):
        counts.add(b"the cat sat on the mat".split())
    counts.flush()
    mixer = bits.BitMixer([bits.states(t) for t in counts.tables])
    lengths, first, node, bit = bits.LENGTH, bits.PLACE, bits.NODE, bits.BIT
    assert sum(2.0 ** -int(n) for n in lengths) == pytest.approx(1)
    assert len({tuple(bit[first[b] : first[b] + lengths[b]]) for b in range(256)}) == 256
    mixer.fit([b"the cat sat on the mat".split()] * 5)
    assert mixer.log2(b"the cat sat".split()) > mixer.log2(b"tac eht tas".split())


def test_lengths_match_brute_force(spark):
    rng = random.Random(6)
    sizes = [rng.choice((0, 1, 5, 900, 1024, 5000, 5001)) for _ in range(300)]
    hist = spark.createDataFrame([(s, 1) for s in sizes] + [(None, 1)], "n_tokens long, n_docs long")
    report = lengths.context_report(hist, [3, 1024, 9000])
    got = {r.context_limit: r for r in report.collect()}
    assert set(got) == set(sizes) | {3, 1024, 9000}
    for limit, r in got.items():
        fit = [s for s in sizes if s <= limit]
        assert (r.n_docs, r.docs_within, r.docs_over, r.tokens_within, r.truncated_tokens, r.total_tokens) == (sizes.count(limit), len(fit), len(sizes) - len(fit), sum(fit), sum(min(s, limit) for s in sizes), sum(sizes))
    for r in lengths.quantile_lengths(report, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == sorted(sizes)[max(0, math.ceil(r["quantile"] * len(sizes)) - 1)]
    assert lengths.context_report(hist.limit(0)).count() == 0 and [r.context_limit for r in lengths.limit_answers(hist, [7]).collect()] == [7]


def test_blocks_of_items_agree_with_one(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    bench = bench.unionByName(spark.createDataFrame([(None, "alpha beta"), (None, "gamma delta"), (None, "...")], bench.schema))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.lit("x alpha beta y gamma delta z")))
    one, cleaned = (sorted(map(tuple, f(docs, bench).collect()), key=str) for f in (decontaminate.hit_report, decontaminate.decontaminate))
    assert any(r[3] == 2 and r[4] == hashlib.sha256(b"").hexdigest() for r in one)
    monkeypatch.setattr(decontaminate, "WORDS_PER_AUTOMATON", 300)
    assert len(decontaminate.item_blocks(bench, "item_id", "text")) > 1
    many, again = (sorted(map(tuple, f(docs, bench).collect()), key=str) for f in (decontaminate.hit_report, decontaminate.decontaminate))
    assert one == many and cleaned == again


def test_fingerprints_match_brute_force(spark, texts):
    from folioq.llm.queries import op4_simhash

    def fp(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().lower())
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {i: fp(t) for i, t in texts}
    pairs = [(i, j) for i, j in itertools.combinations(sorted(prints), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    place = {i: k for k, i in enumerate(sorted(prints))}
    root = components(len(place), [(place[i], place[j]) for i, j in pairs])
    ids = sorted(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", ids[root[place[i]]]) for i in ids}


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three"), (2, None), (3, "")], "item_id long, text string")
    labels = spark.createDataFrame([(5, 1), (None, 0), (2, None)], "doc_id long, toxic int")
    for df, n in ((odd, 6), (none, 0)):
        assert bpe.digest_texts(df, vocabulary()).count() == n
        assert simhash.near_duplicates(df).count() == n
        assert quality(df).count() == n
        assert secrets.find_secrets(df).count() == n
        assert decontaminate.hit_report(df, bench).filter("contaminated").count() == min(1, n)
        assert pii.with_surrogates(df, "k").count() == n
        assert licences.licences(df).count() == 0
        assert mixing.score_texts(df).count() == n
        assert toxicity.reject_toxic(df, labels).columns == df.columns
        assert lengths.context_report(lengths.length_histogram(df, vocabulary()), []).agg({"n_docs": "sum"}).first()[0] == (n or None)
    got = {r.doc_id: r for r in bpe.digest_texts(odd, vocabulary()).collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].ids_sha256 == got[1].decoded_sha256 == hashlib.sha256(b"").hexdigest()


def test_nameless_items_count_alike_in_any_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(None, "one two three"), (None, "four five six"), (None, "four five six"), ("a", "seven eight nine"), (None, ""), ("w", "...")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "x one two three four five six y seven eight nine"), (2, None)], "doc_id long, text string")
    once = decontaminate.hit_report(docs, items).collect()
    monkeypatch.setattr(decontaminate, "WORDS_PER_AUTOMATON", 3)
    assert decontaminate.hit_report(docs, items).collect() == once
    assert [(r.n_items, r.n_hit) for r in once] == [(4, 9), (0, 0)]
    assert [r.text for r in decontaminate.decontaminate(docs, items, max_coverage=0.99).collect()] == ["x  y ", None]


def test_columns_of_any_name(spark, monkeypatch):
    """Columns called like the operators' own come through with their values."""
    from folioq.llm.near_copies import keep_representatives

    kind = "doc_id long, text string, found long, row long, v long, `both` long, id long, n long, root long, best long"
    docs = spark.createDataFrame([(i, "see four five six at a.b@example.org", *[10 * i + k for k in range(8)]) for i in (1, 2)], kind)
    items = spark.createDataFrame([("a", "four five six"), ("b", "no such words")], "item_id string, text string")
    rest = docs.columns[2:]
    for size in (100_000, 3):
        monkeypatch.setattr(decontaminate, "WORDS_PER_AUTOMATON", size)
        out = decontaminate.decontaminate(docs, items)
        assert out.columns == docs.columns and sorted(r[rest[0]] for r in out.collect()) == [10, 20]
    assert [tuple(r) for r in keep_representatives(docs).collect()] == [tuple(docs.first())]
    out = pii.with_surrogates(docs, "k", count_col="n_found")
    assert [(r.n_found, r.both) for r in out.orderBy("doc_id").collect()] == [(1, 13), (1, 23)]
