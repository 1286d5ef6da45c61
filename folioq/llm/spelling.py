"""Spelling variants by dense prefix-suffix tiling.

Two words whose lengths are m and m or m + 1 differ by one edit exactly if their common prefix and suffix together reach the
longer length minus one. The shorter word is cut into PIECES; the edit falls into one of them, so both words agree on all code
points before that piece and, counted from the end, on all behind it. That is the key of a group. Members of a group
are compared pair by pair as padded matrices of code points; a group of more than BLOCK words is dealt into blocks, and every pair of blocks is a
tile of its own, so neither a task nor a row ever holds more than two blocks of a group. Only words that are near each other leave a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import cut, store

#: Fixed values of the registered query: code points of the shortest word, occurrences, deletion rate, and how much more frequent a form is.
SHORTEST, LEAST, RATE, FACTOR = 7, 2, 31, 10
PIECES, BLOCK = 3, 512
#: Distinct words that a task counts before it hands them on, and bytes of a matrix that are compared at a time.
HELD, CHUNK = 200_000, 1 << 22
TILE = ["m", "q", "key", "i", "j"]


def runs(text: str | None, shortest: int) -> list[str]:
    """Maximal runs of letters of at least `shortest` code points, A-Z lower-cased."""
    return re.findall(f"[a-zÀ-ÿ]{{{shortest},}}", text.encode("utf-8").lower().decode("utf-8")) if text else []


def damaged(run: str, start: int, rate: int) -> str:
    """The run, or, where its checksum (which goes on from that of `<doc_id>:`) is divisible by the rate, the run without one code point."""
    h = zlib.crc32(run.encode("utf-8"), start)
    if h % rate:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """(word, n) of all words of at least SHORTEST code points and LEAST occurrences in whole texts; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{name.as_py() or ''}:".encode())
                for word, n in Counter(runs(text.as_py(), SHORTEST)).items():
                    new = damaged(word, start, rate)
                    if len(new) >= SHORTEST:
                        held[new] += n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    src = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, m, q, key, role) for every piece q that an edit may fall into; role 0 is a word of length m, role 1 one of m + 1."""
    roles = F.explode(F.flatten(F.array(*[F.array(*[F.struct(F.lit(role).alias("role"), F.lit(q).alias("q")) for q in range(PIECES)]) for role in (0, 1)])))
    rows = words.select("word", "n", F.length("word").alias("len"), roles.alias("at")).select("word", "n", "len", "at.*").withColumn("m", F.col("len") - F.col("role")).filter(F.col("m") >= SHORTEST)
    before, behind = F.floor(F.col("m") * F.col("q") / PIECES).cast("int"), (F.col("m") - F.floor(F.col("m") * (F.col("q") + 1) / PIECES)).cast("int")
    key = F.xxhash64(F.substring("word", F.lit(1), before), F.lit("\x00"), F.substring("word", F.col("len") - behind + 1, behind))
    return rows.select("word", "n", "m", "q", key.alias("key"), "role")


def tiles(rows: DataFrame) -> DataFrame:
    """Rows of keyed() dealt to tiles (m, q, key, i, j) of the blocks i <= j of a group; `block` is the row's own."""
    sizes = rows.groupBy("m", "q", "key").agg(F.count("*").alias("size"), F.min("role").alias("shortest")).filter((F.col("size") > 1) & (F.col("shortest") == 0))
    blocks = sizes.select("m", "q", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    own = rows.join(blocks, ["m", "q", "key"]).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    other = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select("word", "n", "m", "q", "key", "role", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def matrices(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the words from the left and from the right, padded with zeros (all are below 256), and the lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max(initial=1))
    left = np.frombuffer(b"".join(w.encode("latin-1").ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    right = np.frombuffer(b"".join(w.encode("latin-1")[::-1].ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
    return left, right, size


def agreement(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of two matrices."""
    differ = a != b
    first = differ.argmax(axis=1)
    return np.minimum(np.where(differ.any(axis=1), first, differ.shape[1]), most)


def near_pairs(words: list[str], tile: np.ndarray, block: np.ndarray, m: int, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) that are one edit apart, rows of one tile lying together.

    Rows are compared with those one, two, three ... places on, as far as their tile reaches. A pair counts in the first piece that fits it, so
    once in all groups; rows of a tile of two blocks are compared across the blocks only.
    """
    left, right, size = matrices(words)
    last = np.searchsorted(tile, tile, side="right") - 1
    mixed = np.zeros(len(words), bool)
    if len(words):
        starts = np.searchsorted(tile, tile, side="left")
        low, high = (f.reduceat(block, np.unique(starts)) for f in (np.minimum, np.maximum))
        mixed = (low != high)[np.unique(starts, return_inverse=True)[1]]
    bounds = np.array([m * k // PIECES for k in range(PIECES + 1)])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CHUNK // max(1, left.shape[1] if len(words) else 1))
    for shift in range(1, int((last - np.arange(len(words))).max(initial=0)) + 1):
        rows = np.flatnonzero(last - np.arange(len(words)) >= shift)
        rows = rows[(~mixed[rows] | (block[rows] != block[rows + shift])) & ((size[rows] == m) | (size[rows + shift] == m))]
        for k in range(0, len(rows), step):
            a = rows[k : k + step]
            b = a + shift
            least, most = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
            start, end = agreement(left[a], left[b], least), agreement(right[a], right[b], least)
            fits = (start[:, None] >= bounds[:-1]) & (end[:, None] >= m - bounds[1:])
            near = (start + end >= most - 1) & (fits.argmax(axis=1) == q[a]) & fits.any(axis=1) & ((start < most) | (size[a] != size[b]))
            found.append((a[near], b[near]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ([], [])))


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of sorted tiles, both ways, as (word, near, near_n); a tile that a batch breaks off waits for its rest."""
    rest: pa.Table | None = None

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        m = t.column("m").to_numpy()
        ids = np.zeros(len(m), np.int64)
        for c in TILE:
            x = t.column(c).to_numpy()
            ids[1:] |= x[1:] != x[:-1]
        ids = np.cumsum(ids)
        for one in np.unique(m):  # one length at a time, so that the padding stays small
            at = np.flatnonzero(m == one)
            words, n = t.column("word").take(pa.array(at)).to_pylist(), t.column("n").to_numpy()[at]
            a, b = near_pairs(words, ids[at], t.column("block").to_numpy()[at], int(one), t.column("q").to_numpy()[at])
            names = pa.array(words, pa.string())
            for x, y in ((a, b), (b, a)):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(x)), names.take(pa.array(y)), pa.array(n[y], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
        same = np.ones(len(t), bool)
        for c in TILE:
            x = t.column(c).to_numpy()
            same &= x == x[-1] if len(x) else True
        cutoff = int(np.argmax(same)) if len(t) else 0
        if cutoff:
            yield from out(t.slice(0, cutoff))
        rest = t.slice(cutoff)
    if rest is not None and len(rest):
        yield from out(rest)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for every two words of (word, n) that differ by one inserted, deleted or replaced code point, both ways."""
    dealt = tiles(keyed(words)).repartition(*TILE).sortWithinPartitions(*TILE)
    return dealt.mapInArrow(compare, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, factor: int = FACTOR) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least seven code points that occurs twice or more.

    Null and empty texts have no words; a null id counts as the empty text in the checksum. Repeated rows count each. Very long texts and runs are
    taken whole. Of near words with one count, the smallest in code-point order is the form. No row of an empty table, none of other columns.
    """
    words = store(word_counts(docs, id_col, text_col, rate))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    formed = (-F.col("best.minus")) >= factor * F.col("n")
    rows = store(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.minus")).alias("form_n")))
    # a form is far more frequent than its word, so chains are short and have no cycle; each round doubles the steps taken
    roots = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = new.select("word", "root")
        if new.filter("moved").isEmpty():
            break
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
