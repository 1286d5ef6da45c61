"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is over words. Training words are streamed through it while the length of the longest match that
ends at each word is tracked; windows of enough words, and whole short items, mark the words they cover.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import fold, fresh, pieces, store

#: Words of test items per automaton (about 1.2 KB each in a worker); a larger benchmark is handled in blocks, one pass each.
WORDS_PER_AUTOMATON = 100_000
#: Starts the names of items without an id.
NAMELESS = "\x00"
FOUND, FOUND_TYPE = "found", "struct<starts: array<bigint>, ends: array<bigint>, items: array<string>>"
#: Everything outside a-z, 0-9 and non-ASCII separates words (upper case is folded before).
SEPARATORS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    return fold(text).translate(SEPARATORS).split()


class ItemAutomaton:
    """Generalised suffix automaton of word sequences, with the items that each state occurs in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[str]] = [set()]  # items whose prefixes end in the state, later all its occurrences
        self.whole: list[list[tuple[int, str]]] = [[]]  # short items that end in the state: length, id
        self.shortest = window
        for name, words in items:
            if words:
                self.add(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words])
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.items[self.link[v]] |= self.items[v]

    def add(self, name: str, ids: list[int]) -> None:
        last = 0
        for x in ids:
            last = self.extend(last, x)
            self.items[last].add(name)
        if len(ids) < self.window:
            self.shortest = min(self.shortest, len(ids))
            self.whole[last].append((len(ids), name))

    def state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.items.append(set())
        self.whole.append([])
        return len(self.link) - 1

    def extend(self, last: int, x: int) -> int:
        """The state of the path to `last` followed by x; states are split where occurrences differ."""
        known = self.next[last].get(x)
        if known is not None and self.length[known] == self.length[last] + 1:
            return known
        if known is not None:
            return self.split(last, x, known)
        new = self.state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and x not in self.next[p]:
            self.next[p][x] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][x]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self.split(p, x, q)
        return new

    def split(self, p: int, x: int, q: int) -> int:
        """Give the suffixes of q of at most length(p) + 1 a state of their own."""
        copy = self.state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(x) == q:
            self.next[p][x] = copy
            p = self.link[p]
        return copy

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered [start, end) word ranges, in order of their end, and the items with a window here."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        unknown = np.flatnonzero(ids < 0)
        starts, ends = np.concatenate([[0], unknown + 1]), np.concatenate([unknown, [len(ids)]])
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for i in np.flatnonzero(ends - starts >= self.shortest):  # a match never spans an unknown word
            self.walk(ids[starts[i] : ends[i]].tolist(), int(starts[i]), spans, found)
        return spans, found

    def walk(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        v = size = 0
        for at, x in enumerate(ids, base + 1):
            while v and x not in self.next[v]:
                v = self.link[v]
                size = self.length[v]
            v = self.next[v].get(x, 0)
            size = size + 1 if v else 0
            if size < self.shortest:
                continue
            u, span = v, 0
            while u > 0:
                for k, name in self.whole[u]:
                    if k <= size:
                        found.add(name)
                        span = max(span, k)
                if self.length[self.link[u]] < self.window <= min(size, self.length[u]):
                    found |= self.items[u]
                    span = self.window
                u = self.link[u]
            if span:
                spans.append((at - span, at))


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> list[DataFrame]:
    """The items with words as (id, text) in blocks of about WORDS_PER_AUTOMATON words, dealt by a hash; one block is the usual case.

    Items without an id are named by their text and their number among equal texts before they are dealt, so every block knows an item by one name.
    """
    given = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("words", F.regexp_count("text", F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))).filter("words > 0")
    equal = given.filter("id is null").groupBy("text", "words").agg(F.count("*").alias("n"))
    numbered = equal.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"), "text", "words")
    items = given.filter("id is not null").unionByName(numbered.select(F.concat_ws(":", F.lit(NAMELESS), F.sha2(F.col("text").cast("binary"), 256), "i").alias("id"), "text", "words"))
    words = items.agg(F.sum("words")).first()[0] or 0
    n = 1 + words // WORDS_PER_AUTOMATON
    return [(items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else items).select("id", "text") for i in range(n)]


def automaton(block: DataFrame, window: int) -> ItemAutomaton:
    """The automaton of a block."""
    return ItemAutomaton([(name, words_of(text)) for name, text in sorted((r.id, r.text) for r in block.collect())], window)


def matched(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str) -> tuple[DataFrame, Callable[[], Callable]]:
    """The documents with a column of findings behind the others, and what gives a task its function from a text to (words, spans, items).

    A single block is broadcast: its size is bounded. Of several blocks only one at a time is with the tasks; the documents are
    numbered and stored, matched against the blocks one after another, and get the joined findings as a column.
    """
    blocks = item_blocks(benchmark, item_col, "text")
    last = fresh(FOUND, docs.columns)
    sc = docs.sparkSession.sparkContext
    if len(blocks) == 1:
        shared = sc.broadcast(automaton(blocks[0], window))

        def by_automaton() -> Callable:
            own = shared.value

            def find(text: str | None, _: object) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
                words = words_of(text)
                return words, *own.matches(words)

            return find

        return docs.withColumn(last, F.lit(None).cast(FOUND_TYPE)), by_automaton
    number = fresh("row", [*docs.columns, last])
    numbered = store(docs.withColumn(number, F.monotonically_increasing_id()))
    parts = []
    for block in blocks:
        shared = sc.broadcast(automaton(block, window))
        parts.append(store(numbered.select(F.col(number).alias("row"), F.col(text_col).cast("string").alias("text")).mapInArrow(block_findings(shared), f"row long, {FOUND} {FOUND_TYPE}")))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.collect_list(FOUND).alias("all"))  # a row a block at most
    merged = found.select(F.col("row").alias(number), F.struct(F.flatten("all.starts").alias("starts"), F.flatten("all.ends").alias("ends"), F.flatten("all.items").alias("items")).alias(last))

    def by_column() -> Callable:
        def find(text: str | None, known: dict | None) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
            return words_of(text), list(zip(known["starts"], known["ends"], strict=True)) if known else [], set(known["items"]) if known else set()

        return find

    return numbered.join(merged, number, "left").drop(number), by_column


def block_findings(shared: Broadcast) -> Callable:
    """Per text with a match (row, spans, items) for one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                spans, items = shared.value.matches(words_of(text.as_py()))
                if spans:
                    rows.append(row)
                    found.append({"starts": [int(a) for a, _ in spans], "ends": [int(b) for _, b in spans], "items": sorted(items)})
            kind = pa.struct([("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, kind)], ["row", FOUND])

    return run


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    return np.cumsum(edge[:-1]) > 0


def hit_report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256, contaminated; no text is changed.

    Null and empty texts have no words and no hits; wordless items match nothing. Items with one id count as one item; items
    without an id count each, but have no place in the digest. Repeated documents are reported each, very long ones are
    matched whole. Extra columns are not carried along.
    """
    src, finder = matched(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), benchmark, window, "text", item_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in pieces(batches):
            rows: list[tuple[int, int, int, str]] = []
            for text, known in zip(batch.column(1), batch.column(2), strict=True):
                words, spans, items = find(text.as_py(), known.as_py())
                n_hit = int(covered(spans, len(words)).sum()) if spans else 0
                shown = ",".join(sorted(x for x in items if not x.startswith(NAMELESS)))
                rows.append((len(words), n_hit, len(items), hashlib.sha256(shown.encode()).hexdigest()))
            n_words, n_hit, n_items, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_hit, n_items)), pa.array(sha, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_())],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").withColumnRenamed("id", id_col)


def without(text: str, words: list[bytes], spans: list[tuple[int, int]], max_coverage: float) -> str | None:
    """The text without covered words; null if they are more than max_coverage of it."""
    hit = covered(spans, len(words))
    if hit.mean() > max_coverage:
        return None
    out, at = [], 0
    found = list(WORD.finditer(text))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(text[at : found[a].start()])
        at = found[b - 1].end()
    return "".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Cut covered spans out of the texts and drop documents of which they cover more than max_coverage.

    All columns are kept. Null and empty texts pass unchanged, as does everything when the benchmark is empty; rows are
    judged each, repeated and very long ones too.
    """
    src, finder = matched(docs, benchmark, window, text_col, item_col)
    at, last = docs.columns.index(text_col), len(docs.columns)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder()
        for batch in pieces(batches):
            new, keep = [], []
            for text, known in zip(batch.column(at).to_pylist(), batch.column(last), strict=True):
                words, spans, _ = find(text, known.as_py())
                new.append(without(text, words, spans, max_coverage) if spans else text)
                keep.append(not spans or new[-1] is not None)
            columns = list(batch.columns)[:last]
            columns[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(keep, pa.bool_()))

    return src.mapInArrow(run, docs.schema)
