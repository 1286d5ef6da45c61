"""Secret scans by grammar inference.

Credentials that fixed patterns recognise label the formats. Their symbol classes form a prefix tree whose compatible states
are merged into a probabilistic automaton; all other candidates are reported if the automaton explains their format better, by
a set number of bits, than the class frequencies of ordinary tokens do.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import store

#: The patterns of the base kinds.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ORDER = {"assign": 0, "access": 1, "hex": 2, "format": 3}
#: Candidates: runs of the symbols of credentials with a digit and a letter.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{6,}")
#: Labelled credentials that are learned from at most, picked by a hash, and their symbols.
LEARN_ROWS, LEARN_SYMBOLS = 4_000, 200_000
#: Confidence parameter of the merge test, and the bits by which the automaton must explain a candidate better.
ALPHA, BITS = 0.05, 24.0
#: Symbol classes: digits, small letters that are hex digits, other small letters, capitals, the rest.
CLASSES = "".join("d" if c.isdigit() else "x" if c in "abcdef" else "l" if c.islower() else "U" if c.isupper() else "s" for c in map(chr, range(128)))
SYMBOLS = "dxlUs"


def form(value: str) -> str:
    return value.translate(CLASSES)


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the fixed kinds, by start and kind."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


class Automaton:
    """Deterministic probabilistic automaton from counted strings by compatible state merging.

    ordinary: how often each symbol class occurs in tokens that are no credentials.
    """

    def __init__(self, counted: list[tuple[str, int]], ordinary: dict[str, int] | None = None) -> None:
        known = {c: (ordinary or {}).get(c, 0) + 1 for c in SYMBOLS}
        self.ordinary = {c: math.log2(n / sum(known.values())) for c, n in known.items()}
        self.step: list[dict[str, int]] = [{}]
        self.seen: list[dict[str, int]] = [{}]
        self.ends = [0]
        for text, n in sorted(counted):
            at = 0
            for c in text:
                self.seen[at][c] = self.seen[at].get(c, 0) + n
                if c not in self.step[at]:
                    self.step[at][c] = len(self.step)
                    self.step.append({})
                    self.seen.append({})
                    self.ends.append(0)
                at = self.step[at][c]
            self.ends[at] += n
        self.merge_all()

    def total(self, q: int) -> int:
        return self.ends[q] + sum(self.seen[q].values())

    def compatible(self, a: int, b: int) -> bool:
        """Hoeffding bounds hold for ends and every symbol, here and below."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self.total(a), self.total(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for c in self.seen[a].keys() | self.seen[b].keys():
                if abs(self.seen[a].get(c, 0) / n - self.seen[b].get(c, 0) / m) > bound:
                    return False
                if c in self.step[a] and c in self.step[b]:
                    stack.append((self.step[a][c], self.step[b][c]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the subtree of b into a."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.seen[b].items():
                self.seen[a][c] = self.seen[a].get(c, 0) + n
                if c in self.step[a]:
                    stack.append((self.step[a][c], self.step[b][c]))
                else:
                    self.step[a][c] = self.step[b][c]

    def merge_all(self) -> None:
        red, blue = [0], [(0, c) for c in sorted(self.step[0])]
        while blue:
            p, c = blue.pop(0)
            q = self.step[p][c]
            if q in red:
                continue
            other = next((r for r in red if self.compatible(r, q)), None)
            if other is None:
                red.append(q)
            else:
                self.step[p][c] = other
                self.fold(other, q)
            blue = [(r, x) for r in red for x in sorted(self.step[r]) if self.step[r][x] not in red]

    def score(self, text: str) -> float:
        """log2 likelihood of a whole string, its end included, over that of ordinary tokens; minus infinity outside the language."""
        at, total = 0, 0.0
        for c in text:
            if c not in self.step[at]:
                return -math.inf
            total += math.log2(self.seen[at][c] / self.total(at)) - self.ordinary[c]
            at = self.step[at][c]
        return total + math.log2(self.ends[at] / self.total(at)) if self.ends[at] else -math.inf


def labelled_formats(docs: DataFrame, text_col: str) -> tuple[list[tuple[str, int]], dict[str, int]]:
    """Formats of the labelled credentials, counted, and the symbol classes of ordinary tokens, both over all texts.

    Beyond LEARN_ROWS formats or LEARN_SYMBOLS symbols a hash of the format picks those that are learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinary: Counter[str] = Counter()
        for batch in batches:
            found = []
            for t in batch.column(0):
                text, at, rest = t.as_py() or "", 0, []
                for _, start, end, v in base_spans(text):
                    found.append(form(v))
                    rest.append(text[at:start])
                    at = max(at, end)
                classes = "".join([*rest, text[at:]]).translate(CLASSES)
                for c in SYMBOLS:
                    ordinary[c] += classes.count(c)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([1] * len(found), pa.int64()), pa.array([False] * len(found), pa.bool_())], ["form", "n", "ordinary"])
        yield pa.RecordBatch.from_arrays([pa.array(list(ordinary), pa.string()), pa.array(list(ordinary.values()), pa.int64()), pa.array([True] * len(ordinary), pa.bool_())], ["form", "n", "ordinary"])

    counts = store(docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "form string, n long, ordinary boolean").groupBy("form", "ordinary").agg(F.sum("n").alias("n")))
    picked, symbols = [], 0
    for r in counts.filter(~F.col("ordinary")).orderBy(F.xxhash64("form"), "form").limit(LEARN_ROWS).toLocalIterator():
        symbols += len(r.form)
        if picked and symbols > LEARN_SYMBOLS:
            break
        picked.append((r.form, r.n))
    return picked, {r.form: r.n for r in counts.filter("ordinary").collect()}


def all_spans(text: str, automaton: Automaton | None) -> list[tuple[str, int, int, str]]:
    base = base_spans(text)
    if automaton is None:
        return base
    more = []
    for m in CANDIDATE.finditer(text):
        v = m[0]
        if automaton.score(form(v)) >= BITS and not any(a < m.end() and m.start() < b for _, a, b, _ in base):
            more.append(("format", m.start(), m.end(), v))
    return sorted([*base, *more], key=lambda s: (s[1], ORDER[s[0]]))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row; spans holds (kind, start, end) in code points, end exclusive, base kinds and `format`.

    Null and empty texts have no spans. Without any labelled credential nothing is added to the base kinds. Rows are
    independent once the automaton is learned, so repeated rows agree; values and texts of any length are read whole; extra
    columns are not carried along.
    """
    counted, ordinary = labelled_formats(docs, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(counted, ordinary) if counted else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b, _ in all_spans(t.as_py() or "", shared.value)] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("id", id_col)
