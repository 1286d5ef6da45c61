"""SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint gets a label m(i), a nonzero vector of three bits. For each nonzero v of three bits, table v keeps
the bits with odd <m(i), v>. Two labels always have a common orthogonal v, so two fingerprints that differ in at most two
bits agree on all bits that some table keeps: every such pair meets in a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioq.llm.common import cut, fold
from folioq.llm.graph import connected_components

RADIUS, BITS, SEED = 2, 64, 42
#: Shingles hashed at a time, so that a very long text needs little memory.
BLOCK = 65_536


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks; every error pattern of `radius` bits lies outside at least one of them."""
    labels = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % labels + 1) & v).bit_count() % 2) for v in range(1, labels + 1)]


def fingerprint(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes; no words give 0."""
    words = fold(text).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, n, BLOCK):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(a, min(n, a + BLOCK))), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def majority(h: np.ndarray) -> int:
    """The fingerprint of a set of hashes: a bit is 1 if it is set in over half of them; an empty set gives 0."""
    ones = sum((np.unpackbits(h[a : a + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for a in range(0, len(h), BLOCK)), np.zeros(BITS, np.int64))
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * ones > len(h))))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) per row; null and empty texts have fingerprint zero. Extra columns are not carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = pa.array([signed(fingerprint(t.as_py())) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], ["id", "fp"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between representatives `rep` of distinct fingerprints `fp`, complete up to connectivity.

    Fingerprints that share a bucket of some table emit themselves with each free bit of that table flipped at most once.
    Two of them emit a common value exactly if they differ in at most two bits, and at most 65 fingerprints can emit
    the same value, so a group is never larger than that and all its members are true links of each other.
    """
    masks = [signed(m) for m in covering_masks()]
    keyed = classes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    shared = keyed.groupBy("table", "key").agg(F.count("*").alias("n")).filter("n > 1").select("table", "key")
    free = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("table") + 1)
    flips = keyed.join(shared, ["table", "key"]).groupBy("fp", "rep").agg(F.bit_or(free).alias("free"))
    own = F.array(F.col("fp"), *[F.when(F.col("free").bitwiseAND(F.lit(signed(1 << i))) != 0, F.col("fp").bitwiseXOR(F.lit(signed(1 << i)))) for i in range(BITS)])
    near = flips.select("rep", F.explode(F.array_compact(own)).alias("value")).groupBy("value").agg(F.collect_list("rep").alias("reps")).filter(F.size("reps") > 1)
    return near.select(F.array_min("reps").alias("b"), F.explode("reps").alias("a")).filter("a <> b").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row: the smallest id reachable by links of at most two differing bits.

    Null and empty texts share fingerprint zero. Repeated ids are reported once per row; rows with a null id belong to
    the component of their fingerprint but link nothing if all rows of a fingerprint have null ids (component null then).
    """
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = connected_components(links(classes.filter("rep is not null")))
    known = classes.join(roots, classes.rep == roots.v, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(known, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
