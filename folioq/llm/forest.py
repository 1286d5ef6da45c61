"""Near copies by an LSH forest of MinHash signatures over shingles of words; links are confirmed on whole sets.

Every distinct set has a label in each of TREES orders: DEPTH minimum hashes. Two sets lie in one region of an order as long as their labels
agree. Regions begin at START hashes; one that holds more than REGION sets is taken apart by the next hash, and so on, so the depth follows
how dense the sets lie. Sets of a similarity of 0.8 share START hashes in some order but for 3 pairs in a million, and all DEPTH hashes but for 3 in a thousand.

In every region of the first orders all sets meet one of them, its hub, and their neighbours by the longest common prefix; what passes the exact
test is linked. Regions that still hold several components are then compared pair by pair across these, by their whole
signatures: first each set's most likely partners are tried, then, with the sets at hand, every pair that may pass, of which only links leave the
task. No set and no partner is left out of a region, however large: what is too large for a task is dealt into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioq.llm.common import fold, pieces, store
from folioq.llm.graph import connected_components
from folioq.llm.simhash import links as fingerprint_links
from folioq.llm.simhash import majority, signed

WIDTH, SEED = 2, 42
TREES, DEPTH, START = 32, 8, 5
#: Sets of a region that is not taken apart further; orders whose regions are linked through hubs first.
REGION, FIRST = 128, 4
#: Ids (8 bytes each) that are broadcast at most; more of them are joined by a shuffle.
BROADCAST = 1_000_000
#: Sets on either side of a tile, and partners of a set that are tried before all others.
ASKING, ASKED, NEAREST = 256, 2_048, 4
#: Of the HASHES minimum hashes, a pair of similarity 0.8 shares fewer than this with a chance of about 1 in 10^6.
HASHES = TREES * DEPTH
PLAUSIBLE = round(HASHES * (0.8 - 4.8 * (0.16 / HASHES) ** 0.5))
#: Shingles hashed at a time.
BLOCK = 1_024
#: Factors of the words of a run, by place, and of the minimum hashes.
PLACES = np.random.default_rng(SEED).integers(1, 1 << 63, 16, np.uint64) * np.uint64(2) + np.uint64(1)
FACTORS = np.random.default_rng(SEED).integers(1, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one run, and no words give none."""
    words = fold(text).split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    k = min(len(h), width)
    n = len(h) - k + 1 if k else 0
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * PLACES[i]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ out >> np.uint64(32))


def digest(h: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(h.tobytes(), SEED)


def signature(h: np.ndarray) -> bytes:
    """The upper 16 bits of the HASHES minimum hashes of a set, in big-endian order so that labels sort as bytes."""
    least = np.full(HASHES, (1 << 32) - 1, np.uint32)
    low = (h >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(low), BLOCK):
        np.minimum(least, (low[a : a + BLOCK, None] * FACTORS).min(axis=0), out=least)
    return (least >> np.uint32(16)).astype(">u2").tobytes()


def described(docs: DataFrame, width: int, prints: bool) -> DataFrame:
    """(id, v, n, signature, fp) of every row of (id, text): the digest of its set, its size, its minimum hashes and its SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            v, n, s, fp = [], [], [], []
            for t in batch.column(1):
                h = shingles(t.as_py(), width)
                v.append(digest(h))
                n.append(len(h))
                s.append(signature(h) if len(h) else None)
                fp.append(signed(majority(h)) if prints and len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary()), pa.array(n, pa.int64()), pa.array(s, pa.binary()), pa.array(fp, pa.int64())], ["id", "v", "n", "signature", "fp"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, v binary, n long, signature binary, fp long")


def regions(classes: DataFrame) -> DataFrame:
    """(g, t, label, v, n): the sets of every region g of order t that holds two sets or more, each region as deep as its density asks."""
    orders = classes.select("v", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    rows = orders.select("v", "n", "t", F.substring("signature", F.col("t") * 2 * DEPTH + 1, F.lit(2 * DEPTH)).alias("label"))
    parts = []
    for depth in range(START, DEPTH + 1):
        keyed = rows.withColumn("g", F.xxhash64("t", F.lit(depth), F.substring("label", 1, 2 * depth)))
        dense = keyed.groupBy("g").agg(F.count("*").alias("size")).filter("size > 1")
        known = store(keyed.join(dense, "g"))
        whole = known if depth == DEPTH else known.filter(F.col("size") <= REGION)
        parts.append(whole.select("g", "t", "label", "v", "n"))
        rows = known.filter(F.col("size") > REGION).select("v", "n", "t", "label")
        if depth == DEPTH or rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def linked(a: bytes, b: bytes) -> bool:
    """Whether two sets have 100 * intersection >= 80 * union, that is 9 * common >= 4 * (n + m)."""
    both = np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)])
    both.sort()
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            keep = [linked(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = (sets.select(F.col("v").alias(c), F.col("shingles").alias(f"of_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """(v, shingles) of the sets v of reps (v, id), read from the rows that stand for them; up to BROADCAST ids go to the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            h = [shingles(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in h], pa.binary()), pa.array([x.tobytes() for x in h], pa.binary())], ["v", "shingles"])

    ids = reps.select(F.xxhash64("id").alias("k")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST else ids
    wanted = docs.withColumn("k", F.xxhash64("id")).join(ids, "k", "left_semi").select("text")
    return wanted.mapInArrow(run, "v binary, shingles binary").join(reps.select("v"), "v", "left_semi").groupBy("v").agg(F.first("shingles").alias("shingles"))


def meetings(found: DataFrame, neighbours: bool = True) -> DataFrame:
    """Pairs (a, b) of the first orders: every set of a region with its hub and, if asked for, in regions that weren't too dense with its neighbour by the label."""
    first = found.filter(F.col("t") < FIRST)
    hubs = first.groupBy("g").agg(F.min_by(F.struct("v", "n"), F.xxhash64("v")).alias("hub"))
    met = first.join(hubs, "g").select("v", "n", "hub")
    if neighbours:
        small = first.groupBy("g").agg(F.count("*").alias("size")).filter(F.col("size") <= REGION)
        after = first.join(small, "g").withColumn("hub", F.lead(F.struct("v", "n")).over(Window.partitionBy("g").orderBy("label", "v")))
        met = met.unionByName(after.select("v", "n", "hub").filter("hub is not null"))
    return pairs_of(met)


def pairs_of(met: DataFrame) -> DataFrame:
    """Pairs (a, b), each once, of sets (v, n) and the sets `hub` (v, n) that they meet, if the sizes allow a link."""
    return met.filter((F.col("v") != F.col("hub.v")) & alike(F.col("n"), F.col("hub.n"))).select(F.least("v", "hub.v").alias("a"), F.greatest("v", "hub.v").alias("b")).distinct()


def fingerprint_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) by SimHash: every set with the one that stands for its fingerprint, and that with the least one that stands for a
    fingerprint at most two bits away. So a set is in few pairs however many are near; what these leave apart the forest compares."""
    prints = classes.select("v", "n", "fp")
    stand = prints.groupBy("fp").agg(F.min(F.struct("v", "n")).alias("rep"))
    same = prints.join(stand, "fp").select("v", "n", F.col("rep").alias("hub"))
    near = fingerprint_links(stand).groupBy("a").agg(F.min("b").alias("hub")).select("a.v", "a.n", "hub")
    return pairs_of(same.filter(F.col("v") != F.col("hub.v")).unionByName(near))


def alike(n, m):
    """Whether sets of these sizes can have a Jaccard similarity of 0.8."""
    return 5 * F.least(n, m) >= 4 * F.greatest(n, m)


def open_tiles(found: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(g, i, j, asks, t, v, n, root, signature): in regions of several components, the sets outside the largest ask all others of the region.

    A region is dealt into tiles of a block i of those that ask and a block j of those that are asked.
    """
    rooted = found.join(roots.select(F.col("v"), "root"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    parts = rooted.groupBy("g", "root").agg(F.count("*").alias("size"))
    split = parts.groupBy("g").agg(F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("size").alias("all"), F.max("size").alias("most")).filter(F.col("all") > F.col("most"))
    blocks = split.select("g", "main", F.ceil((F.col("all") - F.col("most")) / ASKING).cast("int").alias("is"), F.ceil(F.col("all") / ASKED).cast("int").alias("js"))
    rows = rooted.join(blocks, "g").withColumn("i", F.pmod(F.xxhash64("v"), F.col("is")).cast("int")).withColumn("j", F.pmod(F.xxhash64("v"), F.col("js")).cast("int"))
    asked = rows.select("g", "t", "v", "n", "root", "j", F.explode(F.sequence(F.lit(0), F.col("is") - 1)).alias("i"), F.lit(False).alias("asks"))
    asking = rows.filter("root <> main").select("g", "t", "v", "n", "root", "i", F.explode(F.sequence(F.lit(0), F.col("js") - 1)).alias("j"), F.lit(True).alias("asks"))
    return asked.unionByName(asking).join(classes.select("v", "signature"), "v").select("g", "i", "j", "asks", "t", "v", "n", "root", "signature")


class Tile:
    """The sets of a tile: those that ask, and all that are asked, as a matrix of minimum hashes."""

    def __init__(self, rows: list[tuple]) -> None:
        self.asking, self.asked = [r for r in rows if r[0]], [r for r in rows if not r[0]]
        self.t = rows[0][1]
        self.grid = np.frombuffer(b"".join(r[5] for r in self.asked), np.uint16).reshape(len(self.asked), HASHES)
        self.n = np.array([r[3] for r in self.asked], np.int64)
        component: dict[bytes, int] = {}
        self.component = component
        self.of = np.array([component.setdefault(r[4], len(component)) for r in self.asked], np.int64)

    def partners(self, row: tuple) -> np.ndarray:
        """Asked sets of other components that may be linked with the asking one, those that share the most minimum hashes first.

        Whole labels that agree in an earlier order have put both into one region there, so they are left to it.
        """
        size, root, s = row[3:6]
        may = np.flatnonzero((5 * np.minimum(self.n, size) >= 4 * np.maximum(self.n, size)) & (self.of != self.component.get(root, -1)))
        same = self.grid[may] == np.frombuffer(s, np.uint16)
        shared = same.sum(axis=1)
        good = np.flatnonzero(shared >= PLAUSIBLE)
        good = good[~same[good].reshape(-1, TREES, DEPTH).all(axis=2)[:, : self.t].any(axis=1)]
        return may[good[np.argsort(-shared[good], kind="stable")]]


def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of every tile that has both sides, from rows sorted by (g, i, j)."""
    key: tuple | None = None
    rows: list[tuple] = []

    def whole() -> bool:
        return any(r[0] for r in rows) and not all(r[0] for r in rows)

    for batch in pieces(batches):
        for g, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (g, i, j) != key:
                if whole():
                    yield key, rows
                key, rows = (g, i, j), []
            rows.append(tuple(row))
    if whole():
        yield key, rows


def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of every asking set with the NEAREST partners of its tile."""
    for _, rows in tiles_of(batches):
        tile = Tile(rows)
        pairs = [(min(row[2], v), max(row[2], v)) for row in tile.asking for v in (tile.asked[k][2] for k in tile.partners(row)[:NEAREST])]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*pairs, strict=True)], ["a", "b"])


def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, i, j, asks, v) of the sets of a tile that have a partner there."""
    for (g, i, j), rows in tiles_of(batches):
        tile, found = Tile(rows), set()
        for row in tile.asking:
            partners = tile.partners(row)
            if len(partners):
                found.add((True, row[2]))
                found.update((False, tile.asked[k][2]) for k in partners)
        if found:
            asks, v = zip(*sorted(found), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(v), pa.int64()), pa.array([i] * len(v), pa.int32()), pa.array([j] * len(v), pa.int32()), pa.array(asks, pa.bool_()), pa.array(v, pa.binary())], ["g", "i", "j", "asks", "v"])


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the flagged sets of a tile, one from each asking set to each component."""
    for _, rows in tiles_of(batches):
        tile, links = Tile(rows), []
        for row in tile.asking:
            met: set[int] = set()
            for k in tile.partners(row):
                other = tile.asked[k]
                if int(tile.of[k]) not in met and linked(row[6], other[6]):
                    met.add(int(tile.of[k]))
                    links.append((min(row[2], other[2]), max(row[2], other[2])))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*links, strict=True)], ["a", "b"])


def spokes(roots: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of (v, root) and their roots, which connect what is connected already."""
    return roots.filter("v <> root").select(F.col("v").alias("a"), F.col("root").alias("b"))


def sorted_tiles(rows: DataFrame) -> DataFrame:
    return rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def classes_of(docs: DataFrame, width: int, prints: bool = False) -> tuple[DataFrame, DataFrame]:
    """(id, v, n) of every row of (id, text), and of every set v that isn't empty (v, rep, root): rep (none, id) is the least of its
    rows by id, rows without one last, and root stands for its component.

    With prints, sets meet by SimHash fingerprints first, in place of neighbours; the forest then finds what lies farther apart.
    """
    rows = store(described(docs, width, prints))
    classes = store(rows.filter("n > 0").groupBy("v").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id")).alias("rep"), F.first("n").alias("n"), F.first("signature").alias("signature"), F.first("fp").alias("fp")))
    found = regions(classes)
    met, ends = meetings(found, neighbours=not prints), found.select("v")
    if prints:
        close = store(fingerprint_pairs(classes))
        met = met.unionByName(close).distinct()
        ends = ends.unionByName(close.select(F.explode(F.array("a", "b")).alias("v")))
    sets = store(sets_of(docs, store(classes.join(ends.distinct(), "v", "left_semi").select("v", F.col("rep.id").alias("id"))), width))
    links = store(verified(met, sets))
    roots = store(connected_components(links))
    tiles = sorted_tiles(open_tiles(found, classes, roots))
    # known components go on as one link from each set to its root, however many links made them
    links = store(verified(tiles.mapInArrow(nearest, "a binary, b binary").distinct(), sets))
    roots = store(connected_components(links.unionByName(spokes(roots))))
    # what is still apart is compared in full, by the sets themselves; only links leave the tasks
    tiles = store(open_tiles(found, classes, roots))
    partners = sorted_tiles(tiles).mapInArrow(flagged, "g long, i int, j int, asks boolean, v binary")
    asking = tiles.join(partners, ["g", "i", "j", "asks", "v"]).join(sets, "v").select(*tiles.columns, "shingles")
    more = store(sorted_tiles(asking).mapInArrow(confirmed, "a binary, b binary"))
    if not more.isEmpty():
        roots = connected_components(more.unionByName(spokes(roots)))
    return rows.drop("signature", "fp"), classes.join(roots, "v", "left").select("v", "rep", F.coalesce("root", "v").alias("root"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component_id, kept) per row: the smallest id reachable by links of a similarity of 0.8 or more.

    Rows of one set are one class and linked; null, empty and wordless texts have no set and are linked with nothing, so each is its own
    component. Rows with a null id link like all others; a component without any id has none. A row is kept if its id is that of its component.
    Repeated rows are reported each, very long texts are compared whole, other columns are not looked at.
    """
    rows, named = classes_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), width)
    best = named.groupBy("root").agg(F.min("rep").alias("best"))
    known = named.join(best, "root").select("v", F.col("best.id").alias("component_id"))
    out = rows.join(known, "v", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
