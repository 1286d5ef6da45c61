"""Prefix trie of conversations, its subtree totals by time-forward processing.

A node is known by its depth and by two 64-bit sums (exclusive or) of hashes of its turns with their places, so no
sequence is ever gathered. Every node gets a weight, the rows of its members from there on; nodes above the limit are few on every level.
What hangs below them is a shard: a subtree of at most the limit's rows. Shards are dealt to tasks, sorted by reverse level order, and read
once: a node takes what its children have left for it in a priority queue and leaves its totals for its parent. The heavy nodes follow, in bands of
levels, with the totals of the shard roots as what they start from.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioq.llm.common import store

#: Conversations that share a leader, and the bound of the turns that they take from it (fixed values of the contract).
FAMILY, TAKEN = 20, 4
#: Turns that are numbered in one window; a longer conversation takes several windows.
SPAN = 4_096
#: Messages that a queue holds in memory before it spills them as a sorted run.
HELD = 200_000
#: Heavy nodes of one band, and of a broadcast (28 bytes each).
BAND, BROADCAST = 100_000, 1_000_000
#: Ids in a piece of text to hash.
PIECE = 4_096
#: A shard is at most 1 / EVEN of an even share of a task, but LEAST rows.
EVEN, LEAST = 8, 64
KEY = ["depth", "x1", "x2"]
WORDS = "[^\\x20\\x09-\\x0D]+"


def running(rows: DataFrame, place: Column, order: list[Column], **sums: tuple[Column, str]) -> DataFrame:
    """Running totals within a conversation `c` along `order`, `place` being a number that never falls along it.

    sums: name = (value, "sum" or "bit_xor"). Windows hold SPAN places; what lies before a window is added by a join with the windows' totals.
    """
    placed = rows.withColumn("span", F.coalesce(F.floor(place / SPAN), F.lit(-(1 << 62)))).withColumns({f"{k}_of": v for k, (v, _) in sums.items()})
    inside = Window.partitionBy("c", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("c", "span").agg(*[F.expr(f"{f}({k}_of)").alias(f"{k}_of") for k, (_, f) in sums.items()])
    offsets = totals.select("c", "span", *[F.expr(f"{f}({k}_of)").over(before).alias(f"{k}_before") for k, (_, f) in sums.items()]).filter(" OR ".join(f"{k}_before IS NOT NULL" for k in sums))
    local = placed.withColumns({k: F.expr(f"{f}({k}_of)").over(inside) for k, (_, f) in sums.items()}).drop(*[f"{k}_of" for k in sums])
    joined = local.join(offsets, ["c", "span"], "left")
    whole = {k: F.col(k).bitwiseXOR(F.coalesce(f"{k}_before", F.lit(0))) if f == "bit_xor" else F.col(k) + F.coalesce(f"{k}_before", F.lit(0)) for k, (_, f) in sums.items()}
    return joined.withColumns(whole).drop("span", *[f"{k}_before" for k in sums])


def taken(c: Column) -> Column:
    """Turns of the leader that a conversation begins with."""
    return (F.crc32(c.cast("string").cast("binary")) % TAKEN).cast("int")


def members(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, depth, x1, x2, p1, p2, words, n) of every turn of every rebuilt conversation, and of its root: the node, its parent's sums, the turns of c."""
    given = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit("")).alias(k) for x, k in ((role_col, "role"), (text_col, "text"))))
    turns = given.filter("c is not null").select("c", "turn", F.xxhash64(F.lit(1), "role", "text").alias("k1"), F.xxhash64(F.lit(2), "text", "role").alias("k2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"), "role", "text")
    ranked = running(turns, F.col("turn"), [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], i=(F.lit(1).cast("long"), "sum"))
    own = store(ranked.select("c", (F.col("i") - 1).alias("i"), "k1", "k2", "words"))
    leaders = own.filter((F.col("c") % FAMILY == 0) & (F.col("i") < TAKEN - 1)).groupBy(F.col("c").alias("lead")).agg(F.sort_array(F.collect_list(F.struct("i", "k1", "k2", "words"))).alias("first"))
    heads = own.groupBy("c").agg(F.count("*").alias("own_n")).withColumn("lead", F.col("c") - F.col("c") % FAMILY).join(leaders, "lead", "left")
    heads = heads.select("c", "own_n", taken(F.col("c")).alias("h"), F.coalesce(F.slice("first", 1, taken(F.col("c"))), F.array().cast("array<struct<i:bigint,k1:bigint,k2:bigint,words:bigint>>")).alias("first"))
    heads = store(heads.withColumn("n", F.size("first") + F.greatest(F.col("own_n") - F.col("h"), F.lit(0))))
    head = heads.select("c", "n", F.explode("first").alias("t")).select("c", "n", F.col("t.i").alias("p"), "t.k1", "t.k2", "t.words")
    tail = own.join(heads.select("c", "n", "h", F.size("first").alias("from")), "c").filter(F.col("i") >= F.col("h")).select("c", "n", (F.col("from") + F.col("i") - F.col("h")).alias("p"), "k1", "k2", "words")
    rows = head.unionByName(tail).withColumn("g1", F.xxhash64(F.lit(3), "p", "k1", "k2")).withColumn("g2", F.xxhash64(F.lit(4), "p", "k2", "k1"))
    summed = running(rows, F.col("p"), [F.col("p")], x1=(F.col("g1"), "bit_xor"), x2=(F.col("g2"), "bit_xor"))
    nodes = summed.select("c", (F.col("p") + 1).alias("depth"), "x1", "x2", F.col("x1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("g2")).alias("p2"), "words", "n")
    zero = F.lit(0).cast("long")
    return nodes.unionByName(heads.select("c", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("p1"), zero.alias("p2"), zero.alias("words"), F.col("n").cast("long")))


class SpillingQueue:
    """A priority queue of tuples of integers; beyond `held` entries it goes on in sorted runs, in unnamed files that end with the task."""

    def __init__(self, width: int, held: int = HELD) -> None:
        self.entry, self.held = struct.Struct(f"<{width}q"), held
        self.heap: list[tuple[int, ...]] = []
        self.heads: list[tuple[tuple[int, ...], int]] = []
        self.runs: list[Iterator[tuple[int, ...]]] = []

    def push(self, entry: tuple[int, ...]) -> None:
        heapq.heappush(self.heap, entry)
        if len(self.heap) > self.held:
            self.spill()

    def spill(self) -> None:
        file = tempfile.TemporaryFile()
        for entry in sorted(self.heap):
            file.write(self.entry.pack(*entry))
        self.heap = []
        file.seek(0)
        self.runs.append(self.read(file))
        self.advance(len(self.runs) - 1)

    def read(self, file) -> Iterator[tuple[int, ...]]:
        with file:
            while block := file.read(self.entry.size * 1_024):
                yield from self.entry.iter_unpack(block)

    def advance(self, run: int) -> None:
        entry = next(self.runs[run], None)
        if entry is not None:
            heapq.heappush(self.heads, (entry, run))

    def least(self) -> tuple[int, ...] | None:
        return min((x for x in (self.heap[0] if self.heap else None, self.heads[0][0] if self.heads else None) if x is not None), default=None)

    def pop(self) -> tuple[int, ...]:
        if self.heads and (not self.heap or self.heads[0][0] < self.heap[0]):
            entry, run = heapq.heappop(self.heads)
            self.advance(run)
            return entry
        return heapq.heappop(self.heap)


#: What a pass over nodes reads, and what it says of each.
PASS = ["depth", "x1", "x2", "p1", "p2", "own", "children", "leaves", "saved", "stop"]
TOTALS = "depth long, x1 long, x2 long, p1 long, p2 long, stop long, children long, leaves long, saved long"


def time_forward(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that come in reverse level order; children, leaves and saved hold what other tasks found below a node.

    A node with stop = 1 leaves nothing for its parent, which another task has.
    """
    queue = SpillingQueue(5, held)
    for batch in batches:
        rows = []
        for depth, x1, x2, p1, p2, own, children, leaves, saved, stop in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            saved += own
            while (first := queue.least()) is not None and first[:3] == (-depth, x1, x2):
                *_, more, kept = queue.pop()
                children, leaves, saved = children + 1, leaves + more, saved + kept
            leaves = leaves if children else 1
            if not stop:
                queue.push((1 - depth, p1, p2, leaves, saved))
            rows.append((depth, x1, x2, p1, p2, stop, children, leaves, saved))
        names = [f.split()[0] for f in TOTALS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(names))], names)


def upwards(totals: DataFrame) -> DataFrame:
    """What the nodes with stop = 1 mean for their parents: (depth, x1, x2, children, leaves, saved) of the parent."""
    up = totals.filter("stop = 1 and depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.lit(1).cast("long").alias("children"), "leaves", "saved")
    return up.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of every node at which members end.

    Ids are joined piece by piece where they lie after a range partitioning by node and id; a node's pieces are then hashed in order, so
    a node with very many ids costs one task a stream of text and no memory.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (*node, ids[0])), pa.array([",".join(map(str, ids))], pa.string())], [*KEY, "first", "ids"])

        for batch in batches:
            for depth, x1, x2, c in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if node is not None and (node != (depth, x1, x2) or len(ids) == PIECE):
                    yield out()
                    ids = []
                node = depth, x1, x2
                ids.append(c)
        if ids:
            yield out()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            done = []
            for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key == node:
                    sha.update(f",{ids}".encode())
                    continue
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(ids.encode())
            if done:
                yield told(done)
        if node is not None:
            yield told([(*node, sha.hexdigest())])

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])

    key = "depth long, x1 long, x2 long"
    packed = rows.filter("depth = n").select(*KEY, "c").repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(pack, f"{key}, first long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard: int | None = None) -> DataFrame:
    """A row for every node of the trie of rebuilt conversations: smallest member, depth, parent, counts and totals of the subtree.

    Rows without a conversation id belong to none and are left out. Turns without a number come first; turns of one number follow by role
    and text, repeated rows each being a turn. Null roles and texts are empty. Texts are hashed whole, however long they are, and
    conversations may be of any length. An empty table has no node. Other columns are not looked at. `shard`: rows of a shard at most; by default it follows from
    the rows and spark.sql.shuffle.partitions.
    """
    spark = conversations.sparkSession
    rows = store(members(conversations, conv_col, turn_col, role_col, text_col))
    nodes = store(
        rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("words").alias("words"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"))
    )
    all_rows = rows.count()
    limit = shard or max(LEAST, all_rows // (EVEN * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    heavy = store(nodes.filter(F.col("weight") > limit))
    n_heavy, deepest = heavy.agg(F.count("*"), F.max("depth")).first()
    flags = heavy.select(*KEY, F.lit(True).alias("heavy"))
    flags = F.broadcast(flags) if n_heavy <= BROADCAST else flags
    # the first light node of a conversation's path is the root of the shard that the rest of the path lies in
    shallow = rows.filter(F.col("depth") <= (deepest or 0) + 1).select("c", *KEY).join(flags, KEY, "left")
    roots = shallow.filter("heavy is null").groupBy(F.col("c").alias("conv_id")).agg(F.min(F.struct(*KEY)).alias("top"))
    columns = [*KEY, "p1", "p2", ((F.col("n_convs") - 1) * F.col("words")).alias("own")]
    nothing = [F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")]
    light = nodes.filter(F.col("weight") <= limit).join(roots, "conv_id").select(*columns, *nothing, (F.col("depth") == F.col("top.depth")).cast("long").alias("stop"), F.xxhash64("top.depth", "top.x1", "top.x2").alias("shard"))
    sorted_shards = light.repartition("shard").sortWithinPartitions(F.desc("depth"), "x1", "x2").select(*PASS)
    totals = [store(sorted_shards.mapInArrow(time_forward, TOTALS))]
    # across the shard roots: bands of heavy levels from the deepest one on, each with what lies below it
    below = upwards(totals[0])
    if n_heavy:
        widest = heavy.groupBy("depth").count().agg(F.max("count")).first()[0]
        levels = max(1, BAND // widest)
        for last in range(deepest, -1, -levels):
            first = max(0, last - levels + 1)
            band = heavy.filter(F.col("depth").between(first, last)).select(*columns).join(below, KEY, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("children", "leaves", "saved")})
            band = band.withColumn("stop", (F.col("depth") == first).cast("long")).select(*PASS)
            totals.append(store(band.repartition(1).sortWithinPartitions(F.desc("depth"), "x1", "x2").mapInArrow(time_forward, TOTALS)))
            below = upwards(totals[0].unionByName(totals[-1]))
    known = totals[0]
    for t in totals[1:]:
        known = known.unionByName(t)
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.select(*KEY, "p1", "p2", "n_convs", "conv_id").join(known.select(*KEY, "children", "leaves", "saved"), KEY).join(ends(rows), KEY, "left")
    named = told.join(up, ["depth", "p1", "p2"], "left")
    return named.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
