"""The trie of conversation prefixes, totals of its subtrees by time-forward processing.

Each conversation is rebuilt: it takes the first h turns of the conversation that begins its hundred, then its own from
h on, with h = crc32(id) % 6. Turns are ordered by `turn`, null first, ties by the digest of role and text. A node is a
distinct sequence of first turns; it is known by the sum, limb by limb, of digests of its (depth, role, text), so the
key of a prefix follows from that of the one before, and a very long conversation may lie in many tasks: sorted ranges
of rows are summed by the tasks and shifted by what lies before them.

Nodes are numbered by their smallest member and depth, so most parents are near their children. A shard is a range of
numbers. In a shard, nodes come in reverse level order from Spark's external sort, and each passes its subtree's totals
to its parent through a priority queue that spills to disk; what goes to parents in other shards is added up and
leaves. These targets form a smaller tree, with an edge to the next target above them, that is solved in the
same way with wider shards. With its totals, shards run once more and every node gets its own.

Rows without a conversation id belong to none and are left out; null roles and texts are empty. Repeated rows are turns
like any other. Very long texts are read once, for their digests and lengths. Other columns are not read. An empty table
gives an empty result; otherwise there is always a root, which has no parent.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.llm import skew
from leadgrid.sources.storage import stored

BLOCK = 100
SHARED = 6
#: nodes in a shard, and how much wider shards of the next tree are
SHARD = 1 << 18
WIDER = 64
#: messages that a queue holds in memory
IN_MEMORY = 1 << 16
#: ids in one piece of a list to be hashed
_IDS = 1 << 14
_LIMB = (1 << 32) - 1
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the one that begins its hundred."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ranged(df: DataFrame, *order: str) -> DataFrame:
    """Rows sorted over all tasks by `order`, which tells rows apart well enough for even ranges."""
    return df.repartitionByRange(_partitions(df), *order).sortWithinPartitions(*order)


def running(df: DataFrame, order: list[str], key: str | None, add: str, name: str) -> DataFrame:
    """Stored `df` with `before` and `upto`: the sums of the binary column `add`, four limbs of 32 bits, over the rows
    of the same `key` that come earlier in `order`, and with this one; wrapping at 64 bits a limb.

    Tasks sum sorted ranges; a key that spans several gets the sums of the earlier ones, a row a range, afterwards.
    """
    fields = [f for f in df.schema if f.name != add]
    at, by = df.columns.index(add), df.columns.index(key) if key else None
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches):
        from pyspark import TaskContext

        part, last, total, first = TaskContext.get().partitionId(), None, 0, None
        for batch in batches:
            keys = batch.column(by).to_pylist() if key else [0] * batch.num_rows
            before, upto, opening = [], [], []
            for k, x in zip(keys, batch.column(at).to_pylist(), strict=True):
                if first is None:
                    first = k
                if k != last:
                    last, total = k, 0
                before.append(total)
                total = _added(total, _limbs(x))
                upto.append(total)
                opening.append(k == first)
            columns = [batch.column(i) for i in range(batch.num_columns) if i != at]
            columns += [pa.array([x.to_bytes(32, "big") for x in c], pa.binary()) for c in (before, upto)]
            columns += [pa.array([part] * len(keys), pa.int32()), pa.array(opening, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in fields), "before", "upto", "_part", "_opening"])

    kinds = schema + ", before binary, upto binary, _part int, _opening boolean"
    return stored(_ranged(df, *order).mapInArrow(run, kinds), name)


def _limbs(data: bytes) -> int:
    """A 16-byte digest as four 64-bit limbs, of 32 bits each."""
    n = int.from_bytes(data, "big")
    return sum(((n >> (32 * i)) & _LIMB) << (64 * i) for i in range(4))


def _added(a: int, b: int) -> int:
    """The sum limb by limb; 2**32 digests fit before a limb wraps, and wrapping takes nothing from its neighbours."""
    out = 0
    for i in range(0, 256, 64):
        out |= ((a >> i) + (b >> i) & 0xFFFFFFFFFFFFFFFF) << i
    return out


def shifted(rows: DataFrame, key: str | None, order: list[str]) -> DataFrame:
    """The result of `running` with sums over ranges: the first key of a range goes on from the ranges before."""
    by = [F.col(key)] if key else [F.lit(0)]
    # of each range: its first and last key, and the sum that the last one leaves
    tail = F.max_by("upto", F.struct(*order)).alias("tail")
    ranges = rows.groupBy("_part").agg(F.min(by[0]).alias("first"), F.max(by[0]).alias("last"), tail)
    carry, opening = (None, 0), []
    for r in sorted(ranges.collect(), key=lambda r: r["_part"]):  # a row a range
        going_on = carry[1] if carry[0] == r["first"] else 0
        if going_on:
            opening.append((r["_part"], going_on.to_bytes(32, "big")))
        tail_sum = int.from_bytes(r["tail"], "big")
        carry = (r["last"], _added(going_on, tail_sum) if r["first"] == r["last"] else tail_sum)
    if not opening:
        return rows.drop("_part", "_opening")
    offsets = rows.sparkSession.createDataFrame(opening, "_part int, _offset binary")

    @F.pandas_udf("binary")
    def plus(a: pd.Series, b: pd.Series) -> pd.Series:
        pairs = zip(a, b, strict=True)
        return pd.Series([_added(int.from_bytes(x, "big"), int.from_bytes(y, "big")).to_bytes(32, "big") for x, y in pairs])

    # one row a range at most
    joined = rows.join(F.broadcast(offsets), "_part", "left")
    moved = joined.filter(F.col("_opening") & F.col("_offset").isNotNull())
    still = joined.filter(~(F.col("_opening") & F.col("_offset").isNotNull()))
    moved = moved.withColumns({"before": plus("before", "_offset"), "upto": plus("upto", "_offset")})
    return still.unionByName(moved).drop("_part", "_opening", "_offset")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, size) of each rebuilt turn, and each conversation's id; size in code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the length keeps role and text apart
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), digest.alias("digest"), F.length(text).cast("bigint").alias("size"),
        F.monotonically_increasing_id().alias("row"), F.unhex(F.lpad(F.lit("1"), 32, "0")).alias("one"),
    ).filter("conv_id IS NOT NULL")
    turns = stored(turns, "prefixes-turns")
    # rows that are alike are told apart by their number, so that they may be split
    order = ["conv_id", "turn", "digest", "row"]
    ranked = shifted(running(turns, order, "conv_id", "one", "prefixes-ranks"), "conv_id", order)
    rank = F.conv(F.hex(F.substring("upto", 25, 8)), 16, 10).cast("bigint")
    ranked = stored(ranked.select("conv_id", rank.alias("rank"), "digest", "size"), "prefixes-ranked")
    ids = ranked.select("conv_id").distinct()
    first = ranked.filter(F.col("rank") < SHARED).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "digest", "size"))).alias("lent")
    )  # under SHARED turns each
    shared = ids.select("conv_id", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    lent = shared.join(first.withColumnRenamed("conv_id", "base").hint("merge"), "base", "left").select(
        "conv_id", "h", F.filter("lent", lambda t: t["rank"] <= F.col("h")).alias("lent")
    )
    lent = stored(lent.withColumn("lent", F.coalesce("lent", F.array().cast(first.schema["lent"].dataType))), "prefixes-lent")
    taken = lent.select("conv_id", F.explode("lent").alias("t")).select("conv_id", F.col("t.rank").alias("depth"), "t.digest", "t.size")
    # one row a conversation meets all its turns: a long one is split
    sizes = ranked.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    moves = stored(lent.join(sizes, "conv_id").select("conv_id", "h", F.size("lent").alias("n"), "turns"), "prefixes-moves")
    own = skew.join_groups(ranked, moves, ["conv_id"], "turns").filter(F.col("rank") > F.col("h"))
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("n")).alias("depth"), "digest", "size")
    return taken.unionByName(own), lent.select("conv_id")


def id_lists(rows: DataFrame) -> DataFrame:
    """(key, ends_sha256): the hash of each key's conversation ids, ascending and comma-joined.

    SHA-256 goes from left to right, so one task writes a key's list, but as a stream of pieces that others have joined.
    """

    def join(batches):
        held, ids = None, []
        for batch in batches:
            for key, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (key != held or len(ids) == _IDS):
                    yield _record(("key", [held], pa.binary()), ("low", [ids[0]], pa.int64()), ("ids", [",".join(map(str, ids))], pa.string()))
                    ids = []
                held = key
                ids.append(i)
        if ids:
            yield _record(("key", [held], pa.binary()), ("low", [ids[0]], pa.int64()), ("ids", [",".join(map(str, ids))], pa.string()))

    def write(batches):
        held, sha = None, None
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != held:
                    if sha:
                        yield _record(("key", [held], pa.binary()), ("ends_sha256", [sha.hexdigest()], pa.string()))
                    held, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if sha:
            yield _record(("key", [held], pa.binary()), ("ends_sha256", [sha.hexdigest()], pa.string()))

    parts = _ranged(rows.select("key", "conv_id"), "key", "conv_id").mapInArrow(join, "key binary, low bigint, ids string")
    parts = stored(parts, "prefixes-ids")
    dealt = parts.repartition(_partitions(rows), "key").sortWithinPartitions("key", "low")
    return dealt.mapInArrow(write, "key binary, ends_sha256 string")


def _record(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for _, v, t in columns], [n for n, _, _ in columns])


class SpillingQueue:
    """A priority queue of tuples, least first, that keeps at most `limit` in memory and the rest in sorted files."""

    def __init__(self, limit: int | None = None):
        self.limit = limit or IN_MEMORY
        self.heap: list[tuple] = []
        self.runs: list[tuple[tuple, int, Iterator[tuple]]] = []
        self.made = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            # the later half goes to a file
            self.heap.sort()
            keep = self.limit // 2
            later, self.heap = self.heap[keep:], self.heap[:keep]
            self._add(self._written(later))

    @staticmethod
    def _written(items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # without a name: gone with the task
        for low in range(0, len(items), 512):
            pickle.dump(items[low : low + 512], file)
        end = file.tell()
        file.seek(0, os.SEEK_SET)

        def read():
            with file:
                while file.tell() < end:
                    yield from pickle.load(file)

        return read()

    def _add(self, run: Iterator[tuple]) -> None:
        first = next(run, None)
        if first is not None:
            self.made += 1
            heapq.heappush(self.runs, (first, self.made, run))

    def pop_if(self, key: tuple) -> tuple | None:
        """The least item, taken out, if it begins with `key`."""
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            item, _, run = self.runs[0]
            if item[: len(key)] != key:
                return None
            heapq.heappop(self.runs)
            self._add(run)
            return item
        if self.heap and self.heap[0][: len(key)] == key:
            return heapq.heappop(self.heap)
        return None


def forward(rows: Iterator[tuple], width: int, whole: bool) -> Iterator[tuple]:
    """Time-forward processing of shards, one after the other.

    Rows are (shard, level, num, parent, parent's level, leaves, saved) in this order, a level being a depth less than
    zero; those with parent -2 bring what a node gets from other shards and come before it. With `whole`, yields (num,
    leaves, saved) of every node's subtree. Else yields (target, next, level, level of next, leaves, saved): for each
    parent in other shards what this one adds to its subtree, next being null, and for each row of parent -2 the target
    next above it, or -1.
    """
    shard = None
    for row in rows:
        if row[0] != shard:
            if shard is not None and not whole:
                yield from _left(out, link, above)
            shard, queue = row[0], SpillingQueue()
            out: dict[int, tuple[int, int, int]] = {}
            # targets that share a path are one set, known by its top; `above` is a set's way out of the shard
            link: dict[int, int] = {}
            above: dict[int, tuple[int, int]] = {}
            brought, label = (0, 0), -1
        _, level, num, parent, up, leaves, saved = row
        if parent == -2:
            brought, label = (leaves, saved), num
            link[num] = num
            continue
        leaves, saved = leaves + brought[0], saved + brought[1]
        while (message := queue.pop_if((level, num))) is not None:
            leaves += message[2]
            saved += message[3]
            if message[4] >= 0:
                top = _top(link, message[4])
                if label >= 0:
                    link[top] = _top(link, label)
                else:
                    label = top
        if whole:
            yield num, leaves, saved
        if parent >= 0 and parent // width == shard:
            queue.push((up, parent, leaves, saved, label))
        elif parent >= 0:
            had = out.get(parent, (up, 0, 0))
            out[parent] = (up, had[1] + leaves, had[2] + saved)
            if label >= 0:
                above[_top(link, label)] = (parent, up)
        brought, label = (0, 0), -1
    if shard is not None and not whole:
        yield from _left(out, link, above)


def _top(link: dict[int, int], label: int) -> int:
    while link[label] != label:
        link[label] = link[link[label]]
        label = link[label]
    return label


def _left(out: dict, link: dict, above: dict) -> Iterator[tuple]:
    for target, (level, leaves, saved) in out.items():
        yield target, None, level, None, leaves, saved
    for target in link:
        parent, up = above.get(_top(link, target), (-1, 1))
        yield target, parent, None, up, 0, 0


_TREE = ["num", "parent", "level", "up", "leaves", "saved"]


def _shards(nodes: DataFrame, brought: DataFrame | None, width: int, whole: bool) -> DataFrame:
    """`forward` over the shards of `nodes`; `brought` has (num, level, leaves, saved) from other shards."""
    rows = nodes.select(*_TREE)
    if brought is not None:
        none = F.lit(None).cast("bigint")
        rows = rows.unionByName(brought.select("num", F.lit(-2).cast("bigint").alias("parent"), "level", none.alias("up"), "leaves", "saved"))
    rows = rows.select(F.floor(F.col("num") / width).cast("bigint").alias("shard"), "level", "num", "parent", "up", "leaves", "saved")
    rows = rows.repartition(_partitions(nodes), "shard").sortWithinPartitions("shard", "level", "num", "parent")
    names = ["num", "leaves", "saved"] if whole else _TREE

    def emit(found):
        return _record(*((n, list(c), pa.int64()) for n, c in zip(names, zip(*found, strict=True), strict=True)))

    def run(batches):
        found = []
        for item in forward((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), width, whole):
            found.append(item)
            if len(found) == 8192:
                yield emit(found)
                found = []
        if found:
            yield emit(found)

    return rows.mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def subtree_totals(nodes: DataFrame, width: int | None = None, wider: int = WIDER) -> DataFrame:
    """(num, leaves, saved) over each node's subtree, from what the nodes have alone.

    `nodes` has num, parent (-1: none), level (less than zero by the depth), up (the parent's level), leaves and saved.
    It is read several times: pass a stored table.
    """
    width = width or SHARD
    apart = nodes.filter((F.col("parent") >= 0) & (F.floor(F.col("parent") / width) != F.floor(F.col("num") / width)))
    if apart.isEmpty():
        return _shards(nodes, None, width, True)
    # nodes with children in other shards, as rows that bring nothing yet
    zero = F.lit(0).cast("bigint")
    targets = apart.groupBy(F.col("parent").alias("num")).agg(F.first("up").alias("level"))
    targets = stored(targets.select("num", "level", zero.alias("leaves"), zero.alias("saved")), "prefixes-targets")
    passed = stored(_shards(nodes, targets, width, False), "prefixes-passed")
    tree = passed.groupBy("num").agg(*(F.max(c).alias(c) for c in ("parent", "level", "up")), *(F.sum(c).alias(c) for c in ("leaves", "saved")))
    tree = stored(tree, "prefixes-tree")
    brought = subtree_totals(tree, width * wider, wider).join(tree.select("num", "level"), "num")
    return _shards(nodes, stored(brought, "prefixes-brought"), width, True)


def trie(conversations: DataFrame, shard: int | None = None) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, ids = rebuilt(conversations)
    depth_digest = F.unhex(F.md5(F.concat(F.col("depth").cast("string").cast("binary"), F.lit(":").cast("binary"), F.col("digest"))))
    turns = turns.select("conv_id", "depth", "size", depth_digest.alias("x"))
    order = ["conv_id", "depth"]
    paths = shifted(running(turns, order, "conv_id", "x", "prefixes-sums"), "conv_id", order)
    root = F.lit(bytes(32))
    paths = stored(paths.select("conv_id", "depth", "size", F.col("before").alias("parent_key"), F.col("upto").alias("key")), "prefixes-paths")
    nodes = paths.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"), F.first("size").alias("size"),
    )
    top = ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        root.alias("key"), F.lit(None).cast("binary").alias("parent_key"), F.lit(0).cast("bigint").alias("depth"), "conv_id", "n_convs",
        F.lit(0).cast("bigint").alias("size"),
    )
    nodes = stored(nodes.unionByName(top), "prefixes-nodes")
    # numbers in order of (conv_id, depth), which tell nodes apart
    one = F.unhex(F.lpad(F.lit("1"), 32, "0")).alias("one")
    numbered = shifted(running(nodes.select("*", one), order, None, "one", "prefixes-numbers"), None, order)
    number = F.conv(F.hex(F.substring("before", 25, 8)), 16, 10).cast("bigint")
    numbered = numbered.select(*nodes.columns, number.alias("num"))
    children = nodes.filter("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    numbered = numbered.join(children.hint("merge"), "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint")))
    numbered = stored(numbered, "prefixes-numbered")
    parents = numbered.filter("n_children > 0").select(
        F.col("key").alias("parent_key"), F.col("num").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of")
    )
    tree = skew.join_groups(numbered.filter("depth > 0"), parents, ["parent_key"], "of").drop("of").unionByName(
        numbered.filter("depth = 0").withColumns({"parent": F.lit(-1).cast("bigint"), "parent_conv_id": F.lit(None).cast("bigint")})
    )
    leaves, saved = (F.col("n_children") == 0).cast("bigint"), (F.col("n_convs") - 1) * F.col("size")
    tree = stored(
        tree.withColumns({"leaves": leaves, "saved": saved, "level": -F.col("depth"), "up": 1 - F.col("depth")}), "prefixes-edges"
    )
    totals = subtree_totals(tree.select(*_TREE), shard)
    totals = stored(totals.select("num", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "prefixes-totals")

    deepest = paths.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key"))
    turnless = ids.join(deepest, "conv_id", "left").select("conv_id", F.coalesce("key", root).alias("key"))
    ends = id_lists(stored(turnless, "prefixes-ends"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    # one row a node on both sides
    return (
        tree.drop("leaves", "saved", "level", "up")
        .join(totals.hint("merge"), "num")
        .join(ends.hint("merge"), "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))
        .select(*_OUT)
    )
