"""The prefix trie of conversations by a splitter skeleton.

A conversation is a path of turns, a turn 16 bytes made of its role and text, so paths sort as byte strings and conversations with a common beginning
stand next to each other. Splitters, drawn from a bounded sample of paths, cut this order into shards. Only a node on the path of
a splitter can have members in two shards: those nodes are the skeleton, and the splitters, at most ``SPLITTER_TURNS`` turns of each, are
broadcast so that every task knows them. Each shard is sorted and finishes all its other nodes in one walk; for skeleton nodes it sends partial sums,
which a reduction combines and rolls up along the skeleton. A conversation that very many rows repeat is cut between its members.

A turn is read as equal to another when the 128-bit digests of role and text are equal.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.llm.store import written
from pairwright.llm.texts import small_batches

#: Turns of a splitter that tasks know. A group of equal conversations with more turns stays in one shard, where a walk passes them one by one.
SPLITTER_TURNS = 64
#: Turns of a shard, about, and sampled conversations for each shard.
SHARD_TURNS = 200_000
SAMPLED = 20
#: Ids of one row of a node's list.
IDS_TOGETHER = 4096
KEY = 16
WORD = r"[^\x20\x09-\x0D]+"

ROOT = hashlib.md5(b"", usedforsecurity=False).digest()
_NODES = "kind string, node binary, parent binary, depth bigint, words bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, above array<binary>, ids array<bigint>, part int"
_NAMES = [f.strip().split(" ")[0] for f in _NODES.split(", ")]
_ARROW = pa.schema(
    [("kind", pa.string()), ("node", pa.binary()), ("parent", pa.binary())]
    + [(n, pa.int64()) for n in ("depth", "words", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")]
    + [("above", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64())), ("part", pa.int32())]
)


def paths(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, path, words)``: the turns of every conversation as one binary of 16 bytes a turn, and the words of each turn's text.

    Turns are ordered by number (null first), then role, then digest of the text; repeated rows are turns of their own. Null roles and texts
    are empty. Rows with a null id belong to no conversation and are left out; extra columns are not read.
    """
    empty = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(empty(role), F.lit("\0"), empty(text))))
    turns = conversations.where(F.col(f"`{conv_id}`").isNotNull()).select(
        F.col(f"`{conv_id}`").cast("bigint").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"), empty(role).alias("role"), F.md5(empty(text)).alias("digest"), key.alias("key"), F.regexp_count(empty(text), F.lit(WORD)).cast("bigint").alias("words")
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    keys = F.transform("t", lambda t: F.hex(t["key"]))
    return whole.select("conv_id", F.unhex(F.array_join(keys, "")).alias("path"), F.transform("t", lambda t: t["words"]).alias("words"))


def rebuilt(whole: DataFrame, *, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation c with its first h turns replaced by those of conversation c - c % ``group`` (none if absent), where h = crc32(decimal c) % ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = whole.select("conv_id", "path", "words", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.alias("h"))
    firsts = whole.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("base"), F.substring("path", 1, KEY * (heads - 1)).alias("first_path"), F.slice("words", 1, heads - 1).alias("first_words")
    )
    both = own.join(firsts, "base", "left")
    part = lambda c, a, n: F.substring(F.col(c), a, n)
    head = F.coalesce(part("first_path", F.lit(1), KEY * F.col("h")), F.lit(b""))
    tail = part("path", KEY * F.col("h") + 1, F.greatest(F.octet_length("path") - KEY * F.col("h"), F.lit(0)))
    none = F.array().cast("array<bigint>")
    words = F.concat(F.coalesce(F.slice("first_words", F.lit(1), F.col("h")), none), F.when(F.size("words") > F.col("h"), F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(1)))).otherwise(none))
    return both.select("conv_id", F.concat(head, tail).alias("path"), words.alias("words"))


def splitters(table: DataFrame, shards: int, n: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` cuts of the order of paths and ids, sorted, from a sample of about ``SAMPLED`` conversations for each shard."""
    if shards < 2 or not n:
        return []
    wanted = SAMPLED * shards
    some = table.sample(min(1.0, 1.5 * wanted / n), seed=7) if n > wanted else table
    longest = KEY * SPLITTER_TURNS
    drawn = some.select(F.substring("path", 1, longest).alias("path"), F.when(F.octet_length("path") <= longest, F.col("conv_id")).otherwise(-(1 << 63)).alias("conv_id"))
    rows = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn.limit(2 * wanted).collect())  # bounded by the parameters above
    cuts = {rows[k * len(rows) // shards] for k in range(1, shards)} if rows else set()
    return sorted(cuts)


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b)) // KEY
    if a[: n * KEY] == b[: n * KEY]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[: mid * KEY] == b[: mid * KEY]:
            lo = mid
        else:
            hi = mid
    return lo


class _Node:
    __slots__ = ("node", "words", "conv", "n", "children", "leaves", "saved", "kids")

    def __init__(self, node: bytes, words: int):
        self.node, self.words = node, words
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.kids: list[tuple] = []


class _Walk:
    """One shard's conversations in order; rows come out as their nodes end."""

    def __init__(self, part: int):
        self.part, self.out = part, []
        self.path, self.bone = b"", 0
        self.open = [_Node(ROOT, 0)]
        self.ends: list[int] = []

    def _flush(self) -> None:
        if self.ends:
            self.out.append(("ends", self.open[-1].node, None, len(self.open) - 1, *[None] * 8, self.ends, self.part))
            self.ends = []

    def _close(self) -> None:
        depth, node = len(self.open) - 1, self.open.pop()
        up = self.open[-1] if self.open else None
        for kid in node.kids:  # the smallest member is known now
            self.out.append((*kid[:6], node.conv, *kid[7:]))
        if depth <= self.bone or not up:
            above = [x.node for x in self.open]
            self.out.append(("part", node.node, up.node if up else None, depth, node.words, node.conv, None, node.n, node.children, node.leaves, node.saved, above, None, self.part))
        else:
            saved = node.saved + (node.n - 1) * node.words
            leaves = node.leaves or 1
            row = ("node", node.node, up.node, depth, node.words, node.conv, None, node.n, node.children, leaves, saved, None, None, self.part)
            if depth - 1 <= self.bone:
                self.out.append(row)  # its parent is a skeleton node
            else:
                up.kids.append((*row[:2], None, *row[3:]))
            up.children += 1
            up.leaves += leaves
            up.saved += saved
        if up:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)

    def add(self, conv: int, path: bytes, words: list[int], bone: int) -> None:
        """``bone`` is how many turns of the path lie on the skeleton."""
        same = _common(self.path, path) if len(self.open) > 1 or self.path else 0
        if len(path) != len(self.path) or same * KEY != len(path) or len(self.ends) >= IDS_TOGETHER:
            self._flush()
        while len(self.open) - 1 > same:
            self._close()
        self.path, self.bone = path, bone
        for d in range(len(self.open), len(path) // KEY + 1):
            up = self.open[-1].node
            self.open.append(_Node(hashlib.md5(up + path[(d - 1) * KEY : d * KEY], usedforsecurity=False).digest(), words[d - 1]))
        top = self.open[-1]
        top.n += 1
        top.conv = conv if top.conv is None else min(top.conv, conv)
        self.ends.append(conv)

    def finish(self) -> None:
        self._flush()
        while self.open:
            self._close()

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.out)
        made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)
        self.out = []
        return made


def trie(table: DataFrame, shards: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie over ``(conv_id, path, words)``, and the conversations that end at each.

    Nodes: ``(node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens)``. ``node`` is a digest of the path, ``conv_id`` the
    smallest member; the root has depth 0 and no parent. A node saves the words of its last turn for each member but one; ``saved_tokens`` and
    ``n_leaves`` (nodes without children) sum over its subtree. Ends: ``(node, part, ids)``, lists of at most ``IDS_TOGETHER`` ids, which ascend
    within and over the rows of a node. Conversations without turns are members of the root. An empty table has no nodes.
    """
    spark = table.sparkSession
    small_batches(spark)
    table = written(table, "paths")
    seen = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("turns")).first()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["turns"] // SHARD_TURNS))
    cuts = splitters(table, shards, seen["n"])
    shared = spark.sparkContext.broadcast(cuts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [bisect_right(shared.value, key) for key in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["conv_id", "path", "words", "part"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, now = shared.value, None
        for batch in batches:
            for conv, path, words, part in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or part != now.part:
                    if now:
                        now.finish()
                        yield now.batch()
                    now = _Walk(part)
                near = cut[max(0, part - 1) : part + 1]  # the splitters before and behind
                now.add(conv, path, words, max([_common(path, s) for s, _ in near], default=0))
                if len(now.out) >= 20_000:
                    yield now.batch()
        if now:
            now.finish()
            yield now.batch()

    dealt = table.mapInArrow(deal, "conv_id bigint, path binary, words array<bigint>, part int")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "path", "conv_id")
    made = written(dealt.mapInArrow(walk, _NODES), "trie")

    bones = made.where("kind = 'part'").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("conv_id").alias("conv_id"), F.first("above").alias("above"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    joints = bones.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("bones"))
    bones = bones.join(joints, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("bones", F.lit(0)))
    own = bones.select(
        "node", "above", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).alias("leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    sums = own.select(F.explode(F.concat("above", F.array("node"))).alias("node"), "leaves", "saved_tokens").groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    skeleton = written(bones.select("node", "parent", "conv_id", "depth", "n_convs", "n_children").join(sums, "node"), "skeleton")
    parents = F.broadcast(skeleton.select(F.col("node").alias("parent"), F.col("conv_id").alias("known")))  # at most SPLITTER_TURNS nodes for each shard
    local = made.where("kind = 'node'").select("node", "parent", "conv_id", "parent_conv_id", "depth", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))
    nodes = local.unionByName(skeleton, allowMissingColumns=True).join(parents, "parent", "left")
    nodes = nodes.select("node", "conv_id", "depth", F.coalesce("parent_conv_id", "known").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    return nodes, made.where("kind = 'ends'").select("node", "part", "ids")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)``: the digest of each node's ids, comma-joined. A list is hashed row by row and never held whole."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            names, digests = [], []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = ",".join(map(str, ids)).encode()
                if node == at:
                    state.update(b"," + text)
                    continue
                if state:
                    names.append(at)
                    digests.append(state.hexdigest())
                at, state = node, hashlib.sha256(text)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    rows = ends.select("node", "part", F.col("ids")[0].alias("first"), "ids")
    ordered = rows.repartition("node").sortWithinPartitions("node", "part", "first")
    return ordered.select("node", "ids").mapInArrow(digest, "node binary, ends_sha256 string")
