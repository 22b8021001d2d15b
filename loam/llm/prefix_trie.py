"""Prefix trie of conversations in succinct level order, shard by shard (operator 13).

A conversation is the sequence of its turns; a turn is a label of ``LABEL`` bytes: 16 of the SHA-256 of role and text and four
for its words. Sequences are sorted and dealt in ranges, so a shard holds neighbouring prefixes, and a prefix that any share
of all conversations has in common is split over as many shards as it fills. In a shard, numpy lays the trie out in level order
as a LOUDS bitvector (a node's children in unary) with an array of labels, and totals are added up from the last level to the
first with ``np.add.at``.

Neighbouring shards share the nodes on their borders and nothing else: the upper levels of heavy prefixes, and an end that very
many equal conversations have. Each shard is told the last sequence before it and the first one behind it. By them it
knows which nodes the earlier shards have already counted and which of its ends go on, so all that it says of a shared node
is additive, and shared nodes merge in one small aggregation.

Texts are read once and never shipped. A conversation's labels (20 bytes a turn) and a shard have to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, small_enough, tune

LABEL = 20
#: Conversations of one block share their first one's opening; up to so many turns of it.
BLOCK, MOST_HEAD = 20, 4
SHARD_BYTES = 32 << 20
#: Ids of an end that goes on in other shards travel in pieces of so many.
CHUNK_IDS = 1 << 17
BROADCAST_NODES = 200_000
NOTHING = hashlib.sha256().hexdigest()
WORD = r"[^\x20\x09-\x0D]+"


def labels(conversations: DataFrame) -> DataFrame:
    """conv_id, path: the labels of each conversation's turns by turn (null first), then role and digest.

    Null roles and texts are empty; rows without conv_id belong to no conversation; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)), 1, LABEL - 4)
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD)).cast("long")), 8, "0"))
    turn = F.col("turn").cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(turn.isNotNull().alias("said"), F.coalesce(turn, F.lit(0)).alias("turn"), role.alias("role"), F.concat(digest, words).alias("label")).alias("one")).filter("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("one")).alias("turns")).select("conv_id", F.array_join(F.transform("turns", lambda x: F.hex(x["label"])), "").alias("path")).select("conv_id", F.unhex("path").alias("path"))


def rebuilt(own: DataFrame) -> DataFrame:
    """conv_id, path: each conversation c opens with the first h turns of the first one of its block, c - c % 20 (all if it has
    fewer, none if it is not there), and goes on with its own after its first h; h is crc32 of its decimal id, modulo 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_HEAD).cast("int")
    based = own.select("conv_id", "path", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block"), (h * LABEL).alias("cut"))
    heads = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.substring("path", 1, (MOST_HEAD - 1) * LABEL).alias("head"))
    head = F.coalesce(F.substring(F.col("head"), F.lit(1), F.col("cut")), F.unhex(F.lit("")))
    rest = F.substring(F.col("path"), F.col("cut") + 1, F.greatest(F.length("path") - F.col("cut"), F.lit(0)))
    return based.join(heads, "block", "left").select("conv_id", F.concat(head, rest).alias("path"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many labels two sequences have in common at their start."""
    n = min(len(a), len(b)) // LABEL * LABEL
    x, y = (np.frombuffer(s[:n], np.uint8) for s in (a, b))
    off = np.flatnonzero(x != y)
    return int(off[0] if len(off) else n) // LABEL


class Trie:
    """The trie of sorted distinct sequences, nodes in level order; the root is node 0.

    ``bits``: LOUDS, "10" for a super-root, then for each node a 1 for every child and a 0. ``label``: number of each node's
    label in ``alphabet`` (-1: root). ``level``: first node of each level and the end. ``end``: the node of each sequence.
    """

    def __init__(self, paths: list[bytes]) -> None:
        size = np.array([len(p) // LABEL for p in paths], np.int64)
        flat = np.frombuffer(b"".join(paths), np.dtype((np.void, LABEL)))
        self.alphabet, code = np.unique(flat, return_inverse=True) if len(flat) else (flat, np.zeros(0, np.int64))
        first = np.cumsum(size) - size
        self.common = self._common(code, first, size)
        self.end = np.zeros(len(paths), np.int64)
        level, label, degree = [0, 1], [np.full(1, -1)], []
        at, live, depth = np.zeros(len(paths), np.int64), np.flatnonzero(size > 0), 0
        while len(live):
            depth += 1
            new = self.common[live] < depth
            parents = at[live][new]
            node = level[-1] + np.cumsum(new) - 1
            degree.append(np.bincount(parents - level[-2], minlength=level[-1] - level[-2]))
            label.append(code[first[live][new] + depth - 1])
            level.append(level[-1] + int(new.sum()))
            at[live] = node
            over = size[live] == depth
            self.end[live[over]] = node[over]
            live = live[~over]
        degree.append(np.zeros(level[-1] - level[-2], np.int64))
        self.level, self.label = np.array(level), np.concatenate(label)
        self.bits = self._louds(np.concatenate(degree))

    @staticmethod
    def _common(code: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Labels that each sequence shares with the one before it (the first: -1, so that nothing of it is old)."""
        out = np.full(len(size), -1, np.int64)
        if len(size) < 2:
            return out
        n = np.minimum(size[1:], size[:-1])
        start = np.cumsum(n) - n
        step = np.arange(n.sum()) - np.repeat(start, n)
        differ = code[np.repeat(first[1:], n) + step] != code[np.repeat(first[:-1], n) + step]
        places = np.flatnonzero(differ)
        at = np.searchsorted(places, start)
        hit = np.r_[places, len(differ)][at]
        out[1:] = np.minimum(hit - start, n)
        return out

    @staticmethod
    def _louds(degree: np.ndarray) -> np.ndarray:
        bits = np.ones(2 * len(degree) + 1, bool)  # 2 for the super-root, a 1 for each node but the root, a 0 for each node
        bits[1] = False
        bits[2 + np.cumsum(degree + 1) - 1] = False
        return bits

    def __len__(self) -> int:
        return len(self.label)

    def parent(self) -> np.ndarray:
        """Of each node (root: -1): the zeros before the node's own 1, less the super-root's."""
        return (np.cumsum(~self.bits) - 1)[self.bits]

    def degree(self) -> np.ndarray:
        ends = np.flatnonzero(~self.bits)
        return np.diff(ends) - 1

    def words(self) -> np.ndarray:
        """Words of each node's last turn."""
        raw = np.ascontiguousarray(self.alphabet).view(np.uint8).reshape(-1, LABEL)[:, LABEL - 4 :]
        said = np.ascontiguousarray(raw).view(">u4").reshape(-1).astype(np.int64)
        return np.r_[said, 0][self.label]

    def add_up(self, values: np.ndarray, parent: np.ndarray) -> None:
        """Every node's value becomes the sum over its subtree."""
        for lo, hi in zip(self.level[-2:0:-1].tolist(), self.level[:1:-1].tolist(), strict=True):
            np.add.at(values, parent[lo:hi], values[lo:hi])

    def least(self, values: np.ndarray, parent: np.ndarray) -> None:
        for lo, hi in zip(self.level[-2:0:-1].tolist(), self.level[:1:-1].tolist(), strict=True):
            np.minimum.at(values, parent[lo:hi], values[lo:hi])

    def depth(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.level) - 1), np.diff(self.level))


def way_of(trie: Trie, parent: np.ndarray, node: int) -> list[int]:
    """Nodes from the root to ``node``."""
    out = [node]
    while out[-1]:
        out.append(int(parent[out[-1]]))
    return out[::-1]


def way_keys(path: bytes, n: int) -> list[bytes]:
    """Keys of the prefixes of 0 to n labels."""
    h, out = hashlib.sha256(), []
    for i in range(n + 1):
        h.update(path[LABEL * (i - 1) : LABEL * i] if i else b"")
        out.append(h.digest())
    return out


NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard long, ids binary"
SCHEMA = pa.schema([("key", pa.binary()), ("parent_key", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string()), ("shard", pa.int64()), ("ids", pa.binary())])


def shard_nodes(shard: int, path: list[bytes], conv: np.ndarray, before: bytes | None, behind: bytes | None) -> Iterator[pa.Table]:
    """The nodes of a shard; those that other shards have too carry a key, and their ids follow in pieces.

    ``path``, ``conv``: sorted by both. ``before``, ``behind``: the last sequence of the shard before and the first of the next.
    """
    runs = np.flatnonzero([True, *(a != b for a, b in zip(path, path[1:], strict=False))])
    stops = np.r_[runs[1:], len(path)]
    trie = Trie([path[i] for i in runs.tolist()])
    n, parent, depth, degree, words = len(trie), trie.parent(), trie.depth(), trie.degree(), trie.words()
    old = shared_turns(path[0], before) if before is not None else -1
    on = shared_turns(path[-1], behind) if behind is not None else -1
    head, tail = way_of(trie, parent, int(trie.end[0])), way_of(trie, parent, int(trie.end[-1]))
    counted, shared = np.zeros(n, bool), np.zeros(n, bool)
    counted[head[: old + 1]] = True
    shared[head[: old + 1] + tail[: on + 1]] = True
    leaf = degree == 0
    if behind is not None and behind.startswith(path[-1]):
        leaf[tail[-1]] = False  # its children, or its last occurrence, are in a later shard
    convs, leaves = np.zeros(n, np.int64), leaf.astype(np.int64)
    convs[trie.end] = stops - runs
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, trie.end, conv[runs])
    trie.add_up(convs, parent)
    trie.add_up(leaves, parent)
    trie.least(least, parent)
    saved = (convs - ~counted) * words
    trie.add_up(saved, parent)
    children = degree.astype(np.int64)
    np.subtract.at(children, parent[head[1 : old + 1]], 1)
    ends = np.full(n, NOTHING, object)
    chunks = []
    for node, lo, hi in zip(trie.end.tolist(), runs.tolist(), stops.tolist(), strict=True):
        if shared[node]:
            chunks += [(node, conv[i : min(i + CHUNK_IDS, hi)].tobytes()) for i in range(lo, hi, CHUNK_IDS)]
        else:
            ends[node] = ids_digest([conv[lo:hi]])
    ends[shared] = None
    keys = np.full(n, None, object)
    for way, m, path_ in ((head, old, path[0]), (tail, on, path[-1])):
        keys[way[: m + 1]] = way_keys(path_, m) if m >= 0 else []
    above = np.r_[0, parent[1:]]
    parent_keys = np.where(np.arange(n) > 0, keys[above], None)
    known = (np.arange(n) > 0) & ~shared[above]
    yield pa.Table.from_arrays(
        [pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()), pa.array(least), pa.array(depth.astype(np.int64)), pa.array(least[above], mask=~known), pa.array(convs), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(ends, pa.string()), pa.array(np.full(n, shard)), pa.nulls(n, pa.binary())],
        schema=SCHEMA,
    )
    for node, ids in chunks:
        yield pa.Table.from_pylist([{"key": keys[node], "conv_id": int(np.frombuffer(ids, "<i8")[0]), "shard": shard, "ids": ids}], SCHEMA)


def ids_digest(parts) -> str:
    """SHA-256 of decimal ids, comma-joined; ``parts``: arrays that follow one another."""
    digest, glue = hashlib.sha256(), ""
    for ids in parts:
        if len(ids):
            digest.update((glue + ",".join(map(str, ids.tolist()))).encode())
            glue = ","
    return digest.hexdigest()


def _merged_ends(batches):
    """ends_sha256 of each shared node from its pieces, which come sorted by node, shard and first id."""
    held, digest, out = None, None, []

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.string()), strict=True)], ["key", "ends_sha256"])

    for b in batches:
        for key, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if key != held:
                if held is not None:
                    out.append((held, digest.hexdigest()))
                held, digest, glue = key, hashlib.sha256(), ""
            digest.update((glue + ",".join(map(str, np.frombuffer(ids, "<i8").tolist()))).encode())
            glue = ","
        if len(out) >= 1000:
            yield batch(out)
            out = []
    if held is not None:
        yield batch([*out, (held, digest.hexdigest())])


def sharded(paths: DataFrame) -> DataFrame:
    """shard, path, conv_id, before, behind: sequences in sorted ranges, written once; one row of each shard names its neighbours."""
    spark = paths.sparkSession
    stored = materialize(paths, "paths")
    total = stored.agg(F.sum(F.length("path") + 64).alias("n")).first()["n"] or 0
    n = max(partitions_for(spark), -(-total // SHARD_BYTES))
    ranged = stored.repartitionByRange(n, "path", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    ranged = materialize(ranged, "shards")
    rims = ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.partitionBy(F.lit(0)).orderBy("shard")  # one row for each shard
    rims = rims.select("shard", F.lag("last").over(order).alias("before"), F.lead("first").over(order).alias("behind"))
    none = F.lit(None).cast("binary")
    return ranged.select("shard", "path", "conv_id", none.alias("before"), none.alias("behind")).unionByName(rims.select("shard", none.alias("path"), F.lit(None).cast("long").alias("conv_id"), "before", "behind"))


def _nodes_of(table: pa.Table) -> Iterator[pa.Table]:
    rim = table.filter(pc.is_null(table.column("path")))
    rows = table.filter(pc.is_valid(table.column("path"))).sort_by([("path", "ascending"), ("conv_id", "ascending")])
    shard, before, behind = (rim.column(c).to_pylist()[0] for c in ("shard", "before", "behind"))
    yield from shard_nodes(shard, rows.column("path").to_pylist(), rows.column("conv_id").to_numpy().astype(np.int64), before, behind)


def tries(paths: DataFrame) -> DataFrame:
    """shard, n_nodes, bits, labels, alphabet: the LOUDS trie of each shard, bits packed, labels as little-endian numbers."""

    def run(table: pa.Table) -> pa.Table:
        own = sorted({p for p in table.column("path").to_pylist() if p is not None})
        trie = Trie(own)
        return pa.table({"shard": [table.column("shard")[0].as_py()], "n_nodes": [len(trie)], "bits": [np.packbits(trie.bits).tobytes()], "labels": [trie.label.astype("<i4").tobytes()], "alphabet": [trie.alphabet.tobytes()]}, pa.schema([("shard", pa.int64()), ("n_nodes", pa.int64()), ("bits", pa.binary()), ("labels", pa.binary()), ("alphabet", pa.binary())]))

    return sharded(paths).groupBy("shard").applyInArrow(run, "shard long, n_nodes long, bits binary, labels binary, alphabet binary")


def trie_nodes(paths: DataFrame) -> DataFrame:
    """A row for each node of the trie of ``paths`` (conv_id, path); see ``conversation_trie`` for the columns."""

    def run(table: pa.Table) -> pa.Table:
        return pa.concat_tables(_nodes_of(table))

    tune(paths.sparkSession)
    made = materialize(sharded(paths).groupBy("shard").applyInArrow(run, NODE), "nodes")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    rims = made.filter("key IS NOT NULL AND ids IS NULL").groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *sums)
    pieces = made.filter("ids IS NOT NULL").select("key", "shard", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "shard", "conv_id").select("key", "ids")
    ends = pieces.mapInArrow(_merged_ends, "key binary, ends_sha256 string")
    rims = materialize(rims.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))), "rims")
    names = rims.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    names = F.broadcast(names) if small_enough(names, BROADCAST_NODES) else names
    kept = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = made.filter("key IS NULL AND parent_key IS NOT NULL").drop("parent_conv_id").unionByName(rims, allowMissingColumns=True).join(names, "parent_key", "left").withColumnRenamed("above", "parent_conv_id")
    return made.filter("key IS NULL AND parent_key IS NULL").select(kept).unionByName(below.select(kept))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of
    the prefix trie of the rebuilt conversations.

    The root has depth 0 and no parent. Null roles and texts are empty, null turns come first, ties go by role and digest,
    repeated rows are turns of their own, rows without conv_id belong to no conversation, other columns are not read, and an
    empty table has no node. Texts have any length; words are at most 2^32 in one text.
    """
    tune(conversations.sparkSession)
    return trie_nodes(rebuilt(materialize(labels(conversations), "labels")))
