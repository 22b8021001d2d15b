"""N-gram Jaccard join by count-vector R-trees (operator 2).

Each document is its set of distinct word n-grams, as 64-bit hashes. Hashed into ``GROUPS`` groups, the set is a point
of group counts; the overlap of two sets is at most the sum of the coordinate minima of their points, and of any set in
an R-tree node at most the sum of the minima with the node's largest corner. Pairs that survive are verified on the sets.

An R-tree over unrelated documents prunes next to nothing near its root (in 64 dimensions every large node's corner
covers every query), so trees are built inside buckets: two sets over the threshold share one of their first
n - ceil(t n) + 1 members under any common order (rarer members first here), and each such member is a bucket. Links
lose nothing by this. A bucket of at most ``LEAF`` documents is a tree of one leaf. Exact copies are one class with one
representative before anything else.

Components need no pair inside them, so a bucket never gives all its pairs. In each round a document proposes its best
candidates of other components (by the bound), the proposals are verified, and components grow. Buckets whose
candidates were not all proposed go on to the next round; a bucket of many blocks proposes its documents to a few
leaders first. What is left after the last round is verified inside the tasks, block against block, and only links that
join two components come out. So rows grow with the documents, whatever the size of a group.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, release, small_enough, trimmed, tune
from .components import connected_components
from .exchange import BUCKET_KEYS, REQUEST, answers_by_page, keys_in, member, new_page_id, request_batch, requests_of, shared_keys

GROUPS, WIDE, LEAF, BLOCK = 64, 256, 16, 512
#: Candidates that a document proposes in a bucket, by round; later rounds see only buckets with candidates left.
TOPS = (1, 4, 32)
#: Buckets of more than this many pairs of blocks propose leaders in a round, and no more.
MOST_COMBOS, LEADERS = 9, 3
#: Sets beyond this size are first compared by the low 32 bits of their members; an overlap that is less than SURE above
#: the threshold is then counted on whole members.
WHOLE, SURE = 512, 8
#: Rows searched at once in a task.
SEARCH_ROWS = 16_384
PAGE_CHARS = 8 << 20
#: A member found in more than this share of the documents comes last in the order.
COMMON = 0.001
#: Ids beyond this many are joined by a shuffle, up to it by a broadcast.
BROADCAST_IDS = 1_000_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Bytes hashed at once; a longer text is cut into such pieces at white space.
CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
#: The low bytes of a word of eight bytes.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
LONG_WORD = 64


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _C[1]
    h = (h ^ (h >> np.uint64(29))) * _C[2]
    return h ^ (h >> np.uint64(32))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a chunk, A-Z lower-cased, cut at ASCII white space.

    All words advance together, eight bytes a step, each step mixed before the next: for one length and up to eight
    bytes no two words collide, beyond that by chance only. Words over LONG_WORD bytes are hashed one by one.
    """
    raw = raw.lower()
    data = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    left = end - start
    h = _mix(left.astype(np.uint64) * _C[3] + _C[0])
    eight = np.ndarray(len(data) + 1, "<u8", raw + bytes(8), strides=(1,))
    at = np.flatnonzero(left <= LONG_WORD)
    pos, rest = start[at], left[at]
    while len(at):
        h[at] = _mix((h[at] ^ (eight[pos] & _LOW[np.minimum(rest, 8)])) * _C[0])
        more = rest > 8
        at, pos, rest = at[more], pos[more] + 8, rest[more] - 8
    for i in np.flatnonzero(left > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return start, h


def _pieces(raw: bytes):
    """(offset, piece) of about CHUNK bytes, cut after white space."""
    at = 0
    while at < len(raw):
        m = _BLANK.search(raw, at + CHUNK) if len(raw) - at > CHUNK else None
        end = m.end() if m else len(raw)
        yield at, raw[at:end]
        at = end


def _chunk_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    parts = [(at + start, w) for at, piece in _pieces(b" ".join(texts)) for start, w in [word_hashes(piece)]]
    start, w = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(start, np.r_[0, ends])
    h = np.full(max(len(w) - n + 1, 0), n, np.uint64)
    for i in range(n):
        h = _mix(h * _C[0] + w[i : i + len(h)])
    out = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(h[a : b - n + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        else:  # fewer words: the whole sequence is one n-gram
            one = np.full(int(b > a), b - a, np.uint64)
            for i in range(a, b):
                one = _mix(one * _C[0] + w[i])
            out.append(one)
    return out


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words is one n-gram; no words, no n-gram."""
    out, held, size = [], [], 0
    for t in texts:
        held.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(held[-1])
        if size >= CHUNK:
            out += _chunk_sets(held, n)
            held, size = [], 0
    return out + _chunk_sets(held, n) if held else out


def need(n: np.ndarray | int, m: np.ndarray | int, percent: int):
    """Least overlap of sets of sizes n and m at a Jaccard of ``percent``: 100 x >= p (n + m - x)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n + (percent * -n // 100) + 1 if n else 0


def point(s: np.ndarray, groups: int = GROUPS) -> bytes:
    """Counts of a power of two of groups, one byte each unless a group is larger."""
    c = np.bincount((s >> np.uint64(65 - groups.bit_length())).astype(np.int64), minlength=groups)
    return c.astype(np.uint8 if c.max(initial=0) < 256 else "<u4").tobytes()


def points(raws: list[bytes], groups: int) -> np.ndarray:
    if all(len(r) == groups for r in raws):
        return np.frombuffer(b"".join(raws), np.uint8).reshape(len(raws), -1).astype(np.int32)
    return np.stack([np.frombuffer(r, np.uint8 if len(r) == groups else "<u4").astype(np.int32) for r in raws])


class Tree:
    """An R-tree over points: split at the median of the widest coordinate down to LEAF points."""

    def __init__(self, pts: np.ndarray, size: np.ndarray, comp: np.ndarray) -> None:
        self.pts, self.size, self.comp = pts, size, comp
        self.root = self._node(np.arange(len(pts)))

    def _node(self, ix: np.ndarray) -> dict:
        p, c = self.pts[ix], self.comp[ix]
        node = {"top": p.max(axis=0), "least": int(self.size[ix].min()), "most": int(self.size[ix].max()), "comp": int(c[0]) if (c == c[0]).all() else None, "ix": ix, "kids": ()}
        if len(ix) > LEAF:
            spread = np.ptp(p, axis=0)
            order = ix[np.argsort(p[:, spread.argmax()], kind="stable")]
            node["kids"] = (self._node(order[: len(ix) // 2]), self._node(order[len(ix) // 2 :]))
        return node

    def search(self, q: np.ndarray, size: np.ndarray, comp: np.ndarray, percent: int):
        """(query, point) pairs of different components whose bound reaches the threshold."""
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, act = todo.pop()
            n = size[act]
            low = np.maximum(node["least"], -(-percent * n // 100))
            ok = (low * percent <= 100 * n) & (node["most"] * 100 >= percent * n)
            if node["comp"] is not None:
                ok &= comp[act] != node["comp"]
            act, n, low = act[ok], n[ok], low[ok]
            if len(act):
                act = act[np.minimum(q[act], node["top"]).sum(axis=1) >= need(n, low, percent)]
            if not len(act):
                continue
            if node["kids"]:
                todo += [(k, act) for k in node["kids"]]
                continue
            for i in node["ix"]:
                n, m = size[act], self.size[i]
                ok = (comp[act] != self.comp[i]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                hit = act[ok]
                hit = hit[np.minimum(q[hit], self.pts[i]).sum(axis=1) >= need(size[hit], m, percent)]
                if len(hit):
                    yield hit, np.full(len(hit), i)


def common_members(docs: DataFrame, n: int) -> np.ndarray:
    """Members found in more than a share COMMON of all documents, counted over all of them.

    A task reports the members that reach half that share among its own documents, so no task reports more than about
    2 / COMMON times the mean set size, and what the driver gets is bounded in the same way.
    """

    def run(batches):
        held, k, size = [], 0, 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            ok = c >= max(3, COMMON / 2 * k)
            return pa.RecordBatch.from_arrays([pa.array(u[ok].view(np.int64)), pa.array(c[ok].astype(np.int64)), ], ["h", "c"])

        for b in batches:
            for s in shingle_sets(b.column(1).to_pylist(), n):
                held.append(s)
                k, size = k + 1, size + len(s)
                if size > 2_000_000:
                    yield flush()
                    held, k, size = [], 0, 0
        if held:
            yield flush()

    total = docs.count()
    tally = docs.mapInArrow(trimmed(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= max(20, COMMON * total))
    return np.sort(np.array([r["h"] for r in tally.select("h").collect()], np.int64).view(np.uint64))


def _squeeze(**arrays: np.ndarray) -> bytes:
    import io

    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(1).compress(out.getvalue())


def _expand(raw: bytes) -> dict[str, np.ndarray]:
    import io

    return dict(np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(raw))))


def signature_pages(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """page, blob: ids, set sizes, set digests, ordered prefixes and points of a few thousand documents a page."""
    common = docs.sparkSession.sparkContext.broadcast(common_members(docs, n))

    def run(batches):
        late, rows, chars = common.value, [], 0

        def flush():
            sizes = np.array([r[1] for r in rows], np.int64)
            return pa.RecordBatch.from_arrays([pa.array([new_page_id()]), pa.array([_squeeze(
                doc=np.array([r[0] or 0 for r in rows], np.int64), null=np.array([r[0] is None for r in rows]), n=sizes, digest=np.array([r[2] for r in rows], "S32"),
                prefix=np.concatenate([r[3] for r in rows]), k=np.array([len(r[3]) for r in rows], np.int64), wide=np.array([len(r[4]) for r in rows], np.int64), point=np.frombuffer(b"".join(r[4] for r in rows), np.uint8),
            )], pa.binary())], ["page", "blob"])

        for b in batches:
            texts = b.column(1).to_pylist()
            for doc, text, s in zip(b.column(0).to_pylist(), texts, shingle_sets(texts, n), strict=True):
                is_late = member(s, late)
                ordered = np.concatenate([s[~is_late], s[is_late]])[: prefix_size(len(s), percent)]
                rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), _mix(ordered * _C[0]) >> np.uint64(16), point(s)))  # prefixes hold small hashes: spread them over the buckets
                chars += len(text or "")
                if chars > PAGE_CHARS:
                    yield flush()
                    rows, chars = [], 0
        if rows:
            yield flush()

    return materialize(docs.mapInArrow(trimmed(run), "page long, blob binary"), "signatures")


def _members(pages: DataFrame) -> DataFrame:
    """page, at, doc_id, n, digest of every row."""

    def run(batches):
        for b in batches:
            for page, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = _expand(blob)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(x["n"]), page, np.int64)), pa.array(np.arange(len(x["n"]))), pa.array(x["doc"], mask=x["null"]), pa.array(x["n"]), pa.array([d.decode() for d in x["digest"]]),
                ], ["page", "at", "doc_id", "n", "digest"])

    return pages.mapInArrow(run, "page long, at long, doc_id long, n long, digest string")


def _buckets(pages: DataFrame, chosen: DataFrame, total: int, percent: int) -> DataFrame:
    """key, node, n, point for every prefix member that two representatives share. ``chosen``: page, ats."""
    buckets = max(1, -(-total // BUCKET_KEYS))
    rep = pages.join(chosen, "page")

    def picked(blob, ats):
        x = _expand(blob)
        start = np.cumsum(x["k"]) - x["k"]
        at = np.array(sorted(ats), np.int64)
        k = x["k"][at]
        inside = np.repeat(start[at] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        return x, at, x["prefix"][inside], np.repeat(at, k)

    def ask(batches):
        for b in batches:
            for page, blob, ats in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x, _, keys, own = picked(blob, ats)
                yield request_batch(requests_of(page, keys, own, buckets))

    answers = answers_by_page(shared_keys(rep.select("page", "blob", "ats").mapInArrow(ask, REQUEST)))

    def take(batches):
        for b in batches:
            for blob, ats, got in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x, _, keys, own = picked(blob, ats)
                ok = member(keys, keys_in(got))
                keys, own = keys[ok], own[ok]
                ends = np.cumsum(x["wide"])
                raw = x["point"].tobytes()
                pts = {i: raw[ends[i] - x["wide"][i] : ends[i]] for i in np.unique(own).tolist()}
                for lo in range(0, len(own), 100_000):
                    o = own[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo : lo + 100_000].view(np.int64)), pa.array(x["doc"][o]), pa.array(x["n"][o]), pa.array([pts[i] for i in o.tolist()], pa.binary())], ["key", "node", "n", "point"])

    return materialize(rep.join(answers, "page").select("blob", "ats", "answers").mapInArrow(trimmed(take), "key long, node long, n long, point binary"), "buckets")


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each member, in a power of two of at least eight times as many bits."""
    size = 1 << max(9, (8 * len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def bitmap_bound(a: bytes, b: bytes, n: int, m: int) -> int:
    """Most members that two sets of n and m members can share: a bit that the other lacks is a member that it lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) != len(y):  # the larger one folded
        if len(x) > len(y):
            x = x[: len(x) // 2] | x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] | y[len(y) // 2 :]
    return min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))


def short_set(s: np.ndarray) -> bytes:
    return s.tobytes() if len(s) <= WHOLE else np.sort(s.astype(np.uint32)).tobytes()


def shared_members(a: bytes, b: bytes, n: int, m: int) -> tuple[int, bool]:
    """(overlap, whether it is exact) of two short sets; one that is not exact is not below the true overlap."""
    wide = [len(x) == 8 * k for x, k in ((a, n), (b, m))]
    x, y = (np.frombuffer(r, np.uint64 if w else np.uint32) for r, w in ((a, wide[0]), (b, wide[1])))
    if all(wide):
        return int(member(x, y).sum()), True
    x, y = (np.sort(v.astype(np.uint32)) for v in (x, y))
    return min(int(member(x, y).sum()), int(member(y, x).sum())), False


def _with_both(pairs: DataFrame, made: DataFrame, *columns: str) -> DataFrame:
    """a, b and the columns of both documents (x_ of a, y_ of b), each with n. Only what the pairs need of ``made`` is shipped."""
    made = _only(made.select("node", "n", *columns), pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    left, right = (made.select(F.col("node").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("n", *columns)]) for k, p in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", *[f"{p}_{c}" for c in ("n", *columns) for p in "xy"])


def _held(pairs: DataFrame, made: DataFrame, column: str, test) -> DataFrame:
    """a, b, sure: the pairs for whose documents ``test`` (of both values of the column and both sizes) is not None."""

    def run(batches):
        for b in batches:
            a, c, n, m, x, y = (b.column(i).to_pylist() for i in range(6))
            said = [test(p, q, i, j) for p, q, i, j in zip(x, y, n, m, strict=True)]
            at = [k for k, v in enumerate(said) if v is not None]
            yield pa.RecordBatch.from_arrays([pa.array([a[k] for k in at], pa.int64()), pa.array([c[k] for k in at], pa.int64()), pa.array([said[k] for k in at], pa.bool_())], ["a", "b", "sure"])

    out = _with_both(pairs, made, column).mapInArrow(trimmed(run), "a long, b long, sure boolean")
    out = out.groupBy("a", "b").agg(F.max("sure").alias("sure")).checkpoint()
    release(pairs.sparkSession)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold.

    Bounds come first, each on less and more: counts of more groups, then a bitmap of about a byte a member; then the
    members, the long sets' cut to 32 bits, and whole members where that leaves doubt. Each is made again from the texts
    of the documents that are still in question.
    """

    def close(x, y, i, j):
        a, b = points([x], WIDE), points([y], WIDE)
        return True if int(np.minimum(a, b).sum()) >= need(i, j, percent) else None

    def closer(x, y, i, j):
        return True if bitmap_bound(x, y, i, j) >= need(i, j, percent) else None

    def counted(x, y, i, j):
        both, exact = shared_members(x, y, i, j)
        least = max(1, need(i, j, percent))
        return None if both < least else exact or both >= least + SURE

    if pairs.isEmpty():
        return pairs
    ids = lambda p: p.select(F.explode(F.array("a", "b")).alias("node"))
    bounds = materialize(_sets(docs, ids(pairs), n, {"point": lambda s: point(s, WIDE), "bits": bitmap}), "bounds")
    pairs = _held(pairs, bounds, "point", close)
    pairs = _held(pairs, bounds, "bits", closer)
    if pairs.isEmpty():
        return pairs.select("a", "b")
    pairs = _held(pairs, materialize(_sets(docs, ids(pairs), n, {"s": short_set}), "sets"), "s", counted)
    links, doubt = pairs.filter("sure").select("a", "b"), pairs.filter("not sure")
    if doubt.isEmpty():
        return links
    whole = _sets(docs, ids(doubt), n, {"s": lambda s: s.tobytes()})
    return links.unionByName(_held(doubt, whole, "s", counted).select("a", "b")).checkpoint()


def _sorted_runs(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


#: What a row is in its run: all of them meet each other, or queries meet the points of an index block.
BOTH, QUERY, INDEX, INDEX_ONLY = 0, 1, 2, 3
_RUN = "key long, i int, j int, role int, node long, n long, comp long, point binary"


def _whole_runs(batches, columns: int, least: int):
    """Tables of whole runs (equal first ``columns`` columns) of about ``least`` rows or one run."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        ids = np.stack([table.column(i).to_numpy() for i in range(columns)])
        other = np.flatnonzero((ids != ids[:, -1:]).any(axis=0))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:  # all runs but the last one are whole
            yield table.slice(0, cut)
        held, size = table.slice(cut).to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _leaf_candidates(c: dict[str, np.ndarray], pts: np.ndarray, run: np.ndarray, percent: int):
    """(x, y) of the pairs that pass in runs of at most LEAF rows, each a leaf: first the corner, then the points."""
    if not len(run):
        return
    first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    inside = np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1
    top, least, most = np.maximum.reduceat(pts, first), np.minimum.reduceat(c["n"], first), np.maximum.reduceat(c["n"], first)
    n = c["n"]
    low = np.maximum(least[inside], -(-percent * n // 100))
    ok = (low * percent <= 100 * n) & (most[inside] * 100 >= percent * n) & (np.minimum(pts, top[inside]).sum(axis=1) >= need(n, low, percent))
    at = np.flatnonzero(ok)
    run, n, comp, pts = run[at], n[at], c["comp"][at], pts[at]
    for d in range(1, LEAF):
        x = np.flatnonzero(run[d:] == run[:-d])
        if not len(x):
            break
        y = x + d
        ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        ok = np.minimum(pts[x], pts[y]).sum(axis=1) >= need(n[x], n[y], percent)
        yield at[x[ok]], at[y[ok]]


def _tree_candidates(c: dict[str, np.ndarray], pts: np.ndarray, percent: int):
    """(x, y) of the pairs of one run that pass, by a tree over its points (or over those of its index block)."""
    both = c["role"][0] == BOTH
    left = np.arange(len(pts)) if both else np.flatnonzero(c["role"] == QUERY)
    right = left if both else np.flatnonzero(c["role"] >= INDEX)
    if not len(left) or not len(right):
        return
    tree = Tree(pts[right], c["n"][right], c["comp"][right])
    for q, p in tree.search(pts[left], c["n"][left], c["comp"][left], percent):
        x, y = left[q], right[p]
        once = (c["node"][x] < c["node"][y]) | (c["role"][y] == INDEX_ONLY)
        yield x[once], y[once]


def candidates(table: pa.Table, percent: int, groups: int):
    """(columns, run of each row, x, y, score): the pairs of different components in whole runs whose bound reaches the
    threshold; the score is the Jaccard that the bound allows. First those of all leaves, then those of each larger run, so
    no more is held than one run has."""
    names = ["key", "i", "j", "role", "node", "n", "comp"]
    c = {k: table.column(k).to_numpy() for k in names}
    pts = points(table.column("point").to_pylist(), groups)
    new = np.r_[True, (c["key"][1:] != c["key"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])]
    first = np.flatnonzero(new)
    size = np.diff(np.r_[first, len(new)])
    run = np.cumsum(new) - 1

    def scored(found: list):
        x, y = (np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        step = 1 << 20 >> (groups.bit_length() - 1)
        overlap = np.concatenate([np.minimum(pts[x[k : k + step]], pts[y[k : k + step]]).sum(axis=1) for k in range(0, len(x), step)]) if len(x) else np.zeros(0)
        return c, run, x, y, overlap / np.maximum(c["n"][x] + c["n"][y] - overlap, 1)

    leaf = (size <= LEAF) & (c["role"][first] == BOTH)
    at = np.flatnonzero(leaf[run])
    yield scored([(at[x], at[y]) for x, y in _leaf_candidates({k: v[at] for k, v in c.items()}, pts[at], run[at], percent)])
    for f, s in zip(first[~leaf].tolist(), size[~leaf].tolist(), strict=True):
        yield scored([(f + x, f + y) for x, y in _tree_candidates({k: v[f : f + s] for k, v in c.items()}, pts[f : f + s], percent)])


def best_of(run: np.ndarray, a: np.ndarray, b: np.ndarray, score: np.ndarray, top: int) -> np.ndarray:
    """Mask of the pairs that are among the ``top`` best of either side in their run."""
    k = len(a)
    r, u, v, s = np.r_[run, run], np.r_[a, b], np.r_[b, a], np.r_[score, score]
    order = np.lexsort((v, -s, u, r))
    new = np.r_[True, (r[order][1:] != r[order][:-1]) | (u[order][1:] != u[order][:-1])] if k else np.zeros(0, bool)
    first = np.flatnonzero(new)
    rank = np.arange(2 * k) - np.repeat(first, np.diff(np.r_[first, 2 * k]))
    out = np.zeros(k, bool)
    out[order[rank < top] % max(k, 1)] = True
    return out


def _proposals(placed: DataFrame, percent: int, top: int, groups: int) -> DataFrame:
    """a, b: each document's ``top`` best candidates of a run; and key, a: the documents with candidates not proposed."""

    def batch(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, key)], ["a", "b", "key"])

    def run(batches):
        for table in _whole_runs(batches, 3, SEARCH_ROWS):
            for c, runs, x, y, score in candidates(table, percent, groups):
                if not len(x):
                    continue
                a, b = np.minimum(c["node"][x], c["node"][y]), np.maximum(c["node"][x], c["node"][y])
                take = best_of(runs[x], a, b, score, top)
                pairs = np.unique(np.stack([a[take], b[take]]), axis=1)
                yield batch(pairs[0], pairs[1], [None] * pairs.shape[1])
                x, y = x[~take], y[~take]
                left = np.unique(np.stack([np.r_[c["key"][x], c["key"][y]], np.r_[c["node"][x], c["node"][y]]]), axis=1)
                yield batch(left[1], [None] * left.shape[1], left[0])

    return placed.mapInArrow(trimmed(run), "a long, b long, key long")


def _deal(tagged: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """key, i, j, role, node, comp: rows dealt to runs of bounded size. ``sizes``: key, c (rows), q (rows outside the largest
    component), main (that component).

    A bucket of at most ``block`` rows is one run. A larger one is cut into query blocks (rows outside its largest
    component) and index blocks (all rows), and every query block meets every index block.
    """
    live = tagged.select("key", "node", "comp").join(F.broadcast(sizes) if small_enough(sizes, BROADCAST_IDS // 4) else sizes, "key")
    ib, qb = F.ceil(F.col("c") / block).cast("int"), F.ceil(F.col("q") / block).cast("int")
    rest = ["node", "comp"]
    one = live.filter(F.col("c") <= block).select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(BOTH).alias("role"), *rest)
    many = live.filter(F.col("c") > block).withColumn("own_i", F.pmod(F.xxhash64("node"), qb).cast("int")).withColumn("own_j", F.pmod(F.xxhash64("node", F.lit(1)), ib).cast("int"))
    asked = F.col("comp") != F.col("main")
    queries = many.filter(asked).select("key", F.col("own_i").alias("i"), F.explode(F.sequence(F.lit(0), ib - 1)).alias("j"), F.lit(QUERY).alias("role"), *rest)
    index = many.select("key", F.explode(F.sequence(F.lit(0), qb - 1)).alias("i"), F.col("own_j").alias("j"), F.when(asked, INDEX).otherwise(INDEX_ONLY).alias("role"), *rest)
    return one.unionByName(queries).unionByName(index)


def _placed(dealt: DataFrame, info: DataFrame, *more: str) -> DataFrame:
    """Dealt rows with the sizes and points of their documents, each run whole and in one task."""
    return _sorted_runs(dealt.join(info, "node").select("key", "i", "j", "role", "node", "n", "comp", "point", *more), ["key", "i", "j"])


def _mixed(tagged: DataFrame) -> DataFrame:
    """key, c, q, main of the buckets with two components or more."""
    by = tagged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("k"))
    sizes = by.groupBy("key").agg(F.sum("k").alias("c"), F.max(F.struct("k", "comp")).alias("m"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    return sizes.select("key", "c", (F.col("c") - F.col("m.k")).alias("q"), F.col("m.comp").alias("main"))


def _leader_pairs(tagged: DataFrame, keys: DataFrame, salt: int, percent: int, groups: int) -> DataFrame:
    """Each document of the buckets ``keys`` with that of a few leaders of the bucket that the bound likes best.

    The leaders are the first by a hash of the document, so that buckets of one group have the same ones.
    """
    hot = _only(tagged, keys.select("key"))
    seats = [F.min(F.struct(F.xxhash64("node", F.lit(salt * LEADERS + k)).alias("h"), "node", "n", "comp", "point")).alias(f"l{k}") for k in range(LEADERS)]
    lead = hot.groupBy("key").agg(*seats)
    lead = lead.select("key", F.array(*[f"l{k}" for k in range(LEADERS)]).alias("lead"))
    lead = F.broadcast(lead) if small_enough(lead, BROADCAST_IDS // 50) else lead
    both = hot.join(lead, "key").select("node", "n", "comp", "point", "lead")

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            node, n, comp = (b.column(i).to_numpy() for i in range(3))
            pts, best, score = points(b.column(3).to_pylist(), groups), np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            leads = b.column(4).to_pylist()
            for k in range(LEADERS):
                seat = [x[k] for x in leads]
                m, other = np.array([x["n"] for x in seat], np.int64), np.array([x["node"] for x in seat], np.int64)
                overlap = np.minimum(pts, points([x["point"] for x in seat], groups)).sum(axis=1)
                j = overlap / np.maximum(n + m - overlap, 1)
                ok = (overlap >= need(n, m, percent)) & (comp != np.array([x["comp"] for x in seat], np.int64)) & (j > score)
                best[ok], score[ok] = other[ok], j[ok]
            at = np.flatnonzero(best >= 0)
            pairs = np.unique(np.stack([np.minimum(node[at], best[at]), np.maximum(node[at], best[at])]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _forest(placed: DataFrame, percent: int, groups: int) -> DataFrame:
    """a, b: links that join the components of a run; every candidate of two components is held against the sets."""

    def run(batches):
        for table in _whole_runs(batches, 3, 1):
            up: dict[tuple[int, int], tuple[int, int]] = {}

            def root(v):
                while (w := up.get(v, v)) != v:
                    up[v] = up.get(w, w)
                    v = w
                return v

            out = [[], []]
            raws = table.column("s")
            for c, runs, x, y, score in candidates(table, percent, groups):
                for k in np.lexsort((c["node"][y], c["node"][x], -score)).tolist():
                    i, j = int(x[k]), int(y[k])
                    u, v = root((int(runs[i]), int(c["comp"][i]))), root((int(runs[i]), int(c["comp"][j])))
                    if u == v:
                        continue
                    s, t = (np.frombuffer(raws[m].as_py(), np.uint64) for m in (i, j))
                    if int(member(s, t).sum()) >= need(len(s), len(t), percent):
                        up[u] = v
                        out[0].append(int(c["node"][i]))
                        out[1].append(int(c["node"][j]))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b"])

    return placed.mapInArrow(trimmed(run), "a long, b long")


def _tag(rows: DataFrame, comps: DataFrame) -> DataFrame:
    known = comps.select("node", F.col("component").alias("known"))
    known = F.broadcast(known) if small_enough(known, BROADCAST_IDS) else known
    return rows.join(known, "node", "left").withColumn("comp", F.coalesce("known", "node")).drop("known")


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(keys) if small_enough(keys, BROADCAST_IDS) else keys, keys.columns, "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, n: int, columns: dict) -> DataFrame:
    """node, n and ``columns`` (name -> function of the set) of the documents in ``ids`` (node), made from their texts.
    Rows of one doc_id with several texts have a row each."""

    def run(batches):
        for b in batches:
            made = shingle_sets(b.column(1).to_pylist(), n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in made], pa.int64()), *(pa.array([f(s) for s in made], pa.binary()) for f in columns.values())], ["node", "n", *columns])

    return _only(docs, ids.select(F.col("node").alias("doc_id")).distinct()).mapInArrow(trimmed(run), "node long, n long, " + ", ".join(f"{c} binary" for c in columns))


def _links(rows: DataFrame, docs: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """a, b: verified links that connect every component of the representatives. ``rows``: key, node, n, point."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "a long, b long")
    # All are components of their own.
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    hot = sizes.filter(F.col("c") > block).select("key").checkpoint()
    cold = rows.join(F.broadcast(hot) if small_enough(hot, BROADCAST_IDS) else hot, "key", "left_anti")
    placed = _sorted_runs(cold.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(BOTH).alias("role"), "node", "n", F.col("node").alias("comp"), "point"), ["key"])
    live, info, groups = rows.select("key", "node", F.col("node").alias("comp")), None, GROUPS
    links, tried = empty, empty
    for k, top in enumerate(TOPS):
        if k:
            sizes = _mixed(live).checkpoint()
            hot = sizes.filter(F.ceil(F.col("c") / block) * F.ceil(F.col("q") / block) > MOST_COMBOS).select("key")
            placed = _placed(_deal(live, sizes.join(hot, "key", "left_anti"), block), info)
        found = _proposals(placed, percent, top, groups).checkpoint()
        more, left = found.filter("key is null").select("a", "b"), found.filter("key is not null").select("key", F.col("a").alias("node"))
        if not hot.isEmpty():
            asked = rows.withColumn("comp", F.col("node")) if k == 0 else live.join(info, "node")
            more = more.unionByName(_leader_pairs(asked, hot, k, percent, groups))
            left = left.unionByName(_only(live, hot).select("key", "node"))
        more = more.distinct().join(tried, ["a", "b"], "left_anti").checkpoint()
        links, tried = links.unionByName(_verified(more, docs, n, percent)), tried.unionByName(more)
        tagged = _tag(left.distinct(), connected_components(links))
        live = _only(tagged, _mixed(tagged).select("key")).checkpoint()
        release(spark)
        if live.isEmpty():
            return links
        if k == 0:  # few are left, so they get points of more groups
            groups, info = WIDE, materialize(_sets(docs, live, n, {"point": lambda s: point(s, WIDE)}), "points")
    has = _proposals(_placed(_deal(live, _mixed(live), block), info), percent, 0, groups).select("key", F.col("a").alias("node")).distinct().checkpoint()
    if has.isEmpty():
        return links
    live = _only(live, has).checkpoint()
    made = materialize(_sets(docs, live, n, {"point": lambda s: point(s, groups), "s": lambda s: s.tobytes()}), "sets")
    # rows of one doc_id with several texts have several sets: each is a row of its own in the runs
    placed = _placed(_deal(live, _mixed(live), block), made, "s")
    return links.unionByName(_forest(placed, percent, groups).distinct().checkpoint())


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id; one row per input row.

    Documents link when 100 * overlap >= percent * union of their sets of ``n``-word shingles; component_id is the
    smallest doc_id reachable. No words: n_shingles 0 and linked with nothing. A null doc_id has no component and
    links nothing. Rows of one doc_id are one node: what any of its texts links with belongs to it. Columns other than
    doc_id and text are not read. A text of any length is hashed in pieces; its set (8 bytes a distinct n-gram) has to
    fit a task. ``block`` bounds the documents of a bucket that one task compares at once.
    """
    tune(docs.sparkSession)
    plain = documents(docs)
    pages = signature_pages(plain, n, percent)
    members = _members(pages).checkpoint()
    live = members.filter("n > 0 and doc_id is not null")
    classes = live.groupBy("digest").agg(F.min(F.struct("doc_id", "page", "at")).alias("r"), F.max("n").alias("n"))
    chosen = classes.groupBy("r.page").agg(F.collect_list("r.at").alias("ats"))
    total = classes.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)).first()[0] or 0
    rows = _buckets(pages, chosen, int(total), percent)
    links = _links(rows, plain, n, percent, block)
    named = live.select("doc_id", "digest").join(classes.select("digest", F.col("r.doc_id").alias("rep")), "digest").select("doc_id", "rep")
    same = named.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = connected_components(links.unionByName(same))
    out = members.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The input rows, one of each component (the one with the smallest doc_id), with all their columns.

    Rows without words or without doc_id stay; of equal rows of the kept doc_id all stay.
    """
    comps = jaccard_join(docs, n, percent)
    gone = comps.filter("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", F.col("row.doc_id").cast("long"))
    gone = gone.withColumnRenamed("doc_id", "key")
    return tagged.join(F.broadcast(gone) if small_enough(gone, BROADCAST_IDS) else gone, "key", "left_anti").select("row.*")
