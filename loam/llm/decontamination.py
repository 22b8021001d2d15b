"""Benchmark decontamination over a stored, distributed positional inverted index (operator 10).

Documents are numbered in pages of about ``PAGE_WORDS`` words; a position counts the words of a page, with a gap between
documents so that no phrase crosses them. The index is a table of posting lists (page, bucket, terms, counts, positions),
written once, partitioned by term (the leading bits of its hash are the bucket); a frequent term is split by page. The
lists of the terms that test items use are read from it, met by page, and a window's lists are taken from the rarest term
of the page on: its positions, less its offset in the window, are candidate places, and each next list, shifted by its own
offset, keeps those it holds. What is left are the exact phrase places. Test items come in blocks of at most
``ITEM_BLOCK_WORDS`` words, each a pass over the index and not over the documents.

Terms are 64-bit hashes of words (``ngram_join.word_hashes``): up to eight bytes of one length no two collide, beyond
that by chance only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, shared_dir, small_enough, trimmed, tune
from .ngram_join import new_page_id, word_hashes

WINDOW = 10
ITEM_BLOCK_WORDS = 2_000_000
PAGE_WORDS = 500_000
#: Buckets of terms, and pages whose lists of one bucket are written together.
BUCKET_BITS, FILE_PAGES = 5, 8
BROADCAST_KEYS = 1_000_000

#: Bytes of word characters keep their place (A-Z lower-cased); all other bytes separate words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
INDEX = "page long, bucket int, terms binary, counts binary, positions binary, docs array<long>, uids array<long>, sizes array<int>"


def word_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES)


def words(text: str | None) -> list[bytes]:
    return word_bytes(text).split()


def term_lists(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(terms, words of each text) of texts in word bytes; long ones are hashed in pieces cut at a separator."""
    terms, sizes, held, size = [], [], [], 0

    def flush():
        start, h = word_hashes(b" ".join(held))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in held]))
        terms.append(h)
        sizes.append(np.diff(np.r_[0, ends]))

    for t in texts:
        if len(t) > 1 << 20:  # in pieces; the words add up
            if held:
                flush()
                held, size = [], 0
            at, parts = 0, []
            while at < len(t):
                end = t.find(b" ", at + (1 << 19)) + 1 or len(t)
                parts.append(word_hashes(t[at:end])[1])
                at = end
            terms += parts
            sizes.append(np.array([sum(map(len, parts))]))
            continue
        held.append(t)
        size += len(t)
        if size > 1 << 19:
            flush()
            held, size = [], 0
    if held:
        flush()
    none = np.zeros(0, np.int64)
    return np.concatenate(terms) if terms else none.astype(np.uint64), np.concatenate(sizes) if sizes else none


def shares_of(docs: DataFrame) -> int:
    """Shares of a bucket: one for about ``FILE_PAGES`` pages, so that a frequent term's lists are split as the corpus grows."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return 1 + chars // (6 * PAGE_WORDS * FILE_PAGES)


def write_index(docs: DataFrame, path: str) -> DataFrame:
    """Write the index of ``docs`` (doc_id, text, uid) to ``path`` and return it. Bucket -1 lists each page's documents."""
    most = PAGE_WORDS

    def run(batches):
        rows: list[tuple] = []
        held = 0

        def flush():
            h, sizes = term_lists([r[1] for r in rows])
            position = np.arange(len(h)) + np.repeat(np.arange(len(rows)), sizes)  # a gap after each document
            order = np.argsort(h, kind="stable")
            terms, first, counts = np.unique(h[order], return_index=True, return_counts=True)
            position = position[order].astype("<u4")
            page, ends = new_page_id(), np.r_[first, len(h)]
            out: list[tuple] = [(page, -1, None, None, None, [r[0] for r in rows], [r[2] for r in rows], sizes.tolist())]
            cuts = np.searchsorted(terms >> np.uint64(64 - BUCKET_BITS), np.arange((1 << BUCKET_BITS) + 1))
            for k, (lo, hi) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
                if lo < hi:
                    out.append((page, k, terms[lo:hi].tobytes(), counts[lo:hi].astype("<u4").tobytes(), position[ends[lo] : ends[hi]].tobytes(), None, None, None))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            names = ["page", "bucket", "terms", "counts", "positions", "docs", "uids", "sizes"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for b in batches:
            for doc, text, uid in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = word_bytes(text)
                rows.append((doc, raw, uid))
                held += raw.count(b" ") + 1
                if held >= most:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    made = docs.select("doc_id", "text", "uid").mapInArrow(trimmed(run), INDEX)
    share = F.pmod(F.xxhash64("page"), F.lit(shares_of(docs)))
    made.withColumn("share", share).repartition("bucket", "share").drop("share").write.partitionBy("bucket").option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(INDEX).parquet(path)


class Phrases:
    """Windows of a block of test items as rows of term numbers, grouped by length."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW) -> None:
        h, sizes = term_lists([word_bytes(t) for _, t in items])
        self.terms, numbers = np.unique(h, return_inverse=True)
        self.seqs = np.split(numbers, np.cumsum(sizes)[:-1]) if len(items) else []
        by_size: dict[int, dict[tuple, list[int]]] = {}
        for n, seq in enumerate(self.seqs):
            seq = seq.tolist()
            size = min(window, len(seq))
            for i in range(len(seq) - size + 1) if size else ():
                owners = by_size.setdefault(size, {}).setdefault(tuple(seq[i : i + size]), [])
                if not owners or owners[-1] != n:
                    owners.append(n)
        self.groups = [(size, np.array(list(g), np.int64), list(g.values())) for size, g in by_size.items()]
        self.item_ids = [i for i, _ in items]


class Postings:
    """The lists of the test terms in one page, as one sorted array of (term number, position)."""

    def __init__(self, parts: list[dict], n_terms: int, sizes: np.ndarray) -> None:
        keys = []
        for p in parts:
            ids, counts = np.frombuffer(p["ids"], "<i8"), np.frombuffer(p["counts"], "<u4")
            keys.append(np.repeat(ids, counts) << 32 | np.frombuffer(p["positions"], "<u4").astype(np.int64))
        self.keys = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.keys, np.arange(n_terms + 1, dtype=np.int64) << 32)
        self.count = np.diff(self.first)
        self.starts = np.cumsum(np.r_[0, sizes + 1])[:-1]  # of the page's documents
        self.ends = self.starts + sizes

    def list_of(self, term: int) -> np.ndarray:
        return self.keys[self.first[term] : self.first[term + 1]] & 0xFFFFFFFF

    def phrases(self, group: np.ndarray, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of every exact place; candidates of at most ``most`` positions or one window at a time."""
        df = self.count[group]
        live = np.flatnonzero(df.min(axis=1) > 0)
        order = np.argsort(df[live], axis=1, kind="stable")
        many = np.cumsum(df[live, order[:, 0]])
        cuts = np.searchsorted(many, np.arange(most, (many[-1] if len(many) else 0) + most, most), "right")
        for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
            w, o = live[lo : max(hi, lo)], order[lo : max(hi, lo)]
            if not len(w):
                continue
            n = df[w, o[:, 0]]
            row = np.repeat(np.arange(len(w)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = (self.keys[self.first[group[w, o[:, 0]]][row] + inside] & 0xFFFFFFFF) - o[row, 0]
            for k in range(1, group.shape[1]):  # the next rarer list, less its offset, keeps the places it holds
                off = o[row, k]
                want = (group[w[row], off] << 32) + start + off
                at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
                ok = (start >= 0) & (self.keys[at] == want)
                row, start = row[ok], start[ok]
                if not len(row):
                    break
            if len(row):
                yield w[row], start

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def near(self, terms: list[int], within: int) -> list[int]:
        """Starts of spans of at most ``within`` words of a document that hold all terms, from the rarest term's list on."""
        terms = sorted(set(terms), key=lambda t: self.count[t])
        if not terms or not self.count[terms[0]]:
            return []
        lists, out = [self.list_of(t) for t in terms], set()
        for p in lists[0].tolist():
            k = int(self.doc_of(np.array([p]))[0])
            for lo in range(max(int(self.starts[k]), p - within + 1), p + 1):
                hi = min(lo + within, int(self.ends[k]))
                places = [int(np.searchsorted(x, lo)) for x in lists]
                if all(i < len(x) and x[i] < hi for i, x in zip(places, lists, strict=True)) and any(x[i] == lo for i, x in zip(places, lists, strict=True)):
                    out.add(lo)
        return sorted(out)


def item_blocks(items: DataFrame, most: int = ITEM_BLOCK_WORDS) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in blocks of about ``most`` words, one block on the driver at a time."""
    plain = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = plain.agg(F.sum(F.length("text"))).first()[0] or 0
    n = 1 + chars // (6 * most)
    for k in range(n):
        part = plain.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else plain
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _by_page(index: DataFrame, phrases) -> DataFrame:
    """page, docs, uids, sizes, lists: every page, with the lists of the test terms. ``phrases``: a broadcast of Phrases."""
    terms = phrases.value.terms
    used = sorted({int(x) for x in (terms >> np.uint64(64 - BUCKET_BITS)).tolist()})

    def run(batches):
        among = phrases.value.terms
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for page, raw, counted, places in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own, counts = np.frombuffer(raw, "<u8"), np.frombuffer(counted, "<u4")
                at = np.minimum(np.searchsorted(among, own), len(among) - 1)
                keep = among[at] == own
                if keep.any():
                    positions = np.frombuffer(places, "<u4")[np.repeat(keep, counts)]
                    for c, v in zip(cols, (page, at[keep].astype("<i8").tobytes(), counts[keep].tobytes(), positions.tobytes()), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["page", "ids", "counts", "positions"])

    pages = index.filter("bucket = -1").select("page", "docs", "uids", "sizes")
    lists = index.filter(F.col("bucket").isin(used) if used else F.lit(False)).select("page", "terms", "counts", "positions").mapInArrow(trimmed(run), "page long, ids binary, counts binary, positions binary")
    met = lists.groupBy("page").agg(F.collect_list(F.struct("ids", "counts", "positions")).alias("lists"))  # a row for each bucket at most
    return pages.join(met, "page", "left")


FOUND = "page long, at int, doc_id long, uid long, n_words long, hit binary, found array<long>"


def _marked(index: DataFrame, items: list[tuple[int, str | None]], window: int) -> DataFrame:
    """FOUND: each document of the index with the hit words and the found items of one block."""
    phrases = index.sparkSession.sparkContext.broadcast(Phrases(sorted(set(items), key=repr), window))

    def run(batches):
        p = phrases.value
        for b in batches:
            for page, docs, uids, sizes, lists in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                sizes = np.array(sizes, np.int64)
                index = Postings(lists or [], len(p.terms), sizes)
                hit, found = np.zeros(int(sizes.sum()) + len(sizes) + 1, np.int32), [set() for _ in docs]
                for size, group, owners in p.groups if lists else ():
                    for w, start in index.phrases(group):
                        np.add.at(hit, start, 1)
                        np.add.at(hit, start + size, -1)
                        for d, k in np.unique(np.stack([index.doc_of(start), w], axis=1), axis=0).tolist():
                            found[d].update(owners[k])
                covered = np.cumsum(hit) > 0
                hits = [np.flatnonzero(covered[s:e]).astype("<i4").tobytes() if f else b"" for s, e, f in zip(index.starts.tolist(), index.ends.tolist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([page] * len(docs), pa.int64()), pa.array(range(len(docs)), pa.int32()), pa.array(docs, pa.int64()), pa.array(uids, pa.int64()), pa.array(sizes),
                    pa.array(hits, pa.binary()), pa.array([[p.item_ids[i] for i in sorted(f)] for f in found], pa.list_(pa.int64())),
                ], ["page", "at", "doc_id", "uid", "n_words", "hit", "found"])

    return _by_page(index, phrases).select("page", "docs", "uids", "sizes", "lists").mapInArrow(trimmed(run), FOUND)


def _indexed(docs: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_dir(docs.sparkSession)}/loam/index-{uuid.uuid4().hex}"
    return write_index(documents(docs).withColumn("uid", F.xxhash64("text")), path), path


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; one row per input row.

    Null and empty texts have no words; items without words match nothing; a null item_id is skipped in the digest and
    counted; the same text under two item_ids counts for both, a repeated item row once. No items: nothing is hit; no
    documents: no rows. Repeated and null doc_ids are rows of their own, with any number of item blocks: a row is its
    place in the index. A text of any length is one document of a page. Other columns are not read.
    """
    tune(docs.sparkSession)
    index, path = _indexed(docs)
    out = _report(index, items, window).checkpoint()
    discard(docs.sparkSession, path)
    return out.drop("uid")


def _report(index: DataFrame, items: DataFrame, window: int) -> DataFrame:
    parts = [_marked(index, block, window) for block in item_blocks(items)]
    out = parts[0].select("doc_id", "uid", "n_words", F.array("hit").alias("hits"), "found")
    if len(parts) > 1:
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        same = [F.first(c).alias(c) for c in ("doc_id", "uid", "n_words")]
        out = both.groupBy("page", "at").agg(*same, F.collect_list("hit").alias("hits"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")).drop("page", "at")

    def run(batches):
        for b in batches:
            docs, uids, n_words, many, found = (b.column(i).to_pylist() for i in range(5))
            said = [",".join(sorted({str(i) for i in f if i is not None})) for f in found]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs, pa.int64()), pa.array(uids, pa.int64()), pa.array(n_words, pa.int64()),
                pa.array([len(np.unique(np.concatenate([np.frombuffer(h, "<i4") for h in hs]))) for hs in many], pa.int64()),
                pa.array([len(set(f)) for f in found], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in said]),
            ], ["doc_id", "uid", "n_words", "n_hit", "n_items", "items_sha256"])

    digests = out.select("doc_id", "uid", "n_words", "hits", "found").mapInArrow(run, "doc_id long, uid long, n_words long, n_hit long, n_items long, items_sha256 string")
    return digests.withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The input rows without any hit, with all their columns; rows without text stay, with or without a doc_id.

    Rows are known by doc_id and a hash of their text, so equal rows share their fate.
    """
    tune(docs.sparkSession)
    index, path = _indexed(docs)
    bad = _report(index, items, window).filter("contaminated").select(F.col("doc_id").alias("_doc"), F.col("uid").alias("_uid")).distinct().checkpoint()
    discard(docs.sparkSession, path)
    bad = F.broadcast(bad) if small_enough(bad, BROADCAST_KEYS) else bad
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col("row.text").cast("string")) == F.col("_uid"))
    return row.join(bad, same, "left_anti").select("row.*")


def proximity(docs: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """doc_id, item_id, start: spans of at most ``within`` words that hold all the words of an item, for items of at most
    ``within`` distinct words. Rows as in ``contamination``; items without words have no span."""
    tune(docs.sparkSession)
    index, path = _indexed(docs)
    out = None
    for block in item_blocks(items):
        phrases = docs.sparkSession.sparkContext.broadcast(Phrases(block, within))

        def run(batches, phrases=phrases):
            p = phrases.value
            wanted = [(i, s.tolist()) for i, s in zip(p.item_ids, p.seqs, strict=True) if 0 < len(set(s.tolist())) <= within]
            for b in batches:
                for docs, sizes, lists in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    page = Postings(lists or [], len(p.terms), np.array(sizes, np.int64))
                    found = [(i, at) for i, terms in wanted for at in page.near(terms, within)] if lists else []
                    rows = [(docs[k], i, at - int(page.starts[k])) for i, at in found for k in [int(page.doc_of(np.array([at]))[0])]]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "item_id", "start"])

        found = _by_page(index, phrases).select("docs", "sizes", "lists").mapInArrow(run, "doc_id long, item_id long, start long")
        out = found if out is None else out.unionByName(found)
    out = out.checkpoint()
    discard(docs.sparkSession, path)
    return out
