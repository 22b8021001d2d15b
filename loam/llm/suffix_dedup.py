"""Repeated substrings by a depth-limited radix sort of suffixes (operator 3).

Only windows of ``threshold`` bytes matter, so suffixes are ordered through that depth and no further: groups of equal
rank after the last pass are exactly the repeated windows, and a group's smallest doc_id decides. Most significant
digit first:

* First digit: each window's anchor, the hash of the 16-byte string that is smallest in it, with the 17 bytes on its left
  or on its right, one of which a window holds whole. Equal windows have equal anchors at equal offsets, and so the same
  side. A page of documents asks about its distinct sides; those that no second document holds end here, with all their
  windows. The anchor alone keeps more, as 16 bytes recur by chance more often than 33.
* Windows that survive travel with their anchor: one context of at most ``2 * threshold - 16`` bytes for all windows of
  an anchor, equal contexts of a page once. Contexts are dealt by anchor, so a bucket holds all equal windows.
* Inside a bucket: equal contexts are one group; where an anchor has several, its windows are refined by digits of
  eight bytes, and a group of one drops out after each pass.

Exact copies are settled by their digest beforehand; one document of each class takes part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, rows_of, tune
from .exchange import REQUEST, answers_by_page, bucket_of, keys_in, member, new_page_id, request_batch, requests_of, shared_keys
from .ngram_join import _expand, _squeeze

THRESHOLD, GRAM = 50, 16
PAGE_BYTES, CHUNK = 8 << 20, 1 << 19
#: Text whose anchors share a bucket, and windows refined at once; both bound a worker's memory.
BUCKET_BYTES, SLICE_WINDOWS = 12 << 20, 300_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def text_pages(docs: DataFrame, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """page, blob: doc_ids, lengths and UTF-8 bytes of documents, some ``page_bytes`` a page (one document more at most)."""

    def run(batches):
        rows, size = [], 0

        def flush():
            blob = _squeeze(
                doc=np.array([d or 0 for d, _ in rows], np.int64), null=np.array([d is None for d, _ in rows]), size=np.array([len(t) for _, t in rows], np.int64), raw=np.frombuffer(b"".join(t for _, t in rows), np.uint8)
            )
            return pa.RecordBatch.from_arrays([pa.array([new_page_id()]), pa.array([blob], pa.binary())], ["page", "blob"])

        for doc, text in rows_of(batches):
            rows.append((doc, (text or "").encode("utf-8", "surrogatepass")))
            size += len(rows[-1][1])
            if size > page_bytes:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    return materialize(docs.mapInArrow(run, "page long, blob binary"), "pages")


def chunks(x: dict[str, np.ndarray], at: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, starts, limits): chunks of whole documents of about CHUNK bytes; a longer document in overlapping pieces.

    Yields the positions in the page's bytes where a piece begins and ends, as two arrays.
    """
    ends = np.cumsum(x["size"])
    begins = ends - x["size"]
    held_b, held_e, size = [], [], 0
    for i in at.tolist():
        b, e = int(begins[i]), int(ends[i])
        while e - b >= threshold:
            piece = min(e, b + CHUNK)
            held_b.append(b)
            held_e.append(piece)
            size += piece - b
            if size >= CHUNK:
                yield np.array(held_b), np.array(held_e)
                held_b, held_e, size = [], [], 0
            if piece == e:
                break
            b = piece - threshold + 1
    if held_b:
        yield np.array(held_b), np.array(held_e)


def anchors(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """(key, position, first start, last start) in page coordinates: every anchor with the run of windows it stands for."""
    width = threshold - GRAM + 1
    data = np.concatenate([raw[b:e] for b, e in zip(begins, ends, strict=True)]).astype(np.uint64)
    sizes = ends - begins
    local = np.cumsum(sizes) - sizes
    g = (data[:-1] << np.uint64(8)) | data[1:]
    g = (g[:-2] << np.uint64(16)) | g[2:]
    g = (g[:-4] << np.uint64(32)) | g[4:]
    h = g[:-8] * _A ^ (g[8:] * _B >> np.uint64(3))
    h = (h ^ (h >> np.uint64(29))) * _C
    h ^= h >> np.uint64(32)
    n = len(h)
    v = (h >> np.uint64(24) << np.uint64(24)) | (np.uint64((1 << 24) - 1) - np.arange(n, dtype=np.uint64))
    size = 1
    while 2 * size <= width:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < width:
        v = np.minimum(v[: len(v) - (width - size)], v[width - size :])
    owner = ((1 << 24) - 1) - (v & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(owner) + threshold, bool)
    for b, s in zip(local, sizes, strict=True):
        valid[b : b + s - threshold + 1] = True
    start = np.flatnonzero(valid[: len(owner)])
    own = owner[start]
    new = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(own)] - 1
    piece = np.searchsorted(local, start[new], "right") - 1
    shift = begins[piece] - local[piece]
    key = (h[own[new]] ^ (h[own[new]] >> np.uint64(31))) * _B  # selected hashes are small ones: spread them over the buckets
    return (key ^ (key >> np.uint64(30))) * _A >> np.uint64(16), own[new] + shift, start[new] + shift, start[last] + shift


def page_anchors(x: dict[str, np.ndarray], at: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    parts = [anchors(x["raw"], b, e, threshold) for b, e in chunks(x, at, threshold)]
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def sides(raw: np.ndarray, found: tuple[np.ndarray, ...], threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, which, split): keys of the anchors with the bytes on their left, then with those on their right, where some window holds
    them; ``which`` anchor each is of; the last ``split`` of the run's windows that holds the left side whole. Later ones hold the right."""
    key, pos, lo, hi = found
    wide = (threshold - GRAM) // 2
    split = pos - wide
    left, right = np.flatnonzero(lo <= split), np.flatnonzero(hi > split)

    def mixed(at: np.ndarray, begin: np.ndarray, salt: np.uint64) -> np.ndarray:
        h = key[at] ^ salt
        for i in range(wide):
            h = (h ^ raw[begin + i]) * _B
            h ^= h >> np.uint64(29)
        return (h * _A) >> np.uint64(16)

    keys = np.concatenate([mixed(left, pos[left] - wide, _A), mixed(right, pos[right] + GRAM, _C)])
    return keys, np.concatenate([left, right]), split


def repeated(raw: np.ndarray, found: tuple[np.ndarray, ...], shared: np.ndarray, threshold: int) -> tuple[np.ndarray, ...]:
    """``found`` without the windows whose side no second document holds."""
    key, pos, lo, hi = found
    keys, which, split = sides(raw, found, threshold)
    hit, n = member(keys, shared), int((lo <= split).sum())
    left, right = np.zeros(len(key), bool), np.zeros(len(key), bool)
    left[which[:n][hit[:n]]], right[which[n:][hit[n:]]] = True, True
    lo, hi = np.where(left, lo, np.maximum(lo, split + 1)), np.where(right, hi, np.minimum(hi, split))
    keep = left | right
    return key[keep], pos[keep], lo[keep], hi[keep]


def contexts(x: dict[str, np.ndarray], found: tuple[np.ndarray, ...], threshold: int) -> np.ndarray:
    """Rows of key (6 bytes), first and last window offset, and the bytes that the anchor's windows cover; zero outside."""
    key, pos, lo, hi = found
    width = threshold - GRAM + 1
    span = np.arange(-(width - 1), threshold)
    raw = x["raw"]
    ix = pos[:, None] + span
    ctx = raw[np.clip(ix, 0, len(raw) - 1)]
    ctx[(ix < lo[:, None]) | (ix >= hi[:, None] + threshold)] = 0
    head = np.zeros((len(key), 8), np.uint8)
    head[:, :6] = np.ascontiguousarray(key.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, 2:]
    head[:, 6], head[:, 7] = lo - pos + width - 1, hi - pos + width - 1
    return np.concatenate([head, ctx], axis=1)


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each kind in byte order, kind of every row)."""
    flat = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).reshape(-1)
    _, first, kind = np.unique(flat, return_index=True, return_inverse=True)
    return first, kind.reshape(-1)


def window_minima(rows: np.ndarray, doc: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct context rows in byte order with their smallest doc: (offset into the flat result, flat minima by window)."""
    key = np.zeros((len(rows), 8), np.uint8)
    key[:, 2:] = rows[:, :6]
    key = key.view(">u8").reshape(-1)
    count = rows[:, 7].astype(np.int64) - rows[:, 6] + 1
    at = np.cumsum(count) - count
    out = np.repeat(doc, count)
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    several = np.flatnonzero(np.bincount(group)[group] > 1) if len(key) else np.zeros(0, np.int64)
    begin = 0
    while begin < len(several):  # slices of whole anchors
        end = begin + int(np.searchsorted(np.cumsum(count[several[begin:]]), SLICE_WINDOWS)) + 1
        while end < len(several) and group[several[end]] == group[several[end - 1]]:
            end += 1
        part = several[begin:end]
        begin = end
        row = np.repeat(part, count[part])
        inside = np.arange(len(row)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        off = rows[row, 6].astype(np.int64) + inside
        rank = group[row] * 256 + off
        live = np.arange(len(row))
        low = doc[row].copy()
        for digit in range(-(-threshold // 8)):
            take = min(8, threshold - 8 * digit)
            d = np.zeros(len(live), np.uint64)
            for i in range(take):
                d = (d << np.uint64(8)) | rows[row[live], 8 + off[live] + 8 * digit + i].astype(np.uint64)
            order = np.lexsort((d, rank[live]))
            r, s = rank[live][order], d[order]
            fresh = np.r_[True, (r[1:] != r[:-1]) | (s[1:] != s[:-1])]
            g = np.cumsum(fresh) - 1
            tied = np.bincount(g)[g] > 1
            live = live[order][tied]
            rank[live] = g[tied]
            if not len(live):
                break
        if len(live):
            order = np.argsort(rank[live], kind="stable")
            at_live = live[order]
            first = np.flatnonzero(np.r_[True, rank[at_live][1:] != rank[at_live][:-1]])
            least = np.minimum.reduceat(low[at_live], first)
            low[at_live] = np.repeat(least, np.diff(np.r_[first, len(at_live)]))
        out[at[row] + inside] = low
    return at, out


def _dealt(x: dict, at: np.ndarray, shared: np.ndarray, page: int, buckets: int, threshold: int) -> Iterator[tuple[int, int, bytes]]:
    found = repeated(x["raw"], page_anchors(x, at, threshold), shared, threshold)
    if not len(found[0]):
        return
    rows = contexts(x, found, threshold)
    first, kind = distinct_rows(rows)
    begins = np.cumsum(x["size"]) - x["size"]
    own = np.searchsorted(begins, found[1], "right") - 1
    while (empty := x["size"][own] == 0).any():  # empty documents share their start with the next one
        own[empty] -= 1
    order = np.argsort(kind, kind="stable")
    times = np.bincount(kind)
    ends = np.cumsum(times)
    bucket = bucket_of(found[0][first], buckets).astype(np.int64)
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in range(buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if lo < hi:
            occ = order[ends[lo] - times[lo] : ends[hi - 1]]
            yield b, page, _squeeze(rows=rows[first[lo:hi]], times=times[lo:hi].astype(np.int32), own=own[occ].astype(np.int32), doc=x["doc"][own[occ]], pos=(found[1][occ] - begins[own[occ]]).astype(np.int64))


def _answer(threshold: int):
    width = threshold - GRAM + 1

    def run(table: pa.Table) -> pa.Table:
        pages, blobs = table.column("page").to_pylist(), table.column("blob").to_pylist()
        parts = [_expand(b) for b in blobs]
        rows = np.concatenate([p["rows"] for p in parts])
        least = np.concatenate([np.minimum.reduceat(p["doc"], np.cumsum(p["times"]) - p["times"]) for p in parts])
        first, kind = distinct_rows(rows)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, kind, least)
        at, minima = window_minima(rows[first], low, threshold)
        count = rows[first][:, 7].astype(np.int64) - rows[first][:, 6] + 1
        out, done = [], 0
        for p in parts:
            k = np.repeat(kind[done : done + len(p["times"])], p["times"])
            done += len(p["times"])
            got = []
            for lo in range(0, len(k), 20_000):
                kk, doc = k[lo : lo + 20_000], p["doc"][lo : lo + 20_000]
                n = count[kk]
                row = np.repeat(np.arange(len(kk)), n)
                inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                hit = minima[at[kk][row] + inside] < doc[row]
                row, inside = row[hit], inside[hit]
                if not len(row):
                    continue
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (inside[1:] != inside[:-1] + 1)])
                last = np.r_[new[1:], len(row)] - 1
                r = row[new]
                base = p["pos"][lo + r] - (width - 1) + rows[first][kk[r], 6]
                got.append((p["own"][lo + r], base + inside[new], base + inside[last]))
            cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [np.zeros(0, np.int64)] * 3
            out.append(_squeeze(own=cols[0].astype(np.int32), s=cols[1], e=cols[2]))
        return pa.table({"page": pa.array(pages, pa.int64()), "spans": pa.array(out, pa.binary())})

    return run


def removed_mask(x: dict[str, np.ndarray], chosen: np.ndarray, spans: list[bytes], threshold: int) -> np.ndarray:
    """Bytes of the page to remove: covered windows of chosen documents, all of the other copies."""
    begins = np.cumsum(x["size"]) - x["size"]
    edge = np.zeros(len(x["raw"]) + 1, np.int32)
    for blob in spans:
        s = _expand(blob)
        base = begins[s["own"]]
        np.add.at(edge, base + s["s"], 1)
        np.add.at(edge, base + s["e"] + threshold, -1)
    mask = np.cumsum(edge)[:-1] > 0
    copy = ~x["null"] & (x["size"] >= threshold)
    copy[chosen] = False
    return mask | np.repeat(copy, x["size"])


def substring_dedup(docs: DataFrame, threshold: int = THRESHOLD, texts: bool = False, page_bytes: int = PAGE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and ``kept`` bytes if ``texts``); one row per input row.

    A null text is empty. A null doc_id is neither removed from nor a source. Rows of one doc_id are no source for each
    other. Texts shorter than ``threshold`` (at least 24) bytes stay whole.
    """
    if threshold < 24:
        raise ValueError("the threshold must be at least 24 bytes")
    tune(docs.sparkSession)
    pages = text_pages(documents(docs), page_bytes)

    def rows(batches):
        for b in batches:
            for page, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = _expand(blob)
                ends, raw = np.cumsum(x["size"]), x["raw"].tobytes()
                sums = [hashlib.blake2b(raw[e - s : e], digest_size=16).hexdigest() for s, e in zip(x["size"], ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), page)), pa.array(np.arange(len(ends))), pa.array(x["doc"], mask=x["null"]), pa.array(x["size"]), pa.array(sums)], ["page", "at", "doc_id", "size", "digest"])

    members = pages.mapInArrow(rows, "page long, at long, doc_id long, size long, digest string").filter(f"doc_id is not null and size >= {threshold}").checkpoint()
    classes = members.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("size").alias("size"))
    total = classes.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    chosen = members.join(classes.select("digest", "least"), "digest").filter("doc_id = least").groupBy("page").agg(F.collect_list("at").alias("ats")).checkpoint()
    live = pages.join(chosen, "page")

    def ask(batches):
        for b in batches:
            for page, blob, ats in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = _expand(blob)
                found = page_anchors(x, np.array(sorted(ats)), threshold)
                keys, which, _ = sides(x["raw"], found, threshold)
                own = np.searchsorted(np.cumsum(x["size"]), found[1], "right")
                yield request_batch(requests_of(page, keys, own[which], buckets))

    answers = materialize(answers_by_page(shared_keys(live.select("page", "blob", "ats").mapInArrow(ask, REQUEST))), "answers")

    def send(batches):
        for b in batches:
            for page, blob, ats, got in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for row in _dealt(_expand(blob), np.array(sorted(ats)), keys_in(got), page, buckets, threshold):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["bucket", "page", "blob"])

    dealt = live.join(answers, "page").select("page", "blob", "ats", "answers").mapInArrow(send, "bucket long, page long, blob binary")
    spans = dealt.groupBy("bucket").applyInArrow(_answer(threshold), "page long, spans binary")
    spans = materialize(spans.groupBy("page").agg(F.collect_list("spans").alias("spans")), "spans")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * texts

    def finish(batches):
        for b in batches:
            for blob, ats, got in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                x = _expand(blob)
                mask = removed_mask(x, np.array(sorted(ats or []), np.int64), got or [], threshold)
                ends = np.cumsum(x["size"])
                cols: list[list] = [[] for _ in names]
                for doc, null, s, e in zip(x["doc"].tolist(), x["null"].tolist(), (ends - x["size"]).tolist(), ends.tolist(), strict=True):
                    m = mask[s:e]
                    n = int(m.sum())
                    kept = x["raw"][s:e][~m].tobytes() if n else x["raw"][s:e].tobytes()
                    row = (None if null else doc, e - s, n, int((m[1:] & ~m[:-1]).sum()) + int(n and m[0]), hashlib.sha256(kept).hexdigest(), kept)
                    for c, v in zip(cols, row, strict=False):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * texts
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    whole = pages.join(chosen, "page", "left").join(spans, "page", "left").select("blob", "ats", "spans")
    return whole.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
