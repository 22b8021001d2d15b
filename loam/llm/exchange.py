"""Which keys occur in more than one place, without shipping every occurrence.

Documents are held in pages (a few thousand documents, bounded by bytes). A page asks about its distinct keys once, so
a key that a third of all rows hold is sent once for each page and not once for each row. Keys are dealt by radix to
buckets of bounded size; a bucket answers each page with those of its keys that some other page, or two documents of
the page itself, also hold. Keys are 48 bits of a hash: a rare collision adds a candidate that the exact step drops.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_BITS = 48
#: Keys that one bucket holds, about.
BUCKET_KEYS = 3_000_000


def new_page_id() -> int:
    return uuid.uuid4().int >> 65


def pack48(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack48(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Radix bucket: the leading digit of the key, scaled to the number of buckets."""
    return ((keys >> np.uint64(KEY_BITS - 24)) * np.uint64(buckets)) >> np.uint64(24)


def deal(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in ``keys``) for sorted keys."""
    b = bucket_of(keys, buckets)
    cuts = np.searchsorted(b, np.arange(buckets + 1))
    for i in range(buckets):
        if cuts[i] < cuts[i + 1]:
            yield i, np.arange(cuts[i], cuts[i + 1])


def requests_of(page: int, keys: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple[int, int, bytes, bytes]]:
    """(bucket, page, packed keys, flags) for all keys of a page; ``owner``: the document of each occurrence."""
    order = np.lexsort((owner, keys))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(k)] - 1 if len(k) else first
    several = o[first] != o[last]
    k = k[first]
    return [(i, page, pack48(k[at]), np.packbits(several[at]).tobytes()) for i, at in deal(k, buckets)]


REQUEST = "bucket long, page long, keys binary, several binary"


def request_batch(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "page", "keys", "several"])


def shared_keys(requests: DataFrame) -> DataFrame:
    """page, keys (packed, sorted): the keys of each page that occur in two documents or more, one row for each bucket."""

    def answer(table: pa.Table) -> pa.Table:
        pages, raws, several = table.column("page").to_pylist(), table.column("keys").to_pylist(), table.column("several").to_pylist()
        parts = [unpack48(r) for r in raws]
        keys = np.concatenate(parts)
        multi = np.concatenate([np.unpackbits(np.frombuffer(s, np.uint8), count=len(p)) for s, p in zip(several, parts, strict=True)])
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        hit = (np.r_[False, same] | np.r_[same, False]) | (multi[order] > 0)
        flags = np.zeros(len(keys), bool)
        flags[order] = hit
        out, at = [], 0
        for p in parts:
            out.append(pack48(p[flags[at : at + len(p)]]))
            at += len(p)
        return pa.table({"page": pa.array(pages, pa.int64()), "keys": pa.array(out, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(answer, "page long, keys binary").filter(F.length("keys") > 0)


def answers_by_page(answers: DataFrame) -> DataFrame:
    """page, answers (array of packed keys); a page has at most one answer for each bucket."""
    return answers.groupBy("page").agg(F.collect_list("keys").alias("answers"))


def keys_in(answers: list[bytes] | None) -> np.ndarray:
    return np.sort(np.concatenate([unpack48(a) for a in answers])) if answers else np.zeros(0, np.uint64)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Mask of ``keys`` that are in the sorted ``among``."""
    if not len(among):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(among, keys)
    return among[np.minimum(at, len(among) - 1)] == keys
