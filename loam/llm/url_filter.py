"""URL filters by a Bloom filter cascade (operator 9).

Listed keys are the rules' (host, path prefix) pairs. The key universe is every pair that a url of the corpus can be
asked for: each suffix of its host at a label boundary, with each prefix of its path that is as long as some rule's
path. Level 1 of the cascade encodes the listed keys; each further level encodes the keys that the level before lets
through wrongly, of the universe and of the list in turn, until none is left. A key is then listed exactly when the
first level that refuses it is an even one, with no error on the universe and without joining urls to rules.

A filter holds as many bits as its keys need, and the keys let through by level 1 are about as many as the listed ones
(its error rate is set from the ratio of the two), so what is broadcast follows the list and not the corpus.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tune

#: Fixed values of the base contract: verdict, host, path.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Rule tables beyond this many rows are refused: the list is what is broadcast.
MOST_RULES = 2_000_000
MOST_LEVELS = 64


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
    return host, tail[:stop]


def suffixes(host: str) -> list[str]:
    """The host and its parent domains, the longest first."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if host[at + 1 :]:
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def keys_of(host: str, path: str, lengths: list[int]) -> list[tuple[str, str]]:
    """Candidate rules, the longest rule first, the longer host first among equals."""
    out = {(s, path[:n]) for s in suffixes(host) for n in lengths if n <= len(path)}
    return sorted(out, key=lambda k: (-len(k[0]) - len(k[1]), -len(k[0]), k))


def key_hash(key: tuple[str, str]) -> bytes:
    return hashlib.blake2b(f"{key[0]}\n{key[1]}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Bloom:
    """Double hashing of a 16-byte key hash, salted by the level."""

    def __init__(self, level: int, n: int, rate: float) -> None:
        self.level = level
        self.bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        self.k = max(1, round(self.bits / max(n, 1) * math.log(2)))
        self.k = min(self.k, 24)
        self.map = np.zeros(-(-self.bits // 8), np.uint8)

    def places(self, h: bytes) -> list[int]:
        d = hashlib.blake2b(h, digest_size=16, salt=self.level.to_bytes(8, "little")).digest()
        a, b = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 1
        return [(a + i * b) % (1 << 64) % self.bits for i in range(self.k)]

    def add(self, h: bytes) -> None:
        for p in self.places(h):
            self.map[p >> 3] |= 1 << (p & 7)

    def has(self, h: bytes) -> bool:
        return all(self.map[p >> 3] >> (p & 7) & 1 for p in self.places(h))


class Cascade:
    def __init__(self) -> None:
        self.levels: list[Bloom] = []

    def depth(self, h: bytes) -> int:
        """How many levels let the key through before one refuses it."""
        for i, level in enumerate(self.levels):
            if not level.has(h):
                return i
        return len(self.levels)

    def __contains__(self, h: bytes) -> bool:
        return self.depth(h) % 2 == 1


def build_cascade(listed: list[bytes], universe: DataFrame, size: int) -> Cascade:
    """``universe``: one column ``h`` of distinct key hashes, ``size`` rows. Each level is one pass over it."""
    sc, out = universe.sparkSession.sparkContext, Cascade()
    inside, outside, known = list(listed), None, sc.broadcast(frozenset(listed))
    r = max(len(listed), 1)
    while inside and len(out.levels) < MOST_LEVELS:
        n = len(out.levels)
        rate = min(0.5, max(1e-9, r * math.sqrt(0.5) / max(size - r, 1))) if n == 0 else 0.5
        level = Bloom(n, len(inside), rate)
        for h in inside:
            level.add(h)
        out.levels.append(level)
        if n == 0:
            sent = sc.broadcast(level)

            def wrong(batches, sent=sent, known=known):
                for b in batches:
                    hs = [h for h in b.column(0).to_pylist() if sent.value.has(h) and h not in known.value]
                    yield pa.RecordBatch.from_arrays([pa.array(hs, pa.binary())], ["h"])

            through = [bytes(x["h"]) for x in universe.mapInArrow(wrong, "h binary").collect()]  # about as many as listed
        else:
            through = [h for h in outside if level.has(h)]
        inside, outside = through, inside
    if inside:
        raise ValueError("the cascade did not close")
    return out


def url_verdicts(pages: DataFrame, rules: DataFrame | list[tuple[str, str, str]] | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict; one row per input row.

    A null url or one without ``://`` has an empty host and path and fits no rule; its verdict is ``default``, as is
    that of every url without a listed key. ``rules``: (verdict, host, path) rows; of equal keys the block rule wins.
    No rules: every url gets the default. Ties in length go to the longer host. Repeated rows repeat, a null page_id is a
    row like any other, other columns are not read, urls of any length are judged whole.
    """
    tune(pages.sparkSession)
    sc = pages.sparkSession.sparkContext
    if isinstance(rules, DataFrame):
        got = rules.select("verdict", "host", "path").limit(MOST_RULES + 1).collect()
        if len(got) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        rules = [(r["verdict"], r["host"] or "", r["path"] or "") for r in got]
    rules = RULES if rules is None else rules
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")  # as urls are: A-Z only
    verdicts = {(h.translate(low), p): v for v, h, p in sorted(rules, key=lambda r: r[0] == "block")}
    lengths = sorted({len(p) for _, p in verdicts})
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))

    def key_rows(batches):
        for b in batches:
            hs = {key_hash(k) for u in b.column(0).to_pylist() for k in keys_of(*split_url(u), lengths)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(hs), pa.binary())], ["h"])

    universe = plain.select("url").mapInArrow(key_rows, "h binary").distinct().checkpoint()
    size = universe.count()
    blocked = {key_hash(k) for k, v in verdicts.items() if v == "block"}
    all_keys = {key_hash(k) for k in verdicts}
    sent = sc.broadcast((build_cascade(sorted(all_keys), universe, size), build_cascade(sorted(blocked), universe, size)))

    def run(batches):
        listed, block = sent.value
        for b in batches:
            rows = []
            for page, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host, path = split_url(url)
                rule = verdict = None
                for k in keys_of(host, path, lengths):
                    h = key_hash(k)
                    if h in listed:
                        rule, verdict = k[0] + k[1], "block" if h in block else "allow"
                        break
                rows.append((page, host, path, rule, verdict or default))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), *[pa.string()] * 4), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), *[pa.string()] * 4)], ["page_id", "host", "path", "rule", "verdict"])

    return plain.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
