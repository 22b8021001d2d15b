"""Secrets by keyword prefilter, anchored expressions and embedded checksums (operator 12).

One Aho-Corasick automaton holds the keywords of all rules. It runs once over a text; a rule's expression is only tried at the
hits of its own keywords, anchored there, so no expression ever scans a text. A hit inside the rule's last match is skipped,
which makes the matches leftmost and non-overlapping for each kind, exactly as a scan by the expression would. The one
rule whose alphabet is its only mark (``hex``) has no keyword; a run of 32 digits covers one byte in every 32, so only every
32nd byte is looked at, and the run around it is measured where it is a hex digit.

Formats that carry a checksum are judged by it: base62 CRC-32 (``github``, ``npm``), base58 with double SHA-256
(``xprv``, ``wif``), bech32 (``age``, ``nsec``), the length in the DER header of a key (``pem``), the JSON header of a
signed token (``jwt``). A text that merely looks like one is dropped.

Texts are scanned as UTF-8 bytes (all rules are ASCII) and places are told in code points.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, rows_of, tune

#: Kinds of the base contract, in its order, and all kinds.
BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "github", "npm", "xprv", "wif", "age", "nsec", "pem", "jwt", "slack", "stripe", "google"]

# Fixed values of the base contract and of the published formats.
ASSIGN = rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_STEPS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
HEX_DIGITS = frozenset(b"0123456789abcdef")


def crc62(body: bytes, check: bytes) -> bool:
    """Whether ``check`` is the base62 CRC-32 of ``body``, most significant digit first."""
    n = zlib.crc32(body)
    out = bytearray()
    for _ in check:
        n, digit = divmod(n, 62)
        out.append(BASE62[digit])
    return n == 0 and bytes(reversed(out)) == check


def base58check(said: bytes, size: int) -> bool:
    """Whether ``said`` is ``size`` bytes in base 58 whose last four are the double SHA-256 of the others."""
    n = 0
    for c in said:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 8 * size:
        return False
    raw = n.to_bytes(size, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32(said: bytes) -> bool:
    """Whether the last six digits of ``said`` close it by the polynomial of bech32."""
    head, _, data = said.lower().rpartition(b"1")
    digits = [BECH32.find(c) for c in data]
    if not head or min(digits, default=-1) < 0:
        return False
    state = 1
    for x in [*(c >> 5 for c in head), 0, *(c & 31 for c in head), *digits]:
        top, state = state >> 25, (state & 0x1FFFFFF) << 5 ^ x
        for i, step in enumerate(BECH32_STEPS):
            state ^= step if top >> i & 1 else 0
    return state == 1


def der_key(m: re.Match) -> bool:
    """Whether the base64 of a key block opens as its own format: a DER sequence of just its length, or the OpenSSH magic."""
    try:
        raw = base64.b64decode(b"".join(m[2].split()), validate=True)
    except binascii.Error:
        return False
    if m[1] == b"OPENSSH ":
        return raw.startswith(b"openssh-key-v1\0")
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    more = raw[1] & 0x7F if raw[1] & 0x80 else 0
    return len(raw) == 2 + more + (int.from_bytes(raw[2 : 2 + more], "big") if more else raw[1])


def jwt_head(m: re.Match) -> bool:
    """Whether the first part of a token is a JSON object that names an algorithm."""
    try:
        head = json.loads(base64.urlsafe_b64decode(m[1] + b"=" * (-len(m[1]) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


class Rule:
    """Keywords by which places are found, the expression tried there, and the check of what it matched."""

    def __init__(self, kind: str, keywords: list[str], pattern: bytes, check: Callable[[re.Match], bool] | None = None, flags: int = 0) -> None:
        self.kind, self.keywords, self.pattern, self.check = kind, keywords, re.compile(pattern, flags), check


#: A rule's expression begins with its keyword and never tries a run of characters twice. Without a check the shape is all
#: that a format gives.
RULES = [
    Rule("assign", ASSIGN_WORDS, ASSIGN, lambda m: len(m[2]) >= LEAST_VALUE, re.I),
    Rule("access", ["akia"], rb"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= LEAST_ACCESS),
    Rule("github", ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])", lambda m: crc62(m[1], m[2])),
    Rule("npm", ["npm_"], rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9_])", lambda m: crc62(m[1], m[2])),
    Rule("xprv", ["xprv", "tprv"], rb"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![A-Za-z0-9])", lambda m: base58check(m[0], 82)),
    Rule("wif", ["5h", "5j", "5k"], rb"5[HJK][1-9A-HJ-NP-Za-km-z]{49}(?![A-Za-z0-9])", lambda m: base58check(m[0], 37)),
    Rule("age", ["age-secret-key-1"], rb"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Za-z0-9])", lambda m: bech32(m[0])),
    Rule("nsec", ["nsec1"], rb"nsec1[02-9ac-hj-np-z]{58}(?![A-Za-z0-9])", lambda m: bech32(m[0])),
    Rule("pem", ["-----begin "], rb"-----BEGIN ((?:RSA |EC |DSA |OPENSSH )?)PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----", der_key),
    Rule("jwt", ["eyj"], rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]{16,}", jwt_head),
    Rule("slack", ["xoxb-", "xoxp-", "xoxa-", "xoxr-"], rb"xox[bpar]-[0-9]{8,}-[0-9A-Za-z-]{16,}"),
    Rule("stripe", ["sk_live_", "rk_live_"], rb"[sr]k_live_[0-9A-Za-z]{24,}"),
    Rule("google", ["aiza"], rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"),
]


@functools.cache
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    by_word: dict[str, list[int]] = {}
    for n, rule in enumerate(RULES):
        for word in rule.keywords:
            by_word.setdefault(word, []).append(n)
    for word, numbers in by_word.items():
        out.add_word(word, (len(word), numbers))
    out.make_automaton()
    return out


def hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    """Maximal runs of LEAST_HEX hex digits or more."""
    end = 0
    for at in range(LEAST_HEX - 1, len(raw), LEAST_HEX):
        if raw[at] not in HEX_DIGITS or at < end:
            continue
        start = at
        while start > end and raw[start - 1] in HEX_DIGITS:
            start -= 1
        end = at + 1
        while end < len(raw) and raw[end] in HEX_DIGITS:
            end += 1
        if end - start >= LEAST_HEX:
            yield start, end


def spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of a text in code points, by start and then kind as listed."""
    raw = text.encode("utf-8", "surrogatepass")
    lower = raw.lower().decode("latin-1")  # one character for each byte
    places: list[list[int]] = [[] for _ in RULES]
    for last, (size, numbers) in automaton().iter(lower):
        for n in numbers:
            places[n].append(last + 1 - size)
    found = [(s, e, "hex") for s, e in hex_runs(raw)]
    for rule, starts in zip(RULES, places, strict=True):
        end = 0
        for at in sorted(starts):
            if at >= end and (m := rule.pattern.match(raw, at)):
                end = m.end()
                if rule.check is None or rule.check(m):
                    found.append((at, end, rule.kind))
    if found and len(raw) != len(text):
        cuts = sorted({x for s, e, _ in found for x in (s, e)})
        points, n, before = {}, 0, 0
        for x in cuts:
            n += len(raw[before:x].decode("utf-8", "surrogatepass"))
            points[x], before = n, x
        found = [(points[s], points[e], k) for s, e, k in found]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined); one row per input row.

    The counts and the digest are of the base kinds; ``spans`` has those of all rules. A null or empty text has none; repeated
    rows repeat; a null doc_id is a row like any other; other columns are not read. Rows are scanned one by one, so a
    text of any length needs three copies of itself and no more.
    """
    tune(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def run(batches):
        for b in batches:
            out = []
            for doc, text in rows_of([b]):
                found = spans(text or "")
                base = [f"{k}:{s}:{e}" for s, e, k in found if k in BASE]
                counts = [sum(k == x for _, _, k in found) for x in BASE]
                out.append((doc, *counts, hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for s, e, k in found)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return documents(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start, end, value: a row for each span, for removal or review. Nulls and repeats as in ``secret_scan``."""
    tune(docs.sparkSession)
    names, kinds = ["doc_id", "kind", "start", "end", "value"], [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            out = [(doc, k, s, e, text[s:e]) for doc, text in rows_of([b]) if text for s, e, k in spans(text)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return documents(docs).mapInArrow(run, "doc_id long, kind string, start long, end long, value string")
