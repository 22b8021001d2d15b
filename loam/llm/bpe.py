"""Byte-pair encoding and decoding by streaming transducers (operator 5).

``StreamingEncoder`` takes text by chunks of any size and gives out ids as soon as no later input can change them.
A blank ends every piece and no special token holds one, so up to the last blank all is stable. Text without blanks for
longer than ``HOLD`` goes through two more machines: ``Unbroken`` normalizes up to the last safe character and gives out
all pieces but the last two, and ``PieceStream`` gives out the tokens of one endless piece that are followed by
``lookahead`` symbols. So memory is constant, whatever the text; a run of more than HOLD combining marks, which has no
safe place, is held whole.

The sufficient lookahead follows from the merge list. Let two pieces begin alike, and look at the first token that
differs, rank by rank. It moves left only if the token before it, ``a``, merges with it in one of the pieces; the token
there then begins with ``a`` in both, and if the place moves again, by a merge (c, b) of higher rank, ``b`` begins with
``a``. It never moves right, as each token has one derivation. So the heaviest chain of merges with rising ranks, each
right side beginning with the left side before it, weighed by the left sides' lengths, bounds the way to the left.

``StreamingDecoder`` is the way back: ids in, bytes through an incremental UTF-8 state machine, text out. The
vocabulary file has no decoder, so the library joins the tokens' own strings by a space, and so does the machine;
``decode_text`` undoes the byte alphabet and the ends of words as well.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import KEPT, documents, rows_of, trimmed, tune

END = "</w>"
#: Pieces cached per worker, in two generations: a full one becomes the old one, and pieces met again move up.
CACHE, PACKED = 80_000, 250_000
#: Bits of a token id in the packed pair and merge keys.
ID_BITS, NO_MERGE = 20, 1 << 62
#: Longer pieces are not cached and go through the streaming path.
LONG_PIECE = 512
#: Characters fed at once, and those held without a blank before the finer machines take over.
CHUNK, HOLD = 1 << 16, 1 << 13
#: Bytes of normalized text that are cut and looked up at once.
PART_BYTES = 4 << 20
#: Pieces of at most so many bytes are merged in bulk, in groups by these sizes.
WIDTHS = (6, 8, 10, 12, 16)


def _latin_class(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(0x370)) if unicodedata.category(c)[0] == kind)


#: The pattern for texts without characters from U+0370 on, with its classes spelled out; letters are tried first.
_SPACE = r"\t-\r \x85\xa0"
LATIN = re.compile(f"[{_latin_class('L')}]+|[{_latin_class('N')}]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}{_latin_class('L')}{_latin_class('N')}]+")
BEYOND_LATIN = re.compile("[^\x00-\u036f]")
PIECES = regex.compile(r"[\p{L}]+|[\p{N}]|'(?:s|t|re|ve|m|ll|d)|[^\s\p{L}\p{N}]+")
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable Latin-1, else the next free character from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Alphabet:
    """Lower case and class of characters as the library of the tokenizer file has them.

    Its Unicode tables can be older or newer than Python's, so characters outside Latin are asked from the library once
    each; ``odd`` are those that differ from what this module's regular expressions would do.
    """

    def __init__(self, spec: str) -> None:
        self.spec, self.known, self.odd, self.lib = spec, {chr(c) for c in range(0x250)}, {}, None

    def composed(self, text: str) -> str:
        """The library's own composed form: combining marks outside the Latin block are ordered by its tables."""
        from tokenizers import normalizers

        return normalizers.NFC().normalize_str(text)

    def odd_in(self, chars: set[str]) -> dict[str, tuple[str, str]]:
        for c in chars - self.known:
            if self.lib is None:
                from tokenizers import Tokenizer

                self.lib = Tokenizer.from_str(self.spec)
            self.known.add(c)
            low = self.lib.normalizer.normalize_str(c)
            spans = [tuple(s) for _, s in self.lib.pre_tokenizer.pre_tokenize_str("a" + low + "b")]
            kind = "L" if len(spans) == 1 else "S" if len(spans) == 2 else "L?"
            if kind == "L?":
                kind = "N" if len(self.lib.pre_tokenizer.pre_tokenize_str("!" + low + "!")) == 3 else "P"
            mine = c.replace("Σ", "σ").lower()
            same = "L" if regex.fullmatch(r"\p{L}+", mine) else "N" if regex.fullmatch(r"\p{N}", mine) else "S" if regex.fullmatch(r"\s+", mine) else "P"
            if len(low) == 1 and (low != unicodedata.normalize("NFC", mine) or kind != same):
                self.odd[c] = (low, kind)
        return {c: self.odd[c] for c in chars & self.odd.keys()} if self.odd else {}


class PieceCache(dict):
    """piece -> ``make(piece)``, in two generations: a full one becomes the old one, and pieces met again move up."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.old, self.most = make, {}, most

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= LONG_PIECE:
            self.put(piece, found)
        return found

    def put(self, piece: str, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[piece] = value


class PairTable:
    """Rank of a pair of ids for whole arrays: a cuckoo table, each pair in one of two places."""

    BITS = 18
    ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]

    def __init__(self, ranks: dict[int, int]) -> None:
        self.none = len(ranks) + 1
        self.merged = np.zeros(self.none, np.int32)
        self.keys, self.ranks = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.none, np.int32)
        places = [(np.fromiter(ranks, np.uint64, len(ranks)) * odd >> np.uint64(64 - self.BITS)).tolist() for odd in self.ODD]
        both = {key: pair for key, *pair in zip(ranks, *places, strict=True)}
        table: dict[int, int] = {}
        for key in ranks:
            side = 0
            for _ in range(500):
                at = both[key][side]
                table[at], key = key, table.get(at)
                if key is None:
                    break
                side = 1 - both[key].index(at) if both[key][0] != both[key][1] else 0
            else:
                raise RuntimeError("merge list too large for the pair table")
        for at, key in table.items():
            self.keys[at], self.ranks[at] = key, ranks[key] >> ID_BITS
            self.merged[ranks[key] >> ID_BITS] = ranks[key] & ((1 << ID_BITS) - 1)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.uint64) << np.uint64(ID_BITS) | right.astype(np.uint64)
        one, two = (key * odd >> np.uint64(64 - self.BITS) for odd in self.ODD)
        return np.where(self.keys[one] == key, self.ranks[one], np.where(self.keys[two] == key, self.ranks[two], self.none)).astype(np.int32)


#: Classes of bytes and characters below U+0370: blank, letter, number, anything else.
BLANK, LETTER, NUMBER, OTHER = range(4)
#: Letters after an apostrophe that are one piece with it: one by itself, or two.
ONE_LETTER, TWO_LETTERS = frozenset(b"stmd"), (b"re", b"ve", b"ll")


@functools.cache
def latin_classes() -> np.ndarray:
    out = np.full(0x370, OTHER, np.uint8)
    for i in range(0x370):
        kind = unicodedata.category(chr(i))[0]
        out[i] = LETTER if kind == "L" else NUMBER if kind == "N" else BLANK if i in (*range(9, 14), 32, 0x85, 0xA0) else OTHER
    return out


def latin_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and ends of the pieces of normalized text whose characters are below U+0370, as ``LATIN`` cuts it."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = latin_classes()[np.minimum(data, 0x7F)]
    wide = np.flatnonzero(data >= 0xC0)
    if len(wide):
        kind[wide] = kind[wide + 1] = latin_classes()[(data[wide].astype(np.int64) & 0x1F) << 6 | (data[wide + 1] & 0x3F)]
    border = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)]
    border[wide + 1] = False
    quote = np.flatnonzero((data[:-1] == 39) & border[:-1] & (kind[1:] == LETTER))
    if len(quote):
        ahead = np.r_[data, np.zeros(2, np.uint8)]
        a, b = ahead[quote + 1], ahead[quote + 2]
        two = np.zeros(len(quote), bool)
        for x, y in TWO_LETTERS:
            two |= (a == x) & (b == y)
        one = np.isin(a, list(ONE_LETTER))
        for hit, size in ((one, 1), (two & ~one, 2)):
            at = quote[hit]
            border[at + 1] = False
            after = at + 1 + size
            after = after[after < len(data)]
            border[after[kind[after] == LETTER]] = True
    cuts = np.flatnonzero(border)
    ends = np.r_[cuts[1:], len(data)]
    real = kind[cuts] != BLANK
    return cuts[real], ends[real]


def cut_at_blanks(texts: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(number of the text, part): texts of over ``PART_BYTES`` are cut behind blanks, where every piece ends."""
    for k, x in enumerate(texts):
        at = 0
        while at < len(x):
            stop = len(x)
            if stop - at > PART_BYTES:
                stop = 1 + max(x.rfind(b" ", at, at + PART_BYTES), x.rfind(b"\n", at, at + PART_BYTES)) or len(x)
            yield k, x[at:stop]
            at = stop


def distinct_pieces(raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each piece's text, a piece with each text). ``raw`` goes on for 16 bytes after the last piece.

    Up to 16 bytes are compared as two words and the length, under a mixed key whose groups are verified; longer ones by themselves.
    """
    none = np.zeros(0, np.int64)
    if not len(start):
        return none, none
    words = np.lib.stride_tricks.as_strided(np.frombuffer(raw, "<u8", 1), (len(raw) - 7,), (1,))
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    a = words[start] & masks[np.minimum(size, 8)]
    b = words[start + 8] & masks[np.clip(size - 8, 0, 8)]
    key = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(29)
    long = np.flatnonzero(size > 16)
    for k, (s, n) in enumerate(zip(start[long].tolist(), size[long].tolist(), strict=True)):
        key[long[k]] = hash(raw[s : s + n]) & ((1 << 64) - 1)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    same = (a == a[first][which]) & (b == b[first][which]) & (size == size[first][which])
    for k in long.tolist():
        s, t, n = int(start[k]), int(start[first[which[k]]]), int(size[k])
        same[k] &= raw[s : s + n] == raw[t : t + n]
    odd = np.flatnonzero(~same)  # two texts under one key: each piece for itself
    which[odd] = len(first) + np.arange(len(odd))
    return which, np.r_[first, odd]


@functools.cache
def _second_halves() -> frozenset[str]:
    """Characters that can compose with the one before."""
    two = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    jamo = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    return frozenset(chr(int(d[1], 16)) for d in two if len(d) == 2 and not d[0].startswith("<")) | jamo


def safe_start(c: str) -> bool:
    """Whether composition cannot reach over the place before ``c``."""
    return c < "\u0300" or (not unicodedata.combining(c) and c not in _second_halves())


class WordBpe:
    """Pieces to token ids, exactly as the file's merges say: lowest rank first, leftmost among equals."""

    def __init__(self, spec: str) -> None:
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks: dict[int, int] = {}  # left and right id packed -> rank and merged id packed
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << ID_BITS | self.vocab[b]] = rank << ID_BITS | self.vocab[a + b]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.alphabet = byte_alphabet()
        self.inner = [self.vocab[c] for c in self.alphabet]
        self.final = [self.vocab[c + END] for c in self.alphabet]
        self.tokens = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for t, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        self.chars = Alphabet(spec)
        self.numerals = list(map(str, range(len(self.tokens))))
        self.token_utf8 = [t.encode("utf-8", "surrogatepass") for t in self.tokens]
        self.ints = list(range(len(self.tokens)))  # one object for each id, shared by all cached pieces
        self.pairs: PairTable | None = None
        self.cache = PieceCache(self._made, CACHE)
        self.by_bytes: dict[bytes, bytes] = {}
        self.old_bytes: dict[bytes, bytes] = {}
        self.packed = PieceCache(lambda p: array("I", self._made(p)).tobytes(), PACKED)
        self.lookahead = self._lookahead(model["merges"])

    def _lookahead(self, merges: list) -> int | None:
        """Symbols after which a token inside an unfinished piece is stable; None if the list is not one that the proof
        covers (a token made by two merges, or used before it is made): then pieces are held whole."""
        heaviest: dict[str, int] = {}
        made: set[str] = set()
        most = 0
        for pair in merges:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            right = b.removesuffix(END)
            if a + b in made or any(len(x.removesuffix(END)) > 1 and x not in made for x in (a, b)):
                return None
            made.add(a + b)
            weight = len(a) + max((heaviest.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
            heaviest[a] = max(heaviest.get(a, 0), weight)
            most = max(most, weight)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Merge symbols; a heap of (rank, position) over a linked list, O(n log n) for pieces of any length."""
        n, get, mask = len(ids), self.ranks.get, (1 << ID_BITS) - 1
        if n < 64:
            ids = list(ids)
            open_ = [get(a << ID_BITS | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
            while open_:
                low = min(open_)
                if low == NO_MERGE:
                    break
                i = open_.index(low)
                ids[i] = low & mask
                del ids[i + 1], open_[i]
                if i:
                    open_[i - 1] = get(ids[i - 1] << ID_BITS | ids[i], NO_MERGE)
                if i < len(open_):
                    open_[i] = get(ids[i] << ID_BITS | ids[i + 1], NO_MERGE)
            return ids
        ids, left, right = list(ids), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r >> ID_BITS, i, ids[i], ids[i + 1], r & mask) for i in range(n - 1) if (r := get(ids[i] << ID_BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = to, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := get(to << ID_BITS | ids[k])) is not None:
                    heapq.heappush(heap, (r >> ID_BITS, i, to, ids[k], r & mask))
            if (h := left[i]) >= 0 and (r := get(ids[h] << ID_BITS | to)) is not None:
                heapq.heappush(heap, (r >> ID_BITS, h, ids[h], to, r & mask))
        return [x for x in ids if x >= 0]

    def _made(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece."""
        raw = piece.encode("utf-8", "surrogatepass")
        if len(raw) > LONG_PIECE:
            run = PieceStream(self)
            return tuple(run.feed(raw)) + tuple(run.end())
        return tuple(map(self.ints.__getitem__, self.merge([self.inner[b] for b in raw[:-1]] + [self.final[raw[-1]]])))

    def merge_many(self, raws: list[bytes]) -> list[bytes]:
        """Packed ids of pieces of 1 to WIDTHS[-1] bytes, all at once: each step merges the lowest pair of every piece."""
        if self.pairs is None:
            self.pairs = PairTable(self.ranks)
        size = np.array([len(r) for r in raws], np.int64)
        out: list[bytes] = [b""] * len(raws)
        for least, most in zip((0, *WIDTHS), WIDTHS, strict=False):
            at = np.flatnonzero((size > least) & (size <= most))
            if len(at):
                rows = at.tolist()
                for k, ids in zip(rows, self._merge_rows([raws[k] for k in rows], size[at], most), strict=True):
                    out[k] = ids
        return out

    def _merge_rows(self, raws: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        rank, none, pad = self.pairs.rank, self.pairs.none, (1 << ID_BITS) - 1
        data = np.frombuffer(b"".join([r.ljust(width, b"\0") for r in raws]), np.uint8).reshape(-1, width)
        col, row = np.arange(width), np.arange(len(raws))
        ids = np.full((len(raws), width + 1), pad, np.int32)
        ids[:, :width] = np.array(self.inner, np.int32)[data]
        ids[row, size - 1] = np.array(self.final, np.int32)[data[row, size - 1]]
        ids[:, :width][col >= size[:, None]] = pad
        r = np.full((len(raws), width), none, np.int32)
        real = col < size[:, None] - 1
        r[real] = rank(ids[:, :-1][real], ids[:, 1:][real])
        out, size = np.zeros((len(raws), width), "<u4"), size.copy()
        while len(row):
            j = r.argmin(axis=1)
            low = r[np.arange(len(row)), j]
            go = low < none
            if not go.all():
                out[row[~go]] = ids[~go, :width]
                row, ids, r, j, low = row[go], ids[go], r[go], j[go], low[go]
            at = np.arange(len(row))
            ids[at, j] = self.pairs.merged[low]
            ids[:, :-1] = np.take_along_axis(ids, col + (col > j[:, None]), 1)
            ids[:, -1] = pad
            r[:, :-1] = np.take_along_axis(r, col[:-1] + (col[:-1] >= j[:, None]), 1)
            r[:, -1] = none
            r[at, j] = rank(ids[at, j], ids[at, j + 1])
            k = np.flatnonzero(j)
            r[k, j[k] - 1] = rank(ids[k, j[k] - 1], ids[k, j[k]])
            size[row] -= 1
        raw, wide = out.tobytes(), 4 * width
        return [raw[k : k + 4 * n] for k, n in zip(range(0, wide * len(raws), wide), size.tolist(), strict=True)]

    def learn(self, pieces: Iterable[str]) -> None:
        """Put the packed ids of pieces into the cache, those of short new pieces all at once."""
        new = set(pieces).difference(self.packed)
        new = [p for p in (new.difference(self.packed.old) if self.packed.old else new) if len(p) <= WIDTHS[-1]]
        raws = [p.encode("utf-8", "surrogatepass") for p in new]
        short = [k for k, x in enumerate(raws) if len(x) <= WIDTHS[-1]]
        if short:
            for k, ids in zip(short, self.merge_many([raws[k] for k in short]), strict=True):
                self.packed.put(new[k], ids)

    def normalized(self, text: str) -> tuple[str, dict]:
        """Text without special tokens in composed form and lower case, and the classes of characters that regular
        expressions here see otherwise than the library."""
        if text.isascii():
            return text.lower(), {}
        plain = unicodedata.normalize("NFC", text).lower()
        if not BEYOND_LATIN.search(plain):
            return plain, {}
        rare = {c for c in set(text) if c >= "\u0370"}
        text = self.chars.composed(text) if any(map(unicodedata.combining, rare)) else unicodedata.normalize("NFC", text)
        odd = self.chars.odd_in(rare | set(text)) if rare else {}
        low = text.replace("Σ", "σ")
        if not odd:
            return low.lower(), {}
        return "".join(odd[c][0] if c in odd else c.lower() for c in low), dict(odd.values())

    def pieces(self, text: str) -> list[str]:
        return self.cut(*self.normalized(text))

    def cut(self, low: str, kinds: dict) -> list[str]:
        """Pieces of normalized text."""
        if kinds:
            return self._cut_by_class(low, kinds)
        return PIECES.findall(low) if BEYOND_LATIN.search(low) else LATIN.findall(low)

    @staticmethod
    def kind(c: str, kinds: dict) -> str:
        return kinds.get(c) or ("L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "S" if regex.match(r"\s", c) else "P")

    def _cut_by_class(self, text: str, kinds: dict) -> list[str]:
        """The pattern as a state machine over character classes, for characters whose class differs between tables."""
        kind_of = [self.kind(c, kinds) for c in text]
        out, i = [], 0
        while i < len(text):
            short = next((c for c in CONTRACTIONS if text.startswith(c, i)), None)
            if short:
                out.append(short)
                i += len(short)
            elif kind_of[i] == "S":
                i += 1
            elif kind_of[i] == "N":
                out.append(text[i])
                i += 1
            else:
                j = i
                while j < len(text) and kind_of[j] == kind_of[i]:
                    j += 1
                out.append(text[i:j])
                i = j
        return out

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Text between special tokens, and the id of the special token that follows."""
        at = 0
        for m in self.specials.finditer(text):
            yield text[at : m.start()], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def encode_ids(self, text: str) -> list[int]:
        """All ids of a text."""
        if "<|" not in text:
            return list(chain.from_iterable(map(self.cache.__getitem__, self.pieces(text))))
        ids: list[int] = []
        for part, special in self.segments(text):
            ids += chain.from_iterable(map(self.cache.__getitem__, self.pieces(part)))
            if special is not None:
                ids.append(special)
        return ids

    def encode_packed(self, texts: list[str]) -> list[bytes]:
        """All ids of each text as unsigned 32-bit integers."""
        cut = [None if "<|" in t else self.pieces(t) for t in texts]
        self.learn(chain.from_iterable(filter(None, cut)))
        get = self.packed.__getitem__
        return [array("I", self.encode_ids(t)).tobytes() if p is None else b"".join(map(get, p)) for t, p in zip(texts, cut, strict=True)]

    def encode_arrays(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after the other, and how many each text has.

        Latin texts are cut together, byte by byte in numpy; every distinct piece is merged or looked up once, and ids are
        gathered by piece. Others take the plain way.
        """
        low, plain = [], {}
        for k, t in enumerate(texts):
            said = t.lower() if t.isascii() else unicodedata.normalize("NFC", t).lower()
            if "<|" in t or not (t.isascii() or said.isascii()) and BEYOND_LATIN.search(said):
                plain[k], said = np.frombuffer(self.encode_packed([t])[0], "<u4"), ""
            low.append(said.encode("utf-8", "surrogatepass"))
        ids, n = self._in_parts(low)
        if not plain:
            return ids, n
        parts = np.split(ids, np.cumsum(n)[:-1])
        for k, x in plain.items():
            parts[k], n[k] = x, len(x)
        return np.concatenate(parts), n

    def known_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pieces; new ones are merged all at once. Two generations: a full one becomes the old one."""
        new = [p for p in pieces if p not in self.by_bytes]
        if new:
            if len(self.by_bytes) + len(new) > PACKED:
                self.old_bytes, self.by_bytes = self.by_bytes, {}
                new = pieces
            old = self.old_bytes
            met = {p: old[p] for p in new if p in old}
            fresh = [p for p in new if p not in met] if met else new
            short = [p for p in fresh if len(p) <= WIDTHS[-1]]
            met.update(zip(short, self.merge_many(short), strict=True))
            met.update((p, array("I", self._made(p.decode("utf-8", "surrogatepass"))).tobytes()) for p in fresh if len(p) > WIDTHS[-1])
            self.by_bytes.update(met)
        pool = [self.by_bytes[p] for p in pieces]
        for p in new:
            if len(p) > LONG_PIECE:
                del self.by_bytes[p]
        return pool

    def _in_parts(self, low: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_latin_ids`` of texts in parts of about ``PART_BYTES``."""
        ids, n, held, owners, size = [np.zeros(0, "<u4")], np.zeros(len(low), np.int64), [], [], 0

        def flush():
            found, many = self._latin_ids(held)
            ids.append(found)
            np.add.at(n, owners, many)

        for k, part in cut_at_blanks(low):
            held.append(part)
            owners.append(k)
            size += len(part)
            if size >= PART_BYTES:
                flush()
                held, owners, size = [], [], 0
        if held:
            flush()
        return np.concatenate(ids), n

    def _latin_ids(self, low: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b"\n".join(low) + bytes(16)
        start, end = latin_pieces(np.frombuffer(raw, np.uint8)[:-16])
        size = end - start
        which, first = distinct_pieces(raw, start, size)
        own = [raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        pool = self.known_ids(own)
        ids = np.frombuffer(b"".join(pool), "<u4")
        many = np.fromiter(map(len, pool), np.int32, len(pool)) >> 2
        n = many[which]
        ends = np.cumsum(n, dtype=np.int64)
        place = ((np.cumsum(many) - many)[which] - (ends - n)).astype(np.int32)
        out = ids[np.repeat(place, n) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]
        cuts = np.searchsorted(start, np.cumsum([len(x) + 1 for x in low]))  # pieces up to the end of each text
        return out, np.diff(np.r_[0, np.r_[0, ends][cuts]])

    def decimal(self, ids: Iterable[int]) -> str:
        """The ids in decimal, joined by a space."""
        numerals = self.numerals
        return " ".join([numerals[i] for i in ids])

    def decode(self, ids: Iterable[int]) -> str:
        """The library's decoding for a file without a decoder: the tokens' own strings, joined by a space."""
        tokens = self.tokens
        return " ".join([tokens[i] for i in ids])

    def token_bytes(self, i: int) -> bytes:
        """The text bytes of a token; the end of a word is a space."""
        t = self.tokens[i]
        if i in self.special.values():
            return t.encode()
        back = self.__dict__.setdefault("_back", {c: b for b, c in enumerate(self.alphabet)})
        return bytes(back[c] for c in t.removesuffix(END)) + (b" " if t.endswith(END) else b"")


class PieceStream:
    """Bytes of one unfinished piece in, stable ids out; holds at most a few times the lookahead."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.held = bpe, bytearray()

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        least = self.bpe.lookahead
        if least is None:
            self.held += raw
            return out
        step = 4 * least
        for at in range(0, len(raw), step):
            self.held += raw[at : at + step]
            if len(self.held) <= 2 * least:
                continue
            ids, size = self.bpe.merge([self.bpe.inner[b] for b in self.held]), 0
            for i in ids:
                if size + len(self.bpe.tokens[i]) > len(self.held) - least:
                    break
                size += len(self.bpe.tokens[i])
                out.append(i)
            del self.held[:size]
        return out

    def end(self) -> list[int]:
        if not self.held:
            return []
        raw, self.held = bytes(self.held), bytearray()
        return self.bpe.merge([self.bpe.inner[b] for b in raw[:-1]] + [self.bpe.final[raw[-1]]])


class Unbroken:
    """Text without blanks in, stable ids out: holds the end that composition, a special token or the last two pieces
    can still change."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.raw, self.low = bpe, "", ""
        self.kinds: dict = {}
        self.run: tuple[str, PieceStream] | None = None
        self.reach = max(map(len, bpe.special), default=1)

    def feed(self, text: str) -> list[int]:
        self.raw += text
        cut = len(self.raw) - self.reach
        while cut > 0 and not safe_start(self.raw[cut]):
            cut -= 1
        if cut <= 0:
            return []
        spans = [m.span() for m in self.bpe.specials.finditer(self.raw)]
        cut = next((s for s, e in spans if s < cut < e), cut)
        done, self.raw = self.raw[:cut], self.raw[cut:]
        return self._segments(done)

    def end(self) -> list[int]:
        done, self.raw = self.raw, ""
        return self._segments(done) + self._close()

    def _segments(self, text: str) -> list[int]:
        out: list[int] = []
        for part, special in self.bpe.segments(text):
            low, kinds = self.bpe.normalized(part)
            self.kinds |= kinds
            out += self._pieces(low)
            if special is not None:
                out += [*self._close(), special]
        return out

    def _pieces(self, low: str) -> list[int]:
        out: list[int] = []
        if self.run:
            kind, stream = self.run
            n = 0
            while n < len(low) and self.bpe.kind(low[n], self.kinds) == kind:
                n += 1
            out += stream.feed(low[:n].encode("utf-8", "surrogatepass"))
            if n == len(low):
                return out
            out += stream.end()
            self.run, low = None, low[n:]
        self.low += low
        pieces = self.bpe.cut(self.low, self.kinds)
        for p in pieces[:-2]:
            out += self.bpe.cache[p]
        at = len(self.low)
        for p in pieces[:-3:-1]:
            at = self.low.rindex(p, 0, at)
        self.low = self.low[at:]
        if pieces and len(pieces[-1]) > LONG_PIECE:  # too long to be a contraction, and the piece before it ends where it begins
            for p in pieces[-2:-1]:
                out += self.bpe.cache[p]
            self.run = (self.bpe.kind(pieces[-1][0], self.kinds), PieceStream(self.bpe))
            out += self.run[1].feed(pieces[-1].encode("utf-8", "surrogatepass"))
            self.low = ""
        return out

    def _close(self) -> list[int]:
        out = self.run[1].end() if self.run else []
        out += chain.from_iterable(map(self.bpe.cache.__getitem__, self.bpe.cut(self.low, self.kinds)))
        self.run, self.low, self.kinds = None, "", {}
        return out

    @property
    def held(self) -> int:
        return len(self.raw) + len(self.low) + (len(self.run[1].held) if self.run else 0)


class StreamingEncoder:
    """Text chunks in, stable ids out; all text up to the last blank is stable."""

    def __init__(self, bpe: WordBpe) -> None:
        self.bpe, self.held = bpe, ""
        self.unbroken: Unbroken | None = None

    def feed(self, chunk: str) -> list[int]:
        out: list[int] = []
        if self.unbroken:
            blank = min((i for i in (chunk.find(" "), chunk.find("\n")) if i >= 0), default=-1)
            if blank < 0:
                return self.unbroken.feed(chunk)
            out = self.unbroken.feed(chunk[:blank]) + self.unbroken.end()
            self.unbroken, chunk = None, chunk[blank:]
        self.held += chunk
        cut = 1 + max(self.held.rfind(" "), self.held.rfind("\n"))
        if cut:
            done, self.held = self.held[:cut], self.held[cut:]
            out += self.bpe.encode_ids(done)
        if len(self.held) > HOLD:
            self.unbroken, done, self.held = Unbroken(self.bpe), self.held, ""
            out += self.unbroken.feed(done)
        return out

    def end(self) -> list[int]:
        out: list[int] = []
        if self.unbroken:
            out += self.unbroken.end()
            self.unbroken = None
        done, self.held = self.held, ""
        return out + self.bpe.encode_ids(done)


class ByteTextDecoder:
    """Bytes to text, one token at a time: keeps only the bytes of an unfinished character; bad bytes become U+FFFD."""

    def __init__(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, raw: bytes) -> str:
        return self.state.decode(raw)

    def end(self) -> str:
        return self.state.decode(b"", final=True)


class StreamingDecoder:
    """Ids in, the library's decoding out: the tokens' strings joined by a space, by an incremental byte-to-text machine."""

    def __init__(self, bpe: WordBpe) -> None:
        self.utf8, self.bytes, self.begun = bpe.token_utf8, ByteTextDecoder(), False

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        raw = b" ".join(map(self.utf8.__getitem__, ids))
        raw, self.begun = (b" " + raw if self.begun else raw), True
        return self.bytes.feed(raw)

    def end(self) -> str:
        return self.bytes.end()


def decode_text(bpe: WordBpe, ids: Iterable[int]) -> str:
    """The (lower-cased, space-separated) text that ids stand for."""
    state = ByteTextDecoder()
    return ("".join(state.feed(bpe.token_bytes(i)) for i in ids) + state.end()).removesuffix(" ")


def stream_ids(bpe: WordBpe, text: str, chunk: int = CHUNK) -> Iterator[list[int]]:
    """The ids of a text as the transducer gives them out."""
    machine = StreamingEncoder(bpe)
    for at in range(0, len(text), chunk):
        yield machine.feed(text[at : at + chunk])
    yield machine.end()


_BPE: dict[int, WordBpe] = {}


def bpe_of(spec: str) -> WordBpe:
    """One encoder, with its cache, per worker process and tokenizer file."""
    key = hash(spec)
    if key not in _BPE:
        _BPE.clear()
        _BPE[key] = WordBpe(spec)
    KEPT["bpe"] = _BPE.clear
    return _BPE[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded; one row per input row. The tokenizer file (a few MB) is read on the driver.

    A null text is the empty text: no tokens, '' decoded. Rows are independent, so repeated rows repeat.
    """
    tune(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches):
        bpe = bpe_of(spec.value)
        for b in batches:
            ids, texts = [], []
            for t in b.column(1).to_pylist():
                decoder, own, parts = StreamingDecoder(bpe), [], []
                for more in stream_ids(bpe, t or ""):
                    own += more
                    parts.append(decoder.feed(more))
                ids.append(own)
                texts.append("".join(parts) + decoder.end())
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string()),
            ], ["doc_id", "n_tokens", "ids", "decoded"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of ``encode_decode``; ids and text are hashed as the machines give them
    out, so a text of any length needs no more than its chunks."""
    tune(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer))

    def run(batches):
        bpe = bpe_of(spec.value)
        out: list[tuple] = []
        for doc, text in rows_of(batches):
            decoder, said, back, n = StreamingDecoder(bpe), hashlib.sha256(), hashlib.sha256(), 0
            for ids in stream_ids(bpe, text or ""):
                if ids:
                    said.update((" " * (n > 0) + bpe.decimal(ids)).encode())
                    back.update(decoder.feed(ids).encode("utf-8", "surrogatepass"))
                    n += len(ids)
            back.update(decoder.end().encode("utf-8", "surrogatepass"))
            out.append((doc, n, said.hexdigest(), back.hexdigest()))
            if len(out) >= 2000:
                yield digest_batch(out)
                out = []
        if out:
            yield digest_batch(out)

    def digest_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(docs).mapInArrow(trimmed(run, "bpe"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

