"""Personal data by fixed patterns and a skip-chain conditional random field (operator 7).

The fixed patterns give the base spans. The field adds what they do not see: phone numbers in national layouts, account
numbers (iban) and secrets (keys and tokens). Its nodes are the tokens that hold a digit or an ``@``; all others are
outside any entity. Neighbouring nodes form a linear chain; nodes of one document with the same or a similar form (digits
and letters folded) are linked by skip edges, each to its next occurrence, so the edges grow with the tokens and not with
the square of a group. Loopy message passing over all edges of a block of documents at once gives the marginals. Nodes
inside a base span are observed, and their evidence reaches the repeated and similar tokens elsewhere in the document; a
number that stands once behind "tel." is found again where it stands bare.

The field is trained here, on ``TRAIN_TEXTS`` sentences made from templates with every kind of entity and of other
numbers (dates, prices, versions, orders), so no label of the corpus is needed and no text of it is gathered: node weights
by softmax regression, edge potentials from smoothed pair counts.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents, rows_of, tune

#: Kinds of the base contract, and all kinds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "secret"]
TRAIN_TEXTS = 2000
MARGINAL, ROUNDS = 0.9, 8
#: Nodes and characters of the documents that are judged at once, and nodes whose messages are made at once.
BLOCK_NODES, BLOCK_CHARS, STEP = 50_000, 4 << 20, 1 << 14

# Fixed values of the base contract.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

TOKEN = re.compile(r"[A-Za-z0-9@._%+()/:-]*[0-9@][A-Za-z0-9@._%+()/:-]*")
DIGIT = re.compile(r"[0-9]")
#: Words before a token that tell its kind; the number of a list is a feature.
CUES = [
    ["tel", "telefon", "phone", "call", "fon", "mobile", "mobil", "fax", "ring", "telephone", "cell", "handy", "numero", "teléfono", "téléphone"],
    ["token", "key", "secret", "password", "passwd", "apikey", "api", "bearer", "auth", "pwd", "credential", "hash"],
    ["iban", "account", "konto", "bank", "cuenta", "compte"],
    ["card", "visa", "mastercard", "karte"],
    ["mail", "email", "contact", "write"],
    ["ip", "host", "server", "address"],
    ["on", "date", "since", "year", "born", "until", "am", "le", "en"],
    ["order", "no", "nr", "number", "id", "item", "invoice", "ref", "isbn", "page", "article"],
    ["version", "v", "release", "license", "by"],
    ["usd", "eur", "cost", "price", "total", "about", "for"],
]
CUE_OF = {w: i for i, words in enumerate(CUES) for w in words}
N_FEATURES = 112


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Anchored at each ``@``: the local part is the run before it, not before the last match; linear in the text."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and at >= end and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive; leftmost non-overlapping per kind, failing matches dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    if "@" in text:
        out["email"] = emails(text)
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP.finditer(text) if all(len(x) < 4 and int(x or "0") <= 255 for p in m[0].split(".") for x in [p.lstrip("0")])]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def form(token: str) -> str:
    """The similarity key of a token: letters lower-cased, digits folded, end punctuation dropped."""
    return re.sub(r"[0-9]+", lambda m: "0" * len(m[0]), token.strip(".,:;()").lower())


def features(token: str, before: str, after: str) -> list[int]:
    """Active features of a token, numbers below N_FEATURES."""
    core = token.strip(".,:;()\"'")
    digits = sum("0" <= c <= "9" for c in core)
    parts = core.split(".")
    letters = sum(c.isalpha() for c in core)
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    on = [0, 1 + min(digits, 20), 24 + min(core.count("."), 5), 32 + min(core.count("-"), 5), 40 + min(letters, 7)]
    on += [48] if "@" in token else []
    on += [49] if token.startswith("+") else []
    on += [50] if before.endswith("+") else []
    on += [51] if len(parts) == 4 and all(0 < len(p) < 4 and p.isdigit() and int(p) <= 255 for p in parts) else []
    on += [52] if "(" in token or ")" in token else []
    on += [53] if re.search(r"@[A-Za-z0-9-]+\.", token) else []
    on += [54] if before.endswith("\n") or not before else []
    on += [55] if digits == len(core) else []
    on += [56] if len(core) >= 16 and letters and digits and turns >= 5 else []
    on += [57] if len(core) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core) and letters else []
    on += [58] if re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]*", core) else []
    on += [59] if re.search(r"[=:]\s*[\"']?$", before) else []
    on += [60] if core.startswith("0") and digits > 1 else []
    on += [61] if "/" in core or "%" in core else []
    on += [62 + min(len(core) // 4, 9)]
    words = re.findall(r"[a-zà-ÿ]+", before.lower())[-2:]
    on += [72 + i for i in {CUE_OF[w] for w in words if w in CUE_OF}]
    on += [82 + i for i in {CUE_OF[w] for w in words[-1:] if w in CUE_OF}]
    on += [92] if re.search(r"[0-9@]\S*\s?$", before) else []
    on += [93 + min(len(re.findall(r"[0-9]", after)), 7)]
    on += [101] if re.search(r"[$€£]\s?$", before) or re.match(r"\s?(?:[$€£%]|eur|usd)", after.lower()) else []
    return on


class Nodes:
    """Tokens of a block of documents in arrays, some 70 bytes each: place, label of the span they lie in (0: none), numbers of their
    features one after the other, whether the token before is a neighbour, and the tokens of the same form before and after."""

    def __init__(self, texts: list[str] = (), known: list[dict[str, list[tuple[int, int]]]] = ()) -> None:
        self.doc, self.start, self.end, self.label, self.joined = array("i"), array("q"), array("q"), array("b"), array("b")
        self.flat, self.first, self.before, self.docs = array("B"), array("q"), array("i"), 0
        for text, base in zip(texts, known, strict=True):
            self.add(text, base)

    def __len__(self) -> int:
        return len(self.doc)

    def add(self, text: str, base: dict[str, list[tuple[int, int]]]) -> None:
        spans = sorted((s, e, 1 + KINDS.index(k)) for k, x in base.items() for s, e in x)
        last, at, stop = {}, 0, None
        for m in TOKEN.finditer(text):
            while at < len(spans) and spans[at][1] <= m.start():
                at += 1
            self.label.append(next((k for s, e, k in spans[at : at + len(KINDS)] if s < m.end() and e > m.start()), 0))
            self.doc.append(self.docs)
            self.start.append(m.start())
            self.end.append(m.end())
            self.first.append(len(self.flat))
            self.flat.extend(features(m[0], text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 16]))
            self.joined.append(stop is not None and m.start() - stop <= 2)
            key, stop = form(m[0]), m.end()
            self.before.append(last.get(key, -1))
            last[key] = len(self.doc) - 1
        self.docs += 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Sum of each node's feature weights, some thousand nodes at a time."""
        out = np.zeros((len(self), weights.shape[1]), np.float32)
        flat, first = np.frombuffer(self.flat, np.uint8) if len(self.flat) else np.zeros(0, np.uint8), np.append(np.array(self.first, np.int64), len(self.flat))
        for lo in range(0, len(self), STEP):
            hi = min(lo + STEP, len(self))
            out[lo:hi] = np.add.reduceat(weights[flat[first[lo] : first[hi]]], first[lo:hi] - first[lo])
        return out

    def links(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """For chain and skip edges: the node at the other end before each node, and behind it (-1: none)."""
        n = len(self)
        left = np.where(np.array(self.joined, bool), np.arange(n) - 1, -1)
        right = np.where(np.append(np.array(self.joined, bool)[1:], False), np.arange(n) + 1, -1) if n else left
        before, after = np.array(self.before, np.int64), np.full(n, -1, np.int64)
        own = np.flatnonzero(before >= 0)
        after[before[own]] = own
        return (left, right), (before, after)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the chain edges and of the skip edges."""
        return tuple(np.stack([side[side >= 0], np.flatnonzero(side >= 0)], 1) for side, _ in self.links())


def train(nodes: Nodes) -> dict[str, np.ndarray]:
    """Weights: node (features x kinds), chain and skip (kinds x kinds, logs)."""
    k, label = len(KINDS) + 1, np.array(nodes.label, np.int64)
    x = np.zeros((len(nodes), N_FEATURES), np.float32)
    x[np.repeat(np.arange(len(nodes)), np.diff([*nodes.first, len(nodes.flat)])), np.array(nodes.flat, np.int64)] = 1
    w, y = np.zeros((N_FEATURES, k), np.float32), np.eye(k, dtype=np.float32)[label]
    for _ in range(300 if len(x) else 0):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 2.0 * (x.T @ (p - y) / len(x) + 1e-4 * w)

    def lifts(edges: np.ndarray) -> np.ndarray:
        counts = np.ones((k, k))
        if len(edges):
            np.add.at(counts, (label[edges[:, 0]], label[edges[:, 1]]), 1)
        both = counts / counts.sum()
        lift = np.log(both / np.outer(both.sum(axis=1), both.sum(axis=0)))
        return np.clip(lift, -2.0, 2.0)  # weak enough for message passing to settle

    chain, skip = map(lifts, nodes.pairs())
    return {"node": w, "chain": chain, "skip": (skip + skip.T) / 2}


def sent(belief: np.ndarray, back: np.ndarray, old: np.ndarray, source: np.ndarray, lift: np.ndarray) -> np.ndarray:
    """New messages, half old: to each node from ``source`` (-1: none), whose belief is taken without what came from the node (``back``)."""
    out = np.zeros_like(old)
    own = np.flatnonzero(source >= 0)
    for lo in range(0, len(own), STEP):
        to = own[lo : lo + STEP]
        cavity = belief[source[to]] - back[source[to]]
        cavity -= cavity.max(axis=1, keepdims=True)
        new = np.log(np.exp(cavity) @ lift)
        out[to] = 0.5 * old[to] + 0.5 * (new - new.max(axis=1, keepdims=True))
    return out


def marginals(nodes: Nodes, model: dict[str, np.ndarray]) -> np.ndarray:
    """Loopy belief propagation, all messages at once, damped; a fixed number of rounds.

    A node has one neighbour of each sort at most (before and behind it in the chain, and of its form), so messages are four arrays by node:
    some 200 bytes a node. The two potentials are shared by all edges.
    """
    node = nodes.scores(model["node"])
    node -= node.max(axis=1, keepdims=True)
    node -= np.log(np.exp(node).sum(axis=1, keepdims=True))
    label = np.array(nodes.label, np.int64)
    known = np.flatnonzero(label)
    node[known] = -30.0
    node[known, label[known]] = 0.0
    ways = [(near, far, np.exp(model[kind]).astype(np.float32)) for (near, far), kind in zip(nodes.links(), ("chain", "skip"), strict=True)]
    messages = [[np.zeros_like(node), np.zeros_like(node)] for _ in ways]
    for _ in range(ROUNDS if any((near >= 0).any() for near, _, _ in ways) else 0):
        belief = node + sum(m for both in messages for m in both)
        for both, (near, far, lift) in zip(messages, ways, strict=True):
            forth, back = both
            both[0] = sent(belief, back, forth, near, lift)
            both[1] = sent(belief, forth, back, far, lift.T)
    belief = node + sum(m for both in messages for m in both)
    belief -= belief.max(axis=1, keepdims=True)
    np.exp(belief, out=belief)
    return belief / belief.sum(axis=1, keepdims=True)


def added_spans(nodes: Nodes, p: np.ndarray, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Runs of neighbouring tokens of one kind above the marginal that touch no base span; stray marks at the ends go."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    best = p.argmax(axis=1)
    held: tuple[str, int, int, int] | None = None  # kind, first node, last node, document

    def put():
        kind, first, last, doc = held
        s, e = nodes.start[first], nodes.end[last]
        while s < e and texts[doc][s] in ".,:;/-)%":
            s += 1
        while s < e and texts[doc][e - 1] in ".,:;/-(%":
            e -= 1
        if s < e:
            out[doc].append((kind, s, e))

    for i in np.flatnonzero((best > 0) & (p.max(axis=1) >= MARGINAL) & (np.array(nodes.label) == 0)).tolist():
        kind = KINDS[best[i] - 1]
        if held and held[2] == i - 1 and held[0] == kind and nodes.joined[i]:
            held = (kind, held[1], i, held[3])
            continue
        if held:
            put()
        held = (kind, i, i, nodes.doc[i])
    if held:
        put()
    return out


def made_text(rng: random.Random) -> tuple[str, dict[str, list[tuple[int, int]]]]:
    """A text from templates, and the spans of its entities: with a cue, without one, and again later in the text."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 9)))
    phones = [lambda: f"(0{d(2)}) {d(4)}-{d(4)}", lambda: f"0{d(3)} {d(7)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"({d(3)}) 555-{d(4)}", lambda: f"00{d(2)} {d(2)} {d(4)} {d(4)}", lambda: f"0{d(3)}/{d(6)}", lambda: f"+{d(2)} ({d(3)}) {d(3)}-{d(4)}"]
    secrets = [lambda: "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))), lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789") for _ in range(rng.choice([20, 24, 32, 40]))) + "7", lambda: "".join(rng.choice("0123456789ABCDEF") for _ in range(40))]
    ibans = [lambda: f"{rng.choice(['DE', 'FR', 'ES', 'GB'])}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"{rng.choice(['DE', 'NL', 'AT'])}{d(20)}"]
    emails_ = [lambda: f"{word()}.{d(2)}@{word()}{d(1)}.example.com"]
    ips = [lambda: ".".join(str(rng.randrange(256)) for _ in range(4))]
    others = [
        lambda: f"on {rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1900, 2030)}", lambda: f"on {rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: f"version {d(1)}.{d(1)}", lambda: f"v{d(1)}.{d(2)}.{d(1)}",
        lambda: f"${d(rng.randint(1, 4))}.{d(2)}", lambda: f"{d(rng.randint(1, 6))} eur", lambda: f"order no {d(rng.randint(5, 12))}", lambda: f"{rng.randint(1900, 2030)}", lambda: d(rng.randint(1, 3)), lambda: f"{d(2)}%", lambda: f"isbn 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        lambda: d(16), lambda: f"{word()}{d(1)}", lambda: f"{d(1)}.{d(2)}", lambda: f"{d(2)}:{d(2)}", lambda: f"pages {d(2)}-{d(3)}", lambda: f"item {d(6)}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: f"{word()}-{d(4)}", lambda: f"section {d(1)}.{d(1)}.{d(1)}",
        lambda: f"id {d(3)}-{d(6)}", lambda: f"{d(4)}/{d(4)}", lambda: f"by {d(1)}.{d(1)}.", lambda: d(rng.randint(7, 11)),
    ]
    cues = {"phone": ["tel. ", "call ", "phone: ", "fax ", "mobile "], "secret": ['token = "', "key: ", "secret=", "password: ", 'api key "'], "iban": ["iban ", "account ", "iban: "], "email": ["mail ", "email: ", ""], "ip": ["host ", "server ", ""]}
    makers = {"phone": phones, "secret": secrets, "iban": ibans, "email": emails_, "ip": ips}
    text, spans, again = "", {k: [] for k in KINDS}, []
    for _ in range(rng.randint(3, 9)):
        text += " ".join(word() for _ in range(rng.randint(1, 6))) + " "
        if rng.random() < 0.55:
            text += rng.choice(others)() + rng.choice(["", ",", "."]) + " "
            continue
        if again and rng.random() < 0.4:
            kind, value, cue = *rng.choice(again), ""
        else:
            kind = rng.choice(list(makers))
            value = rng.choice(makers[kind])()
            cue = rng.choice(cues[kind]) if kind in ("email", "ip") or rng.random() < 0.9 else ""
            again.append((kind, value))
        text += cue
        spans[kind].append((len(text), len(text) + len(value)))
        text += value + ('"' if cue.endswith('"') else rng.choice(["", ",", "."])) + rng.choice([" ", "\n"])
    return text, spans


@functools.cache
def fit(texts: int = TRAIN_TEXTS, seed: int = 11) -> dict[str, np.ndarray]:
    """Train on ``texts`` made texts; the same numbers give the same model."""
    rng = random.Random(seed)
    made = [made_text(rng) for _ in range(texts)]
    return train(Nodes([t for t, _ in made], [s for _, s in made]))


def personal_data(docs: DataFrame, model: dict[str, np.ndarray] | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; one row per input row.

    The counts and the digest are of base spans; ``spans`` has the field's too, of the base kinds, ``iban`` and
    ``secret``, none of them inside or across a base span. A null or empty text has none. Repeated rows repeat, a null
    doc_id is a row like any other, other columns are not read. Documents are judged in blocks of ``BLOCK_NODES`` tokens with a digit or
    an @; a text is never cut, so one that is made of nothing else needs some 300 bytes a token.
    """
    tune(docs.sparkSession)
    field = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit())
    names = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def judge(held, nodes):
        texts = [t for _, t, _ in held]
        more = added_spans(nodes, marginals(nodes, field.value), texts) if len(nodes) else [[] for _ in held]
        rows = []
        for (doc, _, base), extra in zip(held, more, strict=True):
            own = [(k, s, e) for k in BASE for s, e in base[k]]
            both = sorted({*own, *extra}, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
            said = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
            rows.append((doc, *(len(base[k]) for k in BASE), hashlib.sha256(said.encode()).hexdigest(), ",".join(f"{k}:{s}:{e}" for k, s, e in both)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        held, nodes, n = [], Nodes(), 0
        for doc, text in rows_of(batches):
            held.append((doc, text or "", base_spans(text or "")))
            nodes.add(*held[-1][1:])
            n += len(held[-1][1])
            if n >= BLOCK_CHARS or len(nodes) >= BLOCK_NODES:
                yield judge(held, nodes)
                held, nodes, n = [], Nodes(), 0
        if held:
            yield judge(held, nodes)

    return documents(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
