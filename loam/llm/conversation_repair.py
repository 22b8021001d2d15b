"""Repair of the turn structure of conversations by dynamic programming over a shared prefix trie (operator 11).

Every turn becomes one symbol: its role (system, user, assistant, other) and its fault. The symbols of a conversation are its
signature. Signatures are sorted and walked as a prefix trie: a stack holds the DP layers of the current path, the next
signature cuts it back to the common prefix and computes only the layers that are new, and the answer is read at the terminal
node. Equal signatures cost one comparison. Ranges of signatures go to tasks, so a prefix is computed once but for the
borders of ranges, and a signature that very many conversations have is split by conv_id.

A DP layer knows, for each state of the grammar ``(s?(ua)+)?`` (nothing yet, after s, u, a), the least cost and the rank of
the ASCII-least edit string among the four. Strings that end with the edit of the same turn are never prefixes of one another,
so ranks compare them for good and no string is kept: a layer is 40 bytes.

Texts are shipped once, for the repaired turns, and streamed in order: a task holds a conversation's signature and edits (a
byte a turn each) and the digests of its turns, never its texts.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions_for, tune

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one turn that may be inserted, or given a new role, in each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept turn of each role, by state.
KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: (state before, inserts) that lead to each state; longer ways cost more.
WAYS = [[(START, 0)], [(SYSTEM, 0)], [(USER, 0), (START, 1), (SYSTEM, 1), (ASSISTANT, 1)], [(ASSISTANT, 0), (USER, 1), (START, 2), (SYSTEM, 2)]]
EDITS = "DKR"
INF = 1 << 60
GONE = "x"  # the symbol of a turn that must be deleted
SPACE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}


class Layers:
    """The DP layers along one path of the trie."""

    def __init__(self) -> None:
        self.path = ""
        self.cost, self.rank, self.back = array("q", [0, INF, INF, INF]), bytearray(4), bytearray(4)

    def go(self, signature: str) -> None:
        """Move to the node of ``signature``; layers of the common prefix stay."""
        same, most = 0, min(len(signature), len(self.path))
        while same < most and signature[same : same + 64] == self.path[same : same + 64]:
            same += 64
        same = min(same, most)
        while same < most and signature[same] == self.path[same]:
            same += 1
        for x in (self.cost, self.rank, self.back):
            del x[4 * (same + 1) :]
        for symbol in signature[same:]:
            self.push(symbol)
        self.path = signature

    def _best(self) -> list[tuple[int, int, int, int]]:
        """For each state: least cost, rank, state before and inserts, after inserts behind the last turn."""
        cost, rank = self.cost[-4:], self.rank[-4:]
        return [min((cost[p] + t * INSERT, rank[p], p, t) for p, t in ways) for ways in WAYS]

    def push(self, symbol: str) -> None:
        best: list[tuple | None] = [None] * 4
        role, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        for q, (cost, rank, p, t) in enumerate(self._best()):
            if cost >= INF:
                continue
            to = [(q, "D", DELETE)]
            if symbol != GONE:
                to.append((NEXT[q], "R", REROLE + more))
                if (kept := KEEP.get(role, {}).get(q)) is not None:
                    to.append((kept, "K", more))
            for state, edit, price in to:
                way = (cost + price, rank, "I" * t + edit, p, t)
                if best[state] is None or way < best[state]:
                    best[state] = way
        ranks = {x[1:3]: i for i, x in enumerate(sorted((x for x in best if x), key=lambda x: x[1:3]))}
        for x in best:
            self.cost.append(x[0] if x else INF)
            self.rank.append(ranks[x[1:3]] if x else 0)
            self.back.append(x[3] * 12 + x[4] * 3 + EDITS.index(x[2][-1]) if x else 0)

    def answer(self) -> tuple[int, str]:
        """Cost and edits of the conversation that ends here."""
        all_best = self._best()
        cost, _, state, t = min(all_best[START], all_best[ASSISTANT])
        out = ["I" * t]
        for i in range(len(self.back) // 4 - 1, 0, -1):
            code = self.back[4 * i + state]
            state, t, edit = code // 12, code // 3 % 4, EDITS[code % 3]
            out.append("I" * t + edit)
        return cost, "".join(reversed(out))


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the repaired turns, in order; ``turns``: the roles and texts that the audit is about."""
    state = START
    for edit in audit:
        if edit == "I":
            state = NEXT[state]
            yield edit, ROLE[state], ""
            continue
        role, text = next(turns)
        if edit == "D":
            continue
        if edit == "R":
            state = NEXT[state]
            role = ROLE[state]
        else:
            state = KEEP[role[0]][state]
        yield edit, role, text


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with one turn in four spoiled, by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20: 0
    drops it, 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it the user's. Null roles and texts become one space."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat_ws(":", *said[:2]).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said[2].alias("role"), said[3].alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in the last two, and the digest of both, by which ties are ordered."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    both = F.concat_ws(":", F.length(role).cast("string"), role, text)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.unhex(F.sha2(both, 256)).alias("digest"))


def _in_order(rows: DataFrame, lead: str) -> DataFrame:
    """Conversations one after the other, each by ``lead``, turn (nulls first), role and digest."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), lead, F.col("turn").asc_nulls_first(), "role", "digest")


def _groups(batches) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its rows without it) of sorted Arrow batches; rows are read as they are asked for."""
    rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True) for b in batches)
    head = next(rows, None)

    def own(first: tuple) -> Iterator[tuple]:
        nonlocal head
        head = first
        while head is not None and head[0] == first[0]:
            out, head = head, next(rows, None)
            yield out[1:]

    while head is not None:
        turns = own(head)
        yield head[0], turns
        for _ in turns:  # what was not asked for
            pass


def _sign(batches):
    """Counts and signature of each conversation."""
    kinds = [pa.int64()] * 6 + [pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "signature"]
    out = []
    for conv, turns in _groups(batches):
        seen, symbols, times, before, illegal, faults = set(), [], None, None, 0, [0, 0, 0]
        distinct, last = 0, None
        for there, turn, role, digest, end in turns:
            if not there:
                continue
            initial = role[:1]
            illegal += before is not None and before + initial not in LEGAL
            before = initial
            if turn is not None:
                times = (turn, turn) if times is None else (times[0], turn)
                distinct += turn != last
                last = turn
            symbol = initial if initial in KEEP else "o"
            if not end:
                faults[0] += 1
                symbol = GONE
            elif digest in seen:
                faults[1] += 1
                symbol = GONE
            elif end not in ".!?":
                faults[2] += 1
                symbol = symbol.upper()
            seen.add(digest)
            symbols.append(symbol)
        gaps = times[1] - times[0] + 1 - distinct if times else 0
        out.append((conv, gaps, *faults, illegal, "".join(symbols)))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def _solve(batches):
    """Cost and audit of sorted signatures, along one trie."""
    layers, said = Layers(), None
    for b in batches:
        found = []
        for signature in b.column("signature").to_pylist():
            if said is None or signature != layers.path:
                layers.go(signature)
                said = layers.answer()
            found.append(said)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(i) for i in range(b.num_columns)), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], [*b.schema.names, "cost", "audit"]
        )


def audits(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, signature, cost, audit: one row per conversation.

    Turns are taken by ``turn`` (nulls first), then role, then digest of both; null roles and texts read as one space, a null
    conv_id is a conversation like any other. ``ids`` (conv_id) names conversations that are reported even without a turn: all
    zeros, empty audit. Columns beside conv_id, turn, role and text are not read.
    """
    spark = rows.sparkSession
    tune(spark)
    turns = _turns(rows)
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    lean = turns.select("conv_id", F.lit(1).alias("there"), "turn", "role", "digest", end.alias("last"))
    if ids is not None:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("last", "string"))]
        lean = lean.unionByName(ids.select(F.col("conv_id").cast("long")).distinct().select("conv_id", F.lit(0).alias("there"), *none))
    signs = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, signature string"
    signed = materialize(_in_order(lean, "there").mapInArrow(_sign, signs), "signatures")
    ranged = signed.repartitionByRange(partitions_for(spark), "signature", "conv_id").sortWithinPartitions("signature", "conv_id")
    return ranged.mapInArrow(_solve, signs + ", cost long, audit string")


#: What ``audits`` says of a conversation besides its id.
REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _with_turns(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The audits and then the turns of each conversation, in order: conv_id, REPORT, audit (null for turns), role, text."""
    turns = _turns(rows).withColumns({"there": F.lit(1), "audit": F.lit(None).cast("string")} | {c: F.lit(None).cast("long") for c in REPORT})
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"))]
    heads = found.select("conv_id", F.lit(0).alias("there"), *none, "audit", *REPORT)
    return _in_order(heads.unionByName(turns), "there").select("conv_id", *REPORT, "audit", "role", "text")


def _repaired(batches) -> Iterator[tuple[int | None, tuple, Iterator[tuple[str, str, str]]]]:
    """(conv_id, its report and audit, its repaired turns)."""
    for conv, turns in _groups(batches):
        *said, audit, _, _ = next(turns)
        yield conv, (*said, audit), edited(audit, (t[-2:] for t in turns))


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the turns of every repaired conversation. See ``audits``."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches):
        held, size = [], 0
        for conv, _, turns in _repaired(batches):
            for place, (edit, role, text) in enumerate(turns):
                held.append((conv, place, edit, role, text))
                size += len(text)
                if len(held) >= 1000 or size >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema.names)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema.names)

    return _with_turns(rows, audits(rows)).mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def repair_report(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id, REPORT, audit and repaired_sha256, the digest of the repaired ``role:text``, joined by newlines.

    Nulls, ties and repeated rows as in ``audits``; an empty table without ``ids`` gives no rows. A text is hashed as it comes
    and held alone; a conversation of any length is read in order by one task, since its digest is one chain.
    """
    names, kinds = ["conv_id", *REPORT, "audit", "repaired_sha256"], [pa.int64()] * (1 + len(REPORT)) + [pa.string()] * 2

    def run(batches):
        held = []
        for conv, said, turns in _repaired(batches):
            digest, glue = hashlib.sha256(), ""
            for _, role, text in turns:
                digest.update(f"{glue}{role}:{text}".encode("utf-8", "surrogatepass"))
                glue = "\n"
            held.append((conv, *said, digest.hexdigest()))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    longs = ", ".join(f"{c} long" for c in names[:-2])
    return _with_turns(rows, audits(rows, ids)).mapInArrow(run, f"{longs}, audit string, repaired_sha256 string")
