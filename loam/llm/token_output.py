"""Token-id files: canonical length-limited Huffman coding (operator 8).

A dataset is a folder of files, one or more for each range of doc_id in ascending order. A file holds blocks; a block
is self-contained given the code lengths: magic, token, document and checkpoint counts, doc_ids, a bit for each null
doc_id, document lengths, the bit offset of every ``STEP``-th token, and the bits. Code lengths come from the ids' counts over the whole corpus by
the package-merge method, at most ``MAX_BITS`` long; codes are canonical, so the lengths alone rebuild them. Decoding
looks up ``MAX_BITS`` bits at a time in one table, at all checkpoints of a block at once.

Ids come from ``bpe.WordBpe``, which reads the vocabulary file itself and gives what the tokenizers library gives at less
cost; the tests hold it against the library. Ranges have about equal bytes of text, so a task's share does not depend on
how texts are spread over the ids; a doc_id that fills several ranges is dealt over them.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import bpe_of, read_spec
from .common import documents, materialize, rows_of, shared_dir, trimmed, tune

MAX_BITS, STEP, MAGIC = 20, 256, b"LHF2"
BLOCK_TOKENS = 1 << 18
#: Text of a doc_id range, and the most ranges: beyond that ranges grow.
RANGE_CHARS, MOST_RANGES = 8 << 20, 50_000
#: Texts encoded at once.
GROUP_CHARS = 4 << 20
END_ID = 2


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        both = both[at]
        packages = both[0 : len(both) // 2 * 2 : 2] + both[1 : len(both) // 2 * 2 : 2]
    take, lengths = 2 * n - 2, np.zeros(n, np.uint8)
    for own in reversed(levels):
        singles = int(own[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id): within a length they count up from the first, which follows from the shorter ones."""
    many = np.bincount(lengths, minlength=MAX_BITS + 2)
    many[0] = 0
    first, code = np.zeros(len(many), np.int64), 0
    for size in range(1, len(many)):
        code = (code + int(many[size - 1])) << 1
        first[size] = code
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    size = lengths[order].astype(np.int64)
    place = np.arange(len(order)) - (np.cumsum(many) - many)[size]
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = (first[size] + place).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and length for every value of the next MAX_BITS bits: canonical codes fill it in order of (length, id)."""
    used = np.flatnonzero(lengths)
    order = used[np.argsort(lengths[used], kind="stable")]
    wide = 1 << (MAX_BITS - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.uint8)
    ids[: wide.sum()], size[: wide.sum()] = np.repeat(order, wide), np.repeat(lengths[order], wide)
    return ids, size


def pack_block(docs: list[tuple[int | None, np.ndarray]], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    size = lengths[ids].astype(np.uint64)
    ends = np.cumsum(size)
    offs = ends - size
    total = int(ends[-1]) if len(ids) else 0
    words = np.zeros(total // 32 + 3, np.uint64)
    if len(ids):
        word = (offs >> np.uint64(5)).astype(np.int64)
        bits = codes[ids] << (np.uint64(64) - size - (offs & np.uint64(31)))
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words[word[first]] += np.add.reduceat(bits >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(bits & np.uint64(0xFFFFFFFF), first)
    points = offs[::STEP].astype("<u8")
    keys = np.array([0 if d is None else d for d, _ in docs], "<i8")
    nulls = np.packbits([d is None for d, _ in docs]) if docs else np.zeros(0, np.uint8)
    sizes = np.array([len(x) for _, x in docs], "<u4")
    return b"".join([MAGIC, struct.pack("<III", len(ids), len(docs), len(points)), keys.tobytes(), nulls.tobytes(), sizes.tobytes(), points.tobytes(), words.astype(">u4").tobytes()])


def unpack_block(raw: bytes, table: tuple[np.ndarray, np.ndarray]) -> list[tuple[int | None, np.ndarray]]:
    if raw[:4] != MAGIC:
        raise ValueError("not a block")
    n, docs, points = struct.unpack_from("<III", raw, 4)
    at = 16
    keys = np.frombuffer(raw, "<i8", docs, at)
    at += 8 * docs
    nulls = np.unpackbits(np.frombuffer(raw, np.uint8, -(-docs // 8), at), count=docs).tolist()
    at += -(-docs // 8)
    sizes = np.frombuffer(raw, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    offs = np.frombuffer(raw, "<u8", points, at).astype(np.int64)  # a copy
    at += 8 * points
    bits = np.lib.stride_tricks.as_strided(np.frombuffer(raw, ">u4", 1, at), (len(raw) - at - 3,), (1,))  # 32 bits from every byte on
    out = np.zeros((STEP, points), np.uint32)
    symbols, size = table
    limit = len(bits) - 1
    for step in range(STEP if points else 0):
        ahead = bits[np.minimum(offs >> 3, limit)].astype(np.uint32)
        ahead = (ahead << (offs & 7).astype(np.uint32)) >> np.uint32(32 - MAX_BITS)
        out[step] = symbols[ahead]
        offs += size[ahead]
    ids = out.T.reshape(-1)[:n]
    return [(None if null else k, x) for k, null, x in zip(keys.tolist(), nulls, np.split(ids, np.cumsum(sizes)[:-1]), strict=True)] if docs else []


def range_bounds(docs: DataFrame) -> tuple[int, list[int]]:
    """Ranges of null doc_ids, and upper ends of doc_id ranges of about equal text bytes. An end comes several times if
    its doc_id fills several ranges."""
    sizes = materialize(docs.select("doc_id", (F.coalesce(F.length("text"), F.lit(0)) + 16).cast("long").alias("size")), "text-sizes")
    total, null = sizes.agg(F.sum("size"), F.sum(F.when(F.col("doc_id").isNull(), F.col("size")))).first()
    n = min(MOST_RANGES, -(-(total or 0) // RANGE_CHARS))
    if n <= 1:
        return 1, []
    share = (total or 0) / n
    nulls = max(1, round((null or 0) / share))
    ids = sizes.filter("doc_id is not null")
    fine = min(4 * n, 2 * MOST_RANGES)
    ends = np.array(ids.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / fine for i in range(1, fine)], 0.25 / fine), np.float64)
    ends = np.unique(np.clip(ends, -(2.0**62), 2.0**62).astype(np.int64))

    def tally(batches):
        got = np.zeros(len(ends) + 1, np.int64)
        for b in batches:
            np.add.at(got, np.searchsorted(ends, b.column(0).to_numpy(), "left"), b.column(1).to_numpy())
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(got[at])], ["at", "size"])

    counted = ids.select("doc_id", "size").mapInArrow(tally, "at long, size long").groupBy("at").agg(F.sum("size").alias("size"))
    by_end, out, held = {r["at"]: r["size"] for r in counted.collect()}, [], 0.0  # a few rows for each range
    for k, end in enumerate(ends.tolist()):
        held += by_end.get(k, 0)
        while held >= share:
            out.append(end)
            held -= share
    return nulls, out


def encode_table(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Ids of every document by doc_id range, and each task's id counts, written once.

    Columns part, doc_id, crc, n, ids, count_ids, counts. The last two are set on count rows only.
    """
    spark = docs.sparkSession
    spec, plain = spark.sparkContext.broadcast(read_spec(tokenizer)), documents(docs)
    nulls, bounds = range_bounds(plain)
    ends, parts, wide = np.array(bounds, np.int64), nulls + len(bounds) + 1, _wide(tokenizer, end_id)
    names = ["part", "doc_id", "crc", "n", "ids", "count_ids", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches):
        bpe, kind = bpe_of(spec.value), "<u2" if wide <= 1 << 16 else "<u4"
        counts = np.zeros(wide, np.int64)
        turn = 0

        def part_of(doc):
            if doc is None:
                return turn % nulls
            low, high = int(np.searchsorted(ends, doc, "left")), int(np.searchsorted(ends, doc, "right"))
            return nulls + (low + turn % (high - low) if high > low else low)

        def encode(held):
            """Rows of a group of documents: ids of all of them at once, each with the end id behind it."""
            nonlocal counts, turn
            ids, many = bpe.encode_arrays([t for _, t in held])
            ends = np.cumsum(many + 1)
            out = np.full(int(ends[-1]), end_id, "<u4")
            inner = np.ones(len(out), bool)
            inner[ends - 1] = False
            out[inner] = ids
            counts += np.bincount(out, minlength=wide)
            rows, raw, lean = [], out.tobytes(), out.astype(kind).tobytes()
            step, at = np.dtype(kind).itemsize, 0
            for (doc, _), stop in zip(held, ends.tolist(), strict=True):
                rows.append((part_of(doc), doc, zlib.crc32(raw[4 * at : 4 * stop]), stop - at, lean[step * at : step * stop], None, None))
                turn, at = turn + 1, stop
            return batch(rows)

        held, size = [], 0
        for doc, text in rows_of(batches):
            held.append((doc, text or ""))
            size += len(held[-1][1])
            if size >= GROUP_CHARS:
                yield encode(held)
                held, size = [], 0
        if held:
            yield encode(held)
        used = np.flatnonzero(counts)
        if len(used):
            yield batch([(int(counts[used].sum()) % parts, None, 0, 0, None, used.tolist(), counts[used].tolist())])

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    encoded = plain.mapInArrow(trimmed(run, "bpe"), "part long, doc_id long, crc long, n long, ids binary, count_ids array<int>, counts array<long>")
    dealt = encoded.repartitionById(parts, F.col("part").cast("int"))
    return materialize(dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "crc"), "ids")


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID) -> None:
    """Encode, append ``end_id`` to each document and write the dataset: ``path``/blocks and ``path``/code.

    A null text is empty and gives the end id alone; null doc_ids come first; rows of one doc_id follow each other, equal
    or not. Other columns are not read. No documents: no files but the code. Texts of any length are one row each.
    """
    tune(docs.sparkSession)
    spark = docs.sparkSession
    table = encode_table(docs, tokenizer, end_id)
    tally = table.filter("count_ids is not null").select(F.explode(F.arrays_zip("count_ids", "counts")).alias("x")).groupBy(F.col("x.count_ids").alias("id")).agg(F.sum("x.counts").alias("c")).collect()
    counts = np.zeros(max((r["id"] for r in tally), default=0) + 1, np.int64)  # one entry for each id of the vocabulary
    for r in tally:
        counts[r["id"]] = r["c"]
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS, STEP)], "lengths binary, max_bits int, step int").coalesce(1).write.parquet(f"{path}/code")
    sent, wide = spark.sparkContext.broadcast(lengths), "<u2" if _wide(tokenizer, end_id) <= 1 << 16 else "<u4"
    names = ["part", "block", "first_doc", "first_crc", "last_doc", "last_crc", "n_tokens", "payload"]
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]

    def run(batches):
        lens, codes = sent.value, canonical_codes(sent.value)
        held: list = []
        head, last, n = None, None, 0

        def flush():
            row = (head[0], uuid.uuid4().hex, *head[1:], *last, n, pack_block(held, lens, codes))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in batches:
            for part, doc, crc, ids in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (n >= BLOCK_TOKENS or head[0] != part):
                    yield flush()
                    held, n = [], 0
                if not held:
                    head = (part, doc, crc)
                held.append((doc, np.frombuffer(ids, wide).astype(np.uint32)))
                last = (doc, crc)
                n += len(held[-1][1])
        if held:
            yield flush()

    coded = table.filter("count_ids is null").select("part", "doc_id", "crc", "ids").mapInArrow(trimmed(run), "part long, block string, first_doc long, first_crc long, last_doc long, last_crc long, n_tokens long, payload binary")
    coded.write.partitionBy("part").option("compression", "none").parquet(f"{path}/blocks")


def _wide(tokenizer: str, end_id: int) -> int:
    return max(len(bpe_of(read_spec(tokenizer)).tokens), end_id + 1)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a dataset, from its files alone.

    The driver gets one row for each doc_id range (a file of some 64 MB of text); offsets inside a range are a window
    over its blocks' sizes, without their bits.
    """
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)
    sent = spark.sparkContext.broadcast(lengths)
    schema = "block string, first_doc long, first_crc long, last_doc long, last_crc long, n_tokens long, payload binary, part long"
    blocks = spark.read.schema(schema).parquet(f"{path}/blocks")

    def run(batches):
        table = decode_table(sent.value)
        for b in batches:
            for block, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs = unpack_block(raw, table)
                sizes = np.array([len(x) for _, x in docs], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block] * len(docs), pa.string()), pa.array([d for d, _ in docs], pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs], pa.int64()),
                ], ["block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = blocks.select("block", "payload").mapInArrow(trimmed(run), "block string, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, bases = 0, []
    for r in sizes:
        bases.append((r["part"], base))
        base += r["n"]
    before = Window.partitionBy("part").orderBy(F.col("first_doc").asc_nulls_first(), "first_crc", F.col("last_doc").asc_nulls_first(), "last_crc", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "block", "first_doc", "first_crc", "last_doc", "last_crc", "n_tokens").withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    offsets = offsets.join(F.broadcast(spark.createDataFrame(bases, "part long, base long")), "part").select("block", (F.col("base") + F.col("before")).alias("block_start"))
    return rows.join(offsets, "block").select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write a dataset (under the shared folder unless ``path`` is given) and return ``read_tokens`` of it."""
    path = path or f"{shared_dir(docs.sparkSession)}/loam/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, end_id)
    return read_tokens(docs.sparkSession, path)
