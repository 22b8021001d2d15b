"""Repeated runs of lines by winnowing (operator 4).

The lines with a word are a document's sequence of line hashes. A window is ``run`` lines, or fewer with ``words`` words
or more. In each window the smallest hash (the last among equals) is selected, so a repeated window has a selected line
at the same place in it wherever it stands: a guaranteed fingerprint. Each selected line is a place: its hash, its
position, and the hashes and word counts of the ``run`` - 1 lines on either side.

Places are joined by fingerprint, and those that occur once drop out. Matches are extended both ways from the selected
line over the lines beside it to the windows that it was selected for; a window that stands earlier (in a smaller doc_id,
or before it in the same document) marks its lines, and windows that touch or overlap make one run, as long as the match
goes. Marked is thus each line of any repeated run of ``run`` lines or ``words`` words. Lines of later repeats go, the
first stays.

Nothing is paired with all its equals: a window is compared with its earliest place only, found by partial aggregation,
so a passage that a third of all documents hold is one row for each map task. A line or window with more rows than one task
should have is dealt over as many shares as it fills, by its counted rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trimmed, tune

RUN = 3
WORDS = 50
#: Rows of a line or window that go to one task, and the most keys that are known to have more.
SHARE_ROWS, MOST_HOT = 100_000, 50_000
_M = (1 << 64) - 1


def lines_of(text: str | None) -> tuple[list[int], list[str]]:
    """Numbers of the lines that hold a word, and the lines; white space at the ends of a line does not count."""
    at, out = [], []
    for i, line in enumerate((text or "").split("\n")):
        line = line.strip(" \t\n\x0b\x0c\r")
        if line:
            at.append(i)
            out.append(line)
    return at, out


def line_hashes(lines: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)


def selected(h: np.ndarray, run: int) -> np.ndarray:
    """For each window of ``run`` lines, the place of its fingerprint."""
    view = np.lib.stride_tricks.sliding_window_view(h, run)[:, ::-1]
    return np.arange(len(view)) + run - 1 - view.argmin(axis=1)


def window_key(window: list[int]) -> int:
    k = len(window)
    for x in window:
        k = (k * 0x9E3779B97F4A7C15 + x & _M) ^ (k >> 29)
    return k - (1 << 64) if k >> 63 else k


def own_windows(hashes: list[int], counts: list[int], before: int, run: int, words: int) -> list[tuple[int, int, int]]:
    """(key, start, size) of the windows over a place's lines that select the line number ``before``."""
    h, out = [x & _M for x in hashes], []
    least = h[before]
    for low in range(max(0, before - run + 1), before + 1):
        for high in range(before + 1, min(low + run, len(h)) + 1):
            if (high - low == run or sum(counts[low:high]) >= words) and min(h[low:high]) == least and least not in h[before + 1 : high]:
                out.append((window_key(h[low:high]), low, high - low))
    return out


def selections(h: np.ndarray, n_words: np.ndarray, run: int, words: int) -> np.ndarray:
    """Positions that some window selects."""
    out = np.zeros(len(h), bool)
    total = np.r_[0, np.cumsum(n_words)]
    for size in range(1, min(run, len(h)) + 1):
        own = selected(h, size)
        out[own if size == run else own[total[size:] - total[:-size] >= words]] = True
    return np.flatnonzero(out)


PLACE = "fp long, doc long, uid long, at int, before int, hashes array<long>, counts array<int>"


def _places(docs: DataFrame, run: int, words: int) -> DataFrame:
    """PLACE: each selected line with the hashes and word counts of the lines around it; ``before`` of them stand before it."""

    def go(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()))
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for doc, uid, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                lines = lines_of(text)[1]
                h, n_words = line_hashes(lines), np.array([len(x.split()) for x in lines], np.int64)
                hs, ws = h.view(np.int64).tolist(), n_words.tolist()
                for at in selections(h, n_words, run, words).tolist():
                    low, high = max(0, at - run + 1), at + run
                    for c, v in zip(cols, (hs[at], doc, uid, at, at - low, hs[low:high], ws[low:high]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["fp", "doc", "uid", "at", "before", "hashes", "counts"])

    return docs.mapInArrow(trimmed(go), PLACE)


def _extended(places: DataFrame, run: int, words: int) -> DataFrame:
    """key, doc, uid, at, size: the windows around each place that its line was selected for."""

    def go(batches):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for b in batches:
            cols: list[list] = [[] for _ in kinds]
            for doc, uid, at, before, hashes, counts in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for key, low, size in own_windows(hashes, counts, before, run, words):
                    for c, v in zip(cols, (key, doc, uid, at - before + low, size), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["key", "doc", "uid", "at", "size"])

    return places.select("doc", "uid", "at", "before", "hashes", "counts").mapInArrow(go, "key long, doc long, uid long, at int, size int")


def _spread(rows: DataFrame, few: DataFrame, key: str, total: int) -> DataFrame:
    """Join on a key that may hold a third of ``rows`` (``total`` of them): a key with more than its share of rows (``few`` has their
    count c) is dealt by the document as well, to as many shares as it fills. Such keys are at most MOST_HOT, whatever the input."""
    share = max(SHARE_ROWS, -(-total // MOST_HOT))
    few = few.withColumn("_n", F.ceil(F.col("c") / share).cast("int")).drop("c")
    hot = few.filter("_n > 1").select(key, "_n")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.pmod(F.xxhash64("doc", "uid"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    copies = few.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return dealt.join(copies, [key, "_share"]).drop("_share")


def repeated_windows(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc, uid, spans: the later repeats (at, size) among each document's windows of ``run`` lines or ``words`` words. ``docs``: doc, uid, text."""
    places = materialize(_places(docs, run, words), "places")
    often = places.groupBy("fp").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").checkpoint()
    shared = _extended(_spread(places, often, "fp", places.count()), run, words).checkpoint()
    first = shared.groupBy("key").agg(F.min(F.struct("doc", "uid", "at")).alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").checkpoint()
    later = _spread(shared, first, "key", shared.count()).filter(F.struct("doc", "uid", "at") > F.col("first"))
    return later.groupBy("doc", "uid").agg(F.sort_array(F.collect_set(F.struct("at", "size"))).alias("spans"))


def covered_lines(text: str | None, spans: list[dict] | None) -> set[int]:
    at = lines_of(text)[0] if spans else []
    return {at[i] for s in spans or () for i in range(s["at"], s["at"] + s["size"])}


def cut_lines(text: str, drop: set[int]) -> str:
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)


def _tagged(docs: DataFrame) -> DataFrame:
    """doc, uid, text, row: rows of one doc_id and text are the same document; a null doc_id comes before all others."""
    text = F.col("row.text").cast("string")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.select(F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("uid"), text.alias("text"), "row")


def dedup_lines(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """The input rows with later repeated runs of ``run`` lines or ``words`` words taken out of ``text`` (and ``n_chars`` adjusted, if there).

    No row goes: a document whose lines all repeat keeps an empty text. Null and empty texts stay as they are. Among
    rows of one doc_id with different texts the smaller hash of the text counts as earlier.
    """
    tune(docs.sparkSession)
    tagged = _tagged(docs)
    marks = repeated_windows(tagged.select("doc", "uid", "text"), run, words)
    joined = tagged.select("doc", "uid", "row").join(marks, ["doc", "uid"], "left").select("row", "spans")
    spot = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def go(batches):
        for b in batches:
            rows, spans = b.column(0), b.column(1).to_pylist()
            cols = rows.flatten()
            texts = [t if t is None or not s else cut_lines(t, covered_lines(t, s)) for t, s in zip(cols[spot].to_pylist(), spans, strict=True)]
            if chars is not None:
                cols[chars] = pa.array([n if not s or t is None else len(t) for n, t, s in zip(cols[chars].to_pylist(), texts, spans, strict=True)], cols[chars].type)
            cols[spot] = pa.array(texts, cols[spot].type)
            yield pa.RecordBatch.from_arrays(cols, docs_names)

    docs_names = list(docs.columns)
    return joined.mapInArrow(trimmed(go), docs.schema)


def line_report(docs: DataFrame, run: int = RUN, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed lines, n_runs, kept_sha256 of the text left; one row per input row."""
    tune(docs.sparkSession)
    tagged = _tagged(docs.select("doc_id", "text"))
    marks = repeated_windows(tagged.select("doc", "uid", "text"), run, words)
    joined = tagged.join(marks, ["doc", "uid"], "left").select("row.doc_id", "text", "spans")

    def go(batches):
        import hashlib

        for b in batches:
            rows = []
            for doc, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                at, _ = lines_of(text)
                drop = covered_lines(text, spans)
                runs = sum(1 for k, i in enumerate(at) if i in drop and (k == 0 or at[k - 1] not in drop))
                left = cut_lines(text or "", drop)
                rows.append((doc, len(at), len(drop), runs, hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256"])

    return joined.select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(go, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string")
