"""Several tables under one commit: all of them change, or none.

A store is a folder. Every version of a table is a folder of its own that is never written again; ``_log/<number>.json`` says which
version of each table is current, and the highest number counts. A commit writes the new versions first and then creates the next
log entry, which fails if another writer has created it meanwhile. Whatever stops before that leaves the store as it was; what a
stopped commit wrote is never read and ``vacuum`` removes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import aggregates


class Changed(RuntimeError):
    """Another commit came between the reading and the writing."""


class Store:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def version(self) -> int:
        """Number of the last commit; -1 before the first."""
        return max((int(n.removesuffix(".json")) for n in self._names(f"{self.folder}/_log") if n.endswith(".json") and not n.startswith(".")), default=-1)

    def current(self, version: int | None = None) -> dict[str, str]:
        """Folder of each table at a version (the last by default)."""
        v = self.version() if version is None else version
        if v < 0:
            return {}
        lines = self.spark.read.text(f"{self.folder}/_log/{v:012d}.json", wholetext=True).first()
        return json.loads(lines[0])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.current(version)[table]}")

    def commit(self, tables: dict[str, DataFrame], expected: int) -> int:
        """Make ``tables`` current, all at once, if the last commit is still ``expected``. The others stay. Returns the new number."""
        if self.version() != expected:
            raise Changed(f"the store is at {self.version()}, and not at {expected}")
        now = self.current(expected)
        for name, df in tables.items():
            at = f"{name}/v-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{at}")
            now[name] = at
        self._create(f"{self.folder}/_log/{expected + 1:012d}.json", json.dumps(now, sort_keys=True))
        return expected + 1

    def _create(self, at: str, text: str) -> None:
        """A log entry that must not be there yet, visible only as a whole: written aside, then moved to its name."""
        aside = self._path(f"{self.folder}/_log/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
        try:  # without the option to overwrite: of two writers one fails
            hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(at)), none)
        except Exception as e:
            self._fs.delete(aside, False)
            raise Changed(f"another commit is {at}") from e

    def vacuum(self, keep: int = 1) -> int:
        """Delete versions that none of the last ``keep`` commits names; returns how many."""
        last = self.version()
        used = {at for v in range(max(0, last - keep + 1), last + 1) for at in self.current(v).values()}
        gone = [f"{t}/{v}" for t in self._names(self.folder) if not t.startswith("_") for v in self._names(f"{self.folder}/{t}") if f"{t}/{v}" not in used]
        for at in gone:
            self._fs.delete(self._path(f"{self.folder}/{at}"), True)
        return len(gone)


def checked_mapping(mapping: DataFrame, kinds: list[str], pages: DataFrame) -> DataFrame:
    """``mapping`` (old, new) if it is sound, else an error: node ids kind/slug, one kind, no chain, no old node twice, new pages there."""
    ok = lambda c: F.coalesce(F.col(c).rlike(r"^[^/\\]+/[^/\\]+$") & ~F.col(c).rlike(r"/\.\.?$") & F.substring_index(c, "/", 1).isin(kinds), F.lit(False))
    wrong = mapping.filter(~ok("old") | ~ok("new") | (F.substring_index("old", "/", 1) != F.substring_index("new", "/", 1)) | (F.col("old") == F.col("new")))
    chained = mapping.join(mapping.select(F.col("old").alias("new")), "new", "left_semi")
    lost = mapping.join(pages.select(F.col("node").alias("new")), "new", "left_anti")
    twice = mapping.groupBy("old").agg(F.count_distinct("new").alias("n"), F.first("new").alias("new")).filter("n > 1")
    for what, rows in (("no same-kind pair of nodes", wrong), ("a chain", chained), ("no page for", lost), ("two new nodes for", twice)):
        if (r := rows.select("old", "new").first()) is not None:
            raise ValueError(f"{what}: {r.old} -> {r.new}")
    if mapping.isEmpty():
        raise ValueError("nothing to map")
    return mapping.select("old", "new").distinct()


def remapped(rows: DataFrame, mapping: DataFrame, symmetric: Column) -> tuple[DataFrame, DataFrame]:
    """(rows after, one row with remapped and deduplicated): rows of a graph table with nodes renamed.

    Rows that change, and rows with the key of one, form groups by (from, to, type); a group must agree in all but the date, else
    nothing is returned. Of a group the first row that had the key before stays, or else the first. All other rows stay as they
    are, repeated ones too. ``rows`` has from_id, to_id, type, date, _ord and any other columns.
    """
    m = mapping.select("old", "new")
    a, b = (m.select(F.col("old").alias(c), F.col("new").alias(f"_{c}")) for c in ("from_id", "to_id"))
    moved = rows.join(a, "from_id", "left").join(b, "to_id", "left")
    moved = moved.withColumn("_changed", F.col("_from_id").isNotNull() | F.col("_to_id").isNotNull())
    moved = moved.withColumns({"from_id": F.coalesce("_from_id", "from_id"), "to_id": F.coalesce("_to_id", "to_id")}).drop("_from_id", "_to_id")
    keyed = aggregates.edge_key(moved, symmetric)
    turned = keyed.withColumns({"from_id": F.when(F.col("_changed"), F.col("key_from")).otherwise(F.col("from_id")), "to_id": F.when(F.col("_changed"), F.col("key_to")).otherwise(F.col("to_id"))})
    keys = ["key_from", "key_to", "type"]
    said = F.to_json(F.struct(*[c for c in rows.columns if c not in ("date", "_ord")]), {"ignoreNullFields": "false"})
    groups = turned.groupBy(*keys).agg(
        F.bool_or("_changed").alias("_hit"), F.min(said).alias("_low"), F.max(said).alias("_high"), F.min(F.struct("_changed", "_ord"))["_ord"].alias("_first"), F.count(F.lit(1)).alias("_size")
    ).filter("_hit")
    clash = groups.filter("_low <> _high").select(*keys).first()
    if clash is not None:
        raise ValueError(f"rows of {clash.key_from} {clash.type} {clash.key_to} differ; reconcile them first")
    out = turned.join(groups.select(*keys, "_first"), keys, "left").filter(F.col("_first").isNull() | (F.col("_ord") == F.col("_first")))
    counts = turned.agg(F.count_if("_changed").alias("remapped")).crossJoin(groups.agg(F.coalesce(F.sum(F.col("_size") - 1), F.lit(0)).alias("deduplicated")))  # one row each
    return out.select(*rows.columns), counts


def remap_graph(store: Store, mapping: DataFrame, kinds: list[str], pages: DataFrame, symmetric: Column) -> tuple[int, DataFrame]:
    """Rename nodes in ``edges`` and ``citations`` of a store under one commit. Returns its number, and the counts of both tables."""
    at = store.version()
    sound = checked_mapping(mapping, kinds, pages).checkpoint()
    after, counts = {}, None
    for name in ("edges", "citations"):
        if name not in store.current(at):
            continue
        rows, n = remapped(store.read(name, at), sound, symmetric)
        after[name] = rows
        n = n.withColumn("table", F.lit(name))
        counts = n if counts is None else counts.unionByName(n)
    return store.commit(after, at), counts
