"""Parquet snapshots of a SQLite library, renewed only when its files change.

The signature is what the file system says of the three files of a database (size and time of the database, the write-ahead log and
its index) and where they are. It is stored beside the snapshot; as long as it is the same, nothing is copied or written.
"""

from __future__ import annotations

import hashlib
import json
import shutil
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import tables

SUFFIXES = ("", "-wal", "-shm")


def signature(database: str) -> dict[str, object]:
    """root, and size and mtime_ns of each file (null: not there)."""
    at = Path(database).resolve()
    out: dict[str, object] = {"root": str(at.parent)}
    for s in SUFFIXES:
        f = at.with_name(at.name + s)
        out[f.name] = {"size": f.stat().st_size, "mtime_ns": f.stat().st_mtime_ns} if f.exists() else None
    return out


class Snapshot:
    """The tables of a database at one signature: ``read(name)``; ``notes`` say whether it was reused."""

    def __init__(self, spark: SparkSession, folder: str, notes: list[str]) -> None:
        self.spark, self.folder, self.notes = spark, folder, notes

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}")


def prepare(spark: SparkSession, database: str, folder: str, queries: dict[str, tuple[str, str]]) -> Snapshot:
    """The snapshot of ``queries`` (name -> SQL, schema) over ``database`` below ``folder`` (a path that driver and executors share).

    The three files are copied before they are read, so a writer in between cannot mix two states, and a log that was not merged yet
    is part of the copy. The manifest is written last: a snapshot that stopped half way has none and is made again. An
    unreadable manifest counts as none, with a note. A failed query leaves the last whole snapshot as it is.
    """
    now = signature(database)
    wanted = now | {"queries": {k: list(v) for k, v in sorted(queries.items())}}
    home = Path(folder.removeprefix("file://")) / hashlib.sha256(str(now["root"]).encode()).hexdigest()[:16]
    manifest, notes = home / "snapshot.json", []
    if manifest.exists():
        try:
            said = json.loads(manifest.read_text(encoding="utf-8"))
            if said["signature"] == wanted and (home / said["folder"]).is_dir():
                return Snapshot(spark, str(home / said["folder"]), [f"reused {home / said['folder']}"])
        except (OSError, ValueError, KeyError, TypeError) as e:
            notes.append(f"unreadable manifest {manifest}: {type(e).__name__}")
    tag = uuid.uuid4().hex
    copy = home / f"copy-{tag}"
    copy.mkdir(parents=True)
    try:
        source = Path(database).resolve()
        for s in SUFFIXES:
            if now[source.name + s] is not None:
                shutil.copy2(source.with_name(source.name + s), copy / (source.name + s))
        for name, (sql, schema) in queries.items():
            tables.sqlite(spark, str(copy / source.name), sql, schema).write.parquet(str(home / f"tables-{tag}" / name))
    finally:
        shutil.rmtree(copy, ignore_errors=True)
    aside = home / f".manifest-{tag}"
    aside.write_text(json.dumps({"signature": wanted, "folder": f"tables-{tag}"}, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
    aside.replace(manifest)
    for old in home.glob("tables-*"):
        if old.name != f"tables-{tag}":
            shutil.rmtree(old, ignore_errors=True)
    return Snapshot(spark, str(home / f"tables-{tag}"), [*notes, f"created {home / f'tables-{tag}'}"])
