"""Writes as pure functions: (new table, status rows). Nothing is half written: a write commits only if no row is in error.

Tables are Parquet or JSON folders. ``swap`` writes the new state beside the old and exchanges them, so a failed job
leaves the old table in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import aggregates, graph, predicates, windows


def swap(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace the table at ``path`` by ``df`` (which may read it) through a rename of a finished folder."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    tag = uuid.uuid4().hex
    P = jvm.org.apache.hadoop.fs.Path
    new, old, at = P(f"{path}.new-{tag}"), P(f"{path}.old-{tag}"), P(path)
    df.write.format(fmt).save(new.toString())
    fs = at.getFileSystem(conf)
    had = fs.exists(at)
    if had and not fs.rename(at, old):
        fs.delete(new, True)
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, at):
        if had and not fs.rename(old, at):
            raise OSError(f"the old table is at {old.toString()}, the new one at {new.toString()}")
        raise OSError(f"cannot move the new table to {path}; the old one stays")
    if had:
        fs.delete(old, True)


def insert_edges(edges: DataFrame, rows: DataFrame, types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All-or-nothing insert. Returns (table after, status of each row: error, existed or added).

    Rows are put in canonical order first; a row whose key is in the table or earlier in the batch existed.
    """
    checked = predicates.edge_errors(rows, types)
    keyed = aggregates.edge_key(checked, F.col("is_symmetric")).withColumn("bad", F.size("errors") > 0)
    first = keyed.groupBy("key_from", "key_to", "type").agg(F.min("_ord").alias("_first"))
    old = aggregates.edge_key(predicates.endpoint_matches(edges, types), F.col("is_symmetric")).select("key_from", "key_to", "type").distinct().withColumn("_there", F.lit(True))
    out = keyed.join(first, ["key_from", "key_to", "type"]).join(old, ["key_from", "key_to", "type"], "left")
    status = F.when(F.col("bad"), "error").when(F.col("_there").isNotNull() | (F.col("_ord") > F.col("_first")), "existed").otherwise("added")
    marked = out.withColumn("status", status)
    if not marked.filter("bad").isEmpty():
        return edges, marked.select("_ord", "status", "errors")
    new = marked.filter("status = 'added'").select(
        F.col("key_from").alias("from_id"), F.col("key_to").alias("to_id"), "type", "evidence", "date", "confidence", F.when(F.col("is_symmetric"), F.lit(True)).alias("symmetric"), "_ord"
    )
    last = edges.agg(F.coalesce(F.max("_ord"), F.lit(-1))).first()[0]
    return edges.unionByName(new.withColumn("_ord", F.col("_ord") + last + 1), allowMissingColumns=True), marked.select("_ord", "status", "errors")


def insert_citations(citations: DataFrame, rows: DataFrame) -> DataFrame:
    """Citations with the new (from, to) pairs; ``rows`` that are there stay out."""
    fresh = windows.keep_first(rows, ["from_id", "to_id"]).join(citations.select("from_id", "to_id"), ["from_id", "to_id"], "left_anti")
    return citations.unionByName(fresh, allowMissingColumns=True)


def set_confidence(edges: DataFrame, from_id: str, to_id: str, type_: str, value: str) -> DataFrame:
    """Set the confidence of all edges with the key; an error if there is none."""
    hit = (F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("type") == type_)
    if edges.filter(hit).isEmpty():
        raise LookupError(f"no edge {from_id} {type_} {to_id}")
    return edges.withColumn("confidence", F.when(hit, value).otherwise(F.col("confidence")))


def set_evidence(edges: DataFrame, from_id: str, to_id: str, type_: str, value: str, expected: str | None = None) -> tuple[DataFrame, str]:
    """Compare-and-set: exactly one edge, with the expected evidence if given. Returns (table, changed or unchanged)."""
    hit = (F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("type") == type_)
    got = edges.filter(hit).select("evidence").limit(2).collect()
    if len(got) != 1:
        raise LookupError(f"{len(got)} edges match")
    if expected is not None and got[0][0] != expected:
        raise ValueError("the evidence is not the expected one")
    if got[0][0] == value:
        return edges, "unchanged"
    return edges.withColumn("evidence", F.when(hit, value).otherwise(F.col("evidence"))), "changed"


def remove_edge(edges: DataFrame, from_id: str, to_id: str, type_: str, expected: str) -> DataFrame:
    """Remove exactly one edge with the expected evidence."""
    hit = (F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("type") == type_)
    got = edges.filter(hit).select("evidence").limit(2).collect()
    if len(got) != 1 or got[0][0] != expected:
        raise LookupError("no single edge with that evidence")
    return edges.filter(~hit)


def remap_nodes(edges: DataFrame, mapping: DataFrame, symmetric: Column) -> DataFrame:
    """Edges with renamed endpoints (mapping: old, new). Rows that fall on one key must agree in all but the date; the one
    that had the key before is kept, else the first. A disagreement stops the whole write."""
    m = mapping.select("old", "new")
    a = m.select(F.col("old").alias("from_id"), F.col("new").alias("_nf"))
    b = m.select(F.col("old").alias("to_id"), F.col("new").alias("_nt"))
    moved = edges.join(a, "from_id", "left").join(b, "to_id", "left")
    moved = moved.withColumn("_changed", F.col("_nf").isNotNull() | F.col("_nt").isNotNull())
    moved = moved.withColumns({"from_id": F.coalesce("_nf", "from_id"), "to_id": F.coalesce("_nt", "to_id")}).drop("_nf", "_nt")
    keyed = aggregates.edge_key(moved, symmetric)
    rest = [c for c in edges.columns if c not in ("from_id", "to_id", "type", "date", "_ord")]
    groups = keyed.groupBy("key_from", "key_to", "type").agg(F.count_distinct(F.to_json(F.struct(*rest))).alias("kinds"))
    if not groups.filter("kinds > 1").isEmpty():
        raise ValueError("renamed edges collide and differ")
    best = keyed.groupBy("key_from", "key_to", "type").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("from_id", "to_id", "type")]), F.struct("_changed", "_ord")).alias("r"))
    return best.select(F.col("key_from").alias("from_id"), F.col("key_to").alias("to_id"), "type", "r.*").select(*edges.columns)


def dedup_edges(edges: DataFrame, symmetric: Column, corrupt: DataFrame | None = None) -> DataFrame:
    """First edge of each canonical key, in canonical order; lines that could not be read are kept as they are."""
    keyed = graph.canonical(edges, symmetric).drop("error")
    first = windows.keep_first(keyed, ["from_id", "to_id", "type"])
    return first.unionByName(corrupt, allowMissingColumns=True).orderBy("_ord") if corrupt is not None else first


def log_rows(messages: DataFrame) -> DataFrame:
    """period, skill, date, text of log messages 'skill | details' (column ts, message)."""
    skill = F.when(F.col("message").contains("|"), F.trim(F.substring_index("message", "|", 1))).otherwise("general")
    text = F.when(F.col("message").contains("|"), F.trim(F.expr("substring(message, instr(message, '|') + 1)"))).otherwise(F.trim("message"))
    return messages.select(X.month_week("ts").alias("period"), skill.alias("skill"), F.date_format("ts", "yyyy-MM-dd").alias("date"), text.alias("text"))


def append_log(messages: DataFrame, path: str) -> None:
    log_rows(messages).write.mode("append").partitionBy("period", "skill").json(path)


def append_lines(have: Column, new: Column) -> Column:
    """Lines of a section with the new ones that no line of it contains."""
    return F.concat(have, F.filter(new, lambda n: ~F.exists(have, lambda h: h.contains(n))))


def set_field(header: Column, field: str, value: Column) -> Column:
    """A header map with one field replaced; an absent field is an error."""
    missing = F.raise_error(F.lit(f"no field {field}"))
    return F.when(F.map_contains_key(header, field), F.map_concat(F.map_filter(header, lambda k, _: k != field), F.create_map(F.lit(field), value))).otherwise(missing.cast("map<string,string>"))


def rename_in_text(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Whole-token renames, longest first, so that a name inside a longer one is not touched."""
    import re

    for old, new in sorted(pairs, key=lambda p: -len(p[0])):
        text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_-]){re.escape(old)}(?![A-Za-z0-9_-])", new.replace("\\", "\\\\").replace("$", "\\$"))
    return text


def repairs(findings: DataFrame, dry_run: bool) -> DataFrame:
    """Fixable findings with what is done about each."""
    return findings.filter("fixable").withColumn("action", F.lit("would fix" if dry_run else "fix"))


def markdown_table(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """One Markdown line for each row, with its place."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[X.markdown_cell(F.col(c).cast("string")) for c in columns]), F.lit(" |"))
    return df.orderBy(*order).select(line.alias("line"))


def render(df: DataFrame, part: list[str], order: list[Column], line: Column, separator: str = "\n") -> DataFrame:
    """Text of each group, its lines in order (a group is one document and bounded by it)."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line"))))
    return df.groupBy(*part).agg(F.array_join(F.transform(rows, lambda x: x["line"]), separator).alias("text"))


def save_checkpoint(state: DataFrame, done: DataFrame) -> DataFrame:
    """task, item, status: the state with new items; an item is completed once and for all, failed until then."""
    both = state.select("task", "item", "status").unionByName(done.select("task", "item", "status"))
    return both.groupBy("task", "item").agg(F.when(F.count_if(F.col("status") == "completed") > 0, "completed").otherwise("failed").alias("status"))


def load_checkpoint(spark: SparkSession, path: str) -> tuple[bool, DataFrame | None]:
    """(exists, state). A folder that is not there is absent; one that cannot be read raises, so no work is lost by
    starting over on top of it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return False, None
    df = spark.read.parquet(path)
    df.limit(1).count()
    if not {"task", "item", "status"} <= set(df.columns):
        raise ValueError(f"{path} is no checkpoint: {df.columns}")
    return True, df


def upsert_membership(have: DataFrame, wanted: DataFrame, most_rows: int = 2000, most_keys: int = 32) -> tuple[DataFrame, DataFrame]:
    """Add missing (item, collection) pairs. ``wanted``: item, keys. Returns (table after, added and whether changed by item)."""
    if wanted.count() > most_rows:
        raise ValueError("the batch is not valid")
    return upsert_all_membership(have, wanted, most_keys)


def upsert_all_membership(have: DataFrame, wanted: DataFrame, most_keys: int = 32) -> tuple[DataFrame, DataFrame]:
    """``upsert_membership`` of any number of rows: what batches add depends on their own items only, so all of them are one job."""
    bad = wanted.filter((F.size("keys") > most_keys) | F.col("item").isNull())
    if not bad.isEmpty():
        raise ValueError("the batch is not valid")
    pairs = wanted.select("item", F.explode(F.array_distinct("keys")).alias("collection")).distinct()
    new = pairs.join(have, ["item", "collection"], "left_anti")
    report = pairs.join(new.withColumn("_new", F.lit(1)), ["item", "collection"], "left").groupBy("item").agg(F.sum(F.coalesce("_new", F.lit(0))).alias("added"))
    return have.unionByName(new.select(*have.columns)), report.withColumn("changed", F.col("added") > 0)


def get_or_create(have: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The table with one new row for each key that is not there."""
    return have.unionByName(windows.keep_first(wanted, keys).join(have, keys, "left_anti").select(*have.columns), allowMissingColumns=True)


def migrate_log(have: DataFrame, entries: DataFrame) -> DataFrame:
    """Old entries in the new buckets; running it twice adds nothing."""
    return have.unionByName(entries.join(have, ["period", "skill", "text"], "left_anti").select(*have.columns))


def canonical_header(header: Column, order: list[str], defaults: dict[str, str]) -> Column:
    """Header entries as an array of (key, value): the given order first with defaults, the rest sorted."""
    known = F.array(*[F.struct(F.lit(k).alias("key"), F.coalesce(F.try_element_at(header, F.lit(k)), F.lit(defaults.get(k))).alias("value")) for k in order])
    rest = F.array_sort(F.map_entries(F.map_filter(header, lambda k, _: ~k.isin(order))))
    return F.concat(F.filter(known, lambda x: x["value"].isNotNull()), rest)
