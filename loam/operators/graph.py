"""Graph traversal as level-by-level joins: bounded search, closures, root paths, canonical edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def arcs(edges: DataFrame, direction: str = "both", symmetric: Column | None = None) -> DataFrame:
    """src, dst, type, via, _ord: the steps that a walk may take. Undirected edges are walked both ways as 'symmetric'."""
    sym = symmetric if symmetric is not None else F.coalesce(F.col("symmetric"), F.lit(False))
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "type", F.lit("outgoing").alias("via"), F.col("_ord"), sym.alias("_s"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), "type", F.lit("incoming").alias("via"), F.col("_ord"), sym.alias("_s"))
    ways = {"outgoing": [out, back.filter("_s").withColumn("via", F.lit("symmetric"))], "incoming": [back, out.filter("_s").withColumn("via", F.lit("symmetric"))]}
    parts = ways["outgoing"] + ways["incoming"] if direction == "both" else ways[direction]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.drop("_s")


def neighbors(edges: DataFrame, start: DataFrame, depth: int = 1, types: list[str] | None = None, direction: str = "both", symmetric: Column | None = None) -> DataFrame:
    """node, depth, type, via for every node within ``depth`` steps of the nodes in ``start`` (column node), those excluded.

    Each node once, at its least depth, by the edge with the least ``_ord`` (outgoing before incoming before symmetric).
    Each level is one join of the frontier with the arcs and one anti join with what is known.
    """
    steps = arcs(edges if types is None else edges.filter(F.col("type").isin(types)), direction, symmetric)
    order = F.when(F.col("via") == "outgoing", 0).when(F.col("via") == "incoming", 1).otherwise(2)
    seen = start.select("node").distinct()
    frontier, found = seen, None
    for level in range(1, depth + 1):
        reach = steps.join(frontier.withColumnRenamed("node", "src"), "src", "left_semi").join(seen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        best = reach.groupBy("dst").agg(F.min_by(F.struct("type", "via"), F.struct("_ord", order.alias("o"))).alias("x"))
        new = best.select(F.col("dst").alias("node"), F.lit(level).alias("depth"), "x.type", "x.via").checkpoint() if depth > 2 else best.select(F.col("dst").alias("node"), F.lit(level).alias("depth"), "x.type", "x.via")
        found = new if found is None else found.unionByName(new)
        frontier = new.select("node")
        seen = seen.union(frontier)
    return found


def descendants(spark: SparkSession, tree: DataFrame, root: DataFrame, levels: int = 8) -> DataFrame:
    """id, depth of everything below the roots, at its least depth; the roots are not below themselves. ``tree``: id, parent.

    Level by level until nothing new is reached, so any depth; a row that is known ends a cycle. ``levels`` of them are
    one job.
    """
    steps = tree.select("id", F.col("parent").alias("_up")).distinct()
    known = root.select("id", F.lit(0).alias("depth")).distinct()
    frontier, at = known, 0
    while not frontier.isEmpty():
        found = []
        for _ in range(levels):
            at += 1
            frontier = steps.join(frontier.select(F.col("id").alias("_up")), "_up").select("id", F.lit(at).alias("depth")).distinct()
            found.append(frontier)
        reached = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.min("depth").alias("depth")).join(known.select("id"), "id", "left_anti").checkpoint()
        known = known.unionByName(reached)
        frontier = reached.filter(F.col("depth") == at)
    return known.filter("depth > 0")


def _cyclic(tree: DataFrame) -> DataFrame:
    """id of the rows whose way up never ends: pointers double until all are at a root or as many steps as rows are taken.

    Only (id, pointer) pairs are shipped, so a cycle costs rounds and no memory. ``tree``: id, parent; a parent that is not there ends
    the way like a root.
    """
    up = tree.select("id", F.col("parent").alias("_at")).filter("_at is not null").checkpoint()
    for _ in range(max(1, tree.count()).bit_length() + 1):
        if up.isEmpty():
            break
        above = up.select(F.col("id").alias("_at"), F.col("_at").alias("_next"))
        up = up.join(above, "_at").select("id", F.col("_next").alias("_at")).checkpoint()  # rows that reached their root drop out
    return up.select("id")


def _climbed(tree: DataFrame, value: Column) -> DataFrame:
    """id, path (the ``value`` of each row from the root down to the row; null if cyclic), cyclic (the way up never ends).

    Each round joins every row to where its way up has come so far, so ways double and depth n takes log2(n) rounds. Cyclic rows
    are found first and have no path, so no path is longer than the depth.
    """
    cyclic = _cyclic(tree)
    ways = tree.join(cyclic, "id", "left_anti").select("id", F.col("parent").alias("_at"), F.array(value).alias("path")).checkpoint()
    while not ways.filter("_at is not null").isEmpty():
        above = ways.select(F.col("id").alias("_at"), F.col("_at").alias("_next"), F.col("path").alias("_path"))
        on = ways.join(above, "_at", "left")
        # a parent that is not there ends the way like a root
        ways = on.select("id", F.col("_next").alias("_at"), F.when(F.col("_path").isNotNull(), F.concat("_path", "path")).otherwise(F.col("path")).alias("path")).checkpoint()
    return ways.select("id", "path", F.lit(False).alias("cyclic")).unionByName(cyclic.select("id", F.lit(True).alias("cyclic")), allowMissingColumns=True)


def root_paths(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """id, path (names from the root down to the row), at any depth. ``tree``: id, parent, name. Rows without a way to a
    root (below a cycle, or below a parent that is not there) have no path and are absent."""
    there = tree.select(F.col("id").alias("parent")).distinct().withColumn("_there", F.lit(True))
    rooted = tree.join(there, "parent", "left").withColumn("name", F.struct("name", (F.col("parent").isNotNull() & F.col("_there").isNull()).alias("lost")))
    climbed = _climbed(rooted.select("id", "parent", "name"), F.col("name")).filter(~F.col("cyclic")).filter(~F.exists("path", lambda x: x["lost"]))
    return climbed.select("id", F.transform("path", lambda x: x["name"]).alias("path"))


def path_suffix(paths: DataFrame, wanted: list[str]) -> DataFrame:
    """Rows whose path ends with the wanted names, with ``matches`` (1 is a find, more is ambiguous)."""
    n = len(wanted)
    hit = paths.filter((F.size("path") >= n) & (F.slice("path", -n, n) == F.array(*[F.lit(w) for w in wanted])))
    return hit.crossJoin(F.broadcast(hit.agg(F.count(F.lit(1)).cast("int").alias("matches"))))  # one row: the count


def resolve_paths(tree: DataFrame, wanted: DataFrame, levels: int = 4) -> DataFrame:
    """Where paths of names lead: rid, id, status, segment, matches; one row for each row of ``wanted`` (rid, path, key).

    ``tree``: id, parent, name, key. A path is taken level by level from the top, all requests in one join a level: the frontier
    carries each request's place. status is found, top (no path and no key, or a path of slashes: id is null), missing or
    conflict (the first ``segment`` that no row, or several rows, of that level have; nothing is looked up below), or invalid (a blank
    path, a key that is not eight letters and digits). A key goes before a path, in any case of letters. ``levels`` joins are one job.
    """
    children = tree.groupBy("parent", "name").agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")).select(F.col("parent").alias("_p"), F.col("name").alias("_name"), "_n", "_id").checkpoint()
    by_key = tree.filter("key is not null").groupBy(F.upper("key").alias("_key")).agg(F.min("id").alias("_kid"))
    has_key = F.coalesce(F.col("key"), F.lit("")) != ""
    asked = wanted.select("rid", "path", "key").withColumn("_key", F.when(has_key, F.upper("key"))).join(by_key, "_key", "left")
    segments = F.filter(F.transform(F.split("path", "/"), lambda s: F.trim(s)), lambda s: s != "")
    start = (
        F.when(has_key & ~F.col("key").rlike("^[A-Za-z0-9]{8}$"), "invalid").when(has_key & F.col("_kid").isNull(), "missing").when(has_key, "found")
        .when(F.col("path").isNull(), "top").when(F.trim("path") == "", "invalid").when(F.size(segments) == 0, "top")
    )
    state = asked.select(
        "rid", F.when(start == "found", F.col("_kid")).alias("id"), start.alias("status"), F.when(start.isNull(), segments).alias("_todo"),
        F.when(start == "missing", F.col("key")).alias("segment"), F.lit(None).cast("long").alias("matches"),
    ).checkpoint()
    done, at = state.filter("status is not null"), 0
    state = state.filter("status is null")
    while not state.isEmpty():
        for _ in range(levels):
            at += 1
            here = F.when(F.col("status").isNull(), F.get("_todo", F.lit(at - 1)))
            step = state.withColumn("_s", here).join(children, F.col("id").eqNullSafe(F.col("_p")) & (F.col("_s") == F.col("_name")), "left")
            n = F.coalesce("_n", F.lit(0))
            stop = F.when(n == 0, "missing").when(n > 1, "conflict").when(F.size("_todo") == at, "found")
            on = F.col("status").isNull()
            state = step.select(
                "rid", F.when(on & (n == 1), F.col("_id")).when(on & (n != 1), F.lit(None)).otherwise(F.col("id")).alias("id"), F.when(on, stop).otherwise(F.col("status")).alias("status"), "_todo",
                F.when(on & (n != 1), F.col("_s")).otherwise(F.col("segment")).alias("segment"), F.when(on & (n > 1), n).otherwise(F.col("matches")).alias("matches"),
            )
        state = state.checkpoint()
        done = done.unionByName(state.filter("status is not null"))
        state = state.filter("status is null")
    return done.drop("_todo")


def tree_order(spark: SparkSession, tree: DataFrame) -> DataFrame:
    """Depth-first order of a tree of any depth, siblings by (name, id); rows whose parent is missing are roots marked as
    orphans; rows of a cycle or below one come last, marked ``cyclic``, by (name, id).

    Adds ``depth`` (null if cyclic), ``orphan``, ``cyclic`` and ``place`` (sort key).
    """
    ids = tree.select(F.col("id").alias("parent")).distinct().withColumn("_there", F.lit(True))
    marked = tree.join(ids, "parent", "left").withColumn("orphan", F.col("parent").isNotNull() & F.col("_there").isNull()).drop("_there")
    own = F.struct(F.lit(False).alias("cyclic"), "orphan", "name", "id")
    climbed = _climbed(marked.withColumn("parent", F.when(~F.col("orphan"), F.col("parent"))), own)
    last = F.struct(F.lit(True).alias("cyclic"), "orphan", "name", "id")
    out = marked.join(climbed, "id").withColumn("place", F.when(F.col("cyclic"), F.array(last)).otherwise(F.col("path")))
    return out.withColumn("depth", F.when(~F.col("cyclic"), F.size("path") - 1)).drop("path").orderBy("place")


def canonical(edges: DataFrame, symmetric: Column) -> DataFrame:
    """Edges with endpoints in order where undirected, ``symmetric`` set, and an error where a directed type claims to be."""
    return edges.withColumns({
        "error": F.when(F.coalesce(F.col("symmetric"), F.lit(False)) & ~symmetric, "symmetric flag on a directed type"),
        "_a": F.when(symmetric, F.least("from_id", "to_id")).otherwise(F.col("from_id")),
        "_b": F.when(symmetric, F.greatest("from_id", "to_id")).otherwise(F.col("to_id")),
    }).withColumns({"from_id": F.col("_a"), "to_id": F.col("_b"), "symmetric": F.when(symmetric, F.lit(True))}).drop("_a", "_b")


def leaf_first(tree: DataFrame) -> DataFrame:
    """id, round: order in which rows can be removed, leaves first, at any depth; rows of a cycle never come and are absent."""
    left, out, i = tree.select("id", "parent").checkpoint(), None, 0
    while True:
        parents = left.select(F.col("parent").alias("id")).filter("id is not null").distinct()
        leaves = left.join(parents, "id", "left_anti").select("id", F.lit(i).alias("round")).checkpoint()
        if leaves.isEmpty():
            break
        out = leaves if out is None else out.unionByName(leaves)
        left, i = left.join(leaves, "id", "left_anti").checkpoint(), i + 1
    return out if out is not None else left.select("id", F.lit(0).alias("round")).limit(0)
