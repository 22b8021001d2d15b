"""Order-dependent operators: keep-first, ranks, carry-forward, budgets, margins, top-k.

``_ord`` is the arrival order that every source emits; each sort ends with it, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: str = "_ord") -> DataFrame:
    """One row of each key, the first by order. Aggregates before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def repeats(df: DataFrame, keys: list[str], order: str = "_ord") -> DataFrame:
    """Every row of a key but the first, with ``first_ord``."""
    first = df.groupBy(*keys).agg(F.min(order).alias("first_ord"))
    return df.join(first, keys).filter(F.col(order) > F.col("first_ord"))


def dense_ordinal(df: DataFrame, order: list[Column], name: str = "rank", bins: int = 64) -> DataFrame:
    """Rank from 1 over the whole table: sorted in ranges, with each range's rank offset from counts, not in one task."""
    ranged = df.repartitionByRange(bins, *order).withColumn("_p", F.spark_partition_id()).sortWithinPartitions(*order).checkpoint()
    counts = ranged.groupBy("_p").count()
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over ``bins`` rows
    base = counts.select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_p").orderBy(*order)
    return ranged.withColumn("_n", F.row_number().over(inside)).join(F.broadcast(base), "_p").withColumn(name, F.col("_base") + F.col("_n")).drop("_p", "_n", "_base")


def suffix_collisions(df: DataFrame, target: str, suffix: str = "-old", keep_if: Column | None = None) -> DataFrame:
    """All rows that share a target get the suffix."""
    many = df.groupBy(target).agg(F.count(F.lit(1)).alias("_n"))
    hit = (F.col("_n") > 1) & (~keep_if if keep_if is not None else F.lit(True))
    return df.join(many, target).withColumn(target, F.when(hit, F.concat(target, F.lit(suffix))).otherwise(F.col(target))).drop("_n")


def top_with_margin(df: DataFrame, key: str, score: str, least: float, margin: float) -> DataFrame:
    """The best row of each key if it reaches ``least`` and leads the second by ``margin``."""
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), "_ord")
    ranked = df.withColumn("_rn", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.filter((F.col("_rn") == 1) & (F.col(score) >= least) & (F.col("_next").isNull() | (F.col(score) - F.col("_next") >= margin))).drop("_rn", "_next")


def carry_forward(df: DataFrame, part: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row, inside a document."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(Window.partitionBy(*part).orderBy(order)))


def group_records(lines: DataFrame, part: list[str], order: str, is_header: Column) -> DataFrame:
    """Number each header line starts a record with; lines before the first header have record 0."""
    return lines.withColumn("record", F.sum(is_header.cast("int")).over(Window.partitionBy(*part).orderBy(order)))


def budget(df: DataFrame, part: list[str], order: list[Column], size: Column, limit: Column, tail: int = 100) -> DataFrame:
    """Rows up to the first that overflows the limit; that one is cut to what remains if that is more than ``tail``.

    Adds ``used`` (before the row) and ``taken`` (its size in the pack).
    """
    w = Window.partitionBy(*part).orderBy(*order)
    out = df.withColumn("_size", size).withColumn("_end", F.sum("_size").over(w)).withColumn("used", F.col("_end") - F.col("_size"))
    remains = limit - F.col("used")
    taken = F.when(F.col("_end") <= limit, F.col("_size")).when(remains > tail, remains)
    first_over = F.min(F.when(F.col("_end") > limit, F.col("_end"))).over(Window.partitionBy(*part))
    out = out.withColumn("taken", taken).withColumn("_over", first_over)
    return out.filter("taken is not null and (_over is null or _end <= _over)").drop("_size", "_end", "_over")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Best k rows; plans as a take of each partition's best."""
    return df.orderBy(*order).limit(k)


def tail_k(df: DataFrame, k: int, order: str = "_ord") -> DataFrame:
    """Last k rows by arrival, in arrival order."""
    return df.orderBy(F.col(order).desc()).limit(k).orderBy(order)


def near_best(df: DataFrame, key: str, score: str, tie: str, below: int = 3, least: int = 4, most: int = 5) -> DataFrame:
    """Scores of a key that reach max(least, best - below), the ``most`` best of them."""
    w = Window.partitionBy(key)
    ok = df.withColumn("_top", F.max(score).over(w)).filter(F.col(score) >= F.greatest(F.lit(least), F.col("_top") - below))
    return ok.withColumn("rank", F.row_number().over(w.orderBy(F.col(score).desc(), tie))).filter(F.col("rank") <= most).drop("_top")
