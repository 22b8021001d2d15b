"""Counts, merges and group operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model


def degree(edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """node, degree: edges at each node; a self edge counts twice."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """One row: findings of each level and whether any is red."""
    return findings.agg(*[F.count_if(F.col("level") == x).alias(x) for x in ("red", "yellow", "blue")], F.coalesce(F.bool_or(F.col("level") == "red"), F.lit(False)).alias("failed"))


def maturity(counts: DataFrame) -> DataFrame:
    """Density, coverage and level of a graph. ``counts``: one row with entities, papers, claims, experiments_done, edges, has_experiment_evidence."""
    density = F.least(F.lit(1.0), F.col("edges") / F.greatest(F.lit(1), F.col("entities") * (F.col("entities") - 1)))
    coverage = F.least(F.lit(1.0), F.col("papers") / 20 * 0.3 + F.col("claims") / 40 * 0.3 + F.col("experiments_done") / 5 * 0.2 + F.col("edges") / 50 * 0.2)
    hot = (F.col("papers") >= 20) & (F.col("claims") >= 40) & F.col("has_experiment_evidence")
    warm = (F.col("papers") >= 5) & (F.col("claims") >= 10)
    level = F.when(hot, "hot").when(warm, "warm").otherwise("cold")
    return counts.withColumns({"graph_density": density, "coverage_score": coverage, "level": level})


def edge_key(edges: DataFrame, symmetric: Column) -> DataFrame:
    """key_from, key_to: endpoints, sorted where the edge has no direction."""
    return edges.withColumns({
        "key_from": F.when(symmetric, F.least("from_id", "to_id")).otherwise(F.col("from_id")),
        "key_to": F.when(symmetric, F.greatest("from_id", "to_id")).otherwise(F.col("to_id")),
    })


def candidate_key(doi: Column, provider_id: Column, title: Column, doi_shaped_ids: bool = True) -> Column:
    """doi: over provider: over title:; '' if none. With ``doi_shaped_ids`` a provider id that is a DOI counts as one."""
    d, p = F.lower(F.coalesce(doi, F.lit(""))), F.trim(F.coalesce(provider_id, F.lit("")))
    t = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), r"\s+", " "))
    out = F.when(d != "", F.concat(F.lit("doi:"), d))
    if doi_shaped_ids:
        out = out.when(F.lower(p).rlike(r"^10\.\d{4,9}/\S+$"), F.concat(F.lit("doi:"), F.lower(p)))
    return out.when(p != "", F.concat(F.lit("provider:"), F.lower(p))).when(t != "", F.concat(F.lit("title:"), t)).otherwise("")


def ordered_union(column: str, order: str = "_ord") -> Column:
    """Distinct elements of all arrays of a group, in order of first arrival. Bounded by the group's distinct values per task."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(column), F.array().cast("array<string>")).alias("x"))))
    return F.array_distinct(F.filter(F.flatten(F.transform(parts, lambda p: p["x"])), lambda v: v != ""))


def first_filled(column: str, order: str = "_ord") -> Column:
    """The first non-empty value of a group."""
    c = F.col(column)
    return F.min_by(c, F.when(c.isNotNull() & (c.cast("string") != ""), F.col(order)))


def merge_candidates(df: DataFrame) -> DataFrame:
    """One row for each key: unions of lists, first filled texts, largest numbers, any influential edge; rows without key go."""
    keyed = df.withColumn("key", candidate_key(F.col("doi"), F.col("id"), F.col("title"))).filter("key <> ''")
    lists = [ordered_union(c).alias(c) for c in ("sources", "anchors", "providers", "queries")]
    texts = [first_filled(c).alias(c) for c in ("abstract", "tldr", "venue", "url", "year")]
    arrays = [F.min_by(c, F.when(F.size(c) > 0, F.col("_ord"))).alias(c) for c in ("authors", "fields")]
    own = [F.min_by(c, F.col("_ord")).alias(c) for c in ("id", "doi", "title")]
    numbers = [F.max(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("citations", "influential", "max_h_index")]
    return keyed.groupBy("key").agg(*own, *texts, *arrays, *lists, *numbers, F.bool_or(F.coalesce("influential_edge", F.lit(False))).alias("influential_edge"), F.min("_ord").alias("_ord"))


def content_jobs(df: DataFrame, content: Column, importance: Column, member: str) -> DataFrame:
    """One job for each distinct content: members, most importance. Hashes, not contents, are shuffled."""
    hashed = df.select(F.sha2(content, 256).alias("sha"), importance.alias("importance"), F.col(member).alias("member"))
    return hashed.groupBy("sha").agg(F.max("importance").alias("importance"), F.count(F.lit(1)).alias("members"), F.min("member").alias("first_member"))


def label_counts(cards: DataFrame, page: str, label: str, labels: list[str]) -> DataFrame:
    """Cards of a page by label, one column for each."""
    return cards.groupBy(page).agg(*[F.count_if(F.col(label) == x).alias(x) for x in labels])


def use_counts(pages: DataFrame, page: str, text: str) -> DataFrame:
    """Evidence cards of a page's section by use label, one column for each of ``model.USE_LABELS``. A card's first line says its use after its
    id and before a dash; one of the older cards, that does not, counts for the first label in the list that is a word of its line."""
    lines = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"(?m)^[ \t]*-\s+`E\d+`.*$"), F.lit(0))
    said = F.initcap(F.regexp_extract("_l", rf"(?i)^[ \t]*-\s+`E\d+`\s+({'|'.join(model.USE_LABELS)})\s+—", 1))
    old = F.coalesce(*[F.when(F.col("_l").rlike(rf"(?i)\b{x}\b"), x) for x in model.USE_LABELS])
    each = pages.select(page, F.explode_outer(lines).alias("_l")).withColumn("_u", F.when(said != "", said).otherwise(old))
    return label_counts(each, page, "_u", model.USE_LABELS)


#: Counts of pages by kind, and by a kind's status.
STATS = {"papers": "papers", "concepts": "concepts", "topics": "topics", "people": "people", "ideas": "ideas", "experiments": "experiments", "claims": "claims", "summaries": "Summary"}
STATUS_STATS = {"ideas_validated": ("ideas", "validated"), "ideas_failed": ("ideas", "failed"), "claims_supported": ("claims", "supported"), "claims_challenged": ("claims", "challenged")}


def vault_stats(pages: DataFrame, edges: DataFrame, citations: DataFrame) -> DataFrame:
    """One row of fourteen counts in two passes: pages of each kind (those without a header too), some by their status as it is written, edges
    and citations. ``pages``: kind, header (map)."""
    kind, status = F.col("kind"), F.try_element_at("header", F.lit("status"))
    counts = [F.count_if(kind == k).alias(name) for name, k in STATS.items()] + [F.count_if((kind == k) & (status == v)).alias(name) for name, (k, v) in STATUS_STATS.items()]
    rows = edges.select(F.lit(1).alias("e")).unionByName(citations.select(F.lit(2).alias("e")))
    graph = rows.agg(F.count_if(F.col("e") == 1).alias("edges"), F.count_if(F.col("e") == 2).alias("citations"))
    return pages.agg(*counts).crossJoin(graph)  # one row each


def weighted_sum(rules: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
    """(score, reasons) of weighted conditions."""
    score = sum((F.when(F.coalesce(c, F.lit(False)), w).otherwise(0) for _, c, w in rules), F.lit(0))
    return score, F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c, _ in rules])), ", ")


def max_h_index(authors: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(authors, lambda a: a["hIndex"])), F.lit(0))


def catalog(df: DataFrame, kind: str, slug: str, fields: list[str]) -> DataFrame:
    """kind, slug and the given fields as JSON, without nulls and empty lists."""
    return df.select(F.lit(kind).alias("kind"), F.col(slug).cast("string").alias("slug"), F.to_json(F.struct(*fields)).alias("fields"))


def report_by_file(findings: DataFrame, file: str = "file") -> DataFrame:
    """Findings of each file with red and warning counts, worst first."""
    g = findings.groupBy(file).agg(F.count_if(F.col("severity") == "red").alias("red"), F.count_if(F.col("severity") == "warn").alias("warn"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.col("red").desc(), F.col("warn").desc(), file)


