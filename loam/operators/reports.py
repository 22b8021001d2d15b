"""Gathering of candidates, resolution of jobs, plans and reports: the steps around a table that end a command."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import predicates, quality, sinks, windows


def today(as_of: str | None = None) -> Column:
    """The day as yyyy-MM-dd: a given one, or the session's (UTC in sessions of this package)."""
    return F.lit(as_of) if as_of else F.date_format(F.current_date(), "yyyy-MM-dd")


def first_of_each(df: DataFrame, key: str, most: int) -> DataFrame:
    """The first ``most`` rows of each key by ``_ord``."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_ord"))).filter(F.col("_n") <= most).drop("_n")


def gather_anchors(related: DataFrame, references: DataFrame, citations: DataFrame, per_anchor: int, per_channel: int = 30, expand: bool = True) -> DataFrame:
    """Candidates of three channels for each anchor: related works, and unless ``expand`` is off what the anchor cites and
    what cites it. Inputs: anchor, _ord and the candidate's columns. Adds ``sources`` and ``anchors``; a channel without
    rows for an anchor gives none."""

    def channel(df: DataFrame, source: str, most: int) -> DataFrame:
        return first_of_each(df, "anchor", most).withColumns({"sources": F.array(F.lit(source)), "anchors": F.array("anchor")}).drop("anchor")

    parts = [channel(related, "literature_recommend", per_anchor)]
    if expand:
        parts += [channel(references, "literature_reference", per_channel), channel(citations, "literature_citation", per_channel)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gather_topic(hits: DataFrame, limit: int, since: int | None = None) -> DataFrame:
    """Candidates of each query, the first ``limit`` of those from ``since`` on, with ``sources`` and ``queries``.
    ``hits``: query, year, _ord and the candidate's columns."""
    out = first_of_each(predicates.since_year(hits, "year", since), "query", limit)
    return out.withColumns({"sources": F.array(F.lit("literature_search")), "queries": F.array("query")}).drop("query")


def claim_links(experiments: DataFrame, claims: DataFrame) -> DataFrame:
    """Experiments whose target claim is no page. ``experiments``: file, target_claim (slug, link or path); ``claims``: slug."""
    named = experiments.withColumn("target", X.reference_slug("target_claim")).filter("target <> ''")
    lost = named.join(claims.select(F.col("slug").alias("target")), "target", "left_anti")
    return lost.select(*quality.finding("yellow", "broken-claim-ref", F.col("file"), F.concat(F.lit("target_claim="), "target")))


def evidence_pack(pages: DataFrame, grounded: DataFrame, coverage: DataFrame) -> DataFrame:
    """Findings about the evidence of paper pages: no section, quotes that no source has, no evidence id or source file,
    cards that are missing. ``pages``: file, body; ``grounded``: file, quote, grounded; ``coverage``: file, label, missing."""
    part = X.section("body", "Evidence Pack")
    has = pages.withColumn("part", F.trim(part))
    none = has.filter("part = ''").select(*quality.finding("red", "missing-evidence-pack", F.col("file"), F.lit("no ## Evidence Pack")))
    filled = has.filter("part <> ''")
    no_id = filled.filter(~F.col("part").rlike(r"\bE[1-9][0-9]*\b|\bsource_file\b"))
    ids = no_id.select(*quality.finding("red", "missing-evidence-card-id", F.col("file"), F.lit("no evidence id and no source_file")))
    there = filled.select("file")
    quotes = grounded.filter(~F.col("grounded")).join(there, "file", "left_semi").select(*quality.finding("red", "ungrounded-quote", F.col("file"), F.col("quote")))
    cards = coverage.filter("missing > 0").join(there, "file", "left_semi").select(*quality.finding("yellow", "evidence-coverage", F.col("file"), F.concat_ws("", "label", F.lit(": "), F.col("missing").cast("string"))))
    return quality.union_all([none, quotes, ids, cards])


def resolved_jobs(jobs: DataFrame, lookup: DataFrame) -> DataFrame:
    """Jobs with the one input that a lookup table has for them: ``status`` is ready, missing (none) or ambiguous (several).
    ``jobs``: id; ``lookup``: id, path."""
    found = lookup.groupBy("id").agg(F.count_distinct("path").alias("_n"), F.min("path").alias("_path"))
    out = jobs.join(found, "id", "left")
    status = F.when(F.col("_n") == 1, "ready").when(F.col("_n") > 1, "ambiguous").otherwise("missing")
    return out.withColumns({"status": status, "path": F.when(F.col("_n") == 1, F.col("_path"))}).drop("_n", "_path")


def match_totals(matches: DataFrame) -> DataFrame:
    """One row: how many pages matched, how many did not, and by which way. ``matches``: rid, how."""
    return matches.agg(F.count("rid").alias("matched"), F.count_if(F.col("rid").isNull()).alias("unresolved"), F.count_if(F.col("how") == "doi").alias("by_doi"), F.count_if(F.col("how") == "title").alias("by_title"))


def source_manifest(prepared: DataFrame, order: list[Column]) -> DataFrame:
    """Prepared sources with ``shortlist_rank``, from 1."""
    return windows.dense_ordinal(prepared, order, "shortlist_rank", bins=8)


def workspaces(paths: DataFrame, paper: str | None = None) -> DataFrame:
    """paper, draft, files: workspaces below ``papers/<paper>/drafts/<draft>/`` with a manifest; names of letters, digits, '.', '_', '-'."""
    m = r"^papers/([A-Za-z0-9][A-Za-z0-9._-]*)/drafts/([A-Za-z0-9][A-Za-z0-9._-]*)/(.+)$"
    cut = paths.select(*[F.regexp_extract("path", m, i).alias(n) for i, n in ((1, "paper"), (2, "draft"), (3, "file"))]).filter("file <> ''")
    cut = cut.filter(F.col("paper") == paper) if paper else cut
    return cut.groupBy("paper", "draft").agg(F.count(F.lit(1)).alias("files"), F.bool_or(F.col("file") == "manifest.json").alias("_ok")).filter("_ok").drop("_ok")


def next_workspace(have: DataFrame, paper: str, draft: str) -> str:
    """Path of a new draft's version: v1, or one more than the last. ``have``: paper, draft ('name-vN')."""
    last = have.filter(F.col("paper") == paper).select(F.regexp_extract("draft", rf"^\Q{draft}\E-v(\d+)$", 1).try_cast("int").alias("v")).agg(F.max("v")).first()[0]
    return f"papers/{paper}/drafts/{draft}-v{(last or 0) + 1}"


def reset_plan(files: DataFrame, scopes: dict[str, list[str]], chosen: list[str], keep: list[str]) -> DataFrame:
    """path, scope, action (delete or keep) of every file below the folders of the chosen scopes; nothing is deleted here."""
    unknown = set(chosen) - set(scopes)
    if unknown:
        raise ValueError(f"no such scope: {', '.join(sorted(unknown))}")
    scope = reduce(lambda c, s: c.when(predicates.under_paths(F.col("path"), scopes[s]), s), chosen, F.when(F.lit(False), ""))
    kept = predicates.under_paths(F.col("path"), keep) if keep else F.lit(False)
    return files.withColumn("scope", scope).filter("scope is not null").select("path", "scope", F.when(kept, "keep").otherwise("delete").alias("action"))


def relocation_plan(files: DataFrame, moves: dict[str, str]) -> DataFrame:
    """path, target, status of files below the folders to move: move, or conflict where the target is there and stays."""
    target = reduce(lambda c, m: c.when(F.col("path").startswith(m[0]), F.concat(F.lit(m[1]), F.expr(f"substring(path, {len(m[0]) + 1})"))), sorted(moves.items(), key=lambda m: -len(m[0])), F.when(F.lit(False), ""))
    plan = files.withColumn("target", target).filter("target is not null")
    stay = files.join(plan.select("path"), "path", "left_anti").select(F.col("path").alias("target"), F.lit(True).alias("_there"))
    return plan.join(stay, "target", "left").select("path", "target", F.when(F.col("_there"), "conflict").otherwise("move").alias("status"))


def audit_rows(entries: DataFrame, at: Column) -> DataFrame:
    """One JSON line for each entry, with the time and its place in the order of ``_ord``; append with ``write.mode('append').text``."""
    return entries.select("_ord", F.to_json(F.struct(at.alias("at"), *[c for c in entries.columns if c != "_ord"])).alias("value"))


def atomic_json(df: DataFrame, path: str) -> None:
    """Replace a JSON folder by ``df`` as a whole."""
    sinks.swap(df, path, "json")


def grouped_report(items: DataFrame, limit: int, order: list[Column], group: str, groups: list[str], line: Column, title: str, nothing: str) -> DataFrame:
    """place, text: a Markdown report of the first ``limit`` items, cut before grouping; groups in the given order, those
    without items left out. One row if there are none."""
    best = items.orderBy(*order).limit(limit).withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # over ``limit`` rows
    rank = F.array_position(F.array(*map(F.lit, groups)), F.col(group)).cast("int")
    body = best.select(rank.alias("place"), F.col(group).alias("g"), "_n", line.alias("line")).filter("place > 0")
    parts = body.groupBy("place", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    text = parts.select("place", F.concat(F.lit("## "), F.initcap("g"), F.lit("\n\n"), "lines", F.lit("\n")).alias("text"))
    head = items.limit(1).agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("place"), F.when(F.col("n") > 0, F.lit(f"# {title}\n")).otherwise(f"# {title}\n\n{nothing}\n").alias("text"))
    return head.unionByName(text).orderBy("place")


def shortlist_report(shortlist: DataFrame, total: int) -> DataFrame:
    """place, text: one numbered line for each candidate, under a line with the counts."""
    n = F.row_number().over(Window.orderBy(F.col("score").desc(), "_ord"))  # a shortlist is some dozen rows
    said = F.format_string("%d. **%s** (%.2f) %s", n, F.col("title"), F.col("score"), F.coalesce("rationale", F.lit("")))
    rows = shortlist.select(n.alias("place"), F.rtrim(said).alias("text"))
    head = shortlist.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).alias("place"), F.format_string("%d of %d candidates", F.col("n"), F.lit(total)).alias("text"))
    return head.unionByName(rows).orderBy("place")


def queue_report(jobs: DataFrame) -> DataFrame:
    """rank, text: one table line for each job, most important first. ``jobs``: rank, id, pages, importance, papers."""
    return jobs.select("rank", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("rank").cast("string"), F.left("id", F.lit(12)), F.col("pages").cast("string"), F.col("importance").cast("string"), F.array_join("papers", ", ")), F.lit(" |")).alias("text")).orderBy("rank")


def missing_back_links(refs: DataFrame, pages: DataFrame, section: str) -> DataFrame:
    """target, action, line: what a repair of one-way references adds to which section; structured, so nothing is parsed back."""
    lost = refs.join(pages.select(F.col("slug").alias("target")), "target", "left_semi")
    return lost.select("target", F.lit(f"append to {section}").alias("action"), F.concat(F.lit("- [["), "page", F.lit("]]")).alias("line")).distinct()


def moved_bibtex(df: DataFrame, header: str, body: str, allowed: list[str]) -> DataFrame:
    """body, bibtex, extra: the entry of the header or of the body's section, put into one section at the end; ``extra`` are
    its fields beyond the allowed ones."""
    own = F.trim(F.regexp_extract(body, r"(?s)## BibTeX\s*```bibtex\s*(.*?)\s*```", 1))
    entry = F.coalesce(F.nullif(own, F.lit("")), F.trim(F.coalesce(F.col(header), F.lit(""))))
    rest = F.regexp_replace(F.regexp_replace(body, r"(?s)\s*## BibTeX\s*```bibtex.*?```", ""), r"\s+\z", "")
    fields = F.transform(F.regexp_extract_all(entry, F.lit(r"(?m)^\s*(\w+)\s*="), F.lit(1)), lambda x: F.lower(x))
    new = F.when(entry == "", rest).otherwise(F.concat(rest, F.lit("\n\n## BibTeX\n\n```bibtex\n"), entry, F.lit("\n```")))
    return df.withColumns({"bibtex": entry, "extra": F.array_sort(F.array_except(fields, F.array(*map(F.lit, allowed)))), body: F.concat(new, F.lit("\n"))})


def salvaged_header(spark: SparkSession, pages: DataFrame, keys: list[str]) -> DataFrame:
    """The given scalar keys of a page's header, by one expression each: what a header that no parser takes still gives."""
    top = F.regexp_extract("text", r"(?s)\A\x{feff}?---[ \t]*\r?\n(.*?)\r?\n---", 1)
    return pages.withColumns({k: F.nullif(F.regexp_replace(F.trim(F.regexp_extract(top, rf"(?m)^{k}:[ \t]*(.*)$", 1)), r"^[\"']|[\"']$", ""), F.lit("")) for k in keys})
