"""Whole commands as one lazy plan each: shortlist, context pack, open questions, collection listing, page matching, lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import text as X
from ..operators import aggregates, graph, joins, predicates, quality, reports, scoring, sinks, windows


def recommend(hits: DataFrame, anchors: DataFrame, negatives: DataFrame, limit: int) -> DataFrame:
    """Search hits without the anchors and the negatives, keep-first by key, the first ``limit``. All have a column key."""
    fresh = hits.join(anchors.select("key"), "key", "left_anti").join(negatives.select("key"), "key", "left_anti")
    return windows.keep_first(fresh, ["key"]).orderBy("_ord").limit(limit)


def point_lookup(works: DataFrame, identifier: str) -> DataFrame:
    """The work with the DOI if the identifier is one, else the first hit."""
    d = identifier.strip().lower().removeprefix("https://doi.org/").removeprefix("doi:")
    if d.startswith("10.") and "/" in d:
        return works.filter(X.doi("doi") == d).limit(1)
    return works.orderBy("_ord").limit(1)


def shortlist(
    candidates: DataFrame, known: DataFrame, as_of_year: int, mode: str = "anchor", queries: list[str] | None = None, groups: list[str] | None = None,
    since: int | None = None, limit: int = 12, library: DataFrame | None = None,
) -> DataFrame:
    """Merge, drop what is known, gate, score, sort, cut; the library status is joined to the shortlist only.

    ``candidates`` follow ``model.CANDIDATE_SCHEMA``; ``known`` has a column key. Adds key, score, rationale, total, status.
    """
    merged = aggregates.merge_candidates(candidates).join(known.select("key"), "key", "left_anti")
    gated = merged.filter(predicates.not_old_and_rarely_cited(F.col("year"), F.col("citations")))
    if mode == "topic":
        gated = predicates.since_year(gated, "year", since)
        said = F.concat_ws(" ", "abstract", "tldr", "venue")
        rel = scoring.topic_relevance(X.topic_tokens("title"), X.topic_tokens(said), [X.topic_tokens(F.lit(q)) for q in queries or []])
        gated = gated.withColumn("_r", rel).withColumns({"topic_relevance": F.col("_r.score"), "topic_matches": F.col("_r.matches")}).drop("_r")
        gated = gated.filter(predicates.topic_gate(F.col("topic_relevance"), F.col("topic_matches"), queries or []))
        gated = gated.filter(predicates.term_groups(F.concat_ws(" ", "title", said), groups or []))
    scored = scoring.rationale(scoring.rank_score(gated, as_of_year, mode), mode == "anchor")
    if mode == "anchor":
        scored = scored.filter(predicates.heavily_related(F.col("sources"), F.col("anchors"), F.col("influential_edge")))
    total = scored.agg(F.count(F.lit(1)).alias("total"))
    best = windows.top_k(scored, limit, F.col("score").desc(), F.col("_ord")).crossJoin(F.broadcast(total))  # one row: the count
    return joins.library_status(best, library).orderBy(F.col("score").desc(), "_ord")


def open_questions(pages: DataFrame, claims: DataFrame, sections: dict[str, str]) -> DataFrame:
    """branch, slug, pos, line: bullets of the named sections of each kind, then weak claims. ``pages``: kind, slug, body, _ord."""
    out = None
    for i, (kind, heading) in enumerate(sections.items()):
        one = pages.filter(F.col("kind") == kind).select(F.lit(i).alias("branch"), "slug", F.col("_ord"), F.posexplode(X.section_items("body", heading)).alias("pos", "line"))
        out = one if out is None else out.unionByName(one)
    weak = predicates.weak(claims, "confidence", "status").select(F.lit(len(sections)).alias("branch"), "slug", "_ord", F.lit(0).alias("pos"), F.concat_ws("", F.lit("weak claim: "), "title").alias("line"))
    return out.unionByName(weak).orderBy("branch", "_ord", "pos")


def stale(df: DataFrame, date: str, as_of: str, days: int = 30, typed_dates: bool = True) -> DataFrame:
    """Rows last changed more than ``days`` before ``as_of``. Without ``typed_dates`` only dates kept as text count."""
    value = F.col(date)
    if not typed_dates:
        value = F.when(F.typeof(value) == "string", value)
    return df.filter(F.date_diff(F.lit(as_of).cast("date"), value.cast("string").try_cast("date")) > days)


def context_pack(spark: SparkSession, lines: DataFrame, purpose: str, most_chars: int = 8000) -> DataFrame:
    """section, text: each section's lines cut to its budget, the whole cut to ``most_chars``. ``lines``: section, _ord, line."""
    limits = model.budgets_table(spark).filter(F.col("purpose") == purpose).select("section", "pos", F.col("budget").alias("most"))
    kept = windows.budget(lines.join(F.broadcast(limits), "section"), ["section"], [F.col("_ord")], F.length("line") + 1, F.col("most"))  # seven rows
    text = sinks.render(kept.withColumn("part", F.left("line", F.col("taken"))), ["section", "pos"], [F.col("_ord")], F.col("part"))
    whole = windows.budget(text.withColumn("_one", F.lit(1)), ["_one"], [F.col("pos")], F.length("text"), F.lit(most_chars))  # at most seven rows
    return whole.select("pos", "section", F.left("text", F.col("taken")).alias("text")).orderBy("pos")


#: Headings of the sections of a context pack, with the number of rows where they say it.
PACK_HEADINGS = {
    "claims": "## Claims (%d total)", "gaps": "## Open Gaps", "failed": "## Failed Ideas (avoid repeating)", "papers": "## Papers (%d total)",
    "experiments": "## Experiments (%d total)", "edges": "## Recent Relationships (%d total)", "stale": "## Stale Entities",
}


def context_lines(pages: DataFrame, edges: DataFrame, gaps: DataFrame, as_of: str) -> DataFrame:
    """section, rank, line, total: what each section of a context pack chooses, in its own order; ``total`` are all its rows.

    claims by degree, then path; gaps the lines that are no headings; failed (or rejected) ideas, experiments by path; papers the 15 of
    highest degree; edges the last 25 in file order; stale the first 10 pages, by kind and path, whose last date is over 30 days
    before ``as_of``. ``pages``: kind, slug, path, header (map); ``edges``: from_id, to_id, type, _ord; ``gaps``: _ord, line. No section keeps more
    rows than the largest budget has characters, so nothing here grows with the corpus but the counts.
    """
    most = max(max(b) for b in model.CONTEXT_BUDGETS.values())
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    at = lambda k: F.nullif(F.try_element_at("header", F.lit(k)), F.lit(""))
    title = F.coalesce(at("title"), "slug")
    of = lambda k: pages.filter(F.col("kind") == k)
    ranked = lambda k: of(k).withColumn("node", F.concat(F.lit(f"{k}/"), "slug")).join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    joined = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    after = lambda mark, c, end="": F.coalesce(F.concat(F.lit(mark), c, F.lit(end)), F.lit(""))
    date = F.coalesce(at("date_updated"), at("date_added"), at("date_proposed"))
    day = F.when(date.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), date.try_cast("date"))
    old = pages.withColumn("_day", day).filter(F.col("_day").cast("timestamp") < F.lit(as_of).cast("timestamp") - F.expr("INTERVAL 30 DAYS"))
    kind = F.array_position(F.array(*map(F.lit, model.KINDS)), F.col("kind"))
    path = F.col("path")
    parts = {
        "claims": (ranked("claims"), [F.col("degree").desc(), path], joined("- [", F.coalesce(at("status"), F.lit("unknown")), "] ", title, " (conf: ", F.coalesce(at("confidence"), F.lit("?")), ")"), most),
        "gaps": (gaps.filter(~F.col("line").startswith("#") & (F.trim("line") != "")), [F.col("_ord")], F.col("line"), most),
        "failed": (of("ideas").filter(at("status").isin("failed", "rejected")), [path], joined("- ", title, after(" — ", at("failure_reason"))), most),
        "papers": (ranked("papers"), [F.col("degree").desc(), path], joined("- [", F.coalesce(at("importance"), F.lit("?")), "] ", title, after(" (", at("domain"), ")")), 15),
        "experiments": (of("experiments"), [path], joined("- [", F.coalesce(at("status"), F.lit("")), "] ", title, after(" → ", at("target_claim")), after(" (", at("outcome"), ")")), most),
        "edges": (edges, [F.col("_ord").desc()], joined("  ", F.col("from_id"), " --", F.col("type"), "--> ", F.col("to_id")), 25),
        "stale": (old, [kind, path], joined("- ", F.col("kind"), "/", F.col("slug"), " (last: ", date, ")"), 10),
    }
    out = []
    for name, (rows, order, line, k) in parts.items():
        best = windows.top_k(rows.withColumn("line", line), k, *order)
        rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))  # over k rows
        best = best.select(F.lit(name).alias("section"), (-rank if name == "edges" else rank).alias("rank"), "line")
        out.append(best.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))))  # one row: the count
    return quality.union_all(out).drop("rule_order")


def compile_context(spark: SparkSession, pages: DataFrame, edges: DataFrame, gaps: DataFrame, purposes: list[str], as_of: str, most_chars: int = 8000) -> DataFrame:
    """purpose, text: the context pack of each purpose, from one gathering of the seven sections (``context_lines``).

    A section is its heading and its lines, cut to the budget that the purpose gives it; one without rows or budget is left out. Sections
    follow one another while the whole fits ``most_chars``; the first that does not is cut with a mark if over 100 characters are left, and
    nothing follows it. A purpose that is not known has the budgets of ``general``.
    """
    lines = context_lines(pages, edges, gaps, as_of).checkpoint()
    budgets = model.budgets_table(spark)
    known = [r[0] for r in budgets.select("purpose").distinct().collect()]  # the registry
    wanted = spark.createDataFrame([(p, p if p in known else "general") for p in purposes], "purpose string, of string")
    of = wanted.join(budgets.withColumnRenamed("purpose", "of"), "of").filter("budget > 0").drop("of")
    text = lines.groupBy("section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("text"), F.max("total").alias("total"))  # bounded by the largest budget
    heading = F.element_at(F.create_map(*[F.lit(x) for kv in PACK_HEADINGS.items() for x in kv]), F.col("section"))
    part = F.concat(F.replace(heading, F.lit("%d"), F.col("total").cast("string")), F.lit("\n"), F.left("text", F.col("budget")), F.lit("\n"))
    parts = of.join(text, "section").groupBy("purpose").agg(F.array_sort(F.collect_list(F.struct("pos", part.alias("part")))).alias("parts"))  # seven of each purpose

    def put(s, p):
        fits = F.length(s["pack"]) + F.length(p["part"]) <= most_chars
        left = F.lit(most_chars - 25) - F.length(s["pack"])
        cut = F.when(left > 100, F.concat(s["pack"], F.substring(p["part"], F.lit(1), left), F.lit("\n...(truncated)\n"))).otherwise(s["pack"])
        return F.when(s["full"], s).when(fits, F.struct(F.concat(s["pack"], p["part"]).alias("pack"), F.lit(False).alias("full"))).otherwise(F.struct(cut.alias("pack"), F.lit(True).alias("full")))

    head = F.concat(F.lit("# Query Pack ("), F.col("purpose"), F.lit(")\n\n_Auto-generated compressed context. Do not edit._\n\n"))
    found = wanted.select("purpose").join(parts, "purpose", "left")
    none = F.array().cast("array<struct<pos:int,part:string>>")
    return found.select("purpose", F.aggregate(F.coalesce("parts", none), F.struct(head.alias("pack"), F.lit(False).alias("full")), put, lambda s: s["pack"]).alias("text"))


def collection_listing(spark: SparkSession, tree: DataFrame, wanted: str, collection_items: DataFrame, items: DataFrame, deleted: DataFrame, recursive: bool = True) -> DataFrame:
    """Items of the collection whose path ends with ``wanted`` ('a/b'), with those below it; none or several is an error.

    ``items``: itemID and whatever is to be listed, with key and doi; adds no_key and no_doi.
    """
    names = [p.strip() for p in wanted.replace(">", "/").replace("::", "/").split("/") if p.strip()]
    found = graph.path_suffix(graph.root_paths(spark, tree), names)
    hits = [r["id"] for r in found.select("id").limit(2).collect()]
    if len(hits) != 1:
        raise LookupError(f"{len(hits)} collections match {wanted!r}")
    roots = spark.createDataFrame([(hits[0],)], tree.select("id").schema)
    ids = roots.union(graph.descendants(spark, tree, roots).select("id")) if recursive else roots
    places = joins.members(collection_items, items, deleted, ids.withColumnRenamed("id", "collectionID"))
    return places.join(items, "itemID").withColumns({"no_key": F.coalesce(F.col("key"), F.lit("")) == "", "no_doi": F.coalesce(F.col("doi"), F.lit("")) == ""}).orderBy("place").drop("place")


def match_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """lid, rid, how, score: by DOI (several: ambiguous, and no further), by citation key if only one has it, by title.

    Both sides: id column (lid, rid), doi, ck, title (normalized), year.
    """
    levels = [("doi", F.col("doi"), F.col("doi"), True), ("citationKey", F.lower("ck"), F.lower("ck"), False)]
    first = joins.cascade(pages, items, "lid", "rid", levels)
    open_ = first.filter("level = 'unresolved'").join(pages, "lid").select(*pages.columns)
    fuzzy = joins.fuzzy_title_match(open_, items).select("lid", F.col("rid").alias("_t"), F.col("score").alias("_s"))
    out = first.join(fuzzy, "lid", "left")
    how = F.when(F.col("level") == "ambiguous", "ambiguous-doi").when(F.col("rid").isNotNull(), F.col("level")).when(F.col("_t").isNotNull(), "title").otherwise("unresolved")
    score = F.when(how == "doi", 1.0).when(how == "citationKey", 0.98).when(how == "title", F.col("_s")).otherwise(0.0)
    return out.select("lid", F.coalesce("rid", "_t").alias("rid"), how.alias("how"), score.alias("score"))


def lint(spark: SparkSession, pages: DataFrame, fields: dict[str, list[str]], edges: DataFrame, citations: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All checks over pages and graph as findings, in a fixed order. ``pages``: kind, slug, path, body, present; the path
    filter goes below the page checks."""
    p = pages.filter(predicates.under_paths(F.col("path"), only)) if only else pages
    nodes = pages.select(F.concat_ws("/", "kind", "slug").alias("node"))
    line = F.concat(F.lit("edges:"), F.col("_ord"))
    parts = [
        quality.missing_fields(p.select("kind", F.col("path").alias("file"), "present"), model.required_fields_table(spark)).drop("field"),
        joins.broken_links(p.withColumnRenamed("path", "page"), pages).select(*quality.finding("yellow", "broken-link", F.col("page"), F.col("target"))),
        quality.edge_findings(edges, model.edge_types_table(spark), nodes).select("level", "category", line.alias("file"), F.lit("").alias("message"), F.lit(False).alias("fixable")),
        quality.citation_findings(citations).select(F.lit("yellow").alias("level"), "category", F.concat(F.lit("citations:"), F.col("_ord")).alias("file"), F.lit("").alias("message"), F.lit(False).alias("fixable")),
    ]
    return quality.union_all(parts).orderBy("rule_order", "file", "category", "message")


#: Pairs of kinds whose links are expected in both directions.
BOTH_WAYS = [("papers", "concepts"), ("papers", "topics"), ("papers", "people"), ("claims", "papers"), ("ideas", "experiments")]


def lint_all(spark: SparkSession, pages: DataFrame, edges: DataFrame, citations: DataFrame, conflicts: DataFrame | None = None, only: list[str] | None = None) -> DataFrame:
    """All thirteen checks and the sync conflicts as findings, in the checks' order. ``pages``: kind, slug, path, body, header
    (JSON); ``conflicts``: path. The path filter takes findings of pages; those of the graph stay."""
    head = lambda k: F.get_json_object("header", f"$.{k}")
    of = lambda kind: pages.filter(F.col("kind") == kind)
    listed = lambda k, t="array<string>": F.from_json(head(k), t)
    own = pages.withColumnRenamed("path", "page")
    links = joins.wiki_links(own)
    cells = pages.select(F.col("path").alias("file"), "kind", F.explode(F.from_json("header", "map<string,string>")).alias("field", "value"))
    kinds = pages.select("slug", "path", "kind")
    pairs = spark.createDataFrame(BOTH_WAYS, "kind string, to_kind string")
    there = links.join(kinds.select(F.col("path").alias("page"), "kind", F.col("slug").alias("own")), "page").join(kinds.select(F.col("slug").alias("target"), F.col("kind").alias("to_kind")), "target")
    refs = there.join(F.broadcast(pairs), ["kind", "to_kind"], "left_semi").select(F.col("own").alias("page"), "target", F.col("page").alias("path"))  # five rows
    one_way = joins.asymmetric_refs(refs.select("page", "target"), pages.select("slug", "body")).join(refs, ["page", "target"])
    nodes = pages.select(F.concat_ws("/", "kind", "slug").alias("node"))
    line = F.concat(F.lit("edges:"), F.col("_ord"))
    papers = of("papers").select(F.col("path").alias("file"), listed("research_modes").alias("research_modes"), F.coalesce(head("bibtex"), F.lit("")).alias("bibtex"))
    claims = of("claims").select(F.col("path").alias("file"), listed("source_papers").alias("source_papers"), listed("evidence", "array<struct<source:string,source_anchor:string>>").alias("evidence"), head("confidence").alias("confidence"))
    ideas = of("ideas").select(F.col("path").alias("file"), head("status").alias("status"), head("failure_reason").alias("failure_reason"))
    clash = pages.limit(0).select("path") if conflicts is None else conflicts
    of_pages = [
        clash.select(*quality.finding("red", "sync-conflict", F.col("path"), F.lit("copy left by a sync conflict"))),
        quality.missing_fields(pages.select("kind", F.col("path").alias("file"), F.json_object_keys("header").alias("present")), model.required_fields_table(spark)).drop("field"),
        quality.paper_classification(papers, model.RESEARCH_MODES, model.BIBTEX_FIELDS),
        quality.source_excerpts(of("concepts").select(F.col("path").alias("file"), "body")),
        quality.provenance_shape(claims),
        joins.broken_links(own, pages).select(*quality.finding("yellow", "broken-link", F.col("page"), F.col("target"))),
        quality.orphan_pages(pages, links),
        quality.bad_values(cells, model.valid_values_table(spark)).unionByName(quality.confidence_range(claims)),
        quality.failed_without_reason(ideas),
        reports.claim_links(of("experiments").select(F.col("path").alias("file"), F.coalesce(head("target_claim"), F.lit("")).alias("target_claim")), of("claims").select("slug")),
        one_way.select(*quality.finding("yellow", "xref-asymmetry", F.col("path"), F.col("target"), True)),
    ]
    of_graph = [
        quality.edge_findings(edges, model.edge_types_table(spark), nodes).select("level", "category", line.alias("file"), F.lit("").alias("message"), F.lit(False).alias("fixable")),
        quality.citation_findings(citations).select(F.lit("yellow").alias("level"), "category", F.concat(F.lit("citations:"), F.col("_ord")).alias("file"), F.lit("").alias("message"), F.lit(False).alias("fixable")),
    ]
    last = quality.content_quality(pages)
    kept = [p.filter(predicates.under_paths(F.col("file"), only)) if only else p for p in [*of_pages, last]]
    return quality.union_all([*kept[:-1], *of_graph, kept[-1]]).orderBy("rule_order", "file", "category", "message")


def shared_source_counts(papers: DataFrame, concepts: DataFrame, claims: DataFrame) -> DataFrame:
    """slug, concepts, claims: concepts that share a source with a paper, claims that name it (source_papers or evidence)."""
    shared = joins.overlap_counts(papers, concepts, "slug", "concept", "sources", "concept_sources").withColumnRenamed("n", "concepts")
    named = F.array_distinct(F.concat(F.coalesce("source_papers", F.array().cast("array<string>")), F.coalesce(F.transform("evidence", lambda e: e["source"]), F.array().cast("array<string>"))))
    mentions = claims.select("claim", F.explode(named).alias("slug")).groupBy("slug").agg(F.count(F.lit(1)).alias("claims"))
    return papers.select("slug").join(shared, "slug", "left").join(mentions, "slug", "left").fillna(0, ["concepts", "claims"])


def sources_of(pages: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """page, source: explicit links, else the source of the same name if its title agrees."""
    explicit = pages.join(links, "page").select("page", "source")
    rest = pages.join(explicit.select("page").distinct(), "page", "left_anti").join(sources.withColumnRenamed("source", "slug"), "slug")
    same = rest.filter(X.casefold_key("title") == X.casefold_key("source_title")).select("page", F.col("slug").alias("source"))
    return explicit.unionByName(same)


def refresh_status(old: Column, new: Column, dry_run: bool) -> Column:
    """failed (nothing new), unchanged, would_update or updated."""
    return F.when(new.isNull(), "failed").when(old == new, "unchanged").otherwise("would_update" if dry_run else "updated")


def bibtex(kind: Column, key: Column, fields: dict[str, Column], unconfirmed: Column) -> Column:
    """A BibTeX entry of the non-empty fields, with a note where it is not confirmed."""
    lines = F.array_compact(F.array(*[F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"  {k} = {{"), F.trim(v), F.lit("}"))) for k, v in fields.items()]))
    note = F.when(unconfirmed, F.array(F.lit("  note = {UNCONFIRMED}"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("@"), kind, F.lit("{"), key, F.lit(",\n"), F.array_join(F.concat(lines, note), ",\n"), F.lit("\n}"))


def dedup_citations(citations: DataFrame) -> DataFrame:
    return windows.keep_first(citations, ["from_id", "to_id"])


def weekly_name(name: Column) -> Column:
    """'yyyy-MM-wN' of an old weekly log's name, weeks 1 to 5; null if it is none."""
    found = F.regexp_extract(name, r"(\d{4})-?(\d{2})-?[wW]([1-5])\b", 0)
    parts = [F.regexp_extract(name, r"(\d{4})-?(\d{2})-?[wW]([1-5])\b", i) for i in (1, 2, 3)]
    return F.when(found != "", F.concat(parts[0], F.lit("-"), parts[1], F.lit("-w"), parts[2]))
