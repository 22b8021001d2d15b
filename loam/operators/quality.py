"""Data-quality rules. Each rule turns rows into findings: level, category, file, message, fixable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model
from ..functions import markdown
from ..functions import text as X
from . import predicates, windows


def finding(level: str, category: str, file: Column, message: Column, fixable: Column | bool = False) -> list[Column]:
    fix = fixable if isinstance(fixable, Column) else F.lit(fixable)
    return [F.lit(level).alias("level"), F.lit(category).alias("category"), file.alias("file"), message.alias("message"), fix.alias("fixable")]


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Findings of all rules, in the rules' order."""
    return reduce(DataFrame.unionByName, [p.withColumn("rule_order", F.lit(i)) for i, p in enumerate(parts)])


def missing_fields(pages: DataFrame, required: DataFrame) -> DataFrame:
    """Required fields that a page has no key for. ``pages``: kind, file, present (names of its fields)."""
    need = required.groupBy("kind").agg(F.collect_list("field").alias("need"), F.collect_list(F.when(F.col("default").isNotNull(), F.col("field"))).alias("fix"))
    gone = pages.join(F.broadcast(need), "kind").select("file", "fix", F.explode(F.array_except("need", "present")).alias("field"))  # one row a kind
    return gone.select(*finding("red", "missing-field", F.col("file"), F.concat(F.lit("Missing required field: "), F.col("field")), F.array_contains("fix", F.col("field"))), "field")


def bad_values(cells: DataFrame, valid: DataFrame) -> DataFrame:
    """Cells outside their field's set of values. ``cells``: file, kind, field, value; an empty cell is no finding."""
    sets = valid.groupBy("kind", "field").agg(F.collect_set("value").alias("allowed"))
    bad = cells.join(F.broadcast(sets), ["kind", "field"]).filter(F.col("value").isNotNull() & (F.col("value") != "") & ~F.array_contains("allowed", F.col("value")))
    return bad.select(*finding("yellow", "invalid-value", F.col("file"), F.concat_ws("", F.col("field"), F.lit("="), F.col("value"))))


def confidence_range(claims: DataFrame, value: str = "confidence") -> DataFrame:
    """Confidences that are no number of [0, 1]."""
    n = F.col(value).cast("string").try_cast("double")
    return claims.filter(F.col(value).isNotNull() & (n.isNull() | F.isnan(n) | ~n.between(0, 1))).select(*finding("red", "invalid-confidence", F.col("file"), F.concat(F.lit("confidence="), F.col(value).cast("string"))))


def paper_classification(papers: DataFrame, modes: list[str], bibtex_fields: list[str]) -> DataFrame:
    """Research modes that are not known, modes without detail tags, BibTeX fields beyond the core ones."""
    bad_modes = papers.select("file", F.explode(F.array_except(F.coalesce("research_modes", F.array().cast("array<string>")), F.array(*map(F.lit, modes)))).alias("x"))
    found = F.transform(F.regexp_extract_all("bibtex", F.lit(r"(?m)^\s*(\w+)\s*="), F.lit(1)), F.lower)
    extra = papers.select("file", F.explode(F.array_except(found, F.array(*map(F.lit, bibtex_fields)))).alias("x"))
    return bad_modes.select(*finding("yellow", "invalid-mode", F.col("file"), F.col("x"))).unionByName(extra.select(*finding("yellow", "bibtex-field", F.col("file"), F.col("x"))))


def paper_checks(papers: DataFrame) -> DataFrame:
    """Findings about a paper's entry and classification. ``papers``: file, header (JSON), body.

    The BibTeX entry belongs in its section and nowhere else, with core fields only; research_modes is a list of known modes and not empty,
    research_object_tags a list and not empty, and each mode needs its own list of detail tags; the body has a section of classification.
    A header whose modes are no list gets that finding and no more of the classification.
    """
    raw = lambda k: F.get_json_object("header", f"$.{k}")
    none = F.array().cast("array<string>")
    listed = lambda k: F.coalesce(F.from_json(F.when(raw(k).startswith("["), raw(k)), "array<string>"), none)
    p = papers.withColumns({"modes": listed("research_modes"), "entry": F.regexp_extract("body", r"(?ms)^## BibTeX\s*\n+```bibtex\n.*?\n```", 0)})
    extra = F.array_sort(F.array_except(F.array_distinct(F.transform(F.regexp_extract_all("entry", F.lit(r"(?m)^\s*([A-Za-z][A-Za-z0-9_-]*)\s*="), F.lit(1)), F.lower)), F.array(*map(F.lit, model.BIBTEX_FIELDS))))
    unknown = F.array_except("modes", F.array(*map(F.lit, model.RESEARCH_MODES)))
    no_list = raw("research_modes").isNotNull() & ~raw("research_modes").startswith("[")
    said = lambda level, category, when, message: F.when(when, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"), (F.lit(message) if isinstance(message, str) else message).alias("message")))
    rows = [
        said("red", "paper-bibtex", F.array_contains(F.json_object_keys("header"), "bibtex"), "bibtex in the header"),
        said("yellow", "paper-bibtex", F.col("entry") == "", "no ## BibTeX section with an entry"),
        said("yellow", "paper-bibtex", (F.col("entry") != "") & (F.size(extra) > 0), F.concat(F.lit("fields beyond the core: "), F.array_join(extra, ", "))),
        said("red", "paper-classification", no_list, "research_modes is no list"),
        said("red", "paper-classification", ~no_list & (F.size(unknown) > 0), F.concat(F.lit("unknown modes: "), F.array_join(unknown, ", "))),
        said("red", "paper-classification", ~no_list & (F.size("modes") == 0), "research_modes is empty"),
        said("red", "paper-classification", ~no_list & (F.size(listed("research_object_tags")) == 0), "research_object_tags is no list or empty"),
        *[said("red", "paper-classification", ~no_list & F.array_contains("modes", m) & (F.size(listed(f)) == 0), f"{f} is no list or empty") for m, f in model.DETAIL_FIELDS.items()],
        said("red", "paper-classification", ~no_list & ~F.col("body").contains("## Research classification"), "no ## Research classification"),
    ]
    each = p.select("file", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r.isNotNull(), F.lit(False)), r) for r in rows]))).alias("x"))
    return each.select("x.level", "x.category", "file", "x.message", F.lit(False).alias("fixable"))


def source_excerpts(concepts: DataFrame) -> DataFrame:
    """Concept pages whose excerpt section is missing, links no source or quotes nothing."""
    s = X.section("body", "Source excerpts", ignore_case=True)
    why = F.when(F.trim(s) == "", "no section").when(~s.rlike(r"\]\([^)]*\.md|\[\[sources/"), "no source link").when(~s.rlike(r"(?m)^\s*>"), "no quote")
    return concepts.withColumn("why", why).filter("why is not null").select(*finding("yellow", "source-excerpts", F.col("file"), F.col("why")))


def provenance_shape(claims: DataFrame) -> DataFrame:
    """Link syntax inside provenance fields. ``claims``: file, source_papers, evidence (source, source_anchor)."""
    papers = claims.filter(predicates.has_marker(F.col("source_papers"))).select(*finding("yellow", "provenance", F.col("file"), F.lit("source_papers")))
    each = claims.select("file", F.posexplode("evidence").alias("i", "e"))
    marks = each.filter(predicates.has_marker(F.col("e.source")) | predicates.has_marker(F.col("e.source_anchor")))
    return papers.unionByName(marks.select(*finding("yellow", "provenance", F.col("file"), F.format_string("evidence[%d]", F.col("i") + 1))))


def anchor_of(heading: Column) -> Column:
    """Anchor of a heading: lower case, letters, digits, '-' and '_' of any script, blanks as '-'."""
    plain = F.regexp_replace(F.lower(F.trim(heading)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.trim(plain), r"\s+", "-")


def anchor_index(sources: DataFrame) -> DataFrame:
    """source, pos, heading, base, anchor, same: the headings of each source outside fenced code. ``base`` is the plain anchor, ``anchor`` is
    numbered where earlier headings have the same (-1, -2, ...), ``same`` how many headings have it. ``sources``: source, text."""
    bare = F.regexp_replace("text", r"(?ms)^[ ]{0,3}(`{3,}|~{3,}).*?(?:^[ ]{0,3}\1[`~]*[ \t]*$|\z)", "")
    heads = F.regexp_extract_all(bare, F.lit(r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*$"), F.lit(1))
    each = sources.select("source", F.posexplode(heads).alias("pos", "heading")).withColumn("base", anchor_of(F.col("heading"))).filter("base <> ''")
    same = Window.partitionBy("source", "base")  # headings of one text
    n = F.row_number().over(same.orderBy("pos")) - 1
    return each.withColumns({"anchor": F.when(n > 0, F.concat_ws("-", "base", n.cast("string"))).otherwise(F.col("base")), "same": F.count(F.lit(1)).over(same)})


def anchors(claims: DataFrame, index: DataFrame) -> DataFrame:
    """Evidence items without an anchor (nor a ``source_anchor:`` mark in their detail), with one that no heading of the source has, or with
    one that several headings have. ``claims``: file, evidence (source, source_anchor, detail); ``index``: ``anchor_index``.

    An anchor is quoted as heading text or as '#anchor'; the latter, and a numbered one, name one heading and are never ambiguous.
    """
    items = claims.select("file", F.posexplode("evidence").alias("i", "e")).select("file", (F.col("i") + 1).alias("i"), "e.source", F.trim(F.coalesce("e.source_anchor", F.lit(""))).alias("said"), F.coalesce("e.detail", F.lit("")).alias("detail"))
    none = items.filter((F.col("said") == "") & ~F.col("detail").rlike(r"(?i)source_anchor\s*:"))
    quoted = items.filter("said <> ''").withColumn("anchor", anchor_of(F.col("said")))
    there = index.select("source", "anchor", F.when(F.col("anchor") == F.col("base"), F.col("same")).otherwise(1).alias("same")).groupBy("source", "anchor").agg(F.max("same").alias("same"))
    met = quoted.join(there, ["source", "anchor"], "left")
    lost = met.filter("same IS NULL")
    many = met.filter((F.col("same") > 1) & ~F.col("said").startswith("#"))
    at = F.format_string("evidence[%d]", F.col("i"))
    said = F.concat(at, F.lit(": "), F.coalesce("source", F.lit("")), F.lit("#"), F.col("said"))
    return (
        none.select(*finding("red", "missing-source-anchor", F.col("file"), at))
        .unionByName(lost.select(*finding("red", "anchor-not-found", F.col("file"), said)))
        .unionByName(many.select(*finding("yellow", "anchor-ambiguous", F.col("file"), F.concat(said, F.lit(" ("), F.col("same").cast("string"), F.lit(" headings)")))))
    )


def failed_without_reason(ideas: DataFrame) -> DataFrame:
    bad = (F.col("status") == "failed") & (F.trim(F.coalesce("failure_reason", F.lit(""))) == "")
    return ideas.filter(bad).select(*finding("red", "failure-reason", F.col("file"), F.lit("failed idea without failure_reason")))


def page_map(pages: DataFrame) -> DataFrame:
    """slug, path: a later kind replaces an earlier one of the same slug."""
    order = F.array_position(F.array(*map(F.lit, model.KINDS)), F.col("kind"))
    return pages.groupBy("slug").agg(F.max_by("path", order).alias("path"))


def edge_findings(edges: DataFrame, types: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All row checks of edges at once: one pass, an array of categories, exploded. ``_ord`` becomes the file's line."""
    e = predicates.endpoint_matches(edges, types)
    sym, c = F.col("is_symmetric"), F.coalesce(F.col("confidence"), F.lit(""))
    known = F.col("known") | F.col("type").isin(model.LEGACY_TYPES)
    checks = [
        ("red", "missing-from", F.col("from_id").isNull()),
        ("red", "missing-to", F.col("to_id").isNull()),
        ("red", "missing-type", F.col("type").isNull()),
        ("yellow", "unknown-edge-type", F.col("type").isNotNull() & ~known),
        ("yellow", "invalid-edge-endpoint", known & ~F.col("endpoint_ok")),
        ("yellow", "self-edge", (F.col("expected_from") == "papers") & (F.col("expected_to") == "papers") & (F.col("from_id") == F.col("to_id"))),
        ("yellow", "missing-symmetric-marker", sym & ~F.coalesce(F.col("symmetric"), F.lit(False))),
        ("yellow", "noncanonical-symmetric-edge", sym & (F.col("from_id") > F.col("to_id"))),
        ("yellow", "missing-edge-confidence", F.col("needs_confidence") & (c == "")),
        ("yellow", "invalid-edge-confidence", F.col("needs_confidence") & (c != "") & ~c.isin(model.CONFIDENCES)),
        ("yellow", "missing-edge-evidence", F.col("needs_confidence") & (F.trim(F.coalesce("evidence", F.lit(""))) == "")),
        ("yellow", "legacy-edge-type", F.col("legacy")),
    ]
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(lv).alias("level"), F.lit(cat).alias("category"))) for lv, cat, cond in checks]))
    out = e.select("_ord", F.explode(found).alias("x")).select("_ord", "x.level", "x.category")
    if nodes is not None:
        for end in ("from_id", "to_id"):
            gone = edges.filter(F.col(end).contains("/")).join(nodes.select(F.col("node").alias(end)), end, "left_anti")
            out = out.unionByName(gone.select("_ord", F.lit("yellow").alias("level"), F.lit(f"dangling-{end[:-3]}").alias("category")))
    return out


def citation_findings(citations: DataFrame) -> DataFrame:
    """Row checks of citations, with later repeats of a (from, to) pair."""
    rows = F.array_compact(F.array(
        F.when(F.coalesce(F.col("type"), F.lit("")) != "cites", F.lit("citation-type")),
        F.when(~F.coalesce(F.col("source").isin(model.CITATION_SOURCES), F.lit(False)), F.lit("citation-source")),
        F.when(X.node_kind("from_id") != "papers", F.lit("citation-from")),
        F.when(X.node_kind("to_id") != "papers", F.lit("citation-to")),
        F.when(F.col("from_id") == F.col("to_id"), F.lit("self-citation")),
        F.when(~F.coalesce(F.col("date"), F.lit("")).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit("citation-date")),
    ))
    again = windows.repeats(citations, ["from_id", "to_id"]).select("_ord", F.lit("duplicate-citation").alias("category"))
    return citations.select("_ord", F.explode(rows).alias("category")).unionByName(again)


def evidence_coverage(required: DataFrame, available: DataFrame) -> DataFrame:
    """page, label, missing: cards required by label and not there. Both tables: page, label, n."""
    both = required.withColumnRenamed("n", "need").join(available.withColumnRenamed("n", "have"), ["page", "label"], "full_outer")
    gap = F.greatest(F.coalesce("need", F.lit(0)) - F.coalesce("have", F.lit(0)), F.lit(0))
    return both.select("page", "label", gap.alias("missing")).filter("missing > 0")


def text_findings(df: DataFrame, key: str, text: str, files: str | None = None) -> DataFrame:
    """Source screening: key, rule, severity, scope, line, column of all findings of all sixteen rules, on text whose code,
    comments, link targets and header are masked. ``files``: column with the image files that exist, if known."""
    there = F.col(files) if files else F.lit(None).cast("array<string>")
    return df.select(key, F.explode(markdown.screen(F.col(text), there)).alias("x")).select(key, "x.*")


def counted_findings(findings: DataFrame, key: str) -> DataFrame:
    """key, rule, severity, scope, n (places)."""
    return findings.groupBy(key, "rule", "severity", "scope").agg(F.count(F.lit(1)).alias("n"))


def ordered_findings(findings: DataFrame, key: str) -> DataFrame:
    """Findings in reading order: by file, line, column, rule."""
    return findings.orderBy(key, "line", "column", "rule")


def scan_status(findings: DataFrame, key: str, all_keys: DataFrame | None = None) -> DataFrame:
    """key, status, n: blocked by a red finding of the whole document, else to be reviewed; with ``all_keys`` also the
    texts without any finding."""
    doc_red = F.count_if((F.col("severity") == "red") & (F.col("scope") == "document"))
    out = findings.groupBy(key).agg(F.when(doc_red > 0, "blocked").otherwise("review_required").alias("status"), F.count(F.lit(1)).alias("n"))
    if all_keys is None:
        return out
    return all_keys.select(key).distinct().join(out, key, "left").select(key, F.coalesce("status", F.lit("no_findings")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


def repeated_paragraphs(df: DataFrame, key: str, text: str, least: int = 180) -> DataFrame:
    """key, place, first_place, paragraph hash: long plain paragraphs of a document that occurred in it before."""
    paras = df.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("place", "raw"))
    norm = paras.select(key, "place", F.array_join(X.words("raw"), " ").alias("p"))
    long = norm.filter((F.length("p") >= least) & ~F.col("p").rlike(r"[$|<#]")).select(key, "place", F.sha2("p", 256).alias("h"))
    first = long.groupBy(key, "h").agg(F.min("place").alias("first_place"))
    return long.join(first, [key, "h"]).filter("place > first_place")


def migration_findings(papers: DataFrame, sources: DataFrame, texts: DataFrame, most: int | None = 200) -> DataFrame:
    """file, issue: what a migration of slugs has left behind; a report of at most ``most`` rows by file and issue (None: all).

    A paper's slug and a source's sourceSlug that are not the file's stem; the first asset folder in a source that is another's; in every text that
    is no source, the first ``papers/x`` that is no paper, and every link to a prepared source that is not there. ``papers``: path, slug; ``sources``:
    path, slug, text; ``texts``: path, text of all content, sources too.
    """
    stem = lambda c: F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.md$", "")
    said = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", "<missing>").otherwise(F.trim(c))
    wrong = lambda df, name: df.filter(F.trim(F.coalesce("slug", F.lit(""))) != stem("path")).select(F.col("path").alias("file"), F.concat(F.lit(f"{name} mismatch: "), said(F.col("slug")), F.lit(" != "), stem("path")).alias("issue"))
    assets = F.filter(F.regexp_extract_all("text", F.lit(r"assets/([^)/]+)/"), F.lit(1)), lambda x: x != stem("path"))
    foreign = sources.select("path", F.get(assets, F.lit(0)).alias("a")).filter("a is not null").select(F.col("path").alias("file"), F.concat(F.lit("asset stem mismatch: assets/"), "a", F.lit("/")).alias("issue"))
    own = texts.filter(~F.col("path").startswith("sources/"))
    ends = F.regexp_extract_all("text", F.lit(r"(?<!sources/)\bpapers/([A-Za-z0-9_.+-]+?)(?=[\s\"',)\]}]|\.md\b|$)"), F.lit(1))
    points = own.select("path", F.posexplode(ends).alias("at", "s"))
    lost = points.join(papers.select(stem("path").alias("s")), "s", "left_anti").groupBy("path").agg(F.min_by("s", "at").alias("s"))
    lost = lost.select(F.col("path").alias("file"), F.concat(F.lit("broken paper endpoint: papers/"), "s").alias("issue"))
    links = F.regexp_extract_all("text", F.lit(r"(?:\.\./|\./)?sources/papers/[^\s)]+\.md|@(?:configured|wiki)-sources-papers/[^\s)]+\.md"), F.lit(0))
    each = texts.select("path", F.explode(links).alias("link")).withColumn("s", stem("link"))
    gone = each.join(sources.select(stem("path").alias("s")), "s", "left_anti").select(F.col("path").alias("file"), F.concat(F.lit("broken prepared-source link: "), "link").alias("issue"))
    out = wrong(papers, "slug").unionByName(wrong(sources, "sourceSlug")).unionByName(foreign).unionByName(lost).unionByName(gone)
    return out if most is None else out.orderBy("file", "issue").limit(most)


def target_collisions(plan: DataFrame, pages: DataFrame) -> DataFrame:
    """Renames whose target exists and is not itself renamed. ``plan``: slug, target."""
    moving = plan.select(F.col("slug").alias("target"))
    return plan.filter("slug <> target").join(pages.select(F.col("slug").alias("target")), "target", "left_semi").join(moving.filter("target is not null"), "target", "left_anti")


def bibtex_core(df: DataFrame, bibtex: str) -> DataFrame:
    """``lacking``: core fields that a BibTeX entry does not have."""
    lacking = F.array_compact(F.array(*[F.when(X.bibtex_field(bibtex, f) == "", F.lit(f)) for f in ("author", "title", "year")]))
    return df.withColumn("lacking", lacking)


def valid_receipts(jobs: DataFrame, receipts: DataFrame) -> DataFrame:
    """Jobs whose receipt has the same input, output and engine hashes."""
    return jobs.join(receipts, ["id", "pdf_sha256", "output_sha256", "engine"], "left_semi")


def content_quality(pages: DataFrame) -> DataFrame:
    """Suggestions: papers of importance 5 that no concept page names, stable concepts with one key paper at most, topics
    with an empty section of open problems. ``pages``: kind, slug, path, body, header (JSON)."""
    said = pages.filter("kind = 'concepts'").select(F.concat_ws("\n", "header", "body").alias("text"))
    head = lambda k: F.get_json_object("header", f"$.{k}")
    top = pages.filter((F.col("kind") == "papers") & (head("importance") == "5"))
    named = said.select(F.explode(F.split("text", r"[^A-Za-z0-9_.+-]+")).alias("slug")).select(F.regexp_replace("slug", r"\.(md)?$", "").alias("slug")).distinct()
    papers = top.join(named, "slug", "left_anti").select(*finding("blue", "quality", F.col("path"), F.lit("importance=5 but no concept page references this paper")))
    few = F.coalesce(F.size(F.from_json(head("key_papers"), "array<string>")), F.lit(0)) <= 1
    stable = pages.filter((F.col("kind") == "concepts") & (head("maturity") == "stable") & few)
    concepts = stable.select(*finding("blue", "quality", F.col("path"), F.lit("maturity=stable but only 1 key_paper")))
    open_ = F.trim(F.regexp_replace(X.section("body", "Open problems"), r"\s+", " "))
    topics = pages.filter((F.col("kind") == "topics") & F.col("body").contains("## Open problems") & open_.isin("", "—"))
    return papers.unionByName(concepts).unionByName(topics.select(*finding("blue", "quality", F.col("path"), F.lit("no open problems"))))


def orphan_pages(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages that no other page links to. ``links``: page (a path), target (a slug)."""
    named = links.join(pages.select(F.col("path").alias("page"), F.col("slug").alias("_own")), "page").filter("target <> _own").select(F.col("target").alias("slug")).distinct()
    return pages.join(named, "slug", "left_anti").select(*finding("yellow", "orphan-page", F.col("path"), F.lit("no incoming links")))
