"""Whole commands on small fixtures."""

import pytest
from pyspark.sql import functions as F

from loam import model
from loam.plans import compose


def candidates(spark, rows):
    names = [c.split(" ")[0] for c in model.CANDIDATE_SCHEMA.split(", ")]
    base = {"citations": 0, "influential": 0, "max_h_index": 0, "influential_edge": False, **{k: [] for k in ("authors", "fields", "sources", "anchors", "providers", "queries")}}
    return spark.createDataFrame([tuple((base | r | {"_ord": i}).get(n.strip()) for n in names) for i, r in enumerate(rows)], model.CANDIDATE_SCHEMA)


def test_shortlist_anchor(spark):
    rows = [
        {"title": "Old", "year": 1980, "citations": 5, "sources": ["a", "b"]},
        {"title": "Known", "year": 2020, "sources": ["a", "b"]},
        {"title": "Weak", "year": 2024, "sources": ["a"], "anchors": ["x"]},
        {"title": "Good", "year": 2024, "citations": 900, "sources": ["a", "b"], "anchors": ["x"]},
        {"title": "good ", "year": None, "citations": 10, "sources": ["c"], "anchors": ["y"], "influential_edge": True},
        {"title": "Fine", "year": 2010, "sources": ["literature_reference"], "anchors": ["x"]},
    ]
    known = spark.createDataFrame([("title:known",)], "key string")
    lib = spark.createDataFrame([("", "FINE!")], "doi string, title string")
    got = compose.shortlist(candidates(spark, rows), known, 2024, limit=5, library=lib).collect()
    assert [(r.title, r.status, r.total) for r in got] == [("Good", "not collected", 2), ("Fine", "collected", 2)]
    assert got[0].sources == ["a", "b", "c"] and got[0].influential_edge
    assert "influential edge" in got[0].rationale


def test_shortlist_topic(spark):
    rows = [{"title": "Graph learning methods", "year": 2024}, {"title": "Graph theory", "abstract": "learning of graphs", "year": None}, {"title": "Cooking", "year": 2024}]
    none = spark.createDataFrame([], "key string")
    got = compose.shortlist(candidates(spark, rows), none, 2024, "topic", ["graph learning"], ["graph|tree"], since=2000).collect()
    assert [r.title for r in got] == ["Graph learning methods"]


def test_context_pack_and_stale(spark):
    lines = spark.createDataFrame([("claims", i, "x" * 999) for i in range(4)] + [("edges", 0, "e")], "section string, _ord long, line string")
    got = {r.section: r.text for r in compose.context_pack(spark, lines, "ideation").collect()}
    assert len(got["claims"]) == 1500 and got["edges"] == "e"
    df = spark.createDataFrame([("2024-01-01",), ("2024-03-01",), ("x",), (None,)], "d string")
    assert compose.stale(df, "d", "2024-03-10").count() == 1
    assert compose.stale(df.withColumn("d", F.col("d").try_cast("date")), "d", "2024-03-10", typed_dates=False).count() == 0


def test_collection_listing(spark):
    tree = spark.createDataFrame([(1, None, "Top"), (2, 1, "A"), (3, 2, "B"), (4, 1, "C"), (5, 4, "B")], "id int, parent int, name string")
    ci = spark.createDataFrame([(2, 10, 0), (3, 11, 1), (3, 12, 0), (4, 13, 0), (2, 11, 5)], "collectionID int, itemID int, orderIndex int")
    items = spark.createDataFrame([(10, "k", ""), (11, "", "d"), (12, "k", "d"), (13, "k", "d")], "itemID int, key string, doi string")
    deleted = spark.createDataFrame([(12,)], "itemID int")
    got = compose.collection_listing(spark, tree, "Top > A", ci, items, deleted).collect()
    assert [(r.itemID, r.no_key, r.no_doi) for r in got] == [(10, False, True), (11, True, False)]
    with pytest.raises(LookupError):
        compose.collection_listing(spark, tree, "B", ci, items, deleted)


def test_match_pages(spark):
    cols = "id long, doi string, ck string, title string, year string"
    pages = spark.createDataFrame([(1, "d1", "", "a", "1"), (2, "d2", "k", "b", "1"), (3, "", "k3", "deep graph nets", "2000"), (4, "", "", "deep graph nets", "2001"), (5, "", "", "", "")], cols).withColumnRenamed("id", "lid")
    items = spark.createDataFrame([(10, "d1", "", "x", ""), (11, "d2", "k", "y", ""), (12, "d2", "", "z", ""), (13, "", "K3", "q", ""), (14, "", "", "deep graph nets", "2001")], cols).withColumnRenamed("id", "rid")
    got = {r.lid: (r.rid, r.how) for r in compose.match_pages(pages, items).collect()}
    assert got == {1: (10, "doi"), 2: (None, "ambiguous-doi"), 3: (13, "citationKey"), 4: (14, "title"), 5: (None, "unresolved")}


def test_open_questions_and_lint(spark):
    pages = spark.createDataFrame(
        [("topics", "t", "topics/t.md", "## Open problems\n- p1\n- p2\n## X\n- no [[papers/gone]] [[#here]]", ["title", "tags"], 0), ("claims", "c", "claims/c.md", "", ["title"], 1)],
        "kind string, slug string, path string, body string, present array<string>, _ord long",
    )
    claims = spark.createDataFrame([("c", 0.2, "supported", "weak one", 5), ("d", None, "supported", "ok", 6)], "slug string, confidence double, status string, title string, _ord long")
    assert [r.line for r in compose.open_questions(pages, claims, {"topics": "Open problems"}).collect()] == ["p1", "p2", "weak claim: weak one"]
    e = spark.createDataFrame([("papers/a", "papers/a", "builds_on", "e", "2024-01-01", "high", None, 0)], model.EDGE_SCHEMA + ", _ord long")
    c = spark.createDataFrame([("papers/a", "papers/b", "cites", "manual", "x", 0)], model.CITATION_SCHEMA + ", _ord long")
    got = [(r.category, r.message) for r in compose.lint(spark, pages, {}, e, c).collect()]
    assert ("broken-link", "gone") in got and ("self-edge", "") in got and ("citation-date", "") in got and ("dangling-from", "") in got
    assert sum(k == "missing-field" for k, _ in got) == len(model.REQUIRED_FIELDS["claims"]) - 1
    only = compose.lint(spark, pages, {}, e.limit(0), c.limit(0), ["topics/"]).collect()
    assert {r.category for r in only} == {"broken-link"}


def test_all_checks_of_lint(spark):
    """One page or line that breaks each of the checks; the path filter takes findings of pages only."""
    import json

    full = {"papers": {"title": "T", "slug": "p", "paper_type": "paper", "tags": [], "research_modes": ["theory"], "research_object_tags": [], "importance": "3"}, "concepts": {"title": "T", "tags": [], "maturity": "active", "key_papers": ["p", "q"]}}
    rows = [
        ("papers", "p", full["papers"] | {"importance": 5, "research_modes": ["magic"], "bibtex": "@article{k,\n  abstract = {x}\n}"}, "see [[concepts/c]] and [[gone]] [[#here]]"),
        ("papers", "q", full["papers"], "[[p]]"), ("concepts", "c", full["concepts"] | {"maturity": "stable", "key_papers": ["q"]}, "## Source excerpts\ntext"),
        ("claims", "m", {"title": "T", "status": "odd", "confidence": 2, "source_papers": ["[[p]]"], "evidence": []}, ""), ("ideas", "i", {"title": "T", "status": "failed"}, ""),
        ("experiments", "x", {"title": "T", "target_claim": "claims/none"}, ""), ("topics", "t", {"title": "T", "tags": []}, "## Open problems\n\n## Next\nx"),
    ]
    pages = spark.createDataFrame([(k, s, f"{k}/{s}.md", b, json.dumps(h)) for k, s, h, b in rows], "kind string, slug string, path string, body string, header string")
    e = spark.createDataFrame([("papers/p", "papers/p", "builds_on", "e", "2024-01-01", "high", None, 0)], model.EDGE_SCHEMA + ", _ord long")
    c = spark.createDataFrame([("papers/p", "papers/q", "cites", "manual", "x", 0)], model.CITATION_SCHEMA + ", _ord long")
    copies = spark.createDataFrame([("papers/p nsconflict.md",)], "path string")
    got = compose.lint_all(spark, pages, e, c, copies).collect()
    by = {}
    for r in got:
        by.setdefault(r.category, set()).add((r.file, r.message))
    assert [r.rule_order for r in got] == sorted(r.rule_order for r in got) and {r.rule_order for r in got} == set(range(14))
    assert by["invalid-mode"] == {("papers/p.md", "magic")} and by["bibtex-field"] == {("papers/p.md", "abstract")} and by["broken-link"] == {("papers/p.md", "gone")}
    assert by["source-excerpts"] == {("concepts/c.md", "no source link")} and by["provenance"] == {("claims/m.md", "source_papers")} and by["failure-reason"] == {("ideas/i.md", "failed idea without failure_reason")}
    assert by["broken-claim-ref"] == {("experiments/x.md", "target_claim=none")} and by["xref-asymmetry"] == {("papers/p.md", "c")} and by["invalid-confidence"] == {("claims/m.md", "confidence=2")}
    assert by["invalid-value"] == {("claims/m.md", "status=odd")} and {f for f, _ in by["orphan-page"]} == {"papers/q.md", "claims/m.md", "ideas/i.md", "experiments/x.md", "topics/t.md"}
    assert {f for f, _ in by["quality"]} == {"papers/p.md", "concepts/c.md", "topics/t.md"} and "self-edge" in by and "citation-date" in by and "sync-conflict" in by
    assert {f for f, _ in by["missing-field"]} == {"claims/m.md", "ideas/i.md", "experiments/x.md"}
    some = compose.lint_all(spark, pages, e.limit(0), c.limit(0), None, ["topics/"]).collect()
    assert {(r.category, r.file) for r in some} == {("orphan-page", "topics/t.md"), ("quality", "topics/t.md")}


def test_small_pieces(spark):
    df = spark.createDataFrame([("2024-05-W2.md",), ("20240503",), ("log",)], "n string")
    assert [r.x for r in df.select(compose.weekly_name(F.col("n")).alias("x")).collect()] == ["2024-05-w2", None, None]
    b = spark.range(1).select(compose.bibtex(F.lit("article"), F.lit("k"), {"title": F.lit("T"), "year": F.lit("")}, F.lit(True)).alias("b")).first().b
    assert b == "@article{k,\n  title = {T},\n  note = {UNCONFIRMED}\n}"


def test_context_pack_of_nothing_and_cut(spark):
    pages = spark.createDataFrame([("claims", f"c{i}", f"claims/c{i}.md", {"title": "x" * 50}) for i in range(30)], "kind string, slug string, path string, header map<string,string>")
    edges = spark.createDataFrame([("claims/c7", "claims/c9", "supports", 0), ("claims/c7", "papers/p", "supports", 1)], "from_id string, to_id string, type string, _ord long")
    gaps = spark.createDataFrame([], "_ord long, line string")
    got = {r.purpose: r.text for r in compose.compile_context(spark, pages, edges, gaps, ["ideation", "nope"], "2024-01-01", 700).collect()}
    lines = got["ideation"].split("\n")
    assert lines[4] == "## Claims (30 total)" and len(got["ideation"]) <= 700 and got["ideation"].endswith("\n...(truncated)\n")
    assert got["nope"].startswith("# Query Pack (nope)")
    whole = compose.compile_context(spark, pages, edges, gaps, ["ideation"], "2024-01-01").first().text
    assert "## Recent Relationships (2 total)\n  claims/c7 --supports--> claims/c9\n  claims/c7 --supports--> papers/p\n" in whole and "Gaps" not in whole
    empty = compose.compile_context(spark, pages.limit(0), edges.limit(0), gaps, ["ideation"], "2024-01-01").first().text
    assert empty == "# Query Pack (ideation)\n\n_Auto-generated compressed context. Do not edit._\n\n"
