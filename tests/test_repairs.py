"""Pushed filters, edits of pages, renames, commits of two tables, snapshots and path resolution."""

import itertools
import json
import os
import random
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam import model
from loam.operators import commits, edits, graph
from loam.sources import snapshots, works

# --- recorded works --------------------------------------------------------------------------------------------------


@pytest.fixture
def store(spark, tmp_path):
    at = str(tmp_path / "works")
    one = {"results": [{"id": "W1", "doi": "https://doi.org/10.1/A", "display_name": "A <i>b</i> &lt;\n c", "publication_year": 2020, "cited_by_count": 3, "abstract_inverted_index": {"x": [1], "y": [0, 2], "z": "no"}, "authorships": [{"author": {"display_name": "Ann"}}, {"raw_author_name": "Bob"}, {}]}, {"display_name": "old", "publication_year": 1990}]}
    two = {"message": {"items": [{"DOI": "10.2/b", "title": ["T"], "published-print": {"date-parts": [[None]]}, "issued": {"date-parts": [[2021, 5]]}, "author": [{"given": "G", "family": "F"}, {"name": "Org"}]}, {"title": ["no year"]}]}}
    rows = [("openalex", json.dumps(one)), ("crossref", json.dumps(two)), ("other", "{}"), ("openalex", "broken"), ("crossref", None), ("openalex", '{"results": null}')]
    works.record(spark.createDataFrame(rows, "provider string, json string"), at)
    return at


def test_recorded_works(spark, store):
    got = {r.id: r for r in works.works(spark, store).collect()}
    assert set(got) == {"W1", "old", "10.2/b", "no year"}
    a, b = got["W1"], got["10.2/b"]
    assert (a.title, a.doi, a.abstract, a.authors, a.year, a.citations, a.url) == ("A b < c", "10.1/A", "y x y", ["Ann", "Bob"], 2020, 3, "https://doi.org/10.1/A")
    assert (b.title, b.authors, b.year, b.type, b.provider) == ("T", ["G F", "Org"], 2021, "work", "crossref")
    assert got["no year"].year is None


def test_filters_reach_the_store(spark, store, capsys):
    df = works.works(spark, store, ["year", "id"]).filter("year >= 2000 AND id <> 'x'")
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(year,2000)" in plan and "ReadSchema: struct<year:int,id:string>" in plan
    assert sorted(r.id for r in df.collect()) == ["10.2/b", "W1"]
    for where, want in (("year IS NULL", ["no year"]), ("year IN (1990, 2021)", ["10.2/b", "old"]), ("year = 1800", []), ("provider = 'crossref' AND year < 2030", ["10.2/b"]), ("year <=> 1990", ["old"]), ("year <> 1990", ["10.2/b", "W1"])):
        assert sorted(r.id for r in works.works(spark, store, ["id", "year", "provider"]).filter(where).collect()) == want, where


def test_dropped_works_are_never_parsed(spark, store):
    at = f"{store}/provider=openalex/year=1950"
    os.makedirs(at)
    with open(f"{at}/part-x.txt", "w") as f:
        f.write("this is no JSON\n")
    assert works.works(spark, store, ["id", "year"]).filter("year > 1950").count() == 3
    with pytest.raises(Exception, match="JSON"):
        works.works(spark, store, ["id", "year"]).filter("year < 1960").collect()


def test_files_are_split_at_line_ends(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "many")
    rows = [("openalex", json.dumps({"results": [{"id": f"W{i}", "publication_year": 2000, "display_name": "é" * (i % 7)}]})) for i in range(200)]
    works.record(spark.createDataFrame(rows, "provider string, json string"), at, files=1)
    monkeypatch.setattr(works, "SPLIT_BYTES", 100)
    reader = works.RecordedReader(at, ["id"])
    pieces = reader.partitions()
    assert len(pieces) > 50
    assert sorted(x for p in pieces for b in reader.read(p) for x in b.column(0).to_pylist()) == sorted(f"W{i}" for i in range(200))


# --- edits -----------------------------------------------------------------------------------------------------------


def plain_edits(text, todo):
    """Fields and then lines, one by one, each line where its section's content begins, new sections at the end."""
    import re

    for place, name, value in sorted(todo):
        m = re.match(edits.HEADER.replace("(?s)\\A", "(?s)^"), text)
        if place == "field" and m and not re.search(rf"(?m)^{re.escape(name)}[ \t]*:", m[1]):
            text = f"---\n{m[1].rstrip(' ')}\n{name}: {value}\n---{text[m.end():]}"
    lines = [(n, v) for p, n, v in sorted(todo) if p == "section"]
    for known in (True, False):
        for name, value in lines:
            m = re.search(rf"(?m)^{re.escape(name)}[ \t]*$\n*", text)
            if value in text or bool(m) != known:
                continue
            at = m.end()
            text = text[:at] + ("" if text[:at].endswith("\n") else "\n") + value + "\n" + text[at:]
        if known:
            missing = sorted({n for n, v in lines if v not in text})
            for name in missing:
                own = sorted((v for n, v in lines if n == name and v not in text), reverse=True)
                if not re.search(rf"(?m)^{re.escape(name)}[ \t]*$", text):
                    text = text.rstrip(" \t\n\r\x0b\x0c") + f"\n\n{name}\n\n" + "".join(v + "\n" for v in own)
    return text


def test_edits_against_plain_python_in_any_order(spark):
    texts = [
        "---\ntitle: a\n---\n# T\n\n## Related\n\n- [[old]]\n\n## End\nx", "no header\n## Related", "## Related  \n\n\n## Key papers\n- [[k]]", "", "---\ntags: x\nimportance : 2\n---\nbody \n\n",
        "---\n---\n## Related work\n", "## Related\n## Related\n",
    ]
    some = [("section", "## Related", "- [[a]]"), ("section", "## Related", "- [[b]]"), ("section", "## Key papers", "- [[k]]"), ("section", "## Key papers", "- [[c]]"), ("section", "## New", "- [[n]]"), ("field", "importance", "3"), ("field", "tags", "[]"), ("section", "## Related", "- [[old]]")]
    pages = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)] + [("null", None)], "path string, text string")
    rng, said = random.Random(1), None
    for _ in range(2):
        rows = [(f"p{i}", *e) for i in range(len(texts)) for e in some] * 2 + [("null", *some[0]), ("gone", *some[0])]
        rng.shuffle(rows)
        todo = spark.createDataFrame(rows, edits.SCHEMA)
        out = {r.path: r for r in edits.apply_edits(pages, todo).collect()}
        got = {k: r.text for k, r in out.items()}
        assert said is None or got == said
        said = got
    assert said == {f"p{i}": plain_edits(t, some) for i, t in enumerate(texts)} | {"null": None}
    assert out["p0"].changed and not out["null"].changed
    again = edits.apply_edits(spark.createDataFrame([(k, t) for k, t in said.items()], "path string, text string"), todo).collect()
    assert {r.path: r.text for r in again} == said and not any(r.changed or r.edits for r in again if r.text is not None)
    dry = {r.path: r for r in edits.apply_edits(pages, todo, dry_run=True).collect()}
    assert {k: r.text for k, r in dry.items()} == {f"p{i}": t for i, t in enumerate(texts)} | {"null": None}
    assert {k: r.edits for k, r in dry.items()} == {k: r.edits for k, r in out.items()}


def test_one_way_references_of_all_rules(spark):
    rows = [
        ("concepts", "c", '{"key_papers":["p","[[q|Q]]","gone"]}', ""), ("papers", "p", None, "see [[ann]] and [[bob|B]]"), ("papers", "q", None, "knows [[c|the concept]]"),
        ("people", "ann", None, "[[p]]"), ("people", "bob", None, "x"), ("claims", "k", '{"source_papers":["p"]}', "tested in e1"), ("ideas", "i", '{"origin_gaps":"k"}', ""),
        ("experiments", "e1", '{"target_claim":"claims/k.md"}', ""), ("experiments", "e2", '{"target_claim":"k"}', ""),
    ]
    pages = spark.createDataFrame([(k, s, f"{k}/{s}.md", h, t) for k, s, h, t in rows], "kind string, slug string, path string, header string, text string")
    got = {(r.slug, r.to_path, r.section, r.line) for r in edits.one_way_refs(pages).collect()}
    assert got == {
        ("c", "papers/p.md", "## Related", "- [[c]]"), ("p", "people/bob.md", "## Key papers", "- [[p]]"), ("k", "papers/p.md", "## Related", "- [[k]]"),
        ("i", "claims/k.md", "## Linked ideas", "- [[i]]"), ("e2", "claims/k.md", "## Evidence summary", "- Tested by: [[e2]]"),
    }


def test_append_meta_and_sections(spark):
    df = spark.createDataFrame([({"tags": '["a"]', "x": "1"}, "## S\n- a\n")], "h map<string,string>, t string")
    row = df.select(edits.append_meta(F.col("h"), "tags", F.lit("b")).alias("h"), edits.append_to_section(F.col("t"), "## S", F.array(F.lit("- b"), F.lit("- a"))).alias("t"), edits.append_meta(F.col("h"), "new", F.lit("v")).alias("n")).first()
    assert row.h == {"tags": '["a","b"]', "x": "1"} and row.t == "## S\n- b\n- a\n" and row.n["new"] == '["v"]'
    with pytest.raises(Exception, match="no list"):
        df.select(edits.append_meta(F.col("h"), "x", F.lit("b"))).collect()


def test_transitions(spark):
    pages = spark.createDataFrame([("ideas", "a", {"status": "tested"}), ("ideas", "b", {"status": "tested"}), ("ideas", "c", {"status": "proposed"}), ("experiments", "e", {"status": "running", "x": "y"})], "kind string, slug string, header map<string,string>")
    moves = spark.createDataFrame([("ideas", "a", "failed", " why "), ("ideas", "b", "failed", " "), ("ideas", "c", "tested", None), ("experiments", "e", "completed", None), ("ideas", "zz", "tested", None)], "kind string, slug string, status string, reason string")
    after, report = edits.transition(pages, moves, "2026-01-02")
    assert {r.slug: r.outcome for r in report.collect()} == {"a": "moved", "b": "no reason", "c": "not allowed", "e": "moved", "zz": "no page"}
    got = {r.slug: r.header for r in after.collect()}
    assert got == {"a": {"status": "failed", "date_resolved": "2026-01-02", "failure_reason": "why"}, "b": {"status": "tested"}, "c": {"status": "proposed"}, "e": {"status": "completed", "date_completed": "2026-01-02", "x": "y"}}


# --- literal replacement ---------------------------------------------------------------------------------------------


def plain_replace(text, pairs):
    """Longest first: every place of a longer text that is still free, from the left."""
    free = [True] * len(text)
    put = {}
    for old, new in sorted(pairs, key=lambda p: -len(p[0])):
        at = 0
        while (at := text.find(old, at)) >= 0:
            if all(free[at : at + len(old)]):
                free[at : at + len(old)] = [False] * len(old)
                put[at] = (len(old), new)
            at += 1
    # of one length the leftmost wins, whichever pair it is
    out, at = "", 0
    for start in sorted(put):
        out += text[at:start] + put[start][1]
        at = start + put[start][0]
    return out + text[at:]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=30), st.dictionaries(st.text("abc", min_size=1, max_size=5), st.text("abcX", max_size=3), max_size=5))
def test_overlapping_pairs(text, pairs):
    lengths = [len(x) for x in pairs]
    if len(set(lengths)) == len(lengths):  # texts of one length are settled by place and not by order
        assert edits.Literals(list(pairs.items())).replace(text) == plain_replace(text, list(pairs.items()))
    got = edits.Literals(list(pairs.items())).replace(text)
    assert isinstance(got, str) and (got == text or any(p in text for p in pairs))


@pytest.mark.parametrize("most", [100, 2])
def test_replacement_in_texts_and_header_values(spark, most):
    pairs = [("a/one.md", "a/1.md"), ("one", "ONE"), ("a/one.md.x", "L"), ("1", "no"), ("", "bad"), ("two", "a/one.md")]
    header = {"one": ["one", {"one": [["two one"], 7, True, None]}], "n": 1.0}
    df = spark.createDataFrame([(1, "a/one.md.x a/one.md two 1", json.dumps(header)), (2, None, None), (3, "", '{"k":  "kept as it is"}')], "id long, t string, h string")
    got = {r.id: r for r in edits.replace_literals(df, spark.createDataFrame(pairs, "old string, new string"), ["t"], ["h"], most_pairs=most).collect()}
    assert got[1].t == "L a/1.md a/one.md no"
    assert json.loads(got[1].h) == {"one": ["ONE", {"one": [["a/one.md ONE"], 7, True, None]}], "n": 1.0}
    assert (got[2].t, got[2].h, got[3].t, got[3].h) == (None, None, "", '{"k":  "kept as it is"}')
    with pytest.raises(ValueError):
        edits.replace_literals(df, spark.createDataFrame([("a", "b"), ("a", "c")], "old string, new string"), ["t"])


def test_rename_collisions(spark):
    pages = spark.createDataFrame([(f"sources/papers/{s}.md", "{}", "") for s in "abc"], "path string, header string, body string")
    pairs = lambda *r: spark.createDataFrame([(a, b, None) for a, b in r], "old_stem string, new_stem string, citation_key string")
    with pytest.raises(ValueError, match="papers/c.md"):
        edits.rename_sources(pages, pairs(("a", "c")))
    with pytest.raises(ValueError, match="papers/z.md"):
        edits.rename_sources(pages, pairs(("a", "z"), ("b", "z")))
    got = {r.path: r.header for r in edits.rename_sources(pages, pairs(("a", "b"), ("b", "a"), ("c", "c"))).collect()}
    assert got == {"sources/papers/b.md": '{"sourceSlug": "b"}', "sources/papers/a.md": '{"sourceSlug": "a"}', "sources/papers/c.md": "{}"}


# --- commits ---------------------------------------------------------------------------------------------------------

GRAPH = "from_id string, to_id string, type string, evidence string, date string, _ord long"


def graph_store(spark, at, extra=()):
    s = commits.Store(spark, str(at))
    edges = [("papers/a", "papers/x", "supports", "e", "1", 0), ("papers/b", "papers/x", "supports", "e", "2", 1), ("papers/y", "papers/a", "similar_method_to", "s", "3", 2), ("papers/q", "papers/r", "supports", "u", "4", 3), ("papers/q", "papers/r", "supports", "u", "4", 4), *extra]
    s.commit({"edges": spark.createDataFrame(edges, GRAPH), "citations": spark.createDataFrame([("papers/a", "papers/q", "cites", "", "5", 0)], GRAPH)}, -1)
    return s, spark.createDataFrame([(f"papers/{c}",) for c in "bxyqr"], "node string"), spark.createDataFrame([("papers/a", "papers/b")], "old string, new string")


def rows(df):
    return sorted(tuple(r) for r in df.select("from_id", "to_id", "type", "evidence", "date").collect())


def symmetric():
    return F.col("type").isin(model.SYMMETRIC_TYPES)


def test_remap_of_two_tables(spark, tmp_path):
    s, pages, mapping = graph_store(spark, tmp_path / "s")
    v, counts = commits.remap_graph(s, mapping, model.KINDS, pages, symmetric())
    assert (v, s.version()) == (1, 1)
    assert rows(s.read("edges")) == [("papers/b", "papers/x", "supports", "e", "2"), ("papers/b", "papers/y", "similar_method_to", "s", "3"), *[("papers/q", "papers/r", "supports", "u", "4")] * 2]
    assert rows(s.read("citations")) == [("papers/b", "papers/q", "cites", "", "5")]
    assert {(r.table, r.remapped, r.deduplicated) for r in counts.collect()} == {("edges", 2, 1), ("citations", 1, 0)}
    assert rows(s.read("citations", 0)) == [("papers/a", "papers/q", "cites", "", "5")]
    assert s.vacuum() == 2 and len(rows(s.read("edges"))) == 4


def test_a_collision_changes_neither_table(spark, tmp_path):
    s, pages, mapping = graph_store(spark, tmp_path / "s", [("papers/b", "papers/y", "similar_method_to", "other", "9", 5)])
    before = {t: rows(s.read(t)) for t in ("edges", "citations")}
    with pytest.raises(ValueError, match="differ"):
        commits.remap_graph(s, mapping, model.KINDS, pages, symmetric())
    assert s.version() == 0 and {t: rows(s.read(t)) for t in before} == before


def test_a_crash_between_the_writes_changes_neither_table(spark, tmp_path, monkeypatch):
    s, pages, mapping = graph_store(spark, tmp_path / "s")
    before = {t: rows(s.read(t)) for t in ("edges", "citations")}
    write, calls = type(pages.write).parquet, []

    def failing(self, path, *a, **k):
        calls.append(path)
        if "/citations/" in path:
            raise OSError("the disk is gone")
        return write(self, path, *a, **k)

    monkeypatch.setattr(type(pages.write), "parquet", failing)
    with pytest.raises(OSError):
        commits.remap_graph(s, mapping, model.KINDS, pages, symmetric())
    monkeypatch.undo()
    assert any("/edges/" in c for c in calls)
    assert s.version() == 0 and {t: rows(s.read(t)) for t in before} == before
    assert commits.remap_graph(s, mapping, model.KINDS, pages, symmetric())[0] == 1


def test_a_commit_in_between_stops_the_other(spark, tmp_path, monkeypatch):
    s, *_ = graph_store(spark, tmp_path / "s")
    one = spark.range(1)
    with pytest.raises(commits.Changed):
        s.commit({"edges": one}, -1)
    version = commits.Store.version
    monkeypatch.setattr(commits.Store, "version", lambda self: 0)  # both have looked before either has written
    assert s.commit({"edges": one}, 0) == 1
    with pytest.raises(commits.Changed):
        s.commit({"edges": spark.range(2)}, 0)
    monkeypatch.setattr(commits.Store, "version", version)
    assert s.read("edges").count() == 1


def test_unsound_mappings(spark, tmp_path):
    s, pages, _ = graph_store(spark, tmp_path / "s")
    for pairs in ([("papers/a", "topics/b")], [("papers/a", "papers/a")], [("papers/a", "papers/b"), ("papers/c", "papers/a")], [("papers/a", "papers/nope")], [("a", "b")], [("papers/a", "papers/b"), ("papers/a", "papers/x")], []):
        with pytest.raises(ValueError):
            commits.remap_graph(s, spark.createDataFrame(pairs, "old string, new string"), model.KINDS, pages, symmetric())
    assert s.version() == 0


# --- snapshots -------------------------------------------------------------------------------------------------------


def test_snapshot_follows_its_files(spark, tmp_path):
    library, cache = tmp_path / "library", tmp_path / "cache"
    library.mkdir()
    at = library / "zotero.sqlite"
    con = sqlite3.connect(at)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("create table items(itemID integer, key text)")
    con.execute("insert into items values (1, 'A')")
    con.commit()
    queries = {"items": ("SELECT itemID, key FROM items", "itemID long, key string")}
    first = snapshots.prepare(spark, str(at), str(cache), queries)
    assert first.notes[0].startswith("created") and [tuple(r) for r in first.read("items").collect()] == [(1, "A")]
    files = lambda: {str(p): p.stat().st_mtime_ns for p in cache.rglob("*") if p.is_file()}
    there = files()
    again = snapshots.prepare(spark, str(at), str(cache), queries)
    assert again.notes[0].startswith("reused") and files() == there and again.folder == first.folder
    database = at.stat()
    con.execute("insert into items values (2, 'B')")  # goes to the log alone
    con.commit()
    assert (at.stat().st_size, at.stat().st_mtime_ns) == (database.st_size, database.st_mtime_ns)
    third = snapshots.prepare(spark, str(at), str(cache), queries)
    assert third.notes[0].startswith("created") and third.read("items").count() == 2 and third.folder != first.folder
    more = snapshots.prepare(spark, str(at), str(cache), queries | {"keys": ("SELECT key FROM items", "key string")})
    assert more.notes[0].startswith("created") and more.read("keys").count() == 2
    next(cache.rglob("snapshot.json")).write_text("{")
    assert snapshots.prepare(spark, str(at), str(cache), queries).notes[0].startswith("unreadable")
    con.close()


def test_a_failed_snapshot_keeps_the_last(spark, tmp_path):
    at = tmp_path / "x.sqlite"
    with sqlite3.connect(at) as con:
        con.execute("create table t(a integer)")
    good = {"t": ("SELECT a FROM t", "a long")}
    s = snapshots.prepare(spark, str(at), str(tmp_path / "c"), good)
    with pytest.raises(Exception, match="nowhere"):
        snapshots.prepare(spark, str(at), str(tmp_path / "c"), {"t": ("SELECT a FROM nowhere", "a long")})
    assert s.read("t").count() == 0 and snapshots.prepare(spark, str(at), str(tmp_path / "c"), good).notes[0].startswith("reused")
    assert not list((tmp_path / "c").rglob("copy-*"))


# --- paths -----------------------------------------------------------------------------------------------------------


def plain_resolve(tree, path, key):
    import re

    if key:
        if not re.fullmatch("[A-Za-z0-9]{8}", key):
            return None, "invalid", None, None
        hit = [r[0] for r in tree if r[3] == key.upper()]
        return (hit[0], "found", None, None) if hit else (None, "missing", key, None)
    if path is None:
        return None, "top", None, None
    if not path.strip():
        return None, "invalid", None, None
    at = None
    for s in [p.strip() for p in path.split("/") if p.strip()]:
        hit = [r[0] for r in tree if r[1] == at and r[2] == s]
        if len(hit) != 1:
            return None, "conflict" if hit else "missing", s, len(hit) or None
        at = hit[0]
    return (at, "found", None, None) if at is not None else (None, "top", None, None)


def test_paths_against_plain_python(spark):
    rng = random.Random(2)
    tree = [(0, None, "A", "AAAAAAA0")]
    for i in range(1, 60):
        tree.append((i, rng.choice([None, *range(i)]) if rng.random() < 0.8 else max(0, i - 1), rng.choice("ABCD"), f"KEY{i:05d}"))
    paths = ["/".join(x) for n in range(1, 5) for x in itertools.product("AB", repeat=n)] + ["C/D/A/B/C/D/A", " / ", "", "  ", None, "Z", "A/Z/A", " A / B /"]
    asked = [(i, p, None) for i, p in enumerate(paths)] + [(900, "A", "key00007"), (901, None, "nokey"), (902, None, "KEY99999"), (903, None, "")]
    got = graph.resolve_paths(spark.createDataFrame(tree, "id long, parent long, name string, key string"), spark.createDataFrame(asked, "rid long, path string, key string"), levels=2).collect()
    assert {r.rid: (r.id, r.status, r.segment, r.matches) for r in got} == {i: plain_resolve(tree, p, k) for i, p, k in asked} and len(got) == len(asked)


def test_cycles_cost_no_paths(spark):
    n = 20_000
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") < 16, F.when(F.col("id") > 0, F.col("id") - 1)).otherwise(F.when(F.col("id") == 16, n - 1).otherwise(F.col("id") - 1)).alias("parent"), F.lit("x").alias("name"))
    got = graph.tree_order(spark, rows).groupBy("cyclic").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("place")).alias("longest")).collect()
    assert {(r.cyclic, r.n, r.longest) for r in got} == {(False, 16, 16), (True, n - 16, 1)}
    assert graph.root_paths(spark, rows).count() == 16
