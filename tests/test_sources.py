"""Sources, sinks on files, text state machines and streaming helpers."""

import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import headers, markdown
from loam.operators import sinks
from loam.sources import tables, vault


def test_vault_pages(spark, tmp_path):
    papers = tmp_path / "papers"
    papers.mkdir()
    (papers / "b.md").write_text("---\ntitle: B\ntags: [x, y]\ndate: 2026-01-02\n---\nbody [[a]]", encoding="utf-8")
    (papers / "a.md").write_text("no header", encoding="utf-8")
    (papers / "a-NSConflict-1.md").write_text("x", encoding="utf-8")
    (papers / "bad.md").write_bytes(b"\xff\xfe\xff")
    df = vault.pages(spark, {"papers": str(papers)})
    got = {r.slug: r for r in vault.fields(df, ["title", "date"]).collect()}
    assert set(got) == {"a", "b"}
    assert (got["b"].title, got["b"].date, got["a"].title) == ("B", "2026-01-02", None)
    assert got["a"]._ord < got["b"]._ord
    assert vault.unreadable(spark, [str(papers)]).count() == 1
    assert vault.conflict_copies(vault.files(spark, [str(papers)])).count() == 1
    with pytest.raises(ValueError):
        vault.node_path("papers/../x", {"papers": "p"})


def test_json_lines_keep_bad_lines(spark, tmp_path):
    f = tmp_path / "edges.jsonl"
    f.write_text('{"from":"a/1","to":"a/2","type":"supports","evidence":"u v"}\n\nnot json\n{"from":"a/3"}\n', encoding="utf-8")
    rows = tables.edges(spark, str(f)).orderBy("_ord").collect()
    assert [(r.from_id, r._corrupt) for r in rows] == [("a/1", None), (None, "not json"), ("a/3", None)]
    assert rows[0].evidence == "u v"


def test_sqlite_source(spark, tmp_path):
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as con:
        con.execute("create table items(itemID integer, key text)")
        con.executemany("insert into items values (?, ?)", [(1, "A"), (2, "B")])
    df = tables.sqlite(spark, str(db), "SELECT itemID, key FROM items", "itemID long, key string")
    assert sorted(map(tuple, df.collect())) == [(1, "A"), (2, "B")]


def test_swap_keeps_the_old_table_readable(spark, tmp_path):
    at = str(tmp_path / "t")
    spark.range(3).write.parquet(at)
    sinks.swap(spark.read.parquet(at).filter("id > 0"), at)
    assert spark.read.parquet(at).count() == 2


def test_legacy_log(spark):
    df = spark.createDataFrame([(1, "intro\n## [2024-01-02] ingest | first\nmore\n## [2024-02-03] ask | second")], "doc long, text string")
    got = [(r.date, r.skill, r.text) for r in tables.legacy_log(df).orderBy("record").collect()]
    assert got == [("2024-01-02", "ingest", "first\nmore"), ("2024-02-03", "ask", "second")]


def test_ocr_blocks(spark):
    rows = [(1, 0, "text", "Intro", 1, 0), (1, 1, "image", "fig", None, 0), (1, 2, "text", "Next", 1, 2), (1, 3, "image", "fig2", None, 2)]
    s, f, p = tables.ocr_sections(spark.createDataFrame(rows, "doc long, pos int, type string, text string, text_level int, page_idx int"))
    assert [(r.heading, r.page) for r in s.orderBy("pos").collect()] == [("Intro", 1), ("Next", 3)]
    assert sorted((r.section, r.caption) for r in f.collect()) == [(0, "fig"), (2, "fig2")]
    assert p.first().pages == 3


def test_append_log_twice(spark, tmp_path):
    at = str(tmp_path / "log")
    m = spark.createDataFrame([("2024-05-09 10:00:00", "ask | q"), ("2024-05-01 10:00:00", "plain")], "ts string, message string").withColumn("ts", F.to_timestamp("ts"))
    sinks.append_log(m, at)
    sinks.append_log(m, at)
    got = spark.read.json(at)
    assert got.count() == 4
    assert {(r.period, r.skill) for r in got.collect()} == {("2024-05-w2", "ask"), ("2024-05-w1", "general")}


def test_header_reader():
    h, body, mode = headers.read('---\ntitle: "A: b"\nn: 3\nf: 0.5\nok: yes\ntags: [a, "b, c"]\nevidence:\n  - source: x\n    strength: strong\nsetup:\n  model: m\n---\nrest')
    assert body == "rest"
    assert h["title"] == "A: b" and h["n"] == 3 and h["tags"] == ["a", "b, c"]
    assert h["evidence"] == [{"source": "x", "strength": "strong"}] and h["setup"] == {"model": "m"}
    assert mode in ("yaml", "fallback")
    assert headers.subset("a: no\nb: -2\nc: -1.5\nd:\n  - x\n  - 2") == {"a": False, "b": -2, "c": -1.5, "d": ["x", 2]}
    assert headers.read(None) == ({}, "", "none")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab$\\{}_^`\n ()[]~-#|", max_size=60))
def test_masks_keep_offsets_and_repairs_settle(text):
    assert len(markdown.mask_noncontent(text)) == len(text)
    once, _ = markdown.repair_math(text)
    assert isinstance(once, str)


HEADER = """title: "A: b" # c
n: 3
f: 0.5
ok: yes
tags: [a, "b, c", 2, [x]]
evidence:
  - source: x
    strength: strong   # note
    more:
      - 1
      - deep: no
  - source: y
  -
setup:
  model: m
  nested:
    a: 1
flat:
- p
- q: r
# comment
note: |
  two
   lines

  end
fold: >-
  a
  b
url: http://x.y/z#a
tight:value
   stray: 1
- lost
empty:
last: no"""


def test_both_header_readers_on_one_header():
    assert headers.subset(HEADER) == {
        "title": "A: b", "n": 3, "f": 0.5, "ok": True, "tags": ["a", "b, c", 2, ["x"]], "evidence": [{"source": "x", "strength": "strong", "more": [1, {"deep": False}]}, {"source": "y"}, ""],
        "setup": {"model": "m", "nested": {"a": 1}}, "flat": ["p", {"q": "r"}], "note": "two\n lines\n\nend", "fold": "a b", "url": "http://x.y/z#a", "tight": "value", "empty": "", "last": False,
    }
    lint = headers.lint_fields(HEADER)
    assert lint["title"] == '"A: b" # c' and lint["n"] == "3" and lint["ok"] == "yes" and lint["empty"] == []
    assert lint["evidence"] == ["source: x", "1", "deep: no", "source: y"] and lint["setup"] == [] and lint["flat"] == ["p", "q: r"]
    assert headers.read(f"---\n{HEADER}\nbad: [open\n---\nx")[2] == "fallback" and headers.read(f"---\n{HEADER}\nbad: [open\n---\nx", lint=True)[2] == "lint"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab:-# \n[]\"'|>\t1.", max_size=80))
def test_header_readers_never_fail(block):
    assert isinstance(headers.subset(block), dict) and isinstance(headers.lint_fields(block), dict)
    deep = headers.subset("\n".join(" " * i + f"k{i}:" for i in range(500)))
    assert list(deep) == ["k0"]


def test_scan_of_overlapping_paths(spark, tmp_path):
    top = tmp_path / "top"
    (top / "in" / "deep").mkdir(parents=True)
    (top / "inner").mkdir()
    (top / "a.md").write_text("---\nx: 1\n---\nbody é ", encoding="utf-8")
    (top / "in" / "b.MD").write_text("# Abstract\nfine ??", encoding="utf-8")
    (top / "in" / "deep" / "bad.md").write_bytes(b"# x\n\xff\xfe")
    (top / "inner" / "c.md").write_text("# Abstract\nx", encoding="utf-8")
    (top / "in" / "b-NSConflict-1.md").write_text("x", encoding="utf-8")
    (top / "in" / "d.txt").write_text("x", encoding="utf-8")
    at = lambda *p: str(top.joinpath(*p))
    assert vault.disjoint([at("in", "deep"), at("in"), at("inner") + "/", at("in"), at("a.md")]) == [at("a.md"), at("in"), at("inner")]
    scanned = vault.scan_paths(spark, [at("in", "deep"), at("in"), at("a.md"), at("inner"), at("in", "b.MD"), at("a.md")])
    got = {r.path.rsplit("/", 1)[1]: r for r in scanned.collect()}
    assert {k: (r.status, r.body_characters) for k, r in got.items()} == {"a.md": ("read", 6), "b.MD": ("read", 18), "bad.md": ("blocked", None), "c.md": ("read", 12)}
    findings = vault.scan_findings(scanned)
    assert {(r.path.rsplit("/", 1)[1], r.rule) for r in findings.collect() if r.severity == "red"} == {("b.MD", "missing-character"), ("bad.md", "invalid-utf8")}
    assert tuple(vault.scan_summary(scanned, findings).first()) == (4, 3, 2, 1)
    for bad in (at("nowhere"), at("in", "d.txt"), str(tmp_path / "empty")):
        (tmp_path / "empty").mkdir(exist_ok=True)
        with pytest.raises(ValueError):
            vault.scan_paths(spark, [at("in"), bad])


def test_entries_merge_alike_in_any_order(spark):
    rows = [
        ("a", "pdf", "pdf", "x", "p0", ["w"], 0), ("a", "md", "md", "long abstract", "p1", None, 1), ("a", "pdf", "tex", "", "p2", ["v", "w"], 2), ("a", "tex", "tex", None, "p3", [], 3), ("a", "tex", "tex", None, "p4", ["z"], 4),
        ("b", "pdf", "pdf", "x", "p5", [], 5), ("c", "x", "directory", "ab", "p6", None, 6), ("c", "archive", "tex", "abc", "p7", None, 7),
    ]
    schema = "id string, original_format string, ingest_format string, abstract string, source_path string, warnings array<string>, _ord long"
    said = "duplicate local source skipped in favor of preferred source: "
    want = {"a": ("p3", sorted(["w", "v", "z", f"{said}p0", f"{said}p2", f"{said}p3"])), "b": ("p5", []), "c": ("p7", [f"{said}p7"])}
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = {r.id: (r.source_path, r.warnings) for r in tables.preferred_entries(spark.createDataFrame(order, schema).repartition(3)).collect()}
        assert got == want
