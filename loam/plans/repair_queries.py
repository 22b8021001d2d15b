"""Sources with pushed filters, repairs, renames, commits and path resolution as queries over whole tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import headers
from ..operators import commits, edits, graph, quality, sinks
from ..session import shared_folder
from ..sources import tables, works
from ..sources.tables import table
from . import compose
from .registry import query


def text(*parts: str | Column) -> Column:
    """Texts and columns joined; a part in plain text is text."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/loam/{label}-{uuid.uuid4().hex}"


@query("""SELECT CASE WHEN page_id % 3 = 0 THEN 'crossref' ELSE 'openalex' END AS provider, (1990 + page_id % 40)::INT AS year, CASE WHEN page_id % 3 = 0 THEN '10.3/' || page_id WHEN page_id % 3 = 1 THEN 'W' || page_id ELSE '10.4/' || page_id END AS id,
  'About ' || page_id || ' & more' AS title, page_id % 100 AS citations FROM pages WHERE 1990 + page_id % 40 >= 2015 AND page_id % 100 > 10""")
def pushed_works(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers of two providers, read with a year filter and five columns that go to the source."""
    p, n = table(spark, d, "pages"), F.col("page_id")
    year = 1990 + n % 40
    one = F.struct(
        F.when(n % 3 == 1, text("W", n)).alias("id"), F.when(n % 3 == 2, text("https://doi.org/10.4/", n)).alias("doi"), text("<b>About</b> ", n, " &amp; more").alias("display_name"),
        year.alias("publication_year"), (n % 100).alias("cited_by_count"), F.col("url").alias("not_read"),
    )
    two = F.struct(text("10.3/", n).alias("DOI"), F.array(text("About ", n, "\n &amp; more")).alias("title"), F.struct(F.array(F.array(year, F.lit(1))).alias("date-parts")).alias("issued"), (n % 100).alias("is-referenced-by-count"))
    page = F.floor(n / 50)
    a = p.filter(n % 3 != 0).groupBy(page.alias("page")).agg(F.to_json(F.struct(F.collect_list(one).alias("results"))).alias("json")).select(F.lit("openalex").alias("provider"), "json")
    b = p.filter(n % 3 == 0).groupBy(page.alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(two).alias("items")).alias("message"))).alias("json")).select(F.lit("crossref").alias("provider"), "json")
    at = scratch(spark, "works")
    works.record(a.unionByName(b), at)
    return works.works(spark, at, ["provider", "year", "id", "title", "citations"]).filter("year >= 2015 AND citations > 10")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN doc_id % 3 = 0 THEN 'concepts' ELSE 'papers' END AS kind FROM documents),
  p AS (SELECT *, doc_id - doc_id % 3 AS c, doc_id % 3 > 0 AND (doc_id - doc_id % 3) IN (SELECT doc_id FROM documents) AND doc_id % 5 > 0 AS lost FROM d),
  n AS (SELECT *, CASE WHEN kind = 'concepts' AND doc_id % 2 = 0 THEN chr(10) || 'maturity: active' WHEN kind = 'papers' AND doc_id % 4 = 1 THEN chr(10) || 'importance: 3' ELSE '' END AS field, CASE WHEN lost THEN '- [[d' || c || ']]' || chr(10) ELSE '' END AS line FROM p),
  r AS (SELECT doc_id, kind, (field <> '')::INT + lost::INT AS edits, '---' || chr(10) || 'title: T' || field || chr(10) || '---' || chr(10) || CASE WHEN doc_id % 7 < 4
      THEN '# T' || chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || line || CASE WHEN kind = 'papers' AND doc_id % 5 = 0 THEN '- [[d' || c || ']]' || chr(10) ELSE '' END || '## End' || chr(10) || t
      ELSE CASE WHEN lost THEN rtrim('# T' || CASE WHEN kind = 'papers' AND doc_id % 5 = 0 THEN ' [[d' || c || ']]' ELSE '' END || chr(10) || t, E' \\t\\n\\x0b\\x0c\\r') || chr(10) || chr(10) || '## Related' || chr(10) || chr(10) || line
        ELSE '# T' || CASE WHEN kind = 'papers' AND doc_id % 5 = 0 THEN ' [[d' || c || ']]' ELSE '' END || chr(10) || t END END AS body FROM n)
  SELECT kind || '/d' || doc_id AS path, edits, edits > 0 AS changed, sha256(body) AS digest, FALSE AS changed_again FROM r""")
def repaired_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages after all repairs that lint asks for: back links under their sections and default fields; and once more, which
    changes nothing."""
    docs, n = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), F.col("doc_id")
    kind, c = F.when(n % 3 == 0, "concepts").otherwise("papers"), n - n % 3
    has = lambda k, f: F.when(k, f).otherwise("")
    knows = (kind == "papers") & (n % 5 == 0)
    body = F.when(n % 7 < 4, text("# T\n\n## Related\n\n", has(knows, text("- [[d", c, "]]\n")), "## End\n", F.col("t"))).otherwise(text("# T", has(knows, text(" [[d", c, "]]")), "\n", F.col("t")))
    papers = F.array(text("d", n + 1), text("d", n + 2))
    pages = docs.select(
        kind.alias("kind"), text("d", n).alias("slug"), text(kind, "/d", n).alias("path"), text("---\ntitle: T\n---\n", body).alias("text"),
        F.to_json(F.when(kind == "concepts", F.struct(papers.alias("key_papers")))).alias("header"), n.alias("doc_id"),
    )
    gone = pages.filter("(kind = 'concepts' AND doc_id % 2 = 0) OR (kind = 'papers' AND doc_id % 4 = 1)").select("path", "kind", F.when(F.col("kind") == "concepts", "maturity").otherwise("importance").alias("field"))
    fields = gone.join(F.broadcast(model.required_fields_table(spark)), ["kind", "field"]).select("path", "field", "default")  # the registry
    todo = edits.repair_edits(edits.one_way_refs(pages), fields)
    once = edits.apply_edits(pages, todo)
    again = edits.apply_edits(once.select("path", "text"), todo, dry_run=True).select("path", F.col("changed").alias("changed_again"))
    return once.select("path", F.col("edits"), "changed", F.sha2("text", 256).alias("digest")).join(again, "path")


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 10 = 3 AS moved FROM documents), l AS (SELECT *, 's' || doc_id AS old, CASE WHEN doc_id % 10 = 3 THEN 'n' || doc_id || '.x' ELSE 's' || doc_id END AS own, doc_id - doc_id % 10 + 3 AS k FROM d),
  n AS (SELECT *, CASE WHEN k IN (SELECT doc_id FROM documents) THEN 'n' || k || '.x' ELSE 's' || k END AS friend FROM l)
  SELECT 'sources/papers/' || own || '.md' AS path, '{"links":["wiki/sources/papers/' || friend || '.md",{"deep":["see assets/' || friend || '/a.png",7]}],"n":1.5' || CASE WHEN moved THEN ',"sourceSlug":"' || own || '"' || CASE WHEN doc_id % 20 = 3 THEN ',"citationKey":"K' || doc_id || '"' ELSE '' END ELSE '' END || '}' AS header,
    sha256(t || chr(10) || '[a](@wiki-sources-papers/' || friend || '.md) sources/papers/' || old || '0.md.md sources/papers/' || friend || '.md') AS digest, k IN (SELECT doc_id FROM documents) AS changed FROM n""")
def renamed_sources(spark: SparkSession, d: str) -> DataFrame:
    """One source in ten gets a new name; links to it follow in whole texts and at any depth of the headers."""
    docs, n = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), F.col("doc_id")
    k = n - n % 10 + 3
    header = text('{"links":["wiki/sources/papers/s', k, '.md",{"deep":["see assets/s', k, '/a.png",7]}],"n":1.5}')
    body = text(F.col("t"), "\n[a](@wiki-sources-papers/s", k, ".md) sources/papers/s", n, "0.md.md sources/papers/s", k, ".md")
    pages = docs.select(text("sources/papers/s", n, ".md").alias("path"), header.alias("header"), body.alias("body"))
    renames = docs.filter(n % 10 == 3).select(text("s", n).alias("old_stem"), text("n", n, ".x").alias("new_stem"), F.when(n % 20 == 3, text("K", n)).alias("citation_key"))
    out = edits.rename_sources(pages, renames)
    return out.select("path", F.regexp_replace("header", r'(?<=[,:]) ', "").alias("header"), F.sha2("body", 256).alias("digest"), "changed")


@query("""WITH n AS (SELECT doc_id, lang, source, 'n' || n_chars AS name, count(*) OVER (PARTITION BY lang, source, n_chars) AS k, doc_id % 7 AS m FROM documents), twice AS (SELECT max(source) AS s FROM documents)
  SELECT doc_id AS rid, CASE WHEN m = 6 THEN 'c' || doc_id WHEN m IN (0, 4, 5) OR source = s OR k > 1 THEN NULL ELSE 'c' || doc_id END AS id,
    CASE WHEN m = 0 THEN 'missing' WHEN m = 4 THEN 'top' WHEN m = 5 THEN 'invalid' WHEN m = 6 THEN 'found' WHEN source = s OR k > 1 THEN 'conflict' ELSE 'found' END AS status,
    CASE WHEN m = 0 THEN 'nowhere' WHEN m IN (4, 5, 6) THEN NULL WHEN source = s THEN source WHEN k > 1 THEN name END AS segment,
    CASE WHEN m IN (0, 4, 5, 6) THEN NULL WHEN source = s THEN 2 WHEN k > 1 THEN k END AS matches FROM n, twice""")
def resolved_parents(spark: SparkSession, d: str) -> DataFrame:
    """Paths lang/source/name over a tree where one source is there twice in every language, so that it is ambiguous before the last level."""
    docs, n = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source"), text("n", F.col("n_chars")).alias("name")), F.col("doc_id")
    last = docs.agg(F.max("source").alias("s"))
    none = F.lit(None).cast("string")
    a = docs.select("lang").distinct().select(text("a", F.col("lang")).alias("id"), none.alias("parent"), F.col("lang").alias("name"), none.alias("key"))
    b = docs.select("lang", "source").distinct().select(text("b", F.col("lang"), "/", F.col("source")).alias("id"), text("a", F.col("lang")).alias("parent"), F.col("source").alias("name"), none.alias("key"))
    more = b.join(F.broadcast(last), F.col("name") == F.col("s")).select(text(F.col("id"), "2").alias("id"), "parent", "name", "key")  # one row
    key = F.lpad(F.upper(F.conv(n.cast("string"), 10, 36)), 8, "0")
    c = docs.select(text("c", n).alias("id"), text("b", F.col("lang"), "/", F.col("source")).alias("parent"), "name", key.alias("key"))
    path = (
        F.when(n % 7 == 0, text(F.col("lang"), "/nowhere/", F.col("name"))).when(n % 7 == 4, F.when(n % 2 == 0, " / /").otherwise(none)).when(n % 7 == 5, F.when(n % 2 == 0, "  ").otherwise("x"))
        .otherwise(text("/", F.col("lang"), " / ", F.col("source"), "/", F.col("name"), "/"))
    )
    asked = docs.select(n.alias("rid"), path.alias("path"), F.when(n % 7 == 6, F.lower(key)).when((n % 7 == 5) & (n % 2 == 1), "not-a-key").alias("key"))
    return graph.resolve_paths(a.unionByName(b).unionByName(more).unionByName(c), asked)


@query("""WITH d AS (SELECT doc_id, coalesce(lang, '?') AS lang FROM documents), m AS (SELECT a.doc_id AS o, a.doc_id - 1 AS n FROM d a JOIN d b ON b.doc_id = a.doc_id - 1 AND a.lang = b.lang WHERE a.doc_id % 2 = 1),
  c AS (SELECT d.doc_id, coalesce(f.n, d.doc_id) AS x, coalesce(t.n, d.doc_id - d.doc_id % 10 + 1) AS y, f.n IS NOT NULL OR t.n IS NOT NULL AS changed FROM d LEFT JOIN m f ON f.o = d.doc_id LEFT JOIN m t ON t.o = d.doc_id - d.doc_id % 10 + 1),
  g AS (SELECT *, bool_or(changed) OVER (PARTITION BY x, y) AS hit, row_number() OVER (PARTITION BY x, y ORDER BY changed, doc_id) AS k FROM c)
  SELECT 'edges' AS "table", 'papers/d' || doc_id AS from_id, 'topics/' || lang AS to_id, doc_id AS ord FROM d WHERE doc_id NOT IN (SELECT o FROM m)
  UNION ALL SELECT 'citations', 'papers/d' || x, 'papers/d' || y, doc_id FROM g WHERE NOT hit OR k = 1""")
def graph_remap(spark: SparkSession, d: str) -> DataFrame:
    """Nodes renamed in two tables under one commit, read back from the store."""
    docs, n = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang")), F.col("doc_id")
    node = lambda x: text("papers/d", x)
    edge = docs.select(node(n).alias("from_id"), text("topics/", F.col("lang")).alias("to_id"), F.lit("supports").alias("type"), F.col("lang").alias("evidence"), text("2024-", n).alias("date"), n.alias("_ord"))
    cite = docs.select(node(n).alias("from_id"), node(n - n % 10 + 1).alias("to_id"), F.lit("cites").alias("type"), text("day ", n).alias("date"), n.alias("_ord"))
    even = docs.select((n + 1).alias("doc_id"), F.col("lang").alias("_l"))
    pairs = docs.filter("doc_id % 2 = 1").join(even, "doc_id").filter("lang = _l").select(node(n).alias("old"), node(n - 1).alias("new"))
    store = commits.Store(spark, scratch(spark, "store"))
    first = store.commit({"edges": edge, "citations": cite}, -1)
    pages = docs.select(node(n).alias("node"))
    last, _ = commits.remap_graph(store, pairs, model.KINDS, pages, F.col("type").isin(model.SYMMETRIC_TYPES))
    assert last == first + 1
    both = store.read("edges").withColumn("table", F.lit("edges")).select("table", "from_id", "to_id", "_ord").unionByName(store.read("citations").withColumn("table", F.lit("citations")).select("table", "from_id", "to_id", "_ord"))
    return both.withColumnRenamed("_ord", "ord")


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '{}' ELSE '{"title": "T: ' || doc_id || '", "n": ' || doc_id || ', "bad": "[open", "ratio": 0.5, "ok": true, "tags": ["a", "b, c", 2], "evidence": [{"source": "s' || doc_id || '", "pages": [3, {"deep": "d"}]}, "plain"], "setup": {"inner": {"model": "' || coalesce(lang, '?') || '"}}, "note": "one\\n two", "last": ""}' END AS header,
  CASE WHEN doc_id % 9 = 0 THEN '{}' ELSE '{"title": "\\"T: ' || doc_id || '\\" # said", "n": "' || doc_id || '", "bad": "[open", "ratio": "0.5", "ok": "yes", "tags": ["a", "b", "c", "2"], "evidence": ["source: s' || doc_id || '", "3", "deep: d", "plain"], "setup": [], "note": "|", "last": []}' END AS lint,
  CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE 'fallback' END AS mode, CASE WHEN doc_id % 9 = 0 THEN 'none' ELSE 'lint' END AS lint_mode, sha256(CASE WHEN doc_id % 9 = 0 THEN '--- no header' || chr(10) ELSE '' END || coalesce(text, '')) AS body FROM documents""")
def header_modes(spark: SparkSession, d: str) -> DataFrame:
    """Headers that are no YAML (a list is open) over whole texts, by both readers: types and nesting, and the lint's texts and lists."""
    n = F.col("doc_id")
    head = text(
        '---\ntitle: "T: ', n, '" # said\n# a comment\nn: ', n, '\nbad: [open\nratio: 0.5\nok: yes\ntags: [a, "b, c", 2]\nevidence:\n  - source: s', n, "\n    pages:\n      - 3\n      - deep: d\n  - plain\nsetup:\n  inner:\n    model: ",
        F.coalesce("lang", F.lit("?")), "\nnote: |\n  one\n   two\n   stray line\nlast:\n---\n",
    )
    head = F.replace(head, F.lit("   stray line\n"), F.lit(""))
    page = text(F.when(n % 9 == 0, "--- no header\n").otherwise(head), F.coalesce("text", F.lit("")))
    both = table(spark, d, "documents").select("doc_id", page.alias("page")).withColumns({"h": headers.header_json("page"), "l": headers.lint_header_json("page")})
    return both.select("doc_id", F.col("h.header").alias("header"), F.col("l.header").alias("lint"), F.col("h.parse_mode").alias("mode"), F.col("l.parse_mode").alias("lint_mode"), F.sha2("h.body", 256).alias("body"))


_PACK_SQL = """WITH d AS (SELECT doc_id, 'd' || lpad(doc_id::VARCHAR, 9, '0') AS slug, doc_id % 4 AS m, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source FROM documents),
  e AS (SELECT 'papers/d' || lpad((doc_id - doc_id % 4 + 1)::VARCHAR, 9, '0') AS f, 'claims/d' || lpad((doc_id - doc_id % 8)::VARCHAR, 9, '0') AS t, doc_id FROM documents),
  g AS (SELECT node, count(*) AS n FROM (SELECT f AS node FROM e UNION ALL SELECT t FROM e) GROUP BY 1),
  l AS (SELECT 0 AS pos, row_number() OVER (ORDER BY coalesce(n, 0) DESC, slug) AS k, '- [' || lang || '] T' || doc_id || ' (conf: ' || CASE WHEN doc_id % 8 = 0 THEN '0.5' ELSE '?' END || ')' AS line, 10000 AS most FROM d LEFT JOIN g ON node = 'claims/' || slug WHERE m = 0
    UNION ALL SELECT 1, row_number() OVER (ORDER BY doc_id), 'gap ' || doc_id, 10000 FROM d WHERE doc_id % 5 > 1
    UNION ALL SELECT 2, row_number() OVER (ORDER BY slug), '- ' || slug || CASE WHEN doc_id % 8 = 2 THEN ' — why ' || lang ELSE '' END, 10000 FROM d WHERE m = 2 AND doc_id % 3 < 2
    UNION ALL SELECT 3, row_number() OVER (ORDER BY coalesce(n, 0) DESC, slug), '- [' || doc_id % 5 || '] T' || doc_id || ' (' || source || ')', 15 FROM d LEFT JOIN g ON node = 'papers/' || slug WHERE m = 1
    UNION ALL SELECT 4, row_number() OVER (ORDER BY slug), '- [planned] T' || doc_id || ' → c' || CASE WHEN doc_id % 8 = 3 THEN ' (failed)' ELSE '' END, 10000 FROM d WHERE m = 3
    UNION ALL SELECT 5, row_number() OVER (ORDER BY doc_id DESC), '  ' || f || ' --supports--> ' || t, 25 FROM e
    UNION ALL SELECT 6, row_number() OVER (ORDER BY m IN (2, 3, 0), m = 3 OR m = 0, m = 0, slug), '- ' || ['claims', 'papers', 'ideas', 'experiments'][m + 1] || '/' || slug || ' (last: 2024-01-0' || 1 + doc_id % 9 || ')', 10 FROM d WHERE doc_id % 50 = 7),
  s AS (SELECT pos, count(*) AS total, string_agg(line, chr(10) ORDER BY CASE WHEN pos = 5 THEN -k ELSE k END) FILTER (k <= most) AS body FROM l GROUP BY pos),
  b(purpose, budgets) AS (VALUES ('ideation', [1500, 2000, 2000, 1000, 500, 500, 500]), ('writing', [2000, 500, 200, 2500, 500, 800, 0]), ('other', [2000, 1500, 1500, 2000, 0, 1000, 0])),
  p AS (SELECT purpose, pos, CASE pos WHEN 0 THEN '## Claims (' || total || ' total)' WHEN 1 THEN '## Open Gaps' WHEN 2 THEN '## Failed Ideas (avoid repeating)' WHEN 3 THEN '## Papers (' || total || ' total)' WHEN 4 THEN '## Experiments (' || total || ' total)'
      WHEN 5 THEN '## Recent Relationships (' || total || ' total)' ELSE '## Stale Entities' END || chr(10) || left(body, budgets[pos + 1]) || chr(10) AS part, '# Query Pack (' || purpose || ')' || chr(10) || chr(10) || '_Auto-generated compressed context. Do not edit._' || chr(10) || chr(10) AS head FROM s, b WHERE budgets[pos + 1] > 0),
  c AS (SELECT *, length(head) + sum(length(part)) OVER (PARTITION BY purpose ORDER BY pos) AS upto FROM p), o AS (SELECT *, min(CASE WHEN upto > MOST THEN pos END) OVER (PARTITION BY purpose) AS first_over FROM c),
  w AS (SELECT purpose, head, string_agg(part, '' ORDER BY pos) FILTER (first_over IS NULL OR pos < first_over) AS whole, max(part) FILTER (pos = first_over) AS last, max(MOST - 25 - (upto - length(part))) FILTER (pos = first_over) AS room FROM o GROUP BY purpose, head)
  SELECT purpose, head || coalesce(whole, '') || CASE WHEN room > 100 THEN left(last, room::BIGINT) || chr(10) || '...(truncated)' || chr(10) ELSE '' END AS text FROM w""".replace("MOST", "5000")


@query(_PACK_SQL)
def context_packs(spark: SparkSession, d: str) -> DataFrame:
    """Context packs for three purposes from one gathering of seven sections, cut to 5,000 characters."""
    docs, n = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("source", F.lit("?")).alias("source")), F.col("doc_id")
    slug = lambda x: text("d", F.lpad(x.cast("string"), 9, "0"))
    none, title = F.lit(None).cast("string"), text("T", n)
    old = F.when(n % 50 == 7, text("2024-01-0", 1 + n % 9)).when(n % 50 == 9, "2024-1-x").otherwise("2024-03-01")
    fields = {
        "title": F.when(n % 4 != 2, title), "status": F.when(n % 4 == 0, F.col("lang")).when(n % 4 == 2, F.when(n % 3 == 0, "failed").when(n % 3 == 1, "rejected").otherwise("open")).when(n % 4 == 3, "planned"), "confidence": F.when(n % 8 == 0, "0.5"),
        "failure_reason": F.when(n % 8 == 2, text("why ", F.col("lang"))).otherwise(""), "importance": (n % 5).cast("string"), "domain": F.col("source"), "target_claim": F.lit("c"), "outcome": F.when(n % 8 == 3, "failed").otherwise(none),
        "date_updated": F.when(n % 50 != 7, old).otherwise(""), "date_added": old,
    }
    kind = F.element_at(F.array(*map(F.lit, ("claims", "papers", "ideas", "experiments"))), (n % 4 + 1).cast("int"))
    header = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    pages = docs.select(kind.alias("kind"), slug(n).alias("slug"), text(kind, "/", slug(n), ".md").alias("path"), header.alias("header"))
    edges = docs.select(text("papers/", slug(n - n % 4 + 1)).alias("from_id"), text("claims/", slug(n - n % 8)).alias("to_id"), F.lit("supports").alias("type"), n.alias("_ord"))
    gaps = docs.select(n.alias("_ord"), F.when(n % 5 == 0, "## a heading").when(n % 5 == 1, "  ").otherwise(text("gap ", n)).alias("line"))
    return compose.compile_context(spark, pages, edges, gaps, ["ideation", "writing", "other"], "2024-03-10", 5000)


@query("""WITH q AS (SELECT doc_id, doc_id % 7 AS m FROM documents) SELECT doc_id AS file, CASE m WHEN 0 THEN 'anchor-ambiguous' WHEN 3 THEN 'anchor-not-found' WHEN 4 THEN 'missing-source-anchor' ELSE 'anchor-not-found' END AS category,
  CASE m WHEN 0 THEN 'evidence[2]: s' || doc_id || '#Alpha: Beta (3 headings)' WHEN 3 THEN 'evidence[2]: s' || doc_id || '#alpha-beta-3' WHEN 4 THEN 'evidence[2]' ELSE 'evidence[2]: s' || doc_id || '#Hidden' END AS message FROM q WHERE m IN (0, 3, 4, 6)""")
def anchor_findings(spark: SparkSession, d: str) -> DataFrame:
    """Quoted anchors against the headings of whole sources: missing, ambiguous and not given."""
    n = F.col("doc_id")
    body = text("# Alpha, beta\n", F.coalesce("text", F.lit("")), "\n```\n# Hidden\n```\n## Alpha -  Beta ##\n### alpha beta\n## alpha--beta\n## Último: año ", n, "\n")
    body = F.replace(body, F.lit("## Alpha -  Beta ##"), F.lit("## *Alpha* Beta ##"))
    sources = table(spark, d, "documents").select(text("s", n).alias("source"), body.alias("text"))
    said = F.element_at(F.array(F.lit("Alpha: Beta"), F.lit("#alpha-beta"), F.lit("Alpha beta-2"), F.lit("alpha-beta-3"), F.lit(""), F.lit(" "), F.lit("Hidden")), (n % 7 + 1).cast("int"))
    item = lambda s, dt: F.struct(text("s", n).alias("source"), s.alias("source_anchor"), dt.alias("detail"))
    evidence = F.array(item(text("último año ", n), F.lit("x")), item(said, F.when(n % 7 == 5, "Source_Anchor : p. 3").otherwise("d")))
    claims = table(spark, d, "documents").select(n.alias("file"), evidence.alias("evidence"))
    return quality.anchors(claims, quality.anchor_index(sources)).select("file", "category", "message")


@query("""WITH e AS (SELECT doc_id AS o, doc_id - doc_id % 5 AS id, doc_id % 5 AS m, coalesce(n_chars, 0) AS n, coalesce(lang, '?') AS lang FROM documents),
  r AS (SELECT *, CASE m WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 3 END AS rank, CASE WHEN m = 3 THEN 7 ELSE 7 + n % 2 END AS len FROM e),
  w AS (SELECT *, max((rank, len)) OVER (PARTITION BY id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
  k AS (SELECT *, best IS NULL OR (rank, len) > best AS wins FROM w), l AS (SELECT *, max(CASE WHEN wins THEN o END) OVER (PARTITION BY id ORDER BY o) AS kept FROM k),
  s AS (SELECT id, 'w' || lang AS x FROM l UNION SELECT id, 'duplicate local source skipped in favor of preferred source: raw/' || kept FROM l WHERE best IS NOT NULL)
  SELECT 'c' || id AS id, 'raw/' || max(kept) AS source_path, (SELECT string_agg(x, '|' ORDER BY x) FROM s WHERE s.id = l.id) AS warnings FROM l GROUP BY id""")
def merged_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries of several readers merged by preference, with the warnings of all."""
    n = F.col("doc_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n % 5 + 1).cast("int"))
    e = table(spark, d, "documents").select(
        text("c", n - n % 5).alias("id"), pick("pdf", "md", "pdf", "archive", "x").alias("original_format"), pick("pdf", "md", "tex", "tex", "mineru-md").alias("ingest_format"),
        F.when((n % 5 != 3) & (F.coalesce("n_chars", F.lit(0)) % 2 == 1), "8 signs.").otherwise("7 signs").alias("abstract"), text("raw/", n).alias("source_path"), F.array(text("w", F.coalesce("lang", F.lit("?")))).alias("warnings"), n.alias("_ord"),
    )
    return tables.preferred_entries(e).select("id", "source_path", F.array_join("warnings", "|").alias("warnings"))


@query("""WITH d AS (SELECT doc_id, ['ideas', 'experiments', 'claims'][doc_id % 3 + 1] AS kind, ['tested', 'running', 'proposed'][doc_id % 3 + 1] AS was, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'validated' ELSE 'failed' END WHEN 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'planned' ELSE 'completed' END ELSE 'weakly_supported' END AS wish,
    CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE ' of ' || coalesce(lang, '?') || ' ' END AS reason, doc_id % 7 = 0 AS lost FROM documents),
  o AS (SELECT *, CASE WHEN lost THEN 'no page' WHEN kind = 'experiments' AND wish = 'planned' THEN 'not allowed' WHEN wish = 'failed' AND trim(reason) = '' THEN 'no reason' ELSE 'moved' END AS outcome FROM d)
  SELECT kind, doc_id, outcome, CASE WHEN lost THEN NULL WHEN outcome = 'moved' THEN wish ELSE was END AS status, CASE WHEN outcome = 'moved' AND wish IN ('failed', 'validated') THEN 'date_resolved=2024-05-06' WHEN outcome = 'moved' AND wish = 'completed' THEN 'date_completed=2024-05-06' END AS dated,
    CASE WHEN outcome = 'moved' AND wish = 'failed' THEN trim(reason) END AS failure_reason FROM o""")
def status_moves(spark: SparkSession, d: str) -> DataFrame:
    """Status changes along the life cycles, with the fields that come with them, and what becomes of each request."""
    n = F.col("doc_id")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (n % 3 + 1).cast("int"))
    slug = text("d", n)
    all_ = table(spark, d, "documents").select(n, pick("ideas", "experiments", "claims").alias("kind"), slug.alias("slug"), pick("tested", "running", "proposed").alias("was"), F.coalesce("lang", F.lit("?")).alias("lang"))
    pages = all_.filter(n % 7 != 0).select("kind", "slug", F.create_map(F.lit("title"), F.col("slug"), F.lit("status"), F.col("was")).alias("header"))
    wish = F.when(n % 3 == 0, F.when(n % 4 == 0, "validated").otherwise("failed")).when(n % 3 == 1, F.when(n % 4 == 0, "planned").otherwise("completed")).otherwise("weakly_supported")
    moves = all_.select("kind", "slug", wish.alias("status"), F.when(n % 5 == 0, " ").otherwise(text(" of ", F.col("lang"), " ")).alias("reason"))
    after, report = edits.transition(pages, moves, "2024-05-06")
    at = lambda k: F.try_element_at("header", F.lit(k))
    dated = F.coalesce(F.concat(F.lit("date_resolved="), at("date_resolved")), F.concat(F.lit("date_completed="), at("date_completed")))
    now = after.select("kind", "slug", at("status").alias("status"), dated.alias("dated"), at("failure_reason").alias("failure_reason"))
    return report.drop("status").join(now, ["kind", "slug"], "left").select("kind", F.substring("slug", 2, 20).cast("long").alias("doc_id"), "outcome", "status", "dated", "failure_reason")


@query("""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '["' || coalesce(lang, '?') || '"]' WHEN 1 THEN '["a","' || coalesce(lang, '?') || '"]' ELSE '["' || coalesce(lang, '?') || '","b"]' END AS tags,
  sha256(CASE WHEN doc_id % 2 = 0 THEN '## Notes' || chr(10) || '- new ' || doc_id || chr(10) || '- old' || chr(10) || '## End' || chr(10) || coalesce(text, '') ELSE rtrim('# T' || chr(10) || coalesce(text, ''), E' \\t\\n\\x0b\\x0c\\r') || chr(10) || chr(10) || '## Notes' || chr(10) || chr(10) || '- new ' || doc_id || chr(10) || '- old' || chr(10) END) AS digest FROM documents""")
def appended_fields(spark: SparkSession, d: str) -> DataFrame:
    """A value appended to a list field once, and lines to a section of whole texts, which is made where it is not there."""
    n, lang = F.col("doc_id"), F.coalesce("lang", F.lit("?"))
    have = F.when(n % 3 == 1, F.lit('["a"]')).when(n % 3 == 2, text('["', lang, '","b"]'))
    header = F.map_filter(F.create_map(F.lit("tags"), have, F.lit("title"), F.lit("T")), lambda _, v: v.isNotNull())
    body = F.when(n % 2 == 0, text("## Notes\n- old\n## End\n", F.coalesce("text", F.lit("")))).otherwise(text("# T\n", F.coalesce("text", F.lit(""))))
    lines = F.array(text("- new ", n), F.lit("- old"))
    df = table(spark, d, "documents").select("doc_id", header.alias("header"), body.alias("body"), lang.alias("l"), lines.alias("lines"))
    return df.select("doc_id", edits.append_meta(F.col("header"), "tags", F.col("l"))["tags"].alias("tags"), F.sha2(edits.append_to_section(F.col("body"), "## Notes", F.col("lines")), 256).alias("digest"))


@query("""WITH d AS (SELECT doc_id AS i, 'd' || doc_id AS slug, doc_id % 4 AS m FROM documents), p AS (SELECT *, ['papers', 'concepts', 'claims', 'ideas'][m + 1] || '/' || slug || '.md' AS file FROM d)
  SELECT 'red' AS level, 'sync-conflict' AS category, 'papers/' || slug || '-NSConflict-1.md' AS file, 'copy left by a sync conflict' AS message, FALSE AS fixable FROM p WHERE i % 50 = 7
  UNION ALL SELECT 'red', 'missing-field', file, 'Missing required field: importance', TRUE FROM p WHERE i % 8 = 0 UNION ALL SELECT 'red', 'missing-field', file, 'Missing required field: origin', FALSE FROM p WHERE i % 16 = 3
  UNION ALL SELECT 'yellow', 'invalid-value', file, 'paper_type=odd', FALSE FROM p WHERE m = 0 AND i % 12 = 4 UNION ALL SELECT 'red', 'invalid-confidence', file, 'confidence=1.5', FALSE FROM p WHERE i % 8 = 2
  UNION ALL SELECT 'yellow', 'broken-link', file, 'nowhere', FALSE FROM p WHERE i % 16 = 1 UNION ALL SELECT 'yellow', 'broken-link', file, 'd' || (i + 1), FALSE FROM p WHERE m = 0 AND i + 1 NOT IN (SELECT i FROM d)
  UNION ALL SELECT 'yellow', 'orphan-page', file, 'no incoming links', FALSE FROM p WHERE m = 3 OR m IN (0, 2) AND i + 1 NOT IN (SELECT i FROM d) OR m = 1 AND i - 1 NOT IN (SELECT i FROM d)
  UNION ALL SELECT 'red', 'failure-reason', file, 'failed idea without failure_reason', FALSE FROM p WHERE i % 8 = 3
  UNION ALL SELECT 'yellow', 'xref-asymmetry', file, 'd' || (i + 1), TRUE FROM p WHERE m = 0 AND i % 20 = 0 AND i + 1 IN (SELECT i FROM d)
  UNION ALL SELECT 'blue', 'quality', file, 'maturity=stable but only 1 key_paper', FALSE FROM p WHERE m = 1 AND i % 24 = 5
  UNION ALL SELECT 'yellow', 'self-citation', 'citations:' || i, '', FALSE FROM d WHERE i % 30 = 0 UNION ALL SELECT 'yellow', 'citation-date', 'citations:' || i, '', FALSE FROM d WHERE i % 30 > 0 AND i % 45 = 0
  UNION ALL SELECT 'yellow', 'legacy-edge-type', 'edges:' || i, '', FALSE FROM d WHERE i % 28 = 0""")
def lint_findings(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the lint over a vault of one page for each document, with its graph, as findings."""
    docs, n = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("papers", "concepts", "claims", "ideas"))), (n % 4 + 1).cast("int"))
    slug, none = text("d", n), F.lit(None).cast("string")
    fields = {
        "papers": {"title": F.lit("t"), "slug": slug, "paper_type": F.when(n % 12 == 4, "odd").otherwise("paper"), "tags": F.lit("[]"), "research_modes": F.array().cast("array<string>"), "research_object_tags": F.lit("[]"), "importance": F.when(n % 8 != 0, "3")},
        "concepts": {"title": F.lit("t"), "tags": F.lit("[]"), "maturity": F.when(n % 24 == 5, "stable").otherwise("active"), "key_papers": F.array(text("d", n - 1))},
        "claims": {"title": F.lit("t"), "slug": slug, "status": F.lit("proposed"), "confidence": F.when(n % 8 == 2, "1.5").otherwise("0.5"), "tags": F.lit("[]"), "source_papers": F.array().cast("array<string>"), "evidence": F.array().cast("array<string>")},
        "ideas": {"title": F.lit("t"), "slug": slug, "status": F.when(n % 8 == 3, "failed").otherwise("proposed"), "origin": F.when(n % 16 != 3, "x"), "tags": F.lit("[]"), "priority": F.lit("3")},
    }
    header = F.coalesce(*[F.when(kind == k, F.to_json(F.struct(*[v.alias(f) for f, v in fs.items()]))) for k, fs in fields.items()])
    body = (
        F.when(n % 4 == 0, text("[[d", n + 1, "|next]]")).when(n % 4 == 1, text("## Source excerpts\n[x](sources/a.md)\n> q\n", F.when((n - 1) % 20 == 0, text("[[papers/d", n - 1, "]]")).otherwise(text("[[d", n - 1, "]]")), F.when(n % 16 == 1, "[[nowhere#a]]").otherwise("")))
        .when(n % 4 == 3, text("[[d", n - 1, "]]")).otherwise("no links [[#here]]")
    )
    pages = docs.select(kind.alias("kind"), slug.alias("slug"), text(kind, "/", slug, ".md").alias("path"), body.alias("body"), header.alias("header"))
    edges = docs.filter(n % 28 == 0).select(text("papers/", slug).alias("from_id"), text("papers/", slug).alias("to_id"), F.lit("extends").alias("type"), F.lit("e").alias("evidence"), none.alias("confidence"), F.lit(None).cast("boolean").alias("symmetric"), n.alias("_ord"))
    cites = docs.filter((n % 30 == 0) | (n % 45 == 0)).select(text("papers/", slug).alias("from_id"), text("papers/d", F.when(n % 30 == 0, n).otherwise(n + 1)).alias("to_id"), F.lit("cites").alias("type"), F.lit("manual").alias("source"), F.when(n % 30 == 0, "2024-01-01").otherwise("May").alias("date"), n.alias("_ord"))
    copies = docs.filter(n % 50 == 7).select(text("papers/", slug, "-NSConflict-1.md").alias("path"))
    return compose.lint_all(spark, pages, edges, cites, copies).select("level", "category", "file", "message", "fixable")


@query("""WITH e AS (SELECT doc_id, 'papers/d' || doc_id AS from_id, 'concepts/' || coalesce(lang, '?') AS to_id, coalesce(source, '?') AS evidence FROM documents)
  SELECT from_id, to_id, CASE WHEN doc_id = 7 THEN 'checked' ELSE evidence END AS evidence, CASE WHEN doc_id = 5 THEN 'low' ELSE 'high' END AS confidence FROM e WHERE doc_id <> 9""")
def edge_updates(spark: SparkSession, d: str) -> DataFrame:
    """One edge's confidence set, one's evidence compared and set, one removed, out of a whole table."""
    n = F.col("doc_id")
    e = table(spark, d, "documents").select(text("papers/d", n).alias("from_id"), text("concepts/", F.coalesce("lang", F.lit("?"))).alias("to_id"), F.lit("uses_concept").alias("type"), F.coalesce("source", F.lit("?")).alias("evidence"), F.lit("high").alias("confidence"))
    of = {r.from_id: r for r in e.filter(F.col("from_id").isin("papers/d5", "papers/d7", "papers/d9")).collect()}  # three edges
    e = sinks.set_confidence(e, "papers/d5", of["papers/d5"].to_id, "uses_concept", "low")
    e, said = sinks.set_evidence(e, "papers/d7", of["papers/d7"].to_id, "uses_concept", "checked", of["papers/d7"].evidence)
    again, same = sinks.set_evidence(e, "papers/d7", of["papers/d7"].to_id, "uses_concept", "checked")
    assert (said, same) == ("changed", "unchanged")
    return sinks.remove_edge(again, "papers/d9", of["papers/d9"].to_id, "uses_concept", of["papers/d9"].evidence).drop("type")


@query("""SELECT CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 'papers/d' || doc_id END AS from_id, CASE WHEN doc_id % 17 = 0 OR doc_id % 11 = 0 THEN NULL ELSE 'concepts/' || coalesce(lang, '?') END AS to_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE sha256(coalesce(text, '')) END AS evidence,
  CASE WHEN doc_id % 17 = 0 THEN 'not json ' || doc_id END AS corrupt FROM documents WHERE doc_id % 19 <> 0""")
def json_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges written as JSON lines with whole texts as evidence, read back: blank lines skipped, lines that are no objects kept as they are."""
    n = F.col("doc_id")
    good = F.to_json(F.struct(text("papers/d", n).alias("from"), F.when(n % 11 != 0, text("concepts/", F.coalesce("lang", F.lit("?")))).alias("to"), F.lit("supports").alias("type"), F.coalesce("text", F.lit("")).alias("evidence"), F.lit(3).alias("more")))
    at = scratch(spark, "json-edges")
    table(spark, d, "documents").select(F.when(n % 19 == 0, " ").when(n % 17 == 0, text("not json ", n)).otherwise(good).alias("value")).write.text(at)
    return tables.edges(spark, at).select("from_id", "to_id", F.sha2("evidence", 256).alias("evidence"), F.col("_corrupt").alias("corrupt"))


@query("""SELECT doc_id, coalesce(lang, '?') AS lang, length(coalesce(text, '')) AS n, sha256(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 4 < 3""")
def sqlite_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts written as SQLite databases, one for each task, and read back through the source in ranges of rows."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    at = tables.write_sqlite(docs, scratch(spark, "sqlite"), "docs")
    back = tables.sqlite(spark, f"{at}/*.db", "SELECT doc_id, lang, text FROM docs WHERE doc_id % 4 < 3", "doc_id long, lang string, text string", 2, "doc_id")
    return back.select("doc_id", "lang", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query("""WITH d AS (SELECT doc_id, 'd' || doc_id AS slug FROM documents), l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k FROM documents WHERE doc_id % 3 < 2),
  b AS (SELECT doc_id, trim(x, E' \\t\\n\\x0b\\x0c\\r') AS line, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS pos FROM l WHERE trim(x, E' \\t\\n\\x0b\\x0c\\r') <> '')
  SELECT (doc_id % 3)::INT AS branch, 'd' || doc_id AS slug, pos::INT AS pos, sha256(line) AS line FROM b UNION ALL SELECT 2, slug, 0, sha256('weak claim: T' || doc_id) FROM d WHERE doc_id % 3 = 2 AND (doc_id % 2 = 0 OR doc_id % 5 = 0)""")
def open_questions(spark: SparkSession, d: str) -> DataFrame:
    """Bullets of the open sections of topics and concepts (whole texts, a bullet a line), then weak claims."""
    n = F.col("doc_id")
    trimmed = lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), trimmed), lambda x: x != "")
    bullets = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n")
    body = F.concat(F.when(n % 3 == 0, "# T\n## Open problems\n").otherwise("## Open Questions\nnot a bullet\n"), bullets, F.lit("\n## Next\n- other\n"))
    docs = table(spark, d, "documents").select(n, body.alias("body"))
    pages = docs.filter("doc_id % 3 < 2").select(F.when(n % 3 == 0, "topics").otherwise("concepts").alias("kind"), text("d", n).alias("slug"), "body", n.alias("_ord"))
    claims = docs.filter("doc_id % 3 = 2").select(text("d", n).alias("slug"), text("T", n).alias("title"), n.alias("_ord"), F.when(n % 5 == 0, "0.2").otherwise("0.9").alias("confidence"), F.when(n % 2 == 0, "proposed").otherwise("supported").alias("status"))
    out = compose.open_questions(pages, claims, {"topics": "open problems", "concepts": "Open questions"})
    return out.select(F.col("branch").cast("int"), "slug", F.col("pos").cast("int"), F.sha2("line", 256).alias("line"))
