"""Gathering, resolution, plans and reports as queries over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import reports as R
from ..sources import tables as T
from ..sources.tables import table
from . import compose
from .registry import query


@query("""WITH r AS (SELECT l_suppkey AS anchor, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_returnflag = 'N' THEN 'literature_recommend' WHEN l_returnflag = 'R' THEN 'literature_reference' ELSE 'literature_citation' END AS source, l_partkey AS id FROM lineitem),
  n AS (SELECT *, row_number() OVER (PARTITION BY anchor, source ORDER BY ord, id) AS k FROM r) SELECT anchor::VARCHAR AS anchor, source, count(*) AS n FROM n WHERE k <= CASE WHEN source = 'literature_recommend' THEN 5 ELSE 3 END GROUP BY ALL""")
def anchor_gather(spark: SparkSession, d: str) -> DataFrame:
    """Three channels for each anchor, each cut to its limit."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("anchor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_ord"), F.col("l_partkey").alias("id"), "l_returnflag")
    a, b, c = (li.filter(F.col("l_returnflag") == x).drop("l_returnflag") for x in "NRA")
    return R.gather_anchors(a, b, c, 5, 3).select(F.col("anchors")[0].alias("anchor"), F.col("sources")[0].alias("source")).groupBy("anchor", "source").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT event_type AS q, event_id, 2000 + user_id % 20 AS y FROM events WHERE 2000 + user_id % 20 >= 2010), n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY event_id) AS k FROM r)
  SELECT event_id, q AS "query", 'literature_search' AS source FROM n WHERE k <= 50""")
def topic_gather(spark: SparkSession, d: str) -> DataFrame:
    """The first hits of each query from a year on."""
    e = table(spark, d, "events").select(F.col("event_type").alias("query"), "event_id", F.col("event_id").alias("_ord"), (2000 + F.col("user_id") % 20).alias("year"))
    return R.gather_topic(e, 50, 2010).select("event_id", F.col("queries")[0].alias("query"), F.col("sources")[0].alias("source"))


@query("""SELECT o_orderkey AS file, 'target_claim=c' || o_custkey AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderstatus <> 'P'""")
def claim_links(spark: SparkSession, d: str) -> DataFrame:
    """Experiments whose target claim is no page."""
    o = table(spark, d, "orders")
    ex = o.select(F.col("o_orderkey").alias("file"), F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("claims/c"), "o_custkey", F.lit(".md"))).otherwise("").alias("target_claim"))
    return R.claim_links(ex, table(spark, d, "customer").filter("c_acctbal > 0").select(F.concat(F.lit("c"), "c_custkey").alias("slug"))).select("file", "message")


@query("""WITH p AS (SELECT p_partkey AS file, p_size % 4 AS m FROM part) SELECT file, category FROM (SELECT file, 'missing-evidence-pack' AS category FROM p WHERE m = 0 UNION ALL SELECT file, 'missing-evidence-card-id' FROM p WHERE m = 1
  UNION ALL SELECT file, 'ungrounded-quote' FROM p WHERE m IN (1, 2, 3) AND file % 5 = 0 UNION ALL SELECT file, 'evidence-coverage' FROM p WHERE m IN (1, 2, 3) AND file % 7 > 4)""")
def evidence_packs(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of paper pages: section, ids, quotes and cards."""
    p = table(spark, d, "part").withColumn("file", F.col("p_partkey")).withColumn("m", F.col("p_size") % 4)
    body = F.when(F.col("m") == 0, "# T\n").when(F.col("m") == 1, "## Evidence Pack\n> quote\n").when(F.col("m") == 2, "## Evidence Pack\nE1 > quote\n## Next\n").otherwise("## Evidence Pack\nsource_file: a.md\n")
    grounded = p.select("file", F.lit("quote").alias("quote"), (F.col("file") % 5 != 0).alias("grounded"))
    coverage = p.select("file", F.lit("required").alias("label"), F.greatest(F.col("file") % 7 - 4, F.lit(0)).alias("missing"))
    return R.evidence_pack(p.select("file", body.alias("body")), grounded, coverage).select("file", "category")


@query("""SELECT c_custkey AS id, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN 'ready' WHEN count(DISTINCT o_orderpriority) > 1 THEN 'ambiguous' ELSE 'missing' END AS status, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS path
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def job_inputs(spark: SparkSession, d: str) -> DataFrame:
    """The one input that a lookup table has for a job."""
    lookup = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("path"))
    return R.resolved_jobs(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), lookup)


@query("""WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'doi' WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN 'citationKey' ELSE 'unresolved' END AS how FROM part)
  SELECT count(*) FILTER (how <> 'unresolved') AS matched, count(*) FILTER (how = 'unresolved') AS unresolved, count(*) FILTER (how = 'doi') AS by_doi, 0::BIGINT AS by_title FROM p""")
def classification_totals(spark: SparkSession, d: str) -> DataFrame:
    """Pages matched to library items by DOI, citation key or title, counted."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size")
    none = F.lit(None).cast("string")
    pages = p.select(
        F.col("k").alias("lid"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("10.1/"), "k")).alias("doi"), F.when(F.col("k") % 3 == 1, F.concat(F.lit("K"), "k")).otherwise(none).alias("ck"), F.concat(F.lit("page "), "k").alias("title"), F.lit(2000).alias("year")
    )
    items = p.filter("k % 3 = 0 or p_size % 2 = 0").select(
        F.col("k").alias("rid"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("10.1/"), "k")).alias("doi"), F.when(F.col("k") % 3 == 1, F.concat(F.lit("k"), "k")).otherwise(none).alias("ck"), F.concat(F.lit("item "), F.col("k") + 5_000_000).alias("title"), F.lit(1990).alias("year")
    )
    levels = [("doi", F.col("doi"), F.col("doi"), True), ("citationKey", F.lower("ck"), F.lower("ck"), False)]
    found = J.cascade(pages, items, "lid", "rid", levels).withColumnRenamed("level", "how")
    return R.match_totals(found)


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS shortlist_rank FROM part""")
def ranked_manifest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return R.source_manifest(p, [F.col("p_retailprice").desc(), F.col("p_partkey")]).select("p_partkey", F.col("shortlist_rank").cast("long").alias("shortlist_rank"))


@query("""SELECT 'c' || o_custkey AS paper, 'd-v' || o_orderkey % 3 AS draft, count(*) + 1 AS files FROM orders WHERE o_orderstatus <> 'P' AND (o_custkey, o_orderkey % 3) IN (SELECT o_custkey, o_orderkey % 3 FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def workspace_list(spark: SparkSession, d: str) -> DataFrame:
    """Workspaces with a manifest among the paths of a store."""
    o = table(spark, d, "orders")
    at = F.concat(F.lit("papers/c"), "o_custkey", F.lit("/drafts/d-v"), (F.col("o_orderkey") % 3).cast("string"), F.lit("/"))
    files = o.filter("o_orderstatus <> 'P'").select(F.concat(at, F.lit("f"), "o_orderkey").alias("path"))
    manifests = o.filter("o_orderstatus = 'F'").select(F.concat(at, F.lit("manifest.json")).alias("path")).distinct()
    return R.workspaces(files.unionByName(manifests).unionByName(files.limit(1).select(F.lit("papers/.x/drafts/y/z").alias("path"))))


@query("""SELECT 'raw/' || event_type || '/' || event_id AS path, CASE WHEN event_type = 'view' THEN 'log' ELSE 'raw' END AS scope, CASE WHEN event_type = 'click' THEN 'keep' ELSE 'delete' END AS action FROM events WHERE event_type <> 'error'""")
def reset_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a scoped reset would delete."""
    files = table(spark, d, "events").select(F.concat(F.when(F.col("event_type") == "error", "wiki/").otherwise("raw/"), "event_type", F.lit("/"), "event_id").alias("path"))
    return R.reset_plan(files, {"log": ["raw/view/"], "raw": ["raw/"], "wiki": ["wiki/"]}, ["log", "raw"], ["raw/click/"])


@query("""SELECT 'a/' || event_type || '/' || event_id AS path, CASE WHEN event_type = 'view' THEN 'c/v/' ELSE 'b/' || event_type || '/' END || event_id AS target, CASE WHEN event_type = 'click' AND event_id % 2 = 0 THEN 'conflict' ELSE 'move' END AS status FROM events""")
def relocation_plan(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    here = e.select(F.concat(F.lit("a/"), "event_type", F.lit("/"), "event_id").alias("path"))
    there = e.filter("event_type = 'click' and event_id % 2 = 0").select(F.concat(F.lit("b/click/"), "event_id").alias("path"))
    return R.relocation_plan(here.unionByName(there), {"a/": "b/", "a/view/": "c/v/"})


@query("""WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS k FROM labels), b AS (SELECT * FROM r WHERE k <= 100), g AS (SELECT CASE quality WHEN 1 THEN 1 ELSE 2 END AS place, string_agg('- d' || doc_id, chr(10) ORDER BY k) AS lines FROM b GROUP BY 1)
  SELECT 0 AS place, '# Candidates' || chr(10) AS text UNION ALL SELECT place, CASE place WHEN 1 THEN '## High' ELSE '## Low' END || chr(10) || chr(10) || lines || chr(10) FROM g""")
def promotion_report(spark: SparkSession, d: str) -> DataFrame:
    """A report of the first hundred, cut before grouping."""
    items = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")).withColumn("priority", F.when(F.col("quality") == 1, "high").otherwise("low"))
    return R.grouped_report(items, 100, [F.col("doc_id")], "priority", ["high", "low"], F.concat(F.lit("- d"), "doc_id"), "Candidates", "None.")


@query("""WITH s AS (SELECT s_suppkey, s_name, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) SELECT 0 AS place, (SELECT count(*) FROM supplier) || ' of 999 candidates' AS text
  UNION ALL SELECT k, k || '. **' || s_name || '** (' || printf('%.2f', s_acctbal) || ') why' FROM s""")
def shortlist_report(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_name").alias("title"), F.col("s_acctbal").alias("score"), F.col("s_suppkey").alias("_ord"), F.lit("why").alias("rationale"))
    return R.shortlist_report(s, 999)


@query("""SELECT c_custkey AS rank, '| ' || c_custkey || ' | ' || left(md5(c_name), 12) || ' | ' || c_nationkey || ' | 3 | ' || c_mktsegment || ', x |' AS text FROM customer""")
def queue_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return R.queue_report(c.select(F.col("c_custkey").alias("rank"), F.md5("c_name").alias("id"), F.col("c_nationkey").alias("pages"), F.lit(3).alias("importance"), F.array("c_mktsegment", F.lit("x")).alias("papers")))


@query("""SELECT DISTINCT l_suppkey AS target, '- [[o' || l_orderkey || ']]' AS line FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier)
  AND (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'N') AND l_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N')""")
def back_links(spark: SparkSession, d: str) -> DataFrame:
    """What a repair of one-way references would add."""
    li = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("page"), F.concat(F.lit("s"), "l_suppkey").alias("target"), "l_returnflag")
    bodies = li.filter("l_returnflag = 'N'").groupBy(F.col("target").alias("slug")).agg(F.array_join(F.transform(F.collect_set("page"), lambda x: F.concat(F.lit("[["), x, F.lit("]]"))), " ").alias("body"))
    lost = J.asymmetric_refs(li.select("page", "target").distinct(), bodies)
    return R.missing_back_links(lost, bodies, "Related").select(F.substring("target", 2, 20).cast("long").alias("target"), "line")


@query("""SELECT p_partkey, '@misc{k,' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  Extra = {y}' || chr(10) || '}' AS bibtex, 'extra' AS extra,
  '# T' || chr(10) || chr(10) || '## BibTeX' || chr(10) || chr(10) || '```bibtex' || chr(10) || '@misc{k,' || chr(10) || '  title = {' || p_name || '},' || chr(10) || '  Extra = {y}' || chr(10) || '}' || chr(10) || '```' || chr(10) AS body FROM part""")
def bibtex_move(spark: SparkSession, d: str) -> DataFrame:
    """An entry moved from the header or the body to one section at the end."""
    entry = F.concat(F.lit("@misc{k,\n  title = {"), "p_name", F.lit("},\n  Extra = {y}\n}"))
    inside = F.concat(F.lit("# T\n\n## BibTeX\n\n```bibtex\n"), entry, F.lit("\n```\n"))
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, entry).alias("header"), F.when(F.col("p_size") % 2 == 0, "# T\n").otherwise(inside).alias("body"))
    return R.moved_bibtex(p, "header", "body", ["title", "author", "year"]).select("p_partkey", "bibtex", F.array_join("extra", ",").alias("extra"), "body")


@query("""SELECT c_nationkey AS page, c_name AS title, '10.5/' || c_custkey AS id, 'A ' || c_mktsegment AS authors, (CASE WHEN c_custkey % 2 = 0 THEN 2001 ELSE 2002 END)::INT AS year, c_custkey AS citations FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 4 = 0""")
def second_provider(spark: SparkSession, d: str) -> DataFrame:
    """Recorded answers of a second provider, flattened; works before a year go first."""
    c = table(spark, d, "customer")
    year = F.when(F.col("c_custkey") % 2 == 1, 2002).when(F.col("c_custkey") % 4 == 0, 2001).otherwise(1990)
    work = F.struct(
        F.concat(F.lit("10.5/"), "c_custkey").alias("DOI"), F.array(F.concat(F.lit("<i>"), "c_name", F.lit("</i>"))).alias("title"), F.array(F.struct(F.lit("A").alias("given"), F.col("c_mktsegment").alias("family"))).alias("author"),
        F.struct(F.array(F.array(year, F.lit(5))).alias("date-parts")).alias("issued"), F.col("c_custkey").alias("is-referenced-by-count"), F.lit("not read").alias("publisher"),
    )
    answers = c.groupBy(F.col("c_nationkey").alias("page")).agg(F.to_json(F.struct(F.struct(F.collect_list(work).alias("items")).alias("message"))).alias("json"))
    return T.second_works(answers, 2000).select("page", "title", "id", F.array_join("authors", ", ").alias("authors"), "year", "citations")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS title, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS slug FROM customer""")
def header_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Scalar keys of headers that no parser takes."""
    head = F.concat(F.lit("---\ntitle: \""), "c_name", F.lit("\"\nbad: [unclosed: {\nslug: "), "c_mktsegment", F.lit("\n---\ntitle: not this\n"))
    pages = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 > 0, head).otherwise("title: not this\n").alias("text"))
    return R.salvaged_header(spark, pages, ["title", "slug"]).select("c_custkey", "title", "slug")


@query("""SELECT o_orderkey AS ord, '{"at":"2024-01-01","who":"u' || o_custkey || '","what":"' || o_orderstatus || '"}' AS value FROM orders""")
def audit_lines(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select(F.col("o_orderkey").alias("_ord"), F.concat(F.lit("u"), "o_custkey").alias("who"), F.col("o_orderstatus").alias("what"))
    return R.audit_rows(e, R.today("2024-01-01")).select(F.col("_ord").alias("ord"), "value")


@query("""SELECT c_custkey AS lid, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS rid, CASE WHEN c_custkey % 2 = 0 THEN 'title' ELSE 'unresolved' END AS how FROM customer WHERE c_custkey < 9e15""")
def title_matches(spark: SparkSession, d: str) -> DataFrame:
    """Pages matched to items by an equal title of the same year, with a lead over the second."""
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.lit("k"), F.sha1(F.col("c_custkey").cast("string")), F.lit(" part "), "c_custkey").alias("title"))
    none = F.lit(None).cast("string")
    side = lambda df, k: df.select(F.col("c_custkey").alias(k), none.alias("doi"), none.alias("ck"), "title", F.lit(2000).alias("year"))
    got = compose.match_pages(side(c, "lid"), side(c.filter("c_custkey % 2 = 0"), "rid"))
    return got.select("lid", "rid", "how")
