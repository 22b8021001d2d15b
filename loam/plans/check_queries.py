"""Matching cascades, statistics, forms of keys and checks of pages as queries over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import udfs
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import quality as Q
from ..sources.tables import table
from .registry import query
from .repair_queries import text

_TITLES = """t AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS w, coalesce(lang, '?') AS y FROM documents),
  n AS (SELECT doc_id, array_to_string(w, ' ') AS title, array_to_string(w[1:8], ' ') || '|' || y AS k8, array_to_string(w[1:6], ' ') || '|' || y AS k6, array_to_string(w[1:4], ' ') || '|' || y AS k4, len(w) > 0 AS ok FROM t),
  l AS (SELECT * FROM n WHERE doc_id % 3 = 0), r AS (SELECT * FROM n WHERE doc_id % 3 > 0 AND ok)"""


def _titled(spark: SparkSession, d: str) -> DataFrame:
    title = F.array_join(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != ""), " ")
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.coalesce("lang", F.lit("?")).alias("year"))


@query(f"""WITH {_TITLES}, a AS (SELECT title, min(doc_id) AS m FROM r GROUP BY 1), b8 AS (SELECT k8, count(*) AS c, min(doc_id) AS m FROM r GROUP BY 1), b6 AS (SELECT k6, count(*) AS c, min(doc_id) AS m FROM r GROUP BY 1), b4 AS (SELECT k4, count(*) AS c, min(doc_id) AS m FROM r GROUP BY 1)
  SELECT l.doc_id AS slug, CASE WHEN NOT ok THEN NULL WHEN a.m IS NOT NULL THEN a.m WHEN b8.c = 1 THEN b8.m WHEN b6.c = 1 THEN b6.m WHEN b4.c = 1 THEN b4.m END AS stem,
    CASE WHEN NOT ok THEN 'unresolved' WHEN a.m IS NOT NULL THEN 'title-exact' WHEN b8.c = 1 THEN 'first8+year' WHEN b6.c = 1 THEN 'first6+year' WHEN b4.c = 1 THEN 'first4+year' WHEN b4.c > 1 THEN 'ambiguous' ELSE 'unresolved' END AS level
  FROM l LEFT JOIN a USING (title) LEFT JOIN b8 USING (k8) LEFT JOIN b6 USING (k6) LEFT JOIN b4 USING (k4)""")
def source_matches(spark: SparkSession, d: str) -> DataFrame:
    """Prepared sources of papers by title, then by first words and year; whole texts as titles."""
    t = _titled(spark, d)
    return J.match_sources(t.filter("doc_id % 3 = 0").withColumnRenamed("doc_id", "slug"), t.filter("doc_id % 3 > 0").withColumnRenamed("doc_id", "stem"))


@query(f"""WITH {_TITLES}, x AS (SELECT doc_id - doc_id % 7 AS doi, min(doc_id) AS m FROM r WHERE doc_id % 2 = 0 GROUP BY 1), a AS (SELECT title, count(*) AS c, min(doc_id) AS m FROM r GROUP BY 1), b6 AS (SELECT k6, count(*) AS c, min(doc_id) AS m FROM r GROUP BY 1)
  SELECT l.doc_id AS slug, CASE WHEN x.m IS NOT NULL THEN x.m WHEN NOT ok THEN NULL WHEN a.c = 1 THEN a.m WHEN b6.c = 1 THEN b6.m END AS item,
    CASE WHEN x.m IS NOT NULL THEN 'zotero-doi' WHEN NOT ok THEN 'unresolved' WHEN a.c = 1 THEN 'zotero-title-exact' WHEN b6.c = 1 THEN 'zotero-first6+year' ELSE 'unresolved' END AS level
  FROM l LEFT JOIN x ON x.doi = l.doc_id AND l.doc_id % 2 = 1 LEFT JOIN a USING (title) LEFT JOIN b6 USING (k6)""")
def library_matches(spark: SparkSession, d: str) -> DataFrame:
    """Library items of papers: the first with the DOI, the only one with the title, the only one with six words and year."""
    t, n = _titled(spark, d), F.col("doc_id")
    papers = t.filter("doc_id % 3 = 0").withColumn("doi", F.when(n % 2 == 1, text("10.1/", n)).otherwise("")).withColumnRenamed("doc_id", "slug")
    items = t.filter("doc_id % 3 > 0").withColumn("doi", F.when(n % 2 == 0, text("10.1/", n - n % 7))).withColumnRenamed("doc_id", "item")
    return J.match_library(papers, items)


@query("""WITH i AS (SELECT doc_id AS i, doc_id % 50 AS doi, lower(coalesce(lang, '?')) AS title FROM documents), j AS (SELECT doc_id, doc_id % 4 AS m FROM documents WHERE doc_id % 100 < 4),
  f AS (SELECT doi::VARCHAR AS k, 'doi' AS h, count(*) AS n, md5(string_agg('f' || i, ',' ORDER BY 'f' || i)) AS s FROM i GROUP BY 1 UNION ALL SELECT title, 'title', count(*), md5(string_agg('f' || i, ',' ORDER BY 'f' || i)) FROM i GROUP BY 1)
  SELECT doc_id AS job, coalesce(n, 0) AS files, coalesce(s, md5('')) AS digest FROM j LEFT JOIN f ON CASE m WHEN 0 THEN h = 'doi' AND k = (doc_id % 50)::VARCHAR WHEN 1 THEN h = 'title' AND k = 'de' WHEN 2 THEN FALSE ELSE h = 'title' AND k = 'nothing' END""")
def exact_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of the items with exactly a job's DOI, or with its title where it has none: an item of another DOI but the same title is none."""
    n, m = F.col("doc_id"), F.col("doc_id") % 4
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("lang"))
    items = docs.select(text("10.9/A", n % 50, " ").alias("doi"), F.upper("lang").alias("title"), F.array(text("f", n)).alias("paths"))
    jobs = docs.filter(n % 100 < 4).select(n.alias("job"), F.when(m == 0, text(" 10.9/a", n % 50)).when(m == 2, "10.9/none").otherwise("").alias("doi"), F.when(m == 3, "nothing").otherwise(" De! ").alias("title"))
    asked, files = J.exact_lists(jobs, items)
    lists = files.groupBy("k").agg(F.count(F.lit(1)).alias("files"), F.md5(F.array_join(F.sort_array(F.collect_list("path")), ",")).alias("digest"))
    return asked.join(lists, "k", "left").select("job", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("digest", F.md5(F.lit(""))).alias("digest"))


@query("""SELECT count(*) FILTER (doc_id % 8 = 0) AS papers, count(*) FILTER (doc_id % 8 = 1) AS concepts, count(*) FILTER (doc_id % 8 = 2) AS topics, count(*) FILTER (doc_id % 8 = 3) AS people, count(*) FILTER (doc_id % 8 = 4) AS ideas, count(*) FILTER (doc_id % 8 = 5) AS experiments,
  count(*) FILTER (doc_id % 8 = 6) AS claims, count(*) FILTER (doc_id % 8 = 7) AS summaries, count(*) FILTER (doc_id % 8 = 4 AND doc_id % 3 = 0) AS ideas_validated, count(*) FILTER (doc_id % 8 = 4 AND doc_id % 3 = 1) AS ideas_failed, count(*) FILTER (doc_id % 8 = 6 AND doc_id % 3 = 0) AS claims_supported,
  count(*) FILTER (doc_id % 8 = 6 AND doc_id % 3 = 1) AS claims_challenged, count(*) FILTER (doc_id % 5 > 1) AS edges, count(*) FILTER (doc_id % 5 = 0) AS citations FROM documents""")
def vault_stats(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen counts of a vault, pages without a header included."""
    docs, n = table(spark, d, "documents").select("doc_id"), F.col("doc_id")
    kinds = ["papers", "concepts", "topics", "people", "ideas", "experiments", "claims", "Summary"]
    status = F.when(n % 8 == 4, F.when(n % 3 == 0, "validated").when(n % 3 == 1, "failed").otherwise("Failed")).otherwise(F.when(n % 3 == 0, "supported").when(n % 3 == 1, "challenged"))
    pages = docs.select(F.element_at(F.array(*map(F.lit, kinds)), (n % 8 + 1).cast("int")).alias("kind"), F.when(n % 8 > 2, F.create_map(F.lit("status"), status)).alias("header"))
    return A.vault_stats(pages, docs.filter(n % 5 > 1), docs.filter(n % 5 == 0))


@query("""SELECT doc_id, (doc_id % 3 = 0)::BIGINT AS "Problem", 1 + (doc_id % 5 = 0)::BIGINT AS "Method", (doc_id % 3 > 0)::BIGINT AS "Results", 0::BIGINT AS "Limitations", 0::BIGINT AS "Concept", (doc_id % 2)::BIGINT AS "Claim" FROM documents""")
def card_uses(spark: SparkSession, d: str) -> DataFrame:
    """Evidence cards by use: the label that a card says, or for older ones the first that its line has; whole texts between the cards."""
    n = F.col("doc_id")
    section = text(
        "- `E1` method — a Problem of Results\n", F.regexp_replace(F.coalesce("text", F.lit("")), "(?m)^", "> "), "\n", F.when(n % 3 == 0, " - `E2` the problem, and a claim\n").otherwise("- `E2` claims Results\n"),
        F.when(n % 5 == 0, "\t- `E31`  METHOD  — x\n").otherwise("- `E` Method — no id\n"), F.when(n % 2 == 1, "- `E4` Claim: no dash").otherwise("- `E4` nothing"), "\n- Concept\n",
    )
    return A.use_counts(table(spark, d, "documents").select("doc_id", section.alias("section")), "doc_id", "section")


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'HTTPS://dx.doi.org/10.1234/AB.' || doc_id || '.;)' WHEN 1 THEN 'doi: 10.1234/Ab.' || doc_id || ' . ' WHEN 2 THEN 'doi.org/10.1234/aB' || doc_id ELSE NULL END AS x FROM documents)
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '10.1234/AB.' || doc_id || '.;)' WHEN 1 THEN 'doi: 10.1234/Ab.' || doc_id || ' .' WHEN 2 THEN x ELSE '' END AS candidate, CASE doc_id % 4 WHEN 0 THEN '10.1234/ab.' || doc_id || '.;)' WHEN 1 THEN '10.1234/ab.' || doc_id WHEN 2 THEN 'doi.org/10.1234/ab' || doc_id ELSE '' END AS plugin,
    CASE doc_id % 4 WHEN 0 THEN '10.1234/ab.' || doc_id WHEN 1 THEN 'doi: 10.1234/ab.' || doc_id WHEN 2 THEN '10.1234/ab' || doc_id ELSE '' END AS page, CASE WHEN doc_id % 4 = 3 AND doc_id % 3 = 0 THEN '10.5555/P' || doc_id WHEN doc_id % 4 = 3 THEN '' WHEN doc_id % 4 = 0 THEN '10.1234/AB.' || doc_id || '.;)' WHEN doc_id % 4 = 1 THEN 'doi: 10.1234/Ab.' || doc_id || ' .' ELSE x END AS of_candidate FROM c""")
def doi_forms(spark: SparkSession, d: str) -> DataFrame:
    """DOIs as the commands compare them."""
    n = F.col("doc_id")
    x = F.when(n % 4 == 0, text("HTTPS://dx.doi.org/10.1234/AB.", n, ".;)")).when(n % 4 == 1, text("doi: 10.1234/Ab.", n, " . ")).when(n % 4 == 2, text("doi.org/10.1234/aB", n))
    df = table(spark, d, "documents").select("doc_id", x.alias("x"), F.when(n % 3 == 0, text(" 10.5555/P", n)).otherwise(text("W", n)).alias("p"))
    return df.select("doc_id", *[X.doi_form("x", k).alias(k) for k in X.DOI_FORMS], X.candidate_doi("x", "p").alias("of_candidate"))


@query("""SELECT doc_id, sha256(regexp_replace(lower(strip_accents(replace(replace(coalesce(text, ''), chr(92), ''), '$', ''))) || 'caf' || 'e' || 'o' || 'x2' || doc_id || 'bold' || 'word', '[^a-z0-9]+', '', 'g')) AS key FROM documents WHERE regexp_full_match(coalesce(text, ''), '[\\x00-\\x7F\\x{C0}-\\x{D6}\\x{D8}-\\x{DD}\\x{E0}-\\x{F6}\\x{F8}-\\x{FD}\\s]*') AND coalesce(text, '') NOT LIKE '%' || chr(92) || '%'""")
def title_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of titles without LaTeX and accents, over whole texts of Latin letters."""
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).filter(F.col("t").rlike(r"\A[\x00-\x7F\x{C0}-\x{D6}\x{D8}-\x{DD}\x{E0}-\x{F6}\x{F8}-\x{FD}]*\z") & ~F.col("t").contains("\\"))
    title = text("", F.col("t"), " Caf\u00e9 $\\circ$ $x_{2}$ ", n, " \\textbf{Bold} \\alpha{}  W\u00f6rd")
    return docs.select("doc_id", F.sha2(X.alnum(udfs.nfkd_plain(X.without_latex(title))), 256).alias("key"))


@query("""WITH d AS (SELECT doc_id AS file, doc_id % 6 AS m, doc_id % 4 AS b FROM documents), f AS (
  SELECT 'red' AS level, 'paper-bibtex' AS category, file, 'bibtex in the header' AS message FROM d WHERE m = 5 UNION ALL SELECT 'yellow', 'paper-bibtex', file, 'no ## BibTeX section with an entry' FROM d WHERE b = 0
  UNION ALL SELECT 'yellow', 'paper-bibtex', file, 'fields beyond the core: abstract, url' FROM d WHERE b = 1 UNION ALL SELECT 'red', 'paper-classification', file, 'research_modes is no list' FROM d WHERE m = 0
  UNION ALL SELECT 'red', 'paper-classification', file, 'unknown modes: magic' FROM d WHERE m = 1 UNION ALL SELECT 'red', 'paper-classification', file, 'research_modes is empty' FROM d WHERE m = 2
  UNION ALL SELECT 'red', 'paper-classification', file, 'research_object_tags is no list or empty' FROM d WHERE m IN (2, 4) UNION ALL SELECT 'red', 'paper-classification', file, 'theory_tags is no list or empty' FROM d WHERE m IN (1, 3)
  UNION ALL SELECT 'red', 'paper-classification', file, 'experiment_tags is no list or empty' FROM d WHERE m = 4 UNION ALL SELECT 'red', 'paper-classification', file, 'no ## Research classification' FROM d WHERE m > 0 AND b = 2) SELECT * FROM f""")
def paper_checks(spark: SparkSession, d: str) -> DataFrame:
    """Entries and classification of paper pages with whole texts as bodies."""
    n, m, b = F.col("doc_id"), F.col("doc_id") % 6, F.col("doc_id") % 4
    header = (
        F.when(m == 0, '{"research_modes":"theory","research_object_tags":["x"]}').when(m == 1, '{"research_modes":["theory","magic"],"research_object_tags":["x"]}').when(m == 2, '{"research_modes":[]}')
        .when(m == 3, '{"research_modes":["theory"],"research_object_tags":["x"],"theory_tags":"t"}').when(m == 4, '{"research_modes":["computation","experiment"],"research_object_tags":[],"computation_tags":["c"],"experiment_tags":[]}')
        .otherwise('{"research_modes":["theory"],"research_object_tags":["x"],"theory_tags":["t"],"bibtex":"@x{}"}')
    )
    entry = F.when(b == 0, "## BibTeX\nno entry").when(b == 1, "## BibTeX\n\n```bibtex\n@a{k,\n  Title = {x},\n  URL = {y},\n abstract={z},\n url = {w}\n}\n```").otherwise("## BibTeX\n```bibtex\n@a{k,\n  title = {x}\n}\n```")
    body = text(F.when(b == 2, "").otherwise("## Research classification\n"), F.coalesce("text", F.lit("")), "\n", entry, "\n")
    return Q.paper_checks(table(spark, d, "documents").select(n.alias("file"), header.alias("header"), body.alias("body"))).select("level", "category", "file", "message")


@query("""WITH d AS (SELECT doc_id AS i, 'd' || doc_id AS s, doc_id % 9 AS m FROM documents), k AS (SELECT i FROM d WHERE m <> 8)
  SELECT 'papers/' || s || '.md' AS file, 'slug mismatch: ' || CASE m WHEN 1 THEN '<missing>' ELSE 'x' END || ' != ' || s AS issue FROM d WHERE m IN (1, 2) UNION ALL SELECT 'sources/papers/' || s || '.md', 'sourceSlug mismatch: <missing> != ' || s FROM d WHERE m = 3
  UNION ALL SELECT 'sources/papers/' || s || '.md', 'asset stem mismatch: assets/other/' FROM d WHERE m = 4 UNION ALL SELECT 'papers/' || s || '.md', 'broken paper endpoint: papers/gone' || i FROM d WHERE m = 5
  UNION ALL SELECT 'papers/' || s || '.md', 'broken paper endpoint: papers/d' || (i + 1) FROM d WHERE m <> 5 AND i + 1 NOT IN (SELECT i FROM d)
  UNION ALL SELECT 'papers/' || s || '.md', 'broken prepared-source link: @wiki-sources-papers/d' || (i + 1) || '.md' FROM d WHERE i + 1 NOT IN (SELECT i FROM k)""")
def migration_report(spark: SparkSession, d: str) -> DataFrame:
    """What a migration of slugs has left behind, in whole texts."""
    n, m = F.col("doc_id"), F.col("doc_id") % 9
    docs, slug = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")), text("d", n)
    body = text(F.col("t"), " see papers/", slug, ".md, sources/papers/not-mine", F.when(m == 5, text(" papers/gone", n, ", papers/zzz ")).otherwise(""), " [s](@wiki-sources-papers/d", n + 1, ".md)")
    papers = docs.select(text("papers/", slug, ".md").alias("path"), F.when(m == 1, " ").when(m == 2, "x").otherwise(slug).alias("slug"), body.alias("text"))
    own = text("![a](assets/", slug, "/1.png) ", F.col("t"), F.when(m == 4, " assets/other/1.png assets/more/").otherwise(""))
    sources = docs.filter(m != 8).select(text("sources/papers/", slug, ".md").alias("path"), F.when(m != 3, slug).alias("slug"), own.alias("text"))
    texts = papers.select("path", "text").unionByName(sources.select("path", "text"))
    return Q.migration_findings(papers, sources, texts, most=None)
