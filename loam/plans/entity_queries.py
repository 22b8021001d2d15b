"""Selection, joins and aggregation over the star tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import graph as G
from ..operators import joins as J
from ..operators import predicates as P
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators import sinks as K
from ..operators import windows as W
from ..sources.tables import table
from .registry import query



@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus = 'F' AND o_custkey <> 10")
def find_filter(spark: SparkSession, d: str) -> DataFrame:
    return P.find(table(spark, d, "orders"), [("o_totalprice", ">=150000"), ("o_orderstatus", "F"), ("o_custkey", "!=10")]).select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("""SELECT p_partkey, p_brand, tags FROM (SELECT *, p_brand || ',' || p_type AS tags FROM part) WHERE p_type = 'SMALL' AND p_size < 20""")
def find_list_member(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").withColumn("tags", F.array("p_brand", "p_type"))
    return P.find(df, [("tags", "SMALL"), ("p_size", "<20"), ("p_size", "!=1000")]).select("p_partkey", "p_brand", F.array_join("tags", ",").alias("tags"))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal / 10000 END AS confidence,
            CASE c_mktsegment WHEN 'BUILDING' THEN 'proposed' WHEN 'MACHINERY' THEN 'supported' ELSE 'challenged' END AS status FROM customer)
          SELECT c_custkey, confidence, status FROM c WHERE coalesce(confidence, 1.0) < 0.2 OR status IN ('proposed', 'weakly_supported')""")
def weak_entities(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("c_mktsegment") == "BUILDING", "proposed").when(F.col("c_mktsegment") == "MACHINERY", "supported").otherwise("challenged")
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") / 10000).alias("confidence"), status.alias("status"))
    return P.weak(c, "confidence", "status", 0.2)


@query("""SELECT c_custkey, coalesce(c_nationkey % 5 + 1, 3) AS priority FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def ready_entities(spark: SparkSession, d: str) -> DataFrame:
    linked = table(spark, d, "orders").filter("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array(F.min("o_orderkey").cast("string")).alias("linked_experiments"))
    status = F.when(F.col("c_mktsegment") != "FURNITURE", "proposed").otherwise("tested")
    c = table(spark, d, "customer").withColumn("status", status).withColumn("priority", F.col("c_nationkey") % 5 + 1).withColumn("_ord", F.col("c_custkey"))
    return P.ready_to_test(c.join(linked, "c_custkey", "left")).select("c_custkey", "priority")


@query("""SELECT o_orderkey, count(*) FILTER (l_returnflag = 'N') AS supporting, count(*) FILTER (l_returnflag = 'R') AS contradicting,
            CASE WHEN count(*) FILTER (l_returnflag = 'A') >= 2 THEN 'strong' WHEN count(l_orderkey) > 0 THEN 'moderate' ELSE 'weak' END AS net
          FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def evidence_trace(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of each claim (an order), counted by kind before the join; the net strength needs two strong pieces."""
    ev = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(F.col("l_returnflag") == x).alias(f"flag_{x}") for x in "NRA"], F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(ev, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    zero = [F.coalesce(f"flag_{x}", F.lit(0)) for x in "NRA"]
    net = F.when(zero[2] >= 2, "strong").when(F.coalesce("n", F.lit(0)) > 0, "moderate").otherwise("weak")
    return o.select("o_orderkey", zero[0].alias("supporting"), zero[1].alias("contradicting"), net.alias("net"))


@query("SELECT c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def orphans_anti(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("from_id"), F.col("o_custkey").alias("to_id"))
    return J.orphans(table(spark, d, "customer").select(F.col("c_custkey").alias("node")), edges)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)
          AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def prune_dangling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = table(spark, d, "part").filter("p_size < 25").select(F.col("p_partkey").alias("node"))
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return J.prune_dangling(e, p, s, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("""SELECT node, count(*) AS degree FROM (SELECT 'part/' || l_partkey AS node FROM lineitem UNION ALL SELECT 'supplier/' || l_suppkey FROM lineitem)
          GROUP BY node ORDER BY degree DESC, node LIMIT 15""")
def degree_rank(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat(F.lit("part/"), F.col("l_partkey")).alias("from_id"), F.concat(F.lit("supplier/"), F.col("l_suppkey")).alias("to_id"))
    return W.top_k(A.degree(e), 15, F.col("degree").desc(), F.col("node"))


def line_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lines as edges of a small graph with all registered types, some of them wrong on purpose."""
    types = [*model.SYMMETRIC_TYPES, "builds_on", "uses_concept", "supports", "extends", "nonsense"]
    t = F.get(F.array(*map(F.lit, types)), (F.col("l_partkey") % len(types)).cast("int"))
    to = F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("concepts/n"), F.col("l_suppkey") % 40)).otherwise(F.concat(F.lit("papers/n"), F.col("l_suppkey") % 40))
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("papers/n"), F.col("l_partkey") % 40).alias("from_id"), to.alias("to_id"), t.alias("type"),
        F.when(F.col("l_linenumber") != 3, F.col("l_returnflag")).alias("evidence"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        F.when(F.col("l_linestatus") == "O", "high").when(F.col("l_returnflag") == "A", "sure").alias("confidence"),
        F.when(F.col("l_linenumber") == 1, F.lit(True)).alias("symmetric"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("_ord"),
    )


_EDGES_SQL = """e AS (
  SELECT 'papers/n' || (l_partkey % 40) AS from_id, CASE WHEN l_suppkey % 3 = 0 THEN 'concepts/n' ELSE 'papers/n' END || (l_suppkey % 40) AS to_id,
    (['same_problem_as','similar_method_to','complementary_to','builds_on','uses_concept','supports','extends','nonsense'])[1 + l_partkey % 8] AS type,
    CASE WHEN l_linenumber <> 3 THEN l_returnflag END AS evidence, CASE WHEN l_linestatus = 'O' THEN 'high' WHEN l_returnflag = 'A' THEN 'sure' END AS confidence,
    l_linenumber = 1 AS flagged, l_orderkey * 10 + l_linenumber AS ord FROM lineitem
), k AS (
  SELECT *, type IN ('same_problem_as','similar_method_to','complementary_to') AS sym, to_id LIKE 'papers/%' AS pp FROM e
)"""


@query(f"""WITH {_EDGES_SQL} SELECT CASE WHEN sym THEN least(from_id, to_id) ELSE from_id END AS from_id, CASE WHEN sym THEN greatest(from_id, to_id) ELSE to_id END AS to_id,
           type, min(ord) AS first_ord FROM k GROUP BY ALL""")
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    e = line_edges(spark, d)
    sym = F.col("type").isin(model.SYMMETRIC_TYPES)
    return K.dedup_edges(e, sym).select("from_id", "to_id", "type", F.col("_ord").alias("first_ord"))


@query(f"""WITH {_EDGES_SQL}, c AS (
  SELECT ord, unnest([
    CASE WHEN type = 'nonsense' THEN 'yellow:unknown-edge-type' END,
    CASE WHEN (sym OR type = 'builds_on') AND NOT pp OR type = 'uses_concept' AND pp THEN 'yellow:invalid-edge-endpoint' END,
    CASE WHEN (sym OR type = 'builds_on') AND from_id = to_id THEN 'yellow:self-edge' END,
    CASE WHEN sym AND NOT flagged THEN 'yellow:missing-symmetric-marker' END,
    CASE WHEN sym AND from_id > to_id THEN 'yellow:noncanonical-symmetric-edge' END,
    CASE WHEN (sym OR type IN ('builds_on','uses_concept')) AND confidence IS NULL THEN 'yellow:missing-edge-confidence' END,
    CASE WHEN (sym OR type IN ('builds_on','uses_concept')) AND confidence = 'sure' THEN 'yellow:invalid-edge-confidence' END,
    CASE WHEN (sym OR type IN ('builds_on','uses_concept')) AND evidence IS NULL THEN 'yellow:missing-edge-evidence' END,
    CASE WHEN type IN ('supports','extends') THEN 'yellow:legacy-edge-type' END]) AS x FROM k)
  SELECT ord, split_part(x, ':', 1) AS level, split_part(x, ':', 2) AS category FROM c WHERE x IS NOT NULL""")
def edge_lint(spark: SparkSession, d: str) -> DataFrame:
    return Q.edge_findings(line_edges(spark, d), model.edge_types_table(spark)).select(F.col("_ord").alias("ord"), "level", "category")


@query(f"""WITH {_EDGES_SQL}, g AS (SELECT CASE WHEN sym THEN least(from_id, to_id) ELSE from_id END AS a, CASE WHEN sym THEN greatest(from_id, to_id) ELSE to_id END AS b, *,
    type = 'nonsense' OR (sym OR type = 'builds_on') AND (NOT pp OR from_id = to_id) OR type = 'uses_concept' AND pp
    OR (sym OR type IN ('builds_on','uses_concept')) AND (coalesce(confidence, '') <> 'high' OR evidence IS NULL) AS bad FROM k),
  m AS (SELECT *, ord > min(ord) OVER (PARTITION BY a, b, type) AS later FROM g)
  SELECT CASE WHEN bad THEN 'error' WHEN later THEN 'existed' ELSE 'added' END AS status, count(*) AS n FROM m GROUP BY 1""")
def edge_insert(spark: SparkSession, d: str) -> DataFrame:
    """A batch with bad rows: what each row would be; the table stays as it is."""
    e = line_edges(spark, d)
    _, status = K.insert_edges(e.limit(0), e, model.edge_types_table(spark))
    return A.counts_by(status, "status")


@query(f"""WITH {_EDGES_SQL}, d AS (SELECT from_id, to_id, ord, 'cites' AS type FROM e WHERE to_id LIKE 'papers/%') SELECT ord, 'duplicate-citation' AS category FROM (
    SELECT ord, row_number() OVER (PARTITION BY from_id, to_id ORDER BY ord) AS rn FROM d) WHERE rn > 1
  UNION ALL SELECT ord, 'self-citation' FROM d WHERE from_id = to_id""")
def citation_lint(spark: SparkSession, d: str) -> DataFrame:
    c = line_edges(spark, d).filter(F.col("to_id").startswith("papers/")).select("from_id", "to_id", F.lit("cites").alias("type"), F.lit("manual").alias("source"), "date", "_ord")
    return Q.citation_findings(c).select(F.col("_ord").alias("ord"), "category")


@query(f"""WITH {_EDGES_SQL}, b AS (SELECT from_id, to_id, type, min(ord) AS ord FROM e WHERE type = 'supports' GROUP BY 1, 2, 3),
  r AS (SELECT CASE from_id WHEN 'papers/n5' THEN 'papers/m5' WHEN 'papers/n13' THEN 'papers/m5' ELSE from_id END AS from_id,
               CASE to_id WHEN 'papers/n5' THEN 'papers/m5' WHEN 'papers/n13' THEN 'papers/m5' ELSE to_id END AS to_id, type FROM b)
  SELECT DISTINCT from_id, to_id, type FROM r""")
def node_remap(spark: SparkSession, d: str) -> DataFrame:
    e = line_edges(spark, d).filter("type = 'supports'").select("from_id", "to_id", "type", "_ord")
    first = e.groupBy("from_id", "to_id", "type").agg(F.min("_ord").alias("_ord"), F.lit("2024-01-01").alias("date"), F.lit("x").alias("evidence"))
    mapping = spark.createDataFrame([("papers/n5", "papers/m5"), ("papers/n13", "papers/m5")], "old string, new string")
    return K.remap_nodes(first, mapping, F.lit(False)).select("from_id", "to_id", "type")


@query("""WITH t AS (SELECT p_partkey, p_brand || '-' || p_size AS target FROM part), n AS (SELECT target, count(*) AS c FROM t GROUP BY target)
          SELECT p_partkey, CASE WHEN c > 1 THEN target || '-old' ELSE target END AS target FROM t JOIN n USING (target)""")
def collision_suffix(spark: SparkSession, d: str) -> DataFrame:
    return W.suffix_collisions(table(spark, d, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_size").alias("target")), "target").select("p_partkey", "target")


def place_tree(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.col("n_name").alias("name"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.col("c_name").alias("name"))
    return r.union(n).union(c)


_TREE_SQL = """t AS (SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer)"""


@query(f"""WITH RECURSIVE {_TREE_SQL}, e AS (SELECT id AS a, parent AS b, 'outgoing' AS via FROM t WHERE parent IS NOT NULL UNION ALL SELECT parent, id, 'incoming' FROM t WHERE parent IS NOT NULL),
  w(node, depth, via) AS (SELECT 'r1', 0, '' UNION SELECT e.b, w.depth + 1, e.via FROM w JOIN e ON e.a = w.node WHERE w.depth < 2)
  SELECT node, min(depth)::INT AS depth, arg_min(via, depth) AS via FROM w GROUP BY node HAVING node <> 'r1'""")
def neighbors_bfs(spark: SparkSession, d: str) -> DataFrame:
    e = place_tree(spark, d).filter("parent is not null").select(F.col("id").alias("from_id"), F.col("parent").alias("to_id"), F.lit("in").alias("type"), F.lit(False).alias("symmetric"), F.xxhash64("id").alias("_ord"))
    return G.neighbors(e, spark.createDataFrame([("r1",)], "node string"), depth=2).select("node", "depth", "via")


@query(f"""WITH {_TREE_SQL} SELECT a.id, 1 AS depth FROM t a WHERE a.parent = 'r2' UNION ALL SELECT b.id, 2 FROM t a JOIN t b ON b.parent = a.id WHERE a.parent = 'r2'""")
def closure_down(spark: SparkSession, d: str) -> DataFrame:
    return G.descendants(spark, place_tree(spark, d), spark.createDataFrame([("r2",)], "id string"))


@query(f"""WITH {_TREE_SQL} SELECT n.id, r.name || '/' || n.name AS path FROM t n JOIN t r ON n.parent = r.id WHERE n.name = (SELECT n_name FROM nation WHERE n_nationkey = 3)""")
def closure_path(spark: SparkSession, d: str) -> DataFrame:
    name = table(spark, d, "nation").filter("n_nationkey = 3").first()["n_name"]
    return G.path_suffix(G.root_paths(spark, place_tree(spark, d)), [name]).select("id", F.array_join("path", "/").alias("path"))


@query(f"""WITH {_TREE_SQL} SELECT id, depth, orphan, row_number() OVER (ORDER BY k) AS place FROM (
    SELECT r.id, 0 AS depth, false AS orphan, r.name AS k FROM t r WHERE r.id LIKE 'r%' UNION ALL
    SELECT n.id, 1, false, r.name || chr(1) || n.name FROM t n JOIN t r ON n.parent = r.id WHERE n.id LIKE 'n%')""")
def tree_listing(spark: SparkSession, d: str) -> DataFrame:
    """Depth-first listing of regions and nations."""
    from pyspark.sql import Window

    t = G.tree_order(spark, place_tree(spark, d).filter(~F.col("id").startswith("c")))
    return t.select("id", "depth", "orphan", F.row_number().over(Window.orderBy("place")).alias("place"))  # 30 rows: a listing


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS suppliers, (SELECT count(*) FROM part) AS parts,
          (SELECT count(*) FROM orders) AS edges, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS done""")
def stats_counts(spark: SparkSession, d: str) -> DataFrame:
    one = None
    for name, df in (("customers", table(spark, d, "customer")), ("suppliers", table(spark, d, "supplier")), ("parts", table(spark, d, "part"))):
        c = df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))
        one = c if one is None else one.join(c, "_k")
    o = table(spark, d, "orders").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("o_orderstatus") == "F").alias("done")).withColumn("_k", F.lit(1))
    return one.join(o, "_k").drop("_k")


@query("""WITH s AS (SELECT (SELECT count(*) FROM region) AS papers, (SELECT count(*) FROM nation) AS claims, (SELECT count(*) FROM orders WHERE o_custkey < 5) AS edges,
            (SELECT count(*) FROM supplier WHERE s_acctbal < 0) AS done), n AS (SELECT *, papers + claims AS entities FROM s)
          SELECT papers, claims, edges, least(1.0::DOUBLE, edges / greatest(1, entities * (entities - 1))) AS graph_density,
            round_even(least(1.0::DOUBLE, papers / 20 * 0.3::DOUBLE + claims / 40 * 0.3::DOUBLE + done / 5 * 0.2::DOUBLE + edges / 50 * 0.2::DOUBLE), 4) AS coverage_score,
            CASE WHEN papers >= 20 AND claims >= 40 THEN 'hot' WHEN papers >= 5 AND claims >= 10 THEN 'warm' ELSE 'cold' END AS level FROM n""")
def maturity(spark: SparkSession, d: str) -> DataFrame:
    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(1))

    c = one("papers", table(spark, d, "region")).join(one("claims", table(spark, d, "nation")), "_k").join(one("edges", table(spark, d, "orders").filter("o_custkey < 5")), "_k")
    c = c.join(one("experiments_done", table(spark, d, "supplier").filter("s_acctbal < 0")), "_k").withColumns({"entities": F.col("papers") + F.col("claims"), "has_experiment_evidence": F.lit(True)})
    return A.maturity(c).select("papers", "claims", "edges", "graph_density", S.half_even(F.col("coverage_score"), 4).alias("coverage_score"), "level")


@query("""SELECT 'region' AS kind, r_regionkey::VARCHAR AS slug, r_name AS title FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR, n_name FROM nation
          UNION ALL SELECT 'supplier', s_suppkey::VARCHAR, s_name FROM supplier UNION ALL SELECT 'part', p_partkey::VARCHAR, p_name FROM part""")
def catalog_union(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for kind, key, title in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"), ("supplier", "s_suppkey", "s_name"), ("part", "p_partkey", "p_name")):
        one = A.catalog(table(spark, d, kind), kind, key, [title]).select("kind", "slug", F.get_json_object("fields", f"$.{title}").alias("title"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH l AS (SELECT DISTINCT p_brand AS topic, unnest([lower(p_type), p_name]) AS w0 FROM part WHERE p_size = 1), lt AS (SELECT DISTINCT topic, unnest(string_split(w0, ' ')) AS w FROM l),
          r AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)
          SELECT topic, p_partkey, count(*) AS common FROM lt JOIN r USING (w) GROUP BY ALL""")
def topic_overlap(spark: SparkSession, d: str) -> DataFrame:
    """All parts: each name is held against the topics once, and its parts take the result."""
    p = table(spark, d, "part")
    names = p.select("p_name").distinct().withColumn("pt", X.words("p_name"))
    return J.overlap_join(_topics(p), names, "topic", "p_name", "tt", "pt").join(p.select("p_partkey", "p_name"), "p_name").select("topic", "p_partkey", "common")


def _topics(p: DataFrame) -> DataFrame:
    return p.filter("p_size = 1").groupBy(F.col("p_brand").alias("topic")).agg(F.array_distinct(F.flatten(F.collect_set(F.concat(F.array(F.lower("p_type")), X.words("p_name"))))).alias("tt"))


_PHRASE = """CASE WHEN na = nb THEN 1.0 WHEN (contains(nb, na) OR contains(na, nb)) AND len(string_split(CASE WHEN length(na) < length(nb) THEN na ELSE nb END, ' ')) >= 2 THEN 0.85
  WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0 ELSE j END"""


@query(f"""WITH n AS (SELECT DISTINCT p_name AS name, p_name AS na FROM part), e AS (SELECT s_suppkey AS ord, (SELECT p_name FROM part WHERE p_partkey = s_suppkey % 200) || ' ' || lower(s_name) AS label FROM supplier),
  e2 AS (SELECT *, trim(regexp_replace(regexp_replace(label, '[^a-z0-9 ]', ' ', 'g'), ' +', ' ', 'g')) AS nb FROM e),
  t AS (SELECT *, list_filter(string_split(na, ' '), lambda x: length(x) >= 3) AS ta, list_distinct(list_filter(string_split(nb, ' '), lambda x: length(x) >= 3)) AS tb FROM n, e2),
  s AS (SELECT *, len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) AS j0 FROM t),
  f AS (SELECT *, CASE WHEN j0 >= 0.7 THEN j0 WHEN j0 >= 0.4 THEN 0.4 + (j0 - 0.4) * 0.5 ELSE 0.0 END AS j FROM s)
  SELECT name, ord, round_even(({_PHRASE})::DOUBLE, 6) AS score FROM f WHERE ({_PHRASE}) >= 0.4""")
def similar_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return _similar_names(p, p, table(spark, d, "supplier"))


def _similar_names(candidates: DataFrame, p: DataFrame, s: DataFrame) -> DataFrame:
    names = candidates.select(F.col("p_name").alias("name")).distinct()
    ent = s.join(p.select(F.col("p_partkey").alias("k"), "p_name"), F.col("s_suppkey") % 200 == F.col("k")).select(F.col("s_suppkey").alias("entity"), F.col("s_suppkey").alias("_ord"), F.concat_ws(" ", "p_name", F.lower("s_name")).alias("label"))
    return J.similar_names(names, ent).select("name", F.col("_ord").alias("ord"), S.half_even(F.col("score"), 6).alias("score"))


@query("""WITH c AS (SELECT s_suppkey AS id, 'models improve results on ' || lower(s_name) AS title, s_nationkey AS tag FROM supplier),
  q AS (SELECT *, CASE WHEN title = 'our method outperforms result' THEN 1 ELSE 0 END AS x, list_concat(['model','beat','result'], list_filter(string_split(trim(regexp_replace(lower(replace(title, 'models improve results on ', '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 3)) AS tb FROM c),
  j AS (SELECT *, len(list_intersect(['method','beat','result'], tb)) / len(list_distinct(list_concat(['method','beat','result'], tb))) AS j, (tag % 3 = 0)::INT AS shared FROM q),
  r AS (SELECT *, CASE WHEN j >= 0.7 THEN j WHEN j >= CASE WHEN shared > 0 THEN 0.30 ELSE 0.45 END THEN 0.40 + (j - CASE WHEN shared > 0 THEN 0.30 ELSE 0.45 END) * 0.6 ELSE 0.0 END AS raw FROM j)
  SELECT id, round_even((CASE WHEN raw < 0.40 THEN 0.0 WHEN shared > 0 AND raw < 1 THEN least(raw + least(0.05 + 0.02 * shared, 0.10), 0.95) ELSE raw END)::DOUBLE, 6) AS score FROM r""")
def similar_claims(spark: SparkSession, d: str) -> DataFrame:
    """One candidate claim against all existing ones; shared tags lower the floor and add a boost."""
    cand = "Our method outperforms result"
    title = F.concat(F.lit("models improve results on "), F.lower("s_name"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), X.normalize_text(title).alias("nb"), X.claim_tokens(title).alias("tb"), (F.col("s_nationkey") % 3 == 0).cast("int").alias("shared"))
    c = c.withColumns({"na": X.normalize_text(F.lit(cand)), "ta": X.claim_tokens(F.lit(cand))})
    return c.select("id", S.half_even(S.claim_score(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb"), F.col("shared")), 6).alias("score"))


@query("""WITH l AS (SELECT doc_id, left(text, 24) AS k1, left(text, 8) AS k2 FROM documents WHERE source = 'src0'), r AS (SELECT doc_id, left(text, 24) AS k1, left(text, 8) AS k2 FROM documents WHERE source <> 'src0'),
  a AS (SELECT k1, count(*) AS n, min(doc_id) AS m FROM r WHERE k1 <> '' GROUP BY k1), b AS (SELECT k2, count(*) AS n, min(doc_id) AS m FROM r WHERE k2 <> '' GROUP BY k2)
  SELECT l.doc_id, CASE WHEN a.n = 1 THEN a.m WHEN a.n IS NULL AND b.n = 1 THEN b.m END AS matched,
    CASE WHEN a.n = 1 THEN 'exact' WHEN a.n > 1 THEN 'ambiguous' WHEN b.n = 1 THEN 'prefix' ELSE 'unresolved' END AS level FROM l LEFT JOIN a USING (k1) LEFT JOIN b USING (k2)""")
def cascade_match(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "source", F.left("text", F.lit(24)).alias("k1"), F.left("text", F.lit(8)).alias("k2"))
    left, right = t.filter("source = 'src0'"), t.filter("source <> 'src0'").withColumnRenamed("doc_id", "matched")
    return J.cascade(left, right, "doc_id", "matched", [("exact", F.col("k1"), F.col("k1"), True), ("prefix", F.col("k2"), F.col("k2"), False)])


@query("""WITH c AS (SELECT 'user ' || user_id AS title, event_type, value::BIGINT AS v, event_id, event_type = 'purchase' AS e, CASE WHEN event_id % 3 = 0 THEN props END AS abstract FROM events)
  SELECT 'title:' || title AS key, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS sources, max(v) AS citations, bool_or(e) AS influential_edge, min(event_id) AS first_ord,
    arg_min(abstract, event_id) FILTER (abstract IS NOT NULL) AS abstract FROM c GROUP BY title""")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    e = table(spark, d, "events")
    c = e.select(
        none.alias("id"), none.alias("doi"), F.concat(F.lit("User "), F.col("user_id")).alias("title"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("abstract"),
        none.alias("tldr"), none.alias("venue"), none.alias("url"), F.lit(None).cast("int").alias("year"), F.rint("value").cast("long").alias("citations"), F.lit(0).cast("long").alias("influential"),
        F.lit(0).cast("long").alias("max_h_index"), empty.alias("authors"), empty.alias("fields"), F.array("event_type").alias("sources"), empty.alias("anchors"), empty.alias("providers"), empty.alias("queries"),
        (F.col("event_type") == "purchase").alias("influential_edge"), F.col("event_id").alias("_ord"),
    )
    return A.merge_candidates(c).select("key", F.array_join(F.array_sort("sources"), ",").alias("sources"), "citations", "influential_edge", F.col("_ord").alias("first_ord"), "abstract")


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE year(o_orderdate)::INT END AS year, o_custkey AS citations FROM orders)
          SELECT * FROM c WHERE coalesce(NOT (year < 1996 AND citations <= 100), true) AND year >= 1994""")
def gates_old_recent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.year("o_orderdate")).alias("year"), F.col("o_custkey").alias("citations"))
    return P.since_year(c.filter(P.not_old_and_rarely_cited(F.col("year"), F.col("citations"), 1996)), "year", 1994)


@query("""WITH u AS (SELECT user_id, count(*) AS citations, count(*) FILTER (event_type = 'purchase') AS influential, count(DISTINCT event_type) AS channels, max(value)::INT AS h, (2010 + user_id % 15)::INT AS year FROM events GROUP BY user_id),
  s AS (SELECT *, 0.45::DOUBLE * (0.7::DOUBLE * ln(1 + influential) / ln(51) + 0.3::DOUBLE * ln(1 + citations) / ln(1001))
    + 0.25::DOUBLE * CASE WHEN 2024 - year <= 1 THEN 1.0 WHEN 2024 - year <= 3 THEN 0.85 WHEN 2024 - year <= 6 THEN 0.6 WHEN 2024 - year <= 10 THEN 0.4 ELSE 0.25 END
    + 0.15::DOUBLE * least(1.0::DOUBLE, h / 60) + 0.15::DOUBLE * least(1.0::DOUBLE, 0.4::DOUBLE * channels) AS score FROM u)
  SELECT user_id, round_even(score, 6) AS score, citations FROM s ORDER BY round_even(score, 6) DESC, user_id LIMIT 12""")
def rank_score(spark: SparkSession, d: str) -> DataFrame:
    """The shortlist: candidates aggregated once, scored by expressions, best 12."""
    e = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("citations"), F.count_if(F.col("event_type") == "purchase").alias("influential"), F.collect_set("event_type").alias("sources"), F.rint(F.max("value")).cast("int").alias("max_h_index")
    )
    scored = S.rank_score(e.withColumn("year", (2010 + F.col("user_id") % 15).cast("int")), 2024)
    out = scored.select("user_id", S.half_even(F.col("score"), 6).alias("score"), "citations")
    return W.top_k(out, 12, F.col("score").desc(), F.col("user_id"))


@query("""WITH l AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events),
  m(e, s) AS (VALUES ('view', 'planned'), ('click', 'running'), ('purchase', 'completed'), ('error', 'abandoned'), ('signup', 'planned')),
  j AS (SELECT a.s AS old_status, b.s AS new_status FROM l JOIN m a ON l.old = a.e JOIN m b ON l.event_type = b.e)
  SELECT old_status, new_status, CASE WHEN (old_status, new_status) IN (('planned', 'running'), ('running', 'abandoned')) THEN 'ok'
    WHEN (old_status, new_status) = ('running', 'completed') THEN 'needs key_result' ELSE 'not_allowed' END AS status, count(*) AS n FROM j GROUP BY ALL""")
def lifecycle_check(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    names = F.create_map(*[F.lit(x) for p in (("view", "planned"), ("click", "running"), ("purchase", "completed"), ("error", "abandoned"), ("signup", "planned")) for x in p])
    e = table(spark, d, "events").withColumn("old", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    c = e.filter("old is not null").select(F.lit("experiments").alias("kind"), names[F.col("old")].alias("old_status"), names[F.col("event_type")].alias("new_status"))
    return A.counts_by(P.allowed_transition(c, model.transitions_table(spark)), "old_status", "new_status", "status")


@query("""SELECT strftime(ts, '%Y-%m') || '-w' || ((day(ts) - 1) // 7 + 1) AS period, event_type AS skill, count(*) AS n FROM events GROUP BY ALL""")
def log_buckets(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "events").select("ts", F.concat_ws(" | ", "event_type", "props").alias("message"))
    return A.counts_by(K.log_rows(m), "period", "skill")


@query("""WITH f(field, fix) AS (VALUES ('k', false), ('status', true), ('tags', true)) SELECT event_id, 'Missing required field: ' || field AS message, fix AS fixable FROM events, f
          WHERE NOT list_contains(json_keys(props), field)""")
def missing_fields(spark: SparkSession, d: str) -> DataFrame:
    return _missing_fields(spark, table(spark, d, "events"))


def _missing_fields(spark: SparkSession, events: DataFrame) -> DataFrame:
    pages = events.select(F.lit("x").alias("kind"), F.col("event_id").alias("file"), F.json_object_keys("props").alias("present"))
    req = spark.createDataFrame([("x", 0, "k", None), ("x", 1, "status", "proposed"), ("x", 2, "tags", "[]")], "kind string, pos int, field string, default string")
    return Q.missing_fields(pages, req).select(F.col("file").alias("event_id"), "message", "fixable")


@query("SELECT event_id, 'status=' || event_type AS message FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def enum_check(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "events").select(F.col("event_id").alias("file"), F.lit("events").alias("kind"), F.lit("status").alias("field"), F.col("event_type").alias("value"))
    valid = spark.createDataFrame([("events", "status", v) for v in ("view", "click", "purchase")], "kind string, field string, value string")
    return Q.bad_values(cells, valid).select(F.col("file").alias("event_id"), "message")


@query("""SELECT c_custkey AS "itemID", c_name AS title, c_mktsegment AS segment FROM customer""")
def attribute_pivot(spark: SparkSession, d: str) -> DataFrame:
    """Customers taken apart into an attribute store and put together again."""
    c = table(spark, d, "customer")
    long = c.select(F.col("c_custkey").alias("itemID"), F.explode(F.map_from_arrays(F.array(F.lit(1), F.lit(2)), F.array("c_name", "c_mktsegment"))).alias("fieldID", "value"))
    data = long.select("itemID", "fieldID", F.xxhash64("value").alias("valueID"))
    values = long.select(F.xxhash64("value").alias("valueID"), "value").distinct()
    fields = spark.createDataFrame([(1, "title"), (2, "segment"), (3, "other")], "fieldID int, fieldName string")
    return J.attributes(c.select(F.col("c_custkey").alias("itemID")), data, values, fields, ["title", "segment"])


@query("""SELECT l_partkey AS "itemID", min(l_linenumber)::INT AS place FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 1)
          AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 7) GROUP BY l_partkey""")
def collection_members(spark: SparkSession, d: str) -> DataFrame:
    ci = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("collectionID"), F.col("l_partkey").alias("itemID"), F.col("l_linenumber").alias("orderIndex"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("itemID"), "p_size")
    cols = table(spark, d, "supplier").filter("s_nationkey = 1").select(F.col("s_suppkey").alias("collectionID"))
    return J.members(ci, p.select("itemID"), p.filter("p_size = 7").select("itemID"), cols).select("itemID", F.col("place.orderIndex").cast("int").alias("place"))


@query("""SELECT n_nationkey::VARCHAR AS id, n_name AS name, r_name AS parent_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation JOIN region ON n_regionkey = r_regionkey""")
def parent_names(spark: SparkSession, d: str) -> DataFrame:
    t = place_tree(spark, d)
    counts = table(spark, d, "customer").groupBy(F.concat(F.lit("n"), "c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return J.parent_names(t.filter(~F.col("id").startswith("c")), counts).filter("parent is not null").select(F.substring("id", 2, 10).alias("id"), "name", "parent_name", "n")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'collected' ELSE 'not collected' END AS status FROM orders""")
def library_status(spark: SparkSession, d: str) -> DataFrame:
    lib = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.lit("https://doi.org/10.1000/X"), "l_orderkey").alias("doi"), F.lit("").alias("title"))
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("10.1000/x"), "o_orderkey").alias("doi"), F.lit("").alias("title"))
    return J.library_status(o, lib).select("o_orderkey", "status")


@query("""WITH w AS (SELECT o_custkey AS item, 'c' || o_orderkey % 7 AS c FROM orders), h AS (SELECT DISTINCT o_custkey AS item, 'c' || o_orderkey % 7 AS c FROM orders WHERE o_orderstatus = 'F')
  SELECT item, count(DISTINCT c) - count(DISTINCT c) FILTER ((item, c) IN (SELECT item, c FROM h)) AS added, added > 0 AS changed FROM w GROUP BY item""")
def membership_upsert(spark: SparkSession, d: str) -> DataFrame:
    have, o = _memberships(spark, d)
    return K.upsert_all_membership(have, _wanted(o))[1]


def _memberships(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("item"), F.concat(F.lit("c"), F.col("o_orderkey") % 7).alias("collection"), "o_orderstatus")
    return o.filter("o_orderstatus = 'F'").select("item", "collection").distinct(), o


def _wanted(o: DataFrame) -> DataFrame:
    return o.groupBy("item").agg(F.collect_set("collection").alias("keys"))


@query("""SELECT user_id AS task, event_type AS item, CASE WHEN bool_or(value > 20) THEN 'completed' ELSE 'failed' END AS status FROM events GROUP BY ALL""")
def checkpoint_merge(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("task"), F.col("event_type").alias("item"), F.when(F.col("value") > 20, "completed").otherwise("failed").alias("status"), "event_id")
    return K.save_checkpoint(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS page, 'F' AS label, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing FROM
  (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b USING (o_custkey)
  WHERE greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) > 0""")
def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.lit("F").alias("label"), "o_orderstatus")
    need, have = (o.filter(F.col("o_orderstatus") == x).groupBy("page", "label").agg(F.count(F.lit(1)).alias("n")) for x in "FO")
    return Q.evidence_coverage(need, have)
