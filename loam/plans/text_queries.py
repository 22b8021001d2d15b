"""Text, scoring and quality operators over documents, pages and conversations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import predicates as P
from ..operators import quality as Q
from ..operators import scoring as S
from ..operators import windows as W
from ..sources import tables as T
from ..sources.tables import table
from .registry import query

TOPICS = ["thering of the tions", "verstehen und pfung", "nation les aux"]
CLASS_RULES = {
    "licence": [(r"\blicen[sc]e", 5), (r"apache|gnu", 2)],
    "contact": [(r"@[a-z]", 4), (r"\+[0-9]", 3)],
    "junk": [(r"\$\$\$", 6), (r"!! ", 4)],
    "rights": [(r"all rights reserved", 7)],
}


def _stem_sql(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, '{s}') AND length({x}) - {len(s)} >= 4 THEN left({x}, length({x}) - {len(s)}){' || chr(121)' if s == 'ies' else ''}" for s in X.TOPIC_SUFFIXES)
    return f"CASE {cases} ELSE {x} END"


def _tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in X.TOPIC_STOP_WORDS)
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z][a-z0-9-]+'), lambda x: x NOT IN ({stop})), lambda x: {_stem_sql('x')}))"


_REL = ", ".join(
    f"struct_pack(score := least(1.0::DOUBLE, 0.72::DOUBLE * len(list_intersect(q{i}, t)) / len(q{i}) + 0.28::DOUBLE * len(list_intersect(q{i}, b)) / len(q{i})), matches := len(list_intersect(q{i}, b)))"
    for i in range(len(TOPICS))
)


@query(f"""WITH q AS (SELECT {", ".join(f"{_tokens_sql(repr(t))} AS q{i}" for i, t in enumerate(TOPICS))}),
  d AS (SELECT doc_id, {_tokens_sql("left(text, 80)")} AS t, {_tokens_sql("text")} AS b0 FROM documents), e AS (SELECT doc_id, t, list_distinct(list_concat(t, b0)) AS b FROM d),
  r AS (SELECT doc_id, list_max([{_REL}]) AS m FROM e, q)
  SELECT doc_id, round_even(m.score, 6) AS score, m.matches AS matches FROM r WHERE m.matches >= 1 AND m.score >= 0.16""")
def topic_relevance(spark: SparkSession, d: str) -> DataFrame:
    """The first 80 characters stand for a title. A generator between the steps keeps each row's tokens and score made once:
    a filter is pushed below a projection together with what it names, but not below a generator."""
    tokens = F.struct(X.topic_tokens(F.left("text", F.lit(80))).alias("t"), X.topic_tokens("text").alias("b"))
    df = table(spark, d, "documents").select("doc_id", F.explode(F.array(tokens)).alias("x"))
    m = df.select("doc_id", F.explode(F.array(S.topic_relevance(F.col("x.t"), F.col("x.b"), [X.topic_tokens(F.lit(q)) for q in TOPICS]))).alias("m")).select("doc_id", "m.score", "m.matches")
    return m.filter(P.topic_gate(F.col("score"), F.col("matches"), TOPICS)).select("doc_id", S.half_even(F.col("score"), 6).alias("score"), F.col("matches").cast("long").alias("matches"))


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS h FROM documents)
  SELECT doc_id FROM d WHERE regexp_matches(h, '(^|[^\p{L}\p{N}\p{M}_])(the|les|der)($|[^\p{L}\p{N}\p{M}_])') AND regexp_matches(h, '(^|[^\p{L}\p{N}\p{M}_])(and|est|und)($|[^\p{L}\p{N}\p{M}_])')""")
def term_groups(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    return df.filter(P.term_groups(F.col("text"), ["the|les|der", "and|est|und"])).select("doc_id")


_CLASS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{c}' AS category, {i} AS pos, {' + '.join(f'CASE WHEN regexp_matches(h, {chr(39)}{p}{chr(39)}) THEN {w} ELSE 0 END' for p, w in ps)} AS score FROM d" for i, (c, ps) in enumerate(CLASS_RULES.items())
)


@query(f"""WITH d AS (SELECT doc_id, lower(text) AS h FROM documents), s AS ({_CLASS_SQL}), p AS (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM s WHERE score > 0)
  SELECT doc_id, category, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM p WHERE score >= greatest(4, top - 3)
  QUALIFY rank <= 5""")
def classify_rules(spark: SparkSession, d: str) -> DataFrame:
    s = S.classify(table(spark, d, "documents").select("doc_id", F.lower("text").alias("h")), F.col("h"), CLASS_RULES, ["doc_id"])
    return W.near_best(s, "doc_id", "score", "pos").select("doc_id", "category", "score", "rank")


@query("""WITH d AS (SELECT doc_id, lower(left(text, 5000)) AS t, quality FROM documents LEFT JOIN labels USING (doc_id)),
  s AS (SELECT doc_id, 5 * (contains(t, 'license'))::INT + 4 * (contains(t, 'tion'))::INT + 3 * (contains(t, 'the '))::INT + 2 * (contains(t, '@'))::INT + 3 * coalesce((quality = 1)::INT, 0) AS score,
    concat_ws(', ', CASE WHEN contains(t, 'license') THEN 'license' END, CASE WHEN contains(t, 'tion') THEN 'tion' END, CASE WHEN contains(t, 'the ') THEN 'the' END, CASE WHEN contains(t, '@') THEN 'contact' END, CASE WHEN quality = 1 THEN 'quality' END) AS reasons FROM d)
  SELECT doc_id, score, CASE WHEN score >= 12 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS priority, reasons FROM s WHERE score >= 4 ORDER BY score DESC, doc_id LIMIT 200""")
def promote_score(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").withColumn("t", F.lower(F.left("text", F.lit(5000))))
    t = F.col("t")
    score, reasons = A.weighted_sum([("license", t.contains("license"), 5), ("tion", t.contains("tion"), 4), ("the", t.contains("the "), 3), ("contact", t.contains("@"), 2), ("quality", F.col("quality") == 1, 3)])
    out = df.select("doc_id", score.alias("score"), reasons.alias("reasons")).filter("score >= 4")
    out = out.withColumn("priority", F.when(F.col("score") >= 12, "high").when(F.col("score") >= 8, "medium").otherwise("low"))
    return W.top_k(out, 200, F.col("score").desc(), F.col("doc_id"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS value, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents),
  r AS (SELECT *, sum((regexp_matches(value, '^[A-Z][a-z]'))::INT) OVER (PARTITION BY doc_id ORDER BY line) AS record FROM l)
  SELECT doc_id, record::BIGINT AS record, count(*) AS n_lines FROM r GROUP BY ALL""")
def section_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return A.counts_by(W.group_records(lines, ["doc_id"], "line", F.col("value").rlike("^[A-Z][a-z]")), "doc_id", "record").withColumnRenamed("n", "n_lines")


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS target FROM pages)
  SELECT DISTINCT page_id, target FROM l WHERE target NOT IN (SELECT url FROM pages)""")
def link_extract_broken(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    links = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1))).alias("target")).distinct()
    return links.join(p.select(F.col("url").alias("target")), "target", "left_anti").select("page_id", "target")


@query(r"""SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM pages)""")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.clean_markup("html").alias("t")).select("page_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def html_unescape(spark: SparkSession, d: str) -> DataFrame:
    """Text of pages with entities decoded (no SQL form)."""
    from ..functions.udfs import unescape

    return table(spark, d, "pages").select("page_id", F.md5(unescape(X.clean_markup("html"))).alias("digest"))


@query(r"""WITH q AS (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS q FROM benchmark), t AS (SELECT trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM documents)
  SELECT item_id, EXISTS (SELECT 1 FROM t WHERE contains(t.t, q.q)) AS grounded FROM q""")
def quote_grounding(spark: SparkSession, d: str) -> DataFrame:
    return _quote_grounding(spark, d, F.col("text"))


def _quote_grounding(spark: SparkSession, d: str, quote: Column) -> DataFrame:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), quote.alias("quote"))
    s = table(spark, d, "documents").select(F.col("doc_id").alias("sid"), "text")
    return J.quote_grounding(q, s).select(F.col("qid").alias("item_id"), "grounded")


@query(r"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  p AS (SELECT doc_id, unnest(list_transform(ls, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))) AS line, unnest(range(len(ls))) AS i FROM l),
  s AS (SELECT *, (line = '' OR regexp_matches(line, '^#{1,6} .') OR regexp_matches(lower(rtrim(line, ':')), '^(abstract|keywords|article info|introduction|background|methods?|materials and methods|theory|results|results and discussion|discussion|conclusions?|summary|references|bibliography|literature cited|acknowledge?ments|funding|data availability|appendix|supplementary material|supplementary information)$')) AS stop FROM p),
  g AS (SELECT *, sum(stop::INT) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM s), b AS (SELECT doc_id, block, string_agg(line, ' ' ORDER BY i) AS para, min(i) AS i FROM g WHERE NOT stop GROUP BY ALL),
  d AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, para ORDER BY i) AS k FROM b WHERE length(para) >= 180 AND NOT regexp_matches(para, '[$|<#]')),
  r AS (SELECT doc_id, 'empty-source' AS rule, (NOT regexp_matches(text, '\S'))::BIGINT AS n FROM l UNION ALL SELECT doc_id, 'missing-character', len(regexp_extract_all(text, '\?{2,}|\x{fffd}')) FROM l
    UNION ALL SELECT doc_id, 'control-character', len(regexp_extract_all(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) FROM l
    UNION ALL SELECT doc_id, 'abstract-not-located', (NOT regexp_matches(text, '(?im)^\s*(#{1,6}\s+)?(abstract|摘要)[:：]*\s*$'))::BIGINT FROM l
    UNION ALL SELECT doc_id, 'repeated-paragraph', count(*) FILTER (k > 1) FROM d GROUP BY doc_id)
  SELECT rule, count(*) AS files, sum(n)::BIGINT AS places FROM r WHERE n > 0 GROUP BY 1""")
def source_quality(spark: SparkSession, d: str) -> DataFrame:
    """Screening of whole texts by the rules that have an SQL form; ``source_screen`` has all of them."""
    names = ["empty-source", "missing-character", "control-character", "abstract-not-located", "repeated-paragraph"]
    f = Q.counted_findings(Q.text_findings(table(spark, d, "documents"), "doc_id", "text").filter(F.col("rule").isin(names)), "doc_id")
    return f.groupBy("rule").agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("places"))


def source_screen(spark: SparkSession, d: str) -> DataFrame:
    """All sixteen screening rules over whole texts, and each text's status (state machines: no SQL form)."""
    docs = table(spark, d, "documents")
    return Q.scan_status(Q.text_findings(docs, "doc_id", "text"), "doc_id", docs)


def math_quality(spark: SparkSession, d: str) -> DataFrame:
    """Math balance outside code (a state machine: no SQL form)."""
    from ..functions.markdown import math_rules

    f = table(spark, d, "documents").select("doc_id", F.explode(math_rules("text")).alias("rule"))
    return A.counts_by(f, "rule")


@query(r"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents),
  n AS (SELECT doc_id, place, trim(regexp_replace(raw, '[ \t\r\f\v]+', ' ', 'g')) AS p FROM p), l AS (SELECT * FROM n WHERE length(p) >= 40 AND NOT regexp_matches(p, '[$|<#]')),
  f AS (SELECT *, min(place) OVER (PARTITION BY doc_id, p) AS first_place FROM l) SELECT doc_id, place::INT AS place, first_place::INT AS first_place FROM f WHERE place > first_place""")
def repeated_paragraph(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    # each line is a paragraph here; empty lines vanish with the split, so places are counted on the lines themselves
    lines = df.select("doc_id", F.regexp_replace("text", "\n\n", "\x01").alias("t")).select("doc_id", F.replace("t", F.lit("\x01"), F.lit("\n \n")).alias("text"))
    return Q.repeated_paragraphs(lines, "doc_id", "text", least=40).select("doc_id", "place", "first_place")


@query("""SELECT sha256(text) AS sha, max(n_chars)::BIGINT AS importance, count(*) AS members, min(doc_id) AS first_member FROM documents GROUP BY 1""")
def content_jobs(spark: SparkSession, d: str) -> DataFrame:
    return A.content_jobs(table(spark, d, "documents"), F.col("text"), F.col("n_chars").cast("long"), "doc_id")


@query("""WITH g AS (SELECT sha256(text) AS sha, max(n_chars) AS importance, min(doc_id) AS m FROM documents GROUP BY 1) SELECT m AS first_member, row_number() OVER (ORDER BY importance DESC, m) AS rank FROM g""")
def job_ranks(spark: SparkSession, d: str) -> DataFrame:
    jobs = A.content_jobs(table(spark, d, "documents"), F.col("text"), F.col("n_chars").cast("long"), "doc_id")
    return W.dense_ordinal(jobs, [F.col("importance").desc(), F.col("first_member")], bins=8).select("first_member", F.col("rank").cast("long").alias("rank"))


@query("""WITH s AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents), o AS (SELECT *, min(e) FILTER (e > 20000) OVER (PARTITION BY source) AS over FROM s)
  SELECT source, doc_id, CASE WHEN e <= 20000 THEN n_chars ELSE 20000 - (e - n_chars) END::BIGINT AS taken FROM o WHERE (over IS NULL OR e <= over) AND (e <= 20000 OR 20000 - (e - n_chars) > 100)""")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return W.budget(df, ["source"], [F.col("doc_id")], F.col("n_chars"), F.lit(20000)).select("source", "doc_id", F.col("taken").cast("long").alias("taken"))


@query(r"""SELECT conv_id, turn, md5(array_to_string(list_filter(string_split(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '), lambda x: x <> ''), ' ')) AS digest FROM conversations""")
def inverted_index_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts taken apart into word -> positions and put together again."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode_outer(X.words("text")).alias("pos", "word"))
    index = w.groupBy("conv_id", "turn", "word").agg(F.collect_list("pos").alias("at")).groupBy("conv_id", "turn").agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "at")))).alias("index"))
    return index.select("conv_id", "turn", F.md5(X.inverted_index_text("index")).alias("digest"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_NORM = r"list_filter(string_split(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, text AS t FROM documents), w AS (SELECT doc_id, {_NORM} AS w FROM d), k AS (SELECT *, list_filter(w, lambda x: x NOT IN ({_STOP}) AND length(x) > 1) AS k FROM w)
  SELECT doc_id, array_to_string(w, ' ') AS norm, CASE WHEN len(k) > 0 THEN array_to_string(k[1:6], '-') WHEN len(w) > 0 THEN array_to_string(w[1:6], '-') ELSE 'untitled' END AS slug FROM k""")
def slug_keys(spark: SparkSession, d: str) -> DataFrame:
    return _slug_keys(spark, d, F.col("text"))


def _slug_keys(spark: SparkSession, d: str, t: Column) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.normalize_text(t).alias("norm")).select("doc_id", "norm", X.slug_of(F.col("norm")).alias("slug"))


def slug_keys_unicode(spark: SparkSession, d: str) -> DataFrame:
    """Keys with accents folded (Unicode normalization has no SQL form)."""
    from ..functions.udfs import nfkc_key, nfkd_ascii

    return table(spark, d, "documents").select("doc_id", X.slug_part(nfkd_ascii("text")).alias("part"), nfkc_key("text").alias("key"))


@query(f"""WITH d AS (SELECT doc_id, text AS t, source, lang FROM documents) SELECT doc_id, CASE WHEN source = 'src1' THEN regexp_replace(lang || ':' || doc_id, '[^A-Za-z0-9_.+-]+', '', 'g')
    ELSE 'smith_' || (1990 + doc_id % 30) || CASE WHEN len(w2) > 0 THEN '_' || array_to_string(w2[1:3], '-') ELSE '' END END AS slug FROM (SELECT *, list_filter({_NORM}, lambda x: length(x) >= 2) AS w2 FROM d)""")
def paper_slugs(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "documents")
    key = F.when(F.col("source") == "src1", F.concat_ws(":", "lang", "doc_id")).otherwise("")
    return df.select("doc_id", X.paper_slug("text", key, F.lit("Smith, Ann and Lee, Bo"), F.concat(F.lit("c. "), 1990 + F.col("doc_id") % 30)).alias("slug"))


@query(r"""SELECT doc_id, regexp_matches(t, '[0-9]') AND (regexp_matches(t, '[_-]') OR len(list_filter(string_split(regexp_replace(t, '[-_ \t\n\r\f\v]+', ' ', 'g'), ' '), lambda x: x <> '')) <= 3) OR regexp_matches(t, '[/\\]') OR ends_with(lower(t), '.pdf') AS filename_like,
    regexp_matches(lower(t), '^10\.[0-9]{4,9}/[^ \t\n\r\f\v]+$') AS doi_like FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '10.1234/abc' || doc_id WHEN 1 THEN text WHEN 2 THEN 'a_' || doc_id ELSE 'x.PDF' END AS t FROM documents)""")
def query_shapes(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("doc_id") % 4
    t = F.when(m == 0, F.concat(F.lit("10.1234/abc"), "doc_id")).when(m == 1, F.col("text")).when(m == 2, F.concat(F.lit("a_"), "doc_id")).otherwise("x.PDF")
    return table(spark, d, "documents").select("doc_id", P.looks_like_filename(t).alias("filename_like"), X.looks_like_doi(t).alias("doi_like"))


@query("""WITH f AS (SELECT doc_id % 20 AS file, CASE WHEN quality = 0 THEN 'red' ELSE 'warn' END AS severity FROM labels) SELECT file, count(*) FILTER (severity = 'red') AS red, count(*) FILTER (severity = 'warn') AS warn, count(*) AS n FROM f GROUP BY file""")
def report_by_file(spark: SparkSession, d: str) -> DataFrame:
    return A.report_by_file(table(spark, d, "labels").select((F.col("doc_id") % 20).alias("file"), F.when(F.col("quality") == 0, "red").otherwise("warn").alias("severity")))


@query("""SELECT item_id, doc_id, common FROM (SELECT b.item_id, t.doc_id, count(*) AS common FROM (SELECT DISTINCT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) b
  JOIN (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) t USING (w) GROUP BY ALL) WHERE common >= 12""")
def shared_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _shared_vocabulary(spark, d, table(spark, d, "documents"))


def _shared_vocabulary(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    b = table(spark, d, "benchmark").select("item_id", F.split(F.lower("text"), " ").alias("bw"))
    t = docs.select("doc_id", F.split(F.lower("text"), " ").alias("dw"))
    return J.overlap_join(b, t, "item_id", "doc_id", "bw", "dw", least=12)


@query("""SELECT conv_id, count(*) AS turns, arg_max(role, turn) AS last_role, max(CASE WHEN role = 'user' THEN turn END) AS last_user FROM conversations GROUP BY conv_id""")
def conversation_state(spark: SparkSession, d: str) -> DataFrame:
    """Carry-forward of the last user turn, and what each conversation ends with."""
    c = W.carry_forward(table(spark, d, "conversations"), ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("turn")), "user_turn")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.max_by("role", "turn").alias("last_role"), F.max_by("user_turn", "turn").alias("last_user"))


@query("""WITH p AS (SELECT page_id AS id, regexp_replace(url, '^https?://', '') AS title, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS prov FROM pages), k AS (SELECT 'title:' || lower(title) AS key, prov, id FROM p)
  SELECT key, min(prov)::INT AS provider FROM k GROUP BY key""")
def provider_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Keep-first over two providers, the primary before the secondary."""
    none = F.lit(None).cast("string")
    p = table(spark, d, "pages").select(none.alias("id"), none.alias("doi"), F.regexp_replace("url", "^https?://", "").alias("title"), F.col("page_id").alias("_ord"))
    n = 10**9
    got = T.search(p.filter("_ord % 3 <> 0"), p.filter("_ord % 3 = 0"), n, supplement=n)
    return got.select("key", F.col("_p").cast("int").alias("provider"))


for _f in (html_unescape, math_quality, slug_keys_unicode, source_screen):
    query()(_f)
