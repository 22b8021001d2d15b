"""The corpus operators as queries over the tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import ready
from . import bpe, conversation_repair, decontamination, licenses, line_dedup, ngram_join, pii, prefix_trie, quality, secrets_scan, suffix_dedup, token_output, url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(table(spark, sf_dir, "documents"), TOKENIZER)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return conversation_repair.repair_report(conversation_repair.damage(turns), turns)


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_scan(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_ngram_join, op3_suffix_dedup, op4_line_dedup, op5_bpe,
        op6_licenses, op7_pii, op8_token_output, op9_url_filter, op10_decontamination,
        op11_conversation_repair, op12_secret_scan, op13_prefix_trie,
    )
}
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"E' \t\n\x0b\x0c\r'"
#: The table of the CRC-32 polynomial, and the checksum of an ASCII string by it.
_CRC = """crc AS (
  SELECT list(v ORDER BY n) AS tab FROM (SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n))
)"""


def _crc32(said: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({said}, ''), lambda c: ascii(c)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _more(x: str, cost: int, edit: str, where: str = "TRUE") -> str:
    """State ``x`` of the repair after one more edit."""
    return f"CASE WHEN {x} IS NOT NULL AND {where} THEN {{'cost': {x}.cost + {cost}, 'audit': {x}.audit || '{edit}'}} END"


#: States after inserts behind the last turn, as list expressions over b (nothing yet, after s, u, a).
_AFTER = [
    "b[1]", "b[2]",
    f"list_min([b[3], {_more('b[1]', 2, 'I')}, {_more('b[2]', 2, 'I')}, {_more('b[4]', 2, 'I')}])",
    f"list_min([b[4], {_more('b[3]', 2, 'I')}, {_more('b[1]', 4, 'II')}, {_more('b[2]', 4, 'II')}])",
]


def _step() -> str:
    """The states after one more turn of role initial k; gone: must go; t: 1 if truncated. c has the states after inserts."""
    kept = lambda q, role: _more(f"c[{q}]", 0, "K", f"NOT gone AND k = '{role}'")
    given = lambda q: _more(f"c[{q}]", 2, "R", "NOT gone")
    paid = lambda ways: "list_transform([" + ", ".join(ways) + "], lambda x: CASE WHEN x IS NOT NULL THEN {'cost': x.cost + t, 'audit': x.audit} END)"
    into = [[], [kept(1, "s")], [kept(1, "u"), kept(2, "u"), kept(4, "u"), given(1), given(2), given(4)], [kept(3, "a"), given(3)]]
    return "[" + ", ".join(f"list_min([{_more(f'c[{q + 1}]', 3, 'D')}]" + (f" || {paid(ways)}" if ways else "") + ")" for q, ways in enumerate(into)) + "]"


_RULES = ", ".join(f"('{rule}', {step}, {cut}::DOUBLE)" for rule, grid in quality.GRIDS.items() for step, cut in enumerate(grid))
_SHARE, _LEVEL = quality.ALPHA / len(quality.GRIDS), quality.DELTA / len(quality.GRIDS)
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), again AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM g WHERE c > 1) GROUP BY r
), f AS (
  SELECT w.r, doc_id, stratum, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, len(ls) AS n_lines FROM w LEFT JOIN again USING (r)
), s AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbol_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word FROM f
), scores AS (
  UNPIVOT (SELECT r, stratum, doc_id, base_failed, symbol_ratio, upper_ratio, dup_line_ratio, repeat_ratio, mean_word FROM s) ON symbol_ratio, upper_ratio, dup_line_ratio, repeat_ratio, mean_word INTO NAME rule VALUE score
), rules(rule, step, cutoff) AS (
  VALUES {_RULES}
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING max(quality) >= 1
), held AS (
  SELECT stratum, rule, step, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM scores JOIN rules USING (rule) WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good) GROUP BY ALL
), tested AS (
  SELECT *, k < n * {_SHARE} AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_SHARE}) + (n - i) * ln(1 - {_SHARE})))) <= {_LEVEL} / (SELECT greatest(1, count(DISTINCT stratum)) FROM held) AS ok FROM held
), cut AS (
  SELECT stratum, rule, min(cutoff) AS cutoff FROM (SELECT *, min(CASE WHEN NOT ok THEN step END) OVER (PARTITION BY stratum, rule) AS stop FROM tested) WHERE stop IS NULL OR step < stop GROUP BY ALL
), failed AS (
  SELECT s.r, string_agg(s.rule, ',' ORDER BY o.o) AS said FROM scores s JOIN cut c ON c.stratum = s.stratum AND c.rule = s.rule AND s.score > c.cutoff JOIN (SELECT rule, min(rn) AS o FROM (SELECT rule, row_number() OVER () AS rn FROM rules) GROUP BY rule) o ON o.rule = s.rule GROUP BY s.r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND said IS NULL AS kept, coalesce(said, '') AS failed_rules FROM s LEFT JOIN failed USING (r)
""",
    "op11_conversation_repair": rf"""
WITH RECURSIVE {_CRC}, said AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT *, {_crc32('key')} % 20 AS kind FROM said, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text), copy) AS i FROM damaged
), f AS (
  SELECT *, left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(rtrim(text, {_SPACE}), 1) NOT IN ('.', '!', '?') AS cut FROM r
), g AS (
  SELECT *, blank OR again AS gone, (cut AND NOT blank AND NOT again)::INT AS t FROM f
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (t = 1) AS truncated,
    count(*) FILTER (i > 1 AND before || k NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id
), dp(conv_id, i, b) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, [{{'cost': 0::BIGINT, 'audit': ''}}, NULL, NULL, NULL] FROM conversations
  UNION ALL
  SELECT conv_id, i, {_step()} FROM (SELECT d.conv_id, g.i, k, gone, t, [{', '.join(_AFTER)}] AS c FROM dp d JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id AND g.i = d.i + 1)
), best AS (
  SELECT conv_id, n, list_min([b[1], {_AFTER[3]}]) AS x FROM (SELECT dp.conv_id, dp.i, b, coalesce(n, 0) AS n FROM dp LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM dp.conv_id) WHERE i = n
), edits AS (
  SELECT conv_id, p, e, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS place
  FROM (SELECT conv_id, unnest(string_split(x.audit, '')) AS e, unnest(range(length(x.audit))) AS p FROM best WHERE x.audit <> '') WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), placed AS (
  SELECT e.*, g.role, g.text, g.k, bool_or(e.place = 1 AND e.e = 'K' AND g.k = 's') OVER (PARTITION BY e.conv_id) AS led FROM edits e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = e.i AND e.e <> 'I' WHERE e.e <> 'D'
), whole AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (place + coalesce(led, FALSE)::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS said FROM placed GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, x.cost AS cost, x.audit AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
""",
    "op13_prefix_trie": rf"""
WITH {_CRC}, said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT c, role, text, sha256(length(role) || ':' || role || ':' || text) AS label, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text)) AS pos FROM said
), size AS (
  SELECT c, count(*) AS n FROM t GROUP BY c
), ids AS (
  SELECT c, c - c % 20 AS base, {_crc32('c::VARCHAR')} % 4 AS h FROM size, crc
), turns AS (
  SELECT i.c, t.pos AS d, label, text FROM ids i JOIN t ON t.c = i.base AND t.pos <= i.h
  UNION ALL
  SELECT i.c, least(h, coalesce(s.n, 0)) + pos - h, label, text FROM ids i JOIN t ON t.c = i.c AND t.pos > i.h LEFT JOIN size s ON s.c = i.base
), member AS (
  SELECT c, d, string_agg(label, '') OVER (PARTITION BY c ORDER BY d) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turns UNION ALL SELECT c, 0, '', 0 FROM ids
), node AS (
  SELECT path, d, min(c) AS conv_id, count(*) AS n, any_value(words) AS words FROM member GROUP BY path, d
), kids AS (
  SELECT left(path, 64 * (d - 1)) AS path, count(*) AS k FROM node WHERE d > 0 GROUP BY 1
), own AS (
  SELECT n.*, coalesce(k, 0) AS k FROM node n LEFT JOIN kids USING (path)
), up AS (
  SELECT left(path, 64 * a) AS path, sum((n - 1) * words)::BIGINT AS saved, count(*) FILTER (k = 0) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM own) GROUP BY 1
), ends AS (
  SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, path, d, max(d) OVER (PARTITION BY c) AS m FROM member) WHERE d = m GROUP BY path
)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.k AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own o JOIN up USING (path) LEFT JOIN ends USING (path) LEFT JOIN node p ON o.d > 0 AND p.path = left(o.path, 64 * (o.d - 1))
""",
    "op2_ngram_join": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS g FROM d
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), met AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)
), ways AS (
  SELECT x AS a, y AS b FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id)
""",
    "op3_suffix_dedup": """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), g AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS p FROM d)
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) < doc_id AS again FROM g
), cover AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS pos FROM f WHERE again
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (pos - 1 <> prev OR prev IS NULL) AS n_spans FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM cover) GROUP BY doc_id
), kept AS (
  SELECT b.doc_id, string_agg(substr(b.h, 2 * b.p + 1, 2), '' ORDER BY b.p) AS rest FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM cover)) b
  LEFT JOIN cover c ON c.doc_id = b.doc_id AND c.pos = b.p WHERE c.pos IS NULL GROUP BY b.doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN n_removed IS NULL THEN h ELSE coalesce(rest, '') END)) AS kept_sha256
FROM d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op4_line_dedup": r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), l AS (
  SELECT doc_id, i, line, trim(line, E' \t\n\x0b\x0c\r') AS v FROM raw
), f AS (
  SELECT doc_id, i, v, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, len(regexp_extract_all(v, '[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+')) AS words FROM l WHERE v <> ''
), w AS (
  SELECT a.doc_id, a.pos, 1 AS size, [a.v] AS key FROM f a WHERE a.words >= 50
  UNION ALL SELECT a.doc_id, a.pos, 2, [a.v, b.v] FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.words + b.words >= 50
  UNION ALL SELECT a.doc_id, a.pos, 3, [a.v, b.v, c.v] FROM f a JOIN f b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN f c ON a.doc_id = c.doc_id AND c.pos = a.pos + 2
), again AS (
  SELECT doc_id, pos, size FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + size)) AS pos FROM again
), runs AS (
  SELECT doc_id, count(*) AS n_removed, count(*) FILTER (prev IS NULL OR prev < pos - 1) AS n_runs FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM gone) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS rest FROM l LEFT JOIN f ON f.doc_id = l.doc_id AND f.i = l.i LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.pos = f.pos WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, (SELECT count(*) FROM f WHERE f.doc_id = d.doc_id) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, sha256(coalesce(rest, '')) AS kept_sha256
FROM documents d LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op10_decontamination": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)
), g AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
), hit AS (
  SELECT g.doc_id, g.s, g.k, i.item_id FROM g JOIN i USING (k, g)
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS pos FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS said FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_url_filter": """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM (SELECT page_id, coalesce(rest, '') AS rest FROM cut)
), rules(act, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fit AS (
  SELECT n.page_id, arg_max(r.rhost || r.rpath, length(r.rhost) + length(r.rpath)) AS rule, arg_max(r.act, length(r.rhost) + length(r.rpath)) AS act
  FROM named n JOIN rules r ON (n.host = r.rhost OR ends_with(n.host, '.' || r.rhost)) AND starts_with(n.path, r.rpath) GROUP BY n.page_id
)
SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.act, 'allow') AS verdict FROM named n LEFT JOIN fit f USING (page_id)
""",
}
