"""Joins: anti and semi joins over identifiers, token-overlap joins, cascaded matching, grounding, attribute pivots."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType, StructField, StructType

from ..functions import text as X
from . import scoring

#: Rows (id, token) of a left side that tasks may know whole.
FEW_TOKENS = 200_000


def orphans(nodes: DataFrame, edges: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Nodes (column node) at no edge."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node")).distinct()
    return nodes.join(ends, "node", "left_anti")


def prune_dangling(edges: DataFrame, from_nodes: DataFrame, to_nodes: DataFrame, a: str = "from_id", b: str = "to_id") -> DataFrame:
    """Edges whose two endpoints exist."""
    return edges.join(from_nodes.select(F.col("node").alias(a)), a, "left_semi").join(to_nodes.select(F.col("node").alias(b)), b, "left_semi")


def missing_endpoints(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose endpoint has a kind and does not exist."""
    return edges.filter(F.col(end).contains("/")).join(nodes.select(F.col("node").alias(end)), end, "left_anti")


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str, least: int = 1) -> DataFrame:
    """left_id, right_id, common: pairs with ``least`` common tokens or more.

    A left side of up to ``FEW_TOKENS`` tokens in all goes to the tasks, which count every right row against it: no pair that fails is ever
    a row. Otherwise, for one token both sides are exploded into an equality join; for more, such pairs share one of the n - least + 1
    rarest tokens of either side, so only those meet, and the common tokens of those pairs are counted on the arrays: for thresholds that few
    pairs reach.
    """
    if least > 1:
        few = left.select(left_id, F.explode(F.array_distinct(left_tokens)).alias("token")).filter("token is not null").distinct().limit(FEW_TOKENS + 1).collect()
        if len(few) <= FEW_TOKENS:
            return _counted(few, left.schema[left_id].dataType, right, left_id, right_id, right_tokens, least)
    if least <= 1:
        a = left.select(left_id, F.explode(F.array_distinct(left_tokens)).alias("token"))
        b = right.select(right_id, F.explode(F.array_distinct(right_tokens)).alias("token"))
        return a.join(b, "token").groupBy(left_id, right_id).agg(F.count(F.lit(1)).alias("common"))
    pairs = _rare_pairs(left, right, left_id, right_id, left_tokens, right_tokens, lambda n: n - least + 1)
    sets = [df.select(key, F.array_distinct(tokens).alias(name)) for df, key, tokens, name in ((left, left_id, left_tokens, "_a"), (right, right_id, right_tokens, "_b"))]
    both = pairs.join(sets[0], left_id).join(sets[1], right_id)
    return both.select(left_id, right_id, F.size(F.array_intersect("_a", "_b")).cast("long").alias("common")).filter(F.col("common") >= least)


def _counted(few: list[tuple], kind: DataType, right: DataFrame, left_id: str, right_id: str, right_tokens: str, least: int) -> DataFrame:
    """``overlap_join`` of rows (id, token) that every task knows: each right row's tokens are looked up and the hits of each id counted."""
    sent = right.sparkSession.sparkContext.broadcast([tuple(r) for r in few])
    schema = StructType([StructField(left_id, kind), StructField(right_id, right.schema[right_id].dataType), StructField("common", LongType())])

    def run(batches):
        places, having = {}, {}
        for i, token in sent.value:
            having.setdefault(token, []).append(places.setdefault(i, len(places)))
        having = {token: np.array(at) for token, at in having.items()}
        ids = pa.array(list(places), to_arrow_type(kind))
        for b in batches:
            for at in range(0, b.num_rows, 100):  # as many results at once as 100 rows can have
                part, hits, rows = b.slice(at, 100), [], []
                for k, tokens in enumerate(part.column(1).to_pylist()):
                    found = [having[t] for t in set(tokens or ()) if t in having]
                    if len(found) >= least:
                        n = np.bincount(np.concatenate(found), minlength=len(ids))
                        good = np.flatnonzero(n >= least)
                        hits.append((good, n[good]))
                        rows.append(np.full(len(good), k))
                if hits:
                    i, n = (np.concatenate(x) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), part.column(0).take(pa.array(np.concatenate(rows))), pa.array(n, pa.int64())], [left_id, right_id, "common"])

    return right.select(right_id, right_tokens).mapInArrow(run, schema)


def overlap_counts(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str) -> DataFrame:
    """left_id, n: how many right_ids share a token with it, where any do.

    Equal token sets are one class: classes meet and not rows, so many rows that share a token make no pairs. Rows of one id count as
    one with all their tokens.
    """

    def classes(df: DataFrame, key: str, tokens: str, name: str) -> DataFrame:
        return df.select(key, F.explode(tokens).alias("token")).groupBy(key).agg(F.array_sort(F.collect_set("token")).alias(name))

    a, b = classes(left, left_id, left_tokens, "_a"), classes(right, right_id, right_tokens, "_b")
    many = b.groupBy("_b").agg(F.count(F.lit(1)).alias("_m"))
    one, two = a.select("_a").distinct().select("_a", F.explode("_a").alias("token")), many.select("_b", "_m", F.explode("_b").alias("token"))
    met = one.join(two, "token").select("_a", "_b", "_m").distinct().groupBy("_a").agg(F.sum("_m").alias("n"))
    return a.join(met, "_a").select(left_id, "n")


def _rare_pairs(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str, prefix) -> DataFrame:
    """left_id, right_id of pairs that share one of the ``prefix`` (of the number of tokens) rarest tokens of either side.
    Tokens of one side only drop out of the join, not of the prefix."""
    both = left.select(F.explode(F.array_distinct(left_tokens)).alias("token")).unionByName(right.select(F.explode(F.array_distinct(right_tokens)).alias("token")))
    often = both.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def rarest(df: DataFrame, key: str, tokens: str) -> DataFrame:
        long = df.select(key, F.explode(F.array_distinct(tokens)).alias("token")).join(often, "token")
        own = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("w"))
        kept = F.greatest(prefix(F.size("w")), F.lit(0))
        return own.select(key, F.explode(F.slice("w", F.lit(1), kept)).alias("x")).select(key, "x.token")

    return rarest(left, left_id, left_tokens).join(rarest(right, right_id, right_tokens), "token").select(left_id, right_id).distinct()


def jaccard_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_tokens: str, right_tokens: str, least: float) -> DataFrame:
    """left_id, right_id of all pairs whose token sets can reach a Jaccard of ``least``, and few others.

    Such pairs share one of the rarest n - ceil(least n) + 1 tokens of either side, so only those meet, and a frequent
    token pairs nothing unless a set has no rarer ones.
    """
    return _rare_pairs(left, right, left_id, right_id, left_tokens, right_tokens, lambda n: n - F.ceil(n * least).cast("int") + 1)


def containment_candidates(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: str, right_text: str) -> DataFrame:
    """left_id, right_id of all pairs of which one text, of two words or more, can stand inside the other, mid-word too.

    Where it stands, its first gap stands on a gap: up to four letters before and after it are the key of the shorter
    text, and the longer one offers all such keys of all its gaps. A text of three words and more has its second word, which stands
    whole, and the next gap in the key too, so that letters that many first gaps share pair only texts that go on alike.
    """
    most = 4
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(1, most + 1) for j in range(1, most + 1)])

    def key(a: Column, between: list[Column], c: Column, i: Column, j: Column) -> Column:
        return F.concat_ws(" ", F.right(a, i), *between, F.left(c, j), i, j)

    def first(df: DataFrame, name: str, text: str, n: int) -> DataFrame:
        """Keys of the texts of two words (n = 2), or of three and more (3)."""
        w = df.select(name, F.split(text, " ").alias("w")).filter(F.size("w") == 2 if n == 2 else F.size("w") >= 3)
        a, c = F.get("w", F.lit(0)), F.get("w", F.lit(n - 1))
        return w.select(name, key(a, [F.get("w", F.lit(1))] if n == 3 else [], c, F.least(F.length(a), F.lit(most)), F.least(F.length(c), F.lit(most))).alias("gap"))

    def offered(df: DataFrame, name: str, text: str, n: int) -> DataFrame:
        w = df.select(name, F.split(text, " ").alias("w")).filter(F.size("w") >= n)
        runs = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(F.get("w", i).alias("a"), F.get("w", i + 1).alias("m"), F.get("w", i + n - 1).alias("c")))
        cut = w.select(name, F.explode(runs).alias("x")).select(name, "x.*").withColumn("s", F.explode(sizes)).filter((F.length("a") >= F.col("s.i")) & (F.length("c") >= F.col("s.j")))
        return cut.select(name, key(F.col("a"), [F.col("m")] if n == 3 else [], F.col("c"), F.col("s.i"), F.col("s.j")).alias("gap"))

    pairs = []
    for n in (2, 3):
        # merged: the planner takes exploded keys for as small as the texts, and would broadcast them
        pairs.append(first(left, left_id, left_text, n).join(offered(right, right_id, right_text, n).hint("merge"), "gap").select(left_id, right_id))
        pairs.append(first(right, right_id, right_text, n).join(offered(left, left_id, left_text, n).hint("merge"), "gap").select(left_id, right_id))
    return reduce(DataFrame.unionByName, pairs).distinct()


def similar_names(candidates: DataFrame, entities: DataFrame, least: float = 0.40) -> DataFrame:
    """name, entity, label, _ord, score of every pair that reaches ``least`` (at least .40, below which no score lies).

    Equal texts, containment (of two words and more, mid-word too) and Jaccard each have a join of their own that loses
    no pair; the score is made on those pairs only. Columns: candidates name; entities entity, label, _ord.
    """
    a = candidates.select("name", X.normalize_text("name").alias("na"), X.content_tokens("name").alias("ta"))
    b = entities.select("entity", "label", "_ord", X.normalize_text("label").alias("nb"), X.content_tokens("label").alias("tb"))
    pairs = a.join(b, a["na"] == b["nb"]).select("name", "_ord")
    pairs = pairs.unionByName(jaccard_candidates(a, b, "name", "_ord", "ta", "tb", 0.4)).unionByName(containment_candidates(a, b, "name", "_ord", "na", "nb")).distinct()
    joined = pairs.join(a, "name").join(b, "_ord")
    return joined.withColumn("score", scoring.phrase_score(F.col("na"), F.col("nb"), F.col("ta"), F.col("tb"))).filter(F.col("score") >= least).select("name", "entity", "label", "_ord", "score")


def best_similar_name(candidates: DataFrame, entities: DataFrame, least: float = 0.40) -> DataFrame:
    """name, entity, label, score: for each name and entity the best of the entity's labels (the first among equals)."""
    return similar_names(candidates, entities, least).groupBy("name", "entity").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("_ord"))).alias("x")).select("name", "entity", "x.*")


def cascade(left: DataFrame, right: DataFrame, left_id: str, right_id: str, levels: list[tuple[str, Column, Column, bool | str]]) -> DataFrame:
    """Match by levels, the first that decides wins. A level: name, left key, right key, whether several hits end the cascade.

    A level with exactly one hit matches; with several it is 'ambiguous' if it ends the cascade, else the next decides; if it says "first",
    the least right_id of several matches. Empty and null keys hit nothing. Returns left_id, right_id, level.
    """
    parts = []
    for i, (name, lk, rk, ends) in enumerate(levels):
        a = left.select(left_id, lk.cast("string").alias("k")).filter("k is not null and k <> ''")
        b = right.select(right_id, rk.cast("string").alias("k")).filter("k is not null and k <> ''")
        b = b.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min(right_id).alias(right_id))
        sure = F.lit(True) if ends == "first" else F.col("n") == 1
        hit = a.join(b, "k").withColumn("level", F.lit(i)).withColumn("name", F.when(sure, name).otherwise("ambiguous"))
        parts.append(hit.filter(sure | F.lit(bool(ends))).select(left_id, F.when(sure, F.col(right_id)).alias(right_id), "level", "name"))
    best = reduce(DataFrame.unionByName, parts).groupBy(left_id).agg(F.min(F.struct("level", "name", right_id)).alias("m"))
    return left.select(left_id).join(best, left_id, "left").select(left_id, F.col(f"m.{right_id}").alias(right_id), F.coalesce("m.name", F.lit("unresolved")).alias("level"))


def _dated(title: Column, n: int, year: Column) -> Column:
    """First words of a normalized title with the year, a missing one too; null without a title."""
    return F.when(title != "", F.concat_ws("|", X.first_words(title, n), F.coalesce(year.cast("string"), F.lit(""))))


def match_sources(papers: DataFrame, sources: DataFrame) -> DataFrame:
    """slug, stem, level: the prepared source of each paper. An equal title decides (the first stem of several), then one source alone with the
    same first 8, 6 or 4 words and year; several at 4 words are ambiguous. Both: normalized title, year; papers slug, sources stem."""
    t, y = F.col("title"), F.col("year")
    levels = [("title-exact", t, t, "first")] + [(f"first{n}+year", _dated(t, n, y), _dated(t, n, y), n == 4) for n in (8, 6, 4)]
    return cascade(papers, sources, "slug", "stem", levels)


def match_library(papers: DataFrame, items: DataFrame) -> DataFrame:
    """slug, item, level: the library item of each paper: the first with its DOI, the only one with its title, the only one with its first six
    words and year. Both: doi, normalized title, year."""
    t, y = F.col("title"), F.col("year")
    return cascade(papers, items, "slug", "item", [("zotero-doi", F.col("doi"), F.col("doi"), "first"), ("zotero-title-exact", t, t, False), ("zotero-first6+year", _dated(t, 6, y), _dated(t, 6, y), False)])


def exact_lists(jobs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(job, k; k, path): the key of each job, and once for all jobs of a key the files that have it. A key is a job's DOI, or its title if
    it has none, as it is but for case and the ends. ``jobs``: job, doi, title; ``items``: doi, title, paths."""
    bare = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    key = F.when(bare("doi") != "", F.concat(F.lit("doi:"), bare("doi"))).otherwise(F.concat(F.lit("title:"), X.normalize_text("title")))
    asked = jobs.select("job", key.alias("k"))
    keys = F.array(F.concat(F.lit("doi:"), bare("doi")), F.concat(F.lit("title:"), X.normalize_text("title")))
    files = items.select("paths", F.explode(keys).alias("k")).filter("k not in ('doi:', 'title:')").join(asked.select("k").distinct(), "k", "left_semi")
    return asked, files.select("k", F.explode("paths").alias("path")).filter("path is not null").distinct()


def exact_lookup(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """job, paths (sorted): files of the items with a job's DOI, or with its title if it has none (``exact_lists``, put with every job)."""
    asked, files = exact_lists(jobs, items)
    lists = files.groupBy("k").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return asked.join(lists, "k", "left").select("job", F.coalesce("paths", F.array().cast("array<string>")).alias("paths"))


def title_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """lid, rid of titles that are equal, of which one contains the other, or whose words have a Jaccard of ``least``.

    Each has a join of its own, so a word that all titles share pairs nothing. Containment goes mid-word for two words and more; a
    one-word title stands as a word of the other, and of the titles that have it the two first of each year are enough to tell the best and
    its lead. Columns lid, lt, lw; rid, rt, rw, ry: ids, titles, words, the year of the right one.
    """
    pairs = left.join(right, left["lt"] == right["rt"]).select("lid", "rid")
    pairs = pairs.unionByName(jaccard_candidates(left, right, "lid", "rid", "lw", "rw", least)).unionByName(containment_candidates(left, right, "lid", "rid", "lt", "rt"))
    inside = left.select("lid", F.explode(F.array_distinct("lw")).alias("word")).join(right.filter(F.size("rw") == 1).select("rid", F.col("rt").alias("word")), "word")
    said = right.select("rid", "ry", F.explode(F.array_distinct("rw")).alias("word"))
    first = said.withColumn("_n", F.row_number().over(Window.partitionBy("word", "ry").orderBy("rid"))).filter("_n <= 2")
    around = left.filter(F.size("lw") == 1).select("lid", F.col("lt").alias("word")).join(first, "word")
    return pairs.unionByName(inside.select("lid", "rid")).unionByName(around.select("lid", "rid")).distinct()


def fuzzy_title_match(left: DataFrame, right: DataFrame, least: float = 0.82, margin: float = 0.08) -> DataFrame:
    """lid, rid, score: titles equal .92, contained .78, token Jaccard of .82 .72, the same year .04 more; accepted at
    ``least`` with a lead of ``margin`` over the second. Columns lid, title, year; rid, title, year (titles normalized).

    Of equal titles of one year only the first two are looked at: more of them have the same score and cannot change what is decided.
    """
    a = left.select("lid", F.col("title").alias("lt"), F.col("year").alias("ly"), X.words("title").alias("lw")).filter(F.size("lw") > 0)
    b = right.select("rid", F.col("title").alias("rt"), F.col("year").alias("ry"), X.words("title").alias("rw")).filter(F.size("rw") > 0)
    b = b.withColumn("_n", F.row_number().over(Window.partitionBy("rt", "ry").orderBy("rid"))).filter("_n <= 2").drop("_n")
    pairs = title_candidates(a, b, 0.82).join(a, "lid").join(b, "rid")
    base = F.when(F.col("lt") == F.col("rt"), 0.92).when(F.col("lt").contains(F.col("rt")) | F.col("rt").contains(F.col("lt")), 0.78)
    base = base.when(scoring.jaccard(F.array_distinct("lw"), F.array_distinct("rw")) >= 0.82, 0.72).otherwise(0.0)
    score = F.when(base > 0, base + F.when(F.col("ly") == F.col("ry"), 0.04).otherwise(0.0)).otherwise(0.0)
    scored = pairs.select("lid", "rid", score.alias("score")).filter("score > 0")
    w = Window.partitionBy("lid").orderBy(F.col("score").desc(), "rid")
    ranked = scored.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("score").over(w))
    return ranked.filter((F.col("rn") == 1) & (F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= margin))).select("lid", "rid", "score")


def quote_grounding(quotes: DataFrame, sources: DataFrame, k: int = 8) -> DataFrame:
    """Quotes with ``grounded``: whether the normalized quote is a substring of any source.

    Sources are cut into k-word runs that are joined with the quote's second word on (its first may begin mid-word), so
    only sources with that run are searched; quotes of fewer than k + 2 words go against all sources in a broadcast
    of the quotes. Columns: quotes qid, quote; sources sid, text.
    """
    q = quotes.select("qid", F.array_join(X.words(F.lower("quote")), " ").alias("q")).withColumn("w", X.words("q"))
    s = sources.select("sid", F.array_join(X.words(F.lower("text")), " ").alias("t"))
    long = q.filter(F.size("w") >= k + 2).withColumn("key", F.array_join(F.slice("w", 2, k), " "))
    w = s.select("sid", "t", X.words("t").alias("w"))
    wanted = long.select("key").distinct()
    grams = w.select("sid", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - k + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, k), " "))).alias("key"))
    spots = grams.join(wanted, "key", "left_semi").distinct()
    hit = spots.join(long, "key").join(s, "sid").filter(F.col("t").contains(F.col("q"))).select("qid")
    short = q.filter((F.size("w") < k + 2) & (F.col("q") != ""))
    hit_short = s.join(F.broadcast(short), F.col("t").contains(F.col("q"))).select("qid") if short.limit(10_001).count() <= 10_000 else s.join(short, F.col("t").contains(F.col("q"))).select("qid")
    hits = hit.union(hit_short).distinct().withColumn("grounded", F.lit(True))
    return quotes.join(hits, "qid", "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def lookup_fill(df: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fill only missing or empty fields from a lookup table."""
    f = found.select(key, *[F.col(c).alias(f"_{c}") for c in fields])
    return df.join(f, key, "left").withColumns({c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")).cast(df.schema[c].dataType), F.col(f"_{c}")) for c in fields}).drop(*[f"_{c}" for c in fields])


def library_status(df: DataFrame, library: DataFrame | None, doi: str = "doi", title: str = "title") -> DataFrame:
    """``status``: collected, not collected, or unknown without a library; by DOI, else by normalized title."""
    if library is None:
        return df.withColumn("status", F.lit("unknown"))
    dois = library.select(X.doi("doi").alias("_d")).filter("_d <> ''").distinct().withColumn("_by_doi", F.lit(True))
    titles = library.select(X.plain_title("title").alias("_t")).filter("_t <> ''").distinct().withColumn("_by_title", F.lit(True))
    out = df.withColumn("_d", X.doi(doi)).withColumn("_t", X.plain_title(title)).join(dois, "_d", "left").join(titles, "_t", "left")
    return out.withColumn("status", F.when(F.col("_by_doi") | F.col("_by_title"), "collected").otherwise("not collected")).drop("_d", "_t", "_by_doi", "_by_title")


def attributes(items: DataFrame, data: DataFrame, values: DataFrame, fields: DataFrame, names: list[str]) -> DataFrame:
    """Wide item rows of an entity-attribute-value store: itemID and a column for each field name."""
    long = data.join(values, "valueID").join(F.broadcast(fields.filter(F.col("fieldName").isin(names))), "fieldID")  # names is a literal list
    return items.join(long.groupBy("itemID").pivot("fieldName", names).agg(F.first("value")), "itemID", "left")


def attribute_map(data: DataFrame, values: DataFrame, fields: DataFrame) -> DataFrame:
    """itemID, all: map of field name to value."""
    long = data.join(values, "valueID").join(fields, "fieldID").groupBy("itemID", "fieldName").agg(F.min("value").alias("value"))
    return long.groupBy("itemID").agg(F.map_from_entries(F.collect_list(F.struct("fieldName", "value"))).alias("all"))


def ordered_names(item_creators: DataFrame, creators: DataFrame) -> DataFrame:
    """itemID, creators: names in order."""
    named = item_creators.join(creators, "creatorID").withColumn("name", F.concat_ws(" ", "firstName", "lastName"))
    return named.groupBy("itemID").agg(F.transform(F.array_sort(F.collect_list(F.struct("orderIndex", "name"))), lambda x: x["name"]).alias("creators"))


def members(collection_items: DataFrame, items: DataFrame, deleted: DataFrame, collections: DataFrame) -> DataFrame:
    """Items of the given collections that are not deleted, once each, by their least (orderIndex, itemID)."""
    live = collection_items.join(collections, "collectionID", "left_semi").join(deleted, "itemID", "left_anti").join(items, "itemID", "left_semi")
    return live.groupBy("itemID").agg(F.min(F.struct("orderIndex", "itemID")).alias("place"))


def wiki_links(pages: DataFrame, text: str = "body") -> DataFrame:
    """page, target: wiki links of pages; links to an anchor of the page itself are no links."""
    found = pages.select("page", F.explode(F.regexp_extract_all(F.col(text), F.lit(r"\[\[([^\]|]+)"), F.lit(1))).alias("raw")).filter(~F.col("raw").startswith("#"))
    return found.select("page", X.reference_slug("raw").alias("target")).distinct()


def broken_links(pages: DataFrame, targets: DataFrame, text: str = "body") -> DataFrame:
    """page, target: wiki links whose target is no page."""
    return wiki_links(pages, text).join(targets.select(F.col("slug").alias("target")), "target", "left_anti").select("page", "target")


def asymmetric_refs(refs: DataFrame, pages: DataFrame) -> DataFrame:
    """Forward references without a way back. ``refs``: page, target; ``pages``: slug, body. Aliases count.

    The links of each body are taken out once and meet the references as rows, so that no body travels with a reference; only for a page
    whose name no link pattern can read (with a bracket or a bar) the bodies themselves are searched.
    """
    odd = F.col("page").rlike(r"[\[\]|]") | (F.col("page") == "")
    bodies = pages.filter("body is not null").select(F.col("slug").alias("target"), "body")
    own = bodies.groupBy("target").agg(F.count(F.lit(1)).alias("_of"))
    links = bodies.select("target", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]|]+)(?=\]\]|\|)"), F.lit(1)))).alias("page"))
    back = links.groupBy("target", "page").agg(F.count(F.lit(1)).alias("_n"))
    plain = refs.filter(~odd).join(own, "target").join(back, ["target", "page"], "left")
    plain = plain.select("page", "target", F.explode(F.array_repeat(F.lit(1), (F.col("_of") - F.coalesce("_n", F.lit(0))).cast("int"))))  # pages of one name each ask
    said = F.col("body").contains(F.concat(F.lit("[["), F.col("page"), F.lit("]]"))) | F.col("body").contains(F.concat(F.lit("[["), F.col("page"), F.lit("|")))
    return plain.select("page", "target").unionByName(refs.filter(odd).join(bodies, "target").filter(~said).select("page", "target"))


def unmentioned(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """Rows whose one-word name is no word of any text (equality join on words, no nested loop)."""
    said = texts.select(F.explode(F.split(F.col(text), r"[^A-Za-z0-9_.-]+")).alias(name)).distinct()
    return names.join(said, name, "left_anti")


def pairs_to_targets(links: DataFrame, sources: DataFrame) -> DataFrame:
    """target, pages: which pages link to each source, sorted."""
    return links.join(sources, "target", "left_semi").groupBy("target").agg(F.sort_array(F.collect_set("page")).alias("pages"))


def parent_names(tree: DataFrame, counts: DataFrame) -> DataFrame:
    """Tree rows with the parent's name and the item count (0 if none)."""
    parents = tree.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return tree.join(parents, "parent", "left").join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def found_or_missing(wanted: DataFrame, there: DataFrame, key: str, library_order: str) -> DataFrame:
    """Requested keys with the library of least order that has them; ``missing`` otherwise."""
    best = there.groupBy(key).agg(F.min(library_order).alias("library"))
    return wanted.join(best, key, "left").withColumn("missing", F.col("library").isNull())


def last_first_lookup(df: DataFrame, items: DataFrame, keys: list[tuple[str, str, bool]]) -> DataFrame:
    """``item``: the first of several lookups that hits. A lookup: row key, item key, whether the last item of a key wins."""
    out, picks = df, []
    for i, (mine, theirs, last) in enumerate(keys):
        agg = F.max_by if last else F.min_by
        best = items.filter(F.col(theirs).isNotNull() & (F.col(theirs) != "")).groupBy(F.col(theirs).alias(mine)).agg(agg("item", "_ord").alias(f"_hit{i}"))
        out = out.join(best, mine, "left")
        picks.append(F.col(f"_hit{i}"))
    return out.withColumn("item", F.coalesce(*picks)).drop(*[f"_hit{i}" for i in range(len(keys))])
