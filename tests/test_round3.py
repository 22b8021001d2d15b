"""Queries on fixtures of the third round's findings, against plain Python and their SQL."""

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from loam.functions import text as X
from loam.operators import joins as J
from loam.plans import compose, registry

registry.load()


def run(spark, at, name):
    return Counter(tuple(r) for r in registry.QUERIES[name](spark, str(at)).collect())


def put(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")


def test_section_forms_ids_like_years(spark, tmp_path):
    put(spark, tmp_path, "documents", [(k, "one\ntwo") for k in (3, 1998, 2001, 2022, 2099, 2100, 20_010)], "doc_id long, text string")
    got = {r.doc_id: r.title for r in registry.QUERIES["section_forms"](spark, str(tmp_path)).collect()}
    want = {k: {0: f"A title of {k} words", 1: "Long enough", 2: "none"}[k % 3] for k in got}
    assert got == want and len(got) == 7
    line = spark.range(1).select(X.guess_title(F.lit("# A title of 2001 words\nThe title itself"), F.lit("none")).alias("t")).first().t
    assert line == "The title itself"  # the rule itself stays: a short line with a year is none


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_containment_pairs_of_common_gaps(spark):
    same = [(k, f"x{k}abcd part {k}") for k in range(600)]
    odd = [(1000, "abcd part 7"), (1001, "d part"), (1002, "part 59"), (1003, "e part 5 more")]
    a, b = spark.createDataFrame(same + odd, "l long, lt string"), spark.createDataFrame(same + odd, "r long, rt string")
    got = J.containment_candidates(a, b, "l", "r", "lt", "rt")
    assert "Broadcast" not in plan_of(got)
    pairs = {tuple(r) for r in got.collect()}
    want = {(i, j) for i, x in same + odd for j, y in same + odd if x in y or y in x}
    assert want <= pairs and len(pairs) < 20_000  # 360,000 pairs share the letters around the first gap


def test_shared_source_counts_of_classes(spark):
    papers = spark.range(20_000).select(F.col("id").cast("string").alias("slug"), F.array((F.col("id") % 2).cast("string"), F.lit("z")).alias("sources"))
    concepts = spark.range(20_000).select(F.col("id").alias("concept"), F.array(F.when(F.col("id") == 7, "0").otherwise((F.col("id") % 3).cast("string"))).alias("concept_sources"))
    claims = spark.createDataFrame([(1, ["5", "5"], [("6",)]), (2, ["5"], None)], "claim long, source_papers array<string>, evidence array<struct<source:string>>")
    got = compose.shared_source_counts(papers, concepts, claims).groupBy("concepts", "claims").count().collect()
    of = Counter("0" if k == 7 else str(k % 3) for k in range(20_000))
    assert {tuple(r) for r in got} == {(of["0"], 0, 9_999), (of["1"], 0, 9_999), (of["1"], 2, 1), (of["0"], 1, 1)}


def test_exact_lists_once_for_all_jobs(spark):
    items = spark.range(3_000).select(F.lit(" 10.1/A").alias("doi"), F.lit("One").alias("title"), F.array(F.concat(F.lit("f"), "id"), F.lit("f0")).alias("paths"))
    jobs = spark.range(3_000).select(F.col("id").alias("job"), F.when(F.col("id") % 3 == 0, "10.1/a").alias("doi"), F.when(F.col("id") % 3 == 1, " one! ").otherwise("none").alias("title"))
    asked, files = J.exact_lists(jobs, items)
    assert asked.count() == 3_000 and files.count() == 6_000
    paths = sorted(f"f{k}" for k in range(3_000))
    got = {r.job: r.paths for r in J.exact_lookup(jobs.filter("job < 6"), items).collect()}
    assert got == {k: paths if k % 3 < 2 else [] for k in range(6)}


def test_exact_files(spark, tmp_path):
    put(spark, tmp_path, "documents", [(k, "de" if k % 2 else None) for k in range(220)], "doc_id long, lang string")
    md5 = lambda ks: hashlib.md5(",".join(sorted(f"f{k}" for k in ks)).encode()).hexdigest()
    files = {0: lambda j: [k for k in range(220) if k % 50 == j % 50], 1: lambda _: range(1, 220, 2), 2: lambda _: [], 3: lambda _: []}
    assert run(spark, tmp_path, "exact_files") == Counter((j, len(f), md5(f)) for j in range(220) if j % 100 < 4 for f in [files[j % 4](j)])


def _slugs(text):
    w = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in text.lower()).split()
    keys = [x for x in w if x not in X.STOP_WORDS and len(x) > 1]
    return " ".join(w), "-".join((keys or w)[:6]) or "untitled", "-".join([x for x in w if len(x) > 1][:3])


def test_slugs_read_a_text_once(spark, tmp_path):
    texts = ["", " ", "The a of", "a b c d e f g h", "Is The " * 9 + "Thesis, of-the art x by by bye 1 22 an anon theory end", "\n.One\tTwo  -é- a. 3 four", "- a" * 50_000 + " late words and more", "the " * 100_000 + "x1", "of", "ofx of xof y zz"]
    put(spark, tmp_path, "documents", [(k, t, "s", "en") for k, t in enumerate(texts)], "doc_id long, text string, source string, lang string")
    assert run(spark, tmp_path, "slug_keys") == Counter((k, *_slugs(t)[:2]) for k, t in enumerate(texts))
    got = {r.doc_id: r.slug for r in registry.QUERIES["paper_slugs"](spark, str(tmp_path)).collect()}
    assert got == {k: "_".join(filter(None, ["smith", str(1990 + k), _slugs(t)[2]])) for k, t in enumerate(texts)}
    for name in ("slug_keys", "paper_slugs"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(coalesce(text") + plan.count("lower(text") == 1, plan


def test_overlap_join_of_few_pairs_nothing(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c", None]), (2, ["c", "d"]), (3, None)], "i long, x array<string>")
    b = spark.createDataFrame([("p", ["a", "b", "b", "c", "d"]), ("q", ["c", "z"]), ("r", None)], "j string, y array<string>")
    got = J.overlap_join(a, b, "i", "j", "x", "y", least=2)
    assert {tuple(r) for r in got.collect()} == {(1, "p", 3), (2, "p", 2)}
    assert "Join" not in plan_of(got) and "Exchange" not in plan_of(got)
    many = J.overlap_join(spark.range(250_001).selectExpr("id AS i", "array(string(id), string(id + 1)) AS x"), b.selectExpr("j", "array('7', '8', '9') AS y"), "i", "j", "x", "y", least=2)
    assert {tuple(r) for r in many.collect()} == {(i, j, 2) for i in (7, 8) for j in "pqr"}


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    put(spark, tmp_path, "documents", [(1, "x")], "doc_id long, text string")
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    old = [spark.conf.get(k) for k in keys]
    try:
        for rows, want in (("10000", "1000"), ("50", "50")):
            spark.conf.set(keys[0], rows)
            registry.QUERIES["source_screen"](spark, str(tmp_path))
            assert spark.conf.get(keys[0]) == want and int(spark.conf.get(keys[1])) <= 32 << 20
    finally:
        for k, v in zip(keys, old, strict=True):
            spark.conf.set(k, v)


def test_asymmetric_refs_by_links(spark):
    pages = [("t", "[[a]] [[b|B]] [[[c]] [[d] ] [[e\nf]] [[g[h]] [[]]"), ("u", None), ("v", ""), ("w", "[[a]]"), ("w", "[[b]]")]
    names = ["a", "b", "c", "d", "e\nf", "e", "g[h", "h", "", "x|y", "[c"]
    refs = [(n, t) for n in names for t in ("t", "u", "v", "w", "none")]
    got = J.asymmetric_refs(spark.createDataFrame(refs, "page string, target string"), spark.createDataFrame(pages, "slug string, body string"))
    want = Counter((n, t) for n, t in refs for s, body in pages if s == t and body is not None and f"[[{n}]]" not in body and f"[[{n}|" not in body)
    assert Counter(tuple(r) for r in got.collect()) == want
    plain = J.asymmetric_refs(spark.createDataFrame([("a", "t")], "page string, target string"), spark.createDataFrame(pages, "slug string, body string"))
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan.split("Union")[0] and "regexp_extract_all" in plan


def test_suffixes_that_share_an_anchor_only_drop_out():
    import numpy as np

    from loam.llm import suffix_dedup as S

    rng = np.random.default_rng(5)
    word, texts = rng.integers(0, 256, 16, np.uint8), []
    for k in range(40):
        t = rng.integers(0, 256, 200, np.uint8)
        t[80:96] = word
        texts.append(t)
    texts[7][60:140] = texts[3][60:140]  # 80 bytes are the same, and nothing else
    x = {"raw": np.concatenate(texts), "size": np.full(40, 200)}
    found = S.page_anchors(x, np.arange(40), 50)
    keys, which, _ = S.sides(x["raw"], found, 50)
    kinds, n = np.unique(keys, return_counts=True)
    kept = S.repeated(x["raw"], found, kinds[n > 1], 50)
    assert set(kept[1] // 200) == {3, 7}
    spans = {int(w) % 200 for lo, hi in zip(kept[2], kept[3], strict=True) for w in range(lo, hi + 1)}
    assert spans >= set(range(60, 91))  # every repeated window is there
