"""Queries on fixtures with far ids and long texts, against plain Python."""

from collections import Counter

from loam.plans import registry

registry.load()


def run(spark, at, name):
    return Counter(tuple(r) for r in registry.QUERIES[name](spark, str(at)).collect())


def put(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")


def test_missing_fields(spark, tmp_path):
    rows = [(i, '{"k": 1}' if i % 2 else '{"status": "x", "tags": []}') for i in (0, 1, 499, 500, 501, 90_000)]
    put(spark, tmp_path, "events", rows, "event_id long, props string")
    want = [(i, f"Missing required field: {f}", fix) for i, _ in rows for f, fix in (("k", False), ("status", True), ("tags", True)) if (f == "k") != bool(i % 2)]
    assert run(spark, tmp_path, "missing_fields") == Counter(want)


def test_membership_upsert(spark, tmp_path):
    rows = [(k, c, "F" if k % 3 == 0 else "O") for k, c in enumerate([1, 899, 900, 900, 900, 15_000, 15_000, 1, 901, 15_000, *range(20_000, 22_100)])]
    put(spark, tmp_path, "orders", rows, "o_orderkey long, o_custkey long, o_orderstatus string")
    want = Counter()
    for item in {c for _, c, _ in rows}:
        have = {k % 7 for k, c, s in rows if c == item and s == "F"}
        added = len({k % 7 for k, c, _ in rows if c == item} - have)
        want[(item, added, added > 0)] += 1
    got = registry.QUERIES["membership_upsert"](spark, str(tmp_path)).select("item", "added", "changed").collect()
    assert Counter(tuple(r) for r in got) == want


PARTS = [(1, "red gear", "B1", "SMALL", 1), (19, "hot bolt", "B2", "LARGE", 1), (299, "red small", "B1", "LARGE", 5), (300, "red gear", "B3", "SMALL", 5), (301, "hot gear", "B3", "SMALL", 1), (20_000, "cold nut", "B3", "SMALL", 5)]
PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


def test_topic_overlap(spark, tmp_path):
    put(spark, tmp_path, "part", PARTS, PART)
    topics = {}
    for _, name, brand, kind, size in PARTS:
        if size == 1:
            topics.setdefault(brand, set()).update(name.split(), kind.lower().split())
    want = Counter((b, k, len(w & set(name.split()))) for b, w in topics.items() for k, name, *_ in PARTS if w & set(name.split()))
    assert max(k for _, k, _ in want) >= 300
    assert run(spark, tmp_path, "topic_overlap") == want


def test_similar_names(spark, tmp_path):
    put(spark, tmp_path, "part", PARTS, PART)
    put(spark, tmp_path, "supplier", [(1, "Nobody"), (19, "Nobody")], "s_suppkey long, s_name string")
    got = run(spark, tmp_path, "similar_names")
    # contained two-word names .85; "red small" shares 1 of 4 words with "red gear nobody", "hot gear" 1 of 4 with either
    assert got == Counter({("red gear", 1, 0.85): 1, ("hot bolt", 19, 0.85): 1})
    put(spark, tmp_path / "late", "part", [(1, "red gear", "B", "S", 1), (500, "red gear nobody", "B", "S", 1)], PART)
    put(spark, tmp_path / "late", "supplier", [(1, "Nobody")], "s_suppkey long, s_name string")
    assert run(spark, tmp_path / "late", "similar_names") == Counter({("red gear", 1, 0.85): 1, ("red gear nobody", 1, 1.0): 1})


def test_shared_vocabulary(spark, tmp_path):
    words = [f"w{k}" for k in range(30)]
    docs = [(1, " ".join(words), "de"), (2, " ".join(words[:12] * 2), "en"), (3, " ".join(words[:11] * 2), "fr"), (4, " ".join(words[15:]), "es")]
    items = [(7, " ".join(words[:20])), (8, " ".join(words[10:]))]
    put(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string")
    put(spark, tmp_path, "benchmark", items, "item_id long, text string")
    common = {(i, k): len(set(a.split()) & set(b.split())) for i, a in items for k, b, _ in docs}
    assert run(spark, tmp_path, "shared_vocabulary") == Counter((i, k, n) for (i, k), n in common.items() if n >= 12)


LONG = " ".join(f"word{k}" for k in range(60))


def test_quote_grounding(spark, tmp_path):
    put(spark, tmp_path, "documents", [(1, f"Before {LONG} after"), (2, "short one")], "doc_id long, text string")
    put(spark, tmp_path, "benchmark", [(1, LONG), (2, LONG[:120] + " differs from here"), (3, "Short  one"), (4, "shorter one")], "item_id long, text string")
    assert run(spark, tmp_path, "quote_grounding") == Counter([(1, True), (2, False), (3, True), (4, False)])


def test_slug_keys(spark, tmp_path):
    rows = [(1, LONG.upper() + "!"), (2, LONG + " more"), (3, "- " * 100 + "Late words"), (4, "")]
    put(spark, tmp_path, "documents", rows, "doc_id long, text string")
    start = "-".join(LONG.split()[:6])
    assert run(spark, tmp_path, "slug_keys") == Counter([(1, LONG, start), (2, LONG + " more", start), (3, "late words", "late-words"), (4, "", "untitled")])
    got = {r.doc_id: r for r in registry.QUERIES["slug_keys_unicode"](spark, str(tmp_path)).collect()}
    assert got[1].key != got[2].key and got[2].key.endswith("more") and got[2].part.endswith("more") and got[3].part == "late-words"
