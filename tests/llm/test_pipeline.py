"""The whole pipeline, and the certified cutoffs of its first stage, against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from pathlib import Path

import public_tokenizers

import corpus_pipeline
from loam.llm import quality
from loam.session import shared_folder

from .test_ngram_join import components_of
from .test_operators import W_ASCII, contamination_truth, passages_truth, prose, quality_truth


def scores(text):
    """Rule scores of a text, from the counts that ``quality_truth`` makes."""
    n_words, chars, symbols, dup, repeat, failed = quality_truth(text)
    lines = [x for x in (text or "").split("\n") if W_ASCII.search(x)]
    return failed, {
        "symbol_ratio": symbols / max(n_words, 1), "upper_ratio": len(re.findall("[A-Z]", text or "")) / max(chars, 1), "dup_line_ratio": dup / max(len(lines), 1),
        "repeat_ratio": repeat / max(n_words, 1), "mean_word": chars / max(n_words, 1),
    }


def cutoffs_truth(rows, good):
    """(stratum, rule) -> strictest cutoff that the exact binomial test certifies, laxest first, up to the first failure."""
    strata = {}
    for i, text, lang in rows:
        failed, own = scores(text)
        if i in good and not failed:
            strata.setdefault(lang or "", []).append(own)
    p, level, out = quality.ALPHA / len(quality.GRIDS), quality.DELTA / (max(1, len(strata)) * len(quality.GRIDS)), {}
    for lang, held in strata.items():
        for rule, grid in quality.GRIDS.items():
            for c in grid:
                n, k = len(held), sum(x[rule] > c for x in held)
                if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > level:
                    break
                out[lang, rule] = c
    return out


def corpus(n=900, seed=5):
    rng = random.Random(seed)
    passage, rows = prose(rng, 70), []
    for i in range(n):
        text = "\n".join(prose(rng, rng.randint(20, 40)) for _ in range(3))
        if i % 9 == 4:
            text = (rows[-4][1] or text) + (" x" if i % 2 else "")
        if i % 11 == 5:
            text += "\n" + passage
        if i % 13 == 6:
            text = text.replace(" ", " $# ")
        if i % 17 == 7:
            text = prose(rng, 20)
        rows.append((i, text if i % 101 else None, ("en", "de", None)[i % 3 if i % 5 == 0 else 0]))
    return rows


def test_certified_cutoffs(spark):
    rows = corpus()
    labels = [(i, 0 if i % 13 == 6 else 1) for i, *_ in rows if i % 10 < 9]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = quality.certified_cutoffs(quality.features(df), spark.createDataFrame(labels, "doc_id long, quality int"))
    want = cutoffs_truth(rows, {i for i, q in labels if q})
    assert {(r.stratum, r.rule): r.cutoff for r in got.collect()} == want and want


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    rng = random.Random(8)
    labels = [(i, 0 if i % 13 == 6 else 1) for i, *_ in rows if i % 10 < 9]
    items = [(k, " ".join((rows[k][1] or prose(rng, 60)).split()[5:25])) for k in (3, 50, 77)] + [(9, None)]
    spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = Path(shared_folder(spark).removeprefix("file:")) / "loam"
    before = set(folder.iterdir()) if folder.exists() else set()
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert [x.name.split("-")[0] for x in set(folder.iterdir()) - before] == ["pipeline"]  # what the last stage reads

    cuts, kept = cutoffs_truth(rows, {i for i, q in labels if q}), []
    for i, text, lang in rows:
        failed, own = scores(text)
        if not failed and not any(v > cuts.get((lang or "", rule), math.inf) for rule, v in own.items()):
            kept.append((i, text))
    assert 100 < len(kept) < len(rows) - 50
    drop = passages_truth(kept, 3, 50)
    assert any(drop.values())
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i])) for i, t in kept]
    group, _ = components_of([t for _, t in kept], 5, 80)
    one = [x for k, x in enumerate(kept) if group[k] == k]
    assert len(one) < len(kept)
    bad = Counter(d for d, *_, hit in contamination_truth(one, items).elements() if hit)
    assert bad
    lib, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    lib.no_truncation()
    for i, t in one:
        if i not in bad:
            ids = lib.encode(t, add_special_tokens=False).ids
            said = " ".join(map(str, ids))
            want[i, len(ids), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_null_ids_and_texts_through_the_run(spark, tmp_path):
    """A row without id is judged, cut and encoded like any other; one without text goes at the quality rules."""
    rng = random.Random(21)
    rows = [(i, prose(rng, 80), "en", None, None) for i in range(12)] + [(None, prose(rng, 90), None, "s", 3), (None, None, "en", "s", 0), (None, prose(rng, 5), "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(None, "x y"), (1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == Counter([*range(12), None])


def test_stages_keep_all_columns(spark, tmp_path):
    """All stages but the last return the columns of documents, on an empty table too."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and out.count() == 0
