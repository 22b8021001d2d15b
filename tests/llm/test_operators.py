"""The ten corpus operators against plain brute force on small, awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ..conftest import SF
from loam.llm import bpe, components, decontamination, licenses, line_dedup, ngram_join, pii, quality, suffix_dedup, token_output, url_filter

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string, n_words long, starts string, component_id string"
W_ASCII = re.compile(r"[^\x20\x09-\x0D]+")
W_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, empty, null and long texts, a null id, repeated rows."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 60)
    rows = [(0, base), (1, base), (2, None), (3, ""), (4, " \n\t"), (5, "one two"), (6, "One TWO"), (None, base), (7, base), (7, base)]
    for i in range(10, 30):
        w = base.split()
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = "x"
        rows.append((i, " ".join(w)))
    for i in range(30, 50):
        rows.append((i, f"{prose(rng, rng.randint(5, 80))}\n{passage}\n{prose(rng, 30)}"))
    rows += [(60, prose(rng, 4000)), (61, "y" * 3000), (62, "y" * 3000 + "z"), (63, "é\U0001f600ß " * 40), (64, "same line\nsame line\n" * 30)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", 5, "clash", "clash") for i, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, n):
    w = lower(text).encode().split()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join(docs, n, percent):
    rows = corpus()
    nodes = sorted({i for i, _ in rows if i is not None})
    parent = {i: i for i in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, n)) for i, t in rows if i is not None]
    for i, a in sets:
        for j, b in sets:
            both = len(a & b)
            if i < j and both and 100 * both >= percent * (len(a) + len(b) - both):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    want = Counter((i, len(shingles(t, n)), None if i is None else root(i)) for i, t in rows)
    got = Counter(tuple(r) for r in ngram_join.jaccard_join(docs, n, percent).collect())
    assert got == want


def test_tree_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 62, 80, dtype=np.uint64)) for _ in range(60)]
    sets += [np.unique(np.r_[s[: len(s) - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)]) for s in sets[:30] for k in (2, 9)]
    pts, size = ngram_join.points([ngram_join.point(s) for s in sets], ngram_join.GROUPS), np.array([len(s) for s in sets])
    tree = ngram_join.Tree(pts, size, np.arange(len(sets)))
    found = {(int(a), int(b)) for q, p in tree.search(pts, size, np.arange(len(sets)), 80) for a, b in zip(q, p, strict=True)}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert np.minimum(pts[i], pts[j]).sum() >= both
            if i != j and 100 * both >= 80 * (len(a) + len(b) - both):
                assert (i, j) in found


def test_near_duplicates_keep_one(docs):
    kept = ngram_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(7) == 0 and 1 not in ids and 0 in ids and None in ids and 2 in ids and 3 in ids and 4 in ids


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}
    assert components.connected_components(links.limit(0)).count() == 0


def substring_truth(rows, size):
    owner = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - size + 1):
                k = b[p : p + size]
                owner[k] = min(owner.get(k, i), i)
    out = []
    for i, b in texts:
        hit = bytearray(len(b))
        for p in range(len(b) - size + 1) if i is not None else ():
            if owner[b[p : p + size]] < i:
                hit[p : p + size] = b"\1" * size
        kept = bytes(c for c, h in zip(b, hit, strict=True) if not h)
        out.append((i, len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("size", [50, 24, 33])
def test_substring_dedup(docs, size):
    got = suffix_dedup.substring_dedup(docs, size, page_bytes=3000)
    assert Counter(tuple(r) for r in got.collect()) == substring_truth(corpus(), size)


def test_substring_dedup_of_periodic_text(spark):
    rows = [(1, "ab" * 300), (2, "ba" * 100 + "c" + "ab" * 40), (3, "\0" * 200), (4, "\0" * 49), (5, "x" + "\0" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in suffix_dedup.substring_dedup(df, page_bytes=300).collect()) == substring_truth(rows, 50)


def lines_truth(rows, run):
    seqs = [(i, t, [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]) for i, t in rows]
    first = {}
    for i, _, s in sorted(seqs, key=lambda r: -1 if r[0] is None else r[0]):
        for p in range(len(s) - run + 1):
            first.setdefault(tuple(x for _, x in s[p : p + run]), (-1 if i is None else i, p))
    out = []
    for i, t, s in seqs:
        drop = {s[q][0] for p in range(len(s) - run + 1) if first[tuple(x for _, x in s[p : p + run])] < (-1 if i is None else i, p) for q in range(p, p + run)}
        out.append((i, "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in drop)))
    return out


def test_line_dedup(spark):
    rng = random.Random(3)
    block = [f"line {k}" for k in range(6)]
    rows = [(i, "\n".join([prose(rng, 3), *block[i % 3 :], "", prose(rng, 2), *(["rights"] * (i % 3))])) for i in range(20)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, "\n".join(block)), (53, "rights\n" * 8), (54, "\n".join(block)), (54, "\n".join(block))]
    df = spark.createDataFrame([(i, t, 9, "x") for i, t in rows], "doc_id long, text string, n_chars long, uid string").repartition(3)
    out = line_dedup.dedup_lines(df)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.text or "") for r in out.collect())
    assert got == Counter(lines_truth(rows, 3))
    assert out.filter("doc_id = 50").first().text is None
    report = Counter((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in line_dedup.line_report(df).collect())
    assert report == report_truth(rows, 3, 50)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def passages_truth(rows, run, words):
    """Every contiguous run of lines of at least ``run`` lines or ``words`` words that starts earlier too marks its lines."""
    seqs = {i: [(k, x.strip()) for k, x in enumerate((t or "").split("\n")) if x.strip()] for i, t in rows}

    def runs(s):
        for p in range(len(s)):
            for q in range(p + 1, len(s) + 1):
                if q - p >= run or sum(len(x.split()) for _, x in s[p:q]) >= words:
                    yield p, q, tuple(x for _, x in s[p:q])

    first = {}
    for i in sorted(seqs):
        for p, _, key in runs(seqs[i]):
            first.setdefault(key, (i, p))
    return {i: {s[k][0] for p, q, key in runs(s) if first[key] < (i, p) for k in range(p, q)} for i, s in seqs.items()}


def test_line_dedup_of_long_passages(spark):
    rng = random.Random(11)
    whole, left, right, short = prose(rng, 60), prose(rng, 30), prose(rng, 20), prose(rng, 40)
    rows = [(0, f"{whole}\n{prose(rng, 9)}\n{left}\n{right}\n{short}"), (1, whole), (2, f"{left}\n\n {right}"), (3, left), (4, short), (5, f"{left}\n{prose(rng, 3)}\n{right}")]
    rows += [(6, f"{prose(rng, 8)}\n{whole}\n{prose(rng, 8)}\n{short}\n{prose(rng, 8)}"), (7, f"{whole}\n{left}"), (8, f"{left}\n{left}\n{left}"), (9, f"{whole} x"), (10, prose(rng, 49)), (11, prose(rng, 50))]
    rows += [(12, dict(rows)[10]), (13, dict(rows)[11])]
    drop = passages_truth(rows, 3, 50)
    assert drop[1] and drop[13] and drop[8] and not drop[3] and not drop[4] and not drop[12]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()} == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in drop[i]) for i, t in rows}
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in line_dedup.line_report(df).collect()) == report_truth(rows, 3, 50)


def report_truth(rows, run, words):
    """n_lines, n_removed, n_runs and the digest of the text left, of each row; a null id comes before all others."""
    drop = passages_truth([(-1 if i is None else i, t) for i, t in rows], run, words)
    out = Counter()
    for i, t in rows:
        gone, lines = drop[-1 if i is None else i], (t or "").split("\n")
        full = [k for k, x in enumerate(lines) if x.strip()]
        runs = sum(k in gone and (n == 0 or full[n - 1] not in gone) for n, k in enumerate(full))
        out[i, len(full), len(gone), runs, hashlib.sha256("\n".join(x for k, x in enumerate(lines) if k not in gone).encode()).hexdigest()] += 1
    return out


def test_line_dedup_of_random_lines(spark):
    """Many documents over few lines: windows that repeat inside and across documents, in every overlap."""
    rng = random.Random(21)
    lines = ["a", "b", "c", prose(rng, 30), prose(rng, 26), prose(rng, 55), ""]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 9)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in line_dedup.line_report(df).collect()) == report_truth(rows, 3, 50)


def quality_truth(text):
    w = W_ASCII.findall(text or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if W_ASCII.search(x)]
    n, r = len(w), len(covered)
    return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n)


def test_quality_base(spark, docs):
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (0, 0)], "doc_id long, quality int")
    got = Counter(tuple(r)[:7] for r in quality.quality_rules(docs, labels).collect())
    assert got == Counter((i, *quality_truth(t)) for i, t in corpus())
    assert {r.doc_id for r in quality.keep_good(docs, labels).select("doc_id").collect()} == {i for i, t in corpus() if not quality_truth(t)[-1]}
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_binomial_tail_is_exact(spark):
    cases = [(100, 0, 0.02), (100, 1, 0.02), (5000, 30, 0.01), (60000, 500, 0.01), (1, 0, 0.5)]
    for n, k, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p).alias("x")).first().x
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def test_certified_cutoffs_hold_the_risk(spark):
    """Junk goes, good documents of each stratum stay within the bound; a stratum with few labels loses nothing."""
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(3000):
        junk = i % 5 == 0
        text = " ".join(("".join(rng.choice("abcdefghij") for _ in range(4)) + ("$$$" if junk else "")) for _ in range(60))
        rows.append((i, text, "en" if i % 20 else "xx"))
        labels.append((i, int(not junk)))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in quality.quality_rules(d, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert all(not got[i].kept for i in range(3000) if i % 5 == 0 and i % 20)
    assert sum(not got[i].kept for i in range(3000) if i % 5) <= 0.05 * 2400
    assert all(got[i].kept for i in range(0, 3000, 20))


def texts_for_bpe():
    rng = random.Random(2)
    out = ["", " ", "it's 'tis !!'s '''s they'll", "x<|endoftext|>y <|startoftext|>", "é́ ΑΣ İ K", "ab" * 4000, "!" * 2000, "12 3½ ²", "Ᲊ Ꟛ", "a　b\x1cc\x85d"]
    for _ in range(200):
        out.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x370), rng.randrange(0x370, 0x3000), 32, 0x301])) for _ in range(rng.randrange(50))))
    return out


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(TOKENIZER)
    texts = texts_for_bpe()
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (None, "x")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in bpe.encode_decode(df, TOKENIZER).collect()}
    for i, t in enumerate(texts):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert (got[i].ids, got[i].decoded) == (ids, lib.decode(ids, skip_special_tokens=False))
    assert (got[-1].ids, got[-1].decoded, got[-1].n_tokens) == ([], "", 0)
    for r in bpe.encode_digests(df, TOKENIZER).collect():
        g = got[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (g.n_tokens, hashlib.sha256(" ".join(map(str, g.ids)).encode()).hexdigest(), hashlib.sha256(g.decoded.encode()).hexdigest())


def test_transducer_emits_the_same_ids_in_constant_memory(monkeypatch):
    b = bpe.WordBpe(bpe.read_spec(TOKENIZER))
    rng = random.Random(4)
    long = "".join(rng.choice(["don't", "x'", "re", "\u00e9", "e\u0301", "7", "!!'", "\t", "\u00a0", "\u0391\u03a3", "<|endoftext|>", "<|end", "\u3042", "\uac00\u11a8"]) for _ in range(4000))
    monkeypatch.setattr(bpe, "HOLD", 40)
    for t in [*texts_for_bpe()[:60], prose(rng, 300), long, "y" * 9000, "y" * 3000 + "'re!" * 900 + "z" * 3000, "a'" * 50 + "ll " + "b" * 90]:
        for step in (1, 7, 64):
            s, out, held = bpe.StreamingEncoder(b), [], 0
            for i in range(0, len(t), step):
                out += s.feed(t[i : i + step])
                held = max(held, len(s.held), s.unbroken.held if s.unbroken else 0)
            assert out + s.end() == b.encode_ids(t)
            assert held < 8 * b.lookahead
    assert bpe.decode_text(b, b.encode_ids("Hello, wörld's end")) == "hello , wörld 's end"
    d = bpe.ByteTextDecoder()
    assert "".join(d.feed(bytes([x])) for x in "é\U0001f600".encode()) + d.end() == "é\U0001f600"


def test_lookahead_is_sufficient():
    """Pieces that begin alike have the same tokens up to the lookahead before the first difference, and no less holds for
    a small merge list made to move far."""
    b = bpe.WordBpe(bpe.read_spec(TOKENIZER))
    assert 0 < b.lookahead < 2000
    rng = random.Random(9)
    common = [t.removesuffix(bpe.END) for t in list(b.vocab)[1000:20000] if t.isascii() and t.removesuffix(bpe.END).isalpha()]
    worst = 0
    for _ in range(400):
        head = "".join(rng.choice(common) for _ in range(rng.randint(5, 30)))
        ends = []
        for _ in range(2):
            raw = (head + rng.choice(["", *rng.sample(common, 3)])).encode()
            ends.append([b.tokens[i] for i in b.merge([b.inner[x] for x in raw[:-1]] + [b.final[raw[-1]]])])
        same = 0
        for x, y in zip(*ends, strict=False):
            if x != y:
                break
            same += len(x)
        worst = max(worst, len(head) - same)
    assert worst <= b.lookahead
    merges = [["y", "z"], ["x", "y"], ["w", "xy"], ["v", "wxy"]]  # 'vwxy' + 'z': z takes y, and all before it falls apart
    assert bpe.WordBpe._lookahead(b, merges) == 4
    assert bpe.WordBpe._lookahead(b, [["a", "bc"], ["b", "c"]]) is None and bpe.WordBpe._lookahead(b, [["a", "b"], ["ab", "c"], ["b", "c"], ["a", "bc"]]) is None


def test_stream_of_chunks(spark):
    """Chunks of any size give the ids and the text of the whole."""
    b = bpe.WordBpe(bpe.read_spec(TOKENIZER))
    for t in [*texts_for_bpe()[:40], "y" * 3000, ""]:
        for chunk in (3, 100, 1 << 16):
            d, ids, text = bpe.StreamingDecoder(b), [], ""
            for more in bpe.stream_ids(b, t, chunk):
                ids += more
                text += d.feed(more)
            assert ids == b.encode_ids(t) and text + d.end() == b.decode(ids)


def test_packed_ids_of_many_texts():
    b = bpe.WordBpe(bpe.read_spec(TOKENIZER))
    rng = random.Random(2)
    texts = [*texts_for_bpe(), "", "a" * 16 + " " + "b" * 17, "aaaaaa aaa aa a", " ".join("".join(rng.choice("etaoinsrhé") for _ in range(rng.randint(1, 18))) for _ in range(3000))]
    for t, raw in zip(texts, b.encode_packed(texts), strict=True):
        assert np.frombuffer(raw, np.uint32).tolist() == b.encode_ids(t)


def test_license_scan(docs, spark):
    text = "Licensed under the Apache License, Version 2.0. GNU General Public License v3 or later; MIT license, cc-by 4.0\nSPDX-License-Identifier: MIT"
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, text), (901, "apache  LICENSE apache license")], "doc_id long, text string"))
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert got[900].base_labels == "apache,cc-by,gpl,mit" and {"apache-2.0", "gpl-3.0-or-later", "cc-by-4.0"} <= set(got[900].labels.split(","))
    assert (got[901].n_base, got[901].first_word, got[901].last_word) == (2, 0, 2)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].labels, got[2].score) == (0, 0, None, "", 0.0)
    for i, t in corpus():
        assert got[i].n_words == len(W_ALNUM.findall(lower(t)))
    spans = licenses.detect(decontamination.words("the gnu lesser general public license version 2.1 or later"), licenses.signature_rules())
    assert [s[3] for s in spans] == ["lgpl-2.1-or-later"]
    assert len({(r.keyword, r.pattern.pattern) for r in licenses.signature_rules()}) > 500


LICENSE_TEXTS = {
    "License: MIT": "mit", "Licensed under the MIT": "mit", "is BSD licensed": "bsd", "Some rights reserved.": "cc", "This is proprietary and confidential": "proprietary",
    "GPLv3": "gpl-3.0", "under LGPLv2.1 here": "lgpl-2.1", "Apache-2.0": "apache-2.0", "Creative Commons Zero 1.0": "cc0-1.0", "CC0": "cc0", "see http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd", "https://creativecommons.org/licenses/by-nc-sa/4.0/": "cc-by-nc-sa-4.0", "GPL-2.0-or-later": "gpl-2.0-or-later",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3.0-or-later",
}


@pytest.mark.parametrize("text", LICENSE_TEXTS)
def test_license_signatures(text):
    """Bodies, notices, addresses and short ids; what lies inside a stronger detection is not reported."""
    found = licenses.detect(decontamination.words("some words " + text + " and more"), licenses.signature_rules())
    assert [d[3] for d in found] == [LICENSE_TEXTS[text]]


def test_every_rule_can_match():
    """The keyword of each body is a word that whatever matches it holds."""
    written = [*licenses.BODIES, *licenses.NOTICES]
    assert len({b for _, _, b in written}) == len(written) >= 200
    for label, keyword, body in written:
        fixed = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?]?(?:\{[0-9,]+\})?", " ", body)
        for way in fixed.split("|"):
            assert keyword in re.findall(r"[a-z0-9]+", re.sub(r"[a-z][?]", "", way)), label


def test_license_base_and_containment(spark):
    """All base columns against brute force over random words, repeats and a clashing column; the time is linear."""
    rng = random.Random(12)
    pool = ["MIT", "license", "apache", "License", "gnu", "general", "public", "CC", "by", "x1", "é", "cc-by"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(3, "mit license"), (3, "mit license"), (None, "gnu general public license"), (900, None)]
    got = Counter(tuple(r)[:6] for r in licenses.license_scan(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, labels string")).collect())
    want = Counter()
    for i, t in rows:
        w = W_ALNUM.findall(lower(t))
        places = [(k, label) for p, label in licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        want[i, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))] += 1
    assert got == want
    rules = licenses.signature_rules()
    for _ in range(60):
        ws = [x.encode() for x in (rng.choice(["gpl", "v3", "3", "0", "or", "later", "gnu", "general", "public", "license", "version", "apache", "2", "mit", "x"]) for _ in range(80))]
        found = []
        for r in rules:
            if r.keyword in ws:
                for m in r.pattern.finditer(b" ".join(ws)):
                    start = b" ".join(ws).count(b" ", 0, m.start())
                    found.append((start, start + m[0].count(b" ") + 1, r.priority, r.label))
        found.sort(key=lambda d: (-d[2], d[0] - d[1], d[0], d[3]))
        kept = []
        for d in found:
            if not any(k[0] <= d[0] and d[1] <= k[1] for k in kept):
                kept.append(d)
        assert licenses.detect(ws, rules) == sorted(kept)
    import time

    began = time.process_time()
    assert len(licenses.detect([b"mit", b"license"] * 40_000, rules)) == 40_000
    assert time.process_time() - began < 5


PII_TEXTS = [
    "mail a.b@x.org, c@d.e@f.gh; ..@a-b.co.uk. @x.y a@b", "ip 1.2.3.4 300.1.1.1 1.2.3.4.5.6.7.8 01.02.03.004", "card 4111 1111 1111 1111, 4111-1111-1111-1112 4111111111111111000",
    "call +49 (30) 1234-567 or +1 2 or +44 20 7946 0958 0000000 99", "a@b.c_d@e.f 1@2.3.4.5", "", "+" * 50 + "1" * 5000, "a" * 3000 + "@b.c",
]


def pii_truth(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub(r"\D", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_pii_base(spark):
    df = spark.createDataFrame([*enumerate(PII_TEXTS), (100, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(PII_TEXTS):
        want = pii_truth(t)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
    assert got[100].spans == "" and got[100].n_email == 0
    assert pii.personal_data(df.limit(0)).count() == 0


def test_skip_edges_carry_evidence():
    """A token that looks like a known one takes its label over a distance; an isolated one does not."""
    k = len(pii.KINDS) + 1
    skip = np.full((k, k), -3.0)
    np.fill_diagonal(skip, 3.0)
    model = {"node": np.zeros((pii.N_FEATURES, k), np.float32), "chain": np.zeros((k, k)), "skip": skip}
    text = "+49 30 1234567 said someone " + "word " * 50 + "ref 1234567 and 999"
    nodes = pii.Nodes([text], [pii.base_spans(text)])
    p = pii.marginals(nodes, model)
    by_text = {text[s:e]: p[i] for i, (s, e) in enumerate(zip(nodes.start, nodes.end, strict=True)) if nodes.label[i] == 0}
    assert by_text["1234567"].argmax() == 4 and by_text["1234567"][4] > 0.9
    assert by_text["999"].max() < 0.3


def test_index_shares_follow_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PAGE_WORDS", 10)
    df = spark.createDataFrame([(i, "word " * 96) for i in range(100)], "doc_id long, text string")
    assert [decontamination.shares_of(x) for x in (df.limit(0), df, df.union(df))] == [1, 101, 201]


def test_hot_lines_are_dealt_over_shares(spark, monkeypatch):
    """The same runs go, however few rows a share has; a doubled line doubles its shares."""
    rows = [(i, "hot one\nhot two\nhot three\n" + (f"own {i}\nown {i % 7}\nown {i % 3}" if i % 2 else ""), None) for i in range(60)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    want = sorted(tuple(r) for r in line_dedup.line_report(df).collect())
    monkeypatch.setattr(line_dedup, "SHARE_ROWS", 4)
    assert sorted(tuple(r) for r in line_dedup.line_report(df).collect()) == want
    for n in (40, 80):
        few = spark.createDataFrame([(1, n), (2, 3)], "k long, c long")
        dealt = line_dedup._spread(spark.range(n).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("doc"), F.col("id").alias("uid")), few, "k", n)
        assert dealt.count() == n and f"{-(-n // 4)}" in str(few.withColumn("_n", F.ceil(F.col("c") / 4)).agg(F.max("_n")).first()[0])


def test_field_on_held_out_texts():
    """Precision and recall of the spans that the base patterns do not give, on made texts of another seed."""
    model, rng, hit, said, there = pii.fit(), random.Random(99), 0, 0, 0
    for _ in range(300):
        text, truth = pii.made_text(rng)
        base = pii.base_spans(text)
        nodes = pii.Nodes([text], [base])
        got = set(pii.added_spans(nodes, pii.marginals(nodes, model), [text])[0])
        want = {(k, *x) for k, xs in truth.items() for x in xs if x not in base.get(k, ())}
        hit, said, there = hit + len(got & want), said + len(got), there + len(want)
    assert there > 200 and hit / said > 0.95 and hit / there > 0.9


def unseen_layouts(seed: int, prose: list[str]):
    """Prose of the documents with planted spans whose layouts and cues the field was never trained on, and numbers that are nothing."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    h = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    makers = {
        "phone": [lambda: f"0{d(2)}.{d(4)}.{d(4)}", lambda: f"0 {d(3)} {d(3)} {d(2)} {d(2)}", lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"0{d(2)}-{d(8)}"],
        "secret": [lambda: f"{h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", lambda: f"xq{h(30)}Z", lambda: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(26)) + "7"],
        "iban": [lambda: f"PT{d(2)} {d(4)} {d(4)} {d(11)} {d(2)}", lambda: f"NL{d(2)}ABNA{d(10)}", lambda: f"IT{d(2)}X{d(22)}"],
    }
    cues = {"phone": ["hotline ", "reach me under ", "telephone no. "], "secret": ["credential ", "auth: ", "bearer "], "iban": ["wire it to ", "giro ", "bank account: "]}
    others = [lambda: f"flight LH{d(4)}", lambda: f"room {d(3)}", lambda: f"{d(1)}.{d(3)},{d(2)} EUR", lambda: f"{d(4)}/{d(2)}/{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"lot {d(7)}", lambda: f"{d(5)} Berlin", lambda: f"chapter {d(1)}.{d(2)}"]
    for k in range(300):
        words = re.sub("[0-9@+]", "", rng.choice(prose)).split()[:60] or ["word"]
        kind = rng.choice(list(makers))
        head, tail = " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])
        value = rng.choice(makers[kind])()
        text = f"{head} {rng.choice(others)()} {rng.choice(cues[kind])}"
        span = (kind, len(text), len(text) + len(value))
        yield text + f"{value} {tail} {rng.choice(others)()}.", span


def test_field_on_unseen_layouts():
    """Layouts and cues that no template has: most of what is said is right, but only part is found. Any overlap counts as a find."""
    import pyarrow.parquet as pq

    prose = [t for t in pq.read_table(SF / "documents.parquet").column("text").to_pylist() if t]
    model, right, said, found, there = pii.fit(), 0, 0, 0, 0
    for text, (kind, s, e) in unseen_layouts(5, prose):
        base = pii.base_spans(text)
        nodes = pii.Nodes([text], [base])
        got = [*pii.added_spans(nodes, pii.marginals(nodes, model), [text])[0], *((k, *x) for k, xs in base.items() for x in xs)]
        hits = [k == kind and a < e and s < b for k, a, b in got]
        right, said, found, there = right + sum(hits), said + len(got), found + any(hits), there + 1
    print(f"unseen layouts: precision {right / said:.2f}, recall {found / there:.2f}")
    assert right / said > 0.8 and found / there > 0.5


def test_memory_of_a_text_of_numbers():
    """Some 300 bytes a token, whatever the text."""
    import tracemalloc

    model, rng = pii.fit(), random.Random(1)
    text = " ".join(str(rng.randrange(100, 999)) for _ in range(60_000))
    tracemalloc.start()
    nodes = pii.Nodes([text], [{}])
    p = pii.marginals(nodes, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p.shape == (60_000, len(pii.KINDS) + 1) and peak < 500 * 60_000 + (16 << 20)


def test_field_adds_repeated_numbers_and_secrets(spark):
    key = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"
    text = f"tel. 0301 5550123, born 12.4.1987, pays $12.50 for order no 123456; token = \"{key}\" " + "word " * 300 + f"again 0301 5550123 and {key}."
    rows = [(1, text, "x"), (1, text, "x"), (None, "tel. (030) 5550-1234", "x"), (2, "version 1.2, page 12 of 300 in 1999", "x"), (3, "1." + "0" * 5000 + ".2.3 " + "7" * 5000, "x"), (4, "a@b.cc " * 3000, "x")]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    one = [r.spans.split(",") for r in got if r.doc_id == 1]
    assert len(one) == 2 and one[0] == one[1]
    words = [(k, text[int(s) : int(e)]) for k, s, e in (x.split(":") for x in one[0])]
    assert words == [("phone", "0301 5550123"), ("phone", "0301 5550123"), ("secret", key), ("secret", key)]
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].spans.startswith("phone:") and by_id[2].spans == "" and by_id[3].n_ip == 1 and by_id[4].n_email == 3000


def test_huffman_codes():
    rng = np.random.default_rng(0)
    for counts in ([0, 5], [1, 1], [1, 2, 4, 8, 16], rng.zipf(1.5, 5000) % 1000, [1 << i for i in range(40)]):
        counts = np.array(counts)
        lengths = token_output.code_lengths(counts)
        used = lengths[counts > 0].astype(int)
        assert lengths.max() <= token_output.MAX_BITS and (lengths[counts == 0] == 0).all()
        assert sum(2.0 ** -used) <= 1 + 1e-12
    assert token_output.code_lengths(np.array([1, 1, 2, 4])).tolist() == [3, 3, 2, 1]
    assert not token_output.code_lengths(np.zeros(5, int)).any()


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    docs = [(7, rng.integers(0, 300, 1000).astype(np.uint32)), (None, np.zeros(0, np.uint32)), (9, np.array([5], np.uint32)), (9, rng.integers(0, 9, 5000).astype(np.uint32))]
    counts = np.bincount(np.concatenate([x for _, x in docs]), minlength=400)
    lengths = token_output.code_lengths(counts)
    raw = token_output.pack_block(docs, lengths, token_output.canonical_codes(lengths))
    back = token_output.unpack_block(raw, token_output.decode_table(lengths))
    assert [d for d, _ in back] == [d for d, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(docs, back, strict=True))


@pytest.mark.parametrize("chars", [500, 2000, 1 << 22])
def test_token_output(spark, monkeypatch, chars):
    """Against the library: null, smallest and repeated ids, one id with a third of the text, a long text, a clashing column."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_output, "RANGE_CHARS", chars)  # read on the driver
    rng, lib = random.Random(8), Tokenizer.from_file(TOKENIZER)
    lib.no_truncation()
    rows = [(i * 3, prose(rng, rng.randint(0, 60))) for i in range(80)] + [(500, None), (501, ""), (502, "x<|endoftext|>"), (-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    rows += [(None, prose(rng, 20)) for _ in range(30)] + [(77, prose(rng, 30)) for _ in range(40)] + [(78, "same")] * 50 + [(600, prose(rng, 30_000)), *zip(range(700, 760), texts_for_bpe(), strict=False)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, part string").repartition(5)
    got = token_output.token_output(df, TOKENIZER).collect()
    want = Counter()
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at, got = 0, sorted(got, key=lambda r: r.start)
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)


@pytest.mark.parametrize("part", [1 << 22, 40])
def test_pieces_cut_in_numpy(monkeypatch, part):
    """Ids of texts cut and looked up together are those of the pieces one by one."""
    monkeypatch.setattr(bpe, "PART_BYTES", part)
    b, rng = bpe.WordBpe(bpe.read_spec(TOKENIZER)), random.Random(8)
    some = [*"ab's tmdrevl0123\n-\x00\u00e9\u00b2\u0130\u00df\u03a3\u03ac\u6f22<|>\u0301\x85\xa0 '", "<|endoftext|>", "'re", "'ll", "'s", "'d", "x" * 20, "y" * 600, "dont't", "l'\u00e9t"]
    for _ in range(600):
        texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        ids, n = b.encode_arrays(texts)
        want = [b.encode_ids(t) for t in texts]
        assert ids.tolist() == [i for x in want for i in x] and n.tolist() == list(map(len, want)), texts


def test_token_output_of_nothing(spark):
    assert token_output.token_output(spark.createDataFrame([], "doc_id long, text string"), TOKENIZER).count() == 0


URLS = ["http://A.com/en/x", "https://b.example.com/en/71?x", "http://example.com/en/8", "x", None, "http://net/de/", "ftp://a.net#f/de/", "http://example.net/de/8#z", "//org/es/", "http://q.ORG/es/?p", "http://com", "://com/en/", "http://.com/en/"]


def test_url_filter(spark):
    df = spark.createDataFrame([*enumerate(URLS)], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in url_filter.url_verdicts(df).collect()}
    for i, u in enumerate(URLS):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path, host = re.split("[?#]", rest[len(host) :])[0], lower(host)
        fits = max(((len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *fits[1:])
    assert all(r.verdict == "block" and r.rule is None for r in url_filter.url_verdicts(df, rules=[], default="block").collect())


def test_url_filter_on_repeats_and_long_urls(spark):
    long = "https://" + "a." * 300 + "EXAMPLE.com/en/7" + "x" * 50_000
    rows = [(1, long, "x", "y"), (1, long, "x", "y"), (None, "http://b.net/de/1", "x", "y"), (2, "http://\u00c9.org/es/", "x", "y")]
    got = url_filter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")).collect()
    assert Counter((r.page_id, r.rule, r.verdict) for r in got) == Counter({(1, "example.com/en/7", "allow"): 2, (None, "net/de/", "allow"): 1, (2, "org/es/", "block"): 1})
    ruled = url_filter.url_verdicts(spark.createDataFrame([(1, "http://a.\u00c9X/")], "page_id long, url string"), [("block", "\u00c9X", "/")]).collect()
    assert (ruled[0].verdict, ruled[0].rule) == ("block", "\u00c9x/")


def test_cascade_has_no_errors(spark):
    """Exact membership over the universe, and a size that follows the list."""
    keys = [url_filter.key_hash((f"h{i}.com", "/")) for i in range(20_000)]
    listed = keys[:300]
    c = url_filter.build_cascade(listed, spark.createDataFrame([(bytearray(k),) for k in keys], "h binary"), len(keys))
    assert [k for k in keys if k in c] == listed
    assert sum(x.bits for x in c.levels) < 40 * len(listed)


def contamination_truth(rows, items, size=10):
    windows = {}
    for i, t in items:
        w = W_ALNUM.findall(lower(t))
        n = min(size, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for d, t in rows:
        w, hit, found = W_ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[tuple(w[p : p + n])]
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_contamination(spark, docs):
    rows = corpus()
    texts = dict(rows)
    items = [(1, " ".join(texts[30].split()[10:40])), (2, "one TWO"), (3, None), (4, ""), (5, "a a a a a a a a a a a a"), (12, "--y" + "y" * 2999), (1, "one two")]
    df = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontamination.contamination(docs, df).collect()) == contamination_truth(rows, items)
    kept = decontamination.clean_documents(docs, df)
    assert kept.columns == docs.columns
    want = Counter(d for d, *_, bad in contamination_truth(rows, items).elements() if not bad)
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert decontamination.contamination(docs, df.limit(0)).filter("contaminated").count() == 0


def test_contamination_in_item_blocks(spark, monkeypatch):
    rows = [(i, t) for i, t in dict(corpus()).items() if i is not None]
    items = [(i, " ".join(dict(rows)[k].split()[5:30])) for i, k in enumerate((30, 31, 32, 0))]
    monkeypatch.setattr(decontamination, "ITEM_BLOCK_WORDS", 20)
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (20,))
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == contamination_truth(rows, items)


def test_contamination_of_repeated_rows_in_item_blocks(spark, monkeypatch):
    rows = corpus()
    items = [(i, " ".join(dict(rows)[k].split()[5:30])) for i, k in enumerate((30, 31, 32, 0))]
    monkeypatch.setattr(decontamination.item_blocks, "__defaults__", (20,))
    table = spark.createDataFrame(items, "item_id long, text string")
    assert len(list(decontamination.item_blocks(table))) > 1
    rows += [(None, dict(rows)[30]), (None, None), (7, dict(rows)[31])]
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), table)
    assert Counter(tuple(r) for r in got.collect()) == contamination_truth(rows, items)


def test_index_is_stored_by_term(spark, tmp_path, monkeypatch):
    """Every word of every document is in the index once, in the bucket of its term, whatever the pages."""
    monkeypatch.setattr(decontamination, "PAGE_WORDS", 200)
    rows = [(i, t) for i, t in corpus() if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.xxhash64("text")).repartition(2)
    got = decontamination.write_index(df, str(tmp_path / "index")).collect()
    pages = {r.page: r for r in got if r.bucket == -1}
    assert len(pages) > 5 and Counter(d for r in pages.values() for d in r.docs) == Counter(i for i, _ in rows)
    back = {p: [0] * (sum(r.sizes) + len(r.sizes)) for p, r in pages.items()}
    for r in got:
        if r.bucket >= 0:
            terms, counts, places = (np.frombuffer(x, k) for x, k in ((r.terms, "<u8"), (r.counts, "<u4"), (r.positions, "<u4")))
            assert (terms >> np.uint64(64 - decontamination.BUCKET_BITS) == r.bucket).all()
            for t, at in zip(np.repeat(terms, counts).tolist(), places.tolist(), strict=True):
                assert back[r.page][at] == 0
                back[r.page][at] = t
    by_doc = Counter()
    for p, r in pages.items():
        at = 0
        for d, n in zip(r.docs, r.sizes, strict=True):
            by_doc[d, tuple(back[p][at : at + n])] += 1
            at += n + 1
    assert by_doc == Counter((i, tuple(decontamination.term_lists([decontamination.word_bytes(t)])[0].tolist())) for i, t in rows)


def test_proximity(spark):
    d = spark.createDataFrame([(1, "a x b y c z z z z c b a"), (2, "a b"), (3, None)], "doc_id long, text string")
    i = spark.createDataFrame([(9, "c b a")], "item_id long, text string")
    got = sorted(tuple(r) for r in decontamination.proximity(d, i, 5).collect())
    assert got == [(1, 9, 0), (1, 9, 9)]


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_rules(empty, labels).count() == 0
    assert ngram_join.jaccard_join(empty).count() == 0
    assert suffix_dedup.substring_dedup(empty).count() == 0
    assert line_dedup.line_report(empty).count() == 0
    assert bpe.encode_digests(empty, TOKENIZER).count() == 0
    assert licenses.license_scan(empty).count() == 0
    assert url_filter.url_verdicts(spark.createDataFrame([], "page_id long, url string")).count() == 0
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontamination.contamination(empty, items).count() == 0 and decontamination.clean_documents(empty, items).count() == 0
    assert ngram_join.keep_one(empty).count() == 0 and line_dedup.dedup_lines(empty).count() == 0 and quality.keep_good(empty, labels).count() == 0
