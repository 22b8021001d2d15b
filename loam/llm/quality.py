"""Quality rules with risk-controlled cutoffs (operator 1). DataFrame functions only.

Each rule is a badness score of a document and a fixed grid of cutoffs, laxest first. Labelled documents of good
quality form the holdout of their stratum. A cutoff is certified for a stratum when the exact binomial test rejects
"the rule removes more than ``alpha`` of the stratum's good documents": with k of n good documents above the cutoff,
P(Bin(n, alpha / rules) <= k) must not exceed the level. Multiple testing is corrected twice: the level ``delta`` is
split over all (stratum, rule) chains (Bonferroni), and inside a chain the cutoffs are tested from the laxest on and
the first failure ends the chain (fixed sequence), so that with probability 1 - delta no stratum loses more than
``alpha`` of its good documents to all rules together. A stratum with too few labels certifies nothing and loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_enough, tune

ALPHA, DELTA = 0.05, 0.05
MOST_STRATA = 100_000
#: Rule -> its cutoffs, from the laxest to the strictest; a document above the cutoff is rejected.
GRIDS: dict[str, list[float]] = {
    "symbol_ratio": [4.0, 3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05],
    "upper_ratio": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "mean_word": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0],
}
GAP = "[\\x20\\x09-\\x0D]+"


def _let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body`` on it; a plain reference inside a lambda is evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more: sort (window, position), keep equal neighbours, add up the covered words."""

    def covered(grams: Column) -> Column:
        n = F.size(grams)
        same = F.filter(
            grams,
            lambda g, i: ((i > 0) & (F.get(grams, i - 1)["g"] == g["g"])) | ((i < n - 1) & (F.get(grams, i + 1)["g"] == g["g"])),
        )
        at = F.sort_array(F.transform(same, lambda g: g["i"]))
        start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-3).alias("last"))
        return F.aggregate(
            at, start,
            lambda a, p: F.struct((a["total"] + F.least(F.lit(3), p - a["last"])).alias("total"), p.alias("last")),
            lambda a: a["total"],
        )

    def grams(w: Column) -> Column:
        return F.sort_array(F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")),
        ))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(_let(words, lambda w: _let(grams(w), covered)))


def features(docs: DataFrame, stratum: str = "lang", row: bool = False) -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the rule scores.

    A null or empty text has no words: all counts 0, base_failed true. Repeated rows give repeated results. Columns
    other than doc_id, text and the stratum are not read; a missing stratum column or a null stratum is the stratum ''.
    With ``row`` the whole input row comes along as a struct of that name.
    """
    keep = ["doc_id", "stratum", *["row"] * row]
    by = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] * row
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by.alias("stratum"), text.alias("t"), *whole)
    split = base.select(*keep, "t", F.array_remove(F.split("t", GAP), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    dup_lines = _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    counted = split.select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        dup_lines.alias("n_dup_lines"),
        _repeat_words(F.col("w")).alias("n_repeat_words"),
        F.length(F.regexp_replace("t", "[^A-Z]", "")).cast("long").alias("n_upper"),
        F.size(lines).cast("long").alias("n_lines"),
    )
    n = F.greatest(F.col("n_words"), F.lit(1))
    return counted.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_ratio": F.col("n_symbols") / n,
        "upper_ratio": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
        "mean_word": F.col("word_chars") / n,
    })


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed term by term in logarithms; only called for k below n * p, where it is short."""
    odds = math.log(p / (1 - p))
    first = n * F.lit(math.log1p(-p))
    start = F.struct(first.alias("term"), first.alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        high, low = F.greatest(a["total"], term), F.least(a["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>"))
    return F.exp(F.aggregate(steps, start, step, lambda a: a["total"]))


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good. Labels with a null doc_id or quality count as absent; a document labelled
    twice is good if any label says so."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("q")).filter("doc_id is not null and q is not null")
    return known.groupBy("doc_id").agg(F.max("q").alias("q")).filter("q >= 1").select("doc_id")


def certified_cutoffs(scored: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, rule, cutoff: the strictest certified cutoff of each chain; no row where none is certified.

    Documents that the base rules reject are no evidence for the method, so the holdout is the good ones that pass.
    """
    held = scored.filter(~F.col("base_failed")).join(good_ids(labels), "doc_id", "left_semi")
    rules = list(GRIDS)
    sums = [F.sum((F.col(r) > c).cast("long")).alias(f"{r}_{i}") for r in rules for i, c in enumerate(GRIDS[r])]
    wide = held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *sums)
    tests = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{i}").alias("k"))
        for r in rules for i, c in enumerate(GRIDS[r])
    ])
    long = wide.select("stratum", "n", F.explode(tests).alias("x")).select("stratum", "n", "x.*")
    per_rule = alpha / len(rules)
    strata = max(1, wide.count())
    tested = long.withColumn(
        "ok",
        F.when(F.col("k") >= F.col("n") * per_rule, False).otherwise(
            binomial_tail(F.col("n"), F.col("k"), per_rule) <= delta / (strata * len(rules))
        ),
    )
    ended = tested.groupBy("stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("step"))).alias("stop"), F.max("step").alias("top"))
    passed = tested.join(ended, ["stratum", "rule"]).filter(F.col("step") < F.coalesce("stop", F.col("top") + 1))
    return passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def apply_rules(scored: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``kept`` and ``failed_rules``. The cutoff table (a row for each stratum) is broadcast up to MOST_STRATA rows."""
    wide = cutoffs.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cut"))
    joined = scored.join(F.broadcast(wide) if small_enough(wide, MOST_STRATA) else wide, "stratum", "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.try_element_at("cut", F.lit(r)), F.lit(r)) for r in GRIDS]))
    return joined.withColumn("failed_rules", F.array_join(failed, ",")).withColumn(
        "kept", ~F.col("base_failed") & (F.size(failed) == 0)
    )


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules; one row per input row.

    Empty documents or labels: an empty result, or base rules only. See ``features`` for nulls.
    """
    tune(docs.sparkSession)
    scored = features(docs, stratum).checkpoint()
    judged = apply_rules(scored, certified_cutoffs(scored, labels, alpha, delta))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The input rows that the rules keep, with all their columns. A row without doc_id is judged like any other."""
    tune(docs.sparkSession)
    good = good_ids(labels)
    good = F.broadcast(good) if small_enough(good, MOST_STRATA * 10) else good
    held = docs.filter("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long")).join(good, "doc_id", "left_semi")
    cutoffs = certified_cutoffs(features(held, stratum).drop("n_upper", "n_lines").checkpoint(), labels, alpha, delta)
    # a filter is pushed below projections with all that it names, but not below a generator: the features are made once
    scored = features(docs, stratum, row=True).select(F.explode(F.array(F.struct("*"))).alias("x")).select("x.*")
    return apply_rules(scored, cutoffs).filter("kept").select("row.*")
