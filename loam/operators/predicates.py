"""Selection: filter expressions of the user's small language, gates of ranked retrieval, and validity predicates."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import model
from ..functions import text as X

_COMPARE = re.compile(r"^(<=|>=|!=|<|>)\s*(.*)$", re.S)


def match_value(actual: Column, pattern: str) -> Column:
    """``<,>,<=,>=,!=`` compare numbers only, and a value that is no number does not match; else string equality."""
    if m := _COMPARE.match(pattern):
        try:
            limit = float(m[2])
        except ValueError:
            return F.lit(False)
        number = actual.cast("string").try_cast("double")
        ops = {"<": number < limit, ">": number > limit, "<=": number <= limit, ">=": number >= limit, "!=": number != limit}
        return F.coalesce(ops[m[1]], F.lit(False))
    return F.coalesce(actual.cast("string") == pattern, F.lit(False))


def find(df: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """Rows that match all filters. Lists match by membership of the string; a missing field or null never matches."""
    conds = []
    for name, pattern in filters:
        if name not in df.columns:
            conds.append(F.lit(False))
        elif isinstance(df.schema[name].dataType, T.ArrayType):
            conds.append(F.coalesce(F.array_contains(F.col(name).cast("array<string>"), pattern), F.lit(False)))
        else:
            conds.append(match_value(F.col(name), pattern))
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def weak(df: DataFrame, confidence: str, status: str, threshold: float = 0.5, weak_statuses: tuple[str, ...] = ("proposed", "weakly_supported")) -> DataFrame:
    """Confidence below the threshold (absent or no number: 1.0) or a weak status."""
    value = F.coalesce(F.col(confidence).cast("string").try_cast("double"), F.lit(1.0))
    return df.filter((value < threshold) | F.coalesce(F.col(status).isin(*weak_statuses), F.lit(False)))


def ready_to_test(df: DataFrame, status: str = "status", linked: str = "linked_experiments", priority: str = "priority") -> DataFrame:
    """Proposed rows without linked experiments, by falling priority (3 if absent)."""
    none = F.size(F.coalesce(F.col(linked), F.array().cast("array<string>"))) == 0
    return df.filter((F.col(status) == "proposed") & none).orderBy(F.coalesce(F.col(priority).try_cast("int"), F.lit(3)).desc(), "_ord")


def not_old_and_rarely_cited(year: Column, citations: Column, before: int = 1990, most: int = 100) -> Column:
    """False for old rows with few citations; rows without a year pass."""
    return F.coalesce(~((year < before) & (F.coalesce(citations, F.lit(0)) <= most)), F.lit(True))


def since_year(df: DataFrame, year: str, since: int | None) -> DataFrame:
    """Rows from a year on; rows without a year go. No year given: all rows."""
    return df.filter(F.col(year) >= since) if since else df


def term_groups(text: Column, groups: list[str]) -> Column:
    """Every group must have an alternative (``a|b``) in the text as whole words, any case, white space collapsed."""
    hay = F.regexp_replace(F.lower(text), r"(?U)\s+", " ")
    conds = []
    for g in groups:
        parts = [re.escape(p.strip().lower()) for p in g.split("|") if p.strip()]
        if parts:
            conds.append(hay.rlike(rf"(?U)(?<!\w)(?:{'|'.join(parts)})(?!\w)"))
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def topic_gate(relevance: Column, matches: Column, queries: list[str], least: float = 0.16) -> Column:
    """Enough of the topic: one match for a query of at most two tokens, else two, and the least relevance."""
    sizes = [len({w for w in re.findall(r"[a-z][a-z0-9-]+", q.lower()) if w not in X.TOPIC_STOP_WORDS}) for q in queries]
    shortest = min([n for n in sizes if n], default=0)
    return (matches >= (1 if shortest <= 2 else 2)) & (relevance >= least)


def heavily_related(sources: Column, anchors: Column, influential: Column) -> Column:
    """An influential edge, two anchors, two channels, or a direct reference or citation."""
    named = F.filter(anchors, lambda a: a != "")
    direct = F.arrays_overlap(sources, F.array(F.lit("literature_reference"), F.lit("literature_citation")))
    return F.coalesce(influential, F.lit(False)) | (F.size(F.array_distinct(named)) >= 2) | (F.size(F.array_distinct(sources)) >= 2) | F.coalesce(direct, F.lit(False))


def under_paths(path: Column, only: list[str], slash_needed: bool = True) -> Column:
    """The path itself, or below a folder; with ``slash_needed`` a folder must end in '/'."""
    conds = [(path == p) | path.startswith(p if p.endswith("/") or slash_needed else p + "/") if p.endswith("/") or not slash_needed else path == p for p in only]
    return reduce(lambda a, b: a | b, conds, F.lit(not only))


def not_conflict_copy(name: Column) -> Column:
    """File names that are no copies left by a sync conflict."""
    return ~F.lower(name).contains("nsconflict")


def endpoint_matches(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges with ``endpoint_ok``, ``is_symmetric``, ``needs_confidence`` and ``legacy`` from the registry (some twenty rows)."""
    reg = types.select("type", F.col("from_kind").alias("_f"), F.col("to_kind").alias("_t"), "direction", F.col("confidence").alias("_c"))
    a, b = X.node_kind("from_id"), X.node_kind("to_id")
    paper, concept = (a == "papers") & (b == "papers"), (a == "papers") & (b == "concepts")
    return edges.join(F.broadcast(reg), "type", "left").withColumns({
        "known": F.col("_f").isNotNull(),
        "endpoint_ok": F.col("_f").isNull() | (F.col("_f").isin("*") | (F.col("_f") == a)) & (F.col("_t").isin("*") | (F.col("_t") == b)),
        "is_symmetric": F.coalesce(F.col("direction") == "symmetric", F.lit(False)),
        "needs_confidence": F.coalesce(F.col("_c") == "required", F.lit(False)),
        "legacy": F.when(paper, F.col("type").isin(model.LEGACY_PAPER_PAPER)).when(concept, F.col("type").isin(model.LEGACY_PAPER_CONCEPT)).otherwise(False),
    }).withColumnsRenamed({"_f": "expected_from", "_t": "expected_to"}).drop("_c")


def edge_errors(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``errors``: what forbids a write. Unknown type, wrong endpoint, a paper with itself, confidence or evidence missing."""
    e = endpoint_matches(edges, types)
    errors = F.array_compact(F.array(
        F.when(~F.col("known") & ~F.col("type").isin(model.LEGACY_TYPES), F.lit("unknown type")),
        F.when(~F.col("endpoint_ok"), F.lit("wrong endpoint")),
        F.when((F.col("expected_from") == "papers") & (F.col("expected_to") == "papers") & (F.col("from_id") == F.col("to_id")), F.lit("self edge")),
        F.when(F.col("needs_confidence") & ~F.coalesce(F.col("confidence").isin(model.CONFIDENCES), F.lit(False)), F.lit("confidence")),
        F.when(F.col("needs_confidence") & (F.trim(F.coalesce("evidence", F.lit(""))) == ""), F.lit("evidence")),
    ))
    return e.withColumn("errors", errors)


def allowed_transition(changes: DataFrame, transitions: DataFrame) -> DataFrame:
    """kind, old_status, new_status with ``status``: ok, not_allowed, or the precondition that fails.

    Preconditions: an idea is tested only with linked experiments and failed only with a reason; an experiment is
    completed only with a key result; a claim is supported only with a strong piece of evidence. Columns that are not
    there count as absent.
    """

    def has(name: str) -> Column:
        return F.coalesce(F.trim(F.col(name).cast("string")) != "", F.lit(False)) if name in changes.columns else F.lit(False)

    def some(name: str) -> Column:
        return F.coalesce(F.size(name) > 0, F.lit(False)) if name in changes.columns else F.lit(False)

    strong = F.coalesce(F.exists("evidence", lambda x: x["strength"] == "strong"), F.lit(False)) if "evidence" in changes.columns else F.lit(False)
    t = transitions.withColumn("_ok", F.lit(True))
    out = changes.join(F.broadcast(t), ["kind", "old_status", "new_status"], "left")  # the life cycles have a dozen rows
    new = F.col("new_status")
    status = (
        F.when(F.col("_ok").isNull(), "not_allowed")
        .when((F.col("kind") == "ideas") & (new == "tested") & ~some("linked_experiments"), "needs linked_experiments")
        .when((F.col("kind") == "ideas") & (new == "failed") & ~has("reason"), "needs reason")
        .when((F.col("kind") == "experiments") & (new == "completed") & ~has("key_result"), "needs key_result")
        .when((F.col("kind") == "claims") & (new == "supported") & ~strong, "needs strong evidence")
        .otherwise("ok")
    )
    return out.withColumn("status", status).drop("_ok")


def populated(c: Column, least: int = 40) -> Column:
    """A section with enough text that is no placeholder."""
    x = F.array_join(X.words(F.lower(c)), " ")
    return (F.length(x) >= least) & ~F.btrim(x, F.lit("-*. ")).isin(X.PLACEHOLDERS)


def card_ok(c: dict[str, Column]) -> Column:
    """Constraints of an evidence card: id E1.., labels not empty, slug form."""
    filled = reduce(lambda a, b: a & b, [F.coalesce(F.trim(c[k]) != "", F.lit(False)) for k in ("use_label", "short_label", "source_section", "excerpt")])
    return F.coalesce(c["evidence_id"].rlike(r"^E[1-9]\d*$"), F.lit(False)) & filled & F.coalesce(c["source_slug"].rlike(r"^[A-Za-z0-9][A-Za-z0-9_.+-]*$"), F.lit(False))


def looks_like_filename(c: Column) -> Column:
    tokens = F.size(X.words(F.regexp_replace(c, "[_-]", " ")))
    return c.rlike(r"[/\\]") | F.lower(c).endswith(".pdf") | (c.rlike(r"\d") & (c.rlike("[_-]") | (tokens <= 3)))


def has_marker(value: Column, markers: tuple[str, ...] = ("[[", "]]")) -> Column:
    """Whether a marker occurs anywhere in a nested value."""
    said = F.to_json(F.struct(value.alias("v")))
    return reduce(lambda a, b: a | b, [F.contains(said, F.lit(m)) for m in markers])


def pick_result(rows: DataFrame, wanted_id: Column, wanted_name: Column) -> DataFrame:
    """The first row with the id, else the first with the name, else the only row; else none. Columns job, data_id, file_name, _ord."""
    level = F.when(F.col("data_id") == wanted_id, 0).when(F.col("file_name") == wanted_name, 1).otherwise(2)
    tagged = rows.withColumn("_level", level)
    best = tagged.groupBy("job").agg(F.min(F.struct("_level", "_ord", "data_id", "file_name")).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.filter((F.col("b._level") < 2) | (F.col("n") == 1)).select("job", "b.data_id", "b.file_name", "b._level")


def choose_candidate(rows: DataFrame, reasons: tuple[str, ...] = ("item-key", "doi", "exact-title", "title-containment"), least: float = 0.88) -> DataFrame:
    """source, candidate, outcome: the only exact path match; several: ambiguous; else the best score of an accepted reason."""
    best = F.max(F.when((F.col("score") >= least) & F.col("reason").isin(*reasons), F.struct("score", -F.col("_ord"), "candidate")))
    g = rows.groupBy("source").agg(F.count_if("path_match").alias("n"), F.min(F.when(F.col("path_match"), F.struct("_ord", "candidate"))).alias("p"), best.alias("s"))
    return g.select(
        "source",
        F.when(F.col("n") == 1, F.col("p.candidate")).when(F.col("n") == 0, F.col("s.candidate")).alias("candidate"),
        F.when(F.col("n") > 1, "ambiguous").when(F.col("n") == 1, "path").when(F.col("s").isNotNull(), "score").otherwise("none").alias("outcome"),
    )
