"""Registries of the knowledge-graph model: kinds, edge types, field constraints, life cycles and budgets.

They are plain data; ``*_table`` turn them into small DataFrames, so users extend a registry by adding rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entity kinds, edge vocabulary, field constraints, life cycles and context budgets.
KINDS = ["papers", "concepts", "topics", "people", "ideas", "experiments", "claims", "Summary", "foundations"]
CONFIDENCES = ["high", "medium", "low"]
CITATION_SOURCES = ["literature_api", "parsed_bib", "manual"]
LEGACY_TYPES = ["extends", "supersedes"]
LEGACY_PAPER_PAPER = ["extends", "supersedes", "inspired_by", "contradicts", "supports"]
LEGACY_PAPER_CONCEPT = ["supports", "extends"]
#: type, from_kind, to_kind, direction, confidence, workflow
EDGE_TYPES = [
    ("same_problem_as", "papers", "papers", "symmetric", "required", "ingest"),
    ("similar_method_to", "papers", "papers", "symmetric", "required", "ingest"),
    ("complementary_to", "papers", "papers", "symmetric", "required", "ingest"),
    ("builds_on", "papers", "papers", "directed", "required", "ingest"),
    ("compares_against", "papers", "papers", "directed", "required", "ingest"),
    ("improves_on", "papers", "papers", "directed", "required", "ingest"),
    ("challenges", "papers", "papers", "directed", "required", "ingest"),
    ("surveys", "papers", "papers", "directed", "required", "ingest"),
    ("introduces_concept", "papers", "concepts", "directed", "required", "ingest"),
    ("uses_concept", "papers", "concepts", "directed", "required", "ingest"),
    ("extends_concept", "papers", "concepts", "directed", "required", "ingest"),
    ("critiques_concept", "papers", "concepts", "directed", "required", "ingest"),
    ("supports", "*", "*", "directed", "none", "claim_evidence"),
    ("contradicts", "*", "*", "directed", "none", "claim_evidence"),
    ("tested_by", "*", "*", "directed", "none", "experiment"),
    ("invalidates", "*", "*", "directed", "none", "experiment"),
    ("addresses_gap", "*", "*", "directed", "none", "idea"),
    ("derived_from", "*", "*", "directed", "none", "provenance"),
    ("inspired_by", "*", "*", "directed", "none", "idea"),
]
SYMMETRIC_TYPES = [row[0] for row in EDGE_TYPES if row[3] == "symmetric"]
RESEARCH_MODES = ["theory", "computation", "experiment"]
#: Field of detail tags that a paper needs for each of its modes.
DETAIL_FIELDS = {"theory": "theory_tags", "computation": "computation_tags", "experiment": "experiment_tags"}
USE_LABELS = ["Problem", "Method", "Results", "Limitations", "Concept", "Claim"]
BIBTEX_FIELDS = ["author", "title", "year", "journal", "booktitle", "publisher", "school", "institution", "howpublished", "volume", "number", "pages", "doi"]
REQUIRED_FIELDS = {
    "papers": ["title", "slug", "paper_type", "tags", "research_modes", "research_object_tags", "importance"],
    "concepts": ["title", "tags", "maturity", "key_papers"],
    "topics": ["title", "tags"],
    "people": ["name", "tags"],
    "Summary": ["title", "scope", "key_topics"],
    "ideas": ["title", "slug", "status", "origin", "tags", "priority"],
    "experiments": ["title", "slug", "status", "target_claim", "hypothesis", "tags"],
    "claims": ["title", "slug", "status", "confidence", "tags", "source_papers", "evidence"],
    "foundations": ["title", "slug", "domain", "status"],
}
VALID_VALUES = {
    "papers.importance": ["1", "2", "3", "4", "5"],
    "papers.paper_type": ["paper", "review", "book", "degree_thesis", "preprint", "report", "chapter", "dataset", "other"],
    "concepts.maturity": ["stable", "active", "emerging", "deprecated"],
    "ideas.status": ["proposed", "in_progress", "tested", "validated", "failed"],
    "ideas.priority": ["1", "2", "3", "4", "5"],
    "experiments.status": ["planned", "running", "completed", "abandoned"],
    "experiments.outcome": ["succeeded", "failed", "inconclusive", ""],
    "claims.status": ["proposed", "weakly_supported", "supported", "challenged", "deprecated"],
    "foundations.status": ["mainstream", "historical"],
}
FIELD_DEFAULTS = {
    "papers": {"paper_type": "paper", "tags": "[]", "research_modes": "[]", "research_object_tags": "[]", "importance": "3"},
    "concepts": {"tags": "[]", "maturity": "active", "key_papers": "[]"},
    "topics": {"tags": "[]"},
    "people": {"tags": "[]"},
    "Summary": {"key_topics": "[]"},
    "ideas": {"tags": "[]", "priority": "3"},
    "experiments": {"tags": "[]"},
    "claims": {"tags": "[]", "confidence": "0.5"},
    "foundations": {"status": "mainstream"},
}
TRANSITIONS = {
    "ideas": {"proposed": ["in_progress"], "in_progress": ["tested"], "tested": ["validated", "failed"]},
    "experiments": {"planned": ["running"], "running": ["completed", "abandoned"]},
    "claims": {
        "proposed": ["weakly_supported", "challenged"],
        "weakly_supported": ["supported", "challenged", "deprecated"],
        "supported": ["challenged", "deprecated"],
        "challenged": ["weakly_supported", "supported", "deprecated"],
    },
}
AUTO_DATE_FIELDS = {("ideas", "failed"): "date_resolved", ("ideas", "validated"): "date_resolved", ("experiments", "completed"): "date_completed"}
#: kind, header field (None: links in the text), kind of the target, its section, line, how a target shows that it knows.
BACK_LINKS = [
    ("concepts", "key_papers", "papers", "## Related", "- [[%s]]", "link"),
    ("papers", None, "people", "## Key papers", "- [[%s]]", "link"),
    ("claims", "source_papers", "papers", "## Related", "- [[%s]]", "link"),
    ("ideas", "origin_gaps", "claims", "## Linked ideas", "- [[%s]]", "link"),
    ("experiments", "target_claim", "claims", "## Evidence summary", "- Tested by: [[%s]]", "name"),
]
#: Ways in which pages name a source file; the first is the folder itself.
SOURCE_LINK_PREFIXES = ["sources/papers/", "@configured-sources-papers/", "@wiki-sources-papers/", "wiki/sources/papers/"]
SECTIONS = ["claims", "gaps", "failed", "papers", "experiments", "edges", "stale"]
CONTEXT_BUDGETS = {
    "ideation": [1500, 2000, 2000, 1000, 500, 500, 500],
    "experiment": [2500, 500, 500, 1000, 2500, 500, 0],
    "writing": [2000, 500, 200, 2500, 500, 800, 0],
    "review": [2500, 1000, 500, 1000, 1500, 500, 500],
    "general": [2000, 1500, 1500, 2000, 0, 1000, 0],
}

EDGE_SCHEMA = "from_id string, to_id string, type string, evidence string, date string, confidence string, symmetric boolean"
CITATION_SCHEMA = "from_id string, to_id string, type string, source string, date string"
FINDING_SCHEMA = "level string, category string, file string, message string, fixable boolean"
PAGE_SCHEMA = "kind string, slug string, path string, header string, body string, parse_mode string, _ord long"


def edge_types_table(spark: SparkSession) -> DataFrame:
    """type, from_kind, to_kind, direction, confidence, workflow: one row for each of the registered edge types."""
    return spark.createDataFrame(EDGE_TYPES, "type string, from_kind string, to_kind string, direction string, confidence string, workflow string")


def edge_types_matching(spark: SparkSession, **wanted: str | None) -> DataFrame:
    """Rows of the edge registry that equal every given attribute; None is a wildcard."""
    out = edge_types_table(spark)
    for name, value in wanted.items():
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out


def valid_edge_types(spark: SparkSession) -> DataFrame:
    """Registered and legacy types, distinct."""
    return edge_types_table(spark).select("type").union(spark.createDataFrame([(t,) for t in LEGACY_TYPES], "type string")).distinct()


def required_fields_table(spark: SparkSession) -> DataFrame:
    rows = [(k, i, f, FIELD_DEFAULTS.get(k, {}).get(f)) for k, fs in REQUIRED_FIELDS.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "kind string, pos int, field string, default string")


def valid_values_table(spark: SparkSession) -> DataFrame:
    rows = [(*k.split("."), v) for k, vs in VALID_VALUES.items() for v in vs]
    return spark.createDataFrame(rows, "kind string, field string, value string")


def transitions_table(spark: SparkSession) -> DataFrame:
    rows = [(k, a, b) for k, m in TRANSITIONS.items() for a, bs in m.items() for b in bs]
    return spark.createDataFrame(rows, "kind string, old_status string, new_status string")


def budgets_table(spark: SparkSession) -> DataFrame:
    rows = [(p, i, s, b) for p, bs in CONTEXT_BUDGETS.items() for i, (s, b) in enumerate(zip(SECTIONS, bs, strict=True))]
    return spark.createDataFrame(rows, "purpose string, pos int, section string, budget int")


CANDIDATE_SCHEMA = (
    "id string, doi string, title string, abstract string, tldr string, venue string, url string, year int, citations long, influential long,"
    " max_h_index long, authors array<string>, fields array<string>, sources array<string>, anchors array<string>, providers array<string>,"
    " queries array<string>, influential_edge boolean, _ord long"
)
