"""Pages of a vault: Markdown files with a header, one folder for each kind, scanned as a table.

``_ord`` is the place in path order. Copies left by sync conflicts are kept apart and reported.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markdown
from ..functions.headers import header_json
from ..operators import predicates
from ..operators.windows import dense_ordinal


def files(spark: SparkSession, roots: list[str], glob: str = "*.md", recursive: bool = False) -> DataFrame:
    """path, name, mtime, raw (bytes) of the files of several roots, each once."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    df = reader.load(roots).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("content").alias("raw"))
    return df.dropDuplicates(["path"])


def conflict_copies(found: DataFrame) -> DataFrame:
    return found.filter(~predicates.not_conflict_copy(F.col("name"))).select("path", "name")


def pages(spark: SparkSession, roots: dict[str, str], only: list[str] | None = None) -> DataFrame:
    """kind, slug, path, mtime, header (VARIANT), body, parse_mode, _ord for all pages of the kinds' folders.

    ``only`` (path prefixes) applies before any file is decoded. Bytes that are no UTF-8 are left out; see ``unreadable``.
    """
    out = None
    for kind, root in roots.items():
        part = files(spark, [root]).filter(predicates.not_conflict_copy(F.col("name"))).withColumn("kind", F.lit(kind))
        part = part.filter(predicates.under_paths(F.col("path"), only)) if only else part
        out = part if out is None else out.unionByName(part)
    text = out.withColumn("text", F.try_validate_utf8(F.col("raw").cast("string"))).filter("text is not null")
    read = text.withColumn("h", header_json("text"))
    cols = read.select("kind", F.regexp_replace("name", r"\.md$", "").alias("slug"), "path", "mtime", F.try_parse_json("h.header").alias("header"), "h.body", "h.parse_mode")
    return dense_ordinal(cols.withColumn("_k", F.col("path")), [F.col("kind"), F.col("path")], "_ord").drop("_k")


def unreadable(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Files that are no UTF-8: blocked, and not a failure of the scan."""
    return files(spark, roots).filter(F.try_validate_utf8(F.col("raw").cast("string")).isNull()).select("path", F.lit("blocked").alias("status"))


def disjoint(roots: list[str]) -> list[str]:
    """The paths that no other one contains, in order: a folder takes in all below it, a path that is named twice stays once."""
    out: list[str] = []
    for r in sorted({re.sub(r"/+$", "", r) or "/" for r in roots}, key=lambda r: r.split("/")):
        if not (out and (r == out[-1] or r.startswith(out[-1].rstrip("/") + "/"))):
            out.append(r)
    return out


def scan_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, sha256, status, text, body_characters of every Markdown file below or at the paths, each once, however they overlap.

    Bytes that are no UTF-8 are not dropped or replaced: the row is blocked, and text and body_characters are null. Copies left by sync conflicts
    are left out. A path that is not there, a file that is no Markdown and a folder without any are errors, before anything is read.
    """
    P, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for at in paths:
        fs = P(at).getFileSystem(conf)
        if not fs.exists(P(at)) or fs.getFileStatus(P(at)).isFile() and not at.lower().endswith(".md"):
            raise ValueError(f"no Markdown source: {at}")
        if fs.getFileStatus(P(at)).isDirectory() and files(spark, [at], "*.[mM][dD]", True).limit(1).count() == 0:
            raise ValueError(f"no Markdown sources in {at}")
    found = files(spark, disjoint(paths), "*.[mM][dD]", True).filter(predicates.not_conflict_copy(F.col("name")))
    text = F.try_validate_utf8(F.col("raw").cast("string"))
    out = found.select("path", F.sha2("raw", 256).alias("sha256"), text.alias("text"))
    body = F.regexp_replace("text", r"(?s)\A\x{feff}?---[^\S\n]*\n.*?\n(?:---|\.\.\.)[^\S\n]*(?:\n|\z)", "")
    return out.select("path", "sha256", F.when(F.col("text").isNull(), "blocked").otherwise("read").alias("status"), "text", F.length(F.trim(body)).cast("long").alias("body_characters"))


def scan_findings(scanned: DataFrame, images: Column | None = None) -> DataFrame:
    """path, rule, severity, scope, line, column: what screening says of read files; a blocked one has one finding, invalid-utf8."""
    rows = scanned.filter("status = 'read'").select("path", F.explode(markdown.screen(F.col("text"), images if images is not None else F.lit(None).cast("array<string>"))).alias("f")).select("path", "f.*")
    bad = scanned.filter("status = 'blocked'").select("path", F.lit("invalid-utf8").alias("rule"), F.lit("red").alias("severity"), F.lit("document").alias("scope"), F.lit(1).alias("line"), F.lit(1).alias("column"))
    return rows.unionByName(bad)


def scan_summary(scanned: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: files, with_findings, with_red, blocked."""
    per_file = findings.groupBy("path").agg(F.bool_or(F.col("severity") == "red").alias("red"))
    return scanned.select("path", "status").join(per_file, "path", "left").agg(
        F.count(F.lit(1)).alias("files"), F.count("red").alias("with_findings"), F.count_if("red").alias("with_red"), F.count_if(F.col("status") == "blocked").alias("blocked")
    )


def fields(pages_: DataFrame, names: list[str]) -> DataFrame:
    """Typed view: a string column for each header field, null where absent."""
    return pages_.select("kind", "slug", "path", "body", "_ord", *[F.try_variant_get("header", f"$.{n}", "string").alias(n) for n in names])


def recent(pages_: DataFrame, k: int) -> DataFrame:
    """The k pages changed last."""
    return pages_.orderBy(F.col("mtime").desc(), "path").limit(k)


def node_path(node: str, roots: dict[str, str]) -> str:
    """File of a node id kind/slug; refuses absolute ids, '..' and backslashes."""
    kind, _, slug = node.partition("/")
    if not slug or kind not in roots or ".." in node.split("/") or "\\" in node or node.startswith("/"):
        raise ValueError(f"bad node id {node!r}")
    return f"{roots[kind].rstrip('/')}/{slug}.md"
