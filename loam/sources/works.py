"""Works of literature providers: answers recorded once, then read by a data source that takes filters and columns.

``record`` lays answers out as one line of raw JSON for each work, in folders by provider and year. ``RecordedWorks`` reads
them like the providers serve them: a filter on ``year`` or ``provider`` goes into the request, so files of other years are
never opened and their works never parsed, and only the fields of the wanted columns are shaped (``select``). Files are
read through pyarrow, so a store is whatever it knows (local, S3, GCS, HDFS), and large ones are split at line ends.
"""

from __future__ import annotations

import html
import io
import json
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

#: Where each provider keeps its list of works, and a work's year.
LISTS = {"openalex": "$.results", "crossref": "$.message.items"}
ITEMS = {"openalex": "struct<results:array<string>>", "crossref": "struct<message:struct<items:array<string>>>"}
YEARS = {"openalex": ["$.publication_year"], "crossref": [f"$.{c}.date-parts[0][0]" for c in ("published-print", "published-online", "issued")]}
NO_YEAR = "__HIVE_DEFAULT_PARTITION__"
SPLIT_BYTES = 64 << 20


def record(answers: DataFrame, path: str, files: int = 8) -> None:
    """Append recorded answers (provider, json) to the store at ``path``. Answers of providers that are not known, and those
    that are no JSON, hold no works. A provider's year is dealt over ``files`` files at least, so no year is one task."""
    each = None
    for provider, kind in ITEMS.items():
        items = F.from_json("json", kind)
        for step in LISTS[provider].split(".")[1:]:
            items = items[step]
        part = answers.filter(F.col("provider") == provider).select("provider", F.explode(items).alias("value"))
        year = F.coalesce(*[F.nullif(F.get_json_object("value", at).try_cast("int"), F.lit(0)) for at in YEARS[provider]])
        part = part.withColumn("year", year)
        each = part if each is None else each.unionByName(part)
    salt = F.pmod(F.xxhash64("value"), F.lit(files))
    lines = each.withColumns({"value": F.regexp_replace("value", r"[\r\n]+", " "), "_s": salt}).repartition("provider", "year", "_s").drop("_s")
    lines.write.mode("append").partitionBy("provider", "year").text(path)


def plain(value) -> str:
    """Text without tags and entities, white space collapsed."""
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", value or "")).split())


def bare_doi(value) -> str:
    return re.sub(r"(?i)^https?://(?:dx\.)?doi\.org/", "", value or "")


def first(values) -> str:
    return (values or [""])[0]


def indexed(index) -> str:
    """Text of a word -> positions index."""
    places = sorted((p, w) for w, ps in (index or {}).items() if isinstance(ps, list) for p in ps if isinstance(p, int))
    return plain(" ".join(w for _, w in places))


def person(a: dict) -> str:
    return plain(" ".join(filter(None, (a.get("given"), a.get("family")))) or a.get("name"))


#: column -> value of a work, for each provider; a column that is not asked for costs nothing.
SHAPES: dict[str, dict[str, Callable[[dict], object]]] = {
    "openalex": {
        "id": lambda w: w.get("id") or bare_doi(w.get("doi")) or plain(w.get("display_name")),
        "doi": lambda w: bare_doi(w.get("doi")),
        "title": lambda w: plain(w.get("display_name")),
        "abstract": lambda w: indexed(w.get("abstract_inverted_index")),
        "venue": lambda w: plain(((w.get("primary_location") or {}).get("source") or {}).get("display_name")),
        "url": lambda w: f"https://doi.org/{d}" if (d := bare_doi(w.get("doi"))) else w.get("id") or "",
        "citations": lambda w: w.get("cited_by_count") or 0,
        "authors": lambda w: [n for a in w.get("authorships") or [] if isinstance(a, dict) and (n := plain((a.get("author") or {}).get("display_name") or a.get("raw_author_name")))],
        "type": lambda w: w.get("type") or "",
    },
    "crossref": {
        "id": lambda w: w.get("DOI") or w.get("URL") or plain(first(w.get("title"))),
        "doi": lambda w: w.get("DOI") or "",
        "title": lambda w: plain(first(w.get("title"))),
        "abstract": lambda w: plain(w.get("abstract")),
        "venue": lambda w: plain(first(w.get("container-title"))),
        "url": lambda w: w.get("URL") or (f"https://doi.org/{w['DOI']}" if w.get("DOI") else ""),
        "citations": lambda w: w.get("is-referenced-by-count") or 0,
        "authors": lambda w: [n for a in w.get("author") or [] if (n := person(a))],
        "type": lambda w: w.get("type") or "work",
    },
}
SCHEMA = "provider string, year int, id string, doi string, title string, abstract string, venue string, url string, citations long, authors array<string>, type string"
ARROW = {"provider": pa.string(), "year": pa.int32(), "citations": pa.int64(), "authors": pa.list_(pa.string())}
#: Filters that the store answers by its folders.
COMPARE = {ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le}


@dataclass
class Piece(ds.InputPartition):
    """A byte range of a file: the lines that begin in it."""

    provider: str
    year: int | None
    path: str
    start: int
    end: int


def admits(f: ds.Filter, value) -> bool:
    """Whether a row with ``value`` in the filter's column can pass it."""
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None or isinstance(f, ds.IsNotNull):
        return value is not None
    return value in f.value if isinstance(f, ds.In) else COMPARE[type(f)](value, f.value)


class RecordedWorks(ds.DataSource):
    """``spark.read.format("recorded_works").option("path", ...)``, with the columns of ``SCHEMA`` that are wanted as schema."""

    @classmethod
    def name(cls) -> str:
        return "recorded_works"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ds.DataSourceReader:
        return RecordedReader(self.options["path"], [f.name for f in schema.fields])


class RecordedReader(ds.DataSourceReader):
    def __init__(self, path: str, columns: list[str]) -> None:
        self.path, self.columns, self.pushed = path, columns, []

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) in (("year",), ("provider",)) and isinstance(f, (*COMPARE, ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)):
                self.pushed.append(f)
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path) if "://" in self.path else fs.FileSystem.from_uri(re.sub("^file:", "", self.path))
        out = []
        for file in store.get_file_info(fs.FileSelector(top, recursive=True)):
            at = re.search(r"/provider=([^/]+)/year=([^/]+)/[^/_.][^/]*$", file.path)
            if not at or not file.is_file:
                continue
            row = {"provider": unquote(at[1]), "year": None if at[2] == NO_YEAR else int(at[2])}
            if all(admits(f, row[f.attribute[0]]) for f in self.pushed):
                out += [Piece(row["provider"], row["year"], file.path, i, min(i + SPLIT_BYTES, file.size)) for i in range(0, file.size, SPLIT_BYTES)]
        return out or [Piece("", None, "", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.path) if "://" in self.path else fs.FileSystem.from_uri(re.sub("^file:", "", self.path))
        kinds = [ARROW.get(c, pa.string()) for c in self.columns]
        rows: list[list] = []
        for line in lines_from(io.BufferedReader(store.open_input_file(partition.path), 1 << 20), partition.start, partition.end):
            work = json.loads(line)
            known = {"provider": partition.provider, "year": partition.year}
            rows.append([known[c] if c in known else SHAPES[partition.provider][c](work) for c in self.columns])
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], self.columns)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], self.columns)


def lines_from(file, start: int, end: int) -> Iterator[bytes]:
    """Lines of a file that begin in [start, end)."""
    with file:
        at = start
        if start:  # a line that began before belongs to the piece before
            file.seek(start - 1)
            at = start - 1 + len(file.readline())
        file.seek(at)
        while at < end and (line := file.readline()):
            at += len(line)
            if line.strip():
                yield line


def works(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Recorded works with the given columns (all by default). Filters on year and provider go to the store."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordedWorks)
    kinds = {c.split(" ", 1)[0]: c for c in SCHEMA.split(", ")}
    return spark.read.format("recorded_works").option("path", path).schema(", ".join(kinds[c] for c in columns or kinds)).load()
