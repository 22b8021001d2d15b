"""Readers of tables: Parquet, JSON lines with bad lines kept, SQLite extracts, REST fixtures, OCR blocks, legacy logs."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import model
from ..operators import windows
from ..session import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, whose rows go to Python in small batches, as they hold whole texts (``session.small_batches``)."""
    return small_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file with ``_ord`` (file order) and ``_corrupt`` (the line, where it is no object).

    Only '\\n' ends a row; blank lines are skipped. One file is one partition so that lines keep their order.
    """
    lines = spark.read.option("lineSep", "\n").option("wholetext", False).text(path).withColumn("_ord", F.monotonically_increasing_id())
    full = schema + ", _corrupt string"
    rows = lines.filter(F.trim("value") != "").withColumn("j", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return rows.select("j.*", "_ord", F.try_parse_json("value").alias("extra"))


def edges(spark: SparkSession, path: str) -> DataFrame:
    got = json_lines(spark, path, "`from` string, `to` string, type string, evidence string, date string, confidence string, symmetric boolean")
    return got.withColumnsRenamed({"from": "from_id", "to": "to_id"})


def citations(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, "`from` string, `to` string, type string, source string, date string").withColumnsRenamed({"from": "from_id", "to": "to_id"})


class SqliteSource(DataSource):
    """``spark.read.format("sqlite").option("path", ...).option("query", ...)``: a read-only query in rowid ranges."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> str:
        return self.options["schema"] if "schema" in self.options else "value string"

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    """A part is a file (``path`` may be a pattern) and a share of its rows by ``partitioncolumn`` modulo ``numpartitions``."""

    def __init__(self, options) -> None:
        self.options = dict(options)

    def partitions(self):
        import glob

        at = self.options["path"]
        files = sorted(glob.glob(at)) if "*" in at else [at]
        return [InputPartition((f, i)) for f in files for i in range(int(self.options.get("numpartitions", "1")))] or [InputPartition(None)]

    def read(self, partition):
        import sqlite3
        from contextlib import closing

        if partition.value is None:
            return
        (file, share), n = partition.value, int(self.options.get("numpartitions", "1"))
        with closing(sqlite3.connect(f"file:{file}?mode=ro", uri=True)) as db:
            query = self.options.get("query") or f"SELECT * FROM {self.options['table']}"
            if n > 1:
                query = f"SELECT * FROM ({query}) WHERE coalesce(abs({self.options['partitioncolumn']}), 0) % {n} = {share}"
            yield from db.execute(query)


def sqlite(spark: SparkSession, path: str, query: str, schema: str, partitions: int = 1, column: str = "rowid") -> DataFrame:
    """Rows of a read-only query over the database (or those that match a pattern), each in ``partitions`` shares by ``column``."""
    spark.dataSource.register(SqliteSource)
    options = {"path": path.removeprefix("file://"), "query": query, "schema": schema, "numpartitions": str(partitions), "partitioncolumn": column}
    return spark.read.format("sqlite").options(**options).schema(schema).load()


def write_sqlite(df: DataFrame, folder: str, table_: str) -> str:
    """Write ``df`` as databases below ``folder`` (a path that all executors share), one for each task that has rows, and return the
    folder. A file gets its name when it is whole, so a task that is tried again leaves no rows twice."""
    at, names = folder.removeprefix("file://"), df.columns

    def run(batches):
        import os
        import sqlite3
        from contextlib import closing

        from pyspark import TaskContext

        name = f"{at}/part-{TaskContext.get().partitionId():05d}"
        aside, n = f"{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}", 0
        os.makedirs(at, exist_ok=True)
        with closing(sqlite3.connect(aside)) as db:
            db.execute(f"create table {table_}({', '.join(names)})")
            for b in batches:
                n += b.num_rows
                db.executemany(f"insert into {table_} values ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in b.columns), strict=True))
            db.commit()
        os.replace(aside, f"{name}.db") if n else os.remove(aside)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    df.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one number
    return at


def snapshot(spark: SparkSession, make, folder: str, signature: str) -> DataFrame:
    """A Parquet snapshot made once for each signature (root, size, time of the original)."""
    import hashlib

    at = f"{folder}/{hashlib.sha256(signature.encode()).hexdigest()[:16]}"
    P = spark._jvm.org.apache.hadoop.fs.Path
    done = P(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def provider_works(raw: DataFrame, provider: str, queries: Column | None = None) -> DataFrame:
    """Flat candidates of a provider's nested works (id, doi, display_name, abstract_inverted_index, ...)."""
    from ..functions import text as X

    authors = F.transform("authorships", lambda a: F.coalesce(a["author"]["display_name"], a["raw_author_name"]))
    return raw.select(
        F.regexp_replace("id", "^https?://[^/]+/", "").alias("id"), X.doi("doi").alias("doi"), F.col("display_name").alias("title"),
        X.inverted_index_text("abstract_inverted_index").alias("abstract"), F.lit(None).cast("string").alias("tldr"), F.col("primary_location.source.display_name").alias("venue"),
        F.lit(None).cast("string").alias("url"), F.col("publication_year").cast("int").alias("year"), F.col("cited_by_count").cast("long").alias("citations"),
        F.lit(0).cast("long").alias("influential"), F.lit(0).cast("long").alias("max_h_index"), F.filter(authors, lambda a: a != "").alias("authors"),
        F.array().cast("array<string>").alias("fields"), F.array(F.lit("search")).alias("sources"), F.array().cast("array<string>").alias("anchors"),
        F.array(F.lit(provider)).alias("providers"), F.array(queries if queries is not None else F.lit("")).alias("queries"), F.lit(False).alias("influential_edge"), F.monotonically_increasing_id().alias("_ord"),
    )


def search(primary: DataFrame, secondary: DataFrame, limit: int, supplement: int = 0) -> DataFrame:
    """Primary hits, with secondary ones where there are too few or a supplement is asked for; keep-first by key."""
    from ..operators.aggregates import candidate_key

    both = primary.withColumn("_p", F.lit(0))
    if supplement or primary.limit(limit).count() < limit:
        both = both.unionByName(secondary.withColumn("_p", F.lit(1)))
    keyed = both.withColumn("key", candidate_key(F.col("doi"), F.col("id"), F.col("title"), doi_shaped_ids=False)).filter("key <> ''")
    first = keyed.groupBy("key").agg(F.min_by(F.struct(*both.columns), F.struct("_p", "_ord")).alias("r")).select("key", "r.*")
    return first.orderBy("_p", "_ord").limit(limit + supplement)


def references(works: DataFrame) -> DataFrame:
    """Outgoing references with a DOI or a title; the year only where it is all digits."""
    each = works.select("id", F.posexplode("references").alias("pos", "r"))
    return each.filter((F.coalesce("r.doi", F.lit("")) != "") | (F.coalesce("r.title", F.lit("")) != "")).select("id", "pos", "r.doi", "r.title", F.when(F.col("r.year").rlike(r"^\d+$"), F.col("r.year").try_cast("int")).alias("year"))


def no_citations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], model.CANDIDATE_SCHEMA)


def item_with_parent(items: DataFrame) -> DataFrame:
    """Attachments replaced by their parent's fields, one hop. Columns key, parent, title, doi."""
    p = items.select(F.col("key").alias("parent"), F.col("title").alias("pt"), F.col("doi").alias("pd"))
    return items.join(p, "parent", "left").select("key", F.coalesce("pt", "title").alias("title"), F.coalesce("pd", "doi").alias("doi"))


def ocr_sections(blocks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections, figures, pages) of an OCR block list: doc, pos, type, text, text_level, page_idx. A figure belongs to the
    last heading before it; pages is one more than the last page index."""
    head = F.when((F.col("type") == "text") & (F.col("text_level") >= 1), F.col("pos"))
    tagged = windows.carry_forward(blocks, ["doc"], "pos", head, "section")
    sections = tagged.filter(F.col("section") == F.col("pos")).select("doc", "pos", F.trim("text").alias("heading"), (F.col("page_idx") + 1).alias("page"))
    figures = tagged.filter("type = 'image'").select("doc", "section", F.col("text").alias("caption"), (F.col("page_idx") + 1).alias("page"))
    return sections, figures, blocks.groupBy("doc").agg((F.max("page_idx") + 1).alias("pages"))


def evidence_cards(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) cards of a JSON list or an object with a list."""
    from ..operators.predicates import card_ok

    names = ["evidence_id", "use_label", "short_label", "source_slug", "source_section", "excerpt"]
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.explode("cards").alias("c")).select("c.*") if "cards" in raw.columns else raw
    rows = rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast("string").alias(n) for n in names])
    ok = F.coalesce(card_ok({n: F.col(n) for n in names}), F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def legacy_log(logs: DataFrame) -> DataFrame:
    """doc, record, date, skill, text: entries of old logs. A line '## [date] skill | ...' starts an entry; what follows is its body."""
    lines = logs.select("doc", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    header = F.col("value").rlike(r"^#+\s*\[\d{4}-\d{2}-\d{2}\]")
    rec = windows.group_records(lines, ["doc"], "line", header).filter("record > 0")
    first = F.max(F.when(header, F.col("value")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~header, F.struct("line", "value")))), lambda x: x["value"]), "\n")
    got = rec.groupBy("doc", "record").agg(first.alias("h"), F.trim(body).alias("body"))
    return got.select("doc", "record", F.regexp_extract("h", r"\[(\d{4}-\d{2}-\d{2})\]", 1).alias("date"), F.trim(F.regexp_extract("h", r"\]\s*([^|]+)", 1)).alias("skill"), F.concat_ws("\n", F.nullif(F.trim(F.regexp_extract("h", r"\|\s*(.*)$", 1)), F.lit("")), F.nullif(F.col("body"), F.lit(""))).alias("text"))


def preferred_entries(entries: DataFrame) -> DataFrame:
    """One entry for each id out of several readers' (columns id, original_format, ingest_format, abstract, source_path, warnings, _ord, ...).

    Entries are met in ``_ord``; a later one wins only if it is strictly preferred. Its ``warnings`` are those of all, and one for each entry
    in favor of which another was skipped; sorted and distinct, so that neither partitions nor the order of input show.
    """
    from ..operators.scoring import entry_preference

    w = Window.partitionBy("id").orderBy("_ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = entries.withColumn("_p", entry_preference(F.col("original_format"), F.col("ingest_format"), F.col("abstract")))
    seen = seen.withColumn("_best", F.max("_p").over(before))
    wins = F.col("_best").isNull() | (F.col("_p") > F.col("_best"))
    # the winner so far, at every row but the first, is the one that the other was skipped for
    seen = seen.withColumn("_wins", wins).withColumn("_kept", F.last(F.when(wins, F.col("source_path")), ignorenulls=True).over(w))
    said = F.when(F.col("_best").isNotNull(), F.concat(F.lit("duplicate local source skipped in favor of preferred source: "), "_kept"))
    rest = [c for c in entries.columns if c not in ("id", "warnings")]
    own = F.concat(F.coalesce("warnings", F.array().cast("array<string>")), F.array_compact(F.array(said)))
    each = seen.select("id", F.when(F.col("_wins"), F.struct(*rest)).alias("_r"), F.col("_ord").alias("_o"), F.explode_outer(own).alias("_w"))
    best = each.groupBy("id").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col("_o"))).alias("r"), F.sort_array(F.collect_set("_w")).alias("warnings"))
    return best.select("id", "r.*", "warnings")


_DATE = "struct<`date-parts`:array<array<int>>>"
#: The parts of a second provider's works that are read; fields that are not named are not parsed.
SECOND_WORK = (
    "struct<DOI:string,URL:string,title:array<string>,abstract:string,author:array<struct<given:string,family:string,name:string>>,`container-title`:array<string>,"
    f"`published-print`:{_DATE},`published-online`:{_DATE},issued:{_DATE},`is-referenced-by-count`:bigint,type:string>"
)


def second_works(pages: DataFrame, since: int | None = None) -> DataFrame:
    """Works of recorded answers of a second provider, one row each, with the plain columns of a candidate. ``pages``: page,
    json (an answer with message.items). Only the named fields are parsed; works before ``since`` go before they are shaped."""
    from ..functions import text as X

    items = F.from_json("json", f"struct<message:struct<items:array<{SECOND_WORK}>>>")["message"]["items"]
    w = pages.select("page", F.posexplode(items).alias("pos", "w")).select("page", "pos", "w.*")
    years = [F.get(F.get(F.col(f"`{c}`")["date-parts"], F.lit(0)), F.lit(0)) for c in ("published-print", "published-online", "issued")]
    w = w.withColumn("year", F.coalesce(*years))
    w = w if since is None else w.filter(F.col("year") >= since)
    clean = X.clean_markup
    name = lambda a: X.clean_markup(F.coalesce(F.nullif(F.trim(F.concat_ws(" ", a["given"], a["family"])), F.lit("")), a["name"]))
    title, doi = clean(F.get("title", F.lit(0))), F.coalesce("DOI", F.lit(""))
    return w.select(
        "page", "pos", F.coalesce(F.nullif(doi, F.lit("")), "URL", title).alias("id"), doi.alias("doi"), title.alias("title"), clean(F.col("abstract")).alias("abstract"), clean(F.get("container-title", F.lit(0))).alias("venue"),
        F.coalesce("URL", F.when(doi != "", F.concat(F.lit("https://doi.org/"), doi)), F.lit("")).alias("url"), "year", F.coalesce("is-referenced-by-count", F.lit(0)).cast("long").alias("citations"),
        F.filter(F.transform(F.coalesce("author", F.array()), name), lambda a: a != "").alias("authors"), F.coalesce("type", F.lit("work")).alias("type"),
    )


def paged_items(spark: SparkSession, path: str, size: int = 100) -> DataFrame:
    """page, pos, item (JSON text) of recorded answers kept as one JSON list a file, read in parallel; pages after the first
    short one are not part of the listing."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("int").alias("page"), F.from_json("value", "array<string>").alias("items"))
    last = files.filter(F.size("items") < size).agg(F.coalesce(F.min("page"), F.lit(2**31 - 1)).alias("last"))
    return files.crossJoin(F.broadcast(last)).filter("page <= last").select("page", F.posexplode("items").alias("pos", "item"))  # one row: the last page
