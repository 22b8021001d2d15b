"""Edits of page texts: repairs that findings ask for, literal renames, header fields and status changes.

An edit is a row (path, place, name, value). All edits of a page meet once: those that are there already are dropped, the
others become insertions at offsets of the text as it was, and the text is put together in one pass. So the order in which
findings come does not matter, and a second application changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model
from ..functions import text as X

SCHEMA = "path string, place string, name string, value string"
#: Pairs of a rename that one automaton holds; more are found block by block.
MOST_PAIRS = 200_000
HEADER = r"(?s)\A---\n(.*?)\n---"


def one_way_refs(pages: DataFrame) -> DataFrame:
    """path, kind, slug, to_path, section, line: references of ``model.BACK_LINKS`` whose target does not link back.

    ``pages``: kind, slug, path, text, header (JSON). A target counts as linking back by ``[[slug]]`` or ``[[slug|``, for
    experiments by naming the slug at all.
    """
    parts = []
    for kind, field, to_kind, section, line, how in model.BACK_LINKS:
        of = pages.filter(F.col("kind") == kind)
        if field:
            raw = F.get_json_object("header", f"$.{field}")
            named = F.coalesce(F.from_json(raw, "array<string>"), F.array(raw))
        else:
            named = F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]|]+)(?=\]\]|\|)"), F.lit(1))
        each = of.select("path", "kind", "slug", F.explode(F.array_distinct(named)).alias("target"))
        each = each.withColumn("target", X.reference_slug("target")).filter("target <> ''").distinct()
        parts.append(each.select("*", F.lit(to_kind).alias("to_kind"), F.lit(section).alias("section"), F.format_string(line, "slug").alias("line"), F.lit(how).alias("how")))
    refs = parts[0]
    for p in parts[1:]:
        refs = refs.unionByName(p)
    there = refs.join(pages.select(F.col("kind").alias("to_kind"), F.col("slug").alias("target"), F.col("path").alias("to_path")), ["to_kind", "target"])
    back = pages.select(F.col("path").alias("to_path"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\[\[([^\[\]|]+)(?=\]\]|\|)"), F.lit(1)))).alias("slug"))
    lost = there.filter("how = 'link'").join(back, ["to_path", "slug"], "left_anti")
    said = there.filter("how = 'name'").join(pages.select(F.col("path").alias("to_path"), "text"), "to_path").filter(~F.col("text").contains(F.col("slug"))).drop("text")
    return lost.unionByName(said).select("path", "kind", "slug", "to_path", "section", "line")


def repair_edits(refs: DataFrame, fields: DataFrame) -> DataFrame:
    """Edits of fixable findings. ``refs``: to_path, section, line; ``fields``: path, field, default (null: no repair)."""
    links = refs.select(F.col("to_path").alias("path"), F.lit("section").alias("place"), F.col("section").alias("name"), F.col("line").alias("value"))
    added = fields.filter("default IS NOT NULL").select("path", F.lit("field").alias("place"), F.col("field").alias("name"), F.col("default").alias("value"))
    return links.unionByName(added).distinct()


def _placed(text: Column, edits: Column) -> Column:
    """``text`` with new lines under their headings; a heading that is not there comes at the end."""
    lines = F.filter(edits, lambda e: (e["place"] == "section") & ~text.contains(F.trim(e["value"])))
    names = F.array_distinct(F.transform(lines, lambda e: e["name"]))
    block = lambda n: F.array_join(F.transform(F.filter(lines, lambda e: e["name"] == n), lambda e: F.concat(e["value"], F.lit("\n"))), "")
    heading = lambda n: F.concat(F.lit(r"(?m)^\Q"), n, F.lit(r"\E[ \t]*$\n*"))
    at = lambda n: F.regexp_instr(text, heading(n))

    def inside(n: Column) -> Column:
        found = F.regexp_substr(text, heading(n))
        return F.struct((at(n) + F.length(found)).alias("at"), F.concat(F.when(found.endswith("\n"), "").otherwise("\n"), block(n)).alias("text"))

    inserts = F.array_sort(F.transform(F.filter(names, lambda n: at(n) > 0), inside))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    merged = F.aggregate(
        inserts, start,
        lambda s, i: F.struct(F.concat(s["out"], F.substring(text, s["at"], i["at"] - s["at"]), i["text"]).alias("out"), i["at"].alias("at")),
        lambda s: F.concat(s["out"], F.substring(text, s["at"], F.length(text))),
    )
    trim = lambda t: F.rtrim(t, F.lit(" \t\n\r\x0b\x0c"))
    new = F.filter(names, lambda n: at(n) == 0)
    return F.when(F.size(lines) == 0, text).otherwise(F.aggregate(new, merged, lambda t, n: F.concat(trim(t), F.lit("\n\n"), n, F.lit("\n\n"), block(n))))


def _filled(text: Column, edits: Column) -> Column:
    """``text`` with header fields that are not there, before the closing fence; a text without header stays."""
    header = F.regexp_extract(text, HEADER, 1)
    keys = F.regexp_extract_all(header, F.lit(r"(?m)^([^:\n]+?)[ \t]*:"), F.lit(1))
    new = F.filter(edits, lambda e: (e["place"] == "field") & ~F.array_contains(keys, e["name"]))
    lines = F.array_join(F.transform(new, lambda e: F.concat(F.lit("\n"), e["name"], F.lit(": "), e["value"])), "")
    rest = F.substring(text, F.length(F.regexp_substr(text, F.lit(HEADER))) + 1, F.length(text))
    return F.when(text.rlike(HEADER) & (lines != ""), F.concat(F.lit("---\n"), F.rtrim(header), lines, F.lit("\n---"), rest)).otherwise(text)


def apply_edits(pages: DataFrame, edits: DataFrame, dry_run: bool = False) -> DataFrame:
    """``pages`` (path, text, ...) with ``changed``, ``edits`` (how many change something) and, unless ``dry_run``, the new text.

    ``edits``: path, place (section or field), name (the heading line or the field), value (the line or the field's value). Of
    several values of one field the least is taken. Lines of one section are put in descending order, each where the section's
    content begins. An edit whose line is in the page, or whose field is in the header, is done already. Edits of pages
    that are not there do nothing. A null text stays null.
    """
    one = edits.filter("place = 'section'").distinct().unionByName(edits.filter("place = 'field'").groupBy("path", "place", "name").agg(F.min("value").alias("value")).select(*edits.columns))
    by = one.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", "name", F.col("value"))), lambda a, b: _order(a, b)).alias("_e"))
    out = pages.join(by, "path", "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<place:string,name:string,value:string>>")))
    placed = _placed(F.col("text"), F.col("_e"))
    out = out.withColumn("_t", placed).withColumn("_new", _filled(F.col("_t"), F.col("_e")))
    header = F.regexp_extract("text", HEADER, 1)
    keys = F.regexp_extract_all(header, F.lit(r"(?m)^([^:\n]+?)[ \t]*:"), F.lit(1))
    done = lambda e: F.when(e["place"] == "section", F.col("text").contains(F.trim(e["value"]))).otherwise(~F.col("text").rlike(HEADER) | F.array_contains(keys, e["name"]))
    out = out.withColumns({"edits": F.size(F.filter("_e", lambda e: ~done(e))), "changed": F.coalesce(F.col("_new") != F.col("text"), F.lit(False))})
    return (out if dry_run else out.withColumn("text", F.col("_new"))).drop("_e", "_t", "_new")


def _order(a: Column, b: Column) -> Column:
    """Fields and sections by name, lines of a section in descending order."""
    least = lambda x, y: F.when(x < y, -1).when(x > y, 1)
    return F.coalesce(least(a["place"], b["place"]), least(a["name"], b["name"]), F.when(a["place"] == "section", least(b["value"], a["value"])), F.lit(0))


def append_to_section(text: Column, heading: str, lines: Column) -> Column:
    """``text`` with the lines (an array) that it does not hold under a heading line, which is made at the end if need be."""
    edits = F.transform(lines, lambda x: F.struct(F.lit("section").alias("place"), F.lit(heading).alias("name"), x.alias("value")))
    return _placed(text, edits)


def append_meta(header: Column, field: str, value: Column) -> Column:
    """A header map (lists as JSON) with ``value`` appended to a list field, once; a scalar there is an error."""
    have = F.try_element_at(header, F.lit(field))
    items = F.when(have.isNull() | (F.trim(have) == ""), F.array().cast("array<string>")).otherwise(F.from_json(have, "array<string>"))
    bad = F.raise_error(F.concat(F.lit(f"{field} is no list: "), have)).cast("array<string>")
    known = F.coalesce(items, bad)
    new = F.to_json(F.when(F.array_contains(known, value), known).otherwise(F.array_append(known, value)))
    return F.map_concat(F.map_filter(header, lambda k, _: k != field), F.create_map(F.lit(field), new))


def transition(pages: DataFrame, moves: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(pages after, report): status changes along ``model.TRANSITIONS``, with the date fields that come with them.

    ``pages``: kind, slug, header (map); ``moves``: kind, slug, status, reason. Report: kind, slug, status, outcome (moved, no
    page, not allowed, no reason). A failed idea needs a reason, which is written to failure_reason. Only pages that move change.
    """
    spark = pages.sparkSession
    allowed = model.transitions_table(spark).withColumn("_ok", F.lit(True))
    asked = moves.select("kind", "slug", F.col("status").alias("new_status"), "reason")
    at = pages.select("kind", "slug", F.try_element_at("header", F.lit("status")).alias("old_status"), F.lit(True).alias("_there"))
    judged = asked.join(at, ["kind", "slug"], "left").join(F.broadcast(allowed), ["kind", "old_status", "new_status"], "left")  # a dozen rows
    needs = (F.col("kind") == "ideas") & (F.col("new_status") == "failed") & (F.trim(F.coalesce("reason", F.lit(""))) == "")
    outcome = F.when(F.col("_there").isNull(), "no page").when(F.col("_ok").isNull(), "not allowed").when(needs, "no reason").otherwise("moved")
    report = judged.select("kind", "slug", F.col("new_status").alias("status"), "reason", outcome.alias("outcome"))
    moved = report.filter("outcome = 'moved'").select("kind", "slug", F.col("status").alias("_s"), F.col("reason").alias("_r"))
    dates = [F.when((F.col("kind") == k) & (F.col("_s") == s), F.lit(f)) for (k, s), f in model.AUTO_DATE_FIELDS.items()]
    both = pages.join(moved, ["kind", "slug"], "left")
    new = F.create_map(F.lit("status"), F.col("_s"))
    new = F.when(F.coalesce(*dates).isNotNull(), F.map_concat(new, F.create_map(F.coalesce(*dates, F.lit("-")), F.lit(as_of)))).otherwise(new)
    new = F.when((F.col("kind") == "ideas") & (F.col("_s") == "failed"), F.map_concat(new, F.create_map(F.lit("failure_reason"), F.trim("_r")))).otherwise(new)
    kept = F.map_filter("header", lambda k, _: ~F.array_contains(F.map_keys(new), k))
    out = both.withColumn("header", F.when(F.col("_s").isNotNull(), F.map_concat(kept, new)).otherwise(F.col("header"))).drop("_s", "_r")
    return out.select(*pages.columns), report.drop("reason")


# --- literal replacement ---------------------------------------------------------------------------------------------


class Literals:
    """All pairs of a rename as one Aho-Corasick automaton; longer texts win over shorter ones wherever they overlap."""

    def __init__(self, pairs: list[tuple[str, str]]) -> None:
        import ahocorasick

        self.words = ahocorasick.Automaton()
        for old, new in pairs:
            self.words.add_word(old, (len(old), new))
        if pairs:
            self.words.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, length, new) of every occurrence, overlaps and all."""
        return [(end + 1 - size, size, new) for end, (size, new) in self.words.iter(text)] if len(self.words) else []

    def replace(self, text: str) -> str:
        return replaced(text, self.spans(text))


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """``text`` with the spans put in: the longest first, of one length the leftmost, none over another."""
    if not spans:
        return text
    taken, chosen = bytearray(len(text)), []
    for start, size, new in sorted(spans, key=lambda s: (-s[1], s[0])):
        if taken.find(1, start, start + size) < 0:
            taken[start : start + size] = b"\1" * size
            chosen.append((start, size, new))
    out, at = [], 0
    for start, size, new in sorted(chosen):
        out += [text[at:start], new]
        at = start + size
    return "".join([*out, text[at:]])


def walked(value, change):
    """A JSON value with every text in it changed, at any depth; keys, numbers and flags stay."""
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [walked(x, change) for x in value]
    return {k: walked(x, change) for k, x in value.items()} if isinstance(value, dict) else value


def rewritten(raw: str, change) -> str:
    """JSON text after ``change`` of its value; the text itself where nothing changes."""
    value = json.loads(raw)
    new = change(value)
    return raw if new == value else json.dumps(new, ensure_ascii=False)


def texts_of(value, way: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(way, text) of every text in a JSON value."""
    if isinstance(value, str):
        yield way, value
    elif isinstance(value, (list, dict)):
        for k, x in enumerate(value) if isinstance(value, list) else value.items():
            yield from texts_of(x, (*way, k))


def replace_literals(df: DataFrame, pairs: DataFrame, texts: list[str], headers: list[str] = (), most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``df`` with every old text of ``pairs`` (old, new) replaced in the text columns and in all values of the header columns
    (JSON), in one pass, the longest old text first, so what was put in is never replaced again.

    An empty or null old text is no pair; one old text with two new ones is an error. Nulls stay. Up to ``most_pairs`` pairs go to the tasks
    as one automaton; beyond, they are searched block by block and the places of all blocks meet by row.
    """
    known = pairs.filter("old <> '' AND new IS NOT NULL").groupBy("old").agg(F.min("new").alias("new"), F.max("new").alias("_n"))
    if not known.filter("new <> _n").isEmpty():
        raise ValueError("one text is to become two")
    known = known.select("old", "new").checkpoint()
    n = known.count()
    if n <= most_pairs:
        return _replaced_at_once(df, [tuple(r) for r in known.collect()], texts, list(headers))
    return _replaced_in_blocks(df, known, -(-n // most_pairs), texts, list(headers))


def _replaced_at_once(df: DataFrame, pairs: list[tuple[str, str]], texts: list[str], headers: list[str]) -> DataFrame:
    sent, names = df.sparkSession.sparkContext.broadcast(pairs), df.columns

    def run(batches):
        literals = Literals(sent.value)
        one = literals.replace
        for b in batches:
            columns = {c: b.column(i) for i, c in enumerate(names)}
            for c in texts:
                columns[c] = pa.array([x if x is None else one(x) for x in columns[c].to_pylist()], pa.string())
            for c in headers:
                columns[c] = pa.array([x if x is None else rewritten(x, lambda v: walked(v, one)) for x in columns[c].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return df.mapInArrow(run, df.schema)


def _replaced_in_blocks(df: DataFrame, known: DataFrame, blocks: int, texts: list[str], headers: list[str]) -> DataFrame:
    """One block of pairs at a time is with the driver; the places that each finds are joined to the rows."""
    names = df.columns
    rows = df.withColumn("_uid", F.monotonically_increasing_id()).checkpoint()
    only = rows.select("_uid", *texts, *headers)
    places = "_uid long, way string, start long, size long, new string"
    found = None
    for k in range(blocks):
        part = [tuple(r) for r in known.filter(F.pmod(F.xxhash64("old"), F.lit(blocks)) == k).collect()]
        sent = df.sparkSession.sparkContext.broadcast(part)

        def run(batches, sent=sent):
            literals = Literals(sent.value)
            for b in batches:
                out = []
                for uid, *values in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                    for c, x in zip([*texts, *headers], values, strict=True):
                        each = [] if x is None else [((c,), x)] if c in texts else texts_of(json.loads(x), (c,))
                        out += [(uid, json.dumps(way), *s) for way, t in each for s in literals.spans(t)]
                if out:
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["_uid", "way", "start", "size", "new"])

        hits = only.mapInArrow(run, places)
        found = hits if found is None else found.unionByName(hits)
    per_row = found.groupBy("_uid").agg(F.collect_list(F.struct("way", "start", "size", "new")).alias("_spans"))
    both = rows.join(per_row, "_uid", "left").select(*names, "_spans")

    def put(batches):
        for b in batches:
            cells = {c: b.column(i).to_pylist() for i, c in enumerate([*names, "_spans"])}
            for r, spans in enumerate(cells.pop("_spans")):
                by: dict[str, list] = {}
                for s in spans or ():
                    by.setdefault(s["way"], []).append((s["start"], s["size"], s["new"]))
                for c in texts:
                    if (own := by.get(json.dumps((c,)))) and cells[c][r] is not None:
                        cells[c][r] = replaced(cells[c][r], own)
                for c in headers:
                    if cells[c][r] is None:
                        continue
                    cells[c][r] = rewritten(cells[c][r], lambda v, c=c, by=by: _refilled(v, (c,), by))
            yield pa.RecordBatch.from_arrays([pa.array(cells[c], b.column(i).type) for i, c in enumerate(names)], names)

    return both.mapInArrow(put, df.schema)


def _refilled(value, way: tuple, by: dict[str, list]):
    """A JSON value with the spans that were found in each of its texts put in."""
    if isinstance(value, str):
        return replaced(value, by.get(json.dumps(way), []))
    if isinstance(value, list):
        return [_refilled(x, (*way, i), by) for i, x in enumerate(value)]
    return {k: _refilled(x, (*way, k), by) for k, x in value.items()} if isinstance(value, dict) else value


def rename_sources(pages: DataFrame, renames: DataFrame) -> DataFrame:
    """``pages`` (path, header as JSON, body, ...) after sources got new names, with ``changed``: links to them, in bodies and
    header values, follow; a renamed page moves and says its slug and citation key.

    ``renames``: old_stem, new_stem, citation_key. A new path that a page which stays has is an error, and nothing is returned.
    """
    moved = renames.filter("old_stem <> new_stem")
    folder, *_ = model.SOURCE_LINK_PREFIXES
    at = lambda stem: F.concat(F.lit(folder), stem, F.lit(".md"))
    target = moved.select(at(F.col("new_stem")).alias("path"))
    staying = pages.select("path").join(moved.select(at(F.col("old_stem")).alias("path")), "path", "left_anti")
    twice = target.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("path")
    bad = [r.path for r in target.join(staying, "path", "left_semi").union(twice).limit(5).collect()]
    if bad:
        raise ValueError(f"target collisions: {', '.join(sorted(bad))}")
    forms = [(F.concat(F.lit(p), "old_stem", F.lit(".md")), F.concat(F.lit(p), "new_stem", F.lit(".md"))) for p in model.SOURCE_LINK_PREFIXES]
    forms.append((F.concat(F.lit("assets/"), "old_stem", F.lit("/")), F.concat(F.lit("assets/"), "new_stem", F.lit("/"))))
    pairs = moved.select(F.explode(F.array(*[F.struct(a.alias("old"), b.alias("new")) for a, b in forms])).alias("p")).select("p.*")
    was = pages.withColumns({"_path": F.col("path"), "_was": F.struct("header", "body")})
    new = replace_literals(was.withColumn("_was", F.sha2(F.to_json("_was"), 256)), pairs, ["body"], ["header"])
    own = moved.select(at(F.col("old_stem")).alias("_path"), F.col("new_stem").alias("_stem"), F.col("citation_key").alias("_key"))
    both = new.join(own, "_path", "left")
    said = F.when(F.trim(F.coalesce("_key", F.lit(""))) != "", F.create_map(F.lit("sourceSlug"), F.col("_stem"), F.lit("citationKey"), F.col("_key"))).otherwise(F.create_map(F.lit("sourceSlug"), F.col("_stem")))
    out = with_keys(both.withColumn("_said", F.when(F.col("_stem").isNotNull(), F.to_json(said))), "header", "_said").withColumn("path", F.when(F.col("_stem").isNotNull(), at(F.col("_stem"))).otherwise(F.col("path")))
    return out.withColumn("changed", (F.sha2(F.to_json(F.struct("header", "body")), 256) != F.col("_was")) | (F.col("path") != F.col("_path"))).select(*pages.columns, "changed")


def with_keys(df: DataFrame, header: str, more: str) -> DataFrame:
    """``df`` with the entries of the JSON object in column ``more`` set in the header (JSON): known keys in place, new ones last;
    everything else is byte for byte as it was. ``more`` goes."""
    names = [c for c in df.columns if c != more]
    schema = df.select(*names).schema

    def run(batches):
        for b in batches:
            columns = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            new = columns.pop(more).to_pylist()
            old = columns[header].to_pylist()
            columns[header] = pa.array([h if n is None else json.dumps((json.loads(h) if h else {}) | json.loads(n), ensure_ascii=False) for h, n in zip(old, new, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return df.select(*names, more).mapInArrow(run, schema)
