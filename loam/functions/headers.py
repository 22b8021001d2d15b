"""Page headers: a reader of the YAML that headers use, and the stricter one of the lint.

``Block`` reads line by line with a stack of open containers and their columns: maps, lists, lists of maps, to any depth,
block texts, comments, quoted texts, and a ladder of types (flag, decimal, whole number, text). Lines that fit nowhere are
passed over, so a broken header still gives what can be read. ``lint_fields`` knows texts and lists of texts only.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

STRING = T.StringType()
FENCE = re.compile(r"\A\ufeff?---[ \t]*\r?\n(.*?)(?:\r?\n)?---[ \t]*(?:\r?\n|\Z)", re.S)
#: Lines deeper than so many containers are passed over.
MOST_DEPTH = 60
_PAIR = re.compile(r"(\"[^\"]*\"|'[^']*'|[^\s:#\[\]{}\"'-][^:]*?|-[^\s:][^:]*?)[ \t]*:(?:[ \t]+(.*))?$")
_TIGHT = re.compile(r"([A-Za-z_][\w-]*):(?!//)(\S.*)$")
_INLINE = re.compile(r"\s*(\"[^\"]*\"|'[^']*'|\[[^\[\]]*\]|[^,\[\]]+)")
_COMMENT = re.compile(r"\"[^\"]*\"|'[^']*'|[ \t](#.*)$")
TEXT_MARKS = {"|": "\n", "|-": "\n", "|+": "\n", ">": " ", ">-": " ", ">+": " "}


def scalar(raw: str):
    """Flag before decimal before whole number before text; quotes dropped."""
    x = raw.strip()
    if len(x) >= 2 and x[0] == x[-1] and x[0] in "'\"":
        return x[1:-1]
    if x.lower() in ("true", "yes"):
        return True
    if x.lower() in ("false", "no"):
        return False
    if re.fullmatch(r"-?[0-9]+\.[0-9]+", x):
        return float(x)
    return int(x) if re.fullmatch(r"-?[0-9]{1,4000}", x) else x


def value_of(raw: str):
    """A value that stands on one line."""
    x = raw.strip()
    if not (x.startswith("[") and x.endswith("]")):
        return scalar(x)
    parts = (p.strip() for p in _INLINE.findall(x[1:-1]))
    return [value_of(p) if p.startswith("[") else scalar(p) for p in parts if p]


def uncommented(line: str) -> str:
    """A line without its comment; a # inside quotes or a word is none."""
    if line.lstrip().startswith("#"):
        return ""
    for m in _COMMENT.finditer(line):
        if m[1]:
            return line[: m.start(1)]
    return line


class Block:
    """The containers that are open, outermost first, with their columns; and the place that waits for its value."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.open: list[tuple[int, dict | list]] = [(0, self.root)]
        self.waiting: tuple[dict | list, object, int] | None = None

    def line(self, column: int, text: str) -> None:
        item = text == "-" or text.startswith("- ")
        box, key, at = self.waiting or (None, None, column)
        if box is not None and (column > at or item and column == at and isinstance(box, dict)) and len(self.open) < MOST_DEPTH:
            box[key] = [] if item else {}
            self.open.append((column, box[key]))
        self.waiting = None
        while len(self.open) > 1 and (column < self.open[-1][0] or column == self.open[-1][0] and isinstance(self.open[-1][1], list) != item):
            self.open.pop()
        at, box = self.open[-1]
        if column != at or isinstance(box, list) != item:
            return  # fits nowhere
        if item:
            self.entry(column, text, box)
        else:
            self.pair(column, text, box)

    def entry(self, column: int, text: str, box: list) -> None:
        rest = text[1:].lstrip()
        inner = column + len(text) - len(rest)
        if not rest:
            box.append("")
            self.waiting = (box, len(box) - 1, column)
        elif _PAIR.match(rest) and len(self.open) < MOST_DEPTH:
            box.append({})
            self.open.append((inner, box[-1]))
            self.pair(inner, rest, box[-1])
        else:
            box.append(value_of(rest))

    def pair(self, column: int, text: str, box: dict) -> None:
        m = _PAIR.match(text) or _TIGHT.match(text)
        if not m:
            return
        key, value = m[1].strip("\"'"), (m[2] or "").strip()
        box[key] = value_of(value) if value else ""
        if not value:
            self.waiting = (box, key, column)


def subset(block: str) -> dict:
    """The fields of a header block; a field without a value is ''. Never fails."""
    out, lines, i = Block(), block.replace("\r", "").expandtabs(8).split("\n"), 0
    while i < len(lines):
        line = uncommented(lines[i]).rstrip()
        i += 1
        text = line.lstrip()
        if not text:
            continue
        column = len(line) - len(text)
        mark = text.rpartition(":")[2].strip()
        if mark in TEXT_MARKS and text.endswith(mark):  # a block text: all deeper lines, as they are
            own = []
            while i < len(lines) and (not lines[i].strip() or len(lines[i]) - len(lines[i].lstrip()) > column):
                own.append(lines[i])
                i += 1
            left = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
            said = TEXT_MARKS[mark].join(x[left:].rstrip() for x in own).strip("\n ")
            out.line(column, text[: -len(mark)].rstrip())
            if out.waiting:
                box, key, _ = out.waiting
                box[key], out.waiting = said, None
            continue
        out.line(column, text)
    return out.root


def lint_fields(block: str) -> dict[str, str | list[str]]:
    """Fields as the lint's own reader has them: texts as they stand, quotes and all, inline and block lists of texts without their
    quotes; what is indented under a field that has no dash is passed over, and an empty field is an empty list."""
    out: dict[str, str | list[str]] = {}
    takes: list[str] | None = None  # the list that dashes go to
    bare = lambda x: x.strip().strip('"').strip("'")
    for line in block.split("\n"):
        text = line.strip()
        if not text or text[0] == "#":
            continue
        if takes is not None and text.startswith("- "):
            takes.append(bare(text[2:]))
            continue
        name, colon, rest = text.partition(":")
        if colon and out and line.startswith("  "):
            continue
        takes = None
        if not colon:
            continue
        rest = rest.strip()
        if rest.startswith("[") and rest.endswith("]"):
            out[name.strip()] = [bare(x) for x in rest[1:-1].split(",") if x.strip()]
        elif rest:
            out[name.strip()] = rest
        else:
            takes = out[name.strip()] = []
    return out


def read(text: str | None, lint: bool = False) -> tuple[dict, str, str]:
    """(header, body, mode). Mode: yaml (a YAML library is there and takes it), fallback, lint (the stricter one) or none."""
    m = FENCE.match(text or "")
    if not m:
        return {}, text or "", "none"
    body = text[m.end() :]
    try:
        import yaml

        got = yaml.safe_load(m[1])
        if isinstance(got, dict):
            return got, body, "yaml"
    except Exception:  # noqa: BLE001  no library, or not its YAML: the readers here take it
        pass
    return (lint_fields(m[1]), body, "lint") if lint else (subset(m[1]), body, "fallback")


_HEADER = T.StructType().add("header", STRING).add("body", STRING).add("parse_mode", STRING)


def _rows(s: pd.Series, lint: bool) -> pd.DataFrame:
    rows = [read(x, lint) for x in s]
    return pd.DataFrame({"header": [json.dumps(h, default=str, ensure_ascii=False) for h, _, _ in rows], "body": [b for _, b, _ in rows], "parse_mode": [m for _, _, m in rows]})


@pandas_udf(_HEADER)
def header_json(s: pd.Series) -> pd.DataFrame:
    """Header as JSON text, body, and how it was read."""
    return _rows(s, False)


@pandas_udf(_HEADER)
def lint_header_json(s: pd.Series) -> pd.DataFrame:
    """The same by the lint's reader."""
    return _rows(s, True)
