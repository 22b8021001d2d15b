"""Functions that have no Column form: Unicode normalization, entities, YAML headers, sequence ratio.

All are Arrow-batched over one text column.
"""

from __future__ import annotations

import difflib
import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import headers

STRING = T.StringType()


@pandas_udf(STRING)
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """Compatibility form without marks, ASCII only."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


@pandas_udf(STRING)
def nfkd_plain(s: pd.Series) -> pd.Series:
    """Compatibility form without combining marks, lower case."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).lower())


@pandas_udf(STRING)
def nfkc_key(s: pd.Series) -> pd.Series:
    """Compatibility-composed lower case letters and digits, joined by single spaces."""
    return s.map(lambda x: None if x is None else " ".join(re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKC", x).lower()).split()))


@pandas_udf(STRING)
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two texts."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def title_heading_matches(heading: str, title: str) -> bool:
    """Equal keys, or a ratio of .88 of long keys, or a common prefix of 60."""
    if not heading or not title:
        return False
    if heading == title:
        return True
    if min(len(heading), len(title)) >= 20 and difflib.SequenceMatcher(None, heading, title).ratio() >= 0.88:
        return True
    return len(heading) >= 60 and len(title) >= 60 and heading[:60] == title[:60]


def header_of(text: str) -> tuple[dict, bool]:
    """The header, and whether there is one that no reader takes."""
    m = headers.FENCE.match(text)
    try:
        return headers.read(text)[0], False
    except ValueError:
        return {}, bool(m)


@pandas_udf(STRING)
def header_text(s: pd.Series) -> pd.Series:
    """A JSON header as header text with its fence."""

    def one(raw):
        lines = []
        for k, v in json.loads(raw or "{}").items():
            lines.append(f"{k}: [{', '.join(map(str, v))}]" if isinstance(v, list) and all(not isinstance(x, (dict, list)) for x in v) else f"{k}: {json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v}")
        return "---\n" + "\n".join(lines) + "\n---\n"

    return s.map(one)


@pandas_udf(STRING)
def bibtex_escape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else re.sub(r"(?<!\\)([&%#_])", r"\\\1", x))
