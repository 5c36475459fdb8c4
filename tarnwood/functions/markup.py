"""Markdown: frontmatter, header chunks, titles. Arrow-batched functions, as built-ins cannot carry a parser's state."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that are taken out of a batch at a time.
_TEXTS = 256
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*(?:[ \t]#+[ \t]*)?$")
_FENCE = re.compile(r"^ {0,3}(```+|~~~+)")
_INTEGER, _NUMBER = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_STRONG = re.compile(r"(\*\*|__|\*|_)(?=\S)(.+?)(?<=\S)\1")


def _unquoted(text: str) -> str:
    """Without the blanks, then the double, then the single quotes around it."""
    return text.strip().strip('"').strip("'")


def scalar(value: str):
    """A frontmatter value by its look, quotes aside: 64-bit integer, finite number, boolean, or text."""
    value = _unquoted(value)
    if _INTEGER.fullmatch(value) and -(1 << 63) <= int(value) < 1 << 63:
        return int(value)
    if _NUMBER.fullmatch(value) and math.isfinite(float(value)):
        return float(value)
    low = value.lower()
    return low == "true" if low in ("true", "false") else value


def split_frontmatter(raw: str) -> tuple[dict, str]:
    """``key: value`` lines between a leading ``---`` and the next one, and the rest; without them all is body.

    White space may stand before the first ``---``; comments and lines without a colon are left out.
    """
    start = len(raw) - len(raw.lstrip())
    end = raw.find("\n---", start + 3)
    if not raw.startswith("---", start) or end < 0:
        return {}, raw
    fields = {}
    for line in map(str.strip, raw[start + 3 : end].splitlines()):
        key, colon, value = line.partition(":")
        if colon and not line.startswith("#"):
            fields[_unquoted(key)] = scalar(value)
    return fields, raw[end + 4 :].lstrip("\n")


def _plain(line: str) -> str:
    return _STRONG.sub(r"\2", _LINK.sub(r"\1", line))


def chunks(body: str) -> list[tuple[str, str]]:
    """(heading, text) by second and third level headings.

    Lines of a paragraph keep their breaks and paragraphs run together, as the
    inputs of earlier indexes did; other headings count as text; sections
    without text are left out, and text before any heading is ``Untitled``.
    """
    found, heading, text = [], "", ""
    fence, blank = None, True

    def flush() -> None:
        if text.strip():
            found.append((heading or "Untitled", text.strip()))

    for line in body.splitlines():
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1].startswith(fence):
                fence = None
            else:
                text += line + "\n"
            continue
        if mark:
            fence, blank = mark[1], True
            continue
        head = _HEADING.match(line)
        if head and len(head[1]) in (2, 3):
            flush()
            heading, text, blank = _plain(head[2] or ""), "", True
        elif head:
            text += _plain(head[2] or "")
            blank = True
        elif not line.strip():
            blank = True
        else:
            text += ("" if blank else "\n") + _plain(line.strip())
            blank = False
    flush()
    return found


@F.arrow_udf(T.StructType([T.StructField("frontmatter", T.StringType()), T.StructField("body", T.StringType())]))
def frontmatter(raw: pa.Array) -> pa.Array:
    """Struct of the frontmatter as JSON and the body; a few texts at a time are Python's."""
    parts = []
    for low in range(0, len(raw), _TEXTS):
        split = [split_frontmatter(x or "") for x in raw.slice(low, _TEXTS).to_pylist()]
        fields = pa.array([json.dumps(f, sort_keys=True) for f, _ in split], pa.string())
        parts.append(pa.StructArray.from_arrays([fields, pa.array([b for _, b in split], pa.string())], names=["frontmatter", "body"]))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("frontmatter", pa.string()), ("body", pa.string())]))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("heading", T.StringType()), T.StructField("text", T.StringType())])))
def markdown_chunks(body: pd.Series) -> pd.Series:
    """The header chunks of a body; explode for rows."""
    return pd.Series([[{"heading": h, "text": t} for h, t in chunks(x or "")] for x in body])


def title(body, path):
    """The first top-level heading, or else the file's name without its ending."""
    head = F.regexp_extract(body, r"(?m)^\s*# (.*)$", 1)
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.trim(head), F.lit("")), stem)
