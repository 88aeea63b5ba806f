"""Saved metadata queries, and what their pages look like as JSON and Markdown."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from ..operators.metadata import MAX_PAGE, Query, QueryError

MAX_BYTES = 65_536
_SLUG = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")


def _once(pairs: list[tuple[str, object]]) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise QueryError("a key stands twice in one object")
    return dict(pairs)


def parse_saved_query(id_: str, raw: bytes) -> Query:
    """A saved query of format 1: a slug of at most 64 characters as its id, at most 64 KiB, no key twice in an object."""
    if len(id_) > 64 or not _SLUG.fullmatch(id_):
        raise QueryError("the id is not a lower-case slug")
    if len(raw) > MAX_BYTES:
        raise QueryError("the query is larger than 64 KiB")
    try:
        spec = json.loads(raw.decode("utf-8"), object_pairs_hook=_once)
    except (UnicodeDecodeError, json.JSONDecodeError) as error:
        raise QueryError(f"the query is no JSON: {error}") from error
    if not isinstance(spec, dict) or spec.get("format") != 1 or isinstance(spec["format"], bool):
        raise QueryError("the query is not of format 1")
    return Query.parse({k: v for k, v in spec.items() if k != "format"})


#: Nodes, depth and UTF-16 units of a page's JSON at most.
MAX_NODES, MAX_DEPTH, MAX_UNITS = 100_000, 64, 4 * 1024 * 1024


def _rows(page: DataFrame) -> list:
    """The rows of a page; a larger frame is refused instead of gathered."""
    rows = page.limit(MAX_PAGE + 1).collect()
    if len(rows) > MAX_PAGE:
        raise QueryError(f"a page has at most {MAX_PAGE} rows")
    return rows


def check_size(value: object) -> None:
    """Refuse a value with too many nodes, too deep nesting or too much text for a page."""
    nodes = units = 0
    todo = [(value, 1)]
    while todo:
        part, depth = todo.pop()
        nodes += 1
        if depth > MAX_DEPTH:
            raise QueryError(f"the page is nested deeper than {MAX_DEPTH}")
        if isinstance(part, dict):
            units += sum(len(k.encode("utf-16-le")) // 2 for k in part)
            todo += [(x, depth + 1) for x in part.values()]
        elif isinstance(part, (list, tuple)):
            todo += [(x, depth + 1) for x in part]
        elif isinstance(part, str):
            units += len(part.encode("utf-16-le")) // 2
        if nodes > MAX_NODES or units > MAX_UNITS:
            raise QueryError("the page is too large")


def page_json(page: DataFrame, summary: DataFrame) -> str:
    """A page of at most a thousand rows and its summary as one JSON object."""
    head = summary.first().asDict()
    out = {"schema_version": 1, **{k: v for k, v in head.items() if v is not None}, "rows": [r.asDict(recursive=True) for r in _rows(page)]}
    check_size(out)
    return json.dumps(out, ensure_ascii=False)


def _cell(value: object) -> str:
    text = "" if value is None else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
    text = re.sub(r"[\r\n]+", " ", text.replace("\\", "\\\\").replace("|", "\\|"))
    return "".join(c if c.isprintable() or c == " " else f"\\u{{{ord(c):x}}}" for c in text)


def page_markdown(page: DataFrame) -> str:
    """A page of at most a thousand rows as a Markdown table; bars, line breaks and control characters are escaped."""
    rows = [page.columns, ["---"] * len(page.columns), *([_cell(v) for v in r] for r in _rows(page))]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)
