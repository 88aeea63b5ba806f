"""Text, path and identifier functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_whitespace_length(text: Column) -> Column:
    """Characters other than space and U+0009 to U+000D, in code points."""
    return F.length(F.regexp_replace(text, r"[ \t-\r]", ""))


def fits_budget(text: Column, limit: int) -> Column:
    """Whether a text's non-white-space characters are within ``limit``."""
    return non_whitespace_length(text) <= limit


def utf16_key(text: Column) -> Column:
    """Sort key that orders text by UTF-16 code units; Spark's own order is by UTF-8 bytes."""
    return F.encode(text, "UTF-16BE")


def contains_text(text: Column, wanted: str) -> Column:
    """Literal containment in any case; null texts contain nothing."""
    return F.coalesce(F.lower(text).contains(wanted.lower()), F.lit(False))


def humanise(text: Column) -> Column:
    """``snake-case`` or ``snake_case`` as words with a capital."""
    words = F.trim(F.regexp_replace(text, "[-_]+", " "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words)))


def counted(number: Column, noun: str) -> Column:
    """``1 file``, ``2 files``."""
    return F.concat(number.cast("string"), F.lit(f" {noun}"), F.when(number == 1, "").otherwise("s"))


def normalised_heading(text: Column) -> Column:
    """A heading as headings are compared: without spaces around it, in lower case."""
    return F.lower(F.trim(text))


def concept_id(path: Column) -> Column:
    """A document's id: its path without ``.md``."""
    return F.regexp_replace(path, r"\.md$", "")


def file_kind(path: Column) -> Column:
    """index, log, concept or asset; the extension is case-sensitive."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.when(~path.endswith(".md"), "asset").when(name == "index.md", "index").when(name == "log.md", "log").otherwise("concept")


def content_type(path: Column) -> Column:
    """Content type by extension, in any case; unknown extensions are text."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(".ts", ".tsx"), "typescript").when(ext == ".dart", "dart").otherwise("text")


def normalised_path(path: Column) -> Column:
    """Trimmed, with ``/`` for ``\\`` and without trailing slashes."""
    return F.regexp_replace(F.translate(F.trim(path), "\\", "/"), r"(?<=.)/+$", "")


def normalise_path(path: str) -> str:
    """``normalised_path`` of a filter value."""
    path = path.strip().replace("\\", "/")
    return path.rstrip("/") or path[:1]


def glob_regex(pattern: str) -> str:
    """Regular expression of a glob: ``**/`` any directories, ``**`` anything, ``*`` one level.

    The glob may match the whole path or what follows any ``/`` in it.
    """
    parts = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*"}
    body = "".join(parts.get(p) or re.sub(r"([^\w/])", r"\\\1", p) for p in re.split(r"(\*\*/|\*\*|\*)", pattern))
    return f"^(?:.*/)?{body}$"


def chunk_id(path: Column, start: Column, end: Column, kind: Column, content: Column) -> Column:
    """Stable id of a passage: SHA-1 over its place, type and the SHA-1 of its content."""
    return F.sha1(F.concat_ws("|", path, start.cast("string"), end.cast("string"), kind, F.sha1(content)))


def scoped_id(namespace: Column, raw_id: Column) -> Column:
    """Id of a passage within a namespace; both parts as a JSON list, hashed."""
    return F.sha2(F.to_json(F.array(namespace, raw_id)), 256)


def citation(path: Column, start: Column, end: Column) -> Column:
    """``path:start-end``."""
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def parse_citation(text: Column) -> Column:
    """Struct of path, start and end; null fields where the text is no citation."""
    pattern = r"^(.+):(\d+)-(\d+)$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("path"), part(2).cast("int").alias("start"), part(3).cast("int").alias("end"))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line that holds the 0-based character ``offset``."""
    before = F.substring(text, F.lit(1), offset)
    return 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def implied_directories(path: Column) -> Column:
    """All directories above a path, shortest first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def context_text(title: Column, description: Column, section: Column, language: Column, passage: Column) -> Column:
    """What a passage is embedded with: its title, description (240 characters), section and code language, blank-line separated."""
    label = lambda name, x: F.when(F.length(x) > 0, F.concat(F.lit(f"{name}: "), x))
    return F.concat_ws("\n\n", label("Title", title), label("Description", F.substring(description, 1, 240)), label("Section", section), label("Code language", language), label("Passage", passage))


def escape_cell(text: Column) -> Column:
    """A text for one cell of a Markdown table: bars and backslashes escaped, line breaks as spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"([\\|])", r"\\$1"), r"[\r\n]+", " ")


#: Fixed value: a resource that pins a commit, and perhaps a path in it.
GIT_RESOURCE = r"^git:([0-9a-fA-F]{7,64})(?::(.*))?$"


def is_git_resource(resource: Column) -> Column:
    return F.trim(resource).rlike(GIT_RESOURCE)


def last_segment(path: Column) -> Column:
    """The last part of a path that is not empty; null if there is none."""
    return F.nullif(F.regexp_extract(path, r"([^/]+)/*$", 1), F.lit(""))


def resource_label(resource: Column) -> Column:
    """A resource for people: a pinned commit in short with its file's name, anything else as written."""
    pin = F.trim(resource)
    commit = F.lower(F.substring(F.regexp_extract(pin, GIT_RESOURCE, 1), 1, 7))
    label = F.concat_ws(" · ", F.lit("git"), commit, last_segment(F.trim(F.regexp_extract(pin, GIT_RESOURCE, 2))))
    return F.when(is_git_resource(resource), label).otherwise(resource)


def short_target(target: Column) -> Column:
    """A short name of a link's target that is no document: a pin's label, an address's host and last segment, a path's last segment."""
    rest = F.regexp_replace(target, r"^https?://|[?#].*$", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/@]*@)?([^/:]*)", 1))
    tail = last_segment(F.regexp_extract(rest, r"^[^/]*(/.*)?$", 1))
    address = F.concat_ws("/", host, F.coalesce(F.try_url_decode(F.replace(tail, F.lit("+"), F.lit("%2B"))), tail))
    return F.when(is_git_resource(target), resource_label(target)).when(target.rlike("^https?://"), address).otherwise(F.coalesce(last_segment(target), target))


def shown_date(day: Column) -> Column:
    """``26 Aug 2026``."""
    return F.date_format(day, "d MMM yyyy")


def last_verified(verified: Column) -> Column:
    """The latest time of an array of verifications (by, at); unreadable times count for nothing."""
    return F.array_max(F.transform(verified, lambda v: F.try_to_timestamp(v["at"])))


def escaped_controls(text: Column) -> Column:
    """A text without control and format characters other than tab and line feed, for output in a terminal."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Cf}&&[^\t\n]]", "\uFFFD")


def fragment_id(parent: Column, start: Column, end: Column) -> Column:
    """Id of a part of a passage: its parent's id and its range as a JSON list, hashed."""
    head = F.regexp_replace(F.to_json(F.array(parent)), r"\]$", "")
    return F.sha2(F.concat(head, F.lit(","), start.cast("string"), F.lit(","), end.cast("string"), F.lit("]")), 256)


def link_class(raw_target: Column) -> Column:
    """What a link in a text leads to: anchor, web, other (any other address) or file."""
    raw = F.trim(raw_target)
    return F.when(raw.startswith("#"), "anchor").when(raw.rlike("(?i)^https?://"), "web").when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | raw.startswith("//") | (raw == ""), "other").otherwise("file")
