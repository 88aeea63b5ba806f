"""Facts that rules are about, and the evaluation of a list of rules over them.

A fact table has one row for each subject: frontmatter, concept, actor,
directory, file, root or log.  A rule names its subject, a schema and a
message; its findings are one DataFrame, and a profile's findings their union.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import file_kind, implied_directories, normalised_heading, utf16_key
from .rules import SEVERITIES, compile_schema, first_uses, severity_rank

#: Resolutions of links that lead out of a collection or nowhere.
NOT_INTERNAL = ("external", "descriptor", "invalid")
RESOLVED = ("resolvedConcept", "resolvedAsset")
FINDING = "rule_id string, severity string, path string, failing string, message string"
#: A placeholder in a message.
_PLACE = re.compile(r"\{([A-Za-z_]\w*)\}")


def internal(resolution: Column, raw_target: Column) -> Column:
    """Whether a link stays inside its collection: no address, description or broken path, and no mere fragment."""
    return ~resolution.isin(*NOT_INTERNAL) & ~raw_target.startswith("#")


def bundle_relative(raw_target: Column) -> Column:
    """Whether a link is written from the collection's root."""
    return raw_target.startswith("/")


def without_code(body: Column) -> Column:
    """A Markdown body without code blocks and code spans."""
    fenced = F.regexp_replace(body, r"(?ms)^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[ \t]*$|\z)", "")
    return F.regexp_replace(fenced, r"(`+)(?:(?!\1)[^\n])*\1", "")


def footnotes(body: Column, source_ids: Column) -> Column:
    """array<struct<value, referenced, defined, is_source_id>>: labels in order of reference, then those only defined."""
    plain = without_code(body)
    # a definition opens a line and ends its label with a colon
    definition = r"(?m)^ {0,3}\[\^([^\]\n]+)\]:"
    defined = F.array_distinct(F.regexp_extract_all(plain, F.lit(definition), 1))
    referenced = F.array_distinct(F.regexp_extract_all(F.regexp_replace(plain, definition + "[^\n]*", ""), F.lit(r"\[\^([^\]]+)\]"), 1))
    labels = F.concat(referenced, F.array_except(defined, referenced))
    known = F.coalesce(source_ids, F.array().cast("array<string>"))
    return F.transform(
        labels, lambda x: F.struct(x.alias("value"), F.array_contains(referenced, x).alias("referenced"), F.array_contains(defined, x).alias("defined"), F.array_contains(known, x).alias("is_source_id"))
    )


def top_headings(body: Column) -> Column:
    """array<struct<value, normalized>> of a body's first-level headings."""
    found = F.regexp_extract_all(without_code(body), F.lit(r"(?m)^#[ \t]+(.+?)[ \t]*#*[ \t]*$"), 1)
    return F.transform(found, lambda x: F.struct(x.alias("value"), normalised_heading(x).alias("normalized")))


def root_target(href: Column) -> Column:
    """A link of the root index as a path: segments folded, query and fragment dropped; addresses and paths above the root as written."""
    raw = F.trim(href)
    path = F.regexp_replace(raw, r"[?#].*$", "")
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("inside"))

    def step(done: Column, part: Column) -> Column:
        stack, up = done["stack"], part == ".."
        return F.struct(
            F.when((part == "") | (part == "."), stack).when(up, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part))).alias("stack"),
            (done["inside"] & ~(up & (F.size(stack) == 0))).alias("inside"),
        )

    walked = F.aggregate(F.split(path, "/"), start, step)
    folded = F.when(walked["inside"] & (F.size(walked["stack"]) > 0), F.array_join(walked["stack"], "/")).otherwise(raw)
    return F.when(raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | raw.startswith("//"), raw).when(path == "", "index.md").otherwise(folded)


def tag_counts(tags: Column) -> Column:
    """array<struct<value, count>>: each tag, as often as it stands there, with how often that is."""
    return F.transform(tags, lambda t: F.struct(t.alias("value"), F.size(F.filter(tags, lambda x: x == t)).alias("count")))


def directories_of(files: DataFrame) -> DataFrame:
    """path of every directory that files (path) imply, without the root."""
    return files.select(F.explode(implied_directories(F.col("path"))).alias("path")).distinct()


def directory_facts(files: DataFrame) -> DataFrame:
    """path and has_index of every directory but the root."""
    indexes = files.filter(F.col("path").endswith("/index.md")).select(F.regexp_replace("path", "/index\\.md$", "").alias("path"), F.lit(True).alias("there")).distinct()
    return directories_of(files).join(indexes, "path", "left").select("path", F.coalesce("there", F.lit(False)).alias("has_index"), F.concat("path", F.lit("/index.md")).alias("index"))


def file_facts(files: DataFrame) -> DataFrame:
    """path, name and markdown of every file."""
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), (file_kind(F.col("path")) != "asset").alias("markdown"))


def actor_facts(uses: DataFrame) -> DataFrame:
    """id and first_use (path) of every actor, from rows actor, path and seq."""
    return first_uses(uses).select(F.col("actor").alias("id"), F.col("first_path").alias("path"), F.col("first_path").alias("first_use"))


def root_facts(files: DataFrame, concepts: DataFrame) -> DataFrame:
    """One row: path, okf_version, files (names at the root), has_concepts and index_links (null without a root index)."""
    at_root = files.filter(~F.col("path").contains("/")).agg(F.array_sort(F.collect_set("path")).alias("files"))
    text = files.filter("path = 'index.md'").agg(F.min("text").alias("text"))
    links = F.transform(F.regexp_extract_all(without_code(F.col("text")), F.lit(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]*)>?[^)]*\)"), 1), root_target)
    version = F.nullif(F.regexp_extract("text", r"(?s)\A---[ \t]*\n(?:.*?\n)?okf_version:[ \t]*['\"]?([^'\"\n]*?)['\"]?[ \t]*\n.*?---", 1), F.lit(""))
    any_ = concepts.limit(1).agg((F.count("*") > 0).alias("has_concepts"))
    return at_root.join(text).join(any_).select(F.lit("index.md").alias("path"), version.alias("okf_version"), "files", "has_concepts", links.alias("index_links"))


def link_facts(edges: DataFrame) -> DataFrame:
    """path, edges and relationships of every document with links, from edges (source, origin, ordinal, raw_target, resolution, relationship).

    A document's own links are gathered, in order; they are as many as it has.
    """
    flags = [internal(F.col("resolution"), F.col("raw_target")).alias("internal"), bundle_relative(F.col("raw_target")).alias("bundle_relative")]
    one = F.struct("ordinal", F.col("origin"), F.col("raw_target").alias("target"), "resolution", *flags)
    related = F.when(F.col("relationship").isNotNull(), F.struct("ordinal", F.col("relationship").alias("relationship"), F.col("raw_target").alias("target"), "resolution", *flags, F.col("resolution").isin(*RESOLVED).alias("resolved")))
    drop = lambda name: F.transform(F.array_sort(name), lambda x: x.dropFields("ordinal"))
    gathered = edges.groupBy(F.col("source").alias("path")).agg(F.collect_list(one).alias("edges"), F.collect_list(related).alias("relationships"))
    return gathered.select("path", drop("edges").alias("edges"), drop("relationships").alias("relationships"))


def inbound_facts(edges: DataFrame) -> DataFrame:
    """path, relationship and from: a row for each named relationship from another document that resolves to a document."""
    named = edges.filter((F.col("resolution") == "resolvedConcept") & F.col("relationship").isNotNull() & (F.col("resolved_path") != F.col("source")))
    return named.select(F.col("resolved_path").alias("path"), "relationship", F.col("source").alias("from"))


def concept_facts(concepts: DataFrame, files: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row a document: path, type, status, keys, tags, source_ids, headings, footnotes, sibling_directory and, with edges, its links.

    ``concepts`` has path, type, status, keys, tags, source_ids and body.
    Inbound relationships are rows of ``inbound_facts``, not a list: a document
    that everything refers to has very many.
    """
    siblings = directories_of(files).select(F.concat("path", F.lit(".md")).alias("path"), F.lit(True).alias("there"))
    empty = F.array().cast("array<string>")
    own = concepts.join(siblings, "path", "left").select(
        "path",
        "type",
        "status",
        "keys",
        tag_counts(F.coalesce("tags", empty)).alias("tags"),
        F.coalesce("source_ids", empty).alias("source_ids"),
        top_headings(F.coalesce("body", F.lit(""))).alias("headings"),
        footnotes(F.coalesce("body", F.lit("")), F.col("source_ids")).alias("footnotes"),
        F.coalesce("there", F.lit(False)).alias("sibling_directory"),
    )
    if edges is None:
        return own
    linked = own.join(link_facts(edges), "path", "left")
    kinds = {f.name: f.dataType for f in linked.schema}
    return linked.withColumns({n: F.coalesce(n, F.array().cast(kinds[n])) for n in ("edges", "relationships")})


def source_edges(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    """path, id, resource and resolved_path of every source of a document, by the link that its resource is."""
    each = concepts.select("path", F.explode("sources").alias("s")).select("path", F.col("s.id").alias("id"), F.trim("s.resource").alias("resource"))
    known = edges.select(F.col("source").alias("path"), F.trim("raw_target").alias("resource"), "resolved_path").distinct()
    return each.join(known, ["path", "resource"], "left").select("path", "id", "resource", "resolved_path")


def shown(value: Column, kind: T.DataType) -> Column:
    """A fact as text for a message: strings as they are, other values as JSON."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")


def message_of(template: str, facts: DataFrame, failing: Column) -> Column:
    """A message with ``{failing}`` and ``{fact}`` filled in; names that are no fact stay as they are."""
    kinds = {f.name: f.dataType for f in facts.schema}
    parts, at = [], 0
    for place in _PLACE.finditer(template):
        parts.append(F.lit(template[at : place.start()]))
        name = place[1]
        value = failing if name == "failing" else shown(F.col(name), kinds[name]) if name in kinds else F.lit(place[0])
        parts.append(F.coalesce(value, F.lit("null" if name in kinds else "")))
        at = place.end()
    return F.concat(*parts, F.lit(template[at:]))


@dataclass(frozen=True)
class Rule:
    """A rule: what is checked (``subject``, and with ``each`` every element of that fact), by which schema, and what is said.

    ``failing_field`` is what of a failing element is named; ``at`` the column
    that says where.  A rule whose facts come from links ``needs_links``.
    ``valid`` and ``invalid`` are example values that the schema must tell apart.
    With ``wrapped`` elements that are no objects are checked as objects with
    the one property ``value``.
    """

    id: str
    subject: str
    schema: dict
    message: str
    severity: str = "error"
    each: str | None = None
    failing_field: str | None = None
    at: str = "path"
    needs_links: bool = False
    valid: tuple = ()
    invalid: tuple = ()
    kind: str | None = field(default=None)
    wrapped: bool = False


def _accepts(rule: Rule, value: Column, kind: T.DataType) -> Column:
    """Whether a rule's schema accepts an element."""
    if rule.wrapped and not isinstance(kind, T.StructType):
        return compile_schema(rule.schema, F.struct(value.alias("value")), T.StructType([T.StructField("value", kind)]))
    return compile_schema(rule.schema, value, kind)


def _finding(rule: Rule, facts: DataFrame) -> Column:
    """What a rule says of a row of ``facts``, as struct<rule_id, severity, path, failing, message>; null where it accepts it."""

    def told(failing: Column) -> Column:
        text = message_of(rule.message, facts, failing)
        named = (("rule_id", F.lit(rule.id)), ("severity", F.lit(rule.severity)), ("path", F.col(rule.at).cast("string")), ("failing", F.nullif(failing, F.lit(""))), ("message", text))
        return F.struct(*(c.alias(n) for n, c in named))

    if rule.each is None:
        return F.when(~compile_schema(rule.schema, F.struct(*facts.columns), facts.schema), told(F.lit("")))
    kind = facts.schema[rule.each].dataType
    if not isinstance(kind, T.ArrayType):
        return F.when(~_accepts(rule, F.col(rule.each), kind), told(F.coalesce(shown(F.col(rule.each), kind), F.lit("null"))))
    failed = F.filter(rule.each, lambda x: ~_accepts(rule, x, kind.elementType))
    inner = kind.elementType[rule.failing_field].dataType if rule.failing_field else kind.elementType
    names = F.array_distinct(F.transform(failed, lambda x: shown(x[rule.failing_field] if rule.failing_field else x, inner)))
    # the list of one element is worked out once, however often it is used
    return F.element_at(F.transform(F.array(names), lambda n: F.when(F.size(n) > 0, told(F.array_join(n, ", ")))), 1)


def subject_findings(rules: list[Rule], facts: DataFrame) -> DataFrame:
    """rule_id, severity, path, failing and message of all that ``rules`` reject, in one pass over their subject's ``facts``.

    Each row of facts gives an array with a place for every rule, of which the
    findings are exploded; nothing is shuffled.
    """
    found = F.filter(F.array(*(_finding(r, facts) for r in rules)), lambda x: x.isNotNull())
    return facts.select(F.explode(found).alias("finding")).select("finding.*")


def rule_findings(rule: Rule, facts: DataFrame) -> DataFrame:
    """``subject_findings`` of one rule."""
    return subject_findings([rule], facts)


def evaluate(rules: list[Rule], facts: dict[str, DataFrame], builtins: dict[str, Callable[[], DataFrame]] | None = None, links: bool = True) -> DataFrame:
    """All findings of a list of rules over fact tables by subject, and of builtin checks by rule id.

    Each subject's table is read once, whatever the number of its rules.
    Without links, because they could not be read, rules that need them are
    left out.  Builtins give findings of the same columns.
    """
    for rule in rules:
        if rule.severity not in SEVERITIES or rule.subject not in facts:
            raise ValueError(f"rule {rule.id}: unknown severity or subject")
    if len({r.id for r in rules}) != len(rules):
        raise ValueError("two rules have one id")
    by_subject: dict[str, list[Rule]] = {}
    for rule in rules:
        if links or not rule.needs_links:
            by_subject.setdefault(rule.subject, []).append(rule)
    found = [subject_findings(own, facts[subject]) for subject, own in by_subject.items()]
    found += [make() for make in (builtins or {}).values()]
    if not found:
        return next(iter(facts.values())).sparkSession.createDataFrame([], FINDING)
    return reduce(lambda a, b: a.unionByName(b), found)


def check_examples(spark: SparkSession, rule: Rule) -> list[str]:
    """What is wrong with a rule's examples: valid ones that it rejects and invalid ones that it accepts.  ``kind`` is their Spark type."""
    rows = [(True, v) for v in rule.valid] + [(False, v) for v in rule.invalid]
    if not rows:
        return []
    if rule.kind is None:
        raise ValueError(f"rule {rule.id} has examples without a type")
    df = spark.createDataFrame(rows, f"good boolean, value {rule.kind}")
    told = df.select("good", compile_schema(rule.schema, F.col("value"), df.schema["value"].dataType).alias("accepted"), F.to_json(F.struct("value")).alias("value")).collect()
    return [f"{'valid' if r.good else 'invalid'} example {r['value']} is {'accepted' if r.accepted else 'rejected'}" for r in told if r.good != r.accepted]


def with_vocabulary(schema: dict, slots: dict[str, list[str]]) -> dict:
    """A schema with ``{"vocabulary": name}`` in place of the enum of that slot's values; unknown slots are refused."""

    def bind(part: object) -> object:
        if isinstance(part, list):
            return [bind(x) for x in part]
        if not isinstance(part, dict):
            return part
        out = {k: bind(v) for k, v in part.items() if k != "vocabulary"}
        if "vocabulary" in part:
            if part["vocabulary"] not in slots:
                raise ValueError(f"no vocabulary {part['vocabulary']!r}")
            out["enum"] = slots[part["vocabulary"]]
        return out

    return bind(schema)


def united_vocabularies(chain: list[dict[str, list[str]]]) -> dict[str, list[str]]:
    """The slots of a chain of packages, each value once in a slot; a value that two packages bring is refused."""
    out: dict[str, list[str]] = {}
    for package in chain:
        for slot, values in package.items():
            if again := set(values) & set(out.get(slot, ())) or len(set(values)) != len(values):
                raise ValueError(f"vocabulary {slot!r} has a value twice: {again}")
            out.setdefault(slot, []).extend(values)
    return out


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of a severity and of worse ones."""
    if severity not in SEVERITIES:
        raise ValueError(f"a severity is one of {SEVERITIES}")
    return findings.filter(severity_rank(F.col("severity")) <= SEVERITIES.index(severity) + 1)


def in_order(findings: DataFrame) -> DataFrame:
    """Findings in their order for reports: path, rule and message by UTF-16 units."""
    return findings.orderBy(utf16_key(F.col("path")), utf16_key(F.col("rule_id")), utf16_key(F.col("message")))


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings, worst severity first, then as ``in_order``."""
    return findings.orderBy(severity_rank(F.col("severity")), utf16_key(F.col("path")), utf16_key(F.col("rule_id")), utf16_key(F.col("message")))


def groups_in_order(findings: DataFrame, by: str) -> DataFrame:
    """key, worst, size, documents and message (null where they differ) of groups: worst severity first, then larger ones, then by key."""
    rank = F.min(severity_rank(F.col("severity")))
    grouped = findings.groupBy(F.col(by).alias("key")).agg(
        rank.alias("__rank"), F.count("*").alias("size"), F.count_distinct("path").alias("documents"), F.when(F.count_distinct("message") == 1, F.min("message")).alias("message")
    )
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("__rank").cast("int"))
    return grouped.withColumn("worst", worst).orderBy("__rank", F.col("size").desc(), "key").select("key", "worst", "size", "documents", "message")
