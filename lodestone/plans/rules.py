"""Queries that check facts by rules and sum up what they find."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as ru
from ..operators import variant_schema as vs
from ..session import table
from .common import FILES_SQL, PART_SQL, document_files, part_concepts

REQUIRED = {"type": "object", "required": ["title", "description"], "properties": {"title": {"minLength": 9}}}
TAG = {"type": "string", "pattern": "^[a-z]+$", "not": {"enum": ["green", "gear"]}}
TYPES = {"enum": ["PROMO", "SMALL", "LARGE", "MEDIUM"]}
LOGIC = {
    "if": {"properties": {"p_size": {"const": 7}}, "required": ["p_size"]},
    "then": {"required": ["title"]},
    "else": {"anyOf": [{"properties": {"type": {"pattern": "^S"}}}, {"oneOf": [{"required": ["description"]}, {"required": ["status"]}]}]},
}


def _frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = part_concepts(spark, sf_dir)
    return c.select("path", "tags", F.struct("title", "description", "type", "status", "p_size").alias("frontmatter"))


def q_rule_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.schema_findings(_frontmatter(spark, sf_dir), "title-and-description", "error", REQUIRED, "frontmatter")


def q_rule_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.each_findings(_frontmatter(spark, sf_dir), "plain-tags", "warning", TAG, "tags")


def q_rule_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.schema_findings(_frontmatter(spark, sf_dir).withColumn("type", F.col("frontmatter.type")), "known-type", "suggestion", TYPES, "type")


def q_rule_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.schema_findings(_frontmatter(spark, sf_dir), "logic", "warning", LOGIC, "frontmatter")


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [q(spark, sf_dir) for q in (q_rule_required, q_rule_each, q_rule_enum, q_rule_logic)]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.gate(_findings(spark, sf_dir))


def q_findings_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.finding_groups(_findings(spark, sf_dir), "rule_id")


def q_findings_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ru.finding_groups(_findings(spark, sf_dir), "path")


def q_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity counts by brand directory."""
    folder = F.split("path", "/")[0]
    return _findings(spark, sf_dir).groupBy(folder.alias("folder")).agg(*[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in ru.SEVERITIES])


def q_delta_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a change of titles brings beyond those there were."""
    base = _frontmatter(spark, sf_dir)
    changed = base.withColumn("frontmatter", F.col("frontmatter").withField("title", F.when(F.col("frontmatter.p_size") % 4 == 0, F.substring("frontmatter.title", 1, 5)).otherwise(F.col("frontmatter.title"))))
    rule = lambda df: ru.schema_findings(df, "title-and-description", "error", REQUIRED, "frontmatter")
    return ru.introduced(rule(base), rule(changed))


def q_files_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of documents without an index."""
    files = document_files(spark, sf_dir).select(F.concat_ws("/", "bundle", "path").alias("path"))
    required = files.select(F.regexp_replace("path", "/[^/]*$", "/index.md").alias("path")).distinct()
    return ru.missing_files(files, required)


def q_generated_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated directory lists against those of an older state of the collection."""
    files = document_files(spark, sf_dir).filter("path like '%.md' and path not like '%/index.md'").select("doc_id", F.concat_ws("/", "bundle", "path").alias("path"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"))
    return ru.generated_differences(ru.directory_index(files.filter("doc_id % 9 <> 0")), ru.directory_index(files.filter("doc_id % 7 <> 0")))


#: Fields of which each value has a type of its own; tags are nested.
TYPED = {
    "type": "object",
    "required": ["size", "title"],
    "properties": {
        "size": {"type": "integer"},
        "title": {"type": "string", "minLength": 11},
        "tags": {"type": "array", "uniqueItems": True, "items": {"anyOf": [{"enum": ["a", ["b"], {"c": 1}]}, {"$ref": "#/properties/tags"}]}},
    },
}


def q_typed_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts, as JSON whose sizes and tags differ in type from row to row, a schema accepts."""
    n = F.col("p_size")
    size = F.when(n % 5 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).when(n % 5 == 1, F.concat(n.cast("string"), F.lit(".0"))).when(n % 5 == 2, F.concat(n.cast("string"), F.lit(".5"))).otherwise(n.cast("string"))
    tags = F.element_at(F.array(*map(F.lit, ('["a"]', '["a",["b"]]', '["a","a"]', '[{"c":1.0}]', '[["a",["a"]]]', '["d"]', "null"))), (n % 7 + 1).cast("int"))
    title = F.when(F.col("p_partkey") % 11 != 0, F.concat(F.lit(',"title":"'), "p_name", F.lit('"'))).otherwise("")
    text = F.concat(F.lit('{"size":'), size, F.lit(',"tags":'), tags, title, F.lit("}"))
    return table(spark, sf_dir, "part").select("p_partkey", vs.accepts(TYPED, vs.typed(text), depth=3).alias("accepted"))


QUERIES = {
    f.__name__: f
    for f in (q_rule_required, q_rule_each, q_rule_enum, q_rule_logic, q_gate, q_findings_by_rule, q_findings_by_document, q_health, q_delta_gate, q_files_present, q_generated_diff, q_typed_schema)
}


def _found(rule: str, severity: str, where: str, failing: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"SELECT '{rule}' AS rule_id, '{severity}' AS severity, path, {failing} AS failing FROM ({PART_SQL}) WHERE {where}"


_REQUIRED = "title IS NULL OR description IS NULL OR length(title) < 9"
_FAILING = "list_distinct(list_filter(tags, lambda t: NOT regexp_matches(t, '^[a-z]+$') OR t IN ('green', 'gear')))"
_RULES = {
    "q_rule_required": _found("title-and-description", "error", _REQUIRED),
    "q_rule_each": _found("plain-tags", "warning", f"len({_FAILING}) > 0", "array_to_string(list_transform(list_filter(tags, lambda t, i: list_position(tags, t) = i AND (NOT regexp_matches(t, '^[a-z]+$') OR t IN ('green', 'gear'))), lambda t: t), ', ')"),
    "q_rule_enum": _found("known-type", "suggestion", "type NOT IN ('PROMO', 'SMALL', 'LARGE', 'MEDIUM')"),
    "q_rule_logic": _found("logic", "warning", "CASE WHEN p_size = 7 THEN title IS NULL ELSE NOT (prefix(type, 'S') OR ((description IS NOT NULL) <> (status IS NOT NULL))) END"),
}
_ALL = " UNION ALL ".join(_RULES.values())
_GROUP = "list_min(list(CASE severity WHEN 'error' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END))"
_BRANCHES = "SELECT source || '/' || regexp_replace(path, '/[^/]*$', '/index.md') AS path, string_agg('* [Doc ' || doc_id || '](' || 'd' || doc_id || '.md)', chr(10) ORDER BY 'd' || doc_id || '.md') AS content FROM (SELECT bundle AS source, path, doc_id FROM ({files}) WHERE suffix(path, '.md') AND NOT suffix(path, '/index.md') AND doc_id % {k} <> 0) GROUP BY 1"

ORACLES = {
    **_RULES,
    "q_typed_schema": "SELECT p_partkey, p_size % 5 NOT IN (0, 2) AND p_size % 7 IN (0, 1, 3, 4) AND p_partkey % 11 <> 0 AND length(p_name) >= 11 AS accepted FROM part",
    "q_gate": f"SELECT count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'suggestion') AS suggestions, CASE WHEN count(*) FILTER (WHERE severity = 'error') > 0 THEN 'FAIL' ELSE 'PASS' END AS gate FROM ({_ALL})",
    "q_findings_by_rule": f"SELECT rule_id AS key, ['error', 'warning', 'suggestion'][{_GROUP}] AS worst, count(*) AS size, count(DISTINCT path) AS documents FROM ({_ALL}) GROUP BY 1",
    "q_findings_by_document": f"SELECT path AS key, ['error', 'warning', 'suggestion'][{_GROUP}] AS worst, count(*) AS size, count(DISTINCT path) AS documents FROM ({_ALL}) GROUP BY 1",
    "q_health": f"SELECT split_part(path, '/', 1) AS folder, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'suggestion') AS suggestions FROM ({_ALL}) GROUP BY 1",
    "q_delta_gate": f"SELECT 'title-and-description' AS rule_id, path, CAST(1 AS BIGINT) AS n FROM ({PART_SQL}) WHERE NOT ({_REQUIRED}) AND p_size % 4 = 0",
    "q_files_present": f"WITH f AS (SELECT bundle || '/' || path AS path FROM ({FILES_SQL})) SELECT DISTINCT regexp_replace(path, '/[^/]*$', '/index.md') AS path FROM f WHERE regexp_replace(path, '/[^/]*$', '/index.md') NOT IN (SELECT path FROM f)",
    "q_generated_diff": f"SELECT coalesce(e.path, a.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'extra' ELSE 'stale' END AS state FROM ({_BRANCHES.format(files=FILES_SQL, k=9)}) e FULL JOIN ({_BRANCHES.format(files=FILES_SQL, k=7)}) a ON e.path = a.path WHERE e.content IS DISTINCT FROM a.content",
}
