"""Declarative checks: JSON-Schema keywords compiled to Columns, findings, gates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import outside_path

#: Keywords that the compiler knows, and severities, worst first.
ASSERTIONS = (
    "type", "pattern", "minLength", "maxLength", "uniqueItems", "minItems", "maxItems", "format", "enum", "const", "minProperties", "required",
    "properties", "not", "if", "then", "else", "allOf", "anyOf", "oneOf", "items", "contains", "additionalProperties", "propertyNames", "$ref",
)
ANNOTATIONS = ("$schema", "$id", "$defs", "title", "description", "default", "examples", "$comment")
SEVERITIES = ("error", "warning", "suggestion")
DATE_TIME = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


class SchemaError(ValueError):
    """A schema with a keyword or value that cannot be compiled; ``pointer`` says where."""

    def __init__(self, pointer: str, message: str) -> None:
        super().__init__(f"{pointer or '/'}: {message}")
        self.pointer = pointer


def _json_types(kind: T.DataType) -> tuple[str, ...]:
    if isinstance(kind, T.StringType):
        return ("string",)
    if isinstance(kind, T.BooleanType):
        return ("boolean",)
    if isinstance(kind, T.IntegralType):
        return ("integer", "number")
    if isinstance(kind, T.NumericType):
        return ("number",)
    if isinstance(kind, T.ArrayType):
        return ("array",)
    return ("object",)


def _all(parts: list[Column]) -> Column:
    return reduce(and_, parts, F.lit(True))


def compile_schema(schema: dict | bool, value: Column, kind: T.DataType, root: dict | None = None, pointer: str = "") -> Column:
    """A Column, never null, that is true where ``value`` of type ``kind`` is valid.

    A null field is an absent property.  A keyword constrains values of its own
    type only: a string keyword says nothing about a number.
    """
    if isinstance(schema, bool):
        return F.lit(schema)
    if not isinstance(schema, dict):
        raise SchemaError(pointer, "a schema is an object or a boolean")
    root = schema if root is None else root
    for key in schema:
        if key not in ASSERTIONS and key not in ANNOTATIONS:
            raise SchemaError(f"{pointer}/{key}", "unsupported keyword")
    there, own = value.isNotNull(), _json_types(kind)
    sub = lambda s, path: compile_schema(s, value, kind, root, pointer + path)
    checks: list[Column] = []
    if "$ref" in schema:
        target: dict | bool = root
        if not schema["$ref"].startswith("#"):
            raise SchemaError(pointer + "/$ref", "only local references are known")
        for part in schema["$ref"].lstrip("#").strip("/").split("/"):
            if part:
                target = target[part.replace("~1", "/").replace("~0", "~")]
        checks.append(compile_schema(target, value, kind, root, pointer + "/$ref"))
    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        whole = (value % 1 == 0) if "integer" in wanted and own == ("number",) else None
        ok = F.lit(bool(set(wanted) & set(own))) if whole is None or "number" in wanted else whole
        checks.append(F.when(there, ok).otherwise(F.lit("null" in wanted)))
    if "enum" in schema or "const" in schema:
        options = schema.get("enum", [schema["const"]] if "const" in schema else [])
        fitting = [o for o in options if (isinstance(o, str) and "string" in own) or (isinstance(o, bool) and "boolean" in own) or (isinstance(o, (int, float)) and not isinstance(o, bool) and "number" in own)]
        checks.append(F.when(there, value.isin(*fitting) if fitting else F.lit(False)).otherwise(F.lit(None in options)))
    if "string" in own:
        if "pattern" in schema:
            checks.append(value.rlike(schema["pattern"]))
        if "minLength" in schema:
            checks.append(F.length(value) >= schema["minLength"])
        if "maxLength" in schema:
            checks.append(F.length(value) <= schema["maxLength"])
        if "format" in schema:
            if schema["format"] != "date-time":
                raise SchemaError(pointer + "/format", "only date-time is known")
            checks.append(value.rlike(DATE_TIME) & F.try_to_timestamp(value).isNotNull())
    if "array" in own:
        inner = kind.elementType
        each = lambda s, path: lambda x: compile_schema(s, x, inner, root, pointer + path)
        if schema.get("uniqueItems"):
            checks.append(F.size(F.array_distinct(value)) == F.size(value))
        if "minItems" in schema:
            checks.append(F.size(value) >= schema["minItems"])
        if "maxItems" in schema:
            checks.append(F.size(value) <= schema["maxItems"])
        if "items" in schema:
            checks.append(F.forall(value, each(schema["items"], "/items")))
        if "contains" in schema:
            checks.append(F.exists(value, each(schema["contains"], "/contains")))
    if isinstance(kind, T.StructType):
        fields = {f.name: f.dataType for f in kind.fields}
        for name in schema.get("required", []):
            checks.append(value[name].isNotNull() if name in fields else F.lit(False))
        for name, part in schema.get("properties", {}).items():
            if name in fields:
                checks.append(value[name].isNull() | compile_schema(part, value[name], fields[name], root, f"{pointer}/properties/{name}"))
        if "additionalProperties" in schema:
            for name in set(fields) - set(schema.get("properties", {})):
                checks.append(value[name].isNull() | compile_schema(schema["additionalProperties"], value[name], fields[name], root, pointer + "/additionalProperties"))
        if "propertyNames" in schema:
            for name in fields:
                checks.append(value[name].isNull() | compile_schema(schema["propertyNames"], F.lit(name), T.StringType(), root, pointer + "/propertyNames"))
        if "minProperties" in schema:
            checks.append(reduce(lambda a, b: a + b, (F.when(value[n].isNotNull(), 1).otherwise(0) for n in fields)) >= schema["minProperties"])
    for k, part in enumerate(schema.get("allOf", [])):
        checks.append(sub(part, f"/allOf/{k}"))
    if "anyOf" in schema:
        checks.append(reduce(or_, (sub(part, f"/anyOf/{k}") for k, part in enumerate(schema["anyOf"]))))
    if "oneOf" in schema:
        checks.append(reduce(lambda a, b: a + b, (sub(part, f"/oneOf/{k}").cast("int") for k, part in enumerate(schema["oneOf"]))) == 1)
    if "not" in schema:
        checks.append(~sub(schema["not"], "/not"))
    if "if" in schema:
        test = sub(schema["if"], "/if")
        checks.append(F.when(test, sub(schema.get("then", True), "/then")).otherwise(sub(schema.get("else", True), "/else")))
    # what a check says of an absent value never means rejected
    return _all([F.coalesce(c, F.lit(True)) for c in checks])


def schema_findings(facts: DataFrame, rule_id: str, severity: str, schema: dict, fact: str, path: str = "path") -> DataFrame:
    """One finding for each row whose ``fact`` column the schema rejects; null facts are skipped."""
    kind = facts.schema[fact].dataType
    bad = facts.filter(F.col(fact).isNotNull() & ~compile_schema(schema, F.col(fact), kind))
    return bad.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.col(path).cast("string").alias("path"), F.lit(None).cast("string").alias("failing"))


def each_findings(facts: DataFrame, rule_id: str, severity: str, schema: dict, fact: str, path: str = "path") -> DataFrame:
    """One finding for each row with rejected elements in list ``fact``; they are named in ``failing``, each once."""
    kind = facts.schema[fact].dataType.elementType
    failing = F.array_distinct(F.filter(fact, lambda x: ~compile_schema(schema, x, kind)))
    bad = facts.withColumn("__failing", failing).filter(F.size("__failing") > 0)
    return bad.select(F.lit(rule_id).alias("rule_id"), F.lit(severity).alias("severity"), F.col(path).cast("string").alias("path"), F.array_join(F.transform("__failing", lambda x: x.cast("string")), ", ").alias("failing"))


def missing_files(inventory: DataFrame, required: DataFrame) -> DataFrame:
    """Required paths (path) that the inventory (path) lacks."""
    return required.join(inventory.select("path"), "path", "left_anti")


def generated_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and state (missing, stale, extra) between generated and stored files (path, content)."""
    a, b = expected.select("path", F.col("content").alias("e")), actual.select("path", F.col("content").alias("a"))
    both = a.join(b, "path", "full_outer").filter(~F.col("e").eqNullSafe(F.col("a")))
    return both.select("path", F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").otherwise("stale").alias("state"))


def generated_fixes(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path and content of the generated files that are missing or stale, as they should be."""
    wanted = generated_differences(expected, actual).filter("state <> 'extra'").select("path")
    return expected.join(wanted, "path", "left_semi").select("path", "content")


def gate(findings: DataFrame, incomplete: bool = False) -> DataFrame:
    """errors, warnings, suggestions and gate (FAIL, INCOMPLETE or PASS) in one row."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}s") for s in SEVERITIES]
    state = F.when(F.col("errors") > 0, "FAIL").otherwise("INCOMPLETE" if incomplete else "PASS")
    return findings.agg(*counts).withColumn("gate", state)


def introduced(base: DataFrame, candidate: DataFrame) -> DataFrame:
    """Findings of ``candidate`` beyond those of ``base``, by rule and path, as a multiset: rule_id, path and n."""
    count = lambda df, label: df.groupBy("rule_id", "path").agg(F.count("*").alias(label))
    both = count(candidate, "c").join(count(base, "b"), ["rule_id", "path"], "left")
    return both.select("rule_id", "path", (F.col("c") - F.coalesce("b", F.lit(0))).alias("n")).filter("n > 0")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def finding_groups(findings: DataFrame, by: str) -> DataFrame:
    """key, worst severity, size and number of documents of findings by rule or path."""
    worst = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.min(severity_rank(F.col("severity"))).cast("int"))
    return findings.groupBy(F.col(by).alias("key")).agg(worst.alias("worst"), F.count("*").alias("size"), F.count_distinct("path").alias("documents"))


def directory_lines(concepts: DataFrame) -> DataFrame:
    """path (of the directory's ``index.md``), name and line of each document: a directory's list as rows, however long it is."""
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    name = F.element_at(F.split("path", "/"), -1)
    line = F.concat(F.lit("* ["), F.coalesce("title", name), F.lit("]("), name, F.lit(")"))
    return concepts.select(F.concat(folder, F.lit("index.md")).alias("path"), name.alias("name"), line.alias("line"))


def directory_index(concepts: DataFrame) -> DataFrame:
    """path and content of the ``index.md`` that lists each directory's documents by path.

    A content is one file's text and is as long as its directory; to compare
    lists without making them, use ``directory_lines``.
    """
    rows = directory_lines(concepts).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("lines"))
    return rows.select("path", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("content"))


def actors(documents: DataFrame) -> DataFrame:
    """actor and path of everyone named in generated.by, verified[].by and sources[].author; blank names are left out."""
    named = F.concat(F.array(F.col("generated")["by"]), F.transform(F.coalesce("verified", F.array()), lambda v: v["by"]), F.transform(F.coalesce("sources", F.array()), lambda s: s["author"]))
    return documents.select("path", F.explode(F.filter(named, lambda x: F.trim(x) != "")).alias("actor"))


def first_uses(uses: DataFrame) -> DataFrame:
    """actor, first path and number of uses, from rows (actor, path, seq)."""
    return uses.groupBy("actor").agg(F.min_by("path", F.struct("seq", "path")).alias("first_path"), F.count("*").alias("uses"))


def broken_links(resolved: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """Findings for links that name nothing in the collection, once for each document and target.

    ``outside`` (path, beginning with ``../``) lists what is there beside the
    collection: links that lead to it are no findings.
    """
    bad = resolved.filter(F.col("resolution").isin("unresolved", "invalid")).select("source", "raw_target").distinct()
    if outside is not None:
        there = outside.select(F.col("path").alias("__outside")).distinct()
        bad = bad.withColumn("__outside", outside_path(F.col("source"), F.col("raw_target"))).join(there, "__outside", "left_anti")
    return bad.select(F.lit("path-targets-exist").alias("rule_id"), F.lit("error").alias("severity"), F.col("source").alias("path"), F.col("raw_target").alias("failing"))


def repeated_elements(facts: DataFrame, fact: str | Column) -> DataFrame:
    """path, value and n of elements that a list fact of plain values (a column's name or an expression) holds more than once.

    Rows are dealt and sorted by path before lists are unfolded, and counted path
    by path, so what is shuffled is each list once, and a task counts one path
    at a time.
    """
    fact = F.col(fact) if isinstance(fact, str) else fact
    value = facts.select(fact.alias("f")).schema["f"].dataType.elementType
    schema = T.StructType([T.StructField("path", facts.schema["path"].dataType), T.StructField("value", value), T.StructField("n", T.LongType(), False)])
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, found = None, Counter(), []
        for batch in batches:
            for path, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != at:
                    found += [(at, v, k) for v, k in n.items() if k > 1]
                    at, n = path, Counter()
                n.update(values or ())
            yield told(found)
            found = []
        yield told([(at, v, k) for v, k in n.items() if k > 1])

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(shape.types)], schema=shape)

    return facts.repartition("path").sortWithinPartitions("path").select("path", fact.alias("f")).mapInArrow(run, schema)
