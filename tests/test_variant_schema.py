"""Schemas over variants against a plain evaluator, and what is refused."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import facts as fa
from lodestone.operators.variant_schema import SchemaError, accepts, typed

VALUES = [
    None, True, False, 0, 1, 1.0, -3, 2.5, 1e2, 100, 12345678901234567890, "", "a", "1", "ab", "äöü🙂", [], [1], [1, 1.0], ["a"], ["a", "a"], [["a"]], [[1], [1.0]], [None], [1, "1", True],
    {}, {"a": 1}, {"a": 1.0}, {"a": "x", "b": [1]}, {"b": 2, "a": 1}, {"a": {"a": {"a": 1}}}, {"a": [{"a": []}]}, {"x y": 1}, {"a": None}, [{"a": 1, "b": 2}, {"b": 2.0, "a": 1}], {"next": {"next": {"value": 3}}},
]
SCHEMAS = [
    True, False, {}, {"type": "integer"}, {"type": ["number", "null"]}, {"type": "string", "minLength": 2}, {"maxLength": 1}, {"pattern": "^a"}, {"const": 1}, {"const": ["a"]}, {"const": {"a": 1, "b": 2}},
    {"enum": [["a"], {"a": 1}, None, 100]}, {"enum": []}, {"items": {"type": "integer"}}, {"uniqueItems": True}, {"uniqueItems": False}, {"contains": {"const": 1}}, {"minItems": 1, "maxItems": 1},
    {"properties": {"a": {"type": "integer"}}}, {"required": ["a"]}, {"required": ["a", "b"], "additionalProperties": False, "properties": {"a": True, "b": True}}, {"additionalProperties": {"type": "integer"}},
    {"propertyNames": {"pattern": "^[a-z]+$"}}, {"minProperties": 1, "maxProperties": 1}, {"allOf": [{"type": "integer"}, {"minimum": 1}]}, {"anyOf": [{"type": "string"}, {"maximum": 0}]},
    {"oneOf": [{"type": "integer"}, {"type": "number"}]}, {"not": {"type": "string"}}, {"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "array"}}, {"if": {"type": "string"}, "then": False},
    {"$ref": "#/$defs/n", "$defs": {"n": {"type": "integer"}}, "title": "x"}, {"allOf": [{"type": "array"}, {"$ref": "#/allOf/0"}]},
    {"anyOf": [{"type": "integer"}, {"type": "object", "additionalProperties": {"$ref": "#"}}, {"type": "array", "items": {"$ref": "#"}}]},
    {"$defs": {"a/b": {"properties": {"next": {"$ref": "#/$defs/a~1b"}, "value": {"const": 3}}}}, "$ref": "#/$defs/a~1b"},
]


def plain(schema, v, root):
    if isinstance(schema, bool):
        return schema
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    kinds = {"null": v is None, "boolean": isinstance(v, bool), "string": isinstance(v, str), "array": isinstance(v, list), "object": isinstance(v, dict), "number": number, "integer": number and v == int(v)}

    def same(a, b):
        if isinstance(a, bool) or isinstance(b, bool) or a is None or b is None:
            return a is b
        if isinstance(a, list) and isinstance(b, list):
            return len(a) == len(b) and all(map(same, a, b))
        if isinstance(a, dict) and isinstance(b, dict):
            return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
        return a == b

    sub = lambda s, x: plain(s, x, root)
    for key, arg in schema.items():
        if key == "type" and not any(kinds[t] for t in ([arg] if isinstance(arg, str) else arg)):
            return False
        if key == "const" and not same(arg, v) or key == "enum" and not any(same(a, v) for a in arg):
            return False
        if key == "$ref":
            at = root
            for part in arg.split("/")[1:]:
                at = at[int(part)] if isinstance(at, list) else at[part.replace("~1", "/").replace("~0", "~")]
            if not sub(at, v):
                return False
        if key == "allOf" and not all(sub(s, v) for s in arg) or key == "anyOf" and not any(sub(s, v) for s in arg) or key == "oneOf" and sum(sub(s, v) for s in arg) != 1 or key == "not" and sub(arg, v):
            return False
        if key == "if" and not sub(schema.get("then" if sub(arg, v) else "else", True), v):
            return False
        if number and (key == "minimum" and v < arg or key == "maximum" and v > arg):
            return False
        if isinstance(v, str) and (key == "minLength" and len(v) < arg or key == "maxLength" and len(v) > arg or key == "pattern" and not re.search(arg, v)):
            return False
        if isinstance(v, list):
            if key == "items" and not all(sub(arg, x) for x in v) or key == "contains" and not any(sub(arg, x) for x in v) or key == "minItems" and len(v) < arg or key == "maxItems" and len(v) > arg:
                return False
            if key == "uniqueItems" and arg and any(same(a, b) for i, a in enumerate(v) for b in v[:i]):
                return False
        if isinstance(v, dict):
            if key == "properties" and not all(sub(s, v[k]) for k, s in arg.items() if k in v) or key == "required" and not set(arg) <= set(v) or key == "propertyNames" and not all(sub(arg, k) for k in v):
                return False
            if key == "additionalProperties" and not all(sub(arg, x) for k, x in v.items() if k not in schema.get("properties", {})) or key == "minProperties" and len(v) < arg or key == "maxProperties" and len(v) > arg:
                return False
    return True


def told(spark, schemas, values):
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in enumerate(values)], "k int, text string").coalesce(1).withColumn("v", typed(F.col("text")))
    rows = df.select("k", *(accepts(s, F.col("v")).alias(f"s{n}") for n, s in enumerate(schemas))).orderBy("k").collect()
    return [[r[f"s{n}"] for r in rows] for n in range(len(schemas))]


def test_every_keyword_against_a_plain_evaluator(spark):
    for start in range(0, len(SCHEMAS), 12):
        some = SCHEMAS[start : start + 12]
        for schema, got in zip(some, told(spark, some, VALUES)):
            for value, said in zip(VALUES, got):
                assert said == plain(schema, value, schema), (schema, value, said)


def test_random_schemas_and_values(spark):
    pick = random.Random(5)

    def value(d):
        kind = pick.randrange(7 if d else 5)
        return [None, pick.choice([True, False]), pick.randrange(3), pick.choice([0.5, 2.0]), pick.choice(["", "a", "ab"]), [value(d - 1) for _ in range(pick.randrange(3))] if d else 0, {k: value(d - 1) for k in pick.sample("abc", pick.randrange(3))} if d else 0][kind]

    def schema(d):
        out = {}
        for _ in range(pick.randrange(1, 3)):
            key = pick.choice(["type", "const", "enum", "minLength", "minItems", "uniqueItems", "required", *(["items", "properties", "additionalProperties", "anyOf", "oneOf", "not", "contains"] if d else [])])
            out[key] = {
                "type": lambda: pick.choice(["string", "integer", "array", "object", ["null", "number"]]), "const": lambda: value(1), "enum": lambda: [value(1), value(1)], "minLength": lambda: 1, "minItems": lambda: 1, "uniqueItems": lambda: True,
                "required": lambda: ["a"], "items": lambda: schema(d - 1), "properties": lambda: {"a": schema(d - 1)}, "additionalProperties": lambda: schema(d - 1), "anyOf": lambda: [schema(d - 1), schema(d - 1)],
                "oneOf": lambda: [schema(d - 1), schema(d - 1)], "not": lambda: schema(d - 1), "contains": lambda: schema(d - 1),
            }[key]()
        return out

    values, schemas = [value(3) for _ in range(150)], [schema(2) for _ in range(15)]
    for s, got in zip(schemas, told(spark, schemas, values)):
        assert got == [plain(s, v, s) for v in values], s


def test_what_cannot_be_compiled_or_told(spark):
    v = F.col("v")
    for bad, place in (({"nope": 1}, "#/nope"), ({"type": "text"}, "#/type"), ({"items": 3}, "#/items"), ({"$ref": "other.json"}, "only references"), ({"$ref": "#/$defs/x"}, "leads nowhere"), ({"anyOf": [{"type": "string"}, {"$ref": "#"}]}, "back to itself"), ({"minLength": -1}, "#/minLength"), ({"allOf": []}, "#/allOf")):
        with pytest.raises(SchemaError, match=re.escape(place)):
            accepts(bad, v)
    nested = {"items": {"$ref": "#"}, "type": "array"}
    df = spark.createDataFrame([("[[[]]]",), ("not json",)], "text string").withColumn("v", typed(F.col("text")))
    assert [r[0] for r in df.select(accepts(nested, v, depth=3)).collect()] == [True, None]
    with pytest.raises(Exception, match="goes deeper than 1 turns"):
        df.select(accepts(nested, v, depth=1)).collect()


def test_all_rules_of_a_subject_read_it_once(spark, tmp_path):
    spark.createDataFrame([("p1", "ring", ["a", "b"]), ("p2", None, ["c"])], "path string, title string, tags array<string>").write.parquet(f"file://{tmp_path}/facts")
    facts = spark.read.parquet(f"file://{tmp_path}/facts")
    rules = [fa.Rule(f"r{k}", "concept", {"properties": {"title": {"type": "string", "minLength": k % 7}}}, "title {title} of {path}") for k in range(20)]
    rules += [fa.Rule(f"e{k}", "concept", {"enum": ["a", "b"][: k % 3]} if k % 3 else {"type": "string"}, "{failing}", each="tags") for k in range(18)]
    found = fa.evaluate(rules, {"concept": facts})
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    one_by_one = [r for rule in rules for r in fa.rule_findings(rule, facts).collect()]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, one_by_one), key=str) and one_by_one
