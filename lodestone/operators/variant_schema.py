"""JSON Schemas as Columns over VARIANT values, each of which has a type of its own.

A schema is compiled into one boolean expression: types are read off the value
(``1`` is an integer, ``"1"`` is not, whatever other rows hold), arrays and
objects are compared by canonical JSON, and local references, also recursive
ones, are unrolled to a stated depth.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keywords that say nothing about a value.
ANNOTATIONS = {"title", "description", "default", "examples", "deprecated", "format", "$comment", "$schema", "$id", "$defs"}
#: Turns that a recursive reference is unrolled, and expressions that a schema may unroll to.
DEPTH, MOST = 8, 20_000
NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


class SchemaError(ValueError):
    """A schema that cannot be compiled, with the JSON pointer of the place."""


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is(v: Column, name: str, pointer: str) -> Column:
    kind = _kind(v)
    number = kind.rlike(NUMBER)
    found = {
        "object": kind.startswith("OBJECT"), "array": kind.startswith("ARRAY"), "string": kind == "STRING", "boolean": kind == "BOOLEAN", "null": kind == "VOID",
        "number": number, "integer": number & (F.try_variant_get(v, "$", "double") % 1 == 0),
    }.get(name)
    if found is None:
        raise SchemaError(f"{pointer}: no type {name!r}")
    return F.coalesce(found, F.lit(False))


def canonical(v: Column) -> Column:
    """One text for equal JSON values: keys in order, numbers without closing zeros."""
    number = F.try_variant_get(v, "$", "double")
    whole = (number == F.round(number)) & (F.abs(number) < 1e15)
    return F.when(_kind(v).rlike("^(FLOAT|DOUBLE)") & whole, number.cast("long").cast("string")).otherwise(F.to_json(v))


class _Compiler:
    def __init__(self, root: object, depth: int) -> None:
        self.root, self.depth, self.made = root, depth, 0

    def target(self, ref: object, pointer: str) -> object:
        if not isinstance(ref, str) or not ref.startswith("#"):
            raise SchemaError(f"{pointer}: only references inside the schema are known")
        at = self.root
        for part in ref[1:].split("/")[1:]:
            name = part.replace("~1", "/").replace("~0", "~")
            if isinstance(at, dict) and name in at:
                at = at[name]
            elif isinstance(at, list) and name.isdigit() and int(name) < len(at):
                at = at[int(name)]
            else:
                raise SchemaError(f"{pointer}: {ref} leads nowhere")
        return at

    def compile(self, schema: object, v: Column, pointer: str, turns: dict[str, int], here: frozenset[str] = frozenset()) -> Column:
        """``turns`` counts how often a reference was unrolled above, ``here`` holds those that led to this very value."""
        self.made += 1
        if self.made > MOST:
            raise SchemaError(f"the schema unrolls to more than {MOST} expressions at depth {self.depth}")
        if isinstance(schema, bool):
            return F.lit(schema)
        if not isinstance(schema, dict):
            raise SchemaError(f"{pointer}: a schema is an object or a boolean")
        parts = []
        for key, arg in schema.items():
            if key in ANNOTATIONS or key in ("then", "else"):
                continue
            make = getattr(self, "_" + key.lstrip("$"), None) if key.isidentifier() or key == "$ref" else None
            if make is None:
                raise SchemaError(f"{pointer}/{key}: unknown keyword")
            parts.append(make(arg, v, f"{pointer}/{key}", turns, here, schema))
        return reduce(and_, parts, F.lit(True))

    def _deeper(self, schema: object, v: Column, pointer: str, turns: dict[str, int]) -> Column:
        return self.compile(schema, v, pointer, turns)

    def _all(self, many: object, pointer: str) -> list:
        if not isinstance(many, list) or not many:
            raise SchemaError(f"{pointer}: a list of schemas is needed")
        return list(enumerate(many))

    def _number_of(self, arg: object, pointer: str) -> int:
        if isinstance(arg, bool) or not isinstance(arg, (int, float)) or arg < 0 or arg != int(arg):
            raise SchemaError(f"{pointer}: a number of things is needed")
        return int(arg)

    # any value

    def _type(self, arg, v, pointer, *_):
        return reduce(or_, [_is(v, name, pointer) for name in (arg if isinstance(arg, list) else [arg])], F.lit(False))

    def _const(self, arg, v, *_):
        return canonical(v).eqNullSafe(canonical(F.parse_json(F.lit(json.dumps(arg)))))

    def _enum(self, arg, v, pointer, *_):
        if not isinstance(arg, list):
            raise SchemaError(f"{pointer}: a list of values is needed")
        return reduce(or_, [self._const(x, v) for x in arg], F.lit(False))

    def _ref(self, arg, v, pointer, turns, here, _):
        schema = self.target(arg, pointer)
        if arg in here:
            raise SchemaError(f"{pointer}: {arg} leads back to itself and no further into the value")
        done = turns.get(arg, 0)
        if done >= self.depth:
            return F.raise_error(F.lit(f"{arg} goes deeper than {self.depth} turns")).cast("boolean")
        return self.compile(schema, v, arg, {**turns, arg: done + 1}, here | {arg})

    def _allOf(self, arg, v, pointer, turns, here, _):
        return reduce(and_, [self.compile(x, v, f"{pointer}/{k}", turns, here) for k, x in self._all(arg, pointer)])

    def _anyOf(self, arg, v, pointer, turns, here, _):
        return reduce(or_, [self.compile(x, v, f"{pointer}/{k}", turns, here) for k, x in self._all(arg, pointer)])

    def _oneOf(self, arg, v, pointer, turns, here, _):
        return reduce(lambda a, b: a + b, [self.compile(x, v, f"{pointer}/{k}", turns, here).cast("int") for k, x in self._all(arg, pointer)]) == 1

    def _not(self, arg, v, pointer, turns, here, _):
        return ~self.compile(arg, v, pointer, turns, here)

    def _if(self, arg, v, pointer, turns, here, schema):
        then, other = (self.compile(schema.get(k, True), v, pointer[:-2] + k, turns, here) for k in ("then", "else"))
        return F.when(self.compile(arg, v, pointer, turns, here), then).otherwise(other)

    # numbers and texts

    def _on(self, v: Column, kind: str, test: Column) -> Column:
        return F.when(_is(v, kind, ""), test).otherwise(F.lit(True))

    def _minimum(self, arg, v, *_):
        return self._on(v, "number", F.try_variant_get(v, "$", "double") >= float(arg))

    def _maximum(self, arg, v, *_):
        return self._on(v, "number", F.try_variant_get(v, "$", "double") <= float(arg))

    def _minLength(self, arg, v, pointer, *_):
        return self._on(v, "string", F.length(F.try_variant_get(v, "$", "string")) >= self._number_of(arg, pointer))

    def _maxLength(self, arg, v, pointer, *_):
        return self._on(v, "string", F.length(F.try_variant_get(v, "$", "string")) <= self._number_of(arg, pointer))

    def _pattern(self, arg, v, *_):
        return self._on(v, "string", F.try_variant_get(v, "$", "string").rlike(arg))

    # arrays

    def _elements(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "array<variant>")

    def _items(self, arg, v, pointer, turns, *_):
        return self._on(v, "array", F.forall(self._elements(v), lambda x: self._deeper(arg, x, pointer, turns)))

    def _contains(self, arg, v, pointer, turns, *_):
        return self._on(v, "array", F.exists(self._elements(v), lambda x: self._deeper(arg, x, pointer, turns)))

    def _minItems(self, arg, v, pointer, *_):
        return self._on(v, "array", F.size(self._elements(v)) >= self._number_of(arg, pointer))

    def _maxItems(self, arg, v, pointer, *_):
        return self._on(v, "array", F.size(self._elements(v)) <= self._number_of(arg, pointer))

    def _uniqueItems(self, arg, v, *_):
        texts = F.transform(self._elements(v), canonical)
        return self._on(v, "array", F.size(F.array_distinct(texts)) == F.size(texts)) if arg else F.lit(True)

    # objects

    def _members(self, v: Column) -> Column:
        return F.try_variant_get(v, "$", "map<string,variant>")

    def _properties(self, arg, v, pointer, turns, *_):
        if not isinstance(arg, dict):
            raise SchemaError(f"{pointer}: schemas by name are needed")
        members = self._members(v)
        one = lambda name, schema: F.when(F.coalesce(F.map_contains_key(members, F.lit(name)), F.lit(False)), self._deeper(schema, F.try_element_at(members, F.lit(name)), f"{pointer}/{name}", turns)).otherwise(F.lit(True))
        return reduce(and_, [one(*x) for x in arg.items()], F.lit(True))

    def _required(self, arg, v, *_):
        return self._on(v, "object", reduce(and_, [F.map_contains_key(self._members(v), F.lit(name)) for name in arg], F.lit(True)))

    def _additionalProperties(self, arg, v, pointer, turns, _, schema):
        known = list(schema.get("properties", {}))
        rest = F.map_values(F.map_filter(self._members(v), lambda k, _: ~k.isin(known) if known else F.lit(True)))
        return self._on(v, "object", F.forall(rest, lambda x: self._deeper(arg, x, pointer, turns)))

    def _propertyNames(self, arg, v, pointer, turns, *_):
        return self._on(v, "object", F.forall(F.map_keys(self._members(v)), lambda k: self._deeper(arg, k.cast("variant"), pointer, turns)))

    def _minProperties(self, arg, v, pointer, *_):
        return self._on(v, "object", F.size(F.map_keys(self._members(v))) >= self._number_of(arg, pointer))

    def _maxProperties(self, arg, v, pointer, *_):
        return self._on(v, "object", F.size(F.map_keys(self._members(v))) <= self._number_of(arg, pointer))


def accepts(schema: object, value: Column, depth: int = DEPTH) -> Column:
    """Whether ``schema`` (JSON, as Python values) accepts a VARIANT; null where the value is null, as of text that is no JSON.

    A recursive reference is unrolled ``depth`` turns; a value that goes deeper
    fails the job, for it cannot be told.  Unknown keywords, references out of
    the schema or back to themselves, and bad arguments raise ``SchemaError``.
    """
    return F.when(value.isNotNull(), _Compiler(schema, depth).compile(schema, value, "#", {}))


def typed(text: Column) -> Column:
    """JSON text as VARIANT; null where it is none."""
    return F.try_parse_json(text)
