"""Packages of rules as JSON: what they say, as rules over fact tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..operators.facts import Rule
from ..operators.rules import SEVERITIES

#: Keys of a package's rule and of its check, and facts that come from links.
RULE_KEYS = {"id", "category", "severity", "status", "ref", "description", "message", "check", "tests"}
CHECK_KEYS = {"subject", "schema", "each", "at", "failing", "builtin", "params"}
LINK_FACTS = {"edges", "relationships", "inbound"}


@dataclass(frozen=True)
class Package:
    """A package's rules with a schema, its builtin checks as (id, severity, message, name, params), and its rules' examples by id."""

    rules: list[Rule]
    builtins: list[tuple[str, str, object, str, dict]]
    examples: dict[str, tuple[list, list]] = field(default_factory=dict)


def _mentions(schema: object, names: set[str]) -> bool:
    if isinstance(schema, dict):
        return bool(set(schema.get("properties", {})) & names or set(schema.get("required", ())) & names) or any(_mentions(v, names) for v in schema.values())
    return isinstance(schema, list) and any(_mentions(v, names) for v in schema)


def parse_package(raw: bytes) -> Package:
    """A package of format 1.  Unknown keys, severities and repeated ids are refused.

    Elements of a list that are no objects are checked as objects with the one
    property ``value``; definitions of the package are known to every schema.
    """
    spec = json.loads(raw.decode("utf-8"))
    if not isinstance(spec, dict) or spec.get("format") != 1 or not isinstance(spec.get("rules"), list):
        raise ValueError("the package is not of format 1")
    definitions = spec.get("$defs", {})
    rules, builtins, examples, seen = [], [], {}, set()
    for item in spec["rules"]:
        check = item.get("check", {})
        if set(item) - RULE_KEYS or set(check) - CHECK_KEYS or not {"id", "message", "check"} <= set(item):
            raise ValueError(f"rule {item.get('id')!r} has unknown or missing keys")
        id_, severity = item["id"], item.get("severity", "error")
        if id_ in seen or severity not in SEVERITIES:
            raise ValueError(f"rule {id_!r} stands twice or has an unknown severity")
        seen.add(id_)
        if ("builtin" in check) == ("schema" in check) or "schema" in check and "subject" not in check:
            raise ValueError(f"rule {id_!r} needs either a builtin check or a subject with a schema")
        if "builtin" in check:
            builtins.append((id_, severity, item["message"], check["builtin"], check.get("params", {})))
            continue
        schema = {**check["schema"], "$defs": definitions} if definitions else check["schema"]
        links = check.get("each") in LINK_FACTS or _mentions(check["schema"], LINK_FACTS)
        rules.append(Rule(id_, check["subject"], schema, item["message"], severity, check.get("each"), check.get("failing"), {"self": "path"}.get(check.get("at", "self"), check.get("at")), links, wrapped=True))
        tests = item.get("tests", {})
        examples[id_] = (tests.get("valid", []), tests.get("invalid", []))
    return Package(rules, builtins, examples)
