import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone import plans
from lodestone.operators import rules as ru
from lodestone.sources import bundles
from lodestone.sources.generations import GenerationStore
from lodestone.streaming import refresh

KIND = T.StructType(
    [T.StructField("s", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("a", T.ArrayType(T.StringType()))]
)
CASES = [
    ({"required": ["s", "zz"]}, {"s": "x"}, False), ({"required": ["s"]}, {"s": "x"}, True), ({"required": ["s"]}, {"n": 1}, False),
    ({"properties": {"s": {"type": "string", "minLength": 2, "maxLength": 3}}}, {"s": "ab"}, True), ({"properties": {"s": {"minLength": 2}}}, {"s": "a"}, False),
    ({"properties": {"s": {"minLength": 2}}}, {"n": 1}, True), ({"properties": {"n": {"pattern": "^x"}}}, {"n": 1}, True), ({"properties": {"s": {"pattern": "b+"}}}, {"s": "abba"}, True),
    ({"properties": {"n": {"type": "integer"}}}, {"n": 3}, True), ({"properties": {"d": {"type": "integer"}}}, {"d": 3.0}, True), ({"properties": {"d": {"type": "integer"}}}, {"d": 3.5}, False),
    ({"properties": {"n": {"type": ["string", "null"]}}}, {"n": 3}, False), ({"properties": {"n": {"enum": [1, "1", True]}}}, {"n": 1}, True), ({"properties": {"b": {"const": 1}}}, {"b": True}, False),
    ({"properties": {"a": {"uniqueItems": True}}}, {"a": ["x", "x"]}, False), ({"properties": {"a": {"minItems": 1, "maxItems": 2}}}, {"a": []}, False),
    ({"properties": {"a": {"items": {"pattern": "^x"}}}}, {"a": ["x", "y"]}, False), ({"properties": {"a": {"contains": {"const": "y"}}}}, {"a": ["x", "y"]}, True),
    ({"properties": {"a": {"contains": {"const": "y"}}}}, {"a": []}, False), ({"not": {"required": ["s"]}}, {"s": "x"}, False), ({"additionalProperties": False, "properties": {"s": True}}, {"s": "x", "n": 1}, False),
    ({"additionalProperties": {"type": "string"}, "properties": {"n": True}}, {"s": "x", "n": 1}, True), ({"propertyNames": {"maxLength": 0}}, {"s": "x"}, False), ({"propertyNames": {"maxLength": 0}}, {}, True),
    ({"minProperties": 2}, {"s": "x"}, False), ({"allOf": [{"required": ["s"]}, {"required": ["n"]}]}, {"s": "x"}, False), ({"anyOf": [{"required": ["s"]}, {"required": ["n"]}]}, {"n": 1}, True),
    ({"oneOf": [{"required": ["s"]}, {"required": ["n"]}]}, {"s": "x", "n": 1}, False), ({"if": {"required": ["s"]}, "then": {"required": ["n"]}, "else": {"required": ["b"]}}, {"s": "x"}, False),
    ({"if": {"required": ["s"]}, "then": {"required": ["n"]}, "else": {"required": ["b"]}}, {"b": False}, True), ({"$defs": {"t": {"minLength": 3}}, "properties": {"s": {"$ref": "#/$defs/t"}}}, {"s": "ab"}, False),
    ({"properties": {"s": {"format": "date-time"}}}, {"s": "2026-01-02T03:04:05Z"}, True), ({"properties": {"s": {"format": "date-time"}}}, {"s": "2026-01-02"}, False),
    ({"properties": {"s": {"format": "date-time"}}}, {"s": "2026-13-02T03:04:05Z"}, False), (True, {}, True), (False, {"s": "x"}, False),
]


def test_schema_keywords(spark):
    rows = [(k, {f.name: v.get(f.name) for f in KIND.fields}) for k, (_, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", KIND)]))
    out = df.select("k", *[ru.compile_schema(s, F.col("v"), KIND).alias(f"c{k}") for k, (s, _, _) in enumerate(CASES)]).collect()
    for r in out:
        schema, value, want = CASES[r.k]
        assert r[f"c{r.k}"] is want, (schema, value)


@pytest.mark.parametrize("schema", [{"multipleOf": 2}, {"properties": {"s": {"exclusiveMinimum": 1}}}, {"properties": {"s": {"format": "email"}}}, {"$ref": "http://x"}, {"not": []}])
def test_schemas_that_do_not_compile(schema):
    with pytest.raises(ru.SchemaError):
        ru.compile_schema(schema, F.lit(None), KIND)


def test_findings_and_gates(spark):
    facts = spark.createDataFrame([("a", "x", ["p", "Q", "Q"]), ("b", None, None), ("c", "yy", [])], "path string, v string, tags array<string>")
    one = ru.schema_findings(facts, "short", "warning", {"maxLength": 1}, "v")
    each = ru.each_findings(facts, "lower", "error", {"pattern": "^[a-z]$"}, "tags")
    assert [r.path for r in one.collect()] == ["c"] and [(r.path, r.failing) for r in each.collect()] == [("a", "Q")]
    both = one.unionByName(each)
    assert ru.gate(both).first().gate == "FAIL" and ru.gate(one).first().gate == "PASS" and ru.gate(one, incomplete=True).first().gate == "INCOMPLETE"
    twice = each.unionByName(each)
    assert [(r.rule_id, r.n) for r in ru.introduced(each, twice).collect()] == [("lower", 1)] and ru.introduced(twice, each).count() == 0
    assert {r.key: r.worst for r in ru.finding_groups(both, "path").collect()} == {"a": "error", "c": "warning"}


def test_bundles_are_read(spark, tmp_path):
    root = tmp_path / "bundle"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("---\ntype: Guide\ntitle: A\ntags: [x, y]\nextra: {k: 1}\n---\nBody\n", encoding="utf-8")
    (root / "sub/b.md").write_text("﻿---\ntype: Note\nstatus:\n---\n", encoding="utf-8")
    (root / "c.md").write_text("no frontmatter", encoding="utf-8")
    (root / "d.md").write_text("---\n: [\n---\n", encoding="utf-8")
    (root / "log.md").write_text("# Log\n\n## 2026-01-02\n* one\n* two\n\n## 2026-01-03\n- three\n", encoding="utf-8")
    (root / "index.md").write_text("# Index", encoding="utf-8")
    (root / "x.png").write_bytes(b"\x89PNG")
    files = bundles.read_files(spark, str(root), "kb", max_bytes=10_000).cache()
    assert {r.path: r.kind for r in files.collect()} == {"a.md": "concept", "sub/b.md": "concept", "c.md": "concept", "d.md": "concept", "log.md": "log", "index.md": "index", "x.png": "asset"}
    rows = {r.path: r for r in bundles.read_concepts(files).collect()}
    a = rows["a.md"]
    assert (a.id, a.type, a.title, a.tags, a.has_status, a.body, a.body_line) == ("a", "Guide", "A", ["x", "y"], False, "Body\n", 7) and json.loads(a.fm_json)["extra"] == {"k": "1"}
    assert rows["sub/b.md"].has_status and rows["sub/b.md"].type == "Note"
    assert {r.path for r in bundles.unreadable(bundles.read_concepts(files)).collect()} == {"c.md", "d.md"}
    assert [(str(r.day), r.action) for r in bundles.log_entries(files).orderBy("day", "action").collect()] == [("2026-01-02", "one"), ("2026-01-02", "two"), ("2026-01-03", "three")]


def test_generations(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/store")
    chunk = lambda *ids: spark.createDataFrame([(i, f"text {i}", "p") for i in ids], "chunk_id string, content string, source_path string")
    vector = lambda *ids: spark.createDataFrame([(i, "m", [1.0, 2.0]) for i in ids], "chunk_id string, model string, vector array<float>")
    assert store.current() is None
    with pytest.raises(LookupError):
        store.read("chunks")
    first = store.publish(chunk("a", "b"), vector("a", "b"))
    gone = spark.createDataFrame([("a",)], "chunk_id string")
    second = store.replace(chunk("c"), vector("c"), gone)
    assert store.current() == second != first and {r.chunk_id for r in store.read("vectors").collect()} == {"b", "c"} and store.stats() == {"chunks": 2, "vectors": 2}
    for chunks, vectors in ((chunk("x"), vector("y")), (chunk("x"), spark.createDataFrame([("x", "m", [0.0, 0.0])], "chunk_id string, model string, vector array<float>"))):
        with pytest.raises(ValueError):
            store.publish(chunks, vectors)
    with pytest.raises(ValueError):
        store.replace(chunk("b"), vector("b"), spark.createDataFrame([("b",)], "chunk_id string"))
    assert store.current() == second and first in store.collect_garbage() and store.stats()["chunks"] == 2


def test_a_stream_refreshes_an_index(spark, tmp_path):
    store, source = GenerationStore(spark, f"file://{tmp_path}/store"), tmp_path / "in"
    schema = "source_path string, content_type string, text string"
    add = lambda *rows: spark.createDataFrame(list(rows), schema).write.mode("append").parquet(str(source))
    run = lambda: refresh.refresh(spark.readStream.schema(schema).parquet(str(source)), store, str(tmp_path / "check")).awaitTermination()
    add(("a.md", "markdown", "# A\n\none"), ("b.md", "markdown", "two"))
    run()
    assert store.stats() == {"chunks": 3, "vectors": 3}
    add(("a.md", "markdown", "changed"))
    run()
    assert {r.content for r in store.read("chunks").collect()} == {"changed", "two"} and store.stats()["vectors"] == 2


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_queries_run_and_match_their_twins(spark, sf, name):
    import duckdb

    got = plans.QUERIES[name](spark, sf)
    rows = sorted(map(repr, (tuple(r[c] for c in sorted(got.columns)) for r in got.collect())))
    if name not in plans.ORACLES:
        assert rows
        return
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    twin = db.sql(plans.ORACLES[name])
    columns = list(twin.columns)
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in sorted(columns)]
    assert sorted(map(repr, (tuple(r[k] for k in order) for r in twin.fetchall()))) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_repeated_elements_shuffle_lists_and_not_elements(spark):
    rows = [("a", ["x", "y", "x"]), ("b", ["x"]), ("a", ["y", None]), ("a", [None]), (None, ["z", "z"]), ("c", None), ("d", [])]
    found = ru.repeated_elements(spark.createDataFrame(rows, "path string, tags array<string>"), "tags")
    assert {(r.path, r.value, r.n) for r in found.collect()} == {("a", "x", 2), ("a", "y", 2), ("a", None, 2), (None, "z", 2)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "Generate" not in plan and "HashAggregate" not in plan
