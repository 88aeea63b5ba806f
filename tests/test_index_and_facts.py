"""Snapshots, composed search, facts, rules as data, stores."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking
from lodestone.functions import text as tx
from lodestone.functions.vectors import checked_cosine
from lodestone.operators import evaluation as ev
from lodestone.operators import facts as fa
from lodestone.operators import graph as gr
from lodestone.operators import index_search as ix
from lodestone.operators import passages as ps
from lodestone.operators import rules as ru
from lodestone.operators import search as se
from lodestone.operators import snapshot as sn
from lodestone.operators import sync as sy
from lodestone.operators import titles as ti
from lodestone.operators.metadata import QueryError
from lodestone.sources import bundles, rule_packages, saved_queries
from lodestone.sources.generations import GenerationStore, prune

CONCEPT = "path string, type string, title string, description string, body string, body_line int"
BODY = "# Top\n\nOne passage.\n\n## Sub\n\n```python\ncode\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n[^n]: a note\n"


def concepts(spark, *rows):
    return spark.createDataFrame(list(rows), CONCEPT)


def test_snapshot_has_context_and_lines_of_the_file(spark):
    docs = concepts(
        spark, ("a/b.md", "Guide", None, " short ", BODY, 6), ("c.md", "Guide", "C", "x" * 241, "# Only\n\n[^n]: note", 1), ("d.md", sn.EXCLUDED_TYPE, "D", None, BODY, 1), ("e.md", None, "E", None, None, 1)
    )
    rows = sn.snapshot(docs, "n").orderBy("source_path", "line_start").collect()
    got = [(r.source_path, r.chunk_type, r.line_start, r.line_end, r.input) for r in rows]
    lead = "Title: b\n\nDescription: short\n\nSection: Top"
    assert got == [
        ("a/b.md", "paragraph", 8, 8, f"{lead}\n\nPassage:\n\nOne passage."),
        ("a/b.md", "code", 12, 14, f"{lead} > Sub\n\nCode language: python\n\nPassage:\n\n```python\ncode\n```"),
        ("a/b.md", "table", 16, 18, f"{lead} > Sub\n\nTable columns: | a | b |\n|---|---|\n\nPassage:\n\n| a | b |\n|---|---|\n| 1 | 2 |"),
        ("c.md", "heading", 1, 1, "Title: C\n\nSection: Only\n\nPassage:\n\nOnly"),
        ("c.md", "footnote", 3, 3, "Title: C\n\nSection: Only\n\nPassage:\n\n[^n]: note"),
    ]
    moved = {r.id for r in sn.snapshot(concepts(spark, ("a/b.md", "Guide", "New title", None, BODY, 20)), "n").collect()}
    assert moved == {r.id for r in rows if r.source_path == "a/b.md"}
    sn.check_snapshot(sn.snapshot(docs, "n"), docs)
    with pytest.raises(ValueError):
        sn.check_snapshot(sn.snapshot(docs, "n"), docs.filter("path = 'c.md'"))


def test_fitting_loses_nothing(spark):
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {k} | w{k} x y |" for k in range(12))
    prose = "One sentence of some words. " * 12 + "\n\n" + "z" * 90 + " 🙂" * 30
    docs = concepts(spark, ("a.md", "Guide", "A title", None, prose + "\n\n" + table, 3), ("b.md", "Guide", " ".join(f"t{k}" for k in range(40)), None, "short one", 1))
    count = lambda s: -(-len(s) // 4)
    whole = {r.id: r for r in sn.snapshot(docs, "n").collect()}
    parts = sn.fit_snapshot(sn.snapshot(docs, "n"), 20, count).collect()
    by_parent = {}
    for r in sorted(parts, key=lambda r: r.character_start):
        by_parent.setdefault(r.parent_chunk_id, []).append(r)
        assert count(r.input) <= 20 and r.content.strip()
        assert r.content == whole[r.parent_chunk_id].content[r.character_start : r.character_end]
    for key, some in by_parent.items():
        assert "".join(r.content for r in some) == whole[key].content and len({r.id for r in some}) == len(some)
    assert all(r.content.endswith("\n") for p in by_parent.values() if p[0].chunk_type == "table" for r in p[:-1])
    assert any(r.code and sn.SEGMENT_SPLIT in r.code for r in parts) and {r.code for r in parts if r.source_path == "b.md"} == {sn.CONTEXT_OMITTED}
    told = {(r.source_path, r.code): r.affected for r in sn.fit_diagnostics(sn.fit_snapshot(sn.snapshot(docs, "n"), 20, count)).collect()}
    assert told["b.md", sn.CONTEXT_OMITTED] == 1 and ("a.md", sn.SEGMENT_SPLIT) in told
    with pytest.raises(Exception, match="does not fit"):
        sn.fit_snapshot(sn.snapshot(docs, "n"), 20, lambda s: 99).collect()


def library(spark):
    passages = spark.createDataFrame([("a1", "a.md", 1, 2, "alpha"), ("a2", "a.md", 3, 4, "more"), ("b1", "b.md", 1, 1, "be|ta"), ("c1", "c.md", 5, 6, "gamma"), ("d1", "d.md", 1, 1, "delta")], "id string, source_path string, line_start int, line_end int, content string")
    vectors = spark.createDataFrame([("a1", [0.0, 1.0]), ("a2", [1.0, 0.0]), ("b1", [1.0, 0.1]), ("c1", [0.5, 0.5]), ("d1", [1.0, 0.0])], "id string, vector array<float>")
    documents = spark.createDataFrame([("a.md", "a", "Guide", True, "stable", None), ("b.md", "b", "Guide", False, None, None), ("c.md", "c", "Note", True, "draft", None), ("d.md", "d", "Note", True, "deprecated", None)], "path string, id string, type string, has_status boolean, status string, stale_after string")
    edges = spark.createDataFrame([("a.md", 1, "c.md", "resolvedConcept", "c.md"), ("a.md", 2, "gone.md", "unresolved", None), ("b.md", 1, "gone.md", "unresolved", None)], "source string, ordinal int, raw_target string, resolution string, resolved_path string")
    return passages, vectors, documents, spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<float>"), edges


def test_index_search_with_context(spark):
    passages, vectors, documents, queries, edges = library(spark)
    policy = ix.Policy(current_only=True, governing={"a.md": "b.md", "c.md": "d.md"}, expand=True)
    found = ix.search_index(passages, vectors, documents, queries, policy, limit=2, context_limit=4, edges=edges)
    assert [(r["rank"], r.source_path, r.id) for r in found.matches.orderBy("rank").collect()] == [(1, "a.md", "a2"), (2, "b.md", "b1")]
    assert [(r.source_path, r.id, r.reason, r.via) for r in found.context.orderBy("position").collect()] == [("b.md", "b1", "governing", "a.md"), ("a.md", "a2", "match", None), ("c.md", "c1", "relationship", "a.md")]
    told = {r.message: r.paths for r in found.notices.collect()}
    assert told == {"Unresolved relationship: gone.md": ["a.md", "b.md"], "Governing source excluded or has no passage: d.md": ["d.md"]}
    text = ix.matches_markdown(found, passages, 1)
    assert "1. `a.md:3-4` (1.000)" in text and "- `c.md:5-6` (relationship of a.md)" in text and "# Notices" in text
    data = json.loads(ix.matches_json(found, passages, 1))
    assert [m["citation"] for m in data["matches"]] == ["a.md:3-4", "b.md:1-1"] and data["context"][0]["reason"] == "governing"
    assert "No passage matches" in ix.matches_markdown(found, passages, 2)
    with pytest.raises(ValueError, match="without a vector"):
        ix.search_index(passages, vectors.filter("id <> 'b1'"), documents, queries, policy)
    assert ix.search_index(passages, vectors.filter("id <> 'd1'"), documents, queries, policy, limit=0).matches.collect() == []
    with pytest.raises(ValueError):
        ix.search_index(passages, vectors, documents, queries, ix.Policy(governing={"a.md": "nowhere.md"}))
    with pytest.raises(ValueError):
        ix.bounded_rows(spark.range(101).toDF("n"))
    merged = ix.merge_projects({"x": found, "y": found}, 3).collect()
    assert [(r["rank"], r.bundle, r.id) for r in sorted(merged, key=lambda r: r["rank"])] == [(1, "x", "a2"), (2, "y", "a2"), (3, "x", "b1")]
    variants = {r.variant for r in ix.search_variants(passages, vectors, documents, queries, policy, 2, edges).collect()}
    assert variants == set(ix.policy_variants(policy))


def test_search_in_words(spark):
    passages = spark.createDataFrame([("p1", "a.md", "text", "red ring gear"), ("p2", "b.md", "code", "blue bolt"), ("p3", "c.md", "text", "red bolt")], "id string, source_path string, chunk_type string, content string").withColumn("metadata", F.create_map(F.lit("k"), F.lit("v")))
    vectors = ps.embed(passages, "id", "content")
    asked = spark.createDataFrame([(1, " red ring "), (2, "   "), (3, "bolt"), (4, "red ring")], "id long, text string")
    rows = {(r.query_id, r["rank"]): r.id for r in ix.search_texts(passages, vectors, asked, limit=2).collect()}
    assert rows == {(1, 1): "p1", (1, 2): "p3", (3, 1): "p2", (3, 2): "p3", (4, 1): "p1", (4, 2): "p3"}
    only = ix.search_texts(passages, vectors, asked, se.SearchOptions(chunk_types=("code",)), limit=2).collect()
    assert {r.id for r in only} == {"p2"} and ix.search_texts(passages, vectors, asked, limit=0).collect() == []
    with pytest.raises(ValueError, match="no allowed passage"):
        ix.search_texts(passages, vectors.limit(0), asked)
    marked = ps.Embedder(queries=lambda texts: ps.hash_vectors([t.replace("red", "blue") for t in texts]))
    assert ix.search_texts(passages, vectors, asked.filter("id = 1"), limit=1, embedder=marked).first().id in ("p1", "p2")


def test_refusals(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "id string, text string")
    for refuse in (lambda: sy.refuse_conflicts(rows, "id", "text"), lambda: sy.refuse_repeats(rows, "id")):
        with pytest.raises(ValueError, match="'a'"):
            refuse()
    sy.refuse_repeats(rows.filter("id = 'b'"), "id")
    assert sy.index_state(rows.limit(0), True, True, refreshing=True).first().state == "refreshing"
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(checked_cosine(F.col("a"), F.col("b")).alias("v")).first().v
    assert pair([1.0, 0.0], [1.0, 1.0]) == pytest.approx(0.70710678) and pair([0.0], [1.0]) == 0.0
    for a, b in (([1.0], [1.0, 2.0]), ([], []), (None, [1.0]), ([float("nan")], [1.0])):
        with pytest.raises(Exception, match="without a similarity"):
            pair(a, b)
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string")
    actual = spark.createDataFrame([("b", "2"), ("c", "x"), ("d", "9")], "path string, content string")
    assert {tuple(r) for r in ru.generated_fixes(expected, actual).collect()} == {("a", "1"), ("c", "3")}


def test_facts_of_a_collection(spark):
    files = spark.createDataFrame([("index.md", "---\nokf_version: '0.2'\n---\n[a](./x/../a.md#s) [w](https://e.org/) `[no](c.md)` [up](../b) [](?q)"), ("a.md", ""), ("a/more.txt", ""), ("b/c.md", ""), ("b/index.md", "")], "path string, text string")
    concept = "path string, type string, status string, keys array<string>, tags array<string>, source_ids array<string>, body string"
    docs = spark.createDataFrame([("a.md", "T", None, ["type"], ["x", "y", "x"], ["s"], "# One \nx[^s]\n```\n[^no]\n```\n[^d]: def"), ("b/c.md", "T", None, [], None, None, None)], concept)
    root = fa.root_facts(files, docs).collect()
    assert len(root) == 1 and root[0].okf_version == "0.2" and root[0].files == ["a.md", "index.md"] and root[0].has_concepts
    assert root[0].index_links == ["a.md", "https://e.org/", "../b", "index.md"]
    assert {(r.path, r.has_index) for r in fa.directory_facts(files).collect()} == {("a", False), ("b", True)}
    rows = {r.path: r for r in fa.concept_facts(docs, files).collect()}
    a = rows["a.md"]
    assert [tuple(t) for t in a.tags] == [("x", 2), ("y", 1), ("x", 2)] and a.sibling_directory and not rows["b/c.md"].sibling_directory
    assert [tuple(h) for h in a.headings] == [("One", "one")] and [tuple(f) for f in a.footnotes] == [("s", True, False, True), ("d", False, True, False)]
    edge = "source string, origin string, ordinal int, raw_target string, resolution string, resolved_path string, relationship string"
    edges = spark.createDataFrame([("a.md", "relationships", 1, "/b/c.md", "resolvedConcept", "b/c.md", "cites"), ("a.md", "bodyLink", 0, "#here", "resolvedConcept", "a.md", None), ("a.md", "bodyLink", 2, "https://e.org", "external", None, None)], edge)
    linked = {r.path: r for r in fa.concept_facts(docs, files, edges).collect()}
    assert [(e.target, e.internal, e.bundle_relative) for e in linked["a.md"].edges] == [("#here", False, False), ("/b/c.md", True, True), ("https://e.org", False, False)]
    assert [(r.relationship, r.resolved) for r in linked["a.md"].relationships] == [("cites", True)] and linked["b/c.md"].edges == []
    assert [tuple(r) for r in fa.inbound_facts(edges).collect()] == [("b/c.md", "cites", "a.md")]
    sources = docs.withColumn("sources", F.array(F.struct(F.lit("s").alias("id"), F.lit(" /b/c.md ").alias("resource"))))
    assert {(r.path, r.resolved_path) for r in fa.source_edges(sources, edges).collect()} == {("a.md", "b/c.md"), ("b/c.md", None)}


def test_rules_as_data(spark):
    facts = {"file": spark.createDataFrame([("a", ["x", "X", "X"], 3), ("b", [], None), ("c", None, 1)], "path string, tags array<string>, n int")}
    rules = [
        fa.Rule("tags", "file", {"pattern": "^[a-z]$"}, "{path}: {failing} of {tags} {other}", "warning", each="tags"),
        fa.Rule("n", "file", {"type": "object", "required": ["n"]}, "n is {n}"),
        fa.Rule("links", "file", {"type": "object", "required": ["n"]}, "links", needs_links=True),
    ]
    found = sorted((r.rule_id, r.path, r.failing, r.message) for r in fa.evaluate(rules, facts, links=False).collect())
    assert found == [("n", "b", None, "n is null"), ("tags", "a", "X", 'a: X of ["x","X","X"] {other}')]
    assert fa.evaluate(rules, facts).count() == 3 and fa.evaluate([], facts).collect() == []
    ordered = [(r.rule_id, r.severity) for r in fa.by_severity(fa.evaluate(rules, facts)).collect()]
    assert ordered == [("links", "error"), ("n", "error"), ("tags", "warning")] and [r.path for r in fa.in_order(fa.evaluate(rules, facts)).collect()] == ["a", "b", "b"]
    with pytest.raises(ValueError):
        fa.evaluate([fa.Rule("x", "nothing", {}, "")], facts)
    assert fa.check_examples(spark, fa.Rule("p", "file", {"pattern": "^a"}, "", valid=("ab", "b"), invalid=("c", "ad"), kind="string")) == ['valid example {"value":"b"} is rejected', 'invalid example {"value":"ad"} is accepted']
    assert fa.with_vocabulary({"items": {"vocabulary": "types"}}, {"types": ["a"]}) == {"items": {"enum": ["a"]}}
    assert fa.united_vocabularies([{"t": ["a"]}, {"t": ["b"], "s": ["a"]}]) == {"t": ["a", "b"], "s": ["a"]}
    for bad in ([{"t": ["a"]}, {"t": ["a"]}], [{"t": ["a", "a"]}]):
        with pytest.raises(ValueError):
            fa.united_vocabularies(bad)


def test_rule_packages(spark):
    package = {
        "format": 1,
        "$defs": {"text": {"type": "string", "pattern": r"\S"}, "key": {"enum": ["type", "title"]}},
        "rules": [
            {"id": "keys", "severity": "warning", "message": "only known keys; found {failing}", "check": {"subject": "concept", "each": "keys", "schema": {"properties": {"value": {"$ref": "#/$defs/key"}}}}, "tests": {"valid": [{"value": "type"}], "invalid": [{"value": "x"}]}},
            {"id": "typed", "message": "{path} has no type", "check": {"subject": "concept", "schema": {"required": ["type"], "properties": {"type": {"$ref": "#/$defs/text"}}}}},
            {"id": "linked", "message": "no links", "check": {"subject": "concept", "schema": {"properties": {"edges": {"minItems": 1}}}}},
            {"id": "files", "message": "missing", "check": {"builtin": "files-present", "params": {"files": ["a.md"]}}},
        ],
    }
    read = rule_packages.parse_package(json.dumps(package).encode())
    assert [(r.id, r.needs_links) for r in read.rules] == [("keys", False), ("typed", False), ("linked", True)] and read.builtins[0][3:] == ("files-present", {"files": ["a.md"]})
    facts = {"concept": spark.createDataFrame([("a", "T", ["type", "odd", "odd"]), ("b", " ", ["title"]), ("c", None, [])], "path string, type string, keys array<string>")}
    found = sorted((r.rule_id, r.path, r.message) for r in fa.evaluate(read.rules, facts, links=False).collect())
    assert found == [("keys", "a", "only known keys; found odd"), ("typed", "b", "b has no type"), ("typed", "c", "c has no type")]
    for change in ({"format": 2}, {"rules": [{"id": "x"}]}, {"rules": [{"id": "x", "message": "m", "check": {"subject": "concept"}}]}, {"rules": [{"id": "x", "message": "m", "check": {"schema": True}}]}, {"rules": [package["rules"][0]] * 2}, {"rules": [{**package["rules"][0], "severity": "fatal"}]}):
        with pytest.raises(ValueError):
            rule_packages.parse_package(json.dumps({**package, **change}).encode())


def test_links_that_leave_the_collection(spark):
    links = spark.createDataFrame([("a/b.md", "../../docs/x.md"), ("a/b.md", "/../y.md#s"), ("a/b.md", "../../docs/none.md"), ("a/b.md", "gone.md"), ("a/b.md", "https://e.org/../x")], "source string, raw_target string")
    assert [r.p for r in links.select(gr.outside_path(F.col("source"), F.col("raw_target")).alias("p")).collect()] == ["../docs/x.md", "../y.md", "../docs/none.md", None, None]
    resolved = gr.resolve(links, spark.createDataFrame([("a/b.md", "concept")], "path string, kind string"))
    outside = spark.createDataFrame([("../docs/x.md",), ("../y.md",)], "path string")
    assert {r.failing for r in ru.broken_links(resolved, outside).collect()} == {"../../docs/none.md", "gone.md"} and ru.broken_links(resolved).count() == 4


def test_trees_pairs_and_renderers(spark):
    files = spark.createDataFrame([("x/y/a.md", "Alpha", "Guide", ["Gear"]), ("x/b.md", "Beta", "", None)], "path string, label string, type string, tags array<string>")
    assert {(r.node, r.is_file) for r in ti.tree_filter(files, "gear").collect()} == {("x/y/a.md", True), ("x", False), ("x/y", False)}
    assert {r.node for r in ti.tree_filter(files, "none", keep="x/b.md").collect()} == {"x/b.md", "x"} and ti.tree_filter(files, "").count() == 4
    assert [r.type for r in ti.type_tree(files).orderBy("position").collect()] == ["Guide", ""]
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "v")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    data = json.loads(gr.render(edges, nodes, "json"))
    assert [n["node"] for n in data["nodes"]] == ["a", "b", "c", "v"] and data["edges"] == [{"source": "n0", "target": "n1"}, {"source": "n0", "target": "n3"}, {"source": "n1", "target": "n0"}]
    assert gr.backlinks(edges, most=0).filter("sources is null").count() == 3
    many = spark.range(3000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("node"))
    names = {r.node: r.name for r in gr.numbered_nodes(edges.limit(0), many.repartition(7)).collect()}
    assert [names[x] for x in sorted(names)] == [f"n{k}" for k in range(3000)]
    with pytest.raises(ValueError):
        gr.render(edges, spark.range(6000).select(F.col("id").cast("string").alias("node")))


def test_filters_and_rerankers(spark):
    edges = spark.createDataFrame([("a", "b", "bodyLink", "x"), ("b", "c", "sources", None)], "source string, target string, origin string, relationship string")
    assert gr.filtered(edges, origins=("sources",)).count() == 1 and gr.filtered(edges, relationships=("x",)).count() == 1
    assert gr.filtered(edges, nodes=spark.createDataFrame([("a",), ("b",)], "node string")).count() == 1
    findings = spark.createDataFrame([("error",), ("warning",), ("suggestion",)], "severity string")
    assert [fa.at_least(findings, s).count() for s in ("error", "warning", "suggestion")] == [1, 2, 3]
    with pytest.raises(ValueError):
        fa.at_least(findings, "fatal")
    scored = spark.createDataFrame([(1, 1, "q", "one"), (1, 2, "q", "three"), (1, 3, "q", "five5"), (2, 1, "q", None)], "query_id long, rank int, query_text string, content string")
    rows = se.rerank_with(scored, lambda q, c: [len(x) for x in c], 2).orderBy("query_id", "new_rank").collect()
    assert [(r.query_id, r["rank"], r.score) for r in rows] == [(1, 2, 5.0), (1, 3, 5.0), (2, 1, 0.0)]
    with pytest.raises(Exception, match="one finite score"):
        se.rerank_with(scored, lambda q, c: [float("nan")] * len(c), 2).collect()


def test_spans_of_many_lines(spark):
    import random

    rng = random.Random(2)
    spans = [(f"f{k % 3}", f"i{k}", s, s + rng.choice([0, 1, 5, 40, 900])) for k in range(150) for s in [rng.randint(1, 1200)]]
    df = spark.createDataFrame(spans, "source_path string, chunk_id string, line_start int, line_end int")
    got = {(r.left_id, r.right_id): r.overlap for r in ev.span_overlaps(df, df, lines=64).collect()}
    want = {(a[1], b[1]): n for a in spans for b in spans if a[0] == b[0] and (n := min(a[3], b[3]) - max(a[2], b[2]) + 1) > 0}
    assert got == want
    parents = {r.chunk_id: r.parent_id for r in se.enclosing_parents(df).collect()}
    around = lambda c: [(p[3] - p[2], -p[2], p[1]) for p in spans if p[0] == c[0] and p[2] <= c[2] and p[3] >= c[3] and p[3] - p[2] > c[3] - c[2]]
    assert parents == {c[1]: min(around(c))[2] for c in spans if around(c)}
    rows = [(f"f{k % 2}", f"p{k}", str(k % 4), None if k % 3 else str(k % 5), s, s + k % 6) for k, (_, _, s, _) in enumerate(spans)]
    df = spark.createDataFrame(rows, "source_path string, chunk_id string, symbol string, parent_symbol string, line_start int, line_end int")
    rank = lambda c: [(p[4] > c[4], abs(p[4] - c[4]), p[5] - p[4], p[1]) for p in rows if p[0] == c[0] and p[2] == c[3] and p[1] != c[1]]
    assert {r.chunk_id: r.parent_id for r in se.symbol_parents(df).collect()} == {c[1]: min(rank(c))[3] for c in rows if c[3] is not None and rank(c)}


def test_symbol_parents_behind_nameless_and_repeated_passages(spark):
    rows = [
        ("f", None, "S", None, 5, 5), ("f", None, "S", None, 5, 6), ("f", "far", "S", None, 1, 2), ("f", "p", "S", None, 5, 9), ("f", "c", None, "S", 7, 7),  # rows without an id are no parents
        ("g", "x", "S", "S", 5, 5), ("g", "x", "S", "S", 5, 6), ("g", "y", "S", None, 5, 9), ("g", "z", "S", None, 4, 4),  # x stands twice before y, which has its start
        ("h", "a", "S", "S", 3, 3), ("h", "a", "S", "S", 4, 4), ("h", "late", "S", None, 8, 8), ("h", "b", "S", None, 6, 7), ("h", "b2", "S", None, 6, 6),  # a meets itself only, then what follows
        (None, "q", "S", None, 1, 1), (None, "d", None, "S", 1, 1), ("i", "alone", "S", "S", 1, 1), ("i", "lost", None, "T", 1, 1),
    ]
    df = spark.createDataFrame(rows, "source_path string, chunk_id string, symbol string, parent_symbol string, line_start int, line_end int")
    assert {r.chunk_id: r.parent_id for r in se.symbol_parents(df).collect()} == {"c": "p", "x": "y", "a": "b2", "d": "q"}


def test_stores_keep_what_may_be_read(spark, tmp_path):
    store = GenerationStore(spark, f"file://{tmp_path}/s/one")
    chunks = spark.createDataFrame([("a", "x"), ("b", "y")], "chunk_id string, content string")
    vectors = spark.createDataFrame([("a", "m", [1.0, 0.0])], "chunk_id string, model string, vector array<float>")
    first = store.publish(chunks, vectors)
    second = store.publish(chunks.limit(1), vectors)
    chunks.write.parquet(f"file://{tmp_path}/s/one/generations/staged/chunks")
    assert store.current() == second and store.collect_garbage(grace_seconds=3600) == [] and store.collect_garbage() == [first]
    assert store.collect_garbage(staged_seconds=0) == ["staged"] and store.current() == second
    store.check()
    mixed = vectors.unionByName(spark.createDataFrame([("b", "m", [1.0])], vectors.schema))
    with pytest.raises(ValueError):
        store.publish(chunks, mixed)
    assert store.current() == second
    GenerationStore(spark, f"file://{tmp_path}/s/two").publish(chunks, vectors)
    assert prune(spark, f"file://{tmp_path}/s", {"two"}) == [] and prune(spark, f"file://{tmp_path}/s", {"two"}, 0) == ["one"]
    assert GenerationStore(spark, f"file://{tmp_path}/s/one").current() is None


def test_pages_and_live_collections(spark, tmp_path):
    with pytest.raises(QueryError):
        saved_queries.page_markdown(spark.range(1001).toDF("n"))
    deep = []
    for _ in range(70):
        deep = [deep]
    for value in (deep, ["x" * 5_000_000], list(range(100_001))):
        with pytest.raises(QueryError):
            saved_queries.check_size(value)
    root = tmp_path / "b"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("---\ntype: Guide\n---\nbody")
    (root / "log.md").write_text("## 2024-02-01\n* two\n## 2024-01-01\n* one\n")
    (root / "sub" / "index.md").write_text("plain")
    docs, mark = bundles.live_concepts(spark, f"file://{root}", "b")
    assert docs.count() == 1 and bundles.still(spark, f"file://{root}", "b", mark)
    files = bundles.read_files(spark, f"file://{root}", "b")
    assert [r.path for r in bundles.within_budget(files, 40).filter("fits").orderBy("path").collect()] == ["a.md"]
    assert bundles.read_files(spark, f"file://{root}", "b", pattern="*.txt").collect() == []
    (root / "log.md").write_text("## 2024-01-01\n* one\n## 2024-02-01\n* two\n")
    assert not bundles.still(spark, f"file://{root}", "b", mark)
    (root / "sub" / "index.md").write_text("---\nx: y\n---\n")
    assert {r.reason for r in bundles.reserved_file_faults(bundles.read_files(spark, f"file://{root}", "b")).collect()} == {"an index below the root has frontmatter", "the newest log entry is not first"}
    with pytest.raises(ValueError, match="does not conform"):
        bundles.live_concepts(spark, f"file://{root}", "b")


def test_small_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(tx.resource_label(F.lit(" git:3023A6DFF:docs/guide.md "))) == "git · 3023a6d · guide.md" and one(tx.resource_label(F.lit("git:3023a6d"))) == "git · 3023a6d" and one(tx.resource_label(F.lit("git:xyz"))) == "git:xyz"
    assert one(tx.short_target(F.lit("https://E.org/a/b%20c/?q#f"))) == "e.org/b c" and one(tx.short_target(F.lit("http://e.org"))) == "e.org" and one(tx.short_target(F.lit("a/b/"))) == "b" and one(tx.short_target(F.lit("/"))) == "/"
    assert [one(tx.link_class(F.lit(x))) for x in ("#a", "https://e.org", "mailto:x@y", "//e.org", "a/b.md", "")] == ["anchor", "web", "other", "other", "file", "other"]
    verified = F.array(F.struct(F.lit("2024-01-02T00:00:00Z").alias("at")), F.struct(F.lit("soon").alias("at")))
    assert str(one(tx.last_verified(verified).cast("string"))) == "2024-01-02 00:00:00" and one(tx.escaped_controls(F.lit("a\x1bb\u202e\tc"))) == "a\ufffdb\ufffd\tc"
    means = spark.createDataFrame([("a", 3, 1.0, 0.5, 0.0), ("b", 1, 0.0, 0.5, 1.0)], "g string, queries long, recall double, ndcg double, mrr double")
    assert tuple(ev.weighted_means(means).first()) == (4, 0.75, 0.5, 0.25)
    metrics = spark.createDataFrame([(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0)], "query_id long, recall double, ndcg double, mrr double")
    groups = spark.createDataFrame([(1, "x"), (2, "y")], "query_id long, query_group string")
    report = json.loads(ev.report_json(10, {"dense": (metrics, groups)}))
    assert report["runs"][0]["metrics"]["recall"] == 0.5 and [g["name"] for g in report["runs"][0]["queryGroups"]] == ["x", "y"]


def test_typescript_headers():
    kinds = set(chunking.KEYWORDS)
    told = {
        "export default abstract class A<T> extends B": ("class", "A"), "const enum E": ("enum", "E"), "export declare namespace a.b.c": ("namespace", "a.b.c"), "export type T = A | B": ("type", "T"), "interface I": ("interface", "I"),
        "export default async function": ("function", "default"), "function* gen()": ("function", "default"), "export const f = async <T>(a: T): Promise<T> =>": ("function", "f"), "const g: (x: number) => string = x =>": ("function", "g"),
        "const h = 5": None, "if (x)": None, "let o =": None,
    }
    assert {h: chunking.declaration(h, kinds) for h in told} == told
    members = {"private static async run(a, b): Promise<void>": ("method", "run"), "readonly cb = (x: A): B =>": ("method", "cb"), "name: string": None, "count = 3": None, "constructor(private a: A)": ("method", "constructor")}
    assert {h: chunking.member(h) for h in members} == members and chunking.member("run(a)", False) is None


def test_few_rows_are_python_objects_at_once(spark):
    import tracemalloc

    import pyarrow as pa

    from lodestone.operators import passages as pg

    class Taken:
        """Stands for a DataFrame and keeps the function that its rows are handed to."""

        def __getattr__(self, name):
            return lambda *args: self

        def mapInArrow(self, run, schema):
            self.run = run
            return self

    def peak(run, batch):
        tracemalloc.start()
        try:
            rows = sum(out.num_rows for out in run(iter([batch])))
            return rows, tracemalloc.get_traced_memory()[1] / 1e6
        finally:
            tracemalloc.stop()

    n = 3_000
    text = ["\n\n".join(f"## turn {t}\n\n> word {i} and more words of a turn" for t in range(6)) for i in range(n)]
    passages = [f"word {i} " * 60 for i in range(n)]
    snapshot = {"id": passages, "source_path": ["p"] * n, "chunk_type": ["text"] * n, "line_start": [1] * n, "line_end": [1] * n, "content": passages, "prefix": ["Passage:\n\n"] * n}
    taken = Taken()
    for call, columns in (
        (lambda: pg.chunk(taken), {"source_path": [f"p{i}" for i in range(n)], "content_type": ["markdown"] * n, "text": text}),
        (lambda: sn.fit_snapshot(taken, 40), snapshot),
        (lambda: pg.fit_inputs(taken, 40), {"chunk_id": passages, "content": passages}),
    ):
        call()
        rows, mb = peak(taken.run, pa.RecordBatch.from_pydict(columns))
        assert rows >= n and mb < 6
