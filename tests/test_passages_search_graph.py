import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import chunking
from lodestone.functions.vectors import cosine, similarity_of_distance, unit_rows
from lodestone.operators import evaluation as ev
from lodestone.operators import graph as gr
from lodestone.operators import passages as ps
from lodestone.operators import search as se
from lodestone.operators import sync as sy
from lodestone.operators import titles as ti


def test_markdown_passages():
    text = "# Top\n\nOne line.\nAnother.\n\n```python x\ncode | here\n# not a heading\n```\n## Sub\n| a | b |\n|---|:-:|\n| 1 | 2 |\n\n[^1]: a note\n  more of it\n[^2]: two\ntext\n~~~\nopen"
    got = [(s, e, k, c) for s, e, k, c, _ in chunking.markdown(text)]
    assert got == [
        (1, 1, "heading", "Top"), (3, 4, "paragraph", "One line.\nAnother."), (6, 9, "code", "```python x\ncode | here\n# not a heading\n```"), (10, 10, "heading", "Sub"),
        (11, 13, "table", "| a | b |\n|---|:-:|\n| 1 | 2 |"), (15, 17, "footnote", "[^1]: a note\n  more of it\n[^2]: two"), (18, 18, "paragraph", "text"), (19, 20, "code", "~~~\nopen"),
    ]
    details = [d for *_, d in chunking.markdown(text)]
    assert details[2] == {"heading_path": ["Top"], "code_language": "python"} and details[3]["heading_path"] == ["Top", "Sub"] and details[4]["table_header"] == "| a | b |\n|---|:-:|"


def test_nested_fences_and_budget():
    text = "````md\n```\ninner\n```\n````\n" + "\n".join(["x" * 30] * 5) + "\n" + "y" * 200
    got = [(s, e, k) for s, e, k, *_ in chunking.markdown(text, 70)]
    assert got == [(1, 5, "code"), (6, 7, "paragraph"), (8, 9, "paragraph"), (10, 10, "paragraph"), (11, 11, "paragraph")]


def test_text_passages():
    text = "First part.\nStill first.\n \n\nSecond one. It goes on! Does it? Yes.\n"
    assert [(s, e, c) for s, e, _, c, _ in chunking.paragraphs(text)] == [(1, 2, "First part.\nStill first."), (5, 6, "Second one. It goes on! Does it? Yes.\n")]
    assert [(s, e, c) for s, e, _, c, _ in chunking.paragraphs(text, 15, by_sentence=True)] == [(1, 1, "First part."), (2, 2, "Still first."), (5, 5, "Second one."), (5, 5, "It goes on!"), (5, 5, "Does it? Yes. ")]
    assert [(s, e, c) for s, e, _, c, _ in chunking.line_blocks("aa\nbb\ncc", 4)] == [(1, 2, "aa\nbb"), (3, 3, "cc")]
    assert list(chunking.line_blocks("aa\nbb", 9)) == [(1, 2, "text", "aa\nbb", {})]


def test_chunks_and_registry(spark):
    docs = spark.createDataFrame([("a.md", "Markdown", "# T\n\np"), ("b.bin", "binary", "x"), ("c.txt", "text", None)], "source_path string, content_type string, text string")
    assert [(r.source_path, r.chunk_type) for r in ps.chunk(docs).orderBy("line_start").collect()] == [("a.md", "heading"), ("a.md", "paragraph")]
    assert [r.source_path for r in ps.unsupported(docs).collect()] == ["b.bin"]
    ps.register("Binary", lambda text, limit: iter([(1, 1, "raw", text, {})]))
    try:
        assert ps.chunk(docs).filter("chunk_type = 'raw'").count() == 1
    finally:
        del ps.CHUNKERS["binary"]


def test_fitting_loses_nothing():
    for text in ("a b c d e f g", "word" * 9, "x  y\n\nz " * 20, ""):
        parts = ps.split_to_fit(text, 2, ps.words)
        assert "".join(parts) == text and all(ps.words(p) <= 2 for p in parts)


def test_hash_vectors():
    v = ps.hash_vectors(["red ring", "ring red", "", "blue"])
    assert v.shape == (4, 384) and np.allclose((v * v).sum(axis=1), 1) and np.allclose(v[0], v[1]) and v[2][-1] == 1 and v[0] @ v[3] < 0.1
    assert ps.fnv1a(b"a") == 0xE40C292C


@pytest.mark.parametrize("a, b, want", [([1, 0], [1, 0], 1), ([1, 0], [0, 1], 0), ([0, 0], [1, 0], 0), ([1e308, 0], [1e308, 0], 1), ([1e-308, 0], [1e-308, 0], 1), ([1, 1], [-1, -1], -1)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<double>, b array<double>")
    assert math.isclose(df.select(cosine(F.col("a"), F.col("b"))).first()[0], want, abs_tol=1e-12)
    assert math.isclose(float(unit_rows(np.array([a], float))[0] @ unit_rows(np.array([b], float))[0]), want, abs_tol=1e-12)


def test_cosine_of_long_vectors_takes_linear_time(spark):
    start = time.monotonic()
    v = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda x: F.sin(x.cast("double"))).alias("v")).localCheckpoint()
    assert math.isclose(v.select(cosine(F.col("v"), F.transform("v", lambda x: -2 * x))).first()[0], -1, abs_tol=1e-9)
    assert time.monotonic() - start < 60  # a norm computed again for each entry of each entry: 2000 ** 3 steps


def test_distances(spark):
    rows = spark.createDataFrame([(0.0,), (0.25,), (1.0,), (2.0,), (-0.25,), (2.25,)], "d double").select(similarity_of_distance(F.col("d"))).collect()
    assert [r[0] for r in rows] == [1, 0.75, 0, -1, 1, -1]


def test_nearest_ties_and_blocks(spark):
    rows = [(i, [1.0, float(i % 3)]) for i in range(30)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    want = [(r.query_id, r.id, r.sim, r.rank) for r in se.nearest(v, v.filter("id < 7"), 4).orderBy("query_id", "rank").collect()]
    assert want == [(r.query_id, r.id, r.sim, r.rank) for r in se.nearest(v, v.filter("id < 7"), 4, block=2).orderBy("query_id", "rank").collect()]
    assert [w[1] for w in want[:4]] == [3, 6, 9, 12] and len(want) == 28
    assert se.nearest(v, v.filter("id < 0"), 4).collect() == []
    assert se.nearest(v.limit(0), v.filter("id < 2"), 4).collect() == []


def test_parents(spark):
    rows = [("f", "whole", 1, 20), ("f", "part", 3, 9), ("f", "part2", 3, 9), ("f", "leaf", 4, 5), ("g", "leaf2", 4, 5)]
    chunks = spark.createDataFrame(rows, "source_path string, chunk_id string, line_start int, line_end int")
    assert {r.chunk_id: r.parent_id for r in se.enclosing_parents(chunks).collect()} == {"part": "whole", "part2": "whole", "leaf": "part"}


def test_metrics(spark):
    ranking = spark.createDataFrame([("q", 1, "a"), ("q", 2, "a"), ("q", 3, "b"), ("q", 4, "x"), ("r", 1, "z")], "query_id string, rank int, id string")
    qrels = spark.createDataFrame([("q", "a", 3), ("q", "b", 1), ("q", "c", 2), ("r", "y", 0), ("s", "k", 1)], "query_id string, id string, relevance int")
    got = {r.query_id: (r.recall, r.ndcg, r.mrr) for r in ev.query_metrics(ranking, qrels, 3).collect()}
    dcg, ideal = 3 / math.log2(2) + 1 / math.log2(4), 3 / math.log2(2) + 2 / math.log2(3) + 1 / math.log2(4)
    assert got["q"] == (round(2 / 3, 9), round(dcg / ideal, 9), 1.0) and got["r"] == (0, 0, 0) and got["s"] == (0, 0, 0)
    assert ev.mean_metrics(ev.query_metrics(ranking, qrels, 3)).first().queries == 3


def test_gate_of_runs(spark):
    run = lambda name, recall, ndcg: (name, 3, recall, ndcg, 0.5)
    schema = "name string, queries int, recall double, ndcg double, mrr double"
    base, now = spark.createDataFrame([run("a", 0.9, 0.8), run("b", 0.9, 0.8)], schema), spark.createDataFrame([run("a", 0.85, 0.76)], schema)
    got = {(r["name"], r.metric): r.passed for r in ev.regressions(base, now).collect()}
    assert got == {("a", "recall"): True, ("a", "ndcg"): False, ("b", "recall"): False, ("b", "ndcg"): False}


def test_percentiles(spark):
    rows = spark.createDataFrame([("a", float(x)) for x in (5, 1, 3, 2, 4)] + [("b", 7.0), ("b", None)], "g string, v double")
    got = {r.g: (r.n, r.p50, r.i50, r.p95, r.i95) for r in ev.percentiles(rows, "g", "v").collect()}
    assert got == {"a": (5, 3, 3, 5, 5), "b": (1, 7, 7, 7, 7)}


def test_updates(spark):
    old = spark.createDataFrame([(1, "x", "m"), (2, "x", "m"), (3, "x", "m"), (4, "x", "m")], "id int, input_hash string, meta_hash string")
    new = spark.createDataFrame([(1, "x", "m"), (2, "y", "m"), (3, "x", "n"), (5, "x", "m")], "id int, input_hash string, meta_hash string")
    assert {r.id: r.action for r in sy.plan_update(old, new, "id").collect()} == {1: "keep", 2: "embed", 3: "write", 4: "remove", 5: "embed"}


def test_targets(spark):
    cases = {
        ("a/b.md", "c.md"): "a/c.md", ("a/b.md", "/c.md#x"): "c.md", ("a/b.md", "../c.md"): "c.md", ("a/b.md", "../../c.md"): None, ("a/b.md", "./x/../y.md?q"): "a/y.md",
        ("a.md", "b%20c.md"): "b c.md", ("a.md", "b%2Fc.md"): None, ("a.md", "b+c.md"): "b+c.md", ("a.md", "b\\c.md"): None, ("a.md", "b%zz.md"): None, ("a.md", "b%2525.md"): "b%25.md",
    }
    df = spark.createDataFrame(list(cases), "s string, r string").select("s", "r", gr.target_path(F.col("s"), F.col("r")).alias("t"))
    assert {(r.s, r.r): r.t for r in df.collect()} == cases


def test_resolution(spark):
    raw = ["b.md", "x.png", "https://e.com/a", "mailto:a@b.c", "some prose", "gone.md", "../../up.md", "#here", ""]
    links = spark.createDataFrame([("a.md", x) for x in raw], "source string, raw_target string")
    files = spark.createDataFrame([("a.md", "concept"), ("b.md", "concept"), ("x.png", "asset")], "path string, kind string")
    got = {r.raw_target: r.resolution for r in gr.resolve(links, files).collect()}
    assert [got[x] for x in raw] == ["resolvedConcept", "resolvedAsset", "external", "external", "descriptor", "unresolved", "invalid", "resolvedConcept", "invalid"]


def test_markdown_links(spark):
    body = "See [a](x.md) and ![img](i.png) and `[no](c.md)`.\n```\n[no](d.md)\n```\n[b](<y z.md> \"t\") [c](/z.md#f)"
    df = spark.createDataFrame([("p.md", body)], "path string, body string")
    assert [r.raw_target for r in gr.markdown_links(df).orderBy("ordinal").collect()][::2] == ["x.md", "/z.md#f"]


def test_graph_shapes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("b", "c"), ("c", "c"), ("d", "e")], "source string, target string")
    pair = {(r.a, r.b): (r.forward, r.backward, r.n_links) for r in gr.merged_pairs(edges).collect()}
    assert pair == {("a", "b"): (True, True, 3), ("b", "c"): (True, False, 1), ("d", "e"): (True, False, 1)}
    assert {r.target: r.sources for r in gr.backlinks(edges).collect()} == {"a": ["b"], "b": ["a"], "c": ["b"], "e": ["d"]}
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.distance for r in gr.neighbourhood(edges, seeds, 9).collect()} == {"a": 0, "b": 1, "c": 2}


def test_titles(spark):
    rows = [("x/ring", "Red Ring", ["red"]), ("b", "A red thing", ["ring"]), ("c", "ring", []), ("ringed", None, None), ("e", "Blue", ["ring"])]
    df = spark.createDataFrame(rows, "id string, title string, tags array<string>")
    assert [r.id for r in ti.best_titles(df, "ring", 9).collect()] == ["c", "x/ring", "e", "b", "ringed"]
    got = {r.id: r.score for r in ti.title_matches(df, "ring").collect()}
    assert got == {"x/ring": 900, "b": 700, "c": 1200, "ringed": 540, "e": 700}
    assert {r.id: r.score for r in ti.title_matches(df, "red ring").collect()} == {"x/ring": 1200, "b": 700} and ti.title_matches(df, "  ").count() == 0
    long = "word " * 60 + "target " + "tail " * 60
    cut = spark.createDataFrame([(long,), ("short",)], "t string").select(ti.snippet(F.col("t"), "target", 40)).collect()
    assert "target" in cut[0][0] and cut[0][0].startswith("…") and cut[0][0].endswith("…") and len(cut[0][0]) <= 43 and cut[1][0] == "short"


def test_known_passage_ids(spark):
    ts = "import { Calculator } from './calculator';\n\nexport const buildCalculator = () => {\n  const calculator = new Calculator();\n  return {\n    divideSafely: (a: number, b: number) => calculator.divide(a, b),\n  };\n};\n"
    md = "# Table examples\n\n```markdown\n| Key | Value |\n| --- | ----- |\n| sample | literal |\n```\n\n| Key | Value |\n| --- | ----- |\n| sample | indexed |\n\nThe fenced example stays code. The following table is indexed once.\n"
    txt = "This is a sample text file for demonstrating the knowledge_embeddings library.\n\nIt contains multiple paragraphs that will be chunked and indexed.\n\nThe dense searcher ranks chunks with compatible local embeddings.\n\nThen we'll search for content similar to a query.\n"
    docs = spark.createDataFrame([("use_calculator.ts", "typescript", ts), ("tables.md", "markdown", md), ("search.txt", "text", txt)], "source_path string, content_type string, text string")
    got = {(r.source_path, r.line_start, r.line_end, r.chunk_type): r.chunk_id for r in ps.chunk(docs).collect()}
    assert got == {
        ("use_calculator.ts", 3, 8, "function"): "dcdba0715bb04b0273757c80707e4afee10e9c46",
        ("tables.md", 1, 1, "heading"): "10e2d88722cc8fca142427c3a4dd44e64a77f4a8",
        ("tables.md", 3, 7, "code"): "934d569c632dbfb251ce2b6c94d394157aecf3b8",
        ("tables.md", 9, 11, "table"): "2fe08428f99339746e6d1649a8d53c8728c2b3ea",
        ("tables.md", 13, 13, "paragraph"): "9f41895f30b344a9573a1e0ed07495546f0f0f1f",
        ("search.txt", 1, 1, "paragraph"): "5de64e7e3030b96ed3595c99e7a55bdae62b9bcf",
        ("search.txt", 3, 3, "paragraph"): "59b9ea712f2453e2dc26dd37d560b22f4f63202c",
        ("search.txt", 5, 5, "paragraph"): "e4d7069aac6117bd9f31ebdc7b852c0375afe474",
        ("search.txt", 7, 8, "paragraph"): "534ca6541d990ce7f74c3bca6316b5e4f19cdad8",
    }


def test_typescript_passages():
    text = "// doc } here\n@Deco()\nexport class A extends B {\n  private x = \"}\";\n  /** m */\n  async run(a: number): Promise<void> { if (a) { foo(); } }\n  handler = (e) => { return e; };\n  static make = async () => 1;\n}\ninterface I { a: string; }\nconst enum E { X }\ntype T = string | 'a;b';\nnamespace N.M { export function f() { return 1; } }\nexport default async function () { }\nlet z = 3;\n"
    got = [(s, e, k, d["symbol"], d["parent_symbol"]) for s, e, k, _, d in chunking.typescript(text)]
    assert got == [
        (1, 9, "class", "A", None), (5, 6, "method", "run", "A"), (7, 7, "method", "handler", "A"), (8, 8, "method", "make", "A"), (10, 10, "interface", "I", None),
        (11, 11, "enum", "E", None), (12, 12, "type", "T", None), (13, 13, "function", "f", "N.M"), (13, 13, "namespace", "N.M", None), (14, 14, "function", "default", None),
    ]
    big = "class Big {\n" + "  m() {\n    return 'xxxxxxxxxxxxxxxxxxxxxxxx';\n  }\n" * 9 + "}\n"
    first = next(chunking.typescript(big, 60))
    assert first[:4] == (1, 1, "class", "class Big") and first[4]["truncated"]
    assert list(chunking.typescript("let a = 1\n")) == [(1, 2, "file", "let a = 1\n", {})] and list(chunking.typescript(" \n")) == []


def _some_vectors(spark, n=60, size=5, seed=4):
    import numpy as np

    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, size)], f"d{i % 7}" if i % 11 else None) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, vector array<float>, doc string")


@pytest.mark.parametrize("block", [4, 4096])
def test_search_in_blocks_matches_all_pairs(spark, block):
    import numpy as np

    rows, v = _some_vectors(spark)
    unit = lambda x: np.array(x) / (np.linalg.norm(x) or 1)
    sims = {(q, i): round(float(np.clip(unit(a) @ unit(b), -1, 1)), 6) + 0.0 for q, a, _ in rows if q % 3 == 0 for i, b, _ in rows if i != q}
    asked = v.filter("id % 3 = 0")
    got = {(r.query_id, r["rank"]): (r.id, r.sim) for r in se.nearest(v, asked, 4, block=block).collect()}
    best = {(r.query_id, r.doc): (r.id, r.sim) for r in se.nearest_per_document(v, asked, "doc", block=block).collect()}
    for q in range(0, len(rows), 3):
        order = sorted((i for i, _, _ in rows if i != q), key=lambda i: (-sims[q, i], i))
        assert [got[q, k] for k in range(1, 5)] == [(i, sims[q, i]) for i in order[:4]]
        for doc in {d for _, _, d in rows}:
            first = next(i for i in order if rows[i][2] == doc)
            assert best[q, doc] == (first, sims[q, first])
    for limit in (1, 2, 5):  # what may be missing is not among the best
        some = {(r.query_id, r.doc): (r.id, r.sim) for r in se.nearest_per_document(v, asked, "doc", block=block, limit=limit).collect()}
        for q in range(0, len(rows), 3):
            whole = sorted(x[1] for (query, _), x in best.items() if query == q)[-limit]
            assert {k: x for k, x in some.items() if k[0] == q and x[1] >= whole} == {k: x for k, x in best.items() if k[0] == q and x[1] >= whole}


def test_vectors_without_a_similarity_are_refused(spark):
    schema = "id long, vector array<float>"
    good = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], schema)
    for bad in ([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])], [(1, None)], [(1, [])], [(1, [1.0, None, 0.0])], [(1, [float("nan"), 0.0, 1.0])], [(1, [float("inf"), 0.0, 1.0])]):
        odd = spark.createDataFrame(bad, schema)
        with pytest.raises(ValueError):
            se.nearest(odd, good, 2)
        with pytest.raises(ValueError):
            se.nearest(good, odd, 2)
    none = good.limit(0)
    assert se.nearest(none, good, 2).collect() == [] and se.nearest(good, none, 2).collect() == []
