import pytest
from pyspark.sql import functions as F

from lodestone.operators import evaluation as ev
from lodestone.operators import graph as gr
from lodestone.operators import rules as ru
from lodestone.operators import search as se
from lodestone.operators import titles as ti


def test_letters_in_order(spark):
    def plain(text, needle):
        at = gaps = runs = 0
        last = None
        for c in needle.replace(" ", ""):
            found = text.find(c, at)
            if found < 0:
                return 0
            gaps += found - at
            runs += last != found - 1
            last, at = found, found + 1
        score = 300 - 4 * gaps - 6 * runs
        return 0 if gaps > 3 * len(needle) + 6 or score <= 0 or len(needle) < 2 else score

    texts = ["red ring", "reading", "r d i g", "nothing", "rrddiigg", "", "r" + "x" * 40 + "dig"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for needle in ("rdig", "rd ig", "r", "zz", "red"):
        got = [r[0] for r in df.select(ti.letters_in_order(F.col("t"), needle)).collect()]
        assert got == [plain(t, needle) for t in texts], needle


def test_greedy_spans(spark):
    ranked = spark.createDataFrame([("q", 1, "f", 1, 10), ("q", 2, "f", 1, 4), ("q", 3, "f", 3, 4), ("r", 1, "f", 1, 9)], "query_id string, rank int, source_path string, line_start int, line_end int")
    judged = spark.createDataFrame([("q", "a", "f", 1, 3), ("q", "b", "f", 4, 8), ("r", "c", "g", 1, 3)], "query_id string, target_id string, source_path string, line_start int, line_end int")
    assert sorted((r.query_id, r.rank, r.target_id) for r in ev.greedy_span_matches(ranked, judged).collect()) == [("q", 1, "b"), ("q", 2, "a")]


def test_governors(spark):
    assert se.governing_chains({"a": "b", "b": "c"}) == {"a": ["b", "c"], "b": ["c"]}
    for bad in ({"a": "b", "b": "a"}, {"a": "a"}):
        with pytest.raises(ValueError):
            se.governing_chains(bad)
    with pytest.raises(ValueError):
        se.governing_chains({"a": "b"}, known={"a"})
    matches = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 3)], "query_id string, document string, rank int")
    got = [r.document for r in se.with_governors(matches, {"a": "b", "b": "c"}).orderBy("place").collect()]
    assert got == ["x", "c", "b", "a"]
    assert [r.document for r in se.with_governors(matches, {}).orderBy("place").collect()] == ["x", "a", "b"]


def test_actors_and_renderers(spark):
    row = [("a.md", ("bot:x", "t"), [("human:y", "t")], [("z",), (" ",), (None,)]), ("b.md", None, None, None)]
    df = spark.createDataFrame(row, "path string, generated struct<by:string,at:string>, verified array<struct<by:string,at:string>>, sources array<struct<author:string>>")
    assert sorted(r.actor for r in ru.actors(df).collect()) == ["bot:x", "human:y", "z"]
    edges = spark.createDataFrame([("a", 'b"'), ("a", "c")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("c",)], "node string")
    assert gr.render(edges, nodes).split("\n") == ["digraph {", '  n0 [label="a"];', '  n1 [label="c"];', '  n2 [label="b\\""];', "  n0 -> n1;", "  n0 -> n2;", "}"]
    assert "n0 --> n2" in gr.render(edges, nodes, "mermaid")


def test_rerank_and_expansion(spark):
    scored = spark.createDataFrame([("q", i, 1.0 - i / 10, i + 1) for i in range(5)], "query_id string, id int, sim double, rank int")
    got = [r.id for r in se.rerank(scored, F.col("id") % 2, 2, candidates=3).orderBy("new_rank").collect()]
    assert got == [1, 0]
    matches = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, document string, rank int")
    edges = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "c"), ("b", 1, "d"), ("b", 2, "e")], "source string, ordinal int, target string")
    passages = spark.createDataFrame([(x, f"{x}1") for x in "abcde"], "document string, passage_id string")
    assert [(r.via, r.document) for r in se.expand_links(matches, edges, passages, 2).orderBy("position").collect()] == [("a", "c"), ("b", "d")]


def test_answers_by_topic_are_those_by_pairs(spark):
    from lodestone.operators import evaluation as ev

    topic = {1: 0, 2: 0, 3: 0, 4: 2, 5: 1, 6: None, 7: 4, 8: 4}
    ids = spark.createDataFrame([(i, t) for i, t in topic.items() if t is None or t % 2 == 0], "id long, topic int")
    asked = spark.createDataFrame([(q, topic[q], q % 2) for q in (1, 2, 4, 5, 6, 7)] + [(20, 4, 0), (21, 9, 1)], "query_id long, topic int, g int")
    pairs = asked.join(ids, "topic").filter("id <> query_id").select("query_id", "id")
    ranking = spark.createDataFrame([(1, 1, 3), (1, 2, 8), (1, 3, 2), (2, 1, 7), (4, 1, 1), (5, 1, 1), (7, 3, 8), (20, 1, 5), (20, 2, 7), (21, 1, 1)], "query_id long, rank int, id long")
    for group in ((), ("g",)):
        for k in (1, 2, 3):
            want = {tuple(r) for r in ev.answer_metrics(ranking, pairs, asked, k, *group).collect()}
            assert {tuple(r) for r in ev.topic_answer_metrics(ranking, ids, asked, k, *group).collect()} == want and want
