import json

import pytest

from lodestone.operators import metadata as md
from lodestone.sources import judgments, saved_queries


def test_judgments(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"q1": "first", "q2": "second"}, indent=2))
    (tmp_path / "r.json").write_text(json.dumps({"q1": {"a": 3, "b": 0}, "q2": {}}, indent=2))
    (tmp_path / "g.json").write_text(json.dumps({"q1": "x"}))
    queries, qrels, groups = (f(spark, str(tmp_path / n)) for f, n in ((judgments.read_queries, "q.json"), (judgments.read_qrels, "r.json"), (judgments.read_groups, "g.json")))
    assert {(r.query_id, r.text) for r in queries.collect()} == {("q1", "first"), ("q2", "second")}
    assert {(r.query_id, r.id, r.relevance) for r in qrels.collect()} == {("q1", "a", 3), ("q1", "b", 0)}
    with pytest.raises(ValueError, match="q2"):
        judgments.check_groups(queries, groups)
    judgments.check_groups(queries.filter("query_id = 'q1'"), groups)


def test_saved_queries():
    good = b'{"format": 1, "where": {"types": ["Guide"]}}'
    assert saved_queries.parse_saved_query("my-query-1", good) == md.Query.parse({"where": {"types": ["Guide"]}})
    bad = [("Bad", good), ("a--b", good), ("x" * 65, good), ("a", b'{"where": {}}'), ("a", b'{"format": 2}'), ("a", b'{"format": true}'), ("a", b'{"format": 1, "where": {}, "where": {}}'), ("a", b"{"), ("a", b"\xff"), ("a", b" " * 65_537), ("a", b"[]")]
    for id_, raw in bad:
        with pytest.raises(md.QueryError):
            saved_queries.parse_saved_query(id_, raw)


def test_pages_as_text(spark):
    df = spark.createDataFrame([("b", "x", "x.md", "A|B\n\x07", ["t", "u"], False, None)], "bundle string, id string, path string, title string, tags array<string>, has_status boolean, status string")
    query = md.Query.parse({"select": ["title", "tags", "effective_status"]})
    table = saved_queries.page_markdown(md.page(df, query))
    assert table.split("\n")[2] == "| b | x | x.md | A\\|B \\u{7} | t, u | stable |"
    page = json.loads(saved_queries.page_json(md.page(df, query), md.page_summary(df, query)))
    assert (page["schema_version"], page["total"], page["returned"], page["has_more"], page["rows"][0]["tags"]) == (1, 1, 1, False, ["t", "u"])


def test_a_budget_is_filled_by_path(spark):
    import itertools
    import random

    from lodestone.sources import bundles

    two = spark.createDataFrame([("z.md", 10), ("a/x.md", 10)], "path string, n_bytes long")
    assert {r.path: r.fits for r in bundles.within_budget(two, 10).collect()} == {"a/x.md": True, "z.md": False}
    pick = random.Random(2)
    paths = sorted({"/".join(pick.choice(["a", "a.md", "b", "a-b", "ä", "B"]) for _ in range(pick.randrange(1, 4))) for _ in range(120)}, key=lambda p: p.encode())
    sizes = [pick.choice([0, 1, 7, None]) for _ in paths]
    df = spark.createDataFrame(list(zip(paths, sizes)), "path string, n_bytes long").repartition(5)
    sums = dict(zip(paths, itertools.accumulate(x or 0 for x in sizes)))
    for budget in (0, 50, 10**6):
        assert {r.path: r.fits for r in bundles.within_budget(df, budget).collect()} == {p: n <= budget for p, n in sums.items()}
    assert bundles.within_budget(df.limit(0), 5).collect() == []
