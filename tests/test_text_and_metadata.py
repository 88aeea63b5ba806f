import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import metadata as md

CONCEPTS = [
    ("one", "a", "a.md", "Research", "Alpha", "First one", False, None, ["theology", "reading"], None),
    ("one", "nested/b", "nested/b.md", "Research", "Beta", None, True, "draft", ["theology"], None),
    ("one", "c", "c.md", "Guide", "Gamma", None, True, "custom", ["reading"], None),
    ("two", "a", "a.md", "Guide", None, None, True, None, None, None),
]
SCHEMA = "bundle string, id string, path string, type string, title string, description string, has_status boolean, status string, tags array<string>, resource string"


@pytest.fixture(scope="module")
def concepts(spark):
    return spark.createDataFrame(CONCEPTS, SCHEMA)


def ids(concepts, **where):
    return sorted(r.id for r in md.matching(concepts, md.Query.parse({"where": where})).collect())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_filters(concepts):
    assert ids(concepts, required_tags=["reading", "theology"]) == ["a"]
    assert ids(concepts, tags=["reading", "theology"]) == ["a", "c", "nested/b"]
    assert ids(concepts, title_contains="ALP") == ["a"] and ids(concepts, title_contains="A.*") == []
    assert ids(concepts, path_prefixes=["nested"]) == ["nested/b"] and ids(concepts, path_prefixes=["nest"]) == []
    assert ids(concepts, statuses=["stable"]) == ["a"] and ids(concepts, statuses=["draft", "custom"]) == ["c", "nested/b"]
    assert ids(concepts, types=["research"]) == [] and ids(concepts) == ["a", "a", "c", "nested/b"]


def test_pages_and_groups(concepts):
    query = md.Query.parse({"order_by": [{"field": "title", "direction": "desc"}]})
    assert [r.title for r in md.page(concepts, query).collect()] == ["Gamma", "Beta", "Alpha", None]
    assert md.page(concepts, query, offset=1, limit=2).columns == ["bundle", "id", "path", "title", "type", "effective_status"]
    summary = md.page_summary(concepts, query, offset=1, limit=2).first()
    assert (summary.total, summary.returned, summary.has_more) == (4, 2, True)
    groups = md.page(concepts, md.Query.parse({"group_by": "effective_status"})).collect()
    assert [(r.key, r["count"]) for r in groups] == [("custom", 1), ("draft", 1), ("stable", 1), (None, 1)]


@pytest.mark.parametrize(
    "spec",
    [{"x": 1}, {"where": {"y": []}}, {"where": {"types": [" "]}}, {"where": {"types": ["a", "a"]}}, {"select": []}, {"select": ["body"]}, {"group_by": "tags"}, {"group_by": "type", "select": ["title"]}, {"order_by": [{"field": "tags"}]}],
)
def test_bad_queries_are_refused(spec):
    with pytest.raises(md.QueryError):
        md.Query.parse(spec)


def test_page_bounds(concepts):
    for offset, limit in ((0, 0), (0, 1001), (-1, 5)):
        with pytest.raises(md.QueryError):
            md.page(concepts, md.Query(), offset, limit)


def test_order_is_by_utf16_units(spark):
    rows = spark.createDataFrame([("～",), ("🙂",), ("a",)], "t string")
    assert [r.t for r in rows.orderBy(tx.utf16_key(F.col("t"))).collect()] == ["a", "🙂", "～"]


def test_trust_and_staleness(spark):
    tier = lambda v: value(spark, md.trust_tier(F.from_json(F.lit(v), "array<struct<by:string>>")))
    assert tier("[]") == "unverified" and tier('[{"by":"bot:x"}]') == "machine-confirmed" and tier('[{"by":"bot:x"},{"by":"human:y"}]') == "human-reviewed"
    as_of = F.lit("2026-01-02 00:00:00").cast("timestamp")
    assert value(spark, md.is_stale(F.lit("2026-01-02T00:00:00Z"), as_of)) and not value(spark, md.is_stale(F.lit("2026-01-03T00:00:00Z"), as_of))
    assert not value(spark, md.is_stale(F.lit("soon"), as_of)) and not value(spark, md.is_stale(F.lit(None).cast("string"), as_of))


def test_paths(spark):
    kind = lambda p: value(spark, tx.file_kind(F.lit(p)))
    assert [kind(p) for p in ("a/index.md", "log.md", "a/b.md", "a/b.MD", "a.png")] == ["index", "log", "concept", "asset", "asset"]
    assert value(spark, tx.normalised_path(F.lit(" a\\b// "))) == "a/b" == tx.normalise_path(" a\\b// ")
    assert value(spark, tx.implied_directories(F.lit("a/b/c.md"))) == ["a", "a/b"] and value(spark, tx.implied_directories(F.lit("c.md"))) == []
    assert value(spark, tx.concept_id(F.lit("a/b.md"))) == "a/b"


@pytest.mark.parametrize(
    "glob, path, matches",
    [("*.md", "a.md", True), ("*.md", "x/a.md", True), ("a/*.md", "a/b/c.md", False), ("a/**/c.md", "a/c.md", True), ("a/**/c.md", "a/b/d/c.md", True), ("**.md", "a/b.md", True), ("a+b.md", "aab.md", False), ("a.md", "xa.md", False)],
)
def test_globs(spark, glob, path, matches):
    assert value(spark, F.lit(path).rlike(tx.glob_regex(glob))) is matches


def test_identifiers(spark):
    content = "This is a sample text file for demonstrating the knowledge_embeddings library."
    args = [F.lit(x) for x in ("search.txt", 1, 1, "paragraph", content)]
    got = value(spark, tx.chunk_id(*args))
    import hashlib

    assert got == hashlib.sha1(f"search.txt|1|1|paragraph|{hashlib.sha1(content.encode()).hexdigest()}".encode()).hexdigest()
    assert value(spark, tx.parse_citation(tx.citation(F.lit("a:b.md"), F.lit(3), F.lit(9)))) == ("a:b.md", 3, 9)
    assert value(spark, tx.parse_citation(F.lit("a.md")))[0] is None
    assert value(spark, tx.line_at(F.lit("a\nb\nc"), F.lit(2))) == 2
    assert value(spark, tx.context_text(F.lit("T"), F.lit(None).cast("string"), F.lit("S"), F.lit(""), F.lit("p"))) == "Title: T\n\nSection: S\n\nPassage: p"
    assert value(spark, tx.humanise(F.lit("snake_case-name"))) == "Snake case name" and value(spark, tx.counted(F.lit(1), "file")) == "1 file"
    assert value(spark, tx.escape_cell(F.lit("a|b\nc"))) == "a\\|b c" and value(spark, tx.non_whitespace_length(F.lit("a b\t\n\x0bc"))) == 3
