"""Search of an index as one step: eligibility, coverage, best passage of each document, context, notices."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import citation
from .metadata import Query, current, effective_status, predicate, within
from .passages import Embedder, embed_queries
from .search import SearchOptions, governing_chains, nearest, nearest_per_document, uncovered

#: Rows that a page for people may have.
MAX_PAGE = 100


@dataclass(frozen=True)
class Policy:
    """Which documents a search may return, and what comes with them.

    ``where`` is the filter of a metadata query.  ``governing`` maps a document
    to the one that governs it.  With ``expand`` linked documents are context.
    """

    where: dict = field(default_factory=dict)
    current_only: bool = False
    as_of: Column | None = None
    statuses: tuple[str, ...] = ()
    types: tuple[str, ...] = ()
    path_prefixes: tuple[str, ...] = ()
    governing: dict = field(default_factory=dict)
    expand: bool = False

    def column(self) -> Column:
        """The filter over a documents table (id, type, status, has_status, stale_after and what ``where`` names)."""
        parts = [predicate(Query.parse({"where": self.where}).where)] if self.where else []
        if self.current_only:
            parts.append(current(F.current_timestamp() if self.as_of is None else self.as_of))
        if self.statuses:
            parts.append(effective_status().isin(*self.statuses))
        if self.types:
            parts.append(F.col("type").isin(*self.types))
        if self.path_prefixes:
            parts.append(reduce(or_, (within(p, F.col("id")) for p in self.path_prefixes)))
        return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


@dataclass(frozen=True)
class Found:
    """matches: query_id, rank, source_path, id, sim.  context: query_id, position, source_path, id, reason, via.  notices: query_id, position, message, paths."""

    matches: DataFrame
    context: DataFrame
    notices: DataFrame


def eligible_passages(passages: DataFrame, documents: DataFrame, policy: Policy) -> DataFrame:
    """Passages (id, source_path and more) of the documents that a policy allows."""
    allowed = documents.filter(policy.column()).select(F.col("path").alias("source_path"))
    return passages.join(allowed, "source_path", "left_semi")


def search_index(passages: DataFrame, vectors: DataFrame, documents: DataFrame, queries: DataFrame, policy: Policy = Policy(), limit: int = 5, context_limit: int | None = None, edges: DataFrame | None = None) -> Found:
    """The ``limit`` best documents of each query by their best passage, and the context that the policy asks for.

    Passages are told eligible before any is scored, and each needs a vector
    (id, vector): a gap raises ValueError, because what is found would depend on
    it.  ``queries`` has id and vector.  Ties go by path and id.  A limit below
    1 finds nothing.
    """
    eligible = eligible_passages(passages, documents, policy)
    gaps = uncovered(eligible, vectors, "id").limit(5).collect()
    if gaps:
        raise ValueError(f"eligible passages without a vector, synchronise the index: {[r.id for r in gaps]}")
    scored = eligible.select("id", "source_path").join(vectors, "id")
    best = nearest_per_document(scored, queries, "source_path", skip_self=False, limit=max(1, limit))
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "source_path", "id")
    matches = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return context_for(matches.select("query_id", "rank", "source_path", "id", "sim"), eligible, documents, policy, limit if context_limit is None else context_limit, edges)


def context_for(matches: DataFrame, eligible: DataFrame, documents: DataFrame, policy: Policy, budget: int, edges: DataFrame | None = None) -> Found:
    """Context of ranked matches, up to ``budget`` documents a query, each once, governors before what they govern.

    A match is followed by the targets of its edges (source, ordinal,
    raw_target, resolution, resolved_path) where the policy expands them.
    Matches that are not eligible are left out.  What cannot be followed is a
    notice: one for each sentence, with all paths that led to it.
    """
    spark = matches.sparkSession
    first = eligible.groupBy("source_path").agg(F.min_by("id", F.struct("line_start", "id")).alias("first_id"))
    chains = governing_chains(policy.governing, {r.path for r in documents.filter(F.col("path").isin(*{*policy.governing, *policy.governing.values()})).select("path").collect()} if policy.governing else None)
    own = matches.join(first, "source_path").select("query_id", "rank", F.lit(-1).alias("ordinal"), "source_path", F.col("id"), F.lit("match").alias("reason"), F.lit(None).cast("string").alias("via"))
    wanted, lost = own, None
    if policy.expand and edges is not None:
        hops = own.select("query_id", "rank", F.col("source_path").alias("via")).join(edges.withColumnRenamed("source", "via"), "via")
        near = hops.join(first.select(F.col("source_path").alias("resolved_path"), "first_id"), "resolved_path")
        wanted = wanted.unionByName(near.select("query_id", "rank", "ordinal", F.col("resolved_path").alias("source_path"), F.col("first_id").alias("id"), F.lit("relationship").alias("reason"), "via"))
        broken = hops.filter(F.col("resolution").isin("unresolved", "invalid"))
        lost = broken.select("query_id", "rank", "ordinal", F.concat(F.lit("Unresolved relationship: "), "raw_target").alias("message"), F.col("via").alias("path"))
    wanted = wanted.withColumn("up", F.lit(1_000_000))
    steps = [(d, k + 1, g) for d, c in chains.items() for k, g in enumerate(c)]
    if steps:
        # the map is a setting of the caller: a few rows
        known = spark.createDataFrame(steps, "source_path string, k int, governor string").join(first.select(F.col("source_path").alias("governor"), "first_id"), "governor", "left")
        nearer = Window.partitionBy("source_path").orderBy("k")
        reached = known.withColumn("whole", F.min(F.col("first_id").isNotNull()).over(nearer.rowsBetween(Window.unboundedPreceding, 0)))
        lower = F.coalesce(F.lag("governor").over(nearer), "source_path")
        reached = reached.withColumns({"lower": lower, "nearer_whole": F.coalesce(F.lag("whole").over(nearer), F.lit(True))})
        at = wanted.select("query_id", "rank", "ordinal", "source_path").join(F.broadcast(reached), "source_path")
        above = at.filter("whole").select("query_id", "rank", "ordinal", F.col("governor").alias("source_path"), F.col("first_id").alias("id"), F.lit("governing").alias("reason"), F.col("lower").alias("via"), (-F.col("k")).alias("up"))
        wanted = wanted.unionByName(above)
        missing = at.filter(~F.col("whole") & F.col("nearer_whole")).select("query_id", "rank", "ordinal", F.concat(F.lit("Governing source excluded or has no passage: "), "governor").alias("message"), F.col("governor").alias("path"))
        lost = missing if lost is None else lost.unionByName(missing)
    once = Window.partitionBy("query_id", "source_path").orderBy("rank", "ordinal", "up", "via")
    place = Window.partitionBy("query_id").orderBy("rank", "ordinal", "up", "source_path")
    firsts = wanted.withColumn("__n", F.row_number().over(once)).filter("__n = 1")
    # a document that is a match too is shown by the passage that matched
    by_match = own.select("query_id", "source_path", F.col("id").alias("matched"))
    context = firsts.withColumn("position", F.row_number().over(place)).filter(F.col("position") <= budget)
    context = context.join(by_match, ["query_id", "source_path"], "left").select("query_id", "position", "source_path", F.coalesce("matched", "id").alias("id"), "reason", "via")
    return Found(matches, context, notices(lost) if lost is not None else spark.createDataFrame([], "query_id long, position int, message string, paths array<string>"))


def notices(lost: DataFrame) -> DataFrame:
    """query_id, position, message and paths: one notice for each sentence, in the order of its first (rank, ordinal)."""
    one = lost.groupBy("query_id", "message").agg(F.min(F.struct("rank", "ordinal")).alias("at"), F.array_sort(F.collect_set("path")).alias("paths"))
    order = Window.partitionBy("query_id").orderBy("at", "message")
    return one.withColumn("position", F.row_number().over(order)).select("query_id", "position", "message", "paths")


def search_texts(passages: DataFrame, vectors: DataFrame, queries: DataFrame, options: SearchOptions = SearchOptions(), limit: int = 5, embedder: Embedder = Embedder()) -> DataFrame:
    """query_id, rank, id and sim of the ``limit`` best passages that ``options`` allow, for queries in words (id, text).

    Blank queries find nothing.  Where passages are allowed but none of them has
    a vector, the index and the passages are not of one making: ValueError.
    """
    allowed = passages.filter(options.column()).select("id")
    stored = vectors.join(allowed, "id", "left_semi").select("id", "vector")
    if not stored.limit(1).count() and allowed.limit(1).count():
        raise ValueError("no allowed passage has a vector")
    return nearest(stored, embed_queries(queries, embedder), max(limit, 0), skip_self=False).select("query_id", "rank", "id", "sim")


def policy_variants(policy: Policy) -> dict[str, Policy]:
    """The policies that an evaluation compares with the full one: parts of it alone, and none."""
    bare = Policy(as_of=policy.as_of)
    return {
        "none": bare,
        "current": replace(bare, current_only=True),
        "scoped": replace(bare, where=policy.where, statuses=policy.statuses, types=policy.types, path_prefixes=policy.path_prefixes),
        "expanded": replace(bare, expand=True),
        "governed": replace(bare, governing=policy.governing),
        "current and expanded": replace(bare, current_only=True, expand=True),
        "full": policy,
    }


def search_variants(passages: DataFrame, vectors: DataFrame, documents: DataFrame, queries: DataFrame, policy: Policy, limit: int = 5, edges: DataFrame | None = None) -> DataFrame:
    """variant, query_id, rank, source_path and reason of the context that each variant of a policy gives."""
    runs = [
        search_index(passages, vectors, documents, queries, p, limit, edges=edges).context.select(F.lit(name).alias("variant"), "query_id", F.col("position").alias("rank"), "source_path", "reason")
        for name, p in policy_variants(policy).items()
    ]
    return reduce(DataFrame.unionByName, runs)


def bounded_rows(page: DataFrame, limit: int = MAX_PAGE) -> list:
    """The rows of a page for people; more than ``limit`` are refused instead of gathered."""
    rows = page.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a page has at most {limit} rows")
    return rows


def _shown(text: object) -> str:
    """Text on one line, without control characters and characters that turn the direction of writing."""
    return "".join(c if c.isprintable() else f"\\u{{{ord(c):x}}}" for c in str(text).replace("\n", " "))


def _cited(passages: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with the citation and text of their passages."""
    text = passages.select("id", citation(F.col("source_path"), F.col("line_start"), F.col("line_end")).alias("citation"), "content")
    return hits.join(text, "id")


def matches_markdown(found: Found, passages: DataFrame, query_id: int) -> str:
    """The matches, context and notices of one query as Markdown, with citations."""
    mine = lambda df: df.filter(F.col("query_id") == query_id)
    hits = bounded_rows(_cited(passages, mine(found.matches)).orderBy("rank"))
    more = bounded_rows(_cited(passages, mine(found.context).filter("reason <> 'match'")).orderBy("position"))
    told = bounded_rows(mine(found.notices).orderBy("position"))
    lines = ["# Matches", ""]
    for r in hits:
        lines += [f"{r['rank']}. `{_shown(r.citation)}` ({r.sim:.3f})", "", *(f"   > {_shown(x)}" for x in r.content.split("\n")), ""]
    if not hits:
        lines += ["No passage matches.", ""]
    if more:
        lines += ["# Related", "", *(f"- `{_shown(r.citation)}` ({r.reason} of {_shown(r.via)})" for r in more), ""]
    if told:
        lines += ["# Notices", "", *(f"- {_shown(r.message)} ({', '.join(map(_shown, r.paths))})" for r in told), ""]
    return "\n".join(lines)


def matches_json(found: Found, passages: DataFrame, query_id: int) -> str:
    """The matches, context and notices of one query as one JSON object."""
    mine = lambda df: df.filter(F.col("query_id") == query_id)
    shape = lambda r, *keys: {k: r[k] for k in keys if r[k] is not None}
    return json.dumps(
        {
            "schema_version": 1,
            "matches": [shape(r, "rank", "source_path", "id", "sim", "citation", "content") for r in bounded_rows(_cited(passages, mine(found.matches)).orderBy("rank"))],
            "context": [shape(r, "position", "source_path", "id", "reason", "via", "citation") for r in bounded_rows(_cited(passages, mine(found.context)).orderBy("position"))],
            "notices": [shape(r, "message", "paths") for r in bounded_rows(mine(found.notices).orderBy("position"))],
        },
        ensure_ascii=False,
    )


def merge_projects(found: dict[str, Found], limit: int) -> DataFrame:
    """query_id, rank, bundle, source_path, id and sim of the best documents of several bundles, searched each for itself."""
    rows = [f.matches.withColumn("bundle", F.lit(name)) for name, f in found.items()]
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "bundle", "source_path", "id")
    merged = reduce(DataFrame.unionByName, rows).withColumn("rank", F.row_number().over(order))
    return merged.filter(F.col("rank") <= limit).select("query_id", "rank", "bundle", "source_path", "id", "sim")

