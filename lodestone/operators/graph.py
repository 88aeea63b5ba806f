"""Link graphs between documents: extraction, resolution, backlinks, neighbourhoods."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Nodes, and links, of a graph that is rendered as text.
MAX_RENDERED = 5000
#: The origin of links in texts; how a link can resolve.
BODY = "bodyLink"
RESOLUTIONS = ("resolvedConcept", "resolvedAsset", "external", "descriptor", "unresolved", "invalid")


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, ordinal and raw_target of each href of a page, in order."""
    targets = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return pages.select("page_id", F.posexplode(targets).alias("ordinal", "raw_target"))


def markdown_links(documents: DataFrame) -> DataFrame:
    """path, ordinal and raw_target of inline Markdown links, outside of code fences and code spans."""
    body = F.regexp_replace("body", r"(?ms)^(```+|~~~+).*?^\1[ \t]*$", "")
    body = F.regexp_replace(body, r"`[^`\n]*`", "")
    targets = F.regexp_extract_all(body, F.lit(r"(?<!!)\[[^\]]*\]\(\s*<?([^)\s>]*)>?[^)]*\)"), 1)
    return documents.select("path", F.posexplode(targets).alias("ordinal", "raw_target"))


def field_links(documents: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """path, origin, ordinal and raw_target of link fields: a string, or a list of structs with ``resource``."""
    found = None
    for name in fields:
        kind = dict(documents.dtypes)[name]
        many = F.array(F.col(name)) if kind == "string" else F.transform(name, lambda x: x["resource"])
        one = documents.select("path", F.lit(name if kind == "string" else f"{name}.resource").alias("origin"), F.posexplode(many).alias("ordinal", "raw_target")).filter("raw_target is not null")
        found = one if found is None else found.unionByName(one)
    return found


def target_path(source: Column, raw: Column) -> Column:
    """Path in the bundle that a target names, from the place of ``source``; null if it leaves the bundle or is no path.

    A fragment is dropped; ``/a`` starts at the root; ``.`` and ``..`` are
    resolved; an encoded slash, a backslash and control characters are refused.
    """
    plain = F.regexp_replace(raw, r"[#?].*$", "")
    refused = plain.rlike(r"(?i)%2f|%5c|\\|[\x00-\x1f\x7f]|%(?![0-9a-f]{2})")
    decoded = F.when(~refused, F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))))
    here = F.when(plain.startswith("/"), F.lit("")).otherwise(F.regexp_replace(source, r"[^/]*$", ""))
    segments = F.split(F.concat(here, F.regexp_replace(decoded, "^/+", "")), "/")
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(True).alias("inside"))

    def step(done: Column, part: Column) -> Column:
        stack, up = done["stack"], part == ".."
        return F.struct(
            F.when((part == "") | (part == "."), stack).when(up, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part))).alias("stack"),
            (done["inside"] & ~(up & (F.size(stack) == 0))).alias("inside"),
        )

    walked = F.aggregate(segments, start, step)
    return F.when(walked["inside"] & (F.size(walked["stack"]) > 0), F.array_join(walked["stack"], "/"))


def outside_path(source: Column, raw: Column) -> Column:
    """Path, beginning with ``../``, of a target that leaves the bundle, seen from its root; null for others."""
    plain = F.regexp_replace(F.trim(raw), r"[#?].*$", "")
    here = F.when(plain.startswith("/"), F.lit("")).otherwise(F.regexp_replace(source, r"[^/]*$", ""))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(0).alias("ups"))

    def step(done: Column, part: Column) -> Column:
        stack, up = done["stack"], part == ".."
        return F.struct(
            F.when((part == "") | (part == "."), stack).when(up, F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).otherwise(F.concat(stack, F.array(part))).alias("stack"),
            (done["ups"] + F.when(up & (F.size(stack) == 0), 1).otherwise(0)).alias("ups"),
        )

    walked = F.aggregate(F.split(F.concat(here, F.regexp_replace(plain, "^/+", "")), "/"), start, step)
    address = plain.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | plain.startswith("//")
    return F.when(~address & (walked["ups"] > 0), F.concat(F.repeat(F.lit("../"), walked["ups"]), F.array_join(walked["stack"], "/")))


def resolve(links: DataFrame, inventory: DataFrame, concept_kind: str = "concept") -> DataFrame:
    """Add resolution and resolved_path to links (source, raw_target), against an inventory (path, kind)."""
    raw = F.trim("raw_target")
    external = raw.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | raw.startswith("//")
    looks_like_path = raw.rlike(r"[/#]|\.[A-Za-z0-9]+$")
    own = links.withColumn("__path", F.when(raw.startswith("#"), F.col("source")).when(~external & looks_like_path, target_path(F.col("source"), raw)))
    files = inventory.select(F.col("path").alias("__path"), F.col("kind").alias("__kind"))
    kind = (
        F.when(raw == "", "invalid")
        .when(external, "external")
        .when(~looks_like_path, "descriptor")
        .when(F.col("__path").isNull(), "invalid")
        .when(F.col("__kind") == concept_kind, "resolvedConcept")
        .when(F.col("__kind").isNotNull(), "resolvedAsset")
        .otherwise("unresolved")
    )
    joined = own.join(files, "__path", "left")
    return joined.withColumn("resolution", kind).withColumn("resolved_path", F.when(F.col("__kind").isNotNull(), F.col("__path"))).drop("__path", "__kind")


def backlink_rows(edges: DataFrame) -> DataFrame:
    """target, source and n_links of every linked pair, without links to oneself: backlinks as rows, however many a target has."""
    return edges.filter("source <> target").groupBy("target", "source").agg(F.count("*").alias("n_links"))


def backlinks(edges: DataFrame, most: int = 1000) -> DataFrame:
    """target, n_links, n_sources and sources (sorted) of edges (source, target), without links to oneself.

    Counts are of all links.  ``sources`` is for pages that show a document: it
    is null for targets with more than ``most`` sources, whose sources are rows
    of ``backlink_rows``.
    """
    pairs = backlink_rows(edges)
    counts = pairs.groupBy("target").agg(F.sum("n_links").alias("n_links"), F.count("*").alias("n_sources"))
    few = pairs.join(counts.filter(F.col("n_sources") <= most).select("target"), "target").groupBy("target").agg(F.array_sort(F.collect_list("source")).alias("sources"))
    return counts.join(few, "target", "left")


def inbound_counts(edges: DataFrame) -> DataFrame:
    """target and n_links, without links to oneself."""
    return edges.filter("source <> target").groupBy("target").agg(F.count("*").alias("n_links"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target) whose ends are both in ``nodes`` (node)."""
    return edges.join(nodes.withColumnRenamed("node", "source"), "source", "left_semi").join(nodes.withColumnRenamed("node", "target"), "target", "left_semi")


def merged_pairs(edges: DataFrame) -> DataFrame:
    """One row for each linked pair: a, b, forward, backward and n_links.

    Edges with a column ``origin`` (bodyLink for a link in a text) and
    ``relationship`` also give typed, labels (of named relationships) and
    origins (of the rest), as sorted sets.
    """
    a, b = F.least("source", "target"), F.greatest("source", "target")
    more = []
    if {"origin", "relationship"} <= set(edges.columns):
        labels = F.array_sort(F.collect_set("relationship")).alias("labels")
        origins = F.array_sort(F.collect_set(F.when(F.col("relationship").isNull(), F.col("origin")))).alias("origins")
        more = [F.bool_or(F.col("origin") != BODY).alias("typed"), labels, origins]
    return edges.filter("source <> target").groupBy(a.alias("a"), b.alias("b")).agg(
        F.bool_or(F.col("source") <= F.col("target")).alias("forward"), F.bool_or(F.col("source") > F.col("target")).alias("backward"), F.count("*").alias("n_links"), *more
    )


def layers(resolved: DataFrame, shown: tuple[str, ...] = ("concepts",)) -> DataFrame:
    """Resolved links (source, raw_target, resolution, resolved_path) of the layers that are shown, with their target's node id.

    Layers are concepts, attachments, external and unresolved; descriptions are
    in none.  A target that is no document is a node of its own, named by its
    layer and path or text.
    """
    layer = (
        F.when(F.col("resolution") == "resolvedConcept", "concepts").when(F.col("resolution") == "resolvedAsset", "attachments")
        .when(F.col("resolution") == "external", "external").when(F.col("resolution").isin("unresolved", "invalid"), "unresolved")
    )
    target = F.when(layer == "concepts", F.col("resolved_path")).otherwise(F.concat(F.lit("/"), layer, F.lit(":"), F.coalesce("resolved_path", "raw_target")))
    return resolved.withColumns({"layer": layer, "target": target}).filter(F.col("layer").isin(*shown))


def degrees(edges: DataFrame) -> DataFrame:
    """node and degree: ends of edges at each node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node and distance (0 to ``hops``, at most 3) from the seeds (node), over links in either direction.

    Each hop joins the last ring with the links and drops what was reached before.
    """
    hops = min(max(hops, 1), 3)
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    reached = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    ring = reached
    for hop in range(1, hops + 1):
        next_ = ring.join(both, ring.node == both.source).select(F.col("target").alias("node")).distinct()
        ring = next_.join(reached, "node", "left_anti").withColumn("distance", F.lit(hop))
        reached = reached.unionByName(ring)
    return reached


def filtered(edges: DataFrame, nodes: DataFrame | None = None, origins: tuple[str, ...] = (), resolutions: tuple[str, ...] = (), relationships: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the given origins, resolutions and relationships, with both ends in ``nodes`` (node) where that is given."""
    for name, wanted in (("origin", origins), ("resolution", resolutions), ("relationship", relationships)):
        if wanted:
            edges = edges.filter(F.col(name).isin(*wanted))
    return edges if nodes is None else induced(edges, nodes)


def local_scene(resolved: DataFrame, seeds: DataFrame, hops: int, shown: tuple[str, ...] = ("concepts",)) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, distance) and edges (source, target, layer) around seeds (node), up to ``hops`` links (at most 3).

    Documents are reached over links between documents.  Edges run between one
    ring and the next, not within a ring.  Targets of other layers stand one
    link beyond the documents that are nearer than ``hops``.
    """
    hops = min(max(hops, 1), 3)
    every = layers(resolved, tuple({*shown, "concepts"}))
    between = every.filter("layer = 'concepts' and source <> target").select("source", "target", "layer")
    near = neighbourhood(between, seeds, hops)
    at = lambda name: near.select(F.col("node").alias(name), F.col("distance").alias(f"{name}_at"))
    rings = between.join(at("source"), "source").join(at("target"), "target").filter(F.abs(F.col("source_at") - F.col("target_at")) == 1)
    beyond = every.filter("layer <> 'concepts'").select("source", "target", "layer").join(at("source"), "source").filter(F.col("source_at") < hops)
    outer = beyond.groupBy(F.col("target").alias("node")).agg((F.min("source_at") + 1).cast("int").alias("distance"))
    return near.unionByName(outer), rings.select("source", "target", "layer").unionByName(beyond.select("source", "target", "layer"))


def numbered_nodes(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """node and name (n0, n1 ...) of concepts (node) and of targets that are no concepts, for renderers of one graph.

    Nodes are sorted over all tasks; each numbers its own, from how many nodes
    the tasks before it have.
    """
    ends = edges.select(F.col("target").alias("node")).join(concepts, "node", "left_anti").distinct().withColumn("virtual", F.lit(True))
    every = concepts.select("node").distinct().withColumn("virtual", F.lit(False)).unionByName(ends)
    # an id's upper bits number the task, the lower 33 the row in it
    placed = written(every.orderBy("virtual", "node").withColumn("__at", F.monotonically_increasing_id()), "node-numbers")
    task = F.shiftright("__at", 33)
    sizes = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a task
    starts = sizes.select("__task", before.alias("before"))
    number = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before")
    return placed.withColumn("__task", task).join(F.broadcast(starts), "__task").select("node", "virtual", F.concat(F.lit("n"), number.cast("string")).alias("name"))


def render(edges: DataFrame, concepts: DataFrame, form: str = "dot") -> str:
    """A graph of at most ``MAX_RENDERED`` nodes and links as DOT, Mermaid or JSON text; larger ones are refused."""
    if form not in ("dot", "mermaid", "json"):
        raise ValueError("form is dot, mermaid or json")
    if numbered_nodes(edges, concepts).limit(MAX_RENDERED + 1).count() > MAX_RENDERED or edges.select("source", "target").distinct().limit(MAX_RENDERED + 1).count() > MAX_RENDERED:
        raise ValueError(f"a rendered graph has at most {MAX_RENDERED} nodes and links")
    if form == "json":
        nodes = [{"id": r.name, "node": r.node, "virtual": r.virtual} for r in numbered_nodes(edges, concepts).collect()]
        names = {n["node"]: n["id"] for n in nodes}
        pairs = sorted({(names[r.source], names[r.target]) for r in edges.select("source", "target").distinct().collect()}, key=lambda x: (int(x[0][1:]), int(x[1][1:])))
        return json.dumps({"schema_version": 1, "nodes": sorted(nodes, key=lambda n: int(n["id"][1:])), "edges": [{"source": a, "target": b} for a, b in pairs]}, ensure_ascii=False)
    quote = lambda s: s.replace("\\", "\\\\").replace('"', '\\"' if form == "dot" else "#quot;").replace("\n", " ")
    names = {r.node: r.name for r in numbered_nodes(edges, concepts).collect()}
    links = sorted({(names[r.source], names[r.target]) for r in edges.select("source", "target").distinct().collect()}, key=lambda x: (int(x[0][1:]), int(x[1][1:])))
    if form == "dot":
        return "\n".join(["digraph {", *(f'  {n} [label="{quote(x)}"];' for x, n in names.items()), *(f"  {a} -> {b};" for a, b in links), "}"])
    return "\n".join(["graph LR", *(f'  {n}["{quote(x)}"]' for x, n in names.items()), *(f"  {a} --> {b}" for a, b in links)])
