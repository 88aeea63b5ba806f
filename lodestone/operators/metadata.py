"""Exact queries over document metadata: filter, project, order, page, group."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_text, utf16_key

COLUMNS = ("title", "description", "type", "status", "effective_status", "tags", "resource")
DEFAULT_COLUMNS = ("title", "type", "effective_status")
SORT_FIELDS = ("title", "type", "effective_status", "id", "path")
GROUP_FIELDS = ("type", "effective_status")
LIST_KEYS = ("types", "tags", "required_tags", "statuses", "path_prefixes")
TEXT_KEYS = ("title_contains", "description_contains")
MAX_PAGE = 1000


class QueryError(ValueError):
    """A query that names unknown keys, columns or values."""


def effective_status() -> Column:
    """``status`` where the document has one, even a null one, else ``stable``."""
    return F.when(F.col("has_status"), F.col("status")).otherwise("stable")


@dataclass(frozen=True)
class Query:
    """A checked query.  Values of one field are alternatives, fields must all hold."""

    where: dict = field(default_factory=dict)
    select: tuple[str, ...] = DEFAULT_COLUMNS
    order_by: tuple[tuple[str, bool], ...] = ()
    group_by: str | None = None

    @classmethod
    def parse(cls, spec: dict) -> Query:
        """Check a query given as JSON-like values and bring it to its normal form."""
        _known(spec, {"where", "select", "order_by", "group_by"})
        where = spec.get("where", {})
        _known(where, {*LIST_KEYS, *TEXT_KEYS})
        checked: dict = {}
        for key, value in where.items():
            values = [value] if key in TEXT_KEYS else value
            if not isinstance(values, (list, tuple)) or any(not isinstance(v, str) or not v.strip() for v in values):
                raise QueryError(f"{key} takes text that is not blank")
            if len(set(values)) != len(values):
                raise QueryError(f"{key} names a value twice")
            if values:
                checked[key] = value if key in TEXT_KEYS else tuple(sorted(values))
        group = spec.get("group_by")
        if group is not None and (group not in GROUP_FIELDS or "select" in spec or "order_by" in spec):
            raise QueryError("group_by is type or effective_status, without select and order_by")
        select = tuple(spec.get("select", DEFAULT_COLUMNS))
        if not select or set(select) - set(COLUMNS) or len(set(select)) != len(select):
            raise QueryError(f"select takes columns of {COLUMNS}")
        order = []
        for item in spec.get("order_by", []):
            _known(item, {"field", "direction"})
            if item.get("field") not in SORT_FIELDS or item.get("direction", "asc") not in ("asc", "desc"):
                raise QueryError("order_by takes a sortable field, and asc or desc")
            order.append((item["field"], item.get("direction") == "desc"))
        return cls(checked, select, tuple(order), group)


def _known(given: object, keys: set[str]) -> None:
    if not isinstance(given, dict) or set(given) - keys:
        raise QueryError(f"only the keys {sorted(keys)} are known")


def within(prefix: str, id_: Column) -> Column:
    """Whether a document is ``prefix`` itself or lies below it."""
    prefix = prefix.rstrip("/")
    return (id_ == prefix) | id_.startswith(prefix + "/")


def predicate(where: dict) -> Column:
    """The filter of a checked ``where``; documents that lack a field do not match it."""
    parts = []
    if "types" in where:
        parts.append(F.col("type").isin(*where["types"]))
    if "tags" in where:
        parts.append(F.arrays_overlap("tags", F.array(*map(F.lit, where["tags"]))))
    if "required_tags" in where:
        parts.append(F.size(F.array_except(F.array(*map(F.lit, where["required_tags"])), "tags")) == 0)
    if "statuses" in where:
        parts.append(effective_status().isin(*where["statuses"]))
    if "path_prefixes" in where:
        parts.append(reduce(or_, (within(p, F.col("id")) for p in where["path_prefixes"])))
    for key in TEXT_KEYS:
        if key in where:
            parts.append(contains_text(F.col(key.removesuffix("_contains")), where[key]))
    return F.coalesce(reduce(and_, parts, F.lit(True)), F.lit(False))


def matching(concepts: DataFrame, query: Query) -> DataFrame:
    """Documents that a query's filter allows."""
    return concepts.filter(predicate(query.where))


def ordering(query: Query) -> list[Column]:
    """Sort keys by UTF-16 units; missing values are last either way, ties go by bundle and id."""
    keys = []
    for name, down in query.order_by:
        key = utf16_key(effective_status() if name == "effective_status" else F.col(name))
        keys.append(key.desc_nulls_last() if down else key.asc_nulls_last())
    return [*keys, utf16_key(F.col("bundle")).asc(), utf16_key(F.col("id")).asc()]


def page(concepts: DataFrame, query: Query, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of a query: bundle, id, path and the selected columns, or group and count."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise QueryError(f"limit is 1 to {MAX_PAGE} and offset not negative")
    found = matching(concepts, query)
    if query.group_by:
        return group_counts(found, query.group_by).orderBy(F.col("key").asc_nulls_last()).offset(offset).limit(limit)
    chosen = [effective_status().alias(c) if c == "effective_status" else F.col(c) for c in query.select]
    return found.orderBy(*ordering(query)).offset(offset).limit(limit).select("bundle", "id", "path", *chosen)


def group_counts(found: DataFrame, by: str) -> DataFrame:
    """key and count by type or effective status."""
    return found.groupBy((effective_status() if by == "effective_status" else F.col(by)).alias("key")).agg(F.count("*").alias("count"))


def page_summary(concepts: DataFrame, query: Query, offset: int = 0, limit: int = 100) -> DataFrame:
    """total, group_total, returned and has_more of a page, in one row."""
    found = matching(concepts, query)
    groups = F.count_distinct(F.struct(effective_status() if query.group_by == "effective_status" else F.col(query.group_by or "type"))) if query.group_by else F.lit(None).cast("long")
    rows = F.col("group_total") if query.group_by else F.col("total")
    left = F.greatest(rows - offset, F.lit(0))
    return found.agg(F.count("*").alias("total"), groups.alias("group_total")).select("total", "group_total", F.least(left, F.lit(limit)).cast("long").alias("returned"), (left > limit).alias("has_more"))


def trust_tier(verified: Column) -> Column:
    """unverified, machine-confirmed or human-reviewed, by who verified (array of struct with ``by``)."""
    return (
        F.when(F.coalesce(F.size(verified), F.lit(0)) <= 0, "unverified")
        .when(F.exists(verified, lambda v: F.coalesce(v["by"].startswith("human:"), F.lit(False))), "human-reviewed")
        .otherwise("machine-confirmed")
    )


def is_stale(stale_after: Column, as_of: Column) -> Column:
    """Whether the time to review has come; unreadable or missing times never come."""
    return F.coalesce(as_of >= F.try_to_timestamp(stale_after), F.lit(False))


def current(as_of: Column) -> Column:
    """Neither deprecated nor stale."""
    return ~effective_status().eqNullSafe(F.lit("deprecated")) & ~is_stale(F.col("stale_after"), as_of)
