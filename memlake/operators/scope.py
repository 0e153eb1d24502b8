"""Which chunks a caller may see: one predicate for every lane of a search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """A caller and what they ask for.  Without a workspace nothing is checked for visibility."""

    workspace_id: str | None = None
    user_id: str | None = None
    org_ids: tuple[str, ...] = ()
    repo: str | None = None
    source_type: str | None = None
    scope_key: str | None = None
    categories: tuple[str, ...] = ()
    project_id: str | None = None
    include_reference: bool = False
    reference_only: bool = False
    extra: tuple[Column, ...] = field(default=(), compare=False)


def visible(scope: Scope) -> Column:
    """Public rows, those of the caller's organisations, and the caller's own private ones."""
    out = F.col("visibility") == "public"
    if scope.org_ids:
        out |= (F.col("visibility") == "org") & F.col("org_id").isin(*scope.org_ids)
    if scope.user_id is not None:
        out |= (F.col("visibility") == "private") & (F.col("user_id") == scope.user_id)
    return F.coalesce(out, F.lit(False))


def scoped(chunks: DataFrame, scope: Scope, links: DataFrame | None = None) -> DataFrame:
    """Rows of `chunks` (joined with their sources' attributes) in a scope; filters reach the scan."""
    keep = F.col("is_active")
    if scope.workspace_id is not None:
        keep &= visible(scope)
    for name in ("repo", "source_type", "scope_key"):
        if (value := getattr(scope, name)) is not None:
            keep &= F.col(name) == value
    if scope.categories:
        wanted = F.array(*(F.lit(c.strip().lower()) for c in scope.categories))
        keep &= F.arrays_overlap(F.transform("labels", lambda x: F.lower(F.trim(x))), wanted)
    for column in scope.extra:
        keep &= column
    df = chunks.where(keep)
    if scope.reference_only:
        return df.where(F.col("source_class") == "reference")
    if scope.include_reference:
        return df
    if scope.project_id is None or links is None:
        return df.where(F.col("source_class") != "reference")
    own = links.where(F.col("project_id") == scope.project_id)
    if scope.workspace_id is not None:
        own = own.where(F.col("workspace_id") == scope.workspace_id)
    linked = own.select("chunk_id", F.lit(True).alias("memlake_linked")).distinct()
    return df.join(linked, "chunk_id", "left").where((F.col("source_class") != "reference") | F.coalesce("memlake_linked", F.lit(False))).drop("memlake_linked")


_COMPARE = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(*v), "$nin": lambda c, v: ~c.isin(*v)}


def metadata_filter(where: dict) -> Column:
    """A nested document of $and, $or and comparisons as a predicate; absent metadata are empty strings."""
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [metadata_filter(x) for x in value]
            joined = inner[0]
            for x in inner[1:]:
                joined = joined & x if key == "$and" else joined | x
            parts.append(joined)
        else:
            for op, operand in (value if isinstance(value, dict) else {"$eq": value}).items():
                parts.append(_COMPARE[op](F.coalesce(F.col(key), F.lit("")) if isinstance(operand, (str, list)) else F.col(key), operand))
    out = parts[0]
    for x in parts[1:]:
        out = out & x
    return out
