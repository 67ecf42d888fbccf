"""Predicates of retrieval and listing, as one Column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """tenant is mandatory; the rest narrows down. A null user never matches; only memories have a type."""

    tenant: str
    collection: str | None = None
    user: str | None = None
    memory_type: str | None = None
    kind: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    as_of: int | None = None
    include_superseded: bool = False

    def column(self) -> Column:
        if not self.tenant or not self.tenant.strip():
            raise ValueError("a tenant is required")
        out = F.col("tenant_id") == self.tenant
        for name, value in (("collection", self.collection), ("user_id", self.user), ("memory_type", self.memory_type), ("kind", self.kind)):
            if value is not None:
                out = out & F.coalesce(F.col(name) == value, F.lit(False))
        for key, value in self.metadata.items():
            out = out & metadata_is(F.col("metadata"), key, value)
        if self.as_of is not None:
            out = out & valid_at(F.lit(self.as_of))
        return out if self.include_superseded else out & F.col("superseded_by").isNull()


def metadata_is(metadata: Column, key: str, value: str) -> Column:
    """A missing key is no match."""
    return F.coalesce(metadata[key] == value, F.lit(False))


def valid_at(at: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open window [start, end); null has no bound."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at))
