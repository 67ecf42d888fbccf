"""Audit ranges and retention, statistics, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def audit_range(audit: DataFrame, tenant: str, start: int | None = None, end: int | None = None, time: str = "ts") -> DataFrame:
    """Records of the tenant between start and end, both included."""
    if not tenant.strip():
        raise ValueError("a tenant is required")
    if start is not None and end is not None and start > end:
        raise ValueError("the range ends before it begins")
    out = audit.where(F.col("tenant_id") == tenant)
    out = out if start is None else out.where(F.col(time) >= start)
    return out if end is None else out.where(F.col(time) <= end)


def retained(audit: DataFrame, records: int | None = None, size: int | None = None, seq: str = "seq", body: str = "body") -> DataFrame:
    """The newest records that keep to both limits, a contiguous suffix; a line counts its bytes and one line feed. None or 0 is no limit.

    The suffix is found by slices of seq: sizes are summed for each slice, whole slices are kept from the newest
    on, and only the slice in which a limit falls is sorted. No global sort, whatever the length of the log.
    """
    if not records and not size:
        return audit
    bounds = audit.agg(F.min(seq), F.max(seq)).first()
    if bounds[0] is None:
        return audit
    slices = 1024
    width = max(1, -(-(bounds[1] - bounds[0] + 1) // slices))
    weighed = audit.withColumn("_slice", ((F.col(seq) - bounds[0]) / width).cast("long")).withColumn("_bytes", F.octet_length(body) + 1)
    sums = {r[0]: (r[1], r[2]) for r in weighed.groupBy("_slice").agg(F.count("*"), F.sum("_bytes")).collect()}  # at most 1024 rows
    n = used = 0
    edge = -1
    for s in sorted(sums, reverse=True):
        if records and n + sums[s][0] > records or size and used + sums[s][1] > size:
            edge = s
            break
        n, used = n + sums[s][0], used + sums[s][1]
    if edge < 0:
        return audit
    w = Window.partitionBy("_slice").orderBy(F.desc(seq)).rowsBetween(Window.unboundedPreceding, 0)
    inside = weighed.where(F.col("_slice") == edge).withColumn("_n", F.count("*").over(w) + n).withColumn("_used", F.sum("_bytes").over(w) + used)
    ok = F.lit(True)
    if records:
        ok = ok & (F.col("_n") <= records)
    if size:
        ok = ok & (F.col("_used") <= size)
    return weighed.where(F.col("_slice") > edge).select(*audit.columns).unionByName(inside.where(ok).select(*audit.columns))


def audit_stats(audit: DataFrame, body: str = "body") -> DataFrame:
    return audit.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.octet_length(body) + 1), F.lit(0)).alias("bytes"))


def table_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("tenant_id", "collection", "table").agg(F.count("*").alias("records"))


def counts(**tables: DataFrame) -> DataFrame:
    """(entity, rows) of each table, in one plan."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("entity"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def tree(collections: DataFrame) -> DataFrame:
    """Each tenant with its collections, sorted."""
    return collections.groupBy("tenant_id").agg(F.array_sort(F.collect_set("collection")).alias("collections"))


def quality(ranked: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """Cases, hit@1, hit@k and MRR. ranked: case, rank, id; relevant: case, id, a row for each relevant item."""
    hits = ranked.where(F.col("rank") <= k).join(relevant, ["case", "id"]).groupBy("case").agg(F.min("rank").alias("first"))
    cases = relevant.select("case").distinct().join(hits, "case", "left")
    share = lambda c: F.avg(F.coalesce(c.cast("double"), F.lit(0.0)))
    return cases.agg(F.count("*").alias("cases"), share(F.col("first") == 1).alias("hit_at_1"), share(F.col("first") <= k).alias("hit_at_k"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def case_checks(ranked: DataFrame, cases: DataFrame) -> DataFrame:
    """For each case: first_ok, not_forbidden and answer_ok. ranked: case, rank, id, text; cases: case and arrays expected_first, forbidden_first, must_include."""
    seen = ranked.groupBy("case").agg(F.min_by("id", "rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("all"))
    body = F.lower(F.array_join(F.transform("all", lambda x: x["text"]), "\n"))
    joined = cases.join(seen, "case", "left").withColumn("body", F.coalesce(body, F.lit("")))
    first_ok = (F.size("expected_first") == 0) | F.coalesce(F.array_contains("expected_first", F.col("first")), F.lit(False))
    forbidden: Column = F.coalesce(F.array_contains("forbidden_first", F.col("first")), F.lit(False))
    answer = F.forall("must_include", lambda t: F.contains(F.col("body"), F.lower(t)))
    return joined.select("case", first_ok.alias("first_ok"), (~forbidden).alias("not_forbidden"), answer.alias("answer_ok"))
