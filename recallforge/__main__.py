"""Command line: python -m recallforge --data FOLDER COMMAND ... Results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recallforge.operators import report
from recallforge.sources.store import MemoryStore, NotFound, Recall, StoreError

_SHOWN = ("document", "memory", "record", "file")


def pair(text: str) -> tuple[str, str]:
    key, eq, value = text.partition("=")
    if not eq or not key:
        raise argparse.ArgumentTypeError(f"not key=value: {text}")
    return key, value


def vector(text: str) -> list[float]:
    try:
        return [float(x) for x in text.split(",")]
    except ValueError:
        raise argparse.ArgumentTypeError(f"not numbers: {text}") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="recallforge")
    p.add_argument("--data", required=True, help="folder of the store")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, /, *args: str, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for o, kind in options.items():
            flag = "--" + o.replace("_", "-")
            if kind is bool:
                c.add_argument(flag, action="store_true")
            elif kind is pair or isinstance(kind, list):
                c.add_argument(flag, type=kind[0] if isinstance(kind, list) else kind, action="append", default=[])
            else:
                c.add_argument(flag, type=kind)

    add("init"), add("stats"), add("inspect"), add("compact"), add("list-tenants")
    add("create-tenant", "tenant", name=str)
    add("create-collection", "tenant", "collection", description=str)
    add("put-document", "tenant", "collection", "id", "text", meta=pair, valid_from=int, valid_until=int, content_type=str)
    add("remember", "tenant", "collection", "id", "text", meta=pair, type=str, user=str, confidence=float, embedding=vector, supersedes=[str], contradicts=[str], valid_from=int, valid_until=int)
    add("put-record", "tenant", "collection", "table", "id", "payload", meta=pair)
    add("import-file", "tenant", "collection", "path")
    add("upload-records", "tenant", "collection", "path")
    add("recall", "tenant", "query", mode=str, top_k=int, collection=str, user=str, type=str, kind=str, meta=pair, as_of=int, min_score=float, include_superseded=bool, dedup_chunks=bool, mmr=bool)
    add("build-context", "tenant", "query", max_tokens=int, collection=str, no_related=bool)
    for kind in _SHOWN:
        add(f"show-{kind}", "tenant", "collection", "id", table=str)
        add(f"delete-{kind}", "tenant", "collection", "id", table=str)
    add("forget", "tenant", "collection", "id")
    add("rate-memory", "tenant", "collection", "id", "confidence")
    for kind in ("collection", "document", "memory", "record", "file", "edge", "prompt"):
        add({"memory": "list-memories"}.get(kind, f"list-{kind}s"), "tenant", collection=str, table=str, from_id=str)
    add("query", "tenant", "sql"), add("query-records", "tenant", "sql")
    add("add-edge", "tenant", "id", "from_kind", "from_id", "to_kind", "to_id", "relation", meta=pair)
    add("delete-edge", "tenant", "id")
    add("traverse", "tenant", hops=int, max_nodes=int, relation=str, seed=[str])
    add("audit", "tenant", start=int, end=int)
    add("compact-audit", records=int, bytes=int)
    add("eval-quality", "fixture")
    return p


def show(found) -> None:
    rows = found.toLocalIterator() if isinstance(found, DataFrame) else [] if found is None else [found]
    for r in rows:
        print(json.dumps(r.asDict(True) if hasattr(r, "asDict") else r, ensure_ascii=False, default=str))


def evaluate(db: MemoryStore, path: str) -> dict:
    """Run the cases of a fixture (version 1: memories, cases, thresholds) and judge them."""
    with open(path, encoding="utf-8") as f:
        fixture = json.load(f)
    if fixture.get("version") != 1:
        raise StoreError("a fixture of version 1 is required")
    db.create_tenant("quality"), db.create_collection("quality", "cases")
    db.remember_many("quality", "cases", [{"key": m["id"], "text": m["text"], "metadata": m.get("metadata", {}), "memory_type": "semantic"} for m in fixture["memories"]])
    ranked = None
    for c in fixture["cases"]:
        one = db.recall(Recall("quality", c["query"], top_k=5)).select(F.lit(c["name"]).alias("case"), "rank", "id", "text")
        ranked = one if ranked is None else ranked.unionByName(one)
    ranked = ranked.persist()
    spark = db.spark
    relevant = spark.createDataFrame([(c["name"], i) for c in fixture["cases"] for i in c["relevant_ids"]], "case string, id string")
    wanted = spark.createDataFrame([(c["name"], c.get("expected_first_ids", []), c.get("forbidden_first_ids", []), c.get("answer_must_include", [])) for c in fixture["cases"]], "case string, expected_first array<string>, forbidden_first array<string>, must_include array<string>")
    out = report.quality(ranked, relevant, 5).first().asDict()
    checks = [r.asDict() for r in report.case_checks(ranked, wanted).orderBy("case").collect()]
    ranked.unpersist()
    t = fixture.get("thresholds", {})
    enough = all(out[k] >= t.get(f"min_{k}", 0) - 1e-9 for k in ("hit_at_1", "hit_at_k", "mrr"))
    return out | {"checks": checks, "passed": enough and all(all(v for k, v in c.items() if k != "case") for c in checks)}


def run(db: MemoryStore, a: argparse.Namespace):
    c, meta = a.command, dict(getattr(a, "meta", []))
    given_id = None if getattr(a, "id", None) == "-" else getattr(a, "id", None)  # - asks for a new id
    given = lambda **names: {k: v for k, v in names.items() if v is not None}
    if c == "init":
        return {"path": db.path}
    if c == "stats":
        return db.stats()
    if c == "inspect":
        return report.tree(db.view("collection"))
    if c == "compact":
        return db.compact()
    if c == "list-tenants":
        return db.view("tenant").orderBy("seq")
    if c == "create-tenant":
        return db.create_tenant(a.tenant, a.name)
    if c == "create-collection":
        return db.create_collection(a.tenant, a.collection, a.description or "")
    if c == "put-document":
        return db.store_document(a.tenant, a.collection, given_id, a.text, metadata=meta, **given(valid_from=a.valid_from, valid_until=a.valid_until, content_type=a.content_type))
    if c == "remember":
        return db.remember(a.tenant, a.collection, given_id, a.text, metadata=meta, supersedes=a.supersedes, contradicts=a.contradicts, **given(memory_type=a.type, user_id=a.user, confidence=a.confidence, embedding=a.embedding, valid_from=a.valid_from, valid_until=a.valid_until))
    if c == "put-record":
        return db.put_record(a.tenant, a.collection, a.table, a.id, json.loads(a.payload), meta)
    if c == "import-file":
        return {"files": db.import_files(a.tenant, a.collection, a.path)}
    if c == "upload-records":
        return {"records": db.upload_records(a.tenant, a.collection, a.path)}
    if c == "recall":
        more = given(mode=a.mode, top_k=a.top_k, collection=a.collection, user=a.user, memory_type=a.type, kind=a.kind, as_of=a.as_of, min_score=a.min_score)
        found = db.search(Recall(a.tenant, a.query, metadata=meta, include_superseded=a.include_superseded, dedup_chunks=a.dedup_chunks, mmr=a.mmr, **more))
        return found.select("rank", "kind", "id", "document_id", "text", "score", "reason", "matched_terms")
    if c == "build-context":
        return db.build_context(a.tenant, a.query, a.max_tokens or 2048, a.collection, not a.no_related)
    if c.startswith("show-"):
        found = db.get(c[5:], a.tenant, a.collection, a.id, a.table)
        if found is None:
            raise NotFound(f"{c[5:]} {a.id}")
        return found
    if c == "delete-edge":
        return db.delete("edge", a.tenant, None, a.id)
    if c.startswith("delete-"):
        return db.delete(c[7:], a.tenant, a.collection, a.id, a.table)
    if c == "forget":
        return db.forget(a.tenant, a.collection, a.id)
    if c == "rate-memory":
        return db.rate_memory(a.tenant, a.collection, a.id, float(a.confidence))
    if c == "list-prompts":
        return db.prompts(a.tenant)
    if c.startswith("list-"):
        return db.list({"memories": "memory"}.get(c[5:], c[5:].rstrip("s")), a.tenant, a.collection, a.table, a.from_id)
    if c in ("query", "query-records"):
        if c == "query-records" and not a.sql.lower().startswith("select * from records"):
            raise StoreError("only SELECT * FROM records is known here")
        return db.execute_sql(a.tenant, a.sql)
    if c == "add-edge":
        return db.add_edge(a.tenant, a.id, a.from_kind, a.from_id, a.to_kind, a.to_id, a.relation, meta)
    if c == "traverse":
        return db.traverse(a.tenant, a.seed, a.hops or 2, a.max_nodes or 50, a.relation)
    if c == "audit":
        return db.query_audit(a.tenant, a.start, a.end)
    if c == "compact-audit":
        return db.compact_audit(a.records, a.bytes)
    return evaluate(db, a.fixture)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    from recallforge.plans.session import ship

    spark = spark or SparkSession.builder.appName("recallforge").getOrCreate()
    ship(spark)
    try:
        show(run(MemoryStore(spark, a.data), a))
    except (StoreError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
