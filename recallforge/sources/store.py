"""The store: tenants, documents, memories, records, files, edges and prompts as states of an append-only operation log.

The log is a Parquet folder of generations. An operation is a row (seq, ts, op, kind, identity, body as JSON); a batch of them is one
append, committed as a whole. The state of a kind is the last write of each identity that is no deletion; seq is the insertion order wherever order
matters. Compaction writes the live rows as the next generation, which counts once it is complete. One writer at a time.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession, Window
from pyspark.sql import functions as F

from recallforge.functions import text as T
from recallforge.functions.vector import embed, with_hash_embedding
from recallforge.operators import context, graph, minisql, report, retrieve, state
from recallforge.operators.filters import Filter
from recallforge.sources import ingest


class StoreError(ValueError):
    """A request that the store refuses."""


class NotFound(StoreError):
    """Something a request names does not exist."""


_SOURCE = "struct<label:string,uri:string,title:string>"
OPS = "seq long, ts long, op string, kind string, tenant_id string, collection string, `table` string, id string, body string"
IDENTITY = ("kind", "tenant_id", "collection", "table", "id")
#: Fields of each kind besides its identity.
BODIES = {
    "tenant": "name string, created_at long",
    "collection": "description string, created_at long",
    "document": f"text string, metadata map<string,string>, source {_SOURCE}, created_at long, updated_at long, version long, valid_from long, valid_until long",
    "chunk": "document_id string, ordinal int, text string, embedding array<float>",
    "memory": f"text string, embedding array<float>, metadata map<string,string>, source {_SOURCE}, user_id string, memory_type string, created_at long, valid_from long, valid_until long, supersedes array<string>, contradicts array<string>, superseded_by string, confidence double",
    "record": f"payload string, projection string, embedding array<float>, metadata map<string,string>, source {_SOURCE}, created_at long, updated_at long, version long",
    "file": f"path string, name string, media_type string, checksum string, size_bytes long, document_id string, metadata map<string,string>, source {_SOURCE}, created_at long, updated_at long, version long",
    "edge": "from_id string, from_kind string, to_id string, to_kind string, relation string, metadata map<string,string>, created_at long, updated_at long",
    "prompt": "name string, description string, content string, created_at long, updated_at long",
}
MEMORY_TYPES = ("episodic", "semantic", "procedural", "note")
ITEM_KINDS = ("document", "chunk", "memory", "record")
AUDIT = "seq long, tenant_id string, ts long, query string, used long, body string"


@dataclass(frozen=True)
class Config:
    chunk_tokens: int = T.CHUNK_TOKENS
    auto_compact_ops: int = 1000
    auto_compact_bytes: int = 8 << 20
    decay_weight: float = 0.0
    decay_days: float = 30.0
    connectivity_weight: float = 0.0
    audit_records: int | None = None
    audit_bytes: int | None = None


@dataclass(frozen=True)
class Recall:
    tenant: str
    query: str = ""
    mode: str = "hybrid"
    embedding: list[float] | None = None
    top_k: int = 10
    collection: str | None = None
    user: str | None = None
    memory_type: str | None = None
    kind: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
    as_of: int | None = None
    include_superseded: bool = False
    min_score: float | None = None
    dedup_chunks: bool = False
    mmr: bool = False
    mmr_lambda: float = 0.5


def _text(name: str, value: str | None) -> str:
    if not value or not value.strip():
        raise StoreError(f"{name} must not be blank")
    return value


class MemoryStore:
    def __init__(self, spark: SparkSession, path: str, config: Config = Config(), now=lambda: int(time.time() * 1000)):
        context.check_weight("decay weight", config.decay_weight)
        context.check_weight("connectivity weight", config.connectivity_weight)
        self.spark, self.path, self.config, self.now = spark, path.rstrip("/"), config, now
        self.generation, self._audits = (max([0, *self._complete(what)]) for what in ("ops", "audit"))
        self._seq = self.ops().agg(F.max("seq")).first()[0] or 0
        self._since = self._bytes = self._ids = 0
        self._audit_seq: int | None = None

    # ------------------------------------------------------------------------------------ the log

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _complete(self, what: str) -> list[int]:
        """Numbers of the generations of ops or audit that are complete."""
        fs, p = self._fs(f"{self.path}/{what}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        done = [n for n in names if n.startswith("gen=") and fs.exists(self._fs(f"{self.path}/{what}/{n}/_SUCCESS")[1])]
        return [int(n[4:]) for n in done]

    def new_id(self, prefix: str) -> str:
        """prefix, the time in milliseconds and a counter."""
        self._ids += 1
        return f"{prefix}-{self.now()}-{self._ids}"

    def ops(self) -> DataFrame:
        """Every operation of the present generation."""
        folder = f"{self.path}/ops/gen={self.generation}"
        fs, p = self._fs(folder)
        return self.spark.read.schema(OPS).parquet(folder) if fs.exists(p) else self.spark.createDataFrame([], OPS)

    def _commit(self, rows: list[tuple]) -> None:
        """(op, kind, tenant, collection, table, id, body) rows as one append."""
        if not rows:
            return
        now, first = self.now(), self._seq + 1
        data = [(first + i, now, op, kind, t, c, tb, key, json.dumps(body) if body is not None else None) for i, (op, kind, t, c, tb, key, body) in enumerate(rows)]
        self.spark.createDataFrame(data, OPS).coalesce(1).write.mode("append").parquet(f"{self.path}/ops/gen={self.generation}")
        self._grown(len(rows), len(rows), sum(len(r[-1] or "") for r in data))

    def commit_frame(self, rows: DataFrame) -> int:
        """A batch of puts or deletes as a DataFrame (op, kind, tenant_id, collection, table, id, body), one append; how many there were. Numbers may have gaps."""
        numbered = rows.withColumn("seq", F.monotonically_increasing_id() + self._seq + 1).withColumn("ts", F.lit(self.now()))
        path = f"{self.path}/ops/gen={self.generation}"
        seen = Observation()
        numbered.select("seq", "ts", "op", *IDENTITY, "body").observe(seen, F.count("*").alias("n"), F.max("seq").alias("last"), F.sum(F.octet_length("body")).alias("size")).write.mode("append").parquet(path)
        got = seen.get
        self._grown(got["n"], (got["last"] or self._seq) - self._seq, got["size"] or 0)
        return got["n"]

    def _grown(self, rows: int, numbers: int, size: int) -> None:
        self._seq, self._since, self._bytes = self._seq + numbers, self._since + rows, self._bytes + size
        limits = ((self.config.auto_compact_ops, self._since), (self.config.auto_compact_bytes, self._bytes))
        if any(limit and now >= limit for limit, now in limits):
            self.compact()

    def compact(self) -> None:
        """The live rows as the next generation; older ones are deleted when it is complete."""
        live = self._live()
        live.write.mode("overwrite").parquet(f"{self.path}/ops/gen={self.generation + 1}")
        old, self.generation, self._since, self._bytes = self.generation, self.generation + 1, 0, 0
        fs, p = self._fs(f"{self.path}/ops/gen={old}")
        fs.delete(p, True)

    def _live(self) -> DataFrame:
        return state.live(self.ops(), *IDENTITY).select("seq", "ts", "op", *IDENTITY, "body")

    def view(self, kind: str) -> DataFrame:
        """The live entities of a kind, with seq as their insertion order."""
        mine = state.live(self.ops().where(F.col("kind") == kind), *IDENTITY)
        return mine.select("seq", "tenant_id", "collection", "table", "id", F.from_json("body", BODIES[kind]).alias("b")).select("seq", "tenant_id", "collection", "table", "id", "b.*")

    # ------------------------------------------------------------------------------------ reading

    def get(self, kind: str, tenant: str, collection: str | None, key: str, table: str | None = None) -> Row | None:
        row = self.view(kind).where((F.col("tenant_id") == tenant) & F.col("collection").eqNullSafe(F.lit(collection)) & F.col("table").eqNullSafe(F.lit(table)) & (F.col("id") == key))
        return row.first()

    def list(self, kind: str, tenant: str, collection: str | None = None, table: str | None = None, from_id: str | None = None) -> DataFrame:
        out = self.view(kind).where(F.col("tenant_id") == tenant)
        for name, value in (("collection", collection), ("table", table), ("from_id", from_id)):
            out = out if value is None else out.where(F.col(name) == value)
        return out.orderBy("seq")

    def prompts(self, tenant: str) -> DataFrame:
        return self.view("prompt").where((F.col("tenant_id") == tenant) | F.col("tenant_id").isNull()).orderBy("seq")

    def chunks_of(self, tenant: str, collection: str, document: str) -> DataFrame:
        return self.list("chunk", tenant, collection).where(F.col("document_id") == document).orderBy("ordinal")

    def _need(self, kind: str, tenant: str, collection: str | None = None) -> None:
        if kind == "tenant" and self.get("tenant", tenant, None, tenant) is None:
            raise NotFound(f"tenant {tenant}")
        if kind == "collection" and self.get("collection", tenant, collection, collection) is None:
            raise NotFound(f"collection {collection}")

    def entries(self) -> DataFrame:
        """The searchable rows: chunks with what their document says, memories, and records by their projection."""
        null = lambda t: F.lit(None).cast(t)
        docs = self.view("document").select("tenant_id", "collection", F.col("id").alias("document_id"), "metadata", "source", "valid_from", "valid_until", F.col("updated_at").alias("touched"))
        none = F.array().cast("array<string>")
        chunk = self.view("chunk").drop("metadata").join(docs, ["tenant_id", "collection", "document_id"])
        chunk = chunk.select(F.lit("document_chunk").alias("kind"), "tenant_id", "collection", null("string").alias("table"), "id", "document_id", "text", "embedding", "metadata", "source", null("string").alias("user_id"), null("string").alias("memory_type"), "valid_from", "valid_until", null("string").alias("superseded_by"), none.alias("contradicts"), null("double").alias("confidence"), "touched")
        memory = self.view("memory").select(F.lit("memory").alias("kind"), "tenant_id", "collection", null("string").alias("table"), "id", null("string").alias("document_id"), "text", "embedding", "metadata", "source", "user_id", "memory_type", "valid_from", "valid_until", "superseded_by", F.coalesce("contradicts", none).alias("contradicts"), "confidence", F.col("created_at").alias("touched"))
        record = self.view("record").select(F.lit("record").alias("kind"), "tenant_id", "collection", "table", "id", null("string").alias("document_id"), F.col("projection").alias("text"), "embedding", "metadata", "source", null("string").alias("user_id"), null("string").alias("memory_type"), null("long").alias("valid_from"), null("long").alias("valid_until"), null("string").alias("superseded_by"), none.alias("contradicts"), null("double").alias("confidence"), F.col("updated_at").alias("touched"))
        whole = chunk.unionByName(memory).unionByName(record).withColumn("key", F.concat_ws("\u0001", "kind", "tenant_id", "collection", F.coalesce("table", F.lit("")), "id"))
        made = with_hash_embedding(whole.withColumnRenamed("embedding", "given"))
        return made.withColumn("embedding", F.when(F.size("given") > 0, F.col("given")).otherwise(F.col("embedding"))).drop("given", "slots")

    # ------------------------------------------------------------------------------------ writing

    def create_tenant(self, tenant: str, name: str | None = None) -> Row:
        """The tenant; an existing one is returned as it is."""
        _text("tenant", tenant)
        if self.get("tenant", tenant, None, tenant) is None:
            self._commit([("put", "tenant", tenant, None, None, tenant, {"name": name or tenant, "created_at": self.now()})])
        return self.get("tenant", tenant, None, tenant)

    def create_collection(self, tenant: str, name: str, description: str = "") -> Row:
        _text("collection", name)
        self._need("tenant", tenant)
        if self.get("collection", tenant, name, name) is None:
            self._commit([("put", "collection", tenant, name, None, name, {"description": description, "created_at": self.now()})])
        return self.get("collection", tenant, name, name)

    def _document_rows(self, tenant: str, collection: str, key: str, text: str, old: Row | None, stale: list[str], chunks=None, content_type: str | None = None, **more) -> list[tuple]:
        _text("id", key), _text("text", text)
        now = self.now()
        if chunks is not None:
            if any(not t.strip() or not e for t, e in chunks):
                raise StoreError("a chunk needs a text and an embedding")
            parts = [(t, list(e)) for t, e in chunks]
        else:
            language = None
            if content_type and content_type.split(";")[0].strip().lower().startswith(("text/x-", "application/x-")):
                language = content_type.split(";")[0].strip().lower().split("/x-", 1)[1]
            parts = [(t, None) for t in ingest.code_chunks(text, language or "", self.config.chunk_tokens)]
        body = {"text": text, "created_at": old.created_at if old else now, "updated_at": now, "version": old.version + 1 if old else 1, **more}
        rows = [("put", "document", tenant, collection, None, key, body)]
        fresh = [f"{key}#{i}" for i in range(len(parts))]
        rows += [("delete", "chunk", tenant, collection, None, c, None) for c in stale if c not in set(fresh)]
        rows += [("put", "chunk", tenant, collection, None, c, {"document_id": key, "ordinal": i, "text": t, "embedding": e}) for i, (c, (t, e)) in enumerate(zip(fresh, parts))]
        return rows

    def store_document(self, tenant: str, collection: str, key: str | None, text: str, **more) -> Row:
        """Upsert (a new id without a key): created_at stays, version grows, all chunks are replaced. more: metadata, source, valid_from, valid_until, chunks [(text, embedding)], content_type."""
        self._need("collection", tenant, collection)
        key = key or self.new_id("doc")
        stale = [r.id for r in self.chunks_of(tenant, collection, key).select("id").collect()]
        self._commit(self._document_rows(tenant, collection, key, text, self.get("document", tenant, collection, key), stale, **more))
        self._prune(tenant)
        return self.get("document", tenant, collection, key)

    def store_documents(self, tenant: str, collection: str, items: list[dict]) -> int:
        """Several documents in one append."""
        self._need("collection", tenant, collection)
        known = {r.id: r for r in self.list("document", tenant, collection).where(F.col("id").isin([i["key"] for i in items])).collect()}
        old_chunks: dict[str, list[str]] = {}
        for r in self.list("chunk", tenant, collection).where(F.col("document_id").isin(list(known) or [""])).select("id", "document_id").collect():
            old_chunks.setdefault(r.document_id, []).append(r.id)
        rows = [row for i in items for row in self._document_rows(tenant, collection, old=known.get(i["key"]), stale=old_chunks.get(i["key"], []), **i)]
        self._commit(rows)
        self._prune(tenant)
        return len(items)

    def _memory_body(self, text: str, old: Row | None, memory_type: str = "note", confidence: float | None = None, embedding=None, supersedes=(), contradicts=(), **more) -> dict:
        _text("text", text)
        if memory_type.lower() not in MEMORY_TYPES:
            raise StoreError(f"unknown memory type: {memory_type}")
        if confidence is not None and not 0 <= confidence <= 1:
            raise StoreError("confidence must lie between 0 and 1")
        if embedding is not None and not len(embedding):
            raise StoreError("an embedding must not be empty")
        return {"text": text, "memory_type": memory_type.lower(), "confidence": confidence, "embedding": embedding, "supersedes": list(supersedes), "contradicts": list(contradicts), "created_at": old.created_at if old else self.now(), **more}

    def remember_many(self, tenant: str, collection: str, items: list[dict]) -> list[str]:
        """Memories (key, text, and what _memory_body takes) in one append; those they supersede are written again with the mark. One without a key gets a new id."""
        self._need("collection", tenant, collection)
        named = {k for i in items for k in (*i.get("supersedes", ()), *i.get("contradicts", ()))}
        items = [i if i.get("key") else i | {"key": self.new_id("mem")} for i in items]
        keys = [_text("id", i["key"]) for i in items]
        mine = {}
        for r in self.list("memory", tenant).where(F.col("id").isin(sorted(named | set(keys)) or [""])).collect():
            mine.setdefault(r.id, r)
            if r.collection == collection:
                mine[r.id] = r
        if named - set(mine):
            raise NotFound(f"memories {sorted(named - set(mine))}")
        rows = []
        for i in items:
            more = {k: v for k, v in i.items() if k not in ("key", "text")}
            old = mine.get(i["key"])
            body = self._memory_body(i["text"], old if old and old.collection == collection else None, **more)
            rows.append(("put", "memory", tenant, collection, None, i["key"], body))
            for k in i.get("supersedes", ()):
                r = mine[k].asDict(True)
                rows.append(("put", "memory", tenant, r["collection"], None, k, {f: v for f, v in r.items() if f not in ("seq", "tenant_id", "collection", "table", "id")} | {"superseded_by": i["key"]}))
        self._commit(rows)
        return keys

    def remember(self, tenant: str, collection: str, key: str | None, text: str, **more) -> Row:
        [key] = self.remember_many(tenant, collection, [{"key": key, "text": text, **more}])
        return self.get("memory", tenant, collection, key)

    def rate_memory(self, tenant: str, collection: str, key: str, confidence: float) -> None:
        if not 0 <= confidence <= 1:
            raise StoreError("confidence must lie between 0 and 1")
        old = self.get("memory", tenant, collection, key)
        if old is None:
            raise NotFound(f"memory {key}")
        body = {f: v for f, v in old.asDict(True).items() if f not in ("seq", "tenant_id", "collection", "table", "id")}
        self._commit([("put", "memory", tenant, collection, None, key, body | {"confidence": confidence})])

    def put_record(self, tenant: str, collection: str, table: str, key: str, payload: dict, metadata: dict | None = None, embedding=None, source: dict | None = None) -> Row:
        if not isinstance(payload, dict):
            raise StoreError("a payload is a JSON object")
        _text("table", table), _text("id", key)
        self._need("collection", tenant, collection)
        old, text = self.get("record", tenant, collection, key, table), json.dumps(payload)
        words = " ".join(x for x in ("table", table, "record", key, ingest.json_words(text)) if x)
        body = {"payload": text, "projection": words, "embedding": embedding, "metadata": metadata or {}, "source": source, "created_at": old.created_at if old else self.now(), "updated_at": self.now(), "version": old.version + 1 if old else 1}
        self._commit([("put", "record", tenant, collection, table, key, body)])
        return self.get("record", tenant, collection, key, table)

    def import_files(self, tenant: str, collection: str, path: str, pdf=None) -> int:
        """Text, Markdown, CSV and JSON files of a folder, or one file: a file entity and a document for each, in one append.

        A file's id is its path below the folder, its document's `file:` and that. pdf: a function from the bytes of a PDF to its text; without
        one a PDF is an error. Texts, chunks and rows are made on the executors.
        """
        self._need("collection", tenant, collection)
        found = ingest.documents(ingest.files(self.spark, path, pdf), tenant, collection, self.now())
        empty = found.where(F.trim("text") == "").select("file_id").first()
        if empty:
            raise StoreError(f"the file {empty[0]} holds no text")
        mine = lambda kind: self.view(kind).where((F.col("tenant_id") == tenant) & (F.col("collection") == collection))
        now, source = F.lit(self.now()), F.struct(F.lit("file").alias("label"), F.col("path").alias("uri"), F.col("name").alias("title"))
        body = lambda **fields: F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
        row = lambda kind, key, body, op="put": (F.lit(op).alias("op"), F.lit(kind).alias("kind"), F.lit(tenant).alias("tenant_id"), F.lit(collection).alias("collection"), F.lit(None).cast("string").alias("table"), key.alias("id"), body.alias("body"))
        stamped = lambda kind: found.join(mine(kind).select(F.col("id").alias("old"), F.col("created_at").alias("since"), "version"), F.col("id" if kind == "document" else "file_id") == F.col("old"), "left")
        ages = {"created_at": F.coalesce("since", now), "updated_at": now, "version": F.coalesce("version", F.lit(0)) + 1}
        docs = stamped("document").select(*row("document", F.col("id"), body(text=F.col("text"), metadata=F.col("metadata"), source=source, **ages)))
        files = stamped("file").select(*row("file", F.col("file_id"), body(path=F.col("path"), name=F.col("name"), media_type=F.col("media_type"), checksum=F.col("checksum"), size_bytes=F.col("size_bytes"), document_id=F.col("id"), source=source, **ages)))
        parts = found.select(F.col("id").alias("doc"), F.posexplode(T.chunks(F.col("text"), self.config.chunk_tokens)).alias("ordinal", "part"))
        chunks = parts.select(*row("chunk", F.concat_ws("#", "doc", F.col("ordinal").cast("string")), body(document_id=F.col("doc"), ordinal=F.col("ordinal"), text=F.col("part"))))
        fresh = chunks.select("id")
        stale = mine("chunk").join(found.select(F.col("id").alias("document_id")), "document_id", "left_semi").join(fresh, "id", "left_anti").select(*row("chunk", F.col("id"), F.lit(None).cast("string"), "delete"))
        self.commit_frame(docs.union(files).union(chunks).union(stale))
        self._prune(tenant)
        return found.count()

    def upload_records(self, tenant: str, collection: str, path: str) -> int:
        """The rows of CSV files, and the elements of JSON files that hold an array of objects, as records; how many.

        The table is the file's name without its ending, a record's id that and the place of the row. A row that is no object is an error, before anything is written.
        """
        self._need("collection", tenant, collection)
        found = ingest.files(self.spark, path)
        csv = ingest.csv_records(found.where("extension = 'csv'")).select("table", "row", F.to_json("payload").alias("payload"))
        made = csv.union(ingest.json_records(found.where("extension = 'json'")).select("table", "row", "payload"))
        if made.where(~F.col("payload").startswith("{")).first():
            raise StoreError("a payload is a JSON object")
        key = F.concat_ws("-", "table", F.col("row").cast("string"))
        old = self.view("record").where((F.col("tenant_id") == tenant) & (F.col("collection") == collection)).select("table", F.col("id").alias("old"), F.col("created_at").alias("since"), "version")
        made = made.withColumn("id", key).join(old.withColumnRenamed("table", "old_table"), (F.col("table") == F.col("old_table")) & (F.col("id") == F.col("old")), "left")
        now = F.lit(self.now())
        body = F.to_json(F.struct("payload", ingest.projection(F.col("table"), F.col("id"), F.col("payload")).alias("projection"), F.coalesce("since", now).alias("created_at"), now.alias("updated_at"), (F.coalesce("version", F.lit(0)) + 1).alias("version")))
        return self.commit_frame(made.select(F.lit("put").alias("op"), F.lit("record").alias("kind"), F.lit(tenant).alias("tenant_id"), F.lit(collection).alias("collection"), "table", "id", body.alias("body")))

    def delete(self, kind: str, tenant: str, collection: str | None, key: str, table: str | None = None) -> None:
        """Idempotent. A document takes its chunks, a file its document, and each takes the edges that touch it."""
        rows = [("delete", kind, tenant, collection, table, key, None)]
        gone = [(kind, key)]
        if kind == "file":
            old = self.get("file", tenant, collection, key)
            if old:
                rows.append(("delete", "document", tenant, collection, None, old.document_id, None))
                kind, key = "document", old.document_id
                gone.append((kind, key))
        if kind == "document":
            chunks = [r.id for r in self.chunks_of(tenant, collection, key).select("id").collect()]
            rows += [("delete", "chunk", tenant, collection, None, c, None) for c in chunks]
            gone += [("document_chunk", c) for c in chunks]
        self._commit(rows)
        if kind != "edge":
            ends = self.spark.createDataFrame([(k, i) for k, i in gone], "kind string, end string")  # the item, its document and its chunks
            edges = self.view("edge").where(F.col("tenant_id") == tenant)
            touched = edges.where(F.lit(False)).select("id")
            for side in ("from", "to"):
                touched = touched.union(edges.join(F.broadcast(ends), (F.col(f"{side}_kind") == F.col("kind")) & (F.col(f"{side}_id") == F.col("end")), "left_semi").select("id"))
            self._delete_all("edge", touched.distinct().select(F.lit(tenant).alias("tenant_id"), F.lit(None).cast("string").alias("collection"), F.lit(None).cast("string").alias("table"), "id"))

    def _delete_all(self, kind: str, rows: DataFrame) -> int:
        """Delete the entities (tenant_id, collection, table, id) of a kind, in one append; nothing is written if there are none."""
        if rows.isEmpty():
            return 0
        return self.commit_frame(rows.select(F.lit("delete").alias("op"), F.lit(kind).alias("kind"), "tenant_id", "collection", "table", "id", F.lit(None).cast("string").alias("body")))

    def forget(self, tenant: str, collection: str, key: str) -> None:
        self.delete("memory", tenant, collection, key)

    def delete_table(self, tenant: str, collection: str, table: str) -> int:
        """All records of a table, in one append."""
        return self._delete_all("record", self.list("record", tenant, collection, table).select(*IDENTITY[1:]))

    # ------------------------------------------------------------------------------------ graph

    def _items(self, tenant: str) -> DataFrame:
        live = self._live().where((F.col("tenant_id") == tenant) & F.col("kind").isin(*ITEM_KINDS))
        return live.select("tenant_id", F.when(F.col("kind") == "chunk", "document_chunk").otherwise(F.col("kind")).alias("kind"), "id")

    def add_edge(self, tenant: str, key: str, from_kind: str, from_id: str, to_kind: str, to_id: str, relation: str, metadata: dict | None = None) -> Row:
        """Either end must be exactly one item of its kind in the tenant."""
        _text("id", key), _text("relation", relation)
        edge = self.spark.createDataFrame([(tenant, from_kind, from_id, to_kind, to_id)], "tenant_id string, from_kind string, from_id string, to_kind string, to_id string")
        n = graph.end_counts(edge, self._items(tenant)).first()
        for count, name in ((n.from_count, from_id), (n.to_count, to_id)):
            if count == 0:
                raise NotFound(f"item {name}")
            if count > 1:
                raise StoreError(f"item {name} is ambiguous")
        old = self.get("edge", tenant, None, key)
        self._commit([("put", "edge", tenant, None, None, key, {"from_id": from_id, "from_kind": from_kind, "to_id": to_id, "to_kind": to_kind, "relation": relation, "metadata": metadata or {}, "created_at": old.created_at if old else self.now(), "updated_at": self.now()})])
        return self.get("edge", tenant, None, key)

    def _prune(self, tenant: str) -> None:
        edges = self.list("edge", tenant)
        kept = state.prune_edges(edges, self._items(tenant))
        self._delete_all("edge", edges.join(kept.select("id"), "id", "left_anti").select(*IDENTITY[1:]))

    def neighbours(self, tenant: str, node: str) -> DataFrame:
        return graph.neighbours(self.list("edge", tenant), node).orderBy("seq")

    def traverse(self, tenant: str, seeds: list[str], hops: int = 2, max_nodes: int = 50, relation: str | None = None) -> DataFrame:
        return graph.traverse(self.view("edge").where(F.col("tenant_id") == tenant), seeds, hops, max_nodes, relation).orderBy("place")

    # ------------------------------------------------------------------------------------ retrieval

    def search(self, r: Recall) -> DataFrame:
        """Ranked entries: rank, kind, id, document_id, text, score, reason, matched_terms and the entry's own fields."""
        _text("tenant", r.tenant)
        how = retrieve.mode(r.mode)
        if how != "vector" and not r.query.strip() and not r.embedding:
            raise StoreError("a query or an embedding is required")
        entries = self.entries()
        if how == "vector" and not r.query.strip() and not r.embedding:
            return entries.limit(0).withColumns({"score": F.lit(0.0), "reason": F.lit(""), "matched_terms": F.array().cast("array<string>"), "rank": F.lit(0)})
        words = T.query_tokens(r.query)
        vector = r.embedding or embed(r.query if how == "vector" else " ".join(w for w in _ordered(r.query)))
        keep = Filter(r.tenant, r.collection, r.user, r.memory_type, r.kind, r.metadata, r.as_of if r.as_of is not None else self.now(), r.include_superseded).column()
        pool = retrieve.fetch_k(r.top_k)
        if how == "vector":
            hits = retrieve.vector_search(entries, vector, None, "key", keep, pool=pool)
        elif how == "text":
            hits = retrieve.text_search(entries, words, None, "key", keep)  # min-max scores lie close: any match may come first after weighting
        elif r.dedup_chunks or r.mmr or r.min_score is not None:
            hits = entries.join(retrieve.hybrid_search(entries, words, vector, r.top_k, "key", keep, whole=True, pool=pool), "key")
        else:
            # All that may still be ranked after weighting: the row at place p scores at most 4 / (120 + p), the first top_k at least 1 / (60 + top_k),
            # and confidence changes a score at most 1.2 : 0.8.
            found = retrieve.hybrid_search(entries, words, vector, 6 * r.top_k + 241, "key", keep, pool=pool)
            hits = entries.join(F.broadcast(found), "key")  # a bounded number of hits
        hits = hits.withColumn("score", retrieve.confidence_weight(F.col("score"), F.col("kind"), F.col("confidence")))
        if r.min_score is not None:
            hits = hits.where(F.col("score") >= r.min_score)
        if r.dedup_chunks:
            hits = retrieve.best_chunk(hits, "document_id", "key")
        hits = hits.withColumn("matched_terms", retrieve.matched_terms(F.col("text"), words) if how != "vector" else F.array().cast("array<string>"))
        order = Window.orderBy(F.desc("score"), "id", "key")
        if r.mmr:
            pick = retrieve.mmr if how == "vector" else retrieve.mmr_of_all
            picked = pick(hits, r.top_k, r.mmr_lambda, "key").select("key", F.col("place").alias("rank"))
            return hits.join(F.broadcast(picked), "key").orderBy("rank")
        best = hits.orderBy(F.desc("score"), "id", "key").limit(r.top_k)
        return best.withColumn("rank", F.row_number().over(order)).orderBy("rank")

    def recall(self, r: Recall) -> DataFrame:
        from dataclasses import replace

        return self.search(replace(r, mode="hybrid"))

    def build_context(self, tenant: str, query: str, max_tokens: int, collection: str | None = None, include_related: bool = True, top_k: int = 20, related_limit: int = 8) -> dict:
        """The text that fits the budget, its items, the related ids, and an audit record."""
        cfg, now = self.config, self.now()
        hits = self.recall(Recall(tenant, query, top_k=top_k, collection=collection)).withColumnRenamed("contradicts", "contradictions")
        cols = ["id", "kind", "text", "score", "confidence", "contradictions", "touched", "rank"]
        hits = context.contradiction_rank(hits.select(*cols)).drop("rank").withColumnRenamed("new_rank", "rank").withColumn("origin", F.lit("recalled"))
        edges = self.view("edge").where(F.col("tenant_id") == tenant)
        related = graph.both_ways(edges).join(hits.select(F.col("id").alias("node")), "node", "left_semi").select("other").distinct()
        if include_related:
            entries = self.entries().where(F.col("tenant_id") == tenant)
            more = graph.expand(hits.select("id", "rank"), edges, entries.select("id").distinct(), related_limit)
            row = F.row_number().over(Window.orderBy("from_rank", "edge_seq", "id"))
            more = more.withColumn("rank", row + 1_000_000).join(entries.drop("score"), "id").withColumn("contradictions", F.col("contradicts")).withColumn("origin", F.lit("graph_expanded"))
            hits = hits.unionByName(more.select(*cols, "origin"))
        if cfg.decay_weight > 0 or cfg.connectivity_weight > 0:
            hits = context.normalised(hits)
        if cfg.decay_weight > 0:
            hits = hits.withColumn("score", context.decay(F.col("score"), cfg.decay_weight, now, F.col("touched"), cfg.decay_days))
        if cfg.connectivity_weight > 0:
            hits = context.connectivity(hits, edges, cfg.connectivity_weight)
        if cfg.decay_weight > 0 or cfg.connectivity_weight > 0:
            hits = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "rank", "id")))
        else:
            hits = hits.withColumn("rank", F.row_number().over(Window.orderBy("rank", "id")))
        hits = hits.persist()
        try:
            chosen = context.pack(hits, max_tokens).orderBy("rank").collect()  # at most top_k + related_limit rows
            every = [r.id for r in hits.orderBy("rank").select("id").collect()]
        finally:
            hits.unpersist()
        items = [{"id": r.id, "kind": r.kind, "score": r.score, "snippet": r.text[:120], "tokens": r.tokens, "origin": r.origin} for r in chosen]
        text = "\n\n".join(f"[{r.kind}:{r.id}]\n{r.text}" for r in chosen)
        out = {"text": text, "token_count": -(-len(text.encode()) // 4), "items": items, "related_item_ids": sorted(r.other for r in related.collect())}
        self._audit(tenant, query, sum(r.tokens for r in chosen), items + [{"id": k, "origin": "not_included"} for k in every if k not in {r.id for r in chosen}])
        return out

    # ------------------------------------------------------------------------------------ audit, SQL, statistics

    def audit(self) -> DataFrame:
        fs, p = self._fs(folder := f"{self.path}/audit/gen={self._audits}")
        return self.spark.read.schema(AUDIT).parquet(folder) if fs.exists(p) else self.spark.createDataFrame([], AUDIT)

    def _audit(self, tenant: str, query: str, used: int, items: list[dict]) -> None:
        if self._audit_seq is None:
            self._audit_seq = self.audit().agg(F.max("seq")).first()[0] or 0
        self._audit_seq += 1
        row = (self._audit_seq, tenant, self.now(), query, used, json.dumps({"items": items}))
        self.spark.createDataFrame([row], AUDIT).coalesce(1).write.mode("append").parquet(f"{self.path}/audit/gen={self._audits}")
        if self.config.audit_records or self.config.audit_bytes:
            self.compact_audit()

    def query_audit(self, tenant: str, start: int | None = None, end: int | None = None) -> DataFrame:
        return report.audit_range(self.audit(), tenant, start, end).orderBy("seq")

    def compact_audit(self, records: int | None = None, size: int | None = None) -> None:
        """Keep the newest audit records; None takes the configured limit and 0 lifts it."""
        kept = report.retained(self.audit(), self.config.audit_records if records is None else records, self.config.audit_bytes if size is None else size)
        kept.write.mode("overwrite").parquet(f"{self.path}/audit/gen={self._audits + 1}")  # counts once it is complete, and only then the old one goes
        fs, old = self._fs(f"{self.path}/audit/gen={self._audits}")
        self._audits += 1
        fs.delete(old, True)

    def execute_sql(self, tenant: str, statement: str) -> DataFrame:
        return minisql.execute(self.view("record"), tenant, statement)

    def stats(self) -> DataFrame:
        """Rows of each kind, operations and audit lines."""
        kinds = self._live().groupBy(F.col("kind").alias("entity")).agg(F.count("*").alias("rows"))
        every = self.spark.createDataFrame([(k,) for k in BODIES], "entity string")
        return every.join(kinds, "entity", "left").select("entity", F.coalesce("rows", F.lit(0)).alias("rows")).unionByName(report.counts(operations=self.ops(), audit=self.audit()))

    def put_prompt(self, tenant: str | None, key: str, name: str, content: str, description: str = "") -> None:
        _text("id", key), _text("name", name), _text("content", content)
        old = self.get("prompt", tenant, None, key) if tenant else None
        self._commit([("put", "prompt", tenant, None, None, key, {"name": name, "description": description, "content": content, "created_at": old.created_at if old else self.now(), "updated_at": self.now()})])


def _ordered(query: str) -> list[str]:
    """The normalised tokens of a query in their order."""
    import regex

    found = [t.lower() for t in regex.split(r"[^\p{Alphabetic}\p{N}]+", query) if t]
    return [T.SYNONYMS.get(t, t) for t in found]
