"""Log, record, graph, audit and statistics queries. Events stand for the log, TPC-H-like rows for records and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallforge.operators import graph, minisql, report, state
from recallforge.operators.filters import Filter, valid_at
from recallforge.plans.session import scratch
from recallforge.sources import ingest, wal
from recallforge.sources.store import Config, MemoryStore

AS_OF_MS = 1_705_276_800_000  # 15 January 2024
_MS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES, ORACLE = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: identity (user_id, k), an error deletes."""
    e = _read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("seq"), "user_id", k.alias("k"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value", F.expr(f"floor({_MS} / 1000)").alias("ms"))


_LOG = "l AS (SELECT event_id seq, user_id, (props->>'$.k')::INT k, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END op, value, epoch_us(ts) // 1000 ms FROM events)"


@_query(f"WITH {_LOG} SELECT user_id, k, max(seq) AS seq, arg_max(value, seq) AS value FROM l GROUP BY ALL")
def lww_state(spark, sf_dir):
    return state.last_write(_log(spark, sf_dir), "user_id", "k").select("user_id", "k", "seq", "value")


@_query(f"WITH {_LOG} SELECT user_id, k, max(seq) AS seq, arg_max(value, seq) AS value FROM l GROUP BY ALL HAVING arg_max(op, seq) <> 'delete'")
def tombstone_state(spark, sf_dir):
    return state.live(_log(spark, sf_dir), "user_id", "k").select("user_id", "k", "seq", "value")


@_query(f"WITH {_LOG}, d AS (SELECT user_id, k, max(seq) e FROM l WHERE op = 'delete' GROUP BY ALL) SELECT user_id, k, count(*) AS version, min(seq) AS created, max(seq) AS updated FROM l LEFT JOIN d USING (user_id, k) WHERE op <> 'delete' AND (e IS NULL OR seq > e) GROUP BY ALL")
def version_counter(spark, sf_dir):
    return state.versions(_log(spark, sf_dir), "user_id", "k")


@_query("SELECT event_id, props FROM events WHERE event_id < (SELECT min(event_id) FROM events WHERE event_id >= 200 AND props = '{\"k\": 69}')")
def wal_valid_prefix(spark, sf_dir):
    """Events as a log of lines in three appends of unequal size; from number 200 on, lines of one value lose their end. What is recovered is decoded again."""
    e = _read(spark, sf_dir, "events").select("event_id", F.to_json(F.struct("event_id", "props")).alias("body"), "props")
    path, torn = scratch(spark, "log"), scratch(spark, "torn")
    for low, high in ((0, 50), (50, 53), (53, None)):
        part = e.where(F.col("event_id") >= low) if high is None else e.where((F.col("event_id") >= low) & (F.col("event_id") < high))
        wal.write(part, path, "event_id")
    body = F.element_at(F.split("value", "\t", 3), 3)
    bad = (F.get_json_object(body, "$.event_id").cast("long") >= 200) & (F.get_json_object(body, "$.props") == '{"k": 69}')
    spark.read.text(path).select(F.when(bad, F.expr("left(value, length(value) - 3)")).otherwise(F.col("value")).alias("value")).write.text(torn)
    got = wal.recover(spark, torn).select(F.from_json("body", "event_id long, props string").alias("r"))
    return got.select("r.event_id", "r.props")


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("seq")
    return _log(spark, sf_dir).withColumn("valid_from", F.col("ms")).withColumn("valid_until", F.lead("ms").over(w))


@_query(f"WITH {_LOG} SELECT seq, user_id, ms AS valid_from, lead(ms) OVER (PARTITION BY user_id ORDER BY seq) AS valid_until FROM l")
def validity_window(spark, sf_dir):
    return _windows(spark, sf_dir).select("seq", "user_id", "valid_from", "valid_until")


@_query(f"WITH {_LOG}, w AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY seq) u FROM l) SELECT seq, user_id, value FROM w WHERE ms <= {AS_OF_MS} AND (u IS NULL OR u > {AS_OF_MS})")
def as_of_filter(spark, sf_dir):
    return _windows(spark, sf_dir).where(valid_at(F.lit(AS_OF_MS))).select("seq", "user_id", "value")


@_query("SELECT conv_id, turn, conv_id || '#' || (turn + 1) AS superseded_by FROM conversations c WHERE turn % 3 <> 2 AND EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1)")
def superseded_marks(spark, sf_dir):
    """Turn n + 1 supersedes turn n, unless n leaves 2 modulo 3."""
    c = _read(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws("#", F.col("conv_id").cast("string"), t.cast("string"))
    earlier = F.when((F.col("turn") > 0) & ((F.col("turn") - 1) % 3 != 2), F.array(name(F.col("turn") - 1))).otherwise(F.array().cast("array<string>"))
    writes = c.select((F.col("conv_id") % 4).alias("tenant_id"), name(F.col("turn")).alias("id"), (F.col("conv_id") * 10_000 + F.col("turn")).alias("seq"), earlier.alias("supersedes"))
    own = c.select("conv_id", "turn", name(F.col("turn")).alias("id"), (F.col("conv_id") % 4).alias("tenant_id"))
    return own.join(state.superseded(writes), ["tenant_id", "id"]).select("conv_id", "turn", "superseded_by")


@_query("SELECT conv_id, turn FROM conversations c WHERE (conv_id % 4) = 1 AND NOT (turn % 3 <> 2 AND EXISTS (SELECT 1 FROM conversations n WHERE n.conv_id = c.conv_id AND n.turn = c.turn + 1))")
def superseded_excluded(spark, sf_dir):
    """One tenant's turns as memories, with the marks of superseded_marks, through the filter that leaves superseded ones out."""
    marks = superseded_marks(spark, sf_dir)
    rows = _read(spark, sf_dir, "conversations").join(marks, ["conv_id", "turn"], "left").withColumn("tenant_id", (F.col("conv_id") % 4).cast("string"))
    return rows.where(Filter("1").column()).select("conv_id", "turn")


# --------------------------------------------------------------------------------------------- graph


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer to nation and nation to region, in the order of customers, then nations."""
    c = _read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("from_id"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("to_id"), F.col("c_custkey").alias("seq"), F.lit("lives in").alias("relation"))
    n = _read(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("to_id"), (F.col("n_nationkey") + 1_000_000_000).cast("long").alias("seq"), F.lit("part of").alias("relation"))
    return c.unionByName(n).withColumn("id", F.concat_ws(">", "from_id", "to_id"))


_EDGES = """e AS (SELECT 'c' || c_custkey f, 'n' || c_nationkey t, c_custkey seq FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 1000000000 FROM nation),
u AS (SELECT f node, t other, seq, f || '>' || t via FROM e UNION ALL SELECT t, f, seq, f || '>' || t FROM e)"""


@_query(f"WITH {_EDGES} SELECT other AS neighbour, via AS edge_id FROM u WHERE node = 'n3'")
def graph_neighbors(spark, sf_dir):
    return graph.neighbours(_edges(spark, sf_dir), "n3").select("neighbour", F.col("id").alias("edge_id"))


@_query(f"WITH {_EDGES}, h1 AS (SELECT other node, min(seq) s FROM u WHERE node = 'n3' GROUP BY other), h2 AS (SELECT u.other node FROM h1 JOIN u ON u.node = h1.node WHERE u.other <> 'n3' AND u.other NOT IN (SELECT node FROM h1) GROUP BY u.other) SELECT node, 1 AS hop FROM h1 UNION ALL SELECT node, 2 FROM h2")
def graph_bfs_2hop(spark, sf_dir):
    return graph.traverse(_edges(spark, sf_dir), ["n3"], 2, None).select("node", "hop")


@_query(f"WITH {_EDGES} SELECT node, 1 AS hop, via AS via_edge, row_number() OVER (ORDER BY seq, node)::BIGINT AS place FROM (SELECT other node, seq, via FROM u WHERE node = 'r2') ORDER BY seq LIMIT 3")
def graph_bfs_capped(spark, sf_dir):
    return graph.traverse(_edges(spark, sf_dir), ["r2"], 2, 3)


@_query(f"WITH {_EDGES}, hits AS (SELECT * FROM (VALUES ('n3', 1), ('n5', 2), ('r1', 3)) v(id, rank)), x AS (SELECT other id, min((rank, seq)) m FROM hits JOIN u ON node = hits.id WHERE other NOT IN (SELECT id FROM hits) GROUP BY other) SELECT id, m[1] AS from_rank, m[2] AS edge_seq FROM x ORDER BY m, id LIMIT 8")
def graph_expand(spark, sf_dir):
    hits = spark.createDataFrame([("n3", 1), ("n5", 2), ("r1", 3)], "id string, rank int")
    e = _edges(spark, sf_dir)
    items = e.select(F.col("from_id").alias("id")).union(e.select("to_id")).distinct()
    return graph.expand(hits, e, items).select("id", "from_rank", "edge_seq")


_ITEMS = "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'"


@_query(f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN ({_ITEMS}) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def edge_prune(spark, sf_dir):
    """Line items are edges from orders to parts; those whose ends are gone are dropped."""
    o = _read(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"))
    p = _read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"))
    items = o.unionByName(p).withColumn("tenant_id", F.lit("t"))
    li = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id"), F.lit("order").alias("from_kind"), F.lit("part").alias("to_kind"), F.lit("t").alias("tenant_id"))
    return state.prune_edges(li, items).select("l_orderkey", "l_linenumber")


@_query("WITH i AS (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) SELECT s_suppkey AS id, coalesce(a.n, 0) AS from_count, coalesce(b.n, 0) AS to_count FROM supplier LEFT JOIN i a ON a.k = s_nationkey LEFT JOIN i b ON b.k = s_nationkey + 20")
def edge_end_counts(spark, sf_dir):
    items = _read(spark, sf_dir, "customer").select(F.lit("t").alias("tenant_id"), F.lit("k").alias("kind"), F.col("c_nationkey").alias("id"))
    edges = _read(spark, sf_dir, "supplier").select(F.lit("t").alias("tenant_id"), F.col("s_suppkey").alias("id"), F.lit("k").alias("from_kind"), F.lit("k").alias("to_kind"), F.col("s_nationkey").alias("from_id"), (F.col("s_nationkey") + 20).alias("to_id"))
    return graph.end_counts(edges, items).select("id", "from_count", "to_count")


# --------------------------------------------------------------------------------------------- records


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and orders as JSON records."""
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.lit("part").alias("table"), F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), F.col("p_size").alias("size")), {"ignoreNullFields": "false"}).alias("payload"), F.create_map(F.lit("tier"), F.when(F.col("p_size") > 25, "large").otherwise("small")).alias("metadata"))
    o = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1_000_000_000).alias("seq"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("orders").alias("table"), F.to_json(F.struct(F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status")), {"ignoreNullFields": "false"}).alias("payload"), F.create_map(F.lit("tier"), F.lit("any")).alias("metadata"))
    return p.unionByName(o).withColumn("tenant_id", F.lit("acme")).withColumn("collection", F.lit("main"))


@_query("SELECT 'p' || p_partkey AS id FROM part WHERE p_brand = 'Brand#2' AND p_size = 11 ORDER BY p_partkey LIMIT 100")
def sql_select_eq(spark, sf_dir):
    return minisql.execute(_records(spark, sf_dir), "acme", "SELECT * FROM part WHERE brand = 'Brand#2' AND size = 11").select("id")


@_query("SELECT 'p' || p_partkey AS id FROM part WHERE p_type = 'ECONOMY' AND p_size > 25 ORDER BY p_partkey LIMIT 500")
def sql_payload_metadata(spark, sf_dir):
    return minisql.execute(_records(spark, sf_dir), "acme", "select * from records where table=part and payload.type=ECONOMY AND metadata.tier = \"large\" limit 900;").select("id")


@_query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderkey LIMIT 25")
def sql_limit_order(spark, sf_dir):
    return minisql.execute(_records(spark, sf_dir), "acme", "SELECT * FROM orders WHERE priority = '1-URGENT' and priority = '5-LOW' LIMIT 25").select("id")


@_query("SELECT 'o' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 500")
def sql_json_null(spark, sf_dir):
    return minisql.execute(_records(spark, sf_dir), "acme", "SELECT * FROM orders WHERE status = null LIMIT 500").select("id")


@_query("SELECT event_id FROM events WHERE props->>'$.k' = '69' ORDER BY event_id LIMIT 500")
def sql_event_props(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("t").alias("tenant_id"), F.lit("events").alias("table"), F.col("props").alias("payload"))
    return minisql.execute(e, "t", "SELECT * FROM events WHERE k = 69 LIMIT 500").select(F.col("seq").alias("event_id"))


@_query("SELECT p_partkey, 'table part record p' || p_partkey || ' brand ' || p_brand || ' size ' || p_size || ' type ' || p_type AS text FROM part")
def json_projection(spark, sf_dir):
    r = _records(spark, sf_dir).where("table = 'part'")
    return r.select(F.col("seq").alias("p_partkey"), ingest.projection(F.col("table"), F.col("id"), F.col("payload")).alias("text"))


@_query("SELECT n_nationkey::BIGINT AS row, n_name AS name, n_regionkey::VARCHAR AS region, '' AS missing FROM nation")
def csv_rows_to_records(spark, sf_dir):
    lines = _read(spark, sf_dir, "nation").orderBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws(",", F.concat(F.lit(" "), "n_name"), F.col("n_regionkey").cast("string")).alias("line")))).alias("a"))
    whole = lines.select(F.lit("/in/nation.csv").alias("path"), F.concat(F.lit("name,region, missing\r\n"), F.array_join(F.transform("a", lambda x: x["line"]), "\n")).alias("text"))
    return ingest.csv_records(whole).select("row", F.col("payload")["name"].alias("name"), F.col("payload")["region"].alias("region"), F.col("payload")["missing"].alias("missing"))


@_query("SELECT 'acme' AS tenant_id, 'main' AS collection, 'part' AS \"table\", count(*) AS records FROM part UNION ALL SELECT 'acme', 'main', 'orders', count(*) FROM orders")
def list_tables(spark, sf_dir):
    return report.table_counts(_records(spark, sf_dir))


@_query("SELECT lang AS tenant_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS collections FROM documents GROUP BY lang")
def collection_tree(spark, sf_dir):
    c = _read(spark, sf_dir, "documents").select(F.col("lang").alias("tenant_id"), F.col("source").alias("collection"))
    return report.tree(c).select("tenant_id", F.array_join("collections", ",").alias("collections"))


# --------------------------------------------------------------------------------------------- audit and statistics


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.col("event_type").alias("tenant_id"), F.expr(f"floor({_MS} / 1000)").alias("ts"), F.col("props").alias("body"))


@_query(f"SELECT event_id AS seq, epoch_us(ts) // 1000 AS ts FROM events WHERE event_type = 'click' AND epoch_us(ts) // 1000 BETWEEN {AS_OF_MS} AND {AS_OF_MS + 86_400_000}")
def audit_range(spark, sf_dir):
    return report.audit_range(_audit(spark, sf_dir), "click", AS_OF_MS, AS_OF_MS + 86_400_000).select("seq", "ts")


@_query("WITH s AS (SELECT event_id, row_number() OVER (ORDER BY event_id DESC) n, sum(strlen(props) + 1) OVER (ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) b FROM events) SELECT event_id AS seq FROM s WHERE n <= 800 AND b <= 7000")
def audit_retention(spark, sf_dir):
    return report.retained(_audit(spark, sf_dir), 800, 7000).select("seq")


@_query("SELECT count(*) AS lines, sum(strlen(props) + 1)::BIGINT AS bytes FROM events")
def audit_stats(spark, sf_dir):
    return report.audit_stats(_audit(spark, sf_dir))


def _store(spark: SparkSession, sf_dir: str) -> MemoryStore:
    """A store of regions as tenants, nations as collections and customers as records of the table of their market segment, in three appends."""
    db = MemoryStore(spark, scratch(spark, "store"), Config(auto_compact_ops=0, auto_compact_bytes=0), now=lambda: AS_OF_MS)
    row = lambda kind, tenant, collection, table, key, **body: (F.lit("put").alias("op"), F.lit(kind).alias("kind"), tenant.alias("tenant_id"), collection.alias("collection"), table.alias("table"), key.alias("id"), F.to_json(F.struct(*(c.alias(k) for k, c in body.items()))).alias("body"))
    null, text = F.lit(None).cast("string"), lambda c: F.col(c).cast("string")
    nation = _read(spark, sf_dir, "nation")
    db.commit_frame(_read(spark, sf_dir, "region").select(*row("tenant", text("r_regionkey"), null, null, text("r_regionkey"), name=F.col("r_name"))))
    db.commit_frame(nation.select(*row("collection", text("n_regionkey"), F.col("n_name"), null, F.col("n_name"), description=F.col("n_name"))))
    customer = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).orderBy("c_custkey")
    payload = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")))
    db.commit_frame(customer.select(*row("record", text("n_regionkey"), F.col("n_name"), F.col("c_mktsegment"), text("c_custkey"), payload=payload, version=F.lit(1))))
    return db


_KINDS = ("tenant", "collection", "document", "chunk", "memory", "record", "file", "edge", "prompt")


@_query(
    "WITH n AS (SELECT 'tenant' AS entity, count(*) AS rows FROM region UNION ALL SELECT 'collection', count(*) FROM nation UNION ALL SELECT 'record', count(*) FROM customer) SELECT * FROM n UNION ALL SELECT 'operations', sum(rows)::BIGINT FROM n UNION ALL SELECT 'audit', 0 "
    + " ".join(f"UNION ALL SELECT '{k}', 0" for k in _KINDS if k not in ("tenant", "collection", "record"))
)
def db_stats(spark, sf_dir):
    """The statistics of a real store."""
    return _store(spark, sf_dir).stats()


@_query("SELECT c_custkey::VARCHAR AS id, row_number() OVER (ORDER BY c_custkey) AS place FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1 AND c_mktsegment = (SELECT min(c_mktsegment) FROM customer)")
def list_filter(spark, sf_dir):
    """Records of one tenant and table, in the order of their insertion."""
    first = _read(spark, sf_dir, "customer").agg(F.min("c_mktsegment")).first()[0]
    return _store(spark, sf_dir).list("record", "1", table=first).select("id", F.row_number().over(Window.orderBy("seq")).cast("long").alias("place"))


_CODE = "(SELECT item_id, text || chr(10) || 'def f' || item_id || '():' || chr(10) || '  return ' || substr(text, 1, 60) || chr(10) || 'class C' || item_id || ':' || chr(10) || '    def g(self): pass' || chr(10) || '# ' || substr(text, 1, 90) || chr(10) || 'async def h(): pass' AS code FROM benchmark)"
_N = "len(list_filter(regexp_split_to_array({}, '\\s+'), lambda y: y <> ''))"
_GROUPS = "list_transform(range(0, n, 12), lambda i: array_to_string(list_filter(regexp_split_to_array(s, '\\s+'), lambda y: y <> '')[i + 1 : i + 12], ' '))"


@_query(
    f"""WITH s AS (SELECT item_id, o, CASE WHEN ends_with(s, chr(10)) THEN s[:-2] ELSE s END s FROM (SELECT item_id, unnest(p) s, generate_subscripts(p, 1) o
        FROM (SELECT item_id, string_split(regexp_replace(code, '(^|\n)(def |class |async def )', '\\1' || chr(1) || '\\2', 'g'), chr(1)) p FROM {_CODE})) WHERE trim(s, ' ' || chr(10)) <> ''),
    g AS (SELECT item_id, o, s, n, CASE WHEN n > 12 THEN {_GROUPS} ELSE [s] END parts FROM (SELECT *, {_N.format("s")} n FROM s)),
    m AS (SELECT item_id, list_reduce(list_transform(list({{'n': n, 'p': parts}} ORDER BY o), lambda x: x.p), lambda a, c: CASE
        WHEN len(c) > 1 OR {_N.format("c[1]")} > 12 THEN list_concat(CASE WHEN len(a) = 0 OR ends_with(a[-1], chr(10)) THEN a ELSE list_append(a[1 : len(a) - 1], a[-1] || chr(10)) END, c)
        WHEN len(a) > 0 AND {_N.format("a[-1]")} + {_N.format("c[1]")} <= 12 THEN list_append(a[1 : len(a) - 1], a[-1] || chr(10) || c[1]) ELSE list_concat(a, c) END, []::VARCHAR[]) c FROM g GROUP BY item_id)
    SELECT item_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS ordinal FROM m"""
)
def code_chunks(spark, sf_dir):
    """Benchmark passages made into Python modules, cut into chunks of 12 words."""
    t, i = F.col("text"), F.col("item_id").cast("string")
    code = F.concat(t, F.lit("\ndef f"), i, F.lit("():\n  return "), F.substring(t, 1, 60), F.lit("\nclass C"), i, F.lit(":\n    def g(self): pass\n# "), F.substring(t, 1, 90), F.lit("\nasync def h(): pass"))
    made = ingest.with_code_chunks(_read(spark, sf_dir, "benchmark").select("item_id", code.alias("text"), F.lit("python").alias("language")), budget=12)
    return made.select("item_id", "chunk", F.col("ordinal").cast("long"))
