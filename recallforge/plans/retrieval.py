"""Retrieval, text and context queries. Documents stand for entries: tenant is lang, collection is source, id is doc_id."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recallforge.functions import text as T
from recallforge.functions.vector import DIM, hash_slots, with_hash_embedding
from recallforge.operators import context, report, retrieve
from recallforge.operators.filters import Filter

QUERY = "The oranst postgres thing"
WORDS = T.query_tokens(QUERY)
VECTOR = [round(math.sin(i + 1), 6) for i in range(DIM)]
NOW_MS = 1_706_745_600_000  # 1 February 2024
TAU_DAYS = 10.0
BUDGET = 4000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("tenant_id"), F.col("source").alias("collection"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("metadata"), F.lit(None).cast("string").alias("superseded_by"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("tenant_id"))


def _six(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


QUERIES, ORACLE = {}, {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# --------------------------------------------------------------------------------------------- SQL pieces

_LIST = "[" + ",".join(f"'{w}'" for w in WORDS) + "]"
_TOK = r"list_transform(list_filter(regexp_split_to_array(text,'[^\p{L}\p{N}]+'), lambda x: x<>''), lambda x: lower(x))"
_SPLIT = r"list_filter(regexp_split_to_array(text,'[\s\x0B\x{85}\p{Z}]+'), lambda x: x<>'')"
_BM25 = f"""d AS (SELECT *, {_TOK} AS tok FROM documents), st AS (SELECT count(*)::DOUBLE n, sum(len(tok))::DOUBLE tot FROM d),
p AS (SELECT doc_id, t, len(tok) dl, len(list_filter(tok, lambda x: x = t)) f FROM d, (SELECT unnest({_LIST}) t) q),
dfs AS (SELECT t, count(*)::DOUBLE df FROM p WHERE f > 0 GROUP BY t),
b AS (SELECT doc_id, sum(ln(1+(n-df+0.5::DOUBLE)/(df+0.5::DOUBLE))*f*2.2::DOUBLE/(f+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/(tot/n)))) bm25
      FROM p JOIN dfs USING (t), st WHERE f > 0 GROUP BY doc_id)"""
_FNV = "list_reduce([14695981039346656037::HUGEINT] || list_transform(range(1,strlen(t)+1), lambda i: ('0x'||hex(t)[2*i-1:2*i])::HUGEINT), lambda a,b: (xor(a,b)*1099511628211) % 18446744073709551616)"
_SLOTS = f"""w AS (SELECT doc_id, unnest({_TOK}) t FROM documents), wc AS (SELECT doc_id, t, count(*) c FROM w GROUP BY ALL),
h AS (SELECT t, {_FNV} h FROM (SELECT DISTINCT t FROM w)),
s AS (SELECT doc_id, (h % 64)::BIGINT slot, sum(CASE WHEN (h // 4294967296) % 2 = 0 THEN c ELSE -c END)::BIGINT v FROM wc JOIN h USING (t) GROUP BY ALL)"""
_SIN = "[" + ",".join(map(str, VECTOR)) + "]::DOUBLE[]"
_COS = f"""c AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], {_SIN}) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product({_SIN}, {_SIN}))) cos FROM embeddings)"""


# --------------------------------------------------------------------------------------------- text


@_query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) bm25 FROM b ORDER BY b.bm25 DESC, doc_id LIMIT 10")
def bm25_topk(spark, sf_dir):
    return retrieve.text_top(_entries(spark, sf_dir), WORDS, 10).select(F.col("id").alias("doc_id"), *_six("bm25"))


@_query(f"WITH {_BM25} SELECT doc_id, round(bm25, 6) bm25 FROM b JOIN documents USING (doc_id) WHERE lang = 'de' AND source <> 'src1' ORDER BY b.bm25 DESC, doc_id LIMIT 10")
def bm25_tenant_filter(spark, sf_dir):
    keep = Filter("de").column() & (F.col("collection") != "src1")
    return retrieve.text_top(_entries(spark, sf_dir), WORDS, 10, keep=keep).select(F.col("id").alias("doc_id"), *_six("bm25"))


@_query(f"WITH {_BM25} SELECT doc_id, round((bm25 - (SELECT min(bm25) FROM b)) / (SELECT max(bm25) - min(bm25) FROM b), 6) score, 'text match (bm25)' reason FROM b ORDER BY bm25 DESC, doc_id LIMIT 10")
def text_minmax(spark, sf_dir):
    return retrieve.text_search(_entries(spark, sf_dir), WORDS).select(F.col("id").alias("doc_id"), *_six("score"), "reason")


@_query(
    f"""WITH d AS (SELECT doc_id, {_TOK} AS tok FROM documents), st AS (SELECT count(*)::DOUBLE n, sum(len(tok))::DOUBLE tot FROM d),
    q AS (SELECT DISTINCT item_id, unnest({_TOK}) t FROM benchmark), w AS (SELECT doc_id, unnest(tok) t, len(tok) dl FROM d),
    p AS (SELECT doc_id, t, dl, count(*) f FROM w WHERE t IN (SELECT t FROM q) GROUP BY ALL), dfs AS (SELECT t, count(*)::DOUBLE df FROM p GROUP BY t),
    s AS (SELECT item_id, doc_id, sum(ln(1+(n-df+0.5::DOUBLE)/(df+0.5::DOUBLE))*f*2.2::DOUBLE/(f+1.2::DOUBLE*(0.25::DOUBLE+0.75::DOUBLE*dl/(tot/n)))) bm25 FROM q JOIN p USING (t) JOIN dfs USING (t), st GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(bm25, 9) DESC, doc_id) rank FROM s)
    SELECT item_id, rank, doc_id, round(bm25, 6) AS bm25 FROM r WHERE rank <= 5"""
)
def bm25_batch(spark, sf_dir):
    """Every benchmark passage as a query, in one plan."""
    asked = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieve.text_search_many(_entries(spark, sf_dir), asked, 5)
    return found.select(F.col("query_id").alias("item_id"), F.col("rank").cast("long"), F.col("key").alias("doc_id"), *_six("bm25"))


@_query(f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) t FROM documents) GROUP BY ALL")
def term_frequencies(spark, sf_dir):
    return _entries(spark, sf_dir).select(F.col("id").alias("doc_id"), F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@_query(f"SELECT t AS term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_TOK}) t FROM documents) GROUP BY t")
def document_frequency(spark, sf_dir):
    words = F.array_distinct(T.tokens(F.col("text")))
    return _entries(spark, sf_dir).select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@_query(f"SELECT count(*) AS entries, sum(len({_TOK}))::BIGINT AS tokens, round(avg(len({_TOK})), 6) AS avgdl FROM documents")
def df_avgdl(spark, sf_dir):
    n = F.size(T.tokens(F.col("text")))
    return _entries(spark, sf_dir).select(n.alias("n")).agg(F.count("*").alias("entries"), F.sum("n").alias("tokens"), F.round(F.avg("n"), 6).alias("avgdl"))


@_query(f"SELECT doc_id, array_to_string(list_sort(list_intersect(list_distinct({_TOK}), {_LIST})), ' ') AS terms FROM documents")
def matched_terms(spark, sf_dir):
    return _entries(spark, sf_dir).select(F.col("id").alias("doc_id"), F.array_join(retrieve.matched_terms(F.col("text"), WORDS), " ").alias("terms"))


_SYN = "MAP {" + ",".join(f"'{k}': '{v}'" for k, v in T.SYNONYMS.items()) + "}"


@_query(f"SELECT item_id, array_to_string(list_transform({_TOK}, lambda x: coalesce({_SYN}[x], x)), ' ') AS query FROM (SELECT item_id, 'Postgres Conexão ' || text AS text FROM benchmark)")
def query_normalise(spark, sf_dir):
    text = F.concat(F.lit("Postgres Conexão "), F.col("text"))
    return _read(spark, sf_dir, "benchmark").select("item_id", T.normalised_query(text).alias("query"))


@_query(f"SELECT doc_id, o AS ordinal, array_to_string(tk[o*48+1 : o*48+48], ' ') AS chunk FROM (SELECT doc_id, {_SPLIT} tk FROM documents), LATERAL (SELECT unnest(range(0, ceil(len(tk)/48.0)::BIGINT)) o)")
def chunk_documents(spark, sf_dir):
    return _entries(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode(T.chunks(F.col("text"))).alias("ordinal", "chunk")).withColumn("ordinal", F.col("ordinal").cast("long"))


@_query(f"SELECT source, sum(ceil(len({_SPLIT})/48.0))::BIGINT AS chunks FROM documents GROUP BY source")
def chunk_counts(spark, sf_dir):
    words = F.size(F.filter(F.split("text", T.SPACE), lambda t: t != ""))
    return _entries(spark, sf_dir).groupBy(F.col("collection").alias("source")).agg(F.sum(F.ceil(words / 48)).cast("long").alias("chunks"))


@_query(f"WITH {_SLOTS} SELECT doc_id, slot, v AS value FROM s WHERE v <> 0")
def hash_embedding(spark, sf_dir):
    made = with_hash_embedding(_entries(spark, sf_dir).select("id", "text"))
    return made.select(F.col("id").alias("doc_id"), F.posexplode("slots").alias("slot", "value")).where("value <> 0").select("doc_id", F.col("slot").cast("long"), "value")


@_query("SELECT doc_id, ceil(strlen(text)/4.0)::BIGINT AS tokens, substr(text, 1, 120) AS snippet FROM documents")
def snippets(spark, sf_dir):
    return _entries(spark, sf_dir).select(F.col("id").alias("doc_id"), T.approx_tokens(F.col("text")).alias("tokens"), T.snippet(F.col("text")).alias("snippet"))


@_query("SELECT item_id, replace(replace('Use {{context}} for {{query}}', '{{context}}', text || ' {{query}}'), '{{query}}', 'Q' || item_id) AS prompt FROM benchmark")
def prompt_render(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select("item_id", T.render_prompt(F.lit("Use {{context}} for {{query}}"), F.concat("text", F.lit(" {{query}}")), F.concat(F.lit("Q"), F.col("item_id").cast("string"))).alias("prompt"))


@_query("SELECT page_id, lower(trim(split_part(ct, ';', 1))) AS media_type, nullif(regexp_extract(lower(trim(split_part(ct, ';', 1))), '^(?:text|application)/x-(.+)$', 1), '') AS language FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN 'text/x-Rust' ELSE ' application/pdf ;a=b' END AS ct FROM pages)")
def mime_types(spark, sf_dir):
    kind = F.when(F.col("page_id") % 3 == 0, "Text/HTML; charset=utf-8").when(F.col("page_id") % 3 == 1, "text/x-Rust").otherwise(" application/pdf ;a=b")
    return _read(spark, sf_dir, "pages").select("page_id", T.mime(kind).alias("media_type"), T.code_language(kind).alias("language"))


# --------------------------------------------------------------------------------------------- vectors and fusion


@_query(f"WITH {_COS} SELECT vec_id, round(cos, 6) AS cos FROM c ORDER BY c.cos DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    scored = retrieve.vector_scores(_vectors(spark, sf_dir), VECTOR).where("cos IS NOT NULL")
    return retrieve.top(scored, 10, "cos").select(F.col("id").alias("vec_id"), *_six("cos"))


_NEAR = f"WITH {_COS}, k AS (SELECT * FROM c ORDER BY cos DESC, vec_id LIMIT 80), m AS (SELECT vec_id, cos, (cos - (SELECT min(cos) FROM k)) / (SELECT max(cos) - min(cos) FROM k) score FROM k)"


@_query(f"{_NEAR} SELECT vec_id, round(score, 6) AS score, printf('vector match (cosine=%.3f)', cos) AS reason FROM m ORDER BY m.score DESC, vec_id LIMIT 10")
def vector_minmax(spark, sf_dir):
    return retrieve.vector_search(_vectors(spark, sf_dir), VECTOR, 10).select(F.col("id").alias("vec_id"), *_six("score"), "reason")


@_query(f"{_NEAR} SELECT vec_id, round(score, 6) AS score FROM m WHERE m.score >= 0.5 ORDER BY m.score DESC, vec_id LIMIT 10")
def vector_min_score(spark, sf_dir):
    return retrieve.vector_search(_vectors(spark, sf_dir), VECTOR, 10, min_score=0.5).select(F.col("id").alias("vec_id"), *_six("score"))


@_query(f"WITH {_COS} SELECT vec_id, round(cos, 6) AS cos FROM c WHERE label = 3 ORDER BY c.cos DESC, vec_id LIMIT 10")
def vector_tenant_topk(spark, sf_dir):
    mine = _vectors(spark, sf_dir).where(F.col("tenant_id") == "3")
    scored = retrieve.vector_scores(mine, VECTOR).where("cos IS NOT NULL")
    return retrieve.top(scored, 10, "cos").select(F.col("id").alias("vec_id"), *_six("cos"))


_QUERY_SLOTS = hash_slots([WORDS])[0].tolist()
_DOC_COS = f"""qv AS (SELECT i AS slot, {_QUERY_SLOTS}[i + 1]::DOUBLE qv FROM range(64) r(i)),
cc AS (SELECT doc_id, sum(v * qv)::DOUBLE / (sqrt(sum(v * v)::DOUBLE) * sqrt({sum(x * x for x in _QUERY_SLOTS)}::DOUBLE)) cos FROM s JOIN qv USING (slot) GROUP BY doc_id HAVING sum(v * v) > 0)"""
_POOL = f"""{_BM25}, {_SLOTS}, {_DOC_COS}, near AS (SELECT doc_id FROM cc ORDER BY cos DESC, doc_id LIMIT 80),
pool AS (SELECT d.doc_id, cos, coalesce(bm25, 0) bm25 FROM d LEFT JOIN cc USING (doc_id) LEFT JOIN b USING (doc_id) WHERE b.bm25 > 0 OR d.doc_id IN (SELECT doc_id FROM near)),
r AS (SELECT *, row_number() OVER (ORDER BY cos DESC NULLS LAST, doc_id) vr0, row_number() OVER (ORDER BY bm25 DESC, doc_id) tr0, count(*) OVER () n FROM pool),
f AS (SELECT doc_id, CASE WHEN cos IS NULL THEN n + 1 ELSE vr0 END vr, CASE WHEN bm25 > 0 THEN tr0 ELSE n + 1 END tr FROM r)"""


def _hybrid(spark: SparkSession, sf_dir: str, top_k: int = 10) -> DataFrame:
    counted = retrieve.with_term_counts(_entries(spark, sf_dir).select("id", "text"), WORDS, found="found").drop("text")
    made = with_hash_embedding(counted, found="found").withColumn("embedding", F.col("slots").cast("array<double>")).drop("slots")
    return retrieve.hybrid_search(made, WORDS, [float(x) for x in _QUERY_SLOTS], top_k, counted=True)


@_query(f"WITH {_POOL} SELECT doc_id, round(1.0::DOUBLE/(60+vr) + 1.0::DOUBLE/(60+tr), 6) AS score, 'hybrid/rrf(vector_rank=' || vr || ', text_rank=' || tr || ')' AS reason FROM f ORDER BY 1.0::DOUBLE/(60+vr) + 1.0::DOUBLE/(60+tr) DESC, doc_id LIMIT 10")
def hybrid_rrf(spark, sf_dir):
    return _hybrid(spark, sf_dir).select(F.col("id").alias("doc_id"), *_six("score"), "reason")


_NORM = "(bm25 - (SELECT min(bm25) FROM b)) / (SELECT max(bm25) - min(bm25) FROM b)"


@_query(f"WITH {_BM25}, w AS (SELECT doc_id, {_NORM} * (1 + 0.4::DOUBLE * (coalesce(quality::DOUBLE, 0.5::DOUBLE) - 0.5::DOUBLE)) score FROM b LEFT JOIN labels USING (doc_id)) SELECT doc_id, round(score, 6) AS score FROM w ORDER BY w.score DESC, doc_id LIMIT 20")
def confidence_weighted(spark, sf_dir):
    trust = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("confidence"))
    with retrieve.held_scores(_entries(spark, sf_dir), WORDS, "id") as scored:
        joined = retrieve.min_max(scored, "bm25").join(trust, "id", "left").withColumn("score", retrieve.confidence_weight(F.col("score"), F.lit("memory"), F.col("confidence")))
        best = retrieve.top(joined, 20).select(F.col("id").alias("doc_id"), *_six("score"))
        return spark.createDataFrame(best.collect(), best.schema)


_CHUNKED = _BM25.replace("FROM documents)", "FROM ck)", 1).replace("doc_id", "cid")
_CK = f"ck0 AS (SELECT doc_id, {_SPLIT} tk FROM documents), ck AS (SELECT doc_id, doc_id || '#' || o AS cid, array_to_string(tk[o*48+1 : o*48+48], ' ') AS text FROM ck0, LATERAL (SELECT unnest(range(0, ceil(len(tk)/48.0)::BIGINT)) o))"


@_query(f"WITH {_CK}, {_CHUNKED}, n AS (SELECT d.doc_id, cid, bm25, row_number() OVER (PARTITION BY d.doc_id ORDER BY bm25 DESC, cid) rn FROM b JOIN d USING (cid)) SELECT doc_id, cid AS chunk_id, round(bm25, 6) AS score FROM n WHERE rn = 1 ORDER BY bm25 DESC, cid LIMIT 50")
def dedup_best_chunk(spark, sf_dir):
    chunks = _entries(spark, sf_dir).select(F.col("id").alias("document_id"), F.posexplode(T.chunks(F.col("text"))).alias("o", "text"))
    entries = chunks.select("document_id", F.concat_ws("#", F.col("document_id").cast("string"), F.col("o").cast("string")).alias("id"), "text", F.lit("document_chunk").alias("kind"))
    with retrieve.held_scores(entries, WORDS, "document_id", "id", "kind") as scored:
        best = retrieve.top(retrieve.best_chunk(scored.withColumnRenamed("bm25", "score")), 50)
        best = best.select(F.col("document_id").alias("doc_id"), F.col("id").alias("chunk_id"), *_six("score"))
        return spark.createDataFrame(best.collect(), best.schema)


_PICKS = "p1 AS (SELECT vec_id FROM m ORDER BY score DESC, cos DESC, vec_id LIMIT 1)"
for _n in range(2, 6):
    _done = f"p{_n - 1}"
    _PICKS += f""", p{_n} AS (SELECT vec_id FROM {_done} UNION ALL (SELECT vec_id FROM (SELECT m.vec_id, m.score, 0.5::DOUBLE * m.score - 0.5::DOUBLE * greatest(0::DOUBLE, (SELECT max(s) FROM sim WHERE a = m.vec_id AND b IN (SELECT vec_id FROM {_done}))) v
        FROM m WHERE m.vec_id NOT IN (SELECT vec_id FROM {_done})) ORDER BY v DESC, score DESC, vec_id LIMIT 1))"""
_PLACES = " UNION ALL ".join(f"SELECT vec_id, {n}::BIGINT AS place FROM p{n}" + (f" WHERE vec_id NOT IN (SELECT vec_id FROM p{n - 1})" if n > 1 else "") for n in range(1, 6))


@_query(
    f"""{_NEAR}, e AS (SELECT vec_id, embedding::DOUBLE[] x FROM embeddings JOIN m USING (vec_id)),
    sim AS (SELECT a.vec_id a, b.vec_id b, list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) s FROM e a, e b), {_PICKS}, o AS ({_PLACES})
    SELECT vec_id, place, round(score, 6) AS score FROM o JOIN m USING (vec_id)"""
)
def mmr_top5(spark, sf_dir):
    """Five picks from the pool of a search for the best ten."""
    found = retrieve.vector_search(_vectors(spark, sf_dir), VECTOR, None, pool=retrieve.fetch_k(10))
    return retrieve.mmr(found, 5, 0.5).select(F.col("id").alias("vec_id"), "place", *_six("score"))


@_query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def metadata_and_filter(spark, sf_dir):
    return _entries(spark, sf_dir).where(Filter("fr", metadata={"lang": "fr", "source": "src3"}).column()).select(F.col("id").alias("doc_id"))


# --------------------------------------------------------------------------------------------- context


def _ranked(spark: SparkSession, sf_dir: str, top_k: int = 20) -> DataFrame:
    """The best documents by BM25, with rank and min-max score."""
    hits = retrieve.text_search(_entries(spark, sf_dir).select("id", "text", "tenant_id", "collection"), WORDS, top_k)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25"), "id")))


_RANKED = f"{_BM25}, k AS (SELECT doc_id, bm25, {_NORM} score, row_number() OVER (ORDER BY bm25 DESC, doc_id) rank FROM b), hits AS (SELECT k.*, text, source FROM k JOIN documents USING (doc_id) WHERE rank <= 20)"


@_query(
    f"""WITH {_RANKED}, l AS (SELECT list({{'r': rank, 't': ceil(strlen('[document:' || doc_id || ']' || chr(10) || text)/4.0)::BIGINT, 'd': doc_id}} ORDER BY rank) x FROM hits),
    k2 AS (SELECT list_reduce(list_transform(x, lambda v: {{'u': v.t, 'k': [v.d]}}), lambda a, c: CASE WHEN a.u + c.u > {BUDGET} THEN a ELSE {{'u': a.u + c.u, 'k': list_concat(a.k, c.k)}} END, {{'u': 0::BIGINT, 'k': []::BIGINT[]}}).k kept FROM l)
    SELECT doc_id, rank, ceil(strlen('[document:' || doc_id || ']' || chr(10) || text)/4.0)::BIGINT AS tokens FROM hits, k2 WHERE list_contains(kept, doc_id)"""
)
def context_pack(spark, sf_dir):
    hits = _ranked(spark, sf_dir).withColumn("kind", F.lit("document"))
    return context.pack(hits, BUDGET).select(F.col("id").alias("doc_id"), "rank", "tokens")


@_query(
    f"""WITH {_RANKED}, t AS (SELECT user_id, max(epoch_us(ts)) // 1000 ms FROM events GROUP BY user_id),
    m AS (SELECT doc_id, score / (SELECT max(score) FROM hits) s, ms FROM hits LEFT JOIN t ON user_id = doc_id % 200)
    SELECT doc_id, round(s * 0.7::DOUBLE + 0.3::DOUBLE * CASE WHEN ms IS NULL THEN 0.5::DOUBLE ELSE exp(-greatest(0::DOUBLE, ({NOW_MS}::DOUBLE - ms) / 86400000::DOUBLE) / {TAU_DAYS}::DOUBLE) END, 6) AS score FROM m"""
)
def context_blend_decay(spark, sf_dir):
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    touched = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.floor(F.max(micros) / 1000).alias("ms"))
    hits = context.normalised(_ranked(spark, sf_dir)).join(touched, F.col("user_id") == F.col("id") % 200, "left")
    return hits.select(F.col("id").alias("doc_id"), F.round(context.decay(F.col("score"), 0.3, NOW_MS, F.col("ms"), TAU_DAYS), 6).alias("score"))


@_query(
    f"""WITH {_RANKED}, l AS (SELECT a.doc_id, count(*) c FROM hits a JOIN hits b ON a.source = b.source AND a.doc_id <> b.doc_id GROUP BY a.doc_id)
    SELECT doc_id, round(CASE WHEN (SELECT count(*) FROM hits) > 1 THEN score * 0.6::DOUBLE + 0.4::DOUBLE * least(1::DOUBLE, coalesce(c, 0)::DOUBLE / ((SELECT count(*) FROM hits) - 1)) ELSE score END, 6) AS score FROM hits LEFT JOIN l USING (doc_id)"""
)
def context_connectivity(spark, sf_dir):
    hits = _ranked(spark, sf_dir)
    few = hits.select("id", "collection")
    left, right = few.toDF("from_id", "c"), few.toDF("to_id", "c2")
    pairs = left.join(right, (F.col("c") == F.col("c2")) & (F.col("from_id") < F.col("to_id")))  # edges among 20 hits of one source
    edges = pairs.select("from_id", "to_id", F.lit(0).alias("seq"), F.lit("e").alias("id"))
    return context.connectivity(hits, edges, 0.4).select(F.col("id").alias("doc_id"), *_six("score"))


@_query(
    f"""WITH {_RANKED}, e AS (SELECT doc_id, rank, 0.7::DOUBLE * score + 0.3::DOUBLE * coalesce(quality::DOUBLE, 0.5::DOUBLE) eff, toxic FROM hits LEFT JOIN labels USING (doc_id))
    SELECT doc_id, rank AS old_rank, row_number() OVER (ORDER BY CASE WHEN (SELECT max(toxic) FROM e) = 1 THEN eff END DESC NULLS LAST, rank, doc_id) AS new_rank FROM e"""
)
def contradiction_rerank(spark, sf_dir):
    trust = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("confidence"), "toxic")
    hits = _ranked(spark, sf_dir).join(trust, "id", "left").withColumn("kind", F.lit("memory"))
    hits = hits.withColumn("contradictions", F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return context.contradiction_rank(hits).select(F.col("id").alias("doc_id"), F.col("rank").cast("long").alias("old_rank"), F.col("new_rank").cast("long").alias("new_rank"))


@_query(
    """WITH rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    rk AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY n_chars DESC, doc_id) rank FROM rel JOIN documents USING (doc_id)),
    f AS (SELECT item_id, min(rank) FILTER (doc_id % 2 = 0) first FROM rk WHERE rank <= 5 GROUP BY item_id),
    c AS (SELECT DISTINCT item_id FROM rel WHERE doc_id % 2 = 0)
    SELECT count(*) AS cases, round(avg(coalesce((first = 1)::INT, 0)), 6) AS hit_at_1, round(avg(CASE WHEN first IS NULL THEN 0 ELSE 1 END), 6) AS hit_at_k, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM c LEFT JOIN f USING (item_id)"""
)
def eval_quality_metrics(spark, sf_dir):
    """Documents that hold a benchmark passage are ranked by length; those of even id are relevant. Passages meet documents by their first eight words."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    words = F.filter(F.split("text", T.SPACE), lambda t: t != "")
    lead = F.xxhash64(F.array_join(F.slice(words, 2, 6), " "))  # inner words of a passage: its ends may touch others
    items = _read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case"), F.col("text").alias("passage"), lead.alias("key"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 5, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 6), " ")))
    spots = docs.select("doc_id", words.alias("w")).select("doc_id", F.explode(F.array_distinct(grams)).alias("key"))
    pairs = spots.join(items.select("case", "key"), "key").select("case", "doc_id").distinct()
    found = pairs.join(docs, "doc_id").join(items.select("case", "passage"), "case").where(F.contains("text", F.col("passage")))
    rank = F.row_number().over(Window.partitionBy("case").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = found.select("case", F.col("doc_id").alias("id"), rank.alias("rank"))
    out = report.quality(ranked, ranked.where("id % 2 = 0").select("case", "id"), 5)
    return out.select("cases", *_six("hit_at_1", "hit_at_k", "mrr"))
