"""One thin query for each operator, over the whole of its table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from recallforge.llm import embedding_dedup, html, langid, lm, mixing, packing, quality, simhash, token_files, topk
from recallforge.llm.common import table


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language(table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_simhash_dedup, op3_embedding_dedup, op4_mix_sources, op5_quality, op6_lm_score, op7_pack, op8_topk_search, op9_langid, op10_token_files)}

_V = "v AS (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"
#: Where SQL can express the rows. The others hash, learn, tokenize or draw; the tests hold them against brute force, round trips or held-out accuracy.
ORACLE: dict[str, str] = {
    "op3_embedding_dedup": f"""WITH RECURSIVE {_V}, u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) n FROM v WHERE list_dot_product(e, e) > 0),
        l AS (SELECT a.vec_id a, b.vec_id b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        o AS (SELECT vec_id, (SELECT count(*) FROM l WHERE a = vec_id) n_links, least(vec_id, coalesce((SELECT min(b) FROM r WHERE a = vec_id), vec_id)) component_id FROM embeddings)
        SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM o""",
    "op8_topk_search": f"""WITH {_V}, i AS (SELECT vec_id, list_transform(e, lambda x: floor(256 * x)) e FROM v),
        s AS (SELECT q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT score FROM i q JOIN i c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) n FROM s)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5""",
}
