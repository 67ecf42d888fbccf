"""Vector, text and hybrid retrieval over a table of entries.

Entries have an id column and whatever a step needs (text, embedding, kind, confidence, document_id). Every ranking ends in
the id, so ties have one order. Corpus statistics and query constants are single rows, read once and put into the plan as literals; the
scoring is then one projection over the scan, and only the candidates are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recallforge.functions.text import let, token_count, tokens
from recallforge.functions.vector import cosine, cosine_to, literal

K1, B, RRF, EPSILON = 1.2, 0.75, 60, 1.1920929e-07
MODES = {"vector": "vector", "vec": "vector", "text": "text", "bm25": "text", "lexical": "text", "hybrid": "hybrid", "both": "hybrid"}


def mode(name: str) -> str:
    try:
        return MODES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown search mode: {name}") from None


def fetch_k(top_k: int) -> int:
    """Candidates taken before fusion."""
    return max(8 * top_k, top_k + 10)


@dataclass(frozen=True)
class CorpusStats:
    entries: int
    total: int
    df: dict[str, int]


def with_term_counts(entries: DataFrame, query: list[str], text: str = "text", found: str | None = None) -> DataFrame:
    """entries with dl (tokens of the text) and tf (count of each query token), and with the tokens themselves in a column `found` if it is named."""
    wanted = F.array(*map(F.lit, query)).cast("array<string>")
    per_token = lambda hits: F.transform(wanted, lambda q: F.size(F.filter(hits, lambda t: t == q)))
    both = let(tokens(F.col(text)), lambda all_: F.struct(
        F.coalesce(F.size(all_), F.lit(0)).alias("dl"), let(F.filter(all_, lambda t: F.array_contains(wanted, t)), per_token).alias("tf"), *([all_.alias(found)] if found else [])
    ))
    # A generator is a fence for the optimizer: without it a later filter on the score would repeat all of this.
    spread = entries.select("*", F.explode(F.array(both)).alias("counted_"))
    return spread.select(*entries.columns, "counted_.*")


def corpus_stats(counted: DataFrame, query: list[str]) -> CorpusStats:
    """Number of entries, their tokens and the document frequency of each query token, over all of counted."""
    row = counted.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), *(F.coalesce(F.sum((F.col("tf")[i] > 0).cast("long")), F.lit(0)) for i in range(len(query)))).first()
    return CorpusStats(row[0], row[1], dict(zip(query, row[2:])))


def bm25(stats: CorpusStats, query: list[str], tf: str = "tf", dl: str = "dl") -> Column:
    """Sum over distinct query tokens, in their sorted order; 0 without a match."""
    mean = stats.total / stats.entries if stats.entries else 0.0
    out = F.lit(0.0)
    for i, token in enumerate(query):
        df = float(stats.df.get(token, 0))
        idf = F.log(1 + (F.lit(float(stats.entries)) - df + 0.5) / (df + 0.5))
        f = F.col(tf)[i].cast("double")
        share = K1 * (1 - B + B * F.col(dl) / F.lit(mean if mean else 1.0))
        out = out + F.when(f > 0, idf * f * (K1 + 1) / (f + share)).otherwise(0.0)
    return out


def text_scores(entries: DataFrame, query: list[str], keep: Column | None = None, text: str = "text", stats: CorpusStats | None = None) -> DataFrame:
    """entries (those that keep admits) with a bm25 column; the statistics are those of all entries, counted here if they are not given."""
    counted = with_term_counts(entries, query, text)
    stats = stats or corpus_stats(counted, query)
    return (counted if keep is None else counted.where(keep)).withColumn("bm25", bm25(stats, query)).drop("tf", "dl")


@contextmanager
def held_scores(entries: DataFrame, query: list[str], *columns: str, keep: Column | None = None, text: str = "text") -> Iterator[DataFrame]:
    """(columns, bm25) of the entries that keep admits and that hold a query token, for use inside the with block.

    Texts are tokenized once: the narrow rows with their counts are kept, spilled to disk where memory is short, and both the statistics of all
    entries and the scores are read from them. A lost block is made again from the entries.
    """
    admitted = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    held = with_term_counts(entries, query, text).select(*columns, admitted.alias("kept_"), "dl", "tf").persist()
    try:
        stats = corpus_stats(held, query)
        yield held.where("kept_").select(*columns, bm25(stats, query).alias("bm25")).where("bm25 > 0")
    finally:
        held.unpersist()


def text_top(entries: DataFrame, query: list[str], k: int, *columns: str, key: str = "id", keep: Column | None = None) -> DataFrame:
    """The k entries of the greatest BM25, then key: (key, columns, bm25). The k rows pass through the driver."""
    with held_scores(entries, query, key, *columns, keep=keep) as scored:
        return entries.sparkSession.createDataFrame(top(scored, k, "bm25", key).collect(), scored.schema)


def postings(entries: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """(token, key, f, dl): how often each token stands in each entry, and the entry's length. Counted within the entry, so nothing is shuffled."""
    def runs(t: Column) -> Column:
        # In the sorted list a token's count is the distance between its first place and that of the next token.
        first = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), i)), lambda i: i.isNotNull())
        return let(first, lambda s: F.transform(s, lambda at, i: F.struct(F.get(t, at).alias("token"), (F.coalesce(F.get(s, i + 1), F.size(t)) - at).alias("f"), F.size(t).alias("dl"))))

    found = entries.select(F.col(key).alias("key"), F.explode(let(F.sort_array(tokens(F.col(text))), runs)).alias("p"))
    return found.select("p.token", "key", "p.f", "p.dl")


def text_search_many(entries: DataFrame, queries: DataFrame, top_k: int = 10, text: str = "text", key: str = "id") -> DataFrame:
    """(query_id, rank, key, bm25) for a table of queries (query_id, query): the best top_k entries of each.

    One pass over the entries serves all queries: their tokens meet the distinct tokens of the queries (a semi join that drops the others
    before the counts are shuffled), and every ranking is a window of one query over its own candidates.
    """
    from recallforge.functions.text import normalised_query
    from recallforge.plans.session import scratch

    wanted = queries.select("query_id", F.explode(F.array_distinct(F.split(normalised_query(F.col("query")), " "))).alias("token")).where("token <> ''")
    lengths = entries.agg(F.count("*"), F.coalesce(F.sum(token_count(F.col(text))), F.lit(0))).first()
    n, mean = float(lengths[0]), lengths[1] / lengths[0] if lengths[0] and lengths[1] else 1.0
    found = entries.select(F.col(key).alias("key"), F.explode(F.array(tokens(F.col(text)))).alias("found_")).select("key", F.size("found_").alias("dl"), "found_")
    hits = found.select("key", "dl", F.explode("found_").alias("token")).join(wanted.select("token").distinct(), "token", "left_semi")
    hits = hits.groupBy("key", "dl", "token").agg(F.count("*").alias("f"))
    path = scratch(entries.sparkSession, "postings")
    hits.write.parquet(path)  # for the document frequencies and the scores: texts are not tokenized for each
    hits = entries.sparkSession.read.parquet(path)
    df = hits.groupBy("token").agg(F.count("*").cast("double").alias("df"))
    weight = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / mean))
    scored = hits.join(wanted.join(df, "token"), "token").groupBy("query_id", "key").agg(F.sum(weight).alias("bm25"))
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9)), "key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "rank", "key", "bm25")


def vector_scores(entries: DataFrame, query: list[float], column: str = "embedding") -> DataFrame:
    """entries with a cos column, null where the vector cannot be compared."""
    return entries.select("*", F.explode(F.array(cosine_to(F.col(column), query))).alias("cos"))  # a fence, as in with_term_counts


def min_max(df: DataFrame, raw: str, score: str = "score") -> DataFrame:
    """raw brought to 0..1 over the rows of df; 1 where all are alike. The two bounds are one row, broadcast."""
    bounds = df.agg(F.min(raw).alias("low_"), F.max(raw).alias("high_"))
    span = F.col("high_") - F.col("low_")
    scaled = F.when(span.isNull() | (span <= EPSILON), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(raw) - F.col("low_")) / span)))
    return df.join(F.broadcast(bounds)).withColumn(score, scaled).drop("low_", "high_")


def top(df: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(k)


def vector_search(entries: DataFrame, query: list[float], top_k: int | None = 10, key: str = "id", keep: Column | None = None, min_score: float | None = None, pool: int | None = None) -> DataFrame:
    """The nearest `pool` entries by cosine (fetch_k(top_k) unless given), scored by min-max over them, then the best top_k; None keeps the whole pool."""
    scored = vector_scores(entries if keep is None else entries.where(keep), query).where("cos IS NOT NULL")
    near = min_max(scored.orderBy(F.desc("cos"), key).limit(fetch_k(top_k) if pool is None else pool), "cos")
    near = near.withColumn("reason", F.format_string("vector match (cosine=%.3f)", "cos"))
    if min_score is not None:
        near = near.where(F.col("score") >= min_score)
    return near if top_k is None else near.orderBy(F.desc("score"), F.desc("cos"), key).limit(top_k)


def text_search(entries: DataFrame, query: list[str], top_k: int | None = 10, key: str = "id", keep: Column | None = None, min_score: float | None = None) -> DataFrame:
    """All entries with a query token, scored by min-max of BM25 over them, then the best top_k; None keeps them all, in no order.

    With top_k the texts are tokenized once and the best keys, which are unique, meet the entries again; the score grows with BM25, so they are the same.
    """
    if top_k is None:
        matched = min_max(text_scores(entries, query, keep).where("bm25 > 0"), "bm25").withColumn("reason", F.lit("text match (bm25)"))
        return matched if min_score is None else matched.where(F.col("score") >= min_score)
    with held_scores(entries, query, key, keep=keep) as scored:
        best = min_max(scored, "bm25").where(F.lit(True) if min_score is None else F.col("score") >= min_score)
        best = best.orderBy(F.desc("bm25"), key).limit(top_k)
        few = entries.sparkSession.createDataFrame(best.collect(), best.schema).withColumn("reason", F.lit("text match (bm25)"))
    found = entries.join(F.broadcast(few), key).select(*entries.columns, "bm25", "score", "reason")  # top_k rows
    return found.orderBy(F.desc("score"), F.desc("bm25"), key).limit(top_k)


def ranks_of(pool: DataFrame, few: list, raw: str, key: str) -> dict:
    """Exact rank, by descending raw and then key, among all rows of pool, for each of the few rows given.

    Each row of pool is counted into the gap between two of the few, and the counts are added up: one pass and an
    aggregate of at most len(few) + 1 groups instead of a global sort.
    """
    order = sorted((r for r in few if r[raw] is not None), key=lambda r: (-r[raw], r[key]))
    if not order:
        return {}
    marks = F.arrays_zip(F.lit([float(r[raw]) for r in order]), F.lit([r[key] for r in order]))
    at_or_before = lambda s: (s["0"] > F.col(raw)) | ((s["0"] == F.col(raw)) & (s["1"] <= F.col(key)))
    gaps = {r[0]: r[1] for r in pool.where(F.col(raw).isNotNull()).groupBy(F.size(F.filter(marks, at_or_before))).count().collect()}
    out, before = {}, 0
    for i, r in enumerate(order):
        before += gaps.get(i, 0)
        out[r[key]] = before + 1
    return out


def ranked(pool: DataFrame, raw: str, key: str, rank: str) -> DataFrame:
    """(key, rank) of all rows of pool with a raw value, by descending raw and then key; sorted in ranges and numbered from the ranges' sizes."""
    row = pool.where(F.col(raw).isNotNull()).orderBy(F.desc(raw), key).select(key).rdd.zipWithIndex().map(lambda x: (x[0][0], x[1] + 1))
    return pool.sparkSession.createDataFrame(row, f"{key} {dict(pool.dtypes)[key]}, {rank} long")


def hybrid_search(entries: DataFrame, query: list[str], vector: list[float], top_k: int = 10, key: str = "id", keep: Column | None = None, whole: bool = False, pool: int | None = None, counted: bool = False) -> DataFrame:
    """Reciprocal rank fusion of the nearest `pool` entries by cosine (fetch_k(top_k) unless given) and all entries with a query token; the best top_k.

    A null cosine and a BM25 of 0 are unranked: one more than the number of candidates. A row beyond place 2 * top_k + 60 of both lists scores
    less than 1 / (60 + top_k), which the first top_k of a list reach, so only the heads of the two lists (a bounded number of rows) are
    fused, with their exact ranks among all candidates. With whole, every candidate comes back, in no order.
    Entries are read once; with counted they have the columns of with_term_counts already, counted for this query.
    """
    admitted = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    near_to = F.when(admitted, cosine_to(F.col("embedding"), vector))
    counts = entries if counted else with_term_counts(entries, query)
    held = counts.select(key, F.explode(F.array(near_to)).alias("cos"), admitted.alias("kept_"), "dl", "tf").persist()
    try:
        scored = held.where("kept_").select(key, "cos", bm25(corpus_stats(held, query), query).alias("bm25"))
        near = scored.where("cos IS NOT NULL").orderBy(F.desc("cos"), key).limit(fetch_k(top_k) if pool is None else pool).collect()
        last = near[-1] if near else None
        if last is None:
            among = F.lit(False)
        else:
            among = F.coalesce((F.col("cos") > last.cos) | ((F.col("cos") == last.cos) & (F.col(key) <= last[key])), F.lit(False))
        pooled = scored.where(among | (F.col("bm25") > 0)).withColumn("hit", F.when(F.col("bm25") > 0, F.col("bm25")))
        if whole:
            none = F.lit(pooled.count() + 1)
            out = pooled.drop("hit").join(ranked(pooled, "cos", key, "vector_rank"), key, "left").join(ranked(pooled, "hit", key, "text_rank"), key, "left")
            out = out.withColumns({c: F.coalesce(c, none) for c in ("vector_rank", "text_rank")})
            score = 1.0 / (RRF + F.col("vector_rank")) + 1.0 / (RRF + F.col("text_rank"))
            return out.withColumns({"score": score, "reason": F.format_string("hybrid/rrf(vector_rank=%d, text_rank=%d)", "vector_rank", "text_rank")})
        depth = 2 * top_k + RRF
        heads = [pooled.where(F.col(c).isNotNull()).orderBy(F.desc(c), key).limit(depth).collect() for c in ("cos", "hit")]
        few = list({r[key]: r for rows in heads for r in rows}.values())
        vector_rank, text_rank, n = ranks_of(pooled, few, "cos", key), ranks_of(pooled, few, "hit", key), pooled.count()
    finally:
        held.unpersist()
    rows = []
    for r in few:
        v, t = vector_rank.get(r[key], n + 1), text_rank.get(r[key], n + 1)
        rows.append((r[key], r.cos, r.bm25, v, t, 1.0 / (RRF + v) + 1.0 / (RRF + t), f"hybrid/rrf(vector_rank={v}, text_rank={t})"))
    rows.sort(key=lambda r: (-r[5], r[0]))
    kind = dict(entries.dtypes)[key]
    return entries.sparkSession.createDataFrame(rows[:top_k], f"{key} {kind}, cos double, bm25 double, vector_rank long, text_rank long, score double, reason string")


def confidence_weight(score: Column, kind: Column, confidence: Column) -> Column:
    """Memories count 0.8 to 1.2 fold by confidence; 0.5 where it is unknown."""
    return F.when(kind == "memory", score * (1 + 0.4 * (F.coalesce(confidence, F.lit(0.5)) - 0.5))).otherwise(score)


def best_chunk(df: DataFrame, document: str = "document_id", key: str = "id") -> DataFrame:
    """Of each document its best chunk; rows of other kinds stay."""
    w = Window.partitionBy(document).orderBy(F.desc("score"), key)
    chunks = df.where("kind = 'document_chunk'").withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")
    return chunks.unionByName(df.where("kind <> 'document_chunk'"))


def matched_terms(text: Column, query: list[str]) -> Column:
    wanted = F.array(*map(F.lit, query)).cast("array<string>")
    return F.array_sort(F.array_intersect(F.array_distinct(tokens(text)), wanted))


def mmr(candidates: DataFrame, k: int, weight: float = 0.5, key: str = "id") -> DataFrame:
    """Maximal marginal relevance over a bounded set of candidates (key, score, embedding): the k picked, with their place.

    Each pick has the greatest weight * score - (1 - weight) * greatest cosine to what is picked, at least 0. Without an embedding the
    similarity is 1 once something with one is picked. Ties go to the higher score, then the key. The fold is
    sequential, so it runs in one task over the candidates (fetch_k of one query).
    """
    import numpy as np
    import pandas as pd

    lam = min(1.0, max(0.0, weight))

    def fold(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["score", key], ascending=[False, True], ignore_index=True)
        vec = [None if v is None or not len(v) or not np.any(v) else np.asarray(v, float) / np.linalg.norm(v) for v in f["embedding"]]
        left, picked = list(range(len(f))), []
        while left and len(picked) < k:
            seen = [vec[j] for j in picked if vec[j] is not None]

            def value(i: int) -> float:
                if vec[i] is None:
                    near = 1.0 if seen else 0.0
                else:
                    near = max([0.0, *(float(vec[i] @ s) for s in seen if len(s) == len(vec[i]))])
                return lam * f["score"][i] - (1 - lam) * near

            best = max(left, key=lambda i: (value(i), -i))
            picked.append(best)
            left.remove(best)
        out = f.iloc[picked][[key, "score"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    kinds = dict(candidates.dtypes)
    return candidates.select(key, "score", "embedding", F.lit(1).alias("one_")).groupBy("one_").applyInPandas(fold, f"{key} {kinds[key]}, score double, place long")


def mmr_of_all(candidates: DataFrame, k: int, weight: float = 0.5, key: str = "id") -> DataFrame:
    """As mmr, over any number of candidates: each pick is one pass over them, and only the pick reaches the driver."""
    lam = min(1.0, max(0.0, weight))
    pool = candidates.select(key, "score", "embedding").persist()
    picked, seen = [], []
    try:
        while len(picked) < k:
            alike = [F.coalesce(cosine(F.col("embedding"), literal(v)), F.lit(0.0)) for v in seen]
            near = F.greatest(F.lit(0.0), F.lit(0.0), *alike)
            comparable = F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
            value = lam * F.col("score") - (1 - lam) * F.when(comparable, near).otherwise(1.0 if seen else 0.0)
            best = pool.where(~F.col(key).isin([r[key] for r in picked])).orderBy(F.desc(value), F.desc("score"), key).first()
            if best is None:
                break
            picked.append(best)
            if best.embedding and any(best.embedding):
                seen.append([float(x) for x in best.embedding])
    finally:
        pool.unpersist()
    rows = [(r[key], float(r.score), i + 1) for i, r in enumerate(picked)]
    return candidates.sparkSession.createDataFrame(rows, f"{key} {dict(candidates.dtypes)[key]}, score double, place long")
