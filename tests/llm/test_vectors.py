import numpy as np
import pytest

from recallforge.llm import embedding_dedup, queries, topk

SCHEMA = "vec_id long, embedding array<float>, node string, row string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", "r", "k") for i, v in rows], SCHEMA).repartition(3)


def brute_links(rows, threshold=0.9):
    """n_links and component of each row."""
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    width = max((len(v) for _, v in rows if v), default=0)
    vec = [np.pad(np.array(v, np.float32).astype(float), (0, width - len(v))) if good(v) else None for _, v in rows]
    link = [[j for j in range(len(rows)) if i != j and vec[i] is not None and vec[j] is not None and vec[i] @ vec[j] / (np.linalg.norm(vec[i]) * np.linalg.norm(vec[j])) >= threshold] for i in range(len(rows))]
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(link[i]), min(rows[j][0] for j in seen)))
    return out


def clustered(n=150, seed=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, 24))
    rows = [(i, (centre[r.integers(12)] + r.normal(size=24) * r.choice([0.05, 0.2, 3])).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(20)]  # equal vectors
    rows += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None, 1.0]), (1005, [float("inf"), 1.0]), (1006, [x * 1e-30 for x in rows[0][1]]), (1007, rows[0][1][:20])]
    return rows


@pytest.mark.parametrize("block", [2048, 8])
def test_links_and_components(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)  # with 8, buckets are dealt into blocks that meet two by two
    rows = clustered()
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame(spark, rows)).collect()}
    want = brute_links(rows)
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(n for _, n, _ in want)
    assert all(got[i].n_links <= n for i, n, _ in want)
    sure = [w for w in want if got[w[0]].n_links == w[1]]
    assert len(sure) > 0.95 * len(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(1000, 1006))


def test_recall_at_the_threshold(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(300):  # pairs at a cosine a little above 0.9
        a = r.normal(size=64)
        a /= np.linalg.norm(a)
        b = r.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.902 * a + np.sqrt(1 - 0.902**2) * b).tolist())]
    got = sum(x.n_links for x in embedding_dedup.near_duplicates(frame(spark, rows)).collect())
    want = sum(n for _, n, _ in brute_links(rows))
    assert 0.95 * want <= got <= want


def test_every_link_counts_once_however_the_rows_are_dealt(spark):
    """One crowded cluster, in many tables and blocks: with enough tables for its pairs, all links and each once."""
    r = np.random.default_rng(8)
    base = r.normal(size=16)
    rows = [(i, (base + r.normal(size=16) * 0.05).tolist()) for i in range(300)] + [(500, [1e300, 1e-300, 0.1]), (501, [2e300, 2e-300, 0.2])]
    got = {x.vec_id: (x.n_links, x.component_id) for x in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)).collect()}
    assert got == {**{i: (299, 0) for i in range(300)}, 500: (1, 500), 501: (1, 500)}


def test_packed_vectors_are_exact():
    for v in ([1.5, 0.0, 0.0], [0.1, 1e300], [1e-300], [float(np.float32(0.1))]):
        assert embedding_dedup.unpacked([embedding_dedup.packed(np.array(v))], 5)[0].tolist() == v + [0.0] * (5 - len(v))


def test_embedding_edges(spark):
    assert embedding_dedup.near_duplicates(frame(spark, [(1, [1.0])]).where("false")).collect() == []
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in embedding_dedup.near_duplicates(frame(spark, [(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, None)])).collect())
    assert got == [("4", 2, "4"), ("4", 2, "4"), ("None", 0, "None"), ("None", 2, "4")]


def top_doubles(spark, rows):
    return sorted((tuple(r) for r in topk.top(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), key=str)


def brute_top(rows, k=5, every=50, single=True):
    kind = np.float32 if single else np.float64
    good = [(i, n, [int(np.floor(256 * float(kind(x)))) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, v in good:
        if i is None or i % every:
            continue
        scored = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(v, w)))), (j is None, j), j) for j, m, w in good if m != n)
        out += [(i, place + 1, j, -s) for place, (s, _, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def top(spark, rows, **k):
    return sorted((tuple(r) for r in topk.top(frame(spark, rows), **k).select("query_id", "rank", "vec_id", "score").collect()), key=str)


@pytest.mark.parametrize("block", [8192, 40])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    if block == 40:  # groups of about two queries, slices of a few candidates
        monkeypatch.setattr(topk, "GROUP", 256)
        monkeypatch.setattr(topk, "SLICE", 7)
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=16) * r.choice([0.1, 1, 10])).tolist()) for i in range(400)]
    rows += [(400 + i, rows[7][1]) for i in range(9)]  # ties
    rows += [(450, None), (500, [float("nan")] * 16), (550, [0.0] * 16), (600, [1.0] * 3), (650, []), (0, rows[0][1]), (None, rows[50][1])]
    assert top(spark, rows) == brute_top(rows)


def test_top_k_edges(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0])]
    assert top(spark, rows) == [(0, 1, 1, 256 * 256 * 5)]
    assert topk.top(frame(spark, rows).where("false")).collect() == []
    huge = [(50, [1e300, -1e300]), (1, [1e300, 1e299]), (2, [-1e300, 1e300]), (3, [1e10, 1e10]), (100, [1.0, 2.0]), (4, [3e9, 3e9])]
    got = top_doubles(spark, huge)
    assert got == brute_top([(i, v) for i, v in huge], single=False)
    assert top(spark, [(50, [1e9, 1e9]), (1, [1e9, -1e9]), (2, [1e9, 1e8])]) == brute_top([(50, [1e9, 1e9]), (1, [1e9, -1e9]), (2, [1e9, 1e8])])


def test_short_vectors_are_never_searched(spark, monkeypatch):
    """Once a group's thresholds are out of reach, shorter candidates are left alone: one wave of several is read."""
    monkeypatch.setattr(topk, "BLOCK", 20)
    waves, search = [], topk._search
    monkeypatch.setattr(topk, "_search", lambda wave, group: (waves.append(len(group.row)), search(wave, group))[1])
    r = np.random.default_rng(9)
    rows = [(i, (np.ones(8) * 50 + r.normal(size=8)).tolist()) for i in range(20)] + [(i, (r.normal(size=8) * 0.1).tolist()) for i in range(20, 400)]
    got = top(spark, rows)
    assert got == brute_top(rows) and waves[0] == 8 and waves[1:] and max(waves[1:]) < 8


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    import duckdb

    for sf in ("sf0.01", "sf0.1"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
        want = con.execute(queries.ORACLE[name]).df()
        got = queries.QUERIES[name](spark, f"/root/testdata/{sf}").toPandas()
        assert (got.dtypes[want.columns] == want.dtypes).all()
        assert sorted(got[want.columns].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
