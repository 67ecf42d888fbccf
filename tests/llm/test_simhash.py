import numpy as np
import xxhash

from recallforge.llm import common, simhash
from recallforge.llm import components as components_of
from recallforge.llm.components import components
from tests.llm.conftest import ODD


def slow(text):
    words = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, ids, radius=4):
    parent = {i: i for i in range(len(fps))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(fps)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprints_and_odd_rows(docs):
    texts = [*ODD[:7], *ODD[8:], "A b C d e", "a B c d E", "one two three", " ".join(f"w{i % 9}" for i in range(500))]
    for t in texts:
        assert simhash.fingerprint((t or "").encode()) == slow(t)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(*texts)).collect()}
    assert len(got) == len(texts)
    want = groups([slow(t) for t in texts], list(range(len(texts))))
    assert [got[i].component_id for i in range(len(texts))] == want
    assert got[0].fingerprint == "0" * 16 and got[5].component_id == 4


def test_nulls_repeats_and_empty_tables(docs, spark):
    t = simhash.near_duplicates(docs("a b c d e", "a b c d e", None, "z", ids=[3, 3, None, None]))
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in t.collect()))) == sorted(["(3, 3)", "(3, 3)", "(None, None)", "(None, None)"])
    assert simhash.near_duplicates(docs("x").where("false")).collect() == []


def test_links_are_all_found(spark):
    r = np.random.default_rng(1)
    base = [int(x) for x in r.integers(0, 1 << 63, 60)]
    fps = set(base)
    for x in base:  # neighbours at every distance up to 6, bits at the ends of segments among them
        for d in range(1, 7):
            y = x
            for b in r.choice(64, d, replace=False):
                y ^= 1 << int(b)
            fps.add(y)
    fps |= {base[0] ^ (1 << 12) ^ (1 << 13) ^ (1 << 51) ^ (1 << 63), base[0] ^ 0b1111, base[0] ^ (0b1111 << 60)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for radius, segments in ((4, 2), (2, 2), (4, 3)):
        got = {(x.a, x.b) for x in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, segments).collect()}
        want = {(min(x, y), max(x, y)) for x in signed for y in signed if x != y and bin((x ^ y) & (1 << 64) - 1).count("1") <= radius}
        assert got == want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (200, 300)] + [(500, x) for x in range(501, 540)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[95] == 90 and got[300] == 200 and got[539] == 500
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_longer_keys_for_more_fingerprints():
    assert {len(simhash.spellings(i, 2)) for i in range(5)} == {13, 14} and len(simhash.spellings(0, 3)) == 274
    assert [simhash.prefix(n) for n in (0, 10**6, 10**9, 10**11)] == [2, 2, 2, 3]


def test_hot_keys_are_joined_alike(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 20)
    words = [f"w{i}" for i in range(60)]
    texts = ["same text in many rows of the table"] * 30 + [" ".join(words[:i] + ["x"] + words[i:]) for i in range(40)] + [f"alone {i} {i * i} {i + 7} z" for i in range(20)] + [None, ""]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(*texts)).collect()}
    fp = [simhash.fingerprint((t or "").encode()) for t in texts]
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            more = {j for j in range(len(texts)) if (fp[j] ^ fp[x]).bit_count() <= 4} - seen
            seen |= more
            todo += more
        assert got[i] == (f"{fp[i]:016x}", min(seen))
    monkeypatch.setattr("recallforge.llm.components.AT_ONCE", 1)
    star = spark.createDataFrame([(0, i) for i in range(1, 200)] + [(999, i) for i in range(150, 400)], "a long, b long").repartition(40)
    assert {(r.node, r.component) for r in components(star).collect()} == {(i, 0) for i in (*range(400), 999)}


def test_forest():
    r = np.random.default_rng(3)
    for n in (1, 5, 60, 400):
        a, b = r.integers(0, 300, n), r.integers(0, 300, n)
        a[n // 2 :], b[n // 2 :] = np.arange(n - n // 2), np.arange(n - n // 2) + 1  # a chain
        root = {int(x): int(x) for x in (*a, *b)}
        for _ in range(n + 1):
            for x, y in zip(a.tolist(), b.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        assert dict(zip(*(x.tolist() for x in components_of.forest(a, b)))) == {k: v for k, v in root.items() if k != v}
