import math
import zlib
from collections import Counter

import numpy as np

from recallforge.llm import langid, lm, quality
from recallforge.llm.common import table
from tests.conftest import SMALL
from tests.llm.conftest import ODD

MID = "/root/testdata/sf0.01"
fold = lambda i, n: zlib.crc32(str(i).encode()) % n


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in table(spark, MID, "labels").collect()}
    got = quality.quality(table(spark, MID, "documents"), table(spark, MID, "labels")).collect()
    assert all(r.held_out == (fold(r.doc_id, 3) == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_quality_features_against_a_plain_loop():
    lines = [b"", b"THE!! of%%%  of%%% x", b"a a a", "Éa 12ab|".encode(), b" \n"]
    together, sizes = quality.features(lines)
    apart = [quality.features([x])[0].tolist() for x in lines]
    assert sizes.tolist() == [len(x) for x in apart] and together.tolist() == sum(apart, [])
    assert len(apart[1]) == 4 + 3 + 4 + 3 + 2 and quality.features([])[0].tolist() == []
    # equal words and pairs share slots, whatever stands before them
    a, b = quality.features([b"foo bar baz"])[0], quality.features([b"zz foo bar baz"])[0]
    assert set(a[:5].tolist()) <= set(b.tolist())


def test_a_long_text_has_the_features_of_its_parts():
    r = np.random.default_rng(6)
    for size in (40, 100, 1000):
        line = b" ".join(bytes(r.choice(list(b"abAB12.,"), r.integers(1, 9)).tolist()) for _ in range(300)) + b"  x x x \n" + b"w" * 90 + b" end"
        whole, parts = quality.features([b"a b", line, b"c"]), list(quality.all_grams([b"a b", line, b"c"], size))
        for i in range(3):
            mine = np.concatenate([slots[who == i] for slots, who in parts])
            first = int(whole[1][:i].sum())
            assert sorted(mine.tolist()) == sorted(whole[0][first : first + whole[1][i]].tolist())


def test_features_against_plain_hashes():
    """Words, pairs and shapes one by one, hashed with Python's own integers."""
    mask, power = (1 << 64) - 1, 0x100000001B3

    def mix(x):
        x = (x ^ x >> 29) * 0x9E3779B97F4A7C15 & mask
        return x ^ x >> 32

    span = lambda w: mix(sum((b + 1) * pow(power, i, 1 << 64) for i, b in enumerate(w)) & mask)

    def shape(word):
        marks = ["a" if 97 <= b <= 122 or b >= 128 else "A" if 65 <= b <= 90 else "0" if 48 <= b <= 57 else chr(b) for b in word]
        return "".join(m for i, m in enumerate(marks) if i == 0 or m not in "aA0" or marks[i - 1] != m).encode()

    line = "Éa 12ab| the the THE!! Mixed9Case-99 of%%% of%%% x".encode()
    words = line.split()
    form = [12345 if i and w == words[i - 1] else span(shape(w)) for i, w in enumerate(words)]
    want = []
    for salt, values, n in ((1, [span(w) for w in words], 1), (2, [span(w) for w in words], 2), (3, form, 1), (4, form, 2), (5, form, 3)):
        for i in range(len(words) - n + 1):
            h = salt
            for v in values[i : i + n]:
                h = mix((h * 0x9E3779B97F4A7C15 + v) & mask)
            want.append((h >> 20) & quality.BUCKETS - 1)
    assert quality.features([line])[0].tolist() == want


def test_ftrl_and_scores_against_a_plain_loop():
    lines = [b"good clean text here", b"BUY NOW!!! $$$ 99", b"another clean line of text", b"WIN $$$ now!!!", b""] * 4
    labels = [1, 0, 1, 0, 1] * 4
    rows = []
    for line, y in zip(lines, labels):
        slots = quality.features([line])[0]
        i, c = np.unique(slots, return_counts=True)
        rows.append((i, quality.GAIN * c / max(len(slots), 1), y))
    weight = {0: 1.0, 1: 0.7}
    z, n = Counter(), Counter()

    def solve(i):
        return 0.0 if abs(z[i]) <= quality.L1 else -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for slots, values, y in rows:
            x = {**dict(zip(slots.tolist(), values.tolist())), quality.BUCKETS: 1.0}
            w = {i: solve(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - y) * x[i] * weight[y]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * w[i]
                n[i] += g * g
    got = quality.train(rows, weight)
    assert all(math.isclose(got[i], solve(i), rel_tol=1e-9, abs_tol=1e-12) for i in range(quality.BUCKETS + 1)) and (got != 0).sum() > 10
    for line, score in zip(lines, quality.scores(lines, got)):
        slots = quality.features([line])[0].tolist()
        total = got[-1] + quality.GAIN * sum(got[i] for i in slots) / max(1, len(slots))
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    assert quality.scores(lines, got)[0] > 0.5 > quality.scores(lines, got)[1]


def test_quality_odd_rows(spark, docs):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (5, None, 0), (None, 1, 0), (7, 5, 1)], "doc_id long, quality int, text int")
    got = quality.quality(docs(*ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 < r.score < 1 for r in got)
    assert {r.score for r in quality.quality(docs("a", None), labels.where("false")).collect()} == {0.5}
    assert quality.quality(docs("a").where("false"), labels).collect() == []
    assert len(quality.quality(docs("a", "a", ids=[None, 1]), labels).collect()) == 2


def test_language_held_out(spark):
    d = table(spark, MID, "documents")
    lang = {r.doc_id: r.lang for r in d.select("doc_id", "lang").collect()}
    got = langid.language(d).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_language_odd_rows(docs):
    texts = [*ODD, "12 34 !!", "le chat noir est ici " * 9, "the black cat is here " * 9]
    got = {r.doc_id: r for r in langid.language(docs(*texts, langs=["en"] * 4 + [None] * 7 + ["fr", "en"])).collect()}
    assert len(got) == len(texts)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 10))
    assert all(got[i].lang_pred in ("en", "fr") for i in (3, 4, 5, 6, 7, 9))
    assert {r.lang_pred for r in langid.language(docs("a", "b", langs=[None, None])).collect()} == {"und"}
    assert langid.language(docs("a").where("false")).collect() == []


def test_every_byte_is_in_some_window():
    for n in (0, 1, 251, 252, 253, 254, 255, 256, 700, 5000):
        line = bytes(97 + i % 26 for i in range(n))
        w, owner, left = langid.windows([b" x", b" " + line, b" y"])
        mine = w[owner == 1]
        grams = {bytes(r[i : i + 4]) for r in mine for i in range(253)}
        assert all((b" " + line)[i : i + 4] in grams for i in range(n - 2)) and len(mine) == 1 + max(0, -(-(n + 1 - 256) // 253))
        for size in (300, 600):  # and a long text's parts have the same windows
            parts = list(langid.batches_of_windows([b"x", line, b"y", line], size))
            for i in (1, 3):
                assert np.concatenate([x[o == i] for x, o, _ in parts]).tolist() == mine.tolist()


def test_convolution_and_gradients_of_the_language_net():
    net, r = langid.Net(["a", "b", "c"]), np.random.default_rng(3)
    net.p = {k: a.astype(float) for k, a in net.p.items()}
    x, y = r.integers(0, 256, (3, 12)).astype(np.uint8), np.array([0, 2, 3])

    def plain():
        out = []
        for row in x:
            h = []
            for k in langid.WIDTHS:
                for f in range(langid.FILTERS):
                    at = [net.p[f"c{k}"][f] + sum(net.p["e"][row[i + j]] @ net.p[f"f{k}"][j][:, f] for j in range(k)) for i in range(12 - k + 1)]
                    h.append(max(0.0, max(at)))
            z = np.exp(np.array(h) @ net.p["w"] + net.p["b"])
            out.append(z / z.sum())
        return np.array(out)

    assert np.allclose(net.probabilities(x), plain())
    loss = lambda: -np.log(net.probabilities(x)[np.arange(3), y]).mean()
    grads = net.gradients(x, y)
    for k, g in grads.items():
        for at in np.argsort(-np.abs(g), axis=None)[:3]:
            at = np.unravel_index(at, g.shape)
            old = net.p[k][at]
            net.p[k][at] = old + 1e-6
            up = loss()
            net.p[k][at] = old - 1e-6
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / 2e-6 - g[at]) < 1e-5


def gradient_net():
    net = lm.Net(np.array([5.0, 4, 3, 2, 2, 1]), np.array([0, 0, 1, 1, 1, 0]), np.ones(3))
    r = np.random.default_rng(0)
    net.p = {k: (a.astype(float) if k == "ob" else r.normal(0, 0.3, a.shape)) for k, a in net.p.items()}
    return net


def test_gradients_of_the_recurrent_net():
    net, r = gradient_net(), np.random.default_rng(1)
    xs, ys = r.integers(0, 10, (5, 3)), r.integers(0, 9, (5, 3))
    xs[0] = net.begin
    ys[4, 2] = -1

    def loss():
        h, out = np.zeros((3, lm.HIDDEN)), 0.0
        for x, y in zip(xs, ys):
            h = np.where((x == net.begin)[:, None], 0, h)
            h = net.step(net.p["x"][x], h)[0]
            real = y >= 0
            out -= net.logp(h[real], y[real]).sum()
        return out / (ys >= 0).sum()

    grads = net.window(xs, ys, np.zeros((3, lm.HIDDEN)))[1]
    for k in ("x", "u", "v", "c", "cb", "o"):
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        if k == "x":
            at = (xs[1, 0], at[1])
        if k == "o":
            at = (net.cls[ys[0, 0] if ys[0, 0] < 6 else 0], at[1], 0)
        old = net.p[k][at]
        net.p[k][at] = old + 1e-5
        up = loss()
        net.p[k][at] = old - 1e-5
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / 2e-5 - grads[k][at]) < 1e-6


def test_the_state_is_carried_and_lanes_do_not_mix():
    net, r = gradient_net(), np.random.default_rng(2)
    docs = [r.integers(0, 9, n) for n in (1, 90, 3, 40, 200, 2)]
    want = []
    for d in docs:
        h, x, total = np.zeros((1, lm.HIDDEN)), net.begin, 0.0
        for t in d:
            h = net.step(net.p["x"][[x]], h)[0]
            total += net.logp(h, np.array([t]))[0]
            x = t
        want.append(total)
    for lanes in (1, 2, 256):
        assert np.allclose(net.score(docs, lanes), want)


def test_class_probabilities_add_up_to_one():
    net = gradient_net()
    h = np.random.default_rng(3).normal(size=(4, lm.HIDDEN))
    total = sum(np.exp(net.logp(h, np.full(4, t))) for t in range(net.n + 3))
    assert np.allclose(total, 1)


def test_scores_on_documents(spark):
    d = table(spark, SMALL, "documents")
    texts = {r.doc_id: r.text for r in d.collect()}
    tokens = {i: [*lm.words(t.encode()), None] for i, t in texts.items()}
    count = Counter(w for i, ws in tokens.items() if fold(i, 10) for w in ws)
    n, v = sum(count.values()), len(count)
    got = lm.score(d).collect()
    for r in got:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 10) == 0, len(ws), sum(w in count for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_whole_scores_against_a_plain_loop(spark, docs, monkeypatch):
    """Each token's probability by itself: its class by the state, then its share in the class by softmax or by counts."""
    monkeypatch.setattr(lm, "LISTED", 35)
    monkeypatch.setattr(lm, "HEAD", 10)
    texts = ["the cat sat on the mat. " * 9, "a Dog, and THE cat ran 12 miles; zebra", None, "unseen words qqq zzz1 the", "the dog sat, the end."] * 4
    d = docs(*(t and f"{t} only{i}" for i, t in enumerate(texts)), ids=range(100, 120))
    lm_docs = d.select("doc_id", "text").withColumn("held_out", lm._held_out(lm.F.col("doc_id")))
    model, _ = lm.fit(lm_docs, lm.counts(lm_docs).cache())
    net, p = model.net, {k: a.astype(float) for k, a in model.net.p.items()}
    tokens = {r.doc_id: [*lm.words((r.text or "").encode()), lm.END] for r in d.collect()}
    count = Counter(w for i, ws in tokens.items() if fold(i, 10) for w in ws)
    kind = {w: int(lm.tail_class([w], model.letters)[0]) for ws in tokens.values() for w in ws if w != lm.END}
    kind |= {lm.END: 0}
    heads = {w: model.index[w] for w in count if w in model.index and model.index[w] < model.heads}
    mass = [0.1 + sum(count[w] + 0.1 for w in count if w not in heads and kind[w] == k) for k in range(lm.TAILS)]
    sigmoid = lambda z: 1 / (1 + math.exp(-z))

    def whole(ws):
        n, h, x, total = lm.HIDDEN, np.zeros(lm.HIDDEN), p["x"][net.begin], 0.0
        for w in ws:
            gates = [sigmoid(x[i] + h @ p["u"][:, i]) for i in range(2 * n)]
            new = [math.tanh(x[2 * n + i] + (np.array(gates[n:]) * h) @ p["v"][:, i]) for i in range(n)]
            h = np.array([(1 - gates[i]) * h[i] + gates[i] * new[i] for i in range(n)])
            token = heads.get(w, model.heads + kind[w])
            cls = net.cls[token] if w in heads else net.heads + kind[w]
            z = h @ p["c"] + p["cb"]
            total += z[cls] - math.log(sum(math.exp(v) for v in z))
            if w in heads:
                z = [h @ p["o"][cls][:, net.slot[m]] + p["ob"][cls][net.slot[m]] for m in net.members[cls]]
                total += z[net.slot[token]] - math.log(sum(math.exp(v) for v in z))
            else:
                total += math.log((count[w] + 0.1) / mass[kind[w]])
            x = p["x"][token]
        return total / math.log(10)

    got = {r.doc_id: r.score for r in lm.score(d).collect()}
    assert len(heads) == 10 < len(model.index) < len(count) and any(w not in count for ws in tokens.values() for w in ws)
    assert all(math.isclose(got[i], whole(ws), rel_tol=1e-4, abs_tol=1e-3) for i, ws in tokens.items())


def test_a_very_long_text_beside_short_ones_takes_little_memory():
    import tracemalloc

    net = gradient_net()
    net.p = {k: a.astype(np.float32) for k, a in net.p.items()}
    docs = [np.zeros(1_000_000, np.int64)] + [np.zeros(5, np.int64)] * 300
    tracemalloc.start()
    seen = np.zeros(len(docs), np.int64)
    for xs, ys, who in lm.windows(docs, 256, net.begin):
        seen += np.bincount(who[ys >= 0], minlength=len(docs))
        assert xs.shape == ys.shape == who.shape and (ys >= 0).any(0).all()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen.tolist() == list(map(len, docs)) and most < 60e6


def test_words_beyond_the_list_are_joined_alike(spark, monkeypatch):
    d = table(spark, SMALL, "documents")
    whole = {r.doc_id: r.base_score for r in lm.score(d).collect()}
    monkeypatch.setattr(lm, "LISTED", 300)
    monkeypatch.setattr(lm, "HEAD", 100)
    assert all(math.isclose(r.base_score, whole[r.doc_id], rel_tol=1e-9) for r in lm.score(d).collect())


def test_lm_odd_rows(docs):
    got = {r.doc_id: r for r in lm.score(docs(*ODD)).collect()}
    assert len(got) == len(ODD) and all(got[i].n_tokens == 1 for i in (0, 1, 2)) and got[7].n_tokens == 60_001
    assert all(math.isfinite(r.score) and r.score < 0 for r in got.values())
    assert lm.score(docs("a").where("false")).collect() == []
    assert len(lm.score(docs("a", "a", None, ids=[None, 5, None])).collect()) == 3


def test_lm_learns_from_the_whole_texts_of_all_training_documents(docs):
    body = docs("xjxj " + "a b " * 3000 + "zqzq", "c " * 10, None, ids=[1, 2, 3]).select("doc_id", "text").withColumn("held_out", lm._held_out(lm.F.col("doc_id")))
    model, _ = lm.fit(body, lm.counts(body).cache())
    passes = max(1, min(lm.PASSES, lm.AMPLE // model.n))
    assert model.n >= 6000 and model.learned == passes * model.n
    pair = lambda p: model.letters[p[0] << 8 | p[1]].max()
    assert pair(b"xj") > pair(b"~~") and pair(b"zq") > pair(b"~~")  # from both ends of a long text


def test_lm_learns_from_each_training_text_once_whatever_the_size(docs):
    for n in (3, 60):
        body = docs(*(f"a b c {i}" for i in range(n))).select("doc_id", "text").withColumn("held_out", lm._held_out(lm.F.col("doc_id")))
        model, (_, encoded) = lm.fit(body, lm.counts(body).cache())
        assert model.learned == model.n == 5 * encoded.where("NOT held_out").count()


def test_sums_of_runs_of_rows():
    r = np.random.default_rng(4)
    sizes = np.array([1, 3, 8, 9, 1, 200, 2])
    rows, edges = r.normal(size=(sizes.sum(), 5)), np.cumsum(sizes) - sizes
    assert np.allclose(lm.added_up(rows, edges), np.add.reduceat(rows, edges))


def test_lm_held_out(spark):
    held = [r for r in lm.score(table(spark, MID, "documents")).collect() if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -3.65


def test_split_finds_the_words_of_slices():
    import pyarrow as pa

    texts = ["Drop ME", None, "", " \t\n", "É A\x1cb\x0bc ", "x", "  Two  words", "\x85 \xa0 end"]
    for a in range(len(texts)):
        some, sizes = lm.split(pa.array(texts).slice(a, 5))
        want = [lm.words((t or "").encode()) for t in texts[a : a + 5]]
        assert sizes.tolist() == list(map(len, want)) and some.to_pylist() == [w for ws in want for w in ws]


def test_clusters_read_each_text_once(spark, docs):
    """However many passes of k-means follow; their letter pairs are those of a plain count."""
    texts = ["ab " * 400 + "cd", "xyz zyx", None, "  ", "the end. " * 5]
    rows, train = spark.sparkContext.accumulator(0), docs(*texts).select("text")

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    letters = lm.clusters(train.mapInArrow(seen, "text string"), lm.seeds([b"ab ab", b"xyz", b"the end."]))
    lines = [b" " + b" ".join(lm.words(t.encode())) + b" " for t in texts if t and t.strip()]
    pairs = Counter(p for line in lines for p in zip(line, line[1:]))
    assert rows.value == len(texts)
    x = np.exp(letters.astype(float)).max(1)
    assert {(int(at) >> 8, int(at) & 255) for at in np.flatnonzero(x > x.min() * 5)} >= set(pairs)
    owner, p, n = lm.pair_counts([line.strip() for line in lines])
    assert {(int(k) >> 8, int(k) & 255): int(n[p == k].sum()) for k in set(p.tolist())} == pairs
