"""Language ID: a byte convolutional network, trained here in numpy, over fixed-length windows of the whole text.

A text is cut into windows of WINDOW bytes (each begins with a space; the last is padded). Every window goes through filters of several
widths, the largest response of each filter is kept, and a softmax names the language. Since the input is a byte, a
filter's response is a sum of one looked-up row per position: the embedding and the filter are folded into one table
for each position of each filter. A text's score is the mean of its windows' probabilities, weighted by their bytes.

One class more than there are languages is learned, for letters that are no language: windows whose letters were mixed up or drawn by chance. So the
probability of a language says how sure it is that the text is in a language at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from recallforge.llm.common import hash_below, pieces, remainder, texts, wider

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
#: About so many windows of WINDOW characters are learned from, chosen by hash among all windows of all training texts, as many of each language as far as it has them.
SAMPLE, EPOCHS, BATCH = 9000, 5, 64
#: Windows are learned from once more at one of these lengths, so that short texts are known too.
LENGTHS = (8, 16, 32, 64, 128)
#: Bytes of text turned into windows at once.
AT_ONCE = 1 << 21
UND = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII letters in lower case, every other ASCII byte as a space, the rest as it is; 0 pads.
_CODE = np.full(256, 32, np.uint8)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def windows(lines: list[bytes], widest: int = max(WIDTHS)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (they overlap by the widest filter less one), each one's text, and its bytes. Texts come with the blank before them."""
    step = WINDOW - widest + 1
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    count = np.maximum(1, -(-(sizes - widest + 1) // step))
    owner = np.repeat(np.arange(len(lines)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    base = np.cumsum(sizes) - sizes
    data = np.concatenate((_CODE[np.frombuffer(b"".join(lines), np.uint8)], np.zeros(WINDOW, np.uint8)))
    start = base[owner] + nth * step
    left = np.minimum(WINDOW, sizes[owner] - nth * step)
    out = data[start[:, None] + np.arange(WINDOW, dtype=np.int32)]
    out[np.arange(WINDOW) >= left[:, None]] = 0
    return out, owner, left


def batches_of_windows(lines: list[bytes], size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """windows() of all texts, about `size` bytes of text at a time; a longer text comes in parts, with the same windows as in one."""
    size = size or AT_ONCE
    step = WINDOW - max(WIDTHS) + 1
    at = 0
    while at < len(lines):
        if len(lines[at]) > size:
            whole, per = b" " + lines[at], max(1, size // step)
            count = max(1, -(-(len(whole) - max(WIDTHS) + 1) // step))
            for first in range(0, count, per):
                last = min(count, first + per)
                x, owner, left = windows([whole[first * step : (last - 1) * step + WINDOW]])
                yield x, owner + at, left
            at += 1
            continue
        to, held = at, 0
        while to < len(lines) and (to == at or held + len(lines[to]) < size) and len(lines[to]) <= size:
            held += len(lines[to])
            to += 1
        x, owner, left = windows([b" " + x for x in lines[at:to]])
        yield x, owner + at, left
        at = to


class Net:
    """The classes are the languages and, last, no language."""

    def __init__(self, langs: list[str], seed: int = 1):
        r = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs) + 1)), "b": np.zeros(len(langs) + 1)}
        for k in WIDTHS:
            self.p[f"f{k}"] = r.normal(0, 1 / np.sqrt(k * EMBED), (k, EMBED, FILTERS))
            self.p[f"c{k}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def folded(self) -> dict[int, list[np.ndarray]]:
        """For each width, the embedding and the filters folded into one table for each position."""
        return {k: [self.p["e"] @ self.p[f"f{k}"][j] + (self.p[f"c{k}"] if j == 0 else 0) for j in range(k)] for k in WIDTHS}

    def pooled(self, x: np.ndarray, where: bool = False, tables: dict[int, list[np.ndarray]] | None = None):
        """The largest response of each filter, cut off below zero, and its place if asked for."""
        out, at, tables = [], [], tables or self.folded()
        for k in WIDTHS:
            n = x.shape[1] - k + 1
            r = tables[k][0][x[:, :n]]
            for j in range(1, k):
                r += tables[k][j][x[:, j : j + n]]
            if where:
                at.append(r.argmax(1))
            out.append(np.maximum(r.max(1), 0))
        return (np.concatenate(out, 1), at) if where else np.concatenate(out, 1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out, tables = [], self.folded()
        for i in range(0, len(x), 256):  # 256 windows: a few MB of responses at once
            z = self.pooled(x[i : i + 256], tables=tables) @ self.p["w"] + self.p["b"]
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.langs) + 1), np.float32)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy; through the pooling, only the winning place of each filter has one."""
        h, at = self.pooled(x, True)
        z = h @ self.p["w"] + self.p["b"]
        z = np.exp(z - z.max(1, keepdims=True))
        d = z / z.sum(1, keepdims=True)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"w": h.T @ d, "b": d.sum(0), "e": np.zeros_like(self.p["e"])}
        back = (d @ self.p["w"].T) * (h > 0)
        for q, k in enumerate(WIDTHS):
            gk = back[:, q * FILTERS : (q + 1) * FILTERS]
            g[f"c{k}"], g[f"f{k}"] = gk.sum(0), np.zeros_like(self.p[f"f{k}"])
            for j in range(k):
                byte = np.take_along_axis(x, at[q] + j, 1)
                g[f"f{k}"][j] = np.einsum("nfe,nf->ef", self.p["e"][byte], gk)
                np.add.at(g["e"], byte, gk[:, :, None] * self.p[f"f{k}"][j].T[None])
        return g

    def learn(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, seed: int = 2) -> None:
        """Adam on the cross-entropy."""
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), BATCH):
                some = order[i : i + BATCH]
                g = self.gradients(x[some], y[some])
                t += 1
                for k, a in self.p.items():
                    m[k] += 0.1 * (g[k] - m[k])
                    v[k] += 0.001 * (g[k] ** 2 - v[k])
                    a -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-7)


def garbled(text: str, r: np.random.Generator) -> str:
    """Letters that are no language, as long as the text: its own, mixed up, or a to z by chance, cut into words of any length."""
    if r.random() < 0.5:
        letters = [c for c in text if c.isalpha()]
        r.shuffle(letters)
        left = iter(letters)
        return "".join(next(left) if c.isalpha() else c for c in text)
    return "".join(chr(97 + c) if c < 26 else " " for c in r.integers(0, int(r.integers(26, 33)), len(text)).tolist())


def predict(net: Net | None, lines: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and its probability of each whole text, and the probability that it is in no language; `und`, 0 and 1 for a text without a letter, or without a network."""
    has = np.array([bool(_LETTER.search(x.decode("utf-8", "replace"))) for x in lines], bool)
    if net is None or not has.any():
        return [UND] * len(lines), np.zeros(len(lines)), np.ones(len(lines))
    some = [x for x, k in zip(lines, has) if k]
    total, weight = np.zeros((len(some), len(net.langs) + 1)), np.zeros(len(some))
    for x, owner, left in batches_of_windows(some):
        np.add.at(total, owner, net.probabilities(x) * left[:, None])
        np.add.at(weight, owner, left)
    p = np.minimum(total / weight[:, None], 1.0)
    best = p[:, :-1].argmax(1)
    out, score, none = np.full(len(lines), UND, object), np.zeros(len(lines)), np.ones(len(lines))
    out[has] = np.array(net.langs, object)[best]
    score[has], none[has] = p[np.arange(len(best)), best], p[:, -1]
    return out.tolist(), score, none


def fit(docs: DataFrame, sample: int = SAMPLE) -> Net | None:
    """A network learned from the text and lang of documents whose crc32 remainder modulo 3 is not 1; None without any.

    About `sample` windows of WINDOW characters take part, an equal share of each language as far as it has them, chosen by hash among all windows of
    the whole texts: a few MB on the driver, whatever the input.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    body = body.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder(F.col("doc_id"), 3) != 1))
    body = body.withColumn("n", F.ceil(F.length("text") / WINDOW).cast("int"))
    counts = {r[0]: r[1] for r in body.groupBy("lang").agg(F.sum("n")).collect()}
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, sample / len(counts) / n).otherwise(share)
    chosen = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: hash_below(share, F.col("doc_id"), i))
    spread = body.withColumn("chosen", chosen).where(F.size("chosen") > 0).select("doc_id", "lang", "text", F.explode("chosen").alias("i"))
    rows = spread.select("doc_id", "lang", F.expr(f"substring(text, i * {WINDOW} + 1, {WINDOW})").alias("t"), "i").collect()
    rows.sort(key=lambda r: (((r.doc_id or 0) * 0x9E3779B97F4A7C15 + r.i * 0x1000001) & (2**64 - 1), r.lang, r.t))
    langs = sorted({r.lang for r in rows}, key=lambda s: s.encode())
    place = {lang: k for k, lang in enumerate(langs)}
    pairs = list(dict.fromkeys((r.t, place[r.lang]) for r in rows if _LETTER.search(r.t)))
    r = np.random.default_rng(4)
    for k, (t, y) in enumerate(pairs[::2]):
        n = LENGTHS[k % len(LENGTHS)]
        if len(t) > n:
            at = int(r.integers(0, len(t) - n + 1))
            pairs.append((t[at : at + n], y))
    pairs += [(garbled(t, r), len(langs)) for t, _ in pairs[::3]]
    x, owner, left = windows([b" " + t.encode() for t, _ in pairs])
    y = np.array([y for _, y in pairs], np.int64)[owner]
    keep = left > 1
    net = Net(langs)
    net.learn(x[keep], y[keep])
    return net


def label(docs: DataFrame, net: Net | None, lang: str = "lang_pred", score: str = "lang_score", none: str = "no_lang") -> DataFrame:
    """docs with the predicted language, its probability and that of no language added, in columns of the given names."""
    held = docs.sparkSession.sparkContext.broadcast(net)  # some KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            names, *found = predict(held.value, texts(b.column("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), *map(pa.array, found)], [*b.schema.names, lang, score, none])

    return docs.mapInArrow(run, wider(docs, **{lang: StringType(), score: DoubleType(), none: DoubleType()}))


def language(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs, predicted from its whole text.

    A null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn from.
    Equal probabilities go to the language first by code point. A null doc_id counts as the empty text for the fold. Repeated rows come back
    repeated; columns other than doc_id, text and, for learning, lang are not read. An empty table gives an empty table.
    """
    net = fit(docs)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            lang, score, _ = predict(held.value, texts(b.column("text")))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score)})

    named = body.mapInArrow(run, "doc_id long, lang_pred string, score double")
    return named.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
