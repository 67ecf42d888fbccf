"""Gated recurrent language model with a class-factored output, and a unigram base score.

Tokens are the words of a text in lower case (A-Z only), then one end. P(token | state) = P(class | state) * P(token | class, state).
The HEAD most frequent words have classes of up to SPAN words each, and inside such a class a softmax of the state. Every
other word has a class that its bytes decide (a cluster by letter pairs, and how the word ends); inside it a word has
its share of all training counts of the class, with 0.1 added to each and 0.1 kept for words never seen. The weights, the letter
pairs of the clusters and the word counts are all learned from the whole texts of all training documents.

The weights are learned in rounds. In each, every task starts from the same weights and learns from its documents of the round's slice
by truncated backpropagation in numpy (texts of more than SEGMENT tokens in segments side by side); the mean of the tasks' weights, by tokens learned from, starts the next round. One pass takes every
training document once, in a small corpus as in a large one. So the weights depend, slightly, on how the rows lie in partitions.

Texts become network tokens once: two bytes a token, written with what scoring needs beside the network, and read by learning and by scoring.

The words kept at hand (at most LISTED, the most frequent of all documents, training or not) need no shuffle; only rarer ones are joined
with the table of counts, so no very common word gathers in one task.

The state is carried through a whole text, whatever its length: texts run side by side in lanes, each lane one text after another,
and the state is carried from window to window and set to zero where a text begins.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from copy import copy
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallforge.llm.common import LOWER, cut, drop, hash_below, pieces, remainder, texts, turn_of

HEAD, SPAN, LISTED = 2048, 64, 65536
CLUSTERS, ENDINGS = 8, 5
TAILS = CLUSTERS * ENDINGS
HIDDEN, WINDOW, LANES, SEGMENT = 32, 32, 64, 4096
#: Where the rounds of a pass begin and end, as shares of the training documents: the first are short, as the weights change most there.
ROUNDS = (0.0, 0.02, 0.08, 0.25, 0.6, 1.0)
#: Every corpus is passed over PASSES times, whatever its size. A round learns in one lane for every AMPLE / (4 * LANES) tokens learned from before it,
#: FEW at least and 4 * LANES at most: many small steps first, cheap large ones later. A task gets SHARE tokens or more of a pass.
AMPLE, PASSES, FEW, SHARE, BLOCK = 10_000_000, 1, 8, 500_000, 4096
#: The first centres of the clusters come from about so many training documents, up to CUT words of each; LLOYD passes over all follow.
SAMPLE, CUT, LLOYD = 3000, 400, 3
#: So many states meet the output weights at a time, as their logits then stay in the processor's cache.
ROWS = 1024
TOKEN, KEPT = np.uint16, ("task", "row", "doc_id", "held_out", "n_tokens", "known", "base")
SMOOTH, END = 0.1, b"\n"  # no word holds a line feed


def words(line: bytes) -> list[bytes]:
    return line.translate(LOWER).split()


def split(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all rows of a string column, one after another, and how many each row has; the same words as words() finds."""
    column = pa.concat_arrays([column, column.slice(0, 0)])  # a copy, as ascii_lower misreads a cast slice
    got = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    some, sizes = got.flatten().cast(pa.large_binary()), pc.list_value_length(got).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(some), 0).to_numpy(zero_copy_only=False)  # blanks at an end leave an empty word there
    if not full.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[full], minlength=len(sizes))
        some = some.filter(pa.array(full))
    return some, sizes


# ---------------------------------------------------------------------------------------------- classes of rare words


def _pairs(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Letter pairs (two bytes, with a blank at either end) of all words, and where each word's begin."""
    data = np.frombuffer(b" " + b" ".join(some) + b" ", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
    return data[:-1] << 8 | data[1:], np.cumsum(sizes) - sizes


def _ending(some: list[bytes]) -> np.ndarray:
    """0 for a word that ends in a letter, 1 for a full stop, 2 for a comma, 3 for a digit, 4 for any other byte."""
    last = np.array([w[-1] for w in some], np.uint8)
    out = np.full(len(some), 4)
    out[(last >= 97) & (last <= 122) | (last >= 128)] = 0
    out[last == 46], out[last == 44], out[(last >= 48) & (last <= 57)] = 1, 2, 3
    return out


#: A letter pair's place among the 4096 by which documents are clustered.
SLOT = (np.arange(65536) * 2654435761 >> 7) & 4095


def _profiles(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of words with one blank between: a row of length 1 for each, from its letter pairs; all letter pairs; whose each is."""
    data = np.frombuffer(b" " + b" ".join(lines) + b" ", np.uint8).astype(np.int64)
    p, owner = data[:-1] << 8 | data[1:], np.repeat(np.arange(len(lines)), [len(x) + 1 for x in lines])
    table = np.sqrt(np.bincount(owner * 4096 + SLOT[p], minlength=len(lines) * 4096).reshape(-1, 4096).astype(np.float32))
    return table / np.linalg.norm(table, axis=1, keepdims=True), p, owner


def seeds(lines: list[bytes], rounds: int = 12) -> np.ndarray:
    """First centres of the clusters, by k-means on the profiles of a few documents."""
    if not lines:
        return np.zeros((CLUSTERS, 4096), np.float32)
    table = np.concatenate([_profiles(lines[at : at + 256])[0] for at in range(0, len(lines), 256)])
    centre, far = [table[0]], None
    while len(centre) < CLUSTERS:
        d = 1 - table @ centre[-1]
        far = d if far is None else np.minimum(far, d)
        centre.append(table[int(far.argmax())])
    centre = np.array(centre)
    for _ in range(rounds):
        who = (table @ centre.T).argmax(1)
        for k in range(CLUSTERS):
            if (who == k).any():
                m = table[who == k].mean(0)
                centre[k] = m / max(np.linalg.norm(m), 1e-9)
    return centre


def pair_counts(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lines of words with one blank between: whose, which letter pair and how often, for every letter pair of each line."""
    data = np.frombuffer(b" " + b" ".join(lines) + b" ", np.uint8).astype(np.uint16)
    p, owner = data[:-1] << 8 | data[1:], np.repeat(np.arange(len(lines), dtype=np.int32), [len(x) + 1 for x in lines])
    used = np.flatnonzero(np.bincount(p, minlength=65536))
    rank = np.zeros(65536, np.int32)
    rank[used] = np.arange(len(used))
    owner *= len(used)
    owner += rank[p]
    table = np.bincount(owner, minlength=len(lines) * len(used))
    at = np.flatnonzero(table)
    return at // len(used), used[at % len(used)], table[at]


def profiles(train: DataFrame) -> DataFrame:
    """The letter pairs of each row of train and how often each occurs, as bytes: a number above 255 takes several places. Rows without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            some, sizes = split(b.column("text"))
            every = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes)))), some)
            lines = pc.binary_join(every, pa.scalar(b" ", pa.large_binary())).filter(pa.array(sizes > 0)).to_pylist()
            pairs, times = [], []
            for at in range(0, len(lines), 64):
                part = lines[at : at + 64]
                owner, p, n = pair_counts(part)
                more = (n - 1) // 255
                owner, p = np.repeat(owner, more + 1), np.repeat(p, more + 1).astype(np.uint16)
                left = np.full(len(p), 255, np.uint8)
                left[np.cumsum(more + 1) - 1] = n - 255 * more
                edges = np.searchsorted(owner, np.arange(len(part) + 1))
                for a, e in zip(edges, edges[1:]):
                    pairs.append(p[a:e].tobytes())
                    times.append(left[a:e].tobytes())
            yield pa.record_batch({"pairs": pa.array(pairs, pa.binary()), "times": pa.array(times, pa.binary())})

    return cut(train.select("text").mapInArrow(run, "pairs binary, times binary"), "profiles")


def clusters(train: DataFrame, centre: np.ndarray) -> np.ndarray:
    """Log-probabilities of letter pairs in CLUSTERS groups of documents, by k-means over all rows of train (65536 x CLUSTERS).

    Texts become counts of letter pairs once. Each task adds up its documents' profiles and letter pairs by cluster; the sums are whole numbers, so their order does not matter.
    """
    first = CLUSTERS * 65536  # sums of the profiles stand behind the letter pairs
    counted = profiles(train)

    def gather(now, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, pairs = np.zeros((CLUSTERS, 4096)), np.zeros(first)
            for b in pieces(batches, "pairs", 1 << 20):
                for at in range(0, b.num_rows, 256):
                    part = b.slice(at, 256)
                    some, times = part.column("pairs").to_pylist(), part.column("times").to_pylist()
                    p, n = np.frombuffer(b"".join(some), np.uint16), np.frombuffer(b"".join(times), np.uint8)
                    owner = np.repeat(np.arange(len(some)), list(map(len, times)))
                    table = np.sqrt(np.bincount(owner * 4096 + SLOT[p], weights=n, minlength=len(some) * 4096).reshape(-1, 4096).astype(np.float32))
                    table /= np.linalg.norm(table, axis=1, keepdims=True)
                    who = (table @ now.T).argmax(1)
                    if last:
                        pairs += np.bincount(who[owner] * 65536 + p, weights=n, minlength=first)
                    else:
                        for k in range(CLUSTERS):
                            sums[k] += table[who == k].sum(0)
            x = np.concatenate((pairs.astype(np.int64), np.rint(sums.ravel() * (1 << 20)).astype(np.int64)))
            at = np.flatnonzero(x)
            yield pa.record_batch({"at": pa.array(at.astype(np.int32)), "x": pa.array(x[at])})

        got = counted.mapInArrow(run, "at int, x long").groupBy("at").agg(F.sum("x").alias("x")).toArrow()  # at most CLUSTERS * 69632 rows
        out = np.zeros(first + CLUSTERS * 4096)
        out[got.column("at").to_numpy()] = got.column("x").to_numpy()
        return out

    for _ in range(LLOYD):
        m = gather(centre, False)[first:].reshape(CLUSTERS, 4096)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        centre = np.where(size > 0, m / np.maximum(size, 1e-9), centre).astype(np.float32)
    out = gather(centre, True)[:first].reshape(CLUSTERS, 65536).T + 0.02
    drop(counted)
    return np.log(out / out.sum(0)).astype(np.float32)


def tail_class(some: list[bytes], letters: np.ndarray) -> np.ndarray:
    """Class (0 to TAILS - 1) of each word, from its bytes alone."""
    if not some:
        return np.zeros(0, np.int64)
    out = np.empty(len(some), np.int64)
    for at in range(0, len(some), 20_000):
        part = some[at : at + 20_000]
        p, start = _pairs(part)
        out[at : at + 20_000] = np.add.reduceat(letters[p], start).argmax(1) * ENDINGS + _ending(part)
    return out


# ---------------------------------------------------------------------------------------------- the network


def _bounded(z: np.ndarray) -> np.ndarray:
    """z as it is where exp() of it is safe, else with its greatest value of each row taken off."""
    most = z.max(1, initial=-np.inf, keepdims=True)
    return z if not len(z) or most.max() < 60 and most.min() > -60 else z - most


class Room:
    """Arrays that are used again from window to window, by name: fresh memory costs more than the sums made in it. They begin with any values."""

    def __init__(self):
        self.kept: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int, kind=np.float32) -> np.ndarray:
        size, got = int(np.prod(shape)), self.kept.get(name)
        if got is None or got.size < size or got.dtype != kind:
            got = self.kept[name] = np.empty(size, kind)
        return got[:size].reshape(shape)

    def __reduce__(self):
        return Room, ()


class Net:
    """Inputs and head outputs are numbered: 0 the end, 1 to HEAD-1 frequent words, then the tail classes, and last the beginning of a text."""

    def __init__(self, head_counts: np.ndarray, group: np.ndarray, tail_counts: np.ndarray, seed: int = 5):
        r = np.random.default_rng(seed)
        n = len(head_counts)
        order = np.lexsort((-head_counts, group))  # classes of words of one group
        self.cls = np.empty(n, np.int64)
        number, filled, last = -1, SPAN, None
        self.members: list[np.ndarray] = []
        for i in order:
            if filled >= SPAN or group[i] != last:
                number, filled, last = number + 1, 0, group[i]
                self.members.append([])
            self.cls[i] = number
            self.members[number].append(i)
            filled += 1
        self.members = [np.array(m) for m in self.members]
        self.heads = len(self.members)
        self.slot = np.empty(n, np.int64)
        for m in self.members:
            self.slot[m] = np.arange(len(m))
        self.width = max(map(len, self.members))
        classes, inputs = self.heads + len(tail_counts), n + len(tail_counts) + 1
        self.n, self.begin = n, inputs - 1
        mass = np.concatenate(([head_counts[m].sum() for m in self.members], tail_counts)) + SMOOTH
        h = HIDDEN
        self.p = {
            "x": r.normal(0, 0.1, (inputs, 3 * h)), "u": r.normal(0, 1 / np.sqrt(h), (h, 2 * h)), "v": r.normal(0, 1 / np.sqrt(h), (h, h)),
            "c": np.zeros((h, classes)), "cb": np.log(mass / mass.sum()),
            "o": np.zeros((self.heads, h, self.width)), "ob": np.full((self.heads, self.width), -1e9),
        }
        self.p["x"][:, :h] -= 1.0  # gates begin by keeping the state
        for k, m in enumerate(self.members):
            self.p["ob"][k, : len(m)] = np.log((head_counts[m] + SMOOTH) / (head_counts[m] + SMOOTH).sum())
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.room = Room()

    def step(self, x: np.ndarray, h: np.ndarray):
        """One step of the gated unit for the inputs' rows x of the table."""
        n = HIDDEN
        g = 1 / (1 + np.exp(-(x[:, : 2 * n] + h @ self.p["u"])))
        z, r = g[:, :n], g[:, n:]
        rh = r * h
        c = 2 / (1 + np.exp(-2 * (x[:, 2 * n :] + rh @ self.p["v"]))) - 1  # tanh
        return h + z * (c - h), z, r, c, rh

    def classes(self, token: np.ndarray) -> np.ndarray:
        head = token < self.n
        return np.where(head, self.cls[np.where(head, token, 0)], token - self.n + self.heads)

    def safe(self) -> bool:
        """Whether exp() of every output is safe as it is, whatever the state: its components lie between -1 and 1."""
        p, room = self.p, 60.0
        inner = np.abs(p["o"]).sum(1) + np.abs(p["ob"])
        return float(inner[p["ob"] > -1e8].max()) < room and float((np.abs(p["c"]).sum(0) + np.abs(p["cb"])).max()) < room

    def logp(self, h: np.ndarray, token: np.ndarray, safe: bool = False) -> np.ndarray:
        """Natural log probability of each token's class, and inside it for head words, given the states."""
        p, cls = self.p, self.classes(token)
        out, ones = np.empty(len(h), h.dtype), np.ones(max(p["cb"].size, self.width), h.dtype)
        for at in range(0, len(h), ROWS):
            z = h[at : at + ROWS] @ p["c"]
            z += p["cb"]
            z = z if safe else _bounded(z)
            out[at : at + ROWS] = z[np.arange(len(z)), cls[at : at + ROWS]]
            out[at : at + ROWS] -= np.log(np.exp(z, out=z) @ ones[: z.shape[1]])
        head, edges = self.by_class(token, cls)
        inside, slot, got = h.take(head, axis=0), self.slot[token[head]], np.empty(len(head), h.dtype)
        for k in np.flatnonzero(np.diff(edges)):
            a, b, n = edges[k], edges[k + 1], len(self.members[k])
            z = inside[a:b] @ p["o"][k, :, :n]
            z += p["ob"][k, :n]
            z = z if safe else _bounded(z)
            got[a:b] = z[np.arange(b - a), slot[a:b]]
            got[a:b] -= np.log(np.exp(z, out=z) @ ones[:n])
        out[head] += got
        return out

    def by_class(self, token: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of head words, those of one class side by side, and where each class begins among them."""
        head = np.flatnonzero(token < self.n)
        kind = cls[head].astype(np.int16)  # short numbers sort faster
        head = head[np.argsort(kind, kind="stable")]
        return head, np.concatenate(([0], np.cumsum(np.bincount(kind, minlength=self.heads))))

    def forward(self, xs: np.ndarray, h: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The states after each step of a window, and the last one; kept gets what the gradients need."""
        n, p = HIDDEN, self.p
        steps, lanes = xs.shape
        keep, new = kept is not None, partial(self.room, kind=p["x"].dtype)
        # the gates' inputs are negative, as exp() takes them; each part has an array of its own, as whole arrays are passed over faster than parts of rows
        gates = np.take(-p["x"][:, : 2 * n], xs, axis=0, out=new("gates", steps, lanes, 2 * n), mode="clip")
        c = np.take(np.ascontiguousarray(p["x"][:, 2 * n :]), xs, axis=0, out=new("c", steps, lanes, n), mode="clip")  # becomes the candidate
        states, less = new("states", steps, lanes, n), -p["u"]
        before, z, r, rh = (new(k, steps if keep else 1, lanes, n) for k in ("before", "z", "r", "rh"))
        fresh = xs == self.begin
        some = fresh.any(1)
        room, wide = new("step", lanes, n), new("wide", lanes, 2 * n)
        for t in range(steps):
            i = t if keep else 0
            was, now, update, reset, last, fill = before[i], states[t], z[i], r[i], rh[i], c[t]
            was[...] = h
            if some[t]:
                was[fresh[t]] = 0
            np.matmul(was, less, out=wide)
            wide += gates[t]
            np.exp(wide, out=wide)
            wide += 1
            np.reciprocal(wide[:, :n], out=update)
            np.reciprocal(wide[:, n:], out=reset)
            np.multiply(reset, was, out=last)
            np.matmul(last, p["v"], out=room)
            fill += room
            np.tanh(fill, out=fill)
            np.subtract(fill, was, out=now)
            now *= update
            now += was
            h = now
        if keep:
            kept.update(z=z, r=r, c=c, before=before, rh=rh)
        return states, h

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([a.ravel() for a in self.p.values()])

    def load(self, flat: np.ndarray) -> None:
        """Takes the weights from such a row; they stay views of it."""
        at = 0
        for k, a in self.p.items():
            self.p[k] = flat[at : at + a.size].reshape(a.shape)
            at += a.size

    def learn(self, docs: list[np.ndarray], rate: float, adam: list | None = None, most: int = LANES) -> list:
        """One pass over docs by truncated backpropagation over windows of WINDOW tokens in `most` lanes, with Adam; the state is carried between windows.

        adam is what the call for earlier documents returned.
        """
        flat = self.flat()
        self.load(flat)
        m, v, t = adam or [np.zeros_like(flat), np.zeros_like(flat), 0]
        g, grads, at = np.zeros_like(flat), {}, 0
        for k, a in self.p.items():  # the gradients are views of one row, like the weights
            grads[k] = g[at : at + a.size].reshape(a.shape)
            at += a.size
        size = 8192  # weights at a time, so that they stay in the processor's cache
        one, two = np.empty(size, np.float32), np.empty(size, np.float32)
        h = np.zeros((0, HIDDEN), np.float32)
        docs = [d[at : at + SEGMENT] for d in docs for at in range(0, len(d), SEGMENT)]  # the state starts anew in a text every SEGMENT tokens, when learning
        for xs, ys, _ in windows(docs, most, self.begin):
            h = h[: xs.shape[1]] if len(h) else np.zeros((xs.shape[1], HIDDEN), np.float32)
            h, _ = self.window(xs, ys, h, self.safe(), grads)
            t += 1
            short = np.float32(min(1.0, 1.0 / max(float(np.sqrt(g @ g)), 1e-9)))
            step, grown = np.float32(rate * min(1.0, t / 20) / (1 - 0.9**t)), np.float32(1 / (1 - 0.99**t))
            for at in range(0, len(flat), size):
                gs, ms, vs, ws = (a[at : at + size] for a in (g, m, v, flat))
                a, b = one[: len(gs)], two[: len(gs)]
                np.multiply(gs, short, out=a)
                np.subtract(a, ms, out=b)
                b *= np.float32(0.1)
                ms += b
                a *= a
                a -= vs
                a *= np.float32(0.01)
                vs += a
                np.multiply(vs, grown, out=a)
                np.sqrt(a, out=a)
                a += np.float32(1e-6)
                np.multiply(ms, step, out=b)
                b /= a
                ws -= b
        return [m, v, t]

    def window(self, xs: np.ndarray, ys: np.ndarray, h: np.ndarray, safe: bool = False, g: dict | None = None):
        """State after a window, and the mean loss's gradients, in the arrays of g if it is given."""
        n, p, kept = HIDDEN, self.p, {}
        states, h = self.forward(xs, np.asarray(h, p["u"].dtype), kept)
        g = g or {k: np.empty_like(a) for k, a in p.items()}
        for a in g.values():
            a[...] = 0
        real = np.flatnonzero(ys.reshape(-1) >= 0)
        flat, token = states.reshape(-1, n), ys.reshape(-1)
        new = partial(self.room, kind=flat.dtype)
        if len(real) < len(token):
            flat, token = flat.take(real, axis=0), token[real]
        cls, scale = self.classes(token), states.dtype.type(1.0 / max(1, len(real)))
        back, ones = new("back", len(flat), n), np.ones(max(p["cb"].size, self.width), flat.dtype)
        one = new("one", len(flat), n + 1)  # states with a 1 behind, so that one product serves weights and biases
        one[:, :n], one[:, n] = flat, 1
        rows, outer, inner = np.arange(max(ROWS, len(flat))), np.vstack((p["c"], p["cb"])), np.concatenate((p["o"], p["ob"][:, None]), axis=1)

        def error(s: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Softmax less the right answers, in place."""
            if not safe:
                s -= s.max(1, keepdims=True)
            np.exp(s, out=s)
            s *= (1 / (s @ ones[: s.shape[1]]))[:, None]
            s.reshape(-1)[rows[: len(s)] * s.shape[1] + right] -= 1
            return s

        to_outer, cT = np.zeros_like(outer), np.ascontiguousarray(p["c"].T)
        for at in range(0, len(flat), ROWS):
            part = one[at : at + ROWS]
            d = error(part @ outer, cls[at : at + ROWS])
            to_outer += part.T @ d
            np.matmul(d, cT, out=back[at : at + ROWS])
        head, edges = self.by_class(token, cls)
        inside, slot, more, to_inner = np.take(one, head, axis=0, out=new("inside", len(head), n + 1), mode="clip"), self.slot[token[head]], new("more", len(head), n), np.zeros_like(inner)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = int(edges[k]), int(edges[k + 1])
            d = error(inside[a:b] @ inner[k], slot[a:b])
            np.matmul(inside[a:b].T, d, out=to_inner[k])
            np.matmul(d, p["o"][k].T, out=more[a:b])
        back[head] += more
        back *= scale
        for k, whole in (("c", to_outer[:n]), ("cb", to_outer[n]), ("o", to_inner[:, :n]), ("ob", to_inner[:, n])):
            np.multiply(whole, scale, out=g[k])
        if len(real) < xs.size:
            whole = np.zeros((xs.size, n), back.dtype)
            whole[real] = back
            back = whole
        back = back.reshape(states.shape)
        z, r, c, before, rh = (kept[k] for k in ("z", "r", "c", "before", "rh"))
        stay = np.subtract(1, z, out=new("stay", *z.shape))
        to_z = np.subtract(c, before, out=new("to_z", *z.shape))
        to_z *= stay
        to_z *= z
        to_c = c
        to_c *= c
        np.subtract(1, to_c, out=to_c)
        to_c *= z
        to_r = np.subtract(1, r, out=new("to_r", *z.shape))
        to_r *= rh  # before times r
        moved = new("moved", *xs.shape, 3 * n)
        fresh = xs == self.begin
        some, ut, vt = fresh.any(1), np.ascontiguousarray(p["u"].T), np.ascontiguousarray(p["v"].T)
        dh, drh, more, dc = np.zeros_like(states[0]), np.empty_like(states[0]), np.empty_like(states[0]), np.empty_like(states[0])
        for t in range(len(xs) - 1, -1, -1):
            dh += back[t]
            m = moved[t]
            np.multiply(dh, to_c[t], out=dc)
            np.matmul(dc, vt, out=drh)
            np.multiply(dh, to_z[t], out=m[:, :n])
            np.multiply(drh, to_r[t], out=m[:, n : 2 * n])
            m[:, 2 * n :] = dc
            dh *= stay[t]
            drh *= r[t]
            dh += drh
            np.matmul(m[:, : 2 * n], ut, out=more)
            dh += more
            if some[t]:
                dh[fresh[t]] = 0
        moved = moved.reshape(-1, 3 * n)
        np.matmul(before.reshape(-1, n).T, moved[:, : 2 * n], out=g["u"])
        np.matmul(rh.reshape(-1, n).T, moved[:, 2 * n :], out=g["v"])
        token = xs.reshape(-1).astype(np.int16 if self.begin < 1 << 15 else np.int32)
        order = np.argsort(token, kind="stable")  # rows of equal inputs side by side, to be added up
        edges = np.flatnonzero(np.diff(token[order], prepend=-1))
        g["x"][token[order[edges]]] = added_up(np.take(moved, order, axis=0, out=new("sorted", *moved.shape), mode="clip"), edges)
        return h, g

    def score(self, docs: list[np.ndarray], most: int = 256) -> np.ndarray:
        """Natural log probability of each text (tokens with the end last): classes, and inside them for head words."""
        if not docs:
            return np.zeros(0)
        out, safe = np.zeros(len(docs)), self.safe()
        h = np.zeros((0, HIDDEN), np.float32)
        for xs, ys, who in windows(docs, most, self.begin):  # the state goes on from window to window
            h = h[: xs.shape[1]] if len(h) else np.zeros((xs.shape[1], HIDDEN), np.float32)
            states, h = self.forward(xs, h)
            ys, who, states = ys.reshape(-1), who.reshape(-1), states.reshape(-1, HIDDEN)
            real = np.flatnonzero(ys >= 0)
            if len(real) < len(ys):
                ys, who, states = ys[real], who[real], states[real]
            out += np.bincount(who, weights=self.logp(states, ys, safe), minlength=len(docs))
        return out


def added_up(rows: np.ndarray, edges: np.ndarray, few: int = 8) -> np.ndarray:
    """The sum of each run of rows, given where the runs begin: long runs by a product, short ones side by side."""
    out, ones, sizes = rows[edges], np.ones(len(rows), rows.dtype), np.diff(edges, append=len(rows))
    for k in np.flatnonzero(sizes > few):
        out[k] = ones[: sizes[k]] @ rows[edges[k] : edges[k] + sizes[k]]
    short = np.flatnonzero(sizes <= few)
    for j in range(1, few):
        short = short[sizes[short] > j]
        out[short] += rows[edges[short] + j]
    return out


def windows(docs: list[np.ndarray], most: int, begin: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Inputs, targets and whose they are, WINDOW steps by the lanes that have not ended; -1 pads targets.

    Texts go, the longest first, each to the lane with least in it, and lanes come by descending length, so those that end are the last ones.
    Only the texts themselves and one window are held, so one very long text beside short ones costs no more than its tokens.
    """
    if not docs:
        return
    count = min(most, len(docs))
    heap = [(0, k) for k in range(count)]
    place: list[list[int]] = [[] for _ in range(count)]
    for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
        size, k = heapq.heappop(heap)
        place[k].append(i)
        heapq.heappush(heap, (size + len(docs[i]), k))
    sizes = sorted(heap, key=lambda x: (-x[0], x[1]))
    order = [i for _, k in sizes for i in place[k]]
    lengths = np.array([len(docs[i]) for i in order], np.int64)
    targets = np.concatenate([docs[i] for i in order]).astype(np.int32)
    inputs = np.empty_like(targets)
    inputs[1:] = targets[:-1]
    inputs[np.cumsum(lengths) - lengths] = begin
    owner = np.repeat(np.array(order, np.int32), lengths)
    size = np.array([s for s, _ in sizes], np.int64)
    start = np.cumsum(size) - size
    for at in range(0, int(size[0]), WINDOW):
        busy = int((size > at).sum())
        step = at + np.arange(min(WINDOW, int(size[0]) - at))[:, None]
        there = step < size[:busy]
        flat = np.where(there, start[:busy] + step, 0)
        yield np.where(there, inputs[flat], begin), np.where(there, targets[flat], -1), owner[flat]


# ---------------------------------------------------------------------------------------------- counts and scores


def _held_out(doc_id):
    return remainder(doc_id, 10) == 0


def counts(body: DataFrame) -> DataFrame:
    """(word, c, n) for every distinct word: its count in training documents and in all. Words are added up in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.concat_tables(kept).group_by("word", use_threads=False).aggregate([("c", "sum"), ("n", "sum")]).rename_columns(["word", "c", "n"])

        kept: list[pa.Table] = []
        for b in pieces(batches):
            some, sizes = split(b.column("text"))
            train = ~b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            some = some.dictionary_encode()
            word, at = pa.concat_arrays([some.dictionary.cast(pa.binary()), pa.array([END], pa.binary())]), some.indices.to_numpy()
            c, n = np.bincount(at[np.repeat(train, sizes)], minlength=len(word)), np.bincount(at, minlength=len(word))
            c[-1], n[-1] = train.sum(), len(train)
            kept.append(pa.table({"word": word, "c": pa.array(c, pa.int64()), "n": pa.array(n, pa.int64())}))
            if sum(map(len, kept)) > 1_000_000:  # about 50 MB
                yield from made().to_batches()
                kept = []
        if kept:
            yield from made().to_batches()

    return body.select("text", "held_out").mapInArrow(run, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


class Model:
    """What scoring needs, of bounded size: the listed words with their numbers and counts, letter pairs, network and totals of the tail classes."""

    def __init__(self, listed: list[tuple[bytes, int]], n: int, v: int, letters: np.ndarray):
        listed = listed if any(w == END for w, _ in listed) else [*listed, (END, 0)]
        order = sorted(listed, key=lambda x: (x[0] != END, -x[1], x[0]))
        self.n, self.v, self.letters = n, v, letters
        self.index = {w: i for i, (w, _) in enumerate(order)}
        self.count = np.array([c for _, c in order], np.int64)
        self.heads = max(1, min(HEAD, int((self.count > 0).sum())))
        self.tail = np.zeros(len(order), np.int64)
        self.tail[self.heads :] = tail_class([w for w, _ in order[self.heads :]], letters)
        self.words = [w for w, _ in order]
        place = np.arange(len(order))
        self.token = np.where(place < self.heads, place, self.heads + self.tail)
        self.net: Net | None = None
        self.learned = 0  # tokens that the network learned from, over all passes

    def base(self, c):
        return np.log10((np.asarray(c) + SMOOTH) / (self.n + SMOOTH * (self.v + 1)))


def lanes(seen: int) -> int:
    """How many lanes a round learns in, by how many tokens were learned from before it."""
    return max(FEW, min(4 * LANES, 4 * LANES * seen // AMPLE))


def coded(column: pa.Array) -> list[np.ndarray]:
    """Network tokens of each row of a column that encode() wrote."""
    return [np.frombuffer(x, TOKEN) for x in column.to_pylist()]


def learn(train: DataFrame, model: Model) -> int:
    """Learns the weights of the model's network from all rows of train (turn, tokens), whole texts; how many tokens were learned from, over all passes."""
    context, net = train.sparkSession.sparkContext, model.net
    held, flat, seen = context.broadcast(net), net.flat(), 0

    def tasks(now, rate: float, most: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, adam, n = copy(held.value), None, 0
            mine.p = dict(mine.p)
            mine.load(now.value)
            for b in pieces(batches, "tokens"):
                docs = coded(b.column("tokens"))
                adam = mine.learn(docs, rate, adam, most)
                n += sum(map(len, docs))
            if n:
                got = mine.flat()
                parts = [got[at : at + BLOCK].tobytes() for at in range(0, len(got), BLOCK)]
                yield pa.record_batch({"block": pa.array(range(len(parts)), pa.int32()), "task": pa.array([TaskContext.get().partitionId()] * len(parts), pa.int32()), "n": pa.array([n] * len(parts), pa.int64()), "part": pa.array(parts, pa.binary())})

        return run

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("task")  # always the same order of sums
        n, total = rows.column("n").to_pylist(), 0.0
        for k, part in zip(n, rows.column("part")):
            total = total + k * np.frombuffer(part.as_py(), np.float32).astype(np.float64)
        return pa.table({"block": rows.column("block").slice(0, 1), "n": pa.array([sum(n)], pa.int64()), "part": pa.array([(total / sum(n)).astype(np.float32).tobytes()], pa.binary())})

    for i in range(PASSES):
        for low, high in zip(ROUNDS, ROUNDS[1:]):
            mine = train.where((F.col("turn") < high) & (F.col("turn") >= low)).select("tokens").coalesce(max(1, model.n // SHARE))
            now, rate = context.broadcast(flat), 0.01 * max(0.1, 1 - (i + (low + high) / 2) / PASSES)
            made = mine.mapInArrow(tasks(now, rate, lanes(seen)), "block int, task int, n long, part binary")
            got = sorted((r.block, bytes(r.part), r.n) for r in made.groupBy("block").applyInArrow(mean, "block int, n long, part binary").collect())
            if got:
                flat, seen = np.concatenate([np.frombuffer(part, np.float32) for _, part, _ in got]), seen + got[0][2]
            now.destroy()
    net.load(flat)
    held.destroy()
    return seen


def encode(body: DataFrame, model: Model) -> DataFrame:
    """A row for each of body: its network tokens, when they are learned from (turn), and what its score needs beside the network, as far as the listed words go."""
    held = body.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, task, row = held.value, TaskContext.get().partitionId(), 0
        listed, tails = pa.array(m.words, pa.large_binary()), np.arange(len(m.count)) >= m.heads
        # by places in the list; the last entry is for words that are not in it
        known, base = np.append(m.count > 0, False), np.append(m.base(m.count), 0)
        inside = np.append(np.where(tails, np.log10(m.count + SMOOTH) - m.mass[m.tail], 0), 0)
        token_of = np.append(m.token, 0).astype(TOKEN)
        for b in pieces(batches):
            some, sizes = split(b.column("text"))
            n, ends = b.num_rows, np.cumsum(sizes + 1)
            found = pc.index_in(some, value_set=listed)
            is_word = np.ones(ends[-1], bool)
            is_word[ends - 1] = False
            at = np.zeros(len(is_word), np.int32)  # the end has place 0
            at[is_word] = pc.fill_null(found, -1).to_numpy()
            owner, token, rare = np.repeat(np.arange(n), sizes + 1), token_of[at], np.flatnonzero(at < 0)
            loose = some.filter(pc.is_null(found)).dictionary_encode()
            which, fresh = loose.indices.to_numpy(), loose.dictionary
            if len(rare):  # the classes of words not listed are found once for each distinct word
                token[rare] = (m.heads + tail_class(fresh.to_pylist(), m.letters)).astype(TOKEN)[which]
            pair, times = np.unique(owner[rare] * max(1, len(fresh)) + which, return_counts=True)
            edges = pa.array(np.searchsorted(pair, np.arange(n + 1) * max(1, len(fresh))).astype(np.int32))
            whose = fresh.take(pa.array(pair % max(1, len(fresh)))).cast(pa.binary())
            total = lambda x: np.bincount(owner, weights=x[at], minlength=n)
            names = ["task", "row", "doc_id", "held_out", "turn", "n_tokens", "known", "base", "inside", "loose", "times", "tokens"]
            columns = [pa.array([task] * n, pa.int32()), pa.array(range(row, row + n), pa.int64()), *(b.column(c) for c in ("doc_id", "held_out", "turn")), pa.array(sizes + 1)]
            columns += [pa.array(total(known).astype(np.int64)), pa.array(total(base)), pa.array(total(inside)), pa.ListArray.from_arrays(edges, whose), pa.ListArray.from_arrays(edges, pa.array(times, pa.int64()))]
            bounds = np.concatenate(([0], ends)) * token.itemsize
            columns.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(token)]).cast(pa.binary()))
            row += n
            yield pa.RecordBatch.from_arrays(columns, names)

    turn = body.select("doc_id", "text", "held_out", turn_of("doc_id", F.xxhash64("text")).alias("turn"))
    return cut(turn.mapInArrow(run, "task int, row long, doc_id long, held_out boolean, turn double, n_tokens long, known long, base double, inside double, loose array<binary>, times array<long>, tokens binary"), "encoded")


def fit(body: DataFrame, vocabulary: DataFrame) -> tuple[Model, tuple[DataFrame, DataFrame]]:
    """The model; the table of words that are not listed, with their counts and classes; and the encoded texts."""
    total = vocabulary.agg(F.sum("c"), F.sum(F.when(F.col("c") > 0, 1))).first()
    # The listed words: counts are split into slices of a 64th of a power of two, and whole slices are taken from the top
    # as long as at most LISTED words come together. So the driver gets a few thousand sums and then those words alone.
    level = F.floor(F.log2("n") * 64).cast("int")
    sums, room, lowest = {r[0]: r[1] for r in vocabulary.groupBy(level).count().collect()}, LISTED, 1 << 30
    for at in sorted(sums, reverse=True):
        room -= sums[at]
        if room < 0:
            break
        lowest = at
    listed = [(bytes(r.word), r.c) for r in vocabulary.where((level >= lowest) | (F.col("word") == F.lit(END))).select("word", "c").collect()]
    train = body.where("NOT held_out")
    size = train.count()
    chosen = train.where(hash_below(F.lit(SAMPLE / max(size, 1)), "doc_id", F.xxhash64("text")))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for line in texts(b.column("text")):
                w = words(line)
                at = (len(line) * 2654435761 >> 5) % (max(1, len(w) - CUT + 1))
                out.append(b" ".join(w[at : at + CUT]))
            yield pa.record_batch({"line": pa.array(out, pa.binary())})

    lines = sorted(bytes(r.line) for r in chosen.select("text").mapInArrow(some, "line binary").collect() if r.line)
    centre = seeds([lines[i] for i in np.random.default_rng(3).permutation(len(lines))])
    model = Model(listed, int(total[0] or 0), int(total[1] or 0), clusters(train, centre))
    letters, known = model.letters, model.index
    kept = body.sparkSession.sparkContext.broadcast((letters, set(known)))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, known = kept.value
        for b in batches:
            some = b.column("word").to_pylist()
            rare = [i for i, w in enumerate(some) if w not in known]
            at = pa.array(rare, pa.int64())
            yield pa.record_batch({"word": b.column("word").take(at), "c": b.column("c").take(at), "class": pa.array(tail_class([some[i] for i in rare], letters).astype(np.int32))})

    rare = cut(vocabulary.where("c > 0").select("word", "c").mapInArrow(classify, "word binary, c long, class int"), "rare-words")
    mass, kinds = np.zeros(TAILS), np.zeros(TAILS)
    for r in rare.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        mass[r["class"]], kinds[r["class"]] = r.c, r.v
    inner = np.arange(len(model.count)) >= model.heads
    np.add.at(mass, model.tail[inner], model.count[inner])
    np.add.at(kinds, model.tail[inner], model.count[inner] > 0)
    model.mass = np.log10(mass + SMOOTH * (kinds + 1))
    group = tail_class([w if w != END else b"." for w in model.words[: model.heads]], letters) // ENDINGS
    model.net = Net(model.count[: model.heads].astype(float), group, mass)
    encoded = encode(body, model)
    model.learned = learn(encoded.where("NOT held_out").select("turn", "tokens"), model)
    return model, (rare, encoded)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) for every row of docs, over its whole text.

    A null, empty or blank text is the end alone. A null doc_id counts as the empty text for the fold. Repeated rows come back repeated and
    are counted as often as they stand there. Only doc_id and text are read. An empty table gives an empty table; with no training
    document every word is unknown.
    """
    spark = docs.sparkSession
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", _held_out(F.col("doc_id")))
    vocabulary = cut(counts(body), "words")
    model, (rare, encoded) = fit(body, vocabulary)
    held, net = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(model.net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = net.value
        for b in pieces(batches, "tokens"):
            got = n.score(coded(b.column("tokens"))) / np.log(10)
            yield pa.record_batch({"score": pa.array(got + b.column("inside").to_numpy()), **{c: b.column(c) for c in KEPT}})

    scored = encoded.select("tokens", "inside", *KEPT).mapInArrow(run, "score double, task int, row long, doc_id long, held_out boolean, n_tokens long, known long, base double")
    # The words not listed meet their counts. A class's total is looked up by the word's own class, known to the table of counts;
    # a word that the table lacks was never seen, and its class comes from its bytes again.
    loose = encoded.select("task", "row", F.explode(F.arrays_zip("loose", "times")).alias("w")).select("task", "row", F.col("w.loose").alias("word"), F.col("w.times").alias("times"))
    met = loose.join(rare.hint("shuffle_hash"), "word", "left").select("task", "row", "word", "times", "c", "class")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            times, c = b.column("times").to_numpy().astype(float), np.nan_to_num(np.asarray(b.column("c").to_numpy(zero_copy_only=False), float))
            kind = np.nan_to_num(np.asarray(b.column("class").to_numpy(zero_copy_only=False), float), nan=-1).astype(np.int64)
            new = np.flatnonzero(kind < 0)
            if len(new):
                kind[new] = tail_class(b.column("word").take(pa.array(new)).to_pylist(), m.letters)
            yield pa.record_batch({"task": b.column("task"), "row": b.column("row"), "known": pa.array(np.where(c > 0, times, 0).astype(np.int64)), "base": pa.array(times * m.base(c)), "score": pa.array(times * (np.log10(c + SMOOTH) - m.mass[kind]))})

    extra = met.mapInArrow(add, "task int, row long, known long, base double, score double").groupBy("task", "row").agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")))
    whole = scored.join(extra, ["task", "row"], "left")
    total = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    return whole.select("doc_id", "held_out", "n_tokens", total("known").cast("long").alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"), total("base").alias("base_score"), total("score").alias("score"))
