"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own embedding (one for all words outside the vocabulary) beside the mean embedding of its character
trigrams. Two gated recurrent layers read a window of WINDOW words from both ends; attention pools their states into one logit.
A document's score is the sigmoid of its greatest logit over all windows, which overlap by half, so a short insult counts the
same in a text of any length. The labels are the documents' own: in training each document teaches through its window with the
greatest logit.

The network is fitted on at most TRAIN_DOCS labelled documents of at most TRAIN_CHARS characters, in the order of a hash of the
doc_id; the rows with crc32(doc_id) mod 5 = 0 are held out and never seen. Scoring covers every word of every document.

Defined results: null and empty texts get the share of toxic documents in the sample (0 without labels); without labels of both
classes every text does; a null doc_id is not held out; a document labelled twice is toxic if any label says so; null labels
teach nothing; repeated documents get a row each; a column named like the score is replaced by it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import words as words_of

WINDOW, STRIDE = 24, 12
TRAIN_DOCS, TRAIN_CHARS = 4_000, 20_000
VOCABULARY = 30_000
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 12, 8, 8
TRIGRAMS = 4_096
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Steps at least, so that few labels are seen more often.
STEPS = 400
CACHE = 80_000
PAD, RARE = 0, 1


PUNCTUATION = re.compile(r"[\W_]+")


def normal(word: str) -> str:
    """Letters and digits of a word, lower-cased."""
    low = word.lower()
    return (low if low.isalnum() else PUNCTUATION.sub("", low)) or "#"


def trigrams(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the character trigrams of words with their ends marked, and how many each word has; long words are read whole."""
    count = np.fromiter(map(len, forms), np.int64, len(forms))
    codes = np.frombuffer("".join([f"<{w}>" for w in forms]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    slots = (codes[:-2] * 1_000_003 + codes[1:-1] * 8_191 + codes[2:] * 127) % TRIGRAMS
    # a word of n letters has n trigrams; the two that begin at its last marks reach into the next word
    inside = np.ones(len(codes), bool)
    end = np.cumsum(count + 2)
    inside[end - 1] = inside[end - 2] = False
    return slots[inside[:-2]], count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _squash(x: np.ndarray, scale: int = -1) -> None:
    """In place: the sigmoid of x, or with scale -2 its hyperbolic tangent, 2 * sigmoid(2 * x) - 1. exp is numpy's fastest way."""
    x *= np.float32(scale)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += np.float32(1)
    np.reciprocal(x, out=x)
    if scale == -2:
        x *= np.float32(2)
        x -= np.float32(1)


class Network:
    """Parameters and the forward pass. p holds the arrays by name."""

    def __init__(self, vocabulary: list[str], seed: int = 5):
        self.number = {w: i + 2 for i, w in enumerate(vocabulary)}
        rng = np.random.default_rng(seed)
        normal_ = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        size, three = WORD_DIM + CHAR_DIM, 3 * HIDDEN
        self.p = {"word": normal_(len(vocabulary) + 2, WORD_DIM, scale=0.1), "char": normal_(TRIGRAMS, CHAR_DIM, scale=0.1)}
        for d in "fb":
            self.p |= {f"W{d}": normal_(size, three, scale=0.3), f"U{d}": normal_(HIDDEN, three, scale=0.3), f"c{d}": np.zeros(three, np.float32)}
        self.p |= {"A": normal_(2 * HIDDEN, ATTEND, scale=0.3), "a": np.zeros(ATTEND, np.float32), "v": normal_(ATTEND, scale=0.3), "o": normal_(2 * HIDDEN, scale=0.3), "bias": np.full(1, -2, np.float32)}
        self.base = 0.0

    def inputs(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each form: its embedding number, its input vector, and its trigrams as slots and owners."""
        ids = np.array([self.number.get(w, RARE) for w in forms], np.int64)
        if not forms:
            return ids, np.zeros((0, WORD_DIM + CHAR_DIM), np.float32), ids, ids
        slots, count = trigrams(forms)
        owner = np.repeat(np.arange(len(forms)), count)
        chars = np.add.reduceat(self.p["char"][slots], np.cumsum(count) - count, axis=0) / count[:, None]
        return ids, np.concatenate([self.p["word"][ids], chars], axis=1).astype(np.float32), slots, owner

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """Input sides of all gates, forward then backward; the first row is the pad, whose update gate keeps the state."""
        rows = np.concatenate([inputs @ self.p["Wf"] + self.p["cf"], inputs @ self.p["Wb"] + self.p["cb"]], axis=1)
        pad = np.zeros((1, rows.shape[1]), np.float32)
        pad[0, :HIDDEN] = pad[0, 3 * HIDDEN : 4 * HIDDEN] = 40
        return np.concatenate([pad, rows]).astype(np.float32)

    def logits(self, gates: np.ndarray | list[np.ndarray], windows: np.ndarray) -> np.ndarray:
        """Of windows of row numbers (0: pad) in gates, or in their forward and backward halves."""
        out = np.empty(len(windows), np.float32)
        sides = gates if isinstance(gates, list) else [np.ascontiguousarray(g) for g in np.hsplit(gates, 2)]
        turned = [np.ascontiguousarray(self.p[u].T) for u in ("Uf", "Ub")]
        attend = np.ascontiguousarray(self.p["A"].T)
        # windows are the last axis throughout, so that every step works on long runs of memory
        for i in range(0, len(windows), 2_048):
            part = np.ascontiguousarray(windows[i : i + 2_048].T)
            n = part.shape[1]
            states = np.empty((WINDOW, 2 * HIDDEN, n), np.float32)
            gathered, g = np.empty((n, 3 * HIDDEN), np.float32), np.empty((3 * HIDDEN, n), np.float32)
            for d in range(2):
                h = np.zeros((HIDDEN, n), np.float32)
                for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                    np.take(sides[d], part[t], axis=0, out=gathered, mode="clip")
                    np.matmul(turned[d], h, out=g)
                    x = gathered.T
                    zr, new = g[: 2 * HIDDEN], g[2 * HIDDEN :]
                    zr += x[: 2 * HIDDEN]
                    _squash(zr)
                    new *= zr[HIDDEN:]
                    new += x[2 * HIDDEN :]
                    _squash(new, -2)
                    h -= new
                    h *= zr[:HIDDEN]
                    h += new
                    states[t, d * HIDDEN : (d + 1) * HIDDEN] = h
            hidden = attend @ states
            hidden += self.p["a"][:, None]
            _squash(hidden, -2)
            score = np.einsum("tan,a->tn", hidden, self.p["v"])
            score[part == PAD] = -1e9
            score -= score.max(axis=0)
            weight = np.exp(score)
            weight /= weight.sum(axis=0)
            told = np.einsum("thn,h->tn", states, self.p["o"])
            out[i : i + n] = (weight * told).sum(axis=0) + self.p["bias"]
        return out

    def gradients(self, forms: list[str], windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss over windows (row 0 is the pad, row i + 1 is forms[i])."""
        p, n = self.p, len(windows)
        ids, inputs, slots, owner = self.inputs(forms)
        gates = self.projected(inputs)
        real = (windows != PAD).T[:, :, None]
        kept, states = {}, np.zeros((WINDOW, n, 2 * HIDDEN), np.float32)
        for d, lo in (("f", 0), ("b", 3 * HIDDEN)):
            h, own = np.zeros((n, HIDDEN), np.float32), []
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                x, g = gates[windows[:, t], lo : lo + 3 * HIDDEN], h @ p[f"U{d}"]
                z, r = sigmoid(x[:, :HIDDEN] + g[:, :HIDDEN]), sigmoid(x[:, HIDDEN : 2 * HIDDEN] + g[:, HIDDEN : 2 * HIDDEN])
                new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
                own.append((t, h, z, r, new, g[:, 2 * HIDDEN :]))
                h = (1 - z) * new + z * h
                states[t, :, slice(0, HIDDEN) if d == "f" else slice(HIDDEN, None)] = h
            kept[d] = own
        hidden = np.tanh(states @ p["A"] + p["a"])
        score = np.where(real[:, :, 0], hidden @ p["v"], -1e9)
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        slope = (sigmoid(pooled @ p["o"] + p["bias"]) - target) / n
        grad = {"o": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        d_pool = slope[:, None] * p["o"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[:, :, None] * p["v"] * (1 - hidden**2)
        grad["A"], grad["a"] = np.einsum("tnh,tna->ha", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["A"].T
        d_inputs = np.zeros_like(inputs)
        for d, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            d_gates, d_u, dh = np.zeros((len(gates), 3 * HIDDEN)), np.zeros_like(p[f"U{d}"]), np.zeros((n, HIDDEN))
            for t, h, z, r, new, g_new in reversed(kept[d]):
                dh = dh + d_states[t, :, side]
                d_new = dh * (1 - z) * (1 - new**2)
                d_z, d_r = dh * (h - new) * z * (1 - z), d_new * g_new * r * (1 - r)
                np.add.at(d_gates, windows[:, t], np.concatenate([d_z, d_r, d_new], axis=1))
                d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ d_g
                dh = dh * z + d_g @ p[f"U{d}"].T
            d_gates = d_gates[1:]  # the pad learns nothing
            grad |= {f"U{d}": d_u, f"W{d}": inputs.T @ d_gates, f"c{d}": d_gates.sum(axis=0)}
            d_inputs += d_gates @ p[f"W{d}"].T
        grad["word"], grad["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(grad["word"], ids, d_inputs[:, :WORD_DIM])
        share = d_inputs[:, WORD_DIM:] / np.maximum(np.bincount(owner, minlength=len(forms)), 1)[:, None]
        np.add.at(grad["char"], slots, share[owner])
        return grad


def cut(numbers: np.ndarray) -> np.ndarray:
    """All windows of a text's row numbers, half overlapping, the last padded."""
    n = len(numbers)
    count = max(1, -(-(n - WINDOW) // STRIDE) + 1)
    padded = np.zeros(STRIDE * (count - 1) + WINDOW, np.int64)
    padded[:n] = numbers
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]


def fit(texts: list[str], toxic: list[int]) -> Network:
    """A network trained on texts and their labels."""
    forms = [[normal(w) for w in words_of(t)] for t in texts]
    pairs = [(f, y) for f, y in zip(forms, toxic, strict=True) if f]
    seen = Counter(w for f, _ in pairs for w in set(f))
    network = Network([w for w, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY] if n > 1])
    network.base = float(np.mean(toxic)) if toxic else 0.0
    if len(set(y for _, y in pairs)) < 2:
        network.p["o"][:] = 0
        network.p["bias"][:] = 40.0 if network.base == 1 else -40.0
        return network
    rng = np.random.default_rng(11)
    moment = {k: np.zeros_like(v) for k, v in network.p.items()}
    square = {k: np.zeros_like(v) for k, v in network.p.items()}
    step = 0
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(pairs)))
    for epoch in range(epochs):
        order = rng.permutation(len(pairs))
        for i in range(0, len(order), BATCH):
            chosen = [pairs[k] for k in order[i : i + BATCH]]
            own = sorted({w for f, _ in chosen for w in f})
            row = {w: j + 1 for j, w in enumerate(own)}
            windows = [cut(np.array([row[w] for w in f])) for f, _ in chosen]
            begin = np.concatenate(([0], np.cumsum([len(w) for w in windows])[:-1]))
            every = np.concatenate(windows)
            logit = network.logits(network.projected(network.inputs(own)[1]), every)
            best = np.array([b + int(np.argmax(logit[b : b + len(w)])) for b, w in zip(begin, windows, strict=True)])
            taught, numbers = np.unique(every[best], return_inverse=True)
            at = 0 if taught[0] == PAD else 1  # without a pad the rows still begin at 1
            grads = network.gradients([own[j - 1] for j in taught if j], numbers.reshape(-1, WINDOW) + at, np.array([y for _, y in chosen], np.float32))
            step += 1
            rate = RATE * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                moment[k] += 0.1 * (g - moment[k])
                square[k] += 0.001 * (g * g - square[k])
                network.p[k] -= (rate * moment[k] / (np.sqrt(square[k]) + 1e-7)).astype(np.float32)
    return network


class _Rows(dict):
    """Word -> row of the gate matrix; new words are gathered and projected together."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self) + 1
        self.fresh.append(normal(word))
        return row


class Scorer:
    def __init__(self, network: Network):
        self.network = network
        self._empty()

    def _empty(self) -> None:
        self.rows, self.filled = _Rows(), 0
        self.sides = [np.empty((1 << 14, 3 * HIDDEN), np.float32) for _ in range(2)]
        self._add([])

    def _add(self, forms: list[str]) -> None:
        """Project new words into the rows that follow; the first row is the pad."""
        new = self.network.projected(self.network.inputs(forms)[1])[1 if self.filled else 0 :]
        end = self.filled + len(new)
        while end > len(self.sides[0]):
            self.sides = [np.concatenate([side, np.empty_like(side)]) for side in self.sides]
        for side, part in zip(self.sides, np.hsplit(new, 2), strict=True):
            side[self.filled : end] = part
        self.filled = end

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self._empty()
        split = [words_of(t) for t in texts]
        numbers = [np.fromiter(map(self.rows.__getitem__, w), np.int64, len(w)) for w in split]
        if self.rows.fresh:
            self._add(self.rows.fresh)
            self.rows.fresh = []
        score = np.full(len(texts), self.network.base)
        full = [i for i, n in enumerate(numbers) if len(n)]
        if full:
            windows = [cut(numbers[i]) for i in full]
            logit = self.network.logits(self.sides, np.concatenate(windows))
            begin = np.concatenate(([0], np.cumsum([len(w) for w in windows])[:-1]))
            score[full] = sigmoid(np.maximum.reduceat(logit, begin).astype(np.float64))
        return score


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on the documented sample; what comes to the driver is bounded by TRAIN_DOCS * TRAIN_CHARS."""
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    texts = docs.select("doc_id", "text").where(F.length("text") <= TRAIN_CHARS)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id", "text").limit(2 * TRAIN_DOCS).collect()
    return fit([r.text for r in rows], [r.toxic for r in rows])


def score(docs: DataFrame, network: Network, into: str = "score") -> DataFrame:
    """docs with the score added as a column named into; a column of that name in docs gives way."""
    docs = docs.select(*[c for c in docs.columns if c != into])
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scorer(part.column(at).to_pylist()), pa.float64())], [*part.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
