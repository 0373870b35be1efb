"""Quality scores: random-indexing word vectors, pooled per document, and a small calibrated network.

A word's index vector is the sum of fixed sparse random vectors of its units: the word itself, its shape (up to 12
characters), its first and last three letters and its length (up to 20). Random indexing adds up, for each unit, the index
vectors of the words around it over the training sample (words of fewer than ``RARE`` places have only the other units' contexts);
a word's vector is its index vector plus that context, both of unit length, so unseen words have vectors too. A
document is pooled to the mean, the spread and the mean product of neighbouring words' vectors. A network
with one hidden layer scores it, and a temperature fitted on a tenth of the sample calibrates the score.

Defined cases: null texts, empty texts and texts of white space pool to zeros and get the score of that;
null ids count as not held out; repeated rows score alike; an empty table gives no rows; without labels of
both classes the score is the share of label 1 (0.5 without labels); other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import batch_texts, by_bytes
from silverframe.llm.labelled import held_out, labelled_sample

DIM, NONZERO, REMEMBERED, UNITS, RARE, SLICE = 32, 4, 300_000, 5, 5, 1 << 20
_GAP = re.compile(r"\s")
_SHAPES = [(re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ]{2}[^\W\d_]*"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0")]


def units(word: str) -> tuple[str, str, str, str, str]:
    if word.isalpha() and word[1:].islower():
        shape = "a"
    elif word[:-1].isalpha() and word[-1] in ".,;:!?" and word[1:-1].islower():
        shape = "a" + word[-1]
    else:
        shape = word
        for pattern, mark in _SHAPES:
            shape = pattern.sub(mark, shape)
    return "w" + word.strip(".,;:!?").lower(), "s" + shape[:12], "f" + word[:3].lower(), "l" + word[-3:].lower(), "n" + str(min(len(word), 20))


def index_vectors(names: list[str]) -> np.ndarray:
    """The fixed sparse random vector of each unit."""
    v = np.zeros((len(names), DIM), np.float32)
    h = np.fromiter((zlib.crc32(u.encode("utf-8", "surrogatepass")) for u in names), np.uint64, len(names))
    rows = np.arange(len(names))
    for k in range(NONZERO):
        h = (h * np.uint64(2654435761) + np.uint64(97 * k + 1)) & np.uint64(0xFFFFFFFF)
        v[rows, ((h >> np.uint64(8)) % np.uint64(DIM)).astype(np.int64)] += np.where(h >> np.uint64(31), 1, -1)
    return v


class WordVectors:
    """Vectors of words, with a bounded memory of rows."""

    def __init__(self, context: tuple[list[str], np.ndarray] | None = None):
        names, self.contexts = context or ([], np.zeros((0, DIM), np.float32))
        self.place = {u: k for k, u in enumerate(names)}
        self._reset()

    def _reset(self) -> None:
        self.row: dict[str, int] = {}
        self.rows = np.zeros((1024, DIM), np.float32)
        self.unit: dict[str, int] = {}
        self.own, self.around = np.zeros((1024, DIM), np.float32), np.zeros((1024, DIM), np.float32)

    def _unit(self, unit: str) -> int:
        k = self.unit.get(unit)
        if k is None:
            k = self.unit[unit] = len(self.unit)
            if k == len(self.own):
                self.own, self.around = (np.concatenate([m, np.zeros_like(m)]) for m in (self.own, self.around))
            self.own[k] = index_vectors([unit])[0]
            if unit in self.place:
                self.around[k] = self.contexts[self.place[unit]]
        return k

    def _add(self, words: list[str]) -> None:
        named = [units(w) for w in words]
        own = index_vectors([u[0] for u in named])  # words are too many to be kept as units
        at = np.fromiter((self.place.get(u[0], -1) for u in named), np.int64, len(words))
        around = np.zeros_like(own)
        around[at >= 0] = self.contexts[at[at >= 0]]
        k = np.fromiter((self._unit(u) for us in named for u in us[1:]), np.int64, (UNITS - 1) * len(words)).reshape(-1, UNITS - 1)
        for column in k.T:
            own += self.own[column]
            around += self.around[column]
        made = own / (np.linalg.norm(own, axis=1, keepdims=True) + 1e-6) + around / (np.linalg.norm(around, axis=1, keepdims=True) + 1e-6)
        first = len(self.row)
        while len(self.rows) < first + len(words):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : first + len(words)] = made
        self.row.update(zip(words, range(first, first + len(words)), strict=True))

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.row) > REMEMBERED:
            self._reset()
        split = [t.split() for t in texts]
        new = [w for w in set().union(*split) if w not in self.row]
        for at in range(0, len(new), 10_000):
            self._add(new[at : at + 10_000])
        sizes = np.array([len(s) for s in split], np.int64)
        return np.fromiter((i for s in split for i in map(self.row.__getitem__, s)), np.int64, int(sizes.sum())), sizes

    def pooled(self, texts: list[str]) -> np.ndarray:
        """Mean, spread and neighbour product of each text's vectors; long texts go slice by slice."""
        out = np.zeros((len(texts), 3 * DIM), np.float32)
        short = [k for k, t in enumerate(texts) if len(t) <= SLICE]
        ids, sizes = self.ids([texts[k] for k in short])
        some = np.flatnonzero(sizes)
        if len(some):
            v, starts = self.rows[ids], (np.cumsum(sizes) - sizes)[some]
            beside = np.zeros_like(v)
            beside[:-1] = v[:-1] * v[1:]
            beside[starts[1:] - 1] = 0
            out[np.array(short)[some]] = _pool(*(np.add.reduceat(x, starts, axis=0) for x in (v, v * v, beside)), sizes[some, None])
        for k in set(range(len(texts))) - set(short):
            sums, n, last = np.zeros((3, DIM)), 0, None
            for part in slices(texts[k]):
                ids, _ = self.ids([part])
                if len(ids):
                    v = self.rows[ids]
                    ahead = v if last is None else np.concatenate([last, v])
                    sums += [v.sum(0), (v * v).sum(0), (ahead[:-1] * ahead[1:]).sum(0)]
                    n, last = n + len(ids), v[-1:]
            if n:
                out[k] = _pool(*sums, n)
        return out


def _pool(total: np.ndarray, squares: np.ndarray, beside: np.ndarray, n) -> np.ndarray:
    mean = total / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean * mean, 0)), beside / np.maximum(n - 1, 1)], -1)


def slices(text: str):
    """A text in slices of about ``SLICE`` characters, cut at white space."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + SLICE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def contexts(texts: list[str], reach: int = 2) -> tuple[list[str], np.ndarray]:
    """Random indexing: units, and for each the sum of the index vectors of words up to ``reach`` places away."""
    plain = WordVectors()
    words: dict[str, int] = {}
    sums, places = np.zeros((1024, DIM), np.float32), np.zeros(1024, np.int64)
    for text in texts:
        split = text.split()
        if not split:
            continue
        ids, _ = plain.ids([text])
        v = plain.rows[ids]
        total = np.zeros_like(v)
        for k in range(1, min(reach, len(ids) - 1) + 1):
            total[k:] += v[:-k]
            total[:-k] += v[k:]
        own = np.array([words.setdefault(w, len(words)) for w in split])
        while len(words) > len(sums):
            sums, places = np.concatenate([sums, np.zeros_like(sums)]), np.concatenate([places, np.zeros_like(places)])
        np.add.at(sums, own, total)
        places += np.bincount(own, minlength=len(places))
    order: dict[str, int] = {}
    rows = np.array([[order.setdefault(u, len(order)) for u in units(w)] for w in words], np.int64).reshape(-1, UNITS)
    out, seen = np.zeros((len(order), DIM)), np.zeros(len(order), np.int64)
    for column in rows.T:
        np.add.at(out, column, sums[: len(words)])
        np.add.at(seen, column, places[: len(words)])
    names = list(order)
    kept = np.array([k for k, u in enumerate(names) if u[0] != "w" or seen[k] >= RARE], np.int64)
    out = out[kept]
    return [names[k] for k in kept], (out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-6)).astype(np.float32)


class QualityModel:
    def __init__(self, context, mean, scale, layers, temperature, constant=None):
        self.context, self.mean, self.scale, self.layers, self.temperature, self.constant = context, mean, scale, layers, temperature, constant

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(pooled), self.constant)
        return _sigmoid(_forward((pooled - self.mean) / self.scale, self.layers)[1] / self.temperature)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _forward(x, layers):
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden, (hidden @ w2 + b2).astype(float)


def train(docs: list[tuple[str, int]], hidden: int = 32, epochs: int = 60, seed: int = 3) -> QualityModel:
    y = np.array([float(v) for _, v in docs])
    if not len(y) or y.min() == y.max():
        return QualityModel(None, 0, 1, None, 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(docs))
    context = contexts([t for t, _ in docs])
    vectors = WordVectors(context)
    x = np.concatenate([vectors.pooled([t]) for t, _ in docs])
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    kept, tuned = order[len(order) // 10 :], order[: max(1, len(order) // 10)]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    t = 0
    for _ in range(epochs):
        rng.shuffle(kept)
        for at in range(0, len(kept), 128):
            pick = kept[at : at + 128]
            h, z = _forward(x[pick], p)
            d = (_sigmoid(z) - y[pick]) * weight[pick] / len(pick)
            dh = np.outer(d, p[2]) * (1 - h * h)
            grads = [x[pick].T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
    z = _forward(x[tuned], p)[1]
    grid = np.exp(np.linspace(np.log(0.5), np.log(6), 60))
    loss = [np.mean(weight[tuned] * np.logaddexp(0, np.where(y[tuned] == 1, -z, z) / g)) for g in grid]
    return QualityModel(context, mean, scale, p, float(grid[int(np.argmin(loss))]))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 4000, longest: int = 20_000) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents of each class, of at most ``longest`` characters, whose crc32(doc_id) modulo 5 is not 0."""
    return train(labelled_sample(docs, labels, "quality", 5, 0, per_class, longest))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold``) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, per_class))  # units of a bounded sample

    def run(batches):
        vectors = WordVectors(shared.value.context)
        for batch in batches:
            for piece in by_bytes(batch, limit=1 << 20):
                p = shared.value.probability(vectors.pooled(batch_texts(piece)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
