"""A gap-tolerant subsequence string kernel, a support vector machine on Nyström landmarks, and its scoring of words.

The kernel of two words counts the subsequences of two to four characters that they share. An occurrence may skip
up to three characters at each place and weighs ``DECAY`` for each character that it skips, so gapped and
inserted-character spellings stay close to the plain one; words carry marks for their ends, and the kernel is
scaled by the weight of all occurrences that words of their lengths have. A trained machine is a weighted sum of kernels with
landmarks, which is one number per subsequence; the numbers live in a table indexed by a hash of the subsequence.

Training reads labelled sentences. Which words make a toxic document toxic isn't known: they are words and stems whose
frequency in toxic documents of the sample can't be chance (:func:`reliable`). Sentences of toxic documents that hold one
are toxic, their other sentences are left out, and all sentences of other documents are clean. The machine is fitted on the
words of these sentences, each also in gapped, inserted, doubled and replaced spellings, on both sides. A third of the clean
documents is set aside for the calibration.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np

DECAY, SLOTS, LONGEST, STEM, ROOT = 0.6, 1 << 21, 24, 4, 6
LENGTHS = {2: 0.15, 3: 0.6, 4: 1.0}  # weight of each length of subsequence
REACH = (1, 2, 3, 4)  # distances between neighbours: up to three characters skipped at each place
BLOCK = 1 << 18  # subsequences that are hashed together
_EDGES = re.compile(r"^[^\w]+|[^\w]+$")
_SIGNS = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_PLAIN = ".,;:!?\"'()*#$%&"
_ALIKE = {"o": "0", "i": "1", "e": "3", "a": "@", "s": "$", "t": "7", "g": "9"}  # fixed values: usual replacements
_READ = str.maketrans({v: k for k, v in _ALIKE.items()})


def words(text: str) -> list[str]:
    """Raw words; a run of single letters, with or without signs around and between them, is one word (``i d i o t``, ``i . d. - i o t``)."""
    out, run = [], []
    for w in text.split():
        bare = w if w.isalnum() else _SIGNS.sub("", w)
        if len(bare) == 1 and bare.isalpha():
            run.append(bare)
            continue
        if not bare:
            if not run:
                out.append(w)
            continue
        if len(run) > 1:
            out.append("".join(run))
        run = []
        out.append(w)
    if len(run) > 1:
        out.append("".join(run))
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _cut(v: str) -> list[str]:
    v = f"^{v}$"
    return [v] if len(v) <= LONGEST else [v[i : i + LONGEST] for i in range(0, len(v) - LONGEST // 2, LONGEST // 2)]


def windows(word: str) -> list[str]:
    """A raw word as the strings that are compared: lower case, without outer punctuation, long ones in overlapping windows.

    A word with inner signs, or with one string of one to three characters between all its letters, is also compared without them,
    and one with digits or signs also with the letters that they replace.
    """
    w = word.strip(_PLAIN).lower()
    if w.isalpha():
        n = len(w)
        if n < 7 or w[1] not in (w[3], w[4], w[5]):
            return [f"^{w}$"] if n + 2 <= LONGEST else _cut(w)
    else:
        w = _EDGES.sub("", w)
        if not w:
            return []
        if w.isdigit():
            return _cut(w)
    forms = [w]
    if not w.isalpha():
        forms += [_SIGNS.sub("", w), w.translate(_READ)]
    forms += [w[::p] for p in (2, 3, 4) if len(w) > 3 * p and len(w) % p == 1 and w[1] == w[p + 1] and w == w[1:p].join(w[::p])]
    return [s for v in dict.fromkeys(forms) if v for s in _cut(v)]


@lru_cache(maxsize=2 * LONGEST)
def _places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(4 x subsequences) places of the subsequences of a string of ``size`` characters, ``size`` where there is none, and their weights, scaled."""
    rows, weights = [], []
    for n, base in LENGTHS.items():
        for steps in product(REACH, repeat=n - 1):
            offsets = [0, *np.cumsum(steps)]
            for i in range(size - offsets[-1]):
                rows.append([i + k for k in offsets] + [size] * (4 - n))
                weights.append(base * DECAY ** (offsets[-1] - n + 1))
    w = np.array(weights)
    return np.array(rows, np.int64).reshape(-1, 4).T.copy(), (w / (np.linalg.norm(w) or 1)).astype(np.float32)


_MIX = [np.uint32(x) for x in (0x9E3779B1, 0xC2B2AE3D, 0x165667B1, 0x27D4EB2F)]
_AFTER = np.uint32(0x85EBCA6B)
_NOT_SLOT = np.uint32(32 - SLOTS.bit_length() + 1)


def feature_blocks(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(strings, slots, weights) of the occurrences of subsequences, in blocks of strings of equal length."""
    sizes = np.array([len(s) for s in strings], np.int64)
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at, weight = _places(int(size))
        if not at.shape[1]:
            continue
        same = np.flatnonzero(sizes == size)
        step = max(1, BLOCK // at.shape[1])
        for first in range(0, len(same), step):
            who = same[first : first + step]
            chars = np.zeros((len(who), int(size) + 1), np.uint32)  # the last column is no character
            chars[:, :-1] = code[begin[who][:, None] + np.arange(size)]
            h = np.take(chars * _MIX[0], at[0], axis=1)
            for k in (1, 2, 3):
                h += np.take(chars * _MIX[k], at[k], axis=1)
            h ^= h >> np.uint32(15)
            h *= _AFTER
            h ^= h >> np.uint32(13)
            h *= _MIX[1]
            yield who, h >> _NOT_SLOT, weight


def table_scores(strings: list[str], table: np.ndarray) -> np.ndarray:
    """Sum of kernel terms of each string under a table of subsequence weights."""
    out = np.zeros(len(strings))
    table = np.asarray(table, np.float32)
    for who, slot, weight in feature_blocks(strings):
        out[who] = table[slot] @ weight
    return out


def landmark_kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel matrix of strings with landmarks."""
    own = {}
    for who, slot, weight in feature_blocks(landmarks):
        for k, s in zip(who, slot, strict=True):
            own[int(k)] = (s, weight)
    used = np.unique(np.concatenate([s for s, _ in own.values()])) if own else np.empty(0, np.uint32)
    column = np.zeros(SLOTS, np.int32)
    column[used] = np.arange(1, len(used) + 1)
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for k, (s, weight) in own.items():
        np.add.at(dense[:, k], column[s], weight)
    out = np.zeros((len(strings), len(landmarks)))
    for who, slot, weight in feature_blocks(strings):
        for a in range(0, len(who), 200):
            c = column[slot[a : a + 200]]
            x = np.zeros((len(c), len(used) + 1), np.float32)
            rows = np.repeat(np.arange(len(c)), c.shape[1])
            np.add.at(x, (rows, c.ravel()), np.tile(weight, len(c)))
            x[:, 0] = 0
            out[who[a : a + 200]] = x @ dense
    return out


def train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by accelerated gradient steps. y: +1 or -1."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.eigvalsh((x1 * weight[:, None]).T @ x1)[-1] + reg)
    w = z = np.zeros(x1.shape[1])
    t = 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ z))
        grad = -2 * ((weight * y * slack) @ x1) + reg * np.append(z[:-1], 0)
        nw = z - step * grad
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = nw + (t - 1) / nt * (nw - w), nw, nt
    return w[:-1], float(w[-1])


class ToxicityModel:
    """score(word) and the calibration of a document's highest word to a probability."""

    def __init__(self, table: np.ndarray, bias: float, slope: float, offset: float, landmarks: list[str]):
        self.table, self.bias, self.slope, self.offset, self.landmarks = table.astype(np.float32), bias, slope, offset, landmarks

    def decision(self, strings: list[str]) -> np.ndarray:
        return table_scores(strings, self.table) + self.bias

    def probability(self, highest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * highest + self.offset, -50, 50)))


def stems(string: str) -> list[str]:
    """A word with its marks, and its beginnings from ``STEM`` characters (the mark included)."""
    return [string, *(string[:k] for k in range(STEM, len(string)))]


def surprise(k: int, n: int, p: float) -> float:
    """Chernoff's bound on the chance of ``k`` or more of ``n`` at probability ``p``, as a negative logarithm."""
    q = k / n
    if q <= p:
        return 0.0
    return n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def one_per_copy(bags: list[set[str]]) -> list[int]:
    """A number for each bag that near copies share, by bands of least hashes: copies must count once."""
    seen: dict[tuple, int] = {}
    up = list(range(len(bags)))

    def top(k: int) -> int:
        while up[k] != k:
            k = up[k] = up[up[k]]
        return k

    for k, bag in enumerate(bags):
        h = np.fromiter((zlib.crc32(v.encode("utf-8", "surrogatepass")) for v in bag), np.uint32, len(bag))
        least = [int(((h * m) ^ (h >> np.uint32(15)) * _AFTER).min(initial=2**32 - 1)) for m in np.arange(1, 37, 2, dtype=np.uint32) * _MIX[0]]
        for b in range(0, 18, 3):
            first = seen.setdefault((b, *least[b : b + 3]), k)
            up[top(k)] = top(first)
    return [top(k) for k in range(len(bags))]


def reliable(bags: list[tuple[set[str], int]], chance: float | None = 0.5, lift: float = 15) -> set[str]:
    """Words and stems that toxic documents hold too often for chance (over all that are tried), and ``lift`` times as often as others, as they do the word's first letters."""
    seen = [Counter(), Counter()]
    for bag, y in bags:
        seen[y].update({s for v in bag for s in stems(v)})
    n1 = sum(y for _, y in bags)
    p, ratio = n1 / len(bags), lift * n1 / (len(bags) - n1)
    tried = [s for s, k in seen[1].items() if k > 1]
    need = math.log(max(1, len(tried)) / chance) if chance else 0.0
    often = lambda s: seen[1][s] >= ratio * seen[0][s]
    return {s for s in tried if often(s) and often(s[:ROOT]) and surprise(seen[1][s], seen[1][s] + seen[0][s], p) > need}


def spellings(string: str, rng: np.random.Generator, n: int = 6) -> list[str]:
    """Gapped, inserted, doubled and replaced spellings of a marked word."""
    w = string[1:-1]
    if len(w) < 4:
        return []
    out = []
    for kind in np.concatenate([rng.permutation(8) for _ in range(-(-n // 8))])[:n]:
        i = int(rng.integers(1, len(w)))
        sign = str(rng.choice(list("-*._x'~")))
        if kind == 0:
            v = w[:i] + sign + w[i:]
        elif kind == 1:
            v = sign.join(w)
        elif kind == 2:
            v = w[:i] + w[i - 1] * int(rng.integers(1, 4)) + w[i:]
        elif kind == 3:
            v = w[:i] + str(rng.choice(list("*#_-"))) + w[i + 1 :]
        elif kind == 4:
            spots = [k for k, c in enumerate(w) if c in _ALIKE]
            k = int(rng.choice(spots)) if spots else i
            v = w[:k] + _ALIKE.get(w[k], "*") + w[k + 1 :]
        elif kind == 5:
            v = w.join(rng.choice(list("xqzjxx"), 2))
        elif kind == 6:
            v = "".join(c + (str(rng.choice(list("abcdefgxyz"))) if rng.random() < 0.3 else "") for c in w)
        else:
            v = "".join(_ALIKE.get(c, c) for c in w)
        out += _cut(v)[:1]
    return out


def train(docs: list[tuple[str, int]], landmarks: int = 400, rounds: int = 2, seed: int = 1) -> ToxicityModel:
    """Fit on labelled documents, sentence by sentence; rounds add the clean words that score highest."""
    rng = np.random.default_rng(seed)
    bags = [({v for w in words(t) for v in windows(w)}, y) for t, y in docs]
    copies = one_per_copy([bag for bag, _ in bags])
    first = {(c, y): k for k, (c, (_, y)) in reversed(list(enumerate(zip(copies, bags, strict=True))))}
    docs, bags = [docs[k] for k in sorted(first.values())], [bags[k] for k in sorted(first.values())]
    n1 = sum(y for _, y in bags)
    if not n1 or n1 == len(bags):
        return ToxicityModel(np.zeros(SLOTS), -1.0, 1.0, 4.0 if n1 else -2.0, [])
    marks = reliable(bags) or reliable(bags, chance=None)  # of a few documents nothing is certain
    hits = lambda bag: [v for v in bag if any(s in marks for s in stems(v))]
    toxic, clean = Counter(), Counter()
    aside = {k for k in rng.permutation([k for k, (_, y) in enumerate(bags) if not y])[: (len(bags) - n1) // 3].tolist()}
    for k, ((text, y), (bag, _)) in enumerate(zip(docs, bags, strict=True)):
        if not y:
            if k not in aside:
                clean.update(bag)
            continue
        for sentence in sentences(text):
            own = {v for w in words(sentence) for v in windows(w)}
            toxic.update(hits(own))
    strings = sorted(clean)
    witness = sorted((v for v in toxic if clean[v] <= toxic[v] // 4), key=lambda v: (-toxic[v], v))
    if not witness or not strings:
        return ToxicityModel(np.zeros(SLOTS), -1.0, 1.0, -2.0, [])
    place: Counter = Counter()  # a word's place among those with its first letters: landmarks and spellings go to all roots alike
    turn = {v: (place.update([v[:ROOT]]) or place[v[:ROOT]]) for v in witness}
    whole: Counter = Counter()
    for v in witness:
        whole[v[:ROOT]] += toxic[v]
    weight_of = {v: toxic[v] / math.sqrt(whole[v[:ROOT]]) for v in witness}
    witness.sort(key=lambda v: (turn[v], -toxic[v], v))
    first = witness[: landmarks * 5 // 8]
    gapped = {v: spellings(v, rng, 40 if k < 60 else 6) for k, v in enumerate(witness[: 2 * landmarks])}
    positive = [(v, weight_of[v]) for v in witness[: 4 * landmarks]]
    positive += [(u, weight_of[v] * 2 / len(us)) for v, us in gapped.items() for u in us]
    sample = [strings[i] for i in rng.choice(len(strings), min(8000, len(strings)), replace=False)]
    others = sample + [u for v in sample[:4000] for u in spellings(v, rng, 1)]
    hard: list[str] = []
    z = first + others[: landmarks // 8]
    for k in range(rounds + 1):
        kzz = landmark_kernel(z, z)
        vals, vecs = np.linalg.eigh(kzz)
        keep = vals > 1e-6 * vals[-1]
        root = vecs[:, keep] / np.sqrt(vals[keep])
        pick = [v for v, _ in positive] + others + hard
        label = np.where(np.arange(len(pick)) < len(positive), 1.0, -1.0)
        weight = np.concatenate([np.array([w for _, w in positive]) / sum(w for _, w in positive), np.full(len(others), 0.5 / len(others)), np.full(len(hard), 0.5 / max(1, len(hard)))])
        w, bias = train_svm(landmark_kernel(pick, z) @ root, label, weight)
        alpha = root @ w
        table = np.zeros(SLOTS)
        for who, slot, values in feature_blocks(z):
            np.add.at(table, slot.ravel(), (alpha[who][:, None] * values).ravel())
        scores = table_scores(strings, table)
        if k < rounds:
            worst = [strings[i] for i in np.argsort(-scores)[:3000]]
            hard = sorted({*hard, *worst})
            z = first + list(dict.fromkeys(others[: landmarks // 8] + worst[: landmarks // 4]))
    model = ToxicityModel(table, bias, 1.0, 0.0, z)
    rest = sorted({v for k in aside for v in bags[k][0]})
    value = dict(zip(rest, model.decision(rest), strict=True))
    low = np.array([max(map(value.__getitem__, bags[k][0]), default=bias) for k in sorted(aside)])
    high = model.decision([v for v, _ in positive])
    slope, offset = _calibrate(np.append(low, high), np.append(np.zeros(len(low)), np.ones(len(high))))
    # a score of 0.5 is at least what the clean documents set aside reach, but for one in a thousand
    model.slope, model.offset = slope, min(offset, -slope * float(np.quantile(low, 0.999)))
    return model


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration with smoothed targets and both classes weighted alike."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -50, 50)))
        g = np.array([(weight * (p - t) * s).sum(), (weight * (p - t)).sum()])
        d = weight * p * (1 - p) + 1e-12
        h = np.array([[(d * s * s).sum() + 1e-6, (d * s).sum()], [(d * s).sum(), d.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
    return float(a), float(b)
