"""Personal data: exact base patterns, and a linear-chain CRF over word shapes that adds further spans.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers by pattern. The CRF is trained
from a small labelled table (templates filled by rule) and finds spellings that the patterns miss, such as
``ana (at) mail dot example dot com`` or a number without its ``+``. Its chains are the words within
``REACH`` characters of a trigger (a digit, ``@`` or a spelled ``dot``/``at`` sign); words further away are
outside by definition, and a chain is decoded whole, however long. A decoded span counts if it doesn't touch a
base span and holds what its kind needs (digits in number, check digit, range, separators).

Counts and ``base_sha256`` are of the base spans; ``spans`` has all. Offsets are in code points.

Defined cases: null texts count as empty; null ids and repeated rows are kept; an empty table gives no rows;
other columns are ignored by :func:`personal_data` and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silverframe.llm.common import batch_texts, by_bytes
from silverframe.llm.crf import LinearChain, pad

KINDS = ("email", "ip", "card", "phone")
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
REACH, SLICE, BATCH = 60, 4096, 1 << 16  # characters; words whose feature names are made, and padded words that are decoded, together

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]+|(?i:[(\[{]\s?at\s?[)\]}]|\bdot\b)")
_WORD = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_KNOWN = {"at", "dot", "com", "org", "net", "edu", "mail", "email", "e", "tel", "phone", "fax", "call", "mobile", "card", "visa", "ip", "host", "server", "version", "token", "id", "no"}


# Endings that a spelled-out address may have.
_ENDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk"}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; linear in the text's length."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # the local part is what stands before the sign, back to the end of the previous match or the sign before
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at)
        if m and start < at:
            out.append((0, start, m.end()))
        done = m.end() if m and start < at else at + 1
        at = text.find("@", done)
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group().split("."))]
    out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def form(word: str) -> str:
    """A word's shape, or the word itself if it is a sign or one of a few telling words."""
    if word[0].isdigit():
        n = len(word)
        return f"d{n}" if n < 6 else "d6-12" if n < 13 else "d13-19" if n < 20 else "d20"
    if not word[0].isalpha():
        return word
    low = word.lower()
    if low in _KNOWN:
        return low
    return ("X" if word.isupper() else "Xx" if word[0].isupper() else "x") + ("1" if len(word) == 1 else "s" if len(word) < 4 else "l")


def features(words: list[tuple[str, int]]) -> list[list[str]]:
    """Feature names of each (word, space before it)."""
    f = ["<<", "<", *(form(w) for w, _ in words), ">", ">>"]
    gap = [1, *(s for _, s in words[1:]), 1]
    out = []
    for i in range(len(words)):
        p2, p, c, n, n2 = f[i : i + 5]
        a, b = gap[i], gap[i + 1]
        out.append([f"w{c}", f"p{p}{a}", f"n{n}{b}", f"wp{p}{a}{c}", f"wn{c}{b}{n}", f"pp{p2}|{p}{a}{c}", f"nn{c}{b}{n}|{n2}", f"pn{p}{a}{c}{b}{n}"])
    return out


def chains(text: str) -> list[list[tuple[int, int]]]:
    """Words (start, end) near the triggers of a text."""
    areas: list[list[int]] = []
    for m in _MARK.finditer(text):
        a, b = max(0, m.start() - REACH), m.end() + REACH
        if areas and a <= areas[-1][1]:
            areas[-1][1] = b
        else:
            areas.append([a, b])
    out = []
    for a, b in areas:
        words = [m.span() for m in _WORD.finditer(text, a, min(b, len(text)))]
        if words:
            out.append(words)
    return out


def labelled_table(rows: int = 900, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The training table: (text, spans), from templates whose blanks are filled by rule."""
    rng = np.random.default_rng(seed)
    letters = "abdeginorstulm"

    def num(n):
        return "".join(rng.choice(list("0123456789"), n))

    def word(lo=2, hi=9):
        w = "".join(rng.choice(list(letters), rng.integers(lo, hi)))
        return w.capitalize() if rng.random() < 0.15 else w

    def email():
        name, host, end = word(), word(), rng.choice(["com", "org", "net", "de"])
        name = name if rng.random() < 0.6 else f"{name}.{num(2)}"
        sign = rng.choice(["@", " @ ", " (at) ", "[at]", " [at] ", " at ", "(at)"])
        dot = rng.choice([" dot ", " (dot) ", " dot ", " . "]) if sign != "@" else "."
        return f"{name}{sign}{host}{dot}{end}" if rng.random() < 0.6 else f"{name}{sign}{host}{dot}example{dot}{end}"

    def ip():
        return rng.choice([".", "[.]", " . ", " dot ", "(.)"]).join(str(rng.integers(0, 256)) for _ in range(4))

    def card():
        return rng.choice(["", " ", "-", ".", "/"]).join(num(4) for _ in range(4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"0{a} / {b} {c}", f"{a}.{b}.{c}"])

    def plain():
        return rng.choice([num(rng.integers(1, 7)), f"version {num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"CC BY-NC {num(1)}.0", f'token = "{rng.bytes(20).hex()}"', f"at {word()}", f"dot {word()}", f"{num(1)},{num(3)}", f"{num(11)}", f"{num(1)}.{num(1)}.{num(1)}", f"page {num(3)}", f"@{word()}", f"{num(3)}%", f"{num(2)} - {num(2)}"])

    make, table = [email, ip, card, phone], []
    for _ in range(rows):
        text, spans = "", []
        for _ in range(rng.integers(1, 4)):
            text += " ".join(word() + str(rng.choice(["", "", "", ",", "."])) for _ in range(rng.integers(0, 7))) + " "
            k = int(rng.integers(0, 7))
            piece = make[k]() if k < 4 else plain()
            if k < 4:
                spans.append((k, len(text), len(text) + len(piece)))
            text += piece + str(rng.choice([" ", " ", ", ", ". "]))
        table.append((text + word(), spans))
    return table


class Tagger:
    """The trained CRF and its feature numbers."""

    def __init__(self, rows: int = 900):
        table = labelled_table(rows)
        names: dict[str, int] = {}
        xs, ys = [], []
        for text, spans in table:
            words = [m.span() for m in _WORD.finditer(text)]
            y = np.zeros(len(words), np.int64)
            for k, a, b in spans:
                inside = [i for i, (s, e) in enumerate(words) if s >= a and e <= b]
                y[inside] = 2 + 2 * k
                y[inside[0]] = 1 + 2 * k
            xs.append(np.array([[names.setdefault(f, len(names)) for f in fs] for fs in self._features(text, words)]))
            ys.append(y)
        self.names = names
        self.crf = LinearChain(len(names), len(LABELS))
        self.crf.fit(pad(xs), pad(ys))

    @staticmethod
    def _features(text: str, words: list[tuple[int, int]]) -> list[list[str]]:
        return features([(text[a:b], int(i == 0 or words[i - 1][1] < a)) for i, (a, b) in enumerate(words)])

    def _numbers(self, text: str, words: list[tuple[int, int]]) -> np.ndarray:
        """Feature numbers, a slice of words at a time; a feature looks at two words on either side."""
        parts = []
        for at in range(0, len(words), SLICE):
            first = max(0, at - 2)
            names = self._features(text, words[first : at + SLICE + 2])[at - first :][:SLICE]
            parts.append(np.array([[self.names.get(f, -1) for f in fs] for fs in names]))
        return np.concatenate(parts)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Decoded spans of each text, chains of similar length decoded together."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        work = [(k, words) for k, t in enumerate(texts) for words in chains(t)]
        work.sort(key=lambda kw: len(kw[1]))
        at = 0
        while at < len(work):
            end = at + 1
            while end < min(len(work), at + 512) and (end + 1 - at) * len(work[end][1]) <= BATCH:
                end += 1
            part, at = work[at:end], end
            x = [self._numbers(texts[k], words) for k, words in part]
            for (k, words), path in zip(part, self.crf.decode(pad(x), np.array([len(w) for _, w in part])), strict=True):
                i = 0
                while i < len(path):
                    if path[i]:
                        kind, j = (path[i] - 1) // 2, i + 1
                        while j < len(path) and path[j] == 2 + 2 * kind:
                            j += 1
                        found[k].append((int(kind), words[i][0], words[j - 1][1]))
                        i = j
                    else:
                        i += 1
        return found


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    return Tagger()


def holds(kind: int, s: str) -> bool:
    """Whether a decoded string has what its kind needs."""
    digits, low = _digits(s), s.lower()
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[(\[{]\s?at\s?[)\]}]|\bat\b)\s?[\w-]+(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}]|\bdot\b)\s?[\w-]+)+", low)) and ("@" in low or re.split(r"[^a-z]+", low)[-1] in _ENDS)
    if kind == 1:
        parts = re.findall(r"[0-9]+", s)
        return len(parts) == 4 and _octets(parts) and bool(re.fullmatch(r"[0-9.\s()\[\]{}]+|(?:[0-9]+\s?dot\s?)+[0-9]+", low))
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"[0-9\s./-]+", s))
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?\s?[0-9][0-9()\s./-]+", s)) and len(re.findall(r"[0-9]+", s)) >= 3 and not re.fullmatch(r"\d{4}-\d\d-\d\d.*", s)


def all_spans(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    need = [k for k, t in enumerate(texts) if _MARK.search(t)]
    out: list[tuple[list, list]] = [([], []) for _ in texts]
    for k, added in zip(need, model.spans([texts[k] for k in need]), strict=True):
        base = base_spans(texts[k])
        taken = _union(base)
        extra = [(kind, a, b) for kind, a, b in added if holds(kind, texts[k][a:b]) and not _touches(taken, a, b)]
        out[k] = (base, sorted(base + extra))
    return out


def _union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the areas that spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _touches(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    starts, ends = taken
    k = bisect_left(starts, b)
    return k > 0 and a < ends[k - 1]


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, digest of the base spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger())

    def run(batches):
        for batch in batches:
            for piece in by_bytes(batch):
                rows = all_spans(batch_texts(piece), shared.value)
                counts = np.array([np.bincount([k for k, _, _ in base], minlength=4) for base, _ in rows]).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), *(pa.array(counts[:, k].astype(np.int64)) for k in range(4)), pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in rows]), pa.array([joined(spans) for _, spans in rows])],
                    ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by the kind of its first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars``, if there, is counted anew."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger())

    def run(batches):
        for batch in batches:
            for piece in by_bytes(batch):
                texts = batch_texts(piece)
                new = pa.array([redacted(t, spans) for t, (_, spans) in zip(texts, all_spans(texts, shared.value), strict=True)], pa.string())
                cols = {name: piece.column(name) for name in piece.schema.names}
                cols["text"] = pa.compute.if_else(pa.compute.is_null(cols["text"]), pa.scalar(None, pa.string()), new)
                if "n_chars" in cols:
                    cols["n_chars"] = pa.compute.if_else(pa.compute.is_null(cols["text"]), cols["n_chars"], pa.compute.utf8_length(cols["text"]).cast(cols["n_chars"].type))
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)
