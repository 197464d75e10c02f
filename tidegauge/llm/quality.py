"""Quality rules by labelling lines.

A linear-chain conditional random field reads the lines of a document in order, each by what it looks like (symbols, capitals,
repetition, punctuation, length, place), and Viterbi decoding marks each one as content or boilerplate. A document
is kept if enough of its words stand in content lines and the base rules don't fail it.

The field is trained by one executor on a bounded sample of labelled documents, all of whose lines take the document's quality as their label; neighbours and
weights even out the lines that differ from their document.

Base rules: fewer than 20 words fail, and so do texts of which more than 30 in 100 words lie in 8-word windows that occur twice or more.
Null and empty texts: no words, which fails. Without labels of both kinds every line counts as content. Rows are handled one by one.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, prepare, rows, window_hash

#: Labelled documents of each kind that train the field, at most, by hash; they are read whole.
MAX_DOCS = 800
REPEAT = 8
#: Share of words in content lines from which a document is kept.
CONTENT = 0.5

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_CLASSES = [
    _SYMBOLS,
    np.isin(np.arange(256), np.arange(65, 91)),
    np.isin(np.arange(256), np.arange(48, 58)),
    np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-()"]),
    np.isin(np.arange(256), [ord(c) for c in "!?=_{}[]\\/@^~+`"]),
    np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]),
]
#: Counts of three classes in one 64-bit word, 21 bits each.
_PACKED = [sum(c.astype(np.uint64) << np.uint64(21 * k) for k, c in enumerate(_CLASSES[i : i + 3])) for i in (0, 3)]
N_FEATURES = 14
_MASK = np.uint64((1 << 21) - 1)


class Lines:
    """The lines of a column of texts that hold a word: features, words and text of each."""

    def __init__(self, w: Words):
        n, data = w.n, w.data
        ends = np.flatnonzero(data == 10)
        begin = np.unique(np.concatenate([ends + 1, w.off[:-1]]))
        begin = begin[begin < len(data)]
        counts = np.zeros((6, len(begin)))
        if len(begin):
            for k in (0, 1):
                # parts of under 2**21 bytes, so that no packed count runs over
                cuts = np.unique(np.concatenate([begin, np.arange(0, len(data), 1 << 20)]))
                part = np.add.reduceat(_PACKED[k][data], cuts)
                own = np.searchsorted(begin, cuts, "right") - 1
                for j in range(3):
                    counts[3 * k + j] = np.bincount(own, weights=(part >> np.uint64(21 * j) & _MASK).astype(float), minlength=len(begin))
        size = np.diff(np.append(begin, len(data))).astype(float)
        of_word = np.searchsorted(begin, w.starts, "right") - 1
        words = np.bincount(of_word, minlength=len(begin)) if len(begin) else np.zeros(0, int)
        again = np.zeros(len(w.starts), bool)
        again[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
        again = np.bincount(of_word, weights=again, minlength=len(begin)) if len(begin) else np.zeros(0)
        some = words > 0
        last = w.data[w.ends[np.maximum(np.cumsum(words) - 1, 0)] - 1] if len(w.starts) else np.zeros(len(begin), np.uint8)
        doc = np.searchsorted(w.off, begin, "right") - 1
        begin, counts, size, words, again, last, doc = (a[..., some] for a in (begin, counts, size, words, again, last, doc))
        self.doc, self.words = doc, words
        self.first = np.searchsorted(doc, np.arange(n + 1))
        length = np.diff(self.first)[doc]
        place = np.arange(len(doc)) - self.first[doc]
        ink = np.maximum(size - counts[5], 1)
        self.x = np.stack(
            [np.ones(len(doc)), *(counts[:5] / ink), again / words, (words < 6) * 1.0, np.minimum(words, 60) / 60, np.minimum(ink / words, 20) / 10, np.isin(last, [46, 33, 63]) * 1.0, (place == 0) * 1.0, (place == length - 1) * 1.0, (counts[0] > words * 0.2) * 1.0],
            axis=1,
        )


def _grid(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values by line as (place, document, ...), and where there is a line."""
    n = np.diff(first)
    place = np.arange(len(values)) - np.repeat(first[:-1], n)
    out, mask = np.zeros((n.max(initial=0), len(n), *values.shape[1:])), np.zeros((n.max(initial=0), len(n)), bool)
    doc = np.repeat(np.arange(len(n)), n)
    out[place, doc], mask[place, doc] = values, True
    return out, mask


class Field:
    """Two labels, 0 boilerplate and 1 content: a weight for each feature and label, and for each step."""

    def __init__(self):
        self.w, self.step = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))

    def fit(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 80) -> None:
        """groups of x: (place, document, feature), mask, labels y, and weight by document; gradient of the log-likelihood by forward and backward sums, with Adam."""
        m, v, n = [0, 0], [0, 0], max(1.0, sum((mask * weight).sum() for _, mask, _, weight in groups))
        seen = np.zeros((2, 2))
        for _, mask, y, weight in groups:
            for i in (0, 1):
                for j in (0, 1):
                    seen[i, j] += (weight * mask[1:] * (y[:-1] == i) * (y[1:] == j)).sum()
        for r in range(1, rounds + 1):
            g_w, pair = np.zeros_like(self.w), np.zeros((2, 2))
            for group in groups:
                one, two = self._gradient(*group)
                g_w, pair = g_w + one, pair + two
            g_w = g_w / n - 1e-4 * self.w
            # a whole document shares its label in training: the steps are held back, so that lines still speak for themselves
            g_s = 0.1 * (seen - pair) / n - 2e-2 * self.step
            for k, (p, g) in enumerate(((self.w, g_w), (self.step, g_s))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
                p += 0.1 * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8)

    def _gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the weights, and the expected steps."""
        t_n = len(x)
        e = x @ self.w
        a = np.zeros_like(e)
        a[0] = e[0]
        for t in range(1, t_n):
            a[t] = np.where(mask[t][:, None], np.logaddexp(a[t - 1][:, :1] + self.step[0], a[t - 1][:, 1:] + self.step[1]) + e[t], a[t - 1])
        z = np.logaddexp(a[-1][:, 0], a[-1][:, 1])
        b = np.zeros_like(e)
        pair = np.zeros((2, 2))
        node = np.zeros_like(e)
        for t in range(t_n - 1, -1, -1):
            node[t] = np.exp(a[t] + b[t] - z[:, None]) * (mask[t] * weight)[:, None]
            if t:
                on = mask[t]
                s = self.step[None] + (e[t] + b[t])[:, None, :]
                p = np.exp(a[t - 1][:, :, None] + s - z[:, None, None])
                pair += np.einsum("nij,n->ij", p, on * weight)
                b[t - 1] = np.where(on[:, None], np.logaddexp(s[:, :, 0], s[:, :, 1]), b[t])
        is_one = np.stack([1 - y, y], -1) * (mask * weight)[..., None]
        return np.einsum("tnf,tnc->fc", x, is_one - node), pair

    def decode(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The likeliest labels, by (place, document)."""
        if not len(x):
            return np.zeros(mask.shape, int)
        e = x @ self.w
        best, back = e[0], []
        for t in range(1, len(x)):
            s = best[:, :, None] + self.step[None]
            back.append(s.argmax(1))
            best = np.where(mask[t][:, None], s.max(1) + e[t], best)
        out = np.zeros(mask.shape, int)
        now = best.argmax(1)
        for t in range(len(x) - 1, -1, -1):
            out[t] = now
            if t:
                now = np.where(mask[t], np.take_along_axis(back[t - 1], now[:, None], 1)[:, 0], now)
        return out


def _alike(k: np.ndarray) -> list[np.ndarray]:
    """Texts with like numbers of lines k together, so that long ones don't pad the others."""
    order = np.argsort(k, kind="stable")
    out, i = [], 0
    while i < len(k):
        j = i + int(np.searchsorted(k[order[i:]], max(8, 2 * k[order[i]]), "right"))
        out.append(order[i:j])
        i = j
    return out


def content_words(field: Field | None, lines: Lines, n: int) -> np.ndarray:
    """By text, the words in its content lines."""
    if field is None:
        return np.bincount(lines.doc, weights=lines.words, minlength=n)
    out = np.zeros(n)
    k = np.diff(lines.first)
    for docs in _alike(k):
        at = np.concatenate([np.arange(lines.first[d], lines.first[d + 1]) for d in docs])
        if len(at):
            first = np.r_[0, np.cumsum(k[docs])]
            x, mask = _grid(first, lines.x[at])
            content = field.decode(x, mask)
            words, _ = _grid(first, lines.words[at].astype(float))
            out[docs] = (words * content).sum(0)
    return out


def train(texts: list[str], quality: np.ndarray) -> Field | None:
    quality = np.asarray(quality)
    if len(set(quality.tolist())) < 2:
        return None
    lines = Lines(Words(pa.array(texts, pa.string())))
    k = np.diff(lines.first)
    # each document weighs the same, and so do the two kinds
    share = np.where(quality == 1, 0.5 / max(1, (quality == 1).sum()), 0.5 / max(1, (quality == 0).sum()))
    groups = []
    for docs in _alike(k):
        at = np.concatenate([np.arange(lines.first[d], lines.first[d + 1]) for d in docs])
        if len(at):
            x, mask = _grid(np.r_[0, np.cumsum(k[docs])], lines.x[at])
            groups.append((x, mask, np.broadcast_to(quality[docs].astype(float), mask.shape), share[docs] / np.maximum(k[docs], 1) * 1e3))
    field = Field()
    field.fit(groups)
    return field


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Field | None:
    """The field from at most max_docs labelled documents of each kind; labels beyond 0 and 1 and contradicting ones are left out."""
    l = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_m")).where("quality = _m")
    order = F.xxhash64(F.lit(6), "doc_id")
    picked = [l.where(F.col("quality") == c).orderBy(order, "doc_id").limit(max_docs).select("doc_id", F.col("quality").cast("int").alias("quality")) for c in (0, 1)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        got = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), reverse=True)
        got = sorted({i: (i, t, y) for i, t, y in got}.values())
        yield rows([("field", pa.binary())], field=[pickle.dumps(train([t for _, t, _ in got], np.array([y for _, _, y in got], np.int64)))])

    made = d.join(F.broadcast(picked[0].union(picked[1])), "doc_id").select("doc_id", "text", "quality").repartition(1).mapInArrow(run, "field binary").first()
    return pickle.loads(made["field"]) if made else None


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64())]
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def repeated_words(w: Words, width: int = REPEAT) -> np.ndarray:
    """By text, the words in windows of width words that occur twice or more in it."""
    at, doc = w.windows(width)
    h = window_hash(w.hash, at, width) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1] if len(s) else np.zeros(0, bool)
    twice = np.zeros(len(s), bool)
    twice[:-1] |= same
    twice[1:] |= same
    hit = np.sort(at[order[twice]])
    step = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[w.first[1:]] - covered[w.first[:-1]]


def base_columns(w: Words) -> dict[str, np.ndarray]:
    zero = lambda a: np.concatenate([[0], np.cumsum(a)])
    per = lambda c: c[w.off[1:]] - c[w.off[:-1]]
    points = per(zero(~_CLASSES[5][w.data] & ((w.data & 0xC0) != 0x80)))
    symbols = per(zero(_SYMBOLS[w.data]))
    dup = np.zeros(w.n, np.int64)
    for d in range(w.n):
        lines = w.data[w.off[d] : w.off[d + 1]].tobytes().split(b"\n")
        if len(lines) > 1:
            lines = [x for x in lines if x.strip(b" \t\n\r\x0b\x0c")]
            dup[d] = len(lines) - len(set(lines))
    return {"n_words": w.count, "word_chars": points, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeated_words(w)}


def judge(docs: DataFrame, labels: DataFrame, content: float = CONTENT, max_docs: int = MAX_DOCS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share of every row of docs."""
    prepare(docs.sparkSession)
    field = fit(docs, labels, max_docs)

    def run(batches):
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                w = Words(part.column("text"))
                base = base_columns(w)
                failed = (base["n_words"] < 20) | (100 * base["n_repeat_words"] > 30 * base["n_words"])
                share = content_words(field, Lines(w), w.n) / np.maximum(base["n_words"], 1)
                yield rows(_OUT, doc_id=part.column("doc_id"), **base, base_failed=failed, kept=~failed & (share >= content), content_share=share)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)
