"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary labelled documents, back off from a bigram to a word's continuation count: the number of
different words that it stood behind in the class. A bigram's own count is of documents, so that one text's repetitions count once. An
expression whose counts of documents in the two classes differ by no more than chance would make them is too rare to tell the classes apart:
it is discounted whole and backs off to counts that both classes share, so it weighs the same in both. The others keep their class's own
counts, less the usual discount. A text's score comes from the two log-likelihoods, compared per word; a logistic curve over that
difference, its length-scaled form and its telling words turns it into a probability. The curve is fitted on documents that the counts it
uses have not seen.

Words are lower-cased runs of letters and digits. Null and empty texts have no words; their score is the curve's at a difference of
0, and 0.5 at most. Labels beyond 0 and 1, null labels, and documents with contradicting labels don't train. Rows that share an id
are scored by their own text. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, Words, mix, prepare, rows

#: Labelled documents of each class that train a model, at most; the choice is by hash. It bounds the model, which is
#: sent to all executors: a few hundred bytes a document and word.
MAX_DOCS = 4000
THRESHOLD = 0.7
#: The discount of what is kept, and how many standard deviations chance may account for.
DISCOUNT = 0.75
CHANCE = 4.0
_SCORE = [("score", pa.float64()), ("n_words", pa.int64()), ("log_ratio", pa.float64())]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys, or the place after the last for those that are missing."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, len(sorted_keys))


def _pairs(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the word before each word (0 at a text's start), and of both."""
    before = np.zeros_like(w.hash)
    before[1:] = w.hash[:-1]
    before[w.first[:-1][w.count > 0]] = 0
    with np.errstate(over="ignore"):
        return before, mix(before * np.uint64(0x9E3779B97F4A7C15) ^ w.hash)


class KneserNey:
    """Both classes' bigram models over a shared vocabulary; words[c] has the documents of class c."""

    def __init__(self, words: list[Words]):
        grams = [_pairs(w) for w in words]
        word = np.concatenate([w.hash for w in words])
        klass = np.repeat([0, 1], [len(w.hash) for w in words])
        doc = np.concatenate([words[0].doc, words[1].doc + words[0].n])
        before, pair = (np.concatenate([g[k] for g in grams]) for k in (0, 1))
        size = np.array([max(1, w.n) for w in words], float)

        def documents(code, kinds):
            """Documents of each class that have it."""
            once = np.unique(code.astype(np.int64) * (doc.max(initial=0) + 1) + doc)
            kind, of = once // (doc.max(initial=0) + 1), once % (doc.max(initial=0) + 1)
            return np.stack([np.bincount(kind[(of >= words[0].n) == bool(c)], minlength=kinds) for c in (0, 1)]).astype(float)

        def telling(n):
            """Where the classes differ by more than chance: the likelihood ratio against one shared rate."""
            expected = np.maximum(n.sum(0)[None, :] * (size / size.sum())[:, None], 1e-12)
            return 2 * (n * np.log(np.maximum(n, 1e-12) / expected)).sum(0) > CHANCE**2

        self.vocabulary, code = np.unique(word, return_inverse=True)
        v = len(self.vocabulary)
        own = telling(documents(code, v))
        pairs, first, pcode = np.unique(pair, return_index=True, return_inverse=True)
        m = documents(pcode, len(pairs))
        # continuation counts: different words that a word stood behind in each class
        n = np.stack([np.bincount(code[first], weights=m[c] > 0, minlength=v) for c in (0, 1)])
        total = np.maximum(n.sum(1), 1)
        shared = np.append(np.where(own, 0, n.sum(0)), 1.0)  # and one word for all unseen ones
        shared /= shared.sum()
        self.unigram = np.empty((2, v + 1))
        for c in (0, 1):
            kept = np.where(own, np.maximum(n[c] - DISCOUNT, 0), 0)
            left = 1 - kept.sum() / total[c]
            # a telling word that this class never had gets what the discount left of one context
            self.unigram[c] = np.append(np.where(own, (kept + (1 - DISCOUNT)) / total[c], 0), 0) + left * shared
        keep = np.flatnonzero(telling(m))
        self.pairs = pairs[keep]
        self.contexts, at = np.unique(before[first[keep]], return_inverse=True)
        inside = _find(self.contexts, before)
        # all other words weigh the same in both classes, seen or not, but for the mass that is left to them: their columns go
        stay = np.unique(np.concatenate([np.flatnonzero(own), code[first[keep]]]))
        self.unigram = np.append(self.unigram[:, stay], self.unigram[:, -1:], axis=1)
        self.vocabulary = self.vocabulary[stay]
        self.pair_part = np.zeros((2, len(keep) + 1))
        self.context_part = np.ones((2, len(self.contexts) + 1))
        for c in (0, 1):
            have = np.maximum(np.bincount(inside[klass == c], minlength=len(self.contexts) + 1)[:-1], 1)
            kept = np.minimum(np.maximum(m[c][keep] - DISCOUNT, 0), have[at])
            self.pair_part[c, :-1] = kept / have[at]
            self.context_part[c, :-1] = np.maximum(1 - np.bincount(at, weights=kept, minlength=len(self.contexts)) / have, 1e-3)

    def log_ratio(self, w: Words) -> np.ndarray:
        """By word, the log of its probability in class 1 over that in class 0."""
        before, pair = _pairs(w)
        u, p, c = _find(self.vocabulary, w.hash), _find(self.pairs, pair), _find(self.contexts, before)
        both = [self.pair_part[k][p] + self.context_part[k][c] * self.unigram[k][u] for k in (1, 0)]
        return np.log(both[0] / both[1])


def _features(model: KneserNey, w: Words) -> np.ndarray:
    """By text: the difference of log-likelihoods per word, the same scaled by the root of the length, the weight of the words that are
    at least e times likelier in class 1, which doesn't thin out in long texts, and 1."""
    ratio = model.log_ratio(w)
    total = np.concatenate([np.zeros((2, 1)), np.cumsum([ratio, np.where(ratio >= 1, ratio, 0)], axis=1)], axis=1)
    s, strong = total[:, w.first[1:]] - total[:, w.first[:-1]]
    n = np.maximum(w.count, 1)
    return np.stack([s / n, s / np.sqrt(n), np.log1p(np.maximum(strong, 0)), np.ones(w.n)], axis=1)


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method; lightly held to 0."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-2 * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(b))
        step = np.linalg.solve(h, g)
        b += step
        if abs(step).max() < 1e-8:
            break
    return b


def _words(texts: list) -> Words:
    return Words(pa.array(texts, pa.string()), lower=True, separators=PUNCTUATION)


def train(texts: list[str], toxic: np.ndarray) -> tuple[KneserNey, np.ndarray] | None:
    """The model over all of texts, and the curve fitted on halves that the counts of the other half score."""
    toxic = np.asarray(toxic)
    if len(set(toxic.tolist())) < 2:
        return None
    split = lambda keep: KneserNey([_words([t for t, y, k in zip(texts, toxic, keep, strict=True) if k and y == c]) for c in (0, 1)])
    half = np.arange(len(texts)) % 2
    x, y = [], []
    if min((toxic[half == h] == c).sum() for h in (0, 1) for c in (0, 1)) > 0:
        for h in (0, 1):
            x.append(_features(split(half != h), _words([t for t, k in zip(texts, half, strict=True) if k == h])))
            y.append(toxic[half == h])
    model = split(np.ones(len(texts), bool))
    if not x:
        x, y = [_features(model, _words(texts))], [toxic]
    x, y = np.concatenate(x), np.concatenate(y)
    share = y.mean()
    return model, _fit(x, y, np.where(y == 1, 0.5 / share, 0.5 / (1 - share)))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Whole texts and toxic of the bounded sample: documents whose crc32(doc_id) mod 3 is not 1, at most max_docs of each class by hash."""
    l = labels.where("toxic in (0, 1) and doc_id is not null").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    l = l.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_m")).where("toxic = _m").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    order = F.xxhash64(F.lit(5), "doc_id")
    picked = [l.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(max_docs) for c in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return d.join(picked, "doc_id")


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS):
    """The trained model, made by one executor from the bounded sample; only the model comes to the driver."""

    def run(batches):
        got = [(i, t, y) for b in batches for i, t, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        got = list({i: (t, y) for i, t, y in sorted(got, reverse=True)}.values())[::-1]
        yield rows([("model", pa.binary())], model=[pickle.dumps(train([t for t, _ in got], np.array([y for _, y in got], np.int64)))])

    sample = training_rows(docs, labels, max_docs).select("doc_id", "text", "toxic").repartition(1)
    made = sample.mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else None


def score(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs with score, n_words and log_ratio (per word); rows, columns and order as in docs. Of a column in docs with one of these names, the new one stays."""
    prepare(docs.sparkSession)
    fitted = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_docs))
    keep = [f for f in docs.schema.fields if f.name not in {n for n, _ in _SCORE}]
    from pyspark.sql import types as T

    schema = T.StructType([*keep, T.StructField("score", T.DoubleType()), T.StructField("n_words", T.LongType()), T.StructField("log_ratio", T.DoubleType())])
    names = [f.name for f in keep]

    def run(batches):
        got = fitted.value
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                w = Words(part.column("text"), lower=True, separators=PUNCTUATION)
                if got is None:
                    s, x = np.zeros(w.n), np.zeros((w.n, 1))
                else:
                    x = _features(got[0], w)
                    s = 1 / (1 + np.exp(-np.clip(x @ got[1], -30, 30)))
                    s = np.where(w.count == 0, np.minimum(s, 0.5), s)
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(s, pa.float64()), pa.array(w.count, pa.int64()), pa.array(x[:, 0], pa.float64())], names=[*names, *[n for n, _ in _SCORE]])

    return docs.mapInArrow(run, schema)


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_docs: int = MAX_DOCS) -> DataFrame:
    """docs without those whose score reaches the threshold."""
    scored = score(docs.select(F.struct("*").alias("_doc"), F.col("doc_id"), F.col("text")), labels, max_docs)
    return scored.where(F.col("score") < threshold).select("_doc.*")
