"""Packing by lexical retrieval: documents are tokenised, close ones are routed to one shard, and each shard packs with a BM25 index.

Document frequencies and lengths are counted over all documents. A tree of two-means splits, grown on a bounded sample of
weighted term vectors, gives every document a leaf, and neighbouring leaves are neighbours in words; shards are equal stretches of
tokens along the leaves. Only inside a leaf that is larger than a shard does the hash decide. A neighbour that the tree puts into
another shard is not seen.

A shard takes its longest unpacked piece as the seed of a sequence, asks the index for the unused pieces by BM25
over all distinct tokens of the seed, best score first, and fills the window greedily with those that fit; where none fits, the
best unused one is cut. Each document ends with END; every id lies in exactly one piece. Shards hold about
SHARD_TOKENS each, whatever the input, so a task's memory is bounded; a leaf of copies of any size is spread by hash.

Null text: empty, which leaves just END. Null ids and repeated rows are packed as they come. A text longer than the
window fills sequences of its own; the rest of it is packed with others. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, Words, drop_tables, mix, prepare, rows, table

WINDOW = 2048
END = 1
SHARD_TOKENS = 2_000_000
#: UTF-8 bytes for a token, at least, to size the shards; only their number depends on it.
TOKEN_BYTES = 2
#: Neighbours that are sorted at first.
NEAREST = 64
K1, B = 1.2, 0.75
#: The tree that routes: coordinates that terms are hashed to, documents that grow it, the fewest of these in a leaf, and its depth.
DIMENSIONS = 512
SAMPLE = 16_384
LEAF = 8
DEPTH = 12

PIECES = [
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
]
def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: White space beyond ASCII, in UTF-8; the tokenizer joins it with its neighbours.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Encoder:
    """Ids of whole texts, as the tokenizers file gives them; special tokens' strings are ordinary text.

    Where the same vocabulary lies beside it as ranks, tiktoken applies it, which gives the same ids several times faster. Its pattern never
    joins what stands before white space with what follows, so of a batch only the distinct pieces (white space and the word after it)
    are encoded, in one text; the bytes of the ids tell where each piece ends. Texts with wider white space are encoded whole."""

    def __init__(self, path: str):
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.size = None
        if path.endswith(".json") and os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.one = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary
            self.size = np.zeros(max(own.values()) + 1, np.int64)
            for token, i in own.items():
                self.size[i] = len(token)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            self.one = lambda text: t.encode(text, add_special_tokens=False).ids

    def _alone(self, text: str | None) -> np.ndarray:
        return np.array([*(self.one(text) if text else []), END], np.uint32)

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        if self.size is None:
            return [self._alone(t) for t in column.to_pylist()]
        w = Words(column, hashed=False)
        if not len(w.starts):
            return [self._alone(t) for t in column.to_pylist()]
        raw = w.data
        # pieces: from the end of the word before (or the text's start) to the word's end, and what is left at the text's end
        some = w.count > 0
        begin = np.r_[0, w.ends[:-1]]
        begin[w.first[:-1][some]] = w.off[:-1][some]
        rest = np.where(some, w.ends[np.maximum(w.first[1:] - 1, 0)], w.off[:-1])
        tail = np.flatnonzero(rest < w.off[1:])
        doc = np.concatenate([w.doc, tail])
        begin, end = np.concatenate([begin, rest[tail]]), np.concatenate([w.ends, w.off[1:][tail]])
        order = np.argsort(begin, kind="stable")
        doc, begin, end = doc[order], begin[order], end[order]
        w.starts, w.ends = begin, end
        _, first, code = np.unique(w._hash() ^ (end - begin).astype(np.uint64), return_index=True, return_inverse=True)
        begin, size = begin[first], (end - begin)[first]
        # pieces without white space before them (at a text's start) or without a word are encoded by themselves
        bare = ~SPACE[raw[begin]] | np.isin(order[first], np.arange(len(order) - len(tail), len(order)))
        together = np.flatnonzero(~bare)
        stop = np.cumsum(size[together])
        text = raw[np.repeat(begin[together] - (stop - size[together]), size[together]) + np.arange(stop[-1] if len(stop) else 0)]
        ids = np.array(self.one(text.tobytes().decode()), np.uint32)
        cut = np.searchsorted(np.cumsum(self.size[ids]), stop, "left") + 1
        own = [np.array(self.one(raw[begin[k] : begin[k] + size[k]].tobytes().decode()), np.uint32) for k in np.flatnonzero(bare)]
        length, start = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        length[together] = np.diff(cut, prepend=0)
        length[bare] = [len(x) for x in own]
        start[together] = cut - length[together]
        start[bare] = len(ids) + np.cumsum(length[bare]) - length[bare]
        ids = np.concatenate([ids, *own]) if own else ids
        n = length[code]
        per_doc = np.bincount(doc, weights=n, minlength=w.n).astype(np.int64)
        at = np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flat = ids[at]
        stop = np.cumsum(per_doc)
        out = [np.append(flat[b - k : b], np.uint32(END)) for b, k in zip(stop, per_doc, strict=True)]
        if _WIDE.search(raw):
            for d in range(w.n):
                if _WIDE.search(raw[w.off[d] : w.off[d + 1]]):
                    out[d] = self._alone(column[d].as_py())
        return out


_IDS = [("spread", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("ids", pa.binary())]


def _encode(path: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = Encoder(path)
        small = encode.size is not None and len(encode.size) <= 1 << 16
        for b in batches:
            blobs = [(x.astype(np.uint16).tobytes() + b"\0") if small else (x.tobytes() + b"\1") for x in encode(b.column("text"))]
            yield rows(_IDS, spread=b.column("spread"), doc_id=b.column("doc_id"), text_key=b.column("text_key"), ids=blobs)

    return run


def _ids(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob[:-1], np.uint32 if blob[-1] else np.uint16).astype(np.uint32)


class Corpus:
    """What BM25 weighs with, over all documents: how many there are, the mean length of their last pieces, and df by term."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms = n, max(1.0, mean), terms
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, pieces: list[np.ndarray]) -> Corpus:
        terms, df = np.unique(np.concatenate([np.unique(p) for p in pieces]), return_counts=True)
        return cls(len(pieces), float(np.mean([len(p) for p in pieces])), terms, df)

    def postings(self, pieces: list[np.ndarray]):
        """Term, piece and weight, by term and then by piece."""
        size = np.array([len(p) for p in pieces]) / self.mean
        doc = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        pair, tf = np.unique(np.concatenate(pieces).astype(np.int64) * len(pieces) + doc, return_counts=True)
        term, doc = pair // len(pieces), pair % len(pieces)
        return term, doc, self.idf[np.searchsorted(self.terms, term)] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc]))

    def vectors(self, pieces: list[np.ndarray]) -> np.ndarray:
        """By piece, its weights at hashed coordinates and with hashed signs, of length 1; 0 for an empty piece."""
        term, doc, weight = self.postings(pieces)
        h = mix(term.astype(np.uint64) + np.uint64(1))
        at = doc * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64)
        x = np.bincount(at, weights=np.where(h >> np.uint64(63), weight, -weight), minlength=len(pieces) * DIMENSIONS).reshape(-1, DIMENSIONS)
        return (x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)).astype(np.float32)


class Tree:
    """Two-means splits of vectors; leaves are numbered so that what was parted late is near."""

    def __init__(self, x: np.ndarray):
        self.normal, self.cut, self.child = [], [], []
        self.leaves = 0
        self._grow(x, 0)
        self.normal, self.cut, self.child = np.array(self.normal, np.float32).reshape(-1, DIMENSIONS), np.array(self.cut, np.float32), np.array(self.child, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, depth: int) -> int:
        """The number of the node, or -1 - that of a leaf."""
        right = np.zeros(len(x), bool)
        if len(x) >= 2 * LEAF and depth < DEPTH:
            far = x[np.argmin(x @ x.mean(0))]
            normal = far - x[np.argmin(x @ far)]
            cut = np.float32(np.median(x @ normal))
            for _ in range(8):
                right = (x * normal).sum(1) > cut
                if not 0 < right.sum() < len(x):
                    break
                a, b = (m / max(1e-12, float(np.linalg.norm(m))) for m in (x[~right].mean(0), x[right].mean(0)))
                normal = b - a
                # between the means, but a side keeps a tenth at least
                cut = np.float32(np.clip(0.0, *np.quantile(x @ normal, (0.1, 0.9))))
            right = (x * normal).sum(1) > cut
        if not 0 < right.sum() < len(x):
            self.leaves += 1
            return -self.leaves
        at = len(self.cut)
        self.normal.append(normal)
        self.cut.append(cut)
        self.child.append([0, 0])
        self.child[at] = [self._grow(x[~right], depth + 1), self._grow(x[right], depth + 1)]
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.full(len(x), 0 if len(self.cut) else -1)
        while (inner := np.flatnonzero(node >= 0)).size:
            n = node[inner]
            node[inner] = self.child[n, ((x[inner] * self.normal[n]).sum(1) > self.cut[n]).astype(np.int64)]
        return -1 - node


class Index:
    """Postings of pieces with BM25 weights. Terms that are in an eighth of the pieces or more lie as dense rows, the others as lists."""

    def __init__(self, pieces: list[np.ndarray], corpus: Corpus):
        term, doc, score = corpus.postings(pieces)
        score = score.astype(np.float32)
        self.n = len(pieces)
        terms, first, df = np.unique(term, return_index=True, return_counts=True)
        which = np.repeat(np.arange(len(terms)), df)
        dense = df * 8 >= max(self.n, 16)
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((int(dense.sum()), self.n), np.float32)
        often = dense[which]
        self.rows[self.row[which[often]], doc[often]] = score[often]
        self.first, self.df, self.doc, self.score = first, df, doc, score
        by = np.argsort(doc, kind="stable")
        self.terms, self.begin = which[by], np.searchsorted(doc[by], np.arange(self.n + 1))

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every piece over all distinct tokens of the seed."""
        own = self.terms[self.begin[seed] : self.begin[seed + 1]]
        total = self.rows[self.row[own[self.row[own] >= 0]]].sum(0)
        few = own[(self.row[own] < 0) & (self.df[own] > 1)]  # of a term that it alone has, the seed has no neighbours
        if len(few):
            n = self.df[few]
            at = np.repeat(self.first[few] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            total += np.bincount(self.doc[at], weights=self.score[at], minlength=self.n).astype(np.float32)
        return total


def pack(lengths: np.ndarray, terms: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length). terms: the ids of each document's last piece, which alone is packed with others.
    corpus: what BM25 weighs with, where these are not all documents."""
    out = [[(d, s, window)] for d, n in enumerate(lengths) for s in range(0, int(n) - window + 1, window)]
    rest = (lengths % window).astype(np.int64)
    n = len(rest)
    if not n:
        return out
    index = Index(terms, corpus or Corpus.of(terms))
    left = rest.copy()
    start = lengths - rest
    seeds, s = np.argsort(-rest, kind="stable"), 0
    biggest = n  # seeds[:s] are used up
    while True:
        while s < biggest and left[seeds[s]] == 0:
            s += 1
        if s == biggest:
            return out
        seed = seeds[s]
        sequence, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        left[seed] = 0
        if room:
            total = index.scores(seed)
            unused = np.flatnonzero(left)
            ranked = unused
            if len(unused) > NEAREST:  # the best scores; where they leave room, all that is unused follows
                ranked = unused[np.argpartition(-total[unused], NEAREST)[:NEAREST]]
            ranked = ranked[np.lexsort((ranked, -total[ranked]))]
            i = 0
            while room and i < len(ranked):
                fits = np.flatnonzero(left[ranked[i:]] <= room)
                # neighbours in order of score while they fit; where the next would leave a gap that nothing fits, it is cut
                j = i + int(fits[0]) if len(fits) else i
                d = ranked[j]
                take = int(min(room, left[d]))
                sequence.append((d, int(start[d]), take))
                start[d] += take
                left[d] -= take
                room -= take
                if j > i:
                    ranked = np.delete(ranked, j)
                else:
                    i += 1
                if room and i == len(ranked) < len(unused):
                    ranked = unused[left[unused] > 0]
                    ranked, unused, i = ranked[np.lexsort((ranked, -total[ranked]))], ranked, 0
        out.append(sequence)


def _pieces(column: pa.Array, window: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of documents, and their last pieces."""
    docs = [_ids(x) for x in column.to_pylist()]
    return np.array([len(x) for x in docs], np.int64), [x[len(x) - len(x) % window :] for x in docs]


def _corpus(ids: DataFrame, window: int) -> Corpus:
    """Counted on the executors; a row a term comes to the driver. Term -1 counts documents, and -2 tokens of last pieces."""

    def run(batches):
        count = np.zeros(2, np.int64)
        for b in batches:
            _, pieces = _pieces(b.column("ids"), window)
            if not pieces:
                continue
            top = max((int(p.max(initial=0)) for p in pieces)) + 3
            if top > len(count):
                count = np.append(count, np.zeros(top - len(count), np.int64))
            terms, df = np.unique(np.concatenate([np.unique(p) for p in pieces]).astype(np.int64), return_counts=True)
            count[terms + 2] += df
            count[1] += len(pieces)
            count[0] += sum(map(len, pieces))
        at = np.flatnonzero(count)
        yield rows([("term", pa.int64()), ("n", pa.int64())], term=at - 2, n=count[at])

    got = ids.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas().sort_values("term")
    by = dict(zip(got["term"], got["n"], strict=True))
    got = got[got["term"] >= 0]
    return Corpus(int(by.get(-1, 0)), by.get(-2, 0) / max(1, by.get(-1, 0)), got["term"].to_numpy(), got["n"].to_numpy())


def _tree(ids: DataFrame, shared, window: int) -> Tree:
    """Grown by one executor from about SAMPLE documents, by hash; only the tree comes to the driver."""

    def vectors(batches):
        for b in batches:
            x = shared.value.vectors(_pieces(b.column("ids"), window)[1]) if len(b) else []
            yield rows([("spread", pa.int64()), ("doc_id", pa.int64()), ("x", pa.binary())], spread=b.column("spread"), doc_id=b.column("doc_id"), x=[v.tobytes() for v in x])

    def grow(batches):
        got = sorted((s, v) for b in batches for s, v in zip(b.column("spread").to_pylist(), b.column("x").to_pylist(), strict=True))
        yield rows([("tree", pa.binary())], tree=[pickle.dumps(Tree(np.stack([np.frombuffer(v, np.float32) for _, v in got]) if got else np.zeros((0, DIMENSIONS), np.float32)))])

    share = min(1.0, SAMPLE / max(1, shared.value.n))
    some = ids.where(F.pmod(F.xxhash64(F.lit(9), "spread"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    some = some.mapInArrow(vectors, "spread long, doc_id long, x binary").repartition(1)
    return pickle.loads(some.mapInArrow(grow, "tree binary").first()["tree"])


def _routed(ids: DataFrame, shared, shards: int, window: int) -> DataFrame:
    """ids with their shard: equal stretches of tokens along the leaves, in a leaf by hash."""
    spark = ids.sparkSession
    tree = spark.sparkContext.broadcast(_tree(ids, shared, window))

    def place(batches):
        for b in batches:
            n, pieces = _pieces(b.column("ids"), window)
            leaf = tree.value(shared.value.vectors(pieces)) if len(b) else n
            yield rows([("leaf", pa.int32()), ("n", pa.int64()), *_IDS], leaf=leaf.astype(np.int32), n=n, **{n_: b.column(n_) for n_, _ in _IDS})

    placed = table(ids.mapInArrow(place, "leaf int, n long, spread long, doc_id long, text_key long, ids binary"), "packing-leaves")
    drop_tables(spark, ids)
    # as many rows as the tree has leaves, which its depth and sample bound
    size = placed.groupBy("leaf").agg(F.sum("n").alias("tokens"))
    size = size.select("leaf", "tokens", (F.sum("tokens").over(Window.orderBy("leaf")) - F.col("tokens")).alias("begin"), F.sum("tokens").over(Window.partitionBy(F.lit(1))).alias("all"))
    inside = F.col("spread").bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
    shard = F.least(F.floor((F.col("begin") + inside * F.col("tokens")) * shards / F.col("all")), F.lit(shards - 1)).cast("long")
    return placed.join(F.broadcast(size), "leaf").select(shard.alias("shard"), "doc_id", "text_key", "ids")


def _pack(window: int, corpus=None):
    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["doc_id", "text_key"], kind="stable", na_position="last")
        docs = [_ids(x) for x in pdf["ids"]]
        lengths = np.array([len(x) for x in docs], np.int64)
        shard = int(pdf["shard"].iloc[0])
        found = {n: [] for n, _ in PIECES}
        key = pdf["doc_id"].tolist()
        for q, sequence in enumerate(pack(lengths, [x[len(x) - len(x) % window :] for x in docs], window, corpus and corpus.value)):
            offset = 0
            for d, start, length in sequence:
                ids = docs[d][start : start + length].astype("<u4").tobytes()
                for n, v in zip(found, (key[d], start, length, zlib.crc32(ids), int(lengths[d]), shard << 32 | q, offset, ids), strict=True):
                    found[n].append(v)
                offset += length
        out = pd.DataFrame(found)
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return run


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned 32 bits)."""
    prepare(docs.sparkSession)
    # each document has END besides its text
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + TOKEN_BYTES).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // (shard_tokens * TOKEN_BYTES)))
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    d = docs.select(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), key).alias("spread"), F.col("doc_id").cast("long").alias("doc_id"), key.alias("text_key"), "text")
    ids = d.mapInArrow(_encode(tokenizer or default_tokenizer()), "spread long, doc_id long, text_key long, ids binary")
    corpus = None
    if shards == 1:
        ids = ids.withColumn("shard", F.lit(0).cast("long")).drop("spread")
    else:
        ids = table(ids, "packing-ids")
        corpus = docs.sparkSession.sparkContext.broadcast(_corpus(ids, window))
        ids = _routed(ids, corpus, shards, window)
    return ids.groupBy("shard").applyInPandas(_pack(window, corpus), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
