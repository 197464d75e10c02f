"""Near-duplicate detection by Order MinHash with a banded alignment of every candidate.

A document's k-mers are its windows of SHINGLE words, labelled with their occurrence, so that repeats count. Each of BANDS
hash functions picks the MINIMA smallest labelled k-mers; in their order in the text they make one key, so keys agree where
edit similarity is high, not merely where the same k-mers stand in another order. Documents that share a key are
candidates; the similarity of a pair is s / (n + m - s), where s is the longest common subsequence of their n and m k-mers,
found within the band that a similarity of THRESHOLD allows. At 0.8 a pair misses all 16 keys about once in 10**5 times.

Equal word sequences are collapsed first (128-bit hashes) and only one document of each takes part. In a bucket, all are held
against its pivot, the most central member (in the largest buckets), which settles nearly all of a group of copies with a few
alignments each. Then those outside the bucket's largest class are held against all of the bucket, so that no link between classes is lost:
not pair by pair, but in blocks, where one matrix product bounds every pair's similarity by its common k-mers and only pairs
that can reach the threshold are aligned.

Links go from a document to the smallest pivot it matched, and from there to its other ones; late links join classes, not documents. So
there are about as many links as documents, however large a group is.

Null and empty texts: a class of their own each, as are rows without an id. A text of fewer words than SHINGLE has one k-mer.
Rows that share an id are told apart by their text, and equal rows are one document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, Words, drop_tables, join_by_count, mix, prepare, rows, signed, table, text_hashes, text_key, window_hash
from .graph import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 16
MINIMA = 3
#: Of the labelled k-mers of a text, about this many are looked at for each hash function's minima.
POOL = 32
#: Documents of one block, of those that are left and of the bucket they are held against.
LEFT_BLOCK, ALL_BLOCK = 32, 64

_SKETCH = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("n_kmers", pa.int64()), ("keys", pa.list_(pa.int64()))]
_DDL = "doc_id long, text_key long, n_words long, f1 long, f2 long, n_kmers long, keys array<long>"


def kmers(w: Words, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers, text after text, and each text's first one (with the end at last)."""
    at, doc = w.windows(width)
    h = window_hash(w.hash, at, width)
    few = np.flatnonzero((w.count > 0) & (w.count < width))
    if len(few):
        whole = text_hashes(w, few)[0]
        place = np.searchsorted(doc, few)
        h, doc = np.insert(h, place, whole), np.insert(doc, place, few)
    return h, np.searchsorted(doc, np.arange(w.n + 1))


def labelled(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The k-mers' hashes with their occurrence in the text mixed in."""
    doc = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    own = h ^ mix(doc + np.uint64(1))
    order = np.argsort(own, kind="stable")
    s = own[order]
    again = np.r_[False, s[1:] == s[:-1]] if len(s) else np.zeros(0, bool)
    if not again.any():
        return h
    i = np.arange(len(s))
    run = i - np.maximum.accumulate(np.where(again, 0, i))
    nth = np.empty(len(s), np.uint64)
    nth[order] = run.astype(np.uint64)
    return np.where(nth > 0, mix(h + mix(nth)), h)


def sketch(h: np.ndarray, first: np.ndarray, bands: int, minima: int) -> np.ndarray:
    """A row of keys for each text that has k-mers; 0 for those without."""
    n = len(first) - 1
    size = np.diff(first)
    x = labelled(h, first)
    doc = np.repeat(np.arange(n), size)
    share = np.minimum(1.0, POOL / np.maximum(size, 1))
    most = np.uint64(0xFFFFFFFFFFFFFFFF)
    limit = np.where(share >= 1, most, (share * 2.0**63).astype(np.uint64) * np.uint64(2))
    limits, out = limit[doc], np.zeros((n, bands), np.uint64)
    need = np.minimum(size, minima)
    with np.errstate(over="ignore"):
        for k in range(bands):
            a, b = mix(np.array([2 * k + 1, 2 * k + 2], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            v = (x ^ a) * (b | np.uint64(1))
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            at = np.flatnonzero(v <= limits)
            short = np.flatnonzero(np.bincount(doc[at], minlength=n) < need)
            if len(short):
                at = np.union1d(at, np.flatnonzero(np.isin(doc, short)))
            o = np.lexsort((at, v[at], doc[at]))
            at = at[o]
            d = doc[at]
            rank = np.arange(len(d)) - np.searchsorted(d, d)
            at = np.sort(at[rank < minima])  # in the order of the text
            d = doc[at]
            nth = np.arange(len(d)) - np.searchsorted(d, d)
            key = np.full(n, mix(np.array([k + 77], np.uint64))[0])
            for j in range(minima):
                m = nth == j
                key[d[m]] = mix(key[d[m]] * np.uint64(0xA24BAED4963EE407) + x[at[m]])
            out[:, k] = key
    return out


def _sketches(bands: int, minima: int, width: int):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                w = Words(part.column("text"))
                h, first = kmers(w, width)
                keys = sketch(h, first, bands, minima)
                full = np.zeros((2, w.n), np.uint64)
                some = np.flatnonzero(w.count)
                full[:, some] = text_hashes(w, some)
                flat = pa.array(signed(keys.ravel()), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(w.n + 1) * bands, pa.int32()), flat)
                yield rows(_SKETCH, doc_id=part.column("doc_id"), text_key=part.column("text_key"), n_words=w.count, f1=signed(full[0]), f2=signed(full[1]), n_kmers=np.diff(first), keys=lists)

    return run


def _sequences(width: int):
    def run(batches):
        for b in batches:
            for i in range(0, len(b), 200):
                part = b.slice(i, 200)
                h, first = kmers(Words(part.column("text")), width)
                short = (h >> np.uint64(32)).astype(np.uint32)
                yield rows([("node", pa.int64()), ("kmers", pa.binary())], node=part.column("node"), kmers=[short[first[d] : first[d + 1]].tobytes() for d in range(len(part))])

    return run


def common_subsequence(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Length of the longest common subsequence of a and b if it is at least least, else some smaller number."""
    n, m = len(a), len(b)
    if min(n, m) < least:
        return 0
    k = min(n, m)
    eq = a[:k] == b[:k]
    head = k if eq.all() else int(np.argmin(eq))
    k -= head
    eq = a[n - k :][::-1] == b[m - k :][::-1]
    tail = k if eq.all() else int(np.argmin(eq))
    a, b, got = a[head : n - tail], b[head : m - tail], head + tail
    n, m, least = len(a), len(b), least - got
    if not n or not m or least <= 0 and n + m == 0:
        return got
    if min(n, m) < least:
        return got
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < least:
        return got
    apart = n + m - 2 * max(least, 0)  # insertions and deletions that are allowed
    d = 16
    while True:
        d = min(d, apart)
        if n * (2 * d + 1) > 6_000_000:
            return got + _by_rows(a, b, apart)
        found = _furthest(a, b, d)
        if found >= 0:
            return got + (n + m - found) // 2
        if d >= apart:
            return got
        d *= 4


def _furthest(a: np.ndarray, b: np.ndarray, d: int) -> int:
    """Fewest insertions and deletions from a to b, at most d, else -1: furthest places on diagonals, all at once."""
    n, m = len(a), len(b)
    if abs(n - m) > d:
        return -1
    # same[k, x]: how far a[x:] and b[x + k - d:] agree
    width = 2 * d + 1
    y = np.arange(n)[None, :] + (np.arange(width) - d)[:, None]
    equal = (y >= 0) & (y < m)
    equal &= b[np.clip(y, 0, m - 1)] == a[None, :]
    stop = np.where(equal, n, np.arange(n)[None, :])
    stop = np.minimum.accumulate(stop[:, ::-1], axis=1)[:, ::-1]
    stop = np.concatenate([stop, np.full((width, 1), n)], axis=1)
    row, far = np.arange(width), np.full(width, -1)
    # diagonals beyond b's end keep x + k <= m
    top = np.minimum(n, m - (row - d))
    far[d] = 0
    for cost in range(d + 1):
        live = far >= 0
        far[live] = np.minimum(stop[row[live], np.minimum(far[live], n)], top[live])
        if far[d + m - n] >= n:
            return cost
        down = np.full(width, -1)
        down[:-1] = np.where(far[1:] >= 0, far[1:] + 1, -1)  # leave out a symbol of a
        right = np.full(width, -1)
        right[1:] = far[:-1]  # leave out a symbol of b
        far = np.maximum(np.maximum(down, right), far)
        far = np.where((far > top) | (far + row - d < 0), np.where(top >= 0, np.minimum(far, top), -1), far)
        far[far + row - d < 0] = -1
    return -1


def _by_rows(a: np.ndarray, b: np.ndarray, apart: int) -> int:
    """Longest common subsequence within the band, row after row; memory as the band."""
    n, m = len(a), len(b)
    last = np.zeros(m + 1, np.int32)
    for i in range(n):
        lo, hi = max(0, i - apart), min(m, i + apart + 1)
        if lo >= hi:
            break
        new = np.maximum(last[lo + 1 : hi + 1], last[lo:hi] + (b[lo:hi] == a[i]))
        np.maximum.accumulate(new, out=new)
        last[lo + 1 : hi + 1] = np.maximum(new, last[lo])
        last[hi + 1 : hi + 2] = last[hi]  # the next row's new cell starts from here
    return int(last[m])


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """s / (n + m - s) if that is at least threshold, else a smaller number."""
    if not len(a) or not len(b):
        return 0.0
    least = int(np.ceil((len(a) + len(b)) * threshold / (1 + threshold) - 1e-9))
    s = common_subsequence(a, b, least)
    return s / (len(a) + len(b) - s)


def _verify(threshold: float):
    def run(batches):
        for b in batches:
            left, right = b.column("ka"), b.column("kb")
            same = [similarity(np.frombuffer(left[i].as_py(), np.uint32), np.frombuffer(right[i].as_py(), np.uint32), threshold) >= threshold for i in range(len(b))]
            yield rows([("node", pa.int64()), ("pivot", pa.int64())], node=b.column("node"), pivot=b.column("pivot")).filter(pa.array(same, pa.bool_()))

    return run


def _may_link(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have enough common k-mers (occurrences counted) to reach the threshold; exact, by one product of incidence matrices."""
    docs = left + right
    size = np.array([len(x) for x in docs])
    doc = np.repeat(np.arange(len(docs)), size)
    flat = np.concatenate(docs).astype(np.uint64) if size.sum() else np.zeros(0, np.uint64)
    # the n-th occurrence of a k-mer in a text is an element of its own
    key = flat << np.uint64(24) | doc.astype(np.uint64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    again = np.r_[False, s[1:] == s[:-1]] if len(s) else np.zeros(0, bool)
    i = np.arange(len(s))
    nth = i - np.maximum.accumulate(np.where(again, 0, i)) if len(s) else i
    _, element = np.unique((s >> np.uint64(24)) << np.uint64(24) | np.minimum(nth, (1 << 24) - 1).astype(np.uint64), return_inverse=True)
    # elements of one text alone can't be common
    common = np.zeros((len(left), len(right)), np.float32)
    of = doc[order]
    many = np.bincount(element) > 1
    code = np.cumsum(many) - 1
    keep = many[element]
    element, of = code[element[keep]], of[keep]
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        m = (element >= lo) & (element < lo + 4096)
        x = np.zeros((len(docs), 4096), np.float32)
        x[of[m], element[m] - lo] = 1
        common += x[: len(left)] @ x[len(left) :].T
    return common >= threshold * (size[: len(left), None] + size[None, len(left) :] - common) - 1e-3


def _verify_blocks(threshold: float):
    """Links between classes (parts). A part that a block has already joined to another isn't held against it again."""

    def run(batches):
        for b in batches:
            found = []
            for few, all_ in zip(b.column("few").to_pylist(), b.column("every").to_pylist(), strict=True):
                left, right = ([np.frombuffer(r["kmers"], np.uint32) for r in x] for x in (few, all_))
                root: dict[int, int] = {}

                def top(part):
                    while (up := root.get(part, part)) != part:
                        part = up
                    return part

                for i, j in zip(*np.nonzero(_may_link(left, right, threshold)), strict=True):
                    p, q = top(few[i]["part"]), top(all_[j]["part"])
                    if p != q and similarity(left[i], right[j], threshold) >= threshold:
                        root[max(p, q)] = min(p, q)
                        found.append((few[i]["part"], all_[j]["part"]))
            yield rows([("a", pa.int64()), ("b", pa.int64())], a=[x for x, _ in found], b=[y for _, y in found])

    return run


def _by_key(df: DataFrame) -> DataFrame:
    """Joined by shuffle at every size: what is on this side grows with the documents."""
    return df.hint("merge")


def _reduced(links: DataFrame) -> DataFrame:
    """Links (node, pivot) as fewer that connect the same: each node to its smallest pivot, and that one to the node's others."""
    of = links.groupBy("node").agg(F.min("pivot").alias("first"), F.collect_set("pivot").alias("pivots"))
    return of.select(F.col("first").alias("a"), F.explode(F.concat(F.array("node"), "pivots")).alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, minima: int = MINIMA, width: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, n_words, and of its class: class_id (the smallest doc_id), class_text (that
    document's text_key, the smallest) and class_size (rows)."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text")
    every = table(base.mapInArrow(_sketches(bands, minima, width), _DDL), "sketches")
    # a node is a word sequence, whatever rows have it
    first = F.min(F.struct("doc_id", "text_key", "n_kmers", "keys")).alias("r")
    nodes = every.where("n_words > 0 and doc_id is not null").groupBy("f1", "f2").agg(first, F.count("*").alias("n_rows"))
    nodes = table(nodes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "n_rows", "r.*"), "nodes")
    members = nodes.select("node", "n_kmers", F.explode("keys").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = table(members.join(_by_key(crowded), "bucket"), "members")
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    close = lambda x, y: F.least(x, y) >= threshold * F.greatest(x, y)
    # the most central member of each bucket, by an aggregate that combines before the shuffle
    tops = members.join(_by_key(degree), "node").groupBy("bucket").agg(F.min(F.struct(-F.col("degree"), "node", "n_kmers")).alias("p"))
    p = F.col("p.node")
    pairs = members.join(_by_key(tops), "bucket").where((p != F.col("node")) & close(F.col("p.n_kmers"), F.col("n_kmers")))
    pairs = pairs.groupBy(F.least(p, "node").alias("a"), F.greatest(p, "node").alias("b")).agg(F.min(p).alias("pivot")).select((F.col("a") + F.col("b") - F.col("pivot")).alias("node"), "pivot")
    needed = nodes.join(_by_key(members.select("node").distinct()), "node", "left_semi").select("node", "doc_id", "text_key")
    sequences = table(base.join(_by_key(needed), ["doc_id", "text_key"]).dropDuplicates(["node"]).select("node", "text").mapInArrow(_sequences(width), "node long, kmers binary"), "sequences")
    own, others = sequences.withColumnRenamed("kmers", "ka"), sequences.select(F.col("node").alias("pivot"), F.col("kmers").alias("kb"))
    links = pairs.join(_by_key(own), "node").join(_by_key(others), "pivot").select("node", "pivot", "ka", "kb").mapInArrow(_verify(threshold), "node long, pivot long")
    parts = components(_reduced(links))
    where = members.select("bucket", "node", "size").join(_by_key(parts.withColumnRenamed("id", "node")), "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("part"))
    counts = where.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "part")).alias("m"), F.count("*").alias("k"), F.sum("n").alias("all")).where("k > 1")
    where = table(where.join(_by_key(counts.select("bucket", F.col("m.part").alias("large"), F.col("m.n").alias("n"), "all")), "bucket"), "mixed")
    there = where.join(_by_key(sequences), "node")
    block = lambda size: F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(size)).cast("long"))
    packed = lambda df, n, name: df.groupBy("bucket", n.alias("block")).agg(F.collect_list(F.struct("part", "kmers")).alias(name)).drop("block")
    few = packed(there.where("part <> large"), block((F.col("all") - F.col("n")) / LEFT_BLOCK), "few")
    blocks = few.join(_by_key(packed(there, block(F.col("all") / ALL_BLOCK), "every")), "bucket").select("few", "every")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        late = table(blocks.mapInArrow(_verify_blocks(threshold), "a long, b long").distinct(), "late")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    drop_tables(spark, members, sequences, where)
    known = nodes.select("node", "f1", "f2", "n_rows", "doc_id", "text_key").join(_by_key(parts.withColumnRenamed("id", "node")), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    if not late.isEmpty():
        joined = components(late)
        known = known.join(_by_key(joined.withColumnRenamed("id", "part")), "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    known = table(known, "classes")
    sums = table(known.groupBy("part").agg(F.min(F.struct("doc_id", "text_key")).alias("m"), F.sum("n_rows").alias("class_size"), F.count("*").alias("n_nodes")), "class-sums")
    of = join_by_count(known.select("f1", "f2", "n_rows", "part"), sums, ["part"], "n_nodes", "f1").select("f1", "f2", "n_rows", F.col("m.doc_id").alias("class_id"), F.col("m.text_key").alias("class_text"), "class_size")
    some = every.where("n_words > 0 and doc_id is not null").select("doc_id", "text_key", "n_words", "f1", "f2")
    alone = every.where("n_words = 0 or doc_id is null").select("doc_id", "text_key", "n_words", F.col("doc_id").alias("class_id"), F.col("text_key").alias("class_text"), F.lit(1).cast("long").alias("class_size"))
    return join_by_count(some, table(of, "sequence-classes"), ["f1", "f2"], "n_rows", "doc_id").select(*alone.columns).union(alone)


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """One row for each row of docs: doc_id, text_key, class_id (the smallest doc_id of its class), n_words, class_size (rows)."""
    return classes(docs, **how).select("doc_id", "text_key", "class_id", "n_words", "class_size")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs without all but the smallest document of each class (by id, then by text key); of equal rows one stays. Rows without an id, and
    those without words, stay."""
    best = classes(docs, **how).where("n_words > 0 and doc_id = class_id and text_key = class_text").select("doc_id", "text_key").distinct()
    # the rows as one column, so that no name of theirs meets one of ours
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.struct("*").alias("row"))
    wordless = ~F.coalesce(F.regexp_like(F.col("row.text"), F.lit(WORD)), F.lit(False)) | F.col("doc_id").isNull()
    kept = d.where(~wordless).join(_by_key(best), ["doc_id", "text_key"], "left_semi").dropDuplicates(["doc_id", "text_key"])
    return kept.union(d.where(wordless)).select("row.*")
