"""Substring dedup by difference-cover anchors.

A window is WIDTH consecutive words of one document. Windows of two documents that are equal start at
positions i and j; some shift below PERIOD brings both onto cover positions, as the residues in COVER have
every difference modulo PERIOD. So only the short windows at cover positions are hashed and grouped, and any
repeated passage shares an anchor at both its places. Around shared anchors alone, the full windows are
then hashed (128 bits) and compared by the smallest document that has them.

Null text: no words. Null document id: the document is left whole and never counts as a source. Rows that
share an id are one document for the comparison, and each is cut by itself. Extra columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, join_by_count, mix, prepare, rows, signed, table, text_hashes, text_key, window_hash

WIDTH = 50
PERIOD = 31
#: A perfect difference set: each difference 1 to 30 modulo 31 occurs once.
COVER = (0, 1, 3, 8, 12, 18)
WHOLE = (-1, -2)  # places of the two hashes of a whole document

_ANCHOR = [("h", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int32())]
_WINDOW = [("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("place", pa.int32())]
_DIGEST = [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string())]
_CUT = [*_DIGEST[:2], ("n_removed", pa.int64()), ("cut_sha256", pa.string()), ("cut_text", pa.string())]


def _ddl(schema: list) -> str:
    kind = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    return ", ".join(f"{n} {kind[t]}" for n, t in schema)


def _anchors(width: int):
    short = width - PERIOD + 1
    residue = np.zeros(PERIOD, bool)
    residue[list(COVER)] = True

    def run(batches):
        for b in batches:
            w, ids = Words(b.column(1)), b.column(0)
            known = np.asarray(ids.is_valid())
            doc_id = ids.fill_null(0).to_numpy()
            at, doc = w.windows(short)
            place = at - w.first[doc]
            take = residue[place % PERIOD] & known[doc] & (w.count[doc] >= width)
            at, doc, place = at[take], doc[take], place[take]
            big = np.flatnonzero(known & (w.count >= width))
            salt = [mix(x + np.uint64(k)) for k, x in enumerate(text_hashes(w, big))]
            yield rows(
                _ANCHOR,
                h=np.concatenate([signed(window_hash(w.hash, at, short)), *map(signed, salt)]),
                doc_id=np.concatenate([doc_id[doc], doc_id[big], doc_id[big]]),
                place=np.concatenate([place, np.full(len(big), WHOLE[0]), np.full(len(big), WHOLE[1])]).astype(np.int32),
            )

    return run


def _candidates(width: int):
    """Hashes of the windows that hold a shared anchor."""
    reach = PERIOD - 1

    def run(batches):
        for b in batches:
            w = Words(b.column("text"))
            doc_id, key = b.column("doc_id").to_numpy(), b.column("text_key").to_numpy()
            places, starts = b.column("places").flatten().to_numpy(), np.r_[0, np.cumsum(b.column("places").value_lengths().to_numpy())]
            found = []
            for d in range(w.n):
                n = int(w.count[d]) - width + 1
                p = places[starts[d] : starts[d + 1]]
                if n > 0 and len(p):
                    step = np.zeros(n + 1, np.int32)
                    np.add.at(step, np.clip(p - reach, 0, n), 1)
                    np.add.at(step, np.clip(p + 1, 0, n), -1)
                    i = np.flatnonzero(np.cumsum(step[:n]) > 0)
                    found.append((np.full(len(i), d), i))
            doc = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
            place = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
            at = place + w.first[doc]
            yield rows(_WINDOW, h1=signed(window_hash(w.hash, at, width)), h2=signed(window_hash(w.second, at, width)), doc_id=doc_id[doc], text_key=key[doc], place=place.astype(np.int32))

    return run


def _cut(width: int):
    def run(batches):
        for b in batches:
            texts, copy = b.column("text").to_pylist(), b.column("copy").to_pylist()
            w = Words(b.column("text"), hashed=False)
            out = {n: [] for n, _ in _CUT}
            for d, places in enumerate(b.column("cuts").to_pylist()):
                first, n = w.first[d], int(w.count[d])
                gone = np.zeros(n + 1, np.int32)
                if copy[d]:
                    gone[0], gone[n] = 1, -1
                else:
                    p = np.array(places or [], np.int64)
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + width, -1)
                keep = np.cumsum(gone[:n]) == 0
                if keep.all():
                    continue
                s, e, raw = w.starts[first : first + n], w.ends[first : first + n], w.data
                k = np.flatnonzero(keep)
                words = [raw[x:y].tobytes() for x, y in zip(s[k], e[k], strict=True)]
                # a kept word brings the white space before it, but at the start
                before = np.r_[w.off[d], e[:-1]] if n else s
                text = b"".join(raw[x:y].tobytes() for x, y in zip(before[k], e[k], strict=True))
                if len(k) and k[0] > 0:
                    text = text[int(s[k[0]] - before[k[0]]) :]
                out["doc_id"].append(b.column("doc_id")[d].as_py())
                out["text_key"].append(b.column("text_key")[d].as_py())
                out["n_removed"].append(n - len(k))
                out["cut_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                out["cut_text"].append(text.decode())
            del texts
            yield rows(_CUT, **out)

    return run


def cuts(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents that lose words: doc_id, text_key, n_removed, cut_sha256, cut_text; one row for each that differs."""
    prepare(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    anchors = base.mapInArrow(_anchors(width), _ddl(_ANCHOR))
    shared = table(anchors.groupBy("h").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count("*").alias("n")).where("lowest < highest").drop("highest"), "shared")
    hits = (
        join_by_count(anchors, shared, ["h"], "n", "doc_id")
        .groupBy("doc_id")
        .agg(
            F.collect_set(F.when(F.col("place") >= 0, F.col("place"))).alias("places"),
            F.min(F.when((F.col("place") == WHOLE[0]) & (F.col("lowest") < F.col("doc_id")), F.col("lowest"))).alias("w1"),
            F.min(F.when((F.col("place") == WHOLE[1]) & (F.col("lowest") < F.col("doc_id")), F.col("lowest"))).alias("w2"),
            F.sum(F.when(F.col("place") == WHOLE[0], 1).otherwise(0)).alias("n_rows"),
        )
        # ids that several rows share are compared window by window
        .select("doc_id", "places", F.coalesce((F.col("w1") == F.col("w2")) & (F.col("n_rows") == 1), F.lit(False)).alias("copy"))
    )
    found = table(base.withColumn("text_key", text_key()).join(hits, "doc_id"), "repeats")
    windows = found.where("not copy").select("doc_id", "text_key", "text", "places").mapInArrow(_candidates(width), _ddl(_WINDOW))
    lowest = table(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lowest"), F.max("doc_id").alias("highest"), F.count("*").alias("n")).where("lowest < highest").drop("highest"), "lowest")
    places = join_by_count(windows, lowest, ["h1", "h2"], "n", "doc_id").where("lowest < doc_id").groupBy("doc_id", "text_key").agg(F.collect_set("place").alias("cuts"))
    cut = found.select("doc_id", "text_key", "text", "copy").join(places, ["doc_id", "text_key"], "left").where("copy or cuts is not null")
    return cut.mapInArrow(_cut(width), _ddl(_CUT)).dropDuplicates(["doc_id", "text_key"])


def _digest(batches):
    for b in batches:
        words = [(t or "").encode().split() for t in b.column("text").to_pylist()]
        yield rows(_DIGEST, doc_id=b.column("doc_id"), text_key=b.column("text_key"), n_words=[len(x) for x in words], kept_sha256=[hashlib.sha256(b" ".join(x)).hexdigest() for x in words])


def digests(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; texts themselves are shuffled only where anchors are shared."""
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), "text").mapInArrow(_digest, _ddl(_DIGEST))
    lost = cuts(docs, width).select("doc_id", "text_key", "n_removed", "cut_sha256")
    return every.join(lost, ["doc_id", "text_key"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("cut_sha256", "kept_sha256").alias("kept_sha256"))


def dedup_substrings(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the words that a smaller document's windows repeat; same columns and rows. Kept words keep the white space before them."""
    lost = cuts(docs, width).select("doc_id", "text_key", "cut_text")
    # the rows as one column, so that no name of theirs meets one of ours
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("text_key"), F.struct("*").alias("row"))
    own = lambda c: F.col("row").getField(c)
    return d.join(lost, ["doc_id", "text_key"], "left").select(*[(F.coalesce("cut_text", own(c)) if c == "text" else own(c)).alias(c) for c in docs.columns])
