"""What the operators share: word splitting and hashing over Arrow buffers, and tables in the shared folder."""

from __future__ import annotations

import functools
import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: With these, words are letters and digits, and all that isn't ASCII.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

#: Bytes hashed at once, so that memory doesn't follow the length of a text or batch.
CHUNK = 1 << 20


def prepare(spark: SparkSession) -> None:
    """Session settings that all operators want: adaptive plans and Arrow batches that fit a small worker."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def shared_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if not set_to:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        if got.isDefined():
            return got.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_to = "file://" + tempfile.mkdtemp(prefix="tidegauge-")
        spark.sparkContext.setCheckpointDir(set_to)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")
    return set_to.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidegauge/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is hot if it holds more than this share of the rows, so at most HOT keys are; its rows are dealt to SALTS tasks.
HOT, SALTS = 500, 64


def join_by_count(left: DataFrame, right: DataFrame, keys: list[str], count: str, spread: str) -> DataFrame:
    """left with the columns of right, a table of one row a key whose column count says how many rows of left have the key.

    Joined by shuffle at every size. Rows of hot keys, which are at most HOT and so are broadcast, are dealt by spread, a column of
    left, and right's rows of these keys go to all that share them."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT > total
    known = F.broadcast(right.where(hot).select(*keys, F.lit(True).alias("hot_key")))
    salted = left.join(known, keys, "left").withColumn("salt", F.when(F.col("hot_key"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot_key")
    dealt = right.withColumn("salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(dealt.hint("merge"), [*keys, "salt"]).drop("salt")


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables that table() wrote and that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes what an operator wrote to the shared folder and no longer needs."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: str = "text"):
    """Tells rows that share a document id apart; equal rows keep equal keys."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


#: Odd multipliers: one for each of the two independent hashes, and one for joining two halves.
_SEEDS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_JOIN = 0xA24BAED4963EE407
#: The low n bytes of a word's last eight.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)
#: Words beyond this many bytes are hashed one by one.
LONG = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class Words:
    """The words of a column of texts: starts and ends in data, first[i] the first word of text i, hash by word."""

    def __init__(self, column: pa.Array, hashed: bool = True, lower: bool = False, separators: np.ndarray = SPACE):
        if pa.types.is_large_string(column.type):
            column = column.cast(pa.string())
        n = len(column)
        _, off, data = column.buffers()
        off = np.frombuffer(off, np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if off is not None and n else np.zeros(n + 1, np.int64)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        off = off - off[0]
        if lower:
            raw = raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32))
        self.data, self.off, self.n = raw, off, n
        space = separators[raw]
        edge = off[(off > 0) & (off < len(raw))]
        begin = ~space
        end = begin.copy()
        if len(raw):
            begin[1:] &= space[:-1]
            begin[edge] = ~space[edge]
            end[:-1] &= space[1:]
            end[edge - 1] = ~space[edge - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, off)
        self.count = np.diff(self.first)
        self.hash = self._hash() if hashed else None

    def _hash(self, which: int = 1) -> np.ndarray:
        """By word, a hash of its bytes, eight at a time with a finaliser after each; two independent ones."""
        length = self.ends - self.starts
        seed = np.uint64(_SEEDS[which - 1])
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", padded, strides=(1,))
        with np.errstate(over="ignore"):
            out = mix((length.astype(np.uint64) + np.uint64(which)) * seed)
            live = np.flatnonzero(length <= LONG)
            k = 0
            while len(live):
                for i in range(0, len(live), CHUNK):
                    at = live[i : i + CHUNK]
                    some = eight[self.starts[at] + k] & _LOW[np.minimum(length[at] - k, 8)]
                    out[at] = mix((out[at] ^ some) * seed)
                k += 8
                live = live[length[live] > k]
        for i in np.flatnonzero(length > LONG):
            digest = hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
            out[i] = np.frombuffer(digest, np.uint64)[which - 1]
        return out

    @functools.cached_property
    def second(self) -> np.ndarray:
        """The other hash by word."""
        return self._hash(2)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.count)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of width words inside one text, and those windows' texts."""
        k = np.maximum(self.count - width + 1, 0)
        doc = np.repeat(np.arange(self.n), k)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k) + self.first[:-1][doc]
        return at, doc


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two halves by theirs. Not linear, so no sums of words can cancel."""
    x = (a ^ (a >> np.uint64(29))) * np.uint64(_JOIN) + b
    x ^= x >> np.uint64(32)
    x *= np.uint64(_SEEDS[1])
    return x


def window_hash(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of h[i : i + width] for the i in at (ascending): hashes of 1, 2, 4, ... elements, each of two halves, of which those
    that width is the sum of are joined."""
    out = np.empty(len(at), np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(at):
            lo = at[i]
            j = max(i + 1, int(np.searchsorted(at, lo + CHUNK - width, "right")))
            place, power, n, got = at[i:j] - lo, h[lo : at[j - 1] + width], 1, None
            while True:
                if width & n:
                    got = power[place] if got is None else _joined(got, power[place])
                    place = place + n
                if 2 * n > width:
                    break
                power = _joined(power[:-n], power[n:])
                n *= 2
            out[i:j] = got
            i = j
    return mix(out)


def text_hashes(w: Words, texts: np.ndarray) -> np.ndarray:
    """128 bits, as two rows, of the whole word sequence of each of these texts: a cryptographic hash of its words' hashes."""
    out = np.zeros((2, len(texts)), np.uint64)
    for j, d in enumerate(texts):
        out[:, j] = np.frombuffer(hashlib.blake2b(w.hash[w.first[d] : w.first[d + 1]].tobytes(), digest_size=16).digest(), np.uint64)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows(schema, **columns) -> pa.RecordBatch:
    """A record batch of these columns; schema: (name, Arrow type) pairs."""
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[n], pa.Array) else pa.array(c, t) for n, t in schema], names=[n for n, _ in schema])
