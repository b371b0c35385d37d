"""What the operators of this subpackage share: staged tables and hashing of words."""

import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.ship import ship as shipped
from attest.staging import released  # noqa: F401

_OWN_DIR: dict[str, str] = {}
#: Rows of an Arrow batch, where the session has Spark's default: documents are long, and a batch is held twice.
BATCH_ROWS = "1024"
#: Slots of a sieve that documents pass.
SIEVE = 1 << 23


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, and bounds the batches that their Python workers get."""
    shipped(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, as in tests on one machine, a temporary folder serves.
    """
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _OWN_DIR[app] = "file://" + tempfile.mkdtemp(prefix="attest-")
    return _OWN_DIR[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing needs any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (nulls empty) and two integers, never null, that tell documents apart."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), F.xxhash64(F.isnull("doc_id"), "text").alias("kh"))


def sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each of SIEVE slots, set where a key of the one column falls; its size is fixed, and what it lets through holds all that it should, and some more."""

    def each(batches):
        bits = np.zeros(SIEVE, bool)
        for batch in batches:
            bits[_sieve_slot(batch.column(0).to_numpy())] = True
        at = bits.reshape(64, -1)
        some = [i for i in range(64) if at[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.packbits(at[i]).tobytes() for i in some], pa.binary())], ["part", "bits"])

    def added(table: pa.Table) -> pa.Table:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()])
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    out = np.zeros((64, SIEVE // 64), bool)
    for r in keys.mapInArrow(each, "part int, bits binary").groupBy("part").applyInArrow(added, "part int, bits binary").collect():
        out[r["part"]] = np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(bool)
    return np.packbits(out)


def _sieve_slot(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(np.uint64)) >> np.uint64(64 - SIEVE.bit_length() + 1)).astype(np.int64)


def sieved(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a sieve lets through."""
    slot = _sieve_slot(keys)
    return (bits[slot >> 3] << (slot & 7).astype(np.uint8) & 128) > 0


# ---- words and shingles, hashed with numpy -------------------------------------------

#: Bytes that end a word: blank and U+0009 to U+000D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POW = np.ones(1, np.uint64)
_INV = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _POW, _INV = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x], np.uint64))[0])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, end to end, and n + 1 offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def slices(at: np.ndarray, most: int, rows: int = 1 << 15) -> list[tuple[int, int]]:
    """Ranges of up to `rows` rows of up to `most` bytes together; a longer row stands alone."""
    out, first = [], 0
    while first < len(at) - 1:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        last = min(last, first + rows)
        out.append((first, last))
        first = last
    return out


def word_hashes(data: np.ndarray, at: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, n + 1 offsets into them by row, and each word's first and last + 1 byte."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), none, none
    word = ~SPACES[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = at[:-1][(at[:-1] < len(data))]
    first[inner] = word[inner]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return hashes, np.searchsorted(starts, at), starts, ends


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words and n + 1 offsets by row.

    With `short`, a row of 1 to k - 1 words has its whole sequence as its one shingle.
    """
    salt = [np.uint64(mix_int(j + 1) | 1) for j in range(k + 1)]
    many = max(0, len(words) - k + 1)
    every = np.zeros(many, np.uint64)
    for j in range(k):
        every += words[j : j + many] * salt[j]
    every = mix(every)
    counts = np.diff(at)
    n = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), n)
    ends = np.concatenate([[0], np.cumsum(n)])
    every = every[np.arange(ends[-1]) - ends[row] + at[row]] if len(row) else every[:0]
    few = np.flatnonzero((counts > 0) & (counts < k)) if short else []
    if len(few):
        extra = np.array([mix_int((sum(int(w) * int(s) for w, s in zip(words[at[i] : at[i + 1]], salt, strict=False)) + int(salt[k]) * int(counts[i])) & (2**64 - 1)) for i in few], np.uint64)
        every, n = np.insert(every, ends[few], extra), n.copy()
        n[few] = 1
        ends = np.concatenate([[0], np.cumsum(n)])
    return every, ends
