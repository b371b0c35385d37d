"""Chroma fingerprints of recordings, and their alignment.

A recording's spectrum is folded to twelve pitch classes per frame. Rectangular filters over the
frames' integral image give two bits each; sixteen filters make one 32-bit integer a frame.
Recordings are compared by their share of unequal bits at every difference of places, in blocks.
"""

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, ship, staged

RATE = 11025
FRAME = 4096
HOP = 1365
CLASSES = 12
LOWEST, HIGHEST = 28.0, 3520.0
#: Fixed values of this fingerprint: filter kind, first pitch class, number of classes, frames.
FILTERS = (
    (0, 0, 3, 15), (1, 0, 4, 14), (2, 2, 4, 12), (3, 4, 4, 8),
    (4, 6, 6, 15), (5, 0, 6, 9), (0, 6, 4, 5), (1, 4, 4, 16),
    (2, 7, 3, 6), (3, 1, 8, 12), (4, 3, 3, 8), (5, 9, 3, 15),
    (0, 9, 3, 10), (1, 8, 4, 10), (2, 0, 2, 16), (3, 6, 2, 14),
)
#: Where each filter's response is cut into four levels (quartiles, by kind).
CUTS = {0: (0.095, 0.15, 0.21), 1: (-0.04, 0.003, 0.055), 2: (-0.045, 0.0, 0.045), 3: (-0.045, 0.0, 0.045), 4: (-0.1, -0.054, -0.005), 5: (-0.078, -0.051, -0.025)}
#: Two-bit codes of the levels: neighbours differ in one bit.
GRAY = np.array([0, 1, 3, 2], np.uint32)
WIDEST = max(f[3] for f in FILTERS)


def decoded(wav: bytes) -> tuple[np.ndarray, int]:
    """Samples of a PCM WAV file in [-1, 1], all channels averaged, and the sampling rate."""
    with wave.open(io.BytesIO(wav)) as file:
        width, channels, rate = file.getsampwidth(), file.getnchannels(), file.getframerate()
        held = file.readframes(file.getnframes())
    if width == 1:
        x = np.frombuffer(held, np.uint8).astype(np.float64) / 128 - 1
    elif width == 2:
        x = np.frombuffer(held, "<i2").astype(np.float64) / 32768
    elif width == 4:
        x = np.frombuffer(held, "<i4").astype(np.float64) / 2**31
    else:
        raise ValueError(f"{8 * width}-bit samples are not supported")
    return x.reshape(-1, channels).mean(1), rate


def resampled(x: np.ndarray, rate: int) -> np.ndarray:
    if rate == RATE or not len(x):
        return x
    at = np.arange(int(len(x) * RATE / rate)) * (rate / RATE)
    return np.interp(at, np.arange(len(x)), x)


def chroma(x: np.ndarray) -> np.ndarray:
    """Energy of each pitch class in each frame, frames scaled to length one."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, CLASSES))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[:: HOP][:n] * np.hamming(FRAME)
    power = np.abs(np.fft.rfft(frames)) ** 2
    pitch = np.arange(1, FRAME // 2) * RATE / FRAME
    use = np.flatnonzero((pitch >= LOWEST) & (pitch <= HIGHEST)) + 1
    of = (np.rint(12 * np.log2(use * RATE / FRAME / 440.0)).astype(int)) % CLASSES
    out = power[:, use] @ (of[:, None] == np.arange(CLASSES))
    # a little smoothing over time, then the same loudness everywhere
    padded = np.pad(out, ((2, 2), (0, 0)), "edge")
    out = sum(w * padded[i : i + n] for i, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    size = np.sqrt((out**2).sum(1, keepdims=True))
    return np.where(size > 1e-9, out / np.maximum(size, 1e-9), 0.0)


def fingerprint(frames: np.ndarray) -> np.ndarray:
    """One packed integer for each place where the widest filter fits."""
    n = len(frames) - WIDEST + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(frames) + 1, CLASSES + 1))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, c0: int, t1: int, c1: int) -> np.ndarray:
        return image[at + t1, c1] - image[at + t0, c1] - image[at + t1, c0] + image[at + t0, c0]

    out = np.zeros(n, np.uint32)
    for kind, c, height, width in FILTERS:
        c1, h, w = c + height, height // 2, width // 2
        whole, cells = area(0, c, width, c1), width * height
        if kind == 0:  # mean
            r = whole / cells
        elif kind == 1:  # lower classes against upper
            r = (2 * area(0, c, width, c + h) - whole) / cells
        elif kind == 2:  # earlier frames against later
            r = (2 * area(0, c, w, c1) - whole) / cells
        elif kind == 3:  # diagonal quarters
            r = (2 * (area(0, c, w, c + h) + area(w, c + h, width, c1)) - whole) / cells
        elif kind == 4:  # middle classes against outer
            third = max(1, height // 3)
            r = (2 * area(0, c + third, width, c1 - third) - whole) / cells if height > 2 * third else whole / cells
        else:  # middle frames against outer
            third = max(1, width // 3)
            r = (2 * area(third, c, width - third, c1) - whole) / cells
        level = sum((r > cut).astype(np.int64) for cut in CUTS[kind])
        out = out << np.uint32(2) | GRAY[level]
    return out


def fingerprints(media: DataFrame, key: str, audio: str) -> DataFrame:
    """key and prints, an array of packed 32-bit integers, of each recording (a binary WAV file).

    Null, unreadable and very short recordings have no prints. Whole recordings are used.
    """

    def each(batches):
        for batch in batches:
            out = []
            for x in batch.column(1):
                try:
                    out.append(fingerprint(chroma(resampled(*decoded(x.as_py())))) if x.is_valid else np.zeros(0, np.uint32))
                except (wave.Error, EOFError, ValueError):
                    out.append(np.zeros(0, np.uint32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.astype(np.int64).tolist() for p in out], pa.list_(pa.int64()))], [key, "prints"])

    ship(media.sparkSession)
    return media.select(key, audio).mapInArrow(each, f"{key} long, prints array<long>")


def rendered(notes: list[float], cuts: tuple[float, ...] = (-0.084, 0.0, 0.084), seconds: float = 0.1) -> bytes:
    """A melody as a WAV file: each number is a note with overtones, the higher the more cuts it passes."""
    level = np.searchsorted(np.asarray(cuts), np.nan_to_num(np.asarray(notes, np.float64)))
    pitch = 220 * 2 ** (level * 3 / 12)
    n = int(seconds * RATE)
    phase = 2 * np.pi * np.cumsum(np.repeat(pitch, n)) / RATE
    sound = (np.sin(phase) + 0.4 * np.sin(2 * phase) + 0.2 * np.sin(3 * phase)) / 1.6
    held = io.BytesIO()
    with wave.open(held, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(2)
        file.setframerate(RATE)
        file.writeframes((sound * 30000).astype("<i2").tobytes())
    return held.getvalue()


def with_melodies(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and audio: each vector of numbers as a melody, one note a number."""

    def each(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, 64):
                part = batch.slice(first, 64)
                audio = [rendered([y or 0.0 for y in v]) if v else None for v in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(audio, pa.binary())], [key, "audio"])

    ship(vectors.sparkSession)
    return vectors.select(F.col(key).cast("long").alias(key), vector).mapInArrow(each, f"{key} long, audio binary")


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, int]:
    """Unequal bits, and places compared, when b starts `offset` places after a."""
    low, high = max(0, offset), min(len(a), len(b) + offset)
    if high <= low:
        return 0, 0
    x = a[low:high].astype(np.uint32) ^ b[low - offset : high - offset].astype(np.uint32)
    return int(np.bitwise_count(x).sum()), high - low


def classes(prints: DataFrame, key: str) -> DataFrame:
    """key, prints, class_id and digest: the smallest key with the same prints, and what names them.

    Equal prints are one class; recordings without prints have their own, and no digest. A key
    that comes with several prints may stand for several classes, which their digests tell apart.
    Null keys are allowed and stand for a class only where it has no other. Prints are compared
    by SHA-256; a table without rows gives none.
    """
    own = prints.select(F.col(key).alias("_key"), F.col("prints").alias("_prints"))
    own = own.withColumn("digest", F.when(F.size("_prints") > 0, F.sha2(F.to_json(F.struct("_prints")), 256)))
    least = own.where("digest is not null").groupBy("digest").agg(F.min("_key").alias("least")).withColumnRenamed("digest", "of")
    own = own.join(least, F.col("digest") == F.col("of"), "left")
    return own.select(F.col("_key").alias(key), F.col("_prints").alias("prints"), F.when(F.col("digest").isNull(), F.col("_key")).otherwise(F.col("least")).alias("class_id"), "digest")


#: Recordings, and queries, that one task compares at a time.
BLOCK = 1024
_FOUND = "query_id long, match_id long, offset int, votes long, bit_error_rate double"
_NAMED = ["class_id", "digest"]


def _blocks(prints: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of up to BLOCK recordings: keys, lengths and prints end to end."""

    def each(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                held = [np.asarray(v, np.uint32) for v in part.column(1).to_pylist()]
                row = (part.column(0).to_numpy().astype("<i8").tobytes(), np.array([len(v) for v in held], "<i8").tobytes(), np.concatenate(held).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], [f"{name}_keys", f"{name}_sizes", f"{name}_prints"])

    return prints.select(F.col(key).cast("long"), "prints").mapInArrow(each, f"{name}_keys binary, {name}_sizes binary, {name}_prints binary")


def signs(prints: np.ndarray) -> np.ndarray:
    """Rows of 32-bit integers as rows of +1 and -1, one a bit."""
    bits = np.unpackbits(np.ascontiguousarray(prints, "<u4").view(np.uint8).reshape(len(prints), -1), axis=1)
    return bits.astype(np.float32) * 2 - 1


def alignments(queries: np.ndarray, others: np.ndarray, least: int, most_errors: float) -> tuple[np.ndarray, ...]:
    """Rows of queries and of others that align, and offset, votes and share of unequal bits where they do so best.

    Each row is a recording; those of queries have one length, and those of others. Unequal bits at
    one offset are a product of matrices of signs, whose sums are exact.
    """
    (_, m), (_, n) = queries.shape, others.shape
    left, right = signs(queries), signs(others)
    found = []
    for o in range(least - n, m - least + 1):
        low, high = max(0, o), min(m, n + o)
        size = 32 * (high - low)
        agree = left[:, 32 * low : 32 * high] @ right[:, 32 * (low - o) : 32 * (high - o)].T
        i, j = np.nonzero(agree >= size * (1 - 2 * most_errors))
        same = np.concatenate([(queries[i[c : c + 65536], low:high] == others[j[c : c + 65536], low - o : high - o]).sum(1) for c in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        keep = (same >= least) | (2 * (high - low) >= min(m, n))
        i, j, same = i[keep], j[keep], same[keep]
        found.append((i, j, np.full(len(i), o), same, (size - agree[i, j].astype(np.float64)) / (2 * size)))
    i, j, offset, votes, errors = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 5
    order = np.lexsort((offset, errors, -votes, j, i))
    first = np.ones(len(order), bool)
    first[1:] = (i[order][1:] != i[order][:-1]) | (j[order][1:] != j[order][:-1])
    return tuple(x[order[first]] for x in (i, j, offset, votes, errors))


#: Signs of recordings that are compared at once.
SIGNS = 1 << 21


def _compared(prints: DataFrame, key: str, every: int, least_votes: int, most_errors: float, summed: bool) -> DataFrame:
    """Matches of queries with recordings; summed, a row for each query and block of recordings with its number of matches and the best of them (by number of class where errors tie)."""
    held = staged(prints.select(F.col(key).alias("_key"), F.col("prints").alias("_prints"), *_NAMED).where(F.size("_prints") > 0), "prints")
    # a class is its digest; it gets a number, as keys may come again
    asked = F.max(F.coalesce(F.pmod("_key", F.lit(every)) == 0, F.lit(False)))
    reps = held.groupBy(*_NAMED).agg(asked.alias("asked"), F.any_value("_prints").alias("prints")).withColumn("number", F.monotonically_increasing_id())
    reps = staged(reps, "reps")
    queries = reps.where("asked")

    def unpacked(batch, first: int, i: int):
        keys, sizes, every = (np.frombuffer(batch.column(first + c)[i].as_buffer(), kind) for c, kind in enumerate(("<i8", "<i8", "<u4")))
        return keys, sizes, np.concatenate([[0], np.cumsum(sizes)]), every

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, sizes, ends, whole = unpacked(batch, 0, i)
                others, lengths, starts, parts = unpacked(batch, 3, i)
                for m, n in ((m, n) for m in np.unique(sizes) for n in np.unique(lengths)):
                    own, mine = np.flatnonzero(sizes == m), np.flatnonzero(lengths == n)
                    few, many = max(1, SIGNS // (32 * int(m))), max(1, SIGNS // (32 * int(n)))
                    for x, y in ((own[c : c + few], mine[d : d + many]) for c in range(0, len(own), few) for d in range(0, len(mine), many)):
                        left, right = whole[ends[x][:, None] + np.arange(m)], parts[starts[y][:, None] + np.arange(n)]
                        q, r, offset, votes, errors = alignments(left, right, least_votes, most_errors)
                        q, r = keys[x[q]], others[y[r]]
                        good = q != r
                        hits = [q[good], r[good], offset[good].astype(np.int32), votes[good].astype(np.int64), errors[good]]
                        if summed and len(hits[0]):
                            hits = [h[order] for order in [np.lexsort((hits[1], hits[4], hits[0]))] for h in hits]
                            at = np.flatnonzero(np.concatenate([[True], hits[0][1:] != hits[0][:-1]]))
                            hits = [*(h[at] for h in hits), np.diff(np.append(at, len(hits[0])))]
                        if len(hits[0]):
                            names = ["query_id", "match_id", "offset", "votes", "bit_error_rate", "n_links"][: len(hits)]
                            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h)) for h in hits], names)

    pairs = staged(_blocks(queries, "number", "query"), "queries").crossJoin(staged(_blocks(reps, "number", "other"), "others"))
    found = pairs.repartition(partitions(held.sparkSession)).mapInArrow(each, _FOUND + ", n_links long" * summed)
    named = lambda n, c: reps.select(F.col("number").alias(n), F.col("class_id").alias(c), F.col("digest").alias(c.replace("_id", "_digest")))
    found = found.withColumnsRenamed({"query_id": "query_n", "match_id": "match_n"})
    return found.join(named("query_n", "query_id"), "query_n").join(named("match_n", "match_id"), "match_n").drop("query_n", "match_n")


def best_alignments(prints: DataFrame, key: str, every: int = 50, least_votes: int = 4, most_errors: float = 0.25) -> DataFrame:
    """query_id, query_digest, n_links (classes that align with it) and the best of them, for every query that has any.

    Queries and matches are those of `aligned`; best is the one with the least errors, then the
    smallest key. Each task sums up its blocks, so that matches, which grow with queries times
    recordings, do not travel.
    """
    found = _compared(prints, key, every, least_votes, most_errors, True)
    best = F.min_by(F.struct("match_id", "offset", "votes", "bit_error_rate"), F.struct("bit_error_rate", "match_id", "match_digest")).alias("best")
    return found.groupBy("query_id", "query_digest").agg(F.sum("n_links").alias("n_links"), best).select("query_id", "query_digest", "n_links", "best.*")


def aligned(prints: DataFrame, key: str, every: int = 50, least_votes: int = 4, most_errors: float = 0.25) -> DataFrame:
    """Recordings that align with queries, as pairs of classes.

    Recordings with equal prints are one class, whose least key stands for it. Queries are the
    classes that hold a recording whose key is divisible by `every`; they are held against all
    classes, at every difference of places that leaves `least_votes` places or more to compare. A
    pair stays if at most `most_errors` of its bits are unequal at a difference where at least
    `least_votes` integers are equal or half of the shorter recording is compared; of several
    differences that with the most equal integers (votes), then the least errors, then the smallest.

    Nothing is left out by an index, as bits with so many errors leave few integers, or bytes,
    equal: the work is queries times recordings times the product of their lengths.

    Returns query_id, match_id, offset, votes, bit_error_rate, query_digest and match_digest;
    classes that share a least key are told apart by the digests. prints comes from `classes`.
    """
    return _compared(prints, key, every, least_votes, most_errors, False)
