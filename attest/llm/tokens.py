"""Token ids in files: frequency-ranked, byte-aligned variable-length coding.

A file row holds one document: its id, its number of tokens, control bytes and data bytes. Every
token is written as its rank by corpus frequency, so that common tokens take one byte. A control
byte holds four two-bit lengths (1 to 4 bytes); the data bytes hold the ranks, low byte first.
Part files are in ascending document order, and so are the rows within each.
"""

import gc
import re
from array import array
from itertools import compress, repeat
from operator import is_, ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, new_path, partitions, ship, staged

#: Lengths of the four values of a control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
#: Documents and bytes of text that are encoded at once.
ROWS_AT_ONCE = 256
#: Entries of each of the two generations of a worker's cache of encoded words.
CACHE_ENTRIES = 700_000
#: New words that are encoded as one text.
WORDS_AT_ONCE = 512
#: White space of any kind, so that a blank beside it never separates two words.
_SPACE = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
_BLANKS = "".join(c for c in map(chr, range(1 << 16)) if re.match(f"[{_SPACE}]", c))
_SAFE = re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")
#: Letters of which all versions of Unicode say so; a word of them, with stops behind it, and what follows a line's end.
_LATIN = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"
_STOPS = r"[!-&(-/:-@\[-`{-~]*"
_LETTERS = re.compile(_LATIN)
_PIECES = re.compile(f"({_LATIN})({_STOPS})(?:\n({_LATIN})({_STOPS}))?")
#: Comes before a word that starts a text, in the cache's keys.
_FIRST = "\0"
_LOADED: dict[str, "_Encoder"] = {}


class _Encoder:
    """A tokenizer and the ids of words that it has met.

    A text is cut before each single blank between two visible characters. The pre-tokenizer
    always ends a piece there, so the pieces' ids, one after another, are the ids of the text.
    Words seldom met leave the cache when a generation is full.
    """

    def __init__(self, path: str, dtype: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype = Tokenizer.from_file(path), dtype
        with open(path, encoding="utf-8") as file:
            kind = json.load(file)
        before = kind.get("pre_tokenizer") or {}
        #: Whether the tokenizer is of the kind for which the cuts hold.
        self.cuts = kind.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        #: Whether an id's token begins with a blank, which only the first token of a word that follows a blank does.
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[i for token, i in self.tokenizer.get_vocab().items() if token.startswith("\u0120")]] = True
        #: The same model for pieces that are cut already, given in the symbols that stand for bytes.
        self.bare = None
        if self.cuts and kind.get("model", {}).get("type") == "BPE":
            self.bare = Tokenizer.from_str(json.dumps(kind | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": " "}, "added_tokens": [], "post_processor": None}))
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.symbols = {x: chr(256 + i) for i, x in enumerate(sorted(set(range(256)).difference(own)))}
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, tokenizer, pieces: list[str]) -> bytes:
        """The ids of pieces, end to end."""
        return b"".join(self.plain([" ".join(pieces[i : i + WORDS_AT_ONCE]) for i in range(0, len(pieces), WORDS_AT_ONCE)], tokenizer))

    def plain(self, texts: list[str], tokenizer=None) -> list[bytes]:
        kind = "H" if self.dtype == "<u2" else "I"
        return [array(kind, e.ids).tobytes() for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def parted(self, held: bytes) -> list[bytes]:
        """Ids of words that follow blanks, cut where a token begins with a blank."""
        at = (np.flatnonzero(self.begins[np.frombuffer(held, self.dtype)]) * np.dtype(self.dtype).itemsize).tolist()
        return [held[a:b] for a, b in zip(at, [*at[1:], len(held)], strict=True)] if at and at[0] == 0 else []

    def words(self, words: list[str]) -> list[bytes]:
        """The ids of each word with a blank before it; many words are one text."""
        out = []
        asked = [words[i : i + WORDS_AT_ONCE] for i in range(0, len(words), WORDS_AT_ONCE)]
        for part, held in zip(asked, self.plain([" " + " ".join(p) for p in asked]), strict=True):
            got = self.parted(held)
            # a tokenizer that joins words some other way has them one by one
            out += got if len(got) == len(part) else self.plain([" " + w for w in part])
        return out

    def letters(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone with a blank before each, which are one piece and need no pre-tokenizer."""
        asked = ["\u0120" + (w if w.isascii() else w.encode().decode("latin1").translate(self.symbols)) for w in words]
        out = []
        for held, n in ((self.ids(self.bare, asked[i : i + 8 * WORDS_AT_ONCE]), len(asked[i : i + 8 * WORDS_AT_ONCE])) for i in range(0, len(asked), 8 * WORDS_AT_ONCE)):
            got = self.parted(held)
            if len(got) != n:
                return self.words(words)
            out += got
        return out

    def learn(self, words: set[str]) -> None:
        """Puts the ids of new words (without the blank before them) into the cache.

        Letters, stops behind them, a line's end and what follows it are pieces of their own, so most
        words are made of few pieces that are known already or are met again.
        """
        old, new = self.old, self.new
        made, lacking = [], set()
        for w in words:
            if (known := old.get(w)) is not None:
                new[w] = known
            elif (found := _PIECES.fullmatch(w)) and found.end(1) < len(w):
                head, stops, after, last = found.groups()
                parts = [head, _FIRST + stops] if stops else [head]
                if after:
                    parts += [_FIRST + "\n", _FIRST + after] + ([_FIRST + last] if last else [])
                made.append((w, parts))
                for x in parts:
                    if x not in new:
                        if (known := old.get(x)) is None:
                            lacking.add(x)
                        else:
                            new[x] = known
            else:
                lacking.add(w)
        first = [w for w in lacking if w[0] == _FIRST]
        letters = [w for w in lacking if w[0] != _FIRST and _LETTERS.fullmatch(w)] if self.bare else []
        rest = [*lacking.difference(first).difference(letters)]
        new.update(zip(first, self.plain([w[1:] for w in first]), strict=True))
        new.update(zip(letters, self.letters(letters), strict=True))
        new.update(zip(rest, self.words(rest), strict=True))
        for w, parts in made:
            new[w] = b"".join([new[x] for x in parts])

    def encoded(self, texts: list[str]) -> list[bytes]:
        if not self.cuts:
            return self.plain(texts)
        out: list = [None] * len(texts)
        cut, missing = [], set()
        if len(self.new) > CACHE_ENTRIES:
            self.new, self.old = {}, self.new
        for i, text in enumerate(texts):
            if _FIRST in text:
                out[i] = self.plain([text])[0]
                continue
            parts = text.split(" ")
            parts[0] = _FIRST + parts[0]
            got = list(map(self.new.get, parts))
            if None in got:
                lacking = set(compress(parts, map(is_, got, repeat(None))))
                # words with white space at an edge are never in the cache, so they are met here
                bare = [w.removeprefix(_FIRST) for w in lacking]
                if "" in bare or any(map(ne, bare, [w.strip(_BLANKS) for w in bare])) or any(s in text for s in self.special):
                    parts = _SAFE.split(text)
                    parts[0] = _FIRST + parts[0]
                    lacking = {w for w in parts if w not in self.new}
                    if any(s in text for s in self.special) or any(w.removeprefix(_FIRST) == "" for w in parts):
                        out[i] = self.plain([text])[0]
                        continue
                missing |= lacking
                cut.append((i, parts))
            else:
                out[i] = b"".join(got)
        self.learn(missing)
        for i, parts in cut:
            out[i] = b"".join(map(self.new.__getitem__, parts))
        return out


def encoded(texts: list[str], path: str, dtype: str) -> list[bytes]:
    """The ids of each text, as bytes of dtype."""
    if path not in _LOADED:
        _LOADED[path] = _Encoder(path, dtype)
    # nothing here makes cycles, and the collector would look through all words again and again
    on = gc.isenabled()
    gc.disable()
    try:
        return _LOADED[path].encoded(texts)
    finally:
        if on:
            gc.enable()


def token_ids(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """doc_id and ids of every whole text, a binary of little-endian integers.

    Integers have 2 bytes where the vocabulary allows it, else 4. Null texts are empty; end_id is
    put after each document.
    """
    from tokenizers import Tokenizer

    dtype = id_type(Tokenizer.from_file(path).get_vocab_size(), end_id)
    end = b"" if end_id is None else np.array([end_id], dtype).tobytes()

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                ids = encoded([t or "" for t in part.column(1).to_pylist()], path, dtype)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x + end for x in ids], pa.binary())], ["doc_id", "ids"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids binary")


def id_type(vocabulary: int, end_id: int | None = None) -> str:
    return "<u2" if max(vocabulary, (end_id or 0) + 1) <= 1 << 16 else "<u4"


def ranked(ids: DataFrame, vocabulary: int, dtype: str) -> np.ndarray:
    """Token ids, most frequent first (ties by id), for all ids below `vocabulary`.

    Counts are over all rows. One row per token of the vocabulary reaches the driver.
    """

    def each(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                held = b"".join(batch.column(0).slice(first, 1024).to_pylist())
                total += np.bincount(np.frombuffer(held, dtype), minlength=vocabulary)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    rows = ids.select("ids").mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(vocabulary, np.int64)
    for r in rows:
        count[r["id"]] = r["n"]
    return np.lexsort((np.arange(vocabulary), -count)).astype(np.uint32)


def pack(ranks: list[np.ndarray]) -> tuple[list[bytes], list[bytes]]:
    """Control and data bytes of each list of ranks."""
    n = np.array([len(r) for r in ranks], np.int64)
    slots = (n + 3) // 4 * 4
    base, every = np.concatenate([[0], np.cumsum(slots)]), np.concatenate([*ranks, np.zeros(0, np.uint32)]).astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(n)])
    size = 1 + (every > 0xFF).astype(np.int64) + (every > 0xFFFF) + (every > 0xFFFFFF)
    code = np.zeros(base[-1], np.uint8)
    code[np.arange(len(every)) + np.repeat(base[:-1] - ends[:-1], n)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(at[-1], np.uint8)
    for j in range(4):
        has = np.flatnonzero(size > j) if j else slice(None)
        data[at[:-1][has] + j] = (every[has] >> np.uint32(8 * j)).astype(np.uint8)
    return [control[a // 4 : b // 4].tobytes() for a, b in zip(base[:-1], base[1:], strict=True)], [data[at[a] : at[b]].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unpack(n: np.ndarray, control: np.ndarray, data: np.ndarray) -> np.ndarray:
    """All ranks of several documents, from their joined control and data bytes."""
    slots = (n + 3) // 4 * 4
    base, ends = np.concatenate([[0], np.cumsum(slots)]), np.concatenate([[0], np.cumsum(n)])
    size = LENGTHS[control].reshape(-1)[np.arange(ends[-1]) + np.repeat(base[:-1] - ends[:-1], n)]
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    out = data[at].astype(np.uint32)
    for j in range(1, 4):
        has = np.flatnonzero(size > j)
        if not len(has):
            break
        out[has] |= data[at[has] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int | None = None) -> np.ndarray:
    """Encodes all documents and writes the files to `out`; returns the ids by rank.

    Files are in ascending doc_id order (nulls first; equal ids by their ids' bytes). Null and
    empty texts give only the end id. Columns but doc_id and text are ignored.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer).get_vocab_size(), (end_id or 0) + 1)
    dtype = id_type(vocabulary)
    ids = staged(token_ids(docs, tokenizer, end_id), "ids")
    by_rank = ranked(ids, vocabulary, dtype)
    rank = np.empty(vocabulary, np.uint32)
    rank[by_rank] = np.arange(vocabulary)

    def each(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                ranks = [rank[np.frombuffer(x.as_buffer(), dtype)] for x in part.column(1)]
                control, data = pack(ranks)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in ranks], pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())], ["doc_id", "n_tokens", "control", "data"])

    # in order before they are packed, as the bounds of the ranges are looked for in all rows
    ordered = ids.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.length("ids"), "ids")
    packed = ordered.mapInArrow(each, "doc_id long, n_tokens long, control binary, data binary")
    packed.withColumn("seq", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(out)
    dropped(ids)
    return by_rank


def read_tokens(spark, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, n_tokens long, control binary, data binary, seq long").parquet(path)


def decode_rows(batch: pa.RecordBatch, by_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents of a batch with n_tokens, control and data, and n + 1 offsets."""
    n = np.asarray(batch.column("n_tokens").to_numpy(zero_copy_only=False), np.int64)
    streams = []
    for name in ("control", "data"):
        streams.append(np.frombuffer(b"".join(batch.column(name).to_pylist()), np.uint8))
    return by_rank[unpack(n, *streams)], np.concatenate([[0], np.cumsum(n)])


def token_digests(files: DataFrame, by_rank: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files."""
    import zlib

    def each(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                ids, ends = decode_rows(part, by_rank.astype("<u4"))
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column("n_tokens"), part.column("seq"), pa.array(crc, pa.int64())], ["doc_id", "n_tokens", "seq", "ids_crc32"])

    ship(files.sparkSession)
    read = files.mapInArrow(each, "doc_id long, n_tokens long, seq long, ids_crc32 long").withColumn("shard", F.shiftright("seq", 33))
    before = files.groupBy(F.shiftright("seq", 33).alias("shard")).agg(F.sum("n_tokens").alias("n"))
    before = before.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return read.join(before, "shard").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def binary_token_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    by_rank = write_tokens(docs, tokenizer, path, end_id)
    return token_digests(read_tokens(spark, path), by_rank)
