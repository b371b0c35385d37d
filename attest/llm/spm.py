"""SentencePiece encoding and decoding through the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores and byte fallback are
rebuilt as a tokenizers pipeline, which is checked against the sentencepiece library itself.
"""

import re
import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices, text_bytes

MARK = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: Bytes of text that are encoded at once.
BATCH = 1 << 20


def fields(held: bytes) -> list[tuple[int, object]]:
    """(number, value) of every field of a protobuf message; values by wire type."""
    out, at = [], 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = held[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(held):
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = held[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if n == 8 else "<f", held[at : at + n])[0], at + n
        else:
            raise ValueError(f"wire type {kind} at byte {at}")
        out.append((key >> 3, value))
    return out


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    treat_whitespace_as_suffix: bool = False

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def parsed(held: bytes) -> Model:
    model = Model()
    for number, value in fields(held):
        if number == 1:
            own = dict(fields(value))
            model.pieces.append((own.get(1, b"").decode("utf-8"), float(own.get(2, 0.0)), int(own.get(3, NORMAL))))
        elif number == 2:
            own = dict(fields(value))
            model.model_type, model.byte_fallback, model.treat_whitespace_as_suffix = int(own.get(3, UNIGRAM)), bool(own.get(35, 0)), bool(own.get(24, 0))
        elif number == 3:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces = (bool(own.get(n, 1)) for n in (3, 4, 5))
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, best result first; of one result, best parts first."""
    rank = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER, UNUSED)}
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER, UNUSED)}
    found = []
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank:
                found.append((-s, rank[piece], rank[left], rank[right], left, right))
    return [(f[4], f[5]) for f in sorted(found)]


def cuts_at_marks(model: Model) -> bool:
    """Whether no piece goes on past the end of a word, so that words can be encoded alone."""
    return not model.treat_whitespace_as_suffix and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def rebuilt(model: Model):
    """The model as a tokenizers.Tokenizer."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.treat_whitespace_as_suffix:
        raise ValueError("markers after words are not supported")
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    elif model.model_type == BPE:
        core = models.BPE({p: i for i, (p, _, _) in enumerate(model.pieces)}, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is not supported")
    tokenizer = Tokenizer(core)
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.escape_whitespaces and cuts_at_marks(model):
        # a word with the markers before it; markers at the end of a text stand alone
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.add_dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(back)
    return tokenizer


class Codec:
    """A rebuilt tokenizer, the sentencepiece library's own, and words met so far.

    Where words can be encoded alone, each word is encoded once and kept; words seldom met leave
    when a generation is full. A word's ids are held against the sentencepiece library's when it
    is met, so parity is known for every word of every text.
    """

    ENTRIES = 500_000

    def __init__(self, held: bytes, threads: int = 1):
        import os

        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true" if threads > 1 else "false"
        import sentencepiece

        self.model, self.threads = parsed(held), threads
        self.tokenizer = rebuilt(self.model)
        self.other = sentencepiece.SentencePieceProcessor(model_proto=held)
        m = self.model
        self.by_word = not m.charsmap and m.add_dummy_prefix and m.escape_whitespaces and not m.remove_extra_whitespaces and cuts_at_marks(m) and not any(p[2] == USER for p in m.pieces)
        self.kind = "H" if len(m.pieces) <= 1 << 16 else "I"
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.unlike: set[str] = set()

    def plain(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array(self.kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def reference(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array(self.kind, ids).tobytes() for ids in self.other.encode(texts, num_threads=self.threads)]

    def learn(self, words: set[str]) -> None:
        ask = []
        for w in words:
            known = self.old.get(w)
            if known is None:
                ask.append(w)
            else:
                self.new[w] = known
        # encoding a word puts the marker before it, as a blank in a text does
        for w, ids, same in zip(ask, self.plain(ask), self.reference(ask), strict=True):
            self.new[w] = ids
            if ids != same:
                self.unlike.add(w)

    def encoded(self, texts: list[str], whole: list[bool]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, and whether sentencepiece has the same; `whole` texts are compared whole."""
        if len(self.new) > self.ENTRIES:
            self.new, self.old = {}, self.new
        out: list = [None] * len(texts)
        alike = [True] * len(texts)
        parts: dict[int, list[str]] = {}
        missing: set[str] = set()
        for i, text in enumerate(texts):
            if self.by_word and text and text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
                parts[i] = text.split(" ")
                missing.update(w for w in parts[i] if w not in self.new)
        self.learn(missing)
        for i, words in parts.items():
            out[i] = b"".join(map(self.new.__getitem__, words))
            if self.unlike:
                alike[i] = self.unlike.isdisjoint(words)
        rest = [i for i in range(len(texts)) if out[i] is None]
        if rest:
            for i, ids in zip(rest, self.plain([texts[i] for i in rest]), strict=True):
                out[i] = ids
        check = [i for i in range(len(texts)) if whole[i] or i not in parts]
        if check:
            for i, ids in zip(check, self.reference([texts[i] for i in check]), strict=True):
                alike[i] = ids == out[i]
        return out, alike

    def decoded(self, ids: list[bytes]) -> list[str]:
        from array import array

        lists = []
        for x in ids:
            own = array(self.kind)
            own.frombytes(x)
            lists.append(own.tolist())
        return self.tokenizer.decode_batch(lists, skip_special_tokens=False)


_CODECS: dict[tuple[str, int], Codec] = {}


def codec(held: bytes, threads: int = 1) -> Codec:
    """The codec of a model, made once in a worker for each number of threads."""
    import hashlib

    key = hashlib.sha256(held).hexdigest(), threads
    if key not in _CODECS:
        _CODECS[key] = Codec(held, threads)
    return _CODECS[key]


def pieces(docs: DataFrame, model_path: str, every: int = 50, threads: int | None = None) -> DataFrame:
    """Piece ids of every whole text, decoded again and held against sentencepiece.

    Returns doc_id, ids (little-endian integers of two bytes, or of four for vocabularies above
    65,536), n_pieces, ids_crc32 (of the ids as unsigned 32-bit integers), round_trip (decoding
    gives the text back; false where the model's normaliser changes a text) and parity (the
    sentencepiece library gives the same ids: compared whole for texts whose doc_id is divisible
    by `every` or which cannot be cut into words, word by word for the rest). Null texts are
    empty; repeated rows stay; other columns are ignored; an empty table gives no rows. The model
    is read on the driver: its size does not depend on the data. A task encodes its batches with
    `threads` threads, by default as many as `spark.task.cpus` gives it.
    """
    import zlib

    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as file:
        held = file.read()
    threads = threads or int(spark.conf.get("spark.task.cpus", "1"))

    def each(batches):
        own = codec(held, threads)
        wide = np.dtype("<u2" if own.kind == "H" else "<u4")
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            for first, last in slices(at, BATCH, 1024):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, parity = own.encoded(texts, [d is not None and d % every == 0 for d in part.column(0).to_pylist()])
                trip = [x == y for x, y in zip(own.decoded(ids), texts, strict=True)]
                crc = [zlib.crc32(np.frombuffer(x, wide).astype("<u4").tobytes()) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // wide.itemsize for x in ids], pa.int64()), pa.array(crc, pa.int64()), pa.array(trip), pa.array(parity)], ["doc_id", "ids", "n_pieces", "ids_crc32", "round_trip", "parity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, ids binary, n_pieces long, ids_crc32 long, round_trip boolean, parity boolean")
