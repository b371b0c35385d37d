"""Removal of byte strings that occur more than once, by sorting suffixes.

A suffix matters only if its first LENGTH bytes occur elsewhere. Sorting the suffix of every byte
would move each byte LENGTH times, so suffixes that cannot have a twin are left out first, exactly:

1. Every window of LENGTH bytes has an anchor, its GRAM bytes of least hash, leftmost of equals.
   Equal windows have equal anchors at equal places. Neighbouring windows mostly share theirs, so
   there is about one anchor for 85 bytes. Its windows, in three parts by their distance to it,
   have cores in common that are two thirds of a window long.
2. Cores go, packed by range of hash, to tasks that compare them. A window whose core occurs
   nowhere else has no twin. Anchors with equal bytes around them, as far as their windows
   reach, have windows that are all twins. What remains are the anchors at the edges of repeats.
3. The windows of these anchors are the suffixes to sort. Their leading tokens are the first eight
   bytes, then a hash of the window. Splitters sampled from the documents cut the order of
   suffixes into ranges; each range is sorted by multikey quicksort and neighbours are compared.
   Ranges are cut between whole keys, and every packet sends each key once, so twins never lie on
   two sides of a cut and a very common window is no burden to its range.

Hashes have 64 bits; equal hashes count as equal strings.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import _powers, dropped, keyed, mix, partitions, released, ship, slices, staged, text_bytes
from .ngram_join import pack_sorted, unpack_sorted

LENGTH = 200
GRAM = 32
#: Anchors or windows that a task holds before it packs them.
PACKET = 500_000
PACKET_DOCS = 30_000
#: Bytes of documents that are hashed at once. Longer documents are cut into overlapping pieces.
PIECE = 1 << 18
#: Contexts of one anchor in one packet, above which the packet sends the anchor's windows itself.
CONTEXTS = 16

_ROW = "kind int, bucket long, packet long, a binary, b binary, c binary, d binary"
_KINDS = {"kind": pa.int32(), "bucket": pa.int64(), "packet": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
_DOCS, _CLASS, _COMMON, _FLAG = range(4)
_ANCHOR = np.dtype([("doc", "<u2"), ("low", "<u4"), ("span", "u1"), ("cls", "<u4"), ("flag", "u1")])
_ASK = np.dtype([("low", "<u4"), ("span", "u1")])
_TWIN, _EDGE = 1, 2


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)], list(_KINDS))


def _sums(data: np.ndarray) -> np.ndarray:
    power, _ = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return total


def _hash(total: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    _, inverse = _powers(len(total))
    return mix((total[last] - total[first]) * inverse[first])


def pieces(at: np.ndarray, length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Groups of (row, first byte, last byte) of up to PIECE bytes; long rows in overlapping cuts."""
    out = []
    for first, last in slices(at, PIECE):
        if at[last] - at[first] <= PIECE:
            out.append((np.arange(first, last), np.stack([at[first:last], at[first + 1 : last + 1]], 1)))
        else:
            for cut in range(int(at[first]), int(at[last]) - length + 1, PIECE - length + 1):
                out.append((np.array([first]), np.array([[cut, min(int(at[last]), cut + PIECE)]])))
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of all windows within rows of joined bytes: core hash, context hash, first and last window.

    The windows of an anchor come in up to three parts, by their distance to it; those of a part
    share a core of about two thirds of their length, which stands for the anchor.
    """
    none = np.zeros(0, np.uint64)
    if len(data) < length:
        return none, none, none.astype(np.int64), none.astype(np.int64)
    total = _sums(data)
    at = np.arange(len(data) - gram + 1)
    grams = _hash(total, at, at + gram)
    wide = length - gram + 1
    key = (grams >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
    padded = np.full(-(-len(key) // wide) * wide, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, wide)
    before = np.minimum.accumulate(blocks, 1).reshape(-1)
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    n = len(data) - length + 1
    place = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    across = np.zeros(len(data) + 1, np.int32)
    np.add.at(across, np.maximum(ends[1:] - length + 1, ends[:-1]), 1)
    np.add.at(across, ends[1:], -1)
    valid = np.cumsum(across[:-1])[:n] == 0
    third = -(-wide // 3)
    part = place * 4 + (place - np.arange(n)) // third
    begins = valid.copy()
    begins[1:] &= ~valid[:-1] | (part[1:] != part[:-1])
    stops = valid.copy()
    stops[:-1] &= ~valid[1:] | (part[1:] != part[:-1])
    low, high = np.flatnonzero(begins), np.flatnonzero(stops)
    p, j = place[low], part[low] % 4
    core = p - third * j
    same = mix(_hash(total, core, core + length - third + 1) ^ j.astype(np.uint64))
    context = mix(_hash(total, low, high + length) ^ ((p - low) << 16 | (high - low)).astype(np.uint64))
    return same, context, low, high


def _packets(buckets: int, length: int):
    width = np.uint64((1 << 64) // buckets + 1)

    def each(batches):
        base, count = TaskContext.get().partitionId() << 24, 0
        keys: list = []
        held: list = []
        size = docs = 0

        def packed():
            nonlocal keys, held, size, docs, count
            packet = base + count
            count += 1
            rows = []
            gram, context, doc, low, span = (np.concatenate([h[i] for h in held]) if held else np.zeros(0, np.int64) for i in range(5))
            gram, context = gram.astype(np.uint64), context.astype(np.uint64)
            order = np.lexsort((context, gram))
            gram, context, doc, low, span = (x[order] for x in (gram, context, doc, low, span))
            new_gram = np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new = new_gram.copy()
            new[1:] |= context[1:] != context[:-1]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(gram))) > 1 if len(first) else np.zeros(0, bool)
            of_gram = np.cumsum(new_gram[first]) - 1 if len(first) else np.zeros(0, np.int64)
            hot = (np.bincount(of_gram) > CONTEXTS)[of_gram] if len(first) else np.zeros(0, bool)
            # classes that are sent come first in number, so that their places need not be sent
            number = np.empty(len(first), np.int64)
            number[np.argsort(hot, kind="stable")] = np.arange(len(first))
            table = np.zeros(len(gram), _ANCHOR)
            table["doc"], table["low"], table["span"] = doc, low, span
            if len(first):
                of_class = np.cumsum(new) - 1
                table["cls"] = number[of_class]
                table["flag"] = np.where(many[of_class], _TWIN, 0)
                table["flag"][first[hot]] |= _EDGE
            rows.append((_DOCS, -1 - packet, packet, np.concatenate([k[0] for k in keys]).tobytes(), np.concatenate([k[1] for k in keys]).tobytes(), table.tobytes(), None))
            sent = ~hot
            entry = first[sent]
            for kind, g, parts in ((_CLASS, gram[entry], (context[entry], many[sent])), (_COMMON, gram[first[hot & new_gram[first]]], None)):
                bucket = (g // width).astype(np.int64)
                edge = np.flatnonzero(np.diff(bucket)) + 1
                for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(g)]]), strict=True):
                    if b > a:
                        rest = [parts[0][a:b].tobytes(), np.array([a], "<u4").tobytes(), np.packbits(parts[1][a:b]).tobytes()] if parts else [None] * 3
                        rows.append((kind, int(bucket[a]), packet, pack_sorted(g[a:b]), *rest))
            keys, held, size, docs = [], [], 0, 0
            return rows

        for batch in batches:
            data, at = text_bytes(batch.column(2))
            k, kh = (batch.column(i).to_numpy(zero_copy_only=False).astype("<i8") for i in range(2))
            for first, last in slices(at, 8 * PIECE, PACKET_DOCS):
                keys.append((k[first:last], kh[first:last]))
                for rows, spans in pieces(at[first : last + 1], length):
                    part = data[spans[0, 0] : spans[-1, 1]]
                    gram, context, low, high = anchors(part, np.append(spans[:, 0], spans[-1, 1]) - spans[0, 0], length)
                    low, high = low + spans[0, 0], high + spans[0, 0]
                    row = rows[np.searchsorted(spans[:, 0], low, "right") - 1]
                    held.append((gram, context, row + docs, low - at[first + row], high - low))
                    size += len(low)
                docs += last - first
                if size >= PACKET or docs >= PACKET_DOCS:
                    yield _rows(packed())
        if keys:
            yield _rows(packed())

    return each


def _compared(table: pa.Table) -> pa.Table:
    """Of one range of anchors: flags of the classes that have twins or lie at edges."""
    kind = table.column("kind").to_pylist()
    if kind[0] == _DOCS:
        return table
    packet, a, b, c, d = (table.column(x).to_pylist() for x in ("packet", "a", "b", "c", "d"))
    grams = [unpack_sorted(x) for x in a]
    size = [len(g) for g in grams]
    gram = np.concatenate(grams)
    context = np.concatenate([np.frombuffer(x, "<u8") if x is not None else np.zeros(n, np.uint64) for x, n in zip(b, size, strict=True)])
    cls = np.concatenate([np.arange(n) + (np.frombuffer(x, "<u4")[0] if x is not None else 0) for x, n in zip(c, size, strict=True)])
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) if x is not None else np.zeros(n, np.uint8) for x, n in zip(d, size, strict=True)]).astype(bool)
    common = np.repeat(np.array(kind) == _COMMON, size)
    of = np.repeat(np.arange(len(kind)), size)
    order = np.lexsort((of, context, common, gram))
    gram, context, cls, many, common, of = (x[order] for x in (gram, context, cls, many, common, of))
    new_gram = np.ones(len(gram), bool)
    new_gram[1:] = gram[1:] != gram[:-1]
    new = new_gram.copy()
    new[1:] |= (context[1:] != context[:-1]) | (common[1:] != common[:-1])
    g, x = np.cumsum(new_gram) - 1, np.cumsum(new) - 1
    shared = ((np.bincount(g, new) > 1) | (np.bincount(g, common) > 0))[g]
    twin = ((np.bincount(x) > 1) | (np.bincount(x, many) > 0))[x]
    flag = np.where(twin, _TWIN, 0) | np.where(shared & (~twin | new), _EDGE, 0)
    told = np.flatnonzero((flag > 0) & ~common)
    told = told[np.argsort(of[told], kind="stable")]
    ends = np.searchsorted(of[told], np.arange(len(kind) + 1))
    rows = []
    for i in range(len(kind)):
        at = told[ends[i] : ends[i + 1]]
        if len(at):
            rows.append((_FLAG, -1 - packet[i], packet[i], cls[at].astype("<u4").tobytes(), flag[at].astype(np.uint8).tobytes(), None, None))
    return pa.Table.from_batches([_rows(rows)])


def merged(spans: np.ndarray) -> np.ndarray:
    """The union of (first, last + 1) pairs as disjoint ascending pairs that do not touch."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], 1)


def _marked(length: int):
    """Of one packet: repeated spans and windows to sort, by document."""

    def each(table: pa.Table) -> pa.Table:
        out: list = [[], [], [], []]
        flags, anchor, k = [], None, None
        for kind, a, b, c in zip(*(table.column(x).to_pylist() for x in ("kind", "a", "b", "c")), strict=True):
            if kind == _DOCS:
                k, kh, anchor = np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8"), np.frombuffer(c, _ANCHOR).copy()
            else:
                flags.append((np.frombuffer(a, "<u4"), np.frombuffer(b, np.uint8)))
        if len(anchor):
            anchor = anchor[np.argsort(anchor["cls"], kind="stable")]
            by_class = np.zeros(int(anchor["cls"].max()) + 1, np.uint8)
            for cls, flag in flags:
                by_class[cls] |= flag
            first = np.ones(len(anchor), bool)
            first[1:] = anchor["cls"][1:] != anchor["cls"][:-1]
            told = by_class[anchor["cls"]]
            flag = anchor["flag"] | told & _TWIN | np.where(first, told & _EDGE, 0)
            anchor["flag"] = flag
            anchor = anchor[flag > 0]
            anchor = anchor[np.argsort(anchor["doc"], kind="stable")]
            ends = np.searchsorted(anchor["doc"], np.arange(len(k) + 1))
            for i in np.unique(anchor["doc"]):
                own = anchor[ends[i] : ends[i + 1]]
                twin, edge = own[own["flag"] & _TWIN > 0], own[own["flag"] & _EDGE > 0]
                spans = merged(np.stack([twin["low"], twin["low"].astype(np.int64) + twin["span"] + length], 1).astype(np.int64))
                ask = np.zeros(len(edge), _ASK)
                ask["low"], ask["span"] = edge["low"], edge["span"]
                for column, x in zip(out, (int(k[i]), int(kh[i]), spans.astype("<u4").tobytes(), ask.tobytes()), strict=True):
                    column.append(x)
        return pa.table({"k": pa.array(out[0], pa.int64()), "kh": pa.array(out[1], pa.int64()), "spans": pa.array(out[2], pa.binary()), "ask": pa.array(out[3], pa.binary())})

    return each


def _tokens(data: np.ndarray, total: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading tokens of suffixes: the first eight bytes, and a hash of the whole window."""
    lead = np.zeros(len(start), np.uint64)
    for j in range(8):
        lead = lead << np.uint64(8) | data[start + j]
    return lead, _hash(total, start, start + length)


def _sampled(length: int, each_doc: int = 16):
    def each(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            leads, tails = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                if b - a >= length:
                    start = np.linspace(a, b - length, each_doc).astype(np.int64)
                    lead, tail = _tokens(data[a:b], _sums(data[a:b]), start - a, length)
                    leads.append(lead)
                    tails.append(tail)
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none).view(np.int64)) for x in (leads, tails)], ["lead", "tail"])

    return each


def _windows(splitters: tuple[np.ndarray, np.ndarray], length: int):
    """Documents with windows to sort, to packets of suffixes by range."""

    def each(batches):
        base, count = TaskContext.get().partitionId() << 24, 0
        held: list = []
        size = 0

        def packed():
            nonlocal held, size, count
            packet = base + count
            count += 1
            keys = [(h[0], h[1]) for h in held]
            lead, tail, start = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
            doc = np.repeat(np.arange(len(held)), [len(h[2]) for h in held])
            order = np.lexsort((tail, lead))
            lead, tail, start, doc = lead[order], tail[order], start[order], doc[order]
            new = np.ones(len(lead), bool)
            new[1:] = (lead[1:] != lead[:-1]) | (tail[1:] != tail[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(lead))) > 1
            table = np.zeros(len(lead), _ANCHOR)
            table["doc"], table["low"], table["cls"] = doc, start, np.cumsum(new) - 1
            table["flag"] = many[table["cls"]]
            rows = [(_DOCS, -1 - packet, packet, np.array([k for k, _ in keys], "<i8").tobytes(), np.array([k for _, k in keys], "<i8").tobytes(), table.tobytes(), None)]
            l, t = lead[first], tail[first]
            edge = [0]
            for x, y in zip(*splitters, strict=True):
                a, b = np.searchsorted(l, x, "left"), np.searchsorted(l, x, "right")
                edge.append(int(a + np.searchsorted(t[a:b], y, "right")))
            edge.append(len(l))
            for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                if b > a:
                    rows.append((_CLASS, i, packet, pack_sorted(l[a:b]), t[a:b].tobytes(), np.array([a], "<u4").tobytes(), None))
            held, size = [], 0
            return rows

        for batch in batches:
            data, at = text_bytes(batch.column(3))
            for i, (k, kh, ask) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                own = data[at[i] : at[i + 1]]
                ask = np.frombuffer(ask, _ASK)
                start = np.concatenate([np.arange(a, a + n + 1) for a, n in zip(ask["low"].astype(np.int64), ask["span"].astype(np.int64), strict=True)])
                held.append((k, kh, *_tokens(own, _sums(own), start, length), start))
                size += len(start)
                if size >= PACKET or len(held) >= PACKET_DOCS:
                    yield _rows(packed())
        if held:
            yield _rows(packed())

    return each


def multikey_quicksort(columns: list[np.ndarray], few: int = 64) -> np.ndarray:
    """Order of rows by several columns of tokens.

    Rows are split three ways at a pivot token; the smaller and larger parts go on with the same
    token, the equal part with the next. Parts of few rows are sorted at once.
    """
    order = np.arange(len(columns[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == len(columns):
            continue
        part = order[a:b]
        value = columns[depth][part]
        if b - a <= few:
            order[a:b] = part[np.lexsort([c[part] for c in reversed(columns[depth:])])]
            continue
        some = value[:: max(1, len(value) // 1024)]
        pivot = np.partition(some, len(some) // 2)[len(some) // 2]
        less, same = value < pivot, value == pivot
        order[a:b] = np.concatenate([part[less], part[same], part[~less & ~same]])
        m, e = a + int(less.sum()), a + int(less.sum()) + int(same.sum())
        todo += [(a, m, depth), (m, e, depth + 1), (e, b, depth)]
    return order


def _sorted_suffixes(table: pa.Table) -> pa.Table:
    """Of one range of suffixes: which of them have an equal neighbour in order."""
    kind = table.column("kind").to_pylist()
    if kind[0] == _DOCS:
        return table
    packet, a, b, c = (table.column(x).to_pylist() for x in ("packet", "a", "b", "c"))
    lead, tail = np.concatenate([unpack_sorted(x) for x in a]), np.concatenate([np.frombuffer(x, "<u8") for x in b])
    of = np.repeat(np.arange(len(kind)), [len(x) // 8 for x in b])
    cls = np.concatenate([np.frombuffer(x, "<u4")[0] + np.arange(len(y) // 8) for x, y in zip(c, b, strict=True)])
    order = multikey_quicksort([lead, tail])
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (lead[order][1:] == lead[order][:-1]) & (tail[order][1:] == tail[order][:-1])
    twin = np.zeros(len(order), bool)
    twin[order] = same[1:] | same[:-1]
    rows = []
    ends = np.searchsorted(of, np.arange(len(kind) + 1))
    for i, (low, high) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        at = low + np.flatnonzero(twin[low:high])
        if len(at):
            rows.append((_FLAG, -1 - packet[i], packet[i], cls[at].astype("<u4").tobytes(), np.full(len(at), _TWIN, np.uint8).tobytes(), None, None))
    return pa.Table.from_batches([_rows(rows)])


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """k, kh and spans, a set of binaries of (first, last + 1) byte pairs, of documents with repeats."""
    spark = docs.sparkSession
    ship(spark)
    buckets = 4 * partitions(spark)
    text = keyed(docs).select("k", "kh", "text")
    told = staged(text.mapInArrow(_packets(buckets, length), _ROW).groupBy("bucket").applyInArrow(_compared, _ROW), "anchors")
    mark = "k long, kh long, spans binary, ask binary"
    marks = staged(told.groupBy("packet").applyInArrow(_marked(length), mark), "marks")
    dropped(told)
    released(spark)
    asked = marks.where(F.length("ask") > 0).select("k", "kh", "ask")
    n = docs.count()
    share = F.pmod(F.xxhash64("kh", F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, 2_000 / max(n, 1)))
    sample = text.where(share).select("text").mapInArrow(_sampled(length), "lead long, tail long").limit(100_000).toArrow()
    lead, tail = (sample.column(c).to_numpy().view(np.uint64) for c in ("lead", "tail"))
    order = np.lexsort((tail, lead))
    at = order[np.linspace(0, len(order) - 1, min(buckets, len(order)) + 1).astype(int)[1:-1]] if len(order) else order
    windows = asked.hint("merge").join(text, ["k", "kh"]).select("k", "kh", "ask", "text").mapInArrow(_windows((lead[at], tail[at]), length), _ROW)
    ranked = staged(windows.groupBy("bucket").applyInArrow(_sorted_suffixes, _ROW), "suffixes")
    edges = staged(ranked.groupBy("packet").applyInArrow(_marked(length), mark), "edges")
    dropped(ranked)
    released(spark)
    every = marks.select("k", "kh", "spans").unionByName(edges.select("k", "kh", "spans")).where(F.length("spans") > 0)
    return every.groupBy("k", "kh").agg(F.collect_set("spans").alias("spans"))


def _kept(data: np.ndarray, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Remaining bytes and removed spans."""
    cut = merged(np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 2) for s in spans]).astype(np.int64)) if spans else merged(np.zeros((0, 2), np.int64))
    step = np.zeros(len(data) + 1, np.int32)
    step[cut[:, 0]] += 1
    step[cut[:, 1]] -= 1
    return data[np.cumsum(step[:-1]) == 0], cut


def repeat_digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte is removed if a string of `length` bytes that covers it also starts anywhere else, in
    this document or another; matches never cross documents, and strings are judged on the input.
    Null texts are empty; texts shorter than `length` keep all; repeated rows are documents like
    others, so their texts of at least `length` bytes go wholly. Columns but doc_id and text are
    ignored; an empty table gives no rows.
    """

    def each(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            rows = []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                own = data[at[i] : at[i + 1]]
                kept, cut = _kept(own, spans or [])
                rows.append((len(own), len(own) - len(kept), len(cut), hashlib.sha256(kept.tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = staged(repeated_spans(docs, length), "spans")
    joined = keyed(docs).join(found.hint("merge"), ["k", "kh"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeated strings cut out, with all their columns.

    Where a cut splits a character, what is left of it goes too. n_chars, if there, is counted anew.
    """

    def each(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(0))
            texts = [bytes(_kept(data[at[i] : at[i + 1]], spans)[0]).decode("utf-8", "ignore") if spans else None for i, spans in enumerate(batch.column(1).to_pylist())]
            old = batch.column(0)
            new = pa.array([t if t is not None else o.as_py() for t, o in zip(texts, old, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new, batch.column(2)], ["new_text", "doc"])

    found = staged(repeated_spans(docs, length), "spans")
    others = [c for c in docs.columns if c != "text"]
    row = docs.select(F.struct(*docs.columns).alias("doc"))
    row = row.select("doc", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(-(2**63))).alias("k"), F.xxhash64(F.isnull(F.col("doc.doc_id").cast("long")), F.coalesce("doc.text", F.lit(""))).alias("kh"), F.col("doc.text").alias("text"))
    joined = row.join(found.hint("merge"), ["k", "kh"], "left").select("text", "spans", F.col("doc").dropFields("text").alias("doc"))
    kind = StructType([StructField("new_text", StringType()), joined.schema["doc"]])
    out = joined.mapInArrow(each, kind)
    value = {"text": F.col("new_text")}
    if "n_chars" in others:
        value["n_chars"] = F.length("new_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[value.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns])

