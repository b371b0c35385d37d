"""N-gram Jaccard join by prefix filters under several global token orders.

Tokens are hashed word shingles; a document is its set of tokens. If two sets are similar enough,
then under any global order of tokens their prefixes (the first n - ceil(t n) + 1 tokens) share
a token. The work is laid out so that only what can still matter travels:

1. Tokens go, sorted and packed by range of hash, to the task of their range, which tells which
   of them occur in more than one set. Tokens that are shared within one packet go as one entry,
   so a very common token is no burden to its range.
2. That is done twice. At first only tokens of the lowest hashes go, in 40 bits: a set of which
   more than n - ceil(t n) of these occur nowhere else has no partner, however many others do. Then
   all tokens go of one document for each set that is left; packets get back their shared tokens
   with how many documents sent each, and a set with fewer than ceil(t n) of them has no partner.
   So most tokens never travel, and only documents whose key a sieve lets through are cut into
   words again.
3. For the rest, tokens are ordered by frequency (ties by different hashes, and once by frequency
   class alone), and each order links sets that share a prefix token, by stars, not pairs. Sets
   that are connected under every order form a family. Frequencies are each token's own: were
   tokens counted in slots of one table, slots would fill as the input grows, common tokens would
   come into prefixes, and families grow into one another.
4. Families are verified exactly, in blocks, by products of incidence matrices; a block pair puts
   out links that span what it found, not all pairs.
"""

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix, mix_int, partitions, released, shingle_hashes, ship, sieve, sieved, slices, staged, text_bytes, word_hashes
from .graph import components

#: Tokens that a task holds before it packs them.
PACKET = 1_500_000
#: Documents of one packet at most, so that two bytes name one.
PACKET_DOCS = 1 << 16
#: Of so many parts of all hashes, these are looked at first, with so many bits less, as they only narrow what follows.
PARTS, FIRST_PARTS, SHORT = 8, 3, np.uint64(24)
#: Steps of a frequency between a number and twice that number.
OCTAVE = 2000
#: Sets that are compared with each other at once.
BLOCK = 1000
#: Global token orders.
ORDERS = 3

_PACKED = "kind int, bucket long, packet long, a binary, b binary, c binary, d binary"
_EMPTY = {"kind": pa.int32(), "bucket": pa.int64(), "packet": pa.int64(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "d": pa.binary()}
_DOCS, _SINGLE, _COMMON, _SHARED, _COUNTED = range(5)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _EMPTY.values(), strict=True)], list(_EMPTY))


def pack_sorted(h: np.ndarray) -> bytes:
    """Ascending 64-bit integers as the first, then differences of 3, 4, 6 or 8 bytes."""
    if not len(h):
        return b""
    step = np.diff(h)
    most = int(step.max()) if len(step) else 0
    width = 3 if most < 1 << 24 else 4 if most < 1 << 32 else 6 if most < 1 << 48 else 8
    return bytes([width]) + h[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(held: bytes) -> np.ndarray:
    if not held:
        return np.zeros(0, np.uint64)
    width = held[0]
    step = np.zeros(((len(held) - 9) // width, 8), np.uint8)
    step[:, :width] = np.frombuffer(held, np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(held, "<u8", 1, 1), step.view("<u8")[:, 0]]), dtype=np.uint64)


def needed(n: np.ndarray, t: Fraction) -> np.ndarray:
    """ceil(t n)."""
    return -((-n * t.numerator) // t.denominator)


def _set_ids(tokens: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
    n = np.diff(ends).astype(np.uint64)
    return mix((total[ends[1:]] - total[ends[:-1]]) ^ mix(n + np.uint64(1)))


def _packets(k: int, buckets: int, first_parts: bool = False, bits: np.ndarray | None = None):
    """Documents (doc_id, text, key) to packed rows.

    With first_parts, only the tokens of FIRST_PARTS go, shortened, and the replies name documents
    alone. With bits, documents whose key this sieve holds back are left out.
    """
    most = (1 << 64) // PARTS * FIRST_PARTS if first_parts else 1 << 64
    width = np.uint64(((most >> int(SHORT)) if first_parts else most) // buckets + 1)

    def each(batches):
        base, count = TaskContext.get().partitionId() << 24, 0
        held: list = []
        size = docs = 0

        def packed():
            nonlocal held, size, docs, count
            packet = base + count
            count += 1
            ids = np.concatenate([x[0] for x in held])
            known = np.concatenate([x[1] for x in held])
            tokens = np.concatenate([x[2] for x in held])
            n, sent, sets, keys = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5, 6))
            rows = [(_DOCS, -1 - packet, packet, ids.tobytes(), known.tobytes(), sets.tobytes(), np.concatenate([n, sent]).astype("<u4").tobytes() + keys.tobytes())]
            # equal sets of a packet send their tokens once
            _, first = np.unique(sets, return_index=True)
            keep = np.zeros(len(n), bool)
            keep[first] = True
            of = np.repeat(np.arange(len(n)), sent)
            mask = keep[of]
            tokens, of = tokens[mask], of[mask].astype("<u2")
            order = np.argsort(tokens)
            tokens, of = tokens[order], of[order]
            same = np.zeros(len(tokens) + 1, bool)
            same[1:-1] = tokens[1:] == tokens[:-1]
            shared = same[1:] | same[:-1]
            if shared.any():
                rows.append((_SHARED, -1 - packet, packet, None if first_parts else tokens[shared].tobytes(), of[shared].tobytes(), None, None))
            one, of_one = tokens[~shared], of[~shared]
            first = np.flatnonzero(shared & ~same[:-1])
            common, times = tokens[first], None if first_parts else (np.flatnonzero(same[:-1] & ~same[1:]) + 1 - first).astype("<u2")
            for kind, h, refs in ((_SINGLE, one, of_one), (_COMMON, common, times)):
                bucket = (h // width).astype(np.int64)
                edge = np.flatnonzero(np.diff(bucket)) + 1
                for a, b in zip(np.concatenate([[0], edge]), np.concatenate([edge, [len(h)]]), strict=True):
                    if b > a:
                        rows.append((kind, int(bucket[a]), packet, pack_sorted(h[a:b]), None if refs is None else refs[a:b].tobytes(), None, None))
            held, size, docs = [], 0, 0
            return rows

        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(sieved(bits, batch.column(2).to_numpy())))
            data, at = text_bytes(batch.column(1))
            ids, keys = batch.column(0), batch.column(2).to_numpy().astype("<i8")
            known = np.asarray(ids.is_valid())
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for first, last in slices(at, 1 << 21):
                words, ends, _, _ = word_hashes(data[at[first] : at[last]], at[first : last + 1] - at[first])
                shingles, ends = shingle_hashes(words, ends, k)
                parts = [np.unique(shingles[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                tokens, n = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
                own, sets = ids[first:last].astype("<i8"), _set_ids(tokens, np.concatenate([[0], np.cumsum(n)]))
                sent = n
                if first_parts:
                    goes = tokens < np.uint64(most)
                    sent = np.bincount(np.repeat(np.arange(last - first), n)[goes], minlength=last - first)
                    tokens = tokens[goes] >> SHORT
                held.append((own, known[first:last].astype(np.uint8), tokens, n, sent, sets, keys[first:last]))
                size, docs = size + len(tokens), docs + len(sent)
                if size >= PACKET or docs >= PACKET_DOCS // 2:
                    yield _rows(packed())
        if held:
            yield _rows(packed())

    return each


def steps(n: np.ndarray) -> np.ndarray:
    """Frequencies in two bytes, in steps that rise with them; smaller ones than about 2,900 have a step of their own."""
    return (np.log2(n) * OCTAVE).astype("<u2")


def _told(tokens: bool, counted: bool = False):
    """Of one range of hashes: which tokens occur in several sets (and, if counted, how often), told to their packets, or of which documents they are."""

    def each(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_pylist()
        if kind[0] in (_DOCS, _SHARED):
            return table
        a, b, packet = (table.column(c).to_pylist() for c in ("a", "b", "packet"))
        hashes = [unpack_sorted(x) for x in a]
        size = np.array([len(h) for h in hashes])
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        same = np.zeros(len(every) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        several = np.zeros(len(every), bool)
        several[order] = same[1:] | same[:-1]
        often = np.zeros(len(every), "<u2")
        if counted and len(every):
            times = np.concatenate([np.ones(n, np.int64) if k == _SINGLE else np.frombuffer(x, "<u2").astype(np.int64) for k, n, x in zip(kind, size, b, strict=True)])
            first = np.flatnonzero(~same[:-1])
            often[order] = np.repeat(steps(np.add.reduceat(times[order], first)), np.diff(np.append(first, len(every))))
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = []
        for i, k in enumerate(kind):
            own = slice(ends[i], ends[i + 1])
            hit = several[own]
            if k == _SINGLE and hit.any():
                rows.append((_SHARED, -1 - packet[i], packet[i], hashes[i][hit].tobytes() if tokens else None, np.frombuffer(b[i], "<u2")[hit].tobytes(), often[own][hit].tobytes() if counted else None, None))
            elif k == _COMMON and counted:
                rows.append((_COUNTED, -1 - packet[i], packet[i], a[i], None, often[own].tobytes(), None))
        return pa.Table.from_batches([_rows(rows)])

    return each


_shared_tokens = _told(True)


def _packet(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of one packet: keys, sets, sizes and numbers of tokens sent of its documents, and those of its shared tokens."""
    kind, b = (table.column(c).to_pylist() for c in ("kind", "b"))
    at = kind.index(_DOCS)
    sets, d = np.frombuffer(table.column("c")[at].as_py(), "<u8"), table.column("d")[at].as_py()
    n, sent = np.frombuffer(d, "<u4", 2 * len(sets)).astype(np.int64).reshape(2, -1)
    return np.frombuffer(d, "<i8", offset=8 * len(sets)), sets, n, sent, np.concatenate([np.frombuffer(x, "<u2") for x, k in zip(b, kind, strict=True) if k == _SHARED] or [np.zeros(0, "<u2")])


def _left(t: Fraction):
    """Sets that may have a partner by what was sent of them, with a key of each document."""

    def each(table: pa.Table) -> pa.Table:
        keys, sets, n, sent, of = _packet(table)
        # of equal sets of a packet, the first had its tokens sent
        _, first = np.unique(sets, return_index=True)
        alone = sent - np.bincount(of, minlength=len(n))
        at = first[(n[first] > 0) & (alone[first] <= n[first] - needed(n[first], t))]
        return pa.table({"set_id": pa.array(sets[at].view(np.int64)), "key": pa.array(keys[at])})

    return each


def _survivors(t: Fraction):
    def each(table: pa.Table) -> pa.Table:
        _, sets, n, _, of = _packet(table)
        kind, a, c = (table.column(x).to_pylist() for x in ("kind", "a", "c"))
        tokens = np.concatenate([np.frombuffer(x, "<u8") for x, k in zip(a, kind, strict=True) if k == _SHARED] or [np.zeros(0, "<u8")])
        # what the packet shares within itself was counted apart, once for all its documents
        told = [(unpack_sorted(x), np.frombuffer(y, "<u2")) for x, y, k in zip(a, c, kind, strict=True) if k == _COUNTED]
        common, times = (np.concatenate([x[i] for x in told]) for i in (0, 1)) if told else (np.zeros(0, "<u8"), np.zeros(0, "<u2"))
        order = np.argsort(common)
        common, times = common[order], times[order]
        often = [times[np.searchsorted(common, np.frombuffer(x, "<u8"))] if y is None else np.frombuffer(y, "<u2") for x, y, k in zip(a, c, kind, strict=True) if k == _SHARED]
        often = np.concatenate(often or [np.zeros(0, "<u2")])
        enough = np.flatnonzero((np.bincount(of, minlength=len(n)) >= needed(n, t)) & (n > 0))
        keep = np.isin(of, enough)
        order = np.argsort(of[keep], kind="stable")
        tokens, often, of = tokens[keep][order], often[keep][order], of[keep][order]
        ends = np.searchsorted(of, np.append(enough, 1 << 16))
        tokens, often = (pa.array([x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in (tokens, often))
        return pa.table({"set_id": pa.array(sets[enough].view(np.int64)), "n": pa.array(n[enough]), "tokens": tokens, "often": often})

    return each


def _prefixes(t: Fraction):
    """Prefix tokens of each set (set_id, n, tokens, often) that can be shared, under each order."""

    def each(batches):
        for batch in batches:
            out_set, out_key = [], []
            for set_id, n, held, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                # tokens that no other set has come first, and are not here
                tokens, often = np.frombuffer(held.as_buffer(), "<u8"), np.frombuffer(times.as_buffer(), "<u2")
                least = int(needed(np.array([n]), t)[0])
                room = n - least + 1 - (n - len(tokens))
                if room <= 0:
                    continue
                for order in range(ORDERS):
                    rank = often // OCTAVE if order == ORDERS - 1 else often
                    tie = mix(tokens ^ np.uint64(mix_int(order + 11)))
                    first = tokens[np.lexsort((tie, rank))[:room]]
                    out_key.append(mix(first ^ np.uint64(mix_int(order + 101))))
                    out_set.append(np.full(len(first), mix_int((set_id & (2**64 - 1)) ^ mix_int(order + 1001)), np.uint64))
            none = [np.zeros(0, np.uint64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_set or none).view(np.int64)), pa.array(np.concatenate(out_key or none).view(np.int64))], ["node", "key"])

    return each


def _order_nodes(batches):
    """set_id to its nodes under all orders."""
    for batch in batches:
        sets = batch.column(0).to_numpy(zero_copy_only=False)
        nodes = [pa.array(np.array([mix_int((int(s) & (2**64 - 1)) ^ mix_int(o + 1001)) for s in sets], np.uint64).view(np.int64)) for o in range(ORDERS)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *nodes], ["set_id", *(f"node{o}" for o in range(ORDERS))])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by incidence matrices of so many tokens at a time."""
    n = len(sets)
    token, of = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(of, kind="stable")
    of, member = of[order], member[order]
    out = np.zeros((n, n), np.float64)
    width = max(256, (1 << 22) // max(n, 1))
    for first in range(0, len(token), width):
        a, b = np.searchsorted(of, [first, first + width])
        part = np.zeros((n, min(width, len(token) - first)), np.float32)
        part[member[a:b], of[a:b] - first] = 1
        out += part @ part.T
    return np.rint(out).astype(np.int64)


def spanning(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links, the smallest row in its component."""
    label = np.arange(len(linked))
    seen = np.zeros(len(linked), bool)
    for i in range(len(linked)):
        if seen[i]:
            continue
        front = np.zeros(len(linked), bool)
        front[i] = True
        reach = front.copy()
        while front.any():
            front = linked[front].any(0) & ~reach
            reach |= front
        label[reach] = i
        seen |= reach
    return label


def _verified(t: Fraction):
    def each(table: pa.Table) -> pa.Table:
        ids = table.column("set_id").to_numpy()
        order = np.argsort(ids)
        ids, n = ids[order], table.column("n").to_numpy()[order]
        held = table.column("tokens").combine_chunks()
        inter = overlaps([np.frombuffer(held[int(i)].as_buffer(), "<u8") for i in order])
        union = n[:, None] + n[None, :] - inter
        linked = inter * t.denominator >= union * t.numerator
        block = table.column("block").to_numpy()[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        if i != j:  # within a block is another task's work
            linked &= block[:, None] != block[None, :]
        np.fill_diagonal(linked, True)
        label = spanning(linked)
        at = np.flatnonzero(label != np.arange(len(ids)))
        return pa.table({"a": pa.array(ids[at], pa.int64()), "b": pa.array(ids[label[at]], pa.int64())})

    return each


def near_sets(docs: DataFrame, k: int = 5, threshold: str = "0.8") -> tuple[DataFrame, DataFrame]:
    """All documents' sets (doc_id, n, set_id) and links between sets (a, b).

    The links are enough to connect what similar pairs connect: two sets are in one component of
    links if and only if a chain of pairs of at least the threshold joins them.
    """
    spark = docs.sparkSession
    ship(spark)
    t = Fraction(threshold)
    buckets = 4 * partitions(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    docs = docs.withColumn("key", F.xxhash64(F.isnull("doc_id"), "doc_id", "text"))
    told = staged(docs.mapInArrow(_packets(k, buckets, first_parts=True), _PACKED).groupBy("bucket").applyInArrow(_told(False), _PACKED), "first")

    def doc_rows(batches):
        for batch in batches:
            for a, b, c, d in zip(*(batch.column(x).to_pylist() for x in "abcd"), strict=True):
                known = np.frombuffer(b, np.uint8).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(a, "<i8"), pa.int64(), mask=~known), pa.array(np.frombuffer(d, "<u4")[: len(known)].astype(np.int64)), pa.array(np.frombuffer(c, "<i8"))], ["doc_id", "n", "set_id"])

    sets = staged(told.where(F.col("kind") == _DOCS).select("a", "b", "c", "d").mapInArrow(doc_rows, "doc_id long, n long, set_id long"), "sets")
    kept = F.col("kind").isin(_DOCS, _SHARED)
    one = told.where(kept).groupBy("packet").applyInArrow(_left(t), "set_id long, key long").groupBy("set_id").agg(F.min("key").alias("key"))
    bits = sieve(one.select("key"))
    dropped(told)
    released(spark)
    # what the sieve lets through besides is only looked at in vain
    told = staged(docs.mapInArrow(_packets(k, buckets, bits=bits), _PACKED).groupBy("bucket").applyInArrow(_told(True, counted=True), _PACKED), "shared")
    released(spark)
    left = told.groupBy("packet").applyInArrow(_survivors(t), "set_id long, n long, tokens binary, often binary")
    # equal sets of several packets: whichever packet found the most shared tokens has them all
    left = staged(left, "left")
    dropped(told)
    every, left = left, left.groupBy("set_id").agg(F.max_by(F.struct("n", "tokens", "often"), F.length("tokens")).alias("x")).select("set_id", "x.n", "x.tokens", "x.often")
    left = staged(left, "left")
    dropped(every)
    released(spark)
    keys = staged(left.mapInArrow(_prefixes(t), "node long, key long"), "prefixes")
    stars = keys.join(keys.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b")
    part = components(stars)
    nodes = left.select("set_id").mapInArrow(_order_nodes, "set_id long, " + ", ".join(f"node{o} long" for o in range(ORDERS)))
    for o in range(ORDERS):
        nodes = nodes.join(part.select(F.col("node").alias(f"node{o}"), F.col("component").alias(f"part{o}")), f"node{o}")
    nodes = nodes.select("set_id", F.xxhash64(*(f"part{o}" for o in range(ORDERS))).alias("family"))
    nodes = staged(nodes, "families")
    dropped(keys)
    sizes = nodes.groupBy("family").count().where("count > 1").select("family", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    members = left.join(nodes, "set_id").join(sizes, "family")
    members = members.withColumn("block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_id", "n", "tokens")
    links = staged(members.groupBy("family", "i", "j").applyInArrow(_verified(t), "a long, b long"), "links")
    for done in (nodes, left):
        dropped(done)
    released(spark)
    return sets, links


def near_components(docs: DataFrame, k: int = 5, threshold: str = "0.8") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    A document's set holds its distinct shingles of k words, with A-Z in lower case; fewer words
    count as one shingle, and documents without words (null and empty texts) have none and are
    linked with nothing. component_id is the smallest doc_id that links of at least the threshold
    reach. Repeated rows are documents like others; null doc_ids are never the smallest. Columns
    but doc_id and text are ignored. An empty table gives no rows.
    """
    sets, links = near_sets(docs, k, threshold)
    joined = components(links)
    least = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    least = least.join(joined, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("component", "set_id").alias("root"))
    least = staged(least, "least")
    roots = least.groupBy("root").agg(F.min("least").alias("component_id"))
    found = least.select("set_id", "root").join(roots, "root").select(F.col("set_id").alias("of"), "component_id")
    return sets.join(found, (F.col("set_id") == F.col("of")) & (F.col("n") > 0), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
