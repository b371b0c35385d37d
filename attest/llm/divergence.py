"""How far the sources of a language differ in their words, by exact integer shares."""

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, ship, staged

#: Letters as they are counted: A-Z in lower case, other ASCII as blanks, all else as it is.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Fine parts of the vocabulary, in which its load is measured; slices are made of them.
BUCKETS = 1 << 12
#: Terms of a slice, about: an automaton holds the kept terms of one slice of one language.
SLICE = 1 << 16
SCALE = 1_000_000_000
#: Distinct terms, or pairs of groups, that a task holds before it passes them on; bytes of padded terms likewise.
HELD, PADDED = 1 << 18, 1 << 21
#: Bytes of padded terms that are worth an automaton of their own, and of how many documents one is looked at
#: to tell how the load is spread: that only decides which task counts what.
LEAST_LOAD, LOOKED_AT = 1 << 22, 8
#: Pairs of postings that are worked on at once.
PAIRS = 1 << 18


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


def _table(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


class _Slices(dict):
    """The slice of each term, told once."""

    def __init__(self, slices: int):
        self.slices = slices

    def __missing__(self, term: bytes) -> int:
        k = self[term] = crc32(term) % BUCKETS % self.slices
        return k


# ---- first pass: document frequencies -----------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, df, bucket, load): documents with a term, and about how many bytes each bucket has."""
    df: dict[str, Counter] = {}
    uses: dict[str, Counter] = {}
    load: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in df.items():
            yield _table(lang=pa.array([lang] * len(own), pa.string()), term=_strings(list(own)), df=pa.array(list(own.values()), pa.int64()), bucket=pa.nulls(len(own), pa.int32()), load=pa.nulls(len(own), pa.int64()))
        for lang, own in uses.items():
            sizes = load.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for term, n in own.items():
                sizes[crc32(term) % BUCKETS] += LOOKED_AT * n * (len(term) + 1)

    row = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            found = terms(text.as_py())
            df.setdefault(lang, Counter()).update(set(found))
            if row % LOOKED_AT == 0:
                uses.setdefault(lang, Counter()).update(found)
            row += 1
        if sum(map(len, df.values())) > HELD:
            yield from out()
            df.clear()
            uses.clear()
    yield from out()
    for lang, sizes in load.items():
        own = np.flatnonzero(sizes)
        yield _table(lang=pa.array([lang] * len(own), pa.string()), term=pa.nulls(len(own), pa.string()), df=pa.nulls(len(own), pa.int64()), bucket=pa.array(own, pa.int32()), load=pa.array(sizes[own], pa.int64()))


# ---- second pass: occurrences, by automata over slices of the vocabulary --------------------


def _routed(slices: int, spread: dict[tuple[str, int], int]):
    """Texts as padded terms (lang, slice, salt, source, padded), each term sent to its slice.

    `spread` has the slices with more than their share of the load and over how many keys they
    are dealt.
    """

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[list[bytes]]] = {}
        size, turn = 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            rows = []
            for (lang, source), own in held.items():
                for k, found in enumerate(own):
                    if found:
                        n = spread.get((lang, k), 1)
                        turn += 1
                        # a term between two others ends one match and begins the next with one blank
                        for i in range(0, len(found), step := -(-len(found) // n)):
                            rows.append((lang, k, (turn + i // step) % n, source, b" " + b" ".join(found[i : i + step]) + b" "))
            if rows:
                lang, k, salt, source, padded = zip(*rows)
                yield _table(lang=pa.array(lang, pa.string()), slice=pa.array(k, pa.int32()), salt=pa.array(salt, pa.int32()), source=pa.array(source, pa.string()), padded=_strings(list(padded)))

        of = _Slices(slices)
        for batch in batches:
            for lang, source, text in zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"]):
                own = held.setdefault((lang, source), [[] for _ in range(slices)])
                found = terms(text.as_py())
                size += sum(map(len, found)) + len(found)
                if len(of) > HELD // 2:
                    of.clear()
                if slices == 1:
                    own[0] += found
                else:
                    for k, term in zip(map(of.__getitem__, found), found):
                        own[k].append(term)
                if size > PADDED:
                    yield from out()
                    held.clear()
                    size = 0
        yield from out()

    return route


def _recounted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n) from rows sorted by (lang, slice, salt), a key's vocabulary first.

    A row with `terms` belongs to the vocabulary, one with `padded` is text. An automaton lives
    until the next key comes.
    """
    import ahocorasick

    key, words, automaton = None, [], None
    counts: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for source, n in counts.items():
            own = np.flatnonzero(n)
            if len(own):
                yield _table(lang=pa.array([key[0]] * len(own), pa.string()), source=pa.array([source] * len(own), pa.string()), term=pa.array([words[i] for i in own], pa.string()), n=pa.array(n[own], pa.int64()))

    for batch in batches:
        keys = zip(batch["lang"].to_pylist(), batch["slice"].to_pylist(), batch["salt"].to_pylist())
        for now, more, source, padded in zip(keys, batch["terms"].to_pylist(), batch["source"].to_pylist(), batch["padded"]):
            if now != key:
                yield from out()
                counts.clear()
                key, words, automaton = now, [], None
            if more is not None:
                words += more.split(" ")
                continue
            if not words:
                continue
            if automaton is None:
                automaton = ahocorasick.Automaton()
                for i, word in enumerate(words):
                    automaton.add_word(f" {word} ", i)
                automaton.make_automaton()
            if source not in counts:
                if len(counts) * len(words) > 1 << 24:
                    yield from out()
                    counts.clear()
                counts[source] = np.zeros(len(words), np.int64)
            found = [i for _, i in automaton.iter(padded.as_py())]
            counts[source] += np.bincount(found, minlength=len(words)) if found else 0
    yield from out()


def vocabulary(docs: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Kept terms (lang, term) in at least `least` documents of a language, and loads (lang, bucket, load)."""
    found = staged(docs.select("lang", "text").mapInArrow(_frequencies, "lang string, term string, df long, bucket int, load long").groupBy("lang", "term", "bucket").agg(F.sum("df").alias("df"), F.sum("load").alias("load")), "frequencies")
    return found.where(F.col("df") >= least).select("lang", "term"), found.where("bucket is not null").select("lang", "bucket", "load")


def postings(docs: DataFrame, kept: DataFrame, loads: DataFrame) -> DataFrame:
    """(lang, source, term, n): how often each group has each kept term, where it does.

    The vocabulary is cut into slices of about SLICE terms of a language, so that an automaton is
    bounded however large the vocabulary grows, and every term of a text goes to its own slice
    only. Slices with more than a partition's share of all bytes are dealt over several keys, each
    with the slice's vocabulary: at most as many as there are partitions.
    """
    spark = docs.sparkSession
    most = kept.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    slices = min(BUCKETS, 1 << max(0, -(-most // SLICE) - 1).bit_length())
    width = partitions(spark)
    total = loads.agg(F.sum("load")).first()[0] or 1
    share = max(total / width, LEAST_LOAD)
    shares = loads.groupBy("lang", (F.col("bucket") % slices).alias("slice")).agg(F.ceil(F.sum("load") / F.lit(float(share))).cast("int").alias("spread"))
    hot = shares.where("spread > 1")
    # loads sum up to the total, so fewer slices than partitions have more than one share
    spread = {(r["lang"], r["slice"]): r["spread"] for r in hot.collect()}
    wide = spark.createDataFrame([(*k, n) for k, n in spread.items()], "hot_lang string, hot_slice int, spread int")
    # a row of vocabulary for each bucket: a few dozen to some thousand terms
    words = kept.groupBy("lang", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int").alias("bucket")).agg(F.array_join(F.collect_list("term"), " ").alias("terms"))
    words = words.withColumn("slice", F.col("bucket") % slices).join(F.broadcast(wide), (F.col("lang") == F.col("hot_lang")) & (F.col("slice") == F.col("hot_slice")), "left")
    words = words.select("lang", "slice", F.explode(F.sequence(F.lit(0), F.coalesce("spread", F.lit(1)) - 1)).alias("salt"), "terms", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("padded"))
    texts = docs.select("lang", "source", "text").mapInArrow(_routed(slices, spread), "lang string, slice int, salt int, source string, padded string").select("lang", "slice", "salt", F.lit(None).cast("string").alias("terms"), "source", "padded")
    both = words.unionByName(texts).repartition(width, "lang", "slice", "salt").sortWithinPartitions("lang", "slice", "salt", F.col("padded").isNotNull())
    found = both.mapInArrow(_recounted, "lang string, source string, term string, n long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


# ---- shares, pairs and ranks ------------------------------------------------------------------


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 * (n + 1) / (total + kept)), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))


def gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, extra, both) of groups that share terms, from postings with each term's rows on end.

    extra corrects, for the terms that both have, a sum that takes each group's terms to be
    missing in the other.
    """
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def reduced(parts: list) -> tuple[np.ndarray, np.ndarray]:
        keys, sums = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((keys[:, 1], keys[:, 0]))
        keys, sums = keys[order], sums[order]
        first = np.flatnonzero(np.r_[True, (np.diff(keys, axis=0) != 0).any(1)]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(sums, first, axis=0) if len(first) else sums

    def out(parts: list) -> pa.RecordBatch:
        keys, sums = reduced(parts)
        return _table(a=pa.array(keys[:, 0]), b=pa.array(keys[:, 1]), extra=pa.array(sums[:, 0]), both=pa.array(sums[:, 1]))

    def paired(group: np.ndarray, p: np.ndarray, p0: np.ndarray, ends: np.ndarray) -> None:
        """Adds the pairs of all terms; ends are the first rows of terms, and the number of rows."""
        width = np.diff(ends)
        start, size = np.repeat(ends[:-1], width), np.repeat(width, width)
        at = 0
        while at < len(group):
            # rows whose pairs together are few enough; one row at least
            till = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), PAIRS, "right")))
            n = size[at:till]
            i = np.repeat(np.arange(at, till), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[at:till], n)
            keep = i != j
            i, j = i[keep], j[keep]
            f = lambda x, y: (x - y) ** 2 // y
            extra = f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j])
            if len(i):
                parts.append(reduced([(np.stack([group[i], group[j]], 1), np.stack([extra, np.ones(len(i), np.int64)], 1))]))
            at = till

    kept: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> None:
        names = pc.run_end_encode(rows["term"].combine_chunks()).run_ends.to_numpy()
        paired(*(rows[c].to_numpy() for c in ("id", "p", "p0")), np.r_[0, names])

    for batch in batches:
        if not len(batch):
            continue
        last = batch["term"][-1].as_py()
        # the last term may go on in the next batch
        names = pc.equal(batch["term"], pa.scalar(last)).to_numpy(zero_copy_only=False)
        cut = int(np.argmax(names))
        if cut or (kept and kept[0]["term"][-1].as_py() != last):
            work(pa.Table.from_batches([*kept, batch.slice(0, cut)]))
            kept = []
        kept.append(batch.slice(cut))
        if sum(len(k) for k, _ in parts) > HELD:
            parts = [reduced(parts)]
            if len(parts[0][0]) > HELD // 2:
                yield out(parts)
                parts = []
    if kept:
        work(pa.Table.from_batches(kept))
    if parts:
        yield out(parts)


def audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value and rank of each group (lang, source) of docs.

    Null text, lang and source are read as ''. A language keeps the terms that at least `least` of
    its documents have. Part `pair` has every other source of the language as item and the
    divergence from it as value; part `term` has up to `top` terms that the group has more often
    than its language. A language without kept terms gives pairs of value 0. Documents without
    terms make a group all the same; repeated rows count again; a table without rows gives none.

    A pair's sum is made of each group's own terms against the other's share of a missing term
    (by histograms of counts), of what terms in both change in it, and of the terms in neither.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept, loads = vocabulary(own, least)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    found = staged(postings(own, kept, loads), "postings")
    tallies = found.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    groups = own.select("lang", "source").distinct().join(tallies, ["lang", "source"], "left").join(sizes, "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.select("lang", "source", zero("total"), zero("own"), zero("kept")).withColumn("p0", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))))
    groups = staged(groups.withColumn("id", F.monotonically_increasing_id()), "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.max("kept").alias("lang_kept"))
    weighed = found.join(groups.select("lang", "source", "id", "total", "kept", "p0"), ["lang", "source"]).select("lang", "source", "id", "term", "n", "p0", share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    # terms that a group has more often than its language
    of_lang = weighed.withColumn("lang_n", F.sum("n").over(Window.partitionBy("lang", "term"))).join(langs, "lang")
    over = of_lang.withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("lang_kept"))).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    # pairs of sources
    near = weighed.select("lang", "term", "id", "p", "p0").repartition(partitions(spark), "lang", "term").sortWithinPartitions("lang", "term", "id").select(F.concat_ws("\x00", "lang", "term").alias("term"), "id", "p", "p0")
    shared = near.mapInArrow(_shared, "a long, b long, extra long, both long").groupBy("a", "b").agg(F.sum("extra").alias("extra"), F.sum("both").alias("both"))
    counts = staged(weighed.groupBy("lang", "id", "p", "p0").agg(F.count("*").alias("m")), "counts")
    other = groups.where("kept > 0").select("lang", F.col("id").alias("other"), F.col("p0").alias("other_p0"))
    met = counts.join(other, "lang").where("id != other")
    alone = met.select(F.col("id").alias("a"), F.col("other").alias("b"), (F.col("m") * gap(F.col("p"), F.col("other_p0"))).alias("v")).unionByName(met.select(F.col("other").alias("a"), F.col("id").alias("b"), (F.col("m") * gap(F.col("other_p0"), F.col("p"))).alias("v")))
    alone = alone.groupBy("a", "b").agg(F.sum("v").alias("alone"))
    left, right = (groups.select("lang", F.col("source").alias(s), F.col("id").alias(i), F.col("own").alias(f"own_{i}"), F.col("p0").alias(f"p0_{i}"), *extra) for s, i, extra in (("source", "a", ["kept"]), ("item", "b", [])))
    pair = left.join(right, "lang").where("a != b").join(alone, ["a", "b"], "left").join(shared, ["a", "b"], "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    neither = F.col("kept") - F.col("own_a") - F.col("own_b") + none("both")
    value = F.when(F.col("kept") > 0, none("alone") + none("extra") + neither * gap(F.col("p0_a"), F.col("p0_b"))).otherwise(0)
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value")).withColumn("rank", F.row_number().over(best))
    return pair.unionByName(over)
