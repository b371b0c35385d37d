"""Retrieval by BM25 over a durable index, optionally blended with dense vectors.

The index is a folder of segments. A segment has its chunks with their tokens, and their postings
in blocks of up to BLOCK, the most telling ones of a term first; a block knows its greatest term
frequency and its least length, so that what it is worth at most can be told whatever the corpus
grows to. A search reads blocks of asked terms only, takes a bound from the first blocks, and
leaves out blocks that cannot bring a chunk above it.
"""

import uuid
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..ship import ship
from ..staging import Stage, delete, exists, shared_dir

#: Scores are rounded to so many places before they are ranked, so that the order in which a
#: distributed sum adds up cannot swap ties.
PLACES = 9
#: What bounds give way, as scores are rounded.
SLACK = 1e-6
#: Postings of a block, and chunks of a part of a segment: no term has more postings in one place.
BLOCK, PART = 128, 1 << 16
#: Postings that are packed into one row.
PACKET = 1 << 20
#: Terms of all questions of a group, and terms below which questions read only blocks that may matter to them.
ASKED_TERMS, FEW_TERMS = 1 << 19, 1 << 13
#: Vectors that are compared with each other at once, of questions and of chunks.
ASKED, KNOWN = 1 << 10, 1 << 12

_MANIFEST = "segment string, chunks long, tokens long, buckets int"
_CHUNKS = "chunk_id string, doc_id string, text string, start int, end int, metadata map<string,string>, tokens array<string>, segment string"
_BLOCKS = "term string, part int, block int, n long, most int, least int, postings array<struct<chunk_id:string,tf:int,len:int>>, segment string, bucket int"


# ---- the index -------------------------------------------------------------------------------


@dataclass
class Index:
    """Chunks, and blocks of postings by term, in a folder."""

    spark: SparkSession
    path: str
    k1: float = 1.5
    b: float = 0.75
    temporary: bool = False
    segments: list[str] = field(default_factory=list)
    size: int = 0
    tokens: int = 0
    buckets: int = 0

    def load(self) -> "Index":
        """Reads the manifest: a row for each segment, whatever its size."""
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest").orderBy("segment").collect() if exists(self.spark, f"{self.path}/manifest") else []
        self.segments, self.size, self.tokens = [r["segment"] for r in rows], sum(r["chunks"] for r in rows), sum(r["tokens"] for r in rows)
        self.buckets = rows[0]["buckets"] if rows else 0
        return self

    @property
    def average(self) -> float:
        return self.tokens / self.size if self.tokens else 1.0

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[f"{at}/segment={s}" for s in self.segments])

    @property
    def chunks(self) -> DataFrame:
        """chunk_id, doc_id, text, start, end, metadata and tokens."""
        return self._read("chunks", _CHUNKS).drop("segment")

    @property
    def blocks(self) -> DataFrame:
        """bucket, term, segment, part, block, n, most, least and postings (chunk_id, tf, len)."""
        return self._read("blocks", _BLOCKS)

    def terms(self) -> DataFrame:
        """term, df and idf of all terms."""
        found = self.blocks.groupBy("term").agg(F.sum("n").alias("df"))
        return found.select("term", "df", self.idf(F.col("df")).alias("idf"))

    def idf(self, df: Column) -> Column:
        return F.greatest(F.log(1 + (F.lit(float(self.size)) - df + 0.5) / (df + 0.5)), F.lit(1e-6))

    def worth(self, idf: Column, tf: Column, length: Column) -> Column:
        """What a posting is worth to a question that has its term once."""
        return idf * (tf * (self.k1 + 1)) / (tf + self.k1 * (1 - self.b + self.b * length / F.lit(self.average)))

    def extend(self, chunks: DataFrame) -> "Index":
        """Adds a segment of new chunks (chunk_id, doc_id, text, start, end, metadata).

        Frequencies, lengths and numbers of chunks add up, so the index is as if it had been built
        of all chunks at once. The segment counts when its row of the manifest is written, which is
        last: one whose writing fails is never seen. Raises where chunk_ids are in the index
        already.
        """
        spark, segment = self.spark, "s" + uuid.uuid4().hex
        at = [f"{self.path}/{name}/segment={segment}" for name in ("chunks", "blocks")]
        own = chunks.select("chunk_id", "doc_id", "text", "start", "end", "metadata", tokenize(F.col("text")).alias("tokens"))
        own.write.option("compression", "zstd").parquet(at[0])
        own = spark.read.schema(own.schema).parquet(at[0])
        row = own.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
        # folders that terms are dealt to: few for a small knowledge base, whatever comes later
        buckets = self.buckets or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(8, row["tokens"] // 100_000))
        try:
            if self.segments and not own.select("chunk_id").join(self.chunks.select("chunk_id"), "chunk_id", "left_semi").isEmpty():
                raise ValueError("the index has some of these chunks already")
            # for the order only: bounds are told anew from the whole index
            average = row["tokens"] / row["n"] if row["tokens"] else 1.0
            parts = max(1, -(-row["n"] // PART))
            said = own.select(F.explode("tokens").alias("term"), "chunk_id", F.size("tokens").alias("len"), F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("part"))
            # all further grouping is by term within a part, so this is the one shuffle
            said = said.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket", "part")
            counts = said.groupBy("bucket", "part", "term", "chunk_id").agg(F.count("*").cast("int").alias("tf"), F.first("len").alias("len"))
            impact = F.col("tf") / (F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("len") / F.lit(average)))
            order = Window.partitionBy("bucket", "part", "term").orderBy(impact.desc(), "chunk_id")
            placed = counts.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK).cast("int"))
            made = placed.groupBy("bucket", "part", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("len").alias("least"), F.collect_list(F.struct("chunk_id", "tf", "len")).alias("postings"))
            made = made.select("term", "part", "block", "n", "most", "least", "postings", "bucket")
            made.sortWithinPartitions("bucket", "term", "block").write.option("compression", "zstd").partitionBy("bucket").parquet(at[1])
        except Exception:
            for path in at:
                delete(spark, path)
            raise
        spark.createDataFrame([(segment, row["n"], row["tokens"], buckets)], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self.load()

    def close(self) -> None:
        """Deletes an index that was built without a path."""
        if self.temporary:
            delete(self.spark, self.path)


def build_index(chunks: DataFrame, path: str | None = None, k1: float = 1.5, b: float = 0.75) -> Index:
    """An index of chunks at a path that has none yet, or in the shared folder until it is closed.

    Statistics are over all chunks, those without tokens included.
    """
    spark = chunks.sparkSession
    index = Index(spark, path.rstrip("/") if path else f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", k1, b, path is None).load()
    if index.segments:
        raise ValueError(f"{path} has an index; load it, or extend it")
    return index.extend(chunks)


def load_index(spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75) -> Index:
    index = Index(spark, path.rstrip("/"), k1, b).load()
    if not index.segments:
        raise ValueError(f"no index at {path}")
    return index


# ---- lexical search ----------------------------------------------------------------------------


def question_terms(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("question_id", "term").agg(F.count("*").alias("qtf"))


def _packed(cells: list[str], average: float, k1: float, b: float):
    """Blocks (segment, part, term, postings) to what their postings are worth but for rarity, many blocks of a cell in one row."""

    def row(cell: tuple[str, int], held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held)
        postings = own["postings"].combine_chunks()
        n = np.diff(postings.offsets.to_numpy())
        chunk, tf, length = postings.flatten().flatten()
        tf, length = (x.to_numpy().astype(np.float64) for x in (tf, length))
        worth = (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / average))
        chunk = chunk.dictionary_encode()
        terms = pa.table({"term": own["term"].combine_chunks(), "n": pa.array(n.astype("<i4"))})
        found = pa.table({"chunk": chunk.indices.cast(pa.int32()), "worth": pa.array(worth)})
        data = [_pressed(x) for x in (terms, pa.table({"chunk_id": chunk.dictionary}), found)]
        return pa.RecordBatch.from_arrays([pa.array([cells.index(f"{cell[0]}/{cell[1]}")], pa.int32()), *(pa.array([x], pa.binary()) for x in data)], ["cell", "terms", "chunks", "found"])

    def each(batches):
        held: dict = {}
        size: dict = {}
        for batch in batches:
            at = np.array(batch.column("part"))
            segment = batch.column("segment").dictionary_encode()
            names, of = segment.dictionary.to_pylist(), segment.indices.to_numpy()
            for i, part in np.unique(np.stack([of, at]), axis=1).T.tolist():
                own = batch.filter(pa.array((of == i) & (at == part)))
                cell = names[i], part
                held.setdefault(cell, []).append(own)
                size[cell] = size.get(cell, 0) + len(own.column("postings").flatten())
                if size[cell] >= PACKET:
                    yield row(cell, held.pop(cell))
                    del size[cell]
        for cell, own in held.items():
            yield row(cell, own)

    return each


def _pressed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _opened(data: pa.Array) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _packed_questions(batches):
    """Questions (asked, question_id, terms) to packed rows of one group each."""
    for batch in batches:
        group = batch.column(0).to_numpy()
        for g in np.unique(group):
            own = batch.filter(pa.array(group == g))
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([_pressed(pa.Table.from_batches([own.select([1, 2])]))], pa.binary())], ["asked", "questions"])


def best_of_cell(known: pa.Table, asked: pa.Table, top_k: int) -> pa.Table:
    """(question_id, chunk_id, score) of each question's top_k among the chunks of a cell.

    A question's terms add up in one array over the chunks. At least top_k chunks reach what the
    top_k-th posting of any one of its terms is worth, so only chunks that do are ranked: by
    score, rounded to PLACES, then by chunk_id.
    """
    none = pa.table({"question_id": pa.array([], pa.string()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})
    if not len(known) or not len(asked):
        return none
    parts = [[_opened(x) for x in known[c].combine_chunks()] for c in ("terms", "chunks", "found")]
    terms = pa.concat_arrays([x["term"].combine_chunks() for x in parts[0]]).dictionary_encode()
    n = np.concatenate([x["n"].to_numpy() for x in parts[0]])
    chunks = pa.concat_arrays([x["chunk_id"].combine_chunks() for x in parts[1]]).dictionary_encode()
    names = np.array(chunks.dictionary.to_pylist(), object)
    order = np.argsort(names, kind="stable")
    place = np.empty(len(names), np.int32)
    place[order] = np.arange(len(names), dtype=np.int32)
    names, of = names[order], place[chunks.indices.to_numpy()]
    starts = np.cumsum([0] + [len(x) for x in parts[1]])
    chunk = np.concatenate([of[x["chunk"].to_numpy() + s] for x, s in zip(parts[2], starts, strict=False)])
    worth = np.concatenate([x["worth"].to_numpy() for x in parts[2]])
    term = np.repeat(terms.indices.to_numpy(), n)
    order = np.lexsort((-worth, term))
    chunk, worth = chunk[order], worth[order]
    ends = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms.dictionary)))])
    many = np.diff(ends) >= top_k
    least = np.where(many, worth[np.minimum(ends[:-1] + top_k - 1, len(worth) - 1)], 0.0)

    ids, found, scores = [], [], []
    total = np.zeros(len(names))
    for data in asked["questions"].combine_chunks():
        own = _opened(data)
        held = own["terms"].combine_chunks()
        word, weight = held.flatten().flatten()
        number = pc.fill_null(pc.index_in(word, value_set=terms.dictionary), -1).to_numpy()
        weight, edges = weight.to_numpy(), held.offsets.to_numpy() - held.offsets[0].as_py()
        for who, a, b in zip(own["question_id"].to_pylist(), edges[:-1], edges[1:], strict=True):
            bound, touched = 0.0, []
            for t, f in zip(number[a:b].tolist(), weight[a:b].tolist(), strict=True):
                if t < 0:
                    continue
                at = chunk[ends[t] : ends[t + 1]]
                total[at] += f * worth[ends[t] : ends[t + 1]]
                touched.append(at)
                bound = max(bound, f * least[t])
            if not touched:
                continue
            touched = np.concatenate(touched)
            able = np.unique(touched[total[touched] >= bound - SLACK])
            score = np.round(total[able], PLACES)
            # places rise with names, and the sort is stable
            first = np.argsort(-score, kind="stable")[:top_k]
            ids += [who] * len(first)
            found.append(able[first])
            scores.append(score[first])
            total[touched] = 0.0
    if not ids:
        return none
    return pa.table({"question_id": pa.array(ids, pa.string()), "chunk_id": pa.array(names[np.concatenate(found)], pa.string()), "score": pa.array(np.concatenate(scores))})


class Asked:
    """Questions against an index: their terms, and the headers of these terms' blocks."""

    def __init__(self, index: Index, questions: DataFrame, stage: Stage):
        self.index, self.stage = index, stage
        self.own = stage.table(question_terms(questions).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(max(index.buckets, 1))).cast("int")), "asked")

    @cached_property
    def heads(self) -> DataFrame:
        """bucket, term, segment, part, block, idf and bound of the blocks of asked terms."""
        heads = self.index.blocks.select("bucket", "term", "segment", "part", "block", "n", "most", "least")
        heads = self.stage.table(heads.join(self.own.select("bucket", "term").distinct(), ["bucket", "term"]), "heads")
        frequency = heads.groupBy("bucket", "term").agg(self.index.idf(F.sum("n")).alias("idf"))
        heads = heads.join(frequency, ["bucket", "term"]).withColumn("bound", self.index.worth(F.col("idf"), F.col("most"), F.col("least")))
        return self.stage.table(heads.drop("n", "most", "least"), "heads")

    @cached_property
    def terms(self) -> DataFrame:
        """question_id, bucket, term, qtf, top (what the term brings at most), all (what all terms bring at most), upto (what it and lesser ones bring)."""
        best = self.heads.groupBy("bucket", "term").agg(F.max("bound").alias("top"))
        row = self.own.join(best, ["bucket", "term"]).withColumn("top", F.col("qtf") * F.col("top"))
        rising = Window.partitionBy("question_id").orderBy("top", "term")
        row = row.withColumns({"all": F.sum("top").over(Window.partitionBy("question_id")), "upto": F.sum("top").over(rising)})
        return self.stage.table(row, "terms")

    def best(self, top_k: int) -> DataFrame:
        """question_id, chunk_id and whole score of the top_k chunks of each question, ties by chunk_id.

        Postings meet the questions in cells, a part of a segment each, and every cell gives its
        own top_k: no row is made for a question and a chunk. Questions travel to each cell, and
        postings once for each group of questions. All blocks are read, as so many questions have
        most of the terms.
        """
        index = self.index
        ship(index.spark)
        key, n = ["bucket", "term"], self.own.count()
        cells = sorted(f"{r['segment']}/{r['part']}" for r in index.blocks.select("segment", "part").distinct().collect())
        groups = max(1, -(-n // ASKED_TERMS))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)))
        frequency = index.blocks.groupBy(*key).agg(index.idf(F.sum("n")).alias("idf"))
        known = index.blocks.select("segment", "part", "term", "postings").mapInArrow(_packed(cells, index.average, index.k1, index.b), "cell int, terms binary, chunks binary, found binary")
        known = known.select("*", every(groups).alias("asked"))
        asked = self.own.join(frequency, key).groupBy("question_id").agg(F.collect_list(F.struct("term", (F.col("qtf") * F.col("idf")).alias("weight"))).alias("terms"))
        asked = asked.select(F.pmod(F.xxhash64("question_id"), F.lit(groups)).cast("int").alias("asked"), "question_id", "terms")
        asked = asked.mapInArrow(_packed_questions, "asked int, questions binary").select("*", every(len(cells)).alias("cell"))
        near = known.groupBy("cell", "asked").cogroup(asked.groupBy("cell", "asked")).applyInArrow(lambda a, b: best_of_cell(a, b, top_k), "question_id string, chunk_id string, score double")
        rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id"))
        return near.withColumn("rank", rank).where(F.col("rank") <= top_k)

    def hits(self, wanted: DataFrame) -> DataFrame:
        """question_id, chunk_id and worth of all postings in wanted blocks.

        wanted has question_id, qtf, idf, bucket, term, segment, part and block.
        """
        key = ["bucket", "term", "segment", "part", "block"]
        held = self.index.blocks.select(*key, "postings").join(wanted, key)
        one = held.select("question_id", "qtf", "idf", F.explode("postings").alias("p"))
        return one.select("question_id", "p.chunk_id", (F.col("qtf") * self.index.worth(F.col("idf"), F.col("p.tf"), F.col("p.len"))).alias("worth"))

    def bound(self, top_k: int) -> DataFrame:
        """question_id and a score that its top_k-th chunk has at least, from each term's first blocks."""
        first = self.terms.select("question_id", "bucket", "term", "qtf").join(self.heads.where("block = 0"), ["bucket", "term"]).drop("bound")
        sums = self.hits(first).groupBy("question_id", "chunk_id").agg(F.sum("worth").alias("worth"))
        place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("worth"), "chunk_id"))
        last = sums.withColumn("place", place).where(F.col("place") <= top_k).groupBy("question_id").agg(F.max("place").alias("places"), F.min("worth").alias("bound"))
        return self.stage.table(last.where(F.col("places") == top_k).select("question_id", "bound"), "bounds")

    def above(self, bounds: DataFrame) -> DataFrame:
        """question_id, chunk_id and whole score of all chunks that may reach their question's bound.

        bounds has question_id and bound; questions without one get all chunks that share a term. Lesser
        terms that together stay below the bound bring no chunk of their own: they are looked up
        for the chunks that the others brought. Of the others, blocks are left out that cannot
        reach the bound with all a question's other terms.
        """
        row = self.terms.join(bounds, "question_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK).withColumnRenamed("bound", "least")
        lesser = F.col("upto") < F.col("least")
        rest = row.groupBy("question_id").agg(F.first("least").alias("least"), F.coalesce(F.sum(F.when(lesser, F.col("top"))), F.lit(0.0)).alias("rest"))
        wanted = row.where(~lesser).join(self.heads, ["bucket", "term"]).where(F.col("qtf") * F.col("bound") + F.col("all") - F.col("top") >= F.col("least"))
        wanted = wanted.select("question_id", "qtf", "idf", "bucket", "term", "segment", "part", "block")
        sums = self.hits(wanted).groupBy("question_id", "chunk_id").agg(F.sum("worth").alias("worth"))
        able = sums.join(rest, "question_id").where(F.col("worth") + F.col("rest") >= F.col("least")).select("question_id", "chunk_id", "worth")
        able = self.stage.table(able, "able")
        others = row.where(lesser).join(self.heads.drop("bound"), ["bucket", "term"]).select("question_id", "qtf", "idf", "bucket", "term", "segment", "part", "block")
        more = self.hits(others).join(able.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "left_semi")
        return able.unionByName(more).groupBy("question_id", "chunk_id").agg(F.round(F.sum("worth"), PLACES).alias("score"))


def lexical_scores(index: Index, questions: DataFrame, stage: Stage) -> DataFrame:
    """question_id, chunk_id and score of every pair that shares a term."""
    none = index.spark.createDataFrame([], "question_id string, bound double")
    return Asked(index, questions, stage).above(none)


# ---- dense search ------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for unequal lengths, empty arrays and zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def units(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as rows of length 1; zero and null vectors stay zero."""
    made = np.array(column.to_pylist(), np.float64).reshape(-1, width)
    size = np.sqrt((made * made).sum(1, keepdims=True))
    return np.divide(made, size, out=np.zeros_like(made), where=size > 0)


def best_of_block(asked: pa.Table, known: pa.Table, top_k: int, places: int) -> pa.Table:
    """(question_id, chunk_id, score) of each question's top_k among the chunks of a block.

    Scores are cosines rounded to places; equal ones go by chunk_id.
    """
    names = np.array(known["chunk_id"].to_pylist(), object)
    order = np.argsort(names, kind="stable")
    known, names = known.take(pa.array(order)), names[order]
    widths = lambda t: np.array([-1 if v is None else len(v) for v in t["vector"].to_pylist()])
    of_asked, of_known = widths(asked), widths(known)
    ids, found, scores = [], [], []
    for width in np.unique(of_asked):
        own, same = np.flatnonzero(of_asked == width), np.flatnonzero(of_known == width)
        dense = np.zeros((len(own), len(names)))
        if width > 0 and len(same):
            dense[:, same] = units(asked["vector"].take(pa.array(own)), width) @ units(known["vector"].take(pa.array(same)), width).T
        dense = np.round(dense, places) + 0.0
        # names rise, so a stable sort leaves the least first among equals
        best = np.argsort(-dense, axis=1, kind="stable")[:, :top_k]
        ids += [x for i in own for x in [asked["question_id"][int(i)].as_py()] * best.shape[1]]
        found += names[best].ravel().tolist()
        scores.append(np.take_along_axis(dense, best, 1).ravel())
    return pa.table({"question_id": pa.array(ids, pa.string()), "chunk_id": pa.array(found, pa.string()), "score": pa.array(np.concatenate(scores) if scores else [], pa.float64())})


def dense_search(chunk_vectors: DataFrame, question_vectors: DataFrame, top_k: int, places: int = PLACES) -> DataFrame:
    """question_id, chunk_id, score and rank of the top_k nearest vectors of each question.

    Vectors meet in blocks of up to about KNOWN chunks and ASKED questions, as products of
    matrices, and a block gives its own top_k for each question: no row is made for a question and
    a chunk. Questions travel to each block of chunks, and chunks once for each block of questions.
    """
    ship(chunk_vectors.sparkSession)
    # both may come from one table, so their columns are named anew
    own = lambda df, key: df.select(F.col(key).cast("string").alias(key), F.col("vector").alias("vector")).where(F.col(key).isNotNull())
    asked, known = own(question_vectors, "question_id"), own(chunk_vectors, "chunk_id")
    rows, columns = (max(1, -(-df.count() // n)) for df, n in ((asked, ASKED), (known, KNOWN)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = asked.select("question_id", "vector", part("question_id", rows).alias("i"), every(columns).alias("j"))
    known = known.select("chunk_id", "vector", every(rows).alias("i"), part("chunk_id", columns).alias("j"))
    near = asked.groupBy("i", "j").cogroup(known.groupBy("i", "j")).applyInArrow(lambda a, b: best_of_block(a, b, top_k, places), "question_id string, chunk_id string, score double")
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


# ---- both --------------------------------------------------------------------------------------


def search(index: Index, questions: DataFrame, top_k: int = 5, dense_weight: float = 0.0, chunk_vectors: DataFrame | None = None, question_vectors: DataFrame | None = None, stage: Stage | None = None) -> DataFrame:
    """question_id, rank, chunk_id and score of the top_k chunks of each question.

    Scores are divided by the question's best. With vectors (chunk_id, vector) and (question_id,
    vector), the score is (1 - w) * lexical + w * max(cosine, 0). Ties go by chunk_id as a string;
    chunks with no score are left out after the cut. What is staged goes to `stage`, whose owner
    closes it.

    With vectors, the top_k by either score alone give a bound; only chunks whose lexical score
    and the question's best cosine together reach it are looked at further.
    """
    if not 0.0 <= dense_weight <= 1.0:
        raise ValueError("dense_weight must be between 0 and 1")
    stage = stage or Stage(index.spark)
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "chunk_id")
    asked = Asked(index, questions, stage)
    if asked.own.count() < FEW_TERMS:
        ranked = asked.above(asked.bound(top_k)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
    else:
        ranked = asked.best(top_k)
    peak = F.max("score").over(Window.partitionBy("question_id"))
    share = F.when(F.col("peak") > 0, F.col("score") / F.col("peak")).otherwise(0.0)
    ranked = ranked.withColumn("peak", peak)
    if chunk_vectors is None or question_vectors is None or dense_weight == 0.0:
        return ranked.select("question_id", "rank", "chunk_id", share.alias("score")).where("score > 0")
    w = dense_weight
    ranked = stage.table(ranked.withColumn("lexical", share), "ranked")
    near = stage.table(dense_search(chunk_vectors, question_vectors, top_k).withColumn("score", F.greatest("score", F.lit(0.0))), "near")
    last = lambda c: F.coalesce(F.min(F.when(F.col("rank") == top_k, F.col(c))), F.lit(0.0))
    dense = near.groupBy("question_id").agg(F.max("score").alias("nearest"), (w * last("score")).alias("least_dense"))
    words = ranked.groupBy("question_id").agg(F.max("peak").alias("peak"), ((1 - w) * last("lexical")).alias("least_words"))
    least = F.greatest(F.coalesce("least_dense", F.lit(0.0)), "least_words")
    bounds = words.join(dense, "question_id", "left").withColumn("bound", (least - w * F.coalesce("nearest", F.lit(0.0)) - SLACK) / max(1 - w, 1e-12) * F.col("peak"))
    bounds = stage.table(bounds, "bounds")
    able = asked.above(bounds.select("question_id", F.greatest("bound", F.lit(0.0)).alias("bound")))
    lexical = able.join(bounds.select("question_id", "peak"), "question_id").select("question_id", "chunk_id", share.alias("lexical"))
    # a near chunk that is missing here, or whose score is not whole, cannot reach the bound unless it shares no term
    both = lexical.join(near.select("question_id", "chunk_id"), ["question_id", "chunk_id"], "full")
    both = both.join(question_vectors.select("question_id", F.col("vector").alias("qv")), "question_id", "left").join(chunk_vectors.select("chunk_id", F.col("vector").alias("cv")), "chunk_id", "left")
    dense = F.greatest(cosine(F.col("qv"), F.col("cv")), F.lit(0.0))
    blend = (1 - w) * F.coalesce("lexical", F.lit(0.0)) + w * F.coalesce(dense, F.lit(0.0))
    both = both.select("question_id", "chunk_id", F.round(blend, PLACES).alias("score"))
    return both.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= top_k) & (F.col("score") > 0)).select("question_id", "rank", "chunk_id", "score")
