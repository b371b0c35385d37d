"""Mixing of sources to target weights by systematic sampling."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, staged

#: Expected copies are integers in units of one over this, so prefix sums are exact in any order.
UNIT = 1 << 24
#: Random offsets that are drawn for each source.
OFFSETS = 16
#: A word: a run of bytes other than blank and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(seed: int, text: Column) -> Column:
    """60 bits of a seeded digest."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(text, F.lit("")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float = 3.0) -> DataFrame:
    """Target words of each source.

    sizes has one row per source: source, source_size. Sources by code point, null last, take the
    weights in turn and share the sum of all sizes. A target stops at `most` times its source's
    size, and the excess goes to the others by weight, until none is above. That is the level
    at which min(cap, weight * level) adds up: sources are capped in order of cap / weight. There
    is one row per source, so the windows without a key are over the source dimension alone.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    held = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    held = (
        held.withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left"))
        .withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    )
    held = held.withColumn("n", F.row_number().over(order))
    level = F.min_by("level", F.when(~F.col("full"), F.col("n"))).over(every)
    return held.select("source", "source_size", F.when(level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * level)).alias("target"))


def sampled_copies(docs: DataFrame, weights: list[float], most: float = 3.0, seed: int = 17) -> DataFrame:
    """How often a mix takes each document, and how many words that makes.

    A document of a source is expected target / source_size times, at most `most` times. Within a
    source, documents are in order of size, then of a seeded digest of doc_id; one random offset
    per source, of OFFSETS seeded draws the one that comes nearest the target, is added to the running sum of expected copies, and a document is taken once for every
    whole number that the sum crosses. As neighbours are of like size, the words taken come near
    the target.

    No task gets a whole source: rows are range-partitioned by (source, size, digest), so that a
    hot source, and a hot size in it, is split; each range adds up its own rows, and only one row
    per range and source is summed over ranges. Null texts have size 0; documents of sources of
    size 0 are never taken; repeated rows count each; columns but doc_id, text and source are
    ignored. Returns doc_id, row_key (tells rows of one doc_id apart), source, size, source_size,
    target, copies, taken.
    """
    spark = docs.sparkSession
    row_key = F.xxhash64("text")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"), row_key.alias("row_key"))
    order = ["source", "size", "mixed", "doc_id", "row_key"]
    # words are counted once, not again for the bounds of the ranges
    base = staged(base.withColumn("mixed", _digest(seed, F.col("doc_id").cast("string"))), "counts")
    base = staged(base.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()), "sizes").withColumn("range", F.shiftright("seq", 33))
    sums = base.groupBy("range", "source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    aim = targets(sums.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0.0).cast("long")
    firsts = F.array(*[_digest(seed + i, F.col("source")) % UNIT for i in range(OFFSETS)])
    aim = aim.withColumn("rate", rate).withColumn("firsts", firsts)
    aim = aim.withColumnRenamed("source", "of")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("rate") * F.coalesce(F.sum("n").over(earlier), F.lit(0))
    ranges = sums.join(aim, F.col("source").eqNullSafe(F.col("of"))).select(F.col("range").alias("of_range"), "of", "source_size", "target", "rate", "firsts", before.alias("before"))
    summed = base.join(ranges, (F.col("range") == F.col("of_range")) & F.col("source").eqNullSafe(F.col("of")))
    within = Window.partitionBy("range", "source").orderBy("seq")
    summed = summed.withColumn("till", F.col("before") + F.col("rate") * F.row_number().over(within))

    def copies(first: Column) -> Column:
        till = F.col("till") + first
        return F.shiftright(till, UNIT.bit_length() - 1) - F.shiftright(till - F.col("rate"), UNIT.bit_length() - 1)

    tried = summed.groupBy("source").agg(F.any_value("firsts").alias("firsts"), F.any_value("target").alias("target"), F.array(*[F.sum(F.col("size") * copies(F.col("firsts")[i])) for i in range(OFFSETS)]).alias("takes"))
    nearest = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(OFFSETS - 1)), lambda i: F.struct(F.abs(F.get("takes", i) - F.col("target")), i.alias("i"))))["i"]
    tried = tried.select(F.col("source").alias("of_source"), F.get("firsts", nearest).alias("first"))
    summed = summed.join(tried, F.col("source").eqNullSafe(F.col("of_source")))
    return summed.select("doc_id", "row_key", "source", "size", "source_size", "target", copies(F.col("first")).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, weights: list[float], most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all its columns.

    Rows that agree in doc_id, text and source share their copies evenly.
    """
    taken = sampled_copies(docs, weights, most, seed).where("copies > 0").groupBy("doc_id", "row_key", "source").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    row = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("key"), F.col("source").alias("of"))
    held = row.join(taken, row["id"].eqNullSafe(taken["doc_id"]) & (row["key"] == taken["row_key"]) & row["of"].eqNullSafe(taken["source"])).select("doc", "id", "key", "of", "copies", "rows")
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("id", "key", "of").orderBy(F.lit(0))))
    held = held.withColumn("share", F.expr("int(copies div rows) + if(place <= copies % rows, 1, 0)")).where("share > 0")
    return held.select("doc", F.explode(F.sequence(F.lit(1), F.col("share")))).select("doc.*")
