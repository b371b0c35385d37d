"""A training corpus from documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. Stages keep the columns of documents, but for the last.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attest.llm import mixing, ngram_join, quality, spm, suffix_dedup
from attest.llm.common import new_path
from attest.llm.queries import WEIGHTS, table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of at least 0.3).

    The model learns from the labelled documents outside the held-out fold.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group that 5-word shingle similarity of 0.8 or more connects.

    First is the least doc_id, nulls last, then the least hash of the text. Rows that repeat a
    doc_id (or have none) and a text are one document, of which one row stays. Rows without words
    are in no group and stay.
    """
    id = F.col("doc.doc_id").cast("long")
    row = docs.select(F.struct(*docs.columns).alias("doc")).withColumn("hash", F.xxhash64(F.isnull("doc.text"), "doc.text"))
    row = row.withColumn("key", F.xxhash64(F.isnull(id), id, "hash"))
    found = ngram_join.near_components(row.select(F.col("key").alias("doc_id"), "doc.text"), 5, "0.8").where("n_shingles > 0").select(F.col("doc_id").alias("of"), "component_id").distinct()
    named = row.select("key", id.alias("id"), "hash").distinct().join(found, F.col("key") == F.col("of"), "left")
    # components are named by a key, so one without words is named by its own
    kept = named.groupBy(F.col("component_id").isNull().alias("alone"), F.coalesce("component_id", "key").alias("group")).agg(F.min(F.struct(F.isnull("id").alias("none"), "id", "hash", "key")).alias("first"))
    left = row.join(kept.select("first.key"), "key", "left_semi")
    return left.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("hash"))).where("n = 1").select("doc.*")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes or more that occur more than once."""
    return suffix_dedup.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come up to three times."""
    return mixing.mixed(docs, WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text."""
    return spm.pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", one_of_each),
    ("suffix-array dedup", without_repeats),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: A fitted classifier and a tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = new_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
