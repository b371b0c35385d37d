from pyspark.sql import functions as F

from attest.llm import ngram_join


def test_passages_of_few_texts_join_no_families_however_many_tokens_there_are(spark, monkeypatch):
    """3 million tokens, each pair of near copies with a passage of the next pair: families stay pairs."""
    word = lambda *of: F.lower(F.substring(F.hex(F.xxhash64(*of)), 1, 9))
    row = spark.range(4000).select("id", F.floor(F.col("id") / 2).alias("pair"), (F.col("id") % 2).alias("copy"))
    passage = lambda p: F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: word(F.lit("passage"), p, i))
    own = F.transform(F.sequence(F.lit(0), F.lit(1459)), lambda i: word(F.col("pair"), i, F.when(i == 700, F.col("copy")).otherwise(0)))
    docs = row.select(F.col("id").alias("doc_id"), F.concat_ws(" ", passage(F.col("pair")), own, passage(F.col("pair") + 1)).alias("text"))
    staged, largest = ngram_join.staged, []

    def seen(df, name):
        out = staged(df, name)
        if name == "families":
            largest.append(out.groupBy("family").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(ngram_join, "staged", seen)
    found = ngram_join.near_components(docs, 4, "0.85").collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i - i % 2 for i in range(4000)}
    assert largest == [2]
