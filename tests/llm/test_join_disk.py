import random

import corpus_pipeline
from pyspark.sql import functions as F

from attest.llm import ngram_join


def test_copies_send_their_tokens_once(spark, monkeypatch):
    """Texts that come again in every packet: what is staged stays below the bytes of the texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    texts = [" ".join(word() for _ in range(400)) for _ in range(30)]
    near = texts[0].split()
    near[200] = "changed"
    texts.append(" ".join(near))
    rows = [(1000 * copy + i, t) for copy in range(24) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(24, "doc_id")
    staged, size = ngram_join.staged, {}

    def counted(df, name):
        out = staged(df, name)
        if name in ("first", "shared", "left"):
            held = [F.coalesce(F.length(c), F.lit(0)) for c, kind in out.dtypes if kind == "binary"]
            size[name] = size.get(name, 0) + (out.agg(F.sum(sum(held, F.lit(0)))).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_components(docs, 4, "0.85").collect()}
    assert found == {i: 0 if i % 1000 == 30 else i % 1000 for i, _ in rows}
    assert sum(size.values()) < sum(len(t) for _, t in rows)


def test_stage_of_the_pipeline_stages_less_than_its_texts(spark, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(300)) for _ in range(8)]
    rows = [(100 * copy + i, t) for copy in range(16) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(16, "doc_id")
    staged, size = ngram_join.staged, []

    def counted(df, name):
        out = staged(df, name)
        held = [F.coalesce(F.length(c), F.lit(0)) for c, kind in out.dtypes if kind == "binary"]
        size.append(out.agg(F.sum(sum(held, F.lit(0)))).first()[0] or 0)
        return out

    monkeypatch.setattr(ngram_join, "staged", counted)
    assert sorted(map(tuple, corpus_pipeline.one_of_each(spark, docs, "").collect())) == list(enumerate(texts))
    assert sum(size) < sum(len(t) for _, t in rows)
