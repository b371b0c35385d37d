"""Stages of the pipeline against plain versions, with repeated and null-id rows."""

from collections import Counter
from fractions import Fraction

import corpus_pipeline
from test_operators import SCHEMA, WORD, made, shingles


def plain(rows):
    """Rows that stay, with rows of one group that are equally first left to any of them."""
    sets, group = [shingles(r[1], 5) for r in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a and b and Fraction(len(a & b), len(a | b)) >= Fraction("0.8")) or (not a and not b and rows[i][0] is not None and rows[i][:2] == rows[j][:2]):
                group = [group[j] if g == group[i] else g for g in group]
    found = {}
    for g, r in zip(group, rows, strict=True):
        found.setdefault(g, []).append(r)
    return list(found.values())


def test_one_of_each_and_what_follows(spark):
    long = " ".join(f"only{i}" for i in range(60))
    rest = ("c", "x", "y", "z", "d")
    rows = [*made(), (900, long, "en", "s1", len(long), *rest), (900, long, "en", "s1", len(long), *rest), (None, long + " end", "en", "s1", 0, *rest), (901, "", "en", "s1", 0, *rest), (901, "", "en", "s1", 0, *rest)]
    rows += [(902, " ".join(f"left{i}" for i in range(60)), "en", "s1", 0, *rest), (902, " ".join(f"right{i}" for i in range(60)), "en", "s1", 0, *rest)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.one_of_each(spark, docs, "").persist()
    assert kept.columns == docs.columns
    groups = plain(rows)
    got = Counter(tuple(r) for r in kept.collect())
    assert sum(got.values()) == len(groups)
    for own in groups:
        ids = [r[0] for r in own if r[0] is not None]
        assert sum(got[r] for r in set(own)) >= 1 and any(got[r] for r in own if r[0] == (min(ids) if ids else None))
    # what came twice has no twin any more, so the next stage leaves it whole
    left = Counter(r["doc_id"] for r in corpus_pipeline.without_repeats(spark, kept, "").collect() if r["text"] == long)
    assert left == {900: 1}
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def good(spark, rows, labels):
    """What keep_good leaves of rows, by a table of labels in a folder of its own."""
    import tempfile

    folder = tempfile.mkdtemp(prefix="labels-")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = corpus_pipeline.keep_good(spark, docs, folder)
    assert kept.columns == docs.columns
    return Counter(tuple(r) for r in kept.collect())


def test_keep_good_with_nulls_repeats_and_without_labels(spark):
    rest = ("c", "x", "y", "z", "d")
    rows = [(i, ("calm plain sentence about rivers " * 8) if i % 2 else ("WIN$$ BUY$$ NOW!! " * 9), "en", None, 1, *rest) for i in range(400)]
    odd = [(None, None, None, None, None, *rest), (1, rows[1][1], "en", None, 1, *rest), (None, "calm plain sentence about rivers", "en", "s", 1, *rest)]
    kept = good(spark, rows + odd, [(i, i % 2, 0) for i in range(400)])
    assert all(kept[r] == (2 if r == rows[1] else 1) for r in rows if r[0] % 2) and not any(kept[r] for r in rows if not r[0] % 2)
    assert kept[odd[2]] == 1
    # nothing to learn from: all score 0.5 and stay
    assert sum(good(spark, rows[:10] + odd, []).values()) == 13 and sum(good(spark, [], [(1, 1, 0)]).values()) == 0


def test_mix_emits_whole_copies_near_the_targets(spark):
    docs = spark.createDataFrame(made() * 3, SCHEMA).repartition(4)
    rows, mixed = Counter(tuple(r) for r in docs.collect()), Counter(tuple(r) for r in corpus_pipeline.mix(spark, docs, "").collect())
    assert all(0 < n <= 3 * rows[r] for r, n in mixed.items())
    size = lambda held: Counter({s: sum(len(WORD.findall(r[1] or "")) * n for r, n in held.items() if r[3] == s) for s in {r[3] for r in rows}})
    have, got = size(rows), size(mixed)
    assert sum(got.values()) > 0.8 * sum(have.values())
    assert all(got[s] <= 3 * have[s] for s in have)
    assert corpus_pipeline.mix(spark, docs.limit(0), "").count() == 0


def test_encode_gives_the_ids_of_sentencepiece_for_every_row(spark):
    import sentencepiece
    from attest.llm.queries import vocabulary

    docs = spark.createDataFrame(made(), SCHEMA).repartition(3)
    plain_model = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    want = Counter((r[0], tuple(plain_model.encode(r[1] or ""))) for r in made())
    got = Counter((r["doc_id"], tuple(memoryview(r["ids"]).cast("H"))) for r in corpus_pipeline.encode(spark, docs, "").collect())
    assert got == want
    assert corpus_pipeline.encode(spark, docs.limit(0), "").count() == 0
