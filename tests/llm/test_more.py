"""Models against plain solvers, groups against brute force, threads, repeated keys, planted recordings."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import chroma, quality, spm, substrings
from attest.llm.queries import table, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_hinge_against_a_plain_dual_solver():
    rng = np.random.default_rng(3)
    for n, m in ((30, 12), (60, 40), (25, 200)):
        rows = [np.sort(rng.choice(m, rng.integers(2, min(m, 9)), replace=False)) for _ in range(n)]
        values, labels = rng.normal(0, 1, 1 << quality.BITS), rng.integers(0, 2, n)
        labels[:2] = 0, 1
        w, bias = quality.fit_hinge(rows, values, labels, epochs=4000, tolerance=1e-9)
        x = np.zeros((n, m + 1))
        for i, r in enumerate(rows):
            x[i, r] = values[r] / np.linalg.norm(values[r])
        x[:, m] = 1
        y = np.where(labels > 0, 1.0, -1.0)
        upper = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
        q = (x * y[:, None]) @ (x * y[:, None]).T
        alpha, rate = np.zeros(n), 1 / np.linalg.eigvalsh(q)[-1]
        for _ in range(60_000):  # projected gradient on the whole dual
            alpha = np.clip(alpha + rate * (1 - q @ alpha), 0, upper)
        best = 0.5 * np.sum(((alpha * y) @ x) ** 2) + (upper * np.maximum(0, 1 - y * (x @ ((alpha * y) @ x)))).sum()
        own = np.append(w[:m], bias)
        assert 0.5 * own @ own + (upper * np.maximum(0, 1 - y * (x @ own))).sum() == pytest.approx(best, rel=2e-4)


def test_quality_of_documents_that_were_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    found = quality.scored(docs, quality.fit(docs, labels)).select(F.col("doc.doc_id").alias("doc_id"), "score")
    rows = found.join(labels, "doc_id").where(quality.held_out(F.col("doc_id"))).collect()
    good, bad = (np.array([r["score"] for r in rows if r["quality"] == k]) for k in (1, 0))
    auc = ((good[:, None] > bad).mean() + 0.5 * (good[:, None] == bad).mean()) if len(bad) else 1
    assert len(good) > 20 and len(bad) > 5 and auc > 0.95


def test_very_long_texts_are_scored_whole(spark):
    rows = [(i, ("good plain words here " * 20) if i % 2 else "BUY!! NOW!! " * 20) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i in range(200)], "doc_id long, quality int, toxic int"))
    long = spark.createDataFrame([(900, "good plain words here " * 50_000), (901, "good plain words here " * 10 + "BUY!! NOW!! " * 90_000), (902, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in quality.scored(long, model).select("doc.doc_id", "score").collect()}
    assert got[900] > got[901] + 0.2 and len(got) == 3  # the tail counts


def alike(a, b):
    """Whether any stretch of 50 words or more, at one place in both, has four fifths of its shingles in common."""
    sets = lambda w, s, n: {tuple(w[i : i + 5]) for i in range(s, s + n - 4)}
    for n in range(50, len(a) + 1):
        for s in range(len(a) - n + 1):
            x, y = sets(a, s, n), sets(b, s, n)
            if 5 * len(x & y) >= 4 * len(x | y):
                return True
    return False


def test_groups_of_edited_passages_against_all_pairs(spark):
    """Each group's passages are copies with one word changed; links of all pairs name the classes."""
    rng = random.Random(12)
    some = lambda n: [f"w{rng.randrange(10**6):06}" for _ in range(n)]
    passages, group = [], []
    for g in range(24):
        p = some(60)
        for _ in range(12):
            q = list(p)
            q[rng.randrange(60)] = some(1)[0]
            passages.append(q)
            group.append(g)
    up = list(range(len(passages)))
    for i in range(len(passages)):
        for j in range(i):
            if group[i] == group[j] and alike(passages[i], passages[j]):
                a, b = up[i], up[j]
                up = [min(a, b) if u in (a, b) else u for u in up]
    docs = spark.createDataFrame([(i, " ".join(some(55) + p + some(55))) for i, p in enumerate(passages)], "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in substrings.passages(docs).collect()}
    assert [rows[i]["class_id"] for i in range(len(passages))] == up
    assert len(set(up)) < 2 * 24 < len(up)


def test_chains_of_edited_passages_against_all_pairs(spark):
    """Each passage of a chain is alike to the next one only, while all share cells: no link of a chain may be lost."""
    rng = random.Random(21)
    some = lambda n: [f"w{rng.randrange(10**6):06}" for _ in range(n)]
    passages, want = [], []
    for _ in range(60):
        p, first = some(60), len(passages)
        for place in (None, 15, 20, 25, 30, 35, 40, 45):
            p = list(p)
            if place:
                p[place] = some(1)[0]
            passages.append(p)
            want.append(first)
    docs = spark.createDataFrame([(i, " ".join(some(55) + p + some(55))) for i, p in enumerate(passages)], "doc_id long, text string").repartition(4)
    rows = {r["doc_id"]: r for r in substrings.passages(docs).collect()}
    assert [rows[i]["class_id"] for i in range(len(passages))] == want


def test_threads_change_nothing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, three = (sorted(map(tuple, spm.pieces(docs, vocabulary("piece_bpe_32k.model"), 1, n).collect())) for n in (1, 3))
    assert one == three and all(r[4] and r[5] for r in one)
    held = open(vocabulary("piece_bpe_32k.model"), "rb").read()
    assert spm.codec(held, 1) is spm.codec(held, 1) and spm.codec(held, 2) is not spm.codec(held, 1) and spm.codec(held, 2).threads == 2


def test_repeated_and_null_keys_of_recordings(spark):
    rng = np.random.default_rng(5)
    a, b, c = ([int(v) for v in rng.integers(0, 1 << 32, 30)] for _ in range(3))
    rows = [(50, a), (50, b), (51, b), (52, a), (52, b), (53, b), (None, a), (None, c), (None, []), (54, [])]
    known = chroma.classes(spark.createDataFrame(rows, "id long, prints array<long>"), "id")
    got = {(r["id"], tuple(r["prints"])): (r["class_id"], r["digest"]) for r in known.collect()}
    assert len({got[50, tuple(a)], got[52, tuple(a)], got[None, tuple(a)]}) == 1 and got[50, tuple(a)] != got[50, tuple(b)] == got[51, tuple(b)] == got[53, tuple(b)]
    assert got[None, tuple(c)][0] is None and got[54, ()] == (54, None) and got[None, ()] == (None, None)
    assert chroma.aligned(known, "id").count() == 0  # three unlike classes, two of them with key 50
    near = [*c[:29], c[29] ^ 1]
    more = chroma.classes(spark.createDataFrame([*rows, (100, near)], "id long, prints array<long>"), "id")
    found = chroma.aligned(more, "id").collect()
    assert [(r["query_id"], r["match_id"], r["votes"]) for r in found] == [(100, None, 29)]
    best = chroma.best_alignments(more, "id").collect()
    assert [(r["query_id"], r["n_links"]) for r in best] == [(100, 1)]
    empty = spark.createDataFrame([], "id long, prints array<long>")
    assert chroma.classes(empty, "id").count() == 0 and chroma.aligned(chroma.classes(empty, "id"), "id").count() == 0


def test_planted_recordings_among_melodies(spark):
    """Shifted and noisy copies of melodies align with them; other melodies mostly do not."""
    rng = np.random.default_rng(9)
    prints, planted = [], set()
    for i in range(30):
        samples, _ = chroma.decoded(chroma.rendered(rng.normal(0, 0.1, 40).tolist()))
        prints.append((50 * i, [int(v) for v in chroma.fingerprint(chroma.chroma(samples))]))
        if i % 3 == 0:
            shift = 3 + i % 5
            noisy = (samples + rng.normal(0, 0.03, len(samples)))[chroma.HOP * shift :]
            prints.append((50 * i + 1, [int(v) for v in chroma.fingerprint(chroma.chroma(noisy))]))
            planted.add((50 * i, 50 * i + 1, shift))
    found = chroma.aligned(chroma.classes(spark.createDataFrame(prints, "id long, prints array<long>"), "id"), "id").collect()
    got = {(r["query_id"], r["match_id"], r["offset"]) for r in found}
    assert planted <= got
    others = {(a, b) for a, b, _ in got if b - a != 1 and not (b % 50 == 1 and b - 1 == a)}
    # of 30 x 39 pairs of unlike melodies, 11 in a hundred are alike to a quarter of all bits
    assert len(others) < 0.15 * 30 * 39
