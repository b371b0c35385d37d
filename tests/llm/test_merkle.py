"""Manifests against a plain recursion, over nulls, repeated rows, lone leaves and trees of several blocks."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attest.llm import merkle
from attest.llm.queries import document_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return H(*map(field, (doc_id, source, lang, n_chars, text)))


def climb(leaves, fanout):
    """The root, and the siblings (place, others) of every leaf."""
    ways, nodes, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            low = a // fanout * fanout
            run = nodes[low : low + fanout]
            ways[i].append((a - low, run[: a - low] + run[a - low + 1 :]))
            at[i] = a // fanout
        nodes = [H(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], ways


def plain(rows, fanout=8):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0)) for x in langs}
    grown = {x: climb([leaf(*r) for r in own], fanout) for x, own in trees.items()}
    root, tops = climb([grown[x][0] for x in langs], fanout)
    out = Counter()
    for lang, top in zip(langs, tops):
        for r, way in zip(trees[lang], grown[lang][1]):
            steps = way + top
            mine = leaf(*r)
            now = mine
            if zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[0] is not None:
                low = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                now = leaf(r[0], low, *r[2:])
            for place, others in steps:
                now = H(*others[:place], now, *others[place:])
            out[r[0], mine, grown[lang][0], root, H(*(o for _, others in steps for o in others)), now, now == root] += 1
    return out


def made(n):
    rng = random.Random(5)
    texts = [None, "", "ÀÉ Only Not-ASCII", "lower", "Upper ABC", "x" * 5000 + "Q", "5:trick"]
    rows = [(i, rng.choice(texts) if i % 3 else f"Text {i}", rng.choice(["en", "fr", "é", None]) if i % 50 else "one", rng.choice(["s", None, ""]), rng.choice([None, 0, i])) for i in range(n)]
    rows += [(n, "Lone", "zz", "s", 4), (None, "No Key", "yy", None, None)]
    return rows


@pytest.mark.parametrize(("n", "height"), [(700, 4), (700, 1), (150, 2), (0, 4)])
def test_manifest(spark, n, height):
    rows = made(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    found = document_manifest(docs, height)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == plain(rows)


def test_many_trees_and_repeated_rows(spark):
    rows = [(1, "Same", "en", "s", 4)] * 30 + [(i, f"T{i}", f"lang{i % 90}", None, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert Counter(map(tuple, document_manifest(docs, 1).collect())) == plain(rows)


def test_empty_one_row_and_steps(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert document_manifest(docs, 4).count() == 0
    own = spark.createDataFrame([(i, "t", H(str(i))) for i in range(10)], "leaf_id long, k0 string, leaf string")
    found = merkle.manifest(own, "leaf_id", "k0", fanout=3, height=1, paths=True)
    root, ways = climb([H(str(i)) for i in range(10)], 3)
    for r in found.collect():
        assert (r["root"], r["k0"], r["verified"]) == (root, "t", True)
        assert [(s["place"], bytes(s["others"]).decode()) for s in r["steps"]] == [(p, "".join(o)) for p, o in ways[r["leaf_id"]]]
    # a changed leaf does not verify, an unchanged one does
    two = own.withColumn("claim", F.when(F.col("leaf_id") == 4, F.sha2(F.lit("other"), 256)))
    assert {r["leaf_id"]: r["verified"] for r in merkle.manifest(two, "leaf_id", "k0", claimed="claim", fanout=3, height=2).collect()} == {i: i != 4 for i in range(10)}
