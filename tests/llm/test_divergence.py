"""The audit against plain exact arithmetic, with slices of a few terms and keys dealt out."""

import random
import re
from collections import Counter

import pytest

from attest.llm import divergence

SCHEMA = "lang string, source string, text string, item string, term string, n long, id long"


def plain(rows, least=3, top=200):
    found = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text, *_ in rows]
    out = set()
    for lang in {x[0] for x in found}:
        own = [x for x in found if x[0] == lang]
        df = Counter(t for x in own for t in set(x[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter(t for x in own if x[1] == s for t in x[2] if t in kept) for s in {x[1] for x in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        f = lambda x, y: (x - y) ** 2 // y
        for s in counts:
            pair = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(f(p[s][t], q[t]), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, made in (("pair", pair), ("term", term)):
                for rank, (value, item) in enumerate(sorted(made, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item, value, rank))
    return out


def made(n=400):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéßЖ😀") for _ in range(rng.randint(1, 5))) for _ in range(160)] + ["a", "b", "ab", "The"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "z", None, "s1"]), rng.choice([" ", "-", "1", "\n", "_"]).join([rng.choice(words) for _ in range(rng.randint(0, 40))] + ["the"] * rng.randint(0, 60))) for _ in range(n)]
    rows += [("en", "alone", None), ("xx", "few", "one two"), ("xx", "none", ""), ("yy", "only", "same same"), *[("yy", "only", "same")] * 3, ("en", "s1", "the " * 9000)]
    return [(*r, "i", "t", 1, 2) for r in rows]


@pytest.mark.parametrize("size", [divergence.SLICE, 8])
def test_audit(spark, monkeypatch, size):
    monkeypatch.setattr(divergence, "SLICE", size)
    rows = made()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = divergence.audit(docs, top=30)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, top=30)


def test_empty_and_repeated(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("en", "a", "x y", "i", "t", 1, 2)] * 4 + [("en", "b", "y z", "i", "t", 1, 2)] * 2
    assert {tuple(r) for r in divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect()} == plain(rows)


def test_pairs_in_small_pieces(monkeypatch):
    """Batches that cut terms, few pairs at once, and sums passed on early give the same sums."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = [(f"t{t:03d}", g, rng.randint(1, 10**9), 7 + g) for t in range(60) for g in rng.sample(range(9), rng.randint(1, 9))]
    want: dict = {}
    f = lambda x, y: (x - y) ** 2 // y
    for i, (t, a, p, p0) in enumerate(rows):
        for j, (u, b, r, r0) in enumerate(rows):
            if i != j and t == u:
                e, n = want.get((a, b), (0, 0))
                want[a, b] = e + f(p, r) - f(p, r0) - f(p0, r), n + 1
    monkeypatch.setattr(divergence, "PAIRS", 11)
    monkeypatch.setattr(divergence, "HELD", 3)
    table = pa.table(dict(zip(("term", "id", "p", "p0"), map(list, zip(*rows)))))
    got: dict = {}
    for batch in divergence._shared(iter(table.to_batches(max_chunksize=4))):
        for r in batch.to_pylist():
            e, n = got.get((r["a"], r["b"]), (0, 0))
            got[r["a"], r["b"]] = e + r["extra"], n + r["both"]
    assert got == want
