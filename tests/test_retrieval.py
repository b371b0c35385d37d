"""The index against plain BM25: blocks that are left out, increments, loading, blends."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.operators import retrieval
from attest.operators.grounding import with_evidence
from attest.plans.engine import Gate
from attest.sources import readers
from attest.staging import Stage, exists

CHUNK = "chunk_id string, doc_id string, text string, start int, end int, metadata map<string,string>"


def corpus(n, seed=3):
    """Chunks of words of which few are common and many rare; some empty, some alike."""
    rng = random.Random(seed)
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'abcdefghij'[i // 26 % 10]}x" for i in range(200)]
    texts = ["" if i % 41 == 7 else " ".join(words[min(int(rng.paretovariate(0.6)) - 1, 199)] for _ in range(rng.randint(1, 60))) for i in range(n)]
    return [(f"c{seed}-{i}", f"d{i}", texts[i - 1] if i % 29 == 0 else texts[i], 0, len(texts[i]), {"source": "s"}) for i in range(n)]


def plain(rows, questions):
    """Scores of all chunks that share a term, from the tokens that the index has."""
    n, avg = len(rows), sum(len(t) for t in rows.values()) / len(rows)
    df = Counter(t for own in rows.values() for t in set(own))
    out = {}
    for q, terms in questions.items():
        for c, own in rows.items():
            tf = Counter(own)
            score = sum(k * max(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)), 1e-6) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(own) / avg)) for t, k in Counter(terms).items() if tf[t])
            if score:
                out.setdefault(q, {})[c] = round(score, 9)
    return out


def best(scores, k):
    return {q: [(c, round(s / max(own.values()), 8)) for c, s in sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k]] for q, own in scores.items()}


def got(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["question_id"], []).append((r["chunk_id"], round(r["score"], 8)))
    return out


def asked(spark, index, n=30):
    rng = random.Random(9)
    held = [r["text"].split() for r in index.chunks.where("text != ''").select("text").orderBy("chunk_id").limit(200).collect()]
    rows = [(f"q{i}", " ".join(rng.choice(rng.choice(held)) for _ in range(rng.randint(1, 12)))) for i in range(n)] + [("none", "zzzzzz"), ("blank", "")]
    return spark.createDataFrame(rows, "question_id string, question string")


def terms_of(index, questions):
    tokens = {r["chunk_id"]: r["tokens"] for r in index.chunks.select("chunk_id", "tokens").collect()}
    terms = {}
    for r in retrieval.question_terms(questions).collect():
        terms.setdefault(r["question_id"], []).extend([r["term"]] * r["qtf"])
    return tokens, terms


def test_blocks_are_left_out_and_increments_add_up(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "PART", 300)
    rows = corpus(700)
    path = str(tmp_path / "index")
    retrieval.build_index(spark.createDataFrame(rows[:400], CHUNK), path)
    index = retrieval.load_index(spark, path).extend(spark.createDataFrame(rows[400:], CHUNK))
    assert len(index.segments) == 2 and index.size == 700 and index.chunks.count() == 700
    questions = asked(spark, index)
    tokens, terms = terms_of(index, questions)
    want = plain(tokens, terms)
    with Stage(spark) as stage:
        held = retrieval.Asked(index, questions, stage)
        reads = []
        hits = retrieval.Asked.hits
        monkeypatch.setattr(retrieval.Asked, "hits", lambda self, wanted: reads.append(wanted) or hits(self, wanted))
        assert got(retrieval.search(index, questions, 3, stage=stage)) == best(want, 3)
        all_blocks = held.terms.join(held.heads, ["bucket", "term"]).count()
        # the first blocks, those that can reach the bound, and lesser terms' blocks for their chunks
        first, able, lesser = (x.count() for x in reads)
        assert first + able < all_blocks and able + lesser <= all_blocks
        every = {(r["question_id"], r["chunk_id"]): r["score"] for r in retrieval.lexical_scores(index, questions, stage).collect()}
    assert every == pytest.approx({(q, c): s for q, own in want.items() for c, s in own.items()}, abs=2e-9)
    # as if built at once
    whole = retrieval.build_index(spark.createDataFrame(rows, CHUNK))
    key = lambda i: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in i.terms().collect())
    assert key(whole) == key(index) and whole.average == index.average
    with pytest.raises(ValueError, match="already"):
        index.extend(spark.createDataFrame(rows[:1], CHUNK))
    assert retrieval.load_index(spark, path).size == 700
    with pytest.raises(ValueError):
        retrieval.build_index(spark.createDataFrame(rows, CHUNK), path)
    with pytest.raises(ValueError):
        retrieval.load_index(spark, str(tmp_path / "nothing"))
    whole.close()
    assert not exists(spark, whole.path) and exists(spark, path)


def test_only_blocks_of_asked_terms_are_exploded(spark):
    index = retrieval.build_index(spark.createDataFrame(corpus(50), CHUNK))
    one = spark.createDataFrame([("q", "wabx")], "question_id string, question string")
    with Stage(spark) as stage:
        heads = retrieval.Asked(index, one, stage).heads
        assert {r["term"] for r in heads.collect()} <= {r["term"] for r in retrieval.question_terms(one).collect()}
    empty = retrieval.build_index(spark.createDataFrame([], CHUNK))
    with Stage(spark) as stage:
        assert retrieval.search(empty, one, 3, stage=stage).count() == 0
        assert retrieval.search(index, one.limit(0), 3, stage=stage).count() == 0


def test_many_questions_make_no_row_for_a_question_and_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "PART", 150)
    monkeypatch.setattr(retrieval, "PACKET", 500)
    rows = corpus(400)
    rows += [(f"copy {r[0]}", *r[1:]) for r in rows[:40]]
    index = retrieval.build_index(spark.createDataFrame(rows[:300], CHUNK)).extend(spark.createDataFrame(rows[300:], CHUNK))
    questions = asked(spark, index)
    tokens, terms = terms_of(index, questions)
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    monkeypatch.setattr(retrieval, "ASKED_TERMS", 40)
    monkeypatch.setattr(retrieval.Asked, "hits", lambda self, wanted: pytest.fail("a row for a question and a chunk"))
    with Stage(spark) as stage:
        for k in (1, 3, 1000):
            assert got(retrieval.search(index, questions, k, stage=stage)) == best(plain(tokens, terms), k)
        assert retrieval.search(index, questions.limit(0), 3, stage=stage).count() == 0
        empty = retrieval.build_index(spark.createDataFrame([], CHUNK))
        assert retrieval.search(empty, questions, 3, stage=stage).count() == 0
    index.close()


def test_blend(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    monkeypatch.setattr(retrieval, "KNOWN", 37)
    monkeypatch.setattr(retrieval, "ASKED", 10)
    index = retrieval.build_index(spark.createDataFrame(corpus(200), CHUNK))
    questions = asked(spark, index)
    rng = np.random.default_rng(1)
    vector = lambda i: [] if i % 50 == 3 else [0.0] * 4 if i % 50 == 4 else rng.integers(-2, 3, 3 if i % 50 == 5 else 4).tolist()
    chunks, own = {f"c3-{i}": vector(i) for i in range(190)}, {f"q{i}": vector(i) for i in range(28)} | {"none": [1.0, 0, 0, 0]}
    frames = [spark.createDataFrame([(k, [float(x) for x in v]) for k, v in d.items()], f"{n} string, vector array<double>") for d, n in ((chunks, "chunk_id"), (own, "question_id"))]
    tokens, terms = terms_of(index, questions)
    lexical = plain(tokens, terms)

    def cos(a, b):
        size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 0.0 if len(a) != len(b) or not size else sum(x * y for x, y in zip(a, b)) / size

    for w in (0.35, 0.9, 1.0):
        want = {}
        for q in {r["question_id"] for r in questions.collect()}:
            peak = max(lexical.get(q, {}).values(), default=0)
            own_scores = {c: round((1 - w) * lexical.get(q, {}).get(c, 0) / (peak or 1) + w * max(cos(own.get(q, []), chunks.get(c, [])), 0), 9) for c in {*lexical.get(q, {}), *(chunks if q in own else ())}}
            ranked = [(c, round(s, 7)) for c, s in sorted(own_scores.items(), key=lambda x: (-x[1], x[0]))[:4] if s > 0]
            if ranked:
                want[q] = ranked
        with Stage(spark) as stage:
            found = {q: [(c, round(s, 7)) for c, s in x] for q, x in got(retrieval.search(index, questions, 4, w, *frames, stage=stage)).items()}
        assert set(found) == set(want)
        for q, rows in want.items():
            assert [s for _, s in found[q]] == pytest.approx([s for _, s in rows], abs=3e-7)
            assert [c for c, _ in found[q]] == [c for c, _ in rows]
    near = {(r["question_id"], r["chunk_id"]): r["score"] for r in retrieval.dense_search(*frames, 3).collect()}
    for q, v in own.items():
        top = sorted(((-round(cos(v, x), 9), c) for c, x in chunks.items()))[:3]
        assert {c for _, c in top} == {c for k, c in near if k == q}
    plan = retrieval.dense_search(*frames, 3)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_gate_loads_without_tokenising_and_releases(spark, tmp_path):
    path = str(tmp_path / "kb")
    texts = {"frete": "O frete custa R$ 24,90 para todo o país.", "prazo": "O prazo de entrega é de 5 dias úteis."}
    Gate.from_documents(readers.from_texts(spark, texts), path=path).close()
    with Gate.load(spark, path) as gate:
        asked = readers.questions_from_list(spark, ["quanto custa o frete?"])
        plan = with_evidence(gate.retrieve(asked), gate.chunks)._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all(translate" not in plan.replace(" ", "") and "tokens" in plan
        found = gate.ask(asked)
        assert found.first()["action"] == "answer"
        held = [s.path for s in gate._stages]
        assert held and all(exists(spark, p) for p in held)
        gate.release()
        assert not any(exists(spark, p) for p in held)
        gate.extend(readers.from_texts(spark, {"troca": "As trocas podem ser feitas em até 30 dias."}))
        assert gate.ask(readers.questions_from_list(spark, ["trocas em quantos dias?"])).select(F.col("citations")[0]["chunk_id"]).first()[0] == "troca#0"
    assert Gate.load(spark, path).size == 3
