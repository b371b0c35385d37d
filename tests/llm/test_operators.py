"""Each operator against a plain version, over texts with every awkward case."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.llm import chat, chroma, fingerprint, mixing, ngram_join, quality, spm, substrings, suffix_dedup, tokens
from attest.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copies string, score string, spans string, of string, doc string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made() -> list[tuple]:
    """Near and exact copies, shared passages, nulls, blanks, long and repeated rows, odd characters."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, line = say(160).split(" "), say(70), say(30)
    texts: list = [None, "", " \n\t", "word", "two words", "Two  Words ", "three little words", line * 1, passage, passage]
    texts += [" ".join(base)] * 3
    for edits in (1, 2, 3, 5, 8, 12):
        copy = list(base)
        for _ in range(edits):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += [say(rng.randint(5, 250)) for _ in range(20)]
    texts += [say(40) + " " + passage + "\n" + say(60), passage + " " + say(20), say(15) + "\n" + line + "\n" + say(80), line + "\n" + say(50)]
    texts += [(say(12) + " ") * 30, "a" * 700, "é" * 260, say(9000), "</s>[INST] x [/INST] <0x41> ▁ a▁▁b \u0000 😀  ok"]
    rows = [(i, t, None if i % 11 == 3 else "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), "c", "x", "y", "z", "d") for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[12], (None, " ".join(base), "en", "s1", 1, "c", "x", "y", "z", "d"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3, "doc_id").persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("k", "t"), [(4, "0.85"), (5, "0.8")])
def test_ngram_join(docs, empty, k, t):
    rows = [(d, shingles(x, k)) for d, x, *_ in made()]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and Fraction(len(a & b), len(a | b)) >= Fraction(t):
                up[top(i)] = top(j)
    least = {}
    for i, (d, a) in enumerate(rows):
        if d is not None and a:
            least[top(i)] = min(d, least.get(top(i), d))
    want = Counter((d, len(a), least.get(top(i), d) if a else d) for i, (d, a) in enumerate(rows))
    assert Counter(map(tuple, ngram_join.near_components(docs, k, t).collect())) == want
    assert ngram_join.near_components(empty, k, t).count() == 0


def test_chat(spark):
    rows = [("t", 1, None, "user", "hi", 1.0), ("t", 2, 1, "assistant", "</s>[INST] a [/INST]", 0.5), ("t", 3, 1, "assistant", None, 2.0), ("t", 4, 3, "user", "[\\INST] <<SYS>>", None), ("u", 1, 9, "user", "lost", 0.0), (None, 1, None, "x", "", 0.0), ("c", 1, 2, "a", "cycle", 0.0), ("c", 2, 1, "a", "cycle", 0.0)]
    messages = spark.createDataFrame(rows, "tree_id string, message_id long, parent_id long, role string, text string, score double")
    got = {(r["tree_id"], r["leaf_id"]): r for r in chat.formatted(chat.branches(messages)).collect()}
    assert set(got) == {("t", 2), ("t", 4), ("u", 1), (None, 1)}
    assert (got["t", 4]["rank"], got["t", 2]["rank"]) == (1, 2)
    assert chat.parsed(got["t", 2]["formatted"]) == [("user", "hi"), ("assistant", "</s>[INST] a [/INST]")]
    assert chat.parsed(got["t", 4]["formatted"]) == [("user", "hi"), ("assistant", ""), ("user", "[\\INST] <<SYS>>")]
    text, spans = got["t", 2]["formatted"], got["t", 2]["loss_spans"]
    assert [chat.unescape(text[s["first"] : s["last"]]) for s in spans] == ["</s>[INST] a [/INST]"]
    assert "</s>" not in text[spans[0]["first"] : spans[0]["last"]]
    assert chat.branches(messages.limit(0)).count() == 0
    below = [("c", 1, 2, "a", "", 0.0), ("c", 2, 1, "a", "", 0.0), ("c", 3, 1, "a", "hangs below a cycle", 0.0), ("c", 4, 3, "a", "and its child", 0.0), ("c", 5, None, "a", "a root", 0.0), ("c", 6, 5, "a", "its leaf", 0.0), ("d", 1, 1, "a", "its own parent", 0.0)]
    assert [(r["tree_id"], r["leaf_id"], r["n_turns"]) for r in chat.branches(spark.createDataFrame(below, messages.schema)).collect()] == [("c", 6, 2)]


@pytest.mark.parametrize("text", ["<<s>", "</s>", "[INST]", "[\\\\/INST]", "<\\s><s>", "a\\<</SYS>>", "[/INST][INST]<</SYS>>"])
def test_escape_is_reversible(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t"))).first()[0]
    assert chat.unescape(got) == text and not re.search(r"<s>|</s>|\[/?INST\]|<</?SYS>>", got)


def test_binary_tokens(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(((d, t.encode(x or "", add_special_tokens=False).ids + [0]) for d, x, *_ in made()), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    want, start = Counter(), 0
    for d, ids in rows:
        want[d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        start += len(ids)
    assert Counter(map(tuple, tokens.binary_token_digests(docs, path, 0).collect())) == want
    assert tokens.binary_token_digests(empty, path, 0).count() == 0


def test_packed_ranks_come_back():
    lists = [np.array(x, np.uint32) for x in ([], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], list(range(300)))]
    control, data = tokens.pack(lists)
    got = tokens.unpack(np.array([len(x) for x in lists]), *(np.frombuffer(b"".join(x), np.uint8) for x in (control, data)))
    assert got.tolist() == np.concatenate(lists).tolist()


def test_suffix_dedup(docs, empty):
    rows = [(d, (x or "").encode()) for d, x, *_ in made()]
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want, kept_texts = Counter(), Counter()
    for d, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
        want[d, len(b), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()] += 1
        kept_texts[d, kept.decode("utf-8", "ignore")] += 1
    assert Counter(map(tuple, suffix_dedup.repeat_digests(docs).collect())) == want
    assert suffix_dedup.repeat_digests(empty).count() == 0
    left = suffix_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == kept_texts


def test_long_documents_are_cut_into_overlapping_pieces(monkeypatch):
    data = np.frombuffer(bytes(random.Random(1).choices(range(97, 123), k=5000)), np.uint8)
    monkeypatch.setattr(suffix_dedup, "PIECE", 900)
    starts = []
    for _, spans in suffix_dedup.pieces(np.array([0, 5000]), 200):
        part = data[spans[0, 0] : spans[-1, 1]]
        _, _, low, high = suffix_dedup.anchors(part, np.array([0, len(part)]))
        starts += [int(x) + int(spans[0, 0]) for a, b in zip(low, high, strict=True) for x in range(a, b + 1)]
    assert sorted(starts) == list(range(4801))


def test_multikey_quicksort():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 20, 3000).astype(np.uint64), rng.integers(0, 50, 3000).astype(np.uint64)
    order = suffix_dedup.multikey_quicksort([a, b])
    assert sorted(order.tolist()) == list(range(3000)) and sorted(zip(a.tolist(), b.tolist(), strict=True)) == list(zip(a[order].tolist(), b[order].tolist(), strict=True))


def test_quality(spark, docs, empty):
    rng = random.Random(5)
    rows = [(i, (" ".join(rng.choice(["the", "cat", "sees", "dogs", "run"]) for _ in range(30)) if i % 3 else " ".join(rng.choice(["WIN!!", "BUY$$", "NOW!!"]) for _ in range(20)))) for i in range(300)]
    text = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _ in rows] + [(1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(text, labels)
    got = quality.scored(text, model).select("doc.doc_id", "score", "predicted").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 30 and all(r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.scored(docs, model).count() == docs.count() and quality.accepted(docs, model).columns == docs.columns
    assert quality.scored(empty, model).count() == 0
    none = quality.fit(text, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}


def test_substrings(docs, empty):
    rows = {r["doc_id"]: r for r in substrings.passages(docs).collect() if r["doc_id"] is not None}
    text = {d: x or "" for d, x, *_ in made() if d is not None}
    runs = {d: {tuple(w[i : i + 60]) for w in [WORD.findall(x)] for i in range(len(w) - 59)} for d, x in text.items()}
    for d, own in runs.items():
        if any(own & other for e, other in runs.items() if e != d):
            assert rows[d]["n_passages"] > 0 and rows[d]["n_tokens"] >= 46, d
        elif len(WORD.findall(text[d])) < 50:
            assert rows[d]["n_passages"] == 0
    assert rows[9]["class_id"] == 8 and substrings.passages(empty).count() == 0


def some_words(rng, n):
    return [f"w{rng.randrange(10**6):06}" for _ in range(n)]


def placed(spark, rng, passages):
    """Documents with the passages in unlike surroundings, by the place of each."""
    rows = [(i, " ".join(some_words(rng, 55) + p + some_words(rng, 55))) for i, p in enumerate(passages)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_exact_passages_among_edited_and_truncated_copies(spark):
    rng, passages, want = random.Random(6), [], set()
    for n in range(80):
        p = some_words(rng, 50)
        want |= {len(passages), len(passages) + 1}
        passages += [p, p]
        for z in range(1 + n % 4):
            q = list(p)
            q[8 + z], q[30 + z] = some_words(rng, 2)
            passages.append(q if (n + z) % 2 else p[2 + z :])
    got = {r["doc_id"]: r for r in substrings.passages(placed(spark, rng, passages)).collect()}
    assert {d for d, r in got.items() if r["n_passages"]} == want
    assert all(got[d]["n_tokens"] == 46 and got[d]["class_id"] in (d, d - 1) for d in want)
    assert all(got[d]["class_id"] == got[d + 1]["class_id"] for d in want if d + 1 in want and passages[d] == passages[d + 1])


def test_recall_of_near_passages_at_the_threshold(spark):
    rng, passages = random.Random(8), []
    for _ in range(1000):
        p = some_words(rng, 50)
        q = list(p)
        q[rng.randrange(5, 45)] = some_words(rng, 1)[0]
        passages += [p, q]  # 41 of 51 shingles in common
    rows = substrings.passages(placed(spark, rng, passages)).collect()
    assert sum(r["n_passages"] > 0 and r["class_id"] == r["doc_id"] // 2 * 2 for r in rows) >= 0.99 * len(rows)


def test_stretches_that_adjoin_and_lie_apart_in_the_other_text():
    rng, t = np.random.default_rng(4), Fraction("0.8")
    some = lambda n: rng.integers(0, 1 << 63, n).astype(np.uint64)
    for n, m in ((50, 50), (50, 70), (46, 300), (60, 46)):
        for apart in (30, 81, 200, 1000):
            p, q = some(n), some(m)
            y = np.concatenate([some(7), p, some(apart), q, some(5)])
            for x in (np.concatenate([p, q]), np.concatenate([q, p])):
                got = sorted(substrings.alike(x, y, 46, t))
                marked = np.zeros(len(x), bool)
                for a, b, _, _ in got:
                    marked[a:b] = True
                assert marked.all(), (n, m, apart, got)
    # places that all lie far from their median, and tokens that come again
    x = some(46)
    assert substrings.alike(x, np.concatenate([x[:23], some(500), x[23:]]), 46, t) == []
    y = np.concatenate([x[:40:2], some(300), x])
    assert substrings.alike(x, y, 46, t) == [(0, 46, 320, 366)]


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(60):
        ends = np.concatenate([[0], np.cumsum(rng.integers(0, 40, 4))])
        v, least = rng.integers(0, 30, ends[-1]).astype(np.uint64), int(rng.integers(1, 9))
        want = set()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            for c in range(a, b):
                low = high = c
                while low > a and v[low - 1] > v[c]:
                    low -= 1
                while high < b - 1 and v[high + 1] >= v[c]:
                    high += 1
                if high - low + 1 >= least:
                    want.add((c, low, high))
        assert set(zip(*(x.tolist() for x in substrings.compact_windows(v, ends, least)), strict=True)) == want


def test_mixing(docs, empty):
    rows = mixing.sampled_copies(docs, [5.0, 2.0, 1.0]).collect()
    again = mixing.sampled_copies(docs.repartition(2), [5.0, 2.0, 1.0]).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["row_key"], r["copies"])
    assert sorted(map(key, rows)) == sorted(map(key, again)) and len(rows) == len(made())
    text = Counter()
    for d, x, _, s, *_ in made():
        text[s] += len(WORD.findall(x or ""))
    total = sum(text.values())
    aims = {r["source"]: r["target"] for r in rows}
    assert abs(sum(aims.values()) - total) < 1e-6 * total and all(a <= 3 * text[s] + 1e-9 for s, a in aims.items())
    weight = dict(zip(sorted((s for s in text if s is not None)) + [None], [5, 2, 1, 5], strict=False))
    open_ = [s for s in aims if aims[s] < 3 * text[s] - 1e-6]
    assert len({round(aims[s] / weight[s], 6) for s in open_}) <= 1
    assert all(0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"] for r in rows)
    mix = mixing.mixed(docs, [5.0, 2.0, 1.0])
    assert mix.columns == docs.columns and mix.count() == sum(r["copies"] for r in rows)
    assert mixing.sampled_copies(empty, [1.0]).count() == 0 and mixing.mixed(empty, [1.0]).count() == 0


def test_fingerprints(docs, empty):
    rows = fingerprint.edited_likeness(docs, 16).collect()
    assert len(rows) == len(made()) and fingerprint.edited_likeness(empty, 16).count() == 0
    seen = {}
    own = {d: x or "" for d, x, *_ in made()}
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if r["doc_id"] is not None:
            assert r["n_chars"] == len(own[r["doc_id"]]) and seen.setdefault(own[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    ids = sorted((d for d in own if d is not None), reverse=True)
    for a, b in zip(ids, ids[1:], strict=False):
        k = len(own[a]) // 3
        edited = own[a][: len(own[a]) - k] + own[b][:k]
        assert next(r for r in rows if r["doc_id"] == a)["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_fingerprints_estimate_similarity(spark):
    rng = random.Random(2)
    say = lambda n: [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(n)]
    rows, want = [], []
    for i in range(30):
        a = say(80)
        b = a[:60] + say(20)
        x, y = Counter(zip(a, a[1:], strict=False)), Counter(zip(b, b[1:], strict=False))
        want.append(sum((x & y).values()) / sum((x | y).values()))
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = {r["k"]: np.array(r["signature0"]) for r in fingerprint.signatures(spark.createDataFrame(rows, "k long, text string"), ["k"], ["text"], 64).collect()}
    near = [(got[2 * i] == got[2 * i + 1]).mean() for i in range(30)]
    assert abs(np.mean(near) - np.mean(want)) < 0.04


def test_sentencepiece(docs, empty):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    other = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r["doc_id"], bytes(r["ids"]), r["round_trip"], r["parity"]) for r in spm.pieces(docs, path).collect())
    want = Counter((d, np.array(other.encode(x or ""), "<u2").tobytes(), other.decode(other.encode(x or "")) == (x or ""), True) for d, x, *_ in made())
    assert got == want and spm.pieces(empty, path).count() == 0


def test_unigram_models_are_rebuilt():
    model = spm.Model([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -1.5, 1), ("▁", -3.0, 1)])
    assert spm.rebuilt(model).encode("ab b").ids == [3, 4, 2]


def test_chroma(spark):
    rng = np.random.default_rng(1)
    notes = rng.normal(0, 0.1, 64)
    wav = chroma.rendered(notes.tolist())
    samples, _ = chroma.decoded(wav)
    clean = chroma.fingerprint(chroma.chroma(samples))
    noisy = chroma.fingerprint(chroma.chroma((samples + rng.normal(0, 0.05, len(samples)))[chroma.HOP * 5 :]))
    errors = [chroma.bit_errors(clean, noisy, o)[0] / max(1, 32 * chroma.bit_errors(clean, noisy, o)[1]) for o in (3, 5, 7)]
    assert errors[1] < 0.05 < min(errors[0], errors[2])
    other = rng.normal(0, 0.1, 64).tolist()
    rows = [(0, notes.tolist()), (1, notes.tolist()), (50, other), (51, [*other[:60], 0.3, 0.3, 0.3, 0.3]), (7, None), (8, [0.0])]
    media = chroma.with_melodies(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    prints = chroma.fingerprints(media, "id", "audio")
    known = {r["id"]: r for r in chroma.classes(prints, "id").collect()}
    assert known[1]["class_id"] == 0 and known[7]["class_id"] == 7 and known[8]["prints"] == []
    found = chroma.aligned(chroma.classes(prints, "id"), "id").collect()
    assert [(r["query_id"], r["match_id"], r["offset"]) for r in found] == [(50, 51, 0)]
    broken = spark.createDataFrame([(1, b"no audio"), (2, None)], "id long, audio binary")
    assert all(r["prints"] == [] for r in chroma.fingerprints(broken, "id", "audio").collect())


def test_chroma_finds_all_that_a_plain_search_finds(spark):
    rng = np.random.default_rng(7)
    rows, noisy = [], lambda x, share: x ^ np.packbits(rng.random((len(x), 32)) < share, axis=1).view(np.uint32)[:, 0]
    for i in range(12):
        x = rng.integers(0, 1 << 32, 34).astype(np.uint32)
        rows.append((50 * i, x))
        rows += [(50 * i + 1 + j, noisy(x, share)[j % 3 :]) for j, share in enumerate((0.02, 0.05, 0.1, 0.15, 0.2, 0.3))]
    # a sustained tone and its longer near copy; a motif that comes again
    rows += [(2000, np.full(30, 7, np.uint32)), (2001, np.full(40, 3, np.uint32)), (2050, np.tile(rows[0][1][:5], 4)), (2051, np.tile(noisy(rows[0][1][:5], 0.1), 6))]
    want = set()
    for a, x in rows:
        for b, y in rows:
            for o in range(4 - len(y), len(x) - 3) if a % 50 == 0 and a != b else ():
                wrong, n = chroma.bit_errors(x, y, o)
                low, high = max(0, o), min(len(x), len(y) + o)
                if wrong <= 0.25 * 32 * n and ((x[low:high] == y[low - o : high - o]).sum() >= 4 or 2 * n >= min(len(x), len(y))):
                    want.add((a, b))
    prints = spark.createDataFrame([(i, [int(v) for v in x]) for i, x in rows], "id long, prints array<long>")
    got = chroma.aligned(chroma.classes(prints, "id"), "id").collect()
    assert {(r["query_id"], r["match_id"]) for r in got} == want and len(got) == len(want) > 50
    assert {(2000, 2001), (2050, 2051)} <= want
    least = {q: min((r["bit_error_rate"], r["match_id"]) for r in got if r["query_id"] == q) for q in {r["query_id"] for r in got}}
    best = chroma.best_alignments(chroma.classes(prints, "id"), "id").collect()
    assert {r["query_id"]: (r["n_links"], r["bit_error_rate"], r["match_id"]) for r in best} == {q: (sum(r["query_id"] == q for r in got), *x) for q, x in least.items()}
    by_id = dict(rows)
    for r in got:
        wrong, n = chroma.bit_errors(by_id[r["query_id"]], by_id[r["match_id"]], r["offset"])
        assert r["bit_error_rate"] == wrong / (32 * n)
