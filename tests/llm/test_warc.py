"""Archives read by ranges of every size, and records planted inside records."""

import base64
import gzip
import hashlib
import io
import os
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attest.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, n string, sha string, key string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def plain(rows, least=0):
    out = Counter()
    for i, r in enumerate(rows):
        same = [(s[0] is not None, s[0] or 0, j) for j, s in enumerate(rows) if (s[2] or "") == (r[2] or "")]
        size = len((r[2] or "").encode())
        best = max(same)
        first = size < least or len(same) == 1 or (r[0] is not None, r[0] or 0) == best[:2]
        out[r[0], size, digest(r[2]), best[1] if best[0] else None, first] += 1
    return out


def made():
    rng = random.Random(4)
    texts = ["<p>é</p>", "", None, "x" * 300_000, "<html>\r\n\r\nWARC/1.1\r\n</html>", "\x1f tail"]
    rows = [(i, None if i % 9 == 0 else f"http://a/{i}\r\nX: y", rng.choice(texts) if i % 2 else "".join(rng.choices("abc <>é😀", k=rng.randint(1, 3000))), "p", "n", "s", "k") for i in range(120)]
    return [*rows, (None, "u", "<p>é</p>", "p", "n", "s", "k"), (None, None, None, "p", "n", "s", "k"), (7000, "u", "y", "p", "n", "s", "k"), (7000, "u", "y", "p", "n", "s", "k")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = made()
    found = warc.round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4), least=least).collect()
    assert len(found) == len(rows)
    responses = {(r["page_id"], r["payload_digest"]) for r in found if r["record_type"] == "response"}
    got, want = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found), Counter((r[0], len((r[2] or "").encode()), digest(r[2])) for r in rows)
    assert got == want
    best = {}
    for r in rows:
        best.setdefault(r[2] or "", []).append((r[0] is not None, r[0] or 0))
    by = {digest(t): (max(x), len(x), len(t.encode())) for t, x in best.items()}
    for d, ((known, top), times, size) in by.items():
        own = [r for r in found if r["payload_digest"] == d]
        again = [r for r in own if r["record_type"] == "revisit"]
        if size < least:
            assert not again
            continue
        assert len(own) == times and len(again) == times - 1
        assert all(r["refers_to"] == (top if known else None) for r in again)
        assert (top if known else None, d) in responses


def test_empty(spark, tmp_path):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    os.makedirs(tmp_path / "none")
    assert warc.register(spark) is None and spark.read.format("warc").load(str(tmp_path / "none")).count() == 0


def archive():
    """Records of which one holds whole gzip members of records, stored as they are, and their offsets."""
    rng = random.Random(8)
    row = lambda i, p: {"record_id": f"<urn:x:{i}>", "record_type": "response", "target_uri": "u", "payload": p, "fields": None}
    inner = warc.response(row("in", b"inside"))
    noise = rng.randbytes(40_000)

    def stored(packed):
        own = zlib.compressobj(0, zlib.DEFLATED, 31)
        return own.compress(zlib.decompress(packed, 31)) + own.flush()

    parts = [warc.opening(), warc.response(row(1, b"one")), stored(warc.response(row(2, noise + inner + noise[:999] + warc.MAGIC + noise[:50] + inner[:60]))), warc.response(row(3, b"")), warc.response(row(4, rng.randbytes(70_000))), warc.response(row(5, b"five" * 5000))]
    data, at = b"".join(parts), [sum(map(len, parts[:i])) for i in range(len(parts))]
    assert data.count(inner) == 1
    return data, at


@pytest.mark.parametrize("size", [1, 37, 1000, 30_011, 65_536, 1 << 30])
def test_ranges_own_each_record_once(size):
    data, at = archive()
    starts = range(0, len(data), size) if size > 37 else [s for a in (*at, at[2] + 40_300) for s in range(max(0, a - 2 * size), a + 2 * size + 1, size)]
    found = []
    for start in sorted(set(starts)) if size <= 37 else starts:
        found += [o for o, _, _ in warc.owned(io.BytesIO(data), start, min(start + size, len(data)))]
    assert found == at if size > 37 else sorted(set(found)) == at


def test_broken_archives_and_plain_gzip(tmp_path):
    data, at = archive()
    assert gzip.decompress(data).count(b"WARC-Type: response") >= 5
    with pytest.raises((EOFError, zlib.error, ValueError)):
        list(warc.owned(io.BytesIO(data[:-20]), 0, len(data)))
    bent = bytearray(data)
    bent[at[4] + 30_000] ^= 1
    with pytest.raises((EOFError, zlib.error, ValueError)):
        list(warc.owned(io.BytesIO(bytes(bent)), 0, len(data)))


def test_source_with_small_ranges_and_files(spark, tmp_path):
    rows = made()
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    warc.archived(pages, "page_id", "url", "html", str(tmp_path / "w"))
    names = os.listdir(tmp_path / "w")
    assert names and all(n.endswith(".warc.gz") for n in names)
    all_at_once = spark.read.format("warc").load(str(tmp_path / "w"))
    ranged = spark.read.format("warc").option("rangeBytes", "700").load(str(tmp_path / "w"))
    key = lambda df: Counter((r["record_id"], r["record_type"], r["offset"], r["payload"]) for r in df.collect())
    assert key(all_at_once) == key(ranged) and ranged.rdd.getNumPartitions() > 20
    assert ranged.where("record_type = 'warcinfo'").count() == len(names)
    html = {r["payload"].decode() for r in ranged.where("record_type = 'response'").collect()}
    assert html == {r[2] or "" for r in rows}
    # appending keeps, overwriting does not
    row = ranged.where("record_type = 'response'").limit(1).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "refers_to_uri": F.lit(None).cast("string")}).persist()
    row.write.format("warc").mode("append").option("path", str(tmp_path / "w")).save()
    assert len(os.listdir(tmp_path / "w")) == len(names) + 1
    row.write.format("warc").mode("overwrite").option("path", str(tmp_path / "w")).save()
    assert spark.read.format("warc").load(str(tmp_path / "w")).where("record_type = 'response'").count() == 1


def test_base32(spark):
    hexed = hashlib.sha1(b"x").hexdigest()
    assert spark.range(1).select(warc.base32(F.lit(hexed)).alias("b")).first()["b"] == warc.payload_digest(b"x")
