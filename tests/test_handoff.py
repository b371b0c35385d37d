"""Handoffs from tasks: each goes out once, whatever is replayed or fails."""

import json

import pytest

from attest.operators import providers
from attest.plans.engine import Gate
from attest.sources import sinks
from attest.streaming import handoff, webhook


def sender(folder, refuse=()):
    def send(row):
        import uuid

        key = row["message_id"]
        open(f"{folder}/{key}-{uuid.uuid4().hex}", "w").close()
        return key not in refuse

    return send


def sent(folder):
    return sorted(p.name.split("-")[0] for p in folder.iterdir())


def rows(spark, *keys):
    return spark.createDataFrame([(k, "note") for k in keys], "message_id string, note string").repartition(3)


def test_a_replayed_batch_sends_nothing_twice(spark, tmp_path):
    (tmp_path / "out").mkdir()
    name = handoff.register(spark, sender(tmp_path / "out"), str(tmp_path / "ledger"), "handoff_a")
    for _ in range(2):
        rows(spark, *"abcdef").write.format(name).mode("append").save()
    assert sent(tmp_path / "out") == list("abcdef")
    rows(spark, *"fgh").write.format(name).mode("append").save()
    assert sent(tmp_path / "out") == list("abcdefgh")
    rows(spark, "a").limit(0).write.format(name).mode("append").save()


def test_what_failed_is_sent_again_and_the_rest_is_not(spark, tmp_path):
    (tmp_path / "out").mkdir()
    name = handoff.register(spark, sender(tmp_path / "out", {"b"}), str(tmp_path / "ledger"), "handoff_b")
    rows(spark, *"abc").write.format(name).mode("append").save()
    name = handoff.register(spark, sender(tmp_path / "out"), str(tmp_path / "ledger"), "handoff_b2")
    rows(spark, *"abc").write.format(name).mode("append").save()
    assert sent(tmp_path / "out") == list("abbc")


def test_a_stream_writes_through_the_same_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "a.txt").write_text("m1\nm2\nm3")
    name = handoff.register(spark, sender(tmp_path / "out"), str(tmp_path / "ledger"), "handoff_c")
    for checkpoint in ("one", "two"):  # a lost checkpoint replays all
        stream = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "message_id")
        stream.writeStream.format(name).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination(120)
    assert sent(tmp_path / "out") == ["m1", "m2", "m3"]


def test_rows_are_taken_a_few_at_a_time():
    from concurrent.futures import ThreadPoolExecutor

    taken = []
    with ThreadPoolExecutor(2) as pool:
        out = handoff.bounded(pool, lambda x: x * 2, (taken.append(i) or i for i in range(50)), 5)
        assert next(out) == 0 and len(taken) == 5
        assert list(out) == [2 * i for i in range(1, 50)]


def test_messages_that_a_person_takes_over(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    said = lambda i, text, jid="5511@s.whatsapp.net": json.dumps({"event": "messages.upsert", "data": {"key": {"remoteJid": jid, "id": i}, "message": {"conversation": text}}})
    (tmp_path / "in" / "a.txt").write_text("\n".join([said("ok", "quanto custa o frete?"), said("no", "xyzzy plugh"), said("group", "xyzzy plugh", "1@g.us"), said("blank", " ")]))
    name = handoff.register(spark, sender(tmp_path / "out"), str(tmp_path / "ledger"), "handoff_d")
    gate = Gate.from_texts(spark, {"faq": "O frete custa R$ 24,90 para todo o país."})
    out, seen = [], []
    for checkpoint in ("one", "two"):
        messages = webhook.parse_webhook(spark.readStream.text(str(tmp_path / "in")))
        webhook.answer_stream(messages, lambda q: gate.ask(q, providers.echo), lambda df, _: out.extend(df.collect()), str(tmp_path / checkpoint), handoff=name, release=gate.release, on_answer=lambda df, _: seen.append(df.count())).awaitTermination(120)
    by = {r["message_id"]: r for r in out}
    assert sent(tmp_path / "out") == ["no"] and len(out) == 8 and seen == [2, 2] and not gate._stages
    assert by["ok"]["action"] == "answer" and by["no"]["action"] == "escalate" and by["no"]["text_out"] and "xyzzy" in by["no"]["note"]
    assert by["group"]["text_out"] == "" and by["blank"]["text_out"] == "" and not by["group"]["handoff"]


def test_a_sink_tells_whether_it_worked_and_hides_its_token(caplog):
    answers = [{"id": 7}, {}, {"id": None}]
    sink = sinks.ChatwootHandoff(base_url="http://x/", account_id="1", api_token="secret-token", post=lambda *a: answers.pop(0))
    row = {"sender": "s", "note": "hi", "verdict": "ungrounded", "confidence": 0.5}
    assert sink.send(row) is True and sink.send(row) is False
    assert "secret-token" not in repr(sink) + caplog.text
    with pytest.raises(ValueError, match="api_token"):
        sinks.ChatwootHandoff(base_url="http://x", account_id="1")
