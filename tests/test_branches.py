"""Shapes and branches of the gate that other tests do not come by."""

import json
import random

import pytest
from pyspark.sql import functions as F

from attest import cli
from attest.functions import text as T
from attest.operators import probes, providers
from attest.operators.grounding import Checker, check_claims, coverage, evidence_idf, two_places, with_evidence
from attest.plans.engine import Gate
from attest.sources import readers, report, sinks
from attest.streaming import webhook

KB = {
    "entregas": "O prazo de entrega padrão é de 5 dias úteis para todo o país. Não fazemos entregas aos sábados, domingos e feriados nacionais.",
    "pagamento": "Parcelamos em até 6x sem juros. O boleto tem vencimento em 3 dias úteis e o pedido sai após a compensação.",
    "trocas": "Trocas podem ser pedidas em até 7 dias corridos após o recebimento.",
}


@pytest.fixture(scope="module")
def gate(spark):
    return Gate.from_texts(spark, KB)


def asked(spark, gate, *cases):
    """(action, verdict) of each (question, draft)."""
    questions = spark.createDataFrame([(str(i), q) for i, (q, _) in enumerate(cases)], "question_id string, question string")
    drafts = spark.createDataFrame([(str(i), d) for i, (_, d) in enumerate(cases)], "question_id string, draft string")
    return {int(r["question_id"]): r for r in gate.ask(questions, providers.scripted(drafts)).collect()}


def test_figures_count_where_they_belong(spark, gate):
    got = asked(
        spark,
        gate,
        ("qual o prazo de entrega?", "O prazo de entrega é de 3 dias úteis."),
        ("qual o prazo de entrega?", "O prazo de entrega é de 5 dias úteis."),
        ("qual o vencimento do boleto?", "O boleto vence em 3 dias úteis."),
        ("entregam no sábado?", "Não fazemos entregas aos sábados, domingos e feriados nacionais."),
    )
    assert [got[i]["verdict"] for i in range(4)] == ["unsafe_numeric", "grounded", "grounded", "grounded"]


def test_figures_lend_a_chunk_no_coverage(spark):
    row = spark.createDataFrame([("O prazo de entrega é de 3 dias úteis.", "O prazo de entrega é de 5 dias úteis.", "O boleto vence em 3 dias úteis.")], "claim string, near string, far string")
    row = row.select(T.tokenize(F.col("claim")).alias("claim"), *[F.array_distinct(T.tokenize(F.col(c))).alias(c) for c in ("near", "far")])
    row = row.withColumn("idf", evidence_idf(F.array(*[F.struct(F.col(c).alias("tokens")) for c in ("near", "far")])))
    got = row.select(coverage(F.col("claim"), F.col("near"), F.col("idf")).alias("near"), coverage(F.col("claim"), F.col("far"), F.col("idf")).alias("far")).first()
    assert got["near"] == 1.0 > got["far"]


def test_the_guard_may_be_off_and_every_missing_figure_is_told(spark, gate):
    questions = readers.questions_from_list(spark, ["qual o prazo de entrega?"])
    evidence = with_evidence(gate.retrieve(questions), gate.chunks)
    drafts = questions.select("question_id", F.lit("O prazo de entrega é de 9 dias úteis ou 11 dias e custa 40%.").alias("draft"))
    row = check_claims(drafts, evidence).first()
    assert row["unsupported_numbers"] == ["9", "11", "40%"] and not row["supported"]
    assert check_claims(drafts, evidence, Checker(require_numeric_support=False)).first()["unsupported_numbers"] == []
    blank = questions.select("question_id", F.lit("  ").alias("draft"))
    assert check_claims(blank, evidence).count() == 0
    lost = check_claims(drafts, evidence.limit(0)).first()
    assert not lost["supported"] and lost["supporting_chunk_ids"] == [] and lost["support_score"] == 0.0
    few = check_claims(questions.select("question_id", F.lit("Olá! Parcelamos tudo em ouro maciço lunar. O prazo de entrega é de 5 dias úteis.").alias("draft")), evidence).orderBy("pos").collect()
    assert [r["supported"] for r in few] == [False, True]


def test_scores_are_written_as_their_doubles_round(spark):
    rng = random.Random(3)
    values = [i / 200 for i in range(201)] + [i / 1000 for i in range(1001)] + [rng.random() for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", two_places(F.col("v")).alias("t")).collect()
    assert all(r["t"] == f"{r['v']:.2f}" for r in got)


def test_every_place_of_a_text_and_every_broken_payload(spark):
    shapes = {"videoMessage": {"caption": "d"}, "documentMessage": {"caption": "e"}, "imageMessage": {"caption": "c"}, "listResponseMessage": {"title": "g"}, "buttonsResponseMessage": {"selectedDisplayText": "f"}, "extendedTextMessage": {"text": "b"}}
    body = lambda message, **key: json.dumps({"event": "messages.upsert", "data": {"key": {"remoteJid": "1@s.whatsapp.net"} | key, "message": message}})
    got = [r["text"] for r in webhook.parse_webhook(spark.createDataFrame([(body({k: v}),) for k, v in shapes.items()], "value string")).collect()]
    assert got == ["d", "e", "c", "g", "f", "b"]
    odd = [body({"listResponseMessage": {"title": ["x"]}}), body({"imageMessage": "x"}), body({"imageMessage": {"caption": None}}), body(None), body([]), body("x")]
    assert [r["text"] for r in webhook.parse_webhook(spark.createDataFrame([(x,) for x in odd], "value string")).collect()] == [""] * 6
    broken = ["null", '"text"', "[1, 2]", "{", '{"data": []}', '{"data": [null]}', '{"data": 5}', '{"data": {"key": null}}', '{"data": {"key": {"remoteJid": null}}}', body({"conversation": "x"}, fromMe="true"), body({"conversation": "x"}, fromMe=[1])]
    assert webhook.parse_webhook(spark.createDataFrame([(x,) for x in broken], "value string")).count() == 0


def test_blocked_drafts_stay_inside(spark, gate):
    row = asked(spark, gate, ("qual o prazo de entrega?", "O prazo de entrega é de 1 dia útil."))[0]
    assert row["action"] == "escalate" and "1 dia" not in row["text"] and "1 dia" in row["draft"]
    assert row["diagnostics"]["rejected_claims"] == ["O prazo de entrega é de 1 dia útil."] and row["diagnostics"]["tags"] == ["needs-human"] and row["citations"] == []
    note = asked(spark, gate, ("qual o prazo de entrega?", "INSUFICIENTE"))[0]
    assert note["verdict"] == "no_evidence" and note["diagnostics"]["evidence_chunks"] > 0


def test_pre_made_chunks_and_empty_gates(spark):
    rows = [("x#0", "x", "O suporte funciona por mensagem de texto.", 0, 41, {"source": "manual.pdf"})]
    own = Gate(spark.createDataFrame(rows, "chunk_id string, doc_id string, text string, start int, end int, metadata map<string,string>"))
    found = own.ask(readers.questions_from_list(spark, ["como funciona o suporte?"]))
    assert found.first()["action"] == "answer" and json.loads(sinks.audit_log(found).first()["value"])["sources"] == ["manual.pdf"]
    empty = Gate(spark.createDataFrame([], "chunk_id string, doc_id string, text string, start int, end int, metadata map<string,string>"))
    assert empty.ask(readers.questions_from_list(spark, ["algo?"])).first()["verdict"] == "no_evidence" and empty.size == 0
    with pytest.raises(ValueError):
        Gate()


def test_probes_that_leak_end_with_three(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    (tmp_path / "kb").mkdir()
    (tmp_path / "kb" / "a.md").write_text("O frete custa R$ 24,90 para todo o país. A entrega leva 5 dias úteis.", encoding="utf-8")
    pack = tmp_path / "leak.json"
    pack.write_text(json.dumps(["O frete custa R$ 24,90 para todo o país."]), encoding="utf-8")
    page = tmp_path / "r.html"
    assert cli.main(["probe", "--kb", str(tmp_path / "kb"), "--pack", str(pack), "--report", str(page), "--client", "<b>"]) == 3
    assert "LEAK [fabricated]" in capsys.readouterr().out and "&lt;b&gt;" in page.read_text(encoding="utf-8")
    assert cli.main(["probe", "--kb", str(tmp_path / "kb"), "--json"]) == 0
    told = json.loads(capsys.readouterr().out)
    assert told["leak_rate"] == 0 and told["leaked"] == [] and told["by_kind"]["faithful"][0] == told["by_kind"]["faithful"][1]
    assert report.render_html_report(probes.ProbeReport()).startswith("<!DOCTYPE html>")
