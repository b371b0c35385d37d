"""Folders, question files and audit files that are read and written by many tasks."""

import json

import pytest

from attest.operators import providers
from attest.plans.engine import Gate
from attest.sources import readers, sinks
from attest.staging import Stage, exists


def test_files_of_other_kinds_are_not_opened(spark, tmp_path):
    (tmp_path / "a.md").write_text("Texto um.")
    (tmp_path / "B.TXT").write_text("Texto dois.")
    (tmp_path / "video.bin").write_bytes(b"\0" * 100_000)
    (tmp_path / "notes.md.bak").write_text("x")
    kept = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        assert {r["doc_id"] for r in readers.from_directory(spark, str(tmp_path)).collect()} == {"a.md", "B.TXT"}
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", kept)
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.pdf").write_text("nada")
    with pytest.raises(ValueError):
        readers.from_directory(spark, str(tmp_path / "only"))


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_line_numbers_over_several_splits(spark, tmp_path, ends):
    lines = [["", "# nota", f"  pergunta {i} sobre o prazo de entrega? ", f"e{'o' * (i % 90)} {i}"][i % 4] for i in range(900)]
    path = tmp_path / "q.txt"
    path.write_bytes(ends.join(lines).encode())
    want = [(f"{i:09d}", x.strip()) for i, x in enumerate(lines) if x.strip() and not x.strip().startswith("#")]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum") if spark.conf.get(k, None)}
    try:
        for size in ("128m", "2000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            if size != "128m":
                assert spark.read.text(str(path)).rdd.getNumPartitions() > 3
            assert sorted(map(tuple, readers.questions_from_file(spark, str(path)).collect())) == want
    finally:
        for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.set(k, kept[k]) if k in kept else spark.conf.unset(k)
    path.write_text("# só notas\n\n")
    with pytest.raises(ValueError):
        readers.questions_from_file(spark, str(path))


def test_audit_file_is_joined_from_parts_in_order(spark, tmp_path):
    with Gate.from_texts(spark, {"faq": "O frete custa R$ 24,90 para todo o país."}) as gate:
        asked = readers.questions_from_list(spark, [f"quanto custa o frete {i}?" for i in range(40)])
        lines = gate.audit(asked.repartition(7), providers.echo)
        sinks.write_ordered(lines, "question_id", str(tmp_path / "parts"))
        names = sinks.joined_parts(spark, str(tmp_path / "parts"), f"file://{tmp_path}/audit.jsonl")
        assert len(names) > 1 and names == sorted(names)
        got = [json.loads(x)["question"] for x in (tmp_path / "audit.jsonl").read_text(encoding="utf-8").splitlines()]
        assert got == [f"quanto custa o frete {i}?" for i in range(40)]


def test_a_stage_goes_when_it_is_closed(spark):
    with Stage(spark) as stage:
        held = stage.table(spark.range(5), "x")
        assert held.count() == 5 and exists(spark, stage.path)
    assert not exists(spark, stage.path)
