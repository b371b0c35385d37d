"""What the driver calls: names, SQL for them, and a flagship query."""

import __spark_entry__ as entry


def test_sql_is_for_known_queries_and_most_have_it():
    known, told = set(entry.queries()), set(entry.oracle_sql())
    assert told <= known and {"answers", "probe_report", "audit_lines", "prompts", "webhook_replies"} <= told
    assert {n for n in known - told if not n.startswith("op")} <= {"pipeline"}


def test_entry_has_a_stable_schema(spark):
    assert entry.entry(spark).columns == ["question_id", "action", "verdict", "confidence", "claims", "cited"]
