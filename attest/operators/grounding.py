"""The gate: does the evidence support what a draft says?"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import HEDGE, NO_CLAIM
from ..functions.text import extract_numbers, normalize, split_sentences, tokenize, without_figures

#: Weight of a word that no evidence has.
UNKNOWN_WEIGHT = math.log(2.0)


@dataclass(frozen=True)
class Checker:
    """Thresholds of the gate."""

    support_threshold: float = 0.55
    hedged_threshold: float = 0.40
    require_numeric_support: bool = True
    numeric_scope_threshold: float = 0.30
    min_content_tokens: int = 2

    def __post_init__(self) -> None:
        for name in ("support_threshold", "hedged_threshold", "numeric_scope_threshold"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be between 0 and 1")


def two_places(x: Column) -> Column:
    """A share from 0 to 1 as text with two places, rounded as the double that it is, ties to even.

    Java's formatter rounds the digits that it would print, ties up: 0.125 would become 0.13.
    """
    whole, one = F.lit(1 << 60).cast("decimal(20,0)"), (x * float(1 << 60)).cast("long").cast("decimal(20,0)") * 100
    n = F.call_function("div", one, whole)
    rest = (one - n * whole) * 2
    n = n + F.when((rest > whole) | ((rest == whole) & (n % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def held(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    Spark writes a column's expression into every place that names it, also inside the functions
    of arrays, where it would run again for each element. A generator of one row ends that.
    """
    return rows.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_held")).select(*rows.columns, "_held.*")


def is_checkable_claim(sentence: Column, min_content_tokens: int = 2) -> Column:
    """Whether a sentence asserts something: no greeting, no question, and enough content words."""
    return ~normalize(sentence).rlike("(?iU)" + "|".join(NO_CLAIM)) & (F.size(tokenize(sentence)) >= min_content_tokens)


def with_evidence(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id and evidence: its retrieved chunks in order, at most top_k of them.

    Tokens are those of an index, where the chunks come from one; they and figures are made for
    each use as evidence otherwise.
    """
    known = F.col("tokens") if "tokens" in chunks.columns else tokenize(F.col("text"))
    row = retrieved.join(chunks, "chunk_id")
    row = row.select("question_id", "rank", "score", "chunk_id", "doc_id", "text", "start", "end", "metadata", F.array_distinct(known).alias("tokens"), F.array_distinct(extract_numbers(F.col("text"))).alias("numbers"))
    return row.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "chunk_id", "doc_id", "text", "start", "end", F.col("metadata")["source"].alias("source"), "tokens", "numbers"))).alias("evidence"))


def evidence_idf(evidence: Column) -> Column:
    """ln(1 + n / df) of every term of a question's evidence."""
    terms = F.array_distinct(F.flatten(F.transform(evidence, lambda e: e["tokens"])))
    weight = lambda t: F.log(1 + F.size(evidence) / F.size(F.filter(evidence, lambda e: F.array_contains(e["tokens"], t))))
    return F.map_from_entries(F.transform(terms, lambda t: F.struct(t.alias("term"), weight(t).alias("idf"))))


def coverage(claim_tokens: Column, chunk_tokens: Column, idf: Column) -> Column:
    """The share of a claim's words, by rarity, that a chunk has; figures do not count."""
    known = without_figures(claim_tokens)
    weigh = lambda tokens: F.aggregate(tokens, F.lit(0.0), lambda s, t: s + F.coalesce(F.try_element_at(idf, t), F.lit(UNKNOWN_WEIGHT)))
    total = weigh(known)
    return F.when(total > 0, weigh(F.filter(known, lambda t: F.array_contains(chunk_tokens, t))) / total).otherwise(0.0)


def check_claims(drafts: DataFrame, evidence: DataFrame, checker: Checker = Checker()) -> DataFrame:
    """One row for each checkable sentence of the drafts.

    drafts has question_id and draft; evidence comes from `with_evidence`. A claim's figures must
    occur in a chunk nearly as close to it as the best one; N% is also met by N. Returns
    question_id, pos, claim, supported, support_score, supporting_chunk_ids, unsupported_numbers
    and reason.
    """
    said = drafts.select("question_id", F.posexplode(split_sentences(F.col("draft"))).alias("pos", "claim")).where(is_checkable_claim(F.col("claim"), checker.min_content_tokens))
    known = evidence.select("question_id", "evidence", F.explode(F.array(evidence_idf(F.col("evidence")))).alias("idf"))
    row = said.join(known, "question_id", "left")
    row = row.select("question_id", "pos", "claim", "idf", F.coalesce("evidence", F.array()).alias("evidence"), F.explode(F.array(tokenize(F.col("claim")))).alias("tokens"))
    threshold = F.when(F.col("claim").rlike("(?iU)" + HEDGE), checker.hedged_threshold).otherwise(checker.support_threshold)
    score = F.transform("evidence", lambda e: coverage(F.col("tokens"), e["tokens"], F.col("idf")))
    row = row.select("question_id", "pos", "claim", "evidence", F.explode(F.array(score)).alias("scores"), threshold.alias("threshold"), extract_numbers(F.col("claim")).alias("claimed") if checker.require_numeric_support else F.array().cast("array<string>").alias("claimed"))
    row = row.withColumn("best", F.coalesce(F.array_max("scores"), F.lit(0.0)))
    scored = F.zip_with("evidence", "scores", lambda e, s: F.struct(e["chunk_id"].alias("chunk_id"), e["numbers"].alias("numbers"), s.alias("score")))
    row = row.select("question_id", "pos", "claim", "threshold", "claimed", "best", F.explode(F.array(scored)).alias("scored"))
    floor = F.greatest(F.lit(checker.numeric_scope_threshold), F.col("best") * 0.75)
    near = F.filter("scored", lambda e: e["score"] >= floor)
    first = F.slice(F.filter("scored", lambda e: e["score"] == F.col("best")), 1, 1)
    near = F.when(F.size(near) > 0, near).otherwise(first)
    row = row.withColumn("available", F.flatten(F.transform(near, lambda e: e["numbers"])))
    met = lambda n: F.array_contains(F.col("available"), n) | (n.endswith("%") & F.array_contains(F.col("available"), F.rtrim(n, F.lit("%"))))
    missing = F.array_distinct(F.filter("claimed", lambda n: ~met(n)))
    support = F.transform(F.filter("scored", lambda e: e["score"] >= F.col("threshold")), lambda e: e["chunk_id"])
    row = row.select("question_id", "pos", "claim", "best", "threshold", missing.alias("unsupported_numbers"), support.alias("supporting_chunk_ids"))
    numeric = F.size("unsupported_numbers") > 0
    supported = ~numeric & (F.size("supporting_chunk_ids") > 0)
    reason = F.when(numeric, F.concat(F.lit("numbers not present in any relevant source: "), F.array_join("unsupported_numbers", ", "))).when(supported, "").otherwise(F.concat(F.lit("lexical support "), two_places(F.col("best")), F.lit(" < "), two_places(F.col("threshold"))))
    return row.select("question_id", "pos", "claim", supported.alias("supported"), F.col("best").alias("support_score"), "supporting_chunk_ids", "unsupported_numbers", reason.alias("reason"))


def with_relevance(rows: DataFrame, question: Column, answer: Column, evidence: Column, name: str = "relevance", where: Column | None = None) -> DataFrame:
    """Adds how much of the question's content the answer itself has, by rarity in the evidence.

    It is 1 for questions without any content, and 1, without a look at the texts, for rows that
    `where` leaves out.
    """
    wanted = (lambda c: c) if where is None else (lambda c: F.when(where, c))
    made = F.struct(wanted(without_figures(tokenize(question))).alias("asked"), wanted(F.array_distinct(tokenize(answer))).alias("said"), wanted(evidence_idf(evidence)).alias("idf"))
    own = held(rows, **{f"_{name}": made})
    at = F.col(f"_{name}")
    none = F.coalesce(F.size(at["asked"]) <= 0, F.lit(True))
    return own.withColumn(name, F.when(none, 1.0).otherwise(coverage(at["asked"], at["said"], at["idf"]))).drop(f"_{name}")
