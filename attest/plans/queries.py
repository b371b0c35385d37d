"""Queries of the gate over the test tables, and SQL with the same rows where it can say it.

Documents are the knowledge base, benchmark items the questions, user turns and the assistant
turns after them the questions and drafts of conversations.
"""


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fixed import NO_CLAIM
from ..operators import probes, providers, retrieval
from ..operators.chunking import chunk_documents
from ..operators.decide import Policy
from ..operators.grounding import Checker, check_claims, coverage, evidence_idf, held, is_checkable_claim, with_evidence, with_relevance
from ..sources import readers, sinks
from ..sources.sinks import audit_log
from ..staging import Stage
from ..streaming import webhook
from . import sql
from .engine import Gate

FLAGSHIP = "answers"
DOCS = "SELECT doc_id::VARCHAR AS chunk_id, text FROM documents"
ITEMS = "SELECT item_id::VARCHAR AS question_id, text AS question FROM benchmark"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.from_table(table(spark, sf_dir, "documents").select("doc_id", "text"))


def whole_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one chunk."""
    docs = documents(spark, sf_dir)
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "text", F.lit(0).alias("start"), F.length("text").alias("end"), "metadata")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("question_id"), F.col("text").alias("question"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, question, draft and the turn before of user turns that an assistant turn follows."""
    said = table(spark, sf_dir, "conversations")
    place = Window.partitionBy("conv_id").orderBy("turn")
    after = said.select("conv_id", "turn", "role", "text", F.lead("role").over(place).alias("next_role"), F.lead("text").over(place).alias("draft"), F.lag("text").over(place).alias("before"))
    return after.where("role = 'user' and next_role = 'assistant'").select(F.concat_ws("/", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"), "draft", "before")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("doc_id", T.normalize(F.col("text")).alias("normalized"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).select(F.explode(T.tokenize(F.col("text"))).alias("token"))
    return docs.groupBy("token").agg(F.count("*").alias("n"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))


def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir).where(F.col("text").rlike("[0-9]"))
    return docs.select("doc_id", F.posexplode(T.extract_numbers(F.col("text"))).alias("pos", "number"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_documents(documents(spark, sf_dir)).select("chunk_id", "doc_id", "start", "end", F.sha2("text", 256).alias("text_sha256"))


def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.build_index(whole_chunks(spark, sf_dir))
    return index.terms().select("term", F.col("df").cast("long").alias("df"), F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = retrieval.build_index(whole_chunks(spark, sf_dir))
    found = retrieval.search(index, questions(spark, sf_dir), 4)
    return found.select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of documents and of questions, by id; embeddings stand in for both."""
    own = readers.spread(table(spark, sf_dir, "embeddings")).select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    items = questions(spark, sf_dir).select("question_id")
    return own.withColumnRenamed("id", "chunk_id"), own.withColumnRenamed("id", "question_id").join(items, "question_id", "left_semi")


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_chunks, of_questions = _vectors(spark, sf_dir)
    return retrieval.dense_search(of_chunks, of_questions, 4, 6).select("question_id", "chunk_id", "score", F.col("rank").cast("long").alias("rank"))


def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_chunks, of_questions = _vectors(spark, sf_dir)
    index = retrieval.build_index(whole_chunks(spark, sf_dir))
    found = retrieval.search(index, questions(spark, sf_dir), 4, 0.35, of_chunks, of_questions)
    return found.select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 5).alias("score"))


def checkable_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = exchanges(spark, sf_dir).select("question_id", F.posexplode(T.split_sentences(F.col("draft"))).alias("pos", "sentence"))
    return said.select("question_id", F.col("pos").cast("long").alias("pos"), is_checkable_claim(F.col("sentence")).alias("checkable"))


def _turn_evidence() -> Column:
    """The turn before, the user's and the assistant's: what words are weighed by."""
    said = [F.struct(F.when(F.col(c).isNotNull(), F.array_distinct(T.tokenize(F.col(c)))).alias("tokens")) for c in ("before", "question", "draft")]
    return F.filter(F.array(*said), lambda e: e["tokens"].isNotNull())


def turn_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each user turn the assistant's reply covers, by rarity in these and the turn before."""
    own = held(exchanges(spark, sf_dir), evidence=_turn_evidence())
    return with_relevance(own, F.col("question"), F.col("draft"), F.col("evidence")).select("question_id", F.round("relevance", 6).alias("relevance"))


def turn_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claim coverage of each assistant turn by its user turn, by rarity in these and the turn before."""
    own = held(exchanges(spark, sf_dir), evidence=_turn_evidence())
    own = held(own, said=T.tokenize(F.col("draft")), asked=F.array_distinct(T.tokenize(F.col("question"))), idf=evidence_idf(F.col("evidence")))
    return own.select("question_id", F.round(coverage(F.col("said"), F.col("asked"), F.col("idf")), 6).alias("coverage"))


def _gate(spark: SparkSession, sf_dir: str) -> Gate:
    return Gate.from_documents(documents(spark, sf_dir))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision for every benchmark item, with the best chunk as the draft."""
    found = _gate(spark, sf_dir).ask(questions(spark, sf_dir))
    return found.select("question_id", "action", "verdict", F.round("confidence", 4).alias("confidence"), F.size("claim_checks").alias("claims"), F.transform("citations", lambda c: c["chunk_id"]).alias("cited"))


def _conversation_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = exchanges(spark, sf_dir)
    return _gate(spark, sf_dir).ask(own.select("question_id", "question"), providers.scripted(own.select("question_id", "draft")))


def conversation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_answers(spark, sf_dir).select("question_id", "action", "verdict", F.round("confidence", 4).alias("confidence"))


def audit_by_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probes.audit_metrics(_gate(spark, sf_dir).ask(questions(spark, sf_dir)))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_log(_gate(spark, sf_dir).ask(questions(spark, sf_dir)))


def claim_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every claim of every benchmark item, held against its best chunks."""
    gate = _gate(spark, sf_dir)
    asked = questions(spark, sf_dir)
    evidence = with_evidence(gate.retrieve(asked), gate.chunks)
    return check_claims(asked.withColumnRenamed("question", "draft"), evidence, gate.checker).select("question_id", "pos", "supported", F.round("support_score", 6).alias("support_score"), "supporting_chunk_ids", "unsupported_numbers", "reason")


def strict_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations under another policy and another checker: higher bars, refusals instead of escalations."""
    policy = Policy(min_retrieval_score=0.5, max_unsupported_claims=1, min_relevance=0.6, escalate_to_human=False)
    checker = Checker(support_threshold=0.8, hedged_threshold=0.7, numeric_scope_threshold=0.5)
    own = exchanges(spark, sf_dir)
    gate = Gate.from_documents(documents(spark, sf_dir), policy=policy, checker=checker)
    found = gate.ask(own.select("question_id", "question"), providers.scripted(own.select("question_id", "draft")))
    return found.select("question_id", "action", "verdict", F.round("confidence", 4).alias("confidence"))


def handoff_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a person would read who takes over a conversation."""
    return _conversation_answers(spark, sf_dir).select("question_id", sinks.handoff_note().alias("note"))


def webhook_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as messages, some of groups, and what is sent to each, with sources and handoffs."""
    own = exchanges(spark, sf_dir)
    group = F.split("question_id", "/")[0].cast("long") % 7 == 0
    messages = own.select(F.col("question").alias("text"), F.concat(F.col("question_id"), F.when(group, "@g.us").otherwise("@s.whatsapp.net")).alias("sender"), F.lit("main").alias("instance"), F.col("question_id").alias("message_id"), F.lit("").alias("sender_name"), group.alias("is_group"))
    found = webhook.replies(messages, _conversation_answers(spark, sf_dir), True, True)
    return found.select("message_id", "action", "text_out", "handoff")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model would be asked for every benchmark item."""
    gate, asked = _gate(spark, sf_dir), questions(spark, sf_dir)
    return providers.prompts(asked, with_evidence(gate.retrieve(asked), gate.chunks)).select("question_id", "prompt")


def questions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as lines of files, in order, read back as questions."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n]+", " ").alias("value"))
    stage = Stage(spark)
    sinks.write_ordered(items, "item_id", f"{stage.path}/questions")
    return readers.questions_from_file(spark, f"{stage.path}/questions", stage)


def embedded_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks by words and by vectors that an embedder makes: counts of some letters."""
    count = lambda c: (F.length("text") - F.length(F.replace("text", F.lit(c), F.lit("")))).cast("double")
    embedder = lambda rows: rows.select("id", F.array(F.lit(1.0), *map(count, "aent")).alias("vector"))
    gate = Gate.from_documents(documents(spark, sf_dir), embedder=embedder)
    found = gate.retrieve(questions(spark, sf_dir))
    return found.select("question_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 5).alias("score"))


def _suite(spark: SparkSession, sf_dir: str) -> tuple[Gate, DataFrame]:
    """Probes from all documents, against the gate of all documents."""
    gate = _gate(spark, sf_dir)
    return gate, probes.generate_probes(gate.chunks)


def probe_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suite(spark, sf_dir)[1]


def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the gate did on probes from all documents, by kind and over all."""
    gate, suite = _suite(spark, sf_dir)
    found = probes.tally(gate.probe(suite))
    return found.select("kind", "correct", "total", F.round("accuracy", 6).alias("accuracy"), "attacks", "leaked", "blocked", F.round("leak_rate", 6).alias("leak_rate"))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as webhook bodies."""
    own = table(spark, sf_dir, "events")
    key = F.struct(F.concat(F.col("user_id").cast("string"), F.when(F.col("event_id") % 7 == 0, "@g.us").otherwise("@s.whatsapp.net")).alias("remoteJid"), (F.col("event_id") % 5 == 0).alias("fromMe"), F.col("event_id").cast("string").alias("id"))
    data = F.struct(key.alias("key"), F.col("event_type").alias("pushName"), F.struct(F.col("event_type").alias("conversation")).alias("message"))
    body = F.struct(F.when(F.col("event_id") % 3 == 0, "messages.upsert").when(F.col("event_id") % 3 == 1, "connection.update").alias("event"), F.lit("main").alias("instance"), data.alias("data"))
    return own.select(F.to_json(body).alias("value"))


def webhook_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webhook.parse_webhook(_payloads(spark, sf_dir)).withColumn("actionable", webhook.is_actionable())


def webhook_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of every shape, some in lists, and the text that is read from each."""
    places = ["conversation", "extendedTextMessage.text", "imageMessage.caption", "videoMessage.caption", "documentMessage.caption", "buttonsResponseMessage.selectedDisplayText", "listResponseMessage.title", "stickerMessage.url"]
    own = table(spark, sf_dir, "events").withColumn("text", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))

    def shaped(place: str) -> Column:
        inner = F.col("text")
        for name in reversed(place.split(".")):
            inner = F.struct(inner.alias(name))
        return F.to_json(inner)

    message = F.coalesce(*[F.when(F.col("event_id") % 8 == i, shaped(p)) for i, p in enumerate(places)])
    data = F.concat(F.lit('{"key":{"remoteJid":"1@s.whatsapp.net","id":"'), F.col("event_id").cast("string"), F.lit('"},"message":'), message, F.lit("}"))
    body = F.concat(F.lit('{"event":"MESSAGES_UPSERT","data":'), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), data, F.lit("]"))).otherwise(data), F.lit("}"))
    # made once a row: generated code that writes and parses it in one piece grows too large
    return webhook.parse_webhook(held(own.select("event_id", "text"), value=body).select("value")).select("message_id", "text", webhook.is_actionable().alias("actionable"))


def mask_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    jid = F.concat("c_name", F.lit("@s.whatsapp.net"))
    return table(spark, sf_dir, "customer").select("c_custkey", webhook.mask_identifier(jid).alias("masked"))


def mask_secret(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", webhook.mask_secret(F.col("c_custkey").cast("string")).alias("masked"))


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of all packs, and how many documents share a word with each."""
    rows = [(f"{name}:{i}", name, i, line) for name in readers.available_packs() for i, line in enumerate(readers.load_pack(name))]
    stated = spark.createDataFrame(rows, "question_id string, pack string, pos int, question string")
    index = retrieval.build_index(whole_chunks(spark, sf_dir))
    near = retrieval.lexical_scores(index, stated.select("question_id", "question"), Stage(spark)).groupBy("question_id").agg(F.count("*").alias("n"))
    return stated.join(near, "question_id", "left").select("pack", "pos", F.col("question").alias("statement"), F.coalesce("n", F.lit(0)).alias("documents"))


def queries() -> dict:
    names = (
        "normalize_text tokenize_counts sentence_split extract_numbers chunks bm25_index_stats bm25_topk dense_topk hybrid_topk checkable_claims turn_relevance turn_coverage "
        "claim_support answers prompts conversation_verdicts strict_verdicts handoff_notes webhook_replies webhook_shapes questions_file embedded_topk audit_by_action audit_lines probe_suite probe_report webhook_parse mask_identifier mask_secret packs"
    ).split()
    return {name: globals()[name] for name in names}


_RANKED = "SELECT question_id, rank, chunk_id, {score} AS score FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY question_id) AS peak FROM {table}) WHERE rank <= 4 AND score > 0"
_EXCHANGES = "SELECT conv_id || '/' || turn AS question_id, text AS question, draft, before FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS draft, lag(text) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'"


def _plain_sentences(key: str, text: str, source: str) -> str:
    """Sentences: blanks after abbreviations are put aside, the other boundaries are marked and cut."""
    held = rf"regexp_replace(coalesce({text}, ''), '^\s+|\s+$', '', 'g')"
    for _ in range(2):  # matches share their last letter with the next one
        held = rf"regexp_replace({held}, '({T.abbreviation()})\s+([A-ZÀ-ÖØ-Þ0-9])', '\1' || chr(2) || '\2', 'g')"
    for _ in range(2):
        held = rf"regexp_replace({held}, '([.!?;])\s+([A-ZÀ-ÖØ-Þ0-9])', '\1' || chr(1) || '\2', 'g')"
    return rf"SELECT {key}, list_filter(list_transform(string_split_regex(replace({held}, chr(2), ' '), '[\x01\n]'), lambda x: trim(x, ' ' || chr(9) || '-•*')), lambda x: x <> '') AS sentences FROM ({source})"


def oracle_sql() -> dict[str, str]:
    bm25 = sql.bm25(DOCS, ITEMS)
    asked = "list_filter({}, lambda t: NOT regexp_matches(t, '[0-9]'))"
    # words of a turn by rarity in the turn itself, its reply and the turn before
    weigh = "coalesce(list_sum(list_transform({0}, lambda t: ln(1 + n / (list_contains(qa, t)::INT + list_contains(d, t)::INT + list_contains(p, t)::INT)::DOUBLE))), 0.0::DOUBLE)"
    share = lambda a, b: f"CASE WHEN len({a}) = 0 THEN {{}} ELSE round({weigh.format(f'list_filter({a}, lambda t: list_contains({b}, t))')} / {weigh.format(a)}, 6) END"
    own = f"SELECT question_id, {asked.format(sql.tokens('question'))} AS q, {sql.tokens('draft')} AS d, {asked.format(sql.tokens('draft'))} AS dl, {sql.tokens('question')} AS qa, {sql.tokens('before')} AS p, (question IS NOT NULL)::INT + (draft IS NOT NULL)::INT + (before IS NOT NULL)::INT AS n FROM ({_EXCHANGES})"
    vectors = "SELECT b.item_id::VARCHAR AS question_id, e.embedding AS q FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id"
    cosine = "list_cosine_similarity(q::DOUBLE[], embedding::DOUBLE[])"
    greeting = "|".join(NO_CLAIM).replace("'", "''")
    claim = f"NOT regexp_matches({sql.normalize('sentence')}, '{greeting}') AND len({sql.tokens('sentence')}) >= 2"
    chunked = sql.chunks(_plain_sentences("doc_id, text", "text", "SELECT doc_id::VARCHAR AS doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL"))
    begun = lambda asked: f"WITH RECURSIVE {chunked}, {sql.bm25('SELECT chunk_id, text FROM chunked', asked)}"
    echoed = r"SELECT question_id, CASE WHEN body <> '' THEN body ELSE text END AS draft FROM (SELECT question_id, text, trim(regexp_replace(text, '^(?:[^\S\n]*(?:#[^\n]*)?(?:\n|$))+', ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM evidence WHERE rank = 1)"
    scripted = f"SELECT question_id, coalesce(trim(draft, ' ' || chr(9) || chr(10) || chr(13)), 'INSUFICIENTE') AS draft FROM ({_EXCHANGES}) WHERE question_id IN (SELECT question_id FROM evidence)"
    decided = f"{begun(ITEMS)}, {sql.checks(echoed, _plain_sentences, claim)}, {sql.decisions(ITEMS)}"
    talked = f"SELECT question_id, question FROM ({_EXCHANGES})"
    conversed = f"{begun(talked)}, {sql.checks(scripted, _plain_sentences, claim)}, {sql.decisions(talked)}"
    sent = f"SELECT question_id AS message_id, question AS text, question_id || CASE WHEN split_part(question_id, '/', 1)::BIGINT % 7 = 0 THEN '@g.us' ELSE '@s.whatsapp.net' END AS sender FROM ({_EXCHANGES})"
    letters = "[1.0::DOUBLE, " + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '')))::DOUBLE" for c in "aent") + "]"
    suite = sql.suite(_plain_sentences, claim, probes.TEMPLATES, probes.NOTES)
    probed = "SELECT probe_id AS question_id, question FROM suite"
    tried = r"SELECT probe_id AS question_id, trim(candidate, ' ' || chr(9) || chr(10) || chr(13)) AS draft FROM suite WHERE probe_id IN (SELECT question_id FROM evidence)"
    packed = " UNION ALL ".join("SELECT '{0}:{1}' AS question_id, '{0}' AS pack, {1} AS pos, '{2}' AS question".format(n, i, x.replace("'", "''")) for n in readers.available_packs() for i, x in enumerate(readers.load_pack(n)))
    return {
        "normalize_text": f"SELECT doc_id, {sql.normalize('text')} AS normalized FROM documents",
        "tokenize_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({sql.tokens('text')}) AS token FROM documents) GROUP BY token",
        "sentence_split": f"SELECT doc_id, (generate_subscripts(sentences, 1) - 1)::INTEGER AS pos, unnest(sentences) AS sentence FROM ({_plain_sentences('doc_id', 'text', 'SELECT * FROM documents')})",
        "extract_numbers": f"SELECT doc_id, (generate_subscripts(numbers, 1) - 1)::INTEGER AS pos, unnest(numbers) AS number FROM (SELECT doc_id, {sql.figures('text')} AS numbers FROM documents)",
        "chunks": f"WITH RECURSIVE {chunked} SELECT chunk_id, doc_id, start, \"end\", sha256(text) AS text_sha256 FROM chunked",
        "prompts": f"{begun(ITEMS)}, {sql.checks(echoed, _plain_sentences, claim)} {sql.prompts(ITEMS)}",
        "strict_verdicts": f"{begun(talked)}, {sql.checks(scripted, _plain_sentences, claim, 4, 0.8, 0.7, 0.5)}, {sql.decisions(talked, 0.5, 0.6, 1, 'refuse')} SELECT question_id, action, verdict, confidence FROM decided",
        "handoff_notes": f"{conversed}, {sql.notes()}",
        "webhook_replies": f"{conversed}, {sql.replies(sent)}",
        "webhook_shapes": "SELECT event_id::VARCHAR AS message_id, CASE WHEN event_id % 8 = 7 THEN '' ELSE event_type || ' ' || event_id END AS text, event_id % 8 <> 7 AS actionable FROM events",
        "questions_file": r"SELECT question_id, question FROM (SELECT lpad((row_number() OVER (ORDER BY item_id) - 1)::VARCHAR, 9, '0') AS question_id, trim(regexp_replace(coalesce(text, ''), '[\r\n]+', ' ', 'g'), ' ' || chr(9)) AS question FROM benchmark) WHERE question <> '' AND NOT starts_with(question, '#')",
        "embedded_topk": f"""WITH RECURSIVE {chunked}, {sql.bm25('SELECT chunk_id, text FROM chunked', ITEMS)},
peaks AS (SELECT question_id, max(score) AS peak FROM scores GROUP BY question_id),
dense AS (SELECT question_id, chunk_id, greatest(list_cosine_similarity({letters.format('question')}, {letters.format('text')}), 0) AS dense FROM ({ITEMS}), chunked),
blend AS (SELECT d.question_id, d.chunk_id, round(0.65::DOUBLE * coalesce(s.score / p.peak, 0) + 0.35::DOUBLE * dense, 9) AS score FROM dense d LEFT JOIN scores s ON s.question_id = d.question_id AND s.chunk_id = d.chunk_id LEFT JOIN peaks p ON p.question_id = d.question_id)
{_RANKED.format(score='round(score, 5)', table='blend')}""",
        "audit_lines": f"{decided}, {sql.audit()}",
        "claim_support": f"{begun(ITEMS)}, {sql.checks('SELECT question_id, question AS draft FROM (' + ITEMS + ')', _plain_sentences, claim)} SELECT question_id, pos::INTEGER AS pos, supported, round(support_score, 6) AS support_score, supporting_chunk_ids, unsupported_numbers, reason FROM checked",
        "answers": f"{decided} SELECT * FROM decided",
        "conversation_verdicts": f"{begun(talked)}, {sql.checks(scripted, _plain_sentences, claim)}, {sql.decisions(talked)} SELECT question_id, action, verdict, confidence FROM decided",
        "audit_by_action": f"{decided} SELECT count(*) AS questions, count(*) FILTER (WHERE action = 'answer') AS answered, count(*) FILTER (WHERE action <> 'answer') AS blocked, coalesce(count(*) FILTER (WHERE action <> 'answer') / nullif(count(*), 0)::DOUBLE, 0.0::DOUBLE) AS block_rate FROM decided",
        "probe_suite": f"WITH RECURSIVE {chunked}, {suite} SELECT * FROM suite",
        "probe_report": f"WITH RECURSIVE {chunked}, {suite}, {sql.bm25('SELECT chunk_id, text FROM chunked', probed)}, {sql.checks(tried, _plain_sentences, claim)}, {sql.decisions(probed)}, {sql.tally()}",
        "bm25_index_stats": f"WITH {bm25} SELECT term, df, round(idf, 6) AS idf FROM terms",
        "bm25_topk": f"WITH {bm25} {_RANKED.format(score='round(score / peak, 6)', table='scores')}",
        "dense_topk": f"SELECT question_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT question_id, vec_id::VARCHAR AS chunk_id, round({cosine}, 6) AS score FROM ({vectors}), embeddings)) WHERE rank <= 4",
        "hybrid_topk": f"""WITH {bm25},
peaks AS (SELECT question_id, max(score) AS peak FROM scores GROUP BY question_id),
dense AS (SELECT question_id, vec_id::VARCHAR AS chunk_id, greatest({cosine}, 0) AS dense FROM ({vectors}), embeddings),
lexical AS (SELECT s.question_id, chunk_id, CASE WHEN peak > 0 THEN score / peak ELSE 0 END AS lexical FROM scores s JOIN peaks p ON s.question_id = p.question_id),
blend AS (SELECT coalesce(d.question_id, l.question_id) AS question_id, coalesce(d.chunk_id, l.chunk_id) AS chunk_id, round(0.65::DOUBLE * coalesce(lexical, 0) + 0.35::DOUBLE * coalesce(dense, 0), 9) AS score FROM dense d FULL JOIN lexical l ON d.question_id = l.question_id AND d.chunk_id = l.chunk_id)
{_RANKED.format(score='round(score, 5)', table='blend')}""",
        "checkable_claims": f"SELECT question_id, pos, {claim} AS checkable FROM (SELECT question_id, generate_subscripts(sentences, 1) - 1 AS pos, unnest(sentences) AS sentence FROM ({_plain_sentences('question_id', 'draft', _EXCHANGES)}))",
        "turn_relevance": f"SELECT question_id, {share('q', 'd').format('1.0::DOUBLE')} AS relevance FROM ({own})",
        "turn_coverage": f"SELECT question_id, {share('dl', 'qa').format('0.0::DOUBLE')} AS coverage FROM ({own})",
        "webhook_parse": "SELECT event_type AS text, user_id || CASE WHEN event_id % 7 = 0 THEN '@g.us' ELSE '@s.whatsapp.net' END AS sender, 'main' AS instance, event_id::VARCHAR AS message_id, event_type AS sender_name, event_id % 7 = 0 AS is_group, event_id % 7 <> 0 AND trim(event_type) <> '' AS actionable FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 1",
        "mask_identifier": "SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN c_name ELSE repeat('*', length(c_name) - 4) || right(c_name, 4) END || '@s.whatsapp.net' AS masked FROM customer",
        "mask_secret": "SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) <= 4 THEN repeat('*', length(c_custkey::VARCHAR)) ELSE repeat('*', length(c_custkey::VARCHAR) - 4) || right(c_custkey::VARCHAR, 4) END AS masked FROM customer",
        "packs": f"WITH {sql.bm25(DOCS, f'SELECT question_id, question FROM ({packed})')} SELECT p.pack, p.pos::INTEGER AS pos, p.question AS statement, (SELECT count(*) FROM scores s WHERE s.question_id = p.question_id) AS documents FROM ({packed}) p",
    }
