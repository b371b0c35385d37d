"""One query per operator, over whole tables; and the SQL that says the same."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chat, chroma, divergence, fingerprint, merkle, mixing, ngram_join, quality, spm, substrings, suffix_dedup, tokens, warc
from .common import staged

#: A conversation whose texts are control strings of the template.
PLANTED = "</s>[INST] ok [/INST]"
WEIGHTS = [5.0, 2.0, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf_dir, "documents"), 4, "0.85")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string")
    said = said.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted)
    place = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    messages = said.select(F.col("conv_id").alias("tree_id"), F.row_number().over(place).cast("long").alias("message_id"), "role", "text").withColumn("parent_id", F.when(F.col("message_id") > 1, F.col("message_id") - 1)).withColumn("score", F.lit(0.0))
    paths = chat.formatted(chat.branches(messages)).where("rank = 1").withColumnRenamed("tree_id", "conv_id")
    return chat.read_back(paths, "conv_id")


OP2_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length(regexp_replace(role, '(<</|<<|</|<|\[/|\[)(\\*)(s>|INST\]|SYS>>)', '\1\\\2\3', 'g')) + length(regexp_replace(text, '(<</|<<|</|<|\[/|\[)(\\*)(s>|INST\]|SYS>>)', '\1\\\2\3', 'g'))) AS BIGINT) AS formatted_chars
FROM said GROUP BY conv_id
"""


OP1_SQL = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM base
), tokens AS (
  SELECT row, len(s) AS n, unnest(s) AS token FROM sets
), near AS (
  SELECT a.row AS a, b.row AS b FROM tokens a JOIN tokens b ON a.token = b.token AND a.row <> b.row
  GROUP BY a.row, b.row HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT row AS a, row AS b FROM sets UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(min(t.doc_id), s.doc_id) AS component_id FROM sets s JOIN reach r ON r.a = s.row JOIN sets t ON t.row = r.b GROUP BY s.row, s.doc_id, s.s
""".replace("\\\\", "\\")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.binary_token_digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
  SELECT row, p, md5(b[p + 1 : p + 200]) AS m FROM (SELECT row, b, unnest(range(0, octet_length(b) - 199)) AS p FROM d)
), hit AS (
  SELECT row, p, p > lag(p) OVER (PARTITION BY row ORDER BY p) + 200 AS apart FROM (SELECT row, p, count(*) OVER (PARTITION BY m) AS n FROM windows) WHERE n > 1
), runs AS (
  SELECT row, min(p) AS low, max(p) + 200 AS high FROM (SELECT row, p, count(*) FILTER (WHERE apart) OVER (PARTITION BY row ORDER BY p) AS run FROM hit) GROUP BY row, run
), pieces AS (
  SELECT row, low, high, coalesce(lag(high) OVER (PARTITION BY row ORDER BY low), 0) AS before FROM runs
), kept AS (
  SELECT d.row, sum(high - low) AS n_removed, count(*) AS n_spans, string_agg(hex(b[before + 1 : low]), '' ORDER BY low) || any_value(hex(b[last + 1 : octet_length(b)])) AS rest
  FROM d JOIN pieces p ON d.row = p.row JOIN (SELECT row, max(high) AS last FROM runs GROUP BY row) l ON l.row = d.row GROUP BY d.row
)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(unhex(rest), b)) AS kept_sha256
FROM d LEFT JOIN kept k ON k.row = d.row
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(docs, model)
    return found.select("doc.doc_id", quality.held_out(F.col("doc.doc_id")).alias("held_out"), "score", "predicted")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.sampled_copies(table(spark, sf_dir, "documents"), WEIGHTS)
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.pieces(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).drop("ids")


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = chroma.with_melodies(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    prints = staged(chroma.fingerprints(media, "vec_id", "audio"), "prints")
    known = staged(chroma.classes(prints, "vec_id"), "classes")
    found = chroma.best_alignments(known, "vec_id")
    row = known.select("vec_id", "class_id", "digest", F.size("prints").cast("long").alias("n_prints"))
    return row.join(found, F.col("digest") == F.col("query_digest"), "left").drop("query_id", "digest", "query_digest")


OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('17:' || doc_id), 1, 15))::BIGINT AS mixed FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM base GROUP BY source
), weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM sizes
), levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, source) AS n FROM weighed
), chosen AS (
  SELECT min_by(level, n) AS level FROM levels WHERE level * weight < cap
), aim AS (
  SELECT source, source_size, CASE WHEN c.level IS NULL THEN cap ELSE least(cap, weight * c.level) END AS target FROM levels, chosen c
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS rate FROM aim
), runs AS (
  SELECT b.doc_id, b.size, b.source, r.source_size, r.target, r.rate, r.rate * row_number() OVER (PARTITION BY b.source ORDER BY b.size, b.mixed, b.doc_id) AS till
  FROM base b JOIN rates r ON b.source IS NOT DISTINCT FROM r.source
), firsts AS (
  SELECT source, i, ('0x' || substr(md5((17 + i) || ':' || coalesce(source, '')), 1, 15))::BIGINT % 16777216 AS first FROM aim, range(16) t(i)
), tried AS (
  SELECT f.source, f.i, f.first, abs(sum(size * ((till + first) // 16777216 - (till - rate + first) // 16777216)) - any_value(target)) AS off
  FROM runs r JOIN firsts f ON r.source IS NOT DISTINCT FROM f.source GROUP BY ALL
), best AS (
  SELECT source, arg_min(first, (off, i)) AS first FROM tried GROUP BY source
)
SELECT doc_id, size, source_size, target, ((till + first) // 16777216 - (till - rate + first) // 16777216) * size AS taken
FROM runs r JOIN best b ON r.source IS NOT DISTINCT FROM b.source
""".replace("\\\\", "\\")


def document_manifest(docs: DataFrame, height: int = 4) -> DataFrame:
    """The manifest of documents, one tree a language, with a check of the lower-cased ones.

    A document whose doc_id has a crc32 that 3 divides is checked with its text's A-Z lower-cased;
    a row without a doc_id is not tampered with.
    """
    of = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, of(low))
    rows = docs.select("doc_id", "lang", of(F.col("text")).alias("leaf"), tampered.alias("claimed"))
    return merkle.manifest(rows, "doc_id", "lang", claimed="claimed", height=height).drop("lang")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"))


#: A field of a leaf, and crc32 of a decimal number bit by bit, as DuckDB has no such function.
_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) ELSE xor(r >> 1, (r & 1) * 3988292384) END))"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
OP11_SQL = f"""
WITH RECURSIVE made AS (
  SELECT row_number() OVER () AS row, doc_id, lang, {_LEAF.format('text')} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC.format('doc_id')} % 3 = 0 THEN {_LEAF.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS claimed FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, row) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS size FROM made
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS d, size FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM nodes WHERE size > 1 GROUP BY lang, level, pos // 8
), subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS size FROM nodes WHERE size = 1
), tops AS (
  SELECT 0 AS level, pos, subroot AS d, size FROM subroots
  UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(d, '' ORDER BY pos)), (any_value(size) + 7) // 8 FROM tops WHERE size > 1 GROUP BY level, pos // 8
), low AS (
  SELECT l.row, string_agg(n.d, '' ORDER BY n.level, n.pos) AS others FROM leaves l JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.size > 1 AND n.pos // 8 = (l.pos >> (3 * n.level)) // 8 AND n.pos <> l.pos >> (3 * n.level) GROUP BY l.row
), high AS (
  SELECT s.pos, string_agg(t.d, '' ORDER BY t.level, t.pos) AS others FROM subroots s JOIN tops t ON t.size > 1 AND t.pos // 8 = (s.pos >> (3 * t.level)) // 8 AND t.pos <> s.pos >> (3 * t.level) GROUP BY s.pos
), folds AS (
  SELECT row, lang, 0 AS level, pos, coalesce(claimed, leaf) AS d, size FROM leaves
  UNION ALL SELECT f.row, f.lang, f.level + 1, f.pos // 8, sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.d ELSE n.d END, '' ORDER BY n.pos)), (any_value(n.size) + 7) // 8
  FROM folds f JOIN nodes n ON n.lang IS NOT DISTINCT FROM f.lang AND n.level = f.level AND n.pos // 8 = f.pos // 8 AND n.size > 1 GROUP BY f.row, f.lang, f.level, f.pos
), ends AS (
  SELECT f.row, 0 AS level, s.pos, f.d, s.size FROM folds f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang WHERE f.size = 1
  UNION ALL SELECT e.row, e.level + 1, e.pos // 8, sha256(string_agg(CASE WHEN t.pos = e.pos THEN e.d ELSE t.d END, '' ORDER BY t.pos)), (any_value(t.size) + 7) // 8
  FROM ends e JOIN tops t ON t.level = e.level AND t.pos // 8 = e.pos // 8 AND t.size > 1 GROUP BY e.row, e.level, e.pos
)
SELECT l.doc_id, l.leaf, s.subroot, r.d AS root, sha256(coalesce(w.others, '') || coalesce(h.others, '')) AS proof_sha256, e.d AS folded_root, e.d = r.d AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops r ON r.size = 1 JOIN ends e ON e.row = l.row AND e.size = 1 LEFT JOIN low w ON w.row = l.row LEFT JOIN high h ON h.pos = s.pos
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), said AS (
  SELECT row, lang, source, unnest(w) AS term FROM base
), kept AS (
  SELECT lang, term FROM said GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), groups AS (
  SELECT DISTINCT lang, source FROM base
), counts AS (
  SELECT s.lang, s.source, s.term, count(*) AS n FROM said s JOIN kept k ON k.lang = s.lang AND k.term = s.term GROUP BY s.lang, s.source, s.term
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT *, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::BIGINT AS p FROM dense WINDOW w AS (PARTITION BY lang, source)
), langs AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER w + count(*) OVER w))::BIGINT AS q FROM (SELECT lang, term, sum(n) AS n FROM dense GROUP BY lang, term) WINDOW w AS (PARTITION BY lang)
), pairs AS (
  SELECT g.lang, g.source, h.source AS item, coalesce(v.value, 0) AS value FROM groups g JOIN groups h ON h.lang = g.lang AND h.source <> g.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
  ) v ON v.lang = g.lang AND v.source = g.source AND v.item = h.source
), terms AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q
), found AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms
), placed AS (
  SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM found
)
SELECT * FROM placed WHERE part = 'pair' OR rank <= 200
""".replace("\\\\", "\\")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP13_SQL = """
WITH base AS (
  SELECT row_number() OVER () AS row, page_id, coalesce(html, '') AS body FROM pages
), placed AS (
  SELECT page_id, body, sha1(body) AS h, row_number() OVER w AS n, first_value(page_id) OVER w AS first FROM base WINDOW w AS (PARTITION BY body ORDER BY page_id DESC NULLS LAST, row DESC)
)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, i // 8 * 10 + 1, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31), 1)), '') AS payload_digest,
  CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN n > 1 THEN first END AS refers_to
FROM placed
"""


def queries() -> dict:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_token_binary": op3_token_binary,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality": op5_quality,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_mixing": op7_mixing,
        "op8_fingerprints": op8_fingerprints,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_chroma": op10_chroma,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_source_divergence": op12_source_divergence,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_join": OP1_SQL, "op2_chat_formatting": OP2_SQL, "op4_suffix_dedup": OP4_SQL, "op7_mixing": OP7_SQL, "op11_merkle_manifest": OP11_SQL, "op12_source_divergence": OP12_SQL, "op13_warc": OP13_SQL}
