"""The registered queries of the operators, as thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import bpe_stream, chat, conversation_repair, decontam, graph_dedup, langid, pii, quality_crf, secret_scan, shuffle_shards, simhash, source_audit, token_files
from scoreloom.llm.shared import held_out, new_folder

BYTE_BPE, WORD_BPE = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Speaks the template's own control strings, to show that they come back as text.
TRAP = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRAP).alias("text"))
    turns = rows.union(extra).withColumn("parts", chat.linked_parts(F.col("text")))
    return chat.conversation_digest(chat.format_turns(turns))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    field = quality_crf.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_crf.score_documents(docs, field).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= quality_crf.ACCEPT).cast("int").alias("predicted"))


def op4_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = shuffle_shards.shuffled_shards(records, 40).select("doc_id", "text", "shard", "slot")
    shuffle_shards.write_shards(placed, path := new_folder(spark, "shards"))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    written = spark.read.schema(placed.schema).parquet(path)
    return written.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_dictionaries(docs)).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op6_graph_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op7_spaced_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(_table(spark, sf_dir, "documents"), BYTE_BPE, 2).withColumnRenamed("id", "doc_id")


def op9_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.round_trip_digest(_table(spark, sf_dir, "documents"), WORD_BPE).withColumnRenamed("id", "doc_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    return conversation_repair.repair_digest(conversation_repair.repair(conversation_repair.damaged(turns)), turns)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.find_secrets(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_pii_anchors": op2_pii_anchors,
    "op3_quality_crf": op3_quality_crf,
    "op4_shuffle_shards": op4_shuffle_shards,
    "op5_compression_langid": op5_compression_langid,
    "op6_graph_near_dedup": op6_graph_near_dedup,
    "op7_spaced_seed_decontam": op7_spaced_seed_decontam,
    "op8_token_files": op8_token_files,
    "op9_bpe_stream": op9_bpe_stream,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_divergence": op12_source_divergence,
    "op13_secret_scan": op13_secret_scan,
}
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(15 + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + length(replace(replace(plain, '\', '\\'), '<', '\l')) + marks)::BIGINT AS formatted_chars,
            sum(len(links))::BIGINT AS n_attachments, sum(255 * images + 800 * documents)::BIGINT AS expanded_tokens
        FROM (
            SELECT *, regexp_replace(text, '!\[[^\]\n]*\]\([^()\s]+\)', '', 'g') AS plain, len(links) - audios - documents AS images,
                -- <part KIND PLACE>: links stand at the odd places of a message.
                9 * len(links) + 5 * (len(links) - audios - documents) + 5 * audios + 8 * documents - len(links)
                    + coalesce(list_sum([length((2 * i + 1)::VARCHAR) for i in range(len(links))]), 0) AS marks
            FROM (
                SELECT *, len(list_filter(links, lambda x: regexp_matches(lower(x), '\.(mp3|wav|ogg|flac)\)$'))) AS audios,
                    len(list_filter(links, lambda x: regexp_matches(lower(x), '\.(pdf|docx?|txt|md)\)$'))) AS documents
                FROM (SELECT *, regexp_extract_all(text, '!\[[^\]\n]*\]\([^()\s]+\)') AS links FROM turns)))
        GROUP BY conv_id""",
    # Brute force: every pair of one label, and components by closure.
    "op6_graph_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
        fine AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
        links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
        reached AS (SELECT vec_id AS a, vec_id AS root FROM v UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.root)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept, 1.0::DOUBLE AS audited_recall
        FROM v JOIN (SELECT a, min(root) AS c FROM reached GROUP BY a) x ON x.a = v.vec_id LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) y ON y.a = v.vec_id""",
    # The program read forwards: the cheapest and least edits that leave each state, a turn at a time.
    "op11_conversation_repair": r"""
        WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
        -- CRC-32 byte by byte: a byte is taken in, then eight bits are shifted out (-1).
        kinds AS (SELECT key, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(key, '')])),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384::BIGINT) ELSE a // 2 END)) % 20 AS kind FROM (SELECT DISTINCT key FROM keyed)),
        hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM keyed JOIN kinds USING (key), LATERAL (SELECT unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END))) WHERE kind <> 0),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
        said AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS tail, left(role, 1) AS c FROM placed),
        faults AS (SELECT *, CASE WHEN tail = '' THEN 1 WHEN nth > 1 THEN 2 WHEN tail NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
                lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c NOT IN ('su', 'ua', 'au') AS illegal FROM said),
        sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
                count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM faults GROUP BY conv_id),
        -- The cheapest edits up to a turn that leave each state, with the least audit; a struct is compared by its fields in order.
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, {'x': 0::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s0, {'x': 999999999::BIGINT, 'a': '', 't': []::VARCHAR[]} AS s1, {'x': 3::BIGINT, 'a': 'I', 't': ['user:']} AS s2, {'x': 6::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']} AS s3 FROM sums
            UNION ALL
            SELECT conv_id, i, s0, s1, least(s2, {'x': s0.x + 3, 'a': s0.a || 'I', 't': s0.t || ['user:']}, {'x': s1.x + 3, 'a': s1.a || 'I', 't': s1.t || ['user:']}, {'x': s3.x + 3, 'a': s3.a || 'I', 't': s3.t || ['user:']}),
                least(s3, {'x': s2.x + 3, 'a': s2.a || 'I', 't': s2.t || ['assistant:']}, {'x': s0.x + 6, 'a': s0.a || 'II', 't': s0.t || ['user:', 'assistant:']}, {'x': s1.x + 6, 'a': s1.a || 'II', 't': s1.t || ['user:', 'assistant:']})
            FROM (
                SELECT f.conv_id, f.i, {'x': s0.x + 4, 'a': s0.a || 'D', 't': s0.t} AS s0,
                    least({'x': s1.x + 4, 'a': s1.a || 'D', 't': s1.t}, {'x': s0.x + keep + CASE c WHEN 's' THEN 0 ELSE 999999 END, 'a': s0.a || 'K', 't': s0.t || own}) AS s1,
                    least({'x': s2.x + 4, 'a': s2.a || 'D', 't': s2.t},
                        {'x': s0.x + keep + CASE c WHEN 'u' THEN 0 ELSE 999999 END, 'a': s0.a || 'K', 't': s0.t || own}, {'x': s1.x + keep + CASE c WHEN 'u' THEN 0 ELSE 999999 END, 'a': s1.a || 'K', 't': s1.t || own}, {'x': s3.x + keep + CASE c WHEN 'u' THEN 0 ELSE 999999 END, 'a': s3.a || 'K', 't': s3.t || own},
                        {'x': s0.x + keep + 3, 'a': s0.a || 'R', 't': s0.t || ['user:' || text]}, {'x': s1.x + keep + 3, 'a': s1.a || 'R', 't': s1.t || ['user:' || text]}, {'x': s3.x + keep + 3, 'a': s3.a || 'R', 't': s3.t || ['user:' || text]}) AS s2,
                    least({'x': s3.x + 4, 'a': s3.a || 'D', 't': s3.t}, {'x': s2.x + keep + CASE c WHEN 'a' THEN 0 ELSE 999999 END, 'a': s2.a || 'K', 't': s2.t || own}, {'x': s2.x + keep + 3, 'a': s2.a || 'R', 't': s2.t || ['assistant:' || text]}) AS s3
                FROM (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 3 ELSE 999999 END AS keep, [role || ':' || text] AS own FROM faults) f JOIN walk w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = w.i + 1)),
        best AS (SELECT w.conv_id, least(s0, s3) AS s FROM walk w JOIN sums z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = z.n)
        SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
            coalesce(s.x, 0)::BIGINT AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(array_to_string(s.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sums z ON z.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM k.conv_id""",
    "op12_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms, row_number() OVER () AS nr FROM documents),
        t AS (SELECT nr, lang, source, unnest(terms) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT nr) >= 30),
        groups AS (SELECT DISTINCT lang, source FROM d),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
        own AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
        total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY ALL),
        p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
                1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (coalesce(s.total, 0) + 5 * v.v) AS p,
                1 + (1000000000::HUGEINT * (k.n + 5)) // (v.total + 5 * v.v) AS q
            FROM groups g JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term
            LEFT JOIN total s ON s.lang = g.lang AND s.source = g.source),
        gaps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        listed AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM listed QUALIFY part = 'pair' OR rank <= 50""",
    # Where a match starts is the length of all that stands before it, between and in the matches.
    "op13_secret_scan": r"""
        WITH rules(kind, nr, base, pattern, least) AS (VALUES
            ('assign', 0, true, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0), ('access', 1, true, 'AKIA[A-Z0-9]+', 20), ('hex', 2, true, '[0-9a-f]+', 24),
            ('hub', 3, false, 'gh[oprsu]_[A-Za-z0-9]+', 40), ('chat', 4, false, 'xox[abprs]-([0-9]+-)+[A-Za-z0-9]+', 24), ('pem', 5, false, '-----BEGIN ([A-Z]+ )*PRIVATE KEY-----', 0)),
        d AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
        found AS (SELECT d.nr AS doc, r.*, regexp_extract_all(text, r.pattern) AS hits, string_split_regex(text, r.pattern) AS gaps FROM d CROSS JOIN rules r),
        each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM found),
        spans AS (SELECT doc, kind, nr, base, hits[i] AS hit, least, list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0) AS start FROM each),
        kept AS (SELECT *, kind || ':' || start::BIGINT || ':' || (start + length(hit))::BIGINT AS span FROM spans
            WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(hit, '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?', '')) >= 6 ELSE length(hit) >= least END),
        sums AS (SELECT doc, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
                string_agg(span, ',' ORDER BY start, nr) FILTER (base) AS own, string_agg(span, ',' ORDER BY start, nr) AS spans FROM kept GROUP BY doc)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM d LEFT JOIN sums ON sums.doc = d.nr""",
}
