"""Queries over the driver's tables, one for each training-data operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flac, lines, minhash, packing, pieces, quality, suffix_dedup, tools, topk, toxicity
from .common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 50)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read(flac.store(table(spark, sf_dir, "documents")))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.topk(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: What a tool of the query below takes: field to (JSON type, required).
SCHEMAS = {"search": {"limit": ("integer", True), "query": ("string", True)}}


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a user is a call, the assistant's turn after it the result; a call depends on that about half way back.

    One row a call: assistant turns that follow no user turn, and repeated ones beyond the least, have no row
    (``tools.orphans`` returns such results).
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    half = F.floor(F.col("turn") / 2)
    users = turns.filter("role = 'user'")
    limit = F.length("text") % 50
    arguments = F.to_json(F.struct(F.when(limit % 7 != 0, limit).alias("limit"), F.col("text").alias("query")))
    there = users.select("conv_id", F.col("turn").alias("back")).distinct()
    back = users.select("conv_id", "turn", F.explode(F.array(half, half - 1)).alias("back")).filter("back < turn").join(there, ["conv_id", "back"]).groupBy("conv_id", "turn").agg(F.collect_set(name(F.col("back"))).alias("depends_on"))
    calls = users.join(back, ["conv_id", "turn"], "left").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("search").alias("name"), arguments.alias("arguments"), "depends_on")
    results = turns.filter("role = 'assistant'").select("conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    linked = tools.link(calls, results, SCHEMAS)
    return linked.select("conv_id", "turn", "call_id", F.col("level").cast("long").alias("level"), "status", F.array_join("errors", ",").alias("errors"), F.sha2(F.col("json").cast("binary"), 256).alias("json_sha256"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_digests(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_media, op3_topk, op4_quality, op5_line_dedup, op6_tool_calls, op7_pieces, op8_toxicity, op9_near_dedup, op10_packing)}

ORACLE_SQL = {
    "op3_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_line_dedup": r"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
        m AS (SELECT doc_id, n, line, trim(regexp_replace(regexp_replace(line, '(^|\s)[^\s\d@]*[\d@]\S*', '\1<*>', 'g'), '\s+', ' ', 'g')) AS t FROM l),
        p AS (SELECT *, string_split(t, ' ') AS w FROM m WHERE t <> '' AND len(string_split(t, ' ')) >= 3),
        o AS (SELECT t, any_value(w) AS w, count(DISTINCT doc_id) AS docs FROM p GROUP BY t),
        s AS (SELECT t, len(w) AS size, w[:3] AS lead, docs, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM o),
        c AS (SELECT size, lead, pos, word FROM s WHERE word <> '<*>' AND pos > 3 GROUP BY ALL HAVING sum(docs) >= 5),
        h AS (SELECT s.t, count(*) AS kept, string_agg(s.pos || ':' || s.word, ' ' ORDER BY s.pos) AS path FROM s JOIN c ON s.size = c.size AND s.lead = c.lead AND s.pos = c.pos AND s.word = c.word GROUP BY s.t),
        g AS (SELECT o.t, len(w) AS size, w[:3] AS lead, coalesce(path, '') AS path FROM o LEFT JOIN h ON o.t = h.t WHERE len(list_filter(w[:3], lambda x: x <> '<*>')) + coalesce(kept, 0) >= 0.7 * len(w) - 1e-9),
        q AS (SELECT p.doc_id, p.n, g.size, g.lead, g.path FROM p JOIN g ON p.t = g.t),
        r AS (SELECT size, lead, path, min(doc_id) AS first_doc FROM q GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5),
        f AS (SELECT q.size, q.lead, q.path, q.doc_id, min(q.n) AS first_line FROM q JOIN r ON q.size = r.size AND q.lead = r.lead AND q.path = r.path AND q.doc_id = r.first_doc GROUP BY ALL),
        d AS (SELECT q.doc_id, q.n FROM q JOIN f ON q.size = f.size AND q.lead = f.lead AND q.path = f.path WHERE NOT (q.doc_id = f.doc_id AND q.n = f.first_line)),
        k AS (SELECT m.doc_id, count(*) AS n_lines, count(d.n) AS n_dropped, coalesce(string_agg(CASE WHEN d.n IS NULL THEN m.line END, chr(10) ORDER BY m.n), '') AS kept
              FROM m LEFT JOIN d ON m.doc_id = d.doc_id AND m.n = d.n GROUP BY m.doc_id)
        SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM k""",
    "op6_tool_calls": """
        WITH RECURSIVE u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
        e AS (SELECT DISTINCT a.conv_id, a.turn, b.turn AS back FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn IN (a.turn // 2, a.turn // 2 - 1) AND b.turn < a.turn),
        w(conv_id, turn, level) AS (SELECT conv_id, turn, 0 FROM u UNION SELECT e.conv_id, e.turn, w.level + 1 FROM w JOIN e ON e.conv_id = w.conv_id AND e.back = w.turn),
        v AS (SELECT conv_id, turn, max(level) AS level FROM w GROUP BY conv_id, turn),
        c AS (SELECT u.conv_id, u.turn, concat('c', u.conv_id, '-', u.turn) AS call_id, v.level, a.text AS content, u.text, length(u.text) % 50 AS n,
                     CASE WHEN a.turn IS NULL THEN 'missing_result' ELSE 'ok' END AS status
              FROM u JOIN v ON u.conv_id = v.conv_id AND u.turn = v.turn LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')
        SELECT conv_id, turn, call_id, CAST(level AS BIGINT) AS level, status, CASE WHEN n % 7 = 0 THEN 'limit:missing' ELSE '' END AS errors,
               sha256(concat('{"arguments":{', CASE WHEN n % 7 <> 0 THEN concat('"limit":', n, ',') ELSE '' END, '"query":', CAST(to_json(text) AS VARCHAR), '},"id":"', call_id, '","level":', level,
                      ',"name":"search"', CASE WHEN status = 'ok' THEN concat(',"result":', CAST(to_json(content) AS VARCHAR)) ELSE '' END, ',"status":"', status, '"}')) AS json_sha256
        FROM c""",
}
