"""The registered queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fim, html_text, langid, lexical, media, minhash, packing, pieces, pitman_yor, quality, secrets, tool_calls
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""


@query
def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.dialogue_traffic(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, tool_calls.REPLY)


ORACLES["op4_tool_call_linking"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS after_id
  FROM conversations WHERE role = 'user'
), r AS (
  SELECT conv_id, turn, text AS content, conv_id || ':' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant'
), l(call_id, level) AS (
  SELECT call_id, 0::BIGINT FROM c WHERE after_id NOT IN (SELECT call_id FROM c)
  UNION ALL
  SELECT c.call_id, l.level + 1 FROM c JOIN l ON c.after_id = l.call_id
), both_sides AS (
  SELECT c.conv_id, c.call_id, c.turn, CASE WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, l.level,
         1::BIGINT AS copies, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, length(c.text) > 0 AS valid,
         CASE WHEN length(c.text) > 0 THEN NULL ELSE 'prompt breaks minLength' END AS error,
         json_object('arguments', json_object('prompt', c.text, 'turn', c.turn), 'id', c.call_id, 'level', l.level, 'name', 'reply', 'result', r.content)::VARCHAR AS record
  FROM c JOIN l USING (call_id) LEFT JOIN r USING (call_id)
  UNION ALL
  SELECT r.conv_id, r.call_id, r.turn, 'orphan', NULL, 0, 1, false, NULL,
         json_object('arguments', NULL, 'id', r.call_id, 'level', NULL, 'name', NULL, 'result', r.content)::VARCHAR
  FROM r WHERE r.call_id NOT IN (SELECT call_id FROM c)
)
SELECT * FROM both_sides
"""


@query
def tool_calls_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on messages in JSON: each conversation numbers its calls from call_0, so identifiers recur in all of
    them, and every fourth call comes after two others."""
    rows = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    number = lambda back: F.concat(F.lit("call_"), (F.col("turn") - back).cast("string"))
    after = F.when(F.col("turn") % 8 == 0, F.array(number(2), number(4))).otherwise(F.array(number(2)))
    call = F.struct(number(0).alias("id"), after.alias("after"), F.lit("reply").alias("name"), F.to_json(F.struct(F.col("text").alias("prompt"), "turn")).alias("arguments"))
    calls = rows.where("role = 'user'").select("conv_id", "turn", F.lit("assistant").alias("role"), F.to_json(F.struct(F.array(call).alias("tool_calls"))).alias("text"))
    results = rows.where("role = 'assistant'").select("conv_id", "turn", F.lit("tool").alias("role"), F.to_json(F.struct(number(1).alias("tool_call_id"), F.col("text").alias("content"))).alias("text"))
    return tool_calls.link(*tool_calls.json_traffic(calls.union(results)), tool_calls.REPLY)


ORACLES["tool_calls_json"] = r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, 'call_' || turn AS call_id FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL
), r AS (
  SELECT conv_id, turn, text AS content, 'call_' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL
), e AS (
  SELECT a.conv_id, a.turn, b.turn AS before FROM c a JOIN c b ON a.conv_id = b.conv_id AND (b.turn = a.turn - 2 OR (a.turn % 8 = 0 AND b.turn = a.turn - 4))
), w(conv_id, turn, level) AS (
  SELECT conv_id, turn, 0::BIGINT FROM c WHERE (conv_id, turn) NOT IN (SELECT (conv_id, turn) FROM e)
  UNION
  SELECT e.conv_id, e.turn, w.level + 1 FROM e JOIN w ON e.conv_id = w.conv_id AND e.before = w.turn
), l AS (
  SELECT conv_id, turn, max(level) AS level FROM w GROUP BY conv_id, turn
)
SELECT c.conv_id, c.call_id, c.turn, CASE WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status, l.level,
       1::BIGINT AS copies, CASE WHEN r.call_id IS NULL THEN 0 ELSE 1 END::BIGINT AS n_results, length(c.text) > 0 AS valid,
       CASE WHEN length(c.text) > 0 THEN NULL WHEN c.text IS NULL THEN 'prompt is missing' ELSE 'prompt breaks minLength' END AS error,
       json_object('arguments', json_object('prompt', c.text, 'turn', c.turn), 'id', c.call_id, 'level', l.level, 'name', 'reply', 'result', r.content)::VARCHAR AS record
FROM c JOIN l USING (conv_id, turn) LEFT JOIN r USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, 'orphan', NULL, 0, 1, false, NULL,
       json_object('arguments', NULL, 'id', r.call_id, 'level', NULL, 'name', NULL, 'result', r.content)::VARCHAR
FROM r WHERE (conv_id, call_id) NOT IN (SELECT (conv_id, call_id) FROM c)
"""


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.learn(docs))
    return found.withColumn("held_out", langid.held_out())


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs))


@query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again: the ids' checksum, and length and digest of the text that decoding gives."""
    docs = table(spark, sf_dir, "documents")
    back = pieces.decode(pieces.encode(docs))
    return back.select("doc_id", "n_tokens", "ids_crc32", "n_byte_tokens", F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_text(table(spark, sf_dir, "documents"))).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "n_samples", "keyframes")


@query
def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.lm_score(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ranked_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (
  SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d
), p AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0
), f AS (
  SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term
), q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY item_id, r, doc_id
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"))


ORACLES["op12_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), c AS (
  SELECT *, len(lines)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), s AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
), p AS (
  SELECT *, array_to_string(lines[1:low], '') AS prefix, array_to_string(lines[low + 1:high], '') AS middle, array_to_string(lines[high + 1:n], '') AS suffix FROM s
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query
def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["rule"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["rule"] < len(secrets.BASE))
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.labels(base), 256).alias("base_sha256"), secrets.labels(F.col("spans")).alias("spans"))


def _by_rule(name: str) -> str:
    """A list over all rules, each with its pattern and group as constants."""
    plain = {"access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    one = {"gaps": "string_split_regex(t, {p})", "hits": "regexp_extract_all(t, {p})", "vals": "regexp_extract_all(t, {p}, {g})"}[name]
    return "CASE ord " + " ".join(f"WHEN {k} THEN " + one.format(p=quoted(plain.get(r.kind, r.pattern)), g=r.group) for k, r in enumerate(secrets.RULES)) + " END"


ORACLES["op13_secret_scans"] = f"""
WITH rules(ord, kind, least) AS (VALUES {", ".join(f"({k}, '{r.kind}', {r.least})" for k, r in enumerate(secrets.RULES))}), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT r, ord, kind, least, {_by_rule("gaps")} AS gaps, {_by_rule("hits")} AS hits, {_by_rule("vals")} AS vals FROM d, rules
), u AS (
  SELECT r, ord, kind, least, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(vals) AS val, unnest(range(len(hits))) AS i FROM m
), p AS (
  SELECT r, ord, kind, least, length(hit) AS n, length(val) AS counted, sum(length(gap) + length(hit)) OVER (PARTITION BY r, ord ORDER BY i) AS e FROM u
), s AS (
  SELECT r, ord, (e - n)::BIGINT AS b, e::BIGINT AS e, kind || ':' || (e - n)::BIGINT || ':' || e::BIGINT AS label FROM p WHERE counted >= least
)
SELECT doc_id, count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
       sha256(coalesce(string_agg(label, ',' ORDER BY b, ord, e) FILTER (ord < {len(secrets.BASE)}), '')) AS base_sha256, coalesce(string_agg(label, ',' ORDER BY b, ord, e), '') AS spans
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
"""
