"""Registered queries of the corpus operators, over whole tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactloom.llm import chat, decontamination, html_wrapper, line_dedup, packing, pii, quality, secret_scan, simhash, url_reputation


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of `documents`."""
    return pii.spans_of(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` packed into bins of 2,048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_quality_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts for every text of `documents`."""
    docs = table(spark, sf_dir, "documents")
    found = quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return found.drop("line_labels")


#: Tools that conversations may call.
TOOLS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "lookup": {"type": "object", "required": ["id"], "properties": {"id": {"type": ["string", "integer"]}}},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}},
}


def op4_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of `conversations`, linked, ordered and in canonical JSON."""
    return chat.link(table(spark, sf_dir, "conversations"), TOOLS)


def tool_calls_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking, order and schemas on calls and results that are made from every user's turn of `conversations`."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("t")).distinct()
    calls = F.format_string('{"content":null,"tool_calls":[{"id":"b%d","name":"lookup","arguments":{"id":"${a%d}"}},{"id":"a%d","function":{"name":"search","arguments":"{\\"query\\": \\"q%d\\", \\"limit\\": %d}"}}]}', "t", "t", "t", "t", F.col("t") % 3)
    said = [
        ("assistant", calls), ("tool", F.format_string('{"tool_call_id":"b%d","content":"second"}', "t")), ("tool", F.format_string('{"tool_call_id":"a%d","content":{"z":1,"a":[2]}}', "t")),
        ("tool", F.lit('{"tool_call_id":"nobody","content":null}')), ("assistant", F.format_string("plain %d", "t")),
    ]
    made = turns.select("conv_id", F.explode(F.array(*[F.struct((F.col("t") * 10 + k).alias("turn"), F.lit(role).alias("role"), text.alias("text")) for k, (role, text) in enumerate(said)])).alias("m")).select("conv_id", "m.*")
    return chat.link(made, TOOLS)


LINKED_SQL = """
WITH u AS (SELECT DISTINCT conv_id, turn::BIGINT AS t FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL)
SELECT conv_id, t * 10 AS turn, 'assistant' AS role, t * 10 AS order_turn, 0::BIGINT AS order_pos, 2::BIGINT AS n_calls, 2::BIGINT AS n_answered, CASE WHEN t % 3 = 0 THEN 'a' || t || ': $.limit: below minimum' ELSE '' END AS errors, 'calls' AS status,
       '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"limit":' || (t % 3) || ',"query":"q' || t || '"},"id":"a' || t || '","name":"search"},{"arguments":{"id":"${a' || t || '}"},"id":"b' || t || '","name":"lookup"}]}' AS message FROM u
UNION ALL SELECT conv_id, t * 10 + 1, 'tool', t * 10, 2, 0, 0, '', 'result', '{"call":{"name":"lookup","turn":' || (t * 10) || '},"content":"second","role":"tool","tool_call_id":"b' || t || '"}' FROM u
UNION ALL SELECT conv_id, t * 10 + 2, 'tool', t * 10, 1, 0, 0, '', 'result', '{"call":{"name":"search","turn":' || (t * 10) || '},"content":{"a":[2],"z":1},"role":"tool","tool_call_id":"a' || t || '"}' FROM u
UNION ALL SELECT conv_id, t * 10 + 3, 'tool', t * 10 + 3, 0, 0, 0, '', 'orphan', '{"content":null,"role":"tool","tool_call_id":"nobody"}' FROM u
UNION ALL SELECT conv_id, t * 10 + 4, 'assistant', t * 10 + 4, 0, 0, 0, '', 'plain', '{"content":"plain ' || t || '","role":"assistant"}' FROM u
"""


def op5_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of `pages`."""
    return url_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_html_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every row of `pages`."""
    return html_wrapper.extract(table(spark, sf_dir, "pages"))


def op7_simhash_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of `documents`."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, threshold=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of `documents`, each distinct text scanned once."""
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op8_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` without the passages that a document before them has."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chunks", "n_removed", "n_removed_lines", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op10_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps of `documents` with items of `benchmark`."""
    return decontamination.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_pii_crf, op2_best_fit_packing, op3_quality_line_crf, op4_tool_call_linking, tool_calls_linked, op5_url_reputation, op6_html_wrapper_extraction, op7_simhash_anchor_dedup, op8_line_chunk_dedup, op9_secret_ledger, op10_spaced_seed_decontamination)}
ORACLES: dict[str, str] = {"tool_calls_linked": LINKED_SQL, "op5_url_reputation": url_reputation.SQL, "op8_line_chunk_dedup": line_dedup.SQL, "op9_secret_ledger": secret_scan.SQL, "op10_spaced_seed_decontamination": decontamination.SQL}
