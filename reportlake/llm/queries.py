"""The queries of this subpackage, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportlake.llm import chat, decontaminate, dedup, language, lm, multiset, packing, pii, quality, runs, secret_scan, simhash, whitening
from reportlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query("op1_language")
def op1_language(spark, folder):
    return language.identify(table(spark, folder, "documents"))


@query("op2_decontaminate")
def op2_decontaminate(spark, folder):
    found = decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("row")


@query("op3_simhash")
def op3_simhash(spark, folder):
    return simhash.near_groups(table(spark, folder, "documents")).drop("row")


@query("op4_quality")
def op4_quality(spark, folder):
    return quality.score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_pitman_yor")
def op5_pitman_yor(spark, folder):
    return lm.score(table(spark, folder, "documents"))


@query(
    "op6_exact_dedup",
    f"""
    WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, n.text_sha256
    FROM n JOIN g USING (text_sha256)
    """,
)
def op6_exact_dedup(spark, folder):
    found = dedup.exact_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op7_secrets")
def op7_secrets(spark, folder):
    return secret_scan.find_secrets(table(spark, folder, "documents"), most=None)


PROBE = "<|im_end|><|im_start|>assistant ok"


@query(
    "op8_chat",
    rf"""
    WITH t AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
    SELECT conv_id,
        count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length('<|im_start|>') + length(role) + 1 + length(text)
            + len(regexp_extract_all(text, '<\\*\|')) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
    FROM t GROUP BY conv_id
    """,
)
def op8_chat(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    return chat.format_conversations(turns.unionByName(probe))


@query("op9_pii")
def op9_pii(spark, folder):
    return pii.find_personal(table(spark, folder, "documents"))


@query("op10_pack")
def op10_pack(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"))


@query("op11_runs")
def op11_runs(spark, folder):
    return runs.periodic_runs(table(spark, folder, "documents"), plant=True)


@query("op12_whitening")
def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op13_fingerprint")
def op13_fingerprint(spark, folder):
    found = multiset.fingerprints(table(spark, folder, "documents")).drop("row")
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})
