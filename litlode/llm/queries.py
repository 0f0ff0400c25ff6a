"""The queries opN_<name> over the whole driver tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litlode.llm import bpe, chat, fingerprints, licenses, packing, quality, rpforest, secrets, simhash, toxicity
from litlode.llm.common import table

#: Public vocabulary file that ops 6 and 9 take.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.severity(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op2_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(table(spark, sf_dir, "conversations"))


def op3_simhash_bit_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_digest(table(spark, sf_dir, "documents"))


def op5_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality.rate(documents, quality.fit(documents, table(spark, sf_dir, "labels")))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op8_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rpforest.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(table(spark, sf_dir, "documents"), vocabulary())


def op10_license_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_ordinal_toxicity,
        op2_snapshot_collapse,
        op3_simhash_bit_sliced,
        op4_multiset_fingerprints,
        op5_hierarchical_quality,
        op6_best_fit_packing,
        op7_secret_ledger,
        op8_projection_forest,
        op9_bpe_chunk_reuse,
        op10_license_automaton,
    )
    return {f.__name__: f for f in found}


def _duck_spans(kind: str, order: int, pattern: str, group: int = 0, least: int = 1) -> str:
    """DuckDB: the spans of a rule, from the lengths of matches and of what stands between them."""
    p = pattern.replace("'", "''")
    return f"""
      SELECT doc_id, {order} AS r, '{kind}' AS kind, list_sum(list_transform(list_slice(b, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS s, length(m[i]) AS n, length(g[i]) AS got
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, regexp_split_to_array(t, '{p}') AS b FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))
      WHERE length(g[i]) >= {least}"""


_OP7 = f"""
WITH spans AS ({" UNION ALL ".join(_duck_spans(r.kind, k, r.pattern, r.group, r.least) for k, r in enumerate(secrets.RULES))}),
named AS (SELECT doc_id, r, kind, s, concat(kind, ':', CAST(s AS BIGINT), ':', CAST(s + n AS BIGINT)) AS line FROM spans),
byid AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(line, ',' ORDER BY s, r) FILTER (r < 3), '') AS base, string_agg(line, ',' ORDER BY s, r) AS spans
  FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN byid USING (doc_id)"""


_OP2 = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (
  SELECT conv_id, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, string_agg(concat(coalesce(role, chr(3)), chr(1), coalesce(text, chr(3)), chr(2)), '') OVER w AS prefix,
    concat('<|im_start|>', coalesce(role, 'unknown'), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS line
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)),
alike AS (SELECT n, prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY n, prefix),
kept AS (SELECT * FROM alike WHERE prefix NOT IN (SELECT prefix FROM p WHERE k < n))
SELECT conv_id, (p.k - 1) // 64 AS segment, kept.n AS n_turns, n_copies, string_agg(line, '' ORDER BY k) AS text
FROM kept JOIN p USING (conv_id) GROUP BY ALL"""


#: Every pair compared; the forest's result is held to it, links missed included.
_OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
fine AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN degree ON degree.a = vec_id JOIN least ON least.a = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op2_snapshot_collapse": _OP2, "op7_secret_ledger": _OP7, "op8_projection_forest": _OP8}
