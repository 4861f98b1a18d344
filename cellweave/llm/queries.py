"""One query for each corpus operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import warc

    captures, _ = warc.round_trip(_table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import token_records

    index, _ = token_records.write_dataset(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_sorted_list_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import topk

    v = topk.vectors(_table(spark, sf_dir, "embeddings"))
    return topk.search(v, v.where("vec_id % 20 = 0"), 20)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import langid

    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import prefix_tokens

    return prefix_tokens.token_counts(_table(spark, sf_dir, "documents"), "word_bpe_49k.json", 2048)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import simhash

    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), near=2)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import suffix_dedup

    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import licenses

    return licenses.scan(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import decontaminate

    return decontaminate.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import conversation_repair

    return conversation_repair.digests(conversation_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import automaton_dedup

    return automaton_dedup.repeats(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cellweave.llm import spelling

    return spelling.variants(_table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
     f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.h = f.h
"""

OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS seq FROM d, unnest(range(1, len(ws) - 48)) AS t(i)),
f AS (SELECT seq, min(doc_id) AS first FROM w GROUP BY seq),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM w JOIN f USING (seq) WHERE doc_id > first GROUP BY doc_id),
k AS (SELECT d.doc_id, len(ws) AS n, [ws[i] FOR i IN range(1, len(ws) + 1) IF g.gone IS NULL OR NOT list_contains(g.gone, i)] AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n - len(kept) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""

_ALL = (op1_warc_index, op2_token_records, op3_sorted_list_topk, op4_language_id, op5_prefix_token_counts, op6_simhash, op7_best_fit_packing, op8_suffix_array_dedup, op9_license_scan, op10_decontamination, op11_conversation_repair, op12_suffix_automata, op13_spelling_variants)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_index": OP1_SQL, "op3_sorted_list_topk": OP3_SQL, "op12_suffix_automata": OP12_SQL}
