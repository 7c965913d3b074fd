"""SQL of the queries that go by way of stored files."""

from __future__ import annotations


def stored_sql() -> dict[str, str]:
    from citeweave.plans import oracles as O

    hybrid = O._oracle_sql()["rep_hybrid"]
    lines = """
WITH works AS (
  SELECT doc_id, '2024-01-0' || (doc_id % 3 + 1) AS updated_date,
    string_split(text, chr(10))[1] AS title,
    CAST(2000 + doc_id % 27 AS INTEGER) AS publication_year,
    CAST(doc_id * 7919 % 5000 AS INTEGER) AS cited_by_count
  FROM documents
)"""
    summaries = O._oracle_sql()["concept_summaries"]
    return {
        "shards_scan": f"""{O.ORDERS}
SELECT CAST(shard AS BIGINT) AS shard, count(*) AS n_papers,
  count(*) FILTER (coalesce(trim(title), '') != '' AND coalesce(trim(abstract), '') != '')
    AS n_readable,
  CAST(sum(cited_by_count) AS BIGINT) AS citations
FROM papers GROUP BY shard""",
        "shard_files_scan": f"""{O.ORDERS}
SELECT count(*) AS n_papers, min(id) AS first_id FROM papers GROUP BY shard""",
        "rep_temporal_stored": f"""
SELECT *, row_number() OVER (ORDER BY concept, time_bucket, rank) AS place
FROM ({O._temporal("shard, concept")})""",
        "rep_hybrid_stored": f"""
SELECT *, row_number() OVER (ORDER BY concept, rank) AS place FROM ({hybrid})""",
        "pairs_stored": f"""{O.ORDERS}, {O.PAIRS}
SELECT *, row_number() OVER (ORDER BY first_publication_date, concept1, concept2) AS place
FROM ({O._pairs('')})""",
        "distribution_stored": f"{O.COUNTS} SELECT * FROM counts",
        "summaries_stored": f"SELECT * EXCLUDE (definition) FROM ({summaries})",
        "summaries_run_stored": f"""
SELECT 'lengths' AS model, count(*) AS total_concepts,
  CAST(sum(tokens_generated) AS BIGINT) AS total_tokens_generated,
  count(*) AS json_parse_ok, 0::BIGINT AS json_parse_failed, count(*) AS n_raw_responses
FROM ({summaries})""",
        "paper_files": """
SELECT count(*) AS n_papers, 0::BIGINT AS n_over_limit, true AS few_files FROM orders""",
        "edge_files": f"""{O.ORDERS}
SELECT count(*) AS n_edges, 0::BIGINT AS n_overlaps FROM concept_papers""",
        "dictionary_scan": """
SELECT DISTINCT lower(trim(word)) AS concept
FROM (SELECT item_id, unnest(string_split_regex(text, '[ \n]')) AS word FROM benchmark)
WHERE item_id % 3 != 2 AND trim(word) != ''""",
        "works_of_dates": f"""{lines}
SELECT CASE WHEN doc_id % 10 = 4 THEN '' ELSE 'D' || doc_id END AS id, title,
  CASE WHEN doc_id % 4 = 1 THEN '[{{"year":' || publication_year || ',"cited_by_count":'
    || cited_by_count || '}}]' END AS counts_by_year, updated_date
FROM works WHERE doc_id % 10 != 3 AND doc_id % 3 IN (0, 2)""",
        "works_damaged": f"""{lines}
SELECT updated_date, count(*) AS n_lines, count(*) FILTER (doc_id % 10 = 3) AS n_damaged
FROM works GROUP BY updated_date""",
        "ingest_ledger": """
SELECT count(*) AS n_lines, count(*) FILTER (doc_id % 10 = 3) AS n_damaged,
  count(*) FILTER (doc_id % 10 != 3) AS n_works, true AS timely, true AS all_counted
FROM documents""",
        "papers_across_shards": """
WITH base AS (
  SELECT 'D' || doc_id AS id, doc_id % 4 AS shard,
    CAST(2000 + doc_id % 27 AS INTEGER) AS publication_year,
    CAST(doc_id * 7919 % 5000 AS INTEGER) AS cited_by_count, doc_id
  FROM documents
)
SELECT id, shard, publication_year, cited_by_count, 'shard' AS kept_in FROM base
UNION ALL
SELECT id, (shard + 1) % 4, publication_year, cited_by_count + 1, 'shard' FROM base
WHERE doc_id % 2 = 0
UNION ALL
SELECT id, shard, publication_year, cited_by_count, 'all' FROM base""",
    }
