"""The registered queries in SQL for an independent engine to run."""

from __future__ import annotations

from citeweave import constants as C
from citeweave.plans import stored_oracles
from citeweave.plans.adapters import DICTIONARY
from citeweave.plans.catalog import DEEP_K, GENERATION_SECONDS, K, STARTUP_SECONDS

ORDERS = """
WITH concept_papers AS (
  SELECT DISTINCT lower(p_name) AS concept, 'W' || l_orderkey AS paper_id, l_orderkey % 4 AS shard
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
matched AS (
  SELECT paper_id, CAST(count(*) AS INTEGER) AS n FROM concept_papers GROUP BY paper_id
),
papers AS (
  SELECT 'W' || o_orderkey AS id,
    CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 89 = 0 THEN '   '
         ELSE 'Order ' || o_orderkey || ' ' || o_orderpriority END AS title,
    CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN ''
         ELSE 'Status ' || o_orderstatus || ' customer ' || o_custkey END AS abstract,
    CASE WHEN o_orderkey % 79 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS INTEGER) END
      AS publication_year,
    CASE WHEN o_orderkey % 73 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END
      AS publication_date,
    CASE WHEN o_orderkey % 71 = 0 THEN NULL
         ELSE CAST(floor(o_totalprice / 1000) AS INTEGER) END AS cited_by_count,
    CASE WHEN o_orderkey % 67 = 0 THEN NULL ELSE n END AS num_matched_concepts,
    o_orderkey % 4 AS shard
  FROM orders LEFT JOIN matched ON paper_id = 'W' || o_orderkey
),
base AS (
  SELECT concept, id AS paper_id, title, abstract, publication_year, cited_by_count,
    coalesce(num_matched_concepts, 1) AS num_matched_concepts, papers.shard AS shard
  FROM concept_papers JOIN papers ON paper_id = id
  WHERE title IS NOT NULL AND trim(title) != '' AND abstract IS NOT NULL AND trim(abstract) != ''
)
"""

SHOWN = "concept, paper_id, title, abstract, publication_year, cited_by_count"
MOST_CITED = "cited_by_count DESC NULLS LAST, paper_id"

DOCUMENTS = """
WITH docs AS (
  SELECT doc_id, 'D' || doc_id AS id, lang, source, text,
    string_split(text, chr(10))[1] AS title,
    regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') AS words,
    CAST(2000 + doc_id % 27 AS INTEGER) AS publication_year,
    CAST(doc_id * 7919 % 5000 AS INTEGER) AS cited_by_count
  FROM documents
),
document_edges AS (
  SELECT lang AS concept, id AS paper_id FROM docs
  UNION ALL SELECT source, id FROM docs
),
chosen AS (
  SELECT concept, paper_id, title, text AS abstract, publication_year, cited_by_count
  FROM document_edges JOIN docs ON paper_id = id
)
"""

_LITERALS = ", ".join("('" + c + "')" for c in DICTIONARY)
FIXED_DICTIONARY = f"dictionary AS (SELECT * FROM (VALUES {_LITERALS}) v(concept))"
# Word pairs are sought among the ends of parts that one blank divides.
PHRASE_MATCHES = """, runs AS (
  SELECT regexp_extract_all(lower(SOURCE_TEXT), '[\\p{L}\\p{N}]+') AS w FROM SOURCE_TABLE
),
dictionary AS (
  SELECT DISTINCT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
    AS concept
  FROM runs
),
parts AS (SELECT id, string_split(lower(title || ' ' || text), ' ') AS p FROM docs),
placed AS (
  SELECT id, unnest(p) AS one, unnest(list_concat(p[2:], [''])) AS two FROM parts
),
pairs AS (
  SELECT DISTINCT id, regexp_extract(one, '[\\p{L}\\p{N}]+$') || ' '
    || regexp_extract(two, '^[\\p{L}\\p{N}]+') AS concept
  FROM placed
)
SELECT id, concept FROM pairs JOIN dictionary USING (concept)"""


def _phrases(text: str, table: str) -> str:
    sought = PHRASE_MATCHES.replace("SOURCE_TEXT", text).replace("SOURCE_TABLE", table)
    return f"{DOCUMENTS}{sought}"


def _matches(text: str) -> str:
    """Whole-word containment. Run edges are marked in text and concept; a concept
    with another character at an end is searched with its neighbours instead."""
    alnum = "[\\p{L}\\p{N}]"

    def marked(value: str) -> str:
        return f"regexp_replace({value}, '({alnum}+)', '<<\\1>>', 'g')"

    return f"""CASE WHEN regexp_matches(concept, '^{alnum}$|^{alnum}.*{alnum}$')
    THEN contains({marked(f"lower({text})")}, {marked("concept")})
    ELSE regexp_matches(lower({text}), '(^|[^\\p{{L}}\\p{{N}}])' || regexp_escape(concept)
      || '([^\\p{{L}}\\p{{N}}]|$)') END"""


def _top(
    order: str, columns: str = SHOWN, source: str = "base", per: str = "concept", k: int = K
) -> str:
    return f"""SELECT {columns}, r AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY {order}) AS r FROM {source}
    ) WHERE r <= {k}"""


def _temporal(per: str) -> str:
    return f"""{ORDERS},
tiled AS (
  SELECT *, ntile({C.TIME_BUCKETS}) OVER (
    PARTITION BY {per} ORDER BY publication_year, md5(paper_id), paper_id) AS time_bucket
  FROM base WHERE publication_year IS NOT NULL
)
SELECT {SHOWN}, time_bucket, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY concept, time_bucket ORDER BY {MOST_CITED}) AS r
  FROM tiled
) WHERE r <= {max(1, K // C.TIME_BUCKETS)}"""


def _coverage(per: str) -> str:
    outer = K // 3
    return f"""{ORDERS},
tiled AS (
  SELECT *, ntile(3) OVER (
    PARTITION BY {per} ORDER BY num_matched_concepts, md5(paper_id), paper_id) AS breadth_tier
  FROM base WHERE cited_by_count IS NOT NULL
)
SELECT {SHOWN}, num_matched_concepts, breadth_tier, r AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY concept, breadth_tier ORDER BY {MOST_CITED}) AS r
  FROM tiled
) WHERE (breadth_tier = 2 AND r <= {K - 2 * outer}) OR (breadth_tier != 2 AND r <= {outer})"""


SIGNALS = """ranked AS (
  SELECT *,
    percent_rank() OVER (PARTITION BY concept ORDER BY cited_by_count DESC NULLS LAST)
      AS citation_prank,
    percent_rank() OVER (PARTITION BY concept ORDER BY publication_year DESC NULLS LAST)
      AS recency_prank,
    percent_rank() OVER (PARTITION BY concept ORDER BY num_matched_concepts DESC)
      AS breadth_prank
  FROM base
)"""

PAIRS = """dated AS (
  SELECT id, shard, publication_year AS y, try_cast(publication_date AS DATE) AS d
  FROM papers WHERE try_cast(publication_date AS DATE) IS NOT NULL
),
together AS (
  SELECT a.concept AS concept1, b.concept AS concept2, id, d, y, dated.shard AS shard
  FROM concept_papers a
  JOIN concept_papers b ON a.paper_id = b.paper_id AND a.concept < b.concept
  JOIN dated ON a.paper_id = id
)"""


def _pairs(shard: str) -> str:
    per = f"{shard}concept1, concept2"
    return f"""SELECT {per}, id AS first_paper_id, d AS first_publication_date,
  y AS first_publication_year
FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY d, id) AS r FROM together)
WHERE r = 1"""


COUNTS = f"""{ORDERS},
counts AS (SELECT concept, count(*) AS paper_count FROM concept_papers GROUP BY concept)"""


COUNTS_BY_YEAR = """CASE WHEN doc_id % 4 = 1 THEN '[{"year":' || publication_year
    || ',"cited_by_count":' || cited_by_count || '}]' ELSE '[]' END"""


def _papers_of_works() -> str:
    return f"""{DOCUMENTS}, {FIXED_DICTIONARY},
hits AS (
  SELECT id, string_agg(concept, '|' ORDER BY concept) AS concepts,
    CAST(count(*) AS INTEGER) AS num_matched_concepts
  FROM docs JOIN dictionary ON {_matches("title || ' ' || words")}
  GROUP BY id
)
SELECT docs.id AS id, title, words AS abstract, publication_year,
  publication_year || '-01-01' AS publication_date, source AS type, cited_by_count,
  {COUNTS_BY_YEAR} AS counts_by_year, concepts, num_matched_concepts
FROM docs JOIN hits ON docs.id = hits.id"""


def _match_query(dictionary: str) -> str:
    return f"""{DOCUMENTS}, {dictionary}
SELECT id, concept FROM docs JOIN dictionary ON {_matches("title || ' ' || text")}"""


def _batches(direction: str) -> str:
    return f"""{DOCUMENTS},
batches AS (
  SELECT id, title, publication_year, cited_by_count, 1 AS batch, '2024-01-01' AS updated_date,
    lang || '|' || source AS concepts FROM docs
  UNION ALL
  SELECT id, title, publication_year, cited_by_count + 1, 2, '2024-02-01',
    lang || '|' || source || '|again' FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)
)
SELECT id, title, publication_year, cited_by_count, batch, updated_date, concepts FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_date {direction}, batch {direction})
    AS r FROM batches
) WHERE r = 1"""


TOKENS = "(length(title) + length(abstract)) / 4.0"
PER_CONCEPT = f"""per_concept AS (
  SELECT concept, count(*) AS n_papers, CAST(sum({TOKENS}) AS DOUBLE) AS total_tokens,
    CAST(max({TOKENS}) AS DOUBLE) AS max_tokens_per_paper
  FROM chosen GROUP BY concept
)"""


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROMPTS = f"""{DOCUMENTS},
firsts AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY concept ORDER BY {MOST_CITED}) AS r FROM chosen
    WHERE trim(title) != '' AND trim(abstract) != ''
  ) WHERE r <= {C.PROMPT_PAPERS}
),
prompts AS (
  SELECT concept, {_sql_text(C.PROMPT_HEAD_BEFORE_CONCEPT)} || concept
    || {_sql_text(C.PROMPT_HEAD_AFTER_CONCEPT)} || chr(10) || chr(10)
    || string_agg('Paper ' || r || ':' || chr(10) || '  Title: '
        || substring(title, 1, {C.PROMPT_TITLE_CHARS})
        || chr(10) || '  Abstract: ' || substring(abstract, 1, {C.PROMPT_ABSTRACT_CHARS})
        || chr(10) || '  Year: ' || publication_year
        || chr(10) || '  Citations: ' || cited_by_count, chr(10) || chr(10) ORDER BY r)
    || chr(10) || chr(10) || {_sql_text(C.PROMPT_INSTRUCTIONS)} AS prompt,
    CAST(sum(greatest(length(title) - {C.PROMPT_TITLE_CHARS}, 0)
      + greatest(length(abstract) - {C.PROMPT_ABSTRACT_CHARS}, 0)) AS BIGINT) AS chars_left_out
  FROM firsts GROUP BY concept
)"""

RESPONSES = r"""
WITH turns AS (
  SELECT 'C' || conv_id || '-' || turn AS concept, text, conv_id % 7 AS form,
    CAST(json_object('concept', 'C' || conv_id || '-' || turn, 'summary', text) AS VARCHAR) AS body
  FROM conversations WHERE role = 'assistant'
),
raw AS (
  SELECT concept, CAST(length(text) // 4 AS INTEGER) AS tokens_generated,
    CASE form WHEN 0 THEN body
      WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
      WHEN 2 THEN '<|channel|>analysis think {' || chr(10) || '} more<|end|>' || chr(10) || ' '
        || body || chr(10)
      WHEN 3 THEN substring(body, 1, length(body) - 1)
      WHEN 4 THEN '<|channel|>commentary { about' || chr(10) || ' it <|end|>' || body
        || '<|channel|>commentary }<|end|>'
      WHEN 5 THEN '<analysis>{ step' || chr(10) || '1 }</analysis>' || chr(10) || '```' || body
        || '```'
      ELSE text END AS raw_response
  FROM turns
),
cleaned AS (
  SELECT *, trim(regexp_replace(regexp_replace(raw_response,
      '(?s)<\|channel\|>(analysis|commentary).*?<\|end\|>|<analysis>.*?</analysis>', '', 'g'),
      '```json|```', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned
  FROM raw
),
found AS (
  SELECT *, regexp_extract(cleaned, '(?s)\{.*\}', 0) AS object FROM cleaned
),
parsed AS (
  SELECT *, object != '' AND json_valid(object) AS ok FROM found
),
results AS (
  SELECT concept, tokens_generated, 'stop' AS finish_reason, ok AS parse_ok,
    CASE WHEN ok THEN object
      ELSE CAST(json_object('error', 'json_parse_failed', 'raw', cleaned) AS VARCHAR) END
      AS response,
    CASE WHEN ok THEN json_extract_string(object, '$.summary') END AS summary_text
  FROM parsed
)
"""


# What has arrived in any order and been corrected is what stands in the end.
INCREMENTAL = ["citation", "recency", "random", "temporal", "coverage", "hybrid"]


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql() | stored_oracles.stored_sql()
    return found | {f"rep_{s}_incremental": found[f"rep_{s}"] for s in INCREMENTAL}


def _oracle_sql() -> dict[str, str]:
    citation = f"{ORDERS} {_top(MOST_CITED)}"
    match_fixed = _match_query(FIXED_DICTIONARY)
    return {
        "rep_citation": citation,
        "rep_citation_deep": f"{ORDERS} {_top(MOST_CITED, k=DEEP_K)}",
        "rep_citation_per_shard": f"""{ORDERS}
SELECT shard, concept, paper_id, publication_year, cited_by_count, r AS rank_in_shard FROM (
  SELECT *, row_number() OVER (PARTITION BY shard, concept ORDER BY {MOST_CITED}) AS r FROM base
) WHERE r <= {K}""",
        "rep_citation_concepts": f"""{ORDERS} SELECT * FROM ({_top(MOST_CITED)})
WHERE concept IN ('blue anvil', 'blue gear', 'not a concept')""",
        "rep_recency": f"""{ORDERS},
scored AS (
  SELECT *, round(coalesce(cited_by_count, 0) * exp(-{C.RECENCY_DECAY}
    * ({C.RECENCY_REFERENCE_YEAR} - coalesce(publication_year, {C.RECENCY_REFERENCE_YEAR}))), 6)
    AS weighted_score FROM base
)
{_top("weighted_score DESC NULLS LAST, paper_id", SHOWN + ", weighted_score", "scored")}""",
        "rep_temporal": _temporal("concept"),
        "rep_temporal_sharded": _temporal("shard, concept"),
        "rep_coverage": _coverage("concept"),
        "rep_coverage_sharded": _coverage("shard, concept"),
        "rep_hybrid": f"""{ORDERS}, {SIGNALS},
scored AS (
  SELECT *, round({C.HYBRID_WEIGHT_CITATIONS} * citation_prank
    + {C.HYBRID_WEIGHT_RECENCY} * recency_prank
    + {C.HYBRID_WEIGHT_BREADTH} * breadth_prank, 6) AS composite_score FROM ranked
)
{_top("composite_score, paper_id", SHOWN + ", num_matched_concepts, composite_score", "scored")}""",
        "rep_random": f"""{ORDERS}
{_top(f"md5('{C.RANDOM_SEED}|' || concept || '|' || paper_id), paper_id")}""",
        "signal_percent_ranks": f"""{ORDERS}, {SIGNALS}
SELECT concept, cited_by_count, publication_year, num_matched_concepts, count(*) AS n_papers,
  round(min(citation_prank), 6) AS citation_prank, round(min(recency_prank), 6) AS recency_prank,
  round(min(breadth_prank), 6) AS breadth_prank
FROM ranked GROUP BY concept, cited_by_count, publication_year, num_matched_concepts""",
        "concept_counts": f"{COUNTS} SELECT * FROM counts",
        "concept_counts_describe": f"""{COUNTS}
SELECT count(*) AS count, round(avg(paper_count), 6) AS mean,
  round(stddev_samp(paper_count), 6) AS std, min(paper_count) AS min,
  round(quantile_cont(paper_count, 0.25), 6) AS p25,
  round(quantile_cont(paper_count, 0.5), 6) AS p50,
  round(quantile_cont(paper_count, 0.75), 6) AS p75, max(paper_count) AS max
FROM counts""",
        "concept_counts_hist": f"""{COUNTS},
edges AS (
  SELECT CASE WHEN min(paper_count) = max(paper_count) THEN min(paper_count) - 0.5
      ELSE min(paper_count) END::DOUBLE AS lo,
    CASE WHEN min(paper_count) = max(paper_count) THEN max(paper_count) + 0.5
      ELSE max(paper_count) END::DOUBLE AS hi
  FROM counts
),
bins AS (
  SELECT i AS bin, lo + i * ((hi - lo) / {C.HISTOGRAM_BINS}) AS s,
    lo + (i + 1) * ((hi - lo) / {C.HISTOGRAM_BINS}) AS e
  FROM edges, range({C.HISTOGRAM_BINS}) r(i)
)
SELECT bin, round(s, 6) AS bin_start, round(e, 6) AS bin_end, count(paper_count) AS n_concepts
FROM bins LEFT JOIN counts
  ON paper_count >= s AND (paper_count < e OR bin = {C.HISTOGRAM_BINS - 1})
GROUP BY bin, s, e""",
        "concept_ccdf": f"""{COUNTS}
SELECT paper_count, r AS rank, round(1.0 - CAST(r AS DOUBLE) / n, 6) AS ccdf FROM (
  SELECT paper_count, row_number() OVER (ORDER BY paper_count, concept) AS r, count(*) OVER () AS n
  FROM counts
)""",
        "concept_top30": f"""{COUNTS}
SELECT * FROM counts ORDER BY paper_count DESC, concept LIMIT {C.TOP_CONCEPTS}""",
        "pairs_first": f"{ORDERS}, {PAIRS} {_pairs('')}",
        "pairs_first_per_shard": f"{ORDERS}, {PAIRS} {_pairs('shard, ')}",
        "pairs_preview": f"""{ORDERS}, {PAIRS} SELECT * FROM ({_pairs('')})
ORDER BY first_publication_date, concept1, concept2 LIMIT 10""",
        "pairs_per_shard_counts": f"""{ORDERS}, {PAIRS}
SELECT shard, count(*) AS n_pairs FROM ({_pairs('shard, ')}) GROUP BY shard""",
        "abstract_rebuild": f"{DOCUMENTS} SELECT id, words AS abstract FROM docs",
        "concept_match": match_fixed,
        "concept_match_shuffled": match_fixed,
        "concept_match_phrases": _phrases("text", "benchmark"),
        "concept_match_large": _phrases("title", "docs"),
        "concept_match_large_shuffled": _phrases("title", "docs"),
        "works_to_papers": _papers_of_works(),
        "works_stream_ingest": _papers_of_works(),
        "works_scan": f"""{DOCUMENTS}
SELECT id, title, publication_year, cited_by_count, '2024-01-0' || (doc_id % 3 + 1)
  AS updated_date
FROM docs""",
        "year_filter": """
SELECT * FROM (
  SELECT 'D' || doc_id AS id, CASE doc_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 0
    ELSE CAST(2000 + doc_id % 27 AS INTEGER) END AS publication_year
  FROM documents
) WHERE publication_year IS NULL OR publication_year = 0
  OR publication_year BETWEEN 2005 AND 2015""",
        "pending_works": """
SELECT doc_id, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
        "ingest_counters": f"""{DOCUMENTS}, {FIXED_DICTIONARY}
SELECT source, count(DISTINCT id) AS n_papers
FROM docs JOIN dictionary ON {_matches("title || ' ' || text")} GROUP BY source""",
        "consolidate_papers": _batches("ASC"),
        "upsert_latest": _batches("DESC"),
        "consolidate_edges": f"""{DOCUMENTS}
SELECT DISTINCT * FROM (
  SELECT concept, paper_id FROM document_edges
  UNION ALL SELECT 'again', id FROM docs WHERE doc_id IN (SELECT doc_id FROM labels)
)""",
        "token_stats": f"""{DOCUMENTS}, {PER_CONCEPT}
SELECT count(*) AS total_papers, count(DISTINCT concept) AS total_concepts,
  round(avg({TOKENS}), 6) AS avg_tokens_per_paper,
  CAST(median({TOKENS}) AS DOUBLE) AS median_tokens_per_paper,
  CAST(max({TOKENS}) AS DOUBLE) AS max_tokens_per_paper,
  CAST(sum({TOKENS}) AS DOUBLE) AS total_tokens,
  round(count(*) / count(DISTINCT concept), 6) AS papers_per_concept,
  (SELECT round(avg(total_tokens), 6) FROM per_concept) AS avg_tokens_per_concept,
  (SELECT max(total_tokens) FROM per_concept) AS max_tokens_per_concept
FROM chosen""",
        "token_per_concept": f"{DOCUMENTS}, {PER_CONCEPT} SELECT * FROM per_concept",
        "token_budget_k": """
WITH windows AS (
  SELECT 'D' || doc_id AS id, CAST(ceil(length(text) / 4) AS BIGINT) AS context_window
  FROM documents
)
SELECT id, context_window, context_window - 2000 AS available_tokens,
  CAST(floor((context_window - 2000) / 150) AS BIGINT) AS k_short_papers,
  CAST(floor((context_window - 2000) / 280) AS BIGINT) AS k_average_papers,
  CAST(floor((context_window - 2000) / 400) AS BIGINT) AS k_long_papers
FROM windows""",
        "budget_check": f"""{DOCUMENTS}, {PER_CONCEPT},
each AS (
  SELECT *, CAST(unnest({C.CONTEXT_WINDOWS}) AS BIGINT) AS context_window FROM per_concept
)
SELECT concept, n_papers, total_tokens, max_tokens_per_paper, context_window,
  context_window - 2000 AS available_tokens,
  CAST(floor((context_window - 2000) / 150) AS BIGINT) AS k_short_papers,
  CAST(floor((context_window - 2000) / 280) AS BIGINT) AS k_average_papers,
  CAST(floor((context_window - 2000) / 400) AS BIGINT) AS k_long_papers,
  total_tokens > context_window - 2000 AS exceeds_budget
FROM each""",
        "concept_prompts": f"{PROMPTS} SELECT concept, prompt, chars_left_out FROM prompts",
        "concept_conversations": f"""{PROMPTS}
SELECT concept, 'system' AS first_role, {_sql_text(C.SYSTEM_MESSAGE)} AS first_content,
  'user' AS second_role, prompt AS second_content FROM prompts""",
        "concept_summaries": f"""{PROMPTS}
SELECT row_number() OVER (ORDER BY concept) - 1 AS id, concept, 'stop' AS finish_reason,
  CAST(length(prompt) // 4 AS INTEGER) AS tokens_generated, true AS parse_ok,
  '{{"definition": "' || length(prompt) || ' characters"}}' AS response,
  length(prompt) || ' characters' AS definition
FROM prompts""",
        "parse_responses": f"{RESPONSES} SELECT * FROM results",
        "run_stats": f"""{RESPONSES}
SELECT count(*) AS concepts_processed, CAST(sum(tokens_generated) AS BIGINT)
    AS total_tokens_generated,
  {GENERATION_SECONDS}::DOUBLE AS generation_seconds,
  round(sum(tokens_generated) / {GENERATION_SECONDS}::DOUBLE, 1) AS tokens_per_second,
  round({GENERATION_SECONDS}::DOUBLE / count(*), 3) AS avg_seconds_per_concept,
  CAST(sum(tokens_generated) // count(*) AS BIGINT) AS avg_tokens_per_concept,
  {STARTUP_SECONDS}::DOUBLE AS startup_seconds,
  {GENERATION_SECONDS + STARTUP_SECONDS}::DOUBLE AS total_wall_seconds,
  count(*) FILTER (parse_ok) AS json_parse_ok, count(*) FILTER (NOT parse_ok) AS json_parse_failed
FROM results""",
    }
