"""Fixed values.

These must equal the published pipeline's values for results to agree, so they
are kept together here and stated as they are.
"""

# --- selection ---------------------------------------------------------------
DEFAULT_K = 30
CLI_DEFAULT_K = 100
DEFAULT_STRATEGY = "hybrid"
RECENCY_REFERENCE_YEAR = 2026
RECENCY_DECAY = 0.1
TIME_BUCKETS = 5
BREADTH_TIERS = 3
HYBRID_WEIGHT_CITATIONS = 0.5
HYBRID_WEIGHT_RECENCY = 0.3
HYBRID_WEIGHT_BREADTH = 0.2
RANDOM_SEED = 42

# --- distribution ------------------------------------------------------------
HISTOGRAM_BINS = 100
TOP_CONCEPTS = 30
PREVIEW_ROWS = 10

# --- token budgets -----------------------------------------------------------
CHARS_PER_TOKEN = 4.0
DEFAULT_CONTEXT_WINDOW = 8192
RESERVED_TOKENS = 2000
CONTEXT_WINDOWS = [8192, 16384, 32768, 65536, 131072]
TOKENS_PER_PAPER = {"short_papers": 150, "average_papers": 280, "long_papers": 400}

# --- ingest ------------------------------------------------------------------
DOCS_PER_BATCH = 50_000
BYTES_PER_TRIGGER = 32 << 30  # ours: works files of one batch together

# --- summaries ---------------------------------------------------------------
PROMPT_PAPERS = 10
PROMPT_TITLE_CHARS = 500
PROMPT_ABSTRACT_CHARS = 10_000
SYSTEM_MESSAGE = (
    "Reasoning: low\n"
    "You are a precise scientific assistant that summarizes research concepts. "
    "You MUST respond with ONLY a single valid JSON object — no preamble, "
    "no explanation, no markdown fences, no text before or after the JSON. "
    "Start your response with { and end with }. "
    "Do not repeat yourself."
)
PROMPT_HEAD_BEFORE_CONCEPT = (
    'Based on the following representative papers for the concept "'
)
PROMPT_HEAD_AFTER_CONCEPT = (
    '", provide a concise summary of what this concept represents in scientific research.'
)
PROMPT_INSTRUCTIONS = """Respond ONLY with a JSON object with the following keys:
- concept: the concept name
- definition: a clear 1-2 sentence definition of this concept
- key_themes: list of 3-5 main research themes or topics within this concept
- typical_applications: list of 2-4 typical applications or use cases
- related_fields: list of 2-4 related scientific fields or disciplines
- summary: a concise 2-3 sentence overview suitable for researchers unfamiliar with this concept
- research_trends: a brief note on any notable research trends or recent developments related to this concept"""
RESPONSE_SPANS = [
    r"<\|channel\|>analysis.*?<\|end\|>",
    r"<\|channel\|>commentary.*?<\|end\|>",
    r"<analysis>.*?</analysis>",
]
RESPONSE_FENCES = r"```json|```"
RESPONSE_OBJECT = r"\{.*\}"
PARSE_FAILURE = "json_parse_failed"
