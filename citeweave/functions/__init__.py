"""Column expressions: Column in, Column out, no Python on the row path."""

from citeweave.functions.abstracts import rebuild_abstract, rebuild_abstract_json
from citeweave.functions.dates import safe_date
from citeweave.functions.text import combined_text, estimated_tokens, has_text

__all__ = [
    "combined_text",
    "estimated_tokens",
    "has_text",
    "rebuild_abstract",
    "rebuild_abstract_json",
    "safe_date",
]
