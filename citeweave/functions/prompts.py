"""Prompt text and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.functions.text import strip


def _first(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.substring(text, 1, chars)


def paper_block(
    number: Column,
    paper: Column,
    title_chars: int | None = C.PROMPT_TITLE_CHARS,
    abstract_chars: int | None = C.PROMPT_ABSTRACT_CHARS,
) -> Column:
    """One numbered paper of a prompt; abstract and year only if there are any.

    Title and abstract are cut to so many characters; None leaves them whole.
    """
    abstract = F.coalesce(paper["abstract"], F.lit(""))
    year = paper["year"]
    return F.concat(
        F.lit("Paper "),
        number.cast("string"),
        F.lit(":\n  Title: "),
        _first(F.coalesce(paper["title"], F.lit("")), title_chars),
        F.when(strip(abstract) == "", "").otherwise(
            F.concat(F.lit("\n  Abstract: "), _first(abstract, abstract_chars))
        ),
        F.when(year.isNull() | (year == 0), "").otherwise(
            F.concat(F.lit("\n  Year: "), year.cast("string"))
        ),
        F.lit("\n  Citations: "),
        F.coalesce(paper["citations"], F.lit(0)).cast("string"),
    )


def left_out(
    papers: str,
    title_chars: int | None = C.PROMPT_TITLE_CHARS,
    abstract_chars: int | None = C.PROMPT_ABSTRACT_CHARS,
) -> Column:
    """Characters of titles and abstracts that a prompt's cuts leave out."""

    def beyond(text: Column, chars: int | None) -> Column:
        if chars is None:
            return F.lit(0)
        return F.greatest(F.length(F.coalesce(text, F.lit(""))) - chars, F.lit(0))

    return F.aggregate(
        papers,
        F.lit(0).cast("long"),
        lambda n, p: n + beyond(p["title"], title_chars) + beyond(p["abstract"], abstract_chars),
    )


def summary_prompt(
    concept: str,
    papers: str,
    title_chars: int | None = C.PROMPT_TITLE_CHARS,
    abstract_chars: int | None = C.PROMPT_ABSTRACT_CHARS,
) -> Column:
    """The user message for a concept and its ordered array of papers."""
    blocks = F.transform(papers, lambda p, i: paper_block(i + 1, p, title_chars, abstract_chars))
    return F.concat(
        F.lit(C.PROMPT_HEAD_BEFORE_CONCEPT),
        F.col(concept),
        F.lit(C.PROMPT_HEAD_AFTER_CONCEPT),
        F.lit("\n\n"),
        F.array_join(blocks, "\n\n"),
        F.lit("\n\n"),
        F.lit(C.PROMPT_INSTRUCTIONS),
    )


def conversation(prompt: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(message("system", F.lit(C.SYSTEM_MESSAGE)), message("user", prompt))
