"""Works to papers: rebuild the text, tag it, keep what has a tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeweave.functions.abstracts import rebuild_abstract, rebuild_abstract_json
from citeweave.functions.text import combined_text, year_in_range
from citeweave.operators.matching import match_concepts, matched_arrays
from citeweave.schemas import PAPER
from citeweave.sources.works import usable


def parse_works(
    works: DataFrame, start_year: int | None = None, end_year: int | None = None
) -> DataFrame:
    """Raw works to paper fields with defaults, abstract rebuilt.

    Lines that could not be read and works outside the years are left out; a work without
    an id has ''. Other columns (update date, source file) stay.
    """
    fields = {
        "id": F.coalesce("id", F.lit("")),
        "title": F.coalesce("title", F.lit("")),
        "abstract": _abstract(works),
        "cited_by_count": F.coalesce("cited_by_count", F.lit(0)),
        "counts_by_year": F.coalesce("counts_by_year", F.lit("[]")),
    }
    kept = usable(works)
    if start_year or end_year:
        kept = kept.where(year_in_range("publication_year", start_year, end_year))
    return kept.withColumns(fields).drop("abstract_inverted_index", "_corrupt_record")


def _abstract(works: DataFrame) -> Column:
    """From the index as read, or from the whole line where reading it failed."""
    index = F.col("abstract_inverted_index")
    abstract = F.when(index.isNotNull(), rebuild_abstract(index))
    if "_corrupt_record" in works.columns:
        line = F.col("_corrupt_record")
        raw = F.get_json_object(line, "$.abstract_inverted_index")
        abstract = abstract.when(line.isNotNull(), rebuild_abstract_json(raw))
    return abstract.otherwise("")


def tag_papers(parsed: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Add matched_concepts and num_matched_concepts; papers without a hit go.

    Hits are found where the text lies and only (id, text digest, concept) is
    shuffled; the digest keeps versions of one id apart.
    """
    texts = parsed.withColumn("_text", combined_text("title", "abstract")).withColumn(
        "_digest", F.md5("_text")
    )
    keys = ["id", "_digest"]
    hits = match_concepts(texts.select(*keys, "_text"), dictionary, keys, "_text")
    tagged = texts.drop("_text").join(matched_arrays(hits, keys), keys)
    tagged = tagged.drop("_digest").withColumn("processed_date", F.current_timestamp())
    lead = [f.name for f in PAPER if f.name in tagged.columns]
    return tagged.select(*lead, *[c for c in tagged.columns if c not in lead])


def ingest_counters(papers: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Tagged papers per input file."""
    return papers.groupBy(file_col).agg(F.count(F.lit(1)).alias("n_papers"))
