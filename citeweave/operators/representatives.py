"""k representative papers per concept, six ways.

All strategies share one shape: papers with a usable title and abstract are
joined to the edges on narrow rows (no text), the rows are ranked and cut per
concept, and title and abstract are joined back to what is left, without a shuffle of the
texts of papers that were not chosen.

``papers``: id, title, abstract, publication_year, cited_by_count,
num_matched_concepts and, if it was stored, the ``readable`` flag. ``edges``: distinct (concept, paper_id), neither null.
Paper ids must be unique; with ``shard_col`` they need only be unique within a
shard, the join stays inside a shard, and the tiles of the temporal and coverage
strategies are formed per shard.

Top-k cuts itself down before it shuffles. Tiles and percent ranks follow from
counts per value, so no task sees a whole concept, however many papers it has.

Ties are broken by paper_id (for tiles: by md5 of it), so results are stable.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.functions.text import has_text
from citeweave.operators.ranking import (
    spread_ntile,
    top_k,
    value_percent_rank,
    within_rank,
)
from citeweave.operators.semifilter import may_match
from citeweave.schemas import READABLE
from citeweave.session import ensure_checkpoint_dir

# Chosen rows are broadcast to the text scan up to this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024

PAPER_ID = "paper_id"

# What the hybrid score ranks, and the name of each rank.
SIGNALS = {
    "cited_by_count": "citation_prank",
    "publication_year": "recency_prank",
    "num_matched_concepts": "breadth_prank",
}


def citation_count(
    papers: DataFrame,
    edges: DataFrame,
    k: int = C.DEFAULT_K,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
    stage: bool = True,
) -> DataFrame:
    """Most cited papers first, unknown counts last."""
    rows = _tagged(papers, edges, concepts, shard_col, ["publication_year", "cited_by_count"])
    chosen = top_k(rows, ["concept"], [_most_cited(), F.asc(PAPER_ID)], k, PAPER_ID)
    return _with_text(chosen, papers, shard_col, stage)


def recency_weighted(
    papers: DataFrame,
    edges: DataFrame,
    k: int = C.DEFAULT_K,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
    stage: bool = True,
    current_year: int = C.RECENCY_REFERENCE_YEAR,
    decay_factor: float = C.RECENCY_DECAY,
    score_digits: int | None = None,
) -> DataFrame:
    """Citations discounted by age. Years after ``current_year`` are boosted.

    With ``score_digits`` the score is rounded before ranking.
    """
    rows = _tagged(papers, edges, concepts, shard_col, ["publication_year", "cited_by_count"])
    score = recency_score("cited_by_count", "publication_year", current_year, decay_factor)
    rows = rows.withColumn("weighted_score", _rounded(score, score_digits))
    order = [F.desc_nulls_last("weighted_score"), F.asc(PAPER_ID)]
    return _with_text(top_k(rows, ["concept"], order, k, PAPER_ID), papers, shard_col, stage)


def temporal_diversity(
    papers: DataFrame,
    edges: DataFrame,
    k: int = C.DEFAULT_K,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
    stage: bool = True,
    time_buckets: int = C.TIME_BUCKETS,
) -> DataFrame:
    """Most cited papers of each of ``time_buckets`` equal slices of the years.

    Every slice gives max(1, k // time_buckets) papers. ``rank`` counts within
    the slice.
    """
    dated = papers.where(F.col("publication_year").isNotNull())
    chosen = _best_of_tiles(
        dated, edges, concepts, shard_col,
        columns=["publication_year", "cited_by_count"],
        value="publication_year",
        tiles=time_buckets,
        tile_col="time_bucket",
        k=F.lit(max(1, k // time_buckets)),
        max_k=max(1, k // time_buckets),
    )
    return _with_text(chosen, papers, shard_col, stage)


def coverage_diversity(
    papers: DataFrame,
    edges: DataFrame,
    k: int = C.DEFAULT_K,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
    stage: bool = True,
) -> DataFrame:
    """Most cited papers among narrow, medium and broad ones.

    Breadth is the number of concepts matched in the paper, cut into three equal
    tiers; the outer tiers give k // 3 papers each, the middle one the rest.
    ``rank`` counts within the tier.
    """
    outer = k // C.BREADTH_TIERS
    middle = k - 2 * outer
    cited = papers.where(F.col("cited_by_count").isNotNull())
    chosen = _best_of_tiles(
        cited, edges, concepts, shard_col,
        columns=["publication_year", "cited_by_count", _breadth()],
        value="num_matched_concepts",
        tiles=C.BREADTH_TIERS,
        tile_col="breadth_tier",
        k=F.when(F.col("breadth_tier") == 2, F.lit(middle)).otherwise(F.lit(outer)),
        max_k=max(outer, middle),
    )
    return _with_text(chosen, papers, shard_col, stage)


def hybrid(
    papers: DataFrame,
    edges: DataFrame,
    k: int = C.DEFAULT_K,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
    stage: bool = True,
    score_digits: int | None = None,
) -> DataFrame:
    """Lowest weighted sum of the percent ranks of citations, year and breadth."""
    order = [F.asc_nulls_last("composite_score"), F.asc(PAPER_ID)]
    columns = ["publication_year", "cited_by_count", _breadth()]
    rows = _tagged(papers, edges, concepts, shard_col, columns)
    contenders = _contenders(rows, k, score_digits)
    chosen = top_k(contenders, ["concept"], order, k, PAPER_ID)
    return _with_text(chosen, papers, shard_col, stage)


def random_sample(
    papers: DataFrame,
    edges: DataFrame,
    k: int = C.DEFAULT_K,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
    stage: bool = True,
    seed: int = C.RANDOM_SEED,
) -> DataFrame:
    """k papers per concept, uniform for a given seed.

    The order is that of a hash over seed, concept and paper, so it does not
    depend on how the data is partitioned.
    """
    rows = _tagged(papers, edges, concepts, shard_col, ["publication_year", "cited_by_count"])
    rows = rows.withColumn("_key", random_key(seed, "concept", PAPER_ID))
    chosen = top_k(rows, ["concept"], [F.asc("_key"), F.asc(PAPER_ID)], k, PAPER_ID)
    return _with_text(chosen.drop("_key"), papers, shard_col, stage)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "citation": citation_count,
    "recency": recency_weighted,
    "temporal": temporal_diversity,
    "coverage": coverage_diversity,
    "hybrid": hybrid,
    "random": random_sample,
}


def select_representatives(
    papers: DataFrame,
    edges: DataFrame,
    strategy: str = C.DEFAULT_STRATEGY,
    k: int = C.CLI_DEFAULT_K,
    **options,
) -> DataFrame:
    """Run a strategy by name."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {', '.join(STRATEGIES)}")
    return STRATEGIES[strategy](papers, edges, k=k, **options)


def rank_in_shard(
    papers: DataFrame, edges: DataFrame, shard_col: str, k: int = C.DEFAULT_K
) -> DataFrame:
    """Most cited papers of each concept within each shard (no text columns)."""
    rows = _tagged(papers, edges, None, shard_col, ["publication_year", "cited_by_count"])
    order = [_most_cited(), F.asc(PAPER_ID)]
    return top_k(rows, [shard_col, "concept"], order, k, PAPER_ID, "rank_in_shard")


def signal_percent_ranks(
    papers: DataFrame,
    edges: DataFrame,
    concepts: Sequence[str] | None = None,
    shard_col: str | None = None,
) -> DataFrame:
    """The hybrid strategy's three percent ranks for every distinct triple of a
    concept, with the number of papers that share it."""
    rows = _tagged(
        papers, edges, concepts, shard_col, ["publication_year", "cited_by_count", _breadth()]
    )
    return _signal_ranks(rows)


def recency_score(
    cites: str, year: str, current_year: int, decay_factor: float
) -> Column:
    age = F.lit(current_year) - F.coalesce(F.col(year), F.lit(current_year))
    return F.coalesce(F.col(cites), F.lit(0)) * F.exp(F.lit(-float(decay_factor)) * age)


def random_key(seed: int, concept: str, paper_id: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(concept), F.col(paper_id)))


def final_order(chosen: DataFrame) -> DataFrame:
    """The order for a sink: concept, then tile if there is one, then rank."""
    tiles = [c for c in ("time_bucket", "breadth_tier") if c in chosen.columns]
    return chosen.orderBy(*[F.asc_nulls_last(c) for c in ["concept", *tiles, "rank"]])


def _tagged(
    papers: DataFrame,
    edges: DataFrame,
    concepts: Sequence[str] | None,
    shard_col: str | None,
    columns: Sequence[str | Column],
) -> DataFrame:
    """(concept, paper) rows of papers with text, without the text."""
    on = [PAPER_ID] + ([shard_col] if shard_col else [])
    shard = [shard_col] if shard_col else []
    readable = papers.where(_readable(papers)).select(
        F.col("id").alias(PAPER_ID), *shard, *columns
    )
    return _of_concepts(edges, concepts).select("concept", *on).join(readable, on)


def _readable(papers: DataFrame) -> Column:
    """The stored flag if the table has it, so that ranking reads no text at all."""
    if READABLE in papers.columns:
        return F.col(READABLE)
    return has_text("title") & has_text("abstract")


def _of_concepts(edges: DataFrame, concepts: Sequence[str] | None) -> DataFrame:
    """Keep the named concepts (all of them if none are named).

    Names are compared exactly; dictionary concepts are lower case. The list is pushed to
    the scan, so files and row groups outside its range are skipped.
    """
    return edges.where(F.col("concept").isin(sorted(set(concepts)))) if concepts else edges


def _with_text(
    chosen: DataFrame, papers: DataFrame, shard_col: str | None, stage: bool = True
) -> DataFrame:
    """Join title and abstract back to the chosen rows.

    The chosen rows are checkpointed first, so that their exact size is known. If they fit
    they are broadcast and texts are scanned, not shuffled. Beyond that, a bitmap of the
    chosen ids goes to the scan, so that only texts of chosen papers (and a few by chance)
    are shuffled. ``stage=False`` runs no job here and leaves the join to Catalyst.
    """
    on = [PAPER_ID] + ([shard_col] if shard_col else [])
    texts = papers.select(
        F.col("id").alias(PAPER_ID), "title", "abstract", *([shard_col] if shard_col else [])
    )
    return with_texts(chosen, texts, on, stage)


def with_texts(
    chosen: DataFrame, texts: DataFrame, on: Sequence[str], stage: bool = True
) -> DataFrame:
    """Chosen rows with the title and abstract of ``texts``, joined on ``on``."""
    if stage:
        ensure_checkpoint_dir(chosen.sparkSession)
        chosen = chosen.checkpoint()
        widths = sum(F.length(F.coalesce(F.col(c), F.lit(""))) for c in ("concept", PAPER_ID))
        size = chosen.agg(F.sum(widths + F.lit(64))).first()[0] or 0
        if size <= BROADCAST_BYTES:
            chosen = F.broadcast(chosen)
        else:
            texts = may_match(texts, F.struct(*on), chosen, F.struct(*on))
    joined = chosen.join(texts, list(on))
    lead = ["concept", "paper_id", "title", "abstract", "publication_year", "cited_by_count"]
    rest = [c for c in joined.columns if c not in (*lead, "rank")]
    return joined.select(*lead, *rest, "rank")


def _signal_ranks(rows: DataFrame) -> DataFrame:
    triples = rows.groupBy(
        "concept", "cited_by_count", "publication_year", "num_matched_concepts"
    ).agg(F.count(F.lit(1)).alias("n_papers"))
    return triple_ranks(triples)


def triple_ranks(triples: DataFrame) -> DataFrame:
    """Percent ranks of (citations, year, breadth) triples with ``n_papers`` papers each."""
    ranked = triples
    for value, out in SIGNALS.items():
        shares = value_percent_rank(triples, ["concept"], value, "n_papers", out).select(
            F.col("concept").alias("_c"), F.col(value).alias("_v"), out
        )
        same = (F.col("concept") == F.col("_c")) & F.col(value).eqNullSafe(F.col("_v"))
        ranked = ranked.join(shares, same).drop("_c", "_v")
    return ranked


def _contenders(rows: DataFrame, k: int, score_digits: int | None) -> DataFrame:
    """Rows that can be among a concept's best k, with their composite score.

    The score depends on (citations, year, breadth) alone, so it is worked out
    per distinct triple of a concept. A triple with k or more better triples is
    out, since each of those holds a paper.
    """
    scored = _signal_ranks(rows).withColumn("composite_score", composite(score_digits))
    best = within_rank(scored, ["concept"], [F.asc("composite_score")], k, "cited_by_count")
    triples = best.select(
        F.col("concept").alias("_concept"),
        *[F.col(s).alias(f"_{s}") for s in SIGNALS],
        "composite_score",
    )
    same = F.col("concept") == F.col("_concept")
    for signal in SIGNALS:
        same = same & F.col(signal).eqNullSafe(F.col(f"_{signal}"))
    return rows.join(triples, same).drop("_concept", *[f"_{s}" for s in SIGNALS])


def composite(digits: int | None) -> Column:
    return _rounded(
        C.HYBRID_WEIGHT_CITATIONS * F.col("citation_prank")
        + C.HYBRID_WEIGHT_RECENCY * F.col("recency_prank")
        + C.HYBRID_WEIGHT_BREADTH * F.col("breadth_prank"),
        digits,
    )


def _best_of_tiles(
    papers: DataFrame,
    edges: DataFrame,
    concepts: Sequence[str] | None,
    shard_col: str | None,
    columns: Sequence[str | Column],
    value: str,
    tiles: int,
    tile_col: str,
    k: Column,
    max_k: int,
) -> DataFrame:
    """Most cited papers of every tile of every concept."""
    keys = ([shard_col] if shard_col else []) + ["concept"]
    rows = _tagged(papers, edges, concepts, shard_col, columns)
    tiled = spread_ntile(rows, keys, value, PAPER_ID, tiles, tile_col)
    order = [_most_cited(), F.asc(PAPER_ID)]
    return top_k(tiled, ["concept", tile_col], order, k, PAPER_ID, max_k=max_k)


def _most_cited() -> Column:
    return F.desc_nulls_last("cited_by_count")


def _breadth() -> Column:
    return F.coalesce(F.col("num_matched_concepts"), F.lit(1)).alias("num_matched_concepts")


def _rounded(score: Column, digits: int | None) -> Column:
    return score if digits is None else F.round(score, digits)
