"""Representative papers per concept, kept up to date as papers arrive and change.

Every strategy is a table of cells. A cell belongs to a concept and holds its papers of
equal rank signals (hybrid), of one value and one hash slot (temporal, coverage), or all of
them (citation, recency, random). State for a cell is

* its best rows in the strategy's order: the k that a result can need, and a reserve. If
  rows had to be cut off, the order key of the last row kept is the cell's floor: all rows
  up to the floor are held. Corrections take rows away and put others in; only when fewer
  than k are left above a floor is the cell filled again from the stored changes;
* its number of papers, from which percent ranks and tiles follow without the papers.

So a batch costs what it holds and the state's size, not the corpus. Rows of a cell that a
tile's border divides are read from the stored changes when a result is asked for, all
others from the state. Texts are joined to the chosen rows alone.

Folders, by batch: ``versions`` and ``changes`` (kept: the newest versions of papers and
the stored edges), ``<strategy>/held`` and ``<strategy>/counts`` (the newest two). A
repeated batch writes the same folders again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.operators import representatives as rep
from citeweave.operators.ranking import top_k
from citeweave.session import drop_folder
from citeweave.streaming.changes import (
    ROW,
    accepted_versions,
    concept_changes,
    content_hash,
    net_changes,
    paper_versions,
)

CELL = ["concept", "cell"]
# Leading hex digits of md5(paper_id) that make a slot of a value.
SLOT_DIGITS = 1


@dataclass(frozen=True)
class Kept:
    """How a strategy cuts a concept into cells and orders a cell."""

    key: Callable[[], Column]
    needed: int
    values: Sequence[str] = ()
    slots: bool = False
    where: str | None = None
    tiles: int = 0
    tile_col: str = ""
    options: dict = field(default_factory=dict)

    @property
    def counted(self) -> bool:
        return bool(self.values)

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their cell and order key."""
        rows = self._celled(rows)
        if "num_matched_concepts" in self.values:
            rows = rows.withColumn("num_matched_concepts", _breadth())
        return rows.withColumn("key", self.key())

    def live_in(self, changes: DataFrame, cells: DataFrame) -> DataFrame:
        """Placed rows of ``cells`` that stand, from all changes.

        Equal rows have one cell, so changes of other cells go before they are set off.
        """
        inside = self._celled(changes).join(cells.select(*CELL), CELL, "left_semi")
        return self.placed(_live(inside))

    def _celled(self, rows: DataFrame) -> DataFrame:
        rows = rows if self.where is None else rows.where(self.where)
        parts = [
            F.coalesce((_breadth() if v == "num_matched_concepts" else F.col(v)).cast("string"), F.lit(""))
            for v in self.values
        ]
        if self.slots:
            parts.append(F.substring(F.md5("paper_id"), 1, SLOT_DIGITS))
        return rows.withColumn("cell", F.concat_ws("|", *parts) if parts else F.lit(""))


def _breadth() -> Column:
    return F.coalesce("num_matched_concepts", F.lit(1))


def _most_cited() -> Column:
    cites = F.col("cited_by_count")
    return F.struct(cites.isNull().alias("unknown"), (-cites).alias("cites"), F.col("paper_id"))


def _by_id() -> Column:
    return F.struct("paper_id")


def kept_by(strategy: str, k: int = C.DEFAULT_K, **options) -> Kept:
    """State of a strategy; ``options`` are those of the strategy's function."""
    if strategy == "citation":
        return Kept(_most_cited, k)
    if strategy == "recency":
        year = options.get("current_year", C.RECENCY_REFERENCE_YEAR)
        decay, digits = options.get("decay_factor", C.RECENCY_DECAY), options.get("score_digits")

        def by_score() -> Column:
            score = rep.recency_score("cited_by_count", "publication_year", year, decay)
            score = score if digits is None else F.round(score, digits)
            return F.struct((-score).alias("score"), F.col("paper_id"))

        return Kept(by_score, k, options=options)
    if strategy == "random":
        seed = options.get("seed", C.RANDOM_SEED)
        return Kept(
            lambda: F.struct(rep.random_key(seed, "concept", "paper_id").alias("h"), "paper_id"), k
        )
    if strategy == "hybrid":
        signals = ["cited_by_count", "publication_year", "num_matched_concepts"]
        return Kept(_by_id, k, signals, options=options)
    if strategy == "temporal":
        tiles = options.get("time_buckets", C.TIME_BUCKETS)
        return Kept(
            _most_cited, max(1, k // tiles), ["publication_year"], True,
            "publication_year is not null", tiles, "time_bucket",
        )
    if strategy == "coverage":
        outer = k // C.BREADTH_TIERS
        return Kept(
            _most_cited, max(outer, k - 2 * outer), ["num_matched_concepts"], True,
            "cited_by_count is not null", C.BREADTH_TIERS, "breadth_tier",
        )
    raise ValueError(f"unknown strategy {strategy!r}")


# --- state -------------------------------------------------------------------


def _read(spark: SparkSession, path: str, batch_id: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch_id={batch_id}")


def _write(frame: DataFrame, path: str, batch_id: int) -> DataFrame:
    target = f"{path}/batch_id={batch_id}"
    frame.write.mode("overwrite").option("compression", "zstd").parquet(target)
    return frame.sparkSession.read.schema(frame.schema).parquet(target)


def _live(changes: DataFrame) -> DataFrame:
    """The rows that stand, from all changes."""
    return net_changes(changes.select(*ROW, "sign")).where("sign > 0").drop("sign")


def _cut(rows: DataFrame, keep: int) -> DataFrame:
    """The best ``keep`` rows of each cell; a floor where rows are cut off or were before."""
    ranked = top_k(rows, CELL, [F.asc("key")], keep + 1, "paper_id", "_place")
    cell = W.partitionBy(*CELL)
    more = F.max("_place").over(cell) > keep
    last = F.max(F.when(F.col("_place") <= keep, F.col("key"))).over(cell)
    floor = F.when(more, last).otherwise(F.max("floor").over(cell))
    return ranked.withColumn("floor", floor).where(F.col("_place") <= keep).drop("_place")


def _merged(held: DataFrame, delta: DataFrame) -> DataFrame:
    """Held rows without those taken back, and those added down to their cell's floor."""
    gone = delta.where("sign < 0").select(*CELL, "paper_id").distinct()
    come = delta.where("sign > 0").drop("sign")
    floors = held.where("floor is not null").groupBy(*CELL).agg(F.max("floor").alias("floor"))
    come = come.join(floors, CELL, "left").where("floor is null or key <= floor")
    return held.join(gone, [*CELL, "paper_id"], "left_anti").unionByName(come)


def _short_cells(held: DataFrame, merged: DataFrame, needed: int) -> DataFrame:
    """Cells that had rows cut off and have fewer than ``needed`` left."""
    cut = held.where("floor is not null").select(*CELL).distinct()
    left = merged.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    return cut.join(left, CELL, "left").where(F.coalesce("n", F.lit(0)) < needed).select(*CELL)


def update_state(
    spark: SparkSession, state_path: str, batch_id: int, name: str, kept: Kept, reserve: int
) -> None:
    """Bring a strategy's state from the batch before to this one, by its stored changes."""
    path = f"{state_path}/{name}"
    changes = _read(spark, f"{state_path}/changes", batch_id)
    delta = kept.placed(changes)
    keep = kept.needed + reserve
    if batch_id == 0:
        come = delta.where("sign > 0").drop("sign")
        none = F.lit(None).cast(come.schema["key"].dataType)
        _write(_cut(come.withColumn("floor", none), keep), f"{path}/held", 0)
    else:
        held = _read(spark, f"{path}/held", batch_id - 1)
        merged = _write(_merged(held, delta), f"{path}/merged", batch_id)
        short = _write(_short_cells(held, merged, kept.needed), f"{path}/short", batch_id)
        if not short.isEmpty():
            so_far = spark.read.parquet(f"{state_path}/changes").where(F.col("batch_id") <= batch_id)
            pool = kept.live_in(so_far, short)
            none = F.lit(None).cast(pool.schema["key"].dataType)
            merged = merged.join(short, CELL, "left_anti").unionByName(pool.withColumn("floor", none))
        _write(_cut(merged, keep), f"{path}/held", batch_id)
        for done in ("merged", "short"):
            drop_folder(spark, f"{path}/{done}")
    if kept.counted:
        values = [*kept.values]
        counts = delta.groupBy(*CELL, *values).agg(F.sum("sign").alias("n"))
        if batch_id > 0:
            before = _read(spark, f"{path}/counts", batch_id - 1)
            counts = before.unionByName(counts).groupBy(*CELL, *values).agg(F.sum("n").alias("n"))
        _write(counts.where("n > 0"), f"{path}/counts", batch_id)
    if batch_id > 1:
        for table in ("held", "counts"):
            drop_folder(spark, f"{path}/{table}/batch_id={batch_id - 2}")


def update_representatives(
    spark: SparkSession,
    papers: DataFrame,
    state_path: str,
    checkpoint_path: str,
    strategies: Sequence[str] = ("citation",),
    k: int = C.DEFAULT_K,
    version: Column | None = None,
    reserve: int | None = None,
    options: dict[str, dict] | None = None,
) -> None:
    """Feed what has arrived of a stream of tagged papers into the state, then return.

    ``papers`` has id, title, abstract, the rank signals and matched_concepts; the version
    with the greatest ``version`` string (default: updated_date) counts. ``reserve`` rows
    are held beyond those needed (default: as many again).
    """
    version = F.col("updated_date").cast("string") if version is None else version
    plans = {s: kept_by(s, k, **(options or {}).get(s, {})) for s in strategies}

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        log = f"{state_path}/versions"
        arrived = _write(paper_versions(batch, version), f"{state_path}/arrived", batch_id)
        accepted = _write(accepted_versions(session, arrived, log, batch_id), log, batch_id)
        ordered = concept_changes(accepted).repartitionByRange("concept", "paper_id")
        _write(ordered.sortWithinPartitions("concept"), f"{state_path}/changes", batch_id)
        drop_folder(session, f"{state_path}/arrived")
        for name, kept in plans.items():
            spare = kept.needed if reserve is None else reserve
            update_state(session, state_path, batch_id, name, kept, spare)

    query = (
        papers.writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


# --- results -----------------------------------------------------------------


def _newest(spark: SparkSession, state_path: str, name: str) -> int:
    states = spark.read.parquet(f"{state_path}/{name}/held").select("batch_id")
    return states.agg(F.max("batch_id")).first()[0]


def _by_order(held: DataFrame, kept: Kept, k: int) -> DataFrame:
    return top_k(held, ["concept"], [F.asc("key")], k, "paper_id")


def _by_scores(held: DataFrame, counts: DataFrame, kept: Kept, k: int) -> DataFrame:
    ranks = rep.triple_ranks(counts.withColumnRenamed("n", "n_papers"))
    scores = ranks.select(*CELL, rep.composite(kept.options.get("score_digits")).alias("composite_score"))
    order = [F.asc_nulls_last("composite_score"), F.asc("paper_id")]
    best = top_k(scores, ["concept"], [F.asc("composite_score")], k, "cell", "_place")
    # Cells past the k-th of a concept hold no chosen paper, unless they tie with it.
    last = best.groupBy("concept").agg(F.max("composite_score").alias("_last"))
    near = scores.join(last, "concept").where("composite_score <= _last").drop("_last")
    return top_k(held.join(near, CELL), ["concept"], order, k, "paper_id")


def _by_tiles(
    held: DataFrame, counts: DataFrame, changes: DataFrame, kept: Kept, k: Column
) -> DataFrame:
    """Best rows of each tile: whole cells from the state, divided ones row by row."""
    value, tile_col = kept.values[0], kept.tile_col
    slot = F.element_at(F.split("cell", r"\|"), -1)
    order = W.partitionBy("concept").orderBy(value, slot)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy("concept"))
    cells = counts.select(*CELL, "n", before.alias("before"), total.alias("total"))
    cells = cells.withColumn("low", _tile(F.col("before"), kept.tiles))
    cells = cells.withColumn("high", _tile(F.col("before") + F.col("n") - 1, kept.tiles))
    whole = held.join(cells.where("low = high").select(*CELL, F.col("low").alias(tile_col)), CELL)
    divided = cells.where("low < high").select(*CELL, "before", "total")
    rows = kept.live_in(changes, divided).join(divided, CELL)
    inside = F.row_number().over(W.partitionBy(*CELL).orderBy(F.md5("paper_id"), "paper_id"))
    place = F.col("before") + inside - 1
    rows = rows.withColumn("_place", place).withColumn(tile_col, _tile(F.col("_place"), kept.tiles))
    columns = [*ROW, tile_col]
    tiled = whole.select(*columns).unionByName(rows.select(*columns))
    most_cited = [F.desc_nulls_last("cited_by_count"), F.asc("paper_id")]
    return top_k(tiled, ["concept", tile_col], most_cited, k, "paper_id", max_k=kept.needed)


def _tile(place: Column, tiles: int) -> Column:
    """Tile of the 0-based place among ``total`` rows; the first tiles are one larger."""
    small, larger = F.floor(F.col("total") / tiles), F.col("total") % tiles
    inside = F.floor((place - larger * (small + 1)) / small)
    tile = F.when(place < larger * (small + 1), F.floor(place / (small + 1))).otherwise(larger + inside)
    return (tile + 1).cast("bigint")


def current_representatives(
    spark: SparkSession,
    state_path: str,
    texts: DataFrame,
    strategy: str,
    k: int = C.DEFAULT_K,
    **options,
) -> DataFrame:
    """The strategy's rows for the newest state, as its function gives them.

    ``texts`` are the papers that have arrived, with the columns that the stream had.
    """
    kept = kept_by(strategy, k, **options)
    path, newest = f"{state_path}/{strategy}", _newest(spark, state_path, strategy)
    held = _read(spark, f"{path}/held", newest).drop("floor")
    shown = [c for c in ROW if c != "num_matched_concepts"]
    if not kept.counted:
        chosen = _by_order(held, kept, k)
        if strategy == "recency":
            chosen = chosen.withColumn("weighted_score", -F.col("key.score"))
            shown.append("weighted_score")
    else:
        counts = _read(spark, f"{path}/counts", newest)
        if kept.tiles:
            outer = k // C.BREADTH_TIERS
            each = F.lit(kept.needed)
            if strategy == "coverage":
                each = F.when(F.col(kept.tile_col) == 2, F.lit(k - 2 * outer)).otherwise(F.lit(outer))
            changes = spark.read.parquet(f"{state_path}/changes").where(F.col("batch_id") <= newest)
            chosen = _by_tiles(held, counts, changes, kept, each)
            shown += ["num_matched_concepts"] * (strategy == "coverage") + [kept.tile_col]
        else:
            chosen = _by_scores(held, counts, kept, k)
            shown += ["num_matched_concepts", "composite_score"]
    named = texts.select(
        F.col("id").alias("paper_id"), content_hash().alias("content"), "title", "abstract"
    )
    found = rep.with_texts(chosen.select(*shown, "rank"), named, ["paper_id", "content"])
    # A paper that was delivered twice brings its text twice.
    return found.dropDuplicates(["concept", "paper_id"]).drop("content")
