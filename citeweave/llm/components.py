"""Connected components by alternating stars, and linking without all pairs of a group."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citeweave.llm.common import dropped, stored


# Rounds in which an id meets one pivot.
ROUNDS = 2
# Rows of a key that meet at first, about, and by how much more in each further round.
WIDTH = 32
WIDER = 16
# How often ids with too few keys are left out, which leaves others with fewer.
PRUNED = 2
# Longs of a parity sketch.
SKETCH = 16
SKETCH_COLUMNS = [f"parity_{i}" for i in range(SKETCH)]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m")
    return (
        moved.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        .union(least.select("hi", F.col("m").alias("lo")))
        .distinct()
    )


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("hi"), F.expr("bit_xor(xxhash64(hi, lo))")).first())


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``id, component`` of every linked node that is not its component's smallest id.

    ``links`` has long columns ``a, b``. Large and small stars alternate until the
    edges stay the same; they are stored after every round, and only their number and
    checksum reach the driver. A round's edges go when the next ones are written.
    """
    edges = links.where("a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    )
    edges = stored(spark, edges.distinct(), "edges")
    before = _digest(edges)
    while before[0]:
        last, edges = edges, stored(spark, _small_star(_large_star(edges)), "edges")
        after = _digest(edges)
        dropped(spark, last)
        if after == before:
            break
        before = after
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component"))


def _apart(pairs: DataFrame, found: DataFrame, labels: bool = False) -> DataFrame:
    """The pairs whose ids are in different components so far, or (``labels``) these."""
    one = found.select(F.col("id").alias("a"), F.col("component").alias("_a"))
    two = found.select(F.col("id").alias("b"), F.col("component").alias("_b"))
    labelled = pairs.join(one, "a", "left").join(two, "b", "left")
    ends = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    apart = labelled.where(ends[0] != ends[1])
    return apart.select(ends[0].alias("a"), ends[1].alias("b")) if labels else apart.select(*pairs.columns)


def linked_components(
    spark: SparkSession, pairs: DataFrame, verify: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Components of the graph whose links are the verified ones of pairs ``a, b`` (a < b).

    An id is compared with its smallest partner first, then with those still in another component.
    """
    found = spark.createDataFrame([], "id long, component long")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    found = _verified_more(spark, found, first, verify)
    rest = _apart(pairs.join(first, ["a", "b"], "left_anti"), found)
    return _verified_more(spark, found, rest, verify)


def parity_sketches(items: DataFrame) -> DataFrame:
    """``id`` and a sketch of each id's items, from rows ``id, item``.

    Each of 64 cells a long holds whether an odd number of items fell into it, so two
    sketches differ in no more cells than there are items that only one of both ids has.
    """
    cell = F.pmod(F.xxhash64("item"), F.lit(64 * SKETCH)).cast("int")
    placed = items.select("id", cell.alias("cell"))
    placed = placed.withColumn("bit", F.expr("shiftleft(1L, cell % 64)"))
    odd = [
        F.coalesce(F.bit_xor(F.when(F.expr(f"cell div 64 = {i}"), F.col("bit"))), F.lit(0)).cast("long").alias(c)
        for i, c in enumerate(SKETCH_COLUMNS)
    ]
    return placed.groupBy("id").agg(*odd)


def _able(rows: DataFrame, left: Column, least: Callable[[Column, Column], Column]) -> DataFrame:
    """Rows (``id, value, low``) of the ids that have ``left`` keys or more to be linked by."""
    own = W.partitionBy("id")
    rows = rows.withColumn("_left", left).withColumn("_least", F.min(least(F.col("value"), F.col("low"))).over(own))
    return rows.where(F.col("_left") >= F.col("_least")).drop("_left", "_least", "low")


def _apart_rows(
    rows: DataFrame, found: DataFrame, least: Callable[[Column, Column], Column] | None
) -> DataFrame:
    """Rows of keys whose ids are in different components, with ``component`` and ``m``.

    ``m`` is the number of a key's rows. Ids with too few such keys are left out.
    """
    own = rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    for _ in range(1 if least is None else PRUNED):
        own = _of_divided_keys(own, least)
    return own


def _of_divided_keys(
    own: DataFrame, least: Callable[[Column, Column], Column] | None
) -> DataFrame:
    own = own.drop("m").repartition("key")
    both = own.groupBy("key").agg(
        F.min("component").alias("least"),
        F.max("component").alias("top"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).alias("m"),
    )
    own = own.join(both.where("least < top").select("key", "low", "m"), "key")
    if least is None:
        return own.drop("low")
    return _able(own, F.count(F.lit(1)).over(W.partitionBy("id")), least)


def counted_components(
    spark: SparkSession,
    rows: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    near: Callable[[Column, Column], Column],
    needed: Callable[[Column, Column], Column],
    spare: Callable[[Column], Column] | None = None,
    sketches: Callable[[DataFrame], DataFrame] | None = None,
    differing: Callable[[Column, Column], Column] | None = None,
    least: Callable[[Column, Column], Column] | None = None,
    prepare: Callable[[DataFrame], None] | None = None,
    alike: Callable[[str, str], Column] | None = None,
    found: DataFrame | None = None,
) -> DataFrame:
    """Components of the graph whose links are verified pairs that share enough keys.

    ``rows`` has long columns ``key, id, value``, a value being the id's. ``spare`` tells by
    its value how many of its most frequent keys an id can do without: those are dropped,
    by the number of ids that have a key, so that the most common keys make few pairs. Two
    ids that are linked are ``near`` by their values and share as many of the keys that are
    left as ``needed`` says of both values; ``verify`` takes pairs ``a, b`` and returns
    (stored) links. ``least`` says of an id's value and the smallest value among a key's ids
    how many keys the id shares at least with any that it is linked to by that key: ids with
    fewer keys that others have too are left out. ``prepare`` is called once with the ids
    that may be linked, before ``verify``. ``found`` (``id, component``) is what is known of the
    components before.

    Counts of shared keys are accumulated per pair before anything is verified, and pairs
    below their bound are dropped. A group of m rows with one key does not make m² pairs:
    an id meets its keys' pivots (the smallest id of a key) first, for some rounds one at a
    time, that of most shared keys among those still in another component. Then only rows
    of keys whose rows are still in different components meet: first in blocks of about
    ``WIDTH`` rows of a key, dealt by a hash of the id, then in wider ones, and last in full,
    and after each round keys whose rows have come together are done. So an id meets few of
    the many rows of a component before it is one of them; no link between components is
    missed, and links inside one are not needed.
    Of a large group whose rows are not linked all pairs are still compared in the last
    round, but only by their sketches: ``sketches`` takes ids and returns them with
    ``SKETCH_COLUMNS`` (see ``parity_sketches``) and other columns, if any. The sketches of two
    linked ids differ in ``differing`` cells at most, by both values, and what ``alike`` says of
    the suffixes of both sides' columns is true of them. Other pairs make no row.
    """
    dealt = rows.repartition("key")
    ends = dealt.groupBy("key").agg(
        F.min("id").alias("first"),
        F.max("id").alias("top"),
        F.min("value").alias("low"),
        F.count(F.lit(1)).alias("m"),
    )
    shared = dealt.join(ends.where("first < top").select("key", "low", "m"), "key")
    if spare is not None:
        frequent = W.partitionBy("id").orderBy(F.desc("m"), F.asc("key"))
        shared = shared.withColumn("place", F.row_number().over(frequent))
        shared = shared.where(F.col("place") > spare(F.col("value"))).drop("place")
    if least is not None:
        shared = _able(shared, F.count(F.lit(1)).over(W.partitionBy("id")), least)
    shared = stored(spark, shared.select("key", "id", "value"), "shared")
    if prepare is not None:
        prepare(shared.select("id").distinct())

    dealt = shared.repartition("key")
    pivots = dealt.groupBy("key").agg(
        F.min(F.struct("id", "value")).alias("p"), F.max("id").alias("top")
    )
    pivots = pivots.where("p.id < top").select(
        "key", F.col("p.id").alias("pivot"), F.col("p.value").alias("pivot_value")
    )
    bound = needed(F.col("value"), F.col("pivot_value"))
    met = dealt.join(pivots, "key").where("id <> pivot")
    met = met.where(near(F.col("value"), F.col("pivot_value")))
    met = met.groupBy("id", "pivot").agg(
        F.count(F.lit(1)).alias("n"), F.min(bound).alias("bound")
    )
    met = stored(spark, met.where("n >= bound").select("id", "pivot", "n"), "met")
    ends_of = [F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")]
    pairs = met.groupBy(*ends_of).agg(F.max("n").alias("n"))
    if found is None:
        found = spark.createDataFrame([], "id long, component long")
    for turn in range(ROUNDS):
        left = stored(spark, _apart(pairs, found), "left")
        if turn and left.isEmpty():
            dropped(spark, pairs)
            pairs = left
            break
        other = left.select(F.col("a").alias("id"), "a", "b", "n").union(
            left.select(F.col("b").alias("id"), "a", "b", "n")
        )
        best = F.max(F.struct("n", F.bitwise_not("a").alias("x"), F.bitwise_not("b").alias("y")))
        one = other.groupBy("id").agg(best.alias("p"))
        one = one.select(F.bitwise_not("p.x").alias("a"), F.bitwise_not("p.y").alias("b")).distinct()
        found = _verified_more(spark, found, one, verify)
        # What is left here meets again below.
        dropped(spark, met if turn == 0 else pairs)
        pairs = left.join(one, ["a", "b"], "left_anti")
        pairs, last = stored(spark, pairs, "rest"), left
        dropped(spark, last)
    dropped(spark, pairs)

    own = stored(spark, _apart_rows(shared, found, least), "apart")
    dropped(spark, shared)
    drawn = None
    if sketches is not None:
        drawn = stored(spark, sketches(own.select("id").distinct()), "sketches")
    width, turn = WIDTH, 0
    while True:
        most = own.agg(F.max("m")).first()[0] or 0
        if turn and not most:
            break
        pairs = _meeting(own, width, turn, near, needed, drawn, differing, alike)
        found = _verified_more(spark, found, pairs, verify)
        if most <= width:
            break
        # All pairs of an id without a longer key have met.
        longer = own.where(F.col("m") > width).select("id").distinct()
        rest = own.drop("component", "m").join(longer, "id", "left_semi")
        last, own = own, stored(spark, _apart_rows(rest, found, least), "apart")
        dropped(spark, last)
        width, turn = width * WIDER, turn + 1
    dropped(spark, own)
    if drawn is not None:
        dropped(spark, drawn)
    return found


def _meeting(
    own: DataFrame,
    width: int,
    turn: int,
    near: Callable[[Column, Column], Column],
    needed: Callable[[Column, Column], Column],
    drawn: DataFrame | None,
    differing: Callable[[Column, Column], Column] | None,
    alike: Callable[[str, str], Column] | None,
) -> DataFrame:
    """``a, b``: ids of different components that share keys enough within blocks of a key.

    A key of no more than ``width`` rows is one block.
    """
    bits = F.ceil(F.log2(F.col("m") / width)).cast("int")
    block = F.xxhash64(F.col("id"), F.lit(turn)).bitwiseAND(F.expr("shiftleft(1L, _bits) - 1"))
    own = own.withColumn("_bits", F.greatest(bits, F.lit(0))).withColumn("block", block)
    own = own.select("key", "block", "id", "component", "value")
    names = ["component", "value"]
    if drawn is not None:
        own = own.join(drawn, "id")
        names += [c for c in drawn.columns if c != "id"]
    left, right = (
        own.select(
            "key",
            "block",
            F.col("id").alias(x),
            *[F.col(c).alias(f"{c}_{x}") for c in names],
        )
        for x in "ab"
    )
    met = (F.col("component_a") < F.col("component_b")) & near(F.col("value_a"), F.col("value_b"))
    if differing is not None:
        cells = [F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in SKETCH_COLUMNS]
        met = met & (functools.reduce(operator.add, cells) <= differing(F.col("value_a"), F.col("value_b")))
    if alike is not None:
        met = F.when(met, alike("_a", "_b")).otherwise(False)
    meeting = left.join(right, ["key", "block"]).where(met)
    bound = needed(F.col("value_a"), F.col("value_b"))
    meeting = meeting.groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min(bound).alias("bound")
    )
    return meeting.where("n >= bound").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    )


def _joined(spark: SparkSession, found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with those of more (stored) links; these go then."""
    more = components(spark, _apart(links, found, labels=True))
    moved = more.select(F.col("id").alias("component"), F.col("component").alias("_to"))
    moved = found.join(moved, "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
    out = stored(spark, moved.unionByName(more), "found")
    dropped(spark, links)
    return out


def _verified_more(
    spark: SparkSession,
    found: DataFrame,
    pairs: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    pairs = stored(spark, pairs, "pairs")
    if not pairs.isEmpty():
        found = _joined(spark, found, verify(pairs))
    dropped(spark, pairs)
    return found
