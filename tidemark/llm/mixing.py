"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

Time is a row of slots; a slot takes one block (``block_rows`` documents of one source).  A source of weight w releases
its i-th block (from 0) at slot floor(i / w) and must place it before slot ceil((i + 1) / w).  With weights that sum to 1
the earliest-deadline-first order over the released blocks meets every deadline, so before any slot t each source has
placed its fair share w * t to within less than one block.

Weights are multiples of 1 / ``slots``: the schedule repeats after ``slots`` slots, and only one period is simulated (a
fold over ``slots`` steps in one row).  Where that is too short to give every source a slot, the period is a multiple of
``slots``.  Every document then computes its own slot from its rank in its source.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import fresh

SLOTS = 1000
BLOCK_ROWS = 16
#: Rows that are ranked together at most, on average: a source is split by as many leading digits of the shuffle key as that takes.
RANKED = 1000


def shuffle_key(seed: str) -> Column:
    """A document's place among its source: the md5 of seed and doc_id, in hexadecimal."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def divided(shares: DataFrame, slots: int) -> DataFrame:
    """(source, share, i): each source's slots of a period, and its number among the sources.

    ``shares`` has source and units (a whole number above 0).  A source whose weight is below one slot gets one, the others
    share the rest by units with largest remainders (ties: by source; slots that the small ones took too many come off
    the largest source).  With too many sources for ``slots`` some shares are below 1 or null; see `enough`.
    """
    total = Window.partitionBy()
    few = shares.withColumn("tiny", F.col("units") * slots < F.sum("units").over(total))
    few = few.withColumn("free", (F.lit(slots) - F.count_if("tiny").over(total)).cast("long")).withColumn("sum", F.sum(F.when(~F.col("tiny"), F.col("units"))).over(total))
    few = few.withColumn("base", F.when(F.col("tiny"), F.lit(1)).otherwise(F.greatest(F.expr("(units * free) div sum"), F.lit(1))).cast("long"))
    few = few.withColumn("over", F.when(F.col("tiny"), F.lit(-1)).otherwise(F.expr("(units * free) % sum")).cast("long"))
    few = few.withColumn("left_over", F.lit(slots) - F.sum("base").over(total))
    by_rest = Window.orderBy(F.desc("over"), F.asc_nulls_first("source"))
    by_size = Window.orderBy(F.desc("base"), F.asc_nulls_first("source"))
    back = F.when((F.col("left_over") < 0) & (F.row_number().over(by_size) == 1), F.col("left_over")).otherwise(F.lit(0))
    few = few.withColumn("share", (F.col("base") + (F.row_number().over(by_rest) <= F.col("left_over")).cast("long") + back).cast("long"))
    return few.select("source", "share", F.row_number().over(Window.orderBy(F.asc_nulls_first("source"))).alias("i"))


def enough(shares: DataFrame, slots: int = SLOTS) -> int:
    """``slots``, or the multiple of it that gives each of the sources of ``shares`` a slot at least and leaves none over."""
    while True:
        found = divided(shares, slots).agg(F.count("*").alias("n"), F.min("share").alias("least"), F.sum("share").alias("sum")).first()
        if not found.n or (found.n <= slots and found.least >= 1 and found.sum == slots):
            return slots
        slots *= max(2, -(-2 * found.n // slots))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), f)[0]


def period(shares: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(source, share, ordinal, slot, release, deadline): one period of the schedule, ``slots`` rows, `enough` for ``shares``.

    Sources of equal share take turns in the order of their numbers, so the fold keeps one counter for each different share,
    and those are fewer than sqrt(2 * slots).
    """
    kinds = divided(shares, slots).groupBy("share").agg(F.array_sort(F.collect_list(F.struct("i", "source"))).alias("members"))
    one = kinds.agg(F.collect_list(F.struct("share", "members")).alias("s"))

    m = F.lit(slots).cast("long")
    none = F.array().cast("array<struct<source:string,share:bigint,ordinal:bigint>>")

    def step(state: Column, t: Column) -> Column:
        def due(x: Column, k: Column) -> Column:
            done, size = state["done"][k], F.size(x["members"])
            turn = F.floor(done / size)
            job = F.struct(F.ceil((turn + 1) * m / x["share"]).alias("deadline"), F.get(x["members"], (done % size).cast("int")).alias("member"), x["share"].alias("share"), turn.alias("ordinal"), k.alias("k"))
            return F.when(F.floor(turn * m / x["share"]) <= t, job)

        # null (not released) is passed over by array_min; equal deadlines go by the sources' numbers
        return _let(
            F.array_min(F.transform("s", due)),
            lambda job: F.struct(
                F.transform(state["done"], lambda d, k: d + (k == job["k"]).cast("long")).alias("done"),
                F.concat(state["picks"], F.array(F.struct(job["member"]["source"].alias("source"), job["share"].alias("share"), job["ordinal"].alias("ordinal")))).alias("picks"),
            ),
        )

    # in pieces, as each step copies the picks of its piece
    piece = math.isqrt(slots) + 1

    def stretch(state: Column, t: Column) -> Column:
        part = F.aggregate(F.sequence(t, F.least(t + (piece - 1), F.lit(slots - 1))), F.struct(state["done"].alias("done"), none.alias("picks")), step)
        return _let(part, lambda x: F.struct(x["done"].alias("done"), F.concat(state["picks"], x["picks"]).alias("picks")))

    start = F.struct(F.transform("s", lambda _: F.lit(0).cast("long")).alias("done"), none.alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1), F.lit(piece)), start, stretch, lambda state: state["picks"])
    rows = one.where(F.size("s") > 0).select(F.posexplode(picks).alias("slot", "x")).select("x.source", "x.share", "x.ordinal", F.col("slot").cast("long").alias("slot"))
    return rows.withColumn("release", F.expr(f"ordinal * {slots} div share")).withColumn("deadline", F.expr(f"((ordinal + 1) * {slots} + share - 1) div share"))


def mix(docs: DataFrame, weights: Mapping[str | None, int] | None = None, slots: int = SLOTS, block_rows: int = BLOCK_ROWS, seed: str = "mix", ranked: int = RANKED) -> DataFrame:
    """``docs`` (doc_id, source and any other columns) with share, block, place, release, deadline and slot.

    The mixed order is that of (slot, place): slot takes one block of a source, place is the document's number in its
    block.  share is the source's slots in a period of ``slots``, or of `enough` where there are many sources.  Without ``weights`` (units by source; sources that it
    doesn't name get one unit) a source's units are floor(1000 * sqrt(its rows)).  Within a source, documents come in the
    order of a keyed hash of doc_id, then by doc_id.

    No row is dropped: past the slot where a source runs out its slots stay empty, and the other sources go on at the
    same distance.  Up to the first such slot the deviation is less than one block.  A null source is a source; rows that
    agree in doc_id are ranked by a hash of the whole row.  An empty table gives an empty one.  Columns of ``docs`` that are
    called like the added ones are replaced.
    """
    added = ["share", "block", "place", "release", "deadline", "slot"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    key, cell, before, none, src, t_none, t_src, t_slots = fresh(docs, "key", "cell", "before", "none", "src", "t_none", "t_src", "t_slots")
    digits = max(1, math.ceil(math.log(max(docs.count() / ranked, 1), 16)))
    # a null source is told apart by a column of its own, so that joins are by plain equality
    keyed = docs.withColumn(key, shuffle_key(seed)).withColumn(cell, F.substring(key, 1, digits))
    keyed = keyed.withColumn(none, F.col("source").isNull()).withColumn(src, F.coalesce(F.col("source").cast("string"), F.lit("")))
    group = [none, src, cell]
    rows = keyed.groupBy(*group).agg(F.count("*").alias("rows"))
    along = Window.partitionBy(none, src).orderBy(cell)
    cells = rows.select(*group, (F.sum("rows").over(along) - F.col("rows")).alias(before))
    sizes = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("rows"))
    if weights is None:
        units = F.greatest(F.floor(F.sqrt(F.col("rows").cast("double")) * 1000), F.lit(1))
    else:
        named = docs.sparkSession.createDataFrame([(k, int(v)) for k, v in weights.items()], "name string, units long")
        sizes = sizes.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name")), "left")
        units = F.greatest(F.coalesce("units", F.lit(1)), F.lit(1))
    shares = sizes.select("source", units.cast("long").alias("units"))
    slots = enough(shares, slots)
    table = period(shares, slots)

    # the ranks within cells and the join of the cells need the same partitioning: one shuffle
    own = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    within = Window.partitionBy(*group).orderBy(F.asc(key), F.asc("doc_id"), F.xxhash64(*own))
    placed = keyed.withColumn(key, F.row_number().over(within) - 1).join(cells, group)
    placed = placed.withColumn(key, F.col(key) + F.col(before))
    placed = placed.withColumn("block", F.expr(f"`{key}` div {block_rows}")).withColumn("place", (F.col(key) % block_rows).cast("int"))
    # one period: ``slots`` numbers, by source
    table = table.groupBy(F.col("source").isNull().alias(t_none), F.coalesce("source", F.lit("")).alias(t_src), "share").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "slot"))), lambda x: x["slot"]).alias(t_slots)
    )
    placed = placed.join(F.broadcast(table), (F.col(none) == F.col(t_none)) & (F.col(src) == F.col(t_src)))
    turn, nth = F.expr(f"(block div share) * {slots}"), F.col("block") % F.col("share")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return placed.select(
        *names,
        "share",
        "block",
        "place",
        F.expr(f"block * {slots} div share").alias("release"),
        F.expr(f"((block + 1) * {slots} + share - 1) div share").alias("deadline"),
        (turn + F.get(t_slots, nth.cast("int"))).alias("slot"),
    )
