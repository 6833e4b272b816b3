"""Overlapping and gapped intervals.

Intervals become sessions: ``session_window`` with a duration of its own for every row
merges what overlaps.  Three things keep one entity from landing in one task:

1. rows with the same start are reduced to their greatest end (map-side combine);
2. sessions are merged per (entity, tile of the axis).  After step 1 a tile holds at
   most ``tile`` rows, however many rows the entity has;
3. what reaches over tile borders is settled on one small row per tile
   (at most axis length / ``tile`` of them per entity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.session import cut

#: Positions of one tile: bounds the rows of one (entity, tile) group after step 1.
TILE = 1 << 17


def _at(c: Column) -> Column:
    """A position as a point of time, one microsecond per position."""
    return F.timestamp_micros(c)


def merged_spans(df: DataFrame, entity: str, start: str, end: str, tile: int = TILE) -> DataFrame:
    """(entity, span_start, span_end, next_start): the longest stretches without a hole.

    Both ends are included; stretches that touch are one.  ``next_start`` is the start
    of the entity's next stretch or null.  Rows with a null entity, start or end, or
    with start > end are left out.  Repeated rows change nothing; an empty input gives
    an empty result.
    """
    rows = df.select(F.col(entity).alias("entity"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    rows = rows.filter(F.col("entity").isNotNull() & (F.col("s") <= F.col("e")))
    rows = rows.groupBy("entity", "s").agg(F.max("e").alias("e"))
    # [s, e + 1) as a session; the session of a row ends when its own stretch ends
    length = F.make_interval(secs=((F.col("e") - F.col("s") + 1) / F.lit(1_000_000)).cast("decimal(18,6)"))
    keyed = rows.select("entity", F.floor(F.col("s") / tile).alias("tile"), _at(F.col("s")).alias("at"), length.alias("long"))
    local = keyed.groupBy("entity", "tile", F.session_window("at", F.col("long")).alias("w")).agg(F.lit(1).alias("_one"))
    local = local.select("entity", "tile", F.unix_micros("w.start").alias("s"), (F.unix_micros("w.end") - 1).alias("e"))
    # sessions that only touch ([1, 5) and [5, 9)) are one stretch too
    in_tile = Window.partitionBy("entity", "tile").orderBy("s")
    first = F.lag("e").over(in_tile)
    local = local.withColumn("_new", F.when(first.isNull() | (F.col("s") > first + 1), 1).otherwise(0))
    local = local.withColumn("_run", F.sum("_new").over(in_tile.rowsBetween(Window.unboundedPreceding, 0)))
    local = local.groupBy("entity", "tile", "_run").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_run")
    local = cut(local, "spans")
    # how far earlier tiles reach into a tile
    reach = local.groupBy("entity", "tile").agg(F.max("e").alias("far"))
    by_entity = Window.partitionBy("entity").orderBy("tile")
    reach = reach.select("entity", "tile", F.max("far").over(by_entity.rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    local = local.join(reach, ["entity", "tile"])
    head = F.col("carry").isNull() | (F.col("s") > F.col("carry") + 1)
    local = local.withColumn("_head", head)
    # within a tile the stretches that continue an earlier tile come before all heads
    tiles = local.groupBy("entity", "tile").agg(
        F.max(F.when(~F.col("_head"), F.col("e"))).alias("tail"),
        F.min(F.when(F.col("_head"), F.col("s"))).alias("first_head"),
    )
    ahead = by_entity.rowsBetween(1, Window.unboundedFollowing)
    opens = F.count("first_head").over(by_entity.rowsBetween(Window.unboundedPreceding, 0))
    # a tile's tail belongs to the last tile before it that has a head
    tiles = tiles.withColumn("_next", F.first("first_head", ignorenulls=True).over(ahead)).withColumn("_open", opens)
    tiles = tiles.withColumn("_owner", F.col("_open") - F.when(F.col("first_head").isNotNull(), 1).otherwise(0))
    tails = tiles.groupBy("entity", F.col("_owner").alias("_open")).agg(F.max("tail").alias("_tail"))
    lasts = tiles.filter(F.col("first_head").isNotNull()).select("entity", "tile", "_next", "_open").join(tails, ["entity", "_open"], "left")
    heads = local.filter("_head").withColumn("_after", F.lead("s").over(in_tile)).join(lasts, ["entity", "tile"])
    last = F.col("_after").isNull()
    return heads.select(
        F.col("entity").alias(entity),
        F.col("s").alias("span_start"),
        F.when(last, F.greatest("e", F.coalesce("_tail", "e"))).otherwise(F.col("e")).alias("span_end"),
        F.coalesce("_after", "_next").alias("next_start"),
    )


def spans_and_gaps(df: DataFrame, entity: str, start: str, end: str, longest_gap: int | None = None, tile: int = TILE) -> DataFrame:
    """(entity, kind, span_start, span_end): `merged` stretches and the `gap` between
    neighbours, the latter only up to ``longest_gap`` positions long."""
    spans = merged_spans(df, entity, start, end, tile)
    gap = F.struct(F.lit("gap").alias("kind"), (F.col("span_end") + 1).alias("a"), (F.col("next_start") - 1).alias("b"))
    both = F.array(F.struct(F.lit("merged").alias("kind"), F.col("span_start").alias("a"), F.col("span_end").alias("b")), gap)
    out = spans.select(entity, F.explode(both).alias("x"))
    keep = F.col("x.b").isNotNull()
    if longest_gap is not None:
        keep &= (F.col("x.kind") == "merged") | (F.col("x.b") - F.col("x.a") + 1 <= longest_gap)
    return out.filter(keep).select(entity, F.col("x.kind").alias("kind"), F.col("x.a").alias("span_start"), F.col("x.b").alias("span_end"))
