"""Hierarchy navigation and interval joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.query import order, where
from locusframe.operators.skew import salted_join
from locusframe.session import cut, discard, new_table_path


#: Width of the finest tiles of an overlap join, as a power of two.
FINEST = 17
#: Overlap totals on a long axis: about so many tiles of one seqid, and their greatest width, as powers of two.
MOST_TILES, WIDEST = 16, 30
#: Points of overlap totals that are broadcast, at most (for 248,202 points 31 MB at each end); more are joined by a salted shuffle.
FEW_POINTS = 1 << 19


def _ids(ids) -> list[str]:
    return [ids] if isinstance(ids, str) else list(ids)


def children(features: DataFrame, relations: DataFrame, ids: str | list[str], level: int | None = None, order_by=None, reverse: bool = False, **filters) -> DataFrame:
    """Features below ``ids`` at ``level`` (any level where None); each once."""
    edges = relations.filter(F.col("parent").isin(_ids(ids)))
    edges = edges if level is None else edges.filter(F.col("level") == level)
    return order(where(features.join(edges.select(F.col("child").alias("id")), "id", "left_semi"), **filters), order_by, reverse)


def parents(features: DataFrame, relations: DataFrame, ids: str | list[str], level: int | None = None, order_by=None, reverse: bool = False, **filters) -> DataFrame:
    """Features above ``ids``; the mirror of :func:`children`."""
    edges = relations.filter(F.col("child").isin(_ids(ids)))
    edges = edges if level is None else edges.filter(F.col("level") == level)
    return order(where(features.join(edges.select(F.col("parent").alias("id")), "id", "left_semi"), **filters), order_by, reverse)


def family(features: DataFrame, relations: DataFrame, level: int | None = None, parent_type=None, child_type=None, columns: list[str] | None = None) -> DataFrame:
    """All parent-child pairs at once: ``parent_id`` and the child's columns; what a loop
    of ``children`` calls would give, in one join."""
    edges = relations if level is None else relations.filter(F.col("level") == level)
    edges = edges.select(F.col("parent").alias("parent_id"), F.col("child").alias("id")).distinct()
    kids = where(features, child_type)
    out = edges.join(kids.select(*(columns or kids.columns)), "id")
    if parent_type is not None:
        out = out.join(where(features, parent_type).select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return out


def units(features: DataFrame, relations: DataFrame, featuretype: str = "gene") -> DataFrame:
    """(unit_id, id): every feature of a type with all that is below it, itself included."""
    heads = where(features, featuretype).select(F.col("id").alias("unit_id"))
    below = relations.select(F.col("parent").alias("unit_id"), F.col("child").alias("id"))
    below = below.join(heads, "unit_id", "left_semi").join(features.select("id"), "id", "left_semi").select("unit_id", "id")
    return heads.select("unit_id", F.col("unit_id").alias("id")).union(below).distinct()


def grandchild_edges(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(parent, child, level 2) from level-1 edges; ``known`` ids only may be parents."""
    first = edges.select(F.col("parent").alias("g"), F.col("child").alias("m"))
    second = edges.select(F.col("parent").alias("m"), F.col("child").alias("c"))
    if known is not None:
        first = first.join(known.select(F.col("id").alias("g")), "g", "left_semi")
    return first.join(second, "m").select(F.col("g").alias("parent"), F.col("c").alias("child"), F.lit(2).alias("level")).distinct()


def closure(edges: DataFrame, depth: int = 2, known: DataFrame | None = None) -> DataFrame:
    """Edges of levels 1 to ``depth``; a pair may occur at several levels."""
    one = edges.select("parent", "child").distinct()
    out, step = one.withColumn("level", F.lit(1)), one
    for level in range(2, depth + 1):
        below = one.select(F.col("parent").alias("child"), F.col("child").alias("c"))
        step = step.join(below, "child").select("parent", F.col("c").alias("child")).distinct()
        if known is not None:
            step = step.join(known.select(F.col("id").alias("parent")), "parent", "left_semi")
        out = out.union(step.withColumn("level", F.lit(level)))
    return out


def constitutive(features: DataFrame, relations: DataFrame, top: str = "gene", middle: str = "mRNA", part: str = "exon") -> DataFrame:
    """(top_id, part_id) of parts that all middle features of their top share."""
    mids = family(features, relations, 1, top, middle, ["id"]).select(F.col("parent_id").alias("top_id"), F.col("id").alias("mid_id"))
    parts = family(features, relations, 1, middle, part, ["id"]).select(F.col("parent_id").alias("mid_id"), F.col("id").alias("part_id"))
    total = mids.groupBy("top_id").agg(F.count_distinct("mid_id").alias("n"))
    held = mids.join(parts, "mid_id").groupBy("top_id", "part_id").agg(F.count_distinct("mid_id").alias("k"))
    return held.join(total, "top_id").filter("k = n").select("top_id", "part_id")


def overlap_join(left: DataFrame, right: DataFrame, within: bool = False, same_strand: bool = False, left_id: str = "id", right_id: str = "id") -> DataFrame:
    """(left_id, right_id, start, end) of pairs on one seqid that overlap, with the shared
    stretch; ``within``: the right one lies inside the left one.

    The axis is cut into tiles, on several levels of widths; a right row is on the level
    whose tiles are at least as wide as it is long, hence in one or two tiles, and a left
    row looks into the tiles it meets on every level in use.  The join is on (seqid, level,
    tile), and a pair counts in the tile where its shared stretch begins, so that it comes out
    once.  Coordinates have no limit.  Rows that end before they start overlap nothing.
    """
    l_ = left.select(F.col(left_id).alias("left_id"), "seqid", F.col("start").cast("bigint").alias("ls"), F.col("end").cast("bigint").alias("le"), F.col("strand").alias("lt"))
    r_ = right.select(F.col(right_id).alias("right_id"), "seqid", F.col("start").cast("bigint").alias("rs"), F.col("end").cast("bigint").alias("re"), F.col("strand").alias("rt"))
    l_, r_ = l_.filter("ls <= le"), r_.filter("rs <= re")
    bound = r_.agg(F.min("rs"), F.max("re"), F.max(F.col("re") - F.col("rs") + 1)).first()
    low, far, longest = (x or 0 for x in bound)
    levels = [FINEST]
    while longest > 1 << levels[-1]:
        levels.append(levels[-1] + 3)
    tiles = lambda s, e, k: F.transform(F.sequence(F.shiftright(s, k), F.shiftright(e, k)), lambda t: F.struct(F.lit(k).alias("level"), t.alias("tile")))
    inside = lambda c: F.greatest(F.lit(low), F.least(F.col(c), F.lit(far))).cast("bigint")
    l_ = l_.filter((F.col("le") >= low) & (F.col("ls") <= far)).withColumn("_t", F.explode(F.concat(*[tiles(inside("ls"), inside("le"), k) for k in levels])))
    fits = F.col("re") - F.col("rs") + 1
    own = F.coalesce(*[F.when(fits <= 1 << k, tiles(F.col("rs"), F.col("re"), k)) for k in levels])
    r_ = r_.withColumn("_t", F.explode(own))
    cond = (F.col("rs") >= F.col("ls")) & (F.col("re") <= F.col("le")) if within else (F.col("rs") <= F.col("le")) & (F.col("re") >= F.col("ls"))
    if same_strand:
        cond &= F.col("lt") == F.col("rt")
    starts = F.coalesce(*[F.when(F.col("level") == k, F.shiftright(F.greatest("ls", "rs"), k)) for k in levels])
    l_, r_ = (x.select("*", "_t.level", "_t.tile").drop("_t") for x in (l_, r_))
    return l_.join(r_, ["seqid", "level", "tile"]).filter(cond & (starts == F.col("tile"))).select("left_id", "right_id", "seqid", F.greatest("ls", "rs").alias("start"), F.least("le", "re").alias("end"))


def overlap_totals(left: DataFrame, right: DataFrame, left_id: str = "id", tile: int = FINEST, few: int = FEW_POINTS) -> DataFrame:
    """(left_id, n, bp): how many rows of ``right`` a left row overlaps and the positions
    it shares with them, summed up; what the pairs of :func:`overlap_join` add up to by
    ``left_id``, without making them (where many rows lie over each other, pairs grow with
    the square of the rows).  Ids that overlap nothing are left out.

    A row meets the rows that start up to its end, less those that end before its start,
    and shares what they cover up to its end, less what they cover before its start.  So
    the running totals of :func:`_running` are looked up at two points per left row.
    """
    l_ = left.select(F.col(left_id).alias("left_id"), "seqid", (F.col("start").cast("bigint") - 1).alias("before"), F.col("end").cast("bigint").alias("upto"))
    r_ = right.select("seqid", F.col("start").cast("bigint").alias("rs"), F.col("end").cast("bigint").alias("re"))
    l_, r_ = l_.filter("seqid is not null and before < upto"), r_.filter("seqid is not null and rs <= re")
    kinds = ["opened", "closed", "ask_before", "ask_upto"]
    marks = lambda df, of: df.select("seqid", F.inline(F.array(*[F.struct(F.col(c).alias("pos"), *[F.lit(int(x == kind)).alias(x) for x in kinds]) for c, kind in of.items()])))
    points = marks(r_, {"rs": "opened", "re": "closed"}).unionByName(marks(l_, {"before": "ask_before", "upto": "ask_upto"}))
    path = new_table_path(left.sparkSession, "points")
    points = cut(points.groupBy("seqid", "pos").agg(*[F.sum(c).alias(c) for c in kinds]), path=path)
    totals = cut(_running(points, tile).filter("ask_before + ask_upto > 0"), "totals")
    discard(left.sparkSession, path)
    is_few = totals.count() <= few

    def looked_up(rows: DataFrame, c: str, other: str) -> DataFrame:
        at = totals.filter(F.col(f"ask_{c}") > 0).select("seqid", F.col("pos").alias(c), f"ask_{c}", F.col(other), F.col("covered").alias(f"covered_{c}"))
        if is_few:
            return rows.join(F.broadcast(at.drop(f"ask_{c}")), ["seqid", c])
        key = F.struct("seqid", c)
        return salted_join(rows.withColumn("_at", key), at.select(key.alias("_at"), f"ask_{c}", other, f"covered_{c}"), "_at", f"ask_{c}", spread=["left_id"]).drop("_at", f"ask_{c}")

    out = looked_up(looked_up(l_, "upto", "opened"), "before", "closed")
    out = out.select("left_id", (F.col("opened") - F.col("closed")).alias("n"), (F.col("covered_upto") - F.col("covered_before")).alias("bp"))
    return out.groupBy("left_id").agg(F.sum("n").alias("n"), F.sum("bp").alias("bp")).filter("n > 0")


def _running(points: DataFrame, tile: int) -> DataFrame:
    """``points`` (seqid, pos, opened, closed and others: a written table, a point once) with
    ``opened`` and ``closed`` summed up to each point and ``covered``, the positions that
    the rows opened cover up to it.  Windows run over the points of a tile and over one
    row per tile.  Sums are taken from the start of a tile, so that bigint holds them if it
    holds what the rows of a seqid cover, and 2^30 times the points of a tile."""
    low, far = (x or 0 for x in points.agg(F.min("pos"), F.max("pos")).first())
    k = max(tile, min(WIDEST, (far - low).bit_length() - MOST_TILES))
    rows = points.withColumn("tile", F.shiftright("pos", k)).withColumn("y", F.col("pos") - F.shiftleft("tile", k))
    parts = {"o": F.col("opened"), "c": F.col("closed"), "oy": F.col("opened") * F.col("y"), "cy": F.col("closed") * F.col("y")}
    tiles = rows.groupBy("seqid", "tile").agg(*[F.sum(v).alias(x) for x, v in parts.items()])
    by_seqid = Window.partitionBy("seqid").orderBy("tile")
    earlier = by_seqid.rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.withColumn("o0", F.coalesce(F.sum("o").over(earlier), F.lit(0))).withColumn("c0", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    # what is covered from the start of a tile to the start of the next one that has points
    wide = F.shiftleft(F.lead("tile").over(by_seqid) - F.col("tile"), k)
    tiles = tiles.withColumn("step", (F.col("o0") - F.col("c0") + F.col("o") - F.col("c")) * wide + F.col("c") - F.col("oy") + F.col("cy"))
    tiles = tiles.select("seqid", "tile", "o0", "c0", F.coalesce(F.sum("step").over(earlier), F.lit(0)).alias("v0"))
    up_to = Window.partitionBy("seqid", "tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *[F.sum(v).over(up_to).alias(x) for x, v in parts.items()]).join(tiles, ["seqid", "tile"])
    opened, closed = F.col("o0") + F.col("o"), F.col("c0") + F.col("c")
    covered = F.col("v0") + (opened - closed) * F.col("y") + opened - F.col("c0") - F.col("oy") + F.col("cy")
    return rows.select(*[c for c in points.columns if c not in ("opened", "closed")], opened.alias("opened"), closed.alias("closed"), covered.alias("covered"))
