"""Merging features under criteria: gaps and islands, or a fold where it must be one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.query import where
from locusframe.operators.sequence import number_rows
from locusframe.operators.spans import TILE
from locusframe.session import cut

# What a criterion asks of the accumulated (a) and the next feature (b).
EQUAL = {"seqid": ["seqid"], "strand": ["strand"], "feature_type": ["featuretype"], "exact_coordinates_only": ["start", "end"]}


#: Rows of one key up to which a plain window does.
SMALL_GROUP = 1_000_000


def islands(df: DataFrame, keys: list[str], slack: int = 0, tile: int = TILE, small: int = SMALL_GROUP) -> DataFrame:
    """Append ``island``: rows of one key belong together while each starts at most
    ``slack`` + 1 behind the furthest end so far, in start order.

    The island's value is its first start.  Rows without coordinates have none.  Where no
    key has more than ``small`` rows (they are counted), the furthest end runs over a key in
    one window.  Else rows of equal start are reduced to the furthest end, and it runs over
    tiles of the axis: within a tile by a window of at most ``tile`` rows, over the tiles of a
    key by one row each; no key is ever in one task.
    """
    rows = cut(df.filter(F.col("start").isNotNull() & F.col("end").isNotNull()), "island-rows")
    biggest = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if biggest is None or biggest <= small:
        whole = Window.partitionBy(*keys).orderBy("start", "end")
        far = F.max("end").over(whole.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("_head", F.when(far.isNull() | (F.col("start") > far + 1 + slack), F.col("start")))
        return rows.withColumn("island", F.max("_head").over(whole.rowsBetween(Window.unboundedPreceding, 0))).drop("_head")
    points = rows.groupBy(*keys, "start").agg(F.max("end").alias("end")).withColumn("_tile", F.floor(F.col("start") / tile))
    points = _carried(points, keys, F.max("end"), F.max("_far"), "_far")
    inside = Window.partitionBy(*keys, "_tile").orderBy("start")
    far = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    points = points.withColumn("_head", F.when(far.isNull() | (F.col("start") > far + 1 + slack), F.col("start"))).drop("_far")
    # an island is named by the start of its head: the last head at or before a row
    points = _carried(points, keys, F.max("_head"), F.max("_before"), "_before")
    island = F.coalesce(F.max("_head").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    points = points.select(*keys, "start", island.alias("island"))
    return rows.alias("a").join(points.alias("b"), _same("a", "b", [*keys, "start"])).select("a.*", "b.island")


def _carried(rows: DataFrame, keys: list[str], per_tile: Column, over_tiles: Column, name: str) -> DataFrame:
    """Append ``name``: what ``over_tiles`` makes of the tiles before a row's own."""
    tiles = rows.groupBy(*keys, "_tile").agg(per_tile.alias(name))
    before = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)  # one row per tile
    tiles = tiles.select(*keys, "_tile", over_tiles.over(before).alias(name))
    return rows.alias("a").join(tiles.alias("b"), _same("a", "b", [*keys, "_tile"])).select("a.*", f"b.{name}")


def _same(a: str, b: str, cols: list[str]):
    out = F.lit(True)
    for c in cols:
        out &= F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def merged(df: DataFrame, criteria: tuple[str, ...] = ("seqid", "overlap_end_inclusive", "strand", "feature_type"), slack: int = 0) -> tuple[DataFrame, DataFrame]:
    """(merged features, membership) under equality criteria and an overlap in start order.

    ``criteria``: any of seqid, strand, feature_type, and at most one of
    overlap_end_inclusive, overlap_any_inclusive, overlap_start_inclusive, their forms
    with ``_threshold``, or exact_coordinates_only; ``slack`` (a threshold less one) widens
    those at the end and at any side.  Membership is (island keys, island, id).
    A merged feature has the smallest start, the greatest end, ``.`` for strand and frame
    and ``sequence_feature`` for type where members differ, the seqids in order and the
    sources sorted, both joined by commas, and the score of the first member.
    """
    labelled, keys = label(df, criteria, slack)
    return summarise(labelled, [*keys, "island"]), labelled.select(*keys, "island", "id")


def label(df: DataFrame, criteria: tuple[str, ...], slack: int = 0, within: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(rows with ``island``, keys): the islands of ``criteria``; ``within`` names further
    columns in which members agree."""
    names = [*within, *(c for name in criteria if name in EQUAL and name != "exact_coordinates_only" for c in EQUAL[name])]
    keys = [f"_k_{c}" for c in dict.fromkeys(names)]
    rows = df.withColumns({k: F.col(k[3:]) for k in keys}) if keys else df.withColumn("_k_all", F.lit(0))
    keys = keys or ["_k_all"]
    if "exact_coordinates_only" in criteria:
        return rows.withColumn("island", F.concat_ws("-", "start", "end")), keys
    if {"overlap_start_inclusive", "overlap_start_threshold"} & set(criteria):
        # in start order the next row never ends before the accumulated start, so that a
        # threshold at the start changes nothing
        return _start_islands(rows, keys), keys
    return islands(rows, keys, slack), keys


def _start_islands(rows: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """Islands where every next row must end within the accumulated one (by one base).
    The furthest end and the last head are carried from tile to tile of the axis."""
    rows = rows.withColumn("_tile", F.coalesce(F.floor(F.col("start") / tile), F.lit(-1)))
    rows = _carried(rows, keys, F.max("end"), F.max("_far"), "_far")
    inside = Window.partitionBy(*keys, "_tile").orderBy("start", "end", "id")
    far = F.greatest(F.max("end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_far"))
    rows = rows.withColumn("_head", F.when(far.isNull() | (F.col("end") > far), F.col("file_order"))).drop("_far")
    rows = _carried(rows, keys, F.max_by("_head", F.when(F.col("_head").isNotNull(), F.struct("start", "end", "id"))), F.last("_before", ignorenulls=True), "_before")
    island = F.coalesce(F.last("_head", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.col("_before"))
    return rows.withColumn("island", island).drop("_head", "_before", "_tile")


def summarise(rows: DataFrame, by: list[str]) -> DataFrame:
    same = lambda c, other: F.when(F.count_distinct(c) == 1, F.min(c)).otherwise(F.lit(other))
    first = F.min(F.struct("start", "end", "file_order", "score"))
    return rows.groupBy(*by).agg(
        F.array_join(F.array_sort(F.collect_set("seqid")), ",").alias("seqid"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("source"),
        same("featuretype", "sequence_feature").alias("featuretype"),
        F.min("start").alias("start"), F.max("end").alias("end"),
        first.alias("_first"), same("strand", ".").alias("strand"), same("frame", ".").alias("frame"),
        F.min("file_order").alias("file_order"), F.count(F.lit(1)).alias("n_members"),
    ).withColumn("score", F.col("_first.score")).drop("_first")


def merge_features(df: DataFrame, criteria=("seqid", "overlap_end_inclusive", "strand", "feature_type"), slack: int = 0) -> DataFrame:
    """Merged features only, with ids ``<featuretype>_<n>`` in file order."""
    out, _ = merged(df, criteria, slack)
    out = out.select("seqid", "source", "featuretype", "start", "end", "score", "strand", "frame", "file_order", "n_members")
    numbered = number_rows(out, ["featuretype"], "file_order", "_n")
    return numbered.withColumn("id", F.concat_ws("_", "featuretype", "_n")).drop("_n")


def merge_all(features: DataFrame, relations: DataFrame, criteria=("seqid", "overlap_end_inclusive", "strand", "feature_type"), slack: int = 0, exclude_components: bool = False, featuretypes_groups=(None,)) -> tuple[DataFrame, DataFrame]:
    """(features, relations) with the merged features of all islands of several members;
    the members are dropped, or become level-1 children of the merged one and name it as
    their ``Parent``.  Each of ``featuretypes_groups`` (a type, several, or None for all) is
    merged by itself, the later ones with what the earlier ones left."""
    edges = relations.select("parent", "child", "level")
    for n, group in enumerate(featuretypes_groups or (None,)):
        labelled, keys = label(where(features, group), criteria, slack)
        by = [*keys, "island"]
        heads = summarise(labelled, by).filter("n_members > 1")
        heads = number_rows(heads, ["featuretype"], "file_order", "_n").withColumn("new_id", F.concat_ws("_", F.lit("merged" if n == 0 else f"merged{n + 1}"), "featuretype", "_n"))
        a, b = labelled.select(*by, "id").alias("a"), heads.select(*by, "new_id").alias("b")
        members = cut(a.join(b, _same("a", "b", by)).select("b.new_id", "a.id"), "merged-members")
        new = heads.select(F.col("new_id").alias("id"), "seqid", "source", "featuretype", "start", "end", "score", "strand", "frame", "file_order")
        if exclude_components:
            gone = members.select("id")
            features = features.join(gone, "id", "left_anti")
            edges = edges.join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("id", "child"), "child", "left_anti").select("parent", "child", "level")
        else:
            edges = edges.union(members.select(F.col("new_id").alias("parent"), F.col("id").alias("child"), F.lit(1))).distinct()
            if "attributes" in features.columns:
                cols = features.columns
                own = features.join(members.groupBy("id").agg(F.min("new_id").alias("_parent")), "id", "left")
                named = F.map_concat(F.map_filter("attributes", lambda k, v: k != "Parent"), F.create_map(F.lit("Parent"), F.array("_parent")))
                features = own.withColumn("attributes", F.when(F.col("_parent").isNotNull(), named).otherwise(F.col("attributes"))).select(cols)
        features = features.unionByName(new, allowMissingColumns=True)
    return features, edges


def fold(df: DataFrame, criterion: Callable[[dict, dict, list[dict]], bool], group: list[str], order: list[str]) -> DataFrame:
    """Merge by a criterion of one's own, ``f(accumulated, next, members) -> bool``, called
    on rows in ``order`` within ``group``.  A fold is sequential, so a group is one task's
    work: choose groups (say seqid and locus) that stay small."""
    cols = [c for c in ("id", "seqid", "source", "featuretype", "start", "end", "strand") if c not in group]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        members: list[dict] = []
        acc: dict | None = None
        for row in pdf.sort_values(order).to_dict("records"):
            if acc is not None and criterion(acc, row, members):
                acc["start"], acc["end"] = min(acc["start"], row["start"]), max(acc["end"], row["end"])
                members.append(row)
            else:
                if acc is not None:
                    out.append(acc | {"n_members": len(members)})
                acc, members = dict(row), [row]
        if acc is not None:
            out.append(acc | {"n_members": len(members)})
        return pd.DataFrame(out)[[*group, *cols, "n_members"]]

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*group, *cols]) + ", n_members bigint"
    return df.select(*group, *cols).groupBy(*group).applyInPandas(run, schema)
