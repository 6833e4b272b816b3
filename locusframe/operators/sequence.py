"""Numbering rows without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def number_rows(df: DataFrame, by: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Append ``name``: 1, 2, ... within ``by`` in the order of the unique bigint ``order``.

    Counts per (by, block of ``order``) give each block's offset, a row number within
    the block the rest: a window holds at most ``block`` rows, or one row per block.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    counts = rows.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*by, "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(order))
    rows = rows.withColumn("_row", row)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, "_block"]]
    cond = same[0]
    for x in same[1:]:
        cond &= x
    out = rows.alias("a").join(offsets.alias("b"), cond).select("a.*", (F.col("a._row") + F.col("b._before")).alias(name))
    return out.drop("_block", "_row")
