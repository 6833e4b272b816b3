"""Aggregations over families of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusframe.operators.merge import label
from locusframe.operators.query import where
from locusframe.operators.relate import family


def children_bp(features: DataFrame, relations: DataFrame, child_type: str = "exon", parent_type=None, merge: bool = False, level: int | None = None, criteria: tuple[str, ...] = ("seqid", "overlap_end_inclusive", "strand", "feature_type"), slack: int = 0) -> DataFrame:
    """(parent_id, bp): bases of each parent's children.  With ``merge`` children that are
    one under ``criteria`` (see :func:`merge.merged`) count once; leave out ``strand`` to
    merge across strands."""
    kids = family(features, relations, level, parent_type, child_type)
    if merge:
        kids, keys = label(kids, criteria, slack, ("parent_id",))
        kids = kids.groupBy("parent_id", *keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return kids.groupBy("parent_id").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bp"))


def strand_vote(features: DataFrame, relations: DataFrame, child_type: str = "exon", parent_type=None) -> DataFrame:
    """(parent_id, strand): the most common strand of the children, ties to the smaller."""
    kids = family(features, relations, None, parent_type, child_type, ["id", "strand"])
    n = kids.groupBy("parent_id", "strand").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("parent_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "strand")).alias("b")).select("parent_id", F.col("b.strand").alias("strand"))


def extent_check(features: DataFrame, relations: DataFrame, child_type: str = "exon", parent_type: str = "gene") -> DataFrame:
    """(parent_id, ...) of parents whose bounds are not those of their children."""
    kids = family(features, relations, None, parent_type, child_type, ["id", "start", "end"])
    ext = kids.groupBy("parent_id").agg(F.min("start").alias("child_start"), F.max("end").alias("child_end"))
    heads = where(features, parent_type).select(F.col("id").alias("parent_id"), "start", "end")
    return heads.join(ext, "parent_id").filter("start <> child_start or end <> child_end")


def canonical_children(features: DataFrame, relations: DataFrame, top: str = "gene", part: str = "exon", coding: str = "CDS") -> DataFrame:
    """(top_id, child_id, coding_bp, bp): of each top feature the child with the longest
    coding part, of equals or without any the longest one, then the smaller id."""
    mids = family(features, relations, 1, top, None, ["id"]).select(F.col("parent_id").alias("top_id"), F.col("id").alias("child_id"))
    kids = family(features, relations, 1, None, [part, coding], ["id", "start", "end", "featuretype"]).withColumnRenamed("parent_id", "child_id")
    n = F.col("end") - F.col("start") + 1
    size = kids.groupBy("child_id").agg(F.sum(F.when(F.col("featuretype") == coding, n).otherwise(0)).alias("coding_bp"), F.sum(F.when(F.col("featuretype") == part, n).otherwise(0)).alias("bp"))
    all_ = mids.join(size, "child_id", "left").select("top_id", "child_id", F.coalesce("coding_bp", F.lit(0)).alias("coding_bp"), F.coalesce("bp", F.lit(0)).alias("bp"))
    rank = F.row_number().over(Window.partitionBy("top_id").orderBy(F.desc("coding_bp"), F.desc("bp"), "child_id"))
    return all_.withColumn("_r", rank).filter("_r = 1").drop("_r")


def canonical_sequences(features: DataFrame, relations: DataFrame, fasta: DataFrame, top: str = "gene", part: str = "exon") -> DataFrame:
    """(top_id, child_id, sequence): the parts of each canonical child joined in the
    direction of its strand."""
    from locusframe.operators.derive import sequences

    best = canonical_children(features, relations, top, part).select("top_id", "child_id")
    parts = family(features, relations, 1, None, part, ["id", "seqid", "start", "end", "strand"]).withColumnRenamed("parent_id", "child_id").join(best, "child_id")
    at = F.when(F.col("strand") == "-", -F.col("start")).otherwise(F.col("start"))
    return sequences(parts, fasta).groupBy("top_id", "child_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at.alias("at"), "sequence"))), lambda x: x.sequence), "").alias("sequence"))
