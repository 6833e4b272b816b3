"""Features derived from neighbours: gaps, introns, splice sites and start sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.attributes import MAP, first_value, merge_attributes
from locusframe.functions.bins import bin_of
from locusframe.operators.query import where
from locusframe.operators.relate import family

SOURCE = "derived"


def interfeatures(
    df: DataFrame,
    group: list[str],
    order: list[str],
    featuretype: str | None = None,
    merge: bool = True,
    numeric_sort: bool = False,
    update_attributes: dict[str, list[str]] | None = None,
    attribute_func=None,
    source: str = SOURCE,
) -> DataFrame:
    """The gap between each row and the next of its group, in ``order``, on one seqid.

    The gap is [end + 1, next start - 1] and is left out where that is empty.  The type is
    ``inter_<a>_<b>`` unless given, the strand stays where both agree and is ``.`` else;
    score, frame and id are those of the first row of the run on the seqid; attributes are
    the merged ones of the pair (none without ``merge``), with several values of ``ID``
    joined by ``-`` and ``update_attributes`` put over them.  ``attribute_func`` maps
    each side's attributes before merging.  Where one group may hold very many rows, put
    the seqid and a locus into ``group``.
    """
    w = Window.partitionBy(*group).orderBy(*order)
    rows = df.withColumn("_prev", F.lag(F.struct("seqid", "featuretype", "start", "end", "strand", "attributes")).over(w))
    new_run = F.when(F.col("_prev").isNull() | (F.col("_prev.seqid") != F.col("seqid")), 1).otherwise(0)
    rows = rows.withColumn("_run", F.sum(new_run).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.first(F.struct("id", "score", "frame")).over(Window.partitionBy(*group, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_first", first).filter((F.col("_prev.seqid") == F.col("seqid")) & (F.col("start") - F.col("_prev.end") > 1))
    a, b = F.col("_prev.attributes"), F.col("attributes")
    if attribute_func is not None:
        a, b = attribute_func(a), attribute_func(b)
    attrs = merge_attributes(a, b, numeric_sort) if merge else F.create_map().cast(MAP)
    if merge:
        attrs = F.transform_values(attrs, lambda k, v: F.when(k == "ID", F.array(F.array_join(v, "-"))).otherwise(v))
    if update_attributes:
        new = F.map_from_arrays(F.array(*[F.lit(k) for k in update_attributes]), F.array(*[F.array(*[F.lit(x) for x in v]) for v in update_attributes.values()]))
        attrs = F.map_concat(F.map_filter(attrs, lambda k, v: ~k.isin(*update_attributes)), new)
    start, end = F.col("_prev.end") + 1, F.col("start") - 1
    kind = F.lit(featuretype) if featuretype else F.concat(F.lit("inter_"), F.col("_prev.featuretype"), F.lit("_"), F.col("featuretype"))
    strand = F.when(F.col("_prev.strand") == F.col("strand"), F.col("strand")).otherwise(F.lit("."))
    keep = [g for g in group if g not in ("seqid",)]
    return rows.select(
        *keep, F.col("_first.id").alias("id"), "seqid", F.lit(source).alias("source"), kind.alias("featuretype"), start.alias("start"), end.alias("end"),
        F.col("_first.score").alias("score"), strand.alias("strand"), F.col("_first.frame").alias("frame"), attrs.alias("attributes"),
        F.array().cast("array<string>").alias("extra"), bin_of(start, end).alias("bin"),
    )


def introns(features: DataFrame, relations: DataFrame, exon: str = "exon", grandparent: str | None = "gene", parent: str | None = None, featuretype: str = "intron", merge: bool = True, numeric_sort: bool = False) -> DataFrame:
    """Gaps between the exons of each transcript, with ``transcript_id``.

    Transcripts are the level-1 children of ``grandparent`` features, or the ``parent``
    features; exactly one of the two must be given.
    """
    if (grandparent is None) == (parent is None):
        raise ValueError("give exactly one of grandparent and parent")
    if parent is None:
        middle = family(features, relations, 1, grandparent, None, ["id", "strand"]).select(F.col("id").alias("transcript_id"), F.col("strand").alias("transcript_strand")).distinct()
    else:
        middle = where(features, parent).select(F.col("id").alias("transcript_id"), F.col("strand").alias("transcript_strand"))
    exons = family(features, relations, 1, None, exon).withColumnRenamed("parent_id", "transcript_id").join(middle, "transcript_id")
    return interfeatures(exons, ["transcript_id", "transcript_strand"], ["start", "end", "id"], featuretype, merge, numeric_sort)


def splice_sites(features: DataFrame, relations: DataFrame, exon: str = "exon", grandparent: str | None = "gene", parent: str | None = None, merge: bool = True, numeric_sort: bool = False) -> DataFrame:
    """The two bases at each end of every intron: ``five_prime_cis_splice_site`` where the
    transcript begins, ``three_prime_cis_splice_site`` where it goes on, ``splice_site``
    without a strand.  The ``ID`` gets the type as prefix."""
    gaps = introns(features, relations, exon, grandparent, parent, "splice_site", merge, numeric_sort)
    left = F.struct(F.lit("left").alias("side"), F.col("start").alias("s"), (F.col("start") + 1).alias("e"))
    right = F.struct(F.lit("right").alias("side"), (F.col("end") - 1).alias("s"), F.col("end").alias("e"))
    rows = gaps.withColumn("_x", F.explode(F.array(left, right)))
    five = (F.col("transcript_strand") == "+") == (F.col("_x.side") == "left")
    kind = F.when(~F.col("transcript_strand").isin("+", "-"), "splice_site").when(five, "five_prime_cis_splice_site").otherwise("three_prime_cis_splice_site")
    rows = rows.withColumn("featuretype", kind).withColumn("start", F.col("_x.s")).withColumn("end", F.col("_x.e")).withColumn("bin", bin_of(F.col("_x.s"), F.col("_x.e")))
    named = F.transform_values("attributes", lambda k, v: F.when(k == "ID", F.transform(v, lambda x: F.concat(F.col("featuretype"), F.lit("_"), x))).otherwise(v))
    return rows.withColumn("attributes", named).withColumn("side", F.col("_x.side")).drop("_x")


def start_sites(features: DataFrame, relations: DataFrame, gene: str = "gene", name: str = "ID", distance: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """The first base of every level-1 child of a gene: (seqid, start, end, name, strand,
    featuretype).  With ``distance`` sites of one strand at most that far apart are one,
    with their different names joined by commas."""
    tx = family(features, relations, 1, gene, None, ["id", "seqid", "start", "end", "strand", "featuretype", "attributes"])
    at = F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start"))
    label = F.coalesce(first_value(F.col("attributes"), name), F.col("id"))
    sites = tx.select("id", "seqid", at.alias("start"), at.alias("end"), label.alias("name"), "strand", F.concat("featuretype", F.lit("_TSS")).alias("featuretype")).distinct()
    if distance is None:
        return sites
    from locusframe.operators.merge import islands

    lab = islands(sites, ["seqid", "strand"], slack=distance - 1)
    return lab.groupBy("seqid", "strand", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("name"), F.count(F.lit(1)).alias("n")).drop("island")


def flank(df: DataFrame, upstream: Column | int = 0, downstream: Column | int = 0) -> DataFrame:
    """Widen features along their strand; starts stay at 1 or above."""
    up, down = (x if isinstance(x, Column) else F.lit(x) for x in (upstream, downstream))
    minus = F.col("strand") == "-"
    return df.withColumns({"start": F.greatest(F.lit(1), F.col("start") - F.when(minus, down).otherwise(up)), "end": F.col("end") + F.when(minus, up).otherwise(down)})


def sequences(df: DataFrame, fasta: DataFrame, use_strand: bool = True) -> DataFrame:
    """Each feature's bases; the reverse complement on ``-`` with ``use_strand``."""
    from locusframe.functions.attributes import reverse_complement

    rows = df.join(fasta.select("seqid", "seq"), "seqid")
    cut = F.col("seq").substr(F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    return rows.withColumn("sequence", F.when(F.lit(use_strand) & (F.col("strand") == "-"), reverse_complement(cut)).otherwise(cut)).drop("seq")
