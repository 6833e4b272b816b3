"""Writing GFF and GTF, BED6 and BED12."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.attributes import Dialect, first_value, format_attributes
from locusframe.operators.query import where
from locusframe.operators.relate import family


def gff_lines(df: DataFrame, dialect: Dialect, keep_order: bool = False, sort_values: bool = False) -> DataFrame:
    """``line``, with the other columns kept: nine columns and the extra ones by tabs."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    cols = [text(c) for c in ("seqid", "source", "featuretype", "start", "end", "score", "strand", "frame")]
    extra = F.coalesce(F.col("extra"), F.array().cast("array<string>"))
    return df.withColumn("line", F.concat_ws("\t", *cols, format_attributes(F.col("attributes"), dialect, keep_order, sort_values), extra))


def write_gff(df: DataFrame, path: str, dialect: Dialect, directives: list[str] = (), header: bool = True, order: list[str] = ("file_order",), single_file: bool = False) -> None:
    """A directory of text, or one local file (streamed by the driver, row by row)."""
    lines = gff_lines(df, dialect).orderBy(*order).select("line")
    head = [f"##{d}" for d in directives] + ([f"# written {datetime.now(UTC):%Y-%m-%d %H:%M:%S} by locusframe"] if header else [])
    if single_file:
        with open(path, "w", encoding="utf-8") as out:
            out.writelines(x + "\n" for x in head)
            out.writelines(r[0] + "\n" for r in lines.toLocalIterator())
        return
    if head:
        spark = df.sparkSession
        spark.createDataFrame([(x,) for x in head], "line string").coalesce(1).write.text(f"{path}/header")
    lines.write.text(f"{path}/body" if head else path)


def gene_records(features: DataFrame, relations: DataFrame, gene: str = "gene", middle: str = "mRNA", part: str = "exon") -> DataFrame:
    """All features of genes with ``sort_key``, in canonical order: the gene, its mRNAs by
    exon length descending, each with its exons by start and then its other parts, then the
    gene's other children.  A part of several mRNAs follows each of them."""
    genes = where(features, gene).withColumn("gene_id", F.col("id"))
    below = family(features, relations, 1, gene).withColumnRenamed("parent_id", "gene_id")
    mids = below.filter(F.col("featuretype") == middle)
    size = family(features, relations, 1, middle, part, ["id", "start", "end"]).groupBy(F.col("parent_id").alias("id")).agg(F.sum(F.col("end") - F.col("start") + 1).alias("bp"))
    mids = mids.join(size, "id", "left").withColumn("bp", F.coalesce("bp", F.lit(0)))
    parts = family(features, relations, 1, middle).join(mids.select(F.col("id").alias("parent_id"), "gene_id", "bp"), "parent_id")
    key = lambda *k: F.struct(*[c.cast("bigint").alias(f"k{i}") if i != 3 else c.cast("string").alias("k3") for i, c in enumerate(k)])
    none = F.lit(0)
    rows = [
        genes.withColumn("sort_key", key(none, none, none, F.lit(""), none, none)),
        mids.withColumn("sort_key", key(F.lit(1), -F.col("bp"), none, F.col("id"), none, none)).drop("bp"),
        parts.withColumn("sort_key", key(F.lit(1), -F.col("bp"), none, F.col("parent_id"), F.when(F.col("featuretype") == part, 1).otherwise(2), F.col("start"))).drop("bp", "parent_id"),
        below.filter(F.col("featuretype") != middle).withColumn("sort_key", key(F.lit(2), none, none, F.lit(""), none, F.col("start"))),
    ]
    cols = ["gene_id", "sort_key", *features.columns]
    out = rows[0].select(cols)
    for r in rows[1:]:
        out = out.unionByName(r.select(cols))
    return out


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: x.cast("string")), ",")


def bed12(features: DataFrame, relations: DataFrame, parent_type, block: str = "exon", thick: str | None = "CDS", thin: str | None = None, name: str = "ID", color: str | None = None, on_misfit: str = "raise") -> DataFrame:
    """(id, line): BED12 of each parent with its blocks.

    Give ``thick`` or ``thin``, not both; without thick parts thickStart is the start as
    it is.  Parents whose first or last block is not at their bounds raise an error; with
    ``on_misfit="null"`` their line is null.
    """
    if thick and thin:
        raise ValueError("give thick or thin, not both")
    heads = where(features, parent_type)
    kids = family(features, relations, None, parent_type, None, ["id", "start", "end", "featuretype"]).select("parent_id", "start", "end", "featuretype")
    is_block, is_thick, is_thin = (F.col("featuretype") == (t or "") for t in (block, thick, thin))
    pack = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.struct("start", "end"))))
    grouped = kids.groupBy(F.col("parent_id").alias("id")).agg(
        pack(is_block).alias("blocks"), F.min(F.when(is_thick, F.col("start"))).alias("ts"), F.max(F.when(is_thick, F.col("end"))).alias("te"),
        F.max(F.when(is_thin, F.col("end"))).alias("thin_end"), F.min(F.when(is_thin, F.col("start"))).alias("thin_start"), F.count(F.when(is_thin, 1)).alias("n_thin"), pack(is_thin).alias("thins"),
    )
    rows = heads.join(grouped, "id")
    b = F.col("blocks")
    fits = (F.get(b, F.lit(0)).start == F.col("start")) & (F.element_at(b, -1).end == F.col("end"))
    b = b if on_misfit == "null" else F.when(fits, b).otherwise(F.raise_error(F.concat(F.lit("blocks do not reach the bounds of "), F.col("id"))).cast("array<struct<start:bigint,end:bigint>>"))
    if thin:
        left = F.when(F.get("thins", F.lit(0)).start == F.col("start"), F.get("thins", F.lit(0)).end)
        right = F.when(F.element_at("thins", -1).end == F.col("end"), F.element_at("thins", -1).start)
        thick_start, thick_end = F.coalesce(left, F.col("start") - 1), F.coalesce(right - 1, F.col("end"))
    else:
        thick_start, thick_end = F.coalesce(F.col("ts") - 1, F.col("start")), F.coalesce("te", "end")
    score = F.when(F.col("score") == ".", "0").otherwise(F.col("score"))
    label = F.coalesce(first_value(F.col("attributes"), name), F.lit("."))
    rows = rows.withColumn("_b", b)
    fields = ["seqid", F.col("start") - 1, "end", label, score, "strand", thick_start, thick_end, F.lit(color or "0,0,0"), F.size("_b"), _joined(F.transform("_b", lambda x: x.end - x.start + 1)), _joined(F.transform("_b", lambda x: x.start - F.col("start")))]
    line = F.concat_ws("\t", *[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields])
    return rows.select("id", (F.when(fits, line) if on_misfit == "null" else line).alias("line"))


def bed6(df: DataFrame, name: Column | None = None) -> DataFrame:
    """(chrom, chrom_start, chrom_end, name, score, strand), 0-based and half-open."""
    return df.select(F.col("seqid").alias("chrom"), (F.col("start") - 1).alias("chrom_start"), F.col("end").alias("chrom_end"), (name if name is not None else F.col("id")).alias("name"), F.when(F.col("score") == ".", "0").otherwise(F.col("score")).alias("score"), "strand")


def seqfeature_rows(df: DataFrame) -> DataFrame:
    """0-based bounds, strand as 1, -1, 0 or null, and source, score, seqid and frame among
    the qualifiers: the form sequence toolkits take."""
    strand = F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1).when(F.col("strand") == ".", 0)
    own = F.create_map(*[x for c in ("source", "score", "seqid", "frame") for x in (F.lit(c), F.array(F.col(c)))])
    return df.select("id", F.col("featuretype").alias("type"), (F.col("start") - 1).alias("start"), "end", strand.alias("strand"), F.map_concat(F.map_filter("attributes", lambda k, v: ~k.isin("source", "score", "seqid", "frame")), own).alias("qualifiers"))
