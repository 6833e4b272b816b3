"""Reading GFF3, GFF2 and GTF text, directives and FASTA."""

from __future__ import annotations

import os
import textwrap
import urllib.request
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.attributes import MAP, Dialect, choose_dialect, parse_attributes, split_attributes
from locusframe.functions.bins import bin_of
from locusframe.session import _filesystem, new_table_path

COLUMNS = ["seqid", "source", "featuretype", "start", "end", "score", "strand", "frame"]
FEATURE = ["id", *COLUMNS, "attributes", "extra", "bin", "file_order"]


@dataclass
class Annotation:
    """What a file holds: feature rows (without ids), directives and the dialect."""

    features: DataFrame
    directives: DataFrame
    dialect: Dialect


#: The columns of a feature that is given as a row.
ROW_TYPES = {c: "string" for c in ("seqid", "source", "featuretype", "score", "strand", "frame")} | {"start": "bigint", "end": "bigint", "file_order": "bigint", "attributes": MAP, "extra": "array<string>"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files, gzip included, in file order.

    Lines are numbered per input block and the blocks' counts summed up, so a file is read
    in as many tasks as it has blocks; several files follow each other by path.
    """
    lines = spark.read.text(os.path.expanduser(path)).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"))
    counts = lines.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("path", "block").rowsBetween(Window.unboundedPreceding, -1))  # one row per block
    counts = counts.select("path", "block", F.coalesce(before, F.lit(0)).alias("before"))
    row = F.row_number().over(Window.partitionBy("path", "block").orderBy("mid"))
    return lines.withColumn("row", row).join(counts, ["path", "block"]).select((F.col("row") + F.col("before")).alias("line_no"), "value")


def lines_of(spark: SparkSession, data: str, from_string: bool = False) -> DataFrame:
    """Numbered lines of a path, a URL or, with ``from_string``, of the text itself."""
    if from_string:
        rows = list(enumerate(textwrap.dedent(data).splitlines(), 1))
        return spark.createDataFrame(rows, "line_no bigint, value string")
    if data.startswith(("http://", "https://", "ftp://")):
        return numbered_lines(spark, fetch(spark, data))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(os.path.expanduser(data))
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not found:
        raise ValueError(f"no such file: {data!r}; for text itself use from_string=True")
    return numbered_lines(spark, data)


def fetch(spark: SparkSession, url: str, chunk: int = 1 << 20) -> str:
    """Copy a remote file into the shared folder, inflating gzip on the way; it goes when
    the driver ends."""
    inflate = zlib.decompressobj(zlib.MAX_WBITS | 16) if url.endswith(".gz") else None
    path = new_table_path(spark, "fetched") + ".gff"
    fs, at = _filesystem(spark, path)
    out = fs.create(at, True)
    try:
        with urllib.request.urlopen(url) as r:
            while block := r.read(chunk):
                out.write(bytearray(inflate.decompress(block) if inflate else block))
    finally:
        out.close()
    return path


def split_sections(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(data lines, directives), both before any FASTA section: it begins with ``##FASTA``
    or a line that starts with ``>``.  Comments and blank lines are dropped."""
    fasta = lines.filter(F.startswith("value", F.lit("##FASTA")) | F.startswith("value", F.lit(">"))).agg(F.min("line_no").alias("_cut"))
    body = lines.crossJoin(fasta).filter(F.col("_cut").isNull() | (F.col("line_no") < F.col("_cut"))).drop("_cut")  # one row
    directives = body.filter(F.startswith("value", F.lit("##"))).select("line_no", F.substring("value", 3, 1 << 30).alias("directive"))
    data = body.filter(~F.startswith("value", F.lit("#")) & F.col("value").rlike(r"\S"))
    return data, directives


def raw_features(data: DataFrame, strict: bool = True) -> DataFrame:
    """The columns of each line; strict lines are parted by tabs, else by white space with
    at most nine columns.  Missing columns read ``.``; columns past the ninth are extra."""
    value = F.regexp_replace("value", r"[\r\n]+\z", "")
    cols = F.split(value, "\t", -1) if strict else F.split(F.trim(value), r"\s+", 9)
    rows = data.withColumn("_c", cols)
    g = lambda i, d=".": F.coalesce(F.get("_c", F.lit(i)), F.lit(d))
    number = lambda i: F.when(g(i).rlike("^-?[0-9]+$"), g(i).try_cast("bigint"))
    return rows.select(
        F.col("line_no").alias("file_order"), g(0).alias("seqid"), g(1).alias("source"), g(2).alias("featuretype"),
        number(3).alias("start"), number(4).alias("end"), g(5).alias("score"), g(6).alias("strand"), g(7).alias("frame"),
        g(8, "").alias("raw_attributes"), F.slice("_c", 10, F.greatest(F.size("_c") - 9, F.lit(0))).alias("extra"),
    )


def peek(raw: DataFrame, n: int) -> list[str]:
    """The attribute strings of the first n + 1 features."""
    return [r[0] for r in raw.orderBy("file_order").limit(n + 1).select("raw_attributes").collect()]


def _parse_each(c: Column) -> Column:
    """Every string in its own dialect (slow: Python, in Arrow batches)."""
    import pandas as pd

    @F.pandas_udf(MAP)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: split_attributes(t or "")[0])

    return run(c)


def typed_features(raw: DataFrame, dialect: Dialect, each: bool = False, decode: bool = True) -> DataFrame:
    attributes = _parse_each(F.col("raw_attributes")) if each else parse_attributes(F.col("raw_attributes"), dialect, decode)
    return raw.withColumn("attributes", attributes).drop("raw_attributes").withColumn("bin", bin_of(F.col("start"), F.col("end")))


def read_gff(
    spark: SparkSession,
    data,
    from_string: bool = False,
    checklines: int = 10,
    dialect: Dialect | None = None,
    force_dialect_check: bool = False,
    strict: bool = True,
    transform=None,
    decode: bool = True,
) -> Annotation:
    """Features of a path, URL, text, of a DataFrame that has the feature columns or is
    numbered lines (line_no, value), of an iterable of feature rows (dicts), or of a store.

    The dialect is voted from the first ``checklines`` + 1 features unless given; with
    ``force_dialect_check`` every line is parsed in its own.  ``transform`` is a function
    from DataFrame to DataFrame that may change or drop rows.
    """
    if hasattr(data, "features") and hasattr(data, "relations"):
        dialect, data = dialect or data.dialect, data.features
    if not isinstance(data, (str, DataFrame)):
        rows = [{c: dict(f).get(c) for c in ROW_TYPES} | {"file_order": n} for n, f in enumerate(data, 1)]
        data = spark.createDataFrame(rows, ", ".join(f"`{c}` {t}" for c, t in ROW_TYPES.items()))
        data = data.withColumns({"bin": bin_of(F.col("start"), F.col("end")), "extra": F.coalesce("extra", F.array().cast("array<string>")), "attributes": F.coalesce("attributes", F.create_map().cast(MAP)), **{c: F.coalesce(c, F.lit(".")) for c in ("seqid", "source", "featuretype", "score", "strand", "frame")}})
    if isinstance(data, DataFrame) and not {"line_no", "value"} <= set(data.columns):
        features = data if transform is None else transform(data)
        return Annotation(features, spark.createDataFrame([], "line_no bigint, directive string"), dialect or Dialect())
    lines, directives = split_sections(data.select("line_no", "value") if isinstance(data, DataFrame) else lines_of(spark, data, from_string))
    raw = raw_features(lines, strict)
    dialect = dialect or choose_dialect(peek(raw, checklines))
    features = typed_features(raw, dialect, force_dialect_check, decode)
    return Annotation(features if transform is None else transform(features), directives, dialect)


def feature_from_line(spark: SparkSession, line: str, dialect: Dialect | None = None, strict: bool = True) -> DataFrame:
    """One feature row from one line."""
    lines = [x for x in line.splitlines() if x.strip()]
    if len(lines) != 1:
        raise ValueError("exactly one line with content is needed")
    raw = raw_features(spark.createDataFrame([(1, lines[0])], "line_no bigint, value string"), strict)
    return typed_features(raw, dialect or choose_dialect(peek(raw, 0)))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seqid, seq): one row per record, the name up to the first blank."""
    lines = numbered_lines(spark, path).filter("value <> ''")
    head = F.when(F.startswith("value", F.lit(">")), F.split(F.substring("value", 2, 1 << 30), r"\s+")[0])
    return fasta_records(lines.withColumn("name", head))


def fasta_records(lines: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Assemble records from (line_no, value, name), the name set on header lines.  Every
    line carries the number of its header: counted within blocks of lines, and over the
    blocks by one row each.  A record is one value, so its lines come together in one task
    by nature."""
    rows = lines.withColumn("_block", F.floor(F.col("line_no") / block))
    heads = rows.groupBy("_block").agg(F.count("name").alias("n"))
    before = F.sum("n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # one row per block
    heads = heads.select("_block", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.count("name").over(Window.partitionBy("_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_in", inside).join(heads, "_block").withColumn("record", F.col("_in") + F.col("_before")).filter("record > 0")
    whole = rows.groupBy("record").agg(F.max("name").alias("seqid"), F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("line_no", "value")))).alias("x"))
    return whole.select("seqid", F.array_join(F.transform("x", lambda e: e.value), "").alias("seq"))
