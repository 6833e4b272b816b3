"""The forms that the columns of annotation features must have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.text import NUMBER

# Fixed values of the GFF columns.
STRANDS = ("+", "-", ".", "?")
FRAMES = ("0", "1", "2", ".")
PROFILED = ["score", "strand", "frame", "featuretype"]


def missing(value: Column) -> Column:
    return value.isNull() | (value == ".")


def legal_score(v: Column, ranged: bool = True) -> Column:
    """``.`` or a plain decimal number, from 0 to 1000 where ``ranged``."""
    number = v.rlike(NUMBER)
    if ranged:
        number &= F.coalesce(F.when(number, v.try_cast("double")).between(0, 1000), F.lit(False))
    return (v == ".") | number


def judged(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``counts`` (column_name, value, ...) with ``valid``: whether the value has the form
    of its column; null values are valid, columns without a form too.  Feature types are
    looked up in ``terms``, however many there are."""
    v, c = F.col("value"), F.col("column_name")
    legal = terms.filter("featuretype is not null").select(F.col("featuretype").alias("_term")).distinct().withColumn("_legal", F.lit(True))
    term = F.when(c == "featuretype", v)
    rows = counts.join(legal, term == F.col("_term"), "left")
    valid = F.when(v.isNull(), True).when(c == "score", legal_score(v)).when(c == "strand", v.isin(*STRANDS)).when(c == "frame", v.isin(*FRAMES)).when(c == "featuretype", F.col("_legal").isNotNull()).otherwise(True)
    return rows.withColumn("valid", valid).drop("_term", "_legal")
