"""Column-level data quality profiles from maintained value counts.

``ValueCounts`` keeps, for every column and load, how often each value occurs.  The
store is a log of signed deltas at a path: a load adds its counts, taking it back
subtracts the same counts, and ``compact`` folds the log.  Every metric - null rate,
distinct count, range, median, entropy, pattern violations, shift between loads - is exact
and derived from the counts, so a profile never scans the data again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from locusframe.functions.text import NUMBER
from locusframe.session import cut, discard, new_table_path

#: Distinct bad values up to which they are broadcast (a value is cut at 1 kB for the
#: sum, so at most 100 MB); beyond it the look-up is a shuffled join.
BROADCAST_VALUES = 100_000


class ValueCounts:
    """A persistent table (column_name, value, n, delta, load_id) with signed updates.

    A delta is one folder of the log, in it one folder per load.  It is named: applying a
    name again replaces what was there, so that a batch replayed after a failure counts once.
    A store that is opened at an existing path goes on from there; without a path it lasts
    as long as the session.
    """

    SCHEMA = "column_name string, value string, n bigint, delta string, load_id int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_table_path(spark, "value-counts")

    @staticmethod
    def delta(df: DataFrame, columns: list[str], load: str, sign: int = 1) -> DataFrame:
        """The signed counts of ``df``, one row per column, load and value (null included),
        combined before the shuffle.  Values are taken as written (cast to string)."""
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
        rows = df.select(F.col(load).cast("int").alias("load_id"), F.explode(cells).alias("x"))
        return rows.groupBy("x.column_name", "load_id", "x.value").agg((F.count(F.lit(1)) * F.lit(sign)).alias("n"))

    def _put(self, delta: DataFrame, name: str) -> None:
        delta.select("column_name", "value", "n", "load_id").write.mode("overwrite").partitionBy("load_id").parquet(f"{self.path}/delta={name}")

    def apply(self, df: DataFrame, columns: list[str], load: str, sign: int = 1, name: str | None = None) -> ValueCounts:
        """Add the signed counts of ``df``: +1 for rows loaded, -1 for rows taken back.
        Rows of several loads make one delta for each of them, in one pass."""
        self._put(self.delta(df, columns, load, sign), name or uuid.uuid4().hex)
        return self

    def take_back(self, load_id: int, name: str | None = None) -> ValueCounts:
        """Subtract what the store holds of a load, from the counts alone."""
        held = self.counts().filter(F.col("load_id") == load_id)
        self._put(held.withColumn("n", -F.col("n")), name or f"back-{load_id}-{uuid.uuid4().hex}")
        return self

    def log(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def counts(self) -> DataFrame:
        """The folded counts; values whose deltas cancel are gone."""
        return self.log().groupBy("column_name", "load_id", "value").agg(F.sum("n").alias("n")).filter("n <> 0")

    def compact(self) -> ValueCounts:
        """Fold the log into one delta, written beside the old ones before they go."""
        old = [r["delta"] for r in self.log().select("delta").distinct().collect()]
        folded = cut(self.counts(), "folded-counts")
        self._put(folded, f"folded-{uuid.uuid4().hex}")
        for name in old:
            discard(self.spark, f"{self.path}/delta={name}")
        return self


def profile(counts: DataFrame, missing: Callable[[Column], Column]) -> DataFrame:
    """One row per column: rows, null and missing rates, distinct values, entropy in
    bits, smallest and greatest number and text, and how many cells are invalid.
    ``counts`` say of each value whether it is ``valid``."""
    totals = counts.groupBy("column_name", "value", "valid").agg(F.sum("n").alias("n"))
    v, n = F.col("value"), F.col("n").cast("double")
    number = F.when(v.rlike(NUMBER), v.try_cast("double"))
    agg = totals.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(v.isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.sum(F.when(missing(v), F.col("n")).otherwise(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
        F.sum(F.when(v.isNotNull(), n * F.log2(n))).alias("_nlogn"),
        F.min(number).alias("least_number"),
        F.max(number).alias("greatest_number"),
        F.min(v).alias("least_text"),
        F.max(v).alias("greatest_text"),
        F.sum(F.when(~F.col("valid"), F.col("n")).otherwise(0)).alias("n_invalid"),
    )
    there = (F.col("n_rows") - F.col("n_null")).cast("double")
    entropy = F.when(there > 0, F.log2(there) - F.col("_nlogn") / there)
    return agg.withColumn("entropy", F.round(entropy, 6)).withColumn("null_rate", F.col("n_null") / F.col("n_rows")).drop("_nlogn")


def weighted_median(counts: DataFrame, by: list[str], number: str, n: str) -> DataFrame:
    """Exact medians from (number, count): the mean of the two middle values.  The
    running count goes over distinct numbers in two steps - per bucket of the number's
    range, then inside the buckets that hold a middle - so no group is sorted whole."""
    width = 4096
    edges = counts.groupBy(*by).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.sum(n).alias("_all"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(width - 1), F.floor((F.col(number) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * width))).otherwise(0)
    rows = counts.join(edges, by).withColumn("_b", at.cast("int"))
    buckets = rows.groupBy(*by, "_b").agg(F.sum(n).alias("_n"), F.first("_all").alias("_all"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    lower, upper = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    buckets = buckets.withColumn("_to", upto).withColumn("_before", F.col("_to") - F.col("_n"))
    buckets = buckets.filter((F.col("_before") < upper) & (F.col("_to") >= lower)).drop("_n", "_all", "_to")
    inside = rows.join(buckets, [*by, "_b"])
    run = F.sum(n).over(Window.partitionBy(*by, "_b").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")
    inside = inside.withColumn("_to", run)
    low = F.min(F.when(F.col("_to") >= lower, F.col(number)))
    high = F.min(F.when(F.col("_to") >= upper, F.col(number)))
    return inside.groupBy(*by).agg(((low + high) / 2).alias("median"))


def shifted_loads(counts: DataFrame, missing: Callable[[Column], Column], shares: list[str], numeric: str, limit: float = 0.2, factor: float = 5.0) -> DataFrame:
    """(column_name, load_id) of loads that moved against the load before (load_id - 1).

    For every column the share of missing cells, for those in ``shares`` also the share
    of any one value, by more than ``limit``; for ``numeric`` the medians of the valid
    numbers by more than ``factor``.  A load whose predecessor has no rows is not judged.
    """
    # Ratios are compared in whole numbers: a/b - c/d > limit as |a*d - c*b| > limit*b*d
    counts = counts.filter("load_id is not null")
    rows = counts.groupBy("column_name", "load_id").agg(F.sum("n").alias("rows"), F.sum(F.when(missing(F.col("value")), F.col("n")).otherwise(0)).alias("n"))
    kinds = [rows.select("column_name", "load_id", F.lit(None).cast("string").alias("value"), "n")]
    kinds.append(counts.filter(F.col("column_name").isin(*shares) & F.col("value").isNotNull()).select("column_name", "load_id", "value", "n"))
    parts = reduce(DataFrame.unionByName, kinds)
    # every value is compared on both sides, also where one of the loads lacks it
    pairs = parts.select("column_name", "value", F.explode(F.array(F.struct(F.col("load_id").alias("load_id"), F.col("n").alias("now"), F.lit(0).alias("was")), F.struct((F.col("load_id") + 1).alias("load_id"), F.lit(0).alias("now"), F.col("n").alias("was")))).alias("x"))
    pairs = pairs.groupBy("column_name", "value", "x.load_id").agg(F.sum("x.now").alias("now"), F.sum("x.was").alias("was"))
    size = rows.select("column_name", "load_id", F.col("rows").alias("rows_now"))
    before = rows.select("column_name", (F.col("load_id") + 1).alias("load_id"), F.col("rows").alias("rows_was"))
    size = size.join(before, ["column_name", "load_id"])  # one row per column and load
    pairs = pairs.join(size, ["column_name", "load_id"])
    d = lambda c: F.col(c).cast("decimal(38,0)")
    moved = F.abs(d("now") * d("rows_was") - d("was") * d("rows_now")) > F.lit(str(limit)).cast("decimal(6,4)") * d("rows_now") * d("rows_was")
    found = pairs.filter(moved).select("column_name", "load_id").distinct()
    v = F.col("value")
    numbers = counts.filter((F.col("column_name") == numeric) & v.rlike(NUMBER) & F.col("valid")).groupBy("column_name", "load_id", v.cast("double").alias("x")).agg(F.sum("n").alias("n"))
    medians = cut(weighted_median(numbers, ["column_name", "load_id"], "x", "n"), "medians")
    was = medians.select("column_name", (F.col("load_id") + 1).alias("load_id"), F.col("median").alias("was"))
    jumped = medians.join(was, ["column_name", "load_id"]).filter(F.greatest("median", "was") > factor * F.least("median", "was"))
    return found.unionByName(jumped.select("column_name", "load_id")).distinct()


def bad_cells(df: DataFrame, row_key: str, columns: list[str], counts: DataFrame) -> DataFrame:
    """(column_name, row_key) of the cells whose value breaks its column's form.

    Which values do is said by ``valid`` of the maintained counts, once per distinct value; the
    cells are then looked up.  The bad values are broadcast only where the counts say
    there are few; else the cells are shuffled, where AQE splits a hot value.
    """
    bad = cut(counts.filter("value is not null and not valid").select("column_name", "value").distinct(), "bad-values")
    size = bad.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.greatest(F.length("value") - 1000, F.lit(0))), F.lit(0))).first()
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    rows = df.select(F.col(row_key), F.explode(cells).alias("x")).select(row_key, "x.column_name", "x.value").filter("value is not null")
    small = size[0] <= BROADCAST_VALUES and size[1] <= 10_000_000
    return rows.join(F.broadcast(bad) if small else bad, ["column_name", "value"], "left_semi").select("column_name", row_key)
