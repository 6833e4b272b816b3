"""References to records that do not exist.

``orphan_references`` groups references by the null mask of their (composite) key
and looks each mask up on its non-null columns, applying a declared match rule:

* ``simple``  - a reference with any null part is not checked (the SQL default);
* ``full``    - all parts null is fine, some parts null is an orphan;
* ``partial`` - the non-null parts must occur together in some record.

References are first reduced to distinct keys (a map-side combine), so a parent
named by a third of all rows is looked up once; the verdicts of the orphan keys
go back to the rows through a salted join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.functions.text import norm_id_or_null
from locusframe.operators.skew import ROWS_PER_SALT, salted_join
from locusframe.session import cut


def _mask(cols: list[str]):
    """Bit i is set where column i is not null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(cols)])


def key_verdicts(
    refs: DataFrame,
    ref_cols: list[str],
    ref_time: str,
    keys: DataFrame,
    key_cols: list[str],
    key_time: str,
    removals: DataFrame | None = None,
    removal_cols: list[str] | None = None,
    removal_time: str = "removed_at",
    match: str = "simple",
) -> DataFrame:
    """One row per distinct reference key that may be an orphan: the key columns,
    ``n_refs``, ``reason`` (`missing`, `deleted`, `late` or `partial_null`) and
    ``first_at``, the earliest time of its records (only for `late`)."""
    if match not in ("simple", "full", "partial"):
        raise ValueError(f"match must be simple, full or partial, not {match!r}")
    k = len(ref_cols)
    whole = (1 << k) - 1
    distinct = refs.groupBy(*ref_cols).agg(F.count(F.lit(1)).alias("n_refs"), F.min(ref_time).alias("first_ref"))
    if k > 1:
        distinct = cut(distinct.withColumn("_mask", _mask(ref_cols)), "reference-keys")
        occur = {r["_mask"] for r in distinct.select("_mask").distinct().collect()}  # at most 2^k
    found = []
    if match == "full" and k > 1:
        some = distinct.filter((F.col("_mask") != 0) & (F.col("_mask") != whole))
        found.append(some.select(*ref_cols, "n_refs", F.lit("partial_null").alias("reason"), F.lit(None).cast("timestamp").alias("first_at")))
    for mask in range(whole, 0, -1):
        if mask != whole and (match != "partial" or mask not in occur):
            continue
        on = [c for i, c in enumerate(ref_cols) if mask >> i & 1]
        part = distinct.filter(F.col("_mask") == mask) if k > 1 else distinct.filter(F.col(on[0]).isNotNull())
        their = [c for i, c in enumerate(key_cols) if mask >> i & 1]
        known = keys.select(*[F.col(a).alias(b) for a, b in zip(their, on)], F.col(key_time).alias("_t"))
        known = known.groupBy(*on).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.lit(True).alias("_there"))
        seen = part.join(known, on, "left")
        if removals is not None:
            gone_cols = [c for i, c in enumerate(removal_cols or key_cols) if mask >> i & 1]
            gone = removals.select(*[F.col(a).alias(b) for a, b in zip(gone_cols, on)], F.col(removal_time).alias("_r"))
            gone = gone.groupBy(*on).agg(F.max("_r").alias("_gone"))
            seen = seen.join(gone, on, "left")
        else:
            seen = seen.withColumn("_gone", F.lit(None).cast("timestamp"))
        reason = (
            F.when(F.col("_there").isNull(), "missing")
            .when(F.col("_gone").isNotNull() & (F.col("_last").isNull() | (F.col("_gone") > F.col("_last"))), "deleted")
            .when(F.col("_first") > F.col("first_ref"), "late")
        )
        seen = seen.withColumn("reason", reason).filter(F.col("reason").isNotNull())
        found.append(seen.select(*ref_cols, "n_refs", "reason", F.when(F.col("reason") == "late", F.col("_first")).alias("first_at")))
    return reduce(DataFrame.unionByName, found)


def orphan_references(
    refs: DataFrame,
    ref_cols: list[str],
    ref_time: str,
    keys: DataFrame,
    key_cols: list[str],
    key_time: str,
    removals: DataFrame | None = None,
    removal_cols: list[str] | None = None,
    removal_time: str = "removed_at",
    match: str = "simple",
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """The rows of ``refs`` whose record does not exist, with ``reason``.

    Reasons, first that applies: ``missing`` no record has the key; ``deleted`` the
    last removal of the key is later than every load of it; ``late`` its earliest
    load is later than the reference.  Nulls: a null key part follows ``match``; a
    reference without a time is never `late`; records without any time count as
    present, and as removed where a removal stands.  Repeated rows each come out.
    Empty tables give an empty result (no records: everything is `missing`).
    Columns of ``refs`` beyond the key pass through.
    """
    verdicts = cut(
        key_verdicts(refs, ref_cols, ref_time, keys, key_cols, key_time, removals, removal_cols, removal_time, match)
        # one comparable value per composite key; to_json keeps null parts apart from empty ones
        .withColumn("_key", F.to_json(F.struct(*ref_cols), {"ignoreNullFields": "false"}) if len(ref_cols) > 1 else F.col(ref_cols[0]))
        .select("_key", "n_refs", "reason", "first_at"),
        "orphan-keys",
    )
    key = F.to_json(F.struct(*ref_cols), {"ignoreNullFields": "false"}) if len(ref_cols) > 1 else F.col(ref_cols[0])
    rows = salted_join(refs.withColumn("_key", key), verdicts, "_key", "n_refs", "inner", [*ref_cols, ref_time], rows_per_salt)
    real = (F.col("reason") != "late") | (F.col("first_at") > F.col(ref_time))
    return rows.filter(real).drop("_key", "n_refs", "first_at")


def relation_orphans(relations: DataFrame, features: DataFrame, removals: DataFrame) -> DataFrame:
    """(edge_id, load_month, reason) of the relations rows whose parent is not there."""
    refs = relations.select("edge_id", norm_id_or_null("parent").alias("ref"), F.col("loaded_at").alias("at")).filter(F.col("ref").isNotNull())
    keys = features.select(norm_id_or_null("id").alias("id"), F.col("loaded_at").alias("at"))
    gone = removals.select(norm_id_or_null("feature_id").alias("id"), "removed_at")
    out = orphan_references(refs, ["ref"], "at", keys, ["id"], "at", gone, ["id"], "removed_at")
    return out.select("edge_id", F.date_format("at", "yyyy-MM").alias("load_month"), "reason")


def orphan_report(orphans: DataFrame, table: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphans.groupBy("load_month", "reason").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(table).alias("table_name"), "load_month", "reason", "n_rows")
