"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.functions.text import norm_id_or_null, trim_white
from locusframe.llm.components import connected_components
from locusframe.operators.skew import salted_join
from locusframe.session import cut

# What stands for "no value" (compared after trimming and lower-casing).
STAND_INS = ("", "-", "--", "---", ".", "..", "...", "?", "??", "*", "_", "n/a", "na", "n.a.", "nan", "nil", "none", "null", "(null)", "unknown", "undefined", "undef", "unspecified", "not available", "tbd")


def usable(value: Column) -> Column:
    """True where a value is there and not a mere stand-in."""
    return value.isNotNull() & ~F.lower(trim_white(value)).isin(*STAND_INS)


def survive(rows: DataFrame, group: str, field: str, value: str, order: list[Column]) -> DataFrame:
    """(group, field, value): of each group and field the value that ranks first.

    The ranking is a window with a filter on its first row; Spark keeps the first row
    per group already in every map task (WindowGroupLimit), so that a group with a
    third of all rows sends one row per task.  ``order`` must end in a unique column.
    """
    rank = F.row_number().over(Window.partitionBy(group, field).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").select(group, field, value)


def duplicate_groups(duplicates: DataFrame, first: str, renamed: str) -> DataFrame:
    """(id, group_id) of all ids linked through ``duplicates`` at any remove.

    ``group_id`` is the id that nobody was renamed to; the smallest such id where there
    are several, the smallest of all where a loop leaves none.
    """
    edges = duplicates.select(norm_id_or_null(first).alias("a"), norm_id_or_null(renamed).alias("b")).filter("a is not null and b is not null and a <> b")
    edges = cut(edges.distinct(), "dup-edges")
    parts = connected_components(edges, "a", "b")
    targets = edges.select(F.col("b").alias("node")).distinct().withColumn("_renamed", F.lit(True))
    marked = cut(parts.join(targets, "node", "left"), "dup-parts")
    heads = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("_renamed").isNull(), F.col("node"))), F.min("node")).alias("group_id"), F.count(F.lit(1)).alias("n"))
    heads = cut(heads, "dup-heads")
    return salted_join(marked, heads, "component", "n", spread=["node"]).select(F.col("node").alias("id"), "group_id")


#: How members of a group may be ranked, best first.
RANKS = {
    "recency": lambda: F.col("loaded_at").desc_nulls_last(),
    "trust": lambda: F.col("trust_rank").asc_nulls_last(),
    "completeness": lambda: F.col("n_usable").desc(),
}


def best_records(features: DataFrame, duplicates: DataFrame, sources: DataFrame, keys: list[str], by: tuple[str, ...] = ("recency", "trust")) -> DataFrame:
    """(group_id, attr_key, attr_value): one best value per field of each group.

    Groups with fewer than two ids that have a record are left out.  Of the usable
    values the one of the member that ranks first wins.  ``by`` says in which order the
    latest load, the more trusted source (an unknown one ranks last) and the number of
    usable ``keys`` of the record count; ties go to the higher file_order.  A field no member
    can fill gives no row.  Source names are compared after trimming, lower-casing and
    reading ``-`` as ``_``.  Rows with a null id belong to no group; a null time ranks last.

    Ids of ``features`` are counted before they are joined, so that an id that a third of
    the records carry is spread over several tasks.
    """
    groups = cut(duplicate_groups(duplicates, "idspecid", "newid"), "dup-groups")
    ids = features.select(norm_id_or_null("id").alias("id")).filter("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("n_rows"))
    groups = cut(groups.join(ids, "id"), "dup-ids")
    real = groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_members")).filter("n_members >= 2")
    groups = cut(groups.join(real, "group_id").select("id", "group_id", "n_rows"), "dup-members")
    source = lambda c: F.replace(F.lower(trim_white(c)), F.lit("-"), F.lit("_"))
    attrs = F.array(*[F.struct(F.lit(k).alias("attr_key"), F.get(F.filter(F.try_element_at("attributes", F.lit(k)), usable), F.lit(0)).alias("attr_value")) for k in keys])
    # the fields are filtered before the join: most records have none of them
    rows = features.select(norm_id_or_null("id").alias("id"), "file_order", "loaded_at", source(F.col("source")).alias("src"), F.filter(attrs, lambda x: x.attr_value.isNotNull()).alias("found"))
    members = salted_join(rows.filter("id is not null and size(found) > 0"), groups, "id", "n_rows", spread=["file_order", "loaded_at"])
    trust = sources.groupBy(source(F.col("source_name")).alias("src")).agg(F.min("trust_rank").alias("trust_rank"))
    members = members.join(trust, "src", "left").withColumn("n_usable", F.size("found"))
    fields = members.select("group_id", "file_order", "loaded_at", "trust_rank", "n_usable", F.explode("found").alias("x")).select("*", "x.attr_key", "x.attr_value")
    order = [*(RANKS[r]() for r in by), F.col("file_order").desc_nulls_last(), F.col("attr_value")]
    return survive(fields, "group_id", "attr_key", "attr_value", order)
