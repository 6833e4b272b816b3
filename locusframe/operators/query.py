"""Projection, filters, regions, ordering and counts over feature rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from locusframe.functions.attributes import has_text

ORDERABLE = ("seqid", "source", "featuretype", "start", "end", "score", "strand", "frame", "attributes", "extra", "file_order", "length")


class FeatureNotFound(LookupError):
    """No feature has the id."""


def parse_region(region: str) -> tuple[str, int | None, int | None, str | None]:
    """``seqid``, ``seqid:start-end`` or ``seqid:start-end:strand``."""
    m = re.fullmatch(r"(.+?):(\d+)-(\d+)(?::([-+.?]))?", region)
    return (m[1], int(m[2]), int(m[3]), m[4]) if m else (region, None, None, None)


def span_predicate(start: int | None, end: int | None, within: bool = False) -> list[Column]:
    """Rows that overlap [start, end] or, with ``within``, lie inside it.

    Two bounds are closed and may come in either order; a single bound is open for an
    overlap (`end > start`, `start < end`).  0 counts as no bound.
    """
    s, e = F.col("start"), F.col("end")
    start, end = start or None, end or None
    if within:
        return [c for c, v in ((s >= start, start), (e <= end, end)) if v is not None] if start or end else []
    if start and end:
        return [s <= max(start, end), e >= min(start, end)]
    return [e > start] if start else [s < end] if end else []


def where(df: DataFrame, featuretype: str | Iterable[str] | None = None, strand: str | None = None, limit: str | tuple | None = None, completely_within: bool = False) -> DataFrame:
    """The shared filter: feature types, strand, and a region ``limit`` with closed bounds."""
    if featuretype is not None:
        df = df.filter(F.col("featuretype") == featuretype if isinstance(featuretype, str) else F.col("featuretype").isin(*featuretype))
    if strand is not None:
        df = df.filter(F.col("strand") == strand)
    if limit is not None:
        seqid, start, end = parse_region(limit)[:3] if isinstance(limit, str) else limit
        df = df.filter(F.col("seqid") == seqid)
        for c in span_predicate(start, end, completely_within):
            df = df.filter(c)
    return df


def order(df: DataFrame, by: str | Iterable[str] | None = None, reverse: bool = False) -> DataFrame:
    """Sort by feature columns; ``length`` is the length; ``reverse`` turns the last key
    only.  Nulls come first ascending and last descending.  Without keys nothing is sorted,
    unless ``reverse`` asks for the file order backwards."""
    if by is None and not reverse:
        return df
    keys = ["file_order"] if by is None else [by] if isinstance(by, str) else list(by)
    if unknown := [k for k in keys if k not in ORDERABLE]:
        raise ValueError(f"cannot order by {', '.join(unknown)}")
    cols = [F.col("end") - F.col("start") if k == "length" else F.to_json("attributes") if k == "attributes" else F.to_json("extra") if k == "extra" else F.col(k) for k in keys]
    cols[-1] = cols[-1].desc() if reverse else cols[-1]
    return df.orderBy(*cols)


def all_features(df: DataFrame, order_by=None, reverse: bool = False, **filters) -> DataFrame:
    return order(where(df, **filters), order_by, reverse)


def get_feature(df: DataFrame, feature_id: str) -> DataFrame:
    """The one row of an id; FeatureNotFound if there is none."""
    row = df.filter(F.col("id") == feature_id).limit(1)
    if row.isEmpty():
        raise FeatureNotFound(feature_id)
    return row


def region(df: DataFrame, region: str | Row | Mapping | None = None, seqid: str | None = None, start: int | None = None, end: int | None = None, strand: str | None = None, featuretype=None, completely_within: bool = False) -> DataFrame:
    """Rows in a region, given as text, as a feature (a row with seqid, start and end) or
    in parts, but not both; no part gives all rows.  For many regions at once see
    :func:`relate.overlap_join`."""
    if region is not None:
        if seqid is not None or start is not None or end is not None:
            raise ValueError("give either region or seqid, start and end")
        seqid, start, end, s = parse_region(region) if isinstance(region, str) else (region["seqid"], region["start"], region["end"], None)
        strand = s or strand
    if seqid is not None:
        df = df.filter(F.col("seqid") == seqid)
    for c in span_predicate(start, end, completely_within):
        df = df.filter(c)
    return where(df, featuretype, strand)


def attribute_search(df: DataFrame, text: str, featuretype=None) -> DataFrame:
    """Rows with an attribute value that contains ``text``, whatever the case."""
    return where(df, featuretype).filter(has_text(F.col("attributes"), text))


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("featuretype").agg(F.count(F.lit(1)).alias("n"))


def featuretypes(df: DataFrame) -> DataFrame:
    return df.select("featuretype").distinct()


def seqids(df: DataFrame) -> DataFrame:
    return df.select("seqid").distinct()


def inspect(df: DataFrame, look_for: Iterable[str] = ("seqid", "source", "featuretype", "strand", "frame", "attribute_keys"), limit: int | None = None) -> DataFrame:
    """(field, value, n): value counts per column and per attribute key, and the row count
    as field ``feature_count``; ``limit`` counts the first rows in file order."""
    if limit is not None:
        df = df.orderBy("file_order").limit(limit)
    cells = [F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in look_for if c != "attribute_keys"]
    cells.append(F.struct(F.lit("feature_count").alias("field"), F.lit(None).cast("string").alias("value")))
    each = F.array(*cells)
    if "attribute_keys" in look_for:
        keys = F.transform(F.map_keys("attributes"), lambda k: F.struct(F.lit("attribute_keys").alias("field"), k.alias("value")))
        each = F.concat(each, F.coalesce(keys, F.array().cast("array<struct<field:string,value:string>>")))
    return df.select(F.explode(each).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))
