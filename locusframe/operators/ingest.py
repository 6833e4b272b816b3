"""Assigning ids, resolving duplicates and deriving the hierarchy of what is loaded."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.attributes import MAP, first_value
from locusframe.functions.bins import bin_of
from locusframe.operators.relate import closure
from locusframe.operators.sequence import number_rows
from locusframe.session import cut

SHAPE = ["seqid", "source", "featuretype", "start", "end", "score", "strand", "frame"]
STRATEGIES = ("error", "warning", "merge", "create_unique", "replace")
GTF_IDS = {"gene": "gene_id", "transcript": "transcript_id"}


class DuplicateId(ValueError):
    """Two rows have one id and the strategy is ``error``."""


class EmptyInput(ValueError):
    """There is no feature to load."""


def _spec_column(spec: str) -> Column:
    """``:field:`` is a column, anything else an attribute with one value."""
    if spec.startswith(":") and spec.endswith(":") and len(spec) > 2:
        return F.col(spec[1:-1]).cast("string")
    values = F.try_element_at("attributes", F.lit(spec))
    many = F.raise_error(F.concat(F.lit(f"several values of {spec}: "), F.to_json(values))).cast("string")
    return F.when(F.size(values) > 1, many).otherwise(first_value(F.col("attributes"), spec))


def id_column(spec: str | list[str] | dict[str, str | list[str]] | Callable[[], Column] | None) -> Column:
    """The id a spec gives each row, null where it gives none.

    A list takes the first that is there, a dict goes by feature type, a callable returns
    a Column; its value ``autoincrement:x`` numbers rows under ``x``.
    """
    if spec is None:
        return F.lit(None).cast("string")
    if callable(spec):
        return spec()
    if isinstance(spec, str):
        return _spec_column(spec)
    if isinstance(spec, dict):
        out = F.lit(None).cast("string")
        for kind, s in spec.items():
            out = F.when(F.col("featuretype") == kind, id_column(s)).otherwise(out)
        return out
    return F.coalesce(*[_spec_column(s) for s in spec])


def assign_ids(df: DataFrame, spec, counters: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``id``, counters): rows the spec leaves without an id are numbered per
    feature type, in file order, after the last number in ``counters`` (base, n)."""
    rows = df.drop("id").withColumn("_raw", id_column(spec))
    auto = F.startswith("_raw", F.lit("autoincrement:"))
    rows = rows.withColumn("_base", F.when(F.col("_raw").isNull(), F.col("featuretype")).when(auto, F.substring("_raw", 15, 1 << 30)))
    if counters is None:
        counters = df.sparkSession.createDataFrame([], "base string, n bigint")
    bare = number_rows(rows.filter("_base is not null"), ["_base"], "file_order", "_n")
    bare = bare.join(counters.select(F.col("base").alias("_base"), F.col("n").alias("_last")), "_base", "left").withColumn("_n", F.col("_n") + F.coalesce("_last", F.lit(0)))
    after = bare.groupBy(F.col("_base").alias("base")).agg(F.max("_n").alias("n"))
    named = rows.filter("_base is null").withColumn("id", F.col("_raw"))
    cols = ["id", *[c for c in df.columns if c != "id"]]
    out = named.select(cols).unionByName(bare.withColumn("id", F.concat_ws("_", "_base", "_n")).select(cols))
    return out, counters.union(after).groupBy("base").agg(F.max("n").alias("n"))


def resolve_duplicates(rows: DataFrame, strategy: str = "error", force_merge_fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(features with unique ids, duplicates (idspecid, newid)) of rows with ``id``.

    * ``error`` raises DuplicateId; * ``warning`` keeps the first row; * ``replace`` keeps
    the last row at the first one's place; * ``create_unique`` names later rows ``id_1``,
    ``id_2`` ...; * ``merge`` joins rows that agree in all columns but the attributes and
    names rows of another shape as ``create_unique`` does.  ``force_merge_fields`` need
    not agree; they become their sorted values joined by commas.

    An id made up that a row already has raises DuplicateId.  Order is file_order.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {', '.join(STRATEGIES)}")
    spark = rows.sparkSession
    none = spark.createDataFrame([], "idspecid string, newid string")
    cols = rows.columns
    if strategy == "error":
        twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
        if twice:
            raise DuplicateId(f"id {twice[0]['id']!r} occurs {twice[0]['n']} times")
        return rows, none
    if strategy in ("warning", "replace"):
        whole = F.struct(*[F.col(c) for c in cols if c != "id"])
        pick = (F.min_by if strategy == "warning" else F.max_by)(whole, "file_order")
        best = rows.groupBy("id").agg(pick.alias("w"), F.min("file_order").alias("_first"))
        out = best.select("id", *[F.col("_first").alias(c) if c == "file_order" else F.col(f"w.{c}").alias(c) for c in cols if c != "id"])
        return out.select(cols), none
    if strategy == "create_unique":
        ranked = number_rows(rows, ["id"], "file_order", "_r")
        out = ranked.withColumn("_new", F.when(F.col("_r") == 1, F.col("id")).otherwise(F.concat_ws("_", "id", (F.col("_r") - 1).cast("string"))))
        return _unique(out, cols)
    forced = list(force_merge_fields or [])
    if bad := [c for c in forced if c in ("start", "end")]:
        raise ValueError(f"{', '.join(bad)} cannot be merged")
    if {"strand", "frame"} & set(forced):
        warnings.warn("merged strands or frames have no meaning in GFF", stacklevel=2)
    shape = [c for c in SHAPE if c not in forced]
    by = ["id", *shape]
    rest = [c for c in cols if c not in (*by, *forced, "attributes", "file_order")]
    # by key first, so that repeated values are combined before they meet
    pairs = F.when(F.size("attributes") > 0, F.map_entries("attributes")).otherwise(F.array(F.lit(None).cast("struct<key:string,value:array<string>>")))
    flat = rows.select(*by, *forced, *rest, "file_order", F.explode(pairs).alias("_e"))
    flat = flat.select(*by, *forced, *rest, "file_order", F.col("_e.key").alias("_k"), F.explode_outer("_e.value").alias("_v"))
    firsts = F.min(F.struct("file_order", *rest)).alias("_first")
    keyed = flat.groupBy(*by, "_k").agg(firsts, F.array_sort(F.collect_set("_v")).alias("_vs"), *[F.collect_set(c).alias(c) for c in forced])
    pair = F.when(F.col("_k").isNotNull(), F.struct(F.col("_k").alias("k"), F.col("_vs").alias("v")))
    joined = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))), ",").alias(c) for c in forced]
    shapes = keyed.groupBy(*by).agg(F.min("_first").alias("_first"), F.map_from_entries(F.array_sort(F.collect_list(pair))).cast(MAP).alias("attributes"), *joined)
    shapes = shapes.select(*by, *forced, "attributes", *[F.col(f"_first.{c}").alias(c) for c in ("file_order", *rest)])
    ranked = number_rows(cut(shapes, "shapes"), ["id"], "file_order", "_r")
    return _unique(ranked.withColumn("_new", F.when(F.col("_r") == 1, F.col("id")).otherwise(F.concat_ws("_", "id", (F.col("_r") - 1).cast("string")))), cols)


def _unique(out: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows under their new ids, (idspecid, newid) of those renamed); raises DuplicateId
    where a made-up id is also a given one.  The rows are written once, before the check."""
    out = cut(out, "renamed")
    pairs = out.filter("_r > 1").select(F.col("id").alias("idspecid"), F.col("_new").alias("newid"))
    made = pairs.select(F.col("newid").alias("_new"))
    clash = out.join(made, "_new", "left_semi").groupBy("_new").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).collect()
    if clash:
        raise DuplicateId(f"the new id {clash[0]['_new']!r} is taken")
    return out.withColumn("id", F.col("_new")).select(cols), pairs


def gff_edges(rows: DataFrame, features: DataFrame, depth: int = 2, key: str = "Parent", links: DataFrame | None = None) -> DataFrame:
    """Level-1 edges of every ``Parent`` value, even of parents that are not there, and
    further levels below parents that are; ``links`` (parent, child) are level-1 edges
    already known."""
    one = rows.select(F.explode(F.try_element_at("attributes", F.lit(key))).alias("parent"), F.col("id").alias("child")).filter("parent <> ''")
    one = one if links is None else one.union(links.select("parent", "child"))
    return closure(one, depth, features.select("id"))


def gtf_edges(rows: DataFrame, transcript_key: str = "transcript_id", gene_key: str = "gene_id") -> DataFrame:
    """(transcript, row, 1), (gene, row, 2) and (gene, transcript, 1) of every row; a row
    that is its own transcript or gene gives an edge to itself."""
    t, g = first_value(F.col("attributes"), transcript_key), first_value(F.col("attributes"), gene_key)
    e = lambda p, c, n: F.struct(p.alias("parent"), c.alias("child"), F.lit(n).alias("level"))
    edges = rows.select(F.explode(F.array(e(t, F.col("id"), 1), e(g, F.col("id"), 2), e(g, t, 1))).alias("x")).select("x.*")
    return edges.filter("parent is not null and child is not null").distinct()


def infer_extents(features: DataFrame, edges: DataFrame, subfeature: str = "exon", transcript_key: str = "transcript_id", gene_key: str = "gene_id", transcripts: bool = True, genes: bool = True, source: str = "derived") -> DataFrame:
    """Rows for the transcripts and genes that a GTF leaves implicit: from the first start to the
    last end of their sub-features, seqid and strand of the leftmost one."""
    one = edges.filter("level = 1 and parent <> child")
    parts = features.filter(F.col("featuretype") == subfeature).select(F.col("id").alias("child"), "seqid", "start", "end", "strand")
    tx = one.select(F.col("parent").alias("t"), "child").join(parts, "child")
    genes_of = one.select(F.col("parent").alias("g"), F.col("child").alias("t"))
    both = tx.join(genes_of, "t")
    left = F.struct("start", "end", "child")
    extent = [F.min_by("seqid", left).alias("seqid"), F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("strand", left).alias("strand")]
    found = []
    if transcripts:
        rows = both.groupBy(F.col("t").alias("id"), F.col("g")).agg(*extent)
        attrs = F.create_map(F.lit(transcript_key), F.array("id"), F.lit(gene_key), F.array("g"))
        found.append(rows.withColumn("attributes", attrs).withColumn("featuretype", F.lit("transcript")).drop("g"))
    if genes:
        rows = both.groupBy(F.col("g").alias("id")).agg(*extent)
        found.append(rows.withColumn("attributes", F.create_map(F.lit(gene_key), F.array("id"))).withColumn("featuretype", F.lit("gene")))
    if not found:
        return features.limit(0)
    out = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    dot = F.lit(".")
    return out.select(
        "id", "seqid", F.lit(source).alias("source"), "featuretype", "start", "end", dot.alias("score"), "strand", dot.alias("frame"),
        F.col("attributes").cast(MAP).alias("attributes"), F.array().cast("array<string>").alias("extra"), bin_of(F.col("start"), F.col("end")).alias("bin"), F.lit(None).cast("bigint").alias("file_order"),
    )


def delete(features: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the features of ``ids`` (id) and the edges they take part in."""
    gone = ids.select("id").distinct()
    kept = features.join(gone, "id", "left_anti")
    edges = relations.join(gone.withColumnRenamed("id", "parent"), "parent", "left_anti").join(gone.withColumnRenamed("id", "child"), "child", "left_anti")
    return kept, edges.select(relations.columns)


def add_relation(features: DataFrame, relations: DataFrame, parent: str, child: str, level: int, parent_func=None, child_func=None) -> tuple[DataFrame, DataFrame]:
    """With one more edge; ``parent_func`` and ``child_func`` change the two rows: a function
    of one argument maps the attributes column, one of two is called with (parent, child) rows
    and returns the row to keep, as in a program that holds both."""
    edges = relations.union(relations.sparkSession.createDataFrame([(parent, child, level)], "parent string, child string, level int")).distinct()
    whole = {who: f for who, f in ((parent, parent_func), (child, child_func)) if f is not None and len(inspect.signature(f).parameters) == 2}
    if whole:
        found = {r["id"]: r.asDict(recursive=True) for r in features.filter(F.col("id").isin(parent, child)).collect()}  # two rows
        both = [found.get(parent), found.get(child)]
        changed = [f(*both) for who, f in whole.items() if found.get(who) is not None]
        kept = features.join(features.sparkSession.createDataFrame([(who,) for who in whole if who in found], "id string"), "id", "left_anti")
        features = kept.select(features.columns).unionByName(features.sparkSession.createDataFrame(changed, features.schema)) if changed else features
    attrs = F.col("attributes")
    for who, f in ((parent, parent_func), (child, child_func)):
        if f is not None and who not in whole:
            attrs = F.when(F.col("id") == who, f(F.col("attributes"))).otherwise(attrs)
    return features.withColumn("attributes", attrs), edges


def sanitize(features: DataFrame, relations: DataFrame, featuretype: str = "gene") -> DataFrame:
    """Rows of all units with start and end in order and the unit's id as ``gid``."""
    from locusframe.operators.relate import units

    owner = units(features, relations, featuretype).groupBy("id").agg(F.array_sort(F.collect_set("unit_id")).alias("gid"))
    rows = features.join(owner, "id")
    attrs = F.map_concat(F.map_filter("attributes", lambda k, v: k != "gid"), F.create_map(F.lit("gid"), F.col("gid")))
    return rows.withColumns({"start": F.least("start", "end"), "end": F.greatest("start", "end"), "attributes": attrs}).drop("gid")
