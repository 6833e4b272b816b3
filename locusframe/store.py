"""An annotation store: features, relations, duplicates, counters and directives.

A store is a set of DataFrames.  Operations that change it return a new store; ``save``
writes a new version directory and then moves the pointer to it, so readers see whole
versions and every earlier one is a backup.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.attributes import Dialect, merge_attributes
from locusframe.operators import aggregate, derive, ingest, merge, query, relate
from locusframe.session import _filesystem, cut
from locusframe.sources.gff import FEATURE, Annotation, read_gff

TABLES = ("features", "relations", "duplicates", "autoincrements", "directives")


@dataclass(frozen=True)
class AnnotationStore:
    features: DataFrame
    relations: DataFrame
    duplicates: DataFrame
    autoincrements: DataFrame
    directives: DataFrame
    dialect: Dialect
    options: dict

    # -- making and changing -------------------------------------------------------
    @staticmethod
    def create(
        spark: SparkSession,
        data,
        id_spec=None,
        merge_strategy: str = "error",
        force_merge_fields: list[str] | None = None,
        force_gff: bool = False,
        gtf_transcript_key: str = "transcript_id",
        gtf_gene_key: str = "gene_id",
        gtf_subfeature: str = "exon",
        infer_genes: bool = True,
        infer_transcripts: bool = True,
        depth: int = 2,
        **reading,
    ) -> AnnotationStore:
        """Load a path, URL, text (``from_string=True``) or DataFrame; see ``read_gff`` for
        the reading options.  GTF gets its edges from the two keys, GFF from ``Parent``."""
        source = read_gff(spark, data, **reading)
        options = {"id_spec": id_spec, "merge_strategy": merge_strategy, "force_merge_fields": force_merge_fields, "gtf": source.dialect.fmt == "gtf" and not force_gff, "transcript_key": gtf_transcript_key, "gene_key": gtf_gene_key, "subfeature": gtf_subfeature, "infer_genes": infer_genes, "infer_transcripts": infer_transcripts, "depth": depth}
        empty = AnnotationStore(
            spark.createDataFrame([], source.features.schema).withColumn("id", F.lit("")).select(FEATURE),
            spark.createDataFrame([], "parent string, child string, level int"),
            spark.createDataFrame([], "idspecid string, newid string"),
            spark.createDataFrame([], "base string, n bigint"),
            source.directives, source.dialect, options,
        )
        if source.features.isEmpty():
            raise ingest.EmptyInput("no features to load")
        return empty._load(source)

    def _load(self, source: Annotation, **over) -> AnnotationStore:
        o = self.options | over
        spec = o["id_spec"] if o["id_spec"] is not None else (ingest.GTF_IDS if o["gtf"] else "ID")
        rows, counters = ingest.assign_ids(source.features, spec, self.autoincrements)
        last = self.features.agg(F.coalesce(F.max("file_order"), F.lit(0))).first()[0]
        rows = cut(rows.withColumn("file_order", F.col("file_order") + last).select(FEATURE), "loaded")
        if o["merge_strategy"] == "error" and not rows.join(self.features.select("id"), "id", "left_semi").isEmpty():
            raise ingest.DuplicateId("an id is already in the store")
        features, pairs = ingest.resolve_duplicates(self.features.select(FEATURE).unionByName(rows), o["merge_strategy"], o["force_merge_fields"])
        named = features if o["merge_strategy"] == "create_unique" else rows
        if o["gtf"]:
            edges = ingest.gtf_edges(named, o["transcript_key"], o["gene_key"])
            new = ingest.infer_extents(features, edges, o["subfeature"], o["transcript_key"], o["gene_key"], o["infer_transcripts"], o["infer_genes"])
            # a row that is there explicitly wins over an inferred one, and takes its
            # attributes where both agree in all other columns
            new = cut(new, "inferred")
            same = new.select("id", *[F.col(c).alias(f"_{c}") for c in ingest.SHAPE], F.col("attributes").alias("_more"))
            agree = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ingest.SHAPE])
            both = features.join(same, "id", "left")
            features = both.withColumn("attributes", F.when(F.col("_more").isNotNull() & agree, merge_attributes(F.col("attributes"), F.col("_more"))).otherwise(F.col("attributes"))).select(features.columns)
            features = features.unionByName(new.join(features.select("id"), "id", "left_anti").select(FEATURE))
        else:
            edges = ingest.gff_edges(named, features, o["depth"], links=self.relations.filter("level = 1"))
        relations = self.relations.union(edges.select("parent", "child", F.col("level").cast("int"))).distinct()
        return replace(self, features=cut(features.select(FEATURE), "features"), relations=cut(relations, "relations"), duplicates=self.duplicates.union(pairs).distinct(), autoincrements=cut(counters, "counters"))

    def update(self, data, **options) -> AnnotationStore:
        """With more features, under the same resolution; nothing changes for no rows."""
        reading = {k: options.pop(k) for k in ("from_string", "checklines", "force_dialect_check", "transform", "strict", "decode") if k in options}
        source = read_gff(self.features.sparkSession, data, dialect=self.dialect, **reading)
        return self if source.features.isEmpty() else self._load(source, **options)

    def delete(self, ids: str | list[str] | DataFrame | AnnotationStore) -> AnnotationStore:
        if isinstance(ids, AnnotationStore):
            ids = ids.features
        if not isinstance(ids, DataFrame):
            ids = self.features.sparkSession.createDataFrame([(i,) for i in ([ids] if isinstance(ids, str) else ids)], "id string")
        features, relations = ingest.delete(self.features, self.relations, ids)
        return replace(self, features=features, relations=relations)

    def add_relation(self, parent: str, child: str, level: int, parent_func=None, child_func=None) -> AnnotationStore:
        features, relations = ingest.add_relation(self.features, self.relations, parent, child, level, parent_func, child_func)
        return replace(self, features=features, relations=relations)

    # -- saving and opening ---------------------------------------------------------
    def save(self, path: str) -> int:
        """Write the next version under ``path``; returns its number."""
        spark = self.features.sparkSession
        fs, root = _filesystem(spark, path)
        fs.mkdirs(root)
        found = [int(s.getPath().getName()[1:]) for s in fs.listStatus(root) if s.getPath().getName()[1:].isdigit()]
        version = max(found, default=0) + 1
        out = f"{path}/v{version}"
        for t in TABLES:
            df = getattr(self, t)
            if t == "features":  # clustered, so that min/max statistics prune region queries
                df = df.repartitionByRange(F.col("seqid"), F.col("start")).sortWithinPartitions("seqid", "start")
            df.write.parquet(f"{out}/{t}")
        options = {k: v for k, v in self.options.items() if not callable(v)}
        meta = json.dumps({"dialect": self.dialect.to_dict(), "options": options, "format": 1})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.text(f"{out}/meta")
        stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), True)
        stream.writeBytes(str(version))
        stream.close()
        return version

    @staticmethod
    def open(spark: SparkSession, path: str, version: int | None = None) -> AnnotationStore:
        """The current version, or an earlier one; ValueError where there is no store."""
        fs, root = _filesystem(spark, path)
        if version is None:
            current = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
            if not fs.exists(current):
                raise ValueError(f"no annotation store at {path!r}")
            version = int(spark.read.text(f"{path}/CURRENT").first()[0])
        at = f"{path}/v{version}"
        meta = json.loads(spark.read.text(f"{at}/meta").first()[0])
        return AnnotationStore(*[spark.read.parquet(f"{at}/{t}") for t in TABLES], Dialect.from_dict(meta["dialect"]), meta["options"])

    # -- asking ---------------------------------------------------------------------
    def __getitem__(self, feature_id: str) -> DataFrame:
        return query.get_feature(self.features, feature_id)

    def all_features(self, **kw) -> DataFrame:
        return query.all_features(self.features, **kw)

    def features_of_type(self, featuretype, **kw) -> DataFrame:
        return query.all_features(self.features, featuretype=featuretype, **kw)

    def region(self, region=None, **kw) -> DataFrame:
        return query.region(self.features, region, **kw)

    def children(self, ids, level=None, **kw) -> DataFrame:
        return relate.children(self.features, self.relations, ids, level, **kw)

    def parents(self, ids, level=None, **kw) -> DataFrame:
        return relate.parents(self.features, self.relations, ids, level, **kw)

    def units(self, featuretype: str = "gene") -> DataFrame:
        return relate.units(self.features, self.relations, featuretype)

    def count_features_of_type(self, featuretype=None) -> int:
        return query.where(self.features, featuretype).count()

    def featuretypes(self) -> DataFrame:
        return query.featuretypes(self.features)

    def seqids(self) -> DataFrame:
        return query.seqids(self.features)

    def attribute_search(self, text: str, featuretype=None) -> DataFrame:
        return query.attribute_search(self.features, text, featuretype)

    def interfeatures(self, df: DataFrame, **kw) -> DataFrame:
        return derive.interfeatures(df, kw.pop("group", ["seqid"]), kw.pop("order", ["start", "end", "id"]), **kw)

    def introns(self, **kw) -> DataFrame:
        return derive.introns(self.features, self.relations, **kw)

    def splice_sites(self, **kw) -> DataFrame:
        return derive.splice_sites(self.features, self.relations, **kw)

    def start_sites(self, **kw) -> DataFrame:
        return derive.start_sites(self.features, self.relations, **kw)

    def merge(self, **kw) -> DataFrame:
        return merge.merge_features(self.features, **kw)

    def merge_all(self, **kw) -> AnnotationStore:
        features, relations = merge.merge_all(self.features, self.relations, **kw)
        return replace(self, features=features, relations=relations)

    def children_bp(self, **kw) -> DataFrame:
        return aggregate.children_bp(self.features, self.relations, **kw)

    def schema(self) -> str:
        """The tables as DDL."""
        return ";\n".join(f"CREATE TABLE {t} ({getattr(self, t).schema.toDDL()})" for t in TABLES)

    def execute(self, sql: str) -> DataFrame:
        """SQL over the store's tables, which become temporary views."""
        for t in TABLES:
            getattr(self, t).createOrReplaceTempView(t)
        return self.features.sparkSession.sql(sql)
