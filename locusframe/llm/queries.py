"""Queries p3 and p8-p10.  The latter cannot be put in SQL; tests/llm checks them against
brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import leaks, packing, subjects, survivor
from locusframe.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["Name", "biotype", "product", "Note"]
    return survivor.best_records(table(spark, d, "features"), table(spark, d, "duplicates"), table(spark, d, "annot_sources"), keys)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every text with its container."""
    return packing.pack_documents(table(spark, d, "documents"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and the share of room left over, where containers combine
    buckets and where each holds members of one bucket."""
    lengths = cut(packing.token_counts(table(spark, d, "documents")), "token-counts")
    ways = [packing.packing_report(packing.pack(lengths, combine=c)).withColumn("batches", F.lit("combined" if c else "inside buckets")) for c in (True, False)]
    return ways[0].unionByName(ways[1])


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    found = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter(F.col("run") >= leaks.WINDOW).select("doc_id", "item_id")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Edited copies too: verbatim over 13 words, or aligned over 20 or more words of the
    item to seven tenths of the best score that this stretch can have.  Seeds are the rarest n-grams
    that occur of runs of eight words, so that a copy with an edit in every run is seen
    too; a copy in which no five words stand together is not."""
    found = leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), window=8, edited=True)
    return found.filter((F.col("run") >= leaks.WINDOW) | ((F.col("stretch") >= leaks.LEAST_STRETCH) & (F.col("score") >= 2 * leaks.LEAST_SCORE * F.col("stretch"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.document_subjects(table(spark, d, "documents")).select("doc_id", "subject")


def p10_agreement(spark: SparkSession, d: str) -> DataFrame:
    """What the labels say of the subjects found, per language."""
    return subjects.agreement(subjects.document_subjects(table(spark, d, "documents")), table(spark, d, "subject_labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p3_found, p8_containers, p8_report, p9_found, p9_edited, p10_found, p10_agreement)}
_ID = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"

ORACLES: dict[str, str] = {
    "p3_found": f"""
with recursive e as (select distinct {_ID.format('idspecid')} a, {_ID.format('newid')} b from duplicates where idspecid is not null and newid is not null),
u as (select a, b from e where a <> b union select b, a from e where a <> b),
reach(a, b) as (select a, a from u union select r.a, u.b from reach r join u on r.b = u.a),
comp as (select a as id, min(b) comp from reach group by 1),
head as (select comp, coalesce(min(id) filter (where id not in (select b from u join e using (a, b))), min(id)) group_id from comp group by 1),
s as (select lower(replace(trim(source_name), '-', '_')) src, min(trust_rank) trust_rank from annot_sources group by 1),
m as (select group_id, {_ID.format('f.id')} id, f.file_order, f.loaded_at, s.trust_rank, f.attributes
  from features f join comp on {_ID.format('f.id')} = comp.id join head using (comp) left join s on lower(replace(trim(f.source), '-', '_')) = s.src),
x as (select m.*, k.k as attr_key, v.v from m, (select unnest(['Name', 'biotype', 'product', 'Note']) k) k,
  lateral (select unnest(m.attributes[k.k]) v) v
  where v.v is not null and lower(trim(v.v)) not in ({", ".join("'" + x + "'" for x in survivor.STAND_INS)})),
r as (select *, row_number() over (partition by group_id, attr_key order by loaded_at desc nulls last, trust_rank asc nulls last, file_order desc) rn from x)
select group_id, attr_key, v as attr_value from r where rn = 1 and group_id in (select group_id from m group by 1 having count(distinct id) >= 2)""",
}
