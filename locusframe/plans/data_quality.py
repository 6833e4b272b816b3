"""Queries p1, p2 and p4-p7: data quality over the annotation store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.functions.text import norm_id, norm_id_or_null
from locusframe.operators import annotation_rules as rules
from locusframe.operators import badrows, hierarchy, multivalue, orphans, profile, spans
from locusframe.session import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.relation_orphans(table(spark, d, "relations"), table(spark, d, "features"), table(spark, d, "removals"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, month and reason."""
    return orphans.orphan_report(p1_found(spark, d), "relations")


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of source and feature type that no row of the first three loads has, in whole or
    in the part that is not null, per month, null mask and reason."""
    rows = table(spark, d, "features").select("source", "featuretype", F.col("loaded_at").alias("at"), "load_id")
    keys = rows.filter("load_id <= 3").drop("load_id")
    out = orphans.orphan_references(rows.drop("load_id"), ["source", "featuretype"], "at", keys, ["source", "featuretype"], "at", match="partial")
    mask = F.concat(F.when(F.col("source").isNull(), "-").otherwise("s"), F.when(F.col("featuretype").isNull(), "-").otherwise("t"))
    return out.groupBy(F.date_format("at", "yyyy-MM").alias("load_month"), mask.alias("null_mask"), "reason").agg(F.count(F.lit(1)).alias("n_rows"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.explode_packed(table(spark, d, "features"), "attributes", ["Alias", "Dbxref", "Ontology_term"], "file_order")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "features").select(norm_id("seqid").alias("seqid"), "start", "end").filter("seqid <> '.'")
    return spans.spans_and_gaps(rows, "seqid", "start", "end", 1_000_000)


def _store(spark: SparkSession, d: str) -> tuple[DataFrame, profile.ValueCounts]:
    """The features and their maintained counts: a signed delta for every load."""
    features = table(spark, d, "features")
    return features, profile.ValueCounts(spark).apply(features, rules.PROFILED, "load_id", name="loads")


def _judged(spark: SparkSession, d: str, store: profile.ValueCounts) -> DataFrame:
    return cut(rules.judged(store.counts(), table(spark, d, "feature_terms")), "value-counts")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    features, store = _store(spark, d)
    counts = _judged(spark, d, store)
    cells = profile.bad_cells(features, "file_order", rules.PROFILED, counts)
    loads = profile.shifted_loads(counts, rules.missing, ["strand", "frame", "featuretype"], "score")
    values = cells.select(F.lit("value").alias("kind"), "column_name", F.col("file_order").alias("row_key"))
    return values.unionByName(loads.select(F.lit("load").alias("kind"), "column_name", F.col("load_id").cast("bigint").alias("row_key")))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """One profile row per column."""
    return profile.profile(_judged(spark, d, _store(spark, d)[1]), rules.missing)


def p5_taken_back(spark: SparkSession, d: str) -> DataFrame:
    """The profile once the newest load is taken back out of the maintained counts."""
    _, store = _store(spark, d)
    newest = store.log().agg(F.max("load_id")).first()[0]
    return profile.profile(_judged(spark, d, store if newest is None else store.take_back(newest)), rules.missing)


def _forest(spark: SparkSession, d: str) -> hierarchy.Forest:
    rows = table(spark, d, "relations").filter("level = 1")
    rows = rows.select(norm_id_or_null("parent").alias("parent"), norm_id_or_null("child").alias("child"))
    return hierarchy.decompose(rows, "parent", "child")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.hierarchy_rows(_forest(spark, d))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every node's full path from each of its roots, with its depth below it."""
    return hierarchy.tree_paths(_forest(spark, d))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every node."""
    f = _forest(spark, d)
    return hierarchy.descendants(f, f.nodes.select("node"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejected_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files")).select("line_no", "reason")


def p7_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The lines that load, as feature rows."""
    rows = badrows.loaded_lines(table(spark, d, "raw_lines"), table(spark, d, "raw_files"))
    return rows.withColumn("extra", F.concat_ws("|", "extra")).drop("attribute_map")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_report, p1_composite, p2_found, p4_found, p5_found, p5_profile, p5_taken_back, p6_found, p6_paths, p6_descendants, p7_found, p7_loaded)
}

_ID = "lower(trim({0}, ' ' || chr(9) || chr(10) || chr(13)))"
_NUM = "regexp_full_match({0}, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')"

_P1 = f"""
with f as (select {_ID.format('id')} k, min(loaded_at) first_at, max(loaded_at) last_at from features group by 1),
g as (select {_ID.format('feature_id')} k, max(removed_at) gone from removals group by 1),
r as (select edge_id, loaded_at, {_ID.format('parent')} k from relations),
x as (select edge_id, strftime(r.loaded_at, '%Y-%m') load_month,
  case when f.k is null then 'missing' when gone > last_at then 'deleted' when first_at > r.loaded_at then 'late' end reason
  from r left join f on r.k = f.k left join g on r.k = g.k where r.k is not null and r.k <> '')
"""
_SPANS = f"""
with f as (select {_ID.format('seqid')} seqid, "start"::bigint s, "end"::bigint e from features where "start" <= "end"),
m as (select *, max(e) over (partition by seqid order by s, e rows between unbounded preceding and 1 preceding) pe from f where seqid <> '.'),
g as (select *, sum(case when pe is null or s > pe + 1 then 1 else 0 end) over (partition by seqid order by s, e rows unbounded preceding) g from m),
sp as (select seqid, min(s) a, max(e) b from g group by seqid, g),
nx as (select *, lead(a) over (partition by seqid order by a) n from sp)
select seqid, 'merged' as kind, a as span_start, b as span_end from nx
union all select seqid, 'gap', b + 1, n - 1 from nx where n is not null and n - b - 1 <= 1000000
"""
_CELLS = " union all ".join(f"select '{c}' column_name, file_order, load_id, {c} v from features" for c in rules.PROFILED)
_VALID = f"""case column_name
 when 'score' then v = '.' or (case when {_NUM.format('v')} then coalesce(try_cast(v as double) between 0 and 1000, false) else false end)
 when 'strand' then v in ('+', '-', '.', '?') when 'frame' then v in ('0', '1', '2', '.')
 else v in (select featuretype from feature_terms where featuretype is not null) end"""
_P5 = f"""
with cells as ({_CELLS}),
n as (select column_name, load_id, count(*) n, count(*) filter (where v is null or v = '.') m from cells where load_id is not null group by 1, 2),
vals as (select column_name, load_id, v, count(*) k from cells where v is not null and column_name <> 'score' group by 1, 2, 3),
pairs as (select column_name, v, load_id from vals union select column_name, v, load_id + 1 from vals),
med as (select load_id, median(v::double) x from (select load_id, v from cells where column_name = 'score' and {_NUM.format('v')}) where v::double between 0 and 1000 group by 1),
moved as (
 select a.column_name, a.load_id from n a join n b on a.column_name = b.column_name and a.load_id = b.load_id + 1
  where abs(a.m * b.n - b.m * a.n) > 0.2 * a.n * b.n
 union select p.column_name, p.load_id from pairs p join n a on p.column_name = a.column_name and p.load_id = a.load_id
  join n b on p.column_name = b.column_name and p.load_id = b.load_id + 1
  left join vals va on va.column_name = p.column_name and va.v = p.v and va.load_id = p.load_id
  left join vals vb on vb.column_name = p.column_name and vb.v = p.v and vb.load_id = p.load_id - 1
  where abs(coalesce(va.k, 0) * b.n - coalesce(vb.k, 0) * a.n) > 0.2 * a.n * b.n
 union select 'score', a.load_id from med a join med b on a.load_id = b.load_id + 1 where greatest(a.x, b.x) > 5 * least(a.x, b.x))
select 'value' as kind, column_name, file_order as row_key from cells where v is not null and not ({_VALID})
union all select 'load', column_name, load_id::bigint from moved
"""
_PROFILE = f"""
t as (select column_name, v, sum(k) n from kept group by 1, 2),
s as (select column_name, sum(n) n_rows, coalesce(sum(n) filter (where v is null), 0) n_null, coalesce(sum(n) filter (where v is null or v = '.'), 0) n_missing,
 count(v) n_distinct, min(case when {_NUM.format('v')} then try_cast(v as double) end) least_number, max(case when {_NUM.format('v')} then try_cast(v as double) end) greatest_number,
 min(v) least_text, max(v) greatest_text, coalesce(sum(n) filter (where v is not null and not ({_VALID})), 0) n_invalid,
 sum(n * log2(n)) filter (where v is not null) nlogn from t group by 1)
select column_name, n_rows::bigint as n_rows, n_null::bigint as n_null, n_missing::bigint as n_missing, n_distinct::bigint as n_distinct, least_number, greatest_number, least_text, greatest_text,
 n_invalid::bigint as n_invalid, case when n_rows > n_null then round(log2((n_rows - n_null)::double) - nlogn / (n_rows - n_null), 6) end as entropy, n_null / n_rows as null_rate from s
"""

_P7 = f"""
with d as (select line_no, file_no, regexp_replace(line, '\\r$', '') c from raw_lines),
s as (select line_no, file_no, string_split(c, chr(9)) x, n_columns n from d left join raw_files using (file_no) where regexp_matches(c, '\\S') and c not like '#%'),
t as (select line_no, file_no, x, case when n is null or len(x) <> n then 'columns'
 when not regexp_full_match(x[9], '([^"]*[= ]"[^"]*" *;)*([^"]*|[^"]*[= ]"[^"]*" *)') then 'quoting'
 when (x[4] <> '.' and not (regexp_full_match(x[4], '[0-9]+') and coalesce(try_cast(x[4] as hugeint) <= 2147483647, false)))
  or (x[5] <> '.' and not (regexp_full_match(x[5], '[0-9]+') and coalesce(try_cast(x[5] as hugeint) <= 2147483647, false)))
  or coalesce(try_cast(x[4] as hugeint) > try_cast(x[5] as hugeint), false)
  or not (x[6] = '.' or {_NUM.format('x[6]')}) or x[7] not in ('+', '-', '.', '?') or x[8] not in ('0', '1', '2', '.')
  or len(list_filter(x[10:], lambda y: not regexp_full_match(y, '[^:]*[^: ][^:]*:.*[^ ].*'))) > 0 then 'value' end reason from s)
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1 + "select edge_id, load_month, reason from x where reason is not null",
    "p1_report": _P1 + "select 'relations' as table_name, load_month, reason, count(*) as n_rows from x where reason is not null group by 2, 3",
    "p1_composite": """
with k as (select source s, featuretype t, loaded_at a from features where load_id <= 3),
b as (select s, t, min(a) a from k where s is not null and t is not null group by 1, 2),
ks as (select s, min(a) a from k where s is not null group by 1), kt as (select t, min(a) a from k where t is not null group by 1),
r as (select source s, featuretype t, loaded_at a from features where source is not null or featuretype is not null),
x as (select r.a, case when r.s is null then '-' else 's' end || case when r.t is null then '-' else 't' end m,
  case when r.s is null then kt.t is not null when r.t is null then ks.s is not null else b.s is not null end there,
  case when r.s is null then kt.a when r.t is null then ks.a else b.a end first_at
  from r left join b on r.s = b.s and r.t = b.t left join ks on r.s = ks.s left join kt on r.t = kt.t)
select strftime(a, '%Y-%m') as load_month, m as null_mask, case when not there then 'missing' else 'late' end as reason, count(*) as n_rows
from x where not there or coalesce(first_at > a, false) group by 1, 2, 3""",
    "p4_found": _SPANS,
    "p5_found": _P5,
    "p5_profile": f"with cells as ({_CELLS}), kept as (select column_name, v, count(*) k from cells group by 1, 2)," + _PROFILE,
    "p5_taken_back": f"with cells as ({_CELLS}), kept as (select column_name, v, count(*) k from cells where load_id is null or load_id < (select max(load_id) from cells) group by 1, 2)," + _PROFILE,
    "p6_found": f"""
with recursive e as (select distinct {_ID.format('parent')} p, {_ID.format('child')} c from relations where level = 1 and {_ID.format('parent')} <> '' and {_ID.format('child')} <> ''),
g as (select p, c from e where p <> c),
inner_g as (select g.p, g.c from g where c in (select p from g) and p in (select c from g)),
reach(a, b) as (select p, c from inner_g union select r.a, i.c from reach r join inner_g i on r.b = i.p),
lp as (select x.a as node, min(y.b) as loop_id from (select a from reach where a = b) x join reach y on x.a = y.a join reach z on z.a = y.b and z.b = y.a group by 1),
roots as (select p as node from e where p not in (select c from g) union select c from e where p = c and c not in (select c from g)),
walk(node, root, d) as (select node, node, 0 from roots union select g.c, w.root, w.d + 1 from walk w join g on g.p = w.node where g.c not in (select node from lp))
select node, root, d::int as node_depth from walk
union all select node, loop_id, -1 from lp
union all select p, p, -1 from e where p = c and p not in (select node from lp)""",
    "p7_found": _P7 + "select line_no, reason from t where reason is not null",
    "p7_loaded": _P7 + """select line_no, file_no, x[1] as seqid, x[2] as source, x[3] as featuretype, try_cast(x[4] as int) as "start", try_cast(x[5] as int) as "end",
  x[6] as score, x[7] as strand, x[8] as frame, x[9] as attributes, array_to_string(x[10:], '|') as extra from t where reason is null""",
    "p2_found": """
with k as (select file_order, unnest(['Alias', 'Dbxref', 'Ontology_term']) attr_key, attributes from features),
a as (select file_order, attr_key, attributes[attr_key] x from k where attributes[attr_key] is not null),
e as (select file_order, attr_key, unnest(x) v, generate_subscripts(x, 1) i from a),
p as (select file_order, attr_key, i, list_filter(list_transform(
  regexp_extract_all(v || ',', '(\\s*"(?:[^"]|"")*"\\s*|[^,;|]*)[,;|]', 1), lambda y: trim(y, ' ' || chr(9))), lambda y: y <> '' and y <> '""') l from e),
h as (select file_order, attr_key from p group by 1, 2 having max(len(l)) > 1),
f as (select file_order, attr_key, i, unnest(l) y, generate_subscripts(l, 1) j from p join h using (file_order, attr_key))
select file_order, attr_key, (row_number() over (partition by file_order, attr_key order by i, j))::int as pos,
 case when y like '"%"' and len(y) > 1 then replace(y[2:-2], '""', '"') else y end as attr_value from f""",
}
