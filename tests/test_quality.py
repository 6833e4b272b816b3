"""p1-p5 and p7 on small cases: nulls, blanks, ties, repeats, empty tables, odd columns."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from compare import rows
from pyspark.sql import functions as F

from locusframe.operators import annotation_rules as rules
from locusframe.operators import badrows, multivalue, orphans, profile, spans
from locusframe.operators.sequence import number_rows
from locusframe.operators.skew import salted_join

T = lambda d: datetime(2023, 1, d)
REL = "parent string, child string, level int, edge_id bigint, loaded_at timestamp, id string"
FEA = "id string, loaded_at timestamp, parent string"
REM = "feature_id string, removed_at timestamp"


def test_orphans_reasons_and_edge_cases(spark):
    rel = spark.createDataFrame(
        [(" A\t", "x", 1, 1, T(5), "z"), ("b", "x", 1, 2, T(5), None), ("c", "x", 2, 3, T(5), None), ("d", "x", None, 4, T(5), None), (None, "x", 1, 5, T(5), None), ("  ", "x", 1, 6, T(5), None), ("gone", None, 1, 7, T(5), None), ("gone", None, 1, 8, T(5), None), ("c", "x", 1, 9, None, None)], REL
    )
    fea = spark.createDataFrame([("a", T(1), None), ("b", T(1), None), ("b", T(3), None), ("c", T(9), None), ("d", T(1), None), (None, T(1), None)], FEA)
    rem = spark.createDataFrame([("B ", T(2)), ("d", T(2)), ("d", T(4)), (None, T(9))], REM)
    assert rows(orphans.relation_orphans(rel, fea, rem)) == [(3, "2023-01", "late"), (4, "2023-01", "deleted"), (7, "2023-01", "missing"), (8, "2023-01", "missing")]
    assert rows(orphans.relation_orphans(rel.limit(0), fea, rem)) == []
    assert len(rows(orphans.relation_orphans(rel, fea.limit(0), rem.limit(0)))) == 7
    report = orphans.orphan_report(orphans.relation_orphans(rel, fea, rem), "relations")
    assert ("relations", "2023-01", "missing", 2) in rows(report)


@pytest.mark.parametrize("match,want", [("simple", [(2,)]), ("full", [(2,), (3,), (4,)]), ("partial", [(2,), (4,)])])
def test_composite_keys_follow_the_match_rule(spark, match, want):
    refs = spark.createDataFrame([(1, "a", "x", T(5)), (2, "a", "q", T(5)), (3, "a", None, T(5)), (4, None, "z", T(5)), (5, None, None, T(5))], "n int, k1 string, k2 string, at timestamp")
    keys = spark.createDataFrame([("a", "x", T(1)), ("b", "y", T(1))], "p string, q string, at timestamp")
    assert rows(orphans.orphan_references(refs, ["k1", "k2"], "at", keys, ["p", "q"], "at", match=match), "n") == want


def test_salted_join_spreads_and_keeps_every_row(spark):
    probe = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 1), (None, 2), ("none", 3)], "k string, v int")
    build = spark.createDataFrame([("hot", 500, "h"), ("cold", 1, "c")], "k string, n bigint, x string")
    out = salted_join(probe, build, "k", "n", "left", ["v"], rows_per_salt=50)
    assert out.count() == 503 and out.filter("x = 'h'").count() == 500 and out.filter("x is null").count() == 2


CASES = ["a,b", ' "x, y" ; z', '"a ""b"" c"|d', "one", "", None, ",;|", '"only, one"', "a0,b", '5" end,3" x', 'a"b,c"', '"open, b', '"",a,b', "ä|ö ;  ü", '"a","b"', "\ta\t,\tb\t", "%2C,x"]


def test_split_packed(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    from pyspark.sql import functions as F

    got = {r["i"]: r["v"] for r in df.select("i", multivalue.split_packed(F.col("t")).alias("v")).collect()}
    want = [["a", "b"], ["x, y", "z"], ['a "b" c', "d"], ["one"], [], [], [], ["only, one"], ["a0", "b"], ['5" end', '3" x'], ['a"b', 'c"'], ['"open', "b"], ["a", "b"], ["ä", "ö", "ü"], ["a", "b"], ["a", "b"], ["%2C", "x"]]
    assert [got[i] for i in range(len(CASES))] == want


def test_split_packed_on_random_quoted_lists(spark):
    random.seed(1)
    texts = []
    for _ in range(300):
        vals = ["".join(random.choice('ab ,;|"') for _ in range(random.randint(1, 6))).strip(' "') or "v" for _ in range(random.randint(1, 4))]
        texts.append((vals, random.choice([",", ";", " | ", ", "]).join('"' + v.replace('"', '""') + '"' for v in vals)))
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", multivalue.split_packed(F.col("t")).alias("v")).collect()}
    assert all(got[i] == v for i, (v, _) in enumerate(texts))


def test_split_packed_after_any_number_of_blanks(spark):
    df = spark.createDataFrame([(0, "x," + " " * 120 + '"a,b"'), (1, '\u00a0"a;b"\u2003|c'), (2, '\ue000q\ue001,"\ue000,"')], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", multivalue.split_packed(F.col("t")).alias("v")).collect()}
    assert got == {0: ["x", "a,b"], 1: ["a;b", "c"], 2: ["\ue000q\ue001", "\ue000,"]}


def test_explode_packed_whole_arrays_only_where_packed(spark):
    df = spark.createDataFrame([(1, {"A": ["x", "y,z"], "B": ["q"]}), (2, {"A": ["x", "y"]}), (3, None), (4, {"A": []}), (5, {"A": [None, "u;v"]}), (6, {"A": ['"k,l"']})], "file_order bigint, attributes map<string,array<string>>")
    out = multivalue.explode_packed(df, "attributes", ["A", "B"], "file_order")
    assert rows(out) == [(1, "A", 1, "x"), (1, "A", 2, "y"), (1, "A", 3, "z"), (5, "A", 1, "u"), (5, "A", 2, "v")]
    assert multivalue.explode_packed(df.limit(0), "attributes", ["A"], "file_order").count() == 0


def brute_spans(data):
    out = []
    for k in {k for k, _, _ in data if k}:
        iv = sorted((s, e) for kk, s, e in data if kk == k and s is not None and e is not None and s <= e)
        cur = None
        for s, e in iv:
            if cur and s <= cur[1] + 1:
                cur[1] = max(cur[1], e)
            else:
                cur = [s, e]
                out.append((k, cur))
    return sorted(((k, a, b) for k, (a, b) in out), key=repr)


@pytest.mark.parametrize("tile", [4, 50, 1 << 17])
def test_spans_random(spark, tile):
    random.seed(tile)
    data = [(random.choice(["a", "b", None]), s, s + random.choice([-1, 0, 0, 1, 3, 40])) for s in [random.randint(-5, 300) for _ in range(120)]] + [("a", None, 5), ("b", 5, None), ("c", 7, 7), ("c", 7, 7)]
    df = spark.createDataFrame(data, "k string, s int, e int")
    assert rows(spans.merged_spans(df, "k", "s", "e", tile), "k", "span_start", "span_end") == brute_spans(data)
    both = spans.spans_and_gaps(df, "k", "s", "e", 10, tile).filter("kind = 'gap'").collect()
    assert all(r["span_end"] - r["span_start"] < 10 and r["span_start"] <= r["span_end"] for r in both)


def test_profile_deltas_and_shifts(spark):
    sch = "score string, strand string, frame string, featuretype string, load_id int, file_order bigint"
    one = [("5.0", "+", "0", "gene", 1, i) for i in range(10)]
    two = [("50", "-", "0", "gene", 2, 10 + i) for i in range(9)] + [("x", "F", "3", "Gene", 2, 19)]
    df = spark.createDataFrame(one + two + [(None, None, None, None, None, 20)], sch)
    terms = spark.createDataFrame([("gene",), (None,)], "featuretype string")
    judged = lambda: rules.judged(store.counts(), terms)
    store = profile.ValueCounts(spark).apply(df, rules.PROFILED, "load_id", name="first")
    store.apply(df, rules.PROFILED, "load_id", name="first")  # replayed: counts once
    bad = profile.bad_cells(df, "file_order", rules.PROFILED, judged())
    assert rows(bad) == [("featuretype", 19), ("frame", 19), ("score", 19), ("strand", 19)]
    loads = profile.shifted_loads(judged(), rules.missing, ["strand", "frame", "featuretype"], "score")
    assert rows(loads) == [("score", 2), ("strand", 2)]
    again = profile.ValueCounts(spark, store.path)  # the store goes on where it was left
    again.take_back(2).compact()
    assert store.counts().filter("load_id = 2").count() == 0
    again.apply(df.filter("load_id = 2"), rules.PROFILED, "load_id").apply(df.filter("load_id = 2"), rules.PROFILED, "load_id", -1)
    p = {r["column_name"]: r for r in profile.profile(judged(), rules.missing).collect()}
    assert p["score"]["n_rows"] == 11 and p["score"]["n_null"] == 1 and p["score"]["entropy"] == 0 and p["score"]["n_distinct"] == 1
    assert profile.profile(judged().limit(0), rules.missing).count() == 0


def test_more_feature_types_than_a_plan_can_hold(spark):
    terms = spark.range(100_001).select(F.concat(F.lit("type"), F.col("id").cast("string")).alias("featuretype"))
    counts = spark.createDataFrame([("featuretype", "type100000", 1), ("featuretype", "Type1", 1), ("featuretype", None, 1), ("strand", "type1", 1)], "column_name string, value string, n bigint")
    assert rows(rules.judged(counts, terms), "value", "valid") == [("Type1", False), ("type1", False), ("type100000", True), (None, True)]


def test_weighted_median(spark):
    random.seed(3)
    data = [(random.randint(0, 2), round(random.gauss(0, 9), 2), random.randint(1, 4)) for _ in range(200)]
    df = spark.createDataFrame(data, "g int, x double, n bigint").groupBy("g", "x").sum("n").withColumnRenamed("sum(n)", "n")
    import statistics

    for g, m in rows(profile.weighted_median(df, ["g"], "x", "n"), "g", "median"):
        assert m == pytest.approx(statistics.median([x for gg, x, n in data if gg == g for _ in range(n)]))


LINES = [
    ("s\tx\tgene\t1\t5\t.\t+\t.\tID=a;Note=\"b; c\"", None), ("s\tx\tgene\t1\t5\t.\t+\t.", "columns"), ("s\tx\tgene\t1\t5\t.\t+\t.\tID=a\"b", "quoting"), ("s\tx\tgene\t1\t5\t.\t+\t.\tID=\"a", "quoting"),
    ("s\tx\tgene\t5\t1\t.\t+\t.\tID=a", "value"), ("s\tx\tgene\t1\t５\t.\t+\t.\tID=a", "value"), ("s\tx\tgene\t1\t2147483648\t.\t+\t.\tID=a", "value"), ("s\tx\tgene\t.\t.\t1e3\t?\t2\tg \"a\" ; t \"b\" ", None),
    ("s\tx\tgene\t1\t5\tNaN\t+\t.\tID=a", "value"), ("# note", "skip"), ("  ", "skip"), ("s\tx\tgene\t1\t5\t.\t+\t.\tID=a\r", None), (None, "skip"), ("s\tx\tgene\t1\t5\t.\t+\t.\tt \"a;\" u \"b\"", "quoting"), ("s\tx\tgene\t1\t5\t.\t+\t.\t\"a\"", "quoting"), ("", "skip"), ("x" * 100_000, "columns"),
]


def test_bad_rows(spark):
    lines = spark.createDataFrame([(i, 1, t) for i, (t, _) in enumerate(LINES)] + [(99, 7, "a\tb"), (100, 2, LINES[0][0] + "\tk:v\t:v"), (101, 2, LINES[0][0] + "\tk:v\tk:v:w")], "line_no bigint, file_no int, line string")
    files = spark.createDataFrame([(1, "gff3", 9), (2, "gff3", 11)], "file_no int, format_name string, n_columns int")
    got = {r["line_no"]: r["reason"] for r in badrows.rejected_lines(lines, files).collect()}
    want = {i: w for i, (_, w) in enumerate(LINES) if w not in (None, "skip")} | {99: "columns", 100: "value"}
    assert got == want
    assert {r["line_no"] for r in badrows.loaded_lines(lines, files).collect()} == {i for i, (_, w) in enumerate(LINES) if w is None} | {101}
    assert badrows.rejected_lines(lines.limit(0), files).count() == 0
    maps = {r["line_no"]: r["attribute_map"] for r in badrows.loaded_lines(lines, files).collect()}
    assert maps[0] == {"ID": ["a"], "Note": ["b; c"]} and maps[7] == {"g": ["a"], "t": ["b"]}


def well_formed(line, n):
    """What the native expressions decide, by scanning."""
    c = line.split("\t")
    if len(c) != n:
        return False
    a, inside = c[8], False
    for i, ch in enumerate(a):
        if ch == '"' and not inside:
            if i == 0 or a[i - 1] not in "= ":
                return False
            inside = True
        elif ch == '"':
            rest = a[i + 1 :].lstrip(" ")
            if rest and rest[0] != ";":
                return False
            inside = False
    return not inside


def test_error_parse_costs_nothing_exactly_for_well_formed_lines():
    random.seed(5)
    for _ in range(800):
        attrs = "".join(random.choice('a"=; \t' if random.random() < 0.1 else 'a"=; ') for _ in range(random.randint(0, 9)))
        line = "\t".join("x" * 8) + "\t" + attrs
        cost, edits = badrows.error_parse(line, 9)
        assert (cost == 0) == well_formed(line, 9) == (not edits), line
        tabs = [e for e in edits if "tab" in e]
        assert len(tabs) == abs(line.count("\t") - 8), line


def test_error_parse_is_minimal():
    """Against a search over all single and double edits."""
    random.seed(6)
    for _ in range(60):
        attrs = "".join(random.choice('a"=; ') for _ in range(6))
        line = "\t".join("x" * 8) + "\t" + attrs
        cost, _ = badrows.error_parse(line, 9)

        def edits(t):
            for i in range(16, len(t) + 1):
                if i < len(t) and t[i] == '"':
                    yield t[:i] + t[i + 1 :]
                yield t[:i] + '"' + t[i:]

        level, seen = {line}, 0
        while not any(well_formed(t, 9) for t in level) and seen < 3:
            level, seen = {u for t in level for u in edits(t)}, seen + 1
        if seen < 3:
            assert cost == seen, line


def test_number_rows_across_blocks(spark):
    df = spark.createDataFrame([(k, i) for i in range(50) for k in ("a", None)], "k string, o bigint")
    out = number_rows(df, ["k"], "o", "n", block=7)
    assert all(n == o + 1 for _, o, n in rows(out)) and out.count() == 100
