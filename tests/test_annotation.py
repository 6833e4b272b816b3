"""The annotation engine on hand-written lines: parsing, ids, hierarchy, derivation, output."""

from __future__ import annotations

import pytest
from compare import rows
from pyspark.sql import functions as F

from locusframe.functions import attributes as A
from locusframe.functions.bins import bin_of, bins_overlapping
from locusframe.operators import aggregate, derive, ingest, merge, query, relate
from locusframe.sinks import export
from locusframe.sources import gff
from locusframe.store import AnnotationStore

GFF = """##gff-version 3
##sequence-region c1 1 9000
# a comment
c1\tx\tgene\t1000\t5000\t.\t+\t.\tID=g1;Name=alpha
c1\tx\tmRNA\t1000\t5000\t.\t+\t.\tID=m1;Parent=g1
c1\tx\tmRNA\t1000\t4000\t.\t+\t.\tID=m2;Parent=g1
c1\tx\texon\t1000\t1500\t.\t+\t.\tID=e1;Parent=m1,m2
c1\tx\texon\t2000\t2500\t.\t+\t.\tID=e2;Parent=m1,m2
c1\tx\texon\t4500\t5000\t.\t+\t.\tID=e3;Parent=m1
c1\tx\texon\t3000\t4000\t.\t+\t.\tID=e4;Parent=m2
c1\tx\tCDS\t1200\t1500\t.\t+\t0\tParent=m1;Note=a%2Cb,c+d

c2\tx\tgene\t.\t.\t.\t-\t.\tID=g2
##FASTA
>c1
ACGT
"""
GTF = """c1\tx\texon\t10\t20\t.\t-\t.\tgene_id "G"; transcript_id "T1"; tag "a"; tag "b";
c1\tx\texon\t40\t50\t.\t-\t.\tgene_id "G"; transcript_id "T1";
c1\tx\texon\t5\t8\t.\t-\t.\tgene_id "G"; transcript_id "T2";
"""


@pytest.fixture(scope="module")
def store(spark):
    return AnnotationStore.create(spark, GFF, from_string=True)


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_store_contents(spark, store):
    assert store.count_features_of_type("exon") == 4 and store.count_features_of_type() == 9
    assert [r["directive"] for r in store.directives.orderBy("line_no").collect()] == ["gff-version 3", "sequence-region c1 1 9000"]
    assert ids(store.features_of_type("CDS")) == ["CDS_1"]
    note = store["CDS_1"].first()["attributes"]["Note"]
    assert note == ["a,b", "c+d"]
    assert ids(store.children("g1", 1)) == ["m1", "m2"] and ids(store.children("g1", featuretype="exon")) == ["e1", "e2", "e3", "e4"]
    assert ids(store.parents("e1", 2)) == ["g1"] and ids(store.parents("e1", 1)) == ["m1", "m2"] and ids(store.children("none")) == []
    assert rows(store.units(), "unit_id", "id")[0] == ("g1", "CDS_1") and store.units().count() == 9
    with pytest.raises(query.FeatureNotFound):
        store["nothing"]
    with pytest.raises(ingest.EmptyInput):
        AnnotationStore.create(spark, "# nothing", from_string=True)
    with pytest.raises(ValueError):
        gff.lines_of(spark, "/no/such/file.gff")


def test_regions(store):
    assert ids(store.region("c1:2500-3000")) == ["e2", "e4", "g1", "m1", "m2"]
    assert ids(store.region(seqid="c1", start=4500, featuretype="exon")) == ["e3"]
    assert ids(store.region(seqid="c1", start=5000)) == [] and ids(store.region(seqid="c1", end=1000)) == []
    assert ids(store.region("c1:1000-1500", completely_within=True)) == ["CDS_1", "e1"]
    assert ids(store.region("c1:3000-2500")) == ids(store.region("c1:2500-3000")) and store.region().count() == 9
    with pytest.raises(ValueError):
        store.region("c1", start=4)
    assert [r["id"] for r in store.all_features(featuretype="exon", order_by=("seqid", "length"), reverse=True).collect()][0] == "e4"
    with pytest.raises(ValueError):
        query.order(store.features, "colour")
    assert ids(store.attribute_search("ALPHA")) == ["g1"]
    assert store.execute("select count(*) n from relations where level = 2").first()["n"] == 5


def test_derivation(store):
    got = rows(store.introns(), "transcript_id", "start", "end")
    assert got == [("m1", 1501, 1999), ("m1", 2501, 4499), ("m2", 1501, 1999), ("m2", 2501, 2999)]
    sites = store.splice_sites().filter("transcript_id = 'm2' and start < 2000")
    assert rows(sites, "featuretype", "start", "end") == [("five_prime_cis_splice_site", 1501, 1502), ("three_prime_cis_splice_site", 1998, 1999)]
    assert store.introns().filter("start = 1501").first()["attributes"]["ID"] == ["e1-e2"]
    assert rows(store.start_sites(), "name", "start") == [("m1", 1000), ("m2", 1000)]
    assert rows(store.start_sites(distance=10), "name", "n") == [("m1,m2", 2)]
    assert dict(rows(store.children_bp(parent_type="mRNA", level=1))) == {"m1": 1503, "m2": 2003}
    assert rows(relate.constitutive(store.features, store.relations)) == [("g1", "e1"), ("g1", "e2")]
    best = rows(aggregate.canonical_children(store.features, store.relations))
    assert best == [("g1", "m1", 301, 1503)]
    with pytest.raises(ValueError):
        derive.introns(store.features, store.relations, parent="mRNA")


def test_bed12_and_lines(spark, store):
    line = export.bed12(store.features, store.relations, "mRNA").filter("id = 'm1'").first()["line"]
    assert line == "c1\t999\t5000\tm1\t0\t+\t1199\t1500\t0,0,0\t3\t501,501,501\t0,1000,3500"
    text = {r["id"]: r["line"] for r in export.gff_lines(store.features, store.dialect).collect()}
    assert text["e1"] == "c1\tx\texon\t1000\t1500\t.\t+\t.\tID=e1;Parent=m1,m2" and text["CDS_1"].endswith("Note=a%2Cb,c+d") and text["g2"].split("\t")[3] == "."
    with pytest.raises(ValueError):
        export.bed12(store.features, store.relations, "mRNA", thick="CDS", thin="UTR")
    order = [r["id"] for r in export.gene_records(store.features, store.relations).orderBy("gene_id", "sort_key").collect()]
    assert order[:5] == ["g1", "m2", "e1", "e2", "e4"]


def test_update_delete_save_open(spark, store, tmp_path):
    more = store.update("c1\ty\texon\t6000\t6100\t.\t+\t.\tParent=m1\nc1\ty\tCDS\t6000\t6100\t.\t+\t.\tParent=m1", from_string=True)
    assert {"exon_1", "CDS_2"} <= set(ids(more.features)) and "exon_1" in ids(more.children("g1", 2))
    with pytest.raises(ingest.DuplicateId):
        store.update("c1\ty\texon\t1\t2\t.\t+\t.\tID=e1", from_string=True)
    less = more.delete(["e1", "nobody"])
    assert "e1" not in ids(less.features) and less.relations.filter("child = 'e1' or parent = 'e1'").count() == 0
    path = "file://" + str(tmp_path / "s")
    assert less.save(path) == 1 and more.save(path) == 2
    assert AnnotationStore.open(spark, path).features.count() == more.features.count()
    assert AnnotationStore.open(spark, path, 1).features.count() == less.features.count()
    again = AnnotationStore.open(spark, path)
    assert again.dialect == store.dialect
    with pytest.raises(ValueError):
        AnnotationStore.open(spark, path + "x")
    assert store.add_relation("g2", "e1", 1).children("g2", 1).count() == 1
    from locusframe.cli import main

    main(["children", path, "m2"], spark)


def test_gtf(spark):
    s = AnnotationStore.create(spark, GTF, from_string=True)
    f = {r["id"]: r for r in s.features.collect()}
    assert (f["G"]["start"], f["G"]["end"], f["T1"]["start"], f["T1"]["end"], f["T2"]["strand"]) == (5, 50, 10, 50, "-")
    assert s.dialect.fmt == "gtf" and f["exon_1"]["attributes"]["tag"] == ["a", "b"]
    assert ids(s.children("G", 1)) == ["T1", "T2"] and s.children("G", 2).count() == 3
    assert AnnotationStore.create(spark, GTF, from_string=True, infer_genes=False, infer_transcripts=False).features.count() == 3


def test_strategies(spark):
    two = "c\ts\ta\t1\t5\t.\t+\t.\tID=x;k=1\nc\ts\ta\t1\t5\t.\t+\t.\tID=x;k=2\nc\ts\ta\t7\t9\t.\t+\t.\tID=x\n"
    make = lambda how, **kw: AnnotationStore.create(spark, two, from_string=True, merge_strategy=how, **kw)
    with pytest.raises(ingest.DuplicateId):
        make("error")
    assert make("warning").features.first()["attributes"]["k"] == ["1"]
    assert make("replace").features.first()["start"] == 7
    assert ids(make("create_unique").features) == ["x", "x_1", "x_2"]
    m = make("merge")
    assert ids(m.features) == ["x", "x_1"] and rows(m.duplicates) == [("x", "x_1")] and m["x"].first()["attributes"]["k"] == ["1", "2"]
    with pytest.raises(ValueError):
        make("merge", force_merge_fields=["start"])


GOLDEN = [
    ("ID=a;Name=b", {"ID": ["a"], "Name": ["b"]}, "gff3"), ('gene_id "a"; tag "x"; tag "y";', {"gene_id": ["a"], "tag": ["x", "y"]}, "gtf"), ("ID=a;flag;Parent=x,y;", {"ID": ["a"], "flag": [], "Parent": ["x", "y"]}, "gff3"), ("ID=;Note=k=v,", {"ID": [""], "Note": ["k=v", ""]}, "gff3"), ('Gene "a" ; Note "p; q"', {"Gene": ["a"], "Note": ["p; q"]}, "gtf"), ("", {}, "gff3"),
]


@pytest.mark.parametrize("text,want,fmt", GOLDEN)
def test_dialects(text, want, fmt):
    got, dialect = A.split_attributes(text)
    assert got == want and dialect.fmt == fmt


def test_native_parse_matches_inference_and_round_trips(spark):
    for text, want, _ in GOLDEN:
        if "p; q" in text:
            continue  # a quoted separator needs the parse by line
        dialect = A.choose_dialect([text])
        df = spark.createDataFrame([(text,), (None,)], "t string").withColumn("m", A.parse_attributes(F.col("t"), dialect))
        out = df.withColumn("back", A.format_attributes(F.col("m"), dialect)).collect()
        assert out[0]["m"] == want and out[1]["m"] == {} and out[0]["back"] == text.replace("k=v", "k%3Dv")


def test_vote_and_comparison():
    d = A.choose_dialect(["ID=a;Name=b;", "ID=c", 'x "y"'])
    assert d.trailing_semicolon and d.keyval_separator == "=" and d.order == ("ID", "Name", "x")
    assert A.compare_dialects(A.Dialect(), A.Dialect(fmt="gtf")) == ({"fmt": "gff3"}, {"fmt": "gtf"})
    with pytest.raises(A.AttributeFormatError):
        A.format_attributes(F.lit(None), None)


def test_bins(spark):
    df = spark.createDataFrame([(1, 10), (1, 1 << 18), (1 << 17, (1 << 17) + 1), (1 << 29, (1 << 29) + 5), (0, 5), (None, 5)], "s bigint, e bigint")
    got = [tuple(r) for r in df.select(bin_of(F.col("s"), F.col("e")), F.size(bins_overlapping(F.col("s"), F.col("e")))).collect()]
    assert [g[0] for g in got] == [4681, 585, 585, 1, 1, None] and got[3][1] == 1 and got[0][1] == 5 and got[1][1] == 7


def test_merge_attributes_numeric(spark):
    df = spark.createDataFrame([({"n": ["10", "9"]}, {"n": ["1", "9"], "s": ["b"]}), (None, {"s": ["a"]})], "a map<string,array<string>>, b map<string,array<string>>")
    got = [r[0] for r in df.select(A.merge_attributes(F.col("a"), F.col("b"), True)).collect()]
    assert got == [{"n": ["1", "9", "10"], "s": ["b"]}, {"s": ["a"]}]


def test_overlap_join_is_complete(spark):
    import random

    random.seed(2)
    data = [(f"r{i}", random.choice("ab"), s, s + random.choice([0, 50, 300_000, 1 << 29]), "+") for i, s in enumerate(random.sample(range(1, 2_000_000), 80))] + [("n", "a", None, 5, "+")]
    data += [(f"far{i}", "a", s, s + w, "-") for i, (s, w) in enumerate([(1 << 30, 5), ((1 << 30) + 3, 9), (1 << 40, 1 << 41), ((1 << 41) + 7, 0), (-500, 100), (-450, 900_000), (-10, 10)])]
    df = spark.createDataFrame(data, "id string, seqid string, start bigint, end bigint, strand string")
    want = {(a[0], b[0]) for a in data for b in data if a[1] == b[1] and None not in (a[2], b[2]) and b[2] <= a[3] and b[3] >= a[2]}
    got = rows(relate.overlap_join(df, df), "left_id", "right_id")
    assert len(got) == len(set(got)) and set(got) == want


def test_islands_match_a_fold(spark):
    import random

    random.seed(4)
    data = [(f"r{i}", "a", "x", "t", s, s + random.randint(0, 9), ".", "+", ".", i) for i, s in enumerate(random.choices(range(300), k=80))]
    cols = "id string, seqid string, source string, featuretype string, start bigint, end bigint, score string, strand string, frame string, file_order bigint"
    df = spark.createDataFrame(data, cols)
    folded = merge.fold(df, lambda acc, cur, _: cur["start"] <= acc["end"] + 3, ["seqid"], ["start", "end", "id"])
    want = {r["start"]: r["n_members"] for r in folded.collect()}
    for tile, small in ((16, 0), (1 << 17, 0), (16, 1000)):
        n = {r["island"]: r["n"] for r in merge.islands(df, ["seqid"], 2, tile, small).groupBy("island").agg(F.count("*").alias("n")).collect()}
        assert n == want
    inside = merge.fold(df, lambda acc, cur, _: cur["end"] <= acc["end"], ["seqid"], ["start", "end", "id"])
    for tile in (16, 1 << 17):
        got = merge._start_islands(df, ["seqid"], tile).groupBy("island").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.count("*").alias("n"))
        assert rows(got, "s", "e", "n") == rows(inside, "start", "end", "n_members")


def test_merged_children_follow_the_criteria(spark):
    cols = "id string, seqid string, source string, featuretype string, start bigint, end bigint, strand string"
    df = spark.createDataFrame([("e1", "c", "x", "exon", 1, 10, "+"), ("e2", "c", "x", "exon", 5, 20, "-"), ("e3", "c", "x", "exon", 8, 15, "+")], cols)
    edges = spark.createDataFrame([("g", f"e{i}", 1) for i in (1, 2, 3)], "parent string, child string, level int")
    bp = lambda **kw: aggregate.children_bp(df, edges, **kw).first()["bp"]
    assert bp() == 34 and bp(merge=True) == 15 + 16 and bp(merge=True, criteria=("seqid", "overlap_end_inclusive", "feature_type")) == 20


def test_merge_all_by_groups(spark):
    cols = "id string, seqid string, source string, featuretype string, start bigint, end bigint, score string, strand string, frame string, attributes map<string,array<string>>, file_order bigint"
    data = [("a1", "exon", 1, 10), ("a2", "exon", 5, 20), ("b1", "CDS", 1, 4), ("b2", "CDS", 5, 9)]
    df = spark.createDataFrame([(i, "c", "x", t, s, e, ".", "+", ".", {}, n) for n, (i, t, s, e) in enumerate(data)], cols)
    edges = spark.createDataFrame([], "parent string, child string, level int")
    features, relations = merge.merge_all(df, edges, featuretypes_groups=("exon", ["CDS"]))
    assert rows(relations) == [("merged2_CDS_1", "b1", 1), ("merged2_CDS_1", "b2", 1), ("merged_exon_1", "a1", 1), ("merged_exon_1", "a2", 1)]
    assert {r["id"]: r["attributes"]["Parent"] for r in features.filter("id in ('a1', 'b2')").collect()} == {"a1": ["merged_exon_1"], "b2": ["merged2_CDS_1"]}
    features, relations = merge.merge_all(df, edges, featuretypes_groups=("exon",), exclude_components=True)
    assert ids(features) == ["b1", "b2", "merged_exon_1"] and relations.count() == 0


def test_rows_and_stores_as_sources(spark, store):
    rows_ = [{"seqid": "c9", "featuretype": "gene", "start": 5, "end": 9, "attributes": {"ID": ["q1"]}}, {"seqid": "c9", "featuretype": "exon", "start": 5, "end": 6, "strand": "+", "attributes": {"ID": ["q2"], "Parent": ["q1"]}}]
    made = AnnotationStore.create(spark, rows_)
    assert ids(made.children("q1")) == ["q2"] and made["q1"].first()["source"] == "."
    again = AnnotationStore.create(spark, store)
    assert ids(again.features) == ids(store.features) and again.dialect == store.dialect
    e1 = store["e1"].first()
    assert ids(store.region(e1, featuretype="exon")) == ["e1"]
    lines = spark.createDataFrame([(n, x) for n, x in enumerate(GFF.splitlines())], "line_no bigint, value string")
    assert gff.read_gff(spark, lines).features.count() == 9


def test_relation_functions_see_both_rows(spark, store):
    mark = lambda p, c: {**c, "attributes": {**c["attributes"], "Parent": [p["id"]]}}
    out = store.add_relation("g2", "e1", 1, child_func=mark)
    assert out["e1"].first()["attributes"]["Parent"] == ["g2"] and out.features.count() == store.features.count()


def test_inferred_rows_add_attributes_to_explicit_ones(spark):
    text = 'c1\tderived\tgene\t10\t50\t.\t-\t.\tgene_id "G"; note "kept";\n' + GTF.splitlines()[0] + "\n" + GTF.splitlines()[1]
    made = AnnotationStore.create(spark, text, from_string=True)
    assert made["G"].first()["attributes"] == {"gene_id": ["G"], "note": ["kept"]} and made.features.filter("id = 'G'").count() == 1


def test_sequences(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 first\nACGT\nNNAC\n>c2\nTT\n")
    fasta = gff.read_fasta(spark, str(tmp_path / "a.fa"))
    assert rows(fasta) == [("c1", "ACGTNNAC"), ("c2", "TT")]
    lines = spark.createDataFrame([(0, "lost", None), (1, ">x", "x"), (2, "AC", None), (5, "GT", None), (7, ">y", "y"), (9, ">z", "z"), (10, "T", None)], "line_no bigint, value string, name string")
    for block in (2, 1 << 20):
        assert rows(gff.fasta_records(lines, block)) == [("x", "ACGT"), ("y", ""), ("z", "T")]
    df = spark.createDataFrame([("p", "c1", 2, 4, "+"), ("m", "c1", 2, 4, "-")], "id string, seqid string, start bigint, end bigint, strand string")
    assert dict(rows(derive.sequences(df, fasta), "id", "sequence")) == {"p": "CGT", "m": "ACG"}


def test_numbered_lines_over_blocks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = rows(gff.numbered_lines(spark, str(tmp_path / "big.txt")))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert len(got) == 3000 and all(v == f"line {n}" for n, v in got)


def test_streams(spark, tmp_path):
    from locusframe.operators.profile import ValueCounts
    from locusframe.streaming.ingest import sessions, stream_into_store, stream_value_counts

    first = AnnotationStore.create(spark, "c\ts\tgene\t1\t5\t.\t+\t.\tID=x\n", from_string=True)
    path = "file://" + str(tmp_path / "store")
    first.save(path)
    batch = first.features.drop("id", "bin").withColumn("attributes", F.create_map(F.lit("ID"), F.array(F.lit("y")))).withColumn("bin", F.lit(1))
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = stream_into_store(stream, path, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert ids(AnnotationStore.open(spark, path).features) == ["x", "y"]
    counts = ValueCounts(spark)
    q = stream_value_counts(stream.withColumn("load_id", F.lit(1)), ["strand"], "load_id", counts, str(tmp_path / "cp2"))
    q.processAllAvailable()
    q.stop()
    assert rows(counts.counts(), "value", "n") == [("+", 1)]
    ev = spark.createDataFrame([(1, 0), (1, 500), (1, 9000)], "k int, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    assert rows(sessions(ev, "k", "ts", "10 minutes"), "n_events") == [(1,), (2,)]


def test_interval_join_of_all_items(spark):
    from locusframe.plans import reference

    d = "/root/testdata/sf0.001"
    li = [(r["id"], r["seqid"], r["start"], r["end"]) for r in reference.items(spark, d).select("id", "seqid", "start", "end").collect()]
    by = {}
    for _, q, a, b in li:
        by.setdefault(q, []).append((a, b))
    want = []
    for i, q, s, e in li:
        shared = [min(e, b) - max(s, a) + 1 for a, b in by[q] if a <= e and b >= s]
        want.append((i, len(shared), sum(shared)))
    assert rows(reference.QUERIES["interval_join"](spark, d)) == sorted(want, key=repr)


def test_overlap_totals_are_those_of_the_pairs(spark):
    import random

    random.seed(5)
    cols = "id string, seqid string, start bigint, end bigint, strand string"
    wide = [0, 1, 7, 8, 40, 300_000, 1 << 29]
    draw = lambda p, n, top: [(f"{p}{i % (n - 5)}", random.choice(["a", "b", p, None]), s, s + random.choice(wide), "+") for i, s in enumerate(random.choices(range(-60, top), k=n))]
    odd = [("n", "a", None, 5, "+"), ("m", "a", 5, None, "+"), ("turned", "a", 9, 3, "+"), ("far", "a", 1 << 40, 1 << 41, "-"), ("out", "a", (1 << 41) + 1, 1 << 42, "-"), (None, "b", 4, 90, "-")]
    left, right = draw("x", 60, 200) + odd, draw("y", 90, 200) + draw("y", 20, 2_000_000) + odd[:4]
    want = {}
    for i, q, s, e, _ in left:
        for _, q2, a, b, _ in right:
            if None not in (q, s, e, a, b) and q == q2 and max(s, a) <= min(e, b) and s <= e and a <= b:
                n, bp = want.get(i, (0, 0))
                want[i] = n + 1, bp + min(e, b) - max(s, a) + 1
    want = sorted([(i, *v) for i, v in want.items()], key=repr)
    l_, r_ = spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)
    for tile, few in ((17, 1000), (3, 0), (5, 1000)):
        assert rows(relate.overlap_totals(l_, r_, tile=tile, few=few), "left_id", "n", "bp") == want
    pairs = relate.overlap_join(l_, r_).groupBy("left_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("bp"))
    assert rows(pairs, "left_id", "n", "bp") == want
    for a, b in ((l_.limit(0), r_), (l_, r_.limit(0))):
        assert rows(relate.overlap_totals(a, b)) == []


def test_interval_join_of_a_crowd(spark, tmp_path):
    """300,000 items over each other: 90 billion pairs, which can't be made in a minute."""
    from threading import Timer

    from locusframe.plans import reference

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    same = li.limit(1).crossJoin(spark.range(300_000).withColumnRenamed("id", "k"))
    same.withColumns({"l_orderkey": F.col("k"), "l_linenumber": F.lit(1), "l_quantity": (F.col("k") % 50 + 1).cast("double")}).select(li.columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    stop = Timer(60, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        out = reference.QUERIES["interval_join"](spark, str(tmp_path))
        q = (F.floor(F.substring("left_id", 2, 20).cast("bigint") / 1000) % 50 + 1).alias("q")
        got = rows(out.groupBy(q, "n", "bp").count(), "q", "n", "bp", "count")
    finally:
        stop.cancel()
    assert sorted(got) == [(q, 300_000, 6000 * 1000 * sum(min(q, r) for r in range(1, 51)), 6000) for q in range(1, 51)]
