"""Problem 3: duplicate groups and their best values."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from compare import rows

from locusframe.llm import survivor
from locusframe.llm.components import connected_components


def T(d):
    return dt.datetime(2024, 1, d)


def test_connected_components_chain_star_and_self(spark):
    edges = [(f"a{i:02}", f"a{i + 1:02}") for i in range(40)] + [("hub", f"s{i}") for i in range(30)] + [("me", "me"), (None, "x")]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "a string, b string"), "a", "b")))
    assert {v for k, v in got.items() if k.startswith("a")} == {"a00"} and {v for k, v in got.items() if k.startswith("s")} == {"hub"} and got["me"] == "me"


def test_best_record_ties_and_stand_ins(spark):
    sch = "id string, file_order bigint, loaded_at timestamp, source string, attributes map<string,array<string>>, group_id string"
    fea = spark.createDataFrame(
        [("g1", 1, T(1), "good", {"Name": ["first"], "Note": ["keep"]}, "?"), ("G1_1 ", 2, T(2), "BAD", {"Name": ["worse"], "Note": ["n/a"]}, "?"), ("g1.d", 3, T(2), "go-od", {"Name": ["better"], "product": [" "]}, "?"), ("g1.d", 4, None, None, None, None), ("lone", 5, T(1), "good", {"Name": ["x"]}, None), (None, 6, T(9), "good", {"Name": ["y"]}, None)], sch
    )
    dup = spark.createDataFrame([("g1", "g1_1"), ("g1_1", "g1.d"), ("g1", "g1_1"), ("lone", "nobody"), (None, "z")], "idspecid string, newid string")
    src = spark.createDataFrame([("good", 1), ("bad", 2), ("go_od", 1)], "source_name string, trust_rank int")
    out = survivor.best_records(fea, dup, src, ["Name", "Note", "product"])
    assert rows(out) == [("g1", "Name", "better"), ("g1", "Note", "keep")]
    assert survivor.best_records(fea, dup.limit(0), src, ["Name"]).count() == 0


def test_best_record_by_completeness(spark):
    sch = "id string, file_order bigint, loaded_at timestamp, source string, attributes map<string,array<string>>"
    fea = spark.createDataFrame([("a", 1, T(1), "s", {"Name": ["full"], "Note": ["n"]}), ("b", 2, T(2), "s", {"Name": ["late"]})], sch)
    dup = spark.createDataFrame([("a", "b")], "idspecid string, newid string")
    src = spark.createDataFrame([("s", 1)], "source_name string, trust_rank int")
    by = lambda *b: rows(survivor.best_records(fea, dup, src, ["Name", "Note"], by=b), "attr_key", "attr_value")
    assert by("completeness", "recency") == [("Name", "full"), ("Note", "n")]
    assert by("recency", "completeness") == [("Name", "late"), ("Note", "n")]


def test_p3_found_against_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from compare import compare

    from locusframe.llm import queries

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for name in ("features", "duplicates", "annot_sources"):
        con.execute(f"create view {name} as select * from read_parquet('{d}/{name}.parquet')")
    assert compare(spark, con, queries.p3_found, queries.ORACLES["p3_found"], d) == ""
