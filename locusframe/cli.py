"""python -m locusframe.cli COMMAND ...: create, fetch, children, parents, region, search,
sanitize, rmdups and export over annotation stores."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from locusframe.functions.attributes import Dialect
from locusframe.operators import ingest
from locusframe.session import build_session
from locusframe.sinks.export import gff_lines
from locusframe.store import AnnotationStore


def _show(df, dialect: Dialect) -> None:
    for r in gff_lines(df, dialect).select("line").toLocalIterator():
        print(r[0])


def main(args: list[str] | None = None, spark=None) -> None:
    p = argparse.ArgumentParser(prog="locusframe")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("create")
    c.add_argument("file")
    c.add_argument("store")
    c.add_argument("--merge", default="merge", choices=ingest.STRATEGIES)
    c.add_argument("--no-infer", action="store_true")
    for name in ("fetch", "children", "parents"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("ids", help="ids, by commas")
        if name != "fetch":
            c.add_argument("--exclude", default="", help="feature types to leave out")
            c.add_argument("--exclude-self", action="store_true")
    c = sub.add_parser("region")
    c.add_argument("store")
    c.add_argument("region")
    c = sub.add_parser("search")
    c.add_argument("store")
    c.add_argument("text")
    c.add_argument("--featuretype")
    for name in ("sanitize", "rmdups"):
        c = sub.add_parser(name)
        c.add_argument("file")
    a = p.parse_args(args)
    spark = spark or build_session("locusframe-cli")
    if a.command == "create":
        store = AnnotationStore.create(spark, a.file, merge_strategy=a.merge, infer_genes=not a.no_infer, infer_transcripts=not a.no_infer)
        print(store.save(a.store))
        return
    if a.command in ("sanitize", "rmdups"):
        store = AnnotationStore.create(spark, a.file, merge_strategy="merge")
        rows = store.features if a.command == "rmdups" else ingest.sanitize(store.features, store.relations)
        _show(rows.orderBy("file_order"), store.dialect)
        return
    store = AnnotationStore.open(spark, a.store)
    if a.command == "fetch":
        _show(store.features.filter(F.col("id").isin(a.ids.split(","))), store.dialect)
    elif a.command in ("children", "parents"):
        ids = a.ids.split(",")
        rows = getattr(store, a.command)(ids)
        if not a.exclude_self:
            rows = store.features.filter(F.col("id").isin(ids)).unionByName(rows)
        _show(rows.filter(~F.col("featuretype").isin(a.exclude.split(","))), store.dialect)
    elif a.command == "region":
        _show(store.region(a.region), store.dialect)
    elif a.command == "search":
        _show(store.attribute_search(a.text, a.featuretype), store.dialect)


if __name__ == "__main__":
    main()
