"""Rows that fail to parse, separated with the reason while the valid rows load.

A line is parsed by a minimum-cost error parse: dynamic programming over its tabs and
quotes inserts or deletes as few delimiters, then as few quotes, as make it well formed.
A line of cost zero whose values have the right types loads; for the others the edit
operations, or the first illegal value, state the reason.

Whether the cost is zero is decided by native expressions for every line (the count of
columns and the places of the quotes); only the lines that need an edit go through the
Python dynamic programme, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.attributes import percent_decode
from locusframe.functions.text import NUMBER
from locusframe.operators.annotation_rules import FRAMES, STRANDS

#: One delimiter edit outweighs any number of quote edits in a line.
DELIMITER_COST = 1 << 20
#: The column that holds quoted attributes, from 0.
ATTRIBUTES = 8


def _symbols(line: str) -> list[tuple[str, int]]:
    """The line as the symbols the parse depends on: tab, quote, semicolon, blank, equals
    and runs of anything else (``x``), with their places."""
    out: list[tuple[str, int]] = []
    for i, ch in enumerate(line):
        if ch not in '\t"; =':
            ch = "x"
            if out and out[-1][0] == "x":
                continue
        out.append((ch, i))
    return out


# Quote states inside the attributes: o - outside, where a quote may open;
# b - outside, where it may not; i - inside; e - after a closing quote.
def _step(state: str, ch: str) -> str | None:
    if state == "i":
        return "e" if ch == '"' else "i"
    if state == "e":
        return {" ": "e", ";": "b"}.get(ch)
    if ch == '"':
        return "i" if state == "o" else None
    return "o" if ch in " =" else "b"


def error_parse(line: str, n_columns: int, delimiter_cost: int = DELIMITER_COST) -> tuple[int, list[str]]:
    """(cost, edits) of the cheapest well-formed reading of ``line``.

    Edits read ``insert tab @7``, ``delete quote @55``; the place is that in the line.
    Among readings of equal cost the one with the earlier edits is taken.
    """
    symbols = _symbols(line)
    tabs = sum(1 for s, _ in symbols if s == "\t")
    short = n_columns - 1 - tabs  # > 0: tabs to insert, < 0: tabs to delete
    # state -> (cost, chain of edits); only columns that |short| delimiter edits can reach
    best: dict[tuple[int, str], tuple[int, tuple]] = {(0, "b"): (0, ())}
    seen = 0

    def relax(into: dict, key: tuple[int, str], cost: int, edits: tuple) -> None:
        if key not in into or cost < into[key][0]:
            into[key] = (cost, edits)

    def insertions(states: dict, place: int) -> dict:
        for column in range(n_columns):
            for q, to in (("o", "i"), ("i", "e")):
                if column == ATTRIBUTES and (column, q) in states:
                    cost, edits = states[column, q]
                    relax(states, (column, to), cost + 1, (edits, f"insert quote @{place}"))
            if short > 0 and column < n_columns - 1:
                for q in "obe":
                    if (column, q) in states:
                        cost, edits = states[column, q]
                        relax(states, (column + 1, "b"), cost + delimiter_cost, (edits, f"insert tab @{place}"))
        return states

    for ch, place in symbols:
        seen += ch == "\t"
        best = insertions(best, place)
        nxt: dict[tuple[int, str], tuple[int, tuple]] = {}
        for (column, q), (cost, edits) in best.items():
            if ch == "\t":
                if q != "i" and column < n_columns - 1:
                    relax(nxt, (column + 1, "b"), cost, edits)
                if short < 0:
                    relax(nxt, (column, "i" if q == "i" else "b"), cost + delimiter_cost, (edits, f"delete tab @{place}"))
            elif column != ATTRIBUTES:
                relax(nxt, (column, "b"), cost, edits)
            else:
                to = _step(q, ch)
                if to is not None:
                    relax(nxt, (column, to), cost, edits)
                if ch == '"':
                    relax(nxt, (column, q), cost + 1, (edits, f"delete quote @{place}"))
        low, high = (seen, seen + short) if short >= 0 else (seen + short, seen)
        best = {k: v for k, v in nxt.items() if low <= k[0] <= high}
    best = insertions(best, len(line))
    cost, chain = min((best[k] for k in best if k[0] == n_columns - 1 and k[1] != "i"), key=lambda x: x[0])
    edits: list[str] = []
    while chain:
        chain, edit = chain
        edits.append(edit)
    return cost, edits[::-1]


def _parse_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for line_no, line, n, free in zip(pdf["line_no"], pdf["content"], pdf["n_columns"], pdf["free"]):
            if free:  # only its values are wrong
                rows.append((line_no, "value", 0, []))
            elif pd.isna(n):
                rows.append((line_no, "columns", None, []))
            else:
                cost, edits = error_parse(line, int(n))
                rows.append((line_no, "columns" if any("tab" in e for e in edits) else "quoting", cost, edits))
        yield pd.DataFrame(rows, columns=["line_no", "reason", "cost", "edits"]).astype({"cost": "Int64"})


def _quotes_fit(attributes: Column) -> Column:
    """Every quote opens a value (after ``=`` or a blank) or closes it (before ``;`` or the
    end, blanks between allowed), and none stays open."""
    parts = F.split(attributes, '"', -1)
    n = F.size(parts)
    after = F.btrim  # only blanks
    fits = F.forall(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(i % 2 == 1, F.lit(True)).otherwise(
            # even parts lie outside quotes: their end opens, their start follows a close
            ((i == n - 1) | F.substring(F.get(parts, i), -1, 1).isin("=", " "))
            & ((i == 0) | F.startswith(after(F.get(parts, i)), F.lit(";")) | ((i == n - 1) & (after(F.get(parts, i)) == "")))
        ),
    )
    return (n % 2 == 1) & fits


def _whole(c: Column) -> Column:
    """ASCII digits up to 2147483647."""
    digits = F.regexp_replace(c, "^0+(?=[0-9])", "")
    return c.rlike("^[0-9]+$") & (F.length(digits) <= 10) & F.coalesce(F.when(F.length(digits) <= 10, digits.try_cast("bigint")) <= 2147483647, F.lit(False))


def _values_fit(cols: Column) -> Column:
    g = lambda i: F.get(cols, F.lit(i))
    start, end, score = g(3), g(4), g(5)
    coordinates = ((start == ".") | _whole(start)) & ((end == ".") | _whole(end))
    ordered = F.coalesce(F.when(_whole(start), start.try_cast("bigint")) <= F.when(_whole(end), end.try_cast("bigint")), F.lit(True))
    extra = F.slice(cols, ATTRIBUTES + 2, F.greatest(F.size(cols) - ATTRIBUTES - 1, F.lit(0)))
    tagged = F.forall(extra, lambda x: F.trim(F.substring_index(x, ":", 1)) != "") & F.forall(extra, lambda x: (F.locate(":", x) > 0) & (F.trim(F.regexp_replace(x, "^[^:]*:?", "")) != ""))
    return coordinates & ordered & ((score == ".") | score.rlike(NUMBER)) & g(6).isin(*STRANDS) & g(7).isin(*FRAMES) & tagged


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Every data line with its columns, cost, edits and reason (null: the line loads).

    Data lines are those that are neither null, blank nor begin with ``#``; a carriage
    return at the end is not content.  The reason is the first that applies of `columns`
    (also where the line's file is unknown), `quoting` and `value`.  Empty columns are
    columns.  Extra columns of ``lines`` and ``files`` are not read.
    """
    files = files.groupBy("file_no").agg(F.max("n_columns").alias("n_columns"), F.max("format_name").alias("format_name"))
    data = lines.select("line_no", "file_no", F.regexp_replace("line", r"\r\z", "").alias("content"))
    data = data.filter(F.col("content").rlike(r"\S") & ~F.startswith("content", F.lit("#")))
    data = data.join(files, "file_no", "left").withColumn("cols", F.split("content", "\t", -1))
    free = F.coalesce((F.size("cols") == F.col("n_columns")) & _quotes_fit(F.get("cols", F.lit(ATTRIBUTES))), F.lit(False))
    return data.withColumn("free", free)


def _judged(lines: DataFrame, files: DataFrame) -> DataFrame:
    return parse_lines(lines, files).withColumn("fits", F.col("free") & F.coalesce(F.when(F.col("free"), _values_fit(F.col("cols"))), F.lit(False)))


def rejected_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """(line_no, reason, cost, edits) of the data lines that do not load; the cost is null
    where the line's file is unknown."""
    bad = _judged(lines, files).filter(~F.col("fits")).select("line_no", "content", "n_columns", "free")
    return bad.mapInPandas(_parse_batches, "line_no bigint, reason string, cost bigint, edits array<string>")


def attribute_map(attributes: Column) -> Column:
    """Well-formed attributes as ``MAP<STRING, ARRAY<STRING>>``: parts at semicolons outside
    quotes, key and value at the first ``=``, or at the first blank where that comes first;
    quotes are taken off, other values split at commas and percent codes decoded.  Values of a
    repeated key are joined in order; a key without a value has an empty array."""

    def one(part: Column) -> Column:
        key = F.regexp_extract(part, "^[^= ]*", 0)
        value = F.trim(part.substr(F.length(key) + 2, F.length(part)))
        quoted = F.regexp_extract(value, '^"([^"]*)"$', 1)
        values = F.when(value.startswith('"'), F.array(quoted)).when(value == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(value, ",", -1), percent_decode))
        return F.struct(key.alias("k"), values.alias("v"))

    parts = F.transform(F.regexp_extract_all(attributes, F.lit('((?:[^";]|"[^"]*")+)'), F.lit(1)), lambda p: F.trim(p))
    pairs = F.transform(F.filter(parts, lambda p: p != ""), one)
    keys = F.array_distinct(F.transform(pairs, lambda e: e.k))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.flatten(F.transform(F.filter(pairs, lambda e: e.k == k), lambda e: e.v)))))


def loaded_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The data lines that load, as feature rows (``.`` and empty coordinates are null);
    ``attributes`` as written, ``attribute_map`` taken apart."""
    data = _judged(lines, files).filter("fits")
    g = lambda i: F.get("cols", F.lit(i))
    return data.select(
        "line_no", "file_no", g(0).alias("seqid"), g(1).alias("source"), g(2).alias("featuretype"),
        g(3).try_cast("int").alias("start"), g(4).try_cast("int").alias("end"),
        g(5).alias("score"), g(6).alias("strand"), g(7).alias("frame"), g(8).alias("attributes"),
        F.slice("cols", ATTRIBUTES + 2, F.greatest(F.size("cols") - ATTRIBUTES - 1, F.lit(0))).alias("extra"),
        attribute_map(g(8)).alias("attribute_map"),
    )
