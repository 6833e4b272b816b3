"""Attribute strings: dialects, parsing, formatting and merging.

A dialect is inferred on the driver from a small sample; parsing and formatting of the
table itself are native expressions with the dialect folded in as literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP = "map<string,array<string>>"


class AttributeFormatError(ValueError):
    """Attributes cannot be written without a dialect."""


@dataclass(frozen=True)
class Dialect:
    """How a file writes its attribute column."""

    leading_semicolon: bool = False
    trailing_semicolon: bool = False
    quoted_values: bool = False
    field_separator: str = ";"
    keyval_separator: str = "="
    multival_separator: str = ","
    fmt: str = "gff3"
    repeated_keys: bool = False
    order: tuple[str, ...] = ()

    def to_dict(self) -> dict:
        return asdict(self) | {"order": list(self.order)}

    @staticmethod
    def from_dict(d: dict) -> Dialect:
        return Dialect(**{**d, "order": tuple(d.get("order", ()))})


def split_attributes(text: str) -> tuple[dict[str, list[str]], Dialect]:
    """Take one attribute string apart and tell its dialect.

    The separator is the first of `` ; ``, ``; `` and ``;`` that splits; a first part that
    reads ``key=`` makes it GFF3, else key and value are parted by a blank.  A separator
    further on in a part belongs to the value.  Values are split at commas unless the
    key was seen before or a piece begins with a blank.
    """
    text = text.strip("\r\n")
    if not text.strip():
        return {}, Dialect()
    lead, trail = text.startswith(";"), text.rstrip().endswith(";")
    body = text.lstrip(";") if lead else text
    body = body.rstrip()[:-1] if trail else body
    separator = next((s for s in (" ; ", "; ", ";") if len(_outside_quotes(body, s)) > 1), ";")
    parts = [p for p in _outside_quotes(body, separator)]
    gff3 = re.match(r"\s*[\w.\-:]+=", parts[0]) is not None
    sep = "=" if gff3 else " "
    out: dict[str, list[str]] = {}
    quoted = repeated = False
    for part in parts:
        part = part.strip() if not gff3 else part
        key, found, value = part.partition(sep)
        if not key and not found:
            continue
        values: list[str] = []
        if found:
            value = value.strip() if not gff3 else value
            if len(value) > 1 and value[0] == value[-1] == '"':
                quoted, value = True, value[1:-1]
            pieces = value.split(",")
            values = [value] if key in out or len(pieces) > 1 and any(p.startswith(" ") for p in pieces) else pieces
        repeated |= key in out
        out.setdefault(key, []).extend(values)
    fmt = "gtf" if not gff3 and quoted else "gff3"
    return out, Dialect(lead, trail, quoted, separator, sep, ",", fmt, repeated, tuple(out))


def _outside_quotes(text: str, separator: str) -> list[str]:
    """Split at separators that are not inside double quotes (all, where quotes are odd)."""
    if text.count('"') % 2:
        return text.split(separator)
    out, start, at, inside = [], 0, 0, False
    while at < len(text):
        if text[at] == '"':
            inside = not inside
        if not inside and text.startswith(separator, at):
            out.append(text[start:at])
            at = start = at + len(separator)
            continue
        at += 1
    return [*out, text[start:]]


def infer_dialect(text: str) -> Dialect:
    return split_attributes(text)[1]


def choose_dialect(samples: Iterable[str]) -> Dialect:
    """The dialect of a file: each property by a vote weighted with the number of
    attributes, ties to what was seen first; keys in the order first seen."""
    parsed = [split_attributes(s) for s in samples]
    parsed = [(a, d) for a, d in parsed if a]
    if not parsed:
        return Dialect()
    chosen = {}
    for f in fields(Dialect):
        if f.name == "order":
            continue
        votes: dict = {}
        for attrs, d in parsed:
            votes[getattr(d, f.name)] = votes.get(getattr(d, f.name), 0) + len(attrs)
        chosen[f.name] = max(votes, key=votes.get)
    order = tuple(dict.fromkeys(k for a, _ in parsed for k in a))
    return replace(Dialect(**chosen), order=order)


def compare_dialects(a: Dialect, b: Dialect) -> tuple[dict, dict]:
    """(what only a has, what only b has)."""
    x, y = asdict(a), asdict(b)
    return {k: v for k, v in x.items() if y[k] != v}, {k: v for k, v in y.items() if x[k] != v}


def percent_decode(c: Column) -> Column:
    """``%XX`` decoded; a plus sign stays, and a text with a bad code is left as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


# What GFF3 encodes in attributes.
_ENCODED = ["%", *map(chr, range(0x20)), "\x7f", ";", "=", "&", ","]


def percent_encode(c: Column) -> Column:
    """Control characters and ``% ; = & ,`` as percent codes (where there are any)."""
    out = c
    for ch in _ENCODED:
        out = F.replace(out, F.lit(ch), F.lit(f"%{ord(ch):02X}"))
    return F.when(c.rlike("[\\x00-\\x1f\\x7f%;=&,]"), out).otherwise(c)


def _literal(text: str) -> str:
    return "\\Q" + text + "\\E"


def parse_attributes(c: Column, dialect: Dialect, decode: bool = True) -> Column:
    """``MAP<STRING, ARRAY<STRING>>`` of an attribute string in a known dialect.

    Values of a repeated key are joined in order; a key without a value has an empty
    array; null and empty strings give an empty map.
    """
    text = F.coalesce(c, F.lit(""))
    if dialect.trailing_semicolon:
        text = F.rtrim(text, F.lit(";")) if hasattr(F, "rtrim") else text
    if dialect.leading_semicolon:
        text = F.ltrim(text, F.lit(";"))
    gff3 = dialect.keyval_separator == "="

    def one(part: Column) -> Column:
        p = part if gff3 else F.trim(part)
        at = F.instr(p, dialect.keyval_separator)
        value = F.when(at > 0, p.substr(at + 1, F.length(p)))
        value = value if gff3 else F.trim(value)
        bare = F.when(value.rlike('^".*"$') & (F.length(value) > 1), value.substr(F.lit(2), F.length(value) - 2)).otherwise(value)
        values = F.coalesce(F.split(bare, _literal(dialect.multival_separator), -1), F.array().cast("array<string>"))
        if decode and dialect.fmt == "gff3":
            values = F.transform(values, percent_decode)
        return F.struct(F.when(at > 0, p.substr(F.lit(1), at - 1)).otherwise(p).alias("k"), values.alias("v"))

    pairs = F.when(text == "", F.array().cast("array<struct<k:string,v:array<string>>>")).otherwise(F.transform(F.split(text, _literal(dialect.field_separator), -1), one))
    keys = F.array_distinct(F.transform(pairs, lambda e: e.k))
    fold = lambda k: F.struct(k, F.flatten(F.transform(F.filter(pairs, lambda e: e.k == k), lambda e: e.v)))
    return F.map_from_entries(F.transform(keys, fold))


def format_attributes(c: Column, dialect: Dialect | None, keep_order: bool = False, sort_values: bool = False, encode: bool = True) -> Column:
    """The attribute string of a map in ``dialect``; with ``keep_order`` keys follow the
    dialect's order, unknown ones last."""
    if dialect is None:
        raise AttributeFormatError("a dialect is needed to write attributes")
    d = dialect
    entries = F.map_entries(c)
    if keep_order and d.order:
        place = F.array(*[F.lit(k) for k in d.order])
        keyed = F.transform(entries, lambda e, i: F.struct(F.when(F.array_position(place, e["key"]) > 0, F.array_position(place, e["key"]).cast("int")).otherwise(1 << 30).alias("p"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value")))
        entries = F.transform(F.array_sort(keyed), lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))
    quote = F.lit('"') if d.quoted_values else F.lit("")
    safe = percent_encode if encode and d.fmt == "gff3" else (lambda v: v)

    def pair(key: Column, text: Column) -> Column:
        return F.concat(key, F.lit(d.keyval_separator), quote, text, quote)

    def one(e: Column) -> Column:
        values = F.coalesce(F.array_sort(e["value"]) if sort_values else e["value"], F.array().cast("array<string>"))
        values = F.transform(values, lambda v: safe(F.coalesce(v, F.lit(""))))
        empty = F.concat(e["key"], F.lit(' ""')) if d.fmt == "gtf" else e["key"]
        full = F.transform(values, lambda v: pair(e["key"], v)) if d.repeated_keys else F.array(pair(e["key"], F.array_join(values, d.multival_separator)))
        return F.when(F.size(values) == 0, F.array(empty)).otherwise(full)

    text = F.array_join(F.flatten(F.transform(entries, one)), d.field_separator)
    text = F.concat(F.lit(";") if d.leading_semicolon else F.lit(""), text, F.lit(";") if d.trailing_semicolon else F.lit(""))
    return F.when(c.isNull() | (F.size(c) == 0), F.lit("")).otherwise(text)


def merge_attributes(a: Column, b: Column, numeric_sort: bool = False) -> Column:
    """Per key the sorted union of the values; ``numeric_sort`` orders by number where all
    values of a key are numbers."""
    none = F.array().cast("array<string>")

    def union(_key: Column, x: Column, y: Column) -> Column:
        both = F.array_distinct(F.concat(F.coalesce(x, none), F.coalesce(y, none)))
        if not numeric_sort:
            return F.array_sort(both)
        ranked = F.transform(F.array_sort(F.transform(both, lambda v: F.struct(v.try_cast("double").alias("n"), v.alias("v")))), lambda s: s.v)
        return F.when(F.forall(both, lambda v: v.try_cast("double").isNotNull()), ranked).otherwise(F.array_sort(both))

    return F.map_zip_with(F.coalesce(a, F.create_map().cast(MAP)), F.coalesce(b, F.create_map().cast(MAP)), union)


def first_value(attributes: Column, key: str) -> Column:
    """The first value of ``key``; null where there is none or it is empty."""
    v = F.get(F.try_element_at(attributes, F.lit(key)), F.lit(0))
    return F.when(v != "", v)


def has_text(attributes: Column, text: str) -> Column:
    """Any value contains ``text``, whatever the case."""
    return F.exists(F.flatten(F.map_values(attributes)), lambda v: F.contains(F.lower(v), F.lit(text.lower())))


def reverse_complement(seq: Column) -> Column:
    """The other strand, with the ambiguity letters of the alphabet."""
    return F.reverse(F.translate(seq, "ACGTUNRYSWKMBVDHacgtunryswkmbvdh", "TGCAANYRSWMKVBHDtgcaanyrswmkvbhd"))
