"""Several values packed in one field.

Quoted spans are replaced by indexed placeholders, the rest is split at the
delimiters, and the spans are put back through an array lookup; the values come out
one per row with their position.  All of it is native expressions.

Placeholders are ``U+E000 index U+E001``.  They cannot collide with the text: a
U+E000 of the text itself is first written as ``U+E000 x U+E001`` and restored by the
same lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusframe.functions.text import WHITE, trim_white

OPEN, CLOSE = "\ue000", "\ue001"


#: Unicode white space, as :func:`trim_white` takes it off.
_BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE) + "]*+"


def _quoted(delimiters: str, quote: str) -> str:
    """A quoted span that makes up a whole value: what stands before it (group 1) and the
    span (group 2)."""
    d = "[" + "".join("\\" + x for x in delimiters) + "]"
    return rf"((?:^|{d}){_BLANK})({quote}(?:[^{quote}]|{quote}{quote})*+{quote})(?={_BLANK}(?:{d}|\z))"


def split_packed(value: Column, delimiters: str = ",;|", quote: str = '"') -> Column:
    """The values packed in ``value`` as an array.

    A value in quotes may contain delimiters, and a doubled quote in it stands for
    one; outer blanks and the enclosing quotes are taken off.  Empty pieces do not
    count, be they quoted or not.  A quote inside an unquoted value, or one that is
    never closed, is an ordinary character.  Null gives an empty array.
    """
    span = _quoted(delimiters, quote)
    spans = F.regexp_extract_all(value, F.lit(span), F.lit(2))
    # no U+E000 of the text stands before a q now, so that the mark is none of the text
    safe = F.replace(value, F.lit(OPEN), F.lit(f"{OPEN}x{CLOSE}"))
    outside = F.split(F.regexp_replace(safe, span, f"$1{OPEN}q{CLOSE}"), f"{OPEN}q{CLOSE}", -1)
    template = F.array_join(
        F.transform(outside, lambda p, i: F.concat(F.when(i == 0, F.lit("")).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE))), p)),
        "",
    )
    fields = F.split(template, "[" + "".join("\\" + x for x in delimiters) + "]", -1)

    def restore(part: Column, i: Column) -> Column:
        at = F.instr(part, CLOSE)
        token, rest = F.substring_index(part, CLOSE, 1), part.substr(at + 1, F.length(part))
        body = F.get(spans, token.try_cast("int"))
        unquoted = F.replace(body.substr(F.lit(2), F.length(body) - 2), F.lit(quote * 2), F.lit(quote))
        return F.when(i == 0, part).otherwise(F.concat(F.when(token == "x", F.lit(OPEN)).otherwise(unquoted), rest))

    values = F.transform(fields, lambda f: F.array_join(F.transform(F.split(trim_white(f), OPEN, -1), restore), ""))
    return F.coalesce(F.filter(values, lambda v: v != ""), F.array().cast("array<string>"))


def explode_packed(
    df: DataFrame,
    attributes: str,
    keys: list[str],
    row_key: str,
    delimiters: str = ",;|",
    only_packed: bool = True,
) -> DataFrame:
    """(row_key, attr_key, pos, attr_value): one row per value of the arrays under
    ``keys``; with ``only_packed`` only of arrays that have an element holding more
    than one value.  Positions count from 1 over the whole array.  Null maps, absent
    keys, empty arrays and null elements give no rows.
    """
    attr = F.col(attributes)
    entries = F.array(*[F.struct(F.lit(k).alias("attr_key"), F.try_element_at(attr, F.lit(k)).alias("packed")) for k in keys])
    d = "[" + "".join("\\" + x for x in delimiters) + "]"
    rows = df.select(F.col(row_key), F.explode(entries).alias("e")).select(row_key, "e.attr_key", "e.packed")
    if only_packed:  # cheap and exact: an element without a delimiter holds at most one value
        rows = rows.filter(F.exists("packed", lambda v: v.rlike(d)))
    # the row filter below would otherwise evaluate the split twice
    parts = F.transform("packed", lambda v: F.coalesce(split_packed(v, delimiters), F.array().cast("array<string>")))
    rows = rows.select(row_key, "attr_key", F.explode(F.array(parts)).alias("parts"))
    if only_packed:
        rows = rows.filter(F.exists("parts", lambda p: F.size(p) > 1))
    out = rows.select(row_key, "attr_key", F.posexplode(F.flatten("parts")).alias("pos", "attr_value"))
    return out.select(row_key, "attr_key", (F.col("pos") + 1).cast("int").alias("pos"), "attr_value")
