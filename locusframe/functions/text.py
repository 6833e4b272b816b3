"""Column functions on identifiers and scalar text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode.
WHITE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: A plain decimal number: sign, fraction and exponent allowed, ASCII digits only.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def trim_white(c: Column | str) -> Column:
    """Take white space (not only blanks) off both ends."""
    c = F.col(c) if isinstance(c, str) else c
    return F.btrim(c, F.lit(WHITE))


def norm_id(c: Column | str) -> Column:
    """Ids and seqids in the form they are compared in: trimmed and lower-cased."""
    return F.lower(trim_white(c))


def norm_id_or_null(c: Column | str) -> Column:
    """As :func:`norm_id`; blank becomes null."""
    n = norm_id(c)
    return F.when(n != "", n)


def is_number(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(NUMBER)
