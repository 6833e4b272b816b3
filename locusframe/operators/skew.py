"""Joins whose probe side may hold a third of all rows under one key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Probe rows of one key that one task may take.
ROWS_PER_SALT = 1_000_000


def salted_join(
    probe: DataFrame,
    build: DataFrame,
    key: str,
    count_col: str,
    how: str = "inner",
    spread: list[str] | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Join ``probe`` to ``build`` on ``key``, spreading hot keys over several tasks.

    ``build[count_col]`` holds how many probe rows carry the key.  A key with more
    than ``rows_per_salt`` of them is cut into ``ceil(n / rows_per_salt)`` salts: the
    build row is repeated once per salt and each probe row picks one.  The list of
    hot keys that the probe side needs has at most ``|probe| / rows_per_salt`` rows
    (10^6 keys at 10^12 rows), which bounds what is broadcast.  Null keys never
    join.  ``build`` is read twice, so hand over a written table; it may hold several
    rows of a key, all with the key's count.
    """
    salts = F.greatest(F.lit(1), F.ceil(F.col(count_col) / F.lit(rows_per_salt))).cast("int")
    hot = build.filter(F.col(count_col) > rows_per_salt).select(key, salts.alias("_salts")).distinct()
    pick = F.when(
        F.col("_salts").isNotNull(), F.pmod(F.xxhash64(*(spread or probe.columns)), F.col("_salts"))
    ).otherwise(F.lit(0))
    probe = probe.join(F.broadcast(hot), key, "left").withColumn("_salt", pick.cast("int")).drop("_salts")
    build = build.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return probe.join(build, [key, "_salt"], how).drop("_salt")
