"""Joins with a side of unique keys, the hot ones of which are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are dealt out, and over how many parts. Any other key has fewer than one in ``HOT`` of the rows.
HOT, SALTS = 256, 64


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """The inner join of ``rows`` with ``keyed``, which has each key once and in ``count`` the number of its rows. The commonest
    keys, at most ``HOT`` rows, are broadcast; their rows are dealt over ``SALTS`` parts by a hash of the row, so that a task
    that is run again sends them where they went before, and what is known of the key goes to every part. ``count`` is dropped."""
    keyed = keyed.where(F.col(count) > 0)  # read in each use, so that all uses share one exchange
    others = [c for c in keyed.columns if c not in (*keys, count)]
    hot = keyed.where(F.col(count) >= SALTS).orderBy(F.desc(count), *keys, *others).limit(HOT).select(*keys, F.lit(True).alias("__hot"))
    own = F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.when(F.col("__hot"), own).otherwise(0)).drop("__hot")
    parts = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = keyed.join(F.broadcast(hot), keys, "left").select(*keys, *others, F.explode(parts).alias("__salt"))
    return dealt.join(known, [*keys, "__salt"]).drop("__salt")
