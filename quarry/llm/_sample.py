"""Bounded samples that do not hang on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashed(df: DataFrame, n: int, total: int, seed: int, *keys: str) -> DataFrame:
    """The ``n`` rows of ``df`` with the least hash of ``keys``. ``total``, their number, gives a
    bound of the hash under which somewhat more than ``n`` are to be expected, so that tasks
    sort and send those only."""
    h = F.xxhash64(*keys, F.lit(seed))
    share = (1.5 * n + 100) / max(total, 1)
    few = df if share >= 1 else df.where(h < F.lit(int(share * (1 << 64)) - (1 << 63)))
    return few.orderBy(h, *keys).limit(n)
