"""Deterministic keys and uniform numbers in place of a random generator's state."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | str, *columns: str | Column) -> Column:
    """MD5 of seed and columns as text: an order that depends on neither partitions nor row order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns)).cast("binary"))


def seeded_uniform(seed: int | str, *columns: str | Column) -> Column:
    """A number in [0, 1) from the key's first 48 bits."""
    return F.conv(F.substring(seeded_key(seed, *columns), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
