"""Rows drawn by a hash, for models that are fitted on a bounded sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RANGE = 1 << 60


def drawn(share: float | Column, salt: int, *columns: str) -> Column:
    """True for about this share of rows, told by the columns' hash alone; shares down to 2**-60 hold."""
    h = F.xxhash64(*columns, F.lit(salt))
    place = F.pmod(h, F.lit(1 << 20)) * F.lit(1 << 40) + F.pmod(F.shiftrightunsigned(h, 20), F.lit(1 << 40))
    share = share if isinstance(share, Column) else F.lit(float(share))
    return place < F.least(F.ceil(share * F.lit(float(_RANGE))), F.lit(_RANGE))
