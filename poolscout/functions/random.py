"""Random numbers as a pure function of a row's identifier.

``rand()`` depends on partitioning and changes when a lost task is recomputed; a hash of the identifier does not.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX_DIGITS = 13
_RANGE = float(1 << (4 * _HEX_DIGITS))


def uniform(id_col: Column, seed: int) -> Column:
    """Uniform number in [0, 1) for every identifier."""
    digest = F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(digest, 1, _HEX_DIGITS), 16, 10).cast("double") / F.lit(_RANGE)


def uniform_value(key: int, seed: int) -> float:
    """The same number for one key, without Spark."""
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:_HEX_DIGITS], 16) / _RANGE


def normal(id_col: Column, seed: int) -> Column:
    """Standard normal number for every identifier (Box-Muller on two uniforms)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(id_col, seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(id_col, seed + 1))
