"""Deterministic randomness: uniforms and seeds derived from SHA-256.

The same key always gives the same draw on any executor and after any retry, which a
``rand()`` column does not promise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def _col(part) -> Column:
    return part if isinstance(part, Column) else F.lit(str(part))


def hash32(*parts, separator: str = SEPARATOR) -> Column:
    """First eight hex digits of SHA-256 of the joined parts, as a BIGINT in [0, 2^32)."""
    joined = F.concat_ws(separator, *[_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """Uniform in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def stable_seed(*parts) -> Column:
    """Seed of an ordered tuple of parts, separated by the unit separator."""
    return hash32(*parts, separator="\u001f")
