"""Region predicates Spark can push to the scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_regions(regions: Sequence[tuple[str, int | None, int | None]], chrom: str = "chrom", pos: str = "pos") -> Column:
    """True inside any of (chrom, first, last); open ends are ``None``."""
    out = F.lit(False)
    for name, first, last in regions:
        part = F.col(chrom) == name
        if first is not None:
            part = part & (F.col(pos) >= first)
        if last is not None:
            part = part & (F.col(pos) <= last)
        out = out | part
    return out
