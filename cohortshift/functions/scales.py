"""Scalar functions: axis scales and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_scale(c: Column, scale: str) -> Column:
    if scale == "symlog":
        return F.signum(c) * F.log1p(F.abs(c))
    if scale == "log":
        return F.log10(F.when(c > 0, c))
    return F.asinh(c) if scale == "arcsinh" else c


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def human_size(n: Column) -> Column:
    out = F.concat(F.floor(n / 1048576), F.lit(" MB"))
    return F.when(n < 1024, F.concat(n, F.lit(" B"))).when(n < 1048576, F.concat(F.floor(n / 1024), F.lit(" KB"))).otherwise(out)
