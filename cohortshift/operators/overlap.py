"""Semi and anti joins of rows, and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _narrow(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as float, so that both sides have the same representation, under names of their own."""
    return df.select(*(F.col(c).cast("float").alias(f"__{c}") for c in columns)).distinct().withColumn("__seen", F.lit(True))


def flag_overlap(test: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """test with overlap: whether its features occur in train."""
    keyed = test.withColumns({f"__{c}": F.col(c).cast("float") for c in columns})
    keys = [f"__{c}" for c in columns]
    out = keyed.join(_narrow(train, columns), keys, "left")
    return out.withColumn("overlap", F.coalesce("__seen", F.lit(False))).drop(*keys, "__seen")


def overlap_free(test: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    keys = [f"__{c}" for c in columns]
    keyed = test.withColumns({f"__{c}": F.col(c).cast("float") for c in columns})
    return keyed.join(_narrow(train, columns), keys, "left_anti").drop(*keys)


def set_sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of the intersection and of both differences, in one aggregate."""
    both = a.distinct().withColumn("s", F.lit(1)).union(b.distinct().withColumn("s", F.lit(2)))
    side = both.groupBy(a.columns[0]).agg(F.sum("s").alias("s"))
    n = side.agg(*(F.count_if(F.col("s") == v).alias(k) for v, k in ((3, "both"), (1, "only_a"), (2, "only_b"))))
    return n.selectExpr("stack(3, 'both', both, 'only_a', only_a, 'only_b', only_b) AS (side, n)")
