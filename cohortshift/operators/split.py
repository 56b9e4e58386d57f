"""Deterministic samples and splits, by hashes of keys and by running numbers within classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG


def hash_uniform(key: Column, seed: int = CONFIG.seed) -> Column:
    """A uniform number in [0, 1) from the first 32 bits of an md5; the same in any engine."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def spearman_rows(n: int) -> int:
    """Rows for rank correlation: all up to 6.5 million, else 6 million."""
    return n if n <= 6_500_000 else 6_000_000


def bernoulli(df: DataFrame, key: Column, rate: float, seed: int = CONFIG.seed) -> DataFrame:
    return df.where(hash_uniform(key, seed) < rate)


def running_index(df: DataFrame, by: list[str], order: list[str], name: str = "g", buckets: int | None = None) -> DataFrame:
    """Numbers a class's rows from 0 in the given order, without a task that holds a class.

    Rows are dealt into ranges of the first order column, one for each shuffle partition; they are numbered within
    (class, range), and the counts of the ranges before, a row for each, are added. Nulls are the first range.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.agg(F.percentile_approx(order[0], [i / buckets for i in range(1, buckets)] or [0.5], F.lit(1000)).alias("c")).first()["c"]
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [])))), lambda c: c < F.col(order[0])))
    df = df.withColumn("__at", F.when(F.col(order[0]).isNull(), -1).otherwise(at))
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(*by, "__at").orderBy(*order)).cast("long") - 1)
    before = Window.partitionBy(*by).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(*by, "__at").agg(F.count("*").alias("__n"))
    offsets = sizes.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__at").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__0"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by] + [F.col("__at") == F.col("__of")]
    out = local.join(offsets, same).withColumn(name, F.col(name) + F.col("__0"))
    return out.drop("__at", "__of", "__0", *(f"__{c}" for c in by))


def systematic_split(df: DataFrame, code: str, order: list[str], seed: int = CONFIG.seed) -> DataFrame:
    """split is test for running numbers g with (g + phase) % 1000 < 200; the phase depends on class and seed."""
    df = running_index(df, [code], order)
    phase = (F.col(code) * CONFIG.split_phase + seed) % CONFIG.split_modulus
    return df.withColumn("split", F.when((F.col("g") + phase) % CONFIG.split_modulus < CONFIG.split_test, "test").otherwise("train"))


def stride_cap(df: DataFrame, by: str, order: list[str], cap: int) -> DataFrame:
    """Every n div cap-th row of a class, up to cap: the rows numbered 0, step, ... below cap steps."""
    sizes = df.groupBy(by).agg(F.count("*").alias("__n")).select(F.col(by).alias("__by"), "__n")
    df = running_index(df, [by], order).join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    step = F.greatest(F.lit(1), F.expr(f"__n div {cap}"))
    return df.where((F.col("g") % step == 0) & (F.col("g") < step * cap)).drop("__by", "__n", "g")


def random_cap(df: DataFrame, by: list[str], key: Column, cap: int, seed: int = CONFIG.seed, few_groups: bool = False) -> DataFrame:
    """At most cap rows of each group, by smallest hash.

    A group's size tells how small a hash must be to be among its cap smallest, with a margin of eight standard
    deviations; so only about cap rows of a group are sorted, wherever they are. few_groups says that the
    schema bounds the groups (features, cohorts, labels): their sizes are then broadcast.
    """
    sizes = df.groupBy(*by).agg(F.count("*").alias("__n"))
    df = df.withColumn("__h", F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))).join(F.broadcast(sizes) if few_groups else sizes, by)
    uniform = F.conv(F.substring("__h", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    df = df.where(uniform * F.col("__n") <= cap + 8 * cap**0.5 + 8)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h"))).where(F.col("__r") <= cap).drop("__h", "__r", "__n")


def feature_seed(name: Column) -> Column:
    return F.crc32(name)


def scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One row per feature: mean and population deviation, 1 where it is 0; a mergeable aggregate."""
    aggs = [a for f in features for a in (F.avg(f).alias(f"{f}__m"), F.stddev_pop(f).alias(f"{f}__s"))]
    row = df.agg(*aggs)
    return row.selectExpr(f"stack({len(features)}, " + ", ".join(f"'{f}', `{f}__m`, if(`{f}__s` = 0, 1e0, `{f}__s`)" for f in features) + ") AS (feature, mean, scale)")


def scale(df: DataFrame, features: list[str], params: DataFrame) -> DataFrame:
    """z-scores as float; the parameters, one row per column, become literals."""
    known = {r["feature"]: (r["mean"], r["scale"]) for r in params.collect()}
    return df.withColumns({f: ((F.col(f) - F.lit(known[f][0])) / F.lit(known[f][1])).cast("float") for f in features})


def rebase(z: Column, mean_from: Column, scale_from: Column, mean_to: Column, scale_to: Column) -> Column:
    """A z-score of one scaler as one of another; a scale of 0 counts as 1."""
    return (z * scale_from + mean_from - mean_to) / F.when(scale_to == 0, F.lit(1.0)).otherwise(scale_to)
