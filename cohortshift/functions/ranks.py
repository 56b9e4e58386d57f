"""Running totals and ranks that no single task has to compute for a whole key.

Values of a key are dealt into buckets by an approximate quantile sketch. Running totals are taken within a
bucket, and the totals of the buckets before it are added. A value lies in one bucket, so ties stay together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved

BUCKETS = 16


def with_bucket(df: DataFrame, keys: list[str], value: str = "value", buckets: int = BUCKETS, steady: bool = False) -> DataFrame:
    """Adds __bucket. A sketch of many values depends on the order in which its parts arrive; steady saves the bounds, so
    that every step which reads the result gets the same buckets."""
    cuts = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], F.lit(1000))
    bounds = df.groupBy(*keys).agg(cuts.alias("__cuts"))
    bounds = saved(bounds) if steady else bounds
    bucket = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    return df.join(bounds, keys).withColumn("__bucket", bucket).drop("__cuts")


def running_totals(df: DataFrame, keys: list[str], sums: dict[str, str], order: list[str], value: str = "value", steady: bool = False) -> DataFrame:
    """Adds for each name the sum of its column over the key's rows up to and with this one, and <name>_all."""
    df = with_bucket(df, keys, value, steady=steady)
    within = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(*keys, "__bucket").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    for n in sums:
        totals = totals.withColumn(f"__{n}_0", F.coalesce(F.sum(f"__{n}").over(before), F.lit(0))).withColumn(f"{n}_all", F.sum(f"__{n}").over(whole))
    local = df.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    out = local.join(totals.drop(*(f"__{n}" for n in sums)), [*keys, "__bucket"])
    return out.withColumns({n: F.col(n) + F.col(f"__{n}_0") for n in sums}).drop("__bucket", *(f"__{n}_0" for n in sums))


def following_min(df: DataFrame, keys: list[str], column: str, value: str = "value") -> DataFrame:
    """Replaces the column by its minimum over the key's rows of this value and of all larger ones."""
    df = with_bucket(df, keys, value, steady=True)
    back = Window.partitionBy(*keys, "__bucket").orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    lows = df.groupBy(*keys, "__bucket").agg(F.min(column).alias("__low")).withColumn("__low", F.min("__low").over(after))
    return df.withColumn(column, F.min(column).over(back)).join(lows, [*keys, "__bucket"]).withColumn(column, F.least(column, "__low")).drop("__bucket", "__low")


def value_counts(df: DataFrame, keys: list[str], counts: dict, value: str = "value") -> DataFrame:
    """One row per key and value, with conditional counts; pre-aggregated, so frequent values cost one row.

    The counts are saved: running totals read them three times, and the rows are read once.
    """
    return saved(df.groupBy(*keys, value).agg(*(F.count_if(c).alias(n) for n, c in counts.items())))


def value_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, value, name): the average rank of each distinct value within its key."""
    n = value_counts(df, keys, {"__n": F.lit(True)}, value)
    r = running_totals(n, keys, {"__c": "__n"}, [value], value) if keys else _global(n, value)
    return r.withColumn(name, F.col("__c") - (F.col("__n") - 1) / 2).select(*keys, value, name)


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the average rank of each row's value within its key."""
    return df.join(value_ranks(df, keys, value, name), [*keys, value])


def _global(n: DataFrame, value: str) -> DataFrame:
    return running_totals(n.withColumn("__k", F.lit(0)), ["__k"], {"__c": "__n"}, [value], value)


def auc(df: DataFrame, keys: list[str], label: str = "y", value: str = "value") -> DataFrame:
    """Mann-Whitney AUC of value for label 1, from counts of distinct values; null without both labels."""
    return count_auc(value_counts(df, keys, {"n1": F.col(label) == 1, "n0": F.col(label) == 0}, value), keys, value)


def count_auc(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The same from a table of (keys, value, n1, n0)."""
    r = running_totals(counts, keys, {"c0": "n0"}, [value], value)
    won = F.sum(F.col("n1") * (F.col("c0") - F.col("n0") / 2.0))
    return r.groupBy(*keys).agg(won.alias("__w"), F.sum("n1").alias("__n1"), F.sum("n0").alias("__n0")).select(*keys, F.try_divide(F.col("__w"), F.col("__n1").cast("double") * F.col("__n0")).alias("auc"))


def quantiles(df: DataFrame, keys: list[str], ks: list[int], base: int, value: str = "value") -> DataFrame:
    """(keys, k, q): exact k/base quantiles with linear interpolation, from running counts of distinct values."""
    return count_quantiles(value_counts(df, keys, {"__n": F.lit(True)}, value), keys, ks, base, value)


def count_quantiles(counts: DataFrame, keys: list[str], ks: list[int], base: int, value: str = "value") -> DataFrame:
    """The same from a table of (keys, value, __n).

    No task holds a key's values: the row of a value whose ranks cover a wanted position gives it away.
    """
    r = running_totals(counts, keys, {"__c": "__n"}, [value], value)
    last = F.col("__c_all") - 1
    # of the positions (n - 1) k / base, the integer part and the one after it
    wanted = F.array(*map(F.lit, ks))
    covers = lambda shift: F.filter(wanted, lambda k: (k * last >= (F.col("__c") - F.col("__n") - shift) * base) & (k * last < (F.col("__c") - shift) * base))
    dense = ks == list(range(ks[0], ks[-1] + 1))

    def places(shift):
        if not dense:
            return covers(shift)
        lo = F.greatest(F.lit(ks[0]), F.ceil(F.try_divide((F.col("__c") - F.col("__n") - shift) * float(base), last)))
        hi = F.least(F.lit(ks[-1]), F.floor(F.try_divide((F.col("__c") - shift) * float(base) - 1, last)))
        return F.when(last == 0, wanted if shift == 0 else F.expr("cast(array() as array<int>)")).when(lo <= hi, F.sequence(lo.cast("int"), hi.cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))

    def ends(shift, name):
        return F.transform(places(shift), lambda k: F.struct(k.alias("k"), F.lit(name).alias("end")))

    found = r.select(*keys, last.alias("last"), F.explode(F.concat(ends(0, "lo"), ends(1, "hi"))).alias("p"), F.col(value).alias("v")).select(*keys, "last", "p.k", "p.end", "v")
    g = found.groupBy(*keys, "k").agg(F.max("last").alias("last"), F.max(F.when(F.col("end") == "lo", F.col("v"))).alias("lo"), F.max(F.when(F.col("end") == "hi", F.col("v"))).alias("hi"))
    share = (F.col("k") * F.col("last") % base) / float(base)
    return g.select(*keys, "k", (F.col("lo") + share * (F.coalesce("hi", "lo") - F.col("lo"))).alias("q"))
