"""Feature profiles: one row per cohort and feature, from the view that is unpivoted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, IDENTIFIERS_DRIFT, NONNEGATIVE_HINTS, SENTINEL_FEATURES
from ..functions.ranks import auc, count_auc, count_quantiles, quantiles, value_counts
from ..sources.files import saved

KEYS = ["cohort", "feature"]
GRID = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def finite_rows(long: DataFrame) -> DataFrame:
    return long.where("value is not null and not isnan(value) and abs(value) <> double('infinity')")


def _wide(q: DataFrame, names: dict[int, str]) -> DataFrame:
    """Quantile rows as columns."""
    return q.groupBy(*KEYS).agg(*(F.max(F.when(F.col("k") == k, F.col("q"))).alias(n) for k, n in names.items()))


def counts(long: DataFrame) -> DataFrame:
    """(cohort, feature, value, __n, n1, n0): finite values, how often they occur, and with which label; saved."""
    return value_counts(finite_rows(long), KEYS, {"__n": F.lit(True), "n1": F.col("y") == 1, "n0": F.col("y") == 0})


def basic(long: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Mergeable moments in one pass; quartiles and levels from counts(), given or made here."""
    levels = counts(long) if levels is None else levels
    v = F.when(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    out = long.select(*KEYS, v.alias("value")).groupBy(*KEYS).agg(
        F.count("value").alias("n"), F.count_if(F.col("value") == 0).alias("n_zero"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"),
        F.count_if(F.col("value") != F.round("value")).alias("n_fraction"), F.count("*").alias("n_total"),
    ).where("n > 0")
    unique = levels.groupBy(*KEYS).agg(F.count("*").alias("n_unique"))
    quartiles = _wide(count_quantiles(levels, KEYS, [1, 2, 3], 4), {1: "p25", 2: "median", 3: "p75"})
    out = out.join(unique, KEYS).join(quartiles, KEYS).withColumn("n_missing", F.col("n_total") - F.col("n"))
    return out.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("p75") - F.col("p25"), "zero_fraction": F.col("n_zero") / F.col("n_total"), "cv": F.coalesce(F.try_divide("std", F.abs("mean")), F.lit(0.0))})


def mad(long: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """Median absolute deviation, from the counts of distinct values and of their distances to the median."""
    levels = counts(long) if levels is None else levels
    median = _wide(count_quantiles(levels, KEYS, [1], 2), {1: "median"})
    away = levels.join(median, KEYS).groupBy(*KEYS, F.abs(F.col("value") - F.col("median")).alias("value")).agg(F.sum("__n").alias("__n"))
    return _wide(count_quantiles(saved(away), KEYS, [1], 2), {1: "mad"})


def percentiles(long: DataFrame, grid: list[int] = GRID) -> DataFrame:
    """(cohort, feature, place, q): exact percentiles, by linear interpolation."""
    place = F.array_position(F.array(*map(F.lit, grid)), F.col("k")) - 1
    return quantiles(finite_rows(long), KEYS, grid, 100).select(*KEYS, place.cast("int").alias("place"), "q")


def entropy(long: DataFrame, bins: int = CONFIG.entropy_bins) -> DataFrame:
    """Shannon entropy in bits of equal-width bins between minimum and maximum; the last bin is closed."""
    rows = finite_rows(long)
    span = rows.groupBy(*KEYS).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    n = rows.join(span, KEYS).groupBy(*KEYS, at.alias("bin")).agg(F.count("*").alias("n"))
    # -sum p log2 p = log2 N - sum n log2 n / N
    return n.groupBy(*KEYS).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def outliers(long: DataFrame, stats: DataFrame, k: float = CONFIG.tukey) -> DataFrame:
    rows = finite_rows(long).join(stats.select(*KEYS, "p25", "p75", "iqr", "n_total"), KEYS)
    low, high = F.count_if(F.col("value") < F.col("p25") - k * F.col("iqr")), F.count_if(F.col("value") > F.col("p75") + k * F.col("iqr"))
    out = rows.groupBy(*KEYS).agg(low.alias("n_low"), high.alias("n_high"), F.max("n_total").alias("t"))
    return out.select(*KEYS, "n_low", "n_high", ((F.col("n_low") + F.col("n_high")) / F.col("t")).alias("fraction"))


def view_range(long: DataFrame, lo: float = CONFIG.view_low, hi: float = CONFIG.view_high) -> DataFrame:
    """Robust display range and how many values lie outside; an empty range gets width 1."""
    rows = finite_rows(long)
    q = _wide(quantiles(rows, KEYS, [round(lo * 1000), round(hi * 1000)], 1000), {round(lo * 1000): "view_low", round(hi * 1000): "high"})
    q = q.select(*KEYS, "view_low", F.when(F.col("high") > F.col("view_low"), F.col("high")).otherwise(F.col("view_low") + 1).alias("view_high"))
    return rows.join(q, KEYS).groupBy(*KEYS, "view_low", "view_high").agg(F.count_if(F.col("value") < F.col("view_low")).alias("n_clipped_low"), F.count_if(F.col("value") > F.col("view_high")).alias("n_clipped_high"))


def minimum_mass(levels: DataFrame, stats: DataFrame) -> DataFrame:
    """(cohort, feature, n_min): how often the minimum occurs, from counts()."""
    least = F.col("value") == F.col("min")
    return levels.join(stats.select(*KEYS, "min"), KEYS).groupBy(*KEYS).agg(F.sum(F.when(least, F.col("__n")).otherwise(0)).alias("n_min"))


def detect_type(stats: DataFrame, masses: DataFrame) -> DataFrame:
    """detected_type and flags from the aggregates of basic() and minimum_mass()."""
    name, whole = F.lower("feature"), F.col("n_fraction") == 0
    plain = name.isin(*IDENTIFIERS_DRIFT, "dst port", "protocol")
    sentinel = ~plain & (F.col("min") < 0) & (name.isin(*SENTINEL_FEATURES) | whole & (F.col("n_min") > F.col("n_total") * CONFIG.sentinel_mass))
    hinted = name.rlike("|".join(NONNEGATIVE_HINTS))
    kind = (
        F.when(name.isin(*IDENTIFIERS_DRIFT), "identifier").when(name.isin("dst port", "protocol"), "nominal").when(F.col("n_unique") <= 2, "binary")
        .when(F.col("n_unique") <= CONFIG.nominal_levels, "low-cardinality-discrete").when(whole & (F.col("n_unique") <= CONFIG.discrete_levels), "discrete-count").otherwise("continuous")
    )
    return stats.join(masses, KEYS).withColumns({
        "detected_type": kind, "zero_inflated": ~plain & (F.col("zero_fraction") >= CONFIG.zero_inflation), "has_sentinel": sentinel,
        "sentinel_value": F.when(sentinel, F.col("min")), "has_impossible": ~plain & (F.col("min") < 0) & ~sentinel & hinted, "degenerate": F.col("n_unique") <= 1,
    })


def select_scale(levels: DataFrame, types: DataFrame) -> DataFrame:
    """recommended_scale, from counts(), and the threshold of a symlog scale: the 10 % quantile of non-zero magnitudes."""
    v = F.col("value")
    low_n = F.sum(F.when(v <= 0, F.col("__n")).otherwise(0))
    s = levels.groupBy(*KEYS).agg(F.min(F.when(v > 0, v)).alias("least"), F.max(F.when(v > 0, v)).alias("most"), low_n.alias("n_low"))
    sizes = saved(levels.where("value <> 0").groupBy(*KEYS, F.abs("value").alias("value")).agg(F.sum("__n").alias("__n")))
    low = count_quantiles(sizes, KEYS, [1], 10)
    s = s.join(_wide(low, {1: "thr"}), KEYS, "left")
    scale = (
        F.when(F.col("detected_type") != "continuous", "categorical").when(F.col("zero_inflated") | (F.col("n_low") > 0), "symlog")
        .when(F.try_divide("most", "least") > CONFIG.log_ratio, "log").otherwise("linear")
    )
    out = types.join(s, KEYS).withColumn("scale", scale)
    return out.withColumn("scale_param", F.when(F.col("scale") == "symlog", F.greatest(F.coalesce("thr", F.lit(1.0)), F.lit(1e-9))))


def direction(a: Column) -> Column:
    return F.when(F.abs(a - 0.5) >= CONFIG.auc_deadband, F.signum(a - 0.5)).otherwise(0.0)


def separation(long: DataFrame, keys: list[str] = KEYS, levels: DataFrame | None = None) -> DataFrame:
    """Raw and folded AUC of each feature for the label, and its direction with a deadband."""
    a = auc(finite_rows(long), keys) if levels is None else count_auc(levels, keys)
    a = a.withColumn("auc", F.coalesce("auc", F.lit(0.5)))
    return a.select(*keys, F.col("auc").alias("auc_raw"), F.greatest(F.col("auc"), 1 - F.col("auc")).alias("magnitude"), direction(F.col("auc")).alias("direction"))


def family_separation(long: DataFrame) -> DataFrame:
    """The same for each attack family against Benign; Benign rows go to each family, whose number is fixed."""
    families = [r[0] for r in long.select("family").where("family <> 'Benign'").distinct().collect()]
    pairs = long.withColumn("against", F.explode(F.when(F.col("family") == "Benign", F.array(*map(F.lit, families))).otherwise(F.array("family"))))
    return separation(pairs, [*KEYS, "against"])
