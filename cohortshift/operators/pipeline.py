"""The whole comparison of two cohorts, from unpivoted values to a verdict for each feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import saved
from . import drift as D
from . import kernels as N
from . import profile as P


def profiles(long: DataFrame, levels: DataFrame) -> DataFrame:
    """(cohort, feature, detected_type, scale, sentinel_value, zero_inflated): a saved row for each cohort and feature."""
    stats = saved(P.basic(long, levels))
    types = P.select_scale(levels, P.detect_type(stats, P.minimum_mass(levels, stats)))
    return saved(types.select(*P.KEYS, "detected_type", "scale", "sentinel_value", "zero_inflated"))


def found_modes(long: DataFrame, prof: DataFrame) -> DataFrame:
    """(cohort, feature, log_scale, n_modes, modes), saved; log_scale is cohort A's, in whose space modes are matched."""
    a = prof.where("cohort = 'A'").select("feature", F.col("scale").isin(*N.LOG_SCALES).alias("log_scale"))
    m = N.modes(long, P.KEYS, profile=prof).join(a, "feature", "left")
    return saved(m.withColumn("log_scale", F.coalesce("log_scale", F.lit(False))))


def comparison_plan(prof: DataFrame, found: DataFrame) -> DataFrame:
    """The plan of the features that both cohorts have; those without a mode count as unimodal."""
    p = prof.join(found.select(*P.KEYS, "n_modes"), P.KEYS, "left").withColumn("n_modes", F.coalesce("n_modes", F.lit(1)))
    names = {"detected_type": "type", "scale": "scale", "n_modes": "modes", "zero_inflated": "zero"}
    side = lambda c: p.where(F.col("cohort") == c).select("feature", *(F.col(k).alias(f"{v}_{c.lower()}") for k, v in names.items()))
    return D.plan(side("A").join(side("B"), "feature").withColumn("zero_inflated", F.col("zero_a") | F.col("zero_b")))


CONTINUOUS = ["wasserstein_qn", "mmd", "energy_distance", "anderson_darling", "ks_statistic"]


def battery(long: DataFrame, plan: DataFrame) -> DataFrame:
    """(feature, metric, raw, null_floor) of the metric family that the plan names: counts for nominal features, ranks
    and a kernel for continuous ones. Raw values that counts give are of all rows."""
    of = lambda f: long.join(plan.where(F.col("metric_family") == f).select("feature"), "feature", "left_semi")
    nominal, rest = of("nominal"), of("continuous")
    js = N.distances(nominal, ["jensen_shannon"]).join(D.jensen_shannon(nominal), "feature", "left")
    js = js.select("feature", "metric", F.coalesce("jensen_shannon", "raw").alias("raw"), "null_floor")
    ranked = N.distances(rest, CONTINUOUS, scales=plan).join(D.exact_distances(rest), ["feature", "metric"], "left")
    return js.unionByName(ranked.select("feature", "metric", F.coalesce("exact", "raw").alias("raw"), "null_floor"))


def record(long: DataFrame) -> DataFrame:
    """What the comparison says of each planned feature: the primary distance of its route with its null, how far the zero
    mass and matched modes move, and shift, the magnitude that the route reads. Parts that a route has not are null."""
    levels = P.counts(long)
    prof = profiles(long, levels)
    found = found_modes(long, prof)
    plan = saved(comparison_plan(prof, found))
    split = long.join(plan.where("zero_mass_separate").select("feature"), "feature", "left_semi")
    matched = plan.where("comparison_mode = 'per_mode'").select("feature")
    shifts = D.per_mode(long.join(matched, "feature", "left_semi"), found.join(matched, "feature", "left_semi")).groupBy("feature").agg(F.max("wasserstein_qn").alias("max_mode_shift"), F.max("mass_shift").alias("max_mass_shift"))
    b = saved(battery(long, plan))
    raw = lambda m: F.max(F.when(F.col("metric") == m, F.col("raw")))
    wide = b.groupBy("feature").agg(raw("jensen_shannon").alias("js"), raw("wasserstein_qn").alias("w"))
    primary = b.withColumnsRenamed({"metric": "corroboration_primary"}).withColumn("excess", D.calibrate_excess(F.col("raw"), F.col("null_floor")))
    out = plan.join(primary, ["feature", "corroboration_primary"], "left").join(wide, "feature", "left").join(D.zero_mass(split), "feature", "left").join(shifts, "feature", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shift = D.shift_magnitude(
        F.col("js"), F.col("w"), zero("tail_wasserstein"), zero("zero_delta"), zero("max_mode_shift"),
        F.col("metric_family") == "nominal", F.col("zero_mass_separate"), F.col("comparison_mode") == "per_mode",
    )
    names = ["feature", "route", "scale", "corroboration_primary", "raw", "null_floor", "excess", "zero_delta", "tail_wasserstein", "max_mode_shift", "max_mass_shift"]
    return out.select(*names, shift.alias("shift"))


def verdicts(long: DataFrame) -> DataFrame:
    """(feature, route, verdict, calibrated, stability, emerged): profiles of both cohorts, plan, tests, verdict.

    All joins after the profiles are between tables of a row for each feature and cohort.
    """
    levels = P.counts(long)
    prof = profiles(long, levels)
    sep = P.separation(long, levels=levels).join(N.mutual_information(long, P.KEYS), P.KEYS).join(N.separation_nulls(long), P.KEYS)
    # both cohorts' sides read the separations
    sep = saved(sep).withColumn("separated", D.separated(F.col("magnitude"), F.col("mi_normalized"), F.col("auc_null"), F.col("mi_null")))
    names = {"magnitude": "sep", "mi_normalized": "mi", "direction": "dir", "separated": "is"}
    side = lambda c: sep.where(F.col("cohort") == c).select("feature", *(F.col(k).alias(f"{v}_{c.lower()}") for k, v in names.items()))
    tested = N.c2st(long).where("slice = 'pooled'").select("feature", D.calibrate_c2st(F.col("auc"), F.col("null_floor")).alias("calibrated"))
    p = comparison_plan(prof, found_modes(long, prof)).join(side("A"), "feature").join(side("B"), "feature").join(tested, "feature", "left")
    v = D.verdict(F.col("is_a"), F.col("is_b"), F.col("dir_a"), F.col("dir_b"), F.col("route"), F.col("calibrated"))
    unit = lambda c: F.least(F.greatest(D.strength(F.col(f"sep_{c}"), F.col(f"mi_{c}")), F.lit(0.0)), F.lit(1.0))
    out = p.withColumn("verdict", v)
    return out.select("feature", "route", "verdict", "calibrated", (F.when(F.col("verdict") == "flipped", -1.0).otherwise(1.0) * unit("a") * unit("b")).alias("stability"), D.emerged(F.col("is_a"), F.col("is_b")).alias("emerged"))
