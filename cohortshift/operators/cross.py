"""Cross analysis: one row per feature with importances, drift and separation of both cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LISTINGS = {"importance": ("imp_a", True), "most_shifted": ("cal", True), "least_shifted": ("cal", False), "most_stable": ("stab", True), "least_stable": ("stab", False), "permutation": ("perm_a", True)}


def place(c: str, descending: bool = True, tie: str = "feature") -> Column:
    """1 for the first; nulls last, ties by name."""
    order = F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last()
    return F.row_number().over(Window.orderBy(order, tie))


def ranked_listings(features: DataFrame) -> DataFrame:
    """(listing, feature, place) for six orderings of the feature table, whose rows are as few as columns."""
    out = None
    for name, (c, down) in LISTINGS.items():
        part = features.select(F.lit(name).alias("listing"), "feature", place(c, down).alias("place"))
        out = part if out is None else out.unionByName(part)
    return out


def prior_shift(rows: DataFrame) -> DataFrame:
    """Attack rates of both cohorts and how severely they differ."""
    p = rows.agg(F.avg(F.when(F.col("cohort") == "A", F.col("y"))).alias("a"), F.avg(F.when(F.col("cohort") == "B", F.col("y"))).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return p.select(F.round("a", 6).alias("p_a"), F.round("b", 6).alias("p_b"), F.when(gap > 0.10, "LARGE").when(gap > 0.05, "MODERATE").otherwise("SMALL").alias("severity"))


def cross_table(imp_a: DataFrame, imp_b: DataFrame, drift: DataFrame) -> DataFrame:
    """Features with importances of both cohorts and a verdict, with their ranks; one row per feature."""
    t = imp_a.join(imp_b, "feature").join(drift, "feature")
    return t.withColumn("rank_a", place("imp_a")).withColumn("rank_b", place("imp_b")).withColumn("rank_delta", F.col("rank_a") - F.col("rank_b"))


def axis1_level(calibrated: Column) -> Column:
    return F.when(calibrated.isNull(), "n/a").when(calibrated <= 0, "NONE").when(calibrated <= 0.20, "LOW").when(calibrated <= 0.45, "MODERATE").when(calibrated <= 0.70, "HIGH").otherwise("STRONG")


def axis2_level(stability: Column) -> Column:
    return F.when(stability.isNull(), "n/a").when(stability < 0, "FLIPPED").when(stability < 0.09, "COLLAPSED").when(stability < 0.35, "WEAKENED").otherwise("PRESERVED")


def quadrants(features: DataFrame, importance: str = "imp_a", stability: str = "stab") -> DataFrame:
    """Median splits of importance and stability; features without an importance have no quadrant."""
    m = features.where(F.col(importance).isNotNull() & F.col(stability).isNotNull()).agg(F.median(importance), F.median(stability)).first()
    hi, st = F.col(importance) >= F.lit(m[0]), F.col(stability) >= F.lit(m[1])
    q = F.when(hi & st, "Q1_good").when(hi & ~st, "Q2_fragile_shortcut").when(~hi & ~st, "Q3_noise").when(~hi & st, "Q4_underused_stable")
    return features.withColumn("quadrant", q)


def support_state(rho: Column, lo: Column, hi: Column, expect_positive: bool) -> Column:
    excludes, right = (lo > 0) | (hi < 0), (rho > 0) if expect_positive else (rho < 0)
    return F.when(rho.isNull(), "indeterminate").when(right & excludes, "supported").when(excludes & ~right, "contradicted").otherwise("weak")


def strength_level(rho: Column) -> Column:
    return F.when(F.abs(rho) < 0.05, "negligible").when(F.abs(rho) >= 0.5, "strong").when(F.abs(rho) >= 0.3, "moderate").otherwise("weak")


def family_rollup(rows: DataFrame) -> DataFrame:
    """Median stability and shift, and the share of stable features, of each family and of all."""
    g = rows.groupingSets([["family"], []], "family").agg(F.count("stab").alias("n"), F.median("stab").alias("stab"), F.median("cal").alias("shift"), F.avg((F.col("stab") > 0.5).cast("double")).alias("stable"))
    return g.withColumn("family", F.coalesce("family", F.lit("ALL/POOLED")))


def drivers(features: DataFrame) -> DataFrame:
    """How many features each side drives, mean shifts, and which side dominates by a fifth."""
    a = features.agg(F.count_if(F.col("benign") > F.col("attack")).alias("n_benign"), F.count_if(F.col("benign") <= F.col("attack")).alias("n_attack"), F.avg("benign").alias("b"), F.avg("attack").alias("a"))
    word = F.when(F.col("a") > F.col("b") * 1.2, "attack").when(F.col("b") > F.col("a") * 1.2, "benign").otherwise("both")
    return a.select("n_benign", "n_attack", F.round("b", 6).alias("mean_benign"), F.round("a", 6).alias("mean_attack"), word.alias("dominant"))


def dominant_slice(features: DataFrame, slices: list[str]) -> DataFrame:
    """The slice with the highest value; ties by the order given; none if all are null."""
    best = F.array_sort(F.array_compact(F.array(*(F.when(F.col(s).isNotNull(), F.struct((-F.col(s)).alias("v"), F.lit(i).alias("i"), F.lit(s).alias("s"))) for i, s in enumerate(slices)))))
    return features.select("feature", F.coalesce(F.get(best, F.lit(0))["s"], F.lit("none")).alias("slice"))


def mi_preservation(features: DataFrame) -> DataFrame:
    """Whether the signal of cohort A is at least half there in B, by quadrant."""
    q = quadrants(features)
    signal = F.col("mi_a") > 0.01
    kept = F.col("mi_b") >= 0.5 * F.col("mi_a")
    return q.groupBy(F.coalesce("quadrant", F.lit("none")).alias("quadrant")).agg(F.count_if(signal & kept).alias("n_survived"), F.count_if(signal & ~kept).alias("n_lost"), F.avg(F.col("mi_a") - F.col("mi_b")).alias("mean_drop"))


def peak_k(runs: DataFrame) -> DataFrame:
    """The best K of each policy and direction (means over seeds, smallest K of equals), and whether it is inside the grid."""
    m = runs.groupBy("policy", "direction", "kk").agg(F.round(F.avg("f1"), 9).alias("f1"))
    w = Window.partitionBy("policy", "direction").orderBy("kk")
    m = m.withColumn("prev", F.lag("kk").over(w)).withColumn("next", F.lead("kk").over(w))
    best = m.groupBy("policy", "direction").agg(F.min(F.struct((-F.col("f1")).alias("f"), "kk", "prev", "next")).alias("b"))
    inside = F.col("b.prev").isNotNull() & F.col("b.next").isNotNull()
    return best.select("policy", "direction", F.col("b.kk").alias("peak_k"), F.round(-F.col("b.f"), 6).alias("f1"), inside.alias("is_interior"), F.when(inside, F.concat_ws("-", "b.prev", "b.next")).otherwise("at boundary").alias("window"))


def top_bottom(features: DataFrame, k: int = 10) -> DataFrame:
    """Mean and median shift of the k most and least important features and of those between."""
    r = features.where("imp_a is not null and cal is not null").withColumn("r", place("imp_a")).withColumn("n", F.count("*").over(Window.partitionBy()))
    part = F.when(F.col("r") <= k, "top").when(F.col("r") > F.col("n") - k, "bottom").otherwise("mid")
    return r.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("cal"), 6).alias("mean_cal"), F.round(F.median("cal"), 6).alias("median_cal"))


def exposure(features: DataFrame) -> DataFrame:
    """Importance-weighted mean shift."""
    return features.where("imp_a is not null and cal is not null").agg(F.round(F.try_divide(F.sum(F.col("imp_a") * F.col("cal")), F.sum("imp_a")), 6).alias("exposure"))


def thin(curve: DataFrame, by: str, points: int) -> DataFrame:
    """Every n div points-th point of a curve and the last; numbers come from counts of ranges, not from one task."""
    from ..functions.ranks import running_totals

    r = running_totals(curve.select(by, F.lit(1).alias("__one"), F.lit(0).alias("__k")), ["__k"], {"c": "__one"}, [by], by).withColumn("i", F.col("c") - 1)
    return r.where((F.col("i") % F.greatest(F.lit(1), F.expr(f"c_all div {points}")) == 0) | (F.col("c") == F.col("c_all"))).select(by, "i")
