"""Two-sample drift of features between cohorts A and B, from pooled order, counts and quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, ROUTES, SCALE_ORDER, TYPE_ORDER
from ..functions.ranks import quantiles, running_totals, value_counts
from .profile import finite_rows

def _sides() -> dict:
    return {"n_a": F.col("cohort") == "A", "n_b": F.col("cohort") == "B"}


def _linear_sums(a: Column, s: Column, m: Column) -> tuple[Column, Column]:
    """Sums of |a + i s| and of (a + i s)^2 over i = 1..m, in closed form; s is not 0 where m is over 0."""
    m = m.cast("double")
    ends = lambda k: k * a + s * k * (k + 1) / 2
    turn = F.least(F.greatest(F.floor(F.coalesce(F.try_divide(-a, s), F.lit(0.0))).cast("double"), F.lit(0.0)), m)
    return F.abs(ends(turn)) + F.abs(ends(m) - ends(turn)), m * a * a + a * s * m * (m + 1) + s * s * m * (m + 1) * (2 * m + 1) / 6


def rank_distances(long: DataFrame, key: str = "feature") -> DataFrame:
    """(feature, wasserstein_qn, energy): on pooled ordinal ranks, ties A first, without pairs.

    Equal values are one row with two counts, whose ranks are summed in closed form, so frequent values cost nothing.
    """
    c = value_counts(finite_rows(long), [key], _sides())
    r = running_totals(c, [key], {"ca": "n_a", "cb": "n_b"}, ["value"])
    one_a, one_b = F.coalesce(F.try_divide(F.lit(1.0), F.col("ca_all")), F.lit(0.0)), F.coalesce(F.try_divide(F.lit(1.0), F.col("cb_all")), F.lit(0.0))
    before = (F.col("ca") - F.col("n_a")) * one_a - (F.col("cb") - F.col("n_b")) * one_b
    wa, ea = _linear_sums(before, one_a, F.col("n_a"))
    wb, eb = _linear_sums(before + F.col("n_a") * one_a, -one_b, F.col("n_b"))
    steps = F.max(F.col("ca_all") + F.col("cb_all")) - 1
    out = r.groupBy(key).agg(F.sum(wa + wb).alias("w"), F.sum(ea + eb).alias("e"), steps.alias("steps"), F.max("ca_all").alias("na"), F.max("cb_all").alias("nb"))
    there = (F.col("na") > 0) & (F.col("nb") > 0)
    return out.select(key, F.when(there, F.try_divide("w", "steps")).otherwise(0.0).alias("wasserstein_qn"), F.when(there, F.try_divide(2 * F.col("e"), "steps")).otherwise(0.0).alias("energy"))


def average_rank_wasserstein(long: DataFrame) -> DataFrame:
    """The same distance with tied values at one average rank, so equal samples are at distance 0."""
    c = value_counts(finite_rows(long), ["feature"], _sides())
    r = running_totals(c.withColumn("n", F.col("n_a") + F.col("n_b")), ["feature"], {"ca": "n_a", "cb": "n_b", "c": "n"}, ["value"])
    rank = F.col("c") - (F.col("n") - 1) / 2
    step = F.lead(rank).over(Window.partitionBy("feature").orderBy("value")) - rank
    gap = F.abs(F.try_divide("ca", "ca_all") - F.try_divide("cb", "cb_all"))
    return r.withColumn("g", gap * step / F.greatest(F.col("c_all") - 1, F.lit(1))).groupBy("feature").agg(F.coalesce(F.sum("g"), F.lit(0.0)).alias("wasserstein_avg"))


def ks(long: DataFrame) -> DataFrame:
    c = value_counts(finite_rows(long), ["feature"], _sides())
    r = running_totals(c, ["feature"], {"ca": "n_a", "cb": "n_b"}, ["value"])
    return r.groupBy("feature").agg(F.max(F.abs(F.try_divide("ca", "ca_all") - F.try_divide("cb", "cb_all"))).alias("ks"))


def exact_distances(long: DataFrame) -> DataFrame:
    """(feature, metric, exact): the distances that counts of all rows give."""
    d = rank_distances(long).join(ks(long), "feature")
    names = {"wasserstein_qn": "wasserstein_qn", "energy_distance": "energy", "ks_statistic": "ks"}
    return d.select("feature", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("exact")) for m, c in names.items()))).alias("m")).select("feature", "m.metric", "m.exact")


def jensen_shannon(long: DataFrame, top: int = CONFIG.js_top) -> DataFrame:
    """Distance (the root, in nats) of the distributions over the most frequent values and the rest."""
    c = value_counts(finite_rows(long), ["feature"], _sides())
    order = Window.partitionBy("feature").orderBy(F.desc(F.col("n_a") + F.col("n_b")), "value")
    best = c.withColumn("k", F.row_number().over(order)).where(F.col("k") <= top)
    all_ = c.groupBy("feature").agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"))
    shown = best.groupBy("feature").agg(F.sum("n_a").alias("s_a"), F.sum("n_b").alias("s_b"))
    rest = all_.join(shown, "feature").select("feature", (F.col("t_a") - F.col("s_a")).alias("n_a"), (F.col("t_b") - F.col("s_b")).alias("n_b"))
    p = best.select("feature", "n_a", "n_b").unionByName(rest).join(all_, "feature").select("feature", F.try_divide("n_a", "t_a").alias("p"), F.try_divide("n_b", "t_b").alias("q"))
    half = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log(2 * F.col(a) / (F.col(a) + F.col(b)))).otherwise(0.0)
    return p.groupBy("feature").agg(F.sqrt(F.greatest(F.lit(0.0), F.sum(half("p", "q") + half("q", "p")) / 2)).alias("jensen_shannon"))


def zero_mass(long: DataFrame) -> DataFrame:
    """Zero fractions of both cohorts, and the rank distance of the other values."""
    rows = finite_rows(long)
    share = lambda c: F.avg(F.when(F.col("cohort") == c, (F.col("value") == 0).cast("double")))
    z = rows.groupBy("feature").agg(share("A").alias("zero_a"), share("B").alias("zero_b")).withColumn("zero_delta", F.abs(F.col("zero_a") - F.col("zero_b")))
    return z.join(rank_distances(rows.where("value <> 0")).select("feature", F.col("wasserstein_qn").alias("tail_wasserstein")), "feature", "left")


def qq(long: DataFrame) -> DataFrame:
    """(feature, place, q_a, q_b) on the grid 0.01 to 0.99, from exact quantiles."""
    q = quantiles(finite_rows(long), ["feature", "cohort"], list(range(1, 100)), 100)
    side = lambda c: F.max(F.when(F.col("cohort") == c, F.col("q")))
    return q.groupBy("feature", F.col("k").alias("place")).agg(side("A").alias("q_a"), side("B").alias("q_b"))


def qq_line(points: DataFrame) -> DataFrame:
    """Slope, intercept and R2 of q_b on q_a, and the shape class; constant sides are classed by their medians."""
    line = points.groupBy("feature").agg(
        F.regr_slope("q_b", "q_a").alias("slope"), F.regr_intercept("q_b", "q_a").alias("intercept"), F.coalesce(F.regr_r2("q_b", "q_a"), F.lit(1.0)).alias("r2"),
        (F.max("q_a") - F.min("q_a")).alias("span_a"), (F.max("q_b") - F.min("q_b")).alias("span_b"), F.max(F.when(F.col("place") == 50, F.abs(F.col("q_a") - F.col("q_b")))).alias("gap"),
    )
    flat = (F.col("span_a") < 1e-12) | (F.col("span_b") < 1e-12)
    return line.withColumn("shape", shape_class(flat))


def shape_class(flat: Column) -> Column:
    return (
        F.when(flat & (F.col("gap") < 1e-9), "identical").when(flat, "location_shift").when(F.col("r2") < CONFIG.qq_r2, "shape_change")
        .when(F.abs(F.col("slope") - 1) > CONFIG.qq_slope, "scale_change").when(F.abs("intercept") > CONFIG.qq_intercept * F.col("span_a"), "location_shift").otherwise("identical")
    )


def quantile_shifts(points: DataFrame) -> DataFrame:
    """Shifts at the quartiles and the region where they are largest."""
    at = lambda p: F.max(F.when(F.col("place") == p, F.col("q_b") - F.col("q_a")))
    d = points.groupBy("feature").agg(at(25).alias("d25"), at(50).alias("d50"), at(75).alias("d75"))
    top = F.greatest(F.abs("d25"), F.abs("d50"), F.abs("d75"))
    return d.withColumn("region", F.when(F.abs("d50") == top, "median").when(F.abs("d75") == top, "upper").otherwise("lower"))


def per_mode(long: DataFrame, modes: DataFrame) -> DataFrame:
    """(feature, mode, wasserstein_qn, mass_shift): values of the k-th mode of A against those of the k-th of B.

    A value belongs to the mode with the nearest centre, in logarithms of magnitudes where log_scale is set; modes has
    (cohort, feature, log_scale, modes) with centres ascending.
    """
    t = lambda c: F.when(F.col("log_scale"), F.log10(F.greatest(F.abs(c), F.lit(1e-12)))).otherwise(c)
    near = F.array_min(F.transform("modes", lambda m, i: F.struct(F.abs(t(m["center"]) - t(F.col("value"))).alias("d"), i.alias("i"))))
    rows = finite_rows(long).join(modes.select("cohort", "feature", "log_scale", "modes"), ["cohort", "feature"]).withColumn("mode", near["i"])
    named = rows.withColumn("fm", F.concat_ws("#", "feature", "mode"))
    w = rank_distances(named, "fm").select(F.split_part("fm", F.lit("#"), F.lit(1)).alias("feature"), F.split_part("fm", F.lit("#"), F.lit(2)).cast("int").alias("mode"), "wasserstein_qn")
    mass = modes.select("cohort", "feature", F.posexplode("modes").alias("mode", "m")).groupBy("feature", "mode").agg(F.max(F.when(F.col("cohort") == "A", F.col("m.mass"))).alias("ma"), F.max(F.when(F.col("cohort") == "B", F.col("m.mass"))).alias("mb"))
    return mass.where("ma is not null and mb is not null").join(w, ["feature", "mode"], "left").select("feature", "mode", F.coalesce("wasserstein_qn", F.lit(0.0)).alias("wasserstein_qn"), F.abs(F.col("ma") - F.col("mb")).alias("mass_shift"))


def calibrate_c2st(raw: Column, null: Column) -> Column:
    """(raw - null) / (1 - null), negative below the null; null where either is."""
    return (raw - null) / F.greatest(1 - null, F.lit(1e-6))


def calibrate_excess(raw: Column, null: Column) -> Column:
    return F.least(F.greatest((raw - null) / F.greatest(null, F.lit(1e-6)), F.lit(0.0)), F.lit(CONFIG.excess_cap))


def shift_magnitude(js: Column, w: Column, tail: Column, zero_delta: Column, mode_shift: Column, nominal: Column, zero_heavy: Column, per_mode_: Column) -> Column:
    base = F.when(zero_heavy, F.greatest(tail, zero_delta)).otherwise(w)
    return F.when(nominal, js).when(per_mode_, F.greatest(base, mode_shift)).otherwise(base)


def _ordered(a: Column, b: Column, order: dict[str, int]) -> Column:
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    return F.when(F.coalesce(F.try_element_at(rank, a), F.lit(-1)) >= F.coalesce(F.try_element_at(rank, b), F.lit(-1)), a).otherwise(b)


def resolve_type(a: Column, b: Column) -> Column:
    """The more general of two detected types; ties keep the first."""
    return _ordered(a, b, TYPE_ORDER)


def resolve_scale(a: Column, b: Column) -> Column:
    return _ordered(a, b, SCALE_ORDER)


def type_family(t: Column) -> Column:
    return F.when(t == "discrete-count", "count").when(t == "continuous", "continuous").otherwise("categorical")


def route(type_a: Column, type_b: Column, modes_a: Column, modes_b: Column) -> Column:
    fa, fb = type_family(type_a), type_family(type_b)
    return (
        F.when(fa != fb, "structural_change").when(fa == "categorical", "nominal").when(fa == "count", "discrete_count")
        .when((modes_a <= 1) & (modes_b <= 1), "continuous_unimodal").when(modes_a == modes_b, "continuous_multimodal").otherwise("structural_change")
    )


def plan(features: DataFrame) -> DataFrame:
    """Comparison plan of features with type_a/b, scale_a/b, modes_a/b and zero_inflated; identifiers are skipped."""
    r = features.where("type_a <> 'identifier' and type_b <> 'identifier'").withColumn("route", route(F.col("type_a"), F.col("type_b"), F.col("modes_a"), F.col("modes_b")))
    table = F.create_map(*(x for k, v in ROUTES.items() for x in (F.lit(k), F.struct(*(F.lit(p).alias(n) for p, n in zip(v, ("primary", "family", "alignment", "normalization", "mode"), strict=True))))))
    m = F.element_at(table, F.col("route"))
    return r.withColumns({
        "detected_type": resolve_type(F.col("type_a"), F.col("type_b")), "scale": resolve_scale(F.col("scale_a"), F.col("scale_b")), "type_mismatch": F.col("type_a") != F.col("type_b"),
        "modality_mismatch": F.col("modes_a") != F.col("modes_b"), "corroboration_primary": m["primary"], "metric_family": m["family"], "comparison_mode": m["mode"],
        "zero_mass_separate": ~F.col("route").isin("nominal", "discrete_count") & F.col("zero_inflated"),
    })


def auc_stability(sep_a: Column, dir_a: Column, sep_b: Column, dir_b: Column, strong: float = CONFIG.separation_strong) -> Column:
    """Product of both separations on [0, 1]; negative if both are strong and their trusted directions differ."""
    unit = lambda s: F.least(F.greatest((s - 0.5) * 2, F.lit(0.0)), F.lit(1.0))
    base = unit(sep_a) * unit(sep_b)
    flip = (sep_a >= strong) & (sep_b >= strong) & (dir_a != 0) & (dir_b != 0) & (F.signum(dir_a) != F.signum(dir_b))
    return F.when(flip, -base).otherwise(base)


def strength(sep: Column, mi: Column) -> Column:
    return F.greatest((sep - 0.5) * 2, mi)


def separated(sep: Column, mi: Column, auc_null: Column, mi_null: Column) -> Column:
    """Over the fixed bar and over the feature's own null, by either measure."""
    return (sep >= F.greatest(F.lit(CONFIG.separation_strong), auc_null)) | (mi >= F.greatest(F.lit(CONFIG.mi_strong), mi_null))


def verdict(is_a: Column, is_b: Column, dir_a: Column, dir_b: Column, route_: Column, calibrated: Column, threshold: float = 0.0) -> Column:
    """flipped, collapsed, weak, restructured, shifted or stable; the first that holds."""
    shifted = F.coalesce(calibrated > threshold, F.lit(False))
    flip = is_a & is_b & (dir_a != 0) & (dir_b != 0) & (F.signum(dir_a) != F.signum(dir_b))
    return (
        F.when(flip, "flipped").when(is_a & ~is_b, "collapsed").when(~is_a & ~is_b, "weak")
        .when((route_ == "structural_change") & shifted, "restructured").when(shifted, "shifted").otherwise("stable")
    )


def emerged(is_a: Column, is_b: Column) -> Column:
    return ~is_a & is_b


def agreement(metrics: list[Column], calibrated: Column) -> Column:
    """The share of calibrated metrics whose sign agrees with the decision; null metrics don't count."""
    shifted = F.coalesce(calibrated > 0, F.lit(False))
    votes = F.array_compact(F.array(*(F.when(m.isNotNull(), ((m > 0) == shifted).cast("double")) for m in metrics)))
    return F.try_divide(F.aggregate(votes, F.lit(0.0), lambda a, x: a + x), F.size(votes))
