"""Queries: drift of features between cohorts, plans and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import ROUTES, SCALE_ORDER, TYPE_ORDER
from ..operators import drift as D
from ..operators import kernels as N
from ..operators import profile as P
from ..sources.files import saved
from ..sources.views import cte, long_cte, long_view, view
from .registry import query

L = long_cte("drift")
FT = cte("feat")
C = F.col


def _round(df, *names, at=6):
    return df.withColumns({n: F.round(n, at) + 0.0 for n in names})


def _pool(where: str = "true") -> str:
    return f"""{L}, o AS (SELECT feature, cohort, sum(CASE cohort WHEN 'A' THEN 1 ELSE 0 END) OVER w AS ca, sum(CASE cohort WHEN 'B' THEN 1 ELSE 0 END) OVER w AS cb,
count(*) FILTER (WHERE cohort = 'A') OVER (PARTITION BY feature) AS na, count(*) FILTER (WHERE cohort = 'B') OVER (PARTITION BY feature) AS nb
FROM long WHERE {where} WINDOW w AS (PARTITION BY feature ORDER BY value, cohort, okey, lnum, pkey, skey ROWS UNBOUNDED PRECEDING)),
pw AS (SELECT feature, sum(abs(ca / na - cb / nb)) / (max(na + nb) - 1) AS w, 2 * sum((ca / na - cb / nb) * (ca / na - cb / nb)) / (max(na + nb) - 1) AS e FROM o GROUP BY 1)"""


@query("DRF-01")
def drf_01(spark, d):
    """Classifier two-sample test of the pooled cohorts."""
    return N.c2st(long_view(spark, d)).where("slice = 'pooled'").select("feature", "auc", "n_a", "n_b")


@query("DRF-02", f"WITH {FT}, s AS (SELECT feature, unnest([raw, benign, attack, dos, sep_a]) AS s FROM feat) SELECT feature, round(avg(s), 6) AS auc, round(greatest(0, avg(s) - 2.7764451051977987 * stddev_samp(s) / sqrt(5)), 6) AS ci_low, round(least(1, avg(s) + 2.7764451051977987 * stddev_samp(s) / sqrt(5)), 6) AS ci_high FROM s GROUP BY 1")
def drf_02(spark, d):
    """Student's interval of five fold scores."""
    from ..config import T_975_DF4

    s = view(spark, d, "feat").select("feature", F.explode(F.array("raw", "benign", "attack", "dos", "sep_a")).alias("s"))
    a = s.groupBy("feature").agg(F.avg("s").alias("auc"), (F.lit(T_975_DF4) * F.stddev_samp("s") / F.sqrt(F.count("s"))).alias("h"))
    return _round(a.select("feature", "auc", F.greatest(F.lit(0.0), C("auc") - C("h")).alias("ci_low"), F.least(F.lit(1.0), C("auc") + C("h")).alias("ci_high")), "auc", "ci_low", "ci_high")


def _distances(long, metrics):
    """Distances with null floors from samples; raw values come from all rows where counts give them."""
    both = N.distances(long, metrics).join(D.exact_distances(long), ["feature", "metric"], "left")
    return both.select("feature", "metric", F.coalesce("exact", "raw").alias("raw"), "null_floor")


@query("DRF-03")
def drf_03(spark, d):
    """Raw distances with the 95th percentile of their permutation nulls."""
    return _distances(long_view(spark, d), ["wasserstein_qn", "ks_statistic", "energy_distance"])


@query("DRF-04")
def drf_04(spark, d):
    """Null floors of the classifier test, from single splits."""
    return N.c2st(long_view(spark, d)).select("feature", "slice", "null_floor")


@query("DRF-05", f"WITH {FT} SELECT feature, round((raw - null_floor) / greatest(1 - null_floor, 1e-6), 6) + 0.0 AS calibrated FROM feat")
def drf_05(spark, d):
    return view(spark, d, "feat").select("feature", (F.round(D.calibrate_c2st(C("raw"), C("null_floor")), 6) + 0.0).alias("calibrated"))


@query("DRF-06", f"WITH {FT} SELECT feature, round(least(greatest((mi_a - mi_b) / greatest(mi_b, 1e-6), 0), 10), 6) + 0.0 AS excess FROM feat")
def drf_06(spark, d):
    return view(spark, d, "feat").select("feature", (F.round(D.calibrate_excess(C("mi_a"), C("mi_b")), 6) + 0.0).alias("excess"))


@query("DRF-07", f"WITH {_pool()} SELECT feature, round(w, 6) AS wasserstein_qn FROM pw")
def drf_07(spark, d):
    return _round(D.rank_distances(long_view(spark, d)), "wasserstein_qn").select("feature", "wasserstein_qn")


@query("DRF-08", f"WITH {_pool()} SELECT feature, round(e, 6) AS energy FROM pw")
def drf_08(spark, d):
    return _round(D.rank_distances(long_view(spark, d)), "energy").select("feature", "energy")


CNT = f"{L}, v AS (SELECT feature, value, count(*) FILTER (WHERE cohort = 'A') AS a, count(*) FILTER (WHERE cohort = 'B') AS b FROM long GROUP BY 1, 2), t AS (SELECT *, sum(a) OVER (PARTITION BY feature) AS ta, sum(b) OVER (PARTITION BY feature) AS tb FROM v)"


@query("DRF-09", f"WITH {CNT}, c AS (SELECT feature, sum(a) OVER w / ta AS f, sum(b) OVER w / tb AS g FROM t WINDOW w AS (PARTITION BY feature ORDER BY value)) SELECT feature, round(max(abs(f - g)), 6) AS ks FROM c GROUP BY 1")
def drf_09(spark, d):
    return _round(D.ks(long_view(spark, d)), "ks")


@query("DRF-10")
def drf_10(spark, d):
    """Two-sample Anderson-Darling."""
    return N.distances(long_view(spark, d), ["anderson_darling"])


@query("DRF-11")
def drf_11(spark, d):
    """Unbiased MMD with an RBF kernel, in signed logarithms where the plan's scale is logarithmic."""
    from ..operators.pipeline import profiles

    long = long_view(spark, d)
    prof = profiles(long, P.counts(long))
    side = lambda c: prof.where(C("cohort") == c).select("feature", C("scale").alias(f"scale_{c.lower()}"))
    scales = side("A").join(side("B"), "feature").select("feature", D.resolve_scale(C("scale_a"), C("scale_b")).alias("scale"))
    return N.distances(long, ["mmd"], scales=scales)


@query("DRF-12", f"WITH {CNT}, k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY a + b DESC, value) AS k FROM t), p AS (SELECT feature, a / ta AS p, b / tb AS q FROM k WHERE k <= 50 UNION ALL SELECT feature, coalesce(sum(a) FILTER (WHERE k > 50), 0) / max(ta), coalesce(sum(b) FILTER (WHERE k > 50), 0) / max(tb) FROM k GROUP BY 1) SELECT feature, round(sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2)), 5) AS jensen_shannon FROM p GROUP BY 1")
def drf_12(spark, d):
    return _round(D.jensen_shannon(long_view(spark, d)), "jensen_shannon", at=5)


@query("DRF-13")
def drf_13(spark, d):
    """The battery of the metric family that the comparison plan gives each feature."""
    from ..operators import pipeline as X

    long = long_view(spark, d)
    prof = X.profiles(long, P.counts(long))
    return X.battery(long, saved(X.comparison_plan(prof, X.found_modes(long, prof))))


@query("DRF-14")
def drf_14(spark, d):
    """The classifier test of each slice, calibrated by its own null."""
    c = N.c2st(long_view(spark, d)).where("slice <> 'pooled'")
    return c.withColumn("calibrated", D.calibrate_c2st(C("auc"), C("null_floor")))


@query("DRF-15")
def drf_15(spark, d):
    """Values of matched modes against each other, in the space of cohort A's scale."""
    from ..operators import pipeline as X

    long = long_view(spark, d)
    return D.per_mode(long, X.found_modes(long, X.profiles(long, P.counts(long))))


@query("DRF-16", f"WITH {_pool('value <> 0')}, z AS (SELECT feature, avg(CASE WHEN cohort = 'A' THEN CASE WHEN value = 0 THEN 1.0 ELSE 0 END END) AS a, avg(CASE WHEN cohort = 'B' THEN CASE WHEN value = 0 THEN 1.0 ELSE 0 END END) AS b FROM long GROUP BY 1) SELECT z.feature, round(a, 6) AS zero_a, round(b, 6) AS zero_b, round(abs(a - b), 6) AS zero_delta, round(w, 6) AS tail_wasserstein FROM z LEFT JOIN pw ON z.feature = pw.feature")
def drf_16(spark, d):
    return _round(D.zero_mass(long_view(spark, d)), "zero_a", "zero_b", "zero_delta", "tail_wasserstein")


@query("DRF-17", f"WITH {FT} SELECT feature, round(CASE WHEN k % 4 = 0 THEN mi_a WHEN k % 5 = 0 THEN greatest(CASE WHEN k % 3 = 0 THEN greatest(perm_a, perm_b) ELSE sep_a END, sep_b) ELSE CASE WHEN k % 3 = 0 THEN greatest(perm_a, perm_b) ELSE sep_a END END, 6) AS shift FROM feat")
def drf_17(spark, d):
    s = D.shift_magnitude(C("mi_a"), C("sep_a"), C("perm_a"), C("perm_b"), C("sep_b"), C("k") % 4 == 0, C("k") % 3 == 0, C("k") % 5 == 0)
    return view(spark, d, "feat").select("feature", F.round(s, 6).alias("shift"))


QQ = f"{L}, qs AS (SELECT feature, quantile_cont(value, {[i / 100 for i in range(1, 100)]}) FILTER (WHERE cohort = 'A') AS a, quantile_cont(value, {[i / 100 for i in range(1, 100)]}) FILTER (WHERE cohort = 'B') AS b FROM long GROUP BY 1), qq AS (SELECT feature, unnest(range(1, 100)) AS place, unnest(a) AS q_a, unnest(b) AS q_b FROM qs)"


@query("DRF-18", f"WITH {QQ}, x AS (SELECT feature, max(CASE place WHEN 25 THEN q_b - q_a END) AS d25, max(CASE place WHEN 50 THEN q_b - q_a END) AS d50, max(CASE place WHEN 75 THEN q_b - q_a END) AS d75 FROM qq GROUP BY 1) SELECT feature, round(d25, 6) + 0.0 AS d25, round(d50, 6) + 0.0 AS d50, round(d75, 6) + 0.0 AS d75, CASE WHEN abs(d50) = greatest(abs(d25), abs(d50), abs(d75)) THEN 'median' WHEN abs(d75) = greatest(abs(d25), abs(d50), abs(d75)) THEN 'upper' ELSE 'lower' END AS region FROM x")
def drf_18(spark, d):
    return _round(D.quantile_shifts(D.qq(long_view(spark, d))), "d25", "d50", "d75")


REG = f"{QQ}, rg AS (SELECT feature, regr_slope(q_b, q_a) AS slope, regr_intercept(q_b, q_a) AS intercept, coalesce(regr_r2(q_b, q_a), 1) AS r2, max(q_a) - min(q_a) AS sa, max(q_b) - min(q_b) AS sb, max(CASE place WHEN 50 THEN abs(q_a - q_b) END) AS gap FROM qq GROUP BY 1)"


@query("REG-01", f"WITH {REG} SELECT feature, round(slope, 5) + 0.0 AS slope, round(intercept, 4) + 0.0 AS intercept, round(r2, 5) AS r2 FROM rg")
def reg_01(spark, d):
    r = D.qq_line(D.qq(long_view(spark, d)))
    return _round(_round(r, "slope", "r2", at=5), "intercept", at=4).select("feature", "slope", "intercept", "r2")


@query("REL-24", f"WITH {REG} SELECT feature, CASE WHEN (sa < 1e-12 OR sb < 1e-12) AND gap < 1e-9 THEN 'identical' WHEN sa < 1e-12 OR sb < 1e-12 THEN 'location_shift' WHEN r2 < 0.97 THEN 'shape_change' WHEN abs(slope - 1) > 0.15 THEN 'scale_change' WHEN abs(intercept) > 0.05 * sa THEN 'location_shift' ELSE 'identical' END AS shape FROM rg")
def rel_24(spark, d):
    return D.qq_line(D.qq(long_view(spark, d))).select("feature", "shape")


@query("DRF-19", f"WITH {FT}, v AS (SELECT feature, unnest([imp_a - 0.5, stab, perm_a - 0.3]) AS m, coalesce(cal > 0, false) AS s FROM feat) SELECT feature, round(avg(CASE WHEN (m > 0) = s THEN 1.0 ELSE 0 END), 6) AS agreement FROM v WHERE m IS NOT NULL GROUP BY 1")
def drf_19(spark, d):
    a = D.agreement([C("imp_a") - 0.5, C("stab"), C("perm_a") - 0.3], C("cal"))
    return view(spark, d, "feat").select("feature", F.round(a, 6).alias("agreement"))


@query("DRF-20")
def drf_20(spark, d):
    """From values to verdicts: profiles, plan, calibrated test, null-calibrated separation."""
    from ..operators.pipeline import verdicts

    return verdicts(long_view(spark, d))


@query("DRF-20b")
def drf_20b(spark, d):
    """The record of each feature: route, primary distance, zero mass, matched modes and shift magnitude."""
    from ..operators.pipeline import record

    return record(long_view(spark, d))


AX = "least(greatest((sep_a - 0.5) * 2, 0), 1) * least(greatest((sep_b - 0.5) * 2, 0), 1)"


@query("AX2-01", f"WITH {FT} SELECT feature, round(CASE WHEN sep_a >= 0.55 AND sep_b >= 0.55 AND dir_a <> 0 AND dir_b <> 0 AND sign(dir_a) <> sign(dir_b) THEN -({AX}) ELSE {AX} END, 6) + 0.0 AS stability FROM feat")
def ax2_01(spark, d):
    return view(spark, d, "feat").select("feature", (F.round(D.auc_stability(C("sep_a"), C("dir_a"), C("sep_b"), C("dir_b")), 6) + 0.0).alias("stability"))


SEPD = f"{FT}, x AS (SELECT *, sep_a >= 0.55 OR mi_a >= 0.05 AS is_a, sep_b >= 0.55 OR mi_b >= 0.05 AS is_b, greatest((sep_a - 0.5) * 2, mi_a) AS st_a, greatest((sep_b - 0.5) * 2, mi_b) AS st_b FROM feat), fl AS (SELECT *, is_a AND is_b AND dir_a <> 0 AND dir_b <> 0 AND sign(dir_a) <> sign(dir_b) AS flip FROM x)"


def _separated(spark, d):
    zero = F.lit(0.0)
    f = view(spark, d, "feat").withColumns({f"is_{c}": D.separated(C(f"sep_{c}"), C(f"mi_{c}"), zero, zero) for c in "ab"})
    return f.withColumn("flip", C("is_a") & C("is_b") & (C("dir_a") != 0) & (C("dir_b") != 0) & (F.signum("dir_a") != F.signum("dir_b")))


@query("AX2-02", f"WITH {SEPD} SELECT feature, round(CASE WHEN flip THEN -1 ELSE 1 END * least(greatest(st_a, 0), 1) * least(greatest(st_b, 0), 1), 6) + 0.0 AS stability FROM fl")
def ax2_02(spark, d):
    unit = lambda c: F.least(F.greatest(D.strength(C(f"sep_{c}"), C(f"mi_{c}")), F.lit(0.0)), F.lit(1.0))
    f = _separated(spark, d)
    return f.select("feature", (F.round(F.when(C("flip"), -1.0).otherwise(1.0) * unit("a") * unit("b"), 6) + 0.0).alias("stability"))


@query("AX2-03")
def ax2_03(spark, d):
    """Null-calibrated separation flags."""
    long = long_view(spark, d)
    j = P.separation(long).join(N.mutual_information(long, P.KEYS), P.KEYS).join(N.separation_nulls(long), P.KEYS)
    return j.select(*P.KEYS, "magnitude", "mi_normalized", "auc_null", "mi_null", D.separated(C("magnitude"), C("mi_normalized"), C("auc_null"), C("mi_null")).alias("separated"))


AXF = f"WITH {L}, f AS (SELECT cohort, feature, value, y, family AS against FROM long WHERE y = 1 UNION ALL SELECT cohort, feature, value, y, x.against FROM long, (SELECT DISTINCT family AS against FROM long WHERE y = 1) x WHERE y = 0), n AS (SELECT cohort, feature, against, value, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM f GROUP BY 1, 2, 3, 4), c AS (SELECT *, sum(n0) OVER (PARTITION BY cohort, feature, against ORDER BY value) AS c0 FROM n), a AS (SELECT cohort, feature, against, sum(n1 * (c0 - n0 / 2)) / (sum(n1) * sum(n0)) AS auc FROM c GROUP BY 1, 2, 3), s AS (SELECT feature, against, max(CASE cohort WHEN 'A' THEN greatest(auc, 1 - auc) END) AS sep_a, max(CASE cohort WHEN 'B' THEN greatest(auc, 1 - auc) END) AS sep_b, max(CASE cohort WHEN 'A' THEN CASE WHEN abs(auc - 0.5) >= 0.05 THEN sign(auc - 0.5) ELSE 0 END END) AS dir_a, max(CASE cohort WHEN 'B' THEN CASE WHEN abs(auc - 0.5) >= 0.05 THEN sign(auc - 0.5) ELSE 0 END END) AS dir_b FROM a GROUP BY 1, 2), st AS (SELECT feature, against, CASE WHEN sep_a >= 0.55 AND sep_b >= 0.55 AND dir_a <> 0 AND dir_b <> 0 AND dir_a <> dir_b THEN -({AX}) ELSE {AX} END AS st FROM s)"


@query("AX2-04", f"{AXF} SELECT feature, round(min(st), 5) + 0.0 AS least, count(*) FILTER (WHERE st < 0) AS n_family_flips, count(*) FILTER (WHERE st < 0) > 0 AS flip_corroborated FROM st GROUP BY 1")
def ax2_04(spark, d):
    s = P.family_separation(long_view(spark, d))
    side = lambda c, v: F.max(F.when(C("cohort") == c, C(v)))
    w = s.groupBy("feature", "against").agg(side("A", "magnitude").alias("sa"), side("B", "magnitude").alias("sb"), side("A", "direction").alias("da"), side("B", "direction").alias("db"))
    st = w.withColumn("st", D.auc_stability(C("sa"), C("da"), C("sb"), C("db")))
    return st.groupBy("feature").agg((F.round(F.min("st"), 5) + 0.0).alias("least"), F.count_if(C("st") < 0).alias("n_family_flips"), (F.count_if(C("st") < 0) > 0).alias("flip_corroborated"))


TY = "CASE WHEN levels_{c} <= 2 THEN 'binary' WHEN levels_{c} <= 10 THEN 'low-cardinality-discrete' WHEN levels_{c} <= 35 THEN 'discrete-count' ELSE 'continuous' END"
SC = "CASE WHEN levels_{c} <= 35 THEN 'categorical' WHEN levels_{c} % 3 = 0 THEN 'log' WHEN levels_{c} % 3 = 1 THEN 'symlog' ELSE 'linear' END"
PF = f"{FT}, pf AS (SELECT feature, k, {TY.format(c='a')} AS type_a, {TY.format(c='b')} AS type_b, {SC.format(c='a')} AS scale_a, {SC.format(c='b')} AS scale_b, modes_a, modes_b, k % 3 = 0 AS zero_inflated FROM feat)"
FAM = "CASE type_{c} WHEN 'discrete-count' THEN 'count' WHEN 'continuous' THEN 'continuous' ELSE 'categorical' END"
_FA, _FB = FAM.format(c="a"), FAM.format(c="b")
RT = f"{PF}, rt AS (SELECT *, CASE WHEN {_FA} <> {_FB} THEN 'structural_change' WHEN {_FA} = 'categorical' THEN 'nominal' WHEN {_FA} = 'count' THEN 'discrete_count' WHEN modes_a <= 1 AND modes_b <= 1 THEN 'continuous_unimodal' WHEN modes_a = modes_b THEN 'continuous_multimodal' ELSE 'structural_change' END AS route FROM pf)"


def _rank(c: str, order: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in order.items()) + " ELSE -1 END"


def _profiles(spark, d):
    return view(spark, d, "feat").selectExpr("feature", "k", f"{TY.format(c='a')} AS type_a", f"{TY.format(c='b')} AS type_b", f"{SC.format(c='a')} AS scale_a", f"{SC.format(c='b')} AS scale_b", "modes_a", "modes_b", "k % 3 = 0 AS zero_inflated")


@query("REL-18", f"WITH {PF} SELECT feature, CASE WHEN {_rank('type_a', TYPE_ORDER)} >= {_rank('type_b', TYPE_ORDER)} THEN type_a ELSE type_b END AS detected_type, CASE WHEN {_rank('scale_a', SCALE_ORDER)} >= {_rank('scale_b', SCALE_ORDER)} THEN scale_a ELSE scale_b END AS scale FROM pf")
def rel_18(spark, d):
    return D.plan(_profiles(spark, d)).select("feature", "detected_type", "scale")


@query("REL-19", f"WITH {RT} SELECT feature, route, CASE route " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in ROUTES.items()) + " END AS corroboration_primary, route NOT IN ('nominal', 'discrete_count') AND zero_inflated AS zero_mass_separate FROM rt")
def rel_19(spark, d):
    return D.plan(_profiles(spark, d)).select("feature", "route", "corroboration_primary", "zero_mass_separate")


@query("JN-03", f"WITH {RT}, b AS (SELECT * FROM rt WHERE k % 7 <> 0) SELECT (SELECT count(*) FROM b WHERE k % 5 <> 0) AS n_planned, (SELECT count(*) FROM rt WHERE k % 7 = 0 AND k % 5 <> 0) + (SELECT count(*) FROM rt WHERE k % 5 = 0 AND k % 7 <> 0) AS n_one_sided")
def jn_03(spark, d):
    """Features profiled in both cohorts are planned; those of one cohort are counted."""
    p = _profiles(spark, d)
    a, b = p.where("k % 7 <> 0").select("feature"), p.where("k % 5 <> 0")
    planned = D.plan(b.join(a, "feature", "left_semi")).agg(F.count("*").alias("n_planned"))
    single = a.join(b, "feature", "left_anti").unionByName(b.select("feature").join(a, "feature", "left_anti")).agg(F.count("*").alias("n_one_sided"))
    return spark.createDataFrame([(planned.first()[0], single.first()[0])], "n_planned long, n_one_sided long")


VD = f"{SEPD}, rt2 AS (SELECT fl.*, CASE WHEN flip THEN 'flipped' WHEN is_a AND NOT is_b THEN 'collapsed' WHEN NOT is_a AND NOT is_b THEN 'weak' WHEN k % 3 = 0 AND coalesce(cal > {{t}}, false) THEN 'restructured' WHEN coalesce(cal > {{t}}, false) THEN 'shifted' ELSE 'stable' END AS verdict FROM fl)"


def _verdicts(spark, d, t=0.0):
    r = F.when(C("k") % 3 == 0, "structural_change").otherwise("continuous_unimodal")
    return _separated(spark, d).withColumn("verdict", D.verdict(C("is_a"), C("is_b"), C("dir_a"), C("dir_b"), r, C("cal"), t))


@query("REL-20", f"WITH {VD.format(t=0)} SELECT feature, verdict, NOT is_a AND is_b AS emerged FROM rt2")
def rel_20(spark, d):
    return _verdicts(spark, d).select("feature", "verdict", D.emerged(C("is_a"), C("is_b")).alias("emerged"))


@query("AGG-15", " UNION ALL ".join(f"(WITH {VD.format(t=t)} SELECT CAST({t} AS DOUBLE) AS threshold, verdict, count(*) AS n FROM rt2 GROUP BY 2)" for t in (0.0, 0.02, 0.05, 0.1)))
def agg_15(spark, d):
    """Verdict counts at other thresholds, in one aggregate over exploded thresholds."""
    f = _separated(spark, d).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.0, 0.02, 0.05, 0.1)))))
    r = F.when(C("k") % 3 == 0, "structural_change").otherwise("continuous_unimodal")
    v = D.verdict(C("is_a"), C("is_b"), C("dir_a"), C("dir_b"), r, F.when(C("cal") > C("threshold"), 1.0).otherwise(F.when(C("cal").isNotNull(), 0.0)))
    return f.withColumn("verdict", v).groupBy("threshold", "verdict").agg(F.count("*").alias("n"))


@query("AGG-16", f"WITH {FT}, v AS (SELECT unnest(['importance', 'stability', 'permutation']) AS metric, unnest([imp_a - 0.5, stab, perm_a - 0.3]) AS m, coalesce(cal > 0, false) AS s FROM feat) SELECT metric, count(*) AS n, round(avg(CASE WHEN (m > 0) = s THEN 1.0 ELSE 0 END), 6) AS rate FROM v WHERE m IS NOT NULL GROUP BY 1")
def agg_16(spark, d):
    m = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.alias("m")) for n, c in (("importance", C("imp_a") - 0.5), ("stability", C("stab")), ("permutation", C("perm_a") - 0.3)))))
    v = view(spark, d, "feat").select(F.coalesce(C("cal") > 0, F.lit(False)).alias("s"), m.alias("v")).where("v.m is not null")
    return v.groupBy(C("v.metric").alias("metric")).agg(F.count("*").alias("n"), F.round(F.avg(((C("v.m") > 0) == C("s")).cast("double")), 6).alias("rate"))


@query("AGG-17", f"WITH {RT} SELECT route, count(*) AS n, count(*) FILTER (WHERE type_a <> type_b) AS n_type_mismatch, count(*) FILTER (WHERE zero_inflated AND route NOT IN ('nominal', 'discrete_count')) AS n_zero_separate FROM rt GROUP BY 1")
def agg_17(spark, d):
    p = D.plan(_profiles(spark, d))
    return p.groupBy("route").agg(F.count("*").alias("n"), F.count_if("type_mismatch").alias("n_type_mismatch"), F.count_if("zero_mass_separate").alias("n_zero_separate"))


@query("JN-06", f"WITH {cte('dirty')}, f AS (SELECT DISTINCT label, cohort FROM dirty WHERE label IS NOT NULL AND NOT (label = 'PortScan' AND cohort = 'B')) SELECT label, count(DISTINCT cohort) = 2 AS shared FROM f GROUP BY 1")
def jn_06(spark, d):
    """Families of both cohorts, and of one only."""
    v = view(spark, d, "dirty").where("label is not null and not (label = 'PortScan' and cohort = 'B')")
    return v.groupBy("label").agg((F.countDistinct("cohort") == 2).alias("shared"))
