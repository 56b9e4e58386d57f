"""Queries: cross analysis, rank statistics, ablation tables and plot data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..operators import cross as X
from ..operators import kernels as N
from ..operators import profile as P
from ..operators import stats as T
from ..operators.split import random_cap
from ..sources.views import cte, long_view, view
from .registry import query

FT, AB = cte("feat"), cte("abl")
C = F.col


def _feat(spark, d):
    return view(spark, d, "feat")


XT = f"{FT}, x AS (SELECT feature, k, imp_a, imp_b, cal, stab FROM feat WHERE imp_a IS NOT NULL AND imp_b IS NOT NULL AND k % 29 <> 0), r AS (SELECT *, row_number() OVER (ORDER BY imp_a DESC, feature) AS rank_a, row_number() OVER (ORDER BY imp_b DESC, feature) AS rank_b FROM x)"


def _cross(spark, d):
    f = _feat(spark, d)
    return X.cross_table(f.where("imp_a is not null").select("feature", "k", "imp_a"), f.where("imp_b is not null").select("feature", "imp_b"), f.where("k % 29 <> 0").select("feature", "cal", "stab"))


@query("JN-01", f"WITH {XT} SELECT feature, rank_a, rank_b, rank_a - rank_b AS rank_delta FROM r")
def jn_01(spark, d):
    return _cross(spark, d).select("feature", "rank_a", "rank_b", "rank_delta")


@query("JN-08", f"WITH {AB}, m AS (SELECT policy, kk, direction, seed, avg(f1) AS f1 FROM abl GROUP BY 1, 2, 3, 4) SELECT a.kk, a.direction, a.seed, round(a.f1 - b.f1, 6) + 0.0 AS gap FROM m a JOIN m b ON a.kk = b.kk AND a.direction = b.direction AND a.seed = b.seed WHERE a.policy = 'axis1_stable' AND b.policy = 'top_importance'")
def jn_08(spark, d):
    m = view(spark, d, "abl").groupBy("policy", "kk", "direction", "seed").agg(F.avg("f1").alias("f1"))
    a, b = (m.where(C("policy") == p).select("kk", "direction", "seed", C("f1").alias(n)) for p, n in (("axis1_stable", "fa"), ("top_importance", "fb")))
    return a.join(b, ["kk", "direction", "seed"]).select("kk", "direction", "seed", (F.round(C("fa") - C("fb"), 6) + 0.0).alias("gap"))


@query("JN-10", f"WITH {FT} SELECT grp, " + ", ".join(f"round(max(CASE family WHEN '{f}' THEN stab END), 6) + 0.0 AS \"{f}\"" for f in ("Botnet", "DDoS", "DoS", "PortScan")) + " FROM feat GROUP BY 1")
def jn_10(spark, d):
    """Tables of each family side by side."""
    p = _feat(spark, d).groupBy("grp").pivot("family", ["Botnet", "DDoS", "DoS", "PortScan"]).agg(F.max("stab"))
    return p.select("grp", *((F.round(f, 6) + 0.0).alias(f) for f in ("Botnet", "DDoS", "DoS", "PortScan")))


A1 = "CASE WHEN cal IS NULL THEN 'n/a' WHEN cal <= 0 THEN 'NONE' WHEN cal <= 0.2 THEN 'LOW' WHEN cal <= 0.45 THEN 'MODERATE' WHEN cal <= 0.7 THEN 'HIGH' ELSE 'STRONG' END"
A2 = "CASE WHEN stab IS NULL THEN 'n/a' WHEN stab < 0 THEN 'FLIPPED' WHEN stab < 0.09 THEN 'COLLAPSED' WHEN stab < 0.35 THEN 'WEAKENED' ELSE 'PRESERVED' END"


@query("REL-21", f"WITH {FT} SELECT feature, {A1} AS axis1, {A2} AS axis2 FROM feat")
def rel_21(spark, d):
    return _feat(spark, d).select("feature", X.axis1_level(C("cal")).alias("axis1"), X.axis2_level(C("stab")).alias("axis2"))


QD = f"{FT}, md AS (SELECT quantile_cont(imp_a, 0.5) AS a, quantile_cont(stab, 0.5) AS s FROM feat WHERE imp_a IS NOT NULL), qd AS (SELECT feat.*, CASE WHEN imp_a >= a AND stab >= s THEN 'Q1_good' WHEN imp_a >= a THEN 'Q2_fragile_shortcut' WHEN imp_a < a AND stab < s THEN 'Q3_noise' WHEN imp_a < a THEN 'Q4_underused_stable' END AS quadrant FROM feat, md)"


@query("REL-22", f"WITH {QD} SELECT feature, quadrant FROM qd")
def rel_22(spark, d):
    return X.quadrants(_feat(spark, d)).select("feature", "quadrant")


@query("REL-23", f"WITH {FT} SELECT feature, CASE WHEN cal IS NULL THEN 'indeterminate' WHEN cal > 0 AND (stab > 0 OR stab + 0.5 < 0) THEN 'supported' WHEN stab > 0 OR stab + 0.5 < 0 THEN 'contradicted' ELSE 'weak' END AS state, CASE WHEN abs(stab) < 0.05 THEN 'negligible' WHEN abs(stab) >= 0.5 THEN 'strong' WHEN abs(stab) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM feat")
def rel_23(spark, d):
    return _feat(spark, d).select("feature", X.support_state(C("cal"), C("stab"), C("stab") + 0.5, True).alias("state"), X.strength_level(C("stab")).alias("strength"))


@query("AGG-09", f"WITH {FT} SELECT coalesce(family, 'ALL/POOLED') AS family, count(stab) AS n, round(quantile_cont(stab, 0.5), 6) + 0.0 AS stab, round(quantile_cont(cal, 0.5), 6) + 0.0 AS shift, round(avg(CASE WHEN stab > 0.5 THEN 1.0 ELSE 0 END), 6) AS stable FROM feat GROUP BY GROUPING SETS ((family), ())")
def agg_09(spark, d):
    return X.family_rollup(_feat(spark, d)).withColumns({c: F.round(c, 6) + 0.0 for c in ("stab", "shift", "stable")})


@query("AGG-10", f"WITH {FT} SELECT count(*) FILTER (WHERE benign > attack) AS n_benign, count(*) FILTER (WHERE benign <= attack) AS n_attack, round(avg(benign), 6) AS mean_benign, round(avg(attack), 6) AS mean_attack, CASE WHEN avg(attack) > avg(benign) * 1.2 THEN 'attack' WHEN avg(benign) > avg(attack) * 1.2 THEN 'benign' ELSE 'both' END AS dominant FROM feat")
def agg_10(spark, d):
    return X.drivers(_feat(spark, d))


@query("AGG-11", f"WITH {FT} SELECT feature, CASE WHEN benign >= attack AND benign >= dos THEN 'benign' WHEN attack >= dos THEN 'attack' ELSE 'dos' END AS slice FROM feat")
def agg_11(spark, d):
    return X.dominant_slice(_feat(spark, d), ["benign", "attack", "dos"])


@query("AGG-12", f"WITH {QD} SELECT coalesce(quadrant, 'none') AS quadrant, count(*) FILTER (WHERE mi_a > 0.01 AND mi_b >= 0.5 * mi_a) AS n_survived, count(*) FILTER (WHERE mi_a > 0.01 AND mi_b < 0.5 * mi_a) AS n_lost, round(avg(mi_a - mi_b), 6) + 0.0 AS mean_drop FROM qd GROUP BY 1")
def agg_12(spark, d):
    return X.mi_preservation(_feat(spark, d)).withColumn("mean_drop", F.round("mean_drop", 6) + 0.0)


PK = f"{AB}, m AS (SELECT policy, direction, kk, round(avg(f1), 9) AS f1 FROM abl GROUP BY 1, 2, 3), w AS (SELECT *, lag(kk) OVER v AS p, lead(kk) OVER v AS n, row_number() OVER (PARTITION BY policy, direction ORDER BY f1 DESC, kk) AS r FROM m WINDOW v AS (PARTITION BY policy, direction ORDER BY kk))"


@query("AGG-13", f"WITH {PK} SELECT policy, direction, kk AS peak_k, round(f1, 6) AS f1, p IS NOT NULL AND n IS NOT NULL AS is_interior, CASE WHEN p IS NOT NULL AND n IS NOT NULL THEN concat(p, '-', n) ELSE 'at boundary' END AS \"window\" FROM w WHERE r = 1")
def agg_13(spark, d):
    return X.peak_k(view(spark, d, "abl"))


@query("AGG-14", f"WITH {AB}, m AS (SELECT policy, direction, kk, round(avg(f1), 9) AS f1 FROM abl GROUP BY 1, 2, 3), b AS (SELECT *, row_number() OVER (PARTITION BY kk, direction ORDER BY f1 DESC, policy) AS r FROM m) SELECT policy, round(avg(f1), 6) AS mean_f1, count(*) FILTER (WHERE r = 1) AS wins FROM b GROUP BY 1")
def agg_14(spark, d):
    m = view(spark, d, "abl").groupBy("policy", "direction", "kk").agg(F.round(F.avg("f1"), 9).alias("f1"))
    r = m.withColumn("r", F.row_number().over(Window.partitionBy("kk", "direction").orderBy(F.desc("f1"), "policy")))
    return r.groupBy("policy").agg(F.round(F.avg("f1"), 6).alias("mean_f1"), F.count_if(C("r") == 1).alias("wins"))


@query("AGG-18", f"WITH {FT} SELECT {A1} AS axis1, " + ", ".join(f"count(*) FILTER (WHERE {A2} = '{v}') AS {v}" for v in ("FLIPPED", "COLLAPSED", "WEAKENED", "PRESERVED")) + " FROM feat GROUP BY 1")
def agg_18(spark, d):
    names = ["FLIPPED", "COLLAPSED", "WEAKENED", "PRESERVED"]
    p = _feat(spark, d).select(X.axis1_level(C("cal")).alias("axis1"), X.axis2_level(C("stab")).alias("a2")).groupBy("axis1").pivot("a2", names).count()
    return p.select("axis1", *(F.coalesce(n, F.lit(0)).alias(n) for n in names))


TB = f"{FT}, r AS (SELECT *, row_number() OVER (ORDER BY imp_a DESC, feature) AS r, count(*) OVER () AS n FROM feat WHERE imp_a IS NOT NULL AND cal IS NOT NULL)"


@query("AGG-19", f"WITH {TB} SELECT CASE WHEN r <= 10 THEN 'top' WHEN r > n - 10 THEN 'bottom' ELSE 'mid' END AS part, count(*) AS n, round(avg(cal), 6) AS mean_cal, round(quantile_cont(cal, 0.5), 6) AS median_cal FROM r GROUP BY 1")
def agg_19(spark, d):
    return X.top_bottom(_feat(spark, d))


@query("AGG-20", f"WITH {XT}, f AS (SELECT abs(rank_a - rank_b) AS l, cal FROM r WHERE cal IS NOT NULL), m AS (SELECT quantile_cont(l, 0.5) AS ml, quantile_cont(cal, 0.5) AS mc FROM f) SELECT CASE WHEN l >= ml THEN 'hi_L' ELSE 'lo_L' END || '_' || CASE WHEN cal >= mc THEN 'hi_E' ELSE 'lo_E' END AS quadrant, count(*) AS n FROM f, m GROUP BY 1")
def agg_20(spark, d):
    f = _cross(spark, d).where("cal is not null").select(F.abs("rank_delta").cast("double").alias("l"), "cal")
    m = f.agg(F.median("l"), F.median("cal")).first()
    q = F.concat(F.when(C("l") >= m[0], "hi_L").otherwise("lo_L"), F.lit("_"), F.when(C("cal") >= m[1], "hi_E").otherwise("lo_E"))
    return f.groupBy(q.alias("quadrant")).agg(F.count("*").alias("n"))


@query("AGG-21", f"WITH {FT} SELECT round(sum(imp_a * cal) / nullif(sum(imp_a), 0), 6) AS exposure FROM feat WHERE imp_a IS NOT NULL AND cal IS NOT NULL")
def agg_21(spark, d):
    return X.exposure(_feat(spark, d))


@query("AGG-23", f"WITH {AB} SELECT policy, direction, round(avg(f1) FILTER (WHERE kk = 5) - avg(f1) FILTER (WHERE kk = 50), 6) + 0.0 AS gain FROM abl GROUP BY 1, 2")
def agg_23(spark, d):
    g = view(spark, d, "abl").groupBy("policy", "direction").agg((F.avg(F.when(C("kk") == 5, C("f1"))) - F.avg(F.when(C("kk") == 50, C("f1")))).alias("gain"))
    return g.withColumn("gain", F.round("gain", 6) + 0.0)


@query("ST-01", f"WITH {FT} SELECT feature, row_number() OVER (ORDER BY perm_a DESC, feature) AS place FROM feat")
def st_01(spark, d):
    return _feat(spark, d).select("feature", X.place("perm_a").alias("place"))


def _ranks_sql(a: str, b: str, src: str = "feat") -> str:
    rk = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"
    return f"(SELECT {rk(a)} AS x, {rk(b)} AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("ST-02", f"WITH {FT}, p AS (SELECT sign(f.perm_a - g.perm_a) AS dx, sign(f.stab - g.stab) AS dy FROM feat f JOIN feat g ON f.k < g.k) SELECT (SELECT round(corr(x, y), 6) FROM {_ranks_sql('perm_a', 'stab')}) AS spearman, (SELECT round(sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))), 6) FROM p) AS kendall")
def st_02(spark, d):
    """Spearman and Kendall's tau-b."""
    _, rho, tau = T.association(T.cell_counts(_feat(spark, d), "perm_a", "stab"), "perm_a", "stab")
    return spark.range(1).select(F.round(F.lit(rho), 6).alias("spearman"), F.round(F.lit(tau), 6).alias("kendall"))


@query("ST-03")
def st_03(spark, d):
    """Percentile bootstrap of a rank correlation."""
    return T.block(_feat(spark, d), "imp_a", "cal", 500)


@query("ST-04")
def st_04(spark, d):
    """The same with whole clusters of features drawn."""
    return T.block(_feat(spark, d), "imp_a", "cal", 500, by="grp")


def _partial(a: str, b: str, c: str) -> str:
    return f"((r{a}{b} - r{a}{c} * r{b}{c}) / sqrt((1 - r{a}{c} * r{a}{c}) * (1 - r{b}{c} * r{b}{c})))"


_rk = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 AS c{i}" for i, c in enumerate(("perm_a", "stab", "mi_a", "sep_a")))
_rs = ", ".join(f"corr(c{i}, c{j}) AS r{i}{j}" for i in range(4) for j in range(i + 1, 4))


@query("ST-05", f"WITH {FT}, k AS (SELECT {_rk} FROM feat), r AS (SELECT {_rs} FROM k), p AS (SELECT {_partial('0', '1', '2')} AS ab, (r03 - r02 * r23) / sqrt((1 - r02 * r02) * (1 - r23 * r23)) AS a3, (r13 - r12 * r23) / sqrt((1 - r12 * r12) * (1 - r23 * r23)) AS b3 FROM r) SELECT round((ab - a3 * b3) / sqrt((1 - a3 * a3) * (1 - b3 * b3)), 6) + 0.0 AS partial FROM p")
def st_05(spark, d):
    return T.partial_spearman(_feat(spark, d), "perm_a", "stab", ("mi_a", "sep_a")).select((F.round("partial", 6) + 0.0).alias("partial"))


BH = f"{FT}, t AS (SELECT feature, mi_a AS p, row_number() OVER (ORDER BY mi_a, feature) AS r, count(*) OVER () AS m FROM feat), q AS (SELECT feature, least(1, min(p * m / r) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM t)"


@query("ST-06", f"WITH {BH} SELECT feature, round(q, 6) AS q_value, q <= 0.05 AS reject FROM q")
def st_06(spark, d):
    b = T.benjamini_hochberg(_feat(spark, d).select("feature", C("mi_a").alias("p")))
    return b.select("feature", F.round("q_value", 6).alias("q_value"), "reject")


TO = f"{FT}, r AS (SELECT row_number() OVER (ORDER BY imp_a DESC, feature) AS a, row_number() OVER (ORDER BY imp_b DESC, feature) AS b FROM feat WHERE imp_a IS NOT NULL AND imp_b IS NOT NULL)"


@query("ST-07", f"WITH {TO} SELECT k::INT AS k, round(count(*) FILTER (WHERE a <= k AND b <= k) / max(k), 6) AS share FROM r, (SELECT unnest([5, 10, 15, 20]) AS k) GROUP BY 1")
def st_07(spark, d):
    return T.top_overlap(_feat(spark, d))


@query("ST-08", f"WITH {XT}, f AS (SELECT CAST(rank_a - rank_b AS DOUBLE) AS l, cal FROM r WHERE cal IS NOT NULL) SELECT round(corr(x, y), 6) AS rho FROM {_ranks_sql('l', 'cal', 'f')}")
def st_08(spark, d):
    """Rank change of importance against shift."""
    return T.spearman(_cross(spark, d).withColumn("l", C("rank_delta").cast("double")), "l", "cal").select(F.round("rho", 6).alias("rho"))


@query("ST-09")
def st_09(spark, d):
    """Weighted exposure among shuffled weights."""
    return T.exposure_percentile(_feat(spark, d))


@query("ST-10")
def st_10(spark, d):
    """Wilcoxon's signed-rank test of two policies paired on K, direction and seed."""
    return T.paired_test(view(spark, d, "abl"), "axis1_stable", "top_importance")


@query("SMP-08")
def smp_08(spark, d):
    """All bootstrap draws of a feature table, as counts of each row in each draw."""
    return T.resamples(_feat(spark, d).select("feature"), CONFIG.bootstraps, "smp")


@query("SRT-02", f"WITH {FT} SELECT feature, round(perm_a, 6) AS perm_a FROM feat ORDER BY perm_a DESC, feature LIMIT 25")
def srt_02(spark, d):
    """The 25 most important features."""
    return _feat(spark, d).orderBy(F.desc("perm_a"), "feature").limit(25).select("feature", F.round("perm_a", 6).alias("perm_a"))


@query("WIN-03", f"WITH {AB}, m AS (SELECT policy, kk, avg(f1) AS f1 FROM abl GROUP BY 1, 2) SELECT policy, kk, round(f1 - lag(f1) OVER (PARTITION BY policy ORDER BY kk), 6) + 0.0 AS step FROM m")
def win_03(spark, d):
    m = view(spark, d, "abl").groupBy("policy", "kk").agg(F.avg("f1").alias("f1"))
    return m.select("policy", "kk", (F.round(C("f1") - F.lag("f1").over(Window.partitionBy("policy").orderBy("kk")), 6) + 0.0).alias("step"))


@query("WIN-04", f"WITH {BH} SELECT feature, round(q, 6) AS q_value FROM q")
def win_04(spark, d):
    b = T.benjamini_hochberg(_feat(spark, d).select("feature", C("mi_a").alias("p")))
    return b.select("feature", F.round("q_value", 6).alias("q_value"))


#: Values of a raincloud lane.
LANE_ROWS = 20_000


@query("VIZ-01")
def viz_01(spark, d):
    """Raincloud lanes: at most LANE_ROWS values, by hash, of each feature, cohort and class, once with two classes and
    once with families. in_view tells the values within the profile's view range, which the clipped plot shows."""
    long = N.finite_rows(long_view(spark, d))
    pair = lambda split, lane: F.struct(F.lit(split).alias("split"), lane.alias("lane"))
    lanes = long.withColumn("l", F.explode(F.array(pair("binary", F.when(C("y") == 1, "attack").otherwise("benign")), pair("family", C("family")))))
    lanes = lanes.withColumns({"split": C("l.split"), "lane": C("l.lane")})
    some = random_cap(lanes, ["feature", "cohort", "split", "lane"], F.expr(N.ROW_KEY), LANE_ROWS, few_groups=True)
    ends = P.view_range(long).select("cohort", "feature", "view_low", "view_high")
    return some.join(ends, ["cohort", "feature"]).select("feature", "cohort", "split", "lane", "value", C("value").between(C("view_low"), C("view_high")).alias("in_view"))


@query("VIZ-02")
def viz_02(spark, d):
    """Density curves."""
    return N.densities(long_view(spark, d))


@query("VIZ-04", f"WITH {AB}, r AS (SELECT run, row_number() OVER (ORDER BY run) - 1 AS i, count(*) OVER () AS n FROM abl) SELECT run, i FROM r WHERE i % greatest(1, n // 2000) = 0 OR i = n - 1")
def viz_04(spark, d):
    """A curve thinned by stride, with its last point."""
    return X.thin(view(spark, d, "abl").select("run"), "run", 2000)


@query("VIZ-06", f"WITH {FT}, md AS (SELECT quantile_cont(imp_a, 0.5) AS m FROM feat), f AS (SELECT feature, coalesce(imp_a, m) AS v FROM feat, md) SELECT feature, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS place FROM f")
def viz_06(spark, d):
    """Average ranks of a metric with its median in place of nulls."""
    f = _feat(spark, d)
    m = f.agg(F.median("imp_a")).first()[0]
    v = f.select("feature", F.coalesce("imp_a", F.lit(m)).alias("v"))
    return v.select("feature", (F.rank().over(Window.orderBy("v")) + (F.count("*").over(Window.partitionBy("v")) - 1) / 2.0).alias("place"))
