"""Queries: feature profiles, correlation and redundancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import CONFIG
from ..operators import corr as R
from ..operators import profile as P
from ..sources.views import REDUNDANT_FEATURES, cte, long_cte, long_view, view
from .registry import query

L = long_cte("drift")
K = "cohort, feature"


def _round(df, *names, at=6):
    return df.withColumns({n: F.round(n, at) + 0.0 for n in names})


@query("PRO-01", f"WITH {L} SELECT {K}, count(*) AS n, count(*) FILTER (WHERE value = 0) AS n_zero, min(value) AS min, max(value) AS max, round(avg(value), 6) + 0.0 AS mean, round(quantile_cont(value, 0.5), 6) + 0.0 AS median, round(stddev_pop(value), 6) AS std, round(max(value) - min(value), 6) AS range, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, round(mad(value), 6) AS mad FROM long GROUP BY 1, 2")
def pro_01(spark, d):
    long = long_view(spark, d)
    levels = P.counts(long)
    out = P.basic(long, levels).join(P.mad(long, levels), P.KEYS)
    return _round(out, "mean", "median", "std", "range", "iqr", "mad").select(*P.KEYS, "n", "n_zero", "min", "max", "mean", "median", "std", "range", "iqr", "mad")


MOM = f"{L}, m AS (SELECT {K}, avg(value) AS m, stddev_pop(value) AS s FROM long GROUP BY 1, 2)"


@query("PRO-02", f"WITH {MOM} SELECT l.cohort, l.feature, round(avg(pow((value - m) / s, 3)), 5) + 0.0 AS skewness, round(avg(pow((value - m) / s, 4)) - 3, 5) + 0.0 AS kurtosis FROM long l JOIN m ON l.cohort = m.cohort AND l.feature = m.feature GROUP BY 1, 2")
def pro_02(spark, d):
    return _round(P.basic(long_view(spark, d)), "skewness", "kurtosis", at=5).select(*P.KEYS, "skewness", "kurtosis")


@query("PRO-03", f"WITH {L} " + " UNION ALL ".join(f"SELECT {K}, {i} AS place, round(quantile_cont(value, {q / 100}), 6) + 0.0 AS q FROM long GROUP BY 1, 2" for i, q in enumerate(P.GRID)))
def pro_03(spark, d):
    return _round(P.percentiles(long_view(spark, d)), "q")


@query("PRO-04", f"WITH {L} SELECT {K}, round(coalesce(stddev_pop(value) / nullif(abs(avg(value)), 0), 0), 6) AS cv FROM long GROUP BY 1, 2")
def pro_04(spark, d):
    return _round(P.basic(long_view(spark, d)), "cv").select(*P.KEYS, "cv")


@query("PRO-05", f"WITH {L}, s AS (SELECT {K}, min(value) AS lo, max(value) AS hi FROM long GROUP BY 1, 2), b AS (SELECT l.cohort, l.feature, CASE WHEN hi > lo THEN least(49, floor((value - lo) / (hi - lo) * 50)) ELSE 0 END AS bin, count(*) AS n FROM long l JOIN s ON l.cohort = s.cohort AND l.feature = s.feature GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cohort, feature) AS p FROM b) SELECT {K}, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY 1, 2")
def pro_05(spark, d):
    return _round(P.entropy(long_view(spark, d)), "entropy")


Q = f"{L}, q AS (SELECT {K}, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, count(*) AS t FROM long GROUP BY 1, 2)"


@query("PRO-06", f"WITH {Q} SELECT l.cohort, l.feature, count(*) FILTER (WHERE value < a - 1.5 * (b - a)) AS n_low, count(*) FILTER (WHERE value > b + 1.5 * (b - a)) AS n_high, round(count(*) FILTER (WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / max(t), 6) AS fraction FROM long l JOIN q ON l.cohort = q.cohort AND l.feature = q.feature GROUP BY 1, 2")
def pro_06(spark, d):
    long = long_view(spark, d)
    return _round(P.outliers(long, P.basic(long)), "fraction")


@query("PRO-07", f"WITH {L}, q AS (SELECT {K}, quantile_cont(value, 0.005) AS a, quantile_cont(value, 0.995) AS b FROM long GROUP BY 1, 2), r AS (SELECT {K}, a, CASE WHEN b > a THEN b ELSE a + 1 END AS b FROM q) SELECT l.cohort, l.feature, round(a, 6) + 0.0 AS view_low, round(b, 6) + 0.0 AS view_high, count(*) FILTER (WHERE value < a) AS n_clipped_low, count(*) FILTER (WHERE value > b) AS n_clipped_high FROM long l JOIN r ON l.cohort = r.cohort AND l.feature = r.feature GROUP BY 1, 2, a, b")
def pro_07(spark, d):
    return _round(P.view_range(long_view(spark, d)), "view_low", "view_high")


@query("PRO-08", f"WITH {L} SELECT {K}, count(DISTINCT value) AS n_unique FROM long GROUP BY 1, 2")
def pro_08(spark, d):
    return P.basic(long_view(spark, d)).select(*P.KEYS, "n_unique")


MASS = f"{L}, b AS (SELECT {K}, min(value) AS lo, count(*) AS t, count(DISTINCT value) AS u, count(*) FILTER (WHERE value <> round(value)) AS frac, count(*) FILTER (WHERE value = 0) AS z FROM long GROUP BY 1, 2), m AS (SELECT l.cohort, l.feature, lo, t, u, frac, z, count(*) FILTER (WHERE value = lo) AS n_min FROM long l JOIN b ON l.cohort = b.cohort AND l.feature = b.feature GROUP BY 1, 2, 3, 4, 5, 6, 7)"


@query("PRO-09", f"WITH {MASS} SELECT {K}, n_min, n_min > t * 0.01 AS is_frequent FROM m")
def pro_09(spark, d):
    long = long_view(spark, d)
    levels = P.counts(long)
    s = P.basic(long, levels)
    m = P.minimum_mass(levels, s).join(s, P.KEYS)
    return m.select(*P.KEYS, "n_min", (F.col("n_min") > F.col("n_total") * CONFIG.sentinel_mass).alias("is_frequent"))


RANKS = "{l}, n AS (SELECT {k}, value, count(*) FILTER (WHERE y = 1) AS n1, count(*) FILTER (WHERE y = 0) AS n0 FROM {t} GROUP BY {k}, value), c AS (SELECT *, sum(n0) OVER (PARTITION BY {k} ORDER BY value) AS c0 FROM n), a AS (SELECT {k}, coalesce(sum(n1 * (c0 - n0 / 2)) / nullif(sum(n1) * sum(n0), 0), 0.5) AS auc FROM c GROUP BY {k})"
SEP = "round(auc, 6) AS auc_raw, round(greatest(auc, 1 - auc), 6) AS magnitude, CASE WHEN abs(auc - 0.5) >= 0.05 THEN sign(auc - 0.5) ELSE 0 END::DOUBLE AS direction"


@query("PRO-10", f"WITH {RANKS.format(l=L, k=K, t='long')} SELECT {K}, {SEP} FROM a")
def pro_10(spark, d):
    return _round(P.separation(long_view(spark, d)), "auc_raw", "magnitude")


@query("PRO-12", f"WITH {RANKS.format(l=L + ', f AS (SELECT cohort, feature, value, y, family AS against FROM long WHERE y = 1 UNION ALL SELECT cohort, feature, value, y, x.against FROM long, (SELECT DISTINCT family AS against FROM long WHERE y = 1) x WHERE y = 0)', k='cohort, feature, against', t='f')} SELECT cohort, feature, against, {SEP} FROM a")
def pro_12(spark, d):
    return _round(P.family_separation(long_view(spark, d)), "auc_raw", "magnitude")


@query("PRO-11")
def pro_11(spark, d):
    """Nearest-neighbour mutual information with the label, in nats and over the label's entropy."""
    from ..operators.kernels import mutual_information

    return mutual_information(long_view(spark, d), P.KEYS)


@query("PRO-13")
def pro_13(spark, d):
    """Modes without zeros and sentinels, on the feature's scale: a dip test, then mixtures by BIC."""
    from ..operators.kernels import modes
    from ..operators.pipeline import profiles

    long = long_view(spark, d)
    return modes(long, P.KEYS, profile=profiles(long, P.counts(long)))


@query("PRO-14", f"WITH {L} SELECT {K}, count(*) AS n, CAST(NULL AS VARCHAR) AS error FROM long GROUP BY 1, 2")
def pro_14(spark, d):
    """Profiles whose errors are kept as a column, not raised."""
    return P.basic(long_view(spark, d)).select(*P.KEYS, "n", F.lit(None).cast("string").alias("error"))


TYPES = f"{MASS}, ty AS (SELECT cohort, feature, CASE WHEN u <= 2 THEN 'binary' WHEN u <= 10 THEN 'low-cardinality-discrete' WHEN frac = 0 AND u <= 100 THEN 'discrete-count' ELSE 'continuous' END AS detected_type, z / t >= 0.1 AS zero_inflated, lo < 0 AND frac = 0 AND n_min > t * 0.01 AS has_sentinel, u <= 1 AS degenerate FROM m)"


@query("REL-16", f"WITH {TYPES} SELECT cohort, feature, detected_type, zero_inflated, has_sentinel, degenerate FROM ty")
def rel_16(spark, d):
    long = long_view(spark, d)
    levels = P.counts(long)
    s = P.basic(long, levels)
    return P.detect_type(s, P.minimum_mass(levels, s)).select(*P.KEYS, "detected_type", "zero_inflated", "has_sentinel", "degenerate")


@query("REL-17", f"WITH {TYPES}, v AS (SELECT cohort, feature, min(value) FILTER (WHERE value > 0) AS a, max(value) FILTER (WHERE value > 0) AS b, count(*) FILTER (WHERE value <= 0) AS n_low, quantile_cont(abs(value), 0.1) FILTER (WHERE value <> 0) AS thr FROM long GROUP BY 1, 2), x AS (SELECT ty.cohort, ty.feature, thr, CASE WHEN detected_type <> 'continuous' THEN 'categorical' WHEN zero_inflated OR n_low > 0 THEN 'symlog' WHEN b / a > 100 THEN 'log' ELSE 'linear' END AS scale FROM ty JOIN v ON ty.cohort = v.cohort AND ty.feature = v.feature) SELECT cohort, feature, scale, CASE WHEN scale = 'symlog' THEN round(greatest(thr, 1e-9), 6) END AS scale_param FROM x")
def rel_17(spark, d):
    long = long_view(spark, d)
    levels = P.counts(long)
    s = P.basic(long, levels)
    types = P.detect_type(s, P.minimum_mass(levels, s))
    return P.select_scale(levels, types).select(*P.KEYS, "scale", F.round("scale_param", 6).alias("scale_param"))


FE = REDUNDANT_FEATURES
_pairs = [(a, b) for i, a in enumerate(FE) for b in FE[i + 1 :]]


def _matrix_sql(t: str) -> str:
    return " UNION ALL ".join(f"SELECT cohort, '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {t} GROUP BY cohort" for a, b in _pairs)


RANKED = "rk AS (SELECT cohort, " + ", ".join(f"rank() OVER (PARTITION BY cohort ORDER BY {f}) + (count(*) OVER (PARTITION BY cohort, {f}) - 1) / 2 AS {f}" for f in FE) + " FROM red)"
MATS = f"{cte('red')}, {RANKED}, pm AS ({_matrix_sql('red')}), sm AS ({_matrix_sql('rk')})"
CONS = MATS + "".join(f", {o} AS (SELECT a, b, avg(abs(r)) AS mean_r, min(abs(r)) AS min_r, max(CASE cohort WHEN 'A' THEN abs(r) END) AS r_a, max(CASE cohort WHEN 'B' THEN abs(r) END) AS r_b FROM {m} GROUP BY a, b)" for o, m in (("pc", "pm"), ("sc", "sm")))


def _components(name: str, edge: str) -> str:
    return f"{name}_e AS ({edge}), {name}_b AS (SELECT a, b FROM {name}_e UNION SELECT b, a FROM {name}_e UNION SELECT a, a FROM {name}_e UNION SELECT b, b FROM {name}_e), {name}_w AS (SELECT a, b FROM {name}_b UNION SELECT w.a, e.b FROM {name}_w w JOIN {name}_b e ON w.b = e.a), {name} AS (SELECT a AS feature, min(b) AS root FROM {name}_w GROUP BY a)"


GROUPS = CONS + ", " + _components("g", "SELECT pc.a, pc.b FROM pc JOIN sc ON pc.a = sc.a AND pc.b = sc.b WHERE pc.min_r >= 0.95 AND sc.min_r >= 0.95")
REPS = GROUPS + ", me AS (SELECT feature, avg(mean_r) AS m FROM (SELECT a AS feature, mean_r FROM pc UNION ALL SELECT b, mean_r FROM pc) GROUP BY 1), kp AS (SELECT root, feature AS keep FROM (SELECT root, g.feature, row_number() OVER (PARTITION BY root ORDER BY round(m, 9), g.feature) AS k FROM g JOIN me ON g.feature = me.feature) WHERE k = 1)"
CLASS = REPS + ", cl AS (SELECT keep, g.feature AS drop_, CASE WHEN pc.r_a >= 0.95 AND pc.r_b >= 0.95 AND sc.min_r >= 0.95 THEN 'stable' WHEN pc.r_a >= 0.95 AND pc.r_b >= 0.95 THEN 'stable_pearson_only' WHEN pc.r_a >= 0.95 THEN 'shifted_a' WHEN pc.r_b >= 0.95 THEN 'shifted_b' ELSE 'weak_transitive' END AS status FROM g JOIN kp ON g.root = kp.root AND g.feature <> kp.keep JOIN pc ON pc.a = least(keep, g.feature) AND pc.b = greatest(keep, g.feature) JOIN sc ON sc.a = pc.a AND sc.b = pc.b)"


def _red(spark, d):
    return view(spark, d, "red")


def _consensus(spark, d):
    v = _red(spark, d)
    return R.small(R.consensus(R.pearson(v, FE))), R.small(R.consensus(R.spearman(v, FE)))


@query("AGG-05", f"WITH {MATS} SELECT cohort, a, b, round(r, 6) + 0.0 AS r FROM pm")
def agg_05(spark, d):
    return _round(R.pearson(_red(spark, d), FE), "r")


@query("AGG-06", f"WITH {MATS} SELECT cohort, a, b, round(r, 6) + 0.0 AS r FROM sm")
def agg_06(spark, d):
    return _round(R.spearman(_red(spark, d), FE), "r")


@query("AGG-07", f"WITH {CONS} SELECT a, b, round(mean_r, 6) AS mean_r, round(min_r, 6) AS min_r FROM pc")
def agg_07(spark, d):
    return _round(R.consensus(R.pearson(_red(spark, d), FE)), "mean_r", "min_r").select("a", "b", "mean_r", "min_r")


@query("AGG-22", f"WITH RECURSIVE {GROUPS} SELECT x.root, round(avg(abs(r)), 6) AS mean_r FROM sm JOIN g x ON sm.a = x.feature JOIN g z ON sm.b = z.feature WHERE x.root = z.root GROUP BY 1")
def agg_22(spark, d):
    p, s = _consensus(spark, d)
    return _round(R.within_groups(R.groups(R.edges(p, s)), R.spearman(_red(spark, d), FE)), "mean_r")


@query("JN-02", "SELECT * FROM (VALUES ('cents'), ('price'), ('tax')) t(feature)")
def jn_02(spark, d):
    """Features that all matrices have."""
    a, b = (R.pearson(_red(spark, d), f).select(F.explode(F.array("a", "b")).alias("feature")).distinct() for f in (["cents", "price", "tax", "mono"], ["cents", "price", "tax", "local"]))
    return a.join(b, "feature", "left_semi")


@query("JN-09", f"WITH {MATS} SELECT cohort, round(r, 6) AS r FROM pm WHERE a = 'cents' AND b = 'price'")
def jn_09(spark, d):
    return _round(R.pearson(_red(spark, d), FE).where("a = 'cents' and b = 'price'"), "r").select("cohort", "r")


@query("GRF-01", f"WITH {MATS} SELECT cohort, a, b, round(r, 6) AS r FROM pm WHERE abs(r) >= 0.9")
def grf_01(spark, d):
    return _round(R.flagged(R.pearson(_red(spark, d), FE)), "r")


@query("GRF-02", f"WITH {GROUPS} SELECT a, b FROM g_e")
def grf_02(spark, d):
    return R.edges(*_consensus(spark, d))


@query("GRF-03", f"WITH RECURSIVE {GROUPS} SELECT feature, root FROM g")
def grf_03(spark, d):
    return R.groups(R.edges(*_consensus(spark, d)))


@query("GRF-04", f"WITH RECURSIVE {REPS} SELECT root, keep FROM kp")
def grf_04(spark, d):
    p, s = _consensus(spark, d)
    return R.representatives(R.groups(R.edges(p, s)), p)


def _classified(spark, d):
    p, s = _consensus(spark, d)
    g = R.groups(R.edges(p, s))
    return R.classify(g, R.representatives(g, p), p, s)


@query("GRF-05", f"WITH RECURSIVE {CLASS} SELECT keep, drop_ AS \"drop\", status FROM cl")
def grf_05(spark, d):
    return _classified(spark, d)


@query("GRF-06", f"WITH RECURSIVE {CLASS} SELECT drop_ AS feature, CASE WHEN bool_or(status = 'stable') THEN 'drop' ELSE 'monitor' END AS decision FROM cl GROUP BY 1")
def grf_06(spark, d):
    return R.drop_list(_classified(spark, d))


@query("GRF-07", f"WITH {CONS} SELECT a, b, CASE WHEN r_a >= 0.9 THEN 'A_only' ELSE 'B_only' END AS correlated_in FROM pc WHERE (r_a >= 0.9) <> (r_b >= 0.9) AND mean_r < 0.95")
def grf_07(spark, d):
    return R.drifted(R.consensus(R.pearson(_red(spark, d), FE)))


@query("GRF-08", "WITH RECURSIVE " + CONS + "".join(", " + _components(f"t{i}", f"SELECT pc.a, pc.b FROM pc JOIN sc ON pc.a = sc.a AND pc.b = sc.b WHERE pc.min_r >= {t} AND sc.min_r >= {t}") for i, t in enumerate(CONFIG.sweep_corr)) + " " + " UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, count(DISTINCT root)::INT AS n_groups, (count(*) - count(DISTINCT root))::INT AS n_dropped FROM t{i}" for i, t in enumerate(CONFIG.sweep_corr)))
def grf_08(spark, d):
    return R.sweep(*_consensus(spark, d))


@query("VIZ-03", f"WITH {L} SELECT feature, cohort, value, count(*) AS n FROM (SELECT feature, cohort, round(value) AS value FROM long WHERE feature IN ('code')) GROUP BY 1, 2, 3")
def viz_03(spark, d):
    """Level frequencies of a discrete feature."""
    return long_view(spark, d).where("feature = 'code'").groupBy("feature", "cohort", F.round("value").alias("value")).agg(F.count("*").alias("n"))


@query("VIZ-05", f"WITH {CONS} SELECT a, b, round(r_b - r_a, 6) + 0.0 AS gap FROM pc")
def viz_05(spark, d):
    """Cells of the difference heat map."""
    c = R.consensus(R.pearson(_red(spark, d), FE))
    return c.select("a", "b", (F.round(F.col("r_b") - F.col("r_a"), 6) + 0.0).alias("gap"))


@query("WIN-02", f"WITH {cte('red')}, {RANKED} SELECT cohort, round(sum(quantity * price), 2) AS total FROM rk GROUP BY 1")
def win_02(spark, d):
    from ..functions.ranks import average_ranks

    v = _red(spark, d)
    for f in ("quantity", "price"):
        v = average_ranks(v, ["cohort"], f, f"r_{f}")
    return v.groupBy("cohort").agg(F.round(F.sum(F.col("r_quantity") * F.col("r_price")), 2).alias("total"))


@query("SRT-01", f"WITH {MATS} SELECT cohort, a, b, rank() OVER (PARTITION BY cohort ORDER BY round(abs(r), 6) DESC, a, b) AS place FROM pm")
def srt_01(spark, d):
    from pyspark.sql import Window

    m = R.pearson(_red(spark, d), FE)
    return m.select("cohort", "a", "b", F.rank().over(Window.partitionBy("cohort").orderBy(F.desc(F.round(F.abs("r"), 6)), "a", "b")).alias("place"))
