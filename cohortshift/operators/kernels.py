"""Kernels that have no SQL form, run on groups whose size is capped by hash before they are grouped."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, T_975_DF4
from ..functions import lib1d
from .profile import finite_rows
from .split import random_cap

ROW_KEY = "concat_ws('-', okey, lnum, pkey, skey, feature)"


def _rng(*names: str):
    """One generator for each group, whatever the schedule."""
    return np.random.default_rng(zlib.crc32("|".join(names).encode()))


def mutual_information(long: DataFrame, keys: list[str], cap: int = 60_000, total: int = 80_000) -> DataFrame:
    """(keys, mi, mi_normalized) of each feature with the label, on at most cap rows of a label and total rows in all."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > total:
            g = g.sort_values(["y", "value"]).iloc[np.sort(_rng(*(str(g[k].iloc[0]) for k in keys)).choice(len(g), total, replace=False))]
        y = g["y"].to_numpy()
        mi = lib1d.mutual_information(g["value"].to_numpy(), y)
        p = np.bincount(y, minlength=2) / len(y)
        h = float(-(p[p > 0] * np.log(p[p > 0])).sum())
        return pd.DataFrame([(*(g[k].iloc[0] for k in keys), mi, float(np.clip(mi / h, 0, 1)) if h > 0 else 0.0)])

    rows = random_cap(finite_rows(long), [*keys, "y"], F.expr(ROW_KEY), cap, few_groups=True).select(*keys, "y", "value")
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", mi double, mi_normalized double")


#: Scales on which modes and kernel widths are taken in logarithms.
LOG_SCALES = ("log", "symlog")


def scaled_modes(x: np.ndarray, scale: str | None, rng) -> list[tuple[float, float, float]]:
    """Modes of non-zero values as (centre, spread, mass) in their own units, centres ascending.

    On a logarithmic scale they are found among the logarithms of the positive values, and a mode's centre and spread
    are the median and deviation of the values nearest to it there; too few positive values are one mode.
    """
    if scale not in LOG_SCALES or not len(x):
        return lib1d.fit_modes(x, rng)
    base = x[x > 0]
    if len(base) < CONFIG.min_modal:
        return [(float(np.median(x)), float(x.std()), 1.0)]
    logs = np.log10(base)
    centres = np.array([m[0] for m in lib1d.fit_modes(logs, rng)])
    own = np.searchsorted((centres[1:] + centres[:-1]) / 2, logs)
    parts = [base[own == i] for i in range(len(centres))]
    return [(float(np.median(p)), float(p.std()), len(p) / len(base)) for p in parts if len(p)]


def modes(long: DataFrame, keys: list[str], cap: int = 50_000, profile: DataFrame | None = None) -> DataFrame:
    """(keys, n_modes, modes): modes of values other than zero and the sentinel, centre first, as an array of structs.

    profile has a row of (keys, scale, sentinel_value) for each group; without it values are taken as they are.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        names = [g[k].iloc[0] for k in keys]
        found = scaled_modes(g["value"].to_numpy(), g["scale"].iloc[0], _rng(*map(str, names)))
        return pd.DataFrame([(*names, len(found), [dict(zip(("center", "spread", "mass"), m, strict=True)) for m in found])])

    rows = finite_rows(long).where("value <> 0")
    if profile is None:
        rows = rows.withColumn("scale", F.lit(None).cast("string"))
    else:
        rows = rows.join(profile.select(*keys, "scale", "sentinel_value"), keys).where(~F.col("value").eqNullSafe(F.col("sentinel_value")))
    rows = random_cap(rows, keys, F.expr(ROW_KEY), cap, few_groups=True).select(*keys, "value", "scale")
    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} string" for k in keys) + ", n_modes int, modes array<struct<center double, spread double, mass double>>")


def slice_sample(long: DataFrame, cap: int) -> DataFrame:
    """(feature, slice, cohort, value): at most cap finite rows of each cohort in each slice, by hash.

    Slices are pooled, benign, attack, and each family that both cohorts have. Their sizes come from counts of
    (feature, cohort, family, label), a table that the schema bounds; it is joined back by broadcast, and a row
    is copied to a slice only if its hash is small enough for that slice's sample.
    """
    rows = finite_rows(long)
    n = rows.groupBy("feature", "cohort", "family", "y").count().collect()
    cohorts = {f: {r["cohort"] for r in n if r["family"] == f} for f in {r["family"] for r in n}}
    names = lambda r: ["pooled", "attack" if r["y"] else "benign", *([f"family:{r['family']}"] if r["y"] and len(cohorts[r["family"]]) == 2 else [])]
    size: dict = {}
    for r in n:
        for s in names(r):
            size[r["feature"], r["cohort"], s] = size.get((r["feature"], r["cohort"], s), 0) + r["count"]
    margin = cap + 8 * cap**0.5 + 8
    table = [(r["feature"], r["cohort"], r["family"], int(r["y"]), s, margin / size[r["feature"], r["cohort"], s]) for r in n for s in names(r)]
    wanted = long.sparkSession.createDataFrame(table, "feature string, cohort string, family string, y int, slice string, share double")
    hashed = rows.withColumn("h", F.xxhash64(F.expr(ROW_KEY))).withColumn("u", F.shiftrightunsigned("h", 11) / float(1 << 53))
    some = hashed.join(F.broadcast(wanted), ["feature", "cohort", "family", "y"]).where("u <= share")
    place = F.row_number().over(Window.partitionBy("feature", "slice", "cohort").orderBy("h"))
    return some.withColumn("r", place).where(F.col("r") <= cap).select("feature", "slice", "cohort", "value")


def c2st(long: DataFrame, cap: int = CONFIG.c2st_sample) -> DataFrame:
    """(feature, slice, auc, ci_low, ci_high, null_floor, n_a, n_b): classifier two-sample tests with their nulls.

    Slices under 20 finite rows a side have null values; those under 50 have no null floor.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        feature, part = g["feature"].iloc[0], g["slice"].iloc[0]
        a, b = (g.loc[g["cohort"] == c, "value"].to_numpy() for c in "AB")
        if min(len(a), len(b)) < CONFIG.min_slice:
            return pd.DataFrame([(feature, part, None, None, None, None, len(a), len(b))])
        rng = _rng(feature, part)
        mean, lo, hi = lib1d.interval(lib1d.c2st_folds(a, b, rng), T_975_DF4)
        null = lib1d.permutation_null(a, b, lib1d.c2st_once, lib1d.RESPLITS["c2st"], rng)
        return pd.DataFrame([(feature, part, mean, lo, hi, null, len(a), len(b))])

    rows = slice_sample(long, cap)
    return rows.groupBy("feature", "slice").applyInPandas(run, "feature string, slice string, auc double, ci_low double, ci_high double, null_floor double, n_a long, n_b long")


#: Rows a side of each distance and of its null: at least the reference's; kernels compare all pairs.
DISTANCE_ROWS = {m: 2000 if m == "mmd" else 100_000 for m in lib1d.METRICS}


def distances(long: DataFrame, metrics: list[str], caps: dict[str, int] = DISTANCE_ROWS, scales: DataFrame | None = None) -> DataFrame:
    """(feature, metric, raw, null_floor): corroboration distances of the cohorts, pooled, with their nulls at the same size.

    scales has (feature, scale); where that is logarithmic, MMD compares sign(x) log(1 + |x|), so that the tail does not
    set its kernel's width. All other metrics stay the same under such a map.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        feature = g["feature"].iloc[0]
        sides = [np.sort(g.loc[g["cohort"] == c, "value"].to_numpy()) for c in "AB"]
        rows = []
        for m in metrics:
            rng = _rng(feature, m)
            a, b = (s if len(s) <= caps[m] else rng.choice(s, caps[m], replace=False) for s in sides)
            if m == "mmd" and g["scale"].iloc[0] in LOG_SCALES:
                a, b = (np.sign(s) * np.log1p(np.abs(s)) for s in (a, b))
            rows.append((feature, m, lib1d.METRICS[m](a, b, rng), lib1d.permutation_null(a, b, lib1d.METRICS[m], lib1d.RESPLITS[m], rng)))
        return pd.DataFrame(rows)

    cap = max(caps[m] for m in metrics)
    rows = random_cap(finite_rows(long), ["feature", "cohort"], F.expr(ROW_KEY), cap, few_groups=True).select("feature", "cohort", "value")
    rows = rows.withColumn("scale", F.lit(None).cast("string")) if scales is None else rows.join(scales.select("feature", "scale"), "feature", "left")
    return rows.groupBy("feature").applyInPandas(run, "feature string, metric string, raw double, null_floor double")


def separation_nulls(long: DataFrame, cap: int = 5000, resplits: int = 30) -> DataFrame:
    """(cohort, feature, auc_null, mi_null): 95th percentiles of folded AUC and normalised MI under shuffled labels."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        cohort, feature = g["cohort"].iloc[0], g["feature"].iloc[0]
        rng, x, y = _rng(cohort, feature), g["value"].to_numpy(), g["y"].to_numpy()
        p = y.mean()
        h = -(p * np.log(p) + (1 - p) * np.log(1 - p)) if 0 < p < 1 else 0.0
        aucs, mis = [], []
        for _ in range(resplits):
            s = rng.permutation(y)
            a = lib1d.auc(s, x)
            aucs.append(max(a, 1 - a))
            mis.append(lib1d.mutual_information(x, s) / h if h else 0.0)
        return pd.DataFrame([(cohort, feature, float(np.percentile(aucs, 95)), float(np.percentile(mis, 95)))])

    rows = random_cap(finite_rows(long), ["cohort", "feature"], F.expr(ROW_KEY), cap, few_groups=True).select("cohort", "feature", "y", "value")
    return rows.groupBy("cohort", "feature").applyInPandas(run, "cohort string, feature string, auc_null double, mi_null double")


def univariate_transfer(long: DataFrame, cap: int = 20_000, depth: int = 3) -> DataFrame:
    """(feature, accuracy_within, accuracy_cross, drop, transfers_well): a balanced tree on one feature of cohort A."""

    def balanced(y, pred):
        return float(np.mean([(pred[y == c] == c).mean() for c in (0, 1) if (y == c).any()]))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        feature = g["feature"].iloc[0]
        a, b = g[g["cohort"] == "A"], g[g["cohort"] == "B"]
        test = a["okey"].to_numpy() % 5 == 0
        x, y = a["value"].to_numpy(), a["y"].to_numpy()
        share = y[~test].mean()
        w = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        tree = lib1d.Tree(x[~test], y[~test], depth, w[~test])
        within = balanced(y[test], tree.predict(x[test]) >= 0.5)
        cross = balanced(b["y"].to_numpy(), tree.predict(b["value"].to_numpy()) >= 0.5)
        return pd.DataFrame([(feature, within, cross, within - cross, bool(within - cross < 0.05 and cross > 0.55))])

    rows = random_cap(finite_rows(long), ["feature", "cohort", "y"], F.expr(ROW_KEY), cap, few_groups=True).select("feature", "cohort", "okey", "y", "value")
    return rows.groupBy("feature").applyInPandas(run, "feature string, accuracy_within double, accuracy_cross double, drop double, transfers_well boolean")


def densities(long: DataFrame, cap: int = 30_000, points: int = 220) -> DataFrame:
    """(cohort, feature, x, density): curves of the finite values in axis space."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x, d = lib1d.kde(g["value"].to_numpy(), points)
        return pd.DataFrame({"cohort": g["cohort"].iloc[0], "feature": g["feature"].iloc[0], "x": x, "density": d})

    rows = random_cap(finite_rows(long), ["cohort", "feature"], F.expr(ROW_KEY), cap, few_groups=True).select("cohort", "feature", "value")
    return rows.groupBy("cohort", "feature").applyInPandas(run, "cohort string, feature string, x double, density double")
