"""Planted drift: what was moved is found, what was left alone is not."""

import pytest

from cohortshift.operators import drift, kernels
from cohortshift.plans import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def verdicts(spark):
    return {r["feature"]: r for r in registry.queries()["DRF-20"](spark, SF).collect()}


def test_flip_is_found(verdicts):
    assert verdicts["discount"]["verdict"] == "flipped" and verdicts["discount"]["stability"] < -0.9


def test_moved_features_are_distinguishable(verdicts):
    assert all(verdicts[f]["calibrated"] > 0.2 for f in ("quantity", "price", "zero", "discount"))
    assert all(verdicts[f]["calibrated"] <= 0.05 for f in ("tax", "code"))


def test_equal_constants_are_at_no_average_distance(spark):
    rows = [(i, 0, 0, 0, c, "Benign", 0, "f", 1.0) for i in range(30) for c in "AB"]
    long = spark.createDataFrame(rows, "okey long, lnum long, pkey long, skey long, cohort string, family string, y int, feature string, value double")
    assert drift.average_rank_wasserstein(long).first()["wasserstein_avg"] == 0
    # by position, ties put cohort A first: a known bias of the position-ranked form
    assert drift.rank_distances(long).first()["wasserstein_qn"] == pytest.approx(0.5, abs=0.02)


def test_small_slices(spark):
    rows = [(i, 0, 0, 0, c, "DoS" if i < 10 else "Benign", int(i < 10), "f", float(i * (1 + (c == "B")))) for i in range(60) for c in "AB"]
    long = spark.createDataFrame(rows, "okey long, lnum long, pkey long, skey long, cohort string, family string, y int, feature string, value double")
    got = {r["slice"]: r for r in kernels.c2st(long).collect()}
    assert got["attack"]["auc"] is None and got["attack"]["n_a"] == 10
    assert got["benign"]["auc"] is not None and got["pooled"]["null_floor"] is not None


def test_raw_distances_are_of_all_rows(spark):
    """DRF-03's raw values are those of DRF-07 to DRF-09, and its floors are of samples as large as the reference's."""
    q = registry.queries()
    got = {(r["feature"], r["metric"]): r for r in q["DRF-03"](spark, SF).collect()}
    for name, metric, column in (("DRF-07", "wasserstein_qn", "wasserstein_qn"), ("DRF-08", "energy_distance", "energy"), ("DRF-09", "ks_statistic", "ks")):
        for r in q[name](spark, SF).collect():
            assert got[r["feature"], metric]["raw"] == pytest.approx(r[column], abs=1e-6)
    # 1.36 (2 / n)^0.5 bounds the 95th percentile of KS: 0.043 for 2,000 rows a side, 0.011 for 30,000
    assert all(r["null_floor"] < 0.02 for (_, m), r in got.items() if m == "ks_statistic")
    assert kernels.DISTANCE_ROWS == {m: 2000 if m == "mmd" else 100_000 for m in kernels.lib1d.METRICS}


def test_spearman_by_broadcast_and_by_long_table(spark):
    """Both ways to the ranks agree with pandas, with ties and a null that takes its whole row out."""
    import numpy as np
    import pandas as pd

    from cohortshift.operators.corr import spearman

    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"cohort": ["A", "B"] * 60, "x": rng.integers(0, 9, 120) * 1.0, "z": rng.normal(size=120)})
    pdf["y"] = pdf["x"] * 2 + rng.integers(0, 5, 120)
    df = spark.createDataFrame(pdf)
    want = {c: pdf[pdf.cohort == c][["x", "y", "z"]].corr("spearman") for c in "AB"}
    for levels in (0, 20, 1000):
        got = spearman(df, ["x", "y", "z"], levels).collect()
        assert len(got) == 6
        assert all(abs(r["r"] - want[r["cohort"]].loc[r["a"], r["b"]]) < 1e-9 for r in got)
    with_null = df.unionByName(spark.createDataFrame([("A", None, 1.0, 2.0)], "cohort string, x double, y double, z double"))
    # the null's row counts in the ranks of its other columns, as a value of them
    a, b = ([(r["a"], r["b"], round(r["r"], 9)) for r in spearman(with_null, ["x", "y", "z"], n).where("cohort = 'A'").orderBy("a", "b").collect()] for n in (0, 1000))
    assert a == b


def test_modes_leave_out_zeros_and_the_sentinel(spark):
    from cohortshift.operators import kernels

    rows = [(i, i, i, i, "A", "f", float(v)) for i, v in enumerate([0.0] * 50 + [-1.0] * 50 + [7.0] * 60)]
    long = spark.createDataFrame(rows, "okey long, lnum long, pkey long, skey long, cohort string, feature string, value double")
    prof = spark.createDataFrame([("A", "f", "linear", -1.0)], "cohort string, feature string, scale string, sentinel_value double")
    got = kernels.modes(long, ["cohort", "feature"], profile=prof).first()
    assert (got["n_modes"], got["modes"][0]["center"], got["modes"][0]["mass"]) == (1, 7.0, 1.0)


def test_values_join_the_mode_nearest_on_their_scale(spark):
    """50 and 60 are nearer to 1 than to 1,000, but nearer to 1,000 in logarithms; a mode without values has distance 0."""
    from cohortshift.operators import drift

    long = spark.createDataFrame([("A", "f", 50.0), ("B", "f", 60.0)], "cohort string, feature string, value double")
    kind = "cohort string, feature string, log_scale boolean, modes array<struct<center double, spread double, mass double>>"
    two = [(1.0, 0.1, 0.5), (1000.0, 1.0, 0.5)]
    for log, own in ((False, 0), (True, 1)):
        modes = spark.createDataFrame([(c, "f", log, two) for c in "AB"], kind)
        assert {r["mode"]: r["wasserstein_qn"] for r in drift.per_mode(long, modes).collect()} == {own: 1.0, 1 - own: 0.0}


def test_mmd_compares_logarithms_on_a_log_scale(spark):
    """A shift of the small values, which the tail's width hides in raw units."""
    import numpy as np

    from cohortshift.operators import kernels

    rng = np.random.default_rng(3)
    tail = 10 ** rng.uniform(3, 7, 150)
    sides = {"A": np.concatenate([rng.uniform(1, 2, 150), tail]), "B": np.concatenate([rng.uniform(20, 40, 150), tail])}
    rows = [(i, i, i, i, c, "f", float(v)) for c, vs in sides.items() for i, v in enumerate(vs)]
    long = spark.createDataFrame(rows, "okey long, lnum long, pkey long, skey long, cohort string, feature string, value double")
    scales = spark.createDataFrame([("f", "log")], "feature string, scale string")
    raw, log = (kernels.distances(long, ["mmd"], scales=s).first() for s in (None, scales))
    assert raw["raw"] < 0.01 < 0.05 < log["raw"] and log["raw"] > log["null_floor"]


def test_the_record_follows_the_plan(spark):
    """Nominal features are compared by frequencies, continuous ones by ranks; parts that a route has not are null."""
    from cohortshift.plans import registry

    got = {r["feature"]: r for r in registry.queries()["DRF-20b"](spark, "/root/testdata/sf0.001").collect()}
    assert set(got) == {"quantity", "price", "discount", "tax", "zero", "code"}
    for r in got.values():
        nominal = r["route"] in ("nominal", "discrete_count")
        assert r["corroboration_primary"] == "jensen_shannon" if nominal else r["corroboration_primary"] in ("wasserstein_qn", "mmd")
        assert r["raw"] is not None and r["shift"] is not None
        assert not nominal or r["tail_wasserstein"] is None and r["max_mode_shift"] is None and r["shift"] == r["raw"]
    assert got["price"]["scale"] == "log" and got["price"]["shift"] > 0.1
