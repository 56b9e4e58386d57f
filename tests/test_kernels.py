"""Kernels against closed forms, planted effects and pairwise definitions."""

import zlib

import numpy as np
import pytest

from cohortshift.config import CONFIG
from cohortshift.functions import lib1d as K
from cohortshift.operators import clean, split, stats

RNG = np.random.default_rng(5)


def test_digamma():
    assert K.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-8)
    assert K.digamma(np.array([0.5, 10.0])) == pytest.approx([-1.9635100260, 2.2517525891], abs=1e-8)


def test_auc_counts_pairs():
    y, s = RNG.integers(2, size=60), RNG.integers(9, size=60).astype(float)
    a, b = s[y == 1][:, None], s[y == 0][None, :]
    assert K.auc(y, s) == pytest.approx(((a > b) + 0.5 * (a == b)).mean())


def test_energy_is_the_pairwise_statistic():
    a, b = RNG.normal(size=80), RNG.normal(0.4, size=70)
    r, q = K.ranks01(a, b)
    pair = lambda u, v: np.abs(u[:, None] - v[None, :]).mean()
    assert K.energy(a, b) == pytest.approx(2 * pair(r, q) - pair(r, r) - pair(q, q))


def test_mutual_information_of_gaussians():
    y = RNG.integers(2, size=4000)
    assert K.mutual_information(RNG.normal(size=4000), y) < 0.02
    assert K.mutual_information(RNG.normal(size=4000) + 20 * y, y) == pytest.approx(np.log(2), abs=0.02)


def test_c2st_sees_shifts_and_ignores_none():
    a, b = RNG.normal(size=500), RNG.normal(size=500)
    null = K.permutation_null(a, b, K.c2st_once, 20, np.random.default_rng(0))
    assert np.mean(K.c2st_folds(a, b, np.random.default_rng(0))) < null + 0.05
    assert np.mean(K.c2st_folds(a, b + 3, np.random.default_rng(0))) > 0.9
    assert K.permutation_null(a[:30], b, K.ks, 5, RNG) is None


@pytest.mark.parametrize("name", sorted(K.METRICS))
def test_metrics_grow_with_the_shift(name):
    a = RNG.integers(20, size=400).astype(float)
    same, moved = K.METRICS[name](a, RNG.permutation(a)), K.METRICS[name](a, a + 15)
    assert moved > same


def test_modes():
    one, two = RNG.normal(size=2000), np.concatenate([RNG.normal(-6, 1, 1200), RNG.normal(6, 1, 800)])
    assert len(K.fit_modes(one, np.random.default_rng(1))) == 1
    found = K.fit_modes(two, np.random.default_rng(1))
    assert [round(m[0]) for m in found] == [-6, 6] and found[0][2] == pytest.approx(0.6, abs=0.03)


def test_small_second_mode():
    """The dip test sees all values, so a mode of a few percent is not lost; steps of a grid are no modes."""
    x = np.concatenate([np.random.default_rng(7).normal(0, 1, 9600), np.random.default_rng(8).normal(8, 0.5, 400)])
    found = K.fit_modes(x, np.random.default_rng(1))
    assert [round(m[0]) for m in found] == [0, 8] and found[1][2] == pytest.approx(0.04, abs=0.005)
    grid = np.random.default_rng(9).integers(1, 51, 20_000).astype(float)
    assert len(K.fit_modes(grid, np.random.default_rng(1))) == 1


def test_signed_rank_exact():
    assert K.signed_rank_p(np.array([1.0, 2, 3, 4, 5])) == (0.0, pytest.approx(2 / 32))
    assert K.signed_rank_p(np.zeros(4)) == (0.0, 1.0)


def test_split_counts_of_small_classes(spark):
    """Classes of 736 and 104 rows get 27 and 63 test rows from the formula."""
    for code, n, want in ((1, 736, 27), (7, 104, 63)):
        df = spark.range(n).selectExpr("id", f"{code} AS c")
        assert split.systematic_split(df, "c", ["id"]).where("split = 'test'").count() == want


def test_labels(spark):
    raw = ["DoS Hulk", " benign ", "x - Attempted", "Infiltration - NMAP Portscan", "Port Scan 2", "DDDoS", "dos unknown", "Brute Force -Web", "my patator", "Heartbleed", None]
    df = spark.createDataFrame([(r,) for r in raw], "label string")
    got = [r[0] for r in df.select(clean.family(clean.relabel_attempted(df.label))).collect()]
    assert got == ["DoS", "Benign", "Benign", "Infiltration", "PortScan", "DDoS", "DoS", "WebAttack", "BruteForce", None, None]


def test_unknown_family_is_an_error(spark):
    with pytest.raises(Exception, match="unknown family"):
        clean.encode(spark.createDataFrame([("Worm",)], "family string")).collect()


def test_assert_finite(spark):
    with pytest.raises(Exception, match="non-finite"):
        clean.assert_finite(spark.createDataFrame([(float("nan"),)], "v double"), ["v"]).collect()


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    t = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(p)], "test string, p double")
    got = {r["test"]: r["q_value"] for r in stats.benjamini_hochberg(t).collect()}
    assert [round(got[f"t{i}"], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5]


@pytest.mark.parametrize("levels", [7, 100_000])
def test_benjamini_hochberg_without_a_task_for_all_rows(spark, levels):
    """Ties, a frequent value and nulls, which are last: the definition row by row, and no window over all tests."""
    p = [None if i % 50 == 0 else 0.3 if i % 3 == 0 else float(v) for i, v in enumerate(RNG.integers(1, levels, 3000) / levels)]
    t = spark.createDataFrame(list(enumerate(p)), "test long, p double").repartition(6)
    out = stats.benjamini_hochberg(t)
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    order = sorted(range(len(p)), key=lambda i: (p[i] is None, p[i] or 0))
    low, want = 1.0, {}
    for r in range(len(p), 0, -1):
        v = p[order[r - 1]]
        low = low if v is None else min(low, v * len(p) / r)
        want[order[r - 1]] = (low, low <= 0.05)
    got = {r["test"]: (r["q_value"], r["reject"]) for r in out.collect()}
    assert got == {i: (pytest.approx(q, rel=1e-12), reject) for i, (q, reject) in want.items()}


def test_headline_correlation_works_on_counts(spark, monkeypatch):
    """ST-02 neither collects its rows nor ranks them all in one window."""
    from cohortshift.plans import registry

    monkeypatch.setattr(stats, "arrays", None)
    monkeypatch.setattr(stats, "_avg_rank", None)
    row = registry.queries()["ST-02"](spark, "/root/testdata/sf0.001").first()
    assert -1 <= row["spearman"] <= 1 and -1 <= row["kendall"] <= 1


@pytest.mark.parametrize("name", ["ST-06", "WIN-04"])
def test_q_values_need_no_window_over_all_features(spark, name):
    from cohortshift.plans import registry

    out = registry.queries()[name](spark, "/root/testdata/sf0.001")
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ST-06", "WIN-04"])
def test_q_values_of_few_distinct_p_need_no_running_totals(spark, monkeypatch, name):
    """They come from one small table on the driver, not from a chain of jobs."""
    from cohortshift.plans import registry

    monkeypatch.setattr(stats, "running_totals", None)
    monkeypatch.setattr(stats, "following_min", None)
    assert registry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_q_values_on_the_driver_and_in_spark(spark):
    """Both forms agree on ties, nulls, NaN, zero and p over 1, to the last bit, and without any test."""
    p = [None, float("nan"), 0.0, -0.0, 1.0, 1.5, *(float(v) for v in RNG.integers(1, 60, 400) / 300)]
    t = spark.createDataFrame(list(enumerate(p)), "test long, p double").repartition(5)
    few, wide, edge = (stats.benjamini_hochberg(t, at_once=n).drop("p").orderBy("test").collect() for n in (stats.CELLS, 0, len(set(p[2:])) + 2))
    assert few == wide == edge and len(few) == len(p)
    assert [r["q_value"] for r in few[:6]] == [1.0, 1.0, 0.0, 0.0, 1.0, 1.0] and [r["reject"] for r in few[:3]] == [False, False, True]
    assert stats.benjamini_hochberg(t.where("test < 0")).count() == stats.benjamini_hochberg(t.where("test < 0"), at_once=0).count() == 0


def test_buckets_of_many_p_are_the_same_in_every_step(spark, monkeypatch):
    """A sketch of many values may differ each time it is made, so running totals may not make it once more."""
    plans, own = [], stats.saved
    monkeypatch.setattr(stats, "saved", lambda df: plans.append(df._jdf.queryExecution().analyzed().toString()) or own(df))
    t = spark.createDataFrame([(i, i / 900) for i in range(700)], "test long, p double")
    assert stats.benjamini_hochberg(t, at_once=0).count() == 700
    cells = t.selectExpr("p", "-p AS r", "1L AS n")
    plans.append(stats.rank_corr(cells, "p", "r", "n", [])._jdf.queryExecution().analyzed().toString())
    assert len(plans) == 4 and not any("percentile_approx" in p for p in plans)


def test_resamples_in_blocks(spark):
    """Many blocks draw as one would: n rows in each draw, each row as often as its size, the spread of a multinomial."""
    rows = [(f"r{i}", 1 + i % 3) for i in range(90)]
    df = spark.createDataFrame(rows, "key string, size int").repartition(3)
    got = stats.resamples(df, 400, "x", size="size", made=4000)
    assert got.schema.simpleString() == "struct<draw:int,key:string,n:int>"
    t = got.toPandas().pivot_table(index="draw", columns="key", values="n", fill_value=0, aggfunc="sum")
    total = sum(s for _, s in rows)
    assert t.shape == (400, 90) and (t.sum(axis=1) == total).all()
    one, all_sizes = t.mean(), np.array([dict(rows)[k] for k in t.columns])
    assert np.abs(one - all_sizes).max() < 5 * np.sqrt(3 / 400) and (t.var() / all_sizes).mean() == pytest.approx(1 - 1 / 90, abs=0.05)
    assert t.corr().to_numpy()[np.triu_indices(90, 1)].mean() == pytest.approx(-1 / 89, abs=0.003)
    again = stats.resamples(df.repartition(7), 400, "x", size="size", made=4000)
    assert sorted(again.collect()) == sorted(got.collect())
    plain = stats.resamples(df.select("key"), 3, "x").groupBy("draw").sum("n").collect()
    assert [tuple(r) for r in sorted(plain)] == [(0, 90), (1, 90), (2, 90)]
    assert stats.resamples(df.where("size > 9").select("key"), 3, "x").count() == 0


def test_smp_08_makes_all_draws(spark):
    """SMP-08: as many draws as the analysis makes (20 before), each of as many features as there are."""
    from cohortshift.plans import registry

    got = registry.queries()["SMP-08"](spark, "/root/testdata/sf0.001").toPandas()
    known = spark.read.parquet("/root/testdata/sf0.001/part.parquet").count()
    assert CONFIG.bootstraps == 2000 and sorted(got["draw"].unique()) == list(range(2000))
    assert (got.groupby("draw")["n"].sum() == known).all() and not got.duplicated(["draw", "feature"]).any()
    one = got.groupby("feature")["n"].sum() / 2000
    assert len(one) == known and np.abs(one - 1).max() < 5 / 2000**0.5
    assert (got["n"] ** 2).sum() / 2000 / known == pytest.approx(2 - 1 / known, abs=0.02)


@pytest.mark.parametrize("made", [60, 1000, stats.MADE])
def test_resamples_of_equal_rows(spark, made):
    """Equal rows, nulls among them, share a block, which makes a bounded number of rows at a time; each stays a row."""
    keys = [None] * 70 + ["hot"] * 50 + [f"r{i}" for i in range(30)]
    t = stats.resamples(spark.createDataFrame([(k,) for k in keys], "key string").repartition(4), 300, "y", made=made).toPandas()
    assert (t.groupby("draw")["n"].sum() == 150).all() and t["draw"].nunique() == 300
    assert len(t) / 300 == pytest.approx(150 * (1 - (1 - 1 / 150) ** 150), rel=0.01)
    per = t.assign(key=t["key"].fillna("")).pivot_table(index="draw", columns="key", values="n", fill_value=0, aggfunc="sum")
    for k, n in (("", 70), ("hot", 50)):
        assert per[k].mean() == pytest.approx(n, abs=5 * (n * (1 - n / 150) / 300) ** 0.5) and per[k].var() == pytest.approx(n * (1 - n / 150), rel=0.35)


def test_kendall():
    assert stats.kendall(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4])) == pytest.approx(4 / 6)
    assert CONFIG.seed == 42


def _pairs(rows, x, y):
    """tau-b and rho of a table, by their definitions on all rows."""
    d = [np.sign(v[:, None] - v[None, :]) for v in (x, y)]
    ranks = [(v[:, None] > v[None, :]).sum(1) + (v[:, None] == v[None, :]).sum(1) / 2 for v in (x, y)]
    return (d[0] * d[1]).sum() / np.sqrt((d[0] ** 2).sum() * (d[1] ** 2).sum()), np.corrcoef(*ranks)[0, 1]


@pytest.mark.parametrize("levels", [(2, 500), (7, 5), (500, 500)])
def test_kendall_and_spearman_of_counts(spark, levels):
    """Counts of pairs, on the driver and in Spark in many ranges, against all pairs of rows."""
    x = RNG.integers(levels[0], size=600) / 2.0
    y = np.minimum(RNG.integers(levels[1], size=600), x * 2 + RNG.integers(levels[1], size=600))
    df = spark.createDataFrame([(f"f{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [("n", None, 1.0)], "feature string, a double, b double")
    tau, rho = _pairs(df, x, y)
    assert stats.kendall(x, y) == pytest.approx(tau, abs=1e-12)
    cells = stats.cell_counts(df, "a", "b")
    assert stats.association(cells, "a", "b") == (600, pytest.approx(rho, abs=1e-12), pytest.approx(tau, abs=1e-12))
    assert stats.association(cells, "a", "b", at_once=30) == (600, pytest.approx(rho, abs=1e-12), pytest.approx(tau, abs=1e-12))


def test_kendall_takes_no_square_of_the_rows():
    """300,000 different rows: pair by pair they would take minutes."""
    n = 300_000
    x, y = np.arange(n), np.arange(n)[::-1].copy()
    assert stats.kendall(x, y) == -1 and stats.kendall(x, x) == 1
    y = np.arange(n) ^ 1  # each second pair of neighbours is turned
    assert stats.kendall(x, y) == pytest.approx(1 - 2 * (n / 2) / (n * (n - 1) / 2), abs=1e-12)


@pytest.mark.parametrize("by", [None, "g"])
def test_bootstrap_of_counts(spark, by):
    """Draws of counts, in tasks and in Spark, spread as draws of single rows do."""
    n, rng = 400, np.random.default_rng(3)
    x = rng.integers(20, size=n).astype(float)
    y, g = x + rng.integers(-15, 16, size=n), rng.integers(40, size=n)
    df = spark.createDataFrame([(f"f{i}", float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x, y, g, strict=True))], "feature string, a double, b double, g int")
    groups = [np.flatnonzero(g == c) for c in np.unique(g)]
    own = []
    for _ in range(600):
        i = rng.integers(n, size=n) if by is None else np.concatenate([groups[k] for k in rng.integers(len(groups), size=len(groups))])
        own.append(stats.code_rho(stats.codes(x[i]), stats.codes(y[i]), np.ones(len(i))))
    cells = stats.cell_counts(df, "a", "b", *([by] if by else []))
    for at_once, draws in ((1000, 600), (50, 300)):
        got = stats.drawn_rhos(cells, "a", "b", "t", draws, by, at_once)
        assert len(got) == draws and got.mean() == pytest.approx(np.mean(own), abs=5 * np.std(own) / draws**0.5)
        assert got.std() == pytest.approx(np.std(own), rel=0.2)
    row = stats.block(df, "a", "b", 200, by).first()
    assert row["n"] == n and row["ci_low"] < row["spearman"] < row["ci_high"] and row["p_boot"] == 0
    assert stats.block(df.limit(0), "a", "b", 200, by).first()["n"] == 0


def _clusters(spark, n=400):
    rng = np.random.default_rng(4)
    x = rng.integers(12, size=n).astype(float)
    rows = [(f"f{i}", a, float(b), f"g{c}") for i, (a, b, c) in enumerate(zip(x.tolist(), x + rng.integers(-5, 6, size=n), rng.integers(30, size=n), strict=True))]
    return rows, spark.createDataFrame(rows, "feature string, a double, b double, g string").repartition(3)


def test_few_cells_are_drawn_without_a_chain_of_jobs(spark):
    """ST-04: the counts go to the driver once, and so few draws need neither tasks nor another pass."""
    _, df = _clusters(spark)
    spark.sparkContext.setJobGroup("few cells", "")
    try:
        assert stats.block(df, "a", "b", 100, "g").first()["n"] == 400
    finally:
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few cells")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 1 <= len(jobs) <= 4


def test_drawn_clusters_are_whole(spark, monkeypatch):
    """On the driver and in tasks, rho of a draw is that of all rows of the clusters it names, repeats included."""
    rows, df = _clusters(spark)
    x, y, g = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    names, want = np.unique(g), []
    for d in range(20):
        rng = np.random.default_rng([zlib.crc32(b"t"), d])
        i = np.concatenate([np.flatnonzero(g == names[k]) for k in rng.integers(len(names), size=len(names))])
        want.append(stats.code_rho(stats.codes(x[i]), stats.codes(y[i]), np.ones(len(i))))
    cells = stats.cell_counts(df, "a", "b", "g")
    for here in (stats.HERE, 0):
        monkeypatch.setattr(stats, "HERE", here)
        assert stats.drawn_rhos(cells, "a", "b", "t", 20, "g").tolist() == pytest.approx(want, abs=1e-12)
    pairs = len({r[1:3] for r in rows})
    assert 40 < pairs < 200 < cells.count()
    monkeypatch.setattr(stats, "resamples", None)  # it would meet each draw's clusters with all their rows by a join
    monkeypatch.setattr(stats, "ROWS", 7 * pairs)
    for at_once in (200, 40):
        got = stats.drawn_rhos(cells, "a", "b", "t", 20, "g", at_once)
        assert sorted(got) == pytest.approx(sorted(want), abs=1e-12)
        assert stats.block(df, "a", "b", 20, "g", at_once).first() == stats.block(df, "a", "b", 20, "g").first()


def test_running_index_is_the_row_number(spark):
    """Whatever the ranges: ties of the first column, nulls, and a class that holds most rows."""
    rows = [(int(k) if k else None, i, "x" if i % 9 else None) for i, k in enumerate(RNG.integers(0, 6, 300))]
    df = spark.createDataFrame(rows, "k long, i long, c string").repartition(5)
    for buckets in (1, 3, 50):
        got = {r["i"]: r["g"] for r in split.running_index(df, ["c"], ["k", "i"], buckets=buckets).collect()}
        for c in ("x", None):
            own = sorted((r for r in rows if r[2] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
            assert [got[r[1]] for r in own] == list(range(len(own)))


def test_modes_on_a_log_scale():
    """Two bumps a thousandfold apart are two modes with centres in their own units; too few positive values are one."""
    from cohortshift.operators.kernels import scaled_modes

    x = np.concatenate([10 ** RNG.normal(1, 0.1, 3000), 10 ** RNG.normal(4, 0.1, 1000), -np.ones(50)])
    found = scaled_modes(x, "symlog", np.random.default_rng(1))
    assert [m[0] for m in found] == [pytest.approx(10, rel=0.05), pytest.approx(10_000, rel=0.05)]
    assert [m[2] for m in found] == [pytest.approx(0.75, abs=0.01), pytest.approx(0.25, abs=0.01)]
    few = np.array([-3.0, -2.0, -1.0, 5.0])
    assert scaled_modes(few, "log", np.random.default_rng(1)) == [(-1.5, pytest.approx(few.std()), 1.0)]
    assert scaled_modes(np.array([]), "log", np.random.default_rng(1)) == []
