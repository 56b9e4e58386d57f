"""Model queries on whole tables."""

from cohortshift.plans import model_queries, registry
from cohortshift.sources.views import view

SF = "/root/testdata/sf0.01"


def test_all_rows_but_the_train_split_are_scored(spark):
    n = {(r["cohort"], r["y"]): r["count"] for r in view(spark, SF, "drift").groupBy("cohort", "y").count().collect()}
    got = {}
    for r in registry.queries()["ML-01"](spark, SF).collect():
        got[r["cohort"]] = got.get(r["cohort"], 0) + r["n"]
    assert got["B"] == n["B", 0] + n["B", 1]
    assert abs(got["A"] - 0.2 * (n["A", 0] + n["A", 1])) <= 400
    train, rest = model_queries._parts(spark, SF)
    assert train.join(rest, ["okey", "lnum", "pkey", "skey", "cohort"]).count() == 0


def test_permuted_copies_deal_every_value_once(spark):
    from collections import Counter

    from cohortshift.operators.models import permuted_copies

    rows = [(i, 0, i % 7, i % 3, float(i), float(i % 5), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "okey long, lnum long, pkey long, skey long, x double, z double, y int")
    got = permuted_copies(df, ["x", "z"], 4).toPandas()
    assert len(got) == 60 * 9
    for (f, r), g in got.groupby(["feature", "repeat"]):
        g = g.sort_values("okey")
        same = {"x": [w[4] for w in rows], "z": [w[5] for w in rows]}
        for c in ("x", "z"):
            assert Counter(g[c]) == Counter(same[c])
            assert (list(g[c]) == same[c]) == (c != f), (f, r, c)
    assert permuted_copies(df.where("okey < 0"), ["x"], 2).count() == 0


def test_importance_of_the_only_signal(spark):
    from cohortshift.operators.models import fit_forest, permutation_importance

    df = spark.range(2000).selectExpr("id AS okey", "0L AS lnum", "id % 7 AS pkey", "id % 3 AS skey", "CAST(id % 2 AS DOUBLE) AS x", "CAST(id % 11 AS DOUBLE) AS z", "CAST(id % 2 AS INT) AS y")
    got = {r["feature"]: r["drop"] for r in permutation_importance(fit_forest(df, ["x", "z"], trees=20, depth=3), df, ["x", "z"], repeats=5).collect()}
    assert abs(got["x"] - 0.5) < 0.05 and abs(got["z"]) < 0.01


def test_cross_cohort_forests_score_every_row(spark):
    """Each direction, task and framing counts all rows of its target; the planted flip shows under both framings."""
    n = {r["cohort"]: r["count"] for r in view(spark, SF, "drift").groupBy("cohort").count().collect()}
    got = registry.queries()["ML-08b"](spark, SF).toPandas()
    totals = got.groupby(["direction", "task", "framing"])["n"].sum()
    assert len(totals) == 8
    assert all(v == n[k[0][-1]] for k, v in totals.items())
    assert set(got[got.task == "binary"].truth) == {0, 1} and set(got[got.task == "family"].truth) == {0, 1, 4}
    # discount alone tells the label, and moves the other way in B: z-scores of the target's own scaler turn every decision
    # round, and on the source's scale the moved rows lie on the benign side
    binary = got[got.task == "binary"]
    assert (binary[binary.framing == "concept"].truth != binary[binary.framing == "concept"].pred).all()
    assert (binary[binary.framing == "covariate"].pred == 0).all()
