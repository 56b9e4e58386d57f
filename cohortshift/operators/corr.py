"""Correlation matrices in long form, and the redundancy graph of features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.ranks import value_ranks
from ..sources.files import saved

MANY = 200
#: Ranks of at most so many distinct values, of 24 bytes each, are broadcast.
LEVELS = 200_000


def pearson(df: DataFrame, features: list[str]) -> DataFrame:
    """(cohort, a, b, r), a < b: all pairs in one pass of mergeable co-moments; no rows are reshaped."""
    pairs = list(combinations(sorted(features), 2))
    parts = []
    for i in range(0, len(pairs), MANY):
        some = pairs[i : i + MANY]
        row = df.groupBy("cohort").agg(*(F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(some)))
        parts.append(row.selectExpr("cohort", f"stack({len(some)}, " + ", ".join(f"'{a}', '{b}', r{k}" for k, (a, b) in enumerate(some)) + ") AS (a, b, r)"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def spearman(df: DataFrame, features: list[str], levels: int = LEVELS) -> DataFrame:
    """Pearson on average ranks, of rows that have a value of every feature.

    The ranks of all features' distinct values come from one pass and are saved. Features of at most `levels` distinct
    values meet them by broadcast. All others go through one long table: a shuffle to the ranks and one back to the rows,
    whatever their number; frequent values of that join are left to AQE.
    """
    out = df.select("cohort", *features)
    cells = lambda t, ids, some: t.unpivot(ids, some, "feature", "value").where("value is not null")
    ranks = saved(value_ranks(cells(out, ["cohort"], features), ["cohort", "feature"], "value", "rank"))
    n = {r["feature"]: r["count"] for r in ranks.groupBy("feature").count().collect()}
    many = [f for f in features if n.get(f, 0) > levels]
    if many:
        out = saved(out.withColumn("__id", F.monotonically_increasing_id()))
        found = cells(out, ["__id", "cohort"], many).join(ranks, ["cohort", "feature", "value"])
        back = found.groupBy("__id").agg(*(F.max(F.when(F.col("feature") == f, F.col("rank"))).alias(f"__r_{f}") for f in many))
        out = out.drop(*many).join(back.dropna(), "__id")
    for f in features:
        if f not in many:
            one = ranks.where(F.col("feature") == f).select("cohort", F.col("value").alias(f), F.col("rank").alias(f"__r_{f}"))
            out = out.join(F.broadcast(one), ["cohort", f])
    return pearson(out.select("cohort", *(F.col(f"__r_{f}").alias(f) for f in features)), features)


def small(matrix: DataFrame) -> DataFrame:
    """A table with a row for each pair of columns, computed once; its size is set by the schema, not the data."""
    return matrix.sparkSession.createDataFrame(matrix.collect(), matrix.schema)


def consensus(matrix: DataFrame) -> DataFrame:
    """Mean and minimum of |r| over the cohorts."""
    r = F.abs("r")
    return matrix.groupBy("a", "b").agg(F.avg(r).alias("mean_r"), F.min(r).alias("min_r"), F.max(F.when(F.col("cohort") == "A", r)).alias("r_a"), F.max(F.when(F.col("cohort") == "B", r)).alias("r_b"))


def flagged(matrix: DataFrame, at: float = CONFIG.flag_corr) -> DataFrame:
    return matrix.where(F.abs("r") >= at).orderBy(F.desc(F.abs("r")), "cohort", "a", "b")


def edges(p: DataFrame, s: DataFrame, at: float | Column = CONFIG.consensus_corr) -> DataFrame:
    """Pairs that both cohorts and both correlations hold at the threshold."""
    j = p.select("a", "b", F.col("min_r").alias("p")).join(s.select("a", "b", F.col("min_r").alias("s")), ["a", "b"])
    return j.where((F.col("p") >= at) & (F.col("s") >= at)).select("a", "b")


def groups(edge_rows: DataFrame) -> DataFrame:
    """(feature, root): components, by union-find over the columns' edges, whose number is fixed by the schema."""
    parent: dict[str, str] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in sorted((r["a"], r["b"]) for r in edge_rows.select("a", "b").collect()):
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    rows = [(x, find(x)) for x in sorted(parent)]
    return edge_rows.sparkSession.createDataFrame(rows, "feature string, root string")


def representatives(members: DataFrame, p: DataFrame) -> DataFrame:
    """(root, keep): of each group the feature with the lowest mean |r| to all others; ties by name."""
    both = p.select(F.col("a").alias("feature"), "mean_r").unionByName(p.select(F.col("b").alias("feature"), "mean_r"))
    mean = members.join(both.groupBy("feature").agg(F.avg("mean_r").alias("m")), "feature")
    return mean.groupBy("root").agg(F.min(F.struct(F.round("m", 9).alias("m"), "feature")).alias("k")).select("root", F.col("k.feature").alias("keep"))


def classify(members: DataFrame, keeps: DataFrame, p: DataFrame, s: DataFrame, at: float = CONFIG.consensus_corr) -> DataFrame:
    """(keep, drop, status) of each member against its group's representative."""
    pairs = members.join(keeps, "root").where("feature <> keep").select("keep", F.col("feature").alias("drop"), F.least("keep", "feature").alias("a"), F.greatest("keep", "feature").alias("b"))
    j = pairs.join(p.select("a", "b", F.col("r_a").alias("pa"), F.col("r_b").alias("pb")), ["a", "b"]).join(s.select("a", "b", F.col("min_r").alias("s")), ["a", "b"])
    both = (F.col("pa") >= at) & (F.col("pb") >= at)
    status = F.when(both & (F.col("s") >= at), "stable").when(both, "stable_pearson_only").when(F.col("pa") >= at, "shifted_a").when(F.col("pb") >= at, "shifted_b").otherwise("weak_transitive")
    return j.select("keep", "drop", status.alias("status"))


def drop_list(classified: DataFrame) -> DataFrame:
    """(feature, decision): stable pairs are dropped, all others watched."""
    d = classified.groupBy(F.col("drop").alias("feature")).agg(F.max(F.col("status") == "stable").alias("sure"))
    return d.select("feature", F.when(F.col("sure"), "drop").otherwise("monitor").alias("decision"))


def drifted(p: DataFrame, per: float = CONFIG.flag_corr, whole: float = CONFIG.consensus_corr) -> DataFrame:
    """Pairs correlated in one cohort only and not in consensus."""
    a, b = F.col("r_a") >= per, F.col("r_b") >= per
    return p.where((a != b) & (F.col("mean_r") < whole)).select("a", "b", F.when(a, "A_only").otherwise("B_only").alias("correlated_in"))


def sweep(p: DataFrame, s: DataFrame, thresholds=CONFIG.sweep_corr) -> DataFrame:
    """(threshold, n_groups, n_dropped) of the official rule at other thresholds."""
    rows = []
    for t in thresholds:
        g = groups(edges(p, s, t)).collect()
        roots = {r["root"] for r in g}
        rows.append((float(t), len(roots), len(g) - len(roots)))
    return p.sparkSession.createDataFrame(rows, "threshold double, n_groups int, n_dropped int")


def within_groups(members: DataFrame, matrix: DataFrame) -> DataFrame:
    """(root, mean_r): mean |r| of the pairs within a group over both cohorts."""
    a, b = members.select(F.col("feature").alias("a"), F.col("root")), members.select(F.col("feature").alias("b"), F.col("root").alias("root_b"))
    return matrix.join(a, "a").join(b, "b").where("root = root_b").groupBy("root").agg(F.avg(F.abs("r")).alias("mean_r"))
