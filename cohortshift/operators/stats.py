"""Rank statistics and multiple testing over feature tables.

Correlations and their bootstraps work on counts of different pairs of values, q-values on counts of distinct p. Up to CELLS
of them go to the driver or to tasks, where numpy does the rest; for more there is a form in Spark. The exposure permutations run in numpy on the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ..config import CONFIG
from ..functions.ranks import following_min, running_totals
from ..sources.files import forget, saved

#: Rows of draws that one block of a bootstrap makes.
MADE = 1_000_000
#: Tables of at most so many pairs of values or distinct p, of 32 bytes each, go to the driver and, for a bootstrap, to the tasks.
CELLS = 1_000_000
#: The driver makes draws of at most so many rows in all, a row drawn by itself counting as FRESH rows of drawn clusters.
HERE, FRESH = 200_000_000, 20
#: Rows of draws of a larger table that are made at a time.
ROWS = 50_000_000


def _avg_rank(c: str):
    return F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0


def spearman(features: DataFrame, a: str, b: str) -> DataFrame:
    """(n, rho) over rows where both are there."""
    f = features.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return f.select(_avg_rank(a).alias("x"), _avg_rank(b).alias("y")).agg(F.count("*").alias("n"), F.corr("x", "y").alias("rho"))


def arrays(features: DataFrame, *columns: str) -> list[np.ndarray]:
    rows = features.select("feature", *columns).dropna().orderBy("feature").toPandas()
    return [rows[c].to_numpy(float) for c in columns]


def cell_counts(features: DataFrame, *columns: str) -> DataFrame:
    """(columns, __n): the different values of rows that have them all, with counts; saved."""
    return saved(features.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("__n")))


def codes(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def code_rho(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Correlation of average ranks of codes that stand in order; a place counts n times."""
    r = []
    for c in (x, y):
        m = np.bincount(c, weights=n)
        # the average rank less the mean one
        r.append((m, np.cumsum(m) - m / 2 - m.sum() / 2))
    (mx, rx), (my, ry) = r
    d = np.sqrt((mx * rx * rx).sum() * (my * ry * ry).sum())
    return float((n * rx[x] * ry[y]).sum() / d) if d else float("nan")


def rank_corr(cells: DataFrame, a: str, b: str, n: str, keys: list[str]) -> DataFrame:
    """(keys, rho): the same from a table of (keys, a, b, n), in any order and of any size."""
    by = keys or ["__k"]
    t = out = cells if keys else cells.withColumn("__k", F.lit(0))
    for c in (a, b):
        r = running_totals(t.groupBy(*by, c).agg(F.sum(n).alias("__m")), by, {"__c": "__m"}, [c], c, steady=True)
        out = out.join(r.select(*by, c, (F.col("__c") - F.col("__m") / 2 - F.col("__c_all") / 2).alias(f"__r_{c}")), [*by, c])
    x, y = F.col(f"__r_{a}"), F.col(f"__r_{b}")
    return out.groupBy(*keys).agg(F.try_divide(F.sum(F.col(n) * x * y), F.sqrt(F.sum(F.col(n) * x * x) * F.sum(F.col(n) * y * y))).alias("rho"))


def concordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> int:
    """Pairs whose one row is smaller in both x and y; a place counts n times.

    In order of x, and of equal x from the largest y, a pair counts if its later y is larger. The highest bit in which the
    two differ tells that, so each bit is one pass over rows that are sorted by the bits above it.
    """
    y, n = codes(y), np.asarray(n, dtype=np.int64)
    order = np.lexsort((-y, x))
    y, n, found = y[order], n[order], 0
    for bit in range(int(y.max(initial=0)).bit_length() - 1, -1, -1):
        above, one = y >> (bit + 1), (y >> bit & 1).astype(bool)
        before = np.cumsum(np.where(one, 0, n))
        first = np.flatnonzero(np.diff(above, prepend=-1))
        start = np.r_[0, before][first]  # zeros of the groups before
        zeros = before - np.repeat(start, np.diff(np.r_[first, len(y)]))
        found += int((zeros[one] * n[one]).sum())
        order = np.argsort(y >> bit, kind="stable")
        y, n = y[order], n[order]
    return found


def _tau(pairs: int, found: int, tx: int, ty: int, txy: int) -> float:
    """tau-b from all pairs, the concordant ones, and those tied in x, in y and in both."""
    x, y = pairs - tx, pairs - ty
    return (2 * found - pairs + tx + ty - txy) / float(np.sqrt(float(x) * float(y))) if x and y else 0.0


def kendall(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """tau-b; a place counts n times."""
    n = np.ones(len(x), dtype=np.int64) if n is None else np.asarray(n, dtype=np.int64)
    x, y = codes(x), codes(y)

    def tied(c):
        m = np.bincount(codes(c), weights=n).astype(np.int64)
        return int((m * (m - 1) // 2).sum())

    total = int(n.sum())
    return _tau(total * (total - 1) // 2, concordant(x, y, n), tied(x), tied(y), tied(x * (int(y.max(initial=0)) + 1) + y))


def wide_kendall(cells: DataFrame, a: str, b: str, parts: int) -> float:
    """The same of a table (a, b, __n) of any size, without a task that holds it.

    Both columns are dealt into ranges, a cut being a range of its own. Pairs in different ranges of both come from the
    counts of the grid, pairs in the same range of a from that range, all others from their range of b. Cuts hold
    equal values, so none of their own pairs counts.
    """
    shares = [i / parts for i in range(1, parts)]
    cuts = cells.agg(*(F.percentile_approx(c, shares, F.lit(10_000)) for c in (a, b))).first()

    def place(c, ends):
        known = F.array(*map(F.lit, sorted(set(ends))))
        return F.size(F.filter(known, lambda v: v < F.col(c))) * 2 + F.array_contains(known, F.col(c)).cast("int")

    cells = cells.withColumns({"__x": place(a, cuts[0]), "__y": place(b, cuts[1])})
    grid = cells.groupBy("__x", "__y").agg(F.sum("__n").alias("__n")).toPandas()
    found = concordant(*(grid[c].to_numpy() for c in ("__x", "__y", "__n")))
    for by, x in (("__x", a), ("__y", "__x")):
        g = cells.where(F.col(by) % 2 == 0).select(by, F.col(x).alias("x"), F.col(b).alias("y"), F.col("__n").alias("n")).groupBy(by)
        own = g.applyInPandas(lambda g: pd.DataFrame({"found": [concordant(*(g[c].to_numpy() for c in ("x", "y", "n")))]}), "found long")
        found += int(own.agg(F.sum(F.col("found").cast("decimal(38,0)"))).first()[0] or 0)

    def tied(*columns):
        m = cells.groupBy(*columns).agg(F.sum("__n").alias("m"))
        return int(m.agg(F.sum(F.expr("cast(m as decimal(19,0)) * (m - 1)"))).first()[0] or 0) // 2

    total = int(grid["__n"].sum())
    return _tau(total * (total - 1) // 2, found, tied(a), tied(b), tied(a, b))


def held(table: DataFrame, at_once: int) -> pa.Table | None:
    """A table of at most at_once rows, on the driver; None of a larger one, of which at most one row more is read there."""
    t = table.limit(at_once + 1).toArrow()
    return t if t.num_rows <= at_once else None


def arrow_codes(c: pa.ChunkedArray) -> np.ndarray:
    c = c.combine_chunks().dictionary_encode()
    return codes(c.dictionary.to_numpy(zero_copy_only=False))[c.indices.to_numpy()]


class Cells:
    """A held table (a, b, .., __n) in order of the codes of a, b and by; pairs has the places where a pair of a and b begins."""

    def __init__(self, t: pa.Table, a: str, b: str, by: str | None = None):
        x, y, n = arrow_codes(t[a]), arrow_codes(t[b]), t["__n"].to_numpy()
        g = arrow_codes(t[by]) if by else np.zeros_like(x)
        order = np.lexsort((g, y, x))
        x, y, self.g, self.n = x[order], y[order], g[order], n[order]
        self.pairs = np.flatnonzero((np.diff(x, prepend=-1) != 0) | (np.diff(y, prepend=-1) != 0))
        self.x, self.y, self.clusters = x[self.pairs], y[self.pairs], int(g.max(initial=-1)) + 1

    def counts(self, n: np.ndarray) -> np.ndarray:
        """Counts of rows as counts of pairs."""
        return np.add.reduceat(n, self.pairs) if len(n) else n

    def association(self) -> tuple[int, float, float]:
        n = self.counts(self.n)
        return int(n.sum()), code_rho(self.x, self.y, n), kendall(self.x, self.y, n)


def wide_association(cells: DataFrame, a: str, b: str, parts: int) -> tuple[int, float, float]:
    r = rank_corr(cells, a, b, "__n", []).first()["rho"]
    return cells.agg(F.sum("__n")).first()[0], float("nan") if r is None else r, wide_kendall(cells, a, b, parts)


def association(cells: DataFrame, a: str, b: str, at_once: int = CELLS) -> tuple[int, float, float]:
    """(n, rho, tau-b) of a table (a, b, .., __n): on the driver if it has at most at_once rows, else in Spark."""
    few = held(cells, at_once)
    return wide_association(cells, a, b, max(2, -(-cells.count() * 4 // at_once))) if few is None else Cells(few, a, b).association()


def held_rhos(spark: SparkSession, cells: Cells, name: str, draws: int, by: bool) -> np.ndarray:
    """rho of bootstrap draws of a held table, those without one left out. Few are made on the driver, else tasks share them."""
    seed, n, total = zlib.crc32(name.encode()), cells.n if by else cells.counts(cells.n), int(cells.n.sum())

    def one(d: int) -> float:
        w = cells.counts(n * cluster_draws(seed, d, cells.clusters)[cells.g]) if by else draw_counts(np.random.default_rng([seed, d]), n, total)
        return code_rho(cells.x, cells.y, w)

    def share(batches):
        for batch in batches:
            yield pd.DataFrame({"draw": batch["id"], "rho": [one(int(d)) for d in batch["id"]]})

    draws = draws if total else 0
    if draws * len(n) * (1 if by else FRESH) <= HERE:
        r = np.array([one(d) for d in range(draws)])
    else:
        ids = spark.range(0, draws, 1, min(draws, spark.sparkContext.defaultParallelism))
        r = ids.mapInPandas(share, "draw long, rho double").toPandas().sort_values("draw")["rho"].to_numpy()
    return r[np.isfinite(r)]


def cluster_draws(seed: int, d: int, clusters: int) -> np.ndarray:
    """How often each cluster is in a draw of as many clusters."""
    return np.bincount(np.random.default_rng([seed, d]).integers(clusters, size=clusters), minlength=clusters)


def wide_cluster_rhos(cells: DataFrame, a: str, b: str, name: str, draws: int, by: str, clusters: pa.Table, at_once: int) -> np.ndarray:
    """The same of a table of any size whose clusters are held: blocks of pairs of values sum a draw's clusters each by
    themselves, so that a draw is a table of pairs. A task ranks it whole if pairs are at most at_once, else Spark does."""
    known, seed, size = clusters.num_rows, zlib.crc32(name.encode()), cells.count()
    coded = cells.sparkSession.createDataFrame(clusters.sort_by(by).append_column("__g", pa.array(np.arange(known))))
    pairs = cells.select(a, b).distinct().count()
    out, some = [], max(1, ROWS // pairs)
    blocks = max(1, -(-pairs * min(some, draws) // (4 * MADE)), -(-size // MADE))
    dealt = saved(cells.join(coded, by).select(a, b, "__g", "__n", F.pmod(F.xxhash64(a, b), F.lit(blocks)).alias("__b")))
    kind = StructType([StructField("draw", IntegerType()), dealt.schema[a], dealt.schema[b], StructField("n", LongType())])

    def rho(one: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"rho": [code_rho(codes(one[a].to_numpy()), codes(one[b].to_numpy()), one["n"].to_numpy())]})

    def drawer(ids: range):
        def draw(block: pd.DataFrame) -> pd.DataFrame:
            block = block.sort_values([a, b], ignore_index=True)
            x, y, g, n = (block[c].to_numpy() for c in (a, b, "__g", "__n"))
            at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
            w = [np.add.reduceat(n * cluster_draws(seed, d, known)[g], at) for d in ids]
            there = [np.flatnonzero(v) for v in w]
            places = at[np.concatenate(there)]
            return pd.DataFrame({"draw": np.repeat(np.array(ids), [len(i) for i in there]), a: x[places], b: y[places], "n": np.concatenate([v[i] for v, i in zip(w, there, strict=True)])})

        return draw

    for first in range(0, draws, some):
        drawn = dealt.groupBy("__b").applyInPandas(drawer(range(first, min(first + some, draws))), kind)
        if pairs <= at_once:
            found = drawn.groupBy("draw").applyInPandas(rho, "rho double").toPandas()["rho"].to_numpy()
            out.append(found[np.isfinite(found)])
        else:
            drawn = saved(drawn)
            out.append(np.array([r["rho"] for r in rank_corr(drawn, a, b, "n", ["draw"]).collect() if r["rho"] is not None]))
            forget(drawn)
    return np.concatenate(out)


def wide_rhos(cells: DataFrame, a: str, b: str, name: str, draws: int, by: str | None = None, at_once: int = CELLS) -> np.ndarray:
    """The same of a table of any size: draws are made in Spark, some at a time."""
    if by and (clusters := held(cells.select(by).distinct(), at_once)) is not None:
        return wide_cluster_rhos(cells, a, b, name, draws, by, clusters, at_once)
    out, some = [], max(1, ROWS // cells.count())
    for first in range(0, draws, some):
        d, part = min(some, draws - first), f"{name}|{first}"
        if by:
            drawn = resamples(cells.select(by).distinct(), d, part).join(cells, by).select("draw", a, b, (F.col("n") * F.col("__n")).alias("n"))
        else:
            drawn = resamples(cells.select(a, b, "__n"), d, part, "__n")
        drawn = saved(drawn)
        out += [r["rho"] for r in rank_corr(drawn, a, b, "n", ["draw"]).collect() if r["rho"] is not None]
        forget(drawn)
    return np.array(out)


def drawn_rhos(cells: DataFrame, a: str, b: str, name: str, draws: int, by: str | None = None, at_once: int = CELLS) -> np.ndarray:
    """rho of bootstrap draws of a table (a, b, by, __n), those without one left out; by names clusters drawn whole."""
    few = held(cells, at_once)
    return wide_rhos(cells, a, b, name, draws, by, at_once) if few is None else held_rhos(cells.sparkSession, Cells(few, a, b, by), name, draws, bool(by))


def block(features: DataFrame, a: str, b: str, draws: int = CONFIG.bootstraps, by: str | None = None, at_once: int = CELLS) -> DataFrame:
    """(test, n, spearman, kendall, ci_low, ci_high, p_boot) of two columns; by names a cluster column, drawn whole.

    The interval is of percentiles, p two-sided. Rows of equal values are drawn as one with their count, which is the same.
    """
    nan, name, spark = float("nan"), f"{a}|{b}", features.sparkSession
    columns = [a, b, *([by] if by else [])]
    cells = features.dropna(subset=["feature", *columns]).groupBy(*columns).agg(F.count("*").alias("__n"))
    if (few := held(cells, at_once)) is not None:
        few = Cells(few, a, b, by)
        n, r, tau = few.association()
        o = held_rhos(spark, few, name, draws, bool(by)) if n >= 3 else np.array([])
    else:
        cells = saved(cells)
        n, r, tau = association(saved(cells.groupBy(a, b).agg(F.sum("__n").alias("__n"))) if by else cells, a, b, at_once)
        o = wide_rhos(cells, a, b, name, draws, by, at_once) if n >= 3 else np.array([])
    lo, hi, p = (float(np.percentile(o, 2.5)), float(np.percentile(o, 97.5)), float(min(1.0, 2 * min((o <= 0).mean(), (o >= 0).mean())))) if len(o) else (nan, nan, nan)
    row = {"test": f"{a} vs {b}", "n": n, "spearman": r if n >= 3 else nan, "kendall": tau, "ci_low": lo, "ci_high": hi, "p_boot": p}
    # as an Arrow table, which needs no Python worker
    return spark.createDataFrame(pa.table({k: [v] for k, v in row.items()}), "test string, n int, spearman double, kendall double, ci_low double, ci_high double, p_boot double")


def partial_spearman(features: DataFrame, a: str, b: str, controls: tuple[str, str]) -> DataFrame:
    """Correlation of the ranks of a and b without their linear part in the ranks of two controls, in closed form."""
    cols = [a, b, *controls]
    f = features.select(*cols).dropna().select(*(_avg_rank(c).alias(f"c{i}") for i, c in enumerate(cols)))
    r = f.agg(*(F.corr(f"c{i}", f"c{j}").alias(f"r{i}{j}") for i in range(4) for j in range(i + 1, 4)))
    part = lambda i, j, k: (F.col(f"r{i}{j}") - F.col(f"r{i}{k}") * F.col(f"r{min(j, k)}{max(j, k)}")) / F.sqrt((1 - F.col(f"r{i}{k}") ** 2) * (1 - F.col(f"r{min(j, k)}{max(j, k)}") ** 2))
    # control for c2 first, then for c3 given c2
    ab, a3, b3 = part(0, 1, 2), part(0, 3, 2), part(1, 3, 2)
    return r.select(((ab - a3 * b3) / F.sqrt((1 - a3 * a3) * (1 - b3 * b3))).alias("partial"))


def low_q(counts: pa.Table, p: str) -> pa.Table:
    """(p, __q): the q-values, before their cap at 1, of a table (p, __n) of distinct p; NaN counts as the largest."""
    m = pc.sum(counts["__n"]).as_py() or 0
    t = counts.filter(pc.is_valid(counts[p])).sort_by(p)
    raw = t[p].to_numpy() * m / np.cumsum(t["__n"].to_numpy())
    return pa.table({p: t[p], "__q": np.fmin.accumulate(raw[::-1])[::-1]})


def wide_low_q(counts: DataFrame, p: str) -> DataFrame:
    """The same of a table of any size, without a task that holds it."""
    m = counts.agg(F.sum("__n")).first()[0] or 0
    c = running_totals(counts.where(F.col(p).isNotNull()).withColumn("__k", F.lit(0)), ["__k"], {"__c": "__n"}, [p], p, steady=True)
    c = saved(c.select("__k", p, (F.col(p) * F.lit(m) / F.col("__c")).alias("__q")))
    return saved(following_min(c, ["__k"], "__q", p).select(p, "__q"))


def benjamini_hochberg(tests: DataFrame, q: float = 0.05, p: str = "p", at_once: int = CELLS) -> DataFrame:
    """Adds q_value, monotone from the largest p down, and reject. Nulls count as tests; their q_value is 1.

    Equal p share the q_value of their last rank, so counts of distinct p are enough: on the driver if they are at most
    at_once rows, which the limit finds out without saving them first, else in Spark. No task holds all tests.
    """
    n = tests.groupBy(p).agg(F.count("*").alias("__n"))
    few = held(n, at_once)
    low = wide_low_q(saved(n), p) if few is None else tests.sparkSession.createDataFrame(low_q(few, p))
    t = tests.join(low, p, "left").withColumn("q_value", F.least(F.lit(1.0), "__q"))
    return t.select(*tests.columns, "q_value", (F.col("q_value") <= q).alias("reject"))


def top_overlap(features: DataFrame, ks=(5, 10, 15, 20)) -> DataFrame:
    """(k, share): features among the k first by both importances."""
    from .cross import place

    r = features.where("imp_a is not null and imp_b is not null").withColumn("ra", place("imp_a")).withColumn("rb", place("imp_b"))
    e = r.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    return e.groupBy("k").agg(F.round(F.count_if((F.col("ra") <= F.col("k")) & (F.col("rb") <= F.col("k"))) / F.max("k"), 6).alias("share"))


def exposure_percentile(features: DataFrame, draws: int = CONFIG.exposure_draws) -> DataFrame:
    """The weighted mean shift, and its percentile among shuffled weights."""
    w, s = arrays(features, "imp_a", "cal")
    rng = np.random.default_rng(CONFIG.seed)
    own = float((w * s).sum() / w.sum())
    null = np.array([(rng.permutation(w) * s).sum() for _ in range(draws)]) / w.sum()
    return features.sparkSession.createDataFrame([(own, float((null <= own).mean() * 100))], "exposure double, percentile double")


def draw_counts(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How often each place is hit by n draws with replacement, a place being as likely as its size, a whole number."""
    if len(sizes) * 4 < n:
        return rng.multinomial(n, sizes / sizes.sum())
    return np.bincount(np.repeat(np.arange(len(sizes)), sizes)[rng.integers(sizes.sum(), size=n)], minlength=len(sizes))


def dealt(seed: int, ends: np.ndarray, key: int, draws: int) -> np.ndarray:
    """How many of its places each draw has in block `key`, a block being as likely as its size; ends are running sizes from 0.

    Ranges of blocks are halved by binomials, each with a seed of its own, so that any task finds the same shares by itself.
    """
    lo, hi, node, n = 0, len(ends) - 1, 1, np.full(draws, ends[-1])
    while hi - lo > 1:
        mid, whole = (lo + hi) // 2, ends[hi] - ends[lo]
        left = np.random.default_rng([seed, node]).binomial(n, (ends[mid] - ends[lo]) / whole if whole else 0.0)
        lo, hi, n, node = (lo, mid, left, 2 * node) if key < mid else (mid, hi, n - left, 2 * node + 1)
    return n


def drawn_rows(rng: np.random.Generator, sizes: np.ndarray, k: np.ndarray) -> np.ndarray:
    """(row, draw) counts of k[d] draws with replacement of rows, a row being as likely as its size, a whole number."""
    if len(sizes) * 4 < sizes.sum():
        return rng.multinomial(k, sizes / sizes.sum()).T
    at = rng.integers(max(1, sizes.sum()), size=k.sum(), dtype=np.int32)
    at = at if (sizes == 1).all() else np.repeat(np.arange(len(sizes)), sizes)[at]
    return np.bincount(np.repeat(np.arange(len(k)) * len(sizes), k) + at, minlength=len(k) * len(sizes)).reshape(len(k), len(sizes)).T


def resamples(rows: DataFrame, draws: int, name: str, size: str | None = None, made: int = MADE) -> DataFrame:
    """(draw, the rows' columns, n): bootstrap draws with replacement as counts of each row, those of 0 left out.

    A draw is dealt to blocks of rows by binomials of their sizes, then within each block by itself, which is the same
    as one draw of all rows. A block makes about `made` rows; one of more, of equal rows, makes so many at a time. Python
    gives each row's counts in all draws as one array, which Spark unrolls. A row with a size (a whole number) stands for so
    many rows, and as many are drawn as there are in all.
    """
    columns, seed, spark = [c for c in rows.columns if c != size], zlib.crc32(name.encode()), rows.sparkSession
    blocks, some = max(1, -(-rows.count() * draws // made)), max(1, made // max(1, draws))
    b = rows.withColumn("__size", (F.col(size) if size else F.lit(1)).cast("long")).withColumn("__b", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))
    sizes, of = b.groupBy("__b").agg(F.sum("__size").alias("__size")).toArrow(), np.zeros(blocks, dtype=np.int64)
    of[sizes["__b"].to_numpy()] = sizes["__size"].to_numpy()
    ends = np.r_[0, np.cumsum(of)]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(batches)
        key, block = block["__b"][0].as_py(), block.sort_by([(c, "ascending") for c in (*columns, "__size")])
        own, rng = block["__size"].to_numpy(), np.random.default_rng([seed, 0, key + 1])
        starts = np.arange(0, len(own), some)
        parts = np.add.reduceat(own, starts)
        k = rng.multinomial(dealt(seed, ends, key, draws), parts / max(1, parts.sum())) if len(starts) > 1 else dealt(seed, ends, key, draws)[:, None]
        for i, first in enumerate(starts):
            n = drawn_rows(rng, own[first : first + some], k[:, i])
            t = block.select(columns).slice(first, some).combine_chunks()
            counts = pa.ListArray.from_arrays(np.arange(len(n) + 1, dtype=np.int32) * draws, n.astype(np.int32).ravel())
            yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in t.columns), counts], names=[*columns, "__counts"])

    schema = StructType([*(rows.schema[c] for c in columns), StructField("__counts", ArrayType(IntegerType()))])
    # few tasks for each core, whose number is set: by its bytes the table is too small for more than one
    tasks = min(blocks, max(4 * spark.sparkContext.defaultParallelism, blocks // 8))
    made_rows = b.select(*columns, "__size", "__b").repartition(tasks, "__b").groupBy("__b").applyInArrow(draw, schema)
    return made_rows.select(*columns, F.posexplode("__counts").alias("draw", "n")).where("n > 0").select("draw", *columns, "n")


def paired_test(runs: DataFrame, a: str, b: str, keys=("kk", "direction", "seed")) -> DataFrame:
    """Policies a and b paired on K, direction and seed: mean difference, wins, and Wilcoxon's p."""
    from ..functions.lib1d import signed_rank_p

    m = runs.groupBy("policy", *keys).agg(F.avg("f1").alias("f1"))
    j = m.where(F.col("policy") == a).drop("policy").withColumnRenamed("f1", "fa").join(m.where(F.col("policy") == b).drop("policy").withColumnRenamed("f1", "fb"), list(keys))
    rows = j.orderBy(*keys).toPandas()  # one row for each K, direction and seed
    d = (rows["fa"] - rows["fb"]).to_numpy()
    w, p = signed_rank_p(d)
    return runs.sparkSession.createDataFrame([(a, b, len(d), float(d.mean()) if len(d) else None, int((d > 0).sum()), w, p)], "policy_a string, policy_b string, n int, mean_difference double, wins int, w double, p double")
