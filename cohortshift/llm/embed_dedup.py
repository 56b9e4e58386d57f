"""Embedding near-dedup with an inverted multi-index.

Each half of a unit vector has a codebook of its own; pairs of codewords are the cells of a product grid. A
query visits cells in the order of a multi-sequence traversal. How many is calibrated: copies of sampled
vectors, turned to exactly the threshold, must be found in the visited cells at the rate `recall`; closer
pairs, and pairs that either side visits, are found more often. Codebooks and calibration use at most
`SAMPLE_ROWS` vectors, chosen by a hash of vec_id; all vectors are indexed and all are queries. Candidates are
verified in double precision, so no pair under the threshold links.

Equal vectors are one vector with a weight, from the start. Groups of near copies do not become pairs: within a
cell, vectors that link with a leader form a ball (cells of over `BLOCK` vectors are split by salts into blocks of
about that size), whose inner links are counted in a block. Balls, not vectors, are indexed. Two balls are decided
by their leaders' angle and radii where all or none of their pairs link, and compared in one block otherwise; what
a ball's members gain there is summed by ball before it moves. The codebooks grow with the square root of the
different vectors, up to `MAX_WORDS`.

Results go back to equal vectors by two hashes: groups of over 1/`HOT_SHARE` of the rows, at most HOT_SHARE of them,
are broadcast, the others joined.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components
have 0 links and are their own component; rows without a vec_id are left out; of rows with one vec_id the
smallest vector counts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, shuffle_partitions, small_batches

THRESHOLD, RECALL, SAMPLE_ROWS, MAX_WORDS, BLOCK, LIST_ROWS, SEED = 0.95, 0.95, 20_000, 4096, 2048, 20_000, 11
HOT_SHARE = 1000


def units(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the usable vectors of an Arrow list column, and the vectors at unit length."""
    import pyarrow.compute as pc

    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    x = pc.list_flatten(column.take(rows)).to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(1, initial=0)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
    return rows[good], x / np.linalg.norm(x, axis=1, keepdims=True)


def _nearest(x: np.ndarray, words: np.ndarray, rows: int = 512) -> np.ndarray:
    """The nearest word of each row, some rows at a time."""
    size = (words * words).sum(1)
    return np.concatenate([np.argmin(size - 2 * x[i : i + rows] @ words.T, 1) for i in range(0, len(x), rows)])


def codebook(x: np.ndarray, words: int, rng, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means; words without vectors stay."""
    c = x[rng.choice(len(x), words, replace=len(x) < words)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        order = np.argsort(near, kind="stable")
        used, first = np.unique(near[order], return_index=True)
        c[used] = np.add.reduceat(x[order], first) / np.bincount(near, minlength=words)[used, None]
    return c


def multi_sequence(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cells (i, j) in ascending d1[i] + d2[j]."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, seen = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}
    while heap:
        _, a, b = heapq.heappop(heap)
        yield int(o1[a]), int(o2[b])
        for p in ((a + 1, b), (a, b + 1)):
            if p[0] < len(o1) and p[1] < len(o2) and p not in seen:
                seen.add(p)
                heapq.heappush(heap, (d1[o1[p[0]]] + d2[o2[p[1]]], *p))


class MultiIndex:
    def __init__(self, sample: np.ndarray, n_rows: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.dim, self.half = sample.shape[1], max(1, sample.shape[1] // 2)
        self.words = int(min(MAX_WORDS, 2 ** round(np.log2(max(2.0, np.sqrt(n_rows / 4))))))
        self.books = [codebook(h, self.words, rng) for h in self.halves(sample)]
        # worst neighbours: sampled vectors turned to exactly the threshold, in any direction
        x = sample[: min(len(sample), 2000)]
        z = rng.normal(size=x.shape)
        z -= (z * x).sum(1, keepdims=True) * x
        z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        y = self.cells(threshold * x + np.sqrt(1 - threshold**2) * z)
        ranks = []
        for i in range(0, len(x), 64):
            for one, two, own in zip(*self.distances(x[i : i + 64]), y[i : i + 64], strict=True):
                # cells before the neighbour's in the traversal, without the grid
                ranks.append(int(np.searchsorted(np.sort(two), one[own // self.words] + two[own % self.words] - one).sum()))
        self.visits = int(min(self.words**2, np.quantile(ranks, recall) + 1))

    def halves(self, x):
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x):
        return [(c * c).sum(1) - 2 * h @ c.T for h, c in zip(self.halves(x), self.books, strict=True)]

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = (_nearest(h, c) for h, c in zip(self.halves(x), self.books, strict=True))
        return one * self.words + two

    def visited(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The first cells of the multi-sequence traversal; the k-th has sorted ranks with (a + 1)(b + 1) <= k."""
        visits = min(visits, self.words**2)
        a, b = np.array([(a, b) for a in range(min(visits, self.words)) for b in range(min(visits // (a + 1), self.words))]).T
        o1, o2 = (np.argsort(d, 1, kind="stable") for d in self.distances(x))
        d1, d2 = (np.sort(d, 1) for d in self.distances(x))
        first = np.argsort(d1[:, a] + d2[:, b], 1, kind="stable")[:, :visits]
        rows = np.arange(len(x))[:, None]
        return o1[rows, a[first]] * self.words + o2[rows, b[first]]


def build_index(vectors: DataFrame, n_rows: int, sample_rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> MultiIndex | None:
    """None if there is no usable vector."""
    got = vectors.where("x is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("x").toArrow().column(0)
    if not len(got):
        return None
    import pyarrow.compute as pc

    lengths = pc.list_value_length(got).to_numpy()
    _, x = units(got.combine_chunks(), int(np.bincount(lengths).argmax()))
    return MultiIndex(x, n_rows, threshold) if len(x) and x.shape[1] > 1 else None


def form_balls(x: np.ndarray, weight: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(members, links within, radius); the first member is the leader, with which all others link."""
    g = x @ x.T
    free, out = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            free[i] = False
            m = np.concatenate([[i], np.flatnonzero(free & (g[i] >= threshold))])
            free[m] = False
            linked = g[np.ix_(m, m)] >= threshold
            np.fill_diagonal(linked, True)
            out.append((m, linked @ weight[m] - 1, float(np.arccos(np.clip(g[i, m[1:]], -1, 1)).max(initial=0))))
    return out


def _balls(vectors: DataFrame, index: MultiIndex, threshold: float, scratch: Scratch) -> DataFrame:
    """One row per ball: ball (its leader's vec_id), cell, radius, m (its weight), and of its members the arrays
    ids, weights, vecs and inner."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def assign(batches):
        import pyarrow as pa

        for b in batches:
            rows, x = units(b.column(1), shared.value.dim)
            cell = shared.value.cells(x) if len(x) else np.empty(0, int)
            yield pa.record_batch({"vec_id": b.column(0).take(rows), "w": b.column(2).take(rows), "cell": pa.array(cell, pa.int64()), "x": pa.array([v.tobytes() for v in x], pa.binary())})

    def gather(batches):
        import pyarrow as pa

        held, key = [], None

        def close():
            ids, weight = (np.array([h[i] for h in held], "<i8") for i in (0, 1))
            x = np.frombuffer(b"".join(h[2] for h in held)).reshape(len(held), -1)
            found = form_balls(x, weight, threshold)
            of_members = lambda a: pa.array([a[m].tobytes() for m, _, _ in found], pa.binary())
            return pa.record_batch({
                "ball": pa.array([ids[m[0]] for m, _, _ in found], pa.int64()), "cell": pa.array([key[0]] * len(found), pa.int64()), "radius": [r for _, _, r in found], "m": pa.array([weight[m].sum() for m, _, _ in found], pa.int64()),
                "ids": of_members(ids), "weights": of_members(weight), "vecs": of_members(x), "inner": pa.array([n.astype("<i8").tobytes() for _, n, _ in found], pa.binary()),
            })

        for b in batches:
            for *row, cell, salt in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and ((cell, salt) != key or len(held) == 2 * BLOCK):
                    yield close()
                    held = []
                key = (cell, salt)
                held.append(row)
        if held:
            yield close()

    cells = scratch.save(vectors.select("vec_id", "x", "w").mapInArrow(assign, "vec_id long, w long, cell long, x binary"), "cells")
    # few, as such a cell has BLOCK vectors at least; saved, so that Spark knows its size
    large = cells.groupBy("cell").count().where(F.col("count") > BLOCK).select("cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    large = scratch.save(large, "large")
    cells = cells.join(large, "cell", "left").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.coalesce("blocks", F.lit(1))).cast("int"))
    cells = cells.select("vec_id", "w", "x", "cell", "salt").repartition(shuffle_partitions(vectors.sparkSession), "cell", "salt").sortWithinPartitions("cell", "salt", "vec_id")
    return cells.mapInArrow(gather, "ball long, cell long, radius double, m long, ids binary, weights binary, vecs binary, inner binary")


def _ball_pairs(balls: DataFrame, index: MultiIndex, threshold: float) -> DataFrame:
    """(a, b, sure): balls a < b of which pairs may link, or all link (sure)."""
    spark = balls.sparkSession
    shared, parts, angle = spark.sparkContext.broadcast(index), shuffle_partitions(spark), float(np.arccos(threshold))

    def visit(batches):
        import pyarrow as pa

        idx = shared.value
        for b in batches:
            radius = b.column(1).to_numpy()
            width = 8 * idx.dim
            x = np.frombuffer(b"".join(v[:width] for v in b.column(2).to_pylist())).reshape(-1, idx.dim)
            for wide in (False, True):
                rows = np.flatnonzero((radius > 0) == wide)
                for k in range(0, len(rows), 500):
                    some = rows[k : k + 500]
                    cells = idx.visited(x[some], idx.visits * (3 if wide else 1))
                    again = np.repeat(some, cells.shape[1])
                    yield pa.record_batch({"cell": pa.array(cells.ravel(), pa.int64()), "ball": b.column(0).take(again), "radius": b.column(1).take(again), "x": pa.array([v.tobytes() for v in x], pa.binary()).take(again)})

    def match(batches):
        import pyarrow as pa

        key, listed, waiting = None, [], []

        def load(rows):
            return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.frombuffer(b"".join(r[2] for r in rows)).reshape(len(rows), -1)

        def close():
            if not listed or not waiting:
                return None
            (p, rp, xp), (q, rq, xq) = load(waiting), load(listed)
            g, r = xp @ xq.T, rp[:, None] + rq
            with np.errstate(invalid="ignore"):
                may = (g >= np.where(r == 0, threshold, np.cos(np.minimum(np.pi, angle + r)) - 1e-12)) & (p[:, None] != q)
            i, j = np.nonzero(may)
            sure = (r[i, j] == 0) | (np.arccos(np.clip(g[i, j], -1, 1)) + r[i, j] <= angle - 1e-9)
            pairs = np.unique(np.stack([np.minimum(p[i], q[j]), np.maximum(p[i], q[j]), sure], 1), axis=0)
            return pa.record_batch({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64()), "sure": pa.array(pairs[:, 2] == 1)})

        for b in batches:
            for cell, block, kind, *row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (cell, block) != key or len(waiting) == BLOCK:
                    if (out := close()) is not None:
                        yield out
                    waiting = []
                    if (cell, block) != key:
                        key, listed = (cell, block), []
                (waiting if kind else listed).append(row)
        if (out := close()) is not None:
            yield out

    leader = F.expr(f"substring(vecs, 1, {8 * index.dim})").alias("x")
    visits = balls.select("ball", "radius", leader).mapInArrow(visit, "cell long, ball long, radius double, x binary").select("cell", F.lit(1).alias("kind"), "ball", "radius", "x")
    # cells of many balls are listed in blocks, and their visitors go to each block
    large = balls.groupBy("cell").count().where(F.col("count") > LIST_ROWS).select("cell", F.ceil(F.col("count") / LIST_ROWS).cast("int").alias("blocks"))
    lists = balls.select("cell", F.lit(0).alias("kind"), "ball", "radius", leader).join(large, "cell", "left").withColumn("block", F.pmod(F.xxhash64("ball"), F.coalesce("blocks", F.lit(1))).cast("int"))
    visits = visits.join(large, "cell", "left").withColumn("block", F.explode(F.expr("sequence(0, coalesce(blocks, 1) - 1)")))
    rows = [d.select("cell", "block", "kind", "ball", "radius", "x") for d in (lists, visits)]
    dealt = rows[0].unionByName(rows[1]).repartition(parts, "cell", "block").sortWithinPartitions("cell", "block", "kind")
    found = dealt.mapInArrow(match, "a long, b long, sure boolean")
    return found.groupBy("a", "b").agg(F.max("sure").alias("sure"))


class _Sums:
    """Arrays of counts by ball, summed."""

    def __init__(self):
        self.by_ball = {}

    def add(self, ball, n):
        self.by_ball[ball] = self.by_ball[ball] + n if ball in self.by_ball else n

    def columns(self):
        return list(self.by_ball), [n.astype("<i8").tobytes() for n in self.by_ball.values()]


def _compare(pairs: DataFrame, balls: DataFrame, threshold: float) -> DataFrame:
    """Of the unsure pairs: (ball, more), what its members' links grow by, and (a, b) for balls that link."""

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            sums, links = _Sums(), []
            for a, b, vecs_a, w_a, vecs_b, w_b in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                p, q = np.frombuffer(w_a, "<i8"), np.frombuffer(w_b, "<i8")
                hit = np.frombuffer(vecs_a).reshape(len(p), -1) @ np.frombuffer(vecs_b).reshape(len(q), -1).T >= threshold
                if hit.any():
                    sums.add(a, hit @ q)
                    sums.add(b, p @ hit)
                    links.append((a, b))
            ball, more = sums.columns()
            none = [None] * len(ball)
            left, right = zip(*links, strict=True) if links else ((), ())
            yield pa.record_batch([pa.array([*ball, *[None] * len(links)], pa.int64()), pa.array([*more, *[None] * len(links)], pa.binary()), pa.array([*none, *left], pa.int64()), pa.array([*none, *right], pa.int64())], ["ball", "more", "a", "b"])

    side = lambda s: balls.select(F.col("ball").alias(s), F.col("vecs").alias(f"vecs_{s}"), F.col("weights").alias(f"weights_{s}"))
    rows = pairs.where("not sure").select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "vecs_a", "weights_a", "vecs_b", "weights_b")
    return rows.mapInArrow(count, "ball long, more binary, a long, b long")


def _summed(counts: DataFrame) -> DataFrame:
    """(ball, more): one row for each ball."""

    def run(batches):
        import pyarrow as pa

        last = _Sums()
        for b in batches:
            sums = last
            for ball, more in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.add(ball, np.frombuffer(more, "<i8"))
            last = _Sums()
            if sums.by_ball:  # the last ball may go on in the next batch
                last.add(*sums.by_ball.popitem())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(sums.columns(), (pa.int64(), pa.binary()), strict=True)], ["ball", "more"])
        yield pa.record_batch([pa.array(c, t) for c, t in zip(last.columns(), (pa.int64(), pa.binary()), strict=True)], ["ball", "more"])

    dealt = counts.repartition(shuffle_partitions(counts.sparkSession), "ball").sortWithinPartitions("ball")
    return dealt.mapInArrow(run, "ball long, more binary")


def _unlinked(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    spark = embeddings.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    rows = embeddings.where("vec_id is not null").groupBy("vec_id").agg(F.min("embedding").alias("x"))
    rows = scratch.save(rows.select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")), "rows")
    usable = rows.where("x is not null")
    same = usable.groupBy("h1", "h2").agg(F.min(F.struct("vec_id", "x")).alias("m"), F.count("*").alias("w"))
    vectors = scratch.save(same.select("m.vec_id", "m.x", "w", "h1", "h2"), "vectors")
    index = build_index(vectors, vectors.count(), threshold=threshold)
    if index is None:
        return _unlinked(rows)
    balls = scratch.save(_balls(vectors, index, threshold, scratch), "balls")
    pairs = scratch.save(_ball_pairs(balls, index, threshold), "pairs")
    compared = scratch.save(_compare(pairs, balls, threshold), "compared")
    sure = pairs.where("sure")
    edges = sure.select("a", "b").unionByName(compared.where("ball is null").select("a", "b"))
    roots = scratch.save(components(edges, scratch), "roots").withColumnRenamed("node", "ball")
    sizes = balls.select("ball", "m")
    ways = sure.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionByName(sure.select(F.col("b").alias("ball"), F.col("a").alias("other")))
    outer = ways.join(sizes.withColumnRenamed("ball", "other"), "other").groupBy("ball").agg(F.sum("m").alias("outer"))
    more = _summed(compared.where("ball is not null").select("ball", "more"))

    def members(batches):
        import pyarrow as pa

        for b in batches:
            ids, inner = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<i8") for i in (1, 2))
            counts = np.array([len(v) // 8 for v in b.column(1).to_pylist()], int)
            gained = np.concatenate([np.frombuffer(v, "<i8") if v else np.zeros(n, np.int64) for v, n in zip(b.column(3).to_pylist(), counts.tolist(), strict=True)] or [np.empty(0, np.int64)])
            yield pa.record_batch({"vec_id": pa.array(ids), "inner": pa.array(inner + gained), "ball": b.column(0).take(np.repeat(np.arange(len(counts)), counts))})

    found = balls.select("ball", "ids", "inner").join(more, "ball", "left").mapInArrow(members, "vec_id long, inner long, ball long")
    found = found.join(outer, "ball", "left").join(roots, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    found = scratch.save(found.select("vec_id", "root", (F.col("inner") + F.coalesce("outer", F.lit(0))).alias("n")), "members")
    least = found.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = found.join(least, "root").join(vectors.select("vec_id", "w", "h1", "h2"), "vec_id")
    known = scratch.save(known.select("h1", "h2", "w", F.col("n").alias("n_links"), "component_id"), "known")
    hot = F.broadcast(known.where(F.col("w") * HOT_SHARE > usable.count()).drop("w"))  # at most HOT_SHARE rows
    keys = ["h1", "h2"]
    linked = usable.drop("x").join(hot, keys).unionByName(usable.drop("x").join(hot, keys, "left_anti").join(known.drop("w"), keys))
    out = linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return out.unionByName(_unlinked(rows.join(linked.select("vec_id"), "vec_id", "left_anti")))


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
