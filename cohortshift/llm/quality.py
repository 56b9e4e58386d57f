"""Quality classifier: a factorisation machine over hashed words and structure statistics of the text.

score = sigmoid(w0 + <w, x> + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions
in linear time by the sum-of-squares identity. x holds the words of the whole text, hashed to `BUCKETS` and
weighted by log counts at unit length, and standardised statistics of its characters, words and lines, and of the
metadata that may be used: n_chars, the length that the table states.

The model is fitted on at most `TRAIN_ROWS` labelled rows, chosen by a hash of doc_id; only their sparse
features come to the driver. Every document is scored. Labels, lang, source and doc_id are never inputs.

Defined cases: null and empty texts have no words and are scored from the statistics; labels of null or of
repeated ids count by their rounded mean; without labels of both kinds the score is their mean, or 1 without
any; n_chars counts as the text's length where it is null, no number or missing; rows without a doc_id are left
out; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BUCKETS, RANK, TRAIN_ROWS, EPOCHS, SEED = 1 << 14, 8, 6000, 8, 7
STATS = 14
_CLASSES = np.zeros((256, 6))
for _i, _of in enumerate((range(65, 91), range(97, 123), range(48, 58), [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], range(128, 256), [9, 10, 11, 12, 13, 32])):
    _CLASSES[list(_of), _i] = 1


class Features:
    """Sparse features of a text: sorted bucket numbers, their weights, and the raw statistics."""

    def __init__(self, limit: int = 500_000):
        self.cache, self.limit = {}, limit

    def __call__(self, text: str | None, n_chars: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import zlib

        text = text or ""
        raw = text.encode()
        stated = len(text) if n_chars is None or not n_chars >= 0 else min(n_chars, 1e12)
        words = raw.lower().split()
        cache = self.cache
        try:
            ids = [cache[w] for w in words]
        except KeyError:
            ids = [cache[w] if w in cache else zlib.crc32(w) % BUCKETS for w in words]
            if len(cache) < self.limit:
                cache.update((w, i) for w, i in zip(words, ids, strict=True) if len(w) <= 40)
        at, counts = np.unique(np.array(ids, np.int32), return_counts=True)
        weight = np.log1p(counts)
        weight /= max(1e-9, np.sqrt(weight @ weight))
        n = max(1, len(raw))
        upper, lower, digit, punct, high, space = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / n
        lines = raw.split(b"\n")
        distinct = len(set(words)) / max(1, len(words))
        stats = np.array([np.log1p(len(words)), len(raw) / (1 + len(words)), upper, lower, digit, punct, high, space, distinct, len(set(lines)) / len(lines), np.log1p(n / len(lines)), upper / max(1e-9, upper + lower), np.log1p(stated), stated / n])
        return at, weight, np.clip(stats, 0, 50)


class Machine:
    """Weights of a factorisation machine; the statistics follow the buckets."""

    def __init__(self, w0, w, v, mean, scale):
        self.w0, self.w, self.v, self.mean, self.scale = w0, w, v, mean, scale

    def join(self, at, weight, stats):
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(STATS)
        return np.concatenate([at, np.arange(BUCKETS, BUCKETS + STATS)]), np.concatenate([weight, z])

    def score(self, at, weight, stats) -> float:
        i, x = self.join(at, weight, stats)
        vx = self.v[i] * x[:, None]
        s = vx.sum(0)
        y = self.w0 + self.w[i] @ x + 0.5 * (s @ s - (vx * vx).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rank: int = RANK, seed: int = SEED, rate: float = 0.03, decay: float = 1e-5) -> Machine:
    """Adagrad on the logistic loss, in batches of 64 rows."""
    rng = np.random.default_rng(seed)
    stats = np.array([r[2] for r in rows])
    prior = float(np.clip(labels.mean(), 0.01, 0.99))
    m = Machine(np.log(prior / (1 - prior)), np.zeros(BUCKETS + STATS), rng.normal(0, 0.05, (BUCKETS + STATS, rank)), stats.mean(0), np.maximum(stats.std(0), 1e-6))
    joined = [m.join(*r) for r in rows]
    gw, gv, g0 = np.full(len(m.w), 1e-6), np.full(m.v.shape, 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            some = order[k : k + 64]
            i = np.concatenate([joined[r][0] for r in some])
            x = np.concatenate([joined[r][1] for r in some])
            cuts = np.cumsum([0, *(len(joined[r][0]) for r in some[:-1])])
            row = np.repeat(np.arange(len(some)), np.diff([*cuts, len(i)]))
            vx = m.v[i] * x[:, None]
            s = np.add.reduceat(vx, cuts)
            y = m.w0 + np.add.reduceat(m.w[i] * x, cuts) + 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), cuts))
            err = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[some]) / len(some)
            used, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, err[row] * x) + decay * m.w[used]
            part = (err[row] * x)[:, None] * (s[row] - vx)
            dv = np.stack([np.bincount(back, part[:, f]) for f in range(rank)], 1) + decay * m.v[used]
            gw[used] += dw * dw
            gv[used] += dv * dv
            g0 += err.sum() ** 2
            m.w[used] -= rate * 3 * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
            m.w0 -= rate * err.sum() / np.sqrt(g0)
    return m


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def _inputs(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_chars): all that may be read of a document."""
    stated = F.expr("try_cast(cast(n_chars AS string) AS double)") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.where("doc_id is not null").select("doc_id", "text", stated.alias("n_chars"))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Machine | float:
    """A machine, or the constant score if the labels are all alike."""
    small_batches(docs.sparkSession)
    truth = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("label", "text", "n_chars")  # at most train_rows rows of two numbers

    def run(batches):
        import pyarrow as pa

        features = Features()
        for b in batches:
            got = [features(*t) for t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.record_batch({"label": b.column(0), **{c: pa.array([g[i].astype(t).tobytes() for g in got], pa.binary()) for i, (c, t) in enumerate((("at", "<i4"), ("weight", "<f4"), ("stats", "<f8")))}})

    got = sample.mapInArrow(run, "label int, at binary, weight binary, stats binary").toArrow().to_pylist()
    got.sort(key=lambda r: (r["at"], r["label"]))
    y = np.array([r["label"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    return fit([(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["weight"], "<f4").astype(float), np.frombuffer(r["stats"], "<f8")) for r in got], y)


def score_documents(docs: DataFrame, model: Machine | float) -> DataFrame:
    """(doc_id, score) of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m, features = shared.value, Features()
        for b in batches:
            rows = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            s = [m if isinstance(m, float) else m.score(*features(*r)) for r in rows]
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()), "score": pa.array(s, pa.float64())})

    return _inputs(docs).mapInArrow(run, "doc_id long, score double")


def op7_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return score_documents(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
