"""Packing by minimum bin slack: a bitset subset-sum program picks the multiset of lengths that fills each
sequence closest to capacity, with backtracked counts.

Documents are cut at multiples of the capacity, and these pieces fill sequences alone. What remains of a
document has one of at most capacity - 1 lengths, so the plan needs only their histogram, whatever the number of
documents: the driver repeats each pattern as often as the counts allow. Where no multiset fills a sequence,
the slack is filled with the head of one more remainder, whose tail goes back into the histogram. So only the
last sequence can hold padding.

The plan is a table of rank ranges of each length class. Ranks are counted by (length, salt) and offset, with a salt
for each shuffle partition, so a length that a third of all documents have takes no single task. Token ids are written once and read once.

Defined cases: a null or empty text is the end id alone; rows without a doc_id are left out; repeated rows are
packed once each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, salted_rank, shuffle_partitions, small_batches
from .tokens import encoder

CAPACITY = 2048


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of the given lengths, within their counts, whose sum is closest to `room` from below."""
    mask, reach, steps = (1 << room + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left > 0:
            take = min(k, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, k = left - take, 2 * k
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int, int, int]]], int]:
    """For each remainder length: (lo, hi, start, length, sequence, offset), and the number of sequences.

    A remainder of rank lo + t < hi has its ids [start, start + length) in sequence + t, from offset.
    """
    stock = {length: deque([(length, 0, 0, n)]) for length, n in histogram.items() if n > 0}
    count = {length: n for length, n in histogram.items() if n > 0}
    placed, sequences = defaultdict(list), 0

    def put(length, times, take, at):
        """Places the first `take` ids of `times` pieces of this length, one in each sequence from `sequences`."""
        seq, left = sequences, times
        while left:
            origin, start, lo, hi = stock[length].popleft()
            n = min(left, hi - lo)
            if lo + n < hi:
                stock[length].appendleft((origin, start, lo + n, hi))
            placed[origin].append((lo, lo + n, start, take, seq, at))
            if take < length:
                stock.setdefault(length - take, deque()).append((origin, start + take, lo, lo + n))
                count[length - take] = count.get(length - take, 0) + n
            seq, left = seq + n, left - n
        count[length] -= times
        if not count[length]:
            del count[length], stock[length]

    while count:
        first = max(count)
        others = {x: n - (x == first) for x, n in count.items() if n > (x == first)}
        fill = best_fill(others, capacity - first)
        slack = capacity - first - sum(x * k for x, k in fill.items())
        need = dict(fill)
        need[first] = need.get(first, 0) + 1
        donor = None
        if slack and (spare := [x for x, n in count.items() if n > need.get(x, 0) and x > slack]):
            donor = max(spare)
            need[donor] = need.get(donor, 0) + 1
        times, at = min(count[x] // k for x, k in need.items()), 0
        for x, k in sorted({**fill, first: fill.get(first, 0) + 1}.items(), reverse=True):
            for _ in range(k):
                put(x, times, x, at)
                at += x
        if donor:
            put(donor, times, slack, at)
        sequences += times
    return dict(placed), sequences


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(uid, doc_id, n, ids): ids with the end id, in the tokenizer's smallest unsigned type; uid is unique."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc, uid = encoder(tokenizer), TaskContext.get().partitionId() << 33
        end = np.array(end_id, enc.dtype)
        for b in batches:
            ids = [np.append(i, end) for i in enc.encode_many(b.column(1).to_pylist())]
            uids = np.arange(uid, uid + len(ids))
            uid += len(ids)
            yield pa.record_batch({"uid": pa.array(uids), "doc_id": b.column(0).cast(pa.int64()), "n": pa.array([len(i) for i in ids], pa.int64()), "width": pa.array([enc.dtype.itemsize] * len(ids), pa.int32()), "ids": pa.array([i.tobytes() for i in ids], pa.binary())})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "uid long, doc_id long, n long, width int, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, salts: int | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids its ids too."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    tokens = scratch.save(tokenize(docs, tokenizer, end_id), "tokens")
    sizes = tokens.select("uid", (F.col("n") % capacity).alias("rest"), F.expr(f"n div {capacity}").alias("whole"))
    histogram = {r["rest"]: r["count"] for r in sizes.where("rest > 0").groupBy("rest").count().collect()}
    placed, packed = plan(histogram, capacity)
    salts = salts or shuffle_partitions(spark)
    ranked = salted_rank(sizes, ["rest"], ["uid"], "rank", salts).select("uid", "rank")
    # sequences of whole pieces, which only documents of that length have, are numbered by running sums within salts
    long = sizes.where("whole > 0").withColumn("s", F.pmod(F.xxhash64(F.lit(1), F.col("uid")), F.lit(salts)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    totals = long.groupBy("s").agg(F.sum("whole").alias("t"))  # a row for each salt
    totals = totals.select("s", F.coalesce(F.sum("t").over(before(Window.orderBy("s"))), F.lit(0)).alias("base"))
    long = long.withColumn("own", F.coalesce(F.sum("whole").over(before(Window.partitionBy("s").orderBy("uid"))), F.lit(0)))
    long = long.join(totals, "s").select("uid", (F.col("base") + F.col("own") + F.lit(packed)).alias("seq"))
    ranked = ranked.join(long, "uid", "left")
    shared = spark.sparkContext.broadcast({r: np.array(rows, np.int64) for r, rows in placed.items()})
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = {c: [] for c in [*names, *["ids"] * keep_ids]}
            for doc_id, n, width, data, rank, seq in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                ids = np.frombuffer(data, f"<u{width}").astype("<u4")
                base = n - n % capacity
                pieces = [(k * capacity, capacity, seq + k, 0) for k in range(n // capacity)]
                if base < n:
                    p = shared.value[n - base]
                    for lo, _, start, length, first, at in p[(p[:, 0] <= rank) & (rank < p[:, 1])].tolist():
                        pieces.append((base + start, length, first + rank - lo, at))
                for start, length, sequence, at in sorted(pieces):
                    part = ids[start : start + length].tobytes()
                    for c, v in zip(out, (doc_id, start, length, zlib.crc32(part), n, sequence, at, part), strict=False):
                        out[c].append(v)
            yield pa.record_batch({c: pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in out.items()})

    rows = tokens.join(ranked, "uid").select("doc_id", "n", "width", "ids", "rank", "seq")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", ids binary" * keep_ids)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
