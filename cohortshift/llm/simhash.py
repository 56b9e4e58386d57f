"""SimHash near-duplicates through segment popcounts.

A fingerprint is embedded as the popcounts of its 32 two-bit segments. The Manhattan distance of two embeddings
is at most the Hamming distance, so of fingerprints within 3 bits the embeddings of the lower or of the upper 32
bits differ by at most 1. The grid: each half's 16 counts, with cells one count wide. A fingerprint goes to its
own cell of each half, and to the cells one count further along each axis: two points at distance 1 differ by one
count on one axis, so they meet in the cell of the larger. That is some 26 rows for a fingerprint, at any size.
Within a cell the total popcounts, sorted, bound the Manhattan distance of all segments once more (a range join),
and XOR verifies. A cell returns the links of a breadth-first search, fewer than its members, never all its pairs.

Equal fingerprints count once. A cell is held as 8 bytes for each different fingerprint; random ones crowd least
(10^9 of them put 15,000 into the fullest cell), and near copies of one text leave the search as they are found.

Defined cases: null and empty texts have fingerprint 0 and link like any other; texts of one or two words are
one shingle; rows without a doc_id are left out; repeated rows give repeated result rows of equal content;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, shuffle_partitions, small_batches

SHINGLE, DISTANCE = 3, 3
PAIRS = 0x5555555555555555
HALF = (1 << 32) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is set if it is in over half of the shingles' hashes."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    hashes = np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts, stops, strict=False)), np.uint64, n)
    total = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch({"doc_id": b.column(0).cast(pa.int64()), "fp": pa.array(fps.view(np.int64))})

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _embedding():
    """Each two bits become their sum: hi & lo, hi ^ lo."""
    fp, lo = F.col("fp"), F.lit(PAIRS)
    hi = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(hi.bitwiseAND(fp).bitwiseAND(lo), 1).bitwiseOR(hi.bitwiseXOR(fp).bitwiseAND(lo))


def grid_cells(half: int) -> list[int]:
    """The cell of a half's embedding, and those one count further along each axis."""
    return [half, *(half + (1 << i) for i in range(0, 32, 2) if half >> i & 3 != 2)]


def _cells(fps: DataFrame) -> DataFrame:
    """(half, cell, fp): grid_cells in SQL. The embedding is unrolled once; a count of 3 does not exist."""
    code = fps.select("fp", F.explode(F.array(_embedding())).alias("code"))
    halves = F.posexplode(F.array(F.col("code").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("code", 32)))
    steps = F.expr("transform(filter(sequence(0, 30, 2), i -> (shiftright(at, i) & 3L) <> 2L), i -> at + shiftleft(1L, i))")
    return code.select("fp", halves.alias("half", "at")).select("half", F.explode(F.concat(F.array("at"), steps)).alias("cell"), "fp")


def search(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect the members of a cell within the distance, by breadth-first search."""
    if len(fps) == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= distance else []
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order].astype(np.int64)
    free, links = np.ones(len(fps), bool), []
    for seed in range(len(fps)):
        if not free[seed]:
            continue
        free[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            lo, hi = np.searchsorted(ones, [ones[at] - distance, ones[at] + distance + 1])
            near = np.flatnonzero(free[lo:hi] & (np.bitwise_count(fps[lo:hi] ^ fps[at]) <= distance)) + lo
            free[near] = False
            links += [(order[at], order[x]) for x in near]
            queue += near.tolist()
    return links


def _links_in_cells(cells: DataFrame, distance: int) -> DataFrame:
    """(a, b): links that connect the fingerprints of each cell."""
    parts = shuffle_partitions(cells.sparkSession)

    def run(batches):
        import pyarrow as pa

        # the last cell of a batch may go on in the next
        held, key = [], None

        def linked(fps):
            pairs = np.array(search(fps.view(np.uint64), distance) if len(fps) > 1 else [], int).reshape(-1, 2)
            return fps[pairs[:, 0]], fps[pairs[:, 1]]

        def links(found):
            return pa.record_batch({c: pa.array(np.concatenate([f[i] for f in found])) for i, c in enumerate("ab")})

        for batch in batches:
            half, cell, fp = (batch.column(i).to_numpy() for i in range(3))
            if not len(fp):
                continue
            cuts = np.flatnonzero((half[1:] != half[:-1]) | (cell[1:] != cell[:-1])) + 1
            begins, ends = np.append(0, cuts), np.append(cuts, len(fp))
            found = [(np.empty(0, np.int64),) * 2]
            inner = np.flatnonzero(ends - begins > 1)
            for i, j in zip(begins[inner].tolist(), ends[inner].tolist(), strict=True):
                if 0 < i and j < len(fp):
                    found.append(linked(fp[i:j]))
            for n in sorted({0, len(cuts)}):
                i, j = begins[n], ends[n]
                if (half[i], cell[i]) != key and held:
                    found.append(linked(np.concatenate(held)))
                    held = []
                held.append(fp[i:j].copy())
                key = half[i], cell[i]
            yield links(found)
        if held:
            yield links([linked(np.concatenate(held))])

    dealt = cells.select("half", "cell", "fp").repartition(parts, "half", "cell").sortWithinPartitions("half", "cell")
    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (a, b) that connect all fingerprints within 3 bits of each other; fps is distinct."""
    return scratch.save(_links_in_cells(_cells(fps), DISTANCE), "links")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links."""
    scratch = Scratch(docs.sparkSession)
    prints = scratch.save(fingerprints(docs), "prints")
    least = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "least")
    roots = scratch.save(components(fingerprint_links(least.select("fp"), scratch), scratch), "roots").withColumnRenamed("node", "fp")
    classes = least.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = classes.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
