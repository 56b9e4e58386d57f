"""Exact substring dedup over a distributed suffix array.

A byte goes if a `LENGTH`-byte string that covers it also starts earlier in the corpus, in (doc_id, position)
order. Windows are the suffixes cut at LENGTH bytes; equal ones must meet, and nothing else need be sorted.

1. Within a task, a text that repeats one with a smaller doc_id goes whole and makes no runs (below LENGTH bytes
   a text has no window and stays), and of equal runs in a batch only the first moves on. So a group of copies
   makes the rows of one text for each task, and a frequent passage those of one place for each batch.
2. The window's anchor is its smallest-hashed `GRAM`-byte string, leftmost of equals. It depends on the window's
   bytes alone, so equal windows have equal anchors at equal offsets. Consecutive windows with one anchor form a
   run; runs are what moves: two hashes and a place each, about one for every 39 bytes.
3. Runs are dealt by anchor hash and read in (anchor, run hash, place) order. A run equal to an earlier one is
   repeated as a whole. The first of each kind, where an anchor has several kinds, is open: its windows may be
   repeated in part.
4. The bytes of open runs (edges of repeats and edits) are fetched and dealt by anchor hash, and their suffixes
   are sorted deep-shallow: a multikey quicksort to `SHALLOW` bytes, breadth first and a word at a time, then
   blind tries order the groups that still share their prefix. Equal windows are then neighbours; all but the
   earliest are repeated. Equal texts and equal runs were collapsed by their hashes in steps 1 and 3.

Groups of a run kind are never held: the stream keeps one row. Of an anchor with over `HOT` open runs (a passage
in very many edits) the windows themselves are dealt, by their own hash, and of equal ones in a batch the first;
so no task sorts a hot anchor, and its tasks are as many as its different windows.

Defined cases: null and empty texts have no bytes; texts under LENGTH bytes stay; rows without a doc_id are left
out; rows that share doc_id and text are one row, given back as often; rows that share a doc_id alone are texts of
their own, in the order of a hash of them; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, small_batches

LENGTH, GRAM, SHALLOW = 100, 24, 16
#: Bytes of a text that are hashed at once; longer texts go in overlapping parts.
PART = 1 << 20
#: Open runs of an anchor beyond which its windows are dealt one by one.
HOT = 2000
#: Open runs that are sorted at once, and HOT more at most.
SORT_ROWS = 20_000
_ODD = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A mixed polynomial hash (mod 2^64) of each gram-byte string."""
    h, size, power, made = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, 0x94D049BB133111EB, {}
    while size <= gram:
        made[size] = h
        h, size, power = h[:-size] * np.uint64(power) + h[size:], size * 2, power * power & (1 << 64) - 1
    n, out, at = len(data) - gram + 1, None, 0
    for size in sorted(made, reverse=True):
        if gram & size:
            part = made[size][at : at + n]
            out, at = part if out is None else out * np.uint64(_ODD) + part, at + size
    out = (out ^ out >> np.uint64(31)) * np.uint64(_ODD)
    return out ^ out >> np.uint64(29)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, n): n windows from start share the anchor."""
    anchors, starts = [], []
    data = np.frombuffer(raw, np.uint8)
    windows = len(data) - length + 1
    for a in range(0, windows, PART):
        b = min(windows, a + PART)
        h = gram_hashes(data[a : b + length - 1], gram)
        # 40 bits of hash, then the place: of equal hashes the leftmost is smallest
        first = _sliding_min(h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & np.uint64((1 << 24) - 1)
        cuts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
        anchors.append(h[first[cuts].astype(np.int64)])
        starts.append(cuts + a)
    start = np.concatenate(starts)
    return np.concatenate(anchors), start, np.diff(np.append(start, windows))


class BlindTrie:
    """A compacted trie that keeps only the place of each branching bit's byte; strings confirm on insertion."""

    __slots__ = ("root", "text")

    def __init__(self, text):
        self.text, self.root = text, None

    def insert(self, suffix: int, length: int) -> int | None:
        """Adds a suffix; the suffix that is equal over `length` bytes, if there is one, and else None."""
        own = self.text[suffix : suffix + length]
        if self.root is None:
            self.root = suffix
            return None
        node = self.root
        while isinstance(node, list):  # [depth, {byte: child}]: a blind descent
            node = node[1].get(own[node[0]]) if own[node[0]] in node[1] else next(iter(node[1].values()))
        other = self.text[node : node + length]
        if own == other:
            return node
        lcp = length - -(-(int.from_bytes(own) ^ int.from_bytes(other)).bit_length() // 8)
        parent, node = None, self.root
        while isinstance(node, list) and node[0] < lcp:
            parent, node = (node, own[node[0]]), node[1][own[node[0]]]
        if isinstance(node, list) and node[0] == lcp:
            node[1][own[lcp]] = suffix
            return None
        fresh = [lcp, {own[lcp]: suffix, other[lcp]: node}]
        if parent is None:
            self.root = fresh
        else:
            parent[0][1][parent[1]] = fresh
        return None


def shallow_groups(text: bytes, places: np.ndarray, group: np.ndarray, depth: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(rows, segment): windows that share group and `depth` bytes with another, and which of them share.

    A multikey quicksort, breadth first: all segments of a depth are split at once by their next eight bytes, and
    windows that are alone leave.
    """
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text + b"\0" * 8, np.uint8), 8)
    rows, segment = np.arange(len(places)), group
    for at in range(0, depth, 8):
        word = np.ascontiguousarray(words[places[rows] + at]).view(">u8").ravel().astype(np.uint64)
        order = np.argsort(word, kind="quicksort")
        order = order[np.argsort(segment[order], kind="stable")]
        rows, word, segment = rows[order], word[order], segment[order]
        split = np.ones(len(rows), bool)
        split[1:] = (segment[1:] != segment[:-1]) | (word[1:] != word[:-1])
        segment = np.cumsum(split) - 1
        shared = np.bincount(segment)[segment] > 1 if len(rows) else split
        rows, segment = rows[shared], segment[shared]
    return rows, segment


def repeated_windows(text: bytes, places: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which of the windows at `places` in `text`, given in corpus order, have an equal earlier one in their group.

    Deep-shallow: groups that a multikey quicksort leaves with an equal prefix go on to blind tries.
    """
    out = np.zeros(len(places), bool)
    rows, segment = shallow_groups(text, places, group)
    cuts = np.flatnonzero(np.diff(segment)) + 1
    for members in np.split(rows, cuts) if len(rows) else ():
        members.sort()
        trie = BlindTrie(text)
        for m, p in zip(members.tolist(), places[members].tolist(), strict=True):
            if trie.insert(p, length) is not None:
                out[m] = True
    return out


def first_runs(anchor, kind, row, start) -> tuple[np.ndarray, np.ndarray]:
    """Of runs in (row, start) order: which are the first of their kind, and which repeat it at another place."""
    order = np.lexsort((kind, anchor))  # stable: within a kind by place
    head = np.ones(len(order), bool)
    head[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (kind[order[1:]] != kind[order[:-1]])
    lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
    first, again = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[head]] = True
    again[order] = ~head & ((row[order] != row[lead]) | (start[order] != start[lead]))
    return first, again


def _spans(row, start, n) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in (row, start) order, with neighbours joined."""
    if not len(row):
        return row, start, n
    begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + n[:-1])]))
    return row[begins], start[begins], np.add.reduceat(n, begins)


def _spread(doc: np.ndarray) -> np.ndarray:
    """A key that deals rows that need not meet."""
    return (doc.view(np.uint64) * np.uint64(_ODD)).view(np.int64)


def _run_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, kind, doc_id, variant, start, n, known): the runs of each text; kind is a hash of a run's bytes.

    Runs are pre-aggregated before they move: of the equal runs of a batch only the first is dealt by its anchor.
    The others are known to be repeated, and neighbours among them become one span, dealt by document; so do whole
    texts that repeat one with a smaller doc_id (n = -1). Frequent passages cost one row for each batch.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest, least = xxhash.xxh3_64_intdigest, {}
        for b in batches:
            texts = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            rows = sorted({(d, v): (t or "").encode() for d, v, t in texts}.items())
            doc, variant = np.array([r[0] for r in rows], np.int64).reshape(-1, 2).T
            parts, whole = [], []
            for i, (own, raw) in enumerate(rows):
                if len(raw) < length:
                    continue
                text = xxhash.xxh3_128_digest(raw)
                if least.setdefault(text, own) < own:
                    whole.append(i)
                    continue
                least[text] = own
                anchor, start, n = runs(raw, length, gram)
                ends = (start + n + length - 1).tolist()
                kind = np.fromiter((digest(raw[x:y]) for x, y in zip(start.tolist(), ends, strict=True)), np.uint64, len(start))
                parts.append((anchor.view(np.int64), kind.view(np.int64), np.full(len(start), i), start, n))
            anchor, kind, row, start, n = (np.concatenate(c) for c in zip(*parts, [np.empty(0, np.int64)] * 5, strict=True))
            first, again = first_runs(anchor, kind, row, start)
            known = [np.concatenate(c) for c in zip(_spans(row[again], start[again], n[again]), (np.array(whole, np.int64), np.zeros(len(whole), np.int64), np.full(len(whole), -1)), strict=True)]
            dealt, none = [c[first] for c in (anchor, kind, row, start, n)], np.zeros(len(known[0]), np.int64)
            cols = [np.concatenate(c) for c in zip(dealt, (_spread(doc[known[0]]), none, *known), strict=True)]
            flags = np.repeat([False, True], [len(dealt[0]), len(none)])
            cols = [*cols[:2], doc[cols[2]], variant[cols[2]], *cols[3:]]
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in cols), pa.array(flags)], ["anchor", "kind", "doc_id", "variant", "start", "n", "known"])

    return docs.mapInArrow(run, "anchor long, kind long, doc_id long, variant long, start long, n long, known boolean")


def _sort_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, variant, start, n, anchor, open): runs that are repeated, and those that are open."""

    def scan(batches):
        import pyarrow as pa

        # of the last row: anchor, kind, doc_id, variant, start; first: the first row of its anchor while that has one kind
        last, first = None, None
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            whole = b.column(6).to_numpy(zero_copy_only=False)
            out = [(*(cols[i][whole] for i in (2, 3, 4, 5, 0)), np.zeros(whole.sum(), bool))]
            anchor, kind, doc, variant, start, n = (c[~whole] for c in cols)
            if len(anchor):
                before = [np.concatenate([[0 if last is None else last[i]], c[:-1]]) for i, c in enumerate((anchor, kind, doc, variant, start))]
                new_anchor = anchor != before[0]
                new_kind = new_anchor | (kind != before[1])
                if last is None:
                    new_anchor[0] = new_kind[0] = True
                again = ~new_kind & ((doc != before[2]) | (variant != before[3]) | (start != before[4]))
                group, second = np.cumsum(new_anchor), new_kind & ~new_anchor
                many = np.bincount(group, second, minlength=group[-1] + 1) > 0
                heads = np.flatnonzero(new_anchor)
                opened = second.copy()
                opened[heads[many[1:]]] = True
                if many[0] and first is not None:
                    out.append((*(np.array([v]) for v in first), np.ones(1, bool)))
                if many[-1]:
                    first = None
                elif len(heads):
                    first = tuple(c[heads[-1]] for c in (doc, variant, start, n, anchor))
                for mask in (again, opened):
                    out.append((*(c[mask] for c in (doc, variant, start, n, anchor)), np.full(mask.sum(), mask is opened)))
                last = anchor[-1], kind[-1], doc[-1], variant[-1], start[-1]
            yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["doc_id", "variant", "start", "n", "anchor", "open"])

    order = ["anchor", "kind", "doc_id", "variant", "start"]
    dealt = rows.repartition(shuffle_partitions(rows.sparkSession), "anchor").sortWithinPartitions(*order)
    return dealt.mapInArrow(scan, "doc_id long, variant long, start long, n long, anchor long, open boolean")


def _fetched(docs: DataFrame, opened: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(key, doc_id, variant, start, n, bytes): open runs by anchor, and the windows of hot ones by a hash of their own.

    Of a batch's equal windows only the first has its bytes; the others are known to be repeated, and have none.
    """

    def fetch(batches):
        import pyarrow as pa
        import xxhash

        digest, names = xxhash.xxh3_64_intdigest, ["key", "doc_id", "variant", "start", "n", "bytes"]
        for b in batches:
            rows, seen, known = [], {}, []
            texts = zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
            for doc_id, variant, text, places in sorted(texts, key=lambda r: r[:2]):
                raw = text.encode()
                for r in sorted(places, key=lambda r: r["start"]):
                    start, n = r["start"], r["n"]
                    if not r["hot"]:
                        rows.append((r["anchor"], doc_id, variant, start, n, raw[start : start + n + length - 1]))
                        continue
                    for i in range(start, start + n):
                        window = raw[i : i + length]
                        own = doc_id, variant, i
                        if seen.setdefault(window, own) == own:
                            rows.append((digest(window) - (1 << 63), *own, 1, window))
                        else:
                            known.append(own)
            if known:
                doc, variant, at = np.array(known, np.int64).T
                row = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (variant[1:] != variant[:-1])]))
                first = np.unique(row, return_index=True)[1]
                row, at, n = _spans(row, at, np.ones(len(at), np.int64))
                doc, variant = doc[first[row]], variant[first[row]]
                rows += zip(*(c.tolist() for c in (_spread(doc), doc, variant, at, n)), [None] * len(at), strict=True)
            types = [pa.int64()] * 5 + [pa.binary()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    # few, as such an anchor has HOT open runs at least; saved, so that Spark knows its size
    hot = opened.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.lit(True).alias("hot"))
    places = opened.join(scratch.save(hot, "hot"), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    places = places.groupBy("doc_id", "variant").agg(F.collect_set(F.struct("anchor", "start", "n", "hot")).alias("runs"))
    rows = docs.join(places, ["doc_id", "variant"]).select("doc_id", "variant", "text", "runs")
    return rows.mapInArrow(fetch, "key long, doc_id long, variant long, start long, n long, bytes binary")


def _open_windows(docs: DataFrame, found: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(doc_id, variant, start, n): windows of open runs that an earlier document or place has."""

    def sort(batches):
        import pyarrow as pa

        names = ["doc_id", "variant", "start", "n"]

        def close(rows):
            sizes = np.array([len(r[5]) for r in rows])
            n = sizes - length + 1
            row = np.repeat(np.arange(len(rows)), n)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            _, group = np.unique(np.array([r[0] for r in rows]), return_inverse=True)
            hit = repeated_windows(b"".join(r[5] for r in rows), (np.cumsum(sizes) - sizes)[row] + inner, group[row], length)
            # spans of consecutive windows of a run
            at, first, count = _spans(row[hit], inner[hit], np.ones(hit.sum(), np.int64))
            place = np.array([r[1:4] for r in rows], np.int64)[at]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (place[:, 0], place[:, 1], place[:, 2] + first, count)], names)

        held = []
        for b in batches:
            known = b.filter(b.column(5).is_null())
            if len(known):
                yield known.select(names)
            for row in zip(*(c.to_pylist() for c in b.filter(b.column(5).is_valid()).columns), strict=True):
                if held and row[:4] == held[-1][:4]:
                    continue  # a repeated row of a text
                if len(held) >= SORT_ROWS and row[0] != held[-1][0]:
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    rows = _fetched(docs, found.where("open"), length, scratch)
    dealt = rows.repartition(shuffle_partitions(docs.sparkSession), "key").sortWithinPartitions("key", "doc_id", "variant", "start")
    return dealt.mapInArrow(sort, "doc_id long, variant long, start long, n long")


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, variant, spans): (start, n) of windows, n from start, that start earlier too; n = -1 is the whole text."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.save(_sort_runs(_run_rows(docs, length, gram)), "runs")
    opened = scratch.save(_open_windows(docs, found, length, scratch), "open")
    rows = found.where("not open").select("doc_id", "variant", "start", "n").unionByName(opened)
    return rows.groupBy("doc_id", "variant").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def cut_spans(raw: bytes, spans: list[tuple[int, int]], length: int = LENGTH) -> tuple[bytes, int, int]:
    """What is left without the windows' bytes, how many bytes went, and in how many runs."""
    if not spans:
        return raw, 0, 0
    if any(n < 0 for _, n in spans):
        return b"", len(raw), 1
    begin, n = np.array(spans).T
    depth = np.zeros(len(raw) + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, begin + n + length - 1, -1)
    gone = np.cumsum(depth[:-1]) > 0
    return np.frombuffer(raw, np.uint8)[~gone].tobytes(), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): kept is the remaining bytes."""
    small_batches(docs.sparkSession)
    d = docs.where("doc_id is not null").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("variant"), "text")

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for doc_id, text, spans in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode()
                rows.append((doc_id, *(cut_spans(raw, [(s["start"], s["n"]) for s in spans or ()], length)), len(raw)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "kept", "n_removed", "n_spans", "n_bytes"])

    joined = d.join(repeated_spans(d, length), ["doc_id", "variant"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, kept binary, n_removed long, n_spans long, n_bytes long")


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
