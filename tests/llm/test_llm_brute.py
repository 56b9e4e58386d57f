"""Operators against brute force: edge rows, repeated rows, ties, empty tables, clashing extra columns."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from cohortshift.llm import chat_format, decontaminate, embed_dedup, license_scan, line_dedup, packing, quality, simhash, suffix_dedup, token_files, tokens
from cohortshift.llm.common import Scratch, components

RNG = np.random.default_rng(3)
WORDS = ["alpha", "Beta", "gamma", "delta", "ñandú", "Straße", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu"]
LONG = " ".join(RNG.choice(WORDS, 20_000))
COPY = "A line that many documents hold\nand another of them that is long enough to be seen, more than a hundred bytes in all, surely so."
DOCS = [
    (1, COPY, "x", 1), (2, COPY, None, 2), (3, None, "y", None), (4, "", "y", 0), (5, LONG, "z", 5), (6, LONG + " tail", "z", 5), (7, "  \n\n\t", None, 1),
    (8, "a line that MANY documents hold  \nown text", "q", 3), (9, "one", "q", 3), (10, "one two", "q", 3), (11, "ÉCOLE élan ÉCOLE\nÉCOLE élan ÉCOLE", "q", 3), (12, COPY, "x", 1), (12, COPY, "x", 1), (None, COPY, "x", 1),
]
#: Names that the operators use inside, with values of any type.
CLASH = ["pos", "h1", "salt", "fp", "cell", "words", "start", "n", "line", "x", "uid", "ids", "rank", "spans", "score", "label", "term", "__kept", "anchor", "kind", "open", "root"]


def table(spark, rows=DOCS):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").repartition(3)
    return df.withColumns({c: F.lit(f"extra {c}") for c in CLASH})


def texts(rows=DOCS):
    return [(d, t) for d, t, *_ in rows if d is not None]


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (501, 502), (7, 7), (500, 502)] + [(1000, 1000 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[500], got[501], got[502]}) == 1 and len(set(got.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def test_line_dedup(spark):
    got = line_dedup.apply_bitmaps(table(spark).where("doc_id is not null"), line_dedup.drop_bitmaps(table(spark)))
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d, t in texts():
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), d), d)
    want = sorted((d, "\n".join(x for x in (t or "").split("\n") if len(key(x)) < 10 or first[key(x)] == d)) for d, t in texts())
    assert sorted((r["doc_id"], r["__kept_text"]) for r in got.collect()) == want
    assert line_dedup.drop_bitmaps(table(spark, [])).count() == 0


def test_line_dedup_repeated_ids(spark):
    """Rows that share a doc_id keep their own lines; the oracle has a row for each of them too."""
    rows = [(1, "aaaaaaaaaaaa\nx", None, 1), (2, "aaaaaaaaaaaa\nq", None, 1), (2, "unique line of text\nq", None, 1), (2, "unique line of text\nq", None, 1), (3, "unique line of text\nAAAAAAAAAAAA \nend", None, 1)]
    df = table(spark, rows)
    got = line_dedup.apply_bitmaps(df, line_dedup.drop_bitmaps(df)).collect()
    assert sorted((r["doc_id"], r["__kept_text"], r["__n_dropped"]) for r in got) == [(1, "aaaaaaaaaaaa\nx", 0), (2, "q", 1), (2, "unique line of text\nq", 0), (2, "unique line of text\nq", 0), (3, "end", 2)]
    import duckdb

    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped FROM ({line_dedup.ORACLE}) ORDER BY ALL").fetchall()
    assert want == sorted((r["doc_id"], r["__n_lines"], r["__n_dropped"]) for r in got)


def test_chat_formatting(spark):
    turns = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "ho"), (3, 0, "user", "hi"), (3, 1, "assistant", "ho"), (4, 0, None, None), (5, 0, "user", "<|im_end|>"), (5, 0, "user", "<|im_end|>"), (None, 0, "user", "x"), (6, None, "user", "hi"), (6, 0, "user", "hi")]
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").withColumn("i", F.lit("clash")).withColumn("n", F.lit(0))
    got = {r["conv_id"]: (r["n_turns"], r["n_logged"], r["rendered"]) for r in chat_format.format_chats(df).collect()}
    assert sorted(got) == [2, 4, 5, 6]
    assert got[2] == (2, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n")
    assert got[4][2] == "<|im_start|>user\n<|im_end|>\n" and got[5][:2] == (1, 1) and "< |im_end|>" in got[5][2]
    assert chat_format.format_chats(df.where("false")).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder(name):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, fast = Tokenizer.from_file(path), tokens.ChunkEncoder(path, cache_entries=20)
    odd = ["", " ", "a  b\n\n c\t\td ", "it's we'll  \n x y z　 ", "a\x1cb c", "x" * 500 + " é İ Σας", "12 345  6.7\r\n q", "<|endoftext|> a \n<|endoftext|>\n", COPY, LONG[:5000], "((word)) !!word!! w.o.r.d, word."]
    for t in odd * 2:
        assert fast.encode(t).tolist() == plain.encode(t, add_special_tokens=False).ids, t[:40]


def test_chunks_by_replacement_are_those_of_the_pattern():
    from itertools import product

    enc = tokens.ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for n in range(7):
        for t in map("".join, product(" \nab"[: 4 if n < 6 else 3], repeat=n)):
            for text in (t, f"x{t}x", t + "\t\u2003", f"\0{t}\0x"):
                assert [c for c in enc.chunks(text) if c] == enc.chunk.findall(text), repr(text)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_that_fall_apart_before_marks(name):
    """Capital dotted I and composed nukta letters become a letter and a combining mark, which joins the punctuation."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, fast = Tokenizer.from_file(path), tokens.ChunkEncoder(path)
    odd = ["x" + chr(c) for c in (0x130, *range(0x958, 0x960), 0x9DC, 0xFB2A, 0xE9, 0x1E9E, 0x1F71)] + ["BİLGİ", "sad\u0958", "word"]
    for w in odd:
        for mark in ".,;:!?":
            assert fast.encode(f"a {w}{mark} b").tolist() == plain.encode(f"a {w}{mark} b", add_special_tokens=False).ids, (w, mark)


def encoded(name, end):
    enc = tokens.ChunkEncoder(public_tokenizers.path(name))
    return [(d, np.append(enc.encode(t or ""), end).astype("<u4")) for d, t in texts()]


def test_packing(spark):
    got = packing.pack_documents(table(spark), public_tokenizers.path("word_bpe_49k.json"), 1, keep_ids=True).toPandas()
    by_doc = {}
    for d, ids in encoded("word_bpe_49k.json", 1):
        by_doc.setdefault(d, []).append(ids)
    assert sorted(by_doc) == sorted(set(got["doc_id"])) and got["length"].sum() == sum(len(i) for v in by_doc.values() for i in v)
    for d, rows in got.groupby("doc_id"):
        own = by_doc[d][0]
        assert rows["length"].sum() == len(own) * len(by_doc[d])
        for r in rows.itertuples():
            assert r.ids == own[r.start : r.start + r.length].tobytes() and r.ids_crc32 == zlib.crc32(r.ids) and r.doc_tokens == len(own)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]] and s["length"].sum() <= packing.CAPACITY
    fills = got.groupby("sequence_id")["length"].sum()
    assert (fills < packing.CAPACITY).sum() <= 1
    assert packing.pack_documents(table(spark, []), public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def test_best_fill_is_a_subset_sum():
    for _ in range(30):
        items = RNG.integers(1, 40, 9).tolist()
        room = int(RNG.integers(1, 90))
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        fill = packing.best_fill({x: items.count(x) for x in items}, room)
        assert sum(x * k for x, k in fill.items()) == max(s for s in sums if s <= room)
        assert all(k <= items.count(x) for x, k in fill.items())


def test_plan_places_every_token_once():
    placed, n = packing.plan({1500: 40, 7: 3, 2047: 5, 1: 2}, 2048)
    fill = np.zeros(n, int)
    for rest, rows in placed.items():
        for lo, hi, _, length, seq, _ in rows:
            fill[seq : seq + hi - lo] += length
        for rank in {r for lo, hi, *_ in rows for r in (lo, hi - 1)}:
            assert sum(length for lo, hi, _, length, *_ in rows if lo <= rank < hi) == rest
    assert (fill[:-1] == 2048).all()


def test_simhash(spark):
    near = [(100 + i, " ".join(np.where(RNG.random(300) < 0.003, "changed", RNG.permutation(WORDS)[0]).tolist()) if i % 7 == 0 else LONG[: 4000 + i % 2], None, None) for i in range(60)]
    rows = DOCS + near
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = {}
    for d, t in texts(rows):
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t or "")) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints and len(got) == len(texts(rows))
    root = {d: d for d in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    assert {r["doc_id"]: r["component_id"] for r in got} == root
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_dense_cells(spark):
    """Fingerprints in a ball: a crowded cell spans Arrow batches, and the components stay those of all pairs."""
    base = int(RNG.integers(1 << 62))
    fps = sorted({base ^ sum(1 << int(b) for b in RNG.integers(0, 40, RNG.integers(0, 9))) for _ in range(300)})
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for rows in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        scratch = Scratch(spark)
        roots = {r["node"] % (1 << 64): r["root"] for r in components(simhash.fingerprint_links(df, scratch), scratch).collect()}
        x = np.array(fps, np.uint64)
        near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 3
        reach = near.copy()
        for _ in range(12):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        for i in range(0, len(fps), 7):
            same = {fps[j] for j in np.flatnonzero(reach[i])}
            assert same == ({f for f in fps if roots.get(f) == roots.get(fps[i])} if fps[i] in roots else {fps[i]})


def test_token_files(spark):
    scratch = Scratch(spark)
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = scratch.path("tok")
    files = token_files.write_token_files(table(spark), out, scratch, path, 0, file_bytes=3000)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.read_token_files(spark, out, files).collect())
    at, want = 0, []
    for d, ids in sorted(encoded("byte_bpe_50k.json", 0), key=lambda x: x[0]):
        want.append((at, d, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want and files.count() > 2
    assert token_files.write_token_files(table(spark, []), scratch.path("none"), scratch, path, 0).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = RNG.integers(0, 1 << bits, 10_001, dtype=np.uint64).astype("<u4")
    data = token_files.to_bytes([5, 9], [4000, 6001], ids, bits, block=1024)
    f = token_files.TokenFile(data)
    assert (f.ids(0, len(ids)) == ids).all() and (f.document(1) == ids[4000:]).all() and (f.ids(1000, 100) == ids[1000:1100]).all()
    assert len(token_files.pack(ids, bits)) == -(-len(ids) * bits // 8)


def test_machine_matches_pairwise_sum():
    n = quality.BUCKETS + quality.STATS
    m = quality.Machine(0.1, RNG.normal(size=n), RNG.normal(size=(n, 3)) / 3, np.zeros(quality.STATS), np.ones(quality.STATS))
    f = quality.Features()("Some text, of words. Some more!\nline")
    i, x = m.join(*f)
    y = 0.1 + m.w[i] @ x + sum((m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(len(i)) for b in range(a + 1, len(i)))
    assert m.score(*f) == pytest.approx(1 / (1 + np.exp(-y)))


def test_quality_held_out_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score_documents(docs, quality.train(docs, labels)).where(quality.held_out()).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["quality"] == 1)).mean() > 0.93
    assert (got.loc[got["quality"] == 1, "score"] >= 0.5).mean() > 0.97
    edge = table(spark)
    empty = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    scores = quality.score_documents(edge, quality.train(edge, empty)).collect()
    assert len(scores) == len(texts()) and {r["score"] for r in scores} == {1.0}
    two = spark.createDataFrame([(d, int(d < 6)) for d, _ in texts()], "doc_id long, quality int")
    assert all(0 <= r["score"] <= 1 for r in quality.score_documents(edge, quality.train(edge, two)).collect())
    assert quality.score_documents(table(spark, []), 1.0).count() == 0


def test_license_scan(spark):
    rows = [(1, "Intro\nReleased under the  MIT license!\n", None, None), (2, license_scan.TEMPLATES["gpl-3.0"], None, None), (3, None, None, None), (4, "", None, None), (5, LONG, None, None), (6, "MIT", None, None)]
    got = sorted((r["doc_id"], r["line_no"], r["license"], r["dice"]) for r in license_scan.scan(table(spark, rows)).collect())
    assert got == [(1, -1, "mit", 0.888888889), (1, 1, "mit", 1.0), (2, 0, "gpl-3.0", 1.0)]
    assert license_scan.scan(table(spark, [])).count() == 0


MIT_FILE = """MIT License

Copyright (c) 2020 Example Ltd.

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE_HEADER = """// Copyright 2020 Example Ltd.
//
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
//
int main() { return the_answer(); }
"""


def test_license_scan_passages(spark):
    """Wrapped, embedded and full-file notices, against all runs of words by brute force."""
    gpl = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\nimport os\n" + LONG[:2000]
    cc = license_scan.TEMPLATES["cc-by-4.0"]
    rows = [(1, MIT_FILE, None, None), (2, "Copyright 2020 Example Ltd. Released under the MIT License.", None, None), (3, APACHE_HEADER + LONG[:2000], None, None), (4, LONG + "\n" + gpl, None, None), (5, f"alpha beta gamma delta epsilon zeta eta theta {cc} and words after it that go on and on", None, None), (6, "x y z\n" * 30 + "Released\nunder the MIT\nLicense.\n" + LONG[:300] + " Released under the MIT License or not", None, None), (7, "permission license software conditions " * 50, None, None)]
    got = {}
    for r in license_scan.scan(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["line_no"], r["license"], r["dice"]))
    assert {k: {x[:2] for x in v} for k, v in got.items()} == {1: {(4, "mit-grant")}, 2: {(0, "mit")}, 3: {(2, "apache-2.0"), (2, "apache-2.0-header")}, 4: {(1, "gpl-3.0-header")}, 5: {(0, "cc-by-4.0")}, 6: {(30, "mit"), (33, "mit")}}
    known = {k: set(license_scan.template_bigrams(v)) for k, v in license_scan.TEMPLATES.items()}
    for d, text in texts(rows):
        w = re.findall(r"[^\W_]+", text.lower())
        pairs = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        for name, grams in known.items():
            starts = [i for i, g in enumerate(pairs) if g in grams]
            best = max((2 * len(set(pairs[i:j]) & grams) / (len(set(pairs[i:j])) + len(grams)) for i in starts for j in range(i + 1, min(len(pairs), i + 80) + 1)), default=0)
            own = [x[2] for x in got.get(d, ()) if x[1] == name]
            assert not own or max(own) == pytest.approx(best, abs=1e-9) or name == "apache-2.0", (d, name)
            assert best < 0.8 or got.get(d), (d, name)


def test_decontamination(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    items = [(1, item), (2, "tiny Item"), (3, None), (4, "..."), (5, item), (None, "tiny item")]
    rows = [(1, "x " + item.upper() + " y", None, None), (2, "a tiny, item! " + "z " * 100, None, None), (3, " ".join(f"w{i}" for i in range(12)), None, None), (4, None, None, None), (5, item + " and " + item, None, None), (6, LONG + " tiny item", None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for limit, share in ((broadcast, 1000), ("-1", 1000), ("-1", 3)):  # the last makes terms hot
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        monkeypatch.setattr(decontaminate, "HOT_SHARE", share)
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.contamination(table(spark, rows), bench).collect()}
        assert got == {1: (22, 20, ["1", "5"], True), 2: (103, 2, ["2"], False), 3: (12, 0, [], False), 4: (0, 0, [], False), 5: (41, 40, ["1", "5"], True), 6: (20002, 2, ["2"], False)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    twice = decontaminate.contamination(table(spark, rows[:1] * 2 + [(1, "clean", None, None)]), bench).collect()
    assert sorted((r["doc_id"], r["n_hit"]) for r in twice) == [(1, 0), (1, 20), (1, 20)]
    assert not any(r["contaminated"] for r in decontaminate.contamination(table(spark, rows), bench.where("false")).collect())
    assert decontaminate.contamination(table(spark, []), bench).count() == 0
    near = decontaminate.proximity_matches(table(spark, [(1, "item of a tiny kind", None, None), (2, "tiny " + "q " * 50 + "item", None, None)]), bench.where("item_id = 2"), terms=2, within=10).collect()
    assert [(r["doc_id"], r["item_id"], r["at"]) for r in near] == [(1, 2, 3)]


def test_suffix_dedup(spark, monkeypatch):
    base = [bytes(RNG.integers(97, 100, RNG.integers(0, 700)).astype(np.uint8)).decode() for _ in range(20)]
    made = [(50 + i, base[RNG.integers(20)] + base[RNG.integers(20)] + "ab" * int(RNG.integers(200)) * (i % 3), None, None) for i in range(60)]
    rows = [r for r in DOCS if r[0] != 12] + [(12, COPY, None, None), (13, "é" * 300, None, None)] + made
    seen, want = set(), {}
    for d, t in sorted(texts(rows)):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = True
            else:
                seen.add(raw[i : i + 100])
        edge = np.concatenate([[False], gone])
        want[d] = (len(raw), gone.sum(), (edge[1:] & ~edge[:-1]).sum(), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    for hot in (suffix_dedup.HOT, 1):  # the second deals the windows of every anchor that several runs have
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
        assert got == want
    twice = {r["n_removed"] for r in suffix_dedup.remove_repeats(table(spark, [DOCS[4]] * 2)).collect()}
    assert len(twice) == 1  # repeated rows of a doc_id fare alike
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def test_suffix_dedup_repeated_ids(spark):
    """Rows that share a doc_id are texts of their own: every string of the corpus stays once, and equal rows fare alike."""
    a, b, c = ("".join(RNG.choice(list("abcdefgh"), 300)) for _ in range(3))
    rows = [(1, a, None, 1), (2, a + b, None, 1), (2, c + "other", None, 1), (2, c + "other", None, 1), (3, c, None, 1), (3, b + "end", None, 1)]
    got = sorted((r["doc_id"], bytes(r["kept"]).decode()) for r in suffix_dedup.remove_repeats(table(spark, rows)).collect())
    assert got == sorted([(1, a), (2, b), (2, c + "other"), (2, c + "other"), (3, ""), (3, "end")])


def test_repeated_windows_and_tries():
    text = bytes(RNG.integers(97, 99, 3000).astype(np.uint8)) + b"q" * 400
    places = np.arange(len(text) - 40 + 1)
    hit = suffix_dedup.repeated_windows(text, places, np.zeros(len(places), int), 40)
    seen = set()
    for p in places.tolist():
        w = text[p : p + 40]
        assert hit[p] == (w in seen)
        seen.add(w)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumns({c: F.lit("extra") for c in ("x", "cell", "ball", "n", "label")})


def test_embedding_dedup(spark):
    centre = RNG.normal(size=(40, 16))
    x = np.concatenate([RNG.normal(size=(300, 16)), centre[:3].repeat(60, 0) + 0.12 * RNG.normal(size=(180, 16)), centre[3:4].repeat(50, 0)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, 2.0]), (904, [None, *[1.0] * 15]), (905, [float("inf")] * 16), (None, [1.0] * 16)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(vectors(spark, rows + bad + rows[:5])).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    reach = near.copy()
    for _ in range(9):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = near.sum(1) - 1
    found = np.array([got[i][0] for i in range(len(x))])
    assert (found <= want).all() and found.sum() >= 0.9 * want.sum()
    assert np.mean([got[i][1] == np.flatnonzero(reach[i]).min() for i in range(len(x))]) > 0.97
    assert all(got[i] == (0, i, True) for i in range(900, 906)) and None not in got and len(got) == len(x) + 6
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in embed_dedup.near_duplicates(vectors(spark, bad[:2])).orderBy("vec_id").collect()] == [(900, 0, 900, True), (901, 0, 901, True)]


def test_multi_sequence_order():
    d1, d2 = RNG.random(12), RNG.random(12)
    order = [d1[i] + d2[j] for i, j in embed_dedup.multi_sequence(d1, d2)]
    assert order == sorted(order) and len(order) == 144
    idx = embed_dedup.MultiIndex(RNG.normal(size=(400, 8)) / 3, 4000)
    x = RNG.normal(size=(5, 8))
    for row, cells in zip(zip(*idx.distances(x), strict=True), idx.visited(x, 30), strict=True):
        own = [i * idx.words + j for (i, j), _ in zip(embed_dedup.multi_sequence(*row), range(30), strict=False)]
        assert sorted(own) == sorted(cells.tolist())




def test_embedding_recall_at_the_threshold(spark):
    """12,000 vectors of 64 dimensions, half of them in pairs just above the threshold, and exact copies."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cos = rng.uniform(0.9505, 0.956, (6000, 1))
    v = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * z, x[:1].repeat(3000, 0)]).astype(np.float32)
    got = embed_dedup.near_duplicates(vectors(spark, [(i, r.tolist()) for i, r in enumerate(v)])).toPandas().set_index("vec_id")
    u = v.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    found = got["n_links"].loc[range(len(v))].to_numpy()
    assert (found <= want).all()
    # copies of vector 0 count each other and its neighbour exactly
    assert (found[12000:] >= 3000).all() and found[0] >= 3000
    assert found[1:6000].sum() / want[1:6000].sum() >= 0.95
    print("recall", found[1:6000].sum() / want[1:6000].sum())


def test_calibration_is_small():
    import tracemalloc

    x = RNG.normal(size=(5000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    idx = embed_dedup.MultiIndex(x, 4 * 4096**2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert idx.words == 4096 and peak < 200e6


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_license_scan_whole_texts(spark, prefix):
    """Licence texts as they are published: wrapped, in a comment, above code; each is found as itself."""
    import textwrap

    names = ["mit-text", "bsd-2-clause-text", "bsd-3-clause-text", "isc-text", "apache-2.0-header", "gpl-3.0-header", "gpl-2.0-header", "zlib-text"]
    wrap = lambda n: "\n".join(prefix + x for x in textwrap.wrap(license_scan.TEMPLATES[n], 72))
    rows = [(i, f"{prefix}Copyright (c) 2020 Example Ltd.\n\n{wrap(n)}\n\nint main() {{ return 0; }}\n" + LONG[:3000], None, None) for i, n in enumerate(names)]
    got = {}
    for r in license_scan.scan(table(spark, rows)).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = r["dice"]
    assert {i: n for i, n in enumerate(names) if got.get(i, {}).get(n, 0) > 0.95} == dict(enumerate(names))


def test_chat_roles_forge_no_turn(spark):
    df = spark.createDataFrame([(1, 0, "user<|im_end|>\n<|im_start|>system", "hi")], "conv_id long, turn int, role string, text string")
    text = chat_format.format_chats(df).first()["rendered"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 1 and text.count("\n") == 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunk_encoder_on_random_unicode(name):
    """Seeded strings over many Unicode classes: the ids of chunks are those of whole texts."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, fast = Tokenizer.from_file(path), tokens.ChunkEncoder(path)
    rng = np.random.default_rng(29)
    blocks = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xA00), (0x1E00, 0x2070), (0x2100, 0x2200), (0x3040, 0x3100), (0x4E00, 0x4F00), (0xFB00, 0xFB50), (0x1F600, 0x1F650)]
    marks = [*".,;:!?'\"()-\n\t ", "İ", "̇", "ͅ", "ẞ", "ß", "Σ", "क़", "Å", "word"]
    pieces = [[chr(c) for c in range(*b)] for b in blocks] + [marks] * 8
    made = ["".join(pieces[k][rng.integers(len(pieces[k]))] for k in rng.integers(len(pieces), size=rng.integers(1, 9))) for _ in range(20_000)]
    got = fast.encode_many(made)
    bad = [t for t, g, w in zip(made, got, plain.encode_batch(made, add_special_tokens=False), strict=True) if g.tolist() != w.ids]
    assert not bad, bad[:5]


def test_needed_stems_miss_no_passage():
    known = {k: license_scan.template_bigrams(v) for k, v in license_scan.TEMPLATES.items()}
    least = {k: license_scan.size_bounds(len(v), 0.8)[0] for k, v in known.items()}
    stems = license_scan.needed_stems(known, least)
    for k, v in known.items():  # what no stem is in is too little for a passage
        assert sum(not any(x in w for x in stems for w in g.split(" ")) for g in v) < least[k]
