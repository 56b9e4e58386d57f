"""The pipeline against its operators applied in memory."""

import re
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import xxhash
from pyspark.sql import functions as F

from cohortshift.llm import decontaminate, line_dedup, packing, quality, simhash

SF = "/root/testdata/sf0.01"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = P.quality_stage(spark, docs, SF)
    good = {r["doc_id"] for r in quality.score_documents(docs, quality.train(docs, labels)).where("score >= 0.5").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == good
    lines = P.line_stage(spark, kept, SF)
    want = {r["doc_id"]: r["__kept_text"] for r in line_dedup.apply_bitmaps(kept, line_dedup.drop_bitmaps(kept)).collect()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in lines.collect()} == {d: (t, len(t)) for d, t in want.items()} and lines.columns == docs.columns
    single = P.near_duplicate_stage(spark, lines, SF)
    ids = {r["component_id"] for r in simhash.near_duplicates(lines).collect()}
    assert {r["doc_id"] for r in single.collect()} == ids
    clean = P.decontamination_stage(spark, single, SF)
    bad = {r["doc_id"] for r in decontaminate.contamination(single, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == ids - bad and bad


def test_run(spark):
    out = P.run(spark, SF)
    assert [n for n, _ in P.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    fill = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where(f"n > {packing.CAPACITY}").isEmpty() and fill.where(f"n < {packing.CAPACITY}").count() <= 1


def test_extra_columns_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({c: F.lit("x") for c in ("score", "pos", "fp", "words", "n")})
    odd = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes if c != "doc_id"])
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs.unionByName(odd), SF).columns == docs.columns
        assert stage(spark, docs.where("false"), SF).count() == 0


def lower(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def brute_force(spark, sf):
    """doc_id and text of what reaches packing, in plain Python; of the operators only the trained weights."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    texts = {}
    for d, (t, n) in rows.items():
        i, x = model.join(*quality.Features()(t, n))
        pairs = ((model.v[i] @ model.v[i].T) * np.outer(x, x))[np.triu_indices(len(i), 1)].sum()
        if model.w0 + model.w[i] @ x + pairs >= 0:
            texts[d] = t or ""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for d in sorted(texts):
        for line in texts[d].split("\n"):
            first.setdefault(key(line), d)
    texts = {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == d) for d, t in texts.items()}
    prints = {}
    for d, t in texts.items():
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower(t)) if x]
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        prints[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    groups = []
    for d in sorted(prints):
        near = [g for g in groups if any((prints[d] ^ prints[o]).bit_count() <= 3 for o in g)]
        groups = [g for g in groups if g not in near] + [sum(near, []) + [d]]
    texts = {min(g): texts[min(g)] for g in groups}
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or "")) if w]
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = {}
    for d, t in texts.items():
        w = words(t)
        hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean[d] = t
    return clean


def test_run_against_brute_force(spark):
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    want, tokenizer = brute_force(spark, sf), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = P.run(spark, sf).toPandas()
    assert set(got["doc_id"]) == set(want) and 0 < len(want) < 200
    for d, rows in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(want[d], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in rows.sort_values("start").itertuples():
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes()) and r.doc_tokens == len(ids)
            at += r.length
        assert at == len(ids)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum()[:-1]]
