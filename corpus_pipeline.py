"""Training-data pipeline over documents; counted as part of subpackage llm.

Stages: quality classifier (rejected documents go), line dedup, SimHash near-dedup (the smallest doc_id of each
group stays), benchmark decontamination (contaminated documents go), packing. Each stage is written as Parquet in
the shared folder and read again as the next one's docs; all but the last return the columns of documents.

Rows without a doc_id can't be named in a decision and end at the first stage. Line dedup also sets n_chars,
where there is one, to the length of the new text; null texts are empty after it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortshift.llm import decontaminate, line_dedup, packing, quality, simhash
from cohortshift.llm.common import Scratch, clean_up, scratch_folders


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scores = quality.score_documents(docs, quality.train(docs, labels))
    return docs.join(scores.where("score >= 0.5").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.apply_bitmaps(docs, line_dedup.drop_bitmaps(docs.select("doc_id", "text")))
    kept = F.col("__kept_text")
    new = {"text": kept, "n_chars": F.char_length(kept).cast("long")}
    return out.select([new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = simhash.near_duplicates(docs.select("doc_id", "text"))
    return docs.join(classes.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = decontaminate.contamination(docs.select("doc_id", "text"), benchmark)
    return docs.join(found.where("contaminated").select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        own = scratch_folders()
        out = scratch.save(stage(spark, docs, sf_dir), "stage")
        # a stage's own tables and its input are not read any more
        clean_up(spark, own)
        if i:
            scratch.drop(docs)
        docs = out
    return docs


#: A classifier, components of near duplicates and a tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None
