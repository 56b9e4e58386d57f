"""Line dedup, native: range-partitioned line hashes, first occurrences streamed in (document, position)
order, and per-document bitmaps of the lines that stay.

A line's key is the line without the six ASCII white-space characters at its ends, with A-Z lower-cased.
A key of at least `min_chars` code points loses all its lines but those of the smallest doc_id that holds it.

Skew: the range key is (hash, salt of the document), so a line that a third of all documents hold is dealt
over as many tasks as there are salts, one for each shuffle partition. Each streams its own first document; only
rows of these firsts, at most one document for each key and salt, meet again by hash alone.

Defined cases: null or empty text is one empty line; short lines always stay; rows without a doc_id are left
out; rows that share a doc_id are one document with several texts: each row has its own result, a line of any of
them counts as the document's, and none of the smallest doc_id's rows loses it; an empty table gives an empty
result; only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, Scratch, ascii_lower, shuffle_partitions

MIN_CHARS = 10


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _variant(text: str) -> Column:
    """Tells the texts of rows apart that share a doc_id; equal texts share their bitmap."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    lines = docs.where("doc_id is not null").select("doc_id", _variant("text").alias("variant"), F.posexplode(_lines("text")).alias("pos", "line"))
    keyed = lines.select("doc_id", "variant", "pos", ascii_lower(F.trim("line", F.lit(ASCII_SPACE))).alias("key"))
    keyed = keyed.where(F.char_length("key") >= min_chars)
    # two hashes with unlike seeds: 128 bits in all
    return keyed.select("doc_id", "variant", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """(doc_id, variant, pos) of each line that an earlier document holds too."""
    spark = docs.sparkSession
    # saved, as the sampling of range bounds would split and hash all texts once more
    occ = Scratch(spark).save(_occurrences(docs, min_chars), "lines")
    occ = occ.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts or shuffle_partitions(spark))).cast("int"))
    ranged = occ.repartitionByRange(shuffle_partitions(spark), "h1", "h2", "salt")
    stream = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, 0)
    ranged = ranged.withColumn("first_doc", F.first("doc_id").over(stream))
    place = ["doc_id", "variant", "pos"]
    later = ranged.where("doc_id > first_doc").select(place)
    firsts = ranged.where("doc_id = first_doc").select("h1", "h2", *place)
    firsts = firsts.withColumn("first_doc", F.min("doc_id").over(Window.partitionBy("h1", "h2")))
    return later.unionByName(firsts.where("doc_id > first_doc").select(place))


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, variant, dropped_words): a sparse bitmap, from word number to 64 bits, of the lines to drop.

    Texts that keep all lines have no row; words without a set bit are left out.
    """
    words = dropped_lines(docs, min_chars).groupBy("doc_id", "variant", F.shiftright("pos", 6).alias("word"))
    bits = words.agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return bits.groupBy("doc_id", "variant").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped_words"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs' rows with kept_text, n_lines and n_dropped, whatever else docs has under other names."""
    maps = bitmaps.select(F.col("doc_id"), F.col("variant").alias("__variant"), F.col("dropped_words").alias("__dropped_words"))
    joined = docs.withColumn("__variant", _variant("text")).join(maps, ["doc_id", "__variant"], "left").withColumn("__lines", _lines("text"))
    kept = F.expr("filter(__lines, (x, i) -> (shiftright(coalesce(__dropped_words[shiftright(i, 6)], 0L), i & 63) & 1L) = 0L)")
    joined = joined.withColumn("__kept", F.when(F.col("__dropped_words").isNull(), F.col("__lines")).otherwise(kept))
    n_dropped = (F.size("__lines") - F.size("__kept")).cast("long")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns], F.array_join("__kept", "\n").alias("__kept_text"),
        F.size("__lines").cast("long").alias("__n_lines"), n_dropped.alias("__n_dropped"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("doc_id is not null")
    out = apply_bitmaps(docs, drop_bitmaps(docs))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents) WHERE doc_id IS NOT NULL),
k AS (
  SELECT doc_id, rid, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (
  SELECT k.doc_id, k.rid, k.pos, k.line, coalesce(k.doc_id > f.first_doc, false) AS dropped
  FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id, rid
"""
