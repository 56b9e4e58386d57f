"""Chat formatting: cumulative snapshots of a conversation collapse to the longest one before rendering.

A logger that writes the whole conversation after each turn leaves conversations that are prefixes of longer
ones. Each turn gets a rolling 128-bit hash of its prefix: the running XOR of hashes of (position, turn).
A conversation whose full hash is the hash of a proper prefix of another goes (anti-join); of equal
conversations the smallest conv_id stays. Only hashes move until the maximal conversations are known.

Defined cases: turns are ordered by turn number (null first), then by hash; identical rows of a turn count
once, turns of one number with different texts all count; a null role is 'user', a null text is empty; rows without
a conv_id are left out; '<|' in a text or role becomes '< |', and a line break in a role a space, so that neither
can forge a turn; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, n, p1, p2): the hash of the first i of n turns."""
    t = _turns(conversations).select("conv_id", "turn", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    t = t.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("conv_id")).cast("int"))
    t = t.withColumn("c1", F.xxhash64("i", "t1", "t2")).withColumn("c2", F.xxhash64(F.lit(1), "i", "t1", "t2"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return t.select("conv_id", "i", "n", F.bit_xor("c1").over(running).alias("p1"), F.bit_xor("c2").over(running).alias("p2"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_logged): conversations that prefix no other; n_logged counts equal ones."""
    p = prefix_hashes(conversations)
    whole = p.where("i = n").groupBy("n", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    proper = p.where("i < n").select(F.col("i").alias("n"), "p1", "p2").distinct()
    return whole.join(proper, ["n", "p1", "p2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_logged")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, rendered): turns in order, each between start and end markers."""
    plain = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    role = F.translate(plain("role"), "\r\n", "  ")
    part = F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), plain("text"), F.lit("<|im_end|>\n"))
    key = F.struct(F.col("turn"), F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "role", "text").alias("t2"), part.alias("part"))
    rows = _turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_set(key)).alias("parts"))
    return rows.select("conv_id", F.array_join("parts.part", "").alias("rendered"))


def format_chats(conversations: DataFrame) -> DataFrame:
    best = maximal(conversations)
    kept = conversations.join(best.select("conv_id"), "conv_id", "left_semi")
    return render(kept).join(best, "conv_id")


def op3_chat_formatting(spark, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return format_chats(c).select("conv_id", "n_turns", "n_logged", "rendered")


ORACLE = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST) AS l FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(l, 1, k) AS l
      FROM (SELECT l, unnest(range(1, len(l))) AS k FROM c)),
m AS (SELECT l, min(conv_id) AS conv_id, count(*)::BIGINT AS n_logged FROM c GROUP BY l)
SELECT conv_id, len(l)::BIGINT AS n_turns, n_logged,
       array_to_string(list_transform(l, lambda x: '<|im_start|>' || translate(replace(x.r, '<|', '< |'), chr(13) || chr(10), '  ') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10)), '') AS rendered
FROM m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = m.l)
"""
