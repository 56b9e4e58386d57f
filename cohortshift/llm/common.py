"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"
#: Rows and bytes in an Arrow batch; one row may hold more bytes.
BATCH_ROWS, BATCH_BYTES = 1000, 64 << 20


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, UPPER, UPPER.lower())


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of whole texts small enough for a Python worker; the session keeps these settings."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; only local runs without one get their own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        path = f"file://{_local_dir()}"
    return path.rstrip("/")


@cache
def _local_dir() -> str:
    """A folder of this process that goes with it; for local masters only."""
    path = tempfile.mkdtemp(prefix="cohortshift-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Folders of this process that are not deleted yet, oldest first.
_folders: list[str] = []


def clean_up(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch folders made since then; for results that have been written elsewhere."""
    while len(_folders) > since:
        _delete(spark, _folders.pop())


def scratch_folders() -> int:
    """How many there are: what clean_up() takes to leave those alone."""
    return len(_folders)


class Scratch:
    """Tables in the shared folder that cut lineage; they survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0
        _folders.append(self.root)

    def path(self, name: str = "t") -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing reads any more."""
        _delete(self.spark, df.scratch_path)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): one row (node, root) for each node that has an edge to another.

    Randomised contraction: each round maps a node to the neighbour with the smallest hash if that is
    under its own, rewrites the edges to the images and drops loops and repeats. Rounds grow with the
    logarithm of the nodes; each is two shuffles of what is left, written to the shared folder.
    """
    rank = lambda c: F.xxhash64(F.col(c))
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        step = best.select(F.col("a").alias("node"), F.when(F.struct(F.col("m.h"), F.col("m.v")) < F.struct(rank("a").alias("h"), F.col("a").alias("v")), F.col("m.v")).otherwise(F.col("a")).alias("image"))
        step = scratch.save(step, "step")
        maps.append(step)
        left = step.select(F.col("node").alias("a"), F.col("image").alias("ia"))
        right = step.select(F.col("node").alias("b"), F.col("image").alias("ib"))
        images = e.join(left, "a").join(right, "b").where("ia <> ib")
        fresh = scratch.save(images.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")).distinct(), "edges")
        scratch.drop(e)
        e = fresh
    if not maps:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[-1].select("node", F.col("image").alias("root"))
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("image"), "root")
        out = step.join(later, "image", "left").select("node", F.coalesce("root", "image").alias("root"))
    return out


def salted_rank(df: DataFrame, keys: list[str], order: list[str], name: str, salts: int) -> DataFrame:
    """A dense number from 0 within each key, without all rows of a key in one task.

    Rows are numbered within (key, salt); the counts of the salts, at most `salts` rows a key, give the offsets.
    """
    s, n = f"{name}__salt", f"{name}__n"
    df = df.withColumn(s, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    local = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys, s).orderBy(*order)).cast("long") - 1)
    sizes = df.groupBy(*keys, s).agg(F.count("*").alias(n))
    before = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn(n, F.coalesce(F.sum(n).over(before), F.lit(0)))
    return local.join(offsets, [*keys, s]).withColumn(name, F.col(name) + F.col(n)).drop(s, n)
