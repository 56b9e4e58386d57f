"""File sources and sinks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@cache
def _local_dir() -> str:
    """A folder of this process that goes with it; for local masters only."""
    path = tempfile.mkdtemp(prefix="cohortshift-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = f"file://{_local_dir()}"
    return f"{root.rstrip('/')}/files-{uuid.uuid4().hex}/{name}"


def list_files(spark: SparkSession, folder: str, suffix: str = ".parquet") -> DataFrame:
    """(file, n_bytes), largest first, of a folder in any store that Spark reads."""
    blobs = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(folder)
    return blobs.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("n_bytes")).orderBy(F.desc("n_bytes"), "file")


def write_csv(df: DataFrame) -> str:
    df.write.option("header", True).csv(path := shared_path(df.sparkSession, "csv"))
    return path


def write_json(df: DataFrame) -> str:
    df.write.json(path := shared_path(df.sparkSession, "json"))
    return path


def write_text(df: DataFrame) -> str:
    df.write.text(path := shared_path(df.sparkSession, "text"))
    return path


def write_parquet(df: DataFrame, *by: str) -> str:
    df.write.option("compression", "snappy").partitionBy(*by).parquet(path := shared_path(df.sparkSession, "parquet"))
    return path


def saved(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read from there: later steps neither repeat it nor lose it with an executor."""
    df.write.parquet(path := shared_path(df.sparkSession, "saved"))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table from saved, which nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def header_groups(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(header, n_files): a header that only some files have shows as a group of its own."""
    lines = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    first = lines.where("file_block_start = 0").groupBy("file_path").agg(F.min_by("value", "at").alias("header"))
    return first.groupBy("header").agg(F.count("*").alias("n_files"))


def read_artifact(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON artifact; an empty table if it is absent."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def parse_report(spark: SparkSession, path: str) -> DataFrame:
    """(item, n) of lines 'item: n'."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\w+: \d+$"))
    return lines.select(F.regexp_extract("value", r"^(\w+):", 1).alias("item"), F.regexp_extract("value", r"(\d+)$", 1).cast("long").alias("n"))


def stack_shards(shards: list[DataFrame]) -> DataFrame:
    """Union by name; a column missing from a shard is null, and types widen to a common one."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Fields of structs as columns of their own."""
    cols = [F.col(f"{f.name}.{g.name}").alias(f"{f.name}_{g.name}") if isinstance(f.dataType, StructType) else F.col(f.name) for f in df.schema for g in (f.dataType if isinstance(f.dataType, StructType) else [f])]
    return df.select(*cols)
