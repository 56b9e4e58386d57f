"""Cleaning: column names, labels, row quality, dedup and family floors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, FAMILIES, IDENTIFIERS_ML, RAW_LABELS


def normalise_columns(df: DataFrame, drop: tuple[str, ...] = ("attempted category",)) -> DataFrame:
    """Strips column names and drops the named ones, in any case."""
    df = df.toDF(*(c.strip() for c in df.columns))
    return df.drop(*(c for c in df.columns if c.lower() in drop))


def relabel_attempted(label: Column) -> Column:
    """A trimmed label that ends in '- attempted' is benign; a null label is the string nan."""
    trimmed = F.trim(F.coalesce(label, F.lit("nan")))
    return F.when(F.lower(trimmed).endswith("- attempted"), "Benign").otherwise(trimmed)


def standard_label(label: Column) -> Column:
    return F.when(F.lower(F.trim(label)) == "benign", "Benign").otherwise(F.trim(label))


def family(label: Column) -> Column:
    """The family of a raw label: known labels first, then patterns in order; null if there is none."""
    low = F.lower(F.trim(label))
    known = F.create_map(*(F.lit(x) for fam, raws in RAW_LABELS.items() for raw in raws for x in (raw, fam)))
    has = lambda *parts: reduce(lambda a, b: a | b, (low.contains(p) for p in parts))
    pattern = (
        F.when(has("infiltration"), "Infiltration").when(has("portscan", "port scan"), "PortScan")
        .when(low.startswith("ddos") | low.startswith("dddos"), "DDoS").when(low.startswith("dos"), "DoS")
        .when(has("web attack"), "WebAttack").when(has("brute force", "bruteforce", "patator") & has("web", "xss", "sql"), "WebAttack")
        .when(has("brute force", "bruteforce", "patator"), "BruteForce").when(has("botnet") | (low == "bot"), "Botnet")
    )
    return F.coalesce(F.try_element_at(known, low), pattern)


def is_missing(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) for c in columns))


def is_infinite(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(F.abs(F.col(c)) == F.lit(float("inf")), F.lit(False)) for c in columns))


def quality_flag(columns: list[str]) -> Column:
    nan, inf = is_missing(columns), is_infinite(columns)
    return F.when(nan & inf, "both").when(nan, "nan_only").when(inf, "inf_only").otherwise("clean")


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != F.lit(float("inf")))


def clean(df: DataFrame, numeric: list[str], label: str = "label") -> DataFrame:
    """Relabelled rows without missing or infinite values."""
    return df.withColumn(label, relabel_attempted(F.col(label))).where(~is_missing(numeric) & ~is_infinite(numeric))


def dedup_first(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """The first row, in the given order, of rows that agree on the columns."""
    first = Window.partitionBy(*columns).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def row_hash(df: DataFrame, columns: list[str], name: str = "row_hash") -> DataFrame:
    return df.withColumn(name, F.xxhash64(*columns))


def with_family(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with their family; rows without one go."""
    return df.withColumn("family", family(F.col(label))).where("family is not null")


def family_floor(df: DataFrame, least: int = CONFIG.min_family_rows, by: str = "family") -> DataFrame:
    """Rows of families with at least so many rows; at most one count for each family is joined."""
    kept = df.groupBy(by).count().where(F.col("count") >= least).select(by)
    return df.join(kept, by, "left_semi")


def encode(df: DataFrame, by: str = "family") -> DataFrame:
    """Binary and multiclass codes; an unknown family is an error."""
    codes = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    code = F.coalesce(F.try_element_at(codes, F.col(by)), F.raise_error(F.concat(F.lit("unknown family "), F.col(by))).cast("int"))
    return df.withColumn("label_multiclass", code.cast("int")).withColumn("label_binary", (F.col("label_multiclass") > 0).cast("int"))


def assert_finite(df: DataFrame, columns: list[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, (~finite(c) for c in columns))
    return df.withColumn(columns[0], F.when(bad, F.raise_error(F.lit("non-finite value")).cast("double")).otherwise(F.col(columns[0])))


def ml_features(columns: list[str], drops: list[str], log=print) -> list[str]:
    """Columns without identifiers, label and dropped ones; warns of unknown drops."""
    for d in sorted(set(drops) - set(columns)):
        log(f"unknown drop: {d}")
    return [c for c in columns if c.lower() not in IDENTIFIERS_ML and c not in drops]
