"""Queries: streaming extras, which no reference operator needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.files import shared_path
from ..sources.views import SCORED, cte
from ..streaming.scoring import score_batches
from .registry import query


@query("STR-01", f"WITH {cte('scored')} SELECT cohort, truth, pred, count(*) AS n FROM scored GROUP BY 1, 2, 3")
def str_01(spark, d):
    """Predictions scored in micro-batches, then counted."""
    out, check = shared_path(spark, "scored"), shared_path(spark, "progress")
    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/lineitem.parquet*")
    score_batches(stream, lambda b: b.selectExpr(*(f"{e} AS {c}" for c, e in SCORED.items())), out, check).awaitTermination()
    return spark.read.parquet(out).groupBy("cohort", "truth", "pred").agg(F.count("*").alias("n"))
