"""Cutting lineage between the rounds of a loop, in a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_own: str | None = None


def settle(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir (a temporary folder where that is unset) and read back."""
    global _own
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        _own = _own or tempfile.mkdtemp(prefix="siltstone-core-")
        folder = _own
    path = f"{folder.rstrip('/')}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
