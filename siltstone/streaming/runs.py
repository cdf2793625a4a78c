"""Streams over the append-only logs: tumbling scores, duplicate runs, and trailing region metrics with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUN = "id string, project string, region string, ts timestamp, killed bigint, survived bigint"


def run_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RUN).json(folder)


def tumbling_scores(runs: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """project, start, killed, survived, mutation_score by event-time window; repeated run ids count once."""
    once = runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])
    by = once.groupBy("project", F.window("ts", width).alias("w")).agg(F.sum("killed").alias("killed"), F.sum("survived").alias("survived"))
    score = F.coalesce(F.try_divide(F.col("killed").cast("double"), (F.col("killed") + F.col("survived")).cast("double")), F.lit(0.0))
    return by.select("project", F.col("w.start").alias("start"), "killed", "survived", score.alias("mutation_score"))


def trailing_pid(runs: DataFrame, window: int = 5, decay: float = 0.8) -> DataFrame:
    """project, region, p, i, d after each batch, from the last `window` runs of each region, late ones sorted in."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            total = f.killed + f.survived
            score = (f.killed / total.where(total > 0)).fillna(0.0)
            held += list(zip((t.timestamp() for t in f.ts), f.id, score, strict=True))
        held = sorted(set(held))[-window:]
        state.update(tuple(list(c) for c in zip(*held, strict=True)))
        miss = [1 - s for _, _, s in held][::-1]
        yield pd.DataFrame({"project": [key[0]], "region": [key[1]], "p": [miss[0]], "i": [sum(m * decay**k for k, m in enumerate(miss))], "d": [miss[0] - miss[1] if len(miss) > 1 else 0.0]})

    return runs.groupBy("project", "region").applyInPandasWithState(
        step, "project string, region string, p double, i double, d double", "at array<double>, ids array<string>, scores array<double>", "update", GroupStateTimeout.NoTimeout
    )
