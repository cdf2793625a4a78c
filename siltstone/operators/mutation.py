"""Mutation-test aggregates, run history and region metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.outcomes import mutation_score

COUNTS = ("killed", "survived", "no_coverage")


def _tallies() -> list[Column]:
    return [F.count("*").alias("total"), *[F.count_if(F.col("outcome") == c).alias(c) for c in COUNTS]]


def score_by_file(mutants: DataFrame) -> DataFrame:
    """file_path, total, killed, survived, no_coverage, mutation_score of mutants(file_path, outcome)."""
    return mutants.groupBy("file_path").agg(*_tallies()).withColumn("mutation_score", mutation_score(F.col("killed"), F.col("survived")))


def score_rollup(mutants: DataFrame) -> DataFrame:
    """Per-file and grand totals in one pass; is_total marks the latter."""
    both = mutants.rollup("file_path").agg(*_tallies(), F.grouping("file_path").cast("int").alias("is_total"))
    return both.withColumn("mutation_score", mutation_score(F.col("killed"), F.col("survived")))


def history(runs: DataFrame, project: str, region: str | None = None, limit: int | None = None) -> DataFrame:
    """A project's runs, newest first; without a region all of them; a limit of 0 or less means none."""
    if limit is not None and not isinstance(limit, int):
        raise TypeError("limit must be a whole number")
    kept = runs.where(F.col("project") == project)
    if region is not None:
        kept = kept.where(F.col("region").eqNullSafe(F.lit(region)))
    ordered = kept.orderBy(F.desc("ts"), F.desc("id"))
    return ordered.limit(limit) if limit and limit > 0 else ordered


def region_pid(runs: DataFrame, window: int = 5, decay: float = 0.8) -> DataFrame:
    """project, region, p, i, d, n_runs over each region's last `window` runs of runs(project, region, ts, id, score).

    p is the newest miss (1 - score), i the decayed sum of misses, d the newest miss less the one before.
    """
    newest = Window.partitionBy("project", "region").orderBy(F.desc("ts"), F.desc("id"))
    miss = F.lit(1.0) - F.col("score")
    ranked = runs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= window)
    last, before = (F.max(F.when(F.col("rank") == k, miss)) for k in (1, 2))
    return ranked.groupBy("project", "region").agg(
        last.alias("p"),
        F.sum(miss * F.pow(F.lit(decay), F.col("rank") - 1)).alias("i"),
        F.coalesce(last - before, F.lit(0.0)).alias("d"),
        F.count("*").alias("n_runs"),
    )


def score_regressions(runs: DataFrame, drop: float = 0.1) -> DataFrame:
    """project, region, ts, id, before, score: each region's first fall of the score by more than `drop`."""
    order = Window.partitionBy("project", "region").orderBy("ts", "id")
    falls = runs.withColumn("before", F.lag("score").over(order)).where(F.col("before") - F.col("score") > drop)
    first = Window.partitionBy("project", "region").orderBy("ts", "id")
    return falls.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("project", "region", "ts", "id", "before", "score")


def region_stats(regions: DataFrame, mutants: DataFrame, matches) -> DataFrame:
    """Tallies of the mutants inside each region; regions without mutants give no row.

    regions(region_id, r), mutants(m, outcome): region structs; joined on the file, matches(r, m) is the rest.
    """
    joined = regions.join(mutants, (F.col("r.file_path") == F.col("m.file_path")) & matches(F.col("r"), F.col("m")))
    return joined.groupBy("region_id").agg(*_tallies()).withColumn("mutation_score", mutation_score(F.col("killed"), F.col("survived")))
