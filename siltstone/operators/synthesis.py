"""Population metrics of patch search, and verdicts over tiers of budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fitness(individuals: DataFrame) -> DataFrame:
    """individuals(is_valid, ce, spec, complexity, ...) with fitness = .4 ce + .5 spec - .1 complexity, -1 if invalid."""
    value = F.lit(0.4) * F.col("ce") + F.lit(0.5) * F.col("spec") - F.lit(0.1) * F.col("complexity")
    return individuals.withColumn("fitness", F.when(F.col("is_valid"), value).otherwise(F.lit(-1.0)))


def elite(individuals: DataFrame, n: int) -> DataFrame:
    return individuals.orderBy(F.desc("fitness"), "id").limit(n)


def without_weakest(individuals: DataFrame, n: int) -> DataFrame:
    weak = individuals.orderBy("fitness", "id").limit(n).select(F.col("id").alias("weak"))
    return individuals.join(F.broadcast(weak), F.col("id") == F.col("weak"), "left_anti")  # n rows


def entropy(individuals: DataFrame) -> DataFrame:
    """population, n, entropy in bits over bins of individuals(population, bin)."""
    bins = individuals.groupBy("population", "bin").agg(F.count("*").alias("c"))
    share = F.col("c") / F.sum("c").over(Window.partitionBy("population"))
    terms = bins.withColumn("term", -share * F.log2(share))
    return terms.groupBy("population").agg(F.sum("c").alias("n"), F.sum("term").alias("entropy"))


def crowded(individuals: DataFrame, n: int) -> DataFrame:
    """The n weakest individuals of each population's most common bin: what an injection replaces."""
    size = individuals.groupBy("population", "bin").agg(F.count("*").alias("c"))
    top = size.groupBy("population").agg(F.max_by("bin", F.struct("c", "bin")).alias("bin"))
    order = Window.partitionBy("population").orderBy("fitness", "id")
    return individuals.join(top, ["population", "bin"]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).drop("nth")


def tournament(individuals: DataFrame, draws: int, k: int = 3, seed: int = 0) -> DataFrame:
    """draw, id, fitness: the best of k individuals for each draw, chosen by a seeded hash of (draw, id)."""
    drawn = individuals.select("id", "fitness", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    order = Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(seed), "draw", "id"), "id")
    picked = drawn.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    return picked.groupBy("draw").agg(F.max(F.struct("fitness", (-F.col("id")).alias("neg"))).alias("b")).select("draw", (-F.col("b.neg")).alias("id"), "b.fitness")


def best_so_far(history: DataFrame) -> DataFrame:
    """history(run, iteration, fitness) with the best fitness up to each iteration."""
    upto = Window.partitionBy("run").orderBy("iteration").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("best", F.max("fitness").over(upto))


def first_decisive(verdicts: DataFrame) -> DataFrame:
    """request, status, tier from verdicts(request, tier, status, spurious).

    Tiers go from cheap to dear; a spurious counterexample goes on to the next; an error ends; nothing decisive is
    bounded_safe at the last tier.
    """
    decisive = F.col("status").isin("verified", "error", "safe") | ((F.col("status") == "counterexample") & ~F.col("spurious"))
    first = F.min(F.when(decisive, F.struct("tier", "status")))
    return verdicts.groupBy("request").agg(first.alias("d"), F.max("tier").alias("last")).select(
        "request", F.coalesce("d.status", F.lit("bounded_safe")).alias("status"), F.coalesce("d.tier", "last").alias("tier")
    )
