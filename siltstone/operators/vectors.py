"""Vector search and retrieval: exact top-k, one-hop expansion, context packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    """max(0, cosine); 0 for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0)))


def search(vectors: DataFrame, query: list[float], k: int, keep: Column | None = None) -> DataFrame:
    """id, score, rank of the k rows of vectors(id, embedding, ...) nearest to a query; `keep` filters before scoring."""
    kept = vectors if keep is None else vectors.where(keep)
    scored = kept.select("id", cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score"))
    top = scored.orderBy(F.desc("score"), "id").limit(k)  # only k rows go on
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def expand(hits: DataFrame, edges: DataFrame, first: int = 10, out_factor: float = 0.8, in_factor: float = 0.7) -> DataFrame:
    """id, score, source: hits(id, score, rank) and the neighbours of the first ones, callees before callers.

    A neighbour's score comes from the first hit that finds it; a hit keeps its own.
    """
    top = hits.where(F.col("rank") <= first)
    out = top.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("n"), "rank", F.lit(0).alias("way"), (F.col("score") * out_factor).alias("s"))
    into = top.join(edges, F.col("id") == F.col("dst")).select(F.col("src").alias("n"), "rank", F.lit(1).alias("way"), (F.col("score") * in_factor).alias("s"))
    order = Window.partitionBy("n").orderBy("rank", "way")
    near = out.unionAll(into).withColumn("nth", F.row_number().over(order)).where("nth = 1")
    near = near.join(hits.select(F.col("id").alias("hit")), F.col("n") == F.col("hit"), "left_anti")
    added = near.select(F.col("n").alias("id"), F.col("s").alias("score"), F.when(F.col("way") == 0, "callee").otherwise("caller").alias("source"))
    return hits.select("id", "score", F.lit("vector").alias("source")).unionByName(added)


def pack_context(entries: DataFrame, max_tokens: int, group: str = "grp") -> DataFrame:
    """grp, n, context: each group's entries(grp, rank, text) in order while their characters stay within 4 a token."""
    order = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    kept = entries.withColumn("used", F.sum(F.length("text")).over(order)).where(F.col("used") <= 4 * max_tokens)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda e: e["text"])
    return kept.groupBy(group).agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("context"))
