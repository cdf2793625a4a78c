"""Connected components by contraction: every round hooks each node to its least neighbour and shortens the chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import SALTS, forget, keep


def components(edges: DataFrame) -> DataFrame:
    """node, root (bigint; root: one node for each component) for all nodes of edges(a, b).

    Rounds of: each node points to its least neighbour or itself; pointers are followed twice; edges are drawn between
    the new roots. Edges shrink by a factor each round; the loop ends without any. Nothing is collected but counts.
    """
    left = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    roots = None
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b"), F.col("a")).toDF("a", "b"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("up"))
        first = keep(up, "pointers")
        up = _followed(_followed(first, "up", first), "up", first)
        up = keep(up, "pointers")
        forget(first)
        if roots is None:
            roots = up.toDF("node", "root")
            roots._kept_at = up._kept_at
        else:
            old, over = roots, up.toDF("over", "root_over")
            dealt, over = _salted(roots, "node"), _repeated(over)
            joined = dealt.join(over, (dealt["root"] == over["over"]) & (dealt["_salt"] == over["_turn"]), "left")
            roots = keep(joined.select("node", F.coalesce("root_over", "root").alias("root")), "roots")
            forget(old)
        old = left
        left = _followed(_followed(left, "a", up), "b", up)
        left = keep(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
        forget(old)
        if roots._kept_at != up._kept_at:
            forget(up)
    return left.toDF("node", "root") if roots is None else roots


def _salted(df: DataFrame, by: str) -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))


def _repeated(df: DataFrame) -> DataFrame:
    return df.withColumn("_turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _followed(df: DataFrame, column: str, pointers: DataFrame) -> DataFrame:
    """df with `column` replaced by what pointers(node, up) say of it; the rows of one node are dealt to SALTS tasks."""
    other = next(c for c in df.columns if c != column)
    dealt, to = _salted(df, other), _repeated(pointers.toDF("_from", "_to"))
    joined = dealt.join(to, (dealt[column] == to["_from"]) & (dealt["_salt"] == to["_turn"]))
    return joined.select(*[F.col("_to").alias(c) if c == column else dealt[c] for c in df.columns])
