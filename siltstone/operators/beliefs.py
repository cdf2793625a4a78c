"""Belief revision over event logs and support graphs.

events(seq, event_type, assertion_id, evidence_id, from_world, to_world, nodes_added, nodes_removed, ts, reason): any
function reads only the columns it names. support(parent, child, tier, confidence): parent supports child.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.outcomes import denies
from siltstone.operators.graph import closure
from siltstone.plans.settle import settle

ADDING, REMOVING = ("expand", "revise"), ("contract", "revise")


def why_believe(events: DataFrame) -> DataFrame:
    """assertion_id, evidence_id of each event that added the assertion."""
    return events.where(F.col("event_type").isin(*ADDING) & F.col("evidence_id").isNotNull()).select("assertion_id", "evidence_id")


def first_event(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """assertion_id, seq, ts: the first event of the kinds for each assertion."""
    return events.where(F.col("event_type").isin(*kinds)).groupBy("assertion_id").agg(F.min(F.struct("seq", "ts")).alias("e")).select("assertion_id", "e.seq", "e.ts")


def stability(events: DataFrame) -> DataFrame:
    """assertion_id, revisions, stability = 1 / (1 + contractions and revisions), each event once."""
    n = F.count_if(F.col("event_type").isin(*REMOVING))
    return events.groupBy("assertion_id").agg(n.alias("revisions"), (F.lit(1.0) / (n + 1)).alias("stability"))


def entrenchment(support: DataFrame) -> DataFrame:
    """node, entrenchment = min(1, 0.7 mean(0.5 (1 - tier / 5) + 0.5 confidence) + 0.3 min(1, n / 5)) over its supports."""
    tier, sure = F.coalesce("tier", F.lit(5)), F.coalesce("confidence", F.lit(0.0))
    one = F.lit(0.5) * (F.lit(1.0) - tier / F.lit(5.0)) + F.lit(0.5) * sure
    breadth = F.least(F.lit(1.0), F.count("*") / F.lit(5.0))
    return support.groupBy(F.col("child").alias("node")).agg(F.least(F.lit(1.0), F.lit(0.7) * F.avg(one) + F.lit(0.3) * breadth).alias("entrenchment"))


def contract(support: DataFrame, target: str, strategy: str = "entrenchment", cascade_root: bool = True) -> DataFrame:
    """node: what goes when `target` is contracted.

    minimal: the target; full_cascade: all its descendants too; entrenchment: the descendants left without any other
    support, to the fixpoint.
    """
    spark = support.sparkSession
    edges = support.select(F.col("parent").alias("src"), F.col("child").alias("dst")).distinct()
    start = spark.range(1).select(F.lit(target).alias("node"))
    if strategy == "minimal":
        return start
    below = settle(closure(edges, start.select(F.col("node").alias("id"))).select(F.col("dst").alias("node")))
    if strategy == "full_cascade":
        return start.unionByName(below)
    if strategy != "entrenchment":
        raise ValueError(f"unknown strategy {strategy!r}")
    inside = settle(edges.join(below, F.col("dst") == F.col("node"), "left_semi"))
    gone = settle(start)
    while True:
        lost = gone.select(F.col("node").alias("gone"))
        held = inside.join(lost, F.col("src") == F.col("gone"), "left_anti").select(F.col("dst").alias("held")).distinct()
        fresh = below.join(held, F.col("node") == F.col("held"), "left_anti").join(lost, F.col("node") == F.col("gone"), "left_anti")
        fresh = settle(fresh.select("node"))
        if fresh.isEmpty():
            return gone
        gone = settle(gone.unionByName(fresh))


def contradictions(assertions: DataFrame) -> DataFrame:
    """a_id, b_id of assertions(id, kind, content, region_id) in one region that contradict: a_id < b_id."""
    a = assertions.select(F.col("id").alias("a_id"), "region_id", "kind", F.col("content").alias("a"))
    b = assertions.select(F.col("id").alias("b_id"), F.col("region_id").alias("r"), F.col("kind").alias("k"), F.col("content").alias("b"))
    differ = F.lower(F.trim("a")) != F.lower(F.trim("b"))
    rule = F.when(F.col("kind") == "type", differ).when(F.col("kind").isin("behavior", "precondition", "postcondition"), denies(F.col("a"), F.col("b"))).otherwise(F.lit(False))
    return a.join(b, (F.col("region_id") == F.col("r")) & (F.col("kind") == F.col("k")) & (F.col("a_id") < F.col("b_id"))).where(rule).select("a_id", "b_id")


def world_hashes(events: DataFrame) -> DataFrame:
    """hash, seq, pos: where each world hash is first seen; null hashes aside."""
    seen = events.select("seq", F.posexplode(F.array("from_world", "to_world")).alias("pos", "hash")).where("hash is not null")
    return seen.groupBy("hash").agg(F.min(F.struct("seq", "pos")).alias("at")).select("hash", "at.seq", "at.pos")


def world_path(events: DataFrame, last: str) -> DataFrame:
    """hash, steps: the worlds behind a world, followed by each one's newest event, cycles guarded."""
    newest = events.where("to_world is not null").groupBy("to_world").agg(F.max_by("from_world", "seq").alias("from_world"))
    newest = settle(newest)
    at = seen = settle(events.sparkSession.range(1).select(F.lit(last).alias("hash"), F.lit(0).alias("steps")))
    while not at.isEmpty():
        step = newest.join(at, F.col("to_world") == F.col("hash")).where("from_world is not null").select(F.col("from_world").alias("hash"), (F.col("steps") + 1).alias("steps"))
        at = settle(step.join(seen.select(F.col("hash").alias("known")), F.col("hash") == F.col("known"), "left_anti"))
        seen = settle(seen.unionByName(at))
    return seen


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def ungrounded(nodes: DataFrame, grounding: DataFrame) -> DataFrame:
    """Nodes(id) without a grounding edge to them (child)."""
    return nodes.join(grounding.select(F.col("child").alias("grounded")), F.col("id") == F.col("grounded"), "left_anti")


def orphan_edges(edges: DataFrame, nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """edges(parent, child) whose parent is neither node nor evidence, or whose child is no node."""
    known = nodes.select("id")
    bad_parent = edges.join(known.unionByName(evidence.select("id")), F.col("parent") == F.col("id"), "left_anti")
    bad_child = edges.join(known, F.col("child") == F.col("id"), "left_anti")
    return bad_parent.unionByName(bad_child).distinct()


def current_world(pointers: DataFrame) -> DataFrame:
    """domain, label, hash: the newest pointer of pointers(domain, label, hash, seq)."""
    return pointers.groupBy("domain", "label").agg(F.max_by("hash", "seq").alias("hash"))


def rolled_back(pointers: DataFrame, domain: str, label: str, steps: Column) -> DataFrame:
    """pointers with a new row that points where the log pointed `steps` moves ago."""
    own = (F.col("domain") == domain) & (F.col("label") == label)
    back = Window.partitionBy("domain", "label").orderBy(F.desc("seq"))
    then = pointers.where(own).withColumn("ago", F.row_number().over(back) - 1).where(F.col("ago") == steps)
    ahead = then.crossJoin(pointers.where(own).agg(F.max("seq").alias("last")))  # one row each
    return pointers.unionByName(ahead.select("domain", "label", "hash", (F.col("last") + 1).alias("seq")))
