"""The tool surface as functions that take and return DataFrames; TOOLS lists them by name.

Tools that would run commands, containers or models read their recorded results instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import outcomes, regions
from siltstone.operators import beliefs, graph, mutation, synthesis, tables, vectors, verification
from siltstone.sources import code


def get_run_history(runs: DataFrame, project: str, region: str | None = None, limit: int | None = None) -> DataFrame:
    return mutation.history(runs, project, region, limit)


def get_region_metrics(runs: DataFrame, project: str, window: int = 5, decay: float = 0.8) -> DataFrame:
    return mutation.region_pid(runs.where(F.col("project") == project), window, decay)


def run_tests(outputs: DataFrame) -> DataFrame:
    """outputs(id, stdout, exit_code, timed_out) with total, passed_tests, failed_tests, failing, passed."""
    t = outcomes.test_totals(F.col("stdout"))
    rows = outputs.withColumn("t", t)
    total = F.when(F.col("t.total") == 0, F.col("t.passed") + F.col("t.failed")).otherwise(F.col("t.total"))
    good = F.coalesce(F.nullif(F.col("t.passed"), F.lit(0).cast("long")), total - F.col("t.failed"))
    done = (F.col("exit_code") == 0) & (F.col("t.failed") == 0) & ~F.coalesce("timed_out", F.lit(False))
    return rows.select("id", total.alias("total"), good.alias("passed_tests"), F.col("t.failed").alias("failed_tests"), outcomes.failing_tests(F.col("stdout")).alias("failing"), done.alias("passed"))


def run_mutation_tests(mutants: DataFrame) -> DataFrame:
    return mutation.score_rollup(mutants)


def detect_frameworks(files: DataFrame, signals: DataFrame, extensions: DataFrame, configs: DataFrame) -> DataFrame:
    return tables.recommend(tables.detect_frameworks(files, signals), tables.detect_languages(files, extensions, configs))


def parse_region(texts: DataFrame) -> DataFrame:
    """texts(region) with its parts, level, canonical text and validity."""
    r = texts.withColumn("r", regions.parse(F.col("region")))
    return r.select("region", "r.*", regions.level(F.col("r")).alias("level"), regions.text(F.col("r")).alias("canonical"), regions.valid(F.col("r")).alias("is_valid"))


def check_region_relationship(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) of region texts with a_contains_b, b_contains_a, is_overlap."""
    p = pairs.withColumns({"x": regions.parse(F.col("a")), "y": regions.parse(F.col("b"))})
    x, y = F.col("x"), F.col("y")
    return p.select("a", "b", regions.contains(x, y).alias("a_contains_b"), regions.contains(y, x).alias("b_contains_a"), regions.overlaps(x, y).alias("is_overlap"))


def create_region(parts: DataFrame) -> DataFrame:
    """Rows of the five region fields with their text."""
    return parts.withColumn("region", regions.text(F.struct(*regions.FIELDS)))


def add_assertion(assertions: DataFrame, new: DataFrame) -> DataFrame:
    """assertions with new(kind, content, confidence, region_id) added under ids of kind and content; 0 <= confidence <= 1."""
    valid = F.assert_true(F.col("confidence").between(0, 1), F.lit("confidence must lie in [0, 1]"))
    key = F.concat_ws("_", "kind", F.substring(F.sha2(F.concat_ws(":", "kind", "content"), 256), 1, 12))
    rows = new.where(valid.isNull()).withColumn("id", key)
    # one row an id: what was there stays, and of equal new ones the most confident
    both = assertions.withColumn("_new", F.lit(0)).unionByName(rows.select(*assertions.columns).withColumn("_new", F.lit(1)))
    order = Window.partitionBy("id").orderBy("_new", F.desc("confidence"), *[F.col(c) for c in sorted(assertions.columns) if dict(assertions.dtypes)[c].split("<")[0] != "map"])
    return both.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_new", "_nth")


def contract_assertion(support: DataFrame, assertion_id: str, strategy: str = "entrenchment") -> DataFrame:
    return beliefs.contract(support, assertion_id, strategy)


def revise_theory(assertions: DataFrame, support: DataFrame, assertion_id: str, new: DataFrame) -> DataFrame:
    """Contract, then add: what the contraction takes goes."""
    gone = beliefs.contract(support, assertion_id)
    return add_assertion(assertions.join(gone, F.col("id") == F.col("node"), "left_anti"), new)


def get_entrenchment(support: DataFrame) -> DataFrame:
    return beliefs.entrenchment(support).withColumn("interpretation", outcomes.entrenchment_label(F.col("entrenchment")))


def list_assertions(assertions: DataFrame, kind: str | None = None, region: str | None = None) -> DataFrame:
    kept = assertions if kind is None else assertions.where(F.col("kind") == kind)
    return kept if region is None else kept.where(F.col("region_id") == region)


def get_theory_snapshot(pointers: DataFrame) -> DataFrame:
    return beliefs.current_world(pointers)


def store_evidence(evidence: DataFrame, new: DataFrame) -> DataFrame:
    return tables.upsert(evidence, new, ["id"])


def get_provenance(events: DataFrame, last: int = 10) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(last)


def why_believe(events: DataFrame, assertion_id) -> DataFrame:
    return beliefs.why_believe(events.where(F.col("assertion_id") == assertion_id))


def belief_stability(events: DataFrame) -> DataFrame:
    return beliefs.stability(events).withColumn("interpretation", outcomes.stability_label(F.col("stability")))


def rollback_to(pointers: DataFrame, domain: str, label: str, hash_: str) -> DataFrame:
    """The pointer log with a move to a known world."""
    own = pointers.where((F.col("domain") == domain) & (F.col("label") == label))
    then = own.groupBy("domain", "label").agg(F.max(F.when(F.col("hash") == hash_, F.col("hash"))).alias("hash"), (F.max("seq") + 1).alias("seq"))
    return pointers.unionByName(then.where("hash is not null"))


def undo_last_operations(pointers: DataFrame, domain: str, label: str, n: int = 1) -> DataFrame:
    return beliefs.rolled_back(pointers, domain, label, F.lit(n))


def analyze_failure(failures: DataFrame) -> DataFrame:
    return failures.withColumn("failure", outcomes.failure_full(F.col("error_message"), F.col("test_pass_rate"), F.col("mutation_score")))


def list_world_history(events: DataFrame) -> DataFrame:
    return events.where("to_world is not null").select(F.col("to_world").alias("hash"), "ts", F.coalesce("reason", "event_type").alias("why"), "seq")


def extract_call_graph(files: DataFrame) -> DataFrame:
    return code.call_edges(files)


def compute_partitioning(nodes: DataFrame, edges: DataFrame, least: int = 3, deepest: int = 10) -> DataFrame:
    return graph.fiedler_partition(nodes, edges, least, deepest)


def query_reachability(edges: DataFrame, src, dst) -> list:
    """The nodes of a shortest path; [] if dst can't be reached."""
    return graph.shortest_path(edges, src, dst)


def get_hierarchy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.hierarchy(nodes, edges)


def find_function_partition(partition: DataFrame, node) -> DataFrame:
    """The leaf of a node and its siblings."""
    own = partition.where(F.col("id") == node).select(F.col("component").alias("c"), F.col("path").alias("p"))
    return partition.join(F.broadcast(own), (F.col("component") == F.col("c")) & (F.col("path") == F.col("p"))).select("component", "path", "id")  # one row


def synthesize_patch(individuals: DataFrame, survivors: int, draws: int, seed: int) -> DataFrame:
    """One generation's parents: the elite and the winners of seeded tournaments, of scored individuals."""
    scored = synthesis.fitness(individuals)
    best = synthesis.elite(scored, survivors).select("id", "fitness")
    return best.unionByName(synthesis.tournament(scored, draws, seed=seed).select("id", "fitness")).distinct()


def list_synthesis_runs(persisted: DataFrame, recent: DataFrame) -> DataFrame:
    """Persisted runs, and recent ones that aren't persisted."""
    return persisted.unionByName(recent.join(persisted.select("id"), "id", "left_anti").select(*persisted.columns))


def synthesis_status(history: DataFrame) -> DataFrame:
    return synthesis.best_so_far(history)


def incremental_update(old: DataFrame, new: DataFrame, nodes: DataFrame, extracted: DataFrame) -> DataFrame:
    return tables.incremental_apply(old, new, nodes, extracted)


def persistent_graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(edges.agg(F.count("*").alias("n_edges")))  # one row each


def graph_query(kind: str, edges: DataFrame, ids: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """neighbors, reachability or node, for ids(id)."""
    if kind == "neighbors":
        return graph.neighbours(edges, ids)
    if kind == "reachability":
        return graph.closure(edges, ids)
    if kind == "node" and nodes is not None:
        return nodes.join(ids, "id", "left_semi")
    raise ValueError("supported queries: neighbors, reachability, node")


def verify_property(requests: DataFrame) -> DataFrame:
    return verification.solve(requests)


def verify_with_orchestrator(verdicts: DataFrame) -> DataFrame:
    return synthesis.first_decisive(verdicts)


def list_verification_backends(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("bounds", True, "integer comparisons"), ("recorded", True, "verdicts read as data")], "backend string, available boolean, supports string")


def rag_index_nodes(store: DataFrame, new: DataFrame) -> DataFrame:
    """The vector table with new(id, embedding, ..., seq) rows put in."""
    return tables.upsert(store, new, ["id"])


def rag_search(store: DataFrame, edges: DataFrame, query: list[float], k: int = 20) -> DataFrame:
    found = vectors.expand(vectors.search(store, query, k), edges)
    return found.orderBy(F.desc("score"), "id").limit(k)


def rag_stats(store: DataFrame) -> DataFrame:
    return store.agg(F.count("*").alias("n_documents"))


TOOLS = {
    f.__name__: f
    for f in (
        run_tests, run_mutation_tests, get_run_history, get_region_metrics, detect_frameworks, parse_region, check_region_relationship, create_region, add_assertion, contract_assertion,
        get_entrenchment, list_assertions, get_theory_snapshot, revise_theory, store_evidence, get_provenance, why_believe, belief_stability, rollback_to, undo_last_operations, analyze_failure,
        list_world_history, extract_call_graph, compute_partitioning, query_reachability, get_hierarchy, find_function_partition, synthesize_patch, synthesis_status, list_synthesis_runs,
        incremental_update, persistent_graph_stats, graph_query, verify_property, verify_with_orchestrator, list_verification_backends, rag_index_nodes, rag_search, rag_stats,
    )
}
