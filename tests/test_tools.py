"""The tool surface on small inputs."""

import pytest
from pyspark.sql import functions as F

from siltstone import tools


def test_test_runs_and_regions(spark):
    out = spark.createDataFrame([(1, "Tests run: 3, Passed: 2, Failed: 1", 1, False), (2, "Total tests: 4 Passed: 4 Failed: 0", 0, False), (3, "", 0, True)], "id int, stdout string, exit_code int, timed_out boolean")
    got = {r.id: (r.total, r.passed_tests, r.failed_tests, r.passed) for r in tools.run_tests(out).collect()}
    assert got == {1: (3, 2, 1, False), 2: (4, 4, 0, True), 3: (0, 0, 0, False)}
    rel = tools.check_region_relationship(spark.createDataFrame([("file:a", "file:a::func:f")], "a string, b string")).first()
    assert (rel.a_contains_b, rel.b_contains_a, rel.is_overlap) == (True, False, True)
    parsed = tools.parse_region(spark.createDataFrame([("file:a::lines:3",)], "region string"))
    assert tools.create_region(parsed.drop("region")).first().region == "file:a::lines:3-3"


def test_beliefs(spark):
    none = spark.createDataFrame([], "id string, kind string, content string, confidence double, region_id string")
    new = spark.createDataFrame([("type", "x: int", 0.9, "r"), ("type", "x: int", 0.9, "r")], "kind string, content string, confidence double, region_id string")
    added = tools.add_assertion(none, new)
    assert added.count() == 1 and tools.list_assertions(added, "type", "r").count() == 1
    with pytest.raises(Exception, match="confidence"):
        tools.add_assertion(none, new.withColumn("confidence", F.lit(1.5))).collect()
    support = spark.createDataFrame([("t", "a")], "parent string, child string")
    held = none.unionByName(spark.createDataFrame([("t", "type", "y", 1.0, "r"), ("a", "type", "z", 1.0, "r")], none.schema))
    assert {r.content for r in tools.revise_theory(held, support, "t", new).collect()} == {"x: int"}
    log = spark.createDataFrame([("d", "main", "h1", 1), ("d", "main", "h2", 2), ("d", "main", "h3", 3)], "domain string, label string, hash string, seq long")
    assert tools.get_theory_snapshot(log).first().hash == "h3"
    assert tools.get_theory_snapshot(tools.undo_last_operations(log, "d", "main", 1)).first().hash == "h2"
    assert tools.get_theory_snapshot(tools.rollback_to(log, "d", "main", "h1")).first().hash == "h1"
    assert tools.get_theory_snapshot(tools.rollback_to(log, "d", "main", "none")).first().hash == "h3"


def test_graph_and_search(spark):
    edges = spark.createDataFrame([("fn1", "fn2"), ("fn1", "fn3"), ("fn0", "fn1")], "src string, dst string")
    store = spark.createDataFrame([("fn1", [1.0, 0.0, 0.0]), ("zero", [0.0, 0.0, 0.0])], "id string, embedding array<double>")
    got = {r.id: r.score for r in tools.rag_search(store.where("id = 'fn1'"), edges, [1.0, 0.0, 0.0], 10).collect()}
    assert got == {"fn1": 1.0, "fn2": pytest.approx(0.8), "fn3": pytest.approx(0.8), "fn0": pytest.approx(0.7)}
    assert tools.rag_search(store.where("id = 'zero'"), edges, [1.0, 0.0, 0.0], 1).first().score == 0.0
    assert tools.query_reachability(edges, "fn0", "fn3") == ["fn0", "fn1", "fn3"]
    with pytest.raises(ValueError, match="supported"):
        tools.graph_query("other", edges, edges)
    verdicts = spark.createDataFrame([(1, 1, "counterexample", True), (1, 2, "verified", False), (2, 1, "counterexample", True)], "request int, tier int, status string, spurious boolean")
    assert {r.request: (r.status, r.tier) for r in tools.verify_with_orchestrator(verdicts).collect()} == {1: ("verified", 2), 2: ("bounded_safe", 1)}
    assert len(tools.TOOLS) == 39
