"""Graphs, beliefs, stores, reports, code and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.operators import beliefs, graph, mutation, synthesis, tables
from siltstone.plans import catalogue
from siltstone.sources import code, reports
from siltstone.streaming import runs as stream


def edges_of(spark, text):
    return spark.createDataFrame([tuple(e) for e in text.split()], "src string, dst string")


def nodes_of(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def reach(df, start):
    return {r.dst for r in df.collect() if r.src == start}


def test_closure_depth_cycles_and_self_loops(spark):
    chain = edges_of(spark, "ab bc cd")
    assert reach(graph.closure(chain), "a") == set("bcd") and reach(graph.closure(chain, max_depth=2), "a") == set("bc")
    assert reach(graph.closure(chain, reverse=True), "c") == set("ab")
    assert reach(graph.closure(edges_of(spark, "aa ab")), "a") == {"b"}
    assert reach(graph.closure(edges_of(spark, "sa sb st at bt")), "s") == set("abt")


def test_strong_components_and_condensation(spark):
    e = edges_of(spark, "ab bc ca ad")
    scc = graph.strong_components(nodes_of(spark, "abcd"), e)
    assert {r.id: r.scc for r in scc.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    assert [(r.src_scc, r.dst_scc) for r in graph.condensation(e, scc).collect()] == [("a", "d")]


def test_components_levels_and_paths(spark):
    got = {r.id: r.component for r in graph.components(nodes_of(spark, "abcdex"), edges_of(spark, "ab bc ca de")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "x": "x"}
    assert {r.id: r.level for r in graph.levels(edges_of(spark, "sa sb st at bt")).collect()} == {"s": 0, "a": 1, "b": 1, "t": 2}
    with pytest.raises(ValueError):
        graph.levels(edges_of(spark, "ab ba"))
    assert graph.shortest_path(edges_of(spark, "ab bc cd ad"), "a", "d") == ["a", "d"] and graph.shortest_path(edges_of(spark, "ab"), "b", "a") == []


def test_barbell_is_cut_at_its_bridge(spark):
    left, right = "abcde", "vwxyz"
    pairs = [(s[i], s[j], 1.0) for s in (left, right) for i in range(5) for j in range(5) if i != j] + [("a", "v", 1.0)]
    e = spark.createDataFrame(pairs, "src string, dst string, confidence double")
    got = graph.fiedler_partition(nodes_of(spark, left + right), e, least=3, deepest=1).toPandas()
    assert {"".join(sorted(x.id)) for _, x in got.groupby("path")} == {left, right}
    lap = graph.laplacian(e)
    assert abs(lap.groupBy("row").agg(F.sum("value").alias("s")).agg(F.max(F.abs("s"))).first()[0]) < 1e-9


def test_contraction_strategies(spark):
    s = spark.createDataFrame([("t", "a"), ("t", "b"), ("a", "c"), ("x", "b"), ("b", "d")], "parent string, child string")
    got = lambda k: {r.node for r in beliefs.contract(s, "t", k).collect()}
    assert got("minimal") == {"t"} and got("full_cascade") == set("tabcd") and got("entrenchment") == set("tac")


def test_stability_counts_each_event_once(spark):
    rows = [(1, "expand", "a"), (2, "contract", "a"), (3, "expand", "b"), (4, "revise", "b"), (5, "expand", "c")]
    got = {r.assertion_id: r.stability for r in beliefs.stability(spark.createDataFrame(rows, "seq long, event_type string, assertion_id string")).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 1.0}


def test_pid_of_hand_values(spark):
    rows = [("p", "r", f"2024-01-0{i + 1}", i, s) for i, s in enumerate((0.5, 0.6, 0.8))]
    got = mutation.region_pid(spark.createDataFrame(rows, "project string, region string, ts string, id long, score double")).first()
    assert (got.p, got.i, got.d) == (pytest.approx(0.2), pytest.approx(0.84), pytest.approx(-0.2))


def test_history_limits(spark):
    runs = spark.createDataFrame([("p", "r", i, str(i)) for i in range(5)], "project string, region string, ts long, id string")
    assert mutation.history(runs, "p", limit=0).count() == 5 and [r.ts for r in mutation.history(runs, "p", limit=2).collect()] == [4, 3]
    with pytest.raises(TypeError):
        mutation.history(runs, "p", limit="2")


def test_changes_and_updates(spark):
    snap = lambda d: spark.createDataFrame(list(d.items()), "path string, content_hash string")
    old, new = snap({"mod.py": "1", "util.py": "2", "lib.py": "3"}), snap({"mod.py": "9", "util.py": "2", "new.py": "4"})
    assert {r.path: r.change for r in tables.file_changes(old, new).collect()} == {"mod.py": "modified", "lib.py": "removed", "new.py": "added"}


def test_names(spark):
    nodes = spark.createDataFrame([("a.f", "f"), ("b.f", "f"), ("b.g", "g")], "id string, name string")
    names = spark.createDataFrame([("f",), ("g",), ("b.f",), ("zz",)], "name string")
    assert {r.name: (r.status, r.id) for r in tables.resolve_name(nodes, names).collect()} == {"f": ("ambiguous", None), "g": ("resolved", "b.g"), "b.f": ("resolved", "b.f"), "zz": ("not_found", None)}


def test_reports(spark, tmp_path):
    mutant = lambda *s: {"language": "js", "mutants": [{"id": str(i), "status": x, "location": {"start": {"line": i + 1}}} for i, x in enumerate(s)]}
    (tmp_path / "m.json").write_text(json.dumps({"mutationScore": 66.67, "files": {"src/index.js": mutant("Killed", "Killed", "Survived", "NoCoverage"), "src/b.js": mutant("Killed", "killed")}}, indent=1))
    m = reports.report_json(spark, str(tmp_path / "m.json"))
    by = {r.file_path: (r.total, r.killed, r.survived, r.no_coverage) for r in mutation.score_by_file(m).collect()}
    assert by == {"src/index.js": (4, 2, 1, 1), "src/b.js": (2, 2, 0, 0)}
    assert reports.report_score(spark, str(tmp_path / "m.json")).first()[0] == pytest.approx(0.6667)
    (tmp_path / "old.json").write_text(json.dumps({"mutantResults": [{"status": "Killed"}, {"status": "Survived"}]}))
    assert {r.file_path for r in reports.report_json(spark, str(tmp_path / "old.json")).collect()} == {"<all>"}
    (tmp_path / "runs.jsonl").write_text('{"id":"1","projectId":"p","kind":"unit","timestamp":"2024-01-01T00:00:00Z"}\n\nnot json\n{"id":"2","projectId":"p"}\n')
    assert [r.id for r in reports.runs(spark, str(tmp_path / "runs.jsonl")).collect()] == ["1"]
    killed, survived = (spark.createDataFrame([(x,) for x in v], "value string") for v in (["main.mutant.1.py", "main.mutant.2.py", "", "# c"], ["utils_mutant_3"]))
    assert sorted((r.file_path, r.outcome) for r in reports.universalmutator(killed, survived).collect()) == [("main.py", "killed"), ("main.py", "killed"), ("utils", "survived")]


def test_code_that_doesnt_parse_gives_nothing(spark):
    files = spark.createDataFrame([("a.py", "def f(:"), ("b.py", "def g():\n    return g()\n"), ("c.py", None)], "path string, source string")
    assert [(r.source_id, r.target_id, r.kind) for r in code.call_edges(files).orderBy("line").collect()] == [("b", "b.g", "defines"), ("b.g", "b.g", "calls")]


def test_population(spark):
    rows = spark.createDataFrame([(i, "p", "x" if i < 3 else "y", float(i)) for i in range(4)], "id long, population string, bin string, fitness double")
    assert synthesis.entropy(rows).first().entropy == pytest.approx(0.8112781)
    assert [r.id for r in synthesis.crowded(rows, 2).orderBy("id").collect()] == [0, 1]
    assert [r.id for r in synthesis.elite(rows, 1).collect()] == [3] and synthesis.without_weakest(rows, 1).count() == 3


def test_streams_agree_with_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    row = lambda i, k, s, h: json.dumps({"id": str(i), "project": "p", "region": "r", "ts": f"2024-01-01T{h:02d}:30:00Z", "killed": k, "survived": s})
    (folder / "a.json").write_text("\n".join([row(1, 5, 5, 0), row(3, 8, 2, 2), row(1, 5, 5, 0)]))
    (folder / "b.json").write_text(row(2, 6, 4, 1))  # late
    runs = stream.run_stream(spark, str(folder))
    q = stream.tumbling_scores(runs).writeStream.format("memory").queryName("scores").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    assert sorted((r.killed, r.survived) for r in spark.table("scores").collect()) == [(5, 5), (6, 4), (8, 2)]
    q = stream.trailing_pid(runs).writeStream.format("memory").queryName("pid").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    last = spark.table("pid").collect()[-1]
    assert (last.p, last.i, last.d) == (pytest.approx(0.2), pytest.approx(0.84), pytest.approx(-0.2))


def test_whole_graph_queries_leave_nothing_out(spark, tmp_path):
    """A path of 30 users (some beyond any depth of 12), a cycle and a lone pair, in blocks of 50 events."""
    runs = [list(range(1, 31)), [40, 41, 42, 40], [51, 52]]
    events = [(50 * k + i, u) for k, run in enumerate(runs) for i, u in enumerate(run)]
    spark.createDataFrame(events, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    edges = {e for run in runs for e in zip(run, run[1:])}
    depth = {}
    for start in {u for e in edges for u in e}:
        frontier, d, seen = {start}, 0, {start}
        while frontier:
            d += 1
            frontier = {b for a, b in edges if a in frontier} - seen
            seen |= frontier
            depth |= {(start, x): d for x in frontier}
    rows = lambda name: sorted(map(tuple, catalogue.queries()[name](spark, str(tmp_path)).collect()))
    assert rows("shortest_path_length") == sorted((*pair, d) for pair, d in depth.items()) and max(depth.values()) == 29
    assert rows("reachability_closure") == sorted(depth) and rows("reverse_reachability") == sorted((b, a) for a, b in depth)
    assert rows("neighbors_out") == sorted(edges) and rows("neighbors_in") == sorted((b, a) for a, b in edges)
    assert rows("neighbors_both") == sorted([*edges, *((b, a) for a, b in edges)])
    assert {c for _, c in rows("connected_components")} == {1, 40, 51}


def test_large_components_are_cut_at_the_bridge(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "DENSE", 20)
    rng = np.random.default_rng(1)
    i, j = rng.integers(0, 60, 500), rng.integers(0, 60, 500)
    i, j = np.concatenate([i, i + 60, [3]]), np.concatenate([j, j + 60, [77]])
    keep = i != j
    i, j, w = np.concatenate([i[keep], j[keep]]), np.concatenate([j[keep], i[keep]]), np.ones(2 * keep.sum())
    value, v = graph._fiedler(120, i, j, w)
    monkeypatch.setattr(graph, "DENSE", 1500)
    dense, u = graph._fiedler(120, i, j, w)
    assert abs(value - dense) < 1e-6 and abs(abs(u @ v) - 1) < 1e-4
    assert {frozenset(np.flatnonzero(v > 0)), frozenset(np.flatnonzero(v <= 0))} == {frozenset(range(60)), frozenset(range(60, 120))}


def test_searches_from_all_nodes_share_their_steps(monkeypatch):
    """Depths against single searches: more sources than go together, edges cut in steps, a depth limit."""
    import numpy as np

    rng = np.random.default_rng(2)
    n, pairs = 150, rng.integers(0, 150, (2, 260)).astype("<i4")
    monkeypatch.setattr(graph, "WIDTH", 70)
    monkeypatch.setattr(graph, "STEP", 7)
    monkeypatch.setattr(graph, "BATCH", 1000)
    expected, below = set(), {u: set(pairs[1][pairs[0] == u].tolist()) for u in range(n)}
    for start in range(n):
        frontier, seen, depth = {start}, {start}, 0
        while frontier:
            depth += 1
            frontier = set().union(*(below[u] for u in frontier)) - seen
            seen |= frontier
            expected |= {(depth, start, x) for x in frontier}
    got = lambda *block, most=None: [(d, *x) for d, i, j in graph._searched(n, pairs, *block, most) for x in zip(i.tolist(), j.tolist())]
    assert sorted(got(0, 90) + got(90, 150)) == sorted(expected)
    assert sorted(got(0, 150, most=2)) == sorted(x for x in expected if x[0] <= 2)


def test_dominance_in_a_grid(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "GRID", 40)
    monkeypatch.setattr(graph, "BATCH", 50)
    rng = np.random.default_rng(3)
    rows = [(int(g), int(i), int(x), int(y)) for i, (g, x, y) in enumerate(zip(rng.integers(0, 2, 300), rng.integers(0, 40, 300), rng.integers(0, 40, 300)))] + [(9, 7, 0, 0), (9, 7, 1, 1), (9, 8, 2, -1)]
    expected = sorted((a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] != b[1] and a[2] <= b[2] and a[3] <= b[3])
    labels = spark.createDataFrame([*rows, (None, 1, 0, 0), (1, 999, None, 0)], "grp long, id long, l long, r long")
    assert sorted(map(tuple, graph.dominance(labels).collect())) == expected
    texts = labels.select("grp", "id", F.format_string("%03d", "l").alias("l"), "r").where("l <> 'null'")
    assert sorted(map(tuple, graph.dominance(texts).collect())) == expected
    assert graph.dominance(labels.limit(0)).count() == 0


def test_reachability_by_labels_with_large_keys(spark, tmp_path):
    """Customers' keys beyond ten million stay below their own nation."""
    table = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    table("nation", [(0, 0), (1, 0)], "n_nationkey int, n_regionkey int")
    table("customer", [(5, 0), (25_000_000, 0), (6, 1)], "c_custkey long, c_nationkey int")
    got = sorted(map(tuple, catalogue.queries()["kameda_dominance_pairs"](spark, str(tmp_path)).collect()))
    leaves = [(5, 0), (25_000_000, 0), (6, 1)]
    assert got == sorted([(0, 0), (0, 1), *((n + 100, k + 1000) for k, n in leaves), *((0, k + 1000) for k, n in leaves)])


def test_a_text_that_files_share_is_parsed_once_a_task(spark, monkeypatch):
    source = "import a.b\nfrom . import c\nclass A(....x, B):\n    def f(self):\n        self.g()\n        A().f()\n        A.f()\n"
    code._edges.cache_clear()
    code._imports.cache_clear()
    parsed, parse = [], code.ast.parse
    monkeypatch.setattr(code.ast, "parse", lambda s: parsed.append(s) or parse(s))
    for module in ("pkg.a", "pkg.b"):
        rows = code.edges_of("p", module, source)
        assert [r[:4] for r in rows[:3]] == [("p", module, f"{module}.A", "defines"), ("p", f"{module}.A", "....x", "inherits"), ("p", f"{module}.A", "B", "inherits")]
        assert {r[2] for r in rows if r[3] == "calls"} == {f"{module}.A.g", f"{module}.A", f"{module}.A.f", "<dynamic>.f"}
        assert code.imports_of("p", module, source) == [("p", module, "a.b", None, 0, 1), ("p", module, None, "c", 1, 2)]
    assert len(parsed) == 2
    assert code.edges_of("p", "m", "f(:") == code.imports_of("p", "m", None) == []


def test_files_of_one_split_are_dealt_over_tasks(spark):
    files = spark.range(40, numPartitions=1).select(F.concat(F.lit("m"), "id", F.lit(".py")).alias("path"), F.lit("import a\nf()\n").alias("source"))
    for found in (code.call_edges(files), code.imports(files)):
        assert found.count() == 40 and found.select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_small_components_are_bisected_in_tasks_of_their_own(spark):
    pairs = [(f"{k:02d}{a}", f"{k:02d}{b}", 1.0) for k in range(30) for a, b in ("xy", "yz")]
    e = spark.createDataFrame(pairs, "src string, dst string, confidence double")
    got = graph.fiedler_partition(nodes_of(spark, sorted({x for p in pairs for x in p[:2]})), e).withColumn("p", F.spark_partition_id()).toPandas()
    assert len(got) == 90 and got.groupby("component").id.count().eq(3).all() and got.p.nunique() > 4
