import json
import os
import sqlite3

import pytest

from siltstone.operators import graph
from siltstone.sources import code, locate


def database(path, script):
    base = sqlite3.connect(path)
    base.executescript(script)
    base.close()


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


JOINED = """create table mutant(id, line_id, "index", status); create table line(id, sourcefile_id, line, line_number);
create table sourcefile(id, filename, hash);"""


def test_mutmut_joined_then_flat(spark, tmp_path):
    database(tmp_path / ".mutmut-cache", JOINED + """insert into sourcefile values (1, 'a.py', ''); insert into line values (1, 1, 'x', 4);
    insert into mutant values (1, 1, 0, 'OK_KILLED'), (2, 1, 1, null), (3, 9, 0, 'bad_survived');""")
    below = tmp_path / "x/y/z"
    below.mkdir(parents=True)
    assert locate.find_report(below, "mutmut") == str(tmp_path / ".mutmut-cache")
    assert rows(locate.mutants(spark, str(below), "mut-mut"), "file_path", "line", "status_raw") == [("a.py", 4, "ok_killed"), ("a.py", 4, "untested")]
    database(tmp_path / "flat", "create table mutant(id, filename, line_number, status); insert into mutant values (1, 'b.py', 7, 'bad_survived');")
    assert rows(locate.mutmut_cache(spark, str(tmp_path / "flat")), "file_path", "line", "outcome") == [("b.py", 7, "survived")]
    database(tmp_path / "none", JOINED)
    assert locate.mutmut_cache(spark, str(tmp_path / "none")).count() == 0


def test_cosmic_sessions(spark, tmp_path):
    database(tmp_path / "old.sqlite", """create table mutation_specs(job_id, module_path, operator, occurrence, line_number);
    create table results(job_id, worker_outcome, test_outcome); insert into mutation_specs values ('1', 'a.b', 'o', 0, 3), ('2', 'a.b', 'o', 1, 5);
    insert into results values ('1', 'normal', 'killed');""")
    found = rows(locate.mutants(spark, str(tmp_path), "cosmic"), "line", "status_raw")
    assert found == [(3, "killed"), (5, None)]
    database(tmp_path / "new.sqlite", """create table work_items(job_id, module, start_pos, worker_outcome, test_outcome);
    insert into work_items values ('1', 'a', '(12, 4)', 'normal', 'survived'), ('2', 'a', 9, 'normal', 'killed'), ('3', 'a', null, 'normal', 'killed');""")
    os.utime(tmp_path / "old.sqlite", (1, 1))
    assert rows(locate.mutants(spark, str(tmp_path), "cosmic-ray"), "line", "status_raw") == [(12, "survived"), (9, "killed"), (None, "killed")]
    other = tmp_path / "other"
    other.mkdir()
    (tmp_path / "new.sqlite").rename(other / "s.db")
    (other / "cosmic-ray.toml").write_text('[x]\nsession-file = "s.db"\n')
    assert locate.find_report(other, "cosmic-ray") == str(other / "s.db")


def test_one_entry(spark, tmp_path):
    with pytest.raises(locate.Unsupported):
        locate.mutants(spark, str(tmp_path))
    with pytest.raises(locate.Unsupported):
        locate.mutants(spark, str(tmp_path), "mutpy")
    with pytest.raises(FileNotFoundError):
        locate.mutants(spark, str(tmp_path), "stryker")
    (tmp_path / "notes.json").write_text("[1]")
    report = {"schemaVersion": "1", "files": {"a.py": {"mutants": [{"id": "1", "status": "Killed", "location": {"start": {"line": 2}}}]}}}
    (tmp_path / "other.json").write_text(json.dumps(report))
    assert locate.detected_tool(tmp_path) == "poodle"
    assert rows(locate.mutants(spark, str(tmp_path)), "tool", "file_path", "line") == [("poodle", "a.py", 2)]
    (tmp_path / "other.json").rename(tmp_path / ".poodle-report.json")
    assert rows(locate.mutants(spark, str(tmp_path)), "tool", "file_path", "line") == [("poodle", "a.py", 2)]
    (tmp_path / ".universalmutator").mkdir()
    (tmp_path / ".universalmutator/killed.txt").write_text("a.mutant.2.py\n# no mutant\n")
    assert [r.outcome for r in locate.mutants(spark, str(tmp_path), "universalmutator").collect()] == ["killed"]
    (tmp_path / "notkilled.txt").write_text("a.mutant.1.py\n")
    assert [r.outcome for r in locate.mutants(spark, str(tmp_path), "um").collect()] == ["survived"]


SOURCE = '''"""Top."""
import os

class A(B):
    @staticmethod
    async def run(x, /, y, *rest, z=1, **more) -> int:
        """Runs."""
        def inner():
            yield 1
        return lambda q: q
'''


def test_definitions_and_files(spark, tmp_path):
    (tmp_path / "p/skip").mkdir(parents=True)
    (tmp_path / "p/m.py").write_text(SOURCE)
    (tmp_path / "p/bad.py").write_text("def (")
    (tmp_path / "p/skip/n.py").write_text("x = 1")
    files = code.source_files(spark, str(tmp_path), exclude=("skip/",))
    assert rows(files, "path") == [("p/bad.py",), ("p/m.py",)]
    found = {r.id: r for r in code.definitions(files).collect()}
    assert {k: r.kind for k, r in found.items()} == {
        "p.m": "module", "p.m.A": "class", "p.m.A.run": "method", "p.m.A.run.inner": "function", "p.m.A.run.<lambda:10:15>": "lambda",
    }
    run = found["p.m.A.run"]
    assert (run.params, run.returns, run.decorators) == (["x", "y", "*rest", "z", "**more"], "int", ["staticmethod"])
    assert run.is_async and run.is_generator and run.docstring == "Runs." and found["p.m"].docstring == "Top."
    names = spark.createDataFrame([("os.path",), ("p.m",), ("numpy",)], "module string")
    outside = names.select("module", code.is_external(names.module, ["p"]).alias("outside"))
    assert rows(outside, "module", "outside") == [("numpy", True), ("os.path", True), ("p.m", False)]


def test_subgraph(spark):
    edges = spark.createDataFrame([(1, 2, "calls"), (2, 3, "calls"), (1, 2, "defines"), (3, 4, "calls")], "src long, dst long, kind string")
    ids = spark.createDataFrame([(1,), (2,), (2,), (3,)], "id long")
    assert rows(graph.subgraph(edges, ids), "src", "dst") == [(1, 2), (1, 2), (2, 3)]
    assert rows(graph.subgraph(edges, ids, ("calls",)), "src", "dst") == [(1, 2), (2, 3)]
    assert rows(graph.of_kind(edges), "src", "dst") == [(1, 2), (2, 3), (3, 4)]
