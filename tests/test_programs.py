"""Program texts, constraints, hierarchy."""

import ast

import pytest
from pyspark.sql import functions as F

from siltstone.functions import programs
from siltstone.operators import graph, verification

TEXT = "def f(a, b):\n    if a < b:\n        return a + 1\n    return b\n"


def test_features_and_mutations(spark):
    assert programs.features_of(TEXT)[0] and programs.features_of("def f(:") == (False, 0, 0, 0, 0, 0, 1.0)
    for op in programs.OPERATORS:
        made = programs.mutate(TEXT, op, 1)
        assert made != ast.unparse(ast.parse(TEXT)) and ast.parse(made)
    assert programs.mutate("def f(:", "branch_flip", 1) == "def f(:"
    with pytest.raises(ValueError):
        programs.mutate(TEXT, "other", 1)
    assert ast.parse(programs.cross(TEXT, "def g():\n    return 7\n", 3))
    row = spark.createDataFrame([(TEXT, "branch_flip", 1), (None, "branch_flip", 1)], "t string, o string, s int").select(programs.mutated(F.col("t"), F.col("o"), F.col("s")).alias("m")).collect()
    assert "not a < b" in row[0].m


@pytest.mark.parametrize("constraints,status", [
    (["x > 3", "x < 5"], "counterexample"), (["x > 3", "x < 4"], "no_ce"), (["x == 0x10", "x != 16"], "no_ce"), (["x < y", "y < x"], "unknown"),
    (["x * 2 > 3"], "unknown"), ([], "counterexample"), (["x <= y", "y <= 3", "x >= 2"], "counterexample"),
])
def test_constraints(constraints, status):
    assert verification.decide(constraints, bits=8)[0] == status


def test_hierarchy_condenses_cycles(spark):
    e = spark.createDataFrame([(*p, 1.0) for p in ("ab", "ba", "bc", "cd", "dc")], "src string, dst string, confidence double")
    nodes = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    got = graph.hierarchy(nodes, e).where("level = 0").toPandas()
    assert {"".join(sorted(x.id)) for _, x in got.groupby("grp")} == {"ab", "cd"}


def test_features_follow_their_definitions():
    text = "try:\n    for x in y:\n        if x:\n            z = x * w\nexcept ValueError:\n    pass\n"
    valid, depth, nodes, branches, functions, names, _ = programs.features_of(text)
    assert (valid, branches, functions, names) == (True, 2, 0, 5)
    assert programs.features_of("def f(:")[:3] == (False, 0, 0)
    assert programs.mutate("a * b", "operator_swap", 1) == "a // b" and programs.mutate("a // b", "operator_swap", 1) == "a * b"


def test_constraint_grammar():
    from siltstone.operators import verification

    assert verification.decide(["x == 0x10"]) == ("counterexample", "x=16")
    assert verification.decide(["x > -5"], 8) == ("counterexample", "x=252")
    assert verification.decide(["3abc > 1"])[0] == "unknown" and verification.decide(["x < 0"])[0] == "no_ce"
