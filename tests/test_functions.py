"""Scalar rules: regions, outcomes, failures, negation."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import outcomes as o
from siltstone.functions import regions as r


def values(spark, columns, *exprs):
    df = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return tuple(df.select(*[e.alias(f"x{i}") for i, e in enumerate(exprs)]).first())


@pytest.mark.parametrize("text,level", [
    ("file:src/a.py", "file"), ("file:src/a.py::class:C", "class"), ("file:src/a.py::func:f", "func"), ("file:src/a.py::class:C::func:m", "func"),
    ("file:src/a.py::lines:10-20", "lines"), ("file:src/a.py::class:C::func:m::lines:15-15", "lines"),
])
def test_region_text_round_trips(spark, text, level):
    parsed = r.parse(F.lit(text))
    assert values(spark, {}, r.text(parsed), r.level(parsed), r.valid(parsed)) == (text, level, True)


def test_odd_region_texts(spark):
    path = lambda t: r.parse(F.lit(t))["file_path"]
    assert values(spark, {}, path("src/some/path.py"), path("my_module::my_function"), path("  "), r.text(r.parse(F.lit("file:a::lines:15")))) == (
        "src/some/path.py", "my_module::my_function", None, "file:a::lines:15-15",
    )
    assert values(spark, {}, r.valid(r.parse(F.lit("file:a::lines:20-10"))), r.valid(r.parse(F.lit("file:a::lines:0-3"))), r.valid(r.parse(F.lit("file:::class:C")))) == (False, False, False)


@pytest.mark.parametrize("a,b,contains,overlaps", [
    ("file:a", "file:a::func:f", True, True), ("file:a::func:f", "file:a", False, True), ("file:a::class:C", "file:a::class:C::func:m", True, True),
    ("file:a::class:C", "file:a::class:D::func:m", False, False), ("file:a::func:compute", "file:a::func:compute::lines:10-20", True, True),
    ("file:a::lines:10-30", "file:a::lines:15-25", True, True), ("file:a::lines:15-25", "file:a::lines:10-30", False, True), ("file:a", "file:b", False, False),
    ("file:a::lines:10-20", "file:a::lines:15-25", False, True), ("file:a::lines:10-20", "file:a::lines:25-35", False, False), ("file:a::lines:10-20", "file:a::lines:21-30", False, False),
    ("file:a::class:C::func:m", "file:a::class:C::func:m", True, True), ("file:a::lines:1-5", "file:a::func:f", False, False),
])
def test_region_relations(spark, a, b, contains, overlaps):
    x, y = r.parse(F.lit(a)), r.parse(F.lit(b))
    assert values(spark, {}, r.contains(x, y), r.overlaps(x, y)) == (contains, overlaps)


@pytest.mark.parametrize("message,mode", [
    ("TypeError: unsupported operand", "type_mismatch"), ("cannot convert str", "type_mismatch"), ("Precondition violated", "precondition_violation"), ("ValueError: x", "precondition_violation"),
    ("index out of range", "precondition_violation"), ("postcondition failed", "postcondition_violation"), ("expected 3 but got 4", "postcondition_violation"), ("loop invariant broken", "invariant_violation"),
    ("IndexError: list", "invariant_violation"), ("infinite loop", "invariant_violation"), ("AssertionError: no", "postcondition_violation"), ("something else", "unknown"), (None, "unknown"),
])
def test_failure_modes(spark, message, mode):
    assert values(spark, {}, o.failure_mode(F.lit(message).cast("string"))) == (mode,)


def test_fit_and_drift(spark):
    full = lambda p, m: o.failure_full(F.lit(None).cast("string"), F.lit(p).cast("double"), F.lit(m).cast("double"))
    assert values(spark, {}, *[o.is_overfit(F.lit(p), F.lit(m)) for p, m in ((0.95, 0.3), (0.8, 0.7), (0.3, 0.1), (0.8, 0.4))]) == (True, False, False, True)
    assert values(spark, {}, full(0.65, None), full(None, None)) == (("semantic_drift", 0.5), ("unknown", 0.3))


def test_negation(spark):
    pair = lambda a, b: o.denies(F.lit(a), F.lit(b))
    assert values(spark, {}, pair("always sorted", "never sorted"), pair("not x", "x"), pair("is valid", "is invalid"), pair("a", "b")) == (True, True, False, False)


def test_names_and_outputs(spark):
    assert values(spark, {}, *[o.mutant_source(F.lit(x)) for x in ("src/a.mutant.3.py", "lib_mutant_9", "plain")]) == ("src/a.py", "lib", "plain")
    assert values(spark, {}, o.module_to_path(F.lit("a.b")), o.module_to_path(F.lit("")), o.path_to_module(F.lit("a/b/__init__.py"))) == ("a/b.py", "<unknown>", "a.b")
    rel = lambda n, t="x": o.relative_import(F.lit("p.q.m"), F.lit(n), F.lit(t).cast("string"))
    assert values(spark, {}, rel(0), rel(1), rel(2), rel(3), rel(4), rel(1, None)) == ("x", "p.q.x", "p.x", "x", None, "p.q")
    out = F.lit("Total tests: 7\n Passed: 5\n Failed: 2\nFailed mod.a\n[FAIL] mod.b")
    assert values(spark, {}, o.test_totals(out)) == ((7, 5, 2),)
    assert "mod.a" in values(spark, {}, o.failing_tests(out))[0] and "mod.b" in values(spark, {}, o.failing_tests(out))[0]
    assert values(spark, {}, o.extracted_code(F.lit("x\n```python\na = 1\n```\ny")), o.extracted_code(F.lit(" b "))) == ("a = 1", "b")
    assert values(spark, {}, o.cosmic_outcome(F.lit("0"), F.lit("1")), o.cosmic_outcome(F.lit("timeout"), F.lit("killed")), o.cosmic_outcome(F.lit(None), F.lit(None))) == ("killed", "no_coverage", "survived")
    assert values(spark, {}, o.reported_score(F.lit(66.67), F.lit(0.8)), o.reported_score(F.lit(None).cast("double"), F.lit(0.8))) == (pytest.approx(0.6667), 0.8)
    assert values(spark, {}, o.structural_bin(F.lit(2), F.lit(26), F.lit(9), F.lit(4)), o.operator_for(F.lit("Index bad"), F.lit("x"))) == ("0-2-3-1", "guard_insertion")


def test_marked_parts_come_from_one_split(spark):
    """Parts in any order, repeated, beyond the fields' number and with runs of colons, as a split at :: gives them."""
    texts = [
        "file:a::x::y::z::lines:3-4::class:C::class:D", "file:a::func:::class:C", "file:::a::class:C", "file:a::class:C:::func:f", "file::file:b::lines:7", "class:C::file:a", "file:", " file:a::lines:x-2 ", ":::", "",
    ]

    def field(text, mark):
        return next((p[len(mark) :] for p in text.strip().split("::") if p.startswith(mark)), None) if text.strip().startswith("file:") else None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("parts", r.parts(F.col("t")))
    for p in rows.select("t", r.parse(F.col("t"), F.col("parts")).alias("p"), r.parse(F.col("t")).alias("q")).collect():
        assert p.p == p.q
        if not p.t:
            assert p.p is None
            continue
        marked = p.t.strip().startswith("file:")
        assert (p.p.file_path, p.p.class_name, p.p.func_name) == (field(p.t, "file:") if marked else p.t.strip(), field(p.t, "class:"), field(p.t, "func:")), p.t
    assert [(x.a, x.b) for x in rows.select(r.parse(F.col("t"), F.col("parts")).alias("p")).select(F.col("p.line_start").alias("a"), F.col("p.line_end").alias("b")).collect()] == [(3, 4), (None, None), (None, None), (None, None), (7, 7), (None, None), (None, None), (None, 2), (None, None), (None, None)]
