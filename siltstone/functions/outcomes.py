"""Scalar rules for reports, runs, failures and imports, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: how each tool spells its outcomes
STRYKER = {"killed": ["killed"], "survived": ["survived"], "no_coverage": ["no coverage", "nocoverage", "survivednocoverage"]}
MUTMUT = {"killed": ["ok_killed"], "survived": ["bad_survived", "ok_suspicious"], "no_coverage": ["bad_timeout", "untested", "skipped"]}


def _named(status: Column, names: dict[str, list[str]]) -> Column:
    return reduce(lambda c, kv: c.when(status.isin(*kv[1]), kv[0]), names.items(), F).otherwise("other")


def stryker_outcome(status: Column) -> Column:
    return F.coalesce(_named(F.lower(status), STRYKER), F.lit("other"))


def poodle_outcome(status: Column) -> Column:
    plain = F.regexp_replace(F.lower(status), "[_ ]", "")
    return F.when(plain.isin("killed", "survived"), plain).when(plain == "nocoverage", "no_coverage").otherwise("other")


def mutmut_outcome(status: Column) -> Column:
    return _named(F.coalesce(status, F.lit("untested")), MUTMUT)


def _first_of(raw: Column, names: list[str], default: str) -> Column:
    """The first name that the lower-cased text holds, or whose position it is."""
    text = F.lower(F.coalesce(raw.cast("string"), F.lit(default)))
    return reduce(lambda c, kv: c.when(text.contains(kv[1][0]) | (text == kv[1][1]), kv[1][0]), enumerate(names), F).otherwise(text)


def cosmic_outcome(worker: Column, test: Column) -> Column:
    """Killed and survived need a worker that ended normally; missing outcomes are normal and survived."""
    worker = _first_of(worker, [("normal", "0"), ("timeout", "1"), ("exception", "2")], "normal")
    test = _first_of(test, [("killed", "1"), ("survived", "0"), ("incompetent", "2")], "survived")
    return (
        F.when((worker == "normal") & test.isin("killed", "survived"), test)
        .when(worker.isin("timeout", "exception") | (test == "incompetent"), "no_coverage")
        .otherwise("other")
    )


def mutation_score(killed: Column, survived: Column) -> Column:
    """killed / (killed + survived); 0 without either. Mutants without coverage don't count."""
    return F.coalesce(F.try_divide(killed.cast("double"), (killed + survived).cast("double")), F.lit(0.0))


def reported_score(reported: Column, computed: Column) -> Column:
    """A report's own score wins; above 1 it is a percentage."""
    return F.coalesce(F.when(reported > 1, reported / 100).otherwise(reported), computed)


def mutant_source(name: Column) -> Column:
    """The source file that a mutant's file name was made from; the name itself if it follows neither pattern."""
    dotted = F.regexp_extract(name, r"^(.+?)\.mutant\.(\d+)(?:\.(.+))?$", 1)
    ending = F.regexp_extract(name, r"^(.+?)\.mutant\.(\d+)(?:\.(.+))?$", 3)
    plain = F.regexp_extract(name, r"^(.+?)_mutant_(\d+)$", 1)
    return F.when(dotted != "", F.when(ending != "", F.concat(dotted, F.lit("."), ending)).otherwise(dotted)).when(plain != "", plain).otherwise(name)


def module_to_path(module: Column) -> Column:
    return F.when(F.length(F.coalesce(module, F.lit(""))) == 0, "<unknown>").otherwise(F.concat(F.replace(module, F.lit("."), F.lit("/")), F.lit(".py")))


def path_to_module(path: Column) -> Column:
    return F.regexp_replace(F.replace(F.regexp_replace(path, r"\.py$", ""), F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")


def relative_import(importer: Column, level: Column, target: Column) -> Column:
    """Absolute name of an import with `level` dots from a module; null above the root."""
    parts = F.split(importer, r"\.")
    left = F.size(parts) - level
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), ".")
    joined = F.concat_ws(".", F.when(base != "", base), F.when(F.length(target) > 0, target))
    return F.when(level == 0, target).when(left < 0, F.lit(None).cast("string")).otherwise(joined)


def import_confidence(name: Column, level: Column) -> Column:
    return F.when(name == "*", 0.7).when(level > 0, 0.95).otherwise(1.0)


# fixed values: error patterns of each failure mode; the first mode with a match decides
TYPE = r"(?i)TypeError:|type\s+error|expected\s+type\s+\w+.*got\s+\w+|cannot\s+convert|incompatible\s+type|invalid\s+type"
PRE = r"(?i)precondition|requires?\s+.*not\s+met|invalid\s+(argument|input|parameter)|ValueError:|out\s+of\s+range"
POST = r"(?i)postcondition|ensures?\s+.*not\s+met|expected\s+.*but\s+got|return.*value.*incorrect"
INVARIANT = r"(?i)invariant|IndexError:|index\s+out\s+of\s+(bounds|range)|infinite\s+loop|recursion.*depth.*exceeded|stack\s+overflow"
ASSERTION = r"(?i)AssertionError:|assert\s+.*failed"


def failure_mode(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return (
        F.when(m.rlike(TYPE), "type_mismatch").when(m.rlike(PRE), "precondition_violation").when(m.rlike(POST), "postcondition_violation")
        .when(m.rlike(INVARIANT), "invariant_violation").when(m.rlike(ASSERTION), "postcondition_violation").otherwise("unknown")
    )


def is_overfit(passing: Column, mutation: Column) -> Column:
    return (passing >= 0.5) & ((passing - mutation) > 0.3)


def is_underfit(passing: Column) -> Column:
    return passing < 0.5


def failure_full(message: Column, passing: Column, mutation: Column) -> Column:
    """(mode, confidence) of a failure: its message, then fit, then drift."""
    mode = failure_mode(message)
    over, under = F.coalesce(is_overfit(passing, mutation), F.lit(False)), F.coalesce(is_underfit(passing), F.lit(False))
    drift = F.coalesce((passing >= 0.5) & (passing < 0.8), F.lit(False))
    final = F.when(mode != "unknown", mode).when(over, "overfitting").when(under, "underfitting").when(drift, "semantic_drift").otherwise("unknown")
    sure = F.when(mode != "unknown", 0.7).when(over, 0.8).when(under, 0.7).when(drift, 0.5).otherwise(0.3)
    return F.struct(final.alias("mode"), sure.alias("confidence"))


# fixed values: phrases that deny each other
OPPOSITES = [
    ("always", "never"), ("true", "false"), ("positive", "negative"), ("greater", "less"), ("increases", "decreases"), ("returns", "does not return"), ("handles", "does not handle"),
    ("accepts", "rejects"), ("allows", "disallows"), ("valid", "invalid"), ("none", "not none"), ("null", "not null"), ("empty", "not empty"),
]


def denies(a: Column, b: Column) -> Column:
    """Whether two statements contradict: exactly 'not x', or one of OPPOSITES on opposite sides."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    exact = (a == F.concat(F.lit("not "), b)) | (b == F.concat(F.lit("not "), a))
    has = lambda c, s: c.contains(s)
    pairs = [(has(a, p) & ~has(a, n) & has(b, n) & ~has(b, p)) | (has(b, p) & ~has(b, n) & has(a, n) & ~has(a, p)) for p, n in OPPOSITES]
    return reduce(lambda x, y: x | y, pairs, exact)


def evidence_kind(killed: Column, survived: Column, no_coverage: Column, score: Column) -> Column:
    return F.when(no_coverage > killed + survived, "mutation_no_coverage").when(score > 0.5, "mutation_killed").otherwise("mutation_survived")


def entrenchment_label(x: Column) -> Column:
    return F.when(x > 0.7, "highly entrenched").when(x > 0.4, "moderately entrenched").otherwise("weakly entrenched")


def stability_label(x: Column) -> Column:
    return F.when(x > 0.8, "very stable").when(x > 0.5, "stable").when(x > 0.2, "unstable").otherwise("highly unstable")


# fixed values: how test tools print their totals and failures
TOTALS = (r"(?is)Total tests:\s*(\d+).+Passed:\s*(\d+).+Failed:\s*(\d+)", r"(?i)Tests run:\s*(\d+)\s*,\s*Passed:\s*(\d+)\s*,\s*Failed:\s*(\d+)")
FAILING = (r"(?i)Failed\s+([\w\.\:\/\-]+)", r"(?i)\[FAIL\]\s+([\w\.\:\/\-]+)")


def test_totals(output: Column) -> Column:
    """(total, passed, failed) of a test tool's printed summary; the first form that matches, zeros without."""
    got = lambda i: F.coalesce(*[F.nullif(F.regexp_extract(output, p, i), F.lit("")).cast("long") for p in TOTALS], F.lit(0).cast("long"))
    return F.struct(got(1).alias("total"), got(2).alias("passed"), got(3).alias("failed"))


def failing_tests(output: Column) -> Column:
    """Names of failed tests line by line, repeats kept."""
    names = F.flatten(F.transform(F.split(output, "\r?\n"), lambda s: F.array(*[F.regexp_extract(s, p, 1) for p in FAILING])))
    return F.filter(names, lambda s: s != "")


def operator_for(message: Column, other: Column) -> Column:
    """The mutation operator that a counterexample's message asks for; `other` where it says nothing."""
    m = F.lower(message)
    has = lambda *words: reduce(lambda x, y: x | y, [m.contains(w) for w in words])
    return F.when(has("type", "index", "range", "bound"), "guard_insertion").when(has("assert", "expected"), "constant_tweak").when(has("wrong", "incorrect"), "operator_swap").otherwise(other)


def structural_bin(depth: Column, nodes: Column, branches: Column, variables: Column) -> Column:
    cut = lambda c, at: reduce(lambda x, i: x.when(c <= at[i], str(i)), range(len(at)), F).otherwise(str(len(at)))
    return F.concat_ws("-", cut(depth, [2, 4, 6, 8]), cut(nodes, [10, 25, 50, 100]), cut(branches, [1, 3, 5]), cut(variables, [3, 6, 10]))


def extracted_code(text: Column) -> Column:
    """The first fenced block of a model's answer, else the answer trimmed."""
    block = F.regexp_extract(text, r"(?s)```(?:\w+)?\n(.*?)```", 1)
    return F.regexp_replace(F.when(block != "", block).otherwise(text), r"^\s+|\s+$", "")
