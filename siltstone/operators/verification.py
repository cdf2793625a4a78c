"""Bounded checks of integer constraints, and budgets by tier."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: a name, a comparison, and a name or a decimal or hexadecimal number
CONSTRAINT = r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*(==|!=|<=|>=|<|>)\s*([A-Za-z_][A-Za-z0-9_]*|0x[0-9a-fA-F]+|-?\d+)\s*$"
_FLIPPED = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}


def parsed(constraint: Column) -> Column:
    """(lhs, op, rhs) of a comparison, null where the text is none."""
    part = lambda i: F.regexp_extract(constraint, CONSTRAINT, i)
    return F.when(constraint.rlike(CONSTRAINT), F.struct(part(1).alias("lhs"), part(2).alias("op"), part(3).alias("rhs")))


def _number(text: str) -> int | None:
    if text[0].isalpha() or text[0] == "_":
        return None
    return int(text, 16) if text.startswith("0x") else int(text)


def decide(constraints: list[str], bits: int = 32) -> tuple[str, str]:
    """(status, model) of a conjunction over unsigned integers of `bits` bits (negative numbers wrap): counterexample with a model, no_ce, or unknown.

    Bounds are propagated through comparisons of names and numbers to a fixpoint; a model of least values is then
    checked against every constraint. Texts that are no comparison make the answer unknown rather than being dropped.
    """
    rules, low, high = [], {}, {}
    for text in constraints or []:
        m = re.match(CONSTRAINT, text or "")
        if not m:
            return "unknown", ""
        a, op, b = m.groups()
        rules += [(a, op, b), (b, _FLIPPED[op], a)]
        for x in (a, b):
            n = _number(x)
            low[x], high[x] = (n % 2**bits, n % 2**bits) if n is not None else (0, 2**bits - 1)
    for _ in range(4 * len(rules) + 4):
        before = dict(low), dict(high)
        for a, op, b in rules:
            if op in ("<", "<=", "=="):
                high[a] = min(high[a], high[b] - (op == "<"))
            if op in (">", ">=", "=="):
                low[a] = max(low[a], low[b] + (op == ">"))
            if op == "!=" and low[b] == high[b]:
                low[a] += low[a] == low[b] and _number(a) is None
                high[a] -= high[a] == high[b] and _number(a) is None
        if any(low[x] > high[x] for x in low):
            return "no_ce", ""
        if (low, high) == before:
            break
    test = {"==": int.__eq__, "!=": int.__ne__, "<": int.__lt__, "<=": int.__le__, ">": int.__gt__, ">=": int.__ge__}
    if all(test[op](low[a], low[b]) for a, op, b in rules):
        return "counterexample", ",".join(f"{x}={low[x]}" for x in sorted(low) if _number(x) is None)
    return "unknown", ""


def solve(requests: DataFrame, bits: int = 32) -> DataFrame:
    """requests(request, constraints array<string>) with status and model."""

    @F.pandas_udf("status string, model string")
    def decided(lists: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decide(list(c) if c is not None else [], bits) for c in lists], columns=["status", "model"])

    return requests.withColumn("d", decided("constraints")).select(*[c for c in requests.columns], "d.status", "d.model")


def escalate(budget: Column, factor: float) -> Column:
    """A budget struct with every limit scaled and cut to a whole number."""
    fields = ("timeout_s", "max_states", "max_path_len", "max_loop_iters")
    return F.struct(*[F.floor(budget[f] * factor).cast("long").alias(f) for f in fields])


def harness(function: Column, symbols: Column) -> Column:
    """C text of a harness that calls a function with symbolic arguments: symbols is an array of (name, type)."""
    declared = F.array_join(F.transform(symbols, lambda s: F.concat(F.lit("    "), s["type"], F.lit(" "), s["name"], F.lit(";\n    make_symbolic(&"), s["name"], F.lit(", sizeof("), s["name"], F.lit("));"))), "\n")
    called = F.array_join(F.transform(symbols, lambda s: s["name"]), ", ")
    return F.concat(F.lit("int main(void) {\n"), declared, F.lit("\n    "), function, F.lit("("), called, F.lit(");\n    return 0;\n}\n"))
