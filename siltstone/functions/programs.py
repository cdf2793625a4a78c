"""Features and mutations of Python program texts, as Arrow-batched functions."""

from __future__ import annotations

import ast
import random

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = "is_valid boolean, ast_depth long, node_count long, branch_count long, func_count long, var_count long, complexity double"
OPERATORS = ("constant_tweak", "operator_swap", "guard_insertion", "branch_flip")
_SWAPS = {ast.Add: ast.Sub, ast.Sub: ast.Add, ast.Mult: ast.FloorDiv, ast.FloorDiv: ast.Mult, ast.Lt: ast.LtE, ast.LtE: ast.Lt, ast.Gt: ast.GtE, ast.GtE: ast.Gt, ast.Eq: ast.NotEq, ast.NotEq: ast.Eq, ast.And: ast.Or, ast.Or: ast.And}


def _tree(text: str | None) -> ast.Module | None:
    try:
        return ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def features_of(text: str | None) -> tuple:
    tree = _tree(text)
    if tree is None:
        return False, 0, 0, 0, 0, 0, 1.0
    depth, nodes, level = 0, [], [tree]
    while level:
        nodes += level
        level = [c for n in level for c in ast.iter_child_nodes(n)]
        depth += bool(level)
    of = lambda *kinds: sum(isinstance(n, kinds) for n in nodes)
    names = {n.id for n in nodes if isinstance(n, ast.Name)}
    return True, depth, len(nodes), of(ast.If, ast.For, ast.While), of(ast.FunctionDef, ast.AsyncFunctionDef), len(names), min(len(nodes) / 100, 1.0)


def features(text: Column) -> Column:
    """A struct of FEATURES for a column of program texts; text that doesn't parse is invalid, of complexity 1."""

    @F.pandas_udf(FEATURES)
    def measured(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features_of(t) for t in texts], columns=[c.split()[0] for c in FEATURES.split(", ")])

    return measured(text)


def mutate(text: str | None, operator: str, seed: int) -> str | None:
    """The text after one mutation; as it was where the operator finds nothing to change or the text doesn't parse."""
    tree = _tree(text)
    if tree is None:
        return text
    rng, nodes = random.Random(seed), list(ast.walk(tree))
    if operator == "constant_tweak":
        found = [n for n in nodes if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool)]
        if found:
            rng.choice(found).value += rng.choice((-1, 1))
    elif operator == "operator_swap":
        found = [n for n in nodes if isinstance(n, ast.BinOp | ast.BoolOp) and type(n.op) in _SWAPS or isinstance(n, ast.Compare) and type(n.ops[0]) in _SWAPS]
        if found:
            n = rng.choice(found)
            if isinstance(n, ast.Compare):
                n.ops[0] = _SWAPS[type(n.ops[0])]()
            else:
                n.op = _SWAPS[type(n.op)]()
    elif operator == "guard_insertion":
        found = [n for n in nodes if isinstance(n, ast.FunctionDef) and n.args.args]
        if found:
            n = rng.choice(found)
            n.body.insert(0, ast.parse(f"if {rng.choice(n.args.args).arg} is None:\n    return None").body[0])
    elif operator == "branch_flip":
        found = [n for n in nodes if isinstance(n, ast.If | ast.While | ast.IfExp)]
        if found:
            n = rng.choice(found)
            n.test = ast.UnaryOp(op=ast.Not(), operand=n.test)
    else:
        raise ValueError(f"unknown operator {operator!r}")
    return ast.unparse(ast.fix_missing_locations(tree))


def mutated(text: Column, operator: Column, seed: Column) -> Column:
    @F.pandas_udf("string")
    def changed(texts: pd.Series, operators: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([mutate(t, o, int(s)) for t, o, s in zip(texts, operators, seeds, strict=True)], dtype="object")

    return changed(text, operator, seed)


def cross(a: str | None, b: str | None, seed: int) -> str | None:
    """The first text with one of its statements replaced by a statement of the same kind from the second."""
    x, y = _tree(a), _tree(b)
    if x is None or y is None:
        return a
    rng = random.Random(seed)
    donors = [n for n in ast.walk(y) if isinstance(n, ast.stmt)]
    places = [(body, i, [d for d in donors if type(d) is type(s)]) for n in ast.walk(x) if isinstance(body := getattr(n, "body", None), list) for i, s in enumerate(body)]
    places = [p for p in places if p[2]]
    if places:
        body, i, fitting = rng.choice(places)
        body[i] = rng.choice(fitting)
    return ast.unparse(ast.fix_missing_locations(x))


def crossed(a: Column, b: Column, seed: Column) -> Column:
    @F.pandas_udf("string")
    def made(x: pd.Series, y: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([cross(p, q, int(s)) for p, q, s in zip(x, y, seeds, strict=True)], dtype="object")

    return made(a, b, seed)
