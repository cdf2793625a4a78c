"""Definitions, calls and imports of Python sources, one Arrow batch of files at a time."""

from __future__ import annotations

import ast
import builtins
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "path string, source_id string, target_id string, kind string, confidence double, line long"
IMPORTS = "path string, importer string, module string, name string, level int, line long"
NODES = (
    "path string, id string, name string, kind string, line long, end_line long, params array<string>, returns string, decorators array<string>, is_async boolean, is_generator boolean, docstring string"
)


_BUILTINS = frozenset(dir(builtins))


class _Calls(ast.NodeVisitor):
    """DEFINES, INHERITS and CALLS edges of one module; calls resolve in the order local, built-in, unknown."""

    def __init__(self, module: str, known: set[str]):
        self.module, self.known, self.scope, self.edges, self.types = module, known, [module], [], [{}]

    def add(self, target: str, kind: str, sure: float, line: int) -> None:
        self.edges.append((".".join(self.scope), target, kind, sure, line))

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        name = ".".join([*self.scope, node.name])
        self.add(name, "defines", 1.0, node.lineno)
        for base in node.bases:
            if isinstance(base, ast.Name):
                self.edges.append((name, self.resolve(base.id) or base.id, "inherits", 0.8, node.lineno))
            elif isinstance(base, ast.Attribute):
                self.edges.append((name, ast.unparse(base), "inherits", 0.5, node.lineno))
        self.inside(node)

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        self.add(".".join([*self.scope, node.name]), "defines", 1.0, node.lineno)
        self.inside(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def inside(self, node: ast.AST) -> None:
        self.scope.append(node.name)
        self.types.append({})
        for child in ast.iter_child_nodes(node):
            self.visit(child)
        self.types.pop()
        self.scope.pop()

    def resolve(self, name: str) -> str | None:
        return next((full for i in range(len(self.scope), 0, -1) if (full := ".".join([*self.scope[:i], name])) in self.known), None)

    def visit_Assign(self, node: ast.Assign) -> None:
        if isinstance(node.value, ast.Call) and isinstance(f := node.value.func, ast.Name) and f.id[:1].isupper():
            self.types[-1].update({t.id: f.id for t in node.targets if isinstance(t, ast.Name)})
        self.generic_visit(node)

    def visit_Call(self, node: ast.Call) -> None:
        f = node.func
        if isinstance(f, ast.Name):
            full = self.resolve(f.id)
            builtin = f.id in _BUILTINS
            self.add(full or (f"builtins.{f.id}" if builtin else f.id), "calls", 1.0 if full or builtin else 0.5, node.lineno)
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            owner = f.value.id
            kind = next((t[owner] for t in reversed(self.types) if owner in t), None)
            full = self.resolve(kind or owner)
            if owner == "self" and len(self.scope) > 2:
                self.add(".".join([*self.scope[:-1], f.attr]), "calls", 0.9, node.lineno)
            elif kind:
                self.add(f"{full or kind}.{f.attr}", "calls", 0.8, node.lineno)
            else:
                self.add(f"{full or owner}.{f.attr}", "calls", 0.9 if full else 0.4, node.lineno)
        elif isinstance(f, ast.Attribute):
            self.add(f"<dynamic>.{f.attr}", "calls", 0.3, node.lineno)
        self.generic_visit(node)


def _definitions(tree: ast.AST, prefix: str) -> Iterator[str]:
    for node in ast.iter_child_nodes(tree):
        if isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            yield (name := f"{prefix}.{node.name}")
            yield from _definitions(node, name)
        else:
            yield from _definitions(node, prefix)


#: stands for the module in what is kept of a text; no name can hold it
_MODULE = "\0"


@lru_cache(64)
def _edges(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    walker = _Calls(_MODULE, set(_definitions(tree, _MODULE)))
    walker.visit(tree)
    return walker.edges


def edges_of(path: str, module: str, source: str) -> list[tuple]:
    named = lambda x: module + x[1:] if x.startswith(_MODULE) else x
    return [(path, named(scope), named(target), *rest) for scope, target, *rest in _edges(source or "")]


@lru_cache(64)
def _imports(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(a.name, None, 0, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(node.module, a.name, node.level, node.lineno) for a in node.names]
    return out


def imports_of(path: str, module: str, source: str) -> list[tuple]:
    return [(path, module, *x) for x in _imports(source or "")]


def _extracted(files: DataFrame, schema: str, of) -> DataFrame:
    """of(path, module, source) of files(path, source), as rows; files that don't parse give none.

    Files are dealt over the shuffle's partitions first: a table of millions of them can be one split of a small Parquet file.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for x in frame.itertuples() for r in of(x.path, x.module, x.source)]
            yield pd.DataFrame(rows, columns=names)

    module = F.regexp_replace(F.replace(F.regexp_replace("path", r"\.py$", ""), F.lit("/"), F.lit(".")), r"(^|\.)__init__$", "")
    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return files.select("path", module.alias("module"), "source").repartition(tasks, "path").mapInPandas(batches, schema)


def call_edges(files: DataFrame) -> DataFrame:
    return _extracted(files, EDGES, edges_of)


def imports(files: DataFrame) -> DataFrame:
    return _extracted(files, IMPORTS, imports_of)


def _parameters(a: ast.arguments) -> list[str]:
    star = [f"*{a.vararg.arg}"] if a.vararg else []
    return [x.arg for x in a.posonlyargs + a.args] + star + [x.arg for x in a.kwonlyargs] + ([f"**{a.kwarg.arg}"] if a.kwarg else [])


def _named(node: ast.AST, prefix: str, in_class: bool) -> Iterator[tuple]:
    """Node rows below a node, each scope before what it holds; lambdas are named by their line."""
    for child in ast.iter_child_nodes(node):
        if isinstance(child, ast.ClassDef):
            marks = [ast.unparse(d) for d in child.decorator_list]
            yield (full := f"{prefix}.{child.name}"), child.name, "class", child.lineno, child.end_lineno, [], None, marks, False, False, ast.get_docstring(child)
            yield from _named(child, full, True)
        elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
            marks = [ast.unparse(d) for d in child.decorator_list]
            gives = any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(child))
            returned = ast.unparse(child.returns) if child.returns else None
            kind = "method" if in_class else "function"
            yield (full := f"{prefix}.{child.name}"), child.name, kind, child.lineno, child.end_lineno, _parameters(child.args), returned, marks, isinstance(child, ast.AsyncFunctionDef), gives, ast.get_docstring(child)
            yield from _named(child, full, False)
        elif isinstance(child, ast.Lambda):
            name = f"<lambda:{child.lineno}:{child.col_offset}>"
            yield (full := f"{prefix}.{name}"), name, "lambda", child.lineno, child.end_lineno, _parameters(child.args), None, [], False, False, None
            yield from _named(child, full, False)
        else:
            yield from _named(child, prefix, in_class)


def nodes_of(path: str, module: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    top = (module, module.rsplit(".", 1)[-1], "module", 1, len((source or "").splitlines()), [], None, [], False, False, ast.get_docstring(tree))
    return [(path, *row) for row in (top, *_named(tree, module, False))]


def definitions(files: DataFrame) -> DataFrame:
    """The node table: modules, classes, functions, methods and lambdas with their signatures.

    A generator is a function with a yield anywhere below it, inner functions included. Of names defined twice in a file
    each definition is a row; files that don't parse give none.
    """
    return _extracted(files, NODES, nodes_of)


def is_external(module: Column, local: list[str]) -> Column:
    """Whether a module is the standard library's or not below one of the local top-level packages."""
    top = F.substring_index(module, ".", 1)
    return top.isin(*sorted(sys.stdlib_module_names)) | ~top.isin(*local)


def source_files(spark: SparkSession, folder: str, pattern: str = "*.py", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (relative to the folder), source of the files below it; paths that contain an excluded part are left out."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    inside = F.element_at(F.split("path", re.escape(folder.rstrip("/").removeprefix("file:")) + "/", 2), -1)
    found = read.select(inside.alias("path"), F.col("content").cast("string").alias("source"))
    for part in exclude:
        found = found.where(~F.contains("path", F.lit(part)))
    return found
