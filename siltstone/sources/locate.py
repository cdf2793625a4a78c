"""Finding a project's mutation report, reading session databases, and one entry for all tools.

Folders are looked through on the driver, as only names are read there. Databases are read by Spark's binary source and
opened in the tasks, so that many projects' files are read at once and from any file system; a single file with a hidden
name, which Spark's readers leave out, is read by the driver.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import outcomes as o
from siltstone.sources import reports

# Where each tool leaves its report, the first that exists counts
STRYKER = ("reports/mutation/mutation.json", "reports/stryker-report.json", "stryker-report.json")
POODLE = (
    "mutation-report.json", "poodle-report.json", ".poodle-report.json", "reports/mutation-report.json",
    "reports/mutation/mutation.json", "mutation-testing-report.json",
)
COSMIC = ("cosmic-ray.json", "cosmic_ray.json", "cr-report.json")
COSMIC_CONFIG = (".cosmic-ray.toml", "cosmic-ray.toml")
MUTMUT = ".mutmut-cache"
SURVIVED = ("not-killed.txt", "notkilled.txt")
LIST_FOLDERS = ("results", "mutation_results", "mutants", ".universalmutator")
# Other spellings of the tools
SPELLINGS = {
    "stryker_js": "stryker", "mut_mut": "mutmut", "cosmic_ray": "cosmic-ray", "cosmicray": "cosmic-ray", "cosmic": "cosmic-ray",
    "poodle_test": "poodle", "universal_mutator": "universalmutator", "um": "universalmutator",
}


class Unsupported(ValueError):
    """No reader for the tool."""


def _first(folder: Path, names: tuple[str, ...]) -> Path | None:
    return next((folder / n for n in names if (folder / n).exists()), None)


def _is_report(path: Path) -> bool:
    try:
        whole = json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return False
    files = whole.get("files") if isinstance(whole, dict) and "schemaVersion" in whole else None
    return isinstance(files, dict) and any(isinstance(f, dict) and "mutants" in f for f in files.values())


def _session(folder: Path) -> Path | None:
    dump = _first(folder, COSMIC)
    if dump:
        return dump
    for pattern in ("*.sqlite", ".cosmic-ray*.sqlite"):
        if found := list(folder.glob(pattern)):
            return max(found, key=lambda p: p.stat().st_mtime)
    for config in filter(Path.is_file, (folder / n for n in COSMIC_CONFIG)):
        for line in config.read_text(encoding="utf-8", errors="replace").splitlines():
            if line.strip().startswith("session-file"):
                named = folder / line.partition("=")[2].strip().strip("'\"")
                if named.is_file():
                    return named
    return None


def find_report(folder: str, tool: str) -> str | None:
    """The path of a tool's report at or below a folder (mutmut's also up to three folders above), None without one.

    Of a mutation list tool it is the folder that holds the lists.
    """
    at = Path(folder).resolve()
    if tool == "stryker":
        found = _first(at, STRYKER)
    elif tool == "poodle":
        found = _first(at, POODLE) or next(filter(_is_report, sorted(at.glob("*.json"))), None)
    elif tool == "mutmut":
        found = next((p / MUTMUT for p in [at, *at.parents][:4] if (p / MUTMUT).exists()), None)
    elif tool == "cosmic-ray":
        found = _session(at)
    elif tool == "universalmutator":
        found = next((p for p in (at, *(at / n for n in LIST_FOLDERS)) if _first(p, ("killed.txt", *SURVIVED))), None)
    else:
        raise Unsupported(f"no reader for {tool!r}; there are {', '.join(reports.TOOLS)}")
    return str(found) if found else None


def _opened(spark: SparkSession, path: str, attempts: tuple[str, ...], schema: str) -> DataFrame:
    """Rows of the first query that a database answers with any; databases that answer none give no rows."""
    names = [c.split()[0] for c in schema.split(", ")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame.content:
                rows: list[tuple] = []
                base = sqlite3.connect(":memory:")
                try:
                    base.deserialize(content)
                    for query in attempts:
                        try:
                            rows = base.execute(query).fetchall()
                        except sqlite3.OperationalError:
                            continue
                        if rows:
                            break
                finally:
                    base.close()
                yield pd.DataFrame(rows, columns=names)

    if reports.hidden(path):
        return spark.createDataFrame([(Path(path).read_bytes(),)], "content binary").mapInPandas(batches, schema)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(batches, schema)


def mutmut_cache(spark: SparkSession, path: str) -> DataFrame:
    """Mutants of mutmut's databases: three joined tables, or the older flat one where those are missing or empty.

    A null status is untested. A file that is no database raises; one of another layout gives no rows.
    """
    joined = (
        "select filename, cast(line_number as integer), lower(coalesce(nullif(status, ''), 'untested')) from mutant"
        " join line on line.id = mutant.line_id join sourcefile on sourcefile.id = line.sourcefile_id"
    )
    flat = "select filename, cast(line_number as integer), lower(coalesce(nullif(status, ''), 'untested')) from mutant"
    read = _opened(spark, path, (joined, flat), "file_path string, line bigint, status_raw string")
    return read.select(F.lit("mutmut").alias("tool"), "file_path", "line", "status_raw", o.mutmut_outcome(F.col("status_raw")).alias("outcome"))


def cosmic_session(spark: SparkSession, path: str) -> DataFrame:
    """Mutants of cosmic-ray's databases: work items, or specifications left joined to results in older ones.

    A position is a line or "(line, column)"; a specification without a result takes the default outcomes.
    """
    place = "cast(case when instr(start_pos, ',') then ltrim(substr(start_pos, 1, instr(start_pos, ',') - 1), '( ') else start_pos end as integer)"
    newer = f"select module, {place}, worker_outcome, test_outcome from work_items"
    older = "select module_path, line_number, worker_outcome, test_outcome from mutation_specs left join results using (job_id)"
    return reports.cosmic_ray(_opened(spark, path, (newer, older), "module string, line_number bigint, worker_outcome string, test_outcome string"))


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    at = Path(folder)
    none, hidden = spark.createDataFrame([], "value string"), reports.hidden(folder)
    read = lambda p: none if not p or not p.exists() else spark.createDataFrame([(x,) for x in p.read_text().splitlines()], "value string") if hidden else spark.read.text(str(p))
    return reports.universalmutator(read(at / "killed.txt"), read(_first(at, SURVIVED)))


def tool_name(tool: str) -> str:
    """The tool that a spelling means; Unsupported for others."""
    plain = tool.lower().replace("-", "_").replace(" ", "_")
    known = SPELLINGS.get(plain, plain)
    if known not in reports.TOOLS:
        raise Unsupported(f"no reader for {tool!r}; there are {', '.join(reports.TOOLS)}")
    return known


def detected_tool(folder: str) -> str | None:
    """The first tool, in the order of reports.TOOLS, whose report is found."""
    return next((t for t in reports.TOOLS if find_report(folder, t)), None)


def mutants(spark: SparkSession, folder: str, tool: str | None = None, report: str | None = None) -> DataFrame:
    """mutants(tool, file_path, line, status_raw, outcome) of a project: of the given tool or the one that is detected.

    Unsupported is raised for unknown tools and where none is detected, FileNotFoundError where the report is missing.
    """
    name = tool_name(tool) if tool is not None else detected_tool(folder)
    if name is None:
        raise Unsupported(f"no tool detected in {folder}; there are {', '.join(reports.TOOLS)}")
    path = report or find_report(folder, name)
    if path is None or not Path(path).exists():
        raise FileNotFoundError(f"no report of {name} in {folder}")
    if name == "universalmutator":
        return _lists(spark, path)
    if name == "mutmut":
        return mutmut_cache(spark, path)
    if name == "cosmic-ray":
        return reports.cosmic_ray_json(spark, path) if path.endswith(".json") else cosmic_session(spark, path)
    return reports.report_json(spark, path, name)
