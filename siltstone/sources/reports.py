"""Readers of mutation reports, run logs and session tables; all give mutants(tool, file_path, line, status_raw, outcome)."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import outcomes as o

_MUTANT = "array<struct<id:string,status:string,location:struct<start:struct<line:bigint>>>>"
REPORT = f"struct<mutationScore:double,files:map<string,struct<mutants:{_MUTANT}>>,mutantResults:array<struct<status:string>>>"
RUN = (
    "id string, projectId string, commitSha string, regionId string, timestamp timestamp, kind string, passed boolean, totalTests bigint, passedTests bigint, failedTests bigint, durationMs bigint,"
    " framework string, failingTests array<string>, tool string, totalMutants bigint, killed bigint, survived bigint, noCoverage bigint, mutationScore double, runtimeMs bigint, byFile array<struct<"
    "filePath:string,totalMutants:bigint,killed:bigint,survived:bigint,noCoverage:bigint,mutationScore:double>>, _corrupt_record string"
)
OUTCOME = {"stryker": o.stryker_outcome, "poodle": o.poodle_outcome}
TOOLS = ("stryker", "poodle", "mutmut", "cosmic-ray", "universalmutator")


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs of a JSON-lines log; blank and malformed lines, and kinds other than test and mutation runs, are left out."""
    read = spark.read.schema(RUN).option("mode", "PERMISSIVE").json(path)
    return read.where("_corrupt_record is null and kind is not null and id is not null").drop("_corrupt_record")


def append_runs(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def hidden(path: str) -> bool:
    """Whether Spark's readers would leave a local file out for its name."""
    return Path(path).name.startswith((".", "_")) and Path(path).exists()


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([(Path(path).read_text(encoding="utf-8"),)], "value string") if hidden(path) else spark.read.text(path, wholetext=True)


def report_json(spark: SparkSession, path: str, tool: str = "stryker") -> DataFrame:
    """Mutants of Stryker or Poodle JSON reports; the flat form's mutants belong to the file <all>.

    A file without mutants gives one row without a status, whose outcome is null: it counts as a file and as no mutant.
    """
    whole = _whole(spark, path).select(F.from_json("value", REPORT).alias("r"))
    files = whole.select(F.explode("r.files").alias("file_path", "f")).select("file_path", F.explode_outer("f.mutants").alias("m"))
    nested = files.select("file_path", F.col("m.location.start.line").alias("line"), F.col("m.status").alias("status_raw"))
    flat = whole.where("r.files is null").select(F.explode("r.mutantResults").alias("m")).select(F.lit("<all>").alias("file_path"), F.lit(None).cast("bigint").alias("line"), F.col("m.status").alias("status_raw"))
    return nested.unionByName(flat).select(F.lit(tool).alias("tool"), "file_path", "line", "status_raw", OUTCOME[tool](F.col("status_raw")).alias("outcome"))


def report_score(spark: SparkSession, path: str) -> DataFrame:
    """The report's own score, as a fraction."""
    whole = _whole(spark, path).select(F.from_json("value", REPORT).alias("r"))
    return whole.select(o.reported_score(F.col("r.mutationScore"), F.lit(None).cast("double")).alias("mutation_score"))


def mutmut(mutant: DataFrame, line: DataFrame, sourcefile: DataFrame) -> DataFrame:
    """mutmut's three tables, joined by their ids."""
    m = mutant.select("line_id", F.coalesce("status", F.lit("untested")).alias("status_raw"))
    at = m.join(line.select(F.col("id").alias("lid"), "sourcefile_id", "line_number"), F.col("line_id") == F.col("lid"))
    at = at.join(sourcefile.select(F.col("id").alias("sid"), "filename"), F.col("sourcefile_id") == F.col("sid"))
    return at.select(F.lit("mutmut").alias("tool"), F.col("filename").alias("file_path"), F.col("line_number").cast("long").alias("line"), "status_raw", o.mutmut_outcome(F.col("status_raw")).alias("outcome"))


def cosmic_ray(items: DataFrame) -> DataFrame:
    """cosmic-ray work items (module, line or start_pos "(line, col)", worker_outcome, test_outcome)."""
    line = F.coalesce(F.col("line_number").cast("long") if "line_number" in items.columns else F.lit(None).cast("long"), (F.nullif(F.regexp_extract("start_pos", r"\((\d+)", 1), F.lit("")).cast("long") if "start_pos" in items.columns else F.lit(None).cast("long")))
    return items.select(F.lit("cosmic-ray").alias("tool"), o.module_to_path(F.col("module")).alias("file_path"), line.alias("line"), F.col("test_outcome").cast("string").alias("status_raw"), o.cosmic_outcome(F.col("worker_outcome"), F.col("test_outcome")).alias("outcome"))


def cosmic_ray_json(spark: SparkSession, path: str) -> DataFrame:
    schema = "module string, operator string, occurrence int, line_number int, job_id string, test_outcome string, worker_outcome string, diff string"
    return cosmic_ray(spark.read.schema(schema).option("multiLine", True).json(path))


def universalmutator(killed: DataFrame, survived: DataFrame) -> DataFrame:
    """Lists of mutant file names (value), one a line; blank lines and # comments are skipped."""
    both = killed.select(F.trim("value").alias("name"), F.lit("killed").alias("outcome")).unionAll(survived.select(F.trim("value").alias("name"), F.lit("survived").alias("outcome")))
    kept = both.where("name <> '' and name not like '#%'")
    return kept.select(F.lit("universalmutator").alias("tool"), o.mutant_source(F.col("name")).alias("file_path"), F.lit(None).cast("long").alias("line"), F.col("name").alias("status_raw"), "outcome")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*.py") -> DataFrame:
    """path, content_hash of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.sha2("content", 256).alias("content_hash"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL("tool string, file_path string, line bigint, status_raw string, outcome string"))
