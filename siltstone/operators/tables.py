"""Snapshots and stores as tables: diffs, upserts, cascading deletes, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def file_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, change (added, removed, modified) between two snapshots (path, content_hash); one full outer join."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change is not null")


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, that of the largest `order`."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").drop("nth")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows added or put in their place; later rows of new win by `seq`."""
    both = old.withColumn("seq", F.lit(-1).cast("long")).unionByName(new)
    return keep_last(both, keys, "seq").drop("seq")


def delete_cascade(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes(id, file_path) and edges(source_id, target_id) without those of files(file_path)."""
    gone = nodes.join(files, "file_path", "left_semi").select(F.col("id").alias("gone"))
    left = nodes.join(gone, F.col("id") == F.col("gone"), "left_anti")
    kept = edges.join(gone, F.col("source_id") == F.col("gone"), "left_anti").join(gone, F.col("target_id") == F.col("gone"), "left_anti")
    return left, kept


def incremental_apply(old: DataFrame, new: DataFrame, nodes: DataFrame, extracted: DataFrame) -> DataFrame:
    """nodes(id, file_path) after an update: those of removed and modified files go, newly extracted ones come."""
    changes = file_changes(old, new)
    stale = changes.where("change <> 'added'").select(F.col("path").alias("file_path"))
    fresh = changes.where("change <> 'removed'").select(F.col("path").alias("file_path"))
    return nodes.join(stale, "file_path", "left_anti").select("id", "file_path").unionByName(extracted.join(fresh, "file_path", "left_semi").select("id", "file_path"))


def resolve_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """name, status (resolved, ambiguous, not_found), id, n for names(name): exact id first, else name or dotted suffix.

    The suffixes of every id are exploded, so the lookup is an equi-join.
    """
    parts = F.split("id", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = nodes.select("id", F.explode(F.array_distinct(F.concat(F.array("name"), suffixes))).alias("as_name"))
    hits = names.join(known, F.col("name") == F.col("as_name"), "left").groupBy("name").agg(
        F.count("id").alias("n"), F.min("id").alias("least"), F.max(F.when(F.col("id") == F.col("name"), F.col("id"))).alias("exact")
    )
    status = F.when(F.col("exact").isNotNull() | (F.col("n") == 1), "resolved").when(F.col("n") == 0, "not_found").otherwise("ambiguous")
    return hits.select("name", status.alias("status"), F.when(status == "resolved", F.coalesce("exact", "least")).alias("id"), "n")


def longest_prefix(targets: DataFrame, modules: DataFrame) -> DataFrame:
    """target, module: the longest known module that a dotted import target begins with."""
    parts = F.split("target", r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), ".").alias("prefix")))
    tried = targets.select("target", F.explode(prefixes).alias("t"))
    return tried.join(modules, F.col("t.prefix") == F.col("module")).groupBy("target").agg(F.max_by("module", F.col("t.depth")).alias("module"))


def detect_languages(files: DataFrame, extensions: DataFrame, configs: DataFrame) -> DataFrame:
    """project, language, weight, share, rank: extension counts, and 50 for each telling config file.

    files(project, path), extensions(ext, language), configs(name, language).
    """
    named = files.select("project", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).alias("ext"))
    by_ext = named.join(F.broadcast(extensions), "ext").groupBy("project", "language").agg(F.count("*").alias("weight"))
    by_config = named.join(F.broadcast(configs), "name").groupBy("project", "language").agg((F.count_distinct("name") * 50).alias("weight"))
    both = by_ext.unionByName(by_config).groupBy("project", "language").agg(F.sum("weight").alias("weight"))
    whole, order = Window.partitionBy("project"), Window.partitionBy("project").orderBy(F.desc("weight"), "language")
    return both.select("project", "language", "weight", (F.col("weight") / F.sum("weight").over(whole)).alias("share"), F.row_number().over(order).cast("long").alias("rank"))


def detect_frameworks(files: DataFrame, signals: DataFrame) -> DataFrame:
    """project, framework, confidence, path: the first signal of each framework that a project has.

    files(project, path), signals(framework, path, confidence, ordinal).
    """
    first = Window.partitionBy("project", "framework").orderBy("ordinal")
    hits = files.join(F.broadcast(signals), "path").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return hits.select("project", "framework", "confidence", "path")


def recommend(detected: DataFrame, languages: DataFrame) -> DataFrame:
    """project, framework, confidence: the surest detection, else by the main language."""
    best = Window.partitionBy("project").orderBy(F.desc("confidence"), "framework")
    found = detected.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("project", F.col("framework").alias("f"), F.col("confidence").alias("c"))
    main = languages.where("rank = 1").select("project", "language")
    usual = F.when(F.col("language") == "python", "mutmut").when(F.col("language").isin("javascript", "typescript"), "stryker").otherwise("unknown")
    sure = F.when(F.col("language").isin("python", "javascript", "typescript"), 0.6).when(F.col("language") == "java", 0.3).otherwise(0.0)
    return main.join(found, "project", "full").select("project", F.coalesce("f", usual).alias("framework"), F.coalesce("c", sure).alias("confidence"))


def ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
