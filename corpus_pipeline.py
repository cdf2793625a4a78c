"""A corpus pipeline of five stages; each works on all that the one before kept.

Stages 1 to 4 filter documents and return their columns; the last packs what is left. Each result is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, jaccard_join, packing, quality, toxicity
from siltstone.llm.common import bitmap_of, columns, fresh, keep, sift, small_batches, table, without

#: near duplicates: word shingles of five, a similarity of at least 0.8
WIDTH, NUM, DEN = 5, 80, 100


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't predict to be toxic.

    Null, empty and very long texts are scored whole like any other; equal texts share their fate; extra columns of any
    name come back as they were; an empty table stays empty. Without labels of both kinds nothing is rejected.
    """
    small_batches(spark)
    model = toxicity.fit(toxicity.sample(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")))
    return docs.where(toxicity.toxicity_score(F.col("text"), model) < toxicity.CUT)


def of_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's band of perplexity.

    Null and empty texts are kept; a null lang is a language; repeated rows share their fate; long texts are read whole;
    extra columns of any name come back as they were; an empty table stays empty.
    """
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the least id. Rows equal in id and text count as copies.

    Texts without words (null, empty, blank) have no copies but repeated rows; a null id comes after all others; extra
    columns of any name come back as they were; an empty table stays empty.
    """
    named = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    linked = keep(jaccard_join.link(docs.select("doc_id", "text"), WIDTH, NUM, DEN).select("text_id", "is_first"), "linked")
    one = without(docs, named, linked.where("not is_first").select("text_id").distinct())
    repeated = keep(linked.where("is_first").groupBy("text_id").count().where("count > 1").select("text_id"), "repeated")
    if not repeated.isEmpty():
        name = fresh(docs, "text_id")
        some = sift(one.withColumn(name, named), F.col(name), bitmap_of(repeated, F.col("text_id")))
        again = some.join(repeated.toDF(name), name, "left_semi").dropDuplicates([name]).drop(name)
        one = without(one, named, repeated).unionByName(again)
    return one.select(*columns(docs))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, by built-in functions only.

    Null and empty texts contain nothing and stay; all rows of a leaking id go; long texts are searched whole; extra
    columns of any name come back as they were; an empty table stays empty, and without items all stay.
    """
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, each window with the mixture of the sources.

    Null texts are empty (their end id alone); repeated rows are packed each; long texts are cut into pieces; extra
    columns are ignored; an empty table gives no pieces.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("quality classifier", of_quality),
    ("n-gram Jaccard join", without_copies),
    ("benchmark decontamination", without_leaks),
    ("packing", packed),
]
#: SQL can't express compression distance, tokenizers or the packing order
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = keep(docs, name.replace(" ", "-"))
    return docs
