"""Quality by an interpolated modified Kneser-Ney model of characters, order 4, trained on trusted text.

kneser_ney has the model: all characters are symbols, counts are summed over all trusted documents, and documents'
distinct n-grams are joined to them in shards. (`train` and `Model` here are the same model over 64 symbols as one dense
table, for small alphabets; the query doesn't use them.)

A document's perplexity is taken over its whole text. It is kept if it lies within the band of its language: between a
low and a high quantile of the trusted documents' perplexities, each widened by a margin that grows as texts get
shorter. Texts that repeat common words lie below the band, those that repeat rare ones above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import kneser_ney
from siltstone.llm.common import bitmap_of, forget, frees, keep, sift, small_batches, table, without

SIZE, ORDER = 64, 4
BORDER, OTHER = 0, 1
#: bands of so many languages are broadcast; beyond, they are joined by a shuffle
MOST_TONGUES = 10_000


@dataclass(frozen=True)
class Band:
    """Quantiles of trusted perplexity by language, and the factors by which the band is wider."""

    low: float = 0.02
    high: float = 0.98
    margin: float = 1.05
    #: a text may hold so many bits of surprise, or lack of it, beyond the margin in all: one odd name rejects nobody
    spare: float = 40.0
    #: below so many characters the spare bits grow in inverse proportion
    short: int = 64
    #: a language with fewer trusted documents uses the quantiles of all languages
    least: int = 50
    accuracy: int = 10_000
    #: of so many trusted texts one sets the bands and isn't fitted
    apart: int = 3


@dataclass(frozen=True)
class Model:
    symbols: np.ndarray  # code points, the first is symbol 2
    grams: np.ndarray
    shares: np.ndarray
    back_off: np.ndarray
    lower: np.ndarray

    def table(self) -> np.ndarray:
        """log2 P(d | a b c) for all 64^4 n-grams, float32."""
        half = SIZE ** (ORDER - 2)
        p = (self.back_off.reshape(SIZE, half, 1) * self.lower.reshape(1, half, SIZE)).reshape(-1)
        p[self.grams] += self.shares
        return np.log2(p, out=p)


def _code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and each text's length."""
    points = [np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    return np.concatenate(points) if points else np.zeros(0, "<u4"), np.array([len(p) for p in points], np.int64)


def _grams(texts: list[str | None], symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-gram numbers of all positions (a closing border included) and where each text's begin."""
    points, lengths = _code_points(texts)
    known = np.full(0x110000, OTHER, np.uint8)
    known[symbols] = np.arange(2, 2 + len(symbols))
    known[[9, 10, 11, 12, 13]] = known[32]
    begins = np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    s = np.full(int((lengths + ORDER).sum()) + ORDER, BORDER, np.int32)
    inside = np.arange(len(points)) + np.repeat(begins + ORDER - 1 - (np.cumsum(lengths) - lengths), lengths)
    s[inside] = known[points]
    n = len(s) - ORDER
    g = np.zeros(n, np.int32)
    for j in range(ORDER):
        g = g * SIZE + s[j : n + j]
    # each text has its length + 1 n-grams, then ORDER - 1 that cross to the next text
    real = np.ones(n, bool)
    for j in range(1, ORDER):
        real[begins + lengths + j] = False
    return g[real], np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(lengths) else begins


def _parts(texts: list[str | None], most: int = 2_000_000) -> Iterator[list[str | None]]:
    """Lists of texts of bounded length in sum (or one text)."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t or "") > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t or "")
    if part:
        yield part


@frees
def _counted(batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """(key, n): counts of of(texts), summed within the task; held at about 2 million keys."""
    keys, counts, held = [], [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        k, at = np.unique(np.concatenate(keys), return_inverse=True)
        return k, np.bincount(at, np.concatenate(counts), len(k)).astype(np.int64)

    for batch in batches:
        for part in _parts(batch.column(0).to_pylist()):
            k, n = np.unique(of(part), return_counts=True)
            keys.append(k.astype(np.int64))
            counts.append(n)
            held += len(k)
            if held > 2_000_000:
                k, n = merged()
                keys, counts, held = [k], [n], len(k)
                if held > 1_000_000:
                    yield pa.record_batch([pa.array(k), pa.array(n)], names=["key", "n"])
                    keys, counts, held = [], [], 0
    if keys:
        k, n = merged()
        yield pa.record_batch([pa.array(k), pa.array(n)], names=["key", "n"])


def train(trusted: DataFrame) -> Model | None:
    """The dense model of all texts of trusted(text, ...); None without any text."""
    texts = trusted.select("text")
    points = texts.mapInArrow(lambda b: _counted(b, lambda t: _code_points(t)[0]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    points = points.where("key not in (9, 10, 11, 12, 13, 32)").orderBy(F.desc("n"), "key").limit(SIZE - 3)
    symbols = np.array([32, *(r.key for r in points.collect())], np.int64)
    counts = texts.mapInArrow(lambda b: _counted(b, lambda t: _grams(t, symbols)[0]), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    order = {ORDER: keep(counts, "ngrams")}
    if order[ORDER].isEmpty():
        return None
    for k in range(ORDER - 1, 0, -1):
        order[k] = order[k + 1].groupBy((F.col("key") % SIZE**k).alias("key")).agg(F.count("*").alias("n"))
    parts = {k: _discounted(order[k]) for k in order}
    # orders 1 to 3 are dense and small; of order 4 only what was seen is listed, at most 64^4 rows
    lower = np.full(SIZE, 1 / SIZE)
    for k in range(1, ORDER):
        shares, contexts = parts[k]
        lower = np.tile(lower.reshape(-1, SIZE), (SIZE if k > 1 else 1, 1)) if k > 1 else lower.reshape(1, SIZE)
        weight = np.ones(SIZE ** (k - 1))
        c = contexts.toPandas()
        weight[c["context"].to_numpy()] = c["back_off"].to_numpy()
        lower = (lower * weight[:, None]).reshape(-1)
        s = shares.toPandas()
        lower[s["key"].to_numpy()] += s["share"].to_numpy()
    shares, contexts = parts[ORDER]
    c, s = contexts.toPandas(), shares.toPandas()
    back_off = np.ones(SIZE ** (ORDER - 1), np.float32)
    back_off[c["context"].to_numpy()] = c["back_off"].to_numpy()
    forget(order[ORDER])
    return Model(symbols, s["key"].to_numpy().astype(np.int32), s["share"].to_numpy().astype(np.float32), back_off, lower.astype(np.float32))


def _discounted(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, share) and (context, back_off) of one order: modified Kneser-Ney with three discounts."""
    kinds = [F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]
    n1, n2, n3, n4 = (float(x or 0) for x in counts.agg(*kinds).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    cut = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    d1, d2, d3 = (min(max(d, 0.1), i + 0.9) for i, d in enumerate(cut))
    n = F.col("n")
    lost = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
    by_context = counts.withColumn("context", F.expr(f"key div {SIZE}"))
    contexts = by_context.groupBy("context").agg(F.sum("n").alias("total"), F.sum(lost).alias("lost"))
    shares = by_context.join(contexts.select("context", "total"), "context").select(F.col("key").cast("int"), ((n - lost) / F.col("total")).alias("share"))
    return shares, contexts.select(F.col("context").cast("int"), (F.col("lost") / F.col("total")).alias("back_off"))


def _key() -> Column:
    """What names a document's row: of equal rows each has the same text and band."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("lang").cast("string"), F.lit("")))


def _graded(docs: DataFrame, labels: DataFrame, band: Band) -> DataFrame:
    """docs with grade_key, perplexity, low, high and keep."""
    spark = docs.sparkSession
    small_batches(spark)
    wanted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    bitmap = bitmap_of(wanted, F.col("doc_id"))
    base = docs.drop("perplexity", "low", "high", "keep", "tongue", "grade_key", "n_read")
    keyed = base.select("doc_id", "text", "lang").withColumns({"key": _key(), "doc_id": F.col("doc_id").cast("long")})
    trusted = sift(keyed.where("doc_id is not null and text <> ''"), F.col("doc_id"), bitmap)
    ids = keyed.select("doc_id").unionByName(wanted).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    if ids.a is not None and ids.b - ids.a >= bitmap.size:  # else each id has a bit of its own, and no text is shuffled
        trusted = trusted.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    # the model isn't fitted on the texts that set the bands, where there are enough
    apart = F.pmod(F.col("key"), F.lit(band.apart)) == 0
    enough = trusted.where(apart).limit(band.least).count() == band.least
    model = kneser_ney.train((trusted.where(~apart) if enough else trusted).select("text", "key"))
    if model is None:
        return base.withColumns({"grade_key": _key(), "perplexity": F.lit(1.0), "low": F.lit(0.0), "high": F.lit(float("inf")), "keep": F.lit(True)})
    scores = kneser_ney.perplexities(keyed, model)
    forget(model[0])
    own = (trusted.where(apart) if enough else trusted).select("key", F.coalesce("lang", F.lit("")).alias("tongue")).join(scores.hint("shuffle_hash"), "key")
    own = keep(own.select("tongue", F.col("perplexity").alias("p")), "trusted_perplexity")
    edges = F.percentile_approx("p", [band.low, band.high], band.accuracy)
    whole = own.agg(edges.alias("q")).first().q
    low, high = F.col("q")[0], F.col("q")[1]
    by_tongue = own.groupBy("tongue").agg(edges.alias("q"), F.count("*").alias("n")).where(F.col("n") >= band.least)
    by_tongue = keep(by_tongue.select("tongue", low.alias("own_low"), high.alias("own_high")), "bands")
    if by_tongue.count() <= MOST_TONGUES:
        by_tongue = F.broadcast(by_tongue)
    read = base.withColumns({"grade_key": _key(), "n_read": F.coalesce(F.length("text"), F.lit(0)), "tongue": F.coalesce("lang", F.lit(""))})
    graded = read.join(scores.withColumnRenamed("key", "grade_key").hint("shuffle_hash"), "grade_key").join(by_tongue, "tongue", "left")
    n = F.col("n_read") + 1
    room = band.margin * F.pow(F.lit(2.0), F.lit(band.spare) / n * F.greatest(F.lit(1.0), band.short / n))
    graded = graded.withColumns({"low": F.coalesce("own_low", F.lit(whole[0])) / room, "high": F.coalesce("own_high", F.lit(whole[1])) * room})
    kept = (F.col("n_read") == 0) | F.col("perplexity").between(F.col("low"), F.col("high"))
    return graded.select(*base.columns, "grade_key", "perplexity", "low", "high", kept.alias("keep"))


def grade(docs: DataFrame, labels: DataFrame, band: Band = Band()) -> DataFrame:
    """docs with perplexity, low, high and keep.

    Trusted texts are those of documents that labels(doc_id, quality) gives quality 1; null labels and ids don't count.
    Without trusted texts every document is kept. A null lang is a language of its own. Null and empty texts hold no
    evidence and are kept; short ones meet a wide band; very long ones are read whole. Equal texts get equal grades. low and high are those of a document's own length. Repeated
    rows are graded each; an empty table gives an empty result; clashing columns with these names are replaced. The
    columns that are read later are shuffled; clean() leaves texts where they are.
    """
    return _graded(docs, labels, band).drop("grade_key")


def clean(docs: DataFrame, labels: DataFrame, band: Band = Band()) -> DataFrame:
    """The rows of docs that grade() keeps."""
    bad = keep(_graded(docs.select("doc_id", "text", "lang"), labels, band).where("not keep").select("grade_key").distinct(), "rejected")
    return without(docs, _key(), bad)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, low, high, keep of all documents; nulls, short texts and so on: see grade."""
    graded = grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return graded.select("doc_id", "lang", "perplexity", "low", "high", "keep")
